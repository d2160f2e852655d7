import json
import time

import pytest
from pyspark.sql import functions as F

from morphlake.functions.tagsets import with_tag_id, with_upos
from morphlake.operators.batches import numbered, with_batch
from morphlake.operators.lexicon import latest, lookup, mark_seen, members, not_in, promoted, sizes, unseen
from morphlake.operators.scorers import LexiconScorer, OnnxScorer, TableScorer, table_network
from morphlake.plans.engine import Engine, predictions
from morphlake.schema import CHARS, LABELS, LEXICON, PREDICTIONS, SCORED
from morphlake.sinks.logs import LogWriter, append_to_jsonl, to_json
from morphlake.operators.shared import StateFiles, clear, new_path, path_exists, set_for, written
from morphlake.sources.tables import Bundle, base_dict, load_json, log, seen_words, skipped_lines, stream_jsonl
from morphlake.sources.text import files, lines, resolve_model_dir


@pytest.fixture()
def base(spark):
    return spark.createDataFrame([("дом", [("дом", 3, 1.0)])], LEXICON)


@pytest.fixture()
def scorer(spark):
    root = lambda n: [LABELS["B-ROOT"], *[LABELS["I-ROOT"]] * (n - 2), LABELS["E-ROOT"]]
    return TableScorer(spark.createDataFrame([("кот", root(3), [0.95] * 3), ("пёс", root(3), [0.6] * 3)], SCORED))


def test_sequence(spark, tmp_path, base, scorer):
    path = str(tmp_path / "log")
    engine = Engine(spark, scorer, base, LogWriter(path, "jsonl_compat"), scope="session")
    first = engine.predict_dict("Дом кот КОТ пёс .")
    assert list(first) == ["дом", "кот"] and first["дом"] == [("дом", 3, 1.0)] and [m[:2] for m in first["кот"]] == [("кот", 3)]
    assert engine.predict_dict("Дом кот КОТ пёс .") == first
    rows = {r.word: r for r in log(spark, path).collect()}
    assert sorted(rows) == ["кот", "пёс"] and not any(r.validated for r in rows.values()) and rows["пёс"].confidence == 0.6
    again = Engine(spark, scorer, base, LogWriter(path, "jsonl_compat"), scope="session")
    assert again.predict_dict("кот .") == {}
    assert list(Engine(spark, scorer, base, LogWriter(path, "jsonl_compat")).predict_dict("кот .")) == ["кот"]
    assert "ж" * 65 not in again.predict_dict("ж" * 65 + " дом")
    with pytest.raises(ValueError):
        again.predict("  ")
    with pytest.raises(TypeError):
        again.predict(5)
    assert list(again.predict_dict("мышь мышь")) == ["мышь"]


def test_same_word_in_many_partitions(spark, tmp_path, scorer):
    docs = spark.createDataFrame([("кит кит",)] * 40 + [(None,), ("",)], "text string").repartition(8)
    engine = Engine(spark, scorer, writer=LogWriter(str(tmp_path / "log")))
    assert engine.process(docs).count() == 1 and engine.process(docs).count() == 0
    assert engine.writer.read(spark).count() == 1


def test_confidence_is_rounded_before_the_threshold(spark):
    df = spark.createDataFrame([("а", [9], [0.84996])], SCORED)
    p = predictions(df.select("word"), TableScorer(df))
    assert promoted(p).count() == 1 and promoted(p.withColumn("confidence", F.lit(None).cast("double"))).count() == 0


def test_log_files(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    append_to_jsonl(str(path), {"word": "кот", "morphemes": [["ко\"т", 3, 0.91]], "confidence": 0.91, "model": "m", "repaired": False, "validated": False})
    with path.open("a") as f:
        f.write('\nBAD{\n{"nope":1}\n{"word":"кит","morphemes":[{"text":"кит","type_id":3,"confidence":0.5}]}\n')
    rows = {r.word: r.morphemes for r in log(spark, str(path)).collect()}
    assert [tuple(m) for m in rows["кот"]] == [('ко"т', 3, 0.91)] and [tuple(m) for m in rows["кит"]] == [("кит", 3, 0.5)]
    assert skipped_lines(spark, str(path)) == 2
    assert sorted(r.word for r in seen_words(spark, str(path)).collect()) == ["кит", "кот"]
    assert seen_words(spark, str(tmp_path / "none")).count() == 0 and log(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILED"):
        stream_jsonl(spark, str(path), "word string").collect()
    for kind in ("parquet", "json", "jsonl_compat"):
        w = LogWriter(str(tmp_path / "deep" / kind), kind)
        assert w.read(spark).count() == 0
        w.write(log(spark, str(path)))
        assert {r.word: r.morphemes for r in w.read(spark).collect()} == rows
    line = next(p for p in (tmp_path / "deep" / "jsonl_compat").glob("part-*")).read_text().splitlines()[0]
    assert json.loads(line)["morphemes"][0][1] == 3
    with pytest.raises(ValueError):
        LogWriter("x", "csv")


def test_bundle(spark, tmp_path, base):
    config = {"model_specs": {"name": "m", "maxlen": 8}, "mapping": {"label2id": LABELS, "tokenizer_vocab": CHARS}, "resources": {"weights": "w.onnx", "base_dict": "d.json", "output": "o"}}
    to_json(config, str(tmp_path / "b" / "config.json"))
    to_json({"дом": [["дом", 3, 1.0]], "пусто": []}, str(tmp_path / "b" / "d.json"))
    with pytest.raises(FileNotFoundError):
        Bundle.load(str(tmp_path / "b"))
    with pytest.raises(FileNotFoundError):
        Bundle.load(str(tmp_path))
    b = Bundle.load(str(tmp_path / "b"), need_weights=False)
    assert b.maxlen == 8 and Bundle.from_config(b.to_config()).to_config() == b.to_config() and load_json(str(tmp_path / "b" / "config.json")) == config
    assert {r.word: len(r.morphemes) for r in base_dict(spark, b.base_dict).collect()} == {"дом": 1, "пусто": 0}
    engine = Engine.from_pretrained(spark, str(tmp_path / "b"), scorer=LexiconScorer(base))
    assert list(engine.predict_dict("дом слово домик")) == ["дом"]  # others are scored 0.5


def test_lexicon(spark, base):
    words = spark.createDataFrame([("дом",), ("кот",), (None,), ("кот",), ("ж" * 65,)], "word string")
    seen = spark.createDataFrame([("кот",), (None,)], "word string")
    assert [r.word for r in unseen(words, seen).collect()] == ["дом"]
    assert sorted(r.word for r in not_in(words, base).collect()) == ["ж" * 65, "кот", "кот"]
    assert members(words, base, seen).count() == 3
    assert sorted(r.word for r in mark_seen(words, seen).collect()) == ["дом", "ж" * 65, "кот"]
    valid = spark.createDataFrame([("дом", []), ("кот", [("кот", 3, 0.9)])], LEXICON)
    got = {r.word: r.morphemes for r in lookup(words.distinct(), valid, base).collect()}
    assert got["дом"][0].confidence == 1.0 and got["кот"][0].confidence == 0.9 and len(got) == 2
    assert sizes(base, valid, seen).first() == (3, 1)
    writes = spark.createDataFrame([("а", 1, [("а", 3, 0.9)]), ("а", 2, [("а", 4, 0.9)])], "word string, n int, morphemes array<struct<text:string,type_id:int,confidence:double>>")
    assert latest(writes, "n").first().morphemes[0].type_id == 4
    empty = spark.createDataFrame([], LEXICON)
    assert lookup(words, empty, empty).count() == 0 and unseen(words.limit(0), seen).count() == 0


def test_numbers(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k", "id % 3 as t").repartition(5)
    got = {r.k: r.n for r in numbered(df, "k").collect()}
    assert got == {k: k for k in range(1000)}
    ties = sorted(r.n for r in numbered(df, "t").collect())
    assert ties == list(range(1000))
    assert {r.batch: r["count"] for r in with_batch(df, 300, "k").groupBy("batch").count().collect()} == {0: 300, 1: 300, 2: 300, 3: 100}
    assert numbered(df.limit(0), "k").count() == 0


def test_tagsets(spark):
    df = spark.createDataFrame([("RUCORPORA", "POS", "S"), ("RUCORPORA", "POS", "ANUM"), ("RUCORPORA", "CASE", "adnum"), ("RUCORPORA", "GENDER", "m-f"), ("OPENCORPORA", "POS", "INFN"), ("OPENCORPORA", "CASE", "ablt"), ("OPENCORPORA", "CASE", "loc2"), ("OPENCORPORA", "POS", "NOPE"), ("UPOS", "POS", None)], "standard string, category string, tag string")
    got = {(r.standard, r.tag): (r.upos_tag, r.tag_id) for r in with_tag_id(with_upos(df)).collect()}
    assert [v[0] for v in got.values()] == ["NOUN", "ADJ", "Case=Gen", "Gender=Masc", "VERB", "Case=Ins", "Case=Loc", None, None]
    assert got["RUCORPORA", "S"][1] == 2 and got["RUCORPORA", "adnum"][1] == 12 and got["OPENCORPORA", "NOPE"][1] == 1 and got["UPOS", None][1] is None


def test_providers():
    have = ["CPUExecutionProvider"]
    assert OnnxScorer.providers("cpu", have) == have and OnnxScorer.providers("auto", have) == have
    with pytest.raises(RuntimeError):
        OnnxScorer.providers("cuda", have)


def test_streaming(spark, tmp_path, base, scorer):
    from morphlake.streaming.words import distinct_words, file_stream, process_stream, run_once

    (tmp_path / "in").mkdir()
    for i, t in enumerate(("Кот и кит", "КОТ пёс")):
        (tmp_path / "in" / f"{i}.txt").write_text(t)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    run_once(distinct_words(file_stream(spark, str(tmp_path / "in"), 1)), out, check)
    assert sorted(r.word for r in spark.read.parquet(out).collect()) == ["и", "кит", "кот", "пёс"]
    (tmp_path / "in" / "2.txt").write_text("пёс дом")
    run_once(distinct_words(file_stream(spark, str(tmp_path / "in"), 1)), out, check)
    assert spark.read.parquet(out).count() == 5
    writer = LogWriter(str(tmp_path / "log"))
    process_stream(file_stream(spark, str(tmp_path / "in"), 1), scorer, base, writer, str(tmp_path / "check2"))
    assert sorted(r.word for r in writer.read(spark).collect()) == ["и", "кит", "кот", "пёс"]


def test_network(spark, tmp_path):
    scores = [[((c * 5 + k * 3) % 17) / 17 for k in range(len(LABELS))] for c in range(len(CHARS))]
    path = table_network(str(tmp_path / "net.onnx"), scores)
    words = spark.createDataFrame([("дом",), ("x",), ("ё" * 70,), (None,)], "word string")
    rows = {r.word: r for r in OnnxScorer(path, device="auto").score(words.repartition(2)).collect()}
    assert sorted(rows) == sorted(["дом", "x", "ё" * 70]) and len(rows["ё" * 70].tag_ids) == 64  # a model's longest word
    for w in ("дом", "x"):
        own = [scores[CHARS.get(c, 1)] for c in w]
        assert rows[w].tag_ids == [max(range(len(LABELS)), key=lambda k: (s[k], -k)) for s in own]
        assert rows[w].confs == pytest.approx([max(s) for s in own])
    with pytest.raises(Exception, match="no GPU"):
        OnnxScorer(path, device="cuda").score(words).collect()


def test_engine_of_a_bundle_with_a_network(spark, tmp_path, monkeypatch):
    label = {c: "S-ROOT" if c == "я" else "B-ROOT" if c in "мк" else "E-ROOT" if c in "тр" else "I-ROOT" for c in CHARS}
    scores = [[0.9 if k == LABELS[label[c]] else 0.1 for k in range(len(LABELS))] for c in CHARS]
    folder = tmp_path / "models" / "tiny"
    to_json({"model_specs": {"name": "tiny", "maxlen": 8}, "mapping": {"label2id": LABELS, "tokenizer_vocab": CHARS}, "resources": {"weights": "net.onnx", "output": "log"}}, str(folder / "config.json"))
    table_network(str(folder / "net.onnx"), scores)
    monkeypatch.chdir(tmp_path / "models")  # found by its bare name
    engine = Engine.from_pretrained(spark, "tiny", device="cpu")
    assert engine.predict_dict("Кот, мир и длинноеслово") == {"кот": [("кот", 3, pytest.approx(0.9))], "мир": [("мир", 3, pytest.approx(0.9))], "и": [("и", 3, pytest.approx(0.9))]}
    again = Engine.from_pretrained(spark, f"file://{folder}", device="cpu")  # a remote folder, and the log of the first
    assert [r.word for r in again.process("мир кит").collect()] == ["кит"] and sorted(again.predict_dict("мир кот")) == ["кот", "мир"]
    assert resolve_model_dir("tiny", tmp_path) == str(folder) and resolve_model_dir(folder) == str(folder)
    monkeypatch.chdir(tmp_path)
    assert resolve_model_dir("tiny", tmp_path) == str(folder)
    for name in ("none", str(tmp_path)):
        with pytest.raises(FileNotFoundError):
            resolve_model_dir(name, tmp_path)
    with pytest.raises(FileNotFoundError):
        resolve_model_dir(f"file://{tmp_path}", spark=spark)


@pytest.mark.parametrize("kind", ["parquet", "jsonl_compat"])
def test_last_write_wins_in_time(spark, tmp_path, kind):
    writer = LogWriter(str(tmp_path / "log"), kind)
    for i, name in enumerate("dabc"):  # more rows first, so files differ in size and are packed in another order
        rows = [("слово", [(name, 3, 0.9)], 0.9, "m", False, False)] + [(f"w{i}{k}" * 20, [], 0.1, "m", False, False) for k in range(200 - 60 * i)]
        got = writer.write(spark.createDataFrame(rows, PREDICTIONS).coalesce(1))
        assert got.count() == len(rows)
        time.sleep(0.02)
    engine = Engine(spark, None, writer=writer)
    assert [r.morphemes[0].text for r in engine.validated().where("word = 'слово'").collect()] == ["c"]
    assert Engine(spark, None, writer=writer, scope="session").validated().count() == 0


def test_lines_of_a_file_in_splits(spark, tmp_path):
    text = "".join(f"строка {i} abc\n" for i in range(3000))
    (tmp_path / "big.txt").write_text(text)
    with set_for(spark, {"spark.sql.files.maxPartitionBytes": "8k"}):
        rows = lines(spark, str(tmp_path / "big.txt"))
        assert rows.rdd.getNumPartitions() > 5
        assert "".join(r.text for r in rows.orderBy("start", "line").collect()) == text and rows.select("doc_id").distinct().count() == 1
    (tmp_path / "bad.txt").write_bytes(b"a\xff\xd0\n")
    assert [r.text for r in lines(spark, str(tmp_path / "bad.txt")).collect()] == ["a\ufffd\ufffd\n"]
    for read in (lines, files):
        with pytest.raises(FileNotFoundError):
            read(spark, str(tmp_path / "none")).collect()


def test_large_dictionaries(spark, tmp_path):
    rows = spark.createDataFrame([("дом", [("дом", 3, 1.0)]), ("пусто", [])], LEXICON)
    rows.write.parquet(str(tmp_path / "d.parquet"))
    (tmp_path / "d.jsonl").write_text('{"word": "дом", "morphemes": [["дом", 3, 1.0]]}\n\n{"word": "пусто", "morphemes": []}\n')
    for name in ("d.parquet", "d.jsonl"):
        assert sorted(base_dict(spark, str(tmp_path / name)).collect()) == sorted(rows.collect())
    assert base_dict(spark, str(tmp_path / "none.json")).count() == 0


def test_state_files(spark, tmp_path):
    path = f"file://{tmp_path}/s"
    one, other = StateFiles(spark, path), StateFiles(spark, path)
    assert one.load() is None
    for i in range(4):
        one.save({"i": i})
    assert other.load() == {"i": 3} and sorted(p.name for p in (tmp_path / "s").glob("state-*")) == ["state-000000002", "state-000000003"]
    (tmp_path / "s" / "_draft-x").write_text('{"i"')  # a run died here
    assert other.load() == {"i": 3}


def test_folder_is_cleared(spark):
    path = new_path(spark, "x")
    written(spark.range(3), "y")
    spark.range(3).write.parquet(path)
    assert path_exists(spark, path)
    clear(spark)
    assert not path_exists(spark, path)


def test_entry_without_what_the_subpackage_needs(monkeypatch):
    import sys

    import __spark_entry__

    monkeypatch.delitem(sys.modules, "morphlake.llm.queries", raising=False)
    monkeypatch.setitem(sys.modules, "morphlake.llm", None)  # its import fails
    names = set(__spark_entry__.queries())
    assert {"p6_found", "word_frequency"} <= names and not {n for n in names if n.startswith("p1_")} and "p1_found" not in __spark_entry__.oracle_sql()
