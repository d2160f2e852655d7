import random
import re
from collections import Counter

from pyspark.sql import functions as F

from morphlake.llm.seenkeys import SeenKeys, first_or_repeat, wrong_answers
from morphlake.llm.termcounts import TermCounts

WORDS = ["кот", "Ёж", "дом", "и", "Лес", "x", "5"]


def brute(texts):
    occ, rec = Counter(), Counter()
    for t in texts:
        w = re.findall("[а-яё]+", t.lower())
        occ.update(w)
        rec.update(set(w))
    return {w: (occ[w], rec[w]) for w in occ}


def test_deltas_add_up(spark):
    rng = random.Random(1)
    rows = {i: rng.choice([None, "", " ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 9)))]) for i in range(120)}
    frame = lambda items: spark.createDataFrame(items, "id int, text string, sign int, term string, part int")
    first = [(i, t, 1, "z", 9) for i, t in rows.items() if i < 80]
    counts = TermCounts(spark)
    counts.apply(frame(first), sign_col="sign")
    change = [(i, t, 1, "z", 9) for i, t in rows.items() if i >= 80]
    for i in range(0, 40):  # changed and deleted records
        change.append((i, rows[i], -1, "z", 9))
        rows[i] = "новый текст кот" if i % 2 else None
        if i % 2:
            change.append((i, rows[i], 1, "z", 9))
    counts.apply(frame(change), sign_col="sign")
    counts = TermCounts(spark, counts.path)  # as a later session finds it
    now = {i: t for i, t in rows.items() if t is not None}
    got = {r.term: (r.occurrences, r.records) for r in counts.table().collect()}
    total = got.pop("")
    assert got == brute(now.values()) and total == (len(now), len(now))
    marks = {r.term: r.mark for r in counts.marked(rare=2, common=0.3).collect()}
    for w, (_, n) in got.items():
        assert marks[w] == ("rare" if n <= 2 else "common" if n > 0.3 * len(now) else None)


def test_large_counts_stay_until_a_merge(spark):
    counts = TermCounts(spark)
    batch = lambda *texts: spark.createDataFrame([(t,) for t in texts], "text string")
    counts.apply(batch("раз два три четыре пять шесть семь восемь девять десять", "кот"))
    first = counts.segments[0]
    counts.apply(batch("кот"))
    assert counts.segments[0] == first and len(counts.segments) == 2
    assert counts.table().where("term = 'кот'").first().records == 2
    counts.apply(batch("кот лес дом"))  # as large as the one before, not as the first
    assert counts.segments[0] == first and len(counts.segments) == 2
    counts.apply(batch("а б в г д е ж"))
    assert len(counts.segments) == 1 and counts.table().where("term = ''").first().records == 5
    counts.apply(spark.createDataFrame([], "text string"))
    assert counts.table().where("term = 'лес'").first().records == 1


def test_a_batch_counts_once(spark):
    counts = TermCounts(spark)
    rows = spark.createDataFrame([("кот кот",)], "text string")
    counts.apply(rows, number=0)
    again = TermCounts(spark, counts.path)  # a run that doesn't know whether it came to an end
    again.apply(rows, number=0).apply(rows, number=1)
    assert again.table().where("term = 'кот'").first().asDict() == {"term": "кот", "occurrences": 4, "records": 2}
    assert again.next == 2


def test_empty_counts(spark):
    counts = TermCounts(spark)
    assert counts.marked().count() == 0
    counts.apply(spark.createDataFrame([(None,)], "text string"))
    assert counts.marked().count() == 0 and counts.table().count() == 0


def test_hot_key_and_batches(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, rng.choice(["hot", "hot", None, f"k{rng.randint(0, 60)}"])) for i in range(900)]
    path = f"file://{tmp_path}/state"
    seen, want, got = set(), {}, {}
    for number, part in enumerate(([r for r in rows if r[0] >= 300], [r for r in rows if r[0] < 300])):  # the later rows come first
        batch = spark.createDataFrame(part, "ord bigint, key string").withColumn("run", F.lit("x"))
        firsts = SeenKeys(spark, path).run(batch.repartition(3), number)  # each by another run, which has only the folder
        for i, k in sorted(part):
            want[i] = None if k is None else k in seen
            if k is not None:
                seen.add(k)
        records = spark.createDataFrame(part, "row_id bigint, key string").withColumn("ord", F.lit(0))
        got |= {r.row_id: r.repeat for r in first_or_repeat(records, firsts).collect()}
    assert got == want
    again = SeenKeys(spark, path).run(batch, 1)  # the same batch again: the same answer, and no new keys
    assert sorted(r.ord for r in again.collect()) == sorted(r.ord for r in firsts.collect())
    assert SeenKeys(spark, path).firsts().count() == len(seen)
    assert SeenKeys(spark, path).run(batch).count() == 0  # as another batch all its keys are known
    assert SeenKeys(spark, f"file://{tmp_path}/none").firsts().count() == 0


def test_a_stream_is_answered(spark, tmp_path):
    rows = [(i, f"k{i % 7}" if i % 5 else None) for i in range(60)]
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    state, seen, want = SeenKeys(spark, f"file://{tmp_path}/state"), set(), {}
    for part in (rows[:10], rows[10:30], rows[30:]):
        spark.createDataFrame(part, "row_id bigint, key string").coalesce(1).write.mode("append").parquet(source)
        for i, k in part:
            want[i] = None if k is None else k in seen
            seen.add(k)
        stream = spark.readStream.schema("row_id bigint, key string").option("maxFilesPerTrigger", 1).parquet(source)
        state.follow(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), str(tmp_path / "checkpoint"))
    assert {r.row_id: r.repeat for r in spark.read.parquet(out).collect()} == want


def test_no_clock_decides(spark, tmp_path, monkeypatch):
    import time

    state = SeenKeys(spark, f"file://{tmp_path}/state")
    batch = lambda *keys: spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "ord bigint, key string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    assert state.run(batch("a", "b")).count() == 2
    monkeypatch.setattr(time, "time", lambda: 0.0)
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")  # the session's clock goes back
    try:
        assert [r.ord for r in state.run(batch("b", "c", "a", "c")).collect()] == [1]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    import inspect

    from morphlake.llm import seenkeys

    assert "current_timestamp" not in inspect.getsource(seenkeys)


def test_a_run_that_died_after_its_inbox(spark, tmp_path):
    state = SeenKeys(spark, f"file://{tmp_path}/state")
    spark.createDataFrame([("a", 5)], "key string, ord bigint").write.parquet(f"{state.path}/inbox/run=0")
    assert state.run(spark.createDataFrame([(1, "a"), (2, "b")], "ord bigint, key string"), 1).collect()[0].ord == 2
    assert [r.ord for r in state.run(spark.createDataFrame([(5, "a")], "ord bigint, key string"), 0).collect()] == [5]


def test_keys_meet_the_stored_state(spark, tmp_path, monkeypatch):
    from morphlake.llm import queries

    def state(spark):
        return SeenKeys(spark, f"file://{tmp_path}/state")

    monkeypatch.setattr(queries, "SeenKeys", state)
    rows = [(1, "accepted", "кот"), (2, None, "дом"), (3, "new", " Кот "), (4, "new", "лес"), (5, "new", "лес"), (6, "new", "Старое"), (7, "new", None)]
    spark.createDataFrame(rows, "row_id bigint, stage string, word string").write.parquet(str(tmp_path / "predictions.parquet"))
    spark.createDataFrame([("старое",), (None,)], "word string").write.parquet(str(tmp_path / "seen.parquet"))
    assert sorted(r.row_id for r in queries.p5_found(spark, str(tmp_path)).collect()) == [3, 5, 6]
    runs = spark.read.parquet(str(tmp_path / "state" / "firsts")).groupBy("batch").count().collect()
    assert sorted((r.batch, r["count"]) for r in runs) == [(0, 1), (1, 2), (2, 1)]  # seen, accepted, new
    late = [(1, "new", "кот"), (2, "accepted", "кот"), (3, "new", "дом")]  # a new row before an accepted one shows as a wrong answer
    spark.createDataFrame(late, "row_id bigint, stage string, word string").write.parquet(str(tmp_path / "late" / "predictions.parquet"))
    spark.createDataFrame([("x",)], "word string").write.parquet(str(tmp_path / "late" / "seen.parquet"))
    monkeypatch.setattr(queries, "SeenKeys", SeenKeys)
    assert queries.p5_wrong_rate(spark, str(tmp_path / "late")).first() == (2, 1, 1, 0.5)


def test_wrong_answers_are_counted(spark):
    history = spark.createDataFrame([("a", 1), ("a", 2), ("b", -1), ("b", 3), (None, 4)], "key string, ord bigint")
    right = spark.createDataFrame([(1, "a", False), (2, "a", True), (3, "b", True), (4, None, None)], "row_id bigint, key string, repeat boolean")
    assert wrong_answers(right, history).first() == (3, 2, 0, 0.0)
    wrong = right.withColumn("repeat", F.lit(True))
    assert wrong_answers(wrong, history).first() == (3, 3, 1, 1 / 3)
    assert wrong_answers(right.limit(0), history).first() == (0, 0, 0, 0.0)
