"""Queries of the core over the given tables, and the SQL that says the same.

get_batch.text is the text of token batches, base_dict the lexicon, seen the words of earlier sessions,
predictions the log, tagged the input of the decoder. Arrays come out joined to strings.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.functions.decode import segments, segments_by_window, tag_columns, word_confidence
from morphlake.functions.encode import best, chars, decoded, encoded, padded
from morphlake.functions.lexer import exploded, token_type, tokens, valid_text, words
from morphlake.functions.tagsets import crosswalk_rows, tag_rows, with_tag_id, with_upos
from morphlake.operators.batches import with_batch
from morphlake.operators.delivery import delivered_once, superfluous
from morphlake.operators.lexicon import first_occurrences, latest, lookup, mark_seen, members, not_in, promoted, sizes, unseen
from morphlake.operators.scorers import ArithmeticScorer, LexiconScorer, OnnxScorer, table_network
from morphlake.operators.shared import folder_of, new_path, spread, written
from morphlake.plans.engine import Engine, predictions
from morphlake.schema import CHARS, LABELS, MAX_WORD, MORPHEME_NAMES, MORPHEME_TYPES, PROMOTED
from morphlake.sinks.logs import LogWriter, to_json
from morphlake.sources.tables import seen_words, skipped_lines, stream_jsonl
from morphlake.sources.text import lines, source
from morphlake.streaming.words import distinct_words, file_stream, process_stream, run_once


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "get_batch").select("row_id", "text"))


def ru_words(spark: SparkSession, d: str) -> DataFrame:
    return words(texts(spark, d))


def joined(morphemes: Column) -> Column:
    """text:type pieces of a word, joined by |."""
    return F.array_join(F.transform(morphemes, lambda m: F.concat_ws(":", m["text"], m["type_id"].cast("string"))), "|")


def ids_text(ids: Column) -> Column:
    return F.array_join(F.transform(ids, lambda i: i.cast("string")), " ")


# --- tokens


def token_type_histogram(spark, d):
    return exploded(texts(spark, d)).groupBy("row_id", "type").agg(F.count("*").alias("n"))


def token_types_agree(spark, d):
    """Whether the lexer's types are those that came with the batch."""
    rows = table(spark, d, "get_batch").where("text is not null and types is not null")
    own = F.transform(tokens("text"), token_type)
    return rows.select("row_id", F.size(own).cast("bigint").alias("n_tokens"), (own == F.col("types")).alias("agree"))


def token_mask_filter(spark, d):
    return exploded(texts(spark, d), mask=48).select("row_id", "pos", "text", "type")


def token_length_filter(spark, d):
    return exploded(texts(spark, d), mask=28, least=4, most=12).select("row_id", "pos", "text", "size")


def tokens_lower(spark, d):
    return exploded(texts(spark, d), mask=20).groupBy(F.lower("text").alias("text")).agg(F.count("*").alias("n"))


def char_types(spark, d):
    seen = texts(spark, d).select(F.explode(F.array_distinct(chars("text"))).alias("ch")).distinct()
    return seen.select(F.hex(F.encode("ch", "UTF-8")).alias("utf8"), token_type(F.col("ch")).alias("type"))


def token_batches(spark, d):
    """Batches of 4,096 tokens in order: how many, how many code points, how many words."""
    rows = with_batch(exploded(texts(spark, d)).select("row_id", "pos", "type", "size"), 4096, "row_id", "pos")
    return rows.groupBy("batch").agg(F.count("*").alias("n_tokens"), F.sum("size").alias("n_chars"), F.sum((F.col("type") == 16).cast("int")).alias("n_words"))


def token_concat(spark, d):
    """The tokens of each text joined again, and whether that is the text; row by row."""
    rows = texts(spark, d).where("text <> ''").select("row_id", "text", tokens("text").alias("t"))
    return rows.select("row_id", F.size("t").cast("bigint").alias("n"), (F.array_join("t", "") == F.col("text")).alias("same"))


def mask_batches(spark, d):
    """Batches of 512 of those tokens only that a mask lets through, Russian and Latin words, in order."""
    rows = with_batch(exploded(texts(spark, d), mask=20, least=2).select("row_id", "pos", "size"), 512, "row_id", "pos")
    return rows.groupBy("batch").agg(F.count("*").alias("n_tokens"), F.sum("size").alias("n_chars"), F.min("row_id").alias("first_row"))


def file_tokens(spark, d):
    """The texts written as text files and read by lines: tokens of each type, newlines included."""
    path = new_path(spark, "text-files")
    table(spark, d, "get_batch").where("text is not null").select("text").write.text(path)
    return exploded(lines(spark, path).select("text")).groupBy("type").agg(F.count("*").alias("n"), F.sum("size").alias("n_chars"))


def whole_file_words(spark, d):
    """The same files as one document each: what a source of a folder finds."""
    path = new_path(spark, "text-files")
    table(spark, d, "get_batch").where("text is not null").select("text").write.text(path)
    return words(source(spark, path)).groupBy("word").agg(F.count("*").alias("n"))


def malformed_utf8(spark, d):
    """The texts without their last byte, which cuts a character of several bytes."""
    rows = table(spark, d, "get_batch").where("text <> ''").select("row_id", F.encode("text", "UTF-8").alias("b"))
    return rows.select("row_id", valid_text(F.substring("b", F.lit(1), F.length("b") - 1)).alias("text"))


# --- words


def word_frequency(spark, d):
    return ru_words(spark, d).groupBy("word").agg(F.count("*").alias("n"), F.countDistinct("row_id").alias("rows"))


def distinct_words_(spark, d):
    return ru_words(spark, d).select("word").distinct()


def first_occurrence(spark, d):
    return first_occurrences(texts(spark, d), "row_id")


def word_length_filter(spark, d):
    return words(texts(spark, d), least=10, most=14).groupBy("word").agg(F.count("*").alias("n"))


def words_not_in_lexicon(spark, d):
    return not_in(ru_words(spark, d).select("word").distinct(), table(spark, d, "base_dict"))


def words_unseen(spark, d):
    return unseen(not_in(ru_words(spark, d).select("word"), table(spark, d, "base_dict")), table(spark, d, "seen"))


def words_in_lexicon(spark, d):
    return members(ru_words(spark, d), table(spark, d, "base_dict")).groupBy("word").agg(F.count("*").alias("n"))


def registry_members(spark, d):
    return members(ru_words(spark, d).select("word").distinct(), table(spark, d, "base_dict"), _validated(spark, d))


def _validated(spark, d):
    return latest(promoted(table(spark, d, "predictions")), "row_id")


def lexicon_lookup(spark, d):
    found = lookup(ru_words(spark, d).select("word").distinct(), _validated(spark, d), table(spark, d, "base_dict"))
    return found.select("word", joined(F.col("morphemes")).alias("morphemes"))


def sorted_word_chunks(spark, d):
    new = words_unseen(spark, d)
    rows = with_batch(new.withColumn("size", F.char_length("word")), 2048, "size", "word", name="chunk")
    return rows.select("word", F.col("chunk").cast("bigint").alias("chunk"))


def registry_upsert(spark, d):
    return _validated(spark, d).select("word", joined(F.col("morphemes")).alias("morphemes"))


def promoted_words(spark, d):
    return promoted(table(spark, d, "predictions")).select("row_id", "word", "confidence")


def seen_union(spark, d):
    return mark_seen(table(spark, d, "seen"), table(spark, d, "predictions"))


def index_sizes(spark, d):
    return sizes(table(spark, d, "base_dict"), _validated(spark, d), table(spark, d, "seen"))


def well_formed_log(spark, d):
    log = table(spark, d, "predictions")
    return log.agg(F.count("word").alias("loaded"), F.sum(F.col("word").isNull().cast("int")).alias("skipped"))


# --- encoding, labels, decoding


def _dict_words(spark, d):
    return table(spark, d, "base_dict").select("word")


def encode_words(spark, d):
    return table(spark, d, "seen").where("word is not null").select("word").distinct().select("word", ids_text(encoded("word")).alias("ids"))


def encode_lower(spark, d):
    return table(spark, d, "seen").where("word is not null").select("word").distinct().select("word", ids_text(encoded("word", lower=True)).alias("ids"))


def encode_pad(spark, d):
    return _dict_words(spark, d).select("word", ids_text(padded(encoded("word"), MAX_WORD)).alias("ids"))


def decode_ids(spark, d):
    return table(spark, d, "seen").where("word is not null").select("word").distinct().select("word", decoded(padded(encoded("word"), MAX_WORD)).alias("back"))


def argmax_labels(spark, d):
    """Best label and score of each character for scores made by integer arithmetic."""
    n = F.char_length("word")
    scores = F.transform(encoded("word"), lambda c, i: F.transform(F.sequence(F.lit(0), F.lit(26)), lambda k: ((c * 5 + i * 11 + k * 7 + n) % 29) / 32.0))
    tags, confs = best(scores)
    names = F.transform(tags, lambda t: F.try_element_at(F.create_map(*(F.lit(x) for kv in LABELS.items() for x in (kv[1], kv[0]))), t))
    return _dict_words(spark, d).select("word", F.array_join(names, " ").alias("labels"), F.aggregate(confs, F.lit(0.0), lambda a, x: a + x).alias("conf_sum"))


def label_vocab(spark, d):
    rows = [(n, i, n[:1] if n[0] != "<" else None, n[2:] if n[0] != "<" else None, MORPHEME_TYPES.get(n[2:], 0)) for n, i in LABELS.items()]
    return spark.createDataFrame(rows, "label string, id int, prefix string, type string, type_id int")


def morpheme_type_names(spark, d):
    names = F.create_map(*(F.lit(x) for kv in MORPHEME_NAMES.items() for x in kv))
    kinds = table(spark, d, "base_dict").select(F.explode("morphemes").alias("m")).groupBy("m.type_id").agg(F.count("*").alias("n"))
    return kinds.select("type_id", F.try_element_at(names, F.col("type_id")).alias("name"), "n")


def _tagged(spark, d):
    rows = table(spark, d, "tagged")
    return rows.select("case_id", "word", "confs", segments(F.col("word"), tag_columns(F.col("labels"), by_name=True), F.col("confs")).alias("d"))


def bies_segments(spark, d):
    return _tagged(spark, d).select("case_id", F.posexplode("d.morphemes").alias("seg", "m")).select("case_id", "seg", "m.text", "m.type_id", "m.confidence")


def window_segments(spark, d):
    """The segments once more, by windows over a row for each character."""
    rows = table(spark, d, "tagged").where("word is not null and labels is not null and confs is not null")
    n = F.least(F.char_length("word"), F.size("labels"), F.size("confs"))
    cut = [F.slice(c, F.lit(1), n).alias(name) for name, c in (("ch", chars("word")), ("tag", tag_columns(F.col("labels"), by_name=True)), ("conf", F.col("confs")))]
    places = rows.select("case_id", *cut).select("case_id", F.posexplode(F.arrays_zip("ch", "tag", "conf")).alias("pos", "x"))
    found = segments_by_window(places.select("case_id", "pos", "x.ch", "x.tag.prefix", "x.tag.type_id", "x.conf"), "case_id")
    return found.select("case_id", "text", "type_id", "confidence")


def bies_repaired(spark, d):
    return _tagged(spark, d).where("d is not null").select("case_id", "d.repaired", F.size("d.morphemes").alias("n_segments"))


def word_confidences(spark, d):
    rows = table(spark, d, "tagged").where("word is not null")
    return rows.select("case_id", word_confidence(F.col("word"), F.col("confs")).alias("confidence"))


def _scorable(spark, d):
    """The words that are not too long for a model."""
    return not_in(words(texts(spark, d), most=MAX_WORD).select("word").distinct(), table(spark, d, "base_dict"))


def _scored(spark, d, rounded: bool = False):
    return predictions(_scorable(spark, d), ArithmeticScorer(), rounded=rounded)


def rounded_confidences(spark, d):
    """Confidences of four digits, and whether the rounded value promotes the word."""
    return _scored(spark, d, rounded=True).select("word", "confidence", (F.coalesce("confidence", F.lit(0.0)) >= PROMOTED).alias("promoted"))


_SCORES = [[((c * 7 + k * 11) % 32) / 32 for k in range(len(LABELS))] for c in range(len(CHARS))]


def network_scores(spark, d):
    """Labels and confidences by a network in ONNX form, which looks the scores of a character up."""
    path = os.path.join(tempfile.mkdtemp(prefix="morphlake-network-"), "look-up.onnx")
    atexit.register(shutil.rmtree, os.path.dirname(path), ignore_errors=True)
    table_network(path, _SCORES)  # shipped by addFile
    return OnnxScorer(path, device="cpu").score(_scorable(spark, d)).select("word", ids_text(F.col("tag_ids")).alias("labels"), F.aggregate("confs", F.lit(0.0), lambda a, x: a + x).alias("conf_sum"))


def predictions_(spark, d):
    return _scored(spark, d).select("word", joined(F.col("morphemes")).alias("morphemes"), "confidence", "repaired", "validated")


def morphemes_by_type(spark, d):
    # explode would add a filter on the decoded array, which is pushed below the distinct and decodes every occurrence
    rows = _scored(spark, d).select(F.explode_outer("morphemes").alias("m")).where("m is not null")
    return rows.groupBy("m.type_id").agg(F.count("*").alias("n"), F.countDistinct("m.text").alias("texts"))


def lexicon_scorer(spark, d):
    """Labels read off the lexicon and decoded again: the lexicon's morphemes come back where they spell the word."""
    base = table(spark, d, "base_dict")
    return predictions(base.select("word"), LexiconScorer(base), rounded=True).select("word", joined(F.col("morphemes")).alias("morphemes"), "repaired")


def predict_end_to_end(spark, d):
    """Words of the texts in first-occurrence order with morphemes, from the lexicon or scored; nothing is logged."""
    found = first_occurrences(texts(spark, d), "row_id")
    base = table(spark, d, "base_dict")
    made = predictions(not_in(found.select("word").where(F.char_length("word") <= MAX_WORD), base), ArithmeticScorer(), rounded=False).select("word", "morphemes")
    return lookup(found, made, base).select("word", "row_id", "pos", joined(F.col("morphemes")).alias("morphemes"))


def _predicted(spark, d, scope: str, restart: bool):
    """Engine.predict over all texts, the accepted logged before, by the same engine or by an earlier one."""
    rows, base = table(spark, d, "get_batch").select("row_id", "stage", "text"), table(spark, d, "base_dict")
    path = new_path(spark, "engine-log")
    one = lambda: Engine(spark, ArithmeticScorer(), base, LogWriter(path, "jsonl_compat"), scope=scope, threshold=0.5)
    engine = one()
    engine.process(rows.where("stage = 'accepted'").select("text"))
    found = (one() if restart else engine).predict(rows.select(F.col("row_id").alias("doc_id"), "text"))
    return found.select("word", F.col("doc_id").alias("row_id"), "pos", joined(F.col("morphemes")).alias("morphemes"))


def engine_predict(spark, d):
    """What an engine answers: words of the lexicon, and those whose rounded confidence reaches the threshold."""
    return _predicted(spark, d, "session", restart=False)


def engine_restart_log(spark, d):
    """The same by an engine that takes up an earlier one's log: the answers are those of engine_predict."""
    return _predicted(spark, d, "log", restart=True)


def engine_restart_session(spark, d):
    """The same by one that answers for its own session only: words logged before are not scored again, and missing."""
    return _predicted(spark, d, "session", restart=True)


def process_log_roundtrip(spark, d):
    """Process, then read the JSON lines log back: what was appended is what is read."""
    engine = Engine(spark, ArithmeticScorer(), table(spark, d, "base_dict"), LogWriter(new_path(spark, "log"), "jsonl_compat"))
    return engine.process(texts(spark, d)).select("word", joined(F.col("morphemes")).alias("morphemes"), "repaired", "validated")


def log_skip_malformed(spark, d):
    """A log with broken lines: its words, and how many lines were skipped."""
    path = new_path(spark, "broken-log")
    lines = table(spark, d, "seen").where("word is not null").select(F.to_json(F.struct("word")).alias("value")).unionAll(spark.createDataFrame([("BAD{",), ("",), ('{"nope": 1}',), ("[1]",)], "value string"))
    lines.write.text(path)
    return seen_words(spark, path).agg(F.count("*").alias("words")).withColumn("skipped", F.lit(skipped_lines(spark, path)).cast("bigint"))


def stream_dedup(spark, d):
    """Each word of a stream of texts once."""
    out = new_path(spark, "stream-words")
    source = written(texts(spark, d).where("text is not null"), "stream-source")
    folder = source.inputFiles()[0].rsplit("/", 1)[0]
    run_once(distinct_words(spark.readStream.schema(source.schema).parquet(folder)), out, f"{out}-checkpoint")
    return spark.read.schema("word string").parquet(out)


def file_stream_words(spark, d):
    """Each word of text files that come in as a stream, by lines, once."""
    folder, out = new_path(spark, "text-stream"), new_path(spark, "file-words")
    table(spark, d, "get_batch").where("text is not null").select("text").write.text(folder)
    run_once(distinct_words(file_stream(spark, folder)), out, f"{out}-checkpoint")
    return spark.read.schema("word string").parquet(out)


def stream_process(spark, d):
    """The new words of a stream of texts scored and logged, each once."""
    folder, log = new_path(spark, "texts"), LogWriter(new_path(spark, "stream-log"))
    texts(spark, d).where("text is not null").write.parquet(folder)
    stream = spark.readStream.schema("row_id bigint, text string").parquet(folder)
    process_stream(stream, ArithmeticScorer(), table(spark, d, "base_dict"), log, new_path(spark, "stream-log-checkpoint"))
    return log.read(spark).select("word", joined(F.col("morphemes")).alias("morphemes"), "repaired", "validated")


def bundle_process(spark, d):
    """The texts processed by the engine of a model bundle in the shared folder: settings, lexicon, log and network."""
    folder = new_path(spark, "bundle")
    files = {"weights": "net.onnx", "base_dict": "words.parquet", "output": "log"}
    to_json({"model_specs": {"name": "look-up", "maxlen": MAX_WORD}, "mapping": {"label2id": LABELS, "tokenizer_vocab": CHARS}, "resources": files}, f"{folder}/config.json", spark)
    table(spark, d, "base_dict").write.parquet(f"{folder}/words.parquet")
    with tempfile.TemporaryDirectory(prefix="morphlake-network-") as local:
        path = table_network(os.path.join(local, "net.onnx"), _SCORES)
        at, fs = folder_of(spark, f"{folder}/net.onnx")
        fs.copyFromLocalFile(folder_of(spark, f"file://{path}")[0], at)
    engine = Engine.from_pretrained(spark, folder, device="cpu")
    return engine.process(texts(spark, d)).select("word", joined(F.col("morphemes")).alias("morphemes"), "repaired", "model")


def jsonl_rows(spark, d):
    """The log as JSON lines with objects, read back strictly: what a malformed line would stop."""
    path = new_path(spark, "strict-log")
    LogWriter(path, "json").write(table(spark, d, "predictions").where("word is not null"))
    rows = stream_jsonl(spark, path)
    return rows.groupBy("model", "validated").agg(F.count("*").alias("n"), F.count("confidence").alias("n_confidence"), F.sum(F.size("morphemes")).alias("n_morphemes"))


# --- tag sets


def tagset_lookup(spark, d):
    rows = spark.createDataFrame([(s, c, t) for s, c, t, _ in tag_rows()] + [("UPOS", "POS", "NOPE")], "standard string, category string, tag string")
    return with_tag_id(rows)


def tag_crosswalk(spark, d):
    rows = spark.createDataFrame([(s, c, t) for s, c, t, _ in tag_rows() if s != "UPOS"], "standard string, category string, tag string")
    return with_upos(rows)


# --- extensions the data invite


def root_families(spark, d):
    roots = table(spark, d, "base_dict").select("word", F.explode("morphemes").alias("m")).where("m.type_id = 3")
    return roots.groupBy(F.col("m.text").alias("root")).agg(F.countDistinct("word").alias("n_words"), F.min("word").alias("first_word"))


def lexicon_coverage(spark, d):
    known = table(spark, d, "base_dict").select("word", F.lit(1).alias("known"))
    # a word comes once for each row that has it, counted: a frequent word isn't moved again and again
    counted = ru_words(spark, d).groupBy("row_id", "word").agg(F.count("*").alias("n"))
    rows = counted.join(known, "word", "left")
    return rows.groupBy("row_id").agg(F.sum("n").alias("n_words"), F.coalesce(F.sum(F.when(F.col("known") == 1, F.col("n"))), F.lit(0)).alias("n_known"))


def repaired_rate(spark, d):
    rows = _scored(spark, d).groupBy(F.char_length("word").alias("size"))
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("repaired").cast("int")).alias("n_repaired"))


def p6_found(spark, d):
    return superfluous(spark, f"{d}/predictions.parquet")


def p6_once(spark, d):
    return delivered_once(spark, f"{d}/predictions.parquet").select("row_id", "msg_id", "batch_id", "word", "confidence", "model")


QUERIES = {
    f.__name__.rstrip("_"): f
    for f in (
        token_type_histogram, token_types_agree, token_mask_filter, token_length_filter, tokens_lower, char_types, token_batches, token_concat, mask_batches, file_tokens, whole_file_words, malformed_utf8,
        word_frequency, distinct_words_, first_occurrence, word_length_filter, words_not_in_lexicon, words_unseen, words_in_lexicon, registry_members,
        lexicon_lookup, sorted_word_chunks, registry_upsert, promoted_words, seen_union, index_sizes, well_formed_log,
        encode_words, encode_lower, encode_pad, decode_ids, argmax_labels, label_vocab, morpheme_type_names, bies_segments, window_segments, bies_repaired, word_confidences,
        predictions_, rounded_confidences, network_scores, morphemes_by_type, lexicon_scorer, predict_end_to_end, engine_predict, engine_restart_log, engine_restart_session, process_log_roundtrip, log_skip_malformed, stream_dedup, file_stream_words, stream_process, bundle_process, jsonl_rows,
        tagset_lookup, tag_crosswalk, root_families, lexicon_coverage, repaired_rate, p6_found, p6_once,
    )
}

# --- the same in SQL

_ANY = "(?s)([А-Яа-яЁё]+|[A-Za-z]+|[0-9]+|.)"
_PUNCT = r"[!-/:-@\[-`{-~·«»№\x{2010}-\x{201F}\x{2024}-\x{2027}]"


def _type(c: str) -> str:
    return (
        f"case when regexp_matches({c}, '^[А-Яа-яЁё]') then 16 when regexp_matches({c}, '^[A-Za-z]') then 4 when regexp_matches({c}, '^[0-9]') then 8 "
        f"when {c} in (' ', chr(160)) then 1 when {c} = chr(10) then 2 when regexp_matches({c}, '^{_PUNCT}') then 32 else 64 end"
    )


_TOK = f"""
  with l as (select row_id, regexp_extract_all(text, '{_ANY}') as t from get_batch where text is not null),
  u as (select row_id, unnest(t) as text, unnest(range(len(t))) as pos from l),
  tok as (select row_id, pos::int as pos, text, {_type("text")} as type, length(text)::int as size from u)"""
_WORDS = """
  with l as (select row_id, regexp_extract_all(text, '[А-Яа-яЁё]+') as t from get_batch where text is not null),
  u as (select row_id, lower(unnest(t)) as word, unnest(range(len(t)))::int as pos from l),
  w as (select * from u)"""
_VALID = """ v as (
  select word, (arg_max({'m': morphemes}, row_id)).m as morphemes from predictions where coalesce(confidence, 0) >= 0.85 and word is not null group by word)"""


def _joined(c: str) -> str:
    return f"array_to_string(list_transform({c}, lambda m: m.text || ':' || m.type_id), '|')"


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda x: "null" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return "(values " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + f") as t({names})"


_CHARS = _values([(c, i) for c, i in CHARS.items() if len(c) == 1], "ch, id")
_LABELS = _values([(n, i, n[:1], MORPHEME_TYPES.get(n[2:], 0)) for n, i in LABELS.items()], "label, id, prefix, type_id")


def _ids(words_sql: str, lower: bool = False, most: int = 10_000) -> str:
    """CTEs cv, ch: a row for each character of each word: word, i, ch, id."""
    c = "lower(x.word)" if lower else "x.word"
    return f"""cv as (select * from {_CHARS}),
      x as ({words_sql}),
      p as (select x.word, unnest(range(least(length({c}), {most}))) as i from x),
      ch as (select p.word, p.i::int as i, substr({c.replace("x.", "p.")}, p.i::int + 1, 1) as ch from p),
      ids as (select ch.word, ch.i, ch.ch, coalesce(cv.id, 1) as id from ch left join cv on cv.ch = ch.ch)"""


_SEEN_WORDS = "select distinct word from seen where word is not null"
_BIES = """
  s0 as (select *, coalesce(last_value(case when prefix in ('B', 'E', 'S') then prefix end ignore nulls)
           over (partition by k order by i rows between unbounded preceding and 1 preceding) = 'B', false) as open from c),
  s1 as (select *, (prefix in ('B', 'S') or (prefix in ('I', 'E') and not open)) as st,
           ((prefix in ('B', 'S') and open) or (prefix in ('I', 'E') and not open)) as er from s0),
  s2 as (select *, sum(st::int) over (partition by k order by i) as sg from s1),
  g as (select k, sg, string_agg(ch, '' order by i) as text, arg_min(type_id, i) as type_id, avg(conf) as confidence
        from s2 where prefix in ('B', 'I', 'E', 'S') group by k, sg),
  gs as (select *, row_number() over (partition by k order by sg) - 1 as seg from g),
  rp as (select k, bool_or(er) or coalesce(arg_max(prefix, i) filter (where prefix in ('B', 'E', 'S')) = 'B', false) as repaired from s2 group by k)"""
_CASES = f"""
  with lv as (select * from {_LABELS}),
  t as (select *, least(length(word), len(labels), len(confs)) as n from tagged where word is not null and labels is not null and confs is not null),
  p as (select case_id, word, labels, confs, unnest(range(n)) as i from t),
  c as (select case_id as k, i, substr(word, i::int + 1, 1) as ch, coalesce(lv.prefix, 'S') as prefix,
          case when lv.label is null then 3 else lv.type_id end as type_id, confs[i + 1] as conf
        from p left join lv on lv.label = p.labels[i + 1]),{_BIES}"""
_NEW = "select distinct word from w where word not in (select word from base_dict)"
_SHORT = f"{_NEW} and length(word) <= 64"
_SCORED = f"""{_WORDS}, lv as (select * from {_LABELS}), {_ids(_SHORT)},
  c as (select word as k, i, ch, lv.prefix, lv.type_id, ((ids.id * 5 + i * 11 + length(word)) % 65) / 64.0::double as conf
        from ids join lv on lv.id = (ids.id * 7 + i * 3 + length(word)) % 27),{_BIES},
  pr as (select c.k as word, avg(c.conf) as confidence from c group by c.k),
  mm as (select k, string_agg(text || ':' || type_id, '|' order by sg) as morphemes from g group by k),
  made as (select pr.word, coalesce(mm.morphemes, '') as morphemes, pr.confidence, rp.repaired, false as validated
           from pr join rp on rp.k = pr.word left join mm on mm.k = pr.word)"""
# the word's confidences are 64ths, so their sum over n words of characters is a fraction: rounded by whole numbers
_SCORED = f"{_SCORED}, ex as (select k as word, sum(conf * 64)::bigint as a, count(*) * 64 as b from c group by k)"
_ROUNDED = """(case when 2 * (a * 10000 % b) > b or (2 * (a * 10000 % b) = b and (a * 10000 // b) % 2 = 1)
  then a * 10000 // b + 1 else a * 10000 // b end) / 10000.0::double"""


def _answers(kept: str = "true") -> str:
    """What an engine answers with a threshold of 0.5, of the predictions that are kept."""
    return f"""{_SCORED}, f as (select word, row_id, pos from (select *, row_number() over (partition by word order by row_id, pos) as z from w) where z = 1),
      q as (select word, {_ROUNDED} as confidence from ex), old as (select distinct w.word from w join get_batch g on g.row_id = w.row_id and g.stage = 'accepted'),
      ok as (select made.word, made.morphemes from made join q on q.word = made.word where q.confidence >= 0.5 and made.morphemes <> '' and {kept})
      select f.word, f.row_id, f.pos, coalesce(ok.morphemes, {_joined("b.morphemes")}) as morphemes
      from f left join ok on ok.word = f.word left join base_dict b on b.word = f.word where ok.morphemes is not null or b.morphemes is not null"""


_BEST = """
      s as (select id, k::int as k, ((id * 7 + k * 11) % 32) / 32.0::double as sc from (select distinct id from ids), range(27) as r(k)),
      b as (select id, max(sc) as sc, min(k) filter (where sc = m) as k from (select *, max(sc) over (partition by id) as m from s) group by id)"""
_B = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{3000}]+"


def _trim(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_B}', ''), '{_B}$', '')"


_SENT = f"""
    with k as (
      select *, lower({_trim("msg_id")}) as k0, nullif(lower({_trim("word")}), '') as k1 from predictions),
    s as (
      select *, k0 is not null and k1 is not null and row_id > min(row_id) over (partition by k0, k1) as again from k)"""
_TAGS = _values(tag_rows(), "standard, category, tag, tag_id")

SQL = {
    "token_type_histogram": f"{_TOK} select row_id, type, count(*) as n from tok group by all",
    "token_types_agree": f"""
      select row_id, len(types) as n_tokens, true as agree from get_batch where text is not null and types is not null""",
    "token_mask_filter": f"{_TOK} select row_id, pos, text, type from tok where type & 48 <> 0",
    "token_length_filter": f"{_TOK} select row_id, pos, text, size from tok where type & 28 <> 0 and size between 4 and 12",
    "tokens_lower": f"{_TOK} select lower(text) as text, count(*) as n from tok where type & 20 <> 0 group by lower(text)",
    "char_types": f"""
      with c as (select distinct unnest(regexp_extract_all(text, '(?s).')) as ch from get_batch)
      select hex(encode(ch)) as utf8, {_type("ch")} as type from c""",
    "token_batches": f"""{_TOK}, n as (select *, (row_number() over (order by row_id, pos) - 1) // 4096 as batch from tok)
      select batch, count(*) as n_tokens, sum(size)::bigint as n_chars, count(*) filter (where type = 16) as n_words from n group by batch""",
    "token_concat": f"{_TOK} select row_id, count(*) as n, true as same from tok group by row_id",
    "mask_batches": f"""{_TOK}, n as (select *, (row_number() over (order by row_id, pos) - 1) // 512 as batch from tok where type & 20 <> 0 and size >= 2)
      select batch, count(*) as n_tokens, sum(size)::bigint as n_chars, min(row_id) as first_row from n group by batch""",
    "file_tokens": f"""{_TOK}, a as (select type, size from tok union all select 2, 1 from get_batch where text is not null)
      select type, count(*) as n, sum(size)::bigint as n_chars from a group by type""",
    "whole_file_words": f"{_WORDS} select word, count(*) as n from w group by word",
    "word_frequency": f"{_WORDS} select word, count(*) as n, count(distinct row_id) as rows from w group by word",
    "distinct_words": f"{_WORDS} select distinct word from w",
    "first_occurrence": f"""{_WORDS}, r as (select *, row_number() over (partition by word order by row_id, pos) as k from w)
      select word, row_id, pos from r where k = 1""",
    "word_length_filter": f"{_WORDS} select word, count(*) as n from w where length(word) between 10 and 14 group by word",
    "words_not_in_lexicon": f"{_WORDS} {_NEW}",
    "words_unseen": f"{_WORDS} {_SHORT} and word not in (select word from seen where word is not null)",
    "words_in_lexicon": f"{_WORDS} select word, count(*) as n from w where word in (select word from base_dict) group by word",
    "registry_members": f"""{_WORDS}, {_VALID} select distinct word from w where word in (select word from base_dict) or word in (select word from v)""",
    "lexicon_lookup": f"""{_WORDS}, {_VALID}, d as (select distinct word from w),
      f as (select d.word, case when len(v.morphemes) > 0 then v.morphemes else b.morphemes end as ms
            from d left join v on v.word = d.word left join base_dict b on b.word = d.word)
      select word, {_joined("ms")} as morphemes from f where ms is not null""",
    "sorted_word_chunks": f"""{_WORDS}, n as ({_SHORT} and word not in (select word from seen where word is not null))
      select word, (row_number() over (order by length(word), encode(word)) - 1) // 2048 as chunk from n""",
    "registry_upsert": f"with {_VALID} select word, {_joined('morphemes')} as morphemes from v",
    "promoted_words": "select row_id, word, confidence from predictions where coalesce(confidence, 0) >= 0.85",
    "seen_union": "select word from seen where word is not null union select word from predictions where word is not null",
    "index_sizes": f"""with {_VALID} select (select count(*) from base_dict) + (select count(*) from v) as registry,
      (select count(distinct word) from seen) as seen""",
    "well_formed_log": "select count(word) as loaded, count(*) filter (where word is null) as skipped from predictions",
    "encode_words": f"with {_ids(_SEEN_WORDS)} select x.word, coalesce(string_agg(id::varchar, ' ' order by i), '') as ids from x left join ids on ids.word = x.word group by x.word",
    "encode_lower": f"with {_ids(_SEEN_WORDS, True)} select x.word, coalesce(string_agg(id::varchar, ' ' order by i), '') as ids from x left join ids on ids.word = x.word group by x.word",
    "encode_pad": f"""with {_ids("select word from base_dict", False, 64)}
      select word, rtrim(string_agg(id::varchar, ' ' order by i) || ' ' || repeat('0 ', greatest(64 - length(word), 0)::int)) as ids from ids group by word""",
    "decode_ids": f"""with {_ids(_SEEN_WORDS, False, 64)}
      select x.word, coalesce(string_agg(case when id = 1 then '<UNK>' else ids.ch end, '' order by i), '') as back from x left join ids on ids.word = x.word group by x.word""",
    "argmax_labels": f"""with lv as (select * from {_LABELS}), {_ids("select word from base_dict")},
      s as (select word, i, k::int as k, ((id * 5 + i * 11 + k * 7 + length(word)) % 29) / 32.0::double as sc from ids, range(27) as r(k)),
      a as (select word, i, max(sc) as sc, min(k) filter (where sc = m) as k from (select *, max(sc) over (partition by word, i) as m from s) group by word, i)
      select word, string_agg(label, ' ' order by i) as labels, sum(sc) as conf_sum from a join lv on lv.id = a.k group by word""",
    "label_vocab": "select label, id, prefix, type, type_id from "
    + _values([(n, i, None if n[0] == "<" else n[:1], None if n[0] == "<" else n[2:], MORPHEME_TYPES.get(n[2:], 0)) for n, i in LABELS.items()], "label, id, prefix, type, type_id"),
    "morpheme_type_names": f"""with m as (select unnest(morphemes) as m from base_dict), n as (select m.type_id as type_id, count(*) as n from m group by 1)
      select n.type_id, name, n from n left join {_values([(i, s) for i, s in MORPHEME_NAMES.items()], "type_id, name")} on t.type_id = n.type_id""",
    "bies_segments": f"{_CASES} select k as case_id, seg, text, type_id, confidence from gs",
    "window_segments": f"{_CASES} select k as case_id, text, type_id, confidence from gs",
    "malformed_utf8": """select row_id, text[:-2] || case when ord(text[-1]) > 127 then chr(65533) else '' end as text from get_batch where text <> ''""",
    "bies_repaired": f"""{_CASES} select t.case_id, coalesce(rp.repaired, false) as repaired, count(gs.k) as n_segments
      from t left join rp on rp.k = t.case_id left join gs on gs.k = t.case_id group by 1, 2""",
    "word_confidences": "select case_id, list_avg(confs[1:length(word)]) as confidence from tagged where word is not null",
    "predictions": f"{_SCORED} select * from made",
    "rounded_confidences": f"{_SCORED}, q as (select word, {_ROUNDED} as confidence from ex) select word, confidence, confidence >= 0.85 as promoted from q",
    "network_scores": f"""{_WORDS}, {_ids(_SHORT)}, {_BEST}
      select word, string_agg(b.k::varchar, ' ' order by i) as labels, sum(b.sc) as conf_sum from ids join b on b.id = ids.id group by word""",
    "morphemes_by_type": f"{_SCORED} select type_id, count(*) as n, count(distinct text) as texts from g group by type_id",
    "lexicon_scorer": f"""select word, case when array_to_string(list_transform(morphemes, lambda m: m.text), '') = word
      then {_joined("morphemes")} else word || ':3' end as morphemes, false as repaired from base_dict""",
    "predict_end_to_end": f"""{_SCORED}, f as (select word, row_id, pos from (select *, row_number() over (partition by word order by row_id, pos) as z from w) where z = 1)
      select f.word, f.row_id, f.pos, coalesce(nullif(made.morphemes, ''), {_joined("b.morphemes")}) as morphemes
      from f left join made on made.word = f.word left join base_dict b on b.word = f.word where nullif(made.morphemes, '') is not null or b.morphemes is not null""",
    "engine_predict": _answers(),
    "engine_restart_log": _answers(),
    "engine_restart_session": _answers("made.word not in (select word from old)"),
    "process_log_roundtrip": f"{_SCORED} select word, morphemes, repaired, validated from made",
    "log_skip_malformed": "select count(distinct word) as words, 3::bigint as skipped from seen where word is not null and length(word) between 1 and 64",
    "stream_dedup": f"{_WORDS} select distinct word from w",
    "file_stream_words": f"{_WORDS} select distinct word from w",
    "stream_process": f"{_SCORED} select word, morphemes, repaired, validated from made",
    "bundle_process": f"""{_WORDS}, lv as (select * from {_LABELS}), {_ids(_SHORT)}, {_BEST},
      c as (select word as k, i, ch, lv.prefix, lv.type_id, b.sc as conf from ids join b on b.id = ids.id join lv on lv.id = b.k),{_BIES},
      mm as (select k, string_agg(text || ':' || type_id, '|' order by sg) as morphemes from g group by k)
      select rp.k as word, coalesce(mm.morphemes, '') as morphemes, rp.repaired, 'look-up' as model from rp left join mm on mm.k = rp.k""",
    "jsonl_rows": """select model, validated, count(*) as n, count(confidence) as n_confidence, sum(len(morphemes))::bigint as n_morphemes
      from predictions where word is not null group by model, validated""",
    "tagset_lookup": f"select standard, category, tag, tag_id from {_TAGS} union all select 'UPOS', 'POS', 'NOPE', 1",
    "tag_crosswalk": f"""select t.standard, t.category, t.tag, x.upos_tag from {_TAGS} left join
      (select * from {_values(crosswalk_rows(), "s, c, tag, upos_tag")}) x on x.s = t.standard and x.c = t.category and x.tag = t.tag where t.standard <> 'UPOS'""",
    "root_families": """with m as (select word, unnest(morphemes) as m from base_dict)
      select m.text as root, count(distinct word) as n_words, min(word) as first_word from m where m.type_id = 3 group by 1""",
    "lexicon_coverage": f"{_WORDS} select row_id, count(*) as n_words, count(b.word) as n_known from w left join base_dict b on b.word = w.word group by row_id",
    "repaired_rate": f"{_SCORED} select length(word) as size, count(*) as n, count(*) filter (where repaired) as n_repaired from made group by 1",
    "p6_found": f"{_SENT} select row_id from s where again",
    "p6_once": f"{_SENT} select row_id, msg_id, batch_id, word, confidence, model from s where again is not true",
}
