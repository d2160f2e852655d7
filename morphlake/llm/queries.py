"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.functions.keys import word_key
from morphlake.llm.encoding import fit_model, garbled, restored
from morphlake.llm.history import SORTED_BUCKETS, repeated_texts, repeated_words
from morphlake.llm.leakage import leaks
from morphlake.llm.lookalike import look_alike_classes, look_alikes, with_skeleton
from morphlake.llm.mixing import mixture, packed, shares, sized
from morphlake.llm.seenkeys import SeenKeys, first_or_repeat, wrong_answers
from morphlake.llm.sentences import eligible, learn, sentence_units
from morphlake.llm.termcounts import TermCounts
from morphlake.operators.shared import set_for, spread, written


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


#: Arrivals in which p1_found takes in the accepted batches, in the order of their numbers.
ARRIVALS = 3


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(table(spark, d, "get_batch").select("row_id", "batch_id", "stage", "text"))
    new = F.coalesce(F.col("stage") == "new", F.lit(False))
    least, most = rows.where(~new).agg(F.min("batch_id"), F.max("batch_id")).first()
    step = max(1, -(-((most or 0) - (least or 0) + 1) // ARRIVALS))
    arrival = F.coalesce(F.least(F.floor((F.col("batch_id") - (least or 0)) / step), F.lit(ARRIVALS - 1)), F.lit(0))
    model = fit_model(table(spark, d, "base_dict"))

    def of_texts() -> DataFrame:
        return repeated_texts([rows.where(~new & (arrival == k)) for k in range(ARRIVALS)], rows.where(new), model)

    def of_words() -> DataFrame:
        return repeated_words(table(spark, d, "predictions"), table(spark, d, "seen"))

    # two indexes that have nothing to do with each other: the jobs of one fill the gaps between those of the other
    with set_for(spark, {SORTED_BUCKETS: "true"}), ThreadPoolExecutor(2) as pool:
        texts, words = (f.result() for f in [pool.submit(inheritable_thread_target(spark)(f)) for f in (of_texts, of_words)])
    return texts.select(F.lit("get_batch").alias("tab"), "row_id").unionByName(words.select(F.lit("predictions").alias("tab"), "row_id"))


def p1_words(spark: SparkSession, d: str) -> DataFrame:
    """The half of p1_found on single words, which SQL can say."""
    return repeated_words(table(spark, d, "predictions"), table(spark, d, "seen"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled(spread(table(spark, d, "get_batch").select("row_id", "text")), fit_model(table(spark, d, "base_dict")))


def p2_restored(spark: SparkSession, d: str) -> DataFrame:
    return restored(spread(table(spark, d, "get_batch").select("row_id", "text")), fit_model(table(spark, d, "base_dict")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return look_alikes(spread(table(spark, d, "get_batch").select("row_id", "text")))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    return look_alike_classes(spread(table(spark, d, "get_batch").select("row_id", "text")))


def p3_consistent(spark: SparkSession, d: str) -> DataFrame:
    return with_skeleton(spread(table(spark, d, "get_batch").select("row_id", "text")), "text", "consistent").select("row_id", "consistent")


def term_counts(spark: SparkSession, d: str) -> TermCounts:
    """Counts of the accepted batches, then the new batches merged in as a delta."""
    rows = spread(table(spark, d, "get_batch").select("stage", "text"))
    counts = TermCounts(spark)
    counts.apply(rows.where("stage is null or stage <> 'new'"))
    return counts.apply(rows.where("stage = 'new'"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return term_counts(spark, d).marked().where("mark is not null").select("term", "mark")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return term_counts(spark, d).marked()


def _keys(rows: DataFrame) -> DataFrame:
    return rows.select(word_key("word").alias("key"), F.col("row_id").alias("ord"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """The words of earlier sessions, then the accepted, then the new rows go through the state; the answers are
    those it gives on the new rows."""
    rows, state = table(spark, d, "predictions"), SeenKeys(spark)
    state.run(table(spark, d, "seen").select(word_key("word").alias("key"), F.lit(-1).cast("bigint").alias("ord")))
    state.run(_keys(rows.where("stage is null or stage <> 'new'")))
    new = rows.where("stage = 'new'")
    return first_or_repeat(new.select("row_id", word_key("word").alias("key")), state.run(_keys(new)))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _answers(spark, d).where("repeat").select("row_id")


def p5_wrong_rate(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "seen").select(word_key("word").alias("key"), F.lit(-1).cast("bigint").alias("ord"))
    return wrong_answers(_answers(spark, d), _keys(table(spark, d, "predictions")).unionByName(old))


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).where("distance = 0").select("doc_id", "item_id")


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    targets = table(spark, d, "mix_targets")
    blocks = written(packed(written(sized(spread(table(spark, d, "documents").select("doc_id", "source", "text")), targets), "mix-sizes")), "mix-numbered")
    return mixture(blocks, targets), blocks, targets


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return shares(*_mixed(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs = eligible(spread(table(spark, d, "documents").select("doc_id", "text", "lang", "ctype", "cte")))
    return sentence_units(docs, learn(docs))


QUERIES = {
    "p1_found": p1_found,
    "p1_words": p1_words,
    "p2_found": p2_found,
    "p2_restored": p2_restored,
    "p3_found": p3_found,
    "p3_classes": p3_classes,
    "p3_consistent": p3_consistent,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p5_found": p5_found,
    "p5_wrong_rate": p5_wrong_rate,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_mixture": p8_mixture,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
}

_KEY = r"nullif(lower(regexp_replace(regexp_replace({0}, '^[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+', ''), '[\s\x{{00A0}}\x{{2000}}-\x{{200A}}\x{{202F}}\x{{3000}}]+$', '')), '')"
_SEEN = f"""
    with k as (
      select row_id, stage, {_KEY.format("word")} as key from predictions
      union all select -1, 'seen', {_KEY.format("word")} from seen),
    f as (select *, min(row_id) over (partition by key) as least from k where key is not null)"""
_TERMS = """
    with t as (
      select row_id, unnest(regexp_extract_all(lower(text), '[а-яё]+')) as term from get_batch),
    c as (select term, count(*) as occurrences, count(distinct row_id) as records from t group by term),
    m as (select *, case when records <= 2 then 'rare'
      when records > 0.1 * (select count(text) from get_batch) then 'common' end as mark from c)"""

_PLAIN = r"nullif(translate(regexp_replace({0}, '[\x{{0301}}\x{{00AD}}\x{{2010}}\x{{2011}}-]', '', 'g'), 'ё', 'е'), '')"

SQL = {
    "p1_words": f"""
      with k as (
        select row_id, stage, {_PLAIN.format(_KEY.format("word"))} as key from predictions
        union all select -1, 'seen', {_PLAIN.format(_KEY.format("word"))} from seen),
      f as (select *, min(row_id) over (partition by key) as least from k where key is not null)
      select row_id from f where stage = 'new' and row_id > least""",
    "p4_found": f"{_TERMS} select term, mark from m where mark is not null",
    "p4_counts": f"{_TERMS} select term, occurrences, records, mark from m",
    "p5_found": f"{_SEEN} select row_id from f where stage = 'new' and (row_id > least)",
    "p5_wrong_rate": f"""{_SEEN} select count(*) as records, count(*) filter (where row_id > least) as repeats,
      0::bigint as wrong, 0.0::double as wrong_rate from f where stage = 'new'""",
}
