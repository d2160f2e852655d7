"""How often every term occurs, and in how many records, kept up to date by signed deltas.

Only added, changed and deleted records are read: a changed record is its old text with sign -1 and its new
text with +1. Their terms are counted with a partial step in each map task, and the changes of a batch become a
segment, partitioned by term into as many files as its size asks for. Two neighbouring segments merge once the
younger is at least half as large as the older, so a count is rewritten about log2 of the number of batches times,
and a small batch never rewrites large counts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.operators.shared import StateFiles, new_path, remove

RUSSIAN_TERM = "[а-яё]+"
SCHEMA = "term string, occurrences bigint, records bigint"


def deltas(changes: DataFrame, text_col: str = "text", sign_col: str | None = None, pattern: str = RUSSIAN_TERM) -> DataFrame:
    """term, occurrences, records: the changes by term; the empty term holds the number of records with a text.

    changes has a text and, in sign_col, +1 or -1 (all +1 without it). Null texts count nothing, a text without
    terms counts as a record. Terms are the matches of pattern in the lower-cased text.
    """
    sign = F.col(sign_col).cast("bigint") if sign_col else F.lit(1).cast("bigint")
    rows = changes.where(F.col(text_col).isNotNull()).select(sign.alias("sign"), F.array_sort(F.regexp_extract_all(F.lower(text_col), F.lit(f"({pattern})"), F.lit(1))).alias("w"))
    # sorted, a term's first place in the record is where the one before differs: one pass counts both
    marked = F.transform("w", lambda x, i: F.struct(x.alias("term"), ((i == 0) | (F.get("w", i - 1) != x)).cast("bigint").alias("first")))
    terms = rows.select("sign", F.inline(F.concat(F.array(F.struct(F.lit("").alias("term"), F.lit(1).cast("bigint").alias("first"))), marked)))
    return _summed(terms.select("term", F.col("sign").alias("occurrences"), (F.col("sign") * F.col("first")).alias("records")))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).where("occurrences <> 0 or records <> 0")


class TermCounts:
    """Persistent counts in a folder; a later run goes on where this one ended."""

    def __init__(self, spark: SparkSession, path: str | None = None, pattern: str = RUSSIAN_TERM):
        self.spark, self.path, self.pattern = spark, path or new_path(spark, "term-counts"), pattern
        self.state = StateFiles(spark, self.path)
        kept = self.state.load() or {"segments": [], "next": 0}
        self.segments, self.next = [tuple(s) for s in kept["segments"]], kept["next"]

    def _read(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)

    def _write(self, rows: DataFrame) -> tuple[int, str]:
        at = f"{self.path}/counts-{uuid.uuid4().hex}"
        rows.write.parquet(at)
        return self._read(at).count(), at

    def table(self) -> DataFrame:
        """The counts now; terms that are down to zero are not there. The empty term holds the number of records."""
        held = self._read(*[at for _, at in self.segments])
        return held if len(self.segments) < 2 else _summed(held)

    def apply(self, changes: DataFrame, text_col: str = "text", sign_col: str | None = None, number: int | None = None) -> TermCounts:
        """Take in the changes of a batch. number: that of the batch, rising from 0; one that was applied before
        changes nothing, so a run that died can be repeated. The new counts hold once they are complete."""
        number = self.next if number is None else number
        if number < self.next:
            return self
        segments, old = [*self.segments, self._write(deltas(changes, text_col, sign_col, self.pattern))], []
        while len(segments) > 1 and segments[-2][0] <= 2 * segments[-1][0]:
            pair = [segments.pop()[1], segments.pop()[1]]
            segments.append(self._write(_summed(self._read(*pair))))
            old += pair
        self.state.save({"segments": segments, "next": number + 1})
        self.segments, self.next = segments, number + 1
        for at in old:  # no state names them any more
            remove(self.spark, at)
        return self

    def marked(self, rare: int = 2, common: float = 0.1) -> DataFrame:
        """term, occurrences, records, mark: rare in at most `rare` records, common in more than that share of all."""
        now = self.table()
        total = now.where("term = ''").agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
        mark = F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * total, "common")
        return now.where("term <> ''").withColumn("mark", mark)
