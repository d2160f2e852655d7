"""Has this key been seen before? First or repeat for each record of a stream, exactly.

Keys live in a state store on disk (RocksDB), partitioned by key, with checkpoints in the shared folder and
no watermark: a flag for each key that never expires, so memory doesn't grow with the keys. What decides is
whether the flag is there, never a clock. A batch is reduced by key, with a partial step in each map task, before
it goes to the stream: one key that a third of all records carry is one row there.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.operators.shared import STATE_STORE, new_path, set_for, written


class SeenKeys:
    """The state of one stream, in a folder that a later run takes up again.

    inbox/run=<n> holds each batch reduced by key, checkpoint the state, firsts what the state let through.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "seen-keys")

    def _done(self) -> list[int]:
        """Numbers of the batches that are whole in the inbox."""
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/inbox/run=*/_SUCCESS")
        found = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at)
        return sorted(int(f.getPath().getParent().getName()[4:]) for f in found or [])

    def run(self, batch: DataFrame, number: int | None = None) -> DataFrame:
        """Take in a batch (key STRING, ord BIGINT); returns ord of its records that are the first of their key.

        Null keys are left out; of equal keys the least ord is the first. A key of an earlier batch is a repeat
        whatever its ord. number: that of the batch, from 0; one that was taken in before changes nothing and gives
        its answer again, so a run that died can be repeated. Default: the next.
        """
        done = self._done()
        if done:
            self._drain()  # what a dead run left comes first
        number = (done[-1] + 1 if done else 0) if number is None else number
        if number not in done:
            reduced = batch.where("key is not null").groupBy("key").agg(F.min("ord").cast("bigint").alias("ord"))
            reduced.write.mode("overwrite").parquet(f"{self.path}/inbox/run={number}")
            self._drain()
        return self.firsts().where(F.col("run") == number).select("ord")

    def _drain(self) -> None:
        """Hold what is new in the inbox against the state; answers are written by micro-batch, so one that is run
        again replaces itself."""
        spark, target = self.spark, f"{self.path}/firsts"
        stream = spark.readStream.schema("key string, ord bigint, run int").parquet(f"{self.path}/inbox")
        keep = lambda rows, number: rows.select("ord", "run").write.mode("overwrite").parquet(f"{target}/batch={number}")
        with set_for(spark, STATE_STORE):
            stream.dropDuplicates(["key"]).writeStream.outputMode("append").foreachBatch(keep).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    def follow(self, stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, id_col: str = "row_id") -> None:
        """Answer for the records of a stream (id_col unique, key) up to what is there now: write gets those of each
        micro-batch with `repeat`, and its number. A micro-batch that is run again gets the same answers."""

        def one(rows: DataFrame, number: int) -> None:
            rows = written(rows, "seen-keys-batch")
            write(first_or_repeat(rows, self.run(rows.select("key", F.col(id_col).alias("ord")), number), id_col), number)

        stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def firsts(self) -> DataFrame:
        """ord, run of every record that was the first of its key."""
        try:
            return self.spark.read.schema("ord bigint, run int, batch int").parquet(f"{self.path}/firsts").select("ord", "run")
        except Exception as e:  # no batch so far
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], "ord bigint, run int")


def first_or_repeat(records: DataFrame, firsts: DataFrame, id_col: str = "row_id") -> DataFrame:
    """records of one batch (id_col unique, key) with repeat: false for the first of a key, null without key.

    firsts: ord of the same batch's firsts. Only ids meet here, each of them once, so no key can make a task large.
    """
    first = firsts.select(F.col("ord").alias(id_col), F.lit(True).alias("__first"))
    return records.join(first, id_col, "left").withColumn("repeat", F.when(F.col("key").isNotNull(), F.col("__first").isNull())).drop("__first")


def wrong_answers(answers: DataFrame, history: DataFrame) -> DataFrame:
    """records, repeats, wrong, wrong_rate: the answers held against a batch recount of all keys.

    answers: row_id, key, repeat; history: key, ord of everything that came, ord below 0 before all records.
    """
    least = history.where("key is not null").groupBy("key").agg(F.min("ord").alias("least"))
    true_first = least.select(F.col("least").alias("row_id"), F.lit(True).alias("__first"))
    held = answers.where("key is not null").join(true_first, "row_id", "left").withColumn("truth", F.col("__first").isNull())
    wrong = F.sum((F.col("repeat") != F.col("truth")).cast("bigint"))
    return held.agg(
        F.count("*").alias("records"), F.coalesce(F.sum(F.col("repeat").cast("bigint")), F.lit(0)).alias("repeats"),
        F.coalesce(wrong, F.lit(0)).alias("wrong"), F.coalesce(wrong / F.count("*"), F.lit(0.0)).alias("wrong_rate"),
    )
