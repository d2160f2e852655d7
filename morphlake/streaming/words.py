"""Unbounded input: files or rows as micro-batches, each new word once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.functions.lexer import words
from morphlake.operators.lexicon import not_in, unseen
from morphlake.operators.scorers import Scorer
from morphlake.operators.shared import STATE_STORE, set_for
from morphlake.plans.engine import predictions
from morphlake.schema import MAX_WORD
from morphlake.sinks.logs import LogWriter


def file_stream(spark: SparkSession, folder: str, most_files: int | None = None, whole: bool = False) -> DataFrame:
    """text of the files that come into a folder, line by line, as no word goes over a line, or with whole a row for
    each file; most_files bounds a micro-batch."""
    reader = spark.readStream.format("text").option("wholetext", whole)
    if most_files:
        reader = reader.option("maxFilesPerTrigger", most_files)
    return reader.load(folder).select(F.col("value").alias("text"))


def distinct_words(stream: DataFrame, text_col: str = "text", most: int | None = None) -> DataFrame:
    """word: each Russian word of a stream once, as long as its state lives (no watermark: it does not expire)."""
    return words(stream.select(text_col), text_col, 1, most).select("word").dropDuplicates(["word"])


def run_once(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Append a stream's rows to a Parquet table up to what is there now; a restart goes on where this ended.

    State, such as the words seen, is kept on disk."""
    with set_for(stream.sparkSession, STATE_STORE):
        stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def process_stream(stream: DataFrame, scorer: Scorer, base: DataFrame, writer: LogWriter, checkpoint: str, text_col: str = "text") -> None:
    """Score the new words of each micro-batch and append them to the log.

    The stream's state knows its own words; only those new to it, a few late in a long stream, are held against the
    log, which also knows those of other writers and of a micro-batch that is run again.
    """

    def one(batch: DataFrame, number: int) -> None:
        writer.write(predictions(unseen(not_in(batch, base), writer.read(batch.sparkSession).select("word"), ordered=False), scorer))

    with set_for(stream.sparkSession, STATE_STORE):
        distinct_words(stream, text_col, MAX_WORD).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
