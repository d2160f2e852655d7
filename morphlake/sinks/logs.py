"""Prediction logs: appended as Parquet, JSON lines with objects, or JSON lines with arrays as other readers expect."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.operators.shared import folder_of, path_exists
from morphlake.schema import PREDICTIONS
from morphlake.sources.text import resolve_path


def ensure_dir(path: str) -> str:
    """Make the folder above a local path; returns the path resolved."""
    at = resolve_path(path)
    if ":" not in at:
        os.makedirs(os.path.dirname(os.path.abspath(at)), exist_ok=True)
    return at


def to_json(obj, path: str, spark: SparkSession | None = None) -> None:
    """Overwrite the file at path with obj as JSON of two blanks a level. Remote paths need the session."""
    text = "\n".join(json.JSONEncoder(ensure_ascii=False, indent=2).encode(obj).splitlines())
    at = ensure_dir(path)
    if ":" in at:
        where, fs = folder_of(spark, at)
        stream = fs.create(where, True)
        stream.write(bytearray(text, "utf-8"))
        stream.close()
        return
    draft = f"{at}.{os.getpid()}.draft"  # readers see the old file or the new one
    with open(draft, "w", encoding="utf-8") as out:
        out.write(text)
    os.replace(draft, at)


def json_line(morphemes: str = "morphemes"):
    """A prediction as one JSON line whose morphemes are arrays [text, type_id, confidence]."""
    quote = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    item = lambda m: F.concat(F.lit("["), quote(m["text"]), F.lit(", "), m["type_id"].cast("string"), F.lit(", "), m["confidence"].cast("string"), F.lit("]"))
    value = lambda name: F.coalesce(F.when(F.col(name).isNotNull(), F.col(name).cast("string")), F.lit("null"))
    text = lambda name: F.coalesce(F.when(F.col(name).isNotNull(), quote(F.col(name))), F.lit("null"))
    parts = [
        F.lit('{"word": '), text("word"), F.lit(', "morphemes": ['), F.array_join(F.transform(F.coalesce(F.col(morphemes), F.array()), item), ", "), F.lit('], "confidence": '), value("confidence"),
        F.lit(', "model": '), text("model"), F.lit(', "repaired": '), value("repaired"), F.lit(', "validated": '), value("validated"), F.lit("}"),
    ]
    return F.concat(*parts)


class LogWriter:
    """Appends predictions to a log. A failed write leaves nothing behind: Spark commits a job as a whole."""

    def __init__(self, path: str, format: str = "parquet"):
        if format not in ("parquet", "json", "jsonl_compat"):
            raise ValueError(format)
        self.path, self.format = ensure_dir(path), format

    def _files(self, spark: SparkSession) -> set[str]:
        at, fs = folder_of(spark, self.path)
        if not fs.exists(at):
            return set()
        held = fs.listStatus(at)
        return {f.getPath().toString() for f in held if not f.getPath().getName().startswith(("_", "."))}

    def write(self, predictions: DataFrame) -> DataFrame:
        """Append, and return what was appended, read from the files that this added."""
        spark = predictions.sparkSession
        rows = predictions.select(*[c.split()[0] for c in ("word", "morphemes", "confidence", "model", "repaired", "validated")])
        before = self._files(spark)
        if self.format == "jsonl_compat":
            rows.select(json_line().alias("value")).write.mode("append").text(self.path)
        elif self.format == "json":
            rows.write.mode("append").json(self.path)
        else:
            rows.write.mode("append").parquet(self.path)
        return self._read(spark, sorted(self._files(spark) - before))

    def _read(self, spark: SparkSession, paths: list[str], order: str | None = None) -> DataFrame:
        from morphlake.sources.tables import WHEN, log, written_when

        if not paths:
            return spark.createDataFrame([], PREDICTIONS if order is None else f"{PREDICTIONS}, {order} {WHEN}")
        if self.format == "parquet":
            rows = spark.read.schema(PREDICTIONS).parquet(*paths)
            return rows if order is None else rows.select("*", written_when().alias(order))
        return log(spark, paths, order)

    def read(self, spark: SparkSession, order: str | None = None) -> DataFrame:
        """What the log holds; no rows before the first write. order: a column by which later writes come later."""
        return self._read(spark, [self.path] if path_exists(spark, self.path) else [], order)


def append_to_jsonl(path: str, record: dict) -> None:
    """Append one record as a line of a local JSON lines file, at the path as given: one write, which is whole even
    where others append too."""
    line = json.JSONEncoder(ensure_ascii=False).encode(record) + "\n"
    handle = os.open(path, os.O_APPEND | os.O_CREAT | os.O_WRONLY, 0o644)
    try:
        os.write(handle, line.encode("utf-8"))
    finally:
        os.close(handle)
