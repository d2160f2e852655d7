"""Lexicons, prediction logs and model bundles."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.operators.shared import path_exists
from morphlake.schema import CHARS, LABELS, LEXICON, MAX_WORD, MORPHEMES, PREDICTIONS, struct_of
from morphlake.sources.text import is_remote, resolve_model_dir, resolve_path


def load_json(path: str, spark: SparkSession | None = None) -> dict:
    """The JSON document of a file; remote paths need the session."""
    path = resolve_path(path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0] if is_remote(path) else Path(path).read_text("utf-8"))


def _typed(arrays):
    """[[text, type, confidence], ...] as an array of structs; the JSON arrays are read as strings."""
    return F.transform(arrays, lambda a: F.struct(F.get(a, 0).alias("text"), F.get(a, 1).cast("int").alias("type_id"), F.get(a, 2).cast("double").alias("confidence"))).cast(MORPHEMES)


def base_dict(spark: SparkSession, path: str) -> DataFrame:
    """word, morphemes of a dictionary; a missing file gives no rows.

    One JSON object word -> [[text, type_id, confidence], ...] is one row and so one task, for files of up to a few
    hundred MB. Larger ones: Parquet with these two columns (a name ending in .parquet), or a line for each word with
    fields word and morphemes (.jsonl), both read in parallel.
    """
    path = resolve_path(path)
    if not path_exists(spark, path):
        return spark.createDataFrame([], LEXICON)
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.schema(LEXICON).parquet(path)
    if path.endswith(".jsonl"):
        return log(spark, path).select("word", "morphemes")
    whole = spark.read.text(path, wholetext=True)
    rows = whole.select(F.explode(F.from_json("value", "map<string,array<array<string>>>")).alias("word", "m"))
    return rows.select("word", _typed(F.col("m")).alias("morphemes"))


#: Type of written_when().
WHEN = "struct<time:timestamp,path:string,start:bigint,n:bigint>"


def written_when() -> Column:
    """By what rows of files rise with the time at which they were written: the file's time, then, as files of one
    time have no order but that of their names, its path, and within it the place of the split and of the row."""
    m = "_metadata."
    return F.struct(F.col(m + "file_modification_time").alias("time"), F.col(m + "file_path").alias("path"), F.col(m + "file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))


def log(spark: SparkSession, path: str | list[str], order: str | None = None) -> DataFrame:
    """The rows of a JSON lines log, morphemes as arrays or objects; malformed lines and lines without word are
    left out, as are blank ones. A missing file gives no rows. order: a column by which later lines come later."""
    paths = [resolve_path(p) for p in ([path] if isinstance(path, str) else path)]
    if not all(path_exists(spark, p) for p in paths):
        return spark.createDataFrame([], PREDICTIONS if order is None else f"{PREDICTIONS}, {order} {WHEN}")
    fields = "word string, morphemes string, confidence double, model string, repaired boolean, validated boolean"
    lines = spark.read.text(paths)
    extra = [] if order is None else [written_when().alias(order)]
    raw = lines.select("value", *extra).where(F.trim("value") != "").select(F.from_json("value", fields).alias("r"), *([order] if order else [])).select("r.*", *([order] if order else [])).where("word is not null")
    as_objects = F.from_json("morphemes", MORPHEMES)
    as_arrays = _typed(F.from_json("morphemes", "array<array<string>>"))
    return raw.withColumn("morphemes", F.when(F.col("morphemes").rlike(r"^\s*\[\s*\{"), as_objects).otherwise(as_arrays)).select(*struct_of(PREDICTIONS).names, *([order] if order else []))


def skipped_lines(spark: SparkSession, path: str) -> int:
    """Lines of a log that are neither blank nor a record with a word."""
    lines = spark.read.text(resolve_path(path)).where(F.trim("value") != "")
    return lines.where(F.from_json("value", "word string")["word"].isNull()).count()


def seen_words(spark: SparkSession, path: str, least: int = 1, most: int = MAX_WORD) -> DataFrame:
    """word: the distinct words of a log, of least to most code points. Only that field of each line is read."""
    path = resolve_path(path)
    if not path_exists(spark, path):
        return spark.createDataFrame([], "word string")
    words = spark.read.text(path).select(F.from_json("value", "word string")["word"].alias("word")).where("word is not null")
    return words.where(F.char_length("word").between(least, most)).dropDuplicates(["word"])


def stream_jsonl(spark: SparkSession, path: str, schema: str = PREDICTIONS) -> DataFrame:
    """The records of a JSON lines file; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(resolve_path(path))


@dataclass
class Bundle:
    """A model's settings: vocabularies, longest word, and where its files are."""

    name: str = "model"
    folder: str = ""
    chars: dict[str, int] = field(default_factory=lambda: dict(CHARS))
    labels: dict[str, int] = field(default_factory=lambda: dict(LABELS))
    maxlen: int = MAX_WORD
    lower: bool = False
    weights: str | None = None
    base_dict: str | None = None
    output: str | None = None

    def to_config(self) -> dict:
        return {"mapping": {"tokenizer_vocab": self.chars, "label2id": self.labels}, "model_specs": {"maxlen": self.maxlen, "name": self.name}}

    @classmethod
    def from_config(cls, config: dict, folder: str = "") -> Bundle:
        files, specs, maps = config.get("resources", {}), config.get("model_specs", {}), config["mapping"]
        inside = lambda name: f"{folder}/{name}" if is_remote(folder) else str(Path(folder) / name)
        at = lambda key: inside(files[key]) if files.get(key) else None
        return cls(specs.get("name", "model"), folder, maps["tokenizer_vocab"], maps["label2id"], specs.get("maxlen", MAX_WORD), False, at("weights"), at("base_dict"), at("output"))

    @classmethod
    def load(cls, folder: str, need_weights: bool = True, spark: SparkSession | None = None, root: str | None = None) -> Bundle:
        """The bundle of a folder with config.json, found by resolve_model_dir; remote folders need the session.
        FileNotFoundError without it, or without weights if needed."""
        folder = resolve_model_dir(folder, root, spark)
        bundle = cls.from_config(load_json(f"{folder}/config.json", spark), folder)
        there = bool(bundle.weights) and (path_exists(spark, bundle.weights) if is_remote(folder) else Path(bundle.weights).is_file())
        if need_weights and not there:
            raise FileNotFoundError(bundle.weights or f"{folder}: no weights named")
        return bundle
