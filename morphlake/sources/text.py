"""Text sources: DataFrames, files, literal strings; batches and streams of tokens."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.functions.lexer import exploded, valid_text
from morphlake.operators.shared import path_exists
from morphlake.schema import ALL_TOKENS, TOKEN_BATCH

_URI = re.compile(r"[A-Za-z][A-Za-z0-9+.-]+:")


def resolve_path(path: str | os.PathLike, root: str | os.PathLike | None = None) -> str:
    """A path as it is if absolute, else under the working folder if it is there, else under root; URIs stay."""
    text = os.fspath(path)
    if _URI.match(text) or os.path.isabs(text):
        return text
    here = Path.cwd() / text
    return str(here if here.exists() or root is None else Path(root) / text)


def is_remote(path: str | os.PathLike) -> bool:
    """Whether a path names a file system, as hdfs:, s3a: or file: do."""
    return bool(_URI.match(os.fspath(path)))


def resolve_model_dir(name: str | os.PathLike, root: str | os.PathLike | None = None, spark: SparkSession | None = None) -> str:
    """The folder of a model bundle, which holds config.json: an absolute path or URI as it is; else under the working
    folder, under root (default: the folder above this package), or by its bare name under root's folder `models`.
    FileNotFoundError where none of these is one."""
    text = os.fspath(name)
    if is_remote(text):
        if spark is None or not path_exists(spark, f"{text}/config.json"):
            raise FileNotFoundError(f"{text}/config.json")
        return text
    root = Path(root) if root is not None else Path(__file__).resolve().parents[2]
    places = [Path(text)] if os.path.isabs(text) else [Path.cwd() / text, root / text, root / "models" / text]
    for at in places:
        if (at / "config.json").is_file():
            return str(at)
    raise FileNotFoundError(f"no config.json in {', '.join(map(str, places))}")


def file_exists(path: str | os.PathLike) -> bool:
    return Path(resolve_path(path)).is_file()


def dir_exists(path: str | os.PathLike) -> bool:
    return Path(resolve_path(path)).is_dir()


def literal(spark: SparkSession, text: str) -> DataFrame:
    """One document. TypeError for what is no string, ValueError for a blank one."""
    if not isinstance(text, str):
        raise TypeError(f"text must be a string, not {type(text).__name__}")
    if not text.strip():
        raise ValueError("text is blank")
    return spark.createDataFrame([(0, text)], "doc_id bigint, text string")


def _checked(paths: str | list[str]) -> list[str]:
    """Paths resolved; PermissionError for a local one that can't be read."""
    paths = [resolve_path(p) for p in ([paths] if isinstance(paths, (str, os.PathLike)) else paths)]
    for p in paths:
        if not is_remote(p) and os.path.exists(p) and not os.access(p, os.R_OK):
            raise PermissionError(p)
    return paths


def files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row for each file: doc_id (hash of the path), path, text (malformed UTF-8 replaced by U+FFFD).

    FileNotFoundError for a path that isn't there, PermissionError for a local one that can't be read. A file is one
    row, so of 2 GB at most; lines() reads larger ones.
    """
    paths = _checked(paths)
    try:
        df = spark.read.format("binaryFile").load(paths)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(str(paths)) from e
        raise
    return df.select(F.xxhash64("path").alias("doc_id"), "path", valid_text(F.col("content")).alias("text"))


def lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A row for each line of files: doc_id (hash of the path), path, start, line, text with its newline.

    For files of any size: Spark reads one in splits of spark.sql.files.maxPartitionBytes, so neither a row nor a task
    holds it whole. A newline is a token of its own and parts all others, so the tokens of the lines, in the order of
    start and line, are those of the file (whose last line is taken to end with a newline too). Malformed UTF-8 is
    replaced by U+FFFD.
    """
    paths = _checked(paths)
    try:
        rows = spark.read.text(paths, lineSep="\n")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(str(paths)) from e
        raise
    path = F.col("_metadata.file_path")
    return rows.select(F.xxhash64(path).alias("doc_id"), path.alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("line"), F.concat(valid_text(F.col("value")), F.lit("\n")).alias("text"))


def source(spark: SparkSession, what: DataFrame | str | os.PathLike, text_col: str = "text") -> DataFrame:
    """doc_id, text of a DataFrame with a text column, of an existing file or folder, or of a literal text."""
    if isinstance(what, DataFrame):
        ids = F.col("doc_id").cast("bigint") if "doc_id" in what.columns else F.monotonically_increasing_id()
        return what.select(ids.alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if isinstance(what, os.PathLike) or isinstance(what, str) and len(what) < 4096 and "\n" not in what and (_URI.match(what) and "/" in what or os.path.exists(resolve_path(what))):
        return files(spark, what).select("doc_id", "text")
    return literal(spark, what)


def token_rows(spark: SparkSession, what, mask: int = ALL_TOKENS, least: int = 0, most: int | None = None, lower: bool = False, drop_last: bool = False) -> DataFrame:
    """doc_id, pos, text, type, size of all tokens of a source."""
    rows = exploded(source(spark, what), "text", mask, least, most, drop_last)
    return rows.withColumn("text", F.lower("text")) if lower else rows


def token_stream(tokens: DataFrame, batch: int = TOKEN_BATCH) -> Iterator[dict]:
    """The tokens in order as batches {text: [...], types: [...]} for a caller on the driver, one at a time."""
    held: list = []
    for r in tokens.orderBy("doc_id", "pos").select("text", "type").toLocalIterator():
        held.append(r)
        if len(held) == batch:
            yield {"text": [x.text for x in held], "types": [x.type for x in held]}
            held = []
    if held:
        yield {"text": [x.text for x in held], "types": [x.type for x in held]}
