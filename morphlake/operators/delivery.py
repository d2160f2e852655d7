"""Messages delivered more than once: keep exactly one copy, without moving their payload.

Only the identifier, the order of delivery and the place of each row (file, row number) are shuffled. Per
identifier the first delivery wins; the winners' places become one bitmap for each 32,768 rows of each file
(a deletion vector, kept as its complement), and these are applied while the wide rows are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from morphlake.functions.keys import trimmed, word_key
from morphlake.operators.shared import new_path

ROWS_A_BITMAP = 32_768
#: Bitmaps of more bytes than this are read from the shared folder by each task instead of broadcast.
MOST_BROADCAST = 64 << 20

_FILE, _POS = "__delivery_file", "__delivery_pos"


def message_key(id_col: str = "msg_id", word_col: str = "word") -> tuple[Column, Column]:
    """Identifier and word under which two rows are one message; null where the row is never a repeat."""
    ident = F.lower(trimmed(id_col))
    return F.when(F.col(id_col).isNotNull(), ident), word_key(word_col)


def _placed(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select("*", F.xxhash64("_metadata.file_path").alias(_FILE), F.col("_metadata.row_index").alias(_POS))


def _check_files(df: DataFrame) -> None:
    """File names stand for themselves by a 64-bit hash; two files of one hash would share a bitmap."""
    names = df.sparkSession.createDataFrame([(f,) for f in df.inputFiles()], "f string")
    n, hashes = names.agg(F.countDistinct("f"), F.countDistinct(F.xxhash64("f"))).first()
    if hashes != n:
        raise ValueError(f"two of {n} files share a hash; read them as two tables")


def _rank(df: DataFrame, order_col: str) -> Column | None:
    """The order as a bigint, null before all; None if its type isn't one that a bigint can hold."""
    kind = df.schema[order_col].dataType
    if isinstance(kind, T.TimestampType):
        return F.coalesce(F.unix_micros(order_col), F.lit(-(1 << 63)))
    return F.coalesce(F.col(order_col).cast("bigint"), F.lit(-(1 << 63))) if isinstance(kind, T.IntegralType) else None


def keep_bitmaps(spark: SparkSession, path: str, keys: tuple[Column, Column], order_col: str) -> str:
    """Write file, block, bits of the rows that win their identifier; returns the table's path.

    A row without one of the keys takes part in nothing here: it is kept without a bit. The least order wins, a
    missing one before all; of rows that tie, one wins. Winners are found by aggregation with a partial step in each
    map task, so an identifier that a third of all rows carry costs no task more than one row from each other task.
    Where the order is a number or time, Spark hashes instead of sorting: file and place are two aggregates that see
    the same rows in the same order, so both are those of one row.
    """
    rows = _placed(spark, path)
    _check_files(spark.read.parquet(path))
    rank = _rank(rows, order_col)
    slim = rows.select(keys[0].alias("k0"), keys[1].alias("k1"), (F.col(order_col) if rank is None else rank).alias("o"), F.col(_FILE).alias("f"), F.col(_POS).alias("p"))
    groups = slim.where("k0 is not null and k1 is not null").groupBy("k0", "k1")
    if rank is None:
        best = groups.agg(F.min(F.struct("o", "f", "p")).alias("at")).select("at.f", "at.p")
    else:
        best = groups.agg(F.min_by("f", "o").alias("f"), F.min_by("p", "o").alias("p")).select("f", "p")
    place = best.select(F.col("f").alias("file"), F.expr("bitmap_bucket_number(p + 1)").alias("block"), F.expr("bitmap_bit_position(p + 1)").alias("bit"))
    out = new_path(spark, "keep-bitmaps")
    # by place first: a partial bitmap of every block in every task would be larger than the places
    maps = place.repartition("file", "block").groupBy("file", "block").agg(F.expr("bitmap_construct_agg(bit)").alias("bits"))
    maps.repartition("file").sortWithinPartitions("file", "block").write.parquet(out)  # a file's bitmaps lie together
    return out


def _bit() -> Column:
    """Whether the bitmap column `bits` holds the row's place."""
    spot = f"bitmap_bit_position({_POS} + 1)"
    byte = f"cast(conv(hex(substring(__bits, cast({spot} div 8 as int) + 1, 1)), 16, 10) as int)"
    return F.expr(f"coalesce((shiftright({byte}, cast({spot} % 8 as int)) & 1) = 1, false)")


def _side_loaded(bitmaps: str) -> Column:
    """Whether a row wins, by bitmaps that each task loads from the shared folder: those of a file once, when it is met.

    Only file and place go to Python, the rows themselves wait in the JVM.
    """

    @F.pandas_udf("boolean")
    def won(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import numpy as np
        import pyarrow.dataset as ds
        from pyarrow.fs import FileSystem

        fs, at = FileSystem.from_uri(bitmaps) if ":" in bitmaps else (None, bitmaps)
        table, of, bits = ds.dataset(at, format="parquet", filesystem=fs), None, {}
        for file, pos in parts:
            file, pos = file.to_numpy(), pos.to_numpy()
            hit = np.zeros(len(pos), dtype=bool)
            for f in np.unique(file):
                if f != of:
                    got = table.to_table(columns=["block", "bits"], filter=ds.field("file") == int(f))
                    of, bits = f, dict(zip(got["block"].to_pylist(), got["bits"], strict=True))
                own = np.flatnonzero(file == f)
                blocks = pos[own] // ROWS_A_BITMAP
                for block in np.unique(blocks):
                    if (held := bits.get(int(block) + 1)) is not None:
                        here = own[blocks == block]
                        spot = pos[here] % ROWS_A_BITMAP
                        hit[here] = np.frombuffer(held.as_buffer(), dtype=np.uint8)[spot >> 3] >> (spot & 7) & 1
            yield pd.Series(hit)

    return won(F.col(_FILE), F.col(_POS))


def _flagged(spark: SparkSession, path: str, bitmaps: str, columns: list[str], keys: tuple[Column, Column], most_broadcast: int) -> DataFrame:
    """columns, and __superfluous, of every row; the bitmaps are applied as the rows are read, none is shuffled."""
    rows = _placed(spark, path)
    needed = rows.select(*columns, _FILE, _POS, (keys[0].isNotNull() & keys[1].isNotNull()).alias("__keyed"))
    bits = spark.read.schema("file bigint, block bigint, bits binary").parquet(bitmaps)
    if bits.count() * (ROWS_A_BITMAP // 8) <= most_broadcast:
        block = F.expr(f"bitmap_bucket_number({_POS} + 1)")
        held = needed.withColumn("__block", block).join(F.broadcast(bits.select(F.col("file").alias(_FILE), F.col("block").alias("__block"), F.col("bits").alias("__bits"))), [_FILE, "__block"], "left")
        marked = held.withColumn("__won", _bit())
    else:
        marked = needed.withColumn("__won", _side_loaded(bitmaps))
    return marked.select(*columns, (F.col("__keyed") & ~F.col("__won")).alias("__superfluous"))


def delivered_once(spark: SparkSession, path: str, id_col: str = "msg_id", word_col: str = "word", order_col: str = "row_id", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """All columns of the Parquet table at path, with one row for each message.

    A message is identifier (letter case and blanks at the edges left aside) and word key. Rows without
    identifier or word key are all kept, as are messages with an identifier but another word. Of rows that tie
    in order, one stays. An empty table gives an empty result.
    """
    keys = message_key(id_col, word_col)
    marked = _flagged(spark, path, keep_bitmaps(spark, path, keys, order_col), spark.read.parquet(path).columns, keys, most_broadcast)
    return marked.where("not __superfluous").drop("__superfluous")


def superfluous(spark: SparkSession, path: str, id_col: str = "msg_id", word_col: str = "word", order_col: str = "row_id", columns: tuple[str, ...] = ("row_id",), most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """The rows that delivered_once leaves out, read through the same bitmaps."""
    keys = message_key(id_col, word_col)
    marked = _flagged(spark, path, keep_bitmaps(spark, path, keys, order_col), list(columns), keys, most_broadcast)
    return marked.where("__superfluous").drop("__superfluous")
