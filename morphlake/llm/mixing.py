"""Mixing sources to target weights, in blocks of tokens.

Documents are measured in tokens of a public tokenizer and packed into blocks of a fixed number of tokens,
source by source. The number of blocks each source gives to each output shard is drawn from a multinomial;
a source's slots are numbered through all shards and mapped to its blocks by pseudorandom permutations of
their indices, one for each pass over the source, and slots and blocks meet in a join by index.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from morphlake.functions.keys import trimmed
from morphlake.operators.shared import written

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Setting of the session that names another vocabulary file, at the same place on every machine.
RANKS_SETTING = "spark.morphlake.tokenizer.ranks"
# Fixed value: the pattern by which the byte-level BPE vocabularies split a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Documents packed one after the other by one task.
GROUP_DOCS = 100_000
BLOCK = "source string, grp bigint, block bigint, n_tokens bigint, spans array<struct<doc_id:bigint,first:bigint,n:bigint>>"


def ranks_of(spark: SparkSession) -> str:
    """The vocabulary file of a session: that of RANKS_SETTING, else RANKS."""
    return spark.conf.get(RANKS_SETTING, RANKS)


class Tokenizer:
    """A byte-level BPE vocabulary given as ranks; keeps the lengths of pieces it has met."""

    def __init__(self, ranks_path: str = RANKS, pattern: str = PATTERN, most_kept: int = 500_000):
        import regex
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = regex.compile(pattern)
        self.lengths: dict[str, int] = {}
        self.most_kept = most_kept

    def count(self, text: str) -> int:
        """Number of tokens of a whole text; pieces never merge across each other, so their lengths add up."""
        total, get = 0, self.lengths.get
        for piece in self.pieces.findall(text):
            n = get(piece)
            if n is None:
                n = len(self.encoding.encode_ordinary(piece))
                if len(self.lengths) < self.most_kept:
                    self.lengths[piece] = n
            total += n
        return total


def sized(documents: DataFrame, targets: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """source, doc_id, n_tokens of the documents that have a text and a source with a target."""
    key = F.lower(trimmed("source"))
    wanted = targets.select(key.alias("source")).distinct()
    rows = documents.where(F.col("text").isNotNull() & F.col("source").isNotNull()).select(key.alias("source"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(wanted, "source", "left_semi")  # broadcast by Spark where the targets are small
    ranks_path = ranks_path or ranks_of(documents.sparkSession)

    def run(batches):
        tok = Tokenizer(ranks_path)
        for b in batches:
            counts = [tok.count(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], names=["source", "doc_id", "n_tokens"])

    return rows.mapInArrow(run, "source string, doc_id bigint, n_tokens bigint")


def _pack(block_tokens: int):
    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["doc_id"].to_numpy(), kind="stable")
        docs, sizes = table["doc_id"].to_numpy()[order], table["n_tokens"].to_numpy()[order]
        ends = table["start"][0].as_py() + np.cumsum(sizes)
        starts = ends - sizes
        first, last = starts // block_tokens, np.maximum(ends - 1, starts) // block_tokens
        parts = np.where(sizes > 0, last - first + 1, 0)
        doc = np.repeat(np.arange(len(docs)), parts)
        block = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts) + first[doc]
        lo, hi = np.maximum(starts[doc], block * block_tokens), np.minimum(ends[doc], (block + 1) * block_tokens)
        numbers = np.arange(block[0], block[-1] + 1) if len(block) else block
        offsets = np.searchsorted(block, np.append(numbers, numbers[-1:] + 1))
        spans = pa.StructArray.from_arrays([pa.array(docs[doc]), pa.array(lo - starts[doc]), pa.array(hi - lo)], names=["doc_id", "first", "n"])
        size = np.add.reduceat(hi - lo, offsets[:-1]) if len(numbers) else np.zeros(0, np.int64)
        of = lambda c, kind: pa.array([table[c][0].as_py()] * len(numbers), kind)
        lists = pa.ListArray.from_arrays(pa.array(offsets if len(numbers) else [0], pa.int32()), spans)
        return pa.table([of("source", pa.string()), of("grp", pa.int64()), pa.array(numbers), pa.array(size), lists], names=["source", "grp", "block", "n_tokens", "spans"])

    return run


def packed(sizes: DataFrame, block_tokens: int = 1024, group_docs: int = GROUP_DOCS) -> DataFrame:
    """The blocks of each source, numbered from 0: spans of documents that fill block_tokens tokens.

    A source is one row of tokens, cut at every block_tokens-th; only its last block may be shorter, and every token
    of every document lies in exactly one block. It is packed in groups of about group_docs documents, so no task
    holds a whole source: where each group begins follows from the groups' sums, and the blocks that lie across
    groups, one or two a group, are put together afterwards.
    """
    groups = max(1, math.ceil(sizes.count() / group_docs))
    rows = sizes.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)))
    before = Window.partitionBy("source").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "grp").agg(F.sum("n_tokens").alias("n")).select("source", "grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    blocks = written(rows.join(sums, ["source", "grp"]).groupBy("source", "grp").applyInArrow(_pack(block_tokens), BLOCK), "mix-blocks")
    pieces = F.array_sort(F.collect_list(F.struct("grp", "spans")))
    across = blocks.where(F.col("n_tokens") < block_tokens).groupBy("source", "block").agg(F.sum("n_tokens").alias("n_tokens"), F.flatten(F.transform(pieces, lambda x: x["spans"])).alias("spans"))
    return blocks.where(F.col("n_tokens") == block_tokens).drop("grp").unionByName(across)


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """Images of indices under a pseudorandom permutation of 0..n-1: a Feistel network, walked until inside."""
    if n <= 1:
        return np.zeros_like(index)
    half = (max(2, int(n - 1).bit_length()) + 1) // 2
    mask = np.uint64((1 << half) - 1)
    x = index.astype(np.uint64)
    todo = np.arange(len(x))
    while len(todo):
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for r in range(4):
            f = (right + np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD1B54A32D192ED03) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            f = (f ^ (f >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ (f >> np.uint64(32)) & mask
        x[todo] = left << np.uint64(half) | right
        todo = todo[x[todo] >= n]
    return x.astype(np.int64)


def draw(weights: list[float], blocks: list[int], repeats: list[int], shard_slots: int, seed: int) -> np.ndarray:
    """Blocks of each source in each shard (shards x sources): multinomial draws, within every source's capacity.

    The total is the largest at which no source needs more than its blocks times repeats, less a margin for the
    spread of the draws; should a draw pass a capacity all the same, the total shrinks and all is drawn again, down
    to nothing at all if a source has no room. ValueError should that not end.
    """
    w = np.array(weights, dtype=float)
    room = np.array(blocks, dtype=float) * np.array(repeats)
    p = w / w.sum()
    total = int(np.min(room[p > 0] / p[p > 0]))
    while total > 0 and np.any(total * p + 3 * np.sqrt(total * p * (1 - p)) > room) and total > 50:
        total = int(total * 0.99)
    for attempt in range(10_000):
        shards = max(1, math.ceil(total / shard_slots))
        sizes = np.full(shards, total // shards) + (np.arange(shards) < total % shards)
        counts = np.array([np.random.default_rng([seed, attempt, s]).multinomial(n, p) for s, n in enumerate(sizes)]).reshape(shards, len(p))
        if np.all(counts.sum(axis=0) <= room):
            return counts
        total = min(total - 1, int(total * 0.99))
    raise ValueError(f"no draw keeps within the sources: weights {weights}, blocks {blocks}, repeats {repeats}")


def mixture(blocks: DataFrame, targets: DataFrame, shard_slots: int = 50_000, seed: int = 42) -> DataFrame:
    """shard, slot, source, block, pass, n_tokens, spans: the blocks of the mixture, in shards of random order.

    targets: source, weight (relative), max_repeat (null: 1); sources without blocks, or with a weight that is
    null or not above 0, take no part and the others keep their proportions. The counts of the shards, one row
    for each shard and source, are drawn on the driver; slots are made and permuted by the workers.
    """
    spark = blocks.sparkSession
    key = F.lower(trimmed("source"))
    want = targets.where("source is not null").groupBy(key.alias("source")).agg(F.sum("weight").alias("weight"), F.min(F.coalesce("max_repeat", F.lit(1))).alias("max_repeat"))
    have = blocks.groupBy("source").agg(F.count("*").alias("n"))
    rows = sorted(((r.source, r.weight, r.max_repeat, r.n) for r in want.join(have, "source").collect() if r.weight and r.weight > 0 and r.max_repeat > 0), key=lambda r: r[0])
    schema = "shard bigint, slot bigint, source string, block bigint, pass int"
    if not rows:
        slots = spark.createDataFrame([], schema)
    else:
        counts = draw([r[1] for r in rows], [r[3] for r in rows], [r[2] for r in rows], shard_slots, seed)
        firsts = np.cumsum(counts, axis=0) - counts
        shard, j = np.nonzero(counts)
        plan = pa.table({"shard": shard, "j": j.astype(np.int32), "first": firsts[shard, j], "n": counts[shard, j]})
        names, sizes = [r[0] for r in rows], [r[3] for r in rows]

        def run(batches):
            for b in batches:
                for shard, j, first, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    k = np.arange(first, first + n)
                    passes = k // sizes[j]
                    block = np.concatenate([permuted(k[passes == q] % sizes[j], sizes[j], seed * 1_000_003 + j * 1009 + int(q)) for q in np.unique(passes)])
                    place = np.random.default_rng([seed, shard, j]).integers(0, 2**62, n)
                    yield pa.RecordBatch.from_arrays([pa.array([shard] * n, pa.int64()), pa.array(place), pa.array([names[j]] * n, pa.string()), pa.array(block), pa.array(passes.astype(np.int32))], names=["shard", "slot", "source", "block", "pass"])

        slots = spark.createDataFrame(plan).repartition("shard", "j").mapInArrow(run, schema)
    w = Window.partitionBy("shard").orderBy("slot", "source", "block", "pass")
    # slots are made by a function, so Spark takes them for as small as the draws: never broadcast them
    held = slots.hint("shuffle_merge").join(blocks, ["source", "block"])
    return held.withColumn("slot", F.row_number().over(w).cast("bigint") - 1).select("shard", "slot", "source", "block", "pass", "n_tokens", "spans")


def shares(mixed: DataFrame, blocks: DataFrame, targets: DataFrame) -> DataFrame:
    """One row for each target: what was asked, what there was, and what the mixture holds, in tokens."""
    key = F.lower(trimmed("source"))
    want = targets.where("source is not null").groupBy(key.alias("source")).agg(F.sum("weight").alias("weight"), F.min(F.coalesce("max_repeat", F.lit(1))).alias("max_repeat"))
    total = Window.partitionBy(F.lit(1))  # a row for each source
    got = mixed.groupBy("source", "block").agg(F.count("*").alias("uses"), F.sum("n_tokens").alias("t")).groupBy("source").agg(F.sum("t").alias("tokens"), F.sum("uses").alias("slots"), F.max("uses").alias("most_uses"))
    have = blocks.groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    out = want.join(have, "source", "left").join(got, "source", "left").fillna(0, ["available_tokens", "tokens", "slots", "most_uses"])
    return out.select(
        "source", (F.col("weight") / F.sum("weight").over(total)).alias("target_share"), (F.col("tokens") / F.sum("tokens").over(total)).alias("actual_share"),
        "tokens", "available_tokens", "slots", F.col("max_repeat").cast("bigint").alias("max_repeat"), "most_uses",
    )


def materialized(mixed: DataFrame, documents: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """shard, slot, source, tokens: the mixture's blocks as token ids, cut from the documents' texts again."""
    ranks_path = ranks_path or ranks_of(mixed.sparkSession)
    spans = mixed.select("shard", "slot", "source", F.posexplode("spans").alias("k", "span")).select("shard", "slot", "source", "k", "span.doc_id", "span.first", "span.n")
    pieces = spans.join(documents.select("doc_id", "text"), "doc_id")

    def run(batches):
        tok = Tokenizer(ranks_path)
        for b in batches:
            ids = [tok.encoding.encode_ordinary(t)[f : f + n] for t, f, n in zip(b.column("text").to_pylist(), b.column("first").to_pylist(), b.column("n").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("slot"), b.column("source"), b.column("k"), pa.array(ids, pa.list_(pa.int32()))], names=["shard", "slot", "source", "k", "ids"])

    cut = pieces.mapInArrow(run, "shard bigint, slot bigint, source string, k int, ids array<int>")
    return cut.groupBy("shard", "slot", "source").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("k", "ids"))), lambda x: x["ids"])).alias("tokens"))
