"""Evaluation texts leaking into training text: documents that hold passages of held-out items.

Pigeonhole: of a passage of min_words words that is allowed `errors` wrong ones, cut into pieces short enough, more
than `errors` lie in it whole wherever it begins, so at least one is met exactly. The items' pieces are a table;
documents are read once, and of their words only the surroundings of what may be a piece, by a bit filter of bounded
size, go on. These meet the pieces in a join by hash, and every hit is verified with Myers' bit-parallel edit
distance between the passages of the item that cover the piece and the words around it in the document.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphlake.llm.mail import text_parts, unquoted
from morphlake.operators.shared import written

_WORD = re.compile(r"[^\W_]+")
#: Bits of the filter: 16 for each piece, between these powers of two; 64 MB at most, whatever the number of items.
LEAST_BITS, MOST_BITS = 15, 29
#: Bits in one bitmap of Spark's bitmap functions.
_BITMAP = 32_768
_FOUND = "doc_id bigint, item_id bigint, distance int"


def words(text: str) -> list[str]:
    """Runs of letters or digits in lower case; soft hyphens and zero-width characters don't part words."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", re.sub("[­​-‍⁠﻿]", "", text))
    return _WORD.findall(text.lower())


def piece_words(min_words: int, errors: int) -> int:
    """Length at which any min_words words hold errors + 1 whole pieces of an item cut from its start."""
    size = (min_words + 1) // (errors + 2)
    if size < 1:
        raise ValueError(f"a passage of {min_words} words can't be split for {errors} errors")
    return size


def myers(pattern: list[str], text: list[str], most: int) -> int:
    """Least edit distance (in words) of pattern to any stretch of text, bit-parallel; most + 1 if it is above most."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full  # a stretch may begin anywhere
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        best = min(best, score)
        if best == 0:
            break
    return min(best, most + 1)


def nearest(passages: list[str], found: list[str], min_words: int, most: int) -> int:
    """Least distance of any min_words words of passages to a stretch of found; most + 1 if all are farther."""
    near = set(found)
    there = [w in near for w in passages]
    best = most + 1
    for a in range(len(passages) - min_words + 1):
        if sum(there[a : a + min_words]) > min_words - best:  # else too many of its words aren't even near
            best = min(best, myers(passages[a : a + min_words], found, best - 1))
    return best


class _Known(dict):
    """Word -> 64-bit hash, made when it is first asked for."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


class Hashes:
    """64-bit hashes of all runs of `size` words."""

    def __init__(self, size: int):
        self.size, self.known = size, _Known()

    def __call__(self, own: list[str]) -> np.ndarray:
        one = np.fromiter(map(self.known.__getitem__, own), np.uint64, len(own))
        n = len(own) - self.size + 1
        x = np.zeros(max(n, 0), np.uint64)
        for k in range(self.size if n > 0 else 0):
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + one[k : k + n]
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(31))


def _rows(hashes: list[int], ids: list[int], around: list[list[str]], name: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.array(hashes, dtype=np.uint64).view(np.int64)), pa.array(ids, pa.int64()), pa.array(around, pa.list_(pa.string()))], names=["hash", name, f"{name}_words"])


def pieces(items: DataFrame, min_words: int, errors: int) -> DataFrame:
    """hash, item_id, item_id_words of items (item_id, text): each piece, with the words of all passages that cover it."""
    size = piece_words(min_words, errors)

    def run(batches):
        hashes = Hashes(size)
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = words(text)
                if len(own) >= min_words:
                    h = hashes(own)
                    for p in range(0, len(h), size):
                        out[0].append(h[p])
                        out[1].append(i)
                        out[2].append(own[max(0, p + size - min_words) : p + min_words])
            yield _rows(*out, "item_id")

    return items.mapInArrow(run, "hash bigint, item_id bigint, item_id_words array<string>")


def _places(h, k: int):
    """The two bits of a hash in a filter of 2**k bits."""
    mask = np.uint64((1 << k) - 1)
    return h & mask, (h >> np.uint64(64 - k)) & mask


def bit_filter(held: DataFrame, k: int) -> np.ndarray:
    """2**k bits, as bytes, in which those of all hashes of held (hash) are set; put together by Spark."""
    low = F.col("hash").bitwiseAND(F.lit((1 << k) - 1))
    bits = held.select(F.explode(F.array(low, F.shiftrightunsigned("hash", 64 - k))).alias("bit"))
    maps = bits.groupBy(F.expr(f"bit div {_BITMAP}").alias("n")).agg(F.expr(f"bitmap_construct_agg(bit % {_BITMAP})").alias("bits")).collect()
    out = np.zeros(max((1 << k) // 8, _BITMAP // 8), np.uint8)
    for r in maps:
        out[r.n * (_BITMAP // 8) : (r.n + 1) * (_BITMAP // 8)] = np.frombuffer(r.bits, np.uint8)
    return out


def hits(documents: DataFrame, bits: np.ndarray, k: int, min_words: int, errors: int) -> DataFrame:
    """hash, doc_id, doc_id_words of documents (doc_id, text): what may be a piece, with the words around it."""
    size = piece_words(min_words, errors)
    shipped = documents.sparkSession.sparkContext.broadcast(bits)  # at most 2**MOST_BITS bits

    def run(batches):
        held, hashes = shipped.value, Hashes(size)
        is_set = lambda at: held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for part in text_parts(text):
                    own = words(unquoted(part))
                    if len(own) < min_words - errors:
                        continue
                    h = hashes(own)
                    one, other = _places(h, k)
                    for p in np.flatnonzero(is_set(one) & is_set(other)).tolist():
                        out[0].append(h[p])
                        out[1].append(i)
                        out[2].append(own[max(0, p + size - min_words - errors) : p + min_words + errors])
                if len(out[0]) > 20_000:
                    yield _rows(*out, "doc_id")
                    out = ([], [], [])
            yield _rows(*out, "doc_id")

    return documents.mapInArrow(run, "hash bigint, doc_id bigint, doc_id_words array<string>")


def leaks(documents: DataFrame, items: DataFrame, min_words: int = 12, errors: int = 1, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, distance: documents that hold min_words consecutive words of an item, up to `errors` wrong,
    missing or added words; distance is the least number of these, 0 for an exact passage.

    Documents are mail messages; what counts is what their reader sees (see mail). They are read once, row by row,
    for any number of items; only the surroundings of hits are shuffled. Null texts, empty tables and items shorter
    than min_words give no rows; a repeated document or item gives its rows once.
    """
    spark = documents.sparkSession
    one = lambda df, c, name: df.where(F.col(text_col).isNotNull()).select(F.col(c).cast("bigint").alias(name), F.col(text_col).cast("string").alias("text"))
    held = written(pieces(one(items, item_col, "item_id"), min_words, errors), "leak-pieces")
    n = held.count()
    if not n:
        return spark.createDataFrame([], _FOUND)
    k = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    met = hits(one(documents, doc_col, "doc_id"), bit_filter(held, k), k, min_words, errors).join(held, "hash")

    def verify(batches):
        for b in batches:
            d = [nearest(p, t, min_words, errors) for p, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            keep = np.flatnonzero(np.array(d, dtype=np.int32) <= errors)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), b.column(1).take(pa.array(keep)), pa.array(np.array(d, dtype=np.int32)[keep])], names=["doc_id", "item_id", "distance"])

    found = met.select("doc_id", "item_id", "item_id_words", "doc_id_words").mapInArrow(verify, _FOUND)
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))
