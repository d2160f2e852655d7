"""Words to character ids and back; scores to labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from morphlake.schema import CHARS, LABELS, MORPHEME_TYPES, PAD, UNK


def literal_map(values: Mapping) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def chars(word: Column | str) -> Column:
    """Code points of a word as an array; null for null, empty for empty."""
    return F.regexp_extract_all(F.col(word) if isinstance(word, str) else word, F.lit("(?s)(.)"), F.lit(1))


def ints(values: list[int]) -> Column:
    """A constant array, folded once when the plan is optimized."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def char_id(c: Column, vocab: Mapping[str, int]) -> Column:
    """Id of one character: looked up by code point in a constant array where the vocabulary's code points lie
    close together, else in a map."""
    codes = {ord(k): i for k, i in vocab.items() if len(k) == 1}
    unk = vocab.get(UNK, 1)
    if codes and max(codes) - min(codes) < 4096:
        low = min(codes)
        table = ints([codes.get(k, unk) for k in range(low, max(codes) + 1)])
        return F.coalesce(F.get(table, F.ascii(c) - low), F.lit(unk))
    return F.coalesce(F.try_element_at(literal_map(vocab), c), F.lit(unk))


def encoded(word: Column | str, vocab: Mapping[str, int] = CHARS, lower: bool = False, most: int | None = None) -> Column:
    """Ids of the characters of a word; unknown ones get the id of <UNK>. most cuts longer words."""
    col = F.col(word) if isinstance(word, str) else word
    ids = F.transform(chars(F.lower(col) if lower else col), lambda c: char_id(c, vocab))
    return F.slice(ids, 1, most) if most else ids


def padded(ids: Column, width: int | Column, pad: int = 0) -> Column:
    """ids cut or filled with pad to width."""
    width = F.lit(width) if isinstance(width, int) else width
    return F.slice(F.concat(ids, F.array_repeat(F.lit(pad), width)), F.lit(1), width)


def decoded(ids: Column, vocab: Mapping[str, int] = CHARS) -> Column:
    """The word of character ids: padding dropped, ids outside the vocabulary give nothing."""
    table = literal_map({v: k for k, v in vocab.items()})
    return F.array_join(F.transform(F.filter(ids, lambda i: i != vocab.get(PAD, 0)), lambda i: F.coalesce(F.try_element_at(table, i), F.lit(""))), "")


def best(scores: Column) -> tuple[Column, Column]:
    """Class of the highest score of each position, the first of equals, and that score."""
    return F.transform(scores, lambda s: (F.array_position(s, F.array_max(s)) - 1).cast("int")), F.transform(scores, lambda s: F.array_max(s))


def label_parts(labels: Mapping[str, int] = LABELS, types: Mapping[str, int] = MORPHEME_TYPES) -> dict[int, tuple[str, int]]:
    """Label id -> (B, I, E, S or <, id of the morpheme type); the first is < for padding and unknown."""
    return {i: (name[:1], types.get(name[2:], 0)) for name, i in labels.items()}
