"""Types, vocabularies and table schemas."""

from __future__ import annotations

from enum import IntEnum, IntFlag

from pyspark.sql import types as T


# Token types, morpheme types, labels, characters and limits that stored models and logs rely on.


class TokenType(IntFlag):
    """Kinds of token; a filter is any combination of them."""

    NOTTKN = 0
    WRDSPC = 1
    NWLINE = 2
    ENWORD = 4
    NUMBER = 8
    RUWORD = 16
    PNCTTN = 32
    UNKNWN = 64


ALL_TOKENS = 127


class MorphemeType(IntEnum):
    PAD = 0
    UNK = 1
    PREF = 2
    ROOT = 3
    SUFF = 4
    END = 5
    POSTFIX = 6
    LINK = 7
    HYPH = 8


PAD, UNK = "<PAD>", "<UNK>"
MORPHEME_TYPES = {m.name: m.value for m in MorphemeType} | {PAD: 0, UNK: 1}
MORPHEME_NAMES = {v: k for k, v in MORPHEME_TYPES.items()}

#: Labels: padding, unknown, then B, I, E, S of each kind of morpheme; a hyphen is always single.
LABELS = {
    PAD: 0, UNK: 1,
    "B-PREF": 2, "I-PREF": 3, "E-PREF": 4, "S-PREF": 5,
    "B-ROOT": 6, "I-ROOT": 7, "E-ROOT": 8, "S-ROOT": 9,
    "B-SUFF": 10, "I-SUFF": 11, "E-SUFF": 12, "S-SUFF": 13,
    "B-END": 14, "I-END": 15, "E-END": 16, "S-END": 17,
    "B-POSTFIX": 18, "I-POSTFIX": 19, "E-POSTFIX": 20, "S-POSTFIX": 21,
    "B-LINK": 22, "I-LINK": 23, "E-LINK": 24, "S-LINK": 25,
    "S-HYPH": 26,
}
#: Characters: four names, the alphabet with ё after е, digits, blank and hyphen.
CHARS = {c: i for i, c in enumerate([PAD, UNK, "EOW", "MASK", *"абвгдеёжзийклмнопрстуфхцчшщъыьэюя", *"0123456789", " ", "-"])}

MAX_WORD, PROMOTED, MODEL_BATCH, TOKEN_BATCH = 64, 0.85, 2048, 65_536

MORPHEMES = "array<struct<text:string,type_id:int,confidence:double>>"
TOKENS = "pos int, text string, type int, size int"
LEXICON = f"word string, morphemes {MORPHEMES}"
SCORED = "word string, tag_ids array<int>, confs array<float>"
PREDICTIONS = f"word string, morphemes {MORPHEMES}, confidence double, model string, repaired boolean, validated boolean"


def struct_of(ddl: str) -> T.StructType:
    """The StructType of a schema in DDL."""
    return T.StructType.fromDDL(ddl)
