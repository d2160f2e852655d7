"""Text to typed tokens, as expressions: maximal runs of Russian letters, Latin letters or digits, else single characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphlake.schema import ALL_TOKENS, TokenType

RUNS = {TokenType.RUWORD: "[А-Яа-яЁё]+", TokenType.ENWORD: "[A-Za-z]+", TokenType.NUMBER: "[0-9]+"}
ANY = "(?s)([А-Яа-яЁё]+|[A-Za-z]+|[0-9]+|.)"
#: Punctuation: ASCII, the middle dot, angle quotes, the number sign, dashes and quotes, dots.
PUNCTUATION = "[!-/:-@\\[-`{-~·«»№‐-‟․-‧]"


def valid_text(content: Column) -> Column:
    """Bytes as text; each malformed sequence of UTF-8 becomes U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def tokens(text: Column | str, mask: int = ALL_TOKENS) -> Column:
    """The tokens of a text as strings, in order; null for null. Joined, all tokens give the text back.

    Where the mask asks for kinds of run only, the pattern holds only these: no single character is made.
    """
    col = F.col(text) if isinstance(text, str) else text
    if mask and not mask & ~int(sum(RUNS)):
        return F.regexp_extract_all(col, F.lit("(" + "|".join(p for t, p in RUNS.items() if mask & t) + ")"), F.lit(1))
    return F.regexp_extract_all(col, F.lit(ANY), F.lit(1))


def token_type(token: Column) -> Column:
    """Type of a token by the code point of its first character: comparisons of integers, compiled with the plan."""
    c = F.ascii(token)
    within = lambda *spans: F.lit(False) if not spans else _any([c.between(a, z) for a, z in spans])
    return (
        F.when(within((0x410, 0x44F)) | c.isin(0x401, 0x451), TokenType.RUWORD.value)
        .when(within((65, 90), (97, 122)), TokenType.ENWORD.value)
        .when(within((48, 57)), TokenType.NUMBER.value)
        .when(c.isin(0x20, 0xA0), TokenType.WRDSPC.value)
        .when(c == 10, TokenType.NWLINE.value)
        .when(within((33, 47), (58, 64), (91, 96), (123, 126), (0x2010, 0x201F), (0x2024, 0x2027)) | c.isin(0xB7, 0xAB, 0xBB, 0x2116), TokenType.PNCTTN.value)
        .otherwise(TokenType.UNKNWN.value)
    )


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for x in conditions[1:]:
        out = out | x
    return out


def exploded(df: DataFrame, text_col: str = "text", mask: int = ALL_TOKENS, least: int = 0, most: int | None = None, drop_last: bool = False) -> DataFrame:
    """df without text_col, a row for each token: pos (from 0, before any filter), text, type, size (code points).

    Kept are tokens whose type is in mask and whose size lies between least and most, if given. drop_last leaves out the
    last token of each text, as a reader does that misses what stands before the end of a file. Null and empty
    texts give no rows. Columns of df named like a new one are replaced.
    """
    words = tokens(text_col)
    if drop_last:
        words = F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0)))
    keep = [c for c in df.columns if c not in (text_col, "pos", "text", "type", "size")]
    rows = df.select(*keep, F.posexplode(words).alias("pos", "text"))
    typed = rows.withColumn("type", token_type(F.col("text"))).withColumn("size", F.char_length("text"))
    return typed.where((F.col("type").bitwiseAND(mask) != 0) & _between(F.col("size"), least, most))


def _between(size: Column, least: int, most: int | None) -> Column:
    return size >= least if most is None else size.between(least, most)


def words(df: DataFrame, text_col: str = "text", least: int = 1, most: int | None = None) -> DataFrame:
    """df without text_col, a row for each Russian word in lower case, of least to most code points: pos (number of the word in its text), word."""
    keep = [c for c in df.columns if c not in (text_col, "pos", "word")]
    rows = df.select(*keep, F.posexplode(tokens(text_col, TokenType.RUWORD)).alias("pos", "word")).withColumn("word", F.lower("word"))
    return rows.where(_between(F.char_length("word"), least, most))


def first_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """words() without those that occurred before in their text; rows of a text come in the order of words."""
    keep = [c for c in df.columns if c not in (text_col, "pos", "word")]
    places = F.array_sort(F.transform(F.transform(tokens(text_col, TokenType.RUWORD), F.lower), lambda w, i: F.struct(w.alias("word"), i.alias("pos"))))
    rows = df.select(*keep, places.alias("__w"))
    first = F.filter("__w", lambda x, i: (i == 0) | (F.get("__w", i - 1)["word"] != x["word"]))
    return rows.select(*keep, F.inline(first)).select(*keep, "pos", "word")
