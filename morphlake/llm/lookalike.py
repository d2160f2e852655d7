"""Texts that look the same but differ in characters: one consistent form, and the rows that share it.

A text's skeleton: decompose, replace every character by its prototype, decompose again. Characters that
do not show are dropped, blanks of any kind become U+0020, full-width forms and letters of another font become
ordinary ones, look-alike letters of other scripts become the Russian or Latin letter they look like. Which letters
look alike is taken from Unicode's table of confusables, which Spark brings along in its ICU library; what the
letters of the two alphabets stand for among each other is stated here, as that table also likens letters that a
reader tells apart (З and 3, l and I, r and г). The skeleton is returned composed (NFC), which keeps equal what is
equal and makes it readable. Letter case, digits, signs, tabs, line breaks, the number of blanks, and ё/е, й/и
stay apart.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.operators.shared import written

# Letters of other scripts and the Cyrillic letter (or, last lines, the Latin one) they look like.
LATIN = "aceopxyijsABCEHIJKMOPSTXY"
LATIN_AS = "асеорхуіјѕАВСЕНІЈКМОРЅТХУ"
GREEK = "αορκγιϲΑΒΕΗΙΚΜΟΡΤΥΧϹ"
GREEK_AS = "аоркуісАВЕНІКМОРТУХС"
OTHER = "ɑᴏһԁԛԝɡΝΖϳ"
OTHER_AS = "аоhdqwgNZј"


#: Letters that stand for themselves or for what is stated above.
OWN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(map(chr, range(0x410, 0x450))) + "ёЁ" + LATIN_AS + OTHER_AS)
#: Code points among which there are letters of another font or width, and the Latin ligatures.
VARIANTS = (range(0x2100, 0x2150), range(0xFB00, 0xFB07), range(0xFF01, 0xFFF0), range(0x1D400, 0x1D800))


def prototypes() -> dict[int, str | None]:
    """Code point -> what stands for it in a skeleton, as far as Unicode's names and classes say; None drops it."""
    table: dict[int, str | None] = {}
    for letters, prototype in ((LATIN, LATIN_AS), (GREEK, GREEK_AS), (OTHER, OTHER_AS)):
        table |= dict(zip(map(ord, letters), prototype, strict=True))
    for cp in (cp for span in VARIANTS for cp in span):
        if unicodedata.decomposition(chr(cp)).startswith(("<font>", "<wide>", "<narrow>")) or 0xFB00 <= cp < 0xFB07:
            table[cp] = "".join(table.get(ord(c)) or c for c in unicodedata.normalize("NFD", unicodedata.normalize("NFKC", chr(cp))))
    for cp in range(0x3001):  # blanks and characters that do not show, by their Unicode category
        kind = unicodedata.category(chr(cp))
        if kind == "Zs":
            table[cp] = " "
        elif kind == "Cf" and not 0x600 <= cp <= 0x605:
            table[cp] = None
    for cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0xFEFF, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0000, 0xE01F0)):
        table[cp] = None
    return table


def confusables(spark: SparkSession, table: dict[int, str | None]) -> dict[int, str]:
    """Code point -> prototype for the letters of other scripts that Unicode's table likens to one single own letter.

    Of several own letters the one of the same case counts, then the one that is the table's own prototype.
    """
    letters = [chr(cp) for cp in range(0x80, 0x20000) if unicodedata.category(chr(cp)) in ("Lu", "Ll", "Lt", "Lm", "Lo", "Nl")]
    own = sorted(OWN)
    likened = spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join([*own, *letters])).split("\n")
    by: dict[str, list[str]] = {}
    for c, s in zip(own, likened):
        by.setdefault(s, []).append(c)
    out = {}
    for c, s in zip(letters, likened[len(own) :], strict=True):
        if c not in OWN and ord(c) not in table and len(s) == 1 and s in by and unicodedata.normalize("NFD", c) == c:
            cased = [x for x in by[s] if x.isupper() == c.isupper()] or by[s]
            best = min(cased, key=lambda x: (x != s, x))
            out[ord(c)] = table.get(ord(best)) or best
    return out


#: Texts of these characters alone are their own skeleton.
PLAIN = re.compile(r"[А-Яа-яЁё0-9 .,!?:;…«»„“”\"'()\[\]—–№\n\t-]*")


class Skeleton:
    """Text -> the one form of all texts that look like it."""

    def __init__(self, more: dict[int, str] | None = None):
        self.table = prototypes()
        self.table |= more or {}

    def __call__(self, text: str) -> str:
        if PLAIN.fullmatch(text):
            return text
        once = unicodedata.normalize("NFD", text).translate(self.table)
        return unicodedata.normalize("NFC", unicodedata.normalize("NFD", once).translate(self.table))


skeleton = Skeleton()
_BY_APP: dict[str, Skeleton] = {}


def skeleton_of(spark: SparkSession) -> Skeleton:
    """The skeleton with the confusables of the session's ICU library; a few thousand letters, made once."""
    app = spark.sparkContext.applicationId
    if app not in _BY_APP:
        _BY_APP[app] = Skeleton(confusables(spark, skeleton.table))
    return _BY_APP[app]


_LETTER = re.compile(r"[^\W_]")


def with_skeleton(df: DataFrame, text_col: str = "text", out_col: str = "skeleton") -> DataFrame:
    """df with the skeleton of text_col as out_col (a column of that name is replaced); null stays null."""
    form = skeleton_of(df.sparkSession)

    @F.pandas_udf("string")
    def make(s):
        return s.map(lambda t: None if t is None else form(t))

    return df.withColumn(out_col, make(F.col(text_col)))


def hashed(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """row_id, skeleton, exact: 128-bit hashes of skeleton and text; rows without a letter or digit stay out."""
    source = df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).cast("string").alias("text"))
    form = skeleton_of(df.sparkSession)

    def run(batches):
        for b in batches:
            ids, hashes, exact = [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text is None:
                    continue
                s = form(text)
                if _LETTER.search(s):
                    ids.append(i)
                    hashes.append(xxhash.xxh3_128_digest(s))
                    exact.append(xxhash.xxh3_128_digest(text))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.binary()), pa.array(exact, pa.binary())], names=["row_id", "skeleton", "exact"])

    return source.mapInArrow(run, "row_id bigint, skeleton binary, exact binary")


def _variants(rows: DataFrame) -> DataFrame:
    """skeleton, exact, variant of the texts that are not alone in their class; variant: the text's least row_id."""
    texts = rows.groupBy("skeleton", "exact").agg(F.min("row_id").alias("variant"))
    mixed = texts.groupBy("skeleton").agg(F.count("*").alias("n"), F.min("variant").alias("class_id")).where("n > 1").drop("n")
    return texts.join(mixed, "skeleton")


def look_alike_classes(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """row_id, class_id, variant: the rows whose text looks like another's that has other characters.

    One row for each row of df: class_id is the least row_id of all texts that look alike, variant that of the rows
    with exactly this text. Rows of which class_id and variant differ are what would be pairs of representatives, so
    a class of any size costs as many rows as it has. A row that is repeated comes once.
    """
    rows = written(hashed(df, id_col, text_col), "skeletons")
    variants = _variants(rows).select("exact", "class_id", "variant")
    return rows.join(variants, "exact").select("row_id", "class_id", "variant").distinct()


def look_alikes(df: DataFrame, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """row_a < row_b: all pairs of rows whose texts differ in characters but have one skeleton.

    Rows are first counted by skeleton and text: a group of exact copies, however large, is one entry there.
    Pairs are made between different texts of one skeleton, and only then joined to the rows that have them, so
    the work is that of listing the result; copies of one text are never held against each other. Where all pairs
    would be too many, look_alike_classes says the same in a row for each text. Null texts and texts without letter
    or digit give no rows; a row that is repeated gives each of its pairs once.
    """
    rows = written(hashed(df, id_col, text_col), "skeletons")
    kinds = _variants(rows).select("skeleton", "exact")
    held = written(rows.join(kinds, ["skeleton", "exact"], "left_semi").distinct(), "look-alikes")
    kinds = held.select("skeleton", "exact").distinct()
    pairs = kinds.alias("x").join(kinds.alias("y"), "skeleton").where("x.exact < y.exact").select(F.col("x.exact").alias("exact_x"), F.col("y.exact").alias("exact_y"))
    x = held.select(F.col("exact").alias("exact_x"), F.col("row_id").alias("row_x"))
    y = held.select(F.col("exact").alias("exact_y"), F.col("row_id").alias("row_y"))
    both = pairs.join(x, "exact_x").join(y, "exact_y")
    return both.select(F.least("row_x", "row_y").alias("row_a"), F.greatest("row_x", "row_y").alias("row_b"))
