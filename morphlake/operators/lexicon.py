"""Words against a lexicon, a set of seen words and a registry of validated ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from morphlake.functions.lexer import first_words
from morphlake.schema import MAX_WORD, PROMOTED


def _keys(df: DataFrame, word: str = "word") -> DataFrame:
    return df.select(F.col(word).alias("word")).where("word is not null").distinct()


def not_in(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rows of words whose word the lexicon lacks; null words are kept out. Spark broadcasts a lexicon that is
    small by its size in the plan, and merges a larger one."""
    return words.where("word is not null").join(_keys(lexicon), "word", "left_anti")


def unseen(words: DataFrame, seen: DataFrame, least: int = 1, most: int = MAX_WORD, ordered: bool = True) -> DataFrame:
    """word: the distinct words of the right length that were not seen; ordered: shortest first, then by word."""
    right = words.where(F.char_length("word").between(least, most)).select("word").distinct()
    new = right.join(_keys(seen), "word", "left_anti")
    return new.orderBy(F.char_length("word"), "word") if ordered else new


def members(words: DataFrame, *registries: DataFrame) -> DataFrame:
    """Rows of words whose word is a key of any registry."""
    keys = _keys(registries[0])
    for r in registries[1:]:
        keys = keys.unionByName(_keys(r))
    return words.join(keys, "word", "left_semi")


def lookup(words: DataFrame, validated: DataFrame, base: DataFrame) -> DataFrame:
    """words with morphemes: the validated ones if not empty, else those of the base; words with neither are left out.

    validated and base hold a word once at most (see latest).
    """
    v = validated.select("word", F.col("morphemes").alias("__v"))
    b = base.select("word", F.col("morphemes").alias("__b"))
    found = words.join(v, "word", "left").join(b, "word", "left").withColumn("morphemes", F.coalesce(F.when(F.size("__v") > 0, F.col("__v")), F.col("__b")))
    return found.where("morphemes is not null").drop("__v", "__b")


def promoted(predictions: DataFrame, threshold: float = PROMOTED) -> DataFrame:
    """Predictions whose confidence, as stored, reaches the threshold; a missing one counts as 0."""
    return predictions.where(F.coalesce("confidence", F.lit(0.0)) >= threshold)


def latest(predictions: DataFrame, order_col: str) -> DataFrame:
    """word, morphemes: the last write of each word by order_col. Aggregated with a partial step: a word that
    holds a third of all rows costs no task more than a row from each other task."""
    last = predictions.where("word is not null").groupBy("word").agg(F.max_by("morphemes", order_col).alias("morphemes"))
    return last.select("word", "morphemes")


def mark_seen(seen: DataFrame, new: DataFrame) -> DataFrame:
    """word: the union of both sets."""
    return _keys(seen).unionByName(_keys(new)).distinct()


def first_occurrences(texts: DataFrame, doc_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, doc_col, pos (number of the word in its text) of the first place of each Russian word.

    Repeats within a text are dropped in the row itself; what is left is aggregated on plain numbers, which Spark
    hashes, with a partial step: a frequent word costs no task more than a row from each other task. doc_col is a
    number, a text's own: of texts that share one, one counts.
    """
    rows = first_words(texts.select(doc_col, text_col), text_col)
    first = rows.groupBy("word").agg(F.min(doc_col).alias("__doc"), F.min_by("pos", doc_col).alias("pos"))
    return first.select("word", F.col("__doc").alias(doc_col), "pos")


def sizes(base: DataFrame, validated: DataFrame, seen: DataFrame) -> DataFrame:
    """registry: rows of both dictionaries, words of both counted twice; seen: distinct words seen."""
    n = base.select(F.lit(1).alias("r"), F.lit(0).alias("s")).unionAll(validated.select(F.lit(1), F.lit(0))).unionAll(_keys(seen).select(F.lit(0), F.lit(1)))
    return n.agg(F.coalesce(F.sum("r"), F.lit(0)).cast("bigint").alias("registry"), F.coalesce(F.sum("s"), F.lit(0)).cast("bigint").alias("seen"))
