"""The pipeline: text to words, unseen words to predictions, predictions to a log and a registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.functions.decode import exact_round, segments, tag_columns, word_confidence
from morphlake.functions.lexer import words
from morphlake.operators.lexicon import first_occurrences, latest, lookup, mark_seen, not_in, promoted, unseen
from morphlake.operators.scorers import OnnxScorer, Scorer
from morphlake.operators.shared import written
from morphlake.schema import LABELS, LEXICON, MAX_WORD, PREDICTIONS, PROMOTED
from morphlake.sinks.logs import LogWriter
from morphlake.sources.tables import Bundle, base_dict
from morphlake.sources.text import source


def predictions(new_words: DataFrame, scorer: Scorer, labels: dict[str, int] = LABELS, rounded: bool = True, repair: bool = True) -> DataFrame:
    """word, morphemes, confidence, model, repaired, validated for words (word): scored, then decoded in place.

    rounded: the confidence is rounded to 4 digits by its exact value, which is what a threshold then sees.
    """
    scored = scorer.score(new_words)
    conf = word_confidence(F.col("word"), F.transform("confs", lambda c: c.cast("double")))
    done = scored.withColumn("conf", conf).withColumn("d", segments(F.col("word"), tag_columns(F.col("tag_ids"), labels=labels), F.col("confs"), repair))
    conf = F.col("conf")
    return done.select(
        "word", F.col("d.morphemes").alias("morphemes"), (exact_round(conf) if rounded else conf).alias("confidence"),
        F.lit(scorer.name).alias("model"), F.col("d.repaired").alias("repaired"), F.lit(False).alias("validated"),
    )


class Engine:
    """Words of a source against base dictionary, log and scorer.

    scope: `log` answers from all logged predictions that reach the threshold, `session` only from those this
    engine made. Without a writer nothing is logged, and what was seen is what this engine has seen.
    """

    def __init__(self, spark: SparkSession, scorer: Scorer, base: DataFrame | None = None, writer: LogWriter | None = None, scope: str = "log", most: int = MAX_WORD, threshold: float = PROMOTED, labels: dict[str, int] = LABELS):
        if scope not in ("log", "session"):
            raise ValueError(scope)
        self.spark, self.scorer, self.writer, self.scope, self.most, self.threshold, self.labels = spark, scorer, writer, scope, most, threshold, labels
        self.base = base if base is not None else spark.createDataFrame([], LEXICON)
        self.made: list[DataFrame] = []

    @classmethod
    def from_pretrained(cls, spark: SparkSession, folder: str, output: str | None = None, dictionary: str | None = None, device: str = "auto", scorer: Scorer | None = None, **options) -> Engine:
        """The engine of a bundle; its weights must be there unless a scorer is given."""
        bundle = Bundle.load(folder, need_weights=scorer is None, spark=spark)
        scorer = scorer or OnnxScorer(bundle.weights, bundle.chars, bundle.maxlen, device, bundle.name)
        base = base_dict(spark, dictionary or bundle.base_dict) if dictionary or bundle.base_dict else None
        at = output or bundle.output
        return cls(spark, scorer, base, LogWriter(at, "jsonl_compat") if at else None, most=bundle.maxlen, labels=bundle.labels, **options)

    def _own(self, order: str) -> DataFrame:
        """What this engine made, and by order in which call."""
        rows = self.spark.createDataFrame([], f"{PREDICTIONS}, {order} bigint")
        for i, m in enumerate(self.made):
            rows = rows.unionByName(m.withColumn(order, F.lit(i).cast("bigint")))
        return rows

    def _logged(self, order: str = "__order") -> DataFrame:
        return self.writer.read(self.spark, order) if self.writer else self._own(order)

    def seen(self) -> DataFrame:
        return mark_seen(self._logged().select("word"), self.spark.createDataFrame([], "word string"))

    def validated(self) -> DataFrame:
        """word, morphemes of the predictions that reach the threshold, the one written last of each word."""
        rows = self._logged() if self.scope == "log" else self._own("__order")
        return latest(promoted(rows, self.threshold), "__order")

    def new_words(self, what) -> DataFrame:
        """word: the words of a source that neither the base dictionary nor the log has."""
        found = words(source(self.spark, what), "text", 1, self.most)
        return unseen(not_in(found.select("word"), self.base), self.seen(), 1, self.most, ordered=False)  # scorers sort out lengths themselves

    def process(self, what) -> DataFrame:
        """Score the new words of a source once each, append them to the log; returns what was appended."""
        rows = predictions(self.new_words(what), self.scorer, self.labels)
        rows = self.writer.write(rows) if self.writer else written(rows, "predictions")  # written once either way
        self.made.append(rows)
        return rows

    def predict(self, what) -> DataFrame:
        """word, morphemes, doc_id, pos for each Russian word of a source, where it occurs first.

        New words are scored and logged; words whose confidence stays below the threshold are left out. A blank
        literal text is a ValueError, what is no text a TypeError; blank rows of a DataFrame give no words.
        """
        docs = source(self.spark, what)
        self.process(docs)
        return lookup(first_occurrences(docs), self.validated(), self.base).select("word", "morphemes", "doc_id", "pos")

    def predict_dict(self, text: str) -> dict[str, list[tuple[str, int, float]]]:
        """predict for one text, as a dict in the order of first occurrence."""
        rows = self.predict(text).orderBy("doc_id", "pos").collect()
        return {r.word: [tuple(m) for m in r.morphemes] for r in rows}
