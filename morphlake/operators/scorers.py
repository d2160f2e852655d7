"""Scorers: from words to a label id and a confidence for each character. Logits never leave the scorer."""

from __future__ import annotations

import atexit
import hashlib
import os
import shutil
import tempfile
from collections.abc import Mapping
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from morphlake.functions.encode import chars, encoded, literal_map
from morphlake.operators.shared import folder_of
from morphlake.schema import CHARS, LABELS, MODEL_BATCH, MORPHEME_NAMES, SCORED


class Scorer(Protocol):
    name: str

    def score(self, words: DataFrame) -> DataFrame:
        """word, tag_ids, confs for each row of words (word)."""


class ArithmeticScorer:
    """A stand-in without meaning, made of integer arithmetic on character ids, so that SQL can say the same."""

    name = "arithmetic"

    def score(self, words: DataFrame) -> DataFrame:
        n, ids = F.char_length("word"), encoded("word")
        tags = F.transform(ids, lambda c, i: ((c * 7 + i * 3 + n) % 27).cast("int"))
        confs = F.transform(ids, lambda c, i: (((c * 5 + i * 11 + n) % 65) / 64.0).cast("float"))
        return words.select("word", tags.alias("tag_ids"), confs.alias("confs"))


class LexiconScorer:
    """Labels read off a lexicon's morphemes; a word it lacks, or whose morphemes don't spell it, is one root."""

    name = "lexicon"

    def __init__(self, lexicon: DataFrame, confidence: float = 0.9, other: float = 0.5, labels: Mapping[str, int] = LABELS):
        self.lexicon, self.confidence, self.other, self.labels = lexicon, confidence, other, labels

    def score(self, words: DataFrame) -> DataFrame:
        table, names = literal_map(self.labels), literal_map(MORPHEME_NAMES)

        def of(text, kind):
            n = F.char_length(text)
            label = lambda i: F.concat(F.when(n == 1, "S-").when(i == 0, "B-").when(i == n - 1, "E-").otherwise("I-"), kind)
            return F.transform(chars(text), lambda c, i: F.coalesce(F.try_element_at(table, label(i)), F.try_element_at(table, F.lit("S-ROOT"))))

        known = self.lexicon.select("word", F.col("morphemes").alias("__m")).where(F.array_join(F.transform("__m", lambda m: m["text"]), "") == F.col("word"))
        held = words.join(known.dropDuplicates(["word"]), "word", "left")
        whole = of(F.col("word"), F.lit("ROOT"))
        tags = F.when(F.col("__m").isNotNull(), F.flatten(F.transform("__m", lambda m: of(m["text"], F.try_element_at(names, m["type_id"]))))).otherwise(whole)
        conf = F.when(F.col("__m").isNotNull(), F.lit(self.confidence)).otherwise(F.lit(self.other))
        return held.select("word", tags.cast("array<int>").alias("tag_ids"), F.array_repeat(conf.cast("float"), F.char_length("word")).alias("confs"))


class TableScorer:
    """Fixed labels of given words, for tests and replays; other words get one root of confidence `other`."""

    name = "table"

    def __init__(self, scored: DataFrame, other: float = 0.9):
        self.scored, self.other = scored, other

    def score(self, words: DataFrame) -> DataFrame:
        known = self.scored.select("word", "tag_ids", "confs")
        n = F.char_length("word")
        root = F.transform(chars("word"), lambda c, i: F.when(n == 1, LABELS["S-ROOT"]).when(i == 0, LABELS["B-ROOT"]).when(i == n - 1, LABELS["E-ROOT"]).otherwise(LABELS["I-ROOT"]))
        held = words.join(known, "word", "left")
        return held.select("word", F.coalesce("tag_ids", root).alias("tag_ids"), F.coalesce("confs", F.array_repeat(F.lit(self.other).cast("float"), n)).cast("array<float>").alias("confs"))


def table_network(path: str, scores: list[list[float]]) -> str:
    """Write an ONNX network that looks each character's scores up by its id; returns the local path.

    The smallest network with the shape of a tagger, ids (words x characters) to scores (words x characters x labels):
    for tests and as a baseline. Messages are laid out by ONNX's public protobuf schema, whose field numbers are below.
    """
    import struct

    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def number(tag: int, n: int) -> bytes:
        return varint(tag << 3) + varint(n)

    def field(tag: int, data: bytes | str) -> bytes:
        raw = data.encode() if isinstance(data, str) else data
        return varint(tag << 3 | 2) + varint(len(raw)) + raw

    floats, ints = 1, 6  # element types
    size, labels = len(scores), len(scores[0])
    table = number(1, size) + number(1, labels) + number(2, floats) + field(8, "scores") + field(9, struct.pack(f"<{size * labels}f", *[x for row in scores for x in row]))
    node = field(1, "scores") + field(1, "ids") + field(2, "logits") + field(3, "look-up") + field(4, "Gather")
    named = lambda dims: b"".join(field(1, number(1, d) if isinstance(d, int) else field(2, d)) for d in dims)
    value = lambda name, kind, dims: field(1, name) + field(2, field(1, number(1, kind) + field(2, named(dims))))
    graph = field(1, node) + field(2, "table") + field(5, table) + field(11, value("ids", ints, ["words", "chars"])) + field(12, value("logits", floats, ["words", "chars", labels]))
    with open(path, "wb") as out:
        out.write(number(1, 8) + field(7, graph) + field(8, field(1, "") + number(2, 13)))  # IR version, graph, operator set
    return path


_SESSIONS: dict = {}
_SHIPPED: set[tuple[str, str]] = set()


class OnnxScorer:
    """A network in ONNX form, one session for each Python worker. Words are padded by length class (multiples of
    8 up to maxlen), so a word's scores don't depend on the words it comes with. Words longer than maxlen are cut."""

    def __init__(self, weights: str, chars: Mapping[str, int] = CHARS, maxlen: int = 64, device: str = "auto", name: str = "onnx", batch: int = MODEL_BATCH):
        self.weights, self.chars, self.maxlen, self.device, self.name, self.batch = weights, dict(chars), maxlen, device, name, batch

    @staticmethod
    def providers(device: str, available: list[str]) -> list[str]:
        """cpu: that only; cuda: a GPU or RuntimeError; else what is available, fastest first."""
        order = ["TensorrtExecutionProvider", "CUDAExecutionProvider", "CPUExecutionProvider"]
        if device == "cpu":
            return order[2:]
        if device == "cuda":
            gpu = [p for p in order[:2] if p in available]
            if not gpu:
                raise RuntimeError("no GPU provider is available")
            return [*gpu, order[2]]
        return [p for p in order if p in available]

    def session(self, name: str):
        """This worker's session of the shipped file; made once."""
        key = (name, self.device)
        if key not in _SESSIONS:
            import onnxruntime as ort
            from pyspark import SparkFiles

            _SESSIONS[key] = ort.InferenceSession(SparkFiles.get(name), providers=self.providers(self.device, ort.get_available_providers()))
        return _SESSIONS[key]

    def _ship(self, spark: SparkSession) -> str:
        """Send the weights to all machines under a name made of their contents, as files of one name would clash."""
        with tempfile.TemporaryDirectory(prefix="morphlake-weights-") as folder:
            at = os.path.join(folder, "weights")
            if ":" in self.weights:
                source, fs = folder_of(spark, self.weights)
                fs.copyToLocalFile(False, source, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{at}"), True)
            else:
                shutil.copyfile(self.weights, at)
            with open(at, "rb") as f:
                name = hashlib.file_digest(f, "sha256").hexdigest() + ".onnx"
            if (spark.sparkContext.applicationId, name) not in _SHIPPED:
                os.rename(at, os.path.join(folder, name))
                kept = os.path.join(tempfile.mkdtemp(prefix="morphlake-weights-"), name)  # executors fetch it when they need it
                atexit.register(shutil.rmtree, os.path.dirname(kept), ignore_errors=True)
                shutil.move(os.path.join(folder, name), kept)
                spark.sparkContext.addFile(kept)
                _SHIPPED.add((spark.sparkContext.applicationId, name))
        return name

    def score(self, words: DataFrame) -> DataFrame:
        shipped = self._ship(words.sparkSession)
        scorer = self

        def run(frames):
            import numpy as np
            import pandas as pd

            session = scorer.session(shipped)
            name = session.get_inputs()[0].name
            unk = scorer.chars.get("<UNK>", 1)
            for frame in frames:
                held = frame["word"].dropna().tolist()
                by_width: dict[int, list[str]] = {}
                for w in held:
                    by_width.setdefault(min(scorer.maxlen, -(-max(len(w), 1) // 8) * 8), []).append(w)
                for width, own in sorted(by_width.items()):
                    for a in range(0, len(own), scorer.batch):
                        part = own[a : a + scorer.batch]
                        ids = np.zeros((len(part), width), dtype=np.int32)
                        for i, w in enumerate(part):
                            ids[i, : min(len(w), width)] = [scorer.chars.get(c, unk) for c in w[:width]]
                        logits = session.run(None, {name: ids})[0]
                        tags, confs = logits.argmax(-1), logits.max(-1)
                        yield pd.DataFrame({"word": part, "tag_ids": [t[: len(w)] for t, w in zip(tags, part, strict=True)], "confs": [c[: len(w)].astype("float32") for c, w in zip(confs, part, strict=True)]})

        return words.select("word").mapInPandas(run, SCORED)
