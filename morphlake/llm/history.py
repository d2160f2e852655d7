"""Deduplicating new batches against all history by suffix arrays of word sequences.

Each record becomes the sequence of its distinct words in one fixed order, so that records with nearly the
same words share long substrings wherever the words stood. The sequences of a batch are concatenated and the
suffixes that begin in them sorted: an immutable suffix array, stored as a segment, bucketed and sorted by the
suffixes' leading pair of words. A new batch is looked up in each segment where it lies: the batch's own array
has the same order, so all its binary searches are one merge pass, and no segment is shuffled. A common pair
nominates two records; the coverage of all their common substrings, counted on the words themselves, decides.
Segments of one level merge, so there are at most log2(batches) + 1 of them.

Order of words: those in at least SHARE, or HOT, of the first batch's records come last, the most frequent at the
end; the others by hash. Any fixed order gives the same answers; this one keeps leading pairs rare.

Why pairs suffice, and which suffixes are needed: words that two records don't share part the shared ones into
runs; at a similarity t, s shared words among u, at most u - s + 1 runs, so at least 2s - u - 1 pairs of
neighbours are common. By the pigeonhole principle the first common pair of a record of n words then begins at
one of its first 2 (1 - t) n + 1 words in that order, in both records. Suffixes that begin at later, more frequent
words can't be the only match, and aren't stored. This loses nothing at any t over two thirds.

Skew: exact copies meet as one class. A leading pair with more than HOT suffixes, by full count, is not looked up
alone: two records of that similarity also share one of their first n - ceil(t n) + 1 words, so its suffixes are
stored once for each of these words, under pair and word. Texts that only share boilerplate then don't meet. Of
each key's suffixes in a segment the LEADS earliest are looked up first; only records that these don't decide go on
to the others, so a large group of records that are all alike isn't paired out.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NullType
from pyspark.sql.window import Window

from morphlake.functions.keys import word_key
from morphlake.llm.encoding import LetterModel, restore
from morphlake.llm.lookalike import Skeleton, skeleton, skeleton_of
from morphlake.operators.shared import StateFiles, new_path, remove, set_for, written

_WORD = re.compile(r"[^\W_]+")
#: Suffixes from which a leading pair is hot, and how many suffixes of a key are looked up first.
HOT, LEADS = 20_000, 8
#: Share of records from which a word counts as frequent, unless HOT is less: there are at most (words a record) / SHARE
#: such words, or (words of all records) / HOT.
SHARE = 0.0005
#: Rows of a bucket, at about 40 bytes a suffix, 30 a digest and 500 a sequence.
BUCKET_ROWS = {"suffixes": 4_000_000, "digests": 4_000_000, "words": 250_000}
#: A bucket here is one sorted file: Spark may count on the order instead of sorting again.
SORTED_BUCKETS = "spark.sql.legacy.bucketedTableScan.outputOrdering"
TABLES = {
    "suffixes": ("key bigint, row_id bigint, n int, at int, sig bigint, base bigint, lead boolean", "key", "key"),
    "digests": ("cls binary, row_id bigint", "cls", "cls"),
    "words": ("row_id bigint, words array<string>", "row_id", "row_id"),
}


def words_of(text: str, form: Skeleton = skeleton) -> set[str]:
    """The distinct words a reader sees: look-alikes and accents in one form, lower case, ё as е."""
    seen = form(text).lower().replace("ё", "е").replace("́", "")
    return set(_WORD.findall(unicodedata.normalize("NFC", seen)))


def parsed(df: DataFrame, model: LetterModel | None, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """row_id, cls, words: the distinct words of each record that has words, and their 128-bit digest.

    Null texts, texts without a word and (with a model) wrongly decoded texts stay out.
    """
    source = df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).cast("string").alias("text"))
    form = skeleton_of(df.sparkSession)

    def run(batches):
        import xxhash

        for b in batches:
            ids, classes, lens, flat = [], [], [0], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text or model is not None and restore(text, model, find_only=True)[0]:
                    continue
                if words := sorted(words_of(text, form)):
                    ids.append(i)
                    classes.append(xxhash.xxh3_128_digest("\n".join(words).encode("utf-8", "surrogatepass")))
                    flat += words
                    lens.append(len(flat))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(classes, pa.binary()), pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.array(flat, pa.string()))], names=["row_id", "cls", "words"])

    return source.mapInArrow(run, "row_id bigint, cls binary, words array<string>")


def suffixes(sequences: DataFrame, frequent: list[int], similarity: float, hot: Iterable[int] = ()) -> DataFrame:
    """key, row_id, n, at, sig, base, common of the needed suffixes of sequences (row_id, words) of two or more words.

    key is a hash of the leading pair, n the number of words, at the suffix's place, sig one bit a word; common
    says that both leading words are frequent. A suffix whose pair is among the hot ones comes once for each of the
    record's first words: key is then a hash of pair and word, and base that of the pair. frequent: hashes of the
    frequent words, the rarest first.
    """
    hot_keys = np.array(sorted(hot), dtype=np.int64)
    ranked = np.array(frequent, dtype=np.int64)
    order = np.argsort(ranked)
    ranked, ranks = ranked[order], order + 1

    def run(batches):
        for b in batches:
            lists = b.column(1)
            offsets = lists.offsets.to_numpy().astype(np.int64)
            values, offsets = lists.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]
            n = np.diff(offsets)
            if not len(n):
                continue
            of = np.repeat(np.arange(len(n)), n)
            rank = np.zeros(len(values), dtype=np.int64)
            if len(ranked):
                place = np.minimum(np.searchsorted(ranked, values), len(ranked) - 1)
                rank = np.where(ranked[place] == values, ranks[place], 0)
            by = np.lexsort((values, rank, of))
            values, rank = values[by].view(np.uint64), rank[by]
            sig = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (values >> np.uint64(7)) % np.uint64(63)), offsets[:-1])
            starts = np.minimum(np.floor(2 * (1 - similarity) * n + 1e-9).astype(np.int64) + 1, n - 1)
            doc = np.repeat(np.arange(len(n)), starts)
            at = np.arange(len(doc)) - np.repeat(np.cumsum(starts) - starts, starts)
            here = offsets[:-1][doc] + at
            key = _mixed(values[here], values[here + 1])
            is_hot = np.zeros(len(key), dtype=bool)
            common = (rank[here] > 0) & (rank[here + 1] > 0)
            pick, base = np.arange(len(key)), key
            if len(hot_keys):
                is_hot = hot_keys[np.minimum(np.searchsorted(hot_keys, key), len(hot_keys) - 1)] == key
                times = np.where(is_hot, (n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1)[doc], 1)
                pick = np.repeat(pick, times)
                nth = np.arange(len(pick)) - np.repeat(np.cumsum(times) - times, times)
                base, is_hot = key[pick], is_hot[pick]
                key = np.where(is_hot, _mixed(base.view(np.uint64), values[offsets[:-1][doc[pick]] + nth]), base)
            doc = doc[pick]
            out = (key, b.column(0).to_numpy()[doc], n[doc].astype(np.int32), at[pick].astype(np.int32), sig[doc].view(np.int64))
            yield pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(base, mask=~is_hot), pa.array(common[pick])], names=["key", "row_id", "n", "at", "sig", "base", "common"])

    hashed = sequences.where(F.size("words") > 1).select("row_id", F.transform("words", lambda w: F.xxhash64(w)).alias("seq"))
    return hashed.mapInArrow(run, "key bigint, row_id bigint, n int, at int, sig bigint, base bigint, common boolean")


def _mixed(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15) + y
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))).view(np.int64)


class SuffixIndex:
    """Suffix arrays of all history in a folder, for rows of row_id, cls (a digest of the words) and words.

    A state file names the segments; it is written whole under a new name, so a run that dies leaves the state
    before it. A second index on the same folder goes on where the first ended. similarity: from 2/3 to 1.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, similarity: float = 0.7, hot: int = HOT, leads: int = LEADS):
        if not 2 / 3 < similarity <= 1:
            raise ValueError(f"{similarity} isn't between two thirds and 1")
        self.spark, self.path, self.similarity, self.most, self.leads = spark, path or new_path(spark, "suffix-index"), similarity, hot, leads
        self.segments: list[dict] = []
        self.frequent: list[int] | None = None
        self.hot: dict[int, int] = {}
        self._names: dict[str, str] = {}
        self.state = StateFiles(spark, self.path)
        self._load()

    # --- what is stored

    def _load(self) -> None:
        if kept := self.state.load():
            if kept["similarity"] > self.similarity + 1e-9:
                raise ValueError(f"stored for a similarity of {kept['similarity']}, asked for {self.similarity}")
            self.similarity, self.segments, self.frequent, self.hot = kept["similarity"], kept["segments"], kept["frequent"], {int(k): n for k, n in kept["hot"].items()}

    def _save(self) -> None:
        self.state.save({"similarity": self.similarity, "segments": self.segments, "frequent": self.frequent, "hot": self.hot})

    def _table(self, segment: dict, kind: str) -> DataFrame:
        """A table of a segment, read with its buckets: joins by the bucket's column move nothing of it."""
        at, buckets = segment[kind]
        if at not in self._names:
            columns, by, order = TABLES[kind]
            self._names[at] = f"suffix_index_{uuid.uuid4().hex}"
            self.spark.sql(f"create table {self._names[at]} ({columns}) using parquet clustered by ({by}) sorted by ({order}) into {buckets} buckets location '{at}'")
        return self.spark.table(self._names[at])

    def _store(self, df: DataFrame, kind: str, rows: int) -> list:
        """Write a table of a segment: [where, number of buckets]. Buckets grow in number, not in size."""
        columns, by, order = TABLES[kind]
        buckets = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows / BUCKET_ROWS[kind]))
        at, name = f"{self.path}/{kind}-{uuid.uuid4().hex}", f"suffix_index_{uuid.uuid4().hex}"
        df = df.repartition(buckets, by)
        if kind == "suffixes":
            earliest = F.row_number().over(Window.partitionBy("key").orderBy("row_id"))
            df = df.withColumn("lead", earliest <= self.leads).select(*[c.split()[0] for c in columns.split(", ")])
        df.write.format("parquet").bucketBy(buckets, by).sortBy(order).option("path", at).saveAsTable(name)
        self._names[at] = name
        return [at, buckets]

    # --- a batch

    def _note_hot(self, counts: DataFrame) -> list[int]:
        """Keep the hot keys of counts (key, n); returns those not known before. There are at most suffixes / HOT."""
        found = {r.key: r.n for r in counts.where(F.col("n") > self.most).collect()}
        fresh = [k for k in found if k not in self.hot]
        self.hot |= found
        return fresh

    def _count_hot(self, words: DataFrame, n: int) -> None:
        """Learn the order of words from the first batch, and count the batch's leading pairs of two frequent words:
        no other pair can be hot."""
        least = max(2, min(math.ceil(SHARE * n), self.most))
        counts = words.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
        found = counts.where(F.col("n") >= least).select(F.xxhash64("w").alias("h"), "n").orderBy("n", "h").collect()
        if self.frequent is None:
            self.frequent = [r.h for r in found]
        if any(r.n > self.most for r in found):
            pairs = suffixes(words, self.frequent, self.similarity).where("common")
            self._note_hot(pairs.groupBy("key").agg(F.count("*").alias("n")))

    def take_in(self, rows: DataFrame, answer: bool = True) -> DataFrame | None:
        """Add a batch (row_id, cls, words). Returns row_id of its rows that repeat, or are as similar as asked to, a
        row of history or a row of the batch with smaller row_id; None if no answer is wanted.

        Rows whose cls is null or empty take no part. words may be null, or of one word, where only equal digests
        count; a column of type void means that all are. History is read in place; what is written and shuffled is of the size of the batch, but for the
        merging of segments.
        """
        with set_for(self.spark, {SORTED_BUCKETS: "true"}):
            return self._take_in(rows, answer)

    def _take_in(self, rows: DataFrame, answer: bool) -> DataFrame | None:
        self._merge()
        sequences = not isinstance(rows.schema["words"].dataType, NullType)
        batch = written(rows.select("row_id", "cls", *["words"] * sequences), "history-batch").where("length(cls) > 0")
        fresh = batch.groupBy("cls").agg(F.min("row_id").alias("row_id"))
        for s in self.segments:
            fresh = fresh.join(self._table(s, "digests").select("cls"), "cls", "left_anti")
        own: dict = {"level": 0, "digests": self._store(fresh, "digests", batch.count())}
        fresh = self._table(own, "digests")
        if sequences:
            own["words"] = self._store(batch.where(F.size("words") > 1).join(fresh.select("row_id"), "row_id", "left_semi").select("row_id", "words"), "words", batch.count())
            words = self._table(own, "words")
            many, size = words.agg(F.count("*"), F.sum(F.size("words"))).first()
            if many:
                self._count_hot(words, many)
                size += int(sum(self.hot.values()) * (1 - self.similarity) * size / many)
                own["suffixes"] = self._store(suffixes(words, self.frequent, self.similarity, self.hot), "suffixes", size)
        found = None
        if answer:
            found = batch.select("row_id").join(fresh.select("row_id"), "row_id", "left_anti")
            if "suffixes" in own:
                found = found.unionByName(self._near(own))
            found = written(found.distinct(), "history-found")
        self.segments.append(own)
        self._save()
        return found

    def _merge(self) -> None:
        """Merge the youngest two segments while they are of one level; done when the next batch comes."""
        old = []
        while len(self.segments) > 1 and self.segments[-1]["level"] == self.segments[-2]["level"]:
            pair = [self.segments.pop(), self.segments.pop()]
            merged: dict = {"level": pair[0]["level"] + 1}
            for kind in TABLES:
                if held := [s for s in pair if kind in s]:
                    both = self._table(held[0], kind)
                    for s in held[1:]:
                        both = both.unionByName(self._table(s, kind))
                    if kind == "suffixes":
                        both = self._rekeyed(both, held)
                    merged[kind] = self._store(both, kind, both.count())
            self.segments.append(merged)
            old += pair
        if old:
            self._save()
        for s in old:  # no state names them any more
            for kind in TABLES:
                if kind in s:
                    self.spark.sql(f"drop table if exists {self._names.pop(s[kind][0], 'none')}")
                    remove(self.spark, s[kind][0])

    def _rekeyed(self, both: DataFrame, segments: list[dict]) -> DataFrame:
        """Suffixes of segments that merge, with those of pairs that became hot over several batches made anew; such a
        pair has suffixes beyond the leads of some segment."""
        plain = both.where("base is null")
        fresh = self._note_hot(plain.where("not lead").groupBy("key").agg(F.count("*").alias("n")))
        if not fresh:
            return both
        hot = F.broadcast(self.spark.createDataFrame([(k,) for k in fresh], "key bigint"))  # a row for each hot key
        records = plain.join(hot, "key", "left_semi").select("row_id").distinct()
        made = None
        for s in segments:
            words = self._table(s, "words").join(records, "row_id", "left_semi")
            own = suffixes(words, self.frequent, self.similarity, fresh).where("base is not null")
            made = own if made is None else made.unionByName(own)
        rest = both.where("base is not null").unionByName(plain.join(hot, "key", "left_anti"))
        return rest.drop("lead").unionByName(made.drop("common"))

    def _pairs(self, q: DataFrame, c: DataFrame) -> DataFrame:
        """q, c, matched: records with a common leading pair that length, place and signature don't rule out."""
        q = q.select("key", F.col("row_id").alias("q"), F.col("n").alias("nq"), F.col("at").alias("aq"), F.col("sig").alias("sq"))
        c = c.select("key", F.col("row_id").alias("c"), F.col("n").alias("nc"), F.col("at").alias("ac"), F.col("sig").alias("sc"))
        need = F.ceil(F.lit(self.similarity / (1 + self.similarity)) * (F.col("nq") + F.col("nc")) - 1e-9)
        may = (F.col("c") < F.col("q")) & (F.least("aq", "ac") + F.least(F.col("nq") - F.col("aq"), F.col("nc") - F.col("ac")) >= need)
        may &= F.col("nq") + F.col("nc") - F.bit_count(F.col("sq").bitwiseXOR(F.col("sc"))) >= 2 * need
        both = q.join(c.hint("merge"), "key").where(may)
        return both.groupBy("q", "c").agg(F.count("*").alias("matched"))

    def _lookups(self, own: dict) -> list[DataFrame]:
        """The batch's suffixes to look up: as stored, and those of hot pairs also by the pair alone, as which a segment
        has them that was stored before the pair was hot."""
        mine = self._table(own, "suffixes")
        if not self.hot:
            return [mine]
        return [mine, mine.where("base is not null").withColumn("key", F.col("base")).dropDuplicates(["key", "row_id"])]

    def _covered(self, pairs: DataFrame, own: dict, segment: dict) -> DataFrame:
        """q of the pairs whose coverage, all their common words, reaches the similarity."""
        mine = self._table(own, "words").select(F.col("row_id").alias("q"), F.col("words").alias("wq"))
        theirs = self._table(segment, "words").select(F.col("row_id").alias("c"), F.col("words").alias("wc"))
        both = pairs.join(theirs.hint("merge"), "c").join(mine.hint("merge"), "q").withColumn("coverage", F.size(F.array_intersect("wq", "wc")))
        return both.where(F.col("coverage") >= self.similarity * (F.size("wq") + F.size("wc") - F.col("coverage")) - 1e-9).select(F.col("q").alias("row_id"))

    def _near(self, own: dict) -> DataFrame:
        held = [s for s in [*self.segments, own] if "suffixes" in s]
        found = None
        for s in held:
            for q in self._lookups(own):
                near = self._covered(self._pairs(q, self._table(s, "suffixes").where("lead")), own, s)
                found = near if found is None else found.unionByName(near)
        found = written(found.distinct(), "history-near")
        for s in held:
            rest = self._table(s, "suffixes").where("not lead")
            for q in self._lookups(own):
                open_ = q.join(rest.select("key").distinct().hint("merge"), "key", "left_semi").join(found, "row_id", "left_anti")
                found = found.unionByName(self._covered(self._pairs(open_, rest), own, s))
        return found


def repeated_texts(arrivals: list[DataFrame], batch: DataFrame, model: LetterModel | None, similarity: float = 0.7, index: SuffixIndex | None = None) -> DataFrame:
    """row_id of every record of batch whose word set is that of an earlier record, or at least as similar as asked.

    arrivals: the history in the order in which it came, batch: the records to answer for, all with row_id and text.
    Null texts, texts without words and wrongly decoded texts never count. Rows that tie in row_id count as one.
    """
    index = index or SuffixIndex(batch.sparkSession, similarity=similarity)
    for a in arrivals:
        index.take_in(parsed(a, model), answer=False)
    return index.take_in(parsed(batch, model))


def word_records(df: DataFrame, word_col: str = "word", id_col: str | None = "row_id") -> DataFrame:
    """row_id, cls, words of records of one word each: its key with ё as е, without stress marks, soft hyphens and
    hyphens, is the whole text, so cls is the word and there is nothing shorter to match. No id_col: row_id is -1."""
    plain = F.translate(F.regexp_replace(word_key(word_col), "[\\u0301\\u00AD\\u2010\\u2011-]", ""), "ё", "е")
    ids = F.col(id_col).cast("bigint") if id_col else F.lit(-1).cast("bigint")
    return df.select(ids.alias("row_id"), F.encode(plain, "UTF-8").alias("cls"), F.lit(None).alias("words"))


def repeated_words(df: DataFrame, seen: DataFrame, word_col: str = "word", id_col: str = "row_id", stage_col: str = "stage", index: SuffixIndex | None = None) -> DataFrame:
    """row_id of every new record whose word is that of a seen word, of history or of an earlier new record."""
    index = index or SuffixIndex(df.sparkSession)
    new = F.coalesce(F.col(stage_col) == "new", F.lit(False))
    index.take_in(word_records(seen, word_col, None), answer=False)
    index.take_in(word_records(df.where(~new), word_col, id_col), answer=False)
    return index.take_in(word_records(df.where(new), word_col, id_col))
