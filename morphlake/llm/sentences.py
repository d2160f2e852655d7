"""Sentence units of mail bodies across languages and scripts.

What a period means is learned without labels, per language, by log-likelihood ratios over the whole
collection: abbreviations (types that come with a period far more often than chance has it), collocations
across a period (a number and the word after it), and sentence starters. A row-local pass counts, Spark adds
the counts up and scores them, and a second row-local pass classifies each mark with what was learned.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from morphlake.operators.shared import written

#: Least log-likelihood ratio (chi-square, one degree of freedom, p < 0.005), and least share of a type's occurrences with a period.
LEAST_RATIO, LEAST_SHARE = 7.88, 0.8
#: Least share of a language's tokens that a learned word makes up: so a language has at most ten million of them,
#: whatever the number of documents.
LEAST_PART = 1e-7
NUMBER = "##"

_OPEN = "\"'«»„“”‘’‚‹›(¿¡[{—–-*「『“《"
_CLOSE = "\"'»«”“’‘›‹)]}」』》）】"
_TOKEN = re.compile(r"\S+")
_NUMBER = re.compile(r"[\d.,:/-]*\d")
_MARKS = re.compile(r"[.!?…؟।॥。！？｡‼⁇⁈⁉]+(?:[\"'”’“‘»›)\]}」』》）】«‹]|[ \u00a0\u202f]?\r?\n?(?<=[ \u00a0\u202f\n])[»›](?!\w))*")
_LAST = re.compile(r"[^\s\"'«»„“”‘’‚‹›(¿¡\[{「『“《—–*]+\Z")
_CJK = re.compile(r"[぀-ヿ㐀-鿿豈-﫿ｦ-ﾟ]")
_SAYS = re.compile(r"[^\s。！？…“”「」，、]{1,16}?(?:说|道|问|答|喊|写)[。！？，：]")
_ALNUM = re.compile(r"[^\W_]")


def paragraphs(text: str) -> list[tuple[int, int]]:
    """(start, end) of each paragraph of the body: what empty lines, quoted lines and the `-- ` line part."""
    m = re.search(r"\r?\n\r?\n", text)
    if not m:
        return []
    out, start, end, at = [], None, 0, m.end()
    while at < len(text):
        z = text.find("\n", at)
        z = len(text) if z < 0 else z
        line = text[at:z].rstrip("\r")
        if line == "-- ":
            break
        if line.startswith(">") or not line.strip():
            if start is not None:
                out.append((start, end))
                start = None
        else:
            start = at if start is None else start
            end = at + len(line.rstrip())
        at = z + 1
    if start is not None:
        out.append((start, end))
    return out


def items(par: str) -> list[tuple[int, int]]:
    """The items of a numbered list that a paragraph is: lines that begin with 1, 2, 3 and so on."""
    cuts, n = [], 1
    for m in re.finditer(r"(?m)^(\d{1,3})[.)][ \t]", par):
        if int(m[1]) == n and (n > 1 or m.start() == 0):
            cuts.append(m.start())
            n += 1
    return [(a, z) for a, z in zip(cuts, [*cuts[1:], len(par)])] if cuts else []


_LANG = re.compile(r"[a-z]{2,3}(?![a-z])")


def language(lang: str | None) -> str:
    """A language's code of two or three letters, without region; `und` where there is none."""
    m = _LANG.match((lang or "").strip().lower())
    return m[0] if m else "und"


def _count(par: str, lang: str, types: Counter, pairs: Counter) -> None:
    """Add a paragraph's tokens to the counts; NUMBER stands for every number."""
    before, broke = "", False  # the type before if a period follows it; whether a plain sentence break came before
    for m in _TOKEN.finditer(par):
        token = m[0].lstrip(_OPEN)
        core = token.rstrip(_CLOSE)
        base = core.rstrip(".!?…,;:。！？")
        tail = core[len(base) :]
        if not base:
            before, broke = "", False
            continue
        kind = NUMBER if _NUMBER.fullmatch(base) else base.lower()
        first = base[0]
        lower = first.islower() or first.isdigit()
        upper = first.isupper()
        if before:
            types[lang, before, "x"] += lower
            types[lang, before, "c"] += not lower and not upper
            if upper:
                types[lang, before, "u"] += 1
                pairs[lang, before, kind] += 1
        if "@" not in base and "/" not in base:
            types[lang, kind, "n"] += 1
            types[lang, kind, "l"] += first.islower()
            types[lang, kind, "b"] += broke and upper
            types[lang, kind, "U"] += upper
            if tail == "." or tail == ".,":
                types[lang, kind, "p"] += 1
                if tail == ".,":
                    types[lang, kind, "x"] += 1
        closed = len(core) < len(token)
        before = kind if tail == "." and not closed else ""
        broke = tail != "" and tail[0] in ".!?…" and (len(base) > 3 or tail[0] != ".")


def _counts(batches):
    for b in batches:
        types: Counter = Counter()
        pairs: Counter = Counter()
        for text, lang in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            for a, z in paragraphs(text):
                par = text[a:z]
                for i, k in items(par) or [(0, len(par))]:
                    _count(par[i:k], language(lang), types, pairs)
        rows = [(*k[:2], "", k[2], n) for k, n in types.items() if n] + [(*k, "pair", n) for k, n in pairs.items()]
        cols = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(list(c), pa.string()) for c in cols[:4]), pa.array(list(cols[4]), pa.int64())], names=["lang", "w", "w2", "what", "n"])


@dataclass
class Model:
    """abbreviations: language -> type -> share of sentence ends among its uses before a capital; starters and
    follows (after a number and period, no sentence starts): language -> words. `und` holds all languages'."""

    abbreviations: dict[str, dict[str, float]] = field(default_factory=dict)
    starters: dict[str, set[str]] = field(default_factory=dict)
    follows: dict[str, set[str]] = field(default_factory=dict)

    def of(self, lang: str | None, text: str = "") -> tuple[dict[str, float], set[str], set[str]]:
        """What holds for a text: its stated language's, and where the text uses none of that language's starters
        but another's, that one's too; all languages' where the language isn't known."""
        lang = language(lang)
        lang = lang if lang in self.abbreviations or lang in self.starters else "und"
        own = self.abbreviations.get(lang, {}), self.starters.get(lang, set()), self.follows.get(lang, set())
        if lang == "und" or own[1] and not own[1].isdisjoint(here := set(text.lower().split())) or not text:
            return own
        here = set(text.lower().split())
        other = max(self.starters, key=lambda k: (k != "und") * len(here & self.starters[k]), default=lang)
        if other in ("und", lang) or not here & self.starters[other]:
            return own
        return self.abbreviations.get(other, {}) | own[0], own[1] | self.starters[other], own[2] | self.follows.get(other, set())


def _ratio(a: Column, b: Column, both: Column, n: Column) -> Column:
    """Dunning's log-likelihood ratio of two events with counts a and b among n and both together; 0 where they
    come together no more often than chance has it."""
    part = lambda x: F.when(x > 0, x * F.log(x.cast("double"))).otherwise(0.0)
    cells = part(both) + part(a - both) + part(b - both) + part(n - a - b + both)
    return F.when(both.cast("double") * n > a.cast("double") * b, 2 * (cells + part(n) - part(a) - part(n - a) - part(b) - part(n - b))).otherwise(0.0)


def eligible(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, text, lang of the documents whose text is plain: ctype text/plain, cte 7bit or 8bit."""
    plain = (F.lower(F.trim("ctype")) == "text/plain") & F.lower(F.trim("cte")).isin("7bit", "8bit") & F.col("text").isNotNull()
    return df.where(plain).select(F.col(id_col).cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def learn(docs: DataFrame) -> Model:
    """The model of all documents (doc_id, text, lang).

    One row-local pass counts and one aggregation adds up, per language, types and the pairs across a period; the
    counts of types are a written table, and all that follows works on tables of that size. What reaches the driver
    are words that are significant and make up LEAST_PART of their language's tokens each, which bounds them.
    """
    found = written(docs.mapInArrow(_counts, "lang string, w string, w2 string, what string, n bigint").groupBy("lang", "w", "w2", "what").agg(F.sum("n").alias("n")), "sentence-counts")
    one = lambda k: F.coalesce(F.sum(F.when(F.col("what") == k, F.col("n"))), F.lit(0)).alias(k if k != "U" else "big")
    common = (F.col("l") * 20 >= F.col("n")) & (F.col("l") > 0) | (F.col("b") >= 5) & (F.col("b") >= 0.9 * F.col("big"))
    types = written(found.where("what <> 'pair'").groupBy("lang", "w").agg(*map(one, "nplxucbU")).withColumn("common", common), "sentence-types")
    numbers = F.coalesce(F.sum(F.when(F.col("w") == NUMBER, F.col("p"))), F.lit(0)).alias("numbers")
    # a row for each language, of which there are as many as codes of three letters at most
    totals = F.broadcast(types.groupBy("lang").agg(F.sum("n").alias("all"), F.sum("p").alias("dots"), F.sum("b").alias("breaks"), numbers))
    rate = F.greatest(F.least(F.col("dots") / F.col("all"), F.lit(0.98)), F.lit(1e-9))
    ratio = 2 * (F.col("p") * (F.log(F.lit(0.99)) - F.log(rate)) + (F.col("n") - F.col("p")) * (F.log(F.lit(0.01)) - F.log(1 - rate)))
    scored = types.join(totals, "lang").withColumn("opens", _ratio(F.col("breaks"), F.col("n"), F.col("b"), F.col("all")) >= LEAST_RATIO)
    often = scored.where((F.col("p") >= LEAST_SHARE * F.col("n")) & (F.col("p") > 1) & (ratio >= LEAST_RATIO) & (F.col("w") != NUMBER) & (F.col("n") >= LEAST_PART * F.col("all")))
    pairs = found.where("what = 'pair'").select("lang", "w", "w2", F.col("n").alias("m"))
    # of the capitals after a type and its period: how many are words that are also written small
    after = written(pairs.join(scored.select("lang", F.col("w").alias("w2"), "common", "opens", F.col("n").alias("n2"), "numbers", "all"), ["lang", "w2"]), "sentence-pairs")
    kinds = after.groupBy("lang", "w").agg(F.sum(F.when(F.col("common"), F.col("m"))).alias("starts"), F.sum("m").alias("m"), F.count(F.when(~F.col("common"), 1)).alias("names"))
    judged = often.join(kinds, ["lang", "w"], "left").fillna(0, ["starts", "m", "names"])
    letters = F.length(F.regexp_replace("w", r"[^\p{L}\p{M}]", ""))
    goes_on = F.col("x") >= 0.05 * F.col("p")
    names = (F.col("m") - F.col("starts") >= 0.5 * F.col("m")) & (F.col("m") > 0) & ((letters <= 3) | (F.col("names") >= 4))
    caseless = (F.col("u") == 0) & (F.col("x") == 0) & (F.col("c") > 0) & (letters <= 3)
    share = F.when((F.col("m") >= 3) & (F.col("m") >= 0.05 * F.col("p")), F.col("starts") / F.col("m")).otherwise(0.0)
    abbreviations = written(judged.where((letters > 0) & (goes_on | names | caseless)).select("lang", "w", share.alias("share")), "sentence-abbreviations")
    # after an abbreviation or a number: words that start sentences; and words bound to the number before them, as
    # they stand there more often than chance has it and start no sentences
    met = after.join(abbreviations.select("lang", "w").withColumn("known", F.lit(True)), ["lang", "w"], "left").where((F.col("w") == NUMBER) | F.col("known")).where(F.col("n2") >= LEAST_PART * F.col("all"))
    tied = (F.col("w") == NUMBER) & ~F.col("common") & ~F.col("opens") & (F.col("m") > 1) & (_ratio(F.col("numbers"), F.col("n2"), F.col("m"), F.col("all")) >= LEAST_RATIO)
    kind = F.when(F.col("common") & F.col("opens"), "starter").when(tied, "follows")
    learned = abbreviations.select("lang", F.lit("abbreviation").alias("kind"), "w", "share").unionByName(met.select("lang", kind.alias("kind"), F.col("w2").alias("w"), F.lit(0.0).alias("share")).where("kind is not null").distinct())
    model = Model()
    for r in learned.collect():
        for lang in {r.lang, "und"}:
            if r.kind == "abbreviation":
                held = model.abbreviations.setdefault(lang, {})
                held[r.w] = min(r.share, held.get(r.w, r.share)) if lang == "und" else r.share
            else:
                (model.starters if r.kind == "starter" else model.follows).setdefault(lang, set()).add(r.w)
    return model


def _goes_on(par: str, mark: str, at: int, end: int, capitals: bool, abbreviations: dict[str, float], starters: set[str], follows: set[str]) -> bool:
    """Whether the sentence goes on after the mark (with closing quotes) par[at:end].

    Looks no further than the words around the mark: a paragraph may be very long.
    """
    ahead = _ALNUM.search(par, end)
    if not ahead:
        return False
    rest = par[end : ahead.start() + 100]
    bare = mark.rstrip(_CLOSE + " \u00a0\u202f\r\n")
    closed = len(bare) < len(mark)
    gap = len(rest) - len(rest.lstrip())
    after = rest[gap:]
    first = _ALNUM.search(after)
    letter = first[0]
    led = after[: first.start()]  # opening marks, dashes, commas before it
    if led[:1] in tuple(",;:，、；：،") if led else False:
        return True
    if _CJK.match(par[at - 1 : at]) or bare[0] in "。！？｡":
        if set(bare) <= {"…", "."}:
            return True
        if closed:
            return after.startswith("と") or bool(_SAYS.match(after))
        return False
    if bare[0] in "।॥؟":
        return False
    strong = bare.strip(".…") != ""
    if letter.islower():
        if closed or led or not gap or bare == "…" or len(bare) > 1 and not strong or capitals:
            return True
        # nobody writes capitals here: only abbreviations and numbers keep a sentence going
        last = _LAST.search(par, max(0, at - 80), at)
        word = (last[0] if last else "").lower()
        return not strong and (word in abbreviations or len(word) == 1 or bool(_NUMBER.fullmatch(word)))
    if strong:
        return not gap and not closed and not letter.isupper()
    cased = letter.isupper()
    if len(bare) > 1 or bare == "…":  # ellipsis
        return not (cased or letter.isdigit() and gap)
    last = _LAST.search(par, max(0, at - 80), at)
    word = last[0] if last else ""
    if not gap and not closed:
        # no blank: an end only between whole words, or after a closing quote
        whole = len(word) > 1 and word[-1].islower() and word.isalpha() and word.lower() not in abbreviations
        return not (cased and (whole or par[at - 1 : at] in _CLOSE))
    if closed:
        return False
    m = re.match(r"[\w\u0300-\u036f]+(?:[.’'-]\w+)*", after[first.start() :])
    following = m[0].lower() if m else letter
    next_dot = after[first.start() + len(following) : first.start() + len(following) + 1] == "."
    if _NUMBER.fullmatch(word):
        return cased and following not in starters and following in follows
    kind = word.lower()
    if kind in abbreviations or len(kind) == 1 and kind.isalpha() and word.isupper():
        if letter.isdigit() or not cased:
            return True
        if next_dot and (following in abbreviations or len(following) == 1):
            return True
        if following in starters:
            return False
        return abbreviations.get(kind, 0.0) < 0.15
    return False


def _opens(mark: str, par: str, start: int, end: int) -> bool:
    """Whether the last of the quotes after a mark opens the next sentence instead."""
    q = mark[-1]
    if q in "“‘":
        return par.rfind("„‚"["“‘".index(q)], start, end - 1) <= par.rfind(q, start, end - 1)
    tight = end < len(par) and not par[end].isspace()
    return tight and (q in "«‹" or q in "\"'" and par.count(q, start, end) % 2 == 1)


def unit_ends(text: str, abbreviations: dict[str, float], starters: set[str], follows: set[str]) -> list[int]:
    """Number of code points up to and including each unit's last character."""
    ends: list[int] = []
    for a, z in paragraphs(text):
        par = text[a:z]
        listed = items(par)
        if listed:
            ends += [a + i + len(par[i:k].rstrip()) for i, k in listed if _ALNUM.search(par[i:k])]
            continue
        start, capitals = 0, None
        for m in _MARKS.finditer(par):
            mark, end = m[0], m.end()
            while _opens(mark, par, start, end):
                mark, end = mark[:-1], end - 1
            if not mark or not _ALNUM.search(par, start, end):
                continue
            if capitals is None:
                capitals = any(map(str.isupper, par))
            if not _goes_on(par, mark, m.start(), end, capitals, abbreviations, starters, follows):
                ends.append(a + end)
                start = end
        if _ALNUM.search(par, start):
            ends.append(a + len(par.rstrip()))
    return ends


def sentence_units(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, end_pos of each unit of docs (doc_id, text, lang). Row-local; the model is bounded as learn() says.

    Null texts, bodies without a letter or digit and messages without an empty line give no rows; a repeated
    document gives its rows again.
    """

    def run(batches):
        for b in batches:
            ids, ends = [], []
            for i, text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if text:
                    own = unit_ends(text, *model.of(lang, text))
                    ids += [i] * len(own)
                    ends += own
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ends, pa.int64())], names=["doc_id", "end_pos"])

    return docs.select("doc_id", "text", "lang").mapInArrow(run, "doc_id bigint, end_pos bigint")
