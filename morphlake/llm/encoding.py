"""Text decoded with the wrong character encoding: find it and restore it.

Characters are mapped back to the bytes of the legacy code page they were read in. For UTF-8 read as a
legacy page, an automaton over the byte structure (written as a regular expression over the page's
characters) finds the maximal well-formed multibyte spans, and only these are decoded, again while the
result still holds such spans. One legacy page read as another has no byte structure; there, runs of words
are mapped back and kept only if a letter-pair model of Russian prefers the result by a clear margin.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGES = ("cp1252", "cp1251", "koi8-r", "cp866", "mac-cyrillic")
RUSSIAN_PAGES = ("cp1251", "koi8-r", "cp866", "mac-cyrillic")

# Frequent Russian function words, beside the lexicon the model is fitted on.
COMMON_WORDS = "и в не на что с как по это из к но от за для же у так о мы его ещё бы все она или то уже ни при тот чтобы до если свой мой после только здесь когда он я был они вы под над без где кто там нет да".split()


def page_chars(page: str) -> list[str]:
    """The 256 characters of a page; bytes it leaves undefined stand for the control character of that number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(page))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


def _byte_map(page: str) -> dict[int, int]:
    chars = page_chars(page)
    table = {ord(c): b for b, c in enumerate(chars)}
    for b in range(0x80, 0xA0):  # readers that keep C1 controls
        table.setdefault(b, b)
    return table


def _class(page: str, lo: int, hi: int) -> str:
    table = _byte_map(page)
    return "[" + "".join(re.escape(chr(c)) for c, b in sorted(table.items()) if lo <= b <= hi) + "]"


def _automaton(page: str) -> str:
    tail = _class(page, 0x80, 0xBF)
    return f"(?:{_class(page, 0xC2, 0xDF)}{tail}|{_class(page, 0xE0, 0xEF)}{tail}{{2}}|{_class(page, 0xF0, 0xF4)}{tail}{{3}})"


BYTES = {p: _byte_map(p) for p in PAGES}
SPANS = {p: re.compile(_automaton(p) + "+") for p in PAGES}
#: Characters that decoded UTF-8 may consist of to be believed: Latin letters, Cyrillic, usual punctuation.
BELIEVED = re.compile(r"[\x80-ɏЀ-џҐґ‐-⁄€№™─-▟√≤≥ˆ˜\u0300-\u036fƒ\U0001f300-\U0001faff]+")
#: Least number of sequences in a span: where lead and tail characters also meet in ordinary text, two.
LEAST = {"cp1252": 1, "cp866": 1, "cp1251": 2, "koi8-r": 2, "mac-cyrillic": 2}
#: What a reading has to gain over another, in nats.
MARGIN = 9.0
#: The number of words as which a larger lexicon counts against COMMON_WORDS and the smoothing, so that what MARGIN
#: means doesn't drift with the lexicon's size. All its words count, each for less.
FULL_WEIGHT = 20_000
#: Line drawing, which only misread text has.
_BOX = re.compile(r"[─-▟]")
#: Nothing outside this needs a closer look: ordinary characters, ordinary letter case.
SUSPECT = re.compile(r"[^а-яёА-ЯЁa-zA-Z0-9\s.,!?:;…«»„“\"'()\[\]/%+=*&@#<>{}|\\^~`$_—–№-]|[А-ЯЁ]{2}|[а-яё][А-ЯЁ]|[–—][А-Я][–—]|[–—][а-яёА-Я]+[–—]")
_LETTERS = "абвгдежзийклмнопрстуфхцчшщъыьэюяё"
_ALPHABET = " " + _LETTERS  # the blank stands for a word's edge
_RUSSIAN_WORD = re.compile(r"[А-ЯЁа-яё]+")


class LetterModel:
    """Log-probabilities of Russian letter pairs, word edges included, fitted on a list of words or on counts of pairs."""

    def __init__(self, words: Iterable[str] = (), counts: Mapping[str, float] | None = None):
        pairs: Counter[str] = Counter(counts)
        for w in [*words, *COMMON_WORDS * 20]:
            w = " " + w.lower() + " "
            pairs.update(w[i : i + 2] for i in range(len(w) - 1))
        self.logp: dict[str, float] = {}
        for a in _ALPHABET:
            total = sum(pairs[a + b] for b in _ALPHABET) + 0.5 * len(_ALPHABET)
            for b in _ALPHABET:
                self.logp[a + b] = math.log((pairs[a + b] + 0.5) / total)
        self.floor = min(self.logp.values()) - 1
        self._known: dict[str, float] = {}

    def score(self, word: str) -> float:
        """Sum over the pairs of a word; other characters than Russian letters get the floor."""
        known = self._known.get(word)
        if known is None:
            w = " " + word.lower() + " "
            known = sum(self.logp.get(w[i : i + 2], self.floor) for i in range(len(w) - 1))
            if len(self._known) < 200_000:
                self._known[word] = known
        return known

    def __getstate__(self):
        return self.__dict__ | {"_known": {}}


def decode_spans(text: str, page: str, sure: int | None = None) -> tuple[str, int]:
    """text with the believed multibyte spans of UTF-8 read as page decoded, and the number of characters won.

    sure: the least length of a span that counts once the page is known to have been misread.
    """
    table, least, won = BYTES[page], sure or LEAST[page], 0

    def put(m: re.Match) -> str:
        nonlocal won
        raw = bytes(table[ord(c)] for c in m[0])
        try:
            plain = raw.decode("utf-8")
        except UnicodeDecodeError:  # surrogates and the like
            return m[0]
        need = 3 if page == "cp866" and sure is None and not _BOX.search(m[0]) else least  # letters only
        if len(plain) < need or not BELIEVED.fullmatch(plain):
            return m[0]
        won += len(plain)
        return plain

    return SPANS[page].sub(put, text), won


_LATIN_RUN = re.compile(r"(?<![A-Za-zÀ-ÿ])[À-ÿ¨¸]{2,}(?![A-Za-zÀ-ÿ])")
_INNER_SIGN = re.compile(r"[¤¦§©¬®¶µ±°√≈∙■∆ƒ≤≥÷]")
_CASE = re.compile(r"[А-ЯЁ]{2}|[а-яё][А-ЯЁ]")
_SLAVIC = re.compile(r"[ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐЄЇІіґєјЅѕї]")
#: Letters of other Cyrillic alphabets, for scoring as the Russian ones nearest to them.
_NEAREST = str.maketrans("ЂЃѓЉЊЌЋЏђљњќћџЎўЈҐЄЇІіґєјЅѕї", "ДГгЛНКЧЦдлнкчцУуЙГЕИИигейЗзи")
_ASCII_LETTER = re.compile(r"[A-Za-z]")
#: Blanks other than these may stand for a letter of another page.
_TOKEN = re.compile(r"[^ \n\t]+")
_C1 = re.compile(r"[\x80-\x84\x86-\x9f]")
_USUAL = re.compile(r"[А-ЯЁа-яё!-~…«»„“”—–№\s]+")


def _natural(word: str) -> bool:
    return word.islower() or word.isupper() or word.istitle()


def _pair(read_as: str, meant: str) -> dict[int, str]:
    chars = page_chars(meant)
    return {c: chars[b] for c, b in BYTES[read_as].items() if b >= 0x80}


PAIRS = {(r, m): _pair(r, m) for m in RUSSIAN_PAGES for r in PAGES if r != m}
_PLAIN_PAIRS = [("cp1251", "koi8-r"), ("koi8-r", "cp1251")]


def _worth(token: str, model: LetterModel) -> float | None:
    """How well a token reads as words; None for one without letters of interest, such as a foreign word."""
    if token.isascii() or _ASCII_LETTER.search(token):
        return None
    plain = token.translate(_NEAREST)
    if not _USUAL.fullmatch(plain):
        return model.floor * (len(token) + 1) * 0.8
    pieces = _RUSSIAN_WORD.findall(plain)
    strange = sum(a != b for a, b in zip(token, plain))
    return sum(model.score(w) - (0 if _natural(w) else 6) for w in pieces) - 3 * strange if pieces else None


def remap_words(text: str, model: LetterModel, margin: float = MARGIN) -> tuple[str, int]:
    """text with the runs of words read in the wrong single-byte page restored, and the number of characters changed.

    For each pair of pages, a word gains what the model gives its mapped-back form over its present one; a form
    with signs that words don't have counts against. Runs of neighbouring words whose gain passes margin (in nats)
    are replaced, those of higher gain first, where they don't overlap; a run ends where going on would lose margin.
    """
    tokens = list(_TOKEN.finditer(text))
    base = [_worth(t[0], model) for t in tokens]
    letters = [sum(map(str.isalpha, t[0])) for t in tokens]
    runs: list[tuple[float, int, int, list]] = []
    for pair in _PLAIN_PAIRS if _USUAL.fullmatch(text) else PAIRS:
        forms = [t[0].translate(PAIRS[pair]) for t in tokens]
        start, total, gain, stop = 0, 0.0, margin, -1
        for i, (form, was) in enumerate(zip(forms, base, strict=True)):
            if was is not None:
                pieces = _RUSSIAN_WORD.findall(form) if _USUAL.fullmatch(form) else []
                if sum(map(len, pieces)) >= max(1, letters[i]):  # what was a letter is one still
                    total += sum(model.score(w) - (0 if _natural(w) else 6) for w in pieces) - was
                else:
                    total -= 8.0
            if total > gain:
                gain, stop = total, i
            if total < 0 or gain - total > margin:  # words that read well as they are part two runs
                if stop >= 0:
                    runs.append((gain, start, stop, forms))
                start, total, gain, stop = i + 1, 0.0, margin, -1
        if stop >= 0:
            runs.append((gain, start, stop, forms))
    words, taken = [t[0] for t in tokens], bytearray(len(tokens))
    for _, lo, hi, forms in sorted(runs, key=lambda r: -r[0]):
        if not any(taken[lo : hi + 1]):
            words[lo : hi + 1], taken[lo : hi + 1] = forms[lo : hi + 1], b"\1" * (hi + 1 - lo)
    out, at, won = [], 0, 0
    for t, word in zip(tokens, words, strict=True):
        out += [text[at : t.start()], word]
        won += len(word) * (word != t[0])
        at = t.end()
    return "".join([*out, text[at:]]), won


def _decoded(text: str) -> str:
    """text with all layers of UTF-8 read in some page decoded."""
    while True:  # each turn makes the text shorter
        won, by = max((decode_spans(text, page)[1], page) for page in PAGES)
        if not won:
            return text
        text = decode_spans(text, by, 1)[0]  # the page is known now: single characters count too


def _looks_odd(text: str) -> bool:
    """Whether a text has what words of another single-byte page have, but seldom those of this one."""
    return any(p.search(text) for p in (_C1, _CASE, _LATIN_RUN, _BOX, _INNER_SIGN, _SLAVIC))


def _remapped(text: str, model: LetterModel) -> tuple[str, bool]:
    """text with all runs of words remapped until none is left, and whether there was one."""
    if not _looks_odd(text):
        return text, False
    met = {text}  # pages that lead back to an earlier form end the search
    while (plain := remap_words(text, model))[1] and plain[0] not in met:
        text = plain[0]
        met.add(text)
    return text, len(met) > 1


def restore(text: str, model: LetterModel, find_only: bool = False) -> tuple[bool, str]:
    """Whether text, or a stretch of it, was decoded wrongly, and the text restored as far as can be.

    find_only: stop as soon as that is known; the text is then returned as it is. The answer is the same.
    """
    if not SUSPECT.search(text):
        return False, text
    found = bool(_C1.search(text))
    if find_only:  # without a span to decode, one run of words decides
        return found or any(decode_spans(text, page)[1] for page in PAGES) or _looks_odd(text) and bool(remap_words(text, model)[1]), text
    plain = _decoded(text)
    best, remapped = _remapped(plain, model)
    if plain != text:
        # single-byte text may hold what looks like UTF-8: the other order counts where it reads clearly better
        other = _remapped(text, model)
        worth = lambda t: sum(_worth(m[0], model) or 0 for m in _TOKEN.finditer(t))
        if other[1] and worth(last := _remapped(_decoded(other[0]), model)[0]) > worth(best) + MARGIN:
            best = last
    return found or remapped or plain != text, best


def fit_model(lexicon: DataFrame, word_col: str = "word", full_weight: int = FULL_WEIGHT) -> LetterModel:
    """The letter model of a lexicon, fitted on the pairs of all its words of two letters or more; 34 x 34 counts reach
    the driver."""
    edged = F.lower(F.concat(F.lit(" "), F.col(word_col), F.lit(" ")))
    pairs = F.regexp_extract_all(edged, F.lit(f"(?=([{_ALPHABET}]{{2}}))"), F.lit(1))
    rows = lexicon.where(F.length(word_col) > 1).select(F.explode(F.concat(F.array(F.lit("")), pairs)).alias("pair"))  # "" counts the words
    counts = rows.groupBy("pair").agg(F.count("*").alias("n")).collect()
    found = {r.pair: r.n for r in counts}
    weight = min(1.0, full_weight / max(1, found.pop("", 0)))
    return LetterModel(counts={pair: n * weight for pair, n in found.items()})


def garbled(df: DataFrame, model: LetterModel, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """row_id: the rows that restored() gives, by the same steps but without restoring them."""
    source = df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            ids = [i for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if text and restore(text, model, find_only=True)[0]]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64())], names=["row_id"])

    return source.mapInArrow(run, "row_id bigint")


def restored(df: DataFrame, model: LetterModel, id_col: str = "row_id", text_col: str = "text") -> DataFrame:
    """row_id, restored: the rows of df whose text was decoded wrongly, with the text as far as it can be restored.

    Null and empty texts give no row; repeated rows give one each; other columns of df stay out. Row-local: no
    shuffle, and what is sent to the workers is a table of 34 x 34 numbers.
    """
    source = df.select(F.col(id_col).cast("bigint").alias("row_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        for b in batches:
            ids, texts = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text and (r := restore(text, model))[0]:
                    ids.append(i)
                    texts.append(r[1].encode("utf-8", "replace").decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["row_id", "restored"])

    return source.mapInArrow(run, "row_id bigint, restored string")
