import math
import random
import re
import unicodedata

import pytest

from morphlake.llm.encoding import COMMON_WORDS, LetterModel, fit_model, page_chars, restore, restored
from morphlake.llm.encoding import garbled as garbled_rows
from morphlake.llm.lookalike import look_alike_classes, look_alikes, skeleton, skeleton_of, with_skeleton

WORDS = [a + b + c for a in ("вуриги", "зяру", "чопе", "садидо", "мали", "тете") for b in ("буль", "зи", "ка", "ни", "фу") for c in ("вый", "ли", "ость", "ами", "ник", "ения")]


@pytest.fixture(scope="module")
def model():
    return LetterModel(WORDS)


def sentence(rng, n=9):
    return " ".join([rng.choice(WORDS) if rng.random() < 0.7 else rng.choice(["и", "в", "не", "на", "что"]) for _ in range(n)]).capitalize() + "."


def garbled(text, right, wrong):
    return "".join(page_chars(wrong)[b] for b in text.encode(right))


@pytest.mark.parametrize("right,wrong", [("utf-8", "cp1252"), ("utf-8", "cp1251"), ("utf-8", "koi8-r"), ("utf-8", "cp866"), ("utf-8", "mac-cyrillic"), ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866")])
def test_garbled_texts_come_back(model, right, wrong):
    rng = random.Random(right + wrong)
    whole = part = good = 0
    for _ in range(40):
        text = sentence(rng)
        found, back = restore(garbled(text, right, wrong), model)
        whole += found
        good += back == text
        w = text.split(" ")
        part += restore(" ".join([*w[:3], garbled(" ".join(w[3:7]), right, wrong), *w[7:]]), model)[0]
    assert whole == 40 and part >= 36 and good >= 20


def test_double_and_lossy(model):
    text = "Зяруналяости не было, и вуригибули."
    twice = garbled(garbled(text, "utf-8", "cp1252"), "utf-8", "cp1252")
    assert restore(twice, model) == (True, text)
    lossy = garbled(text, "utf-8", "cp1252").replace("Ð¾", "�", 1)
    assert restore(lossy, model)[0]


def test_every_stretch_comes_back(model):
    rng = random.Random(5)
    good = 0
    for _ in range(20):
        stretches = [sentence(rng, 6) for _ in range(16)]
        text = " ".join(stretches)
        bad = " ".join(garbled(t, "koi8-r", "cp1251") if i % 2 else t for i, t in enumerate(stretches))
        good += restore(bad, model) == (True, text)
    assert good >= 15
    layers = text = "Зяруналяости не было, и вуригибули."
    for _ in range(5):
        layers = garbled(layers, "utf-8", "cp1252")
    assert restore(layers, model) == (True, text)


@pytest.mark.parametrize("right", ["cp866", "mac-cyrillic"])
def test_pages_that_leave_control_characters(model, right):
    rng = random.Random(right)
    capitals = [rng.choice("БНПР") + sentence(rng)[1:] for _ in range(40)]
    bad = [garbled(t, right, "cp1252") for t in capitals]
    assert any(re.search("[\x80-\x9f]", t) for t in bad)
    assert sum(restore(b, model) == (True, t) for b, t in zip(bad, capitals)) >= 30


@pytest.mark.parametrize("right,wrong", [("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "cp1252")])
def test_two_kinds_of_stretch(model, right, wrong):
    rng = random.Random(right + wrong)
    good = 0
    for _ in range(40):
        a, b, c = (sentence(rng, 6) for _ in range(3))
        good += restore(" ".join([garbled(a, "utf-8", "cp1252"), b, garbled(c, right, wrong)]), model) == (True, f"{a} {b} {c}")
    assert good >= 30


@pytest.mark.parametrize("text", ["", "Садидокали — café, naïve garçon в Área.", "ВСЁ БОЛЬШИМИ БУКВАМИ, НЕ ТАК ЛИ?", "иНВЕРСИЯ РЕГИСТРА И ВСЁ ТУТ", "Їжак і ґанок", "Ђак ћа љубав", "Ðór Æsir и São João não, Été à Orléans", "НАЗВАНИЕ GARÇON И NAÏVE", "№ 5 «цитата» – да… 😀", "С… Сё Рё? В—Я «О» БЕРЁТ", "－ＡＢＣ　ｄｅｆ", "тАШУШУКИ МУШУЕНИЕ"])
def test_ordinary_texts_stay(model, text):
    assert restore(text, model) == (False, text)


def test_restored_rows(spark, model):
    bad = garbled("Зярузили чопениками", "utf-8", "cp1251")
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "просто текст", "x"), (4, bad, "x"), (4, bad, "x"), (5, bad * 3000, "x")], "row_id bigint, text string, restored string")
    got = restored(df, model).collect()
    assert sorted(r.row_id for r in got) == [4, 4, 5] and {r.restored for r in got if r.row_id == 4} == {"Зярузили чопениками"}
    assert sorted(r.row_id for r in garbled_rows(df, model).collect()) == [4, 4, 5]
    assert restored(df.limit(0), model).count() == 0 == garbled_rows(df.limit(0), model).count()
    lexicon = spark.createDataFrame([(w,) for w in [*WORDS, None, ""]], "word string")
    assert restore(bad, fit_model(lexicon))[0]


def test_model_counts_all_words(spark):
    odd = ["И", "яЁ", "Ёлка-Ель", "naïve", "в общем", "İjИ", "😀жж", "", None, "ж" * 5000]
    few = [*WORDS, *odd]
    assert fit_model(spark.createDataFrame([(w,) for w in few], "word string")).logp == LetterModel(w for w in few if w and len(w) > 1).logp
    many = [w + c for w in WORDS for c in ("", "ся", "сь", "те")] * 40 + ["щж" + w for w in WORDS]  # 28,980 words
    got = fit_model(spark.createDataFrame([(w,) for w in many], "word string").repartition(5))
    edges = {a: sum(w[0] == a for w in many) * 20_000 / len(many) + 20 * sum(w[0] == a for w in COMMON_WORDS) + 0.5 for a in "абвгдежзийклмнопрстуфхцчшщъыьэюяё"}
    assert all(got.logp[" " + a] == pytest.approx(math.log(n / (sum(edges.values()) + 0.5))) for a, n in edges.items())


def test_words_that_hash_last_count(spark):
    """A lexicon of more words than a sample of 20,000 has, of which those like the text's come last by hash."""
    rng = random.Random(8)
    like = lambda letters, n: spark.createDataFrame([("".join(rng.choice(letters) for _ in range(7)),) for _ in range(n)], "word string")
    lexicon = like("абвгде", 48_000).where("xxhash64(word) < 0").union(like("ноипрст", 9_000).where("xxhash64(word) > 0"))
    text = " ".join("".join(rng.choice("ноипрст") for _ in range(7)) for _ in range(8))
    df = spark.createDataFrame([(1, garbled(text, "koi8-r", "cp1251")), (2, text)], "row_id bigint, text string")
    model = fit_model(lexicon)
    assert [tuple(r) for r in restored(df, model).collect()] == [(1, text)] and [r.row_id for r in garbled_rows(df, model).collect()] == [1]


SAME = [("мама", "mama".replace("m", "м")), ("кот", "ко​т"), ("а б", "а б"), ("ABC 12", "ＡＢＣ　１２"), ("й", "й"), ("ё", "ё"), ("вο", "во"), ("сор", "cop"), ("да­", "да"), ("café", "café")]
OTHER = [("ё", "е"), ("й", "и"), ("№", "No"), ("«а»", '"а"'), ("а  б", "а б"), ("а\tб", "а б"), ("а\nб", "а б"), ("Кот", "кот"), ("1", "l"), ("3", "З"), ("0", "О")]


def test_skeletons():
    for a, b in SAME:
        assert skeleton(a) == skeleton(b) and a != b, (a, b)
    for a, b in OTHER:
        assert skeleton(a) != skeleton(b), (a, b)
    for t in ("Ёлка, мой ＡＢ", "é‍ x", "мама мыла раму"):
        assert skeleton(skeleton(t)) == skeleton(t)


def test_confusables_of_other_scripts(spark):
    form = skeleton_of(spark)
    for a, b in [("Ꭺ", "А"), ("օ", "о"), ("ո", "n"), ("ս", "u"), ("𝐚", "а"), ("𝖠", "А"), ("ᴄ", "с"), ("ꜱ", "s"), ("ӏ", "і"), ("Ӏ", "I"), ("ѵ", "v"), ("ѡ", "w"), ("ﬁ", "fi"), ("𝟗", "9"), ("Ꮋ", "Н"), ("ʜ", "н")]:
        assert form(a) == form(b), (a, b)
    for a, b in [*OTHER, ("r", "г"), ("n", "п"), ("b", "ь"), ("I", "l"), ("m", "rn"), ("ы", "ьі"), ("½", "1/2"), ("…", "..."), ("²", "2")]:
        assert form(a) != form(b), (a, b)
    for a, b in SAME:
        assert form(a) == form(b)
    assert len(form.table) > len(skeleton.table) + 300 and all(form(form(chr(c))) == form(chr(c)) for c in form.table)


def test_classes_of_look_alikes(spark):
    rows = [(1, "сор"), (2, "cop"), (3, "сор"), (4, "сoр"), (5, "другое"), (6, "другое"), (7, None), (8, "..."), (9, "кот"), (10, "ко\u200bт"), (2, "cop")]
    df = spark.createDataFrame(rows, "row_id bigint, text string").selectExpr("*", "0 as class_id", "0 as exact")
    got = sorted(tuple(r) for r in look_alike_classes(df).collect())
    assert got == [(1, 1, 1), (2, 1, 2), (3, 1, 1), (4, 1, 4), (9, 9, 9), (10, 9, 10)]
    assert look_alike_classes(df.limit(0)).count() == 0


def test_look_alikes_against_brute_force(spark):
    rng = random.Random(3)
    base = [sentence(rng, 4) for _ in range(30)]
    variants = [lambda t: t, lambda t: t.replace("а", "a", 1), lambda t: t.replace(" ", " "), lambda t: unicodedata.normalize("NFD", t), lambda t: t[:3] + "‍" + t[3:], lambda t: t.replace("о", "0")]
    rows = [(i, rng.choice(variants)(rng.choice(base)), 7) for i in range(150)] + [(200 + i, base[0], 7) for i in range(100)]  # copies of one text
    rows += [(400, None, 7), (401, "", 7), (402, "...", 7), (403, "…", 7), (404, ". . .", 7), (405, "я" * 200_000, 7), (406, "я" * 199_999 + "​я", 7)]
    df = spark.createDataFrame(rows, "row_id bigint, text string, skeleton int")
    want = {(a, b) for a, s, _ in rows for b, t, _ in rows if a < b and s and t and s != t and skeleton(s) == skeleton(t) and re.search(r"[^\W_]", skeleton(s))}
    assert {(r.row_a, r.row_b) for r in look_alikes(df).collect()} == want and (405, 406) in want
    assert look_alikes(df.limit(0)).count() == 0
    got = with_skeleton(df.where("row_id in (400, 401, 200)")).orderBy("row_id").collect()
    assert [r.skeleton for r in got] == [skeleton(base[0]), None, ""]


def test_finding_is_restoring(model):
    rng = random.Random(12)
    pages = ["cp1252", "cp1251", "koi8-r", "cp866", "mac-cyrillic"]
    seen = set()
    for _ in range(400):
        w = sentence(rng).split(" ")
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            a = rng.randrange(len(w))
            z = rng.randint(a + 1, len(w))
            try:
                w[a:z] = garbled(" ".join(w[a:z]), rng.choice(["utf-8", *pages[1:]]), rng.choice(pages)).split(" ")
            except UnicodeEncodeError:
                pass
        text = " ".join(w)
        assert restore(text, model, find_only=True)[0] == restore(text, model)[0], text
        seen.add(restore(text, model)[0])
    assert seen == {True, False}
