import random

import pytest
from pyspark.sql import functions as F

from morphlake.llm.history import SORTED_BUCKETS, SuffixIndex, parsed, repeated_texts, repeated_words, suffixes, words_of
from morphlake.operators.shared import set_for


VOCABULARY = ["".join(random.Random(i).choice("абвгдежзиклмнопрстуфхцчшя") for _ in range(random.Random(i).randint(3, 11))) for i in range(4000)]
COMMON = "и в не на что с как по это из к но от за для".split()


def corpus(n=700, seed=1):
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        if texts and rng.random() < 0.35:
            w = rng.choice(texts).split()
            for _ in range(rng.choice([0, 1, 2, 4, 8])):
                w = w or ["пусто"]
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [rng.choice(VOCABULARY)], [w[k], rng.choice(VOCABULARY)]])
            if rng.random() < 0.3:
                rng.shuffle(w)
            texts.append(" ".join(w) or "пусто")
        else:
            texts.append(" ".join(rng.choice(COMMON) if rng.random() < 0.35 else rng.choice(VOCABULARY) for _ in range(rng.choice([1, 2, 3, 8, 20, 35, 60]))))
    return texts


def brute(rows, first_new, t=0.7):
    sets = [(i, frozenset(words_of(x))) for i, x in sorted(rows, key=lambda r: r[0]) if x]
    return {i for k, (i, a) in enumerate(sets) if i >= first_new and a and any(b and len(a & b) >= t * len(a | b) - 1e-9 for _, b in sets[:k])}


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_id bigint, text string")


def answer(spark, rows, first_new, arrivals=1, **options):
    df = frame(spark, rows)
    index = SuffixIndex(spark, **options)
    old = [df.where(f"row_id < {first_new} and pmod(row_id, {arrivals}) = {k}") for k in range(arrivals)]
    got = [r.row_id for r in repeated_texts(old, df.where(f"row_id >= {first_new}"), None, index=index).collect()]
    assert len(got) == len(set(got))
    return set(got), index


@pytest.mark.parametrize("leads", [8, 1])
def test_texts_against_brute_force(spark, leads):
    rows = list(enumerate(corpus()))
    rows += [(900 + i, rows[0][1].upper()) for i in range(200)]  # a large group of copies
    rows += [(2000, None), (2001, ""), (2002, "... !"), (2004, rows[3][1].replace("а", "a")), (2005, "ё е"), (2006, "е")]
    got, index = answer(spark, rows, 500, 3, leads=leads)
    assert got == brute(rows, 500) and {2004, 2006, 999} <= got
    assert [s["level"] for s in index.segments] == [1, 0, 0]  # three arrivals and the batch itself


def test_empty_tables(spark):
    df = frame(spark, [(1, "раз два три")])
    assert repeated_texts([], df.limit(0), None).count() == 0
    assert repeated_texts([df.limit(0)], df, None).count() == 0
    assert repeated_texts([df], df.limit(0), None).count() == 0
    assert [r.row_id for r in repeated_texts([df], frame(spark, [(2, "три, два. Раз")]), None).collect()] == [2]


def test_columns_that_clash(spark):
    df = frame(spark, [(1, "раз два три"), (2, "раз два три")]).withColumns({c: F.lit(1) for c in ("key", "words", "cls", "n", "lead", "q", "c")})
    assert [r.row_id for r in repeated_texts([df.where("row_id = 1")], df.where("row_id = 2"), None).collect()] == [2]


def test_added_words_that_alternate_with_the_first(spark):
    for k in range(6):  # exactly 0.7, whatever the order of the words is
        rng = random.Random(k)
        base, added = rng.sample(VOCABULARY, 14), rng.sample(VOCABULARY[::-1], 6)
        rows = [(1, " ".join(base)), (2, " ".join(base + added))]
        assert answer(spark, rows, 2)[0] == brute(rows, 2) == {2}


def test_words_of_one_checksum_are_two(spark):
    rows = [(1, "уваязлэп"), (2, "здвфргми"), (3, "Уваязлэп!")]
    assert answer(spark, rows, 2)[0] == {3}


def test_very_long_texts(spark):
    words = [f"слово{i}" for i in range(70_000)]
    rows = [(1, " ".join(words[:65_000])), (2, " ".join(words)), (3, " ".join(words[:40_000])), (4, " ".join(words[:39_000]))]
    assert answer(spark, rows, 2)[0] == brute(rows, 2) == {2, 4}


def test_two_batches_without_reading_the_first_again(spark, tmp_path):
    rows = list(enumerate(corpus(500, 5)))
    path, got, df = f"file://{tmp_path}/index", set(), frame(spark, rows)
    for a, z in ((0, 200), (200, 300), (300, 400), (400, 500)):  # each by another run, which has only the folder
        index = SuffixIndex(spark, path)
        got |= {r.row_id for r in index.take_in(parsed(df.where(f"row_id >= {a} and row_id < {z}"), None)).collect()}
    assert got == brute(rows, 0)
    again = SuffixIndex(spark, path)
    assert [s["level"] for s in again.segments] == [1, 0, 0] and again.segments == index.segments and again.frequent
    assert sorted(p.name.split("-")[0] for p in (tmp_path / "index").iterdir() if p.is_dir()) == sorted(["digests", "suffixes", "words"] * 3)  # merged ones are gone
    assert again.take_in(parsed(df.limit(0), None)).count() == 0 and [s["level"] for s in again.segments] == [2, 0]  # merged as the next batch comes
    with pytest.raises(ValueError):
        SuffixIndex(spark, path, similarity=0.68)


def test_history_is_not_shuffled(spark):
    df = frame(spark, list(enumerate(corpus(400, 3))))
    index = SuffixIndex(spark)
    index.take_in(parsed(df.where("row_id < 300"), None), answer=False)
    own = {"suffixes": index.segments[0]["suffixes"]}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        with set_for(spark, {SORTED_BUCKETS: "true"}):
            pairs = index._pairs(index._lookups(own)[0], index._table(index.segments[0], "suffixes").where("lead"))
            plan = pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "SortMergeJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # that of the pairs found
    assert plan.count("Sort [") == 0, plan


@pytest.mark.parametrize("arrivals", [1, 4])
def test_hot_keys_against_brute_force(spark, arrivals):
    rng = random.Random(2)
    stock = [f"общее{i}" for i in range(30)]
    rows = [(i, " ".join([*stock, *rng.sample(VOCABULARY, rng.choice([2, 5, 20]))])) for i in range(400)]
    rows += [(i, " ".join(rng.sample(VOCABULARY[:300], 12))) for i in range(400, 500)]
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got, index = answer(spark, rows, 400, arrivals, hot=40, leads=2)
    assert got == brute(rows, 400) and got and index.hot
    held = spark.read.parquet(*[s["suffixes"][0] for s in index.segments])
    assert held.where("base is not null").count() > 1000
    # again in batches of 50, whose pairs become hot at a merge only
    df, later = frame(spark, rows), SuffixIndex(spark, hot=90, leads=2)
    for k in range(8):
        later.take_in(parsed(df.where(f"row_id < 400 and row_id % 8 = {k}"), None), answer=False)
    assert later.hot
    again = later.take_in(parsed(df.where("row_id >= 400"), None))
    assert {r.row_id for r in again.collect()} == got


def test_boilerplate_is_not_paired_out(spark):
    rng = random.Random(9)
    stock = [f"общее{i}" for i in range(20)]
    rows = [(i, " ".join([*stock, *(f"x{rng.randrange(10**9)}" for _ in range(20))])) for i in range(600)]
    df, index = frame(spark, rows), SuffixIndex(spark, hot=50)
    index.take_in(parsed(df.where("row_id < 300"), None), answer=False)
    assert index.take_in(parsed(df.where("row_id >= 300"), None)).count() == 0 and index.hot
    pairs = index._pairs(index._lookups(index.segments[1])[0], index._table(index.segments[0], "suffixes"))
    assert pairs.count() == 0  # not 90,000
    free = SuffixIndex(spark, hot=10**9)
    free.take_in(parsed(df.where("row_id < 300"), None), answer=False)
    free.take_in(parsed(df.where("row_id >= 300"), None), answer=False)
    assert free._pairs(free._lookups(free.segments[1])[0], free._table(free.segments[0], "suffixes")).count() > 5_000


def test_records_that_are_all_alike_are_not_paired_out(spark):
    rng = random.Random(10)
    stock = rng.sample(VOCABULARY, 30)
    rows = [(i, " ".join([*stock[:28], f"a{i}", f"b{i}"])) for i in range(500)]
    df, index = frame(spark, rows), SuffixIndex(spark)
    index.take_in(parsed(df.where("row_id < 250"), None), answer=False)
    assert index.take_in(parsed(df.where("row_id >= 250"), None)).count() == 250
    pairs = index._pairs(index._lookups(index.segments[1])[0], index._table(index.segments[0], "suffixes").where("lead"))
    assert pairs.count() <= 250 * 30 * index.leads / 2 < 250 * 250


def test_places_and_order(spark):
    df = spark.createDataFrame([(1, ["а", "б", "в", "г", "д", "е", "ж", "з", "и", "к"]), (2, ["а"])], "row_id bigint, words array<string>")
    rows = suffixes(df, [], 0.7).collect()
    assert sorted(r["at"] for r in rows) == list(range(7)) and {r.n for r in rows} == {10} and len({r["key"] for r in rows}) == 7
    with pytest.raises(ValueError):
        SuffixIndex(spark, similarity=0.5)


def test_words(spark):
    df = spark.createDataFrame([(1, "accepted", "ёлка"), (2, "new", " Елка "), (3, "new", "кот"), (4, "new", "ко­т"), (5, "new", None), (6, "new", "  "), (7, "new", "-"), (8, "new", "по-над"), (9, "new", "Слово"), (10, "new", "понад"), (11, None, "дуб"), (12, "new", "дуб")], "row_id bigint, stage string, word string")
    seen = spark.createDataFrame([("сло́во", 1), (None, 1)], "word string, key int")
    assert sorted(r.row_id for r in repeated_words(df, seen).collect()) == [2, 4, 9, 10, 12]
    assert repeated_words(df.limit(0), seen.limit(0)).count() == 0
