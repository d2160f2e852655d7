import random

import pytest
from pyspark.sql import functions as F

from morphlake.functions.decode import exact_round, segments, segments_by_window, tag_columns, word_confidence
from morphlake.functions.encode import best, decoded, encoded, label_parts, padded
from morphlake.schema import CHARS, LABELS

CASES = [
    ("башня", "B-ROOT I-ROOT E-ROOT S-SUFF S-END", [1, 0.5, 0.75, 0.5, 1], [("баш", 3, 0.75), ("н", 4, 0.5), ("я", 5, 1.0)], False),
    ("да", "E-ROOT S-END", [0.5, 1], [("д", 3, 0.5), ("а", 5, 1.0)], True),
    ("да", "I-PREF S-END", [0.5, 1], [("д", 2, 0.5), ("а", 5, 1.0)], True),
    ("дом", "B-ROOT B-SUFF E-SUFF", [1, 0.5, 1], [("д", 3, 1.0), ("ом", 4, 0.75)], True),
    ("дом", "B-ROOT S-SUFF S-END", [1, 0.5, 1], [("д", 3, 1.0), ("о", 4, 0.5), ("м", 5, 1.0)], True),
    ("кот", "B-ROOT I-ROOT I-ROOT", [1, 0.5, 0.75], [("кот", 3, 0.75)], True),
    ("кот", "B-ROOT I-SUFF E-END", [1, 0.5, 0.75], [("кот", 3, 0.75)], False),
    ("кот", "B-ROOT <PAD> E-ROOT", [1, 0.25, 0.5], [("кт", 3, 0.75)], False),
    ("да", "<PAD> <PAD>", [1, 1], [], False),
    ("да", "NONE S-END", [0.5, 1], [("д", 3, 0.5), ("а", 5, 1.0)], False),
    ("кот", "B-ROOT E-ROOT", [1, 0.5], [("ко", 3, 0.75)], False),
    ("", "", [], [], False),
]


def test_cases(spark):
    rows = [(i, w, tags.split(), [float(x) for x in confs]) for i, (w, tags, confs, *_) in enumerate(CASES)] + [(99, None, ["S-END"], [1.0])]
    df = spark.createDataFrame(rows, "i int, word string, labels array<string>, confs array<double>")
    got = {r.i: r for r in df.select("i", segments(F.col("word"), tag_columns(F.col("labels"), True), F.col("confs")).alias("d"), word_confidence(F.col("word"), F.col("confs")).alias("c")).collect()}
    for i, (_, _, _, want, repaired) in enumerate(CASES):
        assert [tuple(m) for m in got[i].d.morphemes] == want and got[i].d.repaired == repaired, i
    assert got[7].c == 1.75 / 3 and got[99].d is None and got[11].c is None


def fold(word, tags, confs, repair):
    """The table of states, said again in Python."""
    parts = label_parts()
    segs, cur, kind, held, bad = [], "", -1, [], False
    for ch, tag, f in zip(word, tags, confs, strict=False):
        p, t = parts.get(tag, ("S", 3))
        if repair and p in "IE" and not cur:
            bad = True
            segs.append((ch, t, f))
        elif p == "B":
            if cur:
                bad = True
                segs.append((cur, kind, sum(held) / len(held)))
            cur, kind, held = ch, t, [f]
        elif p == "I":
            cur, held = cur + ch, [*held, f]
        elif p == "E":
            held = [*held, f]
            segs.append((cur + ch, kind, sum(held) / len(held)))
            cur, held = "", []
        elif p == "S":
            if cur:
                bad = True
                segs.append((cur, kind, sum(held) / len(held)))
                cur = ""
            segs.append((ch, t, f))
    if cur:
        bad = bad or repair
        segs.append((cur, kind, sum(held) / len(held)))
    return segs, bad


@pytest.mark.parametrize("repair", [True, False])
def test_fold_against_python(spark, repair):
    rng = random.Random(7)
    rows = []
    for i in range(400):
        n = rng.randint(1, 9)
        word = "".join(rng.choice("абвгд") for _ in range(n))
        rows.append((i, word, [rng.choice([*LABELS.values(), 99]) for _ in range(rng.choice([n, n + 2, n - 1]))], [rng.randint(0, 64) / 64 for _ in range(n)]))
    df = spark.createDataFrame(rows, "i int, word string, tags array<int>, confs array<double>")
    got = {r.i: r.d for r in df.select("i", segments(F.col("word"), tag_columns(F.col("tags")), F.col("confs"), repair).alias("d")).collect()}
    for i, w, tags, confs in rows:
        want, bad = fold(w, tags, confs, repair)
        assert [(m.text, m.type_id) for m in got[i].morphemes] == [x[:2] for x in want] and got[i].repaired == bad, (w, tags)
        assert [m.confidence for m in got[i].morphemes] == pytest.approx([x[2] for x in want])


def test_window_form(spark):
    rows = [(i, k, ch, *label_parts()[LABELS.get(t, 9)], float(c)) for i, (w, tags, confs, *_) in enumerate(CASES[:10]) for k, (ch, t, c) in enumerate(zip(w, tags.split(), confs))]
    df = spark.createDataFrame(rows, "i int, pos int, ch string, prefix string, type_id int, conf double")
    got = {}
    for r in segments_by_window(df, "i").orderBy("i", "seg").collect():
        got.setdefault(r.i, []).append((r.text, r.type_id, r.confidence))
    for i, (_, _, _, want, _) in enumerate(CASES[:10]):
        assert got.get(i, []) == want


def test_encoding(spark):
    df = spark.createDataFrame([("дом",), ("ёж",), ("Дом",), ("a1 -",), ("я" * 70,), ("",), (None,)], "w string")
    ids = [r[0] for r in df.select(encoded("w", most=64)).collect()]
    assert ids[:4] == [[8, 19, 17], [10, 11], [1, 19, 17], [1, 38, 47, 48]] and len(ids[4]) == 64 and ids[5] == [] and ids[6] is None
    assert df.select(encoded("w", lower=True)).collect()[2][0] == [8, 19, 17]
    assert [r[0] for r in df.limit(2).select(padded(encoded("w"), 3)).collect()] == [[8, 19, 17], [10, 11, 0]]
    d = spark.createDataFrame([([8, 19, 17, 0, 0],), ([1, 8, 0],), ([99, 8],)], "i array<int>")
    assert [r[0] for r in d.select(decoded(F.col("i"))).collect()] == ["дом", "<UNK>д", "д"]
    s = spark.createDataFrame([([[0.5, 0.5, 0.1], [0.0, 0.2, 0.9]],)], "s array<array<double>>")
    assert s.select(*best(F.col("s"))).first() == ([0, 2], [0.5, 0.9])
    assert CHARS["а"] == 4 and CHARS["я"] == 36 and CHARS["-"] == 48 and len(CHARS) == 49 and LABELS["S-LINK"] == 25 and len(LABELS) == 27


def test_rounding_is_exact(spark):
    df = spark.createDataFrame([(0.84995,), (0.00015,), (None,)], "x double")
    assert [r[0] for r in df.select(exact_round(F.col("x"))).collect()] == [0.8499, 0.0001, None]


def test_rounding_is_that_of_the_exact_value(spark):
    rng = random.Random(11)
    values = [rng.random() for _ in range(3000)] + [rng.randint(0, 20000) / 20000 for _ in range(3000)] + [rng.randint(-64 * 65, 64 * 65) / (64 * rng.randint(1, 64)) for _ in range(3000)]
    values += [k / 32 for k in range(-64, 65)] + [0.00045, 0.84995, 1e-300, 5e15, -7.5e11, 123456.00005, 0.0, -0.0, 0.99995, float("inf")]
    df = spark.createDataFrame([(float(v),) for v in values], "x double").select("x", exact_round(F.col("x")).alias("y"), exact_round(F.col("x"), 2).alias("z"))
    for r in df.collect():
        if r.x != float("inf"):
            assert r.y == round(r.x, 4) and r.z == round(r.x, 2), r
    with pytest.raises(ValueError):
        exact_round(F.col("x"), 8)
