import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from morphlake.functions.lexer import exploded, first_words, words
from morphlake.operators.lexicon import first_occurrences
from morphlake.schema import TokenType
from morphlake.sources.text import files, literal, source, token_rows, token_stream

R, E, N, P, S, L, U = 16, 4, 8, 32, 1, 2, 64
CASES = {
    "Привет, мир!": [("Привет", R), (",", P), (" ", S), ("мир", R), ("!", P)],
    "abc123где": [("abc", E), ("123", N), ("где", R)],
    "кое-кто": [("кое", R), ("-", P), ("кто", R)],
    "Ёлка ёж": [("Ёлка", R), (" ", S), ("ёж", R)],
    "café": [("caf", E), ("é", U)],
    "їжак": [("ї", U), ("жак", R)],
    "a b\t\r\n": [("a", E), (" ", S), ("b", E), ("\t", U), ("\r", U), ("\n", L)],
    "«№…»": [("«", P), ("№", P), ("…", P), ("»", P)],
    "😀😀": [("😀", U), ("😀", U)],
    "  ": [(" ", S), (" ", S)],
    "a\x00б": [("a", E), ("\x00", U), ("б", R)],
    "3.14": [("3", N), (".", P), ("14", N)],
    "ф" * 200: [("ф" * 200, R)],
    "": [],
}


def lexed(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    out = [[] for _ in texts]
    for r in sorted(exploded(df, **options).collect(), key=lambda r: (r.doc_id, r.pos)):
        out[r.doc_id].append((r.text, r.type))
        assert r.size == len(r.text)
    return out


def test_cases(spark):
    assert lexed(spark, list(CASES)) == list(CASES.values())


def test_filters(spark):
    basic = ["Привет, мир!"]
    assert [t for t, _ in lexed(spark, basic, mask=16)[0]] == ["Привет", "мир"]
    assert [t for t, _ in lexed(spark, basic, mask=48)[0]] == ["Привет", ",", "мир", "!"]
    assert [t for t, _ in lexed(spark, basic, mask=16, least=4)[0]] == ["Привет"]
    assert [t for t, _ in lexed(spark, basic, drop_last=True)[0]][-1] == "мир"
    assert lexed(spark, ["Кот"], drop_last=True) == [[]]
    assert int(TokenType.RUWORD | TokenType.PNCTTN) == 48


def test_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "да", 6)], "pos int, text string, size int")
    assert [(r.pos, r.text, r.size) for r in exploded(df).collect()] == [(0, "да", 2)]
    assert exploded(df.limit(0)).count() == 0


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("абвЯЁё abcZ09-.,«»№…\n\t éїx😀"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=20))
def test_tokens_spell_the_text(spark, texts):
    texts = [t.replace("\x00", "") for t in texts]
    for text, tokens in zip(texts, lexed(spark, texts), strict=True):
        assert "".join(t for t, _ in tokens) == text
        for (_, a), (_, b) in zip(tokens, tokens[1:]):
            assert a != b or a not in (4, 8, 16)


def test_words(spark):
    df = spark.createDataFrame([(1, "Кот, КОТ и abc " + "ж" * 65)], "doc_id int, text string")
    assert [(r.pos, r.word) for r in words(df).orderBy("pos").collect()] == [(0, "кот"), (1, "кот"), (2, "и"), (3, "ж" * 65)]
    assert [(r.pos, r.word) for r in words(df, most=64).orderBy("pos").collect()] == [(0, "кот"), (1, "кот"), (2, "и")]
    long = spark.createDataFrame([("a" * 5000 + " " + "ж" * 5000,)], "text string")
    assert sorted(r.size for r in exploded(long).collect()) == [1, 5000, 5000] and exploded(long, most=512).count() == 1


def test_sources(spark, tmp_path):
    with pytest.raises(TypeError):
        literal(spark, 5)
    with pytest.raises(ValueError):
        literal(spark, "  ")
    with pytest.raises(FileNotFoundError):
        files(spark, str(tmp_path / "none.txt"))
    p = tmp_path / "a.txt"
    p.write_bytes("Кот\nпёс ".encode() + b"\xff\xfe x")
    assert source(spark, str(p)).first().text.startswith("Кот\nпёс ")
    got = token_rows(spark, str(p), mask=16, lower=True)
    assert [r.text for r in got.orderBy("pos").collect()] == ["кот", "пёс"]
    batches = list(token_stream(token_rows(spark, "а б в г д", mask=16), 2))
    assert [b["text"] for b in batches] == [["а", "б"], ["в", "г"], ["д"]] and batches[0]["types"] == [16, 16]


def test_sql_functions(spark):
    from morphlake.functions.sqlfuncs import register

    register(spark)
    assert spark.sql("select tokens('a б7') t, ru_words('Кот x Пёс') w, token_type('№') k").first() == (["a", " ", "б", "7"], ["кот", "пёс"], 32)
    rows = spark.sql("select d.i, t.* from values (1, 'да!'), (2, null) d(i, s), lateral tokenize_text(d.s) t").collect()
    assert [(r.i, r.pos, r.token, r.type) for r in rows] == [(1, 0, "да", 16), (1, 1, "!", 32)]
    assert re.match("x", "x")


def test_first_words(spark):
    df = spark.createDataFrame([(2, "кот Кот дом"), (1, "лес дом кот лес"), (3, None), (4, ""), (5, "x")], "doc_id bigint, text string").selectExpr("*", "0 as word", "0 as pos")
    assert sorted((r.doc_id, r.pos, r.word) for r in first_words(df).collect()) == [(1, 0, "лес"), (1, 1, "дом"), (1, 2, "кот"), (2, 0, "кот"), (2, 2, "дом")]
    first = first_occurrences(df)
    assert sorted((r.word, r.doc_id, r.pos) for r in first.collect()) == [("дом", 1, 1), ("кот", 1, 2), ("лес", 1, 0)]
    assert first.columns == ["word", "doc_id", "pos"] and first_occurrences(df.limit(0)).count() == 0
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
