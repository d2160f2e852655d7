import os
import random

import numpy as np
import pytest

from morphlake.llm.mixing import RANKS, RANKS_SETTING, Tokenizer, draw, materialized, mixture, packed, permuted, ranks_of, shares, sized

pytestmark = pytest.mark.skipif(not os.path.exists(RANKS), reason="no tokenizer files")


def test_counts_are_the_tokenizers():
    tok = Tokenizer()
    for t in ("", "The cat's 12 dogs!!  \n\n x", "Привет, мир  ", "旧到小了 ok", "a" * 5000, "<|endoftext|>"):
        assert tok.count(t) == len(tok.encoding.encode_ordinary(t)) == tok.count(t)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1000, 4097])
def test_permutations(n):
    for key in (1, 99):
        assert sorted(permuted(np.arange(n), n, key)) == list(range(n))
    if n > 100:
        assert list(permuted(np.arange(n), n, 1)) != list(permuted(np.arange(n), n, 2)) and list(permuted(np.arange(n), n, 1)) != list(range(n))


def test_draws_keep_to_capacity():
    counts = draw([1, 1, 2], [500, 5000, 5000], [2, 1, 1], 100, 1)
    total = counts.sum(axis=0)
    assert total[0] <= 1000 and total[1] <= 5000 and total[2] <= 5000 and counts.sum() > 3300
    assert abs(total[2] / total.sum() - 0.5) < 0.05 and counts.sum(axis=1).max() <= 101
    assert draw([1, 1], [1, 1], [1, 1], 10, 1).sum() <= 2
    assert draw([1, 1], [0, 5], [1, 1], 10, 1).sum() == 0


def test_another_vocabulary(spark):
    assert ranks_of(spark) == RANKS
    spark.conf.set(RANKS_SETTING, "/else/where")
    try:
        assert ranks_of(spark) == "/else/where"
    finally:
        spark.conf.unset(RANKS_SETTING)


def test_mixture(spark):
    rng = random.Random(1)
    docs = []
    for i in range(900):
        source = rng.choice(["Big ", "big", "big", "small", "unwanted", None])
        docs.append((i, source, None if i % 97 == 0 else " ".join(rng.choice(["pump", "valve", "окно", "the"]) for _ in range(rng.randint(0, 90))), 5))
    df = spark.createDataFrame(docs, "doc_id bigint, source string, text string, n_tokens int")
    targets = spark.createDataFrame([("big", 30.0, 1), ("SMALL", 20.0, 3), ("absent", 5.0, 1), ("zero", 0.0, 1), (None, 1.0, 1)], "source string, weight double, max_repeat int")
    sizes = sized(df, targets).cache()
    assert {r.source for r in sizes.collect()} == {"big", "small"}
    blocks = packed(sizes, block_tokens=64, group_docs=100).cache()
    spans = {}
    for r in blocks.collect():
        assert r.n_tokens == sum(s.n for s in r.spans) and 0 < r.n_tokens <= 64
        for s in r.spans:
            spans.setdefault(s.doc_id, []).append((s.first, s.n))
    for r in sizes.collect():  # every token of every document lies in one block
        at = 0
        for first, n in sorted(spans.get(r.doc_id, [])):
            assert first == at
            at += n
        assert at == r.n_tokens
    for s in ("big", "small"):
        numbers = sorted(r.block for r in blocks.where(f"source = '{s}'").collect())
        assert numbers == list(range(len(numbers)))
        short = [r.block for r in blocks.where(f"source = '{s}' and n_tokens < 64").collect()]
        assert short in ([], [len(numbers) - 1])  # only the last, though the source is packed in several groups
    mixed = mixture(blocks, targets, shard_slots=50, seed=3).cache()
    uses = {(r.source, r.block): r["count"] for r in mixed.groupBy("source", "block").count().collect()}
    assert max(n for (s, _), n in uses.items() if s == "big") == 1 and max(n for (s, _), n in uses.items() if s == "small") <= 3
    got = {r.source: r for r in shares(mixed, blocks, targets).collect()}
    assert abs(got["big"].actual_share - 0.6) < 0.08 and got["absent"].tokens == 0 and got["small"].most_uses <= 3 and abs(sum(r.target_share for r in got.values()) - 1) < 1e-9
    assert mixed.exceptAll(mixture(blocks, targets, shard_slots=50, seed=3)).count() == 0  # the same again
    one = materialized(mixed.limit(5), df).collect()
    assert all(0 < len(r.tokens) <= 64 for r in one) and len(one) == 5
    assert mixture(blocks.limit(0), targets).count() == 0 and packed(sizes.limit(0)).count() == 0
