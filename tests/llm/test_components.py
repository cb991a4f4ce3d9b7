import random

import pytest

from ledgerloom.llm.components import connected_groups


def brute(pairs):
    lab = {}

    def find(v):
        lab.setdefault(v, v)
        while lab[v] != v:
            v = lab[v]
        return v

    for a, b in pairs:
        if a is not None and b is not None:
            p, q = find(a), find(b)
            lab[max(p, q)] = min(p, q)
    return sorted((v, find(v)) for v in lab)


def run(spark, pairs, **extra):
    df = spark.createDataFrame([(a, b, 0, 0, 0) for a, b in pairs], "a long, b long, v long, p long, x long")
    return sorted(map(tuple, connected_groups(df, "a", "b").collect()))


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_with_hub_and_repeats(spark, seed):
    r = random.Random(seed)
    pairs = [(r.randrange(80), r.randrange(80)) for _ in range(50)] + [(500, k) for k in range(600, 660)] * 2
    assert run(spark, pairs) == brute(pairs)


def test_long_chain_in_mixed_order(spark):
    ids = list(range(1000, 1300))
    random.Random(1).shuffle(ids)
    pairs = list(zip(ids, ids[1:]))
    assert run(spark, pairs) == brute(pairs)


def test_nulls_self_pairs_and_empty(spark):
    pairs = [(None, 1), (2, None), (None, None), (3, 3), (5, 4), (4, 5)]
    assert run(spark, pairs) == [(3, 3), (4, 4), (5, 4)]
    assert run(spark, []) == []
