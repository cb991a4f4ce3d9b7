import os

import pytest

from ledgerloom.llm.mixing import mix, pfair_slots, quotas, sized_offsets, whole_slots
from ledgerloom.llm.tokens import TOKENIZER_DIR


def test_quotas():
    q = quotas(100, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 20, "b": 1000, "c": 1000})
    assert q["a"] == 20 and round(q["b"]) == 48 and round(q["c"]) == 32
    assert quotas(100, {"a": 0.5, "b": 0.5}, {"a": 10, "b": 20}) == {"a": 10, "b": 20}
    assert quotas(0, {"a": 1.0}, {"a": 0}) == {"a": 0} and quotas(5, {}, {}) == {}


@pytest.mark.parametrize("w", [{"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.97, "b": 0.02, "c": 0.01}, {"a": 1 / 3, "b": 1 / 3, "c": 1 / 3}, {"a": 7, "b": 0}])
def test_slots_stay_within_a_block(w):
    n, ran = 1000, dict.fromkeys(w, 0)
    total = sum(w.values())
    for i, (s, k, slot) in enumerate(pfair_slots(w, n)):
        assert slot == i and k == ran[s]
        ran[s] += 1
        assert all(abs(ran[x] - w[x] / total * (i + 1)) < 1 + 1e-6 for x in w)


def test_offsets(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b", i % 5 + 1) for i in range(50)], "doc_id long, source string, n long")
    for g, total in (("a", sum(i % 5 + 1 for i in range(50) if i % 3)), ("b", sum(i % 5 + 1 for i in range(50) if not i % 3))):
        rows = sorted((x["start"], x["n"]) for x in sized_offsets(df, "source", "doc_id", "n", 7).filter(f"source = '{g}'").collect())
        at = 0
        for s, n in rows:
            assert s == at
            at += n
        assert at == total


@pytest.mark.skipif(not os.path.exists(f"{TOKENIZER_DIR}/byte_bpe_50k.json"), reason="no vocabulary files")
def test_mix(spark):
    docs = [(i, "big", "palavra " * 20, 0) for i in range(200)] + [(300 + i, "small", "nota fiscal " * 5, 0) for i in range(10)] + [(400, None, "x", 0), (401, "big", None, 0), (402, "big", "", 0), (403, "other", "x", 0)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, slot int")
    target = spark.createDataFrame([("big", 0.5, 1, 9), ("small", 0.5, 3, 9), ("none", 0.1, 2, 9)], "source string, target_share double, max_repeats int, block int")
    rec, sh = mix(df, target)
    s = {x["source"]: x for x in sh.collect()}
    small = [x for x in rec.collect() if x["source"] == "small"]
    assert s["none"]["tokens"] == 0 and s["small"]["times"] == 3 and len(small) == 30 and {x["repeat"] for x in small} == {1, 2, 3}
    assert abs(s["big"]["actual_share"] + s["small"]["actual_share"] - 1) < 1e-9 and s["big"]["times"] == 1
    assert not {400, 401, 402, 403} & {x["doc_id"] for x in rec.collect()}
    # a total within reach gives the shares asked for
    rec, sh = mix(df, target.filter("source <> 'none'"), total=500)
    assert all(abs(x["actual_share"] - 0.5) < 0.06 for x in sh.collect())
    rec, sh = mix(df.limit(0), target)
    assert rec.count() == 0 and sorted(x["tokens"] for x in sh.collect()) == [0, 0, 0]


def test_every_source_has_a_slot():
    w = {"a": 0.9, "b": 0.0996, "c": 0.0003, "d": 0.0001, "e": 0.0}
    slots = whole_slots(w, 100)
    assert [x[2] for x in slots] == list(range(102)) and {x[0] for x in slots} == {"a", "b", "c", "d"}
    for s in w:
        assert [k for x, k, _ in slots if x == s] == list(range(sum(x == s for x, _, _ in slots)))
    assert whole_slots({"a": 0.5, "b": 0.5}, 10) == pfair_slots({"a": 0.5, "b": 0.5}, 10)


@pytest.mark.skipif(not os.path.exists(f"{TOKENIZER_DIR}/byte_bpe_50k.json"), reason="no vocabulary files")
@pytest.mark.parametrize("blocks", [4096, 10])
def test_mix_keeps_sources_below_a_block(spark, blocks):
    """One long text, and a source of less than a block: all records within its quota are in the mix."""
    docs = [(0, "big", "palavra " * 2000), *[(i, "big", "palavra " * 20) for i in range(1, 100)], *[(1000 + i, "tiny", "nota") for i in range(5)]]
    target = spark.createDataFrame([("big", 1.0, 1), ("tiny", 1.0, 1)], "source string, target_share double, max_repeats int")
    rec, sh = mix(spark.createDataFrame(docs, "doc_id long, source string, text string"), target, blocks=blocks)
    got = rec.collect()
    assert sorted(x["doc_id"] for x in got) == sorted(x[0] for x in docs)
    s = {x["source"]: x for x in sh.collect()}
    assert s["tiny"]["records"] == 5 and s["tiny"]["tokens"] == s["tiny"]["available_tokens"]
    assert len({x["slot"] for x in got if x["source"] == "big"} & {x["slot"] for x in got if x["source"] == "tiny"}) == 0
