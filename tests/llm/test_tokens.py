import os
import random

import pytest

from ledgerloom.llm.tokens import TOKENIZER_DIR, WordEncoder, encode_corpus, token_counts

PATH = f"{TOKENIZER_DIR}/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary files")
r = random.Random(4)
TEXTS = ["", None, "Olá, mundo!  R$ 1.234,56\n", "<|endoftext|> é texto", "a" * 999, "ab" * 500, " " * 700, "\n\n \t x", "日本語 и русский 👍🏽", "".join(r.choice("abcde") for _ in range(2500)), "it's I'll", *["".join(chr(r.choice([r.randrange(32, 127), r.randrange(160, 600), r.randrange(0x4E00, 0x4F00)])) for _ in range(60)) for _ in range(60)]]


@pytest.fixture(scope="module")
def gold():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in TEXTS], add_special_tokens=False)]


def test_against_the_library(gold):
    assert WordEncoder(PATH).encode(TEXTS).to_pylist() == gold


def test_words_are_remembered(gold, monkeypatch):
    """Batches one after the other, with and without forgetting in between, give the same ids."""
    from ledgerloom.llm import tokens

    for most in (4_000_000, 100):
        monkeypatch.setattr(tokens, "REMEMBERED", most)
        e = WordEncoder(PATH)
        assert [ids for k in range(0, len(TEXTS), 7) for ids in e.encode(TEXTS[k : k + 7]).to_pylist()] == gold
        assert e.encode([None, ""]).to_pylist() == [[], []]


def test_corpus(spark, gold):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {x["doc_id"]: x["ids"] for x in encode_corpus(df, at_once=300).collect()}
    assert [got[i] for i in range(len(TEXTS))] == gold
    assert {x["doc_id"]: x["n_tokens"] for x in token_counts(df).collect()} == {i: len(g) for i, g in enumerate(gold)}
    assert encode_corpus(df.limit(0)).count() == 0
