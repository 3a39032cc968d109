from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, n_words string, id int"


def odd_texts() -> list:
    """Texts that break careless code."""
    rng = random.Random(4)
    passage = " ".join(f"w{k}" for k in range(60))
    out = [None, "", " ", "\n\n", "a", "one two", "  lead and trail  ", "tab\tand\x0bvt\x0cff\rcr\n", "x" * 5000, "é漢😀 ñ nbsp em \x1c sep", "UPPER lower ÉÀ", "<|endoftext|> <s> </s> ▁x"]
    out += [passage, passage, f"start {passage} end", f"other {passage}\n{passage}", "same line\nsame line\nsame line", "the the the the the the the the the the the the"]
    out += [" ".join(rng.choice("ab cd ef".split()) for _ in range(rng.randint(0, 90))) for _ in range(30)]
    out += [" ".join(rng.choice(["alpha", "beta", "gamma", "delta!!", "#%", "12"]) for _ in range(40)) for _ in range(10)]
    out += [" ".join(f"{rng.randint(0, 999)}" for _ in range(20_000))]
    return out


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with repeated rows and ids, null ids, and columns whose names clash with the operators' own."""
    texts = odd_texts()
    rows = [(k, t, "en" if k % 3 else None, "mine", k if k % 4 else None) for k, t in enumerate(texts)]
    rows += [(12, texts[12], None, None, None), (12, texts[13], None, None, 1), (None, texts[14], "x", "y", 2), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def word_bpe():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def piece_bpe():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def pairs(df, text="text"):
    return [(r.doc_id, r[text]) for r in df.select("doc_id", text).collect()]


def words(text) -> list[bytes]:
    return (text or "").encode().split()


def key(x):
    return tuple((v is not None, v) for v in x)
