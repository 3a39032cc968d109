"""Operators 1, 2, 7: token counts, language scores, pieces."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from frameloom.llm import automaton as A
from frameloom.llm import lmscore as L
from frameloom.llm import pieces as P

from .conftest import key, odd_texts, pairs, words


def greedy(word, vocabulary):
    n = at = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return -1
        at, n = end, n + 1
    return n


def test_automaton_is_greedy_longest_match():
    rng = random.Random(1)
    for _ in range(150):
        vocabulary = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12))}
        some = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(30)]
        assert A.Automaton(sorted(vocabulary)).counts(some).tolist() == [greedy(w, vocabulary) for w in some]


def test_remembered_words_change_nothing(piece_bpe):
    import pyarrow as pa

    own, rng = A.automaton(piece_bpe), np.random.default_rng(3)
    pool = ["".join(rng.choice(list("abcdeé😀z"), rng.integers(1, 9))) for _ in range(400)]
    for most in (0, 1, 50, 1 << 18):
        known = A.Known(most)
        for _ in range(6):
            texts = pa.array([" ".join(rng.choice(pool, rng.integers(0, 60))) for _ in range(20)] + [None, ""])
            for a, b in zip(A.count_texts(own, texts, known), A.count_texts(own, texts), strict=True):
                assert (a == b).all()
            assert len(known.keys) <= most and len(np.unique(known.keys)) == len(known.keys)


def test_token_counts_of_odd_texts(odd, empty, piece_bpe):
    vocabulary = set(A.vocabulary_of(piece_bpe))
    want = []
    for i, t in pairs(odd):
        n = [greedy(P.MARK + w.decode(), vocabulary) for w in words(t)]
        want.append((i, len(n), sum(max(x, 1) for x in n), sum(x < 0 for x in n)))
    got = [tuple(r) for r in A.token_counts(odd, piece_bpe).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    assert A.token_counts(empty, piece_bpe).count() == 0


def test_pieces_equal_sentencepiece_both_ways(odd, empty, piece_bpe):
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_bpe)
    ids = P.encoded(odd, piece_bpe)
    back = P.decoded(ids, piece_bpe)
    texts = sorted(pairs(odd), key=lambda x: str(x))
    got = sorted((r.doc_id, np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in ids.where("doc_id IS NOT NULL").collect())
    assert got == sorted((i, sp.encode(t or "")) for i, t in texts if i is not None)
    text = sorted((r.doc_id, r.text) for r in back.where("doc_id IS NOT NULL").collect())
    assert text == sorted((i, sp.decode(sp.encode(t or ""))) for i, t in texts if i is not None)
    checked = P.checked(odd, piece_bpe).collect()
    assert len(checked) == odd.count() and P.checked(empty, piece_bpe).count() == 0
    assert sum(not r.round_trip for r in checked) == 1  # the literal marker becomes a space


def test_fragments_that_differ_are_counted_and_replaced_alone(piece_bpe):
    own = P.PieceCodec(piece_bpe)
    plain = own.plain

    class Other:
        def encode(self, texts, num_threads):
            return [[7, 7] if x == "bad" else [*plain.encode(x)] for x in texts]

    own.plain = Other()
    ids, n, differ = own.encode_both(pa.array(["good  words", "bad good bad", None, "", "bad"]))
    assert differ.tolist() == [0, 2, 0, 0, 1]
    at = np.concatenate([[0], np.cumsum(n)])
    assert ids[at[4] : at[5]].tolist() == [7, 7]
    assert ids[at[1] : at[2]].tolist() == [7, 7, *plain.encode("good"), 7, 7]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def model_bytes(pieces, model_type, dummy=True, collapse=False, fallback=True):
    """A model file written field by field."""
    import struct

    msg = lambda number, body: varint(number << 3 | 2) + varint(len(body)) + body
    num = lambda number, v: varint(number << 3) + varint(v)
    out = b"".join(msg(1, msg(1, p.encode()) + varint(2 << 3 | 5) + struct.pack("<f", s) + num(3, k)) for p, s, k in pieces)
    out += msg(2, num(3, model_type) + num(35, int(fallback)) + num(40, 0))
    return out + msg(3, msg(1, b"identity") + num(3, int(dummy)) + num(4, int(collapse)) + num(5, 1))


@pytest.mark.parametrize("collapse", [False, True])
def test_a_unigram_model_is_rebuilt(tmp_path, collapse):
    rng = random.Random(2)
    parts = ["▁", "a", "b", "c", "▁a", "ab", "bc", "abc", "▁ab", "ca", "▁c", "cab"]
    pieces = [("<unk>", 0.0, P.UNKNOWN), ("<s>", 0.0, P.CONTROL), ("</s>", 0.0, P.CONTROL)]
    pieces += [(f"<0x{k:02X}>", 0.0, P.BYTE) for k in range(256)]
    pieces += [(p, -1.0 - 0.37 * k - 0.011 * k * k, P.NORMAL) for k, p in enumerate(parts)]
    raw = model_bytes(pieces, P.UNIGRAM, collapse=collapse)
    path = tmp_path / "u.model"
    path.write_bytes(raw)
    parsed = P.parse(raw)
    assert parsed.model_type == P.UNIGRAM and parsed.byte_fallback and parsed.remove_extra_whitespaces is collapse
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    texts = ["".join(rng.choice("abc  é") for _ in range(rng.randint(0, 25))) for _ in range(200)]
    own = P.PieceCodec(str(path))
    ids, n = own.encode(pa.array(texts))
    at = np.concatenate([[0], np.cumsum(n)])
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == sp.encode(texts)
    assert own.differ <= 2  # the library itself agrees, but for a rare tie


def test_language_scores_count_exactly(odd, empty):
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = L.language_scores(odd, train).collect()
    rows = pairs(odd)
    held = {i: i is None or zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    tokens = [(i, [w.lower() for w in words(t)] + [None]) for i, t in rows]
    c = Counter(w for i, ws in tokens if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    want = [(i, held[i], len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in tokens]
    assert sorted([(*tuple(r)[:5], round(r.base_score, 6)) for r in got], key=key) == sorted(want, key=key)
    assert all(np.isfinite(r.score) and r.score <= 0 for r in got)
    assert L.language_scores(empty, train).count() == 0
    none = L.language_scores(odd, F.lit(False)).first()
    assert none.train_tokens == 0 and none.base_score == 0.0


def random_model(k=3, seed=0):
    rng = np.random.default_rng(seed)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    return L.Model(norm(rng.random(k)), norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((k, L.CLASSES))))


def plain_forward(m, classes):
    x = m.pi * m.e[:, classes[0]]
    for c in classes[1:]:
        x = (x @ m.a) * m.e[:, c]
    return x.sum()


def test_forward_is_the_exact_likelihood():
    m = random_model()
    rng = np.random.default_rng(1)
    lengths = np.array([1, 5, 2, 17, 3])
    classes = rng.integers(0, L.CLASSES, lengths.sum())
    got = L.forward_log2(m, classes, lengths)
    at = np.concatenate([[0], np.cumsum(lengths)])
    np.testing.assert_allclose(got, [np.log2(plain_forward(m, classes[a:b])) for a, b in zip(at[:-1], at[1:], strict=True)])


def test_expected_counts_equal_a_sum_over_paths():
    from itertools import product

    m = random_model(2)
    classes = np.array([3, 1, 3, 7])
    pi, mid, moves, emits, ll = L.expected_counts(m, classes, np.array([0]), np.array([4]), np.array([True]))
    total, w_pi, w_moves, w_emit = 0.0, np.zeros(2), np.zeros((2, 2)), np.zeros((2, L.CLASSES))
    for path in product(range(2), repeat=4):
        p = m.pi[path[0]] * np.prod([m.a[s, t] for s, t in zip(path, path[1:], strict=False)]) * np.prod([m.e[s, c] for s, c in zip(path, classes, strict=True)])
        total += p
        w_pi[path[0]] += p
        for s, t in zip(path, path[1:], strict=False):
            w_moves[s, t] += p
        for s, c in zip(path, classes, strict=True):
            w_emit[s, c] += p
    np.testing.assert_allclose(pi, w_pi / total, rtol=1e-4)
    np.testing.assert_allclose(moves, w_moves / total, rtol=1e-4)
    np.testing.assert_allclose(emits, w_emit / total, rtol=1e-3, atol=1e-6)
    assert ll == pytest.approx(np.log2(total), rel=1e-4) and mid.sum() == 0


def test_the_model_beats_the_base_on_held_out_texts(docs):
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2
    got = L.language_scores(docs, train).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


def test_odd_texts_hold_what_they_promise():
    texts = odd_texts()
    assert None in texts and "" in texts and max(len(t or "") for t in texts) > 50_000
