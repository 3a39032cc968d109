"""Operators 3 and 9: packing, token files."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from frameloom.llm import packing as K
from frameloom.llm import tokenfile as T
from frameloom.llm.wordcodec import codec

from .conftest import key, pairs


def library(path):
    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


ALPHABET = list("abcXYZ'.!,-09 \n\té́ÉİK漢😀\u0085 \x1c≠ſΣςẞǅ<|>_") + ["'s", "'LL", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "ﬁ"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join)), max_size=6))
def test_codec_equals_the_library(texts):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    ids, n = codec(path).encode(pa.array(texts, pa.string()))
    at = np.concatenate([[0], np.cumsum(n)])
    encode = library(path)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [encode(t) for t in texts]


def test_codec_of_another_kind_of_tokenizer():
    import public_tokenizers

    own = codec(public_tokenizers.path("byte_bpe_50k.json"))
    assert not own.by_word
    ids, n = own.encode(pa.array(["Hello world", None]))
    assert n.tolist() == [2, 0] and len(ids) == 2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), min_size=1, max_size=120))
def test_plans_cover_the_histogram(lengths):
    kinds, counts = np.unique(lengths, return_counts=True)
    found = K.solve(kinds, counts, 64, rounds=20)
    total = Counter()
    for fill, times in found:
        assert sum(x * n for x, n in fill.items()) <= 64
        for x, n in fill.items():
            total[x] += n * times
    assert total == Counter(lengths)
    assert sum(t for _, t in found) >= -(-sum(lengths) // 64)


def test_the_program_beats_best_fit_where_it_can():
    rng = np.random.default_rng(1)
    kinds, counts = np.unique(rng.integers(500, 900, 6000), return_counts=True)
    assert sum(t for _, t in K.solve(kinds, counts, 2048)) < sum(t for _, t in K.best_fit(kinds, counts, 2048))


def test_the_program_places_the_sequences():
    """Lengths like a corpus' (many distinct, few of each): the program fills nine sequences in ten, and none is lost."""
    rng = np.random.default_rng(5)
    drawn = np.minimum(np.maximum(rng.lognormal(6.4, 0.8, 11_000).astype(np.int64), 20), 2048)
    kinds, counts = np.unique(drawn, return_counts=True)
    for more in (1, 1000):
        found, left = K.program(kinds, counts * more, 2048)
        placed = sum(t for _, t in found)
        total = placed + sum(t for _, t in K.best_fit(kinds, left, 2048))
        assert (left >= 0).all() and placed >= 0.9 * total
        assert total <= 1.0005 * -(-int((kinds * counts * more).sum()) // 2048) + 1


def test_lengths_that_never_fill_a_sequence():
    found, left = K.program(np.array([1000]), np.array([101]), 2048)
    assert sum(t for _, t in found) >= 48 and sum(t for _, t in K.solve(np.array([1000]), np.array([101]), 2048)) == 51


def test_price_is_the_best_configuration():
    lengths, weights = np.array([3, 5, 7]), np.array([3.1, 5.6, 7.1])
    got = K.price(lengths, weights, np.full(3, 99), 20)
    best = max((a * 3.1 + b * 5.6 + c * 7.1, (a, b, c)) for a in range(7) for b in range(5) for c in range(3) if 3 * a + 5 * b + 7 * c <= 20)
    assert got @ weights == pytest.approx(best[0])


def test_packing_of_odd_texts(odd, empty, word_bpe):
    got = K.packed(odd, word_bpe, keep_ids=True).collect()
    encode = library(word_bpe)
    want = []
    for i, t in pairs(odd):
        ids = np.array([*encode(t), 0], dtype="<u4")
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    places = defaultdict(list)
    for r in got:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32
        places[r.sequence_id].append((r.offset, r.length))
    for rows in places.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= -(-sum(r.length for r in got) // 2048) + 1
    assert K.packed(empty, word_bpe).count() == 0


def test_sequences_hold_their_pieces(docs, word_bpe):
    placed = K.packed(docs.limit(40), word_bpe, keep_ids=True).persist()
    by = defaultdict(list)
    for r in placed.collect():
        by[r.sequence_id].append((r.offset, bytes(r.ids)))
    got = {r.sequence_id: bytes(r.ids) for r in K.sequences(placed).collect()}
    assert got == {k: b"".join(x for _, x in sorted(v)) for k, v in by.items()}
    placed.unpersist()


def test_token_files(odd, empty, word_bpe, tmp_path):
    encode = library(word_bpe)
    manifest = T.write_tokens(odd, word_bpe, folder=f"file://{tmp_path}/t")
    got = [tuple(r)[:4] for r in T.read_tokens(manifest).collect()]
    rows = []
    for i, t in pairs(odd):
        ids = np.array([*encode(t), 2], dtype="<u4")
        rows.append((i, zlib.crc32(ids.tobytes()), len(ids)))
    rows.sort(key=lambda r: (r[0] is not None, r[0], r[1], r[2]))
    start, want = 0, []
    for i, crc, n in rows:
        want.append((i, start, n, crc))
        start += n
    assert sorted(got, key=key) == sorted(want, key=key)
    assert T.read_tokens(T.write_tokens(empty, word_bpe)).count() == 0


def test_a_hot_id_is_spread_over_files_in_order(spark, word_bpe, tmp_path):
    texts = [f"word {k} of {k % 7}" for k in range(3000)]
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    manifest = T.write_tokens(df, word_bpe, folder=f"file://{tmp_path}/t")
    assert manifest.count() > 2 and max(r.n_docs for r in manifest.collect()) < 1500
    encode = library(word_bpe)
    want, start = [], 0
    sized = [(i, zlib.crc32(np.array([*encode(t), 2], "<u4").tobytes()), len(encode(t)) + 1) for i, t in rows]
    for i, crc, n in sorted(sized, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        want.append((i, start, n, crc))
        start += n
    got = sorted((tuple(r)[:4] for r in T.read_tokens(manifest).collect()), key=lambda r: r[1])
    assert got == want
    parts = T.parts_of(np.array([5, 7, 7, 7, 9]), np.array([5, 6, 7, 7, 8, T.NO_ID]), np.array([1, 1, 0, (1 << 32) - 1, 5, 9]))
    assert parts.tolist() == [0, 1, 1, 4, 4, 0]


def test_a_reader_takes_single_documents_and_any_tool_the_whole_file(docs, word_bpe, tmp_path):
    manifest = T.write_tokens(docs, word_bpe, folder=f"file://{tmp_path}/t").collect()
    path = manifest[0].path
    file = T.TokenFile(path)
    texts = dict(pairs(docs))
    encode = library(word_bpe)
    for i in (int(file.ids[0]), int(file.ids[file.n // 2])):
        (ids,) = file.document(i)
        assert np.frombuffer(ids, "<u4").tolist() == [*encode(texts[i]), 2]
    assert file.document(-5) == []
    raw = open(path.removeprefix("file://"), "rb").read()
    plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert plain == b"".join(file.frames(range(file.n)))
    broken = bytearray(raw)
    broken[int(file.at[3]) - 3] ^= 0xFF
    bad = tmp_path / "bad.zst"
    bad.write_bytes(bytes(broken))
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(T.TokenFile(f"file://{bad}").frames([2]))
    file.close()
