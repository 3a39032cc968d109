from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from frameloom.llm import textkit as K

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="ab é\n\t漢 \x1c", max_size=90)), max_size=8)


@settings(max_examples=80, deadline=None)
@given(TEXTS, st.booleans())
def test_words_joins_and_hashes(texts, lower):
    t = K.texts_of(pa.array(texts, pa.string()), lower)
    w = K.words_of(t)
    want = [((x or "").encode().lower() if lower else (x or "").encode()).split() for x in texts]
    got = [[t.buf[w.start[j] : w.end[j]].tobytes() for j in range(w.first[i], w.first[i + 1])] for i in range(len(t))]
    assert got == want
    flat = [x for ws in want for x in ws]
    keep = np.arange(len(flat)) % 3 != 1
    j = K.joined(w, keep)
    assert [j.raw(i) for i in range(len(j))] == [b" ".join(x for x, k in zip(ws, keep[w.first[i] :], strict=False) if k) for i, ws in enumerate(want)]
    assert K.xxh64_ranges(t.buf, w.start, w.end).tolist() == [xxhash.xxh64_intdigest(x, 42) for x in flat]
    kinds = {}
    for x, h in zip(flat, K.word_hashes(w).tolist(), strict=True):
        assert kinds.setdefault(x, h) == h
    assert len(set(kinds.values())) == len(kinds)


def test_xxh64_of_every_length():
    raw = bytes(range(256)) * 2
    t = K.texts_of(pa.array([raw[:n] for n in range(300)], pa.binary()))
    assert K.xxh64_ranges(t.buf, t.offsets[:-1], t.offsets[1:], 42).tolist() == [xxhash.xxh64_intdigest(raw[:n], 42) for n in range(300)]


def test_windows_stay_in_their_text():
    w = K.words_of(K.texts_of(pa.array(["a b c", "", "d", "a b c d"])))
    assert K.window_mask(w, 3).tolist() == [True, False, False, False, True, True]
    h = K.window_hashes(K.word_hashes(w), 3)
    assert h[0] == h[4] and h[0] != h[5]


def test_steps_cover_a_batch():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * 10] * 25 + [None])], ["text"])
    parts = list(K.steps(b, "text", 64))
    assert sum(p.num_rows for p in parts) == 26 and len(parts) > 3
