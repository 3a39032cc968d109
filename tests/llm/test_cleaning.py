"""Operators 4, 5, 6, 8, 10 and the pipeline."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from frameloom.llm import components as C
from frameloom.llm import gam as M
from frameloom.llm import multiindex as N
from frameloom.llm import registry as R
from frameloom.llm import rules as Q
from frameloom.llm import similar as Z
from frameloom.llm import simhash as S
from frameloom.llm import substrings as D

from ..compare import assert_same
from .conftest import key, pairs, words

# ------------------------------------------------------------------- rules


def measures(text):
    t = text or ""
    w = words(t)
    runs = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    times = {}
    for r in runs:
        times[r] = times.get(r, 0) + 1
    covered = {k + j for k, r in enumerate(runs) if times[r] > 1 for j in range(8)}
    lines = [x for x in t.split("\n") if words(x)]
    return dict(n_words=len(w), word_chars=sum(len(x.decode()) for x in w), n_symbols=sum(c in "#*$%&|<>" for c in t), n_bangs=t.count("!"), n_lines=len(lines), n_dup_lines=len(lines) - len(set(lines)), n_repeat_words=len(covered))


def test_measures_and_verdicts_of_odd_texts(odd, empty):
    rows = Q.cascade(odd).collect()
    got = [(r.doc_id, *(r[Q.OWN + n] for n in Q.NAMES), r[Q.OWN + "rejected_by"] is None) for r in rows]
    want = []
    for i, t in pairs(odd):
        m = measures(t)
        bad = m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"] or 10 * m["n_symbols"] > m["n_words"] or 10 * m["n_bangs"] > m["n_words"] or 10 * m["n_dup_lines"] > 4 * m["n_lines"] or not 2 * m["n_words"] <= m["word_chars"] <= 12 * m["n_words"]
        want.append((i, *(m[n] for n in Q.NAMES), not bad))
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = Q.kept_only(odd)
    assert kept.columns == odd.columns
    assert sorted([r.doc_id for r in kept.collect()], key=lambda v: (v is not None, v)) == sorted([x[0] for x in want if x[-1]], key=lambda v: (v is not None, v))
    assert Q.cascade(empty).count() == 0 and Q.kept_only(empty).count() == 0


def test_rule_query_equals_sql(spark, duck, small):
    assert_same(R.queries()["op4_rules"](spark, small).toPandas(), duck.execute(R.oracle_sql()["op4_rules"]).df())


def test_the_filter_splits_once_and_holds_no_measure_twice(docs):
    plan = Q.kept_only(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Filter") == 1 and plan.count("split(") == 2  # words, lines
    assert plan.count("array_join(") == plan.count("sequence(") == 1


def test_order_follows_rejection_per_cost(docs):
    order = Q.ordered(docs)
    assert {r.name for r in order} == {r.name for r in Q.RULES}
    never = Q.Rule("never", "n_words < 0")
    assert Q.ordered(docs, (never, *Q.RULES))[-1].name in ("never", "word_length")


# -------------------------------------------------------------- substrings


def brute(rows, window):
    first = {}
    for i, t in rows:
        if i is not None:
            w = words(t)
            for k in range(len(w) - window + 1):
                x = tuple(w[k : k + window])
                first[x] = min(first.get(x, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone[k : k + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return sorted(out, key=key)


@pytest.mark.parametrize("window", [5, 13, 50])
def test_repeats_are_removed_exactly(odd, empty, window):
    got = sorted([tuple(r) for r in D.remove_repeats(odd, window=window).collect()], key=key)
    assert got == brute(pairs(odd), window)
    assert sum(r[2] for r in got) > 0
    assert D.remove_repeats(empty, window=window).count() == 0


def test_covers_align_any_two_places():
    for v, cover in D.COVERS.items():
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))


def test_documents_keep_all_else(odd, empty):
    before = {(r.doc_id, r.lang, r.n_words, r.id): r.text for r in odd.collect()}
    after = D.without_repeats(odd, window=50)
    assert after.columns == odd.columns and after.count() == odd.count()
    cut = {(i, t): n for (i, _, n, _), (_, t) in zip(brute(pairs(odd), 50), sorted(pairs(odd), key=key), strict=False)}
    assert cut
    rows = after.collect()
    for r in rows:
        old = before.get((r.doc_id, r.lang, r.n_words, r.id))
        if r.doc_id is None:
            assert r.text == (old or "")
    same = sum(r.text == (before.get((r.doc_id, r.lang, r.n_words, r.id)) or "") for r in rows)
    assert same >= len(rows) - 6
    assert D.without_repeats(empty).count() == 0


# ----------------------------------------------------------------- simhash


def fingerprint(text):
    w = (text or "").encode().lower().split()
    w = [bytes(x) for x in w]
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(len(w) - 2, 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, near):
    label = {n: n for n in nodes}
    while True:
        new = {a: min([label[a], *(label[b] for b in nodes if near(a, b))]) for a in nodes}
        if new == label:
            return label
        label = new


def test_fingerprints_and_components(odd, empty):
    rows = [(i, fingerprint(t)) for i, t in pairs(odd)]
    got = S.near_duplicates(odd).collect()
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1) for r in got), key=key) == sorted(rows, key=key)
    rep = {}
    for i, f in rows:
        if i is not None:
            rep[f] = min(rep.get(f, i), i)
    root = roots(list(rep), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for f, i in rep.items():
        least[root[f]] = min(least.get(root[f], i), i)
    want = {f: least[root[f]] for f in rep}
    for r in got:
        assert r.component == (want[r.fp & (1 << 64) - 1] if r.doc_id is not None else None)
    kept = S.first_of_each(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} - {None} == set(want.values())
    assert S.near_duplicates(empty).count() == 0 and S.first_of_each(empty).count() == 0


def test_links_in_short_and_long_lists(spark):
    rng = np.random.default_rng(0)
    base = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    fps = {int(x) for x in base}
    for _ in range(900):
        x = int(rng.choice(base))
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            x ^= 1 << int(b)
        fps.add(x)
    fps = np.array(sorted(fps), dtype=np.uint64)
    want = {(int(a), int(b)) for k, a in enumerate(fps.tolist()) for b in fps[k + 1 :].tolist() if (a ^ b).bit_count() <= 2}
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    unsigned = lambda v: v & (1 << 64) - 1
    for block in (S.BLOCK, 16):  # whole lists, and lists cut into blocks that meet each other
        got = [tuple(sorted((unsigned(r.u), unsigned(r.v)))) for r in S.links(df, block=block).collect()]
        assert len(got) == len(want) and set(got) == want


@pytest.mark.parametrize("max_bits", [0, 1, 3, 5])
def test_links_at_other_distances(spark, max_bits):
    rng = np.random.default_rng(max_bits)
    base = rng.integers(0, 1 << 63, 4, dtype=np.uint64)
    fps = {int(x) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for x in base for _ in range(60)}
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= max_bits}
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in fps], "fp long")
    got = {tuple(sorted((r.u & (1 << 64) - 1, r.v & (1 << 64) - 1))) for r in S.links(df, max_bits).collect()}
    assert got == want


def test_count_filter_rejects_pairs_of_a_list():
    """Pairs that share a list's four bytes but not six fall by the tally; of those that pass it, some fall by their bits."""
    one = np.array([0x1111111111111111] * 3, dtype=np.uint64)
    two = np.array([0x1111111101010101, 0x11111111111111EE, 0x1111111111111112], dtype=np.uint64)
    assert S._tally(one ^ two).tolist() == [4, 7, 7]
    assert S._near(one, two, 2)[1].tolist() == [0x1111111111111112]


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(1)
    edges = [(k, k + 1) for k in range(60)] + [(100, 100 + k) for k in range(1, 40)] + [tuple(map(int, rng.integers(200, 300, 2))) for _ in range(70)]
    got = {r.node: r.root for r in C.connected(spark.createDataFrame(edges, "a long, b long").repartition(6)).collect()}
    nodes = sorted({n for e in edges if e[0] != e[1] for n in e})
    linked = {frozenset(e) for e in edges}
    assert got == roots(nodes, lambda a, b: frozenset((a, b)) in linked)
    assert C.connected(spark.createDataFrame([], "a long, b long")).count() == 0


# ------------------------------------------------------------- similar


def shingles(text):
    w = [x.lower() for x in words(text)]
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def jaccard(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / max(len(x | y), 1)


def test_near_copies_of_the_stage_are_those_of_the_rule(spark, odd, empty):
    import corpus_pipeline as P

    rng = random.Random(9)
    texts = []
    for _ in range(12):  # copies with one to six words changed: similarities on both sides of 0.8
        base = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
        texts.append(" ".join(base))
        for changes in (1, 2, 2, 3, 3, 4, 6):
            copy = list(base)
            for at in rng.sample(range(120), changes):
                copy[at] = f"new{rng.randint(0, 5000)}"
            texts.append(" ".join(copy))
    texts += [texts[0].upper(), texts[0].replace(" ", "\n"), "", None, "two words", "Two  words"]
    order = rng.sample(range(len(texts)), len(texts))
    df = spark.createDataFrame([(i, texts[k], "x") for i, k in enumerate(order)] + [(None, texts[0], "x")], "doc_id long, text string, lang string").repartition(5)
    text = {i: texts[k] or "" for i, k in enumerate(order)}
    want = roots(list(text), lambda a, b: jaccard(text[a], text[b]) >= 0.8 or words(text[a]) == words(text[b]))
    kept = P.near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} - {None} == set(want.values())
    assert len(set(want.values())) < 2 * len(text) / 3
    split = Z.components(df, block=3)  # lists cut into small blocks that meet each other
    assert {r.component for r in split.collect()} == set(want.values())
    assert len(Z.first_of_each(odd).where("doc_id IS NULL").collect()) == odd.where("doc_id IS NULL").count()
    assert Z.first_of_each(empty).count() == 0


def test_a_cloud_of_near_copies_becomes_few_links():
    """Copies of which many are under the threshold to each other: every pair is compared, few links come out."""
    rng = random.Random(3)
    base = list(range(150))
    sets = []
    for k in range(120):
        x = list(base)
        for at in rng.sample(range(150), 1 + k % 30):
            x[at] = rng.randint(10_000, 99_999)
        sets.append(np.unique(np.array(x, dtype=np.uint64)))
    keys = np.arange(120)
    u, v = Z.joining(keys, keys.copy(), np.zeros(120, int), False, sets, 0.8)
    near = lambda a, b: 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))
    assert all(near(a, b) for a, b in zip(u, v, strict=True)) and len(u) < 120
    linked = {frozenset(e) for e in zip(u.tolist(), v.tolist(), strict=True)}
    assert roots(keys.tolist(), near) == roots(keys.tolist(), lambda a, b: frozenset((a, b)) in linked)


def bytes_of(prints):
    return [x.tobytes() for x in prints]


def is_candidate(a, b):
    same = sum(x == y for x, y in zip(a, b, strict=True))
    return same >= Z.SHARED and sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True)) <= Z.most_bits(0.8)


def changed(rng, base, share):
    out = base.copy()
    out[rng.choice(len(out), int(share * len(out)), replace=False)] = rng.integers(0, 1 << 63, int(share * len(out)))
    return np.unique(out)


def test_candidates_of_near_copies_come_from_positional_bytes():
    """Fingerprints are SimHash, in a list pairs with few shared bytes or many differing bits fall, and near copies are found."""
    rng = np.random.default_rng(4)
    width = Z.positions(0.8)
    sets = []
    for k in range(400):  # near copies around 0.8, and sets under it
        base = np.unique(rng.integers(0, 1 << 63, int(rng.integers(16, 600))))
        sets += [base, changed(rng, base, 0.11 if k % 2 else 0.3)]
    sets.append(np.empty(0, int))
    h, off = np.concatenate(sets).astype(np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    prints = Z.fingerprints(h, off, width)
    for k in (0, 1, 399, 800):
        bits = [np.unpackbits(np.ascontiguousarray(Z.mix64(sets[k].astype(np.uint64) ^ Z._SALTS[2 + w])).view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0) for w in range(width // 8)]
        assert (np.packbits(2 * np.concatenate(bits) > len(sets[k])) == prints[k].view(np.uint8)).all()

    n = np.diff(off)
    order = np.argsort(n[:-1], kind="stable")
    texts = bytes_of(prints[order])
    size, none = n[order], np.zeros(len(order), int)
    fit = lambda i, j: size[j] <= size[i] / 0.8 + 1e-9
    want = {(i, j) for i in range(len(order)) for j in range(i + 1, len(order)) if fit(i, j) and is_candidate(texts[i], texts[j])}
    got = [(i, j) for u, v in Z.candidates(size, prints[order], none, False, 0.8) for i, j in zip(u.tolist(), v.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want
    own = np.arange(len(order)) % 2
    got = {(i, j) for u, v in Z.candidates(size, prints[order], own, True, 0.8) for i, j in zip(u.tolist(), v.tolist(), strict=True)}
    assert got == {(i, j) for i, j in want if own[i] != own[j]}

    place = {int(x): k for k, x in enumerate(order)}
    near = [tuple(sorted((place[k], place[k + 1]))) for k in range(0, 800, 2) if 5 * len(np.intersect1d(sets[k], sets[k + 1])) >= 4 * len(np.union1d(sets[k], sets[k + 1]))]
    assert len(near) > 150 and set(near) <= want  # recall 1
    assert len(want) < 400  # and others fall


def test_the_index_posts_every_positional_byte(spark):
    """The stage's candidate pairs are those of the index, whole, also where lists are cut into blocks."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 1 << 63, 300)
    sets = [changed(rng, base, 0.01 * (k % 25)) for k in range(60)] + [np.unique(rng.integers(0, 1 << 63, 290)) for _ in range(60)]
    off = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    width = Z.positions(0.8)
    prints = Z.fingerprints(np.concatenate(sets).astype(np.uint64), off, width)
    names = Z._print_names(width)
    rows = [(k, len(x), *p) for k, (x, p) in enumerate(zip(sets, prints.view(np.int64).tolist(), strict=True))]
    classes = spark.createDataFrame(rows, "key long, n long, " + ", ".join(f"{c} long" for c in names)).repartition(3)
    texts = bytes_of(prints)
    fit = lambda a, b: 5 * min(len(sets[a]), len(sets[b])) >= 4 * max(len(sets[a]), len(sets[b])) - 1e-9
    met = lambda a, b: fit(a, b) and is_candidate(texts[a], texts[b])
    want = roots(list(range(120)), met)
    for longest in (Z.LIST, 7):
        got = Z.index(classes, width, 0.8, longest).collect()
        assert all(met(r.key, r.hub) for r in got if r.near)
        parts = {}
        for r in got:
            parts.setdefault(r.band, []).append(r)
        assert all(len(x) == x[0].size for x in parts.values())
        edges = {frozenset((a.key, b.key)) for x in parts.values() for a in x for b in x}
        assert roots(list(range(120)), lambda a, b: frozenset((a, b)) in edges) == want  # noqa: B023
        assert edges >= {frozenset((a, b)) for a in range(120) for b in range(a) if met(a, b)}


# ------------------------------------------------------------- multi-index


def test_neighbours_reach_the_recall(spark, small):
    got = R.queries()["op8_multi_index"](spark, small).toPandas()
    v = spark.read.parquet(f"{small}/embeddings.parquet").toPandas()
    x, ids = np.array(v.embedding.tolist(), dtype=float), v.vec_id.to_numpy()
    hit = total = 0
    for k in np.flatnonzero(ids % 50 == 0):
        s = N.cosine(np.broadcast_to(x[k], x.shape), x)
        s[k] = -9
        best = ids[np.lexsort((ids, -s))[:5]]
        mine = got[got.query_id == ids[k]].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5]
        np.testing.assert_allclose(mine.score, [s[ids == i][0] for i in mine.vec_id], atol=1e-12)
        hit, total = hit + len(set(best) & set(mine.vec_id)), total + 5
    assert hit / total >= 0.9


def test_odd_vectors(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(0, 300)] + [(400, None), (401, [0.0] * 3), (402, [1.0, float("nan"), 0.0]), (403, [1.0, None, 2.0]), (450, [3.0, 2.0, 1.0]), (None, [1.0] * 3), (451, [1.0]), (452, [-1.0, -2.0, -3.0]), (453, []), (1, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, score string, query int").repartition(5)
    got = {}
    for r in N.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[250] == [0, 1, 2, 3, 4] and got[450] == [0, 1, 2, 3, 4]
    assert set(got) == {0, 50, 100, 150, 200, 250, 450}
    assert N.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert N.nearest(df.where("vec_id = 450"), F.col("vec_id") % 50 == 0).count() == 0
    few = N.nearest(df.where("vec_id IN (450, 452)"), F.col("vec_id") % 50 == 0).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in few] == [(450, 1, 452)]


def test_every_cell_visited_gives_the_exact_neighbours(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet")
    v = vectors.toPandas()
    x, ids = np.array(v.embedding.tolist(), dtype=float), v.vec_id.to_numpy()
    got = {}
    for r in N.nearest(vectors, F.col("vec_id") % 50 == 0, share=1.0, group=3).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    for k in np.flatnonzero(ids % 50 == 0):
        s = N.cosine(np.broadcast_to(x[k], x.shape), x)
        s[k] = -9
        assert got[ids[k]] == ids[np.lexsort((ids, -s))[:5]].tolist()


def test_walk_goes_by_summed_distance():
    rng = np.random.default_rng(0)
    left, right, counts = rng.random(6), rng.random(5), rng.integers(0, 4, 30)
    got = N.walk(left, right, counts.tolist(), counts.sum())
    total = (left[:, None] + right[None, :]).ravel()
    want = [c for c in np.argsort(total) if counts[c]]
    assert got == want


# -------------------------------------------------------------- classifier


def test_classifier_learns_planted_quality_and_ignores_the_rest(spark, small, odd, empty):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    learn = R.crc_rest("doc_id", 5) != 0
    model = M.fit(docs, labels, learn)
    got = {r.doc_id: r.score for r in M.scores(docs, model).collect()}
    known = [(r.doc_id, r.quality) for r in labels.where(R.crc_rest("doc_id", 5) == 0).collect()]
    assert np.mean([(got[i] >= M.THRESHOLD) == (q == 1) for i, q in known]) >= 0.9
    other = docs.withColumns({"lang": F.lit("zz"), "source": F.lit("other"), "doc_id": F.col("doc_id") + 10_000})
    moved = {r.doc_id - 10_000: r.score for r in M.scores(other, model).collect()}
    assert moved == got
    rows = M.scores(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert M.scores(empty, model).count() == 0 and M.accepted(empty, model).count() == 0
    assert M.accepted(odd, model).columns == odd.columns
    again = M.fit(docs.repartition(7), labels.repartition(3), learn)
    x = M.measures(pa.array([t for _, t in pairs(docs)]))
    np.testing.assert_allclose(again.score(x), model.score(x))


def test_copies_of_a_labelled_id_leave_the_sample_whole(spark, monkeypatch):
    docs = spark.createDataFrame([(0, f"copy {k}") for k in range(200)] + [(i, "word " * i) for i in range(1, 10)], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(0, 1)] * 50 + [(i, i % 2) for i in range(1, 10)] + [(3, 0)], "doc_id long, quality int").repartition(3)
    seen = []
    monkeypatch.setattr(M, "train", lambda x, y: seen.append((x, y)))
    M.fit(docs, labels, F.lit(True), most=10)
    (x, y) = seen[0]
    assert len(y) == 10 and y.sum() == 5  # every id once; of an id's labels the smallest
    counts = np.rint(np.expm1(x[:, M.MEASURES.index("log_words")])).astype(int)
    assert sorted(counts) == sorted([2, *range(1, 10)])
    M.fit(docs.where("doc_id > 0"), labels, F.lit(True), most=10)
    assert len(seen[1][1]) == 9


def test_tables_of_a_planted_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = M.train(x, y)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.95
    assert M.train(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]
    assert M.train(x[:4], np.ones(4)).score(x[:1])[0] == pytest.approx(5 / 6)


def test_measures_of_small_texts():
    m = dict(zip(M.MEASURES, M.measures(pa.array(["a b a b a b\na b\na b"]))[0], strict=True))
    assert m["distinct"] == 0.2 and m["top_word"] == 0.5 and m["repeat_lines"] == pytest.approx(1 / 3)
    assert (M.measures(pa.array([None, ""])) == 0).all()


# ---------------------------------------------------------------- pipeline


def test_pipeline_equals_its_stages_by_brute_force(spark, small, word_bpe):
    import zlib

    import corpus_pipeline as P
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{small}/documents.parquet")
    labels = spark.read.parquet(f"{small}/labels.parquet")
    model = M.fit(docs, labels, R.crc_rest("doc_id", 5) != 0)
    rows = sorted(pairs(docs))
    score = model.score(M.measures(pa.array([t for _, t in rows])))
    rows = [r for r, s in zip(rows, score, strict=True) if s >= M.THRESHOLD]

    def good(t):
        m = measures(t)
        return not (m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"] or 10 * m["n_symbols"] > m["n_words"] or 10 * m["n_bangs"] > m["n_words"] or 10 * m["n_dup_lines"] > 4 * m["n_lines"] or not 2 * m["n_words"] <= m["word_chars"] <= 12 * m["n_words"])

    rows = [r for r in rows if good(r[1])]
    sets = {i: shingles(t) for i, t in rows}
    root = roots(list(sets), lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]))
    rows = [r for r in rows if root[r[0]] == r[0]]
    kept = {i: text for i, _, _, text in brute(rows, P.PASSAGE_WORDS)}
    t = Tokenizer.from_file(word_bpe)
    want = []
    for i, _ in rows:
        ids = np.array([*t.encode(kept[i], add_special_tokens=False).ids, 0], dtype="<u4")
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    got = P.run(spark, small).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)


def test_stages_of_odd_and_empty_tables(spark, small, odd, empty, tmp_path):
    import corpus_pipeline as P

    for name, stage in P.STAGES:
        for docs in (odd, empty):
            got = stage(spark, docs, small)
            if name != "best_fit_packing":
                assert got.columns == docs.columns, name
            assert (got.count() > 0) == (docs is odd), name
    spark.read.parquet(f"{small}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert P.quality_classifier(spark, odd, f"file://{tmp_path}").count() == odd.count()


def test_digest_query_equals_sql(spark, duck, small):
    assert_same(R.queries()["op5_substrings"](spark, small).toPandas(), duck.execute(R.oracle_sql()["op5_substrings"]).df())


def test_digest_query(spark, small):
    rows = sorted(pairs(spark.read.parquet(f"{small}/documents.parquet")))
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in R.queries()["op5_substrings"](spark, small).collect()}
    assert got == {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in brute(rows, 13)}
