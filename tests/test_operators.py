"""Session operators on planted truths and small cases (D, E, F, G, H families)."""

from __future__ import annotations

import math
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from frameloom.operators import background as B
from frameloom.operators import catalog as G
from frameloom.operators import field as L
from frameloom.operators import geometry as T
from frameloom.operators import images as I
from frameloom.operators import ordering as O
from frameloom.operators import windows as W
from frameloom.plans.config import Config


def test_numbering_and_blocks(spark):
    rows = [(int(v),) for v in np.random.default_rng(0).permutation(20000)]
    df = spark.createDataFrame(rows, "v long").repartition(7)
    assert O.numbered(df, ["v"], "at").where("v <> at").count() == 0
    assert O.numbered(df.limit(0), ["v"], "at").count() == 0
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:  # more partitions than keys: still many ranges, in order
        spark.conf.set("spark.sql.shuffle.partitions", "5000")
        few = df.where("v < 600").coalesce(2)
        parts = [r.part for r in sorted(O.ranges(few, ["v"], "part").collect())]
        assert parts == sorted(parts) and len(set(parts)) == 600
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    wide = W.trimmed_window_long(df.withColumn("x", F.col("v") * 1.0), "v", "x", F.lit(False), 7)
    assert wide.count() == 20000
    assert wide.where("v BETWEEN 3 AND 19996 AND abs(combined - x) > 1e-9").count() == 0


def test_block_background_of_whole_blocks(spark):
    """Blocks of 1,024 values, one of them flat, against the rule step by step; the plan holds no sort inside a lambda."""
    rng = np.random.default_rng(8)
    blocks = {0: rng.normal(50, 4, 1024), 1: np.full(1024, 7.0), 2: np.concatenate([rng.normal(10, 1, 700), rng.normal(90, 1, 324)]), 3: np.array([5.0]), 4: np.array([1.0, 9.0])}
    rows = [(0, k, 0, float(v)) for k, b in blocks.items() for v in rng.permutation(b)] + [(0, 0, 0, None), (0, 9, 0, None)]
    df = spark.createDataFrame(rows, "frame_idx int, gx int, gy int, v double").repartition(4)
    maps = B.block_background(df)
    got = {r.gx: r for r in maps.collect()}
    assert set(got) == set(blocks)
    mid = lambda v: np.sort(v)[len(v) // 2]
    for k, b in blocks.items():
        med = mid(b)
        mad = mid(np.abs(b - med))
        kept = b[b <= med + 3 * mad]
        bg = med if mad <= 0 or len(kept) < len(b) // 2 else mid(kept)
        spread = mid(np.abs(b - bg))
        assert (got[k].bg, got[k].noise, got[k].n) == (bg, spread, len(b))
        assert got[k].star == pytest.approx((b > bg + 4 * spread).mean() - B.STAR_NOISE)
    assert B.block_background(df.limit(0)).count() == 0
    plan = maps.where("bg > 0")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and plan.count("collect_list") == 1


def test_transform_algebra(spark):
    m, k = (T.rotation(F.lit(a), F.lit(x), F.lit(y)) for a, x, y in ((0.3, 4.0, -2.0), (-1.1, 0.5, 7.0)))
    x, y = T.apply(T.compose(k, m), F.lit(2.0), F.lit(5.0))
    x2, y2 = T.apply(k, *T.apply(m, F.lit(2.0), F.lit(5.0)))
    bx, by = T.apply(T.inverse(m), *T.apply(m, F.lit(2.0), F.lit(5.0)))
    r = spark.range(1).select((x - x2).alias("a"), (y - y2).alias("b"), (bx - 2.0).alias("c"), (by - 5.0).alias("d"), T.angle_degrees(m).alias("e"), T.corner_deviation(T.identity(), T.translation(3.0, 4.0), 10, 10).alias("f")).first()
    assert max(abs(v) for v in r[:4]) < 1e-9 and r.e == pytest.approx(math.degrees(0.3)) and r.f == pytest.approx(5.0)


def test_prediction_takes_the_short_way_round(spark):
    rows = [(0, True, 3.1, 0.0, 0.0), (1, False, 0.0, 0.0, 0.0), (2, True, -3.1, 2.0, 4.0), (20, True, 1.0, 1.0, 1.0), (21, False, 0.0, 0.0, 0.0), (40, False, 0.0, 0.0, 0.0)]
    c = spark.createDataFrame(rows, "frame_idx long, aligned boolean, angle double, tx double, ty double")
    got = {r.frame_idx: r.predicted for r in T.predict(c).collect()}
    assert math.cos(got[1].angle) == pytest.approx(-1, abs=1e-6) and (got[1].tx, got[1].ty) == (1.0, 2.0)
    assert got[21].angle == 1.0  # one neighbour: as it is
    assert got[40] is None


def drift(n=30, bad=(), missing=()):
    k = np.arange(n)
    f = pd.DataFrame({"frame_idx": k, "aligned": True, "angle": 0.001 * k, "tx": 0.5 * k, "ty": -0.25 * k})
    for b in bad:
        f.loc[b, "tx"] += 20
    f.loc[list(missing), "aligned"] = False
    f.loc[list(missing), ["angle", "tx", "ty"]] = 0.0
    return f


def test_outlier_is_replaced_and_missing_is_predicted(spark):
    f = drift(bad=(12,), missing=(20,))
    out = T.recovered(f, 600, 400).set_index("frame_idx")
    assert out.source[12] == "replaced" and abs(out.tx[12] - 6.0) < 1.0
    assert out.source[20] == "predicted" and abs(out.tx[20] - 10.0) < 1e-6
    marks = T.implausible(spark.createDataFrame(f), 600.0, 400.0).where("suspect").select("frame_idx").collect()
    assert 12 in {r.frame_idx for r in marks}


def test_planted_rotation_is_recovered_from_star_lists(spark):
    rng = np.random.default_rng(3)
    p = rng.uniform(0, 1000, (25, 2))
    th, t = 0.02, np.array([12.0, -7.0])
    rot = np.array([[np.cos(th), -np.sin(th)], [np.sin(th), np.cos(th)]])
    q = p @ rot.T + t
    q[:5] = rng.uniform(0, 1000, (5, 2))
    rows = [(0, k, *map(float, v), 1.0) for k, v in enumerate(p)] + [(1, k, *map(float, v), 1.0) for k, v in enumerate(q)]
    stars = spark.createDataFrame(rows, "frame_idx long, star_id long, x double, y double, flux double")
    pairs = T.best_matches(T.triangle_votes(T.triangles(stars)))
    one, two = (stars.where(F.col("frame_idx") == k).select(F.col("star_id").alias(n), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y")) for k, n, c in ((0, "ref_star", "p"), (1, "cur_star", "q")))
    got = T.align_frames(pairs.join(one, "ref_star").join(two, "cur_star")).first()
    assert got.aligned and got.inliers >= 15
    assert (got.angle, got.tx, got.ty) == pytest.approx((th, *t), abs=0.05)
    assert T.ransac(p[:2], q[:2]) is None


def star_lists(frames, rng, most=8):
    """Lists of up to ``most`` stars on a coarse grid, so that many triangles agree."""
    return [(f, k, float(x), float(y)) for f in frames for k, (x, y) in enumerate(rng.integers(0, 6, (int(rng.integers(0, most + 1)), 2)))]


def brute_votes(reference, current):
    """{(frame, ref_star, cur_star): votes} of two lists of stars, triangle by triangle."""

    def made(rows):
        lists, out = {}, {}
        for f, *star in sorted(rows):
            lists.setdefault(f, []).append(star)
        for f, stars in lists.items():
            for (i, *p), (j, *q), (k, *r) in combinations(stars, 3):
                sides = sorted([(math.dist(p, q), 0, k), (math.dist(q, r), 1, i), (math.dist(p, r), 2, j)])
                if sides[2][0] >= 1e-3:
                    out.setdefault(f, []).append(([s[2] for s in sides], sides[0][0] / sides[2][0], sides[1][0] / sides[2][0]))
        return out

    votes, one, two = Counter(), made(reference), made(current)
    for f in one.keys() & two.keys():
        for a, u, v in one[f]:
            for b, s, t in two[f]:
                if abs(u - s) < T.BAND and abs(v - t) < T.BAND:
                    votes.update((f, i, j) for i, j in zip(a, b, strict=True))
    return dict(votes)


def test_votes_move_stars_once_and_no_triangles(spark):
    rng = np.random.default_rng(11)
    rows = star_lists([*range(-3, 100), 127, 128, 500, 10**12], rng) + [(None, 0, 1.0, 1.0), (None, 1, 2.0, 1.0), (None, 2, 1.0, 3.0)]
    schema = "frame_idx long, star_id long, x double, y double"
    stars, full = spark.createDataFrame(rows, schema).repartition(5), [r for r in rows if r[0] is not None]
    found = lambda df: {(r.frame_idx, r.ref_star, r.cur_star): r.votes for r in df.collect()}
    for step in (1, 40):
        want = brute_votes(full, [(f - step, *rest) for f, *rest in full])
        votes = T.triangle_votes(stars, step)
        assert len(want) > 150 and found(votes) == want and votes.count() == len(want)
    assert found(T.triangle_votes(T.triangles(stars))) == found(T.triangle_votes(stars))
    other = star_lists(range(0, 80), rng)
    assert found(T.votes_between(stars, spark.createDataFrame(other, schema))) == brute_votes(full, other)
    assert T.triangle_votes(stars.limit(0)).count() == 0
    plan = T.triangle_votes(spark.createDataFrame(full, schema))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("RepartitionByExpression") == 1
    assert "RepartitionByExpression" in plan.split("MapInArrow")[-1] and "inv0" not in plan  # stars are dealt, triangles are not


def test_votes_in_small_pieces(monkeypatch):
    """A task that holds few triangles at once and gets blocks over many batches adds up the same votes."""
    rows = star_lists(range(200), np.random.default_rng(12))
    dealt = [(b, f if f // 32 == b else None, f - 1 if (f - 1) // 32 == b else None, *rest) for f, *rest in rows for b in {f // 32, (f - 1) // 32}]
    dealt.sort(key=lambda r: r[0])
    kinds = pa.schema([(c, pa.int64()) for c in ("block", "ref_of", "cur_of", "star_id")] + [(c, pa.float64()) for c in "xy"])
    table = pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*dealt, strict=True), kinds, strict=True)], schema=kinds)
    want = brute_votes(rows, [(f - 1, *rest) for f, *rest in rows])
    for gathered, held, tried in ((20_000, 300_000, 1_000_000), (30, 40, 7)):
        for name, value in (("GATHERED", gathered), ("HELD", held), ("TRIED", tried)):
            monkeypatch.setattr(T, name, value)
        out = [r for b in T._voted(T.BAND)(iter(table.to_batches(max_chunksize=50))) for r in zip(*b.to_pydict().values(), strict=True)]
        assert len(out) == len(want) and {r[:3]: r[3] for r in out} == want


def every_pair(p, q, tolerance=3.0):
    """Most inliers over every pair of matches, the first pair that has as many, and its inliers."""
    best = np.zeros(len(p), dtype=bool)
    for i, j in combinations(range(len(p)), 2):
        dp, dq = p[j] - p[i], q[j] - q[i]
        lp, lq = np.hypot(*dp), np.hypot(*dq)
        if not (lp > 1e-3 and abs(lq / lp - 1) <= 0.05):
            continue
        th = np.arctan2(dq[1], dq[0]) - np.arctan2(dp[1], dp[0])
        rot = np.array([[np.cos(th), -np.sin(th)], [np.sin(th), np.cos(th)]])
        inside = np.hypot(*(p @ rot.T + q[i] - rot @ p[i] - q).T) < tolerance
        if inside.sum() > best.sum():
            best = inside
    return best


def test_fits_of_many_lists_are_those_of_every_pair(monkeypatch):
    """Lists are fitted together; they stop early only where no pair could do better."""
    rng = np.random.default_rng(21)
    tried, plain = [], T._inside
    monkeypatch.setattr(T, "_inside", lambda made, *rest: tried.append(len(made)) or plain(made, *rest))
    for n, wrong in ((3, 0.0), (6, 0.3), (9, 0.5), (14, 0.9), (20, 0.2)):
        p = rng.uniform(0, 600, (40, n, 2))
        th, t = rng.normal(0, 0.03, 40), rng.normal(0, 9, (40, 1, 2))
        rot = np.stack([np.cos(th), -np.sin(th), np.sin(th), np.cos(th)], axis=1).reshape(40, 2, 2)
        q = p @ rot.transpose(0, 2, 1) + t + rng.normal(0, 0.6, p.shape)
        off = rng.random((40, n)) < wrong
        q[off] = rng.uniform(0, 600, (int(off.sum()), 2))
        q[3, 1], p[4, 0] = np.nan, np.inf
        tried.clear()
        got = T.ransac_lists(p, q)
        if wrong == 0.2:
            assert sum(tried) < 40 * 30  # of 190 pairs each
        for k in range(40):
            best = every_pair(p[k], q[k])
            assert got[3, k] == (best.sum() if best.sum() >= 3 else 0)
            if best.sum() >= 3:
                turned = lambda v, a=got[0, k]: v @ np.array([[np.cos(a), np.sin(a)], [-np.sin(a), np.cos(a)]])
                rest = turned(p[k][best]) + got[1:3, k] - q[k][best]
                assert got[4, k] == pytest.approx(np.sqrt((rest**2).sum(axis=1).mean())) and np.abs(rest.mean(axis=0)).max() < 1e-9
                near = turned(p[k][best] - p[k][best].mean(axis=0))
                assert abs((near[:, 0] * rest[:, 1] - near[:, 1] * rest[:, 0]).sum()) < 1e-9 * (near**2).sum()  # no turn is left
        for name in ("PAIRS", "RESIDUALS"):
            with monkeypatch.context() as small:
                small.setattr(T, name, 50)
                np.testing.assert_array_equal(T.ransac_lists(p, q), got)


def test_selection_corner_cases(spark):
    rows = [(0, 0.5, 0.7, 0.0, True), (1, 0.5, 0.65, 0.0, True), (2, 0.9, 0.5, 0.9, True), (3, 0.5, 0.5, 0.0, False), (4, 0.5, 0.6, 0.01, True)]
    c = spark.createDataFrame(rows, "frame_idx long, level double, fg double, cloud double, aligned boolean")
    got = {r.frame_idx: r for r in G.stack_selection(c).collect()}
    assert [got[k].reject_reason for k in range(5)] == ["foreground", "foreground", "cloud", "unaligned", None]
    assert not got[2].export
    model = {r.frame_idx: r.in_model for r in G.model_frames(G.stack_selection(c)).collect()}
    assert model == {0: False, 1: False, 2: False, 3: False, 4: True}
    assert G.stack_selection(c.limit(0)).count() == 0


def test_sizes_halves_and_motion(spark):
    f = spark.createDataFrame([(0, 10, 8), (1, 10, 8), (2, 9, 8)], "frame_idx long, width int, height int")
    assert G.same_size(f).count() == 2
    c = spark.range(20).select(F.col("id").alias("frame_idx"), (F.col("id") * 60.0).alias("capture_s"))
    assert G.halves(c).groupBy("half").count().orderBy("half").collect()[0]["count"] == 10
    assert G.halves(c.limit(10)).where("half IS NOT NULL").count() == 0
    assert G.first_and_last(c).first().seconds == 19 * 60


def test_blocks_of_pixels_drop_partial_edges(spark):
    px = spark.range(7 * 5).select((F.col("id") % 7).alias("x"), F.floor(F.col("id") / 7).alias("y"), F.lit(0).alias("frame_idx"), F.lit(2.0).alias("v"))
    got = B.block_background(B.pixel_blocks(px, 2, 7, 5)).collect()
    assert len(got) == 6 and all(r.bg == 2.0 and r.noise == 0.0 and r.star == pytest.approx(-0.0035) for r in got)


def test_every_cell_is_filled_or_zero(spark):
    cells = spark.createDataFrame([(x, 0, 5.0 if x == 0 else None, x == 0) for x in range(4)], "gx int, gy int, v double, valid boolean")
    assert [r.v for r in B.fill_all(cells, 10).orderBy("gx").collect()] == [5.0] * 4
    none = cells.withColumn("valid", F.lit(False))
    assert [r.v for r in B.fill_all(none, 3).collect()] == [0.0] * 4


def test_bilinear_lookup_and_cells(spark):
    grid = spark.createDataFrame([(x, y, float(10 * y + x)) for x in range(3) for y in range(3)], "gx int, gy int, v double")
    at = spark.createDataFrame([(0, 0.5, 0.5), (1, 9.0, 9.0)], "k int, fx double, fy double")
    got = {r.k: r.v for r in B.bilinear(grid, at, F.col("fx"), F.col("fy"), 3, 3).collect()}
    assert got[0] == pytest.approx(5.5) and got[1] == pytest.approx(22.0, abs=0.05)
    gx, gy = B.cell_of(F.lit(99.0), F.lit(3.0), 32, 3, 2)
    assert tuple(spark.range(1).select(gx, gy).first()) == (2, 0)


def test_slopes_and_field(spark):
    rng = np.random.default_rng(1)
    rows = [(x, 0, float(k + 1), float((x + 1) * (k + 1) + rng.normal(0, 0.01) + (50 if k == 7 else 0))) for x in range(5) for k in range(20)]
    cells = spark.createDataFrame(rows, "gx int, gy int, level double, bg double")
    slopes = L.robust_slope(cells, ["gx", "gy"], "level", "bg")
    got = {r.gx: r.slope for r in slopes.collect()}
    assert all(abs(got[x] - (x + 1)) < 0.02 for x in range(5))
    assert {r.gx: r.t for r in L.relative_field(slopes, 5).collect()}[2] == pytest.approx(1.0, abs=0.01)
    assert L.robust_slope(cells.where("level < 5"), ["gx", "gy"], "level", "bg").where("slope IS NOT NULL").count() == 0
    assert L.lever(cells).first().lever == 20.0
    field = spark.createDataFrame([(0, 0, 0.8)], "gx int, gy int, t double")
    fixed = L.corrected(cells.where("gx = 0 AND level = 1"), field, 2.0, "bg", F.lit(1.0)).first()
    assert fixed.bg == pytest.approx(cells.where("gx = 0 AND level = 1").first().bg + 0.2 * 2.0 * 0.5)


def test_profiles(spark):
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate([None, 2.0, None, 4.0, None])], "g int, k int, v double")
    assert [r.f for r in W.fill(df, ["g"], "k", "v", "f").orderBy("k").collect()] == [2, 2, 2, 4, 4]
    assert [r.f for r in W.fill_linear(df, ["g"], "k", "v", "f").orderBy("k").collect()] == [2, 2, 3, 4, 4]


def images(spark, n=4, h=6, w=5):
    rng = np.random.default_rng(2)
    rows = [(k, 0, h, w, rng.random(h * w).tolist(), 0.0, 0.0, 0.0) for k in range(n)]
    return spark.createDataFrame(rows, "frame_idx long, session int, h int, w int, data array<double>, angle double, tx double, ty double")


def test_stacks_by_pixel_and_by_tile_agree(spark):
    moved = I.map_images(images(spark), lambda a, r: {"data": a, "cover": np.ones(a.shape, dtype=int)}, "data array<double>, cover array<bigint>", ("frame_idx", "session", "h", "w"))
    by_pixel = {(r.y, r.x): r.total for r in I.stack(moved, ["session"]).collect()}
    tile = I.stack_tiles(moved.repartition(3), ["session"]).first()
    np.testing.assert_allclose([by_pixel[k // 5, k % 5] for k in range(30)], tile.total)
    assert set(tile.cover) == {4.0}
    assert I.coverage_report(I.stack(moved, ["session"])).first().holes == 0
    assert I.warp(images(spark)).count() == 4
    assert I.global_background(images(spark), stride=3).count() == 4
    assert I.full_coverage_bounds(np.array([[1, 2, 2], [1, 2, 2]])) == (1, 0, 3, 2)


def test_window_of_warped_frames(spark):
    rows = [(k, k, 4, 4, [1.0 + (9.0 if k == 2 and i == 5 else 0.0)] * 1 if False else [10.0 if (k == 2 and i == 5) else 1.0 for i in range(16)], [False] * 16, 0.0, 0.0, 0.0) for k in range(5)]
    df = spark.createDataFrame(rows, "position long, frame_idx long, h int, w int, data array<double>, mask array<boolean>, angle double, tx double, ty double")
    got = {r.frame_idx: r for r in I.window_frames(df, 5, channels=1).collect()}
    assert len(got) == 5 and got[2].data[5] == 1.0 and got[2].used[5] == 5


def test_cleaning_a_session(spark):
    from frameloom.operators import solvers as S

    flat = np.full((12, 16), 0.5)
    model = [S.fit_glare(flat, 4, centre=(32.0, 24.0), with_surface=False) for _ in range(3)]
    df = spark.createDataFrame([(0, 8, 8, [0.5] * 192, [1.0, 1.0, 1.0])], "frame_idx long, h int, w int, data array<double>, wb array<double>")
    got = I.clean(df, model, contrast=0.5).first()
    np.testing.assert_allclose(got.data, 0.5, atol=1e-6)


def test_options():
    assert Config("in", "out").checked().export_window == 7
    assert Config("in", no_stack=True).problems()
    assert Config("in", "out", export="x", no_correction=True).problems()
    with pytest.raises(ValueError):
        Config("in", "out", max_stars=3).checked()
    assert W.half_window(6) == 3 and W.half_window(7) == 3 and W.half_window(0) == 0


def test_centre_search_in_parallel_equals_the_plain_one(spark):
    from frameloom.operators import models as M
    from frameloom.operators import solvers as S

    x, y = S.centres(20, 14, 32)
    seen = 1.0 + 0.3 * np.exp(-((np.hypot(x - 350, y - 200) / 150) ** 2))
    assert M.centre_search(spark, seen, 32, levels=1) == S.find_centre(seen, 32, levels=1)


def test_grouped_fits_equal_plain_ones(spark):
    from frameloom.operators import models as M
    from frameloom.operators import solvers as S

    rng = np.random.default_rng(8)
    grids = {k: 1.0 + 0.1 * rng.random((9, 12)) for k in range(3)}
    rows = [(k, x, y, float(g[y, x])) for k, g in grids.items() for y in range(9) for x in range(12)]
    cells = spark.createDataFrame(rows, "session int, gx int, gy int, v double").repartition(4)
    for r in M.surfaces(cells, ["session"], 12, 9, 32, 2, 2.0).collect():
        want, _ = S.fit_surface(grids[r.session], np.ones((9, 12), dtype=bool), 32, 2, 2.0, symmetric=True)
        assert r.fitted == pytest.approx(float(want.at(r.gx * 32 + 16.0, r.gy * 32 + 16.0)), abs=1e-9)
