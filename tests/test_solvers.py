"""Fits on grids with a planted truth."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from frameloom.operators import field as L
from frameloom.operators import solvers as S

BLOCK = 32


def grid(gw=60, gh=40):
    return S.centres(gw, gh, BLOCK)


def halo(x, y, cx, cy, size=600.0):
    return 0.3 * np.exp(-((np.hypot(x - cx, y - cy) / size) ** 2))


def test_smooth_model_recovers_cubic_and_halo():
    rng = np.random.default_rng(0)
    x, y = grid()
    truth = 1.0 + 0.1 * (x / 1920) + 0.05 * (y / 1280) ** 2 + halo(x, y, 1000, 620)
    seen = truth + rng.normal(0, 1e-3, truth.shape)
    seen[5:8, 5:9] += 0.5  # a cloud
    model = S.fit_smooth(seen, BLOCK, 1000, 620, 2.0 * BLOCK)
    off = np.abs(model.at(x, y) - truth)
    assert np.median(off) < 2e-3
    assert model.spread < 3e-3


def test_centre_is_found():
    x, y = grid(40, 28)
    seen = 1.0 + halo(x, y, 700, 400, 300.0)
    cx, cy = S.find_centre(seen, BLOCK, levels=2)
    assert np.hypot(cx - 700, cy - 400) < 100


def test_surface_follows_smooth_residual_and_ignores_spikes():
    rng = np.random.default_rng(1)
    x, y = grid(40, 30)
    truth = 0.05 * np.sin(x / 400) * np.cos(y / 300)
    seen = truth + rng.normal(0, 5e-4, truth.shape)
    seen[::7, ::9] += 1.0
    surface, _ = S.fit_surface(seen, np.ones_like(seen, dtype=bool), BLOCK, 2, 2.0, symmetric=True)
    assert np.median(np.abs(surface.at(x, y) - truth)) < 2e-3


def test_surface_masked_cells_never_matter():
    x, y = grid(30, 20)
    seen = 0.01 * x / 960
    ok = np.ones_like(seen, dtype=bool)
    ok[3:6, 3:6] = False
    spoiled = seen.copy()
    spoiled[3:6, 3:6] = 99.0
    a, _ = S.fit_surface(seen, ok, BLOCK, 2, 2.0)
    b, _ = S.fit_surface(spoiled, ok, BLOCK, 2, 2.0)
    np.testing.assert_allclose(a.nodes, b.nodes, atol=1e-9)


def test_agreed_keeps_what_both_halves_show():
    a, b = S.Surface(np.array([[1.0, -2.0], [0.0, 3.0]]), 1.0), S.Surface(np.array([[2.0, 2.0], [0.0, 1.0]]), 1.0)
    both, share = S.agreed(a, b)
    assert both.nodes[0, 1] == 0.0
    assert 0 <= share <= 1


def test_lines_recover_a_row_and_leave_a_flat_map_alone():
    x, y = grid()
    flat = np.zeros_like(x)
    ok = np.ones_like(x, dtype=bool)
    rng = np.random.default_rng(2)
    seen = flat + rng.normal(0, 1e-3, x.shape)
    seen[20] += 2.5e-3
    lines = S.fit_lines(seen, ok, BLOCK, 960, 640, 640)
    assert lines.rows[20] > 1.5e-3
    assert np.abs(np.delete(lines.rows, 20)).max() < 1.5e-3


def test_direction_is_found():
    x, y = grid()
    d = (x - 960) * np.cos(np.radians(40)) + (y - 640) * np.sin(np.radians(40))
    seen = np.where(d > 200, -3e-3, 0.0) + np.random.default_rng(3).normal(0, 1e-3, x.shape)  # inside the fit's band
    found = S.fit_direction(seen, np.ones_like(x, dtype=bool), BLOCK, 960, 640)
    assert min(abs(found.degrees - t) for t in (40, 220)) <= 6


def test_glare_keeps_its_pedestal_and_corrects_nothing_on_a_flat_map():
    flat = np.full((28, 40), 0.7)
    model = S.fit_glare(flat, BLOCK, centre=(640.0, 448.0))
    x, y = grid(40, 28)
    assert abs(model.pedestal - 0.7) < 1e-6
    assert np.abs(model.correction(x, y)).max() < 1e-5


def test_anomaly_modes():
    x, y = grid(40, 28)
    session = 0.5 + halo(x, y, 640, 448, 300)
    model = S.fit_glare(session, BLOCK, centre=(640.0, 448.0), with_surface=False)
    sky = np.ones_like(session, dtype=bool)
    frame = session + 0.02 * x / 1280 + 0.01
    flat = S.fit_anomaly(frame, session, sky, model, "none")
    assert flat.gain == flat.dome == 1.0 and flat.range == 0.0
    found = S.fit_anomaly(frame, session, sky, model, "full")
    assert np.median(np.abs(found.surface.at(x, y) - (frame - session))) < 3e-3
    same = S.fit_anomaly(session, session, sky, model, "full")
    assert same.range < 1e-6 and abs(same.pedestal) < 1e-9
    assert S.fit_anomaly(session * 2, session, sky, model, "coarse").gain == 1.0  # a bright frame


def test_foreground_finds_a_silhouette():
    x, y = grid(40, 28)
    seen = 0.6 + 0.1 * x / 1280
    seen[22:, 10:20] = 0.05
    mask = S.foreground(seen, BLOCK)
    assert mask[24:, 11:19].all()
    assert not mask[:15].any()


def test_flat_field_recovers_vignetting():
    gw, gh, n = 130, 100, 26  # a grid fine enough for the lens profile's innermost bin
    _, _, r = L._radius(gh, gw)
    lens = 1 - 0.35 * r**2
    rng = np.random.default_rng(4)
    level = 0.2 + 0.02 * np.arange(n)
    seen = lens * level[:, None, None] + 0.03 * np.arange(gw) / gw + rng.normal(0, 1e-4, (n, gh, gw))
    k, j, i = (a.ravel() for a in np.mgrid[:n, :gh, :gw])
    maps = pd.DataFrame({"frame_idx": k, "gx": i, "gy": j, "r": seen.ravel(), "g": seen.ravel(), "b": seen.ravel(), "level": level[k]})
    flat = L.fit_flat_field(maps, gw, gh)
    assert flat.usable and flat.lever > 2 and "applied" in flat.report()
    assert np.corrcoef(flat.t[1].ravel(), lens.ravel())[0, 1] > 0.95
    assert not L.fit_flat_field(maps[maps.frame_idx < 5], gw, gh).usable


def test_flat_fields_of_sessions_equal_the_one_machine_form(spark):
    gw, gh, n = 130, 100, 24  # the innermost bin needs a fine grid
    _, _, r = L._radius(gh, gw)
    k, j, i = (a.ravel() for a in np.mgrid[:n, :gh, :gw])
    level = 0.2 + 0.02 * np.arange(n)
    seen = ((1 - 0.35 * r**2) * level[:, None, None] + np.random.default_rng(6).normal(0, 1e-4, (n, gh, gw))).ravel()
    maps = pd.DataFrame({"frame_idx": k, "gx": i, "gy": j, "r": seen * 1.1, "g": seen, "b": seen * 0.9, "level": level[k]})
    short = maps[maps.frame_idx < 5]
    both = spark.createDataFrame(pd.concat([maps.assign(session=0), short.assign(session=1)]))
    got = L.flat_fields(both, ["session"], gw, gh).toPandas()
    want = L.fit_flat_field(maps, gw, gh)
    one = got[got.session == 0].sort_values(["gy", "gx"])
    assert one.usable.all() and want.usable and one.lever.iloc[0] == pytest.approx(want.lever)
    for c, name in enumerate("rgb"):
        np.testing.assert_allclose(one[f"t_{name}"].to_numpy().reshape(gh, gw), want.t[c], atol=1e-9)
        assert one[f"level_{name}"].iloc[0] == pytest.approx(want.level[c])
    two = got[got.session == 1]
    assert len(two) == gw * gh and not two.usable.any() and (two.t_g == 1).all()


def test_maps_and_pixels_get_back_what_the_lens_withheld(spark):
    from pyspark.sql import functions as F

    from frameloom.operators import images as I

    gw, gh, n, block = 130, 100, 24, 2
    _, _, r = L._radius(gh, gw)
    lens = 1 - 0.35 * r**2
    k, j, i = (a.ravel() for a in np.mgrid[:n, :gh, :gw])
    level = 0.2 + 0.02 * np.arange(n)
    seen = (lens * level[:, None, None] + np.random.default_rng(6).normal(0, 1e-4, (n, gh, gw))).ravel()
    maps = spark.createDataFrame(pd.DataFrame({"frame_idx": k, "gx": i, "gy": j, "r": seen, "g": seen, "b": seen}))
    levels = spark.createDataFrame([(f, float(np.median(lens) * v)) for f, v in enumerate(level)], "frame_idx long, level double")
    lit, flat, ratios = L.lifted(maps, levels, levels, gw, gh)
    assert flat.usable
    one = lit.where("frame_idx = 20").toPandas().sort_values(["gy", "gx"]).g.to_numpy()
    assert np.std(one) < 0.25 * np.std(seen[k == 20]) and len(one) == gw * gh
    picture = np.repeat(np.repeat(lens * level[20], block, 0), block, 1)
    flat_model = [S.Glare(S.Smooth(np.zeros(10), np.zeros((3, 4)), gw * 1.0, gh * 1.0, 64.0, 2.0 * gw, 2.0 * gh, 0.0), block)] * 3
    row = [(20, 2 * gh, 2 * gw, np.repeat(picture[..., None], 3, 2).ravel().tolist(), [1.0] * 3)]
    images = spark.createDataFrame(row, "frame_idx long, h int, w int, data array<double>, wb array<double>").join(ratios, "frame_idx")
    got = np.array(I.clean(images, flat_model, flat=flat).first().data)
    assert np.std(got) < 0.25 * np.std(picture)
    few, none, same = L.lifted(maps, levels, levels.where(F.col("frame_idx") < 5), gw, gh)
    assert few is maps and not none.usable and {x.flat_ratio for x in same.collect()} == {1.0}


def test_slope_keeps_what_it_had_when_x_becomes_flat():
    x = np.array([1.0] * 12 + [2.0])
    y = np.array([1.0] * 12 + [5.0])  # the only other level drops out of the second pass
    assert L._slopes(x, y[:, None])[0] == pytest.approx(4.0)
    assert np.isnan(L._slopes(np.ones(13), y[:, None])[0]) and np.isnan(L._slopes(x[:5], y[:5, None])[0])


def test_anomalies_travel_in_rows_and_are_subtracted(spark):
    from frameloom.operators import images as I
    from frameloom.operators import models as M

    x, y = grid(16, 12)
    session = 0.5 + halo(x, y, 256, 192, 150)
    model = S.fit_glare(session, BLOCK, centre=(256.0, 192.0), with_surface=False)
    one = S.fit_anomaly(session + 0.02 * x / 512, session, np.ones_like(session, dtype=bool), model)
    back = S.FrameAnomaly.unpacked(one.packed())
    k = model.correction(x, y)
    np.testing.assert_allclose(back.correction(k, x, y, 256, 192, 192), one.correction(k, x, y, 256, 192, 192))

    rows = [(f, int(gx), int(gy), *([float(v + 0.02 * f * gx / 16)] * 3)) for f in (0, 1) for gy, line in enumerate(session) for gx, v in enumerate(line)]
    cells = spark.createDataFrame(rows, "frame_idx long, gx int, gy int, r double, g double, b double")
    found = M.packed_anomalies(cells, [session] * 3, [model] * 3)
    py, px = np.mgrid[:384, :512] + 0.5
    frame = model.at(px, py) + 0.02 * px / 512
    data = np.repeat(frame[..., None], 3, axis=2).ravel().tolist()
    images = spark.createDataFrame([(1, 384, 512, data, [1.0] * 3), (2, 384, 512, data, [1.0] * 3)], "frame_idx long, h int, w int, data array<double>, wb array<double>")
    got = {r.frame_idx: np.array(r.data) for r in I.clean(images.join(found, "frame_idx", "left"), [model] * 3).collect()}
    assert np.ptp(got[1]) < 0.4 * np.ptp(got[2])  # frame 2 has no anomaly: its gradient stays
    levels = spark.createDataFrame([(1, 64, 64, (np.random.default_rng(1).random(64 * 64 * 3) + 1).tolist()), (2, 64, 64, (np.random.default_rng(1).random(64 * 64 * 3) * 2 + 3).tolist())], "frame_idx long, h int, w int, data array<double>")
    stats = I.frame_levels(levels)
    from pyspark.sql import functions as F

    ref = stats.where("frame_idx = 1").select(F.col("levels").alias("reference"))
    even = I.deflicker(levels.join(stats, "frame_idx").crossJoin(ref).withColumn("guard", F.lit(True)))
    a, b = (np.array(r.data) for r in even.orderBy("frame_idx").collect())
    np.testing.assert_allclose(a, b, atol=1e-9)


def test_lens_profile_falls_outward_and_gives_up_on_nothing():
    f = L.lens_profile(np.full((12, 16), np.nan))
    assert (f == 1).all()
    _, _, r = L._radius(24, 32)
    f = L.lens_profile(1 - 0.4 * r + 0.1 * (np.arange(32) - 15.5)[None, :] / 16)
    assert f.max() == pytest.approx(1.0) and (np.diff(f[12, 16:]) <= 1e-12).all()


def test_colour_and_smoothing():
    g = np.ones((12, 16))
    assert L.colour_spread(g, g * 1.1) == pytest.approx(0.0)
    np.testing.assert_allclose(L.smooth_field(g), g)
    np.testing.assert_allclose(L.colour_radial(g, g * 0.9), 0.9 * g, atol=0.11)


def test_gaps_and_nodes():
    np.testing.assert_allclose(S.fill_gaps(np.array([np.nan, 1, np.nan, 3, np.nan])), [1, 1, 2, 3, 3])
    assert (S.fill_gaps(np.full(3, np.nan)) == 0).all()
    s = S.smooth_nodes(S.Surface(np.ones((6, 7)), 64.0))
    np.testing.assert_allclose(s.nodes, 1.0)
