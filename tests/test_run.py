"""A whole session with planted stars, drift, sky and a bad file."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions import kernels as K
from frameloom.operators import geometry as T
from frameloom.operators import images as I
from frameloom.plans.config import Config
from frameloom.plans.run import run
from frameloom.sources import frames as R

H, W, N = 160, 224, 6


def picture(k: int) -> np.ndarray:
    """Stars that move by (1.5, -1) pixels a frame over a sky of constant level and noise."""
    rng = np.random.default_rng(77)
    x, y, flux = rng.uniform(20, W - 20, 40), rng.uniform(20, H - 20, 40), rng.uniform(8000, 20000, 40)
    yy, xx = np.mgrid[:H, :W]
    out = 6000 + np.random.default_rng(k).normal(0, 40, (H, W))
    for a, b, f in zip(x + 1.5 * k, y - 1.0 * k, flux, strict=True):
        out += f * np.exp(-((xx - a) ** 2 + (yy - b) ** 2) / 4.5)
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("session")
    for k in range(N):
        (path / f"IMG_{k:03d}.CR2").write_bytes(R.pack(R.Raw(picture(k), "RGGB")))
    (path / "IMG_900.CR2").write_bytes(b"nothing")
    (path / "notes.txt").write_bytes(b"x")
    return path


def test_tracked_session_is_stacked_and_exported(spark, folder, tmp_path):
    done = run(spark, Config(input=f"file://{folder}", output=f"file://{tmp_path}/out", export=f"file://{tmp_path}/seq", export_window=3), f"file://{tmp_path}/work")
    rows = {r.frame_idx: r for r in done.catalog.collect()}
    assert set(rows) == set(range(N)) and all(r.aligned and r.in_stack for r in rows.values())
    for k, r in rows.items():  # the planted drift
        assert abs(r.tx - 1.5 * k) < 0.4 and abs(r.ty + 1.0 * k) < 0.4 and abs(r.angle) < 0.004
        assert r.level == pytest.approx(6000 / 65535, rel=0.02)
    assert len(done.model) == 3 and done.model[1].pedestal == pytest.approx(6000 / 65535, rel=0.02)
    stack = done.stack.first()
    image = np.array(stack.data).reshape(H, W, 3)[20:-20, 20:-20, 1]
    one = np.array(done.frames.where("frame_idx = 0").first().data).reshape(H, W, 3)[20:-20, 20:-20, 1]
    sky = lambda v: v[v < np.quantile(v, 0.8)]
    assert np.std(sky(image)) < 0.7 * np.std(sky(one)) and max(stack.cover) == N
    assert (tmp_path / "out" / "stack.dng").stat().st_size > 0
    assert sorted(p.name for p in (tmp_path / "seq").iterdir()) == [f"IMG_{k:03d}_clean.dng" for k in range(N)] and done.exported.count() == N
    said = done.report.collect()
    assert [r.stage for r in said if r.warning] == ["load"] and any(r.line.startswith("6 frames stacked") for r in said)


def test_fixed_session_without_a_stack(spark, folder, tmp_path):
    done = run(spark, Config(input=f"file://{folder}", export=f"file://{tmp_path}/seq", fixed_tripod=True, no_stack=True, limit=3, keep_transients=False), f"file://{tmp_path}/work")
    assert done.stack is None and done.exported.count() == 3 and done.catalog.where("aligned").count() == 3
    with pytest.raises(ValueError):
        run(spark, Config(input="x"), f"file://{tmp_path}/w")


def test_recovery_by_session(spark):
    rows = [(s, k, k != 4, 0.0, 2.0 * k + (20.0 if k == 8 else 0.0), 1.0 * s) for s in range(3) for k in range(12)]
    df = spark.createDataFrame(rows, "session int, frame_idx long, aligned boolean, angle double, tx double, ty double").repartition(4)
    got = {(r.session, r.frame_idx): r for r in T.recovered_sessions(df, ["session"], 600.0, 400.0).collect()}
    for s in range(3):
        assert got[s, 4].source == "predicted" and got[s, 4].tx == pytest.approx(8.0)
        assert got[s, 8].source == "replaced" and got[s, 8].tx == pytest.approx(16.0)
        assert got[s, 2].source == "stars" and got[s, 2].ty == s


def test_a_trail_is_kept_and_the_drift_of_a_landscape_is_found(spark):
    rng = np.random.default_rng(5)
    combined = 0.2 + rng.normal(0, 0.002, (128, 160, 3))
    current = combined + rng.normal(0, 0.002, combined.shape)
    current[60, 30:100] += 0.3
    row = (0, 128, 160, combined.ravel().tolist(), current.ravel().tolist())
    df = spark.createDataFrame([row], "frame_idx long, h int, w int, data array<double>, current array<double>").withColumn("used", F.array_repeat(F.lit(7), 128 * 160))
    got = I.keep_transients(df).first()
    assert got.kept > 60 and np.allclose(np.array(got.data).reshape(128, 160, 3)[60, 40:90], current[60, 40:90])
    blended = I.keep_occlusions(df).first()
    assert 0.0 <= blended.share <= 1.0
    big = K.box_blur(rng.random((512, 512)), 3)
    moved = np.roll(big, (4, -6), (0, 1))
    cells = np.ones((16, 16), dtype=bool)
    pair = spark.createDataFrame([(1, 512, 512, moved.ravel().tolist()), (2, 512, 512, [0.5] * 512 * 512)], "frame_idx long, h int, w int, data array<double>")
    found = {r.frame_idx: r for r in I.drift(pair, big, cells, 32, 24).collect()}
    assert found[1].dx == pytest.approx(-6, abs=1) and found[1].dy == pytest.approx(4, abs=1) and found[2].dx is None


def test_block_maps_equal_the_grouped_form(spark):
    from frameloom.operators import background as B

    a = np.random.default_rng(3).gamma(2.0, 1.0, (70, 100))
    bg, star, noise = K.block_maps(a, 32)
    y, x = np.mgrid[:70, :100]
    rows = [(0, int(i), int(j), float(v)) for i, j, v in zip(x.ravel(), y.ravel(), a.ravel(), strict=True)]
    df = spark.createDataFrame(rows, "frame_idx int, x int, y int, v double")
    for r in B.block_background(B.pixel_blocks(df, 32, 100, 70)).collect():
        assert (r.bg, r.noise) == (bg[r.gy, r.gx], noise[r.gy, r.gx]) and r.star == pytest.approx(star[r.gy, r.gx])
