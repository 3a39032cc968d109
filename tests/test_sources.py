"""Files: listing, containers, tags, written pictures, reports and streams."""

from __future__ import annotations

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameloom.functions import columns as C
from frameloom.operators import catalog as G
from frameloom.sources import frames as R
from frameloom.sources import sinks as W
from frameloom.sources import tags as T


def tiff(order: str, first, second) -> bytes:
    """A small TIFF head with two directories."""
    bare = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + struct.pack(order + "H", 0) + struct.pack(order + "I", 0)
    return T.embed(bare, {"first": first, "second": second})


FIRST = [(271, 2, [b"Maker\0"]), (272, 2, [b"Camera One\0"]), (306, 2, [b"2024:01:02 03:04:05\0"])]
SECOND = [(33434, 5, [(1, 30)]), (34855, 3, [6400]), (36867, 2, [b"2024:02:29 23:59:58\0"]), (37380, 10, [(-1, 3)]), (42036, 2, [b"Lens 14\0"])]


@pytest.mark.parametrize("order", ["<", ">"])
def test_tags_round_trip(order):
    data = tiff(order, FIRST, SECOND)
    got = T.read_tags(data)
    assert got["first"] == FIRST and got["second"] == SECOND
    again = T.embed(data, {"first": [(272, 2, [b"Other\0"]), (315, 2, [b"Me\0"])], "second": SECOND})
    assert T.text_of(T.read_tags(again)["first"], 272) == "Camera One"  # what is there wins
    assert T.text_of(T.read_tags(again)["first"], 315) == "Me"
    tags = [e[0] for e in T.directory(again, struct.unpack_from(order + "I", again, 4)[0], order)]
    assert tags == sorted(tags)
    assert again[8 : len(data)] == data[8:]


def test_nothing_to_add_changes_nothing_and_bad_heads_are_refused():
    data = tiff("<", FIRST, SECOND)
    assert T.embed(data, {"first": FIRST, "second": SECOND}) == data
    for bad in (b"", b"II", b"PNG00000000"):
        with pytest.raises(T.NotTiff):
            T.read_tags(bad)


def test_file_facts(spark):
    late = tiff("<", [], [(36868, 2, [b"2024:03:01 00:00:00\0"])])
    rows = [("b.cr2", tiff(">", FIRST, SECOND)), ("a.nef", tiff("<", FIRST, [])), ("c.arw", b"nonsense"), ("d.raf", late)]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: (r.source, r.capture_s) for r in R.camera_files and T.file_facts(files).collect()}
    assert got["b.cr2"] == ("Camera One + Lens 14", 1709251198)
    assert got["a.nef"] == ("Camera One", 1704164645)
    assert got["c.arw"] == ("no identifying tags", None)
    assert got["d.raf"][1] == 1709251200
    assert T.tag_rows(files).where("path = 'b.cr2' AND tag = 33434").first().value == "1/30"


def test_listing(spark, tmp_path):
    for name in ("b.CR2", "a.nef", "c.txt", "d.dng", "noext"):
        (tmp_path / name).write_bytes(name.encode())
    (tmp_path / "below").mkdir()
    (tmp_path / "below" / "e.cr2").write_bytes(b"x")
    listed = R.camera_files(spark, f"file://{tmp_path}")
    assert sorted(r.path.rsplit("/", 1)[1] for r in listed.collect()) == ["a.nef", "b.CR2", "d.dng"]
    first = G.list_frames(R.camera_files(spark, f"file://{tmp_path}"), limit=2).orderBy("frame_idx").collect()
    assert [(r.frame_idx, r.path.rsplit("/", 1)[1]) for r in first] == [(0, "a.nef"), (1, "b.CR2")]
    assert len(R.camera_files(spark, f"file://{tmp_path}", limit=1).collect()) == 1
    assert R.count_inputs(spark, f"file://{tmp_path}") == 3


def raw(seed=0):
    mosaic = np.random.default_rng(seed).integers(500, 16000, (6, 8)).astype(float)
    return R.Raw(mosaic, "GRBG", [512.0] * 4, [16383.0] * 4, [2.0, 1.0, 1.5], " Plain Cam ")


def test_plain_container_and_decoding(spark, tmp_path):
    back = R.unpack(R.pack(raw()))
    assert (back.mosaic == raw().mosaic).all() and back.pattern == "GRBG" and back.balance == [2.0, 1.0, 1.5]
    (tmp_path / "a.raw").write_bytes(R.pack(raw()))
    (tmp_path / "b.raw").write_bytes(b"broken")
    got = {r.path.rsplit("/", 1)[1]: r for r in R.decode(R.camera_files(spark, f"file://{tmp_path}")).collect()}
    assert got["a.raw"].error is None and got["a.raw"].wb == [2.0, 1.0, 1.5] and got["a.raw"].camera == "Plain Cam"
    assert len(got["a.raw"].data) == 6 * 8 * 3 and 0 <= min(got["a.raw"].data) <= max(got["a.raw"].data) <= 1
    assert got["b.raw"].error


def test_dng_is_a_tiff_with_the_samples(spark, tmp_path):
    rgb = np.array([[[0.0, 0.5, 1.0], [2.0, -1.0, 0.25]]])
    data = W.dng(rgb, "Cam", black=(0, 0, 0), white=(1, 1, 1))
    order = T.byte_order(data)
    entries = {e[0]: e for e in T.directory(data, struct.unpack_from("<I", data, 4)[0], order)}
    assert list(entries) == sorted(entries)
    assert np.frombuffer(data, "<u2", 6, 8).tolist() == [0, 32768, 65535, 65535, 0, 16384]
    frames = spark.createDataFrame([(0, "x_clean.dng", 1, 2, rgb.ravel().tolist(), "Cam")], "frame_idx long, name string, h int, w int, data array<double>, camera string")
    done = W.write_dngs(frames.withColumn("head", F.lit(tiff(">", FIRST, SECOND))), f"file://{tmp_path}/out").collect()
    assert T.text_of(T.read_tags((tmp_path / "out" / "x_clean.dng").read_bytes())["second"], 42036) == "Lens 14"
    assert done[0].bytes == (tmp_path / "out" / "x_clean.dng").stat().st_size


def test_small_expressions(spark):
    one = spark.range(1)
    row = one.select(
        W.export_name(F.lit("/a/b.c/IMG_1.CR2")).alias("name"),
        C.colour_matrix(F.array(*(F.lit(0.0) for _ in range(12)))).alias("unit"),
        C.colour_matrix(F.array(*(F.lit(float(10000 * k)) for k in range(12)))).alias("big"),
        C.matrix_srational(F.array(F.lit(0.00005), F.lit(-0.00005))).alias("half"),
        C.white_balance(F.lit(4.0), F.lit(2.0), F.lit(3.0)).alias("wb"),
        C.dawn_weight(F.lit(1.5)).alias("night"), C.dawn_weight(F.lit(2.4)).alias("day"),
        C.quantise(F.lit(0.5), F.lit(0.0), F.lit(1.0)).alias("q"),
        C.sidereal_motion(F.lit(7200.0), F.lit(7000.0)).alias("px"),
        *(v.alias(k) for k, v in zip(("lo", "hi"), C.dome_bounds(F.lit(2.0)), strict=True)),
        C.anomaly_damping(F.lit(0.1), F.lit(1.0)).alias("keep"), C.anomaly_damping(F.lit(2.0), F.lit(1.0)).alias("drop"),
        C.radial_value(F.array(F.lit(1.0), F.lit(3.0)), F.lit(96.0), 64.0).alias("past"),
        C.background_level(F.lit(0.3), F.lit(0.1), F.lit(0.5)).alias("level"),
        C.contrast_gain(F.lit(0.5), F.lit(1.0), 0.4).alias("gain"),
    ).first()
    assert row.name == "IMG_1_clean.dng"
    assert row.unit == [1, 0, 0, 0, 1, 0, 0, 0, 1] and row.big == [float(k) for k in range(9)]
    assert row.half == [1, -1] and row.wb == [2.0, 1.0, 1.5]
    assert row.night == 0.0 and row.day == 1.0 and row.q == 32768
    assert 450 < row.px < 470
    assert row.lo == pytest.approx(0.85) and row.hi == pytest.approx(2.3)
    assert row.keep == 1.0 and row["drop"] == 0.0 and row.past == 3.0
    assert row.level == pytest.approx(0.5) and row.gain == pytest.approx(1.25)


def test_report_and_pictures(spark):
    lines = {"  WARNING: few frames": True, "f1 LOAD FAILED": True, "f2 NOT ALIGNED": True, "2 frames of different dimensions": True, "1 implausible alignment": True}
    lines |= {"all is well": False, "3 skipped": False, "drift not measurable": False, "warning in small letters": False}
    got = {r.line: r.warning for r in W.report(spark, [(str(k), x) for k, x in enumerate(lines)]).collect()}
    assert got == lines
    assert W.pgm(np.array([[0.0, 2.0]])) == b"P5\n2 1\n255\n\x00\xff"
    mask = np.zeros((16, 16), dtype=bool)
    mask[9, 1] = True
    assert W.mask_pgm(mask)[-4:] == b"\x00\x00\xff\x00"


def test_arriving_files_are_measured(spark, tmp_path):
    from frameloom.streaming.arrivals import arriving, measured

    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(3):
        (folder / f"{k}.raw").write_bytes(R.pack(raw(k)))
    q = measured(arriving(spark, f"file://{folder}", a_time=2)).writeStream.format("memory").queryName("arrived").option("checkpointLocation", f"file://{tmp_path}/mark").start()
    try:
        q.processAllAvailable()
        rows = spark.table("arrived").collect()
    finally:
        q.stop()
    batch = measured(R.camera_files(spark, f"file://{folder}")).collect()
    assert sorted(r.level for r in rows) == sorted(r.level for r in batch) and len(rows) == 3
