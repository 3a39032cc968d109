"""Writing results: linear 16-bit DNG files, debug tables and pictures, report lines."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tags as T


def quantise(rgb: np.ndarray, black, white) -> np.ndarray:
    black, white = np.asarray(black, dtype=float), np.maximum(np.asarray(white, dtype=float), 1e-6)
    scaled = (rgb - black) * (65535.0 / np.maximum(white - black, 1e-6))
    return np.floor(np.clip(scaled, 0, 65535) + 0.5).astype("<u2")


def srational(matrix: np.ndarray) -> list[tuple[int, int]]:
    """Over 10000, half away from zero."""
    return [(int(np.sign(v) * np.floor(abs(v) * 10000 + 0.5)), 10000) for v in np.ravel(matrix)]


def dng(rgb: np.ndarray, camera: str = "", matrix: np.ndarray | None = None, black=(0.0, 0.0, 0.0), white=(1.0, 1.0, 1.0)) -> bytes:
    """A linear DNG of an (h, w, 3) image, little-endian, one strip.  Black and white are applied to the samples."""
    h, w = rgb.shape[:2]
    pixels = quantise(rgb, black, white).tobytes()
    matrix = np.eye(3) if matrix is None else matrix
    one = [(1, 1)] * 3
    entries: list[tuple[int, int, list]] = [
        (254, 4, [0]), (256, 4, [w]), (257, 4, [h]), (258, 3, [16, 16, 16]), (259, 3, [1]), (262, 3, [34892]),
        (273, 4, [8]), (277, 3, [3]), (278, 4, [h]), (279, 4, [len(pixels)]), (284, 3, [1]), (339, 3, [1, 1, 1]),
        (50706, 1, [1, 4, 0, 0]), (50707, 1, [1, 4, 0, 0]), (50708, 2, [camera.encode() + b"\0"]),
        (50713, 4, [1, 1]), (50714, 4, [0, 0, 0]), (50717, 4, [65535]), (50719, 5, [(0, 1), (0, 1)]), (50720, 5, [(w, 1), (h, 1)]),
        (50721, 10, srational(matrix)), (50727, 5, one), (50728, 5, one), (50730, 10, [(0, 1)]), (50778, 3, [21]), (50829, 4, [0, 0, h, w]),
    ]
    at = 8 + len(pixels) + len(pixels) % 2
    pool_at = at + 2 + 12 * len(entries) + 4
    rows, pool = b"", b""
    for tag, kind, value in entries:
        raw = T.encode(value, kind, "<")
        head = struct.pack("<HHI", tag, kind, T.count_of(value, kind))
        if len(raw) <= 4:
            rows += head + raw.ljust(4, b"\0")
        else:
            rows += head + struct.pack("<I", pool_at + len(pool))
            pool += raw + b"\0" * (len(raw) % 2)
    return b"II*\0" + struct.pack("<I", at) + pixels + b"\0" * (len(pixels) % 2) + struct.pack("<H", len(entries)) + rows + struct.pack("<I", 0) + pool


def export_name(path: Column) -> Column:
    """<stem>_clean.dng of a source path."""
    return F.concat(F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1), F.lit("_clean.dng"))


WRITTEN = "frame_idx long, path string, bytes long"


def write_dngs(frames: DataFrame, folder: str) -> DataFrame:
    """Write each image (frame_idx, name, h, w, data, camera) as a file; returns what was written.

    An optional column ``head`` (the first bytes of the source file) gives the tags to embed.

    The folder may be on any file system that pyarrow opens.  A file is written under a
    temporary name and moved into place, so a repeated task does no harm.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        files.create_dir(root, recursive=True)
        for pdf in batches:
            rows = []
            for r in pdf.itertuples():
                data = dng(np.asarray(r.data, dtype=float).reshape(r.h, r.w, 3), r.camera or "")
                head = getattr(r, "head", None)
                if head:
                    try:
                        data = T.embed(data, T.read_tags(bytes(head)))
                    except (T.NotTiff, struct.error):
                        pass  # a source without tags: the picture is whole without them
                scratch, path = f"{root}/.{uuid.uuid4().hex}", f"{root}/{r.name}"
                with files.open_output_stream(scratch, compression=None) as out:
                    out.write(data)
                files.move(scratch, path)
                rows.append((r.frame_idx, path, len(data)))
            yield pd.DataFrame(rows, columns=["frame_idx", "path", "bytes"])

    return frames.select("frame_idx", "name", "h", "w", "data", "camera", *(["head"] if "head" in frames.columns else [])).mapInPandas(run, WRITTEN)


def dump_table(df: DataFrame, path: str) -> None:
    """A debug table as CSV: a cell a line, no header."""
    df.write.mode("overwrite").csv(path)


def pgm(values: np.ndarray) -> bytes:
    """A grey picture of values in 0..1."""
    h, w = values.shape
    return b"P5\n%d %d\n255\n" % (w, h) + (np.clip(values, 0, 1) * 255).astype(np.uint8).tobytes()


def mask_pgm(mask: np.ndarray, d: int = 8) -> bytes:
    """A mask at an eighth of the size: white where any of a block is set."""
    h, w = mask.shape[0] // d, mask.shape[1] // d
    return pgm(mask[: h * d, : w * d].reshape(h, d, w, d).any(axis=(1, 3)).astype(float))


def report(spark: SparkSession, lines: list[tuple[str, str]]) -> DataFrame:
    """A run's report as a table: stage, line, warning."""
    from ..operators.catalog import is_warning

    return spark.createDataFrame(lines, "stage string, line string").withColumn("warning", is_warning(F.col("line")))
