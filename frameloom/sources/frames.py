"""Reading frames: camera files as bytes, a pluggable decoder, and a plain container for raw mosaics.

Camera formats are not decoded here: their decoders are external.  ``decode`` takes any function
from bytes to Raw; ``unpack`` reads the plain container that ``pack`` writes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import demosaic, normalise_raw
from ..operators.catalog import is_raw

#: Head of the plain container: magic, width, height, pattern, 4 black and 4 white levels, 3 white-balance factors, length of the name.
MAGIC = b"FLMRAW1\0"
_HEAD = struct.Struct("<8sII4s4f4f3fH")


@dataclass
class Raw:
    """A mosaic as the sensor has it."""

    mosaic: np.ndarray
    pattern: str
    black: list[float] = field(default_factory=lambda: [0.0] * 4)
    white: list[float] = field(default_factory=lambda: [65535.0] * 4)
    balance: list[float] = field(default_factory=lambda: [1.0] * 3)
    camera: str = ""


def pack(raw: Raw) -> bytes:
    h, w = raw.mosaic.shape
    name = raw.camera.encode()
    head = _HEAD.pack(MAGIC, w, h, raw.pattern.encode(), *raw.black, *raw.white, *raw.balance, len(name))
    return head + name + np.clip(raw.mosaic, 0, 65535).astype("<u2").tobytes()


def unpack(data: bytes) -> Raw:
    magic, w, h, pattern, *rest = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a plain mosaic container")
    n = rest[-1]
    at = _HEAD.size + n
    mosaic = np.frombuffer(data, "<u2", w * h, at).reshape(h, w)
    return Raw(mosaic, pattern.decode(), list(rest[:4]), list(rest[4:8]), list(rest[8:11]), data[_HEAD.size : at].decode())


FRAME = "path string, w int, h int, data array<double>, wb array<double>, camera string, error string"


def developed(raw: Raw) -> tuple[np.ndarray, list[float]]:
    """Colour image in 0..1 and the balance ratios to green."""
    values = np.clip(raw.mosaic, 0, 65535) if raw.mosaic.dtype.kind == "f" else raw.mosaic
    rgb = demosaic(normalise_raw(values.astype(float), raw.black, raw.white), raw.pattern)
    g = max(raw.balance[1], 1.0)
    return rgb, [raw.balance[0] / g, 1.0, raw.balance[2] / g]


def _decode(decoder: Callable[[bytes], Raw]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content, strict=True):  # one image a batch: they are large
                try:
                    raw = decoder(bytes(content))
                    rgb, wb = developed(raw)
                    row = (path, rgb.shape[1], rgb.shape[0], rgb.ravel(), wb, raw.camera.strip(), None)
                except (ValueError, struct.error) as e:
                    row = (path, 0, 0, [], [], None, str(e))
                yield pd.DataFrame([row], columns=["path", "w", "h", "data", "wb", "camera", "error"])

    return run


def camera_files(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """Files of a folder (not below it) with a camera extension, in path order: path, content.

    The limit applies to the listing, before any file's bytes are read.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    names = listed.select("path").where(is_raw(F.col("path")))
    if limit is None:
        return listed.where(is_raw(F.col("path"))).select("path", "content")
    first = names.orderBy("path").limit(limit)  # ``limit`` names
    return listed.select("path", "content").join(F.broadcast(first), "path", "left_semi")


def decode(files: DataFrame, decoder: Callable[[bytes], Raw] = unpack) -> DataFrame:
    """Frames of files: path, w, h, data (r, g, b interleaved), wb, camera, error (null when decoded)."""
    return files.select("path", "content").mapInPandas(_decode(decoder), FRAME)


def count_inputs(spark: SparkSession, folder: str) -> int:
    return spark.read.format("binaryFile").load(folder).select("path").where(is_raw(F.col("path"))).count()
