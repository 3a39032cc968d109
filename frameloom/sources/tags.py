"""TIFF/EXIF tags: reading them from camera files' heads, and embedding them in written files.

Values are (type, list of numbers or bytes); readers keep a fixed list of tags.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a file's head that are read; the pointer to the second directory.
HEAD_BYTES = 4 << 20
EXIF_POINTER = 34665
MODEL, LENS, MODIFIED, ORIGINAL, DIGITISED = 272, 42036, 306, 36867, 36868

#: Tags kept from the first directory and from the second.
FIRST_TAGS = (271, 272, 305, 306, 315, 33432)
SECOND_TAGS = (
    33434, 33437, 34850, 34855, 36867, 36868, 37377, 37378, 37380, 37381, 37383, 37384, 37385, 37386,
    41986, 41987, 41989, 42032, 42033, 42034, 42035, 42036, 42037,
)

#: Fixed values of the TIFF format: bytes per element and struct code, by type.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "s"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}
KEPT_TYPES = (1, 2, 3, 4, 5, 7, 10)


class NotTiff(ValueError):
    pass


def byte_order(head: bytes) -> str:
    if len(head) < 8:
        raise NotTiff("too short")
    if head[:2] not in (b"II", b"MM"):
        raise NotTiff("not a TIFF container")
    return "<" if head[:2] == b"II" else ">"


def decode(raw: bytes, kind: int, order: str) -> list:
    """Elements of a value: numbers, (numerator, denominator) pairs, or one bytes object."""
    size, code = TYPES[kind]
    if code == "s":
        return [raw]
    found = struct.unpack(order + code * (len(raw) // size), raw)
    return list(zip(found[::2], found[1::2], strict=True)) if len(code) == 2 else list(found)


def encode(value: list, kind: int, order: str) -> bytes:
    code = TYPES[kind][1]
    if code == "s":
        return bytes(value[0])
    flat = [x for pair in value for x in pair] if len(code) == 2 else value
    return struct.pack(order + code[0] * len(flat), *flat)


def count_of(value: list, kind: int) -> int:
    return len(value[0]) if TYPES[kind][1] == "s" else len(value)


def directory(data: bytes, at: int, order: str) -> list[tuple[int, int, int, int]]:
    """Entries (tag, type, count, place of the value field)."""
    if at + 2 > len(data):
        raise NotTiff("truncated")
    n = struct.unpack_from(order + "H", data, at)[0]
    if at + 2 + 12 * n > len(data):
        raise NotTiff("truncated")
    return [(*struct.unpack_from(order + "HHI", data, at + 2 + 12 * k), at + 10 + 12 * k) for k in range(n)]


def _values(data: bytes, entries, wanted, order: str) -> list[tuple[int, int, list]]:
    out = []
    for tag, kind, count, field in entries:
        if tag not in wanted or kind not in KEPT_TYPES:
            continue
        size = TYPES[kind][0] * count
        at = field if size <= 4 else struct.unpack_from(order + "I", data, field)[0]
        if at + size <= len(data):
            out.append((tag, kind, decode(data[at : at + size], kind, order)))
    return out


def read_tags(head: bytes) -> dict[str, list[tuple[int, int, list]]]:
    """Kept tags of the first and second directory of a file's head."""
    order = byte_order(head)
    entries = directory(head, struct.unpack_from(order + "I", head, 4)[0], order)
    second: list = []
    for tag, _, _, field in entries:
        if tag == EXIF_POINTER:
            second = directory(head, struct.unpack_from(order + "I", head, field)[0], order)
    return {"first": _values(head, entries, FIRST_TAGS, order), "second": _values(head, second, SECOND_TAGS, order)}


def text_of(tags: list[tuple[int, int, list]], tag: int) -> str | None:
    for t, kind, value in tags:
        if t == tag and kind == 2:
            return value[0].decode("utf-8", "replace").rstrip("\0").strip()
    return None


TAG_ROWS = "path string, directory string, tag int, type int, n int, value string"
FACTS = "path string, model string, lens string, modified string, original string, digitised string"


def _tag_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, head in zip(pdf.path, pdf.content, strict=True):
            try:
                found = read_tags(bytes(head[:HEAD_BYTES]))
            except (NotTiff, struct.error):
                continue
            for name, tags in found.items():
                for tag, kind, value in tags:
                    shown = value[0].decode("latin-1").rstrip("\0") if TYPES[kind][1] == "s" else " ".join(f"{v[0]}/{v[1]}" if isinstance(v, tuple) else str(v) for v in value)
                    rows.append((path, name, tag, kind, count_of(value, kind), shown))
        yield pd.DataFrame(rows, columns=["path", "directory", "tag", "type", "n", "value"])


def _facts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path, head in zip(pdf.path, pdf.content, strict=True):
            try:
                t = read_tags(bytes(head[:HEAD_BYTES]))
            except (NotTiff, struct.error):
                t = {"first": [], "second": []}
            rows.append((path, text_of(t["first"], MODEL), text_of(t["second"], LENS), text_of(t["first"], MODIFIED), text_of(t["second"], ORIGINAL), text_of(t["second"], DIGITISED)))
        yield pd.DataFrame(rows, columns=["path", "model", "lens", "modified", "original", "digitised"])


def tag_rows(files: DataFrame) -> DataFrame:
    """A row per kept tag of each file (path, content); files that aren't TIFF containers have none."""
    head = files.select("path", F.expr(f"substring(content, 1, {HEAD_BYTES})").alias("content"))
    return head.mapInPandas(_tag_rows, TAG_ROWS)


def file_facts(files: DataFrame) -> DataFrame:
    """One row per file: identifying text and capture seconds (null where there are none)."""
    from ..operators.catalog import capture_seconds, describe

    head = files.select("path", F.expr(f"substring(content, 1, {HEAD_BYTES})").alias("content"))
    found = head.mapInPandas(_facts, FACTS)
    return found.select("path", describe(F.col("model"), F.col("lens")).alias("source"), capture_seconds(F.col("original"), F.col("digitised"), F.col("modified")).alias("capture_s"))


def embed(data: bytes, tags: dict[str, list[tuple[int, int, list]]]) -> bytes:
    """The file with the tags added: a new first directory at its end.  Tags it has already stay as they are."""
    order = byte_order(data)
    at = struct.unpack_from(order + "I", data, 4)[0]
    entries = directory(data, at, order)
    have = {e[0] for e in entries}
    first = [t for t in tags["first"] if t[0] not in have]
    second = tags["second"] if EXIF_POINTER not in have else []
    if not first and not second:
        return data
    body = data + b"\0" * (len(data) % 2)
    base = len(body)
    kept = [(e[0], data[e[3] - 8 : e[3] + 4]) for e in entries]
    tail = data[at + 2 + 12 * len(entries) :][:4]
    n = len(kept) + len(first) + bool(second)
    start = base + 2 + 12 * n + 4

    def lay(items, start):
        rows, pool = [], b""
        for tag, kind, value in items:
            raw = encode(value, kind, order)
            head = struct.pack(order + "HHI", tag, kind, count_of(value, kind))
            if len(raw) <= 4:
                rows.append((tag, head + raw.ljust(4, b"\0")))
            else:
                rows.append((tag, head + struct.pack(order + "I", start + len(pool))))
                pool += raw
        return rows, pool

    rows, pool = lay(first, start)
    rows += kept
    after = start + len(pool)
    if second:
        rows.append((EXIF_POINTER, struct.pack(order + "HHII", EXIF_POINTER, 4, 1, after)))
    table = struct.pack(order + "H", n) + b"".join(r for _, r in sorted(rows, key=lambda r: r[0])) + tail + pool
    if second:
        rows2, pool2 = lay(second, after + 2 + 12 * len(second) + 4)
        table += struct.pack(order + "H", len(second)) + b"".join(r for _, r in sorted(rows2, key=lambda r: r[0])) + struct.pack(order + "I", 0) + pool2
    return body[:4] + struct.pack(order + "I", base) + body[8:] + table
