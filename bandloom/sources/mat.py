"""MATLAB 5 files with an image cube and, in another file, its labels.

``images`` reads whatever Spark's file systems open: each file is inflated once, as a stream, in the task that has it, and
leaves it in pieces of ranges of rows, which other tasks make pixels of.

``spark.read.format("mat").option("path", ...).option("variable", ...)`` reads ranges of rows of a file on a mounted path, without
a task that has the whole file; a compressed variable is inflated up to its range's end for each column there.

Both give ``row, col, spectrum``; a 2-D variable's values are spectra of one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Data types of the format.
TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
MATRIX, COMPRESSED = 14, 15
#: Rows of an image in one partition.
ROWS = 64
# Variables of the known images (cube, labels).
DATASETS = {
    "indian_pines": ("indian_pines_corrected", "indian_pines_gt"),
    "pavia": ("pavia", "pavia_gt"),
    "botswana": ("Botswana", "Botswana_gt"),
    "KSC": ("KSC", "KSC_gt"),
    "salinas": ("salinas_corrected", "salinas_gt"),
}


#: Bytes of a range of rows, as doubles, that a task makes pixels of; and of the piece that is cut into such ranges at a time.
SLAB = 16 << 20
PIECE = 4 << 20
#: Bytes of a variable that hold its name and shape.
HEAD = 4096


def _elements(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<II", data, at)
        if kind >> 16:  # small elements hold their bytes in the tag
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
        else:
            yield kind, data[at + 8 : at + 8 + size]
            at += 8 + size + (-size % 8 if kind != COMPRESSED else 0)


def _header(head: bytes) -> tuple[str, tuple[int, ...], str, int] | None:
    """Name, shape, type and the values' place of a variable, from its first bytes; None for what is no numeric array."""
    if len(head) < 8 or struct.unpack_from("<I", head)[0] != MATRIX:
        return None
    body, at = head[8:], 8
    parts = []
    for kind, value in _elements(body[: HEAD - 8]):
        small = struct.unpack_from("<I", head, at)[0] >> 16
        parts.append((kind, value, at + (4 if small else 8)))
        at += 8 if small else 8 + len(value) + -len(value) % 8
        if len(parts) == 4:
            break
    if len(parts) < 4 or parts[3][0] not in TYPES:
        return None
    (_, dims, _), (_, name, _), (kind, _, start) = parts[1:]
    return name.decode(), tuple(np.frombuffer(dims, "<i4").tolist()), "<" + TYPES[kind], start


def _found(file: BinaryIO, variable: str) -> tuple[tuple[int, ...], str, int, int, bool]:
    """Shape and type of a variable, the values' place in it, its place in the file and whether it is compressed. Others are skipped unread."""
    at = 128
    while True:
        file.seek(at)
        tag = file.read(8)
        if len(tag) < 8:
            raise ValueError(f"no variable {variable} in {getattr(file, 'name', 'a file')}")
        kind, size = struct.unpack("<II", tag)
        packed = kind == COMPRESSED
        head = zlib.decompressobj().decompress(file.read(min(size, HEAD)), HEAD) if packed else tag + file.read(min(size, HEAD - 8))
        if (header := _header(head)) and header[0] == variable:
            return *header[1:], at, packed
        at += 8 + size + (0 if packed else -size % 8)


def rows_of(path: str, variable: str, first: int, last: int) -> np.ndarray:
    """Rows [first, last) of a variable as rows x columns x bands. Rows are the fastest index of the format, so columns are
    read one by one and only their wanted rows are kept; a compressed variable is inflated as a stream."""
    with open(path, "rb") as file:
        shape, kind, start, at, packed = _found(file, variable)
        height, width = shape[0], int(np.prod(shape[1:]))
        item = np.dtype(kind).itemsize
        first, last = max(first, 0), min(last, height)
        out = np.empty((max(last - first, 0), width))
        if packed:
            file.seek(at + 8)
            stream = _Inflated(file)
            stream.take(start)
        for c in range(width):
            if packed:
                values = stream.take(height * item)[first * item : last * item]
            else:
                file.seek(at + start + (c * height + first) * item)
                values = file.read((last - first) * item)
            out[:, c] = np.frombuffer(values, kind)
        bands = shape[2] if len(shape) > 2 else 1
        return out.reshape(len(out), bands, shape[1]).transpose(0, 2, 1)


class _Inflated:
    """Bytes of a compressed file from where it stands, in order."""

    def __init__(self, file: BinaryIO):
        self.file, self.inflate, self.held = file, zlib.decompressobj(), bytearray()

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            packed = self.inflate.unconsumed_tail or self.file.read(1 << 16)
            got = self.inflate.decompress(packed, 1 << 20)
            if not packed and not got:
                raise ValueError("the file ends within a variable")
            self.held += got
        got = bytes(self.held[:n])
        del self.held[:n]
        return got


class MatDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mat"

    def schema(self) -> str:
        return "row int, col int, spectrum array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["variable"])


class _Reader(DataSourceReader):
    def __init__(self, path: str, variable: str):
        self.path, self.variable = path.removeprefix("file://"), variable

    def partitions(self) -> list[InputPartition]:
        """Ranges of rows, from the variable's header alone."""
        with open(self.path, "rb") as file:
            height = _found(file, self.variable)[0][0]
        return [InputPartition(at) for at in range(0, height, ROWS)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        array = rows_of(self.path, self.variable, partition.value, partition.value + ROWS)
        height, width, bands = array.shape
        rows = np.repeat(np.arange(partition.value, partition.value + height), width).astype(np.int32)
        cols = np.tile(np.arange(width), height).astype(np.int32)
        spectra = pa.ListArray.from_arrays(np.arange(0, height * width * bands + 1, bands, dtype=np.int32), np.ascontiguousarray(array).ravel())
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(cols), spectra], ["row", "col", "spectrum"])


def _pieces(variable: str):
    """Cuts a file's variable, columns by columns as they stand in it, into pieces of ranges of rows."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path, content in ((p, c) for b in batches for p, c in zip(b.column(0).to_pylist(), b.column(1))):
            file = pa.BufferReader(content.as_buffer())
            shape, kind, start, at, packed = _found(file, variable)
            height, width, bands = shape[0], shape[1], int(np.prod(shape[2:]))
            item, columns = np.dtype(kind).itemsize, width * bands
            if packed:
                file.seek(at + 8)
                stream = _Inflated(file)
                stream.take(start)
            else:
                file.seek(at + start)
            lines, some = max(1, SLAB // max(1, 8 * columns)), max(1, PIECE // max(1, item * height))
            firsts = list(range(0, height, lines))
            for c in range(0, columns, some):
                size = min(some, columns - c) * height * item
                values = np.frombuffer(stream.take(size) if packed else file.read(size), kind).reshape(-1, height)
                parts = [np.ascontiguousarray(values[:, f : f + lines]).tobytes() for f in firsts]
                same = {"path": path, "at": c, "lines": lines, "width": width, "height": height, "kind": kind}
                rows = [same | {"first": f, "values": part} for f, part in zip(firsts, parts)]
                yield pa.RecordBatch.from_pylist(rows, _PIECES)

    return cut


_PIECES = pa.schema([("path", pa.string()), ("first", pa.int32()), ("at", pa.int64()), ("lines", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("kind", pa.string()), ("values", pa.binary())])


def _pixels(pieces: pd.DataFrame) -> pd.DataFrame:
    """The pixels of a range of rows from all its pieces."""
    head = pieces.iloc[0]
    lines, width, first = min(head.lines, head.height - head["first"]), int(head.width), int(head["first"])
    grid = np.concatenate([np.frombuffer(v, head.kind).reshape(-1, lines) for v in pieces.sort_values("at")["values"]])
    spectra = grid.reshape(-1, width, lines).transpose(2, 1, 0).astype(float).reshape(lines * width, -1)
    return pd.DataFrame({"path": head.path, "row": np.repeat(np.arange(first, first + lines), width), "col": np.tile(np.arange(width), lines), "spectrum": list(spectra)})


def images(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """``path, row, col, spectrum`` of a variable of every file at ``path``, which may be a folder or a pattern, on any of Spark's file systems.

    A file's own bytes, which its format keeps near 2 GB, stand in one task, as what is compressed can only be read from
    its start; nothing else does: what is inflated leaves in pieces of PIECE bytes, and a task makes pixels of SLAB bytes.
    A file without the variable is an error.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kinds = {pa.string(): "string", pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    pieces = files.mapInArrow(_pieces(variable), ", ".join(f"{f.name} {kinds[f.type]}" for f in _PIECES))
    return pieces.groupBy("path", "first").applyInPandas(_pixels, "path string, row int, col int, spectrum array<double>")


def load(spark: SparkSession, dataset: str, cube_path: str, label_path: str) -> DataFrame:
    """The pixels of a known image, from any of Spark's file systems; another name is an error."""
    if dataset not in DATASETS:
        raise ValueError(f"unknown image {dataset!r}; known are {', '.join(DATASETS)}")
    cube, labels = (images(spark, p, v).drop("path") for p, v in zip((cube_path, label_path), DATASETS[dataset]))
    width = (labels.agg(F.max("col")).first()[0] or 0) + 1
    labels = labels.select("row", "col", F.element_at("spectrum", 1).cast("int").alias("label"))
    return cube.join(labels, ["row", "col"]).select((F.col("row").cast("long") * width + F.col("col")).alias("pixel_id"), "row", "col", "label", "spectrum")
