"""NPY and NPZ arrays as a panel, read in ranges of rows.

A data source on Spark's Python API. The driver reads only the headers of the files, which say where each row lies, and
deals rows into partitions as Spark does with splittable files: by bytes, and into enough parts for all cores.
A task seeks its rows and reads them in slices of a few megabytes, so no file is ever in memory as a whole.
Members of .npz files lie uncompressed in the archive (``numpy.savez``) and are sought alike; a
compressed member can't be sought and is streamed by one task.

Rows are numbered through all files in order of their paths, so ids don't collide. Arrays of rank 3 are (sample,
variable, step), those of rank 2 (sample, step); numbers of any kind become doubles.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PARTITION_BYTES, SLICE_BYTES = 128 << 20, 4 << 20
SCHEMA = "sample_id long, var_id int, x array<double>"


def open_path(path: str):
    """(pyarrow file system, path in it) of a path or URI."""
    from pyarrow import fs

    if path.startswith("file:") and not path.startswith("file://"):
        path = path[5:]
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def files_of(path: str) -> list[str]:
    """The file at ``path``, or the .npy and .npz files of a folder, in order."""
    from pyarrow import fs

    store, name = open_path(path)
    info = store.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [name]
    found = store.get_file_info(fs.FileSelector(name))
    return sorted(f.path for f in found if f.is_file and f.base_name.endswith((".npy", ".npz")) and f.base_name[0] not in "._")


@dataclass
class Rows(InputPartition):
    """Rows ``first`` to ``last`` (exclusive) of an array whose data begins at ``at`` of a file; ``at`` None: of a member that has to be unpacked."""

    path: str
    member: str | None
    at: int | None
    dtype: str
    shape: tuple[int, int, int]
    fortran: bool
    base: int
    first: int
    last: int


def header(stream) -> tuple[tuple[int, ...], bool, np.dtype]:
    """(shape, whether in Fortran order, type) of an array; the stream is left at its data."""
    version = np.lib.format.read_magic(stream)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, dtype = read(stream)
    if len(shape) not in (2, 3) or dtype.kind not in "fiub":
        raise ValueError("an array of rank 2 or 3 of real numbers is needed")
    return shape if len(shape) == 3 else (shape[0], 1, shape[1]), fortran, dtype


def array_of(store, path: str, key: str | None, base: int) -> Rows:
    """The whole array of a file as one partition."""
    with store.open_input_file(path) as f:
        if not path.endswith(".npz"):
            shape, fortran, dtype = header(f)
            return Rows(path, None, f.tell(), dtype.str, shape, fortran, base, 0, shape[0])
        with zipfile.ZipFile(f) as archive:
            info = archive.getinfo(f"{key}.npy")
            with archive.open(info) as member:
                shape, fortran, dtype = header(member)
                begin = member.tell()
        if info.compress_type != zipfile.ZIP_STORED:
            return Rows(path, info.filename, None, dtype.str, shape, fortran, base, 0, shape[0])
        f.seek(info.header_offset + 26)
        name, extra = struct.unpack("<HH", f.read(4))
        return Rows(path, None, info.header_offset + 30 + name + extra + begin, dtype.str, shape, fortran, base, 0, shape[0])


def dealt(arrays: list[Rows], most: int, parts: int) -> list[Rows]:
    """The arrays in ranges of at most ``most`` bytes, and small enough to make ``parts`` of them."""
    row = lambda a: max(1, a.shape[1] * a.shape[2] * np.dtype(a.dtype).itemsize)
    size = max(1, min(most, -(-sum(row(a) * a.shape[0] for a in arrays) // parts)))
    out = []
    for a in arrays:
        step = max(1, size // row(a)) if a.at is not None else a.shape[0]
        out += [Rows(**{**vars(a), "first": i, "last": min(i + step, a.shape[0])}) for i in range(0, a.shape[0], step or 1)]
    return out


def slices(part: Rows, store) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows as doubles) of a partition, some megabytes at a time."""
    n, v, length = part.shape
    dtype = np.dtype(part.dtype)
    step = max(1, SLICE_BYTES // max(1, v * length * 8))
    with store.open_input_file(part.path) as f:
        if part.at is None:
            yield from unpacked(part, f, step)
            return
        for lo in range(part.first, part.last, step):
            rows = min(step, part.last - lo)
            if part.fortran:  # the rows of a variable and step lie together
                out = np.empty((rows, v, length))
                for k in range(length):
                    for j in range(v):
                        f.seek(part.at + dtype.itemsize * (lo + n * (j + v * k)))
                        out[:, j, k] = np.frombuffer(f.read(rows * dtype.itemsize), dtype)
                yield lo, out
            else:
                f.seek(part.at + dtype.itemsize * lo * v * length)
                yield lo, np.frombuffer(f.read(rows * v * length * dtype.itemsize), dtype).reshape(rows, v, length).astype(float)


def unpacked(part: Rows, f, step: int) -> Iterator[tuple[int, np.ndarray]]:
    n, v, length = part.shape
    dtype = np.dtype(part.dtype)
    with zipfile.ZipFile(f) as archive, archive.open(part.member) as member:
        header(member)
        if part.fortran:  # every row is spread over the whole member, so it has to be unpacked first
            whole = np.frombuffer(member.read(), dtype).reshape(part.shape, order="F")
            yield from ((lo, whole[lo : lo + step].astype(float)) for lo in range(0, n, step))
        else:
            for lo in range(0, n, step):
                rows = min(step, n - lo)
                yield lo, np.frombuffer(member.read(rows * v * length * dtype.itemsize), dtype).reshape(rows, v, length).astype(float)


class NpyReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.key = options["path"], options.get("key")
        self.most, self.parts = int(options.get("partitionbytes", PARTITION_BYTES)), int(options.get("parts", 1))

    def partitions(self) -> list[InputPartition]:
        store, _ = open_path(self.path)
        arrays, base = [], 0
        for path in files_of(self.path):
            arrays.append(array_of(store, path, self.key, base))
            base += arrays[-1].shape[0]
        return dealt(arrays, self.most, self.parts)

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        store, _ = open_path(self.path)
        for lo, a in slices(part, store):
            n, v, length = a.shape
            x = pa.ListArray.from_arrays(pa.array(np.arange(n * v + 1, dtype=np.int32) * length), pa.array(np.ascontiguousarray(a).reshape(-1)))
            ids = np.repeat(part.base + lo + np.arange(n, dtype=np.int64), v)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.tile(np.arange(v, dtype=np.int32), n)), x], ["sample_id", "var_id", "x"])


class NpySource(DataSource):
    """``spark.read.format("npy_panel")``; options ``key`` (member of .npz files), ``partitionBytes`` and ``parts`` (at least so many partitions)."""

    @classmethod
    def name(cls) -> str:
        return "npy_panel"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpyReader:
        return NpyReader({k.lower(): v for k, v in self.options.items()})


def array_bytes(a: np.ndarray, key: str | None) -> bytes:
    out = io.BytesIO()
    np.savez(out, **{key: a}) if key else np.save(out, a)
    return out.getvalue()
