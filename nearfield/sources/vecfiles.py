"""A Spark data source of vector and raw files: .fvecs and .ivecs (rows of a 4-byte length and that many 4-byte values) and bare i32, i64 and f32 values.

Reading splits files by bytes, as rows of one file are of one length, so that a large file is many tasks' work. Writing makes one part a task under a name that only the commit turns into the final one.
Files are reached by Arrow's file systems, from the driver (names, sizes and one header a file) and from the tasks.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Element types: of a file's values and of the column.
ELEMENTS = {"fvecs": ("<f4", "float"), "ivecs": ("<i4", "int"), "i32": ("<i4", "int"), "i64": ("<i8", "long"), "f32": ("<f4", "float")}
#: Bytes of a task's part of a file, and rows of a batch.
SPLIT_BYTES, BATCH_BYTES = 64 << 20, 4 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI and the path in it; file:/x is file:///x."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return pafs.FileSystem.from_uri(path)


def reaches(path: str) -> bool:
    """Whether Arrow knows the path's kind of file system."""
    try:
        file_system(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def _files(fs: pafs.FileSystem, path: str) -> list[pafs.FileInfo]:
    """The file at path, or the files of the folder, by name; names that begin with . or _ are left out."""
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.File:
        return [info]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = fs.get_file_info(pafs.FileSelector(path))
    return sorted((f for f in found if f.type == pafs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.path)


@dataclass
class Part(InputPartition):
    """Rows of a file: their first byte, how many, the number of the first, and values a row (0: bare values)."""

    path: str
    at: int
    rows: int
    first: int
    width: int


class VectorReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.kind = options["path"], options.get("kind", "fvecs")
        self.split, self.expected = int(options.get("splitbytes", SPLIT_BYTES)), options.get("rows")

    def partitions(self) -> list[Part]:
        fs, path = file_system(self.path)
        out, before = [], 0
        for f in _files(fs, path):
            width, size = 0, np.dtype(ELEMENTS[self.kind][0]).itemsize
            if self.kind.endswith("vecs") and f.size:
                with fs.open_input_file(f.path) as file:
                    width = struct.unpack("<i", file.read(4))[0] if f.size >= 4 else 0
                size = 4 * (width + 1)
                if width <= 0 or f.size % size:
                    raise ValueError(f"{f.path}: not a whole number of vectors")
            elif f.size % size:
                raise ValueError(f"{f.path}: not a whole number of {self.kind} values")
            rows, step = f.size // size, max(1, self.split // size)
            out += [Part(f.path, at * size, min(step, rows - at), before + at, width) for at in range(0, rows, step)]
            before += rows
        if self.expected is not None and before != int(self.expected):
            raise ValueError(f"{self.path}: {before} values, not {self.expected}")
        return out or [Part("", 0, 0, 0, 0)]

    def read(self, part: Part):
        if not part.rows:
            return
        fs, _ = file_system(self.path)
        kind = ELEMENTS[self.kind][0]
        size = 4 * (part.width + 1) if part.width else np.dtype(kind).itemsize
        step = max(1, BATCH_BYTES // size)
        with fs.open_input_file(part.path) as file:
            for k in range(0, part.rows, step):
                n = min(step, part.rows - k)
                data, ids = file.read_at(n * size, part.at + k * size), pa.array(np.arange(part.first + k, part.first + k + n))
                if not part.width:
                    yield pa.RecordBatch.from_arrays([ids, pa.array(np.frombuffer(data, kind))], ["row", "value"])
                    continue
                m = np.frombuffer(data, "<i4").reshape(n, part.width + 1)
                if (m[:, 0] != part.width).any():
                    raise ValueError(f"{part.path}: vectors of different lengths")
                flat = np.ascontiguousarray(m[:, 1:]).view(kind).ravel()
                first = pa.array(np.arange(n + 1, dtype=np.int32) * part.width)
                yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(first, pa.array(flat))], ["vec_id", "embedding"])


@dataclass
class Written(WriterCommitMessage):
    """A task's part: its own name, the final one, rows, and values a row."""

    name: str
    final: str
    rows: int
    width: int


class VectorWriter(DataSourceArrowWriter):
    """A part a task, in the order of partitions; overwrite takes away files that were there before, once all parts are written. The file _rows has the number of all rows."""

    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.kind, self.overwrite = options["path"], options.get("kind", "fvecs"), overwrite
        self.run = uuid.uuid4().hex

    def write(self, batches) -> Written:
        fs, path = file_system(self.path)
        fs.create_dir(path, recursive=True)
        task, kind = TaskContext.get(), ELEMENTS[self.kind][0]
        final = f"part-{self.run[:12]}-{task.partitionId():06d}.{self.kind}"
        name, rows, width = f".{final}-{task.taskAttemptId()}", 0, 0
        with fs.open_output_stream(posixpath.join(path, name)) as out:
            for b in batches:
                col = b.column(b.num_columns - 1)
                if col.null_count:
                    raise ValueError("a null can't be written")
                if self.kind.endswith("vecs"):
                    n, flat, lengths = len(col), col.flatten(), np.unique(np.asarray(col.value_lengths()))
                    if n and (flat.null_count or len(lengths) > 1 or not lengths[0] or width not in (0, lengths[0])):
                        raise ValueError("vectors must have one length above 0 and no nulls")
                    width = int(lengths[0]) if n else width
                    m = np.empty((n, width + 1), "<i4")
                    m[:, 0] = width
                    m[:, 1:] = flat.to_numpy(zero_copy_only=False).astype(kind).reshape(n, width).view("<i4")
                    out.write(m.tobytes())
                else:
                    out.write(col.to_numpy(zero_copy_only=False).astype(kind).tobytes())
                rows += len(col)
        return Written(name, final, rows, width)

    def commit(self, messages: list[Written | None]) -> None:
        fs, path = file_system(self.path)
        done = [m for m in messages if m is not None]
        if len({m.width for m in done if m.rows}) > 1:
            raise ValueError("vectors of different lengths")
        before, count, rows = _files(fs, path) if self.overwrite else [], posixpath.join(path, "_rows"), 0
        if not self.overwrite and fs.get_file_info(count).type == pafs.FileType.File:
            with fs.open_input_file(count) as file:
                rows = int(file.read())
        for m in done:
            if m.rows:
                fs.move(posixpath.join(path, m.name), posixpath.join(path, m.final))
            else:
                fs.delete_file(posixpath.join(path, m.name))
        for f in before:
            fs.delete_file(f.path)
        with fs.open_output_stream(count) as out:
            out.write(str(rows + sum(m.rows for m in done)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, path = file_system(self.path)
        for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
            if self.run[:12] in f.base_name:
                fs.delete_file(f.path)


class VectorFiles(DataSource):
    """Format vecfiles; options: path, kind (a key of ELEMENTS, fvecs by default), splitBytes, rows (how many there must be). Ids go on from file to file by name."""

    @classmethod
    def name(cls) -> str:
        return "vecfiles"

    def schema(self) -> str:
        kind = self.options.get("kind", "fvecs")
        element = ELEMENTS[kind][1]
        return f"vec_id long, embedding array<{element}>" if kind.endswith("vecs") else f"row long, value {element}"

    def reader(self, schema) -> VectorReader:
        return VectorReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> VectorWriter:
        return VectorWriter(dict(self.options), overwrite)
