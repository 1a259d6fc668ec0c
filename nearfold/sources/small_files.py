"""Many small text files as a table, both ways, on file systems that Arrow can open.

``packed_files`` reads: the driver lists names and sizes and packs files into partitions by bytes, each file counted with
the cost of opening it; a file larger than a partition is cut into byte ranges, so that it becomes several rows of
one path and no task has to hold it. A range takes the characters that begin in it. Conditions on the path are applied
to the list of names when Spark hands them on (``spark.sql.python.filterPushdown.enabled``), and by Spark otherwise.

``keyed_files`` writes: one file per row, named by the row. A task writes a file under a folder of its attempt and then moves
it to its name in the job's pending folder, so that a name never stands for half a file, however often a task is
tried. The driver makes the pending folder the result with one move, or removes it when the job fails.

Spark's own readers serve file systems that Arrow cannot open.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds

PACK_BYTES = 128 * 1024 * 1024
#: What opening a file costs, in bytes that could be read meanwhile.
OPEN_BYTES = 1024 * 1024
#: Text in a batch that a task hands on.
BATCH_BYTES = 4 * 1024 * 1024
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

_COLUMNS = "path string, part int, size long, text string"


def locate(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what to put before such a path to name it in Spark)."""
    if path.startswith("file:"):
        inner = "/" + path.removeprefix("file:").lstrip("/")
        return fs.LocalFileSystem(), inner, "file://"
    if "://" not in path:
        return fs.LocalFileSystem(), posixpath.abspath(path), "file://"
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)] if path.endswith(inner) else path.split("://")[0] + "://"


@dataclass
class Share(ds.InputPartition):
    """What one task reads: (root, path, part, begin, end, size) per piece of a file."""

    pieces: list[tuple[str, str, int, int, int, int]]


def packed(files: list[tuple[str, str, int]], pack_bytes: int, split: bool = True, part_bytes: int | None = None) -> list[Share]:
    """Files (root, path, size) in order, as shares of about ``pack_bytes``; if ``split``, files larger than
    ``part_bytes`` (``pack_bytes`` unless given) are cut."""
    shares, now, held = [], [], 0
    for root, path, size in files:
        step = (part_bytes or pack_bytes) if split else max(size, 1)
        for part, begin in enumerate(range(0, max(size, 1), step)):
            end = min(begin + step, size)
            if now and held + end - begin + OPEN_BYTES > pack_bytes:
                shares.append(Share(now))
                now, held = [], 0
            now.append((root, path, part, begin, end, size))
            held += end - begin + OPEN_BYTES
    return [*shares, Share(now)] if now else shares


def _is_inside(byte: int) -> bool:
    """Whether a byte continues a UTF-8 character."""
    return byte & 0xC0 == 0x80


def read_range(system: fs.FileSystem, path: str, begin: int, end: int, size: int) -> str:
    """The characters that begin in bytes ``begin`` to ``end``; invalid bytes become replacement characters."""
    with system.open_input_file(path) as file:
        data = file.read_at(min(end + 3, size) - begin, begin)
    first = 0
    while begin and first < min(3, len(data)) and _is_inside(data[first]):
        first += 1
    last = end - begin
    while last < len(data) and _is_inside(data[last]):
        last += 1
    return data[first:last].decode("utf-8", "replace")


class PackedReader(ds.DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.roots = json.loads(options["roots"])
        self.glob = options.get("glob")
        self.pack_bytes = int(options.get("pack_bytes", PACK_BYTES))
        self.split = options.get("split", "true") == "true"
        self.part_bytes = int(options.get("part_bytes", self.pack_bytes))
        self.asked: list[tuple[str, object]] = []

    def partitions(self) -> list[Share]:
        files = []
        for root in self.roots:
            system, inner, prefix = locate(root)
            info = system.get_file_info(inner)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(root)
            found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
            for f in found:
                hidden = any(p.startswith((".", "_")) for p in posixpath.relpath(f.path, inner).split("/") if p != ".")
                if f.is_file and not hidden and (not self.glob or fnmatch.fnmatchcase(f.base_name, self.glob)) and self._kept(prefix + f.path):
                    files.append((root, f.path, f.size))
        return packed(sorted(files), self.pack_bytes, self.split, self.part_bytes) or [Share([])]

    def _kept(self, path: str) -> bool:
        tests = {
            "equal": lambda v: path == v, "in": lambda v: path in v, "starts": path.startswith, "ends": path.endswith, "contains": lambda v: v in path,
        }
        return all(tests[kind](value) for kind, value in self.asked)

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, int, str]] = []
        held = 0
        for root, path, part, begin, end, size in partition.pieces:
            system, _, prefix = locate(root)
            text = read_range(system, path, begin, end, size)
            rows.append((prefix + path, part, size, text))
            held += end - begin
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple[str, int, int, str]]) -> pa.RecordBatch:
    types = (pa.string(), pa.int32(), pa.int64(), pa.string())
    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(columns, ["path", "part", "size", "text"])


class PushingReader(PackedReader):
    """Also takes conditions on the path."""

    KINDS = ((ds.EqualTo, "equal"), (ds.In, "in"), (ds.StringStartsWith, "starts"), (ds.StringEndsWith, "ends"), (ds.StringContains, "contains"))

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            kind = next((name for cls, name in self.KINDS if isinstance(f, cls)), None)
            if kind and f.attribute == ("path",):
                self.asked.append((kind, f.value))
            elif not (isinstance(f, ds.IsNotNull) and f.attribute == ("path",)):
                yield f


class PackedFiles(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed_files"

    def schema(self) -> str:
        return _COLUMNS

    def reader(self, schema) -> ds.DataSourceReader:
        return (PushingReader if self.options.get("pushdown") == "true" else PackedReader)(dict(self.options))


def packed_files(spark: SparkSession, paths: str | list[str], glob: str | None = None, pack_bytes: int = PACK_BYTES, split: bool = True, part_bytes: int | None = None) -> DataFrame:
    """(path, part, size, text) of every file at any depth below ``paths`` whose name matches ``glob``.

    Names and folders that begin with a dot or an underscore are left out. A file larger than ``part_bytes``
    (``pack_bytes`` unless given) is several rows, numbered by ``part`` from 0, or one row if not ``split``.
    A task reads about ``pack_bytes``, however small the parts.
    """
    spark.dataSource.register(PackedFiles)
    roots = [paths] if isinstance(paths, str) else list(paths)
    options = {"roots": json.dumps(roots), "pack_bytes": str(pack_bytes), "split": str(split).lower(), "pushdown": spark.conf.get(PUSHDOWN, "false")}
    if part_bytes:
        options["part_bytes"] = str(part_bytes)
    if glob:
        options["glob"] = glob
    return spark.read.format("packed_files").options(**options).load()


@dataclass
class Written(ds.WriterCommitMessage):
    files: int


class KeyedWriter(ds.DataSourceArrowWriter):
    def __init__(self, root: str, overwrite: bool) -> None:
        self.root, self.overwrite = root.rstrip("/"), overwrite
        self.pending = f"{self.root}.pending-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, pending, _ = locate(self.pending)
        attempt = f"{pending}/_attempt-{uuid.uuid4().hex}"
        made, files = set(), 0
        for batch in iterator:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not name or name.startswith(("/", ".", "_")) or ".." in name.split("/"):
                    raise ValueError(f"{name!r} cannot be a file below {self.root}")
                for place in (attempt, posixpath.dirname(f"{pending}/{name}")):
                    if place not in made:
                        system.create_dir(place, recursive=True)
                        made.add(place)
                half = f"{attempt}/{files}"
                with system.open_output_stream(half) as out:
                    out.write((text or "").encode())
                system.move(half, f"{pending}/{name}")
                files += 1
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, pending, _ = locate(self.pending)
        _, root, _ = locate(self.root)
        system.create_dir(pending, recursive=True)
        for f in system.get_file_info(fs.FileSelector(pending)):
            if f.base_name.startswith("_attempt-"):
                system.delete_dir(f.path)
        if system.get_file_info(root).type != fs.FileType.NotFound:
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(self.root)
            system.delete_dir(root)
        system.create_dir(posixpath.dirname(root), recursive=True)
        system.move(pending, root)

    def abort(self, messages: list[Written | None]) -> None:
        system, pending, _ = locate(self.pending)
        if system.get_file_info(pending).type != fs.FileType.NotFound:
            system.delete_dir(pending)


class KeyedFiles(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema, overwrite: bool) -> ds.DataSourceArrowWriter:
        return KeyedWriter(self.options["path"], overwrite)


def write_keyed(files: DataFrame, path: str, overwrite: bool = True) -> None:
    """Write every row of (name, text) to the file ``name`` below ``path``; a null text is an empty file.

    Names must differ; of equal ones any one stays. Nothing is left behind when the job fails, and an
    earlier result stays until the new one is complete.
    """
    files.sparkSession.dataSource.register(KeyedFiles)
    mode = "overwrite" if overwrite else "append"
    files.select("name", "text").write.format("keyed_files").option("path", path).mode(mode).save()
