"""Results of stages that are kept and used again while their inputs and parameters are the same.

A stage's table lies under its name and a fingerprint of what it was made from: parameters, and of every input either
the rows (a table: their number and order-free sums of two hashes, one pass) or the files (a path: names, sizes and
times). It is written beside its place and moved there in one step, so that what is there is whole. When a stage is
made anew, tables of the same name with other fingerprints are removed; so change a name to keep both.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Callable, Sequence

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfold.sources.small_files import locate


def rows_fingerprint(df: DataFrame) -> str:
    """Equal for tables with the same columns and rows, in any order; repeated rows count."""
    columns = sorted(df.dtypes)
    row = [F.col(f"`{name}`") for name, _ in columns]
    wide = "decimal(38,0)"
    sums = [F.sum(F.xxhash64(*row, F.lit(salt)).cast(wide)).alias(f"h{salt}") for salt in (1, 2)]
    found = df.agg(F.count("*").alias("n"), *sums).head()
    return _digest([columns, [str(v) for v in found]])


def files_fingerprint(path: str) -> str:
    """Equal while the files below ``path`` keep their names, sizes and times."""
    system, inner, _ = locate(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(inner, recursive=True))
    return _digest(sorted((f.path, f.size, f.mtime_ns) for f in found if f.is_file))


def _digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:32]


class Stages:
    """Stage tables below ``root``, a folder that every executor and Arrow can reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        #: Names of the stages that were made and that were used again, in order.
        self.made: list[str] = []
        self.reused: list[str] = []

    def table(self, name: str, build: Callable[[], DataFrame], inputs: Sequence[DataFrame | str], **parameters: object) -> DataFrame:
        """The stage's table, from ``build`` unless one with the same inputs and parameters is there.

        ``parameters`` must say all that ``build`` depends on besides the inputs.
        """
        if not re.fullmatch("[a-z0-9_]+", name):
            raise ValueError(f"{name!r} is no stage name")
        marks = [files_fingerprint(i) if isinstance(i, str) else rows_fingerprint(i) for i in inputs]
        path = f"{self.root}/{name}-{_digest([marks, parameters])}"
        system, inner, _ = locate(path)
        if system.get_file_info(inner).type == fs.FileType.NotFound:
            pending = f"{path}.pending-{uuid.uuid4().hex}"
            build().write.parquet(pending)
            if system.get_file_info(inner).type == fs.FileType.NotFound:
                system.move(locate(pending)[1], inner)
            else:  # another run was faster
                system.delete_dir(locate(pending)[1])
            self._remove_others(system, name, inner)
            self.made.append(name)
        else:
            self.reused.append(name)
        return self.spark.read.parquet(path)

    def _remove_others(self, system: fs.FileSystem, name: str, kept: str) -> None:
        own = re.compile(re.escape(name) + "-[0-9a-f]{32}")
        for f in system.get_file_info(fs.FileSelector(locate(self.root)[1])):
            if own.fullmatch(f.base_name) and f.path != kept:
                system.delete_dir(f.path)
