"""Small files packed into partitions, and files written under their own names."""

from __future__ import annotations

import os
import random

import pyarrow as pa
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from nearfold.operators.program_parts import instruction_count_of_parts
from nearfold.operators.program_text import instruction_count
from nearfold.sources import readers
from nearfold.sources import small_files as sf


def files(root) -> dict[str, str]:
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), newline="").read() for d, _, names in os.walk(root) for n in names}


@pytest.fixture
def written(spark, tmp_path):
    rows = [(f"a{i % 3}/f{i}.txt", "é€😀x"[: i % 5] * i) for i in range(40)] + [("top.txt", None), ("notes.md", "skip")]
    root = str(tmp_path / "out")
    sf.write_keyed(spark.createDataFrame(rows, "name string, text string").repartition(5), root)
    return root, {n: t or "" for n, t in rows}


def test_round_trip(spark, written):
    root, rows = written
    assert files(root) == rows and os.listdir(os.path.dirname(root)) == ["out"]
    for pack_bytes, split in ((1 << 27, True), (100, True), (100, False)):
        found = sf.packed_files(spark, root, "*.txt", pack_bytes, split).collect()
        texts: dict = {}
        for r in sorted(found, key=lambda r: (r.path, r.part)):
            texts[os.path.relpath(r.path.removeprefix("file://"), root)] = texts.get(os.path.relpath(r.path.removeprefix("file://"), root), "") + r.text
        assert texts == {n: t for n, t in rows.items() if n.endswith(".txt")}
        assert (len(found) > len(texts)) == (split and pack_bytes == 100)
    assert sf.packed_files(spark, [f"file://{root}/a1", f"{root}/top.txt"]).count() == 14


def test_files_are_packed_by_bytes():
    share = sf.packed([("r", f"f{i}", 10) for i in range(1000)], 16 * sf.OPEN_BYTES)
    assert len(share) == 67 and sum(len(s.pieces) for s in share) == 1000
    big = sf.packed([("r", "a", 5), ("r", "b", 250), ("r", "c", 0)], 100)
    assert [p[1:5] for s in big for p in s.pieces] == [("a", 0, 0, 5), ("b", 0, 0, 100), ("b", 1, 100, 200), ("b", 2, 200, 250), ("c", 0, 0, 0)]
    assert sf.packed([], 100) == []


def test_ranges_cut_no_character(tmp_path):
    rng = random.Random(1)
    text = "".join(rng.choice("aé€😀\n\r") for _ in range(300))
    (tmp_path / "f").write_bytes(text.encode())
    size = len(text.encode())
    system = fs.LocalFileSystem()
    for step in (1, 2, 3, 5, 64, size):
        parts = [sf.read_range(system, str(tmp_path / "f"), b, min(b + step, size), size) for b in range(0, size, step)]
        assert "".join(parts) == text
    (tmp_path / "bad").write_bytes(b"a\xff\x80b")
    assert sf.read_range(system, str(tmp_path / "bad"), 0, 4, 4) == "a��b"


def test_conditions_on_the_path_reach_the_list(spark, written):
    root, _ = written
    before = spark.conf.get(sf.PUSHDOWN, "false")
    condition = F.col("path").startswith(f"file://{root}/a1/") & F.col("path").endswith("7.txt")
    plain = sorted(r.path for r in sf.packed_files(spark, root).filter(condition).collect())
    try:
        spark.conf.set(sf.PUSHDOWN, "true")
        assert sorted(r.path for r in sf.packed_files(spark, root).filter(condition).collect()) == plain and len(plain) == 2
    finally:
        spark.conf.set(sf.PUSHDOWN, before)
    import json

    from pyspark.sql import datasource as ds

    reader = sf.PushingReader({"roots": json.dumps([root])})
    other = ds.EqualTo(("part",), 0)
    assert list(reader.pushFilters([ds.StringEndsWith(("path",), "7.txt"), other, ds.IsNotNull(("path",))])) == [other]
    assert {p[1].rsplit("/", 1)[1] for s in reader.partitions() for p in s.pieces} == {"f7.txt", "f17.txt", "f27.txt", "f37.txt"}


def test_a_failed_job_leaves_nothing_and_keeps_the_earlier_result(spark, written):
    root, rows = written
    bad = spark.createDataFrame([("x.txt", "1"), ("../y.txt", "2")], "name string, text string").repartition(2)
    with pytest.raises(Exception, match="cannot be a file"):
        sf.write_keyed(bad, root)
    assert files(root) == rows and os.listdir(os.path.dirname(root)) == ["out"]
    with pytest.raises(Exception, match="FileExists"):
        sf.write_keyed(spark.createDataFrame([("x", "1")], "name string, text string"), root, overwrite=False)
    assert files(root) == rows and os.listdir(os.path.dirname(root)) == ["out"]
    sf.write_keyed(spark.createDataFrame([("x", "1")], "name string, text string"), root)
    assert files(root) == {"x": "1"}


def test_a_repeated_task_leaves_no_half_file(tmp_path):
    """The first try dies in the middle of its second file; the second try writes both."""
    writer = sf.KeyedWriter(str(tmp_path / "out"), True)

    def dying():
        yield pa.RecordBatch.from_pydict({"name": ["a.txt"], "text": ["one"]})
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        writer.write(dying())
    pending = tmp_path / os.path.basename(writer.pending)
    assert (pending / "a.txt").read_text() == "one"
    attempt = next(p for p in pending.iterdir() if p.name.startswith("_attempt-"))
    (attempt / "1").write_text("hal")  # what a lost executor may leave
    message = writer.write(iter([pa.RecordBatch.from_pydict({"name": ["a.txt", "b.txt"], "text": ["one", "two"]})]))
    assert message.files == 2
    writer.commit([message])
    assert files(tmp_path / "out") == {"a.txt": "one", "b.txt": "two"} and os.listdir(tmp_path) == ["out"]
    again = sf.KeyedWriter(str(tmp_path / "out"), True)
    again.write(iter([pa.RecordBatch.from_pydict({"name": ["c"], "text": ["x"]})]))
    again.abort([None])
    assert os.listdir(tmp_path) == ["out"]


def test_nothing_to_write_or_read(spark, tmp_path):
    sf.write_keyed(spark.createDataFrame([], "name string, text string"), str(tmp_path / "none"))
    assert sf.packed_files(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="FileNotFound"):
        sf.packed_files(spark, str(tmp_path / "missing")).count()


def test_a_large_program_is_counted_in_parts(spark, tmp_path):
    lines = ["define i32 @f() {", "  %x = add i32 1, 2", "  ret i32 0", "}", "  ret i32 1", "; ret"]
    rng = random.Random(2)
    text = {f"p{i}": "".join(rng.choice(lines) + rng.choice(["\n", "\r\n"]) for _ in range(400)) for i in range(3)}
    sf.write_keyed(spark.createDataFrame([(f"{n}.ll", t) for n, t in text.items()], "name string, text string"), str(tmp_path / "p"))
    parts = readers.read_corpus_parts(spark, str(tmp_path / "p"), "*.ll", r"(p[0-9])\.ll", 333)
    assert parts.groupBy("doc_id").count().agg(F.min("count")).head()[0] > 10
    whole = spark.createDataFrame(list(text.items()), "doc_id string, text string").select("doc_id", instruction_count(F.col("text")).alias("n"))
    assert sorted(map(tuple, instruction_count_of_parts(parts).collect())) == sorted(map(tuple, whole.collect()))


def test_tasks_grow_with_bytes_not_with_parts(tmp_path, spark):
    """Small parts must not mean a task for every file or two."""
    root = tmp_path / "many"
    root.mkdir()
    for i in range(200):
        (root / f"doc{i}.txt").write_text(f"text {i}" if i else "x" * 2500)
    parts = readers.read_corpus_parts(spark, str(root), "*.txt", r"doc([0-9]+)\.txt", part_bytes=1000)
    assert parts.rdd.getNumPartitions() <= 2
    found = {(r["doc_id"], r["part"]): r["text"] for r in parts.collect()}
    assert len(found) == 202 and found["0", 2] == "x" * 500 and found["7", 0] == "text 7"
