"""Stage tables are used again while what they were made from is the same."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from nearfold import stages as st


def test_fingerprints(spark):
    rows = [(1, "a", [1.0, None]), (2, None, []), (2, None, [])]
    schema = "id int, `odd name` string, v array<double>"
    one = st.rows_fingerprint(spark.createDataFrame(rows, schema))
    assert one == st.rows_fingerprint(spark.createDataFrame(rows[::-1], schema).repartition(3))
    assert one == st.rows_fingerprint(spark.createDataFrame(rows, schema).select("v", "odd name", "id"))
    others = [rows[:2], [*rows, rows[1]], [(1, "a", [1.0, 2.0]), *rows[1:]], []]
    assert len({one, *(st.rows_fingerprint(spark.createDataFrame(r, schema)) for r in others)}) == 5
    assert one != st.rows_fingerprint(spark.createDataFrame(rows, schema).withColumnRenamed("id", "i"))


def test_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x").write_text("1")
    one = st.files_fingerprint(str(tmp_path / "a"))
    assert one == st.files_fingerprint(f"file://{tmp_path}/a")
    (tmp_path / "a" / "y").write_text("1")
    two = st.files_fingerprint(str(tmp_path / "a"))
    os.utime(tmp_path / "a" / "y", ns=(5, 5))
    assert len({one, two, st.files_fingerprint(str(tmp_path / "a"))}) == 3
    with pytest.raises(FileNotFoundError):
        st.files_fingerprint(str(tmp_path / "b"))


def listing(root) -> dict[str, int]:
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(root) for n in names}


def test_a_second_run_writes_nothing(spark, tmp_path):
    root = str(tmp_path / "stages")
    source = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id int, x double")
    builds = []

    def run(df, factor):
        stages = st.Stages(spark, root)
        table = stages.table("scaled", lambda: builds.append(factor) or df.withColumn("x", F.col("x") * factor), [df], factor=factor)
        total = stages.table("total", lambda: table.agg(F.sum("x").alias("s")), [table])
        return stages, sorted(map(tuple, table.collect())), total.head()[0]

    stages, rows, total = run(source, 2)
    assert stages.made == ["scaled", "total"] and rows == [(1, 4.0), (2, 6.0)] and total == 10.0
    before = listing(root)
    stages, rows, total = run(source.repartition(2), 2)
    assert stages.reused == ["scaled", "total"] and stages.made == [] and total == 10.0
    assert listing(root) == before and builds == [2]
    # Another parameter, then another input: made anew, and the earlier tables go.
    stages, _, total = run(source, 3)
    assert stages.made == ["scaled", "total"] and total == 15.0
    stages, _, total = run(source.unionByName(source), 3)
    assert stages.made == ["scaled", "total"] and total == 30.0
    assert len(os.listdir(root)) == 2 and builds == [2, 3, 3]


def test_a_stage_that_fails_leaves_no_table(spark, tmp_path):
    root = tmp_path / "stages"
    root.mkdir()
    (root / "other-thing").mkdir()
    source = spark.createDataFrame([(1,)], "id int")
    stages = st.Stages(spark, str(root))
    with pytest.raises(Exception, match="no luck"):
        stages.table("s", lambda: source.select(F.raise_error(F.lit("no luck")).cast("int").alias("x")), [source])
    assert stages.table("s", lambda: source, [source]).count() == 1 and stages.made == ["s"]
    stages.table("s_2", lambda: source, [source])
    stages.table("s", lambda: source, [source], other=True)
    names = sorted(n.rsplit("-", 1)[0] for n in os.listdir(root) if ".pending" not in n)
    assert names == ["other", "s", "s_2"]
    with pytest.raises(ValueError):
        stages.table("../s", lambda: source, [source])
