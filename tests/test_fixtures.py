"""Hand-derived rows for the rules that decide results."""

import pytest
from pyspark.sql import functions as F

from nearfold.functions import columns as col
from nearfold.functions import commands as cmd
from nearfold.functions import measures as ms
from nearfold.functions.text import CODE_SPECIALS, normalize_text, words
from nearfold.functions.vectors import vector_from_json
from nearfold.operators import evaluation as ev
from nearfold.operators.clusters import elbow_k
from nearfold.operators.program_text import function_body_lines, instruction_count
from nearfold.operators.quality import accepted, dedupe_last, filter_id_range, mark_rejects
from nearfold.operators.ranks import hash_split
from nearfold.operators.retrieval import cluster_candidates, neighbours_from_text
from nearfold.operators.scaling import Scaler, fit_scaler
from nearfold.operators.tokens import chunk_tokens


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c")).alias("r")).head()[0]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("define i32 @main(i32 %argc) {", "define [TYPE] [GLOB]([TYPE] [REG]) {"),
        ("entry:", "[LBL]:"),
        ("  %1 = add i32 %x.0, 42", "  [REG] = add [TYPE] [REG], [NUM]"),
        (
            "  store float 0x3FF0, float* %p, align 4, !dbg !12",
            "  store [TYPE] [ADDR], [TYPE]* [REG], align [NUM], !dbg ![NUM]",
        ),
        ("5:", "[NUM]:"),
        ('@.str.1 = c"hi 7\\00"', "[GLOB][NUM] = [STR]"),
        ("!12abc", "[MD]abc"),
        ("é12 ²3 a_4", "é12 ²3 a_4"),
        ("..a.b: c.:d:: .: x1:2", "..[LBL]: [LBL]:[LBL]:: .: [LBL]:[NUM]"),
        ('c"a\nb" c"x"', 'c"a\nb" [STR]'),
    ],
)
def test_normalisation(spark, text, expected):
    assert one(spark, text, normalize_text) == expected


def test_normalisation_with_metadata_first(spark):
    assert one(spark, "!dbg !12", lambda c: normalize_text(c, metadata_first=True)) == "!dbg [MD]"


def test_words(spark):
    assert one(spark, "Hi, [REG] x_y 中文\x00!", lambda c: words(c, CODE_SPECIALS)) == [
        "Hi", ",", "[REG]", "x", "_", "y", "中", "文", "!",
    ]


PROGRAM = """; ModuleID
define i32 @f(i32 %a) {
entry:
  %0 = add i32 %a, 1
  ; comment
  tail call void @g()
  !dbg
  ret i32 %0
}
declare void @g()
  %z = add i32 1, 2
define void @h() {
ret:   ; preds = %0
  switch i32 %x, label %d [
    i32 0, label %a
  ]
  fneg float %x
  unreachable
}
"""


def test_instruction_count(spark):
    assert one(spark, PROGRAM, instruction_count) == 6
    docs = spark.createDataFrame([("p", PROGRAM)], "doc_id string, text string")
    lines = function_body_lines(docs)
    assert lines.filter("is_instruction").count() == 6
    assert lines.count() == 12


@pytest.mark.parametrize(
    "command, affix, token",
    [
        ("opt -mem2reg -gvn input.bc -o output.bc", ["-mem2reg", "-gvn"], ["-mem2reg", "-gvn"]),
        (
            "/usr/bin/opt-10 -licm x/input.bc -o out.bc",
            ["/usr/bin/opt-10", "-licm", "x/input.bc", "-o", "out.bc"],
            ["-licm"],
        ),
        ("opt input.bc -o output.bc", ["input.bc", "-o", "output.bc"], []),
        ("opt", [], []),
        ("  opt  -a  ", ["-a"], ["-a"]),
        ("opt -o -o -b 'x y' -c=\"1 2\"", ["-o", "-o", "-b", "'x", "y'", '-c="1', '2"'], ["-b", "x y", "-c=1 2"]),
        ("opt 'open", ["'open"], None),
    ],
)
def test_commands(spark, command, affix, token):
    assert one(spark, command, cmd.affix_passes) == affix
    assert one(spark, command, cmd.token_passes) == token


def test_pass_names(spark):
    assert one(spark, ["-gvn", "--licm", "-3x", "x", "-", ""], cmd.pass_names, "array<string>") == ["gvn", "licm"]


@pytest.mark.parametrize(
    "log, total",
    [
        ("Total Insts: 3\ntotal of 7 instructions", 7),
        ("TOTAL NUMBER OF INSTS: 4", 4),
        ("Total instructions = 9", 9),
        ("Total inst: 2", 2),
        ("nothing", None),
    ],
)
def test_log_total(spark, log, total):
    assert one(spark, log, cmd.log_total) == total


@pytest.mark.parametrize(
    "raw, canonical",
    [("12", "12"), ("12.0", "12"), (" a ", "a"), ("inf", "inf"), ("", None), (None, None), ("12d", "12d"), ("1e3", "1000")],
)
def test_ids(spark, raw, canonical):
    assert one(spark, raw, col.canonical_id) == canonical


@pytest.mark.parametrize(
    "raw, number, flag",
    [("1", 1.0, True), (" Yes ", None, True), ("nan", None, None), ("0", 0.0, False), ("-.5e1", -5.0, None), ("3f", None, None)],
)
def test_coercion(spark, raw, number, flag):
    assert one(spark, raw, col.to_number) == number
    assert one(spark, raw, col.to_flag) == flag


@pytest.mark.parametrize("path, stem", [("a/b.tar.gz", "b.tar"), (".bashrc", ".bashrc"), ("x/y/", "y"), ("n", "n")])
def test_stem(spark, path, stem):
    assert one(spark, path, col.path_stem) == stem


def test_id_from_path(spark):
    assert one(spark, "d/Source_7/x.ll", col.id_from_path) == "Source_7"
    assert one(spark, "x.ll", col.id_from_path) == "x.ll"
    assert one(spark, "d/Source_007/x.ll", lambda c: col.id_from_path(c, r"Source_(\d+)")) == "7"
    with pytest.raises(Exception, match="did not match"):
        one(spark, "d/x.ll", lambda c: col.id_from_path(c, r"Source_(\d+)"))


def test_natural_order(spark):
    paths = ["a/File10", "a/file9", "B/1", "a/file9b", "a/file09"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").orderBy(*col.natural_order("p")).collect()
    assert [r[0] for r in rows] == ["a/file09", "a/file9", "a/file9b", "a/File10", "B/1"]


def test_column_choice(spark):
    df = spark.createDataFrame([(1,)], "centroid int")
    assert col.first_present(df, ["cluster_id", "cluster", "centroid"]) == "centroid"
    with pytest.raises(ValueError, match="missing columns: a, b"):
        col.require_columns(df, ["a", "centroid", "b"], "table")


def test_vectors(spark):
    texts = {
        "1": "[1, 2]", "2": "[]", "3": "[1, NaN]", "4": "[1, Infinity]", "5": "nope", "6": "[[1, 2]]",
        "7": "[1, 2, 3]", "8": "[1, null]", " ": "[3, 4]",
    }
    raw = spark.createDataFrame(list(texts.items()), "id string, t string")
    marked = mark_rejects(raw.select("id", vector_from_json(F.col("t")).alias("embedding")))
    found = {r["id"]: r["reject_reason"] for r in marked.collect()}
    assert found == {
        "1": None, "2": "empty vector", "3": "non-finite value", "4": "non-finite value", "5": "not a vector",
        "6": "not a vector", "7": "wrong dimension", "8": "non-finite value", None: "missing id",
    }
    assert accepted(marked, "skip").count() == 1
    with pytest.raises(Exception, match="invalid row"):
        accepted(marked, "error").collect()


def test_id_range(spark):
    df = spark.createDataFrame([("1",), ("5",), ("x",)], "id string")
    assert filter_id_range(df).count() == 3
    with pytest.raises(Exception, match="numeric ids"):
        filter_id_range(df, 1, 4).collect()
    assert filter_id_range(df.filter("id <> 'x'"), 2).count() == 1


def test_dedupe_last(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 2, "z"), ("a", 3, "w")], "k string, o int, v string")
    assert sorted(map(tuple, dedupe_last(df, ["k"], ["o"]).collect())) == [("a", 3, "y"), ("b", 2, "z")]


def test_scaler(spark):
    df = spark.createDataFrame([([1.0, 7.0],), ([3.0, 7.0],)], "embedding array<double>")
    scaler = fit_scaler(df)
    assert scaler == Scaler((2.0, 7.0), (1.0, 1.0))
    assert one(spark, [2.0, 9.0], scaler.apply, "array<double>") == [0.0, 2.0]
    assert Scaler.from_table(scaler.to_table(spark)) == scaler


@pytest.mark.parametrize(
    "curve, k",
    [([100.0, 40.0, 20.0, 15.0, 12.0], 2), ([5.0, 5.0, 5.0], 1)],
)
def test_elbow(spark, curve, k):
    df = spark.createDataFrame(list(enumerate(curve, 1)), "k int, inertia double")
    assert elbow_k(df).head()[0] == k


def test_elbow_needs_three_points(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 1.0)], "k int, inertia double")
    with pytest.raises(Exception, match="three k values"):
        elbow_k(df).collect()


@pytest.mark.parametrize(
    "n, windows",
    [(10, [[1, 2, 3, 4], [4, 5, 6, 7], [7, 8, 9, 10]]), (3, [[1, 2, 3]]), (0, [[]]), (4, [[1, 2, 3, 4]])],
)
def test_chunks(spark, n, windows):
    df = spark.createDataFrame([("d", list(range(101, 101 + n)))], "doc_id string, input_ids array<int>")
    rows = chunk_tokens(df, 6, 1, 2, 3, [2, 3]).orderBy("chunk_no").collect()
    assert [r["input_ids"] for r in rows] == [[2] + [100 + i for i in w] + [3] for w in windows]
    assert all(r["special_tokens_mask"] == [1] + [0] * (len(r["input_ids"]) - 2) + [1] for r in rows)
    assert all(set(r["attention_mask"]) == {1} for r in rows)
    with pytest.raises(ValueError):
        chunk_tokens(df, 6, 4, 2, 3, [2, 3])


@pytest.mark.parametrize("n, ratio, held", [(10, 0.25, 2), (3, 0.1, 1), (1, 0.5, 0), (10, 0.0, 0), (500, 0.3, 150)])
def test_split(spark, n, ratio, held):
    df = spark.range(n).withColumnRenamed("id", "doc_id")
    assert hash_split(df, "doc_id", ratio, 7).filter("split = 'validation'").count() == held


def test_cluster_candidates(spark):
    df = spark.createDataFrame(
        [(1, "9", "a, b,a,, c,d,e,f"), (2, "8.0", " , ")], "cluster_id int, closest_code_id string, top_closest_ids string"
    )
    got = sorted(map(tuple, cluster_candidates(df).collect()))
    assert got == [(1, i, c) for i, c in enumerate("abcde")] + [(2, 0, "8")]


def test_neighbour_text(spark):
    df = spark.createDataFrame([("1", "3, 1,x", "0.5,0.75")], "id string, top_5_closest_clusters string, top_5_distances string")
    (row,) = neighbours_from_text(df).collect()
    assert [tuple(n) for n in row["neighbours"]] == [(1, 3, 0.5), (2, 1, 0.75)]


def test_measures(spark):
    df = spark.createDataFrame([(50, 100), (200, 100), (0, 100), (None, 100), (5, 0)], "c int, o int")
    row = df.agg(
        F.round(ms.geomean_pct_from_counts(F.col("c"), F.col("o")), 9),
        ms.geomean_ratio(F.lit(None).cast("double")),
        F.round(ms.geomean_pct_from_pct(F.when(F.col("c") > 5, (1 - F.col("c") / F.col("o")) * 100)), 9),
    ).head()
    assert tuple(row) == (0.0, None, 0.0)
    nan = spark.createDataFrame([(float("nan"), 1.0), (0.0, float("nan")), (0.0, 1.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in nan.select(ms.below(F.col("a"), F.col("b"))).collect()] == [False, False, True, False]


# --- the gated fallback, every branch ---------------------------------------------

BASE = [
    # id, cluster, oz, base count, extra (cluster, count)
    ("A", 1, 100, 90, None),
    ("B", 1, 100, 98, (2, 97)),
    ("C", 1, 100, 99, (2, 99)),
    ("D", 3, 100, 120, None),
    ("E", 1, None, 50, None),
    ("F", 1, 100, 98, (3, 97)),
    ("G", 1, 100, 0, None),
]


@pytest.fixture(scope="module")
def fallback(spark):
    near = spark.createDataFrame(
        [(i, [(1, c, 0.1)] + ([(2, x[0], 0.2)] if x else [])) for i, c, _, _, x in BASE],
        "id string, neighbours array<struct<rank:int,cluster_id:int,distance:double>>",
    )
    codes = spark.createDataFrame([(c, [f"code{c}"]) for c in (1, 2, 3)], "cluster_id int, codes array<string>")
    measured = [(i, f"code{c}", n, 1.5) for i, c, _, n, _ in BASE]
    measured += [(i, f"code{x[0]}", x[1], 2.0) for i, _, _, _, x in BASE if x]
    measurements = spark.createDataFrame(measured, "id string, code_id string, count bigint, compile_ms double")
    baselines = spark.createDataFrame(
        [(i, oz, 95, None, 140, 2.5) for i, _, oz, _, _ in BASE],
        "id string, oz_count bigint, clang_oz_count bigint, gym_oz_count bigint, o0_count bigint, clang_oz_ms double",
    )
    thresholds = spark.createDataFrame([(1, 5.0), (2, -10.0), (3, None)], "cluster int, delta_p10 double")
    base = ev.base_result(near, codes, measurements, baselines)
    # C's extra ties with its base and must not win.
    return base, ev.final_result(base, codes, thresholds, measurements, baselines), (near, codes, measurements, baselines)


def test_fallback_outcomes(fallback):
    _, final, _ = fallback
    got = {
        r["id"]: (r["category"], r["final_cluster"], r["final_count"], r["final_reduction_pct"] and round(r["final_reduction_pct"], 6))
        for r in final.collect()
    }
    assert got == {
        "A": ("centroid", 1, 90, 10.0),
        "B": ("ncs_ok", 2, 97, 3.0),
        "C": ("preset_fallback", 1, 95, 0.0),
        "D": ("centroid", 3, 120, -20.0),
        "E": ("centroid", 1, 50, None),
        "F": ("ncs_ok", 3, 97, 3.0),
        "G": ("centroid", 1, None, None),
    }


def test_fallback_report(fallback):
    _, final, _ = fallback
    report = {r["metric"]: r["value"] and round(r["value"], 6) for r in ev.stage_report(final).collect()}
    assert report == {
        "ncs_count": 3.0,
        "preset_fallback_count": 1.0,
        "category_centroid": 4.0,
        "category_ncs_ok": 2.0,
        "category_preset_fallback": 1.0,
        "gm_base": -0.531513,
        "gm_ncs": 1.667794,
        "gm_ncs_best": 2.337863,
        "gm_final": -0.321368,
        "extras_compile_ms": report["extras_compile_ms"],
        "preset_clang_oz_ms": 2.5,
        "preset_cgym_oz_ms": 0.0,
    }
    assert {r[0]: r[1] for r in ev.category_counts(final).collect()} == {"centroid": 4, "ncs_ok": 2, "preset_fallback": 1}


def test_preset_columns_belong_to_preset_outcomes(fallback):
    _, final, _ = fallback
    names = ["preset_o0_count", "preset_clang_oz_count", "preset_clang_oz_ms", "preset_cgym_oz_count", "preset_cgym_oz_ms", "preset_best_oz_count"]
    got = {r["id"]: tuple(r[n] for n in names) for r in final.collect()}
    assert got.pop("C") == (140, 95, 2.5, None, 0.0, 95)
    assert set(got.values()) == {(None,) * 6}


def test_fallback_without_gated_rows(spark, fallback):
    base, _, (near, codes, measurements, baselines) = fallback
    none = spark.createDataFrame([], "cluster int, delta_p10 double")
    final = ev.final_result(base, codes, none, measurements, baselines)
    assert {r["category"] for r in final.collect()} == {"centroid"}
    assert final.count() == len(BASE)


def test_scorer_hook_equals_table(fallback):
    base, _, (near, codes, measurements, baselines) = fallback

    def scorer(candidates):
        return candidates.join(measurements, ["id", "code_id"], "left")

    again = ev.base_result(near, codes, scorer, baselines)
    key = lambda df: sorted(map(str, df.drop("neighbours").collect()))
    assert key(again) == key(base)
