"""Command lines, pass sequences, names and logs drawn from orders and their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import query, table
from nearfold.functions.commands import log_total, pass_names, token_passes
from nearfold.operators import sequences as sq
from nearfold.operators.evaluation import metric_summary
from nearfold.session import scratch_path, staged
from nearfold.sources.readers import artifact_inventory, list_artifacts, read_commands, read_sequences, scan_sequences
from nearfold.sources.small_files import write_keyed
from nearfold.sources.writers import write_csv, write_sequences

PASSES = ("mem2reg", "gvn", "licm", "instcombine", "simplifycfg", "sroa", "early-cse-memssa")
MARKER = "benchmark://"


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One command per order and return flag, one pass per line of it, repeats included; some are empty.

    An order's lines do not grow with the table.
    """
    names = F.array(*[F.lit(p) for p in PASSES])
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    steps = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(
        F.array_sort(F.collect_list(line)).alias("steps"), F.max("l_quantity").alias("most")
    )
    named = F.transform("steps", lambda s: F.concat(F.lit("-"), F.element_at(names, s["l_linenumber"].cast("int"))))
    passes = F.array_join(named, " ")
    short = F.concat(F.lit("opt "), passes, F.lit(" input.bc -o output.bc"))
    long = F.concat(F.lit("/usr/bin/opt-10  "), passes, F.lit(" x/input.bc -o 'out file.bc'"))
    line = F.when(F.col("most") < 5, "").when(F.col("l_returnflag") == "N", long).otherwise(short)
    return steps.select(
        F.concat(F.lit("benchmark://set-v1/Source_"), F.col("l_orderkey").cast("string"), F.lit(".bc")).alias("benchmark"),
        F.col("l_returnflag").alias("flag"),
        line.alias("commandline"),
    )


COMMANDS_SQL = f"""WITH steps AS (
  SELECT l_orderkey, l_returnflag AS flag, max(l_quantity) AS most,
    string_agg('-' || {list(PASSES)!r}[l_linenumber], ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS passes
  FROM lineitem
  GROUP BY l_orderkey, l_returnflag
), commands AS (
  SELECT 'benchmark://set-v1/Source_' || l_orderkey || '.bc' AS benchmark, flag, l_orderkey, passes,
    CASE WHEN most < 5 THEN '' WHEN flag = 'N' THEN '/usr/bin/opt-10  ' || passes || ' x/input.bc -o ''out file.bc'''
         ELSE 'opt ' || passes || ' input.bc -o output.bc' END AS commandline
  FROM steps
), latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY flag DESC) AS rn FROM commands WHERE commandline <> '')
  WHERE rn = 1
)"""


@query("load_commands", COMMANDS_SQL + "\nSELECT benchmark, commandline FROM commands WHERE commandline <> ''")
def load_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "commands")
    write_csv(commands(spark, sf_dir).select("benchmark", "commandline"), path)
    return read_commands(spark, path)


@query(
    "parse_commands",
    COMMANDS_SQL + """
SELECT 'Source_' || l_orderkey || '.bc' AS benchmark,
  CASE WHEN flag = 'N' THEN '/usr/bin/opt-10 ' || passes || ' x/input.bc -o ''out file.bc''' ELSE passes END AS passes
FROM latest""",
)
def parse_commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass list per benchmark by cutting the ends off its latest command."""
    found = sq.extract_sequences(commands(spark, sf_dir), ["flag"])
    return found.select("benchmark", F.array_join("passes", " ").alias("passes"))


@query("parse_commands_tokens", COMMANDS_SQL + "\nSELECT benchmark, flag, CASE WHEN commandline = '' THEN '' ELSE passes END AS passes FROM commands")
def parse_commands_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return commands(spark, sf_dir).select(
        "benchmark", "flag", F.array_join(token_passes(F.col("commandline")), " ").alias("passes")
    )


@query(
    "pass_flags",
    COMMANDS_SQL + """
SELECT benchmark, flag, CASE WHEN commandline = '' THEN '' ELSE replace(substr(passes, 2), ' -', ' ') END AS passes FROM commands""",
)
def pass_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = pass_names(token_passes(F.col("commandline")))
    return commands(spark, sf_dir).select("benchmark", "flag", F.array_join(names, " ").alias("passes"))


@query(
    "resolve_actions",
    COMMANDS_SQL + f""", used AS (
  SELECT l.l_orderkey, l.l_returnflag AS flag, l.l_linenumber AS i FROM lineitem l
  JOIN steps s ON s.l_orderkey = l.l_orderkey AND s.flag = l.l_returnflag AND s.most >= 5
)
SELECT c.benchmark || '#' || c.flag AS id,
  coalesce(string_agg(CASE WHEN u.i < 7 THEN CAST(u.i * 10 AS VARCHAR) END, ' ' ORDER BY u.i), '') AS actions,
  coalesce(string_agg(CASE WHEN u.i >= 7 THEN '-' || {list(PASSES)!r}[u.i] END, ' ' ORDER BY u.i), '') AS unknown
FROM commands c LEFT JOIN used u ON u.l_orderkey = c.l_orderkey AND u.flag = c.flag GROUP BY c.benchmark, c.flag""",
)
def resolve_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action numbers for the first six passes; the seventh is not in the action table."""
    names = F.array(*[F.lit(p) for p in PASSES])
    actions = table(spark, sf_dir, "lineitem").select("l_linenumber").distinct().filter("l_linenumber < 7").select(
        F.concat(F.lit("--"), F.upper(F.element_at(names, F.col("l_linenumber")))).alias("name"),
        (F.col("l_linenumber") * 10).alias("action"),
    )
    sequences = commands(spark, sf_dir).select(
        F.concat_ws("#", "benchmark", "flag").alias("id"), token_passes(F.col("commandline")).alias("passes")
    )
    found = sq.resolve_actions(sequences, actions)
    return found.select(
        "id", F.array_join("actions", " ").alias("actions"), F.array_join("unknown", " ").alias("unknown")
    )


def name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent orders have another name elsewhere."""
    urgent = table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT'")
    key = F.col("o_orderkey").cast("string")
    return urgent.select(key.alias("name"), F.concat(F.lit("urgent_"), key).alias("mapped"))


NAME_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'urgent_' || o_orderkey ELSE CAST(o_orderkey AS VARCHAR) END"


@query(
    "normalize_name",
    COMMANDS_SQL + f"""
SELECT c.benchmark AS raw, c.flag, {NAME_SQL} AS name FROM commands c JOIN orders o ON o.o_orderkey = c.l_orderkey""",
)
def normalize_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = commands(spark, sf_dir).select(F.col("benchmark").alias("raw"), F.col("benchmark").alias("name"), "flag")
    return sq.mapped_names(raw, "name", name_pairs(spark, sf_dir), "Source_").select("raw", "flag", "name")


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer and every order day is a cluster listing its orders as files.

    A cluster's list is cut into rows of at most fifty neighbouring order keys.
    """
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("a/Source_"), F.col("o_orderkey").cast("string"), F.lit(".ll")).alias("file"),
        F.col("o_orderkey").alias("key"),
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("customer"),
        F.concat(F.lit("b"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
    )

    def listed(by: str) -> DataFrame:
        named = o.withColumnRenamed(by, "cluster")
        closest = named.groupBy("cluster").agg(F.min_by("file", "key").alias("closest_name"))
        lists = named.groupBy("cluster", F.floor(F.col("key") / 50).alias("part")).agg(
            F.array_join(F.collect_set("file"), ", ").alias("files")
        )
        return lists.join(closest, "cluster").select("cluster", "files", "closest_name")

    return staged(listed("customer").unionByName(listed("day")), "membership")


LOOKUP_SQL = f""", named AS (
  SELECT o_orderkey, o_custkey, {NAME_SQL} AS name FROM orders
), nearest AS (
  SELECT o_custkey, min(o_orderkey) AS k FROM orders GROUP BY o_custkey
), lookup AS (
  SELECT n.name, 'c' || n.o_custkey AS cluster, m.name AS closest_name
  FROM named n JOIN nearest x ON x.o_custkey = n.o_custkey JOIN named m ON m.o_orderkey = x.k
)"""


@query("cluster_lookup", COMMANDS_SQL + LOOKUP_SQL + "\nSELECT name, cluster, closest_name FROM lookup")
def cluster_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files listed twice belong to the cluster that sorts last, here the customer."""
    return sq.cluster_lookup(membership(spark, sf_dir), ["cluster"], ",", name_pairs(spark, sf_dir), "Source_")


COMPARE_SQL = COMMANDS_SQL + LOOKUP_SQL + """, cmd AS (
  SELECT n.name, l.commandline FROM latest l JOIN named n ON n.o_orderkey = l.l_orderkey
), compared AS (
  SELECT k.name, k.cluster, k.closest_name, t.commandline AS centroid_sequence, i.commandline AS individual_sequence,
    CASE WHEN o.o_custkey % 7 > 0 THEN o.o_custkey END AS current_count,
    CASE WHEN o.o_orderkey % 5 > 0 THEN o.o_orderkey % 5 * 100 END AS optimized_count,
    CASE WHEN length(t.commandline) % 4 > 0 THEN length(t.commandline) + length(k.name) END AS centroid_count,
    CASE WHEN length(i.commandline) % 4 > 0 THEN length(i.commandline) + length(k.name) END AS individual_count
  FROM lookup k JOIN named n ON n.name = k.name JOIN orders o ON o.o_orderkey = n.o_orderkey
  LEFT JOIN cmd i ON i.name = k.name LEFT JOIN cmd t ON t.name = k.closest_name
)"""


def compared_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts come as tables: those of a file as it is, and those of a file under a sequence."""
    pairs = name_pairs(spark, sf_dir)
    lookup = staged(sq.cluster_lookup(membership(spark, sf_dir), ["cluster"], ",", pairs, "Source_"), "lookup")
    known = staged(sq.named_commands(commands(spark, sf_dir), ["flag"], pairs, MARKER, "Source_"), "commands")
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("name"),
        (F.when(F.col("o_custkey") % 7 > 0, F.col("o_custkey")).otherwise(0)).alias("current_count"),
        (F.col("o_orderkey") % 5 * 100).alias("optimized_count"),
    )
    totals = sq.mapped_names(orders, "name", pairs)
    compared = staged(sq.compare_sequences(totals.select("name"), lookup, known), "compared")
    asked = compared.select("name", F.explode(F.array("centroid_sequence", "individual_sequence")).alias("commandline"))
    size = F.length("commandline")
    measured = asked.filter("commandline IS NOT NULL").distinct().withColumn(
        "count", F.when(size % 4 > 0, size + F.length("name")).otherwise(-1).cast("bigint")
    )
    return sq.comparison_counts(compared, totals, measured)


@query("compare_sequences", COMPARE_SQL + "\nSELECT * FROM compared")
def compare_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_sequences(spark, sf_dir)


@query(
    "compare_summary",
    COMPARE_SQL + "".join(
        f"{' UNION ALL' if i else ''}\nSELECT '{c}' AS metric, count({c}) AS n_values, round(avg({c}), 6) AS mean_value FROM compared"
        for i, c in enumerate(sq.COUNTS)
    ),
)
def compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files have each count, and its mean."""
    return metric_summary(compared_sequences(spark, sf_dir), list(sq.COUNTS)).withColumn("mean_value", F.round("mean_value", 6))


@query(
    "parse_log_total",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_custkey WHEN 'O' THEN o_custkey
  ELSE CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_custkey END END AS total FROM orders""",
)
def parse_log_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs in several spellings; where two totals appear, the preferred spelling wins."""
    n = F.col("o_custkey").cast("string")
    log = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("x\nTotal Insts: 1\ntotal  of "), n, F.lit(" instructions\n")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("TOTAL number of insts : "), n))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("no total here: 12"))
        .otherwise(F.concat(F.lit("a\n  total inst = "), n, F.lit("\nb")))
    )
    return table(spark, sf_dir, "orders").select("o_orderkey", log_total(log).alias("total"))


@query(
    "sequence_store",
    COMMANDS_SQL + """
SELECT CAST(l_orderkey AS VARCHAR) AS code_id, passes FROM (
  SELECT l_orderkey, string_agg(passes, ' ' ORDER BY flag) AS passes FROM steps GROUP BY l_orderkey)""",
)
def sequence_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pass lists keyed by code id, from the stored text of every order."""
    line = F.struct("l_returnflag", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    steps = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("steps"))
    names = F.array(*[F.lit(p) for p in PASSES])
    text = F.array_join(F.transform("steps", lambda s: F.concat(F.lit("-"), F.element_at(names, s["l_linenumber"].cast("int")))), "\n")
    stored = steps.select(
        F.concat(F.lit("sequence/"), F.col("l_orderkey").cast("string"), F.lit("_seq.txt")).alias("path"), text.alias("text")
    )
    return read_sequences(stored).select("code_id", F.array_join("passes", " ").alias("passes"))


#: A supplier's sequence: the passes of the line numbers it delivers in, in order.
SUPPLIED_SQL = f"""WITH used AS (
  SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem
), seqs AS (
  SELECT l_suppkey, string_agg('-' || {list(PASSES)!r}[l_linenumber], ' ' ORDER BY l_linenumber) AS passes FROM used GROUP BY l_suppkey
)"""


def supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.array_sort(F.collect_set(F.col("l_linenumber").cast("int"))).alias("n"))
    names = F.array(*[F.lit(p) for p in PASSES])
    return numbers.select(
        F.col("l_suppkey").cast("string").alias("benchmark"), F.transform("n", lambda i: F.concat(F.lit("-"), F.element_at(names, i))).alias("passes")
    )


@query("sequence_files", SUPPLIED_SQL + "\nSELECT CAST(l_suppkey AS VARCHAR) AS code_id, passes FROM seqs")
def sequence_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sequence file per supplier, written and scanned back."""
    path = scratch_path(spark, "sequences")
    write_sequences(supplied(spark, sf_dir), path)
    return scan_sequences(spark, path).select("code_id", F.array_join("passes", " ").alias("passes"))


@query(
    "artifact_files",
    """SELECT 'Source_' || s_suppkey AS program_id, s_suppkey % 2 = 0 AS has_source, s_suppkey % 3 > 0 AS has_o0, s_suppkey % 5 > 0 AS has_oz,
  CASE WHEN s_suppkey % 7 = 0 THEN 'Source_' || s_suppkey || '/input.bc' WHEN s_suppkey % 3 > 0 THEN 'Source_' || s_suppkey || '/llvm_O0.ll' END AS start
FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 > 0 OR s_suppkey % 5 > 0 OR s_suppkey % 7 = 0""",
)
def artifact_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders with some of the artefact files for every supplier, written and listed."""
    path = scratch_path(spark, "artifacts")
    key = F.col("s_suppkey")
    held = {"Source.c": key % 2 == 0, "llvm_O0.ll": key % 3 > 0, "llvm_OZ.ll": key % 5 > 0, "input.bc": key % 7 == 0, "notes.txt": F.lit(True)}
    names = F.filter(F.array(*[F.when(has, F.lit(name)) for name, has in held.items()]), lambda n: n.isNotNull())
    files = table(spark, sf_dir, "supplier").select(key, F.explode(names).alias("file"))
    write_keyed(files.select(F.concat(F.lit("Source_"), key, F.lit("/"), "file").alias("name"), F.col("file").alias("text")), path)
    found = artifact_inventory(list_artifacts(spark, path))
    return found.select("program_id", "has_source", "has_o0", "has_oz", F.regexp_extract("start_path", "[^/]+/[^/]+$", 0).alias("start"))
