"""Names, commands and cluster membership joined into sequence comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.functions.columns import after_marker, last_path_part, positive, strip_name
from nearfold.functions.commands import affix_passes
from nearfold.operators.joins import spread_join
from nearfold.operators.quality import dedupe_last
from nearfold.session import staged


def mapped_names(df: DataFrame, name_col: str, name_map: DataFrame | None, prefix: str = "") -> DataFrame:
    """Replace a file name by its stem without prefix, then by its mapped name if there is one."""
    stem = df.withColumn(name_col, strip_name(F.col(name_col), prefix))
    if name_map is None:
        return stem
    # Of a name that is mapped twice the mapping that sorts last counts.
    pairs = name_map.groupBy(F.col("name").alias(name_col)).agg(F.max("mapped").alias("mapped"))
    joined = stem.join(pairs, name_col, "left").withColumn(name_col, F.coalesce("mapped", name_col))
    return joined.select(*df.columns)


def named_commands(
    commands: DataFrame,
    order: list[Column | str],
    name_map: DataFrame | None = None,
    marker: str = "",
    prefix: str = "",
) -> DataFrame:
    """(name, commandline): one command per normalised benchmark name, the latest one."""
    cut = commands.filter("commandline <> ''").withColumn("name", after_marker(F.col("benchmark"), marker))
    named = mapped_names(cut, "name", name_map, prefix)
    return dedupe_last(named, ["name"], order).select("name", "commandline")


def cluster_lookup(
    members: DataFrame, order: list[Column | str], separator: str = ",", name_map: DataFrame | None = None, prefix: str = ""
) -> DataFrame:
    """(name, cluster, closest_name) from a membership table with delimited file lists.

    A cluster's list may be spread over several rows. A file listed by several
    clusters belongs to the last of them.
    """
    # The nearest member is renamed once per list, before the lists are taken apart.
    closest = _mapped_closest(members, name_map, prefix)
    listed = closest.select("*", F.explode(F.split("files", _literal(separator))).alias("item"))
    files = listed.withColumn("name", F.trim("item")).filter("name <> ''").drop("item", "files")
    named = mapped_names(files, "name", name_map, prefix)
    return dedupe_last(named, ["name"], order).select("name", "cluster", "closest_name")


def _mapped_closest(members: DataFrame, name_map: DataFrame | None, prefix: str) -> DataFrame:
    """Distinct nearest members are renamed, then looked up by the list rows; a large
    cluster has many rows with the same nearest member."""
    names = members.select(F.col("closest_name").alias("raw_name")).distinct()
    renamed = mapped_names(names.withColumn("closest_name", F.col("raw_name")), "closest_name", name_map, prefix)
    raw = members.withColumnRenamed("closest_name", "raw_name")
    return spread_join(raw, renamed, "raw_name", "files").select(*members.columns)


def _literal(separator: str) -> str:
    return "\\Q" + separator + "\\E"


def compare_sequences(files: DataFrame, lookup: DataFrame, commands: DataFrame) -> DataFrame:
    """Each file's own command beside the command of its cluster's nearest member.

    File names are unique, but one cluster may hold most files; its command is looked up once per entry of
    ``lookup``, with that allowed for. All other joins are by name.
    """
    own = commands.select("name", F.col("commandline").alias("individual_sequence"))
    theirs = commands.select(F.col("name").alias("closest_name"), F.col("commandline").alias("centroid_sequence"))
    clustered = spread_join(lookup, theirs, "closest_name", "name")
    return files.join(clustered, "name", "left").join(own, "name", "left").select(
        "name", "cluster", "closest_name", "centroid_sequence", "individual_sequence"
    )


COUNTS = ("current_count", "optimized_count", "centroid_count", "individual_count")


def comparison_counts(compared: DataFrame, totals: DataFrame, measured: DataFrame) -> DataFrame:
    """The comparison with four instruction counts per file; an absent or non-positive one is NULL.

    ``totals`` is (name, current_count, optimized_count), ``measured`` (name, commandline, count) has the
    count of a file under a sequence.
    """
    known = totals.select("name", *[positive(F.col(c)).alias(c) for c in COUNTS[:2]])
    under = measured.select("name", "commandline", positive(F.col("count")).alias("count"))
    result = compared.join(known, "name", "left")
    for which in ("centroid", "individual"):
        counted = under.select(F.col("name").alias("of"), "commandline", F.col("count").alias(f"{which}_count"))
        # Only the name is a join key, so that rows and counts are shuffled by name once for both.
        same = F.coalesce(F.col(f"{which}_sequence") == F.col("commandline"), F.lit(False))
        result = result.join(counted, (F.col("name") == F.col("of")) & same, "left").drop("of", "commandline")
    return result.select(*compared.columns, *COUNTS)


def extract_sequences(commands: DataFrame, order: list[Column | str]) -> DataFrame:
    """(benchmark, passes): the pass list per benchmark, last path part as its name."""
    rows = commands.filter("commandline <> ''").withColumn("benchmark", last_path_part(F.col("benchmark")))
    return dedupe_last(rows, ["benchmark"], order).select("benchmark", affix_passes(F.col("commandline")).alias("passes"))


def resolve_actions(sequences: DataFrame, actions: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, actions, unknown): pass names as action numbers in order; unknown names apart.

    ``actions`` is (name, action); matching ignores case and leading dashes, and of names
    that are then equal the largest number counts. Every different pass list is resolved
    once and joined back, so every row stays a row, whatever its id. A list that most rows share is
    split by id.
    """
    known = actions.groupBy(_pass_key(F.col("name")).alias("pass_key")).agg(F.max(F.col("action").cast("int")).alias("action"))
    none = F.array().cast("array<string>")
    rows = staged(sequences.select(id_col, F.coalesce("passes", none).alias("passes")), "pass-lists")
    steps = rows.select("passes").distinct().select("passes", F.posexplode("passes").alias("pos", "pass"))
    joined = steps.withColumn("pass_key", _pass_key(F.col("pass"))).join(known, "pass_key", "left")
    hit = F.when(F.col("action").isNotNull(), F.struct("pos", F.col("action").alias("v")))
    miss = F.when(F.col("action").isNull(), F.struct("pos", F.col("pass").alias("v")))
    gathered = joined.groupBy("passes").agg(
        F.array_sort(F.collect_list(hit)).alias("hits"), F.array_sort(F.collect_list(miss)).alias("misses")
    )
    values = [F.transform(c, lambda s: s["v"]).alias(name) for c, name in (("hits", "actions"), ("misses", "unknown"))]
    digest = F.xxhash64("passes").alias("digest")
    resolved = gathered.select("passes", digest, *values)
    return spread_join(rows.select("*", digest), resolved, "digest", id_col, also=("passes",)).select(
        id_col, F.coalesce("actions", F.array().cast("array<int>")).alias("actions"), F.coalesce("unknown", none).alias("unknown")
    )


def _pass_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "^-+", "")
