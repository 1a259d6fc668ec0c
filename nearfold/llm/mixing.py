"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks. With a share of ``a`` in every ``slots`` slots, block j (from 0)
of a source is released at floor(j * slots / a) and due by ceil((j + 1) * slots / a); every slot goes to
the released block with the earliest deadline. On one line of slots that meets all deadlines, so at every
slot each source is less than one block away from its share.

Shares are the weights in units of 1 / WHOLE by largest remainder, so they differ from the weights by less
than t / WHOLE blocks after t slots. The schedule does not repeat: every block of every source is placed by one
fold over all blocks, one after the other, in rows of at most EPOCH blocks that hand on their state. It takes
blocks times sources steps on one core. With ``slots`` given, shares are rounded to whole slots in so many and
the schedule repeats after them: it is computed for that stretch only, block i of a source takes place
j = i mod a of stretch i div a, and the distance is less than one block from the rounded shares.

Without weights a source weighs its number of rows to the power ALPHA. Nothing is dropped or repeated: slots
of a source that has run out stay empty or go to another that is released, and ``in_mix`` says whether all
sources still had blocks.

Only DataFrame and SQL functions are used. Rows of a source are numbered in the order of a hash of their
id, in cells of about CELL_ROWS rows whose starts come from counts, so a large source is no single group.

Edge cases: a null source is the source ''. A source whose weight rounds to no slot, is not positive or is
missing gets one slot in ``slots`` or WHOLE, and the others give way in proportion. Null ids and repeated rows are numbered like others. An empty table gives no rows. Input
columns with the names of added ones are replaced (``in_order`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfold.session import staged

#: Units of a share when the schedule does not repeat.
WHOLE = 1 << 34
#: Blocks that one row of the fold places, and those that are gathered before they join the rest.
EPOCH, GATHERED = 200_000, 250
#: Rows of a block.
BLOCK_ROWS = 8
#: Weight of a source by default: rows ** ALPHA.
ALPHA = 0.7
CELL_ROWS = 20_000
#: Up to so many sources their table is sent to all executors.
FEW_SOURCES = 10_000


ADDED = ("block", "release", "deadline", "slot", "place", "in_mix")


def shares(counts: DataFrame, weights: DataFrame | None, slots: int) -> DataFrame:
    """(src, n, a) with sum(a) = slots, for ``counts`` (src, n) and ``weights`` (src, weight)."""
    if weights is None:
        weighed = counts.withColumn("weight", F.pow("n", F.lit(ALPHA)))
    else:
        given = weights.groupBy("src").agg(F.max(F.col("weight").cast("double")).alias("weight"))
        weighed = counts.join(given, "src", "left")
    weighed = weighed.withColumn("weight", F.when(F.col("weight") > 0, F.col("weight")).otherwise(0.0))
    every = Window.partitionBy()  # one row per source
    total = F.sum("weight").over(every)
    sources = F.count("*").over(every)
    exact = F.when(total > 0, F.col("weight") / total).otherwise(1 / sources) * slots
    # Every source has one slot; the rest goes by what a weight is worth above that, which leaves exact shares as
    # they are unless some are below one slot.
    sized = weighed.withColumn("above", F.greatest(exact - 1, F.lit(0.0))).withColumn("free", F.lit(slots) - sources)
    sized = sized.withColumn("exact", F.col("above") * F.coalesce(F.try_divide("free", F.sum("above").over(every)), F.lit(0.0)))
    cut = sized.withColumn("a", F.floor("exact"))
    by_rest = Window.partitionBy().orderBy(F.desc(F.col("exact") - F.col("a")), "src")
    left = F.col("free") - F.sum("a").over(every)
    return cut.select("src", "n", (F.col("a") + 1 + (F.row_number().over(by_rest) <= left).cast("long")).alias("a"))


def schedule(quotas: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(src, block, slot) of all blocks, earliest deadline first, and the one row ``end``: the first slot that
    a source should fill and cannot. ``quotas`` has (src, n, a) with sum(a) = WHOLE."""
    blocks = f"((n + {block_rows - 1}) div {block_rows})"
    # A source ends with one block more than it has, which marks where it is missed.
    total = quotas.agg(F.sum(F.expr(f"{blocks} + 1"))).first()[0] or 0
    best = f"""array_min(transform(acc.done, (d, i) -> IF(d <= q[i].b, named_struct('t', greatest(d * {WHOLE}L div q[i].a, acc.t),
        'deadline', ((d + 1) * {WHOLE}L + q[i].a - 1) div q[i].a, 'i', i, 'j', d), NULL)))"""
    step = f"""transform(array({best}), p -> IF(p IS NULL, acc, named_struct('t', p.t + 1,
        'done', transform(acc.done, (d, i) -> IF(i = p.i, d + 1L, d)),
        'picks', array_append(acc.picks, named_struct('i', p.i, 'j', p.j, 't', p.t)))))[0]"""
    none = "cast(array() AS array<struct<i:int,j:bigint,t:bigint>>)"
    gather = f"aggregate(sequence(1, {GATHERED}), named_struct('t', far.t, 'done', far.done, 'picks', {none}), (acc, x) -> {step})"
    fold = f"""aggregate(sequence(1, {max(1, EPOCH // GATHERED)}), named_struct('t', t, 'done', done, 'picks', cast(array() AS array<array<struct<i:int,j:bigint,t:bigint>>>)),
        (far, y) -> transform(array({gather}), g -> named_struct('t', g.t, 'done', g.done, 'picks', array_append(far.picks, g.picks)))[0])"""
    own = F.struct("src", "a", F.expr(blocks).alias("b"))
    state = quotas.agg(F.array_sort(F.collect_list(own)).alias("q")).where(F.size("q") > 0)
    state = state.select("q", F.lit(0).cast("long").alias("t"), F.expr("transform(q, x -> 0L)").alias("done"))
    picked = None
    for _ in range(max(1, -(-total // (max(1, EPOCH // GATHERED) * GATHERED)))):
        far = staged(state.select("q", F.expr(fold).alias("far")), "mixing-schedule")
        state = far.select("q", "far.t", "far.done")
        part = far.select("q", F.explode("far.picks").alias("p")).select("q", F.explode("p").alias("p"))
        part = part.select(F.expr("q[p.i].src").alias("src"), F.col("p.j").alias("block"), F.col("p.t").alias("slot"), F.expr("p.j = q[p.i].b").alias("missed"))
        picked = part if picked is None else picked.unionByName(part)
    plan = staged(picked, "mixing-plan")
    return plan.where("NOT missed").drop("missed"), plan.where("missed").agg(F.min("slot").alias("end"))


def timetable(quotas: DataFrame, slots: int) -> DataFrame:
    """(src, j, pos): the slot of every block in one stretch, earliest deadline first."""
    due = f"""array_min(transform(sequence(0, size(q) - 1), i -> IF(acc.done[i] * {slots}L < (t + 1) * q[i].a,
        named_struct('deadline', ((acc.done[i] + 1) * {slots}L + q[i].a - 1) div q[i].a, 'i', i), NULL))).i"""
    fold = f"""aggregate(sequence(0, {slots - 1}), named_struct('done', transform(q, x -> 0L), 'picks', cast(array() AS array<int>)),
        (acc, t) -> transform(array({due}), p -> named_struct(
            'done', transform(acc.done, (d, i) -> IF(i = p, d + 1L, d)), 'picks', array_append(acc.picks, p)))[0],
        acc -> transform(acc.picks, p -> q[p].src))"""
    all_of = quotas.agg(F.array_sort(F.collect_list(F.struct("src", "a"))).alias("q")).where(F.size("q") > 0)
    picked = all_of.select(F.posexplode(F.expr(fold)).alias("pos", "src"))
    return picked.select("src", "pos", (F.row_number().over(Window.partitionBy("src").orderBy("pos")) - 1).alias("j"))


def mixed(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source", id_col: str = "doc_id", slots: int | None = None, block_rows: int = BLOCK_ROWS, seed: int = 0) -> DataFrame:
    """All rows and columns, with block, release, deadline, slot, place and in_mix.

    Rows ordered by (slot, place) are the mixture.
    """
    src: Column = F.coalesce(F.col(source_col), F.lit(""))
    rows = docs.withColumns({"__src": src, "__h": F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.lit(seed)), 24)})
    counts = rows.groupBy(F.col("__src").alias("src")).agg(F.count("*").alias("n"))
    sources = counts.count()
    repeats = slots is not None
    slots = max(slots, 4 * sources) if repeats else WHOLE
    small = F.broadcast if sources <= FEW_SOURCES else (lambda df: df)
    quotas = staged(shares(counts, weights, slots), "mixing-shares")
    # Cells: even stretches of the hash, as many as a source's rows need.
    sized = small(quotas.select(F.col("src").alias("__src"), F.col("a").alias("__a"), F.ceil(F.col("n") / CELL_ROWS).alias("__cells")))
    celled = rows.join(sized, "__src").withColumn("__cell", F.expr("(__h * __cells) div 1099511627776L"))
    by_source = Window.partitionBy("__src").orderBy("__cell")
    starts = celled.groupBy("__src", "__cell").agg(F.count("*").alias("__n")).select("__src", "__cell", (F.sum("__n").over(by_source) - F.col("__n")).alias("__start"))
    in_cell = Window.partitionBy("__src", "__cell").orderBy("__h", id_col)
    numbered = celled.withColumn("__i", F.row_number().over(in_cell) - 1).join(starts, ["__src", "__cell"]).withColumn("__i", F.col("__i") + F.col("__start"))
    placed = numbered.withColumns({"block": F.expr(f"__i div {block_rows}"), "place": (F.col("__i") % block_rows).cast("int")})
    if repeats:
        placed = placed.withColumns({"__j": F.expr("cast(block % __a AS int)"), "__p": F.expr(f"(block div __a) * {slots}L")})
        plan = small(timetable(quotas, slots).select(F.col("src").alias("__src"), F.col("j").alias("__j"), F.col("pos").alias("__pos")))
        # The first slot that a source should fill and cannot: that of the block after its last.
        blocks = f"((n + {block_rows - 1}) div {block_rows})"
        ends = (
            quotas.select("src", F.expr(f"cast({blocks} % a AS int)").alias("j"), F.expr(f"({blocks} div a) * {slots}L").alias("p"))
            .join(timetable(quotas, slots), ["src", "j"]).agg(F.min(F.col("p") + F.col("pos")).alias("__end"))
        )
        slotted = placed.join(plan, ["__src", "__j"]).withColumn("slot", F.col("__p") + F.col("__pos"))
        release, deadline = f"__p + (__j * {slots}L) div __a", f"__p + ((__j + 1) * {slots}L + __a - 1) div __a"
    else:
        plan, ends = schedule(quotas, block_rows)
        plan, ends = plan.select(F.col("src").alias("__src"), "block", F.col("slot").alias("__slot")), ends.select(F.col("end").alias("__end"))
        slotted = placed.join(plan, ["__src", "block"]).withColumn("slot", F.col("__slot"))
        release, deadline = f"(block * {slots}L) div __a", f"((block + 1) * {slots}L + __a - 1) div __a"
    return (
        slotted.join(F.broadcast(ends))
        .withColumns({"release": F.expr(release), "deadline": F.expr(deadline), "in_mix": F.col("slot") < F.col("__end")})
        .select(*(c for c in docs.columns if c not in ADDED), *ADDED)
    )


def in_order(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, unchanged, in the order of the mixture: a partition holds a stretch of it."""
    own = docs.columns
    renamed = docs.select(*(F.col(f"`{c}`").alias(f"__own_{i}") for i, c in enumerate(own)), F.col(options.pop("source_col", "source")), F.col(options.pop("id_col", "doc_id")).alias("__id"))
    ordered = mixed(renamed.withColumnRenamed(renamed.columns[-2], "__source"), source_col="__source", id_col="__id", **options)
    return ordered.repartitionByRange("slot", "place").sortWithinPartitions("slot", "place").select(*(F.col(f"__own_{i}").alias(c) for i, c in enumerate(own)))
