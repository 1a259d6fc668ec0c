"""Program text in many parts: what ``program_text`` folds in a row, as a prefix over parts.

A document is a set of parts (id, part, text) cut anywhere, in the middle of a line or of a line break too; parts of one
document lie in different tasks. Each is reduced where it lies: its first and last line, which may go on beyond the
part, and for the lines between them the state they leave and their instructions, both for a part entered inside a
body and for one entered outside. Lines across parts are put together by document and line. What a line or a part does
to the state is to set it or to leave it, so the state on entry is the last one set before: one window over rows that
do not grow with the parts' length. Texts are not shuffled by document.

Edge cases: a document whose only part is null counts null and has no lines. Empty parts change nothing. Part
numbers need not be gapless, but must differ within a document. A null id is a document of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfold.operators.program_text import BREAK, closes, is_instruction, opens, trimmed
from nearfold.session import staged

#: Texts with lines between the first and the last have this; so do some without.
TWO_BREAKS = r"[\r\n][^\r\n]*[\r\n]"
#: Characters of a part by default.
PART_CHARS = 1 << 20


def text_parts(docs: DataFrame, id_col: str = "doc_id", part_chars: int = PART_CHARS) -> DataFrame:
    """(id, part, text): every text cut into parts of equal length."""
    last = F.greatest(F.floor((F.length("text") - 1) / part_chars), F.lit(0)).cast("int")
    numbers = F.when(F.col("text").isNotNull(), F.sequence(F.lit(0), last)).otherwise(F.array(F.lit(0)))
    cut = F.substring(F.col("text"), F.col("part") * part_chars + 1, F.lit(part_chars))
    return docs.select(id_col, "text", F.explode(numbers).alias("part")).select(id_col, "part", cut.alias("text"))


def _middle(raw: Column) -> Column:
    """The lines between the first and the last."""
    return F.transform(F.slice(raw, 2, F.size(raw) - 2), trimmed)


def _event(lines: Column) -> Column:
    """The state that lines leave; NULL if they leave it as it is."""
    step = lambda state, line: F.when(opens(line), True).when(closes(line), False).otherwise(state)
    return F.aggregate(lines, F.lit(None).cast("boolean"), step)


def _counts(lines: Column) -> Column:
    """(n_in, n_out): instructions of lines entered inside a body, and of the same lines entered outside."""
    start = F.struct(*(F.lit(v).cast(t).alias(n) for n, v, t in (("a", True, "boolean"), ("b", False, "boolean"), ("n_in", 0, "long"), ("n_out", 0, "long"))))

    def step(state: Column, line: Column) -> Column:
        opening, closing = opens(line), closes(line)
        hit = ~opening & ~closing & is_instruction(line)
        set_ = lambda s: F.when(opening, True).when(closing, False).otherwise(state[s])
        count = lambda s, n: state[n] + F.when(state[s] & hit, 1).otherwise(0)
        return F.struct(set_("a").alias("a"), set_("b").alias("b"), count("a", "n_in").alias("n_in"), count("b", "n_out").alias("n_out"))

    return F.aggregate(lines, start, step)


def _reduced(parts: DataFrame, id_col: str, counted: bool) -> DataFrame:
    """(id, place, text, part, event, n_in, n_out, n_lines): one row per line across parts, in order.

    A row holds the line that a part ends and, if there are lines between the part's first and last, the part and
    what they do; ``text`` is NULL where there is no line. Parts are reduced, and shuffled by document, once. A line
    that lies in two neighbouring parts is put together there; only lines over more parts are gathered.
    """
    split = parts.select(F.col(id_col).alias("id"), "part", "text", F.split("text", BREAK).alias("raw"))
    broken = F.coalesce(F.size("raw") > 1, F.lit(False))
    lines = split.select(
        "id", "part", broken.alias("broken"), F.col("text").startswith("\n").alias("lf"), F.col("text").endswith("\r").alias("ends_cr"),
        F.get("raw", 0).alias("head"), F.when(broken, F.element_at("raw", -1)).alias("tail"), F.when(F.size("raw") > 2, _middle(F.col("raw"))).alias("lines"),
    )
    counts = _counts(F.col("lines")) if counted else F.lit(None).cast("struct<n_in:long,n_out:long>")
    small = lines.select(
        "id", "part", "broken", "lf", "ends_cr", "head", "tail", F.when(F.col("lines").isNotNull(), F.size("lines")).alias("n_lines"),
        _event(F.col("lines")).alias("event"), counts.alias("m"),
    )
    order = Window.partitionBy("id").orderBy("part")
    pieces = staged(
        small.select(
            "id", "part", "broken", "lf", "n_lines", "event", "m.n_in", "m.n_out", "head", F.when(F.lead(F.lit(True)).over(order).isNull(), F.col("tail")).alias("end"),
            F.count_if("broken").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("place"),
            F.lag("tail").over(order).alias("before"), F.lag("ends_cr").over(order).alias("cr"), F.lag("broken").over(order).alias("follows"),
        ),
        "pieces",
    )
    # A line begins after a break in the part before, or with the document.
    begins = F.coalesce("follows", F.lit(True))
    text = F.concat(F.coalesce("before", F.lit("")), F.coalesce("head", F.lit("")))
    both = F.coalesce(F.col("cr") & F.col("follows") & F.col("lf"), F.lit(False))
    middle = [F.when(F.col("n_lines") > 0, F.col("part")).alias("part"), "event", "n_in", "n_out", F.coalesce("n_lines", F.lit(0)).alias("n_lines")]
    two = pieces.filter(F.col("broken") & begins).select("id", "place", text.alias("text"), both.alias("both"), F.lit(True).alias("known"), *middle)
    many = pieces.filter(~(F.col("broken") & begins)).groupBy("id", "place").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", text.alias("text")))), lambda p: p["text"]), "").alias("text"),
        F.coalesce(F.bool_or("lf") & F.bool_or(F.col("cr") & F.col("follows")), F.lit(False)).alias("both"),
        F.bool_or(F.col("head").isNotNull() | F.col("before").isNotNull()).alias("known"),
        F.max(middle[0]).alias("part"), *[F.max(c).alias(c) for c in middle[1:4]], F.max(middle[4]).alias("n_lines"),
    )
    none = [F.lit(None).cast(t).alias(n) for n, t in (("part", pieces.schema["part"].dataType), ("event", "boolean"), ("n_in", "long"), ("n_out", "long"))]
    last = pieces.filter("end IS NOT NULL").select(
        "id", (F.col("place") + 1).alias("place"), F.col("end").alias("text"), F.lit(False).alias("both"), F.lit(True).alias("known"), *none, F.lit(0).alias("n_lines")
    )
    # A break of two characters whose halves lie in two parts is one: there is no line between them.
    line = F.when(F.col("known") & ~(F.col("both") & (F.col("text") == "")), trimmed(F.col("text")))
    return two.unionByName(many).unionByName(last).select("id", "place", line.alias("text"), "part", "event", "n_in", "n_out", "n_lines")


def _entered(places: DataFrame) -> DataFrame:
    """Rows with the state on entry of the line and of the lines after it, and the number of lines before it."""
    known = F.col("text").isNotNull()
    own = F.when(known & opens(F.col("text")), True).when(known & closes(F.col("text")), False)
    marked = places.withColumn("own", own)
    earlier = Window.partitionBy("id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.coalesce("event", "own"), ignorenulls=True).over(earlier)
    return marked.withColumns(
        {"inside": F.coalesce(before, F.lit(False)), "lines_before": F.coalesce(F.sum(F.col("n_lines") + known.cast("int")).over(earlier), F.lit(0))}
    ).withColumn("inside_after", F.coalesce("own", "inside"))


def instruction_count_of_parts(parts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n): instruction lines inside function bodies of every document."""
    known = _entered(_reduced(parts, id_col, counted=True))
    one = F.when(F.col("text").isNotNull() & F.col("inside") & F.col("own").isNull() & is_instruction(F.col("text")), 1).otherwise(0)
    more = F.coalesce(F.when(F.col("inside_after"), F.col("n_in")).otherwise(F.col("n_out")), F.lit(0))
    read = known.filter("text IS NOT NULL OR part IS NOT NULL")
    counted = read.groupBy("id").agg(F.sum(one + more).alias("n"))
    unknown = parts.groupBy(F.col(id_col).alias("id")).agg(F.max(F.col("text").isNotNull()).alias("some")).filter(~F.col("some"))
    return counted.unionByName(unknown.select("id", F.lit(None).cast("long").alias("n"))).withColumnRenamed("id", id_col)


def body_lines_of_parts(parts: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, line_no, line, is_instruction) for the lines inside function bodies.

    Texts meet their state by document and part, so that no document is gathered. Lines across parts and states
    are read for both and therefore written once, before.
    """
    held = ["id", "part", "text", "own", "inside", "inside_after", "lines_before"]
    known = staged(_entered(_reduced(parts, id_col, counted=False)).select(*held), "entered")
    single = known.filter("text IS NOT NULL AND inside AND own IS NULL")
    single = single.select(F.col("id"), F.col("lines_before").cast("int").alias("line_no"), F.col("text").alias("line"))
    after = F.col("lines_before") + F.col("text").isNotNull().cast("int")
    entry = known.filter("part IS NOT NULL").select(
        F.col("id").alias("of"), F.col("part").alias("of_part"), F.col("inside_after").alias("inside"), after.alias("lines_before")
    )
    texts = parts.select(F.col(id_col).alias("id"), "part", "text").filter(F.col("text").rlike(TWO_BREAKS))
    met = texts.join(entry, texts["id"].eqNullSafe(entry["of"]) & (texts["part"] == entry["of_part"]))
    met = met.select("id", "inside", "lines_before", F.split("text", BREAK).alias("raw"))
    kind = "array<struct<line_no:int,line:string>>"
    start = F.struct(F.col("inside").alias("inside"), F.col("lines_before").cast("int").alias("line_no"), F.array().cast(kind).alias("lines"))

    def step(state: Column, line: Column) -> Column:
        opening, closing = opens(line), closes(line)
        here = F.struct(state["line_no"].alias("line_no"), line.alias("line"))
        return F.struct(
            F.when(opening, True).when(closing, False).otherwise(state["inside"]).alias("inside"),
            (state["line_no"] + 1).alias("line_no"),
            F.when(state["inside"] & ~opening & ~closing, F.array_append(state["lines"], here)).otherwise(state["lines"]).alias("lines"),
        )

    inside = F.aggregate(_middle(F.col("raw")), start, step, lambda state: state["lines"])
    many = met.select("id", F.explode(inside).alias("l")).select("id", "l.line_no", "l.line")
    return single.unionByName(many).withColumn("is_instruction", is_instruction(F.col("line"))).withColumnRenamed("id", id_col)
