"""Instruction counting on program text, one document per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: what counts as an instruction line --------------------------
OPCODES = (
    "add", "fadd", "sub", "fsub", "mul", "fmul", "udiv", "sdiv", "fdiv", "urem", "srem", "frem", "shl",
    "lshr", "ashr", "and", "or", "xor", "freeze", "alloca", "load", "store", "fence", "cmpxchg", "atomicrmw",
    "getelementptr", "trunc", "zext", "sext", "fptrunc", "fpext", "uitofp", "sitofp", "fptoui", "fptosi",
    "inttoptr", "ptrtoint", "bitcast", "addrspacecast", "icmp", "fcmp", "phi", "select", "call", "callbr",
    "invoke", "va_arg", "extractelement", "insertelement", "shufflevector", "extractvalue", "insertvalue",
    "landingpad", "catchpad", "cleanuppad", "catchswitch", "catchret", "cleanupret", "resume", "br",
    "switch", "indirectbr", "ret", "unreachable",
)
RESULT_PREFIX = r"(%[-0-9A-Za-z_.$]+\s*=\s*)?"
CALL_PREFIX = r"((tail|musttail|notail)\s+)?"
# -------------------------------------------------------------------------------

#: What ends a line.
BREAK = "\r\n|\r|\n"

#: The word where an opcode stands is the fourth group; a word of other letters or with digits is none.
OPERATION = rf"(?i)^{RESULT_PREFIX}{CALL_PREFIX}([A-Za-z_]+)([^\p{{L}}\p{{N}}_]|$)"
#: White space of regular expressions, and the ends of a line that are none.
BLANKS, LINE_ENDS = " \t\n\x0b\f\r", ("\u0085", "\u2028", "\u2029")


def opens(line: Column) -> Column:
    return line.startswith("define ") & line.endswith("{")


def closes(line: Column) -> Column:
    return line == "}"


def is_instruction(line: Column) -> Column:
    comment = line.startswith(";") | line.startswith("!")
    return ~comment & ~line.endswith(":") & F.lower(F.regexp_extract(line, OPERATION, 4)).isin(*OPCODES)


def trimmed(line: Column) -> Column:
    """The line without white space around it; blanks before one last line end go too, which only the pattern knows."""
    ended = line.contains(LINE_ENDS[0]) | line.contains(LINE_ENDS[1]) | line.contains(LINE_ENDS[2])
    return F.when(ended, F.regexp_replace(line, r"^\s+|\s+$", "")).otherwise(F.btrim(line, F.lit(BLANKS)))


def _trimmed_lines(text: Column) -> Column:
    return F.transform(F.split(text, BREAK), trimmed)


def instruction_count(text: Column) -> Column:
    """Instruction lines inside function bodies, folded within the row: no shuffle.

    A text too long for one task goes through ``program_parts``.
    """
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).cast("bigint").alias("n"))

    def step(state: Column, line: Column) -> Column:
        hit = state["inside"] & ~opens(line) & ~closes(line) & is_instruction(line)
        return F.struct(
            F.when(opens(line), True).when(closes(line), False).otherwise(state["inside"]).alias("inside"),
            (state["n"] + F.when(hit, 1).otherwise(0)).alias("n"),
        )

    return F.aggregate(_trimmed_lines(text), start, step, lambda state: state["n"])


def function_body_lines(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, line_no, line, is_instruction) for the lines inside function bodies.

    The state is folded within the row and only lines inside bodies are exploded: no shuffle.
    """
    kind = "array<struct<line_no:int,line:string>>"
    start = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("line_no"), F.array().cast(kind).alias("lines"))

    def step(state: Column, line: Column) -> Column:
        opening, closing = opens(line), closes(line)
        here = F.struct(state["line_no"].alias("line_no"), line.alias("line"))
        return F.struct(
            F.when(opening, True).when(closing, False).otherwise(state["inside"]).alias("inside"),
            (state["line_no"] + 1).alias("line_no"),
            F.when(state["inside"] & ~opening & ~closing, F.array_append(state["lines"], here)).otherwise(state["lines"]).alias("lines"),
        )

    inside = F.aggregate(_trimmed_lines(F.col("text")), start, step, lambda state: state["lines"])
    body = docs.select(id_col, F.explode(inside).alias("l")).select(id_col, "l.line_no", "l.line")
    return body.withColumn("is_instruction", is_instruction(F.col("line")))
