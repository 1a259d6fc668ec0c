"""Command lines and tool logs turned into pass lists and totals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfold.functions.columns import last_path_part, stripped

# --- fixed values: command shape and log totals, in order of preference -------
TOOL = "opt"
TOOL_SUFFIX = " input.bc -o output.bc"
PLACEHOLDER_FILES = ("input.bc", "output.bc")
TOTAL_PATTERNS = (
    r"Total\s+of\s+([0-9]+)\s+instructions",
    r"Total\s+(?:Insts|Instructions)\s*:\s*([0-9]+)",
    r"Total\s+number\s+of\s+insts\s*:\s*([0-9]+)",
    r"Total\s+inst(?:ruction)?s?\s*[:=]\s*([0-9]+)",
)
# -------------------------------------------------------------------------------

#: A word, or a quote that is left open, which is found by itself.
SHELL_WORD = r"""((?:[^\s"']++|"[^"]*+"|'[^']*+')+|["'])"""
QUOTED = r""""([^"]*)"|'([^']*)'"""


def affix_passes(command: Column) -> Column:
    """Pass list after cutting the tool name off the front and the file arguments off the end."""
    text = F.regexp_replace(stripped(command), rf"^{TOOL}( |$)", "")
    text = F.when(
        text.endswith(TOOL_SUFFIX), F.substring(text, F.lit(1), F.length(text) - len(TOOL_SUFFIX))
    ).otherwise(text)
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def shell_words(command: Column) -> Column:
    """Words as a shell would split them; NULL when a quote is left open."""
    quoted = lambda t: t.contains('"') | t.contains("'")
    plain = lambda t: F.when(quoted(t), F.regexp_replace(t, QUOTED, "$1$2")).otherwise(t)
    found = F.array(F.regexp_extract_all(command, F.lit(SHELL_WORD), F.lit(1)))
    closed = lambda words: ~F.exists(words, lambda t: t.isin('"', "'"))
    return F.get(F.transform(found, lambda words: F.when(closed(words), F.transform(words, plain))), 0)


def token_passes(command: Column) -> Column:
    """Pass list by looking at each shell word: the tool, ``-o`` with its
    argument and the placeholder files are dropped wherever they stand."""
    # The words are used three times over; as the argument of a function over an array of one they are found once.
    without_tool = F.transform(
        F.array(shell_words(command)),
        lambda words: F.when(
            last_path_part(F.get(words, 0)).startswith(TOOL), F.slice(words, F.lit(2), F.size(words))
        ).otherwise(words),
    )
    tokens = F.get(without_tool, 0)
    start = F.struct(
        F.array().cast("array<string>").alias("kept"), F.lit(False).alias("is_argument")
    )

    def step(state: Column, token: Column) -> Column:
        name = F.when(token.contains("/"), last_path_part(token)).otherwise(token)
        skip = state["is_argument"] | (token == "-o") | name.isin(*PLACEHOLDER_FILES)
        return F.struct(
            F.when(skip, state["kept"]).otherwise(F.concat(state["kept"], F.array(token))).alias("kept"),
            (~state["is_argument"] & (token == "-o")).alias("is_argument"),
        )

    return F.aggregate(tokens, start, step, lambda state: state["kept"])


def pass_names(tokens: Column) -> Column:
    """Tokens that look like a pass flag (dashes, then a letter), without the dashes."""
    flags = F.filter(tokens, lambda t: t.rlike(r"^-+\p{L}"))
    return F.transform(flags, lambda t: F.regexp_replace(t, "^-+", ""))


def log_total(log: Column) -> Column:
    """Instruction total in a tool log; earlier patterns win over later ones."""
    hits = [F.nullif(F.regexp_extract(log, "(?i)" + p, 1), F.lit("")) for p in TOTAL_PATTERNS]
    return F.coalesce(*hits).try_cast("bigint")
