"""Text rewriting and word splitting as chains of built-in expressions."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: special tokens, rewrite rules, word classes ----------------
BASE_SPECIALS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
CODE_SPECIALS = ("[REG]", "[ADDR]", "[NUM]", "[TYPE]", "[GLOB]", "[LBL]", "[MD]", "[STR]")

WORD = r"\p{L}\p{N}_"
NOT_BEFORE_WORD = rf"(?<![{WORD}])"
NOT_AFTER_WORD = rf"(?![{WORD}])"

REWRITE_RULES = (
    ("register", rf"%[{WORD}.]+", "[REG]"),
    ("address", r"0x[0-9A-Fa-f]+", "[ADDR]"),
    ("number", rf"{NOT_BEFORE_WORD}\p{{Nd}}++{NOT_AFTER_WORD}", "[NUM]"),
    ("type", rf"{NOT_BEFORE_WORD}(?:i8|i16|i32|i64|float|double){NOT_AFTER_WORD}", "[TYPE]"),
    ("global", rf"@[{WORD}.]+", "[GLOB]"),
    ("label", rf"(?<![{WORD}.])(\.*+)[{WORD}][{WORD}.]*+:", "$1[LBL]:"),
    ("metadata", r"!\p{Nd}+", "[MD]"),
    ("string", r'c"[^\n]*?"', "[STR]"),
)

SPACE = r"\s\p{Z}"
PUNCTUATION = r"!-/:-@\[-`{-~\p{P}"
IDEOGRAPH = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"
CONTROL = r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{7F}-\x{9F}\x{FFFD}]"
# -------------------------------------------------------------------------------


def normalize_text(c: Column, metadata_first: bool = False) -> Column:
    """Apply the rewrite rules in order.

    Runs are matched from their start and never given back, so that very long
    words without spaces cost no more than their length.

    The default order turns ``!12`` into ``![NUM]`` because numbers are rewritten
    before metadata; ``metadata_first`` moves the metadata rule to the front.
    """
    rules = sorted(REWRITE_RULES, key=lambda r: metadata_first and r[0] != "metadata")
    for _, pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return c


@functools.cache
def accent_table() -> tuple[str, str]:
    """Every BMP letter whose canonical decomposition is one base letter plus marks."""
    accented, plain = [], []
    for point in range(0xC0, 0x10000):
        if 0xAC00 <= point <= 0xD7A3 or 0xD800 <= point <= 0xDFFF:
            continue
        char = chr(point)
        base = [p for p in unicodedata.normalize("NFD", char) if unicodedata.category(p) != "Mn"]
        if len(base) == 1 and base[0] != char:
            accented.append(char)
            plain.append(base[0])
    return "".join(accented), "".join(plain)


def strip_accents(c: Column) -> Column:
    accented, plain = accent_table()
    return F.regexp_replace(F.translate(c, accented, plain), r"\p{Mn}+", "")


def fold_text(c: Column, lowercase: bool = True, accents: bool = True) -> Column:
    """Optional accent stripping and lower-casing, in that order."""
    if accents:
        c = strip_accents(c)
    return F.lower(c) if lowercase else c


def word_pattern(specials: tuple[str, ...] = ()) -> str:
    """Alternatives, first match wins: a special token, an ideograph, one
    punctuation mark, or a run of anything else that is not space."""
    atoms = [s.replace("[", r"\[").replace("]", r"\]") for s in specials]
    atoms += [f"[{IDEOGRAPH}]", f"[{PUNCTUATION}]", f"[^{SPACE}{PUNCTUATION}{IDEOGRAPH}]+"]
    return "(" + "|".join(atoms) + ")"


def words(c: Column, specials: tuple[str, ...] = ()) -> Column:
    cleaned = F.regexp_replace(c, CONTROL, "")
    return F.regexp_extract_all(cleaned, F.lit(word_pattern(specials)), F.lit(1))
