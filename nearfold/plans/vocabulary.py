"""Train a sub-word vocabulary from a corpus and describe the run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.functions.text import BASE_SPECIALS, CODE_SPECIALS, normalize_text
from nearfold.operators.tokens import train_vocabulary, word_frequency
from nearfold.session import staged


def learn_vocabulary(
    docs: DataFrame,
    vocab_size: int,
    min_frequency: int = 2,
    preprocess: bool = True,
    lowercase: bool = True,
    accents: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, config): (id, token) rows and a one-row description.

    The marks that rewriting leaves in the text become special tokens.
    """
    text = normalize_text(F.col("text")) if preprocess else F.col("text")
    specials = (*BASE_SPECIALS, *CODE_SPECIALS) if preprocess else BASE_SPECIALS
    counts = word_frequency(docs.select(text.alias("text")), specials, lowercase=lowercase, accents=accents)
    vocab = staged(train_vocabulary(counts, vocab_size, min_frequency, specials), "vocabulary")
    files = docs.agg(F.count("*").alias("files_used"))
    config = files.select(
        F.lit(preprocess).alias("preprocessing"),
        "files_used",
        F.lit(vocab_size).alias("vocab_size_requested"),
        F.lit(vocab.count()).alias("vocab_size_actual"),
        F.lit(min_frequency).alias("min_frequency"),
        F.lit(lowercase).alias("lowercase"),
        F.lit(accents).alias("strip_accents"),
        F.array(*[F.lit(t) for t in specials[len(BASE_SPECIALS) :]]).cast("array<string>").alias("special_tokens"),
    )
    return vocab, config
