"""Hidden states to one vector per document, and weighted loss."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.functions.exact import exact_sum
from nearfold.functions.vectors import as_doubles, l2_normalize, scaled
from nearfold.operators.clusters import vector_mean


def mix_layers(hidden: DataFrame, strategy: str = "last", n: int = 4) -> DataFrame:
    """(doc_id, chunk_no, pos, vec, mask) from (doc_id, chunk_no, layer, pos, vec, mask).

    The layers wanted are a filter on ``layer``, so the others are never read.
    """
    last = hidden.agg(F.max("layer")).head()[0]
    if last is None:
        raise ValueError("no hidden states")
    depth = {"last": 1, "last_n": n, "last_n_weighted": n, "all_mean": last + 1}.get(strategy)
    if depth is None:
        raise ValueError(f"unknown layer strategy: {strategy}")
    first = max(last + 1 - depth, 0)
    kept = hidden.filter(F.col("layer") >= first)
    weight = F.col("layer") - F.lit(first - 1) if strategy == "last_n_weighted" else None
    # Dealt by chunk once; pooling a chunk's tokens then needs no further exchange.
    return kept.repartition("doc_id", "chunk_no").groupBy("doc_id", "chunk_no", "pos").agg(
        vector_mean(F.col("vec"), weight).alias("vec"), F.max("mask").alias("mask")
    )


def pool_tokens(tokens: DataFrame, method: str = "token_mean") -> DataFrame:
    """(doc_id, chunk_no, vec, n_tokens): masked mean over tokens, or the first token.

    A chunk without unmasked tokens gives zeros.
    """
    weight = F.greatest(F.sum("mask"), F.lit(1)).alias("n_tokens")
    keys = ["doc_id", "chunk_no"]
    if method == "cls":
        first = F.max(F.when(F.col("pos") == 0, as_doubles(F.col("vec")))).alias("vec")
        return tokens.groupBy(*keys).agg(first, weight)
    if method != "token_mean":
        raise ValueError(f"unknown pooling method: {method}")
    masked = scaled(as_doubles(F.col("vec")), F.col("mask"))
    sums = tokens.groupBy(*keys).agg(vector_mean(masked).alias("m"), F.count("*").alias("n"), weight)
    return sums.select(*keys, scaled(F.col("m"), F.col("n") / F.col("n_tokens")).alias("vec"), "n_tokens")


def combine_chunks(chunks: DataFrame, weighting: str = "token_count", normalization: str = "none") -> DataFrame:
    """(doc_id, embedding): uniform or token-count weighted mean of chunk vectors."""
    if weighting not in ("uniform", "token_count"):
        raise ValueError(f"unknown chunk weighting: {weighting}")
    if normalization not in ("none", "l2"):
        raise ValueError(f"unknown normalization: {normalization}")
    weight = F.greatest(F.col("n_tokens"), F.lit(1)) if weighting == "token_count" else None
    merged = chunks.groupBy("doc_id").agg(vector_mean(F.col("vec"), weight).alias("embedding"))
    if normalization == "l2":
        merged = merged.withColumn("embedding", l2_normalize(F.col("embedding")))
    return merged


def weighted_perplexity(batches: DataFrame) -> DataFrame:
    """(loss, perplexity) from (loss, masked_tokens) per batch; batches without masked tokens are skipped.

    Equal for batches in any order.
    """
    used = F.when(F.col("masked_tokens") > 0, F.col("masked_tokens"))
    total = exact_sum(F.when(used.isNotNull(), F.col("loss").cast("double") * used))
    row = batches.agg(total.alias("s"), F.sum(used).alias("n"))
    loss = F.when(F.col("n") > 0, F.col("s") / F.col("n")).otherwise(
        F.raise_error(F.lit("no masked tokens in any batch")).cast("double")
    )
    return row.select(loss.alias("loss")).withColumn("perplexity", F.exp("loss"))
