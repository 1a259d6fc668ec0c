"""Documents to vectors, with the embedding model as a hook."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.functions.text import BASE_SPECIALS, CODE_SPECIALS, normalize_text
from nearfold.operators.pooling import combine_chunks
from nearfold.operators.tokens import chunk_tokens, encode

#: Maps chunks (doc_id, chunk_no, input_ids, attention_mask, ...) to
#: (doc_id, chunk_no, vec, n_tokens). A model runs inside it with ``mapInPandas``.
Embedder = Callable[[DataFrame], DataFrame]


def hashing_embedder(dim: int = 256) -> Embedder:
    """Feature hashing of token ids. A stand-in that needs no model weights; it
    is not equivalent to a trained encoder."""

    def embed(chunks: DataFrame) -> DataFrame:
        named = chunks.withColumn("terms", F.col("input_ids").cast("array<string>"))
        counted = HashingTF(inputCol="terms", outputCol="hashed", numFeatures=dim).transform(named)
        n = F.aggregate("attention_mask", F.lit(0), lambda s, m: s + m)
        return counted.select("doc_id", "chunk_no", vector_to_array("hashed").alias("vec"), n.alias("n_tokens"))

    return embed


def embed_documents(
    docs: DataFrame,
    vocab: DataFrame,
    embedder: Embedder | None = None,
    max_length: int = 512,
    stride: int = 128,
    weighting: str = "token_count",
    normalization: str = "l2",
    preprocess: bool = True,
    specials: Sequence[str] = (*BASE_SPECIALS, *CODE_SPECIALS),
) -> DataFrame:
    """(doc_id, embedding): rewrite, encode, chunk, embed each chunk, combine.

    The only shuffle is the one that combines a document's chunks.
    """
    text = normalize_text(F.col("text")) if preprocess else F.col("text")
    encoded = encode(docs.select("doc_id", text.alias("text")), vocab, specials)
    named = {r["token"]: r["id"] for r in vocab.filter(F.col("token").isin(*BASE_SPECIALS)).collect()}
    chunks = chunk_tokens(encoded, max_length, stride, named["[CLS]"], named["[SEP]"], list(named.values()))
    return combine_chunks((embedder or hashing_embedder())(chunks), weighting, normalization)
