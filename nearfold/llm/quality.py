"""Quality rules: counted base rules and the fertility of a public tokeniser.

Every distinct word of a batch is encoded once, with the mark of a leading blank, by the vocabulary's
own encoder; a document's measures are sums over its words:

* ``chars_per_token``: code points in words by tokens;
* ``byte_share``: share of tokens that stand for a single byte because no piece covers a character;
* ``token_entropy``: entropy of the document's token counts in bits, divided by the most that so many
  tokens and the vocabulary allow.

A document is rejected when a measure leaves the band of its language. Bands are a parameter. The least
chars_per_token below is fitted on labels: those of even doc_id in sf0.1 (1,707 labelled documents that pass
the base rules), per language the bound, in steps of 0.01, with the largest share of quality 0 rejected less
share of quality 1 rejected, of those that reject at most 5 % of quality 1. The other sides are wide: labelled
junk lies below good text, not above it, in chars_per_token, hardly differs in entropy and has no byte tokens,
so labels give no reason to reject there; they are meant for text that is no language at all. Languages
without a band of their own have no labels and use the wide band of ``*``.

Edge cases: a null or empty text, or one of white space, has no words, counts 0 everywhere and fails
the base rules. A null language uses ``*``. Texts of any length are measured whole. Repeated rows are
judged each; other columns are not touched.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from nearfold.llm.blocks import SPACES, Texts, cut, gram_hashes

#: Folder of the public vocabularies, on every machine.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "piece_bpe_32k.model"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: (least, most) of chars_per_token, most byte_share, least token_entropy.
Band = tuple[float, float, float, float]
BANDS: dict[str, Band] = {
    "en": (2.10, 8.0, 0.30, 0.35),
    "fr": (1.90, 8.0, 0.30, 0.35),
    "de": (2.12, 8.0, 0.30, 0.35),
    "es": (1.88, 8.0, 0.30, 0.35),
    "*": (0.6, 8.0, 0.60, 0.30),
}

MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean,"
    " n_tokens long, chars_per_token double, byte_share double, token_entropy double"
)


@functools.cache
def load_pieces(folder: str, name: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{name}")


def repeated_places(values: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Per text: places that lie in a run of ``size`` values found twice or more in the text."""
    texts = len(at) - 1
    grams = gram_hashes(values, size)
    if not len(grams):
        return np.zeros(texts, dtype=np.int64)
    owner = np.repeat(np.arange(texts), np.diff(at))
    inside = np.flatnonzero(owner[: len(grams)] == owner[size - 1 :])
    order = inside[np.lexsort((grams[inside], owner[inside]))]
    same = (grams[order][1:] == grams[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    hit = np.zeros(len(values), dtype=bool)
    for shift in range(size):
        hit[order[twice] + shift] = True
    return np.bincount(owner[hit], minlength=texts)


def repeated_lines(text: bytes) -> int:
    lines = [line for line in text.split(b"\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def _tokens(words, counts: np.ndarray, hashes: np.ndarray, model) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words end to end, and how many each text has."""
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    spelled = [words.data[words.starts[i] : words.ends[i]].tobytes().decode() for i in first]
    ids = model.encode(spelled, num_threads=1)
    sizes = np.array([len(x) for x in ids], dtype=np.int64)
    flat = np.array([x for word in ids for x in word], dtype=np.int64)
    begin = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    per_word = sizes[inverse]
    total = np.concatenate(([0], np.cumsum(per_word)))
    place = np.arange(total[-1]) - np.repeat(total[:-1], per_word) + np.repeat(begin[inverse], per_word)
    return flat[place], np.diff(total[words.at])


def measure(texts: Texts, languages: list[str | None], bands: dict[str, Band], model) -> dict[str, np.ndarray]:
    n = len(texts)
    words = texts.words()
    counts, hashes = words.counts(), words.hashes()
    owner = np.repeat(np.arange(n), counts)
    starts_point = (texts.data & 0xC0) != 0x80
    points = np.concatenate(([0], np.cumsum(starts_point)))
    word_chars = np.bincount(owner, weights=points[words.ends] - points[words.starts], minlength=n).astype(np.int64)
    symbol = np.isin(texts.data, np.frombuffer(SYMBOLS, np.uint8))
    symbols = np.diff(np.concatenate(([0], np.cumsum(symbol)))[texts.at])
    repeat = repeated_places(hashes, words.at, 3)
    tokens, per_text = _tokens(words, counts, hashes, model)
    token_owner = np.repeat(np.arange(n), per_text)
    fallback = np.array([model.is_byte(t) for t in range(model.vocab_size())])
    bytes_used = np.bincount(token_owner[fallback[tokens]], minlength=n)
    pairs, times = np.unique(token_owner * model.vocab_size() + tokens, return_counts=True)
    share = times / per_text[pairs // model.vocab_size()]
    entropy = np.bincount(pairs // model.vocab_size(), weights=-share * np.log2(share), minlength=n)
    some = np.maximum(per_text, 1)
    most = np.log2(np.maximum(np.minimum(some, model.vocab_size()), 2))
    failed = (counts < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * counts)
    band = np.array([bands.get(lang or "*", bands["*"]) for lang in languages]).reshape(n, 4)
    fertility, share, entropy = word_chars / some, bytes_used / some, entropy / most
    good = (fertility >= band[:, 0]) & (fertility <= band[:, 1]) & (share <= band[:, 2]) & (entropy >= band[:, 3])
    return {
        "n_words": counts, "word_chars": word_chars, "n_symbols": symbols,
        "n_dup_lines": np.array([repeated_lines(texts.raw(i)) for i in range(n)], dtype=np.int64),
        "n_repeat_words": repeat, "base_failed": failed, "kept": ~failed & good,
        "n_tokens": per_text, "chars_per_token": fertility, "byte_share": share, "token_entropy": entropy,
    }


def judge(docs: DataFrame, keep: list[str], bands: dict[str, Band] | None = None, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, prefix: str = "") -> DataFrame:
    """The columns ``keep`` of every document, then its measures; ``docs`` has text and lang.

    ``prefix`` keeps the measures' names apart from those of ``keep``.
    """
    bands = bands or BANDS
    columns = [*dict.fromkeys([*keep, "text", "lang"])]
    types = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(prefix + m.strip() for m in MEASURES.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load_pieces(folder, vocabulary)
        for batch in cut(batches):
            at = {name: i for i, name in enumerate(batch.schema.names)}
            found = measure(Texts(batch.column(at["text"])), batch.column(at["lang"]).to_pylist(), bands, model)
            kept = [batch.column(at[c]) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(v) for v in found.values())], [*keep, *(prefix + name for name in found)])

    return docs.select(*columns).mapInArrow(run, schema)


def keep_good(docs: DataFrame, **options) -> DataFrame:
    """The documents that no rule rejects, with their own columns only."""
    own = docs.columns
    prefix = "measure_"
    while any(c.startswith(prefix) for c in own):
        prefix += "_"
    return judge(docs, own, prefix=prefix, **options).where(f"{prefix}kept").select(*own)
