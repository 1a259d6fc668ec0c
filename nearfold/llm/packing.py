"""Packing documents into sequences: best fit decreasing, certified by lower bounds.

Every text is encoded and closed with an end id. A document of more than ``size`` ids is cut into pieces of
``size``, of which the first may be shorter; a piece of ``size`` ids is a sequence of its own. All other
pieces are dealt to groups of about ``GROUP`` by a hash of their row. A group packs its pieces by best fit
decreasing and compares the number of its sequences with a lower bound: dual feasible functions map lengths
to weights such that no sequence weighs more than one, so the weights' sum, rounded up, bounds every packing.

* Bound met: no packing of the group needs fewer, its sequences are final, but for the least filled one.
* A gap is left: full sequences are final, as nothing is wasted in them; all other pieces are exchanged.

Exchanged pieces are dealt anew, to fewer and larger groups under another hash, and packed again, as long as this
saves sequences and the bound of all that is exchanged is not met. ``certified`` says whether a sequence
is full or comes from a group (or a last exchange) that met its bound.

Encoding: a text is cut at blanks and line feeds where the vocabulary's own splitting rule must cut it
too, every distinct cutting of a batch is encoded once, and the ids are put together again. Cuttings of plain
Latin text go through the rank form of the vocabulary, which is faster and gives the same ids; all others,
and those with a special token's string, through its ``tokenizers`` form.

Edge cases: a null or empty text is the end id alone. Texts of any length are encoded whole. Repeated rows
and rows with equal or null ids are packed each. Columns of the input named like a result are refused. An
empty table gives no rows. Sequence numbers are unique, not gapless.
"""

from __future__ import annotations

import base64
import functools
import re
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.blocks import Texts, cut, span_hashes, byte_values
from nearfold.session import staged

#: Folder of the public vocabularies, on every machine, and one vocabulary in its two forms there.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k"
SPECIAL = b"<|endoftext|>"
END = 2
SIZE = 1024

#: Pieces that a group packs at first, on average, and after exchanges, each of which doubles them, at most.
#: Groups grow in number with the input, not in size.
GROUP, MOST_IN_GROUP = 8192, 1 << 20
#: Exchanges at most; each has to save sequences for the next to happen.
ROUNDS = 8
#: Text that is encoded at once; more text repeats more words.
BATCH_BYTES = 8 * 1024 * 1024
#: Parameters of the step functions among the dual feasible ones.
STEPS = 32

PIECES = "piece int, start long, length long, ids_crc32 long"

# --- fixed values: bytes beside which a text may be cut ------------------------------------
_BLANK, _LINE = 0x20, 0x0A
_PRINTED = (0x21, 0x7E)  # printed ASCII
_ACCENTED = (0xC3, 0xC9)  # first bytes of accented Latin letters, none of which is white space
# -------------------------------------------------------------------------------------------
_PLAIN = re.compile("[\n -~À-ÖØ-öø-ɏ]*")


def cuts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Starts of the parts that can be encoded on their own, texts' starts included.

    Before a blank that stands before a printed character: the splitting rule puts just this blank before
    the word. Before a line feed after a printed character: white space never belongs to what stands before.
    """
    n = len(data)
    if not n:
        return np.zeros(0, dtype=np.int64)
    printed = (data >= _PRINTED[0]) & (data <= _PRINTED[1])
    follows = (printed & (data != ord("<"))) | ((data >= _ACCENTED[0]) & (data <= _ACCENTED[1]))
    here = np.zeros(n, dtype=bool)
    here[:-1] = (data[:-1] == _BLANK) & follows[1:]
    here[1:] |= (data[1:] == _LINE) & printed[:-1]
    here[at[:-1][np.diff(at) > 0]] = True
    return np.flatnonzero(here)


class Encoder:
    """Ids of short texts by one vocabulary."""

    def __init__(self, folder: str, name: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(str(Path(folder) / f"{name}.json"))
        with (Path(folder) / f"{name}.tiktoken").open("rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
        self.ranks = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, parts: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(parts)
        rare = []
        for i, part in enumerate(parts):
            text = part.decode()
            if SPECIAL not in part and _PLAIN.fullmatch(text):
                out[i] = self.ranks.encode_ordinary(text)
            else:
                rare.append(i)
        for i, found in zip(rare, self.whole.encode_batch([parts[i].decode() for i in rare], add_special_tokens=False), strict=True):
            out[i] = found.ids
        return out


@functools.cache
def encoder(folder: str, name: str) -> Encoder:
    return Encoder(folder, name)


def encode(texts: Texts, model: Encoder, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts end to end, each closed by ``end``, and where each text's ids begin."""
    begins = cuts(texts.data, texts.at)
    ends = np.append(begins[1:], len(texts.data)) if len(begins) else begins
    hashes = span_hashes(byte_values(texts.data), begins, ends) if len(begins) else np.zeros(0, np.uint64)
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    found = model.encode([texts.data[begins[i] : ends[i]].tobytes() for i in first])
    found.append([end])
    sizes = np.array([len(x) for x in found], dtype=np.int64)
    flat = np.fromiter((i for x in found for i in x), dtype=np.uint32, count=int(sizes.sum()))
    offset = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    # One more part, the end id, closes every text.
    parts = np.searchsorted(begins, texts.at)
    which = np.insert(inverse, parts[1:], len(found) - 1)
    at = parts + np.arange(len(parts))
    per = sizes[which]
    total = np.concatenate(([0], np.cumsum(per)))
    place = np.arange(total[-1]) - np.repeat(total[:-1] - offset[which], per)
    return flat[place], total[at]


def pieces(docs: DataFrame, keep: list[str], size: int = SIZE, end: int = END, with_ids: bool = False, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` of every document, once for each of its pieces, then the piece; ``ids`` on demand."""
    types = dict(docs.dtypes)
    ids = ", ids array<int>" if with_ids else ""
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), PIECES + ids])
    names = [*keep, *(part.split()[0] for part in (PIECES + ids).split(", "))]
    if len(set(names)) < len(names):
        raise ValueError(f"columns {keep} clash with {PIECES}")
    columns = [*dict.fromkeys([*keep, "text"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(folder, vocabulary)
        for batch in cut(batches, limit=BATCH_BYTES):
            where = {name: i for i, name in enumerate(batch.schema.names)}
            flat, at = encode(Texts(batch.column(where["text"])), model, end)
            lengths = np.diff(at)
            number = -(-lengths // size)
            row = np.repeat(np.arange(len(lengths)), number)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(number) - number, number)
            head = lengths[row] - (number[row] - 1) * size  # length of the first piece
            start = np.where(piece == 0, 0, head + (piece - 1) * size)
            length = np.where(piece == 0, head, size)
            begin = at[:-1][row] + start
            stored = flat.astype("<u4")
            crc = np.fromiter((zlib.crc32(stored[b : b + n]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)), dtype=np.int64, count=len(row))
            taken = pa.array(row)
            out = [*(batch.column(where[c]).take(taken) for c in keep), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)]
            if with_ids:
                out.append(pa.ListArray.from_arrays(np.append(begin, len(flat)).astype(np.int32), pa.array(flat.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(*columns).mapInArrow(run, schema)


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(sequence, offset) of every length, and how many sequences. Equal lengths are placed together."""
    order = np.argsort(-lengths, kind="stable")
    sequence, offset = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
    free: list[list[np.ndarray]] = [[] for _ in range(size + 1)]  # by free places: sequences with so many
    made = 0
    values, counts = np.unique(lengths, return_counts=True)
    done = 0
    for value, count in zip(values[::-1].tolist(), counts[::-1].tolist(), strict=True):
        items, done = order[done : done + count], done + count
        room = value
        while len(items):
            while room < size and not free[room]:
                room += 1
            each = room // value
            if room == size:
                open_ = np.arange(made, made + -(-len(items) // each))
                made += len(open_)
            else:
                open_ = np.concatenate(free[room])
                free[room] = []
            now, items = items[: len(open_) * each], items[len(open_) * each :]
            k = np.arange(len(now))
            sequence[now] = open_[k // each]
            offset[now] = size - room + k % each * value
            full, rest = divmod(len(now), each)
            free[room - each * value].append(open_[:full])
            if rest:
                free[room - rest * value].append(open_[full : full + 1])
            if full + bool(rest) < len(open_):
                free[room].append(open_[full + bool(rest) :])
            free[0].clear()
    return sequence, offset, made


@functools.cache
def dual_feasible(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights by length, a function a row, and what a whole sequence weighs at most."""
    x = np.arange(size + 1, dtype=np.int64)
    rows, whole = [x], [size]
    for least in range(1, size // 2 + 1):
        # Long ones take a whole sequence, short ones nothing.
        rows.append(np.where(x > size - least, size, np.where(x >= least, x, 0)))
        whole.append(size)
        # By how many of the least length fit beside it.
        most = size // least
        rows.append(np.where(2 * x > size, most - (size - x) // least, np.where(x >= least, 1, 0)))
        whole.append(most)
    for k in range(1, STEPS + 1):
        scaled = (k + 1) * x
        rows.append(np.where(scaled % size == 0, x * k, scaled // size * size))
        whole.append(size * k)
    return np.array(rows), np.array(whole, dtype=np.int64)


def lower_bound(tally: np.ndarray) -> int:
    """Least number of sequences for ``tally[n]`` pieces of every length n up to the size."""
    weights, whole = dual_feasible(len(tally) - 1)
    return int((-(-(weights @ tally.astype(np.int64)) // whole)).max())


def _bound_of(df: DataFrame, size: int) -> int:
    tally = np.zeros(size + 1, dtype=np.int64)
    for row in df.groupBy("length").count().collect():  # at most ``size`` rows
        tally[row["length"]] = row["count"]
    return lower_bound(tally)


def _pack_groups(pool: DataFrame, size: int, number: int) -> DataFrame:
    """One round: ``pool`` dealt, packed and judged group by group."""
    groups = max(1, -(-pool.count() // min(GROUP << number, max(GROUP, MOST_IN_GROUP))))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in pool.dtypes), "sequence_id long", "offset long", "final boolean", "certified boolean"])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.drop_columns("dealt").sort_by([("length", "descending"), ("uid", "ascending")]).combine_chunks()
        lengths = table.column("length").to_numpy()
        sequence, offset, made = best_fit_decreasing(lengths, size)
        met = made == lower_bound(np.bincount(lengths, minlength=size + 1))
        load = np.bincount(sequence, weights=lengths, minlength=made)
        full = load == size
        final = full | met
        if groups > 1 and not full.all():
            final[load.argmin()] = False
        unique = (((number << 33) + key[0].as_py() << 24) + sequence) * 2
        for name, values in (("sequence_id", unique), ("offset", offset), ("final", final[sequence]), ("certified", (full | met)[sequence])):
            table = table.append_column(name, pa.array(values))
        return table

    dealt = pool.withColumn("dealt", F.pmod(F.xxhash64("uid", F.lit(number)), F.lit(groups)))
    return staged(dealt.groupBy("dealt").applyInArrow(run, schema), "packed")


def _sequences(df: DataFrame) -> int:
    return df.agg(F.count_distinct("sequence_id")).head()[0]


def packed(items: DataFrame, size: int = SIZE) -> DataFrame:
    """``items`` (uid, length, ...) with 0 < length < size and a sequence, an offset and ``certified`` for each."""
    now = _pack_groups(items, size, 0)
    done = now.where("final")
    for number in range(1, ROUNDS + 1):
        pool = now.where("not final")
        needed = _sequences(pool)
        if needed <= _bound_of(pool, size):
            # Also when the pool is empty: what was exchanged cannot be packed into fewer.
            now = pool.withColumn("certified", F.lit(True))
            break
        again = _pack_groups(pool.select(*items.columns), size, number)
        if _sequences(again) >= needed:
            now = pool
            break
        done = done.unionByName(again.where("final"))
        now = again
    else:
        now = now.where("not final")
    return done.unionByName(now).drop("final")


def pack(docs: DataFrame, keep: list[str], size: int = SIZE, end: int = END, with_ids: bool = False, **vocabulary) -> DataFrame:
    """Every piece of every document with its place: ``sequence_id``, ``offset`` and ``certified``.

    ``keep`` are the document's columns to carry along; ``with_ids`` adds the ids themselves.
    """
    if {"uid", "dealt", "final", "sequence_id", "offset", "certified"} & set(keep):
        raise ValueError(f"columns {keep} clash with the result's own")
    table = pieces(docs, keep, size, end, with_ids, **vocabulary).withColumn("uid", F.monotonically_increasing_id())
    table = staged(table, "pieces")
    rows = table.drop("ids")
    whole = rows.where(F.col("length") == size).select(
        *rows.columns, (F.col("uid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified")
    )
    out = whole.unionByName(packed(rows.where(F.col("length") < size), size))
    return (out.join(table.select("uid", "ids"), "uid") if with_ids else out).drop("uid")


def sequences(pieces_with_ids: DataFrame) -> DataFrame:
    """(sequence_id, ids, lengths): the sequences themselves; ``lengths`` tells where documents meet."""
    row = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return pieces_with_ids.groupBy("sequence_id").agg(row.alias("row")).select(
        "sequence_id", F.flatten(F.col("row.ids")).alias("ids"), F.col("row.length").alias("lengths")
    )
