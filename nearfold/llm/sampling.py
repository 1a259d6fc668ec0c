"""Sampled segmentations of SentencePiece vocabularies: Gumbel top-k without replacement.

A text becomes chunks (white-space marks and what follows them, up to the next mark); no piece crosses a
chunk, so the lattice of a text is the chain of its chunks' lattices, and the lattices of a batch's
different chunks are built once. Every segmentation has a log-probability, the sum of its pieces'; adding
Gumbel noise and taking the k largest draws k distinct segmentations without replacement. The search is
A*: the noise of the best member of a whole set of segmentations is drawn from the set's total mass, which
the backward sums give exactly, under the bound of the set it was split from. The set with the largest
value is opened: its best member is drawn, and what is left splits into sets that leave this member's path
at one place. So values come out in falling order and nothing is enumerated.

The vocabularies carry merge ranks, not probabilities; piece r of the ranking gets the Zipf weight
1 / (r + SHIFT). Characters without a piece are spelled in byte pieces, as is the mark itself, so decoding
gives back every text exactly.

The noise depends on (seed, row key, path, place) only: a row's samples do not change with partitions,
batches or other rows. ``inclusion`` is the chance that a segmentation of this probability beats the
(k + 1)-th value; log_prob over it weighs samples. Fewer segmentations than k give fewer rows, with
inclusion 1. A null or empty text has one segmentation, of no pieces. Rows that share a key get noise by
key alone, so equal rows give equal samples.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfold.llm.blocks import Texts, byte_values, cut, mixed, powers, release, span_hashes
from nearfold.llm.quality import TOKENIZERS, VOCABULARY, load_pieces
from nearfold.llm.repeats import spans

SHIFT = 2.7
#: Log-probability of a byte piece.
BYTE_WEIGHT = -16.0
#: Bytes of text whose lattices are built together.
BATCH = 4 * 1024 * 1024


class Pieces:
    """The vocabulary's pieces as bytes, with a table of all their prefixes by hash."""

    def __init__(self, folder: str, name: str) -> None:
        model = load_pieces(folder, name)
        size = model.vocab_size()
        normal = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.first_byte = next(i for i in range(size) if model.is_byte(i))
        text = {i: model.id_to_piece(i).replace("▁", " ").encode() for i in normal}
        weight = np.zeros(size)
        weight[normal] = -np.log(np.arange(1, len(normal) + 1) + SHIFT)
        weight[normal] -= np.log(np.exp(weight[normal]).sum())
        self.weight = weight
        known = {p: i for i, p in text.items()}
        prefixes = sorted({p[:n] for p in known for n in range(1, len(p) + 1)})
        at = np.concatenate(([0], np.cumsum([len(p) for p in prefixes])))
        hashes = span_hashes(byte_values(np.frombuffer(b"".join(prefixes), np.uint8)), at[:-1], at[1:])
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.id_of = np.array([known.get(prefixes[i], -1) for i in order])
        self.slots = np.searchsorted(self.hashes, np.arange(1 << 20, dtype=np.uint64) << np.uint64(44))
        self.slots = np.append(self.slots, len(hashes))
        self.depth = int(np.diff(self.slots).max())
        self.longest = max(map(len, known))
        raw = [text.get(i, bytes([i - self.first_byte]) if model.is_byte(i) else b"") for i in range(size)]
        self.raw_at = np.concatenate(([0], np.cumsum([len(r) for r in raw])))
        self.raw = np.frombuffer(b"".join(raw), np.uint8)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(is it a prefix, id of the piece or -1) for every hash."""
        slot = (hashes >> np.uint64(44)).astype(np.int64)
        begin, end = self.slots[slot], self.slots[slot + 1]
        place = np.full(len(hashes), -1)
        for step in range(self.depth):
            at = np.minimum(begin + step, len(self.hashes) - 1)
            place[(begin + step < end) & (self.hashes[at] == hashes)] = step
        found = place >= 0
        return found, np.where(found, self.id_of[np.where(found, begin + place, 0)], -1)

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of a segmentation; the mark before its first word is not part of it."""
        size = self.raw_at[ids + 1] - self.raw_at[ids]
        return self.raw[spans(self.raw_at[ids], size)].tobytes()[1:]


@functools.cache
def load_vocabulary(folder: str, name: str) -> Pieces:
    return Pieces(folder, name)


def _order(key: np.ndarray, most: int) -> np.ndarray:
    """Stable order of keys from 0 to ``most``. Where they fit beside it, places are sorted along with the keys, which is
    several times faster than sorting places by key."""
    bits = len(key).bit_length()
    if int(most).bit_length() + bits > 63:
        return np.argsort(key, kind="stable")
    return np.sort((key << bits) | np.arange(len(key))) & ((1 << bits) - 1)


class Lattices:
    """Lattices of chunks data[at[c]:at[c + 1]]; node p + c stands before byte p of chunk c."""

    def __init__(self, data: np.ndarray, at: np.ndarray, pieces: Pieces) -> None:
        n, chunks = len(data), len(at) - 1
        self.data = data
        owner = np.repeat(np.arange(chunks), np.diff(at))
        values = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(byte_values(data) * powers(0x9E3779B97F4A7C15, n), out=values[1:])
        scale = powers(pow(0x9E3779B97F4A7C15, -1, 1 << 64), n + 1)
        starts = np.flatnonzero((data & 0xC0) != 0x80)
        width = np.diff(np.append(starts, n))  # bytes of the character
        live, room = starts, at[1:][owner[starts]] - starts
        covered = np.zeros(n, dtype=bool)
        width_at = np.zeros(n, dtype=np.int64)
        width_at[starts] = width
        src, dst, ids = [], [], []
        for length in range(1, pieces.longest + 1):
            keep = room >= length
            live, room = live[keep], room[keep]
            known, piece = pieces.find(mixed((values[live + length] - values[live]) * scale[live]))
            hit = piece >= 0
            src.append(live[hit])
            dst.append(live[hit] + length)
            ids.append(piece[hit])
            covered[live[hit][width_at[live[hit]] == length]] = True
            live, room = live[known], room[known]
        bare = starts[~covered[starts]]
        src, dst, ids = np.concatenate([*src, bare]), np.concatenate([*dst, bare + width_at[bare]]), np.concatenate([*ids, np.full(len(bare), -1)])
        of = owner[src]
        weight = np.where(ids >= 0, pieces.weight[ids], BYTE_WEIGHT * (dst - src))
        distance = at[1:][of] - src
        self.first, self.last = at[:-1] + np.arange(chunks), at[1:] + np.arange(chunks)
        src, dst = (src + of).astype(np.int32), (dst + of).astype(np.int32)
        share = self._sum_up(n + chunks, distance, src, dst, weight)
        # Edges by node, the likeliest first: a draw mostly ends with the first.
        order = _order((src.astype(np.int64) << 16) + (65535 - np.rint(share * 65535)).astype(np.int64), (n + chunks) << 16)
        self.src, self.dst, self.ids = src[order], dst[order], ids[order].astype(np.int32)
        self.weight, self.share = weight[order], share[order]
        begin = np.flatnonzero(np.concatenate(([True], self.src[1:] != self.src[:-1])))
        size = np.diff(np.append(begin, len(order)))
        self.edge = np.zeros(n + chunks, dtype=np.int32)
        self.edge_end = np.zeros(n + chunks, dtype=np.int32)
        self.edge[self.src[begin]], self.edge_end[self.src[begin]] = begin, begin + size
        self.below = np.cumsum(self.share)
        self.below -= np.repeat(self.below[begin] - self.share[begin], size)
        self.below[begin + size - 1] = 2.0

    def _sum_up(self, nodes: int, distance: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Backward sums per node; every edge's share of what leaves its node."""
        self.total = np.zeros(nodes)
        order = _order(distance * np.int64(nodes + 1) + src, (int(distance.max(initial=0)) + 1) * (nodes + 1))
        edge = np.searchsorted(distance[order], np.arange(1, int(distance.max(initial=0)) + 2))
        by_src, by_dst, by_weight = src[order], dst[order], weight[order]
        for begin, end in zip(edge[:-1], edge[1:], strict=True):
            if begin == end:
                continue
            value = by_weight[begin:end] + self.total[by_dst[begin:end]]
            new = np.flatnonzero(np.concatenate(([True], by_src[begin + 1 : end] != by_src[begin : end - 1])))
            top = np.maximum.reduceat(value, new)
            size = np.diff(np.append(new, end - begin))
            self.total[by_src[begin:end][new]] = top + np.log(np.add.reduceat(np.exp(value - np.repeat(top, size)), new))
        return np.exp(weight + self.total[dst] - self.total[src])

    def choose(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge that leaves each node, by its share."""
        edge = self.edge[node]
        on = np.flatnonzero(u >= self.below[edge])
        while len(on):
            edge[on] += 1
            on = on[u[on] >= self.below[edge[on]]]
        return edge

    def leaving(self, node: int) -> tuple[int, int]:
        return int(self.edge[node]), int(self.edge_end[node])

    def draw(self, chunk: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A random segmentation of every chunk: edges end to end, and offsets per chunk."""
        who, node, step = np.arange(len(chunk)), self.first[chunk], 0
        last = self.last[chunk]
        drawn, by = [], []
        while len(who):
            edge = self.choose(node, uniform(key[who], step))
            drawn.append(edge)
            by.append(who)
            node = self.dst[edge]
            on = node < last[who]
            who, node, step = who[on], node[on], step + 1
        owner = np.concatenate(by) if by else np.zeros(0, np.int64)
        order = np.argsort(owner, kind="stable")
        return (np.concatenate(drawn)[order] if drawn else owner), np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(chunk)))))


def uniform(key: np.ndarray, step: int) -> np.ndarray:
    """In (0, 1), by key and step."""
    bits = mixed(key + np.uint64((step * 0x9E3779B97F4A7C15 + 1) & ((1 << 64) - 1))) >> np.uint64(11)
    return (bits.astype(np.float64) + 0.5) * 2.0**-53


def bounded(mass: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Gumbel noise with this log mass, given that it is below the bound."""
    return mass - np.logaddexp(mass - bound, np.log(-np.log(u)))


_ALL = (1 << 64) - 1


class _Row:
    """The search of one text. Sets are (-value, tie, path, chunk, step, edges excluded); step -1 is any."""

    def __init__(self, key: int, k: int) -> None:
        self.key, self.k, self.draws = key ^ 0x5DEECE66D, k, 0
        self.queue: list[tuple] = []
        self.paths: list[dict] = []

    def noise(self) -> float:
        """As ``uniform``, for one number."""
        self.draws += 1
        v = (self.key + self.draws * 0x9E3779B97F4A7C15 + 1) & _ALL
        v = ((v ^ (v >> 30)) * 0xBF58476D1CE4E5B9) & _ALL
        v = ((v ^ (v >> 27)) * 0x94D049BB133111EB) & _ALL
        return (((v ^ (v >> 31)) >> 11) + 0.5) * 2.0**-53

    def push(self, mass: float, bound: float, *where) -> None:
        a, b = mass - bound, math.log(-math.log(self.noise()))
        value = mass - max(a, b) - math.log1p(math.exp(-abs(a - b)))
        heapq.heappush(self.queue, (-value, len(self.queue) + self.draws, *where))


def sample(texts: Texts, keys: np.ndarray, k: int, pieces: Pieces) -> list[list[dict]]:
    """Per text its samples: edges' ids end to end, log_prob, value and inclusion."""
    n = len(texts)
    lengths = np.diff(texts.at)
    # Every text gets a mark in front.
    data = np.full(len(texts.data) + n, 32, dtype=np.uint8)
    data[np.arange(len(texts.data)) + np.repeat(np.arange(1, n + 1), lengths)] = texts.data
    at = texts.at + np.arange(n + 1)
    new = (data == 32) & np.concatenate(([True], data[:-1] != 32))
    new[at[:-1]] = True
    full = np.repeat(lengths > 0, lengths + 1)
    begin = np.flatnonzero(new & full)
    if not len(begin):
        return [_finished(_Row(int(key), k), None, pieces) for key in keys]
    end = np.minimum(np.append(begin[1:], len(data)), at[1:][np.searchsorted(at, begin, side="right") - 1])
    _, once, chunk = np.unique(span_hashes(byte_values(data), begin, end), return_index=True, return_inverse=True)
    size = (end - begin)[once]
    lattices = Lattices(data[spans(begin[once], size)], np.concatenate(([0], np.cumsum(size))), pieces)
    of = np.searchsorted(at, begin, side="right") - 1
    chunk_at = np.searchsorted(of, np.arange(n + 1))
    place = np.arange(len(chunk)) - chunk_at[of]
    mass = lattices.total[lattices.first[chunk]]
    rows = [_Row(int(key), k) for key in keys]

    def drawn(which: np.ndarray, path: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Segmentations of the chunks ``which``, their weights, and noise for leaving them."""
        key = mixed(keys[of[which]] + np.uint64((path * 0xD1342543DE82EF95) & ((1 << 64) - 1))) ^ mixed(place[which].astype(np.uint64))
        edges, edge_at = lattices.draw(chunk[which], key)
        weights = np.add.reduceat(lattices.weight[edges], edge_at[:-1]) if len(which) else np.zeros(0)
        return edges, edge_at, weights, uniform(key, -1)

    def take(row: int, begin: int, weights: np.ndarray, noise: np.ndarray, before: float, value: float, path: int) -> None:
        """Queue the sets that leave this path in chunk ``begin`` or later, as many as can still be opened."""
        if not len(weights):
            return
        own = mass[chunk_at[row] + begin : chunk_at[row + 1]]
        behind = np.cumsum(own[::-1])[::-1] - own
        rest = -np.expm1(np.minimum(weights - own, 0.0))  # of the chunk's mass, without this path
        some = np.flatnonzero(rest > 1e-13)
        if not len(some):
            return
        log_mass = before + np.cumsum(weights)[some] - weights[some] + own[some] + np.log(rest[some]) + behind[some]
        values = bounded(log_mass, value, noise[some])
        best = np.argpartition(-values, k)[: k + 1] if len(values) > k + 1 else np.arange(len(values))
        for i in best:
            heapq.heappush(rows[row].queue, (-float(values[i]), path * 1_000_000_007 + int(some[i]), path, begin + int(some[i]), -1, ()))

    edges, edge_at, weights, noise = drawn(np.arange(len(chunk)), 0)
    for row in np.flatnonzero(lengths > 0):
        lo, hi = chunk_at[row], chunk_at[row + 1]
        total = float(mass[lo:hi].sum())
        value = total - math.log(-math.log(rows[row].noise()))
        rows[row].total = total
        rows[row].paths.append({"edges": edges[edge_at[lo] : edge_at[hi]], "at": edge_at[lo : hi + 1] - edge_at[lo], "weights": weights[lo:hi], "value": value})
        take(row, 0, weights[lo:hi], noise[lo:hi], 0.0, value, 0)
    for path in range(1, k):
        heads = []
        for row in np.flatnonzero(lengths > 0):
            if rows[row].queue and len(rows[row].paths) == path:
                heads.append((row, *_leave(rows[row], lattices, mass[chunk_at[row] : chunk_at[row + 1]])))
        if not heads:
            break
        which = np.concatenate([np.arange(chunk_at[row] + c + 1, chunk_at[row + 1]) for row, _, c, *_ in heads])
        edges, edge_at, weights, noise = drawn(which, path)
        done = 0
        for row, parent, c, inside, value in heads:
            m = chunk_at[row + 1] - chunk_at[row] - c - 1
            lo, hi = edge_at[done], edge_at[done + m]
            old = rows[row].paths[parent]
            kept = old["at"][c]
            head = np.concatenate((old["edges"][:kept], inside))
            chunk_weight = float(lattices.weight[inside].sum())
            rows[row].paths.append({
                "edges": np.concatenate((head, edges[lo:hi])),
                "at": np.concatenate((old["at"][: c + 1], len(head) + edge_at[done : done + m + 1] - lo)),
                "weights": np.concatenate((old["weights"][:c], [chunk_weight], weights[done : done + m])), "value": value,
            })
            take(row, c + 1, weights[done : done + m], noise[done : done + m], float(old["weights"][:c].sum()) + chunk_weight, value, path)
            done += m
    return [_finished(row, lattices, pieces) for row in rows]


def _leave(row: _Row, lattices: Lattices, mass: np.ndarray) -> tuple[int, int, np.ndarray, float]:
    """Open the best set: (its path, chunk, edges of a new member in that chunk, value)."""
    value, _, parent, c, step, excluded = heapq.heappop(row.queue)
    value = -value
    path = row.paths[parent]
    old = path["edges"][path["at"][c] : path["at"][c + 1]]
    share = lattices.share[old]
    around = float(path["weights"][:c].sum()) + float(mass[c + 1 :].sum())
    begin = np.concatenate(([0.0], np.cumsum(lattices.weight[old])))  # weight of the chunk's edges before a step
    node_mass = lambda t: around + begin[t] + lattices.total[lattices.src[old[t]]]
    if step < 0:  # at which edge of the chunk does the member leave the path?
        leave = np.maximum(np.exp(begin[:-1] + lattices.total[lattices.src[old]]) * (1 - share), 0.0) if len(old) else np.zeros(0)
        nodes = lattices.src[old]
        leave[lattices.edge_end[nodes] - lattices.edge[nodes] == 1] = 0.0
        step = int(np.searchsorted(np.cumsum(leave), row.noise() * leave.sum(), side="right"))
        for t in np.flatnonzero(leave > 0):
            if t != step:
                row.push(node_mass(t) + math.log(max(1 - share[t], 1e-300)), value, parent, c, int(t), (int(old[t]),))
        excluded = (int(old[step]),)
    lo, hi = lattices.leaving(lattices.src[old[step]])
    free = np.array([e for e in range(lo, hi) if e not in excluded])
    odds = lattices.share[free]
    chosen = int(free[min(int(np.searchsorted(np.cumsum(odds), row.noise() * odds.sum(), side="right")), len(free) - 1)])
    left = float(odds.sum() - lattices.share[chosen])
    if len(free) > 1 and left > 0:
        row.push(node_mass(step) + math.log(left), value, parent, c, step, (*excluded, chosen))
    inside, node = [*map(int, old[:step]), chosen], int(lattices.dst[chosen])
    new, last, weight = len(row.paths), int(lattices.dst[old[-1]]), float(begin[step] + lattices.weight[chosen])
    while node < last:  # the rest of the chunk, and the sets that leave it there
        lo, hi = lattices.leaving(node)
        edge, u = int(lo), row.noise()
        while u >= lattices.below[edge]:
            edge += 1
        if hi - lo > 1 and lattices.share[edge] < 1:
            row.push(around + weight + lattices.total[node] + math.log1p(-min(lattices.share[edge], 1 - 1e-16)), value, new, c, len(inside), (edge,))
        inside.append(edge)
        weight += float(lattices.weight[edge])
        node = int(lattices.dst[edge])
    return parent, c, np.array(inside, dtype=np.int64), value


def _finished(row: _Row, lattices: Lattices | None, pieces: Pieces) -> list[dict]:
    if not row.paths:
        return [{"ids": np.zeros(0, dtype=np.int32), "log_prob": 0.0, "inclusion": 1.0}]
    bar = -row.queue[0][0] - row.total if row.queue else -math.inf
    out = []
    for path in row.paths:
        edges = path["edges"]
        ids = lattices.ids[edges]
        if (ids < 0).any():
            bytes_of = lattices.dst[edges] - lattices.src[edges]
            size = np.where(ids < 0, bytes_of, 1)
            spelled = np.repeat(ids, size)
            bare = np.flatnonzero(spelled < 0)
            node = lattices.src[edges[ids < 0]].astype(np.int64)
            spelled[bare] = pieces.first_byte + lattices.data[spans(node - (np.searchsorted(lattices.first, node, side="right") - 1), size[ids < 0])]
            ids = spelled
        log_prob = float(path["weights"].sum()) - row.total
        inclusion = 1.0 if bar == -math.inf else -math.expm1(-math.exp(min(log_prob - bar, 700.0)))
        out.append({"ids": ids.astype(np.int32), "log_prob": log_prob, "inclusion": inclusion})
    return out


SAMPLES = "sample int, n_pieces int, log_prob double, inclusion double, ids_sha256 string, exact boolean"


def sampled(docs: DataFrame, k: int, key_col: str = "doc_id", seed: int = 0, with_ids: bool = True, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, batch_bytes: int = BATCH, carried: Sequence[str] = ()) -> DataFrame:
    """(key, sample, n_pieces, log_prob, inclusion, ids_sha256, exact[, ids], carried columns): up to k samples a row.

    ``sample`` counts from 1 in falling order of the noisy values; ``exact`` says that decoding the ids
    gave the text back; ``ids_sha256`` is over the ids as little-endian 32-bit numbers. ``batch_bytes``
    of text are worked on together, at about a hundred bytes of memory each; results do not depend on it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        pieces = load_vocabulary(folder, vocabulary)
        for batch in cut(batches, limit=batch_bytes):
            texts = Texts(batch.column(1))
            ids = batch.column(0)
            keys = mixed(ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) + np.uint64(seed)) ^ ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint64)
            out: dict[str, list] = {name: [] for name in ("row", "sample", "n_pieces", "log_prob", "inclusion", "ids_sha256", "exact", "ids")}
            for i, found in enumerate(sample(texts, keys, k, pieces)):
                raw = texts.raw(i)
                for rank, s in enumerate(found, 1):
                    values = (i, rank, len(s["ids"]), s["log_prob"], s["inclusion"], hashlib.sha256(s["ids"].astype("<i4").tobytes()).hexdigest(), pieces.decode(s["ids"]) == raw, s["ids"])
                    for name, value in zip(out, values, strict=True):
                        out[name].append(value)
            row = pa.array(out.pop("row"), pa.int64())
            columns = {key_col: ids.take(row), "sample": pa.array(out["sample"], pa.int32()), "n_pieces": pa.array(out["n_pieces"], pa.int32())}
            columns |= {name: pa.array(out[name]) for name in ("log_prob", "inclusion", "ids_sha256", "exact")}
            if with_ids:
                columns["ids"] = pa.array(out["ids"], pa.list_(pa.int32()))
            columns |= {name: batch.column(2 + i).take(row) for i, name in enumerate(carried)}
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"`{key_col}` long, {SAMPLES}" + ", ids array<int>" * with_ids
    kept = docs.select(F.col(key_col).cast("long").alias(key_col), "text", *carried)
    schema += "".join(f", `{name}` {type_}" for name, type_ in kept.dtypes[2:])
    return kept.mapInArrow(run, schema)


def decoded(samples: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``samples`` with a column ``text``, decoded from ``ids``; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load_vocabulary(folder, vocabulary)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids")).to_pylist()
            text = pa.array([None if x is None else pieces.decode(np.array(x, dtype=np.int64)).decode() for x in ids], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, "text"])

    own = samples.drop("text")
    return own.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in own.dtypes) + ", text string")
