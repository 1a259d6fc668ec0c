"""Near-duplicate classes by an exact Jaccard join on word shingles, with several global token orders.

Two sets of similarity >= t share a token in their prefixes (the first n - ceil(t n) + 1 tokens) under any
global order. Candidates must do so under every one of ORDERS orders: in each, tokens that many documents
have come last and the rest follow a hash of their own. The filters are intersected before sets are
compared.

Documents with equal sets are one from the start. A set that has enough tokens of its own to fill a prefix
has no partner, as partners differ in fewer; counting these tokens over all documents, among a share of
all tokens that a hash selects, leaves a few suspects, and only their texts go further. A token that lies in few prefixes gives all its pairs;
one that lies in many (a class of near copies, in the end) gives its members' pairs with one pivot, in
linear number. Verified links join classes; then only pairs whose ends are still in different classes are
looked at, and of these only such as the sets' marks allow: each set has MARKS bits, bit b telling whether an odd
number of its tokens hash to b, and sets differ in at least as many tokens as their marks do in bits. A pair is formed
once, under the smallest full token that its ends share. Thus no link between different classes is lost, and copies are
never expanded into all pairs.

Frequent tokens are counted over all suspects. The set that is sent to the executors has at most
MOST_FREQUENT tokens by construction: the count from which a token is frequent is at least the number of
counted tokens divided by it.

Edge cases: a null text, or one without words, has an empty set and links with nothing; its class is its
own id. A null id belongs to its text's class but never names one. Repeated rows are rows like others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfold.llm.blocks import BATCH_BYTES, Texts, cut, lowered, mixed, release, span_hashes
from nearfold.llm.repeats import pack, rows_of, unpack, unpack_all
from nearfold.session import staged

SHINGLE, PERCENT = 5, 75
ORDERS = (0x51AFD7ED558CCD00, 0x0E9FE1A85EC53B00)
#: Sets under one token up to which all pairs are formed.
FEW = 24
#: A token in so many documents or more is frequent; at most so many tokens are.
FREQUENT, MOST_FREQUENT = 24, 1_000_000
#: Pivots of a token in more sets; rounds in which each set meets its likeliest partner.
PIVOTS, ROUNDS = 3, 2
#: Bits of a set's marks; members of a token that are compared in one group with as many others.
MARKS, TILE = 2048, 4096
#: Tokens of a bucket; sets that meet one pivot in a task.
BUCKET_TOKENS, SALT = 1_500_000, 200
_SHORT = np.uint64((1 << 48) - 1)
#: Numbers from here on stand for texts without an id; ids have to be smaller.
UNNAMED = 1 << 62

_PACKED = "dealt int, kind int, units long, payload binary"


def _by_owner(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Order by (owner, leading bits of value), ties as they stand."""
    bits = int(owner.max(initial=0)).bit_length()
    return np.argsort((owner.astype(np.uint64) << np.uint64(64 - bits)) | (value >> np.uint64(bits)) if bits else value, kind="stable")


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, for a worker that has given back what its earlier tasks held."""
    release()
    yield from batches


class Sets:
    """Distinct shingle hashes of a batch of texts; text i has tokens at[i]:at[i + 1], ascending."""

    def __init__(self, texts: Texts, size: int) -> None:
        words = texts.words()
        values, counts = words.hashes(lowered(texts.data)), words.counts()
        n = len(texts)
        grams = np.maximum(counts - size + 1, (counts > 0).astype(counts.dtype))
        owner = np.repeat(np.arange(n), grams)
        start = np.arange(len(owner)) - np.repeat(np.cumsum(grams) - grams, grams) + words.at[:-1][owner]
        tokens = span_hashes(values, start, np.minimum(start + size, words.at[1:][owner]))
        order = _by_owner(owner, tokens)
        tokens, owner = tokens[order], owner[order]
        if ((tokens[1:] < tokens[:-1]) & (owner[1:] == owner[:-1])).any():  # equal in the leading bits only
            order = np.lexsort((tokens, owner))
            tokens, owner = tokens[order], owner[order]
        new = np.ones(len(tokens), dtype=bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
        self.tokens, self.owner = tokens[new], owner[new]
        self.n = np.bincount(self.owner, minlength=n)
        self.at = np.concatenate(([0], np.cumsum(self.n)))
        total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(mixed(self.tokens), dtype=np.uint64)))
        #: An id for every set; equal sets have equal ids, the empty one has 0.
        self.ids = np.where(self.n > 0, mixed(total[self.at[1:]] - total[self.at[:-1]]) >> np.uint64(1), 0).astype(np.int64)

    def once(self) -> np.ndarray:
        """One text of every different set, empty ones left out."""
        _, first = np.unique(self.ids, return_index=True)
        return first[self.n[first] > 0]

    def prefixes(self, seed: int, of: np.ndarray, frequent: np.ndarray) -> np.ndarray:
        """Places of the tokens in the prefixes of the texts ``of``, under one order."""
        chosen = np.zeros(len(self.n), dtype=bool)
        chosen[of] = True
        places = np.flatnonzero(chosen[self.owner])
        tokens, owner = self.tokens[places], self.owner[places]
        rank = mixed(tokens ^ np.uint64(seed)) >> np.uint64(1)
        if len(frequent):
            short = tokens & _SHORT
            at = np.minimum(np.searchsorted(frequent, short), len(frequent) - 1)
            rank |= (frequent[at] == short).astype(np.uint64) << np.uint64(63)
        by = _by_owner(owner, rank)  # ties go by token, as texts list theirs in ascending order
        n = self.n[owner]  # the order leaves owners where they are
        begin = (np.cumsum(chosen * self.n) - chosen * self.n)[owner]
        most = n - (PERCENT * n + 99) // 100 + 1
        return places[by[np.arange(len(by)) - begin < most]]


def _describe(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _fresh(cut(batches)):
            sets = Sets(Texts(batch.column(1)), size)
            low = np.bincount(sets.owner[_low(sets.tokens)], minlength=len(sets.n))
            columns = [batch.column(0), pa.array(sets.n, pa.int64()), pa.array(sets.ids), pa.array(low, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "sid", "low"])

    return run


#: Share of all tokens among which a set's own ones are counted, by a hash of the token.
LOW = 0.4


def _low(tokens: np.ndarray) -> np.ndarray:
    return mixed(tokens ^ np.uint64(ORDERS[0])) < np.uint64(int(LOW * 2**64))


def _low_tokens(size: int, buckets: int):
    """(token, set) of the low tokens of every set, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _fresh(cut(batches)):
            sets = Sets(Texts(batch.column(1)), size)
            chosen = np.zeros(len(sets.n), dtype=bool)
            chosen[sets.once()] = True
            at = np.flatnonzero(chosen[sets.owner] & _low(sets.tokens))
            if len(at):
                tokens = sets.tokens[at]
                yield pa.RecordBatch.from_pydict(rows_of(_by_bucket(_bucket(tokens, 0, buckets), (tokens & _SHORT, sets.ids[sets.owner[at]]))))

    return run


def _several(token: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(tokens, sets, starts of the tokens' groups, sets per group) of distinct pairs, by token."""
    by = np.lexsort((sid, token))
    token, sid = token[by], sid[by]
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
    token, sid = token[new], sid[new]
    starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    return token, sid, starts, np.diff(np.append(starts, len(token)))


def _by_set(sid: np.ndarray, groups: int) -> list[tuple[int, int, int, bytes]]:
    """How often each set occurs in ``sid``, packed by groups of sets."""
    found, times = np.unique(sid, return_counts=True)
    to = (mixed(found.view(np.uint64)) % np.uint64(groups)).astype(np.int32)
    return [(b, 1, 0, payload) for b, _, _, payload in _by_bucket(to, (found, times.astype(np.uint32)))] if len(found) else []


def _own_tokens(groups: int):
    """Per bucket: the sets' tokens that no other set has, counted."""

    def run(table: pa.Table) -> pa.Table:
        _, sid, starts, size = _several(*unpack_all(table["payload"].to_pylist(), ("<u8", "<i8")))
        return pa.table(rows_of(_by_set(sid[starts[size == 1]], groups)))

    return run


def _tally(groups: int, least: int):
    """Per bucket: tokens of so many sets or more (kind 0), and own tokens counted (kind 1)."""

    def run(table: pa.Table) -> pa.Table:
        token, sid, starts, size = _several(*unpack_all(table["payload"].to_pylist(), ("<u8", "<i8")))
        rows = _by_set(sid[starts[size == 1]], groups)
        frequent = token[starts[size >= least]]
        return pa.table(rows_of(rows + ([(0, 0, len(frequent), pack(frequent))] if len(frequent) else [])))

    return run


def _sum_up(table: pa.Table) -> pa.Table:
    sid, times = unpack_all(table["payload"].to_pylist(), ("<i8", "<u4"))
    found, at = np.unique(sid, return_inverse=True)
    return pa.table({"sid": found, "own": np.bincount(at, weights=times).astype(np.int64)})


def _all_tokens(size: int, buckets: int):
    """(token, set) of every suspect, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _fresh(cut(_opened(batches))):
            sets = Sets(Texts(batch.column(1)), size)
            if len(sets.tokens):
                yield pa.RecordBatch.from_pydict(rows_of(_by_bucket(_bucket(sets.tokens, 0, buckets), (sets.tokens & _SHORT, sets.ids[sets.owner]))))

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(sid, text, ...) from (sid, packed, ...)."""
    grow = zstandard.ZstdDecompressor()
    for whole in batches:
        for begin in range(0, whole.num_rows, 256):
            batch = whole.slice(begin, 256)
            text = pa.array([grow.decompress(p.as_py()) for p in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), text, *batch.columns[2:]], ["sid", "text", *batch.schema.names[2:]])


def _by_bucket(bucket: np.ndarray, columns: tuple[np.ndarray, ...]) -> list[tuple[int, int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(bucket.max() + 2)) if len(bucket) else np.zeros(1, int)
    return [(b, 0, 0, pack(*(c[order[lo:hi]] for c in columns))) for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if hi > lo]


def _bucket(tokens: np.ndarray, order: int, buckets: int) -> np.ndarray:
    return (((tokens >> np.uint64(48)) % np.uint64(buckets)).astype(np.int64) * len(ORDERS) + order).astype(np.int32)


def _index(size: int, buckets: int, frequent):
    """(token, set, size, own tokens) of all prefixes, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in _fresh(cut(_opened(batches))):
            sets = Sets(Texts(batch.column(1)), size)
            once = sets.once()
            if not len(once):
                continue
            own = batch.column(2).to_numpy().astype(np.int32)
            rows = []
            for o, seed in enumerate(ORDERS):
                at = sets.prefixes(seed, once, known)
                owner = sets.owner[at]
                rows += _by_bucket(_bucket(sets.tokens[at], o, buckets), (sets.tokens[at] & _SHORT, sets.ids[owner], sets.n[owner].astype(np.int32), own[owner]))
            yield pa.RecordBatch.from_pydict(rows_of(rows))

    return run


#: kind 0: a pair of sets; 1: a pair with a pivot of a full token; 2: a member of a full token (set, size, own).
_FOUND = "kind int, orders int, token long, a long, b long, c long"


def _close(n: np.ndarray, own_n: np.ndarray, m: np.ndarray, own_m: np.ndarray) -> np.ndarray:
    """Can sets of these sizes, so many tokens of which no other set has, be similar enough?"""
    most = np.minimum(n - own_n, m - own_m)
    return 100 * most >= PERCENT * (n + m - most)


def _pair_up(table: pa.Table) -> pa.Table:
    order = int(table["dealt"][0].as_py()) % len(ORDERS)
    token, sid, n, own = unpack_all(table["payload"].to_pylist(), ("<u8", "<i8", "<i4", "<i4"))
    n, own = n.astype(np.int64), own.astype(np.int64)
    by = np.lexsort((sid, own, token))  # within a token those with the fewest tokens of their own first
    token, sid, n, own = token[by], sid[by], n[by], own[by]
    new = np.concatenate(([True], (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])))
    token, sid, n, own = token[new], sid[new], n[new], own[new]
    starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    size = np.diff(np.append(starts, len(token)))

    def paired(begin: np.ndarray, count: np.ndarray, steps: int, step_from_start: bool) -> np.ndarray:
        """Pairs of places up to ``steps`` apart, or of every place with the first ``steps`` ones."""
        a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for step in range(1, steps + 1):
            some = count > step
            left = count[some] - step
            offset = np.arange(left.sum()) - np.repeat(np.cumsum(left) - left, left)
            first = np.repeat(begin[some], left)
            x = first + (step - 1 if step_from_start else offset)
            y = first + offset + step
            good = _close(n[x], own[x], n[y], own[y])
            a.append(np.minimum(sid[x], sid[y])[good])
            b.append(np.maximum(sid[x], sid[y])[good])
        return np.unique(np.stack((np.concatenate(a), np.concatenate(b))), axis=1)

    few = (size > 1) & (size <= FEW)
    pairs = paired(starts[few], size[few], FEW, False)
    many = size > FEW
    # In a class of near copies the members nearest to the original come first; they are the pivots.
    stars = paired(starts[many], size[many], PIVOTS, True)
    member = np.repeat(many, size)
    m = np.uint64(order << 60) + token[member]
    kinds = np.repeat(np.arange(3, dtype=np.int32), (pairs.shape[1], stars.shape[1], len(m)))
    none = np.zeros(pairs.shape[1] + stars.shape[1], dtype=np.int64)
    return pa.table({
        "kind": kinds, "orders": np.full(len(kinds), 1 << order, np.int32), "token": np.concatenate((none, m.astype(np.int64))),
        "a": np.concatenate((pairs[0], stars[0], sid[member])), "b": np.concatenate((pairs[1], stars[1], n[member])), "c": np.concatenate((none, own[member])),
    })


def _marked(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(sid, marks) of every different set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _fresh(cut(_opened(batches))):
            sets = Sets(Texts(batch.column(1)), size)
            bit = (mixed(sets.tokens ^ np.uint64(ORDERS[1])) % np.uint64(MARKS)).astype(np.int64)
            once = sets.once()
            rows = [np.packbits((np.bincount(bit[sets.at[i] : sets.at[i + 1]], minlength=MARKS) & 1).astype(np.uint8)).tobytes() for i in once]
            yield pa.RecordBatch.from_arrays([pa.array(sets.ids[once], pa.int64()), pa.array(rows, pa.binary())], ["sid", "marks"])

    return run


class _Members:
    """Members of a full token, one chunk of them: sets, sizes, classes, marks and all full tokens."""

    def __init__(self, table: pa.Table) -> None:
        self.sid, self.label, self.n, self.own = (table[c].to_numpy() for c in ("sid", "label", "n", "own"))
        self.outside = table["outside"].to_numpy(zero_copy_only=False).astype(bool)
        self.marks = np.frombuffer(b"".join(table["marks"].to_pylist()), dtype=np.uint64).reshape(len(table), MARKS // 64)
        tokens = table["tokens"].combine_chunks()
        self.tokens, self.count = tokens.flatten().to_numpy(), np.diff(tokens.offsets.to_numpy())
        self.at = np.cumsum(self.count) - self.count


def _shared(left: _Members, right: _Members, x: np.ndarray, y: np.ndarray, token: int) -> tuple[np.ndarray, np.ndarray]:
    """(full tokens in common, is none of them smaller than ``token``?) of pairs of places."""
    names = np.unique(np.concatenate((left.tokens, right.tokens)))
    here = np.searchsorted(names, token)
    key = np.sort(np.repeat(np.arange(len(right.sid)), right.count) * len(names) + np.searchsorted(names, right.tokens))
    name = np.searchsorted(names, left.tokens)
    common, first = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
    step = max(1, BATCH_BYTES // 8 // int(left.count.max(initial=1)))
    for begin in range(0, len(x), step):
        i, j = x[begin : begin + step], y[begin : begin + step]
        count = left.count[i]
        pair = np.repeat(np.arange(len(i)), count)
        mine = name[np.arange(len(pair)) - np.repeat(np.cumsum(count) - count, count) + left.at[i][pair]]
        asked = j[pair] * len(names) + mine
        both = key[np.minimum(np.searchsorted(key, asked), len(key) - 1)] == asked
        common[begin : begin + step] = np.bincount(pair[both], minlength=len(i))
        first[begin : begin + step] = np.bincount(pair[both & (mine < here)], minlength=len(i)) == 0
    return common, first


def _across(table: pa.Table) -> pa.Table:
    """Pairs of a full token's members in different classes that sizes, own tokens and marks leave similar enough."""
    token = table["token"][0].as_py()
    is_left = table["is_left"].to_numpy(zero_copy_only=False).astype(bool)
    left, right = (_Members(table.filter(pa.array(chosen))) for chosen in (is_left, ~is_left))
    xs, ys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    step = max(1, BATCH_BYTES // 2 // (max(1, len(right.sid)) * MARKS // 8))
    for begin in range(0, len(left.sid), step):
        at = slice(begin, begin + step)
        good = (left.label[at, None] != right.label) & _close(left.n[at, None], left.own[at, None], right.n, right.own)
        good &= ~right.outside | (left.sid[at, None] < right.sid)  # both ways only once
        x, y = np.nonzero(good)
        differ = np.bitwise_count(left.marks[begin + x] ^ right.marks[y]).sum(axis=1, dtype=np.int64)
        # Similar sets share at least t (n + m) / (1 + t) tokens and differ in the rest.
        near = (100 + PERCENT) * differ <= (100 - PERCENT) * (left.n[begin + x] + right.n[y])
        xs.append(begin + x[near])
        ys.append(y[near])
    x, y = np.concatenate(xs), np.concatenate(ys)
    weight, first = _shared(left, right, x, y, token)
    a, b = left.sid[x[first]], right.sid[y[first]]
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b), "weight": weight[first]})


def _verify(size: int) -> Callable[[pa.Table], pa.Table]:
    """Which texts of a group are similar enough to its pivot?"""

    def run(table: pa.Table) -> pa.Table:
        grow = zstandard.ZstdDecompressor()
        pivot = table["a"][0].as_py()
        sids = table["sid"].to_numpy()
        # The pivot first; a row that shares another's id may have another text, its set tells.
        order = np.concatenate((np.flatnonzero(sids == pivot), np.flatnonzero(sids != pivot)))
        mine, linked, begin = None, [], 0
        while begin < len(order):
            end, held, raw = begin, 0, []
            while end < len(order) and (held < BATCH_BYTES or end == begin):
                raw.append(grow.decompress(table["packed"][int(order[end])].as_py()))
                held += len(raw[-1])
                end += 1
            sets, asked = Sets(Texts(pa.array(raw, pa.binary())), size), sids[order[begin:end]]
            begin = end
            if mine is None:
                own = np.flatnonzero((sets.ids == pivot) & (asked == pivot))
                if not len(own):
                    break
                mine = sets.tokens[sets.at[own[0]] : sets.at[own[0] + 1]]
            at = np.minimum(np.searchsorted(mine, sets.tokens), len(mine) - 1)
            both = np.bincount(sets.owner[mine[at] == sets.tokens], minlength=len(asked))
            good = (100 * both >= PERCENT * (len(mine) + sets.n - both)) & (sets.ids == asked) & (asked != pivot)
            linked.append(np.unique(asked[good]))
        found = np.concatenate(linked) if linked else np.zeros(0, dtype=np.int64)
        return pa.table({"a": np.full(len(found), pivot, dtype=np.int64), "b": found})

    return run


def verified(pairs: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """The pairs (a, b) that are similar enough; a text travels, compressed, once per pivot it meets."""
    pairs = staged(pairs.select("a", "b").distinct(), "pairs")
    met = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / SALT).cast("int").alias("salts"))
    asked = pairs.join(met, "a").select(F.col("b").alias("sid"), "a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"))
    hosts = met.select(F.col("a").alias("sid"), "a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    given = texts.join(asked.unionByName(hosts), "sid").select("a", "salt", "sid", "packed")
    return staged(given.groupBy("a", "salt").applyInArrow(_verify(size), "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(sid, label): the smallest id reachable over links (a, b), for every id that has a link.

    Large-star and small-star steps in turn; each is one grouping, written to the shared folder.
    """
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    # A step that changes nothing leaves number and sum of hashes of the edges as they were.
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = staged(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = staged(small.distinct(), "small-star")
        after = mark(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("sid"), F.col("v").alias("label"))


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    # Texts without an id take part under a number beyond all ids, the same for equal texts.
    unnamed = F.lit(UNNAMED) + F.pmod(F.xxhash64(F.col(text_col)), F.lit(UNNAMED))
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), unnamed).alias("doc_id"), F.col(text_col).alias("text"))
    sets = staged(docs.mapInArrow(_describe(shingle), "doc_id long, n_shingles long, sid long, low long"), "sets")
    reps = sets.where("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min("low").alias("low"))
    spark = docs.sparkSession

    def bucket_count(tokens: int | None) -> int:
        return max(1, round((tokens or 0) * (100 - PERCENT) / 100 / BUCKET_TOKENS))

    # Of a partner's tokens fewer than a prefix are not shared, so a set with that many of its own has none.
    prefix = F.expr(f"n - ({PERCENT} * n + 99) div 100 + 1")
    count = sets.agg(F.count("*")).first()[0]
    groups = max(1, -(-count // BUCKET_TOKENS))
    buckets = bucket_count(sets.agg(F.sum("low")).first()[0])
    own = docs.mapInArrow(_low_tokens(shingle, buckets), _PACKED).groupBy("dealt").applyInArrow(_own_tokens(groups), _PACKED)
    own = own.groupBy("dealt").applyInArrow(_sum_up, "sid long, own long")
    suspects = reps.join(own, "sid", "left").where(F.coalesce("own", F.lit(0)) < prefix).select("sid", "rep", "n")
    packed = docs.mapInArrow(_compress, "doc_id long, packed binary")
    suspects = staged(suspects, "suspects")
    texts = staged(packed.join(suspects.hint("merge"), packed["doc_id"] == suspects["rep"]).select("sid", "packed", "n"), "suspect-texts")

    tokens = suspects.agg(F.sum("n")).first()[0] or 0
    buckets = bucket_count(tokens)
    least = max(FREQUENT, tokens // MOST_FREQUENT + 1)
    tally = staged(texts.select("sid", "packed").mapInArrow(_all_tokens(shingle, buckets), _PACKED).groupBy("dealt").applyInArrow(_tally(groups, least), _PACKED), "tally")
    frequent = [unpack(r["payload"])[0] for r in tally.where("kind = 0").toLocalIterator()]
    known = spark.sparkContext.broadcast(np.sort(np.concatenate([*frequent, np.zeros(0, dtype=np.uint64)])))
    own = tally.where("kind = 1").groupBy("dealt").applyInArrow(_sum_up, "sid long, own long")
    texts = texts.join(own, "sid", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    texts = staged(texts.where(F.col("own") < prefix).select("sid", "packed", "own"), "texts")
    indexed = texts.mapInArrow(_index(shingle, buckets, known), _PACKED)
    found = staged(indexed.groupBy("dealt").applyInArrow(_pair_up, _FOUND), "candidates")

    everywhere = (1 << len(ORDERS)) - 1
    full = found.where("kind = 2").groupBy("a").agg(F.bit_or("orders").alias("full")).withColumnRenamed("a", "sid")
    pairs = found.where("kind = 0").groupBy("a", "b").agg(F.bit_or("orders").alias("orders"), F.count("*").alias("weight"))
    # An order in which both ends have a token too full for pairs does not rule the pair out.
    ends = pairs.join(full.select(F.col("sid").alias("a"), F.col("full").alias("fa")), "a", "left").join(full.select(F.col("sid").alias("b"), F.col("full").alias("fb")), "b", "left")
    through = F.col("orders").bitwiseOR(F.coalesce(F.col("fa"), F.lit(0)).bitwiseAND(F.coalesce(F.col("fb"), F.lit(0))))
    passing = staged(ends.where(through == everywhere).select("a", "b", "weight"), "passing")
    stars = found.where("kind = 1").groupBy("a", "b").agg(F.count("*").alias("weight"))

    def labelled(df: DataFrame, column: str, name: str) -> DataFrame:
        other = label.select(F.col("sid").alias(column), F.col("label").alias(name))
        return df.join(other, column, "left").withColumn(name, F.coalesce(name, column))

    def apart(df: DataFrame) -> DataFrame:
        return labelled(labelled(df, "a", "la"), "b", "lb").where("la <> lb").drop("la", "lb")

    links = label = None

    def settle(open_: DataFrame) -> DataFrame:
        """Compare each set with the partner that most of its tokens name, a few times; returns the pairs
        that are then untried and still in different classes."""
        nonlocal links, label
        for _ in range(ROUNDS):
            likely = open_.groupBy("b").agg(F.max_by("a", F.struct("weight", -F.col("a"))).alias("a")).select("a", "b")
            likely = staged(likely, "likely")
            new = verified(likely, texts, shingle)
            links = new if links is None else links.unionByName(new)
            label = staged(components(links), "labels")
            open_ = staged(apart(open_.join(likely, ["a", "b"], "left_anti")), "open")
            if open_.isEmpty():
                break
        return open_

    open_ = settle(staged(passing.unionByName(stars).groupBy("a", "b").agg(F.sum("weight").alias("weight")), "open"))
    left_over = open_.join(passing, ["a", "b"], "left_semi").select("a", "b", "weight")
    # Full tokens of one order are enough: whoever is similar shares one, or a pair above.
    members = labelled(found.where("kind = 2 and orders = 1").select("token", F.col("a").alias("sid"), F.col("b").alias("n"), F.col("c").alias("own")), "sid", "label")
    several = members.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("token")
    members = staged(members.join(several, "token"), "members")
    # Of tokens with the same members one is enough.
    alike = members.groupBy("token").agg(F.count("*").alias("c"), F.sum(F.xxhash64("sid").cast("decimal(20,0)")).alias("h"))
    members = staged(members.join(alike.groupBy("c", "h").agg(F.min("token").alias("token")).select("token"), "token"), "members")
    size_of = members.groupBy("token", "label").agg(F.count("*").alias("c"))
    main = size_of.withColumn("r", F.row_number().over(Window.partitionBy("token").orderBy(F.desc("c"), "label"))).where("r = 1")
    placed = members.join(main.select("token", F.col("label").alias("main")), "token").withColumn("outside", F.col("label") != F.col("main"))
    # A set with so many tokens of its own that it has no partner at all is left out before it meets others.
    able = placed.where(100 * (F.col("n") - F.col("own")) >= PERCENT * F.col("n"))
    marks = texts.select("sid", "packed").mapInArrow(_marked(shingle), "sid long, marks binary").dropDuplicates(["sid"])
    having = staged(able.groupBy("sid").agg(F.collect_set("token").alias("tokens")).join(marks, "sid"), "marks")
    # Each one outside its token's main class meets all members, chunk by chunk.
    chunks = able.groupBy("token").agg(F.ceil(F.count_if("outside") / TILE).cast("int").alias("lefts"), F.ceil(F.count("*") / TILE).cast("int").alias("rights"))
    tiled = able.join(chunks.where("lefts > 0"), "token")
    chunk = lambda count: F.pmod(F.xxhash64("sid"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    left = tiled.where("outside").select("token", "sid", "label", "n", "own", "outside", F.lit(True).alias("is_left"), chunk("lefts").alias("l"), every("rights").alias("r"))
    right = tiled.select("token", "sid", "label", "n", "own", "outside", F.lit(False).alias("is_left"), chunk("rights").alias("r"), every("lefts").alias("l"))
    across = left.unionByName(right).join(having, "sid").groupBy("token", "l", "r").applyInArrow(_across, "a long, b long, weight long")
    rest = staged(left_over.unionByName(across).groupBy("a", "b").agg(F.max("weight").alias("weight")), "rest")
    if not rest.isEmpty():
        rest = settle(rest)
        links = links.unionByName(verified(rest, texts, shingle))
        label = components(links)

    classed = reps.join(label, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    named = classed.groupBy("label").agg(F.min("rep").alias("component_id"))
    class_of = classed.join(named, "label").select("sid", "component_id")
    found = sets.join(class_of, "sid", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return found.withColumns({c: F.when(F.col(c) < UNNAMED, F.col(c)) for c in ("doc_id", "component_id")})


def _compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1)
    for batch in _fresh(cut(batches)):
        texts = Texts(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze.compress(texts.raw(i)) for i in range(len(texts))], pa.binary())], ["doc_id", "packed"])


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """One document of every class, that with the smallest id; rows without an id stay.

    Rows that share the kept id all stay.
    """
    classes = near_duplicates(docs, **options).where("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    kept = docs.join(classes, docs["doc_id"] == classes["__kept"], "left_semi")
    return kept.unionByName(docs.where(F.col("doc_id").isNull()))
