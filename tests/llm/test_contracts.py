"""Cases in which the contracts leave no choice and that ordinary rows do not show."""

from __future__ import annotations

import random
import zlib

from nearfold.llm import jaccard, pii, sharding
from nearfold.llm.queries import QUERIES
from tests.llm import brute
from tests.llm.test_operators import got, prose


def test_spans_of_one_start_go_by_kind(spark):
    texts = ["1.2.3.4@x.com", "4111111111111111@x.com", "a 4111 1111 1111 1111@x.org b", "+14155550123@x.io 10.0.0.1@h.com", "4111111111111111.1.2.3", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in pii.report(docs).collect()}
    for i, text in enumerate(texts):
        base = ",".join(f"{k}:{a}:{b}" for a, b, k in brute.pii_base(text))
        assert rows[i].base_sha256 == brute.sha(base) and rows[i].spans == base
    assert rows[0].spans == "email:0:13,ip:0:7" and rows[1].spans == "email:0:22,card:0:16"


def edited(words: list[str], places: range) -> str:
    return " ".join(f"new{i}" if i in places else w for i, w in enumerate(words))


def test_rows_without_id_link_the_others(spark):
    """A and B are too far apart, but both near a text without an id."""
    words = prose(random.Random(2), 200).split()
    rows = [(1, edited(words, range(10, 15))), (None, " ".join(words)), (2, edited(words, range(150, 160))), (7, prose(random.Random(3), 60))]
    rows += [(None, None), (None, rows[1][1]), (None, prose(random.Random(4), 80))]
    sets = [brute.shingles(t) for _, t in rows[:3]]
    near = lambda a, b: 100 * len(a & b) >= 75 * len(a | b)
    if near(sets[0], sets[2]):
        rows[2] = (2, edited(words, range(140, 162)))
        sets[2] = brute.shingles(rows[2][1])
    assert near(sets[0], sets[1]) and near(sets[1], sets[2]) and not near(sets[0], sets[2])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    size = {t: len(brute.shingles(t)) for _, t in rows}
    component = {rows[0][1]: 1, rows[1][1]: 1, rows[2][1]: 1, rows[3][1]: 7}
    assert got(jaccard.near_duplicates(docs)) == sorted(((d, size[t], component.get(t)) for d, t in rows), key=str)
    kept = [r.doc_id for r in jaccard.keep_first(docs).collect()]
    assert sorted(kept, key=str) == sorted([1, 7, None, None, None, None], key=str)


def test_shards_against_the_whole_order(spark):
    """Every border against all others, every slot against its rank, every checksum against the row's own text."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    key = sharding.key_columns()
    plain = {r["doc_id"]: r for r in docs.select("doc_id", "text", *(c.alias(n) for n, c in key.items())).collect()}
    order = sorted(plain, key=lambda d: (plain[d]["__h"], plain[d]["__i"]))
    places = [0]
    for d in order:
        places.append(places[-1] + len((plain[d]["text"] or "").encode()) + 1)
    found = {r.doc_id: r for r in QUERIES["op4_sharding"](spark, sf_dir).collect()}
    assert set(found) == set(plain)
    shards = [found[d].shard for d in order]
    assert shards == sorted(shards)
    for s in range(1, 8):
        ideal, border = places[-1] * s // 8, places[sum(x < s for x in shards)]
        nearest = min(abs(p - ideal) for p in places)
        assert abs(border - ideal) <= max(nearest, places[-1] / 8 * sharding.TOLERANCE)
    for d, r in found.items():
        before = [x for x in order[: order.index(d)] if found[x].shard == r.shard]
        assert (r.slot, r.size, r.text_crc32, r.law) == (len(before), len((plain[d]["text"] or "").encode()) + 1, zlib.crc32((plain[d]["text"] or "").encode()), "bytes")
