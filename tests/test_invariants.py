"""Properties and brute-force twins of what SQL does not say, and file round trips."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.tokens import _bucket_embedder
from nearfold import session
from nearfold.functions.text import BASE_SPECIALS, CODE_SPECIALS, normalize_text
from nearfold.functions.vectors import l2_normalize
from nearfold.operators import clusters as cl
from nearfold.operators import nearest as nn
from nearfold.operators import pair_index
from nearfold.operators import pooling
from nearfold.operators import tokens as tk
from nearfold.operators.joins import HotKeys, hot_keys, spread_join
from nearfold.operators.ranks import group_percentile
from nearfold.operators.scaling import Scaler, fit_scaler
from nearfold.operators.sequences import extract_sequences
from nearfold.plans.clustering import cluster_vectors
from nearfold.plans.embedding import embed_documents
from nearfold.plans.retrieval import evaluate, nearest_clusters
from nearfold.plans.vocabulary import learn_vocabulary
from nearfold.sources import readers, writers
from nearfold.streaming.assign import assign_stream

RNG = np.random.default_rng(3)
POINTS = RNG.normal(size=(300, 5))
CENTRES = RNG.normal(size=(90, 5))
CENTRES[7] = CENTRES[3]  # a tie: the lower id must win
POINTS[0] = CENTRES[3]


def vectors(spark, points, key="id"):
    kind = "string" if key == "id" else "int"
    rows = [(str(i) if key == "id" else i, p.tolist()) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, f"{key} {kind}, embedding array<double>")


def brute(points, centres, k):
    d = np.sqrt(((points[:, None, :] - centres[None]) ** 2).sum(-1))
    return {str(i): sorted(zip(row.round(9), range(len(row))))[:k] for i, row in enumerate(d)}


def found(df):
    return {r["id"]: [(round(n["distance"], 9), n["cluster_id"]) for n in r["neighbours"]] for r in df.collect()}


@pytest.mark.parametrize("n_centres, k", [(1, 1), (20, 5), (90, 5), (90, 90)])
def test_nearest_is_exact(spark, n_centres, k):
    near = nn.nearest_centres(vectors(spark, POINTS), vectors(spark, CENTRES[:n_centres], "cluster_id"), k)
    assert found(near) == brute(POINTS, CENTRES[:n_centres], k)


@pytest.mark.parametrize("block_bytes", [400, 4_000])
def test_many_blocks_equal_one(spark, monkeypatch, block_bytes):
    scaler = fit_scaler(vectors(spark, POINTS))
    schema = "id string, embedding array<double>, extra int"
    awkward = [("x", POINTS[0].tolist(), 1), ("x", POINTS[7].tolist(), 2), (None, POINTS[8].tolist(), 3), (None, POINTS[8].tolist(), 4)]
    samples = vectors(spark, POINTS).withColumn("extra", F.lit(1)).select("id", "embedding", "extra")
    samples = samples.unionByName(spark.createDataFrame(awkward, schema))
    centres = vectors(spark, CENTRES, "cluster_id")
    runs = {
        "nearest": lambda: nn.nearest_centres(samples, centres, 4, scaler),
        "vectors": lambda: nn.nearest_centres(samples, centres, 1, keep_vector=True),
        "inertia": lambda: cl.inertia_by_k(samples, centres, scaler),
        "distances": lambda: nn.all_distances(samples, centres, scaler=scaler),
        "lloyd": lambda: cl.lloyd(samples, centres, 1, scaler),
    }

    def plain(v):
        if isinstance(v, float):
            return round(v, 6)
        if isinstance(v, list):
            return [plain(x) for x in v]
        return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v

    def rows(df):
        return sorted(repr(plain(r.asDict(recursive=True))) for r in df.collect())

    one = {name: rows(run()) for name, run in runs.items()}
    monkeypatch.setattr(nn, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(nn, "BLOCKS_PER_STAGE", 3)
    monkeypatch.setattr(nn, "TILE_BYTES", 3_000)
    assert {name: rows(run()) for name, run in runs.items()} == one
    assert len(one["nearest"]) == len(POINTS) + 4


def test_arrays_of_the_kernel_stay_within_a_tile(monkeypatch):
    monkeypatch.setattr(nn, "TILE_BYTES", 8_000)
    largest = []
    partition = np.partition
    monkeypatch.setattr(np, "partition", lambda a, *args, **kwargs: largest.append(a.nbytes) or partition(a, *args, **kwargs))
    order, dist = nn._best(POINTS, CENTRES, 5)
    assert max(largest) <= 8_000 and len(largest) > 1
    assert {str(i): [(round(d, 9), int(c)) for d, c in zip(dist[i], order[i])] for i in range(len(POINTS))} == brute(POINTS, CENTRES, 5)


def test_wrong_dimension_fails(spark):
    with pytest.raises(Exception, match="dimensions"):
        nn.nearest_centres(vectors(spark, POINTS[:, :4]), vectors(spark, CENTRES, "cluster_id")).collect()


def test_kmeans_invariants(spark):
    v = vectors(spark, POINTS)
    centres, cost = cl.fit_kmeans(v, 6, n_init=3)
    c = np.array([r["embedding"] for r in centres.orderBy("cluster_id").collect()])
    d2 = ((POINTS[:, None, :] - c[None]) ** 2).sum(-1)
    assert d2.min(1).sum() == pytest.approx(cost, rel=1e-6)
    assigned = cl.assignments(nn.nearest_centres(v, centres, 1))
    rows = {int(r["id"]): r["cluster"] for r in assigned.collect()}
    assert rows == dict(enumerate(d2.argmin(1)))
    firsts = [min(i for i, k in rows.items() if k == cluster) for cluster in sorted(set(rows.values()))]
    assert firsts == sorted(firsts)
    with pytest.raises(ValueError):
        cl.fit_kmeans(v, 301)


def test_lloyd_cost_never_rises(spark):
    v = vectors(spark, POINTS)
    start = vectors(spark, POINTS[:6], "cluster_id")
    costs = []
    for rounds in range(4):
        c = np.array([r["embedding"] for r in cl.lloyd(v, start, rounds).orderBy("cluster_id").collect()])
        costs.append(((POINTS[:, None, :] - c[None]) ** 2).sum(-1).min(1).sum())
    assert costs == sorted(costs, reverse=True) and costs[-1] < costs[0]


def test_lloyd_in_the_grid(spark, monkeypatch):
    v = vectors(spark, POINTS)
    start = vectors(spark, np.vstack([POINTS[:5], np.full((1, 5), 1e3)]), "cluster_id")
    scaler = fit_scaler(v)
    key = lambda df: {r["cluster_id"]: np.round(r["embedding"], 9).tolist() for r in df.collect()}
    plain = key(cl.lloyd(v, start, 2, scaler))
    assert plain[5] == [round((1e3 - m) / d, 9) for m, d in zip(scaler.mean, scaler.deviation)]
    monkeypatch.setattr(session, "BROADCAST_BYTES", 100)
    assert key(cl.lloyd(v, start, 2, scaler)) == plain


def test_cluster_job(spark):
    done = cluster_vectors(vectors(spark, POINTS), k_values=(2, 4, 6, 1000), n_init=1)
    assert done.k in (2, 4, 6)
    assert done.summary.agg(F.sum("cluster_size")).head()[0] == 300
    with pytest.raises(ValueError, match="at least three"):
        cluster_vectors(vectors(spark, POINTS), k_values=(2, 1000))
    fixed = cluster_vectors(vectors(spark, POINTS), k=3, n_init=1, low_id=10, high_id=99, scaling="none")
    assert fixed.curve is None and fixed.assignments.count() == 90


def test_member_segments_are_bounded_and_whole(spark):
    assigned = spark.range(5000).select(
        F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("cluster")
    )
    rows = cl.member_segments(assigned, 200).collect()
    assert sorted(int(i) for r in rows for i in r["member_ids"]) == list(range(5000))
    assert max(len(r["member_ids"]) for r in rows) < 400


@pytest.mark.parametrize("q", [0.0, 0.1, 0.5, 0.97, 1.0])
def test_percentile_is_exact(spark, q):
    groups = {
        "hot": np.round(RNG.normal(size=4000), 2),
        "flat": np.full(50, 3.5),
        "one": np.array([2.0]),
        "spiky": np.concatenate([np.zeros(900), RNG.exponential(size=100) * 1e6]),
    }
    rows = [(g, float(v)) for g, values in groups.items() for v in values] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["p"] for r in group_percentile(df, "g", "v", q, "p").collect()}
    assert got == pytest.approx({g: float(np.quantile(v, q)) for g, v in groups.items()})


@pytest.mark.parametrize("q", [0.0001, 0.1, 0.9999])
def test_percentile_of_a_large_group_is_exact(spark, q):
    n = 400_000
    i = F.col("id")
    # Long tail, a spike of equal values and one far outlier.
    value = F.when(i == 7, -1e12).when(i % 4 == 0, 2.5).otherwise(F.pow((i * 7919 % n) / n, 9.0) * 1e6)
    df = spark.range(n).select(F.when(i % 50 == 0, "small").otherwise("hot").alias("g"), value.alias("v"))
    table = df.toPandas()
    got = {r["g"]: r["p"] for r in group_percentile(df, "g", "v", q, "p").collect()}
    assert got == pytest.approx({g: float(np.quantile(v, q)) for g, v in table.groupby("g")["v"]})


# --- vocabulary and encoding -------------------------------------------------------

TEXTS = [
    "the quick brown fox jumps over the lazy dog, the end",
    "she sells sea shells on the sea shore; shells she sells",
    "aaa aaaa aaaaa banana bandana cabana",
    "Éléphant élève naïve café cafes the then there these",
]


def merged_one_by_one(counts, size, least, specials):
    """Plain rendering of the rule: best pair, ties to the first in order, until done."""
    words = {w: [c if i == 0 else "##" + c for i, c in enumerate(w)] for w in counts}
    letters = sorted({c for w in counts for c in w})
    tokens = list(dict.fromkeys([*specials, *letters, *sorted({p for ps in words.values() for p in ps if p.startswith("##") and len(p) > 2})]))
    while len(tokens) < size:
        pairs = Counter()
        for w, ps in words.items():
            for pair in zip(ps, ps[1:]):
                pairs[pair] += counts[w]
        if not pairs:
            break
        (a, b), n = min(pairs.items(), key=lambda x: (-x[1], x[0]))
        if n < least:
            break
        for w, ps in words.items():
            out, i = [], 0
            while i < len(ps):
                if ps[i : i + 2] == [a, b]:
                    out.append(a + b[2:])
                    i += 2
                else:
                    out.append(ps[i])
                    i += 1
            words[w] = out
        if a + b[2:] not in tokens:
            tokens.append(a + b[2:])
    return tokens


def random_words():
    r = random.Random(5)
    parts = ["an", "ba", "on", "the", "re", "a", "xy", "aa"]
    return Counter("".join(r.choices(parts, k=r.randint(1, 4))) for _ in range(600))


@pytest.mark.parametrize("tracked", [pair_index.TRACKED, 9])
@pytest.mark.parametrize("counts", [Counter(w for t in TEXTS for w in t.lower().split()), random_words()])
def test_vocabulary_equals_one_merge_at_a_time(spark, monkeypatch, counts, tracked):
    """Also when few pairs are tracked, so that epochs end and counts of new pairs are cut."""
    monkeypatch.setattr(pair_index, "TRACKED", tracked)
    df = spark.createDataFrame(list(counts.items()), "word string, n bigint")
    got = [r["token"] for r in tk.train_vocabulary(df, 110, 2).orderBy("id").collect()]
    assert got == merged_one_by_one(counts, 110, 2, BASE_SPECIALS)


def test_rounds_read_only_words_that_hold_a_merged_pair(spark):
    counts = random_words()
    table = session.staged(spark.createDataFrame([(" " + " ".join([w[0], *("##" + c for c in w[1:])]) + " ", n) for w, n in counts.items()], "pieces string, n long"), "words")
    epoch = pair_index.Epoch(table, 2, "##")
    ranking, beyond = epoch.ranking()
    assert beyond is None
    picks = pair_index.independent(ranking, 1, 2)
    held = [r["pieces"] for r in epoch.held.filter(F.col("pair") == " ".join(picks[0][:2])).collect()]
    assert 0 < len(held) < len(counts) and all(f" {picks[0][0]} {picks[0][1]} " in p for p in held)
    epoch.merge(picks)
    again = pair_index.Epoch(epoch.rewritten(), 2, "##")
    known = {p: n for p, n in epoch.counts.items() if n >= 2}
    assert {p: n for p, n in again.counts.items()} == known


def vocabulary(spark, specials=BASE_SPECIALS):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    counts = tk.word_frequency(docs, specials, lowercase=True, accents=True)
    return docs, tk.train_vocabulary(counts, 90, 2, specials)


def test_encoding_equals_the_tokenizer_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    docs, vocab = vocabulary(spark)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    more = TEXTS + ["the zebra's shell-fish (cafés) 中文 x" + "y" * 120, "", "[MASK] the [SEP]"]
    docs = spark.createDataFrame(list(enumerate(more)), "doc_id int, text string")
    got = {r["doc_id"]: r["input_ids"] for r in tk.encode(docs, vocab).collect()}
    library = tokenizers.BertWordPieceTokenizer(vocab=ids, lowercase=True, strip_accents=True)
    library.add_special_tokens(list(BASE_SPECIALS))
    assert got == {i: library.encode(t, add_special_tokens=False).ids for i, t in enumerate(more)}


def test_chunks_equal_the_tokenizer_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    docs, vocab = vocabulary(spark)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    library = tokenizers.BertWordPieceTokenizer(vocab=ids, lowercase=True, strip_accents=True)
    library.enable_truncation(max_length=8, stride=2)
    chunks = tk.chunk_tokens(tk.encode(docs, vocab), 8, 2, ids["[CLS]"], ids["[SEP]"], [0, 1, 2, 3, 4])
    got = {(r["doc_id"], r["chunk_no"]): (r["input_ids"], r["special_tokens_mask"]) for r in chunks.collect()}
    want = {}
    for i, text in enumerate(TEXTS):
        first = library.encode(text)
        for j, e in enumerate([first, *first.overflowing]):
            want[(i, j)] = (e.ids, e.special_tokens_mask)
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}


def test_masking(spark):
    df = spark.createDataFrame([("d", 0, list(range(2, 4002)), [1] + [0] * 3998 + [1])],
                               "doc_id string, chunk_no int, input_ids array<int>, special_tokens_mask array<int>")
    row = tk.mlm_examples(df, 0.15, 1, 4, 5000).head()
    chosen = [i for i, label in enumerate(row["labels"]) if label != -100]
    assert 0 not in chosen and 3999 not in chosen
    assert 0.12 < len(chosen) / 4000 < 0.18
    assert all(row["labels"][i] == row["input_ids"][i] for i in chosen)
    assert all(row["masked_ids"][i] == row["input_ids"][i] for i in set(range(4000)) - set(chosen))
    assert 0.7 < sum(row["masked_ids"][i] == 4 for i in chosen) / len(chosen) < 0.9


def test_pooling_strategies(spark):
    rows = [("d", 0, layer, pos, [float(layer), float(pos)], 1 if pos < 2 else 0) for layer in range(3) for pos in range(3)]
    hidden = spark.createDataFrame(rows, "doc_id string, chunk_no int, layer int, pos int, vec array<double>, mask int")
    first = {}
    for strategy, n in [("last", 1), ("last_n", 2), ("last_n_weighted", 2), ("all_mean", 1), ("last_n", 9)]:
        mixed = pooling.mix_layers(hidden, strategy, n)
        first[strategy, n] = round(mixed.filter("pos = 0").head()["vec"][0], 9)
    assert first == {("last", 1): 2.0, ("last_n", 2): 1.5, ("last_n_weighted", 2): round(5 / 3, 9), ("all_mean", 1): 1.0, ("last_n", 9): 1.0}
    mixed = pooling.mix_layers(hidden, "last")
    assert pooling.pool_tokens(mixed).head()["vec"] == [2.0, 0.5]
    assert pooling.pool_tokens(mixed, "cls").head()["vec"] == [2.0, 0.0]
    nothing = pooling.pool_tokens(mixed.withColumn("mask", F.lit(0))).head()
    assert nothing["vec"] == [0.0, 0.0] and nothing["n_tokens"] == 1
    chunks = spark.createDataFrame([("d", 0, [3.0, 0.0], 1), ("d", 1, [0.0, 4.0], 3)], "doc_id string, chunk_no int, vec array<double>, n_tokens int")
    assert pooling.combine_chunks(chunks, "uniform").head()["embedding"] == [1.5, 2.0]
    assert pooling.combine_chunks(chunks, "token_count").head()["embedding"] == [0.75, 3.0]
    unit = pooling.combine_chunks(chunks, "uniform", "l2").head()["embedding"]
    assert unit == pytest.approx([0.6, 0.8])
    with pytest.raises(ValueError):
        pooling.mix_layers(hidden, "middle")


def test_perplexity(spark):
    df = spark.createDataFrame([(1.0, 1), (3.0, 3), (float("nan"), 0)], "loss double, masked_tokens int")
    row = pooling.weighted_perplexity(df).head()
    assert row["loss"] == 2.5 and row["perplexity"] == pytest.approx(np.exp(2.5))
    with pytest.raises(Exception, match="no masked tokens"):
        pooling.weighted_perplexity(df.filter("masked_tokens = 0")).collect()


def test_embedding_job(spark):
    docs, vocab = vocabulary(spark, (*BASE_SPECIALS, *CODE_SPECIALS))
    rows = embed_documents(docs, vocab, max_length=8, stride=2).collect()
    assert sorted(r["doc_id"] for r in rows) == [0, 1, 2, 3]
    assert all(np.linalg.norm(r["embedding"]) == pytest.approx(1.0) for r in rows)


# --- files ------------------------------------------------------------------------


def test_corpus_files(spark, tmp_path):
    for i in (2, 10, 1):
        folder = tmp_path / f"Source_{i}"
        folder.mkdir()
        (folder / "llvm_O0.ll").write_text(f"@f{i} = 1\n\nend", encoding="utf-8")
        if i == 2:
            (folder / "input.bc").write_bytes(b"\0\1")
        if i != 10:
            (folder / "llvm_OZ.ll").write_text("x")
    docs = readers.read_corpus(spark, str(tmp_path), "llvm_O0.ll", r"Source_(\d+)")
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == {str(i): f"@f{i} = 1\n\nend" for i in (1, 2, 10)}
    kept = readers.read_corpus(spark, str(tmp_path), "llvm_O0.ll", max_files=2, preprocess=True)
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {f"Source_{i}": "[GLOB] = [NUM]\n\nend" for i in (1, 2)}
    with pytest.raises(ValueError, match="no files matched"):
        readers.read_corpus(spark, str(tmp_path), "*.none")
    found = {r["program_id"]: r for r in readers.artifact_inventory(readers.list_artifacts(spark, str(tmp_path))).collect()}
    assert found["Source_2"]["start_path"].endswith("Source_2/input.bc")
    assert found["Source_1"]["start_path"].endswith("Source_1/llvm_O0.ll")
    assert [found[f"Source_{i}"]["has_oz"] for i in (1, 2, 10)] == [True, True, False]
    assert not found["Source_1"]["has_source"]


@pytest.fixture
def uneven(spark):
    """A key with 2,500 of 3,000 rows, one without a value with 300, and small ones."""
    hot = F.when(F.col("id") < 2500, 0).when(F.col("id") < 2700, F.col("id") % 7 + 1)
    return spark.range(3000).select("id", hot.cast("long").alias("key")), spark.createDataFrame([(0, "a"), (3, "b"), (9, "c"), (None, "d")], "key long, v string")


def test_hot_keys_and_their_parts(spark, uneven):
    large, _ = uneven
    parts = dict(hot_keys(large, "key").parts)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert set(parts) <= {0, None} and parts[0] >= 2500 * n // 3000
    assert hot_keys(large.filter("id < 0"), "key").parts == ()
    assert hot_keys(spark.range(1000), "id").parts == ()


def test_spread_join_equals_join(spark, uneven):
    large, lookup = uneven
    key = lambda df: sorted(map(str, df.select("id", "key", "v").collect()))
    want = key(large.join(lookup, "key", "left"))
    assert key(spread_join(large, lookup, "key", "id")) == want
    none = HotKeys(T.LongType(), ())
    assert key(spread_join(large, lookup, "key", "id", none)) == want
    wrong = HotKeys(T.LongType(), ((4, 3), (None, 2), (77, 5)))
    assert key(spread_join(large, lookup, "key", "id", wrong)) == want
    twice = lookup.unionByName(spark.createDataFrame([(0, "z")], "key long, v string"))
    assert key(spread_join(large, twice, "key", "id")) == key(large.join(twice, "key", "left"))


def test_a_hot_key_is_spread_over_tasks(spark, uneven):
    large, lookup = uneven
    quiet = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in quiet}
    try:
        for k, v in quiet.items():
            spark.conf.set(k, v)
        most = lambda df: max(r[1] for r in df.groupBy(F.spark_partition_id()).count().collect())
        assert most(large.join(lookup, "key", "left")) >= 2500
        assert most(spread_join(large, lookup, "key", "id")) < 1500
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_staged_tables_lie_in_the_shared_folder(spark):
    table = session.staged(spark.range(3), "x")
    assert f"{session.shared_dir(spark)}/nearfold-" in table.inputFiles()[0]
    assert table.count() == 3
    empty = session.staged(spark.range(0), "x")
    assert empty.count() == 0 and empty.columns == ["id"]


def test_actions(spark):
    from nearfold.operators import sequences as sq

    rows = [("x", ["-GVN", "nope", "licm", "gvn"]), ("x", ["-GVN", "nope", "licm", "gvn"]), ("x", ["gvn"]), ("y", []), ("z", None), (None, ["nope"])]
    seqs = spark.createDataFrame(rows, "id string, passes array<string>")
    actions = spark.createDataFrame([("-licm", 1), ("gvn", 2), ("--GVN", 1)], "name string, action int")
    want = [("x", [2, 1, 2], ["nope"]), ("x", [2, 1, 2], ["nope"]), ("x", [2], []), ("y", [], []), ("z", [], []), (None, [], ["nope"])]
    assert sorted(map(tuple, sq.resolve_actions(seqs, actions).collect()), key=str) == sorted(want, key=str)


def test_a_name_mapped_twice_stays_one_row(spark):
    from nearfold.operators import sequences as sq

    df = spark.createDataFrame([("p/a.ll",), ("b.ll",)], "n string")
    pairs = spark.createDataFrame([("a", "x"), ("a", "y")], "name string, mapped string")
    assert sorted(r["n"] for r in sq.mapped_names(df, "n", pairs).collect()) == ["b", "y"]


def test_no_line_is_left_out(spark):
    from catalog import commands, corpus
    from nearfold.functions.commands import token_passes

    sf_dir = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_returnflag").agg(F.max("l_quantity").alias("q"), F.count("*").alias("n"))
    want = lines.filter("q >= 5").agg(F.sum("n")).head()[0]
    assert commands.commands(spark, sf_dir).agg(F.sum(F.size(token_passes(F.col("commandline"))))).head()[0] == want
    total = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    # The frame of a program has eight lines; a definition inside counts four more than its line.
    assert corpus.programs(spark, sf_dir).agg(F.sum(F.size(F.split("text", "\n")))).head()[0] >= total


def test_sequence_files(spark, tmp_path):
    commands = spark.createDataFrame(
        [("b/x/p1", "opt -a -b input.bc -o output.bc", 1), ("b/x/p1/", "opt -c", 2), ("p2", "", 1), ("p2", None, 2), ("p3", "opt", 1)],
        "benchmark string, commandline string, n int",
    )
    found = extract_sequences(commands, ["n"])
    assert {r["benchmark"]: r["passes"] for r in found.collect()} == {"p1": ["-c"], "p3": []}
    writers.write_sequences(found, str(tmp_path / "seq"))
    assert sorted(p.name for p in (tmp_path / "seq").iterdir()) == ["p1_seq.txt", "p3_seq.txt"]
    back = readers.scan_sequences(spark, str(tmp_path / "seq")).collect()
    assert {r["code_id"]: r["passes"] for r in back} == {"p1": ["-c"], "p3": []}
    (tmp_path / "store").mkdir()
    (tmp_path / "store" / "7_seq.txt").write_text(" -a\n-b  -c\n")
    assert [tuple(r) for r in readers.scan_sequences(spark, str(tmp_path / "store")).collect()] == [("7", ["-a", "-b", "-c"])]
    (tmp_path / "map.json").write_text('{"a": "b",\n "c": "d"}')
    assert {tuple(r) for r in readers.read_name_map(spark, str(tmp_path / "map.json")).collect()} == {("a", "b"), ("c", "d")}
    (tmp_path / "bad.json").write_text("[1")
    with pytest.raises(Exception, match="JSON object"):
        readers.read_name_map(spark, str(tmp_path / "bad.json")).collect()


def test_table_files(spark, tmp_path):
    v = spark.createDataFrame([("1.0", [1.5, -2.0]), ("x", [0.1, 3e-8])], "id string, embedding array<double>")
    for fmt in ("csv", "parquet"):
        writers.write_vectors(v, str(tmp_path / fmt), fmt)
        assert {r["id"]: r["embedding"] for r in readers.read_vectors(spark, str(tmp_path / fmt), fmt=fmt).collect()} == {
            "1": [1.5, -2.0], "x": [0.1, 3e-8],
        }
    with pytest.raises(ValueError, match="missing columns"):
        readers.read_vectors(spark, str(tmp_path / "csv"), id_col="key")
    assigned = spark.createDataFrame([(str(i), i % 2, float(i)) for i in range(9)], "id string, cluster int, distance_to_centroid double")
    path = writers.write_assignments(assigned, str(tmp_path), 2)
    assert path.endswith("k2") and spark.read.csv(path, header=True).count() == 9
    writers.write_cluster_analysis(cl.cluster_summary(assigned, 3), str(tmp_path / "analysis"), 3)
    rows = readers.read_clusters(spark, str(tmp_path / "analysis")).orderBy("cluster_id").collect()
    assert [tuple(r) for r in rows] == [(0, 5, "0", "0, 2, 4"), (1, 4, "1", "1, 3, 5")]
    writers.write_members(cl.member_segments(assigned), str(tmp_path / "members"))
    assert spark.read.csv(str(tmp_path / "members"), header=True).count() == 2
    (tmp_path / "p10.csv").write_text("cluster,delta_p10\n1,2.5\n2,\n")
    assert [tuple(r) for r in readers.read_thresholds(spark, str(tmp_path / "p10.csv")).collect()] == [(1, 2.5)]
    (tmp_path / "cmd.csv").write_text('benchmark,commandline\na,"opt ""x"", y"\nb,\n')
    assert [tuple(r) for r in readers.read_commands(spark, str(tmp_path / "cmd.csv")).collect()] == [("a", 'opt "x", y')]
    vocab = tk.vocabulary_table(spark, ["[PAD]", "b", "##a"])
    writers.write_vocabulary(vocab, str(tmp_path / "vocab"))
    (part,) = [p for p in os.listdir(tmp_path / "vocab") if p.startswith("part")]
    assert (tmp_path / "vocab" / part).read_text() == "[PAD]\nb\n##a\n"
    writers.write_config(spark.createDataFrame([(3, True)], "vocab_size int, lowercase boolean"), str(tmp_path / "config"))
    assert spark.read.json(str(tmp_path / "config")).count() == 1


def test_vocabulary_job_and_files(spark, tmp_path):
    docs = spark.createDataFrame([("%a = add i32 7", ), ("store %b, @g",)], "text string")
    vocab, config = learn_vocabulary(docs, 60)
    tokens = [r["token"] for r in vocab.orderBy("id").collect()]
    assert tokens[:13] == [*BASE_SPECIALS, *CODE_SPECIALS]
    writers.write_config(config, str(tmp_path / "config"))
    row = spark.read.json(str(tmp_path / "config")).head()
    assert row["files_used"] == 2 and row["vocab_size_actual"] == len(tokens)
    assert row["special_tokens"] == list(CODE_SPECIALS)


def test_model_files(spark, tmp_path):
    v = vectors(spark, POINTS)
    done = cluster_vectors(v, k=4, n_init=1)
    writers.write_model(done.centres, done.scaler, str(tmp_path / "model"))
    centres, scaler = writers.read_model(spark, str(tmp_path / "model"))
    assert scaler == done.scaler
    z = v.withColumn("embedding", scaler.apply(F.col("embedding")))
    again = cl.assignments(nn.nearest_centres(z, centres, 1))
    key = lambda df: sorted((r["id"], r["cluster"]) for r in df.collect())
    assert key(again) == key(done.assignments)
    writers.write_model(done.centres, None, str(tmp_path / "plain"))
    assert writers.read_model(spark, str(tmp_path / "plain"))[1].mean == (0.0,) * 5


def test_retrieval_job_with_given_thresholds(spark):
    v = vectors(spark, POINTS)
    clusters = spark.createDataFrame([(1, "3", "3,4"), (2, "8.0", "")], "cluster_id int, closest_code_id string, top_closest_ids string")
    near = nearest_clusters(v, v, clusters)
    ids = v.select("id")
    rows = [(code, 50 + int(code)) for code in ("3", "4", "8")]
    codes = spark.createDataFrame(rows, "code_id string, count bigint")

    def scorer(candidates):
        return candidates.join(codes, "code_id", "left").withColumn("compile_ms", F.lit(1.0))

    base = ids.withColumns({n: F.lit(100).cast("bigint") for n in ("oz_count", "clang_oz_count", "gym_oz_count")})
    gates = spark.createDataFrame([(2, 45.0), (2, 40.0), (1, None)], "cluster int, delta_p10 double")
    done = evaluate(near, clusters, scorer, base, gates)
    got = {r["category"] for r in done.final.filter("cluster = 2").collect()}
    # Cluster 2 offers 58, below its gate; its neighbour's 53 is fine and ungated.
    assert got == {"ncs_ok"}
    assert {r["final_count"] for r in done.final.collect()} == {53}
    assert done.report.filter("metric = 'preset_fallback_count'").head()["value"] == 0.0
    assert done.final.count() == 300


def test_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    samples = vectors(spark, POINTS)
    samples.write.parquet(source)
    (centres,) = nn.centre_blocks(vectors(spark, CENTRES, "cluster_id"))
    stream = spark.readStream.schema(samples.schema).parquet(source)
    query = assign_stream(stream, centres, out, str(tmp_path / "check"), 3)
    query.awaitTermination(120)
    assert found(spark.read.parquet(out)) == brute(POINTS, CENTRES, 3)


def test_normalisation_on_real_words_keeps_layout(spark):
    df = spark.createDataFrame([("a %x.y\n\tb: 12\n",)], "t string")
    assert df.select(normalize_text(F.col("t"))).head()[0] == "a [REG]\n\t[LBL]: [NUM]\n"


def test_scaler_identity():
    assert Scaler((0.0,), (1.0,)).dim == 1


def test_every_token_has_a_digest_of_its_own(spark):
    ids = list(range(100, 400))
    df = spark.createDataFrame(
        [("a", 0, ids, [0] * 300), ("b", 3, [7, 8], [1, 0]), ("c", 0, None, None), (None, 1, [], [])],
        "doc_id string, chunk_no int, input_ids array<int>, special_tokens_mask array<int>",
    )
    rows = {r["doc_id"]: r for r in tk.mlm_examples(df, 0.15, 42, 4, 5000).collect()}
    shown, labels = [], []
    for i, token in enumerate(ids):
        m = hashlib.md5(f"42:a:0:{i}".encode()).hexdigest()
        chosen, kind, other = int(m[:7], 16) / 16**7 < 0.15, int(m[7:14], 16) / 16**7, int(m[14:21], 16) % 5000
        shown.append(token if not chosen else 4 if kind < 0.8 else other if kind < 0.9 else token)
        labels.append(token if chosen else -100)
    assert rows["a"]["masked_ids"] == shown and rows["a"]["labels"] == labels
    assert rows["c"]["masked_ids"] is None and rows["c"]["labels"] is None
    assert rows[None]["masked_ids"] == [] and rows["b"]["labels"][0] == -100


def test_norms_are_summed_once_per_vector(spark):
    """The sum of squares stays out of the function that divides every element."""
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)], "v array<double>")
    normed = df.select(l2_normalize(F.col("v")).alias("v"))
    assert [r["v"] for r in normed.collect()] == [[0.6, 0.8], [0.0, 0.0], [], None]
    plan = normed._jdf.queryExecution().optimizedPlan().toString()
    division = plan[: plan.index("/")].rindex("lambdafunction(")
    assert "aggregate(" not in plan[division : plan.index("/") + 80]


def test_encoding_matches_a_bounded_number_of_words_at_once(spark, monkeypatch):
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "words": [["a"] * 3, [], ["b"] * 9, ["c", "d"]]})
    assert [part.num_rows for part in tk._slices(batch, 4)] == [2, 1, 1]
    assert pa.Table.from_batches(list(tk._slices(batch.slice(1), 4))).to_pydict() == batch.slice(1).to_pydict()
    docs = spark.createDataFrame([(i, "ab " * i + "zz ba") for i in range(40)], "doc_id int, text string").coalesce(1)
    vocab = tk.vocabulary_table(spark, [*BASE_SPECIALS, "a", "b", "##a", "##b"])
    want = {r["doc_id"]: r["input_ids"] for r in tk.encode(docs, vocab).collect()}
    monkeypatch.setattr(tk, "WORDS_AT_ONCE", 7)
    monkeypatch.setattr(tk, "REMEMBERED", 1)
    assert {r["doc_id"]: r["input_ids"] for r in tk.encode(docs, vocab).collect()} == want
    assert want[2] == [5, 8, 5, 8, 1, 6, 7]


def test_bucket_embedder_counts_remainders(spark):
    chunks = spark.createDataFrame([("a", 0, [0, 64, 1, 130]), ("b", 1, []), ("c", 0, [63])], "doc_id string, chunk_no int, input_ids array<int>")
    embedded = _bucket_embedder(chunks)
    assert "ArrowEvalPython" in embedded._jdf.queryExecution().optimizedPlan().toString()  # one pass, not one per bucket
    rows = {r["doc_id"]: r for r in embedded.collect()}
    assert rows["a"]["vec"] == [2.0, 1.0, 1.0] + [0.0] * 61 and rows["a"]["n_tokens"] == 4
    assert rows["b"]["vec"] == [0.0] * 64 and rows["c"]["vec"] == [0.0] * 63 + [1.0]


def test_merges_are_replayed_on_whole_batches():
    """Arrays of piece numbers give what merging one word at a time gives."""
    rng = random.Random(5)
    words = [[rng.choice("ab"), *("##" + rng.choice("abc") for _ in range(rng.randrange(9)))] for _ in range(300)]
    merges = [("##a", "##a"), ("a", "##b"), ("##aa", "##aa"), ("##b", "##c"), ("a", "##aa"), ("##a", "##a"), ("##x", "##a")]
    made = [a + b[2:] for a, b in merges]
    want = []
    for pieces in words:
        for pair, piece in zip(merges, made):
            out, i = [], 0
            while i < len(pieces):
                hit = tuple(pieces[i : i + 2]) == pair
                out.append(piece if hit else pieces[i])
                i += 1 + hit
            pieces = out
        want.append(f" {' '.join(pieces)} ")
    coded = pair_index.Coded(pa.array([f" {' '.join(w)} " for w in words]), made)
    coded.replay(merges, made)
    assert coded.joined().to_pylist() == want


def test_pass_lists_are_made_once_however_often_they_are_read(spark):
    from nearfold.operators import sequences as sq

    made = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def listed(n):
        made.add(1)
        return ["-gvn", f"-p{n % 3}"]

    seqs = spark.range(200).select(F.col("id").cast("string").alias("id"), listed("id").alias("passes"))
    actions = spark.createDataFrame([("gvn", 2)], "name string, action int")
    found = sq.resolve_actions(seqs, actions).collect()
    assert {(r["id"], *r["actions"], *r["unknown"]) for r in found} == {(str(n), 2, f"-p{n % 3}") for n in range(200)}
    assert made.value == 200


def test_the_words_of_a_command_are_found_once(spark):
    from nearfold.functions.commands import token_passes

    rows = [("opt -a 'b c'd x/input.bc -o \"o p\" -e", ["-a", "b cd", "-e"]), ("-a 'b", None), ("", []), (None, None), ("/x/opt-10 -o -o -a \"\"", ["-a", ""])]
    df = spark.createDataFrame(rows, "c string, want array<string>").select("want", token_passes(F.col("c")).alias("passes"))
    assert all(r["passes"] == r["want"] for r in df.collect())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
