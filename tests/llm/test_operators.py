"""Each operator against a plain version, on rows that hold every awkward case."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfold.llm import chat, collocations, fm_index, jaccard, mixing, pii, quality, repeats, sampling, sharding, suffix_merge, topk
from nearfold.session import staged
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng: random.Random, n: int, vocabulary: int = 4000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows() -> list[tuple[int, str | None]]:
    rng = random.Random(5)
    passage, line = prose(rng, 70), prose(rng, 30)
    base = prose(rng, 300).split()
    out: list[tuple[int, str | None]] = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "one"), (5, "One two three"), (6, "a b c d e"), (7, "again " * 400), (8, "again " * 90 + "x")]
    for i in range(40):
        words = base.copy()
        for _ in range(rng.randrange(12)):
            words[rng.randrange(len(words))] = f"edit{rng.random()}"
        out.append((20 + i, " ".join(words)))
    out += [(70 + i, f"{prose(rng, 40)} {passage}\n{prose(rng, 40)}") for i in range(30)]
    out += [(110 + i, f"{line} {prose(rng, 60 + i)}") for i in range(20)]
    out += [(140 + i, out[20][1]) for i in range(12)]
    out += [(160, prose(rng, 9000)), (161, passage.upper()), (162, passage + "\x0b" + line)]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, "en", f"s{d % 3}", 0) for d, t in rows], DOCS).repartition(5)


def got(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("hot", [repeats.HOT, 3])
def test_word_dedup(monkeypatch, docs, rows, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    result = fm_index.remove_repeated_words(docs)
    assert got(result.drop("kept")) == brute.word_dedup(rows)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in result.collect())


@pytest.mark.parametrize("hot", [repeats.HOT, 3])
def test_byte_dedup(monkeypatch, docs, rows, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    assert got(suffix_merge.remove_repeated_bytes(docs, with_text=False)) == brute.byte_dedup(rows)


def test_dedup_with_repeated_and_null_ids(spark):
    rng = random.Random(8)
    text, other = prose(rng, 80), prose(rng, 80)
    rows = [(1, text), (1, text), (1, other), (2, text), (None, text), (None, None), (3, other + " " + text)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(fm_index.remove_repeated_words(df, with_text=False)) == brute.word_dedup(rows)
    assert got(suffix_merge.remove_repeated_bytes(df, with_text=False)) == brute.byte_dedup(rows)


def contexts_that_share_32_bits(unit: repeats.Unit, spelled: np.ndarray, joint: str) -> list[str]:
    """Two different texts of one window with the same key, whose hashes have equal upper halves."""
    rng = np.random.default_rng(11)
    texts = repeats.Texts(pa.array(spelled.tolist()))
    value = unit.values(texts)[0]
    # A gram with a very small hash is the key of every window around it.
    grams = rng.integers(0, len(value), (200_000, unit.gram))
    gram = grams[repeats.span_hashes(value[grams].ravel(), *(np.arange(len(grams)) * unit.gram + k for k in (0, unit.gram))).argmin()]
    some = rng.integers(0, len(value), (300_000, unit.window))
    at = (unit.window - unit.gram) // 2
    some[:, at : at + unit.gram] = gram
    begin = np.arange(len(some)) * unit.window
    half = repeats.span_hashes(value[some].ravel(), begin, begin + unit.window) >> np.uint64(32)
    order = half.argsort(kind="stable")
    for i in np.flatnonzero(half[order][1:] == half[order][:-1]):
        pair = [joint.join(spelled[some[order[k]]]) for k in (i, i + 1)]
        keys = [repeats.segments(*unit.values(repeats.Texts(pa.array([t]))), unit)[3].tolist() for t in pair]
        if keys[0] == keys[1] and len(keys[0]) == 1:
            return pair
    raise AssertionError("no pair")


def test_segments_that_agree_in_half_their_hash_stay(spark):
    words = contexts_that_share_32_bits(fm_index.WORDS, np.array([f"w{i}" for i in range(4000)]), " ")
    letters = contexts_that_share_32_bits(suffix_merge.BYTES, np.array(list("abcdefghijklmnopqrstuvwxyz")), "")
    for pair, run, plain in ((words, fm_index.remove_repeated_words, brute.word_dedup), (letters, suffix_merge.remove_repeated_bytes, brute.byte_dedup)):
        rows = list(enumerate(pair))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        for parts in (1, 2):
            found = run(df.repartition(parts, "doc_id"), with_text=False)
            assert got(found) == plain(rows) and {r.n_removed for r in found.collect()} == {0}


def test_matching_statistics_against_search():
    rng = np.random.default_rng(3)
    texts = [rng.integers(1, 5, n) for n in (30, 1, 17, 60)]
    symbols = np.concatenate([np.append(t, 0) for t in texts])
    doc = np.repeat([7, 3, 9, 4], [len(t) + 1 for t in texts])
    index = fm_index.FmIndex(symbols, doc, 6)
    queries = [rng.integers(1, 6, n) for n in (40, 0, 25)]
    queries = [np.where(q == 5, -1, q) for q in queries]
    at = np.concatenate(([0], np.cumsum([len(q) for q in queries])))
    length, first = index.matching_statistics(np.concatenate(queries), at)

    def holders(part):
        return [d for t, d in zip(texts, (7, 3, 9, 4), strict=True) if any(t[i : i + len(part)].tolist() == part for i in range(len(t)))]

    for q, begin in zip(queries, at, strict=False):
        for i in range(len(q)):
            want = max(n for n in range(7) if i + n <= len(q) and (n == 0 or holders(q[i : i + n].tolist())))
            assert length[begin + i] == want
            if want == 6:
                assert first[begin + i] == min(holders(q[i : i + 6].tolist()))


def test_loser_tree_merges_and_keeps_prefixes():
    rng = random.Random(2)
    words = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))) for _ in range(400)]
    runs = [sorted(words[i::7]) for i in range(7)] + [[]]
    common = [[0] + [suffix_merge.shared_prefix(a, b, 0) for a, b in zip(r, r[1:], strict=False)] for r in runs]
    merged = [(runs[r][p], same) for r, p, same in suffix_merge.LoserTree(runs, common)]
    assert [m for m, _ in merged] == sorted(words)
    for (a, _), (b, same) in zip(merged, merged[1:], strict=False):
        assert same == suffix_merge.shared_prefix(a, b, 0)


@pytest.mark.parametrize("few", [jaccard.FEW, 3])
def test_near_duplicates(monkeypatch, docs, rows, few):
    monkeypatch.setattr(jaccard, "FEW", few)
    assert got(jaccard.near_duplicates(docs)) == sorted(brute.classes(rows), key=str)


def edited_copies(n: int, edits: int, seed: int) -> list[tuple[int, str]]:
    """One text of 200 words in n copies, each with words of its own at random places."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for d in range(n):
        words = list(base)
        for at in rng.sample(range(200), edits):
            words[at] = f"x{rng.randrange(4 * n)}"
        rows.append((d, " ".join(words)))
    return rows


def test_near_copies_too_different_to_link_are_not_paired(spark, monkeypatch):
    """Most are classes of their own; all pairs of different classes would be over 1,000."""
    rows = edited_copies(60, 5, 1)
    counts: dict[str, list[int]] = {}

    def counted(df, name):
        counts.setdefault(name, []).append((out := staged(df, name)).count())
        return out

    monkeypatch.setattr(jaccard, "staged", counted)
    want = sorted(brute.classes(rows), key=str)
    assert got(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert len({c for _, _, c in want}) > 40 and counts["members"][0] > 60 and counts["rest"][0] < 600


def test_links_between_classes_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE", 7, raising=False)
    monkeypatch.setattr(jaccard, "PIVOTS", 1)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    rows = edited_copies(50, 3, 2) + [(100 + d, t) for d, t in edited_copies(40, 4, 3)]
    assert got(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == sorted(brute.classes(rows), key=str)


def test_pairs_across_classes_come_once_under_their_smallest_token():
    rng = np.random.default_rng(5)
    tokens = [sorted(rng.choice(9, 4, replace=False).tolist()) for _ in range(30)]
    marks = [bytes(jaccard.MARKS // 8)] * 29 + [b"\xff" * (jaccard.MARKS // 8)]  # the last differs from all
    found = []
    for token in range(9):
        here = [i for i in range(30) if token in tokens[i]]
        rows = [(token, i, i % 3, 40, 0, i % 3 > 0, left, tokens[i], marks[i]) for left in (True, False) for i in here if i % 3 or not left]
        names = ["token", "sid", "label", "n", "own", "outside", "is_left", "tokens", "marks"]
        table = pa.table({c: [r[k] for r in rows] for k, c in enumerate(names)})
        found += [tuple(r.values()) for r in jaccard._across(table).to_pylist()]
    pairs = [(i, j, len({*tokens[i]} & {*tokens[j]})) for i in range(29) for j in range(i + 1, 29) if i % 3 != j % 3]
    assert sorted(found) == [p for p in pairs if p[2]]


def test_near_duplicates_keep_first(docs, rows):
    kept = {d for d, _, c in brute.classes(rows) if d == c}
    assert {r.doc_id for r in jaccard.keep_first(docs).collect()} == kept


def test_jaccard_at_the_threshold(spark):
    words = [f"t{i}" for i in range(24)]
    rows = [(1, " ".join(words[:19])), (2, " ".join(words)), (3, " ".join(words[:18] + ["x"] * 6))]  # 15 of 20 shingles
    assert got(jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))) == brute.classes(rows)


AWKWARD = [
    "", None, "a@b.c@d.e", "a@b.c_d@e.f x@y.z.", "1.2.3.4.5.6.7.8 999.1.1.1 01.002.3.255", "4111 1111 1111 1111", "5 4111-1111-1111-1111x",
    "+1 (555) 123-4567 and +12 and ++44 20 7946 0958", "é💥 a.b+c@x-y.co 12-3 4111111111111111 7", "11111111111111111111 4111111111111111",
    "a@b.c-d@e.f", "x@y..z w@-.-", "1" * 30000, "1 " * 30000, "a@b.c " * 300, "+1234567890.", "-4111111111111111-", "1.2.3.4111111111111111",
]


def test_personal_data(spark):
    cue = [f"write secretbox: p{i}@mail.org now" for i in range(20)] + ["write secretbox: AB-1234567 now", "the AB-1234567 stays"]
    texts = AWKWARD + cue + ["the end"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.report(df).collect():
        base = brute.pii_base(texts[r.doc_id])
        written = [f"{k}:{a}:{b}" for a, b, k in base]
        assert r.base_sha256 == brute.sha(",".join(written))
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, _, k in base) for x in brute.PII]
        added = [s for s in r.spans.split(",") if s and s not in written]
        assert set(written) <= set(r.spans.split(","))
        assert added == (["id:17:27"] if texts[r.doc_id] == cue[20] else [])


def added_ids(spark, texts: list[str]) -> dict[int, list[str]]:
    found = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    return {r.doc_id: ids for r in found if (ids := [texts[r.doc_id][slice(*map(int, s.split(":")[1:]))] for s in r.spans.split(",") if s.startswith("id:")])}


def test_personal_data_over_two_hops(spark):
    texts = [f"a{i} secretbox: p{i}@mail.org b{i}" for i in range(20)]
    texts += [f"c{i} secretbox: AB-123456{i} d{i}" for i in range(6)] + [f"e{i} badge: AB-123456{i} f{i}" for i in range(6)]
    texts += ["g badge: CD-7654321 h", "i other: CD-7654322 j"]
    found = added_ids(spark, texts)
    assert found == {20 + i: [f"AB-123456{i % 6}"] for i in range(12)} | {32: ["CD-7654321"]}


def test_personal_data_by_two_words_and_from_the_right(spark):
    texts = [f"a{i} badge no p{i}@mail.org b{i}" for i in range(8)] + ["and badge no AB-1234567 c"] + [f"there is no{i} no d{i}" for i in range(40)] + [f"say no e{i}" for i in range(40)]
    texts += [f"f{i} q{i}@mail.org (member)" for i in range(8)] + ["g EF-1234567 (member)"]
    assert added_ids(spark, texts) == {8: ["AB-1234567"], 97: ["EF-1234567"]}


def test_redacted_rows_keep_their_columns(spark):
    df = spark.createDataFrame([(1, "mail a@b.c now", "x"), (2, None, "y"), (2, "nothing", None)], "doc_id long, text string, base string")
    assert got(pii.redact(df)) == sorted([(1, "mail <EMAIL> now", "x"), (2, "", "y"), (2, "nothing", None)], key=str)


def test_quality(docs, rows):
    texts = dict(rows)
    for r in quality.judge(docs, ["doc_id"]).collect():
        counts = brute.quality_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts
        assert not (r.kept and r.base_failed)


def test_fertility_against_the_encoder(spark):
    text = "Über naïve façades 漢字🎉 and | 7 words  more\nthan once once"
    row = quality.judge(spark.createDataFrame([(1, text, None)], "doc_id long, text string, lang string"), ["doc_id"]).first()
    model = quality.load_pieces(quality.TOKENIZERS, quality.VOCABULARY)
    ids = [i for w in brute.WORD.findall(text) for i in model.encode(w)]
    share = np.array(list(Counter(ids).values())) / len(ids)
    assert row.n_tokens == len(ids)
    assert row.byte_share == pytest.approx(sum(map(model.is_byte, ids)) / len(ids))
    assert row.token_entropy == pytest.approx(-(share * np.log2(share)).sum() / np.log2(len(ids)))


def test_bands_reject_noise(spark):
    noise = " ".join("漢字假名" * 2 + chr(0x3400 + i) for i in range(80))
    rows = [(1, noise, "en"), (2, noise, "zz"), (3, " ".join(["word"] * 20 + [f"other{i}" for i in range(60)]), "en")]
    kept = {r.doc_id for r in quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert kept == {3} or kept == {2, 3}


def test_bands_follow_the_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    judged = quality.judge(spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id"]).where("not base_failed").join(labels, "doc_id")
    kept = {r.quality: (r.kept, r.n) for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept"), F.count("*").alias("n")).collect()}
    assert kept[0][1] > 20 and kept[0][0] < 0.1
    assert kept[1][1] > 300 and kept[1][0] > 0.95


def test_bands_reject_keyboard_noise(spark):
    rng = random.Random(3)
    noise = " ".join("".join(rng.choice("qwertyuiopasdfghjklzxcvbnm") for _ in range(rng.randrange(3, 11))) for _ in range(300))
    rows = [(i, noise, lang) for i, lang in enumerate(("en", "fr", "de", "es"))]
    assert quality.keep_good(spark.createDataFrame(rows, "doc_id long, text string, lang string")).count() == 0


def test_shards(spark, rows):
    many = rows + [(1000 + i, "the same text") for i in range(500)] + [(1000, "the same text"), (None, "x")]
    df = spark.createDataFrame([(d, t, "own") for d, t in many], "doc_id long, text string, h string")
    found = sharding.shard_by_bytes(df, 8).collect()
    size = Counter()
    slots: dict[int, list[int]] = {}
    for r in found:
        assert r.size == len((r.text or "").encode()) + 1 and r.h == "own"
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(found) == len(many)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(len((t or "").encode()) + 1 for _, t in many)
    total = sum(size.values())
    assert all(abs(size[s] - total / 8) <= largest + 1 for s in range(8))


def test_shards_near_equal_when_rows_are_small(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.expr("repeat('x', cast(id % 37 as int))").alias("text"))
    size = [r[0] for r in sharding.shard_by_bytes(df, 8).groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(size) == 8 and max(size) - min(size) < 0.01 * sum(size) / 8


def test_chat_round_trip(spark):
    rows = [
        (1, 0, "user", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "a\\"), (1, 2, "assistant", "<</turn>\n### user: x"), (1, 2, "assistant", "<"),
        (2, None, None, None), (2, 0, "role: # <x>\\", "é漢🎉#"), (None, 0, "user", "lost"), (3, 0, "assistant", "y" * 100_000), (3, 0, "assistant", "y" * 100_000),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.format_conversations(df)
    parts = {}
    for r in formatted.orderBy("conv_id", "part").collect():
        parts[r.conv_id] = parts.get(r.conv_id, "") + r.formatted
    for conv in (1, 2, 3, None):
        turns = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert [(a.decode(), b.decode()) for a, b in chat.read_turns(parts[conv].encode())] == [x[2:] for x in turns]
        row = next(r for r in chat.digest_formatted(formatted).collect() if r.conv_id == conv)
        learned = [text for _, _, role, text in turns if role == "assistant"]
        assert row.n_turns == len(turns) and row.formatted_chars == len(parts[conv])
        assert row.turns_sha256 == brute.sha("".join(f"{x[2]}\n{x[3]}\n" for x in turns))
        assert row.loss_chars == sum(map(len, learned)) and row.loss_sha256 == brute.sha("".join(learned))


def test_chat_in_parts(monkeypatch, spark):
    monkeypatch.setattr(chat, "PART_BYTES", 64)
    df = spark.createDataFrame([(1, i, "assistant", f"turn {i} é") for i in range(40)], "conv_id long, turn long, role string, text string")
    batches = df.select("conv_id", "role", "text").toArrow().combine_chunks().to_batches()
    out = pa.Table.from_batches(list(chat._format(iter(batches))))
    assert out.num_rows > 5 and out["part"].to_pylist() == list(range(out.num_rows))
    done = pa.Table.from_batches(list(chat._digest(iter(out.select(["conv_id", "formatted", "turns"]).to_batches()))))
    assert done["n_turns"].to_pylist() == [40]


def test_mixing(spark):
    counts = {"a": 900, "b": 310, "c": 120, "": 50, "d": 7}
    rows = [(i, s or None, "x") for s, n in counts.items() for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, pos string")
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.15), ("", 0.05), ("absent", 9.0)], "src string, weight double")
    mixed = mixing.mixed(df, weights, slots=40, block_rows=4).collect()
    assert sorted((r.doc_id, r.source, r.pos) for r in mixed if r.source) == sorted(r for r in rows if r[1])
    slot_of: dict[int, set] = {}
    for r in mixed:
        slot_of.setdefault(r.slot, set()).add(r.source or "")
        assert r.release <= r.slot < r.deadline
    assert all(len(s) == 1 for s in slot_of.values())
    quotas = {r.src: r.a for r in mixing.shares(df.groupBy(F.coalesce("source", F.lit("")).alias("src")).agg(F.count("*").alias("n")), weights, 40).collect()}
    assert sum(quotas.values()) == 40 and min(quotas.values()) >= 1
    plan = brute.edf(quotas, 40)
    assert all(plan[slot % 40] == next(iter(s)) for slot, s in slot_of.items())
    done = Counter()
    for slot in range(max(r.slot for r in mixed if r.in_mix) + 1):
        done[next(iter(slot_of[slot]))] += 1
        assert all(abs(done[s] - a * (slot + 1) / 40) < 1 for s, a in quotas.items())


def test_mixing_keeps_to_the_weights_themselves(monkeypatch, spark):
    monkeypatch.setattr(mixing, "EPOCH", 1000)
    wanted = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.03, "e": 0.02}
    counts = {s: int(4000 * w) + 10 * i for i, (s, w) in enumerate(wanted.items())}
    df = spark.createDataFrame([(i, s) for s, n in counts.items() for i in range(n)] + [(i, None) for i in range(9)], "doc_id long, source string")
    weights = spark.createDataFrame(list(wanted.items()), "src string, weight double")
    rows = mixing.mixed(df, weights, block_rows=1).collect()
    assert sorted((r.doc_id, r.source or "") for r in rows) == sorted((r.doc_id, r.source or "") for r in df.collect())
    assert all(r.release <= r.slot < r.deadline for r in rows)
    by_slot = {r.slot: r for r in rows}
    assert len(by_slot) == len(rows)
    end = max(r.slot for r in rows if r.in_mix) + 1
    assert end > 3900
    done = Counter()
    for slot in range(end):
        done[by_slot[slot].source or ""] += 1
        assert all(abs(done[s] - w * (slot + 1)) < 1.001 for s, w in wanted.items())


def test_mixing_order_keeps_rows(spark):
    df = spark.createDataFrame([(i % 50, f"s{i % 3}", i) for i in range(200)], "doc_id long, source string, slot long")
    assert got(mixing.in_order(df)) == got(df)


TEXTS = ["Hello  world\n\tx é 漢字🎉 ", "", "a", "  lead ▁ mark", "the quick brown fox", " ", "same", "same", "\x00\x1f ｆ"]


def test_sampling_is_exact_distinct_and_seeded(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(20, None)], "doc_id long, text string")
    found = sampling.sampled(df, k=5)
    rows = found.collect()
    assert all(r.exact and 0 < r.inclusion <= 1 for r in rows)
    assert len({(r.doc_id, tuple(r.ids)) for r in rows}) == len(rows)
    assert got(found) == got(sampling.sampled(df.repartition(7), k=5))
    text_of = dict(enumerate(TEXTS)) | {20: ""}
    assert all(r.text == text_of[r.doc_id] for r in sampling.decoded(found).collect())
    assert [r.ids for r in rows if r.doc_id in (1, 20)] == [[], []]


def test_samples_follow_the_distribution():
    pieces = sampling.load_vocabulary(sampling.TOKENIZERS, sampling.VOCABULARY)
    n = 4000
    texts = repeats.Texts(pa.array(["fox in"] * n))
    found = sampling.sample(texts, sampling.mixed(np.arange(n, dtype=np.uint64)), 3, pieces)
    prob: dict[tuple, float] = {}
    first, second, inclusion = Counter(), Counter(), Counter()
    for samples in found:
        assert len(samples) == 3
        for rank, s in enumerate(samples):
            ids = tuple(s["ids"].tolist())
            prob[ids] = np.exp(s["log_prob"])
            inclusion[ids] += prob[ids] / s["inclusion"]
            (first if rank == 0 else second if rank == 1 else Counter())[ids] += 1
    likely = sorted(prob, key=prob.get)[-4:]
    for ids in likely:
        assert first[ids] / n == pytest.approx(prob[ids], abs=0.03)
        # The second draw is without replacement: p_b * sum over a of p_a / (1 - p_a).
        want = prob[ids] * sum(p / (1 - p) for a, p in prob.items() if a != ids)
        assert second[ids] / n == pytest.approx(want, abs=0.04)
        # Weighted by probability over inclusion, a segmentation counts as often as it is likely.
        assert inclusion[ids] / n == pytest.approx(prob[ids], abs=0.04)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    rows += [(400, None), (401, [1.0] * 7 + [None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (404, [1.0, 2.0]), (420, [0.5, 1.0]), (440, []), (405, rows[3][1]), (405, rows[3][1])]
    vectors = topk.quantized(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    usable = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, v in usable:
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in usable if c != q and len(w) == len(v))
            want += [(q, rank, c, -s) for rank, (s, c) in enumerate(scored[:7], 1)]
    assert got(topk.exact_top_k(vectors.where("vec_id % 20 = 0"), vectors, 7)) == sorted(want, key=str)


def test_lists_bound_scores():
    rng = np.random.default_rng(4)
    x = rng.integers(-9, 9, (50, 6)).astype(float)
    upper_top, lower_top, upper_bottom, lower_bottom = topk._far_ends(x, 7)
    assert (upper_top >= x).all() and (lower_top <= x).all() and (upper_bottom <= x).all() and (lower_bottom >= x).all()


@pytest.mark.parametrize("run", [
    lambda d: fm_index.remove_repeated_words(d), lambda d: suffix_merge.remove_repeated_bytes(d), lambda d: sharding.shard_by_bytes(d, 8),
    lambda d: pii.report(d), lambda d: quality.judge(d, ["doc_id"]), lambda d: jaccard.near_duplicates(d), lambda d: mixing.mixed(d),
    lambda d: sampling.sampled(d, k=2), lambda d: pii.redact(d), lambda d: jaccard.keep_first(d), lambda d: quality.keep_good(d), lambda d: mixing.in_order(d),
], ids=["words", "bytes", "shards", "pii", "quality", "jaccard", "mixing", "sampling", "redact", "first", "good", "order"])
def test_empty_tables(spark, run):
    assert run(spark.createDataFrame([], DOCS)).count() == 0


def test_clashing_columns(spark):
    text = " ".join(f"word{i} other{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, "en", "a", 5, "p", "q", "r")], DOCS + ", n_words string, spans string, __kept string")
    for step in (quality.keep_good, jaccard.keep_first, pii.redact, mixing.in_order):
        assert [r.asDict() for r in step(df).collect()] == [df.first().asDict()]


def test_crc(spark):
    from nearfold.llm.queries import QUERIES

    rows = QUERIES["op4_sharding"](spark, "/root/testdata/sf0.001").limit(5).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)


def test_places_are_sorted_with_their_keys():
    """The same order as a stable sort by key, also for keys that leave no room for places."""
    key = np.random.default_rng(3).integers(0, 50, 5000)
    for most in (50, 1 << 60):
        assert (sampling._order(key, most) == np.argsort(key, kind="stable")).all()


def test_counted_groups_are_handed_on_in_bounded_batches(spark, monkeypatch):
    docs = spark.createDataFrame([(f"a{i % 7} b{i % 5} c{i % 3} d", "en") for i in range(400)], "text string, lang string")
    want = sorted(tuple(r) for r in collocations.collocations(docs, least=3).collect())
    monkeypatch.setattr(collocations, "HANDED_ON", 5)
    assert sorted(tuple(r) for r in collocations.collocations(docs, least=3).collect()) == want != []
