"""Pieces found in linear time against trying every end for every start."""

from __future__ import annotations

import random
import time

import pytest

from nearfold.operators.longest_match import Matcher


def greedy(word: str, ids: dict[str, int]) -> list[int] | None:
    found, start = [], 0
    while start < len(word):
        ends = (e for e in range(len(word), start, -1) if ("##" if start else "") + word[start:e] in ids)
        end = next(ends, None)
        if end is None:
            return None
        found.append(ids[("##" if start else "") + word[start:end]])
        start = end
    return found


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "ab#", "é😀b"])
def test_random_vocabularies(letters):
    rng = random.Random(len(letters))
    for _ in range(300):
        pieces = {"".join(rng.choices(letters, k=rng.randint(1, 6))) for _ in range(rng.randint(1, 12))}
        tokens = [*pieces, *("##" + "".join(rng.choices(letters, k=rng.randint(1, 5))) for _ in range(rng.randint(0, 12)))]
        ids = {t: i for i, t in enumerate(dict.fromkeys(tokens))}
        matcher = Matcher(ids, "##")
        for _ in range(30):
            word = "".join(rng.choices(letters, k=rng.randint(0, 14)))
            assert matcher.split(word) == greedy(word, ids), (word, ids)


def test_marks_and_single_letters():
    ids = {"[UNK]": 0, "##": 1, "#": 2, "##a": 3, "a": 4, "aba": 5, "##ba": 6, "##b": 7}
    matcher = Matcher(ids, "##")
    for word in ("", "a", "ab", "aba", "abab", "ababa", "#", "##", "##a", "###", "[UNK]", "x", "ax"):
        assert matcher.split(word) == greedy(word, ids), word


def test_a_long_word_takes_linear_time():
    # Every start could be tried up to the far end: the square of a million steps.
    ids = {t: i for i, t in enumerate(["a", "##a", "##aa", "##" + "a" * 50 + "b"])}
    matcher = Matcher(ids, "##")
    begin = time.process_time()
    found = matcher.split("a" * 1_000_000)
    assert len(found) == 500_001 and found[:3] == [0, 2, 2]
    assert time.process_time() - begin < 20
    assert matcher.split("a" * 1_000_000 + "c") is None
