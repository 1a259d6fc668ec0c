"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

WORD = re.compile(r"[^\x20\x09-\x0D]+")
PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def _covered(rows: list[tuple[int | None, list | bytes]], window: int) -> list[list[bool]]:
    first: dict = {}
    for doc, units in rows:
        if doc is not None:
            for i in range(len(units) - window + 1):
                key = tuple(units[i : i + window])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, units in rows:
        gone = [False] * len(units)
        if doc is not None:
            for i in range(len(units) - window + 1):
                if first[tuple(units[i : i + window])] < doc:
                    gone[i : i + window] = [True] * window
        out.append(gone)
    return out


def word_dedup(rows, window=50):
    units = [(d, WORD.findall(t or "")) for d, t in rows]
    return sorted(
        ((d, len(u), sum(g), sha(" ".join(w for w, x in zip(u, g, strict=True) if not x))) for (d, u), g in zip(units, _covered(units, window), strict=True)), key=str
    )


def byte_dedup(rows, window=50):
    units = [(d, (t or "").encode()) for d, t in rows]
    out = []
    for (d, u), g in zip(units, _covered(units, window), strict=True):
        spans = sum(x and not (i and g[i - 1]) for i, x in enumerate(g))
        out.append((d, len(u), sum(g), spans, sha(bytes(b for b, x in zip(u, g, strict=True) if not x))))
    return sorted(out, key=str)


def shingles(text: str | None) -> frozenset:
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1))))


def classes(rows) -> list[tuple]:
    sets = [shingles(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                label[root(i)] = root(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        r = root(i)
        least[r] = min(least.get(r, math.inf), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(rows))


def luhn(digits: str) -> bool:
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def pii_base(text: str | None) -> list[tuple[int, int, str]]:
    out = []
    for rank, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": lambda: True,
                "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                "card": lambda: 14 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 10 <= len(digits) <= 15,
            }[kind]
            if good():
                out.append((m.start(), rank, m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(out)]


def quality_counts(text: str | None) -> tuple:
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    times = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def edf(quotas: dict[str, int], slots: int) -> list[str]:
    done = dict.fromkeys(sorted(quotas), 0)
    out = []
    for t in range(slots):
        ready = [(math.ceil(Fraction((done[s] + 1) * slots, quotas[s])), s) for s in done if Fraction(done[s] * slots, quotas[s]) < t + 1]
        pick = min(ready)[1]
        done[pick] += 1
        out.append(pick)
    return out


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """(start, length, period) of every periodic run."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            stretch = words[i : i + length]
            if j > i and length >= max(6, 4 * q) and not any(stretch[d:] == stretch[:-d] for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return out


def periodic(text: str | None) -> tuple:
    words = WORD.findall(text or "")
    found = sorted(runs_of(words), key=lambda r: (r[0], r[2]))
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    longest = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    best = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
    return len(words), len(found), *best, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone))


def planted(doc: int | None, text: str | None) -> list[str]:
    words = WORD.findall(text or "")
    h = None if doc is None else zlib.crc32(str(doc).encode())
    if h is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def collocations(rows, longest: int, top: int) -> list[tuple]:
    counts: dict = {}
    total: Counter = Counter()
    for lang, text in rows:
        lang = lang or "und"
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {s: a for s, a in f.items() if len(s) > 1 and a >= 10}
        gone = {s[i : i + k] for s, a in candidates.items() for k in range(2, len(s)) for i in range(len(s) - k + 1) if 100 * a >= 50 * candidates[s[i : i + k]]}
        scored = []
        for s, a in candidates.items():
            if s not in gone:
                score, _, left, right = min((10**6 * a * a // (f[s[:k]] * f[s[k:]]), k, f[s[:k]], f[s[k:]]) for k in range(1, len(s)))
                scored.append((-score, -a, " ".join(s).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)
