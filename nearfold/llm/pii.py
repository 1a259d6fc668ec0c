"""Personal data: fixed patterns, and contextual extraction that they bootstrap.

The base patterns (email, ip, card, phone) give seed entities. The contexts of a seed are lexical patterns: the
word before it, the two words before it, and the word after it. The same contexts of other identifier-like
tokens (five digits or more) link patterns and instances in a graph. Spark scores it in rounds. A pattern is
scored when MIN_SEEDS different instances that are seeds or were discovered support it: its confidence is the
summed score of the instances in it over all occurrences of the context in the corpus. It is admitted when that
reaches CONFIDENCE. An instance's score is that some scored pattern is right (noisy or), seeds being certain.
Instances in an admitted pattern are discovered and support others in the next round; what is admitted stays, and rounds go on
until none is added and confidences have settled. Contexts such as ``phone:`` become confident, common words do not. Tokens in admitted
patterns that no base pattern covers are reported as kind ``id``; other tokens are never instances.

Everything is DataFrame and SQL functions. Spans are found with Java regular expressions whose possessive
groups neither backtrack nor recurse, so long texts are safe; offsets come from the text between matches.
Start and end count code points, end exclusive.

Edge cases: a null text is an empty one and has no spans. Repeated rows and rows that share an id are
treated each on its own. An empty table gives no rows. Other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfold.session import staged

KINDS = ("email", "ip", "card", "phone")

#: The patterns as given, in forms that find the same matches in linear time. A match of the email pattern
#: begins where its run of letters begins, or where the last match ended; a card is a whole run of digits.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap sign without which a pattern cannot match.
SIGNS = {"email": "@", "ip": ".", "phone": "+"}

#: A word, white space, and a token with five digits or more.
CANDIDATE = r"(?<!\S)\S{1,64}\s{1,4}(?:[^\s0-9]*+[0-9]){5}\S*+"

#: Different seeds or discovered instances that a pattern needs, confidence from which it is trusted.
MIN_SEEDS, CONFIDENCE = 5, 0.5
#: Growth of all confidences together below which rounds that admit no pattern end.
SETTLED = 1e-3

#: Spans sort by start, then by kind as listed; ``rank`` therefore stands before ``end``.
_SPAN = "struct<start:int,rank:int,end:int,kind:string,value:string,contexts:array<string>>"


def _literal(pattern: str) -> str:
    return "r'" + pattern.replace("'", "\\'") + "'"


def _places(name: str, pattern: str, sign: str | None) -> Column:
    """(start, end, value) of every match in ``text``, from the pieces between the matches."""
    found = f"regexp_extract_all(text, {_literal(pattern)}, 0)"
    if sign:
        found = f"IF(contains(text, '{sign}'), {found}, array())"
    return F.expr(found).alias(name)


def _with_offsets(name: str, pattern: str) -> str:
    kind = "array<struct<start:int,end:int,value:string>>"
    return f"""
    IF(size({name}) = 0, cast(array() AS {kind}),
       aggregate(zip_with({name}, slice(split(text, {_literal(pattern)}, -1), 1, size({name})), (m, g) -> named_struct('m', m, 'g', g)),
         named_struct('at', 0, 'out', cast(array() AS {kind})),
         (acc, x) -> named_struct('at', acc.at + length(x.g) + length(x.m), 'out', array_append(acc.out,
             named_struct('start', acc.at + length(x.g), 'end', acc.at + length(x.g) + length(x.m), 'value', x.m))),
         acc -> acc.out))
    """


_DIGITS = "regexp_replace(s.value, '[^0-9]', '')"
_VALID = {
    "email": "true",
    "ip": "forall(split(s.value, r'\\.'), p -> length(ltrim('0', p)) <= 3 AND cast(concat('0', right(ltrim('0', p), 3)) AS int) <= 255)",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND luhn_check({_DIGITS})",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
}
_BEFORE = r"regexp_extract(substring(text, greatest(s.start - 158, 1), least(s.start, 159)), r'(?:^|\s)(?:(\S{1,64})\s{1,4})?(\S{1,64})\s{1,4}$', %d)"
_AFTER = r"regexp_extract(substring(text, s.end + 1, 70), r'^\s{1,4}(\S{1,64})(?:\s|$)', 1)"
#: A context is its side (<, <<, >) and its words in lower case.
_CONTEXTS = f"""transform(array(named_struct('near', lower({_BEFORE % 2}), 'far', lower({_BEFORE % 1}), 'after', lower({_AFTER}))), c ->
    filter(array(IF(c.near <> '', concat('< ', c.near), NULL), IF(c.far <> '', concat('<< ', c.far, ' ', c.near), NULL),
        IF(c.after <> '', concat('> ', c.after), NULL)), x -> x IS NOT NULL))[0]"""


def _scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__base`` spans and ``__others``: (start, end, token, contexts) of identifier-like tokens."""
    df = docs.withColumn("text", F.coalesce("text", F.lit("")))
    # One projection per step, so that no pattern runs twice over a text.
    df = df.withColumns({f"__{k}": _places(f"__{k}", PATTERNS[k], SIGNS.get(k)) for k in KINDS} | {"__other": _places("__other", CANDIDATE, None)})
    df = df.withColumns({f"__{k}": F.expr(_with_offsets(f"__{k}", p)) for k, p in [*PATTERNS.items(), ("other", CANDIDATE)]})
    spans = [
        f"transform(filter(__{k}, s -> {_VALID[k]}), s -> named_struct('start', s.start, 'rank', {rank}, 'end', s.end, 'kind', '{k}', 'value', s.value))"
        for rank, k in enumerate(KINDS)
    ]
    token = r"regexp_extract(s.value, r'\s(\S+)$', 1)"
    others = f"""transform(__other, s -> named_struct('start', s.end - length({token}), 'rank', {len(KINDS)}, 'end', s.end, 'kind', 'id', 'value', {token}))"""
    df = df.withColumns({"__base": F.expr(f"array_sort(concat({', '.join(spans)}))"), "__others": F.expr(others)})
    df = df.withColumn("__others", F.expr("filter(__others, o -> NOT exists(__base, b -> b.start < o.end AND o.start < b.end))"))
    with_contexts = "transform({}, s -> named_struct('start', s.start, 'rank', s.rank, 'end', s.end, 'kind', s.kind, 'value', s.value, 'contexts', {}))"
    df = df.withColumns({c: F.expr(with_contexts.format(c, _CONTEXTS)) for c in ("__base", "__others")})
    return df.drop(*(f"__{k}" for k in [*KINDS, "other"]))


def _occurring(docs: DataFrame) -> DataFrame:
    """(words): every word and every pair of neighbouring words of the texts, as often as it occurs."""
    w = "filter(split(lower(coalesce(text, '')), r'\\s+'), x -> x <> '')"
    pairs = "transform(w, (x, i) -> IF(i > 0 AND length(x) <= 64 AND length(w[i - 1]) <= 64, concat(w[i - 1], ' ', x), NULL))"
    each = docs.select(F.expr(w).alias("w")).select(F.explode(F.expr(f"concat(w, {pairs})")).alias("words"))
    return each.where("words IS NOT NULL")


def score_patterns(seen: DataFrame, docs: DataFrame) -> DataFrame:
    """(pattern, confidence) of the trusted patterns; ``seen`` has __base and __others of every row."""
    spans = [seen.select(F.explode(c).alias("s")).select(F.explode("s.contexts").alias("pattern"), F.lower("s.value").alias("instance"), F.lit(seed).alias("seed")) for c, seed in (("__base", 1), ("__others", 0))]
    edges = spans[0].unionByName(spans[1]).groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    # A pattern with fewer instances of any kind can never be admitted; discovery changes support, not instances.
    able = edges.groupBy("pattern").agg(F.count("*").alias("instances"), F.sum("n").alias("uses")).where(F.col("instances") >= MIN_SEEDS)
    able = staged(able.withColumn("words", F.regexp_replace("pattern", "^[<>]+ ", "")), "pii-able")
    often = _occurring(docs).join(able.select("words").distinct(), "words").groupBy("words").agg(F.count("*").alias("often"))
    often = staged(able.join(often, "words").select("pattern", "often"), "pii-words")
    edges = staged(edges.join(often.select("pattern"), "pattern"), "pii-edges")
    supported, before = None, (0, 0, 0.0)
    while True:
        scored = edges.withColumns({"score": F.col("seed").cast("double"), "known": F.col("seed") == 1})
        if supported is not None:
            of_instance = edges.join(supported, "pattern").groupBy("instance").agg(
                (1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("belief"), F.max(F.col("confidence") >= CONFIDENCE).alias("found")
            )
            scored = edges.join(of_instance, "instance", "left").select(
                "pattern", "n", F.when(F.col("seed") == 1, 1.0).otherwise(F.coalesce("belief", F.lit(0.0))).alias("score"),
                ((F.col("seed") == 1) | F.coalesce("found", F.lit(False))).alias("known"),
            )
        passing = (
            scored.groupBy("pattern").agg(F.sum(F.col("score") * F.col("n")).alias("mass"), F.count(F.when(F.col("known"), 1)).alias("support")).join(often, "pattern")
            .where(F.col("support") >= MIN_SEEDS).select("pattern", F.least(F.col("mass") / F.col("often"), F.lit(0.999)).alias("confidence"))
        )
        # Scores only grow, so a pattern that was supported or trusted is so again.
        supported = staged(passing, "pii-patterns")
        trusted = supported.where(F.col("confidence") >= CONFIDENCE)
        now = supported.agg(F.count("*"), F.count(F.when(F.col("confidence") >= CONFIDENCE, 1)), F.coalesce(F.sum("confidence"), F.lit(0.0))).first()
        if now[:2] == before[:2] and now[2] - before[2] < SETTLED:
            return trusted
        before = tuple(now)


def find_spans(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``__base`` and ``__spans``, arrays of (start, rank, end, kind, value, contexts).

    ``docs`` needs a column text; ``__spans`` holds the base spans and those that patterns add.
    """
    seen = staged(_scanned(docs.select(*dict.fromkeys([*keep, "text"]))).select(*keep, "__base", "__others").withColumn("__row", F.monotonically_increasing_id()), "pii-seen")
    trusted = score_patterns(seen, docs)
    more = (
        seen.where(F.size("__others") > 0).select("__row", F.explode("__others").alias("o")).select("__row", "o", F.explode("o.contexts").alias("pattern"))
        .join(trusted.select("pattern"), "pattern", "left_semi")
        .groupBy("__row").agg(F.collect_set("o").alias("__more"))
    )
    joined = seen.join(more, "__row", "left")
    every = F.expr(f"array_sort(concat(__base, coalesce(__more, cast(array() AS array<{_SPAN}>))))")
    return joined.select(*keep, "__base", every.alias("__spans"))


def written(spans: str) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.expr(f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')")


def report(docs: DataFrame) -> DataFrame:
    """Counts, digest and spans per document of (doc_id, text)."""
    found = find_spans(docs, ["doc_id"])
    counts = [F.expr(f"cast(size(filter(__base, s -> s.kind = '{k}')) AS long)").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written("__base"), 256).alias("base_sha256"), written("__spans").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets, ``n_chars`` counted anew.

    Where spans overlap, the first goes and the rest of the others with it.
    """
    own = docs.columns
    found = find_spans(docs, own)
    pieces = F.expr(
        """aggregate(__spans, named_struct('at', 0, 'out', cast(array() AS array<string>)),
        (acc, s) -> IF(s.start < acc.at, named_struct('at', greatest(acc.at, s.end), 'out', acc.out),
            named_struct('at', s.end, 'out', array_append(acc.out, concat(substring(text, acc.at + 1, s.start - acc.at), '<', upper(s.kind), '>')))),
        acc -> concat(array_join(acc.out, ''), substring(text, acc.at + 1, 2147483647)))"""
    )
    masked = found.withColumn("text", F.when(F.size("__spans") > 0, pieces).otherwise(F.col("text")))
    if "n_chars" in own:
        masked = masked.withColumn("n_chars", F.when(F.size("__spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return masked.select(*own)
