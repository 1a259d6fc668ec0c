"""A program in parts gives what the fold over the whole text gives, wherever it is cut."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from nearfold.operators.program_parts import body_lines_of_parts, instruction_count_of_parts, text_parts
from nearfold.operators.program_text import function_body_lines, instruction_count


def texts() -> list[tuple[int | None, str | None]]:
    rng = random.Random(17)
    lines = ["define i32 @f() {", "}", "  ret i32 0", "  %x = add i32 1, 2", "", "; ret", "b:", "  tail call void @g() ", "define {", "\tstore i8 0 ", "x", "} ", "define void @h(", "é ret"]
    out: list[tuple[int | None, str | None]] = [(0, ""), (1, "\n"), (2, "\r\n"), (3, "\r\r\n\n"), (4, "ret"), (5, "define {\nret\n}"), (6, None), (7, "define {\r\nret"), (None, "define {\nret\n")]
    for i in range(60):
        text = "".join(rng.choice(lines) + rng.choice(["\n", "\n", "\r\n", "\r", "\n\r"]) for _ in range(rng.randrange(30)))
        out.append((10 + i, text + rng.choice(["", "ret", "}"])))
    return out


def key(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("part_chars", [1, 2, 3, 7, 20, 10_000])
def test_any_cut_gives_the_fold(spark, part_chars):
    docs = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)
    parts = text_parts(docs, part_chars=part_chars).repartition(5)
    assert key(instruction_count_of_parts(parts)) == key(docs.select("doc_id", instruction_count(F.col("text")).alias("n")))
    assert key(body_lines_of_parts(parts)) == key(function_body_lines(docs))


def test_parts_of_uneven_length_with_empty_ones(spark):
    rng = random.Random(5)
    rows = []
    for doc, text in texts():
        if text is not None:
            places = sorted(rng.choices(range(len(text) + 1), k=4))
            rows += [(doc, n * 3, text[a:b]) for n, (a, b) in enumerate(zip([0, *places], [*places, len(text)], strict=True))]
    rng.shuffle(rows)
    parts = spark.createDataFrame(rows, "doc_id long, part int, text string")
    docs = spark.createDataFrame([t for t in texts() if t[1] is not None], "doc_id long, text string")
    assert key(instruction_count_of_parts(parts)) == key(docs.select("doc_id", instruction_count(F.col("text")).alias("n")))
    assert key(body_lines_of_parts(parts)) == key(function_body_lines(docs))


def test_parts_put_together_are_the_text(spark):
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    parts = text_parts(docs, part_chars=5)
    assert parts.agg(F.max(F.length("text"))).head()[0] == 5
    whole = parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"]), "").alias("text"))
    assert key(whole.filter("doc_id <> 6")) == key(docs.filter("doc_id <> 6"))


def test_no_parts(spark):
    none = spark.createDataFrame([], "doc_id long, part int, text string")
    assert instruction_count_of_parts(none).count() == 0 and body_lines_of_parts(none).count() == 0


def test_parts_are_read_once_for_states_and_once_for_texts(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    docs = spark.createDataFrame([(i, "define {\nret\nadd\n}\n" * (i % 3 + 1)) for i in range(30)], "doc_id long, text string")
    parts = text_parts(docs, part_chars=9).localCheckpoint()
    made = parts.withColumn("text", seen("text"))
    assert key(body_lines_of_parts(made)) == key(function_body_lines(docs))
    # Texts that a filter lets pass are read again behind it.
    assert read.value < 3 * parts.count()


def test_blanks_and_words_of_a_line(spark):
    from nearfold.operators.program_text import is_instruction, trimmed

    rows = [(" ret ", "ret", True), ("Ret", "Ret", True), ("ret9", "ret9", False), ("a  ", "a ", False), ("%x = TAIL\tcall ", "%x = TAIL\tcall", True), ("!ret", "!ret", False), ("invoKe x", "invoKe x", False), ("ret ", "ret ", True)]
    df = spark.createDataFrame(rows, "line string, want string, hit boolean").select("*", trimmed(F.col("line")).alias("t"))
    assert [(r["t"], r["i"]) for r in df.withColumn("i", is_instruction(F.col("t"))).collect()] == [(w, h) for _, w, h in rows]
