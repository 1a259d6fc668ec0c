"""Corpus selection, normalisation, line states and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.registry import documents, query, table
from catalog.tokens import TOKENS_SQL, hashed_ids
from nearfold.functions.columns import id_from_path, natural_key, natural_order
from nearfold.functions.text import fold_text, normalize_text
from nearfold.operators.program_parts import body_lines_of_parts, instruction_count_of_parts, text_parts
from nearfold.operators.program_text import CALL_PREFIX, OPCODES, RESULT_PREFIX, function_body_lines, instruction_count
from nearfold.operators.ranks import hash_split
from nearfold.operators.tokens import chunk_tokens
from nearfold.session import scratch_path, spread, staged
from nearfold.sources.readers import limit_corpus, read_corpus, read_corpus_parts
from nearfold.sources.small_files import write_keyed

WORD = r"\p{L}\p{N}_"

# RE2 has no look-around: whole words are wrapped in private-use marks first.
NORMALIZE_SQL = rf"""
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace({{text}},
    '%[{WORD}.]+', '[REG]', 'g'), '0x[0-9A-Fa-f]+', '[ADDR]', 'g'),
    '([{WORD}]+)', chr(57344) || '\1' || chr(57345), 'g'),
    chr(57344) || '\p{{{{Nd}}}}+' || chr(57345), '[NUM]', 'g'),
    chr(57344) || '(?:i8|i16|i32|i64|float|double)' || chr(57345), '[TYPE]', 'g'),
    '[' || chr(57344) || chr(57345) || ']', '', 'g'),
    '@[{WORD}.]+', '[GLOB]', 'g'), '[{WORD}][{WORD}.]*:', '[LBL]:', 'g'),
    '!\p{{{{Nd}}}}+', '[MD]', 'g'), 'c"[^\n]*?"', '[STR]', 'g')"""


def normalized_sql(column: str) -> str:
    return NORMALIZE_SQL.replace("{text}", column).replace("{{", "{").replace("}}", "}")


@query(
    "normalize_text",
    f"""SELECT 'd' || doc_id AS id, {normalized_sql('text')} AS normalized FROM documents
UNION ALL SELECT 'p' || page_id, {normalized_sql('html')} FROM pages""",
)
def normalize_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents and all raw pages, whole."""
    docs = documents(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "text")
    pages = table(spark, sf_dir, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("text")
    )
    return docs.unionByName(pages).select("id", normalize_text(F.col("text")).alias("normalized"))


@query("fold_text", "SELECT doc_id, lower(strip_accents(text)) AS folded FROM documents")
def fold_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", fold_text(F.col("text")).alias("folded"))


@query("corpus_scan", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents")
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text file per document in a few folders, written and scanned back, many files to a task."""
    path = scratch_path(spark, "corpus")
    place = F.concat_ws("/", F.concat(F.lit("shelf"), F.col("doc_id") % 10), F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".txt")))
    write_keyed(documents(spark, sf_dir).select(place.alias("name"), "text"), path)
    return read_corpus(spark, path, "*.txt", r"/doc([0-9]+)\.txt$", packed=True).select("doc_id", "text")


@query("corpus_parts", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents")
def corpus_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files read in parts and put together again."""
    path = scratch_path(spark, "corpus")
    write_keyed(documents(spark, sf_dir).select(F.concat(F.lit("doc"), F.col("doc_id"), F.lit(".txt")).alias("name"), "text"), path)
    parts = read_corpus_parts(spark, path, "*.txt", r"/doc([0-9]+)\.txt$", part_bytes=1 << 21)
    texts = F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda p: p["text"])
    return parts.groupBy("doc_id").agg(F.array_join(texts, "").alias("text"))


NATURAL_SQL = """list_transform(regexp_extract_all(url, '[0-9]+|[^0-9]+'),
  lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN lpad(p, 30, '0') ELSE lower(p) END)"""


@query("natural_sort", f"SELECT page_id, url, array_to_string({NATURAL_SQL}, '|') AS sort_key FROM pages")
def natural_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.transform(
        natural_key(F.col("url")), lambda p: F.coalesce(F.lpad(p["number"].cast("string"), 30, "0"), p["text"])
    )
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.orderBy(*natural_order("url")).select("page_id", "url", F.array_join(key, "|").alias("sort_key"))


@query(
    "corpus_limit",
    """SELECT page_id, url FROM pages ORDER BY list_transform(regexp_extract_all(url, '[0-9]+|[^0-9]+'),
  lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN '1' || lpad(p, 30, '0') ELSE '0' || lower(p) END), url, page_id LIMIT 100""",
)
def corpus_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first hundred pages in natural url order."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return limit_corpus(pages, 100, "url")


@query(
    "extract_id",
    """SELECT page_id, CASE WHEN regexp_extract(url, '([^/]+)/[^/]*$', 1) <> '' THEN regexp_extract(url, '([^/]+)/[^/]*$', 1)
  ELSE regexp_extract(url, '([^/]*)$', 1) END AS folder,
  CAST(CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS VARCHAR) AS number, regexp_extract(url, '^[a-z]+://[^/]+', 0) AS host
FROM pages""",
)
def extract_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id",
        id_from_path(url).alias("folder"),
        id_from_path(url, r"/([0-9]+)").alias("number"),
        id_from_path(url, r"^[a-z]+://[^/]+").alias("host"),
    )


SPLIT_SQL = """WITH marked AS (
  SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS rn, count(*) OVER () AS n FROM documents
), split AS (
  SELECT doc_id, CASE WHEN rn <= least(n - 1, greatest(1, CAST(floor(n * 0.15::DOUBLE) AS BIGINT))) THEN 'validation' ELSE 'train' END AS split
  FROM marked
)"""


@query("train_val_split", SPLIT_SQL + "\nSELECT doc_id, split FROM split")
def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hash_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.15, 42)


@query(
    "corpus_counts",
    SPLIT_SQL + TOKENS_SQL.replace("WITH", ",", 1) + """
SELECT s.split, count(DISTINCT s.doc_id) AS n_docs, count(*) AS n_chunks, CAST(sum(c.n - 2) AS BIGINT) AS n_content
FROM split s JOIN chunks c ON c.doc_id = s.doc_id GROUP BY s.split""",
)
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, chunks and content tokens on either side of the split."""
    docs = spread(hash_split(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", 0.15, 42))
    chunks = chunk_tokens(
        docs.select(F.struct("doc_id", "split").alias("doc"), hashed_ids(F.col("text")).alias("input_ids")),
        128, 32, 2, 3, [0, 1, 2, 3, 4], "doc",
    )
    return chunks.groupBy("doc.split").agg(
        F.count_if(F.col("chunk_no") == 0).alias("n_docs"),
        F.count("*").alias("n_chunks"),
        F.sum(F.size("input_ids") - 2).alias("n_content"),
    )


# --- program text: every order is a small program, its lines are instructions ----


def programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line of text per line of an order; an order's lines do not grow with the table."""
    part = F.col("l_partkey").cast("string")
    number = F.col("l_linenumber").cast("string")
    line = (
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("  %"), number, F.lit(".x = add i32 %a, "), part))
        .when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), F.lit("  tail call void @g()"))
        .when(F.col("l_returnflag") == "R", F.concat(F.lit("b"), part, F.lit(":")))
        .when(F.col("l_linestatus") == "F", F.concat(F.lit("  ; ret "), part))
        .otherwise(F.concat(F.lit("}\n  %z = mul i32 1, 2\ndefine i32 @f"), part, F.lit("() {\nret:   ; preds = %0\n\t!dbg")))
    )
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.struct(F.col("l_linenumber").alias("n"), line.alias("line")).alias("l")
    )
    body = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l")).alias("ls"))
    text = F.concat(
        F.lit("declare void @g()\n  %z = sub i32 1, 2\ndefine i32 @main(i32 %a) {\nentry:\n"),
        F.array_join(F.transform("ls", lambda x: x["line"]), "\n"),
        F.lit("\n  fneg float %x\n  ret i32 %a\n}\n  unreachable\n"),
    )
    return body.select(F.col("l_orderkey").alias("doc_id"), text.alias("text"))


PROGRAMS_SQL = rf"""WITH items AS (
  SELECT l_orderkey, l_linenumber AS n, CASE WHEN l_returnflag = 'A' THEN '  %' || l_linenumber || '.x = add i32 %a, ' || l_partkey
    WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN '  tail call void @g()' WHEN l_returnflag = 'R' THEN 'b' || l_partkey || ':'
    WHEN l_linestatus = 'F' THEN '  ; ret ' || l_partkey
    ELSE '}}' || chr(10) || '  %z = mul i32 1, 2' || chr(10) || 'define i32 @f' || l_partkey || '() {{' || chr(10)
         || 'ret:   ; preds = %0' || chr(10) || chr(9) || '!dbg' END AS line
  FROM lineitem
), programs AS (
  SELECT l_orderkey AS doc_id, 'declare void @g()' || chr(10) || '  %z = sub i32 1, 2' || chr(10) || 'define i32 @main(i32 %a) {{' || chr(10)
    || 'entry:' || chr(10) || string_agg(line, chr(10) ORDER BY n, line) || chr(10) || '  fneg float %x' || chr(10)
    || '  ret i32 %a' || chr(10) || '}}' || chr(10) || '  unreachable' || chr(10) AS text FROM items GROUP BY l_orderkey
), split_lines AS (
  SELECT doc_id, string_split(text, chr(10)) AS parts FROM programs
), lines AS (
  SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INT) AS line_no, trim(unnest(parts), ' ' || chr(9)) AS line FROM split_lines
), states AS (
  SELECT *, CASE WHEN starts_with(line, 'define ') AND line LIKE '%{{' THEN 1 WHEN line = '}}' THEN 0 END AS mark FROM lines
), body AS (
  SELECT *, last_value(mark IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS inside FROM states
), counted AS (
  SELECT doc_id, line_no, line, NOT regexp_matches(line, '^[;!]') AND line NOT LIKE '%:' AND
    regexp_matches(line, '(?i)^{RESULT_PREFIX}{CALL_PREFIX}({"|".join(OPCODES)})\b') AS is_instruction
  FROM body WHERE inside = 1 AND mark IS NULL
)"""


@query("instruction_count", PROGRAMS_SQL + "\nSELECT doc_id, count(*) FILTER (WHERE is_instruction) AS n FROM counted GROUP BY doc_id")
def instruction_count_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return programs(spark, sf_dir).select("doc_id", instruction_count(F.col("text")).alias("n"))


@query("function_body_lines", PROGRAMS_SQL + "\nSELECT doc_id, line_no, line, is_instruction FROM counted")
def function_body_lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return function_body_lines(programs(spark, sf_dir))


#: Characters of a part: about a line and a half, so that most lines and many line breaks are cut.
PART = 40


@query("instruction_count_parts", PROGRAMS_SQL + "\nSELECT doc_id, count(*) FILTER (WHERE is_instruction) AS n FROM counted GROUP BY doc_id")
def instruction_count_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same count with every program in many parts, as a text too long for one task would be."""
    parts = staged(text_parts(programs(spark, sf_dir), part_chars=PART), "parts")
    return instruction_count_of_parts(parts)


@query("function_body_lines_parts", PROGRAMS_SQL + "\nSELECT doc_id, line_no, line, is_instruction FROM counted")
def function_body_lines_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = staged(text_parts(programs(spark, sf_dir), part_chars=PART), "parts")
    return body_lines_of_parts(parts)
