"""File corpora derived from the benchmark tables, in Spark and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from findery.config import STOPWORDS, Ranking, Rules
from findery.functions import text as T
from findery.operators.records import to_records
from findery.schema import STATUS_REVIEW

INDEXED_AT = "2024-01-01T00:00:00+00:00"
#: Brands 1 to 20 are known projects; the other five leave records pending.
PROJECT_NUMBERS = tuple(range(1, 21))
TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
DEPARTMENTS = {"Mechanical": ["bolt|gear|rod|ring"], "Electrical": ["widget|gizmo"]}

PART_RULES = Rules(
    doc_type={t: [rf"\b{t.lower()}\b"] for t in TYPES},
    project_name={f"Brand {n}": [rf"\bbrand\s*{n}\b"] for n in PROJECT_NUMBERS},
    department=DEPARTMENTS,
)
RANKING = Ranking()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a table that one task gets, about.
TASK_ROWS = 20_000
#: Tasks to which a reader deals rows at most. To more than 200 (``spark.shuffle.sort.bypassMergeThreshold``) Spark deals by sorting, and a reader holds all its rows.
READER_TASKS = 200


def tasks_of(rows: DataFrame) -> int:
    return -(-rows.count() // TASK_ROWS)


def spread(rows: DataFrame, key: str | Column, tasks: int | None = None) -> DataFrame:
    """``rows`` dealt by ``key`` over tasks of about ``TASK_ROWS`` rows.

    A small file holds very many rows and is read by one task, which would parse them all and hold all their postings.
    """
    tasks = tasks or tasks_of(rows)
    return rows if tasks < 2 else rows.repartition(tasks, key)


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per part: brand and type folders, and a name with part, tag and year.

    They are dealt by the id of their record, so what is grouped by it stays in tasks of that size without another shuffle.
    """
    key = F.col("p_partkey")
    ext = F.element_at(F.array(*(F.lit(e) for e in (".pdf", ".docx", ".jpg", ""))), (key % 4 + 1).cast("int"))
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_P-"), F.lpad((key % 10000).cast("string"), 4, "0"), F.lit("_"), (F.lit(1950) + F.col("p_size")).cast("string"), ext)
    parts = table(spark, sf_dir, "part")
    tasks = tasks_of(parts)
    if tasks > READER_TASKS:
        # one file may have a single reader; its rows are dealt to few tasks first, which deal their shares on
        parts = parts.repartition(READER_TASKS, key)
    files = parts.select(key, F.concat_ws("/", F.replace("p_brand", F.lit("#"), F.lit("_")), "p_type", name).alias("file_path"))
    return spread(files, T.doc_id(F.col("file_path")), tasks)


def part_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the part files; every eleventh is under review, and index dates vary by part."""
    made = to_records(part_files(spark, sf_dir).select("file_path"), PART_RULES, INDEXED_AT)
    number = F.regexp_extract("file_path", r"_P-([0-9]{4})_", 1).cast("int")
    status = F.when(number % 11 == 0, STATUS_REVIEW).otherwise(F.col("extraction_status"))
    return made.withColumns({"extraction_status": status, "indexed_at": F.format_string("2024-01-%02dT00:00:00+00:00", number % 28 + 1)})


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per document below language and source folders, with its text."""
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source", name).alias("file_path"), "text")


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page addresses as paths: no scheme, query or fragment."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "").alias("file_path"))


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry per event: the user's part was searched by its tag; purchases were right, errors chose nothing."""
    files = part_files(spark, sf_dir).select(F.col("p_partkey").alias("user_id"), F.substring(F.sha1(F.col("file_path").cast("binary")), 1, 12).alias("doc_id"))
    tag = F.concat(F.lit("P-"), F.lpad((F.col("user_id") % 10000).cast("string"), 4, "0"))
    joined = table(spark, sf_dir, "events").join(files, "user_id", "left")
    return joined.select("ts", tag.alias("query"), F.when(F.col("event_type") != "error", F.col("doc_id")).alias("chosen_doc_id"), (F.col("event_type") == "purchase").alias("correct"))


# ---- the same in DuckDB SQL ----

STOP_SQL = ", ".join(f"'{w}'" for w in STOPWORDS)


def tokens_sql(text: str) -> str:
    return f"list_filter(list_transform(string_split_regex({text}, '[^a-zA-Z0-9&]+'), lambda t: lower(t)), lambda t: length(t) > 1 AND t NOT IN ({STOP_SQL}))"


def meta_sql(text: str) -> str:
    """Select list of the six fields from an expression that holds the text."""
    plain = f"replace({text}, '_', ' ')"
    projects = " ".join(f"WHEN regexp_matches({plain}, '(?i)\\bbrand\\s*{n}\\b') THEN 'Brand {n}'" for n in PROJECT_NUMBERS)
    types = " ".join(f"WHEN regexp_matches({plain}, '(?i)\\b{t.lower()}\\b') THEN '{t}'" for t in TYPES)
    return (
        f"CASE {projects} END AS project_name, CASE {types} END AS doc_type, "
        f"CASE WHEN regexp_matches({plain}, '(?i)bolt|gear|rod|ring') THEN 'Mechanical' WHEN regexp_matches({plain}, '(?i)widget|gizmo') THEN 'Electrical' END AS department, "
        f"upper(nullif(regexp_extract({plain}, '(?i)\\b[A-Z]{{1,4}}-\\d{{2,4}}[A-Z]?\\b'), '')) AS equipment_tag, "
        f"TRY_CAST(nullif(regexp_extract({plain}, '\\b(19|20)\\d{{2}}\\b'), '') AS INTEGER) AS year, {tokens_sql(text)} AS keywords"
    )


PART_CTE = f"""
pf AS (
  SELECT p_partkey, replace(p_brand, '#', '_') AS brand, p_type,
    replace(p_name, ' ', '_') || '_P-' || lpad(CAST(p_partkey % 10000 AS VARCHAR), 4, '0') || '_' || CAST(1950 + p_size AS VARCHAR) AS stem,
    CASE p_partkey % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.docx' WHEN 2 THEN '.jpg' ELSE '' END AS file_ext
  FROM part),
pt AS (SELECT *, brand || '/' || p_type || '/' || stem || file_ext AS file_path, stem || ' / ' || brand || ' / ' || p_type AS txt FROM pf),
pm AS (SELECT p_partkey, file_path, stem || file_ext AS file_name, file_ext, {meta_sql('txt')} FROM pt),
rec AS (
  SELECT substr(sha1(file_path), 1, 12) AS doc_id, *,
    CASE WHEN project_name IS NULL OR doc_type IS NULL THEN 'pending_deep_scan' ELSE 'ok' END AS status,
    CASE WHEN p_partkey % 10000 % 11 = 0 THEN 'needs_review' WHEN project_name IS NULL OR doc_type IS NULL THEN 'pending_deep_scan' ELSE 'ok' END AS extraction_status,
    '2024-01-' || lpad(CAST(p_partkey % 10000 % 28 + 1 AS VARCHAR), 2, '0') || 'T00:00:00+00:00' AS indexed_at
  FROM pm)"""
