"""TSV sources and sinks: entity tables, ground truth, candidate and profile files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip

ENTITY = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"
REQUIRED = ["entity_id", "business_name", "business_address", "country"]
#: Sink schemas of the planned result files (fixed values).
CANDIDATE_FILE = ["item_id_1", "item_id_2", "blocking_key"]
MATCH_FILE = ["item_id_1", "item_id_2", "match_score", "is_match"]


def has_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether some quoted field goes on in the next line: then some line has an odd number of quotes."""
    lines = spark.read.text(path)
    return not lines.where(F.length(F.regexp_replace("value", '[^"]', "")) % 2 == 1).isEmpty()


def read_tsv(spark: SparkSession, path: str, schema: str = ENTITY, multi_line: bool | None = None) -> DataFrame:
    """A TSV with header; everything is text, ``NA`` too, and empty fields are empty text.

    ``multi_line`` allows line breaks in quoted fields, but each file is then one
    task; by default it holds only for files in which such a field is found, and
    others are split among tasks.
    """
    multi_line = has_line_breaks(spark, path) if multi_line is None else multi_line
    rows = spark.read.schema(schema).csv(
        path, sep="\t", header=True, quote='"', escape='"', multiLine=multi_line, nullValue="", emptyValue="", enforceSchema=False,
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )
    return rows.na.fill("")


def validate_columns(df: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """``df`` itself, or ValueError with the sorted list of missing columns."""
    if lacking := sorted(set(required) - set(df.columns)):
        raise ValueError(f"missing columns: {lacking}")
    return df


def targets(c: Column) -> Column:
    """Ids of a comma list: trimmed, without empty and repeated ones."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: strip(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def _as_read(raw: DataFrame) -> Column:
    """An order of rows: by file and place in it, where ``raw`` is read from files."""
    at = F.monotonically_increasing_id()
    try:
        place = F.struct("_metadata.file_path", "_metadata.file_block_start", at)
        raw.select(place)
    except AnalysisException:
        return at
    return place


def load_truth(raw: DataFrame, order: str | None = None) -> DataFrame:
    """(s1, targets) of a truth table; of rows with one s1 the last in ``order`` holds
    (default: the order of reading, files by name).  Entities without targets stay."""
    at = F.col(order) if order else _as_read(raw)
    rows = raw.select(F.col("source1_entity_id").alias("s1"), targets(F.col("matched_entity_ids")).alias("targets"), at.alias("at"))
    return rows.groupBy("s1").agg(F.max_by("targets", "at").alias("targets"))


def load_truth_lists(raw: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``load_truth`` as (s1, list) and (list, targets): a list that many entities have is read once and moved once."""
    at = F.col(order) if order else _as_read(raw)
    text = F.coalesce(F.col("matched_entity_ids"), F.lit(""))
    named = raw.select(F.col("source1_entity_id").alias("s1"), text.alias("ids"), F.sha2(text, 256).alias("list"), at.alias("at"))
    members = named.groupBy("s1").agg(F.max_by("list", "at").alias("list"))
    return members, named.select("list", "ids").distinct().select("list", targets(F.col("ids")).alias("targets"))


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.csv(path, sep="\t", header=True, mode="overwrite")


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Entities of in-memory rows; absent values are empty."""
    return spark.createDataFrame([tuple(r.get(c) for c in REQUIRED) for r in rows], ENTITY).na.fill("")


def write_candidates(keyed: DataFrame, path: str) -> None:
    """The candidate file: item_id_1, item_id_2, blocking_key of (s1, candidate, family)."""
    write_tsv(keyed.select(*[F.col(c).alias(n) for c, n in zip(("s1", "candidate", "family"), CANDIDATE_FILE)]), path)


def write_matches(scored: DataFrame, path: str) -> None:
    """The match file, from a table with its columns."""
    write_tsv(scored.select(*MATCH_FILE), path)


def write_profile_csv(df: DataFrame, path: str) -> None:
    """One CSV file: a profile has a row per family."""
    df.coalesce(1).write.csv(path, header=True, mode="overwrite")
