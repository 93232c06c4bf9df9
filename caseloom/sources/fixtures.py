"""Record sources and sinks (SRC-1 to SRC-8, SNK-1 to SNK-3): JSON fixtures, keyword and point lookups, the chunk index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import strip
from ..operators.keyword import first_matches
from ..schemas import FIXTURE


def read_fixture(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """SRC-1: (search rows with their ordinal, judgment details) of a fixture file."""
    raw = spark.read.schema(FIXTURE).json(path, multiLine=True)
    return raw.select(F.posexplode("search_results").alias("ordinal", "r")).select("ordinal", "r.*"), raw.select(F.explode("judgment_details").alias("key", "r")).select("r.*")


def keyword_search(rows: DataFrame, queries: DataFrame, *, limit: int = 10, query_id: str = "query_id", first_rows: int = 10_000) -> DataFrame:
    """SRC-2 for any number of queries (query_id, query): rows (ordinal, title, snippet, ...) whose title or snippet has the whole query, in any
    case; all rows if none has; then the first ``limit`` by their ordinal, as (query_id, rank, columns of rows).

    Queries that ask the same are searched for once, by an index of character grams (``operators.keyword``). A null query is empty.
    """
    asked = queries.select(query_id, F.lower(F.coalesce("query", F.lit(""))).alias("query"))
    return asked.join(first_matches(rows, asked, limit=limit, first_rows=first_rows), "query").select(query_id, "rank", *rows.columns)


def lookup(details: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """SRC-3: asked ids with their record; found is false where there is none."""
    return doc_ids.join(details.withColumn("found", F.lit(True)), "doc_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def write_index(index: DataFrame, path: str, *, mode: str = "append") -> None:
    """SNK-1: chunks with vectors as Parquet; an addition is new files only."""
    index.write.mode(mode).parquet(path)


def read_index(spark: SparkSession, path: str, dimension: int | None = None) -> DataFrame:
    """SRC-6: the index; vectors of another dimension are left out."""
    index = spark.read.parquet(path)
    return index if dimension is None else index.filter(F.size("embedding") == dimension)


def to_json(df: DataFrame) -> DataFrame:
    """SNK-2, SNK-3: one JSON document per row."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def parse_requests(bodies: DataFrame, schema, column: str = "body") -> DataFrame:
    """SRC-7: JSON request bodies to typed columns; unknown fields are dropped, bad JSON gives NULLs."""
    return bodies.withColumn("_r", F.from_json(column, schema)).select(*bodies.columns, "_r.*")


def listed(value: Column) -> Column:
    """SRC-8: a comma list, trimmed, without empty parts."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ",", -1), strip), lambda x: x != "")


def allowed_origins(value: Column, environment: Column) -> Column:
    """SRC-8: * means all in development and none in production."""
    star = strip(value) == "*"
    return F.when(star & (environment == "production"), F.array().cast("array<string>")).when(star, F.array(F.lit("*"))).otherwise(listed(value))


def engine_status(spark: SparkSession) -> DataFrame:
    """SRC-11: one row per module."""
    modules = ("precedent", "facts", "graph", "simulation")
    return spark.createDataFrame([(m, "ok", spark.version) for m in modules], "module string, status string, spark_version string")
