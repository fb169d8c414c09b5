"""Scans: CSV and JSON with declared schemas, tolerant column pruning, multi-part unions, fingerprints."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

CSV = {"header": True, "multiLine": True, "escape": '"', "encoding": "UTF-8"}


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, text_only: bool = False) -> DataFrame:
    """CSV with quoted line breaks and a byte-order mark; all columns text, or by schema, or inferred."""
    reader = spark.read.options(**CSV)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.csv(path, inferSchema=not text_only)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that names the missing columns; no job is run."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def available(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly these columns in this order; a missing one is blank."""
    return df.select([F.col(c) if c in df.columns else F.lit("").alias(c) for c in columns])


def schema_difference(df: DataFrame, expected: list[str]) -> dict[str, list[str] | bool]:
    return {"missing": [c for c in expected if c not in df.columns], "extra": [c for c in df.columns if c not in expected], "in_order": [c for c in df.columns if c in expected] == [c for c in expected if c in df.columns]}


def with_text(df: DataFrame, keep: list[str], first: str, second: str) -> DataFrame:
    """The first text column where it is not blank, else the second."""
    df = available(require(df, keep), [*keep, first, second])
    return df.withColumn("text", F.coalesce(F.nullif(F.trim(F.coalesce(F.col(first), F.lit(""))), F.lit("")), F.col(second)))


def parts_union(parts: list[DataFrame]) -> DataFrame:
    """Parts on end, each row with its part's number."""
    return reduce(DataFrame.unionByName, (p.select(F.lit(i + 1).alias("part"), "*") for i, p in enumerate(parts)))


def read_parts(spark: SparkSession, pattern: str, schema: StructType | str) -> DataFrame:
    """All files of a glob with the number in each file's name as part."""
    df = spark.read.options(**CSV).schema(schema).csv(pattern)
    name = F.col("_metadata.file_name")
    return df.withColumn("part", F.regexp_extract(name, "([0-9]+)[^0-9]*$", 1).try_cast("int"))


def read_experiments(spark: SparkSession, paths: list[str], multi_line: bool = True) -> DataFrame:
    """(tag, label, f1) from JSON result documents, one a file or one a line; a document without a tag has
    its file name."""
    docs = spark.read.schema("tag string, f1_per_label map<string,double>").json(paths, multiLine=multi_line)
    tag = F.coalesce("tag", F.regexp_extract(F.col("_metadata.file_name"), "^(.*?)(\\.json)?$", 1))
    return docs.select(tag.alias("tag"), F.explode("f1_per_label").alias("label", "f1"))


def fingerprints(spark: SparkSession, folder: str, first_bytes: int = 4 << 20) -> DataFrame:
    """(path, length, sha1) of the files of a folder, over their first bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    name = F.regexp_replace("path", "^.*/(?=[^/]+\\.parquet)", "")
    return files.select(name.alias("file_name"), "length", F.sha1(F.substring("content", 1, first_bytes)).alias("sha1"))
