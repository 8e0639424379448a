"""Read tables from files: delimited text, JSON records, and sets of linked tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doppel.functions.columns import quoted

# Encodings by order of trial, separators, wrapper keys of JSON documents.
ENCODINGS = ("UTF-8", "ISO-8859-1")
SEPARATORS = [",", ";", "\t", "|"]
TAB_EXTENSIONS = (".tsv", ".tab")
RECORD_KEYS = ["data", "records", "items", "rows", "results"]


def detect_encoding(spark: SparkSession, path: str) -> str:
    """UTF-8 unless some line does not decode; every byte is a character of ISO-8859-1."""
    broken = spark.read.text(path).filter("not is_valid_utf8(value)").limit(1).count()
    return ENCODINGS[1] if broken else ENCODINGS[0]


def detect_separator(spark: SparkSession, path: str) -> str:
    """The separator that occurs most often in the first line; a comma when none does."""
    if path.rstrip("/").lower().endswith(TAB_EXTENSIONS):
        return "\t"
    first = spark.read.text(path).head(1)
    line = first[0]["value"] if first else ""
    return max(SEPARATORS, key=line.count)


def read_delimited(spark: SparkSession, path: str, sep: str | None = None, encoding: str | None = None,
                   schema: T.StructType | str | None = None) -> DataFrame:
    """Delimited text with a header.

    Separator, encoding and types are found out from the data where they are not
    given; on large inputs give all three, since each is a pass over the files.
    """
    options = {"header": True, "sep": sep or detect_separator(spark, path), "encoding": encoding or detect_encoding(spark, path)}
    reader = spark.read.options(**options)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, schema: T.StructType | str | None = None) -> DataFrame:
    return read_delimited(spark, path, ",", encoding, schema)


def flatten(df: DataFrame) -> DataFrame:
    """Nested struct fields as columns named by their path: a.b."""
    def leaves(fields, names: list[str]):
        for f in fields:
            path = [*names, f.name]
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType.fields, path)
            else:
                yield F.col(".".join(quoted(p) for p in path)).alias(".".join(path))

    return df.select(*leaves(df.schema.fields, []))


def records_of(df: DataFrame) -> DataFrame:
    """The rows inside a document of the form {"data": [...]}, or the frame itself."""
    for key in RECORD_KEYS:
        if key in df.columns and isinstance(df.schema[key].dataType, T.ArrayType):
            inner = df.select(F.explode(F.col(quoted(key))).alias("_r"))
            return inner.select("_r.*") if isinstance(inner.schema["_r"].dataType, T.StructType) else inner.withColumnRenamed("_r", key)
    return df


def read_json_records(spark: SparkSession, path: str, lines: bool = False, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON as a flat table: an array, an object that wraps one, or one object per file.

    A document that spans lines is read by one task per file. Large inputs
    should be one record per line: pass `lines`.
    """
    reader = spark.read.option("multiLine", not lines)
    if schema is None and not lines:
        # Spark finds the schema of many small files in one task; their texts lie in tasks of a few files each.
        found = spark.read.json(spark.read.text(path, wholetext=True).select("value").rdd.map(lambda r: r[0])).schema
        # Broken documents and those in another encoding are left to Spark.
        schema = None if spark.conf.get("spark.sql.columnNameOfCorruptRecord") in found.names else found
    df = reader.schema(schema).json(path) if schema is not None else reader.json(path)
    return flatten(records_of(df))


def parse_json_column(df: DataFrame, name: str, schema: str) -> DataFrame:
    """A column of JSON texts as flat columns beside the others."""
    parsed = df.withColumn(name, F.from_json(name, schema))
    return flatten(parsed)


def read_tables(spark: SparkSession, folder: str, names: list[str], fmt: str = "parquet", suffix: str = "",
                schemas: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Linked tables, each a file or folder named <name><suffix>."""
    found = {}
    for name in names:
        path, schema = f"{folder}/{name}{suffix}", (schemas or {}).get(name)
        if fmt == "csv":
            found[name] = read_csv(spark, path, schema=schema)
        elif fmt == "json":
            found[name] = read_json_records(spark, path, lines=True, schema=schema)
        else:
            found[name] = spark.read.parquet(path)
    return found
