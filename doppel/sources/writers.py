"""Write tables: csv, json or parquet folders, linked sets, and SQL statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doppel.functions.columns import col


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """One folder of csv (with header), json lines or parquet; each task writes its own part."""
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt == "json":
        writer.option("ignoreNullFields", False).json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def sql_type(kind: T.DataType) -> str:
    if isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "REAL"
    return "INTEGER" if isinstance(kind, T.IntegralType) else "TEXT"


def create_table(df: DataFrame, name: str, primary_key: str | None = None, references: dict[str, str] | None = None) -> str:
    """CREATE TABLE text; `references` maps a column to table.column."""
    links = references or {}
    lines = []
    for f in df.schema.fields:
        kind = "INTEGER PRIMARY KEY" if f.name == primary_key else "INTEGER" if f.name in links else sql_type(f.dataType)
        lines.append(f"  {f.name} {kind}")
    for column, target in links.items():
        if "." in target:
            table, key = target.split(".", 1)
            lines.append(f"  FOREIGN KEY ({column}) REFERENCES {table}({key})")
    return f"CREATE TABLE {name} (\n" + ",\n".join(lines) + "\n);"


def _literal(f: T.StructField) -> Column:
    c = col(f.name)
    if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
        # Two decimals without a trailing zero: 5.25, 5.2, 5.0.
        text = F.regexp_replace(F.bround(c.cast("decimal(38,6)"), 2).cast("decimal(36,2)").cast("string"), "0$", "")
    elif isinstance(f.dataType, T.IntegralType):
        text = c.cast("string")
    else:
        text = F.concat(F.lit("'"), F.replace(c.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    missing = F.isnan(c) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.lit(False)
    return F.when(c.isNull() | missing, F.lit("NULL")).otherwise(text)


def insert_statements(df: DataFrame, name: str) -> DataFrame:
    """One INSERT text per row, in column `statement`."""
    values = F.concat_ws(", ", *[_literal(f) for f in df.schema.fields])
    return df.select(F.concat(F.lit(f"INSERT INTO {name} ({', '.join(df.columns)}) VALUES ("), values, F.lit(");")).alias("statement"))


def template_links(template: dict | None) -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """Primary keys and references by table of a relational template."""
    keys, links = {}, {}
    for t in (template or {}).get("tables", []):
        keys[t["name"]] = t.get("primary_key", f"{t['name']}_id")
        links[t["name"]] = {c["name"]: c["references"] for c in t["columns"] if c.get("type") == "fk" and "references" in c}
    return keys, links


def write_sql(tables: dict[str, DataFrame], path: str, template: dict | None = None) -> None:
    """<path>/schema: the CREATE statements in order; <path>/<table>: its INSERT statements, one per line."""
    keys, links = template_links(template)
    spark = next(iter(tables.values())).sparkSession
    ddl = [create_table(df, name, keys.get(name), links.get(name)) for name, df in tables.items()]
    spark.createDataFrame([("\n\n".join(ddl),)], "statement string").coalesce(1).write.text(f"{path}/schema")
    for name, df in tables.items():
        insert_statements(df, name).write.text(f"{path}/{name}")


def write_relational(tables: dict[str, DataFrame], path: str, fmt: str = "csv", include_sql: bool = True,
                     template: dict | None = None) -> None:
    """One folder per table and, if wanted, the SQL statements under <path>/sql."""
    for name, df in tables.items():
        write_table(df, f"{path}/{name}", fmt)
    if include_sql:
        write_sql(tables, f"{path}/sql", template)
