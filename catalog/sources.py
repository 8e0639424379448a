"""Readers, writers and table shaping; files are written under the shared checkpoint folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.common import s, table, u
from catalog.generate import LINE_IDS
from doppel.checkpoint import checkpoint_dir
from doppel.operators import shaping
from doppel.sources import readers, writers


def folder(spark) -> str:
    return f"{checkpoint_dir(spark)}/files-{uuid.uuid4().hex}"


def nation(spark, d):
    return table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")


def csv_copy(spark, d):
    path = folder(spark)
    writers.write_table(table(spark, d, "customer"), path, "csv")
    out = readers.read_csv(spark, path)
    return out.select(F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("bigint"), F.col("c_acctbal").cast("double"), "c_mktsegment")


def delimited_copy(spark, d):
    path = folder(spark)
    table(spark, d, "supplier").write.option("header", True).option("sep", "|").csv(path)
    out = readers.read_delimited(spark, path)
    return out.select(F.col("s_suppkey").cast("bigint"), "s_name", F.col("s_nationkey").cast("bigint"), F.col("s_acctbal").cast("double"))


def latin_copy(spark, d):
    """Conversations written in ISO-8859-1 where every character has one, and read back without naming it."""
    path = folder(spark)
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.regexp_replace("text", "[^\\x20-\\x7e\\xa0-\\xff]", " ").alias("text"))
    rows.write.option("header", True).option("encoding", "ISO-8859-1").option("escape", '"').csv(path)
    out = spark.read.options(header=True, encoding=readers.detect_encoding(spark, path), escape='"').schema(
        "conv_id bigint, turn bigint, text string").csv(path)
    return out.select("conv_id", "turn", F.length(F.trim("text")).cast("bigint").alias("chars"),
                      F.length(F.regexp_replace("text", "[^\\xa0-\\xff]", "")).cast("bigint").alias("accents"))


def json_copy(spark, d):
    """Nested customers as JSON lines, read back flat."""
    path = folder(spark)
    nested = table(spark, d, "customer").select("c_custkey", F.struct(
        F.col("c_name").alias("name"), F.struct(F.col("c_acctbal").alias("balance")).alias("account")).alias("who"))
    writers.write_table(nested, path, "json")
    out = readers.read_json_records(spark, path, lines=True)
    return out.select("c_custkey", F.col("`who.name`").alias("who_name"), F.col("`who.account.balance`").alias("who_account_balance"))


def json_wrapped(spark, d):
    """Rows wrapped in {"records": [...]} documents, a hundred rows to a document."""
    path = folder(spark)
    n = table(spark, d, "customer").select((F.col("c_custkey") / 100).cast("bigint").alias("doc"), F.struct("c_custkey", "c_mktsegment").alias("r"))
    n.groupBy("doc").agg(F.collect_list("r").alias("records")).select("records").write.json(path)
    return readers.read_json_records(spark, path, lines=True)


FILES_A_TASK = 50


def documents_of(rows, key, struct, before: str, after: str, path: str) -> None:
    """Text files of a JSON document each, over several lines, with the rows of 200 keys; about FILES_A_TASK of them by a task."""
    made = rows.withColumn("doc", F.floor(F.col(key) / 200)).groupBy("doc").agg(F.array_sort(F.collect_list(F.to_json(struct))).alias("r"))
    text = F.concat(F.lit(before), F.array_join("r", ",\n"), F.lit(after)).alias("value")
    made.select("doc", text).repartition(1 + rows.count() // (200 * FILES_A_TASK), "doc").write.partitionBy("doc").text(path)


def json_array(spark, d):
    """Files that are an array of objects with a nested object."""
    path = folder(spark)
    row = F.struct(F.col("c_custkey").alias("id"), F.struct("c_mktsegment", "c_nationkey").alias("at"))
    documents_of(table(spark, d, "customer"), "c_custkey", row, "[\n", "\n]", path)
    return readers.read_json_records(spark, path).select("id", F.col("`at.c_mktsegment`").alias("segment"), F.col("`at.c_nationkey`").alias("nation"))


def json_object(spark, d):
    """Files that are one object around the records."""
    path = folder(spark)
    row = F.struct("s_suppkey", "s_name", F.struct("s_nationkey").alias("home"))
    documents_of(table(spark, d, "supplier"), "s_suppkey", row, '{"status": "ok",\n"data": [\n', "\n]}", path)
    return readers.read_json_records(spark, path).select("s_suppkey", "s_name", F.col("`home.s_nationkey`").alias("nation"))


def json_column(spark, d):
    return readers.parse_json_column(table(spark, d, "events").select("event_id", "props"), "props", "k bigint").select(
        "event_id", F.col("`props.k`").alias("k"))


def tables_read(spark, d):
    found = readers.read_tables(spark, d, ["customer", "orders", "lineitem"], "parquet", ".parquet")
    out = None
    for name, df in found.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n", F.lit(len(df.columns)).cast("bigint").alias("columns"))
        out = row if out is None else out.unionByName(row)
    return out


def round_trip(spark, d):
    """Orders through csv, json and parquet; the three copies agree where one row is left per order."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    copies = None
    for fmt in ("csv", "json", "parquet"):
        path = folder(spark)
        writers.write_table(o, path, fmt)
        reader = spark.read.schema(o.schema)
        back = {"csv": lambda: reader.option("header", True).csv(path), "json": lambda: reader.json(path),
                "parquet": lambda: reader.parquet(path)}[fmt]()
        copies = back if copies is None else copies.unionByName(back)
    return copies.groupBy(*o.columns).agg(F.count(F.lit(1)).alias("copies"))


def relational_trip(spark, d):
    """Three tables and their SQL written out; rows per table in files and in INSERT statements."""
    path = folder(spark)
    tables = {"customers": table(spark, d, "customer"), "suppliers": table(spark, d, "supplier"), "parts": table(spark, d, "part")}
    writers.write_relational(tables, path)
    out = None
    for name in tables:
        files = readers.read_csv(spark, f"{path}/{name}", "UTF-8").agg(F.count(F.lit(1)).alias("rows")).withColumn("k", F.lit(1))
        sql = spark.read.text(f"{path}/sql/{name}").agg(F.count_if(F.col("value").startswith("INSERT INTO")).alias("inserts")).withColumn("k", F.lit(1))
        row = files.join(sql, "k").select(F.lit(name).alias("table_name"), "rows", "inserts")
        out = row if out is None else out.unionByName(row)
    return out


def inserts(spark, d):
    odd = table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("'s")).alias("name"),
        F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("size"), (F.col("p_retailprice") / 4).alias("price"))
    return writers.insert_statements(odd, "parts")


INSERT_SQL = """select 'INSERT INTO parts (id, name, size, price) VALUES (' || p_partkey || ', ''' || replace(p_name, '''', '''''')
    || '''''s'', ' || case when p_size % 5 <> 0 then p_size::varchar else 'NULL' end || ', ' ||
    regexp_replace((cents // 100)::varchar || '.' || lpad((cents % 100)::varchar, 2, '0'), '0$', '') || ');' as statement
    from (select *, q // 10000 + case when q % 10000 > 5000 or (q % 10000 = 5000 and (q // 10000) % 2 = 1) then 1 else 0 end as cents
          from (select *, round((p_retailprice / 4) * 1000000)::bigint as q from part))"""


def capped(spark, d):
    return shaping.cap_sample(table(spark, d, "lineitem").select(*LINE_IDS, "l_quantity", "l_shipdate"), LINE_IDS, max_columns=5).withColumn(
        "l_linenumber", F.col("l_linenumber").cast("bigint"))


QUERIES = {
    "read_csv": csv_copy,
    "read_delimited": delimited_copy,
    "read_encoding": latin_copy,
    "read_json_records": json_copy,
    "read_json_wrapped": json_wrapped,
    "read_json_array": json_array,
    "read_json_object": json_object,
    "parse_json_column": json_column,
    "read_tables": tables_read,
    "write_table": round_trip,
    "write_relational": relational_trip,
    "to_sql_statements": inserts,
    "cap_sample": capped,
    "preview": lambda sp, d: shaping.preview(table(sp, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), ["o_orderkey"], 500),
    "search_rows": lambda sp, d: shaping.search_rows(
        table(sp, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), " MACH "),
    "page_rows": lambda sp, d: shaping.page_rows(
        table(sp, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey"], 3, 25, "build"),
}

ORACLES = {
    "read_csv": "select c_custkey, c_name, c_nationkey::bigint as c_nationkey, c_acctbal, c_mktsegment from customer",
    "read_delimited": "select s_suppkey, s_name, s_nationkey::bigint as s_nationkey, s_acctbal from supplier",
    "read_encoding": r"""select conv_id, turn, length(trim(t, ' ')) as chars, length(regexp_replace(t, '[^\x{a0}-\x{ff}]', '', 'g')) as accents
        from (select conv_id, turn, regexp_replace(text, '[^\x20-\x7e\x{a0}-\x{ff}]', ' ', 'g') as t from conversations)""",
    "read_json_records": "select c_custkey, c_name as who_name, c_acctbal as who_account_balance from customer",
    "read_json_wrapped": "select c_custkey, c_mktsegment from customer",
    "read_json_array": "select c_custkey as id, c_mktsegment as segment, c_nationkey::bigint as nation from customer",
    "read_json_object": "select s_suppkey, s_name, s_nationkey::bigint as nation from supplier",
    "parse_json_column": "select event_id, (props::json->>'k')::bigint as k from events",
    "read_tables": "select 'customer' as table_name, count(*) as n, 5::bigint as columns from customer union all "
                   "select 'orders', count(*), 6 from orders union all select 'lineitem', count(*), 11 from lineitem",
    "write_table": "select o_orderkey, o_orderstatus, o_totalprice, 3::bigint as copies from orders",
    "write_relational": " union all ".join(f'select {s(n)} as table_name, count(*) as "rows", count(*) as inserts from {t}'
                                           for n, t in (("customers", "customer"), ("suppliers", "supplier"), ("parts", "part"))),
    "to_sql_statements": INSERT_SQL,
    "cap_sample": f"""select l_orderkey, l_partkey, l_suppkey, l_linenumber::bigint as l_linenumber, l_quantity from lineitem
        order by {u('cap', *LINE_IDS)}, l_orderkey, l_partkey, l_suppkey, l_linenumber limit 50000""",
    "preview": "select o_orderkey, o_custkey, o_totalprice from orders order by o_orderkey limit 500",
    "search_rows": "select c_custkey, c_name, c_acctbal, c_mktsegment from customer where contains(lower(c_name), 'mach') "
                   "or contains(lower(c_mktsegment), 'mach') or contains(c_custkey::varchar, 'mach') or contains(c_acctbal::varchar, 'mach')",
    "page_rows": "select c_custkey, c_name, c_mktsegment from customer where contains(lower(c_name), 'build') "
                 "or contains(lower(c_mktsegment), 'build') order by c_custkey limit 25 offset "
                 "(select (least(3, greatest(1, ceil(count(*) / 25.0)))::bigint - 1) * 25 from customer where contains(lower(c_mktsegment), 'build'))",
}
