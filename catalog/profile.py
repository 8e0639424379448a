"""Profiling of the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.common import LINE_COLUMNS, LINE_TYPES, rnd, s, table
from doppel.functions import domains
from doppel.operators import profile

NUM, INT, STR, TIME = "float", "int", "str", "time"
# The columns the type query covers, by physical kind.
COLUMNS = {
    "region": {"r_regionkey": INT, "r_name": STR},
    "nation": {"n_nationkey": INT, "n_name": STR, "n_regionkey": INT},
    "customer": {"c_custkey": INT, "c_name": STR, "c_nationkey": INT, "c_acctbal": NUM, "c_mktsegment": STR},
    "supplier": {"s_suppkey": INT, "s_name": STR, "s_nationkey": INT, "s_acctbal": NUM},
    "part": {"p_partkey": INT, "p_name": STR, "p_brand": STR, "p_type": STR, "p_size": INT, "p_retailprice": NUM},
    "orders": {"o_orderkey": INT, "o_custkey": INT, "o_orderstatus": STR, "o_totalprice": NUM, "o_orderdate": TIME,
               "o_orderpriority": STR},
    "lineitem": {"l_orderkey": INT, "l_partkey": INT, "l_suppkey": INT, "l_linenumber": INT, "l_quantity": NUM,
                 "l_extendedprice": NUM, "l_discount": NUM, "l_tax": NUM, "l_returnflag": STR, "l_linestatus": STR,
                 "l_shipdate": TIME},
    "events": {"event_id": INT, "ts": TIME, "user_id": INT, "event_type": STR, "value": NUM, "props": STR},
    "documents": {"doc_id": INT, "text": STR, "lang": STR, "source": STR, "n_chars": INT},
    "labels": {"doc_id": INT, "quality": INT, "toxic": INT},
    "pages": {"page_id": INT, "url": STR, "html": STR},
    "benchmark": {"item_id": INT, "text": STR},
    "conversations": {"conv_id": INT, "turn": INT, "role": STR, "text": STR},
}
WORD_GAP = "[\\t-\\r\\x1c- \\x85\\p{Z}]+"


def types(spark, d):
    parts = [
        profile.types_table(spark, profile.detect_types(table(spark, d, t).select(*cols)))
        .select(F.lit(t).alias("table_name"), "column_name", "type")
        for t, cols in COLUMNS.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _time_text(c: str) -> str:
    formats = "['%m/%d/%Y', '%d/%m/%Y', '%d.%m.%Y', '%Y/%m/%d', '%d-%m-%Y']"
    return f"(case when length({c}) <= 40 then coalesce(try_cast({c} as timestamp), try_strptime({c}, {formats})) end)"


def type_sql(src: str, c: str, kind: str) -> str:
    """One row `type` for a column of a table."""
    lower = c.lower()
    for hint in ("email", "name", "phone", "address"):
        if lower in profile.HINTS[hint]:
            return f"select '{hint}' as type"
    few = f"(count(distinct {c}) <= 50 or count(distinct {c}) / count({c}) < 0.05)"
    if kind == TIME:
        return "select 'datetime' as type"
    if kind == NUM:
        return "select 'float' as type"
    if kind == INT:
        return f"select case when {few} then 'categorical' else 'integer' end as type from {src}"

    def share(test):
        return f"count(*) filter ({test}) / count({c}) > 0.8"

    words = (f"avg(len(list_filter(regexp_split_to_array(left({c}, 400), '{WORD_GAP}'), lambda w: w <> '')))")
    phone = "" if lower in profile.NOT_PHONE else (
        f"when {share(f'regexp_matches({c}, {s(profile.PHONE)})')} then 'phone' ")
    return (f"select case when count({c}) = 0 then 'text' "
            f"when {share(f'regexp_matches({c}, {s(profile.UUID)})')} then 'uuid' "
            f"when {share(f'regexp_matches({c}, {s(profile.EMAIL)})')} then 'email' "
            f"when {share(f'{_time_text(c)} is not null')} then 'datetime' {phone}"
            f"when count(distinct {c}) <= 50 or (count({c}) > 20 and count(distinct {c}) / count({c}) < 0.05) "
            f"then 'categorical' when avg(length({c})) < 25 and {words} between 1.5 and 3.5 then 'name' "
            f"else 'text' end as type from {src}")


TYPES_SQL = " union all ".join(
    f"select {s(t)} as table_name, {s(c)} as column_name, type from ({type_sql(t, c, k)})"
    for t, cols in COLUMNS.items() for c, k in cols.items())

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def flagged(spark, d):
    """orders with some values taken out, so that null counts are not all zero."""
    orders = table(spark, d, "orders")
    return orders.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("o_custkey"), "o_orderstatus",
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")).alias("o_totalprice"), "o_orderdate",
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("o_orderpriority"),
    )


FLAGGED_SQL = """(select o_orderkey, case when o_orderkey % 7 <> 0 then o_custkey end as o_custkey, o_orderstatus,
    case when o_orderkey % 11 <> 0 then o_totalprice end as o_totalprice, o_orderdate,
    case when o_orderkey % 3 <> 0 then o_orderpriority end as o_orderpriority from orders)"""


def nulls_sql(src: str, columns: list[str]) -> str:
    return " union all ".join(
        f"select {s(c)} as column_name, count(*) - count({c}) as null_count, "
        f"{rnd(f'(count(*) - count({c})) / count(*)', 4)} as null_rate, count(*) as total_count, "
        f"count(distinct {c}) as unique_count from {src}" for c in columns)


def numbers_sql(src: str, columns: list[str]) -> str:
    return " union all ".join(
        f"select {s(c)} as column_name, min({c})::double as min, max({c})::double as max, "
        f"{rnd(f'avg({c})', 4)} as mean, {rnd(f'coalesce(stddev_samp({c}), 0)', 4)} as std from {src}" for c in columns)


def shares_sql(src: str, columns: list[str]) -> str:
    return " union all ".join(
        f"(select {s(c)} as column_name, {c}::varchar as category, count(*) as n, "
        f"{rnd(f'count(*) / sum(count(*)) over ()', 4)} as share, "
        f"row_number() over (order by count(*) desc, {c}::varchar) as rank from {src} where {c} is not null "
        f"group by {c} qualify rank <= 50)" for c in columns)


def flat_profile(spark, d):
    """profile_table of customer with the category map as text."""
    out = profile.profile_table(table(spark, d, "customer"))
    entries = F.expr("array_join(array_sort(transform(map_entries(categories), "
                     "e -> concat(e.key, '=', format_number(e.value, 4)))), ';')")
    return out.withColumn("categories", entries)


def profile_sql() -> str:
    blank = {"min": "double", "max": "double", "mean": "double", "std": "double", "min_time": "varchar",
             "max_time": "varchar", "avg_length": "double", "min_length": "bigint", "max_length": "bigint",
             "categories": "varchar"}
    parts = []
    for c, kind in COLUMNS["customer"].items():
        given = {k: f"null::{t}" for k, t in blank.items()}
        numbers = {"min": f"min({c})::double", "max": f"max({c})::double", "mean": rnd(f"avg({c})", 4),
                   "std": rnd(f"coalesce(stddev_samp({c}), 0)", 4)}
        lengths = {"avg_length": rnd(f"avg(length({c}))", 1), "min_length": f"min(length({c}))",
                   "max_length": f"max(length({c}))"}
        cats = (f"(select string_agg(t, ';' order by t) from (select {c}::varchar || '=' || "
                f"format('{{:.4f}}', {rnd(f'count(*) / sum(count(*)) over ()', 4)}) as t from customer group by {c}))")
        by_type = {"integer": numbers, "float": numbers, "text": lengths, "categorical": {"categories": cats}}
        kind_sql = type_sql("customer", c, kind)
        fields = [f"case " + " ".join(f"when type = '{t}' then {m[k]}" for t, m in by_type.items() if k in m)
                  + f" else null end as {k}" for k in blank
                  if any(k in m for m in by_type.values())]
        fields += [f"{v} as {k}" for k, v in given.items() if not any(k in m for m in by_type.values())]
        if kind == STR:
            drop = {"min", "max", "mean", "std"}
        else:
            drop = {"avg_length", "min_length", "max_length"}
        fields = [f if f.split(" as ")[-1] not in drop else f"null::{blank[f.split(' as ')[-1]]} as {f.split(' as ')[-1]}"
                  for f in fields]
        parts.append(
            f"select {s(c)} as name, any_value(type) as type, count(*) - count({c}) as null_count, "
            f"{rnd(f'(count(*) - count({c})) / count(*)', 4)} as null_rate, count(*) as total_count, "
            f"count(distinct {c}) as unique_count, "
            + ", ".join(f.replace("when type =", "when any_value(type) =") for f in fields)
            + f" from customer, ({kind_sql})")
    return " union all ".join(parts)


def roles(spark, d):
    found = profile.modelling_roles(table(spark, d, "lineitem").select("l_orderkey", *LINE_COLUMNS, "l_suppkey"),
                                    {**LINE_TYPES, "l_orderkey": "id", "l_suppkey": "categorical"})
    return spark.createDataFrame(list(found.items()), "column_name string, role string")


def reclassified(spark, d):
    part = table(spark, d, "part").select("p_size", "p_type", F.col("p_retailprice").cast("string").alias("price_text"),
                                          F.col("p_size").cast("string").alias("size_text"))
    found = profile.reclassify_numeric_categories(part, {c: "categorical" for c in part.columns})
    return spark.createDataFrame(list(found.items()), "column_name string, type string")


def keyword_sql() -> str:
    cases = " ".join(
        "when " + " or ".join(f"contains(lower(text), {s(w)})" for w in words) + f" then {s(d)}"
        for d, words in domains.KEYWORDS)
    return f"case {cases} else {s(domains.DEFAULT)} end"


def described(spark, d):
    """A description per turn: its words, and for some turns the event types of a user."""
    hint = F.element_at(F.array(*[F.lit(w) for w in ["", " Patient list", " PAYMENT log", " staff", " course", " shop"]]),
                        (F.col("conv_id") % 6 + 1).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.concat("text", hint).alias("text"))


DESCRIBED_SQL = """(select conv_id, turn, text ||
    (['', ' Patient list', ' PAYMENT log', ' staff', ' course', ' shop'])[conv_id % 6 + 1] as text from conversations)"""

_SCHEMA_VALUES = ", ".join(f"({s(d)}, {i}, {s(c)}, {s(t)})" for d, i, c, t in domains.schema_rows())

QUERIES = {
    "detect_types": types,
    "profile_nulls": lambda sp, d: profile.null_profile(flagged(sp, d), ORDER_COLUMNS),
    "profile_numeric": lambda sp, d: profile.numeric_profile(
        table(sp, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
    "profile_categories": lambda sp, d: profile.top_categories(
        table(sp, d, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]).withColumn(
        "rank", F.col("rank").cast("bigint")),
    "profile_datetime": lambda sp, d: profile.datetime_profile(table(sp, d, "orders"), ["o_orderdate"]),
    "profile_text": lambda sp, d: profile.text_profile(table(sp, d, "documents"), ["text", "lang", "source"]),
    "profile_table": flat_profile,
    "classify_modelling_role": roles,
    "reclassify_numeric_categories": reclassified,
    "infer_domain": lambda sp, d: domains.inferred_schemas(described(sp, d), "text").select(
        "conv_id", "turn", "domain", F.col("position").cast("bigint").alias("position"), "column_name", "type"),
}

ORACLES = {
    "detect_types": TYPES_SQL,
    "profile_nulls": nulls_sql(FLAGGED_SQL, ORDER_COLUMNS),
    "profile_numeric": numbers_sql("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]),
    "profile_categories": shares_sql("lineitem", ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]),
    "profile_datetime": "select 'o_orderdate' as column_name, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') as min_time, "
                        "strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') as max_time from orders",
    "profile_text": " union all ".join(
        f"select {s(c)} as column_name, {rnd(f'avg(length({c}))', 1)} as avg_length, min(length({c})) as min_length, "
        f"max(length({c})) as max_length from documents" for c in ["text", "lang", "source"]),
    "profile_table": profile_sql(),
    "classify_modelling_role": " union all ".join(
        f"select {s(c)} as column_name, 'numeric' as role" for c, t in LINE_TYPES.items() if t != "categorical")
        + " union all " + " union all ".join(
        f"select {s(c)}, case when count(try_cast({c}::varchar as double)) = count({c}) and count(distinct {c}) > 10 "
        f"then 'numeric' else 'categorical' end from lineitem"
        for c in ["l_linenumber", "l_returnflag", "l_linestatus", "l_suppkey"]),
    "reclassify_numeric_categories": " union all ".join(
        f"select {s(n)} as column_name, case when count(try_cast({c}::varchar as double)) < count({c}) then 'categorical' "
        f"when count(*) filter (try_cast({c}::varchar as double) = floor(try_cast({c}::varchar as double))) = count({c}) "
        f"then 'integer' else 'float' end as type from part"
        for n, c in [("p_size", "p_size"), ("p_type", "p_type"), ("price_text", "p_retailprice"), ("size_text", "p_size")]),
    "infer_domain": f"select conv_id, turn, d.domain, position::bigint as position, column_name, type "
                    f"from (select *, {keyword_sql()} as domain from {DESCRIBED_SQL}) d "
                    f"join (values {_SCHEMA_VALUES}) v(domain, position, column_name, type) on v.domain = d.domain",
}
