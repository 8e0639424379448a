"""Marginals, normal scores, copula fit and sampling."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog.association import PRICED_SQL, priced
from catalog.common import LINE_TYPES, SEED, cdf, epoch, ppf, rnd, s, table, u, wide
from catalog.generate import LINE_IDS
from doppel.functions import domains
from doppel.operators import copula, marginals
from doppel.operators.order_stats import cumulative_histogram, histogram, ordinal_ranks, plan_order
from doppel.functions.columns import numeric
from doppel.functions.rng import uniform
from doppel.plans.generation import generate_with_method

GRID = "[" + ", ".join(repr(i / 199) for i in range(200)) + "]"


def quantiles_sql(src: str, columns: dict[str, str], digits: int = 6) -> str:
    return " union all ".join(
        f'select {s(c)} as "column", unnest(range(200))::bigint as i, '
        f"unnest(list_transform(quantile_cont({x}, {GRID}), lambda q: round(q, {digits}))) as q from {src}"
        for c, x in columns.items())


def numeric_marginal(spark, d):
    out = marginals.numeric_marginals(wide(spark, d, "lineitem"), ["l_extendedprice", "l_quantity", "l_discount"], buckets=16)
    return out.withColumn("q", F.round("q", 6))


def datetime_marginal(spark, d):
    out = marginals.numeric_marginals(table(spark, d, "orders"), ["o_orderdate"])
    return out.withColumn("q", F.round("q", 3))


LABELS = ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"]
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]


def categorical_marginal(spark, d):
    out = marginals.categorical_marginals(table(spark, d, "lineitem"), LABELS, NUMBERS)
    return out.select("column", F.col("position").cast("bigint").alias("position"), "category", "n",
                      F.round("lo", 9).alias("lo"), F.round("hi", 9).alias("hi"), F.round("score", 6).alias("score"))


def categories_sql(src: str, labels: list[str], numbers: list[str]) -> str:
    mean = " + ".join(f"(avg({c}) - any_value(m_{c})) / any_value(s_{c})" for c in numbers)
    parts = []
    for c in labels:
        parts.append(f"""select {s(c)} as "column", row_number() over w as position, category, n, score,
            (sum(n) over w - n) / total as lo, sum(n) over w / total as hi from (
              with g as (select {c}::varchar as category, count(*) as n, ({mean}) / {len(numbers)} as score
                         from {src} t, (select {', '.join(f'avg({x}) as m_{x}, stddev_samp({x}) as s_{x}' for x in numbers)}
                                     from {src}) group by 1),
              t as (select sum(n)::double as total from g)
              select category, n, score, total from g, t)
            window w as (order by score is null, score, category)""")
    return " union all ".join(parts)


SCORED = ["l_extendedprice", "net", "tax_paid", "l_quantity"]


def scored(spark, d):
    """Priced line items with their key columns."""
    keys = wide(spark, d, "lineitem")
    net = F.col("l_extendedprice") * (1.0 - F.col("l_discount"))
    band = F.when(F.col("l_quantity") < 15, "small").when(F.col("l_quantity") < 35, "medium").otherwise("large")
    return keys.select(*LINE_IDS, "l_extendedprice", net.alias("net"), (net * F.col("l_tax")).alias("tax_paid"),
                       "l_quantity", band.alias("size_band"))


SCORED_SQL = PRICED_SQL.replace("(select ", f"(select {', '.join(LINE_IDS)}, ", 1)
SCORED_TYPES = {**{c: "id" for c in LINE_IDS}, **{c: "float" for c in SCORED}, "size_band": "categorical"}


def score_rows(spark, d):
    df = scored(spark, d)
    models, _, plan = copula.fit_marginals(df, SCORED_TYPES)
    out = copula.normal_scores(df, models, LINE_IDS, plan, SEED)
    names = [*SCORED, "size_band"]
    return out.select(*LINE_IDS[:3], F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
                      *[F.round(f"z{i}", 8).alias(f"z_{c}") for i, c in enumerate(names)])


def _u_number(c: str, ids: list[str]) -> str:
    tie = f"floor({u(f'place:{c}', *ids)} * count(*) over (partition by {c}))"
    return (f"greatest(1e-6::double, least(1 - 1e-6::double, (rank() over (order by {c}) - 1 + {tie} + 1) "
            f"/ (count({c}) over () + 1.0::double)))")


def scores_sql() -> str:
    """Rows with z_<column> for the priced lines, raw."""
    ids = LINE_IDS
    cats = categories_sql(SCORED_SQL, ["size_band"], SCORED)
    place = u("place:size_band", *ids)
    label = (f"greatest(1e-6::double, least(1 - 1e-6::double, (lo + 1e-6::double) + "
             f"((case when hi > 0.9999999999 then 1.0::double else hi end) - lo - 2e-6::double) * {place}))")
    uniforms = ", ".join(f"{_u_number(c, ids)} as u_{c}" for c in SCORED)
    return (f"select {', '.join(ids)}, {', '.join(f'{ppf(f'u_{c}')} as z_{c}' for c in [*SCORED, 'size_band'])} from "
            f"(select {', '.join(ids)}, {uniforms}, {label} as u_size_band from {SCORED_SQL} t "
            f"join ({cats}) k on k.category = t.size_band)")


def fitted(spark, d):
    df = scored(spark, d)
    model = copula.fit_copula(df, SCORED_TYPES, LINE_IDS, SEED)
    return copula.correlation_table(df, model).withColumn("value", F.round("value", 6))


def fitted_sql() -> str:
    names = [*SCORED, "size_band"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    return f"with z as ({scores_sql()}) " + " union all ".join(
        f"select {s(a)} as col_a, {s(b)} as col_b, round(corr(z_{a}, z_{b}), 6) as value from z" for a, b in pairs)


PAIR = ["l_extendedprice", "net"]
PAIR_TYPES = {**{c: "id" for c in LINE_IDS}, **{c: "float" for c in PAIR}}


def sampled_pair(spark, d):
    """One synthetic pair per order, learned from price and net price."""
    df = scored(spark, d).select(*LINE_IDS, *PAIR)
    model = copula.fit_copula(df, PAIR_TYPES, LINE_IDS, SEED)
    ids = wide(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("id"))
    return copula.sample_copula(model, ids, SEED).select(*PAIR)


def sampled_pair_sql() -> str:
    a, b = PAIR
    e = [ppf(f"p{j}") for j in (0, 1)]
    def table_of(c):
        return f"(select quantile_cont({c}, {GRID}) from {SCORED_SQL})"
    def value(c, t, x):
        i = f"least(floor({x} * 199.0::double), 198)::bigint"
        lerp = f"(q{t}[{i} + 1] + (q{t}[{i} + 2] - q{t}[{i} + 1]) * ({x} * 199.0::double - {i}))"
        return f"{rnd(f'greatest(q{t}[1], least(q{t}[200], {lerp}))', 4)} as {c}"
    return f"""with z as ({scores_sql()}), r as (select corr(z_{a}, z_{b}) as r from z),
        e as (select {e[0]} as e0, {e[1]} as e1 from (select {u('copula:0', 'o_orderkey + 1')} as p0,
              {u('copula:1', 'o_orderkey + 1')} as p1 from orders)),
        m as (select e0 as w0, r * e0 + sqrt(1 - r * r) * e1 as w1 from e, r),
        p as (select {cdf('w0')} as x0, {cdf('w1')} as x1 from m),
        q as (select {table_of(a)} as q0, {table_of(b)} as q1)
        select {value(a, 0, 'x0')}, {value(b, 1, 'x1')} from p, q"""


def sampled(spark, d):
    """A synthetic lineitem with as many rows as there are orders, all columns learned."""
    items = wide(spark, d, "lineitem")
    types = {**LINE_TYPES, **{c: "id" for c in LINE_IDS[:3]}}
    model = copula.fit_copula(items, types, LINE_IDS, SEED)
    ids = wide(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("id"))
    out = copula.sample_copula(model, ids, SEED)
    return out.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))


def repaired(spark, d):
    """The nearest correlation matrix to one that no three columns can have: each like the first, the last two opposed."""
    c = table(spark, d, "lineitem").agg(F.corr("l_extendedprice", F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("c")).first()["c"]
    fixed = copula.nearest_psd(np.array([[1.0, c, c], [c, 1.0, -c], [c, -c, 1.0]]))
    cells = [("xyz"[i], "xyz"[j], float(fixed[i, j])) for i in range(3) for j in range(3)]
    return spark.createDataFrame(cells, "a string, b string, value double").withColumn("value", F.round("value", 9))


def by_method(spark, d):
    """Learned and independent customers side by side, from the same call."""
    customers = table(spark, d, "customer")
    ids = customers.select((F.col("c_custkey") + 1).alias("id"))
    learned, how, _ = generate_with_method(ids, real=customers, real_ids=["c_custkey"], null_rate=0.05)
    plain, how_plain, _ = generate_with_method(ids, domains.SCHEMAS["customer"], outlier_rate=0.02)
    return learned.select(F.lit(how).alias("method"), F.col("c_acctbal").cast("double").alias("amount"),
                          F.col("c_mktsegment").alias("label")).unionByName(
        plain.select(F.lit(how_plain).alias("method"), F.col("total_spent").alias("amount"),
                     F.col("currency").alias("label")))


def ranks(spark, d):
    """Ordinal rank of every line by price, ties by hash."""
    items = table(spark, d, "lineitem").select(*LINE_IDS, "l_quantity", F.col("l_shipdate"))
    plan = plan_order(items, {"l_quantity": F.col("l_quantity")}, 16)
    tie = uniform(SEED, "tie", *[F.col(c) for c in LINE_IDS])
    out = ordinal_ranks(items, "l_quantity", tie, plan, "l_quantity", [*LINE_IDS, "l_shipdate"])
    return out.select("l_quantity", "l_orderkey", F.col("rank").cast("bigint").alias("rank"))


def average_ranks(spark, d):
    from doppel.operators.order_stats import rank_tables
    items = table(spark, d, "lineitem")
    values = {"l_extendedprice": numeric(items, "l_extendedprice")}
    return rank_tables(items, values, plan_order(items, values, 16))["l_extendedprice"]


def prefix(spark, d):
    items = table(spark, d, "lineitem")
    values = {c: numeric(items, c) for c in ("l_quantity", "l_shipdate")}
    plan = plan_order(items, values, 16)
    cum = cumulative_histogram(histogram(items, values), plan, ["column"])
    return cum.select("column", "value", "n", "cum", F.col("cum_total").alias("total"))


QUERIES = {
    "distributed_rank": average_ranks,
    "distributed_rank_ordinal": ranks,
    "distributed_prefix_sum": prefix,
    "fit_numeric_marginal": numeric_marginal,
    "fit_datetime_marginal": datetime_marginal,
    "fit_categorical_marginal": categorical_marginal,
    "normal_scores": score_rows,
    "fit_copula": fitted,
    "sample_copula": sampled_pair,
    "sample_copula_table": sampled,
    "generate_with_method": by_method,
    "nearest_psd": repaired,
}

_TIE = u("tie", *LINE_IDS)
ORACLES = {
    "distributed_rank": """select l_extendedprice as value, count(*) as n, any_value(r) - 1 as below,
        any_value(r) + (count(*) - 1) / 2.0::double as avg_rank
        from (select l_extendedprice, rank() over (order by l_extendedprice) as r from lineitem) group by 1""",
    "distributed_rank_ordinal": f"""select l_quantity, l_orderkey, row_number() over
        (order by l_quantity, {_TIE}, {', '.join(LINE_IDS)}, l_shipdate) as rank from lineitem""",
    "distributed_prefix_sum": " union all ".join(
        f"""select {s(c)} as "column", v as value, count(*) as n, sum(count(*)) over (order by v)::bigint as cum,
            sum(count(*)) over ()::bigint as total from (select {x}::double as v from lineitem) group by v"""
        for c, x in [("l_quantity", "l_quantity"), ("l_shipdate", epoch("l_shipdate"))]),
    "fit_numeric_marginal": quantiles_sql("lineitem", {c: c for c in ["l_extendedprice", "l_quantity", "l_discount"]}),
    "fit_datetime_marginal": quantiles_sql("orders", {"o_orderdate": epoch("o_orderdate")}, 3),
    "fit_categorical_marginal": f"""select "column", position, category, n, round(lo, 9) as lo, round(hi, 9) as hi,
        round(score, 6) as score from ({categories_sql('lineitem', LABELS, NUMBERS)})""",
    "normal_scores": f"select {', '.join(LINE_IDS[:3])}, l_linenumber::bigint as l_linenumber, "
                     f"{', '.join(f'round(z_{c}, 8) as z_{c}' for c in [*SCORED, 'size_band'])} from ({scores_sql()})",
    # Its least eigenvalue 1 - 2c, below 0, belongs to (1, -1, -1); raised to 1e-6 it adds a multiple of that vector's square.
    "nearest_psd": """with k as (select corr(l_extendedprice, l_extendedprice * (1 - l_discount)) as c from lineitem), m as (select (1e-6::double - 1 + 2 * c) / 3 as d, c from k),
        s(a, b, sign) as (values ('x', 'y', 1), ('x', 'z', 1), ('y', 'z', -1), ('y', 'x', 1), ('z', 'x', 1), ('z', 'y', -1))
        select a, b, round(sign * (c - d) / (1 + d), 9) as value from s, m
        union all select x, x, 1.0::double from (values ('x'), ('y'), ('z')) t(x)""",
    "fit_copula": fitted_sql(),
    "sample_copula": sampled_pair_sql(),
}
