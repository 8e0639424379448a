"""Association strengths."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from catalog.common import LINE_COLUMNS, LINE_LABELS, LINE_NUMERIC, LINE_TYPES, epoch, halves, rnd, s, table, wide
from doppel.operators import association
from doppel.operators.profile import modelling_roles


def lines(spark, d):
    return wide(spark, d, "lineitem").select(*LINE_COLUMNS)


def priced(spark, d):
    """lineitem with amounts that follow from its columns, so that strong pairs exist."""
    net = F.col("l_extendedprice") * (1.0 - F.col("l_discount"))
    return wide(spark, d, "lineitem").select(
        "l_extendedprice", net.alias("net"), (net * F.col("l_tax")).alias("tax_paid"), "l_quantity",
        F.when(F.col("l_quantity") < 15, "small").when(F.col("l_quantity") < 35, "medium").otherwise("large")
        .alias("size_band"),
    )


PRICED_TYPES = {"l_extendedprice": "float", "net": "float", "tax_paid": "float", "l_quantity": "float",
                "size_band": "categorical"}
PRICED_SQL = """(select l_extendedprice, l_extendedprice * (1.0::double - l_discount) as net,
    l_extendedprice * (1.0::double - l_discount) * l_tax as tax_paid, l_quantity,
    case when l_quantity < 15 then 'small' when l_quantity < 35 then 'medium' else 'large' end as size_band
    from lineitem)"""


def rounded(df, digits: int = 6):
    return df.withColumn("value", F.round("value", digits))


def matrices(spark, d):
    """Association of the even half, the odd half, and the whole table, by one set of roles."""
    real, synth = halves(spark, d, *LINE_COLUMNS)
    roles = modelling_roles(real, LINE_TYPES)
    return tuple(association.association_matrix(x, roles=roles) for x in (real, synth, lines(spark, d)))


def number(c: str) -> str:
    return epoch(c) if c == "l_shipdate" else c


def avg_rank(c: str) -> str:
    return f"(rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0::double)"


def spearman_sql(src: str, names: list[str]) -> str:
    ranks = ", ".join(f"{avg_rank(number(c))} as r_{c}" for c in names)
    parts = [f"select {s(a)} as col_a, {s(b)} as col_b, 'spearman' as kind, "
             f"coalesce(abs(corr(r_{a}, r_{b})), 0.0) as value from r" for a, b in combinations(names, 2)]
    return f"(with r as (select {ranks} from {src}) {' union all '.join(parts)})"


def cramers_sql(src: str, a: str, b: str) -> str:
    return f"""(with o as (select {a}::varchar as x, {b}::varchar as y, count(*)::double as o from {src} group by 1, 2),
      r as (select x, sum(o) as r from o group by 1), c as (select y, sum(o) as c from o group by 1),
      k as (select (select sum(r) from r) as n, (select count(*) from r)::double as nr,
                   (select count(*) from c)::double as nc,
                   (select sum(o * o / (r * c)) from o join r using (x) join c using (y)) - 1 as phi2),
      f as (select greatest(0, greatest(phi2, 0) - (nc - 1) * (nr - 1) / (n - 1)) as p,
                   least(nc - (nc - 1) * (nc - 1) / (n - 1), nr - (nr - 1) * (nr - 1) / (n - 1)) - 1 as m from k)
      select {s(a)} as col_a, {s(b)} as col_b, 'cramers_v' as kind,
             case when m <= 0 then 0.0 else least(1.0, sqrt(p / m)) end as value from f)"""


def eta_sql(src: str, num: str, lab: str, first: str, second: str) -> str:
    v = number(num)
    return f"""(with g as (select count({v})::double as n, avg({v}) as m from {src} group by {lab}),
      t as (select avg({v}) as m, var_pop({v}) * count({v}) as sst from {src})
      select {s(first)} as col_a, {s(second)} as col_b, 'correlation_ratio' as kind,
             case when any_value(t.sst) = 0 then 0.0
                  else least(1.0, sqrt(sum(g.n * (g.m - t.m) * (g.m - t.m)) / any_value(t.sst))) end as value
      from g, t)"""


def matrix_sql(src: str) -> str:
    """All pairs in table order, raw values."""
    at = {c: i for i, c in enumerate(LINE_COLUMNS)}
    numbers = sorted(LINE_NUMERIC, key=at.get)
    parts = [f"select * from {spearman_sql(src, numbers)}"]
    parts += [f"select * from {cramers_sql(src, a, b)}" for a, b in combinations(sorted(LINE_LABELS, key=at.get), 2)]
    for n in numbers:
        for lab in LINE_LABELS:
            first, second = sorted((n, lab), key=at.get)
            parts.append(f"select * from {eta_sql(src, n, lab, first, second)}")
    return " union all ".join(parts)


def half_sql(even: bool) -> str:
    return f"(select * from lineitem where l_orderkey % 2 = {0 if even else 1})"


TOP_SQL = f"""with r as ({matrix_sql(half_sql(True))}), s as ({matrix_sql(half_sql(False))}),
    b as ({matrix_sql('lineitem')}),
    j as (select r.col_a, r.col_b, r.value as r, s.value as s, b.value as b
          from r join s using (col_a, col_b) join b using (col_a, col_b))
    select col_a, col_b, {rnd('r', 3)} as real_strength, {rnd('s', 3)} as synth_strength,
           {rnd('b', 3)} as baseline_strength, {rnd('abs(s - r)', 3)} as difference_synth,
           {rnd('abs(b - r)', 3)} as difference_baseline from j order by r desc, col_a, col_b limit 5"""

QUERIES = {
    "spearman_abs": lambda sp, d: rounded(association.spearman_abs(lines(sp, d), "l_quantity", "l_extendedprice", 16)),
    "cramers_v": lambda sp, d: rounded(association.cramers_v(lines(sp, d), "l_returnflag", "l_linestatus")),
    "correlation_ratio": lambda sp, d: rounded(association.correlation_ratio(
        table(sp, d, "customer"), "c_acctbal", "c_mktsegment")),
    "association_matrix": lambda sp, d: rounded(association.association_matrix(lines(sp, d), LINE_TYPES)),
    "association_full_matrix": lambda sp, d: rounded(association.full_matrix(
        association.association_matrix(lines(sp, d), LINE_TYPES))),
    "association_network": lambda sp, d: association.association_network(
        association.association_matrix(priced(sp, d), PRICED_TYPES)),
    "top_relationships": lambda sp, d: association.top_relationships(*matrices(sp, d)),
}

ORACLES = {
    "spearman_abs": f"select col_a, col_b, round(value, 6) as value from "
                    f"{spearman_sql('lineitem', ['l_quantity', 'l_extendedprice'])}",
    "cramers_v": f"select col_a, col_b, round(value, 6) as value from "
                 f"{cramers_sql('lineitem', 'l_returnflag', 'l_linestatus')}",
    "correlation_ratio": f"select col_a, col_b, round(value, 6) as value from "
                         f"{eta_sql('customer', 'c_acctbal', 'c_mktsegment', 'c_acctbal', 'c_mktsegment')}",
    "association_matrix": f"select col_a, col_b, kind, round(value, 6) as value from ({matrix_sql('lineitem')})",
    "association_full_matrix": f"""with m as ({matrix_sql('lineitem')}),
        b as (select col_a, col_b, value from m union all select col_b, col_a, value from m)
        select col_a, col_b, round(value, 6) as value from b
        union all select distinct col_a, col_a, 1.0 from b""",
    "association_network": f"""with e as (
        select * from {spearman_sql(PRICED_SQL, ['l_extendedprice', 'net', 'tax_paid', 'l_quantity'])}
        union all select * from {eta_sql(PRICED_SQL, 'l_extendedprice', 'size_band', 'l_extendedprice', 'size_band')}
        union all select * from {eta_sql(PRICED_SQL, 'net', 'size_band', 'net', 'size_band')}
        union all select * from {eta_sql(PRICED_SQL, 'tax_paid', 'size_band', 'tax_paid', 'size_band')}
        union all select * from {eta_sql(PRICED_SQL, 'l_quantity', 'size_band', 'l_quantity', 'size_band')})
        select col_a as source, col_b as target, {rnd('value', 3)} as weight from e where value >= 0.3""",
    "top_relationships": TOP_SQL,
}
