"""Real against synthetic: the even and odd halves of lineitem, the whole table as a baseline."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.association import half_sql, matrices, matrix_sql
from catalog.common import LINE_COLUMNS, LINE_LABELS, LINE_NUMERIC, LINE_TYPES, epoch, halves, rnd, s, table, u
from catalog.generate import LINE_IDS
from doppel.checkpoint import settled
from doppel.operators import fidelity
from doppel.operators.profile import modelling_roles

NUMBERS = LINE_NUMERIC[:4]
REAL, SYNTH = half_sql(True), half_sql(False)


def value_of(c: str) -> str:
    return epoch(c) if c == "l_shipdate" else f"{c}::double"


def ks_sql(a: str, b: str, x: str, y: str | None = None) -> str:
    y = y or x
    return (f"(with v as (select {x} as v, 1 as r, 0 as t from {a} union all select {y}, 0, 1 from {b}), "
            f"g as (select v, sum(r) as r, sum(t) as t from v where v is not null group by v), "
            f"c as (select sum(r) over (order by v) / sum(r) over () as fr, sum(t) over (order by v) / sum(t) over () as ft from g) "
            f"select max(abs(fr - ft)) as ks from c)")


def wasserstein_sql(a: str, b: str, x: str, y: str | None = None) -> str:
    y = y or x
    return f"""(with r as (select {x} as v, row_number() over (order by {x}) - 1 as k from {a} where {x} is not null),
        t as (select {y} as v, row_number() over (order by {y}) - 1 as k from {b} where {y} is not null),
        z as (select (select count(*) from r) as nr, (select count(*) from t) as nt),
        g as (select unnest(range(greatest(nr, nt))) as i, nr, nt, greatest(nr, nt) - 1 as m from z),
        p as (select i, (i * (nr - 1)) // m as fr, ((i * (nr - 1)) % m) / m::double as gr, (i * (nr - 1) + m - 1) // m as cr,
                     (i * (nt - 1)) // m as ft, ((i * (nt - 1)) % m) / m::double as gt, (i * (nt - 1) + m - 1) // m as ct from g),
        q as (select r1.v + (r2.v - r1.v) * gr as qr, t1.v + (t2.v - t1.v) * gt as qt from p
              join r r1 on r1.k = fr join r r2 on r2.k = cr join t t1 on t1.k = ft join t t2 on t2.k = ct)
        select avg(abs(qr - qt)) / (select case when max(v) > min(v) then max(v) - min(v) else 1 end from r) as w from q)"""


def compare_numeric_sql(c: str) -> str:
    x = value_of(c)
    stats = ", ".join(f"{f}({x}) as {n}" for f, n in [("avg", "mean"), ("stddev_pop", "std"), ("min", "lo"), ("max", "hi")])
    span = "(case when r.hi > r.lo then r.hi - r.lo else 1 end)"
    score = (f"(greatest(0, 1 - abs(r.mean - t.mean) / {span}) * 100 + greatest(0, 1 - abs(r.std - t.std) / {span}) * 100 "
             f"+ (1 - k.ks) * 100 + greatest(0, 1 - w.w) * 100) / 4")
    fields = ", ".join(f"{rnd(f'{p}.{a}', 4)} as {w}_{n}" for a, n in [("mean", "mean"), ("std", "std"), ("lo", "min"), ("hi", "max")]
                       for p, w in (("r", "real"), ("t", "synth")))
    return (f'select {s(c)} as "column", {fields}, {rnd("k.ks", 4)} as ks, {rnd("w.w", 4)} as wasserstein, {rnd(score, 1)} as score '
            f"from (select {stats} from {REAL}) r, (select {stats} from {SYNTH}) t, {ks_sql(REAL, SYNTH, x)} k, "
            f"{wasserstein_sql(REAL, SYNTH, x)} w")


def shares_sql(a: str, b: str, x: str, y: str | None = None) -> str:
    """value, nr, ns, pr, ps."""
    y = y or x
    return (f"(with r as (select {x}::varchar as value, count(*) as nr from {a} where {x} is not null group by 1), "
            f"t as (select {y}::varchar as value, count(*) as ns from {b} where {y} is not null group by 1) "
            f"select value, coalesce(nr, 0) as nr, coalesce(ns, 0) as ns, coalesce(nr, 0) / sum(nr) over () as pr, "
            f"coalesce(ns, 0) / sum(ns) over () as ps from r full join t using (value))")


def tvd_sql(a: str, b: str, x: str, y: str | None = None) -> str:
    return (f"(select sum(abs(pr - ps)) / 2 as tvd, count(*) filter (nr > 0 and ns > 0) / count(*) filter (nr > 0) as coverage, "
            f"count(*) filter (nr > 0) as real_unique, count(*) filter (ns > 0) as synth_unique from {shares_sql(a, b, x, y)})")


# Orders before and after 1998 by priority and by status, with one status taken out of the second side.
def by_year(spark, d):
    o = table(spark, d, "orders").select("o_orderdate", "o_orderpriority", "o_orderstatus",
                                         F.col("o_custkey").cast("string").alias("customer"))
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz")
    return o.filter(early), o.filter(~early & (F.col("o_orderstatus") != "P"))


EARLY = "(select *, o_custkey::varchar as customer from orders where o_orderdate < timestamp '1998-01-01')"
LATE = ("(select *, o_custkey::varchar as customer from orders where o_orderdate >= timestamp '1998-01-01' "
        "and o_orderstatus <> 'P')")
YEAR_LABELS = ["o_orderpriority", "o_orderstatus", "customer"]


def variation(spark, d):
    out = fidelity.total_variation(*by_year(spark, d), YEAR_LABELS)
    return out.select("column", F.round("tvd", 9).alias("tvd"), F.round("coverage", 9).alias("coverage"), "real_unique", "synth_unique")


def nulled_sides(spark, d):
    """Two sides of orders with different shares of missing keys and priorities."""
    def side(rest, step):
        o = table(spark, d, "orders").filter(F.col("o_orderkey") % 2 == rest)
        return o.select(F.when(F.col("o_orderkey") % step != rest, F.col("o_custkey")).alias("id"),
                        F.when(F.col("o_orderkey") % (step + 2) != rest, F.col("o_orderpriority")).alias("name"))
    return side(0, 6), side(1, 10)


def nulled_sql(c: str, column: str, add: int) -> str:
    def rate(rest, step):
        return (f"(select avg(case when o_orderkey % {step + add} = {rest} then 1.0::double else 0.0::double end) "
                f"from orders where o_orderkey % 2 = {rest})")
    r, t = rate(0, 6), rate(1, 10)
    return (f'select {s(c)} as "column", round({r}, 9) as real_null_rate, round({t}, 9) as synth_null_rate, '
            f"round(1 - abs({r} - {t}), 9) as fidelity")


def nulls(spark, d):
    out = fidelity.null_fidelity(*nulled_sides(spark, d), ["id", "name"])
    return out.select("column", *[F.round(c, 9).alias(c) for c in ("real_null_rate", "synth_null_rate", "fidelity")])


def shapes(spark, d):
    real, synth = halves(spark, d, "l_suppkey", *LINE_COLUMNS)
    return fidelity.shape_and_validity(real, synth, {**LINE_TYPES, "l_suppkey": "id"}, buckets=8)


def shape_sql(raw: bool = False) -> str:
    """All columns of shape_and_validity; `raw` keeps the unrounded shape and validity only."""
    blank = {**{f"{w}_{x}": "double" for x in ("mean", "std", "min", "max", "median") for w in ("real", "synth")},
             "real_unique": "bigint", "synth_unique": "bigint", "real_top": "varchar", "synth_top": "varchar",
             "real_top_pct": "double", "synth_top_pct": "double"}
    parts = []
    for c in LINE_COLUMNS:
        if c in LINE_NUMERIC:
            x = value_of(c)
            ok = f"(select avg(case when {x} between (select min({x}) from {REAL}) and (select max({x}) from {REAL}) then 1.0::double else 0.0::double end) from {SYNTH})"
            given = {}
            for src, w in ((REAL, "real"), (SYNTH, "synth")):
                for f, n in [("avg", "mean"), ("stddev_pop", "std"), ("min", "min"), ("max", "max"), ("median", "median")]:
                    given[f"{w}_{n}"] = rnd(f"(select {f}({x}) from {src})", 2)
            shape, stat, name, source = "1 - ks", "ks", "ks", ks_sql(REAL, SYNTH, x)
        else:
            sh = shares_sql(REAL, SYNTH, c)
            given = {"real_unique": "real_unique", "synth_unique": "synth_unique"}
            for n, p, w in (("nr", "pr", "real"), ("ns", "ps", "synth")):
                given[f"{w}_top"] = f"(select value from {sh} order by {n} desc, value limit 1)"
                given[f"{w}_top_pct"] = rnd(f"(select max({p}) from {sh}) * 100", 1)
            ok, shape, stat, name, source = "coverage", "greatest(0.0, 1 - tvd)", "tvd", "tvd", tvd_sql(REAL, SYNTH, c)
        head = (f'{s(c)} as "column", {s(LINE_TYPES[c])} as type, {s(name)} as stat_name, {rnd(stat, 4)} as stat_value, '
                f"{rnd(f'({shape}) * 100', 1)} as score, {rnd(ok, 4)} as validity, ({shape})::double as raw_shape, ({ok})::double as raw_validity")
        rest = ", ".join(f"{given.get(k, f'null::{t}')} as {k}" for k, t in blank.items())
        parts.append(f"select {head}{'' if raw else ', ' + rest} from {source}")
    ident = ("select 'l_suppkey' as \"column\", 'id' as type, 'null_fidelity' as stat_name, 0.0::double as stat_value, "
             "100.0::double as score, 1.0::double as validity, null::double as raw_shape, null::double as raw_validity")
    if not raw:
        ident += ", " + ", ".join(f"null::{t} as {k}" for k, t in blank.items())
    return " union all ".join([*parts, ident])


def rounded_shapes(spark, d):
    out = shapes(spark, d)
    return out.withColumns({c: F.round(c, 9) for c in ("raw_shape", "raw_validity")})


def relation(spark, d):
    real, synth, _ = matrices(spark, d)
    return fidelity.relationship_fidelity(real, synth).select(*[F.round(c, 6).alias(c) for c in ("fidelity", "mean_real", "mean_diff")])


def relation_sql(other: str, digits: int | None = 6) -> str:
    raw = f"""(select greatest(0.0, case when mr > 0.01 then 1 - md / mr else 1 - md end) as fidelity, mr as mean_real, md as mean_diff
        from (select avg(a.value) as mr, avg(abs(a.value - b.value)) as md from ({matrix_sql(REAL)}) a
              join ({matrix_sql(other)}) b using (col_a, col_b)))"""
    if digits is None:
        return raw
    return f"select round(fidelity, {digits}) as fidelity, round(mean_real, {digits}) as mean_real, round(mean_diff, {digits}) as mean_diff from {raw}"


def histogram_sql(c: str) -> str:
    x = value_of(c)
    return f"""select {s(c)} as "column", bin::bigint as bin, {rnd('lo + bin * w', 2)} as bin_start,
        {rnd('case when bin = 19 then hi else lo + (bin + 1) * w end', 2)} as bin_end,
        {rnd('coalesce(hr, 0) / nr::double * 100', 2)} as real, {rnd('coalesce(hs, 0) / ns::double * 100', 2)} as synthetic
        from (with z as (select min({x}) as lo, max({x}) as hi, (max({x}) - min({x})) / 20 as w,
                         count(*) filter (l_orderkey % 2 = 0) as nr, count(*) filter (l_orderkey % 2 <> 0) as ns from lineitem),
              e as (select unnest(range(20)) as bin),
              p as (select l_orderkey, {x} as x, lo, w, least(floor(({x} - lo) / w), 19)::bigint as f from lineitem, z),
              b as (select case when x < lo + f * w then f - 1 when f < 19 and x >= lo + (f + 1) * w then f + 1 else f end as bin,
                           count(*) filter (l_orderkey % 2 = 0) as hr, count(*) filter (l_orderkey % 2 <> 0) as hs from p group by 1)
              select e.bin, lo, hi, w, nr, ns, hr, hs from e join z on true left join b using (bin))"""


def scatter(spark, d):
    real, synth = halves(spark, d)
    a, b, _ = matrices(spark, d)
    return fidelity.scatter_sample(real, synth, a, b, (LINE_IDS, LINE_IDS))


def scatter_sql() -> str:
    from itertools import combinations
    order = [c for c in LINE_COLUMNS if c in LINE_NUMERIC]
    parts = []
    for x, y in combinations(order, 2):
        for side, src in (("real", REAL), ("synthetic", SYNTH)):
            parts.append(f"""(select {s(x)} as x_col, {s(y)} as y_col, {s(side)} as side, {rnd(value_of(x), 2)} as x, {rnd(value_of(y), 2)} as y
                from {src} order by {u(f'scatter:{x}:{y}', *LINE_IDS)}, {value_of(x)}, {value_of(y)} limit 500)""")
    return f"""with r as ({matrix_sql(REAL)}), t as ({matrix_sql(SYNTH)}),
        top as (select col_a, col_b, r.value as rv, t.value as tv from r join t using (col_a, col_b) where r.kind = 'spearman'
                order by r.value desc, col_a, col_b limit 3), p as ({' union all '.join(parts)})
        select x_col, y_col, side, round(rv, 3) as real_association, round(tv, 3) as synth_association, x, y
        from p join top on x_col = col_a and y_col = col_b"""


def scores(spark, d):
    real, synth = halves(spark, d, *LINE_COLUMNS)
    whole = table(spark, d, "lineitem").select(*LINE_COLUMNS)
    roles = modelling_roles(real, LINE_TYPES)
    a, b, c = matrices(spark, d)
    a = settled(a)  # compared with both others
    first = fidelity.composite(fidelity.shape_and_validity(real, synth, LINE_TYPES, roles), fidelity.relationship_fidelity(a, b))
    second = fidelity.composite(fidelity.shape_and_validity(real, whole, LINE_TYPES, roles), fidelity.relationship_fidelity(a, c))
    return fidelity.fidelity_score(first, second)


def scores_sql() -> str:
    whole = shape_sql(True).replace(SYNTH, "lineitem")
    def one(method, shape, other):
        return (f"select {s(method)} as method, {rnd('sh * 100', 1)} as shape, {rnd('fidelity * 100', 1)} as relationship, "
                f"{rnd('va * 100', 1)} as validity, greatest(0.0, least(100.0, {rnd('(0.4::double * sh + 0.4::double * fidelity + 0.2::double * va) * 100', 1)})) as total "
                f"from (select avg(raw_shape) as sh, avg(raw_validity) as va from ({shape})), {relation_sql(other, None)}")
    return f"""with m as ({one('copula', shape_sql(True), SYNTH)} union all {one('independent', whole, 'lineitem')})
        select *, {rnd("(select total from m where method = 'copula') - (select total from m where method = 'independent')", 1)} as improvement from m"""


COMPARE_TYPES = {"l_suppkey": "id", **{c: "float" for c in NUMBERS}, "l_returnflag": "categorical", "l_linestatus": "categorical"}


def compared(spark, d):
    return fidelity.compare_datasets(*halves(spark, d), COMPARE_TYPES)


def compared_sql() -> str:
    parts = ["select 'l_suppkey' as \"column\", 'id' as type, 100.0::double as score"]
    parts += [f'select "column", \'float\' as type, score from ({compare_numeric_sql(c)})' for c in NUMBERS]
    parts += [f'select {s(c)}, \'categorical\', {rnd("greatest(0.0, 1 - tvd) * 100", 1)} from {tvd_sql(REAL, SYNTH, c)}'
              for c in ("l_returnflag", "l_linestatus")]
    return " union all ".join(parts)


def rounded(column, digits=9):
    return lambda df: df.withColumn(column, F.round(column, digits))


def balances(spark, d):
    return (table(spark, d, "customer").select(F.col("c_acctbal").alias("balance")),
            table(spark, d, "supplier").select(F.col("s_acctbal").alias("balance")))


QUERIES = {
    "ks_statistic": lambda sp, d: rounded("ks")(fidelity.ks_statistic(*halves(sp, d), LINE_NUMERIC, 16)),
    "wasserstein_1d": lambda sp, d: rounded("wasserstein")(fidelity.wasserstein_1d(*balances(sp, d), ["balance"], 4)),
    "compare_numeric": lambda sp, d: fidelity.compare_numeric(*halves(sp, d), NUMBERS),
    "total_variation": variation,
    "category_coverage": lambda sp, d: fidelity.compare_categorical(*by_year(sp, d), YEAR_LABELS),
    "null_fidelity": nulls,
    "compare_datasets": compared,
    "compare_datasets_overall": lambda sp, d: fidelity.overall_score(compared(sp, d)),
    "shape_and_validity": rounded_shapes,
    "relationship_fidelity": relation,
    "paired_histogram": lambda sp, d: fidelity.paired_histogram(*halves(sp, d), LINE_NUMERIC),
    "paired_category_share": lambda sp, d: fidelity.paired_category_share(*by_year(sp, d), YEAR_LABELS),
    "scatter_sample": scatter,
    "fidelity_score": scores,
}

ORACLES = {
    "ks_statistic": " union all ".join(f'select {s(c)} as "column", round(ks, 9) as ks from {ks_sql(REAL, SYNTH, value_of(c))}' for c in LINE_NUMERIC),
    "wasserstein_1d": f"select 'balance' as \"column\", round(w, 9) as wasserstein from {wasserstein_sql('customer', 'supplier', 'c_acctbal', 's_acctbal')}",
    "compare_numeric": " union all ".join(compare_numeric_sql(c) for c in NUMBERS),
    "total_variation": " union all ".join(f'select {s(c)} as "column", round(tvd, 9) as tvd, round(coverage, 9) as coverage, real_unique, synth_unique from {tvd_sql(EARLY, LATE, c)}' for c in YEAR_LABELS),
    "category_coverage": " union all ".join(f'select {s(c)} as "column", real_unique, synth_unique, {rnd("coverage * 100", 1)} as coverage_pct, {rnd("greatest(0.0, 1 - tvd) * 100", 1)} as score from {tvd_sql(EARLY, LATE, c)}' for c in YEAR_LABELS),
    "null_fidelity": nulled_sql("id", "o_custkey", 0) + " union all " + nulled_sql("name", "o_orderpriority", 2),
    "compare_datasets": compared_sql(),
    "compare_datasets_overall": f"select {rnd('avg(score)', 1)} as overall_score, count(*) as column_count from ({compared_sql()})",
    "shape_and_validity": f"select * replace (round(raw_shape, 9) as raw_shape, round(raw_validity, 9) as raw_validity) from ({shape_sql()})",
    "relationship_fidelity": relation_sql(SYNTH),
    "paired_histogram": " union all ".join(histogram_sql(c) for c in LINE_NUMERIC),
    "paired_category_share": " union all ".join(f'(select {s(c)} as "column", value as category, {rnd("pr * 100", 2)} as real, {rnd("ps * 100", 2)} as synthetic from {shares_sql(EARLY, LATE, c)} where nr > 0 order by nr desc, value limit 15)' for c in YEAR_LABELS),
    "scatter_sample": scatter_sql(),
    "fidelity_score": scores_sql(),
}
