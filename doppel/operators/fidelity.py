"""How close a synthetic table is to the real one, column by column and pair by pair."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doppel.checkpoint import settled, stored
from doppel.functions.columns import IDENTITY_TYPES, col, numeric
from doppel.functions.normal import round_even
from doppel.functions.rng import uniform
from doppel.operators.order_stats import ROWS_PER_BUCKET, OrderPlan, bucket_of, melt, plan_order, running_sums
from doppel.operators.profile import modelling_roles
from doppel.operators.shaping import least_draws
from doppel.session import spread

BINS = 20
TOP_SHARES = 15
SCATTER_PAIRS = 3
SCATTER_POINTS = 500
# Weights of shape, relationship and validity in the score.
WEIGHTS = (0.40, 0.40, 0.20)
WEAK_ASSOCIATION = 0.01


def _sides(real: DataFrame, synth: DataFrame, columns: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Both tables under one another: `side` 0 real, 1 synthetic, and `v<i>` for each column."""
    return real.select(F.lit(0).alias("side"), *[a.alias(f"v{i}") for i, (a, _) in enumerate(columns.values())]).unionByName(
        synth.select(F.lit(1).alias("side"), *[b.alias(f"v{i}") for i, (_, b) in enumerate(columns.values())])
    )


def _numbers(real: DataFrame, synth: DataFrame, names: list[str]) -> DataFrame:
    return _sides(real, synth, {c: (numeric(real, c), numeric(synth, c)) for c in names})


def _labels(real: DataFrame, synth: DataFrame, names: list[str]) -> DataFrame:
    return _sides(real, synth, {c: (col(c).cast("string"), col(c).cast("string")) for c in names})


def _values(names: list[str]) -> dict[str, Column]:
    return {c: F.col(f"v{i}") for i, c in enumerate(names)}


def _counts(both: DataFrame, names: list[str]) -> DataFrame:
    """column, value, nr real rows, ns synthetic rows; one shuffle of distinct values."""
    return melt(both, _values(names), {"side": F.col("side")}).groupBy("column", "value").agg(
        F.count_if(F.col("side") == 0).alias("nr"), F.count_if(F.col("side") == 1).alias("ns")
    )


def pooled_cdf(real: DataFrame, synth: DataFrame, names: list[str], buckets: int | None = None) -> DataFrame:
    """Per column and distinct value: counts nr, ns, running counts cr, cs and totals of both sides."""
    both = _numbers(real, synth, names)
    plan = plan_order(both, _values(names), buckets, counted=True)
    return _pooled(both, names, plan)


def _pooled(both: DataFrame, names: list[str], plan: OrderPlan) -> DataFrame:
    bucket = bucket_of(F.col("column"), F.col("value"), plan.bounds) if any(plan.bounds.values()) else None
    return running_sums(_counts(both, names), ["column"], ["value"], {"cr": "nr", "cs": "ns"}, bucket, few_keys=True)


def _ks() -> Column:
    return F.expr("max(if(cr_total = 0 or cs_total = 0, 1D, abs(cr / nullif(cr_total, 0) - cs / nullif(cs_total, 0))))")


def ks_from(cdf: DataFrame) -> DataFrame:
    """column, ks: the largest gap between the two empirical distributions (1 when a side is empty)."""
    return cdf.groupBy("column").agg(_ks().alias("ks"))


def summary_from(cdf: DataFrame) -> DataFrame:
    """column, ks, inside (share of synthetic rows within the real range), r_median, s_median: one aggregation of the pooled frame."""
    middle = []
    for s in "rs":
        n, c, last = f"n{s}", f"c{s}", f"(c{s}_total - 1)"
        # The values that hold the positions around the middle.
        ends = [f"max(case when {c} - {n} <= {p} and {p} < {c} then value end)" for p in (f"{last} div 2", f"({last} + 1) div 2")]
        middle.append(F.expr(f"{ends[0]} + ({ends[1]} - {ends[0]}) * 0.5D").alias(f"{s}_median"))
    inside = ("(max(case when nr > 0 and cr = cr_total then cs end) - max(case when nr > 0 and cr = nr then cs - ns end)) "
              "/ nullif(max(cs_total), 0)")
    return cdf.groupBy("column").agg(_ks().alias("ks"), F.expr(inside).alias("inside"), *middle)


def ks_statistic(real: DataFrame, synth: DataFrame, names: list[str], buckets: int | None = None) -> DataFrame:
    return ks_from(pooled_cdf(real, synth, names, buckets))


def wasserstein_from(cdf: DataFrame, bucket_rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """column, wasserstein: mean gap of the quantile functions on a grid as long as the longer side, over the real range.

    The grid is never made. With m points it meets each row of the longer side once, whose quantiles are steps; those of the shorter
    side, n rows, are steps and straight lines between them. Both are cut at the points where either begins a piece, and
    the gap summed over each run of points in closed form. Pieces are as many as distinct values, and are
    put in order within ranges of grid points.
    """
    def at(position: str, up: bool = False) -> str:
        """The grid point at a position of the shorter side, rounded down or up."""
        product = f"cast({position} as decimal(19,0)) * cast(m1 as decimal(19,0))"
        return f"cast(({product} + {'n1 - 1' if up else '0'}) div greatest(n1, 1) as bigint)"

    long_is_real = "cr_total >= cs_total"
    sides = cdf.filter("cr_total > 0 and cs_total > 0").selectExpr(
        "column", "value", f"if({long_is_real}, nr, ns) as ln", f"if({long_is_real}, cr, cs) as lc", f"if({long_is_real}, ns, nr) as sn",
        f"if({long_is_real}, cs, cr) as sc", "greatest(cr_total, cs_total) - 1 as m1", "least(cr_total, cs_total) - 1 as n1")
    low, high = "(sc - sn)", "(sc - 1)"
    none = {"lv": "double", "cv": "double", "gl": "double", "gr": "double", "gh": "bigint"}

    def piece(kind: str, there: str, first: str, last: str, **fields: str) -> str:
        own = ", ".join(f"{fields.get(f, f'cast(null as {t})')} as {f}" for f, t in none.items())
        return f"struct({there} and {first} <= {last} as there, '{kind}' as kind, {first} as i, {last} as e, {own})"

    def gap(h: str, there: str, **fields: str) -> str:
        return piece("s", there, f"{at(h)} + 1", f"{at(f'({h} + 1)', True)} - 1", gh=h, **fields)

    one = "n1 = 0"
    pieces = sides.selectExpr("column", "m1", "n1", "inline(array(" + ", ".join([
        piece("l", "ln > 0", "lc - ln", "lc - 1", lv="value"),
        piece("s", "sn > 0", f"if({one}, 0L, {at(low, True)})", f"if({one}, m1, {at(high)})", cv="value"),
        gap(high, f"sn > 0 and {high} < n1", gl="value"), gap(f"({low} - 1)", f"sn > 0 and {low} > 0", gr="value"),
    ]) + "))").filter("there")
    starts = pieces.groupBy("column", "i").agg(
        F.max("m1").alias("m1"), F.max("n1").alias("n1"), F.max(F.when(F.col("kind") == "l", F.struct("e", "lv"))).alias("l"),
        *[F.max(F.when(F.col("kind") == "s", F.col(f))).alias(f"s_{f}") for f in ("e", "cv", "gl", "gr", "gh")])
    starts = starts.select("column", "i", "m1", "n1", "l", F.when(F.col("s_e").isNotNull(), F.struct(
        F.col("s_e").alias("e"), F.col("s_cv").alias("cv"), F.col("s_gl").alias("gl"), F.col("s_gr").alias("gr"), F.col("s_gh").alias("gh"))).alias("s"),
        F.expr(f"i div {bucket_rows}").alias("b"))
    # Each point where a piece begins gets the piece of the other kind that holds there: the last before it, in its bucket or an earlier one.
    before = Window.partitionBy("column").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carry = starts.groupBy("column", "b").agg(*[F.max_by(k, F.when(F.col(k).isNotNull(), F.col("i"))).alias(k) for k in "ls"])
    carry = carry.select("column", "b", *[F.last(k, ignorenulls=True).over(before).alias(f"{k}0") for k in "ls"])
    inside = Window.partitionBy("column", "b").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = starts.select("column", "b", "i", "m1", "n1", *[F.last(k, ignorenulls=True).over(inside).alias(k) for k in "ls"])
    held = held.join(carry, ["column", "b"]).select("column", "i", "m1", "n1", *[F.coalesce(k, f"{k}0").alias(k) for k in "ls"])

    def gap_at(i: str) -> str:
        share = f"cast(cast({i} as decimal(19,0)) * cast(n1 as decimal(19,0)) - cast(s.gh as decimal(19,0)) * cast(m1 as decimal(19,0)) as double) / greatest(m1, 1)"
        return f"coalesce(s.cv, s.gl + (s.gr - s.gl) * ({share})) - l.lv"

    runs = held.selectExpr("column", "m1", "i", "least(l.e, s.e) as e", "l", "s", "n1").selectExpr(
        "column", "m1", "e - i + 1 as c", f"{gap_at('i')} as a", f"{gap_at('e')} as z")
    # Where the gap changes sign, k points lie before the change.
    step = "((z - a) / greatest(c - 1, 1))"
    runs = runs.selectExpr("*", f"if(a * z < 0, greatest(1L, least(c - 1, cast(floor(-a / nullif({step}, 0D)) as bigint) + 1)), c) as k")
    total = f"if(k = c, abs(a + z) * c, abs(2 * a + {step} * (k - 1)) * k + abs(a + {step} * k + z) * (c - k)) / 2"
    gaps = runs.groupBy("column").agg((F.sum(F.expr(total)) / (F.max("m1") + 1)).alias("gap"))
    spans = cdf.filter("nr > 0").groupBy("column").agg((F.max("value") - F.min("value")).alias("span"))
    return gaps.join(spans, "column").select(
        "column", F.when(F.col("span") > 0, F.col("gap") / F.col("span")).otherwise(F.col("gap")).alias("wasserstein")
    )


def wasserstein_1d(real: DataFrame, synth: DataFrame, names: list[str], buckets: int | None = None) -> DataFrame:
    return wasserstein_from(pooled_cdf(real, synth, names, buckets))


def side_stats(both: DataFrame, names: list[str]) -> DataFrame:
    """column and per side n, mean, population std, min, max (prefix r_ or s_), in one pass."""
    wanted = [("n", "count({})"), ("mean", "avg({})"), ("std", "stddev_pop({})"), ("min", "min({})"), ("max", "max({})")]
    aggregates, cells = [], []
    for i, c in enumerate(names):
        fields = []
        for prefix, side in (("r", 0), ("s", 1)):
            for stat, call in wanted:
                key = f"{prefix}{stat}{i}"
                aggregates.append(f"{call.format(f'case when side = {side} then v{i} end')} as {key}")
                fields.append(f"{key} as {prefix}_{stat}")
        cells.append(f"struct({i} as at, {', '.join(fields)})")
    row = both.selectExpr(*aggregates).selectExpr(f"inline(array({', '.join(cells)}))")
    label = F.element_at(F.array(*[F.lit(c) for c in names]), F.col("at") + 1)
    return row.select(label.alias("column"), *[x for x in row.columns if x != "at"])


def compare_numeric(real: DataFrame, synth: DataFrame, names: list[str], buckets: int | None = None) -> DataFrame:
    """Means, spreads, KS, Wasserstein and their joint score per numeric column."""
    both = _numbers(real, synth, names)
    # Read by several aggregations, in tasks of its own size and not one for each column.
    cdf = spread(stored(_pooled(both, names, plan_order(both, _values(names), buckets, counted=True))))
    joined = side_stats(both, names).join(ks_from(cdf), "column").join(wasserstein_from(cdf), "column")
    span = F.when(F.col("r_max") > F.col("r_min"), F.col("r_max") - F.col("r_min")).otherwise(F.lit(1.0))

    def closeness(gap: Column) -> Column:
        return F.greatest(F.lit(0.0), 1 - gap) * 100

    score = (closeness(F.abs(F.col("r_mean") - F.col("s_mean")) / span)
             + closeness(F.abs(F.col("r_std") - F.col("s_std")) / span)
             + (1 - F.col("ks")) * 100 + closeness(F.col("wasserstein"))) / 4
    return joined.select(
        "column", *[round_even(F.col(f"{p}_{s}"), 4).alias(f"{w}_{s}") for s in ("mean", "std", "min", "max")
                    for p, w in (("r", "real"), ("s", "synth"))],
        round_even(F.col("ks"), 4).alias("ks"), round_even(F.col("wasserstein"), 4).alias("wasserstein"),
        round_even(score, 1).alias("score"),
    )


def category_shares(real: DataFrame, synth: DataFrame, names: list[str]) -> DataFrame:
    """column, value, nr, ns and both shares of non-null rows."""
    counts = _counts(_labels(real, synth, names), names)
    totals = F.broadcast(counts.groupBy("column").agg(F.sum("nr").alias("tr"), F.sum("ns").alias("ts")))
    return counts.join(totals, "column").select(
        "column", "value", "nr", "ns", (F.col("nr") / F.greatest("tr", F.lit(1))).alias("pr"),
        (F.col("ns") / F.greatest("ts", F.lit(1))).alias("ps"),
    )


def total_variation(real: DataFrame, synth: DataFrame, names: list[str]) -> DataFrame:
    """column, tvd, coverage (share of real categories also drawn), and distinct counts of both sides."""
    return category_shares(real, synth, names).groupBy("column").agg(
        (F.sum(F.abs(F.col("pr") - F.col("ps"))) / 2).alias("tvd"),
        (F.count_if((F.col("nr") > 0) & (F.col("ns") > 0)) / F.greatest(F.count_if(F.col("nr") > 0), F.lit(1)))
        .alias("coverage"),
        F.count_if(F.col("nr") > 0).alias("real_unique"), F.count_if(F.col("ns") > 0).alias("synth_unique"),
    )


def compare_categorical(real: DataFrame, synth: DataFrame, names: list[str]) -> DataFrame:
    return total_variation(real, synth, names).select(
        "column", "real_unique", "synth_unique", round_even(F.col("coverage") * 100, 1).alias("coverage_pct"),
        round_even(F.greatest(F.lit(0.0), 1 - F.col("tvd")) * 100, 1).alias("score"),
    )


def null_fidelity(real: DataFrame, synth: DataFrame, names: list[str]) -> DataFrame:
    """column, null rates of both sides, and 1 - their difference."""
    both = _labels(real, synth, names)
    rates = []
    for i, _ in enumerate(names):
        for p, side in (("r", 0), ("s", 1)):
            rates.append(f"avg(case when side = {side} then cast(v{i} is null as double) end) as {p}{i}")
    cells = F.array(*[
        F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"r{i}"), F.lit(0.0)).alias("real_null_rate"),
                 F.coalesce(F.col(f"s{i}"), F.lit(0.0)).alias("synth_null_rate"))
        for i, c in enumerate(names)
    ])
    long = both.selectExpr(*rates).select(F.explode(cells).alias("c")).select("c.*")
    return long.withColumn(
        "fidelity", F.greatest(F.lit(0.0), 1 - F.abs(F.col("real_null_rate") - F.col("synth_null_rate")))
    )


def compare_datasets(real: DataFrame, synth: DataFrame, types: dict[str, str], buckets: int | None = None) -> DataFrame:
    """column, type, score in table order of schema types; numeric, categorical, or null rates for the rest."""
    shared = [c for c in types if c in real.columns and c in synth.columns]
    numbers = [c for c in shared if types[c] in ("integer", "float")]
    labels = [c for c in shared if types[c] == "categorical"]
    others = [c for c in shared if c not in numbers and c not in labels]
    parts = []
    if numbers:
        parts.append(compare_numeric(real, synth, numbers, buckets).select("column", "score"))
    if labels:
        parts.append(compare_categorical(real, synth, labels).select("column", "score"))
    if others:
        parts.append(null_fidelity(real, synth, others).select("column", round_even(F.col("fidelity") * 100, 1).alias("score")))
    kinds = F.create_map(*[F.lit(x) for c in shared for x in (c, types[c])])
    return reduce(DataFrame.unionByName, parts).select("column", kinds[F.col("column")].alias("type"), "score")


def overall_score(report: DataFrame) -> DataFrame:
    """overall_score, column_count of a compare_datasets report."""
    return report.agg(round_even(F.avg("score"), 1).alias("overall_score"), F.count("column").alias("column_count"))


_REPORT = ["column", "type", "stat_name", "stat_value", "score", "validity", "raw_shape", "raw_validity",
           "real_mean", "synth_mean", "real_std", "synth_std", "real_min", "synth_min", "real_max", "synth_max",
           "real_median", "synth_median", "real_unique", "synth_unique", "real_top", "synth_top", "real_top_pct",
           "synth_top_pct"]
_TEXT = {"column", "type", "stat_name", "real_top", "synth_top"}


def _complete(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(*[
        (F.col(c) if c in have else F.lit(None)).cast("string" if c in _TEXT else "bigint" if c.endswith("_unique") else "double")
        .alias(c) for c in _REPORT
    ])


def shape_and_validity(real: DataFrame, synth: DataFrame, types: dict[str, str], roles: dict[str, str] | None = None,
                       buckets: int | None = None) -> DataFrame:
    """Per column: KS or total variation, its score, and validity with the statistics behind them.

    `raw_shape` and `raw_validity` are unrounded and null for identity columns,
    which do not enter the composite score.
    """
    shared = [c for c in real.columns if c in synth.columns]
    identities = [c for c in shared if types.get(c, "text") in IDENTITY_TYPES]
    roles = roles or modelling_roles(real, {c: types.get(c, "text") for c in shared})
    numbers = [c for c in shared if c not in identities and roles.get(c) == "numeric"]
    labels = [c for c in shared if c not in identities and roles.get(c) == "categorical"]
    kinds = F.create_map(*[F.lit(x) for c in shared for x in (c, types.get(c, "text"))])
    parts = []
    if numbers:
        both = _numbers(real, synth, numbers)
        cdf = _pooled(both, numbers, plan_order(both, _values(numbers), buckets, counted=True))
        stats = side_stats(both, numbers)
        joined = stats.join(summary_from(cdf), "column", "left")
        ks = F.coalesce(F.col("ks"), F.lit(1.0))
        ok = F.coalesce(F.col("inside"), F.lit(0.0))
        parts.append(joined.select(
            "column", kinds[F.col("column")].alias("type"), F.lit("ks").alias("stat_name"),
            round_even(ks, 4).alias("stat_value"),
            round_even(F.greatest(F.lit(0.0), 1 - ks) * 100, 1).alias("score"), round_even(ok, 4).alias("validity"),
            F.greatest(F.lit(0.0), 1 - ks).alias("raw_shape"), ok.alias("raw_validity"),
            *[F.coalesce(round_even(F.col(f"{p}_{s}"), 2), F.lit(0.0)).alias(f"{w}_{s}")
              for s in ("mean", "std", "min", "max", "median") for p, w in (("r", "real"), ("s", "synth"))],
        ))
    if labels:
        shares = category_shares(real, synth, labels)
        # The most frequent label of each side, ties by label: an aggregate, so no side is sorted.
        tops = shares.groupBy("column").agg(*[
            e for p, w in (("r", "real"), ("s", "synth")) for e in (
                F.max(F.when(F.col(f"n{p}") > 0, F.col(f"n{p}"))).alias(f"{w}_top_n"),
                F.max(F.col(f"p{p}")).alias(f"{w}_top_share"),
            )
        ])
        named = shares.join(F.broadcast(tops), "column").groupBy("column").agg(*[
            F.min(F.when(F.col(f"n{p}") == F.col(f"{w}_top_n"), F.col("value"))).alias(f"{w}_top")
            for p, w in (("r", "real"), ("s", "synth"))
        ])
        joined = total_variation(real, synth, labels).join(tops, "column").join(named, "column")
        shape = F.greatest(F.lit(0.0), 1 - F.col("tvd"))
        parts.append(joined.select(
            "column", kinds[F.col("column")].alias("type"), F.lit("tvd").alias("stat_name"),
            round_even(F.col("tvd"), 4).alias("stat_value"), round_even(shape * 100, 1).alias("score"),
            round_even(F.col("coverage"), 4).alias("validity"), shape.alias("raw_shape"),
            F.col("coverage").alias("raw_validity"), "real_unique", "synth_unique", "real_top", "synth_top",
            round_even(F.col("real_top_share") * 100, 1).alias("real_top_pct"),
            round_even(F.col("synth_top_share") * 100, 1).alias("synth_top_pct"),
        ))
    if identities:
        nulls = null_fidelity(real, synth, identities)
        parts.append(nulls.select(
            "column", kinds[F.col("column")].alias("type"), F.lit("null_fidelity").alias("stat_name"),
            round_even(1 - F.col("fidelity"), 4).alias("stat_value"),
            round_even(F.col("fidelity") * 100, 1).alias("score"), F.lit(1.0).alias("validity"),
        ))
    return reduce(DataFrame.unionByName, [_complete(p) for p in parts])


def relationship_fidelity(real_pairs: DataFrame, synth_pairs: DataFrame) -> DataFrame:
    """One row: fidelity, mean_real, mean_diff over all pairs of columns."""
    pair = ["col_a", "col_b"]
    joined = real_pairs.select(*pair, F.col("value").alias("r")).join(
        synth_pairs.select(*pair, F.col("value").alias("s")), pair
    )
    means = joined.agg(F.avg("r").alias("mean_real"), F.avg(F.abs(F.col("s") - F.col("r"))).alias("mean_diff"))
    relative = F.when(F.col("mean_real") > WEAK_ASSOCIATION, 1 - F.col("mean_diff") / F.col("mean_real")).otherwise(
        1 - F.col("mean_diff")
    )
    return means.select(F.coalesce(F.greatest(F.lit(0.0), relative), F.lit(1.0)).alias("fidelity"), "mean_real", "mean_diff")


def paired_histogram(real: DataFrame, synth: DataFrame, names: list[str], bins: int = BINS) -> DataFrame:
    """Percent of each side in equal bins over the joint range: column, bin, bin_start, bin_end, real, synthetic."""
    both = _numbers(real, synth, names)
    limits = both.selectExpr(*[
        e for i in range(len(names)) for e in (
            f"min(v{i}) as lo{i}", f"max(v{i}) as hi{i}",
            f"count(case when side = 0 then v{i} end) as r{i}", f"count(case when side = 1 then v{i} end) as s{i}",
        )
    ]).first()
    usable, places, edges = [], {}, []
    for i, c in enumerate(names):
        if not limits[f"r{i}"] or not limits[f"s{i}"]:
            continue
        low, high = float(limits[f"lo{i}"]), float(limits[f"hi{i}"])
        if low == high:
            low, high = low - 1.0, high + 1.0
        width = (high - low) / bins
        x, lo, w = F.col(f"v{i}"), F.lit(low), F.lit(width)
        first = F.least(F.floor((x - lo) / w), F.lit(bins - 1))
        # The quotient may miss an edge by a rounding; the edges themselves decide.
        settled = F.when(x < lo + first * w, first - 1).when(
            (first < bins - 1) & (x >= lo + (first + 1) * w), first + 1).otherwise(first)
        places[c] = settled.cast("int")
        usable.append(c)
        for b in range(bins):
            end = high if b == bins - 1 else low + (b + 1) * width
            edges.append((c, b, low + b * width, end, limits[f"r{i}"], limits[f"s{i}"]))
    grid = real.sparkSession.createDataFrame(
        edges, "column string, bin int, bin_start double, bin_end double, nr bigint, ns bigint"
    )
    if not usable:
        return grid.select("column", "bin", "bin_start", "bin_end", F.lit(0.0).alias("real"), F.lit(0.0).alias("synthetic"))
    filled = melt(both, places, {"side": F.col("side")}).groupBy("column", F.col("value").alias("bin")).agg(
        F.count_if(F.col("side") == 0).alias("hr"), F.count_if(F.col("side") == 1).alias("hs")
    )
    return F.broadcast(grid).join(filled, ["column", "bin"], "left").select(
        "column", F.col("bin").cast("bigint").alias("bin"), round_even(F.col("bin_start"), 2).alias("bin_start"),
        round_even(F.col("bin_end"), 2).alias("bin_end"),
        round_even(F.coalesce(F.col("hr"), F.lit(0)) / F.col("nr") * 100, 2).alias("real"),
        round_even(F.coalesce(F.col("hs"), F.lit(0)) / F.col("ns") * 100, 2).alias("synthetic"),
    )


def paired_category_share(real: DataFrame, synth: DataFrame, names: list[str], limit: int = TOP_SHARES) -> DataFrame:
    """The top real categories of each column with the percent of both sides."""
    first = Window.partitionBy("column").orderBy(F.desc("nr"), "value")
    shares = category_shares(real, synth, names).filter("nr > 0")
    return shares.withColumn("_r", F.row_number().over(first)).filter(F.col("_r") <= limit).select(
        "column", F.col("value").alias("category"), round_even(F.col("pr") * 100, 2).alias("real"),
        round_even(F.col("ps") * 100, 2).alias("synthetic"),
    )


def scatter_sample(real: DataFrame, synth: DataFrame, real_pairs: DataFrame, synth_pairs: DataFrame,
                   ids: tuple[list[str], list[str]], points: int = SCATTER_POINTS, seed: int = 42) -> DataFrame:
    """Up to 500 points a side of the three numeric pairs most strongly associated in the real table."""
    top = real_pairs.filter("kind = 'spearman'").orderBy(F.desc("value"), "col_a", "col_b").limit(SCATTER_PAIRS).collect()
    strengths = {(r["col_a"], r["col_b"]): r["value"] for r in synth_pairs.filter("kind = 'spearman'").collect()} if top else {}
    parts = []
    for r in top:
        a, b = r["col_a"], r["col_b"]
        for side, df, keys in (("real", real, ids[0]), ("synthetic", synth, ids[1])):
            rows = df.select(numeric(df, a).alias("x"), numeric(df, b).alias("y"),
                             uniform(seed, f"scatter:{a}:{b}", *[col(k) for k in keys]).alias("_u"))
            some = least_draws(rows.filter("x is not null and y is not null"), "_u", points, ["x", "y"])
            parts.append(some.select(
                F.lit(a).alias("x_col"), F.lit(b).alias("y_col"), F.lit(side).alias("side"),
                F.round(F.lit(float(r["value"])), 3).alias("real_association"),
                F.round(F.lit(float(strengths.get((a, b), 0.0))), 3).alias("synth_association"),
                round_even(F.col("x"), 2).alias("x"), round_even(F.col("y"), 2).alias("y"),
            ))
    if not parts:
        return real.sparkSession.createDataFrame(
            [], "x_col string, y_col string, side string, real_association double, synth_association double, x double, y double")
    return reduce(DataFrame.unionByName, parts)


def composite(shapes: DataFrame, relationship: DataFrame) -> DataFrame:
    """One row: shape, relationship, validity, total (0-100, one decimal) of one synthetic table."""
    means = shapes.agg(F.coalesce(F.avg("raw_shape"), F.lit(1.0)).alias("s"),
                       F.coalesce(F.avg("raw_validity"), F.lit(1.0)).alias("v")).withColumn("_k", F.lit(1))
    joined = means.join(F.broadcast(relationship.select(F.col("fidelity").alias("r"), F.lit(1).alias("_k"))), "_k")
    total = (F.lit(WEIGHTS[0]) * F.col("s") + F.lit(WEIGHTS[1]) * F.col("r") + F.lit(WEIGHTS[2]) * F.col("v")) * 100
    return joined.select(
        round_even(F.col("s") * 100, 1).alias("shape"), round_even(F.col("r") * 100, 1).alias("relationship"),
        round_even(F.col("v") * 100, 1).alias("validity"),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), round_even(total, 1))).alias("total"),
    )


def fidelity_score(synth: DataFrame, baseline: DataFrame) -> DataFrame:
    """Two composite rows (method copula, independent) with the improvement of the first on both."""
    # Both the rows and their gain are read from here, so that all statistics are made once.
    rows = settled(synth.withColumn("method", F.lit("copula")).unionByName(baseline.withColumn("method", F.lit("independent"))))
    gain = rows.agg(F.max(F.when(F.col("method") == "copula", F.col("total"))).alias("a"),
                    F.max(F.when(F.col("method") == "independent", F.col("total"))).alias("b"))
    gain = gain.select(round_even(F.col("a") - F.col("b"), 1).alias("improvement"), F.lit(1).alias("_k"))
    return rows.withColumn("_k", F.lit(1)).join(F.broadcast(gain), "_k").drop("_k")
