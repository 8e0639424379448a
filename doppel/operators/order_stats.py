"""Ranks, running sums and quantiles without a single-task sort.

A global order is built from three small pieces:

1. a value histogram, so a value held by a third of the rows becomes one row;
2. buckets with literal bounds taken from a quantile sketch, each holding at
   most about `ROWS_PER_BUCKET` rows, so each window partition is bounded;
3. offsets of the buckets, joined back on the bucket.

Bounds are literals, so a retried task always puts a value in the same bucket.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doppel.checkpoint import settled
from doppel.functions.columns import col
from doppel.functions.rng import array_literal, interval_index

ROWS_PER_BUCKET = 2_000_000
MAX_BUCKETS = 20_000
BROADCAST_VALUES = 400_000  # distinct values whose rank table is broadcast, about 40 MB in memory
BROADCAST_TABLES = 5        # rank tables of that many values that may be broadcast together
HOT_SHARE = 1000            # a value is hot above 1/HOT_SHARE of the rows
EXPLODE_CHUNK = 65_536
MELTED_FROM = 3             # columns of many values whose ranks are looked up together


@dataclass
class OrderPlan:
    """What one pass over the data says about how to order it."""

    rows: int
    bounds: dict[str, list[float]] = field(default_factory=dict)
    distinct: dict[str, int] = field(default_factory=dict)
    nulls: dict[str, int] = field(default_factory=dict)
    table: DataFrame | None = None  # a settled rank_table() of the columns

    def only(self, name: str) -> OrderPlan:
        """The plan of one column."""
        return OrderPlan(self.rows, {name: self.bounds[name]})


def plan_order(df: DataFrame, columns: dict[str, Column], buckets: int | None = None, counted: bool = False) -> OrderPlan:
    """Count rows and nulls, estimate distinct values, and place bucket bounds.

    `counted` says that only a histogram is put in order: no bounds are needed while no column has more values than a bucket holds.
    """
    names = list(columns)
    first = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.approx_count_distinct(columns[c]).alias(f"d{i}") for i, c in enumerate(names)],
        *[F.count(columns[c]).alias(f"k{i}") for i, c in enumerate(names)],
    ).first()
    plan = OrderPlan(rows=first["n"])
    for i, c in enumerate(names):
        plan.distinct[c] = first[f"d{i}"]
        plan.nulls[c] = first["n"] - first[f"k{i}"]
        plan.bounds[c] = []
    short = counted and max(plan.distinct.values(), default=0) <= ROWS_PER_BUCKET
    wanted = buckets or (1 if short else min(MAX_BUCKETS, -(-plan.rows // ROWS_PER_BUCKET)))
    if wanted > 1:
        probs = [i / wanted for i in range(1, wanted)]
        second = df.agg(
            *[F.percentile_approx(columns[c], probs, max(10_000, 10 * wanted)).alias(f"b{i}")
              for i, c in enumerate(names)]
        ).first()
        for i, c in enumerate(names):
            plan.bounds[c] = sorted(set(second[f"b{i}"] or []))
    return plan


def bucket_of(column: Column, value: Column, bounds: dict[str, list[float]]) -> Column:
    """Bucket number of a value of a named column."""
    out = F.lit(0)
    for name, ends in bounds.items():
        if ends:
            index = interval_index(array_literal([float(e) for e in ends]), len(ends), value)
            out = F.when(column == name, index).otherwise(out)
    return out


def melt(df: DataFrame, columns: dict[str, Column], keep: dict[str, Column] | None = None) -> DataFrame:
    """One row per (row, column) with a non-null value: kept columns, `column`, `value`."""
    keep = keep or {}
    # Unpivoting expands rows without making an array of each.
    flat = df.select(*[c.alias(f"_keep{i}") for i, c in enumerate(keep.values())], *[c.alias(name) for name, c in columns.items()])
    flat = flat.unpivot([f"_keep{i}" for i in range(len(keep))], [col(name) for name in columns], "column", "value")
    long = flat.select(*[F.col(f"_keep{i}").alias(k) for i, k in enumerate(keep)], "column", "value")
    return long.filter(F.col("value").isNotNull())


def histogram(df: DataFrame, columns: dict[str, Column], keep: dict[str, Column] | None = None) -> DataFrame:
    """Rows per distinct value of every column (and of the kept keys): `column`, `value`, `n`."""
    keys = [*(keep or {}), "column", "value"]
    return melt(df, columns, keep).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def running_sums(
    frame: DataFrame, keys: list[str], order: list[str], sums: dict[str, str], bucket: Column | None,
    few_keys: bool = False, tasks: int | None = None,
) -> DataFrame:
    """Add an inclusive running sum and the key's total for each entry {name: input column}.

    `name` holds the running sum and `name_total` the total. `bucket` must grow
    with the first order column; None means the whole key is one bucket.
    `few_keys` says that the keys are columns of a table or the like, whose
    totals are few enough to broadcast. Other totals are merged on the window's
    own partitioning: the size of a frame that was made by expanding rows is
    guessed far too low, and they would be sent through the driver. A null key
    is a key like any other. `tasks` deals the buckets to so many, which stay
    apart however small they are: for rows that are expanded afterwards.
    """
    # A struct is never null, so rows with null keys find their totals too.
    columns, keys, frame = frame.columns, ["_key"], frame.withColumn("_key", F.struct(*keys))

    def beside(totals: DataFrame) -> DataFrame:
        return F.broadcast(totals) if few_keys else totals.hint("merge")

    if bucket is None:
        # The totals join on the window's own partitioning, so they move no rows of the frame.
        ordered = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        totals = frame.groupBy(*keys).agg(*[F.sum(c).alias(f"{s}_total") for s, c in sums.items()])
        local = frame.select("*", *[F.sum(c).over(ordered).alias(s) for s, c in sums.items()])
        return local.join(beside(totals), keys).select(*columns, *sums, *[f"{s}_total" for s in sums])
    # An exploded column, unlike an alias, tells the optimiser no formula, from which it would infer a filter of the offsets on `order`.
    split = frame.select("*", F.explode(F.array(bucket)).alias("_bucket"))
    per_bucket = split.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_s_{s}") for s, c in sums.items()])
    whole = Window.partitionBy(*keys)
    before = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys, "_bucket",
        *[F.sum(f"_s_{s}").over(before).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_s_{s}").over(whole).alias(f"{s}_total") for s in sums],
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    dealt = split.repartition(tasks, *keys, "_bucket") if tasks else split
    local = dealt.select("*", *[F.sum(c).over(inside).alias(f"_l_{s}") for s, c in sums.items()])
    joined = local.join(beside(offsets), [*keys, "_bucket"])
    return joined.select(
        *[F.col(c) for c in columns],
        *[(F.col(f"_l_{s}") + F.coalesce(F.col(f"_o_{s}"), F.lit(0))).alias(s) for s in sums],
        *[F.col(f"{s}_total") for s in sums],
    )


def cumulative_histogram(
    hist: DataFrame, plan: OrderPlan, keys: list[str], sums: dict[str, str] | None = None
) -> DataFrame:
    """Histogram with running counts along the value: default `cum` and `cum_total` of `n`."""
    bucket = None
    if any(plan.bounds.values()):
        bucket = bucket_of(F.col("column"), F.col("value"), plan.bounds)
    return running_sums(hist, keys, ["value"], sums or {"cum": "n"}, bucket, few_keys=keys == ["column"])


def rank_tables(df: DataFrame, columns: dict[str, Column], plan: OrderPlan) -> dict[str, DataFrame]:
    """Per column, one row per distinct value: `value`, `n` rows, `below` rows under it, average rank.

    Each table reads its own column only, so a columnar source is read once in total.
    """
    out = {}
    for name, value in columns.items():
        counts = df.select(value.alias("value")).filter("value is not null").groupBy("value").agg(
            F.count(F.lit(1)).alias("n")
        )
        cum = cumulative_histogram(counts.withColumn("column", F.lit(name)), plan.only(name), ["column"])
        out[name] = cum.select(
            "value", "n", (F.col("cum") - F.col("n")).alias("below"),
            (F.col("cum") - (F.col("n") - 1) / F.lit(2.0)).alias("avg_rank"),
        )
    return out


def long_columns(plan: OrderPlan, columns) -> list[str]:
    """Columns whose rank tables are not broadcast: those of over BROADCAST_VALUES values that do not fit in BROADCAST_TABLES such
    tables together."""
    left, out = BROADCAST_TABLES * BROADCAST_VALUES, []
    for c in sorted(columns, key=lambda c: plan.distinct[c]):
        if plan.distinct[c] > max(BROADCAST_VALUES, left):
            out.append(c)
        left -= plan.distinct[c]
    return [c for c in columns if c in out]


def attach_ranks(df: DataFrame, columns: dict[str, str], tables: dict[str, DataFrame], plan: OrderPlan,
                 fields: list[str], prefix: str = "") -> DataFrame:
    """Left-join rank table fields to rows: {name of the rank table: value column of df}.

    The new columns are `<field>_<prefix><position>`. A table of few distinct values is
    broadcast. A long one is shuffled; the values that hold more than 1/1000 of
    the rows (at most 1000 of them) are broadcast on their own, and their rows
    are spread by a salt that matches nothing, so no task gets a hot value.
    """
    out, long = df, long_columns(plan, columns)
    # Long tables first: what is found in the others need not move with the rows.
    for at, (name, value) in sorted(enumerate(columns.items()), key=lambda x: x[1][0] not in long):
        i = f"{prefix}{at}"
        mine = tables[name].select(
            F.col("value").alias(f"_v{i}"), *[F.col(f).alias(f"{f}_{i}") for f in fields], F.col("n").alias(f"_n{i}")
        )
        small = mine.drop(f"_n{i}")
        if name not in long:
            out = out.join(F.broadcast(small), F.col(value) == F.col(f"_v{i}"), "left").drop(f"_v{i}")
            continue
        hot = mine.filter(F.col(f"_n{i}") * F.lit(HOT_SHARE) >= F.lit(plan.rows)).drop(f"_n{i}")
        hot = hot.select(F.col(f"_v{i}").alias("_hv"), *[F.col(f"{f}_{i}").alias(f"_h_{f}") for f in fields])
        marked = out.join(F.broadcast(hot), F.col(value) == F.col("_hv"), "left")
        cold = F.col("_hv").isNull() & F.col(value).isNotNull()
        marked = marked.withColumn("_k", F.when(cold, F.col(value))).withColumn(
            "_salt", F.when(cold, F.lit(0)).otherwise(F.pmod(F.xxhash64(*[F.col(c) for c in out.columns]), F.lit(4096)) + 1)
        )
        joined = marked.join(
            small.withColumn("_zero", F.lit(0).cast("bigint")),
            (F.col("_k") == F.col(f"_v{i}")) & (F.col("_salt") == F.col("_zero")),
            "left",
        )
        out = joined.select(
            *out.columns,
            *[F.coalesce(F.col(f"_h_{f}"), F.col(f"{f}_{i}")).alias(f"{f}_{i}") for f in fields],
        )
    return out


def rank_table(df: DataFrame, columns: dict[str, Column], plan: OrderPlan, given: dict[str, Column] | None = None) -> DataFrame:
    """Ranks of all columns in one frame: column, value, n, below, cum, cum_total, avg_rank.

    For each entry {name: condition} of `given` there are also n_<name> and avg_rank_<name>, which count only rows where the condition
    holds. Whatever the number of columns, rows are counted in one shuffle of distinct values.
    """
    given = given or {}
    long = melt(df, columns, {f"_g{i}": c.cast("int") for i, c in enumerate(given.values())})
    counts = long.groupBy("column", "value").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"_g{i}").cast("bigint").alias(f"n_{g}") for i, g in enumerate(given)])
    cum = cumulative_histogram(counts, plan, ["column"], {"cum": "n"} | {f"cum_{g}": f"n_{g}" for g in given})
    middle = [(F.col(f"cum{g}") - (F.col(f"n{g}") - 1) / F.lit(2.0)).alias(f"avg_rank{g}") for g in ["", *[f"_{g}" for g in given]]]
    return cum.select("column", "value", "n", (F.col("cum") - F.col("n")).alias("below"), "cum", "cum_total", *[f"n_{g}" for g in given], *middle)


def attach_rank_table(df: DataFrame, columns: dict[str, str], table: DataFrame, plan: OrderPlan, fields: list[str],
                      melted_from: int = MELTED_FROM) -> DataFrame:
    """Fields of rank_table() for every row: {column of the table: value column of df} gives `<field>_<position>`.

    Parts of few distinct values are broadcast. `melted_from` or more columns of many values are looked up together: their
    values in one shuffle, the results back by row in another. The table is read once for each column, so settle it.
    """
    long = long_columns(plan, columns)
    parts = {c: table.filter(F.col("column") == c) for c in columns}
    if len(long) < melted_from:
        return attach_ranks(df, columns, parts, plan, fields)
    short = {c: v for c, v in columns.items() if c not in long}
    at = {c: i for i, c in enumerate(columns)}
    rows = settled(df.withColumn("_row", F.monotonically_increasing_id()))
    values = melt(rows, {c: F.col(columns[c]) for c in long}, {"_row": F.col("_row")})
    known = table.filter(F.col("column").isin(long)).select("column", "value", F.struct(*fields).alias("_f"), "n")
    # At most HOT_SHARE values a column hold that many rows.
    hot = known.filter(F.col("n") * F.lit(HOT_SHARE) >= F.lit(plan.rows)).select("column", "value", F.col("_f").alias("_h"))
    marked = values.join(F.broadcast(hot), ["column", "value"], "left")
    cold = marked.filter("_h is null").drop("_h").join(known.drop("n"), ["column", "value"])
    found = marked.filter("_h is not null").withColumnRenamed("_h", "_f").unionByName(cold).groupBy("_row").agg(
        *[F.max(F.when(F.col("column") == c, F.col("_f"))).alias(f"_f{at[c]}") for c in long])
    out = rows.join(found, "_row", "left").select(*df.columns, *[F.col(f"_f{at[c]}.{f}").alias(f"{f}_{at[c]}") for c in long for f in fields])
    if short:
        renamed = attach_ranks(out, short, {c: parts[c] for c in short}, plan, fields, "s")
        out = renamed.select(*out.columns, *[F.col(f"{f}_s{i}").alias(f"{f}_{at[c]}") for i, c in enumerate(short) for f in fields])
    return out


def ordinal_ranks(df: DataFrame, value: str, tie: Column, plan: OrderPlan, name: str, unique: list[str]) -> DataFrame:
    """1-based ordinal rank of every row, ties ordered by `tie` in (0, 1) and then by the unique columns.

    A value with many rows is cut into slices of its tie range, so its rows are
    ranked by many tasks; slices are ordered by their own running count.
    """
    rows = df.filter(F.col(value).isNotNull()).withColumn("_tie", tie)
    tables = rank_tables(rows, {name: F.col(value)}, plan)
    placed = attach_ranks(rows, {name: value}, tables, plan, ["n", "below"])
    slices = F.ceil(F.col("n_0") / F.lit(ROWS_PER_BUCKET))
    placed = placed.withColumn("_slice", F.floor(F.col("_tie") * slices)).drop("n_0")
    per_slice = placed.groupBy(value, "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(value).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(value, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(value, "_slice").orderBy("_tie", *unique)
    ranked = placed.withColumn("_at", F.row_number().over(inside)).join(offsets, [value, "_slice"])
    return ranked.select(*df.columns, (F.col("below_0") + F.col("_offset") + F.col("_at")).alias("rank"))


def _points(cum: DataFrame, keys: list[str], points: int | Column) -> DataFrame:
    """Value at the floor and ceiling position of every grid point i of 0..points-1.

    Products of a position and a short literal grid fit in a long; a grid as
    long as the data needs wider integers.
    """
    exact = "bigint" if isinstance(points, int) else "decimal(38,0)"
    m1 = f"cast({points - 1} as bigint)" if isinstance(points, int) else "cast(_m1 as decimal(19,0))"
    last = f"{points - 1}L" if isinstance(points, int) else "_m1"
    part = "bigint" if isinstance(points, int) else "decimal(19,0)"
    n1 = f"cast(greatest(cum_total - 1, 1) as {part})"
    low, high = f"cast(cum - n as {part})", f"cast(cum - 1 as {part})"  # first and last position of the value

    def floor_div(x, y):
        return f"cast(cast({x} as {exact}) div {y} as bigint)"

    def ceil_div(x, y):
        return floor_div(f"({x} + {y} - 1)", y)

    # floor(i * n1 / m1) in [low, high]  and  ceil(i * n1 / m1) in [low, high]
    one = "cum_total = 1"
    floor_from = f"case when {one} then 0L else {ceil_div(f'{low} * {m1}', n1)} end"
    floor_to = f"case when {one} then {last} else least({ceil_div(f'({high} + 1) * {m1}', n1)} - 1, {last}) end"
    ceil_from = f"case when {one} or cum = n then 0L else {floor_div(f'({low} - 1) * {m1}', n1)} + 1 end"
    ceil_to = f"case when {one} then {last} else least({floor_div(f'{high} * {m1}', n1)}, {last}) end"
    if isinstance(points, int):
        # On a short grid hardly any value holds a point: drop the others before rows are made.
        source = cum.filter(f"{floor_from} <= {floor_to} or {ceil_from} <= {ceil_to}")
    else:
        source = cum.withColumn("_m1", (points - 1).cast("bigint"))
    return source.select(
        *keys, "value", "cum_total",
        F.expr(f"inline(array(struct(true as left, {floor_from} as a, {floor_to} as b), "
               f"struct(false as left, {ceil_from} as a, {ceil_to} as b)))"),
    ).filter("a <= b")


def grid_quantiles(cum: DataFrame, keys: list[str], points: int | Column) -> DataFrame:
    """Linear-interpolated quantiles at i/(points-1): keys, `i`, `q`.

    `cum` comes from cumulative_histogram. A grid given as a column may be as
    long as the data; a value that covers a long run of grid points is then cut
    into chunks that are spread over tasks before they are expanded.
    """
    many = not isinstance(points, int)
    spans = _points(cum, keys, points)
    expand = F.explode(F.sequence(F.col("a"), F.col("b"))).alias("i")
    if many:
        long_run = F.col("b") - F.col("a") >= EXPLODE_CHUNK
        cut = spans.filter(long_run).withColumn(
            "_from", F.explode(F.sequence(F.col("a"), F.col("b"), F.lit(EXPLODE_CHUNK).cast("bigint")))
        )
        cut = cut.select(
            *keys, "value", "cum_total", "left", F.col("_from").alias("a"),
            F.least(F.col("_from") + EXPLODE_CHUNK - 1, F.col("b")).alias("b"),
        ).repartition(*keys, "left", "a")
        spans = spans.filter(~long_run).unionByName(cut)
    hits = spans.select(*keys, "value", "cum_total", "left", expand)
    ends = hits.groupBy(*keys, "i").agg(
        F.max(F.when(F.col("left"), F.col("value"))).alias("_lo"),
        F.max(F.when(~F.col("left"), F.col("value"))).alias("_hi"),
        F.max("cum_total").alias("_n"),
    )
    if many:
        m1 = F.greatest(points - 1, F.lit(1)).cast("decimal(19,0)")
        product = F.col("i").cast("decimal(19,0)") * (F.col("_n") - 1).cast("decimal(19,0)")
    else:
        m1 = F.lit(points - 1).cast("bigint")
        product = F.col("i") * (F.col("_n") - 1)
    fraction = (product % m1).cast("double") / m1.cast("double")
    return ends.select(*keys, "i", (F.col("_lo") + (F.col("_hi") - F.col("_lo")) * fraction).alias("q"))


def medians(cum: DataFrame, keys: list[str]) -> DataFrame:
    """Exact median per key: keys, `median`."""
    mid = grid_quantiles(cum, keys, 3).filter("i = 1")
    return mid.select(*keys, F.col("q").alias("median"))
