"""Linked tables: learn fan-outs, shares and prices, generate parents and children, keep totals exact."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doppel.checkpoint import stored
from doppel.functions import identity, pools
from doppel.functions.columns import col, numeric
from doppel.functions.money import MONEY, money
from doppel.functions.normal import add_norm_ppf, interp_grid, round_even
from doppel.functions.rng import cumulative, interval_pick, pick, uniform, uniform_int
from doppel.operators import generate
from doppel.operators.order_stats import (
    EXPLODE_CHUNK, MAX_BUCKETS, OrderPlan, bucket_of, cumulative_histogram, grid_quantiles, histogram, medians, plan_order,
    running_sums,
)

PRICE_POINTS = 50
SMALL_TABLE = 500       # value lists up to this size are drawn from a literal list; the draws are the same either way
LISTED_RATES = 1000     # distinct tax rates kept as a list; more stay a table
SPREAD = 1000           # a key of more than one in so many rows is looked up in several copies
# What is assumed of items without the columns to learn it from.
DEFAULT_QUANTITIES = [1, 2]
DEFAULT_PRICES = (10.0, 100.0)
HASH_BUCKET_ROWS = 2_000_000
PARENT_ROWS = 50_000    # parents put in order in one task, which also makes the rows of their children
EXPAND_TASKS = 4096
# Windows of generated dates and fallbacks of unlearned parts.
SIGNUP_FROM, SIGNUP_DAYS = date(2021, 1, 1), 1100
ORDER_FROM, ORDER_DAYS = date(2023, 1, 1), 700
DEFAULT_TAX = 0.08
DEFAULT_STATUS = [("completed", 65), ("shipped", 20), ("processing", 10), ("cancelled", 5)]
DEFAULT_CITIES = [("New York", 1), ("San Francisco", 1), ("Austin", 1), ("Chicago", 1)]

# The default set of linked tables.
TEMPLATE = {
    "name": "E-Commerce",
    "tables": [
        {
            "name": "customers",
            "columns": [
                {"name": "customer_id", "type": "id"},
                {"name": "name", "type": "name"},
                {"name": "email", "type": "email"},
                {"name": "phone", "type": "phone"},
                {"name": "city", "type": "address"},
                {"name": "signup_date", "type": "datetime", "stats": {"min": "2020-01-01", "max": "2024-12-31"}},
            ],
            "primary_key": "customer_id",
        },
        {
            "name": "orders",
            "columns": [
                {"name": "order_id", "type": "id"},
                {"name": "customer_id", "type": "fk", "references": "customers.customer_id"},
                {"name": "order_date", "type": "datetime", "stats": {"min": "2023-01-01", "max": "2024-12-31"}},
                {"name": "status", "type": "categorical", "stats": {"categories": {
                    "completed": 0.6, "processing": 0.2, "shipped": 0.15, "cancelled": 0.05}}},
                {"name": "discount", "type": "float", "stats": {"min": 0, "max": 50, "mean": 5, "std": 10}},
                {"name": "tax_rate", "type": "float", "stats": {"min": 0.05, "max": 0.12, "mean": 0.08, "std": 0.02}},
            ],
            "primary_key": "order_id",
            "parent_ratio": {"min": 1, "max": 5},
        },
        {
            "name": "order_items",
            "columns": [
                {"name": "item_id", "type": "id"},
                {"name": "order_id", "type": "fk", "references": "orders.order_id"},
                {"name": "product_name", "type": "product"},
                {"name": "category", "type": "category_pick"},
                {"name": "quantity", "type": "integer", "stats": {"min": 1, "max": 10, "mean": 2, "std": 2}},
                {"name": "unit_price", "type": "float", "stats": {"min": 5.0, "max": 500.0, "mean": 50, "std": 60}},
            ],
            "primary_key": "item_id",
            "parent_ratio": {"min": 1, "max": 4},
        },
    ],
}


# ---- learning ---------------------------------------------------------------

def fanout_histogram(children: DataFrame, fk: str) -> DataFrame:
    """value = children per parent, n = parents with that many (parents without children do not occur)."""
    per_parent = children.filter(col(fk).isNotNull()).groupBy(col(fk).alias("_p")).agg(F.count(F.lit(1)).alias("value"))
    return per_parent.groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def histogram_stats(hist: DataFrame) -> DataFrame:
    """mean, median, std (population), min, max of a value/n histogram, in one row."""
    whole = hist.select(F.lit("v").alias("column"), F.col("value").cast("double").alias("value"), "n")
    spread = whole.groupBy("column").agg(
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"),
        (F.sum(F.col("value") * F.col("value") * F.col("n")) / F.sum("n")).alias("square"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    middle = medians(cumulative_histogram(whole, OrderPlan(0), ["column"]), ["column"])
    return spread.join(middle, "column").select(
        round_even(F.col("mean"), 2).alias("mean"), "median",
        round_even(F.sqrt(F.greatest(F.col("square") - F.col("mean") * F.col("mean"), F.lit(0.0))), 2).alias("std"),
        F.col("min").cast("bigint").alias("min"), F.col("max").cast("bigint").alias("max"),
    )


def fanout_distribution(children: DataFrame, fk: str) -> DataFrame:
    return histogram_stats(fanout_histogram(children, fk))


def value_histogram(df: DataFrame, name: str) -> DataFrame:
    """value, n over non-null rows."""
    return df.filter(col(name).isNotNull()).groupBy(col(name).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def value_distribution(df: DataFrame, names: list[str]) -> DataFrame:
    """column, value, n, share of non-null rows, for every value; one shuffle for all columns."""
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), col(c).cast("string").alias("value")) for c in names
    ])).alias("p")).filter("p.value is not null")
    counts = long.groupBy("p.column", "p.value").agg(F.count(F.lit(1)).alias("n"))
    totals = F.broadcast(counts.groupBy("column").agg(F.sum("n").alias("total")))
    return counts.join(totals, "column").select("column", "value", "n", (F.col("n") / F.col("total")).alias("share"))


def _price_cdf(items: DataFrame, category: str, price: str, buckets: int | None = None) -> DataFrame:
    values = {"price": numeric(items, price)}
    kept = items.filter(col(category).isNotNull())
    plan = plan_order(kept, values, buckets, counted=True)
    hist = histogram(kept, values, {"category": col(category).cast("string")})
    return cumulative_histogram(hist, plan, ["column", "category"])


def price_quantiles(items: DataFrame, category: str = "category", price: str = "unit_price",
                    points: int = PRICE_POINTS, buckets: int | None = None) -> DataFrame:
    """category, i, q: equally spaced price quantiles of every category."""
    return grid_quantiles(_price_cdf(items, category, price, buckets), ["column", "category"], points).drop("column")


def price_by_category(items: DataFrame, category: str = "category", price: str = "unit_price",
                      buckets: int | None = None) -> DataFrame:
    """category, n, share, mean, median, std (population), min, max."""
    stats = items.filter(col(category).isNotNull()).groupBy(col(category).cast("string").alias("category")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(numeric(items, price)).alias("mean"), F.stddev_pop(numeric(items, price)).alias("std"),
        F.min(numeric(items, price)).alias("min"), F.max(numeric(items, price)).alias("max"),
    )
    total = F.broadcast(stats.agg(F.sum("n").alias("total")).withColumn("_k", F.lit(1)))
    middle = medians(_price_cdf(items, category, price, buckets), ["column", "category"]).drop("column")
    return stats.withColumn("_k", F.lit(1)).join(total, "_k").join(middle, "category", "left").select(
        "category", "n", (F.col("n") / F.col("total")).alias("share"),
        *[round_even(F.col(c), 2).alias(c) for c in ("mean", "median", "std", "min", "max")],
    )


def product_positions(items: DataFrame, category: str = "category", product: str = "product_name") -> DataFrame:
    """category, product, position (from 1) and size: the distinct products of each category in hash order.

    The hash is evenly spread, so equal slices of it cut a long category into
    parts of like size without looking at the data.
    """
    distinct = items.filter(col(category).isNotNull() & col(product).isNotNull()).select(
        col(category).cast("string").alias("category"), col(product).cast("string").alias("product")
    ).distinct()
    hashed = distinct.select("category", "product", uniform(0, "product", F.col("product")).alias("_h"), F.lit(1).alias("_one"))
    slices = max(1, -(-distinct.count() // HASH_BUCKET_ROWS))
    bucket = F.floor(F.col("_h") * slices).cast("int") if slices > 1 else None
    ordered = running_sums(hashed, ["category"], ["_h", "product"], {"position": "_one"}, bucket)
    return ordered.select("category", "product", "position", F.col("position_total").alias("size"))


@dataclass
class RelationalModel:
    """What was learned; frames stay distributed until they are drawn from."""

    orders_per_customer: DataFrame
    items_per_order: DataFrame
    quantity: DataFrame
    categories: DataFrame
    prices: DataFrame
    products: DataFrame | None
    status: DataFrame | None = None
    discount: DataFrame | None = None
    tax_rates: list[float] = field(default_factory=lambda: [DEFAULT_TAX])
    tax_table: DataFrame | None = None  # value, n, in place of the list
    city: DataFrame | None = None


def learn_relational(customers: DataFrame, orders: DataFrame, items: DataFrame) -> RelationalModel:
    """Learn from customers(customer_id, city), orders(order_id, customer_id, status, discount, tax_rate) and
    order_items(order_id, category, product_name, quantity, unit_price).

    Columns other than the keys may be missing: without a quantity it is 1 or 2, without a category or price all pool
    categories are equally likely at 10 to 100, with a product each.
    """
    def optional(df, name):
        return value_histogram(df, name) if name in df.columns else None

    spark = items.sparkSession
    rates, rate_table = [DEFAULT_TAX], None
    if "tax_rate" in orders.columns:
        found = orders.select(F.col("tax_rate").cast("double").alias("value")).filter("value is not null").distinct()
        some = [r["value"] for r in found.orderBy("value").limit(LISTED_RATES + 1).collect()]
        rates = some or rates
        if len(some) > LISTED_RATES:
            rate_table = found.withColumn("n", F.lit(1).cast("bigint"))

    def equal(values: list, kind: str) -> DataFrame:
        return spark.createDataFrame([(v, 1) for v in values], f"value {kind}, n bigint")

    if "quantity" in items.columns:
        quantity = value_histogram(items.select(numeric(items, "quantity").cast("bigint").alias("quantity")), "quantity")
        quantity = quantity if quantity.limit(1).count() else equal([1], "bigint")
    else:
        quantity = equal(DEFAULT_QUANTITIES, "bigint")
    if "category" in items.columns and "unit_price" in items.columns:
        categories, prices = value_histogram(items, "category"), price_quantiles(items)
        products = product_positions(items) if "product_name" in items.columns else None
    else:
        categories = equal(pools.CATEGORIES, "string")
        low, high = DEFAULT_PRICES
        grid = F.transform(F.sequence(F.lit(0), F.lit(PRICE_POINTS - 1)), lambda i: F.struct(
            i.cast("bigint").alias("i"), (F.lit(low) + F.lit(high - low) * i / F.lit(float(PRICE_POINTS - 1))).alias("q")))
        prices = categories.select(F.col("value").alias("category"), F.inline(grid))
        products = categories.select(F.col("value").alias("category"), F.concat("value", F.lit(" Product")).alias("product"),
                                     F.lit(1).cast("bigint").alias("position"), F.lit(1).cast("bigint").alias("size"))
    return RelationalModel(
        orders_per_customer=fanout_histogram(orders, "customer_id"), items_per_order=fanout_histogram(items, "order_id"),
        quantity=quantity, categories=categories, prices=prices, products=products,
        status=optional(orders, "status"), discount=optional(orders, "discount"), tax_rates=rates, tax_table=rate_table,
        city=optional(customers, "city"),
    )


def model_summary(model: RelationalModel) -> DataFrame:
    """metric, mean, median, std, min, max of the learned fan-outs and quantity."""
    parts = [(n, h) for n, h in (("orders_per_customer", model.orders_per_customer),
                                 ("items_per_order", model.items_per_order), ("quantity", model.quantity))]
    out = None
    for name, hist in parts:
        row = histogram_stats(hist).select(F.lit(name).alias("metric"), "*")
        out = row if out is None else out.unionByName(row)
    return out


# ---- drawing ------------------------------------------------------------------

def draw(df: DataFrame, u: str, table: DataFrame, out: str) -> DataFrame:
    """Add `out`: a value drawn from a value/n histogram by the uniform column u.

    Values stand in hash order and draws become row numbers of the source. A short histogram is a literal
    list; a long one is not collected, and an equi-join on slices of the row numbers finds the value that
    owns each. Both give the same rows.
    """
    hashed = table.select("value", "n", uniform(0, "draw", F.col("value")).alias("_h"))
    ordered = hashed.orderBy("_h", "value").limit(SMALL_TABLE + 1).collect()
    if not ordered:
        return df.withColumn(out, F.lit(None).cast(table.schema["value"].dataType))
    if len(ordered) <= SMALL_TABLE:
        ends = list(accumulate(r["n"] for r in ordered))
        place = F.least(F.floor(F.col(u) * F.lit(float(ends[-1]))), F.lit(ends[-1] - 1))
        return df.withColumn(out, interval_pick([r["value"] for r in ordered], ends, place))
    sizes = table.agg(F.sum("n").alias("t"), F.count(F.lit(1)).alias("rows")).first()
    total, slices = sizes["t"], -(-sizes["rows"] // HASH_BUCKET_ROWS)
    # Hash order spreads the values evenly over the slices of the running sum.
    ranked = hashed.select(F.lit("v").alias("column"), "value", "n", "_h")
    bucket = F.floor(F.col("_h") * slices).cast("int") if slices > 1 else None
    cum = running_sums(ranked, ["column"], ["_h", "value"], {"upto": "n"}, bucket, few_keys=True)
    # About as many slices as values, so a slice holds a few values and an even share of the draws.
    size = max(1, total // sizes["rows"])
    spans = cum.select("value", (F.col("upto") - F.col("n")).alias("_from"), F.col("upto").alias("_to")).withColumn(
        "_slice", F.explode(F.sequence(F.expr(f"_from div {size}"), F.expr(f"(_to - 1) div {size}")))
    )
    at = F.least(F.floor(F.col(u) * F.lit(float(total))), F.lit(total - 1))
    asked = df.withColumn("_at", at.cast("bigint")).withColumn("_slice", F.expr(f"_at div {size}"))
    hit = asked.join(spans, "_slice").filter("_at >= _from and _at < _to")
    return hit.select(*df.columns, F.col("value").alias(out))


def spread_lookup(df: DataFrame, table: DataFrame, keys: list[str], share: str, row: str, copies: int = SPREAD) -> DataFrame:
    """Left join with a table of one row a key, where few keys may hold nearly all rows of df.

    `share` is the part of the rows a key is expected to hold. A key with more than 1/copies of them, of which there are at most
    `copies`, stands in the table as often as its share says, and each row takes one of these by a hash of its `row` id.
    """
    wanted = F.greatest(F.lit(1), F.ceil(F.col(share) * copies)).cast("bigint")
    hot = table.filter(F.col(share) * copies > 1).select(*keys, wanted.alias("_k"))
    marked = df.join(F.broadcast(hot), keys, "left").withColumn("_copy", F.coalesce(F.pmod(F.xxhash64(row), F.col("_k")), F.lit(0))).drop("_k")
    there = table.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("bigint"), wanted - 1))).drop(share)
    return marked.join(there, [*keys, "_copy"], "left").drop("_copy")


def expand_children(parents: DataFrame, parent_id: str, count: str, child_id: str, buckets: int | None = None) -> DataFrame:
    """One row per child with a dense id from 1 in parent order: child_id, the parent columns, `position`.

    Parents are written once, as several passes read them, and put in order in ranges of about PARENT_ROWS: children are made where
    their parents lie. A parent with very many children is cut into runs that are spread over tasks.
    """
    parents = stored(parents)
    wanted = buckets or min(MAX_BUCKETS, -(-parents.count() // PARENT_ROWS))
    plan = plan_order(parents, {"id": col(parent_id).cast("double")}, wanted)
    bucket = bucket_of(F.lit("id"), col(parent_id).cast("double"), plan.bounds) if plan.bounds["id"] else None
    keyed = parents.withColumn("_all", F.lit(0))
    placed = running_sums(keyed, ["_all"], [parent_id], {"_upto": count}, bucket, few_keys=True, tasks=min(wanted, EXPAND_TASKS)).withColumn("_before", F.col("_upto") - col(count))
    placed = placed.drop("_all", "_upto", "_upto_total").filter(col(count) > 0)
    long = col(count) > EXPLODE_CHUNK
    few = placed.filter(~long).withColumn("position", F.explode(F.sequence(F.lit(1).cast("bigint"), col(count).cast("bigint"))))
    cut = placed.filter(long).withColumn(
        "_from", F.explode(F.sequence(F.lit(1).cast("bigint"), col(count).cast("bigint"), F.lit(EXPLODE_CHUNK).cast("bigint")))
    ).repartition(parent_id, "_from")
    many = cut.withColumn("position", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + EXPLODE_CHUNK - 1, col(count).cast("bigint")))))
    rows = few.unionByName(many.drop("_from"))
    return rows.select((F.col("_before") + F.col("position")).cast("bigint").alias(child_id),
                       *[col(c) for c in parents.columns if c != count], "position")


def generate_customers(ids: DataFrame, model: RelationalModel, seed: int = 42, locale: str = "en_US") -> DataFrame:
    """customer_id, name, email, phone, city, signup_date for ids in column `id`."""
    rid = F.col("id")
    base = ids.select(rid, identity.person_name(seed, "customer", rid, locale).alias("name"),
                      uniform(seed, "customer:city", rid).alias("_uc"))
    if model.city is None:
        base = base.withColumn("city", interval_pick([c for c, _ in DEFAULT_CITIES], cumulative([n for _, n in DEFAULT_CITIES]), F.col("_uc")))
    else:
        base = draw(base, "_uc", model.city, "city")
    mail = F.concat(F.replace(F.lower("name"), F.lit(" "), F.lit(".")), rid.cast("string"), F.lit("@"),
                    pick(pools.CUSTOMER_DOMAINS, uniform(seed, "customer:domain", rid)))
    day = F.date_add(F.lit(SIGNUP_FROM), uniform_int(uniform(seed, "customer:day", rid), 0, SIGNUP_DAYS).cast("int"))
    return base.select(rid.cast("bigint").alias("customer_id"), "name", mail.alias("email"),
                       identity.phone(seed, "customer", rid, locale).alias("phone"), "city", day.alias("signup_date"))


def generate_orders(customers: DataFrame, model: RelationalModel, seed: int = 42) -> DataFrame:
    """order_id, customer_id, order_date, status, discount, tax_rate; fan-out drawn per customer."""
    counted = draw(customers.select("customer_id", uniform(seed, "orders:count", F.col("customer_id")).alias("_u")),
                   "_u", model.orders_per_customer, "_n").select("customer_id", F.greatest("_n", F.lit(1)).cast("bigint").alias("_n"))
    rows = expand_children(counted, "customer_id", "_n", "order_id")
    rid = F.col("order_id")
    rows = rows.select(rid, "customer_id", *[uniform(seed, f"order:{s}", rid).alias(f"_{s}") for s in ("day", "status", "discount", "tax")])
    if model.status is None:
        rows = rows.withColumn("status", interval_pick([s for s, _ in DEFAULT_STATUS], cumulative([n for _, n in DEFAULT_STATUS]), F.col("_status")))
    else:
        rows = draw(rows, "_status", model.status, "status")
    rows = rows.withColumn("discount", F.lit(0.0)) if model.discount is None else draw(rows, "_discount", model.discount, "discount")
    tax = pick(model.tax_rates, F.col("_tax"))
    if model.tax_table is not None:
        rows, tax = draw(rows, "_tax", model.tax_table, "_rate"), F.col("_rate")
    return rows.select(
        "order_id", "customer_id",
        F.date_add(F.lit(ORDER_FROM), uniform_int(F.col("_day"), 0, ORDER_DAYS).cast("int")).alias("order_date"),
        "status", money(F.col("discount")).alias("discount"), tax.alias("tax_rate"),
    )


def generate_items(orders: DataFrame, model: RelationalModel, seed: int = 42) -> DataFrame:
    """item_id, order_id, product_name, category, quantity, unit_price, line_total."""
    counted = draw(orders.select("order_id", uniform(seed, "items:count", F.col("order_id")).alias("_u")),
                   "_u", model.items_per_order, "_n").select("order_id", F.greatest("_n", F.lit(1)).cast("bigint").alias("_n"))
    rows = expand_children(counted, "order_id", "_n", "item_id")
    rid = F.col("item_id")
    rows = rows.select(rid, "order_id", *[uniform(seed, f"item:{s}", rid).alias(f"_{s}") for s in ("category", "product", "quantity", "price")])
    categories = stored(model.categories)
    rows = draw(draw(rows, "_category", categories, "category"), "_quantity", model.quantity, "quantity")
    total = categories.agg(F.sum("n")).first()[0] or 1
    shares = categories.select(F.col("value").alias("category"), (F.col("n") / F.lit(float(total))).alias("_share"))
    about = shares.join(model.prices.groupBy("category").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "q"))), lambda t: t["q"]).alias("_t")), "category", "left")
    products = None if model.products is None else stored(model.products)
    if products is not None:
        about = about.join(products.select("category", "size").distinct(), "category", "left")
    about = stored(about)  # one row a category
    rows = spread_lookup(rows, about, ["category"], "_share", "item_id")
    price = F.coalesce(round_even(interp_grid(F.col("_price"), F.col("_t"), PRICE_POINTS), 2), F.lit(50.0))
    if products is not None:
        rows = rows.withColumn("_pos", F.floor(F.col("_product") * F.col("size")) + 1)
        named = stored(products.join(about.select("category", "_share"), "category").select(
            "category", F.col("position").alias("_pos"), F.col("product").alias("product_name"), (F.col("_share") / F.col("size")).alias("_share")))
        rows = spread_lookup(rows, named, ["category", "_pos"], "_share", "item_id")
    else:
        rows = rows.withColumn("product_name", F.lit(None).cast("string"))
    name = F.coalesce("product_name", F.concat("category", F.lit(" Item")))
    made = rows.select("item_id", "order_id", name.alias("product_name"), "category",
                       F.greatest("quantity", F.lit(1)).cast("bigint").alias("quantity"), price.alias("_p"))
    return made.select("item_id", "order_id", "product_name", "category", "quantity", money(F.col("_p")).alias("unit_price"),
                       (F.col("quantity") * money(F.col("_p"))).cast(MONEY).alias("line_total"))


def reconcile_totals(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders with subtotal, capped discount, tax_amount and order_total in exact cents."""
    sums = items.groupBy("order_id").agg(F.sum(F.col("line_total").cast(MONEY)).alias("_sum"))
    extra = [c for c in orders.columns if c not in ("order_id", "discount", "tax_rate", "subtotal", "tax_amount", "order_total")]
    sub = F.coalesce(F.col("_sum"), F.lit(0)).cast(MONEY)
    rows = orders.join(sums, "order_id", "left").select(
        "order_id", *extra, sub.alias("subtotal"),
        F.least(F.greatest(F.col("discount").cast(MONEY), F.lit(0).cast(MONEY)), sub).alias("discount"), "tax_rate",
    )
    tax = F.bround((F.col("subtotal") - F.col("discount")) * F.col("tax_rate").cast("decimal(9,6)"), 2).cast(MONEY)
    return rows.withColumn("tax_amount", tax).withColumn(
        "order_total", (F.col("subtotal") - F.col("discount") + F.col("tax_amount")).cast(MONEY)
    )


def generate_learned(ids: DataFrame, model: RelationalModel, seed: int = 42, locale: str = "en_US") -> dict[str, DataFrame]:
    """customers, orders and order_items with the learned fan-outs; keys hold and totals add up by construction."""
    customers = generate_customers(ids, model, seed, locale)
    orders = generate_orders(customers, model, seed)
    items = generate_items(orders, model, seed)
    return {"customers": customers, "orders": reconcile_totals(orders, items), "order_items": items}


def _template_column(c: dict, table: str, rid: Column, seed: int, locale: str) -> tuple[Column, Column | None]:
    """(value, draw): the draw is projected first as _u_<name>, numbers use _z_<name>."""
    name, kind, stats = c["name"], c.get("type", "text"), c.get("stats") or {}
    stream = f"{table}:{name}"
    u, z = F.col(f"_u_{name}"), F.col(f"_z_{name}")
    if kind == "datetime":
        return generate.time(u, stats).cast("date"), uniform(seed, stream, rid)
    if kind == "categorical":
        shares = stats.get("categories") or {"A": 1, "B": 1, "C": 1}
        return interval_pick(list(shares), cumulative(list(shares.values())), u), uniform(seed, stream, rid)
    if kind in ("integer", "float"):
        defaults = {"mean": 5, "std": 2, "min": 1, "max": 10} if kind == "integer" else {"mean": 50, "std": 25, "min": 0, "max": 100}
        mean, std, low, high = (float(stats.get(k, defaults[k])) for k in ("mean", "std", "min", "max"))
        x = F.greatest(F.lit(low), F.least(F.lit(high), F.lit(mean) + F.lit(max(std, 0.1 if kind == "integer" else 0.01)) * z))
        return (round_even(x).cast("bigint") if kind == "integer" else round_even(x, 2)), uniform(seed, stream, rid)
    if kind == "product":
        return pick(pools.PRODUCTS, u), uniform(seed, stream, rid)
    if kind == "category_pick":
        return pick(pools.CATEGORIES, u), uniform(seed, stream, rid)
    if kind == "address":
        return identity.city(seed, stream, rid, locale), None
    return identity.identity(kind, seed, stream, rid, None, locale), None


def generate_template(ids: DataFrame, template: dict | None = None, seed: int = 42, locale: str = "en_US") -> dict[str, DataFrame]:
    """All tables of a template, parents before children; ids of the root tables come from column `id`."""
    todo = list((template or TEMPLATE)["tables"])
    made: dict[str, DataFrame] = {}
    keys: dict[str, str] = {}
    while todo:
        ready = [t for t in todo if all(
            c["references"].split(".")[0] in made or c["references"].split(".")[0] not in {x["name"] for x in todo}
            for c in t["columns"] if c.get("type") == "fk" and "references" in c)]
        if not ready:
            raise ValueError("the references of the template form a circle")
        for t in ready:
            todo.remove(t)
            name, pk = t["name"], t.get("primary_key", f"{t['name']}_id")
            links = [(c["name"], c["references"].split(".")[0]) for c in t["columns"] if c.get("type") == "fk" and "references" in c]
            ratio = t.get("parent_ratio")
            first = links[0] if ratio and links and links[0][1] in made else None
            if first:
                fk, parent = first
                key = F.col(keys[parent])
                counted = made[parent].select(key.alias(fk), uniform_int(
                    uniform(seed, f"{name}:count", key), ratio["min"], ratio["max"] + 1).alias("_n"))
                base = expand_children(counted, fk, "_n", "_rid").drop("position")
            else:
                base = ids.select(F.col("id").cast("bigint").alias("_rid"))
            draws, normals, values = {}, {}, []
            for c in t["columns"]:
                if c.get("type") == "id":
                    values.append(F.col("_rid").alias(c["name"]))
                elif c.get("type") == "fk" and first and c["name"] == first[0]:
                    values.append(F.col(c["name"]))
                elif c.get("type") == "fk":
                    # A further parent: its ids are 1..n, so an equally likely id needs only n.
                    parent = c.get("references", "").split(".")[0]
                    n = made[parent].count() if parent in made else None
                    v = uniform_int(uniform(seed, f"{name}:{c['name']}", F.col("_rid")), 1, n + 1) if n else F.col("_rid")
                    values.append(v.alias(c["name"]))
                else:
                    value, u = _template_column(c, name, F.col("_rid"), seed, locale)
                    if u is not None:
                        draws[f"_u_{c['name']}"] = u
                    if c.get("type") in ("integer", "float"):
                        normals[f"_z_{c['name']}"] = f"_u_{c['name']}"
                    values.append(value.alias(c["name"]))
            rows = base.withColumns(draws) if draws else base
            made[name] = add_norm_ppf(rows, normals).select(*values)
            keys[name] = pk
    if {"orders", "order_items"} <= set(made):
        items, orders = made["order_items"], made["orders"]
        if {"quantity", "unit_price"} <= set(items.columns):
            items = items.withColumn("unit_price", money(F.col("unit_price")))
            items = items.withColumn("line_total", (F.col("quantity").cast("decimal(10,0)") * F.col("unit_price")).cast(MONEY))
        if {"order_id", "line_total"} <= set(items.columns):
            if "discount" not in orders.columns:
                orders = orders.withColumn("discount", F.lit(0.0))
            if "tax_rate" not in orders.columns:
                orders = orders.withColumn("tax_rate", F.lit(DEFAULT_TAX))
            orders = reconcile_totals(orders.withColumn("discount", money(F.col("discount"))), items)
        made["orders"], made["order_items"] = orders, items
    return made


def generate_relational(ids: DataFrame, template: dict | None = None, model: RelationalModel | None = None, seed: int = 42,
                        locale: str = "en_US") -> dict[str, DataFrame]:
    """Learned tables when there is a model, else the tables of the template."""
    return generate_learned(ids, model, seed, locale) if model is not None else generate_template(ids, template, seed, locale)


# ---- comparing ------------------------------------------------------------------

def compare_relational(real: dict[str, DataFrame], synth: dict[str, DataFrame]) -> DataFrame:
    """metric, real_/synth_ mean, median, std, min, max for fan-outs and quantity."""
    def stats(tables, name):
        hist = {
            "orders_per_customer": lambda: fanout_histogram(tables["orders"], "customer_id"),
            "items_per_order": lambda: fanout_histogram(tables["order_items"], "order_id"),
            "quantity": lambda: value_histogram(tables["order_items"], "quantity"),
        }[name]()
        return histogram_stats(hist)

    out = None
    for name in ("orders_per_customer", "items_per_order", "quantity"):
        pair = [stats(t, name).select(F.lit(name).alias("metric"), *[F.col(c).alias(f"{w}_{c}") for c in ("mean", "median", "std", "min", "max")])
                for t, w in ((real, "real"), (synth, "synth"))]
        row = pair[0].join(F.broadcast(pair[1]), "metric")
        out = row if out is None else out.unionByName(row)
    return out


def compare_prices(real_items: DataFrame, synth_items: DataFrame) -> DataFrame:
    """Per category on both sides: real_/synth_ mean, median, std, min, max, and the gap of the unrounded means."""
    def side(items, w):
        stats = price_by_category(items).select("category", *[F.col(c).alias(f"{w}_{c}") for c in ("mean", "median", "std", "min", "max")])
        raw = items.groupBy(F.col("category").cast("string").alias("category")).agg(F.avg(numeric(items, "unit_price")).alias(f"_{w}"))
        return stats.join(raw, "category")

    both = side(real_items, "real").join(side(synth_items, "synth"), "category")
    return both.withColumn("diff_mean", round_even(F.abs(F.col("_synth") - F.col("_real")), 2)).drop("_real", "_synth")
