"""Linked tables: customer, orders and lineitem with part stand for customers, orders and order items."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import SEED, pick, rnd, s, table, u, wide
from catalog.generate import int_sql, name_sql, phone_sql
from doppel.functions import pools
from doppel.operators import integrity, relational

TAX_RATES = [0.05, 0.08, 0.1]


def customers(spark, d):
    cities = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("city"))
    return table(spark, d, "customer").join(F.broadcast(cities), "c_nationkey").select(F.col("c_custkey").alias("customer_id"), "city")


def orders(spark, d):
    rate = F.element_at(F.array(*[F.lit(r) for r in TAX_RATES]), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderstatus").alias("status"),
        (F.rint((F.col("o_totalprice") % 50) * 100.0) / 100.0).alias("discount"), rate.alias("tax_rate"),
    )


def items(spark, d):
    part = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category"),
                                          F.col("p_name").alias("product_name"))
    price = F.rint(F.col("l_extendedprice") / F.col("l_quantity") * 100.0) / 100.0
    return table(spark, d, "lineitem").select("l_partkey", F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("quantity"),
                                              price.alias("unit_price")).join(part, "l_partkey").drop("l_partkey")


CUSTOMERS = "(select c_custkey as customer_id, n_name as city from customer join nation on n_nationkey = c_nationkey)"
ORDERS = ("(select o_orderkey as order_id, o_custkey as customer_id, o_orderstatus as status, "
          "round_even((o_totalprice % 50) * 100.0::double, 0) / 100.0::double as discount, ([0.05, 0.08, 0.1])[o_orderkey % 3 + 1]::double as tax_rate from orders)")
ITEMS = ("(select l_orderkey as order_id, l_quantity as quantity, p_type as category, p_name as product_name, "
         "round_even(l_extendedprice / l_quantity * 100.0::double, 0) / 100.0::double as unit_price "
         "from lineitem join part on p_partkey = l_partkey)")


def fan_sql(src: str, key: str) -> str:
    return f"(select value, count(*) as n from (select count(*) as value from {src} where {key} is not null group by {key}) group by 1)"


def values_sql(src: str, c: str) -> str:
    return f"(select {c} as value, count(*) as n from {src} where {c} is not null group by 1)"


def stats_sql(src: str, c: str) -> str:
    """mean, median, std, min, max of a column."""
    return (f"select {rnd(f'avg({c})', 2)} as mean, median({c})::double as median, {rnd(f'stddev_pop({c})', 2)} as std, "
            f"min({c})::bigint as min, max({c})::bigint as max from {src}")


def counts_of(src: str, key: str) -> str:
    return f"(select count(*) as k from {src} group by {key})"


def drawn(rows: str, x: str, hist: str, out: str) -> str:
    """rows with `out` drawn from a value/n histogram by column x, values in hash order."""
    return f"""(select r.* exclude ({x}), h.value as {out} from {rows} r join (
        select value, sum(n) over w - n as lo, sum(n) over w as hi, sum(n) over () as total
        from {hist} window w as (order by {u('draw', 'value', seed=0)}, value)) h
        on least(floor(r.{x} * h.total::double), h.total - 1) >= h.lo and least(floor(r.{x} * h.total::double), h.total - 1) < h.hi)"""


IDS = "(select c_custkey + 1 as id from customer)"
CUSTOMER_GEN = f"""(select id as customer_id, name, replace(lower(name), ' ', '.') || id || '@' || {pick(pools.CUSTOMER_DOMAINS, u('customer:domain', 'id'))} as email,
    {phone_sql('customer', 'id')} as phone, city,
    strftime(date '2021-01-01' + {int_sql(u('customer:day', 'id'), 0, 1100)}::integer, '%Y-%m-%d') as signup_date
    from {drawn(f"(select id, {name_sql('customer', 'id')} as name, {u('customer:city', 'id')} as x from {IDS})", 'x', values_sql(CUSTOMERS, 'city'), 'city')})"""


def expanded(counted: str, parent: str, child: str) -> str:
    return (f"(select upto - k + unnest(range(1, k + 1)) as {child}, {parent} from "
            f"(select *, sum(k) over (order by {parent})::bigint as upto from (select {parent}, greatest(n, 1)::bigint as k from {counted})))")


ORDER_ROWS = expanded(drawn(f"(select id as customer_id, {u('orders:count', 'id')} as x from {IDS})", "x", fan_sql(ORDERS, "customer_id"), "n"),
                      "customer_id", "order_id")
_O1 = (f"(select order_id, customer_id, {u('order:day', 'order_id')} as d, {u('order:status', 'order_id')} as x, "
       f"{u('order:discount', 'order_id')} as y, {u('order:tax', 'order_id')} as t from {ORDER_ROWS})")
ORDER_GEN = f"""(select order_id, customer_id, strftime(date '2023-01-01' + {int_sql('d', 0, 700)}::integer, '%Y-%m-%d') as order_date, status,
    discount::decimal(18,2) as discount, ([0.05, 0.08, 0.1])[cast(floor(t * 3.0::double) as bigint) + 1]::double as tax_rate
    from {drawn(drawn(_O1, 'x', values_sql(ORDERS, 'status'), 'status'), 'y', values_sql(ORDERS, 'discount'), 'discount')})"""
ITEM_ROWS = expanded(drawn(f"(select order_id, {u('items:count', 'order_id')} as x from {ORDER_ROWS})", "x", fan_sql(ITEMS, "order_id"), "n"),
                     "order_id", "item_id")
_I1 = (f"(select item_id, order_id, {u('item:category', 'item_id')} as x, {u('item:product', 'item_id')} as p, "
       f"{u('item:quantity', 'item_id')} as q, {u('item:price', 'item_id')} * 49.0::double as a from {ITEM_ROWS})")
GRID50 = "[" + ", ".join(repr(i / 49) for i in range(50)) + "]"
PRODUCTS = (f"(select category, product, row_number() over (partition by category order by {u('product', 'product', seed=0)}, product) as position, "
            f"count(*) over (partition by category) as size from (select distinct category, product_name as product from {ITEMS}))")
ITEM_GEN = f"""(select item_id, order_id, product as product_name, i.category, quantity, unit_price, quantity * unit_price as line_total from (
    select i.*, z.size, {rnd('t.q[g + 1] + (t.q[g + 2] - t.q[g + 1]) * (a - g)', 2)}::decimal(18,2) as unit_price,
           cast(floor(p * z.size) as bigint) + 1 as position from
      (select *, least(floor(a), 48)::bigint as g, greatest(qv, 1)::bigint as quantity
       from {drawn(drawn(_I1, 'x', values_sql(ITEMS, 'category'), 'category'), 'q', values_sql(f'(select quantity::bigint as quantity from {ITEMS})', 'quantity'), 'qv')}) i
      join (select category, quantile_cont(unit_price, {GRID50}) as q from {ITEMS} group by 1) t on t.category = i.category
      join (select distinct category, size from {PRODUCTS}) z on z.category = i.category) i
    join {PRODUCTS} w on w.category = i.category and w.position = i.position)"""


def _cents(x: str) -> str:
    return f"cast(round({x} * 100) as bigint)"


RECONCILED = f"""(select *, (net_c + tax_c) as total_c from (
    select *, sub_c - disc_c as net_c, prod // 1000000 + case when prod % 1000000 > 500000 or (prod % 1000000 = 500000 and (prod // 1000000) % 2 = 1)
           then 1 else 0 end as tax_c from (
      select o.*, coalesce(sub, 0) as sub_c, least({_cents('o.discount')}, coalesce(sub, 0)) as disc_c,
             (coalesce(sub, 0) - least({_cents('o.discount')}, coalesce(sub, 0))) * cast(round(tax_rate * 1000000) as bigint) as prod
      from {{orders}} o left join (select order_id, sum({_cents('line_total')})::bigint as sub from {{items}} group by 1) i using (order_id))))"""
TOTALS = ("sub_c / 100.0::double as subtotal, disc_c / 100.0::double as discount, tax_c / 100.0::double as tax_amount, "
          "total_c / 100.0::double as order_total")
MONEY = ["subtotal", "discount", "tax_amount", "order_total"]


def as_double(df, names):
    return df.withColumns({c: F.col(c).cast("double") for c in names})


def model(spark, d):
    return relational.learn_relational(customers(spark, d), orders(spark, d), items(spark, d))


def partial_model(spark, d):
    """Learned from tables that hold little more than their keys."""
    return relational.learn_relational(customers(spark, d).select("customer_id"), orders(spark, d).select("order_id", "customer_id"),
                                       items(spark, d).select("order_id"))


def partial_rows(spark, d):
    """Rows drawn from the model of partial tables, by the quantities, prices and categories it assumes: one row with counts."""
    made = relational.generate_learned(ids(spark, d), partial_model(spark, d), SEED)["order_items"]
    return made.agg(F.min("quantity").alias("least"), F.max("quantity").alias("most"),
                    F.count_if(~F.col("unit_price").between(10, 100)).alias("odd_prices"),
                    F.count_if(F.col("product_name") != F.concat("category", F.lit(" Product"))).alias("odd_names"))


def ids(spark, d):
    return wide(spark, d, "customer").select((F.col("c_custkey") + 1).alias("id"))


def made_customers(spark, d):
    out = relational.generate_customers(ids(spark, d), model(spark, d), SEED)
    return out.withColumn("signup_date", F.date_format("signup_date", "yyyy-MM-dd"))


def made_orders(spark, d):
    out = relational.generate_learned(ids(spark, d), model(spark, d), SEED)["orders"]
    return as_double(out.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd")), MONEY)


def made_items(spark, d):
    return as_double(relational.generate_learned(ids(spark, d), model(spark, d), SEED)["order_items"], ["unit_price", "line_total"])


def children(spark, d):
    """As many children per customer as the key says, the ids dense over all customers."""
    parents = table(spark, d, "customer").select("c_custkey", (F.col("c_custkey") % 7).alias("k"))
    return relational.expand_children(parents, "c_custkey", "k", "child_id", buckets=8)


def reconciled(spark, d):
    head = orders(spark, d).withColumn("discount", F.col("discount") * 100)
    lines = items(spark, d).select("order_id", (F.col("quantity").cast("decimal(10,0)") * F.col("unit_price").cast("decimal(18,2)")).alias("line_total"))
    return as_double(relational.reconcile_totals(head, lines).drop("customer_id", "status"), MONEY)


def template_report(spark, d):
    made = relational.generate_relational(ids(spark, d), seed=SEED)
    return integrity.validate_relational(made, [
        ("orders", "customer_id", "customers", "customer_id"), ("order_items", "order_id", "orders", "order_id")])


def template_rows(spark, d):
    made = relational.generate_template(ids(spark, d), None, SEED)["orders"]
    return as_double(made.withColumn("order_date", F.date_format("order_date", "yyyy-MM-dd")), MONEY)


def cohort(spark, d, rest):
    even = F.col("order_id") % 2 == rest
    return {"orders": orders(spark, d).filter(even), "order_items": items(spark, d).filter(even)}


def compared(spark, d):
    return relational.compare_relational(cohort(spark, d, 0), cohort(spark, d, 1))


def compared_sql() -> str:
    parts = []
    for name, key, src in (("orders_per_customer", "customer_id", ORDERS), ("items_per_order", "order_id", ITEMS), ("quantity", None, ITEMS)):
        side = []
        for rest in (0, 1):
            rows = f"(select * from {src} where order_id % 2 = {rest})"
            side.append(stats_sql(counts_of(rows, key), "k") if key else stats_sql(rows, "quantity"))
        fields = ", ".join(f"{a}.{c} as {w}_{c}" for c in ("mean", "median", "std", "min", "max") for a, w in (("a", "real"), ("b", "synth")))
        parts.append(f"select {s(name)} as metric, {fields} from ({side[0]}) a, ({side[1]}) b")
    return " union all ".join(parts)


PRICE_STATS = [("avg", "mean"), ("median", "median"), ("stddev_pop", "std"), ("min", "min"), ("max", "max")]


def prices_sql(src: str) -> str:
    return ("select category, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as share, "
            + ", ".join(f"{rnd(f'{f}(unit_price)', 2)} as {c}" for f, c in PRICE_STATS) + f" from {src} group by category")


def compare_prices_sql() -> str:
    side = [f"(select category, avg(unit_price) as raw, {', '.join(f'{rnd(f'{f}(unit_price)', 2)} as {c}' for f, c in PRICE_STATS)} "
            f"from {ITEMS} where order_id % 2 = {r} group by category)" for r in (0, 1)]
    fields = ", ".join(f"{a}.{c} as {w}_{c}" for _, c in PRICE_STATS for a, w in (("a", "real"), ("b", "synth")))
    return f"select category, {fields}, {rnd('abs(b.raw - a.raw)', 2)} as diff_mean from {side[0]} a join {side[1]} b using (category)"


def shares(spark, d):
    o = relational.value_distribution(orders(spark, d), ["status", "tax_rate"])
    i = relational.value_distribution(items(spark, d), ["quantity"])
    c = relational.value_distribution(customers(spark, d), ["city"])
    return o.unionByName(i).unionByName(c).withColumn("share", F.round("share", 9))


SHARES_SQL = " union all ".join(
    f'select {s(c)} as "column", {c}::varchar as value, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as share from {src} group by {c}'
    for src, c in ((ORDERS, "status"), (ORDERS, "tax_rate"), (ITEMS, "quantity"), (CUSTOMERS, "city")))

QUERIES = {
    "fanout_distribution": lambda sp, d: relational.fanout_distribution(orders(sp, d), "customer_id").withColumn("link", F.lit("orders")).unionByName(
        relational.fanout_distribution(items(sp, d), "order_id").withColumn("link", F.lit("items"))),
    "fanout_histogram": lambda sp, d: relational.fanout_histogram(items(sp, d), "order_id"),
    "value_distribution": shares,
    "price_by_category": lambda sp, d: relational.price_by_category(items(sp, d), buckets=8).withColumn("share", F.round("share", 9)),
    "price_quantiles": lambda sp, d: relational.price_quantiles(items(sp, d), buckets=8).withColumn("q", F.round("q", 6)),
    "product_positions": lambda sp, d: relational.product_positions(items(sp, d)),
    "learn_relational": lambda sp, d: relational.model_summary(model(sp, d)),
    "learn_relational_partial": lambda sp, d: relational.model_summary(partial_model(sp, d)),
    "generate_relational_partial": partial_rows,
    "generate_customers": made_customers,
    "expand_children": children,
    "generate_items": made_items,
    "generate_orders": made_orders,
    "reconcile_totals": reconciled,
    "generate_relational": template_report,
    "generate_relational_template": template_rows,
    "compare_relational": compared,
    "compare_prices": lambda sp, d: relational.compare_prices(items(sp, d).filter("order_id % 2 = 0"), items(sp, d).filter("order_id % 2 = 1")),
}

ORACLES = {
    "fanout_distribution": f"select 'orders' as link, * from ({stats_sql(counts_of(ORDERS, 'customer_id'), 'k')}) "
                           f"union all select 'items', * from ({stats_sql(counts_of(ITEMS, 'order_id'), 'k')})",
    "fanout_histogram": f"select * from {fan_sql(ITEMS, 'order_id')}",
    "value_distribution": SHARES_SQL,
    "price_by_category": prices_sql(ITEMS),
    "price_quantiles": f"""select category, unnest(range(50))::bigint as i,
        unnest(list_transform(quantile_cont(unit_price, {GRID50}), lambda q: round(q, 6))) as q from {ITEMS} group by category""",
    "product_positions": f"select * from {PRODUCTS}",
    "learn_relational": f"""select 'orders_per_customer' as metric, * from ({stats_sql(counts_of(ORDERS, 'customer_id'), 'k')})
        union all select 'items_per_order', * from ({stats_sql(counts_of(ITEMS, 'order_id'), 'k')})
        union all select 'quantity', * from ({stats_sql(ITEMS, 'quantity')})""",
    "learn_relational_partial": f"""select 'orders_per_customer' as metric, * from ({stats_sql(counts_of(ORDERS, 'customer_id'), 'k')})
        union all select 'items_per_order', * from ({stats_sql(counts_of(ITEMS, 'order_id'), 'k')})
        union all select 'quantity', * from ({stats_sql('(select unnest([1, 2]) as quantity)', 'quantity')})""",
    "generate_customers": f"select * from {CUSTOMER_GEN}",
    "expand_children": """select upto - k + unnest(range(1, k + 1)) as child_id, c_custkey, unnest(range(1, k + 1)) as position
        from (select c_custkey, c_custkey % 7 as k, sum(c_custkey % 7) over (order by c_custkey)::bigint as upto from customer)""",
    "generate_items": f"select * replace (unit_price::double as unit_price, line_total::double as line_total) from {ITEM_GEN}",
    "generate_orders": f"select order_id, customer_id, order_date, status, tax_rate, {TOTALS} "
                       f"from {RECONCILED.format(orders=ORDER_GEN, items=ITEM_GEN)}",
    "reconcile_totals": f"select order_id, tax_rate, {TOTALS} from "
                        + RECONCILED.format(orders=f"(select * replace (discount * 100 as discount) from {ORDERS})",
                                            items=f"(select order_id, quantity::bigint * unit_price::decimal(18,2) as line_total from {ITEMS})"),
    "generate_relational": """select 'orphans:orders.customer_id->customers.customer_id' as "check", true as valid, 0::bigint as failures
        union all select 'orphans:order_items.order_id->orders.order_id', true, 0::bigint
        union all select 'order_totals', true, 0::bigint""",
    "compare_relational": compared_sql(),
    "compare_prices": compare_prices_sql(),
}
