"""Key, total and balance checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import table
from doppel.functions.money import money
from doppel.operators import integrity

LINKS = [
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("lineitem", "l_partkey", "part", "p_partkey"),
    ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("customer", "c_nationkey", "nation", "n_nationkey"),
    ("supplier", "s_nationkey", "nation", "n_nationkey"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
    ("events", "user_id", "customer", "c_custkey"),
    ("labels", "doc_id", "documents", "doc_id"),
]


def order_lines(spark, d):
    """lineitem as order_items: the unit price is the extended price over the quantity, in cents."""
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_quantity").alias("quantity"),
        (F.rint(F.col("l_extendedprice") / F.col("l_quantity") * 100.0) / 100.0).alias("unit_price"),
    )


def stated_orders(spark, d):
    """An order header with totals; headers of every 13th and 17th order are off on purpose."""
    lines = order_lines(spark, d).groupBy("order_id").agg(
        F.sum(money(F.col("quantity") * F.col("unit_price"))).alias("lines")
    )
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id")).join(lines, "order_id", "left")
    true_sub = F.coalesce(F.col("lines"), F.lit(0).cast("decimal(18,2)"))
    sub = F.when(F.col("order_id") % 13 == 0, true_sub + F.lit("0.02").cast("decimal(18,2)")).otherwise(true_sub)
    total = sub - F.lit(5).cast("decimal(18,2)") + F.lit(3).cast("decimal(18,2)")
    total = F.when(F.col("order_id") % 17 == 0, total + 1).otherwise(total)
    return orders.select(
        "order_id", sub.cast("double").alias("subtotal"), F.lit(5.0).alias("discount"), F.lit(3.0).alias("tax_amount"),
        total.cast("double").alias("order_total"),
    )


STATED_SQL = """items as (
  select l_orderkey as order_id,
         cast(round_even(l_quantity * (round_even(l_extendedprice / l_quantity * 100.0::double, 0) / 100.0::double)
              * 100.0::double, 0) / 100.0::double as decimal(18,2)) as line_total
  from lineitem),
sums as (select order_id, sum(line_total) as lines from items group by 1),
heads as (
  select o_orderkey as order_id, coalesce(lines, 0)::decimal(18,2) as expected_subtotal,
         coalesce(lines, 0)::decimal(18,2) + case when o_orderkey % 13 = 0 then 0.02 else 0 end as subtotal
  from orders left join sums on order_id = o_orderkey),
checked as (
  select order_id, expected_subtotal, subtotal, subtotal - 5 + 3 as expected_total,
         subtotal - 5 + 3 + case when order_id % 17 = 0 then 1 else 0 end as order_total from heads)"""


def ledger(spark, d):
    """events as an account ledger: value is a credit for purchases and a debit otherwise."""
    credit = F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0)
    debit = F.when(F.col("event_type") == "purchase", 0.0).otherwise(F.col("value"))
    return table(spark, d, "events").select(
        F.col("user_id").alias("account"), F.col("event_id").alias("seq"), credit.alias("credit"), debit.alias("debit")
    )


def stated_ledger(spark, d):
    """The ledger with a stated balance; every 97th line is a cent and a half off."""
    rows = integrity.running_balance(ledger(spark, d), "account", "seq", 1000.0)
    off = F.when(F.col("seq") % 97 == 0, F.lit(0.015)).otherwise(0.0)
    return rows.select("account", "seq", "credit", "debit",
                       (F.col("expected_balance").cast("double") + off).alias("balance"))


LEDGER_SQL = """moves as (
  select user_id as account, event_id as seq,
         cast(case when event_type = 'purchase' then value else 0 end as decimal(18,2)) as credit,
         cast(case when event_type = 'purchase' then 0 else value end as decimal(18,2)) as debit from events),
run as (
  select *, 1000::decimal(18,2) + sum(credit - debit) over
         (partition by account order by seq rows unbounded preceding) as expected_balance from moves)"""


def balance_rows(spark, d):
    out = integrity.running_balance(ledger(spark, d), "account", "seq", 1000.0)
    return out.select("account", "seq", F.col("expected_balance").cast("double").alias("expected_balance"))


def balance_rows_null_account(spark, d):
    """The same where every seventh account is unknown."""
    rows = ledger(spark, d).withColumn("account", F.when(F.col("account") % 7 != 0, F.col("account")))
    out = integrity.running_balance(rows, "account", "seq", 1000.0)
    return out.select("account", "seq", F.col("expected_balance").cast("double").alias("expected_balance"))


def failed(spark, d):
    out = integrity.failed_totals(stated_orders(spark, d), order_lines(spark, d))
    return out.select("order_id", "subtotal", F.col("expected_subtotal").cast("double").alias("expected_subtotal"),
                      "order_total", F.col("expected_total").cast("double").alias("expected_total"),
                      "subtotal_match", "total_match")


def all_links(spark, d):
    names = sorted({t for c, _, p, _ in LINKS for t in (c, p)})
    return integrity.check_all_orphans({t: table(spark, d, t) for t in names}, LINKS)


def validate(spark, d):
    tables = {t: table(spark, d, t) for t in ("customer", "nation", "part")}
    tables["orders"] = stated_orders(spark, d).join(
        table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id")),
        "order_id",
    )
    tables["order_items"] = order_lines(spark, d)
    return integrity.validate_relational(tables, [
        ("orders", "customer_id", "customer", "c_custkey"), ("order_items", "order_id", "orders", "order_id"),
        ("customer", "c_nationkey", "nation", "n_nationkey"),
    ])


def orphan_sql(c, fk, p, pk):
    return (f"select (select count(distinct {fk}) from {c} where {fk} not in (select {pk} from {p})) as orphan_count, "
            f"(select count(distinct {pk}) from {p}) as parent_count, "
            f"(select count(distinct {fk}) from {c}) as child_references")


QUERIES = {
    "check_orphan_keys": lambda s, d: integrity.check_orphan_keys(
        table(s, d, "events"), table(s, d, "customer"), "event_id", "c_custkey"),
    "orphan_examples": lambda s, d: integrity.orphan_examples(
        table(s, d, "events"), table(s, d, "customer"), "event_id", "c_custkey"),
    "check_all_orphans": all_links,
    "check_order_totals": lambda s, d: integrity.check_order_totals(stated_orders(s, d), order_lines(s, d)),
    "failed_totals": failed,
    "running_balance": balance_rows,
    "running_balance_null_account": balance_rows_null_account,
    "check_running_balance": lambda s, d: integrity.check_running_balance(
        stated_ledger(s, d), "account", "seq", 1000.0),
    "validate_relational": validate,
}

ORACLES = {
    "check_orphan_keys": "select orphan_count = 0 as valid, * from ("
                         + orphan_sql("events", "event_id", "customer", "c_custkey") + ")",
    "orphan_examples": "select distinct event_id as orphan_key from events "
                       "where event_id not in (select c_custkey from customer) order by 1 limit 20",
    "check_all_orphans": " union all ".join(
        f"select '{c}.{fk}->{p}.{pk}' as link, orphan_count = 0 as valid, * from ({orphan_sql(c, fk, p, pk)})"
        for c, fk, p, pk in LINKS),
    "check_order_totals": f"""with {STATED_SQL}
        select sm = 0 and tm = 0 as valid, n as orders_checked, sm as subtotal_mismatches, tm as total_mismatches
        from (select count(*) as n, count(*) filter (abs(subtotal - expected_subtotal) > 0.01) as sm,
              count(*) filter (abs(order_total - expected_total) > 0.01) as tm from checked)""",
    "failed_totals": f"""with {STATED_SQL}
        select order_id, subtotal::double as subtotal, expected_subtotal::double as expected_subtotal,
               order_total::double as order_total, expected_total::double as expected_total,
               abs(subtotal - expected_subtotal) <= 0.01 as subtotal_match,
               abs(order_total - expected_total) <= 0.01 as total_match
        from checked where abs(subtotal - expected_subtotal) > 0.01 or abs(order_total - expected_total) > 0.01
        order by order_id limit 5""",
    "running_balance": f"with {LEDGER_SQL} select account, seq, expected_balance::double as expected_balance from run",
    "running_balance_null_account": f"with {LEDGER_SQL.replace('user_id as account', 'case when user_id % 7 <> 0 then user_id end as account')} "
                                    "select account, seq, expected_balance::double as expected_balance from run",
    "check_running_balance": f"""with {LEDGER_SQL}
        select account, bm = 0 and ov = 0 as valid, transactions_checked, bm as balance_mismatches,
               ov as overdraft_violations, 1000.0::double as opening_balance, closing_balance
        from (select account, count(*) as transactions_checked, count(*) filter (seq % 97 = 0) as bm,
                     count(*) filter (expected_balance < -0.01) as ov,
                     arg_max(expected_balance, seq)::double as closing_balance from run group by account)""",
    "validate_relational": f"""with {STATED_SQL}
        select 'orphans:orders.customer_id->customer.c_custkey' as "check", f = 0 as valid, f as failures from
          (select count(distinct o_custkey) as f from orders where o_custkey not in (select c_custkey from customer))
        union all select 'orphans:order_items.order_id->orders.order_id', f = 0, f from
          (select count(distinct l_orderkey) as f from lineitem where l_orderkey not in (select o_orderkey from orders))
        union all select 'orphans:customer.c_nationkey->nation.n_nationkey', f = 0, f from
          (select count(distinct c_nationkey) as f from customer
           where c_nationkey not in (select n_nationkey from nation))
        union all select 'order_totals', f = 0, f from
          (select count(*) filter (abs(subtotal - expected_subtotal) > 0.01)
                + count(*) filter (abs(order_total - expected_total) > 0.01) as f from checked)""",
}
