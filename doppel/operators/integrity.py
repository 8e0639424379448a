"""Checks of keys, totals and running balances. Each returns a DataFrame report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doppel.functions.columns import col
from doppel.functions.money import MONEY, money
from doppel.operators.order_stats import bucket_of, plan_order, running_sums

EXAMPLES = 20
FAILURES = 5


def check_orphan_keys(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """One row: valid, orphan_count, parent_count, child_references (all distinct keys).

    Both key columns go through one aggregation on the key, so a key with many
    rows is reduced before the shuffle and no join is needed.
    """
    sides = child.select(col(fk).alias("key"), F.lit(1).alias("c"), F.lit(0).alias("p")).unionByName(
        parent.select(col(pk).alias("key"), F.lit(0).alias("c"), F.lit(1).alias("p"))
    )
    keys = sides.filter(F.col("key").isNotNull()).groupBy("key").agg(F.max("c").alias("c"), F.max("p").alias("p"))
    counts = keys.agg(
        F.coalesce(F.sum(F.col("c") * (1 - F.col("p"))), F.lit(0)).cast("bigint").alias("orphan_count"),
        F.coalesce(F.sum("p"), F.lit(0)).cast("bigint").alias("parent_count"),
        F.coalesce(F.sum("c"), F.lit(0)).cast("bigint").alias("child_references"),
    )
    return counts.select((F.col("orphan_count") == 0).alias("valid"), "*")


def orphan_examples(child: DataFrame, parent: DataFrame, fk: str, pk: str, limit: int = EXAMPLES) -> DataFrame:
    """The smallest distinct child keys that have no parent."""
    keys = child.select(col(fk).alias("orphan_key")).filter("orphan_key is not null").distinct()
    known = parent.select(col(pk).alias("orphan_key")).distinct()
    return keys.join(known, "orphan_key", "left_anti").orderBy("orphan_key").limit(limit)


def check_all_orphans(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]]) -> DataFrame:
    """One row per declared link (child table, fk, parent table, pk)."""
    checks = [
        check_orphan_keys(tables[c], tables[p], fk, pk).select(F.lit(f"{c}.{fk}->{p}.{pk}").alias("link"), "*")
        for c, fk, p, pk in links if c in tables and p in tables
    ]
    return reduce(DataFrame.unionByName, checks)


def order_total_diffs(orders: DataFrame, items: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Every order with its expected subtotal and total, and whether each matches."""
    lines = items.groupBy("order_id").agg(
        F.sum(money(F.col("quantity").cast("double") * F.col("unit_price").cast("double"))).alias("_sum")
    )
    exact = "decimal(18,4)"
    allowed = F.lit(tolerance).cast(exact)
    joined = orders.select("order_id", "subtotal", "discount", "tax_amount", "order_total").join(
        lines, "order_id", "left"
    )
    wide = joined.select(
        "*",
        F.coalesce(F.col("_sum"), F.lit(0).cast(MONEY)).cast(MONEY).alias("expected_subtotal"),
        money(
            F.col("subtotal").cast(exact) - F.col("discount").cast(exact) + F.col("tax_amount").cast(exact)
        ).alias("expected_total"),
    ).drop("_sum")
    return wide.select(
        "*",
        F.coalesce(F.abs(F.col("subtotal").cast(exact) - F.col("expected_subtotal")) <= allowed, F.lit(False))
        .alias("subtotal_match"),
        F.coalesce(F.abs(F.col("order_total").cast(exact) - F.col("expected_total")) <= allowed, F.lit(False))
        .alias("total_match"),
    )


def check_order_totals(orders: DataFrame, items: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """One row: valid, orders_checked, subtotal_mismatches, total_mismatches."""
    diffs = order_total_diffs(orders, items, tolerance)
    counts = diffs.agg(
        F.count(F.lit(1)).alias("orders_checked"),
        F.count_if(~F.col("subtotal_match")).alias("subtotal_mismatches"),
        F.count_if(~F.col("total_match")).alias("total_mismatches"),
    )
    ok = (F.col("subtotal_mismatches") == 0) & (F.col("total_mismatches") == 0)
    return counts.select(ok.alias("valid"), "*")


def failed_totals(orders: DataFrame, items: DataFrame, tolerance: float = 0.01, limit: int = FAILURES) -> DataFrame:
    """The first failing orders by id."""
    diffs = order_total_diffs(orders, items, tolerance)
    return diffs.filter(~(F.col("subtotal_match") & F.col("total_match"))).orderBy("order_id").limit(limit)


def running_balance(ledger: DataFrame, account: str, seq: str, opening: float,
                    buckets: int | None = None) -> DataFrame:
    """Add `expected_balance` = opening + running credits - debits in seq order per account.

    A long account is cut at sequence buckets; the balance carried into each
    bucket comes from the bucket totals, so no task holds a whole account.
    """
    plan = plan_order(ledger, {"seq": col(seq).cast("double")}, buckets)
    zero = F.lit(0).cast(MONEY)
    moves = ledger.withColumn(
        "_move",
        F.coalesce(money(F.col("credit")), zero) - F.coalesce(money(F.col("debit")), zero),
    )
    bucket = None
    if plan.bounds["seq"]:
        bucket = bucket_of(F.lit("seq"), col(seq).cast("double"), plan.bounds)
    summed = running_sums(moves, [account], [seq], {"_run": "_move"}, bucket)
    start = F.lit(float(opening)).cast(MONEY)
    return summed.select(
        *ledger.columns, (start + F.col("_run")).cast(MONEY).alias("expected_balance"),
        (start + F.col("_run_total")).cast(MONEY).alias("closing_balance"),
    )


def check_running_balance(ledger: DataFrame, account: str, seq: str, opening: float, allow_overdraft: bool = False,
                          tolerance: float = 0.01, buckets: int | None = None) -> DataFrame:
    """One row per account: valid, transactions_checked, mismatches, overdrafts, opening and closing balance."""
    exact = "decimal(18,4)"
    allowed = F.lit(tolerance).cast(exact)
    rows = running_balance(ledger, account, seq, opening, buckets)
    off = ~F.coalesce(F.abs(F.col("balance").cast(exact) - F.col("expected_balance")) <= allowed, F.lit(False))
    over = F.lit(False) if allow_overdraft else F.col("expected_balance") < -allowed
    report = rows.groupBy(account).agg(
        F.count(F.lit(1)).alias("transactions_checked"),
        F.count_if(off).alias("balance_mismatches"),
        F.count_if(over).alias("overdraft_violations"),
        F.lit(float(opening)).alias("opening_balance"),
        F.max("closing_balance").cast("double").alias("closing_balance"),
    )
    ok = (F.col("balance_mismatches") == 0) & (F.col("overdraft_violations") == 0)
    return report.select(account, ok.alias("valid"), *report.columns[1:])


def validate_relational(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]]) -> DataFrame:
    """Key checks, and total checks where orders and order_items carry money columns: check, valid, failures."""
    keys = check_all_orphans(tables, links).select(
        F.concat(F.lit("orphans:"), F.col("link")).alias("check"), "valid", F.col("orphan_count").alias("failures")
    )
    need_o = {"order_id", "subtotal", "discount", "tax_amount", "order_total"}
    need_i = {"order_id", "quantity", "unit_price"}
    parts = [keys]
    if need_o <= set(getattr(tables.get("orders"), "columns", [])) and need_i <= set(
        getattr(tables.get("order_items"), "columns", [])
    ):
        parts.append(
            check_order_totals(tables["orders"], tables["order_items"]).select(
                F.lit("order_totals").alias("check"), "valid",
                (F.col("subtotal_mismatches") + F.col("total_mismatches")).alias("failures"),
            )
        )
    return reduce(DataFrame.unionByName, parts)
