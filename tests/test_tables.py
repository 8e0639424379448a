from datetime import date
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from doppel.operators import documents, generate, integrity, relational
from doppel.operators import order_stats as order

LINKS = [("orders", "customer_id", "customers", "customer_id"), ("order_items", "order_id", "orders", "order_id")]


def by_id(frame, name):
    return frame.sort_values(name).reset_index(drop=True).to_json()


def sample(spark, n=150, seed=1):
    rng = np.random.default_rng(seed)
    customers = pd.DataFrame({"customer_id": range(1, n + 1), "city": rng.choice(["Rome", "Oslo", "Lima"], n, p=[0.6, 0.3, 0.1])})
    fan = np.where(np.arange(n) == 0, n, rng.integers(1, 6, n))  # one customer has a large share of all orders
    orders = pd.DataFrame({"customer_id": np.repeat(customers["customer_id"], fan)})
    orders["order_id"] = np.arange(1, len(orders) + 1)
    orders["status"] = rng.choice(["done", "open"], len(orders), p=[0.8, 0.2])
    orders["discount"] = np.round(rng.uniform(0, 400, len(orders)), 2)
    orders["tax_rate"] = rng.choice([0.05, 0.075], len(orders))
    items = pd.DataFrame({"order_id": np.repeat(orders["order_id"].to_numpy(), rng.integers(1, 4, len(orders)))})
    items["category"] = rng.choice(["cheap", "dear"], len(items))
    items["product_name"] = items["category"] + rng.integers(0, 7, len(items)).astype(str)
    items["quantity"] = rng.integers(1, 6, len(items))
    items["unit_price"] = np.round(np.where(items["category"] == "cheap", rng.uniform(2, 9, len(items)), rng.uniform(90, 200, len(items))), 2)
    return tuple(spark.createDataFrame(x) for x in (customers, orders, items))


@pytest.fixture(scope="module")
def learned(spark):
    return relational.learn_relational(*sample(spark))


def test_learned_tables_hold_together(spark, learned):
    made = relational.generate_learned(generate.rows(spark, 200), learned)
    assert all(r["valid"] for r in integrity.validate_relational(made, LINKS).collect())
    orders, items = made["orders"].toPandas(), made["order_items"].toPandas()
    assert sorted(orders["order_id"]) == list(range(1, len(orders) + 1))
    assert sorted(items["item_id"]) == list(range(1, len(items) + 1))
    assert (orders["discount"] <= orders["subtotal"]).all() and (orders["order_total"] >= 0).all()
    prices = items.groupby("category")["unit_price"].mean()
    assert float(prices["cheap"]) < float(prices["dear"])
    assert set(items["product_name"].str.rstrip("0123456789")) == {"cheap", "dear"}
    again = relational.generate_learned(generate.rows(spark, 200).repartition(7), learned)["orders"].toPandas()
    assert by_id(orders, "order_id") == by_id(again, "order_id")


@pytest.mark.parametrize("size", [499, 500, 501])
def test_draws_do_not_depend_on_the_way(spark, monkeypatch, size):
    rows = spark.range(4000).select("id", ((F.col("id") * 7919 % 4000 + 0.3) / 4000).alias("u"))
    hist = spark.createDataFrame([(f"v{k}", 1 + k * 37 % 11) for k in range(size)], "value string, n bigint")
    usual = relational.draw(rows, "u", hist, "x").toPandas()
    monkeypatch.setattr(relational, "SMALL_TABLE", 1000 if size > 500 else 10)
    assert by_id(usual, "id") == by_id(relational.draw(rows, "u", hist, "x").toPandas(), "id")


def test_long_value_lists_are_drawn_by_join(spark, monkeypatch, learned):
    rows = spark.range(6000).select("id", ((F.col("id") + 0.5) / 6000).alias("u"))
    hist = spark.createDataFrame([("a", 5), ("b", 3), ("c", 1), ("d", 1)], "value string, n bigint")
    monkeypatch.setattr(relational, "SMALL_TABLE", 2)
    got = relational.draw(rows, "u", hist, "x").groupBy("x").count().collect()
    assert {r["x"]: r["count"] for r in got} == {"a": 3000, "b": 1800, "c": 600, "d": 600}


@pytest.mark.parametrize("chunk", [65_536, 10])
def test_children_of_a_parent_with_very_many(spark, monkeypatch, chunk):
    monkeypatch.setattr(relational, "EXPLODE_CHUNK", chunk)
    parents = spark.createDataFrame([(1, 2), (2, 0), (3, 95), (4, 1)], "p bigint, k bigint")
    out = relational.expand_children(parents, "p", "k", "c", buckets=3).orderBy("c").toPandas()
    assert list(out["c"]) == list(range(1, 99))
    assert list(out["p"]) == [1] * 2 + [3] * 95 + [4]
    assert list(out["position"]) == [1, 2, *range(1, 96), 1]


def test_template_tables_and_other_orders_of_tables(spark):
    made = relational.generate_template(generate.rows(spark, 80), {**relational.TEMPLATE, "tables": relational.TEMPLATE["tables"][::-1]})
    assert list(made) == ["customers", "orders", "order_items"]
    assert all(r["valid"] for r in integrity.validate_relational(made, LINKS).collect())
    circle = {"tables": [{"name": a, "columns": [{"name": "k", "type": "fk", "references": f"{b}.id"}]} for a, b in ("xy", "yx")]}
    with pytest.raises(ValueError):
        relational.generate_template(generate.rows(spark, 3), circle)


def test_comparison_of_learned_tables(spark, learned):
    customers, orders, items = sample(spark)
    made = relational.generate_learned(generate.rows(spark, 400), learned)
    rows = {r["metric"]: r for r in relational.compare_relational({"orders": orders, "order_items": items}, made).collect()}
    assert abs(rows["items_per_order"]["real_mean"] - rows["items_per_order"]["synth_mean"]) < 0.3
    prices = relational.compare_prices(items, made["order_items"]).collect()
    assert {r["category"] for r in prices} == {"cheap", "dear"} and all(r["diff_mean"] < 10 for r in prices)


def test_planted_orphans(spark):
    child = spark.createDataFrame([(1,), (9,), (9,), (8,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    row = integrity.check_orphan_keys(child, parent, "k", "k").first()
    assert tuple(row) == (False, 2, 2, 3)
    assert [r[0] for r in integrity.orphan_examples(child, parent, "k", "k").collect()] == [8, 9]


def test_planted_totals(spark):
    items = spark.createDataFrame([(1, 2, 5.0), (1, 1, 0.5), (2, 3, 1.1)], "order_id int, quantity int, unit_price double")
    orders = spark.createDataFrame([(1, 10.5, 1.0, 0.5, 10.0), (2, 3.31, 0.0, 0.0, 3.31), (3, 0.02, 0.0, 0.0, 0.02), (4, 0.0, 0.0, 0.0, 5.0)],
                                   "order_id int, subtotal double, discount double, tax_amount double, order_total double")
    row = integrity.check_order_totals(orders, items).first()  # a cent is tolerated, two are not
    assert (row["valid"], row["orders_checked"], row["subtotal_mismatches"], row["total_mismatches"]) == (False, 4, 1, 1)
    assert [r["order_id"] for r in integrity.failed_totals(orders, items).collect()] == [3, 4]


@pytest.mark.parametrize("buckets", [None, 5])
def test_broken_balance(spark, buckets):
    rng = np.random.default_rng(2)
    rows = []
    for account, n in (("hot", 400), ("cold", 3)):
        balance = Decimal("100.00")
        for i in range(n):
            credit, debit = Decimal(int(rng.integers(0, 900))) / 100, Decimal(int(rng.integers(0, 500))) / 100
            balance += credit - debit
            off = Decimal("0.02") if account == "hot" and i in (10, 77) else 0
            rows.append((account, i, float(credit), float(debit), float(balance + off)))
    ledger = spark.createDataFrame(rows, "account string, seq int, credit double, debit double, balance double")
    got = {r["account"]: r for r in integrity.check_running_balance(ledger, "account", "seq", 100.0, buckets=buckets).collect()}
    assert (got["hot"]["valid"], got["hot"]["balance_mismatches"]) == (False, 2) and got["cold"]["valid"]
    assert got["cold"]["closing_balance"] == rows[-1][-1]
    low = spark.createDataFrame([("a", 1, 0.0, 5.0, -4.0), ("a", 2, 9.0, 0.0, 5.0)], ledger.schema.simpleString()[7:-1].replace(":", " "))
    assert integrity.check_running_balance(low, "account", "seq", 1.0).first()["overdraft_violations"] == 1
    assert integrity.check_running_balance(low, "account", "seq", 1.0, allow_overdraft=True).first()["valid"]


def test_invoice_arithmetic(spark):
    rows = documents.generate_invoices(generate.rows(spark, 50), discount_pct=15, n_items=6, locale="ur_PK").collect()
    for r in rows:
        assert len(r["items"]) == 6 and all(x["line_total"] == x["quantity"] * x["unit_price"] for x in r["items"])
        assert r["subtotal"] == sum(x["line_total"] for x in r["items"])
        assert r["total"] == r["subtotal"] - r["discount"] + r["tax_amount"]
        assert abs(float(r["tax_amount"]) - float(r["subtotal"] - r["discount"]) * 0.17) < 0.0051
        assert r["currency_symbol"] == "Rs." and r["address_to"].startswith("House ")
    html = documents.invoice_html(documents.generate_invoices(generate.rows(spark, 2), discount_pct=15)).first()["html"]
    assert "INVOICE" in html and "Discount (15.0%)" in html and html.count("<tr>") >= 3


def test_statements_reconcile_without_overdraft(spark):
    made = documents.generate_statements(generate.rows(spark, 60), n_transactions=40, opening_balance=120.0, salary_on_1st=True,
                                         as_of=date(2024, 3, 20), days=60)
    lines = documents.statement_lines(made)
    assert all(r["valid"] for r in integrity.check_running_balance(lines, "account", "seq", 120.0).collect())
    for r in made.collect():
        paid = [t for t in r["transactions"] if t["description"] == "Salary Deposit"]
        assert [t["date"] for t in paid] == ["02/01/2024", "03/01/2024"]
        assert r["closing_balance"] == r["opening_balance"] + r["total_credits"] - r["total_debits"]
        assert [t["seq"] for t in r["transactions"]] == list(range(1, len(r["transactions"]) + 1))
        assert all(t["balance"] >= 0 and (t["credit"] > 0) != (t["debit"] > 0) for t in r["transactions"])
    assert documents.statement_html(made).first()["html"].count("<tr>") > 5


def test_item_lines(spark):
    text = "Invoice 12\r\n  Blue kettle  \nab\n" + "x" * 45 + "\nTotal 5\nRed  lamp\n\tGreen chair "
    row = documents.extract_item_lines(spark.createDataFrame([(1, text)], "id int, t string"), "t").first()
    assert row["labels"] == ["Blue kettle", "Red  lamp", "Green chair"] and row["n_items"] == 2


def test_plan_bounds_are_literals(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    plan = order.plan_order(df, {"v": F.col("v")}, 10)
    assert len(plan.bounds["v"]) == 9 and plan.rows == 1000 and plan.nulls["v"] == 0


def test_lookup_of_a_hot_key_is_spread(spark):
    """One key with 99 % of the rows: the result of a plain join, and its rows meet many copies of the key."""
    rows = spark.range(20000).selectExpr("id", "if(id % 100 < 99, 'hot', concat('k', id % 7)) as category", "cast(null as string) as other")
    table = spark.createDataFrame([("hot", 0.99, 5), *[(f"k{i}", 0.001, i) for i in range(6)]], "category string, _share double, v int")
    got = relational.spread_lookup(rows, table, ["category"], "_share", "id", copies=50)
    assert sorted(got.columns) == ["category", "id", "other", "v"] and got.count() == 20000
    assert got.filter("v is null").select("category").distinct().collect() == [("k6",)]
    assert got.filter("category = 'hot' and v = 5").count() == rows.filter("category = 'hot'").count()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = relational.spread_lookup(rows, table, ["category"], "_share", "id", copies=50)
        sizes = plan.groupBy(F.spark_partition_id()).count().toPandas()["count"]
        assert sizes.max() < 15000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_learning_from_keys_alone(spark):
    customers = spark.range(1, 60).selectExpr("id as customer_id")
    orders = spark.range(1, 200).selectExpr("id as order_id", "id % 59 + 1 as customer_id", "id / 4000D as tax_rate")
    items = spark.range(1, 500).selectExpr("id % 199 + 1 as order_id")
    model = relational.learn_relational(customers, orders, items)
    made = relational.generate_learned(spark.range(1, 300), model, 7)["order_items"].toPandas()
    assert set(made["quantity"]) == {1, 2} and made["unit_price"].astype(float).between(10, 100).all()
    assert (made["product_name"] == made["category"] + " Product").all() and made["category"].nunique() > 3


def test_many_tax_rates(spark, monkeypatch):
    monkeypatch.setattr(relational, "LISTED_RATES", 20)
    customers = spark.range(1, 60).selectExpr("id as customer_id")
    orders = spark.range(1, 2000).selectExpr("id as order_id", "id % 59 + 1 as customer_id", "(id % 300) / 1000D as tax_rate")
    items = spark.range(1, 500).selectExpr("id % 199 + 1 as order_id")
    model = relational.learn_relational(customers, orders, items)
    made = relational.generate_orders(spark.range(1, 200).selectExpr("id as customer_id"), model, 3).select("tax_rate").distinct().count()
    assert model.tax_table is not None and made > 100
