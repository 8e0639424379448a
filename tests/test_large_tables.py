"""Steps whose cost or place of work once grew with the table."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from doppel.operators import copula, fidelity, integrity, nearest, relational
from doppel.operators import order_stats as order
from doppel.sources import readers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_totals_of_many_accounts_stay_off_the_driver(spark, tmp_path):
    spark.range(200).select(F.col("id").alias("account")).write.parquet(str(tmp_path / "a"))
    lines = spark.read.parquet(str(tmp_path / "a")).select("account", F.explode(F.sequence(F.lit(1), F.lit(30))).alias("seq"))
    ledger = lines.select("*", F.lit(2.0).alias("credit"), F.lit(0.0).alias("debit"), (F.col("seq") * 2.0).alias("balance"))
    for buckets in (1, 4):
        out = integrity.check_running_balance(ledger, "account", "seq", 0.0, buckets=buckets)
        assert "Broadcast" not in plan(out)
        assert out.filter("valid and transactions_checked = 30 and closing_balance = 60").count() == 200


def test_unclustered_vectors_meet_in_blocks(spark, monkeypatch):
    """Where bounds cut off nothing, visits stay few; the rest is compared in blocks, with the same distances."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (900, 24))
    table = spark.createDataFrame([(str(i), [float(v) for v in r]) for i, r in enumerate(x)], "id string, features array<double>")
    visits = []
    got = {r["id"]: r["distance"] for r in nearest.nearest_distance(table, table, True, cell_rows=20, visits=visits).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert [got[str(i)] for i in range(len(x))] == pytest.approx(d.min(axis=1).tolist(), rel=1e-12)
    assert sum(visits) <= 10 * len(x)  # all would be over 45 each


def test_visits_are_handed_on_in_pieces():
    x = np.random.default_rng(9).normal(0, 1, (600, 8))
    tree = nearest.Centres(x, np.zeros((600, 0), np.int64))
    stats = pd.DataFrame({"cell": range(600), "near": 0.0, "far": 1.0, "wide": 9.0, "low": list(tree.x - 1), "high": list(tree.x + 1)})
    shared = type("Shared", (), {"value": nearest.Bounds(tree, stats, np.ones(600, np.int64))})
    part = pd.DataFrame({"id": [str(i) for i in range(256)], "features": list(x[:256]), "labels": [np.zeros(0, np.int64)] * 256, "home": -1,
                         "d2": np.inf, "at": -1.0, "at_cell": -1})
    sizes = [len(f) for f in nearest._routed(shared, 2048)([part])]
    assert sum(sizes) == 256 * 600 and max(sizes) <= nearest.ROUTED_ROWS


def test_order_of_counted_values_takes_one_pass(spark):
    df = spark.range(1000).select((F.col("id") % 50).cast("double").alias("v"))
    assert order.plan_order(df, {"v": F.col("v")}, counted=True).bounds["v"] == []
    assert len(order.plan_order(df, {"v": F.col("v")}, 4, counted=True).bounds["v"]) == 3


def test_one_column_of_many_values_is_looked_up_without_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(order, "BROADCAST_VALUES", 100)
    plan_of = order.OrderPlan(1000, distinct={"a": 400, "b": 90, "c": 450, "d": 90})
    assert order.long_columns(plan_of, list("abcd")) == ["a", "c"]
    assert order.long_columns(plan_of, ["a", "b"]) == []
    df = spark.range(1000).select("id", (F.col("id") % 400).cast("double").alias("a"))
    made = order.plan_order(df, {"a": F.col("a")}, counted=True)
    out = order.attach_ranks(df, {"a": "a"}, order.rank_tables(df, {"a": F.col("a")}, made), made, ["below"])
    assert "SortMergeJoin" not in plan(out)
    assert out.filter("id < 200").agg(F.sum("below_0")).first()[0] == sum(3 * i for i in range(200))


def test_melt_makes_no_arrays(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, None, 4.0)], "side int, `a.b` double, value double")
    long = order.melt(df, {"a.b": F.col("`a.b`"), "value": F.col("value")}, {"side": F.col("side")})
    assert sorted(map(tuple, long.collect())) == [(1, "a.b", 2.0), (2, "value", 4.0)]
    assert "Generate" not in plan(long)


def test_schema_of_many_json_files_is_found_by_several_tasks(spark, tmp_path):
    for i in range(24):
        (tmp_path / f"{i}.json").write_text('[\n{"id": %d, "at": {"x": "a"}},\n{"id": 1%s}\n]' % (i, ', "late": 1.5' if i == 23 else ""))
    sc = spark.sparkContext
    sc.setJobGroup("json", "json")
    try:
        out = readers.read_json_records(spark, str(tmp_path))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    status = sc.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("json") for s in status.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) > 1
    assert set(out.columns) == {"id", "late", "at.x"} and out.count() == 48
    assert out.filter("late = 1.5").count() == 1 and out.filter("`at.x` = 'a'").count() == 24


def test_json_in_another_encoding(spark, tmp_path):
    (tmp_path / "a.json").write_bytes('[\n{"id": 1, "x": "ä"}\n]'.encode("utf-16"))
    assert readers.read_json_records(spark, str(tmp_path)).collect() == [(1, "ä")]


def test_children_of_many_parents_are_made_by_many_tasks(spark):
    """The task that puts parents in order makes the rows of their children too, so few parents may share one."""
    parents = spark.range(400_000).select(F.col("id").alias("p"), (F.col("id") % 4).alias("k"))
    out = relational.expand_children(parents, "p", "k", "c")
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("t")).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 600_000 and max(sizes) <= 300_000
    ends = out.agg(F.min("c").alias("a"), F.max("c").alias("z"), F.countDistinct("c").alias("n")).first()
    assert (ends["a"], ends["z"], ends["n"]) == (1, 600_000, 600_000)
    assert out.where("p = 399999").agg(F.max("c")).first()[0] == 600_000


def test_compare_numeric_counts_values_once(spark):
    """Later steps read the counted values; the tables are read again for their means only."""
    real, synth = (spark.range(3000).select(((F.col("id") * k) % 701).cast("double").alias("v")) for k in (3, 5))
    out = fidelity.compare_numeric(real, synth, ["v"])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 2
    assert out.first()["real_max"] == 700


def test_scores_of_long_columns_move_little(spark, monkeypatch):
    """Rows meet the long tables first, with labels in place of draws and nothing yet from the short tables; the scores stay the same."""
    df = spark.range(3000).selectExpr("id", "id % 40 * 1.5 as a", "cast(pmod(xxhash64(id), 2500) as double) as b",
                                      "case when id % 3 = 0 then 'x' else 'y' end as c")

    def scores():
        models, _, made = copula.fit_marginals(df, {"id": "id", "a": "float", "b": "float", "c": "categorical"})
        return copula.normal_scores(df, models, ["id"], made)

    whole = scores().toPandas().sort_values("id")
    monkeypatch.setattr(order, "BROADCAST_VALUES", 300)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = scores()
        text = plan(out)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert text.count("SortMergeJoin") == 1
    above, below = text.split("SortMergeJoin")
    assert "place:c" in above and "place:" not in below and above.count("BroadcastHashJoin") == 1
    assert np.array_equal(out.toPandas().sort_values("id").to_numpy(), whole.to_numpy())
