import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from doppel.functions.normal import add_norm_cdf, add_norm_ppf
from doppel.operators import fidelity
from doppel.operators import order_stats as order


def frame(spark, values, name="v"):
    return spark.createDataFrame(pd.DataFrame({name: values, "id": range(len(values))})).repartition(5)


def hot(n=4000, seed=1):
    """A third of the rows share one value; the rest mix ties and single values."""
    rng = np.random.default_rng(seed)
    return np.concatenate([np.full(n // 3, 7.0), rng.integers(0, 50, n // 3).astype(float), rng.normal(5, 20, n - 2 * (n // 3))])


def average_ranks(x):
    return pd.Series(x).rank(method="average").to_numpy()


def test_normal_functions_match_the_library(spark):
    p = np.concatenate([np.logspace(-12, -1, 60), np.linspace(0.01, 0.99, 99), 1 - np.logspace(-10, -1, 40)])
    df = spark.createDataFrame(pd.DataFrame({"p": p}))
    rows = add_norm_cdf(add_norm_ppf(df, {"z": "p"}), {"back": "z"}).toPandas()
    exact = [NormalDist().inv_cdf(x) for x in rows["p"]]
    assert np.allclose(rows["z"], exact, rtol=0, atol=1e-12)
    assert max(abs(b - 0.5 * math.erfc(-z / math.sqrt(2))) for z, b in zip(rows["z"], rows["back"])) < 1e-14
    nothing = add_norm_ppf(spark.sql("select cast(null as double) as p"), {"z": "p"}).first()
    assert nothing["z"] is None


@pytest.mark.parametrize("buckets", [None, 2, 7, 64])
def test_average_ranks_with_a_hot_value(spark, buckets):
    x = hot()
    df = frame(spark, x)
    plan = order.plan_order(df, {"v": F.col("v")}, buckets)
    table = order.rank_tables(df, {"v": F.col("v")}, plan)["v"].toPandas().set_index("value")
    assert np.allclose(table.loc[x, "avg_rank"], average_ranks(x))
    assert table["n"].sum() == len(x)


@pytest.mark.parametrize("limit", [200_000, 0])
def test_rank_lookup_small_and_long_table(spark, monkeypatch, limit):
    monkeypatch.setattr(order, "BROADCAST_VALUES", limit)
    x = hot()
    df = frame(spark, np.where(np.arange(len(x)) % 11 == 0, np.nan, x)).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    plan = order.plan_order(df, {"v": F.col("v")}, 5)
    tables = order.rank_tables(df, {"v": F.col("v")}, plan)
    out = order.attach_ranks(df, {"v": "v"}, tables, plan, ["avg_rank"]).toPandas().sort_values("id")
    want = pd.Series(np.where(np.arange(len(x)) % 11 == 0, np.nan, x)).rank(method="average")
    assert len(out) == len(x)
    assert np.allclose(out["avg_rank_0"].to_numpy(dtype=float), want, equal_nan=True)


@pytest.mark.parametrize("rows_per_slice", [2_000_000, 100])
def test_ordinal_ranks_are_a_permutation_in_value_order(spark, monkeypatch, rows_per_slice):
    monkeypatch.setattr(order, "ROWS_PER_BUCKET", rows_per_slice)
    x = hot()
    df = frame(spark, x)
    plan = order.plan_order(df, {"v": F.col("v")}, 6)
    tie = (F.pmod(F.xxhash64("id"), F.lit(10007)) + 0.5) / 10007
    out = order.ordinal_ranks(df, "v", tie, plan, "v", ["id"]).toPandas().sort_values("rank")
    assert list(out["rank"]) == list(range(1, len(x) + 1))
    assert (np.diff(out["v"]) >= 0).all()


@pytest.mark.parametrize("n", [1, 2, 3, 1000])
@pytest.mark.parametrize("points", [3, 50, 200])
def test_grid_quantiles_match_numpy(spark, n, points):
    x = hot(n) if n > 5 else np.array([3.0, -1.0, 8.0])[:n]
    df = frame(spark, x)
    plan = order.plan_order(df, {"v": F.col("v")}, 4)
    cum = order.cumulative_histogram(order.histogram(df, {"v": F.col("v")}), plan, ["column"])
    got = order.grid_quantiles(cum, ["column"], points).orderBy("i").toPandas()["q"]
    assert np.allclose(got, np.quantile(x, np.linspace(0, 1, points)))


@pytest.mark.parametrize("chunk", [65_536, 16])
def test_wasserstein_and_ks_match_numpy(spark, monkeypatch, chunk):
    monkeypatch.setattr(order, "EXPLODE_CHUNK", chunk)
    a, b = hot(1500), hot(700, 2) + 1
    got = fidelity.pooled_cdf(frame(spark, a), frame(spark, b), ["v"], 8)
    ks = fidelity.ks_from(got).first()["ks"]
    w = fidelity.wasserstein_from(got).first()["wasserstein"]
    n = max(len(a), len(b))
    grid = np.linspace(0, 1, n)
    qa, qb = (np.interp(grid, np.linspace(0, 1, len(x)), np.sort(x)) for x in (a, b))
    assert w == pytest.approx(np.mean(np.abs(qa - qb)) / np.ptp(a), abs=1e-9)
    every = np.sort(np.concatenate([a, b]))
    fa, fb = (np.searchsorted(np.sort(x), every, side="right") / len(x) for x in (a, b))
    assert ks == pytest.approx(np.max(np.abs(fa - fb)))


@pytest.mark.parametrize("na, nb", [(1, 1), (1, 5), (7, 7), (50, 3), (40, 41), (13, 60), (200, 199)])
def test_wasserstein_closed_form(spark, na, nb):
    """Sums over runs of grid points equal the grid, for any sizes, ties and bucket lengths."""
    for seed in range(2):
        rng = np.random.default_rng(seed)
        a, b = np.round(rng.normal(0, 3, na), seed), np.round(rng.normal(1, 2, nb), seed)
        cdf = fidelity.pooled_cdf(frame(spark, a), frame(spark, b), ["v"])
        n = max(na, nb)
        qa, qb = (np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(x)), np.sort(x)) if len(x) > 1 else np.full(n, x[0]) for x in (a, b))
        want = np.mean(np.abs(qa - qb)) / (np.ptp(a) or 1)
        for bucket in (2_000_000, 3):
            assert fidelity.wasserstein_from(cdf, bucket).first()["wasserstein"] == pytest.approx(want, abs=1e-9)


def test_summary_of_pooled_frame(spark):
    a, b = hot(301), hot(200, 5) + 0.5
    got = fidelity.summary_from(fidelity.pooled_cdf(frame(spark, a), frame(spark, b), ["v"], 8)).first()
    assert got["r_median"] == pytest.approx(np.median(a)) and got["s_median"] == pytest.approx(np.median(b))
    assert got["inside"] == pytest.approx(np.mean((b >= a.min()) & (b <= a.max())))


@pytest.mark.parametrize("melted", [1, 9])
def test_rank_table_of_all_columns(spark, monkeypatch, melted):
    """Ranks of long columns looked up together, in rows with a null in another column and among all rows."""
    monkeypatch.setattr(order, "BROADCAST_VALUES", 50)
    rng = np.random.default_rng(3)
    x = pd.DataFrame({"a": rng.integers(0, 400, 900) * 1.0, "b": np.where(rng.random(900) < 0.3, np.nan, rng.normal(0, 1, 900)),
                      "c": rng.integers(0, 5, 900) * 1.0, "id": range(900)})
    x.loc[:300, "a"] = 7.0
    df = spark.createDataFrame(x).withColumn("b", F.when(~F.isnan("b"), F.col("b"))).repartition(4)
    values = {c: F.col(c) for c in "abc"}
    plan = order.plan_order(df, values, 6)
    table = order.rank_table(df, values, plan, {"1": F.col("b").isNotNull()}).cache()
    got = order.attach_rank_table(df, {c: c for c in "abc"}, table, plan, ["avg_rank", "avg_rank_1", "n"], melted).toPandas().sort_values("id")
    for i, c in enumerate("abc"):
        assert np.allclose(got[f"avg_rank_{i}"], x[c].rank(), equal_nan=True)
        there = x["b"].notna()
        assert np.allclose(got[f"avg_rank_1_{i}"][there.to_numpy()], x[c][there].rank())
    assert len(got) == 900


def test_exchanges_do_not_grow_with_columns(spark, monkeypatch):
    from doppel.operators import association
    monkeypatch.setattr(order, "BROADCAST_VALUES", 50)
    df = spark.range(500).selectExpr("id", *[f"cast(pmod(xxhash64(id, {k}), 300) as double) as v{k}" for k in range(8)])

    def shuffles(k):
        made = association.spearman_pairs(df, [f"v{i}" for i in range(k)])
        plan = made._jdf.queryExecution().sparkPlan().toString() + made._jdf.queryExecution().executedPlan().toString()
        return plan.count("Exchange hashpartitioning")

    assert shuffles(8) == shuffles(4)
