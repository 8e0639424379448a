import hashlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from doppel.functions import masking
from doppel.operators import memorisation, nearest, privacy


def apply(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["m"] for r in df.select("i", fn(F.col("v")).alias("m")).orderBy("i").collect()]


@pytest.mark.parametrize("fn, cases", [
    (masking.mask_email, {"john@x.org": "j**n@x.org", "ab@x.org": "a*@x.org", "a@x.org": "a*@x.org", "a@b@c.d": "a*b@c.d",
                          "none": "none", "@x": "@x", None: None}),
    (masking.mask_phone, {"+1 (555) 123-4567": "*******-4567", "12 3": "****", "": "", None: None}),
    (masking.mask_credit_card, {"4111 1111 1111 1234": "****-****-****-1234", "ab1": "***", None: None}),
    (masking.mask_name, {"John  A Smith": "J*** A S****", " x ": "x", "": "", None: None}),
    (masking.mask_generic, {"ab": "ab", "abc": "a*c", "": "", None: None}),
])
def test_masks(spark, fn, cases):
    assert apply(spark, fn, list(cases)) == list(cases.values())


def test_pseudonyms_are_salted_and_stable(spark):
    one = apply(spark, lambda v: masking.pseudonym(v, "s1"), ["ann", "ann", "", None])
    assert one[0] == one[1] == hashlib.sha256(b"s1:ann").hexdigest()[:16]
    assert one[2:] == ["", None]
    assert apply(spark, lambda v: masking.pseudonym(v, "s2"), ["ann"]) != one[:1]


def test_noise_scale_and_rules(spark):
    df = spark.range(4000).select("id", F.lit(100.0).alias("v"), F.lit("Ann Lee").alias("full_name"))
    out = privacy.apply_privacy(df, [
        {"column": "v", "method": "noise", "epsilon": 0.5, "sensitivity": 10.0},
        {"column": "full_name", "method": "mask"}, {"column": "nope", "method": "mask"}], ids=["id"]).toPandas()
    assert np.abs(out["v"] - 100).mean() == pytest.approx(20.0, rel=0.1)  # mean |Laplace(b)| = b
    assert abs(out["v"].mean() - 100) < 2 and set(out["full_name"]) == {"A** L**"}
    with pytest.raises(ValueError):
        privacy.apply_privacy(df, [{"column": "v", "method": "noise"}])


def test_two_noise_columns_get_different_noise(spark):
    df = spark.range(50).select("id", F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
    rules = [{"column": c, "method": "noise", "sensitivity": 1.0} for c in "ab"]
    out = privacy.apply_privacy(df, rules, ["id"]).toPandas()
    assert not np.allclose(out["a"], out["b"])


def test_sniffed_mask(spark):
    df = spark.createDataFrame([("a1@x.org",)] * 30 + [(None,)], "thing string")
    assert privacy.sniffed_types(df, ["thing"]) == {"thing": "email"}
    assert privacy.sniffed_types(spark.createDataFrame([("tag 1234",)], "thing string"), ["thing"]) == {"thing": "phone"}


TYPES = {"a": "float", "b": "float", "c": "categorical"}


def people(n, seed):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"id": range(n), "a": rng.normal(0, 1, n), "b": rng.normal(0, 1, n), "c": rng.choice(list("xyz"), n)})


def test_planted_copies_are_found(spark):
    real = people(300, 1)
    copies = pd.concat([real.head(5), people(45, 2)]).assign(id=range(50))
    r, s = spark.createDataFrame(real), spark.createDataFrame(copies)
    row = memorisation.exact_match(r, s, ["a", "b", "c"]).first()
    assert (row["exact_match_count"], row["exact_match_rate"]) == (5, 0.1)
    only = memorisation.privacy_check(r, spark.createDataFrame(real.head(5)), {"id": "id", **TYPES}, ["id"]).first()
    assert only["exact_match_rate"] == 1.0 and only["status"] == "review" and only["dcr_ratio"] == 0.0


def test_null_equals_null_and_integers_equal_floats(spark):
    r = spark.createDataFrame([(None, 5)], "k string, v int")
    s = spark.createDataFrame([(None, 5.0), ("x", 5.0)], "k string, v double")
    assert memorisation.exact_match(r, s, ["k", "v"]).first()["exact_match_count"] == 1


def brute(q, p, own):
    d = np.sqrt(((q[:, None, :] - p[None, :, :]) ** 2).sum(axis=2))
    if own:
        d[d == 0] = np.inf
    return d.min(axis=1)


@pytest.mark.parametrize("cell_rows", [10, 60, 10_000])
def test_nearest_distance_is_exact(spark, cell_rows):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.normal(0, 1, (300, 4)), rng.normal(6, 0.1, (200, 4)), np.c_[rng.normal(0, 1, 100), np.zeros((100, 3))]])
    q = np.concatenate([rng.normal(1, 3, (80, 4)), p[:5]])

    def vectors(x):
        return spark.createDataFrame([(str(i), [float(v) for v in r]) for i, r in enumerate(x)], "id string, features array<double>").repartition(3)

    for asked, own in ((q, False), (p, True)):
        got = nearest.nearest_distance(vectors(asked), vectors(p), own, cell_rows).toPandas()
        got = got.assign(id=got["id"].astype(int)).sort_values("id")
        assert len(got) == len(asked)
        assert np.allclose(got["distance"], brute(asked, p, own))


@pytest.mark.parametrize("cell_rows", [50, 10_000])
def test_median_distances_with_many_equal_rows(spark, cell_rows):
    rng = np.random.default_rng(4)
    real = np.concatenate([rng.normal(0, 1, (200, 3)), np.zeros((90, 3))])
    synth = np.concatenate([rng.normal(0, 1, (60, 3)), np.ones((30, 3))])

    def frame(x):
        return spark.createDataFrame([([float(v) for v in r],) for r in x], "features array<double>")

    s, r = memorisation.median_distances(frame(real), frame(synth), cell_rows)
    d = np.sqrt(((real[:, None, :] - real[None, :, :]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert s == pytest.approx(np.median(brute(synth, real, False)))
    assert r == pytest.approx(np.median(d.min(axis=1)))


def test_distance_asks_all_rows(spark):
    """Only the median over all 4001 synthetic rows is exact; a sample of 2000 has another."""
    real = spark.range(11).selectExpr("id", "cast(id as double) as v")
    synth = spark.range(4001).selectExpr("id", "100 + cast(id as double) as v")
    got = memorisation.distance_to_closest(real, synth, {"id": "id", "v": "float"}, ["id"]).first()
    assert got["synth_median_dist"] == pytest.approx((100 + 2000 - 10) / 10 ** 0.5, abs=1e-3)


@pytest.mark.parametrize("limits", [{"cell_rows": 9}, {"cell_rows": 30, "centres": 4, "chunk_rows": 7}, {}])
def test_nearest_with_labels_is_exact(spark, limits):
    """Numbers and labels of many values, cells in slices, queries in chunks: equal to all pairs over one-hot vectors."""
    rng = np.random.default_rng(6)
    x, a = np.round(rng.normal(0, 1, (400, 2)), 2), np.c_[rng.integers(0, 60, 400), rng.integers(0, 2, 400)]
    x[:150], a[:150, 0] = x[0], np.arange(150)  # alike but for a label
    x, at = np.unique(np.c_[x, a], axis=0, return_index=True)[0], None
    x, a = x[:, :2], x[:, 2:].astype(int)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2) + 2.0 * (a[:, None] != a[None]).sum(axis=2))
    rows = [(str(i), [float(v) for v in x[i]], [int(v) for v in a[i]]) for i in range(len(x))]
    table = spark.createDataFrame(rows, "id string, features array<double>, labels array<bigint>").repartition(3)
    got = {r["id"]: r["distance"] for r in nearest.nearest_distance(table, table, True, **limits).collect()}
    np.fill_diagonal(d, np.inf)
    assert [got[str(i)] for i in range(len(x))] == pytest.approx(d.min(axis=1).tolist())
    got = {r["id"]: r["distance"] for r in nearest.nearest_distance(table.where("cast(id as int) % 3 = 0"), table.where("cast(id as int) % 3 > 0"), **limits).collect()}
    at = np.arange(len(x)) % 3 == 0
    assert [got[str(i)] for i in np.flatnonzero(at)] == pytest.approx(d[at][:, ~at].min(axis=1).tolist())


def test_nearest_without_points(spark):
    some = spark.createDataFrame([("a", [1.0])], "id string, features array<double>")
    assert nearest.nearest_distance(some, some.limit(0)).first()["distance"] is None
    assert nearest.nearest_distance(some.limit(0), some).count() == 0
    assert nearest.nearest_distance(some, some, True).first()["distance"] is None


def test_visits_are_few_where_rows_lie_close(spark):
    """Rounds visit nearest cells first: on clustered vectors a query sees a small part of the cells."""
    rng = np.random.default_rng(2)
    middle = rng.normal(0, 10, (40, 16))
    x = middle[rng.integers(0, 40, 4000)] + rng.normal(0, 0.3, (4000, 16))
    table = spark.createDataFrame([(str(i), [float(v) for v in r]) for i, r in enumerate(x)], "id string, features array<double>")
    visits = []
    nearest.nearest_distance(table, table, True, cell_rows=20, visits=visits).count()
    assert sum(visits) < 20 * len(x)  # of 200 cells


def test_far_labels_are_seen(spark):
    """Rows that differ only in a rare label are not the same point."""
    real = spark.range(60).selectExpr("id", "cast(id as string) as kind", "1D as v")
    synth = spark.range(60).selectExpr("id", "concat('x', id) as kind", "1D as v")
    got = memorisation.distance_to_closest(real, synth, {"id": "id", "kind": "categorical", "v": "float"}).first()
    assert got["synth_median_dist"] == pytest.approx(2 ** 0.5, abs=1e-4) and got["real_median_dist"] == pytest.approx(2 ** 0.5, abs=1e-4)
