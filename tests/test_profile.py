import pandas as pd

from doppel.operators import profile


def test_types_of_awkward_columns(spark):
    n = 120
    df = spark.createDataFrame(pd.DataFrame({
        "record_id": [f"00000000-0000-4000-8000-{i:012d}" for i in range(n)],
        "email": [f"a{i}@b.org" for i in range(n)],
        "contact": [f"+1 555 {i:07d}" for i in range(n)],
        "when_text": [f"2023-05-{1 + i % 28:02d} 0{i % 9}:00:{i % 60:02d}" for i in range(n)],
        "day_text": [f"{1 + i % 28:02d}.03.20{10 + i % 14}" for i in range(n)],
        "flag": [True, False] * 60,
        "person": [f"Given{i} Family{i}" for i in range(n)],
        "blob": [("word " * 12) + str(i) for i in range(n)],
        "count": [5550000 + i for i in range(n)],
        "small": [1, 2, 3] * 40,
        "ratio": [i / 7 for i in range(n)],
        "constant": ["same"] * n,
    }))
    assert profile.detect_types(df) == {
        "record_id": "uuid", "email": "email", "contact": "phone", "when_text": "datetime", "day_text": "datetime",
        "flag": "categorical", "person": "name", "blob": "text", "count": "integer", "small": "categorical", "ratio": "float",
        "constant": "categorical",
    }


def test_all_null_and_single_row(spark):
    df = spark.createDataFrame([(None, 3.5, "x")], "empty string, one double, label string")
    rows = {r["name"]: r for r in profile.profile_table(df).collect()}
    assert rows["empty"]["type"] == "text" and rows["empty"]["null_rate"] == 1.0 and rows["empty"]["unique_count"] == 0
    assert rows["one"]["std"] == 0.0 and rows["one"]["mean"] == 3.5
    assert rows["label"]["categories"] == {"x": 1.0}


def test_nan_counts_as_null(spark):
    df = spark.createDataFrame(pd.DataFrame({"v": [1.0, float("nan"), 3.0]}))
    row = profile.profile_table(df).first()
    assert (row["null_count"], row["unique_count"], row["mean"]) == (1, 2, 2.0)


def test_long_texts_are_counted_exactly(spark):
    df = spark.createDataFrame([("a" * 500 + str(i % 9),) for i in range(40)], "t string")
    assert profile.distinct_counts(df, ["t"]) == {"t": 9}


def test_approximate_counts_are_an_option(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    assert abs(profile.distinct_counts(df, ["k"], approximate=True)["k"] - 2000) < 300
