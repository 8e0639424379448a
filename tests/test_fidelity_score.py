"""The score of a synthetic table makes its statistics once."""

from pyspark.sql import functions as F

from doppel.operators import fidelity


def test_rows_and_gain_read_the_statistics_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            reads.add(len(frame))
            yield frame

    fields = [F.lit(x).alias(c) for c, x in (("shape", 90.0), ("relationship", 80.0), ("validity", 100.0), ("total", 88.0))]
    one = spark.range(1).select(*fields).mapInPandas(counted, "shape double, relationship double, validity double, total double")
    other = one.withColumn("total", F.lit(80.5))
    rows = {r["method"]: r for r in fidelity.fidelity_score(one, other).collect()}
    assert {m: (r["total"], r["improvement"]) for m, r in rows.items()} == {"copula": (88.0, 7.5), "independent": (80.5, 7.5)}
    assert reads.value == 2
