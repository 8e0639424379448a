"""Vectors without components."""

from __future__ import annotations

from doppel.llm import topk


def test_empty_vectors_score_nothing(spark):
    rows = spark.createDataFrame([(k, []) for k in (3, 1, 2)], "vec_id long, vector array<long>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(rows, rows.where("vec_id < 3"), 1).collect())
    assert got == [(1, 1, 2, 0), (2, 1, 1, 0)]
    assert topk.top_k(rows.where("vec_id > 9"), rows, 1).count() == 0
