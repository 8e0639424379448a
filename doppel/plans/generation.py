"""Choose between learned and independent generation."""

from __future__ import annotations

from pyspark.sql import DataFrame

from pyspark.sql import functions as F

from doppel.checkpoint import settled
from doppel.functions.columns import col
from doppel.functions.rng import uniform
from doppel.operators.copula import LITERAL_CATEGORIES, fit_copula, sample_copula
from doppel.operators.generate import generate_table
from doppel.operators.marginals import IntervalLookup, categorical_marginals
from doppel.operators.profile import profile_schema


def _many_labels(made: DataFrame, real: DataFrame, names: list[str], seed: int, rid: str) -> DataFrame:
    """Columns of very many labels, drawn by their shares in the real table; generated nulls stay and the row id goes."""
    every = settled(categorical_marginals(real, names, []))
    out = [c for c in made.columns if c != rid]
    for c in names:
        drawn = made.withColumn("_u", uniform(seed, f"col:{c}", col(rid)))
        drawn = IntervalLookup(every.filter(F.col("column") == c)).attach(drawn, "_u", col(rid), "_label")
        made = drawn.select(rid, *[F.when(col(x).isNotNull(), F.col("_label")).alias(x) if x == c else col(x) for x in out])
    return made.drop(rid)


def generate_with_method(ids: DataFrame, schema: list[dict] | None = None, real: DataFrame | None = None,
                         real_ids: list[str] | None = None, method: str = "auto", seed: int = 42,
                         locale: str = "en_US", null_rate: float = 0.0, outlier_rate: float = 0.0,
                         id_column: str = "id",
                         literal: int = LITERAL_CATEGORIES) -> tuple[DataFrame, str, list[str]]:
    """Synthetic rows, the method used, and warnings.

    `auto` learns from the real table when there is one. Too little data to
    learn from, or no table, falls back to independent columns. All labels of a real table are learned; a
    column of more than `literal` keeps them in a table.
    """
    warnings: list[str] = []
    given = schema is not None
    schema = schema or profile_schema(real, top=literal)
    if method == "auto":
        method = "copula" if real is not None else "independent"
    if method == "copula" and real is None:
        warnings.append("No dataset given. Falling back to independent generation.")
        method = "independent"
    if method == "copula":
        types = {c["name"]: c["type"] for c in schema}
        model = fit_copula(real, types, real_ids or real.columns, seed, literal=literal)
        warnings += model.warnings
        if not model.independent:
            out = sample_copula(model, ids, seed, id_column, locale, null_rate)
            return out, "copula", warnings
    many = [] if given else [c["name"] for c in schema if c["type"] == "categorical" and c["stats"]["unique_count"] > literal]
    out = generate_table(ids, schema, seed, locale, null_rate, outlier_rate, id_column, "_row_id" if many else None)
    return (_many_labels(out, real, many, seed, "_row_id") if many else out), "independent", warnings
