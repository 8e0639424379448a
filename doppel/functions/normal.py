"""Normal distribution and interpolation as Column arithmetic.

Spark has no erf and no inverse normal. Both are written as rational
approximations so they stay inside generated code.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Coefficients of algorithm AS241 (PPND16), highest power first.
PPF_CENTRE = (
    [2509.0809287301226727, 33430.575583588128105, 67265.770927008700853, 45921.953931549871457,
     13731.693765509461125, 1971.5909503065514427, 133.14166789178437745, 3.387132872796366608],
    [5226.495278852545925, 28729.085735721942674, 39307.89580009271061, 21213.794301586595867,
     5394.1960214247511077, 687.1870074920579083, 42.313330701600911252, 1.0],
)
PPF_MIDDLE = (
    [7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177, 1.27045825245236838258,
     3.64784832476320460504, 5.7694972214606914055, 4.6303378461565452959, 1.42343711074968357734],
    [1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966, 0.14810397642748007459,
     0.68976733498510000455, 1.6763848301838038494, 2.05319162663775882187, 1.0],
)
PPF_TAIL = (
    [2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386, 0.026532189526576123093,
     0.29656057182850489123, 1.7848265399172913358, 5.4637849111641143699, 6.6579046435011037772],
    [2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5, 7.868691311456132591e-4,
     0.0148753612908506148525, 0.13692988092273580531, 0.59983220655588793769, 1.0],
)
# Coefficients of Hart's algorithm 5666 for the normal tail, highest power first.
CDF_TAIL = (
    [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
     221.213596169931, 220.206867912376],
    [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
     637.333633378831, 793.826512519948, 440.413735824752],
)


def _horner(coefficients: Sequence[float], x: str) -> str:
    out = f"{coefficients[0]!r}D"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}D)"
    return out


def _ratio(table, x: str) -> str:
    return f"({_horner(table[0], x)} / {_horner(table[1], x)})"


def add_norm_ppf(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add the inverse normal, accurate to about 1e-16: {new column: column of probabilities in (0, 1)}.

    The variable of the polynomials is used dozens of times, so it gets
    projections of its own; the optimiser keeps such a column instead of
    copying its expression. Column names must be plain.
    """
    if not columns:
        return df
    roots, places, values = {}, {}, {}
    for z, p in columns.items():
        q, r, w = f"({p} - 0.5D)", f"_r_{z}", f"_w_{z}"
        roots[r] = F.expr(f"coalesce(sqrt(-ln(if({q} <= 0D, {p}, 1.0D - {p}))), 0D)")
        places[w] = F.expr(f"case when abs({q}) <= 0.425D then 0.180625D - {q} * {q} "
                           f"when {r} <= 5.0D then {r} - 1.6D else {r} - 5.0D end")
        tail = f"if({r} <= 5.0D, {_ratio(PPF_MIDDLE, w)}, {_ratio(PPF_TAIL, w)})"
        values[z] = F.expr(f"case when {p} is null then null when abs({q}) <= 0.425D then {q} * {_ratio(PPF_CENTRE, w)} "
                           f"else {tail} * if({q} < 0D, -1D, 1D) end")
    done = df.withColumns(roots).withColumns(places).withColumns(values)
    return done.drop(*roots, *places)


def add_norm_cdf(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add the normal CDF, absolute error below 1e-14: {new column: column of numbers}."""
    if not columns:
        return df
    parts, values = {}, {}
    for u, x in columns.items():
        a, d = f"_a_{u}", f"_d_{u}"
        parts[a] = F.expr(f"abs({x})")
        parts[d] = F.expr(f"exp(-abs({x}) * abs({x}) / 2.0D)")
        far = f"({a} + 0.65D)"
        for k in (4.0, 3.0, 2.0, 1.0):
            far = f"({a} + {k}D / {far})"
        upper = f"if({a} < 7.07106781186547D, {d} * {_ratio(CDF_TAIL, a)}, {d} / {far} / 2.506628274631D)"
        values[u] = F.expr(f"if({x} > 0D, 1.0D - {upper}, {upper})")
    done = df.withColumns(parts).withColumns(values)
    return done.drop(*parts)


def interp_grid(u: Column, table: Column, points: int) -> Column:
    """Linear interpolation of u in [0, 1] through `points` equally spaced values."""
    at = u * F.lit(float(points - 1))
    i = F.least(F.floor(at), F.lit(points - 2)).cast("int")
    left = F.get(table, i)
    return left + (F.get(table, i + 1) - left) * (at - i)


def round_even(x: Column, digits: int = 0) -> Column:
    """Round half to even after scaling, the way array libraries round."""
    scale = F.lit(float(10**digits))
    return F.rint(x * scale) / scale if digits else F.rint(x)
