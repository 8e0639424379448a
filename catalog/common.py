"""What the query catalogue shares: table reading, the standard real/synthetic pair, SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doppel.functions import normal
from doppel.session import spread

SEED = 42


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wide(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that is heavy per row: spread over the cores when it lies in few row groups."""
    return spread(table(spark, sf_dir, name))


def halves(spark: SparkSession, sf_dir: str, *columns: str) -> tuple[DataFrame, DataFrame]:
    """Real = lineitem rows of even orders, synthetic = those of odd orders."""
    items = wide(spark, sf_dir, "lineitem")
    even = F.col("l_orderkey") % 2 == 0
    columns = columns or tuple(items.columns)
    return items.filter(even).select(*columns), items.filter(~even).select(*columns)


LINE_TYPES = {
    "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float",
    "l_linenumber": "categorical", "l_returnflag": "categorical", "l_linestatus": "categorical",
    "l_shipdate": "datetime",
}
LINE_NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]
LINE_LABELS = ["l_linenumber", "l_returnflag", "l_linestatus"]
LINE_COLUMNS = [*LINE_NUMERIC[:4], *LINE_LABELS, "l_shipdate"]


# ---- SQL text -------------------------------------------------------------

def s(text: str) -> str:
    return "'" + str(text).replace("'", "''") + "'"


def u(stream: str, *ids: str, seed: int = SEED) -> str:
    """Uniform draw of a row."""
    key = f"concat_ws('|', '{seed}', {s(stream)}, {', '.join(f'cast({i} as varchar)' for i in ids)})"
    return f"((cast(('0x' || substr(md5({key}), 1, 13)) as bigint))::double + 0.5) / 4503599627370496.0::double"


def rnd(x: str, digits: int = 0) -> str:
    if not digits:
        return f"round_even(({x})::double, 0)"
    scale = f"{float(10**digits)!r}::double"
    return f"(round_even(({x})::double * {scale}, 0) / {scale})"


def _horner(coefficients, x: str) -> str:
    out = f"{coefficients[0]!r}::double"
    for c in coefficients[1:]:
        out = f"({out} * {x} + {c!r}::double)"
    return out


def _ratio(pair, x: str) -> str:
    return f"({_horner(pair[0], x)} / {_horner(pair[1], x)})"


def ppf(p: str) -> str:
    """Inverse normal of a column name."""
    q = f"({p} - 0.5::double)"
    r = f"sqrt(-ln(case when {q} <= 0 then {p} else 1.0::double - {p} end))"
    tail = (f"(case when {r} <= 5.0 then {_ratio(normal.PPF_MIDDLE, f'({r} - 1.6::double)')} "
            f"else {_ratio(normal.PPF_TAIL, f'({r} - 5.0::double)')} end)")
    return (f"(case when abs({q}) <= 0.425 then {q} * {_ratio(normal.PPF_CENTRE, f'(0.180625::double - {q} * {q})')} "
            f"when {q} < 0 then -{tail} else {tail} end)")


def cdf(x: str) -> str:
    """Normal CDF of a column name."""
    a = f"abs({x})"
    far = f"({a} + 0.65::double)"
    for k in (4.0, 3.0, 2.0, 1.0):
        far = f"({a} + {k}::double / {far})"
    density = f"exp(-{a} * {a} / 2.0::double)"
    upper = (f"(case when {a} < 7.07106781186547 then {density} * {_ratio(normal.CDF_TAIL, a)} "
             f"else {density} / {far} / 2.506628274631::double end)")
    return f"(case when {x} > 0 then 1.0::double - {upper} else {upper} end)"


def pick(values, u_sql: str) -> str:
    return f"([{', '.join(s(v) for v in values)}])[cast(floor({u_sql} * {float(len(values))!r}) as bigint) + 1]"


def epoch(c: str) -> str:
    return f"(epoch_us({c}) / 1000000.0::double)"
