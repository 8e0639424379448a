"""Column privacy: masks, pseudonyms and Laplace noise, folded into one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doppel.functions import masking
from doppel.functions.columns import col, numeric
from doppel.functions.rng import uniform

# Column-name hints, first match wins.
NAME_HINTS = [
    ("email", ["email", "mail"]),
    ("phone", ["phone", "tel", "mobile"]),
    ("name", ["name"]),
    ("credit_card", ["card", "cc"]),
]


def hinted_type(name: str, col_type: str | None) -> str:
    """Mask type of a column: the given type, or a guess from its name."""
    if col_type not in ("text", "generic", None):
        return col_type
    lower = name.lower()
    for kind, words in NAME_HINTS:
        if any(w in lower for w in words):
            return kind
    return "text"


def sniffed_types(df: DataFrame, names: list[str]) -> dict[str, str]:
    """Mask types from all values, in one pass: e-mail if some value holds an @, phone if some holds three digits in a row."""
    if not names:
        return {}
    seen = df.agg(*[e for i, c in enumerate(names) for v in [col(c).cast("string")] for e in (
        F.max(F.contains(v, F.lit("@"))).alias(f"at{i}"), F.max(v.rlike(r"\d{3,}")).alias(f"digits{i}"))]).first()
    return {c: "email" if seen[f"at{i}"] else "phone" if seen[f"digits{i}"] else "text" for i, c in enumerate(names)}


def mask(v: Column, kind: str) -> Column:
    return masking.MASKS.get(kind, masking.mask_generic)(v.cast("string"))


def mask_column(df: DataFrame, name: str, col_type: str | None = "text") -> DataFrame:
    """Mask one column by type, by its name, or by what its values look like."""
    kind = hinted_type(name, col_type)
    if kind == "text":
        kind = sniffed_types(df, [name])[name]
    return df.withColumn(name, mask(col(name), kind))


def value_ranges(df: DataFrame, values: dict[str, Column]) -> dict[str, float]:
    """max - min per entry (1 where that is 0 or there is no value), in one pass."""
    if not values:
        return {}
    row = df.agg(*[(F.max(v) - F.min(v)).alias(f"r{i}") for i, v in enumerate(values.values())]).first()
    return {name: float(row[f"r{i}"] or 1.0) for i, name in enumerate(values)}


def noisy(v: Column, name: str, ids: list[Column], seed: int, epsilon: float, sensitivity: float) -> Column:
    scale = sensitivity / max(epsilon, masking.MIN_EPSILON)
    return v + masking.laplace(uniform(seed, f"noise:{name}", *ids), F.lit(scale))


def laplace_noise(df: DataFrame, name: str, ids: list[str], seed: int = 42, epsilon: float = 1.0,
                  sensitivity: float | None = None) -> DataFrame:
    """Add Laplace(0, sensitivity / epsilon) to a numeric column; `ids` identify the rows."""
    if sensitivity is None:
        sensitivity = value_ranges(df, {name: numeric(df, name)})[name]
    return df.withColumn(name, noisy(numeric(df, name), name, [col(c) for c in ids], seed, epsilon, sensitivity))


def apply_privacy(df: DataFrame, rules: list[dict], ids: list[str] | None = None, seed: int = 42) -> DataFrame:
    """Apply an ordered rule list in one projection; unknown columns are skipped.

    Rules: {column, method: mask | pseudonymize | noise, col_type, salt, epsilon,
    sensitivity}. Noise draws and its scale come from the values as read; noise
    on a stream needs an explicit sensitivity, a mask there a col_type or a telling column name.
    """
    rules = [r for r in rules if r.get("column") in df.columns]
    measured = {
        r["column"]: numeric(df, r["column"])
        for r in rules if r.get("method") == "noise" and r.get("sensitivity") is None
    }
    if measured and df.isStreaming:
        raise ValueError("noise on a stream needs an explicit sensitivity")
    guessed = [r["column"] for r in rules if r.get("method", "mask") == "mask" and hinted_type(r["column"], r.get("col_type", "text")) == "text"]
    if guessed and df.isStreaming:
        raise ValueError(f"masks on a stream need a col_type for {', '.join(guessed)}")
    kinds = sniffed_types(df, list(dict.fromkeys(guessed)))
    ranges = value_ranges(df, measured)
    id_columns = [col(c) for c in ids or []]
    out: dict[str, Column] = {}
    for rule in rules:
        name, method = rule["column"], rule.get("method", "mask")
        current = out.get(name, col(name))
        if method == "mask":
            kind = hinted_type(name, rule.get("col_type", "text"))
            if kind == "text":
                kind = kinds[name]
            out[name] = mask(current, kind)
        elif method == "pseudonymize":
            out[name] = masking.pseudonym(current.cast("string"), rule["salt"])
        elif method == "noise":
            if not id_columns:
                raise ValueError("noise needs the row id columns")
            value = numeric(df, name) if name not in out else current.cast("double")
            sensitivity = rule.get("sensitivity")
            sensitivity = ranges[name] if sensitivity is None else float(sensitivity)
            out[name] = noisy(value, name, id_columns, seed, rule.get("epsilon", 1.0), sensitivity)
    return df.select(*[out.get(c, col(c)).alias(c) for c in df.columns])
