"""Semantic profiling of a table in a fixed number of jobs, whatever its width."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from doppel.functions.columns import IDENTITY_TYPES, col, is_numeric, numeric, quoted
from doppel.functions.masking import WHITESPACE
from doppel.functions.normal import round_even

# Patterns, name hints and thresholds of the type rules.
EMAIL = r"^[a-zA-Z0-9_.+-]+@[a-zA-Z0-9-]+\.[a-zA-Z0-9-.]+$"
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
PHONE = r"^[\+]?[\d\s\-\(\)\.]{7,20}$"
HINTS = {
    "email": {"email", "e_mail", "email_address", "mail", "user_email"},
    "name": {"name", "first_name", "last_name", "full_name", "firstname", "lastname", "fullname", "customer_name",
             "employee_name", "user_name", "username", "first", "last", "given_name", "surname"},
    "phone": {"phone", "telephone", "tel", "mobile", "cell", "phone_number", "contact_number", "fax"},
    "address": {"address", "street", "street_address", "city", "state", "zip", "zipcode", "zip_code", "postal_code",
                "country"},
    "id": {"id", "uuid", "guid", "identifier", "record_id", "transaction_id"},
}
NOT_PHONE = {"year", "month", "day", "age", "count", "amount", "price", "quantity", "qty", "total", "score", "rating",
             "weight", "height"}
PATTERN_SHARE = 0.8
MAX_UNIQUE = 50
MAX_UNIQUE_RATIO = 0.05
MIN_ROWS_FOR_RATIO = 20
NAME_MAX_LENGTH = 25
NAME_WORDS = (1.5, 3.5)
TOP_CATEGORIES = 50

# Strings longer than this are counted by their SHA-256, so long texts are not shuffled.
LONG_TEXT = 64

# Text that cannot be a time is not parsed: a failed parse costs an exception.
_TIME_TEXT = r"^\s*[+-]?\d{1,4}([./-]\d|$)"
_DATE_FORMATS = ["MM/dd/yyyy", "dd/MM/yyyy", "dd.MM.yyyy", "yyyy/MM/dd", "dd-MM-yyyy"]

SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("null_count", T.LongType()),
    T.StructField("null_rate", T.DoubleType()),
    T.StructField("total_count", T.LongType()),
    T.StructField("unique_count", T.LongType()),
    T.StructField("min", T.DoubleType()),
    T.StructField("max", T.DoubleType()),
    T.StructField("mean", T.DoubleType()),
    T.StructField("std", T.DoubleType()),
    T.StructField("min_time", T.StringType()),
    T.StructField("max_time", T.StringType()),
    T.StructField("avg_length", T.DoubleType()),
    T.StructField("min_length", T.LongType()),
    T.StructField("max_length", T.LongType()),
    T.StructField("categories", T.MapType(T.StringType(), T.DoubleType())),
])


def is_time(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def _is_float(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType, T.DecimalType))


def _present(df: DataFrame, name: str) -> Column:
    """The column with NaN read as null."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(col(name)), col(name))
    return col(name)


def parsed_time(name: str) -> Column:
    """Text as a timestamp: ISO, or one of the common day formats; null when neither."""
    q = quoted(name)
    tries = [f"try_cast({q} as timestamp_ntz)"]
    tries += [f"cast(try_to_timestamp({q}, '{f}') as timestamp_ntz)" for f in _DATE_FORMATS]
    return F.when((F.length(col(name)) <= 40) & col(name).rlike(_TIME_TEXT), F.expr(f"coalesce({', '.join(tries)})"))


def _label(df: DataFrame, name: str) -> Column:
    v = _present(df, name).cast("string")
    if isinstance(df.schema[name].dataType, T.StringType):
        return F.when(F.octet_length(v) > LONG_TEXT, F.sha2(v, 256)).otherwise(v)
    return v


def distinct_counts(df: DataFrame, names: list[str], approximate: bool = False) -> dict[str, int]:
    """Distinct non-null values of every column, in one job."""
    if approximate:
        row = df.agg(*[F.approx_count_distinct(_label(df, c)).alias(f"d{i}") for i, c in enumerate(names)]).first()
        return {c: row[f"d{i}"] for i, c in enumerate(names)}
    labels = F.explode(F.array(*[
        F.struct(F.lit(i).alias("i"), _label(df, c).alias("v")) for i, c in enumerate(names)
    ])).alias("p")
    values = df.select(labels).select("p.i", "p.v").filter("v is not null").groupBy("i", "v").agg(F.lit(1).alias("one"))
    found = {r["i"]: r["n"] for r in values.groupBy("i").agg(F.count("one").alias("n")).collect()}
    return {c: found.get(i, 0) for i, c in enumerate(names)}


def _measures(df: DataFrame, name: str) -> dict[str, Column]:
    kind = df.schema[name].dataType
    v = _present(df, name)
    out = {"n": F.count(v)}
    if isinstance(kind, T.StringType):
        n = F.length(v)
        out["uuid"] = F.count_if(v.rlike(UUID))
        out["email"] = F.count_if(v.rlike(EMAIL))
        out["phone"] = F.count_if(v.rlike(PHONE))
        t = parsed_time(name)
        out["times"], out["tmin"], out["tmax"] = F.count(t), F.min(t), F.max(t)
        out["lmean"], out["lmin"], out["lmax"] = F.avg(n), F.min(n), F.max(n)
    elif is_time(kind):
        out["tmin"], out["tmax"] = (F.min(v.cast("timestamp_ntz")), F.max(v.cast("timestamp_ntz")))
    elif isinstance(kind, T.NumericType):
        d = v.cast("double")
        out["min"], out["max"], out["mean"], out["std"] = F.min(d), F.max(d), F.avg(d), F.stddev_samp(d)
    return out


def measure(df: DataFrame, approximate: bool = False) -> dict[str, dict]:
    """All single-pass facts and the distinct count of every column."""
    names = df.columns
    wanted = {c: _measures(df, c) for c in names}
    row = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[e.alias(f"{k}_{i}") for i, c in enumerate(names) for k, e in wanted[c].items()],
    ).first()
    distinct = distinct_counts(df, names, approximate)
    return {
        c: {**{k: row[f"{k}_{i}"] for k in wanted[c]}, "total": row["total"], "distinct": distinct[c]}
        for i, c in enumerate(names)
    }


def _few_values(facts: dict, small_tables: bool) -> bool:
    n, d = facts["n"], facts["distinct"]
    return d <= MAX_UNIQUE or ((n > MIN_ROWS_FOR_RATIO or not small_tables) and d / n < MAX_UNIQUE_RATIO)


def _rule(name: str, kind: T.DataType, facts: dict) -> str:
    """The type of a column, or "words?" when only its word count can tell name from text."""
    n = facts["n"]
    if n == 0:
        return "text"
    lower = name.lower().strip().replace(" ", "_")
    share = {k: facts.get(k, 0) / n for k in ("uuid", "email", "phone", "times")}
    for hint in ("email", "name", "phone", "address"):
        if lower in HINTS[hint]:
            return hint
    if lower in HINTS["id"]:
        return "uuid" if share["uuid"] > PATTERN_SHARE else "id"
    if share["uuid"] > PATTERN_SHARE:
        return "uuid"
    if share["email"] > PATTERN_SHARE:
        return "email"
    if is_time(kind) or share["times"] > PATTERN_SHARE:
        return "datetime"
    if lower not in NOT_PHONE and share["phone"] > PATTERN_SHARE:
        return "phone"
    if isinstance(kind, T.BooleanType):
        return "categorical"
    if isinstance(kind, T.IntegralType):
        return "categorical" if _few_values(facts, False) else "integer"
    if _is_float(kind):
        return "float"
    if not isinstance(kind, T.StringType):
        return "text"
    if _few_values(facts, True):
        return "categorical"
    return "words?" if facts["lmean"] < NAME_MAX_LENGTH else "text"


def _types(df: DataFrame, facts: dict[str, dict]) -> dict[str, str]:
    types = {c: _rule(c, df.schema[c].dataType, facts[c]) for c in df.columns}
    unsure = [c for c, t in types.items() if t == "words?"]
    if unsure:
        words = [F.avg(F.size(F.filter(F.split(col(c), WHITESPACE), lambda w: w != ""))) for c in unsure]
        row = df.agg(*[w.alias(f"w{i}") for i, w in enumerate(words)]).first()
        for i, c in enumerate(unsure):
            types[c] = "name" if NAME_WORDS[0] <= row[f"w{i}"] <= NAME_WORDS[1] else "text"
    return types


def detect_types(df: DataFrame, approximate: bool = False) -> dict[str, str]:
    """Semantic type of every column."""
    return _types(df, measure(df, approximate))


def types_table(spark: SparkSession, types: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(types.items()), "column_name string, type string")


def null_profile(df: DataFrame, names: list[str]) -> DataFrame:
    """Per column: null_count, null_rate, total_count, unique_count."""
    labels = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), _label(df, c).alias("v")) for c in names
    ])).alias("p")
    values = df.select(labels).groupBy("p.column_name", "p.v").agg(F.count(F.lit(1)).alias("n"))
    per = values.groupBy("column_name").agg(
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.sum("n").alias("total_count"),
        F.count("v").alias("unique_count"),
    )
    return per.select("column_name", "null_count",
                      round_even(F.col("null_count") / F.col("total_count"), 4).alias("null_rate"),
                      "total_count", "unique_count")


def _long(df: DataFrame, names: list[str], measures: dict) -> DataFrame:
    """One aggregation row turned into one row per column."""
    row = df.agg(*[f(c).alias(f"{k}_{i}") for i, c in enumerate(names) for k, f in measures.items()])
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), *[F.col(f"{k}_{i}").alias(k) for k in measures])
        for i, c in enumerate(names)
    ])
    return row.select(F.explode(pairs).alias("r")).select("r.*")


def numeric_profile(df: DataFrame, names: list[str]) -> DataFrame:
    """Per column: min, max, mean and sample standard deviation (0 for one row)."""
    return _long(df, names, {
        "min": lambda c: F.min(numeric(df, c)),
        "max": lambda c: F.max(numeric(df, c)),
        "mean": lambda c: round_even(F.avg(numeric(df, c)), 4),
        "std": lambda c: round_even(F.coalesce(F.stddev_samp(numeric(df, c)), F.lit(0.0)), 4),
    })


def top_categories(df: DataFrame, names: list[str], limit: int = TOP_CATEGORIES) -> DataFrame:
    """The most frequent values of each column with their share of non-null rows, ties by value."""
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), _present(df, c).cast("string").alias("category")) for c in names
    ])).alias("p")
    counts = df.select(pairs).filter("p.category is not null").groupBy("p.column_name", "p.category").agg(
        F.count(F.lit(1)).alias("n")
    )
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("total"))
    first = Window.partitionBy("column_name").orderBy(F.desc("n"), "category")
    top = counts.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= limit)
    return top.join(F.broadcast(totals), "column_name").select(
        "column_name", "category", "n", round_even(F.col("n") / F.col("total"), 4).alias("share"), "rank"
    )


def datetime_profile(df: DataFrame, names: list[str]) -> DataFrame:
    """Per column: first and last time as ISO text."""
    iso = "yyyy-MM-dd'T'HH:mm:ss"

    def time(c):
        kind = df.schema[c].dataType
        return parsed_time(c) if isinstance(kind, T.StringType) else col(c).cast("timestamp_ntz")

    return _long(df, names, {
        "min_time": lambda c: F.date_format(F.min(time(c)), iso),
        "max_time": lambda c: F.date_format(F.max(time(c)), iso),
    })


def text_profile(df: DataFrame, names: list[str]) -> DataFrame:
    """Per column: mean, least and greatest length."""
    return _long(df, names, {
        "avg_length": lambda c: round_even(F.avg(F.length(col(c))), 1),
        "min_length": lambda c: F.min(F.length(col(c))).cast("bigint"),
        "max_length": lambda c: F.max(F.length(col(c))).cast("bigint"),
    })


def _iso(value) -> str | None:
    return value.isoformat() if value is not None else None


def profile_schema(df: DataFrame, approximate: bool = False, top: int = TOP_CATEGORIES) -> list[dict]:
    """The semantic schema: one dict per column, as the generators take it. Categorical columns list their `top` categories."""
    facts = measure(df, approximate)
    types = _types(df, facts)
    labels = [c for c in df.columns if types[c] == "categorical" and facts[c]["n"]]
    shares: dict[str, dict[str, float]] = {c: {} for c in labels}
    if labels:
        for r in top_categories(df, labels, top).orderBy("column_name", "rank").collect():
            shares[r["column_name"]][r["category"]] = r["share"]
    schema = []
    for c in df.columns:
        f, kind = facts[c], types[c]
        nulls = f["total"] - f["n"]
        stats = {
            "null_count": nulls, "null_rate": round(nulls / f["total"], 4) if f["total"] else 0.0,
            "total_count": f["total"], "unique_count": f["distinct"],
        }
        if kind in ("integer", "float") and f["n"] and f.get("min") is not None:
            stats.update(min=f["min"], max=f["max"], mean=round(f["mean"], 4), std=round(f["std"] or 0.0, 4))
        elif kind == "categorical":
            stats["categories"] = shares.get(c, {})
        elif kind == "datetime":
            stats.update(min_time=_iso(f["tmin"]), max_time=_iso(f["tmax"]))
        elif kind == "text" and f["n"] and "lmean" in f:
            stats.update(avg_length=round(f["lmean"], 1), min_length=f["lmin"], max_length=f["lmax"])
        schema.append({"name": c, "type": kind, "stats": stats})
    return schema


def profile_table(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: type and the statistics that belong to the type."""
    rows = []
    for c in profile_schema(df, approximate):
        s = c["stats"]
        rows.append(tuple(
            c[f.name] if f.name in ("name", "type") else s.get(f.name) for f in SCHEMA.fields
        ))
    return df.sparkSession.createDataFrame(rows, SCHEMA)


def modelling_roles(df: DataFrame, types: dict[str, str]) -> dict[str, str]:
    """numeric or categorical for every modelled column; identity columns are left out."""
    roles, check = {}, []
    for c in df.columns:
        kind = types.get(c)
        if kind in IDENTITY_TYPES:
            continue
        if kind in ("integer", "float", "datetime"):
            roles[c] = "numeric"
        elif kind in ("categorical", "boolean"):
            roles[c] = "categorical"
            check.append(c)
        else:
            roles[c] = "numeric" if is_numeric(df.schema[c].dataType) else "categorical"
    check = [c for c in check if not isinstance(df.schema[c].dataType, T.BooleanType)]
    if check:
        row = df.agg(*[
            e for i, c in enumerate(check) for e in (
                F.count(_present(df, c)).alias(f"n{i}"),
                F.count(numeric(df, c)).alias(f"k{i}"),
            )
        ]).first()
        all_numbers = [c for i, c in enumerate(check) if row[f"n{i}"] and row[f"n{i}"] == row[f"k{i}"]]
        if all_numbers:
            for c, d in distinct_counts(df, all_numbers).items():
                if d > 10:
                    roles[c] = "numeric"
    return roles


def reclassify_numeric_categories(df: DataFrame, types: dict[str, str]) -> dict[str, str]:
    """Categorical columns whose every value is a number become integer or float."""
    labels = [c for c in df.columns if types.get(c) == "categorical"
              and not isinstance(df.schema[c].dataType, T.BooleanType)]
    if not labels:
        return dict(types)
    row = df.agg(*[
        e for i, c in enumerate(labels) for e in (
            F.count(_present(df, c)).alias(f"n{i}"),
            F.count(numeric(df, c)).alias(f"k{i}"),
            F.count_if(numeric(df, c) == F.floor(numeric(df, c))).alias(f"w{i}"),
        )
    ]).first()
    out = dict(types)
    for i, c in enumerate(labels):
        n = row[f"n{i}"]
        if n and n == row[f"k{i}"]:
            out[c] = "integer" if row[f"w{i}"] == n else "float"
    return out
