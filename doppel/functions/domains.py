"""Typed table schemas by subject, chosen from a free-text description."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keywords of each domain, first match wins.
KEYWORDS = [
    ("sensor", ["sensor", "iot", "temperature", "device", "reading"]),
    ("patient", ["patient", "hospital", "health", "medical", "clinical", "doctor"]),
    ("transaction", ["transaction", "payment", "fintech", "bank", "fraud", "crypto"]),
    ("employee", ["employee", "hr", "staff", "worker", "payroll", "salary"]),
    ("student", ["student", "school", "university", "college", "course", "grade"]),
    ("customer", ["customer", "e-commerce", "ecommerce", "order", "shop", "retail", "sales"]),
]
DEFAULT = "generic"


def _number(name, kind, low, high, mean, std):
    return {"name": name, "type": kind, "stats": {"min": low, "max": high, "mean": mean, "std": std}}


def _label(name, shares):
    return {"name": name, "type": "categorical", "stats": {"categories": shares}}


def _time(name, low, high):
    return {"name": name, "type": "datetime", "stats": {"min_time": low, "max_time": high}}


def _plain(name, kind):
    return {"name": name, "type": kind, "stats": {}}


# The columns of each domain.
SCHEMAS = {
    "sensor": [
        _plain("device_id", "id"),
        _plain("warehouse_location", "address"),
        _number("temp_celsius", "float", -15, 95, 22, 12),
        _number("humidity_pct", "float", 20, 99, 55, 18),
        _label("warning_alert", {"normal": 0.82, "warning": 0.12, "critical": 0.06}),
        _time("recorded_at", "2024-01-01", "2024-12-31"),
    ],
    "patient": [
        _plain("patient_id", "id"),
        _plain("patient_name", "name"),
        _number("age", "integer", 18, 95, 48, 16),
        _number("blood_pressure", "float", 80, 190, 122, 16),
        _number("heart_rate", "integer", 50, 140, 74, 12),
        _label("diagnosis", {"Hypertension": 0.3, "Diabetes": 0.25, "Asthma": 0.15, "None": 0.3}),
        _time("visit_date", "2023-01-01", "2024-12-31"),
    ],
    "transaction": [
        _plain("transaction_id", "uuid"),
        _plain("account_holder", "name"),
        _plain("email", "email"),
        _number("amount", "float", 5, 50000, 320, 950),
        _label("currency", {"USD": 0.5, "EUR": 0.25, "GBP": 0.15, "PKR": 0.1}),
        _label("type", {"debit": 0.65, "credit": 0.25, "transfer": 0.1}),
        _label("status", {"completed": 0.88, "pending": 0.08, "failed": 0.04}),
        _time("timestamp", "2024-01-01", "2024-12-31"),
    ],
    "employee": [
        _plain("employee_id", "id"),
        _plain("full_name", "name"),
        _plain("email", "email"),
        _label("department", {"Engineering": 0.35, "Sales": 0.25, "Marketing": 0.2, "HR": 0.1, "Finance": 0.1}),
        _number("salary", "float", 35000, 210000, 88000, 28000),
        _number("performance_score", "float", 1, 5, 3.9, 0.7),
        _time("hire_date", "2020-01-01", "2024-12-31"),
    ],
    "student": [
        _plain("student_id", "id"),
        _plain("student_name", "name"),
        _plain("email", "email"),
        _label("major", {"Computer Science": 0.35, "Business": 0.25, "Biology": 0.2, "Economics": 0.2}),
        _number("gpa", "float", 2.0, 4.0, 3.25, 0.45),
        _number("enrollment_year", "integer", 2021, 2025, 2023, 1),
    ],
    "customer": [
        _plain("customer_id", "id"),
        _plain("full_name", "name"),
        _plain("email", "email"),
        _plain("phone", "phone"),
        _plain("city", "address"),
        _number("total_orders", "integer", 1, 250, 18, 22),
        _number("total_spent", "float", 15, 12000, 520, 850),
        _label("currency", {"USD": 0.5, "EUR": 0.25, "GBP": 0.15, "PKR": 0.1}),
        _time("signup_date", "2021-01-01", "2024-12-31"),
    ],
    "generic": [
        _plain("record_id", "id"),
        _plain("name", "name"),
        _plain("email", "email"),
        _label("category", {"Type A": 0.45, "Type B": 0.35, "Type C": 0.20}),
        _number("value", "float", 10, 1000, 250, 120),
        _label("status", {"active": 0.8, "inactive": 0.15, "pending": 0.05}),
        _time("created_at", "2023-01-01", "2024-12-31"),
    ],
}


def domain_of(text: Column) -> Column:
    """The first domain with a keyword inside the text, case ignored."""
    lower = F.lower(text)
    out = F.lit(DEFAULT)
    for domain, words in reversed(KEYWORDS):
        hit = reduce(lambda a, b: a | b, [F.contains(lower, F.lit(w)) for w in words])
        out = F.when(hit, F.lit(domain)).otherwise(out)
    return out


def schema_rows() -> list[tuple[str, int, str, str]]:
    return [(d, i + 1, c["name"], c["type"]) for d, cols in SCHEMAS.items() for i, c in enumerate(cols)]


def schema_table(spark: SparkSession) -> DataFrame:
    """domain, position, column_name, type."""
    return spark.createDataFrame(schema_rows(), "domain string, position int, column_name string, type string")


def infer_domain(df: DataFrame, text: str) -> DataFrame:
    """Add the domain of a description."""
    return df.withColumn("domain", domain_of(F.col(text)))


def inferred_schemas(df: DataFrame, text: str) -> DataFrame:
    """One row per description and column of its domain's schema (a table of fixed size, so it is broadcast)."""
    return infer_domain(df, text).join(F.broadcast(schema_table(df.sparkSession)), "domain")
