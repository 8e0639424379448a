"""Currency, tax and date format by locale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doppel.functions.rng import interval_pick

DEFAULT = "en_US"

# Locale, country, currency code, symbol, tax label, tax rate, date format.
LOCALES = [
    ("en_US", "United States", "USD", "$", "Sales Tax", 0.08, "MM/dd/yyyy"),
    ("en_GB", "United Kingdom", "GBP", "£", "VAT", 0.20, "dd/MM/yyyy"),
    ("ur_PK", "Pakistan", "PKR", "Rs.", "GST", 0.17, "dd/MM/yyyy"),
    ("de_DE", "Germany", "EUR", "€", "MwSt", 0.19, "dd.MM.yyyy"),
    ("fr_FR", "France", "EUR", "€", "TVA", 0.20, "dd/MM/yyyy"),
    ("es_ES", "Spain", "EUR", "€", "IVA", 0.21, "dd/MM/yyyy"),
    ("it_IT", "Italy", "EUR", "€", "IVA", 0.22, "dd/MM/yyyy"),
    ("en_CA", "Canada", "CAD", "CA$", "HST/GST", 0.13, "yyyy-MM-dd"),
    ("en_AU", "Australia", "AUD", "A$", "GST", 0.10, "dd/MM/yyyy"),
    ("hi_IN", "India", "INR", "₹", "GST", 0.18, "dd/MM/yyyy"),
    ("ar_SA", "Saudi Arabia", "SAR", "﷼", "VAT", 0.15, "dd/MM/yyyy"),
    ("ar_AE", "United Arab Emirates", "AED", "AED", "VAT", 0.05, "dd/MM/yyyy"),
    ("ja_JP", "Japan", "JPY", "¥", "Consumption Tax", 0.10, "yyyy/MM/dd"),
    ("zh_CN", "China", "CNY", "¥", "VAT", 0.13, "yyyy-MM-dd"),
    ("tr_TR", "Turkey", "TRY", "₺", "KDV", 0.20, "dd.MM.yyyy"),
    ("pt_BR", "Brazil", "BRL", "R$", "ICMS", 0.17, "dd/MM/yyyy"),
    ("nl_NL", "Netherlands", "EUR", "€", "BTW", 0.21, "dd-MM-yyyy"),
]
FIELDS = ["locale", "country", "currency_code", "currency_symbol", "tax_label", "tax_rate", "date_format"]

# Other currencies of a currency column and the shares of all four.
OTHER_CURRENCIES = ["USD", "EUR", "GBP"]
CURRENCY_ENDS = [0.85, 0.90, 0.95, 1.0]


def config(locale: str) -> dict:
    """Settings of a locale; an unknown one gets those of en_US."""
    rows = {r[0]: dict(zip(FIELDS, r)) for r in LOCALES}
    return rows.get(locale, rows[DEFAULT])


def locale_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        LOCALES, "locale string, country string, currency_code string, currency_symbol string, tax_label string, "
                 "tax_rate double, date_format string"
    )


def known_locale(c: Column) -> Column:
    return F.when(c.isin([r[0] for r in LOCALES]), c).otherwise(F.lit(DEFAULT))


def with_locale(df: DataFrame, column: str) -> DataFrame:
    """Add the settings of each row's locale (17 rows, broadcast); unknown ones get en_US."""
    settings = F.broadcast(locale_table(df.sparkSession).withColumnRenamed("locale", "_locale"))
    return df.join(settings, known_locale(F.coalesce(F.col(column), F.lit(""))) == F.col("_locale")).drop("_locale")


def currency(u: Column, locale: str) -> Column:
    """Mostly the locale's own currency, else one of three others."""
    return interval_pick([config(locale)["currency_code"], *OTHER_CURRENCIES], CURRENCY_ENDS, u)


def format_date(day: Column, pattern: Column) -> Column:
    """A date in one of the locale formats (Spark patterns must be literal, so one branch each)."""
    out = F.date_format(day, "MM/dd/yyyy")
    for p in sorted({r[6] for r in LOCALES}):
        out = F.when(pattern == p, F.date_format(day, p)).otherwise(out)
    return out
