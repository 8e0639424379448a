"""Money arithmetic and formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doppel.functions.normal import round_even

MONEY = "decimal(18,2)"

# Symbols written without a space before the amount.
TIGHT_SYMBOLS = ["$", "£", "€", "₹", "¥", "₺", "CA$", "A$"]


def money(x: Column) -> Column:
    """A double as exact cents, half to even."""
    return round_even(x.cast("double"), 2).cast(MONEY)


def format_money(amount: Column, symbol: Column) -> Column:
    text = F.format_number(amount.cast("double"), 2)
    return F.when(symbol.isin(TIGHT_SYMBOLS), F.concat(symbol, text)).otherwise(F.concat(symbol, F.lit(" "), text))
