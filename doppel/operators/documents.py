"""Invoices and bank statements as nested rows: one row per document, money in exact cents."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from doppel.functions import identity, locales, pools
from doppel.functions.masking import WHITESPACE
from doppel.functions.money import MONEY, format_money, money
from doppel.functions.rng import pick, uniform, uniform_int

# Ranges of generated documents.
ITEMS_LOW, ITEMS_HIGH = 2, 8
QUANTITY_LOW, QUANTITY_HIGH = 1, 10
PRICE_LOW, PRICE_HIGH = 10.0, 500.0
DATE_WINDOW, DUE_DAYS = 90, 30
CREDIT_SHARE = 0.25
CREDIT_LOW, CREDIT_HIGH = 50.0, 2000.0
DEBIT_LOW, DEBIT_HIGH, DEBIT_FLOOR = 5.0, 800.0, 10.0
OVERDRAFT_ROOM = 1000.0
LEAST_DEBIT = 1.0
SALARY_TEXT, SALARY_SOURCE = "Salary Deposit", "Employer Direct Deposit"

# Words that give away a document's locale, first match wins, and words of non-item lines.
LOCALE_WORDS = [
    ("ur_PK", ["pkr", "rs.", "pakistan"]),
    ("en_GB", ["gbp", "£", "united kingdom"]),
    ("de_DE", ["eur", "€", "germany", "euro"]),
    ("en_CA", ["cad", "canada"]),
    ("en_AU", ["aud", "australia"]),
]
NOT_ITEMS = ["invoice", "date", "total", "subtotal", "tax", "bill to", "due", "amount", "page"]
LINE_LOW, LINE_HIGH = 4, 39
LINES_PER_ITEM, FEWEST_ITEMS = 4, 2

DEFAULT_AS_OF = date(2024, 12, 31)
_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _total(items: Column, field: str) -> Column:
    return F.aggregate(items, F.lit(0).cast(MONEY), lambda acc, x: (acc + x[field]).cast(MONEY))


def generate_invoices(ids: DataFrame, seed: int = 42, locale: str = "en_US", n_items: int = 0, discount_pct: float = 0.0,
                      as_of: date = DEFAULT_AS_OF) -> DataFrame:
    """One invoice per `id`. Columns `locale`, `n_items` and `labels` of the input override the defaults per row.

    Each invoice is built inside its row, so no shuffle is needed; dates fall in the 90 days up to `as_of`.
    """
    rid = F.col("id")
    have = set(ids.columns)
    count = F.col("n_items").cast("bigint") if "n_items" in have else F.lit(n_items).cast("bigint")
    labels = F.col("labels") if "labels" in have else F.lit(None).cast("array<string>")
    base = locales.with_locale(ids.select(
        rid, (F.col("locale") if "locale" in have else F.lit(locale)).alias("locale"), labels.alias("_labels"),
        F.when(count > 0, count).otherwise(uniform_int(uniform(seed, "invoice:items", rid), ITEMS_LOW, ITEMS_HIGH)).alias("_count"),
    ), "locale")

    def line(i: Column) -> Column:
        price = F.lit(PRICE_LOW) + uniform(seed, "invoice:price", rid, i) * F.lit(PRICE_HIGH - PRICE_LOW)
        label = F.element_at("_labels", ((i - 1) % F.greatest(F.size("_labels"), F.lit(1)) + 1).cast("int"))
        product = F.when(F.coalesce(F.size("_labels"), F.lit(0)) > 0, label).otherwise(
            pick(pools.PRODUCTS, uniform(seed, "invoice:product", rid, i)))
        return F.struct(i.cast("int").alias("item_no"), product.alias("product"),
                        uniform_int(uniform(seed, "invoice:quantity", rid, i), QUANTITY_LOW, QUANTITY_HIGH).alias("quantity"),
                        money(price).alias("unit_price"))

    rough = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("_count")), line)
    priced = base.withColumn("_lines", rough)
    items = F.transform("_lines", lambda x: F.struct(
        x["item_no"].alias("item_no"), x["product"].alias("product"), x["quantity"].alias("quantity"),
        x["unit_price"].alias("unit_price"), (x["quantity"] * x["unit_price"]).cast(MONEY).alias("line_total")))
    rows = with_totals(priced.withColumn("items", items), discount_pct)
    day = F.date_sub(F.lit(as_of), uniform_int(uniform(seed, "invoice:date", rid), 0, DATE_WINDOW + 1).cast("int"))
    rows = rows.withColumn("_day", day)
    pk = F.col("locale").startswith("ur")

    def by_locale(make):
        return F.when(pk, make("ur_PK")).otherwise(make("en_US"))

    return rows.select(
        rid.alias("invoice_id"),
        F.concat(F.lit("INV-"), uniform_int(uniform(seed, "invoice:number", rid), 10000, 99999).cast("string")).alias("invoice_number"),
        locales.format_date(F.col("_day"), F.col("date_format")).alias("invoice_date"),
        locales.format_date(F.date_add("_day", DUE_DAYS), F.col("date_format")).alias("due_date"),
        by_locale(lambda lo: identity.company(seed, "invoice:from", rid, lo)).alias("company_from"),
        by_locale(lambda lo: identity.company(seed, "invoice:to", rid, lo)).alias("company_to"),
        by_locale(lambda lo: identity.address(seed, "invoice:from", rid, lo)).alias("address_from"),
        by_locale(lambda lo: identity.address(seed, "invoice:to", rid, lo)).alias("address_to"),
        "items", "subtotal", "discount", F.lit(float(discount_pct)).alias("discount_pct"), "tax_label", "tax_rate",
        "tax_amount", "total", "currency_symbol", "currency_code", "locale",
    )


def with_totals(df: DataFrame, discount_pct: float = 0.0) -> DataFrame:
    """Add subtotal, discount, tax_amount and total from `items` and `tax_rate`."""
    zero_rate = F.lit(str(discount_pct)).cast("decimal(9,4)") / 100
    rows = df.withColumn("subtotal", _total(F.col("items"), "line_total"))
    rows = rows.withColumn("discount", F.bround(F.col("subtotal") * zero_rate, 2).cast(MONEY))
    taxable = F.col("subtotal") - F.col("discount")
    rows = rows.withColumn("tax_amount", F.bround(taxable * F.col("tax_rate").cast("decimal(9,6)"), 2).cast(MONEY))
    return rows.withColumn("total", (taxable + F.col("tax_amount")).cast(MONEY))


def check_invoice_totals(invoices: DataFrame) -> DataFrame:
    """invoice_id, the totals recomputed from the items, and whether each stated total agrees."""
    lines = _total(F.transform("items", lambda x: F.struct(
        (x["quantity"] * x["unit_price"]).cast(MONEY).alias("line_total"))), "line_total")
    stated = invoices.select("invoice_id", "subtotal", "discount", "tax_rate", "tax_amount", "total", lines.alias("expected_subtotal"))
    tax = F.bround((F.col("expected_subtotal") - F.col("discount")) * F.col("tax_rate").cast("decimal(9,6)"), 2).cast(MONEY)
    rows = stated.withColumn("expected_tax", tax)
    rows = rows.withColumn("expected_total", (F.col("expected_subtotal") - F.col("discount") + F.col("expected_tax")).cast(MONEY))
    return rows.select(
        "invoice_id", "expected_subtotal", "expected_tax", "expected_total",
        ((F.col("subtotal") == F.col("expected_subtotal")) & (F.col("tax_amount") == F.col("expected_tax"))
         & (F.col("total") == F.col("expected_total"))).alias("valid"),
    )


def invoice_summary(invoices: DataFrame) -> DataFrame:
    """One flat row per invoice."""
    return invoices.select("invoice_number", F.col("invoice_date").alias("date"), F.col("company_from").alias("from"),
                           F.col("company_to").alias("to"), "subtotal", "discount", F.col("tax_amount").alias("tax"), "total")


def invoice_lines(invoices: DataFrame) -> DataFrame:
    """One row per item.

    The outer form keeps the optimiser from adding a size filter on the array,
    which would build every document twice.
    """
    return invoices.select("invoice_id", F.explode_outer("items").alias("x")).filter("x is not null").select("invoice_id", "x.*")


def _salary_days(start: date, end: date) -> list[date]:
    days, year, month = [], start.year, start.month
    while date(year, month, 1) <= end:
        if date(year, month, 1) >= start:
            days.append(date(year, month, 1))
        year, month = (year + 1, 1) if month == 12 else (year, month + 1)
    return days


def _balance_fold(opening_balance: float, min_balance: float, allow_overdraft: bool, salary_amount: float):
    """A vectorised fold over transactions in order, in cents: credit, debit, balance and whether the row stays."""
    start, floor, salary_cents = (round(x * 100) for x in (opening_balance, min_balance, salary_amount))

    @pandas_udf("credit array<bigint>, debit array<bigint>, balance array<bigint>, kept array<boolean>")
    def fold(salary: pd.Series, side: pd.Series, amount: pd.Series) -> pd.DataFrame:
        paid, chance, size = (np.stack(x.to_list()) for x in (salary, side, amount))
        credit_side = paid | (chance < CREDIT_SHARE)
        credits = np.where(paid, salary_cents, np.rint((CREDIT_LOW + size * (CREDIT_HIGH - CREDIT_LOW)) * 100)).astype(np.int64)
        credits = np.where(credit_side, credits, 0)
        debits, balances = np.zeros_like(credits), np.zeros_like(credits)
        kept = np.ones(credits.shape, dtype=bool)
        balance = np.full(len(credits), start, dtype=np.int64)
        for j in range(credits.shape[1]):
            room = np.maximum(balance / 100 + (OVERDRAFT_ROOM if allow_overdraft else 0.0), DEBIT_FLOOR)
            wish = np.rint((DEBIT_LOW + size[:, j] * (np.minimum(room, DEBIT_HIGH) - DEBIT_LOW)) * 100).astype(np.int64)
            if not allow_overdraft:
                wish = np.where(balance - wish < floor, np.maximum(balance - floor, 0), wish)
                kept[:, j] = credit_side[:, j] | (wish >= LEAST_DEBIT * 100)
            debits[:, j] = np.where(credit_side[:, j] | ~kept[:, j], 0, wish)
            balance = balance + credits[:, j] - debits[:, j]
            balances[:, j] = balance
        return pd.DataFrame({"credit": list(credits), "debit": list(debits), "balance": list(balances), "kept": list(kept)})

    return fold


def generate_statements(ids: DataFrame, seed: int = 42, locale: str = "en_US", n_transactions: int = 30,
                        opening_balance: float = 5000.0, days: int = 90, min_balance: float = 0.0,
                        allow_overdraft: bool = False, salary_on_1st: bool = False, salary_amount: float = 3500.0,
                        as_of: date = DEFAULT_AS_OF) -> DataFrame:
    """One bank statement per `id`, its transactions in date order with a running balance.

    A debit depends on the balance before it, so the accounts of an Arrow batch
    step through their transactions together; accounts do not depend on one
    another, and no shuffle is needed.
    """
    rid = F.col("id")
    start = as_of - timedelta(days=days)
    drawn = F.transform(F.sequence(F.lit(1).cast("bigint"), F.lit(n_transactions).cast("bigint")), lambda i: F.struct(
        F.date_add(F.lit(start), uniform_int(uniform(seed, "txn:day", rid, i), 0, days).cast("int")).alias("date"),
        i.alias("i"), F.lit(False).alias("salary"),
        uniform(seed, "txn:side", rid, i).alias("side"), uniform(seed, "txn:amount", rid, i).alias("amount"),
        uniform(seed, "txn:text", rid, i).alias("text"), uniform(seed, "txn:source", rid, i).alias("source")))
    moves = drawn
    payday = _salary_days(start, as_of) if salary_on_1st else []
    if payday:
        paid = F.array(*[F.struct(F.lit(d).alias("date"), F.lit(0).cast("bigint").alias("i"), F.lit(True).alias("salary"),
                                  *[F.lit(0.5).alias(c) for c in ("side", "amount", "text", "source")]) for d in payday])
        moves = F.concat(drawn, paid)
    base = ids.select(rid, F.array_sort(moves).alias("_moves"))
    opening = F.lit(opening_balance).cast(MONEY)
    fold = _balance_fold(opening_balance, min_balance, allow_overdraft, salary_amount)
    folded = base.withColumn("_f", fold("_moves.salary", "_moves.side", "_moves.amount"))

    def cents(x: Column) -> Column:
        return (x.cast("decimal(20,0)") / 100).cast(MONEY)

    zipped = F.filter(F.arrays_zip("_moves", "_f.credit", "_f.debit", "_f.balance", "_f.kept"), lambda x: x["kept"])
    folded = folded.withColumn("_rows", F.transform(zipped, lambda x: F.struct(
        *[x["_moves"][c].alias(c) for c in ("date", "salary", "text", "source")],
        *[cents(x[c]).alias(c) for c in ("credit", "debit", "balance")])))
    config = locales.config(locale)
    text = F.transform("_rows", lambda x, at: F.struct(
        (at + 1).alias("seq"), F.date_format(x["date"], config["date_format"]).alias("date"),
        F.when(x["salary"], F.lit(SALARY_TEXT)).when(x["credit"] > 0, pick(pools.CREDIT_TEXTS, x["text"]))
        .otherwise(pick(pools.DESCRIPTIONS, x["text"])).alias("description"),
        F.when(x["salary"], F.lit(SALARY_SOURCE)).when(x["credit"] > 0, pick(pools.CREDIT_SOURCES, x["source"]))
        .otherwise(pick(pools.MERCHANTS, x["source"])).alias("merchant"),
        x["credit"].alias("credit"), x["debit"].alias("debit"), x["balance"].alias("balance"),
        F.when(x["credit"] > 0, F.lit("credit")).otherwise(F.lit("debit")).alias("type")))
    rows = folded.withColumn("transactions", text)
    period = " - ".join(_strftime(d, config["date_format"]) for d in (start, as_of))
    return rows.select(
        rid.alias("account_id"), identity.person_name(seed, "holder", rid, locale).alias("account_holder"),
        F.concat(F.lit("****"), uniform_int(uniform(seed, "account", rid), 1000, 9999).cast("string")).alias("account_number"),
        identity.bank(seed, "account", rid, locale).alias("bank_name"), F.lit(period).alias("statement_period"),
        opening.alias("opening_balance"),
        F.coalesce(F.try_element_at("transactions", F.lit(-1))["balance"], opening).alias("closing_balance"), "transactions",
        F.lit(config["currency_symbol"]).alias("currency_symbol"), F.lit(config["currency_code"]).alias("currency_code"),
        _total(F.col("transactions"), "credit").alias("total_credits"), _total(F.col("transactions"), "debit").alias("total_debits"),
        F.lit(locale).alias("locale"),
    )


def _strftime(day: date, pattern: str) -> str:
    return day.strftime(pattern.replace("yyyy", "%Y").replace("MM", "%m").replace("dd", "%d"))


def statement_lines(statements: DataFrame) -> DataFrame:
    """One row per transaction, as the balance check takes it."""
    rows = statements.select(F.col("account_id").alias("account"), F.explode_outer("transactions").alias("t"))
    return rows.filter("t is not null").select("account", "t.*")


def statement_summary(ledger: DataFrame, account: str, seq: str, opening: float) -> DataFrame:
    """opening_balance, closing_balance, total_credits, total_debits per account of a flat ledger."""
    credit, debit = F.coalesce(money(F.col("credit")), F.lit(0).cast(MONEY)), F.coalesce(money(F.col("debit")), F.lit(0).cast(MONEY))
    return ledger.groupBy(account).agg(
        F.lit(float(opening)).cast(MONEY).alias("opening_balance"),
        F.max_by(money(F.col("balance")), seq).alias("closing_balance"),
        F.sum(credit).cast(MONEY).alias("total_credits"), F.sum(debit).cast(MONEY).alias("total_debits"),
    )


def _tag(name: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(f"<{name}>"), *[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit(f"</{name}>"))


def _escape(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def invoice_html(invoices: DataFrame) -> DataFrame:
    """invoice_id and the invoice as an HTML text."""
    symbol = F.col("currency_symbol")
    lines = F.array_join(F.transform("items", lambda x: _tag(
        "tr", _tag("td", x["item_no"].cast("string")), _tag("td", _escape(x["product"])), _tag("td", x["quantity"].cast("string")),
        _tag("td", format_money(x["unit_price"], symbol)), _tag("td", format_money(x["line_total"], symbol)))), "")
    head = "".join(f"<th>{h}</th>" for h in ("#", "Product", "Qty", "Unit Price", "Total"))
    discount = F.when(F.col("discount") > 0, _tag("p", F.format_string("Discount (%s%%): -", F.col("discount_pct").cast("string")),
                                                  format_money(F.col("discount"), symbol))).otherwise("")
    text = _tag(
        "article", "<h1>INVOICE</h1>",
        _tag("p", F.col("invoice_number"), " &bull; ", F.col("invoice_date"), " &bull; Due: ", F.col("due_date")),
        _tag("p", "From: ", _escape(F.col("company_from")), "<br>", _escape(F.col("address_from"))),
        _tag("p", "To: ", _escape(F.col("company_to")), "<br>", _escape(F.col("address_to"))),
        _tag("table", f"<thead><tr>{head}</tr></thead>", _tag("tbody", lines)),
        _tag("p", "Subtotal: ", format_money(F.col("subtotal"), symbol)), discount,
        _tag("p", F.col("tax_label"), F.format_string(" (%.0f%%): ", F.col("tax_rate") * 100), format_money(F.col("tax_amount"), symbol)),
        _tag("strong", "TOTAL: ", format_money(F.col("total"), symbol)),
    )
    return invoices.select("invoice_id", text.alias("html"))


def statement_html(statements: DataFrame) -> DataFrame:
    """account_id and the statement as an HTML text."""
    symbol = F.col("currency_symbol")

    def amount(x: Column) -> Column:
        return F.when(x > 0, format_money(x, symbol)).otherwise("")

    lines = F.array_join(F.transform("transactions", lambda x: _tag(
        "tr", _tag("td", x["date"]), _tag("td", _escape(x["description"])), _tag("td", _escape(x["merchant"])),
        _tag("td", amount(x["credit"])), _tag("td", amount(x["debit"])), _tag("td", format_money(x["balance"], symbol)))), "")
    head = "".join(f"<th>{h}</th>" for h in ("Date", "Description", "Merchant", "Credit", "Debit", "Balance"))
    sums = [("Opening Balance", "opening_balance"), ("Total Credits", "total_credits"), ("Total Debits", "total_debits"),
            ("Closing Balance", "closing_balance")]
    text = _tag(
        "article", _tag("h2", F.col("bank_name")),
        _tag("p", _escape(F.col("account_holder")), " &bull; ", F.col("account_number"), " &bull; ", F.col("statement_period")),
        *[_tag("p", f"{label}: ", format_money(F.col(c), symbol)) for label, c in sums],
        _tag("table", f"<thead><tr>{head}</tr></thead>", _tag("tbody", lines)),
    )
    return statements.select("account_id", text.alias("html"))


def document_locale(text: Column) -> Column:
    """Locale by the first group of words that occurs in the whole text, else en_US."""
    lower = F.lower(text)
    out = F.lit(locales.DEFAULT)
    for code, words in reversed(LOCALE_WORDS):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(lower, F.lit(w)) for w in words]), F.lit(code)).otherwise(out)
    return out


def detect_doc_locale(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("locale", document_locale(F.col(text)))


def extract_item_lines(df: DataFrame, text: str, most_labels: int | None = None, most_items: int | None = None) -> DataFrame:
    """Add `labels` (the lines that may name items) and `n_items` (lines / 4, at least 2), of the whole text unless limits are given."""
    trimmed = F.transform(F.split(F.col(text), _LINE_BREAK),
                          lambda x: F.regexp_replace(x, f"^{WHITESPACE}|{WHITESPACE}$", ""))
    lines = F.filter(trimmed, lambda x: F.length(x).between(LINE_LOW, LINE_HIGH))
    rows = df.withColumn("_lines", lines)

    def item(x: Column) -> Column:
        lower = F.lower(x)
        return ~reduce(lambda a, b: a | b, [F.contains(lower, F.lit(w)) for w in NOT_ITEMS])

    per_item = F.floor(F.size("_lines") / LINES_PER_ITEM)
    guess = F.when(per_item == 0, F.lit(LINES_PER_ITEM)).otherwise(per_item)
    guess = guess if most_items is None else F.least(F.lit(most_items), guess)
    labels = F.filter("_lines", item)
    return rows.withColumns({
        "labels": labels if most_labels is None else F.slice(labels, 1, most_labels),
        "n_items": F.greatest(F.lit(FEWEST_ITEMS), guess).cast("bigint"),
    }).drop("_lines")


def mimic_invoices(documents: DataFrame, doc_id: str, text: str, seed: int = 42, as_of: date = DEFAULT_AS_OF,
                   most_labels: int | None = None, most_items: int | None = None) -> DataFrame:
    """An invoice per source document in its locale, with as many items and the labels the document suggests."""
    source = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("_text"))
    read = extract_item_lines(detect_doc_locale(source, "_text"), "_text", most_labels, most_items)
    return generate_invoices(read.drop("_text"), seed, as_of=as_of)
