"""Invoices, statements and documents."""

from __future__ import annotations



from pyspark.sql import functions as F

from catalog.common import SEED, pick, s, u, wide
from catalog.generate import LOCALE_SQL, LOCATED_SQL, address_sql, int_sql, located
from catalog.integrity import LEDGER_SQL, stated_ledger
from doppel.functions import pools
from doppel.operators import documents, integrity

MONEY = ["subtotal", "discount", "tax_amount", "total"]


def doubles(df, names):
    return df.withColumns({c: F.col(c).cast("double") for c in names})


def sources(spark, d):
    """An invoice per order, in the locale drawn for the order."""
    return located(spark, d).select((F.col("o_orderkey") + 1).alias("id"), "locale")


def invoices(spark, d):
    return documents.generate_invoices(sources(spark, d), SEED, discount_pct=7.5)


def nested(spark, d):
    out = documents.invoice_lines(invoices(spark, d))
    return doubles(out, ["unit_price", "line_total"]).withColumn("item_no", F.col("item_no").cast("bigint"))


def headers(spark, d):
    out = invoices(spark, d).drop("items", "discount_pct", "tax_rate", "tax_label", "currency_symbol", "currency_code")
    return doubles(out, MONEY)


DOCS = f"(select o_orderkey + 1 as id, locale from {LOCATED_SQL})"


def lines_sql(docs: str, count: str, product: str) -> str:
    """id, item_no, product, quantity, price cents of every line of docs."""
    return f"""(select *, {int_sql(u('invoice:quantity', 'id', 'i'), 1, 10)} as quantity,
        round_even((10.0::double + {u('invoice:price', 'id', 'i')} * 490.0::double) * 100.0::double, 0)::bigint as cents, {product} as product
        from (select *, unnest(range(1, {count} + 1)) as i from {docs}))"""


DRAWN_COUNT = int_sql(u("invoice:items", "id"), 2, 8)
LINES = lines_sql(DOCS, DRAWN_COUNT, pick(pools.PRODUCTS, u("invoice:product", "id", "i")))


def half_even(x: str, unit: int) -> str:
    return f"({x} // {unit} + case when {x} % {unit} > {unit // 2} or ({x} % {unit} = {unit // 2} and ({x} // {unit}) % 2 = 1) then 1 else 0 end)"


def totals_sql(lines: str, pct: float = 7.5) -> str:
    """id, locale and exact cents: sub, disc, tax, total."""
    return f"""(select *, sub - disc + tax as total from (select *, {half_even('(sub - disc) * rate', 1000000)} as tax from (
        select *, {half_even(f'sub * {int(pct * 100)}', 10000)} as disc from (
        select id, any_value(l.locale) as locale, sum(quantity * cents)::bigint as sub,
               any_value(cast(round(v.tax_rate * 1000000) as bigint)) as rate, any_value(v.date_format) as pattern
        from {lines} l join {LOCALE_SQL} on v.locale = case when l.locale in (select locale from {LOCALE_SQL}) then l.locale else 'en_US' end
        group by id))))"""


PATTERNS = {"MM/dd/yyyy": "%m/%d/%Y", "dd/MM/yyyy": "%d/%m/%Y", "dd.MM.yyyy": "%d.%m.%Y", "yyyy-MM-dd": "%Y-%m-%d",
            "yyyy/MM/dd": "%Y/%m/%d", "dd-MM-yyyy": "%d-%m-%Y"}


def day_sql(day: str) -> str:
    return "case " + " ".join(f"when pattern = {s(p)} then strftime({day}, {s(f)})" for p, f in PATTERNS.items()) + " end"


def party_sql(role: str, kind: str) -> str:
    pk, other = (address_sql(f"invoice:{role}", "id", True), address_sql(f"invoice:{role}", "id")) if kind == "address" else (
        pick(pools.PK_COMPANIES, u(f"invoice:{role}:company", "id")), pick(pools.COMPANIES, u(f"invoice:{role}:company", "id")))
    return f"case when starts_with(locale, 'ur') then {pk} else {other} end"


_DAY = f"(date '2024-12-31' - {int_sql(u('invoice:date', 'id'), 0, 91)}::integer)"
HEADERS_SQL = f"""select id as invoice_id, 'INV-' || {int_sql(u('invoice:number', 'id'), 10000, 99999)} as invoice_number,
    {day_sql(_DAY)} as invoice_date, {day_sql(f'({_DAY} + 30)')} as due_date,
    {party_sql('from', 'company')} as company_from, {party_sql('to', 'company')} as company_to,
    {party_sql('from', 'address')} as address_from, {party_sql('to', 'address')} as address_to,
    sub / 100.0::double as subtotal, disc / 100.0::double as discount, tax / 100.0::double as tax_amount, total / 100.0::double as total,
    locale from {totals_sql(LINES)}"""


def broken(spark, d):
    """Invoices of which every seventh states a total that is a cent off."""
    inv = invoices(spark, d)
    off = F.when(F.col("invoice_id") % 7 == 0, F.lit("0.01").cast("decimal(18,2)")).otherwise(F.lit("0").cast("decimal(18,2)"))
    out = documents.check_invoice_totals(inv.withColumn("total", (F.col("total") + off).cast("decimal(18,2)")))
    return doubles(out, ["expected_subtotal", "expected_tax", "expected_total"])


def accounts(spark, d):
    return wide(spark, d, "customer").select((F.col("c_custkey") + 1).alias("id"))


def statements(spark, d):
    return documents.generate_statements(accounts(spark, d), SEED, opening_balance=900.0, salary_on_1st=True)


def statement_rows(spark, d):
    out = documents.statement_lines(statements(spark, d))
    return doubles(out, ["credit", "debit", "balance"])


def statement_check(spark, d):
    """The balance check over all generated statements, joined by the facts of each statement."""
    made = documents.generate_statements(accounts(spark, d), SEED, opening_balance=900.0)
    out = integrity.check_running_balance(documents.statement_lines(made), "account", "seq", 900.0)
    return out.select("account", "valid", "balance_mismatches", "overdraft_violations")


def summary(spark, d):
    out = documents.statement_summary(stated_ledger(spark, d), "account", "seq", 1000.0)
    return doubles(out, ["opening_balance", "closing_balance", "total_credits", "total_debits"])


def noted(spark, d):
    """Documents, some with a currency word or a few short lines appended."""
    tail = F.element_at(F.array(*[F.lit(x) for x in TAILS]), (F.col("doc_id") % len(TAILS) + 1).cast("int"))
    return wide(spark, d, "documents").select("doc_id", F.concat("text", tail).alias("text"))


TAILS = ["", "\nBlue kettle 2 pcs\nTotal 20", "\nPrice in GBP\nGreen lamp", "\n  Rs. 500 \n", "\nCanada post\nbill to: x\nRed chair"]
NOTED_SQL = ("(select doc_id, text || ([" + ", ".join(s(x).replace("\n", "' || chr(10) || '") for x in TAILS)
             + f"])[doc_id % {len(TAILS)} + 1] as text from documents)")
LOCALE_CASE = "case " + " ".join(
    "when " + " or ".join(f"contains(lower(text), {s(w)})" for w in words) + f" then {s(code)}"
    for code, words in documents.LOCALE_WORDS) + " else 'en_US' end"
# RE2 writes code points above FF in braces.
_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_WS2 = r"[\t-\r\x1c- \x{85}\p{Z}]+"
_LINES = (f"list_filter(list_transform(regexp_split_to_array(text, '{_BREAK}'), lambda x: regexp_replace(x, '^{_WS2}|{_WS2}$', '', 'g')), "
          f"lambda x: length(x) between 4 and 39)")
_ITEM = " and ".join(f"not contains(lower(x), {s(w)})" for w in documents.NOT_ITEMS)
LABELS_SQL = (f"(select doc_id, text, list_filter(ls, lambda x: {_ITEM}) as labels, "
              f"greatest(2, case when len(ls) // 4 = 0 then 4 else len(ls) // 4 end)::bigint as n_items "
              f"from (select doc_id, text, {_LINES} as ls from {NOTED_SQL}))")


def labelled(spark, d):
    out = documents.extract_item_lines(noted(spark, d), "text")
    return out.select("doc_id", "n_items", F.array_join("labels", " / ").alias("labels"))


def mimicked(spark, d):
    inv = documents.mimic_invoices(noted(spark, d), "doc_id", "text", SEED)
    items = inv.select("invoice_id", "locale", F.col("total").cast("double").alias("total"), F.explode_outer("items").alias("x"))
    return items.select("invoice_id", "locale", "total", F.col("x.item_no").cast("bigint").alias("item_no"), "x.product", "x.quantity")


_MIMIC_DOCS = f"(select doc_id as id, labels, n_items, {LOCALE_CASE} as locale from {LABELS_SQL})"
_MIMIC_LINES = lines_sql(_MIMIC_DOCS, "n_items", "case when len(labels) > 0 then labels[(i - 1) % len(labels) + 1] else "
                         + pick(pools.PRODUCTS, u("invoice:product", "id", "i")) + " end")

QUERIES = {
    "generate_invoices": headers,
    "invoice_lines": nested,
    "invoice_totals": broken,
    "invoice_summary": lambda sp, d: doubles(documents.invoice_summary(invoices(sp, d)), ["subtotal", "discount", "tax", "total"]),
    "generate_statements": statement_rows,
    "statement_check": statement_check,
    "statement_summary": summary,
    "render_invoice_html": lambda sp, d: documents.invoice_html(invoices(sp, d)),
    "render_statement_html": lambda sp, d: documents.statement_html(statements(sp, d)),
    "detect_doc_locale": lambda sp, d: documents.detect_doc_locale(noted(sp, d), "text").select("doc_id", "locale"),
    "extract_item_lines": labelled,
    "mimic_invoices": mimicked,
}

ORACLES = {
    "generate_invoices": HEADERS_SQL,
    "invoice_lines": f"select id as invoice_id, i as item_no, product, quantity, cents / 100.0::double as unit_price, "
                     f"quantity * cents / 100.0::double as line_total from {LINES}",
    "invoice_totals": f"select id as invoice_id, sub / 100.0::double as expected_subtotal, tax / 100.0::double as expected_tax, "
                      f"total / 100.0::double as expected_total, id % 7 <> 0 as valid from {totals_sql(LINES)}",
    "invoice_summary": f'select invoice_number, invoice_date as date, company_from as "from", company_to as "to", subtotal, discount, '
                       f"tax_amount as tax, total from ({HEADERS_SQL})",
    "statement_check": "select c_custkey + 1 as account, true as valid, 0::bigint as balance_mismatches, 0::bigint as overdraft_violations from customer",
    "statement_summary": f"""with {LEDGER_SQL} select account, 1000.0::double as opening_balance,
        arg_max(round_even((expected_balance::double + case when seq % 97 = 0 then 0.015::double else 0.0::double end) * 100.0::double, 0) / 100.0::double, seq) as closing_balance,
        sum(credit)::double as total_credits, sum(debit)::double as total_debits from run group by account""",
    "detect_doc_locale": f"select doc_id, {LOCALE_CASE} as locale from {NOTED_SQL}",
    "extract_item_lines": f"select doc_id, n_items, array_to_string(labels, ' / ') as labels from {LABELS_SQL}",
    "mimic_invoices": f"select l.id as invoice_id, l.locale, t.total / 100.0::double as total, i as item_no, product, quantity "
                      f"from {_MIMIC_LINES} l join {totals_sql(_MIMIC_LINES, 0.0)} t on t.id = l.id",
}
