"""Masks, pseudonyms, noise."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import table, u
from doppel.functions import masking
from doppel.operators import privacy

EMAIL_IN_TEXT = r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+"
PHONE_IN_TEXT = r"[+]?[0-9][0-9 ().-]{6,18}[0-9]"
SALT = "orchard"
WORD_GAP = "[\\t-\\r\\x1c- \\x85\\p{Z}]+"


def found(spark, d, pattern: str):
    """Every match of a pattern in documents.text, with its document and position."""
    hits = F.regexp_extract_all(F.col("text"), F.lit(f"({pattern})"), F.lit(1))
    return table(spark, d, "documents").select("doc_id", F.posexplode(hits).alias("pos", "value"))


def masked(pattern, fn):
    def run(spark, d):
        rows = found(spark, d, pattern)
        return rows.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "value", fn(F.col("value")).alias("masked"))
    return run


def found_sql(pattern: str, expression: str) -> str:
    return (f"select doc_id, pos, value, {expression} as masked from (select doc_id, unnest(m) as value, "
            f"cast(unnest(range(len(m))) as bigint) as pos from (select doc_id, regexp_extract_all(text, '{pattern}') as m "
            f"from documents))")


def mask_email_sql(v: str) -> str:
    local = f"substr({v}, 1, length({v}) - length(split_part({v}, '@', -1)) - 1)"
    return (f"case when contains({v}, '@') and length({local}) > 0 then case when length({local}) <= 2 "
            f"then left({local}, 1) || repeat('*', greatest(length({local}) - 1, 1)) "
            f"else left({local}, 1) || repeat('*', length({local}) - 2) || right({local}, 1) end "
            f"|| '@' || split_part({v}, '@', -1) else {v} end")


def digits_sql(v: str) -> str:
    return f"regexp_replace({v}, '[^\\p{{Nd}}]', '', 'g')"


def mask_phone_sql(v: str) -> str:
    d = digits_sql(v)
    return (f"case when length({d}) < 4 then repeat('*', length({v})) "
            f"else repeat('*', length({d}) - 4) || '-' || right({d}, 4) end")


def mask_card_sql(v: str) -> str:
    d = digits_sql(v)
    return (f"case when length({d}) < 4 then repeat('*', length({v})) else '****-****-****-' || right({d}, 4) end")


def mask_name_sql(v: str) -> str:
    return (f"array_to_string(list_transform(list_filter(regexp_split_to_array({v}, '{WORD_GAP}'), lambda w: w <> ''), "
            f"lambda w: left(w, 1) || repeat('*', length(w) - 1)), ' ')")


def mask_generic_sql(v: str) -> str:
    return f"case when length({v}) <= 2 then {v} else left({v}, 1) || repeat('*', length({v}) - 2) || right({v}, 1) end"


def pseudonym_sql(v: str) -> str:
    return f"substr(sha256('{SALT}:' || {v}), 1, 16)"


def laplace_sql(stream: str, ids: list[str], scale: str) -> str:
    c = f"({u(stream, *ids)} - 0.5::double)"
    return f"-({scale}) * sign({c}) * ln(1.0::double - 2.0::double * abs({c}))"


def cards(spark, d):
    """A card number derived from the customer key; a few are too short to keep digits."""
    number = F.concat(F.lit("4111-"), F.lpad(F.col("c_custkey").cast("string"), 4, "0"), F.lit("-"),
                      F.lpad((F.col("c_custkey") * 7919 % 10000).cast("string"), 4, "0"), F.lit("-0042"))
    short = F.when(F.col("c_custkey") % 50 == 0, F.lit("n/a 12")).otherwise(number)
    return table(spark, d, "customer").select("c_custkey", short.alias("value"))


CARD_SQL = ("select c_custkey, case when c_custkey % 50 = 0 then 'n/a 12' else '4111-' || lpad(c_custkey::varchar, 4, '0') "
            "|| '-' || lpad((c_custkey * 7919 % 10000)::varchar, 4, '0') || '-0042' end as value from customer")

RULES = [
    {"column": "c_name", "method": "mask"},
    {"column": "c_mktsegment", "method": "pseudonymize", "salt": SALT},
    {"column": "c_acctbal", "method": "noise", "epsilon": 0.5},
    {"column": "missing", "method": "mask"},
]


def applied(spark, d):
    out = privacy.apply_privacy(table(spark, d, "customer"), RULES, ids=["c_custkey"])
    return out.withColumn("c_acctbal", F.round("c_acctbal", 6)).withColumn("c_nationkey", F.col("c_nationkey").cast("bigint"))


def columns_masked(spark, d):
    """Four columns whose mask comes from the name (c_name), from the values, or from the type given."""
    people = privacy.mask_column(table(spark, d, "customer").select("c_custkey", "c_name"), "c_name")
    brands = privacy.mask_column(table(spark, d, "part").select("p_partkey", "p_brand"), "p_brand", "address")
    found_at = found(spark, d, EMAIL_IN_TEXT).select("doc_id", "pos", F.col("value").alias("found"))
    contacts = privacy.mask_column(found_at, "found")
    key = F.lit
    return people.select(key("c_name").alias("source"), F.col("c_custkey").alias("id"), F.col("c_name").alias("masked")).unionByName(
        brands.select(key("p_brand").alias("source"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("masked"))
    ).unionByName(
        contacts.select(key("found").alias("source"), F.col("doc_id").alias("id"), F.col("found").alias("masked"))
    )


def noise(spark, d):
    out = privacy.laplace_noise(table(spark, d, "customer"), "c_acctbal", ["c_custkey"], epsilon=1.0)
    return out.select("c_custkey", F.round("c_acctbal", 6).alias("c_acctbal"))


QUERIES = {
    "mask_email": masked(EMAIL_IN_TEXT, masking.mask_email),
    "mask_phone": masked(PHONE_IN_TEXT, masking.mask_phone),
    "mask_credit_card": lambda s, d: cards(s, d).withColumn("masked", masking.mask_credit_card(F.col("value"))),
    "mask_name": lambda s, d: table(s, d, "part").select("p_partkey", masking.mask_name(F.col("p_name")).alias("masked")),
    "mask_generic": lambda s, d: table(s, d, "part").select("p_partkey", masking.mask_generic(F.col("p_brand")).alias("masked")),
    "mask_column": columns_masked,
    "pseudonymize": lambda s, d: table(s, d, "customer").select(
        "c_custkey", masking.pseudonym(F.col("c_name"), SALT).alias("pseudonym")),
    "laplace_noise": noise,
    "apply_privacy": applied,
    "hash_client": lambda s, d: table(s, d, "events").select(
        "event_id", masking.client_hash(F.col("user_id").cast("string")).alias("client")),
}

_RANGE = "(select max(c_acctbal) - min(c_acctbal) from customer)"
ORACLES = {
    "mask_email": found_sql(EMAIL_IN_TEXT, mask_email_sql("value")),
    "mask_phone": found_sql(PHONE_IN_TEXT, mask_phone_sql("value")),
    "mask_credit_card": f"select c_custkey, value, {mask_card_sql('value')} as masked from ({CARD_SQL})",
    "mask_name": f"select p_partkey, {mask_name_sql('p_name')} as masked from part",
    "mask_generic": f"select p_partkey, {mask_generic_sql('p_brand')} as masked from part",
    "mask_column": f"""select 'c_name' as source, c_custkey as id, {mask_name_sql('c_name')} as masked from customer
        union all select 'p_brand', p_partkey, {mask_generic_sql('p_brand')} from part
        union all select 'found', doc_id, masked from ({found_sql(EMAIL_IN_TEXT, mask_email_sql('value'))})""",
    "pseudonymize": f"select c_custkey, {pseudonym_sql('c_name')} as pseudonym from customer",
    "laplace_noise": f"select c_custkey, round(c_acctbal + {laplace_sql('noise:c_acctbal', ['c_custkey'], _RANGE)}, 6) "
                     "as c_acctbal from customer",
    "apply_privacy": f"""select c_custkey, {mask_name_sql('c_name')} as c_name, c_nationkey::bigint as c_nationkey,
        round(c_acctbal + {laplace_sql('noise:c_acctbal', ['c_custkey'], f'{_RANGE} / 0.5')}, 6) as c_acctbal,
        {pseudonym_sql('c_mktsegment')} as c_mktsegment from customer""",
    "hash_client": "select event_id, substr(sha256(user_id::varchar), 1, 12) as client from events",
}
