"""Generators and injectors. Row ids are the keys of the given tables, so output grows with them."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.common import SEED, cdf, pick, ppf, rnd, s, table, u, wide
from doppel.functions import domains, identity, locales, pools
from doppel.functions.money import format_money
from doppel.functions.normal import add_norm_cdf, add_norm_ppf, interp_grid
from doppel.functions.rng import cumulative, uniform, uniform_int
from doppel.operators import generate


def ids(spark, d):
    return wide(spark, d, "customer").select((F.col("c_custkey") + 1).alias("id"))


IDS = "(select c_custkey + 1 as id from customer)"


# ---- SQL text of single generators ----------------------------------------

def interval_sql(values, ends, x: str) -> str:
    cases = " ".join(f"when {x} < {e!r}::double then {s(v)}" for v, e in list(zip(values, ends))[:-1])
    return f"(case {cases} else {s(values[-1])} end)" if cases else s(values[-1])


def int_sql(x: str, low: int, high: int) -> str:
    return f"({low} + cast(floor({x} * {float(high - low)!r}::double) as bigint))"


def name_sql(stream: str, rid: str, pk: bool = False) -> str:
    first, last = (pools.PK_FIRST_NAMES, pools.PK_LAST_NAMES) if pk else (pools.FIRST_NAMES, pools.LAST_NAMES)
    return f"({pick(first, u(stream + ':first', rid))} || ' ' || {pick(last, u(stream + ':last', rid))})"


def email_sql(stream: str, rid: str, name: str | None = None, pk: bool = False) -> str:
    name = name or name_sql(f"{stream}:name", rid, pk)
    box = f"replace(replace(lower({name}), ' ', '.'), '''', '')"
    domains_ = pools.PK_DOMAINS if pk else pools.EMAIL_DOMAINS
    return (f"({box} || {int_sql(u(stream + ':number', rid), 10, 999)} || '@' || "
            f"{pick(domains_, u(stream + ':domain', rid))})")


def phone_sql(stream: str, rid: str, pk: bool = False) -> str:
    if pk:
        return (f"('+92 ' || {pick(pools.PK_PHONE_PREFIXES, u(stream + ':prefix', rid))} || ' ' || "
                f"{int_sql(u(stream + ':number', rid), 1000000, 9999999)})")
    tail = f"({int_sql(u(stream + ':number', rid), 1000000, 10000000)})::varchar"
    return (f"('(' || {int_sql(u(stream + ':area', rid), 200, 1000)} || ') ' || substr({tail}, 1, 3) || '-' || "
            f"substr({tail}, 4, 4))")


def city_sql(stream: str, rid: str, pk: bool = False) -> str:
    return pick(pools.PK_CITIES if pk else pools.CITIES, u(stream + ":city", rid))


def address_sql(stream: str, rid: str, pk: bool = False) -> str:
    def n(part, low, high):
        return int_sql(u(f"{stream}:{part}", rid), low, high)
    if pk:
        return (f"('House ' || {n('house', 1, 250)} || ', Street ' || {n('street', 1, 40)} || ', ' || "
                f"{pick(pools.PK_AREAS, u(stream + ':area', rid))} || ', ' || {city_sql(stream, rid, True)})")
    return (f"({n('house', 1, 1000)} || ' ' || {pick(pools.STREETS, u(stream + ':street', rid))} || ' Street, ' || "
            f"{city_sql(stream, rid)} || ' ' || {n('zip', 10000, 100000)})")


def uuid_sql(stream: str, rid: str) -> str:
    h = f"md5(concat_ws('|', '{SEED}', {s(stream)}, {rid}::varchar))"
    return " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)])


def sentence_sql(stream: str, rid: str, low: int, high: int) -> str:
    words = (f"array_to_string(list_transform(range(1, {int_sql(u(stream + ':count', rid), low, high)} + 1), "
             f"lambda i: {pick(pools.WORDS, u(stream + ':word', rid, 'i'))}), ' ')")
    return f"(upper(left({words}, 1)) || substr({words}, 2) || '.')"


def number_sql(x: str, stats: dict, whole: bool) -> str:
    mean, std, low, high = generate.number_stats(stats, whole)
    v = f"greatest({low!r}::double, least({high!r}::double, {mean!r}::double + {std!r}::double * {ppf(x)}))"
    return f"{rnd(v)}::bigint" if whole else rnd(v, 2)


def time_sql(x: str, stats: dict) -> str:
    low, high = generate.time_range(stats)
    return f"strftime(make_timestamp(({low} + cast(floor({x} * {float(high - low)!r}::double) as bigint)) * 1000000), '%Y-%m-%d %H:%M:%S')"


def table_sql(schema: list[dict], source: str, locale: str = "en_US", rid: str = "id") -> str:
    """Select text of generate_table with times as text."""
    pk = identity.is_pk(locale)
    draws, values = [], []
    for i, c in enumerate(schema):
        name, kind, stats = c["name"], c["type"], c.get("stats") or {}
        stream, x = f"col:{name}", f"u{i}"
        if kind in ("integer", "float", "categorical", "currency", "datetime"):
            draws.append(f"{u(stream, rid)} as {x}")
        if kind in ("integer", "float"):
            v = number_sql(x, stats, kind == "integer")
        elif kind == "categorical":
            shares = generate.label_shares(name, stats, locale)
            v = (interval_sql(list(shares), cumulative(list(shares.values())), x) if shares
                 else pick(generate.FALLBACK_LABELS, x))
        elif kind == "currency":
            v = interval_sql([locales.config(locale)["currency_code"], *locales.OTHER_CURRENCIES], locales.CURRENCY_ENDS, x)
        elif kind == "datetime":
            v = time_sql(x, stats)
        elif kind == "name":
            v = name_sql(stream, rid, pk)
        elif kind == "email":
            v = email_sql(stream, rid, None, pk)
        elif kind == "phone":
            v = phone_sql(stream, rid, pk)
        elif kind == "address":
            v = address_sql(stream, rid, pk)
        elif kind == "uuid":
            v = uuid_sql(stream, rid)
        elif kind == "id":
            v = f"{rid}::bigint"
        elif kind == "text":
            v = sentence_sql(stream, rid, *((3, 8) if stats.get("avg_length", 50) < 30 else (6, 30)))
        else:
            v = pick(pools.WORDS, u(f"{stream}:word", rid))
        values.append(f'{v} as "{name}"')
    return f"select {', '.join(values)} from (select {rid}{''.join(', ' + x for x in draws)} from {source})"


def as_text_times(df, schema):
    times = [c["name"] for c in schema if c["type"] == "datetime"]
    return df.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in times})


def generated(schema, locale="en_US"):
    return lambda spark, d: as_text_times(generate.generate_table(ids(spark, d), schema, SEED, locale), schema)


NUMBERS = [
    {"name": "age", "type": "integer", "stats": {"min": 18, "max": 90, "mean": 41, "std": 13}},
    {"name": "flat", "type": "integer", "stats": {"min": 0, "max": 600, "mean": 300, "std": 0}},
    {"name": "spend", "type": "float", "stats": {"min": 5, "max": 900, "mean": 120, "std": 150}},
    {"name": "plain", "type": "float", "stats": {}},
]
LABELS = [
    {"name": "plan", "type": "categorical", "stats": {"categories": {"free": 6, "plus": 3, "team": 1}}},
    {"name": "none", "type": "categorical", "stats": {}},
    {"name": "currency", "type": "categorical", "stats": {"categories": {"USD": 0.5, "EUR": 0.5}}},
    {"name": "pay_currency", "type": "categorical", "stats": {}},
]
TIMES = [
    {"name": "joined", "type": "datetime", "stats": {"min": "2021-03-01", "max": "2024-05-31"}},
    {"name": "backwards", "type": "datetime", "stats": {"min": "2024-01-01", "max": "2023-01-01"}},
    {"name": "default_time", "type": "datetime", "stats": {}},
]
IDENTITIES = [{"name": k, "type": k, "stats": {}} for k in ["id", "name", "email", "phone", "address", "uuid"]] + [
    {"name": "note", "type": "text", "stats": {"avg_length": 20}}, {"name": "story", "type": "text", "stats": {}},
    {"name": "tag", "type": "word", "stats": {}},
]
CURRENCY = [{"name": "paid_in", "type": "currency", "stats": {}}, {"name": "id", "type": "id", "stats": {}}]
PRESET = domains.SCHEMAS["customer"] + [c for c in domains.SCHEMAS["patient"] if c["name"] in ("age", "heart_rate", "diagnosis")]


def nulled(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return generate.inject_nulls(orders, ["o_orderkey"], 0.2, SEED, exempt=["o_orderkey"])


LINE_IDS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
OUTLIER_SCHEMA = [
    {"name": "l_quantity", "type": "integer", "stats": {"mean": 25, "std": 14}},
    {"name": "l_extendedprice", "type": "float", "stats": {"mean": 50000.0, "std": 20000.0}},
    {"name": "l_discount", "type": "float", "stats": {"mean": 0.05, "std": 0.0}},
]


def with_outliers(spark, d):
    lines = wide(spark, d, "lineitem").select(*LINE_IDS, "l_quantity", "l_extendedprice", "l_discount")
    out = generate.inject_outliers(lines, LINE_IDS, OUTLIER_SCHEMA, 0.1, SEED)
    return out.withColumn("l_linenumber", F.col("l_linenumber").cast("bigint"))


def outlier_sql(c: dict) -> str:
    name, mean, std = c["name"], float(c["stats"]["mean"]), float(c["stats"]["std"])
    if std <= 0:
        return name
    x = u(f"outlier-size:{name}", *LINE_IDS)
    size = f"((3.0::double + 2.0::double * case when {x} >= 0.5 then {x} * 2 - 1 else {x} * 2 end) * {std!r}::double)"
    v = f"({mean!r}::double + case when {x} >= 0.5 then {size} else -{size} end)"
    v = rnd(v) if c["type"] == "integer" else rnd(v, 2)
    return f"case when {u(f'outlier:{name}', *LINE_IDS)} < 0.1::double then {v} else {name} end as {name}"


def located(spark, d):
    """Orders with a locale drawn from their key; every ninth has an unknown one."""
    names = F.array(*[F.lit(r[0]) for r in locales.LOCALES])
    code = F.when(F.col("o_orderkey") % 9 == 0, F.lit("xx_XX")).otherwise(
        F.element_at(names, (F.col("o_custkey") % len(locales.LOCALES) + 1).cast("int")))
    return wide(spark, d, "orders").select("o_orderkey", "o_totalprice", code.alias("locale"))


LOCATED_SQL = (f"(select o_orderkey, o_totalprice, case when o_orderkey % 9 = 0 then 'xx_XX' else "
               f"([{', '.join(s(r[0]) for r in locales.LOCALES)}])[o_custkey % {len(locales.LOCALES)} + 1] end as locale "
               f"from orders)")
_LOCALE_VALUES = ", ".join(
    f"({s(a)}, {s(b)}, {s(c)}, {s(e)}, {s(f)}, {g!r}::double, {s(h)})" for a, b, c, e, f, g, h in locales.LOCALES)
LOCALE_SQL = f"(values {_LOCALE_VALUES}) v({', '.join(locales.FIELDS)})"
KNOWN_SQL = f"case when t.locale in ({', '.join(s(r[0]) for r in locales.LOCALES)}) then t.locale else 'en_US' end"


def pk_people(spark, d):
    c = F.col("id")
    return ids(spark, d).select(
        "id", identity.person_name(SEED, "pk", c, "ur_PK").alias("name"), identity.phone(SEED, "pk", c, "ur_PK").alias("phone"),
        identity.address(SEED, "pk", c, "ur_PK").alias("address"), identity.city(SEED, "pk", c, "ur_PK").alias("city"),
        identity.company(SEED, "pk", c, "ur_PK").alias("company"), identity.bank(SEED, "pk", c, "ur_PK").alias("bank"),
        identity.email(SEED, "pk", c, None, "ur_PK").alias("email"),
    )


def pooled(spark, d):
    """A value of every pool for every event, by a draw of the event."""
    names = F.array(*[F.lit(p) for p in pools.POOLS])
    pool = F.element_at(names, (F.col("event_id") % len(pools.POOLS) + 1).cast("int"))
    size = F.create_map(*[F.lit(x) for k, v in pools.POOLS.items() for x in (k, len(v))])
    events = table(spark, d, "events").select("event_id", pool.alias("pool"), uniform(SEED, "pool", F.col("event_id")).alias("u"))
    events = events.withColumn("position", (F.floor(F.col("u") * size[F.col("pool")]) + 1).cast("int")).drop("u")
    return events.join(F.broadcast(pools.content_pools(spark)), ["pool", "position"]).select("event_id", "pool", "value")


_POOL_VALUES = ", ".join(f"({s(p)}, {i}, {s(v)})" for p, i, v in pools.pool_rows())
_POOL_NAMES = ", ".join(s(p) for p in pools.POOLS)
_POOL_SIZES = ", ".join(f"{s(p)}: {len(v)}" for p, v in pools.POOLS.items())


def normals(spark, d):
    """Probabilities of orders through the inverse normal and back."""
    o = table(spark, d, "orders").select("o_orderkey", uniform(SEED, "normal", F.col("o_orderkey")).alias("p"))
    z = add_norm_ppf(o, {"z": "p"})
    wide = add_norm_cdf(z.withColumn("w", F.col("z") * 1.5), {"wide": "w"})
    return wide.select("o_orderkey", F.round("z", 9).alias("z"), F.round("wide", 9).alias("wide"))


INTERP_TABLE = [0.0, 1.0, 4.0, 9.0, 16.0, 25.0, 36.0]
_KNOTS = "[" + ", ".join(f"{x!r}::double" for x in INTERP_TABLE) + "]"


def interpolated(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", uniform(SEED, "interp", F.col("o_orderkey")).alias("p"))
    knots = F.array(*[F.lit(x) for x in INTERP_TABLE])
    return o.select("o_orderkey", F.round(interp_grid(F.col("p"), knots, len(INTERP_TABLE)), 9).alias("y"))


def draws(spark, d):
    e = table(spark, d, "events")
    x = uniform(SEED, "check", F.col("event_id"), F.col("user_id"))
    return e.select("event_id", F.round(x, 12).alias("u"), uniform_int(x, 10, 999).alias("k"))


def formatted(spark, d):
    out = locales.with_locale(located(spark, d), "locale")
    return out.select("o_orderkey", format_money(F.col("o_totalprice"), F.col("currency_symbol")).alias("amount"))


TIGHT = ", ".join(s(x) for x in ["$", "£", "€", "₹", "¥", "₺", "CA$", "A$"])

QUERIES = {
    "uniform": draws,
    "norm_ppf_cdf": normals,
    "interp": interpolated,
    "gen_numeric": generated(NUMBERS),
    "gen_categorical": generated(LABELS, "ur_PK"),
    "gen_datetime": generated(TIMES),
    "gen_currency": generated(CURRENCY, "de_DE"),
    "synth_identity": generated(IDENTITIES),
    "generate_table": generated(PRESET),
    "inject_nulls": nulled,
    "inject_outliers": with_outliers,
    "locale_dim": lambda sp, d: locales.with_locale(located(sp, d), "locale").drop("o_totalprice"),
    "gen_locale_identity": pk_people,
    "content_pools": pooled,
    "format_money": formatted,
}

ORACLES = {
    "uniform": f"select event_id, round(x, 12) as u, {int_sql('x', 10, 999)} as k "
               f"from (select event_id, {u('check', 'event_id', 'user_id')} as x from events)",
    "norm_ppf_cdf": f"select o_orderkey, round(z, 9) as z, round({cdf('w')}, 9) as wide from (select *, z * 1.5::double as w "
                    f"from (select o_orderkey, {ppf('p')} as z from (select o_orderkey, {u('normal', 'o_orderkey')} as p from orders)))",
    "interp": f"""select o_orderkey, round(({_KNOTS})[i + 1] + (({_KNOTS})[i + 2] - ({_KNOTS})[i + 1]) * (a - i), 9) as y
        from (select o_orderkey, a, least(floor(a), 5)::bigint as i
              from (select o_orderkey, {u('interp', 'o_orderkey')} * 6.0::double as a from orders))""",
    "gen_numeric": table_sql(NUMBERS, IDS),
    "gen_categorical": table_sql(LABELS, IDS, "ur_PK"),
    "gen_datetime": table_sql(TIMES, IDS),
    "gen_currency": table_sql(CURRENCY, IDS, "de_DE"),
    "synth_identity": table_sql(IDENTITIES, IDS),
    "generate_table": table_sql(PRESET, IDS),
    "inject_nulls": "select o_orderkey, " + ", ".join(
        f"case when {u(f'null:{c}', 'o_orderkey')} >= 0.2::double then {c} end as {c}"
        for c in ["o_custkey", "o_orderstatus", "o_totalprice"]) + " from orders",
    "inject_outliers": f"select l_orderkey, l_partkey, l_suppkey, l_linenumber::bigint as l_linenumber, "
                       f"{', '.join(outlier_sql(c) for c in OUTLIER_SCHEMA)} from lineitem",
    "locale_dim": f"select o_orderkey, t.locale, country, currency_code, currency_symbol, tax_label, tax_rate, date_format "
                  f"from {LOCATED_SQL} t join {LOCALE_SQL} on v.locale = {KNOWN_SQL}",
    "gen_locale_identity": f"""select id, {name_sql('pk', 'id', True)} as name, {phone_sql('pk', 'id', True)} as phone,
        {address_sql('pk', 'id', True)} as address, {city_sql('pk', 'id', True)} as city,
        {pick(pools.PK_COMPANIES, u('pk:company', 'id'))} as company, {pick(pools.PK_BANKS, u('pk:bank', 'id'))} as bank,
        {email_sql('pk', 'id', None, True)} as email from {IDS}""",
    "content_pools": f"""select event_id, e.pool, value
        from (select event_id, ([{_POOL_NAMES}])[event_id % {len(pools.POOLS)} + 1] as pool, {u('pool', 'event_id')} as x
              from events) e join (values {_POOL_VALUES}) v(pool, position, value)
        on v.pool = e.pool and v.position = cast(floor(x * (map {{{_POOL_SIZES}}})[e.pool]) as bigint) + 1""",
    "format_money": f"""select o_orderkey, currency_symbol || case when currency_symbol in ({TIGHT}) then '' else ' ' end
        || format('{{:,.2f}}', o_totalprice) as amount from {LOCATED_SQL} t join {LOCALE_SQL} on v.locale = {KNOWN_SQL}""",
}
