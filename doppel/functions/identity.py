"""Names, contacts and free text drawn from pools by seed, stream and row id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from doppel.functions import pools
from doppel.functions.rng import pick, uniform, uniform_int

SHORT_TEXT = 30  # average length below which a text column gets one short sentence


def is_pk(locale: str) -> bool:
    return locale.lower().startswith("ur")


def person_name(seed: int, stream: str, rid: Column, locale: str = "en_US") -> Column:
    first, last = (pools.PK_FIRST_NAMES, pools.PK_LAST_NAMES) if is_pk(locale) else (pools.FIRST_NAMES, pools.LAST_NAMES)
    return F.concat(pick(first, uniform(seed, f"{stream}:first", rid)), F.lit(" "),
                    pick(last, uniform(seed, f"{stream}:last", rid)))


def mailbox(name: Column) -> Column:
    return F.replace(F.replace(F.lower(name), F.lit(" "), F.lit(".")), F.lit("'"), F.lit(""))


def email(seed: int, stream: str, rid: Column, name: Column | None = None, locale: str = "en_US") -> Column:
    """An address from a name (a fresh one when none is given) with a number of two or three digits."""
    name = person_name(seed, f"{stream}:name", rid, locale) if name is None else name
    number = uniform_int(uniform(seed, f"{stream}:number", rid), 10, 999).cast("string")
    domains = pools.PK_DOMAINS if is_pk(locale) else pools.EMAIL_DOMAINS
    return F.concat(mailbox(name), number, F.lit("@"), pick(domains, uniform(seed, f"{stream}:domain", rid)))


def phone(seed: int, stream: str, rid: Column, locale: str = "en_US") -> Column:
    if is_pk(locale):
        tail = uniform_int(uniform(seed, f"{stream}:number", rid), 1000000, 9999999).cast("string")
        return F.concat(F.lit("+92 "), pick(pools.PK_PHONE_PREFIXES, uniform(seed, f"{stream}:prefix", rid)),
                        F.lit(" "), tail)
    area = uniform_int(uniform(seed, f"{stream}:area", rid), 200, 1000).cast("string")
    tail = uniform_int(uniform(seed, f"{stream}:number", rid), 1000000, 10000000).cast("string")
    return F.concat(F.lit("("), area, F.lit(") "), F.substring(tail, 1, 3), F.lit("-"), F.substring(tail, 4, 4))


def city(seed: int, stream: str, rid: Column, locale: str = "en_US") -> Column:
    return pick(pools.PK_CITIES if is_pk(locale) else pools.CITIES, uniform(seed, f"{stream}:city", rid))


def address(seed: int, stream: str, rid: Column, locale: str = "en_US") -> Column:
    def number(part, low, high):
        return uniform_int(uniform(seed, f"{stream}:{part}", rid), low, high).cast("string")

    town = city(seed, stream, rid, locale)
    if is_pk(locale):
        return F.concat(F.lit("House "), number("house", 1, 250), F.lit(", Street "), number("street", 1, 40),
                        F.lit(", "), pick(pools.PK_AREAS, uniform(seed, f"{stream}:area", rid)), F.lit(", "), town)
    return F.concat(number("house", 1, 1000), F.lit(" "), pick(pools.STREETS, uniform(seed, f"{stream}:street", rid)),
                    F.lit(" Street, "), town, F.lit(" "), number("zip", 10000, 100000))


def company(seed: int, stream: str, rid: Column, locale: str = "en_US") -> Column:
    return pick(pools.PK_COMPANIES if is_pk(locale) else pools.COMPANIES, uniform(seed, f"{stream}:company", rid))


def bank(seed: int, stream: str, rid: Column, locale: str = "en_US") -> Column:
    return pick(pools.PK_BANKS if is_pk(locale) else pools.BANKS, uniform(seed, f"{stream}:bank", rid))


def uuid(seed: int, stream: str, rid: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stream), rid.cast("string")).cast("binary"))
    cut = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cut])


def word(seed: int, stream: str, rid: Column) -> Column:
    return pick(pools.WORDS, uniform(seed, f"{stream}:word", rid))


def sentence(seed: int, stream: str, rid: Column, low: int = 3, high: int = 8) -> Column:
    """low..high-1 words with a capital and a full stop."""
    count = uniform_int(uniform(seed, f"{stream}:count", rid), low, high)
    words = F.transform(F.sequence(F.lit(1).cast("bigint"), count),
                        lambda i: pick(pools.WORDS, uniform(seed, f"{stream}:word", rid, i)))
    text = F.array_join(words, " ")
    return F.concat(F.upper(F.left(text, F.lit(1))), F.substring(text, F.lit(2), F.length(text)), F.lit("."))


def free_text(seed: int, stream: str, rid: Column, average_length: float = 50.0) -> Column:
    """A short sentence, or a paragraph when the column's texts are longer."""
    if average_length < SHORT_TEXT:
        return sentence(seed, stream, rid)
    return sentence(seed, stream, rid, 6, 30)


def identity(kind: str, seed: int, stream: str, rid: Column, name: Column | None = None,
             locale: str = "en_US", average_length: float = 50.0) -> Column:
    """A value of an identity type."""
    if kind == "name":
        return person_name(seed, stream, rid, locale)
    if kind == "email":
        return email(seed, stream, rid, name, locale)
    if kind == "phone":
        return phone(seed, stream, rid, locale)
    if kind == "address":
        return address(seed, stream, rid, locale)
    if kind == "uuid":
        return uuid(seed, stream, rid)
    if kind == "id":
        return rid.cast("bigint")
    if kind == "text":
        return free_text(seed, stream, rid, average_length)
    return word(seed, stream, rid)
