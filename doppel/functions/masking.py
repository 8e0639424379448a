"""Masking, pseudonymising and noise as Column expressions. Null stays null."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NOT_DIGIT = r"[^\p{Nd}]"
WHITESPACE = r"[\t-\r\x1c- \x85\p{Z}]+"
MIN_EPSILON = 0.01


def _stars(n: Column) -> Column:
    return F.repeat(F.lit("*"), n.cast("int"))


def mask_email(v: Column) -> Column:
    """Keep the ends of the local part and the whole domain after the last @."""
    domain = F.substring_index(v, "@", -1)
    n = F.length(v) - F.length(domain) - 1
    local = F.substring(v, F.lit(1), n)
    short = F.concat(F.left(local, F.lit(1)), _stars(F.greatest(n - 1, F.lit(1))))
    long = F.concat(F.left(local, F.lit(1)), _stars(n - 2), F.right(local, F.lit(1)))
    masked = F.concat(F.when(n <= 2, short).otherwise(long), F.lit("@"), domain)
    return F.when(F.contains(v, F.lit("@")) & (n > 0), masked).otherwise(v)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, NOT_DIGIT, "")


def mask_phone(v: Column) -> Column:
    """Stars for all but the last four digits; all stars below four digits."""
    d = _digits(v)
    return F.when(F.length(d) < 4, _stars(F.length(v))).otherwise(
        F.concat(_stars(F.length(d) - 4), F.lit("-"), F.right(d, F.lit(4)))
    )


def mask_credit_card(v: Column) -> Column:
    d = _digits(v)
    return F.when(F.length(d) < 4, _stars(F.length(v))).otherwise(
        F.concat(F.lit("****-****-****-"), F.right(d, F.lit(4)))
    )


def mask_name(v: Column) -> Column:
    """First letter of every word, words joined by one space."""
    words = F.filter(F.split(v, WHITESPACE), lambda w: w != "")
    return F.array_join(
        F.transform(words, lambda w: F.concat(F.left(w, F.lit(1)), _stars(F.length(w) - 1))), " "
    )


def mask_generic(v: Column) -> Column:
    n = F.length(v)
    return F.when(n <= 2, v).otherwise(F.concat(F.left(v, F.lit(1)), _stars(n - 2), F.right(v, F.lit(1))))


MASKS: dict[str, Callable[[Column], Column]] = {
    "email": mask_email,
    "phone": mask_phone,
    "credit_card": mask_credit_card,
    "name": mask_name,
    "text": mask_generic,
    "address": mask_generic,
}


def pseudonym(v: Column, salt: str) -> Column:
    """First 16 hex digits of SHA-256 of `salt:value`; the empty string stays as it is."""
    hashed = F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), v), 256), 1, 16)
    return F.when(v == "", v).otherwise(hashed)


def client_hash(v: Column) -> Column:
    """First 12 hex digits of SHA-256; the empty string stays empty."""
    return F.when(v == "", v).otherwise(F.substring(F.sha2(v, 256), 1, 12))


def laplace(u: Column, scale: Column) -> Column:
    """Laplace(0, scale) noise from a uniform draw."""
    centred = u - F.lit(0.5)
    return -scale * F.signum(centred) * F.log(F.lit(1.0) - F.lit(2.0) * F.abs(centred))
