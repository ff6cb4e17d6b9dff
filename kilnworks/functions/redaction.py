"""Secrets, home directories and e-mail addresses (SF-25, SF-28)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import UNICODE

PLACEHOLDER = "<redacted>"

# Keys whose value is a secret, and the redaction patterns (fixed values).
SECRET_KEYS = (
    "token",
    "api_key",
    "api-key",
    "apikey",
    "secret",
    "password",
    "passwd",
    "authorization",
    "auth",
    "credential",
    "private_key",
    "access_key",
)
BEARER = r"(?i)\b(bearer|basic)\s+[A-Za-z0-9._~+/=-]+"
SECRET = (
    r"(?i)\b(" + "|".join(SECRET_KEYS) + r")\b\s*[:=]?\s*"
    r"""(?:"[^"]*"|'[^']*'|[^\s,;'"]+)"""
)
HOME = r"(?i)/(?:Users|home)/[^/\s]+"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"

# 64-bit FNV-1a parameters (fixed values).
FNV_OFFSET = 0xCBF29CE484222325
FNV_PRIME = 0x100000001B3


def redact_home(text: Column) -> Column:
    return F.regexp_replace(text, UNICODE + HOME, "<home>")


def redact_text(text: Column) -> Column:
    """SF-25: bearer tokens, then secret values, then home directories."""
    no_bearer = F.regexp_replace(text, UNICODE + BEARER, PLACEHOLDER)
    return redact_home(F.regexp_replace(no_bearer, UNICODE + SECRET, PLACEHOLDER))


def _low(column: Column) -> Column:
    return column.bitwiseAND(F.lit(0xFFFFFFFF))


def pseudonym(address: Column) -> Column:
    """``user-`` and the 64-bit hash of an address of ASCII letters, trimmed, lower case.

    The hash is kept in halves of 32 bits, so that no product leaves a long. The prime is
    2^40 + 435: times 2^40 shifts the low half by 8 bits into the high one.
    """
    letters = F.split(F.lower(F.trim(address)), "")
    high, low = FNV_OFFSET >> 32, FNV_OFFSET & 0xFFFFFFFF
    prime = FNV_PRIME - (1 << 40)

    def step(state: Column, letter: Column) -> Column:
        mixed = state["low"].bitwiseXOR(F.ascii(letter).cast("long"))
        product = mixed * prime
        carried = F.shiftright(product, 32) + F.shiftleft(mixed, 8)
        return F.struct(
            _low(state["high"] * prime + carried).alias("high"), _low(product).alias("low")
        )

    def shown(state: Column) -> Column:
        halves = [F.lpad(F.lower(F.hex(state[half])), 8, "0") for half in ("high", "low")]
        return F.concat(F.lit("user-"), *halves)

    start = F.struct(F.lit(high).cast("long").alias("high"), F.lit(low).cast("long").alias("low"))
    return F.aggregate(letters, start, step, shown)


def redact_emails(text: Column) -> Column:
    """SF-28: every address becomes ``user-`` and 16 hex digits of its hash.

    Texts without an address are passed on as they are.
    """
    addresses = F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))
    woven = F.array_join(
        F.zip_with(
            F.split(text, EMAIL, -1),
            F.transform(addresses, pseudonym),
            lambda piece, name: F.concat(piece, F.coalesce(name, F.lit(""))),
        ),
        "",
    )
    return F.when(F.contains(text, F.lit("@")), woven).otherwise(text)


def redact_value(text: Column) -> Column:
    """Metadata values: addresses first, so pseudonyms survive the secret rule."""
    return redact_text(redact_emails(text))
