"""Masks as column expressions."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _text(c: Column) -> Column:
    return c.cast("string")


def _share(c: Column, key: str) -> Column:
    """A number from 0 to below 1 that the value and a key decide: 52 bits of a SHA-256."""
    digits = F.left(F.sha2(F.concat(_text(c), F.lit(key)), 256), F.lit(13))
    return F.conv(digits, 16, 10).cast("double") / F.lit(2.0**52)


def _stars(length: Column) -> Column:
    return F.repeat(F.lit("*"), F.greatest(length, F.lit(0)))


def _last(c: Column, n: int) -> Column:
    return F.right(c, F.lit(n))


def hash_(c: Column) -> Column:
    return F.left(F.sha2(_text(c), 256), F.lit(8))


def redact(c: Column) -> Column:
    return F.lit("***")


def null(c: Column) -> Column:
    return F.lit(None).cast("string")


def partial(c: Column, show_first: int = 0, show_last: int = 0) -> Column:
    t = _text(c)
    return F.concat(F.left(t, F.lit(show_first)), _stars(F.length(t) - (show_first + show_last)), _last(t, show_last))


def email(c: Column) -> Column:
    """Stars and what begins with the first @; stars alone without one, and for null."""
    t = _text(c)
    return F.when(F.contains(t, F.lit("@")), F.concat(F.lit("***"), F.substr(t, F.locate("@", t)))).otherwise(F.lit("***"))


def phone(c: Column, show_last: int = 4) -> Column:
    return F.concat(F.lit("***"), _last(_text(c), show_last))


def credit_card(c: Column, show_last: int = 4) -> Column:
    digits = F.regexp_replace(_text(c), "[^0-9]", "")
    return F.concat(_stars(F.length(digits) - show_last), _last(digits, show_last))


def first_initial(c: Column) -> Column:
    return F.concat(F.left(_text(c), F.lit(1)), F.lit("."))


def ip_address(c: Column, keep_octets: int = 2) -> Column:
    kept = max(0, min(3, keep_octets))
    octets = [F.split_part(_text(c), F.lit("."), F.lit(i)) if i <= kept else F.lit("x") for i in range(1, 5)]
    # concat_ws passes nulls over, and a null address has to stay null while any octet is shown
    return F.when(c.isNotNull() | F.lit(kept == 0), F.concat_ws(".", *octets))


def range_(c: Column, bucket_size: int = 10000) -> Column:
    low = (F.floor(c.cast("double") / bucket_size) * bucket_size).cast("long")
    return F.concat(low.cast("string"), F.lit("-"), (low + bucket_size).cast("string"))


def noise(c: Column, percentage: float = 10.0, seed_key: str = "") -> Column:
    """The value moved by up to ``percentage`` either way, evenly, the same for the same value and key."""
    reach = percentage / 100.0
    return c.cast("double") * (1.0 - reach + 2.0 * reach * _share(c, seed_key))


def date_shift(c: Column, max_days: int = 30, seed_key: str = "") -> Column:
    """The date moved by up to ``max_days`` either way, each number of days as likely, the same for the same value and key."""
    day = c.cast("date")
    return F.date_add(F.date_sub(day, max_days), F.floor(_share(day, seed_key) * (2 * max_days + 1)).cast("int"))


def truncate(c: Column, length: int = 3) -> Column:
    t = _text(c)
    return F.when(F.length(t) <= length, t).otherwise(F.concat(F.left(t, F.lit(length)), F.lit("...")))


def consistent_hash(c: Column, prefix: str = "", length: int = 8) -> Column:
    """A prefix and hexadecimal digits: equal values stay equal, so joins still work."""
    return F.concat(F.lit(prefix), F.left(F.sha2(_text(c), 256), F.lit(length)))


METHODS = {
    "hash": hash_, "redact": redact, "null": null, "partial": partial, "email": email, "phone": phone, "credit_card": credit_card, "first_initial": first_initial,
    "ip_address": ip_address, "range": range_, "noise": noise, "date_shift": date_shift, "truncate": truncate, "consistent_hash": consistent_hash,
}


def mask(c: Column, method: str, config: dict[str, Any] | None = None) -> Column:
    if method not in METHODS:
        raise ValueError(f"unknown mask {method}")
    return METHODS[method](c, **(config or {}))


# ---- masks that keep a value's shape


def shape_digits(c: Column) -> Column:
    """All digits but the last four become stars; other characters stay (phones and cards)."""
    return F.regexp_replace(_text(c), "[0-9](?=(?:[^0-9]*[0-9]){4})", "*")


def national_id(c: Column) -> Column:
    """The first four characters, stars for the rest; stars alone for four or fewer."""
    t = _text(c)
    return F.when(F.length(t) <= 4, F.repeat(F.lit("*"), F.length(t))).otherwise(F.concat(F.left(t, F.lit(4)), F.repeat(F.lit("*"), F.length(t) - 4)))


def ip_network(c: Column) -> Column:
    """The last octet becomes 0; IPv6 becomes ``::``; anything else stays."""
    t = _text(c)
    return F.when(F.contains(t, F.lit(":")), "::").when(F.size(F.split(t, r"\.")) == 4, F.concat(F.substring_index(t, ".", 3), F.lit(".0"))).otherwise(t)


def salted_hash(c: Column, salt: str) -> Column:
    return F.left(F.sha2(F.concat(F.lit(f"{salt}:"), _text(c)), 256), F.lit(16))
