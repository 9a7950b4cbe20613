"""Column predicates on descriptions and amounts."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def any_keyword(text: Column, keywords: Iterable[str]) -> Column:
    """Some keyword is a substring, letter case aside; null text has none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return any_of(F.contains(low, F.lit(k)) for k in keywords)


def keyword_count(text: Column, keywords: Iterable[str]) -> Column:
    """How many different keywords the text holds."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(low, F.lit(k)).cast("int") for k in keywords), F.lit(0))


def first_keyword(text: Column, keywords: Iterable[str]) -> Column:
    """The first keyword, in list order, that the text holds; null if none."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(*[F.when(F.contains(low, F.lit(k)), F.lit(k)) for k in keywords])


def token_keyword(text: Column, keywords: Iterable[str]) -> Column:
    """Some keyword stands between blanks, or begins the text before a blank, or is the text."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return any_of(F.contains(F.concat(F.lit(" "), low, F.lit(" ")), F.lit(f" {k} ")) | low.startswith(f"{k} ") | (low == k) for k in keywords)


def category_total(text: Column, names: Iterable[str] = rules.CATEGORY_TOTALS) -> Column:
    return F.lower(F.trim(text)).isin(*names)


def episode(description: Column, category: Column, surgical=rules.SURGICAL, atomic=rules.ATOMIC, room=rules.ROOM, surgical_categories=rules.SURGICAL_CATEGORIES, room_categories=rules.ROOM_CATEGORIES) -> Column:
    """surgical before atomic before room_stay; all else is atomic."""
    kind = F.lower(F.coalesce(category, F.lit("")))
    return (
        F.when(kind.isin(*surgical_categories) | any_keyword(description, surgical), "surgical")
        .when(any_keyword(description, atomic), "atomic")
        .when(kind.isin(*room_categories) | token_keyword(description, room), "room_stay")
        .otherwise("atomic")
    )


def dispatch(description: Column, lists: dict = rules.DISPATCH, devices_first: bool = True) -> Column:
    """The check that an atomic line gets, by its first list with a hit; ``unmatched`` if none.

    Devices come before drugs, so that a drug-eluting stent is checked as a device.
    """
    order = [*lists]
    if devices_first:
        order.sort(key=lambda k: k != "device")
    out = F.lit("unmatched")
    for kind in reversed(order):
        out = F.when(any_keyword(description, lists[kind]), F.lit(kind)).otherwise(out)
    return out


def sanitised(value: Column, longest: int = 200) -> Column:
    """Trimmed metadata, or null for placeholders, bracketed, one-letter and overlong values."""
    clean = F.trim(value)
    good = F.length(clean).between(2, longest) & ~F.lower(clean).isin(*rules.PLACEHOLDERS) & ~(clean.startswith("[") & clean.endswith("]"))
    return F.when(good, clean)
