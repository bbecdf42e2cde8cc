"""Strings, numbers as text, dates and JSON fields."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@F.pandas_udf(T.StringType())
def printed(x: pd.Series, digits: pd.Series) -> pd.Series:
    """A number with some decimals, rounded as C's printf does (on the exact binary value). For narrative edges only."""
    return pd.Series([None if pd.isna(v) else f"{v:.{int(n)}f}" for v, n in zip(x, digits, strict=True)])


def fixed(x, digits: int) -> Column:
    """Like ``%.0f`` (built in, halves to even) or ``%.nf``."""
    if digits == 0:
        return F.format_string("%.0f", F.bround(_c(x).cast("double"), 0))
    return printed(_c(x).cast("double"), F.lit(digits))


#: For translate: the letters that ASCII folds.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def contains_ascii(value, wanted: str) -> Column:
    """Whether a text contains another one, A-Z counting as a-z and no other letters folded."""
    return F.translate(_c(value), _UPPER, _LOWER).contains(wanted.translate(str.maketrans(_UPPER, _LOWER)))


def contains_folded(value, wanted: str) -> Column:
    return F.lower(_c(value)).contains(wanted.lower())


def area_text(m2) -> Column:
    m2 = _c(m2)
    return (
        F.when(m2 >= 1_000_000, F.concat(fixed(m2 / 1_000_000, 1), F.lit(" km²")))
        .when(m2 >= 10_000, F.concat(fixed(m2 / 10_000, 1), F.lit(" ha")))
        .otherwise(F.concat(fixed(m2, 0), F.lit(" m²")))
    )


def people_text(n) -> Column:
    n = _c(n)
    return (
        F.when(n >= 1_000_000, F.concat(fixed(n / 1_000_000, 1), F.lit("M")))
        .when(n >= 1_000, F.concat(fixed(n / 1_000, 0), F.lit("K")))
        .otherwise(n.cast("string"))
    )


def listed(names, last: str = " and ") -> Column:
    """``a``, ``a and b``, ``a, b and c``."""
    names = _c(names)
    head = F.array_join(F.slice(names, F.lit(1), F.greatest(F.size(names) - 1, F.lit(1))), ", ")
    return F.when(F.size(names) > 1, F.concat(head, F.lit(last), F.element_at(names, -1))).otherwise(F.array_join(names, ", "))


def country_of_file(path) -> Column:
    """The country part of ``<sensor>_<year>_<country...>.csv``."""
    name = F.regexp_replace(F.substring_index(_c(path), "/", -1), r"\.csv$", "")
    parts = F.split(name, "_")
    return F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))), "_")


def padded_time(hhmm) -> Column:
    return F.lpad(_c(hhmm).cast("string"), 4, "0")


def short_park_name(name) -> Column:
    """Lower case, without each of three suffixes in turn."""
    out = F.lower(_c(name))
    for suffix in (" national park", " game reserve", " reserve"):
        out = F.regexp_replace(out, f"{suffix}$", "")
    return out


def about_park(title, abstract, name) -> Column:
    """Whether a work's title or abstract has the park's name, whole or without its suffixes."""
    title, abstract = F.lower(F.coalesce(_c(title), F.lit(""))), F.lower(F.coalesce(_c(abstract), F.lit("")))
    whole, short = F.lower(_c(name)), short_park_name(name)
    return title.contains(whole) | title.contains(short) | abstract.contains(whole) | abstract.contains(short)


def _once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def inverted_index(value) -> Column:
    """Map of each word between single spaces to its positions from 0, in order: the words sorted, and each run of equal ones cut out."""
    in_order = F.sort_array(F.transform(F.split(_c(value), " "), lambda w, i: F.struct(w.alias("w"), i.alias("p"))))

    def runs(s: Column) -> Column:
        places = F.transform(s, lambda e, i: F.when((i == 0) | ~e["w"].eqNullSafe(F.get(s, i - 1)["w"]), i))
        starts, found = F.filter(places, lambda i: i.isNotNull()), F.transform(s, lambda e: e["p"])

        def run(i: Column, n: Column, t: Column, ps: Column) -> Column:
            return F.struct(F.get(s, i)["w"].alias("w"), F.slice(ps, i + 1, F.coalesce(F.get(t, n + 1), F.size(s)) - i).alias("ps"))

        return _once(starts, lambda t: _once(found, lambda ps: F.transform(t, lambda i, n: run(i, n, t, ps))))

    return F.map_from_entries(_once(in_order, runs))


def abstract_text(index, limit: int = 1000) -> Column:
    """Text of an inverted index (word to positions): gaps give empty words, and over ``limit`` bytes it is cut and marked.

    Words are sorted by position and each is set off by as many spaces as lie before it, so the work follows the number of words.
    Positions below 0 or null are left out; of several words at one position the last in order counts; no index gives an empty text.
    """
    entries = F.flatten(F.transform(F.map_entries(_c(index)), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    in_order = F.sort_array(F.filter(entries, lambda e: e["p"] >= 0))
    last_of_each = _once(in_order, lambda s: F.filter(s, lambda e, i: ~e["p"].eqNullSafe(F.get(s, i + 1)["p"])))
    spaced = _once(last_of_each, lambda s: F.transform(s, lambda e, i: F.concat(F.repeat(F.lit(" "), (e["p"] - F.coalesce(F.get(s, i - 1)["p"], F.lit(0))).cast("int")), e["w"])))
    cut = _once(F.array_join(spaced, ""), lambda t: F.when(F.octet_length(t) > limit, F.concat(F.substring(t.cast("binary"), 1, limit).cast("string"), F.lit("..."))).otherwise(t))
    return F.coalesce(cut, F.lit(""))


def last_part(value, sep: str = "/") -> Column:
    return F.substring_index(_c(value), sep, -1)


#: Track messages that devices send by themselves.
DEFAULT_MESSAGES = ("I'm checking in. Everything is okay.", "Tracking", "Waypoint")


def own_message(description) -> Column:
    return F.coalesce((_c(description) != "") & ~_c(description).isin(*DEFAULT_MESSAGES), F.lit(False))


def month_name(date) -> Column:
    return F.date_format(_c(date), "MMMM")


def day_text(date) -> Column:
    return F.date_format(_c(date), "MMM dd, yyyy")


def day_or_first(ts, year, month) -> Column:
    return F.coalesce(F.to_date(_c(ts)), F.make_date(_c(year), _c(month), F.lit(1)))


def authors(text) -> Column:
    return F.from_json(_c(text), "array<string>")
