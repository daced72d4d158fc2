"""Scalar functions of the query language, as inlined Spark columns that Catalyst sees through."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _span(c: Column, ms: int) -> Column:
    """A signed length of time in milliseconds, in units of `ms`."""
    return (c / F.lit(ms)).cast("double")


def is_valid_email(c: Column) -> Column:
    return _true(c.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"))


def domain_of(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"@([^@\s]+)$", 1))


def listed(c: Column, values: list[str]) -> Column:
    """Whether a text is on a list, which the schema holds as a value."""
    return _true(c.isin(values))


#: Lists that the domain predicates read; a schema sets its own.
LISTS: dict[str, list[str]] = {"disposable": [], "blocked": [], "public": [], "breached": [], "common": [], "statuses": []}


def rounded_to_cents(c: Column) -> Column:
    return _true(F.round(c, 2) == c)


FUNCTIONS = {
    "length": lambda x: F.char_length(x).cast("long"),
    "concat": F.concat,
    "contains": lambda x, y: _true(F.contains(x, y)),
    "startsWith": lambda x, y: _true(F.startswith(x, y)),
    "isNotEmpty": lambda x: _true(F.length(x) > 0),
    "maxLen": lambda n, x: _true(F.length(x) <= n),
    "minLen": lambda n, x: _true(F.length(x) >= n),
    "containsWhitespace": lambda x: _true(x.rlike(r"\s")),
    "isTitleCase": lambda x: _true(F.initcap(x) == x),
    "allDigits": lambda x: _true(x.rlike(r"^[0-9]+$")),
    "isValidEmail": is_valid_email,
    "isRoundedToCents": rounded_to_cents,
    "isDisposableDomain": lambda x: listed(domain_of(x), LISTS["disposable"]),
    "isBlockedDomain": lambda x: listed(domain_of(x), LISTS["blocked"]),
    "isCorporateDomain": lambda x: is_valid_email(x) & ~listed(domain_of(x), LISTS["public"] + LISTS["disposable"]),
    "isBreached": lambda x: listed(F.lower(F.sha1(F.encode(x, "UTF-8"))), LISTS["breached"]),
    "isCommonWord": lambda x: listed(F.lower(x), LISTS["common"]),
    "isKnownStatus": lambda x: listed(x, LISTS["statuses"]),
    "isNothing": lambda x: x.isNull(),
    "isJust": lambda x: x.isNotNull(),
    "moment": lambda x: x.cast("timestamp_ntz"),
    "fromMaybe": lambda d, x: F.coalesce(x, d if isinstance(d, Column) else F.lit(d)),
    "upper": F.upper,
    "lower": F.lower,
    "trim": F.trim,
    "replace": lambda x, a, b: F.replace(x, a, b),
    "days": lambda x: _span(x, 86_400_000),
    "hours": lambda x: _span(x, 3_600_000),
    "minutes": lambda x: _span(x, 60_000),
    "seconds": lambda x: _span(x, 1000),
    "millis": lambda x: x.cast("double"),
    "year": lambda x: F.year(x).cast("long"),
    "round": lambda x, n: F.round(x, n),
    "toText": lambda x: x.cast("string"),
    "words": lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != ""),
    "splitOn": lambda a, x: F.split(x, F.regexp_replace(a, r"([^\w\s])", r"\\$1")),
    "isInfixOf": lambda a, x: _true(F.contains(x, a)),
    "isSuffixOf": lambda a, x: _true(F.endswith(x, a)),
    "take": lambda n, x: F.substring(x, 1, n),
    "strip": F.trim,
    "abs": F.abs,
    "floor": lambda x: F.floor(x).cast("long"),
    "ceiling": lambda x: F.ceil(x).cast("long"),
    "truncate": lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("long"),
    "elem": lambda x, xs: _true(F.array_contains(xs, x)),
    "nub": F.array_distinct,
    "sort": F.array_sort,
    "reverse": F.reverse,
    "lookup": lambda k, m: F.try_element_at(m, k),
    "keys": F.map_keys,
    "addDays": lambda n, x: F.timestamp_add("DAY", F.lit(n), x),
    "month": lambda x: F.month(x).cast("long"),
    "dayOfWeek": lambda x: F.dayofweek(x).cast("long"),
}


def elapsed_ms(later: Column, earlier: Column) -> Column:
    """Time - time as signed milliseconds."""
    return F.timestamp_diff("MILLISECOND", earlier, later).cast("long")


# Row ids: 12 bytes, big-endian milliseconds (6), server (2), sequence (4); byte order is time order.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"  # fixed value: the alphabet of Crockford's base 32


def data_id(ms: Column, server: Column, sequence: Column) -> Column:
    return F.unhex(F.concat(F.lpad(F.hex(ms), 12, "0"), F.lpad(F.hex(server), 4, "0"), F.lpad(F.hex(sequence), 8, "0")))


def created_at(row_id: Column) -> Column:
    return F.timestamp_millis(F.conv(F.hex(F.substring(row_id, 1, 6)), 16, 10).cast("long")).cast("timestamp_ntz")


def origin_server(row_id: Column) -> Column:
    return F.conv(F.hex(F.substring(row_id, 7, 2)), 16, 10).cast("int")


def version_id(shard: Column, seq: Column, place: Column) -> Column:
    """The 14 bytes of a row version: shard (4), transaction (8) and place in it (2), big-endian, so that byte order is theirs."""
    return F.unhex(F.concat(F.lpad(F.hex(shard.cast("long")), 8, "0"), F.lpad(F.hex(seq.cast("long")), 16, "0"), F.lpad(F.hex(place.cast("long")), 4, "0")))


def version_parts(rid: Column) -> tuple[Column, Column, Column]:
    """(shard, transaction, place) of a row version's 14 bytes."""
    number = lambda at, n, kind: F.conv(F.hex(F.substring(rid, at, n)), 16, 10).cast(kind)
    return number(1, 4, "long"), number(5, 8, "long"), number(13, 2, "int")


def transaction_id(shard: Column, seq: Column) -> Column:
    """The version id of a transaction itself: place 0."""
    return version_id(shard, seq, F.lit(0))


def render_id(row_id: Column) -> Column:
    """20 characters of base 32 that sort as the ids do."""
    bits = F.rpad(F.concat(*[F.lpad(F.conv(F.hex(F.substring(row_id, i, 3)), 16, 2), 24, "0") for i in (1, 4, 7, 10)]), 100, "0")
    digit = lambda i: F.substring(F.lit(CROCKFORD), F.conv(F.substring(bits, 5 * i + 1, 5), 2, 10).cast("int") + 1, F.lit(1))
    return F.concat(*[digit(i) for i in range(20)])


def virtual(row_id: Column) -> dict[str, Column]:
    """The columns that every row has without storing them, from its id."""
    return {"created_at": created_at(row_id), "origin_server": origin_server(row_id), "id": render_id(row_id)}
