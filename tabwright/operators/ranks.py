"""Rows at a global rank, without a global window or a driver-side merge of all rows before it."""

from __future__ import annotations

from collections.abc import Generator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabwright.functions.columns import col, dtype, is_date, is_float, is_integer, is_string
from tabwright.operators.quantiles import values_at_ranks

# Rows with equal leading keys that are sorted together instead of being told apart further.
# A bound on all tasks together, as the rows on both sides are cut off.
TIES = 10_000
# Rows up to the end of a page near the start, which is a plain top-k.
TOP_ROWS = 500
# Leading bytes of a text that fit, with their number, a double that a sketch holds exactly.
TEXT_DIGIT_BYTES = 6


def _digits(c: Column, t: T.DataType, clean: bool = False) -> Generator[Column, object, None]:
    """Numbers that order rows as the value does, compared one after the other.

    Each is asked for only among rows that agree on those before, and the value found is sent
    back; None says that the rows hold no value, which ends the digits. ``clean`` floats hold
    no NaN.
    """
    if is_integer(t) or isinstance(t, T.BooleanType):
        yield c.cast("bigint")
    elif is_float(t):
        if clean or (yield F.when(c.isNotNull(), F.isnan(c).cast("bigint"))) == 0:
            yield c.cast("double")
    elif t.typeName() == "date":
        yield F.unix_date(c).cast("bigint")
    elif is_date(t):
        yield F.unix_micros(c.cast("timestamp"))
    elif isinstance(t, T.DecimalType):
        yield c
    elif is_string(t) or isinstance(t, T.BinaryType):
        # Six bytes at a time and how many there were: a text sorts before its continuations.
        raw, full = F.encode(c, "UTF-8") if is_string(t) else c, TEXT_DIGIT_BYTES
        start = 0
        while full == TEXT_DIGIT_BYTES:
            piece = F.substring(raw, start + 1, TEXT_DIGIT_BYTES)
            number = F.conv(F.rpad(F.hex(piece), 2 * TEXT_DIGIT_BYTES, "0"), 16, 10).cast("bigint")
            found = yield number * F.lit(8) + F.octet_length(piece)
            full = None if found is None else found % 8
            start += TEXT_DIGIT_BYTES
    elif isinstance(t, T.ArrayType):
        at = 0
        while (yield F.when(F.size(c) > F.lit(at), F.lit(1)).when(c.isNotNull(), F.lit(0)).cast("bigint")):
            yield from _digits(F.get(c, F.lit(at)), t.elementType)
            at += 1
    elif isinstance(t, T.StructType):
        if (yield F.when(c.isNotNull(), F.lit(1)).cast("bigint")):
            for f in t:
                yield from _digits(c.getField(f.name), f.dataType)
    else:
        raise ValueError(f"rows cannot be ranked by a column of type {t.simpleString()}")


@dataclass
class _Boundary:
    """The rows that share the keys found at a rank, and those on both sides of them."""

    before: Column
    equal: Column
    after: Column
    rest: int  # the rank among the equal rows
    crowd: int  # how many these are


def _locate(df: DataFrame, keys: list[str], rank: int, size: int) -> _Boundary:
    """Exact selection of a rank, key by key and digit by digit, until few rows are tied."""
    at = _Boundary(F.lit(False), F.lit(True), F.lit(False), rank, size)
    for name in keys:
        if at.crowd <= TIES:
            break
        digits, value = _digits(col(name), dtype(df, name), clean=True), None
        digit = next(digits)
        while digit is not None and at.crowd > TIES:
            crowd, rest = at.crowd, at.rest
            ranks = lambda present: [rest - (crowd - present)] if rest >= crowd - present else []
            present, found = values_at_ranks(df.filter(at.equal), {"d": digit}, ranks)["d"]
            nulls = crowd - present  # missing values come first
            if rest < nulls:
                value, after = None, at.after | (at.equal & digit.isNotNull())
                at = _Boundary(at.before, at.equal & digit.isNull(), after, rest, nulls)
            else:
                value, below, alike = found[rest - nulls]
                v = F.lit(value)
                before, after = at.before | (at.equal & (digit.isNull() | (digit < v))), at.after | (at.equal & (digit > v))
                at = _Boundary(before, at.equal & (digit == v), after, rest - nulls - below, alike)
            try:
                digit = digits.send(value)
            except StopIteration:
                digit = None
    return at


def rows_from_rank(df: DataFrame, keys: list[str], offset: int, n: int) -> DataFrame:
    """``n`` rows from 0-based rank ``offset`` in the order of ``keys``, missing values first.

    The first rows of a table are a top-k. For pages further on, the keys at the first and at
    the last rank are found by exact selection, and only the rows between them, at most ``n``
    and two times ``TIES``, are sorted. Rows that are alike in all keys may be a crowd: the page
    takes as many of them as it holds.
    """
    order = [col(c).asc_nulls_first() for c in keys]
    if offset + n <= TOP_ROWS:
        return df.orderBy(*order).offset(offset).limit(n)
    size = df.count()
    n = min(n, size - offset)
    if n <= 0:
        return df.limit(0)
    low, high = _locate(df, keys, offset, size), _locate(df, keys, offset + n - 1, size)
    until = high.before | high.equal
    if low.crowd <= TIES:
        return df.filter((low.equal | low.after) & until).orderBy(*order).offset(low.rest).limit(n)
    alike = min(n, low.crowd - low.rest)
    first = df.filter(low.equal).limit(alike)
    return first if alike == n else first.unionByName(df.filter(low.after & until).orderBy(*order).limit(n - alike))
