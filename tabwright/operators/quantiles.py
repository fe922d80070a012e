"""Exact order statistics without gathering a column in one task.

Spark's ``percentile`` keeps every distinct value of a group in one aggregation buffer,
which does not survive a column of a trillion values. Here the value at a rank is found
by narrowing: a mergeable quantile sketch (KLL) proposes two pivots around the rank, counts
tell in which region the rank lies, and the search goes on inside it. Pivots are counted apart
from the region between them, so a value held by a third of all rows is found as a pivot instead
of being narrowed forever. The sketch is part of the first aggregation, beside whatever else is
measured there. A round is two scans of the pruned columns: one counts the wide regions between
the searched ranks side by side, the other takes only values near those ranks and counts them
with map-side combine. Only counts, sketches and at most ``COLLECT_LIMIT`` values per searched
rank leave the executors. One round settles 5 * 10**6 rows, three rounds 10**12.
"""

from __future__ import annotations

import functools
import math
from bisect import bisect_left
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tabwright.functions.columns import dtype, finite, is_float, is_integer

# Steps of the grid of quantiles taken from a sketch (an odd number, so quartiles lie between two), steps around a rank that its error may
# reach, and values that a level of the sketch keeps (rank error 0.07 % with 99 % confidence).
GRID_STEPS, MARGIN = 2001, 2
SKETCH_SIZE = 4096
COLLECT_LIMIT = 20_000
# Columns searched in one aggregation; the scan only reads those columns.
BATCH = 8

# One text that folds to an array: hundreds of literals would slow down planning.
_GRID = "cast(split('" + " ".join(str(i / GRID_STEPS) for i in range(GRID_STEPS + 1)) + "', ' ') as array<double>)"


class Found(NamedTuple):
    """A value, how many values lie below it, and how often it occurs."""

    value: object
    below: int
    equal: int


@dataclass
class _Search:
    """The value at ``rank`` lies strictly between ``low`` and ``high``."""

    key: str
    rank: int
    size: int  # values between the bounds
    passed: int  # values up to and including the lower bound
    grid: list | None
    least: object  # bounds of the whole column
    greatest: object
    low: object = None
    high: object = None
    answer: Found | None = None

    def pivots(self) -> list:
        """The grid values around the wanted position; none when the region is small or
        has no sketch yet."""
        if self.size <= COLLECT_LIMIT or not self.grid:
            return []
        last = len(self.grid) - 1
        at = int((self.rank - self.passed) / max(self.size - 1, 1) * last)
        inside = [
            p for p in {self.grid[max(at - MARGIN, 0)], self.grid[min(at + 1 + MARGIN, last)]}
            if (self.low is None or p > self.low) and (self.high is None or p < self.high)
        ]
        return sorted(inside) or [self.middle()]

    def middle(self) -> object:
        """A value between the bounds, for long integers and decimals that the sketch, which
        works on doubles, rounded out of the region."""
        low = self.least if self.low is None else self.low
        high = self.greatest if self.high is None else self.high
        unit = Decimal(1).scaleb(low.as_tuple().exponent) if isinstance(low, Decimal) else 1
        half = (high - low) // unit // 2 * unit
        return low + half if self.low is None else high - half

    def expected(self) -> int:
        """How many values the next region will hold, by the error bound of the sketch."""
        return 4 * MARGIN * self.size // GRID_STEPS if self.pivots() else self.size


def sketch(e: Column, t: T.DataType) -> Column:
    """A grid of quantiles of the values, by a sketch that merges before the shuffle; the first
    and the last one are the least and the greatest value (of a decimal, as a double)."""
    whole = is_integer(t)
    made = (F.kll_sketch_agg_bigint if whole else F.kll_sketch_agg_double)(e.cast("bigint" if whole else "double"), F.lit(SKETCH_SIZE))
    grid = (F.kll_sketch_get_quantile_bigint if whole else F.kll_sketch_get_quantile_double)(made, F.expr(_GRID))
    return F.when(F.count(e) > 0, grid)


def grid_of(values: list | None, t: T.DataType) -> list | None:
    """A collected grid in the type of the column."""
    if values is None or not isinstance(t, T.DecimalType):
        return values
    unit = Decimal(1).scaleb(-t.scale)
    return [Decimal(v).quantize(unit) for v in values]


def starts(k: str, e: Column, t: T.DataType) -> list[Column]:
    """What a search begins with: count and grid, of decimals also the least and greatest value."""
    ends = [F.min(e).alias(f"a_{k}"), F.max(e).alias(f"b_{k}")] if isinstance(t, T.DecimalType) else []
    return [F.count(e).alias(f"n_{k}"), sketch(e, t).alias(f"g_{k}"), *ends]


def started(row: dict, k: str, t: T.DataType) -> tuple:
    """``(count, grid, least, greatest)``."""
    n, grid = row[f"n_{k}"], grid_of(row[f"g_{k}"], t)
    return n, grid, *((row[f"a_{k}"], row[f"b_{k}"]) if f"a_{k}" in row else (grid[0], grid[-1]) if grid else (None, None))


def _start(df: DataFrame, names: list[str]) -> dict[str, tuple]:
    """Count, sketch, least and greatest value per column."""
    found = {}
    for i in range(0, len(names), BATCH):
        part = names[i : i + BATCH]
        row = df.agg(*[x for k in part for x in starts(k, F.col(k), dtype(df, k))]).first().asDict()
        found.update({k: started(row, k, dtype(df, k)) for k in part})
    return found


def _literal(v: object) -> str:
    """A number in SQL. One text instead of hundreds of literals keeps planning fast."""
    return f"{v!r}D" if isinstance(v, float) else f"{v}BD" if isinstance(v, Decimal) else f"{v}L" if v >= -(2**63) + 1 else f"({v + 1}L - 1L)"


def _inside(e: str, cuts: list, first: int, last: int) -> str:
    """Whether a value lies in one of the regions from ``first`` to ``last``: 0 is below the first
    cut, 1 on it, 2 between it and the next one ..."""
    if first == last and first % 2:
        return f"{e} = {_literal(cuts[first // 2])}"
    tests = []
    if first:
        tests.append(f"{e} >= {_literal(cuts[first // 2])}" if first % 2 else f"{e} > {_literal(cuts[first // 2 - 1])}")
    if last // 2 < len(cuts):
        tests.append(f"{e} <= {_literal(cuts[last // 2])}" if last % 2 else f"{e} < {_literal(cuts[last // 2])}")
    return f"({' AND '.join(tests) or f'{e} IS NOT NULL'})"


@dataclass
class _Plan:
    """What one round looks at in a column."""

    cuts: list
    fetch: set[int]  # regions whose values are fetched
    narrow: set[int]  # regions that get a new sketch

    def stretches(self) -> list[tuple[int, int]]:
        """First and last of neighbouring fetched regions."""
        return list(zip([r for r in sorted(self.fetch) if r - 1 not in self.fetch], [r for r in sorted(self.fetch) if r + 1 not in self.fetch]))

    def counted(self) -> list[int]:
        """Regions that are only counted; the last one is what is left of the column."""
        return [r for r in range(2 * len(self.cuts) + 1) if r not in self.fetch | self.narrow]

    def region(self, value: object) -> int:
        at = bisect_left(self.cuts, value)
        return 2 * at + (at < len(self.cuts) and self.cuts[at] == value)


def _planned(searches: list[_Search]) -> dict[str, _Plan]:
    plans = {}
    for k in dict.fromkeys(s.key for s in searches):
        mine = [s for s in searches if s.key == k]
        cuts = sorted({p for s in mine for p in (s.low, s.high, *s.pivots()) if p is not None})
        plan = plans[k] = _Plan(cuts, set(), set())
        for s in mine:
            edges = [s.low, *s.pivots(), s.high]
            if len(edges) == 3:  # most likely the pivot itself, so its sides are only counted
                continue
            if len(edges) == 4:  # between the two pivots
                edges = edges[1:3]
            first = 0 if edges[0] is None else 2 * cuts.index(edges[0]) + 2
            last = 2 * len(cuts) if edges[-1] is None else 2 * cuts.index(edges[-1])
            (plan.fetch if s.expected() <= COLLECT_LIMIT else plan.narrow).update(range(first, last + 1, 2))
            # Pivots that are no frequent values are fetched along.
            light = {2 * cuts.index(p) + 1 for p in s.pivots() if s.grid and s.grid.count(p) < 2}
            plan.fetch |= light if s.expected() <= COLLECT_LIMIT else set()
        plan.fetch -= plan.narrow
    return plans


def _round(df: DataFrame, searches: list[_Search], totals: dict[str, int], watch: Watch | None = None) -> None:
    """Count every region around the pivots and move the searches on."""
    plans = _planned(searches)
    names = list(plans)
    types = {k: dtype(df, k) for k in names}
    kinds = list(dict.fromkeys(types.values()))
    if watch:
        watch.aim(searches)
    counts = [f"count_if({_inside(k, p.cuts, r, r)}) AS c_{k}_{r}" for k, p in plans.items() for r in p.counted()[:-1]]
    counts += watch.counts() if watch else []
    wide = df.selectExpr(*counts).first() if counts else None
    if watch:
        watch.counted(wide)
    # Rows near a searched rank become one row per column; of most rows nothing is left.
    near = {k: [_inside(k, p.cuts, *ends) for ends in p.stretches()] + (watch.zone(k, k) if watch else []) for k, p in plans.items()}
    dense = {k: {r: _inside(k, p.cuts, r, r) for r in sorted(p.narrow)} for k, p in plans.items()}
    looked = [k for k in names if near[k] or dense[k]]
    found = []
    if looked:
        entries = []
        for k in looked:
            fetched, narrowed = " OR ".join(near[k]) or "false", " ".join(f"WHEN {test} THEN {r}" for r, test in dense[k].items())
            region = f"CASE {narrowed} END" if narrowed else "CAST(NULL AS INT)"
            values = ", ".join(f"CAST({k if types[k] == t else 'NULL'} AS {t.simpleString()}) AS v{j}" for j, t in enumerate(kinds))
            entries.append(f"named_struct('k', {names.index(k)}, 'f', {fetched}, 'r', {region}, 'v', struct({values}))")
        # The task number keeps the filter above the columns, which are then computed once a row.
        kept = df.select("*", F.spark_partition_id().alias("task")).filter(f"task >= 0 AND ({' OR '.join(test for k in looked for test in [*near[k], *dense[k].values()])})")
        tall = kept.selectExpr(f"inline(array({', '.join(entries)}))").filter("f OR r IS NOT NULL")
        keys = ["k", "r", *[F.when(F.col("f"), F.col(f"v.v{j}")).alias(f"f{j}") for j in range(len(kinds))]]
        narrowing = any(dense.values())
        aggs = [F.count(F.lit(1)).alias("n"), *([sketch(F.when(F.col("r").isNotNull(), F.col(f"v.v{j}")), t).alias(f"g{j}") for j, t in enumerate(kinds)] if narrowing else [])]
        found = tall.groupBy(*keys).agg(*aggs).collect()
    for i, (k, p) in enumerate(plans.items()):
        j = kinds.index(types[k])
        regions: dict[int, _Region] = {}
        for row in (x for x in found if x["k"] == i):
            value = row[f"f{j}"]
            if row["r"] is not None:
                regions.setdefault(row["r"], _Region()).add(None, row["n"], grid_of(row[f"g{j}"], types[k]))
            elif (r := p.region(value)) in p.fetch:
                regions.setdefault(r, _Region()).add(value, row["n"], None)
            if watch and value is not None:
                watch.found(k, value, row["n"])
        counted = p.counted()
        for r in counted[:-1]:
            regions.setdefault(r, _Region()).size += wide[f"c_{k}_{r}"]
        if counted:
            regions.setdefault(counted[-1], _Region()).size = totals[k] - sum(x.size for r, x in regions.items() if r != counted[-1])
        for s in searches:
            if s.key == k:
                _advance(s, p.cuts, {r: x for r, x in regions.items() if x.size})


class Watch:
    """Counts the values outside the 1.5 IQR fences in the very scans that find the quartiles.

    Bounds of the quartiles bound the fences. Values beyond every possible fence are counted;
    those between the bounds of a fence are taken along one by one, and decided when the
    quartiles are known. Columns where they would be too many, or whose search takes more than
    one round, get no count and need a scan of their own.
    """

    def __init__(self, fences: Callable[[float, float], tuple[float, float]]):
        self.fences = fences
        self.names: dict[str, str] = {}  # name in the search of each column
        self.bounds: dict[str, tuple[float, float, float, float]] = {}
        self.sure: dict[str, int] = {}
        self.near: dict[str, list[tuple[float, int]]] = {}
        self.unsure: set[str] = set()

    def aim(self, searches: list[_Search]) -> None:
        for k in dict.fromkeys(s.key for s in searches):
            mine = sorted((s for s in searches if s.key == k), key=lambda s: s.rank)
            if mine[0].least == mine[0].greatest:  # nothing lies outside
                self.sure[k], self.near[k] = 0, []
                continue
            bounds = None if k in self.bounds or any(s.expected() > COLLECT_LIMIT for s in mine) else self._bounds(mine)
            if bounds is None:
                self.unsure.add(k)
            else:
                self.bounds[k] = bounds

    def _bounds(self, mine: list[_Search]) -> tuple[float, float, float, float] | None:
        ends = [(float(p[0]), float(p[-1])) for s in mine for p in [s.pivots() or [s.least, s.greatest]]]
        outer, inner = self.fences(ends[0][0], ends[-1][1]), self.fences(ends[0][1], ends[-1][0])
        found = outer[0], max(outer[0], inner[0]), min(outer[1], inner[1]), outer[1]
        zone = sum(found[0] <= g <= found[1] or found[2] <= g <= found[3] for g in map(float, mine[0].grid))
        return found if zone * mine[0].size // GRID_STEPS <= COLLECT_LIMIT else None

    def _live(self) -> list[str]:
        return [k for k in self.bounds if k not in self.sure]

    def counts(self) -> list[str]:
        beyond = {k: f"CAST({k} AS DOUBLE) < {b[0]!r}D OR CAST({k} AS DOUBLE) > {b[3]!r}D" for k, b in self.bounds.items() if k in self._live()}
        return [f"count_if({test}) AS w_{k}" for k, test in beyond.items()]

    def counted(self, row) -> None:
        for k in self._live():
            self.sure[k], self.near[k] = row[f"w_{k}"], []

    def zone(self, k: str, e: str) -> list[str]:
        """Whether a value lies between the bounds of a fence."""
        if k not in self.sure or k in self.unsure or k not in self.bounds:
            return []
        a, b, c, d = (f"{x!r}D" for x in self.bounds[k])
        return [f"CAST({e} AS DOUBLE) BETWEEN {a} AND {b}", f"CAST({e} AS DOUBLE) BETWEEN {c} AND {d}"]

    def found(self, k: str, value: object, n: int) -> None:
        a, b, c, d = self.bounds.get(k, (0, -1, 0, -1))
        if k in self.near and (a <= float(value) <= b or c <= float(value) <= d):
            self.near[k].append((float(value), n))

    def count(self, column: str, fences: tuple[float, float]) -> int | None:
        """Values outside the fences; none if they have to be counted apart."""
        k = self.names.get(column)
        if k in self.unsure or k not in self.sure:
            return None
        return self.sure[k] + sum(n for v, n in self.near[k] if v < fences[0] or v > fences[1])


class _Region:
    """What one round found out about a region: its size, its values or its sketch."""

    def __init__(self) -> None:
        self.size = 0
        self.values: list[tuple] = []
        self.grid: list | None = None

    def add(self, value: object, n: int, grid: list | None) -> None:
        self.size += n
        if value is not None:
            self.values.append((value, n))
        if grid:
            self.grid = grid

    def value_at(self, rank: int, passed: int) -> Found | None:
        for value, n in sorted(self.values):
            if rank < passed + n:
                return Found(value, passed, n)
            passed += n
        return None


def _advance(s: _Search, cuts: list, regions: dict[int, _Region]) -> None:
    passed = 0
    for r in sorted(regions):
        if s.rank < passed + regions[r].size:
            break
        passed += regions[r].size
    if r % 2:
        s.answer = Found(cuts[r // 2], passed, regions[r].size)
        return
    if regions[r].values:
        s.answer = regions[r].value_at(s.rank, passed)
    s.low, s.high = (cuts[r // 2 - 1] if r else None), (cuts[r // 2] if r // 2 < len(cuts) else None)
    s.size, s.passed, s.grid = regions[r].size, passed, regions[r].grid


def values_at_ranks(
    df: DataFrame, exprs: dict[str, Column], ranks, start: dict[str, tuple] | None = None, watch: Watch | None = None,
) -> dict[str, tuple[int, dict[int, Found]]]:
    """For each expression its non-null count and the values at the wanted 0-based ranks.

    ``ranks(n)`` names the ranks for a column with ``n`` values. ``start`` holds what ``starts``
    measured, if another aggregation has done so.
    """
    if not exprs:
        return {}
    names = {f"k{i}": key for i, key in enumerate(exprs)}
    df = df.select(*[e.alias(n) for n, e in zip(names, exprs.values())])
    result = {}
    begun = {n: start[key] for n, key in names.items()} if start else _start(df, list(names))
    totals = {k: b[0] for k, b in begun.items()}
    for i in range(0, len(names), BATCH):
        part = list(names)[i : i + BATCH]
        searches = [_Search(k, r, totals[k], 0, *begun[k][1:]) for k in part if totals[k] for r in sorted(set(ranks(totals[k])))]
        while waiting := [s for s in searches if s.answer is None]:
            _round(df, waiting, totals, watch)
        result.update({names[k]: (totals[k], {s.rank: s.answer for s in searches if s.key == k}) for k in part})
    if watch:
        watch.names = {key: n for n, key in names.items()}
    return result


def quantiles_of(
    df: DataFrame, exprs: dict[str, Column], probs: Sequence[float], start: dict[str, tuple] | None = None, watch: Watch | None = None,
) -> dict[str, list[float | None]]:
    """Exact quantiles with linear interpolation between the two neighbouring ranks."""

    def ranks(n: int) -> list[int]:
        return [r for p in probs for r in (math.floor((n - 1) * p), math.ceil((n - 1) * p))]

    result: dict[str, list[float | None]] = {}
    for key, (n, at) in values_at_ranks(df, exprs, ranks, start, watch).items():
        if not n:
            result[key] = [None] * len(probs)
            continue
        line = []
        for p in probs:
            position = (n - 1) * p
            low, high = float(at[math.floor(position)].value), float(at[math.ceil(position)].value)
            line.append(low + (high - low) * (position - math.floor(position)))
        result[key] = line
    return result


def searched_type(t: T.DataType) -> T.DataType:
    """The widest type of a kind of numbers."""
    return T.LongType() if is_integer(t) else T.DoubleType() if is_float(t) else t


def numeric_expr(df: DataFrame, name: str) -> Column:
    """The finite values of a numeric column in the widest type of its kind."""
    return finite(name, dtype(df, name)).cast(searched_type(dtype(df, name)))


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], start: dict[str, tuple] | None = None, watch: Watch | None = None,
) -> dict[str, list[float | None]]:
    for c in columns:
        if not isinstance(dtype(df, c), T.NumericType):
            raise ValueError(f"Column '{c}' is not numeric")
    return quantiles_of(df, {c: numeric_expr(df, c) for c in columns}, probs, start, watch)
