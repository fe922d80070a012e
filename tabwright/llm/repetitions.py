"""Periodic runs of words: grid search with longest common extensions from a difference cover."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tabwright.llm.common import small_batches, texts

GAPS = r"[\x20\x09-\x0D]+"
# A perfect difference cover: every distance modulo PERIOD lies between two members of COVER.
PERIOD, COVER = 13, (0, 1, 3, 9)
POWER, LEAST = 4, 6  # periods and words that a run has at least
TOGETHER = 1 << 15  # places that are extended in one go

SCHEMA = (
    "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
)


class Extensions:
    """Longest common extensions of a sequence whose suffixes all differ.

    Only suffixes at cover positions are sorted. Two positions are brought to cover positions by
    comparing less than PERIOD words; what follows is a range minimum over the common prefixes
    of neighbours in the sorted order.
    """

    def __init__(self, codes: np.ndarray):
        """``codes`` are whole numbers; a negative one occurs once."""
        n = len(codes)
        pad = int(codes.min(initial=0)) - 1 - np.arange(2 * PERIOD, dtype=np.int64)
        self.words = np.concatenate([codes, pad])
        blocks = n // PERIOD + 1
        at = (np.arange(blocks)[:, None] * PERIOD + np.array(COVER)).ravel()
        at = at[at < n]
        self.slot = np.full(PERIOD, -1)  # place of a residue in the cover
        self.slot[list(COVER)] = range(len(COVER))
        self.shift = np.array([next(x for x in COVER if (x + d) % PERIOD in COVER) for d in range(PERIOD)])
        ranks = [self._first(at)]
        sizes = [PERIOD]
        while ranks[-1].max(initial=-1) + 1 < len(at):
            step = len(COVER) * (sizes[-1] // PERIOD)
            low = ranks[-1]
            pair = np.full(len(at), -1, np.int64)
            pair[: max(len(at) - step, 0)] = low[step:]
            ranks.append(np.unique(low * np.int64(len(at) + 1) + pair + 1, return_inverse=True)[1])
            sizes.append(2 * sizes[-1])
        self.rank = ranks[-1]
        order = np.empty(len(at), np.int64)
        order[self.rank] = np.arange(len(at))
        lowest = self._neighbours(at, order, ranks, sizes)
        self.table = np.zeros((max(1, len(lowest).bit_length()), len(lowest)), np.int32)  # minima of 1, 2, 4 ... neighbours
        self.table[0] = lowest
        for k in range(1, len(self.table)):
            half = 1 << k - 1
            self.table[k, : len(lowest) - 2 * half + 1] = np.minimum(self.table[k - 1, : len(lowest) - 2 * half + 1], self.table[k - 1, half : len(lowest) - half + 1])

    def _first(self, at: np.ndarray) -> np.ndarray:
        """Ranks by the first PERIOD words, several of them packed in one number."""
        names = np.unique(self.words, return_inverse=True)[1].astype(np.int64)
        bits = max(1, int(names.max(initial=1)).bit_length())
        per, keys = 62 // bits, []
        for k in range(0, PERIOD, per):
            key = np.zeros(len(at), np.int64)
            for j in range(k, min(k + per, PERIOD)):
                key = key << bits | names[at + j]
            keys.append(key)
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(at), bool)
        for key in keys:
            new[1:] |= key[order][1:] != key[order][:-1]
        rank = np.empty(len(at), np.int64)
        rank[order] = np.cumsum(new)
        return rank

    def _neighbours(self, at: np.ndarray, order: np.ndarray, ranks: list[np.ndarray], sizes: list[int]) -> np.ndarray:
        """Common prefixes of neighbouring cover suffixes, from the longest equal blocks down."""
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(len(a), np.int64)
        for rank, size in zip(ranks[::-1], sizes[::-1]):
            inside = (a < len(at)) & (b < len(at))
            same = np.flatnonzero(inside)
            same = same[rank[a[same]] == rank[b[same]]]
            step = len(COVER) * (size // PERIOD)
            a[same] += step
            b[same] += step
            common[same] += size
        left, right = at[order[:-1]] + common, at[order[1:]] + common
        return (common + self._compared(left, right, np.full(len(left), PERIOD))).astype(np.int32)

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Equal words from ``i`` and ``j``, up to ``most``."""
        found, live = np.zeros(len(i), np.int64), np.arange(len(i))
        for k in range(PERIOD):
            live = live[most[live] > k]
            live = live[self.words[i[live] + k] == self.words[j[live] + k]]
            if not len(live):
                break
            found[live] += 1
        return found

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common extensions of the suffixes at ``i`` and ``j``, which differ."""
        reach = (self.shift[(j - i) % PERIOD] - i) % PERIOD
        found = self._compared(i, j, reach)
        deep = np.flatnonzero(found == reach)
        a, b = i[deep] + reach[deep], j[deep] + reach[deep]
        deep = deep[(a < len(self.words) - 2 * PERIOD) & (b < len(self.words) - 2 * PERIOD)]
        a, b = i[deep] + reach[deep], j[deep] + reach[deep]
        x = self.rank[a // PERIOD * len(COVER) + self.slot[a % PERIOD]]
        y = self.rank[b // PERIOD * len(COVER) + self.slot[b % PERIOD]]
        low, high = np.minimum(x, y), np.maximum(x, y)  # neighbours low .. high - 1
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        found[deep] += np.minimum(self.table[level, low], self.table[level, high - (1 << level)])
        return found


def _alike(codes: np.ndarray, period: int) -> np.ndarray:
    """Multiples of a period from which POWER words, one period apart, are equal. A run of that
    many periods holds such a place whatever its start."""
    grid = codes[::period]
    same = grid[1:] == grid[:-1]
    for k in range(POWER - 2):
        same = same[:-1] & same[1:] if k == 0 else same[:-1] & (grid[k + 1 : -1] == grid[k + 2 :])[: len(same) - 1]
    return np.flatnonzero(same) * period


def _joined(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of some documents, longest first, each followed by a number of its own; where
    each begins."""
    begins = np.concatenate([[0], np.cumsum(sizes[docs] + 1)])
    out = np.empty(begins[-1], np.int64)
    inside = np.ones(begins[-1], bool)
    inside[begins[1:] - 1] = False
    take = np.arange(begins[-1]) - np.repeat(begins[:-1] - starts[docs], sizes[docs] + 1)
    out[inside] = codes[take[inside]]
    out[~inside] = -1 - np.arange(len(docs))
    return out, begins


def _periods(sizes: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int]]:
    """Each period with the end of those documents that are long enough for it."""
    count = len(sizes)
    for p in range(1, int(sizes.max(initial=0)) // POWER + 1):
        while count and sizes[count - 1] < max(LEAST, POWER * p):
            count -= 1
        if not count:
            return
        yield p, int(begins[count])


def _extended(ahead: Extensions, back: Extensions, i: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretch around each place that keeps its period."""
    n = len(ahead.words) - 2 * PERIOD
    return i - back.common(n - i - period, n - i), i + period + ahead.common(i, i + period)


def _stretches(flat: np.ndarray, ahead: Extensions, back: Extensions, periods: Iterator[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """``(period, first, last)`` of the stretches of POWER periods, by ascending period. Places
    of several periods are extended together."""
    places, waiting = [], 0
    for p, end in periods:
        i = _alike(flat[:end], p)
        if len(i):
            places.append((i, np.full(len(i), p, np.int64)))
            waiting += len(i)
        if waiting > TOGETHER:
            yield from _extended_all(ahead, back, *map(np.concatenate, zip(*places)))
            places, waiting = [], 0
    if places:
        yield from _extended_all(ahead, back, *map(np.concatenate, zip(*places)))


def _extended_all(ahead: Extensions, back: Extensions, i: np.ndarray, p: np.ndarray) -> Iterator[tuple[int, int, int]]:
    # Of neighbouring places the first one is extended; the others only if its run ends before them.
    head = np.concatenate([[True], (np.diff(i) != p[1:]) | (np.diff(p) != 0)])
    first, last = _extended(ahead, back, i[head], p[head])
    later = ~head
    later[later] = (i + POWER * p)[later] > last[(np.cumsum(head) - 1)[later]]
    more = _extended(ahead, back, i[later], p[later])
    found = np.stack([np.concatenate([p[head], p[later]]), np.concatenate([first, more[0]]), np.concatenate([last, more[1]])], 1)
    long = found[:, 2] - found[:, 1] >= np.maximum(LEAST, POWER * found[:, 0])
    yield from map(tuple, np.unique(found[long], axis=0).tolist())


def find_runs(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(document, start, length, period)`` of all runs of at least POWER periods and LEAST words,
    in order, for documents that lie in ``codes`` from ``starts``."""
    docs = np.argsort(-sizes, kind="stable")
    docs = docs[sizes[docs] >= LEAST]
    flat, begins = _joined(codes, starts, sizes, docs)
    hit = np.zeros(len(docs), bool)
    for p, end in _periods(sizes[docs], begins):
        hit[np.searchsorted(begins, _alike(flat[:end], p), "right") - 1] = True
    docs = docs[hit]
    if not len(docs):
        return []
    flat, begins = _joined(codes, starts, sizes, docs)
    ahead, back = Extensions(flat), Extensions(np.ascontiguousarray(flat[::-1]))
    seen: set[tuple[int, int]] = set()
    found = []
    for p, a, b in _stretches(flat, ahead, back, _periods(sizes[docs], begins)):
        if (a, b) not in seen:  # else a smaller period has the same run
            seen.add((a, b))
            d = int(np.searchsorted(begins, a, "right")) - 1
            found.append((int(docs[d]), a - int(begins[d]), b - a, p))
    return sorted(found)


def tiled(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where the made-up repetition of a document begins and its period; none for most documents."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def periodic_runs(docs: DataFrame, planted: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the runs of its words and a digest of the text without them.

    A run is a stretch of words with smallest period q, at least 4 q and 6 words long, that
    cannot be extended. ``n_runs`` counts them; ``start``, ``length``, ``period`` and
    ``exponent_milli`` describe the longest (of equal ones the first, then that of the smallest
    period), or are null; ``runs_sha256`` is the digest of all as lines ``start,length,period``;
    ``collapsed_sha256`` that of the words outside the repetitions, joined by a space: of each run
    its first q words stay. With ``planted`` one document in ten, by CRC-32 of its id, first gets a
    repetition written over its end (see ``tiled``).

    A null or empty text has no words and no run; a null id stays null and nothing is planted
    there; repeated rows give repeated results; other columns are not read. There is no shuffle.
    The work is n log n in the words of a batch, also for a text of one word repeated.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _digested(batch.column(0), batch.column(1), planted)

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def _digested(ids: pa.Array, bodies: pa.Array, planted: bool) -> pa.RecordBatch:
    lists = pc.split_pattern_regex(bodies, GAPS)
    words = lists.flatten()
    real = pc.not_equal(words, "")
    ends = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))]).astype(np.int64)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    bounds = ends[offsets - offsets[0]]
    words = words.filter(real)
    starts, sizes = bounds[:-1], np.diff(bounds)
    source = np.arange(len(words))
    if planted:
        for d, doc_id in enumerate(ids.to_pylist()):
            if spot := tiled(doc_id, int(sizes[d])):
                a, p = spot
                source[starts[d] + a : bounds[d + 1]] = starts[d] + a + np.arange(sizes[d] - a) % p
    codes = words.dictionary_encode().indices.to_numpy().astype(np.int64)[source]
    runs: dict[int, list[tuple[int, int, int]]] = {}
    covered = np.zeros(len(codes) + 1, np.int64)
    for d, *run in find_runs(codes, starts, sizes):
        start, length, period = run
        runs.setdefault(d, []).append((start, length, period))
        covered[starts[d] + start + period] += 1
        covered[starts[d] + start + length] -= 1
    keep = np.cumsum(covered[:-1]) == 0
    left = np.concatenate([[0], np.cumsum(keep)])[bounds]
    kept = pa.ListArray.from_arrays(pa.array(left, pa.int32()), words.take(pa.array(source[keep])))
    joined = pc.binary_join(kept, " ").cast(pa.binary()).to_pylist()
    out = []
    for d, text in enumerate(joined):
        mine = runs.get(d, [])
        best = min(mine, key=lambda r: (-r[1], r[0], r[2]), default=None)
        four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in mine)
        out.append((len(mine), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(text).hexdigest()))
    columns = list(zip(*out)) if out else [()] * 7
    kinds = [pa.int64()] * 5 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(columns, kinds))], [f.split()[0] for f in SCHEMA.split(", ")])
