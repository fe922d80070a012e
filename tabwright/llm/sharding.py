"""Shards of nearly equal bytes that keep equal texts together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from tabwright.llm.common import texts, written

# Groups stand in the order of a 60-bit key drawn from a text's digest.
KEY_BITS, FIRST_BITS, STEP_BITS = 60, 16, 12
ROW_BITS = 33  # monotonically_increasing_id: task number above, row number below
LAW = "bytes"


class Cells:
    """Consecutive stretches of the key order with their bytes; some hold one group, others many.

    The driver holds at most 2**FIRST_BITS of them and 2**STEP_BITS more for each one that a
    cut falls into, whatever the number of groups.
    """

    def __init__(self, rows: list[tuple[int, int, int, int]]):
        rows = sorted(rows)  # first key, bits of the stretch, bytes, groups
        self.key = [r[0] for r in rows]
        self.bits = [r[1] for r in rows]
        self.size = np.array([r[2] for r in rows], np.int64)
        self.groups = np.array([r[3] for r in rows], np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int64)
        self.total = int(self.ends[-1])

    def cell(self, position: int) -> int:
        return int(np.searchsorted(self.ends, position, "right")) - 1

    def inside(self, position: int) -> bool:
        """Whether a position lies within a stretch of several groups, where a cut is not yet known to exist."""
        j = self.cell(position)
        return position < self.total and self.ends[j] != position and self.groups[j] > 1

    def down(self, position: int) -> int:
        """The last possible cut at or before a position."""
        if position >= self.total:
            return self.total
        return position if self.inside(position) else int(self.ends[self.cell(position)])

    def up(self, position: int) -> int:
        if position <= 0 or position >= self.total or self.inside(position):
            return max(0, min(position, self.total))
        j = self.cell(position)
        return position if self.ends[j] == position else int(self.ends[j + 1])

    def greedy(self, capacity: int, shards: int) -> list[int] | None:
        """Cuts of shards filled in order as far as the capacity allows; none if that takes more shards."""
        cuts, start = [], 0
        for _ in range(shards):
            end = self.down(start + capacity)
            if end == start and start < self.total:
                return None
            cuts.append(end)
            start = end
        return cuts if start >= self.total else None

    def smallest(self, shards: int) -> int:
        low, high = -(-self.total // shards), self.total
        while low < high:
            middle = (low + high) // 2
            if self.greedy(middle, shards) is None:
                low = middle + 1
            else:
                high = middle
        return low

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """Cuts within the capacity, each as near as possible to an equal share of what is left."""
        latest = [self.total]  # least start from which so many shards hold the rest
        for _ in range(shards):
            latest.append(self.up(latest[-1] - capacity))
        found, start = [], 0
        for left in range(shards, 1, -1):
            aim = start + (self.total - start) // left
            below, above = self.down(aim), self.up(aim)
            cut = below if aim - below <= above - aim else above
            start = max(start, min(max(cut, latest[left - 1]), self.down(start + capacity)))
            found.append(start)
        return found


def _cells(groups: DataFrame, bits: int, within: tuple[int, list[int]] | None = None) -> list[tuple[int, int, int, int]]:
    part = groups if within is None else groups.filter(F.shiftright("key", within[0]).isin(within[1]))
    rows = part.groupBy(F.shiftright("key", bits).alias("k")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    return [(r["k"] << bits, bits, r["size"], r["n"]) for r in rows]


def cut_keys(groups: DataFrame, shards: int) -> list[int]:
    """Keys at which shards 1, 2, ... begin: a minimax partition of ``groups (key, size)`` in key order.

    The capacity is found by binary search, with a greedy check over stretches of keys; the
    stretches that a cut falls into are opened further until every cut lies between groups.
    """
    rows = _cells(groups, KEY_BITS - FIRST_BITS)
    while True:
        cells = Cells(rows)
        capacity = cells.smallest(shards)
        cuts = cells.cuts(capacity, shards)
        touched = {cells.cell(p) for p in cuts + (cells.greedy(capacity, shards) or []) if cells.inside(p)}
        if not touched:
            return [cells.key[cells.cell(p)] if p < cells.total else 1 << KEY_BITS for p in cuts]
        kept = [r for j, r in enumerate(sorted(rows)) if j not in touched]
        for bits in {cells.bits[j] for j in touched}:
            opened = [cells.key[j] >> bits for j in touched if cells.bits[j] == bits]
            kept += _cells(groups, max(0, bits - STEP_BITS), (bits, opened))
        rows = kept


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``size`` (UTF-8 bytes of the text and 8), ``text_crc32``,
    ``law``, ``shard``, ``slot`` (0, 1, ... in each shard) and ``grown_shard``.

    Law ``bytes``: the largest shard is as small as whole groups of equal texts in the order of
    their digests allow, and the cuts are then drawn as evenly as that capacity permits. With
    fewer groups than shards some stay empty. A null text has size 8 and equals the empty one;
    a null id is kept; repeated rows get slots of their own; other columns are not read.

    Texts are read once. Groups are summed before the shuffle, a row's shard is a comparison
    with the cut keys, and slots come from the row numbers of each task, so no text and no
    whole group moves.
    """
    rows = written(
        texts(docs, id_col, text_col).select(
            "doc_id", (F.octet_length("text") + F.lit(8)).cast("bigint").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
            F.conv(F.substring(F.sha2("text", 256), 1, KEY_BITS // 4), 16, 10).cast("bigint").alias("key"),
        ),
        "sizes",
    )
    groups = written(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    starts = cut_keys(groups, shards)
    number = sum((F.when(F.col("key") >= F.lit(k), 1).otherwise(0) for k in starts), F.lit(0))
    placed = written(
        rows.withColumn("shard", number.cast("int")).sortWithinPartitions("shard", "doc_id").withColumn("row_no", F.monotonically_increasing_id()), "placed"
    ).withColumn("task", F.shiftright("row_no", ROW_BITS))
    before = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        placed.groupBy("task", "shard")
        .agg(F.min("row_no").alias("first"), F.count(F.lit(1)).alias("n"))
        .select("task", "shard", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    return placed.join(runs, ["task", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard",
        (F.col("base") + F.col("row_no") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
