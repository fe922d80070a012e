"""Train / validation / test split with exact sizes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwright.functions.columns import as_list, as_text, col, dtype, require_columns, row_hash
from tabwright.operators.base import Fitted, Transform
from tabwright.operators.quantiles import values_at_ranks

SPLIT_COLUMN = "split_assignment"
# Copies of one row are multiplied out by this many rows per task.
COPIES_PER_TASK = 1_000_000


def shuffle_key(df: DataFrame, key: list[str], seed: int) -> Column:
    """A seeded pseudo-random number per key: the leading 52 bits of an MD5, which a sketch
    holds exactly."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(as_text(c, dtype(df, c)), F.lit("")) for c in key])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint")


def tie_key(df: DataFrame) -> Column:
    """52 bits of the row hash, for rows with equal keys."""
    return F.shiftright(row_hash(df), 12)


@dataclass(frozen=True)
class TrainTestSplit(Transform):
    """Rows in the order of ``md5(seed|key)``: first train, then validation, then test.

    Only the two boundary keys are needed, so they are found by exact selection and the
    assignment is a comparison in the scan: no shuffle of the table and no global rank.
    """

    test_size: float = 0.2
    validation_size: float = 0.0
    random_state: int = 42
    order_by: list[str] | str | None = None

    def key(self, df: DataFrame) -> list[str]:
        names = as_list(self.order_by) or df.columns
        require_columns(df, names)
        return names

    def fit(self, df: DataFrame) -> Fitted:
        df = df.drop(SPLIT_COLUMN)  # an earlier label is replaced
        test, val = float(self.test_size), float(self.validation_size)
        if not 0 <= test <= 1 or not 0 <= val <= 1:
            raise ValueError(f"parts of {test} and {val}: each may be 0 or more and less than 1")
        if test + val >= 1:
            raise ValueError(f"parts of {test} and {val} leave nothing to train on")
        h1, h2 = shuffle_key(df, self.key(df), int(self.random_state)), tie_key(df)
        sizes = {}

        def cut_ranks(n: int) -> list[int]:
            if n < 5:
                raise ValueError("the table is too small to be split into these parts")
            sizes["n"], sizes["test"], sizes["val"] = n, round(n * test), round(n * val)
            sizes["train"] = n - sizes["test"] - sizes["val"]
            return [r for r in (sizes["train"], sizes["train"] + sizes["val"]) if r < n]

        _, at = values_at_ranks(df, {"h": h1}, cut_ranks)["h"] if df.columns else (0, {})
        if "n" not in sizes:
            raise ValueError("the table is too small to be split into these parts")
        cuts: list[list | None] = []
        known: dict[tuple[int, int], list] = {}
        for rank in (sizes["train"], sizes["train"] + sizes["val"]):
            if rank >= sizes["n"]:
                cuts.append(None)
                continue
            value, below, _ = at[rank]
            if (value, rank - below) not in known:
                known[value, rank - below] = self._cut(df, h1, h2, value, rank - below)
            cuts.append(known[value, rank - below])
        return {"train_rows": sizes["train"], "val_rows": sizes["val"], "test_rows": sizes["test"], "cuts": cuts}

    @staticmethod
    def _cut(df: DataFrame, h1: Column, h2: Column, value: int, before: int) -> list:
        """The first row behind the cut: its key hash, its row hash, how many rows with both
        hashes still lie before the cut, and how many there are.

        With a unique key the key hash settles it.
        """
        if before == 0:
            return [value, None, 0, 0]
        second, below, equal = values_at_ranks(df.filter(h1 == F.lit(value)), {"h": h2}, lambda n: [before])["h"][1][before]
        return [value, second, before - below, equal]

    def apply(self, df: DataFrame, fitted: Fitted) -> DataFrame:
        df = df.drop(SPLIT_COLUMN)
        h1, h2 = shuffle_key(df, self.key(df), int(self.random_state)), tie_key(df)
        train_cut, val_cut = fitted["cuts"]

        def before(cut: list | None) -> Column:
            if cut is None:
                return F.lit(True)
            value, second = cut[:2]
            first = h1 < F.lit(value)
            return first if second is None else first | ((h1 == F.lit(value)) & (h2 < F.lit(second)))

        label = F.when(before(train_cut), "train").when(before(val_cut), "val").otherwise("test")
        crowds = {(c[0], c[1]): c[3] for c in (train_cut, val_cut) if c and c[2]}
        if not crowds:
            return df.withColumn(SPLIT_COLUMN, label)
        # A cut goes through copies of one row: those copies are dealt out by number.
        inside = F.lit(False)
        for value, second in crowds:
            inside = inside | ((h1 == F.lit(value)) & (h2 == F.lit(second)))
        out = df.filter(~inside).withColumn(SPLIT_COLUMN, label)
        for (value, second), size in crowds.items():
            quota = [self._quota(c, (value, second), size) for c in (train_cut, val_cut)]
            out = out.unionByName(self._deal(df.filter((h1 == F.lit(value)) & (h2 == F.lit(second))), size, *quota))
        return out

    @staticmethod
    def _quota(cut: list | None, crowd: tuple[int, int], size: int) -> int:
        """How many rows of a crowd lie before a cut."""
        if cut is None:
            return size
        if (cut[0], cut[1]) == crowd:
            return cut[2]
        behind = cut[0] > crowd[0] or (cut[0] == crowd[0] and cut[1] is not None and cut[1] > crowd[1])
        return size if behind else 0

    @staticmethod
    def _deal(crowd: DataFrame, size: int, train: int, upto_val: int) -> DataFrame:
        """Number the copies of a row and label them by number.

        Copies are counted before the shuffle, so a third of the table travels as one row
        per task; they are multiplied out again in slices spread over many tasks.
        """
        counted = crowd.groupBy(*[col(c) for c in crowd.columns]).agg(F.count(F.lit(1)).alias("__n"))
        # Distinct rows that share two 64-bit hashes: one, so this window sees one row.
        earlier = Window.orderBy(*[col(c) for c in crowd.columns]).rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("__start", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))
        slices = -(-size // COPIES_PER_TASK)
        cut_up = counted.withColumn("__slice", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / F.lit(COPIES_PER_TASK)))))
        cut_up = cut_up.repartition(slices, "__slice")
        first = F.col("__slice") * F.lit(COPIES_PER_TASK)
        last = F.least(first + F.lit(COPIES_PER_TASK), F.col("__n")) - F.lit(1)
        rows = cut_up.withColumn("__i", F.explode(F.sequence(first, last)))
        number = F.col("__i") + F.col("__start")
        label = F.when(number < train, "train").when(number < upto_val, "val").otherwise("test")
        return rows.withColumn(SPLIT_COLUMN, label).select(*[col(c) for c in crowd.columns], SPLIT_COLUMN)
