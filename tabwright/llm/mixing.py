"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabwright.llm.common import column, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SEED = 17
KEY_BITS = 60
ROW_BITS = 33  # monotonically_increasing_id: task number above, row number below


def _cells(rows: int) -> int:
    """Stretches that an order of ``rows`` rows is cut into: their number and the rows in each
    grow with the square root."""
    return max(1, math.isqrt(max(rows - 1, 0)) + 1)


def _words(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Sizes in words and the shuffling key of every row; texts go no further."""
    name = column(source_col).cast("string")
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(column(id_col).cast("string"), F.lit("null"))))
    return docs.select(
        column(id_col).cast("bigint").alias("doc_id"),
        F.coalesce(F.regexp_count(column(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        F.coalesce(name, F.lit("")).alias("src"),
        name.isNull().alias("no_src"),
        F.conv(F.substring(key, 1, KEY_BITS // 4), 16, 10).cast("bigint").alias("key"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def _weighted(sizes: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Sources with their place by code point, null last, and their weight.

    Places come from a range sort: a task numbers its own sources, and only the counts per task
    are summed, so the number of sources does not matter.
    """
    ordered = written(
        sizes.repartitionByRange("no_src", "src").sortWithinPartitions("no_src", "src").withColumn("at", F.monotonically_increasing_id()), "sources"
    ).withColumn("task", F.shiftright("at", ROW_BITS))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    tasks = ordered.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    tasks = tasks.select("task", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.col("base") + F.col("at") - F.col("first")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + F.lit(1)).cast("int"))
    return ordered.join(F.broadcast(tasks), "task").select("src", "no_src", "source_size", place.alias("place"), weight.alias("weight"))


def _level(sources: DataFrame, budget: float, passes: int) -> tuple[float, float]:
    """``(words, weight)`` left once every source that its share would take beyond ``passes``
    times its size stands at that limit; one aggregation per resharing."""
    total = sources.agg(F.sum("weight")).first()[0] or 0.0
    words, weight = budget, total
    while weight:
        over = _over(F.lit(words), F.lit(weight), passes)
        r = sources.agg(F.coalesce(F.sum(F.when(over, F.col("source_size") * F.lit(passes))), F.lit(0)).alias("capped"), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)).alias("rest")).first()
        if r["rest"] == weight:
            break
        words, weight = budget - r["capped"], r["rest"]
    return words, weight


def _over(words: Column, weight: Column, passes: int) -> Column:
    return F.col("weight") * words / weight > F.lit(passes) * F.col("source_size")


def _targets(sources: DataFrame, budget: float, passes: int) -> DataFrame:
    words, weight = _level(sources, budget, passes)
    full = (F.lit(passes) * F.col("source_size")).cast("double")
    share = F.col("weight") * F.lit(words) / F.lit(weight or 1.0)
    target = F.when(_over(F.lit(words), F.lit(weight), passes), full).otherwise(share) if weight else full
    return sources.select("src", "no_src", "place", "source_size", target.alias("target"))


def _placed(rows: DataFrame, weights: Sequence[float], share: float, passes: int) -> tuple[DataFrame, int]:
    """Rows with the target of their source and the words up to their end in its shuffled order; the budget."""
    cells = _cells(rows.count())
    rows = rows.withColumn("cell", F.shiftright(F.shiftright("key", 30) * F.lit(cells), 30))
    groups = written(rows.groupBy("src", "no_src", "cell").agg(F.sum("size").alias("words")), "cells")
    sizes = groups.groupBy("src", "no_src").agg(F.sum("words").alias("source_size"))
    sources = written(_weighted(sizes, weights), "weights")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    before = Window.partitionBy("src", "no_src").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.join(_targets(sources, share * total, passes), ["src", "no_src"]).withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    inside = Window.partitionBy("src", "no_src", "cell").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(starts.drop("words"), ["src", "no_src", "cell"]).select(
        "row_no", "doc_id", "size", "place", "source_size", "target", (F.col("before") + F.sum("size").over(inside)).alias("upto")
    )
    return written(placed, "placed"), int(share * total)


def _served(placed: DataFrame, budget: int, passes: int) -> DataFrame:
    """The mix: ``(row_no, doc_id, source place, pass, finish, start, words)``, cut at the budget."""
    limit = F.ceil("target")
    begun = F.col("pass") * F.col("source_size") + F.col("upto") - F.col("size")
    words = F.least(F.col("size"), limit - begun)
    queue = (
        placed.filter("size > 0 and target > 0")
        .select("*", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("pass"))
        .select("row_no", "doc_id", "place", "pass", words.alias("words"), begun.alias("begun"), (F.least(begun + F.col("size"), limit) / F.col("target")).alias("finish"))
        .filter("words > 0")
    )
    cells = _cells(placed.count())
    queue = written(queue.withColumn("cell", F.least(F.floor(F.col("finish") * F.lit(cells)), F.lit(cells))), "queue")
    sums = queue.groupBy("cell").agg(F.sum("words").alias("cell_words"))
    before = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # a square root of rows
    starts = sums.select("cell", F.coalesce(F.sum("cell_words").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("cell").orderBy("finish", "place", "begun").rowsBetween(Window.unboundedPreceding, 0)
    start = F.col("before") + F.sum("words").over(inside) - F.col("words")
    served = queue.join(starts, "cell").select("row_no", "doc_id", "place", "pass", "finish", start.alias("start"), "words")
    return served.withColumn("words", F.least("words", F.lit(budget) - F.col("start"))).filter("words > 0")


def mix(
    docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.5, passes: int = 2, seed: int = SEED,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """The order in which documents are to be read, and one row per document.

    The order is ``(doc_id, source place, pass, finish, start, words)``: ``start`` is the number
    of words before a document, ``words`` what is taken of it. The second table is ``doc_id``,
    ``size``, ``source_size``, ``target`` and ``taken``.

    Sources by code point, null last, take ``weights`` in turn and share ``share`` times all
    words; a source stops at ``passes`` times its size, and what it leaves is shared anew by
    weight. Within a source, documents stand in the order of a seeded digest of their id, one
    pass after the other. A document's virtual finish time is the words of its source up to its
    end, divided by the source's target. All documents are sorted by that time, in ranges, and
    cut at the budget, so every source advances at its weight at each point of the mix. The
    document that a source has in service at its target is cut there, so a source is off by no
    more than one word and the few that rounding up leaves beyond the budget.

    A null text or one without words has size 0 and is never taken; a source of such texts has
    target 0. A null id is kept and shuffled as such; rows that repeat id and size are ordered
    arbitrarily among themselves, which changes no multiset of rows; an empty table has no mix; other
    columns are not read.

    Native: texts are read once, to be counted. Both running sums, that of a source and that of
    the whole queue, go over stretches whose number is a square root of the rows (drawn from
    the uniform digest, and from virtual time, in which words arrive evenly), so a source with
    a third of all rows is spread over many tasks.
    """
    rows = written(_words(docs, id_col, text_col, source_col, seed), "words")
    placed, budget = _placed(rows, weights, share, passes)
    served = written(_served(placed, budget, passes), "mix")
    kept = ["row_no", "doc_id", "size", "source_size", "target"]
    none = placed.select(*kept, F.lit(0).cast("bigint").alias("words"))
    # Both sides know row_no only from the same written table; the sum needs no join.
    both = none.unionByName(served.select("row_no", "words"), allowMissingColumns=True)
    whole = both.groupBy("row_no").agg(*[F.max(c).alias(c) for c in kept[1:]], F.sum("words").alias("taken"))
    order = served.drop("row_no")
    return order, whole.select("doc_id", "size", "source_size", "target", "taken")
