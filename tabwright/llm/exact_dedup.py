"""Exact duplicates, with frequent texts taken out of the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tabwright.llm.common import texts, written

# Frequent digests that are looked for, and counters of the sketch that finds them. Any text
# held by more than about one row in TRACKED is found; the winners are at most FREQUENT rows,
# so broadcasting them is bounded whatever the size of the table.
FREQUENT, TRACKED = 256, 4096


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Texts are equal when identical; of equal texts the row with the largest id stays, and of
    rows that also share that id one. Ids may be null (they lose against any id); a null text
    is empty, and empty texts are equal to each other; other columns are not read.

    Whole texts are read once, to be hashed; everything after works on digests. A frequent-items
    sketch of the Misra-Gries kind, merged from all tasks, names candidates. Their exact counts,
    largest ids and lengths are then aggregated (verified: one length and one second hash per
    digest), and the winners are broadcast, so rows of frequent texts are decided where they lie.
    The other digests are shuffled: their groups are summed before the shuffle and joined back,
    so no group is gathered in one task, however many copies the sketch left out.
    """
    digests = written(
        texts(docs, id_col, text_col).select(
            "doc_id", F.sha2("text", 256).alias("digest"), F.xxhash64("text").alias("check"), F.octet_length("text").alias("size"),
            F.monotonically_increasing_id().alias("row_no"),
        ),
        "digests",
    )
    best = F.max(F.struct("doc_id", "row_no"))
    sketch = digests.agg(F.expr(f"approx_top_k(digest, {FREQUENT}, {TRACKED})").alias("top"))
    candidates = sketch.select(F.explode("top").alias("t")).select(F.col("t.item").alias("digest"))
    found = (
        digests.join(F.broadcast(candidates), "digest")
        .groupBy("digest")
        .agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"), F.min("check").alias("c0"), F.max("check").alias("c1"), F.min("size").alias("s0"), F.max("size").alias("s1"))
        .filter("group_size > 1 AND c0 = c1 AND s0 = s1")
        .select("digest", "best", "group_size")
    )
    winners = written(found, "winners")
    frequent = digests.join(F.broadcast(winners), "digest")
    rare = digests.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    others = rare.join(rare.groupBy("digest").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size")), "digest")
    return frequent.select(others.columns).unionByName(others).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row_no") == F.col("best.row_no")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
