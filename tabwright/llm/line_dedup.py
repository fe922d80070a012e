"""Repeated passages of lines, found by content-defined chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabwright.llm.common import column, small_side, written

# A chunk of shorter lines ends after a line if the rolling hash over it and the line before is 0
# modulo this, so one line in three ends a chunk, and a passage is cut alike wherever it stands.
MODULUS = 3
LONG_WORDS = 50  # words of a line that is a chunk of its own


def _with_chunks(rows: DataFrame) -> DataFrame:
    """``lines`` and ``chunks`` (first line and last line, from 1, and whether it is one short line) of ``text``."""
    hashed = rows.withColumn("lines", F.split("text", "\n")).withColumn("hashes", F.transform("lines", lambda x: F.xxhash64(x)))
    # So many words take at least 2 * LONG_WORDS - 1 characters.
    hashed = hashed.withColumn("long", F.expr(f"transform(lines, x -> if(char_length(x) < {2 * LONG_WORDS - 1}, false, regexp_count(x, '[^ \\\\t-\\\\r]+') >= {LONG_WORDS}))"))
    rolling = (
        "filter(sequence(1, size(lines)), i -> i = size(lines) OR long[i - 1] OR long[i]"
        " OR (i > 1 AND NOT long[i - 2] AND pmod(xxhash64(hashes[i - 2], hashes[i - 1]), {m}) = 0))"
    )
    ended = hashed.withColumn("ends", F.expr(rolling.format(m=MODULUS)))
    spans = ended.withColumn("spans", F.expr("transform(ends, (e, k) -> struct(if(k = 0, 1, ends[k - 1] + 1) AS first, e AS last))"))
    chunk = "transform(spans, s -> struct(s.first AS first, s.last AS last, s.first = s.last AND NOT long[s.first - 1] AS short))"
    return spans.withColumn("chunks", F.expr(chunk)).drop("hashes", "long", "ends", "spans")


def _bodies(rows: DataFrame) -> DataFrame:
    """One row per chunk: ``(doc_id, text_key, first, last, alone, body, around)``.

    ``around`` holds the lines before and after a chunk of one short line, with the edges of the
    text told apart, and is empty for other chunks; ``alone`` is whether such a line has neighbours.
    """
    # No text is without chunks. A plain explode would filter on that, and work the nested lists out again for each line.
    chunks = _with_chunks(rows).select("doc_id", "text_key", "lines", F.explode_outer("chunks").alias("c"))
    first, last = F.col("c.first"), F.col("c.last")
    body = F.array_join(F.slice("lines", first, last - first + 1), "\n")
    before = F.when(first == 1, "^").otherwise(F.concat(F.lit("<"), F.try_element_at("lines", F.nullif(first - 1, F.lit(0)))))
    after = F.when(last == F.size("lines"), "$").otherwise(F.concat(F.lit(">"), F.try_element_at("lines", last + 1)))
    around = F.when(F.col("c.short"), F.concat(before, F.lit("\n"), after)).otherwise("")
    alone = F.col("c.short") & (F.size("lines") > 1)
    return chunks.select("doc_id", "text_key", first.alias("first"), last.alias("last"), alone.alias("alone"), body.alias("body"), around.alias("around"))


def repeated_chunks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text_key, spans)``: the line spans to remove, for rows that have any, as a written table."""
    text = column(text_col).cast("string")
    rows = docs.select(column(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text")).filter("text <> ''")
    places = _bodies(rows)
    digest = [F.xxhash64("body", "around").alias("digest"), (F.octet_length("body") + F.octet_length("around")).alias("size")]
    # Only digests move here. A chunk in a third of all documents is one row per task.
    repeated = written(places.select(*digest).groupBy("digest", "size").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "size"), "repeated")
    # The bytes of the chunks with a repeated digest are compared by grouping on them.
    same = written(places.withColumns({"digest": digest[0], "size": digest[1]}).join(small_side(repeated), ["digest", "size"]), "occurrences")
    first = F.min(F.struct("doc_id", "text_key", "first")).alias("kept")
    kept = written(same.groupBy("digest", "size", "body", "around").agg(first, F.count(F.lit(1)).alias("n")).filter("n > 1"), "kept")
    surplus = same.join(kept, ["digest", "size", "body", "around"]).filter(~(F.struct("doc_id", "text_key", "first").eqNullSafe(F.col("kept"))))
    found = surplus.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("first", "last", "alone"))).alias("spans"))
    # A short line goes only along with a chunk beside it; then spans that adjoin become one.
    beside = "(k > 0 AND spans[k - 1].last + 1 = s.first) OR (k + 1 < size(spans) AND s.last + 1 = spans[k + 1].first)"
    found = found.withColumn("spans", F.expr(f"filter(spans, (s, k) -> NOT s.alone OR {beside})")).filter("size(spans) > 0")
    firsts = "transform(filter(spans, (s, k) -> k = 0 OR spans[k - 1].last + 1 <> s.first), s -> s.first)"
    lasts = "transform(filter(spans, (s, k) -> k + 1 = size(spans) OR s.last + 1 <> spans[k + 1].first), s -> s.last)"
    return written(found.withColumn("spans", F.expr(f"zip_with({firsts}, {lasts}, (a, b) -> struct(a AS first, b AS last))")), "spans")


def _left_over(text: Column, spans: Column) -> Column:
    """The text without the spans, which are in order and apart: the stretches between them, joined."""
    count = F.size(spans)

    def stretch(lines: Column, k: Column) -> Column:
        begin = F.when(k == 0, 1).otherwise(F.try_element_at(spans, F.nullif(k, F.lit(0)))["last"] + 1)
        end = F.when(k == count, F.size(lines)).otherwise(F.try_element_at(spans, k + 1)["first"] - 1)
        return F.slice(lines, begin, end - begin + 1)

    # The outer list of one holds the lines, so that the text is split once and not for every stretch.
    kept = F.transform(F.array(F.split(text, "\n")), lambda lines: F.flatten(F.transform(F.sequence(F.lit(0), count), lambda k: stretch(lines, k))))
    return F.array_join(F.element_at(kept, 1), "\n")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows with their columns; repeated passages are taken out of ``text``. Adds ``lines`` and
    ``removed_lines``.

    The lines of a text are cut into chunks by their content; a line of LONG_WORDS words or more
    is a chunk of its own. A chunk that occurs more than once in the table, byte for byte, stays
    at its first place (least id, then text, then line) and is removed everywhere else. A chunk of
    one short line counts as the same only between the same two lines, and goes only if a chunk
    beside it goes, so a common line stands where its passage is new. Of texts that are equal
    as a whole, one-line ones included, the first stays whole as far as it is new. A text
    that loses all its lines becomes empty. A null text stays null and has 0 lines; an
    empty one has 1. Null ids come first in the order; rows that repeat both id and text
    share their result. ``lines`` and ``removed_lines`` replace columns of these names.
    """
    spans = repeated_chunks(docs, id_col, text_col).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.col("spans").alias("__spans"))
    text = column(text_col).cast("string")
    joined = docs.join(small_side(spans), column(id_col).cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__key")), "left")
    removed = F.coalesce(F.aggregate("__spans", F.lit(0), lambda n, s: n + s["last"] - s["first"] + 1), F.lit(0))
    new = {
        "lines": F.coalesce(F.size(F.split(text, "\n")), F.lit(0)), "removed_lines": removed,
        text_col: F.when(F.col("__spans").isNull(), column(text_col)).otherwise(_left_over(text, F.col("__spans"))),
    }
    own = [c for c in docs.columns if c not in ("lines", "removed_lines")]
    return joined.select(*[new[c].alias(c) if c in new else column(c) for c in own], new["lines"].alias("lines"), new["removed_lines"].alias("removed_lines"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The rows with repeated passages taken out, their columns as before and ``n_chars`` counted
    anew; rows that consisted of repeated passages alone are dropped.

    A null or empty text has no line that repeats, so its row stays as it is. Of repeated rows
    and of passages in texts that tie, the place with the least id stays, null first.
    """
    cleaned = dedup_lines(docs, id_col, text_col).filter((F.col("removed_lines") == 0) | column(text_col).rlike(r"\S"))
    names = {c: F.when(F.col("removed_lines") > 0, F.char_length(column(text_col)).cast("bigint")).otherwise(column(c)) if c == chars_col else column(c) for c in docs.columns}
    return cleaned.select(*[expr.alias(c) for c, expr in names.items()])
