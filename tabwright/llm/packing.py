"""Packing documents into token sequences: shortest pack first over the length histogram."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tabwright.llm.bpe import IdEncoder
from tabwright.llm.common import small_batches, texts
from tabwright.session import scratch_dir

END = 0  # the id that closes a document
TOKENS = "task int, row bigint, doc_id bigint, doc_tokens bigint, full bigint, full_rank bigint, rest int, rest_rank bigint, crcs array<bigint>, ids binary"


def tokenise(docs: DataFrame, tokenizer: str, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token ids per document, cut at multiples of ``size``, as a written table.

    ``full`` pieces of ``size`` tokens and a rest; ``full_rank`` and ``rest_rank`` number the
    full pieces, and the rests of one length, among those of the same task.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task, row, fulls, rests = IdEncoder(tokenizer), TaskContext.get().partitionId(), 0, 0, Counter()
        for batch in batches:
            made: list[list] = [[] for _ in range(9)]
            for text in batch.column(1).to_pylist():
                ids = np.append(encoder.encode(text), np.uint32(END)).astype("<u4")
                full, rest = divmod(len(ids), size)
                crcs = [zlib.crc32(ids[at : at + size].tobytes()) for at in range(0, len(ids), size)]
                for column, value in zip(made, (task, row, len(ids), full, fulls, rest, rests[rest], crcs, ids.tobytes())):
                    column.append(value)
                row, fulls, rests[rest] = row + 1, fulls + full, rests[rest] + 1
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            arrays = [pa.array(column, kind) for column, kind in zip(made, kinds)]
            yield pa.RecordBatch.from_arrays([*arrays[:2], batch.column(0), *arrays[2:]], ["task", "row", "doc_id", "doc_tokens", "full", "full_rank", "rest", "rest_rank", "crcs", "ids"])

    path = scratch_dir(spark, "tokens")
    texts(docs, id_col, text_col).mapInArrow(run, TOKENS).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(TOKENS).parquet(path)


@dataclass
class Plan:
    """Where pieces go, by their length and rank. Its size follows the lengths, not the documents."""

    size: int
    fulls: int  # full pieces that are sequences of their own
    first_filler: int  # rank of the first full piece that is cut to fill gaps
    slots: dict[int, tuple[list[int], list[int], list[int]]] = field(default_factory=dict)  # length: first ranks, first sequences, offsets
    gaps: list[tuple[int, int, int, int]] = field(default_factory=list)  # start in the stream of fillers, room, first sequence, offset
    filled: int = 0  # ids of the stream that lie in gaps
    tail: int = 0  # sequence of what is left of the stream
    opened: bool = False  # whether rests are fillers as well: their sequence is -1, their offset a place in the stream

    def cuts(self, begin: int, length: int) -> Iterator[tuple[int, int, int, int]]:
        """``(start, length, sequence, offset)`` of the cuts of a filler piece that begins there in the stream."""
        at, end = begin, begin + length
        while at < min(end, self.filled):
            start, room, sequence, offset = self.gaps[bisect_right(self.gaps, at, key=itemgetter(0)) - 1]
            number, within = divmod(at - start, room)
            part = min(room - within, end - at, self.filled - at)
            yield at - begin, part, sequence + number, offset + within
            at += part
        if at < end:
            yield at - begin, end - at, self.tail, at - self.filled


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[int, tuple[int, ...]]]:
    """``(packs, lengths)`` patterns. Lengths go longest first, each into the shortest open pack if
    it fits there, else into new packs; whole counts are placed at a time."""
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    totals: list[int] = []  # of the open packs, ascending

    def put(total: int, packs: int, pattern: tuple[int, ...]) -> None:
        if total not in open_packs:
            open_packs[total] = []
            insort(totals, total)
        open_packs[total].append((packs, pattern))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if not totals or totals[0] + length > size:
                put(length, left, (length,))
                break
            total = totals[0]
            packs, pattern = open_packs[total].pop()
            if not open_packs[total]:
                del open_packs[total]
                totals.pop(0)
            used = min(packs, left)
            if used < packs:
                put(total, packs - used, pattern)
            put(total + length, used, (*pattern, length))
            left -= used
    return [x for total in sorted(open_packs, reverse=True) for x in open_packs[total]]


def make_plan(histogram: dict[int, int], fulls: int, size: int) -> Plan:
    """Packing patterns of the rests, and gaps that full pieces are cut for.

    A pack that is neither full nor a power of two would be padded; documents may be cut
    anywhere, so as many full pieces as the gaps hold are cut to fill them. If there are too few, the
    emptiest packs are taken apart, and their rests are cut for the gaps of the others.
    """
    patterns = shortest_pack_first({k: n for k, n in histogram.items() if n}, size)
    room = {i: size - sum(p) for i, (_, p) in enumerate(patterns) if sum(p) & (sum(p) - 1)}
    wanted = sum(patterns[i][0] * r for i, r in room.items())
    fillers = min(fulls, -(-wanted // size))
    # Each pack that is taken apart closes its own gap and gives its ids: ``size`` in all.
    surplus = max(0, -(-(wanted - fillers * size) // size))
    apart: dict[int, int] = {}
    for i in sorted(room, key=room.get, reverse=True):
        apart[i] = min(surplus, patterns[i][0])
        surplus -= apart[i]
    wanted -= sum(n * room[i] for i, n in apart.items())
    stream = fillers * size
    plan = Plan(size, fulls - fillers, fulls - fillers, opened=any(apart.values()))
    sequence, taken, gap = plan.fulls, Counter(), 0

    def slot(length: int, packs: int, first: int, offset: int) -> None:
        ranks, sequences, offsets = plan.slots.setdefault(length, ([], [], []))
        ranks.append(taken[length])
        sequences.append(first)
        offsets.append(offset)
        taken[length] += packs

    for i, (packs, pattern) in enumerate(patterns):
        packs -= apart.get(i, 0)
        if packs:
            offset = 0
            for length in pattern:
                slot(length, packs, sequence, offset)
                offset += length
            if room.get(i):
                plan.gaps.append((gap, room[i], sequence, offset))
                gap += packs * room[i]
            sequence += packs
        if apart.get(i):
            for length in pattern:
                slot(length, apart[i], -1, stream)
                stream += apart[i] * length
    plan.filled = min(wanted, stream)
    plan.tail = sequence
    return plan


def _number(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(task, length, n, base)``: how many pieces of a length earlier tasks have; and the histogram."""
    rests = tokens.groupBy("task", F.col("rest").alias("length")).agg(F.count(F.lit(1)).alias("n")).filter("length > 0")
    fulls = tokens.groupBy("task").agg(F.sum("full").alias("n")).select("task", F.lit(-1).alias("length"), "n")
    counts = rests.unionByName(fulls)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), counts.groupBy("length").agg(F.sum("n").alias("n"))


def pack_tokens(tokens: DataFrame, size: int) -> DataFrame:
    """``(task, row, doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)`` per piece."""
    bases, lengths = _number(tokens)
    histogram = {r["length"]: r["n"] for r in lengths.collect()}  # at most ``size`` rows
    fulls = histogram.pop(-1, 0)
    plan = make_plan(histogram, fulls, size)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(rest: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64)
        lengths, ranks = rest.to_numpy(), rank.to_numpy()
        for length in np.unique(lengths):
            here = np.flatnonzero(lengths == length)
            firsts, sequences, offsets = (np.array(x, np.int64) for x in plan.slots[length])
            at = np.searchsorted(firsts, ranks[here], "right") - 1
            nth, filler = ranks[here] - firsts[at], sequences[at] < 0
            sequence[here], offset[here] = np.where(filler, -1, sequences[at] + nth), offsets[at] + filler * nth * length
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    names = ["task", "row", "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full_bases = bases.filter("length = -1").select("task", F.col("base").alias("full_base"), "n")
    narrow = tokens.select("task", "row", "doc_id", "doc_tokens", "full", "full_rank", "rest", "rest_rank", "crcs")
    # Full pieces: one sequence each, but for those that are cut.
    whole = (
        narrow.filter("full > 0").join(full_bases, "task")
        .select("task", "row", "doc_id", "doc_tokens", (F.col("full_base") + F.col("full_rank")).alias("rank"), F.posexplode(F.slice("crcs", F.lit(1), F.col("full"))).alias("k", "ids_crc32"))
        .withColumn("sequence_id", F.col("rank") + F.col("k"))
        .filter(F.col("sequence_id") < plan.fulls)
        .select("task", "row", "doc_id", (F.col("k").cast("bigint") * size).alias("start"), F.lit(size).cast("bigint").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", F.lit(0).cast("bigint").alias("offset"))
    )
    def placed(pieces: DataFrame) -> DataFrame:
        return pieces.filter("rest > 0").join(bases.select("task", F.col("length").alias("rest"), "base"), ["task", "rest"]).withColumn("p", place("rest", F.col("base") + F.col("rest_rank")))

    rest = placed(narrow).filter("p.sequence_id >= 0").select(
        "task", "row", "doc_id", (F.col("full") * size).alias("start"), F.col("rest").cast("bigint").alias("length"), F.try_element_at("crcs", F.lit(-1)).alias("ids_crc32"), "doc_tokens", "p.sequence_id", "p.offset"
    )
    made = whole.unionByName(rest)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cuts of the pieces that begin at ``first`` and later in their document, ``length`` ids each."""
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<u4")
                for k in range(r["pieces"]):
                    begin = r["stream"] + k * size
                    if begin < 0:  # a full piece before the first filler
                        continue
                    for start, length, sequence, offset in plan.cuts(begin, r["length"]):
                        at = r["first"] + k * size + start
                        row = (r["task"], r["row"], r["doc_id"], at, length, zlib.crc32(ids[at : at + length].tobytes()), r["doc_tokens"], sequence, offset)
                        for column, value in zip(rows, row):
                            column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "task" else pa.int64()) for c, n in zip(rows, names)], names)

    def fillers(pieces: DataFrame, first: Column, length: Column, number: Column, stream: Column) -> DataFrame:
        columns = [first.alias("first"), length.cast("bigint").alias("length"), number.cast("bigint").alias("pieces"), stream.alias("stream")]
        return pieces.select("task", "row", "doc_id", "doc_tokens", "ids", *columns).mapInArrow(cut, whole.schema)

    if plan.opened:
        opened = placed(tokens).filter("p.sequence_id < 0")
        made = made.unionByName(fillers(opened, F.col("full") * size, F.col("rest"), F.lit(1), F.col("p.offset")))
    if plan.fulls == fulls:
        return made
    # Fillers are the last full pieces; the filter on tasks lets the scan skip the other files.
    least = full_bases.filter(F.col("full_base") + F.col("n") > plan.first_filler).agg(F.min("task")).first()[0]
    rank = F.col("full_base") + F.col("full_rank")
    cut_up = tokens.filter((F.col("task") >= least) & (F.col("full") > 0)).join(full_bases, "task").filter(rank + F.col("full") > plan.first_filler)
    return made.unionByName(fillers(cut_up, F.lit(0).cast("bigint"), F.lit(size), F.col("full"), (rank - plan.first_filler) * size))


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: ``doc_id``, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    A document is its token ids and id 0, so a null or empty text is one id. Whole pieces of
    ``size`` ids are sequences; the rests are packed by the length histogram, and the gaps of
    packs that would be padded are filled with cuts of some whole pieces, or of the rests of some
    packs where whole pieces run out. Every id lies in one piece; one sequence at most is padded. Ids may
    be null or repeat: rows are told apart by task and row number. Other columns are not read.

    The driver sees one count per length. Ranks come from counts per task and length, so no
    length, however frequent, is ranked in one task.
    """
    return pack_tokens(tokenise(docs, tokenizer, size, id_col, text_col), size).drop("task", "row")


def sequences(tokens: DataFrame, pieces: DataFrame) -> DataFrame:
    """``(sequence_id, ids)``: the token ids of each sequence, little-endian 32 bit, unpadded."""
    cut = pieces.join(tokens.select("task", "row", "ids"), ["task", "row"]).select(
        "sequence_id", "offset", F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")).alias("ids")
    )
    parts = cut.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
