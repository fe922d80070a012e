"""Near duplicates: a multi-index Hamming join of b-bit MinHash signatures, and exact links."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabwright.llm.common import column, small_batches, small_side, texts, written
from tabwright.llm.components import components

WIDTH = 5  # words of a shingle
PERCENT = 85  # least share of common shingles, in hundredths, where the caller names none
# A signature has SYMBOLS symbols of 16 bits, cut into chunks. If fewer than two symbols for each
# chunk differ, some chunk differs in at most one: so every pair within that distance agrees, in
# some chunk, on all symbols but one, and shares the key made of these. Two sets with exactly the
# least share of shingles exceed the distance with a probability of at most MISSED.
SYMBOLS, MISSED = 40, 0.0002
CHUNK_WIDTHS = (8, 5, 4, 3)
# A bucket or group is worked on in pairs of blocks of at most this many members or shingles.
BLOCK_MEMBERS, BLOCK_SHINGLES = 8192, 4_000_000
WORDS_AT_ONCE = 100_000


def scheme(percent: int) -> tuple[int, int]:
    """``(chunk width, distance)`` that find pairs of this share: the widest chunks, which have the
    fewest chance members, and then the least distance."""
    if not 1 <= percent <= 100:
        raise ValueError("percent must be between 1 and 100")

    def missed(distance: int) -> float:
        p = 1 - percent / 100
        return sum(comb(SYMBOLS, k) * p**k * (1 - p) ** (SYMBOLS - k) for k in range(distance + 1, SYMBOLS + 1))

    for width in CHUNK_WIDTHS:
        if missed(most := 2 * (SYMBOLS // width) - 1) <= MISSED:
            return width, next(d for d in range(most + 1) if missed(d) <= MISSED)
    raise ValueError(f"Signatures of {SYMBOLS} symbols do not find pairs of {percent} %")


CHUNK_WIDTH, DISTANCE = scheme(PERCENT)

_random = np.random.default_rng(20_240_229)
BYTE_CODES = _random.integers(0, 1 << 64, 256, np.uint64)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PLACES = _random.integers(0, 1 << 64, WIDTH, np.uint64) | np.uint64(1)
FACTORS = _random.integers(0, 1 << 64, SYMBOLS, np.uint64) | np.uint64(1)
SHIFTS = _random.integers(0, 1 << 64, SYMBOLS, np.uint64)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, base in enumerate((BASE, BASE_INVERSE)):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def word_hashes(words: list[bytes]) -> np.ndarray:
    out = []
    for at in range(0, len(words), WORDS_AT_ONCE):
        part = words[at : at + WORDS_AT_ONCE]
        data = np.frombuffer(b"".join(part), np.uint8)
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(sizes)
        powers, inverse = _power(len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODES[data] * powers[: len(data)], dtype=np.uint64)])
        starts = ends - sizes
        out.append(mix((sums[ends] - sums[starts]) * inverse[starts] + sizes.astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: str) -> np.ndarray:
    """64-bit hashes of the distinct shingles of a text, ascending. Words are what stands between
    ASCII white space, with A-Z in lower case; fewer than WIDTH words are one shingle."""
    words = word_hashes(text.encode("utf-8", "surrogatepass").lower().split())
    if not len(words):
        return words
    n = max(1, len(words) - WIDTH + 1)
    made = np.full(n, np.uint64(min(len(words), WIDTH)), np.uint64)
    for k in range(min(WIDTH, len(words))):
        made += words[k : k + n] * PLACES[k]
    return np.unique(mix(made))


def signature(hashes: np.ndarray) -> np.ndarray:
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 8192):
        least = np.minimum(least, (hashes[None, at : at + 8192] * FACTORS[:, None] + SHIFTS[:, None]).min(axis=1))
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def chunk_keys(signatures: np.ndarray, width: int = CHUNK_WIDTH) -> np.ndarray:
    """``[row, chunk * width + error]``: the key of a chunk with one symbol left out."""
    keys = np.empty((len(signatures), SYMBOLS // width * width), np.uint64)
    for i in range(keys.shape[1]):
        chunk = i // width * width
        packed = np.full(len(signatures), np.uint64(i), np.uint64)
        for k in range(chunk, chunk + width):
            if k != i:
                packed = packed * BASE + mix(signatures[:, k].astype(np.uint64) + np.uint64(1))
        keys[:, i] = mix(packed)
    return keys.view(np.int64)


def read_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, text_key, n, node, signature)``: ``node`` is a hash of the whole set, so documents
    with equal sets are one node."""
    source = texts(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, signatures = [], [], []
            for text in batch.column(1).to_pylist():
                hashes = shingles(text)
                sizes.append(len(hashes))
                nodes.append(int(mix(np.array([mix(hashes).sum(dtype=np.uint64) + np.uint64(len(hashes))], np.uint64)).view(np.int64)[0]) if len(hashes) else None)
                signatures.append(signature(hashes).tobytes() if len(hashes) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(signatures, pa.binary())],
                ["doc_id", "text_key", "n", "node", "signature"],
            )

    return source.mapInArrow(run, "doc_id bigint, text_key bigint, n bigint, node bigint, signature binary")


def in_blocks(members: DataFrame, key: str, blocks: str, node: str = "node") -> DataFrame:
    """Rows for every pair of blocks of a key: ``(…, b0, b1)``; one pair where a key has one block."""
    own = F.pmod(F.xxhash64(F.col(node)), F.col(blocks))
    paired = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(blocks) - 1)))
    return paired.withColumns({"b0": F.least("own", "other"), "b1": F.greatest("own", "other")}).drop("own", "other", blocks)


def linked_within(rows: DataFrame, key: str, value: str, spread: Callable[[list[bytes], np.ndarray], Iterator[tuple[int, int]]], pairs: Callable | None = None) -> DataFrame:
    """Links ``(a, b)`` that span the connected members of each ``(key, b0, b1)``.

    Rows are dealt and sorted by the key; ``spread`` gets the values of one key at a time. With
    ``pairs`` keys of two members, by far the most, are decided together.
    """
    dealt = rows.select(key, "b0", "b1", "node", value).repartition(key, "b0", "b1").sortWithinPartitions(key, "b0", "b1", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(table: pa.Table) -> pa.RecordBatch:
            keys = np.stack([table.column(i).to_numpy().astype(np.int64) for i in range(3)])
            nodes, values = table.column(3).to_numpy(), table.column(4)
            edges = np.flatnonzero(np.concatenate([[True], (keys[:, 1:] != keys[:, :-1]).any(axis=0), [True]]))
            sizes = np.diff(edges)
            a, b = [], []
            if pairs is not None and (two := edges[:-1][sizes == 2]).size:
                whole = values.combine_chunks()
                whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
                near = pairs(whole, two)
                a.append(nodes[two[near]])
                b.append(nodes[two[near] + 1])
            for start, size in zip(edges[:-1][sizes > (2 if pairs is not None else 1)], sizes[sizes > (2 if pairs is not None else 1)]):
                found = np.array(list(spread(values.slice(start, size).to_pylist(), nodes[start : start + size])), np.int64).reshape(-1, 2)
                a.append(nodes[start + found[:, 0]])
                b.append(nodes[start + found[:, 1]])
            none = np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])

        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = [tuple(batch.column(i)[j].as_py() for i in range(3)) for j in (0, batch.num_rows - 1)]
            if held and ends[0] == last and ends[1] == last:
                held.append(batch)
                continue
            # Hold back the rows of the last key: the next batch may go on with it.
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            cut = int(np.flatnonzero((keys != keys[:, -1:]).any(axis=0))[-1]) + 1 if ends[0] != ends[1] else 0
            done = pa.Table.from_batches([*held, batch.slice(0, cut)]) if held or cut else None
            if done is not None and done.num_rows:
                yield links(done)
            held, last = [batch.slice(cut)], ends[1]
        if held:
            yield links(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "a bigint, b bigint")


def near_pairs(values: pa.Array, firsts: np.ndarray, distance: int) -> np.ndarray:
    table = np.frombuffer(b"".join(values.to_pylist()), np.uint16).reshape(-1, SYMBOLS)
    return (table[firsts] != table[firsts + 1]).sum(axis=1) <= distance


def near_links(values: list[bytes], nodes: np.ndarray, distance: int) -> Iterator[tuple[int, int]]:
    """A forest over the members that are connected by signatures within the distance. A member
    reached from another is not compared with the members reached before, so a bucket of alike
    members takes one comparison each."""
    table = np.frombuffer(b"".join(values), np.uint16).reshape(-1, SYMBOLS)
    open_rows = np.arange(len(table))
    while len(open_rows):
        front, open_rows = [open_rows[0]], open_rows[1:]
        while front and len(open_rows):
            at = front.pop()
            near = (table[open_rows] != table[at]).sum(axis=1) <= distance
            for other in open_rows[near]:
                yield at, other
            front.extend(open_rows[near])
            open_rows = open_rows[~near]


def exact_links(values: list[bytes], nodes: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """The same forest for sets with ``percent`` hundredths of their union in common."""
    sets = [np.frombuffer(v, np.uint64) for v in values]
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    codes = np.unique(flat, return_inverse=True)[1]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    own = [codes[begins[i] : begins[i + 1]] for i in range(len(sets))]
    mark = np.zeros(codes.max() + 1, bool)
    open_rows = np.arange(len(sets))
    open_codes, open_begins = codes, begins[:-1]
    while len(open_rows):
        front, open_rows, drop = [open_rows[0]], open_rows[1:], np.ones(len(open_rows), bool)
        drop[0] = False
        open_codes, open_begins = _without(open_codes, open_begins, drop)
        while front and len(open_rows):
            at = front.pop()
            mark[own[at]] = True
            common = np.add.reduceat(mark[open_codes], open_begins, dtype=np.int64)
            mark[own[at]] = False
            near = 100 * common >= percent * (sizes[open_rows] + sizes[at] - common)
            if near.any():
                for other in open_rows[near]:
                    yield at, other
                front.extend(open_rows[near])
                open_codes, open_begins = _without(open_codes, open_begins, ~near)
                open_rows = open_rows[~near]


def _without(codes: np.ndarray, begins: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.diff(np.concatenate([begins, [len(codes)]]))
    left = sizes[keep]
    return codes[np.repeat(keep, sizes)], np.concatenate([[0], np.cumsum(left)])[:-1].astype(np.int64)


def candidate_links(nodes: DataFrame, percent: int) -> DataFrame:
    """Links that connect all nodes with signatures within the distance for ``percent``, from
    ``(node, signature)``."""
    width, distance = scheme(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
            if len(table):
                keys = chunk_keys(table, width)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), keys.shape[1]))], ["key", "node"])

    keys = nodes.select("node", "signature").mapInArrow(run, "key bigint, node bigint")
    shared = written(keys.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "buckets")
    members = written(keys.join(shared, "key"), "members").withColumn("blocks", F.ceil(F.col("members") / BLOCK_MEMBERS))
    rows = in_blocks(members.select("key", "blocks", "node").join(nodes.select("node", "signature"), "node"), "key", "blocks")
    return linked_within(rows, "key", "signature", partial(near_links, distance=distance), partial(near_pairs, distance=distance))


def link_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """The written table of sets, and ``(node, component_id)`` of all nodes."""
    small_batches(docs.sparkSession)
    sets = written(read_sets(docs, id_col, text_col), "sets")
    nodes = written(
        sets.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_key")).alias("source"), F.max("n").alias("n"), F.max("signature").alias("signature")), "nodes"
    )
    groups = written(components(candidate_links(nodes, percent)), "groups")
    # Whole sets of the nodes that have a candidate, read again from one text of each node.
    wanted = groups.join(nodes, "node").select("node", "label", "n", F.col("source.doc_id").alias("w_id"), F.col("source.text_key").alias("w_key"))
    weights = wanted.groupBy("label").agg(F.sum("n").alias("shingles"), F.count(F.lit(1)).alias("members"))
    blocks = F.greatest(F.ceil(F.col("shingles") / BLOCK_SHINGLES), F.ceil(F.col("members") / BLOCK_MEMBERS))
    wanted = written(wanted.join(weights, "label").select("node", "label", "w_id", "w_key", blocks.alias("blocks")), "wanted")
    source = texts(docs, id_col, text_col).withColumn("text_key", F.xxhash64("text"))
    found = source.join(small_side(wanted), (source["text_key"] == wanted["w_key"]) & source["doc_id"].eqNullSafe(wanted["w_id"])).select("label", "blocks", "node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = pa.array([shingles(t).tobytes() for t in batch.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), hashes], ["label", "blocks", "node", "hashes"])

    whole = in_blocks(found.mapInArrow(run, "label bigint, blocks bigint, node bigint, hashes binary"), "label", "blocks")
    linked = components(linked_within(whole, "label", "hashes", partial(exact_links, percent=percent)))
    linked = written(linked.withColumnRenamed("label", "component"), "components")
    least = linked.join(nodes, "node").groupBy("component").agg(F.min("least_id").alias("component_id"))
    joined = linked.join(least, "component").select("node", "component_id")
    every = nodes.select("node", "least_id").join(joined, "node", "left").select("node", F.coalesce("component_id", "least_id").alias("component_id"))
    return sets, written(every, "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``.

    Documents are linked if their shingle sets have ``percent`` hundredths of their union in common;
    ``component_id`` is the least id reachable over links, and the document of that id is kept.
    A null or empty text, or one without words, has no shingles and no links. Rows with equal
    sets are one node from the start, so copies cost nothing. A null id loses against any id;
    rows that repeat an id and a text share their result; other columns are not read.

    Candidates come from the signatures by chunk keys with one error (see SYMBOLS); they connect
    nodes into groups, and within each group links are decided on the whole sets. Buckets and
    groups are worked on in pairs of blocks, so none is held whole if it is large.
    """
    sets, classes = link_classes(docs, id_col, text_col, percent)
    labelled = sets.join(classes, "node", "left")
    component = F.coalesce("component_id", F.when(F.col("n") == 0, F.col("doc_id")))
    return labelled.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows without near duplicates: of each component the document with the least id, and of
    rows that share this id and its set all; columns are unchanged."""
    sets, classes = link_classes(docs, id_col, text_col, percent)
    dropped = written(
        sets.join(classes, "node").filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct(), "dropped"
    )
    body = F.coalesce(column(text_col).cast("string"), F.lit(""))
    return docs.join(small_side(dropped), column(id_col).cast("bigint").eqNullSafe(F.col("__id")) & (F.xxhash64(body) == F.col("__key")), "left_anti")
