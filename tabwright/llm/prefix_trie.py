"""Prefix trie of conversations: sorted shards, and a skeleton of the paths between them."""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabwright.llm.common import column, small_batches, written
from tabwright.llm.mixing import WORD

DIGEST = 16  # bytes of the SHA-256 that stands for a turn
# Conversations whose ids share all but these bits are listed together, so a list is bounded.
BLOCK_BITS = 8
# Bytes of paths in one shard, and the most shards; sampled paths per shard, and the turns of a
# sampled path that a splitter keeps. These bound the skeleton, not the rows that are worked on.
SHARD_BYTES, MAX_SHARDS = 64 << 20, 8192
SAMPLED, SPLITTER_TURNS = 16, 64
OUT_ROWS = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODES = (
    "skeleton int, under int, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string, words bigint"
)
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversation_paths(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, turns)``: the turns of each conversation in order, each as a digest of role and
    text and the number of words of its text.

    Turns go by number, null first; turns of one number by role, then by the SHA-256 of role and
    text. Null role and text are empty; rows without a conversation id belong to none.
    """
    role, text = F.coalesce(column(role_col).cast("string"), F.lit("")), F.coalesce(column(text_col).cast("string"), F.lit(""))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    each = turns.filter(column(conv_col).isNotNull()).select(
        column(conv_col).cast("bigint").alias("conv_id"),
        F.struct(
            column(turn_col).cast("bigint").alias("turn"), role.alias("role"), F.unhex(F.sha2(named, 256)).alias("digest"),
            F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("words"),
        ).alias("t"),
    )
    ordered = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.expr(f"transform(t, x -> struct(substring(x.digest, 1, {DIGEST}) AS digest, x.words AS words))").alias("turns"))


def share_starts(paths: DataFrame, family: int = 20, most: int = 4) -> DataFrame:
    """Every conversation rebuilt: the first ``h`` turns of the first conversation of its family
    (ids that differ in their remainder by ``family``), then its own turns after its first ``h``;
    ``h`` is the CRC-32 of its id modulo ``most``. A family has no more than twice ``family``
    members, and ``most`` turns of its first one travel."""
    heads = paths.filter(F.col("conv_id") % F.lit(family) == 0).select(F.col("conv_id").alias("head"), F.slice("turns", 1, most - 1).alias("lead"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most)).cast("int")
    both = paths.select("conv_id", "turns", (F.col("conv_id") - F.col("conv_id") % F.lit(family)).alias("head"), h.alias("h")).join(heads, "head", "left")
    own = F.expr("slice(turns, h + 1, greatest(size(turns) - h, 0))")
    return both.select("conv_id", F.when(F.col("lead").isNull(), own).otherwise(F.concat(F.expr("slice(lead, 1, h)"), own)).alias("turns"))


class Skeleton:
    """The trie of the splitter paths; node 0 is the root."""

    def __init__(self, splitters: list[bytes]):
        self.child: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth = [-1], [0]
        for path in splitters:
            node = 0
            for at in range(0, len(path), DIGEST):
                step = (node, path[at : at + DIGEST])
                node = self.child.setdefault(step, len(self.parent))
                if node == len(self.parent):
                    self.parent.append(step[0])
                    self.depth.append(at // DIGEST + 1)


class _Node:
    """An open node. Counts of closed children are added up in it; children whose parent's
    smallest member is not yet known wait in it, unless it is a skeleton node."""

    __slots__ = ("skeleton", "low", "n", "kids", "leaves", "saved", "words", "ends", "waiting")

    def __init__(self, skeleton: int | None, words: int):
        self.skeleton, self.words = skeleton, words
        self.low: int | None = None
        self.n = self.kids = self.leaves = self.saved = 0
        self.ends = None
        self.waiting: list[tuple] = []

    def members(self, low: int, n: int) -> None:
        self.n += n
        if self.low is None or low < self.low:
            self.low = low


def _common(a: bytes, b: bytes) -> int:
    """Digests that two paths share from their start."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * DIGEST : middle * DIGEST] == b[low * DIGEST : middle * DIGEST]:
            low = middle
        else:
            high = middle - 1
    return low


class ShardTrie:
    """Nodes of a run of sorted paths, closed as soon as the next path leaves them."""

    def __init__(self, skeleton: Skeleton):
        self.skeleton = skeleton
        self.path = b""
        self.open = [_Node(0, 0)]
        self.rows: list[tuple] = []

    def add(self, path: bytes, words: str, ids: list[int]) -> None:
        if path != self.path:
            shared = _common(path, self.path)
            while len(self.open) > shared + 1:
                self._close()
            counts = words.split(",")
            for d in range(shared, len(path) // DIGEST):
                above = self.open[-1].skeleton
                step = None if above is None else self.skeleton.child.get((above, path[d * DIGEST : (d + 1) * DIGEST]))
                self.open.append(_Node(step, int(counts[d])))
            self.path = path
        node = self.open[-1]
        text = ",".join(map(str, ids))
        if node.ends is None:
            node.ends = hashlib.sha256(text.encode())
        else:
            node.ends.update(b"," + text.encode())
        node.members(min(ids), len(ids))

    def _close(self) -> None:
        node, depth = self.open.pop(), len(self.open)
        ends = node.ends.hexdigest() if node.ends else None
        if node.skeleton is not None:  # a partial count, to be added to those of other shards
            self.rows.append((node.skeleton, None, node.low, depth, None, node.n, node.kids, node.leaves, node.saved, ends, node.words))
            if self.open:
                self.open[-1].members(node.low, node.n)
            return
        above = self.open[-1]
        saved = node.saved + (node.n - 1) * node.words
        leaves = node.leaves if node.kids else 1
        self.rows += [(None, None, low, depth + 1, node.low, *rest, None) for low, *rest in node.waiting]
        above.members(node.low, node.n)
        above.kids, above.leaves, above.saved = above.kids + 1, above.leaves + leaves, above.saved + saved
        mine = (node.low, node.n, node.kids, leaves, saved, ends or NO_ENDS)
        if above.skeleton is None:
            above.waiting.append(mine)
        else:
            self.rows.append((None, above.skeleton, mine[0], depth, None, *mine[1:], None))

    def finish(self) -> None:
        """Close what is open, unless no path came."""
        if self.open[0].n or len(self.open) > 1 or self.open[0].ends:
            while self.open:
                self._close()


def _splitters(chunks: DataFrame, shards: int, rows: int) -> list[bytes]:
    """Paths that cut the sorted chunks into about equal shards, from a sample by hash of
    expected ``SAMPLED * shards`` paths, cut to their first ``SPLITTER_TURNS`` turns. The result of
    the trie does not depend on them."""
    parts = 1 << 30
    drawn = min(parts, parts * SAMPLED * shards // max(rows, 1))
    sample = chunks.filter(F.pmod(F.xxhash64("path", "block"), F.lit(parts)) < F.lit(drawn)).select(F.substring("path", 1, SPLITTER_TURNS * DIGEST).alias("path"))
    paths = sorted(bytes(r["path"]) for r in sample.collect())
    return sorted({paths[len(paths) * i // shards] for i in range(1, shards)}) if paths else []


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row per node of the trie of ``paths (conv_id, turns)``, from the root of depth 0.

    A node is a distinct sequence of first turns; its members are the conversations that start
    with it. ``conv_id`` is the smallest member, ``parent_conv_id`` that of the node one turn
    shorter, ``n_convs`` the members, ``n_children`` the nodes one turn longer, ``n_leaves`` the
    childless nodes at and below it, ``saved_tokens`` the words that sharing saves there (members
    but one, times the words of the last turn) and ``ends_sha256`` the SHA-256 of the ids, ascending
    and comma-joined, of the members that end there.

    Conversation ids are distinct. Conversations without turns are members of the root alone;
    equal conversations share all nodes; without conversations there is no node, not even a root.
    Other columns are not read.

    Paths are sorted in shards between sampled splitter paths. A node that starts no splitter
    path has all its members in one shard, which finishes it while it reads on; the others (the
    skeleton, broadcast as its splitters) get a partial count from each shard. Those are summed
    before and after a shuffle, and rolled up over the skeleton, at most ``MAX_SHARDS *
    SPLITTER_TURNS`` nodes. Ids of equal paths are listed in blocks of 256, so neither a task nor a
    row holds a group of copies, and their digest is taken as they stream by. One record holds
    the digests of one conversation (24 bytes a turn).
    """
    spark = paths.sparkSession
    small_batches(spark)
    listed = paths.select(
        "conv_id",
        F.unhex(F.array_join(F.expr("transform(turns, x -> hex(x.digest))"), "")).alias("path"),
        F.array_join(F.expr("transform(turns, x -> string(x.words))"), ",").alias("words"),
        F.shiftright("conv_id", BLOCK_BITS).alias("block"),
    )
    chunks = written(listed.groupBy("path", "words", "block").agg(F.array_sort(F.collect_list("conv_id")).alias("ids")), "paths")
    size = chunks.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("path") + F.octet_length("words") + F.lit(64)), F.lit(0)).alias("bytes")).first()
    shards = min(MAX_SHARDS, max(int(spark.conf.get("spark.sql.shuffle.partitions")), size["bytes"] // SHARD_BYTES + 1))
    cuts = spark.sparkContext.broadcast(_splitters(chunks, shards, size["rows"]))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [bisect_right(cuts.value, p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], [*batch.schema.names, "shard"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = ShardTrie(Skeleton(cuts.value))
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3))):
                trie.add(*row)
                if len(trie.rows) >= OUT_ROWS:
                    yield _batch(trie.rows)
                    trie.rows = []
        trie.finish()
        if trie.rows:
            yield _batch(trie.rows)

    shard = chunks.select("path", "words", "block", "ids").mapInArrow(numbered, "path binary, words string, block bigint, ids array<bigint>, shard int")
    ordered = shard.repartitionById(shards, F.col("shard")).sortWithinPartitions("path", "block")
    nodes = written(ordered.drop("shard").mapInArrow(local, NODES), "nodes")
    top = _rolled_up(nodes, Skeleton(cuts.value))
    skeleton = spark.createDataFrame(top, NODES)
    above = F.broadcast(skeleton.select(F.col("skeleton").alias("under"), F.col("conv_id").alias("above")))
    rest = nodes.filter("skeleton is null").join(above, "under", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above"))
    return rest.select(*RESULT).unionByName(skeleton.select(*RESULT))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.int64()] * 7, pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [f.split()[0] for f in NODES.split(", ")])


def _rolled_up(nodes: DataFrame, skeleton: Skeleton) -> list[tuple]:
    """Rows of the skeleton nodes: the reduced partial counts, and below them the skeleton's own."""
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = nodes.filter("skeleton is not null").groupBy("skeleton").agg(F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"), F.max("words").alias("words"))
    found = {r["skeleton"]: r.asDict() for r in parts.collect()}
    for i in sorted(found, key=skeleton.depth.__getitem__, reverse=True):
        r = found[i]
        if not r["n_children"]:
            r["n_leaves"] = 1
        r["saved_tokens"] += (r["n_convs"] - 1) * r["words"]
        if i:
            up = found[skeleton.parent[i]]
            for name, more in (("n_children", 1), ("n_leaves", r["n_leaves"]), ("saved_tokens", r["saved_tokens"])):
                up[name] += more
    return [
        (i, None, r["conv_id"], skeleton.depth[i], found[skeleton.parent[i]]["conv_id"] if i else None, r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"],
         r["ends_sha256"] or NO_ENDS, r["words"])
        for i, r in found.items()
    ]
