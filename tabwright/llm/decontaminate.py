"""Benchmark decontamination: BM25 with block-max WAND, then exact overlap."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, functions as F

from tabwright.llm.common import column, small_batches, texts

K1, B = 1.2, 0.75
# Share of an item's own score that a passage must reach to be looked at.
THRESHOLD = 0.5
WIDTH, OVERLAP = 5, 0.8  # words of a shingle; share of an item's shingles that is a leak
BLOCK = 8  # postings of a block
ITEM_BLOCK = 4  # items whose largest impacts are summed before a passage is searched
BOUNDS_AT_ONCE = 2_000_000  # bounds of (passage, block of items) held at a time
# Bytes of benchmark texts in one index; a larger benchmark is worked through in parts.
INDEX_BYTES = 32 << 20
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"[^.!?]*[.!?]*")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def shingles(parts: list[str]) -> set[tuple[str, ...]]:
    return {tuple(parts[k : k + WIDTH]) for k in range(max(1, len(parts) - WIDTH + 1))} if parts else set()


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The words of all sentences but the last, and of the last; a single sentence is halved."""
    sentences = [w for s in SENTENCE.findall(text) if (w := words(s))]
    if len(sentences) > 1:
        return [x for s in sentences[:-1] for x in s], sentences[-1]
    own = sentences[0] if sentences else []
    return own[: (len(own) + 1) // 2], own[(len(own) + 1) // 2 :]


def _block_tops(items: list[int], impacts: list[float]) -> dict[int, float]:
    tops: dict[int, float] = {}
    for item, impact in zip(items, impacts):
        tops[item // ITEM_BLOCK] = max(impact, tops.get(item // ITEM_BLOCK, 0.0))
    return tops


class Index:
    """Inverted index of test items. Impacts are BM25 parts over the item's score for itself, so
    a passage that holds all words of an item scores 1 whatever the item's length."""

    def __init__(self, items: list[tuple[int | None, str]]):
        items = [(i, t) for i, t in items if t and words(t)]
        self.ids = [i for i, _ in items]
        bags = [Counter(words(t)) for _, t in items]
        self.longest = max((sum(b.values()) for b in bags), default=1)
        mean = sum(sum(b.values()) for b in bags) / max(1, len(bags))
        found = Counter(w for b in bags for w in b)
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for item, bag in enumerate(bags):
            size = sum(bag.values())
            parts = {w: math.log(1 + (len(bags) - found[w] + 0.5) / (found[w] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * size / mean)) for w, n in bag.items()}
            whole = sum(parts.values())
            for w, x in parts.items():
                postings[w].append((item, x / whole))
        self.terms = {w: i for i, w in enumerate(postings)}
        self.items = [[p[0] for p in x] for x in postings.values()]
        self.impacts = [[p[1] for p in x] for x in postings.values()]
        self.most = np.array([max(x) for x in self.impacts] + [0.0])  # the last: a word of no item
        self.block_last = [[x[min(k + BLOCK, len(x)) - 1] for k in range(0, len(x), BLOCK)] for x in self.items]
        self.block_most = [[max(x[k : k + BLOCK]) for k in range(0, len(x), BLOCK)] for x in self.impacts]
        # Per term the item blocks that it occurs in and its largest impact in each, in one table.
        self.blocks = -(-max(1, len(items)) // ITEM_BLOCK)
        tops = [_block_tops(i, x) for i, x in zip(self.items, self.impacts)]
        self.tops_at = np.concatenate([[0], np.cumsum([len(t) for t in tops] + [0])]).astype(np.int64)
        self.tops_block = np.array([b for t in tops for b in t], np.int64)
        self.tops_most = np.array([x for t in tops for x in t.values()], np.float64)
        parts = [question_and_answer(t) for _, t in items]
        self.questions, self.answers = [shingles(q) for q, _ in parts], [shingles(a) for _, a in parts]
        self.answer_width = [min(WIDTH, len(a)) for _, a in parts]
        self.question_width = [min(WIDTH, len(q)) for q, _ in parts]
        self.wholes = [shingles(words(t)) for _, t in items]
        self.whole_width = [min(WIDTH, sum(b.values())) for b in bags]

    def above(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """``(item, score)`` of all items that score at least ``threshold``, by block-max WAND.

        Cursors walk the postings of the terms in item order. An item can only reach the
        threshold if the largest impacts of the terms at or before it do, and if the largest
        impacts of the blocks that it lies in do; else the cursors skip, whole blocks at a time.
        """
        least, found = threshold - 1e-9, []
        cursors = [[self.items[t][0], 0, t] for t in terms]  # item, posting, term
        most = self.most

        def move(cursor: list[int], item: int) -> bool:
            own = self.items[cursor[2]]
            cursor[1] = bisect_left(own, item, cursor[1])
            cursor[0] = own[cursor[1]] if cursor[1] < len(own) else -1
            return cursor[0] >= 0

        while cursors:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, cursor in enumerate(cursors):
                total += most[cursor[2]]
                if total >= least:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            bound, ends = 0.0, []
            for _, _, t in cursors[: pivot + 1]:
                block = bisect_left(self.block_last[t], item)
                if block < len(self.block_last[t]):
                    bound += self.block_most[t][block]
                    ends.append(self.block_last[t][block])
            if bound < least:
                beyond = min(ends) + 1 if ends else item + 1
                if pivot + 1 < len(cursors):
                    beyond = min(beyond, cursors[pivot + 1][0])
                target = max(beyond, item + 1) if beyond <= item else beyond
                cursors = [c for k, c in enumerate(cursors) if k > pivot or move(c, target)]
            elif cursors[0][0] == item:
                score = sum(self.impacts[t][at] for _, at, t in cursors[: pivot + 1])
                if score >= least:
                    found.append((item, float(score)))
                cursors = [c for k, c in enumerate(cursors) if k > pivot or move(c, item + 1)]
            else:
                cursors = [c for c in cursors if c[0] >= item or move(c, item)]
        return found

    def leaks(self, text: str) -> dict[int, tuple[int, float, float, float]]:
        """Leaked items of a text: first word of the passage, score, overlap of question and of answer.

        Passages are windows of twice the longest item, begun at every such length, so any
        stretch as long as an item lies whole within one.
        """
        parts = words(text)
        found: dict[int, tuple[int, float, float, float]] = {}
        none, get = len(self.most) - 1, self.terms.get
        terms = np.fromiter((get(w, none) for w in parts), np.int64, len(parts))
        known = np.flatnonzero(terms != none)
        if not len(known):
            return found
        # Place of the same word before, to count a word once in a window.
        order = known[np.argsort(terms[known], kind="stable")]
        before = np.full(len(terms), -1, np.int64)
        same = terms[order[1:]] == terms[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        step = self.longest
        for start, window in self._promising(terms, known, before, step, max(1, -(-(len(terms) - step) // step))):
            end = start + 2 * step
            passage = None
            for item, score in self.above(window.tolist(), THRESHOLD):
                if passage is None:
                    passage = parts[start:end]
                question = self._share(self.questions[item], self.question_width[item], passage)
                answer = self._share(self.answers[item], self.answer_width[item], passage)
                whole = self._share(self.wholes[item], self.whole_width[item], passage)
                if (whole >= OVERLAP or min(question, answer) >= OVERLAP) and (item not in found or score > found[item][1]):
                    found[item] = (start, score, question, answer)
        return found

    def _promising(self, terms: np.ndarray, known: np.ndarray, before: np.ndarray, step: int, windows: int) -> Iterator[tuple[int, np.ndarray]]:
        """``(first word, distinct terms)`` of the windows that may hold an item above the threshold:
        the largest impacts of their terms within some block of items add up to it."""
        least = THRESHOLD - 1e-9
        # A word lies in the window begun at its own step and in the one before.
        at = np.concatenate([known, known])
        window = np.concatenate([known // step, known // step - 1])
        own = (window >= 0) & (window < windows) & (before[at] < window * step)
        at, window = at[own], window[own]
        term = terms[at]
        bound = np.bincount(window, self.most[term], windows)
        own = bound[window] >= least
        window, term = window[own], term[own]
        order = np.argsort(window, kind="stable")
        window, term = window[order], term[order]
        room = max(1, BOUNDS_AT_ONCE // self.blocks)
        for first in range(0, windows, room):
            lo, hi = np.searchsorted(window, [first, first + room])
            if lo == hi:
                continue
            w, t = window[lo:hi] - first, term[lo:hi]
            sizes = self.tops_at[t + 1] - self.tops_at[t]
            ends = np.cumsum(sizes)
            flat = np.arange(ends[-1]) + np.repeat(self.tops_at[t] - (ends - sizes), sizes)
            sums = np.bincount(np.repeat(w, sizes) * self.blocks + self.tops_block[flat], self.tops_most[flat])
            for found in np.unique(np.flatnonzero(sums >= least) // self.blocks):
                a, b = np.searchsorted(w, [found, found + 1])
                yield int(found + first) * step, t[a:b]

    @staticmethod
    def _share(own: set[tuple[str, ...]], width: int, passage: list[str]) -> float:
        if not own:
            return 1.0
        there = {tuple(passage[k : k + width]) for k in range(len(passage) - width + 1)}
        return sum(s in there for s in own) / len(own)


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", index_bytes: int = INDEX_BYTES) -> list[Broadcast]:
    """Broadcast indexes over the items, in as many parts as keep each within ``index_bytes`` of text."""
    items = benchmark.select(column(id_col).cast("bigint").alias("item_id"), column(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-size // index_bytes)
    context = benchmark.sparkSession.sparkContext
    share = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, parts)))
    return [context.broadcast(Index(sorted(map(tuple, items.filter(share == k).collect()), key=repr))) for k in range(parts)]


LEAKS = "doc_id bigint, item_id bigint, first_word bigint, score double, question_overlap double, answer_overlap double"


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    index_bytes: int = INDEX_BYTES,
) -> DataFrame:
    """One row per document and leaked benchmark item: ``doc_id``, ``item_id``, ``first_word`` of the
    passage, BM25 ``score`` (1: all words of the item), ``question_overlap`` and ``answer_overlap``.

    Every passage of every text is a query against the items; those scoring THRESHOLD or more are
    verified word for word: OVERLAP of the item's five-word shingles, or of those of its question
    and of its answer, stand in the passage. Null and empty texts or items match nothing; equal
    items each match; ids may be null or repeat, each row giving its own matches; other
    columns are not read. Texts are not shuffled.
    """
    small_batches(docs.sparkSession)
    found = None
    for index in indexes(benchmark, item_col, item_text_col, index_bytes):

        def run(batches: Iterator[pa.RecordBatch], index: Broadcast = index) -> Iterator[pa.RecordBatch]:
            own = index.value
            for batch in batches:
                rows = [(doc, own.ids[item], *leak) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for item, leak in own.leaks(text).items()]
                columns = list(zip(*rows)) if rows else [()] * 6
                kinds = [pa.int64()] * 3 + [pa.float64()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "item_id", "first_word", "score", "question_overlap", "answer_overlap"])

        part = texts(docs, id_col, text_col).mapInArrow(run, LEAKS)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], LEAKS) if found is None else found


def leak_free(index: Broadcast):
    """A function of a text column: whether the text leaks no item of an index."""

    @F.pandas_udf("boolean")
    def clean(columns: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = index.value
        for bodies in columns:
            yield pd.Series([not own.leaks(t or "") for t in bodies], dtype=bool)

    return clean


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows whose text leaks no benchmark item, columns unchanged.

    A null or empty text leaks nothing; ids are not read; repeated rows stay or go together; items
    that are null or empty match no text, and an empty benchmark drops nothing.
    """
    small_batches(docs.sparkSession)
    names = docs.columns
    for index in indexes(benchmark, item_col, item_text_col):
        docs = docs.withColumn("__clean", leak_free(index)(column(text_col).cast("string"))).filter("__clean").select(*[column(c) for c in names])
    return docs
