"""Prefix trie, mixing and periodic runs on small awkward tables, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SF_DIR

from tabwright.llm import prefix_trie as trie_module
from tabwright.llm.mixing import mix
from tabwright.llm.prefix_trie import conversation_paths, prefix_trie, share_starts
from tabwright.llm.queries import QUERIES
from tabwright.llm.repetitions import COVER, PERIOD, Extensions, find_runs, periodic_runs, tiled

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# --- prefix trie -------------------------------------------------------------------------


def turns_of(rows):
    """Ordered ``(role, text)`` lists by conversation."""
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            role, text = role or "", text or ""
            convs[conv].append((turn is not None, turn or 0, role, sha(f"{len(role.encode())}:{role}{text}"), text))
    return {c: [(r, x) for _, _, r, _, x in sorted(t)] for c, t in convs.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        head = c - int(np.fmod(c, 20))
        out[c] = convs.get(head, [])[:h] + own[h:]
    return out


def trie_of(convs):
    nodes = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    rows = []
    for key, members in nodes.items():
        below = [k for k in nodes if k[: len(key)] == key]
        saved = sum((len(nodes[k]) - 1) * len(WORD.findall(k[-1][1])) for k in below if k)
        inner = {k[:-1] for k in below if k}
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(key))
        rows.append((
            min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), sum(len(k) == len(key) + 1 for k in below),
            sum(k not in inner for k in below), saved, sha(ends),
        ))
    return sorted(rows, key=repr)


CONVS = "conv_id bigint, turn int, role string, text string, digest string, words string"


def conversations(seed, copies):
    rng, rows = random.Random(seed), []
    for c in [*range(-25, 90), 4000, 4001]:
        if c % 20 == 0 and rng.random() < 0.3:
            continue  # a family without its first member
        kind = rng.random()
        for turn in range(0 if kind < copies else rng.randrange(1, 7), 8 if kind < copies else 7):
            same = kind < copies
            rows.append((c, None if rng.random() < 0.1 and not same else turn, "user" if same else rng.choice(["user", "", None]), f"w{turn} x" if same else rng.choice(["a b", "c", "", None, " d  e "]), "x", "y"))
    return rows + [(7, 1, "user", "tie one", "x", "y"), (7, 1, "user", "tie two", "x", "y"), (None, 0, "user", "nobody", "x", "y")]


@pytest.mark.parametrize(("seed", "copies"), [(1, 0.0), (2, 0.4)])
def test_prefix_trie(spark, monkeypatch, seed, copies):
    rows = conversations(seed, copies)
    table = spark.createDataFrame(rows, CONVS)
    paths = conversation_paths(table)
    own = sorted((tuple(r) for r in prefix_trie(paths).collect()), key=repr)
    assert own == trie_of(turns_of(rows))
    shared = sorted((tuple(r) for r in prefix_trie(share_starts(paths)).collect()), key=repr)
    assert shared == trie_of(rebuilt(turns_of(rows)))
    # Splitters of one turn, or none at all, change nothing.
    monkeypatch.setattr(trie_module, "SPLITTER_TURNS", 1)
    assert sorted((tuple(r) for r in prefix_trie(paths).collect()), key=repr) == own
    monkeypatch.setattr(trie_module, "_splitters", lambda *_: [])
    assert sorted((tuple(r) for r in prefix_trie(paths).collect()), key=repr) == own


def test_prefix_trie_without_conversations(spark):
    none = spark.createDataFrame([], CONVS)
    assert prefix_trie(share_starts(conversation_paths(none))).count() == 0


def test_prefix_trie_of_a_long_conversation(spark):
    rows = [(c, t, "user", f"word {t}", "x", "y") for c in (1, 2) for t in range(3000 - c)]
    got = {r["depth"]: r for r in prefix_trie(conversation_paths(spark.createDataFrame(rows, CONVS))).collect()}
    assert len(got) == 3000 and got[2998]["n_convs"] == 2 and got[2999]["n_convs"] == 1 and got[0]["saved_tokens"] == 2 * 2998
    assert got[2999]["ends_sha256"] == sha("1") and got[2998]["ends_sha256"] == sha("2")


# --- mixing ------------------------------------------------------------------------------

MIXED = "doc_id bigint, text string, source string, size string, cell string, words string"


def water(sizes, weights, budget, passes):
    targets, full = {}, set()
    while True:
        left = budget - sum(passes * sizes[s] for s in full)
        rest = sum(w for s, w in weights.items() if s not in full)
        over = {s for s in sizes if s not in full and weights[s] * left / rest > passes * sizes[s]}
        if not over:
            return {s: float(passes * sizes[s]) if s in full else weights[s] * left / rest for s in sizes}
        full |= over


def test_mixing(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 200])), rng.choice(["a", "a", "a", "b", "c", "é", None, "z"])) for i in range(600)]
    rows += [(None, "no id", "a"), (805, None, "a"), (909, "twice the same", "b"), (909, "twice the same", "b"), (700, "word " * 20_000, "c"), (701, " \n ", "empty")]
    table = spark.createDataFrame([(*r, "1", "2", "3") for r in rows], MIXED)
    order, got = mix(table)
    got = got.collect()
    assert len(got) == len(rows) and sorted((r["doc_id"], r["taken"]) for r in mix(table)[1].collect() if r["doc_id"] is not None) == sorted((r["doc_id"], r["taken"]) for r in got if r["doc_id"] is not None)
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(WORD.findall(text or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    targets = water(sizes, weights, 1.5 * sum(sizes.values()), 2)
    place = {s: i for i, s in enumerate(weights)}
    source_of = {i: s for i, _, s in rows}
    taken = Counter()
    for r in got:
        s = source_of[r["doc_id"]]
        assert r["source_size"] == sizes[s] and abs(r["target"] - targets[s]) < 1e-6 and 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 1 + len(targets) for s in targets)
    assert sum(taken.values()) == int(1.5 * sum(sizes.values()))
    # The mix: gapless, in order of finish, and at any point each source stands near its weight.
    queue = sorted(order.collect(), key=lambda r: r["start"])
    at, served = 0, Counter()
    for a, b in zip(queue, [*queue[1:], None]):
        assert a["start"] == at and (b is None or a["finish"] <= b["finish"])
        at += a["words"]
        served[a["place"]] += a["words"]
        for s, target in targets.items():
            assert served[place[s]] <= a["finish"] * target + 1
    assert at == sum(taken.values())


def test_mixing_without_rows_or_words(spark):
    none = spark.createDataFrame([], MIXED)
    assert [d.count() for d in mix(none)] == [0, 0]
    blank = spark.createDataFrame([(1, None, "a", "", "", ""), (2, "", None, "", "", "")], MIXED)
    order, got = mix(blank)
    assert order.count() == 0 and sorted(tuple(r) for r in got.collect()) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


# --- periodic runs -----------------------------------------------------------------------


def runs_of(words):
    found = {}
    for p in range(1, len(words) // 4 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(6, 4 * p):
                found.setdefault((i, j + p), p)
            i = max(j, i) + 1
    return sorted((s, e - s, p) for (s, e), p in found.items())


def expected(doc_id, text, planted=True):
    words = WORD.findall(text or "")
    if planted and doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = runs_of(words)
    drop = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def test_difference_cover():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_common_extensions():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 40, 300):
        codes = np.concatenate([rng.integers(0, 2, n), [-1]])
        lce = Extensions(codes)
        i, j = rng.integers(0, n + 1, 200), rng.integers(0, n + 1, 200)
        i, j = i[i != j], j[i != j]
        want = [next(k for k in range(n + 2) if a + k > n or b + k > n or codes[a + k] != codes[b + k]) for a, b in zip(i, j)]
        assert lce.common(i, j).tolist() == want


def test_runs_against_brute_force():
    rng = random.Random(3)
    for _ in range(150):
        docs = []
        for _ in range(rng.randrange(1, 8)):
            words = [rng.randrange(rng.choice([1, 2, 3, 50])) for _ in range(rng.choice([0, 1, 5, 6, 7, 20, 60, 200]))]
            if rng.random() < 0.5 and len(words) > 10:
                a, p = rng.randrange(len(words)), rng.randrange(1, len(words) // 5 + 1)
                words = words[:a] + [words[(a + (i - a) % p) % len(words)] for i in range(a, len(words))]
            docs.append(words)
        sizes = np.array([len(w) for w in docs])
        starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        got = find_runs(np.array([x for w in docs for x in w], np.int64), starts, sizes)
        assert got == sorted((d, *r) for d, w in enumerate(docs) for r in runs_of(w))


def test_periodic_runs(spark):
    planted = [i for i in range(400) if tiled(i, 100)][:6]
    rows = [
        (1, None), (2, ""), (3, " \n "), (4, "a a a a a a"), (5, "a a a a a"), (6, "x " + "b c " * 5 + "b y"), (6, "x " + "b c " * 5 + "b y"), (None, "q r " * 9),
        (7, "\x1fé ü  é ü  é ü  é ü  é"), (8, "word " * 30_000), (9, "a b a b a b a b c c c c c c a b a b a b a b"),
        *((i, " ".join(f"w{j}" for j in range(97 + i))) for i in planted),
    ]
    table = spark.createDataFrame([(*r, "s", "p") for r in rows], "doc_id bigint, text string, start string, period string")
    for flag in (False, True):
        got = sorted((tuple(r) for r in periodic_runs(table, flag).collect()), key=repr)
        want = [expected(i, x, flag) if i != 8 else (8, 1, 0, 30_000, 1, 30_000_000, sha("0,30000,1\n"), sha("word")) for i, x in rows]
        assert got == sorted(want, key=repr)
    assert periodic_runs(table.limit(0)).count() == 0


def test_periodic_runs_of_documents(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    short = {r["doc_id"]: r["text"] for r in rows if len(r["text"]) < 4000}
    got = {r["doc_id"]: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF_DIR).collect()}
    assert len(got) == len(rows)
    assert all(got[i] == expected(i, x) for i, x in short.items())
    assert sum(r[1] > 0 for r in got.values()) > 20
