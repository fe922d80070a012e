"""The training-data operators on small awkward tables, against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from conftest import SF_DIR
from oracle import compare, connect
from pyspark.sql import functions as F

from tabwright.llm import bpe, decontaminate, language_id, line_dedup, near_dedup, packing, sharding, url_filter, warc
from tabwright.llm.components import components
from tabwright.llm.exact_dedup import exact_dedup
from tabwright.llm.queries import ORACLES, QUERIES, URL_RULES
from tabwright.llm.token_counts import count_tokens, counts_at

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, lang string, kept string, shard string, start string"
LONG = " ".join(f"word{i % 977}" for i in range(40_000))
ROWS = [
    (1, "the same text here again", "en"), (2, "the same text here again", "en"), (2, "the same text here again", "en"), (3, None, None), (4, "", "en"),
    (None, "a row without an id", "en"), (5, LONG, "en"), (6, LONG + " more", None), (7, "12 34 !!", "en"), (8, "été à la plage", "fr"), (9, " \n\n x\n", "fr"),
    (10, "it's <|endoftext|> we'll  see", "en"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_token_counts(docs, none, library):
    got = count_tokens(docs, TOKENIZER, 5, prefixes=True).collect()
    assert len(got) == len(ROWS) and count_tokens(none, TOKENIZER).count() == 0
    for r, (doc_id, text, _) in zip(got, ROWS):
        text = text or ""
        n = len(ids_of(library, text))
        assert (r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) == (doc_id, len(text.encode()), n, n > 5)
        counts = counts_at(bytes(r["prefix_steps"]))
        if len(text) < 100:
            assert list(counts) == [len(ids_of(library, text[:k])) for k in range(len(text) + 1)]
        assert r["fits_chars"] == max(k for k in range(len(text) + 1) if counts[k] <= 5)


def test_prefix_program_on_random_texts(library):
    counter, rng = bpe.TokenCounter(TOKENIZER), random.Random(5)
    parts = ["it's", "we'll  ", "\n\n", " \n x", "'re", "!!'s", "日本", "²½", " ", "\x1c", "12", "<|endoftext|>", "<|endof", "😀", "\t", "Ⅷ", "aaaa", "\r\n"]
    for _ in range(200):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 9)))
        assert list(counter.prefixes(text)) == [len(ids_of(library, text[:k])) for k in range(len(text) + 1)]
        assert list(bpe.IdEncoder(TOKENIZER).encode(text)) == ids_of(library, text)


def test_exact_dedup(docs, none):
    got = sorted(exact_dedup(docs).collect(), key=repr)
    groups = defaultdict(list)
    for doc_id, text, _ in ROWS:
        groups[text or ""].append(doc_id)
    assert len(got) == len(ROWS) and exact_dedup(none).count() == 0
    for r in got:
        own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        assert r["group_size"] == len(own) and r["keep_id"] == max((x for x in own if x is not None), default=None)
    assert sum(r["kept"] for r in got) == len(groups)


@pytest.mark.parametrize("sizes, shards", [([5, 9, 2, 7, 7, 1, 30], 3), ([4] * 10, 4), ([100, 1, 1], 5), (list(range(1, 60)), 7), ([], 3)])
def test_smallest_capacity(spark, sizes, shards):
    groups = spark.createDataFrame([(((i * 7919) % 61) << 54, s) for i, s in enumerate(sizes)], "key bigint, size bigint")
    keys = sharding.cut_keys(groups, shards)
    rows = sorted((r["key"], r["size"]) for r in groups.collect())
    loads = Counter(sum(k >= c for c in keys) for k, s in rows for _ in range(s))

    def fits(capacity):
        used, load = 1, 0
        for _, s in rows:
            if s > capacity:
                return False
            used, load = (used + 1, s) if load + s > capacity else (used, load + s)
        return used <= shards

    assert not sizes or max(loads.values()) == next(c for c in range(1, sum(sizes) + 1) if fits(c))


def test_sharding(docs, none):
    got = sharding.shard(docs, 3).collect()
    assert len(got) == len(ROWS) and sharding.shard(none, 3).count() == 0
    where, slots = {}, defaultdict(list)
    for r in got:
        assert where.setdefault(r["text_crc32"], r["shard"]) == r["shard"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert Counter(r["text_crc32"] for r in got) == Counter(zlib.crc32((t or "").encode()) for _, t, _ in ROWS)


@pytest.mark.parametrize("size", [8, 1024])
def test_packing(docs, none, library, size):
    assert packing.pack(none, TOKENIZER, size).count() == 0
    tokens = packing.tokenise(docs, TOKENIZER, size)
    made = packed_well(tokens, packing.pack_tokens(tokens, size), size)
    assert made == Counter((d, len(ids_of(library, t or "")) + 1) for d, t, _ in ROWS)


def packed_well(tokens, pieces, size):
    """Every id in one piece, sequences without holes, one at most padded; the documents' sizes."""
    rows = pieces.collect()
    assert len({(r["task"], r["row"]) for r in rows}) == tokens.count()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["task"], r["row"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    made = Counter()
    for own in by_doc.values():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and 0 < r["length"] <= size
            at += r["length"]
        assert at == own[0]["doc_tokens"]
        made[own[0]["doc_id"], at] += 1
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    totals = [sum(r["length"] for r in own) for own in by_sequence.values()]
    assert sum(t & (t - 1) != 0 for t in totals) <= 1
    built = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.sequences(tokens, pieces).collect()}
    for r in rows:
        assert zlib.crc32(built[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]].tobytes()) == r["ids_crc32"]
    return made


@pytest.mark.parametrize("words", [[38], [40, 37, 33, 90], [60, 5, 33]])
def test_packing_short_documents(spark, words):
    """Where whole pieces run out, rests are cut; whether whole pieces are there or not."""
    docs = spark.createDataFrame([(i, " a" * words[i % len(words)]) for i in range(400)], "doc_id bigint, text string").repartition(5)
    tokens = packing.tokenise(docs, TOKENIZER, 64)
    assert sum(packed_well(tokens, packing.pack_tokens(tokens, 64), 64).values()) == 400


def test_warc(spark, monkeypatch):
    html = [None, "", "é" * 600, "é" * 600, "é" * 600, "short", "short", "\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n" * 200, LONG * 12]
    rows = [(i, f"http://a.example/{i}\r\nx" if i % 2 else None, h, "x") for i, h in enumerate(html)] + [(None, "u", "é" * 600, "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest string")
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert len(got) == len(rows) and warc.round_trip(pages.limit(0)).count() == 0
    for i, _, h, _ in rows:
        body = (h or "").encode()
        first = 4 if h == "é" * 600 and i != 4 else None
        r = got[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(body), hashlib.sha1(body).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first) if first else ("response", None))
    manifest = warc.archive_pages(pages, warc.scratch_dir(spark, "warc"))
    chunks = sorted((r for r in warc.read_archives(manifest).collect() if r["page_id"] == 8), key=lambda r: r["chunk_no"])
    body = (LONG * 12).encode()
    assert len(chunks) == -(-len(body) // warc.CHUNK_BYTES) > 1 and b"".join(bytes(c["data"]) for c in chunks) == body
    assert chunks[0]["running_sha1"] == hashlib.sha1(body[: warc.CHUNK_BYTES]).hexdigest()


def test_url_rules_and_templates(spark):
    urls = [None, "no scheme", "HTTP://WWW.Example.ORG/en/1?x", "http://example.org/es/9", "http://notexample.org/es/9", "http://x.org", "http://a.com/fr/1#y", "http://a.com/de/1", "x://b?c/d"]
    urls += [f"http://bad.net/spam/{i}" for i in range(60)] + [f"http://bad.net/fine/{i}" for i in range(60)]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, host string")
    labels = spark.createDataFrame([(u, "/spam/" in u) for u in urls[9:]], "url string, bad boolean")
    got = {r["page_id"]: r for r in url_filter.filter_urls(pages, labels, URL_RULES).collect()}
    assert len(got) == len(urls)
    expected = [
        ("", "", None, "allow"), ("", "", None, "allow"), ("www.example.org", "/en/1", "example.org/en/1", "block"), ("example.org", "/es/9", "example.org/es/", "block"),
        ("notexample.org", "/es/9", "org/", "allow"), ("x.org", "", None, "allow"), ("a.com", "/fr/1", "com/fr/", "allow"), ("a.com", "/de/1", "com/de/", "block"), ("b", "", None, "allow"),
    ]
    for i, e in enumerate(expected):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"], got[i]["verdict"]) == e
    assert all(got[i]["verdict"] == ("block" if "/spam/" in urls[i] else "allow") for i in range(9, len(urls)))
    assert url_filter.filter_urls(pages.limit(0), labels.limit(0)).count() == 0


def test_language_id(spark, docs, none):
    assert language_id.identify(none).count() == 0
    got = {(r["doc_id"]): r for r in language_id.identify(docs).collect()}
    assert got[3]["lang_pred"] == got[4]["lang_pred"] == got[7]["lang_pred"] == "und" and got[7]["score"] == 0
    assert all(r["lang_pred"] in ("en", "fr", "und") and 0 <= r["score"] <= 1 for r in got.values())
    assert all(r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert language_id.reject_unknown(docs).columns == docs.columns


def test_language_accuracy(spark):
    source = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    scored = language_id.identify(source).join(source.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert scored.filter("lang_pred = lang").count() >= 0.98 * scored.count()




def test_lines_left_over_in_linear_time(spark):
    rng = random.Random(3)
    rows = []
    for n in (1, 2, 7, 40):
        for _ in range(20):
            gone = [i for i in range(1, n + 1) if rng.random() < 0.5]
            spans = [(i, i) for i in gone if i - 1 not in gone]
            spans = [(a, next(i for i in range(a, n + 2) if i + 1 not in gone)) for a, _ in spans]
            rows.append(("\n".join(f"l{i}" for i in range(1, n + 1)), spans, "\n".join(f"l{i}" for i in range(1, n + 1) if i not in gone)))
    many = 100_000
    rows.append(("\n".join(map(str, range(2 * many))), [(2 * i + 1, 2 * i + 1) for i in range(many)], "\n".join(str(2 * i + 1) for i in range(many))))
    df = spark.createDataFrame(rows, "text string, spans array<struct<first: int, last: int>>, expected string").filter("size(spans) > 0")
    begun = time.monotonic()
    assert df.filter(line_dedup._left_over(F.col("text"), F.col("spans")) != F.col("expected")).count() == 0
    assert time.monotonic() - begun < 60


def test_line_dedup(spark, none):
    rng = random.Random(3)
    passages = [[f"shared line number {i} of the passage {p}" for i in range(12)] for p in range(6)]
    rows = []
    for i in range(30):
        own = [f"own {i} {rng.random()}" for _ in range(rng.randrange(2, 9))]
        at = rng.randrange(len(own))
        rows.append((i, "\n".join(own[:at] + passages[i % 6] + own[at:]), "x"))
    rows += [(90, None, "x"), (91, "", "x"), (92, "a\nb\nc\nd", "x"), (93, "a\nb\nc\nd", "x"), (None, "own\nrow", "x")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lines string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(table).collect()}
    assert len(got) == len(rows) and line_dedup.dedup_lines(none).count() == 0
    assert got[90]["text"] is None and got[91]["text"] == "" and got[0]["text"] == rows[0][1] and got[92]["text"] == "a\nb\nc\nd"
    kept = Counter(line for r in got.values() for line in (r["text"] or "").split("\n"))
    for i, text, _ in rows:
        before = (text or "").split("\n")
        after = got[i]["text"].split("\n") if got[i]["text"] else []
        assert got[i]["removed_lines"] == (len(before) - len(after) if text else 0)
        assert all(kept[line] for line in before)  # nothing is lost altogether
    assert sum(r["removed_lines"] for r in got.values()) >= 24 * 4
    assert line_dedup.without_repeats(table).columns == table.columns


def test_long_lines_that_repeat_between_other_lines(spark):
    long = [" ".join(f"word{k}x{i}" for i in range(60)) for k in range(20)]
    rows = []
    for i in range(40):  # every long line twice, in texts that are no copies; one line of 49 words in all
        shared = [long[i % 20], " ".join(["few"] * 49)]
        rows.append((i, "\n".join([f"own {i} a", f"own {i} b", *shared, f"own {i} c", f"own {i} d"])))
    rows += [(50, long[0]), (51, long[0] + "\n" + long[0])]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(table).collect()}
    kept = Counter(line for r in got.values() for line in r["text"].split("\n"))
    assert all(kept[line] == 1 for line in long) and kept[" ".join(["few"] * 49)] == 40
    assert all(long[i] in got[i]["text"] for i in range(20))
    assert (got[50]["text"], got[50]["removed_lines"], got[51]["text"], got[51]["removed_lines"]) == ("", 1, "", 2)


def test_copies_leave_no_lines(spark):
    rng = random.Random(4)
    rows = []
    for i in range(60):  # paragraphs with blank lines and common lines between, so that many chunks are one short line
        lines = [rng.choice(["", "common", f"own {i} {k}", " ".join(f"p{i}x{k}x{w}" for w in range(60))]) for k in range(rng.randrange(1, 30))]
        rows += [(i, "\n".join([f"text {i}", *lines])), (100 + i, "\n".join([f"text {i}", *lines]))]
    rows += [(200, "one short text"), (201, "one short text"), (202, "a\none short text\nb"), (203, ""), (204, ""), (205, None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(table).collect()}
    assert all(got[100 + i]["text"] == "" for i in range(60)) and got[201]["text"] == ""
    assert got[202]["removed_lines"] == got[203]["removed_lines"] == got[204]["removed_lines"] == 0
    kept = Counter(line for r in got.values() for line in (r["text"] or "").split("\n"))
    assert all(kept[line] for _, text in rows for line in (text or "").split("\n"))  # nothing is lost altogether
    left = {r["doc_id"] for r in line_dedup.without_repeats(table).collect()}
    assert left == {*range(60), 200, 202, 203, 204, 205}


def brute_components(rows):
    sets = {}
    for k, (doc_id, text) in enumerate(rows):
        own = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
        sets[k] = {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()
    label = {k: k for k in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[label[k]] = min(doc_id, least.get(label[k], doc_id))
    return Counter((doc_id, len(sets[k]), least.get(label[k])) for k, (doc_id, _) in enumerate(rows))


def test_near_duplicates(spark, docs, none, monkeypatch):
    rng = random.Random(11)
    rows = [(d, t) for d, t, _ in ROWS]
    for base in range(6):
        text = [f"w{rng.randrange(400)}" for _ in range(120)]
        for copy in range(25):
            other = list(text)
            for _ in range(rng.randrange(0, 6)):
                other[rng.randrange(len(other))] = f"n{rng.randrange(10**6)}"
            rows.append((1000 + 100 * copy + base, " ".join(other)))
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, node string")
    expected = brute_components(rows)
    for members in (8192, 4):  # whole groups, and groups cut into blocks
        monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", members)
        got = near_dedup.near_duplicates(table).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == expected
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert near_dedup.near_duplicates(none).count() == 0
    kept = near_dedup.keep_one_of_each(table)
    assert kept.columns == table.columns


def test_signature_join_guarantee():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (200, near_dedup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(near_dedup.SYMBOLS, near_dedup.DISTANCE, replace=False)] ^= 1
    assert (near_dedup.chunk_keys(a) == near_dedup.chunk_keys(b)).any(axis=1).all()


def test_near_duplicates_at_a_lower_share(spark):
    assert (near_dedup.scheme(85), near_dedup.scheme(80)) == ((5, 15), (4, 18))
    rng = random.Random(12)
    rows = []
    for base in range(40):  # 100 shingles, of which 90 stay: 90 of 110 in common, a share of 0.82
        text = [f"w{rng.randrange(10**9)}" for _ in range(104)]
        rows += [(base, " ".join(text)), (100 + base, " ".join([*text[:94], *(f"n{rng.randrange(10**9)}" for _ in range(10))]))]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert near_dedup.keep_one_of_each(table, percent=85).count() == 80
    assert sorted(r["doc_id"] for r in near_dedup.keep_one_of_each(table, percent=80).collect()) == list(range(40))
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, table, "").collect()) == list(range(40))


def test_near_keys_at_a_lower_share():
    width, distance = near_dedup.scheme(80)
    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 16, (200, near_dedup.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(near_dedup.SYMBOLS, distance, replace=False)] ^= 1
    assert (near_dedup.chunk_keys(a, width) == near_dedup.chunk_keys(b, width)).any(axis=1).all()
    assert len(near_dedup.near_pairs(pa.array([a[0].tobytes(), b[0].tobytes()]), np.array([0]), distance)) == 1


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(7, 9), (9, 7), (5, 5)], "a bigint, b bigint")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {7: 7, 9: 7}


def test_block_max_wand_against_all_scores():
    rng = random.Random(2)
    vocabulary = [f"t{i}" for i in range(80)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(5, 30)))) for i in range(150)]
    index = decontaminate.Index(items)
    for _ in range(100):
        terms = rng.sample(range(len(index.terms)), rng.randrange(1, 50))
        scores = defaultdict(float)
        for t in terms:
            for i, x in zip(index.items[t], index.impacts[t]):
                scores[i] += x
        for threshold in (0.2, 0.5):
            assert sorted(i for i, _ in index.above(terms, threshold)) == sorted(i for i, x in scores.items() if x >= threshold)


def test_decontamination(spark, docs, none):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta. theta iota kappa lambda mu."), (2, None), (3, ""), (4, "one two")], "item_id bigint, text string")
    leak = "Alpha, beta gamma delta\nepsilon zeta eta? THETA iota kappa lambda mu"
    filler = " ".join(f"word{i}" for i in range(500))
    rows = [(1, f"{filler} {leak} {filler}"), (2, filler), (3, "alpha beta gamma unrelated words"), (4, None), (None, leak)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, score string")
    for limit in (1 << 20, 20):  # one index, and several
        got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(table, bench, index_bytes=limit).collect()}
        assert got == {(1, 1), (None, 1)}
    assert decontaminate.find_leaks(none, bench).count() == 0 and decontaminate.find_leaks(table, bench.limit(0)).count() == 0
    assert {r["doc_id"] for r in decontaminate.without_leaks(table, bench).collect()} == {2, 3, 4}


@pytest.mark.parametrize("name", list(ORACLES))
def test_checking_sql(spark, name):
    assert compare(QUERIES[name](spark, SF_DIR), connect(SF_DIR), ORACLES[name]) is None


def test_pipeline(spark):
    import corpus_pipeline

    source = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs = source
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.columns == source.columns
    empty = source.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF_DIR).count() == 0
