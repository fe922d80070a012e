"""Counts and ids of texts that are hard for a tokenizer: long runs, many special strings."""

from __future__ import annotations

import random

import public_tokenizers
import pytest

from tabwright.llm import bpe

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
MILLION = 1_000_000


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(TOKENIZER)


@pytest.fixture(scope="module")
def counter():
    return bpe.TokenCounter(TOKENIZER)


@pytest.mark.parametrize("text", [" " * 2 * MILLION, " " * 2 * MILLION + "x", "\n" * 2 * MILLION, "a" * 2 * MILLION, "." * 2 * MILLION, "say " + "\t " * MILLION + "é end"])
def test_long_runs(library, counter, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert bpe.IdEncoder(TOKENIZER).encode(text).tolist() == ids
    assert counter.count(text) == len(ids)
    cut = counter.longest_prefix(text, 1024)
    assert len(library.encode(text[:cut], add_special_tokens=False).ids) <= 1024 < len(library.encode(text[: cut + 1], add_special_tokens=False).ids)


def test_blanks_of_all_kinds(library):
    rng, encoder = random.Random(8), bpe.IdEncoder(TOKENIZER)
    for _ in range(60):
        text = "".join(rng.choice(["x", "it's", " ", "\n", "　", "\x1c", "\xa0", "\t"]) * rng.choice([1, 2, 999, 1000, 1500]) for _ in range(5))
        assert encoder.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_many_special_strings(library, counter):
    text = ("a line of text, about as long as a hundred characters, before a special string that stands within it " * 1)[:94] + "<|endoftext|>"
    text *= 100_000
    assert len(text) > 10 * MILLION
    assert counter.count(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert counter.longest_prefix(text, 1024) == max(k for k in range(6000) if len(library.encode(text[:k], add_special_tokens=False).ids) <= 1024)


def test_prefixes_around_special_strings(library, counter):
    rng = random.Random(9)
    parts = ["<|endoftext|>", "<|endof", "!!", "'", " ", "  \n", "we'll", "ab", "1"]
    for _ in range(80):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(2, 12)))
        counts = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert counter.prefixes(text).tolist() == counts
        for budget in {0, 1, 2, *counts}:
            assert counter.longest_prefix(text, budget) == max(k for k, n in enumerate(counts) if n <= budget)


def test_count_and_cut_in_one(library, monkeypatch):
    """Words are counted once: a long text is not split again to find the cut."""
    rng = random.Random(10)
    letters = ["ab", "ka", "élan", "日本", "ße", "x", "tion", "𝒳", "Ⅷ", "²", "12", "_", "'s", "\n", "\t\n", "\u0301", ",", "!", "...", "😀", "\x1c"]
    counter = bpe.TokenCounter(TOKENIZER)
    for round in range(150):
        common = letters[: 7 if round % 2 else None]
        text = " ".join("".join(rng.choice(common) for _ in range(rng.randrange(1, 5))) + rng.choice(["", "", ".", ",\n"]) for _ in range(rng.randrange(1, 16)))
        counts = [len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        for budget in {0, 1, counts[-1] // 2, rng.randrange(counts[-1] + 1), counts[-1] - 1, counts[-1]}:
            assert counter.count_and_cut(text, budget) == (counts[-1], max(k for k, n in enumerate(counts) if n <= budget))
    assert counter.count_and_cut("", 3) == (0, 0)
    text = " ".join("".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(3000))
    split, seen = bpe.split, []
    monkeypatch.setattr(bpe, "split", lambda t: seen.append(len(t)) or split(t))
    n, cut = counter.count_and_cut(text, 1024)
    assert sum(seen) < 200
    assert n == len(library.encode(text, add_special_tokens=False).ids)
    assert len(library.encode(text[:cut], add_special_tokens=False).ids) <= 1024 < len(library.encode(text[: cut + 1], add_special_tokens=False).ids)
