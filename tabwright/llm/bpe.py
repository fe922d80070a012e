"""Byte-pair encoding from a public tokenizer file: an exact prefix program and fast ids.

The file's merges are read as they are; nothing is trained. Both classes return what the
library of the file returns for a whole text: the same split into pieces, the same merges,
and the special string as one id wherever it stands in a text.
"""

from __future__ import annotations

import json
import re
from array import array
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import ahocorasick
import numpy as np
import regex

# Fixed value: the split pattern of byte-level BPE with regular expressions.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
EXACT = regex.compile(PATTERN)
# The same split by the faster standard module, for texts without the characters that the two
# modules class differently: numbers that are no decimal digits, and four control characters.
PLAIN = re.compile(r" ?[^\W\d_]+|'s|'t|'re|'ve|'m|'ll|'d| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
UNLIKE = re.compile("[" + "".join(re.escape(chr(c)) for c in range(0x110000) if 0x1C <= c <= 0x1F or chr(c).isalnum() and not chr(c).isalpha() and not chr(c).isdecimal()) + "]")
# The same below 2**16, and all beyond: a class with many single characters beyond is slow to search.
SUSPECT = re.compile(UNLIKE.pattern.translate(dict.fromkeys(range(0x10000, 0x110000)))[:-1] + "\U00010000-\U0010ffff]")
CONTRACTIONS = ("'re", "'ve", "'ll")
# Punctuation that is a piece and a token of its own after letters.
MARKS = ",.;:!?"
# Words kept with their result in a worker; at this many the table starts anew.
CACHE_WORDS, CACHED_LENGTH = 1_000_000, 48
CACHE_PAIRS = 2_000_000
# Pieces of more bytes are worked through from the front, without recursion.
DEEP = 400
# White space of at least so many characters is no matter for a backtracking pattern.
BLANKS = regex.compile(r"\s{1000,}")


def split(text: str) -> list[str]:
    return (PLAIN if text.isascii() and not _control(text) or not SUSPECT.search(text) or not UNLIKE.search(text) else EXACT).findall(text)


def _control(text: str) -> bool:
    return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte: itself where printable, else the next code point from 256."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merge ranks and special strings of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        raw = byte_alphabet()
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.ids = {bytes(raw[c] for c in token): i for token, i in model["vocab"].items() if token not in self.special}
        self.merge: dict[tuple[int, int], int] = {}  # rank of a pair
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: left part, right part, rank
        plain = {token: i for token, i in model["vocab"].items()}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            a, b, made = plain[left], plain[right], plain[left + right]
            self.merge[a, b] = rank
            self.parts.setdefault(made, (a, b, rank))
        self.backwards: dict = {}  # tree of the tokens from their last byte; -1 holds the token
        for token, i in self.ids.items():
            node = self.backwards
            for byte in reversed(token):
                node = node.setdefault(byte, {})
            node[-1] = i
        self.reach: dict[bytes, int] = {}  # the longest token with these last three bytes
        for token in self.ids:
            if len(token) > 2:
                self.reach[token[-3:]] = max(len(token), self.reach.get(token[-3:], 0))
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ids.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class PrefixProgram:
    """Exact token counts at every prefix of a byte string, by one pass of dynamic programming.

    The encoding of a prefix that ends at ``i`` closes with exactly one token ``t``; what stands
    before it is the encoding of the prefix ``i - len(t)``. ``t`` is the token for which the
    last token of that shorter prefix and ``t`` stay apart under the merges. So the count at
    ``i`` is one more than the count at ``i - len(t)``, and no prefix is encoded twice.
    """

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self._right: dict[int, list[tuple[int, float]]] = {}
        self._left: dict[int, list[tuple[int, float]]] = {}
        self._apart: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self._states: dict[bytes, int] = {}

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The symbols that stand at one edge while ``token`` is put together, each with the
        rank of the merge that ends it, from the single byte to the token itself."""
        found, chain, at = (self._left, self._right)[side], [], token
        if token not in found:
            ends = float("inf")
            while True:
                chain.append((at, ends))
                if at not in self.v.parts:
                    break
                ends = self.v.parts[at][2]
                at = self.v.parts[at][side]
            found[token] = chain[::-1]
        return found[token]

    def _merged_across(self, a: int, b: int, spare: tuple[int, int] | None = None) -> bool:
        """Whether a merge joins the right edge of ``a`` with the left edge of ``b`` before both are whole."""
        xs, ys, merge, i, j = self._edge(a, 1), self._edge(b, 0), self.v.merge, 0, 0
        while True:
            (x, x_ends), (y, y_ends) = xs[i], ys[j]
            rank = merge.get((x, y))
            # Of two merges of one rank the left one goes first: a's own before the common
            # one, and that before b's own.
            if rank is not None and rank < x_ends and rank <= y_ends and (x, y) != spare:
                return True
            if i + 1 == len(xs) and j + 1 == len(ys):
                return False
            if x_ends <= y_ends and i + 1 < len(xs) or j + 1 == len(ys):
                i += 1
            else:
                j += 1

    def whole(self, token: int) -> bool:
        """Whether the bytes of a token encode to that token alone."""
        known = self._whole.get(token)
        if known is None:
            made = self.v.parts.get(token)
            known = made is None or self.whole(made[0]) and self.whole(made[1]) and not self._merged_across(made[0], made[1], made[:2])
            self._whole[token] = known
        return known

    def apart(self, a: int, b: int) -> bool:
        """Whether ``a`` followed by ``b`` is the encoding of their bytes."""
        key = a << 20 | b
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) > CACHE_PAIRS:
                self._apart.clear()
            known = self._apart[key] = self.whole(b) and not self._merged_across(a, b)
        return known

    def _closing(self, data: bytes, end: int) -> list[tuple[int, int]]:
        """``(start, token)`` of every token that ends at ``end``, shortest first."""
        node, at, found = self.v.backwards, end, []
        while at:
            at -= 1
            node = node.get(data[at])
            if node is None:
                break
            token = node.get(-1)
            if token is not None:
                found.append((at, token))
        return found

    def _state(self, data: bytes, end: int, last: dict[int, int], counts: dict[int, int]) -> None:
        """Find the closing token at ``end``, from the shorter prefixes that it needs."""
        known = self._apart
        for start, token in reversed(self._closing(data, end)):
            if start == 0:
                if not self.whole(token):
                    continue
                counts[end] = 1
            else:
                if start not in last:
                    self._state(data, start, last, counts)
                fits = known.get(last[start] << 20 | token)
                if fits is None:
                    fits = self.apart(last[start], token)
                if not fits:
                    continue
                counts[end] = counts[start] + 1
            last[end] = token
            return
        raise ValueError(f"no token of the vocabulary ends at byte {end}")

    def _from_front(self, data: bytes) -> array:
        """Token counts of all prefixes. The tokens that end at each byte come from one pass of an
        automaton over the bytes, longest first."""
        last, counts, apart = array("i", bytes(4 * len(data) + 4)), array("i", bytes(4 * len(data) + 4)), self._apart
        done = 0
        for at, (token, length) in self.v.automaton.iter(data.decode("latin-1")):
            end = at + 1
            if end == done:
                continue
            if end != done + 1:
                raise ValueError(f"no token of the vocabulary ends at byte {done + 1}")
            start = end - length
            if start == 0:
                if not self.whole(token):
                    continue
            else:
                fits = apart.get(last[start] << 20 | token)
                if fits is None:
                    fits = self.apart(last[start], token)
                if not fits:
                    continue
            counts[end], last[end], done = counts[start] + 1, token, end
        if done != len(data):
            raise ValueError(f"no token of the vocabulary ends at byte {done + 1}")
        return counts

    def state(self, data: bytes) -> int:
        """The closing token of a short byte string, and its token count above 20 bits.

        The states of the prefixes that it needs are kept, as many words begin alike.
        """
        ids, states, apart = self.v.ids, self._states, self._apart
        if data in ids and self.whole(ids[data]):
            return 1 << 20 | ids[data]
        for start in range(max(1, len(data) - self.v.reach.get(data[-3:], 2)), len(data)):  # the longest token first
            token = ids.get(data[start:])
            if token is None:
                continue
            before = states.get(data[:start])
            if before is None:
                before = self.state(data[:start])
                if len(states) >= CACHE_WORDS:
                    states.clear()
                states[data[:start]] = before
            key = (before & 0xFFFFF) << 20 | token
            fits = apart.get(key)
            if fits is None:
                fits = self.apart(before & 0xFFFFF, token)
            if fits:
                return (before >> 20) + 1 << 20 | token
        raise ValueError(f"no token of the vocabulary ends at byte {len(data)}")

    def counts(self, data: bytes, ends: range | list[int]) -> list[int]:
        """Token counts of the prefixes that stop at ``ends`` (ascending)."""
        if len(data) > DEEP:  # from the front, so that no call waits for many others
            known = self._from_front(data)
            return [known[end] for end in ends]
        last: dict[int, int] = {}
        counts = {0: 0}
        for end in ends:
            if end not in counts:
                self._state(data, end, last, counts)
        return [counts[end] for end in ends]


class TokenCounter:
    """Token counts of texts and of all their prefixes."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.program = PrefixProgram(self.v)
        self._pieces: dict[str, int] = {}
        self._words: dict[str, int] = {}

    def piece(self, piece: str) -> int:
        """Tokens of a piece of the split."""
        known = self._pieces.get(piece)
        if known is None:
            data = piece.encode()
            if len(piece) > CACHED_LENGTH:
                return self.program.counts(data, [len(data)])[0]
            if len(self._pieces) >= CACHE_WORDS:
                self._pieces.clear()
            known = self._pieces[piece] = self.program.state(data) >> 20
        return known

    def piece_prefixes(self, piece: str) -> list[int]:
        """Tokens of the first 1, 2, ... characters of a piece."""
        ends, at = [], 0
        for c in piece:
            at += len(c.encode())
            ends.append(at)
        counts = self.program.counts(piece.encode(), ends)
        if piece in CONTRACTIONS:  # its first two characters alone are split into two pieces
            counts[1] = 2
        return counts

    def _split_count(self, text: str) -> int:
        return sum(map(self.piece, split(text)))

    def _word(self, word: str) -> int:
        """Tokens of a short word after a space. Letters are one piece, and so is a mark after them."""
        if word.isalpha():
            return self.program.state((" " + word).encode()) >> 20
        if word[-1] in MARKS and word[:-1].isalpha():
            known = self._words.get(word[:-1])
            return (self.program.state((" " + word[:-1]).encode()) >> 20 if known is None else known) + 1
        return self._split_count(" " + word)

    def _fill(self, words: list[str]) -> bool:
        """Remember the words of a text; false if a word depends on what stands before it."""
        known = self._words
        if len(known) + len(words) > CACHE_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                if not w or w[0].isspace() or len(w) > CACHED_LENGTH:
                    return False
                known[w] = self._word(w)
        return True

    def _by_words(self, text: str) -> list[int] | None:
        """Tokens of the text up to its first space and of each word after a space; none if a word
        depends on what stands before it."""
        first, *words = text.split(" ")
        for _ in range(2):
            try:
                return [self._split_count(first), *map(self._words.__getitem__, words)]
            except KeyError:
                if not self._fill(words):
                    break
        return None

    def count(self, text: str) -> int:
        """Tokens of a whole text. A space always opens a piece unless white space follows or
        the text ends, so the words between single spaces are counted apart and remembered."""
        if any(s in text for s in self.v.special):
            return sum(1 if part in self.v.special else self.count(part) for part in self.v.cut.split(text))
        if not text:
            return 0
        counts = self._by_words(text)
        return self._split_count(text) if counts is None else sum(counts)

    def count_and_cut(self, text: str, budget: int) -> tuple[int, int]:
        """``count`` and ``longest_prefix`` in one; words between single spaces are counted once."""
        special = any(s in text for s in self.v.special)
        counts = None if special or not text else self._by_words(text)
        if counts is None:
            n = self.count(text) if special else self._split_count(text)
            return n, len(text) if n <= budget else self.longest_prefix(text, budget)
        ends = list(accumulate(counts))
        if ends[-1] <= budget:
            return ends[-1], len(text)
        # The words around the budget are opened; the counts of those before stay as they are.
        words, at = text.split(" "), max(0, bisect_right(ends, budget) - 2)
        settled = sum(map(len, words[:at])) + max(0, at - 1)
        near = " ".join(words[at : at + 6])
        return ends[-1], settled + self._plain_prefix(" " + near if at else near, budget - (ends[at - 1] if at else 0))

    def prefixes(self, text: str) -> np.ndarray:
        """Tokens of the first 0, 1, ... ``len(text)`` characters, each as the library counts that
        prefix as a text of its own."""
        out, base, tail, settled = [np.zeros(1, np.int64)], 0, "", 0
        for part in self.v.cut.split(text) if self.v.cut else [text]:
            if part in self.v.special:
                # A cut inside the special string leaves ordinary characters, which join the
                # pieces before them.
                base += 1
                out.append(np.array([*self._open(tail, part, settled), base], np.int64))
                tail, settled = "", base
            else:
                pieces, before = split(part), base
                counts, base = self._walk(pieces, base)
                out += counts
                tail = "".join(pieces[-3:])
                settled = before + sum(map(self.piece, pieces[:-3]))
        return np.concatenate(out)

    def _walk(self, pieces: list[str], base: int, before: str = "") -> tuple[list[np.ndarray], int]:
        """Counts after each character of ``pieces``, which follow the piece ``before``."""
        out = []
        for p in pieces:
            counts = np.array(self.piece_prefixes(p), np.int64) + base
            base = int(counts[-1])
            if before.isspace() and p[0].isspace():
                # At the end of a prefix the run of white space is one piece.
                counts[0] += self.piece(before + p[0]) - self.piece(before) - self.piece(p[0])
            out.append(counts)
            before = p
        return out, base

    def _open(self, tail: str, special: str, settled: int) -> list[int]:
        """Counts where the end lies inside a special string: ``settled`` tokens, then the last
        pieces before the string, which its first characters may change."""
        return [settled + self._split_count(tail + special[:k]) for k in range(1, len(special))]

    def _over_special(self, text: str, budget: int) -> int:
        """``longest_prefix`` of a text with special strings, part by part.

        What follows a whole special string leaves the count before it as it is, so the search
        ends at the first one behind which the budget is exceeded.
        """
        base = best = at = 0
        while at <= len(text):
            found = self.v.cut.search(text, at)
            part = text[at : found.start() if found else len(text)]
            pieces = split(part)
            counts = list(map(self.piece, pieces))
            tail, settled = "".join(pieces[-3:]), base + sum(counts[:-3])
            if base + sum(counts) <= budget:
                best = at + len(part)
            elif base <= budget:
                best = max(best, at + self._plain_prefix(part, budget - base))
            base += sum(counts)
            if not found:
                return best
            base += 1
            if base > budget:
                inside = [k for k, n in enumerate(self._open(tail, found.group(), settled), 1) if n <= budget]
                return found.start() + inside[-1] if inside else best
            at = best = found.end()
        return best

    def longest_prefix(self, text: str, budget: int) -> int:
        """Characters of the longest prefix of at most ``budget`` tokens."""
        if any(s in text for s in self.v.special):
            return self._over_special(text, budget)
        return self._plain_prefix(text, budget)

    def _plain_prefix(self, text: str, budget: int) -> int:
        # The counts after whole pieces grow, so only the pieces around the budget are opened.
        reach = 4 * budget + 64
        while True:
            pieces = split(text[:reach])
            if reach < len(text):  # the last pieces may be other ones in the whole text
                del pieces[-3:]
            ends = list(accumulate(map(self.piece, pieces)))
            if reach >= len(text) or len(ends) > 8 and ends[-8] > budget:
                break
            reach *= 2
        at = max(0, bisect_right(ends, budget) - 2)
        counts, _ = self._walk(pieces[at : at + 6], ends[at - 1] if at else 0, pieces[at - 1] if at else "")
        near = np.concatenate([[ends[at - 1] if at else 0], *counts])
        return sum(map(len, pieces[:at])) + int(np.flatnonzero(near <= budget)[-1])


@lru_cache(maxsize=2)
def token_counter(path: str) -> TokenCounter:
    """The counter of a worker process, whose tables last over its tasks."""
    return TokenCounter(path)


class IdEncoder:
    """Token ids of whole texts by a compiled encoder that runs the merges of the file."""

    def __init__(self, path: str):
        import tiktoken

        v = vocabulary(path)
        self.encoder = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=v.ids, special_tokens=v.special)

    def encode(self, text: str) -> np.ndarray:
        """Ids as unsigned 32-bit numbers.

        Long white space is cut out and encoded by itself, as the pattern would look through all
        of it again and again: it is one piece, but for its last character where a word follows.
        """
        parts, done = [], 0
        for m in BLANKS.finditer(text):
            end = m.end() if m.end() == len(text) else m.end() - 1
            parts += [self._ids(text[done : m.start()]), np.array(self.encoder._encode_single_piece(text[m.start() : end].encode()), np.uint32)]
            done = end
        return self._ids(text) if not parts else np.concatenate([*parts, self._ids(text[done:])])

    def _ids(self, text: str) -> np.ndarray:
        return self.encoder.encode_to_numpy(text, allowed_special="all")
