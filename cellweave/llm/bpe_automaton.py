"""Byte-pair encoding by a deterministic tokenization automaton.

The automaton reads vocabulary tokens and accepts exactly the token sequences that byte-pair merging yields. It is
compiled from the merge list by one gadget per merge, in rank order, starting from a single state with a loop for every
byte. The gadget for the merge (u, v) -> w

* gives the u-arcs a state of their own, a copy of the one they led to, and takes its v-arc (after u, v may no longer
  follow, as the two would have merged);
* adds a w-arc to every state that has a u-arc, leading to where u, v led.

Where an arc leads depends on its token alone, so the transition table is a list of states per token and a table of
bits (state x column) that says which arcs there are. Tokens whose arcs leave the same states share a column until a
gadget tells them apart, as tokens that lead to the same state share a row; so a vocabulary of 50,000 merges makes some
9,000 states and 7,000 columns, 8 MB of bits.

A word is encoded byte by byte. The tokens that start at a position are the nodes of a byte trie on the way down, and an
arc of the position's state for such a token leads to the position behind it. A prefix of an accepted sequence
is accepted and a word has one accepted sequence, so every position is reached by one arc only: nothing is tried and
taken back, and the last arcs followed backwards are the path. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import Counter

import numpy as np
import regex

from cellweave.llm import worker

# Fixed value: the public split pattern of byte-level BPE vocabularies.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_CACHE_BYTES = 64_000_000  # of pieces kept in each of two generations
_ENTRY_BYTES = 220  # an entry's share of its dict and the heads of its objects
_LONG_CHUNK = 256  # longer chunks are encoded without being kept


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character -> byte, as byte-level vocabularies write their tokens."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in set(plain)):
        table[chr(256 + n)] = b
    return table


class Automaton:
    """States and transition table of one byte-level BPE vocabulary.

    leads[t]   the state that t-arcs lead to
    column[t]  the column of t's arcs
    arcs       packed bits: state x column; state 0 is the start
    """

    def __init__(self, vocab: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.ids = vocab
        self.labels: dict[int, bytes] = {i: t for t, i in vocab.items()}
        single = [bytes([b]) for b in range(256)]
        if not vocab.keys() >= set(single):
            raise ValueError("the vocabulary lacks a byte")
        self.leads: dict[bytes, int] = dict.fromkeys(single, 0)
        self.column: dict[bytes, int] = dict.fromkeys(single, 0)
        self._bits = np.zeros((4096, 512), np.uint8)  # state x eight columns; grows by halves
        self._bits[0, 0] = 1  # column 0 starts with all arcs, column 1 has none
        self._states, self._columns = 1, 2
        self._led = Counter({0: len(single) + 1})  # tokens that lead to a state; the start is nobody's to change
        self._filed = Counter({0: len(single), 1: 1})
        for u, v in merges:
            self._gadget(u, v)
        self.arcs = [row.tobytes() for row in self._bits[: self._states, : (self._columns + 7) // 8]]
        del self._bits
        self._trie()

    def _gadget(self, u: bytes, v: bytes) -> None:
        w = u + v
        if w in self.leads:
            raise ValueError(f"two merges make {w!r}: the state behind its arcs would depend on the way there")
        behind = self.leads[w] = self.leads[v]
        self._led[behind] += 1
        # Without the arc earlier merges keep v from ever following u, and w has no arcs either.
        there = self._has(self.leads[u], self.column[v])
        if self._led[self.leads[u]] > 1:
            self._led[self.leads[u]] -= 1
            self.leads[u] = self._new_state(self.leads[u])
            self._led[self.leads[u]] = 1
        if self._filed[self.column[v]] > 1:
            self._filed[self.column[v]] -= 1
            self.column[v] = self._new_column(self.column[v])
            self._filed[self.column[v]] = 1
        byte, bit = divmod(self.column[v], 8)
        self._bits[self.leads[u], byte] &= 255 ^ (1 << bit)
        self.column[w] = self.column[u] if there else 1
        self._filed[self.column[w]] += 1

    def _has(self, state: int, column: int) -> bool:
        return bool(self._bits[state, column >> 3] >> (column & 7) & 1)

    def _new_state(self, like: int) -> int:
        if self._states == len(self._bits):
            self._bits = np.concatenate([self._bits, np.zeros((self._states // 2, self._bits.shape[1]), np.uint8)])
        self._bits[self._states] = self._bits[like]
        self._states += 1
        return self._states - 1

    def _new_column(self, like: int) -> int:
        if self._columns == 8 * self._bits.shape[1]:
            self._bits = np.concatenate([self._bits, np.zeros((len(self._bits), self._columns // 16), np.uint8)], axis=1)
        new, n = self._columns, self._states
        bit = self._bits[:n, like >> 3] >> (like & 7) & 1
        self._bits[:n, new >> 3] |= bit << (new & 7)
        self._columns += 1
        return new

    def _trie(self) -> None:
        """Byte trie of the tokens that have arcs. A node is (nodes by the next byte, arc or None), an arc is its byte
        and bit in a row, the row of the state it leads to, and the token's id."""
        leaf: dict = {}
        found: dict[bytes, list] = {b"": [leaf, None]}
        for t, i in sorted(self.ids.items()):
            if t in self.leads:
                for n in range(1, len(t) + 1):
                    if t[:n] not in found:
                        node = found[t[:n]] = [leaf, None]
                        above = found[t[: n - 1]]
                        if above[0] is leaf:
                            above[0] = {}
                        above[0][t[n - 1]] = node
                c = self.column[t]
                node[1] = (c >> 3, 1 << (c & 7), self.arcs[self.leads[t]], i)
        self._root = found[b""][0]

    def has_arc(self, a: bytes | None, t: bytes) -> bool:
        """Whether the state behind token a (None: the start) has an arc for token t."""
        c = self.column[t]
        return bool(self.arcs[0 if a is None else self.leads[a]][c >> 3] >> (c & 7) & 1)

    def path(self, word: bytes) -> list[int]:
        """The ids along the word's only accepted path; the vocabulary has every byte."""
        n, root, row = len(word), self._root, self.arcs[0]
        came: list = [None] * (n + 1)  # the arc that reaches each position, and from where
        for at in range(n):
            if at:
                row = came[at][0][2]
            down, end = root, at
            for byte in word[at:] if at else word:
                node = down.get(byte)
                if node is None:
                    break
                down, arc = node
                end += 1
                if arc and row[arc[0]] & arc[1]:
                    came[end] = (arc, at)
            if came[n]:
                break
        out = []
        while n:
            arc, n = came[n]
            out.append(arc[3])
        return out[::-1]


class _Chunks(dict):
    """Piece of text -> its ids as little-endian uint32 bytes; two generations of bounded bytes."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.old, self.left, self.most = encode, {}, most, most

    def __missing__(self, piece: str) -> bytes | None:
        got = self.old.get(piece, self)
        if got is self:
            got = self.encode(piece)
        if len(piece) <= _LONG_CHUNK:
            self.left -= _ENTRY_BYTES + len(piece) + len(got or b"")
            if self.left < 0:
                self.old = dict(self)
                self.clear()
                self.left = self.most
            self[piece] = got
        return got


class Tokenizer:
    """Encoder and decoder of one vocabulary file in the JSON format of byte-level BPE.

    Texts are cut at single spaces first: a piece with its leading space splits into words on its own unless a
    white-space run of two or more characters crosses the cut, in which case the whole text is split at once.
    Added tokens that stand in a text are ids of their own, as the file says.
    """

    def __init__(self, path: str, engine: str = "automaton"):
        """engine: "automaton", or "merges" for a compiled library's merging, which yields the same ids sooner."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, alphabet = spec["model"], byte_alphabet()
        as_bytes = lambda t: bytes(alphabet[c] for c in t)
        added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        merges = [tuple(map(as_bytes, m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        vocab = {as_bytes(t): i for t, i in model["vocab"].items() if t not in added}
        self.added = added
        self.labels = {i: t for t, i in vocab.items()} | {i: t.encode() for t, i in added.items()}
        self._label_list = [self.labels.get(i, b"") for i in range(max(self.labels) + 1)]
        self._split = regex.compile(SPLIT).findall
        self._at_added = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self._compiled = None
        if engine == "merges" and [vocab[u + v] for u, v in merges] == sorted(vocab[u + v] for u, v in merges):
            import tiktoken  # merges by id, so the ids must rise with the merge ranks

            self._compiled = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=vocab, special_tokens={}).encode_ordinary
        # One of the two is made, as a worker needs no more.
        self.automaton = None if self._compiled else Automaton(vocab, merges)
        self._word_ids = _Chunks(self._word, _CACHE_BYTES // 4)
        self._piece_ids = _Chunks(self._piece, _CACHE_BYTES)

    def _word(self, word: str) -> bytes:
        return array("I", self.automaton.path(word.encode())).tobytes()

    def _words(self, text: str) -> bytes:
        return b"".join(map(self._word_ids.__getitem__, self._split(text)))

    def _piece(self, piece: str) -> bytes | None:
        """Ids of a piece with the space before it; None if a white-space run may cross its edges."""
        if not piece or piece[0].isspace() or piece[-1].isspace():
            return None
        return b"".join(map(self._word, self._split(" " + piece)))

    def _plain(self, text: str) -> bytes:
        if self._compiled:  # sooner on a whole text than what looking its pieces up would take
            return array("I", self._compiled(text)).tobytes()
        first, *rest = text.split(" ")
        if not rest or not first or first[-1].isspace() or not rest[-1] or rest[-1][0].isspace():
            return self._words(text)
        last = rest.pop()
        try:
            middle = b"".join(map(self._piece_ids.__getitem__, rest))
        except TypeError:  # a None: the whole text is split at once
            return self._words(text)
        # White space at the end of the text can't run on.
        tail = self._words(" " + last) if last[-1].isspace() else self._piece_ids[last]
        return self._words(first) + middle + tail

    def encode_bytes(self, text: str) -> bytes:
        """The text's ids as little-endian uint32 bytes."""
        if self._at_added is None or not any(t in text for t in self.added):
            return self._plain(text)
        return b"".join(self.added[x].to_bytes(4, "little") if x in self.added else self._plain(x) for x in self._at_added.split(text) if x)

    def encode(self, text: str) -> list[int]:
        return array("I", self.encode_bytes(text)).tolist()

    def decode(self, ids) -> str:
        """Emit the arcs' labels; bytes that are no UTF-8 become U+FFFD, ids outside the vocabulary nothing."""
        get = self.labels.get
        return b"".join([get(i, b"") for i in ids]).decode("utf-8", "replace")

    def decode_bytes(self, raw: bytes) -> bytes:
        """decode() of little-endian uint32 bytes, in UTF-8."""
        out = b"".join(map(self._label_list.__getitem__, memoryview(raw).cast("I")))
        try:
            out.decode()
        except UnicodeDecodeError:
            return out.decode("utf-8", "replace").encode()
        return out


def load(path: str, engine: str = "automaton") -> Tokenizer:
    """The worker process's compiled tokenizer; one file and engine at a time."""
    return worker.held(("tokenizer", path, engine), lambda: Tokenizer(path, engine))
