"""Sets of word shingles as 64-bit hashes, for many texts at once.

Words are runs of bytes other than ASCII white space, A-Z in lower case. A text's set holds a hash for each distinct
run of `width` words; a text with fewer words has one for its whole sequence, a text without words has none.

A word's hash is a keyed BLAKE2b digest of its bytes, a shingle's is a sum of its words' hashes by place, mixed. Two given
shingles that differ have equal hashes with a probability of 2 ** -64, whatever their words look like.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np

from cellweave.llm import worker

_LOWER = bytes(range(256)).lower()
_CHUNK = 1 << 20  # bytes of a text that are split into words at once
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_KEY = b"cellweave shingles"
_CACHE_BYTES = 32_000_000  # of words whose hashes a worker keeps
_ENTRY_BYTES = 200  # an entry's share of its dict and the heads of its objects

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_STEP = [mix(np.array([i + 1], _U))[0] | _U(1) for i in range(64)]


class _Words(dict):
    """Word -> its hash; starts anew when full."""

    left = _CACHE_BYTES

    def __missing__(self, word: bytes) -> int:
        got = int.from_bytes(hashlib.blake2b(word, digest_size=8, key=_KEY).digest(), "little")
        if len(word) <= 64:
            self.left -= _ENTRY_BYTES + len(word)
            if self.left < 0:
                self.clear()
                self.left = _CACHE_BYTES
            self[word] = got
        return got


def _hashes(text: bytes, words: _Words) -> np.ndarray:
    """The hashes of a text's words in order."""
    text, parts, at = text.translate(_LOWER), [], 0
    while at < len(text):
        cut = _SPACE.search(text, at + _CHUNK) if len(text) - at > _CHUNK else None
        end = cut.start() if cut else len(text)
        own = text[at:end].split()
        parts.append(np.fromiter(map(words.__getitem__, own), _U, len(own)))
        at = end
    return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, _U), *parts])


def sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = worker.held("words", _Words)
    for text in texts:
        own = _hashes(text, words)
        n = len(own) - width + 1
        if n > 0:
            yield np.unique(mix(sum(own[i : n + i] * _STEP[i] for i in range(width))))
        elif len(own):
            yield mix(sum((own[i : i + 1] * _STEP[i] for i in range(len(own))), np.array([len(own)], _U) * _STEP[63]))
        else:
            yield own


def fingerprint(own: np.ndarray) -> bytes:
    """128 bits of a sorted set."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()
