"""Words of many texts at once, as hashes: one numpy pass over the bytes of a batch."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from postsieve.llm.common import RollingBytes, mix, runs_of

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Bytes of words made of 0-9, a-z and everything beyond ASCII (after lower-casing A-Z).
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

# Bytes of words between white space: all but blank, tab, line feed, VT, FF, return.
SPACED = np.ones(256, dtype=bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False

GRAM_STEP = np.uint64(0xD6E8FEB86659FD93)


@dataclass
class Words:
    hashes: np.ndarray  # uint64 per word, texts one after the other
    bounds: np.ndarray  # text i has the words bounds[i]:bounds[i+1]
    starts: np.ndarray  # byte offsets of the words in the joined texts
    ends: np.ndarray


def split_words(texts: list[bytes], member: np.ndarray) -> Words:
    """All words of ``texts``, A-Z lower-cased; ``member`` says which bytes make words."""
    data = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    starts, ends = runs_of(member[data])
    offsets = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    bounds = np.searchsorted(starts, offsets)
    hashes = RollingBytes(data).of(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return Words(hashes, bounds, starts, ends)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k words from each word on; the last k-1 words have none."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out = mix(out * GRAM_STEP + hashes[i : i + n])
    return out


def gram_of(words: list[str]) -> np.ndarray:
    """Hashes of given words, as split_words makes them."""
    return np.concatenate([split_words([w.encode()], ALNUM).hashes for w in words]) if words else np.zeros(0, np.uint64)
