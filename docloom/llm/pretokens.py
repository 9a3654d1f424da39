"""The public byte-level pre-tokenizer pattern, split by character classes in numpy."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np

from docloom.llm.common import worker_cache

# Fixed value: the pattern of the public byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OTHER, LETTER, NUMBER, SPACE = range(4)
#: A place where a match of the pattern surely ends: white space after none. Characters that are split at once.
EDGE, PART_CHARS = re.compile(r"(?<=[^\s])[ \n]"), 1 << 20
# Code points of the White_Space property.
WHITE = (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)


def _classes() -> np.ndarray:
    cache = worker_cache("classes")
    if "all" not in cache:
        kinds = {"L": LETTER, "N": NUMBER}
        table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
        table[list(WHITE)] = SPACE
        cache["all"] = table
    return cache["all"]


def starts_of(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pattern's matches in texts without an apostrophe; `offsets` bound the texts."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[codes]
    first = np.zeros(n + 1, dtype=bool)
    first[offsets] = True
    edge = first[:n].copy()
    edge[1:] |= kind[1:] != kind[:-1]
    runs = np.flatnonzero(edge)
    white = kind[runs] == SPACE
    # a word takes one plain space before it
    spaced = runs[~white]
    spaced = spaced[(spaced > 0) & ~first[spaced]]
    spaced = spaced[codes[spaced - 1] == 32]
    start = edge
    start[spaced] = False
    ends = np.append(runs[1:], n)[white]
    begins = runs[white]
    inner = ~first[ends]
    # white space before a word: all but its last character, then that one
    start[ends[inner] - 1] = True
    return np.flatnonzero(start)


def parts(text: str, chars: int | None = None) -> Iterator[str]:
    """Parts of a text, of `chars` characters and the rest of a word, whose matches together are the text's."""
    a, chars = 0, chars or PART_CHARS
    while len(text) - a > chars:
        edge = EDGE.search(text, a + chars)
        if edge is None:
            break
        yield text[a : edge.start()]
        a = edge.start()
    yield text[a:] if a else text


def splitter(pattern: str):
    """A function from texts to their matches of the pattern."""
    import regex

    plain = regex.compile(pattern).findall
    if pattern != PATTERN:
        return lambda texts: [plain(t) for t in texts]

    def split(texts: list[str]) -> list[list[str]]:
        easy = [t for t in texts if "'" not in t]
        whole = "".join(easy)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in easy])]).astype(np.int64)
        starts = starts_of(codes, offsets)
        cuts = np.searchsorted(starts, offsets).tolist()
        bounds = [*starts.tolist(), len(whole)]
        words = [whole[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        spans = iter(zip(cuts, cuts[1:], strict=False))
        out = []
        for text in texts:
            if "'" in text:
                out.append(plain(text))
            else:
                a, b = next(spans)
                out.append(words[a:b])
        return out

    return split
