"""Encoding with a public tokenizer, content-defined chunks, and the repair of their joins.

The tokenizer splits a text into words by a pattern and merges bytes inside each word only,
so a text may be cut wherever the pattern always splits: such a cut is safe.  Chunks end at
the first safe cut after a place that a rolling hash over the code points picks, hence by
content and not by position: a passage that stands in several documents gives the same
chunks there.  Nothing here needs Spark.
"""

from __future__ import annotations

import base64
import unicodedata
from functools import lru_cache

import numpy as np
import xxhash

#: Window of the rolling hash and mean length of a chunk, in code points.
WINDOW, MEAN_CHUNK = 16, 512
_rng = np.random.default_rng(7)
_COEF = _rng.integers(1, 2**63, WINDOW, dtype=np.uint64) | np.uint64(1)
#: Folder of the public vocabulary files; None takes the installed package's own.
TOKENIZERS: str | None = None


@lru_cache(maxsize=4)
def encoding(name: str = "byte_bpe_50k", folder: str | None = None):
    """A tokenizer of the rank files; strings that look like special tokens are plain text."""
    import public_tokenizers
    import tiktoken

    path = f"{folder}/{name}.tiktoken" if folder else public_tokenizers.path(f"{name}.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


_KIND: dict[str, str] = {}


def _kind(ch: str) -> str:
    """Letter, number, space or other, as the tokenizer's pattern has them."""
    k = _KIND.get(ch)
    if k is None:
        c = unicodedata.category(ch)[0]
        k = _KIND[ch] = "S" if ch.isspace() else c if c in "LN" else "O"
    return k


def safe(text: str, i: int) -> bool:
    """Whether the pattern always splits before position i."""
    if not 0 < i < len(text):
        return True
    a, b = _kind(text[i - 1]), _kind(text[i])
    if a == "S":
        return False
    if b == "S":
        return True
    # a quotation mark and the letters after it may be one word; rare signs that Python and
    # the pattern class differently keep to their neighbours
    return a != b and "'" not in text[i - 1 : i + 1] and text[i - 1].isprintable() and text[i].isprintable()


def cuts(text: str) -> list[int]:
    """Ends of the chunks of a text, the last one its length; none for an empty text."""
    n = len(text)
    if not n:
        return []
    if n <= WINDOW:
        return [n]
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(n - WINDOW + 1, np.uint64)
    for j in range(WINDOW):
        h += points[j : j + len(h)] * _COEF[j]
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    picked = np.flatnonzero((h >> np.uint64(40)) % np.uint64(MEAN_CHUNK) == 0) + WINDOW
    out: list[int] = []
    for i in picked.tolist():
        if out and i <= out[-1]:
            continue
        while i < n and not safe(text, i):
            i += 1
        if i < n and (not out or i > out[-1]):
            out.append(i)
    out.append(n)
    return out


def chunk_hash(chunk: str) -> int:
    return xxhash.xxh3_64_intdigest(chunk.encode("utf-8", "surrogatepass")) - (1 << 63)


class Encoder:
    """Encodes texts chunk by chunk and repairs the joins."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str | None = None) -> None:
        self.enc = encoding(name, folder)

    def chunk(self, text: str) -> list[int]:
        return self.enc.encode_ordinary(text)

    def text(self, text: str | None) -> list[int]:
        """Ids of a whole text; none for a null or empty one."""
        return self.enc.encode_ordinary(text) if text else []

    def holds(self, ids: list[int], chunk: str) -> bool:
        """Whether ids spell a chunk; a borrowed chunk of another text would not."""
        return self.enc.decode_bytes(ids) == chunk.encode("utf-8", "replace")

    def joined(self, text: str, ends: list[int], parts: list[list[int]]) -> list[int]:
        """Ids of a text from those of its chunks.

        Around every join the words on both sides are encoded again, wider and wider, until
        the ids outside of them agree with those of the chunks.
        """
        if len(parts) < 2:
            return parts[0] if parts else []
        out = list(parts[0])
        for k in range(1, len(parts)):  # out are the ids of text[:at]
            out, right = self._repair(text, ends[k - 1], ends[k], out, parts[k])
            out.extend(right)
        return out

    def _repair(self, text: str, at: int, end: int, left: list[int], right: list[int]) -> tuple[list[int], list[int]]:
        width = 24
        while True:
            lo, hi = max(0, at - width), min(end, at + width)
            while lo > 0 and not safe(text, lo):
                lo -= 1
            while hi < end and not safe(text, hi):
                hi += 1
            a, b = self.enc.encode_ordinary(text[lo:at]), self.enc.encode_ordinary(text[at:hi])
            both = self.enc.encode_ordinary(text[lo:hi])
            if both == a + b:
                return left, right  # nothing to repair
            if left[len(left) - len(a) :] == a and right[: len(b)] == b:
                del left[len(left) - len(a) :]
                return left + both, right[len(b) :]
            if lo == 0 and hi == end:
                return both, []
            width *= 4


def encode_in_chunks(encoder: Encoder, text: str | None, borrowed: dict[int, list[int]] | None = None) -> list[int]:
    """Ids of a text, of which the chunks numbered in ``borrowed`` are encoded already."""
    if not text:
        return []
    text = text.encode("utf-8", "replace").decode("utf-8")  # a lone surrogate has no bytes
    ends = cuts(text)
    parts, start = [], 0
    for k, end in enumerate(ends):
        chunk = text[start:end]
        ids = borrowed.get(k) if borrowed else None
        parts.append(ids if ids is not None and encoder.holds(ids, chunk) else encoder.chunk(chunk))
        start = end
    return encoder.joined(text, ends, parts)
