"""Splitting texts at spaces that no tokenizer piece crosses, and caching what the chunks encode to."""

from __future__ import annotations

import re
from collections.abc import Callable

_SPACE_PAIR = re.compile(r" \s|\s ")
_ODD_SPACES = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")


def chunks(text: str) -> list[str]:
    """Pieces of the text between its lone spaces; all but the first are to be encoded with a space before them.

    A byte-level pattern never matches across a space with no white space on either side: the space begins
    the next piece. So chunks encode apart as they do in the text.
    """
    return _INNER_SPACE.split(text) if _paired(text) else text.split(" ")


def _paired(text: str) -> bool:
    """Whether a space may stand beside other white space, or at an end. Plain searches settle most ASCII texts."""
    if text[:1].isspace() or text[-1:].isspace():
        return True
    if not text.isascii() or any(c in text for c in _ODD_SPACES):
        return bool(_SPACE_PAIR.search(text))
    return "  " in text or " \n" in text or "\n " in text


class Encoder:
    """Encodes texts to bytes of ids by way of chunks; `encode` maps distinct strings to id bytes.

    A mark that follows a letter at a chunk's end is a piece of its own, so such a chunk is put together from
    its word and the mark. The cache holds about `limit` chunks; when it is full, those of the texts at hand stay, which changes no
    result.
    """

    MARKS = ".,;:!?"

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = 1_200_000):
        self.encode, self.limit = encode, limit
        self.spaced: dict[str, bytes] = {}  # chunks after a space
        self.heads: dict[str, bytes] = {}  # chunks that begin a text
        self.marks = dict(zip(self.MARKS, encode(list(self.MARKS)), strict=True))

    def _learn(self, missing: set[str]) -> None:
        marked = [c for c in missing if len(c) > 1 and c[-1] in self.marks and c[-2].isalpha()]
        whole = missing.difference(marked)
        whole.update(w for c in marked if (w := c[:-1]) not in self.spaced)
        new = list(whole)
        self.spaced.update(zip(new, self.encode([" " + c for c in new]), strict=True))
        for c in marked:
            self.spaced[c] = self.spaced[c[:-1]] + self.marks[c[-1]]

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [chunks(t) for t in texts]
        if len(self.spaced) > self.limit:
            self.spaced.clear()
        found = [list(map(self.spaced.get, parts[1:])) for parts in split]
        gaps = [(parts, ids, [i for i, x in enumerate(ids) if x is None]) for parts, ids in zip(split, found, strict=True) if None in ids]
        self._learn({parts[i + 1] for parts, _, holes in gaps for i in holes})
        for parts, ids, holes in gaps:
            for i in holes:
                ids[i] = self.spaced[parts[i + 1]]
        if len(self.heads) > self.limit // 4:
            self.heads.clear()
        new = list({parts[0] for parts in split if parts[0] not in self.heads})
        self.heads.update(zip(new, self.encode(new), strict=True))
        if len(self.spaced) > self.limit:
            self.spaced = {c: x for parts, ids in zip(split, found, strict=True) for c, x in zip(parts[1:], ids, strict=True)}
        return [self.heads[parts[0]] + b"".join(ids) for parts, ids in zip(split, found, strict=True)]


def batches_of(texts: list, size: int = 4 << 20):
    """(start, end) of runs of texts with about `size` characters, so that memory doesn't follow batch lengths."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t or "")
        if total >= size:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
