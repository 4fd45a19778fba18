"""Words of texts inside tasks: splitting as bytes, and tables of encoded words.

A document's words repeat a great deal, so each distinct word is encoded once per table and a document becomes an
array of table rows. Tables live as long as the Python worker and start afresh beyond a bound; that changes speed only.
"""

from __future__ import annotations

import re
import sys
import types
from collections.abc import Callable, Iterable, Iterator

import numpy as np

from ._shared import send_by_value

send_by_value(__name__)

#: ASCII white space; nothing else separates words.
SPACE = b"\x20\t\n\x0b\x0c\r"
CONTINUATION = bytes(range(0x80, 0xC0))
#: Texts are taken together up to about this many bytes, and longer ones cut at white space to look their words up.
CHUNK = 1 << 19
TABLE_WORDS = 1 << 19


def worker_cache(key: tuple, make: Callable):
    """One object per Python worker and key (code sent by value has no globals that last). A worker that goes on to another
    operator drops what the last one kept, but for hashers."""
    kept = sys.modules.setdefault("_econspark_worker", types.ModuleType("_econspark_worker")).__dict__.setdefault("kept", {})
    if key not in kept:
        for other in [k for k in kept if k[0] not in (key[0], "hasher", "codec")]:
            del kept[other]
        kept[key] = make()
    return kept[key]


def chunked(rows: Iterable[tuple[object, bytes | None]], size: int = CHUNK) -> Iterator[list]:
    """Rows (anything, text bytes) in lists of about ``size`` bytes of text."""
    held, n = [], 0
    for row in rows:
        held.append(row)
        n += len(row[1] or b"") + 64
        if n >= size:
            yield held
            held, n = [], 0
    if held:
        yield held


_ANY_SPACE = re.compile(rb"[\x20\t-\r]")


def spans(data: bytes, size: int = CHUNK, space: re.Pattern = _ANY_SPACE) -> Iterator[bytes]:
    """``data`` in pieces of about ``size`` bytes, cut before white space."""
    if len(data) <= size:
        yield data
        return
    at = 0
    while at < len(data):
        cut = space.search(data, at + size)
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


def code_points(data: bytes) -> int:
    return len(data.translate(None, CONTINUATION))


_U = np.uint64
_PRIME = 0x100000001B3


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit numbers."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base, _U)
    steps[0] = 1
    return np.cumprod(steps)


class WordHasher:
    """White-space words and 64-bit hashes of all words of a text at once, from differences of a running polynomial over its bytes."""

    cut_at = _ANY_SPACE

    def __init__(self, marks: bytes = b"") -> None:
        """``marks``: a last byte of these is a word of its own when an ASCII letter or digit stands before it."""
        self.mark, self.plain = np.zeros(256, bool), np.zeros(256, bool)
        self.mark[list(marks)] = True
        self.plain[[c for c in range(128) if chr(c).isalnum()]] = True
        self.byte = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
        self.space = np.zeros(256, bool)
        self.space[list(SPACE)] = True
        self._reach(2 * CHUNK + 4096)

    def _reach(self, n: int) -> None:
        self.power, self.inverse = _powers(_PRIME, n), _powers(pow(_PRIME, -1, 1 << 64), n)

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of each word; the last byte is white space."""
        blank = self.space[codes]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(blank) and not blank[0]:
            edge = np.concatenate((np.zeros(1, edge.dtype), edge))
        start, end = edge[::2], edge[1::2]
        if self.mark.any() and len(end):
            cut = np.flatnonzero(self.mark[codes[end - 1]] & self.plain[codes[end - 2]] & (end - start > 1))
            start, end = np.insert(start, cut + 1, end[cut] - 1), np.insert(end, cut, end[cut] - 1)
        return start, end

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hash, first byte and end of each word."""
        codes = np.frombuffer(data, np.uint8)
        if len(codes) >= len(self.power):
            self._reach(len(codes) + 1)
        start, end = self.edges(codes)
        total = np.empty(len(codes) + 1, _U)
        total[0] = 0
        np.cumsum(self.byte[codes] * self.power[: len(codes)], out=total[1:])
        return mix((total[end] - total[start]) * self.inverse[start] + (end - start).astype(_U)), start, end

    def of_texts(self, texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Bytes, hashes, starts, ends and the word bounds of each text, for short texts together up to about CHUNK bytes and long ones in
        pieces; of the pieces of a long text all but the last have no bounds."""
        group: list[bytes] = []
        size = 0
        for text in texts:
            if len(text) <= CHUNK:
                group.append(text)
                size += len(text) + 1
                if size >= CHUNK:
                    yield self._together(group)
                    group, size = [], 0
                continue
            if group:
                yield self._together(group)
                group, size = [], 0
            pieces = list(spans(text, space=self.cut_at))
            for i, piece in enumerate(pieces):
                data, hashes, start, end, _ = self._together([piece])
                yield data, hashes, start, end, np.array([len(hashes)] if i + 1 == len(pieces) else [], np.int64)
        if group:
            yield self._together(group)

    def _together(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = b"\n".join([*texts, b""])
        hashes, start, end = self.words(data)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        return data, hashes, start, end, np.searchsorted(start, ends)

    def split(self, texts: list[bytes], of_words: Callable) -> list[np.ndarray]:
        """``of_words(data, hashes, starts, ends)`` gives a number per word; returns each text's numbers."""
        found: list[np.ndarray] = []
        held: list[np.ndarray] = []
        for data, hashes, start, end, bounds in self.of_texts(texts):
            values = of_words(data, hashes, start, end)
            at = 0
            for bound in bounds.tolist():
                part = values[at:bound]
                found.append(np.concatenate([*held, part]) if held else part)
                held, at = [], bound
            if not len(bounds):
                held.append(values)
        return found


class UnitHasher(WordHasher):
    """Units instead of words: a blank with what follows up to the next blank or line feed, or one of these alone. They
    make up the whole text, behind one leading blank."""

    cut_at = re.compile(rb" ")

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        feed = codes == 10
        begins = feed | (codes == 32)
        begins[:1] = True
        begins[1:] |= feed[:-1]
        start = np.flatnonzero(begins)
        return start, np.append(start[1:], len(codes))

    def of_texts(self, texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        return super().of_texts([b" " + t if t else t for t in texts])

    def _together(self, texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data, hashes, start, end, _ = super()._together(texts)
        breaks = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1  # the line feeds put between texts
        own = ~np.isin(start, breaks)
        hashes, start, end = hashes[own], start[own], end[own]
        return data, hashes, start, end, np.searchsorted(start, breaks)


class WordTable:
    """Distinct words with their ids under one or more encoders, the ids of each encoder in one flat array.

    Words are known by 64-bit hash (two of a table's words share one with a probability below 1e-7).
    """

    def __init__(self, *encoders: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], hasher: WordHasher | None = None, most: int | None = None) -> None:
        """An encoder gives the ids of all given words in one array, and each word's number of ids."""
        self.encoders = encoders
        self.most = most or TABLE_WORDS
        self.hasher = hasher or worker_cache(("hasher",), WordHasher)
        self._clear()

    def _clear(self) -> None:
        self.size = 0
        #: Sorted hashes with their rows: a large table and a small one of recent words.
        self.known = [(np.zeros(0, _U), np.zeros(0, np.int32)) for _ in range(2)]
        self.codes = [[np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32), 0] for _ in self.encoders]

    def rows(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each text the table rows of its words. They hold until the next call."""
        if self.size > self.most:
            self._clear()
        return self.hasher.split(texts, self._rows)

    def _rows(self, data: bytes, hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        order = np.argsort(hashes)
        ordered = hashes[order]
        first = np.ones(len(ordered), bool)
        first[1:] = ordered[1:] != ordered[:-1]
        distinct, where = ordered[first], order[first]
        rows = np.full(len(distinct), -1, np.int64)
        for keys, at in self.known:
            if len(keys):
                spot = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
                hit = keys[spot] == distinct
                rows[hit] = at[spot[hit]]
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            a, b = start[where[missing]].tolist(), end[where[missing]].tolist()
            rows[missing] = self._add([data[i:j] for i, j in zip(a, b, strict=True)], distinct[missing])
        out = np.empty(len(hashes), np.int64)
        out[order] = rows[np.cumsum(first) - 1]
        return out

    def _add(self, new: list[bytes], keys: np.ndarray) -> np.ndarray:
        at, self.size = self.size, self.size + len(new)
        for code, encode in zip(self.codes, self.encoders, strict=True):
            ids, count = encode(new)
            flat, start, counts, used = code
            flat, start, counts = _room(flat, used, len(ids)), _room(start, at, len(new)), _room(counts, at, len(new))
            flat[used : used + len(ids)] = ids
            counts[at : self.size] = count
            start[at : self.size] = used + np.cumsum(count) - count
            code[:] = flat, start, counts, used + len(ids)
        rows = np.arange(at, self.size, dtype=np.int32)
        self.known[1] = _merged(self.known[1], (keys, rows))
        if len(self.known[1][0]) > 1 << 15:
            self.known = [_merged(*self.known), (np.zeros(0, _U), np.zeros(0, np.int32))]
        return rows

    def gather(self, rows: np.ndarray, encoder: int = 0) -> np.ndarray:
        """The ids of the words at ``rows``, end to end."""
        flat, start, counts, _ = self.codes[encoder]
        count = counts[rows].astype(np.int64)
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        return flat[np.repeat(start[rows] - ends + count, count) + np.arange(total)]


def _merged(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(one[0], two[0])
    return np.insert(one[0], at, two[0]), np.insert(one[1], at, two[1])


def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(array):
        return array
    wider = np.zeros(max(2 * len(array), used + more), array.dtype)
    wider[:used] = array[:used]
    return wider
