"""Secrets in texts and in what texts hide: URL, Unicode, base64 and compressed layers, one inside the other.

A worklist starts with the text itself. Each layer is searched for secrets, then for encoded runs; every run that decodes
becomes a new layer unless the same content was seen at the same place before (so the list ends, cycles included). Each decoded byte keeps the
range of characters it came from, so a find in any layer is reported as a span of the original text, with the path of
layers in its kind (``assign~url>base64``). Plain finds keep their bare kind. No layer is dropped for what it holds: a byte that
is not UTF-8 is one character of its own, control characters are characters like others.
"""

from __future__ import annotations

import binascii
import hashlib
import re
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import append_struct, need, send_by_value

send_by_value(__name__)

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # the leftmost runs of 32 or more
KEY_BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
WEB_TOKEN = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
KINDS = ("assign", "access", "hex", "key-block", "web-token", "too-large")
BASE_KINDS = KINDS[:3]
SPANS = "spans array<struct<kind: string, start: long, end: long>>"

WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_RUN = bytes(120 if c in b"0123456789abcdef" else 32 for c in range(256))
_B64_RUN = bytes(120 if c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_" else 32 for c in range(256))
B64 = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_")
LEAST_B64 = 19  # without padding: 14 bytes, the shortest secret (token=abcdefgh)
URL_RUN = re.compile(r"(?<![^\s%\"'<>])[^\s%\"'<>]*(?:%[0-9A-Fa-f]{2}[^\s%\"'<>]*)+")
UNICODE_RUN = re.compile(r"(?<![^\s\\\"'<>])[^\s\\\"'<>]*(?:\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})(?:[^\s\\\"'<>]|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2})*")
B64_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{LEAST_B64},}}={{0,2}}")
B64_PART = re.compile(r"[A-Za-z0-9+/_-]+")
B64_PAD = re.compile(r"={0,2}")
B64_WRAP = re.compile(r"(?<=[A-Za-z0-9+/_-])[ \t]*\r?\n[ \t]*(?=[A-Za-z0-9+/_-])")
STREAM = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]")
#: A compressed layer that unfolds to more is searched like others and reported as ``too-large`` besides.
MOST_UNFOLDED = 1 << 24
#: Compressed content is unfolded and searched in windows. One is longer only for an unbroken run, up to LONGEST_RUN.
PIECE, WINDOW, OVERLAP, LONGEST_RUN = 1 << 18, 1 << 22, 1 << 18, 1 << 24


def find_plain(text: str, data: bytes) -> list[tuple[str, int, int]]:
    """Secrets in one layer; leftmost and non-overlapping per kind. ``data`` is ``text`` in UTF-8 and only rules kinds out."""
    found = []
    low = data.lower()
    if any(w in low for w in WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if b"AKIA" in data:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    if b"x" * 32 in data.translate(_HEX_RUN):
        found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if b"-----BEGIN" in data:
        found += [("key-block", m.start(), m.end()) for m in KEY_BLOCK.finditer(text)]
    if b"eyJ" in data:
        found += [("web-token", m.start(), m.end()) for m in WEB_TOKEN.finditer(text)]
    return found


def _url_layer(text: str, start: int, end: int, mapped: bool) -> tuple[bytes, np.ndarray | None, np.ndarray | None]:
    return _pieces(text, start, end, mapped, re.compile(r"%([0-9A-Fa-f]{2})"), lambda m: bytes([int(m[1], 16)]))


def _unicode_layer(text: str, start: int, end: int, mapped: bool) -> tuple[bytes, np.ndarray | None, np.ndarray | None]:
    pair = r"\\u([dD][89abAB][0-9A-Fa-f]{2})\\u([dD][c-fC-F][0-9A-Fa-f]{2})"

    def char(m: re.Match) -> bytes:
        if m[1]:
            return bytes.fromhex(m[1] + m[2]).decode("utf-16-be").encode()
        return chr(int(m[3] or m[4], 16)).encode("utf-8", "replace")

    return _pieces(text, start, end, mapped, re.compile(pair + r"|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})"), char)


def _pieces(text: str, start: int, end: int, mapped: bool, code: re.Pattern, decode: Callable[[re.Match], bytes]) -> tuple[bytes, np.ndarray | None, np.ndarray | None]:
    """Decoded bytes with the first and the end character each comes from, if ``mapped``."""
    out, count, first, after, at = [], array("q"), array("q"), array("q"), start

    def plain(a: int, b: int) -> None:
        if a < b:
            out.append(text[a:b].encode("utf-8", "surrogateescape"))
        if a < b and mapped:
            count.frombytes(_widths(text[a:b]).tobytes())
            first.extend(range(a, b))
            after.extend(range(a + 1, b + 1))

    for m in code.finditer(text, start, end):
        plain(at, m.start())
        out.append(decode(m))
        if mapped:
            count.append(len(out[-1]))
            first.append(m.start())
            after.append(m.end())
        at = m.end()
    plain(at, end)
    if not mapped:
        return b"".join(out), None, None
    n = np.frombuffer(count, np.int64)
    return b"".join(out), np.repeat(np.frombuffer(first, np.int64), n), np.repeat(np.frombuffer(after, np.int64), n)


def _widths(text: str) -> np.ndarray:
    """Bytes that each character was decoded from; an undecodable byte is one character."""
    if text.isascii():
        return np.ones(len(text), np.int64)
    point = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where((point >= 0xDC80) & (point <= 0xDCFF), 1, 1 + (point >= 0x80) + (point >= 0x800) + (point >= 0x10000)).astype(np.int64)


def _base64_runs(text: str, data: bytes, mapped: bool) -> Iterator[tuple[str, np.ndarray | None, int]]:
    """Runs of base64 characters with the place of each and the end with padding: unbroken ones, then ones wrapped in lines."""
    if b"x" * LEAST_B64 in data.translate(_B64_RUN):
        for m in B64_RUN.finditer(text):
            run = m[0].rstrip("=")
            yield run, np.arange(m.start(), m.start() + len(run)) if mapped else None, m.end()
    parts: list[tuple[int, int]] = []

    def joined() -> Iterator[tuple[str, np.ndarray | None, int]]:
        if sum(b - a for a, b in parts) >= LEAST_B64:
            place = np.concatenate([np.arange(a, b) for a, b in parts]) if mapped else None
            yield "".join(text[a:b] for a, b in parts), place, B64_PAD.match(text, parts[-1][1]).end()

    for m in B64_WRAP.finditer(text) if b"\n" in data else ():
        if not parts or parts[-1][1] != m.start():
            yield from joined()
            start = m.start()
            while start and text[start - 1] in B64:
                start -= 1
            parts = [(start, m.start())]
        parts.append(B64_PART.match(text, m.end()).span())
    yield from joined()


def _base64_layers(run: str, place: np.ndarray | None) -> Iterator[tuple[bytes, np.ndarray | None, np.ndarray | None]]:
    """The run decoded from each of its first four characters on: what comes before the encoded text may be joined to it."""
    run = run.translate({45: 43, 95: 47})
    for phase in range(min(4, len(run) - LEAST_B64 + 1)):
        part = run[phase : len(run) - ((len(run) - phase) % 4 == 1)]
        raw = binascii.a2b_base64(part + "=" * (-len(part) % 4))
        if place is None:
            yield raw, None, None
            continue
        i = np.arange(len(raw))
        yield raw, place[phase + 4 * i // 3], place[phase + (4 * i + 4 + 2) // 3 - 1] + 1


def _unfold(raw: bytes, at: int) -> Iterator[tuple[bytes, int, bool]]:
    """Content of the gzip or zlib streams that follow each other from ``at`` on, in pieces, each with the end of what was read and
    whether damage ends it there. What a cut or damaged stream gives before its end is given."""
    stream, step = zlib.decompressobj(47), 1 << 14
    while True:
        given = raw[at : at + step]
        before = stream.copy() if step > 1 else None
        try:
            out = stream.decompress(given, PIECE)
        except zlib.error:
            if before is None:
                yield b"", at, True
                return
            stream, step = before, 1  # up to the damage
            continue
        at += len(given) - len(stream.unconsumed_tail) - len(stream.unused_data)
        if out:
            yield out, at, False
        if stream.eof:
            if not STREAM.match(raw, at):
                return
            stream, step = zlib.decompressobj(47), 1 << 14
        elif not given and not out:
            return


def _windows(pieces: Iterator[tuple[bytes, int, bool]]) -> Iterator[bytes]:
    """Content in windows. One starts well before the last blank of the one before, so that no secret or encoded run is cut."""
    held, enough = bytearray(), WINDOW
    for out, _, _ in pieces:
        held += out
        if len(held) < enough:
            continue
        again = max(0, _last_break(held) - OVERLAP)
        if len(held) - again > WINDOW // 2:
            if len(held) < LONGEST_RUN:
                enough = len(held) + WINDOW
                continue
            again = len(held) - OVERLAP
        yield bytes(held)
        del held[:again]
        enough = len(held) + WINDOW
    if held:
        yield bytes(held)


def _last_break(data: bytearray) -> int:
    """The last place that no encoded run goes over: a quote, an empty line, a blank inside a line."""
    last = max(data.rfind(c) for c in (b'"', b"'", b"<", b">", b"\n\n"))
    at = len(data) - 1
    while (at := data.rfind(b" ", last + 1, at)) > 0:
        if data[at - 1] not in b" \t\r\n" and data[at + 1] not in b" \t\r\n":
            return at
    return last


def _layers(text: str, data: bytes, mapped: bool) -> Iterator[tuple[str, int, int, bytes, np.ndarray | None, np.ndarray | None]]:
    """Runs that decode: how, start and end of the run, and the bytes with the first and the end character each comes from, if
    ``mapped``."""
    for run, place, end in _base64_runs(text, data, mapped):
        for raw, first, after in _base64_layers(run, place):
            yield "base64", int(first[0]) if mapped else 0, end, raw, first, after
    if b"\\u" in data or b"\\x" in data:
        for m in UNICODE_RUN.finditer(text):
            yield "unicode", *m.span(), *_unicode_layer(text, *m.span(), mapped)
    if b"%" in data:
        for m in URL_RUN.finditer(text):
            yield "url", *m.span(), *_url_layer(text, *m.span(), mapped)


def find_secrets(text: str) -> list[tuple[str, int, int]]:
    """All secrets of a text as (kind, start, end), by start, then kind, then end."""
    found: set[tuple[str, int, int]] = set()
    seen: set[tuple[bytes, int, int]] = set()

    def inside(path: str, layer: str, first: int | np.ndarray | None, after: int | np.ndarray | None) -> Iterator[tuple]:
        """Notes the secrets of a layer and gives the layers in it. Inside compressed content every place is that of the whole."""
        data = layer.encode("utf-8", "replace")

        def origin(a: int, b: int) -> tuple[int, int]:
            return (a, b) if first is None else (first, after) if isinstance(first, int) else (int(first[a]), int(after[b - 1]))

        def new(content: bytes, spot: tuple[int, int]) -> bool:
            here = (hashlib.sha256(content).digest(), *spot)
            known = here in seen
            seen.add(here)
            return not known

        for kind, a, b in find_plain(layer, data):
            found.add((f"{kind}~{path}" if path else kind, *origin(a, b)))
        for how, a, b, raw, starts, ends in _layers(layer, data, not isinstance(first, int)):
            inner = f"{path}>{how}" if path else how
            spot = origin(a, b)
            if not raw or not new(raw, spot):
                continue
            decoded = raw.decode("utf-8", "surrogateescape")
            if isinstance(first, int):
                yield inner, decoded, *spot
            else:
                end = np.cumsum(_widths(decoded))
                from_, to = starts[np.concatenate(([0], end[:-1]))], ends[end - 1]
                yield inner, decoded, from_ if first is None else first[from_], to if first is None else after[to - 1]
            at = 0
            while how == "base64" and (m := STREAM.search(raw, at)):
                size, stop, damaged = 0, m.end(), False
                for out, stop, damaged in _unfold(raw, m.start()):
                    size += len(out)
                at = m.start() + 1 if damaged or not size else stop
                if not size:
                    continue
                if starts is not None:
                    spot = origin(int(starts[m.start()]), b if damaged or stop == len(raw) else int(ends[stop - 1]))
                if size > MOST_UNFOLDED:
                    found.add((f"too-large~{inner}>compressed", *spot))
                for window in _windows(_unfold(raw, m.start())):
                    if new(window, spot):
                        yield f"{inner}>compressed", window.decode("utf-8", "surrogateescape"), *spot

    work = [inside("", text, None, None)]
    while work:
        if layer := next(work[-1], None):
            work.append(inside(*layer))
        else:
            work.pop()
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0].split("~")[0]), s[2], s[0]))


def scan_secrets(docs: DataFrame, text: str = "text", into: str = "secrets") -> DataFrame:
    """``docs`` with a struct of ``spans`` (kind, start, end in code points, end exclusive). Null and empty texts have none;
    repeated rows are scanned alike; a column named ``into`` is replaced."""

    def judge() -> Callable:
        return lambda data: ([dict(zip(("kind", "start", "end"), s, strict=True)) for s in find_secrets((data or b"").decode())],)

    return append_struct(docs, into, SPANS, judge, text)


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret of ``text`` replaced by ``mark``; overlapping spans become one mark. Null stays null."""
    need(docs, text)

    def judge() -> Callable:
        def one(data: bytes | None) -> tuple:
            if data is None:
                return (None,)
            whole, out, at = data.decode(), [], 0
            for kind, start, end in find_secrets(whole):
                if kind.startswith("too-large"):  # searched like any other layer: its secrets have spans of their own
                    continue
                if start >= at:
                    out += [whole[at:start], mark]
                at = max(at, end)
            return ("".join([*out, whole[at:]]) if out else whole,)

        return one

    into = "_redacted"
    while into in docs.columns:
        into += "_"
    return append_struct(docs, into, "text string", judge, text).withColumn(text, F.col(f"{into}.text")).drop(into)
