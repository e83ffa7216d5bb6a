"""Secret scans over nested encodings (operator 3).

A text is the first layer of a worklist. Each layer is scanned, and whatever can be unwrapped in it becomes a further
layer: percent escapes, Unicode escapes, base64 runs (over line breaks too), and compressed data inside any of those
(gzip, zlib, bzip2, xz, Zstandard; all members). A layer whose content was seen before from the same place is not entered again, which ends cycles
(compression quines, for one); otherwise the list runs until nothing new comes out. Every layer knows for each of its
characters the span of the original text it came from, so findings at any depth point into the original.

Chains of escaped escapes (``%252525..``, ``\\u005cu005c..``) are peeled in one step: the layers between differ in their marks
alone, which no pattern contains. Bytes that are not UTF-8 are read as UTF-16 or Latin-1 where something is found in them.

Decompression of one layer stops at ``MAX_LAYER`` bytes, a guard against bombs; the finding list says so by a row of
kind ``truncated``, as for streams that do not reach their end. Nothing else is bounded: texts of any length are scanned whole.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex")
MAX_LAYER = 64 << 20
LEAST_BASE64 = 16

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})")
#: An escaped mark whose escape is escaped again, and so on.
_CHAINS = ((re.compile(r"%(?:25){2,}(?=[0-9A-Fa-f]{2})"), "url", "%"), (re.compile(r"\\(?:u005[cC]){2,}(?=u[0-9A-Fa-f]{4})"), "unicode", "\\"),
           (re.compile(r"\\(?:x5[cC]){2,}(?=x[0-9A-Fa-f]{2})"), "unicode", "\\"))
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}={0,2}" % LEAST_BASE64)
#: A block of base64 lines: the first of some length, the rest with nothing but indentation beside them, the last with anything after it.
_WRAPPED = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]+)+={0,2}" % LEAST_BASE64)
_LINE = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
_URL_BYTES = re.compile(r"(?:%[0-9A-Fa-f]{2}|[A-Za-z0-9_.~/+-])+")
_URL_TOKEN = re.compile(r"%([0-9A-Fa-f]{2})|.")
_SLASH_BYTES = re.compile(r"(?:\\x[0-9A-Fa-f]{2}|\\u00[0-9A-Fa-f]{2}|\\[nrtabfv0\\'\"]|[ -\[\]-~])+")
_SLASH_TOKEN = re.compile(r"\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})|\\.|.")
_SLASHES = {"n": 10, "r": 13, "t": 9, "a": 7, "b": 8, "f": 12, "v": 11, "0": 0}
_MAGIC = re.compile(rb"\x1f\x8b|\x78[\x01\x5e\x9c\xda]|BZh|\xfd7zXZ\0|\x28\xb5\x2f\xfd", re.S)
FINDINGS = "array<struct<kind:string,start:long,end:long,path:string>>"


@dataclass
class Layer:
    text: str
    path: str
    begin: np.ndarray | None = None  # of each character, in the original; None: the original itself
    end: np.ndarray | None = None
    fresh: np.ndarray | None = None  # which characters this layer's own step decoded; None: all

    def span(self, a: int, b: int) -> tuple[int, int]:
        return (a, b) if self.begin is None else (int(self.begin[a:b].min()), int(self.end[a:b].max()))

    def key(self) -> bytes:
        """A digest of the text and where it came from: what stands in two places counts twice."""
        begin, end = self.maps()
        return hashlib.sha1(b"".join((hashlib.sha1(self.text.encode("utf-8", "surrogatepass")).digest(), begin.tobytes(), end.tobytes()))).digest()

    def maps(self) -> tuple[np.ndarray, np.ndarray]:
        if self.begin is None:
            at = np.arange(len(self.text))
            return at, at + 1
        return self.begin, self.end


def matches(text: str):
    """(kind, start, end) of the plain patterns, in code points."""
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            yield "assign", m.start(), m.end()
    for m in _ACCESS.finditer(text):
        if m.end() - m.start() >= 20:
            yield "access", m.start(), m.end()
    for m in _HEX.finditer(text):
        yield "hex", m.start(), m.end()


def _characters(raw: bytes) -> tuple[str, np.ndarray, np.ndarray] | None:
    """A text with the first and last byte (exclusive) of each character.

    Printable UTF-8 is text. Other bytes are read as UTF-16, if every other one tends to be zero, or as Latin-1, and are
    text if a secret or a further layer is found in them.
    """
    try:
        text = raw.decode("utf-8")
        if text and sum(c.isprintable() or c in "\t\r\n" for c in text) >= 0.9 * len(text):
            at = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
            return text, at, np.r_[at[1:], len(raw)]
    except UnicodeDecodeError:
        pass
    zeros = [raw[k::2].count(0) * 4 > len(raw) for k in (0, 1)]
    if any(zeros):
        text = raw[:len(raw) & ~1].decode("utf-16-be" if zeros[0] else "utf-16-le", "replace")
        width = np.array([4 if ord(c) > 0xFFFF else 2 for c in text], np.int64)
    else:
        text, width = raw.decode("latin-1"), np.ones(len(raw), np.int64)
    if not text or next(matches(text), None) is None and not (_PERCENT.search(text) or _BASE64.search(text)):
        return None
    end = np.minimum(np.cumsum(width), len(raw))
    return text, end - width, end


def _replaced(layer: Layer, step: str, pieces: list[tuple[int, int, str, list[tuple[int, int]]]]) -> Layer | None:
    """The layer with pieces (start, end, new text, source span of each new character) replaced."""
    if not pieces:
        return None
    begin, end = layer.maps()
    out, b, e, f, upto = [], [], [], [], 0
    for start, stop, new, spans in pieces:
        out += [layer.text[upto:start], new]
        b += [begin[upto:start], np.array([begin[x] for x, _ in spans], np.int64)]
        e += [end[upto:start], np.array([end[y - 1] for _, y in spans], np.int64)]
        f += [np.zeros(start - upto, bool), np.ones(len(spans), bool)]
        upto = stop
    out.append(layer.text[upto:]), b.append(begin[upto:]), e.append(end[upto:]), f.append(np.zeros(len(layer.text) - upto, bool))
    return Layer("".join(out), f"{layer.path}>{step}".lstrip(">"), np.concatenate(b), np.concatenate(e), np.concatenate(f))


def _peeled(layer: Layer) -> Layer | None:
    """The layer below all chains of escaped marks."""
    for chain, step, mark in _CHAINS:
        if made := _replaced(layer, step, [(m.start(), m.end(), mark, [m.span()]) for m in chain.finditer(layer.text)]):
            return made
    return None


def _percent(layer: Layer) -> Layer | None:
    pieces = []
    for m in _PERCENT.finditer(layer.text):
        # bytes that are not UTF-8 stay escaped; what stands between them is decoded
        at, new, spans = m.start(), [], []
        for c in bytes.fromhex(m.group().replace("%", "")).decode("utf-8", "surrogateescape"):
            k = 3 if "\udc80" <= c <= "\udcff" else 3 * len(c.encode("utf-8"))
            if "\udc80" <= c <= "\udcff":
                if new:
                    pieces.append((spans[0][0], at, "".join(new), spans))
                new, spans = [], []
            else:
                new.append(c), spans.append((at, at + k))
            at += k
        if new:
            pieces.append((spans[0][0], at, "".join(new), spans))
    return _replaced(layer, "url", pieces)


def _unicode(layer: Layer) -> Layer | None:
    pieces = []
    for m in _UNICODE.finditer(layer.text):
        code = int(next(g for g in m.groups() if g), 16)
        if code < 0x110000 and not 0xD800 <= code < 0xE000:
            pieces.append((m.start(), m.end(), chr(code), [m.span()]))
    return _replaced(layer, "unicode", pieces)


def _format(raw: bytes) -> str | None:
    if raw[:2] == b"\x1f\x8b":
        return "gzip"
    if raw[:1] == b"\x78" and len(raw) > 1 and int.from_bytes(raw[:2], "big") % 31 == 0:
        return "zlib"
    return next((name for magic, name in ((b"BZh", "bzip2"), (b"\xfd7zXZ\0", "xz"), (b"\x28\xb5\x2f\xfd", "zstd")) if raw.startswith(magic)), None)


def _stream(form: str, raw: bytes, most: int) -> tuple[bytes, bool, bytes] | None:
    """(content, whether it ended, what follows) of the first stream."""
    try:
        if form == "zstd":
            import io

            import zstandard

            out = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(raw)).read(most + 1)
            if len(out) > most:
                return out[:most], False, b""
            d = zstandard.ZstdDecompressor().decompressobj()
            d.decompress(raw)
            return out, d.eof, d.unused_data
        d = zlib.decompressobj(47) if form in ("gzip", "zlib") else bz2.BZ2Decompressor() if form == "bzip2" else lzma.LZMADecompressor()
        return d.decompress(raw, most), d.eof, d.unused_data
    except (zlib.error, OSError, EOFError, lzma.LZMAError, ValueError):
        return None
    except Exception as e:  # zstandard's own error type
        if type(e).__name__ != "ZstdError":
            raise
    return None


def _inflate(raw: bytes) -> tuple[str, bytes, bool, bytes] | None:
    """(format, content of all streams, cut short, what follows them) of compressed bytes."""
    form = _format(raw)
    if not form or not (got := _stream(form, raw, MAX_LAYER)) or form == "zlib" and not got[0] and not got[1]:
        return None
    out, whole, rest = got
    parts, size = [out], len(out)
    while whole and _format(after := rest.lstrip(b"\0") if form in ("gzip", "xz") else rest) == form:
        if size >= MAX_LAYER or not (got := _stream(form, after, MAX_LAYER - size)):
            whole = size < MAX_LAYER and whole
            break
        out, whole, rest = got
        parts.append(out)
        size += len(out)
    return form, b"".join(parts), not whole, rest


def _unwrapped(layer: Layer, path: str, raw: bytes, place: tuple[int, int], cut: list) -> tuple[str, bytes]:
    """The path and bytes below all compression of ``raw``."""
    seen = set()
    while (found := _inflate(raw)) and hashlib.sha1(raw).digest() not in seen:
        seen.add(hashlib.sha1(raw).digest())
        path, raw = f"{path}>{found[0]}".lstrip(">"), found[1]
        if found[2]:
            cut.append((layer.span(*place), path))
    return path, raw


def _constant(layer: Layer, path: str, raw: bytes, place: tuple[int, int]) -> Layer | None:
    if not (made := _characters(raw)):
        return None
    a, b = layer.span(*place)
    return Layer(made[0], path, np.full(len(made[0]), a), np.full(len(made[0]), b))


def _escaped(layer: Layer, cut: list):
    """Compressed bytes that stand as percent or backslash escapes, the plain characters among them being bytes too."""
    for step, mark, run, token in (("url", "%", _URL_BYTES, _URL_TOKEN), ("unicode", "\\", _SLASH_BYTES, _SLASH_TOKEN)):
        if mark not in layer.text:
            continue
        for m in run.finditer(layer.text):
            if mark not in m.group():
                continue
            raw, at = bytearray(), []
            for t in token.finditer(m.group()):
                code = next((g for g in t.groups() if g), None)
                c = t.group()
                raw.append(int(code, 16) if code else 32 if c == "+" and step == "url" else _SLASHES.get(c[1], ord(c[1])) if c[0] == "\\" else ord(c))
                at.append(m.start() + t.start())
            at.append(m.end())
            raw, upto = bytes(raw), 0
            for x in _MAGIC.finditer(raw):
                if x.start() < upto or not (found := _inflate(raw[x.start():])):
                    continue
                upto = len(raw) - len(found[3])
                place = at[x.start()], at[upto]
                path, inner = _unwrapped(layer, f"{layer.path}>{step}".lstrip(">"), raw[x.start():upto], place, cut)
                if made := _constant(layer, path, inner, place):
                    yield made


def _decoded(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _joined(text: str):
    """Of each block of base64 lines, the ways to read it as one run, longest first: lists of (start, end)."""
    for m in _WRAPPED.finditer(text):
        lines = [(m.start() + x.start(), m.start() + x.end()) for x in _LINE.finditer(m.group())]
        width = lines[0][1] - lines[0][0]
        even = next((k for k, (a, b) in enumerate(lines) if b - a != width), len(lines))
        ways = {len(lines), len(lines) - 1, even, even + 1 if even < len(lines) and lines[even][1] - lines[even][0] < width else even}
        yield [lines[:k] for k in sorted(ways, reverse=True) if k > 1]


def _base64(layer: Layer, cut: list):
    begin, end = layer.maps()
    path, done = f"{layer.path}>base64".lstrip(">"), []
    for ways in _joined(layer.text):
        for lines in ways:
            raw = _decoded("".join(layer.text[a:b] for a, b in lines))
            if raw is None:
                continue
            place = lines[0][0], lines[-1][1]
            found = _inflate(raw)
            if found:
                if found[2] and lines is not ways[-1]:
                    continue
                below, raw = _unwrapped(layer, path, raw, place, cut)
                made = _constant(layer, below, raw, place)
            elif made := _characters(raw):
                text, lo, hi = made
                at = np.concatenate([np.arange(a, b) for a, b in lines])
                made = Layer(text, path, begin[at[lo * 8 // 6]], end[at[(hi * 8 - 1) // 6]])
            if made:
                yield made
                if not found or not found[2] and not found[3]:
                    done.append(place)
                break
    for m in _BASE64.finditer(layer.text):
        while done and done[0][1] <= m.start():
            done.pop(0)
        if done and done[0][0] <= m.start() and m.end() <= done[0][1]:
            continue
        if (raw := _decoded(m.group())) is None:
            continue
        below, inner = _unwrapped(layer, path, raw, m.span(), cut)
        if below != path:
            if made := _constant(layer, below, inner, m.span()):
                yield made
        elif made := _characters(raw):
            text, lo, hi = made
            yield Layer(text, path, begin[m.start() + lo * 8 // 6], end[m.start() + (hi * 8 - 1) // 6])


def findings(text: str | None) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, path) in the original's code points; path is empty in the text itself, else the unwrapping steps."""
    if not text:
        return []
    found = {(k, a, b): "" for k, a, b in matches(text)}
    cut: list = []
    work, seen = [Layer(text, "")], set()
    while work:
        layer = work.pop()
        if layer.path:
            for k, a, b in matches(layer.text):
                if layer.fresh is None or layer.fresh[a:b].any():
                    found.setdefault((k, *layer.span(a, b)), layer.path)
        peeled = _peeled(layer)
        inner = [peeled] if peeled else [x for x in (_percent(layer), _unicode(layer)) if x]
        for x in (*inner, *_base64(layer, cut), *_escaped(layer, cut)):
            if (known := x.key()) not in seen:
                seen.add(known)
                work.append(x)
    rows = [(k, a, b, p) for (k, a, b), p in found.items()] + [("truncated", a, b, p) for (a, b), p in cut]
    return sorted(rows, key=lambda r: (r[1], (*KINDS, "truncated").index(r[0]), r[2]))


def scanned(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``findings``, an array of (kind, start, end, path) ordered by start, then kind; empty for null and empty texts.

    A column of that name is replaced; all other columns and all rows, repeated ones too, stay.
    """
    @F.pandas_udf(FINDINGS)
    def scan(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "start": a, "end": b, "path": p} for k, a, b, p in findings(t)] for t in texts], dtype=object)

    return docs.withColumn("findings", scan(F.col(text_col).cast("string")))
