"""Secret scans through nested encodings: a worklist of decoded layers with spans mapped to the original text."""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import named, small_batches

#: A compressed layer over this many bytes is reported as ``oversized_layer`` instead of being unwrapped, as it could fill a worker's memory.
LAYER_BYTES = 64 << 20
#: Layers whose characters all have the span of their block.
PACKED = {"gzip", "zlib", "bzip2", "xz", "zstd", "deflate"}
#: Bits a character that the value of an assignment has at least.
ENTROPY = 2.5

#: Rules: name, what a text must contain in lower case, pattern; group 1, where there is one, is the secret.
RULES: list[tuple[str, tuple[str, ...], re.Pattern]] = [
    ("aws_access_key", ("akia", "asia"), re.compile(r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])")),
    ("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_"), re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})")),
    ("slack_token", ("xox",), re.compile(r"(?<![A-Za-z0-9])xox[abeprs]-[A-Za-z0-9-]{10,}")),
    ("google_api_key", ("aiza",), re.compile(r"(?<![A-Za-z0-9])AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])")),
    ("payment_key", ("sk_live_", "rk_live_"), re.compile(r"(?<![A-Za-z0-9])[sr]k_live_[0-9A-Za-z]{16,}")),
    ("private_key", ("private key",), re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----[\sA-Za-z0-9+/=:,-]*?-----END (?:[A-Z0-9]+ )*PRIVATE KEY-----|-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY-----")),
    ("json_web_token", ("eyj",), re.compile(r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
    ("password_in_url", ("://",), re.compile(r"[a-zA-Z][a-zA-Z0-9+.-]{1,20}://[^\s:/@'\"]{1,256}:([^\s:/@'\"]{3,256})@[\w.-]+")),
    ("assigned_secret", ("token", "secret", "passw", "pwd", "api_key", "apikey", "api-key", "access_key", "credential"), re.compile(r"(?i)(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|credential)s?[\"']?\s*(?::=|[:=])\s*(?:[\"']([^\s\"']{12,})[\"']|([A-Za-z0-9_+/=.-]{16,}))")),
]

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_UNICODE = re.compile(r"(?:\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|%u[0-9A-Fa-f]{4}|&#[xX][0-9A-Fa-f]{1,6};|&#[0-9]{1,7};)+")
_ONE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|%u([0-9A-Fa-f]{4})|&#[xX]([0-9A-Fa-f]+);|&#([0-9]+);")
_RUN = re.compile(r"[A-Za-z0-9+/_-]+(?:\r?\n[A-Za-z0-9+/_-]+)*={0,2}")
_AFTER = re.compile(r"[/_-]")
#: Letters that a run has at least, and characters of readable text in a row that its bytes must show.
RUN, READABLE = 16, 12
#: Bytes as x where they are printable ASCII.
_SHOWN = bytes(120 if 32 <= b < 127 else 32 for b in range(256))
_HIDDEN = re.compile(r"[^\t\n\r\x20-\x7e\xa0-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
_UTF16 = (re.compile(rb"(?:[\t\n\r\x20-\x7e]\0){%d,}" % READABLE), re.compile(rb"(?:\0[\t\n\r\x20-\x7e]){%d,}" % READABLE))
_MAGIC = re.compile(rb"(?=\x1f\x8b\x08|[\x08\x18\x28\x38\x48\x58\x68\x78]|BZh[1-9]|\xfd7zXZ\0|\x28\xb5\x2f\xfd)")


@dataclass
class Layer:
    """A decoded text. ``starts`` and ``ends`` hold, for each character, the span of the original text that it comes from; None means itself."""

    text: str
    path: tuple[str, ...]
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    def span(self, a: int, b: int) -> tuple[int, int]:
        """The original span of characters a to b - 1, of which there is one at least."""
        if self.starts is None:
            return a, b
        return int(self.starts[a:b].min()), int(self.ends[a:b].max())

    def spans(self) -> tuple[np.ndarray, np.ndarray]:
        if self.starts is None:
            at = np.arange(len(self.text), dtype=np.int64)
            return at, at + 1
        return self.starts, self.ends


def _rebuilt(layer: Layer, name: str, parts: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Layer:
    """The layer with stretches replaced: ``(from, to, [(character, its from, its to)])``."""
    starts, ends = layer.spans()
    text, s, e, at = [], [], [], 0
    for a, b, chars in parts:
        text.append(layer.text[at:a])
        s.append(starts[at:a])
        e.append(ends[at:a])
        text.append("".join(c for c, _, _ in chars))
        s.append(np.array([starts[x:y].min() for _, x, y in chars], np.int64))
        e.append(np.array([ends[x:y].max() for _, x, y in chars], np.int64))
        at = b
    text.append(layer.text[at:])
    return Layer("".join(text), (*layer.path, name), np.concatenate([*s, starts[at:]]), np.concatenate([*e, ends[at:]]))


def _percent(layer: Layer) -> Iterator[Layer]:
    """The layer with percent escapes decoded, where a run of them is UTF-8."""
    if "%" not in layer.text:
        return
    parts = []
    for m in _PERCENT.finditer(layer.text):
        try:
            found = bytes.fromhex(m[0].replace("%", "")).decode()
        except UnicodeDecodeError:
            continue
        chars, at = [], m.start()
        for c in found:
            size = 3 * len(c.encode())
            chars.append((c, at, at + size))
            at += size
        parts.append((m.start(), m.end(), chars))
    if parts:
        yield _rebuilt(layer, "url", parts)


def _unicode(layer: Layer) -> Iterator[Layer]:
    """The layer with Unicode escapes decoded; surrogate pairs become one character."""
    if "\\" not in layer.text and "%u" not in layer.text and "&#" not in layer.text:
        return
    parts = []
    for m in _UNICODE.finditer(layer.text):
        chars: list[tuple[str, int, int]] = []
        for one in _ONE.finditer(m[0]):
            code = int(one[7]) if one[7] else int(next(g for g in one.groups() if g), 16)
            a, b = m.start() + one.start(), m.start() + one.end()
            if 0xDC00 <= code < 0xE000 and chars and 0xD800 <= ord(chars[-1][0]) < 0xDC00:
                c, x, _ = chars.pop()
                chars.append((chr(0x10000 + ((ord(c) - 0xD800) << 10) + code - 0xDC00), x, b))
            elif code <= 0x10FFFF:
                chars.append((chr(code), a, b))
            else:
                chars += [(x, a + k, a + k + 1) for k, x in enumerate(one[0])]
        parts.append((m.start(), m.end(), chars))
    if parts:
        yield _rebuilt(layer, "unicode", parts)


def _inflated(raw: bytes) -> tuple[str, bytes | None] | None:
    """Name and content of a compressed block, of all its members; a content of None is over LAYER_BYTES. What follows the last sound member is ignored."""
    if raw[:2] == b"\x1f\x8b":
        name, fresh = "gzip", lambda: zlib.decompressobj(31)
    elif len(raw) > 6 and raw[0] & 15 == 8 and raw[0] >> 4 <= 7 and int.from_bytes(raw[:2]) % 31 == 0:
        name, fresh = "zlib", zlib.decompressobj
    elif raw[:3] == b"BZh":
        name, fresh = "bzip2", bz2.BZ2Decompressor
    elif raw[:6] == b"\xfd7zXZ\0":
        name, fresh = "xz", lzma.LZMADecompressor
    elif raw[:4] == b"\x28\xb5\x2f\xfd":
        name, fresh = "zstd", None
    else:
        return None
    parts, size = [], 0
    while raw and size <= LAYER_BYTES:
        try:
            if fresh is None:
                out, raw = _frames(raw), b""
            else:
                engine = fresh()
                out = engine.decompress(raw, LAYER_BYTES + 1 - size)
                raw = engine.unused_data
        except (OSError, ValueError, EOFError, zlib.error, lzma.LZMAError, zstandard.ZstdError):
            break
        parts.append(out)
        size += len(out)
        if name in ("gzip", "xz"):
            raw = raw.lstrip(b"\0")  # padding between members
    if not parts:
        return None
    return name, b"".join(parts) if size <= LAYER_BYTES else None


def _frames(raw: bytes) -> bytes:
    """The content of all Zstandard frames up to what is unsound, not far over LAYER_BYTES, as the input is fed in small pieces."""
    parts, size, at, engine = [], 0, 0, None
    while at < len(raw) and size <= LAYER_BYTES:
        engine = engine or zstandard.ZstdDecompressor().decompressobj()
        piece = raw[at : at + 256]
        try:
            parts.append(engine.decompress(piece))
        except zstandard.ZstdError:
            break
        size += len(parts[-1])
        at += len(piece)
        if engine.eof:
            at, engine = at - len(engine.unused_data), None
    return b"".join(parts)


def _deflated(raw: bytes) -> tuple[str, bytes | None] | None:
    """The same for a stream of deflate without a header, which must end and hold readable text."""
    engine = zlib.decompressobj(-15)
    try:
        out = engine.decompress(raw, LAYER_BYTES + 1)
    except zlib.error:
        return None
    if len(out) > LAYER_BYTES:
        return "deflate", None
    return ("deflate", out) if engine.eof and _readable(out) else None


def _readable(raw: bytes) -> bool:
    """Whether the bytes show readable text anywhere: a secret and any encoding of one do."""
    if b"x" * READABLE in raw.translate(_SHOWN):
        return True
    try:
        text = raw.decode()
    except UnicodeDecodeError:
        return False
    return len(raw) >= READABLE and not _HIDDEN.search(text)


def _texts_of(raw: bytes) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Texts in bytes, with the first and last byte of each character: as UTF-8 with blanks for what isn't text, and as UTF-16."""
    if _readable(raw):
        text = raw.decode(errors="surrogateescape")
        sizes = np.ones(len(text), np.int64) if len(text) == len(raw) else np.array([len(c.encode(errors="surrogateescape")) for c in text], np.int64)
        first = np.cumsum(sizes) - sizes
        yield _HIDDEN.sub(" ", text), first, first + sizes - 1
    if b"\0" in raw:
        for p, pattern in enumerate(_UTF16):
            at = [i for m in pattern.finditer(raw) for i in range(m.start() + p, m.end(), 2)]
            if at:
                first = np.array(at, np.int64)
                yield "".join(chr(raw[i]) for i in at), first - p, first - p + 1


def _unpacked(raw: bytes, starts: Iterable[int]) -> Iterator[tuple[tuple[str, ...], str | None]]:
    """Names and text of the compressed blocks that start anywhere in the bytes, or, without a header, at ``starts``; a text of None is too large."""
    seen, work = {raw}, deque([(raw, (), list(starts))])
    while work:
        data, path, bare = work.popleft()
        found = [_inflated(data[m.start() :]) for m in _MAGIC.finditer(data)] + [_deflated(data[s:]) for s in bare]
        for name, inner in filter(None, found):
            if inner is None:
                yield (*path, name), None
            elif inner not in seen:
                seen.add(inner)
                work.append((inner, (*path, name), [0]))
                for text, _, _ in _texts_of(inner):
                    yield (*path, name), text


def _base64(layer: Layer) -> Iterator[Layer | tuple[int, int, str]]:
    """Layers of the base64 blocks that hold text, or compressed blocks down to text. A block that is too large gives a span instead.

    A block may stand after a path or label and before other letters, and in lines of any width: a run of its
    letters is read from each of its first four, so from any place in it in step with the block.
    """
    starts, ends = layer.spans() if layer.starts is not None else (None, None)
    for m in _RUN.finditer(layer.text):
        if m.end() - m.start() < RUN:
            continue
        body = m[0].rstrip("=")
        where = np.arange(m.start(), m.start() + len(body), dtype=np.int64)
        if "\n" in body:
            where = where[[c not in "\r\n" for c in body]]
            body = body.replace("\r", "").replace("\n", "")
        if len(body) < RUN:
            continue
        letters = body.replace("-", "+").replace("_", "/")
        bare = {0, *(x.end() for x in _AFTER.finditer(body))}
        for k in range(4):
            rest = letters[k:]
            rest = rest[: len(rest) - (len(rest) % 4 == 1)]
            raw = base64.b64decode(rest + "=" * (-len(rest) % 4))
            at = where[k:]
            for text, first, last in _texts_of(raw):
                # byte i lies in base64 characters 4i/3 to 4i/3 + 1
                a, b = at[first * 8 // 6], at[np.minimum((last * 8 + 7) // 6, len(at) - 1)]
                yield Layer(text, (*layer.path, "base64"), a if starts is None else starts[a], b + 1 if ends is None else ends[b])
            a, b = layer.span(int(where[0]), int(where[-1]) + 1)
            for path, text in _unpacked(raw, [(s - k) * 3 // 4 for s in bare if s >= k and (s - k) % 4 == 0]):
                path = (*layer.path, "base64", *path)
                if text is None:
                    yield a, b, ">".join(path)
                else:
                    yield Layer(text, path, np.full(len(text), a, np.int64), np.full(len(text), b, np.int64))


def entropy(value: str) -> float:
    """Bits a character of a string's own distribution."""
    counts = np.unique(np.array(list(value)), return_counts=True)[1] / len(value)
    return float(-(counts * np.log2(counts)).sum())


def _matches(text: str) -> Iterator[tuple[str, int, int]]:
    low = text.lower()
    for name, needed, pattern in RULES:
        if not any(n in low for n in needed):
            continue
        for m in pattern.finditer(text):
            group = m.lastindex or 0
            if name != "assigned_secret" or entropy(m[group]) >= ENTROPY:
                yield name, m.start(group), m.end(group)


def scan(text: str) -> list[tuple[str, int, int, str, str]]:
    """``(rule, start, end, layers, digest)`` of a text: each secret with its span in the text and the layers around it.

    The worklist starts with the text. Each layer is scanned, then decoded in every way that applies; what comes
    out is queued unless the same text was reached from the same span before, so encodings that decode to
    themselves or to each other end. A secret that several layers show at the same span is reported once, in the
    outermost; different secrets of one compressed block have the same span and are reported each.
    """
    found: dict[tuple[str, int, int, str], tuple[str, str]] = {}
    work, seen = deque([Layer(text, ())]), {(hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest(), 0, len(text))}
    while work:
        layer = work.popleft()
        for rule, a, b in _matches(layer.text):
            digest = hashlib.sha256(layer.text[a:b].encode("utf-8", "surrogatepass")).hexdigest()[:16]
            found.setdefault((rule, *layer.span(a, b), digest if PACKED & {*layer.path} else ""), (">".join(layer.path), digest))
        for way in (_percent, _unicode, _base64):
            for inner in way(layer):
                if isinstance(inner, tuple):
                    found.setdefault(("oversized_layer", inner[0], inner[1], ""), (inner[2], ""))
                elif inner.text:
                    key = (hashlib.sha256(inner.text.encode("utf-8", "surrogatepass")).digest(), *inner.span(0, len(inner.text)))
                    if key not in seen:
                        seen.add(key)
                        work.append(inner)
    return [(rule, a, b, path, digest) for (rule, a, b, _), (path, digest) in sorted(found.items(), key=lambda x: (x[0][1], x[0][2], x[0][0], x[0][3]))]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, rule, start, end, layers, digest`` for every secret: span in the whole text (from 0, end excluded), enclosing layers, outermost first, and the start of its SHA-256.

    Null and empty texts have none. Repeated rows are reported each. The secret itself isn't in the result.
    Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("array<struct<rule:string,start:long,end:long,layers:string,digest:string>>")
    def spans(text: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("rule", "start", "end", "layers", "digest"), x, strict=True)) for x in scan(t)] if t else [] for t in text], dtype=object)

    def at(c: str) -> Column:
        return F.col(f"f.{c}").alias(c)

    return docs.select(F.col(named(id_col)).alias("doc_id"), F.explode(spans(F.col(named(text_col)))).alias("f")).select("doc_id", *map(at, ("rule", "start", "end", "layers", "digest")))
