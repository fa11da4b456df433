"""Secrets in texts, also under layers of encoding.

A worklist holds layers of a text: the text itself, and what its URL escapes, Unicode escapes, base64
tokens and compressed base64 tokens decode to. Base64 is also read over line breaks and from inside a
run of its alphabet. Each layer is scanned and searched for further
encodings until nothing new turns up; a layer seen before is not opened again, so cycles end. Every
layer knows which characters of the text each of its own came from."""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, texts_of

# The kinds in their order, and the contract's patterns and least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")  # a maximal run of 24 or more is what [0-9a-f]+ finds there
LEAST_VALUE, LEAST_ACCESS = 6, 20

WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: A maximal run of these holds any hex run and any base64 token.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
BREAK = re.compile(r"[\r\n][ \t\r\n]*")
WORD = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
ALPHABET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
BETWEEN = re.compile("[/_-]")
MAGIC = re.compile(rb"\x1f\x8b\x08|\x78[\x01\x5e\x9c\xda]|BZh[1-9]|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
URL = re.compile("(?:%[0-9A-Fa-f]{2})+")
ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});")
PLUS = re.compile(r"\+")
#: Bytes as languages print them.
BYTE = re.compile(r"""\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})|\\([abfnrtv0\\'"])""")
ESCAPED = dict(zip("abfnrtv0\\'\"", (b"\a", b"\b", b"\f", b"\n", b"\r", b"\t", b"\v", b"\0", b"\\", b"'", b'"')))
PADDING = re.compile(rb"\0*")
#: A run of tokens or escapes, over line breaks, backwards.
LAST_RUN = re.compile(rb"[A-Za-z0-9+/_=.%\\{}&#;-]*+(?:[ \t]*+[\r\n][ \t\r\n]*+[A-Za-z0-9+/_=.%\\{}&#;-]++)*+")
#: A word, one of these, or sixteen of a run's characters stand in any bytes that hold a secret or a further encoding.
SIGN = re.compile(rb"%[0-9A-Fa-f]{2}|\\[uUx]|&#")
IN_RUN = bytes(120 if chr(c) in ALPHABET else 32 for c in range(256))
#: What a compressed layer is unpacked into at a time, and how much of it the next part repeats at least.
PART, OVERLAP = 1 << 20, 1 << 16
#: Bytes that an unpacker is given at a time.
CHUNK, ZSTD_CHUNK = 1 << 16, 1 << 8


@dataclass
class Layer:
    """starts and ends: for each character, the span in the text that it came from; None: itself.
    A whole layer that came from one token has the token's span. part: read from inside a run, so that
    what the token itself shows goes before it."""

    text: str
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None
    token: tuple[int, int] | None = None
    depth: int = 0
    part: bool = False

    def span(self, a: int, b: int) -> tuple[int, int]:
        if self.token:
            return self.token
        if self.starts is None:
            return a, b
        return int(self.starts[a]), int(self.ends[b - 1])


def find(text: str, runs: list[tuple[int, int]] | None = None) -> Iterator[tuple[str, int, int]]:
    """The secrets of a plain text: kind, start and end."""
    low = text.lower()
    if any(w in low for w in WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_VALUE:
                yield "assign", m.start(), m.end()
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= LEAST_ACCESS:
                yield "access", m.start(), m.end()
    for a, b in runs if runs is not None else [m.span() for m in RUN.finditer(text)]:
        if b - a >= 24:
            for m in HEX.finditer(text, a, b):
                yield "hex", m.start(), m.end()


def _member(data: bytes, at: int) -> Iterator[tuple[bytes, int | None]]:
    """The parts of the compressed member that begins at `at`, and where it ends once that is known.
    One that breaks off or is none ends with what came before."""
    first = data[at:at + 6]
    if first[:2] == b"\x1f\x8b" or first[:1] == b"\x78":
        opened = zlib.decompressobj(47)
    elif first[:3] == b"BZh":
        opened = bz2.BZ2Decompressor()
    elif first == b"\xfd7zXZ\x00":
        opened = lzma.LZMADecompressor()
    elif first[:4] == b"\x28\xb5\x2f\xfd":
        import zstandard

        opened = zstandard.ZstdDecompressor().decompressobj()
    else:
        return
    zlibs, fully = first[:1] in (b"\x1f", b"\x78"), hasattr(opened, "needs_input")
    step = CHUNK if zlibs or fully else ZSTD_CHUNK  # the last has no limit of its own
    try:
        while at < len(data):
            rest = data[at:at + step]
            at += len(rest)
            while True:
                part = opened.decompress(rest, PART) if zlibs or fully else opened.decompress(rest)
                rest = opened.unconsumed_tail if zlibs else b""
                yield part, at - len(opened.unused_data) if opened.eof else None
                if opened.eof:
                    return
                if opened.needs_input if fully else not rest and (not zlibs or len(part) < PART):
                    break
    except Exception:  # not what its first bytes promised
        return


def _inflated(data: bytes, at: int) -> Iterator[tuple[bytes, int | None]]:
    """The parts of the member that begins at `at` and of all that follow it, see `_member`."""
    while True:
        end = None
        for part, end in _member(data, at):
            yield part, end
        if end is None:
            return
        at = PADDING.match(data, end).end()


def _unfinished(data: bytearray) -> int:
    """Where that begins which more data may go on with: the last run, over line breaks, or a line with escaped bytes."""
    at = len(data) - LAST_RUN.match(data[::-1]).end()
    line = data.rfind(b"\n") + 1
    return min(at, line) if any(x in data[line:] for x in (b"%", b"\\x", b"\\u00")) else at


def _unpacked(data: bytes, at: int = 0) -> Iterator[str]:
    """The parts of a compressed layer, each with the end of the one before it: OVERLAP, and what is
    unfinished there, however long. Parts grow with what is carried, so that it is not read over and over."""
    tail, carried = bytearray(), 0
    for part, _ in _inflated(data, at):
        tail += part
        if len(tail) - carried >= max(PART, carried):
            yield tail.decode("utf-8", "replace")
            del tail[:max(0, min(len(tail) - OVERLAP, _unfinished(tail)))]
            carried = len(tail)
    if len(tail) > carried:
        yield tail.decode("utf-8", "replace")


def _ends(data: bytes, at: int = 0) -> int | None:
    """Where the compressed data that begins at `at` ends, if it does."""
    last = None
    for _, end in _inflated(data, at):
        last = end or last
    return last


def _streams(data: bytes) -> Iterator[tuple[int, int, Iterator[str]]]:
    """Compressed data that begins anywhere: from where to where, and its parts."""
    behind = 0
    for m in MAGIC.finditer(data):
        if m.start() >= behind:
            # if broken off, or noise, others may begin inside
            end = _ends(data, m.start())
            behind = end or m.start() + 1
            yield m.start(), end or len(data), _unpacked(data, m.start())


def _base64(token: str) -> bytes:
    """What a token decodes to; a character too many is left out."""
    bare = token.rstrip("=").replace("-", "+").replace("_", "/")
    bare = bare[:len(bare) - (len(bare) % 4 == 1)]
    return binascii.a2b_base64(bare + "=" * (-len(bare) % 4))


def _worth(data: bytes) -> bool:
    """Whether decoded bytes can hold a secret or a further encoding; noise hardly ever can."""
    low = data.lower()
    if any(w.encode() in low for w in WORDS) or b"AKIA" in data or b"x" * 16 in data.translate(IN_RUN):
        return True
    return any(c in data for c in (b"%", b"\\", b"&")) and SIGN.search(data) is not None


def _replaced(layer: Layer, line: tuple[int, int], pieces: list[tuple[int, int, str]]) -> Layer:
    """The layer's line with [a, b) of each piece replaced; replaced characters map to all of it."""
    a0, b0 = line
    out, starts, ends, at = [], [], [], a0
    of_start = layer.starts if layer.starts is not None else None

    def keep(a: int, b: int) -> None:
        out.append(layer.text[a:b])
        starts.append(np.arange(a, b) if of_start is None else layer.starts[a:b])
        ends.append(np.arange(a, b) + 1 if of_start is None else layer.ends[a:b])

    for a, b, text in pieces:
        keep(at, a)
        s, e = layer.span(a, b)
        out.append(text)
        starts.append(np.full(len(text), s))
        ends.append(np.full(len(text), e))
        at = b
    keep(at, b0)
    return Layer("".join(out), np.concatenate(starts), np.concatenate(ends), layer.token, layer.depth + 1, layer.part)


def _escape(m: re.Match) -> str:
    code = int(m[6]) if m[6] else int(next(g for g in m.groups()[:5] if g), 16)
    return chr(code) if code <= 0x10FFFF and not 0xD800 <= code < 0xE000 else m[0]


def _escaped_byte(m: re.Match) -> bytes:
    code = m[1] or m[2]
    return bytes.fromhex(code) if code else ESCAPED[m[3]]


def _bytewise(a: int, b: int, data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """The pieces of a run of escapes of three characters, a byte each."""
    return ((a + 3 * i, a + 3 * i + 3, data[i:i + 1]) for i in range((b - a) // 3))


def _surrogates(pieces: list[tuple[int, int, str]], text: str) -> list[tuple[int, int, str]]:
    """Two \\u escapes of a surrogate pair, side by side, are one character."""
    out: list[tuple[int, int, str]] = []
    for a, b, t in pieces:
        if out and out[-1][1] == a and t == text[a:b]:
            high, low = out[-1][2], t
            if re.fullmatch(r"\\u[dD][89abAB][0-9A-Fa-f]{2}", high) and re.fullmatch(r"\\u[dD][c-fC-F][0-9A-Fa-f]{2}", low):
                code = 0x10000 + ((int(high[2:], 16) - 0xD800) << 10) + int(low[2:], 16) - 0xDC00
                out[-1] = (out[-1][0], b, chr(code))
                continue
        out.append((a, b, t))
    return [(a, b, t) for a, b, t in out if t != text[a:b]]


def _lines(text: str, pieces: list[tuple[int, int, str]]) -> Iterator[tuple[tuple[int, int], list]]:
    """The pieces by the line they stand in: no secret reaches over a line end."""
    mine: list = []
    line = (0, -1)
    for p in pieces:
        if p[0] > line[1]:
            if mine:
                yield line, mine
            end = text.find("\n", p[0])
            line, mine = (text.rfind("\n", 0, p[0]) + 1, len(text) if end < 0 else end), []
        mine.append(p)
    if mine:
        yield line, mine


def chains(text: str, runs: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """The runs, and those of any length that only line breaks and indentation separate, together."""
    joined: set[int] = set()
    chain: list[tuple[int, int]] = []
    for m in BREAK.finditer(text):
        end, start = m.start(), m.end()
        while end and text[end - 1] in " \t":
            end -= 1
        if not end or start == len(text) or text[end - 1] not in ALPHABET or text[start] not in ALPHABET:
            continue
        if not chain or chain[-1][1] != end:
            if chain:
                yield chain
            first = end
            while first and text[first - 1] in ALPHABET:
                first -= 1
            chain = [(first, end)]
            joined.add(first)
        chain.append((start, WORD.match(text, start).end()))
        joined.add(start)
    if chain:
        yield chain
    for a, b in runs:
        if a not in joined:
            yield [(a, b)]


def _blocks(text: str, chain: list[tuple[int, int]]) -> Iterator[tuple[list[tuple[int, int]], bytes]]:
    """Tokens that are wrapped as encoders do, and what they decode to: lines of one width, a shorter
    one behind them, or before them where something else stood on its line."""
    width = [b - a for a, b in chain]
    i = 0
    while i < len(chain):
        j = i + 1
        if j + 1 < len(chain) and 16 <= width[i] < width[j] and text[chain[i][1] - 2:chain[i][1]] != "--":
            j += 1
        w = width[j - 1]
        while j < len(chain) and width[j] == w:
            j += 1
        j += j < len(chain) and width[j] < w
        data = _base64("".join(text[a:b] for a, b in chain[i:j]))
        if j - i > 1:
            keep = j
            try:
                data.decode()
            except UnicodeDecodeError as e:
                # a word on the line behind a token, or tokens of their own on each line
                if e.start * 8 // 6 >= sum(width[i:j - 1]) - 2:
                    keep = j - 1
                elif e.start and width[i] % 4:
                    keep = i + 1
            if MAGIC.match(data):
                ends, keep = ((_ends(data) or len(data)) * 8 + 5) // 6, i
                while keep < j and ends > 0:
                    ends -= width[keep]
                    keep += 1
            if keep != j:
                j = keep
                data = _base64("".join(text[a:b] for a, b in chain[i:j]))
        yield chain[i:j], data
        i = j


def _tokens(layer: Layer, chain: list[tuple[int, int]]) -> Iterator[Layer]:
    """What a chain decodes to: each of its tokens, and all of it from each of four characters on, for
    tokens that begin inside. The spans of the latter reach from one of / - _ or a line end to the next."""
    text, depth = layer.text, layer.depth + 1
    if sum(b - a for a, b in chain) < 16:
        return
    whole = False
    for block, data in _blocks(text, chain):
        whole = len(block) == len(chain)
        a, b = block[0][0], block[-1][1]
        if b - a < 16 or not data:
            continue
        span = layer.span(a, b)
        if _worth(data):
            # a character a byte: no byte, whatever the text's encoding, hides those beside it
            yield Layer(data.decode("latin-1"), token=span, depth=depth, part=layer.part)
        for below in _unpacked(data):
            yield Layer(below, token=span, depth=depth, part=layer.part)
    joined = "".join(text[a:b] for a, b in chain)
    bounds = None
    for shift in range(whole, 4):
        data = _base64(joined[shift:])
        plain = _worth(data)
        if not plain and not MAGIC.search(data):
            continue
        if layer.token:
            if plain:
                yield Layer(data.decode("latin-1"), token=layer.token, depth=depth, part=True)
            for _, _, parts in _streams(data):
                yield from (Layer(below, token=layer.token, depth=depth, part=True) for below in parts)
            continue
        if bounds is None:
            # of each character of the chain: the first and the last of its piece, in the layer's text
            sizes = [b - a for a, b in chain]
            at = np.concatenate([np.arange(a, b) for a, b in chain])
            cuts = np.union1d(np.cumsum(sizes), [m.start() for m in BETWEEN.finditer(joined)]).astype(np.int64)
            firsts = np.union1d(np.cumsum([0, *sizes[:-1]]), [m.end() for m in BETWEEN.finditer(joined)]).astype(np.int64)
            bounds = at, firsts, cuts

        def place(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Spans of the bytes first to last."""
            at, firsts, cuts = bounds
            c, d = shift + first * 8 // 6, np.minimum(shift + (last * 8 + 7) // 6, len(joined) - 1)
            s = at[firsts[np.searchsorted(firsts, c, "right") - 1]]
            e = at[np.maximum(cuts[np.minimum(np.searchsorted(cuts, d, "right"), len(cuts) - 1)] - 1, d)] + 1
            return (s, e) if layer.starts is None else (layer.starts[s], layer.ends[e - 1])

        if plain:
            every = np.arange(len(data))
            starts, ends = place(every, every)
            yield Layer(data.decode("latin-1"), starts, ends, depth=depth, part=True)
        for first, end, parts in _streams(data):
            s, e = place(np.array([first]), np.array([end - 1]))
            for below in parts:
                yield Layer(below, token=(int(s[0]), int(e[0])), depth=depth, part=True)


def _escaped_streams(layer: Layer, line: tuple[int, int], pieces: list[tuple[int, int, bytes]]) -> Iterator[Layer]:
    """Compressed data among a line's bytes, some of which are escaped."""
    a0, b0 = line
    a, b = (np.array(x, np.int64) - a0 for x in list(zip(*pieces))[:2])
    data = np.frombuffer(layer.text[a0:b0].encode("latin-1", "replace"), np.uint8).copy()
    data[a] = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    end = np.arange(1, len(data) + 1)
    end[a] = b
    inside = np.zeros(len(data) + 1, np.int64)
    np.add.at(inside, a + 1, 1)
    np.add.at(inside, b, -1)
    start = np.flatnonzero(np.cumsum(inside[:-1]) == 0)
    data, end, start = data[start].tobytes(), end[start] + a0, start + a0
    if MAGIC.search(data):
        for first, last, parts in _streams(data):
            span = layer.span(int(start[first]), int(end[last - 1]))
            for below in parts:
                yield Layer(below, token=span, depth=layer.depth + 1, part=layer.part)


def unwrap(layer: Layer, runs: list[tuple[int, int]]) -> Iterator[Layer]:
    """The layers right below this one."""
    text = layer.text
    if "%" in text:
        found = [(m.start(), m.end(), binascii.unhexlify(m[0].replace("%", ""))) for m in URL.finditer(text)]
        for line, mine in _lines(text, [(a, b, data.decode("utf-8", "replace")) for a, b, data in found]):
            yield _replaced(layer, line, mine)
        for line, mine in _lines(text, [p for a, b, data in found for p in _bytewise(a, b, data)]):
            yield from _escaped_streams(layer, line, mine)
            if "+" in text[slice(*line)]:  # a form's space
                spaces = [(m.start(), m.end(), b" ") for m in PLUS.finditer(text, *line)]
                yield from _escaped_streams(layer, line, sorted(mine + spaces))
    if "\\" in text or "&#" in text:
        pieces = _surrogates([(m.start(), m.end(), _escape(m)) for m in ESCAPE.finditer(text)], text)
        for line, mine in _lines(text, pieces):
            yield _replaced(layer, line, mine)
    if "\\x" in text or "\\u00" in text:
        for line, mine in _lines(text, [(m.start(), m.end(), _escaped_byte(m)) for m in BYTE.finditer(text)]):
            yield from _escaped_streams(layer, line, mine)
    for chain in chains(text, runs):
        yield from _tokens(layer, chain)


def _settled(found: dict[tuple[int, str, int], list[tuple[str, bool]]]) -> set[tuple[int, str, int]]:
    """The spans, without those of parts whose secret a span of a whole token around or inside has."""
    whole = {k: [(s, e, v) for (s, kind, e), values in found.items() if kind == k for v, part in values if not part] for k in KINDS}
    out = set()
    for k in KINDS:
        mine = sorted(whole[k])
        starts = [s for s, _, _ in mine]
        far = np.maximum.accumulate([e for _, e, _ in mine]) if mine else []

        def told(s: int, e: int, value: str) -> bool:
            for i in range(bisect_left(starts, e) - 1, -1, -1):
                if far[i] <= s:
                    return False
                a, b, v = mine[i]
                if (a <= s and e <= b or s <= a and b <= e) and (v in value or value in v):
                    return True
            return False

        out |= {x for x, values in found.items() if x[1] == k and not all(part and told(x[0], x[2], v) for v, part in values)}
    return out


def scan(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(start, kind, end) of what the text itself holds, and of what the layers below add."""
    base: list[tuple[int, str, int]] = []
    added: dict[tuple[int, str, int], list[tuple[str, bool]]] = {}
    seen: set[bytes] = set()

    def scanned(layer: Layer) -> list[tuple[int, int]]:
        runs = [m.span() for m in RUN.finditer(layer.text)]
        for kind, a, b in find(layer.text, runs):
            if layer.depth:
                s, e = layer.span(a, b)
                added.setdefault((s, kind, e), []).append((layer.text[a:b], layer.part))
            else:
                base.append((a, kind, b))
        return runs

    top = Layer(text)
    work = [unwrap(top, scanned(top))]
    while work:
        below = next(work[-1], None)
        if below is None:
            work.pop()
            continue
        # the same text at another place is another layer
        mark = hashlib.blake2b(repr(below.span(0, len(below.text)) if below.text else 0).encode() + below.text.encode("utf-8", "replace"), digest_size=16).digest()
        if below.text and mark not in seen:
            seen.add(mark)
            work.append(unwrap(below, scanned(below)))
    def order(s):
        return s[0], KINDS.index(s[1]), s[2]
    return sorted(base, key=order), sorted(_settled(added) - set(base), key=order)


SPANS = "array<struct<kind: string, start: long, end: long, hidden: boolean>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("hidden", pa.bool_())])


def _found(text: str) -> list[dict]:
    base, added = scan(text)
    both = [(s, k, e, False) for s, k, e in base] + [(s, k, e, True) for s, k, e in added]
    return [{"kind": k, "start": s, "end": e, "hidden": h} for s, k, e, h in sorted(both, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))]


def _spans(batches):
    for ids, texts in slices(batches):
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([_found(t.decode()) for t in texts], pa.list_(_SPAN))], ["doc_id", "spans"])


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end, hidden) of each row of docs(doc_id, text), in order of
    start, kind and end. Positions count code points of the text; `hidden` ones lie in a layer below,
    and cover the characters that it came from. A null or empty text has none; null doc_ids and
    repeated rows stay; other columns are ignored. Rows need no shuffle."""
    return texts_of(docs).mapInArrow(_spans, f"doc_id long, spans {SPANS}")


def blacked_out(text: str, by: str) -> str:
    out, at = [], 0
    for s in _found(text):
        if s["end"] > at:
            if s["start"] >= at:
                out += [text[at:s["start"]], by]
            at = s["end"]
    return "".join([*out, text[at:]])


def without_secrets(docs: DataFrame, by: str = "[SECRET]") -> DataFrame:
    """docs with each secret of `text`, also a hidden one, replaced; overlapping spans are replaced
    together. Nulls stay null, other columns as they are, n_chars (if there) follows the text."""
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: blacked_out(t, by), na_action="ignore")

    out = docs.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def digest(spans: DataFrame) -> DataFrame:
    """The contract's columns of `secret_spans`."""
    def joined(of):
        return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def of_kind(kind):
        return F.size(F.filter(plain, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    plain = F.filter("spans", lambda s: ~s.hidden)
    return spans.select("doc_id", *map(of_kind, KINDS), F.sha2(joined(plain), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
