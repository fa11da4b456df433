"""Passages that an earlier document holds already, removed by repeated-phrase automata.

A window is `WIDTH` words in a row. Of the hashes of the `GRAM`-word runs in a window the smallest is
its anchor, so equal windows have equal anchors, wherever they stand.

1. Blocks of documents ask hash buckets which of their anchors occur in two documents.
2. Windows with such an anchor go to the buckets as text; those found in two documents are confirmed
   recurring passages, and each block learns the smallest doc_id of its own.
3. Windows one after another make passages. Each block compiles its passages to Aho-Corasick
   automata, in shards of bounded size, and streams all its documents through them: every
   occurrence of a passage whose windows smaller doc_ids hold is removed. A hash only proposes; what is removed has been compared word by word."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import asked, block_number, slices, squeezed, stored, text_bytes, texts_of, unsqueezed

# Fixed value of the contract.
WIDTH = 13
#: Words of a run whose hash may be an anchor.
GRAM = 7
#: Text bytes of a block, and for each bucket.
BLOCK_BYTES, BUCKET_BYTES = 2 << 20, 16 << 20
#: Words of the passages in one automaton.
SHARD_WORDS = 300_000
#: Bytes whose words are hashed at a time.
HASH_BYTES = 1 << 20

#: Bits of a hash that give way to a place within a window.
PLACE_BITS = 3

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
# Odd, so that their powers have inverses modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_powers: list[np.ndarray] = []


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word of data, by sums over its bytes times powers of a base."""
    if not _powers:
        for base in (BASE, BASE_INVERSE):
            steps = np.full(HASH_BYTES + 1, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + HASH_BYTES)
        if end < len(data):  # back to the last space, if there is one
            some = np.frombuffer(data, np.uint8, end - at, at)
            spaces = np.flatnonzero(SPACE[some])
            if not len(spaces):
                word = data[at:].split(None, 1)[0]
                out.append(np.frombuffer(hashlib.blake2b(word, digest_size=8).digest(), np.uint64))
                at += len(word)
                continue
            end = at + int(spaces[-1]) + 1
        some = np.frombuffer(data, np.uint8, end - at, at)
        edges = np.diff(np.concatenate([[True], SPACE[some], [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum((some.astype(np.uint64) + np.uint64(1)) * _powers[0][:len(some)])])
        out.append(_mixed((sums[ends] - sums[starts]) * _powers[1][starts]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


class Windows:
    """The windows of some documents: which document each is of, where it starts (counted over all
    the documents' words), and its anchor's hash and place."""

    def __init__(self, texts: list[bytes]):
        self.words = [t.split() for t in texts]
        self.sizes = np.fromiter(map(len, self.words), np.int64, len(texts))
        self.firsts = np.concatenate([[0], np.cumsum(self.sizes)])
        hashes = word_hashes(b"\n".join(texts))
        if len(hashes) != self.firsts[-1]:
            raise AssertionError("words and hashes do not agree")
        n = len(hashes) - WIDTH + 1
        doc = np.repeat(np.arange(len(texts)), self.sizes)
        if n <= 0:
            self.starts = self.doc = self.place = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        grams = len(hashes) - GRAM + 1
        value = np.zeros(grams, np.uint64)
        for j in range(GRAM):
            value = (value ^ hashes[j:grams + j]) * BASE + np.uint64(j)
        value = _mixed(value)
        # the place within a window in the lowest bits, so that one minimum finds hash and place
        reach = WIDTH - GRAM + 1
        low = np.uint64((1 << PLACE_BITS) - 1)
        value = value & ~low
        least = value[:n].copy()
        for j in range(1, reach):
            np.minimum(least, value[j:n + j] | np.uint64(j), out=least)
        self.starts = np.flatnonzero(doc[:n] == doc[WIDTH - 1:])
        least = least[self.starts]
        self.doc, self.anchor, self.place = doc[self.starts], least & ~low, self.starts + (least & low).astype(np.int64)

    def asks(self) -> np.ndarray:
        """The distinct anchors in order; their last bit says whether two documents here have it."""
        if not len(self.anchor):
            return np.zeros(0, np.uint64)
        # windows one after another mostly have the same anchor, and documents stay in order
        new = np.flatnonzero(np.concatenate([[True], self.place[1:] != self.place[:-1]]))
        values = self.anchor[new] >> np.uint64(1)
        order = np.argsort(values, kind="stable")
        values, doc = values[order], self.doc[new][order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        last = np.concatenate([first[1:], [len(values)]]) - 1
        return values[first] << np.uint64(1) | (doc[first] != doc[last]).astype(np.uint64)


def _boxed(ids: list, texts: list[bytes]) -> bytes:
    head = np.array([len(texts)], np.int64).tobytes()
    known = np.array([i is not None for i in ids], np.int8).tobytes()
    sizes = np.array([len(t) for t in texts], np.int64).tobytes()
    return zstandard.ZstdCompressor(6).compress(b"".join([head, np.array([i or 0 for i in ids], np.int64).tobytes(), sizes, known, *texts]))


def _unboxed(data: bytes) -> tuple[list, list[bytes]]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int(np.frombuffer(data, np.int64, 1)[0])
    ids, sizes = (np.frombuffer(data, np.int64, n, 8 + 8 * n * i) for i in (0, 1))
    known = np.frombuffer(data, np.int8, n, 8 + 16 * n)
    ends = np.cumsum(sizes) + 8 + 17 * n
    return [int(i) if k else None for i, k in zip(ids, known)], [data[e - s:e] for e, s in zip(ends.tolist(), sizes.tolist())]


def _bucket_of(anchors: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending with the anchor."""
    return ((anchors >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


_ASK = pa.list_(pa.struct([("bucket", pa.int32()), ("data", pa.binary())]))
_ASK_DDL = "array<struct<bucket: int, data: binary>>"


def _split(buckets: np.ndarray):
    """Where each bucket's part of ascending bucket numbers begins and ends."""
    edges = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]])) if len(buckets) else np.zeros(1, np.int64)
    return [(int(buckets[a]), int(a), int(b)) for a, b in zip(edges[:-1], edges[1:])]


def _blocks(buckets: int):
    def make(batches):
        numbers = block_number()
        for ids, texts in slices(batches, BLOCK_BYTES):
            anchors = Windows(texts).asks()
            asks = [{"bucket": k, "data": squeezed(anchors[a:b])} for k, a, b in _split(_bucket_of(anchors, buckets))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([next(numbers)], pa.int64()), pa.array([_boxed(ids, texts)], pa.binary()), pa.array([asks], _ASK)], ["block", "docs", "asks"])

    return make


def _recurring(table: pa.Table) -> pa.Table:
    """For each block's anchors of a bucket, a bit each: whether two documents have it."""
    asks = [unsqueezed(d) for d in table.column("data").to_pylist()]
    values, where, counts = np.unique(np.concatenate(asks) >> np.uint64(1), return_inverse=True, return_counts=True)
    flags = np.concatenate(asks) & np.uint64(1)
    often = (counts > 1) | (np.bincount(where, weights=flags, minlength=len(values)) > 0)
    bits, at = [], 0
    for a in asks:
        bits.append(np.packbits(often[where[at:at + len(a)]]).tobytes())
        at += len(a)
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "data": pa.array(bits, pa.binary())})


class Stretches:
    """The windows of a block with a recurring anchor, those of one anchor in a row as one stretch of
    text. Equal stretches are listed once, ascending by anchor, with the least and the largest doc_id."""

    def __init__(self, ids: list, texts: list[bytes], buckets: int, answers: list):
        self.windows = w = Windows(texts)
        anchors = w.asks()
        bits = [np.unpackbits(np.frombuffer(a["data"], np.uint8), count=b - s) for a, (_, s, b) in zip(answers or (), _split(_bucket_of(anchors, buckets)))]
        often = anchors[np.concatenate(bits).astype(bool)] >> np.uint64(1) if bits else np.zeros(0, np.uint64)
        known = np.array([i is not None for i in ids], bool)
        # the windows of one anchor in a row: where each run begins and ends among all windows
        new = np.flatnonzero(np.concatenate([[True], w.place[1:] != w.place[:-1]])) if len(w.doc) else np.zeros(0, np.int64)
        end = np.concatenate([new[1:], [len(w.doc)]]) if len(new) else new
        anchor = w.anchor[new] >> np.uint64(1)
        near = np.minimum(np.searchsorted(often, anchor), max(0, len(often) - 1))
        mine = known[w.doc[new]] & (often[near] == anchor) if len(often) else np.zeros(len(new), bool)
        self.new, self.end = new[mine], end[mine]
        of = w.doc[self.new]
        at, size = w.starts[self.new] - w.firsts[of], self.end - self.new + WIDTH - 1
        found: dict[tuple[int, bytes], list[int]] = {}
        keys = []
        for d, h, a, n in zip(of.tolist(), anchor[mine].tolist(), at.tolist(), size.tolist()):
            key = h, b" ".join(w.words[d][a:a + n])
            keys.append(key)
            doc = ids[d]
            span = found.get(key)
            if span is None:
                found[key] = [doc, doc]
            elif doc < span[0]:
                span[0] = doc
            elif doc > span[1]:
                span[1] = doc
        order = sorted(found)
        self.rows = [(*key, *found[key]) for key in order]
        number = {key: i for i, key in enumerate(order)}
        self.row_of = np.fromiter((number[k] for k in keys), np.int64, len(keys))

    def parts(self, buckets: int):
        anchors = np.array([r[0] for r in self.rows], np.uint64) << np.uint64(1)
        return _split(_bucket_of(anchors, buckets))


    def passages(self, ids: list, least: np.ndarray) -> dict[tuple[bytes, ...], int]:
        """From the smallest doc_id of each window of `rows`: the longest runs of windows that each
        document shares with smaller ones, and the largest of those doc_ids. A run in a document
        is one of its own passages, so passages cover what their windows would."""
        w = self.windows
        counts = np.array([len(r[1].split(b" ")) - WIDTH + 1 for r in self.rows], np.int64)
        firsts = np.concatenate([[0], np.cumsum(counts)])[:-1]
        sizes = self.end - self.new
        inside = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        window = np.repeat(self.new, sizes) + inside
        low = least[np.repeat(firsts[self.row_of], sizes) + inside] if len(window) else np.zeros(0, np.int64)
        own = np.array([0 if i is None else i for i in ids], np.int64)[w.doc[window]]
        window, low = window[low < own], low[low < own]
        if not len(window):
            return {}
        start, doc = w.starts[window], w.doc[window]
        edge = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1] + 1) | (doc[1:] != doc[:-1])]))
        lasts = np.concatenate([edge[1:], [len(window)]])
        most = np.maximum.reduceat(low, edge)
        out: dict[tuple[bytes, ...], int] = {}
        for d, a, n, m in zip(doc[edge].tolist(), (start[edge] - w.firsts[doc[edge]]).tolist(), (lasts - edge + WIDTH - 1).tolist(), most.tolist()):
            out[tuple(w.words[d][a:a + n])] = m
        return out


def _windows_of(text: bytes) -> list[bytes]:
    words = text.split(b" ")
    return [b" ".join(words[i:i + WIDTH]) for i in range(len(words) - WIDTH + 1)]


def _candidates(buckets: int):
    def make(batches):
        import pickle

        pack = zstandard.ZstdCompressor(6).compress
        for batch in batches:
            for row in batch.to_pylist():
                found = Stretches(*_unboxed(row["docs"]), buckets, row["answers"])
                asks = [{"bucket": k, "data": pack(pickle.dumps(found.rows[a:b]))} for k, a, b in found.parts(buckets)]
                yield pa.RecordBatch.from_arrays([pa.array([row["block"]], pa.int64()), pa.array([asks], _ASK)], ["block", "asks"])

    return make


NONE = np.iinfo(np.int64).max


def _confirmed(table: pa.Table) -> pa.Table:
    """For each stretch asked for, the smallest doc_id of each of its windows, NONE where no two
    documents have it. Anchor by anchor: equal windows have equal anchors."""
    import pickle

    unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(3).compress
    asks = [pickle.loads(unpack(d)) for d in table.column("data").to_pylist()]
    out = [[None] * len(rows) for rows in asks]
    order = sorted((row[0], i, j) for i, rows in enumerate(asks) for j, row in enumerate(rows))
    at = 0
    while at < len(order):
        end = at
        while end < len(order) and order[end][0] == order[at][0]:
            end += 1
        spans: dict[bytes, tuple[int, int]] = {}
        cut = []
        for _, i, j in order[at:end]:
            _, text, low, high = asks[i][j]
            cut.append((i, j, _windows_of(text)))
            for w in cut[-1][2]:
                a, b = spans.get(w, (low, high))
                spans[w] = (a if a < low else low, b if b > high else high)
        for i, j, windows in cut:
            out[i][j] = [a if a < b else NONE for a, b in map(spans.__getitem__, windows)]
        at = end
    data = [pack(np.array([x for row in rows for x in row], np.int64).tobytes()) for rows in out]
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "data": pa.array(data, pa.binary())})


#: Stands for a word of no passage.
OTHER = "\x00\x01"


def _codes(words: set[bytes]) -> dict[bytes, str]:
    """Two characters for each word, the first from one small alphabet and the second from another:
    a node of an automaton looks its children up one by one, so it must not have many."""
    base = int(len(words) ** 0.5) + 1
    return {w: chr(2 + i // base) + chr(2 + base + i % base) for i, w in enumerate(sorted(words))}


class Automata:
    """Shards of passages (their words, and a doc_id), each an automaton over characters that stand
    for words; a shard has so many words, or is one passage."""

    def __init__(self, passages: dict[tuple[bytes, ...], int]):
        self.shards = []
        some, size = [], 0
        for words, most in sorted(passages.items()):
            if some and size + len(words) > SHARD_WORDS:
                self._compile(some)
                some, size = [], 0
            some.append((words, most))
            size += len(words)
        if some:
            self._compile(some)

    def _compile(self, some: list[tuple[tuple[bytes, ...], int]]) -> None:
        import ahocorasick

        codes = _codes({w for words, _ in some for w in words})
        automaton = ahocorasick.Automaton()
        for words, most in some:
            automaton.add_word("".join([codes[w] for w in words]), (len(words), most))
        automaton.make_automaton()
        self.shards.append((codes, automaton))

    def found(self, words: list[bytes], doc: int) -> list[tuple[int, int]]:
        """Where in the words a passage begins and ends that smaller doc_ids hold."""
        return [(end // 2 + 1 - n, end // 2 + 1) for codes, automaton in self.shards
                for end, (n, most) in automaton.iter("".join([codes.get(w, OTHER) for w in words])) if most < doc]


def _removed(buckets: int):
    def make(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in batch.to_pylist():
                ids, texts = _unboxed(row["docs"])
                found = Stretches(ids, texts, buckets, row["answers"])
                least = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(unpack(a["data"]), np.int64) for a in row["confirmed"] or ())])
                automata = Automata(found.passages(ids, least))
                n_words, n_removed, kept = [], [], []
                for doc, words in zip(ids, found.windows.words):
                    spans = automata.found(words, doc) if doc is not None and len(words) >= WIDTH else []
                    left, at = [] if spans else words, 0
                    for a, b in sorted(spans):
                        left += words[at:a]
                        at = max(at, b)
                    if spans:
                        left += words[at:]
                    n_words.append(len(words))
                    n_removed.append(len(words) - len(left))
                    kept.append(b" ".join(left))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return make


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by a space) of each row of
    docs(doc_id, text).

    Words lie between ASCII white space, unchanged. A word goes if it stands in a window whose words
    also start in a document of a smaller doc_id, judged on the input. A null or empty text has no
    words; a text shorter than a window, and a row with a null doc_id, neither loses words nor takes
    any away; rows of one doc_id do not touch each other; an empty table gives an empty one; other
    columns are ignored. A passage that any number of documents share travels once a block."""
    _, size = text_bytes(docs)
    buckets = max(8, -(-size // BUCKET_BYTES))
    blocks = stored(texts_of(docs).mapInArrow(_blocks(buckets), f"block long, docs binary, asks {_ASK_DDL}"), "phrase-blocks")
    recurring = asked(blocks, _recurring)
    candidates = stored(recurring.mapInArrow(_candidates(buckets), f"block long, asks {_ASK_DDL}"), "phrase-candidates")
    confirmed = asked(candidates, _confirmed).select("block", F.col("answers").alias("confirmed"))
    return recurring.join(confirmed, "block").mapInArrow(_removed(buckets), "doc_id long, n_words long, n_removed long, kept binary")
