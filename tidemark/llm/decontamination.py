"""Benchmark passages in documents, found by one Aho-Corasick automaton over all test items.

Items and documents are normalised alike: ASCII letters in lower case, words of letters, digits and
whatever is not ASCII. Each `WIDTH` words of an item in a row make a window; a shorter item is one
window. The automaton's alphabet are the words of the benchmark, so each document is scanned once, a
word at a time, and every window that ends at a word is reported there. Words know where they stand
in the text as it was, so hits are spans of the original.

A worker compiles the automaton once. A benchmark whose automaton would outgrow it is cut into
several by a hash, each of bounded size, and documents pass through one after the other."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, text_bytes, texts_of

# Fixed value of the contract.
WIDTH = 10
#: Bytes of item text in one automaton: each word of it takes about ten nodes.
AUTOMATON_BYTES = 2 << 20
#: Words of a piece of an item, without those that the next piece repeats.
PIECE_WORDS = 4096
#: Bytes of a document whose words are held at a time.
PART_BYTES = 4 << 20

#: What separates words gives way to spaces, and letters to lower case; bytes of other characters stay.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
word_spans = re.compile(rb"[0-9A-Za-z\x80-\xff]+").finditer
gap = re.compile(rb"[^0-9A-Za-z\x80-\xff]").search


def words_of(data: bytes) -> list[bytes]:
    return data.translate(PLAIN).split()


def _pieces(width: int):
    """Items in pieces of bounded size; windows over a cut lie in the piece before it."""
    def cut(batches):
        for batch in batches:
            items, texts = [], []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text or b"")
                for at in range(0, max(1, len(words) - width + 1) if words else 0, PIECE_WORDS):
                    items.append(item)
                    texts.append(b" ".join(words[at:at + PIECE_WORDS + width - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.string()), pa.array(texts, pa.binary())], ["item", "words"])

    return cut


class Windows:
    """The automaton of some pieces (item, words joined by spaces). An item that has no id is
    looked for as well, under no name."""

    def __init__(self, pieces: list[tuple[str | None, bytes]], width: int = WIDTH):
        import ahocorasick

        self.width, self.code = width, {}
        of: dict[tuple[int, ...], set] = {}
        for item, text in pieces:
            codes = tuple(self.code.setdefault(w, len(self.code) + 1) for w in text.split())
            for at in range(max(1, len(codes) - width + 1)):
                of.setdefault(codes[at:at + width], set()).add(item)
        self.items = [sorted(x for x in names if x is not None) for names in of.values()]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for number, window in enumerate(of):
            self.automaton.add_word(window, (len(window), number))
        if of:
            self.automaton.make_automaton()

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Words, runs of hit words (first and last of each), and the windows that occur."""
        runs: list[tuple[int, int]] = []
        seen: set[int] = set()
        n, at, kept = 0, 0, []
        while at < len(text):
            cut = gap(text, at + PART_BYTES) if at + PART_BYTES < len(text) else None
            end = cut.start() if cut else len(text)
            words = words_of(text[at:end])
            codes = kept + [self.code.get(w, 0) for w in words]
            shift = n - len(kept)
            if self.items:
                for last, (size, number) in self.automaton.iter(tuple(codes)):
                    first, last = shift + last - size + 1, shift + last
                    if last < n:  # found in the part before
                        continue
                    seen.add(number)
                    while runs and first <= runs[-1][1] + 1:  # also runs that a longer window now joins
                        first, last = min(first, runs[-1][0]), max(last, runs[-1][1])
                        runs.pop()
                    runs.append((first, last))
            n, at = n + len(words), end
            kept = codes[-(self.width - 1):] if self.width > 1 else []
        return n, runs, seen


_compiled: dict[str, Windows] = {}


def compiled(name: str, pieces: Broadcast, width: int) -> Windows:
    """This worker's automaton, which it keeps from task to task until it needs another."""
    if name not in _compiled:
        _compiled.clear()
        _compiled[name] = Windows(pieces.value, width)
    return _compiled[name]


def joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs of words as few as possible, in order."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(runs):
        if out and first <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(last, out[-1][1])
        else:
            out.append((first, last))
    return out


def spans_of(data: bytes, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Runs of words as spans of the text, in code points, the end exclusive."""
    if not runs:
        return []
    edges = []
    starts, ends = {a for a, _ in runs}, {b for _, b in runs}
    at = point = 0
    for i, word in enumerate(word_spans(data)):
        for edge, wanted in ((word.start(), i in starts), (word.end(), i in ends)):
            if wanted:
                point += len(data[at:edge].decode())
                at = edge
                edges.append(point)
    return [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])]


def _scanner(pieces: Broadcast, width: int, last: bool):
    """Adds one automaton's hits to those of the ones before it; the last one puts out spans."""
    name, schema = uuid.uuid4().hex, FOUND if last else SCANNED

    def scan(batches):
        windows = compiled(name, pieces, width)
        for batch in batches:
            rows = []
            known = batch.column("hits").to_pylist() if "hits" in batch.schema.names else [[]] * batch.num_rows
            named = batch.column("items").to_pylist() if "hits" in batch.schema.names else [[]] * batch.num_rows
            for doc, text, hits, items in zip(batch.column("doc_id").to_pylist(), batch.column("text"), known, named):
                data = text.as_py() or b""
                n, runs, seen = windows.scan(data)
                names = sorted(set(items).union(*(windows.items[i] for i in seen))) if seen else items
                runs = joined([(h["first"], h["last"]) for h in hits] + runs) if hits else runs
                if last:
                    rows.append((doc, n, sum(b - a + 1 for a, b in runs), spans_of(data, runs), names))
                else:
                    rows.append((doc, data, [{"first": a, "last": b} for a, b in runs], names))
            columns = zip(*rows) if rows else [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(columns, schema)], schema=schema)

    return scan


SCANNED = pa.schema([
    ("doc_id", pa.int64()), ("text", pa.binary()),
    ("hits", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("items", pa.list_(pa.string())),
])
SCANNED_DDL = "doc_id long, text binary, hits array<struct<first: long, last: long>>, items array<string>"
FOUND = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())),
])
FOUND_DDL = "doc_id long, n_words long, n_hit long, spans array<struct<start: long, end: long>>, items array<string>"


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, automaton_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """For each row of docs(doc_id, text): n_words, n_hit (words inside any occurrence of a window of
    benchmark(item_id, text)), spans (of the original text, in code points, the end exclusive, one for
    each run of hit words) and items (the ids of the items with occurring windows, as strings in
    order, each once).

    A null or empty text has no words; an item without words is never found. Rows of one doc_id and
    repeated rows stay apart, a null doc_id is kept. Rows of one item_id are one item, the same text
    under several ids is each of them, and the words of an item without an id hit but name no item.
    Without documents the result is empty, without items nothing is hit; other columns are ignored.
    A document of any length is scanned in parts, an item of any length is cut into pieces."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").cast("binary").alias("text"))
    pieces = stored(items.mapInArrow(_pieces(width), "item string, words binary").distinct(), "test-items")
    shards = max(1, -(-text_bytes(pieces.select(F.col("words").alias("text")))[1] // automaton_bytes))
    shard = F.pmod(F.xxhash64("item", "words"), F.lit(shards))
    scanned = texts_of(docs)
    for i in range(shards):
        # about automaton_bytes of items at most: longer ones have been cut, and equal pieces are one
        some = [(r.item, bytes(r.words)) for r in pieces.filter(shard == i).collect()]
        if i:  # workers hold one automaton at a time
            scanned = stored(scanned, "scanned-texts")
        last = i == shards - 1
        scanned = scanned.mapInArrow(_scanner(spark.sparkContext.broadcast(some), width, last), FOUND_DDL if last else SCANNED_DDL)
    return scanned
