"""Token counts of whole texts without any token ids.

A sentencepiece BPE model merges neighbouring symbols into pieces of its vocabulary only. No piece
has a word mark after another character, so no merge crosses from one word into the next, and a
character that occurs in no longer piece merges with nothing. The normalised text therefore falls
into pre-tokens whose piece counts add up. Each distinct pre-token is counted once, and the counts
are joined to the documents' pre-token frequencies."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import asked, block_number, slices, squeezed, stored, text_bytes, texts_of, tokenizer_path, unsqueezed

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Set before a pre-token so that the model adds its word mark there, and not to the pre-token.
LEAD = "\n"
#: Text bytes of a block: the documents whose pre-tokens share a dictionary.
BLOCK_BYTES = 8 << 20
#: Text bytes for each hash bucket of pre-tokens.
BUCKET_BYTES = 32 << 20
#: Writing tasks whose blocks' asks for a bucket meet, so that a word of every block stays bounded there.
SPAN = 1 << 12


@lru_cache(maxsize=2)
def model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def splitter(path: str):
    """findall of this pattern gives a normalised text's pre-tokens."""
    sp = model(path)
    plain = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in plain):
        raise ValueError("a piece of this model crosses words")
    if any(LEAD in p for p in plain):
        raise ValueError("a piece of this model holds a line end")
    joining = "".join(map(re.escape, sorted({c for p in plain if len(p) > 1 for c in p} - {MARK})))
    return re.compile(f"{MARK}+[{joining}]*|[{joining}]+|[^{joining}{MARK}]", re.DOTALL).findall


def _blocks(path: str, buckets: int):
    def make(batches):
        split, normal = splitter(path), model(path).normalize
        numbers = block_number()
        for ids, texts in slices(batches, BLOCK_BYTES):
            codes: dict[str, int] = {}
            ends, all_codes, all_freqs = [], [], []
            for text in texts:
                counts = Counter(split(normal(text.decode()))) if text else {}
                all_codes.append(np.fromiter((codes.setdefault(w, len(codes)) for w in counts), np.uint32, len(counts)))
                all_freqs.append(np.fromiter(counts.values(), np.uint32, len(counts)))
                ends.append(len(counts))
            by_bucket: dict[int, list[str]] = {}
            for word in codes:
                by_bucket.setdefault(zlib.crc32(word.encode()) % buckets, []).append(word)
            # a pre-token's number is its place among the answers, which come in order of the bucket
            pack = zstandard.ZstdCompressor(9).compress
            asks, place = [], np.empty(len(codes), np.uint64)
            at = 0
            for b, words in sorted(by_bucket.items()):
                words.sort()
                asks.append({"bucket": b, "data": pack(_join(words))})
                place[[codes[w] for w in words]] = np.arange(at, at + len(words), dtype=np.uint64)
                at += len(words)
            # ascending within a document, and from one document to the next
            flat = place[np.concatenate(all_codes)] + np.repeat(np.arange(len(ends), dtype=np.uint64) * np.uint64(len(codes)), ends) if codes else np.zeros(0, np.uint64)
            order = np.argsort(flat, kind="stable")
            freqs = np.concatenate(all_freqs)[order]
            number = next(numbers)
            yield pa.RecordBatch.from_pylist([{
                "block": number, "asks": asks, "doc_ids": ids, "n_bytes": [len(t) for t in texts], "sizes": ends,
                "codes": squeezed(flat[order]), "freqs": pack(freqs.tobytes()),
            }], schema=BLOCKS)

    return make


BLOCKS = pa.schema([
    ("block", pa.int64()), ("asks", pa.list_(pa.struct([("bucket", pa.int32()), ("data", pa.binary())]))),
    ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())),
    ("codes", pa.binary()), ("freqs", pa.binary()),
])
BLOCKS_DDL = (
    "block long, asks array<struct<bucket: int, data: binary>>, doc_ids array<long>, n_bytes array<long>, "
    "sizes array<long>, codes binary, freqs binary"
)


def _join(words: list[str]) -> bytes:
    """Lengths and texts: a pre-token may be any character, so no separator would do."""
    data = [w.encode() for w in words]
    return len(data).to_bytes(4, "little") + np.array([len(d) for d in data], np.uint32).tobytes() + b"".join(data)


def _parted(data: bytes) -> list[str]:
    n = int.from_bytes(data[:4], "little")
    ends = np.cumsum(np.frombuffer(data, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    starts = [4 + 4 * n, *ends[:-1].tolist()]
    return [data[a:b].decode() for a, b in zip(starts, ends.tolist())]


def _counter(path: str):
    def answer(table: pa.Table) -> pa.Table:
        encode = model(path).encode
        lead = len(encode(LEAD))
        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(3).compress
        asks = [_parted(unpack(d)) for d in table.column("data").to_pylist()]
        counts: dict[str, int] = dict.fromkeys(w for words in asks for w in words)
        distinct = list(counts)
        for i in range(0, len(distinct), 10_000):
            part = distinct[i:i + 10_000]
            counts.update((w, len(x) - lead) for w, x in zip(part, encode([LEAD + w for w in part], num_threads=1)))
        data = [pack(np.fromiter((counts[w] for w in words), np.uint32, len(words)).tobytes()) for words in asks]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "data": pa.array(data, pa.binary())})

    return answer


def _sums(batches):
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for row in batch.to_pylist():
            pieces = np.concatenate([np.zeros(0, np.uint32), *(np.frombuffer(unpack(a["data"]), np.uint32) for a in row["answers"] or ())]).astype(np.int64)
            freqs = np.frombuffer(unpack(row["freqs"]), np.uint32)
            total = np.concatenate([[0], np.cumsum(pieces[(unsqueezed(row["codes"]) % np.uint64(max(1, len(pieces)))).astype(np.int64)] * freqs)])
            ends = np.cumsum(np.array(row["sizes"], np.int64))
            sums = total[ends] - total[ends - np.array(row["sizes"], np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(row["n_bytes"], pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, model_path: str | None = None, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of each row of docs(doc_id, text).

    A null text counts as empty: no bytes, no tokens. A null doc_id stays null, repeated rows stay
    repeated, an empty table gives an empty one, and other columns are ignored whatever their names.

    Blocks of documents are written once with their pre-token frequencies; their dictionaries go to
    hash buckets, which count each distinct pre-token once (for each SPAN tasks) and send the
    counts back. Nothing travels for each word of a text."""
    path = model_path or tokenizer_path(MODEL)
    _, size = text_bytes(docs)
    buckets = max(8, -(-size // BUCKET_BYTES))
    blocks = stored(texts_of(docs).mapInArrow(_blocks(path, buckets), BLOCKS_DDL), "token-counts")
    counted = asked(blocks, _counter(path), span=SPAN)
    sums = counted.select("doc_ids", "n_bytes", "sizes", "codes", "freqs", "answers").mapInArrow(_sums, "doc_id long, n_bytes long, n_tokens long")
    return sums.withColumn("over_limit", F.col("n_tokens") > limit)
