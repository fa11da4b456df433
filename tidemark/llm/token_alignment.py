"""Tokens of two tokenizers aligned over the bytes that both cover.

Each token of one side points to the token of the other side that overlaps it and reaches farthest
right; where both end at one byte, the token of the first side points to itself and the other one to it.
Pointer jumping (every successor gives way to its successor's successor until none changes) leads each
token to the last one of its component, and that one labels the group. All tokens of a block of
documents jump together.

A block lists its distinct linked pairs of ids with the number of documents that hold them. Spark sums
them over the corpus, finds each first id's most frequent partner, and sends each block what its pairs
came to; a pair travels once a block, never once an occurrence."""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import block_number, slices, stored, texts_of, tokenizer_path
from tidemark.llm.encoding import byte_letters
from tidemark.llm.token_counts import MARK, model

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Text bytes whose tokens are aligned at a time.
BLOCK_BYTES = 2 << 20
#: Characters without a space, or spaces, that tiktoken is given in a row.
LONG_RUN = 1000
WIDE_GAP = " " * LONG_RUN
# Any character beyond these, whose classes have long been the same in all tables: Latin, Greek and Cyrillic letters,
# punctuation and symbols, kana, Chinese characters, Hangul, pictures.
unsure = re.compile("[^\t\n\r -~\u00a1-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u04ff\u2010-\u2027\u2030-\u205e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3\U0001f300-\U0001f5ff]").search
#: Links of a group from which on its equal ids are counted before they are paired.
LONG_GROUP = 256
#: Bits of the second id in the key of a pair.
SECOND_BITS = np.uint64(32)


class FirstSide:
    """Byte-level ids of a space and the text; strings of special tokens are plain text.

    Ids of merged tokens are numbered in the order of their merges, so tiktoken, given the entries as
    ranks, makes the same merges much faster. Its tables of Unicode may differ from the other
    library's, and it takes long over a long unbroken run, so only texts of well-known characters
    and bounded runs go there."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.tokenizer.encode_special_tokens = True
        of = {letter: byte for byte, letter in byte_letters().items()}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        entries = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes = [bytes(of[c] for c in e) if all(c in of for c in e) else e.encode() for e in entries]
        self.quick = self._ranked(path)

    def _ranked(self, path: str):
        """tiktoken's encoding of the same vocabulary, if it has the form that this asks for."""
        import json

        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        bpe, cut = told["model"], told.get("pre_tokenizer") or {}
        merges = [m.split(" ") if isinstance(m, str) else m for m in bpe.get("merges", [])]
        # single bytes first, then one entry for each merge, in their order
        ordered = all(bpe["vocab"].get(x + y) == 256 + i for i, (x, y) in enumerate(merges))
        if not (merges and ordered and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and told.get("normalizer") is None):
            return None
        ranks = {self.bytes[i]: i for i in range(256 + len(merges))}
        return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            if self.quick is None or unsure(text) or WIDE_GAP in text or max(map(len, text.split(" "))) > LONG_RUN:
                out.append(np.array(self.tokenizer.encode(" " + text, add_special_tokens=False).ids, np.uint32))
            else:
                out.append(self.quick.encode_to_numpy(" " + text, disallowed_special=()))
        return out


class SecondSide:
    """Pieces with a mark for each space; the model itself sets a space before the text."""

    def __init__(self, path: str):
        self.model = model(path)
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(MARK, " ").encode()
            for i, p in enumerate(map(self.model.id_to_piece, range(self.model.get_piece_size())))]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(ids, np.uint32) for ids in self.model.encode(texts, num_threads=1)]


class Sides:
    """Both tokenizers: the ids of texts, lengths in bytes, and decimals with each ending of a group's text."""

    def __init__(self, first: str, second: str):
        self.both = FirstSide(first), SecondSide(second)
        self.lengths = [np.array([len(b) for b in side.bytes], np.int64) for side in self.both]
        # a token that another of its side follows, and the side's last one of a group
        self.texts = [np.array([f"{i}{end}" for end in (",", last) for i in range(len(side.bytes))], object) for side, last in zip(self.both, "|;")]

    def ids(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of a space and each text by both sides; none where a side's do not spell that."""
        none = np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        filled = [t for t in texts if t]
        found = iter(list(zip(*(side([t.decode() for t in filled]) for side in self.both))))
        pairs = [next(found) if t else none for t in texts]
        return [pair if t and all(b"".join(map(side.bytes.__getitem__, ids.tolist())) == b" " + t for side, ids in zip(self.both, pair)) else none for t, pair in zip(texts, pairs)]


@lru_cache(maxsize=1)
def sides(first: str, second: str) -> Sides:
    return Sides(first, second)


def farthest(a_ends: np.ndarray, b_ends: np.ndarray) -> np.ndarray:
    """For the ends of two rows of tokens that cover the same bytes: each token's successor, tokens of
    the second row counted after those of the first."""
    def holds(ends: np.ndarray, last_bytes: np.ndarray) -> np.ndarray:
        """The token that holds each of the bytes: as many as end before it stand before it."""
        before = np.zeros(ends[-1] + 1, np.int32)
        before[ends] = 1
        return np.cumsum(before, dtype=np.int32)[last_bytes]

    if not len(a_ends):
        return np.zeros(0, np.int32)
    over_a, over_b = holds(b_ends, a_ends - 1), holds(a_ends, b_ends - 1)
    a = np.arange(len(a_ends), dtype=np.int32)
    return np.concatenate([np.where(b_ends[over_a] == a_ends, a, len(a) + over_a), over_b]).astype(np.int32)


def jumped(to: np.ndarray) -> np.ndarray:
    """Each node's terminal: successors are doubled until nothing changes."""
    while True:
        further = to[to]
        if np.array_equal(further, to):
            return to
        to = further


def aligned(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each token's group, from 0 and in order of the text, for both rows."""
    ends = jumped(farthest(a_ends, b_ends))  # each group ends with a token of the first row
    last = np.zeros(len(a_ends), np.int64)
    last[ends[ends < len(a_ends)]] = 1
    group = np.cumsum(last) - 1
    return group[ends[:len(a_ends)]], group[ends[len(a_ends):]]


def _pairs(a: np.ndarray, a_group: np.ndarray, b: np.ndarray, b_group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group, key and number of the linked pairs of ids of each group. Where a group is long, equal ids
    of a side are counted first, so that a long group of few ids has few pairs."""
    def counted(ids, group):
        key, n = np.unique(group.astype(np.uint64) << SECOND_BITS | ids.astype(np.uint64), return_counts=True)
        return (key >> SECOND_BITS).astype(np.int64), key & np.uint64(0xFFFFFFFF), n

    groups = int(a_group[-1]) + 1 if len(a_group) else 0
    sizes = np.bincount(a_group, minlength=groups) * np.bincount(b_group, minlength=groups)
    if groups and sizes.max() > LONG_GROUP:
        ga, ia, na = counted(a, a_group)
        gb, ib, nb = counted(b, b_group)
    else:
        (ga, ia, na), (gb, ib, nb) = ((g, i.astype(np.uint64), np.ones(len(i), np.int64)) for g, i in ((a_group, a), (b_group, b)))
    many = np.bincount(gb, minlength=groups)  # partners of each entry of a
    begin = np.concatenate([[0], np.cumsum(many)[:-1]]) if groups else np.zeros(0, np.int64)
    partners = many[ga]
    left = np.repeat(np.arange(len(ga)), partners)
    right = np.arange(len(left)) + np.repeat(begin[ga] - np.cumsum(partners) + partners, partners)
    return ga[left], ia[left] << SECOND_BITS | ib[right], na[left] * nb[right]


BLOCK = pa.schema([
    ("block", pa.int64()), ("docs", pa.binary()), ("links", pa.binary()), ("keys", pa.list_(pa.int64())), ("docs_with", pa.list_(pa.int64())),
])
BLOCK_DDL = "block long, docs binary, links binary, keys array<long>, docs_with array<long>"
DOCS = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")] + [("groups", pa.binary())])


def _groups_text(sides: Sides, a, a_group, b, b_group) -> np.ndarray:
    """The decimals of all tokens with what follows each, groups in order and in each the first side before the second."""
    out = np.empty(len(a) + len(b), object)
    a_last = np.append(a_group[1:] != a_group[:-1], True) if len(a) else np.zeros(0, bool)
    b_last = np.append(b_group[1:] != b_group[:-1], True) if len(b) else np.zeros(0, bool)
    # before a token stand all of its side, and of the other side those of earlier groups, or of its own too
    at_a = np.arange(len(a)) + np.searchsorted(b_group, a_group, "left")
    at_b = np.arange(len(b)) + np.searchsorted(a_group, b_group, "right")
    out[at_a] = sides.texts[0][a + a_last * len(sides.lengths[0])]
    out[at_b] = sides.texts[1][b + b_last * len(sides.lengths[1])]
    return out


def _aligner(first: str, second: str, whole_groups: bool):
    def align(batches):
        both = sides(first, second)
        numbers = block_number()
        pack = zstandard.ZstdCompressor(3).compress
        for doc_ids, texts in slices(batches, BLOCK_BYTES):
            (a, n_a), (b, n_b) = ((np.concatenate(of).astype(np.int64), np.array([len(x) for x in of], np.int64)) for of in zip(*both.ids(texts)))
            a_group, b_group = aligned(np.cumsum(both.lengths[0][a]), np.cumsum(both.lengths[1][b]))
            # documents end where both sides end, so no group reaches from one into the next
            a_doc = np.repeat(np.arange(len(texts)), n_a)
            doc_of = a_doc[np.flatnonzero(np.append(a_group[1:] != a_group[:-1], True))] if len(a) else np.zeros(0, np.int64)
            n_groups = np.bincount(doc_of, minlength=len(texts))
            group, key, times = _pairs(a, a_group, b, b_group)
            where, keys = pd.factorize(key)
            # a pair's links of one document together: where it is among the keys, how often
            at, link = pd.factorize(doc_of[group] * max(1, len(keys)) + where)
            times = np.bincount(at, times, len(link)).astype(np.int64)
            doc, where = np.divmod(link, max(1, len(keys)))
            n_links = np.bincount(doc, times, len(texts)).astype(np.int64)
            docs_with = np.bincount(where, minlength=len(keys))
            pieces = _groups_text(both, a, a_group, b, b_group)
            ends = np.cumsum(n_a + n_b)
            told = []
            for n, end in zip((n_a + n_b).tolist(), ends.tolist()):
                text = "".join(pieces[end - n:end]).removesuffix(";").encode()
                told.append(text if whole_groups else hashlib.sha256(text).hexdigest().encode() if n else b"")
            table = pa.table([pa.array(doc_ids, pa.int64()), *map(pa.array, (n_a, n_b, n_groups, n_links)), pa.array(told, pa.binary())], schema=DOCS)
            links = b"".join(x.astype(np.uint32).tobytes() for x in (np.bincount(doc, minlength=len(texts)), where)) + times.astype(np.int64).tobytes()
            yield pa.RecordBatch.from_arrays([
                pa.array([next(numbers)], pa.int64()), pa.array([pack(_written(table))], pa.binary()), pa.array([pack(links)], pa.binary()),
                pa.array([keys.astype(np.int64)], pa.list_(pa.int64())), pa.array([docs_with], pa.list_(pa.int64()))], schema=BLOCK)

    return align


def _written(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


TOLD = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups binary, n_best long, count_sum long"


def _told(block: pa.Table, answers: pa.Table) -> pa.Table:
    """The documents of a block, each with the sums over its links."""
    unpack = zstandard.ZstdDecompressor().decompress
    docs = pa.ipc.open_stream(unpack(block.column("docs")[0].as_py())).read_all()
    links, n = unpack(block.column("links")[0].as_py()), docs.num_rows
    per_doc = np.frombuffer(links, np.uint32, n).astype(np.int64)
    total = int(per_doc.sum())
    where = np.frombuffer(links, np.uint32, total, 4 * n)
    times = np.frombuffer(links, np.int64, total, 4 * (n + total))
    ends = np.cumsum(per_doc)
    told = np.zeros(answers.num_rows, np.int64)
    told[answers.column("at").to_numpy()] = answers.column("told").to_numpy()
    for name, of_key in (("n_best", told & 1), ("count_sum", told >> 1)):
        sums = np.concatenate([[0], np.cumsum(times * of_key[where])])
        docs = docs.append_column(name, pa.array(sums[ends] - sums[ends - per_doc]))
    return docs


def align_tokens(docs: DataFrame, first: str | None = None, second: str | None = None, whole_groups: bool = True) -> DataFrame:
    """For each row of docs(doc_id, text): n_a and n_b (tokens of a space and the text by both
    tokenizers), n_groups, n_links (pairs of tokens that share a group), n_best (links whose pair of
    ids is in the most documents of all pairs of its first id, ties included), count_sum (over the
    links, the documents that hold their pair of ids linked), and groups: `a1,a2|b1;a3|b2,b3`, the ids of
    each group (bytes), or with whole_groups=False their sha256 in hex.

    A text that is null or empty, or that a side's tokens do not spell byte for byte, has no tokens:
    zeros, and an empty `groups`. Each row is a document in the counts, also a repeated one; a null doc_id
    is kept; an empty table gives an empty one; other columns are ignored. A very long text is a
    block of its own. Ids of a tokenizer are below 2**31."""
    blocks = stored(texts_of(docs).mapInArrow(_aligner(first or tokenizer_path(FIRST), second or tokenizer_path(SECOND), whole_groups), BLOCK_DDL), "token-groups")
    asked = blocks.select("block", F.posexplode(F.arrays_zip("keys", "docs_with")).alias("at", "pair")).select("block", "at", F.col("pair.keys").alias("key"), F.col("pair.docs_with").alias("n"))
    counts = asked.groupBy("key").agg(F.sum("n").alias("count"))
    # the pairs of one first id are no more than the second tokenizer has ids
    same_first = Window.partitionBy(F.shiftright("key", int(SECOND_BITS)))
    best = F.col("count") == F.max("count").over(same_first)
    # a pair's documents, and in the last bit whether it is the best of its first id
    known = stored(counts.select("key", (F.col("count") * 2 + best.cast("int")).alias("told")), "linked-pairs")
    answers = asked.join(known, "key").select("block", "at", "told")
    whole = blocks.select(F.col("block").alias("of"), "docs", "links").groupBy("of").cogroup(answers.groupBy("block"))
    return whole.applyInArrow(_told, TOLD)
