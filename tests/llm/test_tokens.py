"""Counts, stores and packs of token ids against the libraries' own encoding of whole texts."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import encoding
from tidemark.llm.packing import FreeRoom, first_fit_decreasing, pack
from tidemark.llm.token_counts import token_counts
from tidemark.llm.token_store import fetch, read_store, write_store


def ids_of(name, texts, end=1):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return [e.ids + [end] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_counts(docs, rows):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = Counter((r[0], len((r[1] or "").encode()), len(n := sp.encode(r[1] or "")), len(n) > 4096) for r in rows)
    out = token_counts(docs)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert Counter(map(tuple, out.collect())) == want


def test_counts_of_no_rows(no_docs):
    assert token_counts(no_docs).count() == 0


@pytest.mark.parametrize("kind, name", [("words", "word_bpe_49k.json"), ("spaced", "byte_bpe_50k.json")])
def test_stretches_add_up(kind, name):
    r = random.Random(5)
    parts = ["the", "The", "ÉTÉ", "don't", "x'S", "  ", "\n", "\t", "\x1d", " ", ",", ").", "123", "a1", "ß", "İ", "ﬁ", "é", "日本", "🙂", "<|endoftext|>", "<|", " ", "'", "ve", " "]
    texts = ["".join(r.choices(parts, k=r.randint(0, 30))) for _ in range(3000)]
    made = encoding.encoder(public_tokenizers.path(name), kind)([t.encode() for t in texts])
    want = [x[:-1] for x in ids_of(name, texts)]
    assert [np.frombuffer(m, "<u2").tolist() for m in made] == want


def test_kept_stretches_are_bounded(monkeypatch):
    monkeypatch.setattr(encoding, "KEPT", 50)
    texts = [" ".join(f"word{i}" for i in range(k, k + 40)) for k in range(0, 300, 20)]
    fresh = encoding.Encoder(public_tokenizers.path("word_bpe_49k.json"), "words")
    made = fresh([t.encode() for t in texts])
    assert len(fresh.kept) <= 50 and [np.frombuffer(m, "<u2").tolist() for m in made] == [x[:-1] for x in ids_of("word_bpe_49k.json", texts)]


def test_token_store(spark, docs, rows):
    folder = write_store(docs)
    out = read_store(spark, folder).collect()
    got = sorted(out, key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda x: (x is not None, x))
    ends = [r.start + r.n_tokens for r in got]
    assert [r.start for r in got] == [0, *ends[:-1]]
    ids = ids_of("word_bpe_49k.json", [r[1] for r in rows])
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == Counter((r[0], len(i), crc(i)) for r, i in zip(rows, ids))
    some = {7: None, 12: None}
    some = {r[0]: i for r, i in zip(rows, ids) if r[0] in some}
    assert {r.doc_id: r.ids for r in fetch(spark, folder, [7, 12, 99_999]).collect()} == some


def test_store_refuses_another_dictionary(spark, docs):
    folder = write_store(docs.limit(3))
    spark.createDataFrame([("0" * 64, bytearray(b"other"))], "hash string, data binary").write.mode("overwrite").parquet(f"{folder}/dictionary")
    with pytest.raises(Exception, match="another dictionary"):
        read_store(spark, folder).collect()


def test_store_of_no_rows(spark, no_docs):
    assert read_store(spark, write_store(no_docs)).count() == 0


def test_pack(docs, rows):
    out = pack(docs).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in out:
        ids = np.frombuffer(r.ids, f"<u{r.width}").tolist()
        assert len(ids) == r.length <= 2048 and crc(ids) == r.ids_crc32
        by_doc[r.doc_id].append((r.start, r.doc_tokens, ids))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for spans in by_sequence.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= 2048
    want = defaultdict(list)
    for r, ids in zip(rows, ids_of("byte_bpe_50k.json", [r[1] for r in rows])):
        want[r[0]] += [(at, len(ids), ids[at:at + 2048]) for at in range(0, len(ids), 2048)]
    assert {k: sorted(v) for k, v in by_doc.items()} == {k: sorted(v) for k, v in want.items()}


def test_pack_no_rows(no_docs):
    assert pack(no_docs).count() == 0


def test_first_fit_decreasing_is_first_fit():
    r = random.Random(3)
    for _ in range(50):
        lengths = sorted((r.randint(1, 64) for _ in range(r.randint(0, 80))), reverse=True)
        bins, offsets = first_fit_decreasing(lengths, 64)
        room, want = [], []
        for n in lengths:
            b = next((i for i, x in enumerate(room) if x >= n), len(room))
            room += [64] * (b == len(room))
            want.append((b, 64 - room[b]))
            room[b] -= n
        assert list(zip(bins, offsets)) == want
    with pytest.raises(ValueError):
        FreeRoom(2, 5).first(6)


def test_white_space_that_only_adds_up():
    """As many spaces and line ends as there are gaps between words, but not one in each gap."""
    texts = ["a b\n\nc", "a b c  d", "　a b ", "a\tb\n\nc d", "x  y", "\n a"]
    made = encoding.encoder(public_tokenizers.path("byte_bpe_50k.json"), "spaced")([t.encode() for t in texts])
    assert [np.frombuffer(m, "<u2").tolist() for m in made] == [x[:-1] for x in ids_of("byte_bpe_50k.json", texts)]
