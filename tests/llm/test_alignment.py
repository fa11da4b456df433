"""Aligned tokens against the libraries' own ids, walked through byte by byte."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import token_alignment
from tidemark.llm.encoding import byte_letters
from tidemark.llm.queries import op12_token_alignment
from tidemark.llm.token_alignment import align_tokens, aligned, jumped

ODD = ["a▁b", "tab\there  two", "=" * 5000, "日本語🙂", "<|endoftext|> x <s>", "  lead and trail  ", "ﬁ é", "x" * 700 + "=" * 300, "nul\x00 in", " no-break 　wide"]


def brute(rows):
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    of = {letter: byte for byte, letter in byte_letters().items()}
    all_groups, holds = [], Counter()
    for _, text in rows:
        groups = []
        if text:
            data = b" " + text.encode()
            a = first.encode(" " + text, add_special_tokens=False).ids
            b = second.encode(text)
            a_bytes = [bytes(of[c] for c in first.id_to_token(i)) for i in a]
            b_bytes = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(b, map(second.id_to_piece, b))]
            if b"".join(a_bytes) == data == b"".join(b_bytes):
                ends = [{int(e): i + 1 for i, e in enumerate(np.cumsum([len(x) for x in side]))} for side in (a_bytes, b_bytes)]
                at = [0, 0]
                for cut in sorted(ends[0].keys() & ends[1].keys()):
                    to = [e[cut] for e in ends]
                    groups.append((a[at[0]:to[0]], b[at[1]:to[1]]))
                    at = to
        all_groups.append(groups)
        holds.update({(x, y) for ga, gb in groups for x in set(ga) for y in set(gb)})
    most = defaultdict(int)
    for (x, _), n in holds.items():
        most[x] = max(most[x], n)
    out = []
    for (doc, _), groups in zip(rows, all_groups):
        links = Counter()
        for ga, gb in groups:
            for x, n in Counter(ga).items():
                for y, m in Counter(gb).items():
                    links[x, y] += n * m
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        out.append((doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), sum(links.values()),
                    text, sum(n for p, n in links.items() if holds[p] == most[p[0]]), sum(n * holds[p] for p, n in links.items())))
    return out


def test_against_the_libraries(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(token_alignment, "BLOCK_BYTES", 20_000)
    extra = [(500 + i, t, None, None, 0, "x", 0, 0, 0, "y", 0) for i, t in enumerate(ODD)]
    more = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    want = Counter(brute([(r[0], r[1]) for r in [*rows, *extra]]))
    got = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, bytes(r.groups).decode(), r.n_best, r.count_sum) for r in align_tokens(more).collect())
    assert got == want
    assert any(w[1] == 0 and w[0] == 500 for w in want)  # a text that the pieces do not spell


def test_pointer_jumping_finds_common_ends():
    r = random.Random(4)
    for _ in range(300):
        cuts = [sorted(r.sample(range(1, 60), r.randint(0, 30))) + [60] for _ in range(2)]
        a, b = (np.array(c) for c in cuts)
        both = np.array(sorted(set(cuts[0]) & set(cuts[1])))
        a_group, b_group = aligned(a, b)
        assert a_group.tolist() == np.searchsorted(both, a).tolist() and b_group.tolist() == np.searchsorted(both, b).tolist()
    assert jumped(np.minimum(np.arange(1000) + 1, 999)).tolist() == [999] * 1000


def test_no_rows(no_docs):
    assert align_tokens(no_docs).count() == 0


def test_query(spark):
    out = op12_token_alignment(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    ids = sorted(texts)
    want = {w[0]: w for w in brute([(i, texts[i]) for i in ids])}
    assert len(out) == len(ids)
    for r in out:
        w = want[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum) == (*w[1:5], *w[6:])
        assert r.groups_sha256 == (hashlib.sha256(w[5].encode()).hexdigest() if w[1] else "")


def test_quick_ids_are_the_tokenizer_s():
    """Where texts go to the faster library, and where they do not."""
    side = token_alignment.FirstSide(public_tokenizers.path("byte_bpe_50k.json"))
    assert side.quick is not None
    r = random.Random(6)
    parts = ["the", "The", "ÉTÉ", "don't", "x'S", "  ", "\n", "\t", " ", ",", ").", "123", "a1", "ß", "İ", "é", "日本", "한국", "🌍", "Привет", "αβγ", "<|endoftext|>", "—", "'", "ve", "½", "“q”", "\r\n", "ₓ", "\x1c", " "]
    texts = ["".join(r.choices(parts, k=r.randint(1, 30))) for _ in range(5000)] + ["x" * 3000, " " * 3000, "\n" * 3000]
    want = [e.ids for e in side.tokenizer.encode_batch([" " + t for t in texts], add_special_tokens=False)]
    assert [ids.tolist() for ids in side(texts)] == want
    assert 0 < sum(token_alignment.unsure(t) is not None for t in texts) < len(texts)
