"""Phrase dedup and SimHash groups against brute force."""

import hashlib
from collections import Counter

import numpy as np
import xxhash

from tidemark.llm import phrase_dedup, simhash_dedup
from tidemark.llm.components import components


def kept_by_force(rows, width=13):
    words = [(r[0], (r[1] or "").encode().split()) for r in rows]
    first = {}
    for doc, w in words:
        for i in range(len(w) - width + 1) if doc is not None else ():
            key = b" ".join(w[i:i + width])
            first[key] = min(first.get(key, doc), doc)
    out = []
    for doc, w in words:
        gone = {j for i in range(len(w) - width + 1) if doc is not None and first[b" ".join(w[i:i + width])] < doc for j in range(i, i + width)}
        out.append((doc, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone)))
    return Counter(out)


def test_phrases(docs, rows, monkeypatch):
    out = phrase_dedup.without_repeats(docs)
    assert Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in out.collect()) == kept_by_force(rows)


def test_phrases_over_many_blocks(spark, rows):
    """A passage in most documents, a common word run, and blocks of a few documents each."""
    passage = " ".join(f"p{i}" for i in range(60))
    made = [(i, (f"the {i} start of it " * 3 + passage + f" tail {i % 5} of the same words again and again " * 4).strip()) for i in range(150)]
    texts = spark.createDataFrame(made, "doc_id long, text string").repartition(12)
    out = phrase_dedup.without_repeats(texts)
    assert Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in out.collect()) == kept_by_force(made)


def test_phrases_of_no_rows(no_docs):
    assert phrase_dedup.without_repeats(no_docs).count() == 0


def test_words_longer_than_what_is_hashed_at_a_time(monkeypatch):
    monkeypatch.setattr(phrase_dedup, "HASH_BYTES", 64)
    monkeypatch.setattr(phrase_dedup, "_powers", [])
    text = b"ab " + b"x" * 500 + b" " + b"cd ef \n" * 40 + b"y" * 63 + b" ab"
    h = phrase_dedup.word_hashes(text)
    words = text.split()
    assert len(h) == len(words) and len(set(h.tolist())) == len(set(words))
    assert all(a == b for w, a in zip(words, h) for v, b in zip(words, h) if v == w)


def test_automata_in_shards(monkeypatch):
    monkeypatch.setattr(phrase_dedup, "SHARD_WORDS", 30)
    words = [b"%d" % (i % 20) for i in range(100)]
    passages = {tuple(words[i:i + 13 + i]): 5 for i in range(7)}
    made = phrase_dedup.Automata(passages)
    assert len(made.shards) > 3
    want = [(i, i + len(p)) for p in passages for i in range(100) if tuple(words[i:i + len(p)]) == p]
    assert sorted(made.found(words, 9)) == sorted(want) and made.found(words, 5) == []


def groups_by_force(rows):
    def fp(text):
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if s and 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = [fp(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], f, least.get(find(i)), find(i)) for i, (r, f) in enumerate(zip(rows, fps))]


def test_simhash(docs, rows):
    out = simhash_dedup.simhash_groups(docs).collect()
    want = groups_by_force(rows)
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in out) == Counter(w[:3] for w in want)


def test_one_of_each_group(docs, rows):
    kept = simhash_dedup.one_of_each_group(docs)
    assert kept.columns == docs.columns
    want = groups_by_force(rows)
    assert kept.count() == len({w[3] for w in want})
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) - {None} == {w[2] for w in want} - {None}


def test_simhash_of_no_rows(no_docs):
    assert simhash_dedup.simhash_groups(no_docs).count() == 0
    assert simhash_dedup.one_of_each_group(no_docs).count() == 0


def test_links_of_dense_and_random_fingerprints(spark):
    """Dense groups of any size are connected as by all pairs, without emitting them."""
    r = np.random.default_rng(3)
    centre = r.integers(0, 1 << 63, dtype=np.uint64)
    dense = {int(centre) ^ sum(1 << int(b) for b in r.choice(64, 3, replace=False)) for _ in range(400)}
    chain = [int(centre) ^ ((1 << 63) | ((1 << (4 * i)) - 1)) for i in range(1, 12)]
    random = r.integers(0, 1 << 63, 2000, dtype=np.uint64).tolist()
    fps = sorted(dense | set(chain) | set(random))
    v = np.array(fps, np.uint64)
    links = simhash_dedup.fingerprint_links(spark.createDataFrame([(int(x),) for x in v.view(np.int64)], "fp long"))
    rows = np.array([(x.a, x.b) for x in links.collect()], np.int64).view(np.uint64)
    assert (np.bitwise_count(rows[:, 0] ^ rows[:, 1]) <= 4).all()

    def parts(pairs):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {x: find(x) for x in fps}

    every = [(fps[i], fps[j]) for i in range(len(fps)) for j in (i + 1 + np.flatnonzero(np.bitwise_count(v[i + 1:] ^ v[i]) <= 4)).tolist()]
    assert parts(rows.tolist()) == parts(every)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(1, 200)]
    star = [(1000, 1000 + i) for i in range(1, 150)]
    out = components(spark.createDataFrame([*chain, *star, (5, 5)], "a long, b long"))
    got = {r.node: r.root for r in out.collect()}
    assert got == {**{i: 1 for i in range(1, 201)}, **{1000 + i: 1000 for i in range(150)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
