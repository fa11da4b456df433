"""Benchmark passages in documents against a search of every window in every document."""

import random
import re
from collections import Counter

import pytest

from tidemark.llm import decontamination
from tidemark.llm.decontamination import Windows, contamination
from tidemark.llm.queries import op11_decontamination

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
ITEMS = "item_id int, text string, doc_id string, n_hit int"


def brute(rows, items):
    out = []
    wanted = []
    for item, text in items:
        w = WORDS.findall((text or "").translate(LOWER))
        wanted += [(item, w[i:i + 10]) for i in range(max(1, len(w) - 9))] if w else []
    for doc, text in rows:
        w = WORDS.findall((text or "").translate(LOWER))
        hit, names = set(), set()
        for item, window in wanted:
            for i in range(len(w) - len(window) + 1):
                if w[i:i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    names |= {str(item)} - {"None"}
        spans, at = [], [m.span() for m in WORDS.finditer((text or "").translate(LOWER))]
        for i in sorted(hit):
            spans = spans[:-1] + [(spans[-1][0], at[i][1])] if i - 1 in hit else spans + [at[i]]
        out.append((doc, len(w), len(hit), tuple(spans), tuple(sorted(names))))
    return Counter(out)


def told(df):
    return Counter((r.doc_id, r.n_words, r.n_hit, tuple(map(tuple, r.spans)), tuple(r["items"])) for r in df.collect())


@pytest.fixture(scope="module")
def items(rows):
    text = {r[0]: r[1] for r in rows}
    words = text[0].split()
    return [
        (1, " ".join(words[20:60])), (2, " ".join(words[40:52]).upper()), (3, "THE end"), (4, None), (5, "... !"), (6, "日本語"),
        (7, " ".join(words[20:60])), (7, "of the end of"), (None, " ".join(words[100:110])), (8, text[6][:3000]), (8, text[6][:3000]),
        (9, "one - two, THREE!"), (10, text[18][:200]), (11, "nowhere at all"), (12, "same line " * 12), (13, "ÜBERGRÖSSEN"), (14, "w0 " * 9 + "w1"),
    ]


def test_against_every_window(spark, docs, rows, items, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE_WORDS", 50)
    benchmark = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(items)], ITEMS)
    want = brute([(r[0], r[1]) for r in rows], items)
    assert told(contamination(docs, benchmark)) == want
    # several automata of a small size one after the other
    assert told(contamination(docs, benchmark, automaton_bytes=1500)) == want


def test_parts_of_a_long_text(monkeypatch):
    r = random.Random(3)
    words = [r.choice("ab") for _ in range(3000)]
    text = " ".join(words) + "é" * 50 + ", b a"
    pieces = [("1", "a b a b a b a b a b a b"), ("2", "b"), ("3", "a a"), ("4", "b a"), ("5", "é" * 50)]
    whole = Windows([(i, t.encode()) for i, t in pieces]).scan(text.encode())
    monkeypatch.setattr(decontamination, "PART_BYTES", 7)
    assert Windows([(i, t.encode()) for i, t in pieces]).scan(text.encode()) == whole
    got = brute([(0, text)], pieces)
    assert (whole[0], sum(b - a + 1 for a, b in whole[1])) == next(iter(got))[1:3]


def test_empty_tables(spark, docs, no_docs):
    none = spark.createDataFrame([], ITEMS)
    some = spark.createDataFrame([(1, "the end", "x", 1)], ITEMS)
    assert contamination(no_docs, some).count() == 0
    out = contamination(docs, none).collect()
    assert len(out) == docs.count() and not any(r.n_hit or r["items"] for r in out)


def test_query_columns(spark):
    out = op11_decontamination(spark, "/root/testdata/sf0.001")
    assert dict(out.dtypes) == {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}
