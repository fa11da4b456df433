"""Quality features against a plain count, and the cascade's order and effect."""

import re
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.quality import BASE, RULES, good_documents, quality_features, ranked


def by_force(row):
    text = row[1] or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(w)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [" ".join(w[i:i + 8]) for i in range(n - 7)]
    times = Counter(windows)
    repeated = len({j for i, x in enumerate(windows) if times[x] > 1 for j in range(i, i + 8)})
    chars, symbols, dup = sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines))
    failed = n < 20 or 100 * repeated > 30 * n
    letterless = sum(not any(c.isalpha() for c in x) for x in w)
    shouted = sum(any(c.isupper() for c in x) and not any(c.islower() for c in x) for x in w)
    bad = 100 * symbols > 10 * n or chars < 2 * n or chars > 12 * n or 100 * dup > 50 * len(lines) or 100 * letterless > 30 * n or 100 * shouted > 30 * n
    return row[0], n, chars, symbols, dup, repeated, failed, not failed and not bad


def test_features(docs, rows):
    out = quality_features(docs)
    assert out.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert Counter(map(tuple, out.collect())) == Counter(map(by_force, rows))


def test_every_rule_rejects_something_and_stays_native(spark, rows):
    made = [(i, t) for i, t in enumerate([
        "word " * 25 + "a b", " ".join(f"w{i}" for i in range(40)), " ".join(f"{i}" for i in range(30)), " ".join(f"WORD{'AB'[i % 2]}{'X' * (i % 9)}" for i in range(30)),
        "\n".join(["one two three four", "five six"] * 9), " ".join(f"a{'b' * 30}{i}" for i in range(30)), " ".join(f"w{i}#" for i in range(30)), "few words", None])]
    df = spark.createDataFrame(made, "doc_id long, text string")
    out = {r.doc_id: (r.base_failed, r.kept) for r in quality_features(df).collect()}
    assert out == {i: by_force((i, t))[-2:] for i, t in made}
    assert {r.doc_id for r in good_documents(df).collect()} == {i for i, (_, kept) in out.items() if kept}
    for plan in (quality_features(df), good_documents(df)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in text and "Exchange" not in text


def test_good_documents(docs, rows, no_docs):
    out = good_documents(docs)
    assert out.columns == docs.columns
    want = [r for r in rows if by_force(r)[-1]]
    assert Counter(map(tuple, out.collect())) == Counter(want)
    assert good_documents(no_docs).count() == 0 and quality_features(no_docs).count() == 0


def test_order_by_rejection_for_the_cost(docs):
    order = ranked(docs, (*BASE, *RULES))
    gains = [share / cost for _, cost, share in order]
    assert gains == sorted(gains, reverse=True) and len(order) == len(BASE) + len(RULES)


def test_a_row_that_is_rejected_is_not_shown_to_later_rules(spark):
    df = spark.range(10).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"))
    fails = quality.Rule("fails", lambda t, w: F.raise_error(F.lit("asked")).cast("boolean"), lambda: None)
    rejects = quality.Rule("all", lambda t, w: F.length(t) > 0, lambda: None)
    assert df.filter(quality.cascade([rejects, fails], lambda r: r.rejects(F.col("text"), None))).count() == 0
