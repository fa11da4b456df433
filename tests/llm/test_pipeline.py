"""The stages one after another against what each operator says of its own input."""

from collections import Counter
from pathlib import Path

import pytest

import corpus_pipeline
from tidemark.llm.common import stored
from tidemark.llm.mixing import mix
from tidemark.llm.quality import quality_features
from tidemark.llm.secret_scan import secret_spans
from tidemark.llm.simhash_dedup import simhash_groups

SF = "/root/testdata/sf0.001"


def staged(spark, docs):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], SF), "test-" + name.replace(" ", "-")))
    return out


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_stages(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    told = " ".join(f"word{a}{b}" for a in "abcdefgh" for b in "klmno") + " password=hunter2hunter"
    one = spark.createDataFrame([(10**6, told, "en", "src1", len(told))], given.schema)
    docs, good, distinct, clean, mixed, packed = staged(spark, given.unionByName(one))
    for df in (good, distinct, clean, mixed):
        assert df.columns == docs.columns
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    assert ids(good) == ids(quality_features(docs).filter("kept"))
    assert ids(distinct) == ids(simhash_groups(good).filter("doc_id = component_id"))
    assert ids(clean) == ids(distinct)
    assert secret_spans(clean).filter("size(spans) > 0").count() == 0 < secret_spans(distinct).filter("size(spans) > 0").count()
    want = Counter({r.doc_id: r.copies for r in mix(clean).collect()})
    assert ids(mixed) == +want
    totals = Counter()
    for r in packed.collect():
        totals[r.doc_id] += r.length
    each = {r.doc_id: r.doc_tokens for r in packed.collect()}
    assert totals == Counter({i: each[i] * n for i, n in (+want).items()})


def test_odd_rows(spark, docs, no_docs):
    assert staged(spark, docs)[-1].count() > 0
    assert staged(spark, no_docs)[-1].count() == 0
