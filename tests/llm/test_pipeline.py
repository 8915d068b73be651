"""The corpus pipeline: every stage against what it says it does, over a small table."""

from collections import Counter

import __spark_entry__ as entry
import corpus_pipeline
import pytest

from gridloom.llm import mixing, packing, resampling
from gridloom.llm.entry import tokenizer
from test_similar import slow_groups

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, f in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.written(f(spark, out[-1], SF), "t"))
    return out


def test_stages(spark, stages):
    docs, good, single, mixed, packed = stages
    assert all(x.columns == docs.columns for x in (good, single, mixed))
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    kept = {r.doc_id for r in resampling.resample(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert ids(good) == Counter(kept)
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    assert ids(single) == Counter({rows[g][0] for g in slow_groups([t for _, t in rows])})
    want = Counter({r.doc_id: r.taken // r.size for r in mixing.mixture(single).collect() if r.size})
    assert +ids(mixed) == +want
    tokens = Counter()
    for r in packed.collect():
        tokens[r.doc_id] += r.length
    per = {r.doc_id: r.doc_tokens for r in packing.pack(single, tokenizer("word_bpe_49k.json")).collect()}
    assert tokens == Counter({k: per[k] * n for k, n in want.items() if n})


def test_registered(spark):
    got = entry.queries()
    assert got["pipeline"].__wrapped__ is corpus_pipeline.run
    assert [n for n in got if n.startswith("op")] == sorted((n for n in got if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert len([n for n in got if n.startswith("op")]) == 10
    assert got["pipeline"](spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_odd_rows_pass_all_stages(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        names, now = docs.columns, docs
        for name, f in corpus_pipeline.STAGES:
            now = corpus_pipeline.written(f(spark, now, SF), "t")
            assert now.columns == names or name == "packing"
        assert (now.count() > 0) == (docs is odd_docs)
