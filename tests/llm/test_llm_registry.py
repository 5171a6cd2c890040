"""Registered queries against their SQL, and the pipeline against a plain version."""

import pytest

import __spark_entry__ as registry
import corpus_pipeline
from checks.compare import connect, differences
from tillcast.llm import bpe, oracles, queries
from tillcast.llm.queries import vocabulary

from test_llm_bpe import own
from test_llm_lines import plain as plain_lines
from test_llm_quality import plain as plain_quality
from test_llm_simhash import plain_components, plain_print
from test_llm_winnow import plain as plain_hits


def test_every_operator_is_registered():
    names = set(registry.queries())
    assert set(queries.QUERIES) <= names and "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_matches_sql(spark, small, name):
    frame = registry.queries()[name](spark, small)
    assert differences(frame, connect(small), registry.oracle_sql()[name]) == []


def _rejected(text):
    n_words, chars, symbols, dup, repeat = plain_quality(text)
    lines = [x for x in text.split("\n") if x.split()]
    capitals = sum(c.isupper() for c in text)
    return (n_words < 50 or 100 * repeat > 50 * n_words or 10 * symbols > n_words
            or not 2 * n_words <= chars <= 20 * n_words or 10 * dup > 5 * len(lines)
            or 10 * text.count("!") > 3 * n_words or 2 * capitals > chars)


def test_pipeline_matches_a_plain_version(spark, small):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    docs = {i: t for i, t in docs.items() if not _rejected(t)}
    docs = dict(zip(docs, (t for _, _, t in plain_lines(list(docs.values()), 10)), strict=True))
    groups = plain_components({i: plain_print(t) for i, t in docs.items()})
    docs = {i: t for i, t in docs.items() if groups[i] == i}
    hits = plain_hits(list(docs.values()), items, 10)
    docs = {i: t for (i, t), (_, n, _) in zip(docs.items(), hits, strict=True) if not n}
    rows = corpus_pipeline.run(spark, small).collect()
    assert {r.doc_id: r.ids for r in rows} == {i: own(t) for i, t in docs.items()}
    assert len(rows) == len(docs) < 200
    assert bpe.load(vocabulary())


def test_stages_keep_the_columns_of_documents(spark, awkward, small):
    docs = awkward
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, small)
        assert after.columns == docs.columns, name
        assert stage(spark, docs.limit(0), small).count() == 0
    assert corpus_pipeline.tokens(spark, docs, small).count() == 10
