"""Queries with SQL twins, and the pipeline, on the smallest tables."""

import os
import random

import pytest

from lodeview.llm import queries
from tests.compare import DATA, same
from tests.llm.test_operators import _by_buckets, _under_one_passage

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, name):
    same(queries.QUERIES[name](spark, DATA), queries.ORACLE_SQL[name])


def test_pipeline_stages(spark):
    import corpus_pipeline

    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "near_dedup", "source_mix", "sequence_packing"]
    pieces = corpus_pipeline.run(spark, DATA).collect()
    used = {}
    for r in pieces:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in used.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[-1][0] + spans[-1][1] <= 1024
    assert sum(spans[-1][0] + spans[-1][1] < 1024 for spans in used.values()) <= 1


def test_pipeline_on_odd_tables(spark, tmp_path):
    """No rows; then nulls, copies, repeated rows, a long text and columns with the names that stages use."""
    import corpus_pipeline

    kinds = "doc_id long, text string, lang string, source string, n_chars long, row long, id long, __measures long"
    empty = tmp_path / "empty"
    spark.createDataFrame([], kinds).write.parquet(str(empty / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    one, two = text(120), text(150)
    rows = [(1, one), (2, one.replace(" ", "\n")), (3, one + " more"), (4, two), (4, two), (None, text(90)), (5, None), (6, ""), (7, text(30_000)), (8, "too few words")]
    odd = tmp_path / "odd"
    spark.createDataFrame([(i, t, None, (None, "a")[k % 2], None, k, k, k) for k, (i, t) in enumerate(rows)], kinds).write.parquet(str(odd / "documents.parquet"))
    docs, left = spark.read.parquet(str(odd / "documents.parquet")), []
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(odd))
        assert docs.columns == columns, name
        left.append(sorted(str(r["doc_id"]) for r in docs.collect()))
    assert left[0] == ["1", "2", "3", "4", "4", "7", "None"] and left[1] == ["1", "3", "4", "7", "None"] and left[2] == ["1", "4", "7", "None"]
    assert set(left[3]) <= set(left[2])
    pieces = corpus_pipeline.run(spark, str(odd)).collect()
    assert {str(r["doc_id"]) for r in pieces} == set(left[3])


def test_pipeline_keeps_one_of_each_group_of_large_buckets(spark):
    import corpus_pipeline

    docs, root = _by_buckets(spark, _under_one_passage())
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == sorted(set(root))
