"""Every query against its SQL twin on the smallest tables."""

import os

import pytest

from lodeview import catalogue
from lodeview.plans import corpus
from tests.compare import DATA, same

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, name):
    same(catalogue.queries()[name](spark, DATA), catalogue.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_runs(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


@pytest.mark.parametrize("name", ["recent_files", "recent_since", "name_like_topk", "path_like_topk", "candidate_union_dedupe", "repo_like_topk", "fuzzy_names"])
def test_files_alone_need_no_index(spark, monkeypatch, name):
    """What asks only of files neither splits texts into words nor writes anything."""

    def fail(*_):
        raise AssertionError("an index is written")

    monkeypatch.setattr(corpus, "private_folder", fail)
    same(catalogue.queries()[name](spark, DATA + "/"), catalogue.oracle_sql()[name])  # a folder by another name: no index is there yet


def test_texts_are_the_blobs(spark, tmp_path):
    """Texts read without a join of the documents with themselves, also where numbers are repeated or missing."""
    rows = [(1, "a b", "en", "s", 3), (2, None, "en", "s", None), (3, "", None, None, 0), (None, "x", "en", "s", 1), (14, "y", "en", "s", 1)]
    spark.read.parquet(f"{DATA}/supplier.parquet").write.parquet(f"{tmp_path}/a/supplier.parquet")
    spark.read.parquet(f"{DATA}/supplier.parquet").write.parquet(f"{tmp_path}/b/supplier.parquet")
    for at, found in (("a", rows), ("b", [*rows, (1, "again", "en", "s", 5)])):
        spark.createDataFrame(found, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/{at}/documents.parquet")
        got, want = (sorted(map(repr, f(spark, f"{tmp_path}/{at}").collect())) for f in (corpus.texts, corpus.blobs))
        assert got == want


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
