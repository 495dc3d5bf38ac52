"""A fast subset of the driver's oracle check (Spark vs DuckDB) at sf0.001;
the full run is ``python tools/oracle_check.py``."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import compare, duck

from conftest import SF001

SUBSET = ["rate_by_keyword", "log_odds", "distinctive_terms", "top_bigrams", "length_percentiles",
          "length_histogram", "stratified_split", "soft_vote", "classification_report",
          "artifact_profile", "clean_text", "scan_paragraphs", "submission_rows", "official_dev",
          "span_check", "k_class_scores", "dedup_ids", "strict_lookup", "split_leakage", "sample_docs",
          "top_bigrams_cross_doc", "duplicate_profile", "truncated_texts",
          "length_levels", "counts_rollup", "labels_by_keyword", "vocabulary_sketches", "soft_vote_seven",
          "bayes_dev_scores", "epoch_history", "checkpoint_choice", "subword_bytes"]


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", SUBSET)
def test_query_matches_oracle(spark, con, name):
    line = compare(spark, con, name, E.queries()[name], E.oracle_sql().get(name), SF001)
    assert " OK " in line, line


def test_every_query_has_oracle_or_is_ml():
    from textlab.plans import ORACLE, QUERIES, load_all
    load_all()
    assert set(QUERIES) - set(ORACLE) == {"train_members", "best_by_f1", "param_search", "score_unlabelled",
                                          "class_weighted_members", "external_batch_scores", "halving_search",
                                          "subword_lengths", "subword_percentiles"}


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["term", "pcl_freq", "non_pcl_freq", "log_odds"]
    assert df.count() > 0
