"""Driver contract: entry(), registered queries, oracle SQL on the smallest scale."""

import pytest

import __spark_entry__ as entry
from tests.oracle_compare import compare, duck

SF = "/root/testdata/sf0.001"


def test_contract_keys():
    qs, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(qs) and len(qs) >= 50
    assert all(callable(q) for q in qs.values())


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["cv_id", "job_id", "similarity", "rank"]
    assert df.count() > 0


@pytest.mark.parametrize("name", ["topk_title", "cascade_full", "ivf_given_cells", "content_hash",
                                  "extract_skills", "publish_replace", "ndcg_at_k", "get_or_create_company",
                                  "parse_salary", "similar_count_per_job"])
def test_oracle_small(spark, name):
    r = compare(spark, name, entry.queries()[name], entry.oracle_sql()[name], SF, duck(SF))
    assert r["match"], r
