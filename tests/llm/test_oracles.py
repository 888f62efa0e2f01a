import pytest
from helpers import SMALL, same

from vitrine.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_duckdb(spark, duck, name):
    same(spark, duck, QUERIES[name], ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["op5_exact_dedup", "op4_line_dedup", "op9_benchmark_decontamination", "op1_minhash_near_dedup", "op6_token_counts"])
def test_every_document_has_a_row(spark, name):
    assert QUERIES[name](spark, SMALL).count() == spark.read.parquet(f"{SMALL}/documents.parquet").count()
