"""Every registered query of the text operators on the smallest driver tables; with its SQL where there is one."""

from __future__ import annotations

import os

import oracle
import pytest

import __spark_entry__ as entry
from footfall.llm import queries

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")


def test_one_query_for_each_operator_and_the_pipeline():
    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert sorted(n.split("_")[0] for n in names) == sorted(["pipeline", *(f"op{k}" for k in range(1, 14))])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    problem = oracle.compare(queries.QUERIES[name](spark, SF_DIR), oracle.connect(SF_DIR), queries.ORACLES[name])
    assert problem is None, problem


@pytest.mark.parametrize("name", ["op1_license_scan", "op5_lm_score", "op8_secret_scan", "op9_segment", "op10_pii", "op13_lang_id"])
def test_query_has_a_row_for_each_document(spark, name):
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id").collect())
    assert sorted(r.doc_id for r in queries.QUERIES[name](spark, SF_DIR).collect()) == ids


def test_chat_query_has_a_row_for_each_conversation(spark):
    table = spark.read.parquet(f"{SF_DIR}/conversations.parquet")
    got = queries.QUERIES["op3_chat_format"](spark, SF_DIR).collect()
    assert len(got) == table.select("conv_id").distinct().count()
    assert sum(r.n_right for r in got) > 0.8 * sum(r.n_labelled for r in got)
