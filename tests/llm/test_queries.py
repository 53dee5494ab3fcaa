"""Every registered query of the text operators, and the SQL of those that have one."""

import re

import pytest
from oracle import connect, differences

from __spark_entry__ import oracle_sql, queries
from gridweave.llm.queries import ORACLE, QUERIES

COLUMNS = {
    "op1": "doc_id piece start length ids_crc32 sequence_id offset",
    "op2": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op3": "doc_id language accepted",
    "op4": "doc_id held_out score predicted",
    "op5": "doc_id fingerprint component_id",
    "op6": "doc_id size text_crc32 law shard slot grown_shard",
    "op7": "doc_id keep_id group_size kept text_sha256",
    "op8": "doc_id item_id containment",
    "op9": "doc_id n_words n_removed kept_sha256",
    "op11": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op12": "doc_id held_out score predicted",
    "op13": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op10": "doc_id n_words n_base first_word last_word base_labels labels score",
}


def test_registered():
    found = queries()
    assert set(QUERIES) | {"pipeline"} <= set(found) and set(ORACLE) <= set(oracle_sql())
    for n in COLUMNS:
        assert sum(name.startswith(f"{n}_") for name in found) == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_runs(spark, sf, name):
    found = QUERIES[name](spark, sf)
    wanted = COLUMNS[re.match(r"op\d+", name)[0]].split() if name.startswith("op") else []
    assert set(wanted) <= set(found.columns)
    assert len(found.collect()) > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, name):
    assert differences(QUERIES[name](spark, sf).toPandas(), connect(sf).sql(ORACLE[name]).df()) == ""
