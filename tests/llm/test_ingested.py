"""The persisted index, over the stored table in groups of source files, finds what one pass finds."""

import os

import pytest

from tarrafa.llm import queries

SF = os.environ.get("TARRAFA_TEST_SF", "/root/testdata/sf0.01")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_groups_of_files_give_the_rows_of_one_pass(spark):
    ids = lambda name: sorted(r["id"] for r in queries.QUERIES[name](spark, SF).collect())
    assert ids("p4_ingested") == ids("p4_found") != []
