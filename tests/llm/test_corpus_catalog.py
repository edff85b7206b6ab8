"""The corpus queries: registered once each, and equal to their SQL twins."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from compare import connect, differences  # noqa: E402

import __spark_entry__  # noqa: E402
from tauframe.llm.catalog import ORACLES, QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    # By Arrow on both sides, so that whole numbers with nulls get the same type.
    got = QUERIES[name](spark, SF_DIR).toArrow()
    want = connect(SF_DIR).execute(ORACLES[name]).to_arrow_table()
    types = {n: str(want.schema.field(n).type) for n in want.column_names}
    assert {n: str(got.schema.field(n).type) for n in got.column_names} == types
    assert differences(got.to_pandas(), want.to_pandas()) == []


def test_all_are_registered():
    names = list(__spark_entry__.queries())
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
