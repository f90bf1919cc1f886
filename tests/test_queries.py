"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from check import canonical
from kerbline.plans import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf, duck):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["conv_id", "prompt", "n_turns", "length"]
    assert out.count() > 0
