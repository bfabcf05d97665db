"""Every registered query against its SQL; queries without SQL must give rows."""

import os

import pytest
from check_sql import compare

from srcmill.plans import catalog

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    verdict, _ = compare(spark, SF_DIR, name)
    assert verdict.startswith("same" if name in catalog.SQL else "rows"), verdict
