"""Every registered query against its SQL on the smallest tables."""

import importlib.util
import pathlib

import pytest

import __spark_entry__ as entry
from quaymark.plans import QUERIES

ROOT = pathlib.Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
spec = importlib.util.spec_from_file_location("verify", ROOT / "tools" / "verify.py")
verify = importlib.util.module_from_spec(spec)
spec.loader.exec_module(verify)

pytestmark = pytest.mark.skipif(not pathlib.Path(DATA).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return verify.connect(DATA)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, DATA).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert verify.canonical(got) == verify.canonical(want)
