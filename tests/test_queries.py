"""Every registered query with SQL against DuckDB on the same tables."""

import math
import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "~"
    if isinstance(v, float):
        return repr(round(v, 9)).removesuffix(".0")
    if isinstance(v, bytes | bytearray):
        return bytes(v).hex()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    want = found.fetchall()
    assert sorted(names) == sorted(got.columns)
    columns = sorted(names)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    assert rows == sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"pipeline"}))
def test_others_run(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_core_does_not_import_the_optional_subpackage():
    top = os.path.join(os.path.dirname(entry.__file__), "lamina")
    for folder, _, names in os.walk(top):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n)) as f:
                        assert not re.search(r"\bllm\b", f.read()), n
