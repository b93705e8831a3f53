"""Every query with an oracle text gives DuckDB's rows on the smallest tables."""

from concurrent.futures import ThreadPoolExecutor

import __spark_entry__ as entry
from tests.compare import ROOT, compare


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_all_oracles(spark):
    qs, sqls = entry.queries(), entry.oracle_sql()

    def one(n):
        try:
            return compare(spark, n, qs[n], sqls[n], f"{ROOT}/sf0.001")
        except Exception as e:  # noqa: BLE001
            return n, "ERROR", 0, 0.0, str(e)[:300]

    with ThreadPoolExecutor(4) as pool:
        bad = [r for r in pool.map(one, sqls) if r[1] != "ok"]
    assert not bad
