"""Every query of the catalogue runs, and agrees with its SQL, on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from barlight.plans import catalogue

ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def con(tiny):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for p in Path(tiny).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return c


def _canon(rows):
    return sorted([tuple("~" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v).replace("+00:00", "") for v in r) for r in rows])


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, con, tiny, name):
    got = catalogue.QUERIES[name](spark, tiny)
    rows = got.collect()
    assert got.columns and all("(" not in c for c in got.columns)
    if name in catalogue.SQL:
        want = con.execute(catalogue.SQL[name])
        columns = [c[0] for c in want.description]
        assert sorted(columns) == sorted(got.columns)
        assert _canon([[r[c] for c in columns] for r in rows]) == _canon(want.fetchall())


def test_entry_works_without_the_optional_package():
    code = "import sys; sys.modules['barlight.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p1_found' in q and 'p2_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_outside_imports_the_optional_package():
    for p in (ROOT / "barlight").rglob("*.py"):
        if "llm" not in p.parts:
            assert "barlight.llm" not in p.read_text(), p


def test_flagship_plan_has_no_range_product(spark, tiny):
    plan = catalogue.QUERIES["lookback_match"](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
