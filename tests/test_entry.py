"""Every registered query of the library itself against its SQL on the smallest tables."""

import math
import os
import subprocess
import sys
from pathlib import Path

import pytest

from barloom.plans import registry

ROOT = Path(__file__).resolve().parents[1]
DIR = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.8g}" if v else "0"
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"create view {f[:-8]} as select * from '{DIR}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, DIR)
    rows = sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    found = duck.execute(sql)
    at = {d[0]: i for i, d in enumerate(found.description)}
    assert sorted(at) == sorted(df.columns)
    assert rows == sorted(tuple(plain(r[at[c]]) for c in sorted(at)) for r in found.fetchall())


def test_entry_works_without_the_llm_subpackage(tmp_path):
    for name in ("barloom", "__spark_entry__.py"):
        os.symlink(ROOT / name, tmp_path / name) if name != "barloom" else None
    (tmp_path / "barloom").mkdir()
    for p in (ROOT / "barloom").iterdir():
        if p.name not in ("llm", "__pycache__"):
            os.symlink(p, tmp_path / "barloom" / p.name)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), 'pipeline' in q)"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
    assert out.stdout.split()[1:] == ["False", "False"], out.stderr
