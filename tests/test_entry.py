import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"
EXACT = ["coo_to_csc", "csc_ptr", "csc_positions", "apply_map", "clean_counts", "skew_conversion", "random_stream", "spmv", "equilibrate_general", "match_hungarian", "lsmr_damped", "solve_positive", "inertia"]


@pytest.mark.parametrize("name", EXACT)
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"create view {p.stem} as from '{p}'")
    a, b = entry.queries()[name](spark, DATA).toPandas(), c.execute(entry.oracle_sql()[name]).df()
    k = sorted(a.columns)
    assert k == sorted(b.columns)
    a, b = (x[k].sort_values(k).reset_index(drop=True) for x in (a, b))
    assert a.equals(b)


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_imports_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT / "lattica", tmp_path / "lattica", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'coo_to_csc' in e.queries() and not any(k.startswith('op') for k in e.queries()); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin", "PYTHONPATH": str(tmp_path)}, check=True)
