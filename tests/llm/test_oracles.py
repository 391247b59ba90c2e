"""The queries that SQL can express, on the smallest tables; and the rest against what their contracts say."""

import os
from collections import defaultdict

import duckdb
import pytest

from clauseriver import llm

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


@pytest.mark.parametrize("name", llm.ORACLES)
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = llm.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    plain = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    got = sorted([plain(v) for v in row] for row in df.select(*cols).collect())
    sql = ", ".join(f'"{c}"' for c in cols)
    assert got == sorted([plain(v) for v in row] for row in con.execute(f"SELECT {sql} FROM ({llm.ORACLES[name]})").fetchall())


def test_columns_and_rows(spark):
    n = {t: spark.read.parquet(f"{SF}/{t}.parquet").count() for t in ("documents", "pages")}
    out = {k: llm.QUERIES[k](spark, SF) for k in ("op2_html_extract", "op5_near_dedup", "op6_pii", "op7_substring_dedup", "op9_packing", "op1_vp_search")}
    assert dict(out["op1_vp_search"].dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    assert dict(out["op2_html_extract"].dtypes) == {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"}
    assert out["op2_html_extract"].count() == n["pages"]
    for k in ("op5_near_dedup", "op6_pii", "op7_substring_dedup"):
        assert out[k].count() == n["documents"]
    tokens, seen = defaultdict(int), {}
    for r in out["op9_packing"].collect():
        tokens[r["doc_id"]] += r["length"]
        seen[r["doc_id"]] = r["doc_tokens"]
    assert tokens == seen and len(seen) == n["documents"]


def test_rest_stands_alone(tmp_path):
    """With only this part's two folders gone, the entry imports and tests of the rest pass."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    copy = tmp_path / "copy"
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache"))
    assert (copy / "corpus_pipeline.py").exists()
    env = {**os.environ, "PYTHONPATH": str(copy)}
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and not any(q.startswith('op') or q == 'pipeline' for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True)
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", "tests/test_rules.py", "tests/test_rulebase.py"], cwd=copy, env=env, check=True)
