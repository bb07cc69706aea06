"""Every registered query gives the rows of its SQL, on the smallest tables."""

import glob
import os
import re

import pytest

import anchorage.queries as core

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def sql():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{TABLES}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def _plain(frame, columns):
    return sorted(map(repr, frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(core.QUERIES))
def test_query(spark, sql, name):
    got = core.QUERIES[name](spark, TABLES).toPandas()
    if name not in core.ORACLE_SQL:
        assert len(got)
        return
    want = sql.sql(core.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert _plain(got, columns) == _plain(want, columns)


@pytest.mark.parametrize("name", ["alignment_constraints", "annotation_constraints", "constraint_states"])
def test_capabilities_are_not_broadcast(spark, name):
    """They are many times the estimate, which is that of a compressed table; the driver holds a broadcast side whole."""
    rows = core.QUERIES[name](spark, TABLES)
    rows.collect()  # the plan as it ran in the end
    joins = re.findall(r"(\w+Join) \[cap_kind", rows._jdf.queryExecution().executedPlan().toString())
    assert joins and set(joins) == {"SortMergeJoin"}


def test_orders_are_not_dealt_by_their_one_key(spark):
    plan = core.QUERIES["order_constraints"](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [cap_kind" not in plan


def test_entry_stands_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/anchorage", tmp_path / "anchorage", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})


def test_digests_that_sql_lacks(spark):
    """Sequence and collection digests of the documents, by the standard library."""
    import base64
    import hashlib
    import json
    import re

    def short(data):
        return base64.urlsafe_b64encode(hashlib.sha512(data).digest()[:24]).decode()

    def array(values):
        return short(json.dumps(values, separators=(",", ":"), ensure_ascii=False).encode())

    texts = {f"doc{r['doc_id']}": r["text"] for r in spark.read.parquet(f"{TABLES}/documents.parquet").select("doc_id", "text").collect()}
    bases = {name: re.sub("[^A-Za-z]", "", text).upper() for name, text in texts.items()}
    ids = {name: "SQ." + short(b.encode()) for name, b in bases.items()}
    assert {r["name"]: r["refget"] for r in core.QUERIES["refget_identity"](spark, TABLES).collect()} == ids
    names = sorted(ids, key=lambda n: int(n[3:]))
    level = {"lengths": array([len(bases[n]) for n in names]), "names": array(names), "sequences": array([ids[n] for n in names])}
    row = core.QUERIES["collection_digest"](spark, TABLES).first().asDict()
    assert set(level.values()) <= set(row.values()), row
