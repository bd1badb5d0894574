"""The entry as a driver uses it: every query runs, its SQL names the same columns, and it does without the training-data part."""

import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from tests.conftest import ROOT

SF = "/root/testdata/sf0.001"
CORE = [n for n in __spark_entry__.queries() if not n.startswith("op") and n not in ("pipeline", "near_fingerprints")]


def plain(rows):
    return sorted(repr([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows)


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in ("nation", "region", "supplier", "part", "lineitem", "events"):
        con.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query(spark, tables, name):
    df = __spark_entry__.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    assert len(rows) > 0
    if sql := __spark_entry__.oracle_sql().get(name):
        listed = ", ".join(f'"{c}"' for c in columns)
        assert sorted(tables.sql(sql).columns) == columns
        assert plain(rows) == plain(tables.sql(f"select {listed} from ({sql})").fetchall())


def test_without_the_training_data_part():
    """In a process that can't see them, the entry has all other queries."""
    code = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("stackloom.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), any(n.startswith("op") for n in e.queries()))
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True).stdout.split()
    assert out[0] == str(len(CORE)) and out[2] == "False"


def test_shared_folder():
    """The session's setting comes first; without one, only local mode makes a folder of its own."""
    from types import SimpleNamespace as N

    from stackloom.plans.session import shared_folder

    def session(master, own=None, held=None):
        option = N(isDefined=lambda: held is not None, get=lambda: held)
        context = N(master=master, _jsc=N(sc=lambda: N(getCheckpointDir=lambda: option)), getConf=lambda: N(get=lambda key: None))
        return N(sparkContext=context, conf=N(get=lambda key, default: own))

    assert shared_folder(session("yarn", "hdfs:/a/", "hdfs:/b")) == "hdfs:/a" and shared_folder(session("yarn", None, "hdfs:/b")) == "hdfs:/b"
    assert shared_folder(session("local[4]")).startswith("file:")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared_folder(session(master))
