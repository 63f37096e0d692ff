import subprocess
import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions.ufuncs import BINARY

ROOT = Path(__file__).resolve().parent.parent
D = "/root/testdata/sf0.001"


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert len(rows) == 200 and set(rows[0].asDict()) == {"chrom", "k", "mean_contact"}


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


#: One of each kind; the driver compares all of them.
SOME = ["ingest_coo", "ingest_last", "count_masked", "filled", "slice_rect", "set_values", "normalize_diag", "sum_all", "std_row", "prod_diag", "uf_unary", "uf_bitwise", "uf_matrices", "diag_mean", "diamond_mean", "regions", "trim_sparse"]


@pytest.mark.parametrize("name", SOME)
def test_queries_equal_sql(spark, name):
    got = entry.queries()[name](spark, D)
    con = duckdb.connect()
    for t in ("events", "lineitem", "part"):
        con.execute(f"create view {t} as select * from read_parquet('{D}/{t}.parquet')")
    cols = sorted(got.columns)
    want = con.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, want))


def copied_events(folder, copies):
    """The events again and again, by the same users: pairs grow with the square of the copies."""
    duckdb.sql(f"copy (select e.* replace (event_id + 1000000 * r.r as event_id) from '{D}/events.parquet' e, range({copies}) r(r)) to '{folder}/events.parquet' (format parquet)")


def rows_of_sql(folder, name, cols):
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{folder}/events.parquet')")
    return con.execute("select " + ", ".join(f'"{c}"' for c in cols) + f" from ({entry.oracle_sql()[name]})").fetchall()


def test_products_beyond_doubles_equal_sql(spark, tmp_path):
    copied_events(tmp_path, 12)
    want = rows_of_sql(tmp_path, "prod_all", ["chrom", "value"])
    assert all(v > 308.3 for _, v in want)  # no double holds these products
    got = entry.queries()["prod_all"](spark, str(tmp_path)).select("chrom", "value").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_digits_of_large_numbers_equal_sql(spark):
    """Power and others leave numbers whose sixth digit is beyond a double's; halves and borders too."""
    from tessera.plans.queries import _six

    rng = np.random.default_rng(5)
    x = np.concatenate([10.0 ** rng.uniform(-9, 17, 4000) * rng.choice([-1, 1], 4000), [30330344419.970974, 2.4760953182144556e16, 5e-7, -1.5e-6, 1.0000005, 0.0, -0.0, 8e307, 1e303, np.inf, -np.inf, np.nan]])
    got = [r[0] for r in spark.createDataFrame([(float(v),) for v in x], "v double").coalesce(1).select(_six(F.col("v"))).collect()]
    con = duckdb.connect()
    want = [con.execute("select round(?::double, 6) + 0.0", [float(v)]).fetchone()[0] for v in x]
    assert list(map(repr, got)) == list(map(repr, want))


def test_sums_of_large_powers_do_not_overflow(spark):
    """Where exp(a) + exp(b) is infinite, logaddexp is NumPy's and finite."""
    a, b = np.array([1616.5, 956.5, -2000.0]), np.array([-6.5, 956.5, -2001.0])
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b, strict=True)], "a double, b double").coalesce(1)
    got = np.array([tuple(r) for r in df.select(BINARY["logaddexp"](F.col("a"), F.col("b")), BINARY["logaddexp2"](F.col("a"), F.col("b"))).collect()])
    np.testing.assert_allclose(got, np.column_stack([np.logaddexp(a, b), np.logaddexp2(a, b)]), rtol=1e-15)


def test_works_without_the_training_data_operators(tmp_path):
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("tessera.llm"):
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as e
q = e.queries()
assert "diag_mean" in q and "pipeline" not in q and not any(n.startswith("op") for n in q)
assert set(e.oracle_sql()) <= set(q)
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
