"""Every registered query with SQL equals DuckDB's result; this covers what the molecule engine registers."""

import glob
import inspect
import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spotweave.operators import clusters, noise, segmentation
from spotweave.plans import catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")


def normal(df):
    df = df[sorted(df.columns)].astype(object)
    text = lambda v: "-" if v is None or v is pd.NA or v != v else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = catalogue.queries()[name](spark, SF).toPandas()
    want = con.sql(catalogue.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fits_run_to_their_own_stops(spark, monkeypatch):
    """The registered fits name no rounds, start or graph of their own."""
    seen = {}

    def spy(module, name, result):
        real = getattr(module, name)

        def called(*args, **kw):
            bound = inspect.signature(real).bind(*args, **kw)
            given = dict(bound.arguments)
            bound.apply_defaults()
            seen[name] = (given, bound.arguments)
            return result(bound.arguments)

        monkeypatch.setattr(module, name, called)

    spy(noise, "append_confidence", lambda a: a["molecules"].withColumn("confidence", F.lit(1.0)))
    spy(clusters, "cluster_molecules", lambda a: (a["molecules"], []))
    spy(clusters, "compartments", lambda a: a["molecules"])
    spy(segmentation, "segment", lambda a: {"assigned": a["molecules"]})
    graphs = []
    monkeypatch.setattr(catalogue, "_graph", lambda m, adjacency="knn", keep_long=False: graphs.append(adjacency) or m)
    for name in ("noise_confidence", "molecule_clusters", "molecule_compartments", "segment_molecules"):
        catalogue.queries()[name](spark, SF)
    assert graphs == ["auto"] * 3 and seen["append_confidence"][1]["adjacency"] == "auto"
    for name in ("append_confidence", "cluster_molecules", "compartments"):
        assert not {"most", "expression", "tolerance", "patience"} & set(seen[name][0])
    assert seen["segment"][1]["iters"] == 500 and seen["segment"][1]["s"].history_depth == 50
