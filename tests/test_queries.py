"""Queries against their DuckDB equivalents on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from aerotrace.plans import catalogue

DATA = Path("/root/testdata/sf0.001")
SOME = ["q_target_objects", "q_resample_interp", "q_window_features", "q_topk_scores", "q_pair_features", "q_outcome_score", "q_log_roundtrip", "q_annotation_lines", "q_manual_edits", "q_class_report"]


def value(v):
    return ("nan" if math.isnan(v) else f"{v + 0.0:.9g}") if isinstance(v, float) else str(v)


@pytest.mark.skipif(not DATA.exists(), reason="the tables aren't here")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got = catalogue.QUERIES[name](spark, str(DATA))
    cursor = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(got.columns) == sorted(names)
    order = sorted(names)
    assert sorted(tuple(value(r[c]) for c in order) for r in got.collect()) == sorted(tuple(value(r[names.index(c)]) for c in order) for r in cursor.fetchall())


def test_every_oracle_has_its_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES) and len(catalogue.QUERIES) > 45


def test_numbers_are_rounded_as_the_oracles_round_them(spark):
    """125 knots are 64.3055 m/s, a double just below: its decimal text would be rounded up."""
    some = [125 * 0.514444, -125 * 0.514444, 0.0005, 2.0015, -0.0004, 1e17 + 0.5, float("inf"), *(i / 2000 for i in range(1, 400, 2))]
    got = catalogue.shown(spark.createDataFrame(list(enumerate(some)), "i int, x double"), ["i"], ["x"], 3).orderBy("i").collect()
    con = duckdb.connect()
    want = [con.execute("SELECT round(?::DOUBLE, 3) + 0e0", [x]).fetchone()[0] for x in some]
    assert [r.x for r in got] == want
