"""Every registered query gives rows on the middle-sized tables, equal to its SQL's."""

from decimal import Decimal

import duckdb
import pytest

from tests.test_oracles import TABLES, rows_of
from wattline.plans import catalog_queries, learning_queries, pattern_queries, phase_queries, profile_queries, series_queries

SOURCE = "/root/testdata/sf0.01"
QUERIES = {**series_queries.QUERIES, **learning_queries.QUERIES, **pattern_queries.QUERIES, **profile_queries.QUERIES, **phase_queries.QUERIES, **catalog_queries.QUERIES}
ORACLES = {**series_queries.ORACLES, **learning_queries.ORACLES, **pattern_queries.ORACLES, **profile_queries.ORACLES, **phase_queries.ORACLES, **catalog_queries.ORACLES}
#: Columns that say how a row was judged: more than one value of each must occur.
VERDICTS = {
    "p29_training_filter": ("fault",), "w16_synchronized_rise": ("synchronized",), "w19_cycles": ("start_reason", "cut_start", "cut_end"), "c13_prepared_cycles": ("tier", "unstable", "device"),
    "c15_learned_in_order": ("action", "reason"), "c16_learned_patterns": ("status", "seen"), "j12_provisional_match": ("action",), "a24_learning_events": ("action", "reason"), "r21_dedup_match": ("action",),
    "c08_decision": ("label", "source"), "c12_label_suggestion": ("label", "source", "reason"), "c10_hybrid_vote": ("label",), "c18_nightly_merge": ("merged",), "c23_replayed_cycles": ("replay",),
}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SOURCE}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_on_cycles(spark, duck, name):
    df = QUERIES[name](spark, SOURCE)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got[1]
    for column in VERDICTS.get(name, ()):
        k = got[0].index(column)
        assert len({r[k] for r in got[1]}) > 1, column
    if name in ORACLES:
        cursor = duck.execute(ORACLES[name])
        want = rows_of([d[0] for d in cursor.description], [tuple(float(v) if isinstance(v, Decimal) else v for v in r) for r in cursor.fetchall()])
        assert got[0] == want[0]
        assert len(got[1]) == len(want[1])
        wrong = [(g, w) for g, w in zip(got[1], want[1], strict=True) if g != w]
        assert not wrong, wrong[:3]


def test_modes_see_all_cycles(spark):
    n = QUERIES["a07_cycle_features"](spark, SOURCE).count()
    seen = sum(r.seen for r in QUERIES["a17_operating_modes"](spark, SOURCE).collect())
    assert seen > 0.5 * n


def test_forest_has_its_defaults(spark, monkeypatch):
    from wattline.operators import forest

    models, train = [], forest.train
    monkeypatch.setattr(forest, "train", lambda *a, **b: models.append(train(*a, **b)) or models[-1])
    QUERIES["c11_random_forest"](spark, SOURCE)
    trees = models[0].stages[-1]
    assert trees.getNumTrees == 80 and trees.getOrDefault("maxDepth") == 10
    assert {"heating", "motor", "active_phases"} <= set(models[0].stages[1].getInputCols())
