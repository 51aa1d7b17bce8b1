"""Every registered query of the library against its SQL on the smallest tables."""

import math
import re
from pathlib import Path

import duckdb
import pytest

from sessionloom.plans.catalog import ORACLES, QUERIES

TESTS = {m for f in Path(__file__).parent.glob("test_*.py") for m in re.findall(r"^def (test_\w+)", f.read_text(), re.M)}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return int(v) if v == int(v) else v
    return v


#: Queries that SQL cannot say (or not on whole tables in bearable time), and the test that holds their operator against a loop.
LOOPS = {
    "a2_digest": "test_digest_matches_a_loop", "a21_paths": "test_paths_of_known_curves", "e4_rule_sweep": "test_route_similarity_and_clusters_match_loops",
    "f13_coerce_elements": "test_elements_are_coerced", "g6_typed_runs": "test_typed_runs_match_a_loop", "g7_gestures": "test_gestures_match_one_event_at_a_time",
    "h3_cap_split": "test_cap_split_matches_a_loop", "m1_element_predicates": "test_element_predicates_leave_tab_strips_out", "m1_predicates": "test_predicates_of_a_snapshot", "m3_anchors": "test_anchors_have_paths_from_the_root",
    "m17_lcs": "test_route_similarity_and_clusters_match_loops", "m18_compatible": "test_route_similarity_and_clusters_match_loops", "m19_clusters": "test_route_similarity_and_clusters_match_loops",
    "r2_collapse": "test_fuse_matches_a_loop", "r7_fuse": "test_fuse_matches_a_loop", "r8_region_job": "test_region_jobs_fuse_their_sources", "t2_ann": "test_approximate_neighbours_as_registered",
    "t6_embed_text": "test_text_roles", "t12_collapse": "test_collapse_keeps_siblings_and_drops_relatives",
}


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    if name not in ORACLES:
        assert LOOPS[name] in TESTS and len(set(df.columns)) == len(df.columns)
        return
    want = db.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    key = lambda row: tuple((x is None, str(x)) for x in row)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=key)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)


def test_names_agree():
    assert set(ORACLES) <= set(QUERIES)
