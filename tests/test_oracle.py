"""Every registered query against its SQL in DuckDB, over whole tables."""

import pytest
from pitchflow import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(check_sql, name):
    least = 0 if name in ("detection_pairs", "phantom_frames", "stationary_tracks", "nearest_same_frame") else 1
    check_sql(catalog.QUERIES[name], catalog.ORACLE_SQL[name], least=least)
