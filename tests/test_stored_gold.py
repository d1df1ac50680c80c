"""Queries that read gold more than once derive it from the events once."""

import pytest

from farebox import catalog
from farebox.sources import fixtures as X


@pytest.mark.parametrize("name", ["snapshot_diff_buckets", "stream_vector_sync", "semantic_rides"])
def test_gold_is_derived_once(spark, sf, monkeypatch, name):
    calls, real = [], X.ride_gold
    monkeypatch.setattr(X, "ride_gold", lambda *a: calls.append(a) or real(*a))
    catalog.QUERIES[name](spark, sf)
    assert len(calls) == 1
