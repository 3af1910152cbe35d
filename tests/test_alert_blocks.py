"""Alerts keep many waiting ticks in one row of state."""

import numpy as np
import pandas as pd

from orrery.streaming import streams
from tests.test_round_trips import Mark, Stored


def test_a_batch_of_ticks_is_a_few_rows_of_state():
    stored, rules = Stored(), streams.AlertRules(60.0, 2.0, 3, 0)
    rules.init(stored)
    price = np.tile([10.0, 70.0], 50_000)
    frame = pd.DataFrame({"ts": pd.to_datetime(np.arange(100_000) * 1_000_000, unit="us"), "id": np.arange(100_000), "price": price})
    list(rules.handleInputRows(("s",), iter([frame]), Mark(0)))
    assert stored.written == 2
    out = pd.concat(rules.handleExpiredTimer(("s",), Mark(100_000_000), None))
    assert out[out["rule"] == "cross"]["id"].tolist() == list(range(1, 100_000, 2)) and not stored.rows


def test_rising_skips_what_comes_too_soon():
    us = np.array([-5, 0, 0, 3, 10, 12, 20])
    assert streams.rising(us, streams.AlertRules.NEVER, 10) == [0, 4, 6]
    assert streams.rising(us, 0, 10) == [4, 6] and streams.rising(us, -5, 0) == [0, 1, 2, 3, 4, 5, 6]
