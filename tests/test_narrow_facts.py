"""Facts of the columns a query reads: the same values, and no sort of the log for other texts."""

import os
import re

import pytest

from checks import spark_queries as checks

FOLDER = "/root/testdata/sf0.001"
HASHED = ["category_effects", "whale_share_scaled", "future_frame",
          "history_and_future", "masked_identity", "future_calendar_check",
          "column_spread"]

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


class Seen(Exception):
    pass


@pytest.mark.parametrize("name", HASHED)
def test_the_log_is_hashed(spark, monkeypatch, name):
    def look(frame, label, **faults):
        raise Seen(frame._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(checks, "snapshot", look)
    with pytest.raises(Seen) as seen:
        checks.QUERIES[name](spark, FOLDER)
    # The first grouping stands last; the second sorts merchant-days, not the log.
    kinds = [kind for kind, keys in re.findall(r"(\w+)Aggregate\(keys?=\[(.*?)\]", str(seen.value))
             if "merchant_id" in keys]
    assert kinds[-1] == "Hash"


@pytest.mark.parametrize("merchant", ["nation", "region"])
def test_narrow_facts_hold_the_same_values(spark, merchant):
    whole = checks.fact(spark, FOLDER, merchant, True).select(*checks.MEASURED)
    narrow = checks.fact(spark, FOLDER, merchant, True, checks.MEASURED)
    assert narrow.dtypes == whole.dtypes
    bags = [sorted(map(repr, frame.collect())) for frame in (whole, narrow)]
    assert bags[0] and bags[0] == bags[1]
