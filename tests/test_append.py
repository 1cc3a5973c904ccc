"""An append deals its rows to as many tasks as they need."""

import re

from tripweave.sources import sinks


def test_tasks_of_an_append_follow_its_rows(spark, monkeypatch):
    monkeypatch.setattr(sinks, "APPEND_ROWS", 10, raising=False)
    known = spark.createDataFrame([(i,) for i in range(0, 100, 3)], "event_id long")
    rows = [(i, f"t{n}") for i in range(100) for n in (1, 0)]
    out = sinks.insert_ignore(known, spark.createDataFrame(rows, "event_id long, event_type string"))
    assert sorted(map(tuple, out.collect())) == [(i, "t0") for i in range(100) if i % 3]
    dealt = re.findall(r"hashpartitioning\(event_id#\d+L, (\d+)\)", out._jdf.queryExecution().executedPlan().toString())
    assert dealt and set(dealt) == {"20"}  # small ones may be read together
