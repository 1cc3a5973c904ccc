"""Places named in texts that many leads share."""

from tripweave.operators import search


def test_equal_texts_meet_the_catalog_once(spark):
    leads = [(i, ("Try red bolt 7 today at Copper Road, friends", "red bolt 7 it is", "nothing", None)[i % 4]) for i in range(40)]
    hubs = [(1, "Red Bolt 7", "2 copper road", "unknown"), (2, "red bolt 7", None, "unknown"), (3, "Red Bolt 7", "9 Copper Road", "closed"), (4, "blue", "Copper Road", "unknown")]
    frame = search.grounded(spark.createDataFrame(leads, "lead_id long, text string"), spark.createDataFrame(hubs, "hub_id long, name string, address string, closure_status string"))
    got = sorted((r.lead_id, r.hub_id) for r in frame.collect())
    assert got == sorted([(i, 1) for i in range(0, 40, 4)] + [(i, h) for i in range(1, 40, 4) for h in (1, 2)])
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [text" in plan[plan.index("Generate explode") :]
