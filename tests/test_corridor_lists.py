"""The short list read off narrow ellipses equals the one from the pairs of the whole corridor."""

import numpy as np

from tripweave.operators import candidates, corridor
from tripweave.queries.registry import Given
from tripweave.queries.trips import plan

FOLDER = "/root/testdata/sf0.001"


def test_short_lists_need_no_pairs_of_the_whole_corridor(spark, monkeypatch):
    p = plan(Given(spark, FOLDER))
    whole = candidates.select_hubs(p.corridor_rows().unionByName(p.rescued())).select("sid", "hub_id", "coverage")
    want = sorted(map(tuple, whole.collect()))
    monkeypatch.setattr(candidates, "near_route", None)
    monkeypatch.setattr(corridor, "SLICE", 100)
    q = plan(Given(spark, FOLDER))
    assert sorted(map(tuple, q.shortlist().select("sid", "hub_id", "coverage").collect())) == want
    fields = ["sid", "stop1", "stop2", "position"]
    uncut = candidates.prune(candidates.options(q.shortlist())).select(fields)
    assert sorted(map(tuple, q.pruned_first().select(fields).collect()), key=repr) == sorted(map(tuple, uncut.collect()), key=repr)
    assert q.lists(cut=True).count() < q.lists().count()


def test_ellipses_hold_every_hub_of_a_short_detour():
    rng = np.random.default_rng(4)
    y, x = rng.uniform(0, 25, 3000), rng.uniform(0, 50, 3000)
    sites = corridor._Sites(np.arange(3000), y, x)
    ends = rng.uniform(0, 25, (4, 200))
    ends[2:, :5] = ends[:2, :5]
    oy, ox, dy, dx = ends
    reach = np.hypot(dy - oy, dx - ox) + rng.choice([0.001, 0.05, 1.0, 40.0], 200)
    met = {(int(s), int(h)) for a, b in sites.around(oy, ox, dy, dx, reach) for s, h in zip(a, b)}
    way = np.hypot(y[None] - oy[:, None], x[None] - ox[:, None]) + np.hypot(y[None] - dy[:, None], x[None] - dx[:, None])
    assert {(int(s), int(h)) for s, h in zip(*np.nonzero(way <= reach[:, None]))} <= met and len(met) < 200 * 3000 / 2


def test_searches_with_a_brand_read_no_other_whole_list(spark):
    from tripweave.queries import QUERIES, registry

    registry.forget()
    found = QUERIES["join_exact_brand"](spark, FOLDER)
    made = registry.workspace(spark, FOLDER)._made["trip plan"]._made
    assert "lists" not in made and "shortlist" not in made and found.count() > 0
