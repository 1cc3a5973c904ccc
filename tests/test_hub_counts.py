"""Hub counts of trips read what their answer depends on and no more."""

from tripweave.queries import QUERIES, registry

FOLDER = "/root/testdata/sf0.001"


def test_hub_counts_need_no_routes(spark):
    registry.forget()
    found = QUERIES["join_hubs_for_categories"](spark, FOLDER)
    made = registry.workspace(spark, FOLDER)._made["trip plan"]._made
    assert not {"routes", "searches", "choices", "plans"} & set(made)
    assert found.count() > 0
