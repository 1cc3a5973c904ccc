"""Rounds of connected components write as many files as their links need."""

from tripweave.llm.components import components


def test_few_links_make_few_files(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 3000) if i % 10 < 4], "a long, b long")
    held = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        found = components(links)
        assert len(found.inputFiles()) == 1
        assert {r.node: r.root for r in found.collect()} == {i: i // 10 * 10 for i in range(3000) if i % 10 < 5}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
