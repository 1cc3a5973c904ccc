"""Pairs of similar texts: few bytes of queries are spread, lengths too far apart never meet."""

from tripweave.operators import search


def test_queries_are_spread_and_pairs_are_exact(spark):
    words = ["abc", "abcd", "abcdef", "customer12", "custmer12", "x", "abcabcabcabc"]
    queries = spark.createDataFrame([(w,) for w in words + words], "q string").coalesce(1)
    names = spark.createDataFrame([(w,) for w in words], "name string")
    pairs = search.similar_pairs(queries, "q", names, "name", 0.6)
    assert "RepartitionByExpression" in pairs._jdf.queryExecution().optimizedPlan().toString()

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = sorted((a, b) for a in words for b in words if 1 - distance(a, b) / max(len(a), len(b)) >= 0.6)
    assert sorted((r.q, r.name) for r in pairs.collect()) == want
