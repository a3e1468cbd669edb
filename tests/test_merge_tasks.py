"""Learned merges: words go to as many tasks as there are cores, merges written out and walked are the same."""

from tracewright.operators import merges


def test_words_are_dealt_out_and_merges_agree(spark, monkeypatch):
    docs = spark.createDataFrame([("abab abc éé ab",), (None,)], "text string")
    counted = merges.words(docs, "text")
    assert counted.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    rules = [("61", "62"), ("6162", "6162"), ("C3", "A9")]
    found = spark.createDataFrame([(i, a, b, 2) for i, (a, b) in enumerate(rules)], merges.MERGES)
    want = [("ab", 2, 2), ("abab", 1, 1), ("é", 2, 2)]
    assert sorted(map(tuple, merges.dictionary(counted, found).collect())) == want
    monkeypatch.setattr(merges, "NESTED", 0)
    assert sorted(map(tuple, merges.dictionary(counted, found).collect())) == want
