"""A walk that writes leaves alone has those of the whole walk."""

from tracewright.operators import trees


def test_leaves_alone_are_those_of_the_walk(spark):
    docs = spark.createDataFrame([(1, '{"a":[1,{"b":null}],"c":{},"d":[]}'), (2, "3"), (3, None), (4, "[]")], "id int, t string")
    alone = trees.walk(docs, "id", "t", whole=False)
    want = sorted(map(tuple, trees.leaves(trees.walk(docs, "id", "t")).collect()))
    assert sorted(map(tuple, alone.collect())) == want and len(want) == 6
