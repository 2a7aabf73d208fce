"""Documents that contain passages: found without a shuffle of the documents."""

from lexspark.operators import containment


def test_documents_are_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "x one two three four five y"), (2, "one two three four"), (3, "six")], "doc_id int, text string")
    items = spark.createDataFrame([(7, "one two  three four five"), (8, "six")], "item_id int, text string")
    found = containment.containing(docs, items, "doc_id", "item_id")
    assert sorted(map(tuple, found.collect())) == [(1, 7), (3, 8)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") >= 2
