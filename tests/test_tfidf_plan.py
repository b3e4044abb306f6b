import re

from loomtext.operators import tfidf


def test_terms_are_not_shuffled_by_document(spark):
    """Counting and norms take the shuffle of the texts; no row of a document's term is sent by id and term."""
    df = spark.createDataFrame([(1, "one two two"), (1, "two three"), (2, None), (None, "one")], "id long, text string")
    weights = tfidf.tfidf(df, "id", "text")
    plan = weights._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(id#\d+L?, term#", plan)
    assert sorted((r["id"] or 0, r["term"]) for r in weights.collect()) == [(0, "one"), (1, "one"), (1, "three"), (1, "two")]
