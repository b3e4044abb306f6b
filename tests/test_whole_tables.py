import pytest
from pyspark.sql import functions as F

from loomtext.operators import review
from loomtext.plans import registry

D = "/root/testdata/sf0.01"


def test_sessions_fold_all(spark):
    n_docs, n_events = (registry.table(spark, D, t).count() for t in ("documents", "events"))
    items, log = registry._session(spark, D)
    assert items.select("item").distinct().count() == items.count() == n_docs
    assert log.select(F.floor(F.col("seq") / 2)).distinct().count() == n_events
    users = registry.table(spark, D, "events").select("user_id").distinct().count()
    state = review.fold_annotations(items, log).collect()
    assert len(state) == n_docs and len({r["session"] for r in state}) == users
    assert len({r["status"] for r in state}) > 2
    stats = registry.QUERIES["g5_g6_stats"](spark, D).agg(F.sum("total")).first()[0]
    assert stats == n_docs


@pytest.mark.parametrize("name", ["p2_themes", "j16_examples"])
def test_reads_documents(spark, sf_dir, name, monkeypatch):
    seen = []
    read = registry.table
    monkeypatch.setattr(registry, "table", lambda s, d, t: seen.append(t) or read(s, d, t))
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
    assert seen == ["documents"]
