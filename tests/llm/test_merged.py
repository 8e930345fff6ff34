"""What Spark may send to the driver by its own choice."""

import corpus_pipeline
from glossaflow.llm import ngram_join, packing, queries
from glossaflow.llm.common import Scratch

from . import edges
from .test_ngram_join import template


def test_joins_of_the_pipeline_are_merged(spark, monkeypatch):
    """Only the large classes of the passages are broadcast, as asked for: no table, whose compressed file may be small, and no exploded rows."""
    plans, write = [], Scratch.table

    def plan(name, df):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))

    def watched(self, name, df, *partition_by):
        plan(name, df)
        return write(self, name, df, *partition_by)

    monkeypatch.setattr(Scratch, "table", watched)
    monkeypatch.setattr(ngram_join, "HUBS", 2)
    docs = corpus_pipeline.queries.documents(spark, edges.SF)
    copies = spark.createDataFrame(list(enumerate(template(12, 3) + template(12, 8))), "doc_id long, text string")
    for df, limits in ((docs, {}), (copies, {"most_rounds": 2, "pair_budget": 0})):
        plan("near", ngram_join.one_of_each(df, corpus_pipeline.NEAR, **limits))
    plan("passages", corpus_pipeline.repeated_passages(spark, docs, edges.SF))
    plan("packed", packing.pack_documents(docs, queries.VOCABULARY, queries.END_ID, 1024, group_items=50))
    assert {"links-light", "heavy", "left1", "pairs1", "links1", "last-1", "spans", "near", "passages", "packed"} <= {name for name, _ in plans}
    assert sum(p.count("SortMergeJoin") for _, p in plans) > 20
    assert [(name, n) for name, p in plans if (n := p.count("HashJoin"))] == [("spans", 2)]
