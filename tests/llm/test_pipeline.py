"""The pipeline, stage by stage, against brute force over what each stage read."""

from __future__ import annotations

from collections import Counter

from corpus_pipeline import STAGES, run
from strandwise.llm import mixing, toxicity
from strandwise.llm.work import materialize

from .test_operators import DOCS, ODD, SMALL, slow_components, slow_hits, table


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    seen = {}
    for name, stage in STAGES:
        before = docs.collect()
        docs = materialize(stage(spark, docs, SMALL), name)
        seen[name] = (before, docs.collect(), docs)
        if name != "sharding":
            assert docs.columns == columns
    before, after, _ = seen["toxicity"]
    model = toxicity.train(spark.createDataFrame(before), labels)
    assert Counter(r.doc_id for r in after) == Counter(r.doc_id for r in before if model.score(r.text) < 0.5)
    before, after, _ = seen["simhash_near_dedup"]
    assert sorted(r.doc_id for r in after) == sorted({c for _, _, c in slow_components([(r.doc_id, r.text) for r in before])})
    before, after, _ = seen["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in table("benchmark").itertuples()]
    assert Counter(after) == Counter(r for r in before if not slow_hits(r.text, items)[-1])
    before, after, _ = seen["mixing"]
    copies = {r.doc_id: r.copies for r in mixing.mix(spark.createDataFrame(before)).collect()}
    assert Counter(after) == Counter({r: copies[r.doc_id] for r in before if copies[r.doc_id]})
    before, after, _ = seen["sharding"]
    assert Counter(tuple(r)[: len(columns)] for r in after) == Counter(map(tuple, before))
    order = [r.doc_id for r in mixing.mixed(spark.createDataFrame(seen["mixing"][0], seen["mixing"][2].schema)).collect()]
    shard = {r.doc_id: r.shard for r in after}
    for s in set(shard.values()):
        mine = sorted((r.slot, r.doc_id) for r in after if r.shard == s)
        assert [n for n, _ in mine] == list(range(len(mine))) and [d for _, d in mine] == [d for d in order if shard[d] == s]
    assert Counter(r.doc_id for r in run(spark, SMALL).collect()) == Counter(r.doc_id for r in after)


def test_stages_take_odd_rows(spark):
    for df in (spark.createDataFrame(ODD, DOCS), spark.createDataFrame([], DOCS)):
        for name, stage in STAGES:
            df = materialize(stage(spark, df, SMALL), name)
        assert df.count() <= 3 * len(ODD)
