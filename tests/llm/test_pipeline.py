from collections import Counter

import corpus_pipeline
from pointlake.llm.queries import ORACLE_SQL, QUERIES

from .helpers import words

SF = "/root/testdata/sf0.001"


def test_stages_on_the_smallest_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        counts.append(docs.count())
        if name == "near_duplicates":
            assert docs.count() == docs.select("doc_id").distinct().count()
        if name == "repeated_passages":
            last = docs
    assert counts[0] >= counts[1] == counts[2] > 0
    # No passage of 50 words is in two documents.
    seen = Counter()
    for r in last.collect():
        w = words(r.text)
        seen.update({tuple(w[i : i + 50]) for i in range(len(w) - 49)})
    assert not seen or max(seen.values()) == 1
    assert docs.count() > 0


def test_kept_documents_are_the_good_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, SF).select("doc_id").collect()}
    right = [(i in kept) == bool(q) for i, q in labels.items()]
    assert sum(right) / len(right) > 0.9


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in QUERIES} == {"pipeline", *[f"op{k}" for k in range(1, 11)]}
    assert set(ORACLE_SQL) <= set(QUERIES)


def _python_steps(node, above=0):
    """The most Python steps that one task of a plan runs at a time: those between exchanges."""
    name, children = node.nodeName(), node.children()
    if name == "AdaptiveSparkPlan":
        return _python_steps(node.initialPlan(), above)
    now = 0 if "Exchange" in name else above + (name in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "FlatMapGroupsInArrow"))
    return max([now, *(_python_steps(children.apply(k), now) for k in range(children.size()))])


def test_no_task_needs_two_python_workers(spark, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frame, written = type(docs), []
    write = frame.write
    monkeypatch.setattr(frame, "write", property(lambda self: written.append(self) or write.fget(self)))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    steps = [_python_steps(df._jdf.queryExecution().executedPlan()) for df in written]
    assert len(steps) > len(corpus_pipeline.STAGES) and max(steps) == 1
