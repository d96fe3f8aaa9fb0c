from collections import Counter, defaultdict

import corpus_pipeline
from logloom.llm import mixing, shared
from pyspark.sql import functions as F

from .test_operators import brute_components, rows, simulate, split


def test_pipeline(spark, sf):
    docs, seen = shared.documents(spark, sf), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = shared.materialize(stage(spark, docs, sf), name)
        assert out.columns == docs.columns
        seen.append((name, docs, out))
        docs = out
    (_, a, b), (_, _, c), (_, _, d), (_, _, e) = seen
    assert a.count() == b.count()  # all documents there have a language
    texts = Counter(r.text for r in b.collect())
    assert Counter(r.text for r in c.collect()) == Counter(dict.fromkeys(texts, 1))
    assert d.count() < c.count() and d.join(c, ["doc_id", "text"], "left_anti").count() == 0
    # Near copies against a comparison of all pairs: of each component the least doc_id stays, and all without words do.
    before = rows(c)
    stay = {component for _, _, component in brute_components(before, 5, 80)} | {i for i, t in before if not split(t)}
    assert {i for i, _ in rows(d)} == stay
    # The mix against a schedule made slot by slot: files by number and rows by place are in its order.
    key = [F.xxhash64("doc_id", "text"), F.xxhash64("text", F.lit(1))]
    by_source = defaultdict(list)
    for r in d.select("source", "doc_id", key[0].alias("k"), key[1].alias("t")).collect():
        by_source[r.source].append((r.k, r.t, r.doc_id))
    names = sorted(by_source, key=lambda x: (x is not None, x or ""))
    slots = {(x, i): slot for x, i, slot, *_ in simulate({x: -(-len(by_source[x]) // 8) for x in names}, {x: mixing.TARGETS.get(x, mixing.OTHERS) for x in names})}
    want = [i for _, _, i in sorted((slots[(x, rank // 8)], rank, i) for x in names for rank, (_, _, i) in enumerate(sorted(by_source[x])))]
    placed = e.select("doc_id", F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int").alias("f"), F.col("_metadata.row_index").alias("r"))
    assert [r.doc_id for r in placed.orderBy("f", "r").collect()] == want
    assert Counter(map(tuple, e.collect())) == Counter(map(tuple, d.collect()))
    packed = corpus_pipeline.STAGES[-1][1](spark, e, sf)
    assert packed.select("doc_id").distinct().count() == e.count()
    assert packed.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 1024


def test_pipeline_on_edge_cases(spark, docs, empty):
    for frame in (docs.select("doc_id", "text", "lang", "source", "n_chars"), empty.select("doc_id", "text", "lang", "source", "n_chars")):
        now = frame
        for name, stage in corpus_pipeline.STAGES:
            now = shared.materialize(stage(spark, now, ""), name)
