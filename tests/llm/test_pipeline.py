"""The pipeline against brute force, stage by stage, each on the stage's own input."""

import zlib
from collections import Counter

from corpus_pipeline import STAGES, run
from tickloom.llm import curriculum, quality

from .conftest import shingles, words
from .test_documents import components


def test_stages(spark, sf_dir, table):
    docs, columns = table("documents"), table("documents").columns
    seen = []
    for name, stage in STAGES:
        before = docs.collect()
        docs = stage(spark, docs, sf_dir)
        after = docs.collect()
        seen.append(name)
        if name != "sharding":
            assert docs.columns == columns
        text = {r.doc_id: r.text for r in before}
        if name == "quality_rules":
            ratio = quality.fit(table("documents"), table("labels"))
            kept = {r.doc_id for r in quality.measure(table("documents"), ratio).collect() if r.kept}
            assert {r.doc_id for r in after} == kept and kept
        elif name == "near_copies":
            root = components({i: shingles(t) for i, t in text.items()})
            assert {r.doc_id for r in after} == set(root.values())
        elif name == "benchmark_leaks":
            items = [set(tuple(w[i:i + 5]) for i in range(len(w) - 4)) for w in
                     (words(r.text, True) for r in table("benchmark").collect())]
            gone = set(text) - {r.doc_id for r in after}
            whole = {i for i, t in text.items() if any(s and s <= shingles(t) for s in items)}
            near = {i for i, t in text.items() if any(s and len(s & shingles(t)) >= 0.75 * len(s) for s in items)}
            assert whole <= gone <= near
        elif name == "target_mix":
            size = {i: len(words(t)) for i, t in text.items()}
            plan = curriculum.plan(spark.createDataFrame(before)).collect()
            want = Counter()
            for r in plan:
                want[r.doc_id] = sum(2 * p.taken >= size[r.doc_id] for p in r.mix.passes)
            assert Counter(r.doc_id for r in after) == +want
        else:
            assert len(after) == len(before)
            count = Counter(r.shard for r in after)
            assert max(count.values()) - min(count.values()) <= 1
            assert {r.text_crc32 for r in after} == {zlib.crc32(t.encode()) for t in text.values()}
    assert seen == ["quality_rules", "near_copies", "benchmark_leaks", "target_mix", "sharding"]


def test_run(spark, sf_dir):
    rows = run(spark, sf_dir).collect()
    assert rows and {r.shard for r in rows} == set(range(24))
