import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
from fixtures import DOC, contamination, edge_docs, near_components, sentence, words10  # noqa: E402

import corpus_pipeline  # noqa: E402
from triagekit.llm import quality_rules  # noqa: E402
from triagekit.llm.common import scratch_tables  # noqa: E402


def _tables(spark, docs, items) -> str:
    base = tempfile.mkdtemp(prefix="triagekit-pipe-")
    docs.write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def _corpus():
    import random
    rng = random.Random(11)
    rows = [(i, sentence(rng, rng.randrange(40, 120), 3000, "wo"), "en", f"s{i % 3}", 0) for i in range(300)]
    item = sentence(rng, 25, 3000, "it")
    rows[5] = (5, rows[5][1] + " " + item + " " + rows[6][1], "en", "s0", 0)
    rows += [(400, rows[8][1], "en", "s1", 0), (401, rows[9][1] + " end", "en", "s1", 0), (402, "too short", "en", "s1", 0),
             (403, None, None, None, None), (404, " ".join(["again and"] * 60), "en", "s2", 0)]
    return rows, [(1, item), (2, None), (3, "")]


def test_stages_against_brute_force(spark):
    rows, items = _corpus()
    docs = spark.createDataFrame(rows, DOC)
    base = _tables(spark, docs, items)
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality_rules", "near_dedup", "decontamination", "mixing", "sharding"]
    one = stage["quality_rules"](spark, docs, base)
    kept = {r.doc_id for r in quality_rules.quality_digest(docs).collect() if r.kept}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == kept
    assert not kept & {402, 403, 404} and len(kept & set(range(300))) >= 298
    two = stage["near_dedup"](spark, one, base)
    root = near_components([(r[0], r[1]) for r in rows if r[0] in kept])
    assert sorted(r.doc_id for r in two.collect()) == sorted(i for i in kept if root[i] == i)
    three = stage["decontamination"](spark, two, base)
    texts = {r.doc_id: r for r in three.collect()}
    assert set(texts) == {r.doc_id for r in two.collect()} and three.columns == docs.columns
    assert not any(x[1] for x in contamination([(i, r.text) for i, r in texts.items()], items))
    assert words10(texts[5].text) == words10(rows[5][1].split(" it")[0]) + words10(rows[6][1])
    assert texts[7].text == rows[7][1] and all(r.n_chars == len(r.text) for r in texts.values())
    four = stage["mixing"](spark, three, base)
    assert four.columns == docs.columns and {r.doc_id for r in four.collect()} <= set(texts)
    five = stage["sharding"](spark, four, base)
    n = [r["count"] for r in five.groupBy("shard").count().collect()]
    assert five.count() == four.count() and max(n) - min(n) <= 1


def test_stages_with_edges_and_empty_tables(spark):
    for docs in (edge_docs(spark), spark.createDataFrame([], DOC)):
        base = _tables(spark, docs, [(1, "one two three four")])
        d = docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, base)  # each stage on the awkward rows themselves
            assert name == "sharding" or out.columns == docs.columns
            out.count()
        before = scratch_tables(spark)
        d = corpus_pipeline.run(spark, base)
        assert scratch_tables(spark) == before  # only its own scratch is gone
        d.count()
        assert set(d.columns) >= {*docs.columns, "shard", "slot"}
