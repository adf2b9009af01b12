import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import awkward, shingles, words
from vedette.llm.common import table
from vedette.llm.secrets import base_spans
from vedette.llm.tokenise import Encoder

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    docs, sizes = table(spark, SF, "documents").persist(), {}
    whole = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "packing":
            assert out.columns == docs.columns
            out = out.persist()
            sizes[name] = {r.doc_id: r.text for r in out.collect()}
        docs = out
    quality = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    kept = sizes["quality"]
    assert sum((i in kept) == (q == 1) for i, q in quality.items()) >= 0.95 * len(quality)
    left = sizes["near_duplicates"]
    sets = {i: shingles(t, 5) for i, t in left.items()}
    ids = sorted(sets)
    assert not any(100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) for a in ids for b in ids if a < b and sets[a] and sets[b])
    for i in set(kept) - set(left):  # a smaller one that reaches it is kept or went the same way
        s = shingles(kept[i], 5)
        assert any(j != i and 100 * len(s & shingles(kept[j], 5)) >= 80 * len(s | shingles(kept[j], 5)) for j in kept)
    clean = sizes["decontamination"]
    items = [shingles(r.text, 5) for r in table(spark, SF, "benchmark").collect()]
    for i in left:
        have = shingles(left[i], 5)
        share = max(len(s & have) / len(s) for s in items if s)
        assert (i in clean) == (share < 0.8)
    assert set(sizes["secrets"]) == set(clean)
    for i, t in sizes["secrets"].items():
        assert not base_spans(t) and (t == whole[i] or base_spans(whole[i]) or len(words(t)))
    assert {r.doc_id for r in docs.collect()} == set(clean)


def test_stages_of_an_awkward_table(spark):
    """Nulls, ties, repeated rows and columns named as the stages name theirs; then a table without rows."""
    clashing = ["quality_score", "quality_predicted", "_bit", "_b", "_w", "_gone", "bit", "row", "filter", "id", "k1", "node", "kept", "component", "c d"]
    item = table(spark, SF, "benchmark").orderBy("item_id").first().text
    docs = awkward(spark, [(30, item), (31, "so " + item)]).select("*", *(F.lit(n).alias(c) for n, c in enumerate(clashing)))
    for df in (docs.repartition(3), docs.where("false")):
        n = df.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF).persist()
            assert out.schema.names == docs.schema.names and out.count() <= n, name
            if name == "near_duplicates" and n:
                ids = [r.doc_id for r in out.collect()]
                assert len(set(ids) - {None}) == len([i for i in ids if i is not None])
            if name == "quality" and n:
                out = df  # all documents go on to the other stages
            if name == "decontamination" and n:
                assert not {30, 31} & {r.doc_id for r in out.collect()}
            df = out
        assert corpus_pipeline.STAGES[-1][1](spark, df, SF).count() >= bool(n)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_packed_sequences_hold_the_tokens(spark):
    docs = awkward(spark)
    pieces = sorted(corpus_pipeline.pack_sequences(spark, docs, SF).collect(), key=lambda p: (p.sequence_id, p.offset))
    stream = [t for p in pieces for t in np.frombuffer(p.ids, "<u4").tolist()]
    assert len(stream) == sum(p.length for p in pieces)
    want = Encoder().encode([r.text or "" for r in docs.collect()])
    assert sorted(t for x in want for t in [*x, 0]) == sorted(stream)
