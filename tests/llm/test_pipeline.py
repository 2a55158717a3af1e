import corpus_pipeline
from cloudweave.llm import jaccard, queries, substrings
from tests.llm import brute


def test_stages_take_effect(spark, sf_dir, documents):
    """Each stage against its plain version, on what the stage before kept."""
    docs = documents
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "near duplicates", "suffix-array dedup", "secret scans", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = jaccard.common.materialize(stage(spark, docs, sf_dir))
        assert out.columns == documents.columns
        before = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        after = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
        if name == "near duplicates":
            assert set(after) == set(brute.components(before).values())
        elif name == "suffix-array dedup":
            want = brute.repeated_bytes([t for _, t in before], substrings.LENGTH)
            assert len(after) == len(before)
            assert all((after[d] == t) == (w[1] == 0) and len(after[d].encode()) <= w[0] - w[1] for (d, t), w in zip(before, want, strict=True))
        elif name == "secret scans":
            assert len(after) == len(before) and not any('token = "' in t and "[SECRET]" not in t for t in after.values())
        else:
            assert 0.7 * len(before) < len(after) < len(before)
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert packed.select("doc_id").distinct().count() == docs.count()
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


def test_every_operator_has_a_query():
    names = queries.queries()
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
