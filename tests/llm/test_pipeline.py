import importlib

import corpus_pipeline
from refrain.llm import near_dedup, packing, pii, quality_classifier, quality_rules
from refrain.llm.common import read


def test_stages_in_order_and_by_their_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_dedup", "pii", "packing"]


def test_run_equals_a_plain_version(spark):
    """Each stage's decisions, taken from its operator on what the last one kept, and joined here in plain Python."""
    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    p = quality_classifier.ClassifierParams()
    model = quality_classifier.train(docs, read(spark, sf, "labels").withColumnRenamed("quality", "label"), p)
    kept = {r.doc_id for r in quality_classifier.scores(docs, model).collect() if r.score >= p.threshold}
    rows = [r for r in docs.collect() if r.doc_id in kept]
    from .test_quality_rules import brute

    def passes(text):
        n, _, _, _, repeat = brute(text)
        (found,) = quality_rules.measure(iter([text.encode()]), quality_rules.Limits().min_repeat)
        lim = quality_rules.Limits()
        long = found[6] > min(200, max(60, n // 10))
        return n >= 50 and 100 * repeat <= 50 * n and not long and 100 * found[5] <= lim.max_covered_percent * n

    rows = [r for r in rows if passes(r.text)]
    from .test_near_dedup import brute as groups

    component, _ = groups([(r.doc_id, r.text) for r in rows], 5)
    rows = [r for r in rows if component[r.doc_id] == r.doc_id]
    from .test_pii import brute as base

    clean = {}
    for r in rows:
        text, at, out = r.text, 0, []
        for start, k, end in base(text):
            if start >= at:
                out += [text[at:start], f"[{pii.KINDS[k].upper()}]"]
            at = max(at, end)
        clean[r.doc_id] = "".join(out) + text[at:]
    want = packing.packed(spark.createDataFrame(list(clean.items()), "doc_id bigint, text string"), packing.vocabulary())
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(key, got)) == sorted(map(key, want.collect()))
    assert len({r.sequence_id for r in got}) <= len({r.sequence_id for r in want.collect()}) + 1


def test_all_but_the_last_stage_keep_the_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = read(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


def test_entry_lists_the_queries():
    entry = importlib.import_module("__spark_entry__")
    found = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {k.split("_")[0] + "_" for k in found if k.startswith("op")} and "pipeline" in found
    assert near_dedup.NearParams().width == 5 and set(entry.oracle_sql()) <= set(found)
