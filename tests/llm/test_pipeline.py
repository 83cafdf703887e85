"""The pipeline's stages against brute force, each on its own input."""

import corpus_pipeline
from mixlab.llm import decontaminate, simhash, toxicity
from mixlab.llm.common import read, saved

from ..conftest import SF001
from .test_free import brute_lines, closure


def test_stages(spark):
    docs = read(spark, SF001, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = saved(stage(spark, docs, SF001), name)
        seen[name] = (docs, out)
        docs = out
    assert [n for n, _ in corpus_pipeline.STAGES] == list(seen) and len(seen) == 5
    for name in list(seen)[:-1]:
        assert seen[name][1].columns == columns

    before, after = seen["toxicity"]
    model = toxicity.train(before, read(spark, SF001, "labels"))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if model.scorer().score(r.text) < 0.3}

    before, after = seen["line_dedup"]
    marks = brute_lines([(r.doc_id, r.text) for r in before.collect()])
    expected = {}
    for r in before.collect():
        stay = [line for k, line in enumerate(r.text.split("\n")) if not marks.get((r.doc_id, k), (0, 0, 0, False))[3]]
        if "\n".join(stay).split() or not r.text.split():
            expected[r.doc_id] = "\n".join(stay)
    assert {r.doc_id: r.text for r in after.collect()} == expected

    before, after = seen["simhash_near_dedup"]
    fps = {r.doc_id: simhash.fingerprint(r.text) for r in before.collect()}
    root = closure(fps, lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    assert {r.doc_id for r in after.collect()} == set(root.values())

    before, after = seen["benchmark_decontamination"]
    found = {r.doc_id for r in decontaminate.contaminated(before, read(spark, SF001, "benchmark")).collect()}
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()} - found

    before, after = seen["best_fit_packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    run = corpus_pipeline.run(spark, SF001)
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(run) == key(after)
