"""The pipeline against its brute-force parts on a small fixture."""

import corpus_pipeline as C
from logweave.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages_keep_clean_documents_and_columns(spark):
    docs = table(spark, SF, "documents")
    names, seen = docs.columns, []
    for k, (name, stage) in enumerate(C.STAGES):
        before = docs
        docs = written(stage(spark, docs, SF), f"t{k}")
        if k < len(C.STAGES) - 1:
            assert docs.columns == names
        seen.append((name, before, docs))
    rows = [{r["doc_id"]: r["text"] for r in d.collect()} for _, _, d in seen[:4]]
    # near duplicates and contamination against brute force on the stage's own input
    from tests.llm.test_edges import brute_components, brute_hits

    near = brute_components(sorted(rows[0].items()), 5, 80)
    assert set(rows[1]) == {i for i, (_, c) in near.items() if c == i}
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    hits = brute_hits(rows[1].items(), items, 10)
    assert set(rows[2]) == {i for i, h in hits.items() if not h[1]}
    assert set(rows[3]) <= set(rows[2])
    assert seen[4][2].count() == seen[3][2].count()


def test_stages_take_odd_rows(spark, make_docs):
    docs = make_docs([(1, None), (2, ""), (None, "the house and the tree"), (3, "the house and the tree"), (3, "the house and the tree"), (4, "..."), (5, "the " * 50_000)], clash=["component_id", "score", "copies"])
    for k, (_, stage) in enumerate(C.STAGES):
        docs = written(stage(spark, docs, SF), f"o{k}")
    assert docs.count() >= 1
    empty = make_docs([])
    for k, (_, stage) in enumerate(C.STAGES):
        empty = written(stage(spark, empty, SF), f"e{k}")
    assert empty.count() == 0
