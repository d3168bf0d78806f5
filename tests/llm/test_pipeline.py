import numpy as np
import pytest

import corpus_pipeline
from rankatlas.llm import line_rules, near_lines
from rankatlas.llm.frames import table, written

from . import brute

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, FOLDER), "test")
        assert docs.columns == columns, name
        now = [r.doc_id for r in docs.select("doc_id").collect()]
        assert now and len(now) == len(set(now)) and set(now) <= ids, name
        ids = set(now)
    texts = [r.text for r in docs.collect()]
    windows = [tuple(w[i : i + 20]) for w in map(str.split, texts) for i in range(len(w) - 19)]
    # what follows a cut is joined anew, so a few windows may repeat; nearly none do
    assert len(set(windows)) > 0.99 * len(windows)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).collect()
    assert {p.doc_id for p in pieces} == ids and all(np.log2(p.length) % 1 == 0 for p in pieces)


def test_run(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0 and corpus_pipeline.ORACLE_SQL is None


def test_stages_are_those_of_brute_force(spark):
    stages = [f for _, f in corpus_pipeline.STAGES]
    docs = written(table(spark, FOLDER, "documents").filter("n_chars < 8000"), "test")
    rows = lambda d: {r.doc_id: r.text for r in d.collect()}
    before, docs = rows(docs), written(stages[0](spark, docs, FOLDER), "test")
    judged = {i: line_rules.measure(t or "", 0.5) for i, t in before.items()}
    assert rows(docs) == {i: x[-1] for i, x in judged.items() if x[6]}

    before, docs = rows(docs), written(stages[1](spark, docs, FOLDER), "test")
    after = rows(docs)
    plain = brute.lines(list(before.items()), 8, near_lines.within_one_word)
    assert {i: brute.sha(t.encode()) for i, t in after.items()} == {i: kept for i, _, gone, _, kept in plain if i in after}
    assert all(gone for i, _, gone, _, _ in plain if i not in after)

    before, docs = after, written(stages[2](spark, docs, FOLDER), "test")
    ids = sorted(before)
    root = {i: i for i in ids}
    for a, b in brute.similar_pairs([before[i] for i in ids], 5, 0.8) + [(x, y) for y in range(len(ids)) for x in range(y) if before[ids[x]] == before[ids[y]]]:
        low, high = sorted((root[ids[a]], root[ids[b]]))
        root = {k: low if r == high else r for k, r in root.items()}
    assert set(rows(docs)) == set(root.values())

    before, docs = rows(docs), stages[3](spark, docs, FOLDER)
    after = rows(docs)
    for i, n, gone, kept in brute.passages(list(before.items()), 20):
        assert (i in after) == (not gone or gone < n) and (i not in after or brute.sha(b" ".join(after[i].encode().split())) == kept)


@pytest.mark.parametrize("rows", [[], [(1, None, "x", 1), (None, "", None, 2), (1, None, "x", 1)]])
def test_run_of_little(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, carried string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
