"""Each stage of the pipeline against plain versions, and the registered queries against SQL."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import llm_cases as cases  # noqa: E402

import corpus_pipeline  # noqa: E402
from grainmill.llm import queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    rows = [(i, t) for i, t in cases.texts() if i is not None]
    rows = list(dict(rows).items())
    passage = " ".join(rows[7][1].split()[:20])
    folder = str(tmp_path)
    cases.frame(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, "of no text at all here or there")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "benchmark_passages", "encoding"]
    step = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        step.append(docs)
    kept = [(i, t) for i, t in rows if cases.quality(t)[-1]]
    assert {r.doc_id for r in step[0].collect()} == {i for i, _ in kept}
    root = cases.components([cases.fingerprint(t) for _, t in kept])
    least: dict[int, int] = {}
    for (i, _), r in zip(kept, root, strict=True):
        least[r] = min(i, least.get(r, i))
    kept = [(i, t) for i, t in kept if i in least.values()]
    assert {r.doc_id for r in step[1].collect()} == {i for i, _ in kept}
    want = {r[0]: r[3] for r in cases.substrings(kept)}
    texts = {r.doc_id: r.text for r in step[2].collect()}
    assert {i: cases.sha(" ".join(cases.SPACE.findall(t)).encode()) for i, t in texts.items()} == want
    bad = {r[0] for r in cases.decontaminated(list(texts.items()), [(1, passage), (2, "of no text at all here or there")]) if r[-1]}
    assert {r.doc_id for r in step[3].collect()} == set(texts) - bad
    assert {r.doc_id: (r.decoded_sha256, r.round_trip) for r in step[4].collect()} == {i: (cases.sha(t.encode()), True) for i, t in texts.items() if i not in bad}
    assert corpus_pipeline.run(spark, folder).count() == step[4].count()


def test_awkward_rows_go_through_all_stages(spark, tmp_path):
    rows = [*cases.texts(), (None, None), (None, ""), (6, cases.texts()[5][1]), (900, "x " * 3), (None, cases.texts()[5][1])]
    folder = str(tmp_path)
    docs = cases.frame(spark, rows)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    good = {(t or "") for _, t in rows if cases.quality(t)[-1]}
    assert got and all(r.round_trip for r in got) and len(got) <= len(good)
    for _, stage in corpus_pipeline.STAGES[1:4]:  # each by itself, nulls and empty texts included
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.count() > 0
    assert corpus_pipeline.benchmark_passages(spark, docs, folder).count() == len(rows)
    once = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, folder).collect()]
    assert len(once) == len(set(once)) and sum(not (t or "").strip() for _, t in once) == 1


def test_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    cases.empty(spark).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    plain = lambda df: sorted(tuple(str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    got, want = queries.queries()[name](spark, FOLDER).toPandas(), con.sql(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)
