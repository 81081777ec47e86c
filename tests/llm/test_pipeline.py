import duckdb
import pytest

import corpus_pipeline
from terseflow.llm import langid, line_edit_join, mixing, order_minhash, queries
from tests.llm.test_sentencepiece import MODEL


def test_stages_take_effect(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_dedup", "source_mixing", "tokens"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert after.columns == columns, name
        if name == "near_dedup":
            gone = {r.doc_id for r in order_minhash.duplicates(docs).collect()}
            assert {r.doc_id for r in after.collect()} == {r.doc_id for r in docs.collect()} - gone
        docs = spark.createDataFrame(after.collect(), after.schema)
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(final) == docs.count() and all(r.round_trip for r in final)
    assert all(r.token_ids == MODEL.encode(texts[r.doc_id]) for r in final)


def test_run_equals_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = langid.keep_identified(docs, langid.fit(docs))
    kept = line_edit_join.dedup_lines(kept, drop_emptied=True, numbered=False)
    kept = mixing.mix_sources(order_minhash.drop_near_duplicates(kept), numbered=False)
    expected = sorted((r.doc_id, MODEL.encode(r.text)) for r in kept.collect())
    assert sorted((r.doc_id, r.token_ids) for r in corpus_pipeline.run(spark, sf_dir).collect()) == expected


def test_empty_table_runs_through(spark, tmp_path, sf_dir):
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_handle_odd_rows(spark, sf_dir):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns, stage by stage."""
    known = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang is not null").orderBy("doc_id").limit(120).collect()]
    long_text = " ".join(t for _, t, *_ in known)
    odd = [(None, known[0][1], None, None, None), (1000, None, "en", "s", 0), (1001, "", "en", "s", 0), (1002, long_text, None, "s", None), (1002, long_text, None, "s", None), (1003, known[1][1], "en", None, 1)]
    rows = [(*r, i, i + 1, "x", 0) for i, r in enumerate(known + odd)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` int, n_removed int, copy_no string, c0 int")
    columns = docs.columns
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        kept = docs.collect()
        left.append(kept)
        docs = spark.createDataFrame(kept, docs.schema)
    ids = [{r.doc_id for r in kept} for kept in left]
    assert {1000, 1001} & ids[0] == set() and {None, 1002} <= ids[0] and sum(r.doc_id == 1002 for r in left[0]) == 2
    assert None in ids[1] and 1003 not in ids[1]  # its lines stand earlier
    assert {tuple(r)[5:] for r in left[-1]} <= {r[5:] for r in rows}
    final = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert len(final) == len(left[-1]) and all(r.round_trip for r in final)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    rows = queries.queries()[name](spark, sf_dir)
    order = sorted(rows.columns)
    assert sorted(map(repr, (tuple(r[c] for c in order) for r in rows.collect()))) == sorted(map(repr, con.sql(f"SELECT {', '.join(order)} FROM ({queries.oracle_sql()[name]})").fetchall()))
