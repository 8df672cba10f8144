"""Queries over all their rows: whole tasks, all sections that were left out, packed texts."""

import duckdb

from loomspark.plans import oracle
from loomspark.plans.queries import QUERIES, benchmark_aspects, document_chunks

from .test_engine import _same


def _duck(data, sql):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "labels"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    return db.execute(sql).df()


def test_tasks_keep_all_words_and_meet_any_source(spark, tmp_path):
    texts = [" ".join(f"w{i}" for i in range(n)) for n in (3, 17, 48, 100)]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0, "w1", "en", "books"), (1, "w2", "en", None)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = benchmark_aspects(spark, str(tmp_path)).orderBy("task_id", "qi").toPandas()
    assert got.groupby("task_id")["query"].agg(" ".join).tolist() == texts and got.groupby("task_id").size().tolist() == [1, 3, 6, 6]
    assert set(got.file_id) == {"books", ""} == {r.file_id for r in document_chunks(spark, str(tmp_path)).collect()}


def test_buckets_of_all_sections(spark):
    """Far more sections are left out than are shown, and some match an aspect without its best section."""
    data = "/root/testdata/sf0.01"
    got, want = QUERIES["omit_buckets"](spark, data).toPandas(), _duck(data, oracle.ORACLE["omit_buckets"])
    left = _duck(data, oracle._PICKED + " SELECT task_id, count(*) AS n, count(ga.id) AS gaps FROM pk LEFT JOIN ga USING (task_id, id) WHERE pos >= 3 GROUP BY task_id")
    assert left.n.max() > 20 and left.gaps.max() > 0 and _same(got) == _same(want)


def test_recall_of_packed_texts(spark, data):
    got = QUERIES["recall_at_budget"](spark, data).toPandas()
    n = duckdb.sql(f"SELECT count(DISTINCT conv_id) AS n FROM read_parquet('{data}/conversations.parquet') WHERE trim(text) <> ''").fetchall()[0][0]
    assert 0 < len(got) <= 3 * n and got.task_id.is_unique and set(got.token_budget) == {40, 250, 1000}
    assert got.found.any() and (got.expand_ok.isna() == got.found).all() and (got.ok == (got.found | (got.expand_ok == True))).all()  # noqa: E712
    assert got[got.token_budget == 1000].found.mean() >= got[got.token_budget == 40].found.mean()


def test_packs_by_question_and_budget(spark, data):
    got = QUERIES["pack_matrix"](spark, data).toPandas()
    n = duckdb.sql(f"SELECT count(DISTINCT conv_id) FROM read_parquet('{data}/conversations.parquet')").fetchall()[0][0]
    assert len(got) == n * 2 * 4 and (got.whole_doc == (got.selected == got.total_sections)).all() and (got.tokens_used <= got.token_budget).all()
    for _, cells in got.groupby(["file_id", "kind"]):
        at = cells.set_index("token_budget")
        base = at.loc[1000]
        assert (at.stable_ids == all(at.ids[b] == base.ids or at.selected[b] <= base.selected + 2 for b in (4000, 8000))).all()
