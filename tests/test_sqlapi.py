from pyspark.sql import functions as F

from loomspark.functions import query as Q
from loomspark.operators.chunking import chunk_markdown
from loomspark.operators.selection import content_count, count_tokens
from loomspark.operators.single import chunk_text
from loomspark.plans.compile import compile_context
from loomspark.plans.sqlapi import register

from .test_engine import MD, POLICY, TEXTS


def test_sql_functions(spark):
    assert len(register(spark)) == 8
    got = spark.sql("SELECT token_count('abcdefgh') a, content_tokens('<!-- x -->abcdefgh') b, tokenize('Red Cats') c, tokenize_query('what is the refund') d, split_aspects('What is x? Who is y?') e, truncate_section(repeat('word ', 400), 100, NULL) f, token_count(NULL) g").first()
    assert (got.a, got.b, got.c, got.d, got.g) == (2, 2, ["red", "cat"], ["refund"], 1) and got.e == ["What is x?", "Who is y?"] and got.f.endswith("<!-- truncated to budget -->")


def test_native_functions_equal_python(spark):
    register(spark)
    spark.createDataFrame([(t,) for t in TEXTS], "t string").createOrReplaceTempView("texts")
    df = spark.sql("SELECT t, token_count(t) n, content_tokens(t) c, tokenize(t) x FROM texts")
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    for r in df.collect():
        assert r.n == count_tokens(r.t) and r.c == content_count(r.t) and r.x == Q.tokens(r.t)


def test_table_functions(spark):
    register(spark)
    docs = spark.createDataFrame([("m", "m", MD), ("p", "document", POLICY), ("e", "e", ""), ("big", "big", "# A\n" + "\n\n".join("word " * 150 for _ in range(9)) + "\n| a | b |\n| 1 | 2 |")], "file_id string, name string, markdown string")
    docs.createOrReplaceTempView("docs")
    got = spark.sql("SELECT file_id, c.* FROM docs, LATERAL chunk_markdown(markdown) c").orderBy("file_id", "ord").collect()
    want = chunk_markdown(docs).select("file_id", "id", "ord", "breadcrumb", "text", "tokens").orderBy("file_id", "ord").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want] and len(chunk_text("")) == 0
    asks = ["What is the termination notice?", "When are invoices due? How does termination work?", "what is this"]
    tasks = spark.createDataFrame([(str(i), "p", a, 300) for i, a in enumerate(asks)], "task_id string, file_id string, task string, token_budget int")
    tasks.createOrReplaceTempView("asked")
    one = spark.sql("SELECT task_id, c.* FROM asked JOIN docs USING (file_id), LATERAL compile_context(markdown, task, token_budget) c").collect()
    batch = {r.task_id: r for r in compile_context(docs, tasks).collect()}
    for r in one:
        assert r.selected == [s.id for s in batch[r.task_id].selected_sections] and r.omitted == [s.id for s in batch[r.task_id].omitted_sections] and r.stopped_early == batch[r.task_id].stopped_early
        assert r.markdown == batch[r.task_id].markdown
    assert docs.filter(F.col("file_id") == "p").count() == 1
