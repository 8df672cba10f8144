"""Columns, plans, sources and state on Spark against plain versions; every SQL twin on the smallest tables."""

import io
import random
import zipfile
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomspark.functions import query as Q
from loomspark.functions import text as X
from loomspark.functions import tokens as K
from loomspark.operators.chunking import chunk_markdown, lines, sections
from loomspark.operators.selection import content_count, count_tokens
from loomspark.plans.compile import compile_context, expand_sections
from loomspark.plans.oracle import ORACLE
from loomspark.plans.queries import QUERIES
from loomspark.sources import files as S
from loomspark.streaming import state as T

TEXTS = ["", "a", "Returned goods, refunds; RUNNING glass.", "保修条款 and abc漢字", "الخبّاز كتاب", "हिन्दी भाषा", "été <!-- x --> \n\n\n\n fin", "a😀b" * 30, "  nbsp "]


def test_columns_equal_python(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", K.token_count(F.col("t")).alias("n"), K.content_tokens(F.col("t")).alias("c"), X.tokenize(F.col("t")).alias("x")).collect()
    for r in rows:
        assert r.n == count_tokens(r.t) and r.c == content_count(r.t) and r.x == Q.tokens(r.t)


def test_clamp(spark):
    got = spark.createDataFrame([("x",), ("NaN",), (None,), ("12.9",), ("-5",), ("1e9",)], "v string").select(K.clamp_budget(F.col("v"), "web").alias("b")).collect()
    assert [r.b for r in got] == [4000, 4000, 4000, 100, 100, 200000]


MD = "intro\n\n# A\ntext a\n## B\n\n| x | y |\n| - | - |\n| 1 | 2 |\n\n### C ###\nc\n# D\n## \n#nohead\r\nlast\n"


def plain_chunks(md, most=800):
    import re

    out, trail, head, body = [], [], None, []

    def blocks(ls):
        found, cur, was = [], [], None
        for x in ls:
            s = x.strip()
            table = s.startswith("|") and s.endswith("|") and len(s) > 1
            if not s or (cur and table != was):
                found += [cur] if cur else []
                cur = [x] if s else []
            else:
                cur.append(x)
            was = table if s else None
        return found + ([cur] if cur else [])

    def flush():
        full = ((head + "\n" if head else "") + "\n".join(body).strip()).strip()
        if not full:
            return
        crumb = " > ".join(t for _, t in trail) if trail else "(no heading)"
        if count_tokens(full) <= most:
            out.append((crumb, full))
            return
        buf, n = [], 0
        for b in map("\n".join, blocks(([head] if head else []) + body)):
            if buf and n + count_tokens(b) > most:
                out.append((crumb, "\n\n".join(buf).strip()))
                buf, n = [], 0
            buf.append(b)
            n += count_tokens(b)
        if buf:
            out.append((crumb, "\n\n".join(buf).strip()))

    for x in re.split(r"\r?\n", md):
        m = re.match(r"^(#{1,6})\s+(.*)$", x)
        if m:
            flush()
            while trail and trail[-1][0] >= len(m[1]):
                trail.pop()
            trail.append((len(m[1]), m[2].strip()))
            head, body = x, []
        else:
            body.append(x)
    flush()
    return out


def test_headings_over_stretches_of_lines(spark):
    """A file that is scanned in stretches has the sections it has in one."""
    r = random.Random(8)
    docs = [(f"f{i}", "\n".join(r.choice(("text", "", "# A", "## B", "### C", "## D", "###### E", "more")) if i % 3 or r.random() < 0.1 else "plain" for _ in range(r.randint(0, 90)))) for i in range(30)]
    found = lines(spark.createDataFrame(docs, "file_id string, markdown string"))
    whole = sorted(map(tuple, sections(found).collect()))
    for stretch in (1, 4, 25):
        assert sorted(map(tuple, sections(found, stretch).collect())) == whole


def test_chunks(spark):
    long = "# Long\n" + "\n\n".join(f"paragraph {i} " + "word " * 120 for i in range(12)) + "\n\n| a | b |\n| 1 | 2 |\n\ntail"
    import random

    r = random.Random(5)
    random_docs = ["\n".join(r.choice(["# a", "## b", "### c", "#### d", "text", "", "| x |", "plain line"]) for _ in range(40)) for _ in range(12)]
    docs = [MD, long, "", "\n\n", "no heading at all", *random_docs]
    got = chunk_markdown(spark.createDataFrame([(str(i), d) for i, d in enumerate(docs)], "file_id string, markdown string")).orderBy("file_id", "ord").collect()
    for i, d in enumerate(docs):
        mine = [r for r in got if r.file_id == str(i)]
        assert [(r.breadcrumb, r.text) for r in mine] == plain_chunks(d), d
        assert [r.id for r in mine] == [f"s{k}" for k in range(len(mine))] and all(r.tokens == count_tokens(r.text) for r in mine)


POLICY = "# Policy\n\n## Termination\nEither side may end the contract with ninety days notice.\n\n## Payment\nInvoices are due in thirty days.\n\n" + "".join(f"## Note {i}\nRoutine remarks on meetings and minutes, nothing else of interest was said here.\n\n" for i in range(20))


@pytest.fixture(scope="module")
def compiled(spark):
    docs = spark.createDataFrame([("f", "../x/policy.md", POLICY), ("e", "empty.md", "")], "file_id string, name string, markdown string")
    tasks = spark.createDataFrame([("t1", "f", "What is the termination notice?", 300), ("t2", "f", "When are invoices due? How does termination work?", 200), ("t3", "f", "what is this", 300), ("t4", "e", "x", 100)], "task_id string, file_id string, task string, token_budget int")
    return {r.task_id: r for r in compile_context(docs, tasks).collect()}


def test_compile(compiled):
    one, two, vague = compiled["t1"], compiled["t2"], compiled["t3"]
    assert "ninety days" in one.markdown and "thirty days" not in one.markdown.split("---")[0] and one.tokens_used <= 300
    assert "ninety days" in two.markdown and "thirty days" in two.markdown and two.tokens_used <= 200 and len(two.queries) == 2
    assert len(vague.selected_sections) <= 2 and "t4" not in compiled
    assert one.markdown.startswith("<!-- Compiled context from: policy.md -->") and one.reduction_pct > 50
    assert {s.id for s in one.selected_sections} | {s.id for s in one.omitted_sections} == {f"s{i}" for i in range(23)}


def test_expand(spark):
    chunks = chunk_markdown(spark.createDataFrame([("f", POLICY + "## Big\n" + "filler line\n" * 20 + "the needle\n" + "filler line\n" * 200)], "file_id string, markdown string"))
    wanted = spark.createDataFrame([("f", "s1", 500, None), ("f", "s99", 500, None), ("f", "s23", 100, "needle"), ("f", "s23", 20, None)], "file_id string, section_id string, token_budget int, task string")
    got = {(r.section_id, r.token_budget): r for r in expand_sections(chunks, wanted).collect()}
    assert "ninety" in got["s1", 500].markdown and got["s1", 500].error is None
    assert got["s99", 500].error == "No section with id 's99'" and len(got["s99", 500].outline) == 24
    assert "the needle" in got["s23", 100].markdown and got["s23", 100].truncated and not got["s23", 100].query_miss
    assert "needs at least 20" in got["s23", 20].error


def _zip(sizes):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for i, n in enumerate(sizes):
            z.writestr(f"{i}.xml", b"0" * n)
    return buf.getvalue()


def test_guard_as_columns(spark):
    """Uploads in a table are judged as one by one."""
    def zipped(n):
        with zipfile.ZipFile(out := io.BytesIO(), "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("a", b"x" * n)
        return out.getvalue()

    contents = [None, b"", b"text", b"a\x00b", b"x" * 9000 + b"\x00", b"%PDF-1.4", b"PK\x03\x04", b"PK", b"PK\x09\x09", zipped(10), zipped(5_000_000), zipped(100)[:-4]]
    names = [None, "", "a", "a.md", "b.TXT", ".csv", "x.y.docx", "p.pptx", "s.XLSX", "d.pdf", "e.exe", "h.html", "dot."]
    rows = [(n, c) for n in names for c in contents]
    got = spark.createDataFrame(rows, "name string, content binary").select("name", "content", S.guard(F.col("name"), F.col("content")).alias("g")).collect()
    assert [(r.g.ok, r.g.status, r.g.reason) for r in got] == [S.check_upload(r.name, bytes(r.content) if r.content is not None else None) for r in got]
    assert {r.g.status for r in got} == {200, 400, 413, 415}


def test_guards():
    assert S.check_upload("a.md", b"# x")[0] and S.check_upload("a.docx", _zip([1000]))[0]
    assert S.check_upload("a.exe", b"x")[1] == 415 and S.check_upload("a.md", b"")[1] == 400 and S.check_upload("a.txt", b"a\x00b")[1] == 415
    assert S.check_upload("a.docx", b"plain")[1] == 415 and S.check_upload("a.pdf", b"plain")[1] == 415 and S.check_upload("a.docx", _zip([30_000_000]))[1] == 413
    assert S.unzipped_size(b"PK\x03\x04") is None


def test_convert_and_cache(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, raw in {"a.md": b"# T\nx", "b.csv": b"n,r\nAda,dev\n", "c.html": b"<h1>T</h1><p>x <b>y</b><script>no()</script><table><tr><th>a</th></tr><tr><td>1</td></tr></table>", "d.pdf": b"junk", "e.txt": b"  "}.items():
        (tmp_path / "in" / name).write_bytes(raw)
    files = S.read_files(spark, str(tmp_path / "in"))
    got = {r.name: r for r in S.convert(files).collect()}
    assert got["a.md"].markdown == "# T\nx" and got["b.csv"].markdown == "| n | r |\n| --- | --- |\n| Ada | dev |"
    assert got["c.html"].markdown == "# T\n\nx **y**\n\n| a |\n| --- |\n| 1 |" and got["d.pdf"].error and got["e.txt"].error
    cache = str(tmp_path / "cache")
    S.cache_put(cache, S.convert(files))
    hits, todo = S.cache_lookup(files, spark.read.parquet(cache))
    assert S.full_markdown(S.convert(files)).count() == 3
    assert hits.count() == 3 and {r.name for r in todo.collect()} == {"d.pdf", "e.txt"}
    bad = spark.read.parquet(cache).withColumn("markdown", F.lit("changed"))
    assert S.cache_valid(bad).count() == 0 and S.cache_swept(spark.read.parquet(cache), F.current_timestamp() + F.expr("INTERVAL 31 DAYS")).count() == 0
    S.cache_put(cache, S.convert(files))
    S.cache_sweep(spark, cache)
    assert spark.read.parquet(cache).count() == 3 and not [p for p in tmp_path.iterdir() if "-new-" in p.name or "-old-" in p.name]
    with pytest.raises(PermissionError):
        S.inside(str(tmp_path / "cache"), str(tmp_path / "in" / "a.md"))


def test_large_files_are_listed_without_their_bytes(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# x")
    (tmp_path / "b.md").write_bytes(b"x" * 100)
    got = {r.name: r for r in S.read_files(spark, str(tmp_path), most_bytes=50).collect()}
    assert got["a.md"].content is not None and got["b.md"].content is None and got["b.md"].size == 100


def test_office_files_and_endless_conversions(spark):
    import time

    def packed(parts):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            for name, text in parts.items():
                z.writestr(name, text)
        return buf.getvalue()

    w = 'xmlns:w="w"'
    docx = packed({"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Some </w:t></w:r><w:r><w:t>text</w:t></w:r></w:p>'
                   '<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})  # fmt: skip
    pptx = packed({f"ppt/slides/slide{i}.xml": f'<p:s xmlns:p="p" xmlns:a="a"><a:p><a:r><a:t>point {i}</a:t></a:r></a:p></p:s>' for i in (10, 2)})
    xlsx = packed({"xl/workbook.xml": '<workbook><sheets><sheet name="One"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>k</t></si><si><t>v|w</t></si></sst>",
                   "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>3.5</v></c></row></sheetData></worksheet>'})
    bomb = packed({"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'})
    rows = [("a.docx", docx), ("b.pptx", pptx), ("c.xlsx", xlsx), ("d.docx", bomb), ("e.slow.txt", b"x"), ("f.md", None)]
    files = spark.createDataFrame([(n, None if b is None else len(b), b) for n, b in rows], "name string, size long, content binary").withColumn("size", F.when(F.col("name") == "f.md", 10**9).otherwise(F.col("size")))
    got = {r.name: r for r in S.convert(files, {".txt": lambda raw: time.sleep(30) or "x"}, seconds=0.3).collect()}
    assert got["a.docx"].markdown == "## Head\n\nSome text\n\n| a | b |\n| --- | --- |" and got["b.pptx"].markdown == "## Slide 1\n\npoint 2\n\n## Slide 2\n\npoint 10"
    assert got["c.xlsx"].markdown == "## One\n\n| k |  | v\\|w |\n| --- | --- | --- |\n| 3.5 |  |  |"
    assert "ValueError" in got["d.docx"].error and "TimeoutError" in got["e.slow.txt"].error and "20 MB" in got["f.md"].error


def test_a_probe_asks_once_in_a_while():
    asked, now = [], [0.0]
    probe = S.Probe(lambda: asked.append(1) or (1 / 0 if len(asked) > 1 else 1), clock=lambda: now[0])
    assert probe() and probe() and len(asked) == 1
    now[0] = 31
    assert not probe() and len(asked) == 2


def _requests():
    start = datetime(2024, 1, 1)
    return [("k", start + timedelta(seconds=20 * i), "/api/agent" if i % 3 == 0 else "/api/compile") for i in range(60)] + [("other", start, "/api/answer")]


def _plain_limit(rows, points=40, window=300):
    kept, out = {}, []
    for key, ts, route in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        cost = {"/api/agent": 12, "/api/answer": 4}.get(route, 1)
        live = [(t, c) for t, c in kept.get(key, []) if (ts - t).total_seconds() < window]
        ok = sum(c for _, c in live) + cost <= points
        kept[key] = live + [(ts, cost)] * ok
        out.append((key, ts, ok))
    return sorted(out)


def test_rate_limit(spark):
    got = T.rate_limit(spark.createDataFrame(_requests(), "key string, ts timestamp, route string"), points=40).collect()
    assert sorted((r.key, r.ts, r.allowed) for r in got) == _plain_limit(_requests())


def test_rate_limit_stream(spark, tmp_path):
    frame = spark.createDataFrame(_requests(), "key string, ts timestamp, route string")
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = T.rate_limit_stream(stream, points=40).writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert sorted((r.key, r.ts, r.allowed) for r in spark.table("limits").collect()) == _plain_limit(_requests())


def _same(p: pd.DataFrame) -> list:
    # Integers with nulls come as floats from one side only.
    number = lambda v: isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_))
    cell = lambda v: "NULL" if pd.isna(v) else f"{float(v):.6f}" if number(v) else str(v)
    return sorted(tuple(cell(v) for v in row) for row in p[sorted(p.columns)].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_sql_twin(spark, data, name):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "events"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data}/{t}.parquet')")
    got, want = QUERIES[name](spark, data).toPandas(), db.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _same(got) == _same(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_other_queries_run(spark, data, name):
    assert QUERIES[name](spark, data).count() > 0
