"""The engine under SQL names: functions that SQL itself can state, vectorised ones for tasks, and two table functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from loomspark.functions import query as Q
from loomspark.functions import text as X
from loomspark.operators.selection import content_count, count_tokens, truncate
from loomspark.operators.single import chunk_text, compile_text

_STEM = (
    "if(length(p) >= 4 AND octet_length(p) = length(p), CASE WHEN endswith(p, 's') THEN if(endswith(p, 'ss'), p, substring(p, 1, length(p) - 1)) WHEN endswith(p, 'ed') THEN substring(p, 1, length(p) - 2) "
    "WHEN length(p) >= 5 AND endswith(p, 'ing') THEN substring(p, 1, length(p) - 3) ELSE p END, p)"
)
_NGRAMS = "flatten(transform(sequence(1, length(p)), i -> if(i < length(p), array(substring(p, i, 1), substring(p, i, 2)), array(substring(p, i, 1)))))"
#: Functions of SQL alone, which stay inside the JVM: (arguments, type, expression).
NATIVE = {
    "token_count": ("t STRING", "INT", "greatest(1, CAST(floor(octet_length(encode(coalesce(t, ''), 'UTF-16BE')) / 8) AS INT))"),
    "content_tokens": ("t STRING", "INT", r"token_count(coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(t, r'<!--[\s\S]*?-->', ' '), r'\n{3,}', '\n\n'), r'(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$', ''), ''), t))"),
    "tokenize": ("t STRING", "ARRAY<STRING>", rf"flatten(transform(regexp_extract_all(lower(coalesce(t, '')), r'{X.TOKEN}', 0), p -> CASE WHEN rlike(p, r'^[{X.CJK}]+$') THEN {_NGRAMS} WHEN rlike(p, r'{X.ARABIC}') THEN array(regexp_replace(p, r'{X.ARABIC_MARKS}', '')) ELSE array({_STEM}) END))"),
}


def _each(kind: str, f):
    @F.pandas_udf(kind)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: f(x or ""), na_action=None)

    return run


@F.udtf(returnType="id string, ord int, breadcrumb string, text string, tokens int")
class ChunkMarkdown:
    """The sections of one text."""

    def eval(self, md: str):
        for s in chunk_text(md or ""):
            yield s.id, s.ord, s.breadcrumb, s.text, s.tokens


@F.udtf(returnType="markdown string, tokens_used int, selected array<string>, omitted array<string>, stopped_early boolean")
class CompileContext:
    """The selection from one text for one task."""

    def eval(self, md: str, task: str, budget: int):
        done = compile_text(md or "", task or "", budget)
        yield done.text, content_count(done.text.split("\n---\n")[0]) if done.selected else 0, [s.id for s in done.selected], [s.id for s in done.omitted], done.stopped_early


def register(spark: SparkSession) -> list[str]:
    """Registers token_count, content_tokens, tokenize, tokenize_query, split_aspects and truncate_section, and the table
    functions chunk_markdown(md) and compile_context(md, task, budget); null texts count as empty."""

    @F.pandas_udf("string")
    def truncate_section(text: pd.Series, most: pd.Series, task: pd.Series) -> pd.Series:
        def one(t, n, q):
            got = truncate(t or "", count_tokens(t or ""), int(n), Q.query_terms(q) if q else [])
            return got[0] if got else None

        return pd.Series([one(*r) for r in zip(text, most, task, strict=True)], dtype="object")

    for name, (args, kind, body) in NATIVE.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    made = {"tokenize_query": _each("array<string>", Q.query_terms), "split_aspects": _each("array<string>", Q.split_aspects), "truncate_section": truncate_section}
    for name, f in made.items():
        spark.udf.register(name, f)
    spark.udtf.register("chunk_markdown", ChunkMarkdown)
    spark.udtf.register("compile_context", CompileContext)
    return sorted([*NATIVE, *made, "chunk_markdown", "compile_context"])
