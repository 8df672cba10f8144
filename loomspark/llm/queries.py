"""The queries over the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.centroids import centroid_clusters
from loomspark.llm.chat_format import canonical, chat_format, learned_text, read_back
from loomspark.llm.common import held_out, table
from loomspark.llm.decontamination import decontamination
from loomspark.llm.divergence import divergence
from loomspark.llm.embedding_dedup import embedding_dedup
from loomspark.llm.html_extract import html_extract
from loomspark.llm.language_id import language_id
from loomspark.llm.ngram_join import ngram_join
from loomspark.llm.packing import packing
from loomspark.llm.quality_rules import quality_rules
from loomspark.llm.token_counts import token_counts
from loomspark.llm.toxicity import toxicity
from loomspark.llm.url_filters import url_filters


def training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels of documents that are not held out."""
    return table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", "toxic")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return toxicity(docs, training_labels(spark, sf_dir)).select("doc_id", "held_out", "score", "predicted")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs).select("doc_id", *[f"quality.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


OP2_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
win AS (SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(lines) AS n_lines, len(list_filter(lines, lambda x: len(regexp_extract_all(x, '[#*$%&|<>]')) * 10 > length(x))) AS n_symbol_lines,
        len(list_filter(w, lambda x: list_contains(string_split('{stop}', ' '), lower(x)))) AS n_stop,
        len(regexp_extract_all(text, '[{scripts}]')) AS n_other
      FROM w LEFT JOIN cover USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
       OR n_symbols / n_words > 0.1 OR (n_words >= 50 AND n_stop / n_words < 0.02 AND n_other * 2 <= word_chars) OR n_dup_lines / n_lines > 0.3
       OR n_symbol_lines / n_lines > 0.5) AS kept
FROM m
"""


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(CASE WHEN len(w) = 0 THEN [] ELSE range(1, greatest(len(w) - 3, 2)) END) AS i FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
r AS (SELECT DISTINCT a AS doc_id, a AS r FROM l UNION SELECT l.b, r.r FROM r JOIN l ON l.a = r.doc_id),
c AS (SELECT doc_id, min(r) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.c, d.doc_id)::BIGINT AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filters(pages).select("page_id", "host", "path", "rule", "verdict")


OP4_SQL = r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
j AS (SELECT *, CASE WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
               WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
               WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
               WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
               WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule,
         list_contains(string_split('{two}', ' '), array_to_string(string_split(host, '.')[-2:], '.')) AS two,
         array_to_string(string_split(host, '.')[CASE WHEN two THEN -3 ELSE -2 END:], '.') AS domain,
         CASE WHEN two THEN array_to_string(string_split(host, '.')[-2:], '.') ELSE string_split(host, '.')[-1] END AS suffix FROM p),
v AS (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS v FROM j),
h AS (SELECT host, domain, suffix, count(*) AS n, sum((v = 'allow')::INT) AS good FROM v WHERE v IS NOT NULL GROUP BY ALL),
d AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM h GROUP BY ALL),
s AS (SELECT suffix, sum(n) AS n, sum(good) AS good FROM d GROUP BY ALL),
g AS (SELECT coalesce(sum(n), 0) AS n, coalesce(sum(good), 0) AS good FROM s),
u AS (SELECT 'h' AS lv, n, good FROM h UNION ALL SELECT 'd', n, good FROM d UNION ALL SELECT 's', n, good FROM s),
a AS (SELECT lv, count(*) AS k, sum(n)::DOUBLE AS n, sum(good)::DOUBLE AS y, sum(n * n)::DOUBLE AS n2, sum(good * good / n) AS yy FROM u GROUP BY lv),
b AS (SELECT *, y / n * (1 - y / n) AS var, n - n2 / n - (k - 1) AS free FROM a),
r AS (SELECT lv, CASE WHEN k >= 2 AND y > 0 AND y < n AND free > 0 THEN ((yy - n * (y / n) * (y / n)) - var * (k - 1)) / (var * free) END AS rho FROM b),
c AS (SELECT lv, CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1), 1000) ELSE 1000 END AS k FROM r),
ks AS (SELECT max(k) FILTER (lv = 'h') AS kh, max(k) FILTER (lv = 'd') AS kd, max(k) FILTER (lv = 's') AS ks FROM c),
m AS (SELECT (good + 1) / (n + 2) AS mean FROM g),
sm AS (SELECT suffix, (good + ks * mean) / (n + ks) AS suffix_mean FROM s, m, ks),
dm AS (SELECT domain, (good + kd * suffix_mean) / (n + kd) AS domain_mean FROM d JOIN sm USING (suffix), ks),
post AS (SELECT host, coalesce(hh.good, 0) + pr * kh AS a, coalesce(hh.n, 0) - coalesce(hh.good, 0) + (1 - pr) * kh AS b
  FROM (SELECT DISTINCT v.host, coalesce(domain_mean, suffix_mean, mean) AS pr FROM v LEFT JOIN dm USING (domain) LEFT JOIN sm USING (suffix), m) LEFT JOIN h hh USING (host), ks)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN a / (a + b) + 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN post USING (host)
"""


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing(table(spark, sf_dir, "documents").select("doc_id", "text"), path="word_bpe_49k.json")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    return language_id(docs.select("doc_id", "text", "held_out"), docs.filter("not held_out")).select("doc_id", "held_out", "lang_pred", "score")


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    out = chat_format(canonical(rows.unionByName(odd)))
    read = out.select("conv_id", "formatted", "loss", read_back(F.col("formatted")).alias("read"), learned_text(F.col("formatted"), F.col("loss")).alias("learned"))
    every = F.concat_ws("", F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read.select("conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(every, 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"),
                       F.sha2("learned", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP7_SQL = r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT *, length(regexp_replace(text, '([<\[])(\\*)(/?s>|/?(?:INST|SYS|TURN)\])', '\1\\\2\3', 'g'))
         + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 13
           ELSE 16 + length(regexp_replace(role, '[\\\n<\[]', 'xx', 'g')) END AS size FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", F.round("similarity", 6).alias("similarity"))


#: Every window that a shared shingle points at, and those between neighbouring ones, verified without fingerprints.
OP9_SQL = r"""
WITH d AS (SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents)),
i AS (SELECT item_id, iw, len(iw) AS m, least(len(iw), 5) AS k FROM (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS iw FROM benchmark) WHERE len(iw) > 0),
dg AS (SELECT doc_id, n, k, p, array_to_string(w[p:p + k - 1], ' ') AS g FROM (SELECT doc_id, w, n, k, unnest(range(1, n - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i))),
ig AS (SELECT item_id, m, k, p, array_to_string(iw[p:p + k - 1], ' ') AS g FROM (SELECT item_id, iw, m, k, unnest(range(1, m - k + 2)) AS p FROM i)),
nn AS (SELECT count(*) AS n_items FROM i),
wt AS (SELECT g, ln(1 + n_items / count(DISTINCT item_id)) AS weight FROM ig, nn GROUP BY g, n_items),
iw AS (SELECT item_id, g, weight FROM (SELECT DISTINCT item_id, g FROM ig) JOIN wt USING (g)),
it AS (SELECT item_id, sum(weight) AS total FROM iw GROUP BY item_id),
al AS (SELECT DISTINCT doc_id, item_id, m, least(greatest(dg.p - ig.p, 0), greatest(n - m, 0)) AS start FROM dg JOIN ig USING (k, g)),
win AS (SELECT doc_id, item_id, m, unnest(CASE WHEN following - start < m THEN range(start, following) ELSE [start] END) AS start
  FROM (SELECT *, lead(start) OVER (PARTITION BY doc_id, item_id ORDER BY start) AS following FROM al)),
ws AS (SELECT DISTINCT doc_id, item_id, start, array_to_string(w[q:least(q + 4, start + m)], ' ') AS g
  FROM (SELECT doc_id, item_id, m, start, w, unnest(range(start + 1, greatest(least(start + m, n) - 3, start + 2))) AS q FROM win JOIN d USING (doc_id))),
wn AS (SELECT doc_id, item_id, start, count(*) AS n FROM ws GROUP BY ALL),
sh AS (SELECT doc_id, item_id, start, count(*) AS k, sum(weight) AS shared FROM ws JOIN iw USING (item_id, g) GROUP BY ALL),
sim AS (SELECT doc_id, item_id, start, shared / (total + ln(1 + n_items) * (n - k)) AS similarity FROM sh JOIN wn USING (doc_id, item_id, start) JOIN it USING (item_id), nn),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY round(similarity, 9) DESC, start) AS k FROM sim WHERE similarity >= 0.75 - 1e-9)
SELECT doc_id, item_id, start::BIGINT AS start, round(similarity, 6) AS similarity FROM r WHERE k = 1
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, path="byte_bpe_50k.json", limit=1024).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT k) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
n AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
tot AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY ALL),
p AS (SELECT g.lang, g.source, kept.term, coalesce(n.n, 0) AS n, 1 + (1000000000 * (coalesce(n.n, 0) + 2)::HUGEINT) // (coalesce(total, 0) + 2 * v)::HUGEINT AS p
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source, term) LEFT JOIN tot USING (lang, source)),
q AS (SELECT lang, term, 1 + (1000000000 * (sum(n) + 2)::HUGEINT) // (sum(sum(n)) OVER (PARTITION BY lang) + 2 * any_value(v))::HUGEINT AS q FROM p JOIN v USING (lang) GROUP BY lang, term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
k AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM k WHERE part = 'pair' OR rank <= 10
"""


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


_OP12_ROUND = """
m{n} AS (SELECT i, v, d // 100 AS distance, (d % 100)::INT AS cluster FROM (
  SELECT i, any_value(v.v) AS v, min(list_sum(list_transform(list_zip(v.v, c.v), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::HUGEINT * 100 + c.j) AS d FROM v, c{n} c GROUP BY i)),
"""
_OP12_MEAN = """
s{n} AS (SELECT cluster, x, sum(y) AS s, count(*) AS k FROM (SELECT cluster, unnest(v) AS y, unnest(range(64)) AS x FROM m{n}) GROUP BY ALL),
c{m} AS (SELECT c{n}.j, coalesce(f.v, c{n}.v) AS v FROM c{n} LEFT JOIN (SELECT cluster AS j, list(((s - (((s % k) + k) % k)) // k)::BIGINT ORDER BY x) AS v FROM s{n} GROUP BY cluster) f USING (j)),
"""
OP12_SQL = (
    """
WITH v AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS (SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1)::INT AS j, v FROM v WHERE vec_id IS NOT NULL QUALIFY j < 16),"""
    + "".join(_OP12_ROUND.format(n=n) + (_OP12_MEAN.format(n=n, m=n + 1) if n < 3 else "") for n in range(4))
    + """
h AS (SELECT j AS cluster, sha256(array_to_string(v, ',')) AS centroid_sha256 FROM c3)
SELECT vec_id, cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM m3 JOIN (SELECT i, vec_id FROM v) USING (i) JOIN h USING (cluster)
"""
)


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


OP13_SQL = r"""
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding) AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.93),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a),
r AS (SELECT a AS vec_id, a AS r FROM l UNION SELECT l.b, r.r FROM r JOIN l ON l.a = r.vec_id),
c AS (SELECT vec_id, min(r) AS c FROM r GROUP BY vec_id)
SELECT d.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, coalesce(c.c, d.vec_id) AS component_id, coalesce(c.c, d.vec_id) = d.vec_id AS kept
FROM embeddings d LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from loomspark.llm.quality_rules import OTHER_SCRIPTS, STOP_WORDS

    from loomspark.llm.url_filters import TWO_LABEL_SUFFIXES

    return {"op11_source_divergence": OP11_SQL, "op12_centroid_clusters": OP12_SQL, "op13_embedding_dedup": OP13_SQL, "op4_url_filters": OP4_SQL.replace("{two}", " ".join(TWO_LABEL_SUFFIXES)), "op3_ngram_join": OP3_SQL, "op9_decontamination": OP9_SQL, "op7_chat_format": OP7_SQL, "op2_quality_rules": OP2_SQL.replace("{stop}", " ".join(sorted(set(STOP_WORDS)))).replace("{scripts}", "".join(rf"\p{{{x}}}" for x in OTHER_SCRIPTS))}
