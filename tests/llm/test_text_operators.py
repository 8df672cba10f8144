"""Counts, formats, packs and predictions on odd rows, against plain versions."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest

from loomspark.llm.chat_format import canonical, chat_format, escape, learned_text, read_back, unescape
from loomspark.llm.language_id import Parameters as LanguageParameters
from loomspark.llm.language_id import language_id, letters
from loomspark.llm.packing import Ids, Packer, packing
from loomspark.llm.packing import Parameters as PackParameters
from loomspark.llm.quality_rules import quality_rules
from loomspark.llm.token_counts import Parameters as CountParameters
from loomspark.llm.token_counts import PreTokens, load, token_counts
from loomspark.llm.url_filters import url_filters
from pyspark.sql import functions as F

ODD = [None, "", " \n\t ", "one", "a b c d e " * 40, "x" * 30_000, "the cat <|endoftext|> sat\n\n on É 你好 it's 12", "the cat <|endoftext|> sat\n\n on É 你好 it's 12", "a\rb\fc\vd"]
PRE = PreTokens("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, quality string, n_tokens int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "q", 1) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None), (3, "one", "en", "q", 1)], SCHEMA)


def plain_quality(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {p for i, g in enumerate(grams) if n[g] > 1 for p in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, odd):
    got = quality_rules(odd.select("doc_id", "text", "quality")).collect()
    assert len(got) == len(ODD) + 2
    for r in got:
        q = r.quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == plain_quality(r.text)
        assert q.base_failed == (q.n_words < 10 or 100 * q.n_repeat_words > 20 * q.n_words)
        assert not (q.base_failed and q.kept)
    assert quality_rules(odd.limit(0)).count() == 0


def test_quality_rules_verdicts(spark):
    clean = "the rain in the town fell on a stone and it was cold for all of us in there"
    rows = [(1, clean), (2, clean.replace(" ", "*** ")), (3, "word\n" * 30), (4, " ".join(f"xq{i}z" for i in range(60)))]
    got = {r.doc_id: r.quality for r in quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and got[1].failed == []
    other = {"ru": "все счастливые семьи похожи друг на друга каждая несчастливая семья " * 8, "pl": "kot siedzi na oknie i patrzy jak pies biega w ogrodzie bo to jest " * 6, "el": "η γάτα κάθεται " * 3 + " ".join(f"λέξη{i}" for i in range(60))}
    judged = {r.doc_id: r.quality.failed for r in quality_rules(spark.createDataFrame(list(other.items()), "doc_id string, text string")).collect()}
    assert not any("stop_words" in f for f in judged.values())
    assert "symbols" in got[2].failed and "dup_lines" in got[3].failed and got[4].failed == ["stop_words"]


@pytest.mark.parametrize("p", [CountParameters(), CountParameters(most_known=3, longest_known=4, most_held=2, most_chars=20)])
def test_token_counts(odd, p):
    tokenizer = load("byte_bpe_50k.json")
    rows = odd.repartition(3).withColumn("row_0", F.col("text")).withColumn("counted_0", F.lit(1))
    got = token_counts(rows, p=p).collect()
    assert len(got) == len(ODD) + 2 and "text" not in got[0].asDict() and {r.counted_0 for r in got} == {1}
    for r in got:
        text = r.row_0 or ""
        want = len(tokenizer.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), want, want > 1024)
    assert token_counts(odd.limit(0)).count() == 0


def test_frequent_long_pieces_are_known(spark):
    """Rulers and encoded data over 64 characters, in most of the texts, are counted like the library does, whatever is known."""
    tokenizer = load("byte_bpe_50k.json")
    ruler, data = "=" * 500, "QUJD" * 900
    rows = [(i, f"{ruler} {i} {data if i % 3 else ''} tail" + "y" * (70 + i % 7)) for i in range(60)]
    want = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in rows}
    for p in (CountParameters(), CountParameters(long_bytes=30_000), CountParameters(most_known=2, long_bytes=0)):
        got = token_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), p=p)
        assert {r.doc_id: r.n_tokens for r in got.collect()} == want


def test_pre_tokens_keep_the_library_counts():
    tokenizer, r = load("byte_bpe_50k.json"), np.random.default_rng(3)
    parts = ["a", "Don't", "it's,", "...", "x.", ",,", "é", "ﬁn.", "你好,", "12.5,", "#,", "\n", "  ", "\t", "\u3000", "ab!?", "'s", "'", "_x_.", "!", "<|endoftext|>", "\u0301"]
    for _ in range(3000):
        text = "".join(parts[int(i)] + " " * int(r.integers(3) == 0) for i in r.integers(len(parts), size=12))
        found, n = PRE.cut(text)
        assert n + sum(len(e.ids) for e in tokenizer.encode_batch_fast(found, add_special_tokens=False)) == len(tokenizer.encode(text, add_special_tokens=False).ids), text


def test_token_counts_of_a_table(spark, data):
    from loomspark.llm.queries import op10_token_counts

    tokenizer = load("byte_bpe_50k.json")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = op10_token_counts(spark, data).collect()
    assert len(got) == len(texts) and all(r.n_tokens == len(tokenizer.encode(texts[r.doc_id], add_special_tokens=False).ids) for r in got)


@pytest.mark.parametrize("p", [PackParameters(), PackParameters(size=16, open_windows=2, merged_partitions=1)])
def test_packing(odd, p):
    texts = {}
    for r in odd.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    tokenizer = load("word_bpe_49k.json")
    got = packing(odd.repartition(3, "doc_id"), p=p).toPandas()
    for doc_id, pieces in got.groupby("doc_id", dropna=False):
        same = texts[None if doc_id != doc_id else doc_id]
        want = np.array([*tokenizer.encode(same[0] or "", add_special_tokens=False).ids, p.end_id], "<u4")
        assert (pieces.doc_tokens == len(want)).all()
        assert pieces.length.sum() == len(want) * len(same)
        for r in pieces.itertuples():
            assert r.ids_crc32 == zlib.crc32(want[r.start : r.start + r.length].tobytes())
        if len(same) == 1:
            spans = sorted(zip(pieces.start, pieces.length, strict=True))
            assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False)) and spans[0][0] == 0
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= p.size
    assert packing(odd.limit(0)).count() == 0


def test_packing_of_a_table(spark, data):
    """Every id of every document in exactly one piece, windows gapless and full but for a few."""
    from loomspark.llm.queries import op5_packing

    tokenizer = load("word_bpe_49k.json")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    got = op5_packing(spark, data).toPandas()
    assert set(got.doc_id) == set(texts)
    for doc_id, pieces in got.groupby("doc_id"):
        ids = np.array([*tokenizer.encode(texts[doc_id], add_special_tokens=False).ids, 1], "<u4")
        pieces = pieces.sort_values("start")
        assert (pieces.doc_tokens == len(ids)).all() and pieces.start.tolist() == [0, *pieces.length.cumsum().tolist()[:-1]] and pieces.length.sum() == len(ids)
        assert [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces.itertuples()] == pieces.ids_crc32.tolist()
    windows = got.sort_values("offset").groupby("sequence_id").agg(n=("length", "sum"), offsets=("offset", list), lengths=("length", list))
    assert (windows.n <= 2048).all() and all(o == [0, *np.cumsum(k)[:-1].tolist()] for o, k in zip(windows.offsets, windows.lengths, strict=True))
    assert 1 - windows.n.sum() / (2048 * len(windows)) < 0.05


def test_packer_keeps_its_bound():
    packer = Packer(10, 3)
    seen = []
    for i, n in enumerate([4, 5, 6, 7, 8, 9, 3, 2, 1, 9, 9, 9, 5, 5, 5]):
        if gone := packer.place(i, n):
            seen += gone[1]
        assert len(packer.held) <= 3
    assert sorted(seen + [x for w in packer.held.values() for x in w]) == list(range(15))


def test_ids_equal_the_library():
    ids = Ids("word_bpe_49k.json")
    texts = [t or "" for t in ODD] + ["Ab.'s c,,d !!x ÀÉ Ab. é <|ENDOFTEXT|> foo.<|startoftext|> İΣ"]
    assert ids.of(texts) == [np.array(ids.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_language_whose_words_are_seen_once(spark):
    train = spark.createDataFrame([("the cat sat on the mat and the dog ran to the cat", "en"), ("zyxo quarp blivet", "xx")], "text string, lang string")
    rows = spark.createDataFrame([(1, "zyxo quarp blivet"), (2, "the cat and the dog"), (3, "quarpo blive")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id(rows, train).collect()} == {1: "xx", 2: "en", 3: "xx"}


def test_language_id(spark, odd):
    train = spark.createDataFrame([(i, t, lang) for i in range(4) for t, lang in (("the cat and the dog", "en"), ("der hund und die katze", "de"), ("nothing", None), (None, "fr"))], "doc_id long, text string, lang string")
    rows = spark.createDataFrame([(1, "the dog"), (2, "die Hunde"), (3, None), (4, "123 ..."), (5, ""), (6, "the dog"), (7, "katzen " * 5000)], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id(rows, train, p=LanguageParameters(least_count=1)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6, 7)] == ["en", "de", "und", "und", "und", "en", "de"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1].score == got[6].score
    assert {r.lang_pred for r in language_id(rows, train.limit(0)).collect()} == {"und"}
    assert language_id(rows.limit(0), train).count() == 0


def test_letters_are_letters_only():
    assert [letters(t) for t in ("m²", "x½y", "½ 12 _", "Été_b", None)] == [["m"], ["x", "y"], [], ["été", "b"], []]


def test_language_ties_go_to_the_first_name(spark):
    train = spark.createDataFrame([("xx", "same words"), ("aa", "same words")], "lang string, text string")
    rows = spark.createDataFrame([("same", 1), ("m²", 2)], "text string, found_0 int")
    got = language_id(rows, train, p=LanguageParameters(least_count=1)).orderBy("found_0").collect()
    assert [(r.lang_pred, round(r.score, 6)) for r in got] == [("aa", 0.5)] * 2 and got[0].found_0 == 1


def test_language_of_many_languages(spark):
    names = [f"l{i:03d}" for i in range(260)]
    word = lambda i: "".join(chr(97 + int(d)) for d in f"{i:04d}")
    train = spark.createDataFrame([(g, f"{word(i)} {word(i)}") for i, g in enumerate(names)], "lang string, text string")
    got = language_id(spark.createDataFrame([(i, word(i)) for i in (0, 199, 230, 259)], "doc_id int, text string"), train).collect()
    assert {r.doc_id: r.lang_pred for r in got} == {i: names[i] for i in (0, 199, 230, 259)}


def test_language_scores_against_plain_sums(spark, data):
    """A word's log frequency in each language, else the mean over its longest known n-grams, written out with dictionaries."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang")
    train = docs.filter("doc_id % 2 = 0")
    rows = {(r.lang, r.text) for r in train.collect() if r.lang is not None and r.text is not None}
    counts = {}
    for lang, text in rows:
        counts.setdefault(lang, Counter()).update(letters(text))
    langs = sorted(counts)
    words = {g: {w: n for w, n in c.items() if n >= 2} for g, c in counts.items()}
    langs = [g for g in langs if words[g]]
    grams = {g: Counter(f"<{w}>"[i : i + k] for w in words[g] for k in range(1, 5) for i in range(len(w) + 3 - k)) for g in langs}
    every = sum(grams.values(), Counter())
    grams = {g: {x: n for x, n in c.items() if len(x) == 1 or every[x] >= 2} for g, c in grams.items()}

    def logs(table):
        keys = set().union(*table.values())
        total = {g: sum(table[g].values()) + 0.5 * len(keys) for g in langs}
        return keys, lambda x, g: np.log((table[g].get(x, 0) + 0.5) / total[g])

    (vocabulary, word_log), (known, gram_log) = logs({g: words[g] for g in langs}), logs(grams)

    def score(text):
        total = dict.fromkeys(langs, 0.0)
        for w in letters(text):
            marked = f"<{w}>"
            longest = [x for i in range(len(marked)) if (x := next((marked[i : i + n] for n in range(min(4, len(marked) - i), 0, -1) if marked[i : i + n] in known), None))]
            for g in langs:
                total[g] += word_log(w, g) if w in vocabulary else np.mean([gram_log(x, g) for x in longest]) if longest else 0.0
        best = max(langs, key=lambda g: (total[g], [-ord(c) for c in g]))
        return best, 1 / sum(np.exp(total[g] - total[best]) for g in langs)

    got = language_id(docs.filter("doc_id % 4 = 1"), train).collect()
    assert len(got) > 30
    for r in got:
        want = score(r.text) if letters(r.text) else ("und", 0.0)
        assert r.lang_pred == want[0] and abs(r.score - want[1]) < 1e-6


def test_language_id_on_held_out_rows(spark, data):
    from loomspark.llm.queries import op6_language_id

    truth = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    got = op6_language_id(spark, data).join(truth, "doc_id").filter("held_out").select((F.col("lang") == F.col("lang_pred")).cast("int").alias("hit")).toPandas()
    assert got.hit.mean() >= 0.9


URLS = [
    (1, "https://a.Example.org/en/12?x"), (2, "http://b.example.org/es/1"), (3, "http://c.com/fr/9#z"), (4, "http://c.com/de/9"), (5, "http://n.net/en/1"), (6, None), (7, "no scheme"),
    (8, "x://"), (9, "http://example.org.evil.net/es/1"), (10, "http://notexample.org/es/1"), (11, "http://org"), (12, "http://c.com/de/9"), (13, "http://q.com?u=http://b.example.org/es/"),
]


def test_url_filters(spark):
    pages = spark.createDataFrame([(*u, 1.0) for u in URLS], "page_id long, url string, mean double")
    got = {r.page_id: r for r in url_filters(pages).collect()}
    rules = {i: got[i].rule for i in range(1, 14)}
    assert rules == {1: "example.org/en/1", 2: "example.org/es/", 3: "com/fr/", 4: "com/de/", 5: None, 6: None, 7: None, 8: None, 9: None, 10: "org/", 11: None, 12: "com/de/", 13: None}
    assert (got[1].host, got[1].path) == ("a.example.org", "/en/12") and (got[6].host, got[6].path) == (got[7].host, got[7].path) == ("", "")
    assert {got[i].verdict for i in (1, 2, 4)} == {"block"} and {got[i].verdict for i in (3, 10)} == {"allow"}
    assert url_filters(pages.limit(0)).count() == 0


def test_url_filters_block_only_hosts_that_are_surely_bad(spark):
    labelled = spark.createDataFrame([(f"{h}.net", int(i < k)) for h, k in (("bad", 4), ("good", 72), ("m1", 40), ("m2", 50), ("m3", 45), ("m4", 35)) for i in range(80)] + [("once.net", 0)], "host string, good int")
    pages = spark.createDataFrame([(i, f"http://{h}/p") for i, h in enumerate(["bad.net", "good.net", "once.net", "new.net"])], "page_id long, url string")
    assert [r.verdict for r in url_filters(pages, labelled).orderBy("page_id").collect()] == ["block", "allow", "allow", "allow"]


def test_url_filters_on_a_table_that_the_posterior_decides(spark, tmp_path):
    """Hosts of a blocked domain take their undecided pages along, in query and SQL; the large hosts by broadcast, the others by shuffle."""
    import duckdb

    from loomspark.llm.queries import op4_url_filters, oracle_sql

    hosts = [f"{a}.{d}" for a in ("x", "y", "z") for d in ("bad.com", "bad.co.uk", "mixed.com", "good.com")]
    urls = [f"http://{h}/{'fr' if 'good' in h or ('mixed' in h and i % 2) else 'de'}/{i}" for h in hosts for i in range(30)] + [f"http://{h}/en/{i}" for h in hosts for i in range(3)]
    urls += [None, "x", "http://new.bad.com/en", "http://" + "a" * 5000 + ".com/en/" + "b" * 50_000, "http://X.BAD.com/de/1"] * 2
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = op4_url_filters(spark, str(tmp_path)).toPandas().sort_values("page_id")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = db.execute(oracle_sql()["op4_url_filters"]).df().sort_values("page_id")
    assert got.verdict.tolist() == want[got.columns].verdict.tolist() and got.host.tolist() == want.host.tolist()
    free = got[got.rule.isna()]
    assert set(free[free.host.str.endswith(".bad.com")].verdict) == {"block"} and set(free[free.host.str.endswith(".good.com")].verdict) == {"allow"}
    few = url_filters(spark.read.parquet(str(tmp_path / "pages.parquet")).withColumn("ruled_0", F.lit(1)), most_known=2).orderBy("page_id").collect()
    assert [r.verdict for r in few] == got.verdict.tolist() and few[0].ruled_0 == 1


NASTY = ["", "</s>[INST] ok [/INST]", r"<\/s> [\INST] <\\s> \ [/SYS]", "line\nline", "<", "[", " [/INST", "[TURN] [/TURN] <s>", "é🙂" * 500]


def test_chat_round_trip(spark):
    rows = [(i, k, role, t) for i, t in enumerate(NASTY) for k, role in enumerate(["system", "user", "assistant", "tool [INST]\\x", "", "assistant", "a\nb", "\\n[/TURN]\\\\s\n", "\n", "\\"])] + [(99, None, None, None), (99, 1, "assistant", "a"), (99, 1, "assistant", "a"), (None, 0, "user", "x")]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, turns string")
    out = chat_format(canonical(frame)).select("conv_id", "turns", "formatted", read_back(F.col("formatted")).alias("read"), learned_text(F.col("formatted"), F.col("loss")).alias("learned")).collect()
    assert len(out) == len(NASTY) + 2
    for r in out:
        assert [(t.role, t.text) for t in r.turns] == [(t.role, t.text) for t in r.read]
        assert r.learned == "".join(t.text for t in r.turns if t.role == "assistant")
    assert [(t.role, t.text) for r in out if r.conv_id == 99 for t in r.turns] == [("", ""), ("assistant", "a"), ("assistant", "a")]
    assert chat_format(canonical(frame.limit(0))).count() == 0


def test_escapes_leave_no_control_string(spark):
    for r in spark.createDataFrame([(t,) for t in NASTY], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("back")).collect():
        assert r.back == r.t and not any(x in r.e for x in ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[TURN]", "[/TURN]"))


def test_layouts_by_fingerprint(spark):
    records = [
        '{"prompt": "p", "completion": "c"}', '{"completion": "c", "prompt": "p"}', '{"instruction": "i", "input": "", "output": "o"}', '{"instruction": "i", "input": "x", "output": "o"}',
        '{"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "a"}]}', '{"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "a"}]}', '{"unknown": 1}', "broken", None,
        '{"id": 7, "messages": [{"role": "system", "name": {"role": 1}}, {"role": "user", "content": "u", "id": 3}], "meta": {"a": [1]}}', '{"messages": []}', '{"prompt": "[1, {\\"a\\": 2}]", "completion": "{}", "x": null}',
        '{"messages": [{"role": "user", "content": [{"type": "text", "text": "u"}, {"type": "text", "text": "v"}]}, {"role": "assistant", "content": [{"text": "a"}]}]}', '{"prompt": null, "completion": "c"}', '[1]', '{"messages": [1]}',
    ]
    got = canonical(spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")).orderBy("conv_id").collect()
    pairs = [None if r.turns is None else [(t.role, t.text) for t in r.turns] for r in got]
    ask = lambda q, a: [("user", q), ("assistant", a)]
    assert pairs == [ask("p", "c"), ask("p", "c"), ask("i", "o"), ask("i\n\nx", "o"), ask("u", "a"), ask("u", "a"), None, None, None,
                     [("system", ""), ("user", "u")], [], ask('[1, {"a": 2}]', "{}"), ask("uv", "a"), ask("", "c"), None, None]
    assert {r.conv_id for r in chat_format(canonical(spark.createDataFrame(list(enumerate(records)), "conv_id long, record string"))).filter("formatted is null and loss is null").collect()} == {6, 7, 8, 14, 15}
    typed = spark.createDataFrame([(1, "q", "a")], "conv_id long, question string, answer string")
    assert [(t.role, t.text) for t in canonical(typed).first().turns] == ask("q", "a")
    with pytest.raises(ValueError):
        canonical(typed.select("conv_id", "question"))
    wide = spark.createDataFrame([(1, "x", [("u1", "user", 5)], "made")], "conv_id long, extra string, messages array<struct<content:string,role:string,n:int>>, made_0 string")
    assert [(t.role, t.text) for t in canonical(wide).first().turns] == [("user", "u1")]


def test_loss_spans_of_long_conversations(spark):
    rows = [(1, i, ("user", "assistant", "x")[i % 3], "t" * (i % 7)) for i in range(1500)]
    out = chat_format(canonical(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).withColumn("made_0", F.lit("mine"))
    r = chat_format(out).select("formatted", "loss", "made_0").first()
    assert r.made_0 == "mine" and [r.formatted[s.start : s.start + s.length] for s in r.loss] == [t for _, _, role, t in rows if role == "assistant"]


def test_fingerprints():
    assert hashlib.sha256(b"completion\nprompt").hexdigest() in __import__("loomspark.llm.chat_format", fromlist=["x"]).BY_FINGERPRINT
