"""Toxicity and HTML extraction: gradients, held-out accuracy and odd rows."""

import re
import time
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomspark.llm import nn
from loomspark.llm.html_extract import PageMaker, blocks, features, html_extract, trained
from loomspark.llm.toxicity import Encoder, Parameters, Scorer, tokens, toxicity, train, windows

SMALL = Parameters(most_documents=(60, 60), passes=4, batch_windows=60)


@pytest.mark.parametrize("layer, back, gates", [(nn.gru, nn.gru_back, 3), (nn.lstm, nn.lstm_back, 4)])
def test_gradients(layer, back, gates):
    r = np.random.default_rng(0)
    x, u = r.normal(size=(4, 3, gates * 2)), r.normal(size=(2, gates * 2))
    mask, w = np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0]], float), r.normal(size=(4, 3, 2))
    loss = lambda: float((layer(x, mask, u)[0] * w).sum())
    dx, du = back(w, layer(x, mask, u)[1])
    for table, grad in ((x, dx), (u, du)):
        for at in list(np.ndindex(table.shape))[::3]:
            keep = table[at]
            table[at] = keep + 1e-5
            up = loss()
            table[at] = keep - 1e-5
            down = loss()
            table[at] = keep
            assert abs((up - down) / 2e-5 - grad[at]) < 1e-5


def _rows(n=120):
    r = np.random.default_rng(1)
    plain = [f"{a}{b}" for a in ("mo", "ta", "ri", "so") for b in ("len", "ka", "dor", "vis")]
    bad = ["scumvar", "scumlet", "scumdor"]
    rows = []
    for i in range(n):
        w = list(r.choice(plain, int(r.integers(5, 150))))
        if i % 2:
            for k in r.integers(0, len(w), 3):
                w[k] = str(r.choice(bad))
        rows.append((i, " ".join(w), i % 2))
    return rows


@pytest.fixture(scope="module")
def scorer():
    return Scorer(train([(t, y) for _, t, y in _rows()], SMALL))


def test_windows_cover_all_words():
    for n in (1, 31, 32, 33, 56, 57, 500, 4001):
        seen = np.zeros(n, bool)
        for s in windows(n, Parameters()):
            seen[s : s + 32] = True
        assert seen.all()


def test_toxic_words_are_found_anywhere_in_a_long_text(scorer):
    clean = "molen taka rilen sodor " * 40_000
    far = clean + "scumlet scumvar scumlet " + "molen taka rilen sodor " * 100
    got = scorer.score([clean, far, "", None, "...", "scumlet scumvar"])
    assert got[0] < 0.3 <= got[1] and got[2:5] == [0.0, 0.0, 0.0] and got[5] >= 0.3


def test_training_reads_texts_and_words_to_their_ends():
    """What marks these texts stands behind 5,000 clean words; a long word is told by how it ends."""
    clean = "molen taka rilen sodor " * 1250
    rows = [(f"{clean} {'scumvar scumlet' if i % 2 else 'molen taka'} sodor{i}", i % 2) for i in range(40)]
    far = Scorer(train(rows, SMALL)).score(["taka molen", "scumvar scumlet"])
    assert far[0] < 0.3 <= far[1]
    assert {g for g in Encoder.pieces("a" * 60 + "zq")} >= {"zq>", "azq>"}


def test_scores_equal_windows_one_by_one(scorer):
    text = " ".join(t for _, t, _ in _rows(6))
    w = tokens(text)
    one = [scorer.score([" ".join(w[s : s + 32])])[0] for s in windows(len(w), SMALL)]
    assert abs(max(one) - scorer.score([text])[0]) < 1e-4


def plain_score(network, text):
    """The highest window's probability, word by word and window by window, without batches, padding or tables."""
    w, n, enc = network.w, network.p.hidden, network.encoder
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    words = [t for t in re.findall(r"[a-z0-9]+", text.lower())]
    if not words:
        return 0.0

    def vector(word):
        marked = f"<{word}>"
        grams = [enc.ngrams[g] for k in (3, 4) for i in range(len(marked) - k + 1) if (g := marked[i : i + k]) in enc.ngrams]
        return np.concatenate([w["word"][enc.words.get(word, 0)], np.mean([w["char"][g] for g in grams], axis=0) if grams else np.zeros(network.p.char_size)])

    def states(seen, way):
        h, out = np.zeros(n), []
        for x in seen:
            a, b = x @ w[f"in_{way}"] + w[f"b_{way}"], h @ w[f"u_{way}"]
            z, r = sigmoid(a[:n] + b[:n]), sigmoid(a[n : 2 * n] + b[n : 2 * n])
            h = h + (1 - z) * (np.tanh(a[2 * n :] + r * b[2 * n :]) - h)
            out.append(h)
        return out

    best = 0.0
    for s in windows(len(words), network.p):
        seen = [vector(x) for x in words[s : s + network.p.window]]
        h = np.array([np.concatenate(x) for x in zip(states(seen, "f"), states(seen[::-1], "b")[::-1], strict=True)])
        e = np.tanh(h @ w["att"]) @ w["att_v"]
        weight = np.exp(e - e.max())
        best = max(best, sigmoid((weight / weight.sum()) @ h @ w["out"] + w["out_b"][0]))
    return best


def test_scores_equal_a_plain_network(scorer):
    texts = [t for _, t, _ in _rows(12)] + ["", "unseen wordings scumlet", "mo " * 200]
    assert np.allclose(scorer.score(texts), [plain_score(scorer.network, t) for t in texts], atol=1e-4)


def test_toxicity_on_odd_rows(spark):
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in _rows()] + [(900, None, 1.0), (901, "", 1.0), (902, "scumlet scumvar scumdor", 1.0), (902, "scumlet scumvar scumdor", 1.0), (None, "molen", 1.0)], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in _rows()] + [(900, 1), (None, 1), (5, None), (7, 1)], "doc_id long, toxic int")
    got = toxicity(docs, labels, p=SMALL).collect()
    assert len(got) == 125 and {r.predicted for r in got if r.doc_id == 902} == {1} and {r.score for r in got if r.doc_id in (900, 901)} == {0.0}
    assert toxicity(docs, labels.limit(0), p=SMALL).count() == 125 and toxicity(docs.limit(0), labels, p=SMALL).count() == 0


def test_toxicity_on_held_out_rows(spark, data):
    from loomspark.llm.queries import op1_toxicity

    truth = spark.read.parquet(f"{data}/labels.parquet").select("doc_id", "toxic")
    got = op1_toxicity(spark, data).join(truth, "doc_id").filter("held_out").toPandas()
    assert ((got.score >= 0.3).astype(int) == got.predicted).all() and (got.predicted == got.toxic).mean() >= 0.7


PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="ad">Buy  now</div><article><h1>A &amp; B</h1><p><b>First
 line<br>and more<p>Second &lt;x&gt; caf&eacute;.</p><ul><li>one item here</li></ul></article><section class="comments"><h3>Comments</h3><div class="comment">I disagree</div></section>
<form><label>Mail</label><input value="x"><button>Send</button></form><footer>&copy; site &middot; all rights</footer></body></html>"""


def test_blocks():
    assert [b.text for b in blocks(PAGE)][:5] == ["Home", "News", "Buy now", "A & B", "First line and more"]
    assert [b.text for b in blocks("<p>a<p>b<div>c<span>d</span></div>e")] == ["a", "b", "cd", "e"]
    assert blocks(None) == [] and blocks("<p") == [] and [b.text for b in blocks("a < b <p title='x>y'>c")] == ["a < b", "c"]


def test_deep_and_long_pages_take_linear_time():
    began = time.time()
    deep = blocks("<div class=c>x" * 100_000 + "</b></p></li>" * 20_000)
    assert len(deep) == 100_000 and len(trained().labels([deep, blocks(PAGE)])[0]) == 100_000
    assert time.time() - began < 60


def test_all_words_and_all_blocks_are_read():
    words = lambda t: features(blocks(f"<p>{t}</p>"), trained().p)[1].ids.tolist()
    assert words("a " * 3000 + "zebra")[-1] == words("zebra")[0] and len(words("a " * 3000 + "zebra")) == 3001
    # A long page's labels are those of one run over all of its blocks.
    page = [b for _ in range(60) for b in blocks(PAGE)]
    net = trained()
    assert (net.labels([blocks(PAGE), page, []])[1] == (net.forward([net.inputs(features(page, net.p))])[0][:, 0] > 0)).all() and len(page) > 500


def test_extraction_of_an_empty_table(spark):
    assert html_extract(spark.createDataFrame([], "page_id long, html string, n_chars string")).count() == 0


def test_extraction(spark):
    rows = [(1, PAGE), (2, None), (3, ""), (4, PAGE), (5, PAGE[:420]), (6, "<article>" + "<p>Some words of a long article here.</p>" * 900 + "</article>")]
    got = {r.page_id: r for r in html_extract(spark.createDataFrame([(*r, "old") for r in rows], "page_id long, html string, text string")).collect()}
    assert got[1].text == "A & B\nFirst line and more\nSecond <x> café.\none item here" and got[1].n_chars == len(got[1].text) and got[4].text == got[1].text
    assert (got[2].text, got[2].n_chars, got[3].text) == ("", 0, "") and got[6].text.count("\n") == 899


def test_labels_of_unseen_pages():
    maker = PageMaker(12345)
    pages = [maker.page() for _ in range(150)]
    got = trained().labels([b for b, _ in pages])
    right = sum(int((np.array(y) == g).sum()) for (_, y), g in zip(pages, got, strict=True))
    assert right / sum(len(y) for _, y in pages) >= 0.98


class Article(HTMLParser):
    """The texts of a page's article by the standard library's parser: a block ends where an element that is no inline one begins or ends."""

    INLINE = frozenset({"a", "b", "i", "em", "strong", "span", "u", "small", "code", "sup", "sub"})
    UNSEEN = frozenset({"script", "style", "template", "noscript"})

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.depth = self.unseen = 0
        self.held, self.out = [], []

    def cut(self):
        text = " ".join("".join(self.held).split())
        self.out += [text] if text else []
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.held.append(" ")
        elif tag not in self.INLINE:
            self.cut()
        self.depth += tag == "article"
        self.unseen += tag in self.UNSEEN

    def handle_endtag(self, tag):
        if tag not in self.INLINE:
            self.cut()
        self.depth -= tag == "article"
        self.unseen -= tag in self.UNSEEN

    def handle_data(self, data):
        if self.depth > 0 and not self.unseen:
            self.held.append(data)


def test_pages_against_another_parser(spark, data):
    from loomspark.llm.queries import op8_html_extract

    pages = op8_html_extract(spark, data).join(spark.read.parquet(f"{data}/pages.parquet").select("page_id", "html"), "page_id").toPandas()
    hits = []
    for text, page in zip(pages.text, pages.html, strict=True):
        parser = Article()
        parser.feed(page)
        parser.close()
        parser.cut()
        hits.append(text == "\n".join(parser.out))
    assert len(hits) >= 50 and np.mean(hits) >= 0.95


def test_pages_of_the_tables(spark, data):
    from loomspark.llm.queries import op8_html_extract

    pages = op8_html_extract(spark, data).join(spark.read.parquet(f"{data}/pages.parquet").select("page_id", "html"), "page_id").toPandas()
    inside = lambda b: any(m[0] == "article" for m in b.path or ())
    hits = [t == "\n".join(b.text for b in blocks(h) if inside(b)) for t, h in zip(pages.text, pages.html, strict=True)]
    assert np.mean(hits) >= 0.98
