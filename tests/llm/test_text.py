"""Language, main text, exact search and the pipeline."""

import math
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tickloom.llm import html_text, language, queries, topk

SMALL, SF = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_op5_held_out_accuracy(spark):
    rows = queries.op5_language(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    joined = rows.join(docs, "doc_id").collect()
    assert len(joined) == docs.count()
    held = [r for r in joined if r.held_out]
    assert 100 < len(held) < 300
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.98
    assert all(0 <= r.score <= 1 for r in joined)


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en", 9), (2, "der Hund und die Katze", "de", 9), (2, "der Hund und die Katze", "de", 9), (3, None, "en", 9), (4, "", None, 9), (5, "123 ² ½ !!! _", None, 9), (None, "der und die", None, 9), (7, "the and " * 50_000, None, 9), (8, "thecatt", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = language.fit(docs)
    assert model.langs == ["de", "en"]
    out = language.predict(docs, model)
    assert out.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    got = [(r.doc_id, r.lang_pred) for r in out.collect()]
    assert got == [(1, "en"), (2, "de"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "de"), (7, "en"), (8, "en")]
    nothing = language.fit(docs.limit(0))
    assert nothing.langs == [] and {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0


def test_backoff_is_by_longest_known_gram():
    model = language.LanguageModel(["x"], {"known": np.array([-1.0])}, {"^": np.array([-4.0]), "ab": np.array([-2.0]), "a": np.array([-8.0]), "c": np.array([-6.0])}, 3)
    assert model.score("known")[0] == -1.0
    assert model.score("abc")[0] == pytest.approx((-4 - 2 - 6) / 3)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="with-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A, b</a></li></ul></nav><!-- <p>no</p> --><div class="cookie-notice">We use cookies, and more cookies.</div>
<div id="main"><article><h1>Head &amp; line</h1><p><b>First &lt;para&gt;&nbsp;with,  commas,
 and more text.<br><p>Second &eacute; with <a href=x>a link</a> &#8364;, of some length, to score.</p><ul><li>One<li>Two</ul><blockquote>Quoted</blockquote><form><input value=1>Send</form>
<div class="ad">Buy now</div></article><aside>Aside, with, many, commas</aside></div><div class="comments"><p>A reader, writes, a long comment, here, and here.</p></div><footer>&copy; x</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & line\nFirst <para> with, commas, and more text.\nSecond é with a link €, of some length, to score.\nOne\nTwo\nQuoted"


def test_best_container_without_article():
    long = "This paragraph has some length, with commas, so that it scores well enough to win. "
    page = f"<body><div class=menu><a href=1>x</a></div><div><p><a href=1>{long}</a></p></div><div id=story><p>{long}</p><p>{long * 2}</p>tail</div><div><a href=2>more</a></div></body>"
    assert html_text.main_text(page) == f"{long.strip()}\n{(long * 2).strip()}\ntail"


def test_wrappers_and_comments():
    text = "Some article text, with commas, that is long enough to be found as the main text of the page."
    page = f'<div class="page has-sidebar"><div class="sidebar"><p>{text} No.</p></div><article class="post"><p>{text}</p></article><section class="comments"><article><p>{text} {text}</p></article></section></div>'
    assert html_text.main_text(page) == text


ARTICLE = "Some article text, with commas, that is long enough to be found as the main text of the page, and some more."
REMARK = "A reader's remark, with commas, that is about as long as the article is, or even a little longer, as remarks, at times, are."


@pytest.mark.parametrize(
    "page",
    [
        f'<article><p>{ARTICLE}</p><p>{ARTICLE}</p><div class="comments"><article><p>{REMARK}</p><p>{REMARK}</p><p>{REMARK}</p></article></div></article>',
        f'<div id="page"><article><p>{ARTICLE}</p><p>{ARTICLE}</p></article><div class="related"><article><p>{REMARK * 4}</p></article></div></div>',
        f'<main><article><p>{ARTICLE}</p><p>{ARTICLE}</p></article><section class="comments"><article><p>{REMARK}</p></article><article><p>{REMARK * 3}</p></article><article><p>{REMARK}</p></article></section></main>',
        f'<table><tr><td><ul><li><a href="a">Home</a></li><li><a href="b">News</a></li><li><a href="c">Sport</a></li></ul></td><td><p>{ARTICLE}</p><p>{ARTICLE}</p></td></tr></table>',
        f'<article><div class="promo"><article><p>{REMARK * 5}</p></article></div><p>{ARTICLE}</p><p>{ARTICLE}</p></article>',
    ],
)
def test_noise_never_replaces_the_article(page):
    assert html_text.main_text(page) == f"{ARTICLE}\n{ARTICLE}"


def test_nested_articles_belong_to_the_outermost_that_scores():
    page = f"<body><article><h1>Head</h1><p>{ARTICLE}</p><article><p>{REMARK}</p></article></article></body>"
    assert html_text.main_text(page) == f"Head\n{ARTICLE}\n{REMARK}"


def plain_best(tree):
    """The container with the most points, by recursion over tags alone: paragraphs give to parent and, halved, to grandparent."""
    points = {}

    def size(x):
        return sum(len(" ".join(c.split())) if isinstance(c, str) else size(c) for c in x.children)

    def commas(x):
        return sum(c.count(",") if isinstance(c, str) else commas(c) for c in x.children)

    def walk(x):
        for c in x.children:
            if not isinstance(c, str):
                if c.name == "p" and size(c):
                    own = 1 + commas(c) + min(size(c) / 100, 3)
                    points[x] = points.get(x, 0) + own
                    if x.parent is not None:
                        points[x.parent] = points.get(x.parent, 0) + own / 2
                walk(c)

    walk(tree)
    return max(((v + 2 * (k.name == "div"), k) for k, v in points.items()), key=lambda x: x[0])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 5), st.integers(1, 6), st.integers(10, 300)), min_size=1, max_size=12))
def test_score_equals_plain_recursion(shape):
    """On trees of bare divisions and paragraphs, without a name or a link, the score alone decides."""
    page = "".join("<div>" * (d % 3) + "".join(f"<p>{'word, ' * c}{'x' * n}</p>" for _ in range(1 + d // 3)) + "</div>" * (d % 3) for d, c, n in shape)
    tree = html_text.parse(f"<body>{page}</body>")
    html_text.settle(tree, True)
    best, stack = plain_best(tree), [tree]
    html_text.score(tree)
    while stack:
        node = stack.pop()
        stack += [c for c in node.children if not isinstance(c, str)]
        if node.name in ("div", "body"):
            assert node.score <= best[0] + 1e-9
    assert best[1].score == pytest.approx(best[0])


@pytest.mark.parametrize(("page", "want"), [(None, ""), ("", ""), ("plain text", "plain text"), ("<p>a<p>b", "a\nb"), ("<p>a < b & c</p>", "a < b & c"), ("<script>x</script>", ""), ("<p>unclosed <i>it", "unclosed it"), ("</div></p><p>x</div>", "x"), ("<nav>only</nav>", "")])
def test_odd_pages(page, want):
    assert html_text.main_text(page) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<a href='x'>", "</a>", "word, ", "&amp;", "<", ">", "<!--", "-->", "<li>", "<td", "<script>", "</script>", "\n"]), max_size=40))
def test_any_markup_is_read(parts):
    text = html_text.main_text("".join(parts))
    assert all(line == " ".join(line.split()) and line for line in text.split("\n")) or text == ""


def test_op10_finds_the_article(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op10_main_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.n_chars == len(r.text)
        article = pages[r.page_id].split("<article>")[1].split("</article>")[0]
        plain = " ".join(article.replace("<br>", " ").replace("<h1>", " ").replace("</h1>", " ").replace("<p>", " ").replace("</p>", " ").replace("<b>", "").replace("</b>", "").split())
        import html

        assert " ".join(r.text.split()) == " ".join(html.unescape(plain).split())


def test_page_edges(spark):
    rows = [(1, None, "<p>a", 7), (1, None, "<p>a", 7), (None, "u", None, 7), (2, "u", "<div>" * 5000 + "deep", 7), (3, "u", "<p>word, </p>" * 20_000, 7)]
    out = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, id int")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in out) == [(0, 0), (1, 1), (1, 1), (2, 4), (3, 6 * 20_000 - 1)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def simple_top(rows, k=10):
    v = {i: np.floor(1024 * np.array(x, float)) for i, x in rows if x is not None and all(c is not None and np.isfinite(c) for c in x)}
    return {(q, r, i, s) for q in v if q % 100 == 0 for r, (s, i) in enumerate(sorted(((int(v[q] @ v[i]), i) for i in v if i != q), key=lambda p: (-p[0], p[1]))[:k], 1)}


def test_op9_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert {tuple(r) for r in queries.op9_top_k(spark, SF).select("query_id", "rank", "vec_id", "score").collect()} == simple_top(rows)


@pytest.mark.parametrize("block", [7, 1000])
def test_top_k_ties_and_edges(spark, block):
    rng = np.random.default_rng(block)
    rows = [(i, (rng.integers(-2, 3, 4) / 2.0).tolist()) for i in range(0, 150)] + [(200, None), (300, [1.0, None, 0.0, 0.0]), (301, [1.0, float("nan"), 0.0, 0.0]), (400, [0.0, 0.0, 0.0, 0.0])]
    out = topk.top_k(spark.createDataFrame([(i, x, 5) for i, x in rows], "vec_id long, embedding array<float>, id int"), block=block, query_block=1)
    assert {tuple(r) for r in out.select("query_id", "rank", "vec_id", "score").collect()} == simple_top(rows)
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    few = topk.top_k(spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")).collect()
    assert [tuple(r) for r in few] == [(0, 1, 1, 1024 * 2048)]


def test_threshold_stops_early():
    v = np.zeros((5000, 2))
    v[:, 0] = np.arange(5000)
    lists = topk.SortedLists(np.arange(5000), v)
    met = []
    lists.falling = type("Counted", (np.ndarray,), {"__getitem__": lambda self, i: (met.append(i), np.ndarray.__getitem__(self, i))[1]})((5000, 2), int, np.ascontiguousarray(lists.falling))
    ids, scores = lists.search(np.array([1.0, 0.0]), 3, None)
    assert ids.tolist() == [4999, 4998, 4997] and scores.tolist() == [4999.0, 4998.0, 4997.0] and len(met) <= 2


def test_pipeline_stages_against_operators_alone(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept, columns = docs, docs.columns
    from tests.llm.test_similar import least_reachable, simple_fingerprint, simple_lines

    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in kept.collect()}
        kept = spark.createDataFrame(stage(spark, kept, SMALL).collect(), stage(spark, kept.limit(0), SMALL).schema)
        if name == "packing":
            assert {r.doc_id for r in kept.collect()} == set(before)
            break
        assert kept.columns == columns
        after = {r.doc_id: r.text for r in kept.collect()}
        if name == "language":
            assert set(after) == {k for k, t in before.items() if any(c.isalpha() for c in t)}
        if name == "line_dedup":
            assert after == simple_lines(before.items())
            assert all(r.n_chars == len(r.text) for r in kept.collect())
        if name == "simhash":
            prints = {k: simple_fingerprint(t) for k, t in before.items()}
            near = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
            root = least_reachable(prints, near)
            assert set(after) == set(root.values())


def test_pipeline_edges(spark):
    rows = [(1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, "the words of a line here", "en", "s", 24), (3, "the words of a line here", "en", "s", 24), (None, "some other words of a line", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        assert stage(spark, docs, SMALL).count() >= 1
    assert corpus_pipeline.simhash_stage(spark, docs, SMALL).where("doc_id = 3").count() == 1
    assert corpus_pipeline.language_stage(spark, docs, SMALL).where(F.col("text").isNull() | (F.col("text") == "")).count() == 0


def test_pipeline_without_labels_keeps_documents(spark):
    docs = spark.createDataFrame([(1, "some words of a text", None, "s", 20), (2, "12 34", None, "s", 5), (3, None, None, "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in corpus_pipeline.language_stage(spark, docs, SMALL).collect()] == [1]
    known = spark.createDataFrame([(4, "der die das und ist nicht " * 9, "de", "s", 0), (5, "the and is not of to " * 9, "en", "s", 0), (6, "the and is not of", None, "s", 0)], docs.schema)
    kept = {r.doc_id: r.lang for r in corpus_pipeline.language_stage(spark, known, SMALL).collect()}
    assert kept == {4: "de", 5: "en", 6: "en"}


def test_pipeline_restores_the_session(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    assert corpus_pipeline.run(spark, SMALL).count() > 0 and spark.conf.get(key) == was


def test_pipeline_keeps_unlike_documents_that_share_an_id_or_have_none(spark):
    words = [" ".join(f"{c}{i}" for i in range(40)) for c in "abcdef"]
    rows = [(None, words[0], "en", "x"), (None, words[1], "en", "x"), (7, words[2], "en", "x"), (7, words[3], "en", "x"), (8, words[2], "en", "x"), (9, words[4], "en", "x"), (9, words[4], "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, own string").withColumn("n_chars", F.length("text").cast("long")).withColumn("label", F.lit(1)).withColumn("gone", F.lit(2)).withColumn("key", F.lit(3))
    kept = corpus_pipeline.language_stage(spark, docs, SMALL)
    assert kept.columns == docs.columns and kept.count() == 7
    kept = corpus_pipeline.simhash_stage(spark, docs, SMALL)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == sorted([(0, words[0]), (0, words[1]), (7, words[2]), (7, words[3]), (9, words[4])])
    lines = corpus_pipeline.line_stage(spark, docs, SMALL)
    assert lines.columns == docs.columns and sorted(r.text for r in lines.collect() if r.doc_id == 8) == [""]
    assert corpus_pipeline.benchmark_stage(spark, docs, SMALL).columns == docs.columns


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e300, 2.0]), (100, [-1e300, 0.5]), (1, [1e300, 0.0]), (2, [3.0, 1e17]), (3, [0.0, float("inf")]), (4, None), (5, [1.0, None]), (6, [1e-9, -1e-9])]
    out = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=4).orderBy("query_id", "rank").collect()

    def whole(v):
        return [min(max(math.floor(Fraction(x) * 1024), -(2**63)), 2**63 - 1) for x in v]

    vectors = {k: whole(v) for k, v in rows if v and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q in (0, 100):
        scores = {k: min(max(sum(a * b for a, b in zip(v, vectors[q], strict=True)), -(2**63)), 2**63 - 1) for k, v in vectors.items() if k != q}
        want += [(q, i + 1, k, scores[k]) for i, k in enumerate(sorted(scores, key=lambda k: (-scores[k], k))[:4])]
    assert [tuple(r) for r in out] == want


def test_language_of_tables_with_clashing_columns(spark):
    rows = [(i, "the words of the line" if i % 2 else "les mots de la ligne", "en" if i % 2 else "fr", "x", "y", "z") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, own string, label string, share string")
    out = language.predict(docs, language.fit(docs))
    assert out.columns == [*docs.columns, "lang_pred", "score"]
    assert all(r.lang == r.lang_pred and r.own == "x" and r.label == "y" for r in out.collect())
    with pytest.raises(ValueError):
        language.fit(docs, max_languages=1)
