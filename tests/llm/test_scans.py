"""Secret scan, trigram queries, language identification and HTML extraction."""

import hashlib
import itertools
import random
import re

import pandas as pd
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_rows import SF_DIR, no_docs, odd_docs, odd_rows  # noqa: F401
from pyspark.sql import functions as F

from blockloom.llm import language_id
from blockloom.llm.html_extract import Weights, extract_pages, label_blocks, main_text
from blockloom.llm.min_cut import Cut
from blockloom.llm.page_blocks import blocks_of
from blockloom.llm.queries import QUERIES
from blockloom.llm.secret_scan import BASE_RULES, RULES, redacted, scan_report, secret_spans
from blockloom.llm.trigram_query import clauses, conjunction, matches_somewhere


def spans_brute(text):
    found = []
    for order, rule in enumerate(RULES):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), order, m.end(), rule.kind))
    return sorted(found)


def report_brute(doc_id, text):
    found = spans_brute(text)
    base = [s for s in found if s[1] < len(BASE_RULES)]
    write = lambda spans: ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)
    counts = [sum(s[1] == k for s in base) for k in range(3)]
    return (doc_id, *counts, hashlib.sha256(write(base).encode()).hexdigest(), write(found))


SECRETS = [
    (900, "é😀 TOKEN = 'abcdef12' AKIA" + "A" * 16 + " " + "a1" * 30 + " x password:12345"),
    (901, ("ab12" * 7 + " ") * 1200),
    (901, 'api_key"=zzzzzz apikey: "yyyyyyy Secret:\x20\x20=nope'),
    (902, "passwd=abcdefg secret:abcdefgh-----BEGIN RSA PRIVATE KEY-----ghp_" + "a1" * 20),
    (None, "Password:longenough AKIAAKIA" + "B" * 20),
    (903, "tokentoken=aaaaaaa" + "f" * 50),
]


def test_scan_equals_regular_expressions(spark, odd_docs, odd_rows):
    more = spark.createDataFrame(SECRETS, "doc_id long, text string")
    docs = odd_docs.select("doc_id", "text").unionByName(more)
    rows = [r[:2] for r in odd_rows] + SECRETS
    assert sorted(str(tuple(r)) for r in scan_report(docs).collect()) == sorted(str(report_brute(*r)) for r in rows)


def test_scan_query_equals_regular_expressions(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(str(tuple(r)) for r in QUERIES["op7_secret_scan"](spark, SF_DIR).collect())
    assert got == sorted(str(report_brute(*r)) for r in rows)


def test_redaction_replaces_merged_spans(spark):
    rows = redacted(spark.createDataFrame(SECRETS, "doc_id long, text string")).collect()
    for row, (_, text) in zip(rows, SECRETS):
        out, end = "", 0
        for a, _, b, _ in spans_brute(text):
            if a > end or not out and a == 0:
                out += text[end:a] + "[SECRET]"
            elif not out:
                out += "[SECRET]"
            end = max(end, b)
        assert row.text == out + text[end:]
    clean = spark.createDataFrame([(1, None), (2, ""), (3, "nothing here")], "doc_id long, text string")
    assert sorted(str(r.text) for r in redacted(clean).collect()) == ["", "None", "nothing here"]


def test_scan_keeps_columns_and_empty_tables(odd_docs, no_docs):
    assert set(secret_spans(odd_docs).columns) == set(odd_docs.columns)
    assert scan_report(no_docs).count() == 0


def test_columns_of_the_names_used_inside_stay(odd_docs):
    docs = odd_docs.withColumns({"_admitted": F.lit(1), "_kinds": F.lit("k"), "spans": F.lit("mine")})
    clean = redacted(docs)
    assert clean.columns == docs.columns and clean.filter("spans = 'mine' AND _admitted = 1 AND _kinds = 'k'").count() == odd_docs.count()
    assert secret_spans(docs, to="found").columns == [*docs.columns, "found"]


def test_all_mandatory_stretches_are_asked_for():
    private = conjunction(r"-----BEGIN [A-Z ]*PRIVATE KEY-----")
    assert len(private) == 2 and {"beg"} < {g for clause in private[0] for g in clause} and {"key"} < {g for clause in private[1] for g in clause}
    assert not matches_somewhere("abc.*def", "abc x") and matches_somewhere("abc.*def", "abc def") and matches_somewhere("abc.*def", "def abc")
    assert conjunction("[0-9a-f]+") == [] and conjunction("abc.*abcd") == [[frozenset({"abc", "bcd"})]]


def test_rules_have_queries():
    assert clauses(RULES[2].pattern) is None
    assert all(clauses(rule.pattern) for rule in RULES if rule.kind != "hex")
    assert clauses("a.*bcd+e") in (None, [frozenset({"bcd"})])


PATTERNS = ["abc(d|e)f?", "(?i:token|pass)=x+", "a{3}b", "(ab|cd)+ef", "x?yza[bc]d", "[ab][cd]efg|hijk", "^abc$", "q(rst)*uvw"]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(PATTERNS), st.text(alphabet="abcdefghijkTOKENpas=xyzqrstuvw", max_size=30))
def test_query_admits_every_match(pattern, text):
    if re.search(pattern, text):
        assert matches_somewhere(pattern, text)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = language_id.learn_from_documents(docs)
    found = language_id.identify(docs.select("doc_id", "text", "lang"), known).filter(language_id.held_out()).toPandas()
    assert set(known) == {"en", "de", "fr", "es"}
    assert (found["lang"] == found["lang_pred"]).mean() > 0.97
    assert found["lang_rejected"].mean() < 0.03
    assert found["score"].between(0, 1).all()


def test_predictions_equal_plain_compression(spark):
    """Every text by one plain call per language and block of letters."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    known = language_id.learn_from_documents(docs)
    got = {r.doc_id: (r.lang_pred, r.score, r.lang_rejected) for r in QUERIES["op2_language_id"](spark, SF_DIR).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for row in rows:
        letters = " ".join(re.findall(r"[^\W\d_]+", (row.text or "").lower())).encode()
        if not letters:
            assert got[row.doc_id] == ("und", 0.0, True)
            continue
        sizes = []
        for lang, content in known.items():
            raw = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            blocks = [letters[at : at + 4096] for at in range(0, len(letters), 4096)]
            plain = [zstandard.ZstdCompressor(level=3, dict_data=raw, write_content_size=False, write_dict_id=False).compress(b) for b in blocks]
            sizes.append((sum(map(len, plain)), lang))
        (best, lang), (second, _), *_ = sorted(sizes)
        pred, score, rejected = got[row.doc_id]
        assert (pred, rejected) == (lang, score < 0.004) and abs(score - (second - best) / second) < 1e-12


def test_language_ignores_labels_of_what_it_predicts(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "lang")
    blind = docs.selectExpr("doc_id", "text", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 3 = 1 THEN 'xx' ELSE lang END AS lang")
    assert language_id.learn_from_documents(docs) == language_id.learn_from_documents(blind)


def test_language_of_only_long_or_short_texts_and_of_many_copies(spark):
    def texts(letters, count, size):
        rng = random.Random(letters)
        stock = ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(60)]
        return [" ".join(rng.choice(stock) for _ in range(size)) for _ in range(count)]

    copied = texts("moprst", 40, 60)
    labelled = [("long", t) for t in texts("abcde", 6, 3000)] + [("short", t) for t in texts("fghij", 30, 3)]
    labelled += [("copied", t) for t in [copied[0]] * 2000 + copied]
    rows = [(k, t, lang) for k, (lang, t) in enumerate(labelled)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    known = language_id.learn_dictionaries(docs)
    assert set(known) == {"long", "short", "copied"}
    assert len(known["copied"]) > 0.8 * len(" ".join(copied))  # some may be left out as mislabelled
    assert 6 * 4000 < len(known["long"]) <= 6 * 4097
    found = language_id.identify(docs, known).filter("lang <> 'copied'").collect()
    right = [r.lang for r in found if r.lang_pred == r.lang]
    assert right.count("long") == 6 and right.count("short") > 20


def test_language_of_odd_rows(spark, odd_docs, no_docs, odd_rows):
    known = {"en": b"the of and that with from this " * 20, "de": b"der die und nicht ein eine das " * 20}
    found = language_id.identify(odd_docs, known)
    assert found.columns == [c for c in odd_docs.columns if c != "score"] + ["lang_pred", "score", "lang_rejected"]
    rows = found.collect()
    assert len(rows) == len(odd_rows)
    for row in rows:
        letters = any(c.isalpha() for c in row.text or "")
        assert (row.lang_pred == "und") == (not letters) and (letters or row.lang_rejected and row.score == 0)
    assert language_id.identify(no_docs, known).count() == 0
    assert language_id.learn_dictionaries(no_docs) == {}
    assert {r.lang_pred for r in language_id.identify(odd_docs, {}).collect()} == {"und"}


def test_minimum_cut_equals_all_labellings():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(1, 7)
        ends = [(rng.randint(0, 9), rng.randint(0, 9)) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.randint(0, 5)) for _ in range(n)]
        graph = Cut(n)
        for i, (one, two) in enumerate(ends):
            graph.terminals(i, one, two)
        for a, b, room in edges:
            graph.edge(a, b, room, room)

        def cost(labels):
            flat = sum(two if label else one for label, (one, two) in zip(labels, ends))
            return flat + sum(room for a, b, room in edges if labels[a] != labels[b])

        assert cost(graph.source_side()) == min(map(cost, itertools.product((False, True), repeat=n)))


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body>
<header class="top"><h1>Site name</h1><p>Slogan of our site here</p></header>
<div id="cookie-notice"><p>We use cookies to make this site work better for you and all others.</p></div>
<div class="sidebar"><p>Long sidebar text that has many words and goes on for quite some time without end.</p></div>
<div id="content"><h2>A story</h2><p>First para<b>graph</b> with <a href=x>a link</a> and more&nbsp;words
to read.</p><p>Short.</p><div class="advert"><p>Buy this now, it is cheap and very good for everyone.</p></div>
<p>Second &lt;tag&gt; with several more of them.<p>Unclosed<br>line<ul><li>One item of the list</li><li>Two</ul></div>
<form><p>Subscribe to us please and get all of the news first</p></form>
<section id="comments"><article class="comment"><p>I liked this story, thank you for it.</p></article></section>
<footer>Copyright us and nobody else in the world</footer></body></html>"""


def test_main_text_of_a_page():
    text, _, _ = main_text(PAGE)
    assert text == (
        "A story First paragraph with a link and more words to read. Short. Second <tag> with several more of them."
        " Unclosed line One item of the list Two"
    )


def test_main_text_in_page_wrappers():
    long_page = PAGE.replace("<p>Short.</p>", "<p>" + "A long paragraph of the story. " * 20 + "</p>")
    want, _, _ = main_text(long_page)
    assert len(want.split()) > 120
    for wrapper in (
        '<div class="site no-sidebar">', '<div id="content" class="has-widgets">', '<section id="legal">', '<div class="share layout">',
        "<form>", '<div id="top">', '<div class="widgets"><form class="promo">',
    ):
        tag = re.findall(r"<(\w+)", wrapper)
        ends = "".join(f"</{t}>" for t in reversed(tag))
        page = long_page.replace("<form>", "<div class=subscribe>").replace("</form>", "</div>")
        around = page.replace("<body>", "<body>" + wrapper).replace("</body>", ends + "</body>")
        inner = page.replace('<div id="content">', wrapper + '<div id="content">').replace("<li>Two</ul></div>", "<li>Two</ul></div>" + ends)
        article = inner.replace('<div id="content">', "<article>").replace("<li>Two</ul></div>", "<li>Two</ul></article>")
        for html in (around, inner, article, article.replace("article>", "main>")):
            assert main_text(html)[0] == want, (wrapper, html)


def test_a_long_discussion_stays_apart():
    said = "<article><p>" + "I do not think so at all. " * 60 + "</p></article>"
    page = "<body><article><p>" + "The story goes on and on. " * 30 + "</p></article><section id=comments>" + said + "</section></body>"
    assert main_text(page)[0] == ("The story goes on and on. " * 30).strip()


def given_pages(spark, folder):
    import html as references

    for html in (r.html for r in spark.read.parquet(f"{folder}/pages.parquet").select("html").collect()):
        article = re.search(r"<article>(.*)</article>", html, re.S)[1]
        parts = [re.sub(r"</?b>", "", part) for part in re.split(r"</?(?:p|h1|br)>", article)]
        yield html, " ".join(filter(None, (" ".join(references.unescape(part).split()) for part in parts)))


def test_pages_whose_names_and_article_say_nothing(spark):
    """Given pages without telling names and tags: an advert and readers' comments are still left out."""
    nameless = {"<article>": '<div class="q1">', "</article>": '</div><div class="zz9"><p>I liked this story, thank you.</p><p>Me too!</p></div>'}
    nameless |= {'class="ad"': 'class="x1a"'}
    wrong, large = 0, 0
    for html, want in given_pages(spark, SF_DIR):
        for old, new in nameless.items():
            html = html.replace(old, new)
        if len(want.split()) >= 80:
            large += 1
            wrong += main_text(html)[0] != want
    assert large > 20 and wrong == 0


def test_the_cut_decides(spark):
    """Short paragraphs are content through their neighbours, not by their own odds."""
    changed = total = alone_wrong = wrong = 0
    for html, want in given_pages(spark, "/root/testdata/sf0.01"):
        blocks = blocks_of(html)
        texts = [" ".join("".join(block.text).split()) for block in blocks]
        labels, alone = label_blocks(blocks, texts, Weights())
        changed += sum(a != b for a, b in zip(labels, alone))
        total += len(labels)
        wrong += " ".join(t for t, content in zip(texts, labels) if content and t) != want
        alone_wrong += " ".join(t for t, content in zip(texts, alone) if content and t) != want
    assert wrong == 0 and alone_wrong > 10 and 0.005 < changed / total < 0.1
    apart = "<body><div><p>" + "A paragraph of the story that goes on. " * 9 + "</p><p>Yes.</p><p>" + "And on and on. " * 12
    text = main_text(apart + "</p></div><div><p>Yes.</p></div><div><p>Buy now.</p></div></body>")[0]
    assert text.count("Yes.") == 1 and "Buy" not in text


def test_main_text_of_odd_pages(spark):
    odd = [None, "", "<", "<p>a<p>b<script>x</script", "<" * 500, "plain words only", "<div>" * 2000 + "deep words"]
    assert [main_text(html)[0] for html in odd] == ["", "", "<", "a b", "<" * 500, "plain words only", "deep words"]
    schema = "page_id long, url string, html string, text string, n_blocks string"
    pages = spark.createDataFrame([(k, None, html, "old", "old") for k, html in enumerate(odd)] + [(0, "u", None, "", "")], schema)
    clashing = extract_pages(pages.withColumn("_extracted", F.lit(7)))
    assert clashing.filter("_extracted = 7").count() == len(odd) + 1
    rows = extract_pages(pages).collect()
    assert len(rows) == len(odd) + 1 and all(r.n_chars == len(r.text) for r in rows)
    assert extract_pages(pages.limit(0)).count() == 0


def test_pages_of_the_table(spark):
    import html as references

    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet").toPandas()
    got = QUERIES["op8_html_extraction"](spark, SF_DIR).toPandas().set_index("page_id")
    for page in pages.itertuples():
        article = re.search(r"<article>(.*)</article>", page.html, re.S)[1]
        parts = [re.sub(r"</?b>", "", part) for part in re.split(r"</?(?:p|h1|br)>", article)]
        want = " ".join(filter(None, (" ".join(references.unescape(part).split()) for part in parts)))
        assert got.loc[page.page_id, "text"] == want
    assert not pd.isna(got["text"]).any()
