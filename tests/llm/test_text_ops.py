import html
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, quality, tokens, urls
from tidemark.llm import html as pages_html

DATA = "/root/testdata/sf0.001"


def test_token_counts_agree_with_the_library(spark):
    tokenizer = tokens.encoder(tokens.tokenizer_content())
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.op7_token_counts(spark, DATA).collect()}
    n = {i: len(tokenizer.encode(t, add_special_tokens=False).ids) for i, t in docs.items()}
    assert got == {i: (len(t.encode()), n[i], n[i] > 2048) for i, t in docs.items()}


def test_splices_and_words_give_the_library_s_tokens():
    tokenizer = tokens.encoder(tokens.tokenizer_content())
    rnd = random.Random(5)
    parts = ["ab", "É", "é", " ", "\n", "́", "\xa0", "\x1c", "\x85", "'s", "'", "ﬁ", "Σ", "<|endoftext|>", "<|", "　", "９", "½", "\x0b", "İ"]
    texts = ["".join(rnd.choice(parts) for _ in range(1500)) for _ in range(15)]
    texts += ["a" * 4000, "word " * 900 + "b" * 4000 + " tail" * 300, "", "<|endoftext|>" * 300, "  \n\t " * 900]
    for text in texts:
        e = tokenizer.encode(text, add_special_tokens=False)
        want = [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets, strict=True)]
        for chunk, overlap in ((700, 64), (257, 16)):
            assert [tuple(x) for p in tokens.tokens_of(tokenizer, text, chunk, overlap) for x in p.tolist()] == want
        assert tokens.counts_by_word(tokenizer, [text.encode()], {}) == [len(want)]


def test_token_count_edges(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "one  two", "c"), (3, "one  two", "c")], "doc_id long, text string, n_tokens string")
    got = sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in tokens.count_tokens(df, tokens.tokenizer_content()).collect())
    assert got == [(1, 0, 0), (2, 0, 0), (3, 8, 2), (3, 8, 2)]
    assert tokens.count_tokens(df.limit(0), tokens.tokenizer_content()).count() == 0


def brute_contamination(text, items, window=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, ids = cut(text), set(), set()
    for i, t in items:
        b = cut(t)
        n = min(window, len(b))
        grams = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in grams:
                hit |= set(range(k, k + n))
                ids.add(str(i))
    return len(w), len(hit), sorted(ids)


@pytest.mark.parametrize("bits", [1 << 25, 64])
def test_decontamination_agrees_with_brute_force(spark, bits):
    rnd = random.Random(2)
    vocabulary = ["a", "B", "c1", "dé", "e", "f"]
    say = lambda n: " ".join(rnd.choice(vocabulary) + rnd.choice(["", ".", "\n", " "]) for _ in range(n))
    items = [(i, say(rnd.randint(11, 30))) for i in range(30)] + [(100, "one two"), (101, None), (102, "..."), (103, "solo")]
    docs = [(i, say(40) + " " + rnd.choice(items)[1] if i % 3 else say(60)) if items else None for i in range(0)]
    for i in range(120):
        inner = rnd.choice([t for _, t in items if t])
        docs.append((i, f"{say(25)} {inner} {say(5)}" if i % 2 else say(60)))
    docs += [(500, None), (501, ""), (502, "x one TWO y"), (502, "x one TWO y"), (None, "Solo")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("spans", F.lit(1))
    found = decontaminate.decontaminate(df, spark.createDataFrame(items, "item_id long, text string"), most_bits=bits).collect()
    got = sorted(((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), list(r["items"])) for r in found), key=str)
    assert got == sorted(((i, *brute_contamination(t, items)) for i, t in docs), key=str)


def test_decontamination_of_nothing(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).first()["n_words"] == 2
    assert decontaminate.decontaminate(docs.limit(0), none).count() == 0


def test_quality_edges(spark):
    words = " ".join(f"word{i}" for i in range(30)) + "."
    rows = [
        (1, None), (2, ""), (3, words), (3, words), (4, words + "\n" + " | ".join(f"menu{i}" for i in range(40))), (5, "a b c d e " * 20),
        (6, "\n".join([words, "", words, " \t "])), (7, words + "\nAll rights reserved."), (8, words.replace("w", "#$%w")),
    ]
    got = {r.doc_id: r for r in quality.clean(spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("x"))).collect()}
    assert (got[1].n_words, got[1].base_failed, got[1].kept) == (0, True, False)
    assert got[3].kept and got[3].n_lines_removed == 0 and got[3].clean_text == words
    assert not got[4].kept and not got[4].base_failed and got[4].clean_text == words
    assert got[5].base_failed and got[5].n_repeat_words == 100
    assert got[6].n_dup_lines == 1 and got[6].n_repeat_words == 60
    assert got[7].kept and got[7].clean_text == words
    assert not got[8].kept
    assert quality.clean(spark.createDataFrame([], "doc_id long, text string")).filter("kept").count() == 0


def test_quality_lines_of_scripts_without_spaces(spark):
    """Lines of Han, kana or Thai without spaces are no menu entries for it; short ones are. The SQL has the same verdicts."""
    words = " ".join(f"word{i}" for i in range(30)) + "."
    han, thai = "春眠不觉晓处处闻啼鸟" * 12, "สวัสดีชาวโลก" * 12
    rows = [(1, f"{words}\n{han}"), (2, f"{words}\n{thai}"), (3, f"{words}\n首页"), (4, f"{words}\n{'x' * 150}"), (5, f"{words}\nメニュー 検索")]
    got = {r.doc_id: (r.kept, r.n_lines_removed) for r in quality.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (True, 0), 2: (True, 0), 3: (True, 1), 4: (False, 1), 5: (True, 1)}
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    found = con.execute(f"select doc_id, kept from ({quality.OP5_SQL})").fetchall()
    assert dict(found) == {k: v[0] for k, v in got.items()}


def brute_article(page):
    inside = page.split("<article>", 1)[1].split("</article>")[0]
    parts = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", q.replace("<br>", " "))).split()) for q in re.split(r"</?(?:p|h1)>", inside))
    return "\n".join(x for x in parts if x)


def test_html_query_agrees_with_the_template(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = {r.page_id: (r.text, r.n_chars) for r in pages_html.op10_html_extraction(spark, DATA).collect()}
    assert got == {i: (brute_article(p), len(brute_article(p))) for i, p in pages.items()}


def test_html_other_templates(spark):
    head = "<html><head><title>t</title><script>var a='<p>no</p>';</script></head><body><header>Site</header><nav><a>x</a></nav>"
    rows = [
        (1, "http://a.x/1", head + "<main><h1>Title &amp; more</h1><p>One\n two<p>Three <b>b</b>old<ul><li>i<li>j</ul><aside>side</aside>"
            "<form><input>name</form><section class='comments'><p>reader</p></section></main><footer>f</footer>"),
        (2, "http://b.x/1", head + "<div class='sidebar'>s</div><div class='post-content'><p>Text.</p><div class='cookie-notice'>n</div></div></body></html>"),
        (3, "http://c.x/1", head + "<table><tr><td>cell one<td>cell two</table><!-- c --></body>"),
        (4, "http://c.x/2", None), (5, None, ""), (6, "http://a.x/2", "<p>no article here</p>"), (6, "http://a.x/2", "<p>no article here</p>"),
    ]
    got = {r.page_id: r.text for r in pages_html.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))).collect()}
    assert got == {1: "Title & more\nOne two\nThree bold\ni\nj", 2: "Text.", 3: "cell one\ncell two", 4: "", 5: "", 6: "no article here"}
    assert pages_html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_odd_markup():
    read = pages_html.main_text
    assert read("<ARTICLE><P>a &lt; b < c<BR/>d<svg><title>x</title><text>no</text></svg>e") == "a < b < c de"
    assert read("<article><svg/>one<a title=\"x>two</a> three") == "onetwo three"
    assert read("<article><p>cut <b>of") == "cut of"
    assert read("<article>x<!-- <p>no</p>") == "x"
    assert read("<article><header><h1>Title</h1></header><div class='ad banner'>no</div>\n yes\t it is</article></ar") == "Title\nyes it is"
    assert read("") == "" and read("plain &amp text") == "plain & text"


def wrapper_of(*pages):
    made = pages_html.Wrapper()
    for p in pages:
        made.align(list(pages_html.walked(p)))
    return made


def test_wrapper_folds_repeats_and_marks_optional_parts():
    a, b = "<article><p>x</p><p>y</p></article>", "<article><h2>t</h2><p>x</p></article>"
    assert wrapper_of(a, b).root.written() == "(article=main(h2(#)? p(#)+))"
    merged = wrapper_of(a)
    merged.merge(wrapper_of(b))
    assert merged.root.written() == "(article=main(h2(#)? p(#)+))"
    again = wrapper_of("<div><h2>a</h2><p>b</p><h2>c</h2><ul><li>d</ul><p>e</p></div>")
    assert again.root.written() == "(div((h2(#) p(#) ul(li(#)))+))"
    assert pages_html.Wrapper.read(again.packed()).root.written() == again.root.written()


def test_html_keeps_articles_under_telling_names():
    read = pages_html.main_text
    for page in (
        '<body class="no-sidebar"><article><p>good text</p></article>', '<html class="has-cookie-banner"><body><article>good text</article>',
        '<div class="content social"><article><p>good text</p></article></div>', "<body><form><p>good text</p></form></body>",
        '<article><p>good text</p></article><article class="teaser"><p>more</p></article>', "<aside><article>see too</article></aside><div><p>good text</p></div>",
    ):
        assert read(page) == "good text", page


def test_html_of_very_deep_and_very_odd_pages():
    read = pages_html.main_text
    for page in (
        "<div>" * 5_000 + "<p>good text</p>", "<b>" * 60_000 + "good text" + "</i>" * 60_000, "<article>" + "<font>" * 30_000 + "<p>good</p><p>text</p>",
        "<div><b>" * 3_000 + "good text" + "</b></div>" * 3_000 + "</p>" * 9,
    ):
        assert read(page).split() == ["good", "text"]
        made = wrapper_of(page)
        made.merge(wrapper_of(page))
        assert pages_html.main_text(page, pages_html.reading(pages_html.Wrapper.read(made.packed()))).split() == ["good", "text"]


def test_html_templates_without_telling_names(spark):
    """Hosts of their own templates, hashed class names, notices and adverts in plain elements: only the wrapper tells."""
    rnd = random.Random(3)
    say = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))

    def page(kind, paragraphs):
        menu = "".join(f'<a href="/{x}">{x}</a> ' for x in ("one", "two", "three", "four"))
        text = "".join(f"<p>{p}</p>" for p in paragraphs)
        if kind == 0:
            return f'<body><div class="x1a">{menu}</div><div class="k7">{text}</div><div class="z3">We use small files to know you.</div></body>'
        if kind == 1:
            return f"<table><tr><td>{menu}</td><td>{text}<p>Buy our new phone today, it is cheap.</p></td></tr></table>"
        return f'<div id="wrap"><section class="q"><h2>{paragraphs[0]}</h2>{text}</section><p>All the rights are ours.</p></div>'

    rows, want = [], {}
    for k in range(60):
        kind = k % 3
        paragraphs = [say(rnd.randint(5, 30)) for _ in range(rnd.randint(1, 6))]
        rows.append((k, f"http://h{kind}.x/{k}", page(kind, paragraphs)))
        want[k] = "\n".join(paragraphs[:1] * (kind == 2) + paragraphs)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.text for r in pages_html.extract(pages).collect()} == want
    alone = {k: pages_html.main_text(html_of) for k, _, html_of in rows}
    assert any(alone[k] != want[k] for k in want)  # without the host's wrapper the notices stay


def brute_rank(seeds, edges, damping=0.85, rounds=200):
    nodes = set(seeds) | {x for e in edges for x in e}
    total = sum(seeds.values())
    v = {n: seeds.get(n, 0) / total for n in nodes}
    out = {n: [b for a, b in edges if a == n] for n in nodes}
    p = dict(v)
    for _ in range(rounds):
        lost = sum(p[n] for n in nodes if not out[n])
        new = {n: (1 - damping + damping * lost) * v[n] for n in nodes}
        for n in nodes:
            for m in out[n]:
                new[m] += damping * p[n] / len(out[n])
        p = new
    return p


def test_pagerank_agrees_with_brute_force(spark):
    rnd = random.Random(4)
    names = [f"h{i}" for i in range(12)]
    edges = sorted({(rnd.choice(names), rnd.choice(names)) for _ in range(25)})
    seeds = {"h0": 3, "h5": 1}
    got = urls.pagerank(
        spark.createDataFrame([(h, seeds.get(h, 0)) for h in names], "host string, seed long"), spark.createDataFrame(edges, "src string, dst string"), damping=0.5, tolerance=1e-4
    )
    want = brute_rank(seeds, edges, 0.5)
    ranks = {r["host"]: r["rank"] for r in got.collect()}
    assert all(abs(ranks.get(h, 0) - want[h]) < 1e-3 for h in want)


def test_url_rules_and_propagation(spark):
    link = lambda h: f"<a href='https://{h}/x'>l</a>"
    rows = [
        (1, "http://A.Example.org/es/1?q", ""), (2, "http://example.org/en/12#x", ""), (3, "https://www.good.org/", link("ok.net")), (4, "x.com/de/", None),
        (5, "http://bad.com/de/1", ""), (6, "http://bad.com/de/2", ""), (7, "http://farm.net/en/", link("bad.com")), (8, "http://ok.net/a", ""),
        (9, None, None), (10, "http://example.org.net/es/", ""), (10, "http://example.org.net/es/", ""), (11, "http://other.net/", ""),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("verdict", F.lit(0))
    got = {r.page_id: (r["host"], r.path, r.rule, r.verdict) for r in urls.judge(df).collect()}
    assert got[1] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert got[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[3] == ("www.good.org", "/", "org/", "allow")
    assert got[4] == ("", "", None, "allow") and got[9] == ("", "", None, "allow")
    assert got[5][2:] == ("com/de/", "block")
    assert got[7][2:] == (None, "block"), "a host that links to a blocked one and that no trusted one links to"
    assert got[8][2:] == (None, "allow")
    assert got[10][2:] == (None, "allow") and got[11][2:] == (None, "allow")
    assert urls.judge(df.limit(0)).count() == 0


def test_hosts_are_seeds_by_their_ruled_urls(spark):
    paths = ["/de/1", "/de/2", "/fr/1", *(f"/x/{k}" for k in range(9))]
    rows = [(k, f"http://mixed.com{p}", "") for k, p in enumerate(paths)] + [(50, "http://even.com/de/", ""), (51, "http://even.com/fr/", ""), (52, "http://even.com/x", "")]
    got = {r.page_id: r.verdict for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[k] for k in range(12)] == ["block", "block", "allow", *["block"] * 9]
    assert got[52] == "allow"


def test_pagerank_settles_or_raises(spark):
    seeds = spark.createDataFrame([("a", 1)], "host string, seed long")
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "src string, dst string")
    with pytest.raises(RuntimeError):
        urls.pagerank(seeds, edges, max_rounds=3)


def test_op6_agrees_with_brute_force_on_a_linked_graph(spark, tmp_path):
    """The whole query with its own parameters: a ring of 81 hosts, branches, both kinds of seeds, a host of no url."""
    ring = [f"h{k}.example.net" for k in range(81)]
    a, b = "good.example.org", "bad.example.com"
    links = {h: [ring[(k + 1) % 81]] for k, h in enumerate(ring)}
    links[a] = [ring[0], b]
    links[b] = [a]
    links[ring[40]] = [ring[41], b]
    links["lonely.example.net"] = [b]
    links["far.example.net"] = ["only-linked.example.net"]
    rows = [(k, f"https://{h}/x", "".join(f'<a class="l" href="//{x}/">y</a>' for x in to)) for k, (h, to) in enumerate(links.items())]
    rows += [(1000 + k, f"https://{a}/en/2{k}", None) for k in range(5)] + [(2000 + k, f"https://{b}/de/{k}", "") for k in range(3)]
    rows += [(3000, None, "<a href='//h1.example.net/'>"), (3001, "no host", None), (3001, "no host", None), (3002, "x://only-linked.example.net?q", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["host"], r["verdict"]) for r in urls.op6_url_filters(spark, str(tmp_path)).collect()}
    out = [(h, t) for h, to in links.items() for t in to]
    trust = brute_rank({a: 6}, out, 0.85, 400)  # a's urls that a rule fits: /x and five more
    distrust = brute_rank({b: 3}, [(t, h) for h, t in out], 0.85, 400)
    assert len(trust) >= 81
    for k, h in enumerate(links):
        if h not in (a, b):
            want = "block" if 3 * distrust.get(h, 0) > 6 * trust.get(h, 0) else "allow"
            assert got[k] == (h, want), (h, trust.get(h), distrust.get(h))
    assert got[3000] == ("", "allow") and got[3001] == ("", "allow") and got[3002] == ("only-linked.example.net", "allow")
    assert any(v == "block" for h, v in got.values() if h not in (a, b))
    ranks = urls.pagerank(spark.createDataFrame([(ring[0], 1)], "host string, seed long"), spark.createDataFrame([(ring[k], ring[(k + 1) % 81]) for k in range(81)], "src string, dst string"))
    assert ranks.count() == 81
