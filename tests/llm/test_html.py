import html as h
import re
import time

import pyarrow as pa

from kvartal.llm import html


def page(parts, extra=""):
    return f'<!DOCTYPE html><html><head><title>t &amp; t</title><script>var a="</p>";</script></head><body class="with-sidebar"><header>Site</header><nav><ul><li><a href="/a">Menu</a></ul></nav><div class="ad">Buy</div>{parts}{extra}<footer>&copy; x</footer></body></html>'


def text(x):
    return html.extract(x)[0]


def test_blocks():
    assert text(page("<article class='has-comments'><h1>A &amp; B</h1><p><b>Lead\n in<br><p>One<p>Two &lt;3&nbsp;x</article>")) == "A & B\nLead in\nOne\nTwo <3 x"
    assert text("plain  text") == "plain text" and text(None) == text("") == ""
    assert text("<article><p>a<script>x<y</script>b<!-- c -->d</p><p>e &am") == "abd\ne &am"
    assert text('<main><p title="a>b">one</p><form>f</form><div id="comments"><p>c</p></div><aside>s</aside></main>') == "one"
    assert text("<article><header><h1>T</h1></header><ul><li>x<li>y</ul><table><tr><td>1<td>2</table></article>") == "T\nx\ny\n1\n2"
    assert text("<article><div class='post-header'><h1>T</h1></div><div class='post-footer'>f</div>x</article>") == "T\nx"
    assert text("<p>cut <b") == "cut" and text("a < b and 1<2") == "a < b and 1<2"
    assert text("<article>" + "<p>x</p>" * 20000 + "</article>") == "\n".join(["x"] * 20000)
    assert text("<div>" * 3000 + "deep") == "deep"


def test_an_article_is_not_set_aside_by_what_is_around_it():
    story = "<article><h1>T</h1><p>one two</p></article>"
    for around in ("div class='layout with-sidebar'", "div class=has-sidebar", "form action=x", "div class='header'", "section id=sidebar", "aside", "div class='no-ads is-modal'"):
        assert text(f"<body><nav>n</nav><{around}>{story}</{around.split()[0]}><footer>f</footer>") == "T\none two", around
    assert text("<form><div class=story><p>long enough text of a page</p></div></form><p>x</p>") == "long enough text of a page\nx"
    assert text("<div class=sidebar><p>all there is</p></div><nav>n</nav>") == "all there is" and text("<nav>n</nav>") == ""


def test_names_count_whole_or_with_plain_words():
    kept = ["modal-verbs", "search-engine", "notice-period", "legal", "tags", "with-sidebar", "adventure", "headers", "shared", "post-header", "social-history", "alert-fatigue"]
    gone = ["sidebar", "sidebar-left", "site-footer", "main-menu", "comments", "comment-list", "cookie-banner", "ad", "ad1", "ad-300x250", "ad_slot", "related-posts", "share-buttons", "newsletter-box", "notice", "reader-comments"]
    assert [x for x in kept if text(f"<article><p>a</p><div class='{x}'>b</div></article>") != "a\nb"] == []
    assert [x for x in gone if text(f"<article><p>a</p><div class='x {x}'>b</div></article>") != "a"] == []


def test_comments_stay_aside_whatever_holds_them():
    long = "comment words " * 50
    assert text(f"<article><p>story</p></article><div class=comments><article><p>{long}</p></article></div>") == "story"
    assert text(f"<div class=story><p>story</p></div><ol class=comment-list><li><article class=comment-body><p>{long}</p></article></ol>") == "story"
    assert text(f"<main><p>story</p></main><div class=related-posts><article><p>{long}</p></article></div>") == "story"


def test_foreign_elements_and_quotes():
    assert text("one<svg/>two<svg><text>no</text></svg>three<math/>four") == "onetwothreefour"
    assert text("<p title=\"a>b\">one</p><p title='x\">two</p><p>three") == "one\ntwo\nthree"
    assert text("a <!-- b > c --> d <![CDATA[ e ]]> f <?php > g </ h") == "a d f g"


def test_bad_markup_takes_linear_time():
    start = time.time()
    for bad in ("<b ", "<b '", "<!-", "</", "<a b='", "< ", "<p class=x '\""):
        for tail in ('"', "'", ">", "<", ""):
            text("<p>x</p>" + bad * (300_000 // len(bad)) + tail)
    assert time.time() - start < 60


def test_template_finds_the_main_slot(spark):
    rows = []
    for i in range(12):
        body = f'<div class="top">Daily news</div><div class="box"><div class="story"><p>{"story words number " * 20}{i}</p><p>end {i}</p></div></div><div class="more"><p>Read on {i}</p></div>'
        rows.append((i, f"https://a.example/{i}", page(body), "x"))
    rows += [(100, "https://b.example/", page("<div class='z'>Only one</div>"), "x"), (101, None, None, "x"), (102, "not a url", "", "x"), (None, "https://a.example/q", page("<p>other layout</p>"), "x"), (101, None, None, "x")]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[3] == ("story words number " * 20 + "3").strip() + "\nend 3"
    assert by[100] == "Only one" and by[101] == by[102] == "" and by[None] == "other layout"
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string").limit(0)).count() == 0


SCHEMA = "page_id long, url string, html string"
PROSE = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def said(i, n=12):
    return " ".join(PROSE[(i * 7 + k * k) % 10] for k in range(n)) + f" of {'abcdefghij'[i]}"


def pages_of(spark, bodies):
    docs = [(i, f"https://c.example/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    return {r.page_id: r.text for r in html.extract_pages(spark.createDataFrame(docs, SCHEMA)).collect()}


def test_container_keeps_headlines_and_siblings(spark):
    got = pages_of(spark, [f'<div class="story"><h1>Title {i}</h1><p>{said(i, 40)}</p><p>{said(i, 30)} end</p></div>' for i in range(6)])
    assert got[2] == f"Title 2\n{said(2, 40)}\n{said(2, 30)} end"
    got = pages_of(spark, [f'<div class="story"><h1>Title {i}</h1><p>{said(i, 60)}</p></div>' for i in range(6)])
    assert got[2] == f"Title 2\n{said(2, 60)}"
    got = pages_of(spark, [f'<div class="w-1/2"><div class="lead">{said(i)}</div><div class="text"><p>{said(i, 50)}</p></div></div><div class="x"><p>Seen {i} times</p></div>' for i in range(6)])
    assert got[4] == f"{said(4)}\n{said(4, 50)}"


def test_an_advert_inside_does_not_make_two_elements(spark):
    bodies = [f'<div class="story"><p>{said(i, 30)}</p>{"<form>f</form>" if i == 1 else ""}<p>{said(i, 20)}</p></div><div class="x"><p>Seen {i} times</p></div>' for i in range(6)]
    assert pages_of(spark, bodies)[1] == f"{said(1, 30)}\n{said(1, 20)}"


def test_text_that_every_page_repeats_goes(spark):
    bodies = [f'<div class="story"><p>{said(i, 30)}</p><p>Written by our own desk</p><p>{said(i, 20)}</p></div>' for i in range(6)]
    assert pages_of(spark, bodies)[3] == f"{said(3, 30)}\n{said(3, 20)}"
    copies = [f'<div class="story"><p>{said(1, 30)}</p><p>{i}</p></div>' for i in range(6)]
    assert pages_of(spark, copies)[3] == f"{said(1, 30)}\n3"


def test_repeated_sentences_in_unnamed_elements_go(spark):
    bodies = [f'<div class="c1"><div class="c2"><p>{said(i % 10, 40)} {i}</p><div class="c7">See our other pages for more of this</div><p>{said((i + 3) % 10, 30)} {i}</p></div><div class="c9">All of it is ours since 19{i}</div></div>' for i in range(20)]
    got = pages_of(spark, bodies)
    assert all(got[i] == f"{said(i % 10, 40)} {i}\n{said((i + 3) % 10, 30)} {i}" for i in range(20))


def test_sections_of_some_pages_are_classes_of_their_own(spark):
    bodies = [f'<div class="c2"><p>{said(i % 10, 40)} {i}</p>{"<div class=c8>Only some pages say so</div>" if i % 3 else ""}<p>{said((i + 3) % 10, 30)} {i}</p></div>' for i in range(20)]
    assert all("Only some" not in x for x in pages_of(spark, bodies).values())


def brute_template(pages):
    """Tokens of text whose occurrences on all pages equal those of an element around them, by whole vectors."""
    from collections import Counter, defaultdict

    seen, around = defaultdict(Counter), {}
    for k, x in enumerate(pages):
        p = html.Page(x)
        for i in range(1, len(p.path)):
            seen["e", p.path[i]][k] += 1
        for at, t in p.blocks:
            key = "t", p.token(at, t)
            seen[key][k] += 1
            while at:
                around.setdefault(key, set()).add(p.path[at])
                at = p.parent[at]
    often = max(html.LEAST_PAGES, html.LEAST_SHARE * len(pages))
    return {key[1] for key, of in around.items() if len(seen[key]) >= often and any(seen["e", e] == seen[key] for e in of)}


def test_template_against_whole_vectors(spark):
    import random

    rng = random.Random(4)
    bodies = []
    for i in range(40):
        parts = [f"<p>{said(rng.randrange(10), rng.randint(20, 60))} {'abcdefgh'[i % 8] * (i + 1)}</p>" for _ in range(4)]
        for k in range(5):
            if rng.random() < 0.3 + 0.2 * k:
                parts.insert(rng.randint(0, len(parts)), f'<div class="b{k}"><b>Note</b> number {k} {"s" * k}</div>' if rng.random() < 0.9 or k < 3 else f'<div class="b{k}">x</div>')
        bodies.append(f'<html><body><div class="top">one and the same</div><div class="m">{"".join(parts)}</div></body></html>')
    got = pages_of(spark, [b[12:-14] for b in bodies])
    template = brute_template(bodies)
    assert template
    for i, b in enumerate(bodies):
        p = html.Page(b)
        inside = p.within(lambda k, p=p: p.tag[k] == "div" and p.depth[k] == 3)
        assert got[i] == "\n".join(t for at, t in p.blocks if p.token(at, t) not in template and inside[at]), i


def test_deep_and_unclosed_pages_take_linear_time():
    start = time.time()
    assert text("<div class=a>x" * 100_000).count("x") == 100_000 and text("<p>" + "<b>" * 50_000 + "y</i></i>" * 50_000).count("y") == 50_000
    assert len(list(html._occurrences([pa.record_batch({"host": [1], "key": [2], "html": ["<div>x" * 50_000]})])))
    assert time.time() - start < 30


def test_query(spark, sf_dir):
    from kvartal.llm.queries import queries

    src = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    for r in queries()["op2_html"](spark, sf_dir).collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", src[r.page_id].html, re.S).group(1)
        parts = [re.sub(r"\s+", " ", h.unescape(re.sub(r"<br>|<[^>]*>", "", x))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(x for x in parts if x) and r.n_chars == len(r.text)
