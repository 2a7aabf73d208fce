"""HTML extraction: wrappers of a host, and the main text they give."""

import random
import re
import time

from lexspark.llm import wrappers as W


def page(title, paragraphs, nav=3, ad="buy now", extra="", comments=""):
    links = "".join(f'<li><a href="/{i}">link {title} {i}</a></li>' for i in range(nav))
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul>{links}</ul></nav>"
        f'<!-- c --><div class="ad">{ad}</div><article><h1>{title}</h1>{body}{extra}</article>{comments}<footer>&copy; site</footer></body></html>'
    )


def wrapper(pages):
    held = W.fold(W.tree(pages[0]))
    for p in pages[1:]:
        held = W.merge(held, W.fold(W.tree(p)))
    return held


def text(pages, one):
    blocks = []
    W.read(W.decide(wrapper(pages), len(pages)), W.tree(one), blocks)
    return "\n".join(blocks)


def find(item, label):
    if item[0] == label:
        return item
    return next((f for x in (item[3] if item[0] != "#" else []) if (f := find(x, label))), None)


def test_mismatches_become_slots_optionals_and_groups():
    held = wrapper([page("A", ["one"]), page("B", ["two", "three"], nav=5), page("C", ["four"], extra="<ul><li>x</li></ul>")])
    assert find(held, "h1")[3][0][3][0] is None  # a slot
    assert find(held, "p")[2] and find(held, "li")[2]  # repeated
    assert find(find(held, "article"), "ul")[1] == 0  # optional
    assert find(held, "footer")[3][0][3][0] == "&copy; site"  # constant


def test_sequences_become_groups():
    held = wrapper(["<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl>", "<dl><dt>e</dt><dd>f</dd></dl>"])
    group = find(held, "dl")[3]
    assert [g[0] for g in group] == ["(dt|dd)"] and group[0][2]
    assert text(["<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl>"], "<dl><dt>a</dt><dd>b</dd><dt>c</dt><dd>d</dd></dl>") == "a\nb\nc\nd"


def test_main_text():
    pages = [page(f"T{i}", [f"Some &amp; text {i}.", f"x\n  y\t{i}"]) for i in range(4)]
    assert text(pages, pages[2]) == "T2\nSome & text 2.\nx y 2"


def test_unclosed_and_inline_tags():
    odd = page("T", []).replace("</h1>", "</h1><p><b>Bold <i>start</i>.<br><p>next &lt;b&gt; &#233;</p><p> </p>")
    assert text([odd], odd) == "T\nBold start .\nnext <b> é".replace(" .", ".")
    cut = page("T", ["whole"]).split("<footer>")[0]
    assert text([page("T", ["whole"]), cut], cut) == "T\nwhole"


def test_comments_forms_and_asides_are_out():
    more = '<div class="comments"><p>reader says</p></div><form><p>send</p></form><aside><p>see also</p></aside><noscript>js</noscript>'
    pages = [page(f"T{i}", [f"a {i}", f"b {i}"], extra=more, comments='<section id="comments"><p>me too</p></section>') for i in range(3)]
    assert text(pages, pages[0]) == "T0\na 0\nb 0"


def test_template_text_needs_many_pages():
    pages = [page(f"T{i}", [f"a {i}"], extra="<div>Share this story</div>") for i in range(12)]
    assert text(pages, pages[3]) == "T3\na 3"
    assert text(pages[:2], pages[0]) == "T0\na 0\nShare this story"
    same = [page("T", ["all the same"])] * 12
    assert text(same, same[0]) == "T\nall the same"


def test_article_text_does_not_depend_on_the_number_of_near_copies():
    pages = [page("Search and share", [f"a {i}"], extra="<div>One lone block</div>") for i in range(12)]
    assert text(pages, pages[3]) == "Search and share\na 3\nOne lone block" == text(pages[:7], pages[3])


def test_pages_without_an_article():
    bare = [f"<div class='menu'><a href='/'>home</a></div><div><p>story {i}</p><p>more {i}</p></div><div><a href='/x'>only {i}</a> <a href='/y'>links</a></div>" for i in range(3)]
    assert text(bare, bare[1]) == "story 1\nmore 1"


def test_a_host_with_and_without_articles():
    bare = [f"<div class='menu'><a href='/'>home</a></div><div><p>story {i}</p><p>more {i}</p></div><footer>end</footer>" for i in range(6)]
    pages = [*bare, page("T", ["in the article"])]
    assert text([bare[1]], bare[1]) == "story 1\nmore 1"
    assert [text(pages, p) for p in pages] == [*(f"story {i}\nmore {i}" for i in range(6)), "T\nin the article"]


def test_layout_words_do_not_hide_the_article():
    pages = ['<div class="page with-sidebar">' + page(f"T{i}", [f"a {i}"]) + "<div class='sidebar'>s</div></div>" for i in range(3)]
    assert text(pages, pages[0]) == "T0\na 0"


def test_merging_in_any_order_reads_alike():
    rng = random.Random(3)
    pages = [page(f"T{i}", [f"p{i}.{j}" for j in range(rng.randint(0, 5))], nav=rng.randint(1, 6), extra=rng.choice(["", "<ul><li>q</li></ul>", "<blockquote>z</blockquote>"])) for i in range(20)]
    want = [text(pages, p) for p in pages]
    for _ in range(5):
        mixed = rng.sample(pages, len(pages))
        assert [text(mixed, p) for p in pages] == want


def test_columns(spark):
    rows = [(i, f"http://h{i % 3}.example/{i}", page(f"T{i}", [f"a {i}"])) for i in range(30)]
    rows += [(100, None, page("N", ["no url"])), (101, "http://h0.example/", None), (102, "http://h0.example/", ""), (0, *rows[0][1:]), (103, "http://h1.example/l", page("L", ["word " * 50_000]))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    for limit in (1 << 30, 0):
        got = W.extract(df, broadcast_bytes=limit)
        assert got.columns == ["page_id", "url", "text"]
        out = sorted((r.page_id, r.text) for r in got.collect())
        want = [(i, f"T{i}\na {i}") for i in range(30)] + [(0, "T0\na 0"), (100, "N\nno url"), (101, ""), (102, ""), (103, "L\n" + ("word " * 50_000).strip())]
        assert out == sorted(want)
    assert W.extract(df.limit(0)).collect() == []


def test_the_wrapper_tells_template_texts_from_the_story():
    bare = [f"<div class=a>Welcome to our house</div><div><p>story {i}</p><p>more {i}</p></div><div class=b>We are here for you</div><div class=c><a href='/{i}'>link {i}</a> or</div>" for i in range(9)]
    alone = "Welcome to our house\nstory 4\nmore 4\nWe are here for you"
    assert text([bare[4]], bare[4]) == alone  # nothing else to compare with
    assert text(bare, bare[4]) == "story 4\nmore 4"
    long = [p.replace("here for you", "here " * 200 + "for you") for p in bare]
    assert text(long, long[4]) == "story 4\nmore 4"


def test_deep_and_broken_pages_take_linear_time():
    for deep in ("<div>" * 100_000 + "in", "<div>" * 100_000 + "in" + "</div>" * 100_000, "<x>" * 50_000 + "in" + "</y>" * 100_000):
        assert text([deep], deep) == "in"
    nested = "<section><p>one</p>" * 3_000
    assert text([nested, nested], nested) == "\n".join(["one"] * 3_000)
    for broken in ("<p " * 350_000, "<a '" * 250_000, '<a b="' * 170_000, "<!" * 500_000, "<!--" * 250_000, "<script>" * 120_000, "</" * 500_000):
        start = time.time()
        text(["<p>in</p>" + broken], "<p>in</p>" + broken)
        assert time.time() - start < 20
    assert text(["<p>in</p><p "], "<p>in</p><p ") == "in"


def test_long_mixed_sequences_become_one_group():
    rng = random.Random(6)
    pages = ["<article>" + "".join(f"<{t}>{t} {i} {j}</{t}>" for j, t in enumerate(rng.choices(["p", "h2", "ul", "blockquote", "pre"], k=3_000))) + "</article>" for i in range(4)]
    start = time.time()
    held = wrapper(pages)
    assert len(find(held, "article")[3]) == 1 and time.time() - start < 20
    for p in pages:
        assert text(pages, p) == "\n".join(re.findall(r">([^<>]+)<", p))


def best(a, b):
    """Longest common subsequence, over all choices."""
    if not a or not b:
        return 0
    return best(a[1:], b[1:]) + 1 if a[0] == b[0] else max(best(a[1:], b), best(a, b[1:]))


def test_alignment_equals_all_choices():
    rng = random.Random(12)
    for _ in range(200):
        a, b = (rng.choices("abcd", k=rng.randint(0, 6)) for _ in range(2))
        a, b = ([x for i, x in enumerate(s) if not i or s[i - 1] != x] for s in (a, b))
        out = W.align([[x, 1, False, []] for x in a], [[x, 1, False, []] for x in b])
        if all(x[0][0] != "(" and not x[2] for x in out):
            assert len(out) == len(a) + len(b) - best(a, b)
            assert sum(x[1] for x in out) == best(a, b)


def test_class_words_are_no_proof_inside_the_article():
    kept = (
        '<section class="related-work"><p>earlier work</p></section><p class="search-results">what we found</p><p id="comment-policy">how we answer</p>'
        "<p>since <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds</p><object data='a.svg'><param name=q><p>a picture</p></object>"
    )
    gone = '<div class="inline-ad">buy</div><div class="share-buttons">tell</div><ul class="comment-list"><li>first</li></ul><div id="ads_2">now</div><div class="reader-comments">me</div>'
    pages = [page(f"T{i}", [f"a {i}"], extra=kept + gone) for i in range(10)]
    want = "a 3\nearlier work\nwhat we found\nhow we answer\nsince x=2 holds\na picture"
    assert text(pages, pages[3]) == text([pages[3]], pages[3]) == "T3\n" + want
    assert text([page("T", ["b"])], pages[3]) == "T3\n" + want  # what the wrapper has not seen


def test_a_map_column_passes(spark):
    df = spark.createDataFrame([(i, "http://a.b/c", page("T", [f"a {i}"]), {"k": i}) for i in range(4)], "page_id int, url string, html string, m map<string,int>")
    for limit in (1 << 30, 0):
        assert sorted((r.page_id, r.m["k"], r.text) for r in W.extract(df, broadcast_bytes=limit).collect()) == [(i, i, f"T\na {i}") for i in range(4)]
