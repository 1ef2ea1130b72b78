import math
import random
import time
from html.parser import HTMLParser

import pytest
from chronolode.llm import html_text as ht
from chronolode.llm.html_text import extract, extract_pages

BODY = "<p>First paragraph with <b>bold</b> text, long enough to be the article.<p>Second &amp; last&nbsp;one goes on\n and  on."
TEXT = "First paragraph with bold text, long enough to be the article. Second & last one goes on and on."
NOISE = [
    "<nav><ul><li><a href=/>Home</a></ul></nav>", "<header><h1>The Site</h1><a href=x>menu</a></header>", "<footer>&copy; 2024 all rights reserved by everybody concerned</footer>",
    "<aside><p>A sidebar that says quite a lot about other things.</p></aside>", '<div class="cookie-notice"><p>We use cookies, and we say so in many words indeed.</p></div>',
    '<div class="ad">Buy now, buy here, buy more of everything we sell!</div>', "<form><p>Sign up with your address to get our letter</p><input name=a><button>Go</button></form>",
    "<script>var t='</p>';document.write('<p>no')</script><style>p{margin:0}</style>", '<section id="comments"><div class="comment"><p>Nice one, I like this very much, thanks for all of it.</p></div></section>',
    '<div role="navigation"><a href=1>one</a> <a href=2>two</a></div>', "<!-- <p>gone</p> -->", '<div style="display: none">hidden words stand here</div>',
]


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main><div>{}</div></main>", '<div id="content"><div class="post">{}</div></div>', "<div><section>{}</section></div>"])
@pytest.mark.parametrize("noise", NOISE)
def test_leaves_noise(frame, noise):
    page = f"<!DOCTYPE html><html><head><title>t</title></head><body>{noise}{frame.format(BODY)}{noise}</body></html>"
    assert extract(page) == TEXT


FRAMES = ['<div class="page has-sidebar">{}</div>', '<div id="nav-open"><div class="content-with-menu"><article>{}</article></div></div>', '<form id="aspnet"><div><h1>A title</h1>{}</div></form>']


@pytest.mark.parametrize("frame", FRAMES)
def test_frames_named_like_noise(frame):
    body = "<p>" + "More words of the article stand here to make it long. " * 12 + "</p>"
    got = extract(f"<html><body><nav><a href=/>Home</a></nav>{frame.format(body)}<div class='sidebar'>Other things.</div></body></html>")
    assert got.removeprefix("A title ") == ("More words of the article stand here to make it long. " * 12).strip()


def test_comments_go_however_long():
    comments = '<div class="comments">' + "<article class='comment'><p>I think so too, and I say it at length.</p></article>" * 60 + "</div>"
    assert extract(f"<body><article>{BODY}</article>{comments}</body>") == TEXT


def test_all_noise_and_heading():
    page = "<html><body>" + "".join(NOISE) + f"<article><h1>A <i>title</i></h1>{BODY}</article>" + "".join(NOISE)
    assert extract(page) == f"A title {TEXT}"


@pytest.mark.parametrize("html,text", [(None, ""), ("", ""), ("plain", "plain"), ("a < b & c &lt; d", "a < b & c < d"), ("<p>a<p>b<br>c", "a b c"), ("<nav>x</nav>", ""), ("<p>x<b>y</b>z</p>", "xyz"), ("<p title='a>b'>x", "x"), ("<!-- open", ""), ("<p>x<", "x<"), ("<ul><li>a<li>b</ul>", "a b"), ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<script>x", "")])
def test_small_and_broken(html, text):
    assert extract(html) == text


def test_long_and_deep():
    assert extract("<div>" * 3000 + "<p>" + "word " * 200_000) == "word " * 199_999 + "word"
    assert extract("<" * 20_000).count("<") == 20_000


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", f"<article>{BODY}</article>", "t", 3), (None, None, None, None, None), (1, "u", f"<article>{BODY}</article>", "t", 3)], "page_id long, url string, html string, text string, n_chars int")
    got = extract_pages(df)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, [(1, "u", TEXT, len(TEXT))] * 2 + [(None, None, "", 0)]))
    assert extract_pages(df.limit(0)).count() == 0


@pytest.mark.parametrize("tags", ["section section section", "section div section", "div section div"])
@pytest.mark.parametrize("sizes", [(300, 100, 300), (300, 100, 100), (100, 300, 50)])
def test_sections_without_an_article_element(tags, sizes):
    parts = [" ".join(["w" * (n - 1)] * 5) for n in sizes]
    body = "".join(f"<{t}>" + "".join(f"<p>{w}</p>" for w in x.split()) + f"</{t}>" for t, x in zip(tags.split(), parts, strict=True))
    links = "<div>" + "<a href=x>elsewhere</a> " * 5 + "</div>" if sizes[0] == sizes[2] else ""
    got = extract(f"<html><body>{NOISE[0]}<div><h1>Ten letter</h1>{body}{links}</div>{NOISE[2]}</body></html>")
    assert got == " ".join(["Ten letter", *parts])


SUBJECTS = ['class="share-price"', 'id="related-work"', 'class="privacy"', 'id="discussion"', 'id="search-algorithms"', 'class="legal notice"', 'class="header-files"', 'class="ad-hoc"']


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main>{}</main>", "<div>{}</div>"])
@pytest.mark.parametrize("name", SUBJECTS)
def test_sections_keep_their_text_whatever_their_name(frame, name):
    p = "<p>" + "words of a paragraph that is part of the article, " * 4 + "</p>"
    page = frame.format(f"<h1>Title</h1>{p * 3}<section {name}><h2>Subject</h2><p>TARGET {p[3:]}{p}</section>{p}")
    got = extract(f"<body>{NOISE[0]}{page}{NOISE[2]}</body>")
    assert "TARGET" in got and "Subject" in got and got.startswith("Title")


@pytest.mark.parametrize("frame", ["<article>{}</article>", "<main><article>{}</article></main>"])
@pytest.mark.parametrize("noise", [
    '<ol class="thread">' + "<li><b>Ann</b> <time>noon</time> <p>So it is, I think.</p></li>" * 30 + "</ol>", '<div class="share"><a href=a>here</a> <a href=b>there</a></div>',
    '<div class="related"><h3>Read on</h3><ul><li><a href=x>Another one</a><li><a href=y>One more</a></ul></div>', '<div class="notice">We say: cookies.</div>'])
def test_sparse_parts_of_doubtful_name_go(frame, noise):
    p = "<p>" + "words of a paragraph that is part of the article, " * 6 + "</p>"
    text = extract(f"<body>{frame.format(p * 4)}</body>")
    assert extract(f"<body>{frame.format(p * 4 + noise)}</body>") == extract(f"<body>{noise}{frame.format(p * 4)}{noise}</body>") == text


@pytest.mark.parametrize("unit", ["<b>|x</i>", "<i>|<td>x", "<div>|x</p>", "<i><div>|<b>x</i>", "<thead>|<td>x", "<a |", '<a "|', "<li><b>|<li>x", "<p><i>|<div>x</div>", "<table><tr>|<td>x</tr>", "<!|<", "<x '|>", "</b>|</i>x", "<ul><li>|x</ol>"])
def test_broken_markup_takes_time_in_proportion(unit):
    a, b = unit.split("|")

    def seconds(size):
        began = time.process_time()
        extract(a * (size // len(a)) + b * (size // max(len(b), 1)))
        extract(unit.replace("|", "") * (size // len(unit)))
        return time.process_time() - began

    seconds(5_000)
    assert seconds(120_000) < 8 * max(seconds(30_000), 0.1)  # 4 times the length; quadratic work would be 16 times


class Walk(HTMLParser):
    """A plain tree: [tag, children, text]."""

    def __init__(self, html):
        super().__init__()
        self.stack = [["#root", [], 0]]
        self.order = [self.stack[0]]
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        node = [tag, [], 0]
        self.stack[-1][1].append(node)
        self.order.append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        self.stack[-1][2] += len(data.replace(" ", ""))


def naive(node, linked, share):
    """chars, tags, link chars, link tags of a subtree, by recursion, and its density."""
    linked = linked or node[0] == "a"
    c, t, lc, lt = node[2], 0, node[2] if linked else 0, 0
    for child in node[1]:
        x = naive(child, linked, share)
        c, t, lc, lt = c + x[0], t + x[1] + 1, lc + x[2], lt + x[3] + (child[0] == "a")
    if share is None or not c:
        return c, t, lc, lt, 0.0
    d = c / max(t, 1)
    bottom = math.log(max(math.log(c * lc / max(c - lc, 1) + share * c + math.e), 1) + 1)
    return c, t, lc, lt, d * math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1) + 1e-9) / bottom


def test_densities_and_choice_equal_a_naive_walk():
    r = random.Random(8)

    def part(depth):
        text = "word " * r.randint(1, 40)
        if depth == 0 or r.random() < 0.2:
            return f"<p>{text}<a>{'go ' * r.randint(1, 5)}</a></p>" if r.random() < 0.5 else f"<p>{text}</p>"
        tag = r.choice(["div", "section", "ul"])
        return f"<{tag}>{''.join(part(depth - 1) for _ in range(r.randint(1, 5)))}</{tag}>"

    for _ in range(40):
        html = f"<body>{part(4)}{part(3)}</body>"
        page = ht._Page(html)
        size = [0] * len(page.tag)
        for piece in page.pieces:
            if piece:
                size[piece[0]] += len(piece[1].replace(" ", ""))
        out = [False] * len(page.tag)
        density, *_ = ht._densities(page, out, size)
        tree = Walk(html)
        body = tree.order[1]
        whole = naive(body, False, None)
        want = [naive(x, False, whole[2] / max(whole[0], 1)) for x in tree.order]
        inside = set()  # link characters of a node below a link count as such
        assert [x[0] for x in tree.order] == page.tag and not inside
        for i, tag in enumerate(page.tag):
            if tag != "a":
                assert density[i] == pytest.approx(want[i][4], rel=1e-9)
        place = {id(x): i for i, x in enumerate(tree.order)}
        sums = [sum(density[place[id(c)]] for c in x[1]) for x in tree.order]
        best = max((i for i, x in enumerate(tree.order) if i and not x[2]), key=lambda i: sums[i])
        chosen = ht._select(page, out, size)
        assert not sums[best] or chosen[best] or page.tag[best] == "body" or any(chosen[i] for i in range(best, len(chosen)))
