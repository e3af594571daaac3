import itertools
import random

from hypothesis import given
from hypothesis import strategies as st

from plexum.llm import html_cut

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p><p>no";</script></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy this now, it is very good.</div>
<article><h1>Caf&eacute; &amp; &#x54;ea</h1><p>First <b>par</b>t of&nbsp;the
 story.<p>Er.</p><aside>See also other stories of this kind, please do.</aside><form><label>Name</label><input><button>Send</button></form>
<div class="cookie-notice">We use cookies on this site for all of you.</div><p>The last words<br>stand here.</p>
<section id="comments"><p>I am a reader and I like the story very much indeed.</p></section></article><footer>&copy; 2020 Site.</footer></body></html>"""


def test_page():
    assert html_cut.main_text(PAGE)[0] == "Café & Tea First part of the story. Er. The last words stand here."


def test_without_article():
    page = "<div><ul class=menu><li><a href=x>Home</a><li><a href=y>News</a></ul><div id=content><p>A long sentence of the story, with many words in it, goes on here.</p><p>Short.</p></div><div>&copy; 2020</div></div>"
    assert html_cut.main_text(page)[0] == "A long sentence of the story, with many words in it, goes on here. Short."


STORY = "<p>" + "The story has many words and goes on here for long. " * 10 + "</p>"
TOLD = html_cut.main_text(f"<article>{STORY}</article>")[0]


def test_marked_wrappers():
    assert len(TOLD) > 500
    bar, talk = "<div class=sidebar><p>Other things of this site stand here, all day.</p></div>", "<section id=comments><p>" + "I am a reader and I like it. " * 40 + "</p></section>"
    for name in ("has-sidebar", "search-results", "with-comments", "share-enabled", "site-menu-open", "has-sidebar with-comments"):
        for tag in ("article", "main", "div"):
            assert html_cut.main_text(f"<div class='{name}'><{tag}>{STORY}</{tag}>{bar}</div>")[0] == TOLD, (name, tag)
            assert html_cut.main_text(f"<div class='{name}'><div id=banner-wrap><{tag}>{STORY}</{tag}></div>{bar}</div>")[0] == TOLD, (name, tag)
        for tag in ("article", "main"):
            assert html_cut.main_text(f"<div class='{name}'><{tag}>{STORY}</{tag}>{bar}{talk}</div>")[0] == TOLD, (name, tag)
            assert html_cut.main_text(f"<div class='{name}'><{tag}>{STORY}{bar}{talk}</{tag}></div>")[0] == TOLD, (name, tag)


def test_marked_parts():
    """Teasers and comments stay out, articles or not, whether the story is one or not."""
    for words in ("related", "widget", "comments"):
        part = f"<div class={words}>" + "<article><p>A teaser of another story, with some words in it.</p></article>" * 3 + "</div>"
        assert html_cut.main_text(f"<article>{STORY}</article>{part}")[0] == TOLD
        assert html_cut.main_text(f"<div>{STORY}</div>{part}")[0] == TOLD
        assert html_cut.main_text(f"<div class=has-sidebar><article>{STORY}</article>{part}</div>")[0] == TOLD


def test_unclosed():
    """An element without an end tag loses no text of the blocks after it."""
    for tag in ("button", "select", "object", "audio", "video", "canvas", "svg", "noscript", "template"):
        assert html_cut.main_text(f"<article><p>One two three four five.</p><{tag}>Go<p>Then the rest.</p></article>")[0] == "One two three four five. Then the rest.", tag
        assert html_cut.main_text(f"<article><p>One two three four five.<{tag}>Go</p><p>Then the rest.</p><p><{tag}>Go</{tag}> And more.</p></article>")[0].split("five.")[1].split() == "Then the rest. And more.".split(), tag
    assert html_cut.main_text("<article><p>One.</p><svg><g><svg></svg>no</g></svg><p>Two.</p><object><p>no</p></object></article>")[0] == "One. Two."
    html_cut.main_text("<article>" + "<svg><button>" * 20_000 + "<p>x</p>")


def _page(rng, kind):
    """A page of one of four layouts without marks by class, and its text."""
    words = "the of and river house stone walk light over green winter long road".split()
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    parts = [f"<h1>{say(3)}</h1>"]
    for _ in range(rng.randint(3, 7)):
        n = rng.choice([2, 3, 15, 25, 40, 60])
        parts.append(f"<p>{say(n)}{rng.choice(['.', '.', ''])}</p>" if rng.random() < 0.8 else f"<ul><li>{say(2)}</li><li>{say(3)}</li></ul>")
    parts += [f"<p>{say(30)}.</p>", f"<p>{say(2)}</p>", f"<p>{say(40)}.</p>"]
    text = " ".join(" ".join(html_cut.re.sub("<[^>]+>", " ", "".join(parts)).split()).split())
    menu = "<ul>" + "".join(f"<li><a href=/{k}>{say(1)}</a></li>" for k in range(6)) + "</ul>"
    foot = "<div>&copy; 2020 All rights reserved</div>"
    story = "".join(parts)
    page = [f"<article>{story}</article>", f"<main>{story}</main>", f"<div><div>{story}</div></div>", f"<table><tr><td>{menu}</td><td><div>{story}</div></td></tr></table>"][kind]
    return f"<body><div>{menu}</div>{page}{foot}</body>", text


def test_cut_decides():
    """Many pages have labels other than the costs' signs, and are read better for it."""
    rng = random.Random(8)
    changed = better = worse = whole = 0
    for k in range(400):
        page, want = _page(rng, k % 4)
        found, above = html_cut.parsed(page)
        costs, links = html_cut.network(found, above)
        side = html_cut.minimum_cut(costs, links)
        has_body = any(b.body and not b.frame for b in found)
        signs = [html_cut.logit(b, has_body) > 0 for b in found]
        truth = set(range(len(found))) - {i for i, b in enumerate(found) if b.link_chars or "©" in b.text}
        assert " ".join(found[i].text for i in sorted(truth)) == want
        off = lambda x: sum(len(b.text) for i, b in enumerate(found) if x[i] != (i in truth))
        if list(side[: len(found)]) != signs:
            changed += 1
            better += off(side) < off(signs)
            worse += off(side) > off(signs)
        whole += html_cut.main_text(page)[0] == want
    assert changed >= 300 and better >= 0.95 * changed and worse <= 0.02 * changed, (changed, better, worse)
    assert whole >= 380, whole


def test_broken():
    for page in (None, "", "<", "<p", "<!-- x", "<script>x", "<p title='x>y", "&am", "<article><p>Cut off &am"):
        html_cut.main_text(page)
    assert html_cut.main_text("<article><p>A &lt; b &am")[0] == "A < b &am"
    assert html_cut.main_text("<nav>" + "<div>" * 3000 + "x")[0] == ""


@given(st.integers(0, 10**6))
def test_cut_is_minimal(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 7)
    costs = [rng.choice([-3, -1.5, -0.5, 0.7, 1.1, 2.3, 4]) for _ in range(n)]
    links = [(i, j, rng.choice([0.3, 0.9, 2.0])) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]

    def cut(side):
        return sum(max(c, 0) if not s else max(-c, 0) for c, s in zip(costs, side)) + sum(w for i, j, w in links if side[i] != side[j])

    best = min(cut(x) for x in itertools.product([False, True], repeat=n))
    assert abs(cut(html_cut.minimum_cut(costs, links)) - best) < 1e-6


def test_operator(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (None, "v", "", None), (3, "w", "<article><p>" + "long words here. " * 20_000 + "</p></article>", "")]
    out = html_cut.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in out) == [(0, 0), (1, 66), (1, 66), (2, 0), (3, 17 * 20_000 - 1)]
    assert all(r.n_chars == len(r.text) for r in out)
    assert html_cut.extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
