"""The style tree against a recursive version in plain Python, and pages of which only the tree knows what to remove."""

import math
import random
from functools import cache

import pytest
from pyspark.sql import functions as F

from cairn.llm import site_tree as s

PAGES = "page_id long, url string, html string"


def plain_tree(pages):
    """(host, path) to importance, by recursion over the pages' elements."""
    out = {}
    for host in {s.host_of(u) for _, u, p in pages if p} - {""}:
        seen = [{x[0]: x for x in s.page_nodes(p)} for _, u, p in pages if p and s.host_of(u) == host]

        @cache
        def importance(path, host=host):
            on = [p for p in seen if path in p]
            m = len(on)
            features = [f for p in on for f in p[path][5]]
            if features:
                entropy = [math.log(features.count(f)) / math.log(m) if m > 1 else 0 for f in features]
                return 1 - sum(entropy) / len(entropy)
            styles = [p[path][4] for p in on]
            share = [styles.count(x) / m for x in set(styles)]
            presentation = -sum(x * math.log(x) for x in share) / math.log(m) if m > 1 else 1
            below = 0
            for p in on:
                children = [c for c, x in p.items() if x[1] == path]
                below += sum(importance(c) for c in children) / max(1, len(children)) / m
            g = s.GAMMA ** len(share)
            return (1 - g) * presentation + g * below

        out |= {s._key(host, str(path)): importance(path) for p in seen for path in p}
    return out


def test_tree_equals_the_recursive_one(spark):
    rng = random.Random(7)

    def block(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["Same words here", f"Page {rng.randrange(9)} of many", "One", f"n{rng.randrange(50)} and more &amp; more", "&nbsp;"])
        tag = rng.choice(["div", "p", "section", "article", "span", "ul"])
        kind = rng.choice(["", ' class="a"', ' class="b c"', ' class="sidebar"'])
        return f"<{tag}{kind}>" + "".join(block(depth - 1) for _ in range(rng.randint(1, 3))) + f"</{tag}>"

    pages = [(i, rng.choice(["http://a.example.com/x", "http://b.example.com/y", "http://c.example.com", None]), "<body>" + block(4) + block(3)) for i in range(40)]
    pages += [(i + 50, "http://a.example.com/x", '<body><div class="x1"><p>Same words here</p></div><div class="x2"><p>w%d v%d</p></div>' % (i, i)) for i in range(30)]
    pages += [(90, "http://a.example.com/x", ""), (91, "http://a.example.com/x", None)]
    got = {r["key"]: r["importance"] for r in s.tree_nodes(spark.createDataFrame(pages, PAGES)).collect()}
    want = plain_tree(pages)
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    assert min(want.values()) < 0.3 and max(want.values()) - min(want.values()) > 0.4


class Plain:
    """A page built as a tree of lists, which knows the text that each of its pieces belongs to: the parser is held against a walk over it."""

    BLOCKS, INLINE = ("div", "p", "section", "ul", "article", "nav", "aside"), ("b", "span", "a", "button", "i")

    def __init__(self, rng):
        self.rng, self.count = rng, 0

    def text(self):
        self.count += 1
        return f"t{self.count}"

    def build(self, depth, tag="div"):
        inline = tag in self.INLINE or tag in ("p", "h1")
        out = []
        for _ in range(self.rng.randint(0, 4)):
            if depth == 0 or self.rng.random() < 0.4:
                out.append(self.text())
            else:
                kind = self.rng.choice(self.INLINE if inline else self.BLOCKS + self.INLINE)
                out.append((kind, self.rng.choice(["", "", " hidden", ' class="share"', ' class="x1"']), self.build(depth - 1, kind if kind not in self.INLINE else "b")))
        return out

    def html(self, nodes):
        return "".join(x if isinstance(x, str) else f"<{x[0]}{x[1]}>{self.html(x[2])}</{x[0]}>" for x in nodes)

    def walk(self, nodes, noise=False, article=False, names=True, out=None):
        out = [[]] if out is None else out
        for x in nodes:
            if isinstance(x, str):
                out[-1].append((x, noise, article))
            else:
                tag, attribute, below = x
                block = tag in self.BLOCKS
                main = tag == "article"
                bad = noise or tag in ("nav", "aside", "button") or "hidden" in attribute or names and "share" in attribute and not main
                if block:
                    out.append([])
                self.walk(below, bad, (article or main and not bad) and not bad, names, out)
                if block:
                    out.append([])
        return out

    def main(self, nodes):
        for names in (True, False):
            blocks = self.walk(nodes, names=names)
            inside = any(a and not n for b in self.walk(nodes, names=False) for _, n, a in b)
            kept = [" ".join([]) + "".join(t for t, n, a in b if not n and (a or not inside)) for b in blocks]
            if any(kept):
                return "\n".join(k for k in kept if k)
        return ""


def test_pieces_equal_a_walk_over_the_tree():
    rng = random.Random(11)
    for _ in range(1500):
        plain = Plain(rng)
        nodes = plain.build(4)
        if any("share" in x and "<article" in x for x in [plain.html(nodes)]):
            continue  # an article below a name has rules of its own
        assert s.main_text(plain.html(nodes), "", frozenset()) == plain.main(nodes), plain.html(nodes)


@pytest.mark.parametrize("sent", [None, 0])
def test_only_the_tree_removes_what_no_name_tells(spark, monkeypatch, sent):
    """Boilerplate in plain elements without telling names goes, with a changing number in it too; what differs from page to page stays."""
    if sent is not None:
        monkeypatch.setattr(s, "MOST_SENT", sent)
    page = '<div class="x1"><p>Welcome to our little site</p><p>All about ships and trains</p></div><div class="x2"><p>%s</p><p>%s</p></div><div class="x3"><p>Made in 1999 by the people of the harbour, read %d times so far by many</p></div>'
    rng = random.Random(3)
    story = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(30))
    texts = {i: (story(), story()) for i in range(30)}
    pages = [(i, f"http://plain.example.com/{i}", page % (*texts[i], i)) for i in range(30)]
    pages += [(100, "http://plain.example.com/x", page.replace('<div class="x2"><p>%s</p><p>%s</p></div>', "") % 5)]  # nothing of its own: all but noise stays
    pages += [(200, "http://lonely.example.com/", page % (*texts[0], 1))]
    got = {r["page_id"]: r["text"] for r in s.extract(spark.createDataFrame(pages, PAGES).withColumn("key", F.lit(1))).collect()}
    assert all(got[i] == "\n".join(texts[i]) for i in range(30))
    assert got[100].startswith("Welcome to our") and got[200].startswith("Welcome to our")


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="elementor-widget-container"><article>A b</article></div>', "A b"),
        ('<div class="has-sidebar"><article>A b</article></div>', "A b"),
        ('<article class="post comments-open">A b</article>', "A b"),
        ('<form id="aspnetForm"><main>A b</main><div><form><p>Mail</p></form></div></form>', "A b"),
        ("<form><p>Mail</p></form><p>A b</p>", "A b"),
        ('<p>One <svg x="1"/>two</p><p>three</p>', "One two\nthree"),
        ("<p>One</p><svg><text>icon</text><p>Two</p>", "One\nTwo"),
        ("<head><title>x<body><p>A b</p>", "A b"),
        ("<textarea>x<article>A b</article>", "A b"),
        ("<p>One</p><script>var x = 1;<p>Two</p>", "One"),
        ("<article><p>Main sentence <button>More</p><p>b</p>", "Main sentence\nb"),
        ("<p>Story <i class='icon social'></p><p>b</p>", "Story\nb"),
        ("<p>Story <span class='ad'></p><p>b</p>", "Story\nb"),
        ("<p>One <span hidden>secret</span> two</p>", "One two"),
        ("<p>One <span style='display: none'>secret</span>two</p>", "One two"),
        ("<article><button>b</button><p>c</p></article>", "c"),
        ("<p>x</p><select><option>1<option>2</select>", "x"),
        ("<p>x</p><div>y <a class='share'>Share this</a></div>", "x\ny"),
        ("<p>a</p><!--><p>b</p>", "a\nb"),
        ("<p>a</p><!---><p>b</p>", "a\nb"),
        ("<p>a</p><!-- x --!><p>b</p>", "a\nb"),
        ("<p>a</p><!-- x > y --><p>b</p>", "a\nb"),
        ("<p>a</p><!-- x <p>b</p>", "a"),
        ('<div class="social-history"><p>main text</p></div>', "main text"),
        ("<div class='form-of-government'><p>main text</p></div>", "main text"),
        ('<div class="ad"><p>main text</p></div>', "main text"),
        ('<article><div class="ad-hoc-committee"><p>One</p></div><div class="widget-content"><p>Two</p></div><figure class="banner-image"><p>Three</p></figure><div class="ad">Four</div></article>', "One\nTwo\nThree"),
        ('<article><p>One</p><div class="related-box"><a href="x">more of this</a></div></article>', "One"),
        ('<p>One two three</p><div class="comment-list"><p>' + "word " * 40 + "</p></div>", "One two three"),
        ("<p>One</p><svg><g><text>icon</text></g><h2>Two</h2>", "One\nTwo"),
    ],
)
def test_pages_that_lost_their_text(page, text):
    assert s.main_text(page, "", frozenset()) == text
