"""Operator 1: templates, odd pages, and the registered query against the standard library's parser."""

from __future__ import annotations

import random
from html.parser import HTMLParser

import __spark_entry__ as entry
from lexiforge.llm import html_extraction, html_tree

from .test_models import page


def extracted(spark, rows):
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_extraction.extract(table).collect()}


def story(k, n=6):
    r = random.Random(k)
    return [f"{' '.join(r.choice(['river', 'stone', 'light', 'winter', 'quiet']) + str(r.randrange(99)) for _ in range(r.randrange(8, 30)))}." for _ in range(n)]


def neutral(k, menu="Start Topics Archive", foot="Printed in the old town"):
    """A page without articles and without names that mean anything."""
    items = "".join(f"<li><a href=/{w}>{w}</a></li>" for w in menu.split())
    text = "".join(f"<div class='x9'><p>{t}</p></div>" for t in story(k))
    return f"<html><body><div class='a1'><ul>{items}</ul></div><div class='b2'><div>Weather today is fair</div></div><div class='c3'>{text}</div><div class='d4'><p>{foot}</p></div></body></html>"


def test_neutral_hosts_lose_menus_and_keep_articles(spark):
    rows = [(k, "http://few.example/x", neutral(k)) for k in range(4)] + [(100 + k, "http://more.example/x", neutral(k)) for k in range(40)]
    got = extracted(spark, rows)
    assert all(got[i] == " ".join(story(k)) for k in range(40) for i in (k, 100 + k) if i in got)


def test_two_layouts_of_a_host(spark):
    other = lambda k: neutral(k, "Shop Basket", "Sold by nobody").replace("<div class='c3'>", "<div class='e5'><table><tr><td>Opening hours</td></tr></table></div><div class='c3'>")
    rows = [(k, "http://h.example/", (neutral if k % 2 else other)(k)) for k in range(30)]
    got = extracted(spark, rows)
    assert all(got[k] == " ".join(story(k)) for k in range(30))


def test_prose_that_pages_share_needs_more_evidence(spark):
    shared = " ".join(f"word{k}" for k in range(40))
    rows = [(k, "http://s.example/", neutral(k).replace("<div class='c3'>", f"<div class='c3'><p>{shared}</p>")) for k in range(5)]
    rows += [(100 + k, "http://t.example/", neutral(k).replace("<div class='c3'>", f"<div class='c3'><p>{shared}</p>")) for k in range(12)]
    got = extracted(spark, rows)
    assert all(got[k].startswith(shared) for k in range(5)) and not any(got[100 + k].startswith(shared) for k in range(12))


def test_template_in_a_marked_article(spark):
    rows = [(k, "http://u.example/", page(f"<p>Send us your view</p>{''.join(f'<p>{t}</p>' for t in story(k))}")) for k in range(12)]
    got = extracted(spark, rows)
    assert all(got[k] == " ".join(story(k)) for k in range(12))  # the headline is alike as well


def test_names_that_only_look_like_furniture():
    body = "<section class='share-price'><p>up</p></section><div class='social-history'>old</div><div class='article-header'><h1>Head</h1></div><div class='related-articles'>no</div>"
    assert html_extraction.main_text(f"<article>{body}</article>") == "up old Head"
    assert html_extraction.main_text(f"<div>{body}</div>") == "up old Head"
    assert html_extraction.main_text("<div role=listitem class=domain>junk</div><main><p>in</p></main>") == "in"
    assert html_extraction.main_text("<p>one<button>press</button>two<span class=ad>buy</span></p>") == "onetwo"


def test_deep_and_long_pages(spark):
    deep = lambda t: "<div>" * 5000 + t + "</div>" * 5000
    long = lambda k: "".join(f"<p>{i} {k}</p>" if i % 3 else f"<div><b>{i}</b><p>{k}</div>" for i in range(20_000 - k))
    rows = [(k, "http://deep.example/", deep(f"text {k}")) for k in range(9)] + [(20 + k, "http://long.example/", long(k)) for k in range(3)]
    got = extracted(spark, rows)
    assert all(got[k] == f"text {k}" for k in range(9))
    assert all(got[20 + k].endswith(f" {k}") for k in range(3))


def test_hosts_too_many_to_broadcast(spark, monkeypatch):
    rows = [(100 * h + k, f"http://h{h}.example/", neutral(k)) for h in range(3) for k in range(10)] + [(999, None, neutral(3))]
    want = extracted(spark, rows)
    monkeypatch.setattr(html_extraction, "BROADCAST_BYTES", 0)
    assert extracted(spark, rows) == want and want[204] == " ".join(story(4))


def test_long_lists_align_at_their_common_children():
    a, b = (html_tree.parse("".join(f"<div>{'<p>x</p>' * (i % 40)}</div>" for i in order)) for order in (range(60), [*range(25), *range(30, 60), 3, 4]))
    pairs = html_tree.match(a, b)
    assert len(pairs) == len(set(pairs)) and {i for i, _ in pairs} <= set(range(a.size))
    assert pairs == sorted(pairs) or sorted(pairs) == sorted(set(pairs))
    assert len(pairs) > 0.8 * b.size


class Article(HTMLParser):
    """What lies within the article element, block by block."""

    PARTS = frozenset("h1 h2 h3 p ul ol li div table tr td th br article".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.skipped, self.blocks = 0, 0, [""]

    def handle_starttag(self, tag, attrs):
        names = dict(attrs).get("class") or ""
        self.inside += tag == "article"
        if tag in ("aside", "nav", "footer", "form", "script", "style", "section") or "ad" in names.split():
            self.skipped += 1
        if tag in self.PARTS:
            self.blocks.append("")

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in self.PARTS:
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside and not self.skipped:
            self.blocks[-1] += data


def test_query_equals_a_plain_parser(spark):
    d = "/root/testdata/sf0.001"
    want = {}
    for r in spark.read.parquet(f"{d}/pages.parquet").collect():
        parser = Article()
        parser.feed(r.html.partition("<article")[1] + r.html.partition("<article")[2].partition("</article>")[0] + "</article>")
        parser.close()
        want[r.page_id] = " ".join(filter(None, (" ".join(b.split()) for b in parser.blocks)))
    got = entry.queries()["op1_html_extraction"](spark, d).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_odd_tables(spark):
    """Null and empty pages, null addresses, repeated rows, clashing names, an empty table."""
    schema = "page_id long, url string, html string, text string, host string, layout long, templates string"
    rows = [(1, "http://a.example/1", None), (2, None, "<p>Only words of a page without an address</p>"), (3, "", ""), (4, "http://a.example/4", neutral(4)), (4, "http://a.example/4", neutral(4)), (5, "http://a.example/5", "<<<>&&#x;</div>")]
    table = spark.createDataFrame([(*r, "old", "h", 7, "t") for r in rows], schema)
    made = html_extraction.extract(table)
    assert sorted(made.columns) == ["host", "layout", "page_id", "templates", "text", "url"]
    got = sorted((r.page_id, r.text) for r in made.collect())
    assert [g[0] for g in got] == [1, 2, 3, 4, 4, 5] and got[0][1] == got[2][1] == "" and got[1][1] == "Only words of a page without an address"
    assert got[3] == got[4] and all(t in got[3][1] for t in story(4))
    assert {(r.host, r.layout, r.templates) for r in made.collect()} == {("h", 7, "t")}
    assert html_extraction.extract(table.limit(0)).count() == 0


def test_long_lists_of_children_match_in_full(monkeypatch):
    """Lists without shapes of their own, far shifted: as many pairs as the plain programme finds, also by halves."""
    import random

    r = random.Random(3)
    kinds = [f"<div>{'<p>x</p>' * k}</div>" for k in range(6)]
    lists = [[r.choice(kinds) for _ in range(120)] for _ in range(2)]
    lists[1] = [kinds[0]] * 70 + lists[0][5:60] + lists[1][:30]
    a, b = (html_tree.parse("".join(x)) for x in lists)

    def plain(x, y, known):
        if x.tag != y.tag:
            return 0
        if (x.shape, y.shape) not in known:
            rows = [[0] * (len(y.children) + 1)]
            for c in x.children:
                row = [0]
                for k, d in enumerate(y.children):
                    row.append(max(rows[-1][k + 1], row[-1], rows[-1][k] + plain(c, d, known)))
                rows.append(row)
            known[x.shape, y.shape] = 1 + rows[-1][-1]
        return known[x.shape, y.shape]

    want = plain(a, b, {})
    for table in (html_tree.TABLE, 500):
        monkeypatch.setattr(html_tree, "TABLE", table)
        pairs = html_tree.match(a, b)
        assert len(pairs) == want == len({i for i, _ in pairs}) == len({j for _, j in pairs})
