"""Main text by differencing: which lines it decides, against a plain version of the pairing."""

import os
import re
from collections import defaultdict

from strandline.llm import pages
from tests.compare import TESTDATA


def texts(spark, rows):
    given = spark.createDataFrame([(n, u, h) for n, (u, h) in enumerate(rows)], "page_id long, url string, html string").repartition(3)
    return [r["text"] for r in sorted(pages.main_text(given).collect(), key=lambda r: r["page_id"])]


def test_copies_without_an_article_keep_their_text(spark):
    page = "<div>one two three</div><p>four five</p>"
    assert texts(spark, [("http://h/a?p=1", page), ("http://h/a?p=2", page)]) == ["one two three four five"] * 2
    other = "<div>one two three</div><p>quite another text of this host</p>"
    assert texts(spark, [("http://h/a?p=1", page), ("http://h/a?p=2", page), ("http://h/b", other)]) == ["four five"] * 2 + ["quite another text of this host"]


def test_versions_of_a_page_tell_nothing_of_each_other(spark):
    """Three near copies between other pages: each is held against those, not against its versions."""
    top = "<div>site name</div>"
    body = [f"paragraph {n} of the long text that all versions have" for n in range(6)]
    version = [top + "".join(f"<p>{t}</p>" for t in [*body[:n], f"changed words here {n}", *body[n + 1 :]]) for n in range(3)]
    other = [top + f"<p>the text of page {n} is {'like no other ' * 3}{n}</p>" for n in range(2)]
    rows = [("http://h/a", other[0]), *((f"http://h/k{n}", v) for n, v in enumerate(version)), ("http://h/z", other[1])]
    found = texts(spark, rows)
    for n in range(3):
        assert found[n + 1] == " ".join([*body[:n], f"changed words here {n}", *body[n + 1 :]])
    assert all("site name" not in t for t in found)


def test_a_teaser_in_an_article_is_not_all(spark):
    assert texts(spark, [("http://h/a", "<article>teaser</article><div>long body of text</div>")]) == ["teaser long body of text"]


def test_what_every_page_has_goes_from_articles_too(spark):
    rows = [(f"http://h/p{n}", f"<div>head</div><article><p>Share this story<p>text number {n} with words {n * 7} of its own</article>") for n in range(9)]
    assert texts(spark, rows) == [f"text number {n} with words {n * 7} of its own" for n in range(9)]
    # Four unlike pages at least have to agree; a passage that some pages quote stays.
    assert texts(spark, rows[:3])[0].startswith("Share this story")
    quoting = [(u, h.replace("Share this story", "a quoted passage" if n % 3 else "a line of its own")) for n, (u, h) in enumerate(rows)]
    assert sum("a quoted passage" in t for t in texts(spark, quoting)) == 6


def test_nothing_else_is_dropped_from_an_article(spark):
    body = "<p>a <math><mi>x</mi></math> b<noscript>plain</noscript><object>drawn</object><div class='related-work'>earlier work<div class='share-chart'>chart</div></div>"
    assert texts(spark, [("http://h/a", f"<article>{body}<div class='share'>post it</div></article>")]) == ["a x b plain drawn earlier work chart"]


def plain_shared(a, b):
    """The lines of ``a`` that a longest common subsequence takes, by the table of lengths."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in reversed(range(len(a))):
        for j in reversed(range(len(b))):
            best[i][j] = 1 + best[i + 1][j + 1] if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    return best[0][0]


def bare(html):
    """A page without the markup that tells its parts."""
    return re.sub(r'</?(?:nav|article|aside|footer|header|main|form)\b[^>]*>|<div class="ad">', lambda m: "<div>" if m[0][1] != "/" else "</div>", html)


def test_differencing_decides_pages_without_markup(spark):
    """On the given pages, bared of telling markup, each line that goes is shared with the page that the plain pairing names."""
    rows = spark.read.parquet(os.path.join(TESTDATA, "sf0.01", "pages.parquet")).select("page_id", "url", "html").collect()
    top = [f"<div>{host} front page</div><div>contact and terms of {host}</div>" for host in (r["url"].split("/")[2] for r in rows)]
    given = spark.createDataFrame([(r["page_id"], r["url"], bare(r["html"]).replace("<body>", "<body>" + t)) for r, t in zip(rows, top)], "page_id long, url string, html string")
    found = {r["page_id"]: r["text"] for r in pages.main_text(given).collect()}
    hosts = defaultdict(dict)
    for r in given.collect():
        lines = tuple(t for k, t in pages.lines_of(r["html"]) if k != pages.FRAME_LINE)
        host, path = re.match(r"https?://([^/?#]*)([^?#]*)", r["url"]).groups()
        at = hosts[host.lower()].setdefault(lines, [path, []])
        at[0] = min(at[0], path)
        at[1].append(r["page_id"])

    def alike(a, b):
        both, total = sum(len(a[i]) for i in pairs(a, b)), min(sum(map(len, a)), sum(map(len, b)))
        return both / max(1, total)

    def pairs(a, b):
        taken = [i for i, t in enumerate(pages.shared([hash(x) for x in a], [hash(x) for x in b])) if t]
        assert len(taken) == plain_shared(a, b)
        return taken

    gone = kept = 0
    for reps in hosts.values():
        order = sorted((path, lines, ids) for lines, (path, ids) in reps.items())
        if len({p for p, _, _ in order}) < len(order):
            continue  # equal paths stand in the order of a hash
        version = [0]
        for n in range(1, len(order)):
            version.append(version[-1] + (alike(order[n][1], order[n - 1][1]) <= pages.ALIKE))
        for n, (path, lines, ids) in enumerate(order):
            before = [m for m in range(n) if version[m] == version[n] - 1][-1:]
            after = [m for m in range(n + 1, len(order)) if version[m] == version[n] + 1][:1]
            near = [m for m in before + after if alike(lines, order[m][1]) <= pages.ALIKE]
            near.sort(key=lambda m: -len(os.path.commonprefix([path, order[m][0]])))
            if not near:
                continue
            out = set(pairs(lines, order[near[0]][1]))
            expected = " ".join(t for i, t in enumerate(lines) if i not in out)
            for page in ids:
                assert found[page] == expected
            gone, kept = gone + len(out) * len(ids), kept + (len(lines) - len(out)) * len(ids)
    assert gone > 300 and kept > gone
