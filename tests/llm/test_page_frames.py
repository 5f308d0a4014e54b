"""Pages whose text stands inside elements that look like frame or in a head left open."""

import pytest

from strandline.llm import pages

BODY = "<article><p>one two three four five<p>six</article>"
TEXT = "one two three four five six"


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<div class='content with-sidebar'><nav>m</nav>{BODY}<aside>s</aside></div>", TEXT),
        (f"<div class='page no-sidebar'>{BODY}</div><div class=ad>buy</div>", TEXT),
        (f"<form action=/><div class=ad>buy</div>{BODY}</form>", TEXT),
        ("<div class='page no-sidebar'><p>text in a div<div class=ad>buy</div></div>", "text in a div"),
        ("<html><head><title>t</title><meta charset=utf-8><body><p>one<p>two", "one two"),
        ("<html><head><title>t</title><style>p{}</style><p>one", "one"),
        ("<head><title>t</title>one", "one"),
        ("<head><template><p>no</p></template><title>t</title></head><p>one", "one"),
        # What is frame stays frame.
        (f"{BODY}<div class=comments><article>{'a comment ' * 20}</article></div>", TEXT),
        (f"<p>{'a body without an article ' * 3}<section class=comments><article>no</article></section>", ("a body without an article " * 3).strip()),
        ("<p>a<div class=comments>much longer than the text</div>", "a"),
        (f"{BODY}<div class='x-sidebar'>{'related things ' * 20}</div>", TEXT),
    ],
)
def test_text_is_not_lost(html, text):
    lines = pages.lines_of(html)
    kept = [t for k, t in lines if k == pages.ARTICLE_LINE] or [t for k, t in lines if k == pages.OPEN_LINE]
    assert " ".join(kept) == text
