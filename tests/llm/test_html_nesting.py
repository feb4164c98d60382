"""Deeply nested and badly closed pages: time in proportion to the page, and text as a plain walk over the open elements gives it."""

import time

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfield.llm.html_text import BLOCK, Lines, main_text

TAGS = ["p", "div", "b", "a", "li", "td", "article", "nav", "br", "hr", "script", "span"]
events = st.lists(st.tuples(st.sampled_from(["open", "close", "word"]), st.sampled_from(TAGS)), max_size=60)


def page(made) -> str:
    return "".join({"open": f"<{t}>", "close": f"</{t}>", "word": f"word{i} "}[kind] for i, (kind, t) in enumerate(made))


@settings(max_examples=200, deadline=None)
@given(events)
def test_open_elements_are_kept_right(made):
    lines = Lines()
    lines.feed(page(made))
    names = [tag for tag, _, _ in lines.open]
    assert lines.blocks == [i for i, tag in enumerate(names) if tag in BLOCK]
    assert {k: n for k, n in lines.names.items() if n} == {k: names.count(k) for k in set(names)}
    assert lines.links == names.count("a")


def test_deep_pages_take_time_in_proportion():
    began = time.time()
    for bad in ("<b>" * 60000 + "<hr>" * 60000, "<b>" * 60000 + "</i>" * 60000, "<b>x" * 60000 + "</b>" * 60000, "<p><i>x" * 40000):
        main_text(bad)
    assert time.time() - began < 60


def test_an_empty_table_of_pages(spark):
    from tallyfield.llm.html_text import extract

    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
