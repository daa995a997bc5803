"""Very wide and very deep pages: the time a node takes does not grow with the page."""

import time

import numpy as np
import pytest

from reportmill.llm import extraction as E


def seconds(html):
    began = time.process_time()
    every = E.nodes(E.parse(html))
    x = E.features(every)
    E.decode(every, np.where(x[:, 6] > 0.5, 0.9, 0.2))
    return time.process_time() - began, len(every)


@pytest.mark.parametrize("shape", [
    lambda n: "<body><article>" + "<p>one two</p>" * n + "</article></body>", lambda n: "<table>" + "<tr><td>a<td>b" * n, lambda n: "<center>" * n + "words" + "</center>" * n, lambda n: "<h1>" * n + "x</b></i></p>" * n, lambda n: "<div>" * n + "<p>a</section>" * n, lambda n: "<ul>" + "<li>x" * n,
])
def test_linear(shape):
    small, n = seconds(shape(5_000))
    large, m = seconds(shape(50_000))
    assert m >= 9 * n * 0.9 and large / m < 4 * small / n + 2e-5, (small, n, large, m)


def test_a_hundred_thousand_siblings():
    took, n = seconds("<body><article>" + "<p>one two, three.</p>" * 100_000 + "</article></body>")
    assert n > 200_000 and took < 120


def test_pages_are_run_in_turns(monkeypatch):
    """Texts do not depend on which pages are in memory together."""
    pages = ["<nav><a href=x>menu</a></nav><article><p>" + f"Page {i} has words, and more of them. " * 8 + "</p></article>" for i in range(12)] + [None, ""]
    model = E.train([p for p in pages if p], copies=2)
    whole = E.extract_texts(pages, model)
    monkeypatch.setattr(E, "TOGETHER", 3)
    assert E.extract_texts(pages, model) == whole and whole[-2:] == ["", ""] and all(whole[:-2])
