"""Where dropped elements of broken or terse markup end."""

import pytest

from reportmill.llm import extraction

A = "<article><p>one</p><p>two</p></article>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<html><head><title>t</title><meta charset=x><body>{A}", "one two"),
        (f"<head><title>t</title><script>var a='<p>'</script><style>p{{}}</style>{A}", "one two"),
        ("<head><title>t</title>\n plain", "plain"),
        (f"<head><title>t</title><noscript><img src=x><p>no</p></noscript></head><body>{A}", "one two"),
        (f"<head><noscript><p>no</p><body>{A}", "one two"),
        *((f"<body><nav><a><{t}/>menu</a></nav>{A}", "menu one two") for t in ("svg", "canvas", "object", "iframe", "button", "select", "template", "noscript")),
        (f"<body><nav><svg><use/><g><path/></g></svg>menu</nav>{A}", "menu one two"),
        *((f"<body><nav>menu<{t}>no</nav>{A}", "menu one two") for t in ("svg", "canvas", "object", "button", "select", "template", "noscript")),
        (f"<nav><ul><li><a><svg><path>no</a>x</li></ul></nav>{A}", "x one two"),
        (f"<div><button>no<div>no</div>no</div>{A}", "one two"),
        (f"<div><button><div>no</div>no</button>yes</div>{A}", "yes one two"),
        (f"<div><button>no<button>no</button>yes</div>{A}", "yes one two"),
        (f"<select><option>no<option>no</select>{A}", "one two"),
        (f"<select><option>no{A}", "one two"),
        (f"<div><script>no</div></script>yes</div>{A}", "yes one two"),
        (f"<div><template><div>no</div><template>no</template>no</template>yes</div>{A}", "yes one two"),
        (f"<div><noscript>no<script>no</script>no</noscript>yes</div>{A}", "yes one two"),
    ],
)
def test_skips_end(html, want):
    every = extraction.nodes(extraction.parse(html))
    assert " ".join(x.text for x in every if x.text) == want
    assert not any(x.links for x in every if x.text in ("one", "two", "x", "yes"))
