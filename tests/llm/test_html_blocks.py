"""Heads without end tags, and formulas."""

import pytest

from foldwise.llm.html_blocks import leaf_blocks


def texts(html):
    return [t for _, t, _ in leaf_blocks(html)]


@pytest.mark.parametrize(
    "html, want",
    [
        ("<html><head><title>T</title><article><p>One<p>Two</article>", ["One", "Two"]),
        ("<head><title>T</title><meta charset=utf-8><script>x()</script>Plain text", ["Plain text"]),
        ("<html><head><style>p {}</style></head><body><p>One", ["One"]),
        ("<head><title>T</title>\n<body>One", ["One"]),
        ("<head><noscript><p>unseen</p></noscript><div>One</div>", ["One"]),
    ],
)
def test_an_open_head_ends_at_the_first_content(html, want):
    assert texts(html) == want


def test_formulas_are_text():
    assert texts("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> hold.</p></article>") == ["Let x=1 hold."]


# Pages written by hand, not by the generator of the training pages.
PAGES = [
    ("<article><p>This is one sentence, complete.</p></article>", "This is one sentence, complete."),
    ("<main><p>Article text is here, and it is long enough to read.</p></main><div class='fb-talkback'>Great post, thanks for it.</div>",
     "Article text is here, and it is long enough to read."),
    ("Just a plain text without any tags.", "Just a plain text without any tags."),
    ("<p>One paragraph only.</p>", "One paragraph only."),
    ("<html><body><div><p>Only this.</p></div></body></html>", "Only this."),
    ("<article>Text right inside the element.</article>", "Text right inside the element."),
    ("<article><p>Body text of the article, first part.</p><button>Buy now</button><p>Second part of it.</p></article>",
     "Body text of the article, first part.\nSecond part of it."),
    ("<article><p>Body text of the article, first part.</p><div style='display:none'>Hidden words are here.</div><p>Second part of it.</p></article>",
     "Body text of the article, first part.\nSecond part of it."),
    ("<article><h1>Title</h1><p>One line.</p></article><footer>© 2020 Us</footer>", "Title\nOne line."),
    ("<nav><a href='/'>Home</a></nav><article><p>Short.</p></article>", "Short."),
    ("<div class='zzz'><p>Some text of the page, that goes on for a while.</p><p>And more text.</p></div>",
     "Some text of the page, that goes on for a while.\nAnd more text."),
    ("<section><h2>Head</h2><p>Text of the section here.</p></section>", "Head\nText of the section here."),
    ("<article><h1>Rights</h1><p>What this law says.</p><p>All rights reserved.</p></article><div class='cookie-notice'>We use cookies.</div>",
     "Rights\nWhat this law says.\nAll rights reserved."),
    ("", ""), ("<html><body></body></html>", ""),
]


@pytest.fixture(scope="module")
def chain():
    from foldwise.llm import html_crf

    return html_crf.fit()


@pytest.mark.parametrize("html, want", PAGES)
def test_hand_written_pages(chain, html, want):
    from foldwise.llm.html_crf import main_text

    assert main_text(html, chain) == want


def test_likelihood_gradient():
    """One step of the fit moves the weights along the gradient that finite differences give."""
    import itertools

    import numpy as np

    from foldwise.llm import html_crf

    data = [(html_crf.block_features(b), y) for b, y in html_crf.labelled_blocks(60) if b and len(b) < 9][:4]
    names = sorted({f for x, _ in data for fs in x for f in fs})
    assert len(data) == 4

    def likelihood(w, s):
        total = 0.0
        for x, y in data:
            e = [sum(w[f] for f in fs) for fs in x]
            score = lambda z: sum(e[k] * z[k] for k in range(len(z))) + sum(s[a][b] for a, b in zip(z, z[1:]))  # noqa: B023, E731
            total += score(y) - np.log(sum(np.exp(score(z)) for z in itertools.product((0, 1), repeat=len(x))))
        return total / len(data)

    zero, flat, h = dict.fromkeys(names, 0.0), [[0.0, 0.0], [0.0, 0.0]], 1e-5
    slope = {f: (likelihood({**zero, f: h}, flat) - likelihood({**zero, f: -h}, flat)) / (2 * h) for f in names}
    original = html_crf.labelled_blocks
    html_crf.labelled_blocks = lambda pages, first=0: [(b, y) for b, y in original(60) if b and len(b) < 9][:4]
    try:
        chain = html_crf.fit(60, steps=1, ridge=0.0)
    finally:
        html_crf.labelled_blocks = original
    for f in names:
        # the first adaptive step is 0.5 in the gradient's direction, where the gradient is not tiny
        if abs(slope[f]) > 1e-2:
            assert chain.weights[f] == pytest.approx(0.5 * np.sign(slope[f]), rel=1e-2), f
        g2 = slope[f] ** 2
        assert chain.weights[f] == pytest.approx(0.5 * slope[f] / np.sqrt(1e-8 + g2), abs=1e-3)
