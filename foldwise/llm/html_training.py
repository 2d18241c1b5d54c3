"""Labelled pages for the extractor: layouts drawn from fixed parts, each block marked as article or not."""

from __future__ import annotations

import random

# Names that pages commonly give to their parts.
SHELLS = ["<article>", "<main>", '<div class="content">', '<div id="content">', '<div class="post-content">', '<div class="entry-content">', '<div class="article-body">',
          '<section class="story">', '<div role="main">', '<article class="post">', '<main id="main"><article>', '<div class="page"><div class="text">', "<div>", '<section>',
          '<div class="container"><article>', '<div itemprop="articleBody">']
NAVS = ["<nav>", '<div class="menu">', '<div id="nav">', '<ul class="navbar">', '<div class="topnav">', '<nav class="breadcrumb">', '<div role="navigation">', '<div class="pagination">', '<div class="main-menu">']
TOPS = ["<header>", '<div id="header">', '<div class="masthead">', '<div class="site-header">', '<header class="page-header">', '<div class="top-bar">', '<div class="logo">']
FEET = ["<footer>", '<div id="footer">', '<div class="site-footer">', '<div class="copyright">', '<footer class="foot">', '<div class="legal">']
SIDES = ["<aside>", '<div class="sidebar">', '<div id="sidebar">', '<div class="widget">', '<aside class="related">', '<div class="related-posts">', '<div class="side-column">', '<div class="recommended">', '<div class="trending">', '<div class="share social">', '<div class="author-bio">', '<div class="tags">']
NOTES = ['<div class="cookie-notice">', '<div id="consent">', '<div class="gdpr banner">', '<div class="notice">', '<div class="alert">', '<div class="popup modal">', '<div class="paywall">', '<div role="alert">', '<div class="cookie-banner">', '<section class="announcement">', '<div role="dialog">']
ADS = ['<div class="ad">', '<div class="ads">', '<div class="advert">', '<div class="advertisement">', '<div class="sponsored">', '<div class="promo">', '<div id="ad-slot">', '<aside class="ad-box">', '<div class="banner-ad">', '<ins class="adsbygoogle">']
TALKS = ['<div class="comments">', '<section id="comments">', '<ol class="commentlist">', '<div id="disqus_thread">', '<div class="comment-section">', '<ul class="responses">', '<div class="discussion">', '<section class="reader-comments">', '<div class="replies">']
FORMS = ["<form>", '<form class="search">', '<div class="newsletter"><form>', '<form id="subscribe">', '<div class="login"><form>', '<div class="signup">', '<fieldset>']
HIDDEN = ['<div style="display:none">', '<p hidden>', '<div aria-hidden="true">', '<span style="display: none">', '<section hidden>']
LINES = ["All rights reserved.", "Read more about this below.", "Share what you know.", "Comment is free.", "Copyright law is old.", "Subscribe!", "Related work.", "Cookie.", "Yes.", "Short."]
SHORT = ["Home", "About us", "Contact", "Read more", "Share", "Sign in", "Subscribe", "Next", "Older posts", "Search", "Privacy", "Terms", "Menu", "Reply"]


def _close(opening: str) -> str:
    tags = [t.split()[0].rstrip(">") for t in opening.split("<")[1:]]
    return "".join(f"</{t}>" for t in reversed(tags))


class Draw:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = "etaoinsrhldcumfpgwybvk"
        self.words = ["".join(self.r.choice(letters) for _ in range(self.r.randint(1, 9))) for _ in range(300)]

    def text(self, low: int, high: int) -> str:
        w = [self.r.choice(self.words) for _ in range(self.r.randint(low, high))]
        for k in range(0, len(w), self.r.randint(6, 14)):
            w[k] = w[k].capitalize()
            if k:
                w[k - 1] += self.r.choice([".", ",", "?"])
        return " ".join(w) + self.r.choice([".", ".", ".", "", "!"])

    def article(self) -> list[tuple[str, int]]:
        out = [(f"<h1>{self.text(2, 9)}</h1>", 1)] if self.r.random() < 0.8 else []
        for _ in range(self.r.choice([1, 1, 2, 4, 8, 12])):
            k = self.r.random()
            if k < 0.66:
                out.append((f"<p>{self.text(1, 80)}</p>", 1))
            elif k < 0.74:
                out.append((f"<h2>{self.text(1, 7)}</h2>", 1))
            elif k < 0.82:
                out += [(f"<{t}>{self.text(1, 15)}</{t}>", 1) for t in ["li"] * self.r.randint(2, 4)]
            elif k < 0.87:
                out.append((f"<blockquote>{self.text(5, 30)}</blockquote>", 1))
            elif k < 0.90:
                out.append((f"<pre>{self.text(5, 30)}</pre>", 1))
            elif k < 0.93:
                out.append((f"<figure><figcaption>{self.text(3, 12)}</figcaption></figure>", 1))
            elif k < 0.96:
                out.append((f"<table><tr><td>{self.text(1, 4)}</td></tr></table>", 1))
            else:
                out.append((f"<p>{self.text(3, 20)} <a href='/x'>{self.text(1, 4)}</a> {self.text(3, 20)}</p>", 1))
            if self.r.random() < 0.08:  # words of other parts may stand in an article as well
                out.append((f"<p>{self.r.choice(LINES)}</p>", 1))
            if self.r.random() < 0.1:
                out += self.part(self.r.choice([ADS, ADS, SIDES, FORMS, NOTES, HIDDEN, HIDDEN]))
        return out

    def unnamed(self, shell: str) -> str:
        """The part's shell under a name that no list has."""
        return f'<{self.r.choice(["div", "section", "div"])} class="{self.r.choice(self.words)}-{self.r.choice(self.words)}">' if shell.startswith(("<div", "<section", "<ins")) else shell

    def part(self, names: list[str], strange: bool = False) -> list[tuple[str, int]]:
        shell = self.r.choice(names)
        shell = self.unnamed(shell) if strange else shell
        n = self.r.randint(1, 6 if names in (NAVS, TALKS) else 3)
        if names is NAVS:
            inner = [f"<li><a href='/x'>{self.r.choice(SHORT) if self.r.random() < 0.5 else self.text(1, 3)}</a></li>" for _ in range(n)]
        elif names is FORMS:
            inner = [f"<label>{self.text(1, 4)}</label><input><button>{self.r.choice(SHORT)}</button><p>{self.text(2, 15)}</p>"]
        elif names is TALKS:
            c = self.r.choice(['<div class="comment">', "<li>", "<div>", '<article class="comment">'])
            inner = [f"{c}<p>{self.text(2, 50)}</p>{_close(c)}" for _ in range(n)]
        elif names is FEET:
            inner = [f"<p>&copy; {self.text(1, 8)}</p>" if self.r.random() < 0.5 else f"&copy; {self.text(2, 12)}"]
        else:
            t = self.r.choice(["p", "div", "li", "h3", "span", "p"])
            inner = [f"<{t}>{self.text(1, 30)}</{t}>" for _ in range(n)]
        # what stands before the first block belongs to it: a label is taken per leaf block, see page()
        return [(shell + "".join(inner) + _close(shell), 0)]


def page(seed: int) -> tuple[list[str], list[int]]:
    """Pieces of HTML of one page in order, and for each piece whether its text belongs to the article.

    Some pages are one block, with or without tags; around an article or main element, some parts have names that no list has.
    """
    d = Draw(seed)
    if d.r.random() < 0.05:
        return ["", d.text(1, 80), ""], [0, 1, 0]
    shell = d.r.choice(SHELLS)
    shell = d.unnamed(shell) if d.r.random() < 0.2 and not shell.startswith("<div class=\"container") and shell.count("<") == 1 else shell
    short = d.r.random() < 0.15
    alone = short and d.r.random() < 0.5
    strange = lambda: shell.startswith(("<article", "<main")) and d.r.random() < 0.3
    drawn = lambda parts: [] if alone else [p for names, chance in parts if d.r.random() < chance for p in d.part(names, strange())]
    before = [] if d.r.random() < 0.25 else drawn(((NOTES, 0.35), (TOPS, 0.45), (NAVS, 0.65), (ADS, 0.45), (FORMS, 0.2), (SIDES, 0.25), (HIDDEN, 0.1)))
    after = [] if d.r.random() < 0.1 else drawn(((TALKS, 0.5), (SIDES, 0.5), (ADS, 0.3), (FORMS, 0.3), (NAVS, 0.2), (FEET, 0.75), (NOTES, 0.2), (HIDDEN, 0.1)))
    inside = [(f"<p>{d.text(1, d.r.choice([3, 60]))}</p>", 1)] if short else d.article()
    tail = d.part(d.r.choice([SIDES, TALKS, ADS])) if d.r.random() < 0.2 and not alone else []
    pieces = [*before, (shell, None), *inside, *tail, (_close(shell), None), *after]
    wrap = d.r.random() < 0.3
    head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{d.text(2, 8)}</title><script>var a="</p>";</script></head><body>' + ('<div class="wrapper">' if wrap else "")
    return [head, *[p for p, _ in pieces], "</div>" * wrap + "</body></html>"], [0, *[m if m is not None else -1 for _, m in pieces], 0]
