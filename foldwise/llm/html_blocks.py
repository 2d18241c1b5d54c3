"""Leaf blocks of a page with the tags above them, from the standard library's tolerant parser."""

from __future__ import annotations

from html.parser import HTMLParser

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time "
    "tt u var wbr br "
    # MathML
    "annotation maction math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt "
    "mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
HEAD_CONTENT = frozenset("title meta link base basefont bgsound noframes script style template noscript".split())
UNSEEN = frozenset("script style template noscript head title svg iframe object canvas audio video select option textarea datalist button".split())
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre "
    "section table ul".split()
)
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
            "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Blocks(HTMLParser):
    """Collects ``(path, text, characters inside links)``; the path is a tuple of (tag, class and id text)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, str]] = []
        self.out: list[tuple[tuple, str, int]] = []
        self.parts: list[str] = []
        self.unseen = self.links = self.linked = 0
        self.at: tuple = ()

    def _flush(self):
        text = " ".join("".join(self.parts).split())
        if text:
            self.out.append((self.at, text, self.linked))
        self.parts, self.linked = [], 0

    def _pop(self, k: int):
        for tag, _ in self.stack[k:]:
            self.unseen -= tag in UNSEEN
            self.links -= tag == "a"
        del self.stack[k:]

    def _close_until(self, tags: set, stop: set):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] in stop:
                return
            if self.stack[k][0] in tags:
                self._pop(k)
                return

    def _in_head(self) -> bool:
        """Directly in a head, whose end tag may be left out."""
        return bool(self.stack) and self.stack[-1][0] == "head"

    def handle_starttag(self, tag, attrs):
        if tag == "body":
            self._flush()
            self._pop(0)  # whatever the head left open
        elif self._in_head() and tag not in HEAD_CONTENT and tag not in ("html", "head"):
            self._flush()
            self._pop(len(self.stack) - 1)
        if tag not in INLINE:
            self._flush()
        if tag == "br":
            self.parts.append(" ")
        if tag in ENDS_P:
            self._close_until({"p"}, {"table", "td", "th", "button", "object"})
        if tag in SIBLINGS:
            self._close_until(*SIBLINGS[tag])
        if tag in VOID:
            return
        names = " ".join(v for k, v in attrs if k in ("class", "id", "role", "itemprop") and v)
        if any(k == "hidden" or (k == "style" and v and "display:none" in v.replace(" ", "").lower()) or (k == "aria-hidden" and v == "true") for k, v in attrs):
            names += " hiddenelement"
        self.stack.append((tag, names))
        self.unseen += tag in UNSEEN
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.stack and self.stack[-1][0] == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self._flush()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                self._pop(k)
                break

    def handle_data(self, data):
        if self._in_head() and data.strip():
            self._pop(len(self.stack) - 1)
        if self.unseen > 0 or not data:
            return
        if not self.parts or not "".join(self.parts[-1:]).strip():
            self.at = tuple(x for x in self.stack if x[0] not in INLINE)
        self.parts.append(data)
        if self.links > 0:
            self.linked += len(data.strip())


def leaf_blocks(html: str | None) -> list[tuple[tuple, str, int]]:
    """Visible text blocks of a page in page order; a null or empty page has none."""
    p = Blocks()
    p.feed(html or "")
    p.close()
    p._flush()
    return p.out
