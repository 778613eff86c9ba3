"""HTML text as a tree of elements and text blocks, with features for labelling them."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never running text.
SKIPPED = frozenset("head title script style template svg iframe canvas audio video select textarea button datalist map".split())
#: Those of them that end at their own end tag only, and those that may stand inside each other.
RAW, NESTED = frozenset("title script style iframe textarea".split()), frozenset("template svg".split())
#: Start tags that leave an open head open.
IN_HEAD = frozenset("head title script style template base basefont bgsound link meta noscript html".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption legend".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption html body legend".split())
#: A start tag ends an open element of these, unless one of the second set stands between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tbody": (("tr", "tbody", "thead"), ("table",)), "option": (("option",), ("select",)),
}
P_SCOPE = frozenset("table td th caption button object html template".split())
A_SCOPE = P_SCOPE | BLOCK
ENDS = {tag: (frozenset(tags), frozenset(stop)) for tag, (tags, stop) in ENDS.items()}
NONE = frozenset()
#: Elements nested deeper hang on their ancestor at this depth, as in browsers; their text stays.
MAX_DEPTH = 512
_KINDS = (BLOCK, P_SCOPE, A_SCOPE, *{k for pair in ENDS.values() for k in pair})
#: The kinds of elements that a tag belongs to.
KINDS_OF = {tag: tuple(k for k in dict.fromkeys(_KINDS) if tag in k) for tag in frozenset().union(*_KINDS)}
TAGS = ("text", "body", "article", "main", "section", "div", "p", "h1", "h2", "h3", "li", "ul", "ol", "nav", "header", "footer", "aside", "form", "table", "td", "blockquote", "pre", "figure", "figcaption", "dl", "dd", "other")
#: Words in class, id and role attributes, by what they hint at.
HINTS = {
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs tabs toc pagination pager skip",
    "header": "header masthead banner topbar branding logo site-header head",
    "footer": "footer contentinfo copyright legal colophon bottom imprint",
    "side": "sidebar side aside widget complementary rail secondary",
    "advert": "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion promoted dfp",
    "notice": "cookie cookies consent notice gdpr alert popup modal dialog overlay message announcement warning privacy toast",
    "form": "form search login signin signup subscribe newsletter subscription contact register",
    "comment": "comment comments comentarios discussion disqus replies reply respond reader responses feedback",
    "share": "share sharing social follow like tweet facebook related recommended more-stories recirc tags tag",
    "content": "content article post entry story main text body prose page hentry articlebody post-content entry-content article-body maincontent",
}
_HINT_OF = {w: kind for kind, ws in HINTS.items() for w in ws.split()}
_SPLIT = re.compile(r"[^a-z]+")
_ATTRIBUTE, _IS, _BARE = re.compile(r"[\s/]*[^\s/>=]*"), re.compile(r"\s*=+\s*([\"']?)"), re.compile(r"[^>\s]*")


class Node:
    __slots__ = ("parent", "tag", "hints", "depth", "text", "chars", "linked", "kids")

    def __init__(self, parent: int, tag: str, hints: frozenset[str], depth: int):
        self.parent, self.tag, self.hints, self.depth, self.text = parent, tag, hints, depth, ""
        self.chars = self.linked = self.kids = 0


def hints_of(attrs: list[tuple[str, str | None]]) -> frozenset[str]:
    found = set()
    for name, value in attrs:
        if value and name in ("class", "id", "role"):
            low = value.lower()
            for word in (*low.split(), *_SPLIT.split(low)):
                if kind := _HINT_OF.get(word):
                    found.add(kind)
    return frozenset(found)


class Tree(HTMLParser):
    """Nodes in page order, each after its parent. Text blocks are nodes of tag ``text``."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node(-1, "body", frozenset(), 0)]
        self.open: list[tuple[str, int]] = [("body", 0)]
        #: Places in ``open`` of each tag and each kind of tags, so that the last one is found without a search.
        self.places: dict[str | frozenset, list[int]] = {}
        self.last_ends: dict[str, int] = {}
        self.skip: list[str] = []
        self.links = 0
        self.words: list[str] = []
        self.linked = 0
        self.html, self.lines = html, [0]
        for m in re.finditer("\n", html):
            self.lines.append(m.end())
        self.dead: set[int] = set()
        self.searched: dict[str, int] = {}
        self.closing = False
        whole = html.rfind(">") + 1  # no tag after it has an end
        self.feed(html[:whole])
        self.searched, self.closing = {}, True
        if self.rawdata.startswith("<!--"):
            self.rawdata = ""  # an unclosed comment goes to the end of the page
        else:
            self.close()
            if not self.cdata_elem:
                self.handle_data(unescape(html[whole:].partition("<!--")[0]))
        self.flush()
        for i in range(len(self.nodes) - 1, 0, -1):
            n = self.nodes[i]
            up = self.nodes[n.parent]
            up.chars += n.chars
            up.linked += n.linked
            up.kids += n.tag in ("p", "text")

    def last_place(self, text: str) -> int:
        """Where ``text`` stands last in what is parsed, sought once."""
        if text not in self.searched:
            self.searched[text] = self.rawdata.rfind(text)
        return self.searched[text]

    def parse_comment(self, i: int, report: bool = True) -> int:
        return super().parse_comment(i, report) if not self.closing or self.last_place("--") > i else -1

    def parse_marked_section(self, i: int, report: bool = True) -> int:
        return super().parse_marked_section(i, report) if not self.closing or self.last_place("]") > i else -1

    def check_for_whole_start_tag(self, i: int) -> int:
        return super().check_for_whole_start_tag(i) if not self.closing or self.closed(i) else -1

    def closed(self, i: int) -> bool:
        """Whether the start tag at ``i`` has an end. Asked once a first one had none; what leads nowhere is remembered, so all scans together read the page once."""
        raw, path, p = self.rawdata, [], i + 1
        while p < len(raw) and raw[p] != ">" and p not in self.dead:
            path.append(p)
            p = max(_ATTRIBUTE.match(raw, p).end(), p + 1)
            if value := _IS.match(raw, p):
                p = value.end()
                if quote := value[1]:
                    p = raw.find(quote, p) + 1 if self.last_place(quote) >= p else len(raw)
                else:
                    p = _BARE.match(raw, p).end()
        if p < len(raw) and raw[p] == ">":
            return True
        self.dead.update(path)
        return False

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            node = self.nodes[self.node(self.open[-1][1], "text", NONE)]
            node.text, node.chars, node.linked = text, len(text), min(self.linked, len(text))
        self.words, self.linked = [], 0

    def node(self, parent: int, tag: str, hints: frozenset[str]) -> int:
        if self.nodes[parent].depth >= MAX_DEPTH:
            parent = self.nodes[parent].parent
        self.nodes.append(Node(parent, tag, hints, self.nodes[parent].depth + 1))
        return len(self.nodes) - 1

    def push(self, tag: str, parent: int) -> None:
        for k in (tag, *KINDS_OF.get(tag, ())):
            self.places.setdefault(k, []).append(len(self.open))
        self.open.append((tag, parent))
        self.links += tag == "a"

    def shut(self, at: int) -> None:
        """Close the open elements from place ``at`` on."""
        if any(t in BLOCK for t, _ in self.open[at:]):
            self.flush()
        while len(self.open) > at:
            tag, _ = self.open.pop()
            self.links -= tag == "a"
            for k in (tag, *KINDS_OF.get(tag, ())):
                self.places[k].pop()

    def last(self, tags: str | frozenset, stop: frozenset = NONE) -> int:
        """Place of the last open element of ``tags``, 0 if there is none or one of ``stop`` stands after it."""
        at, wall = self.places.get(tags), self.places.get(stop)
        return at[-1] if at and (not wall or at[-1] >= wall[-1]) else 0

    def ends(self, tag: str) -> bool:
        """Whether the element of the current start tag has an end tag: after it, and before the next start tag unless these may nest."""
        line, column = self.getpos()
        here = self.lines[line - 1] + column + 1
        if tag in NESTED:
            if tag not in self.last_ends:
                self.last_ends[tag] = max((m.start() for m in re.finditer(f"</{tag}(?=[\\s/>])", self.html, re.IGNORECASE)), default=-1)
            return self.last_ends[tag] >= here
        m = re.compile(f"</?{tag}(?=[\\s/>])", re.IGNORECASE).search(self.html, here)
        return m is not None and m[0][1] == "/"

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "body" or self.skip == ["head"] and tag not in IN_HEAD:
            self.skip.clear()
        if self.skip:
            if self.skip[-1] not in RAW and (tag in RAW or tag in BLOCK - VOID or tag in SKIPPED and self.ends(tag)):
                self.skip.append(tag)
            return
        if tag in SKIPPED:
            if tag == "head" or tag in RAW or self.ends(tag):
                self.skip.append(tag)
            return
        if tag in ("html", "body"):
            self.nodes[0].hints |= hints_of(attrs) & {"content"}
            return
        if tag == "br":
            self.words.append(" ")
            return
        if tag in CLOSES_P and (at := self.last("p", P_SCOPE)):
            self.shut(at)
        if tag in ENDS and (at := self.last(*ENDS[tag])):
            while nxt := self.last(*ENDS[tag]):
                at = min(at, nxt)
                self.shut(nxt)
        if tag == "a" and (at := self.last("a", A_SCOPE)):
            self.shut(at)
        if tag in BLOCK:
            self.flush()
        if tag in VOID:
            return
        parent = self.open[-1][1]
        if tag in BLOCK:
            parent = self.node(parent, tag, hints_of(attrs))
        self.push(tag, parent)

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag in self.skip:
                while self.skip.pop() != tag:
                    pass
                return
            if tag in ("body", "html"):
                self.skip.clear()
            if tag not in BLOCK or self.skip and self.skip[-1] in RAW or not self.last(tag):
                return
            self.skip.clear()  # the end of a block around it ends what is skipped
        if tag in VOID or tag in ("html", "body"):
            return
        if at := self.last(tag, NONE if tag in BLOCK else BLOCK):
            self.shut(at)

    def handle_data(self, data: str) -> None:
        if self.skip == ["head"] and data.strip():
            self.skip.clear()
        if not self.skip:
            self.words.append(data)
            if self.links:
                self.linked += len("".join(data.split()))


_FEATURES: dict[str, int] = {}
for _name in ("bias", *(f"tag:{t}" for t in TAGS), *(f"hint:{h}" for h in HINTS), *(f"up:{h}" for h in HINTS), *(f"in:{t}" for t in ("article", "main", "nav", "header", "footer", "aside", "form")), *(f"size:{i}" for i in range(6)), *(f"link:{i}" for i in range(4)), *(f"kids:{i}" for i in range(4)), "sentence", "sign", "first", "leaf"):
    _FEATURES[_name] = len(_FEATURES)
N_FEATURES = len(_FEATURES)
#: Kinds of parent-child pairs, each with potentials of its own.
EDGES = ("text", "body", "article", "generic", "hinted")


def features(nodes: list[Node]) -> list[list[int]]:
    f, out = _FEATURES, []
    for i, n in enumerate(nodes):
        ids = [f["bias"], f["tag:" + (n.tag if n.tag in TAGS else "other")]]
        ids += [f["hint:" + h] for h in n.hints]
        up = nodes[n.parent] if n.parent >= 0 else None
        if up:
            ids += [f["up:" + h] for h in up.hints]
            if up.tag in ("article", "main", "nav", "header", "footer", "aside", "form"):
                ids.append(f["in:" + up.tag])
        ids.append(f[f"size:{(n.chars > 0) + (n.chars > 25) + (n.chars > 80) + (n.chars > 200) + (n.chars > 800)}"])
        share = n.linked / n.chars if n.chars else 0
        ids.append(f[f"link:{(share > 0.1) + (share > 0.4) + (share > 0.8)}"])
        ids.append(f[f"kids:{(n.kids > 0) + (n.kids > 2) + (n.kids > 5)}"])
        if n.tag == "text":
            ids.append(f["leaf"])
            if n.text[-1] in ".!?…:\"”»)":
                ids.append(f["sentence"])
            if "©" in n.text or "|" in n.text:
                ids.append(f["sign"])
        if i == 1:
            ids.append(f["first"])
        out.append(ids)
    return out


def edge_kinds(nodes: list[Node]) -> list[int]:
    out = []
    for n in nodes:
        up = nodes[n.parent] if n.parent >= 0 else n
        if n.tag == "text":
            kind = "text"
        elif up.hints - {"content"} or up.tag in ("nav", "header", "footer", "aside", "form"):
            kind = "hinted"
        elif up.tag == "body":
            kind = "body"
        elif up.tag in ("article", "main") or "content" in up.hints:
            kind = "article"
        else:
            kind = "generic"
        out.append(EDGES.index(kind))
    return out
