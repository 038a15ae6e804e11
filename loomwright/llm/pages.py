"""Main text of web pages: a graphical model over the DOM tree says which blocks are content.

Each block element is a node with a binary variable, content or not. Its features weigh for or against content, and a
potential ties it to its parent. Sum-product message passing, up from the leaves and down from the root, gives every
node's exact marginal. Weights maximize the likelihood of labelled pages (see ``labelled_pages``), with the same
marginals as gradient. Blocks whose marginal is 1/2 or more are the text.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
EMBEDDED = frozenset("button select object svg math canvas video audio noscript template".split())
NARROW = frozenset("button select svg math".split())
UNSEEN = frozenset("button select template".split())
FOREIGN = frozenset("svg math".split())
LEAVES_FOREIGN = frozenset("blockquote body center dd div dl dt h1 h2 h3 h4 h5 h6 head hr li listing menu ol p pre ruby table ul article section main aside nav header footer form figure details fieldset address".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
ROWS = frozenset("tr tbody tfoot thead".split())
# Words of class, id and role names.
GROUPS = {
    "ad": "ad ads adv advert adverts advertisement adsense banner promo promotion promoted sponsor sponsored sponsors commercial",
    "comment": "comment comments commentlist commenter reply replies respond response responses discussion disqus reader readers feedback guestbook",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs crumbs toc pagination pager tabs tab links toolbar topbar skip",
    "foot": "footer foot footnav copyright legal colophon contentinfo imprint bottom",
    "head": "header masthead head logo branding sitename tagline site top hero",
    "side": "sidebar side aside widget widgets rail complementary tags archive archives tagcloud",
    "notice": "cookie cookies consent notice notices alert popup modal overlay gdpr privacy warning message banner dialog paywall announcement toast",
    "form": "form login signin signup register subscribe subscription newsletter search input contact optin",
    "share": "share sharing social follow twitter facebook buttons print",
    "related": "related recommended recommendations more popular trending also similar teaser teasers read",
    "content": "content article articlebody post story entry main maincontent body text prose page blog",
}
WORD_GROUP = {w: g for g, words in GROUPS.items() for w in words.split()}

#: A tag, without going back over what was read: quotes count only where a value begins, as browsers have it; a quote that
#: is never closed is a character like others.
ATTRIBUTE = r"""[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+|="""
TAG = re.compile(rf"<(/?)([a-zA-Z][^\s/>]*+)((?>[\s/]++|{ATTRIBUTE})*+)>", re.S)
NAMED = re.compile(r"""([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?+)?+""")
COMMENT_END = re.compile(r"--!?>")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
NOT_SHOWN = re.compile(r"display\s*:\s*none", re.I)


#: Elements that a page's head may hold; the first other one ends it, as does text.
IN_HEAD = {"base", "basefont", "bgsound", "head", "html", "link", "meta", "noframes", "noscript", "script", "style", "template", "title"}


class Tree:
    """Elements in page order (parents first) and the blocks of text that stand in them.

    Inline elements are no nodes; what is embedded in a line (EMBEDDED) is a node, but doesn't end the block it stands in.
    Reading goes forward only: open elements are found by their tags, so time is in proportion to the page's length."""

    def __init__(self, page: str, labelled: bool = False):
        self.tag, self.parent, self.names, self.label = ["#root"], [-1], [frozenset()], [1]
        self.runs: list[list[tuple[int, str]]] = []  # of each block: (node, text)
        self.linked: list[int] = [0]
        self.text: list[int] = [0]
        self.labelled = labelled
        self.stack: list[tuple[str, int]] = [("#root", 0)]  # open elements and the node they are in
        self.places: dict[str, list[int]] = {}  # where in the stack elements of a tag are
        self.walls = [0]  # where in the stack elements are that aren't inline
        self.links: list[int] = []  # where in the stack anchors with a target are
        self.fresh = True
        self.in_head = self.had_head = False
        self.build(page)

    def build(self, page: str) -> None:
        at, end, ends = 0, len(page), LastEnds(page)
        while at < end:
            mark = page.find("<", at)
            if mark < 0:
                mark = end
            if mark > at:
                self.write(page[at:mark])
            if mark + 1 >= end:
                self.write(page[mark:])
                break
            after = page[mark + 1]
            if after in "!?" or after == "/" and not page[mark + 2 : mark + 3].isalpha():
                if page.startswith("<!--", mark):
                    empty = page.startswith((">", "->"), mark + 4)
                    close = COMMENT_END.search(page, mark + 4)
                    at = page.index(">", mark + 4) + 1 if empty else close.end() if close else end
                else:
                    at = page.find(">", mark) + 1 or end
                continue
            if after != "/" and not (after.isascii() and after.isalpha()):
                self.write("<")
                at = mark + 1
                continue
            m = TAG.match(page, mark)
            if not m:
                break  # a tag that the page ends in
            at, tag = m.end(), m[2].lower()
            foreign = self.stack[self.walls[-1]][0] in FOREIGN and tag not in LEAVES_FOREIGN and tag not in ("script", "style")
            if self.in_head and (tag == "head" if m[1] else tag not in IN_HEAD):
                self.in_head = False
            if m[1]:
                self.close(tag)
            elif foreign:
                if not m[3].endswith("/") and tag not in VOID:
                    self.push(tag, self.stack[-1][1])
            elif tag in RAW:
                at = ends.after(tag, at)
            elif tag == "head":
                self.in_head, self.had_head = not self.had_head, True
            elif tag in INLINE or tag in VOID:
                if tag == "br" and self.runs and not self.fresh:
                    self.runs[-1].append((-1, " "))
                self.fresh |= tag == "hr"
                if tag not in VOID and not m[3].endswith("/"):
                    if tag == "a":
                        self.close(tag)  # an anchor ends at the next one
                        if any(x[1].lower() == "href" for x in NAMED.finditer(m[3])):
                            self.links.append(len(self.stack))
                    self.push(tag, self.stack[-1][1])
            elif tag in EMBEDDED:
                if not m[3].endswith("/") and (tag in FOREIGN or ends.later(tag, at)):
                    self.push(tag, self.node(tag, m[3]), wall=True)
            else:
                self.imply_ends(tag)
                self.push(tag, self.node(tag, m[3]), wall=True)
                self.fresh = True

    def write(self, piece: str) -> None:
        node, n = self.stack[-1][1], len(piece.strip())
        if self.in_head:
            if not n:
                return
            self.in_head = False  # text can't be in the head
        if self.fresh:
            self.runs.append([])
            self.fresh = False
        self.runs[-1].append((node, piece))
        self.text[node] += n
        if self.links and self.links[-1] > self.walls[-1]:
            self.linked[node] += n

    def node(self, tag: str, attributes: str) -> int:
        found: dict[str, str] = {}
        if attributes:
            for m in NAMED.finditer(attributes):
                found.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
        words = {w.lower() for k in ("class", "id", "role") if k in found for w in NAME_WORD.findall(found[k])}
        hidden = {"hidden"} if "hidden" in found or NOT_SHOWN.search(found.get("style", "")) else set()
        self.tag.append(tag)
        self.parent.append(self.stack[-1][1])
        self.names.append(frozenset(WORD_GROUP[w] for w in words if w in WORD_GROUP) | hidden)
        self.label.append(int(found.get("data-y") or 0) if self.labelled else 0)
        self.text.append(0)
        self.linked.append(0)
        return len(self.tag) - 1

    def push(self, tag: str, node: int, wall: bool = False) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        if wall:
            self.walls.append(len(self.stack))
        self.stack.append((tag, node))

    def cut(self, k: int) -> None:
        """Ends the open elements from place k of the stack on."""
        while len(self.stack) > k:
            tag, _ = self.stack.pop()
            self.places[tag].pop()
            if self.links and self.links[-1] == len(self.stack):
                self.links.pop()
            if self.walls[-1] == len(self.stack):
                self.walls.pop()
                self.fresh |= tag not in EMBEDDED

    def last(self, tags) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tag: str) -> None:
        """An end tag ends what it finds open; an inline one ends nothing across a block."""
        k = self.last((tag,))
        if k and not (tag in INLINE and k < self.walls[-1]):
            self.cut(k)

    def imply_ends(self, tag: str) -> None:
        """A block ends the paragraph it starts in, and what can't hold blocks; items, cells and rows end their like."""
        while self.stack[self.walls[-1]][0] in NARROW:
            self.cut(self.walls[-1])
        if self.stack[self.walls[-1]][0] == "p":
            self.cut(self.walls[-1])
        if tag in CLOSES:
            while (k := self.last(CLOSES[tag])) > self.last(SCOPES[tag]):
                self.cut(k)
                if tag not in ROWS:
                    break

    def features(self) -> list[list[str]]:
        n = len(self.tag)
        text, linked, paragraphs = self.text[:], self.linked[:], [0] * n
        for i in range(n - 1, 0, -1):
            text[self.parent[i]] += text[i]
            linked[self.parent[i]] += linked[i]
            paragraphs[self.parent[i]] += self.tag[i] == "p"
        out = []
        for i in range(n):
            on = ["bias", f"tag:{self.tag[i]}", f"in:{self.tag[self.parent[i]]}:{self.tag[i]}", *(f"name:{g}" for g in self.names[i])]
            if text[i]:
                on.append(f"links:{min(3, 4 * linked[i] // text[i])}")
                on.append(f"size:{min(4, int(math.log10(text[i])))}")
            else:
                on.append("empty")
            if paragraphs[i]:
                on.append(f"paragraphs:{min(3, paragraphs[i])}")
            out.append(on)
        return out

    def blocks(self, content: list[bool]) -> str:
        shown = [True] * len(self.tag)
        for i in range(1, len(self.tag)):
            shown[i] = shown[self.parent[i]] and self.tag[i] not in UNSEEN
        kept = [a and b for a, b in zip(content, shown, strict=True)] + [True]  # the last is that of line breaks
        texts = (" ".join("".join(entities.unescape(t) if "&" in t else t for node, t in run if kept[node]).split()) for run in self.runs)
        return "\n\n".join(t for t in texts if t)


class LastEnds:
    """Where end tags of an element are, each part of the page looked through once for each tag."""

    def __init__(self, page: str):
        self.page, self.final = page, {}

    def later(self, tag: str, at: int) -> bool:
        if tag not in self.final:
            self.final[tag] = max((m.start() for m in re.finditer(rf"</{tag}(?=[\s/>])", self.page, re.I)), default=-1)
        return self.final[tag] >= at

    def after(self, tag: str, at: int) -> int:
        """Behind the next end tag; the page's end if there is none."""
        if not self.later(tag, at):
            return len(self.page)
        start = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(self.page, at).start()
        return self.page.find(">", start) + 1 or len(self.page)


def softplus(x: float) -> float:
    return x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def passed(odds: float, tie: tuple[float, float, float, float]) -> float:
    """The message, as log odds, over an edge from a side with the log odds: tie[2 * own + other] is the edge's potential."""
    a, b, c, d = tie
    return (b + softplus(odds + d - b)) - (a + softplus(odds + c - a))


def marginals(parent: list[int], unary: list[float], down: tuple[float, ...]) -> tuple[list[float], list[float], list[float]]:
    """Log odds of each node being content given the whole tree; also what its subtree says and what it is told from above.

    down[2 * y_parent + y_child] is the potential of an edge."""
    n = len(parent)
    up_tie = (down[0], down[2], down[1], down[3])
    inside, message = unary[:], [0.0] * n
    for i in range(n - 1, 0, -1):
        message[i] = passed(inside[i], up_tie)
        inside[parent[i]] += message[i]
    total, above = inside[:], [0.0] * n
    for i in range(1, n):
        above[i] = passed(total[parent[i]] - message[i], down)
        total[i] = inside[i] + above[i]
    return total, inside, message


class Model:
    def __init__(self) -> None:
        self.weight: dict[str, float] = {}
        self.tie = [0.0] * 4

    def unary(self, features: list[list[str]]) -> list[float]:
        get = self.weight.get
        return [sum([get(f, 0.0) for f in on]) for on in features]

    def content(self, tree: Tree) -> list[bool]:
        return [x >= 0 for x in marginals(tree.parent, self.unary(tree.features()), tuple(self.tie))[0]]

    def fit(self, pages: list[str], rounds: int = 40, rate: float = 0.3, decay: float = 1e-3) -> Model:
        """Gradient ascent on the likelihood, page by page with AdaGrad steps."""
        trees = [Tree(p, labelled=True) for p in pages]
        given = [(t, t.features()) for t in trees]
        seen: dict[object, float] = {}

        def step(key: object, now: float, g: float) -> float:
            g -= decay * now
            seen[key] = seen.get(key, 1e-2) + g * g
            return now + rate * g / math.sqrt(seen[key])

        for _ in range(rounds):
            for tree, features in given:
                total, inside, message = marginals(tree.parent, self.unary(features), tuple(self.tie))
                slope: dict[str, float] = {}
                for on, y, odds in zip(features, tree.label, total, strict=True):
                    for f in on:
                        slope[f] = slope.get(f, 0.0) + y - sigmoid(odds)
                ties = [0.0] * 4
                for i in range(1, len(tree.parent)):
                    p = tree.parent[i]
                    ties[2 * tree.label[p] + tree.label[i]] += 1
                    rest = total[p] - message[i]  # the parent without this child
                    joint = [self.tie[2 * a + b] + a * rest + b * inside[i] for a in (0, 1) for b in (0, 1)]
                    top = max(joint)
                    shares = [math.exp(x - top) for x in joint]
                    for k in range(4):
                        ties[k] -= shares[k] / sum(shares)
                for f, g in slope.items():
                    self.weight[f] = step(f, self.weight.get(f, 0.0), g)
                self.tie = [step(k, self.tie[k], ties[k]) for k in range(4)]
        return self


#: Labelled pages the model is fitted to; a fixed number, whatever the corpus.
PAGES, SEED = 200, 11


def labelled_pages(n: int = PAGES, seed: int = SEED, unnamed: float = 0.25) -> Iterator[str]:
    """Pages of varied layouts whose elements say in data-y whether they are content; in a share of them, ``unnamed``, names tell nothing."""
    rng = random.Random(seed)
    telling = True

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(a, b)))

    def sentence(a: int = 3, b: int = 18) -> str:
        return words(a, b).capitalize() + "."

    def el(tag: str, y: int, inner: str, *names: str) -> str:
        name = rng.choice(names) if names else ""
        name = name if telling or not name else "".join(rng.choice("bcdfgkxz") for _ in range(rng.randint(3, 7))) + f"-{rng.randint(1, 99)}"
        kind = rng.choice(["class", "class", "id"])
        return f"<{tag}" + (f' {kind}="{name}"' if name else "") + f' data-y="{y}">{inner}</{tag}>'

    def links(n: int, y: int = 0) -> str:
        items = [f'<a href="/{words(1, 1)}">{words(1, 3)}</a>' for _ in range(n)]
        return el("ul", y, "".join(el("li", y, a) for a in items)) if rng.random() < 0.7 else " ".join(items)

    def paragraphs(n: int, y: int, *names: str) -> str:
        return "".join(el("p", y, " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 4, 8]))), *names) for _ in range(n))

    def inside() -> str:
        return rng.choice([
            lambda: el("div", 0, sentence(), "ad", "advert", "ad-slot", "sponsored", "promo"), lambda: el("aside", 0, links(3), "related", "", "more-stories"),
            lambda: el("div", 0, links(4), "share", "social-share"), lambda: el("form", 0, el("p", 0, sentence()) + "<input><button>Go</button>", "newsletter", "subscribe", ""),
            lambda: el("div", 0, el("p", 0, sentence()), "notice", "alert", "cookie-notice"), lambda: el("nav", 0, links(3), "", "toc", "breadcrumbs"),
            lambda: el(rng.choice(["video", "audio", "canvas", "svg"]), 0, words(2, 8)),
        ])()

    def article() -> str:
        parts = [el(rng.choice(["h1", "h1", "h2"]), 1, words(2, 9))]
        for _ in range(rng.randint(1, 7)):
            parts.append(rng.choice([
                lambda: paragraphs(rng.randint(1, 3), 1), lambda: paragraphs(rng.randint(1, 3), 1), lambda: el("p", 1, f'{sentence()} <a href="/">{words(1, 3)}</a> {sentence()}'),
                lambda: el("blockquote", 1, paragraphs(1, 1)), lambda: el("ul", 1, "".join(el("li", 1, sentence()) for _ in range(3))), lambda: el("h2", 1, words(1, 5)), lambda: el("h3", 1, words(1, 5)),
                lambda: el("figure", 1, "<img src='x.png'>" + el("figcaption", 1, sentence())), lambda: el("pre", 1, words(3, 9)), lambda: el("section", 1, el("h2", 1, words(1, 4)) + paragraphs(2, 1)),
                lambda: el("table", 1, el("tr", 1, el("td", 1, words(1, 3)) + el("td", 1, words(1, 3)))), lambda: el("div", 1, paragraphs(2, 1)), lambda: f'<p data-y="1"><b>{sentence()}<br>' + paragraphs(1, 1),
                lambda: el("p", 1, sentence() + el("math", 1, words(1, 3)) + sentence()), lambda: el("object", 1, paragraphs(1, 1)), lambda: el("noscript", 1, el("p", 1, sentence())),
            ])())
            if rng.random() < 0.12:
                parts.append(inside())
        return "".join(parts)

    def comments() -> str:
        one = lambda: el(rng.choice(["div", "li", "article"]), 0, el("p", 0, sentence()) + paragraphs(rng.randint(0, 2), 0), "comment", "reply", "comment-body", "")
        return el(rng.choice(["section", "div", "ol"]), 0, (el("h3", 0, words(1, 3)) if rng.random() < 0.5 else "") + "".join(one() for _ in range(rng.randint(1, 5))), "comments", "reader-comments", "responses", "disqus", "comment-list")

    def often(chance: float, make) -> str:
        return make() if rng.random() < chance else ""

    for _ in range(n):
        telling = rng.random() >= unnamed
        before = [
            often(0.5, lambda: el("header", 0, el("div", 0, words(1, 4), "logo", "tagline", "") + often(0.5, lambda: links(4)), "", "site-header", "masthead")), often(0.7, lambda: el("nav", 0, links(rng.randint(3, 8)), "", "menu", "main-nav")),
            often(0.2, lambda: el("div", 0, links(6), "menu", "navbar", "navigation")), often(0.3, lambda: el("div", 0, paragraphs(1, 0), "cookie-banner", "notice", "consent", "alert")), often(0.5, lambda: el("div", 0, sentence(), "ad", "ads", "banner", "advertisement")),
            often(0.15, lambda: el("div", 0, f"<p data-y='0'>{sentence()}</p>" + links(2), "header", "site-top")), often(0.15, lambda: el("noscript", 0, words(3, 9))),
        ]
        after = [
            often(0.4, comments), often(0.35, lambda: el("aside", 0, el("h3", 0, words(1, 3)) + often(0.6, lambda: links(5)) + paragraphs(rng.randint(0, 2), 0), "sidebar", "", "widget")), often(0.2, lambda: el("div", 0, el("h3", 0, words(1, 3)) + paragraphs(1, 0) + links(3), "sidebar", "side-rail", "widget")),
            often(0.25, lambda: el("form", 0, el("p", 0, sentence()) + "<input><button>Send</button>", "", "login", "search", "contact-form")), often(0.7, lambda: el("footer", 0, rng.choice([sentence, lambda: paragraphs(2, 0), lambda: links(4)])(), "", "site-footer")),
            often(0.2, lambda: el("div", 0, paragraphs(1, 0) + links(2), "footer", "copyright", "legal")), often(0.2, lambda: el("div", 0, sentence(), "ad", "sponsor")),
        ]
        rng.shuffle(after)
        body = article()
        shape = rng.random()
        if shape < 0.5:
            body = el(rng.choice(["article", "main", "article"]), 1, body, "", "", "post", "content")
        elif shape < 0.85:
            body = el(rng.choice(["div", "section"]), 1, body, "content", "article-body", "entry", "story", "post", "main")
        elif shape < 0.93:
            body = el("div", 1, body)
        if rng.random() < 0.3:
            cut = rng.randint(0, len(after))
            body = el(rng.choice(["div", "main"]), 1, body + "".join(after[:cut]), "", "wrapper", "container", "page")
            after = after[cut:]
        if rng.random() < 0.12:  # a fragment: no html, no body, perhaps nothing but paragraphs
            yield rng.choice([lambda: paragraphs(rng.randint(1, 3), 1), lambda: often(0.5, lambda: "".join(before)) + el(rng.choice(["article", "main"]), 1, often(0.5, lambda: el("h1", 1, words(1, 5))) + paragraphs(rng.randint(1, 2), 1)), lambda: "".join(before) + body + "".join(after)])()
            continue
        yield f'<html data-y="1"><head><title>{words(2, 6)}</title></head><body data-y="1">{"".join(before)}{body}{"".join(after)}</body></html>'


def main_text(page: str | None, model: Model) -> str:
    tree = Tree(page or "")
    return tree.blocks(model.content(tree))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url and text of every row of ``pages`` (page_id, url, html), over its whole html.

    Null, empty and markup-only pages have the text ''. What a browser reads past the end of a broken page (an open comment,
    script or tag) is no text; a start tag of something embedded that has no end tag is passed over. Rows that repeat are extracted each; other columns are not read.
    The model (a few hundred weights) is fitted to a fixed number of labelled pages and travels with the tasks."""
    model = model or Model().fit(list(labelled_pages()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), model) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string")


def op7_tree_model_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
