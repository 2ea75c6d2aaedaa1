"""HTML extraction by a tree-structured graphical model.

The nodes of a page's element tree are content or not. A node's potential comes from its tag, the cue words of its
class, id and role, its text, and how the page's prose and links lie in and around it; parent-child potentials join it
to its parent. Sum-product messages go up and down the tree, level by level over all pages of a slice at once, and
give each node's marginal; text of nodes with a marginal over one half is kept. Weights are fitted on labelled pages:
pages built from labelled fragments, many of them without any name that says what a part is, and a bounded sample of
the table's own pages. Those are labelled by where their prose stands together, never by tag names or cue words.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import as_bytes, col_of, map_texts

#: Fixed by HTML: elements that end a line of text, that never hold any, whose content is no text, and what ends an open element.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: The source of these is text up to their own end tag, whatever stands in it; what these others hold is not shown as text.
VERBATIM = frozenset("script style title textarea iframe noframes xmp noembed".split())
MUTE = frozenset("template noscript svg object audio video canvas".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "body": {"head"}}
SCOPE = frozenset("html body article aside section div main table td th ul ol dl form nav header footer blockquote figure li dd".split())
PLAIN = frozenset("math mi mn mo ms mtext mrow mfrac msqrt msup msub mover munder semantics annotation a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())

#: Cue words by family; a class, id or role is split into words, and a word counts where it starts with one of these or, up to four letters, equals it or its plural.
CUES = {
    "menu": "nav menu breadcrumb toolbar tabs pager pagination skip toc",
    "head": "header masthead banner topbar logo branding",
    "foot": "footer footnote copyright legal bottom colophon",
    "side": "sidebar aside related recommend widget complementary more-stories popular trending tags",
    "notice": "notice cookie consent gdpr popup modal overlay alert toast disclaimer paywall",
    "advert": "ad ads adv advert sponsor promo banner-ad outbrain taboola commercial adsense",
    "form": "form login signup subscribe newsletter search register contact",
    "comment": "comment reply disqus discussion respond feedback",
    "share": "share social follow author-bio byline breadcrumbs rating",
    "body": "article content main post entry story body page-content prose",
}
WORD_CUES = [(w, family) for family, words in CUES.items() for w in words.split()]
NAMED = {"nav": "menu", "menu": "menu", "header": "head", "footer": "foot", "aside": "side", "form": "form", "select": "form", "button": "form", "fieldset": "form", "dialog": "notice", "article": "body", "main": "body"}
TAGS = ["article", "main", "section", "div", "p", "h1", "h2", "h3", "ul", "ol", "li", "table", "tr", "td", "th", "blockquote", "pre", "figure", "figcaption", "nav", "header", "footer", "aside", "form", "button", "label", "dialog", "html", "body", "head", "address", "dl", "dd", "dt", "inline", "other"]
GROUPS = frozenset("div section html body table ul ol dl".split())
KINDS = 4
FEATURES = {name: i for i, name in enumerate(["bias", *(f"tag {t}" for t in TAGS), *(f"cue {f}" for f in CUES), "only body", "in article", "in other part", "short", "long", "links", "sentence", "no text", "holds most prose", "holds some prose", "holds little prose", "holds links", "in most prose", "prose beside", "no prose beside"])}
LOW = [FEATURES[n] for n in ("in article", "in other part", "short", "long", "links", "sentence", "no text", "holds most prose", "holds some prose", "holds little prose", "holds links", "in most prose", "prose beside", "no prose beside")]

#: A tag ends at the first > outside a quoted value; a quote that is not closed before a blank, / or > is none.
TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([a-zA-Z][^\s/>]*+)(?:(?:[^>=]++|=\s*+(?:"[^"]*+"(?=[\s/>])|'[^']*+'(?=[\s/>])|(?!["'])))*+>|[^>]*+>)|<[!?/][^>]*+>""", re.DOTALL)
END_TAG = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in VERBATIM}
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|data-label)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
SLICE_WORDS = re.compile(r"[^a-z]+")

#: Fixed by HTML: a drawing that is still open ends where one of these begins.
LEAVES_SVG = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: What these are is said by their tag; their class or id is about what they tell, so it is no cue.
NO_CUES = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
#: Start tags of up to so many characters are remembered.
TAG_LENGTH = 500

SENTENCE = (".", "!", "?", "。")


class Tag:
    """What a start tag's source says: its name, its features, the label that a training page gives it."""

    __slots__ = ("name", "features", "families", "label", "node", "block", "inline", "kind")

    def __init__(self, source: str, name: str):
        self.name = name
        found = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(source)}
        words = [w for k in ("class", "id", "role") if name not in NO_CUES for w in SLICE_WORDS.split(re.sub("([a-z])([A-Z])", r"\1 \2", found.get(k, "")).lower()) if w]
        self.families = {f for w in words for cue, f in WORD_CUES if (w in (cue, cue + 's') if len(cue) <= 4 else w.startswith(cue))}
        if name in NAMED:
            self.families.add(NAMED[name])
        self.inline = name in PLAIN
        shape = "inline" if self.inline else name if name in TAGS else "other"
        self.features = [FEATURES["bias"], FEATURES[f"tag {shape}"], *(FEATURES[f"cue {f}"] for f in sorted(self.families)), *[FEATURES["only body"]] * (self.families == {"body"})]
        #: For the parent-child potentials: a container, text, a part that names itself as no article, an article.
        self.kind = 3 if self.families == {"body"} else 2 if self.families else 0 if name in GROUPS else 1
        self.label = int(found["data-label"]) if found.get("data-label", "") in ("0", "1") else None
        self.block = name in BLOCKS
        self.node = not self.inline or bool(self.families) or self.label is not None


_tags: dict[str, Tag] = {}


def tag_of(source: str, name: str) -> Tag:
    tag = _tags.get(source)
    if tag is None:
        tag = Tag(source, name)
        if len(source) <= TAG_LENGTH:
            if len(_tags) > 50_000:
                _tags.clear()
            _tags[source] = tag
    return tag


class Page:
    """A page's nodes (parent, depth, tag) and its pieces of text (block, node, text); counts of text and link text by node."""

    def __init__(self, source: str):
        self.parents, self.depths, self.tags = [-1], [0], [tag_of("<html>", "html")]
        self.within = [(False, False)]  # an article, another named part
        self.pieces: list[tuple[int, int, str]] = []
        stack: list[tuple[str, int]] = [("html", 0)]
        opened: Counter[str] = Counter(html=1)
        linked = muted = block = at = read = 0
        self.sizes, self.links, self.prose = [0], [0], [0]
        while m := TOKEN.search(source, read):
            if m.start() > at and not muted:
                self.piece(block, stack[-1][1], source[at : m.start()], linked)
            read = m.end()
            name = m[2] and m[2].lower()
            if name and not m[1] and name in VERBATIM:
                read = self.end_of(source, name, read)
            at = read
            if name is None or name in VERBATIM:
                continue
            if m[1]:
                if name in BLOCKS:
                    block += 1
                if opened[name] and len(stack) > 1:
                    while len(stack) > 1:
                        last, _ = stack.pop()
                        opened[last] -= 1
                        if last == name:
                            break
                    linked, muted = opened["a"], sum(opened[x] for x in MUTE)
                continue
            if opened["svg"] and name in LEAVES_SVG and not opened["foreignobject"]:
                while opened["svg"]:
                    last, _ = stack.pop()
                    opened[last] -= 1
                linked, muted = opened["a"], sum(opened[x] for x in MUTE)
            if name in VOID:
                if name == "br" and not muted:
                    self.pieces.append((block, stack[-1][1], " "))
                block += name == "hr"
                continue
            if name == "html" or (name in MUTE and m[0].endswith("/>")):
                continue
            tag = tag_of(m[0], name)
            if tag.block:
                block += 1
                if opened["p"]:
                    self.close(stack, opened, {"p"})
                if name in ENDS:
                    self.close(stack, opened, ENDS[name])
                linked, muted = opened["a"], sum(opened[x] for x in MUTE)
            node = stack[-1][1]
            if tag.node and not muted:
                self.parents.append(node)
                self.depths.append(self.depths[node] + 1)
                above, (article, other) = self.tags[node], self.within[node]
                self.within.append((article or above.kind == 3, other or above.kind == 2))
                node = len(self.tags)
                self.tags.append(tag)
                self.sizes.append(0)
                self.links.append(0)
                self.prose.append(0)
            stack.append((name, node))
            opened[name] += 1
            linked += name == "a"
            muted += name in MUTE
        if not muted and at < len(source):
            self.piece(block, stack[-1][1], source[at:], linked)

    def piece(self, block: int, node: int, text: str, linked: int) -> None:
        self.pieces.append((block, node, text))
        n = len(text.strip())
        self.sizes[node] += n
        if linked:
            self.links[node] += n
        elif n >= 60 or (n >= 20 and text.rstrip().endswith(SENTENCE)):
            self.prose[node] += n

    @staticmethod
    def end_of(source: str, name: str, at: int) -> int:
        """Where the end tag of a verbatim element whose text begins at `at` ends; the page's end if it has none."""
        m = END_TAG[name].search(source, at)
        stop = source.find(">", m.end()) if m else -1
        return stop + 1 if stop >= 0 else len(source)

    @staticmethod
    def close(stack: list[tuple[str, int]], opened: Counter[str], names: set[str]) -> None:
        """End what is open of `names`, up to the element that holds this one."""
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in names:
                for name, _ in stack[k:]:
                    opened[name] -= 1
                del stack[k:]
                return
            if stack[k][0] in SCOPE:
                return

    def text(self, content: np.ndarray) -> str:
        """The blocks of the nodes that are content."""
        out: list[str] = []
        last, held = -1, []
        for block, node, text in self.pieces:
            if content[node]:
                if block != last:
                    out.append("".join(held))
                    last, held = block, []
                held.append(text)
        out.append("".join(held))
        blocks = (" ".join(html.unescape(b).split()) for b in out)
        return "\n\n".join(b for b in blocks if b)


class Forest:
    """The trees of several pages as arrays: parent, features, and the nodes of each depth."""

    def __init__(self, pages: list[Page]):
        firsts = np.cumsum([0, *(len(p.tags) for p in pages)])
        self.firsts = firsts
        self.parent = np.concatenate([np.where(np.array(p.parents) < 0, -1, np.array(p.parents) + f) for p, f in zip(pages, firsts, strict=False)])
        depth = np.concatenate([p.depths for p in pages])
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1])
        sizes, links, prose = (np.array([x for p in pages for x in getattr(p, a)]) for a in ("sizes", "links", "prose"))
        self.prose, self.prose_in = prose, self.summed(prose)
        links_in, sizes_in = self.summed(links), self.summed(sizes)
        owner = np.repeat(np.arange(len(pages)), np.diff(firsts))
        whole = self.prose_in[firsts[:-1]][owner]
        share = self.prose_in / np.maximum(whole, 1)
        up = np.maximum(self.parent, 0)
        beside = (self.prose_in[up] - self.prose_in > 0) & (self.parent >= 0)
        tags = [t for p in pages for t in p.tags]
        ends = np.zeros(len(tags), bool)
        for p, f in zip(pages, firsts, strict=False):
            for _, node, text in p.pieces:
                if text.rstrip().endswith(SENTENCE):
                    ends[f + node] = True
        text = sizes > 0
        within = np.array([w for p in pages for w in p.within])
        low = np.stack([within[:, 0], within[:, 1], text & (sizes < 25), sizes > 120, text & (2 * links > sizes), ends, ~text, share > 0.5, (share > 0.1) & (share <= 0.5), (share <= 0.1) & (whole > 0), 2 * links_in > sizes_in, (share[up] > 0.5) & (share <= 0.5), beside, ~beside & (whole > 0)], 1)
        x = np.zeros((len(tags), len(FEATURES)), np.float32)
        for i, t in enumerate(tags):
            x[i, t.features] = 1
        x[:, LOW] = low
        self.x = x
        self.kind = np.array([t.kind for t in tags])

    def summed(self, own: np.ndarray) -> np.ndarray:
        """Each node's sum over its subtree."""
        out = own.astype(np.int64)
        for level in self.levels[:0:-1]:
            np.add.at(out, self.parent[level], out[level])
        return out

    def marginals(self, unary: np.ndarray, pair: np.ndarray):
        """(P(content) of each node, P(parent state, own state) of each, log of the partition sum); pair: (kind, parent, own)."""
        n = len(self.parent)
        up = np.zeros((n, 2))
        up[:, 1] = unary  # potentials and the messages of children
        message = np.zeros((n, 2))
        edge = pair[self.kind]
        for level in self.levels[:0:-1]:
            message[level] = np.logaddexp(edge[level, :, 0] + up[level, 0, None], edge[level, :, 1] + up[level, 1, None])
            np.add.at(up, self.parent[level], message[level])
        roots = self.levels[0]
        log_z = np.logaddexp(up[roots, 0], up[roots, 1]).sum()
        belief = up.copy()  # with what comes from above
        both = np.zeros((n, 2, 2))
        for level in self.levels[1:]:
            above = self.parent[level]
            rest = belief[above] - message[level]
            joint = rest[:, :, None] + edge[level] + up[level][:, None, :]
            top = joint.max((1, 2), keepdims=True)
            e = np.exp(joint - top)
            both[level] = e / e.sum((1, 2), keepdims=True)
            belief[level] = up[level] + np.logaddexp(rest[:, 0, None] + edge[level, 0, :], rest[:, 1, None] + edge[level, 1, :])
        return 1 / (1 + np.exp(belief[:, 0] - belief[:, 1])), both, log_z


class Model:
    def __init__(self):
        self.w = np.zeros(len(FEATURES))
        self.pair = np.zeros((KINDS, 2, 2))

    def fit(self, forest: Forest, labels: np.ndarray, steps: int = 250, rate: float = 0.1, decay: float = 1e-4) -> None:
        """Ascend the conditional log-likelihood of the labels: observed less expected counts, by Adam."""
        x, child = forest.x.astype(np.float64), np.flatnonzero(forest.parent >= 0)
        seen = np.zeros((KINDS, 2, 2))
        np.add.at(seen, (forest.kind[child], labels[forest.parent[child]], labels[child]), 1)
        state = [np.zeros_like(self.w), np.zeros_like(self.w), np.zeros_like(self.pair), np.zeros_like(self.pair)]
        for step in range(1, steps + 1):
            p, both, _ = forest.marginals(x @ self.w, self.pair)
            expected = np.zeros((KINDS, 2, 2))
            np.add.at(expected, forest.kind[child], both[child])
            grads = ((labels - p) @ x / len(p) - decay * self.w, (seen - expected) / len(p) - decay * self.pair)
            for value, grad, m, s in ((self.w, grads[0], state[0], state[1]), (self.pair, grads[1], state[2], state[3])):
                m += 0.1 * (grad - m)
                s += 0.01 * (grad * grad - s)
                value += rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)

    def texts(self, sources: list[str]) -> list[str]:
        pages = [Page(s) for s in sources]
        if not pages:
            return []
        forest = Forest(pages)
        p, _, _ = forest.marginals(forest.x @ self.w, self.pair)
        content = p > 0.5
        return [page.text(content[a:b]) for page, a, b in zip(pages, forest.firsts, forest.firsts[1:], strict=False)]


def labels_of(page: Page) -> np.ndarray:
    """Each node's label: what data-label says, else its parent's."""
    out = np.zeros(len(page.tags), np.int64)
    for i, (tag, up) in enumerate(zip(page.tags, page.parents, strict=True)):
        out[i] = tag.label if tag.label is not None else out[up] if up >= 0 else 0
    return out


def prose_labels(page: Page) -> np.ndarray | None:
    """Labels by where prose stands together, whatever tags and names say: what the node holds whose own text and lines are the most prose.

    Lines are children that are no groups. If its siblings of the same tag hold half as much together, they and it are
    parts of what their parent holds. Parts that are mostly links are not content. None for a page without prose.
    """
    forest = Forest([page])
    parent, prose, prose_in = forest.parent, forest.prose, forest.prose_in
    lines = [t.name not in GROUPS and t.name not in SCOPE for t in page.tags]
    held = prose.astype(np.int64)
    for i in range(1, len(parent)):
        if lines[i]:
            held[parent[i]] += prose_in[i]
    best = int(held.argmax())
    if not held[best]:
        return None
    while parent[best] > 0:
        like = [i for i in np.flatnonzero(parent == parent[best]) if i != best and page.tags[i].name == page.tags[best].name]
        if 2 * held[like].sum() < held[best]:
            break
        best = int(parent[best])
    links = forest.summed(np.array(page.links)) * 2 > forest.summed(np.array(page.sizes))
    out = np.zeros(len(parent), np.int64)
    for i in range(len(parent)):
        out[i] = i == best or (parent[i] >= 0 and out[parent[i]] and not (links[i] and not lines[i]))
    return out


def built_pages(n: int = 320, seed: int = 4, styles: tuple[str, ...] = ("cues", "cues", "plain", "none")) -> list[str]:
    """Pages built from labelled fragments: articles in several kinds of markup, with what stands around and inside them.

    Only pages of the style `cues` have tags and names that say what a part is; `plain` ones have divs with names that
    say nothing, `none` divs alone.
    """
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("aeioubcdlmnrst") for _ in range(draw.randrange(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(draw.randrange(a, b)))
    sentence = lambda: words(1, 25).capitalize() + "."
    link = lambda: f'<a href="/{word()}">{words(1, 4)}</a>'
    links = lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(draw.randrange(2, 8))) + "</ul>"
    prose = lambda: " ".join(sentence() for _ in range(draw.randrange(1, 6)))

    style = ["cues"]

    def attr(*cues: str) -> str:
        if style[0] == "none":
            return ""
        if style[0] == "plain":  # a name that says nothing
            return f' class="{word()}{draw.choice(["", "-" + word()])}"'
        return f' {draw.choice(["class", "id"])}="{draw.choice(["", "c-", "site-", "x_"])}{draw.choice(cues)}{draw.choice(["", "-box", " w3", "_1"])}"'

    def outside() -> str:
        return draw.choice(
            [
                lambda: f"<nav data-label=0>{links()}</nav>",
                lambda: f"<div data-label=0{attr('menu', 'nav', 'breadcrumbs')}>{links()}</div>",
                lambda: f"<header data-label=0{draw.choice(['', attr('masthead')])}><h1>{words(1, 4)}</h1><p>{words(2, 8)}</p></header>",
                lambda: f"<div data-label=0{attr('header', 'topbar', 'banner')}><p>{words(2, 8)}</p></div>",
                lambda: f"<footer data-label=0>&copy; {words(1, 4)} <p>{sentence()}</p></footer>",
                lambda: f"<div data-label=0{attr('footer', 'copyright', 'legal')}><p>{sentence()}</p>{link()}</div>",
                lambda: f"<aside data-label=0><h3>{words(1, 4)}</h3>{links()}<p>{prose()}</p></aside>",
                lambda: f"<div data-label=0{attr('sidebar', 'related', 'widget', 'popular')}><h3>{words(1, 4)}</h3><p>{prose()}</p>{links()}</div>",
                lambda: f"<div data-label=0{attr('cookie', 'notice', 'consent', 'alert', 'popup')}><p>{prose()}</p><button>{word()}</button></div>",
                lambda: f"<div data-label=0{attr('ad', 'ads', 'advert', 'sponsored', 'promo')}>{draw.choice([prose(), '<p>' + prose() + '</p>'])}</div>",
                lambda: f"<form data-label=0><label>{word()}</label><p>{words(2, 9)}</p><button>{word()}</button></form>",
                lambda: f"<div data-label=0{attr('newsletter', 'subscribe', 'login', 'search')}><p>{sentence()}</p></div>",
                lambda: f"<section data-label=0{attr('comments', 'comment-list', 'discussion', 'replies')}><h2>{words(1, 3)}</h2>" + "".join(f"<{e}{draw.choice(['', attr('comment')])}><p>{prose()}</p></{e}>" for e in [draw.choice(["div", "article", "li"])] * draw.randrange(1, 4)) + "</section>",
                lambda: f"<div data-label=0{attr('share', 'social')}>{links()}</div>",
            ]
        )()

    def inside() -> str:
        return draw.choice(
            [
                lambda: f"<p>{prose()}</p>",
                lambda: f"<p>{prose()}</p>",
                lambda: f"<p><b>{sentence()}<br><p>{prose()}</p>",
                lambda: f"<p>{words(1, 5)} {link()} {sentence()}</p>",
                lambda: f"<h2>{words(1, 7)}</h2><p>{prose()}</p>",
                lambda: "<ul>" + "".join(f"<li>{words(1, 12)}</li>" for _ in range(3)) + "</ul>",
                lambda: f"<blockquote><p>{prose()}</p></blockquote>",
                lambda: f"<pre>{words(3, 20)}</pre>",
                lambda: f"<figure><figcaption>{sentence()}</figcaption></figure>",
                lambda: f"<table><tr><th>{word()}</th><td>{words(1, 6)}</td></tr></table>",
                lambda: f"<div><p>{prose()}</p></div>",
                lambda: f"<section><h3>{words(1, 5)}</h3><p>{prose()}</p></section>",
                lambda: f"<header><h1>{words(2, 7)}</h1><p>{words(2, 6)}</p></header>" if style[0] == "cues" else f"<p>{prose()}</p>",
                lambda: f'<p class="{draw.choice(["message", "printable", "reading", "textual", "lead"])}">{prose()}</p>',
            ]
        )()

    def unnamed(source: str) -> str:
        return source if style[0] == "cues" else re.sub(r"(</?)(?:nav|header|footer|aside|section|article|main|form)\b", r"\1div", source)

    pages = []
    for _ in range(n):
        style[0] = draw.choice(styles)
        parts = [f"<h1>{words(1, 9)}</h1>" * draw.randrange(2), *(inside() for _ in range(draw.randrange(1 if style[0] == "cues" else 4, 12)))]
        for _ in range(draw.choice([0, 0, 1, 2]) if style[0] == "cues" else 0):
            part = outside()
            while part.startswith("<header"):  # inside an article its header belongs to it
                part = outside()
            parts.insert(draw.randrange(1, len(parts) + 1), part)
        short = style[0] == "cues" and draw.random() < 0.2  # a short article and little else
        body = draw.choice([f"<p>{sentence()}</p>", f"<p>{words(1, 5)}</p>", f"<h1>{words(1, 6)}</h1><p>{sentence()}</p>"]) if short else "".join(parts)
        body = draw.choice(
            [
                lambda b: f"<article data-label=1>{b}</article>",
                lambda b: f"<article data-label=1>{b}</article>",
                lambda b: f"<main data-label=1>{b}</main>",
                lambda b: f"<main data-label=1><article>{b}</article></main>",
                lambda b: f"<div data-label=1{attr('content', 'main', 'post', 'entry', 'story', 'article')}>{b}</div>",
                lambda b: f"<div data-label=1{attr('article')}><div{attr('body', 'text')}>{b}</div></div>",
            ]
        )(body)
        before, after = ("".join(outside() for _ in range(draw.randrange(0, 2 if short else 4))) for _ in range(2))
        wrap = draw.choice(["{}", "{}", "<div>{}</div>", '<div class="wrapper" data-label="0">{}</div>'])
        pages.append(unnamed(f"<html><body>{wrap.format(before + body + after)}</body></html>"))
    return pages


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", max_pages: int = 100, max_chars: int = 200_000) -> Model:
    """A model of the built pages and of at most `max_pages` pages of the table: those of the smallest id hashes, each of at most `max_chars`.

    Only ids are ranked; then those pages are read. Pages without an id or html, and empty tables, give none; of
    repeated rows as many count as fit; ties in the order are broken by the id's text.
    """
    named = F.col(f"`{id_col}`").cast("string")
    able = pages.where(F.col(f"`{id_col}`").isNotNull() & (F.octet_length(F.col(f"`{html_col}`").cast("string")) <= max_chars))
    ids = able.select(F.xxhash64(named).alias("h"), named.alias("id")).orderBy("h", "id").limit(max_pages).select("id").distinct()
    few = able.select(named.alias("id"), F.col(f"`{html_col}`").cast("string").alias("html")).join(F.broadcast(ids), "id", "left_semi").limit(2 * max_pages).collect()
    held = [(p, labels_of(p)) for p in map(Page, built_pages())]
    held += [(p, y) for p in (Page(h) for h in sorted(r.html for r in few)[:max_pages]) if (y := prose_labels(p)) is not None]
    model = Model()
    model.fit(Forest([p for p, _ in held]), np.concatenate([y for _, y in held]))
    return model


def extract(pages: DataFrame, model: Model, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for each row: blocks of the main text, joined by two line ends; "" where there is none.

    White space inside a block is one space, character references are decoded, <br> is white space. Null and empty
    html give "". Broken markup is read as far as it goes. Repeated rows each get a row, an empty
    table gives none. A very long page is read whole by one task. A node is content at over one half, so a tie is
    not. Other columns, whatever their names, are not read.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def start():
        held = shared.value

        def of(batch: pa.RecordBatch) -> dict:
            sources = [t.decode("utf-8", "replace") if t else "" for t in col_of(batch, "html").to_pylist()]
            texts = [""] * len(sources)
            full = [i for i, s in enumerate(sources) if s]
            for i, text in zip(full, held.texts([sources[i] for i in full]), strict=True):
                texts[i] = text.encode("utf-8", "replace").decode()
            return {"page_id": col_of(batch, "page_id"), "url": col_of(batch, "url"), "text": texts}

        return of

    source = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), as_bytes(html_col).alias("html"))
    return map_texts(source, "html", f"page_id {kind}, url string, text string", start)
