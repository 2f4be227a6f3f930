"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page is cut into leaf blocks, runs of text between block-level tags. A block's features are its ancestors' tags, class and id words, and its text's
shape. The field labels the sequence article or not; it is trained on labelled pages and decoded by Viterbi.
"""

from __future__ import annotations

import functools
import html as entities
import math
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import base

# Fixed values of HTML: elements whose content is never page text, elements without an end tag, elements inside a line of text.
RAW = frozenset("script style noscript template iframe textarea title noembed noframes xmp svg math select object audio video canvas".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
# Elements that a start tag of the key closes where one is open.
CLOSES = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th", "option": "option", "body": "head", "nav": "p", "footer": "p", "div": "p", "ul": "p", "ol": "p", "table": "p", "article": "p", "section": "p", "aside": "p", "form": "p", "h1": "p", "h2": "p", "h3": "p", "header": "p", "blockquote": "p", "pre": "p"}

TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*|[^>]*)>""")
NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
PART = re.compile(r"[a-z]+")
_ends = {t: re.compile(f"</{t}(?=[\\s/>])", re.I) for t in RAW}

#: The sequence's start counts as a block that is not article.
START = 0


class Place:
    """An open element: its parent, its block-level tag or the nearest above it, and those of its features that no ancestor has."""

    __slots__ = ("parent", "tag", "inner", "fresh", "field", "score")

    def __init__(self, parent: Place | None, tag: str, fresh: tuple[str, ...]):
        self.parent, self.tag, self.fresh, self.field, self.score = parent, tag, fresh, None, 0.0
        self.inner = tag if tag not in INLINE else parent.inner if parent else None


class Open:
    """The open elements of a page, outermost first; finds the nearest of a tag, and where inline elements begin, without going through them."""

    def __init__(self):
        self.places: list[Place] = []
        self.at: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # indexes of elements that aren't inline
        self.walls: list[int] = []  # and are no paragraphs
        self.features: set[str] = set()

    def top(self) -> Place | None:
        return self.places[-1] if self.places else None

    def push(self, tag: str, own: list[str]) -> None:
        fresh = tuple(dict.fromkeys(f for f in own if f not in self.features))
        self.features.update(fresh)
        k = len(self.places)
        self.at.setdefault(tag, []).append(k)
        if tag not in INLINE:
            self.blocks.append(k)
            if tag != "p":
                self.walls.append(k)
        self.places.append(Place(self.top(), tag, fresh))

    def nearest(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def shut(self, k: int) -> int:
        """Close all from ``k`` on; the number of links among them."""
        links = 0
        while len(self.places) > k:
            place = self.places.pop()
            self.at[place.tag].pop()
            self.features.difference_update(place.fresh)
            links += place.tag == "a"
        for indexes in (self.blocks, self.walls):
            while indexes and indexes[-1] >= k:
                indexes.pop()
        return links


class Block:
    __slots__ = ("parts", "place", "linked")

    def __init__(self, place):
        self.parts, self.place, self.linked = [], place, 0


def leaf_blocks(page: str) -> list[tuple[str, Place | None, float]]:
    """(text, element it stands in, share of linked characters) of each leaf block with text, in page order; memory and time go with the page's length."""
    out: list[tuple[str, Place | None, float]] = []
    stack = Open()
    links, block = 0, None
    at, end, last = 0, len(page), page.rfind(">")

    def text(a: int, b: int) -> None:
        nonlocal block
        if a < b:
            if block is None:
                block = Block(stack.top())
            block.parts.append(page[a:b])
            if links:
                block.linked += b - a

    def close() -> None:
        nonlocal block
        if block is not None:
            body = " ".join(entities.unescape("".join(block.parts)).split())
            if body:
                out.append((body, block.place, min(1.0, block.linked / len(body))))
            block = None

    while at < end:
        i = page.find("<", at)
        if i < 0 or i > last:
            text(at, end)
            break
        text(at, i)
        mark = page[i + 1 : i + 2]
        if mark in ("!", "?"):
            if page.startswith("<!--", i):
                j = page.find("-->", i + 4 - (page[i + 4 : i + 5] == ">"))
                at = end if j < 0 else j + 3
            else:
                at = page.find(">", i) + 1
            continue
        m = TAG.match(page, i)
        if m is None:
            if mark == "/":
                at = page.find(">", i) + 1
            else:
                text(i, i + 1)
                at = i + 1
            continue
        at = m.end()
        closing, tag = m[1], m[2].lower()
        if tag not in INLINE:
            close()
        if closing:
            k = stack.nearest((tag,))
            if k >= 0 and (tag not in INLINE or not stack.blocks or k > stack.blocks[-1]):
                links -= stack.shut(k)
            continue
        if tag in RAW:
            found = _ends[tag].search(page, at)
            at = end if found is None else page.find(">", found.end()) + 1 or end
            continue
        if tag in VOID:
            continue
        if tag in CLOSES:
            k = stack.nearest(CLOSES[tag].split())
            if k >= 0 and (not stack.walls or k >= stack.walls[-1]):
                links -= stack.shut(k)
        own = ["<" + tag]
        if m[3]:
            for a, b, c in NAMED.findall(m[3]):
                own += ["." + w for w in PART.findall((a or b or c).lower())]
        stack.push(tag, own)
        links += tag == "a"
    close()
    return out


def _nearest_block(place: Place | None) -> str:
    return "in <" + place.inner if place and place.inner else "bare"


def place_features(place: Place | None) -> set[str]:
    """Tags and names of an element and its ancestors, and the nearest block-level tag."""
    out = {_nearest_block(place)}
    while place is not None:
        out.update(place.fresh)
        place = place.parent
    return out


def shape_features(text: str, linked: float) -> tuple[str, ...]:
    words = text.count(" ") + 1
    return (
        f"words {min(7, int(math.log2(words)))}",
        f"links {0 if linked == 0 else 1 if linked < 0.5 else 2}",
        f"stop {text[-1] in '.!?…。'}",
        f"comma {',' in text}",
        f"mark {'©' in text}",
    )


class Field:
    """Weights of features in favour of "article", of the four label changes and of the start."""

    def __init__(self, weights: dict[str, float], moves: np.ndarray):
        self.weights, self.moves = weights, moves

    def _favour_of(self, place: Place | None) -> float:
        """The sum over an element's and its ancestors' features, each element adding to its parent's sum."""
        above = []
        while place is not None and place.field is not self:
            above.append(place)
            place = place.parent
        total = place.score if place else 0.0
        for p in reversed(above):
            total += sum(self.weights.get(f, 0.0) for f in p.fresh)
            p.field, p.score = self, total
        return total

    def favour(self, block: tuple[str, Place | None, float]) -> float:
        body, place, linked = block
        return self._favour_of(place) + self.weights.get(_nearest_block(place), 0.0) + sum(self.weights.get(f, 0.0) for f in shape_features(body, linked))

    def decode(self, blocks: list) -> list[int]:
        """The likeliest labels of a page's blocks (Viterbi)."""
        (m00, m01), (m10, m11) = self.moves.tolist()
        s0, s1 = 0.0, -math.inf
        back = []
        for b in blocks:
            a, c, e, g = s0 + m00, s1 + m10, s0 + m01, s1 + m11
            back.append((a < c, e < g))
            s0, s1 = max(a, c), max(e, g) + self.favour(b)
        label = int(s1 > s0)
        out = []
        for came in reversed(back):
            out.append(label)
            label = int(came[label])
        return out[::-1]

    def main_text(self, page: str) -> str:
        blocks = leaf_blocks(page)
        return " ".join(b[0] for b, y in zip(blocks, self.decode(blocks), strict=True) if y)


def fit(pages: list[tuple[list, list[int]]], epochs: int = 15, rate: float = 0.5, l2: float = 1e-4) -> Field:
    """Adagrad on the conditional log-likelihood of labelled block sequences, by forward and backward sums; deterministic."""
    names: dict[str, int] = {}
    data = []
    for blocks, labels in pages:
        if blocks:
            data.append(([np.array([names.setdefault(f, len(names)) for f in sorted({*place_features(b[1]), *shape_features(b[0], b[2])})]) for b in blocks], np.array(labels)))
    w, g2 = np.zeros(len(names)), np.full(len(names), 1e-6)
    moves, m2 = np.zeros((2, 2)), np.full((2, 2), 1e-6)
    order = random.Random(7)
    for _ in range(epochs):
        order.shuffle(data)
        for feats, y in data:
            n = len(y)
            u = np.zeros((n, 2))
            u[:, 1] = [w[f].sum() for f in feats]
            fwd, bwd = np.zeros((n, 2)), np.zeros((n, 2))
            fwd[0] = moves[START] + u[0]
            for i in range(1, n):
                fwd[i] = np.logaddexp(fwd[i - 1, 0] + moves[0], fwd[i - 1, 1] + moves[1]) + u[i]
            for i in range(n - 2, -1, -1):
                v = u[i + 1] + bwd[i + 1]
                bwd[i] = np.logaddexp(moves[:, 0] + v[0], moves[:, 1] + v[1])
            z = np.logaddexp(*fwd[-1])
            p = np.exp(fwd + bwd - z)
            gm = np.zeros((2, 2))
            gm[START] += p[0]
            gm[START, y[0]] -= 1
            for i in range(1, n):
                gm += np.exp(fwd[i - 1][:, None] + moves + u[i] + bwd[i] - z)
                gm[y[i - 1], y[i]] -= 1
            for f, d in zip(feats, p[:, 1] - y, strict=True):
                g = d + l2 * w[f]
                g2[f] += g * g
                w[f] -= rate * g / np.sqrt(g2[f])
            gm += l2 * moves
            m2 += gm * gm
            moves = moves - rate * gm / np.sqrt(m2)
    return Field({k: float(w[i]) for k, i in names.items()}, moves)


# Labelled pages: what page templates call their parts. Fixed values.
ARTICLE_NAMES = "article content post entry story main body text page blog single news".split()
OTHER_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topnav toc pagination pager".split(),
    "header": "header masthead topbar branding logo tagline site search".split(),
    "footer": "footer copyright legal colophon bottom credits imprint".split(),
    "aside": "sidebar aside widget related recommended trending popular recent archive tags".split(),
    "notice": "cookie cookies consent gdpr notice banner alert popup modal overlay paywall message disclaimer".split(),
    "ad": "ad ads advert advertisement sponsor sponsored promo promoted adsense outbrain".split(),
    "form": "form newsletter subscribe signup login register contact".split(),
    "comments": "comment comments reply replies respond discussion disqus reader feedback".split(),
    "share": "share social follow sharing buttons".split(),
}
OTHER_TAGS = {"nav": ["nav"], "header": ["header"], "footer": ["footer"], "aside": ["aside"], "form": ["form"], "comments": ["section"]}


def labelled_pages(n: int = 500, seed: int = 20240613) -> list[tuple[str, list[int]]]:
    """(page, label of each of its leaf blocks): generated pages whose parts are known by construction."""
    rng = random.Random(seed)
    syllables = [a + b for a in "b d f g l m n p r s t v".split() for b in "a e i o u en ar is".split()]

    def words(a: int, b: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(rng.randint(a, b)))

    def sentence(a: int = 3, b: int = 18) -> str:
        s = words(a, b).capitalize()
        return s.replace(" ", ", ", 1) + "." if rng.random() < 0.4 else s + rng.choice("....!?")

    def link(s: str) -> str:
        return f'<a href="/{rng.randint(1, 999)}">{s}</a>'

    def named(names: list[str], tag: str = "div") -> tuple[str, str]:
        name = rng.choice(names) + rng.choice(["", "", "-" + rng.choice(["wrap", "box", "inner", "area", "list", "item", "1"])])
        return f'<{tag} {rng.choice(["class", "class", "id"])}="{name}">', f"</{tag}>"

    def other(kind: str) -> tuple[str, int]:
        tag = rng.choice([*OTHER_TAGS.get(kind, ["div"]), "div", "section"])
        plain = tag in ("nav", "header", "footer", "aside", "form") and rng.random() < 0.5
        a, b = (f"<{tag}>", f"</{tag}>") if plain else named(OTHER_NAMES[kind], tag)
        k = rng.randint(1, 6)
        if kind in ("nav", "share") or kind in ("aside", "footer", "header") and rng.random() < 0.4:
            return a + "<ul>" + "".join(f"<li>{link(words(1, 3))}</li>" for _ in range(k)) + "</ul>" + b, k
        if kind == "comments":
            return a + "".join(f"<div><p>{sentence()} {sentence()}</p></div>" for _ in range(k)) + b, k
        if kind == "footer":
            return a + f"&copy; {words(1, 2)} &middot; {sentence()}" + b, 1
        if kind == "form":
            return a + f"<p>{sentence()}</p><input type=text>" + b, 1
        if rng.random() < 0.5:
            return a + f"{sentence()} {sentence()}" + b, 1
        return a + "".join(f"<p>{sentence()}</p>" for _ in range(k)) + b, k

    def article() -> tuple[str, list[int]]:
        parts, labels = [], []
        if rng.random() < 0.8:
            parts.append(f"<h1>{words(2, 9).capitalize()}</h1>")
            labels.append(1)
        for _ in range(rng.randint(1, 14)):
            r = rng.random()
            if r < 0.68:
                body = " ".join(sentence() for _ in range(rng.choice([1, 1, 2, 4, 9])))
                if rng.random() < 0.2:
                    body = words(1, 5).capitalize() + " " + link(words(1, 3)) + " " + body
                if rng.random() < 0.2:
                    body = f"<b>{body}<br>"
                    parts.append(f"<p>{body}")
                else:
                    parts.append(f"<p>{body}</p>")
                labels.append(1)
            elif r < 0.76:
                k = rng.randint(1, 4)
                parts.append("<ul>" + "".join(f"<li>{rng.choice([sentence(1, 8), words(1, 5), link(words(1, 4))])}</li>" for _ in range(k)) + "</ul>")
                labels += [1] * k
            elif r < 0.82:
                parts.append(f"<h2>{words(1, 6).capitalize()}</h2>")
                labels.append(1)
            elif r < 0.87:
                parts.append(rng.choice(["<blockquote>{}</blockquote>", "<pre>{}</pre>", "<table><tr><td>{}</td></tr></table>", "<figure><figcaption>{}</figcaption></figure>", "<div>{}</div>"]).format(sentence()))
                labels.append(1)
            elif r < 0.9:
                parts.append("<script>x='</p>'</script>")
            else:
                s, k = other(rng.choice(["ad", "share", "aside", "notice", "form"]))
                parts.append(s)
                labels += [0] * k
        if rng.random() < 0.25:
            s, k = other("comments")
            parts.append(s)
            labels += [0] * k
        form = rng.random()
        if form < 0.45:
            a, b = "<article>", "</article>"
        elif form < 0.6:
            a, b = "<main>", "</main>"
        elif form < 0.9:
            a, b = named(ARTICLE_NAMES, rng.choice(["div", "section", "article", "main"]))
        else:
            a, b = "", ""
        return a + "".join(parts) + b, labels

    pages = []
    for i in range(n):
        body, labels = "", []
        for kind in rng.sample(["nav", "header", "ad", "notice", "share", "form"], rng.randint(0, 3)):
            s, k = other(kind)
            body += s
            labels += [0] * k
        s, ys = article()
        body += s
        labels += ys
        for kind in rng.sample(["comments", "aside", "ad", "footer", "nav", "form", "notice", "share"], rng.randint(0, 4)):
            s, k = other(kind)
            body += s
            labels += [0] * k
        wrap = named(["wrap", "container", "layout", "row", "col", "site", "page"]) if rng.random() < 0.4 else ("", "")
        pages.append((f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{wrap[0]}{body}{wrap[1]}" + rng.choice(["</body></html>", ""]), labels))
    return pages


@functools.cache
def default_field() -> Field:
    return fit([(leaf_blocks(page), labels) for page, labels in labelled_pages()])


def extract(pages: DataFrame, *, html: str = "html", field: Field | None = None) -> DataFrame:
    """Adds ``text``, the main text, and ``n_chars``, its code points; columns with these names are replaced.

    Blocks labelled article are joined in page order by a space; in a block character references are decoded and white space is one
    space. Scripts, styles, comments and markup are never text. Null, empty and unparsable pages give what text is found, empty if none. Rows are
    mapped one by one over whole pages; nothing is shuffled, equal pages give equal texts.
    """
    shared = pages.sparkSession.sparkContext.broadcast(field or default_field())

    def start():
        import pyarrow as pa

        f = shared.value

        def work(batch):
            out = [f.main_text(x) if x else "" for x in batch.column(html).to_pylist()]
            return [pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())]

        return work

    return base.append_columns(pages.withColumn(html, F.col(f"`{html}`").cast("string")), [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], start)
