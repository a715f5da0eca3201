"""HTML extraction: a linear-chain conditional random field over DOM leaf blocks.

A page is parsed into leaf blocks, the runs of inline text between block-level
tags. A block's features are its ancestors' tags and class words and simple
facts of its text; the field has one weight for each feature and label and for
each pair of neighbouring labels. It is trained by conditional likelihood
(forward-backward, AdaGrad) on labelled pages and decoded by Viterbi. The
labelled pages are made here: ``labelled_pages`` builds pages from parts whose
labels are known, in the usual layouts of articles, with text of random
syllables, so that no weight can depend on a language.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from queuelake.llm.common import session_of, small_batches

#: Fixed values of HTML: tags inside a line of text, tags without an end, tags whose content is no text.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr input".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OPAQUE = set("script style noscript template svg iframe textarea select title".split())
#: Opaque elements that stand in each other.
NESTING = {"svg", "template"}
#: Mathematics, and what stands for an object or a canvas, is text of its line.
INLINE |= set("object canvas math mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom menclose msub msup msubsup munder mover munderover mmultiscripts mprescripts mtable mtr mtd semantics annotation annotation-xml maction".split())
#: Where an opaque element without an end of its own ends at the latest: at a part of the page, or where the head does.
PART = re.compile(r"</?(?:head|body|html|article|main|section|header|footer|nav|aside|div|p|h[1-6]|ul|ol|table|form|meta|link|base)\b", re.IGNORECASE)
HEAD_ENDS = re.compile(r"</head\b|<body\b", re.IGNORECASE)
#: An opening tag ends an open element of these.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TOKEN = re.compile(r"""<!--(?:.*?-->|.*)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*>|.*)""", re.DOTALL)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
NAME_WORD = re.compile(r"[a-z]+")
SEED, PAGES, EPOCHS, RATE, DECAY = 5, 600, 8, 0.3, 1e-3


def opaque_end(page: str, at: int, tag: str, unclosed: set[str]) -> int:
    """Where an opaque element ends whose opening tag ends at ``at``. ``unclosed``: tags that no longer end in the page, or not in pairs."""
    if tag in NESTING and f"{tag} in pairs" not in unclosed:
        depth = 1
        for m in re.compile(rf"<(/?){tag}\b[^>]*>", re.IGNORECASE).finditer(page, at):
            depth += -1 if m[1] else 0 if m[0].endswith("/>") else 1
            if not depth:
                return m.end()
        unclosed.add(f"{tag} in pairs")
    end = None if tag in unclosed else re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, at)
    if not end:
        unclosed.add(tag)
    if end and tag in ("script", "style"):
        return end.end()
    stop = (HEAD_ENDS if end and tag != "select" else PART).search(page, at, end.start() if end else len(page))
    return stop.start() if stop else end.end() if end else len(page)


class OpenElements:
    """The open elements of a page and the features of a block in them; what an element adds is counted, so that depth costs no more than its own names."""

    def __init__(self, known: frozenset[str] | None) -> None:
        self.known, self.names, self.added = known, [], []
        self.open: Counter[str] = Counter()
        self.counts: Counter[str] = Counter()
        self.depth, self.path = 0, None

    def push(self, tag: str, words: set[str]) -> None:
        inner = tag not in ("html", "body")
        found = [f"has {tag}"] * inner + [f"word {w}" for w in words]
        found = [f for f in found if self.known is None or f in self.known]
        self.names.append(tag)
        self.added.append(found)
        self.open[tag] += 1
        self.counts.update(found)
        self.depth += inner
        self.path = None

    def pop(self) -> None:
        tag = self.names.pop()
        for f in self.added.pop():
            self.counts[f] -= 1
            if not self.counts[f]:
                del self.counts[f]
        self.open[tag] -= 1
        self.depth -= tag not in ("html", "body")
        self.path = None

    def close(self, tag: str) -> None:
        """End the innermost open ``tag`` and what is open in it; an end tag without such an element does nothing."""
        if self.open[tag] > 0:
            while self.names[-1] != tag:
                self.pop()
            self.pop()

    def features(self) -> tuple[str, ...]:
        """Each ancestor's tag and class words, wherever it stands, and the innermost tags in order."""
        if self.path is None:
            inner = []
            for tag in reversed(self.names):
                if tag not in ("html", "body"):
                    inner.insert(0, tag)
                if len(inner) == 2:
                    break
            self.path = (*sorted(self.counts), f"tag {inner[-1] if inner else ''}", f"pair {' '.join(inner)}", f"depth {min(6, self.depth)}", "bias")
        return self.path


def leaf_blocks(page: str, known: frozenset[str] | None = None) -> list[tuple[str, tuple[str, ...], float]]:
    """(text, features of its ancestors, share of the text inside links) of each leaf block with text, in page order.

    References are decoded and white space, line breaks included, becomes one
    space. ``known`` names the features of ancestors that matter; others are
    passed over, so that a page's own names don't add up in nested elements.
    """
    out: list[tuple[str, tuple[str, ...], float]] = []
    stack = OpenElements(known)
    names = stack.names
    paths: dict[tuple[str, ...], tuple[str, ...]] = {}
    parts: list[str] = []
    linked = in_link = 0
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(parts).split())
        if text:
            path = stack.features()
            out.append((text, paths.setdefault(path, path), min(1.0, linked / len(text))))
        parts.clear()
        linked = 0

    at, n = 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        start = m.start() if m else n
        if start > at:
            piece = html.unescape(page[at:start])
            parts.append(piece)
            if in_link:
                linked += len(" ".join(piece.split()))
        if not m:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag == "a":
                in_link = 0
            if tag in INLINE:
                continue
            flush()
            stack.close(tag)
            continue
        if tag in OPAQUE:
            if not m[3].endswith("/>"):
                at = opaque_end(page, at, tag, unclosed)
            continue
        if tag == "head":  # its end tag may be missing, and what it holds is opaque or void
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append("\n")
            if tag == "a":
                in_link = 1
            continue
        flush()
        if "p" in names[-3:]:
            stack.close("p")
        closes = ENDS.get(tag, ())
        if names and names[-1] in closes:
            stack.pop()
            if tag == "tr" and names and names[-1] in closes:
                stack.pop()
        if tag in VOID or m[3].endswith("/>"):
            continue
        stack.push(tag, {w for g in NAMES.findall(m[3]) for w in NAME_WORD.findall("".join(g).lower())} if "=" in m[3] else set())
    flush()
    return out


def text_features(text: str, links: float) -> list[str]:
    return [f"size {min(9, int(math.log2(1 + len(text))))}", f"links {int(links * 4)}", f"stop {text[-1] in '.!?…。'}", f"mark {text[0] in '©®™'}"]


class Field:
    """Weights of a two-label chain: 0 is what stands around an article, 1 the article."""

    def __init__(self) -> None:
        self.unary: dict[str, list[float]] = {}
        self.pairs = [[0.0, 0.0], [0.0, 0.0]]
        self.paths: dict[tuple[str, ...], tuple[float, float]] = {}

    def _sum(self, features: Iterable[str]) -> tuple[float, float]:
        a = b = 0.0
        for f in features:
            w = self.unary.get(f)
            if w:
                a += w[0]
                b += w[1]
        return a, b

    @cached_property
    def known(self) -> frozenset[str]:
        """The features of ancestors that have weights."""
        return frozenset(f for f in self.unary if f.startswith(("has ", "word ")))

    def potentials(self, blocks: list[tuple[str, tuple[str, ...], float]]) -> list[tuple[float, float]]:
        out = []
        for text, path, links in blocks:
            p = self.paths.get(path)
            if p is None:
                if len(self.paths) > 5_000:
                    self.paths.clear()
                p = self.paths[path] = self._sum(path)
            t = self._sum(text_features(text, links))
            out.append((p[0] + t[0], p[1] + t[1]))
        return out

    def viterbi(self, blocks: list[tuple[str, tuple[str, ...], float]]) -> list[int]:
        """The most probable labels of a page's blocks; of equal ones, the lesser label."""
        if not blocks:
            return []
        psi, (s, t) = self.potentials(blocks), self.pairs
        a, b = psi[0]
        back = []
        for x, y in psi[1:]:
            from_a, from_b = a + s[0] >= b + t[0], a + s[1] >= b + t[1]
            back.append((0 if from_a else 1, 0 if from_b else 1))
            a, b = x + (a + s[0] if from_a else b + t[0]), y + (a + s[1] if from_b else b + t[1])
        labels = [0 if a >= b else 1]
        for choice in reversed(back):
            labels.append(choice[labels[-1]])
        return labels[::-1]

    def train(self, pages: list[tuple[list[tuple[str, tuple[str, ...], float]], list[int]]], epochs: int = EPOCHS, seed: int = SEED) -> None:
        """Gradients of each page's log conditional likelihood, by forward-backward."""
        rng, squares, pair_squares = random.Random(seed), {}, [[1e-2, 1e-2], [1e-2, 1e-2]]
        prepared = [([[*p, *text_features(t, k)] for t, p, k in blocks], labels) for blocks, labels in pages if blocks]
        for _ in range(epochs):
            rng.shuffle(prepared)
            for rows, labels in prepared:
                psi, n = [self._sum(f) for f in rows], len(rows)
                forward, backward = [psi[0]], [(0.0, 0.0)] * n
                for k in range(1, n):
                    a, b = forward[-1]
                    forward.append(tuple(psi[k][y] + _log_add(a + self.pairs[0][y], b + self.pairs[1][y]) for y in (0, 1)))
                for k in range(n - 2, -1, -1):
                    backward[k] = tuple(_log_add(*(self.pairs[y][z] + psi[k + 1][z] + backward[k + 1][z] for z in (0, 1))) for y in (0, 1))
                total = _log_add(*forward[-1])
                expected = [[0.0, 0.0], [0.0, 0.0]]
                for k in range(1, n):
                    for y in (0, 1):
                        for z in (0, 1):
                            expected[y][z] += math.exp(min(0.0, forward[k - 1][y] + self.pairs[y][z] + psi[k][z] + backward[k][z] - total))
                    expected[labels[k - 1]][labels[k]] -= 1
                for k, features in enumerate(rows):
                    error = math.exp(min(0.0, forward[k][1] + backward[k][1] - total)) - labels[k]
                    if abs(error) < 1e-4:
                        continue
                    for f in features:
                        w, g = self.unary.setdefault(f, [0.0, 0.0]), squares.setdefault(f, [1e-2, 1e-2])
                        for y, d in ((0, -error), (1, error)):
                            d += DECAY * w[y]
                            g[y] += d * d
                            w[y] -= RATE * d / math.sqrt(g[y])
                for y in (0, 1):
                    for z in (0, 1):
                        d = expected[y][z] + DECAY * self.pairs[y][z]
                        pair_squares[y][z] += d * d
                        self.pairs[y][z] -= RATE * d / math.sqrt(pair_squares[y][z])
        self.paths.clear()


def _log_add(a: float, b: float) -> float:
    return max(a, b) + math.log1p(math.exp(-abs(a - b)))


#: Class words by which pages name what isn't the article, and what is; each labelled page draws from them.
AROUND = {
    "menu": "nav navigation navbar menu mainmenu topnav breadcrumb breadcrumbs tabs toc pagination pager".split(),
    "head": "header masthead top topbar logo brand banner tagline site title".split(),
    "foot": "footer foot bottom copyright legal colophon imprint credits contentinfo".split(),
    "side": "sidebar side aside rail widget widgets related recommended trending popular more tags categories archive author bio complementary".split(),
    "notice": "notice cookie cookies consent gdpr alert warning popup modal overlay newsletter subscribe signup paywall message info toast".split(),
    "advert": "ad ads advert advertisement advertising adsense sponsor sponsored promo promotion promoted banner commercial dfp".split(),
    "form": "form search login contact signup subscribe newsletter poll".split(),
    "comment": "comment comments commentlist reply replies respond discussion disqus reader responses thread feedback".split(),
    "share": "share sharing social buttons toolbar tools meta byline print".split(),
}
INSIDE = "content article post entry story body text main page maincontent articlebody postcontent primary prose".split()


def labelled_pages(count: int = PAGES, seed: int = SEED) -> list[tuple[str, list[tuple[str, int]]]]:
    """``count`` pages and, for each, its blocks' texts with their labels, in page order."""
    rng = random.Random(seed)
    syllables = ["".join(rng.choice(c) for c in ("bcdfghklmnprstvw", "aeiouäéö", "nrstl ")).strip() for _ in range(120)]

    def words(n: int) -> str:
        return " ".join("".join(rng.choices(syllables, k=rng.choice((1, 1, 2, 3)))) for _ in range(max(1, n)))

    def sentences(n: int) -> str:
        return " ".join(words(rng.randrange(3, 16)).capitalize() + rng.choice("....!?") for _ in range(n))

    def named(tag: str, kinds: list[str], inner: str) -> str:
        # Pages also name parts of what isn't the article by words such as content or body: comment-body, sidebar-content.
        mixed = kinds is not INSIDE and rng.random() < 0.25
        name = rng.choice(kinds) + (f"-{rng.choice(INSIDE)}" if mixed else rng.choice(("", "", "-box", "_wrap", "-1", " module", "-container", "-section")))
        return f'<{tag} {rng.choice(("class", "class", "id", "role" if len(name) < 9 else "id"))}="{name}">{inner}</{tag}>'

    def page() -> tuple[str, list[tuple[str, int]]]:
        said: list[tuple[str, int]] = []

        def block(tag: str, text: str, label: int, close: bool = True) -> str:
            said.append((" ".join(text.split()), label))
            return f"<{tag}>{html.escape(text)}" + (f"</{tag}>" if close else "")

        def link(text: str, label: int) -> str:
            said.append((text, label))
            return f'<a href="/{rng.randrange(99)}">{html.escape(text)}</a>'

        def links(n: int) -> str:
            return "<ul>" + "".join(f"<li>{link(words(rng.randrange(1, 5)), 0)}</li>" for _ in range(n)) + "</ul>"

        def around(kind: str) -> str:
            kinds = AROUND[kind]
            if kind == "menu":
                inner = links(rng.randrange(2, 9))
                return f"<nav>{inner}</nav>" if rng.random() < 0.6 else named("div", kinds, inner)
            if kind == "head":
                inner = block(rng.choice(("h1", "div", "p")), words(rng.randrange(1, 6)), 0) + (block("p", sentences(1), 0) if rng.random() < 0.4 else "")
                return f"<header>{inner}</header>" if rng.random() < 0.6 else named("div", kinds, inner)
            if kind == "foot":
                inner = block(rng.choice(("p", "div", "span")), rng.choice(("© ", "")) + words(rng.randrange(2, 9)) + rng.choice((".", " · " + sentences(1), "")), 0)
                inner = inner.replace("<span>", "").replace("</span>", "")
                return f"<footer>{inner}</footer>" if rng.random() < 0.6 else named("div", kinds, inner)
            if kind == "side":
                inner = block(rng.choice(("h2", "h3", "h4")), words(rng.randrange(1, 4)), 0) + rng.choice((links(rng.randrange(2, 6)), block("p", sentences(rng.randrange(1, 4)), 0)))
                return f"<aside>{inner}</aside>" if rng.random() < 0.5 else named(rng.choice(("div", "section", "aside")), kinds, inner)
            if kind == "form":
                inner = block("div", words(rng.randrange(1, 8)), 0) + '<input type="text">' + block("button", words(1), 0) + (block("p", sentences(1), 0) if rng.random() < 0.5 else "")
                inner = f"<form>{inner}</form>"
                return inner if rng.random() < 0.6 else named("div", kinds, inner)
            if kind == "comment":
                item = rng.choice(("li", "div", "article"))
                made = [f"<{item}>{block('h4', words(2), 0) if rng.random() < 0.5 else ''}{block('p', sentences(rng.randrange(1, 6)), 0)}</{item}>" for _ in range(rng.randrange(1, 6))]
                if rng.random() < 0.3:
                    made = [named("div", ["comment", "reply", "response"], x) for x in made]
                title = ""
                if rng.random() < 0.5:
                    kept = said[:]
                    del said[:]
                    title = block(rng.choice(("h2", "h3")), words(2), 0)
                    first = len(kept) - _made_since(made)
                    said[:] = kept[:first] + said + kept[first:]
                return named(rng.choice(("section", "div", "ol")), kinds, title + "".join(made))
            inner = block(rng.choice(("p", "div", "div")), sentences(rng.randrange(1, 4)) if rng.random() < 0.7 else words(4), 0)
            if rng.random() < 0.5:  # text right inside the named element
                inner = re.sub(r"^<\w+>|</\w+>$", "", inner)
            return named(rng.choice(("div", "section", "div", "p", "p") if "<" not in inner else ("div", "div", "section")), kinds, inner)

        def _made_since(made: list[str]) -> int:
            return sum(x.count("<h4>") + x.count("<p>") for x in made)

        def body() -> str:
            out = block("h1", words(rng.randrange(2, 10)), 1) if rng.random() < 0.85 else ""
            for _ in range(rng.choice((1, 2, 3, 4, 6, 9, 14))):
                kind = rng.random()
                if kind < 0.68:
                    opening = rng.choice(("p", "p", "p", "div"))
                    text = sentences(rng.choice((1, 1, 2, 4, 8))) if rng.random() < 0.9 else words(rng.randrange(1, 30))
                    if opening == "p" and rng.random() < 0.25:
                        out += block("p", text, 1, close=False).replace("<p>", "<p><b>") + "<br>"
                    else:
                        out += block(opening, text, 1)
                elif kind < 0.76:
                    out += block(rng.choice(("h2", "h3")), words(rng.randrange(1, 7)), 1)
                elif kind < 0.83:
                    out += "<ul>" + "".join(block("li", sentences(1) if rng.random() < 0.5 else words(4), 1) for _ in range(rng.randrange(1, 5))) + "</ul>"
                elif kind < 0.87:
                    out += "<blockquote>" + block("p", sentences(2), 1) + "</blockquote>"
                elif kind < 0.9:
                    out += block("pre", words(9), 1)
                elif kind < 0.93:
                    out += "<table><tr>" + "".join(block("td", words(2), 1) for _ in range(3)) + "</tr></table>"
                else:
                    out += around(rng.choice(("advert", "share", "side", "notice")))
            return out

        before = [around(k) for k in ("notice", "head", "menu", "advert", "side", "form") if rng.random() < 0.45]
        style = rng.random()
        inner = body()
        if rng.random() < 0.15:
            inner += around("comment")
        if style < 0.5:
            main = f"<article>{inner}</article>"
        elif style < 0.62:
            main = f"<main>{inner}</main>"
        elif style < 0.7:
            main = f"<main><article>{inner}</article></main>"
        elif style < 0.92:
            main = named(rng.choice(("div", "section", "article")), INSIDE, inner)
            if rng.random() < 0.3:
                main = named("div", INSIDE, main)
        else:
            main = inner
        after = [around(k) for k in ("share", "comment", "side", "advert", "form", "menu", "notice", "foot") if rng.random() < 0.45]
        wrap = ("<div class=\"wrapper\">", "</div>") if rng.random() < 0.3 else ("", "")
        head = f"<head><title>{words(3)}</title><style>p{{}}</style></head>"
        return f"<!DOCTYPE html><html>{head}<body>{wrap[0]}{''.join(before)}{main}{''.join(after)}{wrap[1]}</body></html>", said

    return [page() for _ in range(count)]


def trained_blocks(pages: list[tuple[str, list[tuple[str, int]]]]) -> list[tuple[list[tuple[str, tuple[str, ...], float]], list[int]]]:
    """The pages' parsed blocks with their labels; blocks whose text was made twice with different labels go."""
    out = []
    for page, said in pages:
        labels: dict[str, set[int]] = {}
        for text, label in said:
            labels.setdefault(text, set()).add(label)
        blocks = [b for b in leaf_blocks(page) if len(labels.get(b[0], ())) == 1]
        out.append((blocks, [min(labels[b[0]]) for b in blocks]))
    return out


@lru_cache(maxsize=1)
def trained_field() -> Field:
    field = Field()
    field.train(trained_blocks(labelled_pages()))
    return field


def main_text(page: str, field: Field) -> str:
    blocks = leaf_blocks(page, field.known)
    return "\n".join(b[0] for b, label in zip(blocks, field.viterbi(blocks)) if label)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of each page.

    Defined cases: a null or empty page has an empty text; markup that never
    ends is dropped up to the page's end; repeated rows give repeated rows; an
    empty table gives an empty result. Other columns are not passed on.
    """
    spark = session_of(pages)
    small_batches(spark)
    shared = spark.sparkContext.broadcast(trained_field())

    @F.arrow_udf("string")
    def texts(htmls: Iterator[pa.Array]) -> Iterator[pa.Array]:
        field = shared.value
        for batch in htmls:
            yield pa.array([main_text(h, field) for h in batch.to_pylist()], pa.string())
    out = pages.select("page_id", "url", texts(F.coalesce("html", F.lit(""))).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))
