"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A page is cut into leaf blocks: the text between two tags that begin or end a block. Scripts, styles, comments and
other matter that no reader sees make no blocks. A block has the features of its ancestors (tags, and the words of
their class, id and role), of its text (length, share of links, marks, numbers, telling words) and of its place. The
field has two states, main and rest; its weights are trained by gradient ascent on the likelihood of labelled pages,
and Viterbi's path through a page says which blocks make the text.

Labelled pages are of two kinds: at most ``SAMPLE`` pages of the input itself, those with the smallest key hashes among
the pages of at most ``SAMPLE_BYTES`` whose own markup tells the article (an ``article`` or ``main`` element), and ``MADE``
pages laid out by a seeded generator in the usual ways (with sidebars, notices, forms and comments, with and without
telling elements, of one paragraph or many, with tables, figures and lists, text that stands right in its shell, notices
and adverts inside the article, pages with hardly any markup). While training, the features of ancestors
are dropped now and then, so that texts and neighbours count too.

Character references are decoded, white space inside a block is one space, and the main blocks are joined by line
ends. Formulas stay in their sentence; unseen elements inside one, buttons among them, are passed over. Line breaks
(``br``) are white space. Null or empty html, and pages without main blocks, give ''. Very long pages are
taken whole, in time linear in their length; markup that nothing closes is no exception. Of states of equal score a block
takes rest, so ties are settled alike everywhere. Repeated rows give equal texts, each for itself. Rows are neither merged
nor dropped; other columns are ignored, and an empty table gives an empty result. Without labelled pages of its own the
field is trained on made ones alone.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common

#: Pages of the input that the field is trained on, at most.
SAMPLE = 300
MADE = 1000
BITS = 12
SEED = 11
STEPS = 400
#: Sets of chains that the steps take in turn.
TURNS = 4
RATE = 0.12
RIDGE = 2e-4
DROPPED = 0.3

#: Training pages of the input have at most so many bytes of html; longer ones are not used to train, but extracted like all.
SAMPLE_BYTES = 1 << 20
#: Chains that the field is trained on have at most so many blocks: longer pages are several chains, none of their blocks left out.
CHAIN = 64

# Elements of HTML by what they are to a reader.
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input".split())
#: Formulas are part of the sentence they stand in.
FORMULA = frozenset("math mi mo mn ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd mstyle mspace mpadded mphantom menclose merror semantics".split())
#: Parts of a text that stand in another element together with their neighbours.
HELD = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption hr html body".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head svg annotation annotation-xml iframe object canvas audio video select textarea button datalist".split())
#: Raw text up to their end tag.
RAW = frozenset("script style textarea title".split())
#: An open element of the left kind ends when one of the right starts.
CLOSED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]),
}
#: Blocks of these words alone say what the next one is.
HEADS = {
    "advert": frozenset(["advertisement", "advert", "advertising", "ad", "sponsored", "sponsored content", "promoted", "anzeige", "werbung", "publicité", "publicidad"]),
    "sign-up": frozenset(["newsletter", "subscribe", "sign up", "our newsletter", "subscribe to our newsletter", "get the newsletter", "join our newsletter"]),
}
TELLING = ("cookie", "subscribe", "newsletter", "login", "log in", "sign in", "privacy", "copyright", "©", "all rights", "comment", "reply", "share", "advert", "sponsored", "related", "read more", "menu", "search", "posted", "accept", "promo", "this site", "your email", "inbox", "click here", "buy now", "% off")

#: What ends no block: unseen elements are passed over inside a sentence.
_WITHIN = INLINE | FORMULA | UNSEEN
_NAME_AT = r"<(/?)([a-zA-Z][^\s/>]*+)"
#: A tag whose quotes are closed, and one that ends at the next > whatever its quotes.
_TAG = re.compile(_NAME_AT + r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(_NAME_AT + r"([^>]*+)>")
_ATTR = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")


#: An open element: tag, whether unseen, the block element above or itself, all tags and names above, its holder.
Element = tuple[str, bool, str, frozenset, frozenset, int]


class Block:
    """A text and what stands around it: the element right above, all tags and names (of class, id, role) above, and the
    number of the element that holds it together with its neighbours."""

    __slots__ = ("holder", "linked", "names", "parent", "raw", "tags")

    def __init__(self, parent: str, tags: frozenset, names: frozenset, holder: int, raw: str, linked: int):
        self.parent, self.tags, self.names, self.holder, self.raw, self.linked = parent, tags, names, holder, raw, linked


def _pieces(page: str) -> Iterator[tuple[str, str, str, str]]:
    """Text and tags in order, in linear time: ("", "", "", text), or ("/" or "", name, attributes, "").

    Comments and declarations are passed over. Raw text is passed over up to its end tag. Once a tag's quotes are not
    closed before the page's end, tags end at the next >; what looks like a tag that nothing ends is text."""
    size, at, last = len(page), 0, page.rfind(">")
    loose, cdata = False, True
    while at < size:
        i = page.find("<", at)
        while 0 <= i < last and not (page[i + 1].isalpha() or page[i + 1] in "/!?"):
            i = page.find("<", i + 1)
        if not 0 <= i < last:
            yield "", "", "", page[at:]
            return
        if i > at:
            yield "", "", "", page[at:i]
        at = i
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            at = end + 3 if end >= 0 else size
            continue
        if cdata and page.startswith("<![CDATA[", i):
            end = page.find("]]>", i)
            cdata = end >= 0
            if cdata:
                at = end + 3
                continue
        if page[i + 1] in "!?":
            at = page.find(">", i) + 1
            continue
        found = None if loose else _TAG.match(page, i)
        if not found:
            found = _LOOSE.match(page, i)
            if not found:  # no name after </
                if page[i + 1] == "/":
                    at = page.find(">", i) + 1
                else:
                    yield "", "", "", page[i]
                    at = i + 1
                continue
            loose = True
        at = found.end()
        tag = found[2].lower()
        yield found[1], tag, found[3], ""
        if tag in RAW and not found[1]:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = end.end() if end else size


def leaf_blocks(page: str) -> list[Block]:
    """The blocks of text of a page in order."""
    blocks: list[Block] = []
    none = frozenset()
    stack: list[Element] = []
    page_itself: Element = ("", False, "", none, none, 0)
    holders = 0
    open_: Counter[str] = Counter()
    parts: list[str] = []
    linked, links, unseen = 0, 0, 0

    def close(within: Element) -> None:
        nonlocal linked
        raw = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if raw:
            _, _, parent, tags, names, holder = within
            blocks.append(Block(parent, tags, names, holder, raw, linked))
        parts.clear()
        linked = 0

    def pop() -> None:
        nonlocal links, unseen
        tag, out, *_ = stack.pop()
        open_[tag] -= 1
        unseen -= out
        links -= tag == "a"

    for ending, tag, attributes, text in _pieces(page):
        if not tag:
            if not unseen:
                parts.append(text)
                if links:
                    linked += len(text)
            continue
        if ending:
            if open_[tag]:
                if tag not in _WITHIN:
                    within = stack[-1]
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                    if not unseen:
                        close(within)
                else:  # of the open elements down to the last block only
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == tag:
                            while len(stack) > k:
                                pop()
                            break
                        if stack[k][0] not in _WITHIN:
                            break
            elif tag == "br":
                parts.append(" ")
            elif tag == "p" and not unseen:
                close(stack[-1] if stack else page_itself)
            continue
        if tag in RAW:
            continue
        if tag not in _WITHIN:
            if not unseen:
                close(stack[-1] if stack else page_itself)
            while stack and stack[-1][0] in INLINE and any(open_[t] and tag in closers for t, closers in CLOSED_BY.items()):
                pop()
            while stack and stack[-1][0] in CLOSED_BY and tag in CLOSED_BY[stack[-1][0]]:
                pop()
        elif tag in ("br", "img", "input", "wbr"):
            if tag != "wbr":
                parts.append(" ")
            continue
        if tag in VOID:
            continue
        names: list[str] = []
        out = tag in UNSEEN
        if attributes and attributes.strip() not in ("", "/"):
            for key, value in _ATTR.findall(attributes):
                key, value = key.lower(), value.strip("\"'").lower()
                if key in ("class", "id", "role"):
                    names += _NAME.findall(value)
                elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                    out = True
        _, _, parent, above, called, holder = stack[-1] if stack else page_itself
        if tag in _WITHIN:
            stack.append((tag, out, parent, above, called, holder))
        else:
            if tag not in HELD:
                holders += 1
                holder = holders
            stack.append((tag, out, tag, above if tag in above else above | {tag}, called if called.issuperset(names) else called.union(names), holder))
        open_[tag] += 1
        unseen += out
        links += tag == "a"
        if attributes.endswith("/") and tag in ("svg", "path", "g"):
            pop()
    close(stack[-1] if stack else page_itself)
    return blocks


# --- features ---------------------------------------------------------------------------------------------------

_SLOTS: dict[str, int] = {}


def _slot(name: str) -> int:
    if name not in _SLOTS:
        if len(_SLOTS) > 1 << 16:
            _SLOTS.clear()
        _SLOTS[name] = zlib.crc32(name.encode()) & ((1 << BITS) - 1)
    return _SLOTS[name]


def features(blocks: list[Block]) -> list[tuple[list[int], list[int]]]:
    """For each block the slots of its ancestors' features and of all others."""
    out = []
    n = len(blocks)
    heads = [next((w for w in HEADS if b.raw.lower().strip(" :.-–—") in HEADS[w]), "") for b in blocks]
    held: Counter[int] = Counter()
    for b in blocks:
        held[b.holder] += max(1, len(b.raw) - b.linked)
    most = max(held.values(), default=1)
    for i, b in enumerate(blocks):
        above = {f"<{t}" for t in b.tags} | {f".{w}" for w in b.names}
        if b.parent:
            above.add(f"in<{b.parent}")
        text, low = b.raw, b.raw.lower()
        words = text.count(" ") + 1
        own = ["bias", f"words{min(7, words.bit_length())}", f"links{min(4, int(4.99 * min(1.0, b.linked / max(1, len(text)))))}"]
        own.append(f"ends{text[-1] if text[-1] in '.!?…:' else 'x'}")
        own.append(f"commas{min(3, text.count(','))}")
        if any(c.isdigit() for c in text):
            own.append("digits")
        if text[:1].isupper():
            own.append("capital")
        if i == 0:
            own.append("first")
        if i == n - 1:
            own.append("last")
        own.append(f"place{4 * i // n}")
        own += [f"says{w}" for w in TELLING if w in low]
        if heads[i]:
            own.append(f"heads{heads[i]}")
        if i and heads[i - 1]:
            own.append(f"under{heads[i - 1]}")
        share = held[b.holder] / most
        holds = "holds most" if share == 1 else f"holds{int(4 * share)}" if share >= 0.1 else "holds little"
        own.append(holds)
        if n == 1:
            own.append("alone")
        out.append(([_slot(a) for a in sorted(above)], [_slot("t:" + o) for o in own]))
    return out


# --- the field --------------------------------------------------------------------------------------------------


class Chains:
    """Labelled chains side by side: their features, the places that are blocks, and the states that are right."""

    def __init__(self, pages: list[tuple[list[tuple[list[int], list[int]]], list[int]]]):
        self.width, self.count = max(len(f) for f, _ in pages), len(pages)
        self.real = np.zeros((self.count, self.width), bool)
        gold = np.zeros((self.count, self.width), np.int64)
        flat, where, ancestor = [], [], []
        for i, (feats, labels) in enumerate(pages):
            self.real[i, : len(feats)] = True
            gold[i, : len(feats)] = labels
            for j, (above, own) in enumerate(feats):
                flat += above + own
                where += [i * self.width + j] * (len(above) + len(own))
                ancestor += [True] * len(above) + [False] * len(own)
        self.flat, self.where, self.ancestor = np.array(flat), np.array(where), np.array(ancestor)
        self.target = np.zeros((self.count * self.width, 2))
        self.target[np.arange(self.count * self.width), gold.ravel()] = 1
        both = self.real[:, 1:]
        self.pair = np.zeros((2, 2))
        np.add.at(self.pair, (gold[:, :-1][both], gold[:, 1:][both]), 1)


class Field:
    """Weights of (feature, state) and of (state, next state)."""

    def __init__(self) -> None:
        self.unary = np.zeros((1 << BITS, 2))
        self.step = np.zeros((2, 2))

    def scores(self, slots: list[list[int]]) -> np.ndarray:
        flat = np.concatenate([np.asarray(s, np.int64) for s in slots])
        return np.add.reduceat(self.unary[flat], np.cumsum([0, *map(len, slots[:-1])]), axis=0)

    def decode(self, slots: list[list[int]]) -> np.ndarray:
        """Viterbi: the likeliest states."""
        u, t = self.scores(slots).tolist(), self.step.tolist()
        a, b, back = u[0][0], u[0][1], []
        for x, y in u[1:]:
            from_a, from_b = (a + t[0][0] >= b + t[1][0]), (a + t[0][1] >= b + t[1][1])
            a, b = (a + t[0][0] if from_a else b + t[1][0]) + x, (a + t[0][1] if from_b else b + t[1][1]) + y
            back.append((0 if from_a else 1, 0 if from_b else 1))
        state = [0 if a >= b else 1]
        for step in reversed(back):
            state.append(step[state[-1]])
        return np.array(state[::-1])

    def train(self, pages: list[tuple[list[tuple[list[int], list[int]]], list[int]]]) -> None:
        """Adaptive gradient ascent on the log-likelihood, with forward and backward sums over many chains at once; the
        chains are dealt to ``TURNS`` sets, which take turns."""
        rng = np.random.default_rng(SEED)
        pages = [(f[i : i + CHAIN], y[i : i + CHAIN]) for f, y in pages for i in range(0, len(f), CHAIN)]
        if not pages:
            return
        order = rng.permutation(len(pages))
        sets = [Chains([pages[i] for i in part]) for part in np.array_split(order, min(TURNS, len(pages)))]
        sum_u, sum_s = np.full_like(self.unary, 1e-8), np.full_like(self.step, 1e-8)
        for turn in range(STEPS):
            chains = sets[turn % len(sets)]
            # Per page, either some of the ancestors' features are out, or all of them are, or none is.
            mode = rng.random(chains.count)[chains.where // chains.width]
            keep = ~chains.ancestor | (mode > DROPPED) | ((mode > DROPPED / 3) & (rng.random(len(chains.flat)) > 0.5))
            _, grad, step = self.likelihood(chains, keep)
            sum_u += grad**2
            sum_s += step**2
            self.unary += RATE * grad / np.sqrt(sum_u) * 2
            self.step += RATE * step / np.sqrt(sum_s) * 2

    def likelihood(self, chains: Chains, keep: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The mean log-likelihood of the chains less the ridge, with its gradients by unary and step."""
        count, width, real, flat, where = chains.count, chains.width, chains.real, chains.flat[keep], chains.where[keep]
        score = np.stack([np.bincount(where, self.unary[flat, s], count * width) for s in (0, 1)], axis=1).reshape(count, width, 2)
        ahead, behind = np.zeros((count, width, 2)), np.zeros((count, width, 2))
        ahead[:, 0] = score[:, 0]
        for j in range(1, width):
            new = np.logaddexp(ahead[:, j - 1, :1] + self.step[0], ahead[:, j - 1, 1:] + self.step[1]) + score[:, j]
            ahead[:, j] = np.where(real[:, j, None], new, ahead[:, j - 1])
        for j in range(width - 2, -1, -1):
            next_ = behind[:, j + 1] + score[:, j + 1]
            new = np.logaddexp(next_[:, :1] + self.step[:, 0], next_[:, 1:] + self.step[:, 1])
            behind[:, j] = np.where(real[:, j + 1, None], new, 0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        state = np.exp(ahead + behind - total[:, None, None]) * real[:, :, None]
        diff = (chains.target * real.reshape(-1, 1) - state.reshape(-1, 2)) / count
        grad = np.stack([np.bincount(flat, diff[where, s], 1 << BITS) for s in (0, 1)], axis=1) - RIDGE * self.unary
        both = real[:, 1:]
        joint = ahead[:, :-1, :, None] + self.step + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]
        step = (chains.pair - (np.exp(np.minimum(joint, 0)) * both[:, :, None, None]).sum((0, 1))) / count - RIDGE * self.step
        gold = (score.reshape(-1, 2) * chains.target * real.reshape(-1, 1)).sum() + (chains.pair * self.step).sum()
        return float((gold - total.sum()) / count - RIDGE / 2 * ((self.unary**2).sum() + (self.step**2).sum())), grad, step


# --- labelled pages ---------------------------------------------------------------------------------------------

_REST = frozenset("nav aside footer form dialog menu".split())
_REST_NAMES = frozenset("ad ads advert adverts advertisement banner cookie cookies consent notice sidebar comment comments replies menu nav footer newsletter share social related promo breadcrumb breadcrumbs popup subscribe login".split())


def own_labels(blocks: list[Block]) -> list[int] | None:
    """Which blocks the page's own markup says to be the article; None where it does not say."""
    out = []
    for b in blocks:
        told = "article" in b.tags or "main" in b.tags
        out.append(int(told and not _REST & b.tags and not _REST_NAMES & b.names))
    return out if any(out) else None


_SYLLABLES = "the and ing er on re ti en at or st nd ha es le de la un que os ch ver be ein lich ge au eau ment".split()


def made_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A page in one of many layouts, and which of its blocks are main."""

    def pick(*options: str) -> str:
        return str(rng.choice(options))

    odd = rng.random() < 0.15  # numbers, keys and marks instead of prose

    def word() -> str:
        if rng.random() < (0.4 if odd else 0.02):
            return pick(str(rng.integers(10**9)), f"{rng.integers(2**60):x}", "=", "+1", "(984)", '"x7"', "224.228.19.86", "a_b", "%%%", "***", "|")
        return "".join(rng.choice(_SYLLABLES, rng.integers(1, 4)))

    def sentence(low: int, high: int) -> str:
        words = [word() for _ in range(rng.integers(low, high))]
        return (" ".join(w + ("," if rng.random() < 0.08 else "") for w in words)).capitalize() + rng.choice([".", ".", ".", "!", "?"])

    labels: list[int] = []

    def block(tag: str, text: str, main: int, attributes: str = "") -> str:
        labels.append(main)
        return f"<{tag}{attributes}>{text}</{tag}>"

    def menu(tag: str, name: str) -> str:
        return f'<{tag} class="{name}"><ul>' + "".join(block("li", f'<a href="/{word()}">{word()}</a>', 0) for _ in range(rng.integers(2, 8))) + f"</ul></{tag}>"

    def rest(kind: str) -> str:
        if kind == "menu":
            return menu(pick("nav", "div", "ul", "header"), pick("nav", "menu", "navbar", "topbar", "links"))
        if kind == "header":
            return f'<{(t := pick("header", "div"))} class="{pick("header", "site", "masthead", "branding")}">' + block(pick("h1", "div", "p", "span div".split()[1]), word().capitalize(), 0) + f"</{t}>"
        if kind == "crumbs":
            return f'<div class="{pick("breadcrumb", "breadcrumbs", "path")}">' + block("div", " &gt; ".join(f'<a href="/">{word()}</a>' for _ in range(3)), 0) + "</div>"
        if kind == "plain-ad":  # nothing but its heading tells
            t = pick("div", "p", "div")
            return block(pick("div", "p", "span div".split()[1]), pick("Advertisement", "ADVERTISEMENT", "Sponsored", "Advertising", "Promoted"), 0) + block(t, sentence(3, 25), 0)
        if kind == "inner-notice":
            t = pick("aside", "div", "section")
            return f'<{t} class="{pick("notice", "newsletter", "newsletter-signup", "subscribe", "alert", "promo", "related")}">' + "".join(
                block(pick("p", "h4", "div"), pick("Subscribe to our newsletter", "", "Get it in your inbox. ", "Sign up. ") + sentence(3, 20), 0) for _ in range(rng.integers(1, 3))
            ) + f"</{t}>"
        if kind == "ad":
            return block("div", sentence(3, 25), 0, f' class="{pick("ad", "ads", "advert", "banner", "sponsored", "promo")}"')
        if kind == "notice":
            return f'<{(t := pick("div", "section", "dialog", "aside"))} class="{pick("cookie", "cookie-banner", "notice", "consent", "alert", "popup")}">' + block("p", pick("We use cookies. ", "", "This site uses cookies. ") + sentence(5, 20), 0) + f"<button>{pick('Accept', 'OK', word())}</button></{t}>"
        if kind == "form":
            return f'<form class="{pick("search", "login", "subscribe", "newsletter", "contact")}">' + block("p", pick("Subscribe to our newsletter", "Search", sentence(3, 12)), 0) + '<input name="q">' + f"<button>{pick('Search', 'Send', 'Go', word())}</button></form>"
        if kind == "sidebar":
            t = pick("aside", "div", "section")
            return f'<{t} class="{pick("sidebar", "side", "related", "widget", "rail")}">' + block("h3", pick("Related", "Popular", word()), 0) + "".join(block(pick("p", "li", "div"), pick("", f'<a href="/{word()}">') + sentence(3, 22), 0) for _ in range(rng.integers(1, 5))) + f"</{t}>"
        if kind == "share":
            return f'<div class="{pick("share", "social", "tags", "meta")}">' + block("div", f'<a href="#">Share</a> <a href="#">{word()}</a>', 0) + "</div>"
        if kind == "comments":
            t, c = pick("section", "div", "ul", "aside"), pick("comments", "comment-list", "replies", "discussion", "responses")
            return f'<{t} {pick("class", "id")}="{c}">' + block("h2", pick("Comments", "3 replies", word()), 0) + "".join(
                f'<{(u := pick("div", "li", "article"))} class="{pick("comment", "reply", "post")}">' + block("p", sentence(4, 40), 0) + f"</{u}>" for _ in range(rng.integers(1, 5))
            ) + f"</{t}>"
        t = pick("footer", "div")
        return f'<{t} class="{pick("footer", "bottom", "legal", "copyright")}">' + block(pick("p", "div"), pick("&copy; ", "Copyright ", "") + word() + ".com &middot; " + sentence(3, 15), 0) + f"</{t}>"

    def loose(text: str) -> str:
        """Text that stands right in its shell is a block of its own."""
        labels.append(1)
        return text

    def lines() -> str:
        return pick("<br>", "<br><br>", "<br/>\n<br/>").join(" ".join(sentence(4, 25) for _ in range(rng.integers(1, 5))) for _ in range(rng.integers(1, 6)))

    def shell_text() -> list[str]:
        """An article whose paragraphs are lines, with a heading, a list or a notice among them or not."""
        inner = [block(pick("h1", "h2"), sentence(2, 12), 1)] if rng.random() < 0.4 else []
        inner.append(loose(lines()))
        for _ in range(rng.integers(0, 3)):
            inner.append(rest(pick("plain-ad", "inner-notice", "ad")) if rng.random() < 0.3 else block(pick("h2", "blockquote", "p", "div"), sentence(3, 25), 1))
            if rng.random() < 0.7:
                inner.append(loose(lines()))
        return inner

    def article() -> str:
        short = rng.random() < 0.25  # one or two paragraphs and nothing else
        right_in = rng.random() < 0.4
        inner = [loose(lines()) if rng.random() < 0.6 else block("div", lines(), 1)] if right_in and rng.random() < 0.5 else shell_text() if right_in else [block(pick("h1", "h1", "h2"), sentence(2, 12), 1)] if rng.random() < (0.3 if short else 0.9) else []
        if right_in:
            short = False
        elif short:
            inner += [block("p", " ".join(sentence(3, 20) for _ in range(rng.integers(1, 4))), 1) for _ in range(rng.integers(1, 3) if rng.random() < 0.5 else 1)]
        for _ in range(0 if short or right_in else rng.integers(1, 3 if rng.random() < 0.25 else 12)):
            kind = rng.random()
            text = sentence(2, 14) if rng.random() < 0.25 else " ".join(sentence(4, 25) for _ in range(rng.integers(1, 5)))
            if kind < 0.6:
                inner.append(block("p", f"<b>{text}</b>" if rng.random() < 0.1 else text, 1))
            elif kind < 0.66:
                cells = rng.integers(2, 5)
                rows = [f"<tr>{''.join(block(pick('td', 'td', 'th'), word() if rng.random() < 0.7 else str(rng.integers(10**4)), 1) for _ in range(cells))}</tr>" for _ in range(rng.integers(2, 5))]
                inner.append(f"<table>{pick('', '<tbody>')}{''.join(rows)}</table>")
            elif kind < 0.69:
                inner.append('<figure><img src="x">' + block("figcaption", sentence(2, 12), 1) + "</figure>")
            elif kind < 0.72:
                inner.append("<dl>" + "".join(block("dt", word(), 1) + block("dd", sentence(2, 12), 1) for _ in range(rng.integers(1, 4))) + "</dl>")
            elif kind < 0.8:
                inner.append(block(pick("h2", "h3"), sentence(2, 8), 1))
            elif kind < 0.88:
                inner.append("<ul>" + "".join(block("li", sentence(2, 15), 1) for _ in range(rng.integers(2, 5))) + "</ul>")
            elif kind < 0.94:
                inner.append(block("blockquote", text, 1))
            elif kind < 0.97:
                inner.append(block("pre", text, 1))
            else:
                inner.append(rest(pick("ad", "share", "sidebar", "form")))
            if rng.random() < 0.1:
                inner.append(rest(pick("plain-ad", "inner-notice")))
        if rng.random() < 0.2:
            inner.append(rest("comments"))
        shell = pick("article", "article", "main", "div", "div", "section")
        named = pick("content", "post", "entry", "article", "story", "main", "body", "post-content", "text", "")
        wrap = pick("", "", "main", "div")
        body = (f"<{shell}>" if rng.random() < 0.35 else f'<{shell} {pick("class", "id")}="{named}">') + "".join(inner) + f"</{shell}>"
        return f'<{wrap} class="{pick("container", "wrapper", "page", "main")}">{body}</{wrap}>' if wrap else body

    def some(kinds: list[str], share: float) -> list[str]:
        return [rest(k) for k in kinds if rng.random() < share]

    if rng.random() < 0.06:  # no markup, or hardly any
        if rng.random() < 0.5:
            return loose(lines()), labels
        return "".join(block("p", " ".join(sentence(3, 25) for _ in range(rng.integers(1, 4))), 1) for _ in range(rng.integers(1, 5))), labels
    if rng.random() < 0.2:  # nothing around the article
        page = article()
        return f"<html><body>{page}</body></html>", labels
    page = "".join([*some(["notice", "header", "menu", "crumbs", "form", "ad", "plain-ad", "sidebar"], 0.45), article(), *some(["share", "ad", "sidebar", "comments", "form", "notice", "menu", "footer"], 0.45)])
    return f"<html><body>{page}</body></html>", labels


def fit(spark: SparkSession, pages: DataFrame, sample: int = SAMPLE) -> Field:
    field = Field()
    told = pages.select("page_id", "html").filter(F.lower("html").rlike("<(article|main)[ >]") & (F.octet_length("html") <= SAMPLE_BYTES))
    rows = told.orderBy(F.xxhash64("page_id"), "page_id", F.xxhash64("html")).limit(sample)
    labelled = []
    for row in rows.toLocalIterator():
        blocks = leaf_blocks(row.html)
        if (labels := own_labels(blocks)) is not None:
            labelled.append((features(blocks), labels))
    rng = np.random.default_rng(SEED)
    for _ in range(MADE):
        page, labels = made_page(rng)
        blocks = leaf_blocks(page)
        if len(blocks) == len(labels):
            labelled.append((features(blocks), labels))
    field.train(labelled)
    return field


def text_of(field: Field, page: str | None) -> str:
    blocks = leaf_blocks(page or "")
    if not blocks:
        return ""
    state = field.decode([above + own for above, own in features(blocks)])
    return "\n".join(b.raw for b, s in zip(blocks, state, strict=True) if s)


def extract(spark: SparkSession, pages: DataFrame, field: Field | None = None) -> DataFrame:
    """Per row of pages: page_id, url, text, n_chars."""
    field = field or fit(spark, pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "html"):
            text = [text_of(field, h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(text), pa.array(map(len, text), pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
