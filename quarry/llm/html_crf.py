"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks, runs of text between block-level tags. Features of a block come from its ancestors (tags, the kind of
the innermost sectioning element, word groups in class, id and role) and from its text (length, links, punctuation, stock phrases).
Two states, main or not, form a chain; weights are fitted by gradient on the log-likelihood of labelled pages, and Viterbi decoding
picks the blocks to keep. The labelled pages are made here: many layouts with known main blocks, from a seeded generator (PAGES is their number).
"""

from __future__ import annotations

import html
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.shared import map_rows

PAGES, SEED, STEPS = 500, 11, 250
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
RAW = {"script", "style", "noscript", "template", "title", "textarea", "iframe"}
END = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}
#: Elements whose text is left out, up to their closing tag or their parent's end.
HELD = {"svg", "math", "select", "object", "canvas"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
SECTIONS = ("article", "main", "nav", "header", "footer", "aside", "form", "section", "head", "dialog", "figure")
TAGS = ("p", "li", "ul", "ol", "dl", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "table", "td", "figcaption", "button", "label", "details", "address", "div", "a", "b")
#: Word groups in class, id, role and the like.
GROUPS = {
    "advert": r"ads?|advert\w*|sponsor\w*|promo\w*|banner|adsense|doubleclick|outbrain|taboola|affiliate",
    "menu": r"nav\w*|menu\w*|breadcrumbs?|crumbs?|toolbar|tabs?|pagination|pager|toc|skip",
    "foot": r"foot\w*|copyright|legal|colophon|contentinfo|imprint",
    "head": r"head|header|masthead|topbar|brand\w*|logo|site|hero",
    "side": r"side\w*|aside|rail|related|recommend\w*|widget\w*|trending|popular|complementary|more",
    "comment": r"comments?|reply|replies|respond|disqus|discussion|reviews?|thread|guestbook|feedback",
    "notice": r"cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscrib\w*|signup|paywall|toast|announcement|dialog",
    "share": r"share|sharing|social|follow|tweet|like",
    "form": r"form|search|login|input|field|contact",
    "meta": r"meta|byline|author|tags?|date|category|categories|posted",
    "content": r"content|article\w*|post|entry|main|story|body|text|prose|blog",
}
GROUP = {k: re.compile(rf"(?:\A|[^a-z])(?:{v})(?:[^a-z]|\Z)") for k, v in GROUPS.items()}
STOCK = re.compile(r"cookie|©|copyright|all rights reserved|privacy policy|terms of (?:use|service)|subscribe|newsletter|sign (?:in|up)|log ?in|advertis|sponsored|read more|share (?:this|on)|leave a (?:comment|reply)|posted by|related|follow us", re.I)

NAMES = [
    "bias", *(f"in {x}" for x in SECTIONS), *(f"within {x}" for x in SECTIONS), *(f"tag {x}" for x in TAGS), *(f"group {x}" for x in GROUPS), *(f"near {x}" for x in GROUPS), "plain",
    "chars<25", "chars<60", "chars<150", "chars>=150", "words<4", "words>=20", "links none", "links some", "links most", "ends sentence", "commas", "digits", "stock", "first", "last", "under body",
]
AT = {n: i for i, n in enumerate(NAMES)}

Block = tuple[str, tuple[tuple[str, str], ...], int]


def blocks(page: str | None) -> list[Block]:
    """(text, ((tag, attribute words), ...) from the outermost element in, characters inside links) of the leaf blocks in page order.
    Malformed markup is read as browsers would, roughly: unclosed elements end with their parent, stray closing tags are dropped."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    parts: list[str] = []
    linked = 0
    path: tuple = ()
    hidden = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            out.append((text, path, min(linked, len(text))))
        parts.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked, path
        if hidden or not text:
            return
        if not parts or text.strip() and not "".join(parts[-3:]).strip():
            path = tuple(stack)
        parts.append(text)
        if any(t == "a" for t, _ in stack):
            linked += len(text.strip())

    at, n = 0, len(page or "")
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                say(m[0][9:-3])
            continue
        held = next((i for i, (t, _) in enumerate(stack) if t in HELD), len(stack)) if hidden else len(stack)
        if m["close"] or m["close2"]:
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if tag not in INLINE and tag not in HELD and (held == len(stack) or 0 <= depth < held):
                flush()
            if depth >= 0 and (tag not in INLINE or all(t in INLINE for t, _ in stack[depth:held])):
                hidden -= sum(w.startswith("\0") for _, w in stack[depth:])
                del stack[depth:]
            continue
        attrs = m["attrs"] or m["attrs2"] or ""
        if tag in RAW:
            if attrs.endswith("/") and tag not in ("script", "style"):
                continue
            closed = END[tag].search(page, at)
            if closed:
                at = closed.end()
            elif tag in ("script", "style"):
                break  # code to the end of the page
            continue  # any other without an end is empty
        if tag == "br":
            say(" ")
            continue
        if tag in HELD:
            if not (tag in ("svg", "math") and attrs.endswith("/")):
                stack.append((tag, "\0"))
                hidden += 1
            continue
        if tag not in INLINE:
            if held == len(stack):
                flush()
            closes = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",)}.get(tag, ()) + ("p",)
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in closes:
                    if i < held < len(stack):
                        flush()
                    hidden -= sum(w.startswith("\0") for _, w in stack[i:])
                    del stack[i:]
                    break
                if stack[i][0] not in INLINE and stack[i][0] not in ("p", "div") and not (stack[i][0] in ("svg", "math") and (tag in SECTIONS or tag in TAGS)) or stack[i][0] == "div" and tag != "body":
                    break
        if tag in VOID or attrs.endswith("/") and tag not in INLINE and tag not in ("p", "div"):
            continue
        words = ""
        if attrs.strip(" /\n\t"):
            found = {k.lower(): v.strip("\"'").lower() for k, v in ATTRIBUTE.findall(attrs)}
            words = " ".join(found[k] for k in ("class", "id", "role", "itemprop", "aria-label") if found.get(k))
        stack.append((tag, words))
    flush()
    return out


@lru_cache(maxsize=20_000)
def _path_features(path: tuple[tuple[str, str], ...]) -> tuple[int, ...]:
    found = {"bias"}
    inner = next((t for t, _ in reversed(path) if t in SECTIONS), None)
    found.add(f"in {inner}" if inner else "under body")
    found |= {f"within {t}" for t, _ in path if t in SECTIONS} | {f"tag {t}" for t, _ in path if t in TAGS}
    near = None
    for _, words in path:
        if hits := {k for k, v in GROUP.items() if words and v.search(words)}:
            found |= {f"group {k}" for k in hits}
            near = hits
    found |= {f"near {k}" for k in near} if near else {"plain"}
    return tuple(sorted(AT[f] for f in found))


def page_features(found: list[Block]) -> np.ndarray:
    x = np.zeros((len(found), len(NAMES)), np.float64)
    for i, (text, path, linked) in enumerate(found):
        x[i, list(_path_features(path))] = 1
        n, words = len(text), text.count(" ") + 1
        share = linked / n
        for name, yes in (("chars<25", n < 25), ("chars<60", 25 <= n < 60), ("chars<150", 60 <= n < 150), ("chars>=150", n >= 150), ("words<4", words < 4), ("words>=20", words >= 20), ("links none", share == 0), ("links some", 0 < share <= 0.5), ("links most", share > 0.5), ("ends sentence", text[-1] in ".!?…\"”"), ("commas", "," in text), ("digits", any(map(str.isdigit, text[:40]))), ("stock", n < 400 and bool(STOCK.search(text))), ("first", i == 0), ("last", i == len(found) - 1)):
            x[i, AT[name]] = yes
    return x


def train(pages: list[tuple[np.ndarray, np.ndarray]], steps: int = STEPS, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """(weights for state 1 over features, 2x2 transition scores) that maximise the conditional log-likelihood, by Adam."""
    pages = [p for p in pages if len(p[1])]
    longest, many = max(len(y) for _, y in pages), len(pages)
    x, y, on = np.zeros((many, longest, len(NAMES))), np.zeros((many, longest), int), np.zeros((many, longest), bool)
    for i, (a, b) in enumerate(pages):
        x[i, : len(b)], y[i, : len(b)], on[i, : len(b)] = a, b, True
    w = np.zeros(len(NAMES) + 4)
    m, v = np.zeros_like(w), np.zeros_like(w)
    follow = on[:, 1:]
    gold = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & follow).sum() for b in (0, 1)] for a in (0, 1)], float)
    for t in range(1, steps + 1):
        score, move = x @ w[:-4], w[-4:].reshape(2, 2)
        emit = np.stack([np.zeros_like(score), score], axis=-1)
        fore, back = np.zeros((longest, many, 2)), np.zeros((longest, many, 2))
        fore[0] = emit[:, 0]
        for s in range(1, longest):
            step = np.logaddexp.reduce(fore[s - 1][:, :, None] + move, axis=1) + emit[:, s]
            fore[s] = np.where(on[:, s, None], step, fore[s - 1])
        total = np.logaddexp.reduce(fore[-1], axis=1)
        for s in range(longest - 2, -1, -1):
            step = np.logaddexp.reduce(move + (emit[:, s + 1] + back[s + 1])[:, None, :], axis=2)
            back[s] = np.where(on[:, s + 1, None], step, 0)
        chance = np.exp(np.clip(fore + back - total[:, None], -700, 0))[:, :, 1].T * on
        pair = fore[:-1].transpose(1, 0, 2)[:, :, :, None] + move + (emit[:, 1:] + back[1:].transpose(1, 0, 2))[:, :, None, :]
        expected = (np.exp(np.clip(pair - total[:, None, None, None], -700, 0)) * follow[:, :, None, None]).sum(axis=(0, 1))
        g = np.concatenate([np.einsum("ijk,ij->k", x, (y * on) - chance), (gold - expected).ravel()]) / many - decay * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w[:-4], w[-4:].reshape(2, 2)


def viterbi(score: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Best states given state 1's scores (state 0 scores nothing); ties to state 0."""
    n = len(score)
    best, came = np.array([0.0, score[0]]) if n else None, np.zeros((n, 2), int)
    for s in range(1, n):
        reach = best[:, None] + move
        came[s] = reach.argmax(axis=0)
        best = reach.max(axis=0) + (0.0, score[s])
    states = np.zeros(n, int)
    if n:
        states[-1] = best.argmax()
        for s in range(n - 1, 0, -1):
            states[s - 1] = came[s, states[s]]
    return states


def labelled_page(rng: np.random.Generator) -> tuple[str, list[int]]:
    """One made page and the label of each of its leaf blocks, in page order."""
    labels: list[int] = []
    pick = lambda *xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    word = lambda: "".join(pick("ka", "lo", "mi", "ren", "tas", "vo", "du", "el", "on", "st", "er", "sch", "é", "ü") for _ in range(int(rng.integers(1, 4))))

    def words(a: int, b: int, end: str = "") -> str:
        return " ".join(word() for _ in range(int(rng.integers(a, b)))).capitalize() + end

    def leaf(tag: str, text: str, label: int, attrs: str = "") -> str:
        labels.append(label)
        return f"<{tag}{attrs}>{text}" + ("" if tag in ("p", "li") and chance(0.1) else f"</{tag}>")

    def cls(*names: str) -> str:
        return f' {pick("class", "id")}="{pick(*names)}"'

    def prose() -> str:
        if chance(0.12):
            return words(1, 6, pick("", "", "!", "###"))
        return " ".join(words(4, 18, pick(".", ".", "!", "?", "")) for _ in range(int(rng.integers(1, 7))))

    def links(n: int) -> str:
        return "<ul>" + "".join(leaf("li", f'<a href="/{word()}">{words(1, 4)}</a>', 0) for _ in range(n)) + "</ul>"

    def junk(kind: str) -> str:
        if kind == "nav":
            return pick("<nav>{}</nav>", f"<div{cls('nav', 'main-menu', 'menu', 'breadcrumbs')}>{{}}</div>", '<nav class="top">{}</nav>', "<header><nav>{}</nav></header>").format(links(int(rng.integers(1, 8))))
        if kind == "ad":
            box = pick(f"<div{cls('ad', 'ads', 'advert', 'ad-slot', 'sponsored', 'banner', 'promo')}>", "<aside class='ad'>", "<section class='advertisement'>")
            inner = leaf("p", prose(), 0) if chance(0.3) else pick("", "<span>") + (labels.append(0) or prose()) + ""
            return box + inner + {"<d": "</div>", "<a": "</aside>", "<s": "</section>"}[box[:2]]
        if kind == "header":
            return pick("<header>{}</header>", f"<div{cls('header', 'masthead', 'topbar', 'site-header')}>{{}}</div>").format(leaf(pick("h1", "div", "p"), words(1, 5), 0) + (leaf("p", words(3, 9), 0) if chance(0.5) else ""))
        if kind == "footer":
            return pick("<footer>{}</footer>", f"<div{cls('footer', 'site-footer', 'legal', 'copyright')}>{{}}</div>").format((links(3) if chance(0.3) else "") + leaf(pick("p", "div", "span"), pick("&copy; ", "Copyright 2024 ", "") + words(1, 9) + pick("", " &middot; " + prose(), ". All rights reserved."), 0) if chance(0.6) else (labels.append(0) or "&copy; " + word() + " &middot; " + prose()))
        if kind == "side":
            inner = leaf("h3", words(1, 4), 0) + (links(4) if chance(0.6) else leaf("p", prose(), 0))
            return pick("<aside>{}</aside>", f"<div{cls('sidebar', 'related', 'widget', 'side-rail', 'recommended')}>{{}}</div>", "<aside class='sidebar'>{}</aside>").format(inner)
        if kind == "notice":
            return f"<{(t := pick('div', 'section', 'dialog'))}{cls('cookie-banner', 'cookie-notice', 'consent', 'newsletter', 'popup', 'notice', 'gdpr', 'subscribe', 'alert')}>" + leaf("p", pick("We use cookies. ", "Subscribe to our newsletter. ", "") + prose(), 0) + (leaf("button", words(1, 3), 0) if chance(0.5) else "") + f"</{t}>"
        if kind == "form":
            return f"<form{pick('', cls('search', 'contact-form', 'login'))}>" + leaf("label", words(1, 4), 0) + "<input name='q'>" + leaf("button", words(1, 2), 0) + (leaf("p", prose(), 0) if chance(0.3) else "") + "</form>"
        many = int(rng.integers(1, 6))
        body = leaf("h3", pick("Comments", words(1, 3)), 0) + "".join(pick("<div class='comment'>{}</div>", "<article class='comment'>{}</article>", "<li>{}</li>", "<div>{}</div>").format(leaf("p", prose(), 0)) for _ in range(many))
        return pick("<section{}>{}</section>", "<div{}>{}</div>", "<aside{}>{}</aside>").format(cls("comments", "comment-list", "discussion", "replies", "disqus"), body)

    out = ["<!DOCTYPE html><html><head><title>", words(2, 8), "</title><style>p{margin:0}</style><script>var t='</p>';</script></head><body>"]
    before = [k for k in ("header", "nav", "notice", "ad", "form", "side") if chance(0.35)]
    for kind in rng.permutation(before) if before else []:
        out.append(junk(str(kind)))
    holder = pick("article", "article", "article", "main", "div", "section")
    attrs = cls("content", "post", "entry-content", "article-body", "main", "story") if holder in ("div", "section") else pick("", "", cls("post", "content"))
    wrap = pick("", "", "<main>", "<div class='container'>", "<div>")
    out.append(f"{wrap}<{holder}{attrs}>")
    out.append(leaf(pick("h1", "h1", "h2"), words(2, 12), 1) if chance(0.9) else "")
    if chance(0.15):
        out.append(leaf("p", words(2, 5), 0, cls("byline", "meta", "post-meta")))
    for _ in range(int(rng.integers(1, 12))):
        r = rng.random()
        if r < 0.72:
            inner = prose()
            out.append(leaf("p", f"<b>{inner}" if chance(0.2) else inner + (f' <a href="#">{word()}</a>' if chance(0.15) else ""), 1))
        elif r < 0.8:
            out.append(leaf(pick("h2", "h3", "h4"), words(1, 7), 1))
        elif r < 0.86:
            out.append(pick("<ul>{}</ul>", "<ol>{}</ol>").format("".join(leaf("li", words(2, 14), 1) for _ in range(int(rng.integers(1, 5))))))
        elif r < 0.9:
            out.append(leaf(pick("blockquote", "pre", "td"), prose(), 1))
        else:
            out.append(junk(pick("ad", "ad", "side", "notice", "form")))
    if chance(0.12):
        out.append(junk("comment"))
    out.append(f"</{holder}>" if chance(0.95) else "")
    after = [k for k in ("comment", "side", "ad", "form", "nav") if chance(0.3)]
    for kind in rng.permutation(after) if after else []:
        out.append(junk(str(kind)))
    out.append({"<m": "</main>", "<d": "</div>"}.get(wrap[:2], ""))
    out.append(junk("footer") if chance(0.85) else "")
    out.append("</body></html>" if chance(0.9) else "")
    return "".join(out), labels


def labelled(n: int, seed: int) -> list[tuple[str, list[int]]]:
    rng = np.random.default_rng(seed)
    made = [labelled_page(rng) for _ in range(n)]
    return [(page, y) for page, y in made if len(blocks(page)) == len(y)]


@lru_cache(maxsize=4)
def model(pages: int = PAGES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    return train([(page_features(blocks(p)), np.array(y)) for p, y in labelled(pages, seed)])


def main_text(page: str | None, weights: np.ndarray, move: np.ndarray) -> str:
    found = blocks(page)
    if not found:
        return ""
    return " ".join(b[0] for b, s in zip(found, viterbi(page_features(found) @ weights, move), strict=True) if s)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every row. Null, empty and textless pages give the empty text; null ids and urls stay
    null; repeated rows are read alike; other columns are ignored; an empty table gives no rows."""
    weights, move = model()
    plain = pages.select(F.col(f"`{page_id}`").alias("i"), F.col(f"`{url}`").alias("u"), F.col(f"`{source}`").alias("h"))
    read = map_rows(plain, "h", [("text", T.StringType())], lambda hs: [[main_text(h, weights, move) for h in hs]], ["i", "u"])
    return read.select(F.col("i").alias(page_id), F.col("u").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
