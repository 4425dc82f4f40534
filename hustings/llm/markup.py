"""Reading one page: its blocks of text, its containers and how likely each holds the article.

A page is read once, from front to back, in time that grows with its length: tags move a stack of open elements, text
gathers in the block that is open. What is no article by its tag, role, class or id is told apart here; what else is none
is left to the containers' scores and to the vote of the host (maintext.py).
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import xxhash

# Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CONTAINERS = frozenset("article body center details div main section td".split())
ARTICLES = frozenset(("article", "main"))
#: Elements whose start ends an open one of these, up to the nearest of the others.
ENDS = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr",), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",))}
#: An end tag doesn't reach beyond these.
SCOPES = frozenset(("html", "table", "td", "th", "caption", "template", "object"))
#: No article, by tag.
DROPPED = frozenset("aside audio button canvas datalist dialog footer menu nav noscript object search select svg template video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status tablist toolbar".split())
# Words of class and id names: what is no article, what is one, and what turns a name into a statement about its neighbours.
CLUTTER = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising adv aside banner breadcrumb breadcrumbs ccpa comment commentlist comments consent cookie cookies copyright disqus"
    " footer form gdpr header hidden invisible legal lightbox login masthead menu menus modal nav navbar navigation newsletter notice notices notification notifications alert alerts outbrain overlay pager pagination paging"
    " popular popup promo promos promotion promotional rail recommendations recommended related replies reply respond search share sharebar sharing sidebar sidebars signin signup skip social sponsor sponsored sponsors"
    " submenu subscribe subscription taboola toolbar topbar trending widget widgets".split()
)
ARTICLE_WORDS = frozenset("article articlebody body content entry main post story text".split())
ABOUT = frozenset("has hide no show with without".split())
HEADER_WORDS = frozenset(("header", "masthead"))

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][^\s/>]*+)((?>[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>|<[!?][^>]*+>?|</?[A-Za-z].*+|</[^>]*+>?""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
NAME_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*")
HIDDEN = re.compile(r"display\s*:\s*none", re.I)
DIGITS = re.compile(r"\d+")

#: A block counts for its container, and by so much less for each container around that.
DECAY = 0.85
#: How much likelier an article element, a container named like an article, and one with a top heading is.
BY_ELEMENT, BY_NAME, BY_HEADING = 1.5, 1.15, 1.25
#: Text outside paragraphs speaks for a container from so many characters, list items from so many.
LONG_LOOSE, LONG_ITEM = 80, 40
PARAGRAPHS = frozenset("blockquote caption dd dt figcaption p pre td th".split()) | HEADINGS


@dataclass(slots=True)
class Open:
    """An open element: its nearest block's place in the stack, its container's index, the mark it stands under; whether
    its text goes, or goes but for headings; whether it is in a heading or an article; how many links it is in."""

    tag: str
    block: int = 0
    node: int = 0
    mark: int = 0
    gone: bool = False
    headings_only: bool = False
    heading: bool = False
    in_article: bool = False
    links: int = 0


@dataclass(slots=True)
class Page:
    """blocks of text, each with its container and mark; containers by index, parents first; marks, 0 being none."""

    blocks: list[str] = field(default_factory=list)
    block_tags: list[str] = field(default_factory=list)
    block_nodes: list[int] = field(default_factory=list)
    block_marks: list[int] = field(default_factory=list)
    block_links: list[int] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [-1])
    steps: list[str] = field(default_factory=lambda: ["html"])
    factors: list[float] = field(default_factory=lambda: [1.0])
    paths: list[int] = field(default_factory=lambda: [0])
    starts: list[int] = field(default_factory=lambda: [0])
    ends: list[int] = field(default_factory=lambda: [-1])
    above: list[int] = field(default_factory=lambda: [0])
    spared: list[bool] = field(default_factory=lambda: [True])
    forms: list[bool] = field(default_factory=lambda: [False])


def words_of(name: str) -> list[str]:
    return [w.lower() for w in NAME_WORD.findall(name)]


def named_clutter(names: list[str]) -> tuple[bool, bool]:
    """Whether class and id names tell of no article, and whether they tell so of a header only."""
    found, header, article = [], False, False
    for name in names:
        words = words_of(name)
        if ABOUT & set(words):
            continue
        hits = CLUTTER & set(words)
        if hits:
            found.append(len(words))
            header |= hits <= HEADER_WORDS
        elif ARTICLE_WORDS & set(words):
            article = True
    marked = bool(found) and not (article and min(found) > 1)  # "content sidebar-left" tells of a layout
    return marked, marked and header and len(found) == 1


def hidden(raw: str, known: dict[str, str]) -> bool:
    return "display" in raw and bool(HIDDEN.search(known.get("style", ""))) or "hidden" in raw and "hidden" in re.sub(r"""=\s*(?:"[^"]*"|'[^']*'|\S+)""", " ", raw).lower().split()


def attributes(raw: str) -> dict[str, str]:
    return {name.lower(): unescape(a or b or c) for name, a, b, c in ATTRIBUTE.findall(raw)} if "=" in raw else {}


def read(html: str) -> Page:
    """The page's blocks in page order, and its containers."""
    page = Page()
    stack = [Open("html")]
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                page.blocks.append(text)
                page.block_tags.append(stack[stack[-1].block].tag)
                page.block_nodes.append(stack[-1].node)
                page.block_marks.append(stack[-1].mark)
                page.block_links.append(linked)
        linked = 0

    def close(down_to: int) -> None:
        for x in stack[down_to:]:
            if not x.gone and x.tag in CONTAINERS and page.ends[x.node] < 0:
                page.ends[x.node] = len(page.blocks)
        del stack[down_to:]

    def end(tag: str) -> None:
        block = tag in BLOCKS
        for at in range(len(stack) - 1, 0, -1):
            if stack[at].tag == tag:
                if block:
                    flush()
                return close(at)
            if stack[at].tag in SCOPES and tag not in ("table", "body", "html", "tr", "tbody", "thead", "tfoot") or not block and stack[at].tag in BLOCKS:
                break
        if tag == "p":
            flush()  # an end without a start is an empty paragraph
        return None

    def implied(tag: str) -> None:
        """Ends what the start of this block ends."""
        closing, limits = ENDS.get(tag, ((), ()))
        at = stack[-1].block
        while closing and at and stack[at].tag not in limits:
            if stack[at].tag in closing:
                return close(at)
            at = stack[at - 1].block
        if stack[stack[-1].block].tag == "p":
            close(stack[-1].block)
        return None

    def start(tag: str, raw: str) -> None:
        if tag in BLOCKS:
            flush()
            implied(tag)
        if tag in ("html", "body") and any(x.tag == tag for x in stack[1:]) or tag == "html":
            return
        if tag in VOID or tag == "svg" and raw.endswith("/"):
            if tag == "br":
                pieces.append(" ")
            return
        up = stack[-1]
        block = len(stack) if tag in BLOCKS else up.block
        if up.gone:
            stack.append(Open(tag, block, up.node, up.mark, True))
            return
        known = attributes(raw)
        here = Open(tag, block, up.node, up.mark, up.gone, up.headings_only, up.heading or tag in HEADINGS, up.in_article, up.links + (tag == "a"))
        classes = known.get("class", "").split()
        names = [*classes, known["id"]] if "id" in known else classes
        clutter, header = named_clutter(names) if names and tag not in ("body", "main") else (False, False)
        clutter = clutter or "role" in known and known["role"].lower() in ROLES
        if tag in HEADINGS:
            clutter, header = clutter and not header and tag != "h1", False
        article = tag in ARTICLES and not clutter
        if tag in DROPPED or raw and hidden(raw, known) or clutter and tag not in BLOCKS:
            here.gone = True
        elif (tag == "header" or header) and up.in_article:
            here.headings_only = True
        elif tag == "header":
            here.gone = True
        elif clutter or tag == "form":
            here.mark = marked(up.mark, not clutter)
        if article or tag == "h1" and here.mark:
            spare(here.mark, article)
        here.in_article |= article
        if tag in CONTAINERS and not here.gone:
            step = f"{tag}.{DIGITS.sub('N', classes[0])}" if classes and tag != "body" else tag
            page.parents.append(up.node)
            page.steps.append(step)
            named = bool(ARTICLE_WORDS & {w for name in classes for w in words_of(name)}) or "articlebody" in known.get("itemprop", "").lower()
            page.factors.append(BY_ELEMENT if article or known.get("role") == "main" else BY_NAME if named else 1.0)
            page.paths.append(xxhash.xxh64_intdigest(step.encode("utf-8", "surrogatepass"), seed=page.paths[up.node] & (1 << 64) - 1) - (1 << 63))
            page.starts.append(len(page.blocks))
            page.ends.append(-1)
            here.node = len(page.parents) - 1
        stack.append(here)

    def marked(above: int, form: bool = False) -> int:
        page.above.append(above)
        page.spared.append(False)
        page.forms.append(form)
        return len(page.above) - 1

    def spare(mark: int, article: bool) -> None:
        """An article in what looked like none: it wasn't. A top heading tells so of forms only, which some pages stand in whole."""
        while mark:
            page.spared[mark] |= article or page.forms[mark]
            mark = page.above[mark]

    def say(text: str) -> None:
        nonlocal linked
        up = stack[-1]
        if up.gone or up.headings_only and not up.heading:
            return
        text = unescape(text) if "&" in text else text
        pieces.append(text)
        if up.links:
            linked += len(text)

    at, size = 0, len(html)
    while at < size:
        found = TOKEN.search(html, at)
        if found is None:
            say(html[at:])
            break
        if found.start() > at:
            say(html[at : found.start()])
        at = found.end()
        name = found[2]
        if name is None:
            continue
        tag = name.lower()
        if found[1]:
            end(tag)
        elif tag in RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = stop.end() if stop else size
        else:
            start(tag, found[3])
    flush()
    close(0)
    page.ends = [e if e >= 0 else len(page.blocks) for e in page.ends]
    return page


def kept(page: Page) -> list[bool]:
    """Which blocks stand under no mark, but for marks that hold an article."""
    bare = [True] * len(page.above)
    for m in range(1, len(bare)):
        bare[m] = page.spared[m] and bare[page.above[m]]
    return [bare[m] for m in page.block_marks]


def weight(text: str, tag: str, links: int) -> int:
    """How many characters speak for the block's being of an article, or against it."""
    if 2 * links > len(text):
        return -len(text)
    if tag in PARAGRAPHS or len(text) >= (LONG_ITEM if tag == "li" else LONG_LOOSE):
        return len(text)
    return 0 if tag == "li" else -len(text)


def path_scores(page: Page, stays: list[bool]) -> dict[int, float]:
    """The score of every container path of the page that holds text, over all containers of that path."""
    score, has, heading = [0.0] * len(page.parents), [False] * len(page.parents), [False] * len(page.parents)
    for text, tag, node, links, stay in zip(page.blocks, page.block_tags, page.block_nodes, page.block_links, stays, strict=True):
        if stay:
            score[node] += weight(text, tag, links)
            has[node] = True
            heading[node] |= tag == "h1"
    paths: dict[int, float] = {}
    for node in range(len(page.parents) - 1, -1, -1):
        if has[node]:
            up = page.parents[node]
            if up >= 0:
                score[up] += DECAY * score[node]
                has[up] = True
                heading[up] |= heading[node]
            factor = page.factors[node] * (BY_HEADING if heading[node] else 1) if score[node] > 0 else 1
            paths[page.paths[node]] = paths.get(page.paths[node], 0.0) + score[node] * factor
    return paths


def best_container(page: Page, scores: dict[int, float]) -> int | None:
    """The first container of the path with the highest score, of these the deepest path, of these the first; None without text."""
    best, at = None, None
    depth = [0] * len(page.parents)
    for node, up in enumerate(page.parents):
        depth[node] = depth[up] + 1 if up >= 0 else 0
        path = page.paths[node]
        if path in scores and (best is None or (scores[path], depth[node]) > best):
            best, at = (scores[path], depth[node]), node
    return at


def readable(page: Page, node: int) -> str:
    steps = []
    while node >= 0:
        steps.append(page.steps[node])
        node = page.parents[node]
    return ">".join(reversed(steps))


def depth_of(page: Page, node: int) -> int:
    count = 0
    while page.parents[node] >= 0:
        node, count = page.parents[node], count + 1
    return count
