"""HTML main text by consensus host paths.

First pass: each page's containers are scored by the text of their blocks against its share in links, and the page votes for its best
generalised tag-class paths (digits in class names become #), each widened to the widest element around it that adds main text only. Votes are summed by host and path in Spark, with map-side sums, so a hot host is a few
rows. Second pass: each page is extracted again at its host's winning path; a page where that holds less than half the main
text of its own best container uses its own.

The winners are one short row for each host; they go to the tasks by broadcast up to a checked number of hosts and by a shuffled
join, which AQE splits for hot hosts, beyond it.

Left out: menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, markup and reader comments, told by tag, role
and class or id words; an element told by words only stays if it holds an article or most of the page's text outside links, but for adverts,
notices and comments. A block's white space becomes single spaces; blocks are joined by an empty line.

Defined results: null, empty or text-free html gives an empty text; a null url is a host of its own; repeated pages vote each for
itself; ties between a page's paths go to the one met first, between a host's to the higher score, then the first path; tags that match nothing are
left out; an empty table gives an empty result; columns besides
page_id, url and html are not read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import in_batches, materialize, small, table

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
#: The same, with quoted values that end before the next tag. It takes over once a quote is found that nothing closes: looking for its end from each tag
#: would make the work grow with the square of the page.
STRICT = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^<>"']++|"[^"<]*+"|'[^'<]*+')*+)>|<[!?/][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Elements that hold raw text up to their end tag, or to the end of the page.
RAW = {"script", "style", "iframe", "textarea", "title", "noframes", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"nav", "header", "footer", "aside", "form", "button", "dialog", "menu", "head", "option", "canvas", "audio", "video", "map", "noscript", "template", "svg", "math", "select", "object", *RAW}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
CONTAINERS = {"article", "main", "section", "div", "td", "body", "html", "center", "blockquote", "table", "tbody", "tr"}
RUNNING = {"p", "pre", "blockquote", "li", "dd", "td", "figcaption"}
#: A wrapper's own paragraphs go together with the text in these within it, but not with that of other boxes.
PARTS = {"section", "article", "blockquote", "table", "tbody", "tr", "td"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "hgroup"}
#: An open element of these is closed by the start of the elements listed.
CLOSES = {"p": BLOCKS - {"html", "body"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "tr": {"tr", "tbody", "tfoot"}, "option": {"option"}}
CLOSED_BY = {start: {t for t, starts in CLOSES.items() if start in starts} for start in set().union(*CLOSES.values())}
BOUNDS = CONTAINERS | {"ul", "ol", "dl", "table"}
REPLIES = re.compile(r"comments?|commentlist|disqus|repl(?:y|ies)|respond")
NOISE = re.compile(rf"ads?|advert\w*|adsense|banner|sponsor\w*|promo\w*|nav|navbar|navigation|menu|menubar|breadcrumbs?|header|masthead|topbar|footer|sidebar|aside|widgets?|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w+|signup|login|social|share|sharing|related|recommend\w*|search|searchform|pagination|pager|skip|toolbar|{REPLIES.pattern}")
#: Never main text, however long.
FOREIGN = re.compile(rf"ads?|advert\w*|adsense|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscri\w+|signup|login|{REPLIES.pattern}")
#: Names that sections of an article may have as well: within one these stay if they hold running text with few links.
SOFT = re.compile(r"related|recommend\w*|search|social|shar(?:e|ing)|widgets?|toolbar|pager|pagination|skip")
#: Code points that make a paragraph of an article's header, or of a soft section, running text.
LEAD = 80
#: Parts of a class name that say what an element has, lacks or is at the moment; parts that only name a box around the part before.
MODIFIERS = {"has", "no", "not", "with", "without", "hide", "show"}
STATES = {"open", "opened", "closed", "enabled", "disabled", "on", "off", "active", "visible"}
FRAMES = {"wrap", "wrapper", "container", "inner", "outer", "box", "block", "area", "list", "item", "items", "content", "section", "left", "right", "top", "bottom", "row", "col", "column", "group"}
TITLED = {"post", "entry", "article", "story", "content"}
#: Elements told as furniture by class or id words only, which are judged by what they hold once the page is read.
JUDGED = CONTAINERS - {"html", "body", "blockquote"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu", "menubar", "toolbar"}


class Node:
    __slots__ = ("tag", "path", "parent", "dropped", "box", "score", "in_article", "suspect", "outer", "foreign", "soft", "lead", "amount", "chars", "links", "running", "holds", "gone")

    def __init__(self, tag: str, path: int, parent: Node | None, dropped: bool):
        self.tag, self.path, self.parent, self.dropped = tag, path, parent, dropped
        self.score = 0.0
        #: The nearest container, this or around it.
        self.box: Node = self if tag in CONTAINERS or parent is None else parent.box
        self.in_article = tag in ("article", "main") or (parent is not None and parent.in_article)
        self.suspect: Node | None = parent.suspect if parent is not None else None  # the nearest element, this or around it, to be judged
        self.lead = parent is not None and parent.lead

    def accuse(self, foreign: bool, soft: bool) -> None:
        self.outer, self.suspect, self.foreign, self.soft = self.suspect, self, foreign, soft
        self.amount = self.chars = self.links = self.running = 0
        self.holds = self.gone = False


def attributes(s: str) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(s)} if s.strip() else {}


def named(attrs: dict[str, str], words: re.Pattern, titled: bool = False) -> bool:
    """Whether a class or id names one of the words: as its first or last part, boxes and numbers at its end aside. titled: within an article."""
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        parts = [x for x in re.split("[-_]+", name) if x and not x.isdigit()]
        if not parts or parts[-1] in STATES or not MODIFIERS.isdisjoint(parts):
            continue
        while len(parts) > 1 and parts[-1] in FRAMES:
            parts.pop()
        if parts[-1] == "header" and (titled or parts[0] in TITLED):
            continue
        if words.fullmatch(parts[0]) or words.fullmatch(parts[-1]):
            return True
    return False


def hidden(tag: str, attrs: dict[str, str], parent: Node) -> bool:
    """Left out whatever it holds."""
    if tag == "header" and parent.in_article:
        return False  # an article's own title
    if tag in DROPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in ROLES:
        return True
    return bool(re.search(r"display\s*:\s*none", attrs.get("style", "")))


def noisy(tag: str, attrs: dict[str, str], parent: Node) -> bool:
    """Furniture by class or id words."""
    if tag in ("html", "body") or (tag == "header" and parent.in_article) or not ("class" in attrs or "id" in attrs):
        return False
    return named(attrs, REPLIES if tag in ("article", "main") or tag in HEADINGS else NOISE, parent.in_article)


class Page:
    """Blocks of a page in order, each with the container that holds it; containers with scores.

    A path is a number: `up` names the path around it, `segment` its own last part. Work and memory are in proportion to the page, whatever its nesting and
    its unmatched tags: open elements are found by their tag, and what is said of an element follows from the one around it."""

    def __init__(self, source: str | None):
        self.blocks: list[tuple[str, Node]] = []
        self.content: list[bool] = []  # of each block: a heading, or running text
        self.read: list[tuple[str, Node, float, int, Node | None, bool, bool]] = []  # text, container, value, characters in links, suspect, content, heading
        self.articles: list[Node] = []
        self.suspects: list[Node] = []
        self.containers: dict[int, Node] = {}
        self.up, self.segment, self.tag_of, self.number = [-1], [""], [""], {}
        self.top = Node("", 0, None, False)
        self.open = [self.top]
        self.spots: dict[str, list[int]] = {}  # places in open, by tag
        self.block_spots: list[int] = []
        self.bound_spots: list[int] = []
        self.parts: list[str] = []
        self.links = self.depth_a = 0
        if source:
            self.parse(source)
            self.settle()

    def path(self, parent: int, segment: str, tag: str) -> int:
        if (p := self.number.get((parent, segment))) is None:
            p = self.number[parent, segment] = len(self.up)
            self.up.append(parent)
            self.segment.append(segment)
            self.tag_of.append(tag)
        return p

    def spelled(self, path: int) -> str:
        out = []
        while path > 0:
            out.append(self.segment[path])
            path = self.up[path]
        return "".join(f"/{x}" for x in reversed(out))

    def numbered(self, path: str) -> int | None:
        """The number of a path that is spelled out; None if the page has no such element."""
        at = 0
        for segment in path.split("/")[1:]:
            if (at := self.number.get((at, segment))) is None:
                return None
        return at

    def push(self, node: Node) -> None:
        i = len(self.open)
        self.open.append(node)
        self.spots.setdefault(node.tag, []).append(i)
        if node.tag in BLOCKS:
            self.block_spots.append(i)
        if node.tag in BOUNDS:
            self.bound_spots.append(i)
        if node.tag == "a" and not node.dropped:
            self.depth_a += 1

    def pop(self) -> None:
        node, i = self.open.pop(), len(self.open) - 1
        self.spots[node.tag].pop()
        if node.tag in BLOCKS:
            self.block_spots.pop()
        if node.tag in BOUNDS:
            self.bound_spots.pop()
        if node.tag == "a" and not node.dropped:
            self.depth_a -= 1

    def close(self, i: int) -> None:
        self.flush()
        while len(self.open) > i:
            self.pop()

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        self.parts.clear()
        links, self.links = self.links, 0
        if not text:
            return
        top = self.open[-1]
        if top.lead and (len(text) < LEAD or 3 * links > len(text)):
            return
        near = [n.tag for n in self.open[-4:]]
        heading = any(t in HEADINGS for t in near[-3:])
        value = 0.0 if heading else max(0, len(text) - 2 * links) * (1.0 if any(t in ("p", "pre", "blockquote") for t in near) else 0.6)
        running = len(text) >= 60 or any(t in RUNNING for t in near)
        self.read.append((text, top.box, value, links, top.suspect, 2 * links <= len(text) and (heading or running), heading))

    def settle(self) -> None:
        """Drops the suspects, but for those that hold an article or most of the page's text outside links, and soft ones that are running text; scores the
        blocks that stay. What suspects hold is summed from the last to the first, what is around them counts from the first to the last."""
        for n in self.suspects:
            n.foreign = n.foreign or (n.outer is not None and n.outer.foreign)
        total = 0
        for text, _, _, links, suspect, _, heading in self.read:
            if suspect is not None and suspect.foreign:
                continue
            size = max(0, len(text) - links)
            total += size
            if suspect is not None:
                suspect.amount += size
                suspect.chars += len(text)
                suspect.links += links
                suspect.running += 0 if heading or len(text) < LEAD else len(text)
        for a in self.articles:
            if a.suspect is not None and not a.suspect.foreign:
                a.suspect.holds = True
        for n in reversed(self.suspects):
            if n.outer is not None:
                n.outer.holds = n.outer.holds or n.holds
                for k in ("amount", "chars", "links", "running"):
                    setattr(n.outer, k, getattr(n.outer, k) + getattr(n, k))
        for n in self.suspects:
            text = n.soft and n.in_article and n.running > 0 and 3 * n.links <= n.chars
            n.gone = n.foreign or not (n.holds or 2 * n.amount > total or text) or (n.outer is not None and n.outer.gone)
        for text, at, value, _, suspect, main, _ in self.read:
            if suspect is not None and suspect.gone:
                continue
            self.blocks.append((text, at))
            self.content.append(main)
            node, share = at, 1.0
            # A block counts in full for its container, half for the next one up, and so on.
            while node is not None and share > 0.1:
                node.score += value * share
                self.containers[id(node)] = node
                node, share = (node.parent.box if node.parent is not None else None), share / 2

    def text(self, s: str) -> None:
        if s and not self.open[-1].dropped:
            s = entities.unescape(s)
            self.parts.append(s)
            if self.depth_a > 0:
                self.links += len(s.strip())

    def parse(self, source: str) -> None:
        pos, stop, token, endless = 0, source.rfind(">") + 1, TOKEN, set()
        while (m := token.search(source, pos, stop)) is not None:
            self.text(source[pos : m.start()])
            pos = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                if pos == stop and m[0].startswith("<!--") and not m[0].endswith("-->"):
                    pos = len(source)  # a comment that nothing closes
                continue
            if m[5]:
                token = STRICT
            if m[1] or m[4]:
                self.end(tag)
                continue
            if tag in RAW:
                if not (m[3] or m[6] or "").endswith("/"):
                    end = None if tag in endless else re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, pos)
                    if end is None:
                        endless.add(tag)
                    pos = end.end() if end else len(source)
                continue
            self.start(tag, m[3] if m[2] else m[6])
        rest = source[pos:]
        self.text(rest[: i] if (i := rest.find("<!--")) >= 0 else rest)
        self.close(1)

    def start(self, tag: str, rest: str) -> None:
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif not self.open[-1].dropped:
                self.parts.append(" ")
            return
        i = max((self.spots[t][-1] for t in CLOSED_BY.get(tag, ()) if self.spots.get(t)), default=0)
        if i and i >= (self.bound_spots[-1] if self.bound_spots else 0):
            self.close(i)
        if tag in BLOCKS:
            self.flush()
        parent = self.open[-1]
        attrs = attributes(rest)
        path = parent.path
        if tag in BLOCKS:
            path = self.path(path, ".".join([tag, *sorted(re.sub(r"\d+", "#", c).replace("/", "_") for c in attrs.get("class", "").split())]), tag)
        noise = not parent.dropped and noisy(tag, attrs, parent)
        dropped = parent.dropped or hidden(tag, attrs, parent) or (noise and tag not in JUDGED)
        if parent.tag == "header" and parent.in_article and tag not in HEADINGS and tag != "p":
            dropped = True
        node = Node(tag, path, parent, dropped)
        node.lead = node.lead or (tag == "p" and parent.tag == "header")
        if noise and not dropped:
            node.accuse(named(attrs, FOREIGN), named(attrs, SOFT))
            self.suspects.append(node)
        if tag in ("article", "main") and not dropped and node.suspect is not node:
            self.articles.append(node)
        self.push(node)
        if rest.endswith("/") and tag not in BLOCKS:
            self.pop()

    def end(self, tag: str) -> None:
        last = lambda t: (self.spots.get(t) or [0])[-1]
        i = last(tag)
        if not i or (tag not in ("body", "html") and max(last("body"), last("html")) > i):
            return
        block = self.block_spots[-1] if self.block_spots else 0
        # An inline end tag does not close blocks that were opened within it.
        if tag in BLOCKS or tag in DROPPED or block <= i:
            if tag in BLOCKS or block >= i:
                self.close(i)
            else:
                while len(self.open) > i:
                    self.pop()

    def best(self) -> list[tuple[int, float]]:
        """Paths with scores, the best first, of equal ones that which was met first; an article or main element counts half as much again."""
        total: dict[int, float] = {}
        for n in self.containers.values():
            if n.parent is not None:
                total[n.path] = total.get(n.path, 0.0) + n.score * (1.5 if n.tag in ("article", "main") else 1.0)
        return sorted(total.items(), key=lambda x: -x[1])

    def ranked(self, top: int = 3) -> list[tuple[str, float]]:
        """The best paths, each widened, spelled out, without repeats."""
        out: dict[int, float] = {}
        for path, score in self.best()[:top]:
            out.setdefault(self.widened(path), score)
        return [(self.spelled(p), s) for p, s in out.items()]

    def levels(self, chain: list[int]) -> list[tuple[int, bool, bool]]:
        """For each block: the place in chain of the nearest path that holds it (-1: none), whether it is that element's own, and whether a container that is no
        part of a text lies between."""
        place = {p: j for j, p in enumerate(chain)}
        known: dict[int, tuple[int, bool]] = {p: (j, False) for p, j in place.items()}
        known.setdefault(0, (-1, False))
        out = []
        for _, at in self.blocks:
            p, way = at.path, []
            while p not in known:
                way.append(p)
                p = self.up[p]
            j, box = known[p]
            for q in reversed(way):
                box = box or (self.tag_of[q] in CONTAINERS and self.tag_of[q] not in PARTS)
                known[q] = (j, box)
            out.append((known[at.path][0], at.path in place, known[at.path][1]))
        return out

    def within(self, path: int) -> list[bool]:
        return [j == 0 for j, _, _ in self.levels([path])]

    def widened(self, path: int) -> int:
        """The path, or the widest around it that adds main text only: for an article or main element, more of it than of other text, or hardly any other; else
        content blocks alone, some of which are the element's own and the others in parts of it such as sections."""
        chain, outer = [path], self.up[path]
        if self.tag_of[path] in ("body", "html"):
            return path
        while outer > 0 and self.tag_of[outer] not in ("body", "html"):
            chain.append(outer)
            outer = self.up[outer]
        n = len(chain)
        extra, other, own, boxed = [0] * n, [0] * n, [False] * n, [False] * n
        size = 0
        for (text, _), main, (j, direct, box) in zip(self.blocks, self.content, self.levels(chain), strict=True):
            if j == 0:
                size += len(text)
            elif j > 0 and main:
                extra[j] += len(text)
                own[j] = own[j] or direct
                boxed[j] = boxed[j] or box
            elif j > 0:
                other[j] += len(text)
        more = less = 0
        apart = False
        for j in range(1, n):
            inner = self.tag_of[chain[j - 1]]
            apart = apart or (more > 0 and inner in CONTAINERS and inner not in PARTS) or boxed[j]
            more, less = more + extra[j], less + other[j]
            tag = self.tag_of[chain[j]]
            if tag in CONTAINERS and more > 0 and ((more > less or 10 * less <= size + more) if tag in ("article", "main") else not apart and own[j] and less == 0):
                path = chain[j]
        return path

    def at(self, path: int | str | None) -> str:
        """Text of all blocks within elements of this path, a number or spelled out."""
        if path is None:
            return "\n\n".join(t for t, _ in self.blocks)
        if isinstance(path, str) and (path := self.numbered(path)) is None:
            return ""
        return "\n\n".join(t for (t, _), in_ in zip(self.blocks, self.within(path), strict=True) if in_)

    def main(self, path: str | None) -> str:
        """Text at the host's path, or at the page's own best one if the host's holds less than half as much main text, or none."""
        found = self.best()
        if not found:
            return self.at(None)
        own = self.widened(found[0][0])
        host = self.numbered(path) if path is not None else None
        if host is None or host == own:
            return self.at(own)
        amount = lambda p: sum(len(t) for (t, _), main, in_ in zip(self.blocks, self.content, self.within(p), strict=True) if main and in_)
        text = self.at(host)
        return self.at(own) if not text or 2 * amount(host) < amount(own) else text


def host(url) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def votes(pages: DataFrame, top: int = 3) -> DataFrame:
    """host, path, votes, score: each page gives 1, 1/2, 1/3 to its best paths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[tuple[str, str], list[float]] = {}
            for h, t in zip(b.column("host").to_pylist(), b.column("html"), strict=True):
                for k, (path, s) in enumerate(Page(t.as_py()).ranked(top)):
                    v = rows.setdefault((h, path), [0.0, 0.0])
                    v[0] += 1 / (k + 1)
                    v[1] += s
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.string()), *(pa.array([v[i] for v in rows.values()], pa.float64()) for i in (0, 1))], names=["host", "path", "votes", "score"])

    cast = in_batches(pages.select(host(F.col("url")).alias("host"), "html"), run, "host string, path string, votes double, score double")
    return cast.groupBy("host", "path").agg(F.round(F.sum("votes"), 6).alias("votes"), F.round(F.sum("score"), 3).alias("score"))


def winners(pages: DataFrame) -> DataFrame:
    """host, path."""
    order = F.struct((-F.col("votes")).alias("v"), (-F.col("score")).alias("s"), F.col("path"))
    return votes(pages).groupBy("host").agg(F.min(order)["path"].alias("path"))


def extract(pages: DataFrame, host_rows: int = 200_000) -> DataFrame:
    """page_id, url, text."""
    won = small(materialize(winners(pages), "winners"), host_rows)
    rows = pages.select("page_id", "url", "html", host(F.col("url")).alias("host")).join(won, "host", "left").select("page_id", "url", "html", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, path in zip(b.column("html"), b.column("path").to_pylist(), strict=True):
                out.append(Page(t.as_py()).main(path))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    id_type = rows.schema["page_id"].dataType.simpleString()
    return in_batches(rows, run, f"page_id {id_type}, url string, text string")


def op5_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
