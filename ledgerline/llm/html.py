"""Main-text extraction from web pages by consensus paths per host.

Each page is read into containers (body, div, article, ...) without the parts
that are never article text. Every container is scored by its own text: plain
and linked characters, whether it belongs to an article or holds the first-rank
heading, and the text itself. Its path of tags and classes, digits taken out,
carries the score as a vote. Spark adds the votes per host and path over
distinct pages: a path loses if the host's pages repeat its text or if it is
nearly all links, and is no article; every other path wins. Then each page is
extracted again from the containers of winning paths. Paths that the host has
not voted on (too few pages) follow the page's own candidate, the deepest
container that holds all of its plain text.
"""

from __future__ import annotations

import re
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerline.llm.common import bound_batches, store

#: A path is voted on from so many distinct pages of its host, and from this share of them (which bounds the list).
LEAST_PAGES = 5
SHARE = 0.01
#: A path loses if each of its texts stands on so many distinct pages on average, or with this share of linked text.
REPEATS = 5
LINKED = 0.8

# HTML element groups and the class, id and role words of parts that are not article text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp svg".split())
CONTAINERS = set("body div article section main td".split())
MARKS = set("article main h1".split())
BLOCKS = CONTAINERS | set(
    "html head p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr th caption blockquote pre address "
    "figure figcaption header footer nav aside form fieldset hr details summary center menu dialog hgroup".split())
DROPPED = RAW | set("head nav header footer aside form button select option menu dialog label object audio video "
                    "canvas input".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"},
          "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
JUNK = set(
    "nav navbar navigation menu menubar sidebar side aside footer foot header masthead banner ad ads adv advert "
    "adverts advertisement advertising adsense promo promotion sponsor sponsored cookie cookies consent gdpr notice "
    "notices notification popup modal overlay newsletter subscribe subscription signup share sharing social related "
    "recommended breadcrumb breadcrumbs comment comments commentlist respond reply replies discussion disqus form "
    "login search widget widgets pagination pager toolbar alert disclaimer contentinfo complementary".split())
# Words that beside those of JUNK only say where or how the element is laid out.
LAYOUT = set(
    "list area box bar block wrapper wrap container inner outer section item items link links button buttons btn top "
    "bottom left right main site page global primary secondary content text title unit slot space zone row col column "
    "panel group icon icons info user reader posts sticky fixed mobile desktop small large wide full".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
OWN = set("article post entry story content text title headline".split())
# A class word that begins so tells the layout, not what the element is.
FLAGS = set("has have no not with without".split())
#: Stands for the whole page among the voted paths.
_ALL = "page"
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")


class Page:
    """Containers of a page and its text pieces.

    nodes: (parent container, digest of the path, dropped); pieces: (container, block, text, in a link of a list or
    menu). Links in an article or a first-rank heading are text. marked: containers of an article or with that heading.
    An element with a word of JUNK is dropped once the page is read, and only if it is not the article (``_keeps``).
    """

    def __init__(self, html: str):
        self.nodes = [(-1, "", False)]
        self.pieces: list[tuple[int, int, str, bool]] = []
        self.marked: set[int] = set()
        stack = [("", 0, False, 0, None)]      # (tag, container, dropped, suspect, range of pieces)
        opened: dict[str, list[int]] = {}      # depths of the open elements of a tag
        walls, bounds = [], []                 # depths of open containers, and of those and open lists
        suspects, marks = [(0, [0, 0], "")], []  # (suspect around it, range, kind), (tag, suspect, range); 0 is none
        held = [0]                             # suspect of each container
        owner = []                             # (suspect, in a link, in a heading) of each piece
        block, at = 0, 0
        size = len(html)
        low = None

        def inside(tag: str) -> bool:
            return bool(opened.get(tag))

        def add(piece: str) -> None:
            node, link = stack[-1][1], inside("a")
            first, article = inside("h1"), inside("article")
            if (first or article) and piece.strip():
                self.marked.add(node)
            self.pieces.append((node, block, piece, link and not first and not article))
            owner.append((stack[-1][3], link, first or any(opened.get(h) for h in HEADINGS)))

        def text(end: int) -> None:
            if end > at and not stack[-1][2]:
                add(html[at:end])

        def close(depth: int) -> None:
            while len(stack) > depth:
                tag, *_, span = stack.pop()
                opened[tag].pop()
                for deep in (walls, bounds):
                    if deep and deep[-1] == len(stack):
                        deep.pop()
                if span:
                    span[1] = len(self.pieces)

        for m in _TAG.finditer(html):
            if m.start() < at:
                continue
            text(m.start())
            at = m.end()
            tag = (m.group(2) or m.group(5) or "").lower()
            if not tag:
                continue
            if m.group(1) or m.group(4):       # an end tag
                if tag in BLOCKS:
                    block += 1
                if inside(tag) and (tag in BLOCKS or not walls or walls[-1] < opened[tag][-1]):
                    close(opened[tag][-1])
                continue
            if tag == "br":
                if not stack[-1][2]:
                    add(" ")
                continue
            if tag in BLOCKS:
                block += 1
                shut = CLOSES.get(tag, set()) | ({"p"} if tag != "p" else set())
                depth = max((opened[t][-1] for t in shut if inside(t)), default=0)
                if depth and (not bounds or depth >= bounds[-1]):
                    close(depth)
            if tag in VOID:
                continue
            if tag in RAW:
                low = low or html.lower()
                end = low.find(f"</{tag}", at)
                at = size if end < 0 else (low.find(">", end) + 1 or size)
                continue
            given = m.group(3) or m.group(6) or ""
            attributes = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(given)} if given.strip() else {}
            own = tag not in ("html", "body")
            title = tag == "header" and inside("article")
            gone = stack[-1][2] or tag in DROPPED and not title or own and _hidden(attributes)
            node, suspect, span = stack[-1][1], stack[-1][3], None
            if not gone and own and (tag in MARKS or title or attributes):
                junk = "title" if title else _junk(attributes)
                if junk or tag in MARKS:
                    span = [len(self.pieces), -1]
                if junk:
                    suspects.append((suspect, span, junk))
                    suspect = len(suspects) - 1
                if tag in MARKS:
                    marks.append((tag, suspect, span))
            if tag in CONTAINERS:
                label = ".".join([tag, *sorted(re.sub(r"\d+", "", attributes.get("class", "")).split())])
                path = blake2b(f"{self.nodes[node][1]}/{label}".encode(errors="replace"), digest_size=8).hexdigest()
                self.nodes.append((node, path, gone))
                held.append(suspect)
                node = len(self.nodes) - 1
                walls.append(len(stack))
            if tag in CONTAINERS or tag in ("ul", "ol", "table", "dl"):
                bounds.append(len(stack))
            opened.setdefault(tag, []).append(len(stack))
            stack.append((tag, node, gone, suspect, span))
        text(size)
        close(1)
        if len(suspects) > 1:
            lengths = [len(piece.strip()) for _, _, piece, _ in self.pieces]
            keeps = _keeps([0 if linked else n for n, (*_, linked) in zip(lengths, self.pieces)], lengths, owner,
                           suspects, marks)
            lost = [False]
            for number, (around, *_) in enumerate(suspects[1:], 1):
                lost.append(lost[around] or not keeps[number])
            self.nodes = [(a, path, gone or lost[held[i]]) for i, (a, path, gone) in enumerate(self.nodes)]
            self.pieces = [piece for piece, (number, *_) in zip(self.pieces, owner) if not lost[number]]

    def plain(self) -> list[int]:
        """Characters of text outside links per container, those inside it included."""
        size = [0] * len(self.nodes)
        for node, _, text, linked in self.pieces:
            if not linked:
                size[node] += len(text.strip())
        for node in range(len(self.nodes) - 1, 0, -1):
            size[self.nodes[node][0]] += size[node]
        return size

    def candidate(self) -> int:
        """The deepest container that holds all of the plain text; only links may stand beside it."""
        size, children = self.plain(), {}
        for node in range(1, len(self.nodes)):
            children.setdefault(self.nodes[node][0], []).append(node)
        at = 0
        while at in children:
            best = max(children[at], key=lambda n: (size[n], -n))
            if size[best] == 0 or size[best] < size[at]:
                break
            at = best
        return at

    def votes(self):
        """(path, marked, plain characters, linked characters, text) of each container with text of its own."""
        own: dict[int, list] = {}
        for node, _, piece, linked in self.pieces:
            if piece.strip():
                cell = own.setdefault(node, [0, 0, []])
                cell[linked] += len(piece.strip())
                cell[2].append(piece)
        for node, (plain, linked, pieces) in own.items():
            yield self.nodes[node][1], node in self.marked, plain, linked, " ".join("".join(pieces).split())

    def elected(self, verdicts: dict[str, bool]) -> list[bool]:
        """Whether each container is read, by its host's verdicts on paths.

        A path without a verdict follows the candidate and its surroundings. If the verdicts leave neither marked text
        nor half of the plain text, the page is not one of the host's kind and its candidate is read.
        """
        mine = self._inside([self.candidate()])
        keep = []
        for node, (around, path, _) in enumerate(self.nodes):
            default = mine[node] and (around < 0 or keep[around] or not mine[around])
            keep.append(verdicts.get(path, default))
        total = left = marked = 0
        for node, _, piece, linked in self.pieces:
            if not linked:
                n = len(piece.strip())
                total += n
                left += n * keep[node]
                marked += n * (keep[node] and node in self.marked)
        return keep if marked or left and 2 * left >= total else mine

    def _inside(self, roots) -> list[bool]:
        roots, inside = set(roots), []
        for node, (around, *_) in enumerate(self.nodes):
            inside.append(node in roots or around >= 0 and inside[around])
        return inside

    def text(self, roots) -> str:
        """Blocks inside the containers ``roots``, in page order."""
        return self.joined(self._inside(roots))

    def joined(self, read: list[bool]) -> str:
        """Blocks of the containers marked in ``read``, in page order."""
        out, block, now = [], None, []
        for node, number, piece, _ in self.pieces:
            if read[node]:
                if number != block:
                    out.append("".join(now))
                    block, now = number, []
                now.append(piece)
        out.append("".join(now))
        return " ".join(x for x in (" ".join(unescape(b).split()) for b in out) if x)


def _hidden(attributes: dict[str, str]) -> bool:
    return ("hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"
            or bool(re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I)))


def _junk(attributes: dict[str, str]) -> str:
    """"sure" if a class, id or role word names a junk element, "perhaps" if it only has a word of JUNK in it.

    It names one if its last part is a word of JUNK (user-comments) or its other parts only tell the layout (ad-slot).
    """
    found = ""
    for name in ("class", "id", "role"):
        for word in attributes.get(name, "").split():
            parts = [x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", word).lower()) if x]
            junk = JUNK.intersection(parts)
            if junk and parts[0] not in FLAGS and not (OWN.intersection(parts) and junk <= {"header", "text", "side"}):
                if parts[-1] in JUNK or not set(parts) - JUNK - LAYOUT - OWN:
                    return "sure"
                found = "perhaps"
    return found


def _keeps(plain: list[int], lengths: list[int], owner: list, suspects: list, marks: list) -> list[bool]:
    """Whether each suspect is the article and not junk.

    It is if it holds the page's article, main or first-rank heading (of several, one outside all suspects, then the
    longest), or most of the page's plain text while no article or main of the page stands beside it. One whose words
    only hint at junk is so too unless half of its text is links; an article's own header is so if it has a heading.
    """
    upto, whole, links, heads = [0], [0], [0], [0]
    for n, size, (_, link, head) in zip(plain, lengths, owner):
        upto.append(upto[-1] + n)
        whole.append(whole[-1] + size)
        links.append(links[-1] + size * link)
        heads.append(heads[-1] + size * head)
    chief = {}
    for tag, suspect, (a, b) in marks:
        rank = (suspect == 0, upto[b] - upto[a])
        if rank[1] and (tag not in chief or rank > chief[tag][0]):
            chief[tag] = (rank, a, b)
    keeps = [True]
    for _, (a, b), kind in suspects[1:]:
        holds = any(a <= c and d <= b for _, c, d in chief.values())
        beside = any(d <= a or b <= c for tag, (_, c, d) in chief.items() if tag != "h1")
        keep = holds or 2 * (upto[b] - upto[a]) > upto[-1] and not beside
        if kind == "title":
            keep = heads[b] > heads[a]
        elif kind == "perhaps":
            keep = keep or 2 * (links[b] - links[a]) < whole[b] - whole[a]
        keeps.append(keep)
    return keeps


def _digest(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(errors="replace"), digest_size=8).digest(), "big", signed=True)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of (page_id, url, html).

    Defined cases: a null or empty html gives an empty text; pages whose url
    is null or has no host share one nameless host; broken markup is read as
    far as it goes; repeated rows are repeated in the result; an empty table
    gives an empty result; other columns are ignored.
    """
    bound_batches(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1),
                              F.lit("")))
    source = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
                          host.alias("host"))

    def vote(batches):
        for batch in batches:
            out = []
            for name, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                votes = list(Page(html).votes())
                if votes:
                    mark = _digest("\n".join(v[4] for v in votes))
                    out.append((name, _ALL, mark, mark, 0, 0, 0))
                    out += [(name, path, mark, _digest(text), int(marked), plain, linked)
                            for path, marked, plain, linked, text in votes]
            columns = list(zip(*out)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.string() if i < 2 else pa.int64()) for i, c in enumerate(columns)],
                ["host", "path", "page", "digest", "marked", "plain", "linked"])

    sums = [F.sum(c).alias(c) for c in ("marked", "plain", "linked")]
    # Pages of equal text vote once; then per text, then per path: no step has more rows of a key than texts or pages.
    each = (source.select("host", "html")
            .mapInArrow(vote, "host string, path string, page long, digest long, marked long, plain long, linked long")
            .groupBy("host", "path", "digest", "page").agg(*[F.max(c).alias(c) for c in ("marked", "plain", "linked")])
            .groupBy("host", "path", "digest").agg(F.count(F.lit(1)).alias("seen"), *sums)
            .groupBy("host", "path").agg(F.sum("seen").alias("seen"), F.count(F.lit(1)).alias("texts"), *sums)
            .where(F.col("seen") >= LEAST_PAGES))
    pages_of_host = F.max(F.when(F.col("path") == _ALL, F.col("seen"))).over(Window.partitionBy("host"))
    loses = ((2 * F.col("marked") < F.col("seen"))
             & ((REPEATS * F.col("texts") <= F.col("seen"))
                | (F.col("linked") >= LINKED * (F.col("plain") + F.col("linked")))))
    verdicts = store(
        each.withColumn("pages", pages_of_host)
        .where((F.col("path") != _ALL) & (F.col("seen") >= SHARE * F.col("pages")))
        .groupBy("host").agg(F.collect_list(F.when(~loses, F.col("path"))).alias("won"),
                             F.collect_list(F.when(loses, F.col("path"))).alias("lost")))

    def read(batches):
        for batch in batches:
            out = []
            for html, won, lost in zip(*(batch.column(c).to_pylist() for c in ("html", "won", "lost"))):
                page = Page(html)
                out.append(page.joined(page.elected({p: w for paths, w in ((won, True), (lost, False))
                                                     for p in paths or []})))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    schema = T.StructType([source.schema["page_id"], source.schema["url"], T.StructField("text", T.StringType())])
    return (source.join(verdicts, "host", "left").select("page_id", "url", "html", "won", "lost").mapInArrow(read, schema)
            .withColumn("n_chars", F.length("text").cast("long")))
