"""Main text of web pages by consensus host paths.

Pass 1 parses each page, scores its containers by the text they hold and how much of it is links and noise, and emits
the generalised tag-class path of the best one. Spark adds up the votes by host and path; the path with most votes
wins its host. Pass 2 parses the pages again and extracts the text of the containers on their host's winning path, or
of the page's own best container where that path is absent.

Text rules: character references are decoded; white space inside a block is one space; blocks are trimmed and joined
in page order by one space. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments are left out by tag and by the names in class, id and role. Markup is scanned in linear time as HTML parsers
read it: unquoted values end at white space or ">", and quotes elsewhere are letters like others. Elements without
markup (but for scripts and styles) that are never closed end with the element around them.

Defined results: null and empty html give an empty text; a null url, or one without a host, votes for the host "";
repeated rows vote and are extracted each on its own; ties of votes go to the lesser path; an empty table gives an
empty table; only id, url and html columns are read.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace, broadcast_if_few, map_columns

#: Winning paths (about 200 bytes each) that may be broadcast.
BROADCAST_HOSTS = 100_000
#: Steps of a generalised path before those above them are told by a digest.
PATH_STEPS = 12

# The HTML standard's void and raw-text elements and block-level elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe svg math template object".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
CLOSES_P = BLOCK - frozenset("caption dd dt head html body legend li summary tbody td tfoot th thead title tr".split())
# Elements that hold no main text, and words in class, id or role that say so.
NOISE_TAGS = frozenset("nav header footer aside form button select option label input dialog menu head script style textarea title noscript iframe svg math template object".split())
NOISE_WORDS = frozenset("nav navbar navigation menu breadcrumb breadcrumbs header footer sidebar side aside widget ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social comment comments respond reply replies discussion disqus related recommended recommendations toolbar pagination pager search masthead skip complementary contentinfo".split())
CONTAINERS = frozenset("article main section div body td blockquote".split())
HINTS = frozenset("article content main post entry story body text".split())

# Words that do not change what a name stands for: the "list" of "comment-list".
NEUTRAL = frozenset("site page global primary secondary top bottom left right main box bar block list wrap wrapper container section area inner outer item items link links button buttons icon icons form panel column col row group slot unit media posts articles stories".split())
# Words of noise that articles have for parts of their own, such as "post-header".
PARTS = frozenset("header footer side aside banner notice notices search".split())

_tag_name = re.compile(r"[A-Za-z][A-Za-z0-9:_-]*")
# Attributes as nearly all pages write them; their values hold no angle brackets, so a miss costs no more than the tag.
_plain_attributes = re.compile(r"""((?:\s++[^\s"'<>/=]++(?:=(?:"[^"<>]*+"|'[^'<>]*+'|[^\s"'<>=/]++))?+)*+)\s*+(/?)>""")
_named = re.compile(r"""\s(class|id|role)=(?:"([^"]*)"|'([^']*)'|(\S+))""", re.I)
_gap, _attribute_name, _equals, _unquoted = re.compile(r"[\s/]*+"), re.compile(r"=?[^\s/>=]*+"), re.compile(r"\s*+=\s*+"), re.compile(r"[^\s>]*+")
_name_words = re.compile(r"[A-Za-z]+")
_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)"


def name_words(value: str) -> list[str]:
    """Words of an attribute value, camel case taken apart, digits dropped."""
    return [w.lower() for w in _name_words.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", value))]


def is_noise(value: str, in_article: bool) -> bool:
    """Whether a name in a class, id or role says that the element is no main text: its last word that is not neutral
    decides ("post-comments", not "sharing-economy"); parts of articles are none."""
    for name in value.split():
        words = name_words(name)
        heads = [w for w in words if w not in NEUTRAL]
        if heads and heads[-1] in NOISE_WORDS and not (heads[-1] in PARTS and (in_article or not HINTS.isdisjoint(words[:-1]))):
            return True
    return False


class Tags:
    """Scans a page's markup once, from left to right: no part of it is looked at more than a few times."""

    def __init__(self, page: str):
        self.page = page
        self.never: set[str] = set()  # what is known not to come any more

    def find(self, what: str, at: int) -> int:
        if what in self.never:
            return -1
        if (k := self.page.find(what, at)) < 0:
            self.never.add(what)
        return k

    def attributes(self, at: int) -> tuple[list[tuple[str, str]], int, bool]:
        """(class, id and role with their values, the place after the tag, whether it closes itself). A quote that is
        never closed is part of an unquoted value; quotes elsewhere are letters like others."""
        if m := _plain_attributes.match(self.page, at):
            found = [(x[1].lower(), x[2] or x[3] or x[4] or "") for x in _named.finditer(m[1])] if m[1] else []
            return found, m.end(), bool(m[2])
        page, n, found = self.page, len(self.page), []
        while True:
            at = _gap.match(page, at).end()
            if at >= n:
                return found, n, False
            if page[at] == ">":
                return found, at + 1, page[at - 1] == "/"
            m = _attribute_name.match(page, at)
            name, at, value = m[0].lower(), m.end(), ""
            if m := _equals.match(page, at):
                at = m.end()
                quote = page[at : at + 1]
                if quote in ('"', "'") and quote and (end := self.find(quote, at + 1)) >= 0:
                    value, at = page[at + 1 : end], end + 1
                else:
                    m = _unquoted.match(page, at)
                    value, at = m[0], m.end()
            if name in ("class", "id", "role"):
                found.append((name, value))

    def raw_end(self, tag: str, at: int) -> int:
        """The place after the end tag of an element whose content is no markup, or -1."""
        if (end := "</" + tag) in self.never:
            return -1
        m = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(self.page, at)
        if not m:
            self.never.add(end)
            return -1
        return m.end()

    def next(self, at: int) -> tuple[int, int, str, bool]:
        """(start, end of what is known to be markup, tag name in lower case or "", whether it is an end tag) of the
        next markup; for a tag, the end is where its attributes begin."""
        page, n = self.page, len(self.page)
        while True:
            start = page.find("<", at)
            if start < 0 or start + 1 >= n:
                return n, n, "", False
            c = page[start + 1]
            if c == "!":
                if page.startswith("<!--", start):
                    k = self.find("-->", start + 2)
                    return start, n if k < 0 else k + 3, "", False
                if page.startswith("<![CDATA[", start):
                    k = self.find("]]>", start)
                    return start, n if k < 0 else k + 3, "", False
            if c in "!?":
                k = self.find(">", start)
                return start, n if k < 0 else k + 1, "", False
            closing = c == "/"
            if m := _tag_name.match(page, start + 1 + closing):
                return start, m.end(), m[0].lower(), closing
            at = start + 1


class Node:
    """An open element; ``home`` is the nearest container, the element itself if it is one."""

    __slots__ = ("tag", "path", "noise", "parent", "linked", "hint", "home")

    def __init__(self, tag, path, noise, parent, hint):
        self.tag, self.path, self.noise, self.parent, self.hint = tag, path, noise, parent, hint
        self.linked = 0
        self.home = self if tag in CONTAINERS else parent.home if parent is not None else None


def parse(page: str):
    """(nodes, blocks): the containers, and (container, text, is link) runs of each block in page order.

    A block is a list of (node, raw text) pieces; whoever extracts it joins, decodes and normalises the pieces.
    """
    root = Node("", "", False, None, False)
    stack: list[Node] = [root]
    nodes: list[Node] = []
    blocks: list[list[tuple[Node, str]]] = [[]]
    links = at = 0
    opened: Counter[str] = Counter()  # by tag, so that an end tag without a start costs nothing

    def put(text):
        if text and not stack[-1].noise:
            blocks[-1].append((stack[-1], text))
            if links:
                stack[-1].linked += len(text)

    def cut():
        if blocks[-1]:
            blocks.append([])

    def close(k):
        nonlocal links
        for node in stack[k:]:
            opened[node.tag] -= 1
            if node.tag == "a":
                links -= 1
        del stack[k:]

    scanner = Tags(page)
    while True:
        start, end, tag, closing = scanner.next(at)
        put(page[at:start])
        if start >= len(page):
            break
        at = end
        if not tag:
            continue
        named, at, closed = scanner.attributes(at)
        if closing:
            if tag in BLOCK:
                cut()
            k = len(stack) - 1 if opened[tag] else 0
            while k and stack[k].tag != tag:
                if stack[k].tag in CONTAINERS and tag not in BLOCK:
                    k = 0
                    break
                k -= 1
            if k:
                close(k)
            continue
        if tag in BLOCK:
            cut()
            if opened["p"] and (tag in CLOSES_P or tag == "p"):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == "p":
                        close(k)
                        break
                    if stack[k].tag in BLOCK:
                        break
            elif opened[tag] and tag in ("li", "td", "th", "tr", "dt", "dd"):
                ends = {"li": ("ul", "ol", "menu"), "tr": ("table", "tbody", "thead", "tfoot")}.get(tag, ("dl", "tr", "table"))
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if stack[k].tag in ends:
                        break
        if tag == "br":
            put(" ")
        if tag in VOID:
            continue
        if tag in RAW:
            after = scanner.raw_end(tag, at)
            if after >= 0 or tag in ("script", "style"):
                at = after if after >= 0 else len(page)
                continue
        words: list[str] = []
        classes = ""
        noise = stack[-1].noise or (tag in NOISE_TAGS and not (tag == "header" and opened["article"]))
        for name, value in named:
            found = name_words(value)
            words += found
            if name == "class":
                classes = ".".join(sorted(set(found)))
            if not noise and tag not in ("body", "html", "article", "main"):
                noise = is_noise(value, bool(opened["article"]))
        if tag == "a":
            links += 1
        path = f"{stack[-1].path}/{tag}.{classes}" if classes else f"{stack[-1].path}/{tag}"
        if tag in CONTAINERS and path.count("/") > PATH_STEPS:  # the steps above as a digest, so that deep pages stay small
            path = f"#{hashlib.blake2b(stack[-1].path.encode('utf-8', 'surrogatepass'), digest_size=12).hexdigest()}{path[path.rindex('/'):]}"
        # Generalised: inside a container only containers count, so that paragraphs and inline tags share its path.
        node = Node(tag, path if tag in CONTAINERS or tag == "html" else stack[-1].path, noise, stack[-1], tag in ("article", "main") or not HINTS.isdisjoint(words))
        if tag in CONTAINERS and not noise:
            nodes.append(node)
        stack.append(node)
        opened[tag] += 1
        if closed and tag not in BLOCK:
            close(len(stack) - 1)
    return nodes, blocks


def scored(nodes: list[Node], blocks) -> list[tuple[float, Node]]:
    """Each container's score: its text with that of its inner containers at a discount, less what is linked."""
    own: dict[int, float] = {id(n): 0.0 for n in nodes}
    for block in blocks:
        for node, text in block:
            home = node.home
            if home is not None and id(home) in own:
                own[id(home)] += len(text.strip())
    linked: dict[int, float] = {}
    for block in blocks:
        for node, _ in block:
            if node.linked:
                home = node.home
                linked[id(home)] = linked.get(id(home), 0.0) + node.linked
                node.linked = 0
    total = {k: max(0.0, v - 2 * linked.get(k, 0.0)) for k, v in own.items()}
    # Inner containers come after outer ones in page order: add them up from the end.
    for n in reversed(nodes):
        outer = n.parent.home
        if outer is not None and id(outer) in total:
            total[id(outer)] += 0.8 * total[id(n)]
    return [(total[id(n)] * (1.5 if n.hint else 1.0), n) for n in nodes]


def best_path(page: str) -> tuple[str, float]:
    """The path of the page's best container and its score; the outermost of equal ones."""
    ranked = scored(*parse(page))
    if not ranked:
        return "", 0.0
    score, node = max(ranked, key=lambda x: x[0])
    return node.path, score


def extract(page: str, path: str | None) -> str:
    """The text of all containers on ``path``; of the page's best container if there is none with text."""
    nodes, blocks = parse(page)
    wanted = {id(n) for n in nodes if path and n.path == path}

    def text_of(ids: set[int]) -> str:
        inside: dict[int, bool] = {}

        def is_in(node) -> bool:
            chain = []
            while node is not None and id(node) not in inside:
                if id(node) in ids:
                    inside[id(node)] = True
                    break
                chain.append(node)
                node = node.parent
            answer = inside.get(id(node), False) if node is not None else False
            for n in chain:
                inside[id(n)] = answer
            return answer

        out = []
        for block in blocks:
            text = " ".join(html_lib.unescape("".join(t for n, t in block if is_in(n))).split())
            if text:
                out.append(text)
        return " ".join(out)

    found = text_of(wanted) if wanted else ""
    if not found:
        if nodes:
            found = text_of({id(max(scored(nodes, blocks), key=lambda x: x[0])[1])})
        else:  # no container at all: everything that is not noise
            found = " ".join(t for t in (" ".join(html_lib.unescape("".join(x for _, x in b)).split()) for b in blocks) if t)
    return found


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of each page."""
    work = Workspace(pages.sparkSession)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def voting():
        def fn(hosts, htmls):
            for host, page in zip(hosts, htmls, strict=True):
                path, score = best_path(page or "")
                if score > 0:
                    yield host, path

        return fn

    host = F.lower(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit("")))
    votes = map_columns(rows.select(host.alias("host"), "html"), voting, "host string, path string")
    tally = votes.groupBy("host", "path").agg(F.count("*").alias("n"))
    winners = work.keep(tally.groupBy("host").agg(F.min_by("path", F.struct((-F.col("n")).alias("minus"), "path")).alias("path")))
    led = rows.withColumn("host", host).join(broadcast_if_few(winners, BROADCAST_HOSTS), "host", "left")

    def extracting():
        def fn(ids, urls, htmls, paths):
            for i, url, page, path in zip(ids, urls, htmls, paths, strict=True):
                text = extract(page, path) if page else ""
                yield i, url, text, len(text)

        return fn

    return map_columns(led.select("page_id", "url", "html", "path"), extracting, "page_id long, url string, text string, n_chars long")
