"""Main text of HTML pages by wrapper induction.

The pages of a host are dealt into groups of about ``group`` pages; in each, the largest page's tree is the wrapper and every
page is aligned with it by simple tree matching. Trees are matched over block elements, with runs of like siblings as one node.
A block whose text is the same in most aligned pages is template; what varies is content. Pages of equal block texts have one vote
together, and within an article or main element votes remove nothing, so copies of a page keep its text. Of the content, blocks in menus, headers,
footers, sidebars, notices, adverts, forms and comments (by element, role, class or id) are left out, and where a page has an
article (else a main) element, everything outside it. A class or id counts if all parts of one of its tokens say so, if the
element holds no article or main element, and if it is mostly links or the elements hidden like this, the smallest kinds first,
are no more than half of the page's text.

A host with very many pages makes many groups, so no group grows with the data.

Edge cases: null html gives an empty text; a null URL is the empty host; pages that are alone in their group have no template.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from furrow.session import cut_lineage

# Elements of HTML by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg canvas audio video select annotation annotation-xml".split())
TO_THE_END = frozenset("script style textarea title iframe".split())  # unclosed, they take the rest of the page; the others end with their parent
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
                  "table tbody td tfoot th thead tr ul".split())
APART = frozenset("nav header footer aside form head button menu dialog fieldset search".split())
ENDS_P = BLOCK - frozenset(("body", "html", "head"))
SAME_ENDS = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)),
             "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
WORDS = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar "
                  "navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices popup modal newsletter subscribe "
                  "signup login share sharing social related recommended comment comments disqus respond replies pagination pager".split())
PLACES = frozenset("site page main top bottom left right primary secondary global list area box block bar".split())  # may stand beside WORDS

# Nested deeper, elements still end blocks but add no level; with more children, like siblings are one node wherever they stand.
DEEPEST, WIDEST = 100, 64
ASIDE = 100  # a named element within a line of text is hidden up to this many characters

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|</?[a-zA-Z](?:[^>"']|"[^"]*"|'[^']*')*+>|</?[a-zA-Z][^>]*>""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTR = re.compile(r"""\s(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>])""", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
_HREF = re.compile(r"\shref\s*=", re.I)
_PARTS = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")


class Node:
    """A block element: its blocks of own text (by number) and its children, in order."""

    __slots__ = ("tag", "key", "apart", "named", "texts", "children")

    def __init__(self, tag: str, key: str, apart: bool, named: str = ""):
        self.tag, self.key, self.apart, self.named, self.texts, self.children = tag, key, apart, named, [], []


def _name(tokens: str) -> str:
    """Those of the classes and ids that are made of WORDS (and PLACES) alone, without numbers."""
    split = [_PARTS.findall(x) for x in tokens.split()]
    return " ".join(sorted({"-".join(x) for x in split if not WORDS.isdisjoint(x) and all(y in WORDS or y in PLACES for y in x)}))


def _attributes(tag: str, name: str) -> tuple[str, bool, str]:
    """Class text for the node's key, whether the element is no main text, and the classes and ids that say so."""
    if "=" not in tag and "hidden" not in tag:
        return "", name in APART, ""
    found = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTR.findall(tag)}
    named, apart = "", False
    if name not in ("html", "body", "main", "article"):
        named = _name(f"{found.get('class', '')} {found.get('id', '')}")
        apart = (name in APART or found.get("role") in ROLES or "hidden" in found or found.get("aria-hidden") == "true"
                 or bool(_HIDDEN.search(found.get("style", ""))))
    return found.get("class", ""), apart, named


def _hidden_by_name(blocks: list[tuple], spared: set[int], inline: dict[int, Node]) -> set[int]:
    """The numbers of the blocks that a class or id hides; a block ends with its named elements and its characters in links."""
    kinds: dict[str, set[int]] = {}
    hidden: set[int] = set()
    size = [0 if b[1] else len(b[0]) for b in blocks]
    for k, b in enumerate(blocks):
        for node in b[4]:
            if id(node) in inline and inline[id(node)].texts and size[k] <= ASIDE:
                hidden.add(k)
            elif id(node) not in spared:
                kinds.setdefault(node.named, set()).add(k)
    room, taken = sum(size) / 2, set()
    for own in sorted(kinds.values(), key=lambda own: sum(size[k] for k in own)):
        if sum(blocks[k][5] for k in own if size[k]) * 2 >= sum(size[k] for k in own):
            hidden |= own
        elif sum(size[k] for k in taken | own) <= room:
            taken |= own
    return hidden | taken


def parse(html: str) -> tuple[Node, list[tuple[str, bool, bool, bool]]]:
    """The tree and the blocks in page order: (text, is apart, in an article, in a main element)."""
    root = Node("", "", False)
    stack: list[tuple[str, Node | None]] = [("", root)]
    path: list[Node] = [root]
    around: list[tuple] = [(False, False, False, ())]  # for each node of the path: is or lies in what is apart, an article, a main element; named elements since
    open_at: dict[str, list[int]] = {}  # the stack positions of each open name
    ends: dict[str, re.Match] = {}  # the next end of each RAW element
    blocks: list[tuple] = []  # as returned, the named elements around it, characters in links
    pieces: list[str] = []
    linked = links = 0  # characters in links of the block, links open
    spared: set[int] = set()  # named elements that hold an article or main element
    inline: dict[int, Node] = {}  # the parents of named elements without blocks in them
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                path[-1].texts.append(len(blocks))
                blocks.append((text, *around[-1], linked))
            linked = 0

    def opened(name: str, node: Node | None) -> None:
        open_at.setdefault(name, []).append(len(stack))
        stack.append((name, node))
        if node is not None:
            if node is not path[-1]:
                apart, article, main, named = around[-1]
                named = () if node.tag in ("article", "main") else (*named, node) if node.named else named
                around.append((apart or node.apart, article or node.tag == "article", main or node.tag == "main", named))
            else:
                around.append(around[-1])
            path.append(node)

    def close(k: int) -> None:
        """Leave the elements from stack position k on."""
        nonlocal links
        for name, node in stack[k:]:
            links -= name == "a href"
            open_at[name].pop()
            if node is not None:
                flush()
                path.pop()
                around.pop()
        del stack[k:]

    def innermost(names) -> int:
        return max((open_at[n][-1] for n in names if open_at.get(n)), default=0)

    def nearest(names, stops=()) -> int:
        """Stack position of the innermost of the names, 0 if there is none or a stop lies within it."""
        k = innermost(names)
        return k if k >= innermost(stops) else 0

    def raw_end(name: str, at: int) -> re.Match | None:
        """The end of a RAW element, if its parent does not end before."""
        if name in unclosed:
            return None
        end = ends.get(name)
        if end is None or end.start() < at:
            end = ends[name] = _RAW_END[name].search(html, at)
        if end is None:
            unclosed.add(name)
        elif name not in TO_THE_END and (parent := stack[-1][0].split(" ")[0]):
            depth = 0
            for m in re.compile(rf"<(/?){re.escape(parent)}(?=[\s/>])", re.I).finditer(html, at, end.start()):
                depth += -1 if m[1] else 1
                if depth < 0:
                    return None
        return end

    at = 0
    while True:
        m = _TAG.search(html, at)
        pieces.append(html[at:m.start()] if m else html[at:])
        if links:
            linked += len(" ".join(unescape(pieces[-1]).split()))
        if not m:
            break
        at, tag = m.end(), m[0]
        name = _NAME.match(tag)
        if not name:
            continue
        name = name[1].lower()
        if tag[1] == "/":
            if name == "br" or name == "p" and not nearest(("p",)):
                pieces.append(" ")
                continue
            k = nearest(("a", "a href") if name == "a" else (name,))
            if k:
                close(k)
            continue
        if name in RAW:
            end = None if tag.endswith("/>") and name == "svg" else raw_end(name, at)
            if end or tag.endswith("/>") or name in TO_THE_END:
                at = end.end() if end else at if tag.endswith("/>") else len(html)
                pieces.append(" " if name != "title" else "")
                continue
            classes, apart, named = "", not around[-1][0], ""
        else:
            classes, apart, named = _attributes(tag, name) if name not in VOID else ("", False, "")
        if name in BLOCK or apart or named:
            if name in ENDS_P and (k := nearest(("p",), ("td", "th", "li", "article", "section", "div", "body", "button"))):
                close(k)
            if name in SAME_ENDS:
                names, stops = SAME_ENDS[name]
                if k := nearest(names.split(), stops):
                    close(k)
            flush()
            if name == "hr":
                continue
            if len(path) > DEEPEST and (not apart or around[-1][0]):
                opened(name, path[-1])
                continue
            node = Node(name, f"{name}.{classes}", apart, named)
            if name in ("article", "main"):
                spared.update(id(n) for n in path[:DEEPEST + 1] if n.named)  # what follows there repeats the last one
            if name in BLOCK:
                for n in path[:DEEPEST + 1]:
                    inline.pop(id(n), None)
            elif named:
                inline[id(node)] = path[-1]
            path[-1].children.append(node)
            opened(name, node)
        elif name in VOID:
            pieces.append(" ")
        elif not tag.endswith("/>"):
            link = name == "a" and bool(_HREF.search(tag))
            links += link
            opened("a href" if link else name, None)
    close(1)
    flush()
    hidden = _hidden_by_name(blocks, spared, inline)
    return root, [(b[0], b[1] or k in hidden, b[2], b[3]) for k, b in enumerate(blocks)]


def fold(node: Node) -> Node:
    """The tree with runs of like siblings as one node."""
    out = Node(node.tag, node.key, node.apart)
    out.texts = list(node.texts)
    runs = [list(run) for _, run in groupby(node.children, key=lambda c: c.key)]
    if len(runs) > WIDEST:
        by: dict[str, list[Node]] = {}
        for c in node.children:
            by.setdefault(c.key, []).append(c)
        runs = list(by.values())
    for run in runs:
        whole = None
        for c in run:
            if whole is None:
                whole = Node(c.tag, c.key, c.apart)
            whole.texts += c.texts
            whole.children += c.children
        out.children.append(fold(whole))
    return out


def match(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the size of the largest matching of two trees that keeps order and levels, and its pairs."""
    if a.key != b.key:
        return 0, []
    m, n = len(a.children), len(b.children)
    size = [[0] * (n + 1) for _ in range(m + 1)]
    cell = {}
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            cell[i, j] = match(a.children[i - 1], b.children[j - 1])
            size[i][j] = max(size[i - 1][j], size[i][j - 1], size[i - 1][j - 1] + cell[i, j][0])
    pairs, i, j = [(a, b)], m, n
    while i and j:
        if size[i][j] == size[i - 1][j]:
            i -= 1
        elif size[i][j] == size[i][j - 1]:
            j -= 1
        else:
            pairs += cell[i, j][1]
            i, j = i - 1, j - 1
    return size[m][n] + 1, pairs


def _count(node: Node) -> int:
    return 1 + sum(map(_count, node.children))


def extract_group(pages: list[str], least: int = 3, share: float = 0.6) -> list[str]:
    """Main texts of pages of one host.

    A block outside article and main elements is template if ``share`` of the distinct pages that have its place (at least
    ``least``) have it there.
    """
    parsed = [(fold(tree), blocks) for tree, blocks in map(parse, pages)]
    template: list[set[int]] = [set() for _ in pages]
    like: dict[tuple[str, ...], list[int]] = {}
    for k, (_, blocks) in enumerate(parsed):
        like.setdefault(tuple(b[0] for b in blocks), []).append(k)
    if len(like) >= least:
        wrapper = max((tree for tree, _ in parsed), key=_count)
        aligned = [match(wrapper, tree)[1] for tree, _ in parsed]
        seen: Counter = Counter()
        same: Counter = Counter()
        for equal in like.values():
            seen.update({id(w) for k in equal for w, _ in aligned[k]})
            same.update({(id(w), parsed[k][1][t][0]) for k in equal for w, p in aligned[k] for t in p.texts})
        for k, (pairs, (_, blocks)) in enumerate(zip(aligned, parsed, strict=True)):
            template[k] = {t for w, p in pairs for t in p.texts if not (blocks[t][2] or blocks[t][3])
                           and same[id(w), blocks[t][0]] >= max(least, share * seen[id(w)])}
    out = []
    for (_, blocks), fixed in zip(parsed, template, strict=True):
        left = [b for k, b in enumerate(blocks) if not b[1] and k not in fixed]
        # the article decides where one is, even if nothing is left in it
        for part in (2, 3):
            if any(b[part] and not b[1] for b in blocks):
                left = [b for b in left if b[part]]
                break
        out.append("\n".join(b[0] for b in left))
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("host", "part", "page_id", "url", "html")), strict=True)

    for _, group in groupby(rows(), key=lambda r: r[:2]):
        group = list(group)
        texts = extract_group([r[4] for r in group])
        yield pa.RecordBatch.from_arrays([pa.array([r[2] for r in group], pa.int64()), pa.array([r[3] for r in group], pa.string()), pa.array(texts, pa.string())],
                                         ["page_id", "url", "text"])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", group: int = 32) -> DataFrame:
    """(page_id, url, text) of every row."""
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    rows = pages.select(host.alias("host"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    parts = cut_lineage(rows.groupBy("host").agg(F.ceil(F.count("*") / group).alias("parts")))
    dealt = rows.join(parts, "host").withColumn("part", F.pmod(F.xxhash64("page_id", "url", F.length("html")), F.col("parts"))).drop("parts")
    return dealt.repartition("host", "part").sortWithinPartitions("host", "part", "page_id", "url").mapInArrow(
        _extract, "page_id long, url string, text string")
