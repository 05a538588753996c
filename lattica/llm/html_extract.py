"""Layout-aware text of HTML: a tree builder with implied tags, visibility rules, and a block renderer.

All visible text comes out, in document order: blocks on lines of their own with
a blank line around paragraphs and headings, list items with bullets or numbers
and indented by depth, table cells padded so that columns line up, preformatted
text as it stands. What never shows, or what attributes or style rules on simple
selectors hide, is left out: the most specific and then the last rule counts,
rules for other media don't, and what is visible again within something invisible
comes out. Of controls the text they show counts: chosen options, values of
buttons and fields. A closed ``details`` shows its summary only.
"""

from __future__ import annotations

import re
from bisect import bisect
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Groups of element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
HIDDEN = frozenset("head title script style template noscript iframe object audio video canvas datalist noembed noframes param datalist annotation annotation-xml desc defs metadata".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr ul caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure article section".split())
CLOSES_P = BLOCK - frozenset("dd dt li optgroup option tbody tfoot thead tr caption body html legend".split()) | {"table"}
#: An element that opens ends those of the first set that are open, looking up to the nearest of the second.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
IN_HEAD = frozenset("base link meta title style script noscript template head html".split())
CELLS = ("td", "th", "table")
KEEP_P = ("td", "th", "li", "button", "table", "caption", "object")

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>?", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
DECLARED = re.compile(r"(?:^|[;{\s])(display|visibility)\s*:\s*([a-z-]+)[^;!]*(!\s*important)?", re.I)
#: Input types that show no text of theirs.
SILENT = frozenset("hidden checkbox radio image file password color range".split())
ASCII_SPACE = " \t\n\r\f"
SIMPLE = re.compile(r"^([a-z][a-z0-9]*)?(?:([.#])([\w-]+))?$", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


class Element:
    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: dict[str, str]):
        self.name, self.attributes, self.children = name, attributes, []


def parse(html: str) -> tuple[Element, str]:
    """The tree under a root, and the text of its style sheets."""
    root = Element("", {})
    open_, sheets, at = [root], [], 0
    places: dict[str, list[int]] = {}  # where in open_ elements of each name are

    def close_to(i: int) -> None:
        for e in open_[i:]:
            places[e.name].pop()
        del open_[i:]

    def last(*names: str) -> int:
        """The place of the innermost open element of these names, 0 if there is none."""
        return max((places[n][-1] for n in names if places.get(n)), default=0)

    def close_head() -> None:
        close_to(next(i for i, e in enumerate(open_) if e.name == "head"))

    def text(raw: str) -> None:
        if any(e.name == "head" for e in open_[:3]) and raw.strip() and open_[-1].name not in RAW:
            close_head()
        open_[-1].children.append(unescape(raw))

    def begin(name: str, attributes: dict[str, str]) -> None:
        if name in CLOSES_P or name == "p":
            if (i := last("p")) > last(*KEEP_P):
                close_to(i)
        elif name in IMPLIED:
            ends, stop = IMPLIED[name]
            outer = last(*stop)
            inside = [x[k] for n in ends if (x := places.get(n)) and (k := bisect(x, outer)) < len(x)]
            if inside:
                close_to(min(inside))
        if name not in IN_HEAD and any(e.name == "head" for e in open_[:3]):
            close_head()
        if name in ("td", "th") and open_[-1].name in ("table", "tbody", "thead", "tfoot"):
            begin("tr", {})
        if name in ("html", "body") and last(name):
            return
        e = Element(name, attributes)
        open_[-1].children.append(e)
        if name not in VOID:
            places.setdefault(name, []).append(len(open_))
            open_.append(e)

    while m := TOKEN.search(html, at):
        if m.start() > at:
            text(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "br":
                begin("br", {})
            elif name == "p" and not last("p"):
                begin("p", {})
                close_to(len(open_) - 1)
            elif (i := last(name)) and (name in ("table", "tr", "tbody", "thead", "tfoot", "body", "html") or i >= last(*CELLS)):
                close_to(i)
            continue
        attributes = {}
        for a in ATTRIBUTE.finditer(m[3]):
            attributes.setdefault(a[1].lower(), unescape(a[2] or a[3] or a[4] or ""))
        begin(name, attributes)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I).search(html, at)
            inner = html[at : end.start() if end else len(html)]
            if name == "style":
                if not attributes.get("media") or on_screen(attributes["media"]):
                    sheets.append(inner)
            elif name in ("textarea", "title"):
                text(inner)
            at = end.start() if end else len(html)
            if end is None and len(open_) > 1:
                close_to(len(open_) - 1)
    if at < len(html):
        text(html[at:])
    return root, "\n".join(sheets)


def on_screen(media: str) -> bool:
    """Whether one of a list of media queries is for screens; conditions of size and the like are taken as met."""
    kinds = [re.match(r"\s*(not\s+|only\s+)?([a-z-]*)", q.lower()) for q in media.split(",")]
    return any((k[2] in ("", "all", "screen", "and")) != (k[1] or "").startswith("not") for k in kinds)


def rules_of(css: str) -> dict[tuple[str, str, str], list[tuple]]:
    """What style sheets say of display and visibility: by selector (element, mark, name), (property, (important, specificity, place), value)."""
    out: dict[tuple[str, str, str], list[tuple]] = {}
    css = re.sub(r"/\*.*?(?:\*/|\Z)", "", css, flags=re.S)
    at, inside, place = 0, [], 0  # inside: whether each open at-rule's rules count
    for m in re.finditer(r"([^{};]*)([{};])|[^{};]+\Z", css):
        if m.start() < at or not m[2]:
            continue
        head = m[1].strip()
        if m[2] == "}":
            if inside:
                inside.pop()
        elif m[2] == "{" and head.startswith("@"):
            kind, _, rest = head[1:].partition(" ")
            kind = kind.lower()
            inside.append(on_screen(rest) if kind == "media" else kind in ("supports", "layer", "container"))
        elif m[2] == "{":
            end = css.find("}", m.end())
            body, at = css[m.end() : end if end >= 0 else len(css)], (end + 1 if end >= 0 else len(css))
            if all(inside):
                for s in head.split(","):
                    if s.strip() and (x := SIMPLE.match(s.strip())):
                        key = (x[1].lower() if x[1] else "", x[2] or "", x[3] or "")
                        rank = {"#": 100, ".": 10, "": 0}[key[1]] + bool(key[0])
                        for d in DECLARED.finditer(body):
                            place += 1
                            out.setdefault(key, []).append((d[1].lower(), (bool(d[3]), rank, place), d[2].lower()))
    return out


def styles(e: Element, rules: dict) -> dict[str, str]:
    """The element's own display and visibility, where attributes or rules give any."""
    a, best = e.attributes, {}
    found = [("display", (False, -1, 0), "none")] if "hidden" in a else []
    if rules:
        names = [("", "")] + [(".", c) for c in a.get("class", "").split()] + ([("#", a["id"])] if "id" in a else [])
        found += [d for mark, x in names for n in {e.name, ""} for d in rules.get((n, mark, x), ())]
    if "style" in a:
        found += [(d[1].lower(), (bool(d[3]), 1000, i), d[2].lower()) for i, d in enumerate(DECLARED.finditer(a["style"]))]
    for what, rank, value in found:
        if what not in best or best[what][0] <= rank:
            best[what] = rank, value
    return {what: value for what, (_, value) in best.items()}


def shown_children(e: Element) -> list:
    """Children that an element's own kind lets show."""
    if e.name == "details" and "open" not in e.attributes:
        first = next((c for c in e.children if isinstance(c, Element) and c.name == "summary"), None)
        return [] if first is None else [first]
    if e.name == "select" and "multiple" not in e.attributes and e.attributes.get("size", "1") in ("", "0", "1"):
        options, left = [], list(reversed(e.children))
        while left:
            c = left.pop()
            if isinstance(c, Element):
                if c.name == "option":
                    options.append(c)
                else:
                    left += reversed(c.children)
        chosen = [c for c in options if "selected" in c.attributes]
        return [x for c in (chosen[-1:] or options[:1]) for x in c.children]
    if e.name == "input" and e.attributes.get("type", "text").lower() not in SILENT:
        return [e.attributes.get("value", "")]
    return e.children


def only_visible(root: Element, rules: dict) -> None:
    """Take what doesn't show out of the tree."""
    left = [(root, True)]
    while left:
        e, visible = left.pop()
        kept = []
        for c in shown_children(e):
            if isinstance(c, str):
                if visible:
                    kept.append(c)
                continue
            if c.name in HIDDEN or (c.name == "title" and e.name in ("svg", "g")) or (c.name == "dialog" and "open" not in c.attributes):
                continue
            own = styles(c, rules)
            if own.get("display") == "none":
                continue
            seen = {"visible": True, "hidden": False, "collapse": False}.get(own.get("visibility"), visible)
            kept.append(c)
            left.append((c, seen))
        e.children = kept


class Lines:
    """Text as it is laid out: the lines so far and the one that is being filled."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.gap = False

    def add(self, s: str) -> None:
        """Inline text: runs of white space are one space, none at the start of a line."""
        words = SPACE.sub(" ", s)
        if not words:
            return
        if words[0] == " ":
            self.space, words = True, words[1:]
        if not words:
            return
        if self.space and self.now:
            self.now.append(" ")
        self.space = words[-1] == " "
        self.now.append(words.rstrip(" "))

    def end(self, blank: bool = False) -> None:
        """End the line, if it has anything; with ``blank`` an empty line is to follow before the next."""
        if self.now:
            if self.gap and self.lines:
                self.lines.append("")
            self.lines.append("".join(self.now))
            self.now, self.gap = [], False
        self.space = False
        self.gap |= blank

    def take(self, lines: list[str], blank: bool, first: str = "", rest: str = "") -> None:
        """Lines that were laid out apart, behind a mark and an indent."""
        self.end(blank)
        if lines:
            if self.gap and self.lines:
                self.lines.append("")
            self.gap = False
            self.lines += [f"{first if i == 0 else rest}{x}" if x or i == 0 else "" for i, x in enumerate(lines)]
            self.gap = blank


def run(step):
    """Run one of the generators below to its end. They yield those they need the result of, which wait on a stack, so no depth of the tree is too much."""
    stack, value = [step], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as e:
            stack.pop()
            value = e.value
    return value


def lay_out(e: Element, out: Lines, depth: int = 0):
    for c in e.children:
        if isinstance(c, str):
            out.add(c)
            continue
        name = c.name
        if name == "br":
            out.now = out.now or [""]
            out.end()
        elif name == "hr":
            out.end(True)
        elif name in ("ul", "ol", "menu", "dir"):
            yield items(c, out, depth)
        elif name == "table":
            out.take((yield table(c)), True)
        elif name in ("pre", "xmp"):
            raw = plain(c)
            out.take((raw[1:] if raw.startswith("\n") else raw).rstrip("\n").split("\n") if raw.strip() else [], True)
        elif name in ("blockquote", "dd"):
            inner = Lines()
            yield lay_out(c, inner, depth)
            inner.end()
            out.take(inner.lines, name == "blockquote", "  ", "  ")
        elif name in BLOCK:
            out.end(name in SPACED)
            yield lay_out(c, out, depth)
            out.end(name in SPACED)
        else:
            yield lay_out(c, out, depth)


def items(e: Element, out: Lines, depth: int):
    blank = depth == 0
    out.end(blank)
    start = e.attributes.get("start", "1")
    n = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for c in e.children:
        if isinstance(c, str) or c.name != "li":
            loose = Element("", {})
            loose.children = [c]
            inner, mark = Lines(), ""
            yield lay_out(loose, inner, depth + 1)
        else:
            mark = f"{n}. " if e.name == "ol" else "- "
            n += 1
            inner = Lines()
            yield lay_out(c, inner, depth + 1)
        inner.end()
        out.take(inner.lines, False, mark, " " * len(mark) or "  ")
    out.end(blank)


def plain(e: Element) -> str:
    """Its text as it stands."""
    out, left = [], [e]
    while left:
        c = left.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.name == "br":
            out.append("\n")
        else:
            left += reversed(c.children)
    return "".join(out)


def spans(e: Element, name: str) -> int:
    given = e.attributes.get(name, "1")
    return min(1000, max(1, int(given))) if re.fullmatch(r"\d{1,4}", given) else 1


def table(e: Element):
    """Lines of a table: its caption, then rows whose cells start at the same places; a spanning cell takes as many columns or rows."""
    head, grid = [], []

    def walk(x: Element):
        for c in x.children:
            if isinstance(c, str):
                if c.strip(ASCII_SPACE):
                    head.append(SPACE.sub(" ", c).strip(ASCII_SPACE))
            elif c.name == "tr":
                row = []
                for d in c.children:
                    if isinstance(d, str):
                        if d.strip(ASCII_SPACE):
                            row.append(([SPACE.sub(" ", d).strip(ASCII_SPACE)], 1, 1))
                    else:
                        inner = Lines()
                        cell = d if d.name in ("td", "th") else Element("", {})
                        if cell is not d:
                            cell.children = [d]
                        yield lay_out(cell, inner)
                        inner.end()
                        row.append((inner.lines or [""], spans(cell, "colspan"), spans(cell, "rowspan")))
                grid.append(row)
            elif c.name in ("tbody", "thead", "tfoot", "colgroup"):
                yield walk(c)
            else:
                inner = Lines()
                loose = Element("", {})
                loose.children = [c]
                yield lay_out(loose, inner)
                inner.end()
                head.extend(inner.lines)

    yield walk(e)
    placed: list[list[tuple[int, int, list[str]]]] = []  # (column, columns, lines) of each row's cells
    widths: dict[int, int] = {}
    taken: dict[int, int] = {}  # column -> further rows in which a cell from above has it
    for row in grid:
        at, mine, from_above = 0, [], taken
        taken = {c: n - 1 for c, n in from_above.items() if n > 1}
        for lines, columns, rows in row:
            while at in from_above:
                at += 1
            mine.append((at, columns, lines))
            if columns == 1:
                widths[at] = max(widths.get(at, 0), *map(len, lines))
            if rows > 1:
                taken |= dict.fromkeys(range(at, at + columns), rows - 1)
            at += columns
        placed.append(mine)
    starts = np.cumsum([0, *(widths.get(k, 0) + 2 for k in range(max((a + n for mine in placed for a, n, _ in mine), default=0)))]).tolist()
    out = list(head)
    for mine in placed:
        for i in range(max((len(lines) for _, _, lines in mine), default=0)):
            line = ""
            for at, _, lines in mine:
                if line and len(line) > starts[at]:
                    line += " " * 2  # a spanning cell was wider than its columns
                line = line.ljust(starts[at]) + (lines[i] if i < len(lines) else "")
            out.append(line.rstrip())
    return [x for x in out if x] if any(out) else []


def extract(html: str | None) -> str:
    """The visible text; empty for a null or empty page."""
    if not html:
        return ""
    root, css = parse(html)
    only_visible(root, rules_of(css))
    out = Lines()
    run(lay_out(root, out))
    out.end()
    return "\n".join(line.rstrip() for line in out.lines)


def _batches(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([extract(h) for h in b.column(1).to_pylist()], pa.string())], ["page_id", "text"])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, text) for every row of pages.

    Null and empty html give an empty text; null ids and repeated rows are kept,
    and other columns are not read. Pages of any length and depth are rendered
    whole. Of rules that tie the last counts, of repeated attributes the first.
    """
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(_batches, "page_id long, text string")


def query(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
