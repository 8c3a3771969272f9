"""Visible text of HTML pages, laid out as a reader sees it.

A page is cut into tags and text, built into a tree with the tags that HTML implies (a paragraph ends where a
block starts, a cell where the next one starts, and so on), and written out: blocks on lines of their own,
margins as blank lines, list items with bullets or numbers, table cells in aligned columns, white space
collapsed except in preformatted text. Elements that a browser does not show are left out; what a hidden
element shows again (``visibility``) is there, as are form texts, formulas and the texts of drawings.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipcause.llm.common import ship_package, table, without

#: Fixed values of HTML.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"}
UNSEEN = {
    "head", "script", "style", "title", "template", "noscript", "iframe", "noembed", "noframes", "object", "audio", "video",
    "canvas", "datalist",
}
#: Not shown inside drawings and formulas; elsewhere these names mean nothing.
UNSEEN_IN = {
    "svg": {
        "clippath", "defs", "desc", "filter", "lineargradient", "marker", "mask", "metadata", "pattern", "radialgradient", "symbol",
    },
    "math": {"annotation", "annotation-xml", "mphantom"},
}
#: Elements of drawings and formulas that hold HTML, HTML tags that end both, and formula parts that do not stand in line.
HOLDS_HTML = {"svg": {"desc", "foreignobject", "title"}, "math": {"mi", "mn", "mo", "ms", "mtext"}}
ENDS_FOREIGN = {
    "b", "big", "blockquote", "body", "br", "center", "code", "dd", "div", "dl", "dt", "em", "embed", "h1", "h2", "h3", "h4", "h5",
    "h6", "head", "hr", "i", "img", "li", "listing", "menu", "meta", "nobr", "ol", "p", "pre", "ruby", "s", "small", "span", "strong",
    "strike", "sub", "sup", "table", "tt", "u", "ul", "var",
}
APART = {"mfrac", "mmultiscripts", "mover", "mroot", "msub", "msubsup", "msup", "mtable", "mtr", "munder", "munderover"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li",
    "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search", "section", "summary", "table", "ul", "xmp", "caption",
}
MARGINS = {"blockquote", "dl", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "ol", "p", "pre", "table", "ul", "dir", "menu", "xmp", "hr"}
LISTS = {"ul", "ol", "dir", "menu"}
#: What a start tag ends, and the elements beyond which it does not look.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
ENDS_PARAGRAPH = BLOCKS - {"body", "html", "option", "optgroup", "legend", "caption"}
HEAD_ONLY = {"base", "link", "meta", "title", "style", "script", "noscript", "template", "head", "html", "bgsound"}

TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<(?P<slash>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
CSS_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
DECLARATION = re.compile(
    r"(?:[^;\"'(]|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z)|\((?:[^)\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*+(?:\)|\Z))++"
)
IMPORTANT = re.compile(r"\s*!\s*important$")
#: Properties that hide, and the values a browser knows; it passes over declarations with others.
GLOBAL = {"inherit", "initial", "unset", "revert", "revert-layer"}
HIDES = {
    "display": re.compile(
        r"none|contents|(?:inline-)?(?:block|flex|grid|table)|table-[a-z-]+|ruby(?:-[a-z-]+)?|math|run-in|-(?:webkit|moz|ms)-[a-z-]+"
        r"|(?:(?:block|inline|flow|flow-root|flex|grid|table|ruby|list-item)(?:\s+|$))+|" + "|".join(GLOBAL)
    ),
    "visibility": re.compile("visible|hidden|collapse|" + "|".join(GLOBAL)),
    "content-visibility": re.compile("visible|hidden|auto|" + "|".join(GLOBAL)),
}
SPACES = re.compile(r"[ \t\n\r\f]+")
INTEGER = re.compile(r"[ \t\n\r\f]*([+-]?[0-9]{1,9})(?![0-9])")
#: Columns of a table, and rows that a cell may go over, at most; what is beyond stands in columns and rows of its own.
COLUMNS, ROWS = 1000, 65_534
#: Longer lines run over their column instead of widening it.
WIDEST = 100
#: Cells are aligned where that makes a table at most so many times longer (and so many characters).
PADDING, ALLOWANCE = 8, 4096


class Node:
    """An element; ``inside`` and ``inner`` are "svg", "math" or "": what it stands in, and what its children do."""

    __slots__ = ("attributes", "children", "inner", "inside", "name")

    def __init__(self, name: str, attributes: dict[str, str], inside: str = ""):
        self.name, self.attributes, self.children, self.inside = name, attributes, [], inside
        self.inner = name if name in ("svg", "math") else "" if inside and name in HOLDS_HTML[inside] else inside


def build_tree(html: str) -> Node:
    """The page's elements and texts; every tag that HTML lets authors leave out is there."""
    root = Node("html", {})
    stack = [root]
    opened = Counter()  # open elements by name, so that nothing is looked for in vain

    def open_(name: str, attributes: dict[str, str]) -> None:
        node = Node(name, attributes, stack[-1].inner)
        stack[-1].children.append(node)
        stack.append(node)
        opened[name] += 1

    def cut(depth: int) -> None:
        for node in stack[depth:]:
            opened[node.name] -= 1
        del stack[depth:]

    def close(names: set[str], limits: set[str]) -> None:
        """End the outermost open element of ``names`` above the nearest one of ``limits``."""
        left = sum(opened[name] for name in names)
        found, k = None, len(stack) - 1
        while left and k and stack[k].name not in limits:
            if stack[k].name in names:
                found = k
                left -= 1
            k -= 1
        if found is not None:
            cut(found)

    def close_nearest(name: str) -> None:
        """End the innermost open element called ``name``, if there is one inside the same cell."""
        if not opened[name]:
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name == name:
                return cut(k)
            if stack[k].name in ("td", "th", "caption") and name != "table":
                return None

    def text(data: str) -> None:
        if stack[-1].name == "head" and data.strip():
            cut(len(stack) - 1)
        if data:
            stack[-1].children.append(data)

    at, end = 0, len(html)
    while at < end:
        token = TOKEN.search(html, at)
        if token is None:
            text(unescape(html[at:]))
            break
        text(unescape(html[at : token.start()]))
        at = token.end()
        if not (name := (token["name"] or "").lower()):
            if stack[-1].inner and html.startswith("<![CDATA[", token.start()):
                closing = html.find("]]>", token.start())
                text(html[token.start() + 9 : closing if closing >= 0 else end])
                at = closing + 3 if closing >= 0 else end
            continue
        if token["slash"]:
            if name == "br" or name == "p" and not opened["p"]:
                open_(name, {})
                cut(len(stack) - 1)
            elif name not in ("html", "body"):
                close_nearest(name)
            continue
        if stack[-1].inner and name in ENDS_FOREIGN:
            depth = len(stack)
            while stack[depth - 1].inner:
                depth -= 1
            cut(depth)
        if name not in HEAD_ONLY and stack[-1].name == "head":
            cut(len(stack) - 1)
        if name == "html" or name == "body" and opened["body"]:
            continue
        if name in ENDS_PARAGRAPH:
            close({"p"}, {"table", "td", "th", "caption", "button", "object", "template", "html"})
        if name in ENDS:
            close(*ENDS[name])
        if name in ("td", "th") and stack[-1].name in ("table", "thead", "tbody", "tfoot"):
            open_("tr", {})
        attributes = {
            m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(token["rest"])
        } if token["rest"].strip(" /\n\t\r") else {}
        open_(name, attributes)
        foreign = stack[-1].inside or stack[-1].inner
        if name in VOID or (foreign or name == "path") and token["rest"].rstrip().endswith("/"):
            cut(len(stack) - 1)
        elif name in RAW and not foreign:
            closing = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            inside = html[at : closing.start()] if closing else html[at:]
            if name == "textarea":
                inside = inside.removeprefix("\r").removeprefix("\n")  # a line end that HTML takes no notice of
            stack[-1].children.append(unescape(inside) if name in ("textarea", "title") else inside)
            at = closing.end() if closing else end
            cut(len(stack) - 1)
    return root


def hiding(style: str) -> dict[str, str]:
    """The values that a style gives to the properties that hide; the last one counts, important ones before others."""
    found: dict[str, str] = {}
    important: dict[str, str] = {}
    if "display" in (style := CSS_COMMENT.sub(" ", style.lower())) or "visibility" in style:
        for declaration in DECLARATION.findall(style):
            name, _, value = declaration.partition(":")
            if (known := HIDES.get(name.strip())) is None:
                continue
            plain = IMPORTANT.sub("", value := value.strip())
            if known.fullmatch(plain):
                (found if plain == value else important)[name.strip()] = plain
    return found | important


def visible(node: Node, shown: bool) -> tuple[bool, bool]:
    """Whether ``node`` is there at all, and whether its own text shows where that of its parent does or does not."""
    a = node.attributes
    if node.name in UNSEEN or node.inside and node.name in UNSEEN_IN[node.inside]:
        return False, False
    if "hidden" in a or node.name == "dialog" and "open" not in a:
        return False, False
    style = hiding(a["style"]) if "style" in a else {}
    if node.inside == "svg" or node.name == "svg":
        style = {k: v for k in ("display", "visibility") if HIDES[k].fullmatch(v := a.get(k, "").strip().lower())} | style
    if style.get("display") == "none" or style.get("content-visibility") == "hidden":
        return False, False
    visibility = style.get("visibility", "inherit")
    if visibility == "collapse" and node.name in ("tr", "thead", "tbody", "tfoot"):
        return False, False
    return True, visibility in ("visible", "initial") or visibility not in ("hidden", "collapse") and shown


class Lines:
    """Lines in the making: collapses spaces, and turns requests for breaks and margins into line ends."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # a space is due before the next text
        self.blank = False  # a blank line is due before the next line
        self.mark = ""  # a bullet is due before the next text
        self.indent = 0

    def text(self, data: str) -> None:
        words = SPACES.sub(" ", data)
        if words[0] == " ":
            self.space = True
        if not (words := words.strip(" ")):
            return
        if not self.line:
            self.start()
        elif self.space:
            self.line.append(" ")
        self.line.append(words)
        self.space = data[-1] in " \t\n\r\f"

    def start(self) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        mark, self.mark = self.mark, ""
        self.line.append(" " * max(0, self.indent - len(mark)) + mark)

    def break_(self, blank: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip(" "))
            self.line = []
        self.space = False
        self.blank |= blank

    def forced_break(self) -> None:
        if self.line:
            self.break_()
        elif self.lines and self.lines[-1]:
            self.lines.append("")

    def literal(self, data: str) -> None:
        for i, part in enumerate(data.replace("\r\n", "\n").split("\n")):
            if i:
                if not self.line:
                    self.start()
                self.lines.append("".join(self.line))
                self.line = []
            if part:
                if not self.line:
                    self.start()
                self.line.append(part)

    def whole(self, lines: list[str]) -> None:
        for line in lines:
            self.start()
            self.line.append(line)
            self.break_()

    def result(self) -> list[str]:
        self.break_()
        return self.lines


#: The lines of a table cell, and how many columns and rows it goes over.
Cell = tuple[list[str], int, int]


def integer(text: str, default: int) -> int:
    """The number that an attribute begins with, as HTML reads it; ``default`` for none and for very large ones."""
    found = INTEGER.match(text)
    return int(found[1]) if found else default


def render(root: Node) -> str:
    """All visible text below ``root``. Goes through the tree with its own stack, so depth does not matter."""
    outs = [Lines()]
    lists: list[list] = []
    tables: list[list[list[Cell]]] = []
    pre = 0
    # shown: by visibility; drawn: in a drawing only what stands in its text elements
    todo: list[tuple[Node | str, bool, bool, bool]] = [(root, False, True, True)]
    while todo:
        node, leaving, shown, drawn = todo.pop()
        out = outs[-1]
        if isinstance(node, str):
            if not (shown and drawn):
                continue
            if pre:
                out.literal(node)
            elif node:
                out.text(node)
            continue
        name = node.name
        if not leaving:
            there, shown = visible(node, shown)
            if not there:
                continue
            if name == "br":
                out.forced_break() if shown else out.break_()
                continue
            if name == "img":
                if shown and (alt := node.attributes.get("alt", "").strip()):
                    out.text(alt)
                continue
            if name == "input":
                if shown and node.attributes.get("type", "").lower() in ("submit", "button", "reset") and (value := node.attributes.get("value")):
                    out.text(value)
                continue
            todo.append((node, True, shown, drawn))
            if name in BLOCKS or node.inside == "svg" and name in ("text", "foreignobject"):
                out.break_(blank=name in MARGINS and not (name in LISTS and lists))
            if name in LISTS:
                lists.append([name == "ol", integer(node.attributes.get("start", ""), 1)])
                out.indent += 2
            elif name == "li":
                numbered = lists[-1] if lists else [False, 1]
                out.mark = (f"{numbered[1]}. " if numbered[0] else "- ") if shown else ""
                numbered[1] += 1
                out.indent += 2
            elif name == "dd":
                out.indent += 4
            elif name == "blockquote":
                out.indent += 2
            elif name in ("pre", "xmp"):
                pre += 1
            elif name == "textarea":
                if out.space and out.line:
                    out.line.append(" ")
                out.space = False
                pre += 1
            elif name == "table":
                tables.append([])
            elif name == "tr" and tables:
                tables[-1].append([])
            elif name in ("td", "th") and tables:
                outs.append(Lines())
            elif name in ("td", "th"):
                out.space = True
            children = node.children
            if name in ("optgroup", "option") and (label := node.attributes.get("label", "").strip()):
                if name == "option":
                    children = [label]
                elif shown:
                    out.text(label)
                    out.break_()
            elif node.inside == "math" and name in APART:
                children = [part for child in children for part in (child, " ")]
            if node.inner == "svg":
                drawn = name == "text" or drawn and name != "svg"
            else:
                drawn = True
            todo.extend((child, False, shown, drawn) for child in reversed(children))
            continue
        if name in LISTS:
            lists.pop()
            out.indent -= 2
        elif name == "li":
            out.indent -= 2
            out.break_()
            out.mark = ""
        elif name == "dd":
            out.indent -= 4
        elif name == "blockquote":
            out.indent -= 2
        elif name in ("pre", "xmp", "textarea"):
            pre -= 1
        elif name in ("td", "th") and len(outs) > 1:
            cell = outs.pop().result()
            if not tables[-1]:
                tables[-1].append([])
            across, down = (integer(node.attributes.get(a, ""), 1) for a in ("colspan", "rowspan"))
            tables[-1][-1].append((cell, max(1, across), ROWS if down == 0 else max(1, down)))
        elif name == "table" and tables:
            out.whole(aligned(tables.pop()))
        if name in BLOCKS or node.inside == "svg" and name in ("text", "foreignobject"):
            out.break_(blank=name in MARGINS and not (name in LISTS and lists))
    return "\n".join(outs[0].result()).strip("\n")


def grid(rows: list[list[Cell]]) -> list[list[list[str]]]:
    """Every row's cells by column, with nothing where a cell from the left or from above stands."""
    taken: dict[int, int] = {}  # column -> rows that a cell from above still covers
    out = []
    for row in rows:
        placed: list[list[str]] = []
        below = {c: n - 1 for c, n in taken.items() if n > 1}

        def skip() -> None:
            while len(placed) in taken:
                placed.append([])

        for cell, across, down in row:
            skip()
            across = min(across, max(1, COLUMNS - len(placed)))
            if down > 1 and len(placed) < COLUMNS:
                below.update(dict.fromkeys(range(len(placed), len(placed) + across), down - 1))
            placed += [cell, *[[]] * (across - 1)]
        taken = below
        out.append(placed)
    return out


def aligned(rows: list[list[Cell]]) -> list[str]:
    """Table rows as lines, each column as wide as its widest line, two spaces apart.

    Lines of more than ``WIDEST`` characters do not count for the width and run over it. A table that padding would
    make many times longer is given without padding.
    """
    cells = grid(rows)
    widths: list[int] = []
    for row in cells:
        widths.extend([0] * (len(row) - len(widths)))
        for i, cell in enumerate(row):
            widths[i] = max([widths[i], *(len(line) for line in cell if len(line) <= WIDEST)])
    up_to = [0, *accumulate(w + 2 for w in widths)]
    heights = [max((len(cell) for cell in row), default=0) for row in cells]
    plain = sum(len(line) + 2 for row in cells for cell in row for line in cell)
    padded = sum(n * up_to[max((i + 1 for i, cell in enumerate(row) if cell), default=0)] for n, row in zip(heights, cells, strict=True))
    if padded > PADDING * plain + ALLOWANCE:
        widths = [0] * len(widths)
        cells = [[cell for cell in row if cell] for row in cells]
    lines = []
    for n, row in zip(heights, cells, strict=True):
        for k in range(n):
            parts = [(cell[k] if k < len(cell) else "").ljust(w) for cell, w in zip(row, widths, strict=False)]
            lines.append("  ".join(parts).rstrip(" "))
    return lines


def page_text(html: str) -> str:
    return render(build_tree(html))


def visible_text(html: Column) -> Column:
    """The visible text of an HTML column; NULL and '' give ''."""

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([page_text(p) for p in pages], dtype=object)

    return extract(F.coalesce(html, F.lit("")))


def extract_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text``, the visible text of ``html``, in place of the latter.

    Visibility is what elements and their attributes say, ``style`` among them; rules of style sheets, the page's own
    ones as well, are not read, so what only they hide is kept.

    Every row stays, also repeated ones and those without id; an empty table gives no rows; a column ``text``
    that was there is replaced. Pages are rendered row by row, whole, without a shuffle.
    """
    ship_package(pages.sparkSession)
    return without(pages.withColumn("__text", visible_text(F.col("html"))), ["html", "text"]).withColumnRenamed("__text", "text")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages")).select("page_id", "url", "text")
