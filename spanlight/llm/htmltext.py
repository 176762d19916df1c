"""HTML to text as it is laid out: a tree with implied tags, visibility rules, block spacing, lists and aligned tables."""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: What HTML says of its elements (fixed values).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style xmp iframe noembed noframes textarea title".split())
HIDDEN = set("head script style template iframe noembed noframes object audio video canvas datalist title link meta param source track area base col colgroup embed".split())
BLOCK = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table ul caption tr td th thead tbody tfoot".split()
)
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol menu dir dl pre blockquote figure table hr".split())
CLOSES_P = BLOCK - set("body html caption tr td th thead tbody tfoot legend".split())
#: Start tag -> (elements it ends, elements that stop the search).
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "caption": ({"caption"}, {"table"}),
}
#: What svg and math hold besides what they show.
UNSHOWN = set("desc defs metadata symbol clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml".split())
#: Inputs that show no text of their own.
NO_TEXT = set("hidden checkbox radio file image password range color".split())
#: An end tag is not looked for beyond these.
SCOPE = {"table", "td", "th", "caption", "html", "body"}
#: Deeper elements become siblings, as in browsers (at a lesser depth).
MAX_DEPTH = 150
SPACE = " \t\n\r\f"

_TOKEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>", re.DOTALL)
_TAG_START = re.compile(r"</?[A-Za-z]")
_MARK = re.compile("[>\"']")
_ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
_NAME_END = re.compile(r"[\s/>]")


class Node:
    """shown is False where visibility hides the node's own text and marker, but not its kids."""

    __slots__ = ("attrs", "kids", "shown", "tag")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None) -> None:
        self.tag, self.attrs, self.kids, self.shown = tag, attrs or {}, [], True


class Tokens:
    """Comments, declarations and tags in turn, in time linear in the page whatever stays open.

    A tag that never closes is text. Whether one closes depends only on the quotes
    and `>` from its name's end on. So the first failure makes a list of those, and
    those from which no tag closes are remembered: each is walked once.
    """

    def __init__(self, html: str) -> None:
        self.html, self.at = html, 0
        self.last = html.rfind(">")
        self.marks: list[int] | None = None
        self.dead: set[int] = set()
        self.name_end = -1  # the first end of a name at or after what was asked for last

    def next(self, at: int) -> tuple[int, int, str | None, str | None, str] | None:
        """(start, end, slash, name, attributes) of the first token from at on; name is None for what isn't a tag."""
        html = self.html
        while (i := html.find("<", at)) >= 0:
            at = i + 1
            if html.startswith("<!--", i):
                end = html.find("-->", i + 4)
                return i, end + 3 if end >= 0 else len(html), None, None, ""
            if i > self.last:
                continue
            if html.startswith(("<!", "<?"), i):
                return i, html.index(">", i) + 1, None, None, ""
            if self.marks is None:
                if m := _TOKEN.match(html, i):
                    return i, m.end(), m[1], m[2], m[3]
                if _TAG_START.match(html, i):
                    self.marks = [m.start() for m in _MARK.finditer(html, i)]
            if self.marks is not None and _TAG_START.match(html, i) and (found := self._tag(i)):
                return found
        return None

    def _tag(self, i: int) -> tuple[int, int, str, str, str] | None:
        html, marks = self.html, self.marks
        if self.name_end < i + 2:
            m = _NAME_END.search(html, i + 2)
            self.name_end = m.start() if m else len(html)
        if self.name_end == len(html):
            return None
        walked, k = [], bisect_left(marks, self.name_end)
        while k < len(marks) and k not in self.dead:
            walked.append(k)
            p = marks[k]
            if html[p] == ">":
                m = _NAME.match(html, i)
                return i, p + 1, m[1], m[2], html[m.end() : p]
            close = html.find(html[p], p + 1)
            if close < 0:
                break
            k = bisect_left(marks, close + 1)
        self.dead.update(walked)
        return None


def attributes(said: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(said):
        out.setdefault(m[1].lower(), unescape(next((g for g in m.groups()[1:] if g is not None), "")))
    return out


def parse(html: str) -> Node:
    """The tree of a document or fragment. Tags may be missing, crossed or unknown; text is kept wherever it stands."""
    root = Node("html")
    stack = [root]

    def text(s: str) -> None:
        if s:
            stack[-1].kids.append(unescape(s))

    def close(tags: set[str], stop: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                del stack[i:]
            elif stack[i].tag in stop:
                return

    at, n, tokens = 0, len(html), Tokens(html)
    while at < n:
        m = tokens.next(at)
        if not m:
            text(html[at:])
            break
        start, end, slash, name, said = m
        text(html[at:start])
        at = end
        if name is None:
            continue
        tag = name.lower()
        if slash:
            if tag == "br":
                stack[-1].kids.append(Node("br"))
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in SCOPE and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body", "html"):
                    break
            continue
        if tag in ("html", "body"):
            if tag == "body":
                close({"head"}, set())
            continue
        if stack[-1].tag == "head" and tag not in HIDDEN | {"noscript"}:
            stack.pop()
        if tag in CLOSES_P:
            close({"p"}, SCOPE)
        if tag in IMPLIED:
            close(*IMPLIED[tag])
        node = Node(tag, attributes(said) if said.strip() else None)
        stack[-1].kids.append(node)
        if tag in RAW and not (said.rstrip().endswith("/") and any(n.tag in ("svg", "math") for n in stack)):
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(html, at)
            node.kids.append(html[at : end.start()] if end else html[at:])
            at = end.end() if end else n
        elif tag not in VOID and not said.rstrip().endswith("/") and len(stack) < MAX_DEPTH:
            stack.append(node)
    return root


_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_COMPOUND = re.compile(r"(\*|[A-Za-z][\w-]*)?((?:[.#][\w-]+)*)\Z")
#: What hides by visibility, and elements that show something without text of their own (fixed values).
UNSEEN = {"hidden", "collapse"}
REPLACED = {"input", "textarea", "select"}


def declared(css: str) -> dict[str, tuple[bool, str]]:
    """display and visibility of a block of declarations as (important, value); the later one counts, but important ones first."""
    out: dict[str, tuple[bool, str]] = {}
    for one in css.split(";"):
        name, colon, value = one.partition(":")
        name, value = name.strip().lower(), value.strip().lower()
        if colon and name in ("display", "visibility"):
            value, mark, rest = value.partition("!")
            new = (mark == "!" and rest.strip() == "important", value.strip())
            if re.fullmatch(r"[a-z -]+", new[1]) and (name not in out or new[0] >= out[name][0]):
                out[name] = new
    return out


class Styles:
    """What the page's style elements hide, by simple selectors: a tag, classes and an id, or several with commas.

    Selectors with combinators, attributes or pseudo-classes are left alone, as are
    rules for other media. Important rules go first, then the element's own style,
    then the more specific rule, then the later one. Rules are found by id, class or
    tag, so a node meets only those that name something of its own.
    """

    def __init__(self, root: Node) -> None:
        self.rules: dict[str, list[tuple[tuple, str, frozenset, str | None, dict]]] = {}
        n = 0
        for css in _style_texts(root):
            css = _plain_rules(re.sub(r"/\*.*?(?:\*/|\Z)", "", css, flags=re.DOTALL))
            for m in _RULE.finditer(css):
                if says := declared(m[2]):
                    for one in m[1].split(","):
                        if c := _COMPOUND.match(one.strip()) if one.strip() else None:
                            ids = re.findall(r"#([\w-]+)", c[2])
                            classes = frozenset(re.findall(r"\.([\w-]+)", c[2]))
                            tag = (c[1] or "*").lower()
                            if len(ids) < 2:
                                n += 1
                                key = f"#{ids[0]}" if ids else f".{min(classes)}" if classes else tag
                                rule = (((len(ids), len(classes), tag != "*"), n), tag, classes, ids[0] if ids else None, says)
                                self.rules.setdefault(key, []).append(rule)

    def of(self, node: Node) -> dict[str, str]:
        """The node's own display and visibility, where something says them."""
        best: dict[str, tuple] = {}

        def offer(says: dict, inline: bool, weight: tuple) -> None:
            for name, (important, value) in says.items():
                rank = (important, inline, weight, value)
                if name not in best or rank[:3] >= best[name][:3]:
                    best[name] = rank

        if self.rules:
            own = frozenset(node.attrs["class"].split()) if "class" in node.attrs else frozenset()
            id_ = node.attrs.get("id")
            for key in ("*", node.tag, *[f".{c}" for c in own], *([f"#{id_}"] if id_ is not None else [])):
                for weight, tag, classes, wanted, says in self.rules.get(key, ()):
                    if tag in ("*", node.tag) and classes <= own and wanted in (None, id_):
                        offer(says, False, weight)
        if "style" in node.attrs:
            offer(declared(node.attrs["style"]), True, ())
        return {name: rank[3] for name, rank in best.items()}


def _style_texts(root: Node) -> Iterator[str]:
    """Contents of all style elements; text that stands in noscript or template doesn't count."""
    stack = [root]
    while stack:
        node = stack.pop()
        if node.tag == "style" and node.attrs.get("media", "all").strip().lower() in ("", "all", "screen"):
            yield "".join(k for k in node.kids if isinstance(k, str))
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node) and k.tag not in ("template", "noscript"))


def _plain_rules(css: str) -> str:
    """The rules outside any at-rule's block."""
    out, depth, skip, at = [], 0, False, 0
    for m in re.finditer(r"[{}]", css):
        if m[0] == "{":
            if depth == 0:
                start = css.rfind(";", at, m.start()) + 1 or at
                skip = css[start : m.start()].strip().startswith("@")
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                if not skip:
                    out.append(css[start : m.end()])
                at = m.end()
    return "".join(out)


def hide_by_style(root: Node) -> None:
    """Marks what is not displayed, and takes out the text that visibility hides.

    display: none takes an element with all it holds. visibility is inherited and
    may be turned on again within; a table cell keeps its column though its text is
    hidden, a collapsed row goes. A details element that isn't open shows its summary.
    """
    styles = Styles(root)

    def cascade(node: Node, seen: bool) -> bool:
        """Whether anything in the node is shown."""
        kids, some = [], False
        if node.tag == "details" and "open" not in node.attrs:
            node.kids = [k for k in node.kids if isinstance(k, Node) and k.tag == "summary"][:1]
        for kid in node.kids:
            if isinstance(kid, str):
                if seen:
                    kids.append(kid)
                    some = some or not kid.isspace()
                continue
            says = styles.of(kid)
            own = says.get("visibility")
            kid_seen = seen if own is None or own == "inherit" else own not in UNSEEN
            if says.get("display") == "none" or (own == "collapse" and kid.tag in ("tr", "thead", "tbody", "tfoot")):
                kid.attrs["hidden"] = ""
            kid.shown = kid_seen
            inner = cascade(kid, kid_seen) or kid_seen
            if (not inner and kid.tag not in ("td", "th", "br")) or (not kid_seen and kid.tag in REPLACED):
                kid.attrs["hidden"] = ""
            some = some or inner
            kids.append(kid)
        node.kids = kids
        return some

    cascade(root, True)


def visible(node: Node) -> bool:
    a = node.attrs
    return node.tag not in HIDDEN and "hidden" not in a and not (node.tag == "input" and a.get("type", "").lower() == "hidden") and not (node.tag == "dialog" and "open" not in a)


def width(s: str) -> int:
    """Columns of a monospaced line: wide characters take two, combining ones none."""
    return len(s) if s.isascii() else sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


class Page:
    """Lines as they are laid out. Margins collapse; white space does outside `pre`."""

    def __init__(self, in_list: bool = False) -> None:
        self.lines: list[str] = []
        self.line = ""
        self.margin = False
        self.in_list = in_list  # lists in lists have no margins

    def write(self, s: str, pre: bool) -> None:
        if pre:
            first, *rest = s.split("\n")
            self.line += first
            for r in rest:
                self.end_line(True)
                self.line = r
            return
        words = " ".join(s.translate(_TO_SPACE).split(" ")) if s.strip(SPACE) else " "
        s = _RUN.sub(" ", words)
        if not self.line or self.line.endswith(" "):
            s = s.lstrip(" ")
        self.line += s

    def end_line(self, even_empty: bool = False) -> None:
        line = self.line.rstrip(" \t\r")
        self.line = ""
        if line or even_empty:
            if self.margin and self.lines:
                self.lines.append("")
            self.margin = False
            self.lines.append(line)

    def space(self) -> None:
        self.end_line()
        self.margin = bool(self.lines)

    def place(self, lines: list[str], lead: str) -> None:
        """Lays out the lines of a nested block after lead; the further ones are indented as far."""
        for i, x in enumerate(lines):
            self.line = (lead if i == 0 else " " * len(lead)) + x if x else ""
            self.end_line(True)


_GAP = Node("option")
_GAP.kids = [" "]
_TO_SPACE = dict.fromkeys(map(ord, "\t\n\r\f"), " ")
_RUN = re.compile(" +")


def render(node: Node, page: Page, pre: bool = False) -> None:
    for kid in node.kids:
        if isinstance(kid, str):
            page.write(kid, pre)
        elif kid.tag == "br":
            page.end_line(True)
        elif visible(kid):
            tag = kid.tag
            if tag == "table":
                page.space()
                page.place(table_lines(kid), "")
                page.space()
            elif tag in ("ul", "ol", "menu", "dir"):
                margin = page.end_line if page.in_list else page.space
                margin()
                list_lines(kid, page)
                margin()
            elif tag in BLOCK:
                page.space() if tag in SPACED else page.end_line()
                if tag in ("dd", "blockquote"):
                    own = Page()
                    render(kid, own, pre)
                    own.end_line()
                    page.place(own.lines, "  ")
                else:
                    render(kid, page, pre or tag == "pre")
                page.space() if tag in SPACED else page.end_line()
            elif tag == "input":
                page.write(kid.attrs.get("value", "") if kid.attrs.get("type", "").lower() not in NO_TEXT else "", False)
            elif tag == "textarea":
                page.write(unescape("".join(kid.kids).removeprefix("\n")), True)
            elif tag == "select":
                for option in shown_options(kid):
                    page.write(option.attrs.get("label") or own_text(option), False)
            elif tag in ("svg", "math"):
                foreign(kid, page, tag)
            else:
                render(kid, page, pre)


def own_text(node: Node) -> str:
    return "".join(k if isinstance(k, str) else own_text(k) for k in node.kids if isinstance(k, str) or visible(k))


def shown_options(select: Node) -> list[Node]:
    """The selected options, else the first; all of a list box (multiple, or a size above 1), separated by white space."""

    def options(node: Node) -> Iterator[Node]:
        for kid in node.kids:
            if isinstance(kid, Node) and visible(kid):
                if kid.tag == "option":
                    yield kid
                else:
                    yield from options(kid)

    every = list(options(select))
    size = select.attrs.get("size", "")
    if "multiple" in select.attrs or (size.isdecimal() and size.strip("0") not in ("", "1")):
        return [x for o in every for x in (o, _GAP)][:-1]
    return [o for o in every if "selected" in o.attrs][-1:] or every[:1]


def foreign(node: Node, page: Page, kind: str) -> None:
    """The text of svg and math in line; in svg a text element is a word of its own, and only text elements show text."""
    for kid in node.kids:
        if isinstance(kid, str):
            if kind != "svg":
                page.write(kid, False)
        elif kid.tag in UNSHOWN or not visible(kid):
            continue
        elif kind == "svg" and kid.tag == "text":
            page.write(" ", False)
            render(kid, page)
        elif kind == "svg" and kid.tag == "foreignobject":
            page.end_line()
            render(kid, page)
            page.end_line()
        else:
            foreign(kid, page, kind)


def list_lines(node: Node, page: Page) -> None:
    ordered = node.tag == "ol"
    whole = lambda a: int(a) if re.fullmatch(r"\s*[-+]?[0-9]{1,9}\s*", a) else None
    step = -1 if ordered and "reversed" in node.attrs else 1
    n = whole(node.attrs.get("start", ""))
    if n is None:
        n = 1 if step > 0 else sum(isinstance(k, Node) and k.tag == "li" and visible(k) for k in node.kids)
    for kid in node.kids:
        if isinstance(kid, str):
            page.write(kid, False)
            continue
        if not visible(kid):
            continue
        page.end_line()
        own = Page(in_list=True)
        render(kid, own) if kid.tag in ("li", "ul", "ol") else render(_wrap(kid), own)
        own.end_line()
        while own.lines and not own.lines[0]:  # the marker stands before the first text
            del own.lines[0]
        if kid.tag == "li":
            said = whole(kid.attrs.get("value", ""))
            n = n if said is None else said
            page.place(own.lines or [""], "  " if not kid.shown else f"{n}. " if ordered else "- ")
            n += step
        else:
            page.place(own.lines, "  ")
    page.end_line()


def _wrap(node: Node) -> Node:
    out = Node("div")
    out.kids = [node]
    return out


def table_rows(node: Node) -> Iterator[list[Node]]:
    for kid in node.kids:
        if isinstance(kid, str) or not visible(kid):
            continue
        if kid.tag == "tr":
            yield [c for c in kid.kids if isinstance(c, Node) and c.tag in ("td", "th") and visible(c)]
        elif kid.tag in ("thead", "tbody", "tfoot"):
            yield from table_rows(kid)


def stray(node: Node) -> list:
    """What stands in a table outside its cells: captions and misplaced content, laid out before the rows as browsers do."""
    out: list = []
    for kid in node.kids:
        if isinstance(kid, str):
            if kid.strip(SPACE):
                out.append(kid)
        elif kid.tag in ("thead", "tbody", "tfoot", "tr"):
            if visible(kid):
                out += stray(kid)
        elif kid.tag not in ("td", "th") and visible(kid):
            out.append(kid)
        elif node.tag != "tr" and visible(kid):
            out.append(kid)
    return out


def table_lines(node: Node) -> list[str]:
    """Rows with their cells in columns of even width, two spaces apart; a cell of several lines takes several."""
    before = Page()
    holder = Node("div")
    holder.kids = stray(node)
    render(holder, before)
    before.end_line()
    rows = list(table_rows(node))
    grid: list[dict[int, list[str]]] = []
    taken: dict[int, int] = {}  # column -> further rows that a cell from above takes there
    for row in rows:
        cells: dict[int, list[str]] = {}
        k = 0
        for cell in row:
            while taken.get(k, 0):
                k += 1
            own = Page()
            render(cell, own)
            own.end_line()
            cells[k] = own.lines or [""]
            wide, high = _span(cell, "colspan"), _span(cell, "rowspan")
            for j in range(k, k + wide):
                taken[j] = max(taken.get(j, 0), high)
            k += wide
        grid.append(cells)
        taken = {k: n - 1 for k, n in taken.items() if n > 1}
    # Columns in which no cell begins have no width and no gap.
    used = sorted({k for cells in grid for k in cells})
    wide_of = {k: max(width(x) for cells in grid if k in cells for x in cells[k]) for k in used}
    out = list(before.lines)
    for cells in grid:
        last = max(cells, default=-1)
        for i in range(max((len(c) for c in cells.values()), default=0)):
            texts = [(cells[k][i] if k in cells and i < len(cells[k]) else "", wide_of[k]) for k in used if k <= last]
            out.append("  ".join(x + " " * (w - width(x)) for x, w in texts).rstrip(" "))
    return out


#: The greatest spans that HTML allows (fixed values).
SPANS = {"colspan": 1000, "rowspan": 65534}


def _span(cell: Node, name: str) -> int:
    said = cell.attrs.get(name, "1").strip()
    n = int(said) if said.isascii() and said.isdigit() and len(said) < 9 else 1
    return min(SPANS[name], n) or (SPANS[name] if name == "rowspan" else 1)  # rowspan 0: down to the end


def text_of(html: str | None) -> str:
    """All visible text of a page; empty for null, empty or invisible pages."""
    if not html:
        return ""
    root, page = parse(html), Page()
    hide_by_style(root)
    render(root, page)
    page.end_line()
    return "\n".join(page.lines).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, html) -> page_id, text, n_lines; one row for each row, null ids and repeated rows too. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 128) for i in range(0, batch.num_rows, 128)):
                texts = [text_of(h) for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64())], ["page_id", "text", "n_lines"])

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, "page_id long, text string, n_lines long")


def op9_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
