"""Layout-aware rendering of HTML: all visible text, with blocks, lists and tables as they would look.

A tree builder closes what HTML's rules imply (paragraphs at blocks, items, cells and rows at their like, the head
at what may not stand in it, all that is open inside an element at its end tag; end tags of nothing open are
ignored), opens rows that cells imply, and drops what is not shown: the head, scripts and styles, templates, closed
dialogs, and elements hidden by attribute, inline style, or a rule of a style element for a tag, class or id; what is
made visible again in an element of hidden visibility is shown. Rendering collapses white space outside `pre`, starts
blocks on lines of their own, leaves a blank line around paragraphs, headings, lists and tables, numbers and indents
list items, and pads table cells to the width of their column, also of cells that span several.

Time and memory grow with the page: tags are scanned once, and trees are built and laid out with stacks of our own.
As browsers let at most 512 elements stand within each other, so lists, quotes and tables are laid out that deep, and
further ones are plain blocks, so that a page of nothing but list tags is no page of its length squared. If a tag's quotes run to the end
of the page, from there on tags end at the next ">" whatever the quotes; a tag without any ">" is text.

Null and empty pages render as empty text. Markup that is not closed runs to the end; pages of any length are
rendered whole; repeated pages give a row each; an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link iframe object canvas audio video datalist noembed noframes desc defs metadata symbol clippath annotation annotation-xml".split())
BLOCKS = frozenset("address article aside blockquote body caption center details dialog div dd dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol optgroup option p pre section summary table tbody td text tfoot th thead tr ul".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure".split())
CLOSES_P = BLOCKS - {"body", "html", "caption", "option", "optgroup", "tbody", "td", "text", "tfoot", "th", "thead", "tr"}
#: What a start tag ends if it is open, and the elements behind which it doesn't look.
ENDS = {"li": ({"li"}, {"ul", "ol"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"table"}), "th": ({"td", "th"}, {"table"}), "tr": ({"tr", "td", "th"}, {"table"}), "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "option": ({"option"}, {"select"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, set())}
#: What may stand in an open head, and what holds the cells and rows of a table.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
SECTIONS = frozenset("thead tbody tfoot".split())
CELLS = frozenset("td th".split())
#: How many lists, quotes and tables within each other are laid out (as in browsers), and the most columns of a cell.
DEEP, SPAN = 512, 1000
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
REST = re.compile(r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
RAW_END = {tag: re.compile(rf"</{tag}[\s/>]", re.I) for tag in RAW}
DISPLAY = re.compile(r"(?<![\w-])display\s*:\s*([a-z-]+)", re.I)
VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*([a-z]+)", re.I)
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
SELECTOR = re.compile(r"([a-zA-Z][\w-]*|\*)?([.#][\w-]+)?")
SPACES = re.compile(r"[ \t\n\r\f]+")


class Element:
    __slots__ = ("attributes", "children", "shown", "tag", "visible")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.shown, self.visible = True, None


def rules(sheet: str) -> Iterator[tuple[str, tuple[bool | None, bool | None]]]:
    """(selector, (shown, visible)) of a sheet's rules for one tag, class or id outside of at-rules, in order."""
    depth, start, selector = 0, 0, ""
    sheet = COMMENT.sub(" ", sheet)
    for m in re.finditer(r"[{};]", sheet):
        sign = m.group()
        if sign == "{":
            depth += 1
            if depth == 1:
                selector, start = sheet[start : m.start()].strip(), m.end()
        elif sign == "}":
            depth = max(0, depth - 1)
            if not depth:
                if not selector.startswith("@"):
                    found = styled(sheet[start : m.start()])
                    for one in selector.split(","):
                        if found != (None, None) and SELECTOR.fullmatch(one.strip()):
                            yield one.strip(), found
                start = m.end()
        elif not depth:
            start = m.end()


def styled(style: str) -> tuple[bool | None, bool | None]:
    """Whether declarations show an element, and make it visible; None where they don't say."""
    display, visibility = DISPLAY.findall(style), VISIBILITY.findall(style)
    return display[-1].lower() != "none" if display else None, visibility[-1].lower() not in ("hidden", "collapse") if visibility else None


def _resolve(root: Element, sheets: list[str]) -> None:
    """Sets shown and visible of all elements; of rules that fit, the last one that says so, then the inline style."""
    by: dict[str, list] = defaultdict(list)
    for i, (selector, found) in enumerate(x for sheet in sheets for x in rules(sheet)):
        m = SELECTOR.fullmatch(selector)
        by[m[2] or (m[1] or "*").lower()].append((i, (m[1] or "*").lower(), found))
    todo = [root]
    while todo:
        e = todo.pop()
        a = e.attributes
        e.shown = e.tag not in UNSEEN and "hidden" not in a and not (e.tag == "input" and a.get("type", "").lower() == "hidden") and not (e.tag == "dialog" and "open" not in a)
        found = []
        if by:
            for key in (e.tag, "*", *(f".{c}" for c in a.get("class", "").split()), f"#{a.get('id', '')}"):
                found += [x for x in by.get(key, ()) if x[1] in ("*", e.tag)]
            found = [x[2] for x in sorted(found, key=lambda x: x[0])]
        if "style" in a:
            found.append(styled(a["style"]))
        for shown, visible in found:
            if shown is not None and e.tag not in UNSEEN:
                e.shown = shown
            e.visible = e.visible if visible is None else visible
        todo.extend(c for c in e.children if isinstance(c, Element))


def parse(page: str) -> Element:
    """The tree of a page; texts are strings among the children, with character references resolved."""
    root, sheets = Element("html", {}), []
    stack, at, size, strict = [root], 0, len(page), True
    places: dict[str, list[int]] = defaultdict(list)  # of open elements, by tag

    def cut(i: int) -> None:
        while len(stack) > i:
            places[stack.pop().tag].pop()

    def opened(element: Element) -> None:
        places[element.tag].append(len(stack))
        stack.append(element)

    def close(tags: set[str], walls: set[str]) -> None:
        wall = max((places[t][-1] for t in walls if places[t]), default=0)
        least = min((i for t in tags for i in _above(places[t], wall)), default=0)
        if least:
            cut(least)

    def text(value: str) -> None:
        value = html.unescape(value)
        if stack[-1].tag == "head" and SPACES.sub("", value):
            cut(len(stack) - 1)
        stack[-1].children.append(value)

    start = 0  # of text that is not in the tree yet
    while (at := page.find("<", at)) >= 0:
        begin, m = at, None
        if page.startswith("<!--", at):
            at = size if (end := page.find("-->", at + 4)) < 0 else end + 3
        elif page.startswith(("<!", "<?"), at):
            at = size if (end := page.find(">", at)) < 0 else end + 1
        elif m := NAME.match(page, at):
            rest = REST.match(page, m.end()) if strict else None
            if strict and not rest:
                strict = False
            end = rest.end() - 1 if rest else page.find(">", m.end())
            if end < 0:
                break
            attributes, at = page[m.end() : end], end + 1
        else:
            at += 1
            continue
        if begin > start:
            text(page[start:begin])
        start = at
        if not m:
            continue
        tag = m[2].lower()
        if m[1]:
            if places[tag]:
                cut(places[tag][-1])
            elif tag == "br":
                stack[-1].children.append(Element("br", {}))
            continue
        if tag in CLOSES_P:
            close({"p"}, {"table", "td", "th", "button"})
        if tag in ENDS:
            close(*ENDS[tag])
        if stack[-1].tag == "head" and tag not in HEAD:
            cut(len(stack) - 1)
        if tag in CELLS and stack[-1].tag in SECTIONS | {"table"}:
            row = Element("tr", {})
            stack[-1].children.append(row)
            opened(row)
        element = Element(tag, {k.lower(): html.unescape(x or y or z) for k, x, y, z in reversed(ATTRIBUTE.findall(attributes))} if attributes.strip(" /") else {})
        stack[-1].children.append(element)
        if tag in RAW:
            found = RAW_END[tag].search(page, at)
            content = page[at : found.start() if found else size]
            element.children.append(html.unescape(content) if tag in ("textarea", "title") else content)
            if tag == "style":
                sheets.append(content)
            at = size if not found else size if (end := page.find(">", found.start())) < 0 else end + 1
            start = at
        elif tag not in VOID and (tag in BLOCKS or not attributes.rstrip().endswith("/")):
            opened(element)
    if start < size:
        text(page[start:])
    _resolve(root, sheets)
    return root


def _above(places: list[int], wall: int) -> Iterator[int]:
    for i in reversed(places):
        if i <= wall:
            return
        yield i


class Lines:
    """Lines of text as they are laid out; a gap is at most one blank line. todo: what is still to be laid out.

    Lines inside another's (above) go to the same place, each once: the first behind what stands before it there and a
    mark, the others behind that and `then`."""

    def __init__(self, depth: int = 0, done: Callable[[list[str]], None] | None = None, above: Lines | None = None, mark: str = "", then: str = "") -> None:
        self.lines: list[str] = above.lines if above else []
        self.parts: list[str] = []
        self.gap, self.open, self.depth, self.done = False, False, depth, done
        self.above, self.mark, self.rest, self.some = above, mark, above.rest + then if above else "", False
        self.todo: list[tuple | Callable[[], None]] = []

    def add(self, text: str) -> None:
        text = SPACES.sub(" ", text)
        if not self.open:
            text = text.lstrip(" ")
        if text:
            self.parts.append(text)
            self.open = not text.endswith(" ")

    def raw(self, text: str) -> None:
        first, *rest = text.split("\n")
        self.parts.append(first)
        for line in rest:
            self.put("".join(self.parts))
            self.parts = [line]
        self.open = True

    def end(self, gap: bool = False) -> None:
        if self.parts and (line := "".join(self.parts).rstrip(" ")):
            self.put(line)
        self.parts, self.open = [], False
        self.gap = self.gap or gap

    def put(self, line: str) -> None:
        begun, at = [], self
        while at.above and not at.some:
            begun.append(at)
            at = at.above
        if at.gap and at.some:
            self.lines.append(at.rest.rstrip())
        before, at.gap, at.some = at.rest if at.some else "", False, True
        for inner in reversed(begun):
            before, inner.gap, inner.some = before + inner.mark, False, True
        self.lines.append((before + line).rstrip() if self.above else line)


def _parts(element: Element, inside: frozenset[str], wanted: frozenset[str]) -> tuple[list[Element], list[object]]:
    """The wanted elements of a table or row, in what may hold them or in elements that may not stand there, and
    all other children, in order; of an element around wanted ones, the children are taken one by one."""
    found: list[Element] = []
    loose: list[object] = []
    around, todo = _around(element, wanted), list(reversed(element.children))
    while todo:
        child = todo.pop()
        if not isinstance(child, Element):
            loose.append(child)
        elif not child.shown:
            continue
        elif child.tag in wanted:
            found.append(child)
        elif child.tag in inside or id(child) in around:
            todo.extend(reversed(child.children))
        else:
            loose.append(child)
    return found, loose


def _around(element: Element, wanted: frozenset[str]) -> set[int]:
    """The ids of the shown elements in this one that hold a wanted one, outside tables within it."""
    around: set[int] = set()
    todo = [(c, None) for c in element.children if isinstance(c, Element)]
    while todo:
        path = todo.pop()
        now, above = path
        if now.tag in wanted:
            while above and id(above[0]) not in around:
                around.add(id(above[0]))
                above = above[1]
        elif now.tag not in ("table", "caption") and now.shown:
            todo.extend((c, path) for c in now.children if isinstance(c, Element))
    return around


def _whole(value: str, least: int, most: int, otherwise: int) -> int:
    return max(least, min(most, int(value))) if re.fullmatch(r"\s*-?[0-9]{1,9}\s*", value) else otherwise


def _put_table(grid: list[list[tuple[int, int, list[str]]]], out: Lines) -> None:
    """grid: per row the cells' spans of columns and rows, and their lines."""
    rows: list[list[tuple[int, int, list[str]]]] = []  # column, columns, lines
    taken: dict[int, int] = {}  # column: rows that a cell from above still takes
    for cells in grid:
        column, row = 0, []
        for wide, high, lines in cells:
            while taken.get(column, 0):
                column += 1
            row.append((column, wide, lines))
            for c in range(column, column + wide if high > 1 else column):
                taken[c] = high
            column += wide
        taken = {c: n - 1 for c, n in taken.items() if n > 1}
        rows.append(row)
    widths: dict[int, int] = defaultdict(int)
    for span in sorted({wide for row in rows for _, wide, _ in row}):
        for row in rows:
            for column, wide, lines in row:
                if wide == span and lines:
                    need = max(map(len, lines)) - sum(widths[c] + 2 for c in range(column, column + wide - 1))
                    widths[column + wide - 1] = max(widths[column + wide - 1], need)
    starts, at = {}, 0
    for c in range(max(widths, default=-1) + 1):
        starts[c], at = at, at + (widths[c] + 2 if widths[c] else 0)
    for row in rows:
        tall = sorted((len(lines), column) for column, _, lines in row)
        beside = tall[-2][0] if len(tall) > 1 else 0  # below these lines only the tallest cell has any
        for k in range(beside):
            line, here = [], 0
            for column, _, lines in row:
                if k < len(lines) and lines[k]:
                    line += [" " * (starts[column] - here), lines[k]]
                    here = starts[column] + len(lines[k])
            if joined := "".join(line).rstrip():
                out.put(joined)
        for column, _, lines in row:
            pad = " " * starts[column]
            for text in lines[beside:]:
                if text := text.rstrip():
                    out.put(pad + text if pad else text)


def _start_table(table: Element, out: Lines, frames: list[Lines], visible: bool) -> None:
    """Lays the caption, then all cells, then the table they make, then what stands outside of cells."""
    rows, others = _parts(table, SECTIONS, frozenset(["tr"]))
    grid, loose, tasks = [], [], []
    for row in rows:
        cells, rest = _parts(row, frozenset(), CELLS)
        seen = visible if row.visible is None else row.visible
        grid.append([(_whole(c.attributes.get("colspan", ""), 1, SPAN, 1), _whole(c.attributes.get("rowspan", ""), 1, len(rows), 1), []) for c in cells])
        tasks += [lambda c=c, lines=place[2], seen=seen: _open(c, Lines(out.depth + 1, lines.extend), frames, seen) for c, place in zip(cells, grid[-1])]
        loose += rest
    of = lambda wanted: [(c, False, visible) for c in others if (isinstance(c, Element) and c.tag == "caption") == wanted]
    out.todo.extend(reversed([*of(True), out.end, *tasks, lambda: _put_table(grid, out), *of(False), *((c, False, visible) for c in loose)]))


def _start_list(element: Element, out: Lines, frames: list[Lines], visible: bool) -> None:
    items = sum(isinstance(c, Element) and c.tag == "li" and c.shown for c in element.children)
    back = element.tag == "ol" and "reversed" in element.attributes
    number, tasks = _whole(element.attributes.get("start", ""), -(10**9), 10**9, items if back else 1), []
    for child in element.children:
        if isinstance(child, Element) and child.tag == "li" and child.shown:
            number = _whole(child.attributes.get("value", ""), -(10**9), 10**9, number)
            mark = f"{number}. " if element.tag == "ol" else "- "
            number += -1 if back else 1
            tasks.append(lambda c=child, mark=mark: _open(c, Lines(out.depth + 1, None, out, mark, " " * len(mark)), frames, visible))
        else:
            tasks += [(child, False, visible), out.end]
    out.todo.extend(reversed(tasks))


def _open(element: Element, frame: Lines, frames: list[Lines], visible: bool) -> None:
    """Lays the element's children out in a frame."""
    seen = visible if element.visible is None else element.visible
    frame.todo.extend((c, element.tag == "pre", seen) for c in reversed(element.children))
    frames.append(frame)


def _step(out: Lines, child: object, pre: bool, visible: bool, frames: list[Lines]) -> None:
    if isinstance(child, str):
        if visible:
            (out.raw if pre else out.add)(child)
        return
    if not child.shown:
        return
    tag, attributes = child.tag, child.attributes
    visible = visible if child.visible is None else child.visible
    if tag == "br":
        if pre:
            out.raw("\n")
        else:
            out.end(gap=not out.parts)
    elif tag in ("ul", "ol", "table", "blockquote") and out.depth < DEEP:
        out.end(True)
        out.todo.append(lambda: out.end(True))
        if tag == "table":
            _start_table(child, out, frames, visible)
        elif tag == "blockquote":
            _open(child, Lines(out.depth + 1, None, out, "> ", "> "), frames, visible)
        else:
            _start_list(child, out, frames, visible)
    else:
        if tag in BLOCKS:
            out.end(tag in SPACED)
            out.todo.append(lambda: out.end(tag in SPACED))
            if tag == "li" and out.depth >= DEEP:
                out.add("- ")
        said = {"img": "alt", "optgroup": "label"}.get(tag) or ("value" if tag == "input" and attributes.get("type", "").lower() not in ("checkbox", "radio", "image", "password") else None)
        if said and visible:
            out.add(attributes.get(said, ""))
            if tag == "optgroup":
                out.end()
        inner = pre or tag in ("pre", "textarea")
        out.todo.extend((c, inner, visible) for c in reversed(child.children))


def render(page: str) -> str:
    found: list[str] = []
    frames: list[Lines] = []
    _open(parse(page), Lines(0, found.extend), frames, True)
    while frames:
        out = frames[-1]
        if not out.todo:
            out.end()
            frames.pop()
            if out.done:
                out.done(out.lines)
        elif callable(task := out.todo.pop()):
            task()
        else:
            _step(out, *task, frames)
    return "\n".join(found)


def render_pages(pages: DataFrame, source: str = "html") -> DataFrame:
    """Per row: page_id, text, n_chars and n_lines. One pass without a shuffle."""
    bounded_batches(pages.sparkSession)

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(p) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([t.count("\n") + bool(t) for t in texts], pa.int64())], ["page_id", "text", "n_chars", "n_lines"])

    return pages.select("page_id", F.coalesce(source, F.lit("")).alias("html")).mapInArrow(show, f"page_id {pages.schema['page_id'].dataType.simpleString()}, text string, n_chars long, n_lines long")
