"""HTML to text as it is laid out.

A tree builder reads the page with the usual implied tags (a block ends an open paragraph, an item the item before, a cell the cell
before, and so on) and never fails: unknown end tags are ignored, open elements end with the page, and an element nested over
``MAX_DEPTH`` deep is a sibling of the one before, with its own text. The renderer emits all visible text: blocks on lines of their own, a
blank line around paragraphs, headings, lists and tables, markers and indents of lists, preformatted text as it stands, and table cells aligned
in columns, with those that span columns or rows. Cells of over ``WRAP`` characters go on below in their column; a word longer than that
moves what follows it on its own line only.

Not visible: head, scripts, styles, templates, comments; elements with ``hidden``, ``display: none`` or ``visibility: hidden`` in
their attributes or in a style element's rules; what a closed details element holds besides its summary; options that aren't selected; titles
and definitions of drawings; and values of input fields. Rules count by importance, kind of selector and place, the style attribute before any
sheet. Selectors are tags, classes and ids in any combination, inside or directly below others; rules with other selectors, and rules for other media
than a screen of any size, hide nothing.

Defined cases: null and empty html give an empty text; rows are independent, repeated ones give equal texts; a text of any size takes
time in proportion to it; other columns pass through, except one called like the output; an empty table gives none.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesforge.llm.common import whole_text

MAX_DEPTH = 200
WRAP = 60  # characters of a table cell's line
MAX_SPAN = {"colspan": 1000, "rowspan": 65534}  # fixed values of the HTML standard

# Fixed values of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
HEAD = {"html", "head", "title", "base", "link", "meta", "style", "script", "template", "noscript"}
UNSEEN = {"head", "script", "style", "template", "title", "iframe", "noembed", "noframes", "object", "video", "audio", "canvas", "input",
          "datalist", "defs", "desc", "metadata", "symbol", "annotation", "annotation-xml"}
MARGIN = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "dl", "menu", "pre", "xmp", "blockquote", "table", "figure", "hr", "fieldset"}
BLOCK = MARGIN | {"address", "article", "aside", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dt", "figcaption",
                  "footer", "form", "header", "hgroup", "html", "legend", "li", "main", "nav", "optgroup", "section", "summary",
                  "tbody", "td", "tfoot", "th", "thead", "tr", "search"}
CLOSES_P = BLOCK - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "legend", "optgroup"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Start tag -> (tags that it ends, tags beyond which it doesn't look).
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}), "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}), "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    **{t: ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}) for t in ("tbody", "thead", "tfoot")},
}
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
RULE = re.compile(r"([^{}]*)\{([^{}]*)\}|([^{}]*)\{|\}")
COMPOUND = re.compile(r"(?:\*|[a-z][\w-]*)?(?:[.#][\w-]+)*", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


class Element:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict | None = None):
        self.tag, self.attrs, self.children = tag, attrs or {}, []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def parse(page: str) -> tuple[Element, list[tuple[str, str]]]:
    """Tree of the page, and the rules of its style elements."""
    root = Element("body")
    stack, sheet, pattern, at, n = [root], [], TAG, 0, len(page)
    last = page.rfind(">")  # what opens behind it is text

    def end(tags: set[str], limits: set[str]) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                break
            if stack[k].tag in limits:
                break

    def open_(tag: str, attrs: dict) -> None:
        if tag in ("td", "th"):
            end(*IMPLIED[tag])
            if stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                open_("tr", {})
        elif tag in IMPLIED:
            while True:  # all that it ends
                before = len(stack)
                end(*IMPLIED[tag])
                if len(stack) == before or tag in ("li", "dt", "dd", "option"):
                    break
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            stack.pop()
        element = Element(tag, attrs)
        if len(stack) >= MAX_DEPTH and tag not in VOID:
            stack.pop()
        stack[-1].children.append(element)
        if tag not in VOID:
            stack.append(element)

    while at < n:
        i = page.find("<", at)
        text = page[at:i] if i >= 0 else page[at:]
        if text:
            if stack[-1].tag == "head" and not text.isspace():
                stack.pop()
            stack[-1].children.append(unescape(text) if "&" in text else text)
        if i < 0:
            break
        if page.startswith("<!--", i):
            at = page.find("-->", i + 4)
            at = n if at < 0 else at + 3
            continue
        if page.startswith(("<!", "<?"), i):
            at = page.find(">", i)
            at = n if at < 0 else at + 1
            continue
        m = pattern.match(page, i) if i < last else None
        if m is None and i < last and page[i + 1:i + 3].strip("/")[:1].isalpha() and pattern is TAG:
            pattern = LOOSE_TAG  # a quote is never closed: from here on tags end at the next bracket
            m = pattern.match(page, i)
        if m is None:
            stack[-1].children.append("<")
            at = i + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Element("br"))
            elif tag == "p" and not any(e.tag == "p" for e in stack):
                stack[-1].children.append(Element("p"))
            elif tag not in ("html", "body"):
                end({tag}, {"td", "th", "caption"} if tag not in ("table", "tr", "tbody", "thead", "tfoot", "td", "th", "caption") else {"table"} - {tag})
            continue
        if tag in ("html", "body"):
            if stack[-1].tag == "head":
                stack.pop()
            root.attrs = root.attrs | _attributes(m[3])
            continue
        if stack[-1].tag == "head" and tag not in HEAD:
            stack.pop()
        if tag in CLOSES_P:
            end({"p"}, {"button", "td", "th", "caption", "table"})
        attrs = _attributes(m[3]) if m[3] else {}
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            raw = page[at:close.start()] if close else page[at:]
            if tag == "style":
                sheet += _rules(raw, attrs.get("media", ""))
            elif tag in ("xmp", "textarea"):
                stack[-1].children.append(e := Element(tag, attrs))
                e.children.append(raw if tag == "xmp" else unescape(raw).removeprefix("\n"))
            at = page.find(">", close.end()) + 1 if close else n
            at = at or n
            continue
        open_(tag, attrs)
    return root, sheet


def _on_screen(media: str) -> bool:
    """Whether a list of media holds for a screen whatever its size."""
    return not media.strip() or any(q.strip().removeprefix("only ").strip() in ("all", "screen") for q in media.lower().split(","))


def _rules(raw: str, media: str) -> list[tuple[str, str]]:
    """(selector, declarations) of a style element that hold on a screen."""
    out, holds = [], [_on_screen(media)]
    for m in RULE.finditer(re.sub(r"(?s)/\*.*?\*/", " ", raw)):
        if m[0] == "}":
            holds = holds[:-1] or [False]
        elif m[3] is not None:  # a block with rules inside
            name, _, condition = m[3].rpartition(";")[2].strip().partition(" ")
            holds.append(holds[-1] and (name.lower() == "@media" and _on_screen(condition) or name.lower() == "@layer"))
        elif holds[-1] and "@" not in m[1].rpartition(";")[2]:
            out += [(selector.strip(), m[2]) for selector in m[1].rpartition(";")[2].split(",")]
    return out


def _declared(text: str) -> dict[str, tuple[bool, str]]:
    """display and visibility as declared: (important, value)."""
    out: dict[str, tuple[bool, str]] = {}
    for part in text.lower().split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip(), value.strip()
        important = value.endswith("!important")
        if name in ("display", "visibility") and value and (important or not out.get(name, (False,))[0]):
            out[name] = (important, value.removesuffix("!important").strip())
    return out


class _Sheet:
    """Which elements the rules of a page and their own styles hide."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.by_name: dict[str, list] = {}  # rules by what their last part needs
        for place, (selector, body) in enumerate(rules):
            declared, parts = _declared(body), re.sub(r"\s*>\s*", " > ", selector).split()
            compounds = [p for p in parts if p != ">"]
            if not declared or not compounds or parts[0] == ">" or parts[-1] == ">" or not all(COMPOUND.fullmatch(p) and p for p in compounds):
                continue
            steps, direct = [], False
            for p in parts:
                if p == ">":
                    direct = True
                    continue
                tag = re.match(r"[^.#]*", p)[0].lower()
                steps.append((direct, "" if tag == "*" else tag, set(re.findall(r"\.([\w-]+)", p)), set(re.findall(r"#([\w-]+)", p))))
                direct = False
            weight = (sum(len(s[3]) for s in steps), sum(len(s[2]) for s in steps), sum(bool(s[1]) for s in steps), place)
            _, tag, classes, ids = steps[-1]
            name = "#" + min(ids) if ids else "." + min(classes) if classes else tag or "*"
            self.by_name.setdefault(name, []).append((weight, steps, declared))

    @staticmethod
    def _is(e: Element, step: tuple) -> bool:
        _, tag, classes, ids = step
        return (not tag or e.tag == tag) and classes <= set(e.attrs.get("class", "").split()) and ids <= {e.attrs.get("id")}

    def _fits(self, e: Element, above: list[Element], steps: list[tuple]) -> bool:
        if not self._is(e, steps[-1]):
            return False
        places = {len(above)}  # where the step behind can stand
        for step, behind in zip(steps[-2::-1], steps[:0:-1]):
            inside = {k - 1 for k in places} if behind[0] else range(max(places))
            places = {k for k in inside if k >= 0 and self._is(above[k], step)}
            if not places:
                return False
        return True

    def says(self, e: Element, above: list[Element]) -> str:
        """none, hidden, visible or nothing."""
        found = [((False, -1), "display", "none")] if "hidden" in e.attrs else []
        if self.by_name:
            for name in (e.tag, "*", *("." + c for c in e.attrs.get("class", "").split()), "#" + e.attrs.get("id", "")):
                for weight, steps, declared in self.by_name.get(name, ()):
                    if self._fits(e, above, steps):
                        found += [((important, 0, *weight), what, value) for what, (important, value) in declared.items()]
        if "style" in e.attrs:
            found += [((important, 1), what, value) for what, (important, value) in _declared(e.attrs["style"]).items()]
        last = {what: value for _, what, value in sorted(found, key=lambda f: f[0])}
        if last.get("display") == "none":
            return "none"
        visibility = last.get("visibility", "")
        return "hidden" if visibility in ("hidden", "collapse") else "visible" if visibility == "visible" else ""


class _Lines:
    """Lines of a block: words flow into the current one until something breaks it."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.gap = False

    def text(self, text: str) -> None:
        words = SPACE.split(text)
        if len(words) > 1 and not words[0]:
            self.space = True
        body = " ".join(w for w in words if w)
        if not body:
            return
        if self.space and self.now:
            self.now.append(" ")
        self._open()
        self.now.append(body)
        self.space = not words[-1]

    def _open(self) -> None:
        if self.gap and self.lines and not self.now:
            self.lines.append("")
        self.gap = False

    def end(self) -> None:
        if self.now:
            self.lines.append("".join(self.now).rstrip())
            self.now = []
        self.space = False

    def line_break(self) -> None:
        if self.now:
            self.end()
        elif self.lines and self.lines[-1]:
            self.lines.append("")

    def block(self, lines: list[str], margin: bool) -> None:
        self.end()
        while lines and not lines[0].strip():
            lines = lines[1:]
        while lines and not lines[-1].strip():
            lines = lines[:-1]
        if lines:
            self.gap |= margin
            self._open()
            self.lines += lines
        self.gap |= margin


class _Renderer:
    def __init__(self, sheet: _Sheet):
        self.sheet = sheet
        self.above = [Element("html")]  # the elements around what is being rendered

    def lines(self, e: Element, seen: bool = True, pre: bool = False) -> list[str]:
        out = _Lines()
        self.into(out, e, seen, pre or e.tag in ("pre", "xmp"))
        out.end()
        return out.lines

    def into(self, out: _Lines, e: Element, seen: bool, pre: bool) -> None:
        self.above.append(e)
        self._children(out, e, seen, pre)
        self.above.pop()

    def _children(self, out: _Lines, e: Element, seen: bool, pre: bool) -> None:
        number = int(e.attrs["start"]) if e.tag == "ol" and re.fullmatch(r"-?\d{1,9}", e.attrs.get("start", "")) else 1
        children = e.children
        if e.tag == "details" and "open" not in e.attrs:
            children = [c for c in children if isinstance(c, Element) and c.tag == "summary"][:1]
        elif e.tag == "select":
            options = [o for c in children if isinstance(c, Element) for o in ([c] if c.tag == "option" else c.children) if isinstance(o, Element)]
            children = [o for o in options if "selected" in o.attrs] or options[:1]
        for c in children:
            if isinstance(c, str):
                if not seen:
                    continue
                if pre:
                    first, *more = c.replace("\r\n", "\n").split("\n")
                    if first:
                        out._open()
                        out.now.append(first)
                    for line in more:
                        out.lines.append("".join(out.now).rstrip()) if out.now or out.lines else None
                        out.now = [line] if line else []
                else:
                    out.text(c)
                continue
            said = self.sheet.says(c, self.above)
            if c.tag in UNSEEN or said == "none":
                continue
            here = said != "hidden" and (seen or said == "visible")
            if c.tag == "br":
                out.line_break()
            elif c.tag == "wbr" or c.tag == "img":
                continue
            elif c.tag == "table":
                out.block(self.table(c, here, pre), True)
            elif c.tag == "li":
                marker = f"{number}. " if e.tag == "ol" else "- "
                if e.tag == "ol" and re.fullmatch(r"-?\d{1,9}", c.attrs.get("value", "")):
                    number = int(c.attrs["value"])
                    marker = f"{number}. "
                number += 1
                own = self.lines(c, here, pre)
                out.block([(marker if k == 0 else " " * len(marker)) + x if x else x for k, x in enumerate(own)], False)
            elif c.tag in ("dd", "blockquote"):
                out.block(["  " + x if x else x for x in self.lines(c, here, pre)], c.tag == "blockquote")
            elif c.tag in BLOCK:
                nested = c.tag in ("ul", "ol", "menu") and e.tag == "li"
                out.block(self.lines(c, here, pre), c.tag in MARGIN and not nested)
            else:
                self.into(out, c, here, pre or c.tag == "textarea")
                out.space |= c.tag in ("text", "textarea")

    def table(self, e: Element, seen: bool, pre: bool) -> list[str]:
        """Cells in columns; what stands outside of cells comes first."""
        outside, rows = _Lines(), []

        def read(x: Element, seen: bool) -> None:
            self.above.append(x)
            for c in x.children:
                if isinstance(c, str):
                    if seen:
                        outside.text(c)
                    continue
                said = self.sheet.says(c, self.above)
                if said == "none" or c.tag in UNSEEN:
                    continue
                here = said != "hidden" and (seen or said == "visible")
                if c.tag in ("tbody", "thead", "tfoot", "tr"):
                    if c.tag == "tr":
                        rows.append([])
                    read(c, here)
                elif c.tag in ("td", "th") and rows:
                    rows[-1].append((_wrapped(self.lines(c, here, pre)), _span(c, "colspan"), _span(c, "rowspan")))
                elif c.tag not in ("colgroup", "col"):
                    holder = Element("div")
                    holder.children = [c]
                    outside.block(self.lines(holder, seen, pre), False)
            self.above.pop()

        read(e, seen)
        outside.end()
        placed, taken = [], []  # a row's cells with their columns; columns (from, to) taken for some more rows
        for row in rows:
            at, own, k, more = 0, [], 0, []
            for lines, columns, span in row:
                while k < len(taken) and taken[k][0] <= at:
                    at, k = max(at, taken[k][1]), k + 1
                own.append((at, lines, columns))
                if span > 1:
                    more.append((at, at + columns, span - 1))
                at += columns
            placed.append(own)
            taken = sorted([(lo, hi, n - 1) for lo, hi, n in taken if n > 1] + more) if taken or more else taken
        widths: dict[int, int] = {}
        for own in placed:
            for at, lines, columns in own:
                if columns == 1:
                    widths[at] = max(widths.get(at, 0), min(max((len(x) for x in lines), default=0), WRAP))
        known = sorted(widths)
        ends = [0, *accumulate(widths[c] + 2 for c in known)]
        out = list(outside.lines)
        for own in placed:
            for k in range(max((len(lines) for _, lines, _ in own), default=0)):
                line = ""
                for at, lines, _ in own:
                    if k < len(lines) and lines[k]:
                        start = ends[bisect_left(known, at)]
                        line = (line + "  " if line and len(line) + 2 > start else line.ljust(start)) + lines[k]
                out.append(line.rstrip())
        return out


def _span(cell: Element, name: str) -> int:
    text = cell.attrs.get(name, "1")
    return min(max(int(text), 1), MAX_SPAN[name]) if re.fullmatch(r"\d{1,6}", text) else 1


def _wrapped(lines: list[str]) -> list[str]:
    """Lines of at most WRAP characters, but for longer words; indents stay."""
    out = []
    for line in lines:
        if len(line) <= WRAP:
            out.append(line)
            continue
        indent = line[:len(line) - len(line.lstrip())][:WRAP // 2]
        now, size = [], 0
        for word in line.split():
            if now and size + len(word) + 1 > WRAP - len(indent):
                out.append(indent + " ".join(now))
                now, size = [], 0
            now.append(word)
            size += len(word) + (len(now) > 1)
        out.append(indent + " ".join(now))
    return out


def visible_text(page: str) -> str:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 20 * MAX_DEPTH))  # a level of nesting is a few calls
    root, rules = parse(page)
    renderer = _Renderer(_Sheet(rules))
    said = renderer.sheet.says(root, renderer.above)
    return "" if said == "none" else "\n".join(renderer.lines(root, said != "hidden")).strip("\n")


def extract(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """Adds ``out``: the visible text of each whole page."""

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(visible_text)

    return df.withColumn(out, text.asNondeterministic()(whole_text(html)))
