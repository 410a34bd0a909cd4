"""Form fields of crawled pages: HTML to flat rows, by the standard library's parser in Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = (
    "page_id {id}, seq int, form int, tag string, type string, name string, label string, legend string, value string, required boolean, "
    "autocomplete string, accept string, options array<string>, rows array<string>, section string, path string, identity_key string"
)
#: Controls that hold no answer, and elements without content.
SKIPPED = {"hidden", "submit", "button", "reset", "image"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: What a start tag closes, up to where: an open element of the first set, unless one of the second stands in between.
_BLOCKS = "address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
IMPLIED = {
    **{tag: ({"p"}, {"table", "td", "th", "button"}) for tag in _BLOCKS},
    "li": ({"li", "p"}, {"ul", "ol"}), "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}), "label": ({"label"}, {"form", "fieldset", "td"}),
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Levels of a path, and of the search for text before a field; characters that such text has at most.
DEPTH, NEAR_LEVELS, NEAR_TEXT = 12, 4, 140


def _tidy(text: str | None) -> str:
    return " ".join((text or "").split())


def _pretty(name: str) -> str:
    return _tidy(re.sub(r"([a-z])([A-Z])", r"\1 \2", re.sub(r"[_\-\[\]]+", " ", name)))


class _Node:
    """An open element: where its text begins, its place among siblings, and the last text that a child of it gave."""

    __slots__ = ("at", "before", "child_tags", "end", "fields", "index", "own", "parent", "start", "tag")

    def __init__(self, tag: str, at: dict[str, str], parent: _Node | None, start: int, fields: int):
        self.tag, self.at, self.parent, self.start, self.end, self.fields = tag, at, parent, start, None, fields
        self.child_tags: dict[str, int] = {}
        self.own: dict = {}  # its field, number as a form, legend or grid
        self.before: tuple[int, int] | None = None
        if parent is not None:
            parent.child_tags[tag] = parent.child_tags.get(tag, 0) + 1
            self.index = parent.child_tags[tag]
        else:
            self.index = 1


class _Reader(HTMLParser):
    """Keeps a stack of open elements, as a browser would close them, and each text once; elements are ranges of texts.

    Every tag and text is handled once, and a tag is taken from the stack once, so time follows the length of the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.texts: list[str] = []
        self.solid = [0]  # characters without white space up to each text
        self.root = _Node("", {}, None, 0, 0)
        self.stack = [self.root]
        self.open: dict[str, list[int]] = {}  # places in the stack of each tag
        self.fields: list[dict] = []
        self.forms, self.section = 0, ""
        self.labels: dict[str, _Node] = {}
        self.ids: dict[str, _Node] = {}
        self.mute = 0  # inside a script, style, select or text area
        self.option: list[str] | None = None

    def updatepos(self, i: int, j: int) -> int:
        return j  # lines and columns aren't asked for

    def _inner(self, *tags: str) -> _Node | None:
        at = max((self.open[t][-1] for t in tags if self.open.get(t)), default=None)
        return None if at is None else self.stack[at]

    def _role(self, *roles: str) -> _Node | None:
        return self._inner(*(f"role={r}" for r in roles))

    def _push(self, node: _Node) -> None:
        for name in (node.tag, f"role={node.at.get('role')}"):
            self.open.setdefault(name, []).append(len(self.stack))
        self.stack.append(node)

    def _pop(self) -> None:
        node = self.stack.pop()
        for name in (node.tag, f"role={node.at.get('role')}"):
            self.open[name].pop()
        self._close(node)

    def _close(self, node: _Node) -> None:
        node.end = len(self.texts)
        size = self.solid[node.end] - self.solid[node.start]
        if node.parent is not None and 0 < size <= NEAR_TEXT and node.fields == len(self.fields):
            node.parent.before = (node.start, node.end)
        if node.tag in HEADINGS and size:
            self.section = self._text(node)
        if node.tag in ("script", "style", "select", "textarea", "datalist"):
            self.mute -= 1
        if node.tag == "option" or node.at.get("role") == "option":
            self._end_option(node)
        if "grid" in node.own:
            self._end_grid(node.own["grid"])

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        at = {k: v if v is not None else "" for k, v in attrs}
        closes, unless = IMPLIED.get(tag, (set(), set()))
        stop = max((self.open[t][-1] for t in unless if self.open.get(t)), default=0)
        low = min((i for t in closes for i in self.open.get(t, ())[-1:] if i > stop), default=None)
        while low is not None and len(self.stack) > low:
            self._pop()
        node = _Node(tag, at, self.stack[-1], len(self.texts), len(self.fields))
        role = at.get("role")
        if at.get("id"):
            self.ids.setdefault(at["id"], node)
        if tag == "form":
            node.own["form"], self.forms = self.forms, self.forms + 1
        elif tag == "label" and at.get("for"):
            self.labels.setdefault(at["for"], node)
        elif tag == "legend" and (fieldset := self._inner("fieldset")) is not None:
            fieldset.own.setdefault("legend", node)
        if tag == "table" or role in ("grid", "table"):
            node.own["grid"] = {"columns": [], "rows": [], "cells": [], "lines": 0, "node": node}
        if (grid := self._grid()) is not None:
            grid["lines"] += tag == "tr"
            if role == "columnheader" or (tag == "th" and grid["lines"] <= 1 and at.get("scope") != "row"):
                grid["columns"].append(node)
            elif role == "rowheader" or tag == "th":
                grid["rows"].append(node)
        kind = self._kind(tag, at)
        if kind is not None:
            self._field(node, tag, at, kind)
        if tag in VOID:
            self._close(node)
            return
        if tag in ("script", "style", "select", "textarea", "datalist"):
            self.mute += 1
        if tag == "option" or role == "option":
            self.option = [] if tag == "option" else None
        self._push(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # "<div/>" opens a div, as in browsers

    def handle_endtag(self, tag: str) -> None:
        if self.open.get(tag):
            low = self.open[tag][-1]
            while len(self.stack) > low:
                self._pop()

    def handle_data(self, data: str) -> None:
        if self.option is not None:
            self.option.append(data)
        elif not self.mute:
            self.texts.append(data)
            self.solid.append(self.solid[-1] + sum(map(len, data.split())))

    def close(self) -> None:
        super().close()
        while len(self.stack) > 1:
            self._pop()

    @staticmethod
    def _kind(tag: str, at: dict[str, str]) -> str | None:
        """The control's kind, null for what is none: roles of lists go before what the element is."""
        role = at.get("role", "")
        if tag == "input" and (at.get("type") or "").lower() in SKIPPED:
            return None
        if tag == "select" or role in ("combobox", "listbox") or at.get("aria-haspopup") in ("listbox", "combobox"):
            return "select"
        if tag == "textarea" or role in ("textbox", "spinbutton") or at.get("contenteditable") == "true":
            return "paragraph"
        if tag == "input":
            return (at.get("type") or "text").lower()
        return {"radio": "radio", "checkbox": "checkbox", "switch": "checkbox"}.get(role)

    def _grid(self) -> dict | None:
        node = self._inner("table", "role=grid", "role=table")
        return None if node is None else node.own["grid"]

    def _field(self, node: _Node, tag: str, at: dict[str, str], kind: str) -> None:
        near, level = None, node
        for _ in range(NEAR_LEVELS):
            if level.parent is None or near:
                break
            near, level = level.parent.before, level.parent
        form, fieldset, label = self._inner("form"), self._inner("fieldset"), self._inner("label")
        field = {"node": node, "form": None if form is None else form.own["form"], "tag": tag, "type": kind, "at": at, "fieldset": fieldset, "wrap": label, "near": near, "section": self.section, "options": [], "rows": []}
        node.own["field"] = field
        self.fields.append(field)
        if kind in ("radio", "checkbox") and (grid := self._grid()) is not None:
            grid["cells"].append(field)

    def _end_option(self, node: _Node) -> None:
        owner = self._inner("select") or self._role("listbox", "combobox")
        text = _tidy("".join(self.option)) if self.option is not None else self._text(node)
        self.option = None
        if owner is not None and "field" in owner.own and text:
            options = owner.own["field"]["options"]
            if options or not text.lower().startswith(("select", "choose", "--")):
                options.append(text)

    def _end_grid(self, grid: dict) -> None:
        """Buttons of a table with heads of columns and of rows are one question."""
        columns, rows = ([_tidy(h.at.get("aria-label")) or self._text(h) for h in grid[k]] for k in ("columns", "rows"))
        columns, rows, cells = [c for c in columns if c], [r for r in rows if r], grid["cells"]
        if not (columns and rows and cells):
            return
        first, node = cells[0], grid["node"]
        required = any("required" in c["at"] or c["at"].get("aria-required") == "true" for c in cells)
        kind = "checkbox_grid" if any(c["type"] == "checkbox" for c in cells) else "multiple_choice_grid"
        first |= {"node": node, "at": node.at | {"name": cells[0]["at"].get("name")}, "tag": node.tag, "type": kind, "options": columns, "rows": rows, "near": node.parent.before, "wrap": None, "grid": True, "required": required}
        for c in cells[1:]:
            c["dropped"] = True

    def _text(self, node: _Node | None) -> str:
        return "" if node is None else _tidy("".join(self.texts[node.start : node.end]))

    def _pointed(self, ids: str) -> str:
        return _tidy(" ".join(self._text(self.ids.get(i)) for i in ids.split()))

    def _label(self, f: dict) -> Iterator[str]:
        """What may name a field, the best first."""
        at = f["at"]
        if not f.get("grid"):
            yield self._text(self.labels.get(at.get("id", "")))
            yield self._text(f["wrap"])
        yield _tidy(at.get("aria-label"))
        yield self._pointed(at.get("aria-labelledby", ""))
        yield self._text(f["fieldset"].own.get("legend")) if f["fieldset"] is not None else ""
        yield _tidy(at.get("placeholder"))
        for key in ("title", "data-label", "data-field-label", "data-testid"):
            value = _tidy(at.get(key))
            yield "" if key == "data-testid" and re.match(r"(?i)(?:input|field|control)$", value) else _pretty(value)
        yield _tidy("".join(self.texts[slice(*f["near"])])) if f["near"] else ""
        yield _tidy(at.get("aria-description")) or self._pointed(at.get("aria-describedby", ""))
        yield _pretty(at.get("name") or at.get("id") or "")

    @staticmethod
    def _path(node: _Node) -> str:
        parts: list[str] = []
        while node.parent is not None and node.tag not in ("html", "body") and len(parts) < DEPTH:
            several = node.parent.child_tags[node.tag] > 1
            parts.append(f"{node.tag}[{node.index}]" if several else node.tag)
            node = node.parent
        return ">".join(reversed(parts))

    def rows(self) -> Iterator[tuple]:
        for seq, f in enumerate(x for x in self.fields if "dropped" not in x):
            at = f["at"]
            label = next((x for x in self._label(f) if x), "")
            legend = self._text(f["fieldset"].own.get("legend")) if f["fieldset"] is not None else ""
            required = f.get("required", False) or "required" in at or at.get("aria-required") == "true" or label.endswith("*")
            path = self._path(f["node"])
            key = "|".join([path, at.get("name") or at.get("id") or at.get("data-automation-id") or "", label.lower()])
            yield seq, f["form"], f["tag"], f["type"], at.get("name"), label, legend or None, at.get("value"), required, at.get("autocomplete"), at.get("accept"), f["options"], f["rows"], f["section"] or None, path, key


def page_fields(pages: DataFrame) -> DataFrame:
    """One row for each form control of pages (page_id, html), in document order.

    label: the first that is not blank of label for, wrapping label, aria-label, aria-labelledby, legend, placeholder, title and
    data attributes, the text of an element before (up to four levels up, 140 characters, without fields), the description, the name.
    type is the control's (text, email, radio, paragraph, select, ...): list boxes and combo boxes of any element are selects, spin buttons
    paragraphs. options are those of selects and list boxes, without a leading prompt. Radio buttons or checkboxes in a table (or role grid)
    with heads of columns and rows are one row, multiple_choice_grid or checkbox_grid, with columns as options and `rows`. form
    numbers the page's forms from 0, null outside; section is the heading before; path the place in the document, identity_key path, name
    and label. Null html has no fields; elements that are not closed end where browsers end them, labels at the next label. What scripts
    draw or styles hide can't be seen.
    """
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.format(id=kind).split(", ")]
        for batch in batches:
            out = []
            for page, html in zip(batch["page_id"], batch["html"], strict=True):
                if html:
                    reader = _Reader()
                    reader.feed(html)
                    reader.close()
                    out += [(page, *row) for row in reader.rows()]
            frame = pd.DataFrame(out, columns=names)
            frame["form"] = frame["form"].astype("Int32")
            yield frame

    return pages.select("page_id", "html").mapInPandas(run, SCHEMA.format(id=kind))
