"""Markup rules that need a tree: well-formedness, tolerant reading, the content model. Arrow-batched Python."""

from __future__ import annotations

from html.parser import HTMLParser
from xml.etree import ElementTree as ET
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

from strataloom.functions import text as T
from strataloom.operators.emit import LAST_IN_CONBODY, TASKBODY_ORDER

# Containers of blocks, phrase elements, and blocks a task body cannot hold directly.
CONTAINERS = ("result", "context", "prereq", "section", "conbody", "refbody", "taskbody", "steps", "info", "stepxmp", "stepresult")
PHRASES = (
    "uicontrol", "menucascade", "wintitle", "option", "ph", "b", "i", "u", "sub", "sup", "term", "q", "image", "xref", "cite", "fn", "keyword", "codeph", "varname", "parmname", "filepath", "userinput", "systemoutput",
    "cmdname", "msgnum", "msgph", "synph", "tm", "abbreviated-form",
)
LOOSE_IN_TASK = ("p", "note", "fig", "table", "ul", "ol", "codeblock")
STEP_LISTS = ("steps", "steps-unordered", "steps-informal")


def is_well_formed(xml: str) -> bool:
    parser = expat.ParserCreate()
    try:
        parser.Parse(xml.encode("utf-8", "replace"), True)
    except expat.ExpatError:
        return False
    return True


@F.pandas_udf(BooleanType())
def well_formed(xml: pd.Series) -> pd.Series:
    """Does an XML parser read the text? Null gives null; doctypes must be stripped before."""
    return xml.map(is_well_formed, na_action="ignore")


class _Tolerant(HTMLParser):
    """Reads broken markup: stray end tags are dropped, open elements closed where their parent ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = ET.Element("_root")
        self.open = [self.root]

    def parse_starttag(self, i: int) -> int:
        end = super().parse_starttag(i)
        return end

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.open.append(ET.SubElement(self.open[-1], tag, {k: v or "" for k, v in attrs}))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        ET.SubElement(self.open[-1], tag, {k: v or "" for k, v in attrs})

    def handle_endtag(self, tag: str) -> None:
        names = [e.tag for e in self.open[1:]]
        if tag in names:
            del self.open[len(names) - names[::-1].index(tag) :]

    def handle_data(self, data: str) -> None:
        _append_text(self.open[-1], data)


def _append_text(parent: ET.Element, data: str) -> None:
    if len(parent):
        parent[-1].tail = (parent[-1].tail or "") + data
    else:
        parent.text = (parent.text or "") + data


def read(body: str) -> ET.Element:
    """The tree under an artificial root, by the strict parser or, where that fails, the tolerant one."""
    try:
        return ET.fromstring(f"<_root>{body}</_root>")
    except ET.ParseError:
        parser = _Tolerant()
        parser.feed(body)
        parser.close()
        return parser.root


def write(elem: ET.Element) -> str:
    """Markup of an element's content, attributes in their order."""
    out = [escape(elem.text or "")]
    for c in elem:
        attrs = "".join(f' {k}="{escape(v, {chr(34): "&quot;"})}"' for k, v in c.attrib.items())
        inner = write(c)
        out.append(f"<{c.tag}{attrs}>{inner}</{c.tag}>" if inner else f"<{c.tag}{attrs}/>")
        out.append(escape(c.tail or ""))
    return "".join(out)


def _said(text: str | None) -> bool:
    return bool(text and text.strip())


def _new(tag: str, css: str, text: str | None = None) -> ET.Element:
    e = ET.Element(tag, {"class": css})
    e.text = text
    return e


def _paragraphs(elem: ET.Element) -> None:
    """No bare text in a container: phrase content becomes one paragraph, runs between blocks one each."""
    items: list[ET.Element] = []
    para: ET.Element | None = None

    def run() -> ET.Element:
        nonlocal para
        if para is None:
            para = _new("p", "- topic/p ")
            items.append(para)
        return para

    if _said(elem.text):
        run().text = elem.text
    for c in list(elem):
        tail, c.tail = c.tail, None
        if c.tag in PHRASES:
            run().append(c)
        else:
            para = None
            items.append(c)
        if _said(tail):
            _append_text(run(), tail)
        elif para is not None and len(para) and tail:
            para[-1].tail = tail
    elem.text = None
    elem[:] = items


# Fixed value: the command of a step that says nothing.
EMPTY_STEP = "Complete this step."


def _step(step: ET.Element) -> None:
    """A step has a command first; loose code and paragraphs go into one info at its end.

    A missing command is made of the step's own words, else of a paragraph that comes first.
    """
    parts = list(step)
    if "cmd" not in {c.tag for c in parts}:
        said = _said(step.text)
        made_of = parts.pop(0) if parts and parts[0].tag == "p" and not said else _new("p", "", step.text if said else EMPTY_STEP)
        cmd = ET.Element("cmd", {**made_of.attrib, "class": "- topic/ph task/cmd "})
        cmd.text, cmd.tail, cmd[:] = made_of.text, made_of.tail, list(made_of)
        step.text = None if said else step.text
        parts.insert(0, cmd)
    info = _new("info", "- topic/itemgroup task/info ")
    info[:] = [c for c in parts if c.tag in ("codeblock", "p")]
    step[:] = [c for c in parts if c.tag not in ("codeblock", "p")] + ([info] if len(info) else [])


def _task(body: ET.Element) -> None:
    """Sections are dissolved (or become examples), loose blocks go to context or result, parts into their order."""
    flat: list[ET.Element] = []
    for c in body:
        if c.tag != "section":
            flat.append(c)
        elif "example" in (c.findtext("title") or "").lower():
            c.tag = "example"
            c.set("class", "- topic/section task/example ")
            flat.append(c)
        else:
            flat.extend(c)
    at = next((i for i, c in enumerate(flat) if c.tag in STEP_LISTS), len(flat))
    parts = {"context": next((c for c in flat if c.tag == "context"), None), "result": next((c for c in flat if c.tag == "result"), None)}
    kept: list[ET.Element] = []
    for i, c in enumerate(flat):
        if c.tag not in LOOSE_IN_TASK:
            kept.append(c)
            continue
        name = "context" if i < at or at == len(flat) else "result"
        if parts[name] is None:
            parts[name] = _new(name, f"- topic/section task/{name} ")
            kept.append(parts[name])
        parts[name].append(c)
    rank = {t: i for i, t in enumerate(TASKBODY_ORDER)}
    body[:] = sorted(kept, key=lambda c: rank.get(c.tag, 99))


def _hoist(parent: ET.Element) -> None:
    """Sections inside sections become their siblings."""
    out: list[ET.Element] = []
    for c in list(parent):
        out.append(c)
        if c.tag == "section":
            inner = [x for x in c if x.tag == "section"]
            for x in inner:
                c.remove(x)
            holder = ET.Element("_root")
            holder[:] = inner
            _hoist(holder)
            out.extend(holder)
    parent[:] = out


def _indent(elem: ET.Element, depth: int) -> None:
    """Children on lines of their own, where an element holds nothing but elements."""
    if len(elem) and not any(_said(t) for t in (elem.text, *(c.tail for c in elem))):
        elem.text = "\n" + "  " * (depth + 1)
        for c in elem:
            c.tail = elem.text
            _indent(c, depth + 1)
        elem[-1].tail = "\n" + "  " * depth


def pretty(xml: str | None) -> str | None:
    """Well-formed markup with its elements indented, no text changed; other markup as it is."""
    if xml is None or not is_well_formed(f"<_root>{xml}</_root>"):
        return xml
    root = read(xml)
    for c in root:
        _indent(c, 0)
    return write(root)


@F.pandas_udf(StringType())
def pretty_print(xml: pd.Series) -> pd.Series:
    return xml.map(pretty, na_action="ignore")


def fix_body(body: str | None) -> str | None:
    """A body that keeps to the content model; unchanged text if nothing had to be done."""
    if body is None:
        return None
    root = read(body)
    before = write(root)
    for elem in list(root.iter()):
        if elem.tag in CONTAINERS:
            _paragraphs(elem)
        if elem.tag == "refbody" and any(c.tag == "p" for c in elem):
            section = _new("section", "- topic/section ")
            for c in [c for c in elem if c.tag == "p"]:
                elem.remove(c)
                section.append(c)
            elem.insert(0, section)
        if elem.tag == "step":
            _step(elem)
        if elem.tag == "taskbody":
            _task(elem)
        if any(c.tag == "section" for c in elem):
            _hoist(elem)
        if elem.tag == "conbody":
            elem[:] = sorted(elem, key=lambda c: c.tag in LAST_IN_CONBODY)
    after = write(root)
    return body if after == before and is_well_formed(f"<_root>{body}</_root>") else after


@F.pandas_udf(StringType())
def _fix(body: pd.Series) -> pd.Series:
    return body.map(fix_body, na_action="ignore")


def fix_content_model(body: Column) -> Column:
    """Text repairs in the JVM, then the tree rules. Text and child blocks never end up nested in a paragraph."""
    quick = T.fill_table_groups(T.collapse_double_close(T.escape_tags_in_attributes(T.close_class_attribute(T.unescape_quotes(body)))))
    return _fix(quick)
