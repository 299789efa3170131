"""Presentation MathML as inline LaTeX.

A stack machine over the parser's events: a start tag opens a frame, text and finished children become
the frame's operands, and an end tag reduces the frame to one operand of the frame below. How an
element reduces depends on its kind in the MathML definition alone: token elements hold text, layout
schemata with a required number of arguments have a template, and everything else is a row.
It runs as an Arrow function, since nesting is beyond a column expression.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple
from xml.parsers import expat

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Tex(str):
    """An operand; in templates without blanks at its ends, and with ``:g`` as a group."""

    def __format__(self, spec: str) -> str:
        bare = self.strip()
        grouped = len(bare) == 1 or bare.startswith("{") and bare.endswith("}")
        return bare if spec != "g" or grouped else f"{{{bare}}}"


# Characters, names of functions, accents, and the form of each schema with required arguments.
_SIGNS = str.maketrans({"−": "-", "×": r"\cdot", "⋅": r"\cdot", "π": r"\pi"})
_UPRIGHT = {name: "\\" + name for name in ("sin", "cos", "tan", "cot", "ln", "log")} | {name: name for name in ("tg", "ctg", "arcsin", "arccos", "arctan")}
_ACCENTS = {"→": "overrightarrow", r"\rightarrow": "overrightarrow", r"\to": "overrightarrow", "‾": "overline", "¯": "overline", "—": "overline"}
_TEMPLATES = {
    "mfrac": (2, r"\frac{{{0}}}{{{1}}}"),
    "mroot": (2, r"\sqrt[{1}]{{{0}}}"),
    "msub": (2, "{0:g}_{1:g}"),
    "msup": (2, "{0:g}^{1:g}"),
    "msubsup": (3, "{0:g}_{{{1}}}^{{{2}}}"),
    "munder": (2, r"\underset{{{1}}}{{{0}}}"),
}


class Frame(NamedTuple):
    """An open element: its name without prefix, its attributes, its row so far, finished children, and plain text."""

    name: str
    attributes: dict[str, str]
    row: list[str]
    children: list[Tex]
    text: list[str]


def _signs(text: str) -> str:
    return html.unescape(text).translate(_SIGNS)


def _token(name: str, text: str) -> str | None:
    """What a token element stands for; None if ``name`` is none."""
    if name == "mo":
        return _signs(text)
    if name == "mtext":
        return html.unescape(text)
    if name not in ("mi", "mn"):
        return None
    word = html.unescape(text).strip()
    return word if name == "mn" or len(word) < 2 else _UPRIGHT.get(word, rf"\mathrm{{{word}}}")


def _reduced(frame: Frame) -> str:
    """The operand that a finished frame leaves."""
    name, row = frame.name, "".join(frame.row)
    if (token := _token(name, "".join(frame.text))) is not None:
        return token
    arity, template = _TEMPLATES.get(name, (0, ""))
    if arity and len(frame.children) >= arity:
        return template.format(*frame.children)
    if name == "mover" and len(frame.children) > 1:
        base, above = (c.strip() for c in frame.children[:2])
        command = _ACCENTS.get(above) or ("overline" if "arrow" in frame.attributes.get("accent", "") else rf"overset{{{above}}}")
        return rf"\{command}{{{base}}}"
    match name:
        case "msqrt":
            return rf"\sqrt{{{row.strip()}}}"
        case "mfenced":
            return f"{frame.attributes.get('open') or '('}{row}{frame.attributes.get('close') or ')'}"
        case "mspace":
            return " "
        case "annotation":
            return ""
    return row


def markup_to_latex(block: str) -> str:
    """LaTeX, without dollar signs, of one ``math`` element; raises ``ExpatError`` for what isn't well formed."""
    stack = [Frame("", {}, [], [], [])]

    def opened(tag: str, attributes: dict[str, str]) -> None:
        stack.append(Frame(tag.split(":")[-1], attributes, [], [], []))

    def said(text: str) -> None:
        stack[-1].row.append(_signs(text))
        stack[-1].text.append(text)

    def closed(_: str) -> None:
        frame = stack.pop()
        tex = Tex(_reduced(frame))
        below = stack[-1]
        below.row.append(tex)
        below.children.append(tex)
        below.text.extend(frame.text)

    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.CharacterDataHandler, parser.EndElementHandler = opened, said, closed
    parser.Parse(block, True)
    line = " ".join(stack[0].children[0].split())
    return re.sub(r"(?<=\() | (?=\))", "", line).strip()


_PIECE = re.compile(r"(?is)(?P<math><m:math\b.*?</m:math>)|(?P<tag><[^>]+>)|(?P<text>[^<]+|<)")


def page_to_text(page: str | None) -> str:
    """Text of a task page: mathematical elements as ``$...$`` (those that can't be read are left out), other tags away.

    Two or more closing marks at the end are dropped. Empty for null and blank pages.
    """
    out = []
    for piece in _PIECE.finditer(page or ""):
        found = piece.group()
        if piece.lastgroup == "text":
            out.append(html.unescape(found))
            continue
        out.append(" ")
        if piece.lastgroup == "math":
            try:
                out.append(f"${markup_to_latex(found)}$ ")
            except expat.ExpatError:
                continue
    line = " ".join("".join(out).split())
    bare = line.rstrip(" .;,:")
    return bare if len(line[len(bare) :].replace(" ", "")) > 1 else line


def task_page_text(c: Column) -> Column:
    """:func:`page_to_text` of a column; empty for null."""

    @F.pandas_udf("string")
    def convert(pages: pd.Series) -> pd.Series:
        return pages.map(page_to_text, na_action=None)

    return convert(c)
