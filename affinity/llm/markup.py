"""Markup residue: clean text that keeps its structure, and the kinds of markup met.

A note is scanned for the constructs of the four families in order of how strongly they
bind: Markdown code first, whose content belongs to no other family, then comments and raw
HTML, formulas, LaTeX, wiki markup, Markdown. What is finished is set aside under a
placeholder, so that no later step reads it again.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from html.entities import html5

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

FAMILIES = ("html", "markdown", "wiki", "latex")

# The elements of HTML, with those that were dropped from it.
TAGS = """
a abbr acronym address area article aside audio b base bdi bdo big blockquote body br button canvas caption
center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset figcaption
figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img input ins kbd
label legend li link main map mark menu meta meter nav noframes noscript object ol optgroup option output p param
picture pre progress q rp rt ruby s samp script search section select slot small source span strike strong style
sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr
""".split()
# LaTeX commands that need no argument to be known as such.
BARE_COMMANDS = """
item maketitle tableofcontents newpage clearpage hline par noindent centering bfseries itshape ldots dots quad
qquad newline linebreak pagebreak bigskip medskip smallskip LaTeX TeX appendix footnotesize small large
""".split()

_NAME = "(?:" + "|".join(sorted(TAGS, key=len, reverse=True)) + ")"
_ATTRIBUTES = r"""(?:\s+[A-Za-z_:@][\w:.-]*(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'=<>`]+))?)*\s*"""
TAG = re.compile(rf"</?({_NAME})\b{_ATTRIBUTES}/?>|<!DOCTYPE[^<>]*>|<\?xml[^<>]*\?>", re.I)
COMMENT = re.compile(r"<!--.*?-->", re.S)
RAW = re.compile(rf"<(script|style)\b{_ATTRIBUTES}>.*?</\1\s*>", re.I | re.S)
PRE = re.compile(rf"<pre\b{_ATTRIBUTES}>(?:\s*<code\b{_ATTRIBUTES}>)?(.*?)(?:</code\s*>\s*)?</pre\s*>", re.I | re.S)
ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|([A-Za-z][A-Za-z0-9]{1,31}));")
HEAD_TAG = re.compile(rf"<h([1-6])\b{_ATTRIBUTES}>(.*?)</h[1-6]\s*>", re.I | re.S)

FRONT = re.compile(r"\A---[ \t]*\n.*?\n(?:---|\.\.\.)[ \t]*(?:\n|\Z)", re.S)
FENCE = re.compile(r"^[ \t]*((?:>[ \t]?)*)(`{3,}|~{3,})([^\n`]*)\n(.*?)(?:^[ \t]*(?:>[ \t]?)*\2[`~]*[ \t]*$|\Z)", re.M | re.S)
SPAN = re.compile(r"(?<!`)(`+)(?!`)((?:(?!\n[ \t]*\n).)+?)(?<!`)\1(?!`)", re.S)
DRIVE_PATH = re.compile(r"\b[A-Za-z]:\\[^\s`$]*")

DISPLAY = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]", re.S)
PAREN = re.compile(r"\\\((.+?)\\\)", re.S)
INLINE = re.compile(r"(?<![\\$\w])\$(?=[^\s$])([^$\n]*?[^\s$\\])\$(?![\d$])")
FORMULA = re.compile(r"[\\^_=+{}<>*/|-]|^[A-Za-z]\w{0,2}'?$")
EQUATION = re.compile(r"\\begin\{(equation|align|gather|multline|eqnarray|math|displaymath)(\*?)\}(.*?)\\end\{\1\2\}", re.S)
VERBATIM = re.compile(r"\\begin\{(verbatim|lstlisting|minted)(\*?)\}(?:\[[^\]\n]*\]|\{[^}\n]*\})*\n?(.*?)\\end\{\1\2\}", re.S)
SECTION = re.compile(r"\\(part|chapter|section|subsection|subsubsection|paragraph)\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}")
ENVIRONMENT = re.compile(r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\]|\{[^}\n]*\})*")
BRACE = re.compile(r"(?<![\\\w:])\\([A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{|[{}]")
BARE = re.compile(rf"(?<![\\\w:])\\({'|'.join(BARE_COMMANDS)})\b[ \t]*")
DROPPED = {"label", "ref", "cite", "citep", "citet", "index", "vspace", "hspace", "usepackage", "documentclass", "pageref", "eqref"}

WIKI_TABLE = re.compile(r"^\{\|.*?^\|\}", re.M | re.S)
DOUBLE_BRACE = re.compile(r"\{\{|\}\}")
WIKI_LINK = re.compile(r"!?\[\[([^\[\]\n|]+)(?:\|([^\[\]\n]*))?\]\]")
WIKI_HEAD = re.compile(r"^[ \t]*(={2,6})[ \t]*([^=\n](?:.*?[^=\n])?)[ \t]*\1[ \t]*$", re.M)
QUOTED = re.compile(r"(?<!')('{5}|'{2,3})(?=[^\s'])((?:(?!'').)+?)(?<=[^\s'])\1(?!')")

ATX = re.compile(r"^((?:[ \t]*>)*[ \t]{0,3})(#{1,6})[ \t]+(\S.*?)[ \t]*#*[ \t]*$", re.M)
SETEXT = re.compile(r"^(?![ \t]*(?:[-+*>|]|\d+[.)])[ \t])(?![ \t]*\|)([^\n]*\S[^\n]*)\n[ \t]{0,3}(={2,}|-{2,})[ \t]*$", re.M)
TASK = re.compile(r"^([ \t>]*(?:[-*+]|\d+[.)])[ \t]+)\[[ xX]\][ \t]+", re.M)
DELIMITER = re.compile(r"^[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)+\|?[ \t]*$|^[ \t]*\|[ \t]*:?-+:?[ \t]*\|[ \t]*$", re.M)
IMAGE = re.compile(r"!\[([^\[\]\n]*)\](?:\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)|\[[^\[\]\n]*\])")
LINK = re.compile(r"(?<![\]\\])\[([^\[\]\n]+)\](?:\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)|\[[^\[\]\n]*\])")
DEFINITION = re.compile(r"^[ \t]{0,3}\[[^\[\]\n]+\]:[ \t]+\S+(?:[ \t]+[\"'(][^\n]*)?[ \t]*$\n?", re.M)
AUTOLINK = re.compile(r"<((?:https?|ftp|mailto):[^<>\s]+)>")
STRIKE = re.compile(r"(?<!~)~~(?=[^\s~])([^~\n]+?)(?<=[^\s~])~~(?!~)")
STRONG = (
    re.compile(r"(?<![\\*])\*\*(?=[^\s*])((?:(?!\n[ \t]*\n)[^*])+?)(?<=[^\s*])\*\*(?!\*)"),
    re.compile(r"(?<![\w\\])__(?=[^\s_])([^\n]+?)(?<=[^\s_])__(?!\w)"),
)
LIGHT = (
    re.compile(r"(?<![\w*\\])\*(?=[^\s*])([^*\n]+?)(?<=[^\s*])\*(?![\w*])"),
    re.compile(r"(?<![\w\\])_(?=[^\s_])([^_\n]+?)(?<=[^\s_])_(?!\w)"),
)
#: Tags that end a line or a block, and what stands in their place.
BREAKS = {"br": "\n", "p": "\n", "div": "\n", "hr": "\n", "tr": "\n", "table": "\n", "ul": "\n", "ol": "\n", "details": "\n", "summary": "\n", "blockquote": "\n", "section": "\n", "article": "\n", "dl": "\n", "li": "\n- ", "dt": "\n", "dd": "\n- ", "td": " | ", "th": " | "}


class _Scan:
    """One text on its way through the steps."""

    def __init__(self, text: str):
        self.found: set[str] = set()
        self.kept: list[str] = []
        marks = (chr(0xE000 + i) for i in range(6000))
        self.mark = next(m for m in marks if m not in text)
        self.text = text

    def keep(self, content: str) -> str:
        self.kept.append(content)
        return f"{self.mark}{len(self.kept) - 1}{self.mark}"

    def sub(self, family: str | None, pattern: re.Pattern, make) -> None:
        """Replace all matches; the family counts if there was any."""

        def step(m: re.Match) -> str:
            new = make(m)
            if family and new is not None:
                self.found.add(family)
            return m.group() if new is None else new

        self.text = pattern.sub(step, self.text)

    def restore(self) -> str:
        pattern = re.compile(f"{self.mark}(\\d+){self.mark}")
        text = self.text
        while self.mark in text:
            text = pattern.sub(lambda m: self.kept[int(m.group(1))], text)
        return text


def _block(code: str) -> str:
    return "\n```\n" + code.strip("\n") + "\n```\n"


def _code(s: _Scan) -> None:
    if "```" in s.text or "~~~" in s.text:
        s.sub("markdown", FENCE, lambda m: s.keep("```" + m[3].strip() + "\n" + m[4].rstrip("\n") + "\n```"))
    if "`" in s.text:
        s.sub("markdown", SPAN, lambda m: s.keep("`" + m[2].strip() + "`"))


def _raw_html(s: _Scan) -> None:
    if "<" not in s.text:
        return
    s.sub("html", COMMENT, lambda m: "")
    s.sub("html", RAW, lambda m: "")
    s.sub("html", PRE, lambda m: s.keep(_block(html.unescape(TAG.sub("", m[1])))))
    s.sub("html", HEAD_TAG, lambda m: f"\n{'#' * int(m[1])}{s.keep(' ')}{m[2].strip()}\n")


def _formulas(s: _Scan) -> None:
    if "\\" in s.text:
        s.sub(None, DRIVE_PATH, lambda m: s.keep(m[0]))
        s.sub("latex", VERBATIM, lambda m: s.keep(_block(m[3])))
        s.sub("latex", EQUATION, lambda m: s.keep("$$" + m[3].strip() + "$$"))
        s.sub("latex", PAREN, lambda m: s.keep("$" + m[1].strip() + "$"))
    if "$$" in s.text or "\\[" in s.text:
        s.sub("latex", DISPLAY, lambda m: s.keep("$$" + (m[1] or m[2]).strip() + "$$"))
    if "$" in s.text:
        s.sub("latex", INLINE, lambda m: s.keep("$" + m[1] + "$") if FORMULA.search(m[1]) else None)


def _commands(text: str) -> str:
    """The arguments in place of LaTeX commands, however deep these are nested, in one pass.

    A command whose argument still holds a brace is left as it is.
    """
    out: list[str] = []
    open_at: list[tuple[int, str | None]] = []  # piece and command name of each open brace, null for a plain one
    plain: list[bool] = []  # whether a plain brace stands inside it
    at = 0
    for m in BRACE.finditer(text):
        out.append(text[at : m.start()])
        at = m.end()
        out.append(m[0])
        if m[0] != "}":
            open_at.append((len(out) - 1, m[1]))
            plain.append(False)
            continue
        if not open_at:
            continue
        (head, name), braced = open_at.pop(), plain.pop()
        if name is None or braced:
            if plain:
                plain[-1] = True
        elif name in DROPPED:
            del out[head:]
        else:
            out[head], out[-1] = (" (", ")") if name == "footnote" else ("", "")
    return "".join(out) + text[at:]


def _without_templates(text: str) -> str:
    """The text without templates, however deep these are nested, in one pass."""
    out: list[str] = []
    open_at: list[int] = []
    at = 0
    for m in DOUBLE_BRACE.finditer(text):
        out += [text[at : m.start()], m[0]]
        at = m.end()
        if m[0] == "{{":
            open_at.append(len(out) - 1)
        elif open_at:
            del out[open_at.pop() :]
    return "".join(out) + text[at:]


def _latex(s: _Scan) -> None:
    if "\\" not in s.text:
        return
    depth = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
    s.sub("latex", SECTION, lambda m: f"{'#' * depth[m[1]]}{s.keep(' ')}{m[2]}")
    before = s.text
    if "\\begin" in s.text or "\\end" in s.text:
        table = "\\begin{tabular" in s.text or "\\begin{array" in s.text
        s.sub("latex", ENVIRONMENT, lambda m: "")
        if table:
            s.text = re.sub(r"[ \t]*\\\\[ \t]*$", "", s.text, flags=re.M)
            s.text = re.sub(r"(?m)^([^\n&]*(?<!\\)[ \t]&[ \t][^\n]*)$", lambda m: m[0].replace(" & ", " | "), s.text) if before != s.text else s.text
    s.sub("latex", re.compile(r"(?m)^[ \t]*\\item\b(?:\[[^\]\n]*\])?[ \t]*"), lambda m: "- ")
    new = _commands(s.text)
    if new != s.text:
        s.found.add("latex")
        s.text = new
    s.sub("latex", BARE, lambda m: "")


def _wiki(s: _Scan) -> None:
    if "{|" in s.text:
        def table(m: re.Match) -> str:
            rows = re.split(r"^\|-.*$", m[0][2:-2], flags=re.M)
            lines = []
            for row in rows:
                cells = [c.strip() for part in re.split(r"^[|!]\+?|\|\||!!", row.partition("\n")[2], flags=re.M) if (c := part.strip())]
                if cells:
                    lines.append(" | ".join(cells))
            return "\n".join(lines)

        s.sub("wiki", WIKI_TABLE, table)
    if "{{" in s.text:
        new = _without_templates(s.text)
        if new != s.text:
            s.found.add("wiki")
            s.text = new
    if "[[" in s.text:
        def link(m: re.Match) -> str:
            if m[1].lower().startswith(("category:", "file:", "image:")) and not m[0].startswith("!"):
                return ""
            return m[2] or m[1].partition("#")[0] or m[1]

        s.sub("wiki", WIKI_LINK, link)
    if "==" in s.text:
        s.sub("wiki", WIKI_HEAD, lambda m: f"{'#' * (len(m[1]) - 1)}{s.keep(' ')}{m[2].strip()}")
    if "''" in s.text:
        s.sub("wiki", QUOTED, lambda m: m[2])


def _markdown(s: _Scan) -> None:
    text = s.text
    if "#" in text:
        s.sub("markdown", ATX, lambda m: f"{m[2]}{s.keep(' ')}{m[3]}")
    if "==" in text or "--" in text:
        s.sub("markdown", SETEXT, lambda m: f"{'#' if m[2][0] == '=' else '##'}{s.keep(' ')}{m[1].strip()}")
    if "|" in text and "-" in text and DELIMITER.search(s.text):
        lines, kept = s.text.split("\n"), []
        rows = {i for i, x in enumerate(lines) if DELIMITER.match(x) and i and "|" in lines[i - 1]}
        if rows:
            s.found.add("markdown")
            inside = False
            for i, x in enumerate(lines):
                if i in rows:
                    inside = True
                    continue
                if i + 1 in rows or inside and "|" in x:
                    x = " | ".join(c.strip() for c in x.strip().strip("|").split("|"))
                elif inside:
                    inside = False
                kept.append(x)
            s.text = "\n".join(kept)
    if "[" in text:
        s.sub("markdown", TASK, lambda m: m[1])
        s.sub("markdown", DEFINITION, lambda m: "")
        s.sub("markdown", IMAGE, lambda m: m[1])
        s.sub("markdown", LINK, lambda m: m[1])
    if "~~" in text:
        s.sub("markdown", STRIKE, lambda m: m[1])
    if "*" in text or "_" in text:
        for pattern in (*STRONG, *LIGHT):
            s.sub("markdown", pattern, lambda m: m[1])


def _tags(s: _Scan) -> None:
    if "<" in s.text:
        s.sub("markdown", AUTOLINK, lambda m: m[1])

        def tag(m: re.Match) -> str:
            name = (m[1] or "").lower()
            closing = m[0][1] == "/"
            if name == "img":
                alt = re.search(r"""\balt\s*=\s*(?:"([^"]*)"|'([^']*)')""", m[0], re.I)
                return (alt[1] or alt[2] or "") if alt else ""
            if closing and name in ("li", "td", "th", "dt", "dd"):
                return ""
            return BREAKS.get(name, "")

        s.sub("html", TAG, tag)
    if "&" in s.text:
        def character(m: re.Match) -> str | None:
            if m[1] and m[1] + ";" not in html5:
                return None
            return html.unescape(m[0]).replace("\xa0", " ")

        old = None
        while s.text != old:  # characters that were escaped several times; each round makes the text shorter
            old = s.text
            s.sub("html", ENTITY, character)


def scan(text: str | None, title: str | None = None) -> tuple[str | None, list[str]]:
    """The clean text and the families of markup, in the order of ``FAMILIES``.

    ``title``, if the text begins with it and a blank, is not part of the first line.
    Null and empty texts come back as they are, without a family.
    """
    if not text:
        return text, []
    head, body = "", text
    if title and text.startswith(title + " "):
        head, body = title + " ", text[len(title) + 1 :]
    if not any(c in body for c in "<>&[]{}*_~`$\\|=#'-"):
        return text, []
    s = _Scan(body)
    if body.startswith("---"):
        s.sub(None, FRONT, lambda m: s.keep(m[0]))
    for step in (_code, _raw_html, _formulas, _latex, _wiki, _markdown, _tags):
        step(s)
    clean = s.restore()
    if s.found:
        clean = re.sub(r"[ \t]+\n", "\n", clean)
        clean = re.sub(r"\n{3,}", "\n\n", clean).strip()
    return head + clean, [f for f in FAMILIES if f in s.found]


SCANNED = StructType([StructField("text", StringType()), StructField("kinds", ArrayType(StringType()))])


@F.pandas_udf(SCANNED)
def _scanned(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, titles in batches:
        rows = [scan(t, n) for t, n in zip(texts, titles)]
        yield pd.DataFrame({"text": [r[0] for r in rows], "kinds": [r[1] for r in rows]})


def clean_text(df: DataFrame, id_col: str, text_col: str, title_col: str | None = None) -> DataFrame:
    """(id, text, kinds): each row's text without markup, and the families of markup it held.

    Headings become ``#`` lines, items ``-`` or numbered lines, code stays between backticks
    and formulas between dollars; link and image texts stay, addresses, comments, scripts,
    templates and tags go. A null text stays null. Rows repeated in full come out once.
    """
    title: Column = F.col(title_col) if title_col else F.lit(None).cast("string")
    parsed = df.select(F.col(id_col).alias("id"), _scanned(F.col(text_col), title).alias("s"))
    return parsed.select("id", "s.text", "s.kinds")
