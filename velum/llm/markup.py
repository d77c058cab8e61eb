"""Clean text from documents with markup (problem 6): HTML, Markdown, wiki text and LaTeX, by tag-path ratios.

Every dialect is read into leaves: (path from the root, kind, text). Per root-to-leaf path the lengths of text outside
links and its punctuation are summed and divided by the path's leaves; both ratios are smoothed over the paths that
stand side by side and fused, and a path whose score falls under the deviation of the page's scores is no content: navigation,
link lists, boilerplate. Code and formulas are judged by the best of their path and the subtree around it, headings by
the section they head.
"""

from __future__ import annotations

import html
import math
import re
import statistics
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from velum.sources.tables import latest, load, spread

#: Weight of the neighbouring paths in the smoothing, and of the page's mean in a path's ratios (in leaves); deviations of the page's scores under which a path is no content.
SMOOTH, PRIOR, THRESHOLD = 0.15, 0.05, 1.0


class Leaf(NamedTuple):
    path: str
    kind: str  # heading, item, code, formula or text
    text: str
    linked: int = 0  # characters inside links


MARKS = frozenset(".,;:!?…。、，；：！？।؟،")
_DISPLAY = re.compile(r"\$\$(.+?)\$\$|\\\[(.+?)\\\]|\\\((.+?)\\\)", re.S)
_INLINE = re.compile(r"(?<![\\$\w])\$(?![\s$])([^$\n]*?[^\s$\\])\$(?![\d$])")


def _flat(text: str) -> str:
    return " ".join(text.split())


def _bare(text: str) -> str:
    return text.strip("\r\n")


def dialect(text: str) -> str:
    """The markup that a text is written in, by its telling marks; plain text counts as Markdown."""
    marks = {
        "html": len(re.findall(r"(?i)</?(?:p|div|h[1-6]|ul|ol|li|br|a|b|i|em|strong|span|html|body|table|td|tr)\b[^>]*>", text)) + 0.5 * len(re.findall(r"&(?:[a-z]{2,8}|#\d+);", text)),
        "wiki": 2 * len(re.findall(r"(?m)^={1,6}[^=\n].*?={1,6}\s*$", text)) + len(re.findall(r"'''|''|\[\[[^\]\n]+\]\]|\{\{[^}\n]+\}\}", text)) + 2 * len(re.findall(r"<(?:math|source|syntaxhighlight|ref|nowiki)\b", text)),
        "latex": 2 * len(re.findall(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph|begin|end|item|documentclass|textbf|textit|emph|itshape|bfseries|usepackage|maketitle)\b", text)),
        "markdown": len(re.findall(r"(?m)^(?:#{1,6}[ \t]|```|~~~|=+[ \t]*$|-{3,}[ \t]*$)|\]\((?:https?:|/|#)|\*\*", text)),
    }
    best = max(marks, key=lambda k: (marks[k], k == "markdown"))
    if best == "html" and re.search(r"(?m)^(?:#{1,6}[ \t]+\S|```|~~~)", re.sub(r"(?is)<pre\b.*?</pre>", "", text)):
        return "markdown"  # whose reader takes blocks of HTML as such
    return best if marks[best] else "markdown"


def _formulas(text: str, inline: bool = True) -> tuple[str, list[str]]:
    """Text with its formulas taken out (as \\x00 n \\x00), and they."""
    found: list[str] = []

    def keep(m: re.Match[str]) -> str:
        found.append(next(g for g in m.groups() if g is not None).strip())
        return f"\x00{len(found) - 1}\x00"

    text = _DISPLAY.sub(keep, text)
    if inline:
        text = _INLINE.sub(lambda m: keep(m) if re.search(r"[\\^_=+]|^[A-Za-z]$", m.group(1)) else m.group(), text)
    return text, found


def _put_back(text: str, found: list[str]) -> str:
    return re.sub("\x00(\\d+)\x00", lambda m: found[int(m.group(1))], text)


# --- Markdown


def _md_inline(s: str) -> str:
    held: list[str] = []

    def hold(x: str) -> str:
        held.append(x)
        return f"\x01{len(held) - 1}\x01"

    s = re.sub(r"(`+)(.+?)\1(?!`)", lambda m: hold(m.group(2).strip()), s)
    s = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: hold(m.group(1)), s)
    s = re.sub(r"!\[([^\]]*)\]\([^)\s]*(?:\s+\"[^\"]*\")?\)", r"\1", s)
    s = re.sub(r"\[([^\]]*)\]\([^)\s]*(?:\s+\"[^\"]*\")?\)", r"\1", s)
    s = re.sub(r"\[([^\]]+)\]\[[^\]]*\]", r"\1", s)
    s = re.sub(r"<(https?://[^>\s]+)>", r"\1", s)
    for mark in (r"\*\*\*", r"\*\*", r"\*", "~~"):
        s = re.sub(rf"{mark}(?!\s)(.+?)(?<!\s){mark}", r"\1", s, flags=re.S)
    for mark in ("___", "__", "_"):
        s = re.sub(rf"(?<!\w){mark}(?!\s)(.+?)(?<!\s){mark}(?!\w)", r"\1", s, flags=re.S)
    s = re.sub(r"</?(?:b|i|em|strong|br|sub|sup|u)\s*/?>", "", s, flags=re.I)
    s = html.unescape(s)
    return re.sub("\x01(\\d+)\x01", lambda m: held[int(m.group(1))], s)


#: Elements that begin a block of HTML inside Markdown.
_HTML_BLOCK = re.compile(r"^ {0,3}<(div|p|ul|ol|h[1-6]|table|section|article|nav|aside|header|footer|main|dl|figure)\b[^>]*>", re.I)
_ITEM = re.compile(r"^(\s*)(?:[-*+]|\d{1,9}[.)])[ \t]+(\S.*)$")


def markdown(text: str) -> Iterator[Leaf]:
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    i, n = 0, len(lines)
    if n > 2 and lines[0].strip() == "---" and "---" in (x.strip() for x in lines[1:40]):
        head = next(k for k in range(1, n) if lines[k].strip() == "---")
        if head > 1 and all(":" in x or x.startswith((" ", "-")) for x in lines[1:head]):
            i = head + 1
    para: list[str] = []

    def flush() -> Iterator[Leaf]:
        if para:
            body, found = _formulas("\n".join(para))
            linked = sum(len(m) for m in re.findall(r"\[([^\]]*)\]\(", body))
            for k, piece in enumerate(re.split("\x00(\\d+)\x00", body)):
                if k % 2:
                    yield Leaf("md/formula", "formula", found[int(piece)])
                elif piece.strip():
                    yield Leaf("md/p", "text", _md_inline(piece).strip(), linked)
            para.clear()

    while i < n:
        line = lines[i]
        if m := re.match(r"^ {0,3}(`{3,}|~{3,})", line):
            yield from flush()
            fence = m.group(1)
            code = []
            i += 1
            while i < n and not re.match(rf"^ {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}\s*$", lines[i]):
                code.append(lines[i])
                i += 1
            yield Leaf("md/pre", "code", _bare("\n".join(code)))
            i += 1
        elif not para and (m := _HTML_BLOCK.match(line)):
            # to the line that closes the element, or to the end
            tag = re.compile(rf"<(/?){m.group(1)}\b", re.I)
            depth, first = 0, i
            while i < n:
                depth += sum(-1 if x.group(1) else 1 for x in tag.finditer(lines[i]))
                i += 1
                if depth <= 0:
                    break
            yield from (x._replace(path="md/" + x.path) for x in html_leaves("\n".join(lines[first:i])))
        elif m := re.match(r"^ {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", line):
            yield from flush()
            yield Leaf("md/h", "heading", _flat(_md_inline(m.group(1) or "")))
            i += 1
        elif re.match(r"^ {0,3}(?:=+|-+)\s*$", line) and para and not _ITEM.match(para[-1]):
            title = "\n".join(para)
            para.clear()
            yield Leaf("md/h", "heading", _flat(_md_inline(title)))
            i += 1
        elif re.match(r"^ {0,3}(?:(?:-\s*){3,}|(?:\*\s*){3,}|(?:_\s*){3,})$", line):
            yield from flush()
            i += 1
        elif not para and re.match(r"^(?: {4}|\t)\S", line):
            code = []
            while i < n and (re.match(r"^(?: {4}|\t)", lines[i]) or not lines[i].strip()):
                code.append(re.sub(r"^(?: {4}|\t)", "", lines[i]))
                i += 1
            yield Leaf("md/pre", "code", _bare("\n".join(code)).rstrip())
        elif m := (_ITEM.match(line) if not para or not re.match(r"^\s*\d+[.)]", line) or re.match(r"^\s*1[.)]", line) else None):
            yield from flush()
            item = [m.group(2)]
            i += 1
            while i < n and lines[i].strip() and not _ITEM.match(lines[i]) and not re.match(r"^ {0,3}(?:#{1,6}[ \t]|```|~~~)", lines[i]):
                item.append(lines[i].strip())
                i += 1
            body, found = _formulas("\n".join(item))
            yield Leaf("md/ul/li", "item", _flat(_put_back(_md_inline(body), found)), sum(len(x) for x in re.findall(r"\[([^\]]*)\]\(", body)))
            for f in found:
                yield Leaf("md/ul/li/formula", "formula", f)
        elif not line.strip():
            if sum(x.count("$$") for x in para) % 2:
                para.append(line)
            else:
                yield from flush()
            i += 1
        else:
            para.append(re.sub(r"^ {0,3}> ?", "", line))
            i += 1
    yield from flush()


# --- HTML

_BLOCK = {"p", "div", "section", "article", "header", "footer", "nav", "aside", "main", "table", "tr", "td", "th", "blockquote", "body", "ul", "ol", "dl", "dd", "dt", "form", "figure", "hr", "html"}
_SKIP = {"head", "style", "script", "title", "noscript", "template"}
_VOID = {"br", "hr", "img", "meta", "link", "input", "col", "wbr"}


class _Html(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.leaves: list[Leaf] = []
        self.stack: list[str] = []
        self.text: list[str] = []
        self.linked = 0
        self.kind = "text"
        self.math = False

    def flush(self) -> None:
        raw = "".join(self.text)
        kind, linked = self.kind, self.linked
        self.text, self.linked = [], 0
        path = "/".join(self.stack) or "html"
        if kind == "code":
            if raw.strip():
                self.leaves.append(Leaf(path, "code", _bare(raw)))
            return
        body, found = _formulas(raw, inline=False)
        if kind in ("heading", "item"):
            if t := _flat(_put_back(body, found)):
                self.leaves.append(Leaf(path, kind, t, linked))
            self.leaves += [Leaf(path + "/formula", "formula", f) for f in found]
            return
        for k, piece in enumerate(re.split("\x00(\\d+)\x00", body)):
            if k % 2:
                self.leaves.append(Leaf(path + "/formula", "formula", found[int(piece)]))
            elif t := "\n".join(x for x in (_flat(y) for y in piece.split("\n")) if x):
                self.leaves.append(Leaf(path, "text", t, linked))

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append("\n")
            return
        if tag in _VOID:
            return
        if re.fullmatch(r"h[1-6]|li|pre|math", tag) or tag in _BLOCK:
            if not (tag == "math" and self.kind in ("heading", "item")):
                self.flush()
            if tag == "li":
                self._close_to("li", ("ul", "ol"))
            elif tag == "p" or re.fullmatch(r"h[1-6]", tag):
                self._close_to("p", ("div", "body", "section", "article", "li", "td"))
        self.stack.append(tag)
        if tag == "script" and any(k == "type" and (v or "").startswith("math/") for k, v in attrs):
            self.math = True
        self._set_kind()

    def _close_to(self, tag: str, until: tuple[str, ...]) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k] in until:
                return
            if self.stack[k] == tag:
                del self.stack[k:]
                return

    def _set_kind(self) -> None:
        self.kind = "text"
        for t in self.stack:
            if t == "pre":
                self.kind = "code"
                return
            if t == "li":
                self.kind = "item"
            elif t in ("ul", "ol") and self.kind == "item":
                self.kind = "text"
            elif re.fullmatch(r"h[1-6]", t):
                self.kind = "heading"

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.stack:
            return
        if re.fullmatch(r"h[1-6]|li|pre|math", tag) or tag in _BLOCK:
            self.flush()
        if tag == "script":
            self.math = False
        while self.stack and self.stack.pop() != tag:
            pass
        self._set_kind()

    def handle_data(self, data: str) -> None:
        if self.math:
            self.leaves.append(Leaf("/".join(self.stack), "formula", data.strip()))
        elif "math" in self.stack:
            self.leaves.append(Leaf("/".join(self.stack), "formula", data.strip())) if data.strip() else None
        elif not any(t in _SKIP for t in self.stack):
            self.text.append(data if self.kind == "code" else data.replace("\xa0", " "))
            if "a" in self.stack:
                self.linked += len(data.strip())


def html_leaves(text: str) -> Iterator[Leaf]:
    parser = _Html()
    parser.feed(text.replace("\r\n", "\n").replace("\r", "\n"))
    parser.close()
    parser.flush()
    yield from parser.leaves


# --- wiki text


def _wiki_inline(s: str) -> str:
    s = re.sub(r"<!--.*?-->", "", s, flags=re.S)
    s = re.sub(r"<ref\b[^>]*/>|<ref\b[^>]*>.*?</ref>", "", s, flags=re.S | re.I)
    while (t := re.sub(r"\{\{[^{}]*\}\}", "", s)) != s:
        s = t
    s = re.sub(r"\[\[(?:File|Image|Immagine|Categoria|Category)\s*:[^\]]*\]\]", "", s, flags=re.I)
    s = re.sub(r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", r"\1", s)
    s = re.sub(r"\[https?://\S+\s+([^\]]+)\]", r"\1", s)
    s = re.sub(r"\[https?://\S+\]", "", s)
    s = re.sub(r"'{2,5}", "", s)
    s = re.sub(r"<br\s*/?>", "\n", s, flags=re.I)
    s = re.sub(r"</?(?:nowiki|small|big|sup|sub|b|i|u|em|strong|code|tt|span|div|p|center|blockquote|poem)\b[^>]*>", "", s, flags=re.I)
    return html.unescape(s).replace("\xa0", " ")


def wiki(text: str) -> Iterator[Leaf]:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    held: list[Leaf] = []

    def hold(kind: str, body: str) -> str:
        held.append(Leaf("wiki/" + kind, kind, body))
        return f"\x02{len(held) - 1}\x02"

    text = re.sub(r"<(pre|source|syntaxhighlight)\b[^>]*>(.*?)</\1>", lambda m: "\n" + hold("code", _bare(html.unescape(m.group(2)) if m.group(1).lower() == "pre" else m.group(2))) + "\n", text, flags=re.S | re.I)
    text = re.sub(r"<!--.*?-->", "", text, flags=re.S)
    text = re.sub(r"<math\b[^>]*>(.*?)</math>", lambda m: hold("formula", html.unescape(m.group(1)).strip()), text, flags=re.S | re.I)
    para: list[str] = []

    def flush() -> Iterator[Leaf]:
        if para:
            raw = "\n".join(para)
            para.clear()
            linked = sum(len(x.split("|")[-1]) for x in re.findall(r"\[\[([^\]]*)\]\]", raw))
            for k, piece in enumerate(re.split("\x02(\\d+)\x02", raw)):
                if k % 2:
                    yield held[int(piece)]
                elif t := _wiki_inline(piece).strip():
                    yield Leaf("wiki/p", "text", t, linked)

    for line in text.split("\n"):
        if m := re.match(r"^(={1,6})\s*(.+?)\s*\1\s*$", line):
            yield from flush()
            if t := _flat(_wiki_inline(m.group(2))):
                yield Leaf(f"wiki/h{len(m.group(1))}", "heading", t)
        elif m := re.match(r"^([*#:;]*[*#])[:;]*\s*(.*)$", line):
            yield from flush()
            body = m.group(2)
            ids = re.findall("\x02(\\d+)\x02", body)
            body = re.sub("\x02(\\d+)\x02", lambda x: held[int(x.group(1))].text, body)
            if t := _flat(_wiki_inline(body)):
                yield Leaf("wiki/" + "/".join("ul" if c == "*" else "ol" for c in m.group(1)) + "/li", "item", t, sum(len(x.split("|")[-1]) for x in re.findall(r"\[\[([^\]]*)\]\]", body)))
            for k in ids:
                yield held[int(k)]
        elif not line.strip():
            yield from flush()
        else:
            para.append(re.sub(r"^[:;]+\s*", "", line))
    yield from flush()


# --- LaTeX

_ACCENTS = {"`": "̀", "'": "́", "^": "̂", '"': "̈", "~": "̃", "c": "̧"}
_VERBATIM = "verbatim|lstlisting|minted|Verbatim|alltt"
_MATH = r"equation|align|gather|multline|displaymath|math|eqnarray"


def _braced(s: str, at: int) -> int:
    """Place after the brace that closes the one at `at`."""
    depth, i = 0, at
    while i < len(s):
        if s[i] == "\\":
            i += 2
            continue
        if s[i] == "{":
            depth += 1
        elif s[i] == "}":
            depth -= 1
            if not depth:
                return i + 1
        i += 1
    return len(s)


def _tex_inline(s: str) -> str:
    s = re.sub(r"\\euro\b(?:\{\})?", "€", s)
    s = re.sub(r"\\(?:ldots|dots)\b(?:\{\})?", "…", s)
    s = re.sub(r"\\S\b(?:\{\})?", "§", s)
    s = re.sub(r"\\([`'^\"~])\s*\{?\\?([A-Za-z])\}?", lambda m: unicodedata.normalize("NFC", m.group(2) + _ACCENTS[m.group(1)]), s)
    s = re.sub(r"\\(?:footnote|label|ref|cite|index)\*?(?:\[[^\]]*\])?\{[^{}]*\}", "", s)
    s = re.sub(r"\\href\{[^{}]*\}", "", s)
    s = re.sub(r"\\\\(?:\[[^\]]*\])?|\\newline\b", "\n", s)
    held: list[str] = []

    def hold(m: re.Match[str]) -> str:
        held.append(m.group(1))
        return f"\x01{len(held) - 1}\x01"

    s = re.sub(r"\\([#$%&_{}])", hold, s)
    s = re.sub(r"\\textbackslash\b(?:\{\})?", r"\\", s)
    s = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]]*\])?", "", s)
    s = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]]*\])?(?:\{\})?[ \t]*(?=\{)?", "", s)
    s = re.sub(r"\\[,;:! ]", " ", s)
    s = s.replace("~", " ").replace("{", "").replace("}", "").replace("---", "—").replace("``", "“").replace("''", "”")
    return re.sub("\x01(\\d+)\x01", lambda m: held[int(m.group(1))], s)


def latex(text: str) -> Iterator[Leaf]:
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    held: list[Leaf] = []

    def hold(kind: str, body: str) -> str:
        held.append(Leaf("tex/" + kind, kind, body))
        return f"\x02{len(held) - 1}\x02"

    text = re.sub(rf"\\begin\{{({_VERBATIM})\}}(?:\[[^\]\n]*\])?(?:\{{[^}}\n]*\}})?(.*?)\\end\{{\1\}}", lambda m: hold("code", _bare(m.group(2))), text, flags=re.S)
    text = re.sub(r"(?<!\\)%.*", "", text)
    if m := re.search(r"\\begin\{document\}", text):
        text = text[m.end() :]
    text = re.sub(r"\\end\{document\}.*", "", text, flags=re.S)
    text = re.sub(r"\\(?:documentclass|usepackage|title|author|date|maketitle|tableofcontents)\b(?:\[[^\]]*\])?(?:\{[^{}]*\})?", "", text)
    text = re.sub(rf"\\begin\{{((?:{_MATH})\*?)\}}(.*?)\\end\{{\1\}}", lambda m: hold("formula", m.group(2).strip()), text, flags=re.S)
    text = re.sub(r"\\\[(.+?)\\\]|\\\((.+?)\\\)|(?<!\\)\$\$(.+?)(?<!\\)\$\$", lambda m: hold("formula", next(g for g in m.groups() if g is not None).strip()), text, flags=re.S)
    text = re.sub(r"(?<!\\)\$([^$\n]+?)(?<!\\)\$", lambda m: hold("formula", m.group(1).strip()), text)
    at, depth = 0, 0
    token = re.compile(r"\\(?:part|chapter|(?:sub){0,2}section|(?:sub)?paragraph)\*?(?:\[[^\]]*\])?(?=\{)|\\item\b(?:\[[^\]]*\])?|\\(begin|end)\{(itemize|enumerate|description)\}(?:\[[^\]]*\])?")

    def plain(chunk: str, item: bool) -> Iterator[Leaf]:
        if item:
            # a blank line in an item parts it from text that follows the list
            ids = re.findall("\x02(\\d+)\x02", chunk)
            body = re.sub("\x02(\\d+)\x02", lambda x: held[int(x.group(1))].text if held[int(x.group(1))].kind == "formula" else "", chunk)
            if t := _flat(_tex_inline(body)):
                yield Leaf("tex/list/item", "item", t)
            for k in ids:
                yield held[int(k)]
            return
        for k, piece in enumerate(re.split("\x02(\\d+)\x02", chunk)):
            if k % 2:
                yield held[int(piece)]
            else:
                for part in re.split(r"\n\s*\n", piece):
                    if t := _tex_inline(part).strip():
                        yield Leaf("tex/p", "text", t)

    item = False
    while m := token.search(text, at):
        yield from plain(text[at : m.start()], item)
        at = m.end()
        word = m.group()
        item = False
        if word.startswith("\\item"):
            item = True
        elif m.group(1):
            depth += 1 if m.group(1) == "begin" else -1
        else:
            end = _braced(text, at)
            title = re.sub("\x02(\\d+)\x02", lambda x: held[int(x.group(1))].text, text[at + 1 : end - 1])
            if t := _flat(_tex_inline(title)):
                yield Leaf("tex/section", "heading", t)
            at = end
    yield from plain(text[at:], item)


READERS = {"markdown": markdown, "html": html_leaves, "wiki": wiki, "latex": latex}


def path_scores(leaves: list[Leaf]) -> dict[str, float]:
    """The fused score of each path: logarithms of its text and punctuation a leaf, smoothed over the paths beside it.

    Text inside links counts for neither, so a path of nothing but links has no text of its own.
    """
    size, marks, count = defaultdict(float), defaultdict(float), defaultdict(int)
    beside: dict[str, set[str]] = defaultdict(set)
    for x, after in zip(leaves, [*leaves[1:], None], strict=True):
        own = max(0, len(x.text) - x.linked)
        size[x.path] += own
        marks[x.path] += sum(c in MARKS for c in x.text) * own / len(x.text)
        count[x.path] += 1
        if after is not None and after.path != x.path:
            beside[x.path].add(after.path)
            beside[after.path].add(x.path)

    def smooth(ratio: dict[str, float]) -> dict[str, float]:
        return {p: (1 - SMOOTH) * r + SMOOTH * sum(ratio[o] for o in beside[p]) / len(beside[p]) if beside[p] else r for p, r in ratio.items()}

    def ratio(of: dict[str, float]) -> dict[str, float]:
        mean = sum(of.values()) / len(leaves)
        return {p: math.log1p((of[p] + PRIOR * mean) / (count[p] + PRIOR)) for p in count}

    text, punctuation = smooth(ratio(size)), smooth(ratio(marks))
    return {p: text[p] + punctuation[p] for p in count}


def selected(leaves: list[Leaf]) -> list[Leaf]:
    """The leaves of content paths, by the fused ratios of the paths."""
    if not leaves:
        return []
    scores = path_scores(leaves)
    level = THRESHOLD * statistics.pstdev(scores[x.path] for x in leaves)
    around: dict[str, float] = defaultdict(float)  # the best path of each subtree
    for p, score in scores.items():
        while "/" in p:
            p = p.rsplit("/", 1)[0]
            around[p] = max(around[p], score)
    alone = Counter(x.path for x in leaves)
    kept = []
    for x in leaves:
        score = scores[x.path]
        if x.kind in ("code", "formula"):
            score = max(score, around[x.path.rsplit("/", 1)[0]])
        kept.append(score >= level or x.kind == "item" and alone[x.path] == 1)  # one item is no list of links
    # a heading stands and falls with its section; one without a section stands by itself
    section: list[bool] = []
    for i in range(len(leaves) - 1, -1, -1):
        if leaves[i].kind == "heading":
            kept[i] = any(section) if section else True
            section = []
        else:
            section.append(kept[i])
    return [x for x, k in zip(leaves, kept, strict=True) if k]


def leaves(text: str) -> list[Leaf]:
    return selected([x for x in READERS[dialect(text)](text) if x.text.strip()])


def clean(text: str) -> str:
    """Readable text: headings after #, items after -, code between fences, formulas between $$."""
    out: list[str] = []
    before = ""
    for x in leaves(text):
        body = {"heading": f"# {x.text}", "item": f"- {x.text}", "code": f"```\n{x.text}\n```", "formula": f"$${x.text}$$"}.get(x.kind, x.text)
        out.append(("\n" if before == x.kind == "item" else "\n\n" if out else "") + body)
        before = x.kind
    return "".join(out)


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, x.kind, x.text) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in leaves(t) if x.kind != "text"]
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "kind", "content"])


def _clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([clean(t) for t in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])


def structure(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, content): the distinct headings, items, code blocks and formulas of docs(doc_id, text).

    Null, empty and blank texts have none; an unclosed fence or environment reaches to the end of the text or counts
    as text; repeated rows count once.
    """
    return spread(docs.select("doc_id", "text").filter("text is not null")).mapInArrow(_find, "doc_id long, kind string, content string").distinct()


def cleaned(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of every non-null text, without markup."""
    return spread(docs.select("doc_id", "text").filter("text is not null")).mapInArrow(_clean, "doc_id long, text string")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents_in").select("doc_id", "format", "text", "loaded_at")
    return latest(docs, ["doc_id"], "loaded_at").filter("format = 'markdown'")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure(_docs(spark, sf_dir))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(_docs(spark, sf_dir))
