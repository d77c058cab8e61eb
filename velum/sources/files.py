"""Formats, plain text and Markdown scans, and DOCX and ODT containers."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree as ET
from xml.parsers import expat
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions.lexicons import ALLOWED_SUFFIXES, FORMATS
from velum.functions.text import QUOTES_FROM, QUOTES_TO, WS, page_count, trim_all, unified_breaks


def suffix(path: Column) -> Column:
    return F.lower(F.element_at(F.split(path, r"\."), -1))


def detect_format(path: Column) -> Column:
    """Format by the last suffix; anything unknown is text."""
    return F.coalesce(F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])[suffix(path)], F.lit("txt"))


def allowed(path: Column) -> Column:
    return F.coalesce(path.contains(".") & suffix(path).isin(*ALLOWED_SUFFIXES), F.lit(False))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 where they are not."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def strip_markdown(c: Column) -> Column:
    """Text without Markdown's marks, rule by rule in the order results depend on."""
    rules = [
        (f"(?m)^#{{1,6}}{WS}+", ""), (r"\*{1,3}([^*\n]+)\*{1,3}", "$1"), (r"_{1,3}([^_\n]+)_{1,3}", "$1"), (r"`([^`]+)`", "$1"), (r"```[\s\S]*?```", ""),
        (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"!\[([^\]]*)\]\([^)]*\)", "$1"), (f"(?m)^>{WS}?", ""), (f"(?m)^{WS}*[-*+]{WS}+", ""), (f"(?m)^{WS}*\\d+\\.{WS}+", ""),
        (f"(?m)^[-*_]{{3,}}{WS}*$", ""), (r"\n{3,}", "\n\n"),
    ]
    for pattern, new in rules:
        c = F.regexp_replace(c, pattern, new)
    return trim_all(c)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files under a path, of any number."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_TEXT = "{urn:oasis:names:tc:opendocument:xmlns:text:1.0}"
_OFFICE = "{urn:oasis:names:tc:opendocument:xmlns:office:1.0}"


def docx_text(content: bytes) -> tuple[str, int]:
    """(paragraphs joined by line breaks, pages) of a DOCX file; raises ValueError for anything else."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ET.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
        raise ValueError(f"no DOCX file: {e}") from e
    out = []
    for p in root.iter(f"{_W}p"):
        text = "".join("\t" if t.tag == f"{_W}tab" else t.text or "" for t in _own(p) if t.tag in (f"{_W}t", f"{_W}tab"))
        if text.strip():
            out.append(text.strip())
    pages = 1 + sum(b.get(f"{_W}type") == "page" for b in root.iter(f"{_W}br"))
    return "\n".join(out), pages


def _own(p: ET.Element) -> Iterator[ET.Element]:
    """The elements of a paragraph, without those of paragraphs inside it (text boxes), which stand for themselves."""
    for child in p:
        if child.tag != f"{_W}p":
            yield child
            yield from _own(child)


def _odt_inline(node: ET.Element) -> str:
    out = node.text or ""
    for child in node:
        if child.tag in (f"{_TEXT}line-break", f"{_TEXT}tab"):
            out += " "
        elif child.tag == f"{_TEXT}s":
            out += " " * int(child.get(f"{_TEXT}c", "1"))
        else:
            out += _odt_inline(child)
        out += child.tail or ""
    return out


def odt_text(content: bytes) -> tuple[str, int]:
    """(paragraphs and headings in document order, lists included; pages by length) of an ODT file."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ET.fromstring(z.read("content.xml"))
    except (zipfile.BadZipFile, KeyError, ET.ParseError) as e:
        raise ValueError(f"no ODT file: {e}") from e
    body = root.find(f".//{_OFFICE}text")
    if body is None:
        raise ValueError("no ODT file: it has no text body")
    parts = [_odt_inline(p).strip() for p in body.iter() if p.tag in (f"{_TEXT}p", f"{_TEXT}h")]
    text = "\n".join(p for p in parts if p)
    return text, max(1, -(-len(text) // 3000))


def read_containers(files: DataFrame) -> DataFrame:
    """(path, text, page_count, warnings, error) of files(path, content) in DOCX or ODT.

    A bad file gives an error, no failure; one without any text a warning.
    """

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    text, pages = (docx_text if path.lower().endswith(".docx") else odt_text)(bytes(content))
                    rows.append((path, text, pages, [] if text else ["no text in its body"], None))
                except Exception as e:  # noqa: BLE001 - whatever is wrong with one file is a row of the result
                    rows.append((path, None, None, [], str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "text", "page_count", "warnings", "error"]).astype({"page_count": "Int32"})

    return files.select("path", "content").mapInPandas(read, "path string, text string, page_count int, warnings array<string>, error string")


def parse(files: DataFrame) -> DataFrame:
    """(path, format, text, page_count, warnings, error) of files(path, content).

    PDF and image bytes need a reader of their own: their text comes from tables of tokens and pages (sources.pdf).
    """
    columns = ("path", "format", "text", "page_count", "warnings", "error")
    none, no_text = F.array().cast("array<string>").alias("warnings"), F.lit(None).cast("string")
    known = files.withColumn("format", detect_format(F.col("path")))
    ok = known.filter(allowed(F.col("path")))
    plain = ok.filter("format in ('txt', 'markdown')").withColumn("raw", unified_breaks(decoded(F.col("content"))))
    text = F.when(F.col("format") == "markdown", strip_markdown(F.col("raw"))).otherwise(F.col("raw"))
    texts = plain.select("path", "format", text.alias("text")).select("path", "format", "text", page_count(F.col("text")).alias("page_count"), none, no_text.alias("error"))
    packed = read_containers(ok.filter("format in ('docx', 'odt')")).withColumn("format", detect_format(F.col("path"))).select(*columns)
    other = known.filter(~allowed(F.col("path")) | F.col("format").isin("pdf", "image")).select(
        "path", "format", no_text.alias("text"), F.lit(None).cast("int").alias("page_count"), none,
        F.when(allowed(F.col("path")), F.lit("needs a table of tokens or pages")).otherwise(F.lit("suffix not allowed")).alias("error"),
    )
    return texts.unionByName(packed).unionByName(other)


class _Slot:
    """A stretch of character data in a part's bytes: [start, end), its text, and where its element's start tag ends."""

    __slots__ = ("start", "end", "text", "tag_end", "new")

    def __init__(self, start: int, text: str, tag_end: int) -> None:
        self.start, self.end, self.text, self.tag_end, self.new = start, start, text, tag_end, None


def _slots(raw: bytes, docx: bool) -> list[list[_Slot]]:
    """The stretches of text of each paragraph, in order; those of a paragraph inside another stand for themselves."""
    parser = expat.ParserCreate(namespace_separator=" ")
    marks = (f"{_W[1:-1]} p",) if docx else (f"{_TEXT[1:-1]} p", f"{_TEXT[1:-1]} h")
    leaf = f"{_W[1:-1]} t"
    found: list[list[_Slot]] = []
    open_: list[list[_Slot]] = []
    stack: list[tuple[str, int]] = []
    current: list[_Slot] = []  # the stretch being read, if any
    opened = [-1]  # where a CDATA section begins

    def close() -> None:
        if current:
            current.pop().end = parser.CurrentByteIndex

    def start(name: str, _attributes: dict) -> None:
        close()
        if name in marks:
            open_.append([])
            found.append(open_[-1])
        stack.append((name, parser.CurrentByteIndex))

    def end(name: str) -> None:
        close()
        stack.pop()
        if name in marks:
            open_.pop()

    def data(text: str) -> None:
        if not open_ or docx and stack[-1][0] != leaf:
            return
        if current:
            current[0].text += text
        else:
            at = opened[0] if opened[0] >= 0 else parser.CurrentByteIndex
            current.append(_Slot(at, text, stack[-1][1]))
            open_[-1].append(current[0])

    def cdata(begins: bool) -> None:
        opened[0] = parser.CurrentByteIndex if begins else -1

    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, data
    parser.StartCdataSectionHandler, parser.EndCdataSectionHandler = lambda: cdata(True), lambda: cdata(False)
    parser.CommentHandler = parser.ProcessingInstructionHandler = lambda *_: close()
    parser.Parse(raw, True)
    return found


_PLAIN = str.maketrans(QUOTES_FROM, QUOTES_TO)


def _rewrite(slots: list[_Slot], pairs: list[tuple[str, str]]) -> int:
    """Rewrites the hits in a paragraph: the first stretch of a hit takes the pseudonym, the others lose their part."""
    whole = "".join(s.text for s in slots)
    view = whole.translate(_PLAIN)
    low = "".join(c if len(x := c.lower()) != 1 else x for c in view)  # as long as the text, letter by letter
    taken: list[tuple[int, int, str]] = []
    for original, pseudonym in sorted(pairs, key=lambda x: -len(x[0])):
        key, at = "".join(c if len(x := c.lower()) != 1 else x for c in original.translate(_PLAIN)), 0
        while key and (at := low.find(key, at)) >= 0:
            end = at + len(key)
            if not any(s < end and at < e for s, e, _ in taken):
                taken.append((at, end, pseudonym))
            at = end
    if taken:
        at = 0
        for slot in slots:
            new, upto = "", at
            for s, e, pseudonym in sorted(taken):
                if s < at + len(slot.text) and e > at:
                    new += whole[upto : max(s, at)] + (pseudonym if s >= at else "")
                    upto = min(e, at + len(slot.text))
            if upto > at:
                slot.new = new + whole[upto : at + len(slot.text)]
            at += len(slot.text)
    return len(taken)


def redact_container(path: str, content: bytes, pairs: list[tuple[str, str]]) -> tuple[bytes, int]:
    """A DOCX or ODT file with the hits of (original, pseudonym) pairs rewritten, and their number.

    Hits are sought in each paragraph's whole text, longest first and without overlaps. Only the bytes of the stretches
    with hits change: namespaces, declarations and all other markup stay as they are.
    """
    docx = path.lower().endswith(".docx")
    part = "word/document.xml" if docx else "content.xml"
    src = zipfile.ZipFile(io.BytesIO(content))
    raw = src.read(part)
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        raw = re.sub(r"^<\?xml[^>]*\?>", '<?xml version="1.0" encoding="UTF-8"?>', raw.decode("utf-16")).encode()
    total, changed = 0, []
    for slots in _slots(raw, docx):
        total += _rewrite(slots, pairs)
        changed += [s for s in slots if s.new is not None]
    for s in sorted(changed, key=lambda s: -s.start):
        raw = raw[: s.start] + escape(s.new).encode() + raw[s.end :]
        tag = raw[s.tag_end : s.start]
        if docx and s.new != s.new.strip() and b"xml:space" not in tag and tag.endswith(b">"):
            raw = raw[: s.start - 1] + b' xml:space="preserve">' + raw[s.start :]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for info in src.infolist():
            z.writestr(info, raw if info.filename == part else src.read(info.filename))
    return out.getvalue(), total


def redact_containers(files: DataFrame, entities: DataFrame) -> DataFrame:
    """(path, output_path, content, entities_replaced, error) of DOCX and ODT files(path, content).

    entities(path, original_text, pseudonym, confirmed); one bad file gives an error row.
    """
    from velum.operators.redact import output_path

    per_file = entities.filter("confirmed and original_text <> ''").groupBy("path").agg(F.collect_list(F.struct("original_text", F.coalesce("pseudonym", F.lit("")).alias("pseudonym"))).alias("pairs"))

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content, pairs in zip(pdf["path"], pdf["content"], pdf["pairs"], strict=True):
                try:
                    data, n = redact_container(path, bytes(content), [(p["original_text"], p["pseudonym"]) for p in (pairs if pairs is not None else [])])
                    rows.append((path, data, n, None))
                except Exception as e:  # noqa: BLE001 - whatever is wrong with one file is a row of the result
                    rows.append((path, None, None, f"not rewritten: {e}"))
            yield pd.DataFrame(rows, columns=["path", "content", "entities_replaced", "error"]).astype({"entities_replaced": "Int32"})

    out = files.join(per_file, "path", "left").select("path", "content", "pairs").mapInPandas(write, "path string, content binary, entities_replaced int, error string")
    return out.select("path", output_path("path").alias("output_path"), "content", "entities_replaced", "error")


def redact_texts(files: DataFrame, entities: DataFrame, mode: str = "compat") -> DataFrame:
    """(path, output_path, text, entities_replaced) of TXT and Markdown files(path, content), rewritten as they stand.

    Line ends and Markdown's marks are kept: a name across a line end or a mark is not found. entities(path, seq,
    original_text, pseudonym, confirmed).
    """
    from velum.operators.redact import output_path, redact

    plain = files.filter(detect_format(F.col("path")).isin("txt", "markdown") & allowed(F.col("path")))
    docs = plain.select(F.col("path").alias("doc_id"), decoded(F.col("content")).alias("text"))
    out = redact(docs, entities.withColumnRenamed("path", "doc_id"), mode).withColumnRenamed("doc_id", "path")
    return out.select("path", output_path("path").alias("output_path"), "text", "entities_replaced")


def write_texts(outputs: DataFrame, folder: str) -> None:
    """Writes outputs(output_path, text) as UTF-8 files of their own name under `folder`, one task a partition.

    `folder` is a URI of a file system that all executors reach, or a path of one mounted on all of them. A file appears
    whole: it is written under another name first, so a task may be run again.
    """
    from velum.sources.tables import is_local

    uri = folder if "://" in folder else "file://" + folder.removeprefix("file:")
    if uri.startswith("file://") and not is_local(outputs.sparkSession):
        shared = outputs.sparkSession.sparkContext.getConf().get("spark.checkpoint.dir", "")
        if not shared.removeprefix("file://").removeprefix("file:") or not uri.removeprefix("file://").startswith(shared.removeprefix("file://").removeprefix("file:")):
            raise ValueError("on a cluster, name a folder under spark.checkpoint.dir or on a shared file system")

    def write(rows: Iterable) -> None:
        import uuid

        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(uri)
        system.create_dir(root, recursive=True)
        for r in rows:
            name = r.output_path.rsplit("/", 1)[-1]
            part = f"{root}/.{name}.{uuid.uuid4().hex}"
            with system.open_output_stream(part) as out:
                out.write((r.text or "").encode())
            system.move(part, f"{root}/{name}")

    outputs.select("output_path", "text").foreachPartition(write)
