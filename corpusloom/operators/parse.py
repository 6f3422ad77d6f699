"""From bytes to ordered typed blocks.

A small helper per format names what a line or an element is; Spark groups, cleans,
numbers and carries sections forward. Raw blocks are rows of (doc_id, at,
block_type, text, level, page, extra); sealed blocks have their final ordinal.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import collapse, fold_lines, trim

TITLE_CHARS = 512
RAW = "array<struct<block_type:string,text:string,level:int,extra:string>>"
LINES = "array<struct<kind:string,part:int,text:string,level:int,extra:string>>"

# Which parser reads which type.
PARSERS = {
    "text/plain": "txt",
    "text/markdown": "markdown",
    "text/x-markdown": "markdown",
    "text/html": "html",
    "application/xhtml+xml": "html",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx",
    "application/pdf": "pdf",
}


def parser_name(mime: Column) -> Column:
    """Name of the parser, null where none reads the type."""
    clean = F.lower(F.trim(F.split_part(mime, F.lit(";"), F.lit(1))))
    return F.get(F.filter(F.array(*[F.when(clean == m, p) for m, p in PARSERS.items()]), lambda p: p.isNotNull()), F.lit(0))


def decode_bytes(data: Column) -> Column:
    """UTF-16 by its mark, else UTF-8 with or without a mark, else Latin-1."""
    mark = F.hex(F.substring(data, 1, 2))
    utf16 = F.when(mark.isin("FFFE", "FEFF"), F.decode(data, "UTF-16"))
    utf8 = F.when(F.is_valid_utf8(data.cast("string")), F.regexp_replace(data.cast("string"), "^﻿", ""))
    return F.coalesce(utf16, utf8, F.decode(data, "ISO-8859-1"))


def fallback_title(filename: Column, title: Column) -> Column:
    stem = trim(F.regexp_replace(F.regexp_replace(filename, r"^.*/", ""), r"(?<=.)\.[^.]*$", ""))
    named = F.when(F.coalesce(title, F.lit("")) != "", trim(title)).when(F.coalesce(stem, F.lit("")) != "", stem)
    return F.substring(F.coalesce(named, F.lit("Untitled")), 1, TITLE_CHARS)


# --- lines of text and Markdown ---------------------------------------------------

_FENCE = re.compile(r"```(\S*)\s*$")
_HEAD = re.compile(r"(#{1,6})\s+(.*)$")
_ITEM = re.compile(r"\s*(?:([-*+])|\d+[.)])\s+(.*)$")
_TABLE_RULE = re.compile(r"\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?$")


def classify_lines(text: str | None, markdown: bool = False) -> Iterator[tuple]:
    """(kind, part, text, level, extra) per line that belongs to a block; lines of one part make a block."""
    lines = (text or "").split("\n")
    part, last, i = 0, None, 0
    for i, line in enumerate(lines):
        bare = line.strip()
        if isinstance(last, tuple) and last[0] == "fence":
            if bare.startswith("```"):
                last = None
            else:
                yield "code", part, line, None, last[1]
            continue
        if bare.startswith("```") and (found := _FENCE.match(bare)):
            part, last = part + 1, ("fence", found[1])
            # A fence without lines leaves no block.
            continue
        if line.startswith("    ") and bare and not (markdown and last in ("paragraph", "ul", "ol")):
            if last != "indent":
                part, last = part + 1, "indent"
            yield "code", part, line[4:], None, ""
            continue
        if not bare:
            following = lines[i + 1] if i + 1 < len(lines) else ""
            if last == "indent" and line == "" and following.startswith("    "):
                yield "code", part, "", None, ""
            else:
                last = None
            continue
        if found := _HEAD.match(bare):
            part, last = part + 1, None
            yield "heading", part, found[2].rstrip("#").rstrip() if markdown else found[2], len(found[1]), None
            continue
        if bare.startswith(">"):
            if last != "quote":
                part, last = part + 1, "quote"
            yield "quote", part, bare[1:].removeprefix(" ") if not bare[1:2].isspace() or bare[1:2] == " " else bare[2:], None, None
            continue
        if markdown and bare.startswith("|"):
            if last != "table":
                part, last = part + 1, "table"
            if not _TABLE_RULE.match(bare):
                yield "table", part, bare, None, None
            continue
        if found := _ITEM.match(line):
            kind = "ul" if found[1] else "ol"
            if last != kind:
                part, last = part + 1, kind
            yield "list", part, found[2], None, kind
            continue
        if last != "paragraph":
            part, last = part + 1, "paragraph"
        yield "paragraph", part, bare, None, None


def _line_blocks(markdown: bool):
    @F.pandas_udf(LINES)
    def run(texts: pd.Series) -> pd.Series:
        names = ("kind", "part", "text", "level", "extra")
        return texts.map(lambda t: [dict(zip(names, x, strict=True)) for x in classify_lines(t, markdown)])

    return run


def pipe_table(rows: Column) -> Column:
    """array<array<string>> as a Markdown table; short rows are padded."""
    width = F.array_max(F.transform(rows, F.size))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    padded = F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))
    rule = F.when(F.size(rows) > 1, F.array(line(F.array_repeat(F.lit("---"), width)))).otherwise(F.array().cast("array<string>"))
    body = F.concat(F.array(line(F.get(padded, F.lit(0)))), rule, F.transform(F.slice(padded, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line))
    return F.when(F.size(rows) > 0, F.array_join(body, "\n")).otherwise("")


def inline_markdown(text: Column) -> Column:
    """Without images, link targets, emphasis and code marks."""
    for pattern, to in (
        (r"!\[[^\]]*\]\([^)]*\)", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"`+([^`]*)`+", "$1"),
        (r"\*\*(\S(?:[^*]*\S)?)\*\*", "$1"), (r"__(\S(?:[^_]*\S)?)__", "$1"), (r"\*(\S(?:[^*]*\S)?)\*", "$1"), (r"<[^>]+>", " "),
    ):
        text = F.regexp_replace(text, pattern, to)
    return text


def _from_lines(docs: DataFrame, text: Column, markdown: bool) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode(_line_blocks(markdown)(fold_lines(text))).alias("line_no", "x")).select("doc_id", "line_no", "x.*")
    said = F.when(F.col("kind").isin("code", "table"), F.col("text")).otherwise(inline_markdown(F.col("text"))) if markdown else F.col("text")
    rows = rows.withColumn("text", said)
    if markdown:
        shown = F.regexp_extract_all(F.col("x_text"), F.lit(r"!\[([^\]]*)\]\([^)]*\)"), 1)
        raw = docs.select("doc_id", F.posexplode(_line_blocks(True)(fold_lines(text))).alias("line_no", "x")).select("doc_id", "line_no", F.col("x.part").alias("part"), F.col("x.kind").alias("kind"), F.col("x.text").alias("x_text"))
        images = raw.where(~F.col("kind").isin("code", "table")).select("doc_id", (F.col("part") * 2 + 1).alias("at"), "line_no", F.explode(shown).alias("text")).where("text != ''")
        images = images.select("doc_id", "at", F.lit("image_caption").alias("block_type"), "text", F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("extra"))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    grouped = rows.groupBy("doc_id", "part", "kind").agg(ordered.alias("_l"), F.max("level").alias("level"), F.max("extra").alias("extra"))
    lines = F.transform("_l", lambda x: x["text"])
    cells = F.transform(lines, lambda r: F.transform(F.split(F.regexp_replace(r, r"^\|?\s*|\s*\|?$", ""), r"\s*\|\s*"), lambda c: F.trim(c)))
    body = F.when(F.col("kind").isin("code", "list"), F.array_join(lines, "\n")).when(F.col("kind") == "table", pipe_table(cells)).otherwise(F.array_join(lines, " "))
    out = grouped.select("doc_id", (F.col("part") * 2).alias("at"), F.col("kind").alias("block_type"), body.alias("text"), "level", "extra")
    return out.unionByName(images) if markdown else out


def text_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Raw blocks of plain text: headings, lists, quotes, code and paragraphs."""
    return _from_lines(docs, F.col(text), False)


def markdown_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Raw blocks of Markdown, with tables and captions of images."""
    return _from_lines(docs, F.col(text), True)


# --- HTML ---------------------------------------------------------------------------

_SKIPPED = frozenset("script style noscript svg iframe template".split())
_HOLDS = {"p": "paragraph", "pre": "code", "blockquote": "quote", "figcaption": "image_caption", **{f"h{i}": "heading" for i in range(1, 7)}}
_LOOSE = frozenset("body div article main section".split())
_EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Elements(HTMLParser):
    """Events of one page as raw blocks; the open element that holds text gathers it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple] = []
        self.open: list[str] = []
        self.skipping = 0
        self.held: dict | None = None
        self.captions: list[tuple] = []

    def emit(self, kind: str, text: str, level: int | None = None, extra: str | None = None) -> None:
        self.blocks.append((kind, text, level, extra))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        given = dict(attrs)
        if tag in _SKIPPED:
            self.skipping += 1
        if self.skipping:
            return
        if tag == "img":
            caption = (given.get("alt") or given.get("title") or "").strip()
            if caption and (self.held is None or self.held["tag"] == "p"):
                (self.captions if self.held else self.blocks).append(("image_caption", caption, None, None))
            return
        if tag in _EMPTY:
            return
        if self.held and self.held["tag"] == "p" and (tag in _HOLDS or tag in _LOOSE or tag in ("ul", "ol", "table")):
            self.close(self.held["tag"])
        self.open.append(tag)
        if self.held is None:
            if tag in _HOLDS or tag in ("ul", "ol", "table", "title"):
                self.held = {"tag": tag, "depth": len(self.open), "parts": [], "items": [], "rows": [], "language": ""}
        elif tag == "li" and self.held["tag"] in ("ul", "ol") and len(self.open) == self.held["depth"] + 1:
            self.held["items"].append([])
        elif self.held["tag"] == "table" and tag == "tr":
            self.held["rows"].append([])
        elif self.held["tag"] == "table" and tag in ("td", "th"):
            if self.held["rows"]:
                self.held["rows"][-1].append([])
        if self.held and self.held["tag"] == "pre" and tag in ("pre", "code") and not self.held["language"]:
            found = [c.removeprefix("language-") for c in (given.get("class") or "").split() if c.startswith("language-")]
            self.held["language"] = found[0] if found else ""

    def handle_endtag(self, tag: str) -> None:
        if tag in _SKIPPED:
            self.skipping = max(self.skipping - 1, 0)
            return
        if not self.skipping and tag in self.open:
            self.close(tag)

    def close(self, tag: str) -> None:
        while self.open:
            if self.held and self.held["depth"] == len(self.open):
                self.release()
            if self.open.pop() == tag:
                return

    def release(self) -> None:
        held, self.held = self.held, None
        tag, say = held["tag"], lambda parts: " ".join(p.strip() for p in parts if p.strip())
        if tag in ("ul", "ol"):
            items = [x for x in map(say, held["items"]) if x]
            self.emit("list", "\n".join(items), None, tag)
        elif tag == "table":
            rows = [[say(c) for c in r] for r in held["rows"] if r]
            self.emit("table", json.dumps(rows, ensure_ascii=False))
        elif tag == "title":
            self.emit("title", say(held["parts"]), 1)
        elif tag == "pre":
            self.emit("code", "".join(held["parts"]), None, held["language"])
        else:
            self.emit(_HOLDS[tag], say(held["parts"]), int(tag[1]) if tag[0] == "h" and tag[1:].isdigit() else None)
        self.blocks += self.captions
        self.captions = []

    def handle_data(self, data: str) -> None:
        if self.skipping:
            return
        if self.held is None:
            if data.strip() and (not self.open or self.open[-1] in _LOOSE):
                self.emit("paragraph", data.strip())
        elif self.held["tag"] in ("ul", "ol"):
            if self.held["items"]:
                self.held["items"][-1].append(data)
        elif self.held["tag"] == "table":
            if self.held["rows"] and self.held["rows"][-1]:
                self.held["rows"][-1][-1].append(data)
        else:
            self.held["parts"].append(data)

    def finish(self) -> list[tuple]:
        self.close("")
        return self.blocks


def html_elements(source: str | None) -> list[dict]:
    page = _Elements()
    page.feed(source or "")
    return [dict(zip(("block_type", "text", "level", "extra"), b, strict=True)) for b in page.finish()]


def html_blocks(docs: DataFrame, html: str = "html") -> DataFrame:
    """Raw blocks of HTML in document order."""

    @F.pandas_udf(RAW)
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(html_elements)

    rows = docs.select("doc_id", F.posexplode(run(F.col(html))).alias("at", "x")).select("doc_id", "at", "x.*")
    table = pipe_table(F.from_json(F.when(F.col("block_type") == "table", F.col("text")), "array<array<string>>"))
    return rows.withColumn("text", F.when(F.col("block_type") == "table", table).otherwise(F.col("text")))


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """url, link: distinct targets of a page's anchors, made absolute, without fragments."""
    hrefs = F.regexp_extract_all(F.col(html), F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']([^\"']*)[\"']"), 1)
    rows = pages.select(F.col(url).alias("url"), F.explode(F.array_distinct(hrefs)).alias("href"))
    href = F.regexp_replace("href", "#.*$", "")
    root = F.regexp_extract("url", r"^([a-zA-Z]+://[^/]+)", 1)
    folder = F.concat(root, F.coalesce(F.regexp_extract(F.regexp_replace("url", r"[?#].*$", ""), r"^[a-zA-Z]+://[^/]+(/.*/)?", 1), F.lit("")))
    absolute = (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract("url", r"^([a-zA-Z]+:)", 1), href))
        .when(href.startswith("/"), F.concat(root, href))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), href))
    )
    return rows.where(href != "").select("url", absolute.alias("link")).where(F.col("link").rlike("^https?://")).distinct()


# --- DOCX, PDF words and JSON rows ----------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_elements(data: bytes | None) -> list[dict] | None:
    """Paragraphs and tables of a document's body in order; null if it cannot be read."""
    try:
        body = ElementTree.parse(zipfile.ZipFile(io.BytesIO(data or b"")).open("word/document.xml")).getroot().find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    words = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    out = []
    for node in body if body is not None else []:
        if node.tag == f"{_W}tbl":
            rows = [[" ".join(filter(None, (words(p).strip() for p in c.iter(f"{_W}p")))) for c in r.findall(f"{_W}tc")] for r in node.findall(f"{_W}tr")]
            out.append(("table", json.dumps(rows, ensure_ascii=False), None, None))
        elif node.tag == f"{_W}p" and (text := words(node).strip()):
            found = node.find(f"{_W}pPr/{_W}pStyle")
            style = re.sub(r"[\s_-]", "", found.get(f"{_W}val", "") if found is not None else "").lower()
            if style.startswith("title"):
                out.append(("title", text, 1, None))
            elif style.startswith("heading"):
                out.append(("heading", text, int(re.sub(r"\D", "", style) or 1), None))
            elif style.startswith("list") or node.find(f"{_W}pPr/{_W}numPr") is not None:
                out.append(("list", text, None, "ol" if "number" in style else "ul"))
            elif "quote" in style:
                out.append(("quote", text, None, None))
            else:
                out.append(("paragraph", text, None, None))
    return [dict(zip(("block_type", "text", "level", "extra"), b, strict=True)) for b in out]


def docx_blocks(docs: DataFrame, data: str = "data") -> DataFrame:
    """Raw blocks of DOCX bytes; list paragraphs in a row are one list. Unreadable bytes give one row of type `error`."""

    @F.pandas_udf(RAW)
    def run(contents: pd.Series) -> pd.Series:
        return contents.map(docx_elements)

    broken = F.array(F.struct(F.lit("error").alias("block_type"), F.lit("corrupt or unreadable").alias("text"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("extra")))
    rows = docs.withColumn("_b", run(F.col(data))).select("doc_id", F.posexplode(F.coalesce("_b", broken)).alias("at", "x")).select("doc_id", "at", "x.*")
    order = Window.partitionBy("doc_id").orderBy("at")
    begins = (F.col("block_type") != "list") | (F.coalesce(F.lag("block_type").over(order), F.lit("")) != "list")
    rows = rows.withColumn("_run", F.sum(begins.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    items = F.array_sort(F.collect_list(F.struct("at", "text")))
    grouped = rows.groupBy("doc_id", "_run", "block_type").agg(F.min("at").alias("at"), items.alias("_i"), F.max("level").alias("level"), F.max("extra").alias("extra"))
    text = F.array_join(F.transform("_i", lambda x: x["text"]), "\n")
    table = pipe_table(F.from_json(F.when(F.col("block_type") == "table", text), "array<array<string>>"))
    return grouped.select("doc_id", "at", "block_type", F.when(F.col("block_type") == "table", table).otherwise(text).alias("text"), "level", "extra")


def pdf_word_blocks(words: DataFrame) -> DataFrame:
    """Raw blocks from words (doc_id, page, x0, top, size, text) that a PDF reader has given.

    Words of one third of a point grid line make a line; a short line of at least
    1.25 times the page's median size is a heading, its level the rank of its size.
    """
    line = F.bround(F.col("top") / 3.0).cast("int")
    ordered = F.array_sort(F.collect_list(F.struct("x0", "text")))
    lines = words.groupBy("doc_id", "page", line.alias("line")).agg(
        trim(F.array_join(F.transform(ordered, lambda w: w["text"]), " ")).alias("text"), F.max(F.coalesce("size", F.lit(0.0))).alias("size")
    ).where("text != ''")
    typical = lines.groupBy("doc_id", "page").agg(F.percentile("size", F.lit(0.5)).alias("typical"))
    rows = lines.join(typical, ["doc_id", "page"])
    rank = F.dense_rank().over(Window.partitionBy("doc_id", "page").orderBy(F.desc(F.bround("size", 1))))
    head = (F.col("typical") > 0) & (F.col("size") >= 1.25 * F.col("typical")) & (F.length("text") < 120)
    rows = rows.withColumns({"level": F.when(head, F.least(rank, F.lit(6))), "block_type": F.when(head, "heading").otherwise("paragraph")})
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line"))
    return rows.select("doc_id", at.alias("at"), "block_type", "text", "level", F.lit(None).cast("string").alias("extra"), "page")


def needs_ocr(pages: DataFrame, least_chars: int = 40) -> DataFrame:
    """doc_id: documents whose pages (doc_id, page, text) hold too little text on average."""
    chars = F.sum(F.length(trim(F.coalesce("text", F.lit("")))))
    return pages.groupBy("doc_id").agg(chars.alias("chars"), F.count("*").alias("pages")).where(F.col("chars") < least_chars * F.col("pages")).select("doc_id")


def json_blocks(docs: DataFrame, text: str = "text") -> DataFrame:
    """Raw blocks of flat JSON objects: one paragraph per field, in order of name."""
    fields = F.array_sort(F.map_entries(F.from_json(F.col(text), "map<string,string>")))
    rows = docs.select("doc_id", F.posexplode(fields).alias("at", "f"))
    return rows.select("doc_id", "at", F.lit("paragraph").alias("block_type"), F.concat_ws(": ", "f.key", "f.value").alias("text"), F.lit(None).cast("int").alias("level"), F.lit(None).cast("string").alias("extra"))


# --- cleaning, sections, titles ---------------------------------------------------------


def seal(raw: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, ordinal, block_type, text, heading_level, page, section, extra of raw blocks.

    docs: doc_id, filename, title. Blocks are cleaned by type; the first heading of
    level 1 is the title if there is none before; a document without a title gets
    one in front; sections carry forward, and what has none is named by the title.
    """
    page = F.col("page") if "page" in raw.columns else F.lit(None).cast("int")
    kind = F.col("block_type")
    folded = fold_lines(F.coalesce("text", F.lit("")))
    clean = F.when(kind == "code", F.when(trim(folded) != "", folded).otherwise("")).when(kind.isin("list", "table"), trim(folded)).otherwise(collapse(folded))
    rows = raw.withColumns({"text": clean, "page": page}).where((F.col("text") != "") & (kind != "error"))
    so_far = Window.partitionBy("doc_id").orderBy("at", "block_type", "text").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy("doc_id")
    could = (kind == "title") | ((kind == "heading") & (F.col("level") == 1))
    rows = rows.withColumn("_nth", F.sum(could.cast("int")).over(so_far))
    rows = rows.withColumn("block_type", F.when(could & (F.col("_nth") == 1), "title").otherwise(kind))
    rows = rows.withColumns(
        {
            "section": F.last(F.when(F.col("block_type").isin("title", "heading"), F.col("text")), ignorenulls=True).over(so_far),
            "_own": F.first(F.when(F.col("block_type") == "title", F.substring("text", 1, TITLE_CHARS)), ignorenulls=True).over(everything),
            "_nr": F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "block_type", "text")),
        }
    )
    named = docs.select(F.col("doc_id").alias("_d"), fallback_title(F.col("filename"), F.col("title")).alias("_fallback"))
    rows = named.join(rows, F.col("_d") == F.col("doc_id"), "left")
    title = F.coalesce("_own", "_fallback")
    block = lambda number, kind, text, level, page, section, extra: F.struct(
        number.cast("int").alias("ordinal"), kind.alias("block_type"), text.alias("text"), level.cast("int").alias("heading_level"),
        page.cast("int").alias("page"), section.alias("section"), extra.cast("string").alias("extra"),
    )
    null = F.lit(None)
    front = block(F.lit(0), F.lit("title"), title, null, null, title, null)
    shift = F.when(F.col("_own").isNull(), 0).otherwise(1)
    own = block(F.col("_nr") - shift, F.col("block_type"), F.col("text"), F.col("level"), F.col("page"), F.coalesce("section", title), F.col("extra"))
    missing = F.col("_own").isNull() & (F.coalesce("_nr", F.lit(1)) == 1)
    out = F.when(F.col("doc_id").isNull(), F.array(front)).when(missing, F.array(front, own)).otherwise(F.array(own))
    return rows.select(F.col("_d").alias("doc_id"), F.explode(out).alias("b")).select("doc_id", "b.*")
