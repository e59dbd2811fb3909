"""Raw pages and font spans to blocks and glossary entries."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from yieldloom.functions import text as X
from yieldloom.operators.ranking import running_total
from yieldloom.sources.scratch import checkpoint

CLEAN = "page_id long, title string, kinds array<string>, texts array<string>, ends array<boolean>"
PAGES_AT_ONCE = 32
BLOCKS = "page_id long, pos int, section int, kind string, text string, src string, alt string"
CELL = "\x1f"  # start of a table cell while a row is read
ITEM = "\x1e"  # between the texts of a page while they are normalised; the parser removes it from texts
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())


@dataclass(frozen=True)
class SiteRules:
    """Which elements of a site's pages count: 'tag' or 'tag.class'.

    ``mark_style`` is the style of spans that are dropped, ``leaves`` drops elements around
    paragraphs and items, ``unique`` repeats of a text, and ``figure_text`` tells
    whether a paragraph with an image keeps its text.
    """

    root: str
    kinds: dict[str, str]
    drop: tuple[str, ...] = ()
    headings: tuple[str, ...] = field(default=("heading",))
    title: str = "title"
    mark_style: str | None = None
    leaves: bool = False
    unique: bool = False
    figure_text: bool = True


# Interactive elements, credits in captions, line openings of the clean
# document, and element rules of the three page layouts and of plain articles.
INTERACTIVE = ("nav", "form", "button", "script", "style", "noscript")
CREDIT, CREDIT_LINE = re.compile(r"\(ⓒ[^)]*\)"), "출처"
OPENINGS = {"heading": "\n## ", "subheading": "\n### ", "footnote": "※ ", "list_item": "- "}
NEWSROOM = SiteRules(
    root="div.post-contents",
    kinds={
        "h3.sub-title": "heading",
        "p.footnote": "footnote",
        "p.caption": "caption",
        "p": "paragraph",
        "tr": "table_row",
        "img": "image",
    },
    drop=("div.post-intro",),
    title="h2.post-title",
    mark_style="color: red",
    figure_text=False,
)
PRODUCT = SiteRules(
    root="main",
    kinds={
        "h1": "heading",
        "h2": "heading",
        "h3": "subheading",
        "h4": "subheading",
        "p": "paragraph",
        "li": "list_item",
        "img": "image",
    },
    drop=INTERACTIVE,
    leaves=True,
    unique=True,
)
GLOSSARY = SiteRules(root="body", kinds={"h3.m-heading-type3": "heading", "div.m-text": "definition"})
ARTICLE = SiteRules(
    root="article",
    kinds={
        "h1": "heading",
        "h2": "heading",
        "h3": "subheading",
        "p": "paragraph",
        "li": "list_item",
        "img": "image",
    },
    drop=INTERACTIVE,
)


class _BlockReader(HTMLParser):
    """Collects the blocks of one page; a new block element ends the open one."""

    def __init__(self, rules: SiteRules) -> None:
        super().__init__(convert_charrefs=True)
        self.rules = rules
        self.blocks: list[tuple[int, str, str, str | None, str | None]] = []
        self.section = 0
        self.title: str | None = None
        self.ends: set[int] = set()
        self._title_tag: str | None = None
        self._title: list[str] = []
        self._seen: set[str] = set()
        self._inside_root = 0
        self._root_tag = rules.root.split(".")[0]
        self._dropped: list[str] = []
        self._kind: str | None = None
        self._tag = ""
        self._text: list[str] = []

    def _matches(self, names: list[str], wanted: tuple[str, ...] | str) -> bool:
        return any(n == wanted if isinstance(wanted, str) else n in wanted for n in names)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = dict(attrs)
        names = [*(f"{tag}.{c}" for c in (values.get("class") or "").split()), tag]
        if self._dropped:
            if tag == self._dropped[-1] and tag not in VOID_TAGS:
                self._dropped.append(tag)
            return
        if self.title is None and self._title_tag is None and self._matches(names, self.rules.title):
            self._title_tag = tag
        if not self._inside_root:
            if self._matches(names, self.rules.root):
                self._inside_root = 1
            return
        mark = self.rules.mark_style
        marked = mark is not None and tag == "span" and mark in (values.get("style") or "")
        if marked or self._matches(names, self.rules.drop):
            if tag not in VOID_TAGS:
                self._dropped.append(tag)
            return
        if tag == self._root_tag:
            self._inside_root += 1
        kind = next((self.rules.kinds[n] for n in names if n in self.rules.kinds), None)
        if kind == "image":
            if self._kind == "paragraph" and not self.rules.figure_text:
                self._kind, self._text = None, []
            src = values.get("src") or ""
            if src and not src.startswith("data:"):
                self.blocks.append((self.section, kind, "", src, values.get("alt") or ""))
        elif kind is not None:
            if self.rules.leaves and tag in ("p", "li"):
                self._kind = None
            self._close()
            self._kind, self._tag = kind, tag
        elif tag == "br":
            self._text.append("\n")
        elif tag in ("td", "th") and self._kind == "table_row":
            self._text.append(CELL)

    def handle_endtag(self, tag: str) -> None:
        if self._dropped:
            if tag == self._dropped[-1]:
                self._dropped.pop()
            return
        if tag == self._title_tag:
            self.title, self._title_tag = " ".join("".join(self._title).split()), None
        if self._inside_root:
            if tag == "table":
                self._close()
                self.ends.add(len(self.blocks) - 1)
            if self._kind is not None and tag == self._tag:
                self._close()
            if tag == self._root_tag:
                self._inside_root -= 1
                if not self._inside_root:
                    self._close()

    def handle_data(self, data: str) -> None:
        if self._title_tag is not None:
            self._title.append(data)
        if self._kind is not None and not self._dropped and self._inside_root:
            self._text.append(data)

    def _close(self) -> None:
        if self._kind is not None:
            text = "".join(self._text)
            if self._kind == "caption":
                lines = [" ".join(line.split()) for line in CREDIT.sub("", text).split("\n")]
                text = " ".join(x for x in lines if not x.startswith(CREDIT_LINE))
            parts = text.split("\n") if self._kind == "footnote" else [text]
            for part in parts:
                clean = " ".join(part.split())
                if self._kind == "table_row":
                    cells = [" ".join(cell.split()) for cell in part.split(CELL)[1:]]
                    clean = f"| {' | '.join(cells)} |"
                if clean and self._new(clean):
                    if self._kind in self.rules.headings:
                        self.section += 1
                    self.blocks.append((self.section, self._kind, clean, None, None))
            if self._kind == "footnote":
                self.ends.add(len(self.blocks) - 1)
        self._kind, self._text = None, []

    def _new(self, text: str) -> bool:
        """Whether a text counts: all do but repeats where texts are to be unique."""
        if not self.rules.unique:
            return True
        key = " ".join(unicodedata.normalize("NFC", text).replace("/p>", "").split())
        known = key in self._seen
        self._seen.add(key)
        return not known

    def read(self, html: str) -> list[tuple[int, str, str, str | None, str | None]]:
        self.feed(html)
        self.close()
        self._close()
        return self.blocks


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple[int, str]]]:
    """(page_id, html) of a few pages at a time, so that little output is held at once."""
    for batch in batches:
        pages = list(zip(batch["page_id"], batch["html"], strict=True))
        for start in range(0, len(pages), PAGES_AT_ONCE):
            yield [(page_id, html or "") for page_id, html in pages[start : start + PAGES_AT_ONCE]]


def page_blocks(pages: DataFrame, rules: SiteRules) -> DataFrame:
    """(page_id, html) -> ordered blocks with the number of the section they are in.

    HTML has no built-in parser in Spark, so pages go through Arrow batches one
    page at a time; page text is normalised in the JVM afterwards.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in _pieces(batches):
            rows = [
                (page_id, pos, *block)
                for page_id, html in piece
                for pos, block in enumerate(_BlockReader(rules).read(html))
            ]
            yield pd.DataFrame(
                rows, columns=["page_id", "pos", "section", "kind", "text", "src", "alt"]
            )

    blocks = pages.select("page_id", "html").mapInPandas(read, BLOCKS)
    return blocks.withColumn("text", X.normalize_text(F.col("text")))


def clean_documents(pages: DataFrame, rules: SiteRules) -> DataFrame:
    """(page_id, html) -> page_id, title, body: one clean text per page, without a shuffle.

    Headings open with ``##`` or ``###``, items with ``-``, footnotes with ``※``; an empty
    line follows a paragraph, a caption, the footnotes of an element and a table. A page
    without the root element, or without HTML, has an empty body; one without a title
    element an empty title.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for piece in _pieces(batches):
            rows = []
            for page_id, html in piece:
                page = _BlockReader(rules)
                texts = [(i, b) for i, b in enumerate(page.read(html)) if b[1] != "image"]
                kinds, lines = [b[1] for _, b in texts], [b[2] for _, b in texts]
                rows.append((page_id, page.title or "", kinds, lines, [i in page.ends for i, _ in texts]))
            yield pd.DataFrame(rows, columns=["page_id", "title", "kinds", "texts", "ends"])

    parsed = pages.select("page_id", "html").mapInPandas(read, CLEAN)
    # One normalisation for all texts of a page; none crosses the separator.
    texts = F.split(X.normalize_text(F.array_join("texts", ITEM)), ITEM, -1)
    blocks = F.arrays_zip("kinds", F.transform(texts, X.strip).alias("texts"), "ends")

    def line(block: F.Column) -> F.Column:
        kind, opened = block["kinds"], F.lit("")
        for name, opening in OPENINGS.items():
            opened = F.when(kind == name, opening).otherwise(opened)
        closes = block["ends"] | kind.isin("heading", "subheading", "paragraph", "caption", "definition")
        return F.concat(opened, block["texts"], F.when(closes, "\n").otherwise(""))

    kept = F.filter(blocks, lambda b: b["kinds"].isNotNull() & (b["texts"] != ""))
    body = F.regexp_replace(F.array_join(F.transform(kept, line), "\n"), "\n{3,}", "\n\n")
    return parsed.select(
        "page_id", X.normalize_text(F.col("title")).alias("title"), X.strip(body).alias("body")
    )


def page_images(blocks: DataFrame) -> DataFrame:
    """Images with the section they stand in; the parser carries the section number."""
    return blocks.filter(F.col("kind") == "image").select("page_id", "pos", "section", "src", "alt")


def glossary_pairs(blocks: DataFrame) -> DataFrame:
    """Heading and the first definition block before the next heading.

    ``section`` numbers the headings, so a pair is one pre-aggregated group.
    """
    pairs = blocks.filter(F.col("section") > 0).groupBy("page_id", "section").agg(
        F.min_by(
            F.when(F.col("kind") == "heading", F.col("text")),
            F.when(F.col("kind") == "heading", F.col("pos")),
        ).alias("term"),
        F.min_by(
            F.when(F.col("kind") == "definition", F.col("text")),
            F.when(F.col("kind") == "definition", F.col("pos")),
        ).alias("definition"),
    )
    return pairs.filter((F.col("term") != "") & (F.col("definition") != ""))


def glossary_from_spans(spans: DataFrame, min_size: float = 9.0, max_size: float = 10.5) -> DataFrame:
    """Font spans (doc_id, page, pos, text, size, bold) -> (term, definition) entries.

    A bold span ending in ':' closes a term that may have begun in bold spans
    before it. A closed term in brackets continues the running definition. The
    sequential rule becomes two running counts, each carried over pages by page
    totals, so a long document is not read by one task.
    """
    stripped = X.strip(F.col("text"))
    usable = (
        spans.filter(F.col("size").between(min_size, max_size))
        .withColumn("clean", stripped)
        .filter((F.col("clean") != "") & ~F.col("clean").rlike("^(#|___)"))
    )
    closes_term = F.col("bold") & F.endswith(F.col("clean"), F.lit(":"))
    marked = usable.withColumn("closes_term", closes_term).withColumn(
        "closes", (closes_term | ~F.col("bold")).cast("long")
    )
    numbered = running_total(marked, ["doc_id"], ["page"], ["pos"], "closes", "through").withColumn(
        "unit", F.col("through") - F.col("closes")
    )
    piece = F.struct("page", "pos", F.when(F.col("bold"), F.col("clean")).otherwise(F.col("text")).alias("text"))
    units = numbered.groupBy("doc_id", "unit").agg(
        F.min("page").alias("page"),
        F.min("pos").alias("pos"),
        F.max("closes").alias("closed"),
        F.max("closes_term").alias("is_term"),
        F.max(F.when(F.col("closes") == 1, F.col("clean"))).alias("last"),
        F.transform(F.array_sort(F.collect_list(piece)), lambda p: p["text"]).alias("pieces"),
    ).filter(F.col("closed") == 1)
    # Read three times below.
    units = checkpoint(units)
    candidate = X.strip(F.regexp_replace(F.array_join("pieces", " "), ":+$", ""))
    terms = units.withColumn("candidate", F.when(F.col("is_term"), candidate))
    first_term = terms.filter("is_term").groupBy("doc_id").agg(F.min("unit").alias("first_unit"))
    opened = terms.join(first_term, "doc_id").withColumn(
        "opens",
        (
            F.col("is_term")
            & (~F.startswith(F.col("candidate"), F.lit("(")) | (F.col("unit") == F.col("first_unit")))
        ).cast("long"),
    )
    entries = running_total(opened, ["doc_id"], ["page"], ["unit"], "opens", "entry").filter(
        F.col("entry") > 0
    )
    body = F.when(F.col("opens") == 1, F.array().cast("array<string>")).otherwise(
        F.when(F.col("is_term"), F.array("last")).otherwise(F.col("pieces"))
    )
    joined = entries.groupBy("doc_id", "entry").agg(
        F.max(F.when(F.col("opens") == 1, F.col("candidate"))).alias("term"),
        F.array_join(
            F.flatten(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("unit", body.alias("body")))),
                    lambda u: u["body"],
                )
            ),
            " ",
        ).alias("definition"),
    )
    return (
        joined.withColumn("term", X.normalize_text(F.col("term")))
        .withColumn("definition", X.normalize_text(F.col("definition")))
        .filter(F.length("definition") >= 10)
    )
