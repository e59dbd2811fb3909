"""Driver tables mapped to the shapes the operators work on.

All mappings are row-wise projections: no window, join or aggregate, so that
filters and column pruning of the operators reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yieldloom import schemas
from yieldloom.functions.text import sections
from yieldloom.sources.spread import spread

# Measurement limits of the five recipes: (key, min, max, active).
SPEC_LIMITS = {
    "R0": [("QTY", "2", "48", "T"), ("DISC", "0", "9", "T"), ("TAX", "1", "7", "T")],
    "R1": [("QTY", "1", "45", "T"), ("DISC", "1", "10", "T"), ("TAX", "0", "8", "F")],
    "R2": [("QTY", "5", "50", "T"), ("DISC", "0", "8", "T"), ("TAX", "n/a", "8", "T")],
    "R3": [("QTY", "1", "50", "T"), ("DISC", "2", "9", "T"), ("TAX", "0", "7", "T")],
    "R4": [("QTY", "3", "47", "F"), ("DISC", "0", "10", "T"), ("TAX", "2", "8", "T")],
}

MAP_COLUMNS = 16
PASS_THRESHOLD = -0.15
#: Strips whose first value is above this have no map.
CUT_ABOVE = 0.15


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def raw_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Step rows as they arrive: lower-case names, yield and time as text."""
    rejected = F.round(F.col("l_quantity") * F.col("l_discount") * 100).cast("long")
    quantity = (F.col("l_quantity") * 100).cast("long")
    percent = F.lit(100) - F.round(F.col("l_discount") * 100).cast("int")
    return read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("lotid"),
        F.col("l_linenumber").alias("stepseq"),
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("stepname"),
        F.concat(F.lit("EQ"), F.col("l_suppkey").cast("string")).alias("eqpid"),
        quantity.alias("inqty"),
        rejected.alias("reject"),
        (quantity - rejected).alias("outqty"),
        F.concat(percent.cast("string"), F.lit(".0%")).alias("yield"),
        F.date_format("l_shipdate", "yyyyMMdd HHmmssSSS").alias("trackouttime"),
    )


def lot_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Ingested step rows with the native time column kept for pushdown."""
    rejected = F.round(F.col("l_quantity") * F.col("l_discount") * 100).cast("long")
    quantity = (F.col("l_quantity") * 100).cast("long")
    steps = read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("lot_id"),
        F.col("l_linenumber").alias("step_seq"),
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("step_name"),
        F.concat(F.lit("EQ"), F.col("l_suppkey").cast("string")).alias("eqp_id"),
        quantity.alias("in_qty"),
        rejected.alias("reject"),
        (quantity - rejected).alias("out_qty"),
        (F.lit(100.0) - F.round(F.col("l_discount") * 100)).alias("yield_num"),
        F.col("l_shipdate").alias("track_out_time"),
    )
    return schemas.require_columns(steps, schemas.STEPS, "lot_steps")


def readings(spark: SparkSession, folder: str) -> DataFrame:
    """Measurements in long form; a defect label exists only for high-loss rows."""
    def whole(column: F.Column) -> F.Column:
        return F.round(column).cast("int").cast("string")

    def entry(key: str, value: F.Column) -> F.Column:
        return F.struct(F.lit(key).alias("key"), value.alias("value"))

    entries = F.array(
        entry("QTY", whole(F.col("l_quantity"))),
        entry("DISC", whole(F.col("l_discount") * 100)),
        entry("TAX", whole(F.col("l_tax") * 100)),
        F.when(
            F.col("l_discount") >= 0.09,
            entry("DEFECT_TYPE", F.concat(F.lit("label-"), F.col("l_returnflag"))),
        ),
    )
    rows = (
        spread(read_table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber", "l_suppkey")
        .select(
            F.col("l_orderkey").alias("lot_id"),
            F.concat(F.lit("EQ"), F.col("l_suppkey").cast("string")).alias("eqp_id"),
            F.explode(entries).alias("entry"),
            F.col("l_shipdate").alias("ts"),
        )
        .filter(F.col("entry").isNotNull())
        .select("lot_id", "eqp_id", "entry.key", "entry.value", "ts")
    )
    return schemas.require_columns(rows, schemas.READINGS, "readings")


def recipe_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """One recipe assignment per lot."""
    return read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("lot_id"),
        F.lit("RECIPE").alias("item_name"),
        F.concat(F.lit("R"), (F.col("o_orderkey") % 5).cast("string")).alias("check_value"),
        F.col("o_orderdate").alias("ts"),
    )


def recipe_specs(spark: SparkSession) -> DataFrame:
    """The recipe master is a small reference list."""
    rows = [
        F.struct(*[F.lit(v).alias(n) for v, n in zip((recipe, *limit), schemas.SPECS.names, strict=True)])
        for recipe, limits in SPEC_LIMITS.items()
        for limit in limits
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def lots(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("lot_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("value"),
        F.col("o_orderdate").cast("date").cast("string").alias("due_date"),
    )


def strips(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("strip_id"),
        F.col("label").alias("lot_id"),
        F.col("vec_id").alias("position"),
    )


def _map_file() -> F.Column:
    """A map file: header, one 0/1 line per grid row, closing brace."""
    bits = F.transform("embedding", lambda v: F.when(v >= PASS_THRESHOLD, "1").otherwise("0"))
    starts = F.sequence(F.lit(1), F.size("embedding"), F.lit(MAP_COLUMNS))
    lines = F.transform(starts, lambda i: F.array_join(F.slice(bits, i, MAP_COLUMNS), ""))
    return F.concat(_map_header(), F.lit("MAP {\n\n "), F.array_join(lines, " \n"), F.lit("\n}\n"))


def _map_header() -> F.Column:
    return F.concat(F.lit("STRIP "), F.col("vec_id").cast("string"), F.lit("\n"))


def strip_files(spark: SparkSession, folder: str) -> DataFrame:
    """One map file per strip."""
    return read_table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("strip_id"), _map_file().alias("content")
    )


def cut_strip_files(spark: SparkSession, folder: str) -> DataFrame:
    """The same files, those of strips with a high first value cut off before their map."""
    cut = F.get("embedding", F.lit(0)) > CUT_ABOVE
    return read_table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("strip_id"),
        F.when(cut, _map_header()).otherwise(_map_file()).alias("content"),
    )


# --- documents and pages -------------------------------------------------------------------


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents for work on their whole text."""
    return spread(documents(spark, folder), "doc_id")


def _title() -> F.Column:
    first = F.substring_index("text", "\n", 1)
    numbered = F.concat(F.lit("["), F.upper("lang"), F.lit(" 시리즈 "), "n_chars", F.lit("편] "), first)
    return (
        F.when(F.col("lang") == "en", numbered)
        .when(F.col("lang") == "de", F.concat(F.lit("["), "source", F.lit("] "), first))
        .otherwise(first)
    )


def _url() -> F.Column:
    return F.concat(F.lit("https://docs.example.com/"), "lang", F.lit("/"), "doc_id")


def markdown_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as Markdown: short lines inside a text are its headings."""
    return texts(spark, folder).select(
        "doc_id",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"),
        "source",
        _url().alias("url"),
        _title().alias("title"),
        F.col("lang").alias("language"),
        F.when(F.col("source") == "src0", "glossary").otherwise("article").alias("doc_type"),
        F.regexp_replace("text", "\n([^\n]{1,40})\n", "\n## $1\n").alias("body"),
    )


def paragraph_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Structured articles: the whole text is one section, each line a paragraph."""
    section = F.struct(
        F.lit(0).alias("ordinal"),
        F.lit(None).cast("string").alias("heading"),
        F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("text"),
    )
    return texts(spark, folder).select(
        "doc_id",
        _title().alias("title"),
        "source",
        _url().alias("url"),
        F.lit(None).cast("string").alias("series"),
        F.lit(None).cast("int").alias("part"),
        F.col("lang").alias("language"),
        F.lit("article").alias("doc_type"),
        F.array(section).alias("sections"),
    )


def caption_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Markdown documents with the caption list of their judged figures."""
    def caption(section: F.Column, text: F.Column, status: F.Column) -> F.Column:
        return F.struct(
            section.cast("int").alias("section"), text.alias("caption"), status.alias("status")
        )

    judged = read_table(spark, folder, "labels").select(
        "doc_id",
        F.array(
            caption(
                F.col("quality") + F.col("toxic"),
                F.concat(F.lit("figure "), F.col("quality").cast("string")),
                F.when(F.col("toxic") == 1, "error: refused").otherwise("ok"),
            ),
            caption(F.lit(99), F.lit("closing figure"), F.lit("ok")),
        ).alias("captions"),
    )
    return markdown_docs(spark, folder).join(judged, "doc_id", "left")


def internal_docs(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "benchmark").select(
        F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("slug"),
        F.lit(None).cast("string").alias("doc_type"),
        F.concat(
            F.lit("# Item "),
            F.col("item_id").cast("string"),
            F.lit("\n"),
            F.replace("text", F.lit("\n"), F.lit("\n## Part\n")),
        ).alias("body"),
    )


def glossary_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Glossary documents: one headed section per document, line ends start numbered senses."""
    first = F.substring_index("text", "\n", 1)
    section = F.struct(
        F.lit(1).alias("ordinal"),
        F.concat(F.substring_index(first, " ", 2), F.lit(" ("), "lang", F.lit(", "), "source", F.lit(")")).alias("heading"),
        F.concat(
            F.lit("(1) "), F.replace("text", F.lit(".\n"), F.lit(". (2) (in use): "))
        ).alias("text"),
    )
    return texts(spark, folder).select(
        "doc_id",
        "source",
        F.lit(None).cast("string").alias("url"),
        F.col("lang").alias("language"),
        F.lit("glossary").alias("doc_type"),
        F.array(section).alias("sections"),
    )


def footnote_docs(spark: SparkSession, folder: str) -> DataFrame:
    """Articles whose lines are footnotes: the first comma of a line ends the term."""
    section = F.struct(
        F.lit(0).alias("ordinal"),
        F.lit(None).cast("string").alias("heading"),
        F.concat(
            F.lit("※ "),
            F.replace(F.replace("text", F.lit(","), F.lit(":")), F.lit("\n"), F.lit("\n※ ")),
        ).alias("text"),
    )
    return texts(spark, folder).select(
        "doc_id",
        "source",
        F.lit(None).cast("string").alias("url"),
        F.col("lang").alias("language"),
        F.lit("article").alias("doc_type"),
        F.array(section).alias("sections"),
    )


def part_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as cards; small parts only refer to the name of a larger one."""
    name = F.concat_ws(" ", "p_name", "p_brand")
    see = F.concat(F.lit('See "'), F.upper("p_name"), F.lit(' Brand#1".'))
    return read_table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"),
        F.lower(name).alias("canonical_term"),
        name.alias("term"),
        F.array("p_brand", "p_type").alias("aliases"),
        F.when(F.col("p_size") <= 10, see)
        .otherwise(F.concat_ws(" ", "p_type", F.col("p_size").cast("string")))
        .alias("definition"),
        F.col("p_type").alias("source"),
        F.when(F.col("p_size") <= 25, "parsed").otherwise("footnote").alias("extracted_by"),
    )


def page_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Pages as listing rows and as fetched content."""
    url = F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "//(m|blog)\\.", "//")
    return read_table(spark, folder, "pages").select(
        "page_id",
        url.alias("url"),
        F.regexp_extract("url", "//[^/]+/([^/]+)/", 1).alias("tag"),
        F.regexp_extract("url", "//([^/]+)/", 1).alias("source"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.col("html").alias("content"),
    )


def article_pages(spark: SparkSession, folder: str) -> DataFrame:
    return spread(read_table(spark, folder, "pages"), "page_id").select("page_id", "html")


def illustrated_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages whose bold openings carry a figure."""
    return spread(read_table(spark, folder, "pages"), "page_id").select(
        "page_id",
        F.replace("html", F.lit("<b>"), F.lit('<img src="/fig.png" alt="figure"><b>')).alias("html"),
    )


def line_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of the documents as page blocks; short lines are headings."""
    return (
        texts(spark, folder)
        .select(F.col("doc_id").alias("page_id"), F.posexplode_outer(F.split("text", "\n")))
        .select("page_id", "pos", F.col("col").alias("text"))
    )


def definition_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Section headings and their text as alternating heading and definition blocks."""
    body = markdown_docs(spark, folder).select("doc_id", F.inline_outer(sections(F.col("body"))))
    block = F.inline(
        F.array(
            F.struct((F.col("ordinal") * 2).alias("pos"), F.lit("heading").alias("kind"), F.col("heading").alias("text")),
            F.struct((F.col("ordinal") * 2 + 1).alias("pos"), F.lit("definition").alias("kind"), "text"),
        )
    )
    return body.select(F.col("doc_id").alias("page_id"), F.col("ordinal").alias("section"), block)


def spans(spark: SparkSession, folder: str) -> DataFrame:
    """Lines as font spans: short lines are bold and end a term where they had a full stop."""
    lines = line_blocks(spark, folder)
    bold = F.length("text") < 40
    return lines.select(
        F.col("page_id").alias("doc_id"),
        F.floor(F.col("pos") / 50).alias("page"),
        "pos",
        F.when(bold, F.regexp_replace("text", r"\.$", ":")).otherwise(F.col("text")).alias("text"),
        F.lit(10.0).alias("size"),
        bold.alias("bold"),
    )


def image_src(line: F.Column) -> F.Column:
    """Address of the image that a line of a document describes."""
    return F.concat(
        F.lit("/img/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit("/"), line.cast("string"), F.lit(".png")
    )


def page_captions(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of the documents as a caption with a fetch status per language."""
    status = (
        F.when(F.col("lang") == "de", "download_failed")
        .when(F.col("lang") == "es", F.concat(F.lit("error: "), "source"))
        .when(F.col("n_chars") < 200, "svg_skipped")
        .otherwise("ok")
    )
    lines = texts(spark, folder).select(
        "doc_id", "source", status.alias("status"), F.posexplode_outer(F.split("text", "\n")).alias("section", "caption")
    )
    return lines.select(
        image_src(F.col("section")).alias("src"),
        "source",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("slug"),
        "section",
        "caption",
        "status",
    )


def toxic_images(spark: SparkSession, folder: str) -> DataFrame:
    """Images of all lines of the documents that are marked as toxic."""
    toxic = read_table(spark, folder, "labels").filter(F.col("toxic") == 1).select("doc_id")
    lines = (
        texts(spark, folder)
        .join(toxic, "doc_id", "left_semi")
        .select("doc_id", "source", F.posexplode_outer(F.split("text", "\n")).alias("section", "caption"))
    )
    return lines.select(image_src(F.col("section")).alias("src"))


# --- retrieval -----------------------------------------------------------------------------


def text_records(spark: SparkSession, folder: str) -> DataFrame:
    return texts(spark, folder).select(F.col("doc_id").alias("id"), "text")


def text_queries(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def vector_records(spark: SparkSession, folder: str) -> DataFrame:
    """Two collections in one table: labels below 5 are cards, the others article chunks."""
    return read_table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("id"),
        F.when(F.col("label") < 5, "glossary").otherwise("article").alias("kind"),
        F.col("embedding").alias("vec"),
        F.col("label").alias("label"),
    )


def vector_queries(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items with the vector of the same number."""
    items = text_queries(spark, folder)
    vectors = read_table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"), "label"
    )
    return items.join(vectors, "query_id")


def text_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Every line of the documents as a term."""
    return texts(spark, folder).select(
        "doc_id", F.posexplode_outer(F.split("text", "\n")).alias("line", "term")
    )


def user_questions(spark: SparkSession, folder: str) -> DataFrame:
    """User turns of the conversations, by conversation and turn."""
    return (
        spread(read_table(spark, folder, "conversations"), "conv_id", "turn")
        .filter(F.col("role") == "user")
        .select(F.concat_ws("-", "conv_id", "turn").alias("query_id"), "text")
    )


def record_texts(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        F.col("doc_id").alias("id"),
        F.substring_index("text", "\n", 1).alias("title"),
        F.col("text").alias("content"),
        F.when(F.col("lang") != "de", _url()).alias("source_url"),
    )


# --- questions, evaluation and telemetry ---------------------------------------------------


def qa_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered corpus records that questions are written for."""
    card = F.col("lang") == "en"
    return documents(spark, folder).select(
        F.concat(F.when(card, "card-").otherwise("chunk-"), F.col("doc_id").cast("string")).alias("id"),
        F.when(card, "glossary_card").otherwise("article_chunk").alias("source_type"),
        (F.col("doc_id") + 1).alias("number"),
        "text",
    )


def qa_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Question rows for every line: formal ones for longer texts, casual ones for most sources."""
    card = F.col("lang") == "en"
    line = F.col("line")

    def row(phrasing: str, question: F.Column) -> F.Column:
        return F.struct(F.lit(phrasing).alias("phrasing"), question.alias("question"))

    rows = F.array_compact(
        F.array(
            F.when(F.col("n_chars") >= 300, row("formal", line)),
            F.when(F.col("source") != "src3", row("casual", F.concat(line, F.lit("?")))),
        )
    )
    lines = texts(spark, folder).select(
        "doc_id", "lang", "source", "n_chars", F.explode_outer(F.split("text", "\n")).alias("line")
    )
    return lines.select(
        F.concat(F.when(card, "card-").otherwise("chunk-"), F.col("doc_id").cast("string")).alias("source_id"),
        F.when(card, "glossary_card").otherwise("article_chunk").alias("source_type"),
        F.when(F.col("lang") == "fr", "flow")
        .when(F.col("lang") == "de", "judgment")
        .otherwise("unsorted")
        .alias("question_type"),
        F.inline(rows),
    )


def classified_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the label a weak rule gives them."""
    return read_table(spark, folder, "events").select(
        F.col("event_type").alias("expected"),
        F.when(F.col("value") < 20, "error").otherwise(F.col("event_type")).alias("got"),
    )


def tool_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Events as tool-choice cases: the number in the properties decides what was called."""
    k = F.get_json_object("props", "$.k").cast("int")
    label = F.when(F.col("value") < 50, "data").otherwise("knowledge")
    return read_table(spark, folder, "events").select(
        "event_id",
        F.when(F.col("event_type") == "error", "knowledge").otherwise("data").alias("expected_label"),
        label.alias("label"),
        F.when(F.col("event_type") == "error", F.array().cast("array<string>"))
        .when(F.col("event_type") == "view", F.array(F.lit("lot_info"), F.lit("step_history")))
        .otherwise(F.array(F.lit("yield_by_group")))
        .alias("expected_tools"),
        F.when(k < 30, F.array(F.lit("lot_info")))
        .when(k < 60, F.array(F.lit("yield_by_group"), F.lit("step_history")))
        .otherwise(F.array(F.lit("strip_yield")))
        .alias("called_tools"),
    )


def defect_events(spark: SparkSession, folder: str) -> DataFrame:
    """One planted event per equipment; some name the measurement that caused it."""
    return read_table(spark, folder, "supplier").select(
        F.concat(F.lit("EV"), F.col("s_suppkey").cast("string")).alias("event_id"),
        F.lit("R-F").alias("step"),
        F.concat(F.lit("EQ"), F.col("s_suppkey").cast("string")).alias("eqp_id"),
        F.lit("label-R").alias("defect_name"),
        F.when(F.col("s_nationkey") < 12, "DISC").alias("root_cause_item"),
    )


def defect_event_lots(spark: SparkSession, folder: str) -> DataFrame:
    """Lots with a high loss at the equipment of the event."""
    return (
        read_table(spark, folder, "lineitem")
        .filter(F.col("l_discount") >= 0.09)
        .select(
            F.concat(F.lit("EV"), F.col("l_suppkey").cast("string")).alias("event_id"),
            F.col("l_orderkey").alias("place"),
            F.col("l_orderkey").alias("lot_id"),
        )
        .distinct()
    )


def strip_events(spark: SparkSession, folder: str) -> DataFrame:
    """One planted strip pattern per region."""
    names = F.array(*[F.lit(n) for n in ("center", "edge", "stripe", "scattered", "none")])
    return read_table(spark, folder, "region").select(
        F.concat(F.lit("SE"), F.col("r_regionkey").cast("string")).alias("event_id"),
        F.get(names, F.col("r_regionkey")).alias("pattern"),
    )


def strip_event_lots(spark: SparkSession, folder: str) -> DataFrame:
    """Every lot is named by the two events its number points to."""
    lots_ = read_table(spark, folder, "embeddings").select(F.col("label").alias("lot_id")).distinct()
    named = F.explode(F.array(F.col("lot_id") % 4, (F.col("lot_id") + 1) % 4))
    return lots_.select("lot_id", named.alias("event")).select(
        F.concat(F.lit("SE"), F.col("event").cast("string")).alias("event_id"),
        F.col("lot_id").alias("place"),
        "lot_id",
    )


def answer_cases(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as answers; keywords are any-of word lists and the source name."""
    def group(*words: str) -> F.Column:
        return F.array(*[F.lit(w) for w in words])

    return texts(spark, folder).select(
        F.col("doc_id").alias("case_id"),
        F.col("source").alias("event_type"),
        F.col("lang").alias("label"),
        F.when(F.col("n_chars") < 200, "de").otherwise("en").alias("expected_label"),
        F.col("text").alias("answer"),
        F.array(group("the ", "der ", "que "), group("*the*"), group("on", "nothing")).alias(
            "expected_keywords"
        ),
        F.contains("text", F.lit("and ")).alias("cited"),
    )


def eval_case_files(spark: SparkSession, folder: str) -> DataFrame:
    """Case files with one case per benchmark item: all its words are keywords.

    Of every three words the first is a text and the next two are one list.
    """
    words = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    quoted = F.transform(words, lambda w: F.regexp_replace(F.to_json(F.array(w)), r"^\[|\]$", ""))

    def group(start: F.Column) -> F.Column:
        pair = F.slice("quoted", start + 2, 2)
        listed = F.concat(F.lit(", ["), F.array_join(pair, ", "), F.lit("]"))
        return F.concat(
            F.get(F.col("quoted"), start), F.when(F.size(pair) > 0, listed).otherwise(F.lit(""))
        )

    starts = F.sequence(F.lit(0), F.size("quoted") - 1, F.lit(3))
    keywords = F.concat(F.lit("["), F.array_join(F.transform(starts, group), ", "), F.lit("]"))
    return read_table(spark, folder, "benchmark").select("item_id", quoted.alias("quoted")).select(
        F.concat(
            F.lit('{"cases": [{"id": "c'),
            F.col("item_id").cast("string"),
            F.lit('", "query": "q", "expected_intent": "data", "expected_tools": ["a", "b"], "expected_keywords": '),
            keywords,
            F.lit("}]}"),
        ).alias("content")
    )


def judge_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Stored labels as verdicts; English documents count as strip events."""
    good, clean = F.col("quality") == 1, F.col("toxic") == 0
    verdict = F.create_map(
        *[
            part
            for name, value in (
                ("strip", good),
                ("pattern", clean),
                ("cause_sound", good & clean),
                ("step", good),
                ("equipment", clean),
            )
            for part in (F.lit(name), value)
        ]
    )
    return (
        read_table(spark, folder, "labels")
        .join(documents(spark, folder).select("doc_id", "lang"), "doc_id")
        .select(
            F.col("doc_id").alias("case_id"),
            F.when(F.col("lang") == "en", "strip_pattern").otherwise("defect").alias("event_type"),
            verdict.alias("verdict"),
        )
    )


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations; middle-sized answers are written as reports with a summary section."""
    first = F.substring_index("text", "\n", 1)
    report = F.concat(
        F.lit("# Report\n## 1. 요약\n"), first, F.lit("\nsecond line\n\n---\n## 2. Detail\n"), "text"
    )
    is_report = (F.col("role") == "assistant") & F.length("text").between(300, 600)
    return read_table(spark, folder, "conversations").select(
        "conv_id", "turn", "role", F.when(is_report, report).otherwise(F.col("text")).alias("text")
    )


def conversation_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Assistant turns with an expectation and two tool calls that set the same argument."""
    def pairs(*items: tuple[str, F.Column]) -> F.Column:
        return F.create_map(*[p for key, value in items for p in (F.lit(key), value)])

    conv = F.col("conv_id").cast("string")
    turn = F.col("turn").cast("string")
    long = F.length("text") > 300
    return (
        read_table(spark, folder, "conversations")
        .filter(F.col("role") == "assistant")
        .select(
            "conv_id",
            "turn",
            F.when(long, "root_cause").otherwise("data").alias("label"),
            F.lit("data").alias("expect_label"),
            conv.alias("lot_id"),
            F.when(F.col("turn") > 1, F.when(long, "none").otherwise(conv)).alias("expect_lot_id"),
            F.array(F.lit("lot_info"), F.lit("step_history")).alias("tools"),
            F.when(F.col("turn") < 3, F.when(long, "strip_yield").otherwise("lot_info")).alias("expect_tool"),
            F.array(pairs(("lot", conv), ("step", conv)), pairs(("step", turn))).alias("calls"),
            F.when(F.col("turn") > 1, pairs(("step", turn), ("lot", turn))).alias("expect_input"),
            F.array(F.lit("e"), F.lit("the")).alias("expect_words"),
            F.col("text").alias("answer"),
        )
    )


def answered_turns(spark: SparkSession, folder: str) -> DataFrame:
    """The turns with their place in the conversation, as a case file counts them."""
    # A window over one conversation's turns.
    order = Window.partitionBy("conv_id").orderBy("turn")
    return conversation_turns(spark, folder).withColumn("place", F.row_number().over(order))


def turn_case_files(spark: SparkSession, folder: str) -> DataFrame:
    """A case file per conversation with what its turns expect; nothing is stated for a null."""
    stated = F.struct(
        F.concat(F.lit("question "), F.col("place").cast("string")).alias("query"),
        F.col("expect_label").alias("expect_intent"),
        "expect_lot_id",
        "expect_tool",
        F.col("expect_input").alias("expect_tool_input"),
        F.col("expect_words").alias("expect_answer_contains"),
    )
    # The turns of one conversation are one file.
    turns = F.sort_array(F.collect_list(F.struct("place", F.to_json(stated).alias("json"))))["json"]
    text = '{"conversations": [{"id": "%s", "turns": [%s]}]}'
    return (
        answered_turns(spark, folder)
        .groupBy(F.col("conv_id").cast("string").alias("id"))
        .agg(turns.alias("turns"))
        .select(F.format_string(text, "id", F.array_join("turns", ", ")).alias("content"))
    )


def run_results(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user as the rows of one evaluation run."""
    return read_table(spark, folder, "events").select(
        F.col("user_id").alias("run_id"),
        F.date_trunc("hour", "ts").alias("bucket"),
        F.struct("ts", "event_id").alias("seq"),
        F.when(F.col("event_type").isin("error", "view"), "error").otherwise("ok").alias("label"),
    )


def runs_from_events(events: DataFrame) -> DataFrame:
    """Telemetry records: the number in the properties is the length of the step log."""
    k = F.get_json_object("props", "$.k").cast("int")
    step = lambda i: F.struct(
        F.when(i % 3 == 0, "RAG 검색").when(i % 3 == 1, "Function Call").otherwise("Router").alias("step")
    )
    log = F.when(k > 0, F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), step)).otherwise(
        F.array().cast("array<struct<step:string>>")
    )
    return events.select(
        F.col("event_id").alias("run_id"),
        "ts",
        F.col("event_type").alias("intent"),
        F.bround("value").cast("long").alias("latency_ms"),
        log.alias("log"),
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    return runs_from_events(read_table(spark, folder, "events"))


def streamed_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream of the event files."""
    schema = read_table(spark, folder, "events").schema
    # A pattern, because a stream takes a folder or a pattern but no single file.
    return runs_from_events(spark.readStream.schema(schema).parquet(f"{folder}/event[s].parquet"))


def logged_runs(spark: SparkSession, folder: str) -> DataFrame:
    """The same for work on all logs."""
    return runs_from_events(spread(read_table(spark, folder, "events"), "event_id"))


def tool_results(spark: SparkSession, folder: str) -> DataFrame:
    """Event properties as tool results, some with an error or only a message."""
    kind = F.col("event_type")
    result = (
        F.when(kind == "error", F.lit('{"error": "not found"}'))
        .when(kind == "view", F.lit('{"message": "nothing recorded"}'))
        .when(kind == "signup", F.lit('{"message": "partial", "recipe": "R1"}'))
        .otherwise(F.col("props"))
    )
    return read_table(spark, folder, "events").select("event_id", result.alias("result"))
