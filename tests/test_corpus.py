from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from yieldloom import schemas
from yieldloom.functions import text as X
from yieldloom.operators import captions, corpus, documents, manifest, pages
from yieldloom.sources import corpus_files


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v")).alias("x")).first().x


def test_normalize_text(spark):
    raw = "  café x /p>\n  two\t\tthree "
    assert one(spark, raw, X.normalize_text) == "café x two three"
    assert one(spark, "Å", X.normalize_text) == "Å"


@pytest.mark.parametrize(
    ("url", "slug"),
    [
        ("https://a.com/x/y z?q=1", "y_z"),
        ("https://a.com/", "index"),
        ("https://a.com", "index"),
        ("https://a.com/p/", "p"),
    ],
)
def test_url_slug(spark, url, slug):
    assert one(spark, url, X.url_slug) == slug


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Yield (수율)", ("Yield", ["수율"])),
        ("FDC（Fault, Detection/Class） ", ("FDC", ["Fault", "Detection", "Class"])),
        ("(only)", ("(only)", [])),
        ("plain", ("plain", [])),
    ],
)
def test_term_aliases(spark, raw, want):
    got = one(spark, raw, X.term_and_aliases)
    assert (got.term, got.aliases) == want


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("[반도체 후공정 2편] x", ("반도체 후공정", 2)),
        ("[특강] x", ("특강", None)),
        ("x", (None, None)),
    ],
)
def test_series(spark, title, want):
    got = one(spark, title, X.series_and_part)
    assert (got.series, got.part) == want


def test_sections_keep_heading_numbers(spark):
    body = "intro\n## A\ntext a\n## \n## B\n\n## C\ntext c"
    got = [(s.ordinal, s.heading, s.text) for s in one(spark, body, X.sections)]
    assert got == [(0, None, "intro"), (1, "A", "text a\n##"), (3, "C", "text c")]
    assert [(s.ordinal, s.heading) for s in one(spark, "## A\nx", X.sections)] == [(1, "A")]


def test_defect_variants(spark):
    assert one(spark, "박리 (Delamination)", X.defect_name_variants) == ["박리 (Delamination)", "박리", "Delamination"]
    assert one(spark, "void", X.defect_name_variants) == ["void"]
    assert len(one(spark, "몰딩 온도 스펙 이탈", X.defect_name_variants)) == 3


def test_captions_go_to_the_last_section_reached(spark):
    docs = spark.createDataFrame(
        [("d", "intro\n## A\na\n## B\n\n## C\nc", [(0, "zero", "ok"), (2, "two", "ok"), (9, "nine", "ok"), (1, "bad", "error")])],
        "doc_id string, body string, captions array<struct<section:int,caption:string,status:string>>",
    ).withColumn("sections", X.sections(F.col("body")))
    row = documents.merge_captions(docs).first()
    assert row.n_captions == 3
    assert [s.text for s in row.sections] == [
        "intro\n\n[그림 설명: zero]", "a\n\n[그림 설명: two]", "c\n\n[그림 설명: nine]",
    ]


def test_captions_equal_brute_force_and_stay_linear(spark):
    rng = random.Random(3)
    rows = []
    for d in range(40):
        ordinals = sorted(rng.sample(range(12), rng.randint(0, 6)))
        found = [(rng.choice([None, *range(-1, 15)]), f"c{i}", rng.choice(["ok", "error"])) for i in range(rng.randint(0, 8))]
        rows.append((d, [(o, None, f"t{o}") for o in ordinals], found if d % 9 else None))
    rows.append((99, [(o, None, "t") for o in range(3000)], [(o, "c", "ok") for o in range(3000)]))
    docs = spark.createDataFrame(
        rows, "doc_id int, sections array<struct<ordinal:int,heading:string,text:string>>, "
        "captions array<struct<section:int,caption:string,status:string>>",
    )
    got = {r.doc_id: (r.n_captions, [s.text for s in r.sections]) for r in documents.merge_captions(docs).collect()}
    for d, sections, found in rows[:-1]:
        ok = [c for c in found or [] if c[2] == "ok"] if sections else []
        want = [s[2] for s in sections]
        for number, caption, _ in ok:
            at = max(0, sum(s[0] <= number for s in sections) - 1) if number is not None else 0
            want[at] += f"\n\n[그림 설명: {caption}]"
        assert got[d] == (len(ok), want)
    assert got[99] == (3000, ["t\n\n[그림 설명: c]"] * 3000)


def test_bodies_are_split_once(spark, tmp_path):
    columns = "doc_id string, slug string, title string, source string, url string, language string, doc_type string, body string"
    docs = spark.createDataFrame([("d", "s", "t", "x", "u", "ko", "article", "## h\ntext"), ("e", "s", "t", "x", "u", "ko", "article", "")], columns)
    docs.withColumn("captions", F.lit(None).cast("array<struct<section:int,caption:string,status:string>>")).write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    built = documents.structure(stored)
    assert [r.doc_id for r in built.collect()] == ["d"]
    splits = [f._jdf.queryExecution().optimizedPlan().toString().count("split(body") for f in (built, stored.select(X.sections(F.col("body")).alias("s")))]
    assert splits[0] == splits[1] > 0


def test_dedupe_keeps_all_columns(spark):
    blocks = spark.createDataFrame([(1, 3, "a", "p"), (1, 0, "a", "h"), (1, 1, "b", "p"), (2, 5, "a", None)], "page_id int, pos int, text string, kind string")
    got = {tuple(r) for r in documents.block_dedupe(blocks).collect()}
    assert got == {(1, 0, "a", "h"), (1, 1, "b", "p"), (2, 5, "a", None)}


def test_quality_gate(spark):
    docs = spark.createDataFrame(
        [("short", "s", "article", "x"), ("flat", "s", "article", "x" * 600), ("ok", "s", "article", "## h\n" + "x" * 600), ("gloss", "s", "glossary", "x")],
        "doc_id string, source string, doc_type string, body string",
    )
    got = {r.doc_id: (r.include, r.reason) for r in documents.quality_gate(docs).collect()}
    assert got == {"short": (False, "too_short"), "flat": (True, "no_sections"), "ok": (True, None), "gloss": (False, "no_terms")}


def pack(paragraphs, limit=450):
    parts, size = [], 0
    for p in paragraphs:
        cost = len(p) // 2
        if parts and not (not p.startswith("[그림 설명:") and size + cost > limit):
            parts[-1] += "\n\n" + p
            size += cost
        else:
            parts.append(p)
            size = cost
    return parts


@pytest.mark.parametrize(
    "paragraphs",
    [
        ["a" * 100, "b" * 100],
        ["a" * 600, "b" * 600, "c" * 400],
        ["a" * 3000],
        ["[그림 설명: x]", "a" * 880, "b" * 880, "[그림 설명: " + "y" * 900 + "]", "c" * 10],
        ["a" * 902, "b", "", "c" * 1000],
    ],
)
def test_chunk_packing(spark, paragraphs):
    text = "\n\n".join(paragraphs)
    section = (0, None, text)
    docs = spark.createDataFrame(
        [("d", "T", "s", "u", None, None, "ko", "article", [section])],
        "doc_id string, title string, source string, url string, series string, part int, language string, "
        "doc_type string, sections array<struct<ordinal:int,heading:string,text:string>>",
    )
    got = corpus.chunk_sections(docs).orderBy("piece").collect()
    want = [text] if len(text) // 2 <= 500 else pack([p for p in paragraphs if p.strip()])
    assert [r.text for r in got] == [w.strip() for w in want]
    if len(want) > 1:
        assert got[0].context_header == f"[T] > (서두) (1/{len(want)})"


def test_senses(spark):
    def senses(term, text):
        row = spark.createDataFrame([(term, text)], "t string, d string")
        return row.select(corpus.split_senses(F.col("t"), F.col("d")).alias("s")).first().s

    assert senses("die", "One thing. (2) (in a package): Another. (3) Third") == ["One thing", "(in a package) Another", "Third"]
    assert senses("die", "(1) First. (2) Second.") == ["First", "Second."]
    assert senses("die", "Only one.") == ["Only one."]
    # Another term starts over at (1): cut before it. The same term is kept.
    assert senses("die", "Mine. scratch (1) A mark.") == ["Mine."]
    assert senses("die", "Mine. die pad (1) A pad.") == ["Mine. die pad (1) A pad."]


def cards(spark, rows):
    frame = spark.createDataFrame(rows, "id long, term string, definition string")
    return frame.withColumn("canonical_term", X.canonical_term(F.col("term")))


def test_see_references_are_one_hop(spark):
    data = cards(
        spark,
        [
            (1, "ball grid array", "A package."),
            (2, "BGA", 'See "Ball  Grid Array".'),
            (3, "A", "See B"),
            (4, "B", "see 'C'"),
            (5, "C", "Real."),
            (6, "self", "See self"),
            (7, "lost", "See nowhere"),
            (8, "C", "Second card."),
        ],
    )
    assert {r.id for r in corpus.resolve_see_refs(data).collect()} == {1, 5, 8}
    got = {tuple(r) for r in corpus.see_aliases(data).collect()}
    assert got == {("ball grid array", "BGA"), ("b", "A"), ("c", "B")}
    assert {tuple(r) for r in corpus.absorbed_names(data).collect()} == {(1, "BGA"), (5, "B"), (8, "B")}
    named = data.withColumn("aliases", F.array().cast("array<string>"))
    kept = {r.id: r for r in corpus.with_absorbed_names(named).collect()}
    assert set(kept) == {1, 5, 8} and "BGA" in kept[1].aliases and "B" in kept[8].aliases
    assert {r.state: r.n for r in corpus.see_report(data).collect()} == {"kept": 3, "absorbed": 3, "dropped": 2}


def test_footnotes(spark):
    docs = spark.createDataFrame(
        [("d", "s", "u", "ko", "article", [(0, None, "x\n※ Yield (수율): share\n※ no colon\n※ A ：  B ")])],
        "doc_id string, source string, url string, language string, doc_type string, "
        "sections array<struct<ordinal:int,heading:string,text:string>>",
    )
    got = sorted((r.term, r.aliases, r.definition) for r in corpus.cards_from_footnotes(docs).collect())
    assert got == [("A", [], "B"), ("Yield", ["수율"], "share")]


def test_ids_follow_file_names_and_keep_all_digits(spark):
    rows = spark.createDataFrame([("a",), ("a-b",), ("b",)], "doc_id string").withColumn("piece", F.lit(0))
    got = {r.doc_id: r.id for r in corpus.assign_corpus_ids(rows, "chunk", "doc_id", ["piece"]).collect()}
    assert got == {"a-b": "chunk-0001", "a": "chunk-0002", "b": "chunk-0003"}
    many = spark.range(10001).select(F.col("id").cast("string").alias("doc_id"), F.lit(0).alias("piece"))
    ids = {r.id for r in corpus.assign_corpus_ids(many, "card", "doc_id", ["piece"]).collect()}
    assert len(ids) == 10001 and "card-10001" in ids and "card-0001" in ids


HTML = """<html><body><nav><p>menu</p></nav><div class="post-contents"><div class="post-intro"><p>skip</p></div>
<h3 class="sub-title">First &amp; one</h3><p>Body <b>bold</b>
text</p><p><img src="a.png" alt="A"></p><p class="footnote">T1: d1<br>T2: d2</p>
<table><tr><td>a</td><td>b</td></tr></table><h3>plain</h3><p class="caption">cap</p><h3 class="sub-title">Second</h3>
<p>open <p>next</div><p>after</p></body></html>"""


def test_page_blocks(spark):
    frame = spark.createDataFrame([(1, HTML), (2, "<p>nothing here</p>"), (3, None)], "page_id long, html string")
    blocks = pages.page_blocks(frame, pages.NEWSROOM)
    got = [(r.section, r.kind, r.text or r.src) for r in blocks.orderBy("page_id", "pos").collect()]
    assert got == [
        (1, "heading", "First & one"), (1, "paragraph", "Body bold text"), (1, "image", "a.png"),
        (1, "footnote", "T1: d1"), (1, "footnote", "T2: d2"), (1, "table_row", "| a | b |"), (1, "caption", "cap"),
        (2, "heading", "Second"), (2, "paragraph", "open"), (2, "paragraph", "next"),
    ]
    assert [tuple(r) for r in pages.page_images(blocks).collect()] == [(1, 2, 1, "a.png", "A")]


NEWS = """<html><body><h2 class="post-title">My&nbsp;title</h2><div class="post-contents">
<h3 class="sub-title">One</h3><p>text<span style="color: red;">*</span></p><p>with <img src="a.png" alt="A"> picture</p>
<p class="footnote">T1: d1<br>T2: d2</p><p class="caption">Figure (ⓒ Owner)<br>출처: site</p>
<table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table><p>end</p></div></body></html>"""
SHOP = """<html><head><title>Shop</title></head><main><h1>Line</h1><ul><li>outer <p>inner</p></li><li>x</li><li>y</li></ul>
<h3>Sub</h3><p>inner</p><p>more</p><button><p>buy</p></button></main></html>"""


def test_clean_documents(spark):
    frame = spark.createDataFrame([(1, NEWS), (2, "<p>no root</p>"), (3, None), (4, "")], "page_id long, html string")
    got = {r.page_id: (r.title, r.body) for r in pages.clean_documents(frame, pages.NEWSROOM).collect()}
    body = "## One\n\ntext\n\n※ T1: d1\n※ T2: d2\n\nFigure\n\n| a | b |\n| c |\n\nend"
    assert got == {1: ("My title", body), 2: ("", ""), 3: ("", ""), 4: ("", "")}
    frame = spark.createDataFrame([(1, SHOP)], "page_id long, html string")
    got = pages.clean_documents(frame, pages.PRODUCT).first()
    assert (got.title, got.body) == ("Shop", "## Line\n\ninner\n\n- x\n- y\n\n### Sub\n\nmore")
    blocks = pages.page_blocks(frame, pages.PRODUCT).orderBy("pos").collect()
    assert [b.text for b in blocks] == ["Line", "inner", "x", "y", "Sub", "more"]
    assert pages.clean_documents(frame.limit(0), pages.PRODUCT).count() == 0


def test_glossary_pairs_stop_at_the_next_heading(spark):
    html = '<body><h3 class="m-heading-type3">A</h3><h3 class="m-heading-type3">B</h3><p>x</p><div class="m-text">b def</div></body>'
    frame = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = pages.glossary_pairs(pages.page_blocks(frame, pages.GLOSSARY)).collect()
    assert [(r.term, r.definition) for r in got] == [("B", "b def")]


def test_glossary_from_spans(spark):
    spans = [
        ("(lost):", 10.0, True), ("noise before", 10.0, False), ("chip", 10.0, True), ("out (1):", 10.0, True),
        ("a crack at the edge", 10.0, False), ("header", 11.0, False), ("Example", 10.0, True), ("of a crack", 10.0, False),
        ("(2) (in use):", 10.0, True), ("second sense", 10.0, False), ("#12", 10.0, False),
        ("die:", 10.0, True), ("short", 10.0, False), ("wafer:", 10.0, True), ("a thin slice of silicon", 10.0, False),
        ("dangling", 10.0, True),
    ]
    frame = spark.createDataFrame(
        [("d", i // 4, i, t, s, b) for i, (t, s, b) in enumerate(spans)],
        "doc_id string, page long, pos int, text string, size double, bold boolean",
    )
    got = {r.term: r.definition for r in pages.glossary_from_spans(frame).collect()}
    assert got == {
        "(lost)": "noise before",
        "chip out (1)": "a crack at the edge Example of a crack (2) (in use): second sense",
        "wafer": "a thin slice of silicon",
    }


def test_term_filter_needs_letter_boundaries(spark):
    frame = spark.createDataFrame([("die attach",), ("diet",), ("Burn-in board",), ("soldier",), ("BGA2",)], "term string")
    assert {r.term for r in manifest.term_keyword_filter(frame).collect()} == {"die attach", "Burn-in board", "BGA2"}


def test_manifest_modes(spark):
    schema = "source string, url string, file string, sha256 string, bytes long, status string, seq long"
    old = spark.createDataFrame([("s", "u1", "f", "a", 1, "candidate", 1), ("s", "u2", "f", "a", 1, "failed", 1)], schema)
    new = spark.createDataFrame([("s", "u1", "f", "b", 2, "downloaded", 2), ("s", "u1", "f", "c", 3, "downloaded", 3)], schema)
    replaced = {r.url: r.sha256 for r in manifest.manifest_upsert(old, new).collect()}
    kept = {r.url: r.sha256 for r in manifest.manifest_upsert(old, new, "keep").collect()}
    assert replaced == {"u1": "c", "u2": "a"} and kept == {"u1": "a", "u2": "a"}


def test_caption_classes_in_order(spark):
    long = " " * 50
    frame = spark.createDataFrame(
        [("1", "짧다", "ok"), ("2", "로고 →" + long, "ok"), ("3", "A → B 단면" + long, "ok"), ("4", "단면" + long, "ok"), ("5", "x" + long, "ok"), ("6", "x" + long, "error: 500")],
        "src string, caption string, status string",
    )
    got = {r.src: r.category for r in captions.caption_risk_class(frame).collect()}
    assert got == {"1": "suspect", "2": "suspect", "3": "flow", "4": "structure", "5": "other"}
    excluded = spark.createDataFrame([("5",), ("6",), ("9",)], "src string")
    assert {r.name: r.n for r in captions.exclusion_report(frame, excluded).collect()} == {"changed": 1, "requested": 3}


def test_front_matter_files(spark, tmp_path):
    folder = tmp_path / "site"
    folder.mkdir()
    (folder / "page.md").write_text("---\ntitle: A: b\nurl: \nkey: 1\nkey: 2\n---\n## H\nbody\n")
    (folder / "bare.md").write_text("no matter")
    got = {r.doc_id: (r.meta, r.body) for r in corpus_files.read_clean_docs(spark, str(tmp_path)).collect()}
    assert got["site-page"] == ({"title": "A: b", "url": None, "key": "2"}, "## H\nbody\n")
    assert got["site-bare"] == ({}, "no matter")


def test_titles_and_merged_sources(spark, tmp_path):
    old = spark.createDataFrame([("d001", "a", "A", "x"), ("d002", "b", "B", "y"), ("d009", "c", "C", "z")], "id string, source string, title string, text string")
    fresh = spark.createDataFrame([(2, "c", "C2", "t"), (1, "c", "C1", "t")], "n int, source string, title string, text string")
    merged = manifest.replace_by_source(old, fresh, ["n"])
    assert sorted((r.id, r.title) for r in merged.collect()) == [("d001", "A"), ("d002", "B"), ("d003", "C1"), ("d004", "C2")]
    corpus_files.write_titles(manifest.corpus_titles(merged), str(tmp_path / "titles"))
    assert "d003\tc\tC1" in {r.value for r in spark.read.text(str(tmp_path / "titles")).collect()}


def test_case_and_corpus_files(spark, tmp_path):
    cases = {"cases": [{"id": "1", "query": "q", "expected_keywords": ["ML001", ["a", "b"], "[x]"]}, {"id": "2"}]}
    (tmp_path / "cases.json").write_text(json.dumps(cases, indent=1))
    got = {r.id: r.expected_keywords for r in corpus_files.read_eval_cases(spark, str(tmp_path / "cases.json")).collect()}
    assert got == {"1": [["ML001"], ["a", "b"], ["[x]"]], "2": None}
    (tmp_path / "cards.jsonl").write_text('{"id": "card-0001", "term": "x", "aliases": ["y"], "definition": "z"}\n')
    row = corpus_files.read_corpus_jsonl(spark, str(tmp_path / "cards.jsonl"), schemas.CARD).first()
    assert (row.id, row.aliases, row.source) == ("card-0001", ["y"], None)


def test_manifest_carries_details_and_failures(spark):
    kind = "source string, url string, content string, seq long, status string, title string, fetched_at string, note string"
    old = spark.createDataFrame([("s", "http://x/a", "old", 1, "downloaded", "A", "2026-01-01", None), ("s", "http://x/b", "b", 1, "downloaded", "B", "2026-01-01", "kept")], kind)
    new = spark.createDataFrame([("s", "http://x/a", None, 2, "downloaded", "A2", "2026-02-01", "status 500"), ("s", "http://x/c", "c", 3, "downloaded", None, "2026-02-02", None)], kind)
    old, new = manifest.fetch_records(old), manifest.fetch_records(new)
    got = {r.url[-1]: (r.file, r.bytes, r.status, r.title, r.fetched_at, r.note) for r in manifest.manifest_upsert(old, new).collect()}
    assert got == {
        "a": (None, 0, "failed", "A2", "2026-02-01", "status 500"),
        "b": ("s/b.html", 1, "downloaded", "B", "2026-01-01", "kept"),
        "c": ("s/c.html", 1, "downloaded", None, "2026-02-02", None),
    }
    kept = {r.url[-1]: r.status for r in manifest.manifest_upsert(old, new, "keep").collect()}
    assert kept == {"a": "downloaded", "b": "downloaded", "c": "downloaded"}
