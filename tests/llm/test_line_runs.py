from __future__ import annotations

import hashlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.llm.tables import BLANKS, ascii_lower, multiset, write
from yieldloom.llm import line_runs, queries


def brute(records):
    def rank(doc_id):
        return -1 if doc_id is None else doc_id

    holders, keeper = defaultdict(int), {}
    for doc_id, text, _ in records:
        for key in {ascii_lower(x.strip(BLANKS)) for x in (text or "").split("\n")}:
            if len(key) >= 40:
                holders[key] += 1
                keeper[key] = max(keeper.get(key, -2), rank(doc_id))
    for doc_id, text, _ in records:
        lines = (text or "").split("\n")
        stay = []
        for line in lines:
            key = ascii_lower(line.strip(BLANKS))
            if holders.get(key, 0) < 5 or keeper[key] == rank(doc_id):
                stay.append(line)
        kept = "\n".join(stay)
        yield doc_id, len(lines), len(lines) - len(stay), hashlib.sha256(kept.encode()).hexdigest()


def test_against_brute_force(spark, folder, records):
    got = multiset(map(tuple, queries.op4_line_runs(spark, folder).collect()))
    assert got == multiset(brute(records))
    assert sum(r[2] for r in got) == 14


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (3, 2), (7, 3)])
def test_batches_do_not_matter(spark, tmp_path, batches, fanout):
    lines = [f"line number {i % 7} is long enough to be counted here" for i in range(60)]
    rows = [(i, "\n".join(lines[i : i + 1 + i % 4] + [lines[i]] * (i % 3)), "s") for i in range(40)]
    docs = queries.documents(spark, write(tmp_path / "sf", rows, clashes=False))
    got = line_runs.dedupe_lines(docs, n_batches=batches, fanout=fanout)
    got = got.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert multiset(map(tuple, got)) == multiset(brute(rows))


def test_runs_compact_and_settled_lines_stay_out(spark):
    def batch(*rows):
        return spark.createDataFrame(list(rows), "h1 long, h2 long, n_docs long, keep_id long")

    runs = line_runs.LineRuns(spark, min_docs=5, fanout=2)
    runs.add(batch((1, 1, 6, 90), (2, 2, 2, 95)))
    second = runs.add(batch((1, 1, 4, 80), (2, 2, 3, 70), (3, 3, 1, 60)))
    # The first line is settled, the second is not.
    assert multiset(r["h1"] for r in second.collect()) == [2, 3]
    assert [len(level) for level in runs.levels] == [0, 1]
    runs.add(batch((1, 1, 1, 99)))
    got = {tuple(r) for r in runs.repeated().collect()}
    assert got == {(1, 1, 99), (2, 2, 95)}


def test_empty_table(spark, empty):
    assert queries.op4_line_runs(spark, empty).collect() == []


def test_repeated_ids_count_row_by_row(spark, tmp_path):
    """A line in three rows of one id and in two others is in five documents, in SQL as well."""
    line = "this line is shared and has more than forty characters"
    rows = [(1, f"{line}\na{i}", "s") for i in range(3)] + [(2, line, "s"), (3, f"b\n{line}", "s"), (None, line, "s")]
    folder = write(tmp_path / "sf", rows, clashes=False)
    got = queries.op4_line_runs(spark, folder).collect()
    assert multiset(map(tuple, got)) == multiset(brute(rows))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    assert multiset(connection.execute(queries.ORACLES["op4_line_runs"]).fetchall()) == multiset(map(tuple, got))
    assert sum(r["n_dropped"] for r in got) == 5


def test_small_table_against_sql(spark, folder):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = connection.execute(queries.ORACLES["op4_line_runs"]).fetchall()
    assert multiset(want) == multiset(map(tuple, queries.op4_line_runs(spark, folder).collect()))
