"""Round trips of files, and the store's changes."""

import json

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import contracts, registry, repository
from scriptorium.sources import artefacts


def test_entries_come_back_without_bad_lines(spark, tmp_path):
    p = str(tmp_path / "entries")
    artefacts.save_entries(spark.createDataFrame([("a", 3), ("b", 1)], "word string, frequency long"), p)
    (tmp_path / "entries" / "part-x.json").write_text('not json\n{"word": "c", "frequency": 2}\n{}\n')
    assert {tuple(r) for r in artefacts.load_entries(spark, p, "word string, frequency long").collect()} == {("a", 3), ("b", 1), ("c", 2)}


def test_golden_questions(spark, tmp_path):
    f = tmp_path / "q.jsonl"
    f.write_text("\n// note\n" + json.dumps({"id": "q007", "query": "الوضوء", "must_contain": ["x"]}) + "\nbroken {\n" + json.dumps({"id": "q012", "query": "b"}) + "\n")
    g = artefacts.load_golden(spark, str(f))
    assert {(r.id, r.query) for r in g.collect()} == {("q007", "الوضوء"), ("q012", "b")} and artefacts.next_golden_id(g).first().id == "q013"
    assert artefacts.next_golden_id(g.limit(0)).first().id == "q001"


def test_texts_graphs_rankers_and_logs(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("سطر\r\nline".encode() + b"\xff")
    (tmp_path / "b.epub").write_bytes(b"x")
    t = artefacts.plain_texts(spark, str(tmp_path))
    assert [(r.line, r.text) for r in artefacts.text_lines(t).orderBy("line").collect()] == [(1, "سطر"), (2, "line")]
    n, e = spark.createDataFrame([("x",)], "id string"), spark.createDataFrame([("x", "y")], "source string, target string")
    artefacts.save_graph(n, e, str(tmp_path / "g"))
    assert [d.count() for d in artefacts.load_graph(spark, str(tmp_path / "g"))] == [1, 1]
    artefacts.save_ranker(spark, {"b": 0.5, "a": -0.25}, str(tmp_path / "r"))
    assert artefacts.load_ranker(spark, str(tmp_path / "r")) == {"a": -0.25, "b": 0.5}
    for _ in range(2):
        artefacts.append_audit(n, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_vectors_are_replaced_or_refused(spark):
    new = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0]), (3, None), (4, [float("nan"), 1.0]), (None, [1.0, 1.0]), (5, [0.0, 1.0]), (5, [0.0, 1.0])], "id int, v array<double>")
    old = spark.createDataFrame([(1, [9.0, 9.0]), (9, [8.0, 8.0]), (8, [1.0, 2.0, 3.0])], "id int, v array<double>")
    table, refused = artefacts.upsert_vectors(old, new, "id", "v", 2)
    assert {(r.id, tuple(r.v)) for r in table.collect()} == {(1, (1.0, 2.0)), (5, (0.0, 1.0)), (9, (8.0, 8.0))} and table.count() == 3
    assert {(r.id, r.reason) for r in refused.collect()} == {(2, "size"), (3, "no vector"), (4, "not a number"), (None, "no key")}
    assert artefacts.upsert_vectors(None, new, "id", "v", 2)[0].count() == 2


def test_store_changes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "id int, x string")
    stays, gone = repository.delete(df, "id", spark.createDataFrame([(2,), (7,), (2,)], "id int"))
    assert {r.x for r in stays.collect()} == {"a", "d"} and gone.first().deleted == 2
    assert repository.first(df, ["x"]).first().x == "a" and repository.first(df.limit(0), ["x"]).count() == 0
    assert {r.x for r in repository.where_equal(df, id=None).collect()} == {"d"}
    made = repository.imported(spark.createDataFrame([("d", 1, "a\n\nb\n\n "), ("d", 2, None)], "doc string, page_number int, t string"), "doc", "t")
    assert [(r.element_order, r.text_raw) for r in made["elements"].orderBy("element_order").collect()] == [(1, "a"), (2, "b")] and made["images"].filter("path = 'pages/d/2.png'").count() == 1


def test_parts_are_gated():
    assert registry.require("layout") == "operators.structure" and registry.require("fuzzy") == "operators.retrieval"
    for part, partial in (("fuzzy", False), ("pdf_import", True), ("no such part", True)):
        with pytest.raises(registry.NotReady):
            registry.require(part, partial)


def test_contracts(spark):
    df = spark.createDataFrame([("t", 1, None), (" ", 0, "x"), (None, None, " ")], "title string, volumes int, language string")
    rules = contracts.CONTRACTS["books"]
    assert {r.rule: r.rows for r in contracts.violations(df, rules).collect()} == {"title": 2, "volumes": 1, "language": 1}
    assert [r.broken for r in contracts.valid(df, rules).collect()] == [[], ["title", "volumes"], ["title", "language"]]
    a = spark.createDataFrame([(True, ["s"], None), (True, [], None), (False, None, "why"), (None, None, "")], "a boolean, s array<string>, r string")
    assert [r[0] for r in a.select(contracts.valid_answer(F.col("a"), F.col("s"), F.col("r"))).collect()] == [True, False, True, False]
