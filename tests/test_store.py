import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.functions.text import is_oversized
from loomgraph.operators import chunker, codegraph, ingest, memory, ordering, store
from loomgraph.sources.tables import of_graph


@pytest.fixture(scope="module")
def graph(spark):
    observations = spark.createDataFrame([(1, "a", 10), (2, "b", 20), (3, "c", 30)], "id long, content string, created_at long")
    facts = spark.createDataFrame([(7, "s", "p", "o"), (8, "s", "p", None), (9, "s", "p", "o")], "id long, subject string, predicate string, object string")
    edges = spark.createDataFrame([(1, 7), (2, 7), (2, 8)], "src long, dst long")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (4, [1.0, 0.0]), (3, None)], "vec_id long, embedding array<float>")
    return observations, facts, edges, vectors


def test_links_are_sets_and_need_their_ends(spark, graph):
    observations, facts, edges, _ = graph
    new = spark.createDataFrame([(1, 7), (3, 9), (3, 9)], "src long, dst long")
    assert rows(store.link_evidence(edges, new, observations, facts)) == [(1, 7), (2, 7), (2, 8), (3, 9)]
    with pytest.raises(ValueError, match="dst 70, src 5"):
        store.link_evidence(edges, spark.createDataFrame([(5, 7), (1, 70)], "src long, dst long"), observations, facts)
    assert rows(store.link_evidence(edges, edges.limit(0), observations, facts)) == rows(edges)


def test_first_link_distils(spark, graph):
    observations = graph[0]
    chunks = spark.createDataFrame([(1, None, "x"), (2, 0, "x"), (3, 5, "y"), (4, None, None)], "id long, last_distilled_at long, source string")
    new = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 3)], "src long, dst long")
    linked, marked = store.link_motivates(new.limit(0), new, observations, chunks, 99)
    assert rows(linked) == [(1, 1), (1, 2), (2, 3)]
    assert rows(marked.select("id", "last_distilled_at")) == [(1, 99), (2, 99), (3, 5), (4, None)]
    assert rows(store.motivating(linked, chunks.filter("source = 'x'"))) == [(1, 1), (2, 1)]
    with pytest.raises(ValueError):
        store.link_motivates(linked, spark.createDataFrame([(1, 77)], "src long, dst long"), observations, chunks, 99)
    left, kept = store.delete_source(chunks, linked, "x")
    assert rows(left.select("id")) == [(3,), (4,)] and rows(kept) == []


def test_lookups(graph):
    observations, facts, _, _ = graph
    assert store.get(observations, 2).content == "b"
    with pytest.raises(LookupError, match="observation 44"):
        store.get(observations, 44, "observation")
    assert rows(store.find_fact(facts, "s", "p", "o")) == [(7, "s", "p", "o")]
    assert store.find_fact(facts, "s", "p", "q").count() == 0


def test_a_new_observation_is_not_its_own_neighbour(graph):
    observations, facts, edges, vectors = graph
    more, indexed, similar = store.add_observation(observations, vectors, facts, edges, " new ", [1.0, 0.0], 50, k=1)
    assert rows(more.filter("id > 3")) == [(4, "new", 50)] and indexed.count() == 5
    assert rows(similar.select("id")) == [(7,)]
    assert rows(store.search_observations(observations, vectors, [1.0, 0.0], 5).select("id", "distance")) == [(1, 0.0), (2, 1.0)]
    with pytest.raises(ValueError):
        store.add_observation(observations, vectors, facts, edges, " ", [1.0, 0.0], 50)
    assert store.add_observation(observations.limit(0), vectors, facts, edges, "first", [1.0, 0.0], 50)[0].first().id == 1


def test_meta_of_graphs(spark):
    meta = spark.createDataFrame([], "graph string, kind string, strict boolean")
    meta = store.ensure_meta(store.ensure_meta(meta, "g", "code", False), "h", "memory", True)
    meta = store.ensure_meta(meta, "g", "code", True)
    assert rows(meta) == [("g", "code", True), ("h", "memory", True)]
    assert store.read_meta(meta, "x") is None and store.read_meta(meta, "h").strict
    with pytest.raises(ValueError, match="kind code"):
        store.ensure_meta(meta, "g", "memory", True)
    assert rows(store.delete_graph(meta, "g")) == [("h", "memory", True)]


def test_chunks_of_files(spark):
    chunks = spark.createDataFrame([("g", "a.md", 1, "x"), ("g", "a.md", 2, "y" * 7000), ("g", "b.md", 3, None), ("h", "a.md", 4, "")], "graph string, source string, id long, content string")
    files = spark.createDataFrame([("g", "a.md", 11), ("g", "a.md", 10), ("h", "z.md", 12)], "graph string, path string, id long")
    assert rows(store.of_file(chunks, files, is_oversized)) == [("g", 1, 10, False), ("g", 2, 10, True)]


def test_running_sum_over_ranges(spark):
    rng = random.Random(1)
    data = [("hot" if k % 3 else rng.choice("ab"), k * 7 % 1009, rng.randint(0, 5)) for k in range(1000)] + [(None, 1, 2), (None, 2, 3)]
    got = rows(ordering.running_sum(spark.createDataFrame(data, "g string, k long, n long").repartition(5), ["g"], ["k"], F.col("n"), "sum"), "g", "k", "sum")
    want, sums = [], {}
    for g, k, n in sorted(data, key=lambda r: r[1]):
        sums[g] = sums.get(g, 0) + n
        want.append((g, k, sums[g]))
    assert set(got) == set(want) and len(got) == len(want)


def test_ten_thousand_headings(spark):
    text = "\n".join(f"{'#' * (1 + k % 6)} h{k}\ntext {k}" for k in range(10_000))
    got = chunker.split_sections(spark.createDataFrame([(1, text)], "id long, text string"), "id", "text").orderBy("line_start").collect()
    assert len(got) == 10_000 and got[-1].line_end == 20_000
    assert got[8].breadcrumb == "h6 > h7 > h8" and got[9_999].breadcrumb == "h9996 > h9997 > h9998 > h9999"


def test_lines_end_in_all_ways(spark):
    for text, lines in (("a\r\nb\r", ["a", "b"]), ("a\n\r", ["a"]), ("a\r\r\n", ["a\r"]), ("\n", [""]), ("a\n\n", ["a", ""]), ("a", ["a"])):
        assert spark.createDataFrame([(text,)], "t string").select(chunker.lines_of(F.col("t"))).first()[0] == lines


def test_names_and_paths(spark):
    df = spark.createDataFrame([("file:///a%20b/c+d.Ts",), ("/r/x/y",), (None,)], "p string")
    assert [r[0] for r in df.select(T.uri_path(F.col("p"))).collect()] == ["/a b/c+d.Ts", "/r/x/y", None]
    assert [r[0] for r in df.select(T.relative_path(F.col("p"), "/r/")).collect()][1] == "x/y"
    assert [tuple(r) for r in df.select(T.base_name(F.col("p")), T.extension(F.col("p"))).collect()] == [("c+d.Ts", ".Ts"), ("y", ""), (None, None)]
    assert T.list_of(" a, ,b ") == ["a", "b"] and T.list_of("") == []


def test_hits_as_text(spark):
    long = "é" * 300
    schema = "id long, breadcrumb string, content string, source string, line_start int, line_end int, score double"
    hits = spark.createDataFrame([(2, "A > B", long, "s.md", 3, 9, 0.25), (1, None, None, None, None, None, 0.25), (3, "x", "a" + long, "s", 1, 1, 0.5), (4, "x", "y" * 500, "s", 1, 1, 0.75)], schema)
    texts = [r.text for r in store.hit_texts(hits).orderBy("rank").collect()]
    assert texts[0] == "### Result 1 (score: 0.2500)\n**Source:**  (lines –)\n**Breadcrumb:** \n\n\n\n---\n\n"
    assert texts[1] == f"### Result 2 (score: 0.2500)\n**Source:** s.md (lines 3–9)\n**Breadcrumb:** A > B\n\n{'é' * 250}...\n\n---\n\n"
    assert "a" + "é" * 249 + "...\n" in texts[2] and "y" * 500 + "\n" in texts[3]
    assert store.hit_texts(hits.limit(0)).count() == 0


def test_entities_described_by_chunks_with_motives(spark):
    documents = spark.createDataFrame([("g", 1, 10), ("g", 2, 10), ("g", 1, 11), ("g", 9, 12), (None, 1, 13)], "graph string, chunk_id long, entity_id long")
    motivates = spark.createDataFrame([(5, 1), (5, 2), (6, 2), (6, 2), (7, 77)], "src long, dst long")
    evidence = spark.createDataFrame([(5, 100), (5, 101), (5, 101), (6, 999)], "src long, dst long")
    facts = spark.createDataFrame([(100, "b", "x"), (101, "a", "x"), (102, None, "x")], "id long, object string, graph string")
    about = memory.about_entities(documents, motivates, evidence, facts)
    assert rows(about) == sorted([("g", 10, 5, ["a", "b"]), ("g", 10, 6, []), ("g", 11, 5, ["a", "b"]), (None, 13, 5, ["a", "b"])], key=str)
    assert memory.about_entities(documents.limit(0), motivates, evidence, facts).count() == 0


def test_code_entities_and_tables_of_a_graph(spark, tmp_path):
    df = spark.createDataFrame([("g", 1, "a", "Class"), ("g", 1, "a", "Class"), ("g", 2, "b", "File"), ("h", 3, None, "Enum"), ("h", 4, "c", None)], "graph string, id long, name string, label string")
    assert rows(codegraph.code_entities(df)) == [("g", 1, "a"), ("h", 3, None)]
    df.write.partitionBy("graph").parquet(f"{tmp_path}/entities.parquet")
    assert rows(of_graph(spark, str(tmp_path), "entities", "h", "id")) == [(3,), (4,)]
    assert of_graph(spark, str(tmp_path), "entities", "none").count() == 0
    with pytest.raises(ValueError):
        of_graph(spark, str(tmp_path), "entities", "")


def test_totals_of_a_reingest(spark):
    report = spark.createDataFrame([("s", "created", 2), ("t", "created", 1), ("s", "renamed", 1), ("s", "orphaned", 4)], "source string, action string, count long")
    chunks = spark.createDataFrame([(1, "s", True, None), (2, "s", None, None), (3, "s", True, 7), (4, "u", True, None)], "id long, source string, oversized boolean, orphaned_at long")
    edges = spark.createDataFrame([(1,), (1,), (2,), (3,), (4,)], "chunk_id long")
    names = ["created", "updated", "renamed", "unchanged", "orphaned", "stored", "oversized", "edges"]
    assert rows(ingest.totals(report, chunks, edges).select(*names)) == [(3, 0, 1, 0, 4, 4, 1, 3)]
    assert rows(ingest.totals(report.limit(0), chunks, edges).select(*names)) == [(0,) * 8]


def test_answers_in_order_of_their_index():
    assert ingest.in_request_order([(1, [2.0]), (0, [1.0])]) == [[1.0], [2.0]]
    assert ingest.in_request_order([[2.0], [1.0]]) == [[2.0], [1.0]] and ingest.in_request_order([]) == []
