import math
import random

from conftest import rows
from pyspark.sql import functions as F

from loomgraph.operators import codegraph, knn, linker, memory
from loomgraph.plans.lineage import cut
from loomgraph.plans.queries import QUERIES


def test_link(spark):
    chunks = spark.createDataFrame([("g", 1, "use `Foo` and barBaz", 0), ("g", 2, "Foo alone is no name", None), ("g", 3, "`Foo`", 99), ("h", 4, "`Foo`", 0), ("g", 5, None, 0)], "graph string, id long, content string, orphaned_at long")
    entities = spark.createDataFrame([("g", 10, "Foo"), ("g", 11, "Foo"), ("g", 12, "barBaz"), ("g", 13, "foo"), ("g", 10, "Foo"), ("g", 14, None)], "graph string, id long, name string")
    assert rows(linker.link(chunks, entities)) == [("g", 1, 10), ("g", 1, 11), ("g", 1, 12)]
    assert rows(linker.link(chunks, entities, strict=True)) == [("g", 1, 10), ("g", 1, 11)]


def test_innermost_entity(spark):
    entities = spark.createDataFrame([("g", "p", 1, 0, 50), ("g", "p", 2, 10, 20), ("g", "p", 3, 10, 20), ("g", "q", 4, 0, 9), ("g", "p", 5, None, None)], "graph string, path string, id long, src_start int, src_end int")
    refs = spark.createDataFrame([(1, "g", "p", 15), (2, "g", "p", 5), (3, "g", "p", 99), (4, None, None, None)], "ref_id long, graph string, path string, line int")
    assert rows(codegraph.at_position(entities, refs)) == [(1, 2), (2, 1), (3, -1), (4, -1)]


def test_entities_merge_on_their_key(spark):
    made = [("g", 1, "Method", "foo", "p", "A", 10, 15, "old", ""), ("g", 7, "Method", "foo", "p", "A", 30, 35, "new", ""), ("g", 2, "Method", "foo", "p", "B", 1, 2, None, "")]
    df = spark.createDataFrame(made, "graph string, id long, label string, name string, path string, parent_name string, src_start int, src_end int, doc string, signature_hash string")
    assert rows(codegraph.merge_entities(df), "id", "src_start", "doc") == [(1, 30, "new"), (2, 1, None)]


def test_edges(spark):
    edges = spark.createDataFrame([("CALLS", 1, 2, 5), ("CALLS", 1, 2, 9), ("CALLS", 2, 3, None), ("CALLS", 3, 99, 1)], "type string, src long, dst long, pos int")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    assert rows(codegraph.connect(edges, nodes), "src", "dst", "pos") == [(1, 2, 9), (2, 3, None)]
    reached = codegraph.reach(edges, nodes.filter("id = 1"), 3, cut)
    assert rows(reached) == [(1, 2, 1), (1, 3, 2), (1, 99, 3)]


def test_nearest_of_each_equals_brute_force(spark):
    rng = random.Random(3)
    data = [(k, [rng.uniform(-1, 1) for _ in range(8)]) for k in range(0, 6000, 15)] + [(7000, None), (15, [0.0] * 8)][:1]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    stored = {r.vec_id: list(r.embedding) for r in df.collect() if r.embedding}

    def distance(a, b):
        return 1 - sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b)))

    got = {}
    for r in knn.nearest_of_each(df, df.filter("vec_id % 20 = 0"), 3).collect():
        got.setdefault(r.query_id, {})[r.rank] = r.id
    for q in [k for k in stored if k % 20 == 0]:
        want = sorted((round(distance(stored[q], v), 12), k) for k, v in stored.items() if k != q)[:3]
        assert [got[q][k] for k in (1, 2, 3)] == [k for _, k in want]


def test_nearest_one(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in knn.nearest(df, [2.0, 0.0], 2).collect()] == [1, 4]
    assert [r.vec_id for r in knn.nearest(df, [2.0, 7.0], 0, dim=1).collect()][:2] == [1, 4]


def test_facts(spark):
    df = spark.createDataFrame([("g", 2, "ledger gateway", "is_a", "graph database", 5), ("g", 1, "ledger gateway", "is_a", "graph database", 9), ("g", 3, "ledger gateway", "supports", "vector search", 1), ("g", 4, "index store", "is_a", None, 1)], "graph string, id long, subject string, predicate string, object string, created_at long")
    merged = memory.merge_facts(df)
    assert rows(merged, "id", "created_at", "deliveries") == [(1, 5, 2), (3, 1, 1), (4, 1, 1)]
    assert [r.id for r in memory.search_facts(merged, subject="ledger gateway").collect()] == [1, 3]
    assert memory.search_facts(merged, subject="Nobody").count() == 0


def test_evidence(spark):
    facts = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    edges = spark.createDataFrame([(10, 1), (11, 1), (11, 2)], "src long, dst long")
    observations = spark.createDataFrame([(10, 5), (11, 6)], "id long, created_at long")
    assert rows(memory.facts_backed_by(facts, edges, observations)) == [(1,), (2,)]
    assert rows(memory.evidence_for(observations, edges, facts.filter("id = 1"))) == [(1, 10, 5), (1, 11, 6)]
    assert rows(memory.count_evidence(facts, edges)) == [(1, 2), (2, 1), (3, 0)]
    bad = spark.createDataFrame([(99, 1), (10, 98)], "src long, dst long")
    assert rows(memory.missing_endpoints(bad, observations, facts)) == [(98, "dst"), (99, "src")]


def test_evidence_queries_cover_every_event(spark, tmp_path):
    made = [(k, f"user{k % 7}", f"kind{k % 3}") for k in range(40)]
    events = spark.createDataFrame([(k, k % 7, f"kind{k % 3}", "{}") for k, _, _ in made], "event_id long, user_id long, event_type string, props string")
    events.withColumn("ts", F.timestamp_millis(F.col("event_id") * 1_000 + 1)).write.parquet(f"{tmp_path}/events.parquet")
    first = {}
    for k, subject, kind in made:
        first.setdefault((subject, kind), k + 1)
    assert rows(QUERIES["evidence_for_every_fact"](spark, str(tmp_path)), "fact_id", "observation_id") == sorted((first[s, kind], k + 1) for k, s, kind in made)
    assert rows(QUERIES["facts_backed_by_any_observation"](spark, str(tmp_path)), "id") == sorted((n,) for n in first.values())
    assert rows(QUERIES["observations_with_all_facts"](spark, str(tmp_path)), "observation_id", "facts") == [(k + 1, kind) for k, _, kind in made]
