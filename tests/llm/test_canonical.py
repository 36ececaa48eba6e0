import pytest
from conftest import rows

from loomgraph.llm import canonical

ENTRIES = [
    (1, "is_a", ["instance of"]),
    (5, "incompatible_with", ["conflicts with"]),
    (8, "supports", ["offers"]),
    (13, "replaces", ["supersedes"]),
    (16, "reads_from", ["consumes", "takes input from"]),
    (24, "tested_with", ["verified using"]),
    (6, "causes", ["leads to"]),
]


@pytest.mark.parametrize(
    "value, meant",
    [
        ("readsFrom", 16),
        ("READS FROM", 16),
        ("reading from", 16),
        ("  rel:reads.from ", 16),
        ("raeds_from", 16),
        ("ｒｅａｄｓ ｆｒｏｍ", 16),
        ("rеads frоm", 16),  # look-alike letters
        ("reads​From", 16),
        ("r3ads fr0m", 16),
        ("mostly takes input from", 16),
        ("has support for", 8),
        ("is the replacement for", 13),
        ("not compatible with", 5),
        ("isa", 1),
        ("is an", 1),
        ("tested with", 24),
        ("tasted", -1),
        ("is cousin of", -1),
        ("plays chess against", -1),
        ("???", -1),
        ("12", -1),
        ("unknown", -1),
        ("x" * 20_000, -1),
    ],
)
def test_values(value, meant):
    assert canonical.Canon(ENTRIES).find(value) == meant


def test_rows_nulls_blanks_and_repeats(spark):
    reference = spark.createDataFrame(ENTRIES, "predicate_id long, name string, aliases array<string>")
    facts = spark.createDataFrame(
        [(1, "reads from", 0), (1, "reads from", 0), (2, None, 0), (3, " \t ", 0), (4, "reads_from", 0), (5, "", 0), (6, "zzz", 0), (None, "reads from", 0), (7, "\n", 0)],
        "id long, predicate string, predicate_id int",
    )
    assert rows(canonical.found(facts.filter("id is not null"), reference)) == [(1, 16), (6, -1), (7, -1)]
    assert rows(canonical.unmatched_report(facts, reference)) == [("\n", 1), ("zzz", 1)]
    assert canonical.found(facts.limit(0), reference).count() == 0
    assert rows(canonical.found(facts.filter("id = 1"), reference.limit(0))) == [(1, -1)]


def test_long_list_is_refused(spark, monkeypatch):
    monkeypatch.setattr(canonical, "MOST_CANONICAL", 2)
    reference = spark.createDataFrame(ENTRIES, "predicate_id long, name string, aliases array<string>")
    with pytest.raises(ValueError):
        canonical.found(spark.createDataFrame([(1, "x")], "id long, predicate string"), reference)


def test_the_latest_delivery_counts(spark):
    reference = spark.createDataFrame(ENTRIES, "predicate_id long, name string, aliases array<string>")
    facts = spark.createDataFrame([(1, "reads from", 1), (1, "supporting", 2), (2, "tested using", 2), (2, "cause", 1), (3, "cause", None)], "id long, predicate string, at long")
    from pyspark.sql import functions as F

    dated = facts.withColumn("received_at", F.timestamp_seconds("at"))
    assert rows(canonical.found(dated, reference)) == [(1, 8), (2, 24), (3, 6)]
