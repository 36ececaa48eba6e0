"""The memory layer: facts, observations and the evidence that ties them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The predicates that every graph knows.
KERNEL_PREDICATES = ("is_a", "subtype_of", "part_of", "equivalent_to", "incompatible_with", "causes", "requires")


def merge_facts(rows: DataFrame) -> DataFrame:
    """One fact for each (graph, subject, predicate, object), by case: the first insert's time and the lowest id.

    Nulls are values of their own; ``deliveries`` counts the rows merged.
    """
    keys = ["graph", "subject", "predicate", "object"]
    return rows.groupBy(*keys).agg(F.min("id").alias("id"), F.min("created_at").alias("created_at"), F.count(F.lit(1)).alias("deliveries"))


def search_facts(facts: DataFrame, subject: str = "", predicate: str = "", object_: str = "", limit: int = 50) -> DataFrame:
    """The facts that equal every given part (empty: any), lowest ids first, at most ``limit`` (50 if it is below 1)."""
    found = facts
    for column, value in (("subject", subject), ("predicate", predicate), ("object", object_)):
        if value:
            found = found.filter(F.col(column) == value)
    return found.orderBy("id").limit(limit if limit > 0 else 50)


def observe(events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``events`` as observations ``(id, content, created_at)``, the facts they state ``(id, subject, predicate, object)`` and EVIDENCE_FOR edges ``(src, dst)``.

    A fact's id is the lowest id of the observations that state it, so it stays as others arrive.
    """
    stated = events.select(
        (F.col("event_id") + 1).alias("id"),
        F.col("props").alias("content"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("created_at"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("subject"),
        F.col("event_type").alias("object"),
    ).filter("id is not null and subject is not null and object is not null")
    facts = stated.groupBy("subject", "object").agg(F.min("id").alias("id")).select("id", "subject", F.lit("performed").alias("predicate"), "object")
    edges = stated.select(F.col("id").alias("src"), "subject", "object").join(facts.withColumnRenamed("id", "dst"), ["subject", "object"]).select("src", "dst")
    return stated.select("id", "content", "created_at"), facts, edges.dropDuplicates()


def missing_endpoints(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """``(id, side)`` of edge ends that no row has."""
    src = edges.select(F.col("src").alias("id")).distinct().join(sources.select("id"), "id", "left_anti").select("id", F.lit("src").alias("side"))
    dst = edges.select(F.col("dst").alias("id")).distinct().join(targets.select("id"), "id", "left_anti").select("id", F.lit("dst").alias("side"))
    return src.unionByName(dst)


def evidence_for(observations: DataFrame, edges: DataFrame, facts: DataFrame) -> DataFrame:
    """``(fact_id, observation_id, created_at)``: the observations behind each of ``facts``."""
    wanted = edges.join(facts.select(F.col("id").alias("dst")), "dst", "left_semi")
    return wanted.join(observations.select(F.col("id").alias("src"), "created_at"), "src").select(F.col("dst").alias("fact_id"), F.col("src").alias("observation_id"), "created_at")


def facts_backed_by(facts: DataFrame, edges: DataFrame, observations: DataFrame) -> DataFrame:
    """The facts that any of ``observations`` is evidence for, once each."""
    ends = edges.join(observations.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
    return facts.join(ends, "id", "left_semi")


def about_entities(documents: DataFrame, motivates: DataFrame, evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """``(graph, entity_id, observation_id, facts)``: the observations behind the chunks that describe each entity.

    From DOCUMENTS edges (``graph, chunk_id, entity_id``), MOTIVATES and EVIDENCE_FOR edges (``src, dst``);
    ``facts`` are the objects that an observation is evidence for, sorted, once each, and empty if there are none.
    """
    behind = documents.join(motivates.select(F.col("dst").alias("chunk_id"), F.col("src").alias("observation_id")), "chunk_id").select("graph", "entity_id", "observation_id").distinct()
    stated = evidence.select(F.col("src").alias("observation_id"), F.col("dst").alias("id")).join(facts.select("id", "object"), "id")
    stated = stated.groupBy("observation_id").agg(F.array_sort(F.collect_set("object")).alias("facts"))
    return behind.join(stated, "observation_id", "left").select("graph", "entity_id", "observation_id", F.coalesce("facts", F.array().cast("array<string>")).alias("facts"))


def count_evidence(facts: DataFrame, edges: DataFrame) -> DataFrame:
    """``(id, evidence)``: how many observations back each fact, 0 included."""
    counts = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("evidence"))
    return facts.select("id").join(counts, "id", "left").fillna(0, ["evidence"])


def stale_facts(facts: DataFrame, now_ms: int, days: int = 90) -> DataFrame:
    """Facts neither made nor verified in the last ``days`` days; a verification of null or 0 never happened."""
    verified = F.nullif("last_verified_at", F.lit(0))
    return facts.filter(F.coalesce(F.greatest("created_at", F.coalesce(verified, "created_at")), verified) < now_ms - days * 86_400_000)
