"""Writing to a graph's tables, looking rows up, and searching them.

Every function takes tables and returns the changed ones; nothing is written in place.  Ends of
edges that don't exist, and lookups of rows that don't, raise an error that names them.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import hit_text
from loomgraph.operators import knn, memory
from loomgraph.operators.ordering import running_sum

#: Missing ids that an error names.
NAMED_IDS = 20


def required(**texts: str) -> None:
    """Raises ``ValueError`` if any of the given texts is null, empty or blank."""
    empty = [name for name, text in texts.items() if not (text or "").strip()]
    if empty:
        raise ValueError(f"{', '.join(empty)} must not be empty")


def get(rows: DataFrame, id_: int, what: str = "row"):
    """The row with this id; ``LookupError`` if there is none."""
    found = rows.filter(F.col("id") == id_).take(1)
    if not found:
        raise LookupError(f"{what} {id_} not found")
    return found[0]


def find_fact(facts: DataFrame, subject: str, predicate: str, object_: str) -> DataFrame:
    """The one fact of a triplet (the lowest id), or no row."""
    same = (F.col("subject") == subject) & (F.col("predicate") == predicate) & (F.col("object") == object_)
    return facts.filter(same).orderBy("id").limit(1)


def _check(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> None:
    missing = [f"{row.side} {row.id}" for row in memory.missing_endpoints(edges, sources, targets).orderBy("side", "id").limit(NAMED_IDS).collect()]
    if missing:
        raise ValueError(f"no such ends of edges: {', '.join(missing)}")


def link_evidence(edges: DataFrame, new: DataFrame, observations: DataFrame, facts: DataFrame) -> DataFrame:
    """``edges`` (``src, dst``) with those of ``new`` from observations to facts, each once; ``ValueError`` if an end doesn't exist."""
    _check(new, observations, facts)
    return edges.select("src", "dst").unionByName(new.select("src", "dst")).distinct()


def link_motivates(edges: DataFrame, new: DataFrame, observations: DataFrame, chunks: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """The edges with ``new`` from observations to chunks, each once, and the chunks.

    A chunk linked for the first time is distilled now; an earlier ``last_distilled_at`` (not null
    or 0) stays.  ``ValueError`` if an end doesn't exist.
    """
    _check(new, observations, chunks)
    linked = new.select(F.col("dst").alias("id")).distinct().withColumn("_linked", F.lit(True))
    earlier = F.nullif("last_distilled_at", F.lit(0))
    marked = chunks.join(linked, "id", "left").withColumn("last_distilled_at", F.when(F.col("_linked"), F.coalesce(earlier, F.lit(now_ms))).otherwise(F.col("last_distilled_at"))).drop("_linked")
    return edges.select("src", "dst").unionByName(new.select("src", "dst")).distinct(), marked


def motivating(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(chunk_id, observation_id)``: the observations that motivate each of ``chunks``."""
    return edges.join(chunks.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(F.col("dst").alias("chunk_id"), F.col("src").alias("observation_id"))


def _hits(rows: DataFrame, vectors: DataFrame, query: list[float], k: int, columns: list[str], score: str) -> DataFrame:
    near = knn.nearest(vectors.join(rows.select(F.col("id").alias("vec_id")), "vec_id", "left_semi"), query, k)
    return near.withColumnsRenamed({"vec_id": "id", "distance": score}).join(rows.select("id", *columns), "id")


def search_chunks(chunks: DataFrame, vectors: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """The ``k`` chunks whose vectors (``vec_id``, ``embedding``) are nearest to ``query``, as hits: place, content, lines and ``score``.

    Only the hits' rows are read for their content.  Chunks without a vector are never found.
    """
    return _hits(chunks, vectors, query, k, ["breadcrumb", "content", "source", "line_start", "line_end"], "score")


def hit_texts(hits: DataFrame) -> DataFrame:
    """``(rank, text)`` of what ``search_chunks`` found, each hit as markdown, best first; the few hits are one group."""
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("score", "id")))
    return ranked.select("rank", hit_text(*(F.col(c) for c in ("rank", "score", "source", "line_start", "line_end", "breadcrumb", "content"))).alias("text"))


def search_observations(observations: DataFrame, vectors: DataFrame, query: list[float], k: int = 5) -> DataFrame:
    """``(id, distance, content)`` of the ``k`` observations nearest to ``query``."""
    return _hits(observations, vectors, query, k, ["content"], "distance")


def add_observation(observations: DataFrame, vectors: DataFrame, facts: DataFrame, edges: DataFrame, content: str, vector: list[float], now_ms: int, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The observations and vectors with a new one, and the facts that its ``k`` nearest older ones back, once each.

    The id follows the highest one.  The neighbours are looked for before the insert, so the new
    observation is none of its own.  ``ValueError`` for a blank content; ``k`` below 1 counts as 5.
    """
    required(content=content)
    spark = observations.sparkSession
    near = search_observations(observations, vectors, vector, k if k > 0 else 5)
    similar = memory.facts_backed_by(facts, edges, near)
    top = observations.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id"))
    new = top.select((F.col("id") + 1).alias("id"), F.lit(content.strip()).alias("content"), F.lit(now_ms).cast("long").alias("created_at"))
    entry = new.select(F.col("id").alias("vec_id"), F.array(*[F.lit(float(x)) for x in vector]).cast(vectors.schema["embedding"].dataType).alias("embedding"))
    return observations.select("id", "content", "created_at").unionByName(new), vectors.select("vec_id", "embedding").unionByName(entry.select(F.col("vec_id").cast(vectors.schema["vec_id"].dataType), "embedding")), similar


def delete_source(chunks: DataFrame, edges: DataFrame, source: str) -> tuple[DataFrame, DataFrame]:
    """The chunks without those of ``source``, and the edges (``src, dst``) without those to or from them."""
    gone = chunks.filter(F.col("source") == source).select("id")
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return chunks.filter(~F.col("source").eqNullSafe(source)), kept


def delete_graph(rows: DataFrame, graph: str) -> DataFrame:
    """``rows`` without those of ``graph``."""
    return rows.filter(~F.col("graph").eqNullSafe(graph))


def of_file(chunks: DataFrame, files: DataFrame, oversized) -> DataFrame:
    """``(graph, chunk_id, file_id, oversized)``: an OF_FILE edge from each chunk to the stored file of its source.

    A file scanned several times is its lowest id.  ``oversized`` tells from the content column
    whether a chunk is too long for a vector.
    """
    stored = files.groupBy("graph", F.col("path").alias("source")).agg(F.min("id").alias("file_id"))
    return chunks.select("graph", "source", F.col("id").alias("chunk_id"), oversized(F.coalesce("content", F.lit(""))).alias("oversized")).join(stored, ["graph", "source"]).select("graph", "chunk_id", "file_id", "oversized")


def ensure_meta(meta: DataFrame, graph: str, kind: str, strict: bool) -> DataFrame:
    """``(graph, kind, strict)`` of all graphs, with ``graph`` added or its strictness changed; ``ValueError`` if it has another kind already."""
    required(graph=graph, kind=kind)
    known = read_meta(meta, graph)
    if known and known.kind not in (None, kind):
        raise ValueError(f"graph {graph} is of kind {known.kind} already, not {kind}")
    row = meta.sparkSession.createDataFrame([(graph, kind, strict)], "graph string, kind string, strict boolean")
    return delete_graph(meta, graph).unionByName(row)


def read_meta(meta: DataFrame, graph: str):
    """The row of ``graph``, or ``None``."""
    found = meta.filter(F.col("graph") == graph).take(1)
    return found[0] if found else None


def in_time_order(evidence: DataFrame) -> DataFrame:
    """``evidence_for`` facts (``fact_id, observation_id, created_at``) with ``place``: oldest first within a fact, ties by id.

    A fact's evidence can spread over many tasks; an observation counts once for a fact.
    """
    order = ["created_at", "observation_id"]
    return running_sum(evidence.distinct(), ["fact_id"], order, F.lit(1), "place").withColumn("place", F.col("place").cast("long"))
