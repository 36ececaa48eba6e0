"""Chunks to the code entities that they name."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.text import link_tokens


def chunk_tokens(chunks: DataFrame, strict: bool = False) -> DataFrame:
    """``(graph, chunk_id, token)``: the distinct tokens of each live chunk (``graph``, ``id``, ``content``, ``orphaned_at``)."""
    live = chunks.filter(F.coalesce("orphaned_at", F.lit(0)) == 0)
    return live.select("graph", F.col("id").alias("chunk_id"), F.explode(link_tokens(F.col("content"), strict)).alias("token"))


def link(chunks: DataFrame, entities: DataFrame, strict: bool = False) -> DataFrame:
    """``(graph, chunk_id, entity_id)``: DOCUMENTS edges from each chunk to every entity of its graph that it names, once each.

    Names match by case; entities of one name are all linked.  An equi-join on graph and name, in
    which tokens that name nothing fall out early; null names and contents link nothing.
    """
    named = entities.filter("name is not null").select("graph", F.col("id").alias("entity_id"), F.col("name").alias("token")).dropDuplicates()
    return chunk_tokens(chunks, strict).join(named, ["graph", "token"]).select("graph", "chunk_id", "entity_id").dropDuplicates()
