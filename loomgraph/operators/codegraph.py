"""The code graph: entities, their edges, and what stands at a position."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.ordering import running_sum

#: The labels of code entities that a document can be linked to.
LABELS = ("Class", "Function", "Method", "Interface", "Enum", "Constructor")
_KEY = ["graph", "label", "name", "path", "parent_name"]


def merge_entities(rows: DataFrame) -> DataFrame:
    """One entity for each (graph, label, name, path, parent): it keeps its lowest id and takes the rest from the last row by id.

    A null parent is an empty one.
    """
    rows = rows.withColumn("parent_name", F.coalesce("parent_name", F.lit("")))
    last = F.struct("id", "src_start", "src_end", "doc")
    merged = rows.groupBy(*_KEY).agg(F.min("id").alias("id"), F.max_by(last, "id").alias("last"))
    return merged.select(*_KEY, "id", "last.src_start", "last.src_end", "last.doc")


def code_entities(rows: DataFrame) -> DataFrame:
    """``(graph, id, name)`` of the code entities, once each; rows of other labels, or of none, are no code."""
    return rows.filter(F.col("label").isin(*LABELS)).select("graph", "id", "name").distinct()


def merge_edges(edges: DataFrame) -> DataFrame:
    """``(type, src, dst, pos)``: each edge once, with the position written last (the highest)."""
    return edges.groupBy("type", "src", "dst").agg(F.max("pos").alias("pos"))


def connect(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges of which both ends exist, each once; the others are dropped silently."""
    ids = nodes.select("id").distinct()
    there = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return merge_edges(there)


def at_position(entities: DataFrame, references: DataFrame) -> DataFrame:
    """``(ref_id, entity_id)``: the innermost entity that covers each reference (``ref_id, graph, path, line``), -1 where none does.

    An equi-join on the file with the lines as a further condition; of entities of equal extent
    the lowest id counts.  References without a file or line get -1.
    """
    spans = entities.select("graph", "path", F.col("id").alias("entity_id"), "src_start", "src_end").filter("src_start is not null and src_end is not null")
    covered = references.join(spans, ["graph", "path"]).filter("src_start <= line and src_end >= line")
    innermost = covered.groupBy("ref_id").agg(F.min(F.struct((F.col("src_end") - F.col("src_start")).alias("extent"), "entity_id")).alias("best"))
    return references.select("ref_id").distinct().join(innermost, "ref_id", "left").select("ref_id", F.coalesce("best.entity_id", F.lit(-1)).alias("entity_id"))


def defines(entities: DataFrame) -> DataFrame:
    """``(graph, parent_id, child_id)``: DEFINES edges from each class or interface to the entities in it.

    The parent is the entity of the child's file that has the name of its parent and the narrowest
    extent around it, then the lowest id.
    """
    parents = entities.select("graph", "path", F.col("name").alias("parent_name"), F.col("id").alias("parent_id"), F.col("src_start").alias("p_start"), F.col("src_end").alias("p_end")).filter(F.col("label").isin("Class", "Interface"))
    children = entities.filter("parent_name is not null and parent_name != ''").select("graph", "path", "parent_name", F.col("id").alias("child_id"), "src_start", "src_end")
    around = children.join(parents, ["graph", "path", "parent_name"]).filter("p_start <= src_start and p_end >= src_end")
    best = around.groupBy("graph", "child_id").agg(F.min(F.struct((F.col("p_end") - F.col("p_start")).alias("extent"), "parent_id")).alias("best"))
    return best.select("graph", F.col("best.parent_id").alias("parent_id"), "child_id")


def reach(edges: DataFrame, starts: DataFrame, hops: int, cut) -> DataFrame:
    """``(start, node, hops)``: the nodes within ``hops`` edges (``src, dst``) of each start, with the fewest hops.

    ``cut`` materialises each step, so that no step runs the ones before it again.
    """
    seen = cut(starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("hops")).distinct())
    frontier = seen
    for hop in range(1, hops + 1):
        step = frontier.join(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")), "node").select("start", F.col("next").alias("node")).distinct()
        frontier = cut(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        seen = cut(seen.unionByName(frontier))
    return seen.filter("hops > 0")


def in_reading_order(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``position``, their place in their file by line, then id (unique); a file can spread over many tasks."""
    return running_sum(chunks, ["graph", "source"], ["line_start", "id"], F.lit(1), "position").withColumn("position", F.col("position").cast("long"))
