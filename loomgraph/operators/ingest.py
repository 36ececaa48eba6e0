"""Markdown documents into the stored chunks of a graph: split, match, embed what changed, mark what is gone."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import anchor_id, content_hash, is_oversized
from loomgraph.operators import identity
from loomgraph.operators.chunker import split_sections
from loomgraph.operators.ordering import running_sum

#: Numbers of an embedding, and texts that are embedded together.
DIM, TEXTS_PER_REQUEST = 512, 32
CHUNKS = (
    "id long, source string, breadcrumb string, content string, line_start int, line_end int, anchor_id string, content_hash string, "
    "vector array<float>, oversized boolean, orphaned_at long, ambiguous_at long, last_distilled_at long"
)


def hash_embedder(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding service: the same text always gives the same vector, without meaning."""
    out = []
    for text in texts:
        v = np.zeros(DIM)
        for word in text.lower().split():
            digest = hashlib.blake2b(word.encode(), digest_size=8).digest()
            v[int.from_bytes(digest[:4], "little") % DIM] += 1 if digest[4] & 1 else -1
        out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
    return out


def in_request_order(answer: list) -> list:
    """The vectors of an embedder's answer; where they come as ``(index, vector)``, in order of index."""
    if answer and isinstance(answer[0], tuple):
        return [vector for _, vector in sorted(answer, key=lambda item: item[0])]
    return answer


def embed(rows: DataFrame, embedder=hash_embedder, dim: int = DIM) -> DataFrame:
    """``rows`` (``new_id, text``) as ``(new_id, vector)``; the embedder is called with a few texts at a time, and vectors cut to ``dim``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), TEXTS_PER_REQUEST):
                part = batch.iloc[start : start + TEXTS_PER_REQUEST]
                vectors = in_request_order(embedder(part["text"].tolist()))
                if len(vectors) != len(part):
                    raise ValueError(f"{len(part)} texts gave {len(vectors)} vectors")
                yield pd.DataFrame({"new_id": part["new_id"].to_numpy(), "vector": [[float(x) for x in v[:dim]] for v in vectors]})

    return rows.select("new_id", "text").mapInPandas(run, "new_id long, vector array<float>")


def new_chunks(docs: DataFrame) -> DataFrame:
    """``(new_id, source, breadcrumb, content, …)`` of documents ``(source, text)``: their sections, numbered by source and line."""
    sections = split_sections(docs, "source", "text")
    # a running number within a source, made unique over all by the source's hash only where sources are matched one by one
    nth = F.row_number().over(Window.partitionBy("source").orderBy("line_start"))
    return sections.withColumns({"new_id": nth.cast("long"), "anchor_id": anchor_id(F.col("source"), F.col("breadcrumb")), "content_hash": content_hash(F.col("content"))})


def reingest(stored: DataFrame, docs: DataFrame, now_ms: int, cut, embedder=hash_embedder) -> tuple[DataFrame, DataFrame]:
    """The chunks after documents ``(source, text)`` came in again, and ``(source, action, count)`` of what happened.

    Unchanged chunks are not touched, though their lines may have moved, and stay orphaned if they
    were.  Updated and renamed ones keep their id and when they were distilled and lose their marks;
    a chunk that grew oversized keeps its old vector.  Chunks of the documents' sources that nothing
    matched are orphaned.  A document that has no chunk now leaves the stored ones alone, as do
    documents that don't come.  New ids follow the highest stored one, in order of source and line.
    ``cut`` materialises what several steps read.
    """
    fresh = cut(new_chunks(docs))
    renamed = fresh.select("source", F.col("new_id").alias("id"), "anchor_id", "content_hash", "breadcrumb")
    matches = cut(identity.match(stored.select("source", "id", "anchor_id", "content_hash", "breadcrumb"), renamed))
    changed = fresh.join(matches.select("source", "new_id", "id", "action"), ["source", "new_id"]).filter("action != 'unchanged'")
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    # ids by ranges of sources: a count for each source, then its start
    counts = changed.filter("action = 'created'").groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    starts = running_sum(counts.withColumn("all", F.lit(0)), ["all"], ["source"], F.col("n"), "start").select("source", (F.col("start") - F.col("n")).alias("start"))
    made = changed.filter("action = 'created'").join(starts, "source").crossJoin(F.broadcast(top))
    nth = F.row_number().over(Window.partitionBy("source").orderBy("new_id"))
    numbered = made.withColumn("id", F.col("top") + F.col("start") + nth).drop("top", "start")
    written = cut(changed.filter("action != 'created'").unionByName(numbered).withColumn("over", is_oversized(F.col("content"))))
    vectors = embed(written.filter("not over").select(F.col("id").alias("new_id"), F.concat_ws("\n", "breadcrumb", "content").alias("text")), embedder).withColumnRenamed("new_id", "id")
    old = stored.select("id", F.col("vector").alias("old_vector"), "last_distilled_at")
    rows = written.join(vectors, "id", "left").join(old, "id", "left")
    rows = rows.select(
        "id", "source", "breadcrumb", "content", F.col("line_start").cast("int"), F.col("line_end").cast("int"), "anchor_id", "content_hash",
        F.coalesce("vector", "old_vector").alias("vector"), F.when(F.col("over"), True).alias("oversized"),
        F.lit(None).cast("long").alias("orphaned_at"), F.lit(None).cast("long").alias("ambiguous_at"), "last_distilled_at",
    )
    gone = identity.orphaned(stored, matches).select("id", F.lit(now_ms).alias("gone_at"))
    unsure = matches.select(F.explode("ambiguous").alias("id")).distinct().withColumn("unsure_at", F.lit(now_ms))
    kept = stored.join(written.select("id"), "id", "left_anti").join(gone, "id", "left").join(unsure, "id", "left")
    kept = kept.withColumns({"orphaned_at": F.coalesce("orphaned_at", "gone_at"), "ambiguous_at": F.coalesce("unsure_at", "ambiguous_at")}).drop("gone_at", "unsure_at")
    report = matches.groupBy("source", "action").agg(F.count(F.lit(1)).alias("count"))
    report = report.unionByName(identity.orphaned(stored, matches).groupBy("source").agg(F.count(F.lit(1)).alias("count")).withColumn("action", F.lit("orphaned")))
    return cut(kept.unionByName(rows)), report


def totals(report: DataFrame, chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of what a re-ingest did: chunks by action, ``stored`` ones, ``orphaned`` ones, and of its sources the ``oversized`` chunks and ``edges`` to code.

    ``report`` and ``chunks`` come from ``reingest``, ``edges`` (``chunk_id``) from the linker.  Of nothing all are 0.
    """
    actions = [F.coalesce(F.sum(F.when(F.col("action") == action, F.col("count"))), F.lit(0)).alias(action) for action in ("created", "updated", "renamed", "unchanged", "orphaned")]
    own = chunks.filter("orphaned_at is null").join(report.select("source").distinct(), "source", "left_semi")
    oversized = own.agg(F.count_if(F.coalesce("oversized", F.lit(False))).alias("oversized"))
    linked = edges.join(own.select(F.col("id").alias("chunk_id")), "chunk_id", "left_semi").agg(F.count(F.lit(1)).alias("edges"))
    counted = report.agg(*actions).withColumn("stored", F.col("created") + F.col("updated") + F.col("renamed"))
    return counted.crossJoin(oversized).crossJoin(linked)  # of one row each
