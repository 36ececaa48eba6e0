"""Nearest neighbours by cosine distance."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import cosine_distance

#: Rows of a block of queries, and of a block of stored vectors.
BLOCK = 2048


def nearest(vectors: DataFrame, query: list[float], k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", dim: int | None = None) -> DataFrame:
    """``(id, distance)`` of the ``k`` rows nearest to ``query``, ties by id; rows without a vector are never found.

    ``dim`` compares only the first so many numbers, as nested embeddings allow.  A ``k`` below 1
    counts as 5.
    """
    k = k if k > 0 else 5
    query = [float(x) for x in (query[:dim] if dim else query)]
    vector = F.slice(vector_col, 1, dim) if dim else F.col(vector_col)
    distance = cosine_distance(vector, F.array(*[F.lit(x) for x in query]))
    scored = vectors.filter(F.col(vector_col).isNotNull()).select(F.col(id_col), distance.alias("distance"))
    return scored.orderBy("distance", id_col).limit(k)


def nearest_of_each(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``(query_id, id, distance, rank)``: for each query row its ``k`` nearest rows other than itself, exactly.

    Both sides are dealt to blocks of about ``BLOCK`` rows by the hash of their ids; each block of queries
    is sent to each block of vectors, meets it in one matrix product, and only the ``k`` best of a
    block go on to the final choice.  Null vectors take no part; a row repeated under one id counts once.
    """

    def blocks(df: DataFrame, side: str) -> tuple[DataFrame, int]:
        own = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).filter("id is not null and v is not null").dropDuplicates(["id"])
        n = max(1, -(-df.count() // BLOCK))
        return own.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias(f"{side}_block")).agg(F.collect_list(F.struct("id", "v")).alias(side)), n

    (q, _), (r, n) = blocks(queries, "q"), blocks(vectors, "r")
    sent = q.withColumn("r_block", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("r_block", F.col("r_block").cast("long"))
    pairs = r.join(sent.hint("shuffle_hash"), "r_block")

    def product(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for q, r in zip(batch["q"], batch["r"]):
                q_ids, r_ids = (np.array([x["id"] for x in side]) for side in (q, r))
                a, b = (np.array([x["v"] for x in side], np.float64) for side in (q, r))
                a /= np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)
                b /= np.maximum(np.linalg.norm(b, axis=1, keepdims=True), 1e-300)
                distance = 1 - a @ b.T
                distance[q_ids[:, None] == r_ids[None, :]] = np.inf
                n = min(k, len(r_ids))
                # by distance, then id: sort the columns by id first, then stably by rounded distance
                order = np.argsort(r_ids)
                distance, r_ids = distance[:, order], r_ids[order]
                best = np.argsort(np.round(distance, 12), axis=1, kind="stable")[:, :n]
                rows = np.arange(len(q_ids))[:, None]
                out = pd.DataFrame({"query_id": np.repeat(q_ids, n), "id": r_ids[best].ravel(), "distance": distance[rows, best].ravel()})
                yield out[np.isfinite(out["distance"])]

    found = pairs.select("q", "r").mapInPandas(product, "query_id long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("distance", 12), "id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
