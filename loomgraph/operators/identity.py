"""Carrying chunk identities over a re-ingest: which stored row each new chunk is."""

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.text import anchor_id, content_hash
from loomgraph.plans.lineage import cut

#: Packs for each shuffle partition; a pack's groups of entangled chunks are decided in one call.
GROUPS_AT_ONCE = 4
MATCHES = "source string, new_id long, id long, action string, ambiguous array<long>"


def with_identity(chunks: DataFrame) -> DataFrame:
    """``chunks`` with ``anchor_id`` and ``content_hash`` computed where they are missing (null or empty)."""
    return chunks.withColumns(
        {
            "anchor_id": F.coalesce(F.nullif("anchor_id", F.lit("")), anchor_id(F.col("source"), F.col("breadcrumb"))),
            "content_hash": F.coalesce(F.nullif("content_hash", F.lit("")), content_hash(F.col("content"))),
        }
    )


def match_unchanged(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``(source, new_id, id)``: new chunks that are a stored row unchanged.

    Both sides have ``source, id, anchor_id, content_hash``; copies within a source are numbered by
    id and paired in that order.  Where every new chunk of a source is matched here, this is all
    that ``match`` would do, by an equi-join alone.
    """
    keys = ["source", "anchor_id", "content_hash"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    old = existing.select(*keys, "id").filter("anchor_id != ''").withColumn("nth", nth)
    fresh = new.select(*keys, F.col("id")).withColumn("nth", nth).withColumnRenamed("id", "new_id")
    return fresh.join(old, [*keys, "nth"]).select("source", "new_id", "id")


def match(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``(source, new_id, id, action, ambiguous)`` for every new chunk, decided in order of its id within its source.

    A stored row can be taken once.  A row of the same anchor is ``unchanged`` (preferred) or
    ``updated``; else a row of the same content under another anchor is ``renamed``, the one with
    the longest common trail of headings, then the lowest id, and the other candidates are
    ``ambiguous``; else the chunk is ``created`` and ``id`` is null.  Sources that ``match_unchanged``
    decides whole never reach Python.  Null sources are left out.  The others are decided in
    groups of chunks and rows that can get in each other's way, see ``entangled``, so that a large
    source is no single task.
    """
    columns = ["source", "id", "anchor_id", "content_hash", "breadcrumb"]
    fresh = new.select(*[F.col(c).alias(c) for c in columns]).filter("source is not null")
    existing = existing.select(*[F.col(c).alias(c) for c in columns])  # both sides can come from one table
    simple = match_unchanged(existing, fresh)
    counted = fresh.groupBy("source").count().join(simple.groupBy("source").agg(F.count(F.lit(1)).alias("matched")), "source", "left")
    whole = counted.filter("count = matched").select("source")
    fast = simple.join(whole, "source", "left_semi").select("source", "new_id", "id", F.lit("unchanged").alias("action"), F.array().cast("array<long>").alias("ambiguous"))
    rest = fresh.join(whole, "source", "left_anti")
    kept = existing.join(rest.select("source").distinct(), "source", "left_semi")
    groups = entangled(rest.select("source", *_place()).unionByName(kept.select("source", *_place())))
    grouped = ["source", "id", "anchor_id", "content_hash", "breadcrumb", "group", "pack"]
    packs = GROUPS_AT_ONCE * int(existing.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pack = F.pmod(F.xxhash64("source", "group"), F.lit(packs)).alias("pack")
    rest, kept = (side.toDF(*columns).withColumn("place", _place()[0]).join(groups, ["source", "place"]).select(*grouped[:-1], pack).toDF(*grouped) for side in (rest, kept))
    slow = rest.groupBy("pack").cogroup(kept.groupBy("pack")).applyInPandas(_decide, MATCHES)
    return fast.unionByName(slow)


def _place() -> list[Column]:
    """What a chunk can be matched by: its anchor (or its content alone, if it has none), and its content."""
    own = F.when(F.coalesce("anchor_id", F.lit("")) != "", F.col("anchor_id")).otherwise(F.concat(F.lit("="), F.coalesce("content_hash", F.lit(""))))
    same = F.when(F.coalesce("content_hash", F.lit("")) != "", F.col("content_hash")).otherwise(F.concat(F.lit("@"), own))
    return [own.alias("place"), same.alias("passage")]


def entangled(chunks: DataFrame) -> DataFrame:
    """``(source, place, group)``: places of a source that share contents, directly or through others, have one group.

    Only such chunks can take a row from each other.  Groups spread from place to place through
    equal contents, the lowest place naming the group, until nothing changes: as many rounds as the
    longest chain of moved contents, which is a few.
    """
    known = cut(chunks.distinct())
    labels = known.select("source", "place").distinct().withColumn("group", F.col("place"))
    while True:
        lowest = known.join(labels, ["source", "place"]).groupBy("source", "passage").agg(F.min("group").alias("group"))
        spread = known.join(lowest, ["source", "passage"]).groupBy("source", "place").agg(F.min("group").alias("spread"))
        step = cut(labels.join(spread, ["source", "place"]).withColumn("group", F.least("group", "spread")))
        changed = step.join(labels.withColumnRenamed("group", "before"), ["source", "place"]).filter("group != before")
        labels, done = step.select("source", "place", "group"), changed.isEmpty()
        if done:
            return labels


def _common(a: str | None, b: str | None) -> int:
    n = 0
    for x, y in zip((a or "").split(" > "), (b or "").split(" > ")):
        if x != y:
            break
        n += 1
    return n


class _Free:
    """Rows in order of id, of which those taken elsewhere are passed over once and for all."""

    def __init__(self):
        self.rows: list = []
        self.at = 0

    def first(self, taken: set[int]):
        while self.at < len(self.rows) and self.rows[self.at].id in taken:
            self.at += 1
        return self.rows[self.at] if self.at < len(self.rows) else None


def _decide(new: pd.DataFrame, existing: pd.DataFrame) -> pd.DataFrame:
    """The decisions of ``match`` for a pack of groups; chunks of different sources or groups share no key."""
    by_anchor, by_both, by_hash = defaultdict(_Free), defaultdict(_Free), defaultdict(_Free)
    for row in existing.sort_values("id").itertuples(index=False):
        if row.anchor_id:
            by_anchor[row.source, row.anchor_id].rows.append(row)
            by_both[row.source, row.anchor_id, row.content_hash].rows.append(row)
        if row.content_hash:
            by_hash[row.source, row.content_hash].rows.append(row)
    taken: set[int] = set()
    out = []
    for chunk in new.sort_values(["source", "id"]).itertuples(index=False):
        best, action, others = by_both[chunk.source, chunk.anchor_id, chunk.content_hash].first(taken), "unchanged", []
        if best is None:
            best, action = by_anchor[chunk.source, chunk.anchor_id].first(taken), "updated"
        if best is None and chunk.content_hash and by_hash[chunk.source, chunk.content_hash].first(taken):
            free = by_hash[chunk.source, chunk.content_hash]
            moved = [row for row in free.rows[free.at :] if row.id not in taken and row.anchor_id != chunk.anchor_id]
            if moved:
                best, action = min(moved, key=lambda row: (-_common(row.breadcrumb, chunk.breadcrumb), row.id)), "renamed"
                others = sorted(row.id for row in moved if row.id != best.id)
        if best is None:
            out.append((chunk.source, chunk.id, None, "created", []))
        else:
            taken.add(best.id)
            out.append((chunk.source, chunk.id, best.id, action, others))
    return pd.DataFrame(out, columns=["source", "new_id", "id", "action", "ambiguous"]).astype({"id": "Int64"})


def orphaned(existing: DataFrame, matches: DataFrame) -> DataFrame:
    """``(id, source)``: stored rows of re-ingested sources that no new chunk took and that are not orphaned already."""
    touched = matches.select("source").distinct()
    taken = matches.filter("id is not null").select("id")
    live = existing.filter(F.coalesce("orphaned_at", F.lit(0)) == 0)
    return live.join(touched, "source", "left_semi").join(taken, "id", "left_anti").select("id", "source")


def counters(matches: DataFrame) -> DataFrame:
    """``(source, created, updated, renamed, unchanged, stored)`` of a re-ingest."""
    counts = {action: F.count_if(F.col("action") == action).alias(action) for action in ("created", "updated", "renamed", "unchanged")}
    return matches.groupBy("source").agg(*counts.values()).withColumn("stored", F.col("created") + F.col("updated") + F.col("renamed"))
