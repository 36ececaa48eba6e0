import random

from conftest import rows

from loomgraph.operators import identity

SCHEMA = "source string, id long, anchor_id string, content_hash string, breadcrumb string, orphaned_at long"


def greedy(existing, new):
    taken, out = set(), {}
    for source, n, a, h, b, _ in sorted(new, key=lambda r: r[1]):
        mine = [r for r in existing if r[0] == source and r[1] not in taken]
        same = [r for r in mine if r[2] and r[2] == a]
        if same:
            best = min(same, key=lambda r: (r[3] != h, r[1]))
            action = "unchanged" if best[3] == h else "updated"
        else:
            same = [r for r in mine if r[3] and r[3] == h and r[2] != a]
            if not same:
                out[n] = (None, "created")
                continue
            best, action = min(same, key=lambda r: (-identity._common(r[4], b), r[1])), "renamed"
        taken.add(best[1])
        out[n] = (best[1], action)
    return out


def test_random_matches_equal_the_model(spark):
    rng = random.Random(7)
    existing, new = [], []
    for s in range(60):
        make = lambda k: (f"s{s}", k, rng.choice("ABC"), rng.choice("xyz"), rng.choice(["a > b", "a > c", "d"]), 0)
        old = [make(s * 100 + k) for k in range(rng.randint(0, 6))]
        existing += old
        if rng.random() < 0.4:  # re-ingested unchanged
            new += [(r[0], r[1] + 50, *r[2:]) for r in old]
        else:
            new += [make(s * 100 + 50 + k) for k in range(rng.randint(0, 6))]
    got = identity.match(spark.createDataFrame(existing, SCHEMA), spark.createDataFrame(new, SCHEMA))
    assert {r.new_id: (r.id, r.action) for r in got.collect()} == greedy(existing, new)


def test_named_cases(spark):
    existing = spark.createDataFrame([("f", 1, "A", "old", "x", 0), ("f", 2, "A", "H", "x", 0), ("g", 3, "A", "H", "x", 0), ("g", 4, "Z", "Q", "x", 9), ("h", 5, "K", "K", "x", 0)], SCHEMA)
    new = spark.createDataFrame([("f", 10, "A", "H", "x", 0), ("g", 11, "B", "H", "y", 0), ("g", 12, "A", "H", "x", 0), (None, 13, "A", "H", "x", 0)], SCHEMA)
    matches = identity.match(existing, new)
    assert rows(matches, "new_id", "id", "action") == [(10, 2, "unchanged"), (11, 3, "renamed"), (12, None, "created")]
    # the row that nothing took is orphaned; one orphaned before and other sources are left alone
    assert rows(identity.orphaned(existing, matches)) == [(1, "f")]
    assert rows(identity.counters(matches), "source", "created", "renamed", "unchanged", "stored") == [("f", 0, 0, 1, 0), ("g", 1, 1, 0, 2)]


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert identity.match(empty, empty).count() == 0


def test_backfill_keeps_what_is_there(spark):
    df = spark.createDataFrame([("s", None, "c", None, None), ("s", "b", None, "", "h")], "source string, breadcrumb string, content string, anchor_id string, content_hash string")
    got = identity.with_identity(df).collect()
    assert all(len(r.anchor_id) == 64 for r in got) and got[1].content_hash == "h"
