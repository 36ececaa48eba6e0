import random

from conftest import rows

from loomgraph.llm import leakage

RNG = random.Random(11)
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "so", "ti", "vu") for b in ("ran", "del", "mop", "stik", "gor", "plen", "tash")]
ITEMS = [(k, " ".join(RNG.choice(WORDS) + str(RNG.randint(10, 99)) if n % 3 == 0 else RNG.choice(WORDS) for n in range(50)), "suite") for k in range(1, 40)]


def item(k):
    return ITEMS[k - 1][1].split()


def noise(n):
    return [RNG.choice(WORDS) for _ in range(n)]


def test_leaks(spark):
    misspelt = [w[:3] + "x" + w[3:] if n % 12 == 5 else w for n, w in enumerate(item(3))]
    texts = {
        1: " ".join(noise(30) + item(1) + noise(30)),
        2: "> **" + " ".join(item(2)).upper().replace(" ", "**\n> ") + "**",
        3: " ".join(noise(5) + misspelt),
        4: " ".join(noise(20) + item(4)[10:36] + noise(20)),  # a half
        5: " ".join(noise(20) + item(5)[:12] + noise(20)),  # too short a quote
        6: " ".join(noise(200)),
        7: " ".join(item(7)) + " " + " ".join(item(8)),
    }
    docs = spark.createDataFrame([(k, t, 0) for k, t in texts.items()] + [(1, texts[1], 0), (9, None, 0), (10, "", 0), (11, "word " * 40_000, 0)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame(ITEMS + [(90, None, "s"), (91, "", "s")], "item_id long, text string, suite string")
    assert rows(leakage.found(docs, items)) == [(1, 1), (2, 2), (3, 3), (4, 4), (7, 7), (7, 8)]
    span = leakage.leaks(docs, items).filter("doc_id = 4").collect()[0]
    assert texts[4][span.char_start : span.char_end].split() == item(4)[10:36]
    assert rows(leakage.leak_report(docs, items), "item_id", "documents") == [(k, 1) for k in (1, 2, 3, 4, 7, 8)]
    assert leakage.found(docs.limit(0), items).count() == 0
    assert leakage.found(docs, items.limit(0)).count() == 0


def test_copies_and_short_items(spark):
    copies = [(1000 * n + k, ITEMS[n][1] if k % 2 else ITEMS[n][1].upper(), "copies") for n, many in ((1, 4), (2, 400)) for k in range(many)]
    near = [(90_000 + k, " ".join(w if n != k else "other" for n, w in enumerate(item(9))), "near") for k in range(8)]  # hardly a window of their own
    short = [(80_000, "which port does the relay of the harbour use", "short"), (80_001, "kaplen mopzz", "short"), (80_002, "the relay", "short")]
    items = spark.createDataFrame(copies + near + short, "item_id long, text string, suite string")
    texts = {1: noise(9) + item(2) + noise(9), 2: noise(4) + item(3) + noise(9), 3: noise(5) + item(9) + noise(5), 4: noise(4) + "Which port does the RELAY, of the harbour: use?".split() + noise(4), 5: noise(9) + "which port does the harbour use".split(), 6: ["x", "kaplen", "mopzz"], 7: noise(40)}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    want = [(1, i) for i, _, _ in copies if i < 2000] + [(2, i) for i, _, _ in copies if i >= 2000] + [(3, i) for i, _, _ in near] + [(4, 80_000), (4, 80_002), (6, 80_001)]
    assert set(rows(leakage.found(docs, items))) == set(want)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leakage, "ITEMS_PER_BLOCK", 10)
    docs = spark.createDataFrame([(k, " ".join(noise(9) + item(k) + noise(9))) for k in (1, 15, 39)], "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string, suite string")
    assert rows(leakage.found(docs, items)) == [(1, 1), (15, 15), (39, 39)]


def test_results_do_not_depend_on_blocks(spark, monkeypatch):
    near = [(k, " ".join(w if n != k else "other" for n, w in enumerate(item(9))), "near") for k in range(8)]
    items = spark.createDataFrame(near, "item_id long, text string, suite string")
    docs = spark.createDataFrame([(1, " ".join(noise(5) + item(9)[5:30] + noise(5))), (2, " ".join(noise(5) + item(9)[5:14] + noise(5) + item(9)[20:30]))], "doc_id long, text string")
    whole = rows(leakage.leaks(docs, items))
    monkeypatch.setattr(leakage, "ITEMS_PER_BLOCK", 2)
    assert rows(leakage.leaks(docs, items)) == whole and 1 in {r[0] for r in whole}


def test_offsets_lead_to_the_original():
    text = "Ünï «Foo_bar»​Baz ＡＢＣ, x"
    for word, start, end in leakage.placed_words(text):
        assert word in leakage.plain(text[start:end])
    assert [w for w, _, _ in leakage.placed_words(text)] == leakage.normal_words(text)
