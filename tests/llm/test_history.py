import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import rows

from loomgraph.llm import history
from loomgraph.llm.leakage import normal_words

SCHEMA = "id long, batch_no int, content string, short long"


def passage(rng, n=60):
    return [f"w{rng.randint(0, 5000)}" for _ in range(n)]


def changed(rng, words, share=0.08):
    return [f"z{rng.randint(0, 9999)}" if rng.random() < share else w for w in words]


def make(seed, accepted=60, per_batch=25, batches=4):
    rng = random.Random(seed)
    texts, out, n = [], [], 0
    for batch in range(batches + 1):
        for _ in range(accepted if batch == 0 else per_batch):
            n += 1
            kind = rng.random()
            if batch and kind < 0.2:
                words = rng.choice(texts)
                text = "**" + " ".join(words).upper() + "**!"
            elif batch and kind < 0.4:
                text = " ".join(changed(rng, rng.choice(texts)))
            elif batch and kind < 0.55:  # shares some sentences only
                text = " ".join(rng.choice(texts)[:24] + passage(rng, 40))
            else:
                words = passage(rng)
                texts.append(words)
                text = " ".join(words)
            out.append((n, batch, text, 0))
    return out


def codes(text):
    return np.array([xxhash.xxh32_intdigest(w) for w in normal_words(text)], np.uint32)


def likeness(a, b):
    x, y = normal_words(a), normal_words(b)
    if min(len(x), len(y)) > 1:
        x, y = list(zip(x, x[1:])), list(zip(y, y[1:]))
    total = len(x) + len(y)
    return 2 * sum((Counter(x) & Counter(y)).values()) / total if total else 0.0


def brute(data):
    accepted, cases = [], []
    for n, batch, text, _ in data:
        like = [k for k, other in accepted if likeness(other, text) >= history.LEAST_LIKE] if batch else []
        if like:
            cases.append((min(like), n))
        else:
            accepted.append((n, text))
    return sorted(cases)


def test_equals_brute_force(spark):
    data = make(1, batches=3)
    want = brute(data)
    assert len(want) > 20
    assert rows(history.found(spark.createDataFrame(data, SCHEMA))) == sorted(map(tuple, want), key=str)


def test_a_passage_that_fills_a_third(spark):
    rng = random.Random(5)
    hot = passage(rng)
    data = [(k, 0, " ".join(hot if k % 3 == 0 else passage(rng)), 0) for k in range(1, 150)]
    data += [(200 + k, 1, " ".join(changed(rng, hot, 0.04) if k % 3 == 0 else passage(rng)), 0) for k in range(80)]
    got = dict((c, k) for k, c in rows(history.found(spark.createDataFrame(data, SCHEMA))))
    assert got == {200 + k: 3 for k in range(0, 80, 3)}


def test_edges(spark):
    data = [(1, 0, "alpha beta", 0), (2, 1, "Alpha, beta!", 0), (3, 1, None, 0), (4, 1, "", 0), (5, None, "alpha beta", 0), (None, 1, "alpha beta", 0), (6, 2, "alpha gamma", 0), (7, 2, "x" * 50_000, 0), (8, 3, "x" * 50_000, 0)]
    assert rows(history.found(spark.createDataFrame(data, SCHEMA))) == [(1, 2), (7, 8)]
    assert history.found(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_chunk_that_repeats_only_a_case_is_no_case_of_it(spark):
    rng = random.Random(9)
    a = passage(rng, 100)
    b = a[:88] + passage(rng, 12)
    c = passage(rng, 16) + a[16:82] + b[82:]
    data = [(1, 0, " ".join(a), 0), (2, 1, " ".join(b), 0), (3, 1, " ".join(c), 0)]
    assert rows(history.found(spark.createDataFrame(data, SCHEMA))) == sorted(brute(data), key=str)


def test_a_repeat_whose_unchanged_places_are_all_common(spark):
    rng = random.Random(11)
    template, own = passage(rng), [passage(rng, 30) for _ in range(30)]

    def each(words, n):
        return [f"z{rng.randint(0, 9999)}" if k % n == 0 else w for k, w in enumerate(words)]

    data = [(k + 1, 0, " ".join(template + words), 0) for k, words in enumerate(own)]
    data += [(101 + k, 1 + k % 2, " ".join(template + each(own[k], 5)), 0) for k in range(9, 30)]
    data += [(201 + k, 3, " ".join(each(template, 11) + each(own[k], 5)), 0) for k in range(9, 30)]
    want = brute(data)
    assert len(want) == 42
    got = rows(history.found(spark.createDataFrame(data, SCHEMA)))
    assert not set(got) - set(want)
    assert {c for c in want if c[1] < 200} <= set(got)
    assert len(got) >= 36  # the last batch has no eleven words in a row of its originals


def sentences(n, count, seed):
    rng = random.Random(seed)
    common = [" ".join(passage(rng, 12)) for _ in range(count)]
    return [". ".join(rng.choice(common) for _ in range(6)) for _ in range(n)]


def lowest_alike(history_texts, text):
    return next(k for k, other in enumerate(history_texts, 1) if likeness(other, text) >= history.LEAST_LIKE)


@pytest.mark.parametrize("at_once", [0, 1_000_000])
def test_histories_of_common_sentences(spark, monkeypatch, at_once):
    monkeypatch.setattr(history, "REST_AT_ONCE", at_once)
    for n, count, seed in ((400, 12, 3), (3_000, 24, 4)):
        texts = sentences(n, count, seed)
        rng = random.Random(seed)
        repeated = [rng.choice(texts) for _ in range(40)]
        data = [(k, 0, t, 0) for k, t in enumerate(texts, 1)] + [(100_000 + k, 1, t, 0) for k, t in enumerate(repeated)]
        got = dict((c, k) for k, c in rows(history.found(spark.createDataFrame(data, SCHEMA))))
        assert got == {100_000 + k: lowest_alike(texts, t) for k, t in enumerate(repeated)}


def test_recall_against_brute_force_on_common_passages(spark):
    rng = random.Random(8)
    texts = [t.split() for t in sentences(300, 40, 5)]
    data = [(k, 0, " ".join(words + passage(rng, 30)), 0) for k, words in enumerate(texts, 1)]
    data += [(1000 + k, 1, " ".join(changed(rng, data[rng.randrange(300)][2].split(), 0.1)), 0) for k in range(200)]
    want, got = set(brute(data)), set(rows(history.found(spark.createDataFrame(data, SCHEMA))))
    assert len(want) > 100 and len(got & want) >= 0.98 * len(want) and not got - want


def test_short_texts(spark):
    rng = random.Random(6)
    data = [(k, 0, " ".join(passage(rng, 6 + k % 20)), 0) for k in range(1, 120)]
    data += [(200 + k, 1, " ".join(words[:-1] + ["other"]), 0) for k in range(100) for words in [data[k][2].split()]]
    assert sorted(rows(history.found(spark.createDataFrame(data, SCHEMA)))) == sorted(brute(data))


def test_sampled_suffixes_meet_in_every_common_run():
    rng = random.Random(1)
    for _ in range(50):
        run = passage(rng, history.SUFFIX_WORDS + history.WINDOW - 1)
        a, b = (codes(" ".join(passage(rng, rng.randint(0, 40)) + run + passage(rng, rng.randint(0, 40)))) for _ in range(2))
        keys, owner, _ = history.suffixes([a, b])
        assert set(keys[owner == 0]) & set(keys[owner == 1])


def test_many_segments_and_split_common_keys(spark, monkeypatch):
    monkeypatch.setattr(history, "HOT", 4)
    data = make(21, accepted=40, per_batch=20, batches=8)
    rng = random.Random(2)
    hot = passage(rng)
    data += [(n, 9 + (n - 1000) // 40, " ".join(changed(rng, hot, 0.03)), 0) for n in range(1000, 1120)]
    assert sorted(rows(history.found(spark.createDataFrame(data, SCHEMA)))) == sorted(brute(data))
    left = [d.name for d in spark.catalog.listDatabases() if d.name.startswith("history_")]
    assert not left


def test_likeness():
    rng = random.Random(2)
    some = ["", "a", "a a", "a a a b", "a a b"] + [" ".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(60)]
    assert all(abs(history.likeness(codes(a), codes(b)) - likeness(a, b)) < 1e-12 for a in some for b in some)


def test_word_codes_are_those_of_the_words():
    rng = random.Random(4)
    alphabet = "aAbZ09 _-.\n\té́ßſΣςİıﬁK 　​­\x1f\x85中аͅΐ"
    texts = ["", " ", "x" * 50_000 + " é", *("q" * n for n in range(1, 40)), *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(2_000))]
    assert history.word_codes(texts) == [codes(text).astype("<u4").tobytes() for text in texts]
    assert history.word_codes([]) == []


@pytest.mark.parametrize("block", [1, 50, 500_000])
def test_likenesses_of_many_pairs(monkeypatch, block):
    monkeypatch.setattr(history, "PAIR_BLOCK", block)
    rng = random.Random(3)
    texts = ["", "a", "a a", "a a a b"] + [" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 40))) for _ in range(40)]
    xs, ys = [a for a in texts for _ in texts], [b for _ in texts for b in texts]
    got = history.likenesses(history.word_codes(xs), history.word_codes(ys))
    assert np.abs(got - [likeness(a, b) for a, b in zip(xs, ys)]).max() < 1e-12
    assert not len(history.likenesses([], []))


def test_the_rest_of_common_suffixes_stands_apart():
    rng = np.random.default_rng(1)
    parts = []
    for n in (0, 3, 200, 500):
        keys, ids = rng.integers(0, 40, n).astype("<u8"), rng.permutation(n).astype("<i8")
        parts.append(history._Entries(keys.tobytes(), ids.tobytes(), np.zeros(n, "<u2").tobytes()))
    entries = sorted((k, i) for p in parts for k, i in zip(np.frombuffer(p.keys, "<u8").tolist(), np.frombuffer(p.ids, "<i8").tolist()))
    for hot in (1, 4, 64, 1_000):
        block = dict(zip(history._names(history._BLOCK), history._join_blocks(7, parts, hot)))
        want = [e for k, e in enumerate(entries) if k >= hot and entries[k - hot][0] == e[0]]
        assert list(zip(np.frombuffer(block["rest_keys"], "<u8").tolist(), np.frombuffer(block["rest_ids"], "<i8").tolist())) == want
        assert block["size"] == len(entries)
