import pickle
import random
import time

from conftest import rows

from loomgraph.llm import toxicity

RNG = random.Random(4)
NOUNS = "cache router ledger queue shard index vector token".split()


def ordinary():
    a, b = RNG.sample(NOUNS, 2)
    return RNG.choice([f"The {a} reads {RNG.randint(1, 99)} rows from the {b}.", f"Call the {a} before you drop the {b}.", f"Kill the child process of the {a} before it dies.", f"You are wrong about the {a}, the patch is poor work."])


def insult(style=None):
    text = RNG.choice([f"You are a stupid moron and your {RNG.choice(NOUNS)} is garbage, you idiot!", "Shut your mouth, you useless idiot, nobody likes you!", "Go to hell, you pathetic stupid moron!", "Du bist ein dummer Idiot, halt die Fresse!"])
    return style(text) if style else text


def document(toxic, style=None):
    parts = [ordinary() for _ in range(6)]
    if toxic:
        parts.insert(RNG.randint(0, 6), insult(style))
    return "\n\n".join(parts)


def labelled(n=300, wrong=0.04):
    out = []
    for k in range(n):
        toxic = k % 5 == 0
        out.append((k, document(toxic), float(toxic != (RNG.random() < wrong))))
    return out


def test_held_out_documents():
    model = toxicity.fit(labelled())
    styles = [None, str.upper, lambda t: t.replace("stupid", "st​upid").replace("idiot", "1d10t"), lambda t: t.replace("moron", "m*ron").replace("idiot", "id**t"), lambda t: t.replace("stupid", "s t u p i d").replace("useless", "uuuuseless")]
    caught = [model.score(document(True, styles[k % 5])) > toxicity.THRESHOLD for k in range(150)]
    clean = [model.score(document(False)) > toxicity.THRESHOLD for k in range(150)]
    assert sum(caught) >= 0.93 * len(caught)
    assert sum(clean) <= 0.03 * len(clean)


def test_without_labels_the_seeds_decide():
    model = toxicity.fit([])
    assert model.score("Shut up, you stupid idiot, you worthless piece of shit!") > toxicity.THRESHOLD
    assert model.score("The master node aborts the slave replica.") <= toxicity.THRESHOLD


def test_rows(spark):
    data = labelled(500)
    docs = [(k, t, f"s{k % 2}", 0.0) for k, t, _ in data] + [(900, None, "s0", 0.0), (901, "", None, 0.0), (902, " ", "s1", 0.0), (903, "word " * 50_000, "s1", 0.0), (5, data[5][1], "s1", 0.0)]
    docs = spark.createDataFrame(docs, "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(k, int(label)) for k, _, label in data] + [(1, 1), (None, 1), (2, None)], "doc_id long, offensive int")
    scored = toxicity.score_documents(docs, labels)
    assert scored.count() == docs.count()
    assert {r.score for r in scored.filter("doc_id in (900, 901, 902)").collect()} == {toxicity.LOWEST}
    assert scored.filter("doc_id not in (900, 901, 902)").filter(f"score = {toxicity.LOWEST}").count() == 0
    found = {r.doc_id for r in toxicity.found(docs, labels).collect()}
    truth = {k for k in range(500) if k % 5 == 0}
    assert len(found & truth) >= 90 and len(found - truth) <= 10
    assert sum(r.documents for r in toxicity.rates(docs, labels).collect()) == docs.count()
    assert toxicity.found(docs.limit(0), labels).count() == 0
    assert toxicity.found(docs, labels.limit(0)).count() >= 0
    assert rows(toxicity.found(docs.limit(0), labels.limit(0))) == []


def test_offences_of_ordinary_words_are_scored():
    rng, texts = random.Random(3), []
    for k in range(400):
        a, b = rng.sample(NOUNS, 2)
        threat = f"We will find where you live and you will regret the {a}."
        texts.append((k, " ".join([ordinary(), threat if k % 4 == 0 else f"We will find where the {a} stores rows and you will see the {b}."]), float(k % 4 == 0)))
    model = toxicity.fit(texts)
    assert model.score("We will find where you live and you will regret the cache.") > toxicity.THRESHOLD
    assert model.score("We will find where the cache stores rows and you will see the index.") <= toxicity.THRESHOLD


def test_probabilities_of_a_context_add_up():
    counts = toxicity.Counts([["a", "b", "a"], ["b", "b", "c"], ["a", "b", "c"]])
    words = ["a", "b", "c", "</s>"]
    for context in (("<s>", "<s>"), ("a", "b"), ("b", "b"), ("c", "a")):
        assert abs(sum(counts.probability(*context, word, 1 / len(words)) for word in words) - 1) < 1e-9


def tricky(rng):
    pieces = ["You are a stupid moron", "s t u p i d", "m*ron", "**idiot**", "@bob", "@bob@bob", "$hit", "$a$b#1*c", "# ", "a_b_c", "1d10t", "uuuseless", "é", "Жук", "…", "​", "́", " ", "\x00", "\x01", "\x1c", ". ", "!\n", "\n\n", "\n- ", ": ", " ", " ", "*", "$", "the router reads rows from the queue"]
    return "".join(rng.choice(pieces) for _ in range(rng.randint(0, 40)))


def test_scores_of_many_texts_are_those_of_each():
    models, rng = toxicity.fit(labelled()), random.Random(6)
    texts = [None, "", " ", "#", "\x01", "word " * 1_000, "You are a stupid moron and " * 9, *(tricky(rng) for _ in range(3_000)), *(document(k % 2) for k in range(200))]
    for own in (toxicity.scorer_of(models), pickle.loads(pickle.dumps(toxicity.scorer_of(models)))):
        for _ in range(2):  # also from memory
            assert max(abs(a - models.score(b)) for a, b in zip(own.scores(texts), texts, strict=True)) < 1e-9
    assert len(toxicity.scorer_of(models).scores([])) == 0 and list(toxicity.scorer_of(models).scores([None])) == [toxicity.LOWEST]


def test_what_is_remembered_does_not_change_scores(monkeypatch):
    models, texts = toxicity.fit(labelled()), [tricky(random.Random(k)) for k in range(300)]
    expected = list(toxicity.scorer_of(models).scores(texts))
    for name, least in (("PLACE_BITS", 1), ("MET_TOKENS", 3), ("TEXTS_PER_BLOCK", 1), ("WORDS_PER_BLOCK", 1)):
        monkeypatch.setattr(toxicity, name, least)
    assert max(abs(a - b) for a, b in zip(toxicity.scorer_of(models).scores(texts), expected, strict=True)) < 1e-12
    monkeypatch.setattr(toxicity, "MOST_WORDS", 0)  # too many words to number their triples
    assert max(abs(a - b) for a, b in zip(toxicity.scorer_of(models).scores(texts), expected, strict=True)) < 1e-9


def test_many_texts_cost_less_than_each():
    models, texts = toxicity.fit(labelled()), [document(k % 5 == 0) for k in range(6_000)]
    own, took = toxicity.scorer_of(models), []
    for score in (lambda: own.scores(texts), lambda: [models.score(text) for text in texts]):
        began = time.process_time()
        score()
        took.append(time.process_time() - began)
    assert took[0] < 0.6 * took[1]
