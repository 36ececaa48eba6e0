import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from loomgraph.llm.tokenize import DEFAULT_VOCABULARY, Merges, encode_corpus, load_ranks, replay

TEXTS = ["", None, " ", "\n\n  x", "I'm don't 'S", "hello hello world 12345 67", "naïve 漢字 😀 \x00", "a" * 20_000, "  　 ", "<|endoftext|>", "snake_case camelCase `x`\r\n"]


@pytest.fixture(scope="module")
def reference():
    own = Tokenizer.from_file(DEFAULT_VOCABULARY.replace(".tiktoken", ".json"))
    own.encode_special_tokens = True
    return lambda text: own.encode(text, add_special_tokens=False).ids if text else []


def test_corpus(spark, reference):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)] + [(5, TEXTS[5], 1)], "doc_id long, text string, ids int")
    got = [(r.doc_id, r.ids) for r in encode_corpus(df).collect()]
    assert sorted(got) == sorted([(k, reference(t)) for k, t in enumerate(TEXTS)] + [(5, reference(TEXTS[5]))])
    assert encode_corpus(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def merges():
    with open(DEFAULT_VOCABULARY, "rb") as file:
        return Merges(load_ranks(file))


@settings(max_examples=150, deadline=None)
@given(words=st.lists(st.text(st.characters(categories=["L"]), min_size=1, max_size=30), min_size=1, max_size=5))
def test_replay_of_words(words, merges, reference):
    assert replay([w.encode() for w in words], merges) == [reference(w) for w in words]
