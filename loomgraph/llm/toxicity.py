"""Scores for abusive, hateful and sexually explicit language (problem 8).

Two Kneser-Ney word models, one of offensive and one of ordinary utterances (triples by their counts, pairs
and words by the contexts they continue), share the counts they
back off to, so that a rare expression is judged by the company its words keep in either class.
Every utterance of every document is scored with both, many documents at once: a word is a number, the
words of a block of texts are one array, and a triple of words is one number, too.
A document's score is the highest length-normalised difference of the two log-likelihoods among
its utterances.  The models are fitted on a bounded sample of labelled documents; the
labels are of whole documents and partly wrong, so which sentences of a document earned its label
is estimated by cross-fitting.
"""

import math
import re
from collections import Counter, defaultdict
from collections.abc import Container, Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.leakage import plain
from loomgraph.llm.seeds import OFFENSIVE_SEEDS, ORDINARY_SEEDS

#: Most labelled documents that the models are fitted on (those with the lowest hash of their id).
MOST_LABELLED = 6_000
#: Utterances of more words than ``LONGEST`` are scored in windows of ``WINDOW`` words.
WINDOW, LONGEST = 12, 18
#: The length that a shorter utterance counts as.
SHORT = 8
#: The discount of the models, and rounds and folds of the cross-fitting.
DISCOUNT, ROUNDS, FOLDS = 0.7, 1, 2
#: Length-normalised difference from which an utterance is offensive.
THRESHOLD = 1.4
#: Difference below which an utterance of a document labelled offensive is trained as an ordinary one.
CLEARLY_ORDINARY = -0.5
#: The score of a null, empty or blank text.
LOWEST = -10.0
#: Triples of words whose difference ``Models`` remembers; beyond that it forgets all and goes on (results do not change).
MET_TRIPLES = 1_000_000
#: Of the triples that a task has met, it keeps one for each place, whose number has so many bits (results do not change).
PLACE_BITS = 20
#: Tokens whose number a task remembers; beyond that it forgets all and goes on (results do not change).
MET_TOKENS = 500_000
#: Words, marks included, whose triples can be numbered in 63 bits; with more of them, utterances are scored one by one.
MOST_WORDS = 1 << 21
#: Texts and words that are scored at once.
TEXTS_PER_BLOCK, WORDS_PER_BLOCK = 1_000, 200_000
#: A word that is rarer in the sample than this is an unknown word.
LEAST_COUNT = 2

DIGITS_FOR_LETTERS = str.maketrans("013457@$", "oieastas")
_ASCII_TOKEN = re.compile(r"[a-z0-9]+(?:[*$@#]+[a-z0-9]+)*|\$[a-z0-9]+")
_TOKEN = re.compile(r"[^\W_]+(?:[*$@#]+[^\W_]+)*|\$[^\W_]+")
_MENTION = re.compile(r"@(?<![^\W_]@)[a-z]\w*")
_SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:[ .\-_*][^\W\d_]){2,}(?![^\W_])")
_SINGLE = frozenset("abcdefghijklmnopqrstuvwxyz")
_STRETCH = re.compile(r"([^\W\d_])\1{2,}")
#: Stands after each utterance; no token has it.
_END = "\x01"
_TO_BLANKS = str.maketrans({chr(k): " " for k in range(128) if not (chr(k).isalnum() or chr(k) in "*$@#" + _END)})
#: Where a run of letters, digits and ``*$@#`` can be several tokens, and where letters can be spaced; else each run has one token at most.
_SEVERAL = re.compile(r"\$[a-z0-9]+[*$@#]|[ .\-_*][a-z][ .\-_*][a-z](?![a-z0-9])")
#: Patterns that begin with the characters that they can begin with are found faster.
_BOUNDARY = re.compile(r"[.!?…:\n](?:(?<!\n)[.!?…:]*[*_\")\]]*(?:\s|$)|(?<=\n)\s*(?=[\n\-*#>|@`\d/])|(?<=\n)\s*\n)")


class _Normal(dict):
    """Tokens as the models see them; filled as tokens are met."""

    def __missing__(self, token: str) -> str:
        out = _STRETCH.sub(r"\1", token)
        if token.isdigit():
            out = "0"
        elif not token.isalpha():
            out = re.sub(r"[*#]", "*", out)
            if sum(map(str.isdigit, out)) * 2 <= len(out):
                out = _STRETCH.sub(r"\1", out.translate(DIGITS_FOR_LETTERS))
        if len(self) > 500_000:
            self.clear()
        self[token] = out
        return out


_NORMAL = _Normal()


def tokens(text: str) -> list[str]:
    """Lower-case words, undisguised: look-alikes, unseen characters, digits for letters, spaced and stretched letters."""
    return [_NORMAL[token] for token in split_words(text)]


def split_words(text: str) -> list[str]:
    """The words of ``tokens`` before ``_NORMAL``."""
    if text.isascii():
        text, split = text.lower(), _ASCII_TOKEN
    else:
        text, split = plain(text), _TOKEN
    if "@" in text:
        text = _MENTION.sub(" someone ", text)
    found = split.findall(text)
    if len(_SINGLE.intersection(found)) > 1 and _SPACED.search(text):
        found = split.findall(_SPACED.sub(lambda m: re.sub(r"[\W_]", "", m.group()), text))
    return found


def seen_as(word: str, known: Container[str], masked: dict[tuple[str, int], list[str]]) -> str:
    """``word`` as the vocabulary has it; a masked word becomes the offensive word that fits it."""
    if word in known:
        return word
    if "*" in word:
        pattern = re.compile(word.replace("*", "."))
        return next((w for w in masked.get((word[0], len(word)), ()) if pattern.fullmatch(w)), "<masked>")
    return "<unk>"


class Counts:
    """What one class's Kneser-Ney model needs: counts of triples, and below them of the contexts that pairs and words continue."""

    def __init__(self, segments: list[list[str]]):
        self.triple: Counter[tuple[str, str, str]] = Counter()
        words: Counter[str] = Counter()
        padded = [["<s>", "<s>", *segment, "</s>"] for segment in segments]
        words.update(chain.from_iterable(x[2:] for x in padded))
        self.triple.update(chain.from_iterable(zip(x, x[1:], x[2:]) for x in padded))
        self.total = sum(words.values())
        self.frequency = words
        self.pair = Counter((b, word) for _, b, word in self.triple)  # of a pair, the words it follows
        self.word = Counter(word for _, word in self.pair)  # of a word, the words it follows
        self.after2: Counter[tuple[str, str]] = Counter()
        for (a, b, _), n in self.triple.items():
            self.after2[a, b] += n
        self.kinds_after2 = Counter((a, b) for a, b, _ in self.triple)
        self.after: Counter[str] = Counter()
        for (b, _), n in self.pair.items():
            self.after[b] += n
        self.kinds_after = Counter(b for b, _ in self.pair)
        self.pairs = sum(self.word.values())

    def probability(self, a: str, b: str, word: str, base: float) -> float:
        p = base
        if self.pairs:
            p = (max(self.word[word] - DISCOUNT, 0) + DISCOUNT * len(self.word) * p) / self.pairs
        if n := self.after.get(b):
            p = (max(self.pair.get((b, word), 0) - DISCOUNT, 0) + DISCOUNT * self.kinds_after[b] * p) / n
        if n := self.after2.get((a, b)):
            p = (max(self.triple.get((a, b, word), 0) - DISCOUNT, 0) + DISCOUNT * self.kinds_after2[a, b] * p) / n
        return p


class Models:
    """The models of both classes over a common vocabulary, with shared backoff counts."""

    def __init__(self, offensive: list[list[str]], ordinary: list[list[str]]):
        seen = Counter(chain.from_iterable(offensive + ordinary))
        self.known = {word for word, n in seen.items() if n >= LEAST_COUNT}
        offensive, ordinary = ([[w if w in self.known else "<unk>" for w in s] for s in x] for x in (offensive, ordinary))
        self.offensive, self.ordinary = Counts(offensive), Counts(ordinary)
        before = defaultdict(set)
        for a, word in {*self.offensive.pair, *self.ordinary.pair}:
            before[word].add(a)
        kinds = sum(map(len, before.values())) or 1
        vocabulary = len(self.known) + 2
        self.shared = {word: (len(own) + 1) / (kinds + vocabulary) for word, own in before.items()}
        self.unseen = 1 / (kinds + vocabulary)
        o, n = self.offensive, self.ordinary
        by_shape = defaultdict(list)  # of words likelier among offensive ones, which a masked word stands for
        for word in self.known:
            if len(word) > 2 and o.frequency[word] * max(n.total, 1) > 2 * (n.frequency[word] + 0.5) * max(o.total, 1):
                by_shape[word[0], len(word)].append(word)
        self.masked = {k: sorted(v, key=lambda w: (-o.frequency[w], w)) for k, v in by_shape.items()}
        self.met: dict[tuple[str, str, str], float] = {}

    def difference(self, triple: tuple[str, str, str]) -> float:
        known = self.met.get(triple)
        if known is None:
            if len(self.met) > MET_TRIPLES:
                self.met.clear()
            base = self.shared.get(triple[2], self.unseen)
            known = self.met[triple] = math.log(self.offensive.probability(*triple, base) / self.ordinary.probability(*triple, base))
        return known

    def utterance(self, words: list[str]) -> float:
        """Mean difference of the log-likelihoods of one utterance; of a longer text, of its highest window of ``WINDOW`` words."""
        known = self.known
        words = ["<s>", "<s>", *(word if word in known else seen_as(word, known, self.masked) for word in words), "</s>"]
        each = list(map(self.difference, zip(words, words[1:], words[2:])))
        if len(each) <= LONGEST:
            return sum(each) / max(len(each), SHORT)
        total = sum(each[:WINDOW])
        best = total
        for k in range(WINDOW, len(each)):
            total += each[k] - each[k - WINDOW]
            best = max(best, total)
        return best / WINDOW

    def score(self, text: str) -> float:
        """The score of a document: that of its highest utterance, or ``LOWEST`` where there is none."""
        if not text:
            return LOWEST
        return max((self.utterance(words) for words in utterances(text)), default=LOWEST)

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        return np.array([self.score(text) for text in texts], float)


class _Numbers(dict):
    """The numbers of tokens, also with ``*$@#`` around them, or -1 where there is no token; filled as they are met."""

    def __init__(self, number: dict[str, int], masked: dict[tuple[str, int], list[str]]):
        super().__init__()
        self.number, self.masked = number, masked

    def __missing__(self, run: str) -> int:
        token = _TOKEN.search(run)
        out = self.number[seen_as(_NORMAL[token.group()], self.number, self.masked)] if token else self.number.get(run, -1)
        if len(self) > MET_TOKENS:
            self.clear()
        self[run] = out
        return out


class _Class:
    """The counts of one class as arrays by number of a word, and as sorted numbers of pairs and triples with their counts."""

    def __init__(self, counts: Counts, number: dict[str, int], vocabulary: int):
        def by_word(x: Counter[str]) -> np.ndarray:
            out = np.zeros(vocabulary, np.int64)
            out[[number[word] for word in x]] = list(x.values())
            return out

        def by_key(x: Counter[tuple[str, ...]], *others: Counter[tuple[str, ...]]) -> tuple[np.ndarray, ...]:
            keys = np.zeros(len(x), np.int64)
            for words in zip(*x):
                keys = keys * vocabulary + np.fromiter(map(number.__getitem__, words), np.int64, len(x))
            order = np.argsort(keys)
            counts = [np.fromiter(map(y.__getitem__, x), np.int64, len(x))[order] for y in (x, *others)]
            return tuple(np.append(y, last) for y, last in zip((keys[order], *counts), (np.iinfo(np.int64).max, 0, 0)))

        self.word, self.after, self.kinds_after = map(by_word, (counts.word, counts.after, counts.kinds_after))
        self.pair, self.triple, self.after2 = by_key(counts.pair), by_key(counts.triple), by_key(counts.after2, counts.kinds_after2)
        self.kinds, self.pairs, self.vocabulary = len(counts.word), counts.pairs, vocabulary

    def probabilities(self, a: np.ndarray, b: np.ndarray, word: np.ndarray, p: np.ndarray) -> np.ndarray:
        """``Counts.probability`` of each triple, with the same steps in the same order."""

        def of(keys: np.ndarray, known: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
            at = np.searchsorted(known, keys)
            return [np.where(known[at] == keys, x[at], 0) for x in counts]

        def down(p: np.ndarray, own: np.ndarray, kinds: np.ndarray, n: np.ndarray) -> np.ndarray:
            return np.where(n > 0, (np.maximum(own - DISCOUNT, 0) + DISCOUNT * kinds * p) / np.maximum(n, 1), p)

        if self.pairs:
            p = (np.maximum(self.word[word] - DISCOUNT, 0) + DISCOUNT * self.kinds * p) / self.pairs
        p = down(p, *of(b * self.vocabulary + word, *self.pair), self.kinds_after[b], self.after[b])
        n, kinds = of(a * self.vocabulary + b, *self.after2)
        return down(p, *of((a * self.vocabulary + b) * self.vocabulary + word, *self.triple), kinds, n)


class Scorer:
    """``Models`` as arrays: the same scores, but for the last bits of their sums, for many texts at once."""

    def __init__(self, models: Models):
        words = [_END, "<s>", "<unk>", "<masked>", *sorted(models.known)]
        number = {word: k for k, word in enumerate(words)}
        self.vocabulary = len(words)
        self.numbers = number, models.masked
        own = number | {"</s>": number[_END]}
        self.base = np.full(self.vocabulary, models.unseen)
        self.base[[own[word] for word in models.shared]] = list(models.shared.values())
        self.classes = [_Class(counts, own, self.vocabulary) for counts in (models.offensive, models.ordinary)]
        self.ready = False

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("met", "keys", "values")} | {"ready": False}

    def _start(self) -> None:
        self.met = _Numbers(*self.numbers)
        self.keys, self.values = np.full(1 << PLACE_BITS, -1, np.int64), np.zeros(1 << PLACE_BITS)
        self.ready = True

    def _new(self, keys: np.ndarray) -> np.ndarray:
        pairs, word = np.divmod(keys, self.vocabulary)
        a, b = np.divmod(pairs, self.vocabulary)
        offensive, ordinary = (x.probabilities(a, b, word, self.base[word]) for x in self.classes)
        return np.array(list(map(math.log, (offensive / ordinary).tolist())))

    def differences(self, keys: np.ndarray) -> np.ndarray:
        """``Models.difference`` of each numbered triple; what was met before is looked up."""
        places = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PLACE_BITS)).astype(np.int64)
        out = self.values[places]
        new = np.flatnonzero(self.keys[places] != keys)
        if len(new):
            own, back = np.unique(keys[new], return_inverse=True)
            values = self._new(own)
            out[new] = values[back]
            at = np.zeros(len(own), np.int64)
            at[back] = places[new]
            _, last = np.unique(at, return_index=True)  # one triple for each place
            self.keys[at[last]], self.values[at[last]] = own[last], values[last]
        return out

    def _block(self, texts: list[np.ndarray]) -> np.ndarray:
        """The scores of texts whose words are numbered, each utterance with its end (0) after it."""
        scores = np.full(len(texts), LOWEST)
        words = np.concatenate(texts)
        text = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        words, text = words[words >= 0], text[words >= 0]
        kept = (words != 0) | (np.append(0, words[:-1]) != 0)  # no end without words before it
        words, text = words[kept], text[kept]
        if not len(words):
            return scores
        start = 1  # the number of <s>
        before = np.append(0, words[:-1])
        b = np.where(before == 0, start, before)
        a = np.append(start, b[:-1])
        a[before == 0] = start
        each = self.differences((a * self.vocabulary + b) * self.vocabulary + words)
        ends = np.flatnonzero(words == 0)
        starts = np.append(0, ends[:-1] + 1)
        lengths = ends - starts + 1
        best = np.add.reduceat(each, starts) / np.maximum(lengths, SHORT)
        longer = np.flatnonzero(lengths > LONGEST)
        if len(longer):
            windows = np.full(len(each), -np.inf)
            windows[: len(each) - WINDOW + 1] = sum(each[k : len(each) - WINDOW + 1 + k] for k in range(WINDOW))
            windows[np.repeat(ends, lengths) - np.arange(len(each)) < WINDOW - 1] = -np.inf  # it would go beyond its utterance
            best[longer] = np.maximum.reduceat(windows, starts)[longer] / WINDOW
        text = text[ends]
        first = np.flatnonzero(np.append(True, text[1:] != text[:-1]))
        scores[text[first]] = np.maximum.reduceat(best, first)
        return scores

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """``Models.score`` of each text."""
        if not self.ready:
            self._start()
        number, out, block, held = self.met.__getitem__, [np.empty(0)], [], 0
        for text in texts:
            words = words_and_ends(text) if text else []
            block.append(np.fromiter(map(number, words), np.int64, len(words)))
            held += len(words)
            if held >= WORDS_PER_BLOCK or len(block) >= TEXTS_PER_BLOCK:
                out.append(self._block(block))
                block, held = [], 0
        if block:
            out.append(self._block(block))
        return np.concatenate(out)


def scorer_of(models: Models) -> Scorer | Models:
    """What scores many texts by ``models``."""
    return Scorer(models) if len(models.known) < MOST_WORDS - 8 else models


def utterances(text: str) -> list[list[str]]:
    """The words of each sentence or block of ``text``; a line that merely goes on is no boundary."""
    return [words for part in _BOUNDARY.split(text) if (words := tokens(part))]


def words_and_ends(text: str) -> list[str]:
    """The words of the ``utterances`` of ``text``, before ``_NORMAL`` and maybe with ``*$@#`` around them, with ``_END`` after each utterance."""
    if _END in text:
        text = text.replace(_END, "\0")
    out = []
    if not text.isascii():  # the order of utterances doesn't count
        parts = _BOUNDARY.split(text)
        for part in parts:
            if not part.isascii():
                out += (*split_words(part), _END)
        whole = f" {_END} ".join([part for part in parts if part.isascii()])
    else:
        whole = _BOUNDARY.sub(f" {_END} ", text)
    whole = whole.lower()
    named = _MENTION.sub(" someone ", whole) if "@" in whole else whole
    if _SEVERAL.search(named):
        for part in whole.split(_END):
            out += (*split_words(part), _END)
        return out
    return [*named.translate(_TO_BLANKS).split(), _END, *out]


def fold_of(doc: int) -> int:
    """The fold of a document, whatever ids may have in common."""
    return (doc * 0x9E3779B1 & 0xFFFFFFFF) * FOLDS >> 32


def fit(labelled: list[tuple[int, str, float]]) -> Models:
    """Models from ``(doc_id, text, share of labels that say offensive)``; with no such documents, from the seed phrases alone."""
    segments = [(doc, label, words) for doc, text, label in labelled for words in utterances(text or "")]
    seeds_off, seeds_ord = [tokens(s) for s in OFFENSIVE_SEEDS], [tokens(s) for s in ORDINARY_SEEDS]
    turns = _turns(segments)
    ordinary_turn = _ordinary_turns(turns)
    open_ = [label >= 0.5 and not ordinary_turn(words) for _, label, words in segments]
    model = Models(seeds_off, seeds_ord + [words for free, (_, _, words) in zip(open_, segments) if not free])
    scores = [model.utterance(words) if free else LOWEST for free, (_, _, words) in zip(open_, segments)]
    telling = _telling_turns(segments, turns)
    tells = [telling(words) for _, _, words in segments]  # in a document labelled ordinary, most likely a wrong label
    chosen = [free and (score > 0 or tell) for free, score, tell in zip(open_, scores, tells)]

    def train(without: int | None) -> Models:
        # what is neither clearly ordinary nor chosen in a document labelled offensive is left out of both classes
        own = [k for k, (doc, _, _) in enumerate(segments) if without is None or fold_of(doc) != without]
        return Models(seeds_off + [segments[k][2] for k in own if chosen[k]], seeds_ord + [segments[k][2] for k in own if not chosen[k] and scores[k] < CLEARLY_ORDINARY and not tells[k]])

    for _ in range(ROUNDS):
        folds = [train(fold) for fold in range(FOLDS)]
        scores = [folds[fold_of(doc)].utterance(words) if free else LOWEST for free, (doc, _, words) in zip(open_, segments)]
        chosen = [score > THRESHOLD for score in scores]
    return train(None)


def _turns(segments: list[tuple[int, float, list[str]]]) -> tuple[Counter[tuple], Counter[tuple]]:
    """For each turn of phrase (four words), the documents labelled ordinary and offensive that use it."""
    docs: tuple[Counter[tuple], Counter[tuple]] = Counter(), Counter()
    for (_, label), own in groupby(segments, key=lambda x: x[:2]):
        docs[label >= 0.5].update(set(chain.from_iterable(zip(words, words[1:], words[2:], words[3:]) for _, _, words in own)))
    return docs


def _telling_turns(segments: list[tuple[int, float, list[str]]], docs: tuple[Counter[tuple], Counter[tuple]]):
    """Tells an utterance with a turn of phrase that several offensive documents use and hardly any ordinary one, wrong labels aside."""
    ordinary = len({doc for doc, label, _ in segments if label < 0.5}) or 1
    offensive = len({doc for doc, label, _ in segments if label >= 0.5}) or 1
    turns = {turn for turn, o in docs[True].items() if o >= 3 and o / offensive >= 12 * (docs[False][turn] + 0.5) / ordinary}

    def told(words: list[str]) -> bool:
        return not turns.isdisjoint(zip(words, words[1:], words[2:], words[3:]))

    return told


def _ordinary_turns(docs: tuple[Counter[tuple], Counter[tuple]]):
    """Tells an utterance made of turns of phrase that documents without an offence use, too.

    A document labelled offensive has ordinary sentences with harsh words as well; where a turn is
    found in a fair share of documents labelled as ordinary, it didn't earn the label.
    """

    def told(words: list[str]) -> bool:
        counts = [(n, o) for turn in set(zip(words, words[1:], words[2:], words[3:])) if (n := docs[False][turn]) + (o := docs[True][turn]) >= 3]
        return bool(counts) and sum(n >= 2 and n >= 0.5 * o for n, o in counts) > 0.5 * len(counts)

    return told


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, source, score, offensive)`` of every document; the columns of ``docs`` that clash or are not needed are left out.

    ``labels`` has ``doc_id`` and ``offensive``, possibly several rows a document, which count on
    average.  The models are fitted on at most ``MOST_LABELLED`` labelled documents.  Null, empty
    and blank texts score ``LOWEST``; repeated rows give repeated rows; without labels the seed
    phrases alone make the models.
    """
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"), docs["source"].cast("string").alias("source"))
    verdicts = labels.filter("doc_id is not null and offensive is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("offensive").alias("label"))
    verdicts = verdicts.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MOST_LABELLED)
    sample = texts.select("doc_id", "text").filter("text is not null").join(verdicts, "doc_id").dropDuplicates(["doc_id"]).select("doc_id", "text", "label")
    models = fit(sorted((row.doc_id, row.text, row.label) for row in sample.collect()))
    shipped = docs.sparkSession.sparkContext.broadcast(scorer_of(models))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            scores = own.scores(text.as_py() for text in batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(scores), pa.array(scores > THRESHOLD)], names=["doc_id", "source", "score", "offensive"])

    return texts.mapInArrow(score, "doc_id long, source string, score double, offensive boolean")


def found(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(doc_id)`` of each document with an offensive utterance."""
    return score_documents(docs, labels).filter("offensive").select("doc_id").distinct()


def rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(source, documents, offensive, rate)`` per source."""
    counts = score_documents(docs, labels).groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("offensive").alias("offensive"))
    return counts.withColumn("rate", F.col("offensive") / F.col("documents"))
