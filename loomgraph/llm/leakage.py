"""Evaluation items that stand, whole or in part, in training texts (problem 7).

One Aho-Corasick automaton holds the word windows of all normalised items.  Each text is
normalised and scanned once; the windows it contains give, per item, places on both sides from
which the item's words are aligned with the text's, so that spelling changes and a few changed
words between the windows count too.  Positions lead back to offsets in the original text.  Items of
the same words are one in the automaton and come apart again by a join.
"""

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from itertools import islice

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in a window of the automaton.
WINDOW = 3
#: A window that stands in more items than this is common.  An item is aligned with a text that has some of its other
#: windows, or windows of any kind over this share of the words that a run needs.
COMMON_WINDOW, LEAST_COVERED = 3, 0.5
#: A run counts from this many words of the item, and from this share of the item; of an item with fewer words, from this share.
LEAST_WORDS, LEAST_SHARE, LEAST_OF_SHORT = 18, 0.45, 0.9
#: Share of a run's words that must be the item's, and the share that must be so letter for letter.
LEAST_KEPT, LEAST_EXACT = 0.8, 0.68
#: Items per automaton; with more, the texts are scanned once for each such block of items.
ITEMS_PER_BLOCK = 20_000

# Letters of other scripts that look like Latin ones, and characters that are not seen.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмтвнαεοριυκντ", "aeopcyxijsdhkmtbhaeopiukvt")
UNSEEN = re.compile(r"[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_MARKS = re.compile(r"[\u0300-\u036f\u1ab0-\u1aff\u20d0-\u20ff\ufe20-\ufe2f]")
_PLAIN = re.compile(r"[a-z0-9]+")
_ANY = re.compile(r"[^\W_]+")


def plain(text: str) -> str:
    """``text`` without case, compatibility forms, accents, look-alike letters and unseen characters."""
    text = UNSEEN.sub("", unicodedata.normalize("NFKC", text)).casefold().translate(LOOKALIKES)
    return _MARKS.sub("", unicodedata.normalize("NFD", text))


def normal_words(text: str) -> list[str]:
    return _PLAIN.findall(text.lower()) if text.isascii() else _ANY.findall(plain(text))


def placed_words(text: str) -> list[tuple[str, int, int]]:
    """The normalised words with the offsets of the original text that they come from."""
    out = []
    for chunk in re.finditer(r"\S+", text):
        start = chunk.start()
        if chunk.group().isascii():
            out += [(m.group().lower(), start + m.start(), start + m.end()) for m in re.finditer(r"[A-Za-z0-9]+", chunk.group())]
        else:
            out += [(word, start, chunk.end()) for word in _ANY.findall(plain(chunk.group()))]
    return out


def item_words(text: str) -> tuple[list[str], list[int]]:
    """The normalised words of an item, and of each the number of the blank-separated token it is in."""
    words, tokens = [], []
    for k, token in enumerate(text.split()):
        own = normal_words(token)
        words += own
        tokens += [k] * len(own)
    return words, tokens


def windows_of(words: list[str]) -> list[str]:
    size = min(WINDOW, len(words))
    return [f" {' '.join(words[at : at + size])} " for at in range(len(words) - size + 1)] if words else []


class Items:
    """Items of different words, with the automaton over their windows; ``common`` has those windows that stand in many."""

    def __init__(self, items: list[tuple[int, str]], common: set[str] | frozenset[str] = frozenset()):
        self.words: dict[int, list[str]] = {}
        self.tokens: dict[int, list[int]] = {}
        self.n_tokens: dict[int, int] = {}
        self.need: dict[int, float] = {}
        windows: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for item, text in items:
            self.words[item], self.tokens[item] = item_words(text or "")
            n = self.n_tokens[item] = len(set(self.tokens[item]))
            self.need[item] = LEAST_OF_SHORT * n if n < LEAST_WORDS else max(LEAST_WORDS, LEAST_SHARE * n)
            for at, window in enumerate(windows_of(self.words[item])):
                windows[window].append((item, at))
        self.automaton = ahocorasick.Automaton()
        self.any = bool(windows)
        for window, places in windows.items():
            self.automaton.add_word(window, (len(window), window in common, places))
        if self.any:
            self.automaton.make_automaton()

    def scan(self, text: str) -> list[tuple[int, int, int, int, float]]:
        """``(item, first word, last word, words of the run, share)`` of each item that ``text`` leaks; words are numbered in the text."""
        words = normal_words(text)
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        telling: Counter[int] = Counter()
        starts = None
        for end, (length, common, places) in self.automaton.iter(f" {' '.join(words)} "):
            if starts is None:
                starts, at = [], 0
                for word in words:
                    starts.append(at)
                    at += len(word) + 1
            word = bisect_right(starts, end - length + 1) - 1
            for item, place in places:
                hits[item].append((word, place))
            if not common:
                telling.update({item for item, _ in places})
        out = []
        for item, own in hits.items():
            few = min(3, max(1, len(self.words[item]) - WINDOW + 1))
            if len(own) < few:
                continue
            if telling[item] < few:
                least = LEAST_COVERED * self.need[item]
                if WINDOW * len(own) < least or len({place + k for _, place in own for k in range(WINDOW)}) < least:
                    continue
            run = self.align(item, own, words)
            if run:
                out.append((item, *run))
        return out

    def align(self, item: int, hits: list[tuple[int, int]], words: list[str]) -> tuple[int, int, int, float] | None:
        theirs, tokens = self.words[item], self.tokens[item]
        need = self.need[item]
        best = None
        for low, high in neighbourhoods(hits, len(theirs), len(words), least=2 if len(theirs) > WINDOW else 1):
            part = words[low:high]
            same = [-1] * len(theirs)
            blocks = SequenceMatcher(None, theirs, part, autojunk=False).get_matching_blocks()
            last_a = last_b = 0
            for a, b, size in blocks:
                if a - last_a and a - last_a == b - last_b:  # words between two matches, in equal number
                    for k in range(a - last_a):
                        if alike(theirs[last_a + k], part[last_b + k]):
                            same[last_a + k] = last_b + k
                for k in range(size):
                    same[a + k] = b + k
                last_a, last_b = a + size, b + size
            # the run where kept words outweigh changed ones most
            top, total, start = (0.0, 0, 0), 0.0, 0
            for k, at in enumerate(same):
                if total <= 0:
                    total, start = 0.0, k
                total += 1 if at >= 0 else -1.5
                if total > top[0]:
                    top = total, start, k + 1
            _, start, stop = top
            kept = [k for k in range(start, stop) if same[k] >= 0]
            exact = sum(part[same[k]] == theirs[k] for k in kept)
            if not kept or exact < LEAST_EXACT * (stop - start):
                continue
            length = len(set(tokens[start:stop]))
            first, last = low + same[kept[0]], low + same[kept[-1]]
            if length >= need and len(kept) >= LEAST_KEPT * (stop - start) and last - first <= 2 * (stop - start) + 6 and (best is None or length > best[2]):
                best = first, last, length, length / self.n_tokens[item]
        return best


def neighbourhoods(hits: list[tuple[int, int]], n_item: int, n_text: int, least: int = 2) -> list[tuple[int, int]]:
    """The stretches of the text where at least ``least`` hits of one item stand together, with room for the whole item."""
    out: list[list[int]] = []
    for word, place in sorted(hits):
        low, high = max(0, word - place - 8), min(n_text, word + n_item - place + 8)
        if out and low <= out[-1][1] and low - out[-1][0] <= 12:
            out[-1][1] = max(out[-1][1], high)
            out[-1][2] += 1
        else:
            out.append([low, high, 1])
    return [(low, high) for low, high, n in out if n >= least]


def alike(a: str, b: str) -> bool:
    return a == b or (len(a) > 3 and len(b) > 3 and SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.7)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, char_start, char_end, words, share)``: the longest run of each item in each text that leaks it.

    The offsets are those of the original text (zero-based, end exclusive); ``words`` and ``share``
    tell how much of the item the run covers.  Null, empty and blank texts and items leak nothing;
    repeated rows give repeated rows, items delivered twice count once; without items there is no row.  The items go to every task in
    blocks of at most ``ITEMS_PER_BLOCK``, one scan of the texts for each block, so that neither an
    automaton nor what is sent grows without bound; the results don't depend on the blocks.
    """
    spark = docs.sparkSession
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).filter("text is not null and text != ''")
    wanted = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null")
    normal = wanted.mapInPandas(_normalise, "item_id long, text string, same string").distinct()
    firsts = normal.groupBy("same").agg(F.min("item_id").alias("first"))
    members = normal.join(firsts, "same").select("first", "item_id").distinct()
    alone = normal.join(firsts, "same").filter("item_id = first").groupBy("first").agg(F.min("text").alias("text"))
    windows = alone.mapInPandas(_windows, "window string").groupBy("window").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > COMMON_WINDOW)
    common = frozenset(row.window for row in windows.toLocalIterator())
    schema = "doc_id long, first long, char_start int, char_end int, words int, share double"
    rest = alone.orderBy("first").toLocalIterator()
    out = None
    while block := [(row.first, row.text) for row in islice(rest, ITEMS_PER_BLOCK)]:
        part = _scan(texts, block, common, schema)
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], schema)
    return out.join(members, "first").select("doc_id", "item_id", "char_start", "char_end", "words", "share")


def _normalise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        same = []
        for text in batch["text"]:
            words, tokens = item_words(text)
            same.append(hashlib.sha256("".join(f"{word} {token}\n" for word, token in zip(words, tokens)).encode()).hexdigest() if words else None)
        yield batch.assign(same=same).dropna(subset=["same"])


def _windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"window": [window for text in batch["text"] for window in sorted(set(windows_of(item_words(text)[0])))]}, dtype=object)


def _scan(texts: DataFrame, block: list[tuple[int, str]], common: frozenset[str], schema: str) -> DataFrame:
    shipped = texts.sparkSession.sparkContext.broadcast((block, common))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        items = Items(*shipped.value)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                runs = items.scan(text) if items.any else []
                if runs:
                    placed = placed_words(text)
                    rows += [(doc, item, placed[first][1], placed[last][2], length, share) for item, first, last, length, share in runs]
            yield pd.DataFrame(rows, columns=["doc_id", "first", "char_start", "char_end", "words", "share"])

    return texts.mapInPandas(scan, schema)


def found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(doc_id, item_id)``: each pair once."""
    return leaks(docs, items).select("doc_id", "item_id").distinct()


def leak_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``(suite, item_id, documents)``: which items leaked, and into how many documents."""
    return found(docs, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents")).join(items.select("item_id", "suite"), "item_id").select("suite", "item_id", "documents")
