"""Encoding of a corpus with a byte-level BPE vocabulary (problem 6).

Corpus-level merge replay: instead of tokenising text by text, the distinct words of a block of
the corpus are laid end to end, an inverted index from token pair to positions is built over
them, and the merges are applied in rank order to all their positions at once.  Only the
neighbours of a merged position are touched.  Each Spark task does this for its own part of the
corpus and keeps what it has learnt in a word table of bounded size, so the job needs no shuffle
and its cost per text falls as words repeat.
"""

import base64
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's public definition splits text into words.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts in ASCII, which the faster standard library can split.
ASCII_WORDS = r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Words a task remembers; beyond that it forgets all and goes on (results do not change).
REMEMBERED_WORDS = 500_000
ROWS_PER_BLOCK = 2_000


def load_ranks(lines: Iterable[bytes]) -> dict[bytes, int]:
    """Token bytes to id, where the id is also the rank of the merge that makes the token."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, map(bytes.strip, lines)))}


class Merges(dict):
    """From a pair of token ids, ``left << 16 | right``, to the id that their merge makes, or -1; filled as pairs are met."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}

    def __missing__(self, pair: int) -> int:
        made = self[pair] = self.ranks.get(self.token[pair >> 16] + self.token[pair & 0xFFFF], -1)
        return made


def replay(words: list[bytes], merges: Merges) -> list[list[int]]:
    """The token ids of each word, by applying every merge to all words in order of rank."""
    single = [merges.ranks[bytes([byte])] for byte in range(256)]
    ids: list[int] = []  # by position; -1 ends a word (no merge crosses it), -2 was merged away
    for word in words:
        ids.extend([single[byte] for byte in word])
        ids.append(-1)
    n = len(ids)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    where: dict[int, list[int]] = {}
    for at, (left, right) in enumerate(zip(ids, ids[1:])):
        if left >= 0 and right >= 0 and (made := merges[left << 16 | right]) >= 0:
            where.setdefault(made, []).append(at)
    due = list(where)
    heapq.heapify(due)
    while due:
        rank = heapq.heappop(due)
        spots = where.pop(rank)
        spots.sort()
        for at in spots:
            left = ids[at]
            if left < 0:
                continue
            then = after[at]
            right = ids[then]
            if right < 0 or merges[left << 16 | right] != rank:
                continue  # a neighbour was merged away meanwhile
            ids[at] = rank
            ids[then] = -2
            following = after[at] = after[then]
            before[following] = at
            previous = before[at]
            for start, pair in ((at, rank << 16 | ids[following] if ids[following] >= 0 else -1), (previous, ids[previous] << 16 | rank if previous >= 0 and ids[previous] >= 0 else -1)):
                if pair >= 0 and (made := merges[pair]) >= 0:
                    if made in where:
                        where[made].append(start)
                    else:
                        where[made] = [start]
                        heapq.heappush(due, made)
    result: list[list[int]] = []
    own: list[int] = []
    for token in ids:
        if token >= 0:
            own.append(token)
        elif token == -1:
            result.append(own)
            own = []
    return result


def encode_corpus(docs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids)``: the token ids of every text, without special tokens.

    Null and empty texts give an empty list; blank texts are encoded as they are.  Rows are kept
    one for one (repeated rows are encoded again, from memory); other columns are not read.  The vocabulary is one
    file of about a megabyte, which is sent to the executors as it is; its path is a parameter.
    """
    with open(vocabulary, "rb") as file:
        shipped = docs.sparkSession.sparkContext.broadcast(file.read())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(shipped.value.splitlines())
        merges = Merges(ranks)
        split_any, split_ascii = regex.compile(WORDS).findall, re.compile(ASCII_WORDS, re.ASCII).findall
        known: dict[str, list[int]] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_PER_BLOCK):
                block = batch.slice(start, ROWS_PER_BLOCK)
                if len(known) > REMEMBERED_WORDS:
                    known.clear()
                texts = [(split_ascii if text.isascii() else split_any)(text) if text else [] for text in block.column(1).to_pylist()]
                new = set(chain.from_iterable(texts)).difference(known)
                todo: list[str] = []
                for word in new:
                    rank = ranks.get(word.encode("utf-8", "surrogatepass"))
                    if rank is None:
                        todo.append(word)
                    else:
                        known[word] = [rank]
                known.update(zip(todo, replay([word.encode("utf-8", "surrogatepass") for word in todo], merges)))
                get = known.__getitem__
                lists = [list(chain.from_iterable(map(get, words))) for words in texts]
                offsets = [0]
                for ids in lists:
                    offsets.append(offsets[-1] + len(ids))
                flat = pa.array(chain.from_iterable(lists), pa.int32(), size=offsets[-1])
                yield pa.RecordBatch.from_arrays([block.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)], names=["doc_id", "ids"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(encode, "doc_id long, ids array<int>")
