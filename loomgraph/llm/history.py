"""Checking new batches for repeats of everything accepted before (problem 3).

Each batch becomes an immutable segment: a suffix array over the batch's concatenated texts, in which
suffixes begin at words and stand in the order of their words' codes.  A segment is cut at fixed
fences into ranges, each one sorted block of numbers, and is bucketed by range, so that a batch's
suffixes meet each older segment where it lies: nothing of the history is shuffled again.  In a
range the batch's suffixes are looked up by binary search; the suffixes of the block that begin with
the same ``SUFFIX_WORDS`` words are the matches.  The words that matches cover are added up for each
pair of records, and pairs with enough of them are compared as wholes.  A segment is merged with the one
before it unless that is twice as large, so a record is rewritten a logarithmic number of times.

The array is sampled by minimizers (Grabowski and Raniszewski, 2015): of any ``WINDOW`` neighbouring
suffixes the one of lowest hash is in it.  Equal passages of ``SUFFIX_WORDS + WINDOW - 1`` words are thus sampled
alike wherever they stand, and none of them is missed.
"""

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.llm.leakage import normal_words
from loomgraph.plans.lineage import shared_dir

#: Words that a match has at least, and neighbouring suffixes of which one is sampled at least.
SUFFIX_WORDS, WINDOW = 6, 5
#: Texts of fewer words than this have all their suffixes in the array, too, matched by ``SHORT_WORDS`` words among such texts.
SHORT_TEXT, SHORT_WORDS = 32, 3
#: Share of a record's words that matches with another cover, from which the two are compared, and the share of word pairs
#: they must then have in common to be repeats.
LEAST_COVER, LEAST_LIKE = 0.15, 0.7
#: Of more equal suffixes than this in one block the lowest ids are met first, and the others as far as they still can matter.
HOT = 64
#: Suffixes of all records for which a segment has a bucket; a bucket has four ranges.
BUCKET_PLACES = 800_000
#: Records whose suffixes are sampled to lay the fences (this affects only how even the ranges are).
FENCE_RECORDS = 4_000
#: Suffixes of a batch for which there is a group of records whose matches are added up together.
GROUP_PLACES = 150_000
#: Matches of common suffixes for which there is a group of pairs whose matches are added up together.
GROUP_MATCHES = 1_000_000
#: Matches of common suffixes up to which they are all looked up without first finding bounds for them (same results).
REST_AT_ONCE = 1_000_000
#: Pairs up to which the pairs of a batch are broadcast (16 bytes each).
BROADCAST_PAIRS = 200_000
#: Characters of texts that are taken apart at once, and words of pairs that are compared at once (same results).
TEXT_BLOCK, PAIR_BLOCK = 1_000_000, 500_000

#: Shares of a text are counted in ten-thousandths.
_ALL = 10_000
_NEED = int(LEAST_COVER * _ALL)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_IN_WORD = np.array([b >= 128 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" for b in range(256)])
_SHORT_KEYS, _WHOLE_KEYS = np.uint64(1 << 60), np.uint64(2 << 60)
_RECORD = "id long, batch_no int, whole long, whole2 long, codes binary"
_FOUND = "group int, inside boolean, range int, ids binary, kept_ids binary, shares binary, hot_ids binary, hot_keys binary, hot_shares binary, hot_n binary"
_WEIGHED = "kind string, id long, kept_id long, share int, inside boolean, key long, range int, missing int, n long, ids binary, kept_ids binary, shares binary, insides binary"
_PAIRS = "group int, inside boolean, ids binary, kept_ids binary, shares binary"
_BLOCK = "range int, size long, keys binary, ids binary, shares binary, more_keys binary, more_ids binary, more_shares binary, rest_keys binary, rest_ids binary"


def _xxh32(text: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """xxHash's 32-bit hashes of the pieces of ``text``: all those under 16 bytes in one go, by the same steps."""
    one, two, three, four, five = (np.uint32(p) for p in (2654435761, 2246822519, 3266489917, 668265263, 374761393))
    data = np.frombuffer(text, np.uint8)
    out = five + sizes.astype(np.uint32)

    def step(which: np.ndarray, value: np.ndarray, times: np.uint32, bits: int, factor: np.uint32) -> None:
        mixed = out[which] + value * times
        out[which] = ((mixed << np.uint32(bits)) | (mixed >> np.uint32(32 - bits))) * factor

    for k in range(0, 12, 4):
        which = np.flatnonzero((sizes >= k + 4) & (sizes < 16))
        at = starts[which] + k
        value = data[at].astype(np.uint32)
        for byte in (1, 2, 3):
            value |= data[at + byte].astype(np.uint32) << np.uint32(8 * byte)
        step(which, value, three, 17, four)
    for k in range(3):
        which = np.flatnonzero((sizes % 4 > k) & (sizes < 16))
        step(which, data[starts[which] + sizes[which] // 4 * 4 + k].astype(np.uint32), five, 11, one)
    out = (out ^ (out >> np.uint32(15))) * two
    out = (out ^ (out >> np.uint32(13))) * three
    out ^= out >> np.uint32(16)
    for k in np.flatnonzero(sizes >= 16).tolist():
        out[k] = xxhash.xxh32_intdigest(text[starts[k] : starts[k] + sizes[k]])
    return out


def _normal(text: str) -> bytes:
    """``text`` with the words that ``normal_words`` finds in it, which ``_IN_WORD`` tells from what is between them.  No form of a character reaches over blanks."""
    if text.isascii():
        return text.lower().encode()
    return " ".join(part.lower() if part.isascii() else " ".join(normal_words(part)) for part in text.split()).encode()


def word_codes(texts: list[str]) -> list[bytes]:
    """For each text the 32-bit codes of its normalised words."""
    parts = [_normal(text) for text in texts]
    joined = b"\n".join([b"", *parts, b""])
    begins = np.cumsum([1, *(len(part) + 1 for part in parts)])
    within = _IN_WORD[np.frombuffer(joined, np.uint8)]
    edges = np.flatnonzero(within[1:] != within[:-1]) + 1
    starts, ends = edges[::2], edges[1::2]
    codes = _xxh32(joined, starts, ends - starts).astype("<u4").tobytes()
    cuts = (4 * np.searchsorted(starts, begins)).tolist()
    return [codes[a:b] for a, b in zip(cuts, cuts[1:])]


def _blocks(sizes: np.ndarray, most: int, rows: int) -> list[np.ndarray]:
    """The indices of ``sizes`` in blocks that come to about ``most`` and have up to ``rows`` each."""
    before = np.cumsum(sizes) - sizes
    index = np.arange(len(sizes))
    parts = np.split(index, np.flatnonzero(np.diff(before // most)) + 1)
    return [block for part in parts for block in np.split(part, range(rows, len(part), rows)) if len(block)]


def records_of(rows: DataFrame) -> DataFrame:
    """``(id, batch_no, whole, whole2, codes)`` of ``rows`` with ``id``, ``batch_no``, ``content``: 32-bit codes of the normalised words, and two hashes of them all.  Texts without words give no row."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["content"].tolist()
            blocks = _blocks(np.array([len(text) for text in texts], np.int64), TEXT_BLOCK, len(texts) + 1)
            out = batch[["id", "batch_no"]].assign(codes=[c for block in blocks for c in word_codes(texts[block[0] : block[-1] + 1])])
            out = out[out["codes"].map(len) > 0]
            for name, seed in (("whole", 0), ("whole2", 1)):
                out[name] = np.array([xxhash.xxh64_intdigest(c, seed) for c in out["codes"]], np.uint64).view(np.int64)
            yield out[["id", "batch_no", "whole", "whole2", "codes"]]

    return rows.select("id", "batch_no", "content").mapInPandas(make, _RECORD)


def _begin(codes: np.ndarray, words: int, bits: int) -> np.ndarray:
    """For each place the first ``bits`` bits of the codes of the ``words`` words from it on, so that numbers are ordered as the suffixes are."""
    top = codes >> np.uint64(32 - bits)
    out = np.zeros(len(codes), np.uint64)
    for k in range(words):
        out <<= np.uint64(bits)
        out[: len(codes) - k] |= top[k:]
    return out


def _lowest(hashes: np.ndarray, within: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Which places are the lowest of some window of ``WINDOW`` places; ``within`` tells the places a window may begin at."""
    low = hashes.copy()
    for k in range(1, WINDOW):
        low[:-k] = np.minimum(low[:-k], hashes[k:])
    kept = within & (low == hashes)
    for k in range(1, WINDOW):
        kept[k:] |= within[:-k] & (low[:-k] == hashes[k:]) & (texts[:-k] == texts[k:])
    return kept


def suffixes(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sampled suffixes of the concatenated ``texts`` (arrays of codes) in order: key, number of the text, and the share of the text it stands for.

    A key's top bits tell suffixes, suffixes of short texts, and whole texts apart.  Equal suffixes
    of one text are one.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    if not sizes.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    gap = np.zeros(SUFFIX_WORDS, np.uint32)
    flat = np.concatenate([part for t in texts for part in (t, gap)]).astype(np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes + SUFFIX_WORDS)[:-1]])
    owner = np.repeat(np.arange(len(sizes)), sizes + SUFFIX_WORDS)
    at = np.arange(len(flat)) - starts[owner]
    n = sizes[owner]

    key = _begin(flat, SUFFIX_WORDS, 10)
    valid = at <= n - SUFFIX_WORDS
    mixed = (key ^ (key >> np.uint64(29))) * _MULTIPLIER
    mixed = np.where(valid, mixed ^ (mixed >> np.uint64(32)), np.uint64(0xFFFFFFFFFFFFFFFF))
    kept = valid & _lowest(mixed, valid & ((at + WINDOW - 1 <= n - SUFFIX_WORDS) | (at == 0)), owner)
    places = np.nonzero(kept)[0]
    following = np.append(places[1:], len(flat))
    stands = np.minimum(np.minimum(following - places, SUFFIX_WORDS), (n - at)[places])

    short = np.nonzero((n < SHORT_TEXT) & (at <= n - SHORT_WORDS))[0]
    short_key = _begin(flat, SHORT_WORDS, 20)[short] | _SHORT_KEYS
    full = np.nonzero(sizes)[0]
    whole = np.array([xxhash.xxh64_intdigest(texts[k].astype("<u4").tobytes(), 2) for k in full], np.uint64) >> np.uint64(4) | _WHOLE_KEYS

    keys = np.concatenate([key[places], short_key, whole])
    owners = np.concatenate([owner[places], owner[short], full])
    words = np.concatenate([stands, np.ones(len(short), np.int64), sizes[full]])
    shares = -(-words * _ALL // sizes[owners])
    order = np.lexsort((owners, keys))
    keys, owners, shares = keys[order], owners[order], shares[order]
    first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (owners[1:] != owners[:-1])))
    return keys[first], owners[first], np.minimum(np.add.reduceat(shares, first), _ALL)


def _cut(of: np.ndarray) -> dict[int, np.ndarray]:
    """The indices at which each number stands in ``of``."""
    order = np.argsort(of, kind="stable")
    numbers, begin = np.unique(of[order], return_index=True)
    return dict(zip(numbers.tolist(), np.split(order, begin[1:])))


def _group(ids: np.ndarray, groups: int) -> np.ndarray:
    return ((ids.astype(np.uint64) * _MULTIPLIER) >> np.uint64(40)).astype(np.int64) % groups


def _names(schema: str) -> list[str]:
    return schema.replace(",", "").split()[::2]


def _pack(number: int, entries: tuple, more: tuple, rest: tuple = (np.zeros(0), np.zeros(0))) -> tuple:
    kinds = ("<u8", "<i8", "<u2")
    return (number, len(entries[0]), *(a.astype(t).tobytes() for part in (entries, more, rest) for a, t in zip(part, kinds)))


def _unpack(row, names: tuple = ("keys", "ids", "shares"), kinds: tuple = ("<u8", "<i8", "<u2")) -> tuple[np.ndarray, ...]:
    return tuple(np.frombuffer(getattr(row, name), kind) for name, kind in zip(names, kinds))


_MORE = ("more_keys", "more_ids", "more_shares")


def _join_blocks(number: int, parts: list, hot: int) -> tuple:
    """One sorted block of the blocks ``parts`` of a range; of more than ``hot`` equal suffixes all but the lowest ids stand in its ``rest``, too."""
    keys, ids, shares = (np.concatenate(a) for a in zip(*(_unpack(p) for p in parts)))
    more = tuple(np.concatenate(a) for a in zip(*(_unpack(p, _MORE) for p in parts)))
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    rest = hot + np.flatnonzero(keys[hot:] == keys[:-hot])
    return _pack(number, (keys, ids, shares[order]), more, (keys[rest], ids[rest]))


def _codes(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<u4")


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """Share of word pairs that two texts, arrays of codes, have in common (of words, where one is shorter than two)."""
    return float(likenesses([x.astype("<u4").tobytes()], [y.astype("<u4").tobytes()])[0])


def likenesses(xs: list[bytes], ys: list[bytes]) -> np.ndarray:
    """The ``likeness`` of each of ``xs`` to the one of ``ys`` beside it."""
    sizes = np.array([[len(x) // 4 for x in xs], [len(y) // 4 for y in ys]], np.int64).reshape(2, -1)
    out = np.zeros(len(xs))
    for block in _blocks(sizes.sum(0), PAIR_BLOCK, 1 << 16):
        first, end = block[0], block[-1] + 1
        out[first:end] = _likenesses(np.frombuffer(b"".join(xs[first:end] + ys[first:end]), "<u4").astype(np.uint64), sizes[:, first:end])
    return out


def _likenesses(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The same for at most 65,536 pairs, whose first texts and then second texts stand in ``flat``.

    What a text is made of becomes numbers of the pair (16 bits), a hash (47 bits) and the side, so
    that one sort brings together what the two have in common.
    """
    count = sizes.shape[1]
    by_words = np.tile(sizes.min(0) < 2, 2)
    sizes = sizes.ravel()
    owner = np.repeat(np.arange(2 * count), sizes)
    of_words = by_words[owner]
    made = flat << np.uint64(32)
    made[:-1] |= np.where(of_words[:-1], 0, flat[1:]).astype(np.uint64)
    kept = np.ones(len(flat), bool)
    kept[(np.cumsum(sizes) - 1)[(sizes > 0) & ~by_words]] = False  # no word follows
    made, owner = made[kept], owner[kept]
    made = (made ^ (made >> np.uint64(29))) * _MULTIPLIER
    made = np.sort(((owner % count).astype(np.uint64) << np.uint64(48)) | (made >> np.uint64(17) << np.uint64(1)) | (owner >= count).astype(np.uint64))
    total = np.bincount(owner % count, minlength=count)
    if not len(made):
        return np.zeros(count)
    bare = made >> np.uint64(1)
    begin = np.flatnonzero(np.append(True, bare[1:] != bare[:-1]))
    second = np.add.reduceat((made & np.uint64(1)).astype(np.int64), begin)
    common = np.minimum(second, np.diff(np.append(begin, len(made))) - second)
    return 2 * np.bincount((made[begin] >> np.uint64(48)).astype(np.int64), common, count) / np.maximum(total, 1)


class History:
    """The accepted records as suffix segments in the shared folder.

    ``records`` holds the ``records_of`` everything that is or will be added; of it only the records
    of pairs that are compared are looked at again.
    """

    def __init__(self, records: DataFrame):
        self.spark: SparkSession = records.sparkSession
        self.records = records
        self.path = f"{shared_dir(self.spark)}/history-{uuid.uuid4().hex}"
        self.database = f"history_{uuid.uuid4().hex}"
        self.spark.sql(f"CREATE DATABASE {self.database} LOCATION '{self.path}/segments'")
        self.segments: list[tuple[int, str]] = []  # (places, table); they hold cases, too, which are left out of pairs
        self.cases = self.spark.createDataFrame([], "kept_id long, chunk_id long")
        self.made = 0
        n = records.count()
        self.buckets = max(2, -(-n * 40 // BUCKET_PLACES))
        self.fences = self._lay_fences(min(1.0, FENCE_RECORDS / max(n, 1)))

    def _lay_fences(self, share: float) -> np.ndarray:
        """Keys that cut the suffixes into about equal ranges.  A key so common that it fills several ranges is several fences."""

        def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keys, owners, _ = suffixes([_codes(c) for c in batch["codes"]])
                lot = pd.Series((keys * _MULTIPLIER) >> np.uint64(20))
                yield pd.DataFrame({"key": keys[(lot.groupby(owners).rank(method="first") <= 8).to_numpy()].view(np.int64)})

        keys = np.sort(self.records.sample(share, seed=7).mapInPandas(some, "key long").toPandas()["key"].to_numpy(np.int64).view(np.uint64))
        ranges = 4 * self.buckets
        return keys[np.arange(1, ranges) * len(keys) // ranges] if len(keys) else np.zeros(0, np.uint64)

    def _new(self) -> str:
        self.made += 1
        return f"{self.path}/{self.made}"

    def _write(self, df: DataFrame) -> DataFrame:
        path = self._new()
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Deletes everything but the cases."""
        self.spark.sql(f"DROP DATABASE IF EXISTS {self.database} CASCADE")
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    # --- segments ------------------------------------------------------------------------------

    def _save(self, blocks: DataFrame) -> str:
        name = f"{self.database}.segment_{uuid.uuid4().hex}"
        blocks.write.bucketBy(self.buckets, "range").option("compression", "zstd").saveAsTable(name)
        return name

    def _segment(self, records: DataFrame) -> str:
        """The suffix array of ``records``.

        Suffixes whose key is several fences are dealt to all the ranges between; that they may
        look for each other, each is added to the other ranges as one that only looks (``more``).
        """
        fences = self.fences

        def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                keys, owners, shares = suffixes([_codes(c) for c in batch["codes"]])
                ids = batch["id"].to_numpy(np.int64)[owners]
                low, high = np.searchsorted(fences, keys, "left"), np.searchsorted(fences, keys, "right")
                own = low + ids % (high - low + 1)
                wide = np.flatnonzero(high > low)
                spread = np.repeat(wide, (high - low + 1)[wide])
                to = low[spread] + np.arange(len(spread)) - np.repeat(np.cumsum((high - low + 1)[wide]) - (high - low + 1)[wide], (high - low + 1)[wide])
                spread, to = spread[to != own[spread]], to[to != own[spread]]
                entries, more = _cut(own), _cut(to)
                nothing = np.zeros(0, np.int64)
                rows = []
                for number in entries.keys() | more.keys():
                    e, m = entries.get(number, nothing), spread[more.get(number, nothing)]
                    rows.append(_pack(number, (keys[e], ids[e], shares[e]), (keys[m], ids[m], shares[m])))
                yield pd.DataFrame(rows, columns=_names(_BLOCK))

        def merge(key: tuple, parts: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame([_join_blocks(int(key[0]), list(parts.itertuples()), HOT)], columns=_names(_BLOCK))

        made = records.select("id", "codes").mapInPandas(make, _BLOCK)
        return self._save(made.repartition(self.buckets, "range").groupBy("range").applyInPandas(merge, _BLOCK))

    def _beside(self, rows: DataFrame, tables: list[str], columns: tuple) -> DataFrame:
        """``rows``, of one ``range`` each, with the blocks of that range in the segments ``tables``: ``columns`` ending in 0, 1, ...; one task reads what a bucket has in all of them."""
        for k, name in enumerate(tables):
            theirs = self.spark.table(name).select("range", *(F.col(c).alias(f"{c}{k}") for c in columns))
            rows = rows.join(theirs.hint("shuffle_hash"), "range", "left")
        return rows

    def _push(self, name: str, size: int) -> None:
        """Adds a segment of ``size`` suffixes, merged with those before it that are less than twice as large."""
        names = [name]
        while self.segments and self.segments[-1][0] < 2 * size:
            old_size, old = self.segments.pop()
            names, size = [*names, old], size + old_size
        if len(names) > 1:

            def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for batch in batches:
                    rows = []
                    for row in batch.itertuples():
                        blocks = [[getattr(row, f"{c}{k}") for c in ("keys", "ids", "shares")] for k in range(len(names))]
                        blocks = [_Entries(*block) for block in blocks if block[0] is not None]
                        rows += [_join_blocks(row.range, blocks, HOT)] if blocks else []
                    yield pd.DataFrame(rows, columns=_names(_BLOCK))

            ranges = self.spark.range(len(self.fences) + 1).select(F.col("id").cast("int").alias("range")).repartition(self.buckets, "range")
            name = self._save(self._beside(ranges, names, ("keys", "ids", "shares")).mapInPandas(merge, _BLOCK))
            for old in names:
                self.spark.sql(f"DROP TABLE {old}")
        self.segments.append((size, name))

    # --- matches -------------------------------------------------------------------------------

    def _look_up(self, batch: str, groups: int) -> DataFrame:
        """The matches of a batch's suffixes with its own and every segment's, found by binary search, packed by groups of the batch's records.

        Of more than ``HOT`` equal suffixes of a segment only the lowest ids come, and how many there are.
        """
        others = [name for _, name in self.segments]
        mine = self.spark.table(batch).drop("size", "rest_keys", "rest_ids")

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for blocks in batches:
                for row in blocks.itertuples():
                    keys, ids, shares = (np.concatenate(a) for a in zip(_unpack(row), _unpack(row, _MORE)))
                    group = _group(ids, groups)
                    for number_of, inside in (("", True), *((str(k), False) for k in range(len(others)))):
                        if getattr(row, f"keys{number_of}") is None:
                            continue
                        old_keys, old_ids = _unpack(row, (f"keys{number_of}", f"ids{number_of}"))
                        low, high = np.searchsorted(old_keys, keys, "left"), np.searchsorted(old_keys, keys, "right")
                        n = high - low
                        who, at = _spread(low, np.minimum(n, HOT))
                        lower = old_ids[at] < ids[who]
                        who, at = who[lower], at[lower]
                        hot = np.flatnonzero(n > HOT)
                        cold_of, hot_of, nothing, rows = _cut(group[who]), _cut(group[hot]), np.zeros(0, np.int64), []
                        for number in cold_of.keys() | hot_of.keys():
                            c, h = cold_of.get(number, nothing), hot[hot_of.get(number, nothing)]
                            cold = (ids[who[c]], old_ids[at[c]], shares[who[c]])
                            common = (ids[h], keys[h], shares[h], n[h])
                            rows.append((number, inside, row.range, *(x.astype(t).tobytes() for x, t in zip((*cold, *common), ("<i8", "<i8", "<u2", "<i8", "<u8", "<u2", "<i8")))))
                        yield pd.DataFrame(rows, columns=_names(_FOUND))

        return self._beside(mine, others, ("keys", "ids")).mapInPandas(search, _FOUND)

    def _look_up_rest(self, wanted: DataFrame, batch: str, groups: int) -> DataFrame:
        """What ``_look_up`` left out for the suffixes ``wanted`` (``id``, ``key``, ``range``, ``share``, ``bound``), as far as it is below the bound, packed by groups of pairs."""
        columns = ("id", "key", "share", "bound")
        asked = wanted.repartition(self.buckets, "range").groupBy("range").agg(F.collect_list(F.struct(*columns)).alias("asked")).select("range", *(F.col(f"asked.{c}").alias(c) for c in columns))
        tables = [batch] + [name for _, name in self.segments]

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for blocks in batches:
                for row in blocks.itertuples():
                    ids, keys, shares, bounds = (np.asarray(a, np.int64) for a in (row.id, row.key, row.share, row.bound))
                    for k in range(len(tables)):
                        if not getattr(row, f"rest_keys{k}"):
                            continue
                        old_keys, old_ids = _unpack(row, (f"rest_keys{k}", f"rest_ids{k}"))
                        low = np.searchsorted(old_keys, keys.view(np.uint64), "left")
                        n = np.searchsorted(old_keys, keys.view(np.uint64), "right") - low
                        for part in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(np.cumsum(n) // 1_000_000)) + 1):
                            who, at = _spread(low[part], n[part])
                            below = old_ids[at] < bounds[part][who]
                            who, at = who[below], at[below]
                            yield _pack_pairs(ids[part][who], old_ids[at], shares[part][who], k == 0, groups)

        return self._beside(asked, tables, ("rest_keys", "rest_ids")).mapInPandas(search, _PAIRS)

    def _alike(self, pairs: DataFrame, records: DataFrame) -> DataFrame:
        """Those of ``pairs`` (written: ``kept_id``, ``id`` of one of ``records``, ``inside``) whose texts are alike."""
        few = pairs.limit(BROADCAST_PAIRS + 1).count() <= BROADCAST_PAIRS
        sent = F.broadcast(pairs) if few else pairs
        kept = self.records.select(F.col("id").alias("kept_id"), F.col("codes").alias("kept_codes")).join(sent, "kept_id")
        ids = pairs.select("id").distinct()
        both = kept.join(records.select("id", "codes").join(F.broadcast(ids) if few else ids, "id", "left_semi").hint("shuffle_hash"), "id")

        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                like = likenesses(batch["kept_codes"].tolist(), batch["codes"].tolist()) >= LEAST_LIKE
                yield batch.loc[like, ["kept_id", "id", "inside"]]

        return both.select("kept_id", "kept_codes", "id", "codes", "inside").mapInPandas(compare, "kept_id long, id long, inside boolean")

    def _repeats(self, records: DataFrame, batch: str, size: int) -> DataFrame:
        """``(kept_id, id, inside)`` of every one of ``records``, whose segment ``batch`` has ``size`` suffixes, that is like a lower record of the history or of its own batch (``inside``).

        Two records are compared if the matches between them cover ``LEAST_COVER`` of the new one, common
        suffixes, whose matches are not all known at first, included (``_weigh``).  Of a record that is like one of
        the history, pairs above the lowest of those can be missing: it is a case of that one or of a lower one.
        """
        packed = self._look_up(batch, max(2, -(-size // GROUP_PLACES)))
        weighed = self._write(packed.groupBy("group").applyInPandas(_weigh, _WEIGHED))
        cases = self.cases.select(F.col("chunk_id").alias("kept_id"))
        pairs = weighed.filter("kind = 'pair'").select("kept_id", "id", "inside")
        counts = {row.kind: row.n for row in weighed.filter("kind != 'pair'").groupBy("kind").agg(F.sum("n").alias("n")).collect()}  # at most two rows
        to_come = counts.get("wanted", 0)
        if not to_come:
            return self._alike(pairs, records).join(cases, "kept_id", "left_anti")
        wanted = weighed.filter("kind = 'wanted'").select("id", "key", "range", "share", "missing")
        like = None
        if to_come <= REST_AT_ONCE:
            wanted = wanted.withColumn("bound", F.col("id"))
        else:
            like = self._write(self._alike(pairs, records).join(cases, "kept_id", "left_anti"))
            bounds = like.filter("not inside").groupBy("id").agg(F.min("kept_id").alias("bound"))
            wanted = self._write(wanted.join(bounds, "id", "left").withColumn("bound", F.coalesce("bound", "id")))
        groups = max(2, -(-(to_come + counts.get("share", 0)) // GROUP_MATCHES))

        def regroup(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for blocks in batches:
                for row in blocks.itertuples():
                    ids, kept, shares, inside = _unpack(row, ("ids", "kept_ids", "shares", "insides"), ("<i8", "<i8", "<i4", "?"))
                    for where in (False, True):
                        which = inside == where
                        yield _pack_pairs(ids[which], kept[which], shares[which], where, groups)

        shares = weighed.filter("kind = 'share'").select("ids", "kept_ids", "shares", "insides").mapInPandas(regroup, _PAIRS)
        rest = self._look_up_rest(wanted, batch, groups).unionByName(shares).groupBy("group").applyInPandas(_add_up, "kept_id long, id long, share int, inside boolean")
        rest = rest.join(wanted.groupBy("id").agg(F.max("bound").alias("bound"), F.max("missing").alias("missing")), "id")
        rest = rest.filter((F.col("share") >= _NEED - F.col("missing")) & (F.col("kept_id") < F.col("bound"))).select("kept_id", "id", "inside")
        if like is None:
            return self._alike(self._write(pairs.unionByName(rest).distinct()), records).join(cases, "kept_id", "left_anti")
        rest = self._write(rest.join(pairs, ["kept_id", "id"], "left_anti"))
        return like.unionByName(self._alike(rest, records).join(cases, "kept_id", "left_anti"))

    @staticmethod
    def _together(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    # --- batches -------------------------------------------------------------------------------

    def add_batch(self, records: DataFrame, accept_all: bool = False) -> None:
        """Adds a batch.  With ``accept_all`` all of it is accepted; else its cases join ``self.cases``, ``(kept_id, chunk_id)``.

        A record is a case if it is like an accepted record; of several the lowest id counts.
        Records of the batch are decided in order of id, in rounds: what has no undecided lower
        like is accepted, which makes cases of the higher ones like it.  Of copies within the batch the lowest
        stands for all.
        """
        repeated = records.groupBy("whole", "whole2").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
        copies = self._write(records.select("id", "whole", "whole2").join(repeated, ["whole", "whole2"]).filter("id != first").select("id", "first"))
        batch = self._segment(records.join(copies, "id", "left_anti"))
        size = self.spark.table(batch).agg(F.sum("size")).first()[0] or 0
        if not accept_all:
            new = self._decide(self._write(self._repeats(records, batch, size)))
            again = copies.join(new.withColumnRenamed("chunk_id", "first"), "first", "left").select(F.coalesce("kept_id", "first").alias("kept_id"), F.col("id").alias("chunk_id"))
            self.cases = self._write(self._together([self.cases, new, again]))
        self._push(batch, size)

    def _decide(self, pairs: DataFrame) -> DataFrame:
        cases = pairs.filter("not inside").groupBy("id").agg(F.min("kept_id").alias("kept_id")).select("kept_id", F.col("id").alias("chunk_id"))
        open_, done = pairs.filter("inside"), cases.select(F.col("chunk_id").alias("id"))
        while True:
            open_ = self._write(open_.join(done, "id", "left_anti").join(done.withColumnRenamed("id", "kept_id"), "kept_id", "left_anti"))
            if open_.isEmpty():
                return cases
            upper = open_.select(F.col("id").alias("kept_id")).distinct()
            first = open_.join(upper, "kept_id", "left_anti")  # their lower ends are accepted
            new = self._write(first.groupBy("id").agg(F.min("kept_id").alias("kept_id")).select("kept_id", F.col("id").alias("chunk_id")))
            cases, done = cases.unionByName(new), new.select(F.col("chunk_id").alias("id"))


def _spread(low: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ``n`` places from ``low`` on, whose it is and where it is."""
    who = np.repeat(np.arange(len(low)), n)
    return who, np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + low[who]


def _pack_pairs(ids: np.ndarray, kept_ids: np.ndarray, shares: np.ndarray, inside: bool, groups: int) -> pd.DataFrame:
    """Matches of pairs of records as a row for each group.  A pair is always in the same group; the pairs of one record are in any."""
    of = _group(ids * np.int64(31) + kept_ids, groups)
    rows = [(number, inside, ids[k].astype("<i8").tobytes(), kept_ids[k].astype("<i8").tobytes(), shares[k].astype("<i4").tobytes()) for number, k in _cut(of).items()]
    return pd.DataFrame(rows, columns=_names(_PAIRS))


def _sums(ids: np.ndarray, kept: np.ndarray, shares: np.ndarray, inside: np.ndarray) -> pd.DataFrame:
    """The share of each pair of records that its matches add up to."""
    order = np.lexsort((kept, ids))
    ids, kept, shares, inside = ids[order], kept[order], shares[order], inside[order]
    begin = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]) | (kept[1:] != kept[:-1]))) if len(ids) else np.zeros(0, np.int64)
    return pd.DataFrame({"id": ids[begin], "kept_id": kept[begin], "share": np.add.reduceat(shares, begin) if len(begin) else begin, "inside": inside[begin]})


def _add_up(found: pd.DataFrame) -> pd.DataFrame:
    """The pairs of a group whose matches cover half of what is needed."""
    rows = list(found.itertuples())
    parts = [_unpack(r, ("ids", "kept_ids", "shares"), ("<i8", "<i8", "<i4")) for r in rows]
    ids, kept, shares = (np.concatenate([p[k] for p in parts]).astype(np.int64) for k in range(3))
    pairs = _sums(ids, kept, shares, np.repeat([r.inside for r in rows], [len(p[0]) for p in parts]))
    return pairs.loc[pairs["share"] >= _NEED // 2, ["kept_id", "id", "share", "inside"]]


def _weigh(found: pd.DataFrame) -> pd.DataFrame:
    """What the matches of a group of records come to, as rows of several kinds.

    A ``pair`` is to be compared: matches cover enough of it, or would, if all common suffixes of
    the record were matches, too, provided these are less than half of what is needed.  Where they are more,
    those ``wanted`` are to be looked up in full: all but the commonest, which together (``missing``)
    stay under that half.  For these records the other pairs' shares come as well (one ``share``, packed).
    """
    rows = list(found.itertuples())
    cold = [(*_unpack(r, ("ids", "kept_ids", "shares"), ("<i8", "<i8", "<u2")), r.inside) for r in rows]
    ids, kept, shares = (np.concatenate([c[k] for c in cold]).astype(np.int64) for k in range(3))
    inside = np.repeat([c[3] for c in cold], [len(c[0]) for c in cold])
    pairs = _sums(ids, kept, shares, inside)

    hot = [(*_unpack(r, ("hot_ids", "hot_keys", "hot_shares", "hot_n"), ("<i8", "<u8", "<u2", "<i8")), r.range) for r in rows]
    common = pd.DataFrame({"id": np.concatenate([h[0] for h in hot]), "key": np.concatenate([h[1] for h in hot]).view(np.int64), "share": np.concatenate([h[2] for h in hot]).astype(np.int64), "n": np.concatenate([h[3] for h in hot]), "range": np.repeat([h[4] for h in hot], [len(h[0]) for h in hot])})
    keys = common.groupby(["id", "key"], as_index=False).agg(share=("share", "max"), n=("n", "sum")).sort_values(["id", "n", "key"], ascending=[True, False, True])
    keys["common"] = keys.groupby("id")["share"].transform("sum")
    keys["left_out"] = keys.groupby("id")["share"].cumsum()
    keys["missing"] = keys["left_out"].where(keys["left_out"] < _NEED // 2, 0).groupby(keys["id"]).transform("max")
    heavy = keys[keys["common"] >= _NEED // 2]

    lacks = _NEED - pairs["id"].map(keys.drop_duplicates("id").set_index("id")["common"]).fillna(0)
    is_heavy = pairs["id"].isin(heavy["id"])
    chosen = pairs["share"] >= lacks.where(~is_heavy, _NEED)
    wanted = heavy.loc[heavy["left_out"] >= _NEED // 2, ["id", "key", "share", "missing"]].merge(common[["id", "key", "range", "n"]].drop_duplicates(["id", "key", "range"]), on=["id", "key"])
    share = pairs[is_heavy]
    packed = {"ids": share["id"].to_numpy("<i8"), "kept_ids": share["kept_id"].to_numpy("<i8"), "shares": share["share"].to_numpy("<i4"), "insides": share["inside"].to_numpy(bool)}
    share = pd.DataFrame([{"kind": "share", "n": len(share), **{name: a.tobytes() for name, a in packed.items()}}])
    kinds = {"kept_id": "Int64", "share": "Int32", "key": "Int64", "range": "Int32", "missing": "Int32", "n": "Int64", "inside": "boolean", **dict.fromkeys(packed, "object")}
    parts = [pairs[chosen].assign(kind="pair"), wanted.assign(kind="wanted"), share]
    parts = [part.assign(**{name: None for name in kinds if name not in part}).astype(kinds) for part in parts]  # before they are joined: keys are no floats
    return pd.concat(parts)[_names(_WEIGHED)]


class _Entries(NamedTuple):
    """A block's entries, without any that only look."""

    keys: bytes
    ids: bytes
    shares: bytes
    more_keys: bytes = b""
    more_ids: bytes = b""
    more_shares: bytes = b""


def found(chunks: DataFrame) -> DataFrame:
    """``(kept_id, chunk_id)``: the chunks of batch 1 and later that repeat an accepted chunk.

    ``chunks`` has ``id``, ``batch_no`` and ``content``; batch 0 is the accepted history.  The
    stored ``content_hash`` and ``anchor_id`` can be missing or stale and give way to the content,
    whose equality they stand for.  Rows without id or batch are left out; null and empty contents
    repeat nothing; a row repeated under its own id is no case of itself; without chunks there is no row.
    """
    spark = chunks.sparkSession
    rows = chunks.select(F.col("id").cast("long").alias("id"), F.col("batch_no").cast("int").alias("batch_no"), "content").filter("id is not null and batch_no is not null and content is not null")
    path = f"{shared_dir(spark)}/history-{uuid.uuid4().hex}"
    records_of(rows).write.partitionBy("batch_no").option("compression", "zstd").parquet(f"{path}/records")
    records = spark.read.schema(_RECORD).parquet(f"{path}/records")
    number = F.col("batch_no")
    batches = sorted(row.batch_no for row in records.select("batch_no").distinct().collect())  # a row for each batch
    history = History(records)
    try:
        for batch in batches:
            history.add_batch(records.filter(number == batch), accept_all=batch <= 0)
        history.cases.write.parquet(f"{path}/cases")
    finally:
        history.close()
    return spark.read.schema("kept_id long, chunk_id long").parquet(f"{path}/cases")
