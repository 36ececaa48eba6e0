"""Mapping freely typed values to the entries of a canonical list (problem 2).

A multi-pattern automaton over the canonical names, their aliases and regular variants of both
finds mentions inside each normalised value; the longest non-overlapping mention wins.  What the
automaton leaves over goes to a similarity of token sets that tolerates misspelt tokens.  Every
task keeps the answers for values it has seen, so a value that fills a third of the rows costs one
lookup per row and no shuffle.
"""

import re
import unicodedata
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Values a task remembers; beyond that it forgets all and goes on (results do not change).
REMEMBERED_VALUES = 200_000
#: The canonical list is sent to every task; a longer list than this is refused.
MOST_CANONICAL = 100_000
#: Lowest token-set similarity of a match.
LEAST_SIMILARITY = 0.7

# Letters of other scripts that look like Latin ones, and digits and signs typed for letters.
LOOKALIKES = str.maketrans("аеорсухіјѕԁһкмтвнαεοριυκντβηγ", "aeopcyxijsdhkmtbhaeopiukvtbny")
DIGITS_FOR_LETTERS = str.maketrans("013457@$", "oieastas")
#: Words that carry no meaning of their own in a predicate.
FILLERS = {"is", "was", "are", "were", "be", "been", "being", "has", "have", "had", "rel", "relation", "pred", "predicate", "the", "a", "an", "also", "again", "twice"}
#: Words of negation: a mention right after one means the opposite, unless the canonical form has the word itself.
NEGATIONS = {"not", "never", "non", "no", "cannot"}
#: Endings by which a verb's root is inflected or made a noun.
ENDINGS = ("", "e", "s", "es", "ed", "ing", "ion", "ation", "ment", "er", "en", "ten")
#: Small words typed in place of each other.
LINKS = {"to": ("to", "into", "onto", "with"), "in": ("in", "inside", "inside of", "within", "into"), "on": ("on", "onto", "upon"), "with": ("with", "using", "via"), "by": ("by", "through"), "through": ("through", "thru", "via", "by")}
#: Common abbreviations that are no prefix of the word they stand for, and other spellings.
SPELLINGS = {"configured": ("cfg", "cfgd"), "documented": ("docs",), "requires": ("reqs",), "maintained": ("mnt", "mtd"), "licensed": ("licence", "licenced", "licencing"), "deployed": ("dpl",), "authenticates": ("authn",)}
_FORMAT_CHARS = re.compile(r"[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def words(value: str) -> list[str]:
    """The lower-case Latin words of ``value``, whatever its case, script look-alikes, accents, digits for letters and joiners."""
    value = _FORMAT_CHARS.sub("", unicodedata.normalize("NFKC", value))
    value = _CAMEL.sub(" ", value) if not value.isupper() else value
    value = unicodedata.normalize("NFD", value.casefold()).translate(LOOKALIKES)
    value = "".join(c for c in value if not unicodedata.combining(c))
    tokens = re.findall(r"[^\W_]+|[@$]", value) if not re.search(r"[@$]", value) else re.findall(r"[^\W_@$]*[@$]?[^\W_]+[@$]?", value)
    out = []
    for token in tokens:
        if not token.isdigit() and any(c.isalpha() for c in token):
            token = token.translate(DIGITS_FOR_LETTERS)
        out.append(token)
    return out


def edits(a: str, b: str, most: int) -> int:
    """Edit distance of ``a`` and ``b`` where a swap of neighbours counts once; ``most + 1`` if it is more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    above, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above2, above, row = above, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(above[j] + 1, row[j - 1] + 1, above[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, above2[j - 2] + 1)
            row.append(cost)
        if min(row) > most:
            return most + 1
    return row[-1]


def variants(name: str) -> set[str]:
    """Regular variants of a canonical name: inflections, nouns, abbreviations and other small words."""
    head, *rest = words(name)
    root = re.sub(r"(?:ed|es|s|e)$", "", head) if len(head) > 4 else head
    heads = {head, root} | {root + ending for ending in ENDINGS}
    if root.endswith("uc"):
        heads.add(root + "tion")
    if root.endswith("i") or root.endswith("ibl") or head.endswith("ible"):
        heads.add(re.sub(r"ible$", "ibility", head))
    heads |= {head[:n] for n in range(4, len(head))} | set(SPELLINGS.get(head, ()))
    ends = [""]
    for word in rest:
        ends = [f"{end} {link}" for end in ends for link in LINKS.get(word, (word,))]
    forms = {h + end for h in heads for end in ends}
    if not rest:  # such a name's noun takes a small word: support for, cause of
        forms |= {h + link for h in (root, root + "e", root + "ment", root + "ement", root + "ation", root + "er") for link in (" for", " of")}
    if head[:2] in ("in", "un") and len(head) > 6:
        forms |= {f"not {h[2:]}{end}" for h in heads if len(h) > 6 for end in ends}
    if rest == ["a"]:
        forms = {name.replace("_", " "), "is an", "isa", "is a"}
    if rest == ["by"] and root != head:
        forms.add(root + "er")
    return forms


class Canon:
    """The canonical list, ready to look values up in."""

    def __init__(self, entries: Iterable[tuple[int, str, list[str] | None]]):
        entries = sorted(entries)
        self.forms: dict[str, int] = {}
        firm = [(" ".join(words(form)), i) for i, name, aliases in entries for form in [name, *(aliases or [])] if form]
        firm += [(" ".join(w for w in form.split() if w not in FILLERS), i) for form, i in firm if len(form.split()) > 2]
        loose = [(form, i) for i, name, _ in entries if name and words(name) for form in sorted(variants(name))]
        for form, i in firm + loose:
            if form:
                self.forms.setdefault(form, i)
        self.compact = {}
        for form, i in self.forms.items():
            self.compact.setdefault(form.replace(" ", ""), i)
        self.automaton = ahocorasick.Automaton()
        for form, i in self.forms.items():
            self.automaton.add_word(f" {form} ", (len(form), i, form))
        if self.forms:
            self.automaton.make_automaton()
        self.listed = list(self.forms)
        self.joined = [form.replace(" ", "") for form in self.listed]
        self.bags = np.array([self.bag(form) for form in self.listed], np.int16).reshape(-1, 27)
        self.lengths = self.bags.sum(1)

    @staticmethod
    def bag(text: str) -> list[int]:
        counts = [0] * 27
        for c in text:
            if c != " ":
                counts[ord(c) - 97 if "a" <= c <= "z" else 26] += 1
        return counts

    def mention(self, tokens: list[str]) -> tuple[int, int] | None:
        """Length and entry of the longest mention (then the first) among those that don't overlap a longer one."""
        text = f" {' '.join(tokens)} "
        best = None
        for end, (length, i, form) in self.automaton.iter(text):
            before = text[: end - length - 1].split()
            if before and before[-1] in NEGATIONS:
                continue
            if form in ("is a", "is an") and len(tokens) > 2:
                continue
            if best is None or length > best[0]:
                best = length, i
        return best

    def similar(self, tokens: list[str]) -> int | None:
        """The entry whose form's token set is most like ``tokens``, if it is like enough."""
        joined = "".join(tokens)
        bag = np.array(self.bag(joined), np.int16)
        # each edit changes the bags of letters by two at most, so no form that this leaves out can be like enough
        wholes = np.maximum(self.lengths, len(joined))
        allowed = ((1 - LEAST_SIMILARITY) * wholes).astype(np.int16)
        near = np.nonzero(np.abs(self.lengths - len(joined)) <= allowed)[0]
        difference = self.bags[near] - bag
        least = np.maximum(np.maximum(difference, 0).sum(1), np.maximum(-difference, 0).sum(1))
        kept = least <= allowed[near]
        near, bound = near[kept], 1 - least[kept] / wholes[near[kept]]
        best = (0.0, 0)
        for k in np.argsort(-bound, kind="stable").tolist():
            if bound[k] < best[0]:
                break  # nor can any of the rest be more like it than what was found
            form = self.listed[near[k]]
            whole = int(wholes[near[k]])
            most = min(int(allowed[near[k]]), int((1 - best[0]) * whole))
            cost = edits(joined, self.joined[near[k]], most)
            if cost > 1 and len(tokens) > 1 and " " in form:
                cost = min(cost, token_set_cost(tokens, form.split(), most))
            score = 1 - cost / whole
            if cost <= most and (score, -self.forms[form]) > best:
                best = score, -self.forms[form]
        return -best[1] if best[0] >= LEAST_SIMILARITY else None

    def find(self, value: str) -> int:
        """The id of the entry that ``value`` means, or -1."""
        tokens = words(value)
        if not self.forms or not any(c.isalpha() for c in value):
            return -1
        mention = self.mention(tokens)
        if mention and mention[0] == len(" ".join(tokens)):
            return mention[1]
        joined = self.compact.get("".join(tokens))  # written as one word, or with other breaks
        if joined is not None:
            return joined
        if mention:
            return mention[1]
        if tokens[0] in NEGATIONS and not any(form.startswith(f"{tokens[0]} ") for form in self.forms):
            return -1
        kept = [t for t in tokens if t not in FILLERS and not (len(t) > 5 and t.endswith("ly"))]
        if not kept:
            return -1
        found = self.similar(kept)
        return -1 if found is None else found


def token_set_cost(tokens: list[str], form: list[str], most: int) -> int:
    """Edits that turn one set of tokens into the other, each token paired with its nearest."""
    left, cost = list(tokens), 0
    for word in sorted(form, key=len, reverse=True):
        near = min(left, key=lambda t: edits(t, word, most), default=None)
        if near is None:
            cost += len(word)
        else:
            cost += min(edits(near, word, most), len(word) + len(near))
            left.remove(near)
        if cost > most:
            return most + 1
    return cost + sum(map(len, left))


def map_to_canonical(rows: DataFrame, canonical: DataFrame, id_col: str = "id", value_col: str = "predicate") -> DataFrame:
    """``(fact_id, value, received_at, predicate_id)`` of every row whose value is neither blank nor character for character a canonical name.

    A fact's rows also keep ``received_at``, null where ``rows`` has none.  ``canonical`` has ``predicate_id``, ``name``, ``aliases``; it goes whole to every task and may
    have at most ``MOST_CANONICAL`` rows.  ``predicate_id`` is -1 where no entry is meant.  Null
    and blank (spaces or tabs) values give no row; repeated rows give repeated rows; an empty list
    gives -1 throughout.
    """
    listed = canonical.select("predicate_id", "name", "aliases").limit(MOST_CANONICAL + 1).collect()
    if len(listed) > MOST_CANONICAL:
        raise ValueError(f"the canonical list has more than {MOST_CANONICAL} entries")
    entries = [(row.predicate_id, row.name or "", list(row.aliases or [])) for row in listed]
    names = {name for _, name, _ in entries}
    shipped = rows.sparkSession.sparkContext.broadcast(entries)

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon = Canon(shipped.value)
        known: dict[str, int] = {}
        for batch in batches:
            values = batch["value"]
            if len(known) > REMEMBERED_VALUES:
                known.clear()
            for value in values.unique():
                if value not in known:
                    known[value] = canon.find(value)
            yield batch.assign(predicate_id=values.map(known).astype("int64"))

    value = F.col("value")
    free = rows.select(F.col(id_col).cast("long").alias("fact_id"), F.col(value_col).alias("value"), (F.col("received_at") if "received_at" in rows.columns else F.lit(None)).cast("timestamp").alias("received_at"))
    free = free.filter(value.isNotNull() & ~value.rlike(r"^[ \t]*\z") & ~value.isin(*names) if names else value.isNotNull() & ~value.rlike(r"^[ \t]*\z"))
    return free.mapInPandas(look_up, "fact_id long, value string, received_at timestamp, predicate_id long")


def found(rows: DataFrame, canonical: DataFrame) -> DataFrame:
    """``(fact_id, predicate_id)``: each fact once; of a fact delivered with different values, that received last counts (then the highest id)."""
    latest = F.struct(F.coalesce(F.unix_micros("received_at"), F.lit(-(2**63))).alias("at"), "predicate_id")
    return map_to_canonical(rows, canonical).groupBy("fact_id").agg(F.max_by("predicate_id", latest).alias("predicate_id"))


def unmatched_report(rows: DataFrame, canonical: DataFrame) -> DataFrame:
    """``(value, facts)``: how many facts have each value that no canonical entry accounts for."""
    mapped = map_to_canonical(rows, canonical).filter("predicate_id = -1")
    return mapped.groupBy("value").agg(F.countDistinct("fact_id").alias("facts"))
