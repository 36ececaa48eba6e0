"""Column expressions over markdown and identifiers; all of them stay in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as a regular expression class, headings, fences, backticks and identifiers.
SPACE = r"[\t\n\x0B\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
HEADING = r"(?d)^(#{1,6})[\t\n\f\r ]+(.+)\z"
FENCE, BACKTICK, IDENTIFIER = r"(?s)```.*?```", r"`([^`\n]+)`", r"[A-Za-z_][A-Za-z0-9_]*"
#: Bytes of content above which a chunk is oversized.
OVERSIZED_BYTES = 6000
#: Folders that hold no source of the project itself.
DEFAULT_IGNORE = ("node_modules", ".git", "dist", "build", "coverage", ".output", ".next", "__pycache__", ".venv", "vendor")


def trim_space(text: Column) -> Column:
    """``text`` without white space, of all scripts, at its ends."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+\z", "")


def anchor_id(source: Column, breadcrumb: Column) -> Column:
    """Identity of a place: hex SHA-256 of source and breadcrumb with a zero character between; nulls count as empty."""
    return F.sha2(F.concat(F.coalesce(source, F.lit("")), F.lit("\0"), F.coalesce(breadcrumb, F.lit(""))), 256)


def content_hash(content: Column) -> Column:
    """Identity of a content: hex SHA-256 with runs of white space as one blank; null counts as empty."""
    return F.sha2(trim_space(F.regexp_replace(F.coalesce(content, F.lit("")), r"[\t\n\f\r ]+", " ")), 256)


def is_oversized(content: Column) -> Column:
    return F.octet_length(content) > OVERSIZED_BYTES


def is_linkable(token: Column) -> Column:
    """Whether a bare word looks like an identifier: four bytes or more, and two parts by underscore or case."""
    parts = F.size(F.filter(F.split(token, "_"), lambda part: part != "")) >= 2
    return (F.octet_length(token) >= 4) & F.when(F.contains(token, F.lit("_")), parts).otherwise(token.rlike("[a-z][A-Z]|[A-Z][A-Z][a-z]"))


def link_tokens(content: Column, strict: bool = False) -> Column:
    """The distinct tokens of ``content`` that can name an entity, those between backticks first; null gives none.

    Fenced code is left out.  ``strict`` keeps only what stands between backticks.
    """
    outside = F.regexp_replace(F.coalesce(content, F.lit("")), FENCE, "\n")
    quoted = F.transform(F.regexp_extract_all(outside, F.lit(BACKTICK), 1), trim_space)
    quoted = F.filter(quoted, lambda token: token != "")
    if strict:
        return F.array_distinct(quoted)
    bare = F.regexp_extract_all(F.regexp_replace(outside, BACKTICK, " "), F.lit(IDENTIFIER), 0)
    return F.array_distinct(F.concat(quoted, F.filter(bare, is_linkable)))


def is_dependency(path: Column) -> Column:
    """Whether any part of ``path`` is a folder to ignore."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*[F.lit(name) for name in DEFAULT_IGNORE]))


def base_name(path: Column) -> Column:
    """What follows the last slash of ``path``."""
    return F.regexp_extract(path, r"[^/]*\z", 0)


def extension(path: Column) -> Column:
    """The last part of the name from its point on, or nothing."""
    return F.regexp_extract(path, r"\.[^./]*\z", 0)


def uri_path(uri: Column) -> Column:
    """The path of a ``file:`` address, with its escapes undone; other texts as they are."""
    return F.when(F.startswith(uri, F.lit("file://")), F.url_decode(F.replace(F.substr(uri, F.lit(8)), F.lit("+"), F.lit("%2B")))).otherwise(uri)


def relative_path(path: Column, root: str) -> Column:
    """``path`` seen from ``root``; as it is where it isn't below that."""
    prefix = root.rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(prefix)), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def list_of(text: str) -> list[str]:
    """The parts of a comma-separated text, trimmed, without empty ones."""
    return [part.strip() for part in (text or "").split(",") if part.strip()]


def merge_ignore(extra: list[str]) -> list[str]:
    """The default folders to ignore, then ``extra``, each once."""
    return list(dict.fromkeys([*DEFAULT_IGNORE, *extra]))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine of two vectors, in double precision; a vector of zeros has the distance 1 to all."""

    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return 1 - F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def hit_text(rank: Column, score: Column, source: Column, first: Column, last: Column, breadcrumb: Column, content: Column) -> Column:
    """A search hit as markdown; of a content beyond 500 bytes the whole characters within them and three dots.  Nulls are empty."""
    raw = F.encode(content, "UTF-8")
    kept = F.lit(497)
    for end in (498, 499, 500):  # up to the last place within the limit before which a character begins
        kept = F.when(F.hex(F.substring(raw, end + 1, 1)).between("80", "BF"), kept).otherwise(F.lit(end))
    shown = F.when(F.octet_length(content) > 500, F.concat(F.decode(raw.substr(F.lit(1), kept), "UTF-8"), F.lit("..."))).otherwise(content)
    parts = [F.coalesce(part.cast("string"), F.lit("")) for part in (source, first, last, breadcrumb, shown)]
    head = F.format_string("### Result %d (score: %.4f)\n", rank.cast("int"), score.cast("double"))
    return F.concat(head, F.format_string("**Source:** %s (lines %s–%s)\n**Breadcrumb:** %s\n\n%s\n\n---\n\n", *parts))
