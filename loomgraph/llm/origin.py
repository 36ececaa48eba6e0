"""Source files that nobody wrote by hand in their project (problem 1): generated, minified, built, vendored, or data.

Each file is lexed and re-emitted in a canonical layout, one statement or brace a line.  Extreme
expansion against the original layout marks minified text; one statement shape repeated throughout
marks generated text; dominance of literals marks data saved as code.  What the layout leaves open, as it can't tell a
copy of ordinary source, is decided by a note of origin at the head of the file, then by its place (a vendor or build folder).
"""

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.lexing import Token, language_of, lex

#: Folders of other people's code, and of what tools make.
VENDOR_DIRS = frozenset("vendor vendored _vendor third_party third-party thirdparty 3rdparty 3rd_party extern external externals node_modules bower_components jspm_packages web_modules site-packages dist-packages .venv venv virtualenv deps godeps pods carthage .yarn".split())
BUILT_DIRS = frozenset("dist build out .output .next .nuxt .svelte-kit .angular .parcel-cache .turbo .cache .docusaurus _build target coverage htmlcov .nyc_output storybook-static __pycache__".split())
GENERATED_DIRS = frozenset("gen generated _generated __generated__ autogen auto-generated .generated codegen-out openapi-client".split())
#: How a note of origin begins, at the beginning of a line of the comments before the first code.
GENERATED_NOTE = re.compile(
    r"(?:@generated\b|<auto-?generated|(?:this (?:file|code|module|source) (?:was|is|has been) )?auto(?:matically)?[- ]?(?:generated|produced|created|written|built)\b|(?:this |the )?(?:file|code|source) (?:was |is |has been )?(?:auto(?:matically)? ?)?generated (?:by|from|with|using)\b|generated (?:by|from|with|using|automatically)\b|machine[- ](?:written|generated|made)\b|do not (?:touch|edit|modify|change)\b|.*\bdo not edit\W*$)",
    re.I,
)
VENDORED_NOTE = re.compile(
    r"(?:vendored\b\W|copied (?:verbatim |unchanged )?from (?:the )?[\w.@/-]+ (?:project|library|package|repo)|(?:imported|taken|copied|forked) from upstream\b|(?:this file is )?part of [\w.@/-]+,? (?:version |release |v)?\d+\.\d+|[\w.@/-]+ v?\d+\.\d+(?:\.\d+)? \| \(c\)|upstream copy\b)",
    re.I,
)
BUILT_NOTE = re.compile(r"[\w.@/-]+ v?\d+\.\d+(?:\.\d+)?\S* \| built\b|bundled by\b|webpackbootstrap|minified (?:by|with|using)\b", re.I)
#: Endings that tools give to the names of what they make.
MADE_NAME = re.compile(r"(?:\.min|\.bundle|\.chunk|\.generated|_generated|\.gen|_gen|\.g|\.pb|_pb|_pb2|_pb2_grpc|\.pb\.gw|_grpc_pb|_string|_autogen|\.designer|_packed|\.packed|-min)\.[A-Za-z]+$|\.[0-9a-f]{8,}\.(?:chunk\.)?[A-Za-z]+$")
#: A name with the version of a release, as copies of libraries have.
VERSION_NAME = re.compile(r"^[A-Za-z][\w-]*?[._-]v?\d+\.\d+\.\d+\.[A-Za-z]+$")

#: Canonical lines to original ones, and characters in a line, from which text is minified.
LEAST_EXPANSION, LEAST_WIDTH = 6.0, 150
#: Share of literals' characters among those of names and literals, and number of them, from which a file is data, if it
#: defines no functions.
LEAST_LITERALS, LEAST_DATA = 0.85, 400
#: Share of the commonest shape among a file's statements at the outermost level, and their number, from which it is generated.
LEAST_UNIFORM, LEAST_STATEMENTS = 0.8, 6
#: A file of twice as many statements is generated, too, if they are of no more shapes than this.
MOST_SHAPES = 3


def place(graph: str | None, path: str) -> str:
    """What the folders of a path inside its repository say: ``vendored``, ``built``, ``generated`` or nothing."""
    inside = path.split(f"/{graph}/", 1)[-1] if graph else path
    folders = [part.lower() for part in inside.split("/")[:-1]]
    for folder in folders:
        if folder in VENDOR_DIRS:
            return "vendored"
        if folder in BUILT_DIRS:
            return "built"
        if folder in GENERATED_DIRS:
            return "generated"
    if any(a == "static" and b in ("js", "chunks") for a, b in zip(folders, folders[1:])):
        return "built"
    return ""


def head_lines(tokens: list[Token]) -> list[str]:
    """The lines of the comments before the first code, without marks."""
    out = []
    for kind, token, _ in tokens:
        if kind == "com":
            for line in token.splitlines():
                line = re.sub(r"\s*\*+/\s*$", "", re.sub(r"^\s*(?:/\*+!?|\*+|//+!?|#+!?)?\s*", "", line)).strip()
                if line:
                    out.append(line)
        elif kind not in ("nl", "nl:", "nl@"):
            break
    return out


def note(tokens: list[Token]) -> str:
    """What the comments at the head of a file say of its origin."""
    for line in head_lines(tokens):
        if VENDORED_NOTE.match(line):
            return "vendored"
        if BUILT_NOTE.match(line):
            return "built"
        if GENERATED_NOTE.match(line):
            return "generated"
    return ""


def canonical_lines(tokens: list[Token], language: str) -> Iterator[str]:
    """The code re-emitted in a canonical layout without comments: one statement, or one brace and what it opens, a line.

    Semicolons between parentheses end no statement; in Python a colon that opens a block on its line ends one.
    """
    line: list[str] = []
    inside, block = 0, False
    for kind, token, _ in tokens:
        if kind == "com" or kind in ("in", "out"):
            continue
        if kind in ("nl", "nl:", "nl@"):
            if line and (language == "py" or not inside):
                yield " ".join(line)
                line, block = [], False
            continue
        ends = False
        if kind == "op":
            if token in ("(", "["):
                inside += 1
            elif token in (")", "]"):
                inside = max(0, inside - 1)
            elif language == "py":
                ends = not inside and (token == ";" or token == ":" and block)
            elif token == "}":
                if line:
                    yield " ".join(line)
                line, ends = [], True
            else:
                ends = token == "{" or token == ";" and not inside
        elif language == "py" and kind == "id" and not line:
            block = token in _KEPT and token not in ("import", "from", "return")
        line.append(token)
        if ends:
            yield " ".join(line)
            line = []
    if line:
        yield " ".join(line)


def layout(text: str, tokens: list[Token], language: str) -> dict[str, float]:
    """Measures of a file's layout against its canonical one, and of what it is made of."""
    real = [t for t in tokens if t[0] not in ("com", "nl", "nl:", "in", "out")]
    bodies = [line for line in text.splitlines() if line.strip()]
    canonical = max(1, sum(1 for _ in canonical_lines(tokens, language)))
    literals = sum(len(token) for kind, token, _ in real if kind in ("num", "str", "tpl"))
    names = sum(len(token) for kind, token, _ in real if kind == "id")
    shapes = Counter(statements(tokens, language))
    total = sum(shapes.values())
    return {
        "expansion": canonical / max(1, len(bodies)),
        "width": sum(map(len, bodies)) / max(1, len(bodies)),
        "literals": literals / max(1, literals + names),
        "n_literals": literals,
        "uniform": max(shapes.values(), default=0) / total if total else 0.0,
        "functions": sum(kind == "id" and token in ("function", "def", "func", "class") or kind == "op" and token == "=>" for kind, token, _ in real),
        "statements": total,
        "shapes": len(shapes),
    }


def statements(tokens: list[Token], language: str) -> Iterator[tuple]:
    """The shapes of the statements at the outermost level: their tokens with names and literals blanked."""
    depth, shape = 0, []
    if language == "py":
        indent = 0
        for kind, token, _ in tokens:
            if kind == "in":
                indent += 1
            elif kind == "out":
                indent -= 1
            elif kind in ("nl", "nl:", "nl@"):
                shape.append("/")
            elif kind != "com":
                depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(token, 0) if kind == "op" else 0
                if not indent and shape and shape[-1] == "/" and depth <= (kind == "op" and token in "([{"):
                    if shape[0] not in ("from", "import", "package"):
                        yield tuple(shape)
                    shape = []
                shape.append(_blank(kind, token))
        if shape and shape[0] not in ("from", "import"):
            yield tuple(shape)
        return
    for kind, token, _ in tokens:
        if kind == "com":
            continue
        if kind == "nl":
            if depth == 0 and shape:
                if shape[0] not in ("package", "import"):
                    yield tuple(shape)
                shape = []
            continue
        shape.append(_blank(kind, token))
        if kind == "op":
            depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(token, 0)
            if language != "go" and depth == 0 and token in (";", "}"):
                if shape[0] != "import" and shape != [";"]:
                    yield tuple(shape)
                shape = []
    if shape:
        yield tuple(shape)


_KEPT = frozenset("import from package export const let var function class def func type struct interface enum return if for while try async extends".split())


def _blank(kind: str, token: str) -> str:
    return token if kind == "op" or kind == "id" and token in _KEPT else {"id": "i", "num": "n", "str": "s"}.get(kind, kind)


def origin(graph: str | None, path: str, text: str | None) -> str:
    """Why a file is not hand-written source: ``vendored``, ``built``, ``generated``, ``minified`` or ``data``; else nothing."""
    where = place(graph, path)
    if not text:
        return where
    language = language_of(path) or "js"
    tokens = lex(text, language)
    name = path.rsplit("/", 1)[-1]
    return by_layout(layout(text, tokens, language), bool(MADE_NAME.search(name))) or note(tokens) or where or ("vendored" if VERSION_NAME.match(name) else "")


def by_layout(m: dict[str, float], made: bool) -> str:
    """What a file's layout says of it; ``made`` if its name is one that tools give."""
    if m["expansion"] >= LEAST_EXPANSION and m["width"] >= LEAST_WIDTH:
        return "minified"
    if m["literals"] >= LEAST_LITERALS and m["n_literals"] >= LEAST_DATA and not m["functions"]:
        return "data"
    if m["uniform"] >= LEAST_UNIFORM and m["statements"] >= LEAST_STATEMENTS:
        return "generated"
    if m["shapes"] <= MOST_SHAPES and m["statements"] >= 2 * LEAST_STATEMENTS:
        return "generated"
    if made and (m["uniform"] >= 0.5 and m["statements"] >= 3 or m["expansion"] >= 2):
        return "generated"
    return ""


def classify(files: DataFrame) -> DataFrame:
    """``(file_id, graph, path, origin)`` of every file; ``origin`` is empty for hand-written source.

    Null and empty contents are judged by their place alone; rows with a null id or path are left
    out; the stored name and extension, which can be null, are taken from the path; repeated rows
    give repeated rows.
    """

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [origin(graph, path, text) for graph, path, text in zip(batch["graph"], batch["path"], batch["content"])]
            yield pd.DataFrame({"file_id": batch["file_id"], "graph": batch["graph"], "path": batch["path"], "origin": found})

    read = files.select(F.col("id").cast("long").alias("file_id"), "graph", "path", "content").filter("file_id is not null and path is not null")
    return read.mapInPandas(judge, "file_id long, graph string, path string, origin string")


def found(files: DataFrame) -> DataFrame:
    """``(file_id)`` of each file that is not hand-written source."""
    return classify(files).filter("origin != ''").select("file_id").distinct()


def report(files: DataFrame) -> DataFrame:
    """``(graph, origin, files)``: how many files of each origin a graph has; hand-written ones under ``hand-written``."""
    named = F.when(F.col("origin") == "", "hand-written").otherwise(F.col("origin"))
    return classify(files).select("graph", named.alias("origin")).groupBy("graph", "origin").agg(F.count(F.lit(1)).alias("files"))
