"""Functions paired with their documentation (problem 5).

Each file is lexed by a state machine that knows strings and comments; braces (in Python,
indentation) delimit the functions, and a comment that ends on the line above a declaration (in
Python, the docstring) is its documentation.  What documents nothing beyond the name and the
signature is dropped.
"""

import re
from bisect import bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.lexing import Token
from loomgraph.llm import syntax

_PAIRS = {"(": ")", "[": "]", "{": "}"}
#: Words of JavaScript and TypeScript before a parenthesis that declare nothing.
_NO_METHOD = frozenset("if for while switch catch with return function typeof await new delete void throw super import in of instanceof case else do yield".split())
_MODIFIERS = frozenset("public private protected static readonly async override abstract accessor get set declare".split())


class Function(tuple):
    """``(name, label, first line, last line, documentation, signature words)``."""


def matching(tokens: list[Token]) -> dict[int, int]:
    """From the index of each opening bracket to that of its closing one."""
    out, stack = {}, []
    for k, (kind, token, _) in enumerate(tokens):
        if kind == "op" and token in _PAIRS:
            stack.append(k)
        elif kind == "op" and token in (")", "]", "}") and stack:
            out[stack.pop()] = k
    return out


#: What may stand behind a comment that is alone on its line.
_COMMENTS = re.compile(r"/\*.*?\*/|/\*.*|//.*|#.*")


class Source:
    """A lexed file with its lines."""

    def __init__(self, text: str, language: str, tokens: list[Token]):
        self.text, self.language = text, language
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.tokens = [t for t in tokens if t[0] != "com"]
        self.comments: dict[int, list[tuple[int, str]]] = {}  # by last line: (first line, text), of comments alone on their lines
        others = 0  # where the latest token that is no comment ends
        for kind, token, start in tokens:
            if kind != "com":
                if token and kind not in ("nl", "nl:", "nl@", "in", "out"):
                    others = start + len(token)
                continue
            first, end = self.line(start), start + len(token)
            last = self.line(end - 1)
            after = text.find("\n", end)
            if others <= self.starts[first] and not _COMMENTS.sub("", text[end : after if after >= 0 else len(text)]).strip():
                self.comments.setdefault(last, []).append((first, token))

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at) - 1

    def comment_above(self, line: int) -> str:
        """The comment that ends on the line above: a block, or a run of line comments."""
        out: list[str] = []
        while (line - 1) in self.comments:
            first, token = self.comments[line - 1][0][0], "\n".join(t for _, t in self.comments[line - 1])
            if token.startswith("/*"):
                if not out:
                    return token
                break
            out.append(token)
            line = first
        return "\n".join(reversed(out))


def _params(tokens: list[Token], start: int, stop: int) -> set[str]:
    return {token.lower() for kind, token, _ in tokens[start:stop] if kind == "id"}


def es_functions(source: Source) -> list[Function]:
    tokens = source.tokens
    close = matching(tokens)
    opened = {v: k for k, v in close.items()}
    out = []
    braces: list[str | None] = []  # of each open brace, the name of the class whose body it opens
    pending_class: str | None = None
    n = len(tokens)
    k = 0

    def text_at(i: int) -> str:
        return tokens[i][1] if 0 <= i < n and tokens[i][0] in ("op", "id") else ""

    def body_after(i: int) -> int:
        """The index of the body's brace after a parameter list that closes at ``i``, or -1."""
        j = i + 1
        if text_at(j) == ":":  # the type of the result
            j += 1
            while j < n:
                t = text_at(j)
                if t == "{" and text_at(j - 1) not in (":", "|", "&", "<", ",", "(", "=>", "is", "extends"):
                    return j
                if t == "{" or t in ("(", "["):
                    j = close.get(j, n)
                elif t in (";", ")", "}", "]") or t == "=" or (t == "=>" and text_at(j - 1) != ")"):
                    return -1
                elif t == "=>" and text_at(j - 1) == ")":
                    pass
                j += 1
            return -1
        return j if text_at(j) == "{" else -1

    def declaration(i: int, words: frozenset[str]) -> int:
        while i > 0 and text_at(i - 1) in words and tokens[i - 1][0] == "id":
            i -= 1
        return i

    def add(name: str, label: str, first: int, params: tuple[int, int], last: int) -> None:
        line = source.line(tokens[first][2])
        words = _params(tokens, *params)
        if label == "Constructor":
            words.update(name_words(braces[-1] or ""))
        out.append(Function((name, label, line, source.line(tokens[min(last, n - 1)][2]), source.comment_above(line), words)))

    while k < n:
        kind, token, _ = tokens[k]
        if kind == "id" and token == "class" and text_at(k - 1) not in (".", "?."):
            pending_class = text_at(k + 1) if text_at(k + 1) not in ("{", "extends") else ""
        elif kind == "op" and token == "{":
            braces.append(pending_class)
            pending_class = None
        elif kind == "op" and token == "}" and braces:
            braces.pop()
        elif kind == "op" and token == ";":
            pending_class = None
        elif kind == "id" and token == "function" and text_at(k - 1) not in (".", "?."):
            j = k + 1 + (text_at(k + 1) == "*")
            if j < n and tokens[j][0] == "id":
                p = j + 1
                if text_at(p) == "<":
                    p = _skip_generics(tokens, p)
                body = body_after(close[p]) if text_at(p) == "(" and p in close else -1
                if body >= 0:
                    first = declaration(k, frozenset(("export", "default", "async", "declare")))
                    if text_at(first - 1) in ("", ";", "}", "{", ")", ":") or source.line(tokens[first - 1][2]) != source.line(tokens[first][2]):
                        add(tokens[j][1], "Function", first, (p, body), close.get(body, n - 1))
        elif kind == "id" and token in ("const", "let", "var") and not braces and k + 2 < n and tokens[k + 1][0] == "id":
            found = _arrow(tokens, k + 2, close)
            if found and token == "const":
                first = declaration(k, frozenset(("export", "default", "declare")))
                add(tokens[k + 1][1], "Function", first, (k + 2, found[0]), found[1])
        elif kind == "id" and braces and braces[-1] is not None and token not in _NO_METHOD and text_at(k - 1) not in (".", "?.", "@", "new", "=", "=>", ":", ","):
            p = k + 1
            if text_at(p) == "<":
                p = _skip_generics(tokens, p)
            if text_at(p) == "(" and p in close and (before := text_at(k - 1)) not in ("(", "["):
                body = body_after(close[p])
                if body >= 0:
                    first = declaration(k, _MODIFIERS)
                    if text_at(first - 1) == "*":
                        first = declaration(first - 1, _MODIFIERS)
                    add(token, "Constructor" if token == "constructor" else "Method", first, (p, body), close.get(body, n - 1))
        k += 1
    return out


def _skip_generics(tokens: list[Token], at: int) -> int:
    depth = 0
    while at < len(tokens):
        token = tokens[at][1] if tokens[at][0] == "op" else ""
        depth += {"<": 1, ">": -1, ">>": -2, ">>>": -3}.get(token, 0)
        at += 1
        if depth <= 0:
            return at
    return at


def _arrow(tokens: list[Token], at: int, close: dict[int, int]) -> tuple[int, int] | None:
    """Of a declaration whose name stands before ``at``: where its arrow and the end of its body are, if it is an arrow function."""
    n = len(tokens)

    def text(i: int) -> str:
        return tokens[i][1] if i < n and tokens[i][0] in ("op", "id") else ""

    if text(at) == ":":  # the type of the variable
        at += 1
        while at < n and text(at) not in ("=", ";"):
            at = close.get(at, at) + 1
    if text(at) != "=":
        return None
    at += 1
    if text(at) == "async":
        at += 1
    if text(at) == "<":
        at = _skip_generics(tokens, at)
    if text(at) == "(" and at in close:
        at = close[at] + 1
        if text(at) == ":":
            at += 1
            while at < n and text(at) not in ("=>", ";", ")", "}"):
                at = close.get(at, at) + 1
    elif at < n and tokens[at][0] == "id":
        at += 1
    if text(at) != "=>":
        return None
    body = at + 1
    return at, close.get(body, body) if body < n else n - 1


def go_functions(source: Source) -> list[Function]:
    tokens = source.tokens
    close = matching(tokens)
    out, k, n = [], 0, len(tokens)
    while k < n:
        kind, token, start = tokens[k]
        if kind == "id" and token == "func" and (k == 0 or tokens[k - 1][0] == "nl" or tokens[k - 1][1] == ";"):
            j, label = k + 1, "Function"
            if j < n and tokens[j][1] == "(" and j in close:
                j, label = close[j] + 1, "Method"
            if j < n and tokens[j][0] == "id":
                name, p = tokens[j][1], j + 1
                if p < n and tokens[p][1] == "[" and p in close:
                    p = close[p] + 1
                at = close.get(p, n)
                at += 1
                while at < n and tokens[at][0] != "nl" and not (tokens[at][1] == "{" and tokens[at - 1][1] not in ("interface", "struct")):
                    at = close.get(at, at) + 1 if tokens[at][1] in _PAIRS else at + 1
                if at < n and tokens[at][1] == "{":
                    line, end = source.line(start), close.get(at, n - 1)
                    out.append(Function((name, label, line, source.line(tokens[end][2]), source.comment_above(line), _params(tokens, k + 1, at))))
                    k = at
        k += 1
    return out


def py_functions(source: Source) -> list[Function]:
    tokens = source.tokens
    out, n = [], len(tokens)
    blocks: list[tuple[str, str]] = []  # the word that opened each block, and the name after it
    opener = owner = ""
    for k, (kind, token, start) in enumerate(tokens):
        if kind == "in":
            blocks.append((opener, owner))
        elif kind == "out" and blocks:
            blocks.pop()
        elif kind == "id" and token in ("def", "class") and (k == 0 or tokens[k - 1][0] in ("nl", "nl:", "nl@", "in", "out") or tokens[k - 1][1] in ("async", ";", ":")):
            opener, owner = token, tokens[k + 1][1] if k + 1 < n else ""
            if token == "class" or k + 1 >= n:
                continue
            first = k - 1 if k and tokens[k - 1][1] == "async" else k
            at, depth = k + 1, 0
            while at < n and not (depth == 0 and tokens[at][1] == ":" and tokens[at][0] == "op"):
                depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(tokens[at][1], 0) if tokens[at][0] == "op" else 0
                at += 1
            params = _params(tokens, k + 2, at)
            at += 1
            while at < n and tokens[at][0] in ("nl", "nl:", "in"):
                at += 1
            doc = ""
            if at < n and tokens[at][0] == "str":
                last = at
                while last + 1 < n and tokens[last + 1][0] == "str":
                    last += 1
                if last + 1 >= n or tokens[last + 1][0] in ("nl", "out") or tokens[last + 1][1] == ";":
                    if not re.match(r"[bBfF]|[rR][bBfF]", tokens[at][1]):
                        doc = "\n".join(_unquoted(t[1]) for t in tokens[at : last + 1])
            label = "Method" if blocks and blocks[-1][0] == "class" else "Function"
            if tokens[k + 1][1] == "__init__" and label == "Method":
                label = "Constructor"
                params |= set(name_words(blocks[-1][1]))
            out.append(Function((tokens[k + 1][1], label, source.line(tokens[first][2]), _end_of_block(source, tokens, k), doc, params)))
        elif kind in ("nl:",):
            first_word = ""
            j = k - 1
            while j >= 0 and tokens[j][0] not in ("nl", "nl:", "nl@", "in", "out"):
                first_word = tokens[j][1] if tokens[j][1] != "async" else first_word
                j -= 1
            opener = first_word
    return out


def _end_of_block(source: Source, tokens: list[Token], at: int) -> int:
    depth, last = 0, tokens[at][2]
    for kind, token, start in tokens[at:]:
        if kind == "in":
            depth += 1
        elif kind == "out":
            depth -= 1
            if depth <= 0:
                break
        elif kind not in ("nl", "nl:", "nl@"):
            last = start + len(token) - 1
    return source.line(max(last, 0))


def _unquoted(literal: str) -> str:
    m = re.match(r"[rRuU]{0,2}(\"\"\"|'''|\"|')([\s\S]*)\1\Z", literal)
    return m.group(2) if m else literal


def functions(text: str, language: str, tokens: list[Token]) -> list[Function]:
    """The functions of a file that parses, in order."""
    source = Source(text, language, tokens)
    return {"py": py_functions, "go": go_functions}.get(language, es_functions)(source)


# --- documentation that says nothing -----------------------------------------------------------

#: Comments for tools, marks of something left to do, and words that any function could be described with.
DIRECTIVE = re.compile(r"(?:eslint|prettier|tslint|jshint|jscs|biome|deno-|@ts-|nolint|noqa|noinspection|pylint|flake8|mypy|type:\s*ignore|pragma|fmt:|isort:|yapf:|istanbul|c8 ignore|v8 ignore|sonar|go:|lint:|nosec|\+build|#?\s*region|#?\s*endregion|line \d)", re.I)
UNDONE = re.compile(r"(?:todo|fixme|tbd|xxx|hack|wip|tbc|write me|add docs?|document (?:this|me)|see (?:above|below)|ditto|placeholder|lorem ipsum|no (?:description|docs?)|undocumented|n/a|none|same as above)\b", re.I)
TAG = re.compile(r"""[@:\\](?:params?|args?|arguments?|returns?|rtype|type|throws|raises|template|typeparam|yields?|this|override|inheritdoc|public|private|protected|internal|static|async|function|method|constructor|class|memberof|deprecated|since|see|todo|abstract|readonly|export|constructs|name|var|ivar|kind)\b:?""", re.I)
CODE = re.compile(
    r"""(?:(?:const|let|var|return|import|export|from|func|def|async|function|class|if|elif|else|for|while|switch|case|type|await|throw|raise|defer|go|try|catch|with|new|print)\b.*(?:[;{}=]|\)|:)|[\w.$\[\]]+\s*(?:[+\-*/|&%]|:)?=[^=].*|[\w.$]+\([^)]*\)\s*;?|[{}()\[\];,]+|pass|break;?|continue;?|return;?)\s*$"""
)
GENERIC = frozenset(
    """the a an this that these those it its function functions method methods procedure routine constructor class object instance will would shall should can
    to of for in on with and or is are be does do did helper helpers utility util utils creates create make makes build builds new initializes initialize init returns return returned
    result results value values parameter parameters param params argument arguments args input inputs output outputs description desc descriptions summary details
    default generic main here there todo self cls void none null undefined string number boolean bool int float any object unknown promise error function code implementation implements
    implement handles handle performs perform executes execute calls call runs run simple internal private public""".split()
)
_MARKS = re.compile(r"^\s*(?:/\*+!?|\*+/|\*(?!/)|//+[/!]?|#+!?)?\s?|\s*\*+/\s*$", re.M)


def name_words(name: str) -> list[str]:
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", name)]


def clean(doc: str) -> str:
    """A comment without its marks."""
    return _MARKS.sub("", doc).strip()


def _same(word: str, known: str) -> bool:
    return word == known or word.rstrip("s") == known.rstrip("s") or (len(known) > 3 and word.startswith(known[:-1]) and len(word) <= len(known) + 3)


def trivial(name: str, doc: str, signature: set[str]) -> bool:
    """Whether a documentation adds nothing to the name and the signature."""
    if doc.startswith("/*!"):
        return True  # a banner of the file
    known, whole = name_words(name), name.replace("_", "").lower()
    for line in clean(doc).splitlines():
        line = line.strip()
        if not line or DIRECTIVE.match(line) or UNDONE.match(line) or UNDONE.match(line.lstrip("<[({-* ")) or CODE.match(line):
            continue
        line = re.sub(r"\{[^{}]*\}", " ", line) if TAG.match(line) else line
        line = TAG.sub(" ", line)
        for word in re.findall(r"[^\W_]+", line):
            low = word.lower()
            if low.isdigit() or low in GENERIC or low in signature or low == whole or any(_same(low, k) for k in known):
                continue
            if len(low) == 1 or any(low in s.split("_") for s in signature):
                continue
            return False
    return True


def documented(text: str, language: str, tokens: list[Token]) -> Iterator[Function]:
    return (one for one in functions(text, language, tokens) if one[4] and not trivial(one[0], one[4], one[5]))


def _of_good_files(files: DataFrame, of_file, schema: str) -> DataFrame:
    """The rows that ``of_file`` makes of the files that parse, from one lexing for both; of a repeated file row once."""
    whole = Window.partitionBy("row")
    rows = syntax.judged(syntax.token_rows(files, of_file, schema)).withColumns({"bad": F.max("wrong").over(whole), "open": F.sum("step").over(whole)})
    return rows.filter("name is not null and not bad and open = 0").dropDuplicates(["file_id", "name", "src_start"])


def pairs(files: DataFrame) -> DataFrame:
    """``(file_id, name, label, src_start, src_end, code, doc)``: every function of a file that parses, with documentation that is not trivial.

    Lines count from 0; ``doc`` has no comment marks; ``code`` is the function's lines.  Null and
    empty contents, null ids, other languages and files that don't parse give no rows; a file row
    that is repeated counts once.
    """

    def extract(text: str, language: str, tokens: list[Token]) -> Iterator[tuple]:
        lines = text.split("\n")
        for name, label, first, last, doc, _ in documented(text, language, tokens):
            yield name, label, first, last, "\n".join(lines[first : last + 1]), clean(doc)

    made = _of_good_files(files, extract, "name string, label string, src_start long, src_end long, code string, doc string")
    return made.select("file_id", "name", "label", "src_start", "src_end", "code", "doc")


def found(files: DataFrame) -> DataFrame:
    """``(file_id, name, src_start)`` of every documented function."""
    made = _of_good_files(files, lambda *file: [(name, first) for name, _, first, *_ in documented(*file)], "name string, src_start long")
    return made.select("file_id", "name", "src_start")
