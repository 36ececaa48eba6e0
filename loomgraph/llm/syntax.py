"""Source files that their language cannot parse (problem 4).

Files are lexed into rows, one for each token with the class of the token before it.  An anti-join
of those adjacent pairs with the pairs that each language's grammar permits leaves the pairs that
cannot stand in any file of the language; windowed reductions over the brackets of a file check
their nesting, and others over the marks of its statements check their productions: that an ``else`` has its ``if``,
a ``case`` its ``switch``, a condition both its branches, the head of a ``for`` its parts.  The classes carry what a pair
needs to know of its statement: a name that is being declared, the parenthesis that ends a function's
parameters, the block of a ``try``, a Python line that opens a block, and so on.

Not detected: what needs types or scopes, and some errors inside TypeScript's types.
"""

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions.lexing import GO_WORDS, LANGUAGES, language_of, lex

# --- classes of tokens -------------------------------------------------------------------------

ES_WORDS = frozenset("var let const if else for while do return switch case default break continue throw try catch finally debugger import export function class enum with this super null true false new typeof void delete await yield in instanceof extends".split())
ES_CONTEXT = frozenset("async of get set static as from".split())
TS_CONTEXT = ES_CONTEXT | frozenset("type interface namespace declare abstract readonly private public protected override keyof infer is asserts satisfies implements unique module global accessor".split())
ES_OPS = frozenset(">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << >> ** { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @".split())
PY_WORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
PY_SOFT = frozenset("match case type".split())
PY_OPS = frozenset("**= //= >>= <<= ... -> := == != <= >= += -= *= /= %= &= |= ^= @= ** // << >> ( ) [ ] { } , : . ; @ = + - * / % & | ^ ~ < >".split())
GO_OPS = frozenset("<<= >>= &^= ... && || <- ++ -- == != <= >= := += -= *= /= %= &= |= ^= << >> &^ { } ( ) [ ] ; , < > + - * / % & | ^ ! : = . ~".split())


#: Marks of statements, by group; in a block the sum of a group must not fall below 0 (``BRANCH``), or not be above it at
#: a statement's end (``CONDITION``, ``LAMBDA``, ``EACH``).  ``HEAD`` counts the semicolons in a ``for``; a ``CASE`` stands in a ``switch``; an ``END`` ends a statement.
BRANCH, CONDITION, LAMBDA, EACH, HEAD, CASE, END = range(1, 8)
#: Brackets with a statement of their own, by number; modulo 5 they are what closes them.
FOR_PAREN, SWITCH_BRACE = 6, 8

Marks = dict[int, tuple[int, int]]


def es_classes(tokens: list[tuple[str, str, int]], text: str, typed: bool, marks: Marks, kinds: dict[int, int]) -> list[str]:
    """The class of each token of a TypeScript or JavaScript file; ``+`` in front marks the first on its line.

    ``marks`` gets group and step of the tokens that are marks of a statement, ``kinds`` the brackets of ``for`` and ``switch``.
    """
    context = TS_CONTEXT if typed else ES_CONTEXT
    real = [t for t in tokens if t[0] != "com"]
    out: list[str] = []
    opened: list[str] = []
    prev = "BOF"
    end = 0
    importing = False
    asked = False
    paren = ""
    for k, (kind, token, start) in enumerate(real):
        following = real[k + 1][1] if k + 1 < len(real) else ""
        if kind == "id":
            if prev in (".", "?."):
                c = "ID"
            elif token in ES_WORDS and not (following == ":" and token not in ("default", "else", "case", "this", "null", "true", "false", "super") and prev != "?") and not (following == "?" and prev in ("{", ";", ",") and typed) and not (following == ":" and prev in ("{", ",") and token != "default"):
                c = token
                if token == "import" and following != "(":
                    importing = True
            elif token == "from" and importing and (prev in ("}i", "NAME", "ID", "CTX") or prev == "}") :
                c, importing = "FROM", False
            elif token in context:
                c = "CTX"
            elif prev == "const":
                c = "CNAME"
            elif prev in ("function", "class", "enum", "f*"):
                c = "NAME"
            elif prev == "CTX" and k and real[k - 1][1] in ("interface", "namespace") and typed:
                c = "NAME"
            else:
                c = "ID"
            if c == "if":
                marks[k] = (BRANCH, 1)
            elif c == "else":
                marks[k] = (BRANCH, -1)
            elif c == "case":
                marks[k] = (CASE, 0)
        elif kind == "op":
            c = token
            if token == "(":
                before = real[k - 2][1] if k > 1 else ""
                if prev == "for" or prev == "await" and before == "for":
                    kinds[k] = FOR_PAREN
                opened.append(")s" if prev == "switch" else ")k" if prev == "catch" else ")f" if prev == "function" or prev == "NAME" and before in ("function", "*") else ")c" if prev in ("if", "for", "switch", "with") else ")")
            elif token == "[":
                opened.append("]")
            elif token == "{":
                opened.append("}i" if importing else "}t" if prev == "try" else "}d" if prev == "do" else "}k" if prev == "catch" or prev == ")" and paren == ")k" else "}")
                if paren == ")s" and prev == ")c":
                    kinds[k] = SWITCH_BRACE
            elif token in ")]}" and opened:
                c = opened.pop()
                paren = c
                c = c if c[0] == token else token
                c = {")s": ")c", ")k": ")"}.get(c, c)
            elif token == "*" and prev == "function":
                c = "f*"
            elif token == ":" and not typed and prev == "ID" and opened and opened[-1] == ")f":
                c = "bad"
            elif token == "?" and following not in (")", ",", ":", ".", "=", ";", "]", ">", "}") and not (typed and (following == "(" or prev in ("]", "}"))):
                marks[k], asked = (CONDITION, 1), True
            elif token == ":" and asked:
                marks[k] = (CONDITION, -1)
            elif token == ";":
                if opened and opened[-1][0] == ")":
                    marks[k] = (HEAD, 1)
                elif asked:
                    marks[k], asked = (END, 0), False
        elif kind == "tpl":
            head, tail = token.startswith("`"), token.endswith("`") and len(token) > 1
            c = "TPL" if head and tail else "TPL<" if head else "TPL>" if tail else "TPL|"
            if head and not tail:
                opened.append("tpl")
            elif tail and not head and opened:
                opened.pop()
        else:
            c = {"num": "NUM", "str": "STR", "re": "RE", "tag<": "TAG<", "tag>": "TAG>", "txt": "TXT", "conf": "bad"}.get(kind, "bad")
            if c == "STR":
                importing = False
        if c == ";":
            importing = False
        fresh = "\n" in text[end:start]
        end = start + len(token)
        out.append("+" + c if fresh and c != "bad" else c)
        prev = c
    out.append("EOF")
    return out


def py_classes(tokens: list[tuple[str, str, int]], marks: Marks) -> list[str]:
    """The class of each token of a Python file; ``marks`` as in ``es_classes``."""
    real = [t for t in tokens if t[0] != "com"]
    out: list[str] = []
    loops = [False]  # of each open bracket whether a comprehension's ``for`` was met
    prev, head, marked, lambdas, params, default = "", "", False, 0, 0, False
    for k, (kind, token, _) in enumerate(real):
        if kind == "id":
            c = token if token in PY_WORDS and prev != "." else "SOFT" if token in PY_SOFT else "ID"
            if prev in ("def", "class") and c == "ID":
                c = "NAME"
            head = head or token
            if c == "for":
                marks[k], marked = (EACH, 1), True
                loops[-1] = len(loops) > 1
            elif c == "in" and marked:
                marks[k] = (EACH, -1)
            elif c == "if" and out and prev not in ("NL", "NL:", "NL@", "IN", "OUT", "BOF", ":", ";") and not loops[-1] and head not in ("case",):
                marks[k], marked = (CONDITION, 1), True
            elif c == "else" and marked:
                marks[k] = (CONDITION, -1)
            elif c == "lambda":
                marks[k], marked, lambdas = (LAMBDA, 1), True, lambdas + 1
            elif c == "ID" and len(loops) == params and default and prev == "," and real[min(k + 1, len(real) - 1)][1] in (",", ")"):
                c = "bad"  # a parameter without a default after one with
        elif kind == "op":
            c = token
            if token in "([{":
                if prev == "NAME" and head in ("def", "async"):
                    params, default = len(loops) + 1, False
                loops.append(False)
            elif token in ")]}":
                if len(loops) == params:
                    params = 0
                if len(loops) > 1:
                    loops.pop()
            elif token == ":" and lambdas:
                marks[k] = (LAMBDA, -1)
            elif token == "=":
                if len(loops) == params:
                    default = True
                elif len(loops) == 1 and head in ("if", "elif", "while", "return", "assert", "raise", "del") and not lambdas:
                    c = "bad"
            elif token == "*" and len(loops) == params:
                default = False
        else:
            c = {"num": "NUM", "str": "STR", "nl": "NL", "nl:": "NL:", "nl@": "NL@", "in": "IN", "out": "OUT"}.get(kind, "bad")
            if kind in ("nl", "nl:", "nl@"):
                if marked and k not in marks:
                    marks[k] = (END, 0)
                head, marked, lambdas, params, loops = "", False, 0, 0, [False]
        if c == ";" and len(loops) == 1:
            head = ""
        out.append(c)
        prev = c
    if marked:
        marks[len(out)] = (END, 0)
    out.append("EOF")
    return out


def go_classes(tokens: list[tuple[str, str, int]]) -> list[str]:
    """The class of each token of a Go file."""
    real = [t for t in tokens if t[0] != "com"]
    out: list[str] = []
    depth, prev, before, head, parts, declared = 0, "", "", -1, 0, False
    params: list[bool] = []  # of each open bracket whether it holds a function's parameters
    for kind, token, _ in real:
        if kind == "id":
            c = token if token in GO_WORDS and prev != "." else "ID"
            if c == "ID" and prev == "var":
                c = "VNAME"
            elif c == "ID" and prev == "func":
                c = "FNAME"
            elif c == "ID" and prev == "ID" and params and params[-1]:
                c = "TYPE"
            elif c == "for":
                head, parts = depth, 0
            elif depth == 0 and c == "import" and declared:
                c = "bad"
            elif depth == 0 and c in ("func", "var", "type", "const"):
                declared = True
        elif kind == "op":
            c = token
            if token in "([{":
                if token == "{" and depth == head:
                    head = -1
                    c = c if parts in (0, 2) else "bad"
                params.append(token == "(" and (prev in ("func", "FNAME") or depth == 0 and prev == "ID" and before == ")"))
                depth += 1
            elif token in ")]}":
                depth -= 1
                if params:
                    params.pop()
            elif token == ";" and depth == head:
                parts += 1
        elif kind == "nl":
            c = "NL0" if depth <= 0 else "NL"
        else:
            c = {"num": "NUM", "str": "STR"}.get(kind, "bad")
        out.append(c)
        before, prev = prev, c
    out.append("EOF")
    return out


# --- pairs that the grammars permit ------------------------------------------------------------


def es_pairs(typed: bool, markup: bool) -> set[tuple[str, str]]:
    close = {")", ")f", ")c", "]", "}", "}i", "}t", "}d", "}k", "TPL>", "TPL|"}
    literal = {"this", "super", "null", "true", "false"}
    operand_end = {"ID", "CTX", "NUM", "STR", "RE", "TPL", "TPL>", "TAG>", ")", "]", "}", "++", "--", "NAME"} | literal | ({">", "!", ")f"} if typed else set())
    begin = {"ID", "CTX", "NUM", "STR", "RE", "TPL", "TPL<", "(", "[", "{", "+", "-", "!", "~", "++", "--", "@", "function", "class", "new", "typeof", "void", "delete", "await", "yield", "import"} | literal | ({"TAG<"} if markup else set()) | ({"<"} if typed else set())
    statement = {"var", "let", "const", "if", "for", "while", "do", "return", "switch", "break", "continue", "throw", "try", "debugger", "import", "export", "function", "class", "enum", "with", "case", "default"}
    binary = {o for o in ES_OPS if o not in "( ) [ ] { } ; ! ~ ++ -- @ ... . ?. =>".split()}
    follow = binary | close | {";", "EOF", ".", "?.", "=>", "instanceof", "in", "CTX", "extends"} | ({"!"} if typed else set())
    prefix_word = {"throw", "typeof", "void", "delete", "new", "await", "instanceof", "in", "case", "extends"}
    pairs: set[tuple[str, str]] = set()

    def allow(prevs: set[str], nexts: set[str], fresh: set[str] | None = None) -> None:
        for p in prevs:
            pairs.update((p, n) for n in nexts)
            pairs.update((p, "+" + n) for n in (nexts if fresh is None else nexts | fresh))

    everything = follow | begin | statement | {"else", "FROM", "NAME", "TXT", "TAG>"}
    allow({"BOF"}, begin | statement | {";", "EOF"})
    allow(operand_end - {")", "]", "}", "NAME", "CTX"}, follow | {"(", "[", "{", "TPL", "TPL<", "++", "--"}, begin | statement | {"*"})
    pairs.difference_update((p, n) for p in ("NUM", "STR", "RE") for n in ("(", "TPL", "TPL<") + (() if typed else ("{",)) if (p, n) != ("STR", "("))
    allow({"ID", "CTX", "STR", "]"}, {"FROM"})
    allow({"]"}, follow | {"(", "[", "{", "TPL", "TPL<", "++", "--"}, begin | statement | {"*", "else"})
    allow({")", "}"}, everything | {"*", "++", "--"})
    if not typed:
        pairs.difference_update({("}", "FROM"), (")", "FROM")})
    allow({"}t"}, {"catch", "finally"})
    allow({"}k"}, begin | statement | {"}", "}t", "}d", "}k", ";", "EOF", "finally", "else", "*"})
    allow({"}d"}, {"while"})
    allow({"CNAME"}, {"=", ":", "in", "CTX"} | ({"!"} if typed else set()))
    allow({"}i"}, {"FROM", ";", "=", ","} , statement | begin if typed else set())
    allow({")f"}, {"{"} | ({":", "<", ";"} if typed else set()), {"EOF"} if typed else set())
    allow({")c"}, (everything - {"EOF", ")", "]", "}", "FROM"}) | {";"})
    allow({"CTX"}, everything | {"*", "..."})
    allow({"NAME"}, {"(", "{", "<", "extends", "CTX", "=", ":", "in", "FROM", ";", ","} | ({"!", ">"} if typed else set()))
    allow({"FROM"}, {"STR"})
    allow(binary - {",", ":", "?", "*", ">"} | ({">"} if not typed else set()), begin)
    allow({">"} if typed else set(), follow | begin | statement | {"{", "(", "["})
    allow({","}, begin | {")", ")f", "]", "}", "}i", ",", "...", "*"} | ({">"} if typed else set()))
    allow({":"}, begin | statement | {"}", "}t", "}d", "}k"})
    allow({"?"}, begin | ({":", ")", ")f", ",", "}", ".", "(", "="} if typed else set()))
    allow({"*", "f*"}, begin | {"=", "NAME"})
    allow({"=>"}, begin)
    if typed:
        allow({"=", ":", "<", "(", "|", "&", "?", ",", "=>", "["}, {"|", "&", "-", "+"})
        allow({"-", "+"}, {"?", "CTX"})
        allow({"CTX"}, {"NAME"})
        allow({"?"}, {"?."})
        allow({"void", "typeof"}, follow | {"{", "["})  # the type
    allow({"...", "@"}, begin)
    allow({"."}, {"ID"})
    allow({"?."}, {"ID", "(", "[", "TPL", "TPL<"})
    allow({"!", "~"}, begin)
    allow({"++", "--"}, begin)
    allow({"(", "TPL<", "TPL|"}, begin | {"...", ")", ")f", ")c", ";", "var", "let", "const"})
    allow({"["}, begin | {"]", ",", "..."})
    ends = {"}", "}t", "}d", "}k"}
    allow({"{"}, begin | statement | ends | {"}i", ";", "...", "*", "get"})
    allow({";"}, begin | statement | ends | {";", ")", ")c", "EOF", "*", "[", "else"})
    allow({"return"}, begin | ends | {";", "EOF"}, statement)
    allow({"yield"}, begin | ends | {"*", ";", ")", "]", ",", "EOF"}, statement)
    allow(prefix_word, begin | ({"."}))
    allow({"else", "do"}, begin | statement)
    allow({"try", "finally"}, {"{"})
    allow({"catch"}, {"(", "{"})
    allow({"if", "while", "switch", "with"}, {"("})
    allow({"for"}, {"(", "await"})
    allow({"var", "let"}, {"ID", "CTX", "NAME", "{", "["})
    allow({"const"}, {"CNAME", "CTX", "{", "[", "enum"})
    allow({"function"}, {"NAME", "CTX", "(", "f*"})
    allow({"class"}, {"NAME", "CTX", "{", "extends"})
    allow({"enum"}, {"NAME", "CTX"})
    allow({"import"}, {"{", "ID", "CTX", "*", "STR", "(", "."})
    allow({"export"}, {"{", "*", "default", "function", "class", "const", "let", "var", "CTX", "enum", "import", "@", "="})
    allow({"default"}, begin | {":"})
    allow({"break", "continue"}, ends | {";", "ID", "CTX", "EOF"}, statement | begin)
    allow({"debugger"}, ends | {";", "EOF"}, statement | begin)
    if markup:
        allow({"TAG<", "TXT", "TAG>", "}"}, {"TAG<", "TAG>", "TXT", "{"})
    return pairs


def py_pairs() -> set[tuple[str, str]]:
    close = {")", "]", "}"}
    literal = {"None", "True", "False"}
    operand_end = {"ID", "SOFT", "NUM", "STR", "...", "NAME"} | close | literal
    begin = {"ID", "SOFT", "NUM", "STR", "(", "[", "{", "-", "+", "~", "not", "lambda", "await", "yield", "..."} | literal
    statement = {"assert", "async", "break", "class", "continue", "def", "del", "for", "from", "global", "if", "import", "nonlocal", "pass", "raise", "return", "try", "while", "with"}
    again = {"else", "elif", "except", "finally"}
    binary = PY_OPS - {"(", "[", "{", ")", "]", "}", ".", ";", "~", "...", "@"}
    words = {"and", "or", "in", "is", "if", "else", "for", "as", "not", "async", "import", "from"}
    pairs: set[tuple[str, str]] = set()

    def allow(prevs: set[str], nexts: set[str]) -> None:
        pairs.update((p, n) for p in prevs for n in nexts)

    allow({"BOF"}, begin | statement | {"@", "EOF", "NL", "*"})
    allow(operand_end - {"NAME"}, binary | close | words | {".", ";", "NL", "NL:", "NL@", "[", "@", "@="})
    allow({"ID", "SOFT", ")", "]", "NAME"}, {"("})
    allow({"NAME"}, {":", "["})
    allow({"STR"}, {"STR"})
    allow({"SOFT"}, begin)
    allow({"STR", "}"}, {"("})
    allow((binary | {"@"}) - {"->"}, begin)
    allow({"->"}, begin)
    allow({","}, begin | close | {"NL", ":", "*", "**", "/", "=", "for"})
    allow({":"}, begin | statement | close | {",", ":", "NL", "NL:", "="})
    allow({"="}, begin | {"*"})
    allow({"*"}, {",", ")", "NL", ":"})
    allow({"/"}, {",", ")", ":"})
    allow({"."}, {"ID", "SOFT", "import", ".", "...", "NAME"})
    allow({"..."}, {"ID", "import", "."})
    allow({"(", "["}, begin | {")", "]", "*", "**", ":", "..."})
    allow({"{"}, begin | {"}", "*", "**"})
    allow({";"}, begin | statement | {"NL"})
    allow({"NL", "OUT", "IN"}, begin | statement | {"@", "*"})
    allow({"NL", "OUT"}, {"OUT", "EOF", "NL"} | again)
    allow({"NL:"}, {"IN"})
    allow({"NL@"}, {"def", "class", "async", "@"})
    allow({"def"}, {"NAME", "SOFT"})
    allow({"class"}, {"NAME", "SOFT"})
    allow({"import"}, {"ID", "SOFT", "*", "("})
    allow({"from"}, begin | {".", "..."})
    allow({"return"}, begin | {"NL", ";", "*"})
    allow({"raise"}, begin | {"NL", ";"})
    allow({"if", "elif", "while", "with", "and", "or", "del", "assert", "await", "in", "not", "is"}, begin | {"*"})
    allow({"not"}, {"in"})
    allow({"else"}, begin | {":"})
    allow({"try", "finally"}, {":"})
    allow({"except"}, begin | {":", "*"})
    allow({"for", "as", "global", "nonlocal"}, {"ID", "SOFT", "(", "[", "*"})
    allow({"pass", "break", "continue"}, {"NL", ";"})
    allow({"lambda"}, {"ID", "SOFT", ":", "*", "**"})
    allow({"yield"}, begin | {"from", "NL", ")", "]", ";", ","})
    allow({"async"}, {"def", "for", "with"})
    return pairs


def go_pairs() -> set[tuple[str, str]]:
    close = {")", "]", "}"}
    types = {"func", "map", "chan", "struct", "interface"}
    begin = {"ID", "NUM", "STR", "(", "[", "{", "&", "*", "+", "-", "!", "^", "<-", "~"} | types
    statement = {"break", "const", "continue", "defer", "fallthrough", "for", "go", "goto", "if", "return", "select", "switch", "type", "var", "case", "default"}
    binary = GO_OPS - {"(", "[", "{", ")", "]", "}", ".", ";", "!", "~", "++", "--", "..."}
    ends = {"NL", "NL0", ";"}
    pairs: set[tuple[str, str]] = set()

    def allow(prevs: set[str], nexts: set[str]) -> None:
        pairs.update((p, n) for p in prevs for n in nexts)

    allow({"BOF"}, {"package"})
    allow({"package"}, {"ID"})
    allow({"ID"}, binary | close | ends | begin - {"NUM", "!", "~"} | {".", "...", "++", "--"})
    allow({"NUM", "STR"}, binary | close | ends | {"[", ".", "{"})
    allow({")"}, binary | close | ends | (begin - {"NUM", "STR", "!", "~"}) | {".", "...", "++", "--", "STR"})
    allow({"]"}, binary | close | ends | (begin - {"NUM", "STR", "!"}) | {".", "...", "++", "--"})
    allow({"}"}, binary | close | ends | {"(", "{", ".", "else", "[", "STR"})
    allow(binary - {",", ":"}, begin | {"range"})
    allow({","}, begin | close | {"...", "range"})
    allow({":"}, begin | statement | {"}", "]"})
    allow({"..."}, begin | {")", "]", "}", ","})
    allow({"."}, {"ID", "("})
    allow({"!", "~"}, begin)
    allow({"++", "--"}, ends | {"{", ")", "}"})
    allow({"("}, begin | {")", "...", "type"})
    allow({"["}, begin | {"]", "...", ":"})
    allow({"{"}, begin | statement | {"}", ";", "range"})
    allow({"NL", ";"}, begin | statement | {"}", ")", "]", ";", "{"})
    allow({"NL0"}, {"import", "func", "type", "var", "const", "EOF", ";"})
    allow({";"}, {"EOF", "import"})
    allow({"NL"}, {"EOF"})
    allow({"import"}, {"STR", "(", "ID", "."})
    allow({"func"}, {"FNAME", "("})
    allow({"FNAME"}, {"(", "["})
    allow({"TYPE"}, {",", ")", ".", "["})
    allow({"ID"}, {"TYPE"})
    allow({"var"}, {"VNAME", "("})
    allow({"VNAME"}, types | {"ID", "=", ",", "*", "[", "(", "<-"})
    allow({"type", "const"}, {"ID", "("})
    allow({"chan", "range", "go", "defer", "case"}, begin)
    allow({"if", "switch"}, begin | {";"})
    allow({"for"}, begin | {";", "range"})
    allow({"select", "struct", "interface"}, {"{"})
    allow({"interface"}, {"{"})
    allow({"map"}, {"["})
    allow({"default"}, {":"})
    allow({"return"}, begin | ends | {"}"})
    allow({"break", "continue"}, {"ID", "}"} | ends)
    allow({"goto"}, {"ID"})
    allow({"fallthrough"}, ends | {"}"})
    allow({"else"}, {"{", "if"})
    return pairs


@cache
def grammar() -> tuple[dict[str, int], dict[str, frozenset[tuple[str, str]]]]:
    """The number of each class, and the permissible pairs of each language."""
    pairs = {"ts": es_pairs(True, False), "tsx": es_pairs(True, True), "js": es_pairs(False, False), "jsx": es_pairs(False, True), "py": py_pairs(), "go": go_pairs()}
    names = sorted({c for own in pairs.values() for pair in own for c in pair} | {"bad"} | {f + c for c in ES_WORDS | ES_OPS for f in ("", "+")} | PY_WORDS | PY_OPS | GO_WORDS | GO_OPS)
    return {c: k for k, c in enumerate(names)}, {language: frozenset(own) for language, own in pairs.items()}


def classes(text: str, language: str, tokens: list[tuple[str, str, int]], marks: Marks, kinds: dict[int, int]) -> list[str]:
    if language == "py":
        return py_classes(tokens, marks)
    if language == "go":
        return go_classes(tokens)
    return es_classes(tokens, text, language in ("ts", "tsx"), marks, kinds)


#: Brackets by class: which kind, and whether one opens (1) or closes (-1).
BRACKETS = {"(": (1, 1), ")": (1, -1), ")f": (1, -1), ")c": (1, -1), "[": (2, 1), "]": (2, -1), "{": (3, 1), "}": (3, -1), "}i": (3, -1), "}t": (3, -1), "}d": (3, -1), "}k": (3, -1), "TPL<": (4, 1), "TPL>": (4, -1), "TAG<": (5, 1), "TAG>": (5, -1)}

#: Files whose tokens are handed on together.
FILES_AT_A_TIME = 256
_NUMBERS = ("language", "before", "class", "pos", "bracket", "step", "mark", "delta")
_TOKENS = "row long, file_id long, " + ", ".join(f"{name} int" for name in _NUMBERS)


def token_rows(files: DataFrame, of_file: Callable | None = None, of_file_schema: str = "") -> DataFrame:
    """The tokens of each file (``id``, ``path``, ``content``) as rows.

    A pair of neighbouring tokens has a row for each file that has it (``before``, ``class``, at place -1); brackets and marks
    of statements have a row for each place.  ``row`` tells repeated file rows apart.  ``of_file`` makes further rows of a
    text, its language and its tokens, whose columns ``of_file_schema`` names, so that each file is
    lexed once.  Files of other languages and null or empty contents give no rows.
    """
    number, pairs = grammar()
    languages = sorted(pairs)

    schema = f"{_TOKENS}, {of_file_schema}" if of_file else _TOKENS
    of_further = {column.split()[0]: {"string": pa.string(), "long": pa.int64()}[column.split()[1]] for column in of_file_schema.split(", ") if column}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bad, width = number["bad"], len(number) + 1
        plain = {c: number.get(c[1:] if c[0] == "+" and c[1:] in number and len(c) > 1 and c not in ES_OPS else c, bad) for c in number}
        bare = {c: c[1:] if c[0] == "+" and c[1:] in BRACKETS else c for c in number}
        brackets = {c: BRACKETS[b] for c, b in bare.items() if b in BRACKETS}
        for batch in (whole.slice(k, FILES_AT_A_TIME) for whole in batches for k in range(0, len(whole), FILES_AT_A_TIME)):
            parts, made = [], []
            for row, file, path, text in zip(*(batch.column(name).to_pylist() for name in ("row", "file_id", "path", "content"))):
                language = language_of(path)
                tokens = lex(text, language)
                marks, kinds = {}, {}
                own = classes(text, language, tokens, marks, kinds)
                codes = np.array([number.get(c, bad) for c in own], np.int64)
                before = np.array([number["BOF"], *(plain.get(c, bad) for c in own[:-1])], np.int64)
                met = np.unique(before * width + codes)
                places = sorted({k for k, c in enumerate(own) if c in brackets}.union(marks))
                shape = []
                for k in places:
                    kind, step = brackets.get(own[k], (0, 0)) if k < len(own) else (0, 0)
                    shape.append((k, kinds.get(k, kind), step, *marks.get(k, (0, 0))))
                out = np.zeros((len(met) + len(shape), len(_NUMBERS)), np.int32)
                out[:, 0] = languages.index(language)
                out[: len(met), 1], out[: len(met), 2], out[: len(met), 3] = met // width, met % width, -1
                out[len(met) :, 1:3] = -1
                if shape:
                    out[len(met) :, 3:] = shape
                parts.append((row, file, out))
                if of_file:
                    made += [(row, file, *new) for new in of_file(text, language, tokens)]
            sizes = [len(p[2]) for p in parts]
            numbers = np.concatenate([p[2] for p in parts]) if parts else np.zeros((0, len(_NUMBERS)), np.int32)
            columns = [np.repeat(np.array([p[k] for p in parts], np.int64), sizes) for k in (0, 1)] + [np.ascontiguousarray(numbers[:, k]) for k in range(len(_NUMBERS))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns] + [pa.nulls(len(numbers), kind) for kind in of_further.values()], names=["row", "file_id", *_NUMBERS, *of_further])
            if made:
                flat = np.zeros(len(made), np.int32)
                columns = [pa.array([m[k] for m in made], pa.int64()) for k in (0, 1)] + [pa.array(flat - (name in ("before", "pos"))) for name in _NUMBERS]
                yield pa.RecordBatch.from_arrays(columns + [pa.array([m[k] for m in made], kind) for k, kind in enumerate(of_further.values(), 2)], names=["row", "file_id", *_NUMBERS, *of_further])

    read = files.select(F.col("id").cast("long").alias("file_id"), "path", "content").filter("file_id is not null and path is not null and content is not null and content != ''")
    return read.filter(extension_language(F.col("path")).isNotNull()).withColumn("row", F.monotonically_increasing_id()).mapInArrow(rows, schema)


def extension_language(path):
    """The language that a path's extension says, as a column; null for others."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))
    out = F.lit(None).cast("string")
    for known, language in LANGUAGES.items():
        out = F.when(extension == known, language).otherwise(out)
    return out


def permissible_pairs(spark: SparkSession) -> DataFrame:
    """``(language, before, class)``: every pair that a grammar permits.  A fixed table of a few thousand rows."""
    number, pairs = grammar()
    rows = [(k, number[a], number[b]) for k, language in enumerate(sorted(pairs)) for a, b in pairs[language]]
    return spark.createDataFrame(pd.DataFrame(rows, columns=["language", "before", "class"]), "language int, before int, class int")


def judged(tokens: DataFrame) -> DataFrame:
    """``token_rows``, as far as they are wrong or shape the file or are no tokens, with ``wrong`` and the number of brackets (``step``)."""
    pairs = permissible_pairs(tokens.sparkSession).withColumn("permitted", F.lit(True))
    met = tokens.join(F.broadcast(pairs), ["language", "before", "class"], "left")
    no_pair = F.col("before") < 0
    kept = met.filter(no_pair | F.col("permitted").isNull()).withColumn("wrong", ~no_pair).drop("language", "before", "class", "permitted")
    kept = kept.withColumn("depth", F.sum("step").over(Window.partitionBy("row").orderBy("pos")))
    step, mark = F.col("step"), F.col("mark")
    kept = kept.withColumn("level", F.when(step < 0, F.col("depth") + 1).when((step > 0) | (mark > 0), F.col("depth")))
    in_level = Window.partitionBy("row", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("row", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    groups = (BRANCH, CONDITION, LAMBDA, EACH, HEAD)
    kept = kept.withColumns({f"sum{g}": F.sum(F.when(mark == g, F.col("delta")).otherwise(0)).over(in_level) for g in groups})
    begins = {g: F.when(step > 0, F.col(f"sum{g}")) if g in (BRANCH, HEAD) else F.when((step > 0) | (mark == END), F.col(f"sum{g}")) for g in groups}
    kept = kept.withColumns({f"base{g}": F.coalesce(F.last(begins[g], ignorenulls=True).over(earlier), F.lit(0)) for g in groups} | {"opener": F.last(F.when(step != 0, F.struct("bracket", "step")), ignorenulls=True).over(earlier)})
    left = {g: F.col(f"sum{g}") - F.col(f"base{g}") for g in groups}
    opens, opener = F.coalesce(F.col("opener.step") == 1, F.lit(False)), F.coalesce(F.col("opener.bracket"), F.lit(0))
    nests = (F.col("depth") >= 0) & opens & (opener % 5 == F.col("bracket") % 5) & ((opener != FOR_PAREN) | left[HEAD].isin(0, 2))
    ends = (step < 0) | (mark == END)
    wrong = F.col("wrong") | ((step < 0) & ~nests) | ((mark == BRANCH) & (left[BRANCH] < 0)) | ((mark == CASE) & ~(opens & (opener == SWITCH_BRACE))) | (ends & ((left[CONDITION] > 0) | (left[LAMBDA] > 0) | (left[EACH] > 0)))
    return kept.withColumn("wrong", wrong).drop("depth", "level", "opener", "bracket", "mark", "delta", "pos", *(f"{a}{g}" for a in ("sum", "base") for g in groups))


def found(files: DataFrame) -> DataFrame:
    """``(file_id)`` of each file whose content its path's language cannot parse.

    Null and empty contents, null ids and other languages are no case; repeated rows count once.
    """
    verdict = judged(token_rows(files)).groupBy("row", "file_id").agg(F.max("wrong").alias("wrong"), F.sum("step").alias("open"))
    return verdict.filter("wrong or open != 0").select("file_id").distinct()


def rates(files: DataFrame) -> DataFrame:
    """``(graph, language, files, invalid, rate)``: per graph and language, the files with content and those that don't parse."""
    own = files.select("graph", F.col("id").cast("long").alias("file_id"), extension_language(F.col("path")).alias("language")).filter("language is not null and file_id is not null")
    counted = own.join(found(files).withColumn("bad", F.lit(1)), "file_id", "left")
    totals = counted.groupBy("graph", "language").agg(F.count(F.lit(1)).alias("files"), F.count("bad").alias("invalid"))
    return totals.withColumn("rate", F.col("invalid") / F.col("files"))
