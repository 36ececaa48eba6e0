"""Lexers for TypeScript, TSX, JavaScript, Python and Go: state machines that know strings, comments, templates and markup.

A token is ``(kind, text, start)``.  Kinds: ``id``, ``num``, ``str``, ``re``, ``op``, ``com``
(comment), ``tpl`` (a piece of a template between its substitutions), ``tag<`` and ``tag>`` (the
beginning and end of an element in markup), ``txt`` (text in markup), ``nl``, ``in``, ``out`` (Python's
and Go's line ends and Python's indentation), ``conf`` (a merge conflict's marker line) and ``bad``
(a character or an unfinished literal that the language doesn't have).
"""

import re

LANGUAGES = {"ts": "ts", "mts": "ts", "cts": "ts", "tsx": "tsx", "js": "js", "mjs": "js", "cjs": "js", "jsx": "jsx", "py": "py", "pyi": "py", "go": "go"}

Token = tuple[str, str, int]


def language_of(path: str | None) -> str | None:
    """The language that the extension of ``path`` says."""
    return LANGUAGES.get((path or "").rsplit("/", 1)[-1].rpartition(".")[2].lower())


_WORD = r"[A-Za-z_$\u0080-\U0010ffff][\w$\u0080-\U0010ffff]*"
_NUMBER = r"(?:0[xXbBoO][0-9a-fA-F_]+|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9]+)?)[nij]?"
_CONFLICT = r"^(?:<{7}|={7}|>{7}|\|{7})(?=[ \t\r\n]|\Z)[^\n]*"
_ES = re.compile(
    rf"""[ \t\r\n\f\v﻿ ]*(?:(?P<id>[#]?{_WORD})|(?P<conf>{_CONFLICT})|(?P<com>//[^\n]*|/\*[\s\S]*?\*/)|(?P<open>/\*)
    |(?P<str>"(?:[^"\\\n]|\\[\s\S])*"|'(?:[^'\\\n]|\\[\s\S])*')|(?P<num>{_NUMBER})(?![\w$])|(?P<tick>`)
    |(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?![0-9])|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[{{}}()\[\];,<>+\-*/%&|^!~?:=.@])|(?P<bad>[\s\S])|(?P<end>\Z))""",
    re.MULTILINE | re.VERBOSE,
)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(?P<end>`|\$\{)?")
_KIDS = re.compile(r"[^<{]*")
_TAG_START = re.compile(rf"<(?=>|{_WORD})")
_TAG_INNER = re.compile(rf"""(?P<ws>\s+)|(?P<end>/>|>)|(?P<str>"[^"]*"|'[^']*')|(?P<id>{_WORD}(?:[-.:][\w$]+)*)|(?P<op>[={{])|(?P<bad>[\s\S])""")
_TAG_CLOSE = re.compile(rf"</\s*(?:{_WORD}(?:[-.:][\w$]+)*)?\s*>")
#: After these words an operand begins, so that a slash opens a regular expression and an angle bracket an element.
BEFORE_OPERAND = frozenset("return typeof instanceof in of new delete void throw case do else await yield default extends".split())


def _lex_es(text: str, markup: bool) -> list[Token]:
    out: list[Token] = []
    stack: list[str] = []  # "{" plain brace, "${" substitution, "tag" in a tag, "kids" in an element, "{j" braces in markup
    at, size = 0, len(text)
    if text.startswith("#!"):
        at = text.find("\n") if "\n" in text else size
    last, last_text = "op", ";"

    def template(start: int) -> int:
        """Takes in a piece of a template from ``start`` on; where it ends."""
        nonlocal last, last_text
        m = _TEMPLATE.match(text, start + 1)
        if m.group("end") == "${":
            stack.append("${")
            out.append(("tpl", text[start : m.end()], start))
            last, last_text = "op", "("
        elif m.group("end"):
            out.append(("tpl", text[start : m.end()], start))
            last, last_text = "str", ""
        else:
            out.append(("bad", text[start : m.end()], start))
        return m.end()

    while at < size:
        mode = stack[-1] if stack else ""
        if mode == "kids":
            m = _KIDS.match(text, at)
            if m.group().strip():
                out.append(("txt", m.group(), at))
            at = m.end()
            if at >= size:
                break
            if text[at] == "{":
                stack.append("{j")
                out.append(("op", "{", at))
                last, last_text = "op", "{"
                at += 1
            elif m := _TAG_CLOSE.match(text, at):
                stack.pop()
                out.append(("tag>", m.group(), at))
                last, last_text = "tag>", ""
                at = m.end()
            elif m := _TAG_START.match(text, at):
                stack.append("tag")
                out.append(("tag<", "<", at))
                at += 1
            else:
                out.append(("bad", text[at], at))
                at += 1
            continue
        if mode == "tag":
            m = _TAG_INNER.match(text, at)
            kind = m.lastgroup
            if kind == "end":
                stack.pop()
                if m.group() == "/>":
                    out.append(("tag>", "/>", at))
                    last, last_text = "tag>", ""
                else:
                    stack.append("kids")
            elif kind == "op" and m.group() == "{":
                stack.append("{j")
                out.append(("op", "{", at))
                last, last_text = "op", "{"
            elif kind == "bad":
                out.append(("bad", m.group(), at))
            at = m.end()
            continue
        for m in _ES.finditer(text, at):  # until something moves the place or the mode
            kind = m.lastgroup
            token, at = m.group(kind), m.end()
            if kind == "id":
                out.append((kind, token, m.start(kind)))
                last, last_text = kind, token
                continue
            start = m.start(kind)
            if kind == "op":
                if token == "{":
                    stack.append("{")
                elif token == "}":
                    mode = stack.pop() if stack else ""
                    if mode == "${":
                        at = template(start)
                        break
                    if stack and stack[-1] in ("kids", "tag"):
                        out.append((kind, token, start))
                        last, last_text = kind, token
                        break
                elif token in ("/", "/=") or token == "<" and markup:
                    operand = last in ("id", "num", "str", "re", "tag>") and not (last == "id" and last_text in BEFORE_OPERAND) or last == "op" and last_text in (")", "]", "}", "++", "--")
                    if token == "<":
                        if not operand and _TAG_START.match(text, start):
                            stack.append("tag")
                            out.append(("tag<", "<", start))
                            at = start + 1
                            break
                    elif not operand and (r := _REGEX.match(text, start)):
                        out.append(("re", r.group(), start))
                        last, last_text, at = "re", r.group(), r.end()
                        break
                out.append((kind, token, start))
                last, last_text = kind, token
            elif kind == "num" or kind == "str":
                out.append((kind, token, start))
                last, last_text = kind, token
            elif kind == "com" or kind == "conf":
                out.append((kind, token, start))
            elif kind == "tick":
                at = template(start)
                break
            elif kind == "end":
                at = size
                break
            else:
                out.append(("bad", token, start))
                if kind == "open":
                    at = size
                    break
    if any(mode != "{" for mode in stack):
        out.append(("bad", "", size))
    return out


_PY = re.compile(
    rf"""(?:[ \t\f﻿]+|\\\r?\n)*(?:(?P<nl>\r?\n|\r)|(?P<conf>{_CONFLICT})|(?P<com>\#[^\n\r]*)
    |(?P<str>(?:[rRbBuUfF]{{0,2}})(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|"(?!"")(?:[^"\\\n]|\\[\s\S])*"|'(?!'')(?:[^'\\\n]|\\[\s\S])*'))
    |(?P<num>(?!0[0-9_]*[1-9]){_NUMBER}|0[0-9_]*\.[0-9_]*)(?![\w])|(?P<id>[^\W\d]\w*)
    |(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|->|:=|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\*\*|//|<<|>>|[()\[\]{{}},:.;@=+\-*/%&|^~<>])|(?P<bad>[\s\S])|(?P<end>\Z))""",
    re.MULTILINE | re.VERBOSE,
)
_BLOCKS = frozenset("def class if elif else for while with try except finally async match case".split())


def _lex_py(text: str) -> list[Token]:
    out: list[Token] = []
    depth, size = 0, len(text)
    indents: list[tuple[int, str]] = [(0, "")]
    fresh, opener, first, tested = True, "", "", ""
    for m in _PY.finditer(text):
        kind = m.lastgroup
        token, start = m.group(kind), m.start(kind)
        if kind == "end":
            break
        if kind == "com":
            out.append(("com", token, start))
            continue
        if kind == "nl":
            if depth == 0 and not fresh:
                line_end = "nl"
                if out and opener and _last(out) == ":":
                    line_end = "nl:"
                elif first == "@":
                    line_end = "nl@"
                elif first in _BLOCKS and first not in ("match", "case") and ":" not in tested:
                    line_end = "bad"
                out.append((line_end, "\n", start))
                fresh = True
            continue
        if fresh:
            line = text.rfind("\n", 0, start) + 1
            column = len(text[line:start].replace("﻿", "").expandtabs(8))
            closed = ""
            if column > indents[-1][0]:
                out.append(("in", "", start))
                indents.append((column, opener if out[-2:-1] and out[-2][0] in ("nl:", "com") else ""))
            while column < indents[-1][0]:
                closed = indents.pop()[1]
                ok = column <= indents[-1][0]
                if closed == "try" and not (column == indents[-1][0] and token in ("except", "finally")):  # a try needs its sequel
                    ok = False
                out.append(("out" if ok else "bad", "", start))
            if token in ("else", "elif", "except", "finally") and not closed and first not in _BLOCKS and kind == "id" and not (out and _last(out) == ":"):
                out.append(("bad", token, start))
            fresh, first, opener, tested = False, token if kind == "id" or token == "@" else "", "", ""
            if kind == "id" and token in _BLOCKS:
                opener = token
        if kind == "op":
            if token in "([{":
                depth += 1
            elif token in ")]}":
                depth = max(0, depth - 1)
            elif token == ":" and depth == 0:
                tested = ":"
        elif kind == "bad" and token in "\"'":
            out.append(("bad", text[start:], start))
            break
        out.append((kind, token, start))
    if not fresh:
        out.append(("nl:" if opener and _last(out) == ":" else "nl@" if first == "@" else "bad" if first in _BLOCKS and first not in ("match", "case") and ":" not in tested else "nl", "", size))
    while len(indents) > 1:
        out.append(("bad" if indents.pop()[1] == "try" else "out", "", size))
    return out


def _last(out: list[Token]) -> str:
    for kind, token, _ in reversed(out):
        if kind != "com":
            return token
    return ""


_GO = re.compile(
    rf"""[ \t\r\f﻿]*(?:(?P<nl>\n)|(?P<conf>{_CONFLICT})|(?P<com>//[^\n]*|/\*[\s\S]*?\*/)|(?P<open>/\*)
    |(?P<str>"(?:[^"\\\n]|\\.)*"|`[^`]*`|'(?:[^'\\\n]|\\(?:[0-7]{{3}}|x[0-9a-fA-F]{{2}}|u[0-9a-fA-F]{{4}}|U[0-9a-fA-F]{{8}}|.))')|(?P<num>{_NUMBER})(?![\w])|(?P<id>[^\W\d]\w*)
    |(?P<op><<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[{{}}()\[\];,<>+\-*/%&|^!:=.~])|(?P<bad>[\s\S])|(?P<end>\Z))""",
    re.MULTILINE | re.VERBOSE,
)
_GO_LINE_END = frozenset(("break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"))
GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())


def _lex_go(text: str) -> list[Token]:
    out: list[Token] = []
    size, last, last_kind = len(text), "", ""
    for m in _GO.finditer(text):
        kind = m.lastgroup
        token, start = m.group(kind), m.start(kind)
        if kind == "end":
            break
        if kind == "com":
            out.append(("com", token, start))
            if not (token.startswith("/*") and "\n" in token):
                continue
            kind = "nl"
        if kind == "nl":
            if last_kind in ("num", "str") or last_kind == "id" and last not in GO_WORDS or last in _GO_LINE_END:
                out.append(("nl", "\n", start))
                last = last_kind = ""
            continue
        if kind == "open":
            out.append(("bad", token, start))
            break
        out.append((kind, token, start))
        last, last_kind = token, kind
    if last_kind in ("num", "str") or last_kind == "id" and last not in GO_WORDS or last in _GO_LINE_END:
        out.append(("nl", "", size))
    return out


def lex(text: str, language: str) -> list[Token]:
    """The tokens of ``text``, comments included."""
    if language == "py":
        return _lex_py(text)
    if language == "go":
        return _lex_go(text)
    return _lex_es(text, language in ("tsx", "jsx"))
