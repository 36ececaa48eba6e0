import ast
import warnings

import pytest
from conftest import rows

from loomgraph.functions.lexing import language_of, lex
from loomgraph.llm import docpairs, origin, syntax

PY = '''"""Module."""
import os


@retry(3)
async def load(path: str, *, limit=10) -> list:
    """Reads at most ``limit`` rows and closes the file."""
    with open(path) as f:
        return [x for x in f if x][:limit]


class A(Base):
    def __init__(self):
        """Creates the object."""
        try:
            self.x = {"a": 1, **{}}
        except (OSError, ValueError) as e:
            raise RuntimeError(f"{e}") from e
        else:
            pass

    def sum_up(self):
        """Sum up."""
        lambda a, b=2: a if a else b
        return """
<<<<<<< not a marker
def not_real(x):
"""
'''
TS = """import { A, type B } from './a';
import d, * as all from "x";

/** Keeps the newest entry of each key; older ones are dropped. */
export async function pick<T extends object>(rows: Map<string, T>, n = 1): Promise<T[]> {
  const re = /[/"'`]{1,3}/g.test(`a ${rows ? `b ${n}` : '}'} c`);
  if (!re) return [];
  for (const [k, v] of rows) { n += k.length / 2; }
  switch (n) { case 1: return []; default: break; }
  return [...rows.values()].filter((x): x is T => x !== null && (x as any)!.y! < 3);
}

// TODO
export const noDoc = (a: number): number => a * 2;

interface Shape<T> extends Base<T> { readonly a?: string; b(x: number): void; [key: string]: unknown }
type U = | 'a' | { b: () => void } | (new () => U)[];
enum E { A = 1, B }

export abstract class C<T> extends D<T> implements Shape<T> {
  private static cache = new Map<string, number>();
  // Fails when the store is closed.
  constructor(private readonly x: number) { super(); }
  get size(): number { return this.#n ?? 0; }
  #n = 0;
  /** run */
  run = async () => { await this.x; };
  // stop stops
  protected stop(): void {
    label: while (true) { break label }
  }
}
"""
TSX = """const View = ({ a }: { a: string }) => {
  return (
    <section className="x" {...rest}>
      <h2>It's {a ? <b>y</b> : null} here</h2>
      <Other on={() => { go(); }} />
      <></>
    </section>
  );
};
"""
GO = """// Package a does.
package a

import (
	"fmt"
	str "strings"
)

type S struct {
	A int `json:"a"`
	f func(int) (string, error)
}

// Name joins the parts with a dash and lowers them.
func (s *S) Name(parts ...string) (out string, err error) {
	defer func() { _ = recover() }()
	m := map[string][]int{"a": {1, 2}, "b": nil}
	for i, x := range parts {
		if v, ok := m[x]; ok && v != nil {
			out += fmt.Sprintf("%v { %d", x, i)
		} else if i > 3 {
			continue
		}
	}
	switch {
	case len(out) > 0:
		return str.ToLower(out), nil
	default:
	}
	raw := `{ raw
func notReal(x int) {`
	_, r := raw, 'x'
	_ = r
	go func(c chan<- int) { c <- 1 }(nil)
	return
}

// Method.
func Plain[T any](x T) T {
	return x
}
"""
JS = """'use strict'
import a, { b as c } from 'x'
export default class extends a {
  static async *gen() { yield* this.all?.() }
  'quoted'() { return { delete: 1, get x() { return 2 }, async y() {} } }
}
let x = a ? b : c
  , y = `t`
;[x, y] = [y, x]
do { x++ } while (x < 3)
if (x) y(); else { z = /=/.exec(x) }
export const f = async ({ a, b = 1 }, ...rest) => ({ ...a, [b]: rest })
"""
GOOD = {"a.py": PY, "a.ts": TS, "a.tsx": TSX, "a.go": GO, "a.js": JS}
BAD = {
    "conflict.ts": TS.replace("// TODO", "<<<<<<< HEAD\n// TODO\n=======\n>>>>>>> main"),
    "cut.ts": TS[:420],
    "cut.py": PY[:110],
    "nobody.py": "def f(a):\n",
    "try.py": "try:\n    x = 1\n",
    "indent.py": "x = 1\n    y = 2\n",
    "zero.py": "x = 0123\n",
    "quote.py": 'x = "a\n',
    "wrong.py": JS,
    "wrong.js": PY,
    "wrong.ts": GO,
    "wrong.go": TS,
    "markup.ts": TSX,
    "html.js": "<!DOCTYPE html>\n<html></html>\n",
    "prose.ts": "# A note\n\nThis is a note, not code.\n",
    "pointer.go": "version https://x.invalid/spec\noid sha256:12\n",
    "cut.go": GO[:400],
    "bracket.js": "f([1, 2);\n",
    "typed.js": "function f(a: string) { return a }\n",
    "cut2.js": "export const f =",
}
FILES = "graph string, id long, path string, name string, ext string, content string, row int, file_id int"


def frame(spark, files):
    return spark.createDataFrame([("g", k, f"/srv/g/src/{name}", None, None, text, 0, 0) for k, (name, text) in enumerate(files)], FILES)


def test_syntax(spark):
    files = [*GOOD.items(), *BAD.items(), ("null.ts", None), ("empty.py", ""), ("a.md", "# x y"), ("bom.ts", "﻿" + TS), ("crlf.py", PY.replace("\n", "\r\n")), ("long.js", "x = [" + "1, " * 30_000 + "2];"), ("cut.ts", BAD["cut.ts"])]
    df = frame(spark, files)
    got = {r.file_id for r in syntax.found(df.unionByName(df.limit(1))).collect()}
    want = {k for k, (name, text) in enumerate(files) if BAD.get(name) == text and text}
    assert {files[k][0] for k in got ^ want} == set()
    rates = {r.language: (r.files, r.invalid) for r in syntax.rates(df).collect()}
    assert rates["go"] == (4, 3)
    assert syntax.found(df.limit(0)).count() == 0


#: Statements that are no sentence of their language although all their neighbouring tokens are.
UNSOUND = {
    "js": ["try { a(); }", "for (let i = 0; i < 3) {}", "const x;", "if (a) { b(); } else { c(); } else { d(); }", "case 3: a();", "let x = a ? b;", "do { } b();", "f(a ? b, c);", "if (a) { } catch (e) { }", "x = { case: 1, ...{ a ? b } }"],
    "ts": ["try { a(); }", "for (let i = 0; i < 3) {}", "const x;", "else { }", "do { } b();"],
    "py": ["if x = 3:\n    pass", "x = a if b", "f = lambda x", "for x:\n    pass", "def f(a=1, b):\n    pass", "return x = 3", "y = [a if b, c]"],
    "go": ["package p\n\nfunc f() {\n\tvar x\n}", "package p\n\nfunc f() {\n\tfor i := 0; i < 3 {\n\t}\n}", "package p\n\nfunc f(a int b int) {\n}", 'package p\n\nfunc f() {\n}\n\nimport "x"'],
}
SOUND = {
    "js": ["try { a() } catch { b() } finally { c() }", "for (let i = 0; i < 3; i++) {}", "for (;;) {}", "for (const x of y) {}", "for await (const x of y) {}", "if (a) b(); else if (c) d(); else e()", "switch (a ? 1 : 2) { case 3: { b() } default: c() }", "let x = a ? { b: 1 } : c, y = d ? e : f ? g : h", "do { if (a) break } while (b)", "const { a, b: [c] } = d", "x.catch(e => {}).finally(() => {})", "if (a) { try { b() } finally { c() } } else { d() }", "x = { case: 1, if: 2, else: 3 }"],
    "ts": ["declare const x: number", "function f(a?: number, b?) { return a ? b : a }", "type A<B> = B extends string ? 1 : 2", "interface A { b?: string; c?(): void }", "const f = (a?: () => void): void => {}", "let x = a?.b ?? (c ? d : e)"],
    "py": ["x = [a for a in b if a if not c]", "f(a if b else c for a in d if e)", "f = lambda a, b=1, *c: a if b else c", "def f(a, b=1, *c, d, e=2, **g):\n    return (lambda x=1: x)", "for a, b in c: pass\nelse: pass", "match x:\n    case [a] if a:\n        pass", "if (y := x) == 3: pass", "async def f(a: int = 1, *, b): return [x async for x in a]", "x = {k: lambda: v for k, v in d.items()}", "while a: b(c=1)"],
    "go": ["package p\n\nvar x int\n\nfunc f(a, b int, c ...string) (d int, e error) {\n\tvar y = 1\n\tfor i := 0; i < 3; i++ {\n\t}\n\tfor {\n\t}\n\tfor _, c := range []struct{ a int }{{1}} {\n\t}\n\treturn\n}", "package p\n\nfunc (r *T) F(a map[string]int, f func(int) error) chan int {\n\tvar (\n\t\ta int\n\t)\n\treturn nil\n}"],
}


def test_productions(spark):
    files = [(f"{k}.{ext}", text, bad) for bad, texts in ((True, UNSOUND), (False, SOUND)) for ext, own in texts.items() for k, text in enumerate(own)]
    got = {r.file_id for r in syntax.found(frame(spark, [(name, text) for name, text, _ in files])).collect()}
    assert {files[k][:2] for k in got ^ {k for k, file in enumerate(files) if file[2]}} == set()


def test_python_agrees_with_its_parser(spark):
    warnings.simplefilter("ignore")
    lines = PY.split("\n")
    variants = [PY] + ["\n".join(lines[:k] + lines[k + 1 :]) for k in range(len(lines))] + [PY[:k] for k in range(5, len(PY), 23)]
    wanted = set()
    for k, text in enumerate(variants):
        try:
            ast.parse(text)
        except SyntaxError:
            wanted.add(k)
    got = {r.file_id for r in syntax.found(frame(spark, [(f"{k}.py", t) for k, t in enumerate(variants)])).collect()}
    assert len(got ^ wanted) <= 0.04 * len(variants), sorted(got ^ wanted)


def test_pairs(spark):
    files = [*GOOD.items(), ("bad.ts", BAD["cut.ts"]), ("null.ts", None), ("copy.py", PY)]
    got = rows(docpairs.found(frame(spark, files)))
    names = [name for name, _ in files]
    assert [(names[f], name, line) for f, name, line in got] == [
        ("a.py", "load", 5),
        ("a.ts", "constructor", 22),
        ("a.ts", "pick", 4),
        ("a.go", "Name", 14),
        ("copy.py", "load", 5),
    ]
    pick = docpairs.pairs(frame(spark, files)).filter("name = 'pick'").collect()[0]
    assert pick.label == "Function" and pick.doc.startswith("Keeps the newest") and pick.code.endswith("}")
    assert docpairs.found(frame(spark, files).limit(0)).count() == 0


@pytest.mark.parametrize(
    "name, doc, is_trivial",
    [
        ("loadRows", "/** */", True),
        ("loadRows", "// TODO: say more", True),
        ("loadRows", "/** Load rows. */", True),
        ("loadRows", "// loadRows loads the rows", True),
        ("loadRows", "// --------", True),
        ("loadRows", "/** @returns {string} */", True),
        ("loadRows", "// eslint-disable-next-line", True),
        ("loadRows", "// const x = load(1);", True),
        ("loadRows", "// Helper.", True),
        ("loadRows", "/** Load rows.\n * Not reentrant.\n */", False),
        ("loadRows", "/** @param n how many bytes to keep */", False),
        ("load_rows", "Skips rows whose checksum is stale.", False),
    ],
)
def test_trivial(name, doc, is_trivial):
    assert docpairs.trivial(name, doc, {"n"}) is is_trivial


STUBS = "".join(f"export function get{n}(msg: any) {{\n  return msg.fields[{k}];\n}}\n\n" for k, n in enumerate("Alpha Beta Gamma Delta Epsilon Zeta Eta Theta".split()))


@pytest.mark.parametrize(
    "path, text, why",
    [
        ("/home/build/out/g/src/a.ts", TS, ""),
        ("/srv/g/vendor/x/a.ts", TS, "vendored"),
        ("/srv/g/vendors/x/a.ts", TS, ""),
        ("/srv/g/node_modules/x/a.ts", None, "vendored"),
        ("/srv/g/.next/server/a.js", "", "built"),
        ("/srv/g/src/a.ts", "", ""),
        ("/srv/g/src/a.ts", None, ""),
        ("/srv/g/src/a.go", "// Code generated by x. DO NOT EDIT.\n\n" + GO, "generated"),
        ("/srv/g/src/a.py", PY + 'BANNER = "Code generated by x. DO NOT EDIT."\n', ""),
        ("/srv/g/src/a.ts", "// Generated files must not import from here.\n" + TS, ""),
        ("/srv/g/src/a.py", "# Copied from the foo project, release 1.2.3. Local changes: none.\n" + PY, "vendored"),
        ("/srv/g/src/a.js", "!function(t,e){" + "function a(x,e){return x&&e?x.b(e):1}var c=2,d=[1,2];" * 30 + "}();", "minified"),
        ("/srv/g/src/a.ts", STUBS, "generated"),
        ("/srv/g/src/a.py", "TABLE = [\n" + "    1, 2, 3, 4, 5, 6, 7, 8, 9, 10,\n" * 80 + "]\n", "data"),
        ("/srv/g/src/a.py", PY + "STEPS = [\n" + "    1, 2, 3,\n" * 20 + "]\n", ""),
        ("/srv/g/src/minify_helper.py", PY, ""),
    ],
)
def test_origin(path, text, why):
    assert origin.origin("g", path, text) == why


def test_origin_rows(spark):
    df = spark.createDataFrame([("g", 1, "/s/g/a.ts", TS, 0), ("g", 2, "/s/g/dist/a.ts", None, 0), (None, 3, "/s/g/gen/a.ts", TS, 0), ("g", None, "/x", TS, 0), ("g", 4, None, TS, 0), ("g", 2, "/s/g/dist/a.ts", None, 0)], "graph string, id long, path string, content string, origin int")
    assert rows(origin.found(df)) == [(2,), (3,)]
    assert sum(r.files for r in origin.report(df).collect()) == 4
    assert origin.found(df.limit(0)).count() == 0


def test_canonical_lines():
    lines = lambda name, text: list(origin.canonical_lines(lex(text, language_of(name)), language_of(name)))
    assert lines("a.js", "for(let i=0;i<3;i++){a();b()}// c") == ["for ( let i = 0 ; i < 3 ; i ++ ) {", "a ( ) ;", "b ( )", "}"]
    assert lines("a.py", "if a: b=1;c={'x':2}\nd = [\n  1]\n") == ["if a :", "b = 1 ;", "c = { 'x' : 2 }", "d = [ 1 ]"]
    assert origin.origin("g", "/r/g/a.py", "a=1;b=2;c=3;d=f(a,b,c);" * 40 + "\nif a: b=1;c=2\n") == "minified"
    assert lines("a.ts", "") == []
