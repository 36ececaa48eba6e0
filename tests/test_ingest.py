import os

import pytest
from conftest import rows

from loomgraph.operators import ingest, typescript
from loomgraph.plans.lineage import cut
from loomgraph.sources import files


def ingest_texts(spark, stored, texts, now):
    docs = spark.createDataFrame(list(texts.items()), "source string, text string")
    chunks, report = ingest.reingest(stored, docs, now, cut)
    return chunks, {(r.source, r.action): r["count"] for r in report.collect()}


def test_edits_renames_and_deletions(spark):
    stored = spark.createDataFrame([], ingest.CHUNKS)
    stored, did = ingest_texts(spark, stored, {"b.md": "# B\nother\n", "a.md": "# Fixture\n\n## Setup\n\nfirst\n\n## Teardown\n\nlast\n"}, 1)
    assert did == {("a.md", "created"): 2, ("b.md", "created"): 1}
    assert rows(stored, "id", "source", "breadcrumb") == [(1, "a.md", "Fixture > Setup"), (2, "a.md", "Fixture > Teardown"), (3, "b.md", "B")]
    assert all(len(r.vector) == ingest.DIM for r in stored.collect())
    # an edit keeps the id; a rename, too; what is gone is orphaned; the other source isn't touched
    stored, did = ingest_texts(spark, stored, {"a.md": "# Fixture\n\n## Setup\n\nedited\n"}, 2)
    assert did == {("a.md", "updated"): 1, ("a.md", "orphaned"): 1}
    assert rows(stored, "id", "content", "orphaned_at") == [(1, "edited", None), (2, "last", 2), (3, "other", None)]
    stored, did = ingest_texts(spark, stored, {"a.md": "# Fixture\n\n## Arrangement\n\nedited\n\n## New\n\nmore\n"}, 3)
    assert did == {("a.md", "renamed"): 1, ("a.md", "created"): 1}
    assert rows(stored, "id", "breadcrumb", "orphaned_at") == [(1, "Fixture > Arrangement", None), (2, "Fixture > Teardown", 2), (3, "B", None), (4, "Fixture > New", None)]
    # unchanged: nothing is written; a file without chunks leaves the stored ones alone
    stored, did = ingest_texts(spark, stored, {"a.md": "\n\n# Fixture\n\n## Arrangement\n\nedited\n\n## New\n\nmore\n", "b.md": "# B\n"}, 4)
    assert did == {("a.md", "unchanged"): 2}
    assert stored.filter("id = 3 and orphaned_at is null").count() == 1


def test_growing_oversized_keeps_the_vector(spark):
    stored, _ = ingest_texts(spark, spark.createDataFrame([], ingest.CHUNKS), {"a.md": "short"}, 1)
    vector = stored.collect()[0].vector
    stored, _ = ingest_texts(spark, stored, {"a.md": "long " * 2000}, 2)
    assert stored.collect()[0].oversized and stored.collect()[0].vector == vector


def test_walks(spark, tmp_path):
    for name, text in {"a.md": "x", "sub/B.MD": "y", "node_modules/c.md": "z", "sub/d.txt": "t", "sub/e.ts": "const a = 1", "sub/F.TS": ""}.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_text(text)
    found = files.markdown(spark, str(tmp_path))
    assert sorted(os.path.relpath(r.source, tmp_path) + "=" + r.text for r in found.collect()) == ["a.md=x", "sub/B.MD=y"]
    assert files.typescript(spark, str(tmp_path)).count() == 1
    with pytest.raises(FileNotFoundError):
        files.markdown(spark, str(tmp_path / "missing"))
    os.makedirs(tmp_path / "repo" / ".git")
    assert files.repository_of(str(tmp_path / "repo" / "x")) == "repo"
    os.makedirs(tmp_path / "other" / ".git")
    with pytest.raises(ValueError):
        files.common_repository([str(tmp_path / "repo"), str(tmp_path / "other")])


SOURCE = """import { X } from './x';

/** Doc of a. */
function a(p: Shape, q?: number): Promise<Result> {
  b(p);
  const inner = () => { hidden(); };
  return q.run<T>(1);
}

// lost by export
export const b = async (n: Thing): Result => a(n, c());

export class C<T> extends Base<T> implements Shape, Other {
  field = make();
  // builds
  constructor(private x: Thing) { super(); this.go(); }
  get size(): number { return 1; }
  overload(a: string): void;
  overload(a: any): void { new Foo(); bar(); }
}
interface I extends J, K<number> { m(): void }
type U = A | B;
enum E { A }
abstract class Z { m() { n(); } }
"""


def test_typescript(spark):
    df = spark.createDataFrame([("g", 1, "/s/a.ts", SOURCE), ("g", 2, "/s/b.ts", None), ("g", 3, "/s/c.py", SOURCE), ("g", 4, "/s/d.tsx", "")], "graph string, id long, path string, content string")
    found, named = typescript.analysed(df)
    found = found.orderBy("ord").collect()
    got = [(r.label, r.name, r.parent_name, r.src_start, r.src_end) for r in found]
    assert got[:9] == [
        ("Function", "a", "", 3, 7),
        ("Function", "b", "", 10, 10),
        ("Class", "C", "", 12, 19),
        ("Constructor", "constructor", "C", 15, 15),
        ("Method", "size", "C", 16, 16),
        ("Method", "overload", "C", 18, 18),
        ("Interface", "I", "", 20, 20),
        ("Interface", "U", "", 21, 21),
        ("Enum", "E", "", 22, 22),
    ]
    assert [r.doc for r in found][:4] == ["/** Doc of a. */", "", "", "// builds"]
    refs = {(r.ord, r.kind, r.name) for r in named.collect()}
    assert {(0, "parameters", "Shape"), (0, "return_type", "Promise"), (0, "call", "b"), (0, "call", "run"), (1, "parameters", "Thing"), (1, "return_type", "Result")} <= refs
    assert {(2, "base_class", "Base"), (2, "implement_interface", "Shape"), (2, "implement_interface", "Other"), (3, "call", "go"), (5, "call", "bar"), (6, "extend_interface", "J"), (6, "extend_interface", "K")} <= refs
    assert not {(0, "call", "hidden"), (1, "call", "a"), (5, "call", "Foo")} & refs


HARD = """const plain = 1
const generic = async <T,>(a: T, b?: Map<string, Shape>): Promise<Map<string, T>> => {
  const inner = class { m() { hidden() } }
  return pick<T, Shape>(a < 3, { short() { hidden() } }, other?.(b), last())
}
const whole = (x: Shape | null) => chain(x).tail(y)
const half = (x) => await chain(x)
function lost(a: string): void
export default async function* kept([p]: Shape, { q }: Other = make()): A | B { if (p) { yield* go() } }
interface Sig { call(a: Shape): void; other: number }
const enum Kind { A = f() }
type Long<T> =
  | A
  | B<T>
class D extends ns.Base implements I<X>, J {
  @Deco() @Other static async *walk<T>(x: T = seed()): Shape { step() }
  cb = () => { hidden() }
  value = first(second())
  gone(a: string): void
  "quoted name"() { `${inTemplate()}` }
  open() { tail(
"""


def test_typescript_of_hard_and_broken_files(spark):
    extra = "graph string, id long, path string, content string, n int, text string, scope string"
    df = spark.createDataFrame([("g", 1, "/s/a.ts", HARD, 1, "x", "y"), ("g", 1, "/s/a.ts", HARD, 1, "x", "y"), (None, 2, "/s/b.ts", ")}] function f() { g() } class", None, None, None), ("g", 3, "/s/C.ts", None, 1, "", "")], extra)
    found, named = typescript.analysed(df)
    assert rows(found.filter("file_id = 1"), "ord", "label", "name", "parent_ord", "src_start", "src_end") == [
        (0, "Function", "generic", -1, 1, 4),
        (1, "Function", "whole", -1, 5, 5),
        (2, "Function", "half", -1, 6, 6),
        (3, "Function", "kept", -1, 8, 8),
        (4, "Interface", "Sig", -1, 9, 9),
        (5, "Enum", "Kind", -1, 10, 10),
        (6, "Interface", "Long", -1, 11, 13),
        (7, "Class", "D", -1, 14, 20),
        (8, "Method", "walk", 7, 15, 15),
        (9, "Method", '"quoted name"', 7, 19, 19),
        (10, "Method", "open", 7, 20, 20),
    ]
    assert rows(found.filter("file_id = 2"), "graph", "name") == [(None, "f")]
    assert rows(named.filter("file_id = 1"), "ord", "kind", "name") == [
        (0, "call", "last"), (0, "call", "pick"), (0, "parameters", "Map"), (0, "parameters", "T"), (0, "return_type", "Promise"),
        (1, "call", "chain"), (2, "call", "chain"), (3, "call", "go"), (3, "parameters", "Other"), (3, "parameters", "Shape"),
        (7, "call", "first"), (7, "call", "second"), (7, "implement_interface", "I"), (7, "implement_interface", "J"),
        (8, "call", "step"), (8, "parameters", "T"), (8, "return_type", "Shape"), (9, "call", "inTemplate"), (10, "call", "tail"),
    ]
    none, no_references = typescript.analysed(df.limit(0))
    assert none.count() == 0 and no_references.count() == 0


def test_edges_from_definitions(spark):
    found = spark.createDataFrame([("g", 1, "p", 0, "call", "f", 4, 2), ("g", 1, "p", 0, "call", "f", 6, 2), ("g", 1, "p", 0, "return_type", "T", 3, 9), ("g", 1, "p", 0, "call", "far", 7, 1)], "graph string, file_id long, path string, ord int, kind string, name string, line int, col int")
    definitions = spark.createDataFrame([("g", "p", 4, 2, "q", 12), ("g", "p", 6, 2, "q", 12), ("g", "p", 3, 9, "q", 1)], "graph string, path string, line int, col int, target_path string, target_line int")
    ids = spark.createDataFrame([("g", 1, "p", 0, 50, 0, 9), ("g", 2, "q", 0, 60, 0, 20), ("g", 2, "q", 1, 61, 10, 15)], "graph string, file_id long, path string, ord int, entity_id long, src_start int, src_end int")
    assert rows(typescript.edges(found, definitions, ids)) == [("g", "CALLS", 50, 61, 6), ("g", "RETURNS", 50, 60, 3)]
