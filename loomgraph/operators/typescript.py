"""TypeScript sources into entities and the references between them.

A small helper per file only lexes; tokens are rows, and brackets, declarations, their extents and
what they refer to are found by windows over the tokens of a file.  Declarations count at the top of a
file and, as methods, in the bodies of the classes there.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.functions.lexing import language_of, lex
from loomgraph.plans.lineage import cut

# Words of the language.
_MODIFIERS = "public private protected static readonly async override abstract accessor get set declare".split()
_STATEMENT_WORDS = "if for while switch catch with return function typeof await new delete void throw super import in of instanceof case else do yield".split()
_UNARY_WORDS = "await new typeof void delete yield as satisfies in instanceof".split()
_INFIX_WORDS = "in instanceof as satisfies extends is of".split()
#: Types that the language has itself and that name no entity, and words that begin a type which is no plain name.
_NO_NAMES = "any unknown never void null undefined string number boolean bigint symbol object this true false keyof typeof readonly new infer asserts unique".split()
#: From what kind of reference an edge of which type comes.
RELATIONS = {"call": "CALLS", "base_class": "EXTENDS", "implement_interface": "IMPLEMENTS", "extend_interface": "EXTENDS", "return_type": "RETURNS", "parameters": "PARAMETERS"}

_TOKENS = "file_id long, n int, kind string, text string, line int, col int, last_line int, doc string"
_WHOLE = (Window.unboundedPreceding, Window.unboundedFollowing)


def _lexed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [column.split()[0] for column in _TOKENS.split(", ")]
    for batch in batches:
        for file, path, text in zip(batch["file_id"], batch["path"], batch["content"]):
            rows, line, at, doc = [], 0, 0, ""
            for kind, token, start in lex(text, language_of(path) or "ts"):
                if kind == "com":
                    doc = token
                    continue
                line, at = line + text.count("\n", at, start), start
                rows.append((file, len(rows), kind, token if kind in ("id", "op", "str") else "", line, start - text.rfind("\n", 0, start) - 1, line + token.count("\n"), doc))
                doc = ""
            yield pd.DataFrame(rows, columns=names)


def _is(column: str, *texts: str) -> Column:
    """Whether a column has one of the texts; a null has none."""
    return F.coalesce(F.col(column).isin(*texts), F.lit(False))


def _op(*texts: str) -> Column:
    return (F.col("kind") == "op") & F.col("text").isin(*texts)


def tokens(files: DataFrame) -> DataFrame:
    """The tokens of every ``.ts`` and ``.tsx`` file but comments and closing brackets, each with its place among brackets.

    ``scope`` is the number of the bracket that a token stands in (-1: none), ``close_n`` where a
    bracket closes (one that nothing closes does at the end); ``before`` and ``after`` are the neighbours in the same scope, so that a bracket
    with all its content is one neighbour.  ``doc`` is the comment right before a token.  Rows with one
    ``id`` are one file.
    """
    read = files.select(F.col("id").cast("long").alias("file_id"), "path", "content").filter("content is not null and content != ''")
    rows = read.filter(F.col("path").rlike(r"\.tsx?\z")).dropDuplicates(["file_id"]).mapInPandas(_lexed, _TOKENS)
    rows = rows.withColumns({"opens": _op("(", "[", "{"), "closes": _op(")", "]", "}")})
    file = Window.partitionBy("file_id").orderBy("n")
    opens, closes = F.col("opens").cast("int"), F.col("closes").cast("int")
    rows = rows.withColumns({"level": F.sum(opens - closes).over(file) - opens, "begins": (F.col("n") == 0) | F.lag("opens", 1, False).over(file) & ~F.col("closes")})
    level = Window.partitionBy("file_id", "level").orderBy("n")
    closed = F.col("opens") & F.coalesce(F.lead("closes").over(level), F.lit(False))
    rows = rows.withColumns(
        {
            "close_n": F.when(closed, F.lead("n").over(level)).when(F.col("opens"), F.max("n").over(file.rowsBetween(*_WHOLE)) + 1),
            "close_line": F.when(closed, F.lead("line").over(level)).when(F.col("opens"), F.max("last_line").over(file.rowsBetween(*_WHOLE))),
            "scope": F.coalesce(F.last(F.when(F.col("begins"), F.col("n") - 1), True).over(level), F.lit(-1)),
        }
    ).filter("not closes")
    rows = rows.withColumns({"end_n": F.coalesce("close_n", "n"), "end_line": F.coalesce("close_line", "last_line")})
    scope = Window.partitionBy("file_id", "scope").orderBy("n")
    columns = {"before": ("text", 1), "before2": ("text", 2), "before3": ("text", 3), "before_kind": ("kind", 1), "before2_kind": ("kind", 2), "before_line": ("end_line", 1)}
    rows = rows.withColumns({name: F.lag(c, k).over(scope) for name, (c, k) in columns.items()} | {"after": F.lead("text").over(scope), "after2": F.lead("text", 2).over(scope), "after_kind": F.lead("kind").over(scope)})
    # a line that begins something new: neither the token before it nor its first one asks for more
    operand = (F.col("before_kind") != "op") & ~F.col("before").isin([word for word in _UNARY_WORDS if word != "void"]) | F.col("before").isin("(", "[", "{", ">", ">>")
    new_line = F.coalesce(F.col("before_line") < F.col("line"), F.lit(False)) & operand & ((F.col("kind") != "op") & ~F.col("text").isin(_INFIX_WORDS) | _op("@", "++", "--"))
    return rows.withColumn("new_line", new_line).drop("opens", "closes", "begins", "close_line", "last_line")


def _member(modifier: Column) -> Column:
    """Where a method's name can stand in a class: followed by parameters, and at the beginning of a member."""
    decorated = _is("before2", "@") & (F.col("before_kind") == "id") | _is("before", "(") & _is("before3", "@")
    begins = F.col("before").isNull() | _is("before", ";", "{") | modifier | F.col("new_line") | decorated
    return F.col("kind").isin("id", "str") & _is("after", "(", "<") & begins


def _heads(rows: DataFrame) -> DataFrame:
    """The tokens from each possible declaration to the next, without type arguments, with what that declaration is made of."""
    rows = rows.filter("level <= 1")
    top = F.col("scope") == -1
    scope = Window.partitionBy("file_id", "scope").orderBy("n")
    modifies = F.when(top, F.col("text").isin("async", "const")).otherwise(F.col("text").isin(*_MODIFIERS) | _op("*"))
    rows = rows.withColumn("modifies", modifies).withColumn("modified", F.lag("modifies", 1, False).over(scope))
    own = F.struct("n", "line", "doc")
    first = F.last(F.when(F.col("modifies") & ~F.col("modified"), own), True).over(scope.rowsBetween(Window.unboundedPreceding, -1))
    statement = F.col("before").isNull() | _is("before", ";", "{", "export", "default", "declare", "async", "const") | F.col("new_line")
    word, named = F.col("text"), F.coalesce(F.col("after_kind") == "id", F.lit(False))
    declares = (
        (word == "function") & (named | _is("after", "*"))
        | word.isin("class", "interface", "enum") & named & ~_is("after", "extends", "implements")
        | (word == "type") & named & _is("after2", "=", "<")
        | word.isin("const", "let") & ~_is("after", "enum")
    )
    starts = F.when(top, (F.col("kind") == "id") & statement & declares).otherwise(_member(F.col("modified")))
    rows = rows.withColumns({"first": F.when(F.col("modified"), first).otherwise(own), "starts": starts})
    rows = rows.withColumn("part", F.sum(F.col("starts").cast("int")).over(scope)).filter("part > 0")
    part = Window.partitionBy("file_id", "scope", "part").orderBy("n")
    rows = rows.withColumn("angle", _angle()).withColumn("angles", F.sum("angle").over(part)).filter("angle = 0 and angles = 0")
    rows = rows.withColumns({"prior": F.lag("text").over(part), "prior2": F.lag("text", 2).over(part), "prior2_n": F.lag("n", 2).over(part), "word": F.when(top, F.first("text").over(part)).otherwise("method")})
    rows = rows.withColumns({name: F.lead(c, k).over(part) for name, (c, k) in {"next": ("text", 1), "next2": ("text", 2), "next3": ("text", 3), "next_n": ("n", 1), "next2_n": ("n", 2), "next_kind": ("kind", 1), "next2_kind": ("kind", 2)}.items()})
    here = F.struct("n", "end_n", "end_line")
    ends = _op(";") | F.col("next").isNull() | _is("next", ",") | F.coalesce(F.lead("new_line").over(part), F.lit(False))
    backwards = Window.partitionBy("file_id", "scope", "part").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"here": here, "ends": ends})
    rows = rows.withColumn("end", F.last(F.when(F.col("ends"), F.col("here")), True).over(backwards))
    # an arrow's last token: the end of its block and a semicolon after it, or the end of the statement
    block = F.when(_is("next2", ";"), F.lead("here", 2).over(part)).otherwise(F.lead("here").over(part))
    rows = rows.withColumn("arrow_end", F.when(_op("=>"), F.when(_is("next", "{"), block).otherwise(F.lead("end").over(part))))
    whole = part.rowsBetween(*_WHOLE)

    def at(condition: Column, value) -> Column:
        return F.min(F.when(condition, value)).over(whole)

    n = F.col("n")
    later = (F.col("next") == "async") & (F.col("next2") != "=>")
    takes, then = F.when(later, F.col("next2")).otherwise(F.col("next")), F.when(later, F.col("next3")).otherwise(F.col("next2"))
    takes_kind, takes_n = F.when(later, F.col("next2_kind")).otherwise(F.col("next_kind")), F.when(later, F.col("next2_n")).otherwise(F.col("next_n"))
    arrow = F.struct(takes.alias("takes"), takes_kind.alias("kind"), F.when(takes == "(", takes_n).alias("params"), then.alias("then"))
    variable = F.col("word").isin("const", "let")
    rows = rows.withColumn("equals", at(_op("="), n))
    rows = rows.withColumns({"value": at(n == F.col("equals"), F.struct("n", arrow.alias("arrow"))), "arrow_n": at(_op("=>") & (n > F.col("equals")), n)})
    rows = rows.withColumn("params", F.when(variable, F.col("value.arrow.params")).when(F.col("word").isin("function", "method"), at(_op("("), n)))
    function = F.col("word").isin("function", "method")
    past = n > F.when(function, F.col("params")).when(variable, F.col("equals")).otherwise(F.lit(-1))
    rows = rows.withColumns({"body": at(_op("{") & past & (~function | ~_is("prior", ":", "|", "&")), F.col("here")), "semicolon": at(_op(";") & past, n), "result": at(n == F.col("params"), F.col("next")), "arrow_last": at(n == F.col("arrow_n"), F.col("arrow_end"))})
    return rows.withColumns({"variable": variable, "function": function})


def _angle() -> Column:
    """What a token adds to the depth of type arguments."""
    return F.when(_op("<"), 1).when(_op(">"), -1).when(_op(">>"), -2).when(_op(">>>"), -3).otherwise(0)


def _declared(heads: DataFrame) -> DataFrame:
    """One row for each entity: its numbering, label, name, parent, lines and comment, and the tokens that its references are found by."""
    before_semicolon = lambda n: F.col("semicolon").isNull() | (F.col("semicolon") > n)
    takes = F.col("value.arrow")
    is_arrow = (takes.then == "=>") & ((takes.takes == "(") | (takes.kind == "id")) | (takes.takes == "(") & (takes.then == ":") & before_semicolon(F.col("arrow_n"))
    has_body = F.when(F.col("function"), F.col("body").isNotNull() & F.col("result").isin("{", ":") & before_semicolon(F.col("body.n")))
    kept = has_body.when(F.col("variable"), (F.col("next_kind") == "id") & is_arrow & F.col("arrow_last").isNotNull()).when(F.col("word") == "type", F.lit(True)).otherwise(F.col("body").isNotNull())
    label = F.when(F.col("word") == "method", F.when(F.col("text") == "constructor", "Constructor").otherwise("Method")).when(F.col("word").isin("interface", "type"), "Interface").when(F.col("word") == "class", "Class").when(F.col("word") == "enum", "Enum").otherwise("Function")
    found = heads.filter("starts").filter(F.coalesce(kept, F.lit(False))).select(
        "file_id", "n", "scope", label.alias("label"), "params",
        F.when(F.col("word") == "method", F.col("text")).when(F.col("next") == "*", F.col("next2")).otherwise(F.col("next")).alias("name"),
        F.col("first.line").alias("src_start"), F.col("first.doc").alias("doc"),
        F.when(F.col("variable"), F.col("arrow_last.end_line")).when(F.col("word") == "type", F.col("end.end_line")).otherwise(F.col("body.end_line")).alias("src_end"),
        F.when(F.col("variable"), F.col("arrow_n")).when(F.col("function"), F.col("body.n")).otherwise(F.col("n")).alias("holder"),
        F.col("body.n").alias("body_n"),
    )
    classes = found.filter("label = 'Class'").select("file_id", F.col("body_n").alias("scope"), F.col("name").alias("parent_name"))
    kept = found.join(classes, ["file_id", "scope"], "left").filter("scope = -1 or parent_name is not null")
    order = Window.partitionBy("file_id").orderBy("n")
    kept = kept.withColumn("ord", F.row_number().over(order) - 1)
    parent = F.last(F.when(F.col("label") == "Class", F.col("ord")), True).over(order)
    return kept.withColumns({"parent_ord": F.when(F.col("scope") == -1, -1).otherwise(parent), "parent_name": F.coalesce("parent_name", F.lit(""))})


def _calls(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Calls by the innermost function, arrow function or class that they stand in, where that is an entity."""
    found = found.filter(F.col("label").isin("Function", "Method", "Constructor", "Class"))
    scope = Window.partitionBy("file_id", "scope").orderBy("n")
    following = Window.partitionBy("file_id", "scope").orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.last(F.when(_op(",", ";") | F.col("new_line"), F.col("n")), True).over(following)
    brace = F.last(F.when(_op("{") & ~_is("before", ":", "|", "&"), F.struct("n", "close_n")), True).over(following)
    rows = rows.withColumns({"breaks": breaks, "brace": brace, "scope_end": F.max("end_n").over(scope.rowsBetween(*_WHOLE)), "after_end": F.lead("end_n").over(scope), "after_close": F.lead("close_n").over(scope)})
    # type arguments of a call: what stands behind the bracket that closes them
    angles = Window.partitionBy("file_id", "scope", "angle_level").orderBy("n")
    rows = rows.withColumn("angle_level", F.sum(_angle()).over(scope) - _op("<").cast("int"))
    rows = rows.withColumn("behind", F.when(_op("<") & F.coalesce(F.lead("text").over(angles).startswith(">"), F.lit(False)), F.lead("after").over(angles)))
    generic = _is("after", "<") & F.coalesce(F.lead("behind").over(scope) == "(", F.lit(False))
    word = F.col("kind") == "id"
    call = word & (_is("after", "(") & ~_is("after2", "{") | generic) & (~F.col("text").isin(*_STATEMENT_WORDS) | _is("before", ".", "?.")) & ~_is("before", "new", "function", "@")
    declares = (F.col("level") == 1) & _member(_is("before", *_MODIFIERS, "*")) & ~F.col("in_value")  # in a class: a method without a body
    # calls that are an arrow function's whole value: no operator between the arrow and them, and nothing behind them
    operators = F.sum((~_op(".", "?.", "(", "[") & ((F.col("kind") == "op") | F.col("text").isin(*_UNARY_WORDS))).cast("int")).over(scope)
    arrow_end = F.when(_is("after", "{"), F.col("after_close")).otherwise(F.coalesce(F.col("breaks") - 1, F.col("scope_end")))
    statements = F.sum((_op(";") | F.col("new_line")).cast("int")).over(scope)
    values = F.sum(_op("=").cast("int")).over(Window.partitionBy("file_id", "scope", "statement").orderBy("n"))
    rows = rows.withColumn("statement", statements).withColumn("in_value", values > 0)
    rows = rows.withColumns({"operators": operators, "arrow_end": F.when(_op("=>"), arrow_end), "call": call, "declares": declares})
    arrow = F.last(F.when(_op("=>"), F.struct("n", "operators", "arrow_end")), True).over(scope)
    rows = rows.withColumn("arrow", arrow)
    marks = found.select("file_id", F.explode(F.array("holder", "params")).alias("n")).filter("n is not null").distinct().withColumn("marked", F.lit(True))
    rows = rows.join(marks, ["file_id", "n"], "left")
    method = _op("{") & _is("before", "(") & (F.col("before2_kind") == "id") & ~_is("before2", *_STATEMENT_WORDS)
    nested = word & (F.col("text") == "function") | word & (F.col("text") == "class") & ~_is("before", ".", "?.") | method | _op("=>") | F.col("marked")
    last = F.when(_op("=>"), F.col("arrow_end")).when(word, F.col("brace.close_n")).otherwise(F.col("close_n"))
    rows = rows.withColumn("last", F.when(F.coalesce(nested, F.lit(False)), last)).select("file_id", "n", "text", "line", "col", "call", "declares", "arrow", "operators", "after_end", "last")
    # every nested extent adds one from its first token on, until after its last
    own = F.struct(F.col("n").alias("pos"), F.lit(1).alias("step"), F.col("last").isNotNull().cast("int").alias("delta"))
    done = F.struct((F.col("last") + 1).alias("pos"), F.lit(0).alias("step"), F.lit(-1).alias("delta"))
    rows = rows.withColumn("event", F.explode(F.when(F.col("last").isNotNull(), F.array(own, done)).otherwise(F.array(own)))).select("*", "event.*")
    rows = rows.withColumn("depth", F.sum("delta").over(Window.partitionBy("file_id").orderBy("pos", "step")))
    holder = F.last(F.when(F.col("delta") == 1, F.col("n")), True).over(Window.partitionBy("file_id", "depth").orderBy("pos", "step"))
    calls = rows.withColumn("holder", holder).filter("step = 1 and call")
    whole = (F.col("arrow.n") == F.col("holder")) & (F.col("arrow.operators") == F.col("operators")) & (F.col("arrow.arrow_end") == F.col("after_end"))
    calls = calls.filter(~F.coalesce(whole, F.lit(False))).select("file_id", "holder", F.col("text").alias("name"), "line", "col", "n", "declares")
    owned = calls.join(found.select("file_id", "holder", "ord", "label", "body_n"), ["file_id", "holder"]).filter("label != 'Class' or n > body_n and not declares")
    return owned.select("file_id", "ord", F.lit("call").alias("kind"), "name", "line", "col")


def _type_name(after: str) -> Column:
    """Whether a type is a plain or generic name that isn't the language's own."""
    return (F.col("kind") == "id") & ~F.col("text").isin(*_NO_NAMES) & ~_is(after, ".", "|", "&", "[", "is")


def _parameters(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The types of parameters: what follows the first colon of each, before any default value."""
    lists = found.filter("params is not null").select("file_id", F.col("params").alias("scope"), "ord")
    inside = rows.join(lists, ["file_id", "scope"]).withColumn("angle", _angle())
    scope = Window.partitionBy("file_id", "scope").orderBy("n")
    inside = inside.withColumn("angles", F.sum("angle").over(scope)).filter("angle = 0 and angles = 0")
    inside = inside.withColumn("place", F.sum(_op(",").cast("int")).over(scope))
    one = Window.partitionBy("file_id", "scope", "place").orderBy("n")
    inside = inside.withColumns({"prior": F.lag("text").over(one), "next": F.lead("text").over(one), "colons": F.sum(_op(":").cast("int")).over(one), "defaults": F.sum(_op("=").cast("int")).over(one)})
    named = inside.filter((F.col("prior") == ":") & (F.col("colons") == 1) & (F.col("defaults") == 0) & _type_name("next"))
    return named.select("file_id", "ord", F.lit("parameters").alias("kind"), F.col("text").alias("name"), "line", "col")


def _head_references(heads: DataFrame, found: DataFrame) -> DataFrame:
    """The types of results, and the classes and interfaces that an entity extends or implements."""
    part = Window.partitionBy("file_id", "scope", "part").orderBy("n")
    heads = heads.withColumns({"start_n": F.first("n").over(part), "heir": F.last(F.when(F.col("text").isin("extends", "implements"), F.col("text")), True).over(part)})
    result = (F.col("prior") == ":") & (F.col("prior2") == "(") & (F.col("prior2_n") == F.col("params")) & _type_name("next")
    base = F.col("word").isin("class", "interface") & (F.col("n") < F.col("body.n")) & (F.col("kind") == "id") & _is("prior", "extends", "implements", ",") & ~_is("next", ".") & F.col("heir").isNotNull()
    kind = F.when(result, "return_type").when(base, F.when(F.col("heir") == "implements", "implement_interface").when(F.col("word") == "class", "base_class").otherwise("extend_interface"))
    named = heads.withColumn("reference", kind).filter("reference is not null")
    own = found.select("file_id", F.col("n").alias("start_n"), "ord")
    return named.join(own, ["file_id", "start_n"]).select("file_id", "ord", F.col("reference").alias("kind"), F.col("text").alias("name"), "line", "col")


def _files(files: DataFrame) -> DataFrame:
    return files.select("graph", F.col("id").cast("long").alias("file_id"), "path").filter(F.col("path").rlike(r"\.tsx?\z")).dropDuplicates(["file_id"])


def _entities(found: DataFrame, files: DataFrame) -> DataFrame:
    columns = ["graph", "file_id", "path", "ord", "parent_ord", "label", "name", "parent_name", "src_start", "src_end", "doc"]
    return found.join(_files(files), "file_id").select(*columns)


def entities(files: DataFrame) -> DataFrame:
    """The entities of every ``.ts`` and ``.tsx`` file (``graph, id, path, content``), with the order of each and of its parent (-1: the file).

    Functions, arrow functions that are the first variable of a declaration, classes with their
    methods, interfaces, type aliases and enums; functions within functions and abstract classes are
    none.  An entity's ``doc`` is the comment right before its declaration; where ``export`` stands in
    between there is none.  Null and empty contents have none; what a broken file still shows is kept.
    """
    return _entities(_declared(_heads(tokens(files))), files)


def analysed(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``entities`` and ``references`` of files that are lexed once; tokens and declarations are kept in the shared folder."""
    rows = cut(tokens(files))
    heads = _heads(rows)
    found = cut(_declared(heads))
    named = _calls(rows, found).unionByName(_parameters(rows, found)).unionByName(_head_references(heads, found))
    return _entities(found, files), named.join(_files(files), "file_id").select("graph", "file_id", "path", "ord", "kind", "name", "line", "col")


def references(files: DataFrame) -> DataFrame:
    """The calls, base types, parameter and result types that each entity names, with the place of the name.

    Calls in functions, methods and arrow functions within an entity aren't its own, nor is one that
    is all that an arrow function returns.
    """
    return analysed(files)[1]


def edges(found: DataFrame, definitions: DataFrame, ids: DataFrame) -> DataFrame:
    """``(graph, type, src, dst, pos)`` from ``references`` whose definition is known.

    ``definitions`` maps (graph, path, line, col) to (target_path, target_line), as a language
    server does; ``ids`` has ``graph, file_id, path, ord, entity_id, src_start, src_end``.  The
    target is the innermost entity at the definition; references to other files' unknown places
    give no edge.  Each edge stands once, with the last line that it comes from.
    """
    relation = F.create_map(*[F.lit(x) for pair in RELATIONS.items() for x in pair])
    placed = found.join(definitions, ["graph", "path", "line", "col"]).withColumn("type", relation[F.col("kind")])
    own = ids.select("graph", "file_id", "ord", F.col("entity_id").alias("src"))
    there = ids.select("graph", F.col("path").alias("target_path"), F.col("entity_id").alias("dst"), "src_start", "src_end")
    covered = placed.join(own, ["graph", "file_id", "ord"]).join(there, ["graph", "target_path"]).filter("src_start <= target_line and src_end >= target_line")
    extent = F.struct((F.col("src_end") - F.col("src_start")).alias("extent"), "dst")
    innermost = covered.groupBy("graph", "type", "src", "path", "line", "col").agg(F.min(extent).alias("target"))
    return innermost.groupBy("graph", "type", "src", F.col("target.dst").alias("dst")).agg(F.max("line").alias("pos"))
