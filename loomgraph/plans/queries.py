"""The registered queries of the core, each with its SQL."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import text as T
from loomgraph.operators import chunker, codegraph, identity, ingest, knn, linker, memory, store, typescript
from loomgraph.plans.lineage import cut
from loomgraph.sources.tables import of_graph, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: The time that stands for now.
NOW_MS = 1_735_689_600_000

_SPACE = r"[\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _trim(expression: str) -> str:
    return f"regexp_replace({expression}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _anchor(source: str, breadcrumb: str) -> str:
    return f"sha256(coalesce({source}, '') || chr(0) || coalesce({breadcrumb}, ''))"


def _hash(content: str) -> str:
    blank = r"[\t\n\f\r ]+"
    return f"sha256({_trim(f"regexp_replace(coalesce({content}, ''), '{blank}', ' ', 'g')")})"


def _tokens(content: str, strict: bool = False) -> str:
    outside = f"regexp_replace(coalesce({content}, ''), '(?s)```.*?```', chr(10), 'g')"
    ticked = "`([^`\\n]+)`"
    quoted = f"list_filter(list_transform(regexp_extract_all({outside}, '{ticked}', 1), lambda x: {_trim('x')}), lambda x: x <> '')"
    if strict:
        return f"list_distinct({quoted})"
    linkable = "strlen(x) >= 4 and case when contains(x, '_') then len(list_filter(string_split(x, '_'), lambda y: y <> '')) >= 2 else regexp_matches(x, '[a-z][A-Z]|[A-Z][A-Z][a-z]') end"
    bare = f"list_filter(regexp_extract_all(regexp_replace({outside}, '{ticked}', ' ', 'g'), '[A-Za-z_][A-Za-z0-9_]*'), lambda x: {linkable})"
    return f"list_distinct(list_concat({quoted}, {bare}))"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if it has one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


# --- chunks ------------------------------------------------------------------------------------

_SECTIONS = rf"""
a0 as (select doc_id, string_split(text, chr(10)) a from documents where text is not null and text <> ''),
a1 as (select doc_id, case when a[len(a)] = '' then a[1:len(a) - 1] else a end a from a0),
l0 as (select doc_id, unnest(range(1, len(a) + 1)) ln, a from a1),
l1 as (select doc_id, ln, regexp_replace(a[ln], '\r$', '') line, len(a) n from l0),
l2 as (select *, length(regexp_extract(line, '^(#{{1,6}})[\t\n\f\r ]+(.+)$', 1)) level, {_trim(r"regexp_extract(line, '^(#{1,6})[\t\n\f\r ]+(.+)$', 2)")} title from l1),
l3 as (select *, sum(case when level > 0 then 1 else 0 end) over (partition by doc_id order by ln) sec from l2),
s as (select doc_id, sec, min(case when sec = 0 then 1 else ln end) line_start, max(n) n,
        {_trim("coalesce(string_agg(line, chr(10) order by ln) filter (level = 0), '')")} content
      from l3 group by doc_id, sec),
h as (select doc_id, sec, level, title from l3 where level > 0),
bc as (select k.doc_id, k.sec, string_agg(j.title, ' > ' order by j.sec) filter (j.title <> '') trail
       from h k join h j on j.doc_id = k.doc_id and j.sec <= k.sec
       where not exists (select 1 from h i where i.doc_id = k.doc_id and i.sec > j.sec and i.sec <= k.sec and i.level <= j.level)
       group by k.doc_id, k.sec),
e as (select doc_id, sec, content, line_start, coalesce(lead(line_start) over (partition by doc_id order by sec), n) line_end from s),
sections as (select e.doc_id, coalesce(bc.trail, '(top)') breadcrumb, e.content, e.line_start, e.line_end
             from e left join bc on bc.doc_id = e.doc_id and bc.sec = e.sec where e.content <> '')
"""


@query(f"with {_SECTIONS} select * from sections")
def chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunker.split_sections(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"with {_SECTIONS} select breadcrumb, count(*) sections, sum(strlen(content))::bigint bytes from sections group by breadcrumb")
def chunk_breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = chunker.split_sections(table(spark, sf_dir, "documents"), "doc_id", "text")
    return sections.groupBy("breadcrumb").agg(F.count(F.lit(1)).alias("sections"), F.sum(F.octet_length("content")).alias("bytes"))


@query(f"select id, {_anchor('source', 'breadcrumb')} anchor_id, {_hash('content')} content_hash from chunks")
def chunk_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks", "id", "source", "breadcrumb", "content")
    return chunks.select("id", T.anchor_id(F.col("source"), F.col("breadcrumb")).alias("anchor_id"), T.content_hash(F.col("content")).alias("content_hash"))


@query(f"select id, coalesce(nullif(anchor_id, ''), {_anchor('source', 'breadcrumb')}) anchor_id, coalesce(nullif(content_hash, ''), {_hash('content')}) content_hash from chunks")
def backfill_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.with_identity(table(spark, sf_dir, "chunks")).select("id", "anchor_id", "content_hash")


@query(f"select kind, count(*) filter (strlen(text) > {T.OVERSIZED_BYTES}) oversized, count(*) filter (strlen(text) <= {T.OVERSIZED_BYTES}) embedded from documents group by kind")
def oversized_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "kind", "text").withColumn("over", T.is_oversized(F.col("text")))
    return docs.groupBy("kind").agg(F.count_if("over").alias("oversized"), F.count_if(~F.col("over")).alias("embedded"))


@query("select graph, source, id, row_number() over (partition by graph, source order by line_start, id) as position from chunks")
def read_file_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.in_reading_order(table(spark, sf_dir, "chunks", "graph", "source", "id", "line_start")).select("graph", "source", "id", "position")


@query("""select graph, batch_no, count(*) chunks, count(*) filter (orphaned_at > 0) orphaned, count(*) filter (coalesce(last_distilled_at, 0) = 0) undistilled,
          count(*) filter (coalesce(anchor_id, '') = '') legacy from chunks group by graph, batch_no""")
def chunk_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks", "graph", "batch_no", "orphaned_at", "last_distilled_at", "anchor_id")
    return chunks.groupBy("graph", "batch_no").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(F.col("orphaned_at") > 0).alias("orphaned"),
        F.count_if(F.coalesce("last_distilled_at", F.lit(0)) == 0).alias("undistilled"),
        F.count_if(F.coalesce("anchor_id", F.lit("")) == "").alias("legacy"),
    )


# --- identity over a re-ingest: batch 0 is stored, the later batches are new --------------------


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    chunks = table(spark, sf_dir, "chunks", "id", "batch_no", "source", "breadcrumb", "content", "anchor_id", "content_hash", "orphaned_at")
    chunks = identity.with_identity(chunks.withColumns({"anchor_id": F.lower("anchor_id"), "content_hash": F.lower("content_hash")}))
    return chunks.filter("batch_no = 0"), chunks.filter("batch_no > 0")


_VERSIONS = f"""
c as (select id, batch_no, source, orphaned_at, coalesce(nullif(lower(anchor_id), ''), {_anchor('source', 'breadcrumb')}) a, coalesce(nullif(lower(content_hash), ''), {_hash('content')}) h from chunks),
o as (select *, row_number() over (partition by source, a, h order by id) rn from c where batch_no = 0),
n as (select *, row_number() over (partition by source, a, h order by id) rn from c where batch_no > 0)
"""


@query(f"with {_VERSIONS} select n.source, n.id new_id, o.id from n join o on n.source = o.source and n.a = o.a and n.h = o.h and n.rn = o.rn")
def identity_unchanged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.match_unchanged(*_versions(spark, sf_dir))


@query(f"""with {_VERSIONS}, m as (select o.id from n join o on n.source = o.source and n.a = o.a and n.h = o.h and n.rn = o.rn)
select id, source from o where coalesce(orphaned_at, 0) = 0 and source in (select source from n) and id not in (select id from m)""")
def identity_left_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, new = _versions(spark, sf_dir)
    matches = identity.match_unchanged(existing, new)
    live = existing.filter(F.coalesce("orphaned_at", F.lit(0)) == 0)
    return live.join(new.select("source").distinct(), "source", "left_semi").join(matches.select("id"), "id", "left_anti").select("id", "source")


@query()
def identity_full_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.match(*_versions(spark, sf_dir))


@query()
def identity_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    existing, new = _versions(spark, sf_dir)
    return identity.orphaned(existing, cut(identity.match(existing, new)))


@query()
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identity.counters(identity.match(*_versions(spark, sf_dir)))


# --- linking -----------------------------------------------------------------------------------

_LIVE = "coalesce(orphaned_at, 0) = 0"


@query(f"select graph, id chunk_id, unnest({_tokens('content')}) as token from chunks where {_LIVE}")
def link_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linker.chunk_tokens(table(spark, sf_dir, "chunks", "graph", "id", "content", "orphaned_at"))


@query(f"select graph, id chunk_id, unnest({_tokens('content', True)}) as token from chunks where {_LIVE}")
def link_tokens_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linker.chunk_tokens(table(spark, sf_dir, "chunks", "graph", "id", "content", "orphaned_at"), strict=True)


_ENTITY_NAMES = "e as (select distinct graph, id, name from entities where name is not null)"
_EDGES = f"t as (select graph, id chunk_id, unnest({_tokens('content')}) as token from chunks where {_LIVE}), {_ENTITY_NAMES}, d as (select distinct t.graph, t.chunk_id, e.id entity_id from t join e on e.graph = t.graph and e.name = t.token)"


@query(f"with {_EDGES} select * from d")
def documents_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linker.link(table(spark, sf_dir, "chunks", "graph", "id", "content", "orphaned_at"), table(spark, sf_dir, "entities", "graph", "id", "name"))


@query(f"with {_EDGES} select d.graph, x.name, count(distinct d.chunk_id) chunks, count(*) edges from d join e x on x.graph = d.graph and x.id = d.entity_id group by d.graph, x.name")
def docs_for_entity(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "entities", "graph", "id", "name")
    edges = linker.link(table(spark, sf_dir, "chunks", "graph", "id", "content", "orphaned_at"), entities)
    named = entities.filter("name is not null").dropDuplicates().withColumnRenamed("id", "entity_id")
    return edges.join(named, ["graph", "entity_id"]).groupBy("graph", "name").agg(F.countDistinct("chunk_id").alias("chunks"), F.count(F.lit(1)).alias("edges"))


@query(f"""with t as (select doc_id, unnest({_tokens('text')}) as token from documents where text is not null)
select token, count(*) documents from t group by token""")
def mentioned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null")
    return docs.select("doc_id", F.explode(T.link_tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("documents"))


# --- vectors -----------------------------------------------------------------------------------


def _knn_sql(k: int, dim: int | None = None) -> str:
    part = f"[1:{dim}]" if dim else ""
    return f"""with q as (select embedding{part}::double[] v from embeddings where vec_id = (select min(vec_id) from embeddings)),
d as (select vec_id, list_cosine_distance(embedding{part}::double[], (select v from q)) x from embeddings)
select vec_id, round(x, 6) distance from d order by x, vec_id limit {k}"""


def _first_vector(vectors: DataFrame) -> list[float]:
    return vectors.orderBy("vec_id").limit(1).collect()[0]["embedding"]


@query(_knn_sql(10))
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return knn.nearest(vectors, _first_vector(vectors), 10).withColumn("distance", F.round("distance", 6))


@query(_knn_sql(10, 32))
def knn_matryoshka(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return knn.nearest(vectors, _first_vector(vectors), 10, dim=32).withColumn("distance", F.round("distance", 6))


@query("""with p as (select a.vec_id query_id, b.vec_id id, list_cosine_distance(a.embedding::double[], b.embedding::double[]) x
from embeddings a, embeddings b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
r as (select *, row_number() over (partition by query_id order by round(x, 12), id) as rank from p)
select query_id, id, round(x, 6) distance, rank from r where rank <= 5""")
def knn_batch_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return knn.nearest_of_each(vectors, vectors.filter("vec_id % 20 = 0")).withColumn("distance", F.round("distance", 6))


@query("""with p as (select a.vec_id query_id, a.label, b.label other, row_number() over (partition by a.vec_id order by round(list_cosine_distance(a.embedding::double[], b.embedding::double[]), 12), b.vec_id) as r
from embeddings a, embeddings b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id)
select label, count(*) neighbours, count(*) filter (label = other) agreeing from p where r <= 5 group by label""")
def knn_label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    near = knn.nearest_of_each(vectors, vectors.filter("vec_id % 20 = 0"))
    mine = vectors.select(F.col("vec_id").alias("query_id"), "label")
    theirs = vectors.select(F.col("vec_id").alias("id"), F.col("label").alias("other"))
    joined = near.join(mine, "query_id").join(theirs, "id")
    return joined.groupBy("label").agg(F.count(F.lit(1)).alias("neighbours"), F.count_if(F.col("label") == F.col("other")).alias("agreeing"))


# --- facts and evidence ------------------------------------------------------------------------


@query("select graph, subject, predicate, object, min(id) id, min(created_at) created_at, count(*) deliveries from facts group by graph, subject, predicate, object")
def fact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.merge_facts(table(spark, sf_dir, "facts", "graph", "id", "subject", "predicate", "object", "created_at"))


def _distinct_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "facts", "id", "graph", "subject", "predicate", "object").dropDuplicates()


_FACTS = "with f as (select distinct id, graph, subject, predicate, object from facts)"


@query(f"{_FACTS} select * from f where subject = 'ledger gateway' order by id limit 50")
def search_facts_s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.search_facts(_distinct_facts(spark, sf_dir), subject="ledger gateway")


@query(f"{_FACTS} select * from f where predicate = 'reads_from' order by id limit 50")
def search_facts_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.search_facts(_distinct_facts(spark, sf_dir), predicate="reads_from")


@query(f"{_FACTS} select * from f where subject = 'ledger gateway' and predicate = 'introduced_in' order by id limit 20")
def search_facts_sp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.search_facts(_distinct_facts(spark, sf_dir), subject="ledger gateway", predicate="introduced_in", limit=20)


@query(f"{_FACTS} select * from f order by id limit 50")
def search_facts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.search_facts(_distinct_facts(spark, sf_dir), limit=0)


@query(f"""select graph, count(*) facts, count(*) filter (predicate in ({', '.join(f"'{p}'" for p in memory.KERNEL_PREDICATES)})) kernel, count(distinct subject) subjects from facts group by graph""")
def facts_by_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = table(spark, sf_dir, "facts", "graph", "predicate", "subject")
    return facts.groupBy("graph").agg(F.count(F.lit(1)).alias("facts"), F.count_if(F.col("predicate").isin(*memory.KERNEL_PREDICATES)).alias("kernel"), F.countDistinct("subject").alias("subjects"))


@query(f"""select id, subject, predicate, object from facts
where greatest(created_at, coalesce(nullif(last_verified_at, 0), created_at)) < {NOW_MS} - 90::bigint * 86400000 group by all""")
def stale_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.stale_facts(table(spark, sf_dir, "facts"), NOW_MS).select("id", "subject", "predicate", "object").dropDuplicates()


_OBSERVED = """o as (select event_id + 1 id, props content, epoch_us(ts) // 1000 created_at, 'user' || user_id::varchar subject, event_type object from events where event_id is not null and user_id is not null and event_type is not null),
f as (select min(id) id, subject, 'performed' predicate, object from o group by subject, object),
e as (select distinct o.id src, f.id dst from o join f on o.subject = f.subject and o.object = f.object)"""


@query(f"with {_OBSERVED} select * from f")
def observed_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.observe(table(spark, sf_dir, "events"))[1]


@query(f"with {_OBSERVED} select f.id, count(e.src) evidence from f left join e on e.dst = f.id group by f.id")
def fact_evidence_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, facts, edges = memory.observe(table(spark, sf_dir, "events"))
    return memory.count_evidence(facts, edges)


@query(f"with {_OBSERVED} select f.id fact_id, o.id observation_id, o.created_at from f join e on e.dst = f.id join o on o.id = e.src")
def evidence_for_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations, facts, edges = memory.observe(table(spark, sf_dir, "events"))
    return memory.evidence_for(observations, edges, facts)


@query(f"with {_OBSERVED} select distinct f.* from f join e on e.dst = f.id join o on o.id = e.src")
def facts_backed_by_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations, facts, edges = memory.observe(table(spark, sf_dir, "events"))
    return memory.facts_backed_by(facts, edges, observations)


@query(f"""with {_OBSERVED} select o.id observation_id, array_to_string(list_sort(list(f.object) filter (f.object is not null)), ',') facts
from o left join e on e.src = o.id left join f on f.id = e.dst group by o.id""")
def observations_with_optional_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations, facts, edges = memory.observe(table(spark, sf_dir, "events"))
    stated = edges.join(facts.select(F.col("id").alias("dst"), "object"), "dst")
    joined = observations.select("id").join(stated.withColumnRenamed("src", "id"), "id", "left")
    return joined.groupBy(F.col("id").alias("observation_id")).agg(F.nullif(F.array_join(F.array_sort(F.collect_list("object")), ","), F.lit("")).alias("facts"))


# The same under the names they have had beside the three before.


@query(f"with {_OBSERVED} select f.id fact_id, o.id observation_id, o.created_at from f join e on e.dst = f.id join o on o.id = e.src")
def evidence_for_every_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations, facts, edges = memory.observe(table(spark, sf_dir, "events"))
    return memory.evidence_for(observations, edges, facts)


@query(f"with {_OBSERVED} select distinct f.* from f join e on e.dst = f.id join o on o.id = e.src")
def facts_backed_by_any_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations, facts, edges = memory.observe(table(spark, sf_dir, "events"))
    return memory.facts_backed_by(facts, edges, observations)


@query(f"""with {_OBSERVED} select o.id observation_id, array_to_string(list_sort(list(f.object) filter (f.object is not null)), ',') facts
from o left join e on e.src = o.id left join f on f.id = e.dst group by o.id""")
def observations_with_all_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations, facts, edges = memory.observe(table(spark, sf_dir, "events"))
    stated = edges.join(facts.select(F.col("id").alias("dst"), "object"), "dst")
    joined = observations.select("id").join(stated.withColumnRenamed("src", "id"), "id", "left")
    return joined.groupBy(F.col("id").alias("observation_id")).agg(F.nullif(F.array_join(F.array_sort(F.collect_list("object")), ","), F.lit("")).alias("facts"))


# --- code graph --------------------------------------------------------------------------------


@query("""with e as (select graph, label, name, path, coalesce(parent_name, '') parent_name, id, src_start, src_end, doc from entities)
select graph, label, name, path, parent_name, min(id) id, arg_max({'a': src_start}, id).a src_start, arg_max({'a': src_end}, id).a src_end, arg_max({'a': doc}, id).a doc
from e group by graph, label, name, path, parent_name""")
def entity_merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.merge_entities(table(spark, sf_dir, "entities"))


_REFERENCES = """r as (select id * 3 + k ref_id, graph, path, case k when 0 then src_start when 1 then src_end else (src_start + src_end) // 2 end line
from (select distinct id, graph, path, src_start, src_end from entities) x, (values (0), (1), (2)) v(k))"""


@query(f"""with {_REFERENCES}, e as (select distinct graph, path, id, src_start, src_end from entities),
c as (select r.ref_id, e.id, row_number() over (partition by r.ref_id order by e.src_end - e.src_start, e.id) as rn from r join e on e.graph = r.graph and e.path = r.path and e.src_start <= r.line and e.src_end >= r.line)
select r.ref_id, coalesce(c.id, -1) entity_id from (select distinct ref_id from r) r left join c on c.ref_id = r.ref_id and c.rn = 1""")
def entity_lookup_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "entities", "graph", "path", "id", "src_start", "src_end").dropDuplicates()
    lines = F.array("src_start", "src_end", F.floor((F.col("src_start") + F.col("src_end")) / 2).cast("int"))
    references = entities.select("id", "graph", "path", F.posexplode(lines).alias("k", "line")).select((F.col("id") * 3 + F.col("k")).alias("ref_id"), "graph", "path", "line")
    return codegraph.at_position(entities, references)


@query("""with e as (select distinct graph, path, id, label, name, parent_name, src_start, src_end from entities),
c as (select k.graph, p.id parent_id, k.id child_id, row_number() over (partition by k.graph, k.id order by p.src_end - p.src_start, p.id) as rn
from e k join e p on p.graph = k.graph and p.path = k.path and p.name = k.parent_name and p.label in ('Class', 'Interface') and p.src_start <= k.src_start and p.src_end >= k.src_end
where k.parent_name is not null and k.parent_name <> '')
select graph, parent_id, child_id from c where rn = 1""")
def defines_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["graph", "path", "id", "label", "name", "parent_name", "src_start", "src_end"]
    return codegraph.defines(table(spark, sf_dir, "entities", *columns).dropDuplicates())


_CALLS = "calls as (select 'CALLS' \"type\", l_orderkey src, l_partkey dst, max(l_linenumber) pos from lineitem group by l_orderkey, l_partkey)"


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber")
    return codegraph.merge_edges(lines.select(F.lit("CALLS").alias("type"), F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_linenumber").alias("pos")))


@query(f"with {_CALLS} select * from calls")
def calls_edges_pos_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir)


@query(f"with {_CALLS} select p.p_name callee, count(*) callers, max(calls.pos) last_pos from calls join part p on p.p_partkey = calls.dst group by p.p_name")
def callers_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part", "p_partkey", "p_name")
    joined = _calls(spark, sf_dir).join(parts, F.col("dst") == F.col("p_partkey"))
    return joined.groupBy(F.col("p_name").alias("callee")).agg(F.count(F.lit(1)).alias("callers"), F.max("pos").alias("last_pos"))


@query("select graph, path, count(*) scans, max(id) id from files where regexp_matches(path, '\\.tsx?$') group by graph, path")
def discovered_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files", "graph", "path", "id").filter(F.col("path").rlike(r"\.tsx?\z"))
    return files.groupBy("graph", "path").agg(F.count(F.lit(1)).alias("scans"), F.max("id").alias("id"))


@query(f"""select graph, count(*) files, count(*) filter (list_has_any(string_split(path, '/'), [{', '.join(f"'{name}'" for name in T.DEFAULT_IGNORE)}])) dependencies from files group by graph""")
def dependency_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files", "graph", "path")
    return files.groupBy("graph").agg(F.count(F.lit(1)).alias("files"), F.count_if(T.is_dependency(F.col("path"))).alias("dependencies"))


@query("""with f as (select graph, count(distinct path) files from files group by graph), e as (select graph, count(distinct id) entities from entities group by graph),
c as (select graph, count(*) chunks from chunks group by graph), r as (select graph, max(files) reported_files from analyze_runs group by graph)
select f.graph, f.files, e.entities, c.chunks, r.reported_files from f left join e on e.graph = f.graph left join c on c.graph = f.graph left join r on r.graph = f.graph""")
def analyze_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files", "graph", "path").groupBy("graph").agg(F.countDistinct("path").alias("files"))
    entities = table(spark, sf_dir, "entities", "graph", "id").groupBy("graph").agg(F.countDistinct("id").alias("entities"))
    chunks = table(spark, sf_dir, "chunks", "graph").groupBy("graph").agg(F.count(F.lit(1)).alias("chunks"))
    runs = table(spark, sf_dir, "analyze_runs", "graph", "files").groupBy("graph").agg(F.max("files").alias("reported_files"))
    return files.join(entities, "graph", "left").join(chunks, "graph", "left").join(runs, "graph", "left")


# --- TypeScript sources -------------------------------------------------------------------------


@query()
def ts_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typescript.entities(table(spark, sf_dir, "files", "graph", "id", "path", "content"))


@query()
def ts_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return typescript.references(table(spark, sf_dir, "files", "graph", "id", "path", "content"))


def _named_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Entities with ids, and the edges to what the same graph declares under the name that is referred to (first by path)."""
    files = table(spark, sf_dir, "files", "graph", "id", "path", "content")
    found, references = typescript.analysed(files)
    found = found.withColumn("entity_id", F.col("file_id") * 100_000 + F.col("ord"))
    places = found.groupBy("graph", "name").agg(F.min(F.struct("path", "src_start")).alias("at")).select("graph", "name", F.col("at.path").alias("target_path"), F.col("at.src_start").alias("target_line"))
    definitions = references.join(places, ["graph", "name"]).select("graph", "path", "line", "col", "target_path", "target_line").distinct()
    return found, typescript.edges(references, definitions, found)


@query()
def ts_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named_edges(spark, sf_dir)[1]


@query()
def ts_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, edges = _named_edges(spark, sf_dir)
    backwards = cut(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct())
    return codegraph.reach(backwards, found.select(F.col("entity_id").alias("id")), 3, cut).groupBy(F.col("start").alias("entity_id")).agg(F.count(F.lit(1)).alias("reached"), F.max("hops").alias("hops"))


@query(r"""with f as (select distinct graph, path from files where regexp_matches(path, '\.tsx?$')),
e as (select distinct graph, path, id, label, name, parent_name from entities)
select e.graph, e.label, count(*) entities, count(distinct e.path) files, count(*) filter (coalesce(e.parent_name, '') <> '') nested
from e join f on f.graph = e.graph and f.path = e.path group by e.graph, e.label""")
def entity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files", "graph", "path").filter(F.col("path").rlike(r"\.tsx?\z")).distinct()
    rows = table(spark, sf_dir, "entities", "graph", "path", "id", "label", "name", "parent_name").distinct()
    joined = rows.join(files, ["graph", "path"], "left_semi")
    return joined.groupBy("graph", "label").agg(F.count(F.lit(1)).alias("entities"), F.countDistinct("path").alias("files"), F.count_if(F.coalesce("parent_name", F.lit("")) != "").alias("nested"))


@query(f"""with {_EDGES} select c.graph, c.id from chunks c where {_LIVE.replace('orphaned_at', 'c.orphaned_at')} and not exists (select 1 from d where d.graph = c.graph and d.chunk_id = c.id)""")
def chunks_linked_to_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks", "graph", "id", "content", "orphaned_at")
    edges = linker.link(chunks, table(spark, sf_dir, "entities", "graph", "id", "name"))
    live = chunks.filter(F.coalesce("orphaned_at", F.lit(0)) == 0).select("graph", "id")
    return live.join(edges.select("graph", F.col("chunk_id").alias("id")), ["graph", "id"], "left_anti")


@query()
def ingest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "path", "text", "received_at").filter("path is not null and text is not null")
    latest = docs.groupBy(F.col("path").alias("source")).agg(F.max_by("text", F.struct("received_at", "text")).alias("text"))
    return ingest.reingest(spark.createDataFrame([], ingest.CHUNKS), latest, NOW_MS, cut)[0]


# --- writing to a graph and searching it --------------------------------------------------------

_FIRST = "q as (select embedding::double[] v from embeddings where vec_id = (select min(vec_id) from embeddings))"


@query(f"""with {_FIRST}, d as (select c.*, list_cosine_distance(e.embedding::double[], (select v from q)) x from chunks c join embeddings e on e.vec_id = c.id)
select id, breadcrumb, content, source, line_start, line_end, round(x, 6) score from d order by x, id limit 10""")
def search_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    hits = store.search_chunks(table(spark, sf_dir, "chunks"), vectors, _first_vector(vectors), 10)
    return hits.withColumn("score", F.round("score", 6))


@query(f"""with {_OBSERVED}, {_FIRST}, d as (select o.id, o.content, list_cosine_distance(e.embedding::double[], (select v from q)) x from o join embeddings e on e.vec_id = o.id)
select id, content, round(x, 6) distance from d order by x, id limit 10""")
def search_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    observations = memory.observe(table(spark, sf_dir, "events"))[0]
    return store.search_observations(observations, vectors, _first_vector(vectors), 10).withColumn("distance", F.round("distance", 6))


@query(f"""with {_OBSERVED}, {_FIRST}, d as (select o.id, list_cosine_distance(e.embedding::double[], (select v from q)) x from o join embeddings e on e.vec_id = o.id order by x, id limit 5)
select distinct f.* from f join e on e.dst = f.id where e.src in (select id from d)""")
def facts_near_a_new_observation(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    observations, facts, edges = memory.observe(table(spark, sf_dir, "events"))
    return store.add_observation(observations, vectors, facts, edges, "a new observation", _first_vector(vectors), NOW_MS)[2]


@query(f"with {_OBSERVED} select distinct src, dst from e")
def evidence_linked_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations, facts, edges = memory.observe(table(spark, sf_dir, "events"))
    return store.link_evidence(edges, edges, observations, facts)


_MOTIVATES = "m as (select distinct o.id src, c.id dst from o join chunks c on c.id = o.id)"


def _motivates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Observations, chunks, and MOTIVATES edges between those of one id."""
    observations = memory.observe(table(spark, sf_dir, "events", "event_id", "props", "ts", "user_id", "event_type"))[0]
    chunks = table(spark, sf_dir, "chunks", "id", "source", "orphaned_at", "last_distilled_at")
    edges = observations.select(F.col("id").alias("src")).join(chunks.select(F.col("id").alias("dst")), F.col("src") == F.col("dst")).distinct()
    return observations, chunks, edges


@query(f"with {_OBSERVED}, {_MOTIVATES} select id, case when id in (select dst from m) then coalesce(nullif(last_distilled_at, 0), {NOW_MS}) else last_distilled_at end last_distilled_at from chunks")
def chunks_distilled_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations, chunks, edges = _motivates(spark, sf_dir)
    return store.link_motivates(edges.limit(0), edges, observations, chunks, NOW_MS)[1].select("id", "last_distilled_at")


@query(f"with {_OBSERVED}, {_MOTIVATES} select m.dst chunk_id, m.src observation_id from m join chunks c on c.id = m.dst where coalesce(c.orphaned_at, 0) > 0")
def observations_behind_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, chunks, edges = _motivates(spark, sf_dir)
    return store.motivating(edges, chunks.filter(F.coalesce("orphaned_at", F.lit(0)) > 0))


_HANDBOOK = "docs/handbook/operations.md"


@query(f"with {_OBSERVED}, {_MOTIVATES} select m.src, m.dst from m where not exists (select 1 from chunks c where c.source = '{_HANDBOOK}' and c.id in (m.src, m.dst))")
def edges_after_deleting_a_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, chunks, edges = _motivates(spark, sf_dir)
    return store.delete_source(chunks, edges, _HANDBOOK)[1]


@query(f"select id, source from chunks where source is distinct from '{_HANDBOOK}'")
def chunks_after_deleting_a_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks", "id", "source")
    return store.delete_source(chunks, spark.createDataFrame([], "src long, dst long"), _HANDBOOK)[0]


@query("select graph, count(*) facts from facts where graph is distinct from 'harbor-core' group by graph")
def facts_after_deleting_a_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.delete_graph(table(spark, sf_dir, "facts", "graph", "id"), "harbor-core").groupBy("graph").agg(F.count(F.lit(1)).alias("facts"))


@query(f"{_FACTS} select * from f where subject = 'ledger gateway' and predicate = 'introduced_in' and object = (select min(object) from f where subject = 'ledger gateway' and predicate = 'introduced_in') order by id limit 1")
def fact_by_triplet(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = _distinct_facts(spark, sf_dir)
    object_ = facts.filter("subject = 'ledger gateway' and predicate = 'introduced_in'").agg(F.min("object")).first()[0]
    return store.find_fact(facts, "ledger gateway", "introduced_in", object_ or "")


@query(f"""with {_OBSERVED} select f.id fact_id, o.id observation_id, o.created_at, row_number() over (partition by f.id order by o.created_at, o.id) as place
from f join e on e.dst = f.id join o on o.id = e.src""")
def evidence_in_time_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations, facts, edges = memory.observe(table(spark, sf_dir, "events"))
    evidence = memory.evidence_for(observations, edges, facts)
    return store.in_time_order(evidence)


@query(r"""select id, regexp_extract(path, '[^/]*$') base, regexp_extract(path, '\.[^./]*$') ext from files""")
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "files", "id", "path").select("id", T.base_name(F.col("path")).alias("base"), T.extension(F.col("path")).alias("ext"))


@query(f"select distinct graph, id, name from entities where label in ({', '.join(f"'{label}'" for label in codegraph.LABELS)})")
def code_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codegraph.code_entities(table(spark, sf_dir, "entities", "graph", "id", "name", "label"))


@query("select id, source, breadcrumb, line_start from chunks where graph = 'harbor-core'")
def chunks_of_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_graph(spark, sf_dir, "chunks", "harbor-core", "id", "source", "breadcrumb", "line_start")


@query(f"with {_OBSERVED}, {_MOTIVATES} select o.id, o.created_at from o where not exists (select 1 from m where m.src = o.id)")
def observations_without_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    observations, _, edges = _motivates(spark, sf_dir)
    return observations.select("id", "created_at").join(edges.select(F.col("src").alias("id")), "id", "left_anti")


_DESCRIBED = _EDGES.replace(_ENTITY_NAMES, _ENTITY_NAMES.replace("e as", "x as", 1)).replace("e.id entity_id from t join e on e.graph = t.graph and e.name", "x.id entity_id from t join x on x.graph = t.graph and x.name")


@query(f"""with {_OBSERVED}, {_MOTIVATES}, {_DESCRIBED} select d.graph, d.entity_id, m.src observation_id, array_to_string(list_sort(list(distinct f.object) filter (f.object is not null)), ',') facts
from d join m on m.dst = d.chunk_id left join e on e.src = m.src left join f on f.id = e.dst group by d.graph, d.entity_id, m.src""")
def observations_about_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, facts, evidence = memory.observe(table(spark, sf_dir, "events"))
    about = memory.about_entities(documents_edges(spark, sf_dir), _motivates(spark, sf_dir)[2], evidence, facts)
    return about.withColumn("facts", F.nullif(F.array_join("facts", ","), F.lit("")))


@query("select id, to_json({'id': id, 'source': source, 'breadcrumb': breadcrumb, 'line_start': line_start, 'line_end': line_end})::varchar as json from chunks")
def chunks_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = table(spark, sf_dir, "chunks", "id", "source", "breadcrumb", "line_start", "line_end")
    return chunks.select("id", F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


@query("select id, path, case when starts_with(path, '/workspace/') then substr(path, 12) else path end relative from files")
def file_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "files", "id", "path")
    uri = F.concat(F.lit("file://"), F.replace(F.replace("path", F.lit("%"), F.lit("%25")), F.lit(" "), F.lit("%20")))
    return files.select("id", T.uri_path(uri).alias("path"), T.relative_path(F.col("path"), "/workspace").alias("relative"))


@query()
def search_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return store.hit_texts(store.search_chunks(table(spark, sf_dir, "chunks"), vectors, _first_vector(vectors), 10))


@query()
def ingest_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "path", "text", "received_at").filter("path is not null and text is not null")
    latest = docs.groupBy(F.col("path").alias("source")).agg(F.max_by("text", F.struct("received_at", "text")).alias("text"))
    chunks, report = ingest.reingest(spark.createDataFrame([], ingest.CHUNKS), latest, NOW_MS, cut)
    names = codegraph.code_entities(table(spark, sf_dir, "entities", "graph", "id", "name", "label"))
    edges = linker.link(chunks.select(F.lit("harbor-core").alias("graph"), "id", "content", "orphaned_at"), names)
    return ingest.totals(report, chunks, edges)


@query()
def analyze_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each graph its TypeScript files, their entities, and the relationships stated, repeated ones included."""
    files = table(spark, sf_dir, "files", "graph", "id", "path", "content")
    found, references = typescript.analysed(files)
    counts = found.groupBy("graph").agg(F.countDistinct("file_id").alias("files"), F.count(F.lit(1)).alias("entities"))
    return counts.join(references.groupBy("graph").agg(F.count(F.lit(1)).alias("relationships")), "graph", "left").fillna(0, ["relationships"])
