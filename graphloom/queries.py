"""One query for each operator, on the graph projected from the star-schema tables, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .functions import text as X
from .operators import corpus, diff, edges as E, evaluate, rank, resolve, traverse
from .plans import projection
from .plans.projection import table
from .schema import INHERIT_RELATIONS, LEGACY_RANK, MEMBER_RELATIONS, NOT_A_TEST_LINK, RELATION_WEIGHTS, TAINT_RELATIONS, TRAVERSAL_RELATIONS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, graph: bool = False, recursive: bool = False):
    """Register the decorated function, and its SQL; ``graph`` puts the projection's CTEs in front."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            text = sql.strip()
            if graph:
                text = ("with recursive " if recursive else "with ") + projection.SQL.strip() + (", " + text[5:] if text.startswith("with ") else "\n" + text)
            ORACLE_SQL[fn.__name__] = text
        return fn

    return add


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _case(table_: dict, key: str, other) -> str:
    return f"case {key} " + " ".join(f"when '{k}' then {v}" for k, v in table_.items()) + f" else {other} end"


def _graph(spark: SparkSession, sf_dir: str, distinct: bool = True) -> tuple[DataFrame, DataFrame]:
    """Walks and closures keep the first of equal edges by themselves, so they may take them as they come."""
    return projection.nodes(spark, sf_dir), projection.edges(spark, sf_dir, distinct)


def _seeds(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i, i) for i in ids], "query_id string, id string")


# --- traversal -----------------------------------------------------------------


def _reach_sql(ids: tuple[str, ...], depth: int, direction: str, members: bool = False) -> str:
    up = "select target as id, source as next from edges where relation in " + _in(TRAVERSAL_RELATIONS)
    down = "select source as id, target as next from edges where relation in " + _in(TRAVERSAL_RELATIONS)
    adj = {"up": up, "down": down, "both": f"{up} union all {down}"}[direction]
    seeds = " union ".join(f"select '{i}' as query_id, '{i}' as id" for i in ids)
    if members:
        seeds += " union " + " union ".join(f"select '{i}', target from edges where source = '{i}' and relation in {_in(MEMBER_RELATIONS)}" for i in ids)
    return f"""with adj as ({adj}), start as ({seeds}), walk(query_id, id, depth) as (
  select query_id, id, 0 from start
  union
  select w.query_id, a.next, w.depth + 1 from walk w join adj a using (id) where w.depth < {depth}
), reach as (select query_id, id, min(depth)::int as depth from walk group by query_id, id)"""


def _reach_query(name: str, ids: tuple[str, ...], depth: int, direction: str, members: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        n, e = _graph(spark, sf_dir, distinct=False)
        return traverse.radius(n, e, _seeds(spark, *ids), depth, direction, members=members).drop("truncated")

    run.__name__ = name
    run.__doc__ = f"Nodes within {depth} hops {direction}."
    query(_reach_sql(ids, depth, direction, members) + " select query_id, id, depth from reach", graph=True, recursive=True)(run)


_reach_query("blast_up_d2", ("P:1", "O:7"), 2, "up")
_reach_query("blast_down_d2", ("C:1", "C:2"), 2, "down")
_reach_query("blast_both_d2", ("P:1",), 2, "both")
_reach_query("blast_member_seed", ("N:3", "R:1"), 1, "down", members=True)


@query(_reach_sql(("P:1",), 2, "up") + """, pairs as (
  select r1.query_id, e.* from edges e join reach r1 on e.source = r1.id join reach r2 on e.target = r2.id and r1.query_id = r2.query_id)
select query_id, source, target, relation, confidence from pairs qualify row_number() over (partition by query_id, source, target, relation order by edge_pos) = 1""", graph=True, recursive=True)  # fmt: skip
def blast_closure_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every edge, of any relation, between nodes of a radius."""
    n, e = _graph(spark, sf_dir, distinct=False)
    return traverse.closure_edges(e, traverse.radius(n, e, _seeds(spark, "P:1"), 2, "up", members=False)).select("query_id", "source", "target", "relation", "confidence")


@query(_reach_sql(("P:1", "P:2"), 2, "up") + f""", t as (
  select distinct r1.query_id, e.source, e.target from edges e join reach r1 on e.source = r1.id join reach r2 on e.target = r2.id and r1.query_id = r2.query_id where e.relation in {_in(TAINT_RELATIONS)})
select query_id, source as id from t union select query_id, target from t""", graph=True, recursive=True)  # fmt: skip
def taint_exposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that a taint edge of the radius touches."""
    n, e = _graph(spark, sf_dir, distinct=False)
    return traverse.taint_exposed(traverse.closure_edges(e, traverse.radius(n, e, _seeds(spark, "P:1", "P:2"), 2, "up", members=False)))[1]


@query(f"""with adj as (select target as id, source as next, edge_pos from edges where relation in {_in(TRAVERSAL_RELATIONS)}),
one as (select next as id, row_number() over (order by min(edge_pos), next) as r from adj where id = 'P:1' and next <> 'P:1' group by next),
kept1 as (select id, r from one where r <= 29),
two as (select a.next as id, row_number() over (order by min(lpad((k.r + 1)::varchar, 12, '0') || a.edge_pos), a.next) as r from kept1 k join adj a using (id)
  where a.next <> 'P:1' and a.next not in (select id from kept1) group by a.next),
every as (select 'P:1' as id, 0 as depth union all select id, 1 from kept1 union all select id, 2 from two where r + 1 + (select count(*) from kept1) <= 30)
select 'P:1' as query_id, id, depth::int as depth, ((select count(*) from one) > 29 or (select count(*) from two) + 1 + (select count(*) from kept1) > 30) as truncated from every""", graph=True)  # fmt: skip
def blast_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A radius cut off at 30 nodes in discovery order."""
    n, e = _graph(spark, sf_dir, distinct=False)
    return traverse.radius(n, e, _seeds(spark, "P:1"), 2, "up", max_nodes=30, members=False)


@query(f"""with below(owner) as (
  select e.source from edges e where e.relation in {_in(INHERIT_RELATIONS)} and e.target = 'R:2'
  union select e.source from edges e join below b on e.target = b.owner where e.relation in {_in(INHERIT_RELATIONS)})
select 'R:2' as query_id, owner as id from below""", graph=True, recursive=True)  # fmt: skip
def subclasses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct and indirect subclasses of a region."""
    return traverse.subclasses(projection.edges(spark, sf_dir), _seeds(spark, "R:2"))


#: Fixed values of the override query: a base class above two regions, with a member that customers are made to override.
_BASES = (("R:0", "inherits", "B:0"), ("R:1", "inherits", "B:0"), ("B:0", "method", "B:0.m"))


@query(f"""with base(source, relation, target) as (values {", ".join(f"('{s}', '{r}', '{t}')" for s, r, t in _BASES)}),
e2 as (select source, relation, target from edges where relation <> 'contains' union all select * from base),
n2 as (select id, case when id like 'C:%' and (substr(id, 3)::bigint % 7) = 0 then 'm()' else label end as label from nodes union all values ('B:0', 'Base'), ('B:0.m', 'm()')),
below(owner) as (select 'B:0' union select e.source from e2 e join below b on e.target = b.owner where e.relation in {_in(INHERIT_RELATIONS)})
select 'B:0.m' as query_id, e.target as id, e.source as owning_class from below b join e2 e on e.source = b.owner and e.relation in {_in(MEMBER_RELATIONS)} join n2 on n2.id = e.target
where regexp_replace(n2.label, '\\(\\)$', '') = 'm' and e.target <> 'B:0.m'""", graph=True, recursive=True)  # fmt: skip
def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of indirect subclasses that override a base class's member."""
    n, e = _graph(spark, sf_dir)
    more = spark.createDataFrame([(s, r, t) for s, r, t in _BASES], "source string, relation string, target string")
    e = e.where("relation <> 'contains'").select("source", "relation", "target").unionByName(more)
    renamed = F.when(F.col("id").startswith("C:") & (F.substring("id", 3, 20).try_cast("long") % 7 == 0), "m()").otherwise(F.col("label"))
    n = n.select("id", renamed.alias("label")).union(spark.createDataFrame([("B:0", "Base"), ("B:0.m", "m()")], "id string, label string"))
    return traverse.overrides(n, e, _seeds(spark, "B:0.m"))


@query(f"""with s(query_id) as (values ('O:7'), ('P:3')), kept as (select * from edges where relation in {_in(TRAVERSAL_RELATIONS)})
select distinct query_id, source as id, 'caller' as role, relation from kept join s on target = query_id
union select distinct query_id, target, 'callee', relation from kept join s on source = query_id where source <> target""", graph=True)  # fmt: skip
def neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direct callers and callees."""
    n, e = _graph(spark, sf_dir, distinct=False)
    return traverse.neighbours(n, e, _seeds(spark, "O:7", "P:3"))


@query(_reach_sql(("O:7",), 3, "both") + """, pairs(query_id, id, target) as (values ('O:7', 'O:7', 'P:3'), ('O:7', 'O:7', 'S:1'), ('O:7', 'O:7', 'R:1'))
select p.query_id, p.id, p.target, r.depth from pairs p left join reach r on r.query_id = p.query_id and r.id = p.target""", graph=True, recursive=True)  # fmt: skip
def shortest_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hops between pairs, direction ignored."""
    n, e = _graph(spark, sf_dir, distinct=False)
    pairs = spark.createDataFrame([("O:7", "O:7", t) for t in ("P:3", "S:1", "R:1")], "query_id string, id string, target string")
    return traverse.shortest_depth(n, e, pairs)


@query("select id, count(*)::bigint as degree from (select source as id from edges union all select target from edges) group by id", graph=True)
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.degree(projection.edges(spark, sf_dir))


@query(f"select relation, count(*)::bigint as n, row_number() over (order by count(*) desc, min(edge_pos))::int as rank, relation in {_in(TRAVERSAL_RELATIONS)} as followed from edges group by relation", graph=True)
def relation_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of each relation, commonest first, and whether a walk follows it by default."""
    e = projection.edges(spark, sf_dir)
    return evaluate.most_common(e, "relation", "edge_pos").withColumn("followed", F.col("relation").isin(*TRAVERSAL_RELATIONS))


@query(_reach_sql(("P:1", "O:7"), 2, "up") + " select query_id, id, row_number() over (partition by query_id order by depth, id)::int as pos from reach", graph=True, recursive=True)
def blast_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A radius in the order it is shown in: by depth, then id."""
    n, e = _graph(spark, sf_dir, distinct=False)
    return traverse.ordered(traverse.radius(n, e, _seeds(spark, "P:1", "O:7"), 2, "up", members=False)).select("query_id", "id", "pos")


def _extra_edges(spark: SparkSession, sf_dir: str, e: DataFrame) -> DataFrame:
    """The projection's edges, and tests and configuration that no star schema has: test customers test the part of their number, parts read a region."""
    i = lambda p, c: F.concat(F.lit(f"{p}:"), c.cast("string"))
    make = lambda df, s, r, t: df.select(s.alias("source"), t.alias("target"), F.lit(r).alias("relation"), F.lit("INFERRED").alias("confidence")).withColumn("edge_pos", F.concat_ws("|", "relation", "source", "target"))
    tests = make(table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'"), i("C", F.col("c_custkey")), "tests", i("P", F.col("c_custkey")))
    config = make(table(spark, sf_dir, "part"), i("P", F.col("p_partkey")), "reads_config", i("R", F.col("p_partkey") % 5))
    return e.unionByName(tests).unionByName(config)


_TRIAGE_SQL = f"""with low as (select s_suppkey, s_name from supplier order by s_acctbal, s_suppkey limit 5),
report as (select 'V' || s_suppkey as query_id, s_name as description, 'P:' || (select min(l_partkey) from lineitem where l_suppkey = s_suppkey) as seed from low
  union all select 'L1', 'in a file', (select id from nodes where source_file = 'nation_3' and line <= 25 order by line desc limit 1) union all select 'X1', 'nowhere', null),
e2 as (select source, target, relation from edges union all select 'C:' || c_custkey, 'P:' || c_custkey, 'tests' from customer where c_mktsegment = 'BUILDING' union all select 'P:' || p_partkey, 'R:' || (p_partkey % 5), 'reads_config' from part),
adj as (select target as id, source as next from e2 where relation in {_in(TRAVERSAL_RELATIONS)}),
walk(query_id, id, depth) as (select query_id, seed, 0 from report where seed is not null union select w.query_id, a.next, w.depth + 1 from walk w join adj a using (id) where w.depth < 2),
reach as (select distinct query_id, id from walk),
closure as (select distinct r1.query_id, e.source, e.target, e.relation from e2 e join reach r1 on e.source = r1.id join reach r2 on e.target = r2.id and r1.query_id = r2.query_id),
taints as (select * from closure where relation in {_in(TAINT_RELATIONS)}), exposed as (select query_id, source as id from taints union select query_id, target from taints)
select r.query_id, r.description, r.seed, (select count(*) from reach x where x.query_id = r.query_id and r.seed is not null)::bigint as n_nodes, (select count(*) from closure x where x.query_id = r.query_id)::bigint as n_edges,
  (select count(distinct source) from e2 where target = r.seed and relation in {_in(TRAVERSAL_RELATIONS)})::bigint as n_callers, (select count(distinct target) from e2 where source = r.seed and relation in {_in(TRAVERSAL_RELATIONS)})::bigint as n_callees,
  (select count(*) from exposed x where x.query_id = r.query_id)::bigint as n_exposed, exists (select 1 from e2 where target = r.seed and relation = 'tests') as covered,
  coalesce((select string_agg(distinct target, ',' order by target) from e2 where source = r.seed and relation = 'reads_config'), '') as config
from report r"""


@query(_TRIAGE_SQL, graph=True, recursive=True)
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triage of a report: the first part of each of the suppliers with the lowest balance, a place in a file, and one that is nowhere. One traversal for all."""
    from .operators import triage as T

    n, e = _graph(spark, sf_dir, distinct=False)
    n = n.withColumn("source_file", F.concat("source_file", F.lit(".py")))
    low = table(spark, sf_dir, "supplier").orderBy("s_acctbal", "s_suppkey").limit(5).select("s_suppkey", "s_name")
    first = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.min("l_partkey").alias("p"))
    none = lambda t: F.lit(None).cast(t)
    found = low.join(first, low["s_suppkey"] == first["l_suppkey"]).select(F.concat(F.lit("V"), F.col("s_suppkey").cast("string")).alias("query_id"), F.col("s_name").alias("description"), none("string").alias("file"), none("int").alias("line"), F.concat(F.lit("P:"), F.col("p").cast("string")).alias("function"))
    placed = spark.createDataFrame([("L1", "in a file", "nation_3.py", 25, None), ("X1", "nowhere", "nation_99.py", 3, None)], found.schema)
    out = T.triage(found.unionByName(placed), n, _extra_edges(spark, sf_dir, e), max_nodes=None)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    return out.select(
        "query_id", "description", "seed", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"), size("callers").alias("n_callers"), size("callees").alias("n_callees"),
        size("exposed").alias("n_exposed"), (size("covered_by") > 0).alias("covered"), F.coalesce(F.array_join("config", ","), F.lit("")).alias("config"),
    )


# --- resolution ----------------------------------------------------------------

#: Fixed values of the resolution queries: other cases than the graph's, locations that parse, names with several meanings.
_ASKED = ("N:3", "n:3", "CUSTOMER#000000017()", "customer#000000018", ".SUPPLIER#000000003()", "nation_3.py:L25", "nation_3.py:17", "tests/nation_5.py:11", "nation_99.py:3", "red widget", "europe", "no such thing", "ORDER_77/", "ER#000000042", "dER_77()", "./nation_5.PY")
_BARE, _LEAF = "regexp_replace({}, '\\(\\)$', '')", "regexp_replace(regexp_replace({}, '\\(\\)$', ''), '^\\.+', '')"


@query(f"""with ask as (select query_id, lower(regexp_replace(query_id, '/+$', '')) as q, regexp_matches(query_id, '^[^:]+[.][A-Za-z0-9_]+:L?[0-9]+$') as placed from (values {", ".join(f"('{a}')" for a in _ASKED)}) t(query_id)),
n as (select id, lower(label) as label, lower(source_file) || '.py' as path, source_file || '.py' as file, line from nodes),
hits as (
  select query_id, 0 as rung, id from ask join n on id = query_id
  union all select query_id, 2, id from ask join n on label = q where not placed
  union all select query_id, 4, id from ask join n on {_BARE.format('label')} = {_BARE.format('q')} where not placed
  union all select query_id, 5, id from ask join n on {_LEAF.format('label')} = {_LEAF.format('q')} where not placed
  union all select query_id, 6, id from ask join n on path = regexp_replace(q, '^[.]/', '') where not placed),
one as (select query_id, rung, min(id) as id from hits group by query_id, rung having count(*) = 1
  union all select query_id, 1, max_by(id, line) from ask join n on file = regexp_extract(query_id, '^(.*):L?[0-9]+$', 1) and line <= regexp_extract(query_id, '([0-9]+)$', 1)::int where placed group by query_id),
best as (select query_id, min(rung) as rung, arg_min(id, rung) as id from one group by query_id),
loose as (select query_id, 7 as rung, min(id) as id from ask join n on contains(label, q) where not placed and query_id not in (select query_id from best) group by query_id having count(*) = 1)
select query_id, id, case rung when 0 then 'id' when 1 then 'location' when 2 then 'label' when 4 then 'bare' when 5 then 'leaf' when 6 then 'file' else 'substring' end as rung from (select query_id, rung, id from best union all select query_id, rung, id from loose)""", graph=True)  # fmt: skip
def resolve_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rung of the ladder that names exactly one node, case folded."""
    asked = spark.createDataFrame([(a, a) for a in _ASKED], "query_id string, query string")
    return resolve.resolve(asked, projection.nodes(spark, sf_dir).withColumn("source_file", F.concat("source_file", F.lit(".py"))))


_TERMS = ("CUSTOMER#00000001", "Widget", "o:12", "EUROPE", "Order_77", ".order_78()", "tests/nation_7")


@query(f"""with asked as (select query_id, lower(query_id) as q from (values {", ".join(f"('{a}')" for a in _TERMS)}) t(query_id)),
met as (select query_id, id, case when lower(label) = q or {_BARE.format('lower(label)')} = {_BARE.format('q')} or {_LEAF.format('lower(label)')} = {_LEAF.format('q')} or id = query_id then 0
  when contains(lower(label), q) then 2 when contains(lower(id), q) or contains(lower(coalesce(source_file, '')), q) then 3 end as match, ends_with(label, '()') as calls from asked, nodes),
r as (select query_id, id, match::int as match, row_number() over (partition by query_id order by match, not calls, id)::int as rank from met where match is not null)
select * from r where rank <= 15""", graph=True)  # fmt: skip
def search_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 best candidates for a search term, case folded."""
    asked = spark.createDataFrame([(a, a) for a in _TERMS], "query_id string, query string")
    return resolve.candidates(asked, projection.nodes(spark, sf_dir), limit=15)


_REFS_SQL = """refs as (select p_partkey as pos, case p_partkey % 4 when 0 then 'customer#' || lpad((p_partkey % 1500)::varchar, 9, '0') when 1 then 'nation_' || (p_partkey % 25) || '.py:L' || (p_partkey % 300) when 2 then 'C:' || (p_partkey % 1700) else 'nation_' || (p_partkey % 25) || '.py' end as q from part),
n as (select id, regexp_replace(lower(label), '\\(\\)$', '') as name, source_file || '.py' as file, line from nodes)"""


@query(f"""with {_REFS_SQL}, named as (select q, min(id) as id from (select distinct q from refs where q like 'customer#%') join n on name = q group by q having count(*) = 1),
placed as (select q, max_by(id, line) as id from (select distinct q from refs where q like '%:L%') join n on file = regexp_extract(q, '^(.*):L', 1) and line <= regexp_extract(q, '([0-9]+)$', 1)::int group by q),
filed as (select q, min(id) as id from (select distinct q from refs where q like '%.py') join n on file = q group by q having count(*) = 1),
known as (select * from named union all select * from placed union all select * from filed union all select distinct q, n.id from refs join n on n.id = q)
select pos, id as source_id, 'C:1' as target_id from refs left join known using (q)""", graph=True)  # fmt: skip
def finding_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with references by name, place, id and file: distinct references are resolved once; a file of many nodes names none of them."""
    k, n = F.col("p_partkey"), projection.nodes(spark, sf_dir).withColumn("source_file", F.concat("source_file", F.lit(".py")))
    none, text = F.lit(None).cast("string"), lambda x: x.cast("string")
    file = F.concat(F.lit("nation_"), text(k % 25), F.lit(".py"))
    node = F.when(k % 4 == 0, F.concat(F.lit("customer#"), F.lpad(text(k % 1500), 9, "0"))).when(k % 4 == 2, F.concat(F.lit("C:"), text(k % 1700)))
    ref = F.struct(node.alias("node"), F.when(node.isNull(), file).alias("file"), F.when(k % 4 == 1, (k % 300).cast("int")).alias("line"))
    found = table(spark, sf_dir, "part").select(k.alias("pos"), F.lit("taints").alias("relation"), ref.alias("source_ref"), F.struct(F.lit("C:1").alias("node"), none.alias("file"), F.lit(None).cast("int").alias("line")).alias("target_ref"))
    return E.resolve_findings(found, n).select("pos", "source_id", "target_id")


@query("""with asked as (select event_id::varchar as query_id, 'nation_' || (event_id % 25) as file, (user_id * 7 % 400)::int as line from events),
own as (select id, source_file as file, line from nodes where line is not null)
select query_id, max_by(id, o.line) as id, case when max(o.line) = any_value(a.line) then 'exact' else 'preceding' end as how from asked a join own o on o.file = a.file and o.line <= a.line group by query_id""", graph=True)  # fmt: skip
def locate_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest callable at or above each event's line of a nation's file."""
    ev = table(spark, sf_dir, "events")
    asked = ev.select(F.col("event_id").cast("string").alias("query_id"), F.concat(F.lit("nation_"), (F.col("event_id") % 25).cast("string")).alias("file"), (F.col("user_id") * 7 % 400).cast("int").alias("line"))
    return resolve.locate(asked, projection.nodes(spark, sf_dir))


_EXTENTS_SQL = "ext as (select 'f' || (p_partkey % 50) as file, 'def_' || p_partkey as name, (p_partkey * 13 % 900 + 1)::int as start_, (p_partkey * 13 % 900 + 1 + p_size * 5)::int as end_, p_partkey as pos from part), pts as (select event_id as query_id, 'f' || (event_id % 50) as file, (user_id * 11 % 1000 + 1)::int as line from events)"


def _extents(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, ev = table(spark, sf_dir, "part"), table(spark, sf_dir, "events")
    start = F.col("p_partkey") * 13 % 900 + 1
    ext = p.select(F.concat(F.lit("f"), (F.col("p_partkey") % 50).cast("string")).alias("file"), F.concat(F.lit("def_"), F.col("p_partkey").cast("string")).alias("name"), start.cast("int").alias("start"), (start + F.col("p_size") * 5).cast("int").alias("end"), F.col("p_partkey").alias("pos"))
    pts = ev.select(F.col("event_id").alias("query_id"), F.concat(F.lit("f"), (F.col("event_id") % 50).cast("string")).alias("file"), (F.col("user_id") * 11 % 1000 + 1).cast("int").alias("line"))
    return ext, pts


@query(f"with {_EXTENTS_SQL} select query_id, e.file, name, start_ as start, end_ as \"end\" from pts p join ext e on e.file = p.file and line between start_ and end_ qualify row_number() over (partition by query_id order by end_ - start_, pos) = 1")
def locate_interval_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smallest extent that holds each point."""
    ext, pts = _extents(spark, sf_dir)
    return resolve.enclosing(pts, ext)


@query(f"""with {_EXTENTS_SQL}, both_ as (select query_id, file, line, 0 as o from pts union all select query_id, file, line + 1, 1 from pts),
enc as (select query_id, o, e.file, name, start_ from both_ p join ext e on e.file = p.file and line between start_ and end_ qualify row_number() over (partition by query_id, o order by end_ - start_, pos) = 1)
select a.query_id, a.name from enc a join enc b on a.query_id = b.query_id and a.name = b.name and a.file = b.file and a.start_ = b.start_ where a.o = 0 and b.o = 1""")  # fmt: skip
def insertion_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extent a pure insertion belongs to, where both its neighbours agree."""
    ext, pts = _extents(spark, sf_dir)
    return resolve.insertion_anchor(pts, ext)


# --- links ---------------------------------------------------------------------


@query("""with names as (select 'S:' || s_suppkey as id, 'part_' || (s_suppkey % 97) as name, false as t from supplier union all select 'N:' || n_nationkey, 'part_' || (n_nationkey * 5 % 97), false from nation
  union all select 'C:' || c_custkey, case c_custkey % 3 when 0 then 'test_part_' when 1 then 'testpart_' else 'test part_' end || (c_custkey % 97) || case when c_custkey % 50 = 0 then '-x' else '' end, true from customer where c_mktsegment = 'BUILDING'),
one as (select name, min(id) as target_id from names where not t group by name having count(*) = 1)
select id as test_id, target_id from names join one on regexp_extract(names.name, '^test[_ ]?(\\w+)$', 1) = one.name where t""")  # fmt: skip
def unique_name_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests linked to the one node outside the tests that they are named after, callable or not, case folded."""
    name = lambda pre, k, post="": F.concat(pre, (k % 97).cast("string"), F.lit(post))
    row = lambda p, k, label, file: [F.concat(F.lit(f"{p}:"), F.col(k).cast("string")).alias("id"), label.alias("label"), F.lit(file).alias("source_file"), F.lit(None).cast("boolean").alias("_callable")]
    s = table(spark, sf_dir, "supplier").select(*row("S", "s_suppkey", name(F.lit("Part_"), F.col("s_suppkey"), "()"), "src/a.py"))
    n = table(spark, sf_dir, "nation").select(*row("N", "n_nationkey", name(F.lit("PART_"), F.col("n_nationkey") * 5), "src/b.py"))
    k = F.col("c_custkey")
    stem = F.when(k % 3 == 0, "test_Part_").when(k % 3 == 1, "TestPart_").otherwise("TEST part_")
    c = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(*row("C", "c_custkey", F.concat(name(stem, k), F.when(k % 50 == 0, "-x").otherwise("")), "tests/a.py"))
    return E.unique_name_links(s.unionByName(n).unionByName(c))


@query("""with calls as (select 'O:' || o_orderkey as source, 'f' || (o_orderkey % 40) as file, 'fn_' || (o_custkey % 1400) as callee from orders),
fns as (select 'P:' || p_partkey as id, 'f' || (p_partkey % 40) as file, 'fn_' || (p_partkey % 1301) as name from part),
loc as (select file, name, min(id) as id from fns group by file, name having count(*) = 1), whole as (select name, min(id) as id from fns group by name having count(*) = 1)
select distinct source, coalesce(l.id, g.id) as target, case when l.id is not null then 'same-file' else 'graph-unique' end as scope from calls c left join loc l on l.file = c.file and l.name = c.callee left join whole g on g.name = c.callee where coalesce(l.id, g.id) is not null""")  # fmt: skip
def tiered_callee(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls linked to the one callable of that name in the file, else in the graph."""
    s = lambda pre, c: F.concat(F.lit(pre), c.cast("string"))
    calls = table(spark, sf_dir, "orders").select(s("O:", F.col("o_orderkey")).alias("source"), s("f", F.col("o_orderkey") % 40).alias("file"), s("fn_", F.col("o_custkey") % 1400).alias("callee"))
    fns = table(spark, sf_dir, "part").select(s("P:", F.col("p_partkey")).alias("id"), s("f", F.col("p_partkey") % 40).alias("file"), s("fn_", F.col("p_partkey") % 1301).alias("name"))
    return E.tiered_callees(calls, fns)


@query("""with defs as (select 'nation_' || c_nationkey as file, c_name as name, ((c_custkey % 90) * 10 + 1)::int as def_line from customer),
known as (select source_file as file, line as def_line, regexp_replace(label, '[()]+$', '') as leaf from nodes where line is not null)
select file, def_line, name from defs d where not exists (select 1 from known k where k.file = d.file and k.def_line = d.def_line and k.leaf = d.name)""", graph=True)  # fmt: skip
def known_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that no node stands for."""
    defs = table(spark, sf_dir, "customer").select(F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("file"), F.col("c_name").alias("name"), ((F.col("c_custkey") % 90) * 10 + 1).cast("int").alias("def_line"))
    return E.unmodelled(defs, projection.nodes(spark, sf_dir)).select("file", "def_line", "name")


_WORDS_SQL = "select distinct {id} as {out}, unnest(regexp_extract_all(lower(text), '[a-z]{{9,}}')) as key from {table}"


@query(f"with r as ({_WORDS_SQL.format(id='doc_id', out='source', table='documents')}), d as ({_WORDS_SQL.format(id='item_id', out='target', table='benchmark')}) select distinct source, target, key from r join d using (key)")
def many_to_many_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that reads a key joined with every item that defines it."""
    words = lambda name, i, out: table(spark, sf_dir, name).select(F.col(i).alias(out), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{9,})"), F.lit(1))).alias("key")).distinct()
    return E.key_links(words("documents", "doc_id", "source"), words("benchmark", "item_id", "target"))


_TESTS_SQL = f"""with shown(query_id, touches) as (values ('O:7', 'O:7'), ('O:7', 'O:8'), ('O:9', 'O:9'), ('O:9', 'O:21')), e as (select * from edges where relation not in {_in(NOT_A_TEST_LINK)}),
ends as (select source as test_id, target as touches, relation from e union all select target, source, relation from e)
select distinct query_id, test_id, touches, relation from ends join shown using (touches) join nodes n on n.id = test_id where n.source_file like 'tests/%' and test_id <> touches"""


@query(_TESTS_SQL, graph=True)
def test_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests that touch what is shown, either way round."""
    n, e = _graph(spark, sf_dir)
    shown = spark.createDataFrame([("O:7", "O:7"), ("O:7", "O:8"), ("O:9", "O:9"), ("O:9", "O:21")], "query_id string, id string")
    return E.related_tests(n, e, shown, NOT_A_TEST_LINK)


@query(f"""with seeds(query_id, seed) as (values ('O:7', 'O:7'), ('O:9', 'O:9'), ('P:1', 'P:1')), near as (select query_id, seed as touches from seeds union select query_id, source from seeds join edges on target = seed and relation = 'references'),
e as (select source, target, relation from edges where relation not in {_in(NOT_A_TEST_LINK)} union all select 'C:' || c_custkey, 'P:' || c_custkey, 'tests' from customer where c_mktsegment = 'BUILDING'),
ends as (select source as test_id, target as touches, relation from e union all select target, source, relation from e),
met as (select distinct query_id, test_id, touches, relation, n.source_file as file, n.label from ends join near using (touches) join nodes n on n.id = test_id where n.source_file like 'tests/%' and test_id <> touches)
select query_id, test_id, touches, relation, row_number() over (partition by query_id order by touches <> query_id, relation <> 'tests', file, label, touches, relation)::int as rank from met""", graph=True)  # fmt: skip
def test_links_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related tests as they are listed: those of the seed itself, then those that say so, then by file and label."""
    n, e = _graph(spark, sf_dir)
    seeds = _seeds(spark, "O:7", "O:9", "P:1")
    near = seeds.unionByName(e.where("relation = 'references'").join(seeds.withColumnRenamed("id", "target"), "target").select("query_id", F.col("source").alias("id"))).distinct()
    tests = E.related_tests(n, _extra_edges(spark, sf_dir, e), near, NOT_A_TEST_LINK)
    return E.tests_in_order(tests, seeds, n).select("query_id", "test_id", "touches", "relation", "rank")


@query(f"""with owners as (select source as owner from edges where target = 'C:5' and relation in {_in(MEMBER_RELATIONS)})
select distinct 'C:5' as query_id, e.target as id, n.label, o.owner from owners o join edges e on e.source = o.owner and e.relation in {_in(MEMBER_RELATIONS)} join nodes n on n.id = e.target where e.target <> 'C:5' and ends_with(n.label, '()')""", graph=True)  # fmt: skip
def siblings_via_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callable members of the seed's owner other than the seed."""
    from .operators import pack

    n, e = _graph(spark, sf_dir)
    return pack.siblings(n, e, _seeds(spark, "C:5")).select("query_id", "id", "label", "owner")


@query("select distinct target as query_id, source as id, n.label, relation from edges join nodes n on n.id = source where target in ('O:7', 'O:8') and relation in ('calls', 'indirect_call')", graph=True)
def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers of the seed."""
    from .operators import pack

    n, e = _graph(spark, sf_dir)
    return pack.call_sites(n, e, _seeds(spark, "O:7", "O:8")).select("query_id", "id", "label", "relation")


# --- ranking -------------------------------------------------------------------

_RANK_SQL = _reach_sql(("P:1", "P:4"), 2, "up") + f""", closure as (select distinct r1.query_id, e.* from edges e join reach r1 on e.source = r1.id join reach r2 on e.target = r2.id and r1.query_id = r2.query_id),
ends as (select query_id, target as id, relation, edge_pos, 0 as o from closure union all select query_id, source, relation, edge_pos, 1 from closure),
v as (select query_id, id, arg_min(relation, edge_pos || o) as via from ends group by query_id, id),
rows_ as (select r.query_id, r.id, n.label, r.depth, v.via, {_case(RELATION_WEIGHTS, "v.via", 0.3)}::double * pow(0.5, r.depth) as score, (r.id <> r.query_id)::int as other, (right(r.id, 1) <> '7')::int as apart from reach r join nodes n on n.id = r.id left join v on v.query_id = r.query_id and v.id = r.id)"""


@query(_RANK_SQL + " select query_id, id, via from v", graph=True, recursive=True)
def via_first_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relation of the first closure edge that touches each node."""
    n, e = _graph(spark, sf_dir, distinct=False)
    return rank.via(traverse.closure_edges(e, traverse.radius(n, e, _seeds(spark, "P:1", "P:4"), 2, "up", members=False))).select("query_id", "id", "via")


def _rank_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, e = _graph(spark, sf_dir, distinct=False)
    reach = traverse.radius(n, e, _seeds(spark, "P:1", "P:4"), 2, "up", members=False)
    v = rank.via(traverse.closure_edges(e, reach))
    return reach.join(n.select("id", "label"), "id").join(v, ["query_id", "id"], "left").select("query_id", "id", F.col("query_id").alias("seed"), "label", "depth", "via", F.col("id").endswith("7").alias("mentioned"))


def _rank_query(name: str, order: str, keys: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rank.ranked(_rank_rows(spark, sf_dir), order).select("query_id", "id", F.round("score", 9).alias("score"), "rank")

    run.__name__ = name
    query(_RANK_SQL + f" select query_id, id, round(score, 9) as score, row_number() over (partition by query_id order by {keys})::int as rank from rows_", graph=True, recursive=True)(run)


_rank_query("order_mention_first", "mention-first", "other, apart, depth, -score, not starts_with(label, '.'), id")
_rank_query("order_mention", "mention", "other, depth, apart, -score, not starts_with(label, '.'), id")
_rank_query("order_current", "current", "other, depth, -score, not starts_with(label, '.'), id")
_rank_query("order_legacy", "legacy", f"other, depth, {_case(LEGACY_RANK, 'via', 5)}, label, id")

_FILL_SQL = """c as (select conv_id as query_id, turn as rank, greatest(1, length(text) // 4)::bigint as cost, row_number() over (partition by conv_id order by turn) as k from conversations qualify row_number() over (partition by conv_id, turn order by text) = 1),
f(query_id, k, rank, taken, used) as (
  select query_id, k, rank, cost <= 600, case when cost <= 600 then cost else 0 end from c where k = 1
  union all select c.query_id, c.k, c.rank, f.used + c.cost <= 600, f.used + case when f.used + c.cost <= 600 then c.cost else 0 end from f join c on c.query_id = f.query_id and c.k = f.k + 1)"""


@query(f"with recursive {_FILL_SQL} select query_id, rank, taken, used::bigint as used from f")
def greedy_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation that fit a budget of 600 tokens, skipping what does not fit."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    rows = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).alias("cost"))
    return rank.greedy_fill(rows.withColumn("rank", F.col("rank").cast("int")), 600).select("query_id", F.col("rank").cast("long").alias("rank"), "taken", "used")


@query(f"""with recursive {_FILL_SQL}, spent as (select query_id, max(used) as spent from f group by query_id),
w as (select f.query_id, f.rank, 5 + (f.rank % 7) as ic, greatest(20, 600 - spent) as cap, row_number() over (partition by f.query_id order by f.rank) as k from f join spent s using (query_id) where not taken),
g(query_id, k, rank, listed, used, cap) as (
  select query_id, k, rank, ic <= cap, case when ic <= cap then ic else 0 end, cap from w where k = 1
  union all select w.query_id, w.k, w.rank, g.used + w.ic <= w.cap, g.used + case when g.used + w.ic <= w.cap then w.ic else 0 end, w.cap from g join w on w.query_id = g.query_id and w.k = g.k + 1)
select query_id, rank::bigint as rank, 'body' as tier from f where taken union all select query_id, rank::bigint, case when listed then 'index' else 'omitted' end from g""")  # fmt: skip
def index_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What does not fit as a body competes for the index."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    rows = c.select(F.col("conv_id").alias("query_id"), F.col("turn").cast("int").alias("rank"), F.lit("-").alias("seed"), F.col("turn").cast("string").alias("id"), F.lit(1).alias("depth"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).alias("cost"), (F.col("turn") % 7 + 5).alias("index_cost"))
    return rank.two_tier_fill(rows, 600, 20).select("query_id", F.col("rank").cast("long").alias("rank"), "tier")


# --- ordered state ---------------------------------------------------------------


@query("select conv_id, turn, role, lead(role) over (partition by conv_id order by turn, text) as next from conversations qualify next is not null")
def flow_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive roles of each conversation."""
    c = table(spark, sf_dir, "conversations").withColumn("pos", F.struct("turn", "text"))
    return evaluate.flow_pairs(c, "conv_id", "pos", "role").select("conv_id", F.col("pos.turn").alias("turn"), "role", "next")


@query("select event_id, last_value(case when event_type = 'click' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as last_click from events")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user's last click up to each event."""
    ev = table(spark, sf_dir, "events")
    return evaluate.carry_forward(ev, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "click", F.col("event_id")), "last_click").select("event_id", "last_click")


# --- provenance ------------------------------------------------------------------



@query("""with s as (select user_id, event_type, event_id as pos, value, 0 as gen from events where event_id % 3 <> 0 union all select user_id, event_type, event_id, value, 1 from events where event_id % 3 = 0),
r as (select *, row_number() over (partition by user_id, event_type order by gen desc, pos desc) as newest, row_number() over (partition by user_id, event_type order by gen, pos) as oldest from s)
select a.user_id, a.event_type, a.value, b.gen::int as generation, b.pos from r a join r b using (user_id, event_type) where a.newest = 1 and b.oldest = 1""")  # fmt: skip
def findings_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later finding of the same key replaces the stored one in its place."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_type", "value", F.col("event_id").alias("pos"))
    return E.upsert(ev.where("pos % 3 <> 0"), ev.where("pos % 3 = 0"), ["user_id", "event_type"]).select("user_id", "event_type", "value", "generation", "pos")


_FOUND_SQL = """found as (select 'C:' || (event_id % 40) as source_id, case when event_id % 11 <> 0 then 'C:' || (user_id % 40) end as target_id, case when event_type = 'view' then 'taints' when event_type = 'click' then 'reaches_sink' else event_type end as relation, event_type = 'view' as skip_self, event_id as pos from events),
judged as (select *, case when relation not in ('taints', 'reaches_sink', 'tests', 'reads_config') then 'unknown_relation' when source_id is null then 'unresolved_source' when target_id is null then 'unresolved_target' when source_id = target_id and skip_self then 'self_edge' end as reason from found)"""


def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, c = table(spark, sf_dir, "events"), lambda x: F.concat(F.lit("C:"), (x % 40).cast("string"))
    relation = F.when(F.col("event_type") == "view", "taints").when(F.col("event_type") == "click", "reaches_sink").otherwise(F.col("event_type"))
    rows = ev.select(c(F.col("event_id")).alias("source_id"), F.when(F.col("event_id") % 11 != 0, c(F.col("user_id"))).alias("target_id"), relation.alias("relation"), (F.col("event_type") == "view").alias("skip_self"), F.col("event_id").alias("pos"), F.lit(None).cast("string").alias("confidence"), F.lit(None).cast("double").alias("confidence_score"), F.lit(None).cast("string").alias("detail"))
    return E.validated(rows)


@query(f"with {_FOUND_SQL} select coalesce(reason, 'applied') as reason, count(*)::bigint as n from (select reason from judged where reason is not null union all select null from (select distinct source_id, target_id, relation from judged where reason is null)) group by 1")
def validation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings counted by why they are refused, and the edges applied."""
    none = spark.createDataFrame([], "source string, target string, relation string, confidence string, confidence_score double, origin string, detail string")
    return E.merge(none, _found(spark, sf_dir))[1]


@query(f"with {_FOUND_SQL} select distinct source_id as source, target_id as target, relation, 'EXTERNAL' as confidence from judged where reason is null")
def edge_merge_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merging findings twice gives what merging them once gives."""
    none = spark.createDataFrame([], "source string, target string, relation string, confidence string, confidence_score double, origin string, detail string")
    found = _found(spark, sf_dir)
    return E.merge(E.merge(none, found)[0], found)[0].select("source", "target", "relation", "confidence")


# --- differences -------------------------------------------------------------------

_SNAP_SQL = "a as (select source, target, relation, confidence from edges where substr(source, 3)::bigint % 50 <> 1), b as (select source, target, relation, case when relation = 'uses' and substr(target, 3)::bigint % 400 = 3 then 'AMBIGUOUS' else confidence end as confidence from edges where substr(source, 3)::bigint % 50 <> 2)"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e, num = projection.edges(spark, sf_dir), lambda c: F.substring(c, 3, 20).cast("long")
    b = e.withColumn("confidence", F.when((F.col("relation") == "uses") & (num("target") % 400 == 3), "AMBIGUOUS").otherwise(F.col("confidence")))
    return e.where(num("source") % 50 != 1), b.where(num("source") % 50 != 2)


@query(f"with {_SNAP_SQL} select *, 'added' as change from (select * from b except select * from a) union all select *, 'removed' from (select * from a except select * from b)", graph=True)
def edge_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge fingerprints that came or went between two snapshots."""
    return diff.edge_diff(*_snapshots(spark, sf_dir), columns=("source", "target", "relation", "confidence"))


@query(f"""with {_SNAP_SQL} select 'nodes' as part, (select count(*) from (select distinct source from a except select distinct source from b))::bigint as only_a, (select count(*) from (select distinct source from b except select distinct source from a))::bigint as only_b
union all select 'edges', (select count(*) from (select * from a except select * from b))::bigint, (select count(*) from (select * from b except select * from a))::bigint""", graph=True)  # fmt: skip
def graph_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of two graphs differs."""
    a, b = _snapshots(spark, sf_dir)
    return diff.graph_equality(a.select(F.col("source").alias("id")), a, b.select(F.col("source").alias("id")), b, ("id",), ("source", "target", "relation", "confidence"))


_RUNS_SQL = "a as (select o_custkey as task, case when count(*) % 5 <> 0 then sum(o_totalprice) / 1e6 end as v from orders where o_orderdate < '1998-01-01' group by 1), b as (select o_custkey as task, case when count(*) % 4 <> 0 then sum(o_totalprice) / 1e6 end as v from orders where o_orderdate >= '1998-01-01' group by 1)"


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "task")
    run = lambda x, m: x.groupBy("task").agg(F.when(F.count("*") % m != 0, F.sum("o_totalprice") / 1e6).alias("v"))
    return run(o.where("o_orderdate < '1998-01-01'"), 5), run(o.where("o_orderdate >= '1998-01-01'"), 4)


@query(f"""with {_RUNS_SQL} select coalesce(a.task, b.task) as task, round(a.v, 4) as base, round(b.v, 4) as now, case when a.task is null then 'new' when b.task is null then 'missing' when a.v is null and b.v is null then 'same' when a.v is null or b.v is null then 'regressed' when b.v > a.v + 1e-9 then 'improved' when b.v < a.v - 1e-9 then 'regressed' else 'same' end as verdict from a full join b on a.task = b.task""")
def baseline_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of all tasks compared, with new and missing tasks."""
    a, b = _runs(spark, sf_dir)
    return diff.baseline_diff(a, b, "task", "v").withColumn("base", F.round("base", 4)).withColumn("now", F.round("now", 4))


@query(f"""with {_RUNS_SQL} select a.task, case when a.v is null and b.v is null then 'still_unscored' when a.v is null then 'newly_scoreable' when b.v is null then 'lost' when b.v > a.v + 1e-9 then 'improved' when b.v < a.v - 1e-9 then 'regressed' else 'same' end as verdict from a left join b using (task)""")
def ab_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two configurations compared on the first one's tasks."""
    return diff.ab_diff(*_runs(spark, sf_dir), "task", "v").select("task", "verdict")


@query("""with a(key, value) as (values ('depth', '2'), ('budget', '6000'), ('order', 'current')), b(key, value) as (values ('depth', '3'), ('budget', '6000'), ('index', '300'))
select coalesce(a.key, b.key) as key, a.value as a, b.value as b from a full join b on a.key = b.key where a.value is distinct from b.value""")  # fmt: skip
def config_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    make = lambda *rows: spark.createDataFrame(list(rows), "key string, value string")
    return diff.config_diff(make(("depth", "2"), ("budget", "6000"), ("order", "current")), make(("depth", "3"), ("budget", "6000"), ("index", "300")))


# --- evaluation ----------------------------------------------------------------------

_PR_SQL = """w as (select distinct l_suppkey as task, l_partkey as part from lineitem where l_quantity > 20), r as (select distinct l_suppkey as task, l_partkey as part from lineitem where l_discount > 0.05),
pr as (select coalesce(w.task, r.task) as task, count(w.part)::bigint as n_wanted, count(r.part)::bigint as n_returned, count(case when w.part is not null and r.part is not null then 1 end)::bigint as hits from w full join r on w.task = r.task and w.part = r.part group by 1),
scored as (select *, case when n_wanted > 0 then hits / n_wanted end as recall, case when n_returned > 0 then hits / n_returned else 0.0 end as precision from pr)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("task"), F.col("l_partkey").alias("part"), "l_quantity", "l_discount")
    return evaluate.recall_precision(li.where("l_quantity > 20"), li.where("l_discount > 0.05"), ["part"])


@query(f"with {_PR_SQL} select task, n_wanted, n_returned, hits, round(recall, 6) as recall, round(precision, 6) as precision from scored")
def recall_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).withColumn("recall", F.round("recall", 6)).withColumn("precision", F.round("precision", 6))


@query(f"with {_PR_SQL} select s_nationkey as repo, count(*)::bigint as n, count(recall)::bigint as n_scored, round(avg(recall), 6) as mean, round(median(recall), 6) as median, round(min(recall), 6) as low, count_if(recall = 0)::bigint as zeros, count_if(recall = 1)::bigint as perfect from scored join supplier on s_suppkey = task group by 1")
def agg_by_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summary of recall for each nation."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("task"), F.col("s_nationkey").alias("repo"))
    out = evaluate.summary(_scores(spark, sf_dir).join(s, "task"), ["repo"], "recall")
    for c in ("mean", "median", "low"):
        out = out.withColumn(c, F.round(c, 6))
    return out


_ARMS_SQL = "arms as (select o_custkey as task, o_orderstatus as arm, o_totalprice > 200000 as ok, o_totalprice as cost from orders)"


def _arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("task"), F.col("o_orderstatus").alias("arm"), (F.col("o_totalprice") > 200000).alias("ok"), F.col("o_totalprice").alias("cost"))


@query(f"with {_ARMS_SQL}, full_ as (select task from arms group by task having count(distinct arm) = (select count(distinct arm) from arms)) select arm, count(*)::bigint as runs, count_if(ok)::bigint as resolved, count(distinct task)::bigint as tasks from arms where task in (select task from full_) group by arm")
def paired_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arms compared on the tasks that all of them have run."""
    rows = _arms(spark, sf_dir)
    return evaluate.with_all(rows, "task", rows.select("arm")).groupBy("arm").agg(F.count("*").alias("runs"), F.count_if("ok").alias("resolved"), F.countDistinct("task").alias("tasks"))


@query(f"with {_ARMS_SQL} select arm, count(*)::bigint as runs, round(avg(ok::int), 6) as rate, round(avg(cost), 2) as mean_cost from arms group by arm")
def resolve_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _arms(spark, sf_dir).groupBy("arm").agg(F.count("*").alias("runs"), F.round(F.avg(F.col("ok").cast("int")), 6).alias("rate"), F.round(F.avg("cost"), 2).alias("mean_cost"))


@query("select o_custkey as task, count_if(o_orderstatus = 'F') > 0 and count_if(o_orderstatus = 'F' and o_totalprice <= 50000) = 0 and count_if(o_orderstatus = 'O' and o_totalprice <= 50000) = 0 as resolved from orders where o_orderstatus in ('F', 'O') group by 1")
def resolved_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs whose wanted tests all pass and that break nothing."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus in ('F', 'O')")
    return evaluate.resolved(o.select(F.col("o_custkey").alias("task"), F.when(F.col("o_orderstatus") == "F", "f2p").otherwise("p2p").alias("kind"), (F.col("o_totalprice") > 50000).alias("passed")), ["task"])


@query("with t as (select event_type as label, value as seconds from events where value > 0), g as (select label, min(seconds) as best, median(seconds) as middle from t group by label) select label, best, round(middle, 6) as middle, round((select best from g where label = 'view') / best, 6) as ratio from g")
def speedup_min_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "events").where("value > 0").select(F.col("event_type").alias("label"), F.col("value").alias("seconds"))
    return evaluate.speedup(t, baseline="view").withColumn("middle", F.round("middle", 6)).withColumn("ratio", F.round("ratio", 6))


@query("""with b as (select l_orderkey as test, max(l_quantity) > 30 as p from lineitem where l_linenumber <= 3 group by 1), a as (select l_orderkey as test, max(l_quantity) > 30 as p from lineitem where l_linenumber > 2 group by 1)
select coalesce(a.test, b.test) as test, case when not coalesce(b.p, false) and coalesce(a.p, false) then 'fail_to_pass' when coalesce(b.p, false) and coalesce(a.p, false) then 'pass_to_pass' when coalesce(b.p, false) then 'pass_to_fail' else 'still_failing' end as outcome from a full join b on a.test = b.test""")  # fmt: skip
def f2p_p2p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each test from the runs before and after."""
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "test")
    side = lambda x: x.groupBy("test").agg((F.max("l_quantity") > 30).alias("passed"))
    return evaluate.classify_tests(side(li.where("l_linenumber <= 3")), side(li.where("l_linenumber > 2")))


@query("select case when o_orderstatus = 'P' then 'revert' when o_totalprice < 30000 then 'no_ground_truth' when o_orderpriority like '5%' then 'single_symbol' when row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) > 1 then 'duplicate_entry' else 'kept' end as reason, count(*)::bigint as n from (select *, row_number() over () from orders) group by 1".replace("row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) > 1", "dup > 1").replace("select *, row_number() over () from orders", "select *, row_number() over (partition by o_custkey, o_orderpriority order by o_orderkey) as dup from orders"))
def selection_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why candidates are dropped, each under its first reason."""
    o = table(spark, sf_dir, "orders").withColumn("dup", F.row_number().over(Window.partitionBy("o_custkey", "o_orderpriority").orderBy("o_orderkey")))
    return evaluate.funnel(o, [("revert", F.col("o_orderstatus") == "P"), ("no_ground_truth", F.col("o_totalprice") < 30000), ("single_symbol", F.col("o_orderpriority").startswith("5")), ("duplicate_entry", F.col("dup") > 1)])


# --- text, state ------------------------------------------------------------------------


@query("""with known as (select url as path, md5(html) as md5 from pages where page_id % 7 <> 0), now as (select url as path, md5(case when page_id % 5 = 0 then html || ' ' else html end) as md5 from pages where page_id % 11 <> 0)
select path, case when n.md5 is null then 'deleted' else 'edited' end as reason from (select path, max(md5) as md5 from known group by path) k left join (select path, max(md5) as md5 from now group by path) n using (path) where n.md5 is null or n.md5 <> k.md5""")  # fmt: skip
def manifest_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that changed or went since the manifest was written."""
    from .operators import state

    p = table(spark, sf_dir, "pages")
    make = lambda x, c: x.groupBy(F.col("url").alias("path")).agg(F.max(F.md5(c)).alias("md5"))
    return state.stale(make(p.where("page_id % 7 <> 0"), F.col("html")), make(p.where("page_id % 11 <> 0"), F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html"))))


_SEMGREP_SQL = "f as (select event_id, json_extract_string(props, '$.k')::int as k, event_type from events)"


@query(f"with {_SEMGREP_SQL} select event_id, case when k % 3 = 0 then 'trace' when k % 3 = 1 and event_type in ('click', 'error') then 'declared' else 'skipped' end as class, case when k % 3 = 0 then 1.0 when k % 3 = 1 and event_type in ('click', 'error') then round(0.9 * case event_type when 'error' then 1.0 else 0.9 end, 4) end::double as score from f")
def semgrep_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scanner results by whether they carry a trace, match a declared rule, or are skipped."""
    from .sources import scanners

    ev = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    rows = ev.select("event_id", F.col("event_type").alias("check_id"), F.when(F.col("k") % 3 == 0, F.lit("{}")).alias("trace"), F.when(F.col("k") % 3 == 2, F.lit("none")).otherwise(F.col("event_type")).alias("rule"), F.when(F.col("event_type") == "error", "ERROR").otherwise("OTHER").alias("severity"))
    out = scanners.classify(rows.withColumn("check_id", F.col("rule")), ("click", "error"))
    return out.select("event_id", "class", F.round(F.when(F.col("class") == "trace", 1.0).otherwise(F.col("score")), 4).alias("score"))


@query("with l as (select doc_id, unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) as text, generate_subscripts(string_split(regexp_replace(text, '\\n$', ''), chr(10)), 1)::int as line from documents) select doc_id, line, regexp_extract(text, '([A-Za-z_]+) = \"[0-9a-f]{16,}', 1) as key from l where regexp_matches(text, '[A-Za-z_]+ = \"[0-9a-f]{16,}')")
def line_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that assign a long hexadecimal value, with the key they assign."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.inline(X.lines(F.col("text"))))
    pattern = '([A-Za-z_]+) = "[0-9a-f]{16,}'
    return d.where(F.col("text").rlike(pattern)).select("doc_id", "line", F.regexp_extract("text", pattern, 1).alias("key"))


@query(r"""with c as (select page_id, url, regexp_replace(regexp_replace(url, '[^A-Za-z0-9._-]', '-', 'g'), '^\.+|\.+$', '', 'g') as clean from pages) select page_id, case when clean = url then url else clean || '-' || substr(sha1(url), 1, 8) end as slot from c""")
def slot_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Branch names made fit for partition values."""
    return table(spark, sf_dir, "pages").select("page_id", X.slot_name(F.col("url")).alias("slot"))


@query(r"""with p as (select page_id, url as path, regexp_extract(url, '[^/]*$') as name from pages) select page_id, len(list_filter(string_split(path, '/'), lambda x: lower(x) in ('tests', 'test', 'spec', 'specs', '__tests__'))) > 0 or regexp_matches(name, '(?i)^(test_.*|.*_test\..+|.*\.test\..+|.*\.spec\..+|.*_spec\..+|.*\.tests\.ps1)$') or regexp_matches(name, '^(.*Test\.java|.*Tests\.java|.*Tests\.cs)$') as is_test, name as basename, lower(regexp_extract(name, '\.([^.]+)$', 1)) as suffix from p""")
def path_preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", X.is_test_path(p).alias("is_test"), X.basename(p).alias("basename"), X.suffix(p).alias("suffix"))


@query("""select distinct page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) as target from pages""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Import-like edges: what each page links to."""
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("target")).distinct()


@query("select doc_id, greatest(1, length(text) // 4)::bigint as tokens, md5(text) as md5 from documents")
def token_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.token_count(F.col("text")).alias("tokens"), F.md5("text").alias("md5"))


@query("select conv_id, turn, role, text from conversations qualify row_number() over (partition by conv_id, role order by turn, text) = 1")
def first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.first_wins(table(spark, sf_dir, "conversations"), ["conv_id", "role"], F.struct("turn", "text")).select("conv_id", "turn", "role", "text")


@query("select case when ends_with(label, '()') then 'callable' else 'other' end as kind, count(*)::bigint as n, count(distinct source_file)::bigint as files from nodes group by 1", graph=True)
def node_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = projection.nodes(spark, sf_dir)
    return n.groupBy(F.when(X.is_callable(F.col("_callable"), F.col("label")), "callable").otherwise("other").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("source_file").alias("files"))


# --- source code -------------------------------------------------------------------------


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``file, text``: one Python file a nation, with a class whose methods are its customers; every third one holds a nested function."""
    c = table(spark, sf_dir, "customer")
    key = F.col("c_custkey").cast("string")
    method = F.concat(F.lit("    def customer_"), key, F.lit("(self):\n        return supplier_"), (F.col("c_custkey") % 7).cast("string"), F.lit("()"))
    nested = F.concat(F.lit("    def customer_"), key, F.lit("(self):\n        def inner_"), key, F.lit("(): return 1"))
    lines = c.select(F.col("c_nationkey").alias("k"), F.struct("c_custkey", F.when(F.col("c_custkey") % 3 == 0, nested).otherwise(method).alias("t")).alias("m"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda m: m["t"]), "\n")
    return lines.groupBy("k").agg(body.alias("body")).select(F.format_string("nation_%d.py", F.col("k")).alias("file"), F.concat(F.lit("class Nation"), F.col("k").cast("string"), F.lit(":\n"), F.col("body"), F.lit("\n")).alias("text"))


_DEFS_SQL = """m as (select c_nationkey as k, c_custkey as c, 'nation_' || c_nationkey || '.py' as file, 'Nation' || c_nationkey as cls, (row_number() over (partition by c_nationkey order by c_custkey) * 2)::int as l from customer),
defs as (select file, cls as name, 'class' as kind, 1 as start, (max(l) + 1)::int as end_, 1 as def_line from m group by file, cls
  union all select file, cls || '.customer_' || c, 'function', l, l + 1, l from m union all select file, cls || '.customer_' || c || '.inner_' || c, 'function', l + 1, l + 1, l + 1 from m where c % 3 = 0)"""


@query(f'with {_DEFS_SQL} select file, name, kind, start, end_ as "end", def_line from defs')
def source_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of generated source files with their extents."""
    from .operators import symbols

    return symbols.definitions(_sources(spark, sf_dir)).select("file", "name", "kind", "start", "end", "def_line")


@query(f"with {_DEFS_SQL} select file, name, def_line from defs where name like '%inner%'")
def nested_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions inside functions."""
    from .operators import symbols

    return symbols.nested_in_function(symbols.definitions(_sources(spark, sf_dir)))


def _parsed(files: DataFrame) -> DataFrame:
    """Definitions, written once: parsing is the one step here that is not cheap to repeat."""
    from .operators import symbols
    from .plans.lineage import cut

    return cut(symbols.definitions(files), "definitions")


def _modelled(spark: SparkSession, defs: DataFrame) -> DataFrame:
    """Nodes for every file and class and for methods of even customers."""
    d = defs.where("name not like '%inner%'").withColumn("leaf", F.substring_index("name", ".", -1))
    member = F.col("kind") == "function"
    some = d.where(~member | (F.regexp_extract("leaf", "(\\d+)$", 1).try_cast("long") % 2 == 0))
    own = some.select(F.concat_ws("::", "file", "name").alias("id"), F.when(member, F.concat(F.lit("."), F.col("leaf"), F.lit("()"))).otherwise(F.col("leaf")).alias("label"), F.col("file").alias("source_file"), F.concat(F.lit("L"), F.col("def_line").cast("string")).alias("source_location"))
    files = d.select(F.regexp_replace("file", "[.]", "_").alias("id"), F.col("file").alias("label"), F.col("file").alias("source_file"), F.lit("L1").alias("source_location")).distinct()
    every = own.unionByName(files)
    return every.select("*", F.lit(None).cast("boolean").alias("_callable"), F.lit(None).cast("string").alias("qualified_name"), F.lit(None).cast("string").alias("origin"))


@query(f"""with {_DEFS_SQL} select lower('nation_' || k || '_py_' || cls || '_customer_' || c) as id, '.customer_' || c || '()' as label, file as source_file, 'L' || l as source_location, 'absent_from_extraction' as supplement_reason from m where c % 2 = 1""")
def supplement_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes for methods that the graph lacks."""
    from .operators import supplement

    defs = _parsed(_sources(spark, sf_dir))
    return supplement.compute(_modelled(spark, defs), defs)[0].select("id", "label", "source_file", "source_location", "supplement_reason")


@query(f"""with {_DEFS_SQL} select file || '::' || cls as source, lower('nation_' || k || '_py_' || cls || '_customer_' || c) as target, 'method' as relation, 'EXTRACTED' as confidence from m where c % 2 = 1""")
def supplement_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner edges of the supplemented nodes; what they call is no callable of the graph, so no call edge is made."""
    from .operators import supplement

    defs = _parsed(_sources(spark, sf_dir))
    return supplement.compute(_modelled(spark, defs), defs)[1].select("source", "target", "relation", "confidence")


_PACK_SQL = """src as (select c_nationkey as k, c_custkey as c, (row_number() over (partition by c_nationkey order by c_custkey) * 2)::int as l,
    '    def customer_' || c_custkey || '(self):\n        ' || case when c_custkey % 3 = 0 then 'def inner_' || c_custkey || '(): return 1' else 'return supplier_' || (c_custkey % 7) || '()' end as t from customer where c_nationkey in (3, 5)),
  cls as (select k, 'class Nation' || k || ':\n' || string_agg(t, chr(10) order by c) as t from src group by k),
  found as (select 'nation_' || k || '.py::Nation' || k as query_id, 'nation_' || k || '.py::Nation' || k as id, 0 as other, k, 1 as l, t, 'class Nation' || k as sig from cls
    union all select 'nation_' || k || '.py::Nation' || k, 'nation_' || k || '.py::Nation' || k || '.customer_' || c, 1, k, l, t, 'def customer_' || c || '(self)' from src where c % 2 = 0),
  r as (select query_id, id, greatest(1, length('--- nation_' || k || '.py:L' || l || ' ---\n' || t || '\n') // 4)::bigint as cost, greatest(1, length('  nation_' || k || '.py:L' || l || '  ' || sig || '\n') // 4)::bigint as icost, row_number() over (partition by query_id order by other, id) as rank from found),
  f(query_id, rank, taken, used) as (select query_id, rank, true, cost from r where rank = 1 union all select r.query_id, r.rank, f.used + r.cost <= 800, f.used + case when f.used + r.cost <= 800 then r.cost else 0 end from f join r on r.query_id = f.query_id and r.rank = f.rank + 1),
  w as (select r.*, greatest(300, 800 - (select max(used) from f g where g.query_id = r.query_id)) as cap, row_number() over (partition by r.query_id order by r.rank) as k from r join f using (query_id, rank) where not taken),
  g(query_id, k, rank, listed, used) as (select query_id, k, rank, icost <= cap, case when icost <= cap then icost else 0 end from w where k = 1
    union all select w.query_id, w.k, w.rank, g.used + w.icost <= w.cap, g.used + case when g.used + w.icost <= w.cap then w.icost else 0 end from g join w on w.query_id = g.query_id and w.k = g.k + 1)"""


@query(f"""with recursive {_PACK_SQL} select query_id, id, 'body' as tier, null::varchar as reason, 0 as depth, rank::int as rank, cost from r join f using (query_id, rank) where taken
union all select query_id, id, case when listed then 'index' else 'omitted' end, case when listed then 'budget' else 'index_budget' end, 0, rank::int, cost from r join g using (query_id, rank)""")  # fmt: skip
def context_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of the packs around two classes, on the generated sources."""
    from .operators import pack

    files = _sources(spark, sf_dir)
    defs = _parsed(files)
    nodes = _modelled(spark, defs)
    owner = F.regexp_replace("id", "[.][^.]*$", "")
    methods = nodes.where("label like '.%'").select(owner.alias("source"), F.col("id").alias("target"), F.lit("method").alias("relation"))
    classes = nodes.where("label like 'Nation%'").select(F.regexp_replace("source_file", "[.]", "_").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("relation"))
    edges = methods.unionByName(classes).select("*", F.lit("EXTRACTED").alias("confidence"), F.concat_ws("|", "relation", "source", "target").alias("edge_pos"))
    seeds = _seeds(spark, "nation_3.py::Nation3", "nation_5.py::Nation5")
    return pack.context_pack(nodes, edges, seeds, files, defs, budget=800).rows.select("query_id", "id", "tier", F.when(F.col("tier") == "omitted", "index_budget").otherwise(F.col("reason")).alias("reason"), "depth", "rank", "cost")


@query(r"""with r as (select doc_id as source, unnest(regexp_extract_all(text, '([A-Z][A-Za-z_]{5,})', 1)) as w from documents), t as (select item_id as target, unnest(regexp_extract_all(text, '([a-z]{6,})', 1)) as w from benchmark)
select distinct source, target, lower(r.w) as "table" from r join (select distinct target, w from t) t on lower(r.w) = t.w""")  # fmt: skip
def table_reference_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References joined with the known tables they name, case ignored."""
    words = lambda name, i, out, p: table(spark, sf_dir, name).select(F.col(i).alias(out), F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(1))).alias("table")).distinct()
    return E.table_links(words("documents", "doc_id", "source", r"([A-Z][A-Za-z_]{5,})"), words("benchmark", "item_id", "target", r"([a-z]{6,})"))


# --- task corpus ---------------------------------------------------------------------------


@query("""with w as (select conv_id as task, turn, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*)', 1)) as token, generate_subscripts(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*(?:\\.[A-Za-z_][A-Za-z0-9_]*)*)', 1), 1) as pos from conversations where turn = 0),
base as (select * from w where length(token) >= 4), n as (select distinct task, case when pos % 3 = 0 then 'mod_' || (pos % 2) || '.' || token else token end as name from (select conv_id as task, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)', 1)) as token, generate_subscripts(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)', 1), 1) as pos from conversations where turn = 1)),
leaf as (select task, regexp_extract(name, '[^.]*$') as token, count(*) as c, min(name) as entry from n group by 1, 2),
hits as (select task, name as token, 'name' as outcome, name as entry from n union all select task, token, case when c = 1 then 'leaf' else 'ambiguous' end, case when c = 1 then entry end from leaf where not exists (select 1 from n where n.task = leaf.task and n.name = leaf.token))
select task, (arg_min({'e': entry, 'o': outcome}, pos)).e as entry, (arg_min({'e': entry, 'o': outcome}, pos)).o as outcome from base join hits using (task, token) group by task""")  # fmt: skip
def entry_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first word of a message that names one thing the answer names."""
    c = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "task")
    words = c.where("turn = 1").select("task", F.posexplode(F.regexp_extract_all("text", F.lit(f"({X.IDENTIFIER})"), F.lit(1))).alias("pos", "token"))
    at = F.col("pos") + 1
    names = words.select("task", F.when(at % 3 == 0, F.concat(F.lit("mod_"), (at % 2).cast("string"), F.lit("."), F.col("token"))).otherwise(F.col("token")).alias("name"))
    return corpus.pick_entry(c.where("turn = 0"), names)


@query(f"""with {_EXTENTS_SQL}, t as (select p.*, (query_id % 4)::int as repo, query_id % 3 <> 0 as touched, exists (select 1 from ext e where e.file = p.file and p.line between start_ and end_) as inside from pts p)
select repo, count_if(touched)::bigint as positives, count_if(touched and inside)::bigint as positive_hits, count_if(not touched)::bigint as negatives, count_if(not touched and not inside)::bigint as negative_misses from t group by rollup (repo)""")  # fmt: skip
def ground_truth_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive and negative controls for each repo and in all."""
    ext, pts = _extents(spark, sf_dir)
    return corpus.controls(pts.withColumn("repo", (F.col("query_id") % 4).cast("int")).withColumn("touched", F.col("query_id") % 3 != 0), ext)


@query("""with t as (select distinct l_orderkey as task, 'p' || l_partkey as name, case when l_partkey % 13 <> 0 then l_partkey end as id from lineitem),
d as (select t.*, id % 5 = 0 as p, id % 5 = 1 as o, id % 5 = 2 as u, case when id % 5 = 3 then 3 end as deep, case when id % 2 = 0 then 1 end as any_ from t)
select task, name, case when id is null then 'no_node' when p then 'included' when o then 'omitted_for_budget' when u then 'unresolved' when deep > 2 then 'reachable_deeper' when any_ is not null then 'unreachable' else 'unreachable_any' end as verdict from d""")  # fmt: skip
def diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each wanted symbol is or is not in a pack."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("task"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("name"), F.when(F.col("l_partkey") % 13 != 0, F.col("l_partkey")).alias("id")).distinct()
    known = li.where("id is not null").select("task", "id").distinct()
    some = lambda r: known.where(F.col("id") % 5 == r)
    return corpus.diagnosis(li, some(0), some(1), some(2), some(3).withColumn("depth", F.lit(3)), known.where("id % 2 = 0").withColumn("depth", F.lit(1)), 2)


@query(_reach_sql(("P:1",), 2, "up") + f""", t as (select source, target from edges where relation in {_in(TAINT_RELATIONS)}) select distinct id from reach where id in (select source from t union select target from t)""", graph=True, recursive=True)
def exposed_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of a radius that are ends of any taint."""
    n, e = _graph(spark, sf_dir, distinct=False)
    return corpus.exposed_in(traverse.radius(n, e, _seeds(spark, "P:1"), 2, "up", members=False), e.where(F.col("relation").isin(*TAINT_RELATIONS)))[0]


@query("""with f as (select page_id, case page_id % 4 when 0 then 'src/a' || page_id || '.py' when 1 then 'src/tests/a.py' when 2 then 'lib/test_x.go' else 'src/readme.md' end as path from pages) select page_id, page_id % 4 = 0 or page_id % 4 = 2 as kept from f""")
def package_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files of packages: known language, no test directory; a test-like file name alone does not matter."""
    k = F.col("page_id") % 4
    path = F.when(k == 0, F.concat(F.lit("src/a"), F.col("page_id").cast("string"), F.lit(".py"))).when(k == 1, "src/tests/a.py").when(k == 2, "lib/test_x.go").otherwise("src/readme.md")
    return table(spark, sf_dir, "pages").select("page_id", corpus.package_source(path).alias("kept"))


# --- operators that need sources, points or histories of their own ---------------------------


@query("""with e as (select l_orderkey as flow, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as pos, 'nation_' || (l_suppkey % 25) as file, (l_partkey % 300)::int as line from lineitem),
n as (select *, lead(file) over w as nfile, lead(line) over w as nline, count(*) over (partition by flow) as c, first_value(file) over w as ffile, first_value(line) over w as fline, row_number() over (partition by flow order by pos desc) as back from e window w as (partition by flow order by pos))
select flow * 100000 + pos as pos, 'taints' as relation, file as source_file, line as source_line, nfile as target_file, nline as target_line, true as skip_self from n where nfile is not null
union all select flow * 100000 - 1, unnest(['taints', 'reaches_sink']), ffile, fline, file, line, false from n where c >= 2 and back = 1""")  # fmt: skip
def flow_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows as neutral findings: end to end, and each step."""
    from .sources import scanners

    li = table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    rows = li.select(F.col("l_orderkey").alias("flow"), "pos", F.lit(None).cast("string").alias("rule"), F.concat(F.lit("nation_"), (F.col("l_suppkey") % 25).cast("string")).alias("file"), (F.col("l_partkey") % 300).cast("int").alias("line"))
    out = scanners.flow_findings(rows)
    return out.select("pos", "relation", F.col("source_ref.file").alias("source_file"), F.col("source_ref.line").alias("source_line"), F.col("target_ref.file").alias("target_file"), F.col("target_ref.line").alias("target_line"), "skip_self")


@query("""with h as (select c_nationkey as diff_id, 'src/nation_' || c_nationkey || '.py' as file, (c_custkey * 10)::int as old, (c_custkey % 4)::int as n from customer)
select diff_id, file, old as line, 'inserted' as kind from h where n = 0 union all select diff_id, file, unnest(generate_series(old, old + n - 1))::int, 'modified' from h where n > 0""")  # fmt: skip
def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old lines and insertion anchors of a unified diff for each nation, a hunk for each customer."""
    from .sources import files

    c = table(spark, sf_dir, "customer")
    n, at, k = F.col("c_custkey") % 4, (F.col("c_custkey") * 10).cast("string"), F.col("c_nationkey").cast("string")
    hunk = F.concat(F.lit("@@ -"), at, F.when(n == 1, "").otherwise(F.concat(F.lit(","), n.cast("string"))), F.lit(" +1,2 @@ def x():\n+ new"))
    body = c.groupBy("c_nationkey").agg(F.array_join(F.sort_array(F.collect_list(hunk)), "\n").alias("hunks"))
    head = F.concat(F.lit("diff --git x y\n--- a/src/nation_"), k, F.lit(".py\n+++ b/src/nation_"), k, F.lit(".py\n"))
    return files.changed_old_lines(body.select(F.col("c_nationkey").alias("diff_id"), F.concat(head, "hunks").alias("text")))


@query("select distinct 'w' || (c_custkey % 7) as query_id, 'nation_' || c_nationkey || '.py' as file, 'Nation' || c_nationkey || '.customer_' || c_custkey as name from customer where c_custkey % 3 <> 0")
def grep_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions whose text names a word, found line by line."""
    from .sources import files

    words = spark.createDataFrame([(f"w{k}", f"supplier_{k}") for k in range(7)], "query_id string, word string")
    src = _sources(spark, sf_dir)
    return files.grep_symbols(src, words, _parsed(src))


@query(f"with {_DEFS_SQL}, ms as (select file, cls as class, cls || '.customer_' || c as member, row_number() over (partition by file order by l) as n from m) select file, class, member from ms where n <= 40")
def class_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members one level below a class and inside its extent, at most 40 a class."""
    from .operators import symbols

    return symbols.class_members(symbols.definitions(_sources(spark, sf_dir))).select("file", "class", "member")


@query(f"""with {_DEFS_SQL}, asked as (select c, k, file, l + (c % 7 = 0)::int as l, case when c % 5 = 0 then 'other' else 'customer_' || c end as leaf from m)
select c as query_id, case when leaf <> 'other' and c % 7 <> 0 then 'Nation' || k || '.' || leaf end as name, case when c % 7 = 0 and c % 3 <> 0 then 'no_definition_at_line' when c % 7 = 0 or leaf = 'other' then 'definition_mismatch' end as unresolved from asked""")  # fmt: skip
def definition_at_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definition of a line and a name, or why there is none."""
    from .operators import symbols

    src = _sources(spark, sf_dir)
    c = table(spark, sf_dir, "customer").withColumn("l", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) * 2)
    k = F.col("c_custkey")
    leaf = F.when(k % 5 == 0, "other").otherwise(F.concat(F.lit("customer_"), k.cast("string")))
    asked = c.select(k.alias("query_id"), F.format_string("nation_%d.py", F.col("c_nationkey")).alias("file"), (F.col("l") + (k % 7 == 0).cast("int")).alias("def_line"), leaf.alias("leaf"))
    return symbols.at_line(asked, _parsed(src)).select("query_id", F.col("symbol.name").alias("name"), "unresolved")


@query("""select distinct 'nation_' || c_nationkey || '.py' as file, 'hash_differs' as reason from customer where c_nationkey % 6 = 0
union all select distinct 'nation_' || c_nationkey || '.py', 'orphan_callable' from customer where c_nationkey in (4, 12) and c_nationkey % 6 <> 0 and c_custkey % 2 = 0""")  # fmt: skip
def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files the graph no longer matches: another hash, or a callable where no definition begins."""
    from .operators import supplement

    src = _sources(spark, sf_dir).withColumn("md5", F.md5("text"))
    defs = _parsed(src)
    k = F.regexp_extract("file", "nation_([0-9]+)", 1).cast("int")
    moved = F.regexp_extract("source_file", "nation_([0-9]+)", 1).isin("4", "12")
    nodes = _modelled(spark, defs).withColumn("source_location", F.when(moved, "L99999").otherwise(F.col("source_location")))
    manifest = src.select(F.col("file").alias("path"), F.when(k % 6 == 0, "before").otherwise(F.col("md5")).alias("md5"))
    return supplement.stale_files(nodes, defs, manifest, src.select("file", "md5"))


@query("""with f as (select page_id, 'p' || page_id as path, page_id % 5 as k from pages where page_id % 3 = 0)
select path, case when k = 0 then 'not_in_manifest' when k = 1 then 'unreadable' else 'edited' end as reason from f where k < 3""")  # fmt: skip
def stale_shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a pack that the manifest does not vouch for."""
    from .operators import state

    p = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("path"), (F.col("page_id") % 5).alias("k"), (F.col("page_id") % 3 == 0).alias("shown"), F.md5("html").alias("md5"))
    return state.stale_shown(p.where("shown"), p.where("k <> 0").select("path", "md5"), p.where("k <> 1").select("path", F.when(F.col("k") == 2, "now").otherwise(F.col("md5")).alias("md5")))


@query("""with recursive c as (select conv_id as query_id, turn as rank, greatest(1, length(text) // 4)::bigint as cost, turn % 7 + 5 as icost from conversations qualify row_number() over (partition by conv_id, turn order by text) = 1),
w as (select query_id, rank, icost, greatest(20, 600 - coalesce((select cost from c s where s.query_id = c.query_id and s.rank = 0), 0)) as cap, row_number() over (partition by query_id order by rank) as k from c where rank > 0),
g(query_id, k, rank, listed, used) as (select query_id, k, rank, icost <= cap, case when icost <= cap then icost else 0 end from w where k = 1
  union all select w.query_id, w.k, w.rank, g.used + w.icost <= w.cap, g.used + case when g.used + w.icost <= w.cap then w.icost else 0 end from g join w on w.query_id = g.query_id and w.k = g.k + 1)
select query_id, rank::bigint as rank, 'body' as tier, null::varchar as reason from c where rank = 0 union all select query_id, rank::bigint, case when listed then 'index' else 'omitted' end, case when listed then 'depth' else 'index_budget' end from g""")  # fmt: skip
def tiers_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What lies deeper than bodies go competes for the index alone; the seed is always a body."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    rows = c.select(F.col("conv_id").alias("query_id"), F.col("turn").cast("int").alias("rank"), F.lit("0").alias("seed"), F.col("turn").cast("string").alias("id"), F.col("turn").cast("int").alias("depth"), F.greatest(F.lit(1), F.floor(F.length("text") / 4)).alias("cost"), (F.col("turn") % 7 + 5).alias("index_cost"))
    return rank.two_tier_fill(rows, 600, 20, body_depth=0).select("query_id", F.col("rank").cast("long").alias("rank"), "tier", "reason")


@query("""select doc_id as query_id, doc_id % 2 = 0 and regexp_extract(text, '[A-Za-z_][A-Za-z0-9_]*') <> '' as mentioned from documents""")
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a label's bare name stands in the seed's own source."""
    d = table(spark, sf_dir, "documents")
    first = F.regexp_extract("text", f"({X.IDENTIFIER})", 1)
    label = F.when((F.col("doc_id") % 2 == 0) & (first != ""), F.concat(F.lit("."), first, F.lit("()"))).otherwise("no such name()")
    return rank.mentioned(d.select(F.col("doc_id").alias("query_id"), label.alias("label")), d.select(F.col("doc_id").alias("query_id"), "text")).select("query_id", "mentioned")


@query("""with n as (select id, case when id like 'S:%' then regexp_replace(label, '\\(\\)$', '') else label end as label, source_file as file, (line - line % 10)::int as line, id like 'C:%' as calls from nodes where line is not null)
select p.page_id as task, (select id from n where n.file = 'nation_' || (p.page_id % 25) and n.line = (p.page_id % 40) * 10 order by calls desc, length(label), id limit 1) as id from pages p
where exists (select 1 from n where n.file = 'nation_' || (p.page_id % 25) and n.line = (p.page_id % 40) * 10)""", graph=True)  # fmt: skip
def entry_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the nodes on a line, a callable first, then the shortest label, then the id."""
    n = projection.nodes(spark, sf_dir).where("source_location is not null")
    line = F.regexp_extract("source_location", "([0-9]+)", 1).cast("int")
    n = n.withColumn("source_location", F.concat(F.lit("L"), (line - line % 10).cast("string"))).withColumn("label", F.when(F.col("id").startswith("S:"), X.bare(F.col("label"))).otherwise(F.col("label")))
    k = F.col("page_id")
    points = table(spark, sf_dir, "pages").select(k.alias("task"), F.concat(F.lit("nation_"), (k % 25).cast("string")).alias("file"), (k % 40 * 10).cast("int").alias("def_line"))
    return corpus.entry_nodes(points, n)


@query("select distinct source, target from edges where relation = 'taints' and source in (select 'C:' || c_custkey from customer where c_nationkey = 3)", graph=True)
def in_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Taints of the customers of one nation."""
    wanted = table(spark, sf_dir, "customer").where("c_nationkey = 3").select(F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("id"))
    return corpus.lookup(projection.edges(spark, sf_dir).where("relation = 'taints'"), "source", wanted).select("source", "target")


@query(f"""with {_EXTENTS_SQL}, t as (select pos % 40 as task, (pos % 40) * 250 as at, file, start_, end_ from ext where pos % 3 = 0), ch as (select query_id // 4 as commit, query_id as pos, file, line from pts)
select distinct task, commit from ch join t on ch.file = t.file and line between start_ and end_ and ch.pos > t.at""")  # fmt: skip
def follow_ups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later commits that touch the ground truth of a task."""
    ext, pts = _extents(spark, sf_dir)
    task = F.col("pos") % 40
    truth = ext.where("pos % 3 = 0").select(task.alias("task"), (task * 250).alias("pos"), "file", "name", "start", "end")
    return corpus.follow_ups(pts.select(F.floor(F.col("query_id") / 4).alias("commit"), F.col("query_id").alias("pos"), "file", "line"), truth)


@query(f"with {_PR_SQL} select s_nationkey as repo, count(*)::bigint as tasks, sum(n_wanted - hits)::bigint as missed, sum(n_returned - hits)::bigint as surplus from scored join supplier on s_suppkey = task group by 1")
def disclosure_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each nation's runs left out or brought beyond what was wanted, summed."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("task"), F.col("s_nationkey").alias("repo"))
    rows = _scores(spark, sf_dir).join(s, "task").withColumn("missed", F.col("n_wanted") - F.col("hits")).withColumn("surplus", F.col("n_returned") - F.col("hits"))
    return evaluate.sums(rows, ["repo"], ["missed", "surplus"])


@query("select l_suppkey as task, count(distinct l_partkey)::bigint as files, sum(q)::bigint as tokens, round(avg(q), 4) as mean_tokens, max(q) as most_tokens from (select *, l_quantity::bigint as q from lineitem) group by 1")
def reading_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct files to open and the tokens they cost, for each task."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("task"), F.col("l_partkey").alias("file"), F.col("l_quantity").cast("long").alias("tokens"))
    return evaluate.reading_cost(li, ["task"]).withColumn("mean_tokens", F.round("mean_tokens", 4))


@query("""with r as (select o_orderstatus as arm, (o_orderkey % 2)::int as rep, o_totalprice > 200000 as ok, o_totalprice as cost, o_custkey % 30 as turns, o_custkey % 9 = 0 as idle from orders)
select arm, rep, count(*)::bigint as runs, count_if(ok)::bigint as resolved, round(avg(ok::int), 6) as rate, round(avg(turns), 4) as mean_turns, round(avg(cost), 2) as mean_cost, round(sum(cost), 2) as total_cost, count_if(idle)::bigint as no_edit from r group by grouping sets ((arm), (arm, rep))""")  # fmt: skip
def resolve_rate_by_rep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolve rates of each arm and of each of its repetitions (rep null: all)."""
    k, price = F.col("o_custkey"), F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("arm"), (F.col("o_orderkey") % 2).cast("int").alias("rep"), (price > 200000).alias("resolved"), price.alias("cost"), (k % 30).alias("turns"), F.when(k % 9 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("f"))).alias("edited"))
    out = evaluate.resolve_rates(rows)
    for c, n in (("rate", 6), ("mean_turns", 4), ("mean_cost", 2), ("total_cost", 2)):
        out = out.withColumn(c, F.round(c, n))
    return out


@query("""with o as (select *, row_number() over (order by o_orderkey) as r, case when o_orderstatus = 'P' then 'revert' when o_totalprice < 30000 then 'no_ground_truth' else 'kept' end as reason from orders),
b as (select o_orderkey from o where reason = 'kept' order by o_orderkey limit 500) select reason, count(*)::bigint as n from o where o_orderkey <= (select max(o_orderkey) from b) or (select count(*) from b) < 500 group by reason""")  # fmt: skip
def selection_funnel_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The funnel stops once 500 candidates are kept: later ones are not counted."""
    return evaluate.funnel(table(spark, sf_dir, "orders"), [("revert", F.col("o_orderstatus") == "P"), ("no_ground_truth", F.col("o_totalprice") < 30000)], limit=500, order="o_orderkey")


@query("""select id, coalesce(string_agg(f, '|' order by f), '') as edges from (select distinct n.id, '{"confidence":"' || confidence || '","relation":"' || relation || '","source":"' || source || '","target":"' || target || '"}' as f
from (values ('O:7'), ('N:3'), ('P:3')) n(id) join edges on source = n.id or target = n.id) group by id""", graph=True)  # fmt: skip
def edge_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of a node as sorted canonical JSON, which a snapshot keeps."""
    prints = diff.fingerprints(projection.edges(spark, sf_dir), _seeds(spark, "O:7", "N:3", "P:3").select("id"), ("source", "target", "relation", "confidence"))
    return prints.select("id", F.array_join("edges", "|").alias("edges"))


@query("""select doc_id, case when k = 0 then 'file' when k = 1 then 'function' when k = 2 then 'file' end as kind from (select doc_id, doc_id % 4 as k from documents)""")
def label_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as functions, files or neither."""
    k, t = F.col("doc_id") % 4, F.col("doc_id").cast("string")
    label = F.when(k == 0, F.concat(F.lit("src/m"), t, F.lit(".py"))).when(k == 1, F.concat(F.lit("f"), t, F.lit("()"))).when(k == 2, "Makefile.mk").otherwise(F.concat(F.lit("Class"), t))
    return table(spark, sf_dir, "documents").select("doc_id", X.label_kind(label).alias("kind"))


@query("""with e as (select l_orderkey as flow, l_linenumber as pos, 'm' || (l_partkey % 50) as method from lineitem) select distinct flow from e where flow not in (select flow from e where method in ('m1', 'm2', 'm3'))""")
def unsanitized_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows that pass through no sanitizer."""
    from .sources import scanners

    e = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("flow"), F.col("l_linenumber").alias("pos"), F.concat(F.lit("m"), (F.col("l_partkey") % 50).cast("string")).alias("method"))
    return scanners.without_sanitizer(e, ("m1", "m2", "m3")).select("flow").distinct()


@query("""with a as (select 'C:' || o_custkey as source, 'O:' || o_orderkey as target, o_orderstatus as s from orders), v as (select 'nation_' || c_nationkey as slot, count(*) as n, c_nationkey % 4 as k from customer group by 1, c_nationkey)
select slot, case when k = 0 or k = 1 or k = 2 then 'full' else 'incremental' end as decision from v""")  # fmt: skip
def swap_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a switch to each slot has to do: detached, not cached and not trusted ones are built in full."""
    from .operators import state

    k = F.col("c_nationkey") % 4
    slots = table(spark, sf_dir, "customer").select(F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("slot"), k.alias("k")).distinct()
    trusted = state.trustworthy(F.when(F.col("k") == 2, state.VERSION - 1).otherwise(state.VERSION), F.lit(True))
    return slots.select("slot", state.decision(F.col("k") == 0, F.col("k") != 1, trusted).alias("decision"))


@query(f"with {_DEFS_SQL} select file, cls || '.customer_' || c as name, 'supplier_' || (c % 7) as callee, l + 1 as line from m where c % 3 <> 0")
def call_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call in the generated sources, with its line and the definition around it."""
    from .operators import symbols

    return symbols.call_lines(_sources(spark, sf_dir))


@query(f"""with {_DEFS_SQL}, f as (select c, 'customer_' || c as source_function, 'supplier_' || (c % 7) as source_call, 'customer_' || (c + 1) as sink_function, 'supplier_' || ((c + 1) % 7) as sink_call from m),
calls as (select 'customer_' || c as fn, 'supplier_' || (c % 7) as call, file, l + 1 as line from m where c % 3 <> 0)
select f.c as flow, a.file as source_file, a.line as source_line, b.file as sink_file, b.line as sink_line from f left join calls a on a.fn = source_function and a.call = source_call left join calls b on b.fn = sink_function and b.call = sink_call""")  # fmt: skip
def flow_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the calls that a ground truth names stand."""
    from .operators import symbols

    k = F.col("c_custkey")
    name = lambda pre, x: F.concat(F.lit(pre), x.cast("string"))
    flows = table(spark, sf_dir, "customer").select(k.alias("flow"), name("customer_", k).alias("source_function"), name("supplier_", k % 7).alias("source_call"), name("customer_", k + 1).alias("sink_function"), name("supplier_", (k + 1) % 7).alias("sink_call"))
    return corpus.flow_locations(flows, symbols.call_lines(_sources(spark, sf_dir)))


from . import queries_io  # noqa: E402, F401
