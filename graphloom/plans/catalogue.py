"""Queries over the star-schema tables and the SQL each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, trees
from ..operators import rows
from ..sources.tables import symbols, table
from . import fixpoint

ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount"
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def relational(name: str, tables: str, sql: str, oracle: str | None = None) -> None:
    """A query whose plan is declared in SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in tables.split()})

    text = oracle or sql
    for t in tables.split():
        text = text.replace("{" + t + "}", t)
    QUERIES[name], ORACLE[name] = run, text


# Alias chains: a part's target is its key divided by two; key 0 and parts of size 45 and more are roots.
CHAIN = """with recursive n as (select p_partkey k, p_size, p_name, case when p_partkey = 0 or p_size >= 45 then null else p_partkey // 2 end nxt from part),
r as (select k, k root, nxt, 0 hops from n union all select r.k, n.k, n.nxt, hops + 1 from r join n on r.nxt = n.k) """


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), "p_size")
    root = (F.col("k") == 0) | (F.col("p_size") >= 45)
    return fixpoint.resolve(part.select("k", F.when(root, None).otherwise(F.floor(F.col("k") / 2)).cast("long").alias("nxt")))


def rooted(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("root"), "p_size", "p_name")
    return chain(spark, sf_dir).join(part, "root")


@query(CHAIN + "select k, root, cast(hops as bigint) hops from r where nxt is null")
def alias_resolve(spark, sf_dir):
    return chain(spark, sf_dir).select("k", "root", "hops")


@query(CHAIN + "select r.k, p_size >= 45 is_primitive from r join part on p_partkey = root where nxt is null")
def alias_is_primitive(spark, sf_dir):
    return rooted(spark, sf_dir).select("k", (F.col("p_size") >= 45).alias("is_primitive"))


@query(CHAIN + "select r.root, string_agg(p_name, ',' order by p_name) as names from r join part on p_partkey = r.k where nxt is null and hops > 0 group by r.root")
def typedef_names_on_target(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"), "p_name")
    return chain(spark, sf_dir).where("hops > 0").join(part, "k").groupBy("root").agg(F.array_join(F.array_sort(F.collect_list("p_name")), ",").alias("names"))


@query(CHAIN + "select r.k, cast(p_size as bigint) size from r join part on p_partkey = root where nxt is null")
def size_resolve(spark, sf_dir):
    return rooted(spark, sf_dir).select("k", F.col("p_size").cast("long").alias("size"))


@query(CHAIN + "select r.k, cast(hops as bigint) depth, p_name || repeat('*', hops) spelling from r join part on p_partkey = root where nxt is null")
def tree_flatten_depth(spark, sf_dir):
    node = lambda op, s: F.struct(F.lit(op).alias("op"), F.lit(None).cast("bigint").alias("g"), F.lit(None).cast("int").alias("n"), s.alias("s"))
    tree = F.concat(F.array(node("BASE", F.col("p_name"))), F.array_repeat(node("PTR", F.lit(None).cast("string")), F.col("hops").cast("int")))
    return rooted(spark, sf_dir).select("k", F.col("hops").alias("depth"), trees.display(tree).alias("spelling"))


REFS = "select 'o' || o_orderkey src, 'c' || o_custkey dst from orders union all select 'c' || c_custkey, 'n' || c_nationkey from customer union all select 'n' || n_nationkey, 'r' || n_regionkey from nation"


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for t, a, x, b, y in (("orders", "o", "o_orderkey", "c", "o_custkey"), ("customer", "c", "c_custkey", "n", "c_nationkey"), ("nation", "n", "n_nationkey", "r", "n_regionkey")):
        e = table(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(x)).alias("src"), F.concat(F.lit(b), F.col(y)).alias("dst"))
        out = e if out is None else out.union(e)
    return out


@query(REFS)
def refs_view(spark, sf_dir):
    return refs(spark, sf_dir)


@query(f"with recursive e as ({REFS}), r as (select 'o' || o_orderkey k from orders where o_orderstatus = 'F' union select dst from r join e on src = k) select k from r")
def mark_sweep(spark, sf_dir):
    roots = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("o"), "o_orderkey").alias("k"))
    e = refs(spark, sf_dir)
    return fixpoint.sweep(e.select(F.col("src").alias("k")).union(e.select("dst")), e, roots)


@query("select 's' || s_suppkey k from supplier where s_suppkey % 2 = 0 union select 'n' || s_nationkey from supplier where s_suppkey % 2 = 0 union select 'r' || n_regionkey from supplier join nation on s_nationkey = n_nationkey where s_suppkey % 2 = 0")
def forward_prune(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("src"), F.concat(F.lit("n"), "s_nationkey").alias("dst"), "s_suppkey")
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    return fixpoint.reach(s.select("src", "dst").union(n), s.where("s_suppkey % 2 = 0").select(F.col("src").alias("k")))


LINKED = "with recursive e as (select distinct 2 * l_suppkey a, 2 * l_partkey + 1 b from lineitem), u as (select a, b from e union select b, a from e), r as (select a k, a c from u union select u.b, r.c from r join u on r.k = u.a) "


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select((2 * F.col("l_suppkey")).cast("long").alias("src"), (2 * F.col("l_partkey") + 1).cast("long").alias("dst"))
    return fixpoint.components(e)


@query(LINKED + "select cast(k as bigint) k, cast(min(c) as bigint) component from r group by k")
def components(spark, sf_dir):
    return linked(spark, sf_dir)


@query(LINKED + ", m as (select k, min(c) component from r group by k) select cast(component as bigint) bucket, cast(coalesce(min(k) filter (where k <= 20), min(k)) as bigint) as primary_goff, bool_or(k <= 20) as prim from m group by component")
def bucket_primary(spark, sf_dir):
    k = F.col("k")
    return linked(spark, sf_dir).groupBy(F.col("component").alias("bucket")).agg(F.coalesce(F.min(F.when(k <= 20, k)), F.min(k)).alias("primary_goff"), F.max(k <= 20).alias("prim"))


@query("with recursive e as (select p_partkey a, p_partkey // 2 b from part union select p_partkey, p_partkey // 3 from part), r as (select a k, b dep from e union select r.k, e.b from r join e on r.dep = e.a) select cast(k as bigint) k, cast(dep as bigint) dep from r")
def dep_closure(spark, sf_dir):
    return closure(table(spark, sf_dir, "part"))


def closure(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey").cast("long")
    e = part.select(k.alias("src"), F.explode(F.array(F.floor(k / 2), F.floor(k / 3))).alias("dst"))
    return rows.closure(e)[0].select(F.col("src").alias("k"), F.col("dst").alias("dep"))


LIST = "select l_orderkey, string_agg(l_returnflag || l_linestatus, ',' order by " + ORDER + ") as shape from lineitem group by l_orderkey"


def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.struct(*ORDER.split(", "), F.concat("l_returnflag", "l_linestatus").alias("m"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda x: x["m"]), ",").alias("shape"))


@query(f"with s as ({LIST}) select l_orderkey, shape, cast(8 * (length(shape) - length(replace(shape, ',', '')) + 1) as bigint) as size from s")
def struct_layouts(spark, sf_dir):
    return shapes(spark, sf_dir).withColumn("size", (8 * F.size(F.split("shape", ","))).cast("long"))


@query(f"with s as ({LIST}) select shape, min(l_orderkey) as primary_goff, count(*) as n from s group by shape")
def dedupe_layouts(spark, sf_dir):
    return shapes(spark, sf_dir).groupBy("shape").agg(F.min("l_orderkey").alias("primary_goff"), F.count("*").alias("n"))


@query("with n as (select unnest(['char','u8','Pair']) as base, generate_series as i from generate_series(1, 5)) select base || repeat('*', i) || '[' || i || ']' as display, base = 'Pair' as has from n")
def tree_display(spark, sf_dir):
    rows = [([("BASE", g, None, b)] + [("PTR", None, None, None)] * i + [("ARRAY", None, i, None)],) for g, b in enumerate(("char", "u8", "Pair")) for i in range(1, 6)]
    df = spark.createDataFrame(rows, f"tree {trees.TYPE}")
    return df.select(trees.display(F.col("tree")).alias("display"), trees.contains(F.col("tree"), F.lit(2)).alias("has"))


PREFER, DISLIKE = ["^PROMO", "^ECONOMY", "BRUSHED"], ["STEEL$", "PLATED"]


@query("""with k as (select distinct p_brand, p_type, (case when regexp_matches(p_type, '^PROMO') then 0 when regexp_matches(p_type, '^ECONOMY') then 1 when regexp_matches(p_type, 'BRUSHED') then 2 else 3 end) * 65536
+ (case when regexp_matches(p_type, 'STEEL$') then 1 when regexp_matches(p_type, 'PLATED') then 2 else 0 end) as sort_key from part) select p_brand, p_type as name, cast(sort_key as bigint) as sort_key from k qualify row_number() over (partition by p_brand order by sort_key, p_type) = 1""")
def preferred_name(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumn("k", names.sort_key(F.col("p_type"), PREFER, DISLIKE))
    return part.groupBy("p_brand").agg(F.min(F.struct("k", "p_type")).alias("m")).select("p_brand", F.col("m.p_type").alias("name"), F.col("m.k").cast("long").alias("sort_key"))


@query("select s_name as symbol, cast(s_suppkey * 16 as bigint) as addr from supplier")
def csv_symbols(spark, sf_dir):
    lines = table(spark, sf_dir, "supplier").select(F.concat(F.lit("x,0x"), F.hex((F.col("s_suppkey") * 16 + 4096).cast("long")), F.lit(", "), "s_name").alias("value"))
    return symbols(lines, 1, 2, 4096)


relational("single_member", "lineitem", "select l_orderkey, min(l_partkey) as part from {lineitem} group by l_orderkey having count(*) = 1")
relational("same_type_members", "lineitem", "select l_orderkey, min(l_returnflag) as ty, count(*) as n from {lineitem} group by l_orderkey having count(*) > 1 and min(l_returnflag) = max(l_returnflag)")
relational("number_of_members", "orders lineitem", "select o_orderkey, case count(l_orderkey) when 0 then '0' when 1 then '1' when 2 then '2' else 'n' end as class from {orders} left join {lineitem} on o_orderkey = l_orderkey group by o_orderkey")
relational("union_member_dedupe", "lineitem", f"select l_orderkey, l_returnflag, l_linenumber, l_partkey from (select *, row_number() over (partition by l_orderkey, l_returnflag order by {ORDER}) as rn from {{lineitem}}) t where rn = 1")
relational("bitfield_collapse", "lineitem", f"select l_orderkey, l_linestatus, l_partkey, rn as slot from (select *, row_number() over (partition by l_orderkey order by {ORDER}) as rn, lead(l_linestatus) over (partition by l_orderkey order by {ORDER}) as nx from {{lineitem}}) t where nx is null or nx <> l_linestatus", f"select l_orderkey, l_linestatus, l_partkey, cast(rn as integer) as slot from (select *, row_number() over (partition by l_orderkey order by {ORDER}) as rn, lead(l_linestatus) over (partition by l_orderkey order by {ORDER}) as nx from lineitem) t where nx is null or nx <> l_linestatus")
relational("empty_base_elim", "lineitem", f"select l_orderkey, l_partkey, l_linenumber from (select *, lag(l_linenumber) over (partition by l_orderkey order by {ORDER}) as pv from {{lineitem}}) t where pv is null or pv <> l_linenumber")
relational("enum_catalog", "orders lineitem events", "select kind, name, cast(dense_rank() over (partition by kind order by name) - 1 as bigint) as ordinal from (select 'status' as kind, o_orderstatus as name from {orders} union select 'flag', l_returnflag from {lineitem} union select 'event', event_type from {events}) t")
relational("enumeratorize", "part", "select p_partkey, case when p_type like '%STEEL' then p_brand else p_type end as ty from {part}")
relational("symbol_join", "customer nation supplier", "select c_custkey, c_name, n_name from {customer} join {nation} on c_nationkey = n_nationkey where exists (select 1 from {supplier} where s_nationkey = n_nationkey)")
relational("symbol_merge_consistency", "part", "select p_brand, count(distinct p_size) as sizes, min(p_type) as ty, count(distinct p_type) > 1 as conflict from {part} group by p_brand")
relational("merge_deps_orphans", "part supplier", "select p_partkey from {part} where not exists (select 1 from {supplier} where s_suppkey = p_partkey)")
relational("vtable_merge", "lineitem", "select coalesce(a.o, b.o) as o, coalesce(a.s, b.s) as s, coalesce(a.m, b.m) as m, a.m is not null and b.m is not null and a.m <> b.m as conflict from (select l_orderkey as o, l_linenumber as s, min(l_partkey) as m from {lineitem} where l_returnflag = 'A' group by l_orderkey, l_linenumber) a full join (select l_orderkey as o, l_linenumber as s, min(l_partkey) as m from {lineitem} where l_returnflag = 'R' group by l_orderkey, l_linenumber) b on a.o = b.o and a.s = b.s")
relational("decl_name_union", "part", "select p_brand, array_join(array_sort(collect_set(p_type)), ',') as names from {part} group by p_brand", "select p_brand, string_agg(distinct p_type, ',' order by p_type) as names from part group by p_brand")
relational("name_permute", "nation region", "select n_nationkey, concat(r_name, '::', n_name, '<', r_name, '>') as name from {nation} join {region} on n_regionkey = r_regionkey")
relational("namespace_path", "region nation customer", "select c_custkey, concat(r_name, '::', n_name, '::', c_name) as path from {customer} join {nation} on c_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey")
relational("untemplated_name", "part", "select p_partkey, substring_index(concat(p_name, '<', p_type, '>'), '<', 1) as name from {part}", "select p_partkey, split_part(p_name || '<' || p_type || '>', '<', 1) as name from part")
relational("split_namespace", "part", "select p_partkey, regexp_replace(concat(p_brand, '::', p_type, '::', p_name), '::[^:]*$', '') as ns, substring_index(concat(p_brand, '::', p_type, '::', p_name), '::', -1) as base from {part}", "select p_partkey, p_brand || '::' || p_type as ns, p_name as base from part")
relational("regex_unique_match", "part", "select p_brand, count(case when p_type like 'PROMO%' then 1 end) as n, min(case when p_type like 'PROMO%' then p_partkey end) as first_match from {part} group by p_brand")
relational("name_graph_asymmetry", "lineitem", "with e as (select distinct l_partkey as p, l_suppkey as s from {lineitem}) select x.p as a, x.s as b from e x join e y on x.p = y.s and x.s = y.p where x.p < x.s")
relational("goff_normalise", "orders", "select o_custkey, o_orderkey, cast(dense_rank() over (partition by o_custkey order by o_orderkey) - 1 as bigint) as idx from {orders}")
relational("cache_hits", "orders", "select a.s, case when b.s is null then 'new' when a.h = b.h then 'hit' else 'miss' end as state from (select o_orderkey as s, o_orderstatus as h from {orders}) a left join (select o_orderkey as s, case when o_orderkey % 7 = 0 then 'x' else o_orderstatus end as h from {orders} where o_orderkey % 5 <> 0) b on a.s = b.s")
relational("stage_counts", "part supplier orders lineitem", "select 'part' as kind, count(*) as n from {part} union all select 'supplier', count(*) from {supplier} union all select 'orders', count(*) from {orders} union all select 'lineitem', count(*) from {lineitem}")
relational("addr_rel", "orders", "select o_orderkey, lower(hex(o_orderkey + 4096)) as addr, cast(conv(hex(o_orderkey + 4096), 16, 10) as bigint) - 4096 as rel from {orders}", "select o_orderkey, lower(printf('%X', o_orderkey + 4096)) as addr, cast(o_orderkey as bigint) as rel from orders")


@query("select a, doc_id as b from (select doc_id, min(doc_id) over (partition by lower(trim(text))) as a from documents where text is not null) t where a < doc_id")
def merge_candidates(spark, sf_dir):
    """Each document of a text, with the text's first: a frequent text costs a row a document, and only a hash is shuffled."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2(F.lower(F.trim("text")), 256).alias("h"))
    low = docs.groupBy("h").agg(F.min("doc_id").alias("a"))
    return docs.join(low, "h").where("a < doc_id").select("a", F.col("doc_id").alias("b"))


from . import typed  # noqa: E402, F401  adds its queries
