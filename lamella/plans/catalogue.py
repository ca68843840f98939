"""The engine's queries over the driver's tables, each with the SQL that another engine runs for comparison."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamella.functions.aggregates import Aggregate, max_of
from lamella.operators import relational as R
from lamella.sources.engine import Engine

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def engine(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = TABLES, path: str | None = None) -> Engine:
    e = Engine(spark, path)
    for n in names:
        e.catalog.attach(n, lambda n=n: table(spark, sf_dir, n))
    return e


def dialect(name: str, sql: str, oracle: str | None = None, views: tuple[str, ...] = (), tables: tuple[str, ...] = TABLES[:8]) -> None:
    """A query of the dialect. Where the oracle's SQL is not given it is the same text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = engine(spark, sf_dir, tables)
        for v in views:
            e.execute(v)
        return e.query(sql)

    QUERIES[name], ORACLE[name] = run, oracle or sql


def operator(name: str, oracle: str | None, *names: str):
    """An operator query: a function of the named tables."""

    def add(f):
        QUERIES[name] = lambda spark, sf_dir: f(*(table(spark, sf_dir, n) for n in names))
        if oracle:
            ORACLE[name] = oracle
        return f

    return add


# select, project, predicates
dialect("scan_project", "select n_nationkey, n_name from nation")
dialect("select_int_const", "select n_name, n_regionkey from nation where n_regionkey = 1")
dialect("select_str_const", "select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'")
dialect("select_const_left", "select n_name from nation where 1 = n_regionkey")
dialect("select_field_eq_field", "select l_orderkey, l_linenumber, l_suppkey from lineitem where l_linenumber = l_suppkey")
dialect("select_conjunction", "select o_orderkey, o_custkey from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT' and o_orderkey > 100")
dialect("select_const_true", "select r_name from region where 1 = 1")
dialect("select_const_false", "select r_name from region where 'a' = 'b'")
dialect("select_type_mismatch", "select n_name from nation where n_nationkey = '5'", "select n_name from nation where false")
dialect("cmp_ne", "select n_name from nation where n_regionkey <> 2")
dialect("cmp_lt", "select p_partkey, p_size from part where p_size < 10")
dialect("cmp_le", "select p_partkey, p_size from part where p_size <= 10")
dialect("cmp_gt", "select p_partkey, p_name from part where p_brand > 'Brand#3'")
dialect("cmp_ge", "select o_orderkey from orders where o_custkey >= 1000")
dialect("pred_or", "select p_partkey from part where p_size = 1 or p_size = 50")
dialect("pred_and_or", "select p_partkey from part where p_size = 1 and p_partkey < 900 or p_size = 50 and p_partkey >= 900")
dialect("star", "select * from region")
dialect("aliases", "select n.n_name as nation_name, r.r_name region_name from nation n, region as r where n.n_regionkey = r.r_regionkey")
dialect("qualified", "select nation.n_name, region.r_name from nation, region where nation.n_regionkey = region.r_regionkey and region.r_regionkey = 3")

# products and joins
dialect("product_two", "select n_name, r_name from nation, region")
dialect("product_three", "select a.r_name as a_name, b.r_name as b_name, n_name from region a, region b, nation")
dialect("implicit_join_two", "select n_name, r_name from nation, region where n_regionkey = r_regionkey")
dialect("implicit_join_three", "select c_custkey, n_name, r_name from customer, nation, region where c_nationkey = n_nationkey and n_regionkey = r_regionkey")
dialect("implicit_join_four", "select l_orderkey, l_linenumber, c_name, n_name from lineitem, orders, customer, nation where l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n_nationkey and n_regionkey = 2")
dialect("join_inner", "select c.c_name, o.o_orderkey from customer c inner join orders o on c.c_custkey = o.o_custkey")
dialect("join_bare", "select c_name, n_name from customer join nation on c_nationkey = n_nationkey where n_regionkey = 0")
dialect("join_left", "select c.c_custkey, o.o_orderkey from customer c left join orders o on c.c_custkey = o.o_custkey and o.o_orderstatus = 'P'")
dialect("join_right", "select o.o_orderkey, c.c_custkey from orders o right outer join customer c on c.c_custkey = o.o_custkey and o.o_orderpriority = '5-LOW'")
dialect("join_full", "select n.n_nationkey, s.s_suppkey from nation n full outer join supplier s on n.n_nationkey = s.s_nationkey and s.s_suppkey < 20")
dialect("join_theta", "select a.n_name as low_name, b.n_name as high_name from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey = b.n_regionkey")
dialect("join_chain", "select c_name, o_orderkey, n_name from customer join orders on c_custkey = o_custkey left join nation on c_nationkey = n_nationkey where o_orderstatus = 'O'")



def _reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, TABLES[:8]).query_reordered("select l_orderkey, l_linenumber, c_name, n_name from lineitem, orders, customer, nation where l_orderkey = o_orderkey and o_custkey = c_custkey and c_nationkey = n_nationkey and n_regionkey = 2")


QUERIES["join_order_greedy"], ORACLE["join_order_greedy"] = _reordered, ORACLE["implicit_join_four"]

# views
dialect("view_of_its_own_name", "select n_name from nation", "select n_name from nation where n_regionkey = 3", ("create view nation as select n_name, n_regionkey from nation where n_regionkey = 3",))
_ASIA = "create view some_nations as select n_nationkey, n_name, n_regionkey from nation where n_regionkey = 2"
dialect("view_simple", "select n_name from some_nations", "select n_name from nation where n_regionkey = 2", (_ASIA,))
dialect("view_nested", "select n_name from narrow where n_nationkey > 5", "select n_name from nation where n_regionkey = 2 and n_nationkey > 5", (_ASIA, "create view narrow as select n_nationkey, n_name from some_nations"))
dialect("view_with_string_const", "select c_custkey from builders", "select c_custkey from customer where c_mktsegment = 'BUILDING'", ("create view builders as select c_custkey from customer where c_mktsegment = 'BUILDING'",))
dialect("view_join", "select c_name, n_name from customer, some_nations where c_nationkey = n_nationkey", "select c_name, n_name from customer, nation where c_nationkey = n_nationkey and n_regionkey = 2", (_ASIA,))
dialect("product_view", "select n_name, r_name from some_nations, region", "select n_name, r_name from nation, region where n_regionkey = 2", (_ASIA,))


# operators of the API
@operator("merge_join_unique", "select o_orderkey, c_name from orders join customer on o_custkey = c_custkey", "orders", "customer")
def _(orders, customer):
    return R.project(R.merge_join(orders, customer, "o_custkey", "c_custkey"), ["o_orderkey", "c_name"])


@operator("merge_join_dups", "select c_custkey, s_suppkey from customer join supplier on c_nationkey = s_nationkey", "customer", "supplier")
def _(customer, supplier):
    return R.project(R.merge_join(customer, supplier, "c_nationkey", "s_nationkey"), ["c_custkey", "s_suppkey"])


@operator("index_join", "select l_orderkey, l_linenumber, p_name from lineitem join part on l_partkey = p_partkey", "lineitem", "part")
def _(lineitem, part):
    return R.project(R.index_join(lineitem, part, "l_partkey", "p_partkey"), ["l_orderkey", "l_linenumber", "p_name"])


@operator("product_operator", "select s_name, r_name from supplier, region", "supplier", "region")
def _(supplier, region):
    return R.project(R.product(supplier, region), ["s_name", "r_name"])


@operator("block_product", "select s_suppkey, n_name from supplier, nation", "supplier", "nation")
def _(supplier, nation):
    return R.project(R.block_product(supplier, nation, 7), ["s_suppkey", "n_name"])


@operator("materialize_reuse", "select a.o_orderkey as first_key, b.o_orderkey as second_key from orders a join orders b on a.o_custkey = b.o_custkey where a.o_orderstatus = 'P' and b.o_orderstatus = 'P' and a.o_orderkey < b.o_orderkey", "orders")
def _(orders):
    some = R.materialize(R.project(R.select_rows(orders, "o_orderstatus = 'P'"), ["o_orderkey", "o_custkey"]))
    return R.join(some, some, "a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey", aliases=("a", "b")).toDF("first_key", "c1", "second_key", "c2").select("first_key", "second_key")


@operator("sort_single", "select c_custkey, c_name from customer order by c_name", "customer")
def _(customer):
    return R.project(R.sort(customer, ["c_name"]), ["c_custkey", "c_name"])


@operator("sort_multi", "select o_orderkey, o_orderstatus, o_orderpriority from orders order by o_orderstatus, o_orderpriority, o_orderkey", "orders")
def _(orders):
    return R.project(R.sort(orders, ["o_orderstatus", "o_orderpriority", "o_orderkey"]), ["o_orderkey", "o_orderstatus", "o_orderpriority"])


@operator("group_max_int", "select o_custkey, max(o_orderkey) as maxofo_orderkey from orders group by o_custkey", "orders")
def _(orders):
    return R.group_by(orders, ["o_custkey"], [max_of("o_orderkey")])


@operator("group_max_string", "select p_brand, max(p_name) as maxofp_name from part group by p_brand", "part")
def _(part):
    return R.group_by(part, ["p_brand"], [max_of("p_name")])


@operator("group_max_multi", "select c_nationkey, c_mktsegment, max(c_custkey) as maxofc_custkey, max(c_name) as maxofc_name from customer group by c_nationkey, c_mktsegment", "customer")
def _(customer):
    return R.group_by(customer, ["c_nationkey", "c_mktsegment"], [max_of("c_custkey"), max_of("c_name")])


@operator("grand_max", "select max(p_size) as maxofp_size from part", "part")
def _(part):
    return R.group_by(part, [], [max_of("p_size")])


@operator("grand_max_of_none", "select max(p_size) as maxofp_size from part where p_size < 0", "part")
def _(part):
    return R.group_by(R.select_rows(part, "p_size < 0"), [], [max_of("p_size")])


@operator("group_keys_only", "select distinct c_mktsegment from customer", "customer")
def _(customer):
    return R.group_by(customer, ["c_mktsegment"])


@operator("ext_group_count_sum", "select l_returnflag, count(l_orderkey) as countofl_orderkey, sum(l_linenumber) as sumofl_linenumber, min(l_partkey) as minofl_partkey from lineitem group by l_returnflag", "lineitem")
def _(lineitem):
    return R.group_by(lineitem, ["l_returnflag"], [Aggregate("count", "l_orderkey"), Aggregate("sum", "l_linenumber"), Aggregate("min", "l_partkey")])


# commands: the state of a table afterwards
def _folder(spark: SparkSession) -> str:
    """A new folder for managed tables, in the folder that all executors share, or a temporary one in local mode."""
    import uuid

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lamella-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        shared = "file://" + folder
    return f"{shared.rstrip('/')}/tables-{uuid.uuid4().hex}"


def managed(spark: SparkSession, sf_dir: str, indexes: tuple[str, ...] = ()) -> Engine:
    """A managed copy of nation in two files, with the indexes given."""
    e = Engine(spark, _folder(spark))
    e.execute("create table nat (n_nationkey int, n_name varchar(25), n_regionkey int)")
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    t, v = e.catalog.table("nat"), e.catalog.version("nat")
    for part in (F.col("n_nationkey") < 10, F.col("n_nationkey") >= 10):
        v = t.publish(t.insert(v, rows.where(part).coalesce(1)))
    for i in indexes:
        e.execute(i)
    return e


def command(name: str, commands: tuple[str, ...], oracle: str, indexes: tuple[str, ...] = ()) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = managed(spark, sf_dir, indexes)
        for c in commands:
            e.execute(c)
        if not indexes:
            return e.query("select n_nationkey, n_name, n_regionkey from nat")
        index = e.catalog.indexes_of("nat")[0]
        return index.rows(spark, e.catalog.table("nat"), e.catalog.version("nat")).select("n_nationkey", "n_name", "n_regionkey")

    QUERIES[name], ORACLE[name] = run, oracle


_NAT = "select n_nationkey, n_name, n_regionkey from nation"
_INSERT = ("insert into nat (n_nationkey, n_name, n_regionkey) values (100, 'NEW ONE', 4)", "insert into nat (n_name) values ('it''s')")
_INSERTED = f"{_NAT} union all select 100, 'NEW ONE', 4 union all select 0, 'it''s', 0"
_UPDATED = "select n_nationkey, case when n_regionkey = 1 then 'ONE' else n_name end as n_name, n_regionkey from nation"
_DELETED = f"{_NAT} where not (n_regionkey = 1 and n_nationkey > 3)"
command("insert_state", _INSERT, _INSERTED)
command("update_const_state", ("update nat set n_name = 'ONE' where n_regionkey = 1",), _UPDATED)
command("update_field_state", ("update nat set n_nationkey = n_regionkey where n_nationkey >= 20",), "select case when n_nationkey >= 20 then n_regionkey else n_nationkey end as n_nationkey, n_name, n_regionkey from nation")
command("delete_state", ("delete from nat where n_regionkey = 1 and n_nationkey > 3",), _DELETED)
command("delete_all_state", ("delete from nat",), f"{_NAT} where false")
_HASH, _TREE = "create index by_key on nat (n_nationkey)", "create index by_key on nat (n_nationkey) using btree"
command("index_insert_state", _INSERT, _INSERTED, (_HASH,))
command("index_update_state", ("update nat set n_name = 'ONE' where n_regionkey = 1",), _UPDATED, (_TREE,))
command("index_delete_state", ("delete from nat where n_regionkey = 1 and n_nationkey > 3",), _DELETED, (_HASH,))


def _orders(spark: SparkSession, sf_dir: str, kind: str) -> Engine:
    """A managed copy of orders with an index on the customer, and nation and customer attached."""
    e = Engine(spark, _folder(spark))
    for n in ("customer", "nation"):
        e.catalog.attach(n, lambda n=n: table(spark, sf_dir, n))
    e.execute("create table ord (o_orderkey int, o_custkey int, o_orderstatus varchar(1))")
    t, v = e.catalog.table("ord"), e.catalog.version("ord")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("int"), F.col("o_custkey").cast("int"), "o_orderstatus")
    t.publish(t.insert(v, rows))
    e.execute(f"create index by_customer on ord (o_custkey) using {kind}")
    return e


def _index_select(kind: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _orders(spark, sf_dir, kind).begin().indexed("ord", "o_custkey").lookup(37)

    return run


def _index_sql(sql: str, kind: str = "hash"):
    return lambda spark, sf_dir: _orders(spark, sf_dir, kind).query(sql)


_BY_CUSTOMER = "select o_orderkey, o_orderstatus from ord where o_custkey = 37 and o_orderstatus <> 'P'"
_OF_BUILDERS = "select c_name, o_orderkey from customer, ord where c_custkey = o_custkey and c_nationkey = 7"
for _name, _sql, _kind in (("index_select_sql", _BY_CUSTOMER, "hash"), ("index_select_sql_btree", _BY_CUSTOMER, "btree"), ("index_join_sql", _OF_BUILDERS, "hash")):
    QUERIES[_name], ORACLE[_name] = _index_sql(_sql, _kind), _sql.replace(" ord", " orders")


def _index_join_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _orders(spark, sf_dir, "hash")
    some = R.select_rows(table(spark, sf_dir, "customer"), "c_nationkey = 7")
    return R.project(R.index_join(some, e.begin().indexed("ord", "o_custkey"), "c_custkey"), ["c_name", "o_orderkey"])


QUERIES["index_join_lookup"], ORACLE["index_join_lookup"] = _index_join_operator, ORACLE["index_join_sql"]


for _kind in ("hash", "btree"):
    QUERIES[f"index_select_{_kind}"] = _index_select(_kind)
    ORACLE[f"index_select_{_kind}"] = "select o_orderkey, o_custkey, o_orderstatus from orders where o_custkey = 37"


# catalog and statistics
def _catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return managed(spark, sf_dir).query("select tblname, slotsize from tblcat")


def _catalog_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return managed(spark, sf_dir).query("select tblname, fldname, type, length, offset from fldcat")


def _catalog_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = managed(spark, sf_dir)
    e.execute("create view v as select n_name from nat where n_name = 'x y'")
    return e.query("select viewname, viewdef from viewcat")


def _catalog_indexes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return managed(spark, sf_dir, (_HASH,)).query("select indexname, tablename, fieldname from idxcat")


def _stats_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted once each and kept; the second call of each reads nothing."""
    c = engine(spark, sf_dir).catalog
    for n in TABLES:
        c.statistics(n, columns=False)
    return spark.createDataFrame([(n, c.statistics(n, columns=False)["rows"]) for n in TABLES], "table_name string, n_rows long")


def _stats_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a managed table: exact counts, before and after a command that makes another version."""
    e = managed(spark, sf_dir)
    out = [("before", c, n) for c, n in e.catalog.statistics("nat", approximate=False)["distinct"].items()]
    e.execute("update nat set n_regionkey = 0 where n_regionkey < 3")
    out += [("after", c, n) for c, n in e.catalog.statistics("nat", approximate=False)["distinct"].items()]
    return spark.createDataFrame(out, "at string, field string, n_distinct long")


def _two_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction over two tables that commits, and one that conflicts in the second and leaves nothing in the first."""
    from lamella.sources.log import Conflict

    e = managed(spark, sf_dir)
    e.execute("create table reg (r_regionkey int, r_name varchar(25))")
    done, late = e.begin(), e.begin()
    for t, key in ((done, 200), (late, 300)):
        t.execute(f"insert into nat (n_nationkey, n_name, n_regionkey) values ({key}, 'BOTH', 9)") if t is done else t.execute("create table other (a int)")
        t.execute(f"insert into reg (r_regionkey, r_name) values ({key}, 'BOTH')")
    late.execute("insert into other (a) values (1)")
    done.commit()
    try:
        late.commit()
    except Conflict:
        pass
    return e.query("select n_nationkey as k, n_name as name from nat where n_nationkey >= 200").unionAll(e.query("select r_regionkey as k, r_name as name from reg")).unionAll(e.query("select a as k, 'other' as name from other"))


QUERIES |= {"stats_distinct": _stats_distinct, "two_table_commit_state": _two_tables}
ORACLE |= {
    "stats_distinct": " union all ".join(f"select '{at}' as at, '{c}' as field, count(distinct {x}) as n_distinct from nation" for at, r in (("before", "n_regionkey"), ("after", "case when n_regionkey < 3 then 0 else n_regionkey end")) for c, x in (("n_nationkey", "n_nationkey"), ("n_name", "n_name"), ("n_regionkey", r))),
    "two_table_commit_state": "select 200 as k, 'BOTH' as name union all select 200, 'BOTH'",
}
QUERIES |= {"catalog_tables": _catalog_tables, "catalog_fields": _catalog_fields, "catalog_views": _catalog_views, "catalog_indexes": _catalog_indexes, "stats_counts": _stats_counts}
ORACLE |= {
    "catalog_tables": "select 'nat' as tblname, 53 as slotsize",
    "catalog_fields": "select * from (values ('nat', 'n_nationkey', 1, 0, 8), ('nat', 'n_name', 2, 25, 16), ('nat', 'n_regionkey', 1, 0, 45)) as t(tblname, fldname, type, length, \"offset\")",
    "catalog_views": "select 'v' as viewname, 'select n_name from nat where n_name = ''x y''' as viewdef",
    "catalog_indexes": "select 'by_key' as indexname, 'nat' as tablename, 'n_nationkey' as fieldname",
    "stats_counts": " union all ".join(f"select '{n}' as table_name, count(*) as n_rows from {n}" for n in TABLES),
}
