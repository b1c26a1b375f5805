"""Merge, join and aggregate queries over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from skarn.functions.exprs import non_empty
from skarn.operators import chunks as C, merge, relate, stats

from .base import query


@query("SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_last_wins(t):
    return merge.latest(t.events.select("user_id", "ts", "event_type", "value", "event_id"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "value", "event_id")


_MERGE_SQL = """WITH old AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0),
new AS (SELECT o_orderkey, 'N' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0)
SELECT coalesce(n.o_orderkey, o.o_orderkey) AS o_orderkey, {status} AS o_orderstatus, coalesce(n.o_totalprice, o.o_totalprice) AS o_totalprice,
CASE WHEN o.o_orderkey IS NULL THEN 'created' WHEN n.o_orderkey IS NULL THEN 'kept' ELSE 'updated' END AS change FROM old o FULL JOIN new n ON o.o_orderkey = n.o_orderkey"""


def _sides(t):
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    new = rows.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("N").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return rows.where("o_orderkey % 3 <> 0"), new


@query(_MERGE_SQL.format(status="coalesce(n.o_orderstatus, o.o_orderstatus)"))
def merge_existing_new(t):
    return merge.merge(*_sides(t), ["o_orderkey"])


@query(_MERGE_SQL.format(status="coalesce(o.o_orderstatus, n.o_orderstatus)"))
def merge_frozen_properties(t):
    return merge.merge(*_sides(t), ["o_orderkey"], frozen=("o_orderstatus",))


@query("""SELECT o_custkey, l_partkey, l_quantity FROM (SELECT o_custkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS n
FROM lineitem JOIN orders ON o_orderkey = l_orderkey) WHERE n = 1""")
def edge_merge_once(t):
    edges = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "l_partkey", "l_orderkey", "l_linenumber", "l_quantity")
    return merge.merge_edges(edges, ["o_custkey", "l_partkey"], ["l_orderkey", "l_linenumber", "l_quantity"]).select("o_custkey", "l_partkey", "l_quantity")


@query("""WITH old AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity < 20), new AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity >= 10)
SELECT *, 'old' AS origin FROM old UNION ALL SELECT *, 'new' FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.l_orderkey = n.l_orderkey AND o.l_partkey = n.l_partkey)""")
def edge_insert_if_absent(t):
    pairs = lambda condition, origin: t.lineitem.where(condition).select("l_orderkey", "l_partkey").distinct().withColumn("origin", F.lit(origin))
    return merge.insert_if_absent(pairs("l_quantity < 20", "old"), pairs("l_quantity >= 10", "new"), ["l_orderkey", "l_partkey"])


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def belongs_to(t):
    return relate.belongs_to(t.nation, t.region, "n_regionkey", "r_regionkey").select("n_nationkey", "n_name", "r_name")


@query("SELECT c_custkey, count(o_orderkey) AS n_edges FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus IS NOT NULL AND o_orderstatus <> '' AND o_totalprice > 200000 GROUP BY 1")
def optional_match(t):
    named = t.orders.where(non_empty(F.col("o_orderstatus")) & (F.col("o_totalprice") > 200000))
    return relate.optional_match(t.customer, named, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(F.count("o_orderkey").alias("n_edges"))


@query("""SELECT l_orderkey, l_linenumber, c.c_name AS caller, s.s_name AS target FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer c ON c.c_custkey = o_custkey AND c.c_nationkey < 20 JOIN supplier s ON s.s_suppkey = l_suppkey AND s.s_nationkey < 20""")
def double_match(t):
    calls = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "o_custkey", "l_suppkey")
    ends = relate.one_hop(calls, t.customer.where("c_nationkey < 20"), t.supplier.where("s_nationkey < 20"), ("o_custkey", "c_custkey"), ("l_suppkey", "s_suppkey"))
    return ends.select("l_orderkey", "l_linenumber", F.col("c_name").alias("caller"), F.col("s_name").alias("target"))


@query("""WITH u AS (SELECT c_custkey, c_nationkey AS name FROM customer), a AS (SELECT s_nationkey AS name, 'type:' || s_suppkey AS target FROM supplier WHERE s_nationkey % 3 = 0),
b AS (SELECT n_nationkey AS name, 'interface:' || n_name AS target FROM nation)
SELECT name, c_custkey, target FROM u JOIN a USING (name) UNION ALL SELECT name, c_custkey, target FROM u JOIN b USING (name) WHERE name NOT IN (SELECT name FROM a)""")
def fallback_join(t):
    usages = t.customer.select("c_custkey", F.col("c_nationkey").alias("name"))
    types = t.supplier.where("s_nationkey % 3 = 0").select(F.col("s_nationkey").alias("name"), F.concat(F.lit("type:"), F.col("s_suppkey").cast("string")).alias("target"))
    return relate.fallback_join(usages, types, t.nation.select(F.col("n_nationkey").alias("name"), F.concat(F.lit("interface:"), "n_name").alias("target")), "name")


@query("""WITH children AS (SELECT 'class' AS kind, c_custkey AS child, c_nationkey AS name FROM customer UNION ALL SELECT 'interface', s_suppkey, s_nationkey FROM supplier),
a AS (SELECT n_nationkey AS name, n_name AS target FROM nation WHERE n_regionkey < 2), b AS (SELECT n_nationkey AS name, 'i' || n_name AS target FROM nation WHERE n_regionkey < 4)
SELECT name, kind, child, target FROM children JOIN a USING (name) UNION ALL SELECT name, kind, child, target FROM children JOIN b USING (name) WHERE name NOT IN (SELECT name FROM a)""")
def coalesce_join(t):
    children = t.customer.select(F.lit("class").alias("kind"), F.col("c_custkey").alias("child"), F.col("c_nationkey").alias("name")).unionByName(
        t.supplier.select(F.lit("interface").alias("kind"), F.col("s_suppkey").alias("child"), F.col("s_nationkey").alias("name"))
    )
    parents = t.nation.select(F.col("n_nationkey").alias("name"), "n_name", "n_regionkey")
    return relate.coalesce_join(children, parents.where("n_regionkey < 2").withColumn("target", F.col("n_name")), parents.where("n_regionkey < 4").withColumn("target", F.concat(F.lit("i"), "n_name")), "name", "target")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def name_many_to_many(t):
    return t.supplier.join(t.customer, F.col("s_nationkey") == F.col("c_nationkey")).select("s_suppkey", "c_custkey")


@query("""WITH f AS (SELECT o_custkey AS file, o_orderpriority AS name, max(o_orderkey) AS target_seq FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2)
SELECT o_orderkey AS call, o_custkey AS file, o_orderpriority AS called, target_seq, CASE WHEN target_seq IS NOT NULL THEN o_orderpriority END AS target
FROM orders LEFT JOIN f ON file = o_custkey AND name = o_orderpriority WHERE o_orderkey % 2 = 1""")
def local_resolution(t):
    functions = t.orders.where("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("name"), F.col("o_orderkey").alias("seq"))
    calls = t.orders.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("call"), F.col("o_custkey").alias("file"), F.col("o_orderpriority").alias("called"))
    return relate.resolve_local(calls, functions).select("call", "file", "called", "target_seq", "target")


@query("""WITH calls AS (SELECT l_orderkey AS file, l_linenumber AS call, l_returnflag AS owner, l_linestatus AS method FROM lineitem WHERE l_quantity < 25),
classes AS (SELECT DISTINCT l_orderkey AS file, l_returnflag AS name FROM lineitem WHERE l_discount > 0.05),
f AS (SELECT l_orderkey AS file, l_linestatus AS name, min(l_linenumber) AS target_seq FROM lineitem WHERE l_tax > 0.03 GROUP BY 1, 2)
SELECT calls.file, call::BIGINT AS call, owner, method, target_seq::BIGINT AS target_seq FROM calls JOIN classes ON classes.file = calls.file AND classes.name = owner JOIN f ON f.file = calls.file AND f.name = method""")
def qualified_resolution(t):
    rows = t.lineitem.withColumnRenamed("l_orderkey", "file")
    calls = rows.where("l_quantity < 25").select("file", F.col("l_linenumber").cast("bigint").alias("call"), F.concat_ws(".", "l_returnflag", "l_linestatus").alias("called"))
    classes = rows.where("l_discount > 0.05").select("file", F.col("l_returnflag").alias("name"))
    functions = rows.where("l_tax > 0.03").select("file", F.col("l_linestatus").alias("name"), F.col("l_linenumber").cast("bigint").alias("seq"))
    return relate.resolve_qualified(calls, functions, classes).select("file", "call", "owner", "method", "target_seq")


#: Lines 1, 2 and 49, 50 are in no span.
SPANS = [("outer", 3, 48), ("first", 5, 20), ("nested", 8, 12), ("second", 30, 44), ("tail", 44, 48)]


@query(f"""WITH spans(name, first, last) AS (VALUES {', '.join(map(str, SPANS))})
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, coalesce((SELECT arg_max(name, (first, -last)) FROM spans WHERE l_quantity BETWEEN first AND last), '') AS scope FROM lineitem""")
def innermost_scope(t):
    spans = t.spark.createDataFrame(SPANS, "name string, start_line int, end_line int")
    points = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_quantity")
    return relate.innermost(points, spans, [], "l_quantity").select("l_orderkey", "l_linenumber", F.coalesce("name", F.lit("")).alias("scope"))


@query("""WITH calls AS (SELECT l_orderkey AS file, l_quantity AS line, l_linenumber FROM lineitem),
spans AS (SELECT l_orderkey AS file, l_linenumber AS name, least(l_quantity, l_discount * 500) AS first, greatest(l_quantity, l_discount * 500) AS last FROM lineitem WHERE l_returnflag = 'R')
SELECT file, c.l_linenumber::BIGINT AS l_linenumber, line, (SELECT max(s.first) FROM spans s WHERE s.file = c.file AND line BETWEEN s.first AND s.last) AS start_line FROM calls c""")
def innermost_by_file(t):
    rows = t.lineitem.withColumnRenamed("l_orderkey", "file")
    points = rows.select("file", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), F.col("l_quantity").alias("line"))
    spans = rows.where("l_returnflag = 'R'").select("file", F.expr("least(l_quantity, l_discount * 500)").alias("start_line"), F.expr("greatest(l_quantity, l_discount * 500)").alias("end_line"))
    return relate.innermost(points, spans, ["file"], "line").select("file", "l_linenumber", "line", "start_line")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def membership_semi(t):
    return t.customer.join(t.orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)")
def anti_join(t):
    return t.part.join(t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


@query("""SELECT DISTINCT c_name, n_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey AND p_brand = 'Brand#1'
JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def star_distinct(t):
    uses = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part.where("p_brand = 'Brand#1'"), F.col("p_partkey") == F.col("l_partkey"))
    return uses.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).select("c_name", "n_name").distinct()


@query("SELECT l_orderkey, string_agg(l_partkey || ':' || l_linenumber, ';' ORDER BY l_linenumber, l_partkey || ':' || l_linenumber) AS elements FROM lineitem GROUP BY 1")
def group_collect(t):
    item = F.struct("l_linenumber", F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")).alias("x"))
    return t.lineitem.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["x"]), ";").alias("elements"))


@query("""SELECT l_orderkey::VARCHAR AS file, '// Imports for ' || l_orderkey || chr(10) || string_agg('import from ''' || l_partkey || '''' || chr(10), '' ORDER BY l_linenumber, l_partkey::VARCHAR) AS content,
string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey::VARCHAR) AS modules FROM lineitem GROUP BY l_orderkey""")
def import_concat(t):
    rows = t.lineitem.select(F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").alias("seq"), F.col("l_partkey").cast("string").alias("module"))
    return C.import_lines(rows).select("file", "content", F.array_join("modules", ",").alias("modules"))


@query("SELECT event_type AS kind, count(*) AS n, sum((value < 1)::INT)::BIGINT AS errors FROM events GROUP BY 1")
def entity_counts(t):
    return t.events.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.sum((F.col("value") < 1).cast("bigint")).alias("errors"))


@query("SELECT 'customer' AS kind, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'constants', 0")
def entity_table_counts(t):
    return stats.entity_counts({"customer": t.customer, "supplier": t.supplier, "constants": t.part.limit(0)})


@query("SELECT n_name, count(c_custkey) AS n_edges FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
def edge_counts(t):
    return t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_name").agg(F.count("c_custkey").alias("n_edges"))


@query("SELECT event_type, event_id, floor(sum((value * 100)::BIGINT) OVER w / count(*) OVER w)::BIGINT AS mean FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 999 PRECEDING AND CURRENT ROW)")
def rolling_mean_1000(t):
    cents = t.events.select("event_type", "event_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    return stats.rolling_mean(cents, "event_id", "cents", 1000, ["event_type"]).select("event_type", "event_id", "mean")


@query("SELECT EXISTS (SELECT 1 FROM events WHERE event_type = 'purchase') AS found")
def exists_check(t):
    return stats.exists(t.events.where("event_type = 'purchase'"))


@query("SELECT o_custkey, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1")
def latest_row(t):
    return merge.latest(t.orders.select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("latest"))


@query("""WITH RECURSIVE reach(root, node, depth) AS (SELECT n_regionkey, n_nationkey, 1 FROM nation WHERE n_nationkey % 5 = 0
UNION ALL SELECT root, (node * 2 + 1) % 25, depth + 1 FROM reach WHERE depth < 6) SELECT root, node, min(depth)::BIGINT AS depth FROM reach GROUP BY 1, 2""")
def recursive_callers(t):
    t.nation.createOrReplaceTempView("_nation")
    return t.spark.sql("""WITH RECURSIVE reach(root, node, depth) AS (SELECT n_regionkey, n_nationkey, 1 FROM _nation WHERE n_nationkey % 5 = 0
        UNION ALL SELECT root, (node * 2 + 1) % 25, depth + 1 FROM reach WHERE depth < 6) SELECT root, node, CAST(min(depth) AS BIGINT) AS depth FROM reach GROUP BY root, node""")
