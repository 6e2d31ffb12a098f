"""Projections, filters, joins, unions and orderings over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablehaul.dialects import ORACLE, POSTGRES
from tablehaul.operators import relational as R
from tablehaul.operators.aggregates import count_children, lists_equal
from tablehaul.operators.checks import missing_columns, missing_tables, orphans, reconcile_counts
from tablehaul.operators.positions import rank_within
from tablehaul.operators.skew import join_hot
from tablehaul.operators.splits import even_parts
from tablehaul.sources.scan import table_inventory
from tablehaul.workloads.registry import RELATIONAL, register, table

MONEY = "decimal(18,2)"


@register(
    "customer_order_count",
    """SELECT c_custkey AS user_id, c_name AS username, CAST(count(o_orderkey) AS BIGINT) AS order_count
       FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""",
)
def customer_order_count(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    counted = count_children(customers, table(spark, folder, "orders"), "c_custkey", "o_custkey", "order_count")
    return counted.select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("username"), "order_count")


@register(
    "fold_columns",
    """SELECT c_custkey AS "C_CUSTKEY", c_name AS "C_NAME", c_nationkey AS "C_NATIONKEY",
              c_acctbal AS "C_ACCTBAL", c_mktsegment AS "C_MKTSEGMENT" FROM customer""",
)
def fold_columns(spark, folder):
    return R.fold_columns(R.fold_columns(table(spark, folder, "customer"), POSTGRES), ORACLE)


@register(
    "align_sources",
    """SELECT 'customer' AS source, c_custkey AS party_key, c_name AS name, c_nationkey AS nation,
              CAST(c_acctbal AS DECIMAL(18,2)) AS balance, c_mktsegment AS segment FROM customer
       UNION ALL SELECT 'supplier', s_suppkey, s_name, s_nationkey, CAST(s_acctbal AS DECIMAL(18,2)), NULL FROM supplier""",
)
def align_sources(spark, folder):
    customer = {
        "source": "'customer'", "party_key": "c_custkey", "name": "c_name", "nation": "c_nationkey",
        "balance": f"CAST(c_acctbal AS {MONEY})", "segment": "c_mktsegment",
    }
    supplier = {
        "source": "'supplier'", "party_key": "s_suppkey", "name": "s_name", "nation": "s_nationkey",
        "balance": f"CAST(s_acctbal AS {MONEY})",
    }
    return R.align_sources([(table(spark, folder, "customer"), customer), (table(spark, folder, "supplier"), supplier)])


@register(
    "exclude_members",
    """SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW')""",
)
def exclude_members(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return R.exclude_members(orders, "o_orderpriority", ("1-URGENT", "5-LOW"))


_OWNERS = {
    POSTGRES: "CASE event_type WHEN 'view' THEN 'pg_catalog' WHEN 'click' THEN 'information_schema' ELSE event_type END",
    ORACLE: "CASE event_type WHEN 'view' THEN 'SYS' WHEN 'click' THEN 'XS$NULL' ELSE event_type END",
}


def _register_system(dialect: str) -> None:
    @register(
        f"exclude_system_{dialect}",
        f"SELECT event_id, {_OWNERS[dialect]} AS owner FROM events WHERE event_type NOT IN ('view', 'click')",
    )
    def owned(spark, folder):
        listed = table(spark, folder, "events").selectExpr("event_id", f"{_OWNERS[dialect]} AS owner")
        return R.exclude_system(listed, "owner", dialect)


for _dialect in _OWNERS:
    _register_system(_dialect)


@register("equality_filter", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def equality_filter(spark, folder):
    return table(spark, folder, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", "o_orderstatus")


@register(
    "search_tables",
    """SELECT p_partkey, p_brand, p_name FROM part
       WHERE lower(p_brand || '.' || p_name) LIKE '%#1.red%' OR lower(p_brand) LIKE '%#1.red%' OR lower(p_name) LIKE '%#1.red%'""",
)
def search_tables(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_name")
    return R.search_tables(parts, "p_brand", "p_name", "#1.Red")


@register(
    "search_kind",
    """SELECT p_partkey, p_type, p_brand, p_name FROM part
       WHERE p_type = 'PROMO' AND (lower(p_name) LIKE '%ring%' OR lower(p_brand) LIKE '%ring%')""",
)
def search_kind(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_type", "p_brand", "p_name")
    return R.search_objects(parts, "p_type", "p_brand", "p_name", "PROMO", " Ring ")


@register(
    "selected_visible",
    """SELECT p_partkey, p_brand, p_name, p_size > 25 AS selected FROM part
       WHERE p_size > 25 AND (lower(p_name) LIKE '%blue%' OR lower(p_brand) LIKE '%blue%')""",
)
def selected_visible(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_name", (F.col("p_size") > 25).alias("selected"))
    return R.selected_visible(parts, "selected", "p_brand", "p_name", "BLUE")


@register(
    "flag_filter",
    """SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem
       WHERE l_linestatus = 'F' AND NOT (l_returnflag = 'N') AND l_returnflag IN ('A', 'R')""",
)
def flag_filter(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return lines.filter(
        (F.col("l_linestatus") == "F") & ~(F.col("l_returnflag") == "N") & F.col("l_returnflag").isin("A", "R")
    )


@register(
    "drop_blank",
    r"""SELECT p_partkey, name FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN '  ' WHEN 1 THEN NULL
        WHEN 2 THEN chr(9) ELSE p_name END AS name FROM part) t WHERE regexp_replace(coalesce(name, ''), '\s', '', 'g') <> ''""",
)
def drop_blank(spark, folder):
    step = F.col("p_size") % 5
    name = F.when(step == 0, "  ").when(step == 1, None).when(step == 2, "\t").otherwise(F.col("p_name"))
    return R.drop_blank(table(spark, folder, "part").select("p_partkey", name.alias("name")), "name")


@register(
    "semi_join_exists",
    """SELECT c_custkey, c_name FROM customer WHERE EXISTS
       (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
)
def semi_join_exists(spark, folder):
    urgent = table(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'")
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    return R.present(customers, urgent.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@register(
    "anti_join",
    """SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS
       (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')""",
)
def anti_join(spark, folder):
    urgent = table(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'")
    customers = table(spark, folder, "customer").select("c_custkey", "c_name")
    return R.absent(customers, urgent.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@register(
    "conditional_column",
    "SELECT p_partkey, p_type, CASE WHEN p_type LIKE 'S%' THEN p_size END AS small_size FROM part",
)
def conditional_column(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey", "p_type", F.when(F.col("p_type").like("S%"), F.col("p_size")).alias("small_size")
    )


@register(
    "join_composite",
    """SELECT l_orderkey, l_linenumber, l_partkey, o_orderstatus, c_name
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey""",
)
def join_composite(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderstatus")
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    # Orders are narrowed to what a line needs before the lines, by far the largest side, join once.
    headed = join_hot(orders, customers, ["o_custkey"])
    joined = join_hot(lines, headed, ["l_orderkey"])
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "o_orderstatus", "c_name")


@register(
    "left_join_flag",
    """SELECT o_orderkey, o_orderstatus, CASE WHEN k IS NULL THEN 0 ELSE 1 END AS has_returns FROM orders
       LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R') r ON k = o_orderkey""",
)
def left_join_flag(spark, folder):
    returned = table(spark, folder, "lineitem").filter("l_returnflag = 'R'")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return R.flag_matches(orders, returned.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"], "has_returns")


@register(
    "pair_by_position",
    """SELECT a.l_orderkey, a.l_linenumber, a.local_part, b.referenced_part, a.n > 1 OR b.n > 1 AS repeated FROM
       (SELECT l_orderkey, l_linenumber, min(l_partkey) AS local_part, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) a
       JOIN (SELECT l_orderkey, l_linenumber, min(l_partkey) AS referenced_part, count(*) AS n FROM lineitem WHERE l_returnflag = 'A'
       GROUP BY ALL) b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber""",
)
def pair_by_position(spark, folder):
    lines = table(spark, folder, "lineitem")
    local = lines.filter("l_returnflag = 'R'").withColumnRenamed("l_partkey", "local_part")
    referenced = lines.filter("l_returnflag = 'A'").withColumnRenamed("l_partkey", "referenced_part")
    return R.pair_by_position(local, referenced, ["l_orderkey", "l_linenumber"], "local_part", "referenced_part", "report")


@register(
    "posexplode_keys",
    """SELECT vec_id, CAST(pos AS INTEGER) AS position, CAST(round(CAST(embedding[pos] AS DOUBLE) * 1000000) AS BIGINT) AS local_key,
              CAST(round(CAST(embedding[len(embedding) + 1 - pos] AS DOUBLE) * 1000000) AS BIGINT) AS referenced_key
       FROM (SELECT vec_id, embedding, unnest(generate_series(1, len(embedding))) AS pos FROM embeddings) t""",
)
def posexplode_keys(spark, folder):
    vectors = table(spark, folder, "embeddings")
    values = F.col("embedding")
    opened = R.unnest_with_position(vectors, ["vec_id"], local=values, referenced=F.reverse(values))
    whole = lambda name: F.round(F.col(name).cast("double") * 1000000).cast("bigint")
    return opened.select(
        "vec_id", "position", whole("local").alias("local_key"), whole("referenced").alias("referenced_key")
    )


@register(
    "fk_orphans",
    """SELECT l_orderkey, CAST(count(*) AS BIGINT) AS row_count FROM lineitem WHERE l_orderkey IS NOT NULL AND NOT EXISTS
       (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') GROUP BY l_orderkey""",
)
def fk_orphans(spark, folder):
    parents = table(spark, folder, "orders").filter("o_orderstatus = 'F'")
    return orphans(table(spark, folder, "lineitem"), parents, {"l_orderkey": "o_orderkey"})


@register(
    "fk_orphans_composite",
    """WITH known AS (SELECT DISTINCT l_partkey AS pk, l_suppkey AS sk FROM lineitem WHERE l_linestatus = 'F')
       SELECT l_partkey, l_suppkey, CAST(count(*) AS BIGINT) AS row_count FROM lineitem
       WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM known WHERE pk = l_partkey AND sk = l_suppkey) GROUP BY ALL""",
)
def fk_orphans_composite(spark, folder):
    lines = table(spark, folder, "lineitem")
    parents = lines.filter("l_linestatus = 'F'").select("l_partkey", "l_suppkey").distinct()
    child = lines.filter("l_returnflag = 'R'")
    return orphans(child, parents, {"l_partkey": "l_partkey", "l_suppkey": "l_suppkey"})


def _counts_sql(wheres: dict[str, str], names=RELATIONAL) -> str:
    return " UNION ALL ".join(
        f"SELECT 'tpch' AS table_schema, '{n}' AS table_name, CAST(count(*) AS BIGINT) AS row_count FROM {n}{wheres.get(n, '')}"
        for n in names
    )


@register("table_inventory", _counts_sql({}))
def inventory(spark, folder):
    return table_inventory({n: table(spark, folder, n) for n in RELATIONAL}, "tpch")


@register(
    "reconcile_counts",
    f"""SELECT 'tpch' AS table_schema, coalesce(a.table_name, b.table_name) AS table_name, a.row_count AS source_rows,
        b.row_count AS target_rows, a.row_count IS NOT DISTINCT FROM b.row_count AS matches
        FROM ({_counts_sql({}, RELATIONAL[1:])}) a FULL JOIN
        ({_counts_sql({"lineitem": " WHERE l_linestatus = 'F'"}, RELATIONAL[:-1])}) b ON a.table_name = b.table_name""",
)
def reconcile(spark, folder):
    tables = {n: table(spark, folder, n) for n in RELATIONAL}
    source = table_inventory({n: tables[n] for n in RELATIONAL[1:]}, "tpch")
    copied = {n: tables[n] for n in RELATIONAL[:-1]} | {"lineitem": tables["lineitem"].filter("l_linestatus = 'F'")}
    return reconcile_counts(source, table_inventory(copied, "tpch"))


@register(
    "restore_selection",
    """SELECT p_partkey, p_brand, p_name, EXISTS (SELECT 1 FROM part c WHERE c.p_size = 50
       AND lower(c.p_brand || '.' || c.p_name) = lower(p.p_brand || '.' || p.p_name)) AS selected FROM part p""",
)
def restore_selection(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_brand", "p_name", "p_size")
    chosen = parts.filter("p_size = 50").select(F.upper("p_brand").alias("p_brand"), F.upper("p_name").alias("p_name"))
    return R.restore_selection(parts.drop("p_size"), chosen, "p_brand", "p_name")


@register(
    "union_listings",
    """SELECT 'customer' AS kind, c_custkey AS object_key, c_name AS name FROM customer
       UNION ALL SELECT 'supplier', s_suppkey, s_name FROM supplier UNION ALL SELECT 'part', p_partkey, p_name FROM part""",
)
def union_listings(spark, folder):
    listed = lambda n, key, name: table(spark, folder, n).select(F.col(key).alias("object_key"), F.col(name).alias("name"))
    return R.union_listings(
        {
            "customer": listed("customer", "c_custkey", "c_name"),
            "supplier": listed("supplier", "s_suppkey", "s_name"),
            "part": listed("part", "p_partkey", "p_name"),
        }
    )


PART_KINDS = {"STANDARD": 0, "LARGE": 1, "SMALL": 2, "PROMO": 3, "ECONOMY": 4, "MEDIUM": 5}
_KIND_RANK = "CASE p_type " + " ".join(f"WHEN '{k}' THEN {r}" for k, r in PART_KINDS.items()) + " END"


@register(
    "kind_name_order",
    f"""SELECT p_partkey, p_type, p_brand, p_name, CAST(row_number() OVER
        (ORDER BY {_KIND_RANK}, lower(p_brand), lower(p_name), p_partkey) AS BIGINT) AS position FROM part""",
)
def kind_name_order(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_type", "p_brand", "p_name")
    return R.order_objects(parts, "p_type", PART_KINDS, "p_brand", "p_name", "p_partkey")


@register(
    "section_order",
    f"""SELECT p_partkey, p_type, CAST(row_number() OVER (ORDER BY {_KIND_RANK} DESC, p_partkey DESC) AS BIGINT) AS position
        FROM part""",
)
def section_order(spark, folder):
    parts = table(spark, folder, "part").select("p_partkey", "p_type")
    return R.rank_sections(parts, "p_type", PART_KINDS, ["p_partkey"], undo=True)


@register(
    "missing_columns",
    """SELECT p_brand, p_name, min(p_partkey) AS first_key FROM part p WHERE NOT EXISTS (SELECT 1 FROM part t
       WHERE t.p_size > 25 AND lower(t.p_brand) = lower(p.p_brand) AND lower(t.p_name) = lower(p.p_name)) GROUP BY ALL""",
)
def columns_missing(spark, folder):
    parts = table(spark, folder, "part").withColumnRenamed("p_partkey", "first_key")
    target = parts.filter("p_size > 25").withColumn("p_name", F.upper("p_name"))
    return missing_columns(parts, target, "p_brand", "p_name", "first_key")


@register(
    "missing_tables",
    """SELECT DISTINCT p_brand, p_name FROM part p WHERE p_type <> 'PROMO' AND NOT EXISTS (SELECT 1 FROM part t
       WHERE t.p_type = 'PROMO' AND lower(t.p_brand) = lower(p.p_brand) AND lower(t.p_name) = lower(p.p_name))""",
)
def tables_missing(spark, folder):
    parts = table(spark, folder, "part")
    target = parts.filter("p_type = 'PROMO'").withColumn("p_brand", F.upper("p_brand"))
    return missing_tables(parts.filter("p_type <> 'PROMO'"), target, ["p_brand", "p_name"])


_NULL_CUSTOMER = "nullif(o_custkey, 7)"
_SIDE = """SELECT {group} AS k, lower(o_orderpriority) AS v, row_number() OVER (PARTITION BY {group} ORDER BY {order}) AS p FROM orders"""


def _equal_sql(group: str, name: str) -> str:
    a, b = _SIDE.format(group=group, order="o_orderkey"), _SIDE.format(group=group, order="o_orderdate, o_orderkey")
    return f"""SELECT coalesce(a.k, b.k) AS {name}, bool_and(coalesce(a.v = b.v, false)) AS lists_equal
       FROM ({a}) a FULL JOIN ({b}) b ON a.k IS NOT DISTINCT FROM b.k AND a.p = b.p GROUP BY 1"""


def _equal(spark, folder, group: str, name: str):
    orders = table(spark, folder, "orders").selectExpr(f"{group} AS {name}", "o_orderkey", "o_orderdate", "o_orderpriority")
    by_key = rank_within(orders, [name], ["o_orderkey"])
    by_date = rank_within(orders.withColumn("o_orderpriority", F.upper("o_orderpriority")), [name], ["o_orderdate", "o_orderkey"])
    return lists_equal(by_key, by_date, [name], "o_orderpriority")


@register("equal_lists", _equal_sql("o_custkey", "o_custkey"))
def equal_lists(spark, folder):
    return _equal(spark, folder, "o_custkey", "o_custkey")


@register("equal_lists_null_group", _equal_sql(_NULL_CUSTOMER, "customer"))
def equal_lists_null_group(spark, folder):
    return _equal(spark, folder, _NULL_CUSTOMER, "customer")


@register(
    "even_splits",
    """SELECT 'gaps' AS key, count(*) AS placed, TRUE AS even FROM lineitem
       UNION ALL SELECT 'hot', count(*), TRUE FROM lineitem""",
)
def even_splits(spark, folder):
    """Parts of a key with wide gaps, and of one that a third of all rows have: no part is larger than twice the mean."""
    # As doubles: the cube of a key over 2,097,151 does not fit a long.
    wide = F.col("l_orderkey").cast("double")
    lines = table(spark, folder, "lineitem").select(
        (wide * wide * wide).alias("gaps"),
        F.when(F.col("l_orderkey") % 3 == 0, 7).otherwise(F.col("l_partkey")).cast("double").alias("hot"), "l_orderkey", "l_linenumber",
    ).withColumn("tie", F.struct("l_orderkey", "l_linenumber"))
    found = []
    for key in ("gaps", "hot"):
        counts = even_parts(lines, key, 16, "tie").groupBy("part").agg(F.count("*").alias("n"))
        found.append(counts.agg(F.sum("n").alias("placed"), (F.max("n") * 16 <= 2 * F.sum("n")).alias("even")).select(F.lit(key).alias("key"), "placed", "even"))
    return found[0].unionByName(found[1])
