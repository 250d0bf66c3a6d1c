"""Queries of the keyed-table operators on the driver's tables, each with the
same in SQL."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.frame import KeyedFrame, keyed
from keyloom.functions import sequence, text
from keyloom.operators import aggregates as agg
from keyloom.operators import filters, intervals, joins, load, ranks, shape
from keyloom.plans import associations as assoc
from keyloom.plans import indices, tasks
from keyloom.plans.rules import Only, Rule, Var, traverse
from keyloom.storage import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def exact_sum(c: str):
    return F.sum(F.col(c).cast("decimal(18,2)")).cast("double")


SUM = "CAST(sum(CAST({} AS DECIMAL(18,2))) AS DOUBLE)"


def joined(*names: str):
    return [F.array_join(F.transform(n, lambda x: x.cast("string")), "|").alias(n) for n in names]


def micros(c: str):
    """Of a time without a zone, as if in UTC, whatever the session's zone."""
    return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(c)).cast("timestamp"))


def customers(t) -> KeyedFrame:
    return keyed(t("customer"), "c_custkey")


def order_lists(t) -> KeyedFrame:
    """Orders of each customer: a double table."""
    return load.merge(t("orders"), "o_custkey", ["o_orderkey", "o_orderstatus", "o_totalprice"], ["o_orderkey"])


def purchases(t) -> DataFrame:
    e = t("events").where("event_type = 'purchase'")
    return e.select(F.col("event_id").alias("b_id"), micros("ts").alias("b_start"), (micros("ts") + 3_600_000_000).alias("b_end"))


@query("SELECT lang, arg_min(doc_id, doc_id) AS doc_id, arg_min(source, doc_id) AS source FROM documents GROUP BY lang")
def q01_load_first_wins(t):
    return load.first_wins(t("documents").select("lang", "doc_id", "source"), "lang", ["doc_id", "source"], ["doc_id"]).df


@query("SELECT o_custkey, string_agg(o_orderstatus, '|' ORDER BY o_orderkey) AS o_orderstatus FROM orders GROUP BY 1")
def q02_load_merge(t):
    return order_lists(t).df.select("o_custkey", *joined("o_orderstatus"))


@query("SELECT l_partkey, string_agg(l_quantity::INT::VARCHAR, '|' ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS l_quantity FROM lineitem GROUP BY 1")
def q03_load_zipped(t):
    """Rows with several keys, of which the i-th takes the i-th quantity."""
    rows = t("lineitem").withColumn("l_quantity", F.col("l_quantity").cast("int"))
    lists = load.merge(rows, "l_orderkey", ["l_partkey", "l_quantity"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"])
    return load.merge_zipped(lists.df, "l_partkey", ["l_quantity"], ["l_orderkey"]).df.select("l_partkey", *joined("l_quantity"))


@query("SELECT word, string_agg(p_partkey::VARCHAR, '|' ORDER BY p_partkey) AS p_partkey FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
def q04_rekey_words(t):
    words = t("part").select("p_partkey", F.split("p_name", " ").alias("word"))
    return shape.rekey(KeyedFrame(words, "p_partkey", ["word"], "double"), "word").df.select("word", *joined("p_partkey"))


@query("SELECT s_suppkey, upper(s_name) AS s_name, round(s_acctbal * 100, 0) AS s_acctbal, length(s_name) AS size FROM supplier")
def q05_slice_process(t):
    own = shape.slice_fields(keyed(t("supplier"), "s_suppkey"), ["s_name", "s_acctbal"])
    own = shape.process(shape.process(own, "s_name", F.upper), "s_acctbal", lambda c: F.round(c * 100, 0))
    return shape.add_fields(own, {"size": F.length("s_name").cast("long")}).df


@query("SELECT o_custkey, min(o_orderkey) AS first_order, count(*) AS n FROM orders GROUP BY 1")
def q06_to_list_flat(t):
    own = order_lists(t)
    first = shape.to_list(own).df.select("o_custkey", F.col("o_orderkey").alias("first_order"))
    flat = shape.to_flat(shape.slice_fields(own, ["o_orderkey"])).df.select("o_custkey", F.size("values").cast("long").alias("n"))
    return first.join(flat, "o_custkey")


@query("SELECT o_custkey, bool_or(o_orderstatus = 'F') AS \"F\", bool_or(o_orderstatus = 'O') AS \"O\", bool_or(o_orderstatus = 'P') AS \"P\" FROM orders GROUP BY 1")
def q07_one_hot(t):
    return shape.one_hot(order_lists(t), "o_orderstatus", ["F", "O", "P"]).df


_NATIONS = range(25)


@query("SELECT field, " + ", ".join(f'max(CASE WHEN n_nationkey = {n} THEN v END) AS "{n}"' for n in _NATIONS) + " FROM (SELECT 'n_name' AS field, n_nationkey, n_name AS v FROM nation UNION ALL SELECT 'n_regionkey', n_nationkey, n_regionkey::VARCHAR FROM nation) GROUP BY field")
def q08_transpose(t):
    own = t("nation").withColumn("n_regionkey", F.col("n_regionkey").cast("string"))
    return shape.transpose(keyed(own, "n_nationkey", ["n_name", "n_regionkey"]), list(_NATIONS)).df


@query("SELECT p_partkey, 'p_size' AS variable, p_size::DOUBLE AS value FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part")
def q09_melt(t):
    own = t("part").withColumn("p_size", F.col("p_size").cast("double"))
    return shape.melt(keyed(own, "p_partkey", ["p_size", "p_retailprice"]))


@query("SELECT o_custkey || '(' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) || ')' AS o_custkey, o_orderkey, o_orderstatus FROM orders")
def q10_unzip_replicates(t):
    return shape.unzip_replicates(shape.slice_fields(order_lists(t), ["o_orderkey", "o_orderstatus"])).df


@query("SELECT o_custkey || ':' || o_orderstatus AS o_custkey, string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey, o_orderstatus")
def q11_unzip(t):
    own = shape.unzip(shape.slice_fields(order_lists(t), ["o_orderkey", "o_orderstatus"]), "o_orderstatus")
    return own.df.select("o_custkey", *joined("o_orderkey"))


@query("SELECT l_orderkey, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linestatus FROM lineitem) GROUP BY 1")
def q12_remove_duplicates(t):
    own = load.merge(t("lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"], ["l_linenumber", "l_returnflag", "l_linestatus"])
    return shape.remove_duplicates(own).df.select("l_orderkey", F.size("l_returnflag").cast("long").alias("n"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus = 'F')")
def q13_select_values(t):
    return filters.select(order_lists(t), {"o_orderstatus": ["F"]}).df.select("o_custkey", F.size("o_orderkey").cast("long").alias("n"))


@query("SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '^red|blue')")
def q14_select_regexp(t):
    return filters.select(keyed(t("part"), "p_partkey", ["p_name"]), {"p_name": re.compile("^red|blue")}).df


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING arg_min(o_totalprice, o_orderkey) >= 300000")
def q15_select_compare(t):
    return filters.select(order_lists(t), {"o_totalprice": ">=300000"}).df.select("o_custkey")


@query("SELECT o_custkey, count(*) >= 15 AS many FROM orders GROUP BY 1")
def q16_select_cardinality(t):
    own = order_lists(t)
    yes, no = (filters.select(own, {"o_orderkey": 15}, invert=i).df.select("o_custkey", F.lit(not i).alias("many")) for i in (False, True))
    return yes.unionByName(no)


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS has_orders FROM customer")
def q17_subset(t):
    keys = t("orders").select("o_custkey")
    yes, no = (filters.subset(customers(t), keys, i).df.select("c_custkey", F.lit(not i).alias("has_orders")) for i in (False, True))
    return yes.unionByName(no)


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT regexp_matches(c_mktsegment, 'BUILDING') AND c_acctbal >= 0 AND c_nationkey IN (1, 2, 3)")
def q18_filter_stack(t):
    stack = filters.FilterStack(customers(t)).add("c_mktsegment", "!/BUILDING/").add("c_acctbal", ">=0").add("c_nationkey", ["1", "2", "3"])
    return stack.rows().df.select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey FROM part WHERE p_brand IN ('Brand#1', 'Brand#2') AND p_type IN ('ECONOMY', 'STANDARD')")
def q19_field_index_select(t):
    """By an index that is written once, of which the lookup reads the folders
    of the values it asks for."""
    path = f"{shared_dir(t('part').sparkSession)}/index-{uuid.uuid4().hex}"
    indices.write_field_index(keyed(t("part"), "p_partkey", ["p_brand", "p_type"]), path, buckets=16)
    return indices.FieldIndex(t("part").sparkSession, path).select({"p_brand": ["Brand#1", "Brand#2"], "p_type": ["ECONOMY", "STANDARD"]})


@query(f"SELECT c_custkey, c_name, n_orders, total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, {SUM.format('o_totalprice')} AS total FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def q20_attach_same_key(t):
    totals = agg.reduce_by(t("orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey", n_orders=F.count(F.lit(1)), total=exact_sum("o_totalprice"))
    return joins.attach(keyed(t("customer"), "c_custkey", ["c_name"]), totals).df


@query("SELECT l_orderkey, string_agg(n_name, '|' ORDER BY l_suppkey) AS n_name FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def q21_attach_source_key(t):
    pairs = t("lineitem").select("l_orderkey", "l_suppkey").distinct()
    own = load.merge(pairs.withColumn("s_suppkey", F.col("l_suppkey")), "l_orderkey", ["s_suppkey"], ["l_suppkey"])
    named = joins.attach(keyed(t("supplier").withColumnRenamed("s_nationkey", "n_nationkey"), "s_suppkey", ["n_nationkey"]), keyed(t("nation"), "n_nationkey", ["n_name"]))
    return joins.attach(own, named, ["n_name"]).df.select("l_orderkey", *joined("n_name"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, r_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def q22_attach_path(t):
    steps = [
        (keyed(t("orders"), "o_orderkey", ["o_custkey"]), "l_orderkey"),
        (keyed(t("customer"), "c_custkey", ["c_nationkey"]), "o_custkey"),
        (keyed(t("nation"), "n_nationkey", ["n_regionkey"]), "c_nationkey"),
        (keyed(t("region"), "r_regionkey", ["r_name"]), "n_regionkey"),
    ]
    return joins.attach_steps(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), steps).select("l_orderkey", "l_linenumber", "l_partkey", "r_name")


@query("SELECT coalesce(c_nationkey, s_nationkey) AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1) FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1) ON c_nationkey = s_nationkey")
def q23_attach_complete(t):
    a = agg.reduce_by(t("customer").withColumnRenamed("c_nationkey", "nation"), "nation", customers=F.count(F.lit(1)))
    b = agg.reduce_by(t("supplier").withColumnRenamed("s_nationkey", "nation"), "nation", suppliers=F.count(F.lit(1)))
    rows = joins.attach(a, b, complete=True).df
    return rows.select("nation", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("customers", "suppliers")))


@query("SELECT s_suppkey, p AS l_partkey FROM supplier LEFT JOIN (SELECT l_suppkey, min(l_partkey) AS p FROM lineitem GROUP BY 1) ON s_suppkey = l_suppkey")
def q24_attach_one2one(t):
    parts = load.merge(t("lineitem").select(F.col("l_suppkey").alias("s_suppkey"), "l_partkey").distinct(), "s_suppkey", ["l_partkey"], ["l_partkey"])
    return joins.attach(keyed(t("supplier"), "s_suppkey", []), parts, one2one=True).df


def _pasted(t, all_match):
    parts = [
        agg.reduce_by(t("customer").withColumnRenamed("c_nationkey", "k").where("c_acctbal > 9000"), "k", a=F.count(F.lit(1))),
        agg.reduce_by(t("supplier").withColumnRenamed("s_nationkey", "k").where("s_acctbal > 5000"), "k", b=F.count(F.lit(1))),
        agg.reduce_by(t("nation").withColumnRenamed("n_nationkey", "k").where("n_regionkey < 3"), "k", c=F.max("n_name")),
    ]
    return joins.paste(parts, all_match, "").df


_PASTE = "SELECT k, coalesce(a::VARCHAR, '') AS a, coalesce(b::VARCHAR, '') AS b, coalesce(c, '') AS c FROM (SELECT c_nationkey AS k, count(*) AS a FROM customer WHERE c_acctbal > 9000 GROUP BY 1) {0} JOIN (SELECT s_nationkey AS k, count(*) AS b FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) USING (k) {0} JOIN (SELECT n_nationkey AS k, n_name AS c FROM nation WHERE n_regionkey < 3) USING (k)"


@query(_PASTE.format("FULL"))
def q25_paste_streams(t):
    return _pasted(t, False)


@query(_PASTE.format("INNER"))
def q26_paste_all_match(t):
    return _pasted(t, True)


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0")
def q27_translate(t):
    index = t("nation").where("n_regionkey <> 0").select("n_nationkey", "n_name")
    return joins.translate(keyed(t("customer"), "c_custkey", ["c_nationkey"]), "c_nationkey", index, "n_name", compact=True).df


@query("SELECT e.event_id, p.event_id AS b_id FROM events e JOIN events p ON p.event_type = 'purchase' AND e.ts BETWEEN p.ts AND p.ts + INTERVAL 1 HOUR")
def q28_points_in_ranges(t):
    points = t("events").select("event_id", micros("ts").alias("pos"))
    # Bins of a quarter of the intervals' length: a point meets little more than what holds it.
    return intervals.points_in(points, purchases(t), [], 900_000_000, longest=3_600_000_000).select("event_id", "b_id")


@query("SELECT a.event_id AS a_id, b.event_id AS b_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.ts <= b.ts + INTERVAL 10 MINUTE AND b.ts <= a.ts + INTERVAL 10 MINUTE WHERE a.event_type = 'error' AND b.event_type = 'purchase'")
def q29_interval_pairs(t):
    e = t("events").withColumn("at", micros("ts"))
    side = lambda p, kind: e.where(F.col("event_type") == kind).select("user_id", F.col("event_id").alias(f"{p}_id"), F.col("at").alias(f"{p}_start"), (F.col("at") + 600_000_000).alias(f"{p}_end"))
    return intervals.overlaps(side("a", "error"), side("b", "purchase"), ["user_id"], 600_000_000, longest=600_000_000).select("a_id", "b_id")


_ASKED = "(SELECT event_id, user_id, ts FROM events UNION ALL SELECT -1 - event_id, NULL, ts FROM events WHERE event_type = 'error' UNION ALL SELECT -1 - event_id, user_id, NULL FROM events WHERE event_type = 'click')"


@query(f"SELECT e.event_id, max(p.event_id) AS purchase FROM {_ASKED} e LEFT JOIN LATERAL (SELECT event_id FROM events p WHERE p.event_type = 'purchase' AND p.user_id = e.user_id AND p.ts < e.ts ORDER BY p.ts DESC, p.event_id DESC LIMIT 1) p ON true GROUP BY e.event_id")
def q30_as_of(t):
    """Besides all events, some without a user and some without a time."""
    e = t("events").select("event_id", "event_type", "user_id", micros("ts").alias("at"))
    less = lambda kind, user, at: e.where(F.col("event_type") == kind).select((-1 - F.col("event_id")).alias("event_id"), user.alias("user_id"), at.alias("at"))
    nothing = F.lit(None).cast("long")
    asked = e.drop("event_type").unionByName(less("error", nothing, F.col("at"))).unionByName(less("click", F.col("user_id"), nothing))
    right = e.where("event_type = 'purchase'").select("user_id", "at", F.col("event_id").alias("purchase"))
    return intervals.as_of(asked, right, "user_id", "at", ["purchase"], 86_400_000_000, strict=True).select("event_id", F.col("_hit.purchase").alias("purchase"))


@query("SELECT date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::BIGINT AS pos, o_orderkey FROM orders WHERE date_diff('day', DATE '1970-01-01', o_orderdate::DATE) IN (9000, 9500, 10000)")
def q31_point_lookup(t):
    """Keys at positions, by an index of the positions."""
    day = F.unix_date(F.to_date("o_orderdate")).cast("long")
    index = t("orders").select("o_orderkey", day.alias("b_start"), day.alias("b_end"))
    points = t("orders").sparkSession.createDataFrame([(9000,), (9500,), (10000,)], "pos long")
    return intervals.points_in(points, index, [], 32, longest=0).select("pos", "o_orderkey")


@query(f"SELECT l_partkey, {SUM.format('l_quantity')} AS quantity FROM lineitem GROUP BY 1")
def q32_collapse_sum(t):
    return agg.reduce_by(t("lineitem"), "l_partkey", quantity=exact_sum("l_quantity")).df


@query("SELECT value, min(p_partkey) AS p_partkey FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS value FROM part) GROUP BY 1")
def q33_value_index(t):
    return agg.value_index(KeyedFrame(t("part").select("p_partkey", F.split("p_name", " ").alias("word")), "p_partkey", ["word"], "double"))


@query("SELECT field, count(DISTINCT value) AS n FROM (SELECT 'p_partkey' AS field, p_partkey::VARCHAR AS value FROM part UNION ALL SELECT 'p_brand', p_brand FROM part UNION ALL SELECT 'p_type', p_type FROM part UNION ALL SELECT 'p_size', p_size::VARCHAR FROM part) WHERE value IN ('Brand#1', 'Brand#2', 'ECONOMY', '7', '11') GROUP BY field")
def q34_field_match(t):
    spark = t("part").sparkSession
    wanted = spark.createDataFrame([(x,) for x in ("Brand#1", "Brand#2", "ECONOMY", "7", "11")], "value string")
    return agg.field_matches(keyed(t("part"), "p_partkey", ["p_brand", "p_type", "p_size"]), wanted)


@query("SELECT event_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events), 9) AS share FROM events GROUP BY 1")
def q35_counts(t):
    return agg.counts(t("events"), "event_type").withColumn("share", F.round("share", 9))


@query("SELECT string_split(p_name, ' ')[1] AS word, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def q36_first_word_key(t):
    words = t("part").select("p_partkey", F.substring_index("p_name", " ", 1).alias("word"))
    return agg.value_index(keyed(words, "p_partkey", ["word"])).withColumnRenamed("value", "word")


@query("SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal::DECIMAL(20,4))::DOUBLE, 2) AS total, round(avg(c_acctbal), 4) AS mean, round(median(c_acctbal), 4) AS median, round(CASE WHEN count(*) >= 3 THEN var_samp(c_acctbal) END, 1) AS variance, round(CASE WHEN count(*) >= 3 THEN stddev_samp(c_acctbal) END, 4) AS sd, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY 1")
def q37_statistics(t):
    return agg.statistics(t("customer"), "c_nationkey", "c_acctbal").withColumns({"total": F.round("total", 2), "variance": F.round("variance", 1), **{c: F.round(c, 4) for c in ("mean", "median", "sd")}})


def _activity(t):
    return t("events").select("user_id", micros("ts").alias("start"), (micros("ts") + 600_000_000).alias("end"))


_ISLANDS = "WITH r AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + 600000000 AS e FROM events), o AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS brk FROM r), i AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS n FROM o), c AS (SELECT user_id, min(s) AS \"start\", max(e) AS \"end\" FROM i GROUP BY user_id, n) "


@query(_ISLANDS + 'SELECT user_id, "start", "end" FROM c')
def q38_collapse_ranges(t):
    return intervals.collapse(_activity(t), ["user_id"], width=86_400_000_000)


@query(_ISLANDS + 'SELECT user_id, sum("end" - "start" + 1)::BIGINT AS total_length FROM c GROUP BY 1')
def q38b_total_length(t):
    return intervals.total_length(_activity(t), ["user_id"], width=86_400_000_000)


@query("SELECT c_mktsegment, max((o_orderstatus = 'F')::INT) AS \"F\", max((o_orderstatus = 'O')::INT) AS \"O\", max((o_orderstatus = 'P')::INT) AS \"P\" FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def q39_incidence(t):
    rows = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"))
    return agg.incidence(rows, "c_mktsegment", "o_orderstatus", ["F", "O", "P"])


@query("SELECT l_suppkey AS source, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey) AS targets FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) GROUP BY 1")
def q40_adjacency(t):
    return assoc.adjacency(assoc.edges(t("lineitem"), "l_suppkey", "l_partkey"))


_LOG_CHOOSE = "(lgamma({0} + 1.0) - lgamma({1} + 1.0) - lgamma({0} - {1} + 1.0))"


@query(
    "WITH p AS (SELECT DISTINCT p_partkey, p_brand FROM part), c AS (SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 48), "
    "n AS (SELECT p_brand, count(*) AS good, count(l_partkey) AS k, (SELECT count(*) FROM p) AS total, (SELECT count(*) FROM p JOIN c ON p_partkey = l_partkey) AS drawn FROM p LEFT JOIN c ON p_partkey = l_partkey GROUP BY 1) "
    f"SELECT *, round(least(1.0, list_sum(list_transform(range(k, least(good, drawn) + 1), lambda i: exp({_LOG_CHOOSE.format('good', 'i')} + {_LOG_CHOOSE.format('(total - good)', '(drawn - i)')} - {_LOG_CHOOSE.format('total', 'drawn')})))), 6) AS p_value FROM n"
)
def q41_enrichment(t):
    chosen = t("lineitem").where("l_returnflag = 'R' and l_quantity >= 48").select(F.col("l_partkey").alias("p_partkey"))
    return agg.enrichment(t("part"), "p_partkey", "p_brand", chosen).withColumn("p_value", F.round("p_value", 6))


@query("SELECT click, purchase, \"view\", count(*) AS n FROM (SELECT user_id, max((event_type = 'click')::INT) AS click, max((event_type = 'purchase')::INT) AS purchase, max((event_type = 'view')::INT) AS \"view\" FROM events GROUP BY 1) WHERE click + purchase + \"view\" > 0 GROUP BY ALL")
def q42_venn(t):
    return agg.memberships(t("events"), "user_id", "event_type", ["click", "purchase", "view"])


@query("WITH s AS (SELECT DISTINCT p_brand, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey), a AS (SELECT l_suppkey FROM s WHERE p_brand = 'Brand#1'), b AS (SELECT l_suppkey FROM s WHERE p_brand = 'Brand#2') SELECT (SELECT count(*) FROM a WHERE l_suppkey IN (FROM b)) AS common, (SELECT count(*) FROM a WHERE l_suppkey NOT IN (FROM b)) AS only_first, (SELECT count(*) FROM b WHERE l_suppkey NOT IN (FROM a)) AS only_second")
def q43_compare_lists(t):
    """The suppliers of two brands, over all lines."""
    sold = lambda brand: t("lineitem").join(t("part").where(F.col("p_brand") == brand), F.col("p_partkey") == F.col("l_partkey"))
    return agg.compare(sold("Brand#1"), sold("Brand#2"), "l_suppkey")


@query("SELECT p_partkey, p_name, p_type, round(row_number() OVER (ORDER BY p_retailprice, p_partkey) / (SELECT count(*) FROM part), 9) AS rank FROM part")
def q44_ranks(t):
    return agg.rank_fraction(t("part"), "p_retailprice", "p_partkey").select("p_partkey", "p_name", "p_type", F.round("rank", 9).alias("rank"))


@query("SELECT c_custkey, round((c_acctbal - m) / s, 6) AS z, round((c_acctbal - lo) / (hi - lo), 6) AS unit FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)")
def q45_scaled(t):
    return agg.scaled(t("customer").select("c_custkey", "c_acctbal"), "c_acctbal").select("c_custkey", F.round("z", 6).alias("z"), F.round("unit", 6).alias("unit"))


@query("SELECT p_partkey, p_name, p_type, (n % 7)::BIGINT AS robin, (n // 7)::BIGINT AS block FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part)")
def q46_chunks(t):
    return agg.chunks(t("part").select("p_partkey", "p_name", "p_type"), ["p_partkey"], 7)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 25 OFFSET 25")
def q47_page(t):
    return ranks.page(t("customer").select("c_custkey", "c_acctbal"), 2, 25, ["c_acctbal", "c_custkey"])


@query("WITH r AS (SELECT event_id, user_id, epoch_us(ts) AS s, epoch_us(ts) + 600000000 AS e FROM events) SELECT a.event_id, count(b.event_id) AS depth FROM r a LEFT JOIN r b ON a.user_id = b.user_id AND b.s < a.s AND b.e >= a.s GROUP BY 1")
def q48_overlap_depth(t):
    rows = t("events").select("event_id", "user_id", micros("ts").alias("start"), (micros("ts") + 600_000_000).alias("end"))
    return intervals.depth(rows, ["user_id"], width=86_400_000_000).select("event_id", "depth")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 20")
def q49_sort_abs(t):
    return ranks.sort_by(keyed(t("customer"), "c_custkey", ["c_acctbal"]), "c_acctbal", descending=True, absolute=True).limit(20)


@query("WITH a AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 5000), b AS (SELECT o_custkey AS k FROM orders WHERE o_totalprice > 300000) SELECT 'union' AS op, k FROM (FROM a UNION FROM b) UNION ALL SELECT 'intersect', k FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'except', k FROM (FROM a EXCEPT FROM b)")
def q50_set_ops(t):
    a, b = t("customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("k")), t("orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("k"))
    parts = {"union": ranks.union(a, b), "intersect": ranks.intersection(a, b), "except": ranks.difference(a, b)}
    tagged = [d.select(F.lit(n).alias("op"), "k") for n, d in parts.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


_EDGE = "(SELECT o_custkey AS source, l_suppkey AS target, string_agg(l_returnflag, ';;' ORDER BY l_orderkey, l_linenumber, l_partkey, l_returnflag) AS l_returnflag FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2)"


def _edges(t):
    rows = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return assoc.edges(rows, "o_custkey", "l_suppkey", ["l_returnflag"], ["l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"])


@query(f"SELECT source || '~' || target AS pair, l_returnflag FROM {_EDGE}")
def q51_edges(t):
    return _edges(t).select(assoc.pair_key(F.col("source"), F.col("target")).alias("pair"), "l_returnflag")


_PLAIN = "(SELECT DISTINCT o_custkey AS source, l_suppkey AS target FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@query(f"SELECT source, target FROM {_PLAIN} WHERE source IN (5, 17) UNION SELECT target, source FROM {_PLAIN} WHERE target IN (5, 17)")
def q52_neighbours(t):
    nodes = t("orders").sparkSession.createDataFrame([(5,), (17,)], "id long")
    return assoc.neighbours(_edges(t).select("source", "target"), nodes)


@query(f"SELECT source, target FROM {_PLAIN} UNION SELECT target, source FROM {_PLAIN}")
def q53_undirected(t):
    return assoc.undirected(_edges(t).select("source", "target"))


_C, _O, _P = Var("c"), Var("o"), Var("p")


def _kb(t):
    kb = assoc.KnowledgeBase()
    kb.register("placed", lambda: assoc.edges(t("orders"), "o_custkey", "o_orderkey"))
    kb.register("contains", lambda: t("lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("flag")).distinct())
    names = t("customer").select("c_name", "c_custkey")
    return kb.register("buys", lambda: _edges(t), source_ids=names)


@query(f"SELECT source, target FROM {_PLAIN} WHERE source IN (5, 17, 23) AND target < 50")
def q54_kb_subset(t):
    named = t("customer").where("c_custkey in (5, 17, 23)").select("c_name")
    targets = t("supplier").where("s_suppkey < 50").select("s_suppkey")
    return _kb(t).subset("buys", named, targets).select("source", "target")


@query("SELECT DISTINCT o_custkey AS c, o_orderkey AS o, l_partkey AS p FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'")
def q55_path_rules(t):
    return traverse(_kb(t), [Rule(_C, "placed", _O), Rule(_O, "contains", _P, {"flag": "R"})])


@query("SELECT DISTINCT o_custkey AS c, o_orderkey AS o FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def q56_path_block(t):
    return traverse(_kb(t), [Rule(_C, "placed", _O), Only(_O, (Rule(_O, "contains", _P, {"flag": "R"}),))])


_SPANS = {"1h 30m": 5400, "-2d": -172800, "1:02:03": 3723, "3w": 1814400, "2mo": 5356800, "45": 45, "5'30''": 330}


@query(
    "SELECT * FROM (VALUES " + ", ".join("('{}', {})".format(k.replace("'", "''"), v) for k, v in _SPANS.items()) + ") v(span, seconds) "
    "UNION ALL SELECT p_size || 'h ' || (p_partkey % 60) || 'min', (p_size * 3600 + (p_partkey % 60) * 60)::INT FROM part "
    "UNION ALL SELECT '-' || p_size || ':' || lpad((p_partkey % 60)::VARCHAR, 2, '0') || ':07', (-(p_size * 3600 + (p_partkey % 60) * 60 + 7))::INT FROM part"
)
def q57_timespan(t):
    """Spans as they are written, and two made from each part's size and key."""
    said = t("part").sparkSession.createDataFrame([(x,) for x in _SPANS], "span string")
    minutes = F.col("p_partkey") % 60
    plain = t("part").select(F.concat(F.col("p_size").cast("string"), F.lit("h "), minutes.cast("string"), F.lit("min")).alias("span"))
    clock = t("part").select(F.concat(F.lit("-"), F.col("p_size").cast("string"), F.lit(":"), F.lpad(minutes.cast("string"), 2, "0"), F.lit(":07")).alias("span"))
    return said.unionByName(plain).unionByName(clock).select("span", text.timespan(F.col("span")).cast("int").alias("seconds"))


@query("SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1)) AS host, md5(replace(replace(url, '/', '·'), '~', '-')) AS digest, coalesce(regexp_extract(url || '&', '[?&]id=([^&#]*)', 1), '') AS id, len(regexp_extract_all(regexp_extract(url, '[?]([^#]*)', 1), '[^&]+'))::INT AS n_params FROM pages")
def q58_text_functions(t):
    return t("pages").select("page_id", text.url_host(F.col("url")).alias("host"), F.md5(text.safe_name(F.col("url"), 100000)).alias("digest"), F.coalesce(F.element_at(text.query_map(F.col("url")), "id"), F.lit("")).alias("id"), F.size(text.query_map(F.col("url"))).alias("n_params"))


_HGVS = {"p.Gly12Asp": "G12D", "p.Ser45ProfsTer9": "S45P", "p.Ile7del": "I7Indel", "p.Tyr88Ter": "Y88*", "g.9C>T": None, "p.C77_D79>Q": "C77Indel", "p.*301fs": "*301Frameshift", "p.H19?": "H19?", "p.L4_L5insWW": "L4Indel", "p.Met1fs": "M1Frameshift", "p.=": None}
_LONG, _SHORT = list(sequence.AMINO), list(sequence.AMINO.values())
_SQL_LIST = lambda x: "[" + ", ".join(f"'{v}'" for v in x) + "]"


@query(
    "SELECT * FROM (VALUES " + ", ".join(f"('{k}', {'NULL' if v is None else repr(v)})" for k, v in _HGVS.items()) + ") v(hgvs, short) "
    f"UNION ALL SELECT 'p.' || {_SQL_LIST(_LONG)}[p_size % 21 + 1] || p_partkey || {_SQL_LIST(_LONG)}[p_partkey % 21 + 1], {_SQL_LIST(_SHORT)}[p_size % 21 + 1] || p_partkey || {_SQL_LIST(_SHORT)}[p_partkey % 21 + 1] FROM part "
    f"UNION ALL SELECT 'p.' || {_SQL_LIST(_SHORT)}[p_size % 21 + 1] || p_partkey || 'fs*' || p_size, {_SQL_LIST(_SHORT)}[p_size % 21 + 1] || p_partkey || 'Frameshift' FROM part"
)
def q59_hgvs(t):
    """Changes as they are written, and two made from each part's size and key."""
    said = t("part").sparkSession.createDataFrame([(x,) for x in _HGVS], "hgvs string")
    name = lambda names, c: F.get(F.array(*map(F.lit, names)), (F.col(c) % 21).cast("int"))
    at = F.col("p_partkey").cast("string")
    swapped = t("part").select(F.concat(F.lit("p."), name(_LONG, "p_size"), at, name(_LONG, "p_partkey")).alias("hgvs"))
    shifted = t("part").select(F.concat(F.lit("p."), name(_SHORT, "p_size"), at, F.lit("fs*"), F.col("p_size").cast("string")).alias("hgvs"))
    return said.unionByName(swapped).unionByName(shifted).select("hgvs", sequence.protein_change(F.col("hgvs")).alias("short"))


#: A strand for each customer: the digits of its name and balance as bases.
_STRAND = "translate(regexp_replace(c_name || c_acctbal::VARCHAR, '[^0-9]', '', 'g'), '0123456789', 'ACGTACGTAC')"
_CODON = "16 * (instr('TCAG', substr(dna, i, 1)) - 1) + 4 * (instr('TCAG', substr(dna, i + 1, 1)) - 1) + instr('TCAG', substr(dna, i + 2, 1))"


@query(
    "SELECT * FROM (VALUES ('ATGGCC', 'MA', 'GGCCAT'), ('TAAnnn', '*X', 'nnnTTA'), ('AUGA', 'M', 'TCAT')) v(dna, protein, opposite) UNION ALL "
    f"SELECT dna, array_to_string(list_transform(range(1, length(dna) - 1, 3), lambda i: substr('{sequence.CODE}', ({_CODON})::BIGINT, 1)), ''), translate(reverse(dna), 'ACGT', 'TGCA') FROM (SELECT {_STRAND} AS dna FROM customer)"
)
def q60_codons(t):
    said = t("customer").sparkSession.createDataFrame([(x,) for x in ("ATGGCC", "TAAnnn", "AUGA")], "dna string")
    own = t("customer").select(F.translate(F.regexp_replace(F.concat(F.col("c_name"), F.col("c_acctbal").cast("string")), "[^0-9]", ""), "0123456789", "ACGTACGTAC").alias("dna"))
    rows = said.unionByName(own)
    return rows.select("dna", sequence.translate_codons(F.col("dna")).alias("protein"), sequence.reverse_complement(F.col("dna")).alias("opposite"))


#: A mutation for each part: a new base, inserted bases or deleted ones.
_MUTATION = "'chr' || ['1', '2', '10', 'X', 'Y', 'MT'][p_size % 6 + 1] || ':' || p_partkey || ':' || CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN '+' || repeat('T', p_size) ELSE repeat('-', p_size + 1) END"


def mutations(t) -> DataFrame:
    names = F.array(*map(F.lit, ("1", "2", "10", "X", "Y", "MT")))
    which = F.col("p_partkey") % 3
    allele = F.when(which == 0, "A").when(which == 1, F.concat(F.lit("+"), F.repeat(F.lit("T"), F.col("p_size")))).otherwise(F.repeat(F.lit("-"), F.col("p_size") + 1))
    return t("part").select(F.concat(F.lit("chr"), F.get(names, (F.col("p_size") % 6).cast("int")), F.lit(":"), F.col("p_partkey").cast("string"), F.lit(":"), allele).alias("m"))


@query(
    f"SELECT m, split_part(m, ':', 1)[4:] AS chr, split_part(m, ':', 2)::BIGINT - 1 AS \"start\", split_part(m, ':', 2)::BIGINT - 1 + CASE substr(split_part(m, ':', 3), 1, 1) WHEN '-' THEN length(split_part(m, ':', 3)) - 1 ELSE length(split_part(m, ':', 3)) END AS \"end\", "
    f"CASE split_part(m, ':', 1)[4:] WHEN 'X' THEN 23 WHEN 'Y' THEN 22 WHEN 'MT' THEN 24 ELSE try_cast(split_part(m, ':', 1)[4:] AS INT) END AS rank FROM (SELECT {_MUTATION} AS m FROM part)"
)
def q62_mutations_bed(t):
    bed = sequence.mutation_bed(F.col("m"))
    return mutations(t).select("m", bed["chr"].alias("chr"), bed["start"].alias("start"), bed["end"].alias("end"), sequence.chromosome_rank(bed["chr"]).alias("rank"))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#00000001%'")
def q63_prefix_scan(t):
    return tasks.prefix_scan(t("customer"), "c_name", "Customer#00000001").select("c_custkey", "c_name")


@query("SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept, count(*) AS n FROM lineitem GROUP BY 1")
def q64_model(t):
    return agg.regressions(t("lineitem"), "l_suppkey", "l_extendedprice", "l_quantity").withColumns({"slope": F.round("slope", 3), "intercept": F.round("intercept", 2)})


@query("SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[0-9]{3}') GROUP BY 1")
def q66_grep_lines(t):
    lines = t("documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("value"))
    return filters.grep(lines, ["[0-9]{3}"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_partkey, string_agg(l_quantity::INT::VARCHAR, '|' ORDER BY l_orderkey, l_linenumber, l_suppkey, l_quantity) AS q FROM lineitem GROUP BY 1")
def q67_collapse(t):
    rows = t("lineitem").withColumn("q", F.col("l_quantity").cast("int"))
    return agg.collapse(rows, "l_partkey", ["q"], ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity"]).df


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(b.v, a.v) AS v FROM (SELECT c_nationkey AS k, max(c_name) AS v FROM customer GROUP BY 1) a FULL JOIN (SELECT n_nationkey AS k, n_name AS v FROM nation WHERE n_regionkey = 1) b ON a.k = b.k")
def q68_union_keys(t):
    a = agg.reduce_by(t("customer").withColumnRenamed("c_nationkey", "k"), "k", v=F.max("c_name"))
    b = keyed(t("nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), "k")
    return joins.union_keys(a, b).df


@query("WITH s AS (SELECT DISTINCT p_brand, l_suppkey FROM lineitem JOIN part ON p_partkey = l_partkey), a AS (SELECT l_suppkey FROM s WHERE p_brand = 'Brand#12'), b AS (SELECT l_suppkey FROM s WHERE p_brand = 'Brand#23') SELECT (SELECT count(*) FROM a WHERE l_suppkey IN (FROM b)) AS common, (SELECT count(*) FROM a WHERE l_suppkey NOT IN (FROM b)) AS only_first, (SELECT count(*) FROM b WHERE l_suppkey NOT IN (FROM a)) AS only_second")
def q69_compare_brands(t):
    sold = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).select("p_brand", "l_suppkey")
    return agg.compare(sold.where("p_brand = 'Brand#12'"), sold.where("p_brand = 'Brand#23'"), "l_suppkey")


@query("SELECT c_mktsegment AS segment, " + ", ".join(f'sum(CASE WHEN c_nationkey = {n} THEN 1 ELSE 0 END)::BIGINT AS "{n}"' for n in range(25)) + " FROM customer GROUP BY 1")
def q70_transpose_segments(t):
    segments = [r[0] for r in t("customer").select("c_mktsegment").distinct().orderBy("c_mktsegment").collect()]
    nations = [r[0] for r in t("nation").select("n_nationkey").orderBy("n_nationkey").collect()]
    counts = t("nation").select("n_nationkey").join(t("customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).pivot("c_mktsegment", segments).count(), "n_nationkey", "left").fillna(0)
    return shape.transpose(keyed(counts, "n_nationkey", segments), nations, "segment").df


import keyloom.more_queries  # noqa: E402, F401  (registers more)
import keyloom.stored_queries  # noqa: E402, F401
import keyloom.small_queries  # noqa: E402, F401  (registers the rest)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
