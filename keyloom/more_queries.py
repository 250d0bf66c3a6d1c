"""Further queries of the catalogue: shapes, joins, lists, ranks, associations,
notation, models and stored tables, each with the same in SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.frame import keyed
from keyloom.functions import sequence, text
from keyloom.operators import aggregates as agg
from keyloom.operators import density, filters, intervals, joins, load, ranks, shape
from keyloom.plans import associations as assoc
from keyloom.plans import entities, indices, tasks
from keyloom.plans.rules import Rule, Var, assignments, paths
from keyloom.queries import _MUTATION, customers, exact_sum, joined, micros, mutations, order_lists, query
from keyloom.sources import text as source
from keyloom.storage import shared_dir
from keyloom.streaming import tables as streams

_STATUS = "string_agg(o_orderstatus, '|' ORDER BY o_orderkey)"


def scratch(t, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(t('region').sparkSession)}/{tag}-{uuid.uuid4().hex}"


# Shapes ------------------------------------------------------------------------


@query("SELECT c_nationkey, arg_max(c_name, c_custkey) AS c_name FROM customer GROUP BY 1")
def q71_process_key(t):
    """Customers under their nation: the last of those that meet stays."""
    nation = t("customer").select("c_custkey", "c_name", F.col("c_nationkey").alias("_n"))
    own = keyed(nation.select(F.struct("c_custkey", "_n").alias("id"), "c_name"), "id")
    return shape.process_key(own, lambda c: c["_n"]).df.select(F.col("id").alias("c_nationkey"), "c_name")


@query("SELECT p_partkey || '~' || f AS pair, v AS value, p_brand, p_partkey, f AS field FROM (SELECT p_partkey, p_brand, 'p_size' AS f, p_size::DOUBLE AS v FROM part UNION ALL SELECT p_partkey, p_brand, 'p_retailprice', p_retailprice FROM part)")
def q72_matrix_melt(t):
    own = keyed(t("part").withColumn("p_size", F.col("p_size").cast("double")), "p_partkey", ["p_brand", "p_size", "p_retailprice"])
    return shape.matrix_melt(own, "field", "value", ["p_brand"]).df.withColumnRenamed("p_partkey~field", "pair")


@query("SELECT s_suppkey, 's_name|s_acctbal' AS fields, s_name || '|' || s_acctbal::VARCHAR AS cells FROM supplier")
def q73_read_matrix(t):
    own = keyed(t("supplier").select("s_suppkey", "s_name", F.col("s_acctbal").cast("string").alias("s_acctbal")), "s_suppkey")
    return shape.read_matrix(own, "fields", "cells").df.select("s_suppkey", *joined("fields", "cells"))


@query("SELECT o_custkey || ':' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS \"ID\", o_custkey, o_orderkey FROM orders")
def q74_melt_records(t):
    return shape.melt_records(shape.slice_fields(order_lists(t), ["o_orderkey"]))


@query("SELECT k, string_agg(v, '|' ORDER BY turn, v) AS v FROM (SELECT n_nationkey AS k, 0 AS turn, n_name AS v FROM nation UNION ALL SELECT c_nationkey, 1, max(c_name) FROM customer GROUP BY c_nationkey) GROUP BY k")
def q75_merge_zip(t):
    a = keyed(t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), "k")
    new = t("customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.max("c_name").alias("v"))
    return shape.zip_new(shape.to_double(a), new).df.select("k", *joined("v"))


@query("SELECT o_custkey, string_agg('order,' || o_orderkey || ',' || o_orderstatus, '|' ORDER BY o_orderkey) AS zipped FROM orders GROUP BY 1")
def q76_zip_fields(t):
    own = order_lists(t).df
    zipped = shape.zip_fields([F.array(F.lit("order")), F.transform("o_orderkey", lambda x: x.cast("string")), F.col("o_orderstatus")])
    return own.select("o_custkey", F.array_join(F.transform(zipped, lambda x: F.array_join(x, ",")), "|").alias("zipped"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END::DOUBLE AS rich, c_nationkey::DOUBLE AS nation, NULL::DOUBLE AS segment FROM customer")
def q77_logical_matrix(t):
    own = t("customer").select("c_custkey", (F.col("c_acctbal") > 0).alias("rich"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return shape.logical_matrix(keyed(own, "c_custkey")).df


@query("SELECT o_custkey, string_agg(o_orderstatus, ', ' ORDER BY o_orderkey) AS statuses FROM orders GROUP BY 1")
def q78_joined_cells(t):
    return shape.joined_cells(shape.slice_fields(order_lists(t), ["o_orderstatus"])).df.withColumnRenamed("o_orderstatus", "statuses")


@query("SELECT * FROM (VALUES ('c_name', 'character'), ('c_nationkey', 'numeric'), ('c_acctbal', 'numeric'), ('c_mktsegment', 'character'), ('rich', 'logical')) v(field, class)")
def q79_field_classes(t):
    own = t("customer").withColumn("rich", F.col("c_acctbal") > 0)
    return shape.field_classes(keyed(own, "c_custkey"))


@query("SELECT rows, keys, o_orderkey FROM (SELECT count(DISTINCT o_custkey) AS rows, count(DISTINCT o_custkey) AS keys, count(*) AS o_orderkey FROM orders)")
def q80_row_counts(t):
    return agg.row_counts(shape.slice_fields(order_lists(t), ["o_orderkey"]))


@query("SELECT p_brand AS p_type, p_type AS p_brand, p_partkey FROM part")
def q81_permute(t):
    return shape.permute(t("part").select("p_partkey", "p_brand", "p_type"), {1: 2}).toDF("p_partkey", "p_brand", "p_type")


@query("SELECT o_orderstatus, o_orderkey FROM orders")
def q82_rekey_lines(t):
    return shape.rekey_lines(order_lists(t), "o_orderstatus", ["o_orderkey"], zipped=True)


# Filters ---------------------------------------------------------------------


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE regexp_matches(n_name, '_1$|_2')")
def q83_select_by_name(t):
    """Customers by the name of their nation."""
    return filters.select_by_name(customers(t), "c_nationkey", t("nation").select("n_nationkey", "n_name"), "/_1$|_2/").df.select("c_custkey")


@query("SELECT o_custkey, coalesce(string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'F'), '') AS finished, coalesce(string_agg(o_orderstatus, '|' ORDER BY o_orderkey) FILTER (WHERE o_orderstatus <> 'F'), '') AS others FROM orders GROUP BY 1")
def q84_choose(t):
    own = order_lists(t)
    finished = filters.choose(F.col("o_orderkey"), F.transform("o_orderstatus", lambda x: x == "F"))
    rest = filters.keep_values(own, "o_orderstatus", "F", invert=True).df
    return own.df.select("o_custkey", F.array_join(F.transform(finished, lambda x: x.cast("string")), "|").alias("finished")).join(rest.select("o_custkey", F.array_join("o_orderstatus", "|").alias("others")), "o_custkey")


# Joins ---------------------------------------------------------------------------


@query("SELECT coalesce(a.k, b.k) AS k, concat_ws('|', a.name, b.name) AS name, coalesce(b.supplier, '') AS supplier FROM (SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey < 3) a FULL JOIN (SELECT s_nationkey AS k, string_agg(s_name, '|' ORDER BY s_suppkey) AS name, string_agg(s_suppkey::VARCHAR, '|' ORDER BY s_suppkey) AS supplier FROM supplier GROUP BY 1) b ON a.k = b.k")
def q85_common_fields(t):
    """A full join in which a field of both sides is concatenated."""
    a = shape.to_double(keyed(t("nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), "k"))
    b = load.merge(t("supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("supplier")), "k", ["name", "supplier"], ["supplier"])
    return joins.attach(a, b, ["name", "supplier"], complete=True).df.select("k", *joined("name", "supplier"))


@query("SELECT c_custkey, n_regionkey AS r_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def q86_compose_index(t):
    """From customers to regions by way of nations."""
    pairs = [t("customer").select("c_custkey", "c_nationkey"), t("nation").select("n_nationkey", "n_regionkey")]
    return joins.compose_index(pairs).toDF("c_custkey", "r_regionkey")


@query("SELECT n_name, string_agg(c_custkey::VARCHAR, '|' ORDER BY c_custkey) AS c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def q87_change_key(t):
    """Customers under the name of their nation, which two tables give."""
    tables = [t("customer").select("c_custkey", F.col("c_nationkey").alias("nation")), t("nation").select(F.col("n_nationkey").alias("nation"), "n_name")]
    index = joins.translation_index(tables, "c_custkey", "n_name")
    own = keyed(t("customer").select("c_custkey", F.col("c_custkey").alias("id")), "c_custkey")
    return joins.change_key(own, index, "n_name").df.select("n_name", *joined("id")).withColumnRenamed("id", "c_custkey")


@query("SELECT o_custkey, string_agg(coalesce(n, ''), '|' ORDER BY o_orderkey) AS status FROM (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS n FROM orders) WHERE n IS NOT NULL GROUP BY 1 UNION ALL SELECT o_custkey, '' FROM orders GROUP BY 1 HAVING bool_and(o_orderstatus = 'P')")
def q88_swap_values(t):
    """Values of lists translated, and those without a translation left out."""
    index = t("orders").sparkSession.createDataFrame([("F", "finished"), ("O", "open")], "a string, b string")
    return joins.translate(order_lists(t), "o_orderstatus", index, "status", compact=True).df.select("o_custkey", *joined("status"))


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(customers, '') AS customers, coalesce(suppliers, '') AS suppliers FROM (SELECT c_nationkey AS k, string_agg(c_name, '|' ORDER BY c_custkey) AS customers FROM customer WHERE c_acctbal > 5000 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, string_agg(s_name, '|' ORDER BY s_suppkey) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) b ON a.k = b.k")
def q89_merge_different_fields(t):
    a = t("customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"), F.col("c_name").alias("customers"), F.col("c_custkey").alias("_o"))
    b = t("supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("suppliers"), F.col("s_suppkey").alias("_o"))
    return joins.merge_different_fields(a, b, "k", ["_o"]).df


@query("SELECT c_custkey, p_name FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS n FROM customer) FULL JOIN (SELECT p_name, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS n FROM part) USING (n)")
def q90_paste_positions(t):
    frames = [t("customer").select("c_custkey", "c_acctbal"), t("part").select("p_partkey", "p_retailprice", "p_name")]
    return joins.paste_positions(frames, [["c_acctbal", "c_custkey"], ["p_retailprice", "p_partkey"]]).select("c_custkey", "p_name")


@query("SELECT k, string_agg(v, '|' ORDER BY turn) AS v FROM (SELECT n_nationkey AS k, n_name AS v, 0 AS turn FROM nation UNION ALL SELECT c_nationkey, max(c_name), 1 FROM customer GROUP BY 1 UNION ALL SELECT s_nationkey, max(s_name), 2 FROM supplier GROUP BY 1) GROUP BY k")
def q91_paste_same_fields(t):
    parts = [
        keyed(t("nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), "k"),
        agg.reduce_by(t("customer").withColumnRenamed("c_nationkey", "k"), "k", v=F.max("c_name")),
        agg.reduce_by(t("supplier").withColumnRenamed("s_nationkey", "k"), "k", v=F.max("s_name")),
    ]
    return joins.paste(parts, same_fields=True).df


_CENTS = "floor({} * 100)::BIGINT"


@query(f"SELECT c_custkey, s_suppkey FROM (SELECT *, {_CENTS.format('c_acctbal')} AS a FROM customer) JOIN (SELECT *, {_CENTS.format('s_acctbal')} AS b FROM supplier) ON c_nationkey = s_nationkey AND a <= b + s_suppkey * 100 AND b <= a + CASE c_mktsegment WHEN 'BUILDING' THEN 1000000 ELSE 3 END")
def q92_uneven_intervals(t):
    """Overlaps of intervals of very different lengths: of a nation's customers
    and suppliers, from their balances on."""
    cents = lambda c: F.floor(F.col(c) * 100)
    long = F.when(F.col("c_mktsegment") == "BUILDING", 1_000_000).otherwise(3)
    a = t("customer").select("c_custkey", F.col("c_nationkey").alias("n"), cents("c_acctbal").alias("a_start"), (cents("c_acctbal") + long).alias("a_end"))
    b = t("supplier").select("s_suppkey", F.col("s_nationkey").alias("n"), cents("s_acctbal").alias("b_start"), (cents("s_acctbal") + F.col("s_suppkey") * 100).alias("b_end"))
    return intervals.overlaps(a, b, ["n"], 64).select("c_custkey", "s_suppkey")


@query("SELECT chr, event_id FROM (SELECT (user_id % 5)::VARCHAR AS chr, event_id, epoch_us(ts) AS s FROM events) WHERE chr = '2' AND s <= 1704240000000000 AND s + 3600000000 >= 1704153600000000")
def q93_bed_index(t):
    """Intervals of one contig that overlap a range of positions, by a stored
    index in two parts."""
    own = t("events").select((F.col("user_id") % 5).cast("string").alias("chr"), micros("ts").alias("b_start"), (micros("ts") + 3_600_000_000).alias("b_end"), "event_id", "event_type")
    index = indices.RangeIndex(t("events").sparkSession, scratch(t, "ranges"), ["chr"], 3_600_000_000)
    for part in (own.where("event_type = 'purchase'"), own.where("event_type <> 'purchase'")):
        index.append(part.drop("event_type"), files=16)
    return index.over(1_704_153_600_000_000, 1_704_240_000_000_000, chr="2").select("chr", "event_id")


# Aggregates and ranks ----------------------------------------------------------


@query("SELECT c_mktsegment, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS \"F\", max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS \"O\", max(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS \"P\" FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def q94_incidence_values(t):
    rows = t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey"))
    return agg.incidence(rows, "c_mktsegment", "o_orderstatus", ["F", "O", "P"], "o_totalprice")


@query("SELECT source, string_agg(target::VARCHAR, '|' ORDER BY target) AS targets, string_agg(n::VARCHAR, '|' ORDER BY target) AS values FROM (SELECT l_suppkey AS source, l_partkey AS target, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def q95_adjacency_values(t):
    e = t("lineitem").groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    return assoc.adjacency_values(e, "n").select("source", *joined("targets", "values"))


@query(f"SELECT c_mktsegment, round(mode, 3) AS mode, round(density, 9) AS density FROM ({density.oracle('customer', 'c_mktsegment', 'c_acctbal')})")
def q96_modes(t):
    """Peaks of each segment's balances."""
    return density.modes(t("customer"), "c_mktsegment", "c_acctbal").select("c_mktsegment", F.round("mode", 3).alias("mode"), F.round("density", 9).alias("density"))


_HEX = "lpad(lower(to_hex(round({0} + ({1} - {0}) * share)::BIGINT)), 2, '0')"


@query(f"SELECT p_partkey, '#' || {_HEX.format(255, 0)} || {_HEX.format(255, 0)} || {_HEX.format(255, 128)} AS colour FROM (SELECT p_partkey, (p_size - lo) / (hi - lo)::DOUBLE AS share FROM part, (SELECT min(p_size) AS lo, max(p_size) AS hi FROM part))")
def q97_gradient(t):
    return ranks.gradient(t("part").select("p_partkey", "p_size"), "p_size", "#ffffff", "#000080").select("p_partkey", "colour")


@query("WITH p AS (SELECT p_retailprice, row_number() OVER (ORDER BY p_retailprice) - 1 AS place FROM (SELECT DISTINCT p_retailprice FROM part)) SELECT * FROM p WHERE p_retailprice IN (SELECT p_retailprice FROM part WHERE p_brand = 'Brand#7')")
def q98_hit_places(t):
    return ranks.hit_places(t("part"), "p_retailprice", t("part").where("p_brand = 'Brand#7'"))


@query("SELECT c_custkey, round(-log10(p), 8) AS observed, round(-log10(row_number() OVER (ORDER BY p, c_custkey) / (SELECT count(*) + 1 FROM customer)), 8) AS expected FROM (SELECT c_custkey, (c_acctbal + 1001) / 20000 AS p FROM customer)")
def q99_quantile_pairs(t):
    p = t("customer").select("c_custkey", ((F.col("c_acctbal") + 1001) / 20000).alias("p"))
    return ranks.quantile_pairs(p, "p", "c_custkey").select("c_custkey", F.round("observed", 8).alias("observed"), F.round("expected", 8).alias("expected"))


@query("SELECT p_partkey FROM part ORDER BY md5(p_partkey || '#11'), p_partkey LIMIT 100")
def q100_sample(t):
    """A hundred parts, drawn without replacement."""
    return ranks.sample(t("part"), 100, "p_partkey", 11).select("p_partkey")


@query("SELECT name, stream, place FROM (SELECT c_name AS name, 0 AS stream, row_number() OVER (ORDER BY c_custkey) AS place FROM customer UNION ALL SELECT s_name, 1, row_number() OVER (ORDER BY s_suppkey) FROM supplier)")
def q101_interleaved(t):
    parts = [t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name")), t("supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"))]
    return ranks.interleaved(parts, [["k"], ["k"]]).select("name", F.col("_stream").alias("stream"), F.col("_place").alias("place"))


@query("SELECT o_custkey, array_to_string(list_sort(list_distinct(a || b)), '|') AS both, array_to_string(list_sort(list_intersect(a, b)), '|') AS common, array_to_string(list_sort(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))), '|') AS rest FROM (SELECT o_custkey, coalesce(list(o_orderpriority ORDER BY o_orderkey) FILTER (WHERE o_orderstatus = 'F'), []) AS a, coalesce(list(o_orderpriority ORDER BY o_orderkey) FILTER (WHERE o_orderstatus <> 'F'), []) AS b FROM orders GROUP BY 1)")
def q102_list_sets(t):
    """Priorities of each customer's finished orders and of the others; one of
    the lists may be empty."""
    rows = t("orders").groupBy("o_custkey").agg(*(F.transform(F.sort_array(F.collect_list(F.when(test, F.struct("o_orderkey", "o_orderpriority")))), lambda x: x["o_orderpriority"]).alias(n) for n, test in (("a", F.col("o_orderstatus") == "F"), ("b", F.col("o_orderstatus") != "F"))))
    return rows.select("o_custkey", *(F.array_join(c, "|").alias(n) for n, c in (("both", ranks.list_union("a", "b")), ("common", ranks.list_intersection("a", "b")), ("rest", F.sort_array(ranks.list_without("a", "b"))))))


_PLACE = "SELECT m, row_number() OVER (ORDER BY {}, split_part(m, ':', 2)::BIGINT, m) AS place FROM (SELECT DISTINCT {} AS m FROM part)"


@query(_PLACE.format("split_part(m, ':', 1)", _MUTATION))
def q61_genomic_sort(t):
    """Mutations in the byte order of their chromosomes, numbered."""
    return agg.numbered(mutations(t).distinct().select("m", *ranks.position_keys("m", "plain")), ["_chr", "_pos", "m"], "place").select("m", "place")


@query(_PLACE.format("list_position(['MT', 'X', '10', 'Y', '2', '1'], split_part(m, ':', 1)[4:])", _MUTATION))
def q103_contig_sort(t):
    """The same in the order of a list of contigs."""
    keys = ranks.position_keys("m", ["chrMT", "chrX", "chr10", "chrY", "chr2", "chr1"])
    return agg.numbered(mutations(t).distinct().select("m", *keys), ["_chr", "_pos", "m"], "place").select("m", "place")


# Associations ----------------------------------------------------------------


@query("SELECT source, target, string_agg(flag, ';;' ORDER BY flag) AS flags FROM (SELECT DISTINCT c_name AS source, s_name AS target, l_returnflag AS flag FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey) GROUP BY ALL")
def q104_association(t):
    """Who bought from whom, both ends by name."""
    rows = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("l_suppkey").alias("supplier"), F.col("o_custkey").alias("customer"), F.col("l_returnflag").alias("flag")).distinct()
    spec = assoc.Spec(["supplier", "customer", "flag"], assoc.End("customer", t("customer").select("c_custkey", "c_name"), "name"), assoc.End("supplier", t("supplier").select("s_suppkey", "s_name"), "firm"))
    e = assoc.database(keyed(rows, "supplier", ["customer", "flag"]), spec)
    return assoc.edges(e, "source", "target", ["flag"], ["flag"]).select("source", "target", F.col("flag").alias("flags"))


def _kb(t) -> assoc.KnowledgeBase:
    kb = assoc.KnowledgeBase(keep=True)
    kb.register("placed", lambda: assoc.edges(t("orders"), "o_custkey", "o_orderkey"))
    return kb.register("contains", lambda: t("lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_returnflag").alias("flag")).distinct())


_RULES = [Rule(Var("c"), "placed", Var("o")), Rule(Var("o"), "contains", Var("p"), {"flag": "R"})]


@query("SELECT DISTINCT o_custkey AS c, o_orderkey AS o, l_partkey AS p, o_custkey || ' placed ' || o_orderkey AS first, o_orderkey || ' contains ' || l_partkey AS second FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'")
def q105_path_edges(t):
    """Bindings with the edges that each rule took."""
    shown = lambda p: F.concat_ws(" ", F.col(p)["source"].cast("string"), F.col(p)["db"], F.col(p)["target"].cast("string"))
    return paths(_kb(t), _RULES).select("c", "o", "p", shown("path_0").alias("first"), shown("path_1").alias("second"))


@query("SELECT 'c' AS var, o_custkey AS id FROM orders UNION SELECT 'o', o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') UNION SELECT 'p', l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'")
def q106_assignments(t):
    """What rule after rule leaves of each variable."""
    own = assignments(_kb(t), _RULES)
    parts = [df.select(F.lit(v).alias("var"), F.col(v).alias("id")) for v, df in own.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT source, target FROM (SELECT o_custkey AS source, l_suppkey AS target, list(l_returnflag) AS f FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2) WHERE list_contains(f, 'A')")
def q107_matching_edges(t):
    rows = t("orders").join(t("lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return assoc.matching(assoc.edges(rows, "o_custkey", "l_suppkey", ["l_returnflag"]), "l_returnflag", "A").select("source", "target")


@query("SELECT s_name AS source, length(s_name) AS single, count(l_orderkey) AS many FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey, s_name")
def q65_entity_property(t):
    """A property of each id, and one that all ids are asked for together."""
    names = t("supplier").select("s_suppkey", "s_name")
    n = entities.Property("many", many=lambda ids: ids.join(names, F.col("id") == F.col("s_name")).join(t("lineitem"), F.col("s_suppkey") == F.col("l_suppkey"), "left").groupBy("id").agg(F.count("l_orderkey").alias("value")))
    own = entities.Property("single", single=lambda c: F.length(c).cast("long")).of(names.select(F.col("s_name").alias("source")), "source")
    return n.of(own, "source")


@query("SELECT c_name || '#1' AS key, c_name AS id, '{\"nation\":' || c_nationkey || ',\"segment\":\"' || c_mktsegment || '\"}' AS notes FROM customer")
def q108_notes(t):
    own = t("customer").select(F.col("c_name").alias("id"), F.struct(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment")).alias("notes"))
    return entities.notes_table(own)


# Functions --------------------------------------------------------------------------


@query("SELECT page_id, string_split(url, '#')[1] || CASE WHEN contains(string_split(url, '#')[1], '?') THEN '&' ELSE '?' END || 'seen=' || page_id || CASE WHEN contains(url, '#') THEN substr(url, instr(url, '#')) ELSE '' END AS seen, '<a href=''' || replace(url, '&', '&amp;') || '''>page ' || page_id || '</a>' AS tag, md5('=' || page_id || chr(31) || '=' || url) AS digest, round(log2(page_id + 1), 9) AS bits FROM pages")
def q109_url_text(t):
    """Of all URLs, those with a fragment too."""
    own = t("pages")
    page = F.col("page_id").cast("string")
    return own.select("page_id", text.with_param(F.col("url"), "seen", page).alias("seen"), text.html_tag("a", F.concat(F.lit("page "), page), {"href": F.col("url"), "title": F.lit(None)}).alias("tag"), text.digest(F.col("page_id"), F.col("url")).alias("digest"), F.round(text.log_of(F.col("page_id") + 1, 2), 9).alias("bits"))


@query("SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS human, string_split(p_name, ' ')[1] || upper(substr(string_split(p_name, ' ')[2], 1, 1)) || substr(string_split(p_name, ' ')[2], 2) AS camel, replace(p_name, ' ', '_') AS snake, 'size=' || p_size || '#type=' || p_type AS options, p_type AS type FROM part")
def q110_case_text(t):
    words = F.split("p_name", " ")
    first, second = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    camel = F.concat(first, F.upper(F.left(second, F.lit(1))), F.substr(second, F.lit(2)))
    said = text.option_map(F.concat(F.lit(":type="), F.col("p_type"), F.lit("#size='"), F.col("p_size").cast("string"), F.lit("'")))
    return t("part").select("p_partkey", text.humanize(camel).alias("human_camel"), text.humanize(F.col("p_name")).alias("human"), camel.alias("camel"), text.snake_case(camel).alias("snake"), text.option_text(said).alias("options"), said["type"].alias("type")).drop("human_camel")


_ALLELES = "(SELECT p_partkey AS id, p_partkey AS pos, repeat('A', p_size % 3 + 1) || 'C' AS ref, repeat('A', p_partkey % 4 + 1) || 'C' AS alt FROM part)"


@query(f"SELECT id, pos + least(length(ref), length(alt)) - 1 + CASE WHEN ref = alt THEN 1 ELSE 0 END AS position, CASE WHEN ref = alt THEN '+' WHEN length(ref) > length(alt) THEN repeat('-', length(ref) - length(alt)) ELSE repeat('-', 1) || repeat('A', length(alt) - length(ref)) || 'C' END AS allele FROM {_ALLELES}")
def q111_corrected_alleles(t):
    """Runs of A before a C, of another length in the allele."""
    rows = t("part").select(F.col("p_partkey").alias("id"), F.concat(F.repeat(F.lit("A"), F.col("p_size") % 3 + 1), F.lit("C")).alias("ref"), F.concat(F.repeat(F.lit("A"), (F.col("p_partkey") % 4 + 1).cast("int")), F.lit("C")).alias("alt"))
    own = rows.withColumn("x", sequence.corrected_alleles(F.col("id"), F.col("ref"), F.col("alt")))
    return own.select("id", F.col("x")["position"].alias("position"), F.array_join(F.col("x")["alleles"], ",").alias("allele"))


_DNA = ("c.9T>A", "c.5_6insGGC", "c.12delA", "c.30_34del5", "c.40_41delinsTTA", "c.77_78ins3", "c.100_101delAC", "c.8_9insQ", "c.=", "c.4delx")
_DNA_SHORT = ("A", "+GGC", "-", "-----", "--TTA", "+NNN", "--", "?(c.8_9insQ)", "?(c.=)", "?(c.4delx)")


@query(
    "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in zip(_DNA, _DNA_SHORT)) + ") v(hgvs, short) "
    "UNION ALL SELECT 'c.' || p_partkey || '_' || (p_partkey + p_size) || 'delinsGT', repeat('-', p_size + 1) || 'GT' FROM part UNION ALL SELECT 'c.' || p_partkey || 'ins' || p_size, '+' || repeat('N', p_size) FROM part"
)
def q112_dna_change(t):
    """Changes as they are written, and two made from each part's size and key."""
    said = t("part").sparkSession.createDataFrame([(x,) for x in _DNA], "hgvs string")
    at, size = F.col("p_partkey"), F.col("p_size")
    swapped = t("part").select(F.concat(F.lit("c."), at.cast("string"), F.lit("_"), (at + size).cast("string"), F.lit("delinsGT")).alias("hgvs"))
    grown = t("part").select(F.concat(F.lit("c."), at.cast("string"), F.lit("ins"), size.cast("string")).alias("hgvs"))
    return said.unionByName(swapped).unionByName(grown).select("hgvs", sequence.dna_change(F.col("hgvs")).alias("short"))


@query()
def q113_local_alignment(t):
    """Each nation's suppliers and its name, aligned (tested against a plain
    version)."""
    rows = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    own = rows.withColumn("x", sequence.local_alignment(F.upper("s_name"), F.col("n_name")))
    return own.select("s_suppkey", *(F.col("x")[c].alias(c) for c in ("score", "q_start", "q_end", "t_start", "t_end", "percent")))


_GREY = "lpad(lower(to_hex(round({0})::BIGINT)), 2, '0')"


@query(f"SELECT p_partkey, '#' || {_GREY.format('p_size + (255 - p_size) * 0.5')} || {_GREY.format('127.5')} || {_GREY.format('16 + (255 - 16) * 0.5')} AS light FROM part")
def q114_colours(t):
    colour = F.concat(F.lit("#"), F.lpad(F.hex("p_size"), 2, "0"), F.lit("0010"))
    return t("part").select("p_partkey", text.lightened(colour, 0.5).alias("light"))


# Models ----------------------------------------------------------------------------


_FIT = "(SELECT l_suppkey AS s, regr_slope(y, l_quantity) AS a, regr_intercept(y, l_quantity) AS b FROM (SELECT *, CASE WHEN l_linenumber <> 1 THEN l_extendedprice END AS y FROM lineitem) GROUP BY 1)"


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(CASE WHEN l_linenumber <> 1 THEN l_extendedprice ELSE b + a * l_quantity END, 2) AS filled, round(b + a * l_quantity, 2) AS prediction FROM lineitem JOIN {_FIT} ON s = l_suppkey")
def q115_predicted(t):
    """Prices predicted by each supplier's line, where the first line's are missing."""
    rows = t("lineitem").withColumn("y", F.when(F.col("l_linenumber") != 1, F.col("l_extendedprice")))
    return agg.predicted(rows, "l_suppkey", "y", "l_quantity").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("filled", 2).alias("filled"), F.round("prediction", 2).alias("prediction"))


@query()
def q116_components(t):
    """Parts by two principal components (tested against numpy)."""
    return agg.components(t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount"), ["l_quantity", "l_extendedprice", "l_discount"], 2)


# Stored tables and streams -----------------------------------------------------------


@query(f"SELECT o_custkey::VARCHAR AS o_custkey, {_STATUS} AS o_orderstatus, string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def q117_text_round_trip(t):
    """A double table written as text with its header, and opened again."""
    path = scratch(t, "table")
    source.write_table(shape.slice_fields(order_lists(t), ["o_orderstatus", "o_orderkey"]), path)
    return source.open_table(t("orders").sparkSession, path).df.select("o_custkey", *joined("o_orderstatus", "o_orderkey"))


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, s_nationkey::BIGINT AS s_nationkey FROM supplier")
def q118_csv_source(t):
    path = f"{scratch(t, 'table')}.csv"
    t("supplier").select("s_suppkey", "s_name", "s_nationkey").write.csv(path, header=True)
    own = source.open_source(t("supplier").sparkSession, path)
    return own.df.select("s_suppkey", "s_name", source.number(F.col("s_nationkey"), "long").alias("s_nationkey"))


@query("SELECT s_suppkey, '{\"s_suppkey\":' || s_suppkey || ',\"s_name\":\"' || s_name || '\",\"nation_key\":' || s_nationkey || '}' AS value FROM supplier")
def q119_json(t):
    own = keyed(t("supplier").select("s_suppkey", "s_name", F.col("s_nationkey").alias("nationKey")), "s_suppkey")
    lines = source.json_lines(own, as_records=True, snake=True)
    return lines.select(F.get_json_object("value", "$.s_suppkey").cast("long").alias("s_suppkey"), "value")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P' AND o_orderkey BETWEEN 100 AND 900")
def q120_shards(t):
    """A range of keys in one shard of a stored table."""
    spark = t("orders").sparkSession
    held = tasks.persist(spark, shared_dir(spark), "orders", {"files": tasks.files_of(t("orders"))}, lambda: t("orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), check=tasks.files_of(t("orders")), shards=["o_orderstatus"])
    return tasks.range_scan(held.where("o_orderstatus = 'P'"), "o_orderkey", 100, 900).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name, c_nationkey < 5 AS new FROM customer WHERE c_acctbal > 0")
def q121_with_cache(t):
    """Names that a store has, and those looked up because it lacks them."""
    every = t("customer").select("c_custkey", "c_name")
    cache = t("customer").where("c_nationkey >= 5").select("c_custkey", "c_name", F.lit(False).alias("new"))
    fetch = lambda ids: ids.join(every, "c_custkey").withColumn("new", F.lit(True))
    return tasks.with_cache(cache, t("customer").where("c_acctbal > 0"), "c_custkey", fetch)[0].select("c_custkey", "c_name", "new")


def _streamed(t) -> tuple[DataFrame, str]:
    """All events as they arrive in a folder, and a path for what becomes of
    them."""
    path = scratch(t, "stream")
    t("events").repartition(8).write.parquet(f"{path}-in")
    return streams.tail(t("events").sparkSession, f"{path}-in", t("events"), 2), path


@query("SELECT user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1")
def q122_stream_collapse(t):
    """Sums that a stream leaves batch by batch, added up."""
    stream, path = _streamed(t)
    exact = stream.where("event_type = 'purchase'").withColumn("value", F.col("value").cast("decimal(18,2)"))
    streams.collapse_into(exact, "user_id", "value", path, f"{path}-state").awaitTermination()
    sums = t("events").sparkSession.read.parquet(path)
    return sums.groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("value").cast("double").alias("value"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def q123_stream_windows(t):
    """Rows of each type in windows of a day of event time, of the stream's
    rows as they stand."""
    return streams.windowed_counts(t("events"), "ts", "event_type", "1 day", "1 hour").select("start", "event_type", "n")


@query("SELECT event_id, 'kept' AS sink FROM events WHERE event_type = 'error' UNION ALL SELECT event_id, 'rest' FROM events WHERE event_type <> 'error'")
def q124_tee(t):
    """One stream into two folders."""
    stream, path = _streamed(t)
    sinks = {f"{path}-kept": lambda d: d.where("event_type = 'error'").select("event_id"), f"{path}-rest": lambda d: d.where("event_type <> 'error'").select("event_id")}
    streams.tee_into(stream, sinks, f"{path}-state").awaitTermination()
    read = lambda s: t("events").sparkSession.read.parquet(f"{path}-{s}").select("event_id", F.lit(s).alias("sink"))
    return read("kept").unionByName(read("rest"))


@query("SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders GROUP BY 1")
def q125_tasks(t):
    """A task whose dependency is another's stored result. Its input grows
    after a first run, which makes both steps anew."""
    spark, path = t("orders").sparkSession, scratch(t, "orders")
    orders = tasks.Task("orders", lambda given: spark.read.parquet(given["path"]).select("o_custkey", "o_totalprice"), paths=("path",))
    totals = tasks.Task("totals", lambda given, rows: agg.reduce_by(rows, "o_custkey", total=exact_sum("o_totalprice")).df, [orders])
    root = scratch(t, "tasks")
    for status in ("o_orderstatus = 'F'", "o_orderstatus <> 'F'"):
        t("orders").where(status).write.mode("append").parquet(path)
        found = totals.run(spark, root, {"path": path})
    return found
