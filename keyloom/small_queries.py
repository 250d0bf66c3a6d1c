"""Queries of the smaller functions: sources, shapes, filters, order, entities
and text, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.frame import KeyedFrame, keyed
from keyloom.functions import sequence, text
from keyloom.more_queries import scratch
from keyloom.operators import aggregates as agg
from keyloom.operators import filters, load, ranks, shape
from keyloom.plans import associations as assoc
from keyloom.plans import entities, tasks
from keyloom.queries import customers, joined, order_lists, query
from keyloom.sources import text as source
from keyloom.streaming import tables as streams

# Sources and sinks ---------------------------------------------------------------


def _written(t, table: KeyedFrame) -> str:
    path = scratch(t, "table")
    source.write_table(table, path)
    return path


@query("SELECT o_custkey::VARCHAR AS o_custkey, arg_min(o_orderkey, o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def q162_option_string(t):
    """A table opened by a text that names key, field, shape and cast."""
    path = _written(t, order_lists(t))
    return source.open_table(t("orders").sparkSession, path, spec="o_custkey~o_orderkey#:type=:single#:cast=:to_i").df


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier")
def q163_single_rows(t):
    path = _written(t, keyed(t("supplier"), "s_suppkey", ["s_name", "s_nationkey"]))
    return source.open_table(t("supplier").sparkSession, path, spec="s_suppkey~s_name#:type=:single").df


@query("SELECT s_nationkey::VARCHAR AS s_nationkey, arg_min(s_name, s_suppkey::VARCHAR) AS s_name, arg_min(s_suppkey, s_suppkey::VARCHAR)::BIGINT AS s_suppkey FROM supplier GROUP BY 1")
def q164_list_rows(t):
    """Rows by another key: of those that share it the first in the file."""
    path = _written(t, keyed(t("supplier").withColumn("s_suppkey", F.col("s_suppkey").cast("string")), "s_suppkey", ["s_name", "s_nationkey"]))
    own = source.open_table(t("supplier").sparkSession, path, shape="list", key_field="s_nationkey", fields=["s_name", "s_suppkey"]).df
    return own.withColumn("s_suppkey", F.col("s_suppkey").cast("long"))


@query("SELECT o_custkey::VARCHAR AS o_custkey, string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def q165_flat_rows(t):
    path = _written(t, shape.slice_fields(order_lists(t), ["o_orderkey"]))
    return source.open_table(t("orders").sparkSession, path, shape="flat").df.select("o_custkey", *joined("o_orderkey"))


@query("SELECT word, arg_min(p_partkey, p_partkey) AS p_partkey FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
def q166_first_zipped(t):
    """Rows with several keys, of which the first row of a key stays."""
    rows = t("part").select(F.split("p_name", " ").alias("word"), F.array("p_partkey").alias("part"), "p_partkey")
    return load.merge_zipped(rows, "word", ["part"], ["p_partkey"], first_only=True).df.select("word", F.col("part").alias("p_partkey"))


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, replace(s_name, 'Supplier', 'Firm') AS s_name FROM supplier WHERE contains(s_name, '0')")
def q167_fixed_lines(t):
    """Lines rewritten, and only those that hold a pattern."""
    path = _written(t, keyed(t("supplier"), "s_suppkey", ["s_name"]))
    return source.open_table(t("supplier").sparkSession, path, shape="single", select=lambda v: v.contains("Firm") & v.contains("0"), fix=lambda v: F.replace(v, F.lit("Supplier"), F.lit("Firm"))).df.where(F.col("s_name").contains("0"))


@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name FROM supplier WHERE regexp_matches(s_suppkey::VARCHAR || chr(9) || s_name, '[13579]$')")
def q168_grep_rows(t):
    path = _written(t, keyed(t("supplier"), "s_suppkey", ["s_name"]))
    return source.open_table(t("supplier").sparkSession, path, shape="single", grep="[13579]$").df


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 5")
def q169_head_rows(t):
    """The first rows of a file."""
    path = _written(t, keyed(t("customer"), "c_custkey", ["c_name"]))
    own = source.open_table(t("customer").sparkSession, path, shape="single", head=5).df
    return own.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name")


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders")
def q170_unmerged(t):
    return source.unmerged(shape.slice_fields(order_lists(t), ["o_orderkey", "o_orderstatus"])).df


@query("SELECT s_suppkey, s_name, 'parquet' AS kind FROM supplier UNION ALL SELECT s_suppkey, s_name, 'json' FROM supplier")
def q171_stored_results(t):
    """A result stored and loaded again, in two kinds."""
    spark, own = t("supplier").sparkSession, t("supplier").select("s_suppkey", "s_name")
    parts = []
    for kind in ("parquet", "json"):
        source.save_result(spark, path := scratch(t, kind), kind, own)
        parts.append(source.load_result(spark, path, kind).select("s_suppkey", "s_name", F.lit(kind).alias("kind")))
    return parts[0].unionByName(parts[1])


@query("SELECT l_suppkey::VARCHAR AS l_suppkey, count(*)::DOUBLE AS n, max(l_quantity) AS quantity FROM lineitem GROUP BY 1")
def q202_open_numbers(t):
    """A matrix of numbers, written as text and opened as numbers."""
    own = agg.reduce_by(t("lineitem"), "l_suppkey", n=F.count(F.lit(1)).cast("double"), quantity=F.max("l_quantity"))
    return source.open_numbers(t("lineitem").sparkSession, _written(t, own)).df


@query("SELECT s_suppkey, s_name, round(s_acctbal, 1) AS s_acctbal FROM supplier WHERE s_suppkey = 3")
def q172_one_record(t):
    return source.record(keyed(t("supplier"), "s_suppkey", ["s_name", "s_acctbal"]), 3, 1)


@query("SELECT p_partkey, p_name FROM part")
def q173_pandas(t):
    """A table to pandas and back, by batches inside the tasks."""
    own = keyed(t("part"), "p_partkey", ["p_name"])
    return source.through_pandas(own, lambda df: df, own.df.schema).df


# Shapes ----------------------------------------------------------------------


@query("SELECT o_custkey, string_agg(o_orderstatus, '|' ORDER BY o_orderkey) AS status FROM orders GROUP BY 1")
def q174_renamed_column(t):
    own = shape.rename_field(shape.column(order_lists(t), "o_orderstatus"), "o_orderstatus", "status")
    return own.df.select("o_custkey", *joined("status"))


@query("SELECT o_orderstatus FROM orders")
def q175_column_values(t):
    return shape.column_values(order_lists(t), "o_orderstatus")


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def q176_resolved_fields(t):
    """Fields by position, by the name without what it adds in parentheses, and
    those that another table has too."""
    own = keyed(t("customer").withColumnRenamed("c_nationkey", "c_nationkey (number)"), "c_custkey", ["c_name", "c_nationkey (number)", "c_mktsegment", "c_acctbal"])
    sliced = shape.slice_fields(own, ["c_nationkey", 2, "c_acctbal"])
    kept = shape.detach(sliced, keyed(t("customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("c_nationkey (number)")), "c_custkey"))
    return kept.df.toDF("c_custkey", "c_nationkey", "c_mktsegment").select("c_custkey", "c_nationkey", "c_mktsegment")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def q177_to_single(t):
    return shape.to_single(shape.slice_fields(order_lists(t), ["o_orderkey", "o_orderstatus"])).df


@query("SELECT o_custkey::VARCHAR AS o_custkey, string_agg(o_orderstatus, '|' ORDER BY o_orderstatus) AS o_orderstatus, string_agg(o_orderkey::VARCHAR, '|' ORDER BY o_orderstatus, o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def q178_unzip_and_zip(t):
    """Records under key and value, and back under the key."""
    own = shape.unzip(shape.slice_fields(order_lists(t), ["o_orderstatus", "o_orderkey"]), "o_orderstatus")
    return shape.zip_keys(own, "o_orderstatus").df.select("o_custkey", *joined("o_orderstatus", "o_orderkey"))


@query("SELECT p_partkey, p_brand || ' of ' || p_type AS shown FROM part")
def q179_through(t):
    own = shape.add_fields(keyed(t("part"), "p_partkey", ["p_brand", "p_type"]), {"shown": F.concat("p_brand", F.lit(" of "), "p_type")})
    return shape.slice_fields(own, ["shown"]).df


# Filters -----------------------------------------------------------------------


@query("SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) FILTER (WHERE o_orderstatus = 'F') > 5")
def q180_select_by_function(t):
    """Rows by a function of a field's list."""
    return filters.select(order_lists(t), {"o_orderstatus": lambda v: F.size(F.filter(v, lambda x: x == "F")) > 5}).df.select("o_custkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_name = 'BUILDING'")
def q181_select_by_text(t):
    """Rows with a text in any field."""
    return filters.select(customers(t), ["BUILDING"]).df.select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0 AND c_nationkey = 7")
def q182_select_field_equality(t):
    return filters.select(customers(t), {"c_mktsegment": "BUILDING", "c_nationkey": [7], "c_acctbal": ">0"}).df.select("c_custkey")


@query("SELECT s_name AS id FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) UNION ALL SELECT s_name FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def q183_entity_lists(t):
    """Annotated ids that another list has, and those that it hasn't."""
    notes = F.struct(F.lit("firm").alias("kind")).alias("notes")
    own = t("supplier").select(F.col("s_name").alias("id"), notes)
    other = t("supplier").join(t("nation").where("n_regionkey = 1"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_name").alias("id"), notes)
    return entities.concatenated(entities.subset(own, other), entities.without(own, other)).select("id")


@query("SELECT DISTINCT c_name AS id FROM customer WHERE c_nationkey < 20")
def q184_flat_entities(t):
    """Lists of ids flattened, without empty ones and repeats."""
    lists = t("customer").groupBy("c_nationkey").agg(F.collect_list(F.when(F.col("c_nationkey") < 20, F.col("c_name")).otherwise("")).alias("id")).withColumn("notes", F.struct(F.lit(1).alias("n"))).drop("c_nationkey")
    return entities.unique(entities.compact(entities.flattened(lists))).select("id")


@query("SELECT c_name || '#1' AS key, c_name AS id, c_mktsegment AS segment FROM customer")
def q185_notes_round_trip(t):
    """Notes written as text and loaded again."""
    own = t("customer").select(F.col("c_name").alias("id"), F.struct(F.col("c_mktsegment").alias("segment")).alias("notes"))
    table = entities.notes_table(own, ["segment"])
    back = entities.load_notes(table, ["segment"]).select(F.col("id").alias("_id"), F.col("notes.segment.text").alias("back"))
    return table.join(back, F.col("id") == F.col("_id")).select("key", "id", F.col("back").alias("segment"))


@query("SELECT s_name AS id, 'firm' AS kind, 'Person' AS entity FROM supplier")
def q203_marked_entities(t):
    """Ids with the same note on each, in a column whose entity is known."""
    own = entities.annotate(t("supplier"), "s_name", kind="firm").select(F.col("id").alias("name (Customer)"), "notes.kind")
    marked = entities.Formats({"Customer": "Person"}).mark(own)
    entity = entities.Formats.of(marked.schema)["name (Customer)"]
    return marked.select(F.col("`name (Customer)`").alias("id"), "kind", F.lit(entity).alias("entity"))


@query("SELECT c_nationkey, count(*) AS n, avg(c_acctbal) AS mean FROM customer GROUP BY 1")
def q204_memo(t):
    """A result that is made once in a session and used twice."""
    memo = tasks.Memo()
    rows = lambda: memo.get("rows", lambda: t("customer").select("c_nationkey", "c_acctbal"))
    counts = rows().groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    means = rows().groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean"))
    return counts.join(means, "c_nationkey")


@query("SELECT event_id, (SELECT count(*) FROM events) AS seen, (SELECT max(event_id) FROM events) AS last FROM events")
def q205_watched(t):
    """Rows that are counted on their way."""
    own, seen = streams.watched(t("events").select("event_id"), f"seen-{id(t)}", seen=F.count(F.lit(1)), last=F.max("event_id"))
    held = streams.saved_through(own, scratch(t, "watched"))
    return held.select("event_id", F.lit(seen.get["seen"]).cast("long").alias("seen"), F.lit(seen.get["last"]).cast("long").alias("last"))


# Indices, order ---------------------------------------------------------------------


@query("SELECT o_orderstatus AS value, string_agg(o_custkey::VARCHAR, '|' ORDER BY o_custkey) AS keys FROM (SELECT DISTINCT o_custkey, o_orderstatus FROM orders) GROUP BY 1")
def q186_field_index(t):
    return filters.field_index(order_lists(t), "o_orderstatus").select("value", *joined("keys"))


@query("SELECT 'c_name' AS field, count(*) AS n FROM supplier JOIN customer ON replace(s_name, 'Supplier', 'Customer') = c_name")
def q187_guessed_field(t):
    """The field in which most of a list's values are found."""
    wanted = t("supplier").select(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("value"))
    own = keyed(t("customer").select("c_custkey", "c_name", "c_mktsegment"), "c_custkey")
    return agg.field_matches(own, wanted).where(F.col("field") == agg.guess_field(own, wanted))


@query("SELECT o_custkey, row_number() OVER (ORDER BY n DESC, o_custkey) AS place FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)")
def q188_sorted_pairs(t):
    """Rows by an expression of their list."""
    own = order_lists(t).df.withColumn("n", -F.size("o_orderkey"))
    return agg.numbered(own.select("o_custkey", "n"), ["n", "o_custkey"], "place").select("o_custkey", "place")


@query("SELECT m, row_number() OVER (ORDER BY split_part(m, ':', 1), split_part(m, ':', 2)::BIGINT, m) AS place FROM (SELECT DISTINCT CASE p_size % 3 WHEN 0 THEN 'MT' ELSE 'X' END || ':' || p_partkey || ':A' AS m FROM part)")
def q189_mutation_lines(t):
    """Mutations with their chromosome's usual name, in order; lines without one
    go."""
    name = F.when(F.col("p_size") % 3 == 0, "M").otherwise("X")
    lines = t("part").select(F.concat(name, F.lit(":"), F.col("p_partkey").cast("string"), F.lit(":A")).alias("m")).unionByName(t("part").select(F.col("p_name").alias("m")))
    kept = ranks.mutation_lines(lines, "m")
    return agg.numbered(kept.select("m", *ranks.position_keys("m", "plain")), ["_chr", "_pos", "m"], "place").select("m", "place")


@query("SELECT DISTINCT s_nationkey::VARCHAR AS value FROM supplier")
def q190_unique_lines(t):
    return ranks.unique_lines(t("supplier").select(F.col("s_nationkey").cast("string").alias("value")))


# Knowledge bases, tasks --------------------------------------------------------------


@query("SELECT 'sold@shop' AS db, l_suppkey AS source, l_partkey AS target FROM lineitem GROUP BY 2, 3 UNION ALL SELECT 'sold', l_partkey, l_suppkey FROM lineitem GROUP BY 2, 3")
def q191_syndicated(t):
    """Another knowledge base's association beside an own one of that name."""
    pairs = lambda a, b: (lambda: t("lineitem").select(F.col(a).alias("source"), F.col(b).alias("target")).distinct())
    other = assoc.KnowledgeBase().register("sold", pairs("l_suppkey", "l_partkey"))
    kb = assoc.KnowledgeBase().register("sold", pairs("l_partkey", "l_suppkey"))
    kb.syndicate("shop", other)
    parts = [kb.index(n).select(F.lit(n).alias("db"), "source", "target") for n in kb.databases()]
    return parts[0].unionByName(parts[1])


@query("SELECT 'placed' AS db, 'customer' AS source, 'order' AS target, 'o_orderstatus' AS info, count(*) AS edges FROM orders")
def q192_described(t):
    """What an association says of itself, and how many edges it has."""
    kb = assoc.KnowledgeBase().register("placed", lambda: assoc.edges(t("orders"), "o_custkey", "o_orderkey", ["o_orderstatus"]), source="customer", target="order")
    about = kb.describe("placed")
    edges = kb.index("placed").agg(F.count(F.lit(1)).alias("edges"))
    return edges.select(F.lit("placed").alias("db"), F.lit(about["source"]).alias("source"), F.lit(about["target"]).alias("target"), F.lit("|".join(about["info"])).alias("info"), "edges")


@query("SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY 1")
def q193_replaced_dependency(t):
    """A task whose dependency's result is given instead of made."""
    rows = tasks.Task("rows", lambda given: t("customer"))
    counted = tasks.Task("counted", lambda given, df: df.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n")), [rows])
    return counted.run(t("customer").sparkSession, scratch(t, "tasks"), {}, instead={"rows": t("customer").where("c_acctbal > 0")})


@query("SELECT p_partkey, p_size * 2 AS twice FROM part")
def q194_saved_through(t):
    return streams.saved_through(t("part").select("p_partkey", (F.col("p_size") * 2).alias("twice")), scratch(t, "through"))


@query("SELECT event_id, value * 2 AS twice FROM events")
def q195_traversed_stream(t):
    path = scratch(t, "stream")
    t("events").repartition(4).write.parquet(f"{path}-in")
    stream = streams.tail(t("events").sparkSession, f"{path}-in", t("events"), 1)
    streams.traverse_into(stream, path, f"{path}-state", lambda df: df.select("event_id", (F.col("value") * 2).alias("twice"))).awaitTermination()
    return t("events").sparkSession.read.parquet(path)


# Functions -----------------------------------------------------------------------


@query("SELECT event_id, lpad((s // 3600)::VARCHAR, 2, '0') || ':' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') AS clock FROM (SELECT event_id, event_id % 86400 AS s FROM events)")
def q196_format_seconds(t):
    return t("events").select("event_id", text.format_seconds(F.col("event_id") % 86400).alias("clock"))


@query("SELECT p_partkey, abs(p_size - 25) < 3 AS near, abs(25 - p_size) || ',' || p_size AS sizes FROM part")
def q197_near_and_sizes(t):
    sizes = text.size_of(F.array(25 - F.col("p_size"), F.col("p_size")))
    return t("part").select("p_partkey", text.near(F.col("p_size"), F.lit(25), 3).alias("near"), F.array_join(F.transform(sizes, lambda x: x.cast("string")), ",").alias("sizes"))


@query("SELECT p_partkey, 'find|' || p_name || '|' || string_split(p_name, ' ')[1] AS words FROM part")
def q198_command_words(t):
    """A command's words: what stands in quotes is one."""
    line = F.concat(F.lit("find '"), "p_name", F.lit("' "), F.substring_index("p_name", " ", 1))
    return t("part").select("p_partkey", F.array_join(text.tokens(line), "|").alias("words"))


@query("SELECT s_suppkey, s_name AS name, s_nationkey::VARCHAR AS nation, NULL::VARCHAR AS none FROM supplier")
def q199_named_values(t):
    """Pairs and lists as maps, and values by position with names."""
    pairs = F.array(F.array(F.lit("name"), F.lit("old")), F.array(F.lit("name"), F.col("s_name")))
    zipped = text.zipped_map(F.array(F.lit("nation")), F.array(F.col("s_nationkey").cast("string")))
    own = text.named(["name", "nation", "none"], text.pairs_map(pairs)["name"], zipped["nation"])
    return t("supplier").select("s_suppkey", own.alias("x")).select("s_suppkey", "x.name", "x.nation", F.col("x.none").cast("string").alias("none"))


@query("SELECT page_id, 'page ' || page_id AS shown FROM pages")
def q200_without_link(t):
    page = F.concat(F.lit("page "), F.col("page_id").cast("string"))
    return t("pages").select("page_id", text.without_link(text.html_tag("a", page, {"href": F.col("url")})).alias("shown"))


@query("SELECT p_partkey, [['A', 'G'], ['C', 'T'], ['G', 'T'], ['A', 'C']][p_size % 4 + 1][1] AS first, CASE WHEN p_size % 2 = 0 THEN 'www.ensembl.org' ELSE 'may' || p_partkey || '.archive.ensembl.org' END AS host FROM part")
def q201_bases_and_hosts(t):
    """The bases of ambiguity codes, and the host of a dated organism."""
    code = F.element_at(F.array(*map(F.lit, "RYKM")), (F.col("p_size") % 4 + 1).cast("int"))
    organism = F.concat(F.lit("Hsa"), F.when(F.col("p_size") % 2 == 0, "").otherwise(F.concat(F.lit("/may"), F.col("p_partkey").cast("string"))))
    return t("part").select("p_partkey", F.left(sequence.iupac_bases(code), F.lit(1)).alias("first"), sequence.archive_host(organism).alias("host"))
