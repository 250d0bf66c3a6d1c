"""URL filters by a temporal list join, in DataFrame functions only.

A list is a history: dated entries that put a host or a domain on it or take it
off. The history of each entry becomes intervals of validity. A capture is held
against the entries of its host and of every domain above it that were valid
when it was fetched; the join is on the entry and a slice of time (intervals
are dealt to the slices that they touch), so neither a host with very many
captures nor one with a long history meets the whole of the other.

Results by case: a null or malformed URL, or a null fetch time, matches
nothing; entries with a null name or date don't count; of entries of one name
and date, putting on wins; repeated rows of captures each give their own row;
empty tables give captures without a match, or none; other columns of captures
are carried by ``keep`` only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days of a slice of time.
SLICE = 64
FOREVER = 1 << 20


#: The host of an absolute URL: an IPv6 address in brackets or a name.
HOST = r"^[\x00-\x20]*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-f:.]+\]|[^/?#:@\[\]]+)"
#: A host that is an address has no domain above it.
ADDRESS = r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$"


def host_of(url: Column) -> Column:
    """The host of an absolute URL in lower case, without user, port or a dot
    at its end; null where there is none."""
    host = F.regexp_extract(F.lower(url), HOST, 1)
    return F.nullif(F.regexp_replace(host, r"\.+$", ""), F.lit(""))


def names_of(host: Column) -> Column:
    """The host and every domain above it, of two labels at least; an IP
    address is its only name."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    starts = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    return F.when(host.rlike(ADDRESS), F.array(host)).otherwise(F.transform(starts, lambda i: F.array_join(F.slice(labels, i, n), ".")))


def intervals(entries: DataFrame) -> DataFrame:
    """name, since, until (days, until excluded) in which the name is listed,
    from (name, day, listed)."""
    days = entries.where("name is not null and day is not null").groupBy("name", "day").agg(F.max("listed").alias("listed"))
    # Histories are dealt by name; what a name's window holds is a row a day.
    order = Window.partitionBy("name").orderBy("day")
    return days.withColumn("until", F.coalesce(F.lead("day").over(order), F.lit(FOREVER))).where("listed").select("name", F.col("day").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame, url: str, day: str, keep: list[str]) -> DataFrame:
    """``keep``, host, the day, blocked, the number of names that were listed
    on that day (n_entries), the longest of them (entry) and since when it was
    listed (listed_since)."""
    own = captures.select(*keep, host_of(F.col(url)).alias("host"), F.col(day).alias("fetched"))
    first, last = captures.agg(F.min(day), F.max(day)).first()
    # Captures of one host on one day share their answer.
    asked = own.select("host", "fetched").where("host is not null and fetched is not null").distinct()
    asked = asked.withColumn("slice", F.floor(F.col("fetched") / SLICE)).withColumn("name", F.explode(names_of(F.col("host"))))
    valid = intervals(entries).where((F.col("since") <= F.lit(last)) & (F.col("until") > F.lit(first)))
    low, high = F.greatest("since", F.lit(first)), F.least(F.col("until") - 1, F.lit(last))
    dealt = valid.withColumn("slice", F.explode(F.sequence(F.floor(low / SLICE), F.floor(high / SLICE))))
    hit = asked.join(dealt, ["name", "slice"]).where("since <= fetched and fetched < until")
    best = F.max(F.struct(F.length("name").alias("n"), "name", "since")).alias("b")
    found = hit.groupBy("host", "fetched").agg(F.count(F.lit(1)).alias("n_entries"), best)
    found = found.select("host", "fetched", "n_entries", F.col("b.name").alias("entry"), F.col("b.since").alias("listed_since"))
    return own.join(found, ["host", "fetched"], "left").select(
        *keep, "host", "fetched", F.col("n_entries").isNotNull().alias("blocked"), F.coalesce("n_entries", F.lit(0)).alias("n_entries"), "entry", "listed_since"
    )


#: The table of pages has neither fetch times nor lists, so the query makes
#: both from it by rule: a page is fetched on the day its id gives, and every
#: name of a page's host has a history that its letters give.
FIRST_DAY, DAYS = 20000, 730
_MARK = "(31 * length(name) + 17 * ascii(substr(name, 1, 1)) + 7 * ascii(substr(name, 3, 1)))"


def page_captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", (FIRST_DAY + F.pmod("page_id", F.lit(DAYS))).alias("day"))


def page_entries(pages: DataFrame) -> DataFrame:
    """name, day, listed: one name in three is put on, taken off and put on
    again."""
    names = pages.select(host_of(F.col("url")).alias("host")).distinct().select(F.explode(names_of(F.col("host"))).alias("name")).distinct()
    marked = names.withColumn("mark", F.expr(_MARK)).where("mark % 3 = 0")
    day = FIRST_DAY + F.col("mark") % 365
    steps = F.array(F.struct(day.alias("day"), F.lit(True).alias("listed")), F.struct((day + 90).alias("day"), F.lit(False).alias("listed")), F.struct((day + 300).alias("day"), F.lit(True).alias("listed")))
    return marked.select("name", F.explode(steps).alias("e")).select("name", F.col("e.day").cast("long").alias("day"), "e.listed")


ORACLE = rf"""
WITH h AS (SELECT page_id, {FIRST_DAY} + page_id % {DAYS} AS fetched,
  nullif(regexp_replace(regexp_extract(lower(url), '{HOST}', 1), '\.+$', ''), '') AS host FROM pages),
n AS (SELECT DISTINCT host, array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.') AS name
  FROM (SELECT host, unnest(CASE WHEN regexp_matches(host, '{ADDRESS}') THEN [1] ELSE range(1, greatest(len(string_split(host, '.')), 2)) END) AS i FROM (SELECT DISTINCT host FROM h WHERE host IS NOT NULL))),
m AS (SELECT name, {_MARK} AS mark FROM (SELECT DISTINCT name FROM n)),
e AS (SELECT name, {FIRST_DAY} + mark % 365 + unnest([0, 90, 300]) AS day, unnest([true, false, true]) AS listed FROM m WHERE mark % 3 = 0),
asked AS (SELECT page_id, host, fetched, name FROM h JOIN n USING (host)),
hit AS (SELECT page_id, asked.name AS name, e.day AS day FROM asked ASOF JOIN e ON asked.name = e.name AND asked.fetched >= e.day WHERE e.listed),
b AS (SELECT page_id, count(*) AS n_entries, arg_max(name, (length(name), name)) AS entry, arg_max(day, (length(name), name)) AS listed_since FROM hit GROUP BY page_id)
SELECT page_id, host, fetched, n_entries IS NOT NULL AS blocked, coalesce(n_entries, 0) AS n_entries, entry, listed_since
FROM h LEFT JOIN b USING (page_id)
"""
