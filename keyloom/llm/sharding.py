"""A uniform shuffle into shards of exact sizes, by a hypergeometric
communication matrix.

Rows are numbered by the files they stand in. Runs of consecutive rows are the
sources. How many rows of each source go to each shard is drawn exactly as a
uniform shuffle would have it (multivariate hypergeometric, one source after the
other from what room the shards have left): a small matrix, of ``CELLS`` numbers
at most. A source is permuted locally, and the first of its rows go to shard 0,
the next to shard 1, and so on by the matrix. So a row's shard and its place
among those that arrive there are known before it moves, the shard is permuted
again by that place, and rows move once, to the tasks that hold their slots.

Both permutations are computed from a row's place alone, by a keyed bijection, so
no task gathers a source or a shard: there is no window and no group, and what a
task holds is what the exchange deals out by runs of slots. A task that is run
again gives the same rows the same slots.

- The law is ``rows``: shards' sizes are at most one apart, the first ones
  larger. Equal texts are rows like others, and go wherever their places lead.
- Null, empty and very long texts, null and repeated ids change nothing: a row's
  place in its file decides, not its content.
- An empty table gives no rows; with fewer rows than shards, some stay empty.
- Input columns named shard or slot give way to the result's.
"""

from __future__ import annotations

import json
import random
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import materialize

#: Sources, at most, and numbers in the matrix.
SOURCES, CELLS = 64, 1 << 18
#: Files whose offsets may be broadcast.
FILES = 100_000
#: Slots of a shard that are dealt out together.
RUN = 4096
#: Half-rounds of a permutation, and times it may be applied until a place is in
#: range (once, for all but about one in the root of the size).
ROUNDS, WALK = 6, 64


def hypergeometric(rng: random.Random, good: int, total: int, drawn: int) -> int:
    """How many good ones are among those drawn without replacement: inversion
    from the mode outwards, by the ratios of neighbouring chances, so the steps
    taken grow with the deviation only and no large factorial is needed."""
    low, high = max(0, drawn - (total - good)), min(good, drawn)
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    up = lambda x: (good - x) * (drawn - x) / ((x + 1) * (total - good - drawn + x + 1))

    def side(start: int, step: int) -> list[float]:
        chances, x, p = [], start, 1.0
        while low <= x + step <= high and p > 1e-18:
            p = p * up(x) if step > 0 else p / up(x - 1)
            chances.append(p)
            x += step
        return chances

    above, below = side(mode, 1), side(mode, -1)
    at = rng.random() * (1.0 + sum(above) + sum(below)) - 1.0
    if at < 0:
        return mode
    for step, chances in ((1, above), (-1, below)):
        for i, p in enumerate(chances):
            if (at := at - p) < 0:
                return mode + step * (i + 1)
    return mode


def communication(sources: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """How many rows each source sends to each shard; rows and columns sum to
    the sizes given."""
    rng, room, matrix = random.Random(seed), list(shards), []
    for size in sources:
        row, left, rest = [], size, sum(room)
        for s, free in enumerate(room):
            n = hypergeometric(rng, free, rest, left) if left and free else 0
            row.append(n)
            left, rest, room[s] = left - n, rest - free, free - n
        matrix.append(row)
    return matrix


def _shifted(left: Column, right: Column, a: Column, b: Column, key: list[Column], r: int) -> tuple[Column, Column]:
    """A round: one of two digits is shifted by a hash of the other."""
    if r % 2:
        return left, F.pmod(right + F.pmod(F.xxhash64(*key, F.lit(r), left), b), b)
    return F.pmod(left + F.pmod(F.xxhash64(*key, F.lit(r), right), a), a), right


def permuted(df: DataFrame, name: str, place: Column, size: Column, key: list[Column]) -> DataFrame:
    """df with the column ``name``, a permutation of the places 0 .. size - 1
    that depends on the key. The place's two digits, whose bases a and b give
    size or little more when multiplied, are shifted in turn, which is a
    bijection of 0 .. a * b - 1; it is applied until the place is in range,
    which keeps it one."""
    a, b, left, right = (F.col(f"_{name}_{c}") for c in "ablr")
    base = df.withColumns({f"_{name}_s": size, f"_{name}_p": place}).withColumn(f"_{name}_b", F.ceil(F.sqrt(F.col(f"_{name}_s").cast("double"))))
    size, place = F.col(f"_{name}_s"), F.col(f"_{name}_p")
    base = base.withColumn(f"_{name}_a", F.ceil(size / b)).withColumns({f"_{name}_l": F.call_function("div", place, b), f"_{name}_r": F.pmod(place, b)})
    for r in range(ROUNDS):
        base = base.withColumn(f"_{name}_{'lr'[r % 2]}", _shifted(left, right, a, b, key, r)[r % 2])
    base = base.withColumn(name, left * b + right)

    def again(x: Column) -> Column:
        digits = F.call_function("div", x, b), F.pmod(x, b)
        for r in range(ROUNDS):
            digits = _shifted(*digits, a, b, key, r)
        return digits[0] * b + digits[1]

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), F.col(name), lambda x, _: F.when(x < size, x).otherwise(again(x)))
    return base.withColumn(name, F.when(F.col(name) < size, F.col(name)).otherwise(walk)).drop(*(f"_{name}_{c}" for c in "ablrsp"))


def numbered(rows: DataFrame, as_read: bool) -> tuple[DataFrame, int]:
    """(row, g): rows numbered from 0 in the order of their files, and how many
    there are. ``as_read``: rows are a Parquet table as it is read, whose files
    number them; others, and those of too many files, are written first."""
    if not as_read:
        rows = materialize(rows, "rows")
    place = lambda df: df.select(F.struct("*").alias("row"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("i"))
    sizes = materialize(place(rows).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.max("i").alias("last")), "sizes")
    files, total, whole = sizes.agg(F.count(F.lit(1)), F.sum("n"), F.bool_and(F.col("n") == F.col("last") + 1)).first()
    if files and not whole:
        raise ValueError("rows were left out of their files: they aren't a table as it is read")
    if files > FILES:
        return numbered(materialize(rows.coalesce(FILES // 2), "rows"), True)
    own = sizes.orderBy("file").collect()
    ends = accumulate(r.n for r in own)
    starts = literal_rows(rows.sparkSession, [{"file": r.file, "start": end - r.n} for r, end in zip(own, ends)], "file:string,start:bigint")
    return place(rows).join(F.broadcast(starts), "file").select("row", (F.col("start") + F.col("i")).alias("g")), total or 0


def literal_rows(spark, rows: list[dict], schema: str) -> DataFrame:
    """A few rows that the driver knows, as a frame made by SQL functions."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def shuffled(rows: DataFrame, shards: int = 8, seed: int = 13, as_read: bool = False) -> DataFrame:
    """Rows with shard (0 ... shards - 1) and slot (gapless from 0 in its
    shard), a uniform shuffle; the runs of a shard's slots are in order within
    their partitions."""
    own, total = numbered(rows, as_read)
    sources = max(1, min(SOURCES, CELLS // shards, total))
    width = -(-total // sources) or 1
    lengths = [min(width, total - at) for at in range(0, total, width)]
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication(lengths, sizes, seed)
    arrived, table = [0] * shards, []
    for p, (length, row) in enumerate(zip(lengths, matrix)):
        table.append({"source": p, "length": length, "upto": list(accumulate(row)), "shift": [a - (u - n) for a, u, n in zip(arrived, accumulate(row), row)]})
        arrived = [a + n for a, n in zip(arrived, row)]
    # One row for each source, of CELLS numbers together at most.
    plan = literal_rows(rows.sparkSession, table, "source:bigint,length:bigint,upto:array<bigint>,shift:array<bigint>")
    dealt = own.withColumn("source", F.call_function("div", F.col("g"), F.lit(width))).join(F.broadcast(plan), "source")
    local = permuted(dealt, "j", F.col("g") - F.col("source") * width, F.col("length"), [F.lit(seed), F.lit("source"), F.col("source")])
    sent = local.withColumn("shard", F.size(F.filter("upto", lambda u: u <= F.col("j"))))
    room = F.lit(total // shards).cast("long") + (F.col("shard") < F.lit(total % shards)).cast("long")
    arrives = F.col("j") + F.get("shift", F.col("shard"))
    there = permuted(sent, "slot", arrives, room, [F.lit(seed), F.lit("shard"), F.col("shard")])
    kept = [F.col("row")[c].alias(c) for c in rows.columns if c not in ("shard", "slot")]
    moved = there.select("row", "shard", "slot").repartition("shard", F.call_function("div", F.col("slot"), F.lit(RUN)))
    return moved.sortWithinPartitions("shard", "slot").select(*kept, "shard", "slot")


def summary(found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard), from the rows
    in their shards."""
    own = F.coalesce(F.col(text), F.lit(""))
    return found.select(F.col(doc_id).alias("doc_id"), (F.octet_length(own) + 1).cast("long").alias("size"), F.crc32(own).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
