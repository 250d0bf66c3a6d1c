"""Near-duplicate detection by SimHash with pigeonring filtering.

Each text gets a 64-bit fingerprint; equal fingerprints are one node. Two
fingerprints that differ in at most ``BITS`` bits, seen as a ring of four
segments, have a segment from which every chain of consecutive segments stays
within its proportional share of ``BITS``: none in the first, at most one in
the first two, two in the first three. The candidate join is on the first two
links of that chain (one side lists its second segment with each single bit
flipped), the third is checked in the join condition, and only then is the
whole distance. A dense cluster isn't paired in full: see ``linked``. Components come from alternating star contractions.

Results by case: a null text or one without a word has fingerprint zero, and is
linked like any other; repeated rows share a fingerprint and a component; an
empty table gives an empty one; other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import materialize
from keyloom.llm.vectext import blocks

SHINGLE = 3
BITS = 3
SEED = 42
SEGMENTS = 4
WIDTH = 64 // SEGMENTS

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingle_hashes(text: str, words: int = SHINGLE) -> np.ndarray:
    """One hash for each run of so many words, with repeats; a shorter text is
    one run, an empty one has none. Each hash is eight bytes, high ones first."""
    raw = b" ".join(text.encode("utf-8").translate(_LOWER).split())
    if not raw:
        return np.zeros((0, 8), np.uint8)
    blanks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
    starts = [0, *(blanks + 1).tolist()]
    ends = [*blanks.tolist(), len(raw)]
    spans = zip(starts[: len(starts) - words + 1], ends[words - 1 :]) if len(starts) > words else [(0, len(raw))]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(raw[a:b], SEED) for a, b in spans]), np.uint8).reshape(-1, 8)


def fingerprint(text: str, words: int = SHINGLE) -> int:
    """The fingerprint of one text, as an unsigned number."""
    return majority(shingle_hashes(text, words))


def majority(hashes: np.ndarray) -> int:
    """Of hashes as eight bytes each: the bits that over half of them have."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255):  # sums of 255 bits fit a byte
        ones += np.unpackbits(hashes[at : at + 255], axis=1).sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprints(df: DataFrame, key: str, text: str, words: int = SHINGLE) -> DataFrame:
    """key, and as ``fp`` the fingerprint's 64 bits in a long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t or "", words) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=[batch.schema.names[0], "fp"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, fp long")


def _rotated(fp, segment: int):
    """The ring read from the given segment on."""
    n = segment * WIDTH
    return F.shiftleft(fp, n).bitwiseOR(F.shiftrightunsigned(fp, 64 - n)) if n else fp


def _chains(nodes: DataFrame, bits: int) -> DataFrame:
    """node, turn, ring (read from that segment on) and head, its first two
    segments: four rows a node."""
    if not 0 <= bits <= 7:
        raise ValueError("chains of two segments are enumerated for budgets of up to 7 bits")
    ring = nodes.select("node", F.posexplode(F.array(*[_rotated(F.col("fp"), s) for s in range(SEGMENTS)])).alias("turn", "ring"))
    return ring.select("node", "turn", "ring", F.shiftrightunsigned("ring", 64 - 2 * WIDTH).alias("head"))


def _flipped(chains: DataFrame, bits: int, *more: str) -> DataFrame:
    heads = F.array(*[F.col("head").bitwiseXOR(F.lit(m).cast("long")) for m in _flips(bits)])
    return chains.select(F.col("node").alias("a"), F.col("ring").alias("ring_a"), "turn", F.explode(heads).alias("head"), *(F.col(c).alias(f"{c}_a") for c in more))


def _near(bits: int):
    """The third link of a chain, and then the whole distance."""
    apart = F.col("ring_a").bitwiseXOR(F.col("ring_b"))
    return (F.bit_count(F.shiftrightunsigned(apart, 64 - 3 * WIDTH)) <= 3 * bits // SEGMENTS) & (F.bit_count(apart) <= bits)


def links(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs a < b of nodes (``node``, distinct ``fp``) whose fingerprints
    differ in at most ``bits`` bits."""
    chains = _chains(nodes, bits)
    right = chains.select(F.col("node").alias("b"), F.col("ring").alias("ring_b"), "turn", "head")
    pairs = _flipped(chains, bits).join(right, ["turn", "head"]).where((F.col("a") < F.col("b")) & _near(bits))
    return pairs.select("a", "b").distinct()


def met(nodes: DataFrame, bits: int) -> DataFrame:
    """Pairs (a, b) of nodes (``node``, ``n``, ``fp``) whose fingerprints differ
    in at most ``bits`` bits, with their ``n_a`` and ``n_b``; some occur twice.

    The ring has ``bits + 1`` segments, so a chain's first link is equal, its
    second differs in one bit at most and its third brings that to two: a node
    asks for one head a turn, and that with each bit of its second segment
    flipped. It meets one node of each head, so no dense cluster is paired in
    full; what only another node of that head is near to isn't found here."""
    m = bits + 1
    if not 4 <= m <= 16:
        raise ValueError("budgets of 3 to 15 bits are enumerated")
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    heads, asked, thirds = [], [], []
    for s in range(m):
        first, second, third = (widths[(s + i) % m] for i in range(3))
        at = sum(widths[:s])
        turned = F.shiftleft("fp", at).bitwiseOR(F.shiftrightunsigned("fp", 64 - at)) if at else F.col("fp")
        head = F.shiftrightunsigned(turned, 64 - first - second).bitwiseOR(F.lit(s << 58))
        heads.append(head)
        asked += [head, *(head.bitwiseXOR(F.lit(1 << i)) for i in range(second))]
        ones = sum(1 << (63 - (at + i) % 64) for i in range(first + second + third))
        thirds.append(F.lit(ones - (ones >> 63 << 64)))
    order = F.struct(F.xxhash64("fp", "head").alias("h"), "fp", "node", "n")
    centres = nodes.select("fp", "node", "n", F.explode(F.array(*heads)).alias("head")).groupBy("head").agg(F.min(order).alias("c"))
    asking = nodes.select("fp", F.explode(F.array(*asked)).alias("head")).withColumnRenamed("fp", "fp_a")
    apart = F.col("fp_a").bitwiseXOR(F.col("c.fp"))
    third = F.element_at(F.array(*thirds), (F.shiftrightunsigned("head", 58) + 1).cast("int"))
    near = (F.bit_count(apart) <= bits) & (F.bit_count(apart.bitwiseAND(third)) <= 2)
    pairs = asking.join(centres, "head").where(near).select("fp_a", F.col("c.node").alias("b"), F.col("c.n").alias("n_b")).distinct()
    # A fingerprint that several nodes share has asked for all of them.
    return pairs.join(nodes.select(F.col("fp").alias("fp_a"), F.col("node").alias("a"), F.col("n").alias("n_a")), "fp_a").where("a <> b").select("a", "n_a", "b", "n_b")


def linked(nodes: DataFrame, bits: int = BITS) -> DataFrame:
    """(node, root) of the nodes that have a link, without all pairs of a dense
    cluster: first each node is held against one of those that share its head,
    then only what is still in different components is paired."""
    chains = _chains(nodes, bits)
    centres = chains.groupBy("turn", "head").agg(F.min(F.struct(F.xxhash64("node").alias("h"), "node", "ring")).alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = chains.join(centres.select("turn", "head", F.col("c.node").alias("b"), F.col("c.ring").alias("ring_b")), ["turn", "head"])
    first = first.withColumnRenamed("ring", "ring_a").where((F.col("node") != F.col("b")) & (F.bit_count(F.col("ring_a").bitwiseXOR(F.col("ring_b"))) <= bits))
    edges = materialize(first.select(F.least("node", "b").alias("a"), F.greatest("node", "b").alias("b")).distinct(), "links")
    found = materialize(components(edges), "roots")
    placed = materialize(chains.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")), "chains")
    # A head whose nodes are all in the asking node's component has nothing new
    # for it. At others the largest component's nodes meet only the rest, and
    # the rest all, so no component is paired with itself for a few strangers.
    sizes = placed.groupBy("turn", "head", "root").agg(F.count(F.lit(1)).alias("n"))
    bounds = sizes.groupBy("turn", "head").agg(F.max(F.struct("n", "root"))["root"].alias("major"), F.count(F.lit(1)).alias("several"))
    asking = _flipped(placed, bits, "root").join(bounds, ["turn", "head"]).where((F.col("several") > 1) | (F.col("major") != F.col("root_a")))
    asking = asking.withColumn("of_major", F.explode(F.when(F.col("root_a") == F.col("major"), F.array(F.lit(False))).otherwise(F.array(F.lit(True), F.lit(False)))))
    right = placed.join(bounds, ["turn", "head"]).select(F.col("node").alias("b"), F.col("ring").alias("ring_b"), "turn", "head", F.col("root").alias("root_b"), (F.col("root") == F.col("major")).alias("of_major"))
    more = asking.join(right, ["turn", "head", "of_major"]).where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & _near(bits)).select("a", "b").distinct()
    return components(edges.unionByName(more))


def _flips(bits: int) -> list[int]:
    """Masks over the first two segments within the chain's budgets: up to
    ``bits // 4`` bits in the first, ``2 * bits // 4`` in both."""
    from itertools import combinations

    out = [0]
    for n in range(1, 2 * bits // SEGMENTS + 1):
        for at in combinations(range(2 * WIDTH), n):
            if sum(i >= WIDTH for i in at) <= bits // SEGMENTS:
                out.append(sum(1 << i for i in at))
    return out


def components(edges: DataFrame) -> DataFrame:
    """Of each node in an edge (a, b): the smallest node it is connected to,
    as (node, root)."""

    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    was = state(edges)
    while was[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Larger neighbours move to the smallest one,
        large = both.where("b > a").join(low, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        # and of the smaller ones the smallest takes the others.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b")).where("a <> b").distinct()
        edges = materialize(small, "edges", instead_of=edges)
        now = state(edges)
        if now == was:
            break
        was = now
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).groupBy("node").agg(F.min("root").alias("root"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """key, fingerprint (hexadecimal), component_id: the smallest key that
    links lead to. A row without a key has a fingerprint too, and the component
    of the rows that share it, or none (null) where all of these are without a
    key; such a fingerprint links nothing."""
    prints = materialize(fingerprints(df, key, text, words), "fingerprints")
    nodes = materialize(prints.groupBy("fp").agg(F.min(key).alias("node")), "nodes")
    roots = linked(nodes.where("node is not null"), bits)
    named = nodes.join(roots, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"))
    return prints.join(named, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows without all but the first (by key) of each group of near
    copies: candidates by SimHash and, for those too far apart in bits, by
    MinHash, all of them compared by Jaccard similarity. A key may stand on
    several texts: each is kept or dropped by itself. Rows with a null key stay."""
    from keyloom.llm import near_copies

    # Used three times; it would be joined anew each time.
    groups = materialize(near_copies.groups(df.where(F.col(key).isNotNull()), key, text), "groups")
    copies = groups.where((F.col("component_id") != F.col(key)) | (F.col("first_row") != F.col("row"))).select(F.col(key).alias("_of"), F.col("row").alias("_is"))
    out = df.join(copies, (F.col(key) == F.col("_of")) & (F.xxhash64(text) == F.col("_is")), "left_anti")
    repeated = groups.groupBy(key, "row").count().where("count > 1").limit(1).count()
    if not repeated:
        return out
    return out.where(F.col(key).isNotNull()).dropDuplicates([key, text]).unionByName(out.where(F.col(key).isNull()))
