"""Sequence and mutation notation as Column expressions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC ambiguity codes.
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "U": "U", "R": "AG", "Y": "CT", "S": "GC", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}

#: Three-letter names of amino acids.
AMINO = {"Ala": "A", "Arg": "R", "Asn": "N", "Asp": "D", "Cys": "C", "Gln": "Q", "Glu": "E", "Gly": "G", "His": "H", "Ile": "I", "Leu": "L", "Lys": "K", "Met": "M", "Phe": "F", "Pro": "P", "Ser": "S", "Thr": "T", "Trp": "W", "Tyr": "Y", "Val": "V", "Ter": "*"}

#: The standard genetic code, codons in the order TCAG.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def _map(d: dict) -> Column:
    return F.create_map(*(F.lit(x) for kv in d.items() for x in kv))


def iupac_bases(code: Column) -> Column:
    return F.element_at(_map(IUPAC), F.upper(code))


def complement(sequence: Column) -> Column:
    return F.translate(sequence, "ACGTUacgtu", "TGCAAtgcaa")


def reverse_complement(sequence: Column) -> Column:
    return F.reverse(complement(sequence))


def translate_codons(sequence: Column) -> Column:
    """Amino acids of the whole codons; X for one that isn't known."""
    codes = {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}
    codons = F.regexp_extract_all(F.replace(F.upper(sequence), F.lit("U"), F.lit("T")), F.lit("(...)"), F.lit(1))
    return F.array_join(F.transform(codons, lambda c: F.coalesce(F.element_at(_map(codes), c), F.lit("X"))), "")


#: One-letter codes that a change may name besides the amino acids'.
OTHER_CODES = "XBZJ*?"


def protein_change(hgvs: Column) -> Column:
    """A substitution such as ``p.Val600Glu`` or ``p.V600E`` as ``V600E``; a
    frame shift as ``V600Frameshift``, an insertion, deletion or replacement as
    ``V600Indel``, else null. A residue of three letters on either side of the
    position makes it a substitution, whatever follows. Of shifts and indels in
    three letters the first residue is read too."""
    body = F.regexp_replace(hgvs, r"p\.", "")
    code = lambda name: F.element_at(_map(AMINO), F.initcap(name))
    three = r"(?i)([a-z]{3})(\d+)([a-z]{3})"
    part = lambda i: F.regexp_extract(body, three, i)
    long = F.concat(code(part(1)), part(2), code(part(3)))
    first = F.regexp_extract(body, r"^([A-Za-z]{3})\d", 1)
    short = F.coalesce(long, F.when(code(first).isNotNull(), F.concat(code(first), F.substr(body, F.lit(4)))), body)
    codes = "".join(dict.fromkeys(AMINO.values())) + OTHER_CODES
    one = "[" + codes.replace("*", r"\*").replace("?", r"\?") + "]"
    start = F.nullif(F.regexp_extract(short, rf"^({one}\d+)", 1), F.lit(""))
    return F.when(short.rlike(rf"^{one}\d+{one}"), short).when(short.rlike("fs"), F.concat(start, F.lit("Frameshift"))).when(short.rlike("ins|del|dup|>"), F.concat(start, F.lit("Indel")))


#: A coding change: where it starts and ends, its kind, and what it puts there.
_DNA = r"^.*?(?:(\d+)(?:_(\d+))?)?[ACGTN]*(>|delins|del|ins)([^>]*)$"


def dna_change(hgvs: Column) -> Column:
    """A coding change as its allele: the new base of a substitution, a mark
    ``-`` for each deleted base, ``+`` and the inserted ones; ``?(...)`` for
    what says neither. The size of a replaced range is that from its first to
    its last position."""
    start, end, kind, what = (F.regexp_extract(hgvs, _DNA, i) for i in range(1, 5))
    count, bases = what.try_cast("int"), what.rlike("(?i)^[ACGT]+$")
    of = lambda mark, n: F.repeat(F.lit(mark), n.cast("int"))
    size = F.coalesce(end.try_cast("long") - start.try_cast("long") + 1, F.lit(1))
    allele = (
        F.when(kind == ">", what)
        .when((kind == "delins") & bases, F.concat(of("-", size), what))
        .when((kind == "del") & count.isNotNull(), of("-", count))
        .when((kind == "del") & bases, of("-", F.length(what)))
        .when((kind == "ins") & count.isNotNull(), F.concat(F.lit("+"), of("N", count)))
        .when((kind == "ins") & what.rlike("(?i)^[NACGT]+$"), F.concat(F.lit("+"), what))
    )
    return F.coalesce(allele, F.concat(F.lit("?("), hgvs, F.lit(")")))


def _alleles(text: Column) -> Column:
    parts = F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))
    return F.transform(parts, lambda m: F.when(m == "<DEL>", "-").otherwise(m))


def _shared(reference: Column, alleles: Column) -> Column:
    """How many first bases the reference and all alleles share."""
    same = lambda m: F.size(F.filter(F.sequence(F.lit(0), F.least(F.length(reference), F.length(m))), lambda i: F.left(reference, i) == F.left(m, i))) - 1
    return F.when(F.size(alleles) == 0, F.length(reference)).otherwise(F.array_min(F.transform(alleles, same)))


def _marked(reference: Column, m: Column, other: Column) -> Column:
    """An allele against the reference, both without what they share; marks
    for deleted bases, ``other`` where neither rule holds."""
    gone = F.length(reference) - F.length(m)
    return F.when(F.length(reference) == 0, F.concat(F.lit("+"), m)).when((gone > 0) & ((F.length(m) == 0) | reference.contains(m)), F.repeat(F.lit("-"), gone)).when((F.length(reference) == 1) & (F.length(m) == 1), m).otherwise(other)


def corrected_alleles(position: Column, reference: Column, alleles: Column) -> Column:
    """(position, alleles) without the first bases that the reference and all
    alleles (joined by commas) share: ``+`` and inserted bases, a ``-`` for each
    deleted one, or the new base."""
    ref = F.when(reference == "-", "").otherwise(reference)
    every = _alleles(alleles)
    n = _shared(ref, every)
    rest = F.substr(ref, n + 1)

    def own(m: Column) -> Column:
        m = F.substr(m, n + 1)
        m = F.when(m == "-", "").otherwise(m)
        return _marked(rest, m, F.concat(F.repeat(F.lit("-"), F.length(rest)), m))

    return F.struct((position + n).alias("position"), F.transform(every, own).alias("alleles"))


def corrected_vcf(position: Column, reference: Column, alleles: Column) -> Column:
    """The same for VCF, where the first base stands before the change: the
    position doesn't move past the whole reference, and an allele that is the
    reference is left out."""
    every = _alleles(alleles)
    n = _shared(reference, every)
    rest = F.substr(reference, n + 1)
    ref = F.when(rest == "-", "").otherwise(rest)

    def own(m: Column) -> Column:
        m = F.substr(m, n + 1)
        new = F.when(m == "-", "").otherwise(m)
        other = F.when(F.left(rest, F.lit(1)) == F.left(m, F.lit(1)), F.concat(F.lit("+"), F.substr(m, F.lit(2)))).otherwise(F.concat(F.repeat(F.lit("-"), F.length(rest)), new))
        return F.when(m != rest, _marked(ref, m, other))

    moved = n - F.when((n > 0) & (F.length(rest) == 0), 1).otherwise(0)
    return F.struct((position + moved).alias("position"), F.filter(F.transform(every, own), lambda x: x.isNotNull()).alias("alleles"))


def corrected_icgc(reference: Column, allele: Column) -> Column:
    """Marks for the bases after a ``-``, and ``+`` before bases inserted where
    the reference is ``-``."""
    marks = F.when(allele.rlike("^-[ACGT]"), F.repeat(F.lit("-"), F.length(allele) - 1)).otherwise(allele)
    return F.when(reference == "-", F.concat(F.lit("+"), marks)).otherwise(marks)


def mutation_bed(mutation: Column, prefix: str | None = "remove") -> Column:
    """``chr:pos:allele`` as a struct of chromosome, start (from 0) and end. An
    insertion spans its bases and one more, a deletion its marks but one,
    another allele its bases. ``prefix``: add, remove or leave ``chr``."""
    p = F.split(mutation, ":")
    name, allele, at = F.get(p, F.lit(0)), F.get(p, F.lit(2)), F.get(p, F.lit(1)).try_cast("long")
    size = F.when(allele.isNull(), 1).when(allele.startswith("+"), F.length(allele)).when(allele.startswith("-"), F.length(allele) - 1).otherwise(F.length(allele))
    bare = F.regexp_replace(name, "^chr", "")
    shown = bare if prefix == "remove" else F.concat(F.lit("chr"), bare) if prefix == "add" else name
    return F.struct(shown.alias("chr"), (at - 1).alias("start"), (at - 1 + size).alias("end"))


def archive_host(organism: Column) -> Column:
    """The host of ``species/date``'s archive, or the current one."""
    date = F.nullif(F.get(F.split(organism, "/"), F.lit(1)), F.lit(""))
    return F.when(date.isNull(), "www.ensembl.org").otherwise(F.concat(date, F.lit(".archive.ensembl.org")))


def chromosome_rank(name: Column) -> Column:
    """Numbers in numeric order; Y ties with 22, X is 23, M (or MT) 24."""
    bare = F.upper(F.regexp_replace(name, "^chr", ""))
    return F.coalesce(bare.try_cast("int"), F.when(bare == "X", 23).when(bare == "Y", 22).when(bare.isin("M", "MT"), 24), F.lit(99))


def _aligned(query: str, target: str, match: int, mismatch: int, gap: int) -> tuple:
    """Score, ends (from 0, excluded) and the pairs of aligned positions of the
    best local alignment; each row of the table is one array operation."""
    a, b = np.frombuffer(query.encode("utf-32-le"), "<u4"), np.frombuffer(target.encode("utf-32-le"), "<u4")
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    slope = gap * np.arange(len(b) + 1)
    for i in range(1, len(a) + 1):
        best = np.maximum(table[i - 1, :-1] + np.where(b == a[i - 1], match, -mismatch), table[i - 1, 1:] - gap)
        row = np.concatenate(([0], np.maximum(best, 0)))
        table[i] = np.maximum.accumulate(row + slope) - slope
    i, j = np.unravel_index(table.argmax(), table.shape)
    score, end, pairs = int(table[i, j]), (int(i), int(j)), []
    while table[i, j]:
        if table[i, j] == table[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else -mismatch):
            i, j = i - 1, j - 1
            pairs.append((int(i), int(j)))
        elif table[i, j] == table[i - 1, j] - gap:
            i -= 1
        else:
            j -= 1
    return score, int(i), end[0], int(j), end[1], pairs[::-1]


def local_alignment(query: Column, target: Column, match: int = 2, mismatch: int = 2, gap: int = 3, least: int = 1) -> Column:
    """The best local alignment (Smith-Waterman, a gap costs the same a
    place): score, q_start, q_end, t_start, t_end, pairs of positions, and
    percent of the query that is aligned to equal letters. Below ``least``
    the pairs are empty; null with null."""
    fields = "score int, q_start int, q_end int, t_start int, t_end int, pairs array<struct<q: int, t: int>>, percent double"

    @F.pandas_udf(fields)
    def align(q: pd.Series, t: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(q, t):
            if x is None or y is None:
                out.append((None,) * 7)
                continue
            *ends, pairs = _aligned(x, y, match, mismatch, gap)
            same = sum(x[i] == y[j] for i, j in pairs)
            out.append((*ends, [{"q": i, "t": j} for i, j in pairs] if ends[0] >= least else [], 100.0 * same / len(x) if x else 0.0))
        return pd.DataFrame(out, columns=["score", "q_start", "q_end", "t_start", "t_end", "pairs", "percent"])

    return align(query, target)
