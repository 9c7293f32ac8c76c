"""Sequence functions on string columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Complements, and the bases each IUPAC letter stands for.
BASES, COMPLEMENTS = "ACGTacgtXxNn-", "TGCAtgcaXxNn-"
IUPAC = {
    "A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT",
    "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT",
}


def complement(seq: Column) -> Column:
    """Case is kept; null where a letter has no complement."""
    return F.when(~seq.rlike(f"[^{BASES}]"), F.translate(seq, BASES, COMPLEMENTS))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def collapse(seq: Column, alphabet: str, canonical: str) -> Column:
    """Modified bases become the canonical ones below them in ``canonical``."""
    return F.translate(seq, alphabet, canonical)


def encode(seq: Column, alphabet: str) -> Column:
    """Integer codes; null where a letter is outside the alphabet."""
    codes = F.transform(F.filter(F.split(seq, ""), lambda c: c != ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    return F.when(~F.exists(codes, lambda c: c < 0), codes)


def decode(codes: Column, alphabet: str) -> Column:
    """Letters of integer codes; codes past the alphabet (flops) wrap around."""
    letters = F.array(*[F.lit(c) for c in alphabet])
    return F.array_join(F.transform(codes, lambda c: F.element_at(letters, (c % len(alphabet) + 1).cast("int"))), "")


def has_ambiguity(seq: Column, alphabet: str = "ACGT") -> Column:
    return seq.rlike(f"[^{alphabet}]")


def flatten_ambiguity(seq: Column, alphabet: str = "ACGT", to: str = "N") -> Column:
    return F.regexp_replace(seq, f"[^{alphabet}]", to)


def iupac_regex(motif: str) -> str:
    return "".join(f"[{IUPAC[c]}]" for c in motif)


def motif_offsets(seq: Column, motif: str, skip_last: bool = False) -> Column:
    """Offsets at which the motif matches, overlaps included. One pass of the regex engine marks
    where matches begin; the lengths between the marks add up to the offsets."""
    pieces = F.split(F.regexp_replace(seq, f"(?={iupac_regex(motif)})", "!"), "!")
    lengths = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.length(p))
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("at"))
    step = lambda a, n: F.struct((a["sum"] + n).alias("sum"), F.array_append(a["at"], a["sum"] + n).alias("at"))
    found = F.aggregate(lengths, start, step, lambda a: a["at"])
    return F.filter(found, lambda i: i < F.length(seq) - len(motif)) if skip_last else found


def cigar_total(cigar: Column, op: str) -> Column:
    """Summed lengths of one operation of a CIGAR string."""
    found = F.regexp_extract_all(cigar, F.lit(rf"(\d+){op}"), F.lit(1))
    return F.aggregate(found, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
