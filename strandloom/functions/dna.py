"""Sequence columns: normalisation, complements, transforms and gap removal (JVM expressions only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .config import COMPLEMENT_FROM, COMPLEMENT_TO, AlignConfig


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bound(value: Column, use) -> Column:
    """use(value) with value evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalise(seq) -> Column:
    """Stripped, upper-cased, without spaces."""
    return F.replace(F.upper(F.regexp_replace(_col(seq), r"^\s+|\s+$", "")), F.lit(" "), F.lit(""))


def complement(seq) -> Column:
    """A-T and C-G in either case; every other character, gaps too, stays."""
    return F.translate(_col(seq), COMPLEMENT_FROM, COMPLEMENT_TO)


def reverse_complement(seq) -> Column:
    return F.reverse(complement(seq))


def degap(aligned) -> Column:
    return F.replace(_col(aligned), F.lit("-"), F.lit(""))


def is_dna(seq) -> Column:
    return _col(seq).rlike("^[ACGT]*$")


def hashed_primer(tag: str, key, shortest: int = 16, spread: int = 12) -> Column:
    """A reproducible sequence of shortest .. shortest + spread - 1 bases from the md5 of tag and key."""
    key = _col(key)
    bases = F.translate(F.md5(F.concat(F.lit(tag), key.cast("string"))), "0123456789abcdef", "ACGTACGTACGTACGT")
    return F.substring(bases, F.lit(1), (F.lit(shortest) + F.pmod(key, F.lit(spread))).cast("int"))


def flag_string(*flags) -> Column:
    return F.concat(*[F.when(_col(f), "1").otherwise("0") for f in flags])


SYMMETRIES_2D = ("swap", "reverse", "complement")
SYMMETRIES_3D = ("swap12", "swap13", "swap23", "reverse", "complement")


def transformed(symmetry: str, seqs: list, config: AlignConfig) -> tuple[list[Column], AlignConfig]:
    """Sequences and free-end flags under a symmetry: swaps exchange sequences with their flags, reversal exchanges left and right."""
    seqs = [_col(s) for s in seqs]
    flags = [config.free[2 * k : 2 * k + 2] for k in range(len(seqs))]
    if symmetry.startswith("swap"):
        x, y = (0, 1) if symmetry == "swap" else (int(symmetry[4]) - 1, int(symmetry[5]) - 1)
        seqs[x], seqs[y] = seqs[y], seqs[x]
        flags[x], flags[y] = flags[y], flags[x]
    elif symmetry == "reverse":
        seqs, flags = [F.reverse(s) for s in seqs], [f[::-1] for f in flags]
    elif symmetry == "complement":
        seqs = [complement(s) for s in seqs]
    else:
        raise ValueError(f"unknown symmetry {symmetry!r}")
    return seqs, config.but(free=tuple(x for f in flags for x in f))


def restored(symmetry: str, aligned: list) -> list[Column]:
    """Aligned strings of the transformed problem, mapped back; every symmetry is its own inverse."""
    aligned = [_col(a) for a in aligned]
    if symmetry.startswith("swap"):
        x, y = (0, 1) if symmetry == "swap" else (int(symmetry[4]) - 1, int(symmetry[5]) - 1)
        aligned[x], aligned[y] = aligned[y], aligned[x]
        return aligned
    return [F.reverse(a) if symmetry == "reverse" else complement(a) for a in aligned]


def dimer_swapped(seq1, seq2, config: AlignConfig) -> tuple[Column, Column, AlignConfig]:
    """(p1, rc(p2)) → (p2, rc(p1)), given the second sequence as aligned; flags are read backwards."""
    return reverse_complement(seq2), reverse_complement(seq1), config.but(free=config.free[::-1])


def expected_invariance(symmetry, transpose_symmetric, complement_symmetric, sequences: int) -> Column:
    """Whether scores must agree: swaps need a symmetric matrix, complements a complement-symmetric one; reversal is
    certain for three sequences and left open (null) for two."""
    symmetry = _col(symmetry)
    reversal = F.lit(True) if sequences == 3 else F.lit(None).cast("boolean")
    return F.when(symmetry.startswith("swap"), transpose_symmetric).when(symmetry == "complement", complement_symmetric).otherwise(reversal)
