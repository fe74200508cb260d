"""Column expressions over sequences and qualities, all built in and evaluated in the JVM.

Counting uses lengths before and after deleting characters, which stays inside whole-stage code generation.
Totals are UTF-8 bytes; single-byte text is assumed where positions matter. A null input gives null.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: NCBI translation table 1, codons in TCAG order. Fixed values.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
#: IUPAC ambiguity codes other than N. Fixed values.
AMBIGUOUS = "RYSWKMBDHV"


def count_of(sequence: Column, letters: str) -> Column:
    """How many characters are among the letters, in either case."""
    both = "".join(dict.fromkeys(letters.upper() + letters.lower()))
    return (F.length(sequence) - F.length(F.translate(sequence, both, ""))).cast("long")


def total_bases(sequence: Column) -> Column:
    return F.octet_length(sequence).cast("long")


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole; 0 where the whole is 0 or missing."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def mean(total: Column, n: Column) -> Column:
    return F.coalesce(F.try_divide(total.cast("double"), n), F.lit(0.0))


def characters(text: Column) -> Column:
    """The characters of a text as an array; empty for an empty text."""
    return F.when(F.length(text) > 0, F.split(text, "")).otherwise(F.array().cast("array<string>"))


def bound(value: Column, use) -> Column:
    """use(value), with the value computed once however often it is read, also where it is itself an expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def complexity(sequence: Column) -> Column:
    """Distinct characters over min(length, 4); 0 for an empty sequence; exceeds 1 for more than four letters."""
    return F.when(F.length(sequence) == 0, F.lit(0.0)).otherwise(F.size(F.array_distinct(F.split(sequence, ""))) / F.least(F.length(sequence), F.lit(4)))


def reverse_complement(sequence: Column) -> Column:
    """Case is kept; whatever isn't A, C, G, T or N becomes N."""
    return F.reverse(F.translate(F.regexp_replace(sequence, "[^ACGTNacgtn]", "N"), "ACGTacgt", "TGCAtgca"))


def kmer_reverse_complement(kmer: Column) -> Column:
    return F.reverse(F.translate(kmer, "ACGT", "TGCA"))


def canonical(kmer: Column) -> Column:
    return F.least(kmer, kmer_reverse_complement(kmer))


def trim_position(sequence: Column, adapter: str, overlap: int) -> Column:
    """1-based place of the first occurrence of the adapter's first `overlap` letters, 0 without one."""
    return F.instr(sequence, adapter[:overlap])


#: Letters of a piece in which windows are cut: a substring is found by walking its text, so texts must be short.
PIECE = 256


def chunks(text: Column, size: int, least: int = 1) -> Column:
    """The text cut into pieces of `size` characters, the last of `least` at least; one pass over the text."""
    return F.regexp_extract_all(text, F.lit(f"[\\s\\S]{{{least},{size}}}"), F.lit(0))


def _windows(text: Column, k: int) -> Column:
    found = F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substring(text, i, F.lit(k)))
    return F.when(F.length(text) >= k, found).otherwise(F.array().cast("array<string>"))


def kmers(sequence: Column, k: int) -> Column:
    """All windows of k characters; empty for a shorter sequence.

    A long sequence is cut into pieces first, each with the k - 1 characters that follow it, so the work is linear.
    """

    def pieced(pieces: Column) -> Column:
        following = lambda i: F.coalesce(F.substring(F.get(pieces, i + 1), F.lit(1), F.lit(k - 1)), F.lit(""))
        return F.flatten(F.transform(pieces, lambda p, i: bound(F.concat(p, following(i)), lambda x: _windows(x, k))))

    return bound(sequence, lambda s: F.when(F.length(s) <= PIECE, _windows(s, k)).otherwise(bound(chunks(s, PIECE), pieced)))


def is_clean(kmer: Column) -> Column:
    """Only A, C, G, T in upper case."""
    return F.translate(kmer, "ACGT", "") == ""


def hamming(a: Column, b: Column) -> Column:
    """Positions that differ, for texts of equal length."""
    apart = F.zip_with(characters(a), characters(b), lambda x, y: (x != y).cast("int"))
    return F.aggregate(apart, F.lit(0).cast("long"), lambda s, x: s + x)


def two_bit_letters(sequence: Column) -> Column:
    """What survives two-bit encoding: upper-case letters, everything else A."""
    return F.regexp_replace(F.upper(sequence), "[^ACGT]", "A")


def issues(checks: dict[str, Column]) -> Column:
    """The names of the checks that fail."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in checks.items()]))


def scale_category(n: Column) -> Column:
    """Size class of a number of reads."""
    names = ["tiny", "small", "medium", "large", "very_large"]
    return reduce(lambda rest, x: F.when(n < x[0], x[1]).otherwise(rest), list(zip([10**3, 10**4, 10**5, 10**6, 10**7], names, strict=True))[::-1], F.lit("huge"))
