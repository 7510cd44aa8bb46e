"""Sequence encoding as Column expressions.

A k-mer's code has two bits per base (T 0, G 1, A 2, C 3) with the first base in
the lowest bits. The length is not part of the code: trailing T's are invisible.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bases in the order of their digits, and both sides of the complement
BASES, DIGITS = "TGAC", "0123"
PLAIN, COMPLEMENT = "ACGTacgt", "TGCAtgca"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def encode(seq, wide: bool = False) -> Column:
    """Code of up to 31 bases as BIGINT, or of up to 32 as DECIMAL(20,0) with ``wide``.

    Case-insensitive; a base other than A, C, G, T counts as 0; longer input gives 0.
    """
    s = _col(seq)
    digits = F.reverse(F.translate(F.regexp_replace(F.upper(s), "[^ACGT]", "T"), BASES, DIGITS))
    code = F.when(F.length(s) == 0, F.lit("0")).otherwise(F.conv(digits, 4, 10))
    if wide:
        return F.when(F.length(s) > 32, F.lit(0)).otherwise(code.cast("decimal(20,0)")).cast("decimal(20,0)")
    return F.when(F.length(s) > 31, F.lit(0)).otherwise(code.cast("bigint")).cast("bigint")


def code_bits(seq) -> Column:
    """Code of up to 32 bases as the bits of a BIGINT (negative if the last of 32 bases is A or C)."""
    c = encode(seq, wide=True)
    two64 = F.lit("18446744073709551616").cast("decimal(20,0)")
    half = F.lit("9223372036854775808").cast("decimal(20,0)")
    return F.when(c >= half, c - two64).otherwise(c).cast("bigint")


def decode(code, length) -> Column:
    """Bases of a code; null beyond 32 bases. A negative BIGINT is read as the bits of an unsigned code."""
    n = length if isinstance(length, Column) else F.lit(length)
    c = _col(code).cast("decimal(20,0)")
    c = F.when(c < 0, c + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(c)
    digits = F.lpad(F.conv(c.cast("string"), 10, 4), n, "0")
    return F.when(n > 32, F.lit(None)).when(n == 0, F.lit("")).otherwise(F.reverse(F.translate(digits, DIGITS, BASES)))


def view(seq, start, width: int) -> Column:
    """Code of ``width`` bases from a 0-based start; positions past the end read as T; 0 past the end or beyond 32."""
    s, i = _col(seq), start if isinstance(start, Column) else F.lit(start)
    if width > 32:
        return F.lit(0).cast("decimal(20,0)")
    return F.when(i >= F.length(s), F.lit(0).cast("decimal(20,0)")).otherwise(encode(F.substring(s, i + 1, F.lit(width)), wide=True))


def first_bad_base(seq) -> Column:
    """1-based position of the first base other than A, C, G, T, or 0."""
    s = _col(seq)
    clean = F.length(F.regexp_extract(s, "^[ACGTacgt]*", 0))
    return F.when(clean < F.length(s), clean + 1).otherwise(0)


def reported_bad_base(seq) -> Column:
    """Compatible mode: last bad base inside the first 32-base word that has one, 1-based, or 0."""
    s = _col(seq)
    word = F.floor((first_bad_base(s) - 1) / 32).cast("int")
    text = F.substring(s, word * 32 + 1, F.lit(32))
    after = F.length(F.regexp_extract(text, "[ACGTacgt]*$", 0))
    return F.when(first_bad_base(s) == 0, 0).otherwise(word * 32 + F.length(text) - after).cast("int")


def is_clean(seq) -> Column:
    return ~_col(seq).rlike("[^ACGTacgt]")


def reverse_complement(seq) -> Column:
    """Reverse complement, case kept; other characters below ``Z`` become N, all others n."""
    s = F.reverse(_col(seq))
    s = F.regexp_replace(s, "[\\x00-\\x59&&[^ACGT]]", "N")
    s = F.regexp_replace(s, "[^\\x00-\\x59acgt]", "n")
    return F.translate(s, PLAIN, COMPLEMENT)
