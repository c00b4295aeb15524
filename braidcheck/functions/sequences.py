"""Nucleotide and record-field functions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The alphabet, and the complements of the letters whose complement is another one.
ALPHABET = "ACGTRYSWKMBDHVN"
LETTERS = "ACGTRYKMBDHVacgtrykmbdhv"
COMPLEMENTS = "TGCAYRMKVHDBtgcayrmkvhdb"
LARGEST = "18446744073709551615"

_NOT_IN_ALPHABET = f"[^{ALPHABET}{ALPHABET.lower()}]"


def invalid_position(sequence: Column) -> Column:
    """1-based place of the first letter outside the alphabet; null if there is none."""
    at = F.regexp_instr(sequence, F.lit(f"({_NOT_IN_ALPHABET})"))
    return F.when(at > 0, at.cast("long"))


def invalid_symbol(sequence: Column) -> Column:
    symbol = F.regexp_extract(sequence, f"({_NOT_IN_ALPHABET})", 1)
    return F.when(symbol != "", symbol)


def is_valid(sequence: Column) -> Column:
    return ~sequence.rlike(_NOT_IN_ALPHABET)


def ambiguous_bases(sequence: Column) -> Column:
    """Letters that are not A, C, G or T."""
    return F.length(F.translate(sequence, "ACGTacgt", "")).cast("long")


def complement(sequence: Column) -> Column:
    return F.translate(sequence, LETTERS, COMPLEMENTS)


def oriented(sequence: Column, orientation: Column) -> Column:
    """A segment as a traversal reads it."""
    return F.when(orientation == "-", complement(F.reverse(sequence))).otherwise(sequence)


def segment_position(orientation: Column, index0: Column, length: Column) -> Column:
    """1-based place in the segment as stored, of a 0-based place as read."""
    return F.when(orientation == "-", length - index0).otherwise(index0 + 1).cast("long")


def number(text: Column) -> Column:
    """A whole text of digits as a number of 64 bits without sign; else null."""
    bare = F.ltrim(text, F.lit("0"))
    digits = F.concat(F.lit("0"), bare).try_cast("decimal(21,0)")
    return F.when(text.rlike("\\A[0-9]+\\z") & (F.length(bare) <= 20) & (digits <= F.lit(LARGEST).cast("decimal(21,0)")), digits)


def segment_key(name: Column) -> Column:
    """Names that are positive numbers have one key however they are written; the prefix keeps both kinds apart."""
    bare = F.ltrim(name, F.lit("0"))
    # number() as text: as many digits as the largest has compare like numbers.
    small = (F.length(bare) < len(LARGEST)) | ((F.length(bare) == len(LARGEST)) & (bare <= LARGEST))
    return F.when((F.translate(name, "0123456789", "") == "") & (bare != "") & small, F.concat(F.lit("#"), bare)).otherwise(F.concat(F.lit("$"), name))


def path_steps(text: Column) -> Column:
    """Steps of a P record as array of (segment, orientation); null if malformed."""
    parts = F.split(text, ",", -1)
    ok = F.forall(parts, lambda t: (F.length(t) >= 2) & F.right(t, F.lit(1)).isin("+", "-"))
    steps = F.transform(parts, lambda t: F.struct(F.substring(t, F.lit(1), F.length(t) - 1).alias("segment"), F.right(t, F.lit(1)).alias("orientation")))
    return F.when(ok, steps)


def walk_steps(text: Column) -> Column:
    """Steps of a W record; an empty text has none, a malformed one is null."""
    bad = text.rlike("\\A[^><]|[><](?:[><]|\\z)")
    parts = F.filter(F.split(text, "(?=[><])", -1), lambda t: t != "")
    steps = F.transform(parts, lambda t: F.struct(F.substring(t, F.lit(2), F.length(t)).alias("segment"), F.when(F.startswith(t, F.lit("<")), "-").otherwise("+").alias("orientation")))
    return F.when(~bad, steps)


def blunt(overlaps: Column, steps: Column) -> Column:
    """`*`, or for more than one step as many `0M` as there are joints."""
    parts = F.split(overlaps, ",", -1)
    return (overlaps == "*") | ((F.size(steps) > 1) & (F.size(parts) == F.size(steps) - 1) & F.forall(parts, lambda t: t == "0M"))


def mapped_identifier(raw: Column, mode: Column, sample: Column, haplotype: Column, prefix: Column) -> Column:
    return F.when(mode == "pansn", F.concat_ws("#", sample, haplotype, raw)).when(mode == "prefix", F.concat(prefix, raw)).otherwise(raw)


def sha256(sequence: Column) -> Column:
    return F.sha2(F.upper(sequence), 256)


def percentage(count: Column, total: Column) -> Column:
    return F.when(total > 0, 100.0 * count / total)


def ordered_concat(order: list[Column], text: Column) -> Column:
    """Aggregate: the texts of a group joined in the given order."""
    names = [f"k{i}" for i in range(len(order))]
    rows = F.sort_array(F.collect_list(F.struct(*[c.alias(n) for c, n in zip(order, names)], text.alias("t"))))
    return F.array_join(rows["t"], "")
