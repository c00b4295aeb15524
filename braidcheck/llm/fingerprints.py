"""Document fingerprints: every shingle hash below a fixed share of the hash space.

Two fingerprints of texts of any lengths can be compared, and the fingerprint of a whole is the
union of its parts' fingerprints, because what is kept depends on the hash alone. The least hash of a text is
always kept, so no text that has words has an empty fingerprint; a union drops those that are above the bound and no longer the
least. Everything here is built-in column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, table

WORDS = 5
#: One shingle hash in so many is kept.
KEPT_OF = 4
#: Documents are dealt to ranges of ids, of about RANGE_ROWS rows, in which each looks for the next one. Quantiles give the first MOST_CUTS ranges;
#: beyond, each of those is cut into equal parts.
LEAST_RANGES, MOST_CUTS, RANGE_ROWS = 64, 4096, 20_000
#: Rows of one per range that are broadcast at most; beyond, they are joined.
MOST_BROADCAST = 100_000

_BLANKS = "[ \\t\\n\\x0B\\f\\r]+"


def fingerprint(text: Column, words: int = WORDS, kept_of: int = KEPT_OF) -> Column:
    """Sorted distinct kept hashes of a text's shingles of `words` words; a shorter text is one shingle; none without words.

    Words part at ASCII white space, A-Z are lower-cased, a null text is empty. The hash of a
    shingle is made of those of its words.
    """
    parts = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), _BLANKS), lambda w: w != "")
    hashed = F.transform(parts, lambda w: F.xxhash64(w))

    def run(h: Column) -> Column:
        whole = F.array(F.xxhash64(h, F.size(h)))
        at = F.sequence(F.lit(0), F.size(h) - words)
        each = F.transform(at, lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).when(F.size(h) < words, whole).otherwise(each)

    # A one-element transform binds the hashes of the words once.
    shingles = F.get(F.transform(F.array(hashed), run), F.lit(0))
    return F.get(F.transform(F.array(shingles), lambda all_: _kept(F.array_distinct(all_), kept_of)), F.lit(0))


def _kept(hashes: Column, kept_of: int) -> Column:
    bound = F.lit(-(1 << 63) + (1 << 64) // kept_of)
    return F.get(F.transform(F.array(F.array_min(hashes)), lambda least: F.array_sort(F.filter(hashes, lambda x: (x < bound) | (x == least)))), F.lit(0))


def shared(a: Column, b: Column) -> Column:
    """The number of hashes that two fingerprints share."""
    return F.size(F.array_intersect(a, b))


def resemblance(a: Column, b: Column) -> Column:
    """Estimated share of common shingles among all of both texts, 0 to 1; two texts without words are alike: 1."""
    both = shared(a, b)
    return F.when(F.size(a) + F.size(b) == 0, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has, 0 to 1, whatever their lengths; 0 if a's fingerprint is empty."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(shared(a, b) / F.size(a))


def merge(a: Column, b: Column, kept_of: int = KEPT_OF) -> Column:
    """The fingerprint of two texts together (without the shingles across their border)."""
    return _kept(F.array_union(a, b), kept_of)


def encoded(fp: Column) -> Column:
    """A fingerprint as text: the hashes in hexadecimal, in order."""
    return F.array_join(F.transform(fp, lambda x: F.hex(x)), " ")


def with_next(docs: DataFrame, key: str, take: list[str], enrich=lambda df: df) -> DataFrame:
    """Each row, enriched, with `next`, the struct of `take` of the row with the next smaller key; the least key's next is the greatest.

    Rows are dealt to ranges of the key, so no task sees the whole order; a copy of the first row of each range, by which only keys
    travel ahead, is dealt to the range above it as the last. Of rows with one key, one follows the other; those without a key come after the
    least, and `next` is null where no row with a key follows. Without rows there are none.
    """
    told = docs.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("least"), F.max(key).alias("most")).first()
    ranges = max(LEAST_RANGES, told["n"] // RANGE_ROWS)
    first = min(MOST_CUTS, ranges)
    quantiles = docs.select(F.percentile_approx(key, [i / first for i in range(1, first)], 10 * first).alias("q")).first()["q"] or []
    cuts = sorted({int(c) for c in quantiles} - {told["least"]})
    edges = [told["least"] or 0, *cuts, (told["most"] or 0) + 1]
    parts, bound = -(-ranges // first), F.array(*[F.lit(e) for e in edges]).cast("array<bigint>")
    cell = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c <= F.col(key)))
    # The place in the cell, as a share; whole numbers of any size would not hold the product.
    share = (F.col(key) - F.get(bound, cell)).cast("double") / (F.get(bound, cell + 1) - F.get(bound, cell)).cast("double")
    part = F.least(F.lit(parts - 1), F.floor(share * parts)) if parts > 1 else F.lit(0)
    at = F.when(F.col(key).isNull(), 0).otherwise(cell * parts + part).cast("long")
    dealt = docs.withColumn("_range", at)
    # A row a range: its greatest key, and in the order of ranges the head of the range below, for the lowest that of the highest.
    line = Window.orderBy(F.col("_range").desc())
    ring = dealt.groupBy("_range").agg(F.max(key).alias("_head"))
    ring = ring.select(F.coalesce(F.lead("_head").over(line), F.first("_head").over(line)).alias(key), F.col("_range").alias("_to"))
    heads = docs.join(F.broadcast(ring) if ranges <= MOST_BROADCAST else ring, key).dropDuplicates(["_to"]).withColumnRenamed("_to", "_range")
    both = dealt.withColumn("_over", F.lit(False)).unionByName(heads.withColumn("_over", F.lit(True)))
    order = Window.partitionBy("_range").orderBy("_over", F.col(key).desc())
    return enrich(both).withColumn("next", F.lead(F.struct(*take)).over(order)).where("not _over").drop("_range", "_over")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, held_in_edited of every row of documents.

    A null text is empty. Rows that repeat a doc_id follow each other in any order. Rows without doc_id come after the least one; a text that no row with
    a doc_id follows is followed by an empty one. Texts of any length are whole; an empty table gives no rows; other columns are not read.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    paired = with_next(docs, "doc_id", ["text", "fp"], lambda df: df.withColumn("fp", fingerprint(F.col("text"))))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    after, none = F.coalesce("next.text", F.lit("")), F.array().cast("array<bigint>")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(after, F.lit(1), third))
    out = paired.select("doc_id", n.cast("long").alias("n_chars"), "fp", F.coalesce("next.fp", none).alias("next_fp"), edited.alias("edited"))
    out = out.withColumn("edited_fp", fingerprint(F.col("edited")))
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        encoded(F.col("fp")).alias("fingerprint"),
        encoded(F.col("edited_fp")).alias("edited_fingerprint"),
        resemblance(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        resemblance(F.col("fp"), F.col("next_fp")).alias("near_next"),
        containment(F.col("fp"), F.col("edited_fp")).alias("held_in_edited"),
    )
