"""Near-duplicate documents: universal hash minima, banding, verification on whole sets, components.

Documents with the same set of shingles form a class, and only one of a class goes
through the search. Within a bucket of a band, members are first compared with the
bucket's least member. Components of these links already join most of a bucket;
only members of different components are compared with each other after that. So a
bucket that holds a third of all documents costs a comparison per member, and still
no link between two components goes unseen.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, discard, id_or_null, identified, lean, settle, shared_dir, table, written
from .components import connected_components
from .hashing import mix, shingle_hashes, text_bytes, word_hashes

WORDS = 5
#: Links need PERCENT * union <= 100 * intersection.
PERCENT = 75
#: A pair at similarity 0.75 misses all bands with probability (1 - 0.75**5)**48 = 2e-6.
BANDS, ROWS = 48, 5
#: Of BANDS * ROWS low bits of the minima, a pair at 0.75 shares 210 on average, 5.1 its deviation.
LEAST_BITS = 180
#: A sharper sketch of the documents that share a bucket: two bits of each of FINE more minima. A pair at 0.75 agrees in 832 on
#: average, 12.5 its deviation; fewer than LEAST_FINE is 4.5 deviations less.
FINE, LEAST_FINE = 1024, 776
#: Members of a bucket or partners of a document that one task compares.
CHUNK = 2048
#: Shingles hashed at once.
SLAB = 200_000

_A = mix(np.arange(1, BANDS * ROWS + FINE + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)) | np.uint64(1)
_B = mix(np.arange(1, BANDS * ROWS + FINE + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))

_EVEN = np.uint64(0x5555555555555555)

SKETCH = "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>, bits array<long>"


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles."""
    return np.unique(shingle_hashes(word_hashes(text_bytes(text)), words))


def minima(sets: list[np.ndarray], first: int = 0, end: int = BANDS * ROWS) -> np.ndarray:
    """(sets, end - first) least values of (a * x + b) mod 2**64, upper half; sets must not be empty."""
    out = np.empty((len(sets), end - first), dtype=np.uint32)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint64)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
    for k in range(end - first):
        out[:, k] = np.minimum.reduceat(x * _A[first + k] + _B[first + k], starts) >> np.uint64(32)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """(sets, BANDS) 64-bit keys of the minima of each band."""
    rows = low.reshape(len(low), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(mix(np.arange(BANDS, dtype=np.uint64)), rows.shape[:2])
    for k in range(ROWS):
        keys = mix(keys ^ rows[:, :, k] * np.uint64(0x9E3779B97F4A7C15))
    return keys


def low_bits(low: np.ndarray) -> np.ndarray:
    """(sets, 4) numbers that hold the low bit of each minimum, 60 each."""
    bits = (low & 1).astype(np.uint64).reshape(len(low), 4, -1)
    return (bits << np.arange(bits.shape[2], dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def fine_bits(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, FINE / 32) numbers that hold the two low bits of each of FINE minima."""
    low = (minima(sets, BANDS * ROWS, BANDS * ROWS + FINE) & 3).astype(np.uint64).reshape(len(sets), FINE // 32, 32)
    return (low << np.arange(0, 64, 2, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def with_fine_bits(pool: DataFrame) -> DataFrame:
    """(id, fine) of pool (id, text); all have shingles."""

    @lean
    def run(batches):
        for pdf in batches:
            sets = ((d, shingle_set(t)) for d, t in zip(pdf["id"].tolist(), pdf["text"].tolist()))
            for some in _slabs(sets, lambda x: len(x[1])):
                yield pd.DataFrame({"id": [d for d, _ in some], "fine": list(fine_bits([s for _, s in some]).view(np.int64))})

    return pool.select("id", "text").mapInPandas(run, "id long, fine array<long>")


def _slabs(items, size):
    held, n = [], 0
    for item in items:
        held.append(item)
        n += size(item)
        if n >= SLAB:
            yield held
            held, n = [], 0
    if held:
        yield held


def sketches(docs: DataFrame) -> DataFrame:
    """One row per document; without words n_shingles is 0 and the rest is of no use."""

    @lean
    def run(batches):
        for pdf in batches:
            sets = ((d, shingle_set(t)) for d, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()))
            for some in _slabs(sets, lambda x: len(x[1])):
                full = [x for x in some if len(x[1])]
                rows = [(d, 0, 0, 0, None, None) for d, s in some if not len(s)]
                if full:
                    low = minima([s for _, s in full])
                    keys, bits = band_keys(low).view(np.int64), low_bits(low).view(np.int64)
                    for (d, s), k, b in zip(full, keys, bits, strict=True):
                        f = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                        rows.append((d, len(s), int.from_bytes(f[:8], "little", signed=True), int.from_bytes(f[8:], "little", signed=True), k, b))
                yield pd.DataFrame(rows, columns=["doc_id", "n_shingles", "fp1", "fp2", "bands", "bits"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(run, SKETCH)


def likely(a: str, b: str):
    """Whether the sizes and low bits of two sketches allow a link."""
    size = f"100 * least({a}.n, {b}.n) >= {PERCENT} * greatest({a}.n, {b}.n)"
    same = " + ".join(f"bit_count({a}.bits[{i}] ^ {b}.bits[{i}])" for i in range(4))
    return F.expr(f"{size} and {BANDS * ROWS} - ({same}) >= {LEAST_BITS}")


def verified(pairs: DataFrame, pool: DataFrame, folder: str) -> DataFrame:
    """Those of the distinct pairs (u, v) whose whole sets are similar enough.

    pool has the texts (id, text). The partners of a u meet in tasks of about CHUNK each, to
    each of which the text of u is sent ahead of theirs; a task holds one text of a u at a time.
    """
    parts = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")).select("u", F.ceil(F.col("n") / CHUNK).cast("int").alias("parts"))
    parts = written(parts, folder, "parts")  # so that the join can split a u with very many partners
    met = pairs.withColumnRenamed("u", "first").join(parts.withColumnRenamed("u", "first"), "first")
    right = met.select(F.col("first").alias("u"), F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"), F.col("v").alias("id"))
    left = parts.select("u", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("u").alias("id"))
    rows = left.union(right).join(pool, "id").select("u", "part", (F.col("u") != F.col("id")).alias("other"), "id", "text")

    @lean
    def run(batches):
        now, held = None, None
        for pdf in batches:
            u, v = [], []
            for a, part, other, b, text in zip(pdf["u"].tolist(), pdf["part"].tolist(), pdf["other"].tolist(), pdf["id"].tolist(), pdf["text"].tolist()):
                own = shingle_set(text)
                if not other:
                    now, held = (a, part), own
                    continue
                if now != (a, part):
                    raise ValueError(f"the text of document {a} did not come ahead of its partners")
                both = np.count_nonzero(held[np.minimum(np.searchsorted(held, own), len(held) - 1)] == own)
                if 100 * both >= PERCENT * (len(held) + len(own) - both):
                    u.append(a)
                    v.append(b)
            yield pd.DataFrame({"u": u, "v": v}, dtype="int64")

    return rows.repartition("u", "part").sortWithinPartitions("u", "part", "other").mapInPandas(run, "u long, v long")


def rest_pairs(members: DataFrame, sketch: DataFrame) -> DataFrame:
    """Likely pairs within buckets of members (key, id, component) that have several components.

    Each bucket's largest component only answers: the members of the others go to every chunk
    of the bucket and are compared there with its members of other components, in blocks.
    sketch has id, n and fine, which ends with the document's band keys: a pair comes out of the first bucket that it shares alone.
    """
    size = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    whole = size.groupBy("key").agg(F.count(F.lit(1)).alias("parts"), F.sum("n").alias("n"), F.max_by("component", F.struct("n", "component")).alias("largest")).where("parts > 1")
    rows = members.join(whole.select("key", "largest", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "key").join(sketch, "id")
    right = rows.select("key", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("side"), "id", "component", "n", "fine")
    left = rows.where("component <> largest").select("key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), "id", "component", "n", "fine")

    def compared(key, query, chunk):
        """Pairs of a block of queries with the members of a chunk."""
        (q_id, q_n, q_of, q_bits), (c_id, c_n, c_of, c_bits) = query, chunk
        (q_bits, q_bands), (c_bits, c_bands) = ((x[:, : FINE // 32], x[:, FINE // 32 :]) for x in (q_bits, c_bits))
        key = np.int64(key).view(np.uint64)
        u, v = [], []
        for i in range(len(q_id)):
            x = c_bits ^ q_bits[i]
            same = FINE - np.bitwise_count((x | x >> np.uint64(1)) & _EVEN).sum(axis=1, dtype=np.int64)
            ok = (c_of != q_of[i]) & (same >= LEAST_FINE) & (100 * np.minimum(c_n, q_n[i]) >= PERCENT * np.maximum(c_n, q_n[i]))
            on = np.flatnonzero(ok)
            first = q_bands[i][(c_bands[on] == q_bands[i]).argmax(axis=1)]
            found = c_id[on[first == key]]
            u += np.minimum(found, q_id[i]).tolist()
            v += np.maximum(found, q_id[i]).tolist()
        return pd.DataFrame({"u": u, "v": v}, dtype="int64").drop_duplicates()

    @lean
    def run(batches):
        now, held = None, ([], [])
        for pdf in batches:
            bits = np.array(pdf["fine"].tolist(), dtype=np.int64).reshape(-1, FINE // 32 + BANDS).view(np.uint64)
            columns = (*(pdf[c].to_numpy(np.int64) for c in ("id", "n", "component")), bits)
            key = list(zip(pdf["key"].tolist(), pdf["chunk"].tolist()))
            side, i = pdf["side"].tolist(), 0
            while i < len(key):
                j = i
                while j < len(key) and key[j] == key[i] and side[j] == side[i]:
                    j += 1
                if key[i] != now:
                    if held[0] and held[1]:
                        yield compared(now[0], *([np.concatenate(x) for x in zip(*h)] for h in held))
                    now, held = key[i], ([], [])
                held[side[i]].append(tuple(c[i:j] for c in columns))
                i = j
        if held[0] and held[1]:
            yield compared(now[0], *([np.concatenate(x) for x in zip(*h)] for h in held))

    return left.union(right).repartition("key", "chunk").sortWithinPartitions("key", "chunk", "side").mapInPandas(run, "u long, v long").distinct()


def joined(part: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """part (id, component) after links (u, v) between ids; only the components that are linked go through the rounds."""
    ends = links.join(part.select(F.col("id").alias("u"), F.col("component").alias("a")), "u").join(part.select(F.col("id").alias("v"), F.col("component").alias("b")), "v")
    found = connected_components(ends.select(F.col("a").alias("u"), F.col("b").alias("v")), folder)
    new = part.join(found.select(F.col("node").alias("component"), F.col("component").alias("least")), "component", "left")
    return written(new.select("id", F.coalesce("least", "component").alias("component")), folder, "part")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text).

    Null and empty texts, and texts of white space alone, have no shingles and are kept. Rows
    that repeat a doc_id are one document and come back as often. Rows without doc_id are linked with nothing, have no
    component_id and are kept. An empty table gives no rows. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    folder = shared_dir(spark)
    docs = identified(docs)
    base = written(sketches(docs), folder, "sketches")
    full = base.where((F.col("n_shingles") > 0) & (F.col("doc_id") != NO_ID))
    classes = written(full.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("id")), folder, "classes")
    firsts = full.select(F.col("doc_id").alias("id"), F.col("n_shingles").alias("n"), "bands", "bits").join(classes.select("id").distinct(), "id", "left_semi")

    bands = firsts.select("id", F.explode("bands").alias("key"))
    hubs = bands.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last")
    members = written(bands.join(hubs.select("key", "hub"), "key"), folder, "members")
    asked = members.select("id").distinct()
    pool = written(docs.withColumnRenamed("doc_id", "id").join(asked, "id", "left_semi").dropDuplicates(["id"]), folder, "pool")
    sketch = firsts.select("id", "n", "bits").dropDuplicates(["id"])
    sketch = written(sketch.join(asked, "id", "left_semi"), folder, "asked")
    settle(spark)

    pairs = members.where("id <> hub").select("hub", "id").distinct()
    pairs = pairs.join(sketch.select(F.col("id").alias("hub"), F.struct("n", "bits").alias("a")), "hub").join(sketch.select("id", F.struct("n", "bits").alias("b")), "id").where(likely("a", "b")).select(F.col("hub").alias("u"), F.col("id").alias("v"))
    links = written(verified(written(pairs, folder, "pairs"), pool, f"{folder}/first"), folder, "links")
    part = joined(asked.withColumn("component", F.col("id")), links, f"{folder}/first")
    named = members.select("key", "id").join(part, "id")
    # Only buckets that are still apart need the sharper sketches, and only of their members.
    apart = named.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")
    named = written(named.join(apart, "key", "left_semi"), folder, "apart")
    fine = with_fine_bits(pool.join(named.select("id").distinct(), "id", "left_semi"))
    keys = firsts.select("id", "bands").dropDuplicates(["id"])
    fine = fine.join(sketch.select("id", "n"), "id").join(keys, "id").select("id", "n", F.concat("fine", "bands").alias("fine"))
    fine = written(fine, folder, "fine")
    settle(spark)
    more = written(verified(written(rest_pairs(named, fine), folder, "rest"), pool, f"{folder}/second"), folder, "more")
    part = joined(part, more, f"{folder}/second")

    found = classes.join(part, "id", "left").select("fp1", "fp2", F.coalesce("component", "id").alias("component"))
    for name in ("members", "pool", "asked", "pairs", "links", "apart", "fine", "rest", "more"):
        discard(spark, f"{folder}/{name}")
    settle(spark)
    keyed = base.withColumn("fp1", F.when(F.col("n_shingles") > 0, F.col("fp1")).otherwise(F.col("doc_id")))
    out = keyed.select("doc_id", "n_shingles", "fp1", "fp2").join(found.withColumn("full", F.lit(True)), ["fp1", "fp2"], "left")
    component = F.when(F.col("doc_id") == NO_ID, None).when((F.col("n_shingles") > 0) & F.col("full"), F.col("component")).otherwise(F.col("doc_id"))
    out = out.select(id_or_null(), "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of documents; see near_duplicates for nulls, repeats and empty tables. Texts of any length are whole."""
    return near_duplicates(table(spark, sf_dir, "documents"))
