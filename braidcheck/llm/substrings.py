"""Removal of long repeated byte strings, by sorting suffixes at content-chosen anchors.

Every string of LENGTH bytes holds LENGTH - GRAM + 1 grams; the one with the least hash (the
first of equals) is its anchor, so equal strings have their anchors at the same place. Only
anchors whose gram occurs again can lie in a repeated string, and only the bytes around those
move. Occurrences with equal surroundings are counted as one class before anything is
sorted. The classes of a gram are sorted by their bytes to the right (deep-shallow) and to
the left; the tree of common left parts then gives, for each class, every stretch that it
shares with another. A gram with very many different classes is resolved by counting the
hashes of blocks of strings instead, so no task ever holds such a group.

The same works on words in place of bytes (WORDS): a text is then the row of its words' hashes,
8 bytes each where bytes are sorted, and places count words.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, id_or_null, identified, lean, settle, shared_dir, table, written
from .hashing import _BLANK, hashes_of_words, mix, powers, prefix_sums, text_bytes
from .suffixes import deep_shallow_sort, intervals

LENGTH = 400
GRAM = 50
#: A gram with more classes than this is resolved by counting hashes; so many take about 20 MB to sort.
HOT_CLASSES = 20_000
#: Rows that a Python task hands on at once.
ROWS_AT_ONCE = 8_000
#: Sizes of the blocks of string starts whose hashes are counted, one after another.
STEPS = (64, 8, 1)
#: Bytes whose grams are hashed at once.
SLICE = 1 << 20
_PLACE = np.uint64(SLICE * 2 - 1)
_SALT = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Unit:
    """Strings of `length` places that must not repeat, and their grams; a place is a byte of the text, or a word.

    With `under`, only strings of bytes that hold fewer whole words than that, a blank on either side of each, are looked at.
    """

    length: int
    gram: int
    words: bool = False
    under: int = 0

    @property
    def back(self) -> int:
        return self.length - self.gram

    @property
    def width(self) -> int:
        """Bytes that a place takes in the strings that are sorted."""
        return 8 if self.words else 1

    def places(self, text: str | None) -> np.ndarray:
        raw = text_bytes(text)
        return hashes_of(raw) if self.words else np.frombuffer(raw, dtype=np.uint8)


BYTES = Unit(LENGTH, GRAM)
#: Passages of over 50 words; white space between the words does not count.
WORDS = Unit(51, 8, words=True)
#: Strings of LENGTH bytes that WORDS cannot see, as they hold too few words.
WORDLESS = Unit(LENGTH, GRAM, under=WORDS.length)

OCCURRENCES = "kind byte, gram long, class long, doc_id long, pos long, l int, r int, n long"


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the words of data, and the bytes after them. Words part at ASCII white space."""
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _BLANK[data], [True])).view(np.int8)))
    return edge[::2], edge[1::2]


def hashes_of(raw: bytes) -> np.ndarray:
    """A hash of each word as it is written; about SLICE bytes are hashed at once."""
    data = np.frombuffer(raw, dtype=np.uint8)
    start, end = word_places(data)
    out = np.empty(len(start), dtype=np.uint64)
    cuts = np.flatnonzero(np.diff(start // SLICE, prepend=-1)).tolist() + [len(start)]
    for a, b in zip(cuts, cuts[1:]):
        at = start[a]
        out[a:b] = hashes_of_words(data[at : end[b - 1]], start[a:b] - at, end[a:b] - at)
    return out


def few_words(data: np.ndarray, unit: Unit) -> np.ndarray:
    """Which strings of unit.length bytes hold fewer than unit.under words with a blank of the string on either side."""
    start, end = word_places(data)
    begun, ended = np.cumsum(np.bincount(start, minlength=len(data))), np.cumsum(np.bincount(end, minlength=len(data) + 1))
    return ended[unit.length - 1 : len(data)] - begun[: len(data) - unit.length + 1] < unit.under


def anchors(data: np.ndarray, unit: Unit = BYTES) -> np.ndarray:
    """Places of the anchors of all strings of unit.length places in data."""
    n, out = len(data), []
    window = unit.back + 1
    few = few_words(data, unit) if unit.under and n >= unit.length else None
    for at in range(0, n - unit.length + 1, SLICE):
        some = data[at : min(n, at + SLICE + unit.length - 1)]
        here = None if few is None else few[at : at + len(some) - unit.length + 1]
        if here is not None and not here.any():
            continue
        sums = prefix_sums(some)
        _, down = powers(len(some) + 1)
        grams = mix((sums[unit.gram :] - sums[: -unit.gram]) * down[: len(some) - unit.gram + 1])
        key = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        wide = np.full(-(-len(key) // window) * window, np.iinfo(np.uint64).max, dtype=np.uint64)
        wide[: len(key)] = key
        blocks = wide.reshape(-1, window)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        last = len(key) - window + 1
        least = np.minimum(back[:last], ahead[window - 1 : window - 1 + last]) & _PLACE
        if here is not None:
            least = least[here]
        step = np.flatnonzero(np.diff(least.astype(np.int64), prepend=-1))
        out.append(np.unique(least[step]).astype(np.int64) + at)
    return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.int64)


def hashes_between(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[begin:end]; data is taken in slices that hold the longest stretch."""
    out = np.empty(len(begin), dtype=np.uint64)
    reach = int((end - begin).max(initial=0))
    cell = begin // SLICE
    for c in np.unique(cell).tolist():
        of = np.flatnonzero(cell == c)
        at = c * SLICE
        some = data[at : at + SLICE + reach]
        sums = prefix_sums(some)
        _, down = powers(len(some) + 1)
        b, e = begin[of] - at, end[of] - at
        out[of] = mix((sums[e] - sums[b]) * down[b] + (e - b).astype(np.uint64) * _SALT)
    return out


def occurrences(docs: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """Kind 0: anchors with their gram, class, and places to the left and right that count.

    Anchors of one document with equal surroundings (text that repeats itself at a short
    period) are one row with their number n; the places they cover are rows of kind 1, from pos
    to l places on, whatever the number of anchors.
    """

    def one(doc_id, text):
        data = unit.places(text)
        at = anchors(data, unit)
        if not len(at):
            return
        l, r = np.minimum(unit.back, at), np.minimum(unit.length, len(data) - at)
        gram = hashes_between(data, at, at + unit.gram)
        # The surroundings hold the gram, at l.
        whole = mix(hashes_between(data, at - l, at + r) + l.astype(np.uint64) * _SALT)
        _, first, back, n = np.unique(whole, return_index=True, return_inverse=True, return_counts=True)
        yield [np.broadcast_to(x, len(first)) for x in (0, gram[first].view(np.int64), whole[first].view(np.int64), doc_id, at[first], l[first], r[first], n)]
        if len(first) < len(at):
            again = n[back.ravel()] > 1
            for b, e in merged(at[again] - l[again], at[again] + r[again]):
                # Spans longer than an int can hold are written in pieces.
                for p in range(b, e, 1 << 30):
                    yield [np.array([x]) for x in (1, 0, 0, doc_id, p, min(1 << 30, e - p), 0, 0)]

    def frame(rows):
        return pd.DataFrame({c: np.concatenate(x) for c, x in zip(columns, zip(*rows))})

    columns = ["kind", "gram", "class", "doc_id", "pos", "l", "r", "n"]

    @lean
    def run(batches):
        for pdf in batches:
            rows: list[list] = []
            n = 0
            for doc_id, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                for some in one(doc_id, text):
                    rows.append(some)
                    n += len(some[1])
                if n >= ROWS_AT_ONCE:
                    yield frame(rows)
                    rows, n = [], 0
            if rows:
                yield frame(rows)

    return docs.mapInPandas(run, OCCURRENCES)


def merged(begin: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open stretches, in order; those that touch become one."""
    if not len(begin):
        return []
    order = np.argsort(begin, kind="stable")
    begin, far = begin[order], np.maximum.accumulate(end[order])
    new = np.flatnonzero(np.concatenate(([True], begin[1:] > far[:-1])))
    return list(zip(begin[new].tolist(), far[np.concatenate((new[1:] - 1, [len(far) - 1]))].tolist()))


def shared_stretches(lefts: list[bytes], rights: list[bytes], unit: Unit = BYTES) -> list[list[tuple[int, int]]]:
    """For each class, (places left, places right) of maximal stretches of at least unit.length places that it shares with another.

    lefts are the bytes before the anchor, last first; rights begin with the anchor.
    """
    n = len(lefts)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    order, lcp = deep_shallow_sort(rights)
    rank = [0] * n
    for k, i in enumerate(order):
        rank[i] = k
    by_left, left_lcp = deep_shallow_sort(lefts)
    near = np.array(lcp, dtype=np.int64) // unit.width
    for depth, a, b in intervals([x // unit.width for x in left_lcp]):
        places = np.sort(np.array([rank[i] for i in by_left[a : b + 1]]))
        between = np.minimum.reduceat(near[: places[-1] + 1], places[:-1] + 1)
        best = np.maximum(np.concatenate(([0], between)), np.concatenate((between, [0])))
        for k in np.flatnonzero(best + depth >= unit.length).tolist():
            out[order[places[k]]].append((depth, int(best[k])))
    return out


def _surroundings(docs: DataFrame, wanted: DataFrame, unit: Unit) -> DataFrame:
    """wanted (gram, class, doc_id, pos, l, r, ...) with the bytes of the places around pos, read from the documents."""
    rest = [c for c in wanted.columns if c != "doc_id"]
    asked = wanted.groupBy("doc_id").agg(F.collect_list(F.struct(*rest)).alias("asked"))
    kinds = dict(wanted.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in rest) + ", before binary, after binary"

    @lean
    def run(batches):
        for pdf in batches:
            rows = []
            for text, some in zip(pdf["text"].tolist(), pdf["asked"].tolist()):
                data = unit.places(text)
                for x in some:
                    p = x["pos"]
                    rows.append((*[x[c] for c in rest], data[p - x["l"] : p][::-1].tobytes(), data[p : p + x["r"]].tobytes()))
                if len(rows) >= ROWS_AT_ONCE:
                    yield pd.DataFrame(rows, columns=[*rest, "before", "after"])
                    rows = []
            yield pd.DataFrame(rows, columns=[*rest, "before", "after"])

    return docs.join(asked, "doc_id").select("text", "asked").mapInPandas(run, schema)


def _sorted_groups(around: DataFrame, unit: Unit) -> DataFrame:
    """Stretches of each class of the grams with a bounded number of classes."""

    def of(held):
        unique = {x[1]: x for x in held}  # a repeated row of documents brings its classes again
        items = list(unique.values())
        found = shared_stretches([x[2] for x in items], [x[3] for x in items], unit)
        return [(x[0], x[1], depth, right) for x, some in zip(items, found) for depth, right in some]

    @lean
    def run(batches):
        held: list[tuple] = []
        for pdf in batches:
            rows = []
            for x in zip(pdf["gram"].tolist(), pdf["class"].tolist(), pdf["before"].tolist(), pdf["after"].tolist()):
                if held and held[0][0] != x[0]:
                    rows += of(held)
                    held = []
                held.append(x)
            yield pd.DataFrame(rows, columns=["gram", "class", "back", "ahead"])
        if held:
            yield pd.DataFrame(of(held), columns=["gram", "class", "back", "ahead"])

    return around.repartition("gram").sortWithinPartitions("gram").mapInPandas(run, "gram long, class long, back int, ahead int")


def _counted_groups(around: DataFrame, folder: str, unit: Unit) -> DataFrame:
    """The same for grams with very many classes, by counts of hashes.

    A block of starts lo..hi before the anchor stands for its strings: if the bytes that all of them
    share occur once, none repeats; if all their bytes together occur twice, all do; else the block
    is split. Counts are summed up before they are shuffled, so a hot string costs one row a task.
    """
    held = around.select("gram", "class", "n", "before", "after").dropDuplicates(["gram", "class"])
    held = written(held, folder, "hot")
    if held.isEmpty():
        return held.select("gram", "class", F.lit(0).alias("back"), F.lit(0).alias("ahead"))
    blocks = None
    found = None
    for level, size in enumerate(STEPS):

        def run(batches, size=size):
            for pdf in batches:
                rows = []
                for gram, cls, n, before, after, lo0, hi0 in zip(*(pdf[c].tolist() for c in ("gram", "class", "n", "before", "after", "lo", "hi"))):
                    kind = np.uint64 if unit.words else np.uint8
                    data = np.concatenate((np.frombuffer(before, dtype=kind)[::-1], np.frombuffer(after, dtype=kind)))
                    l = len(before) // unit.width
                    r = len(data) - l
                    first, last = max(0, unit.length - r), min(unit.back, l)
                    lo = np.arange(lo0, min(hi0, last) + 1, size)
                    hi = np.minimum(lo + size - 1, unit.back)
                    fits = hi >= first
                    lo, hi = lo[fits], hi[fits]
                    if not len(lo):
                        continue
                    core = hashes_between(data, l - lo, l - hi + unit.length)
                    whole = (hi <= l) & (unit.length - lo <= r)
                    full = np.zeros(len(lo), dtype=np.uint64)
                    full[whole] = hashes_between(data, l - hi[whole], l - lo[whole] + unit.length)
                    for a, b, c, w, f in zip(lo.tolist(), hi.tolist(), core.view(np.int64).tolist(), whole.tolist(), full.view(np.int64).tolist()):
                        rows.append((gram, cls, n, a, b, c, f, w))
                yield pd.DataFrame(rows, columns=["gram", "class", "n", "lo", "hi", "core", "full", "whole"])

        source = held.withColumns({"lo": F.lit(0), "hi": F.lit(unit.back)}) if blocks is None else held.join(blocks, ["gram", "class"])
        rows = written(source.mapInPandas(run, "gram long, class long, n long, lo int, hi int, core long, full long, whole boolean"), folder, f"blocks{level}")
        # Written before they are joined, so that a string that very many classes share is split among tasks.
        cores = written(rows.groupBy("gram", "lo", "core").agg(F.sum("n").alias("cores")).where("cores > 1"), folder, f"cores{level}")
        fulls = written(rows.where("whole").groupBy("gram", "lo", "full").agg(F.sum("n").alias("fulls")).where("fulls > 1"), folder, f"fulls{level}")
        judged = rows.join(cores, ["gram", "lo", "core"]).join(fulls, ["gram", "lo", "full"], "left")
        judged = written(judged.select("gram", "class", "lo", "hi", "core", "full", (F.col("whole") & F.col("fulls").isNotNull()).alias("sure")), folder, f"judged{level}")
        new = judged.where("sure").select("gram", "class", F.col("hi").alias("back"), (unit.length - F.col("lo")).cast("int").alias("ahead"))
        found = new if found is None else found.union(new)
        open_ = judged.where("not sure")
        # What is settled is still compared with what is not: one class of those that are equal all over the block.
        settled = judged.where("sure").groupBy("gram", "lo", "hi", "core", "full").agg(F.min("class").alias("class"))
        settled = settled.join(open_.select("gram", "lo", "core").distinct(), ["gram", "lo", "core"], "left_semi")
        blocks = open_.select("gram", "class", "lo", "hi").union(settled.select("gram", "class", "lo", "hi"))
    return found


def repeated_spans(docs: DataFrame, folder: str, unit: Unit = BYTES) -> DataFrame:
    """(doc_id, spans): stretches of places that belong to a repeated string of unit.length places. A written table, the only one that stays in folder.

    A document's row holds as many spans as it has anchors at most, so it is no larger than its text.
    """
    spark = docs.sparkSession
    seen = written(occurrences(docs, unit), folder, "anchors")
    # Grams that occur once are most of all and go first; their count is summed up before it is shuffled. What is summed up by gram is
    # written before it is joined, so that a gram that very many anchors share is split among tasks.
    again = written(seen.where("kind = 0").groupBy("gram").agg(F.sum("n").alias("all")).where("all > 1").select("gram"), folder, "again")
    real = written(seen.where("kind = 0").drop("kind").join(again, "gram", "left_semi"), folder, "repeated")
    own = written(seen.where("kind = 1").select("doc_id", F.col("pos").alias("b"), (F.col("pos") + F.col("l")).alias("e")), folder, "own")
    for name in ("anchors", "again"):
        discard(spark, f"{folder}/{name}")
    settle(spark)
    # Any occurrence can stand for its class; all firsts of a group are of one row.
    counted = written(real.groupBy("gram", "class").agg(F.sum("n").alias("n"), *[F.first(c).alias(c) for c in ("doc_id", "pos", "l", "r")]), folder, "counted")
    grams = written(counted.groupBy("gram").agg(F.count(F.lit(1)).alias("classes"), F.min("n").alias("rarest")), folder, "grams")
    classes = counted.join(grams, "gram")

    asked = classes.where("classes > 1 and rarest = 1").select("gram", "class", "n", "doc_id", "pos", "l", "r", (F.col("classes") > HOT_CLASSES).alias("hot"))
    around = written(_surroundings(docs, asked, unit), folder, "around")
    discard(spark, f"{folder}/grams")
    found = _sorted_groups(around.where("not hot"), unit).union(_counted_groups(around.where("hot"), folder, unit))
    alike = counted.where(f"n > 1 and l + r >= {unit.length}").select("gram", "class", F.col("l").alias("back"), F.col("r").alias("ahead"))
    # At most unit.back + 1 of a class, one a depth to the left.
    stretches = found.union(alike).groupBy("gram", "class").agg(F.collect_set(F.struct("back", "ahead")).alias("stretches"))
    stretches = written(stretches, folder, "stretches")
    for name in ("around", "counted", "hot", *(f"{x}{k}" for x in ("blocks", "cores", "fulls", "judged") for k in range(len(STEPS)))):
        discard(spark, f"{folder}/{name}")
    settle(spark)

    spans = real.join(stretches, ["gram", "class"]).select("doc_id", "pos", F.explode("stretches").alias("x")).select("doc_id", (F.col("pos") - F.col("x.back")).alias("b"), (F.col("pos") + F.col("x.ahead")).alias("e"))
    spans = written(spans.union(own).groupBy("doc_id").agg(F.collect_list(F.struct("b", "e")).alias("spans")), folder, "spans")
    for name in ("repeated", "own", "stretches"):
        discard(spark, f"{folder}/{name}")
    settle(spark)
    return spans


def cut(raw: bytes, spans) -> tuple[bytes, int, int]:
    """raw without the spans, the number of bytes removed, and of maximal removed runs."""
    if spans is None or not len(spans):
        return raw, 0, 0
    runs = merged(np.array([x["b"] for x in spans], dtype=np.int64), np.array([x["e"] for x in spans], dtype=np.int64))
    kept, at = [], 0
    for b, e in runs:
        kept.append(raw[at:b])
        at = e
    return b"".join([*kept, raw[at:]]), sum(e - b for b, e in runs), len(runs)


def byte_spans(raw: bytes, spans) -> list[dict]:
    """Spans of words of raw as spans of bytes, from the first word's first byte to the last word's last."""
    if spans is None or not len(spans):
        return []
    start, end = word_places(np.frombuffer(raw, dtype=np.uint8))
    return [{"b": int(start[x["b"]]), "e": int(end[x["e"] - 1])} for x in spans]


def without_repeats(docs: DataFrame, folder: str, units: dict[str, Unit] | None = None) -> DataFrame:
    """docs (doc_id, text, and any others that come along) joined with the spans to remove, a column for each of units (spans, of bytes).

    Rows that share a doc_id must share their text; they count as repeats of each other and come
    back as often. Rows without doc_id are documents like others. Null texts count as empty; texts under a unit's length hold nothing to remove.
    """
    docs = docs.withColumn("_own", F.coalesce(F.col("doc_id").cast("long"), F.xxhash64(F.lit("no id"), "text")))
    texts = docs.select(F.col("_own").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for name, unit in ({"spans": BYTES} if units is None else units).items():
        spans = repeated_spans(texts, f"{folder}/{name}", unit)
        docs = docs.join(spans.select(F.col("doc_id").alias("_own"), F.col("spans").alias(name)), "_own", "left")
    return docs.drop("_own")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of documents, by without_repeats with strings of LENGTH bytes.

    Null and empty texts have 0 bytes; rows that repeat a document lose all strings of LENGTH bytes, as each also starts in the other;
    texts of any length are whole; an empty table gives no rows; other columns are not read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    @lean
    def run(batches):
        for pdf in batches:
            rows = []
            for doc_id, text, spans in zip(pdf["doc_id"].tolist(), pdf["text"].tolist(), pdf["spans"].tolist()):
                raw = text_bytes(text)
                kept, removed, runs = cut(raw, spans)
                rows.append((doc_id, len(raw), removed, runs, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = without_repeats(docs, shared_dir(spark))
    return identified(found, "spans").mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumn("doc_id", id_or_null())
