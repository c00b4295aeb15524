"""Best-fit packing of token sequences, after a dominance reduction.

The plan is made from the histogram of piece lengths, whose size is bounded by the
capacity and not by the data; the pieces find their places by their rank among the
pieces of the same length, so no task and no driver ever holds the pieces.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_or_null, identified, lean, shared_dir, table, written
from .tokens import blank_separated, encoder, public_path

CAPACITY = 4096
END_ID = 1
#: Ranks are counted in parts of each length, of about so many pieces and so many parts at least, so that a length that a third of all pieces have is spread.
PART_PIECES, LEAST_PARTS = 250_000, 64

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def tokenised_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each document: ids of the whole text, then end_id; longer ones are cut.

    A null or empty text gives one piece that holds end_id alone; a repeated row gives its pieces again; a null doc_id stays null.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    @lean
    def run(batches):
        encode = encoder(tokenizer_path, blank_separated)
        for pdf in batches:
            rows = []
            for doc_id, ids in zip(pdf["doc_id"].tolist(), encode(pdf["text"].tolist())):
                ids += end
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, capacity)):
                    part = ids[start * 4 : (start + capacity) * 4]
                    rows.append((doc_id, k, start, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
        encode.rest()

    return identified(docs).mapInPandas(run, PIECES).withColumn("doc_id", id_or_null())


@dataclass
class Slot:
    """Ranks lo..hi-1 of a length: `each` of them in a row share a sequence, from `offset` on."""

    length: int
    lo: int
    hi: int
    each: int
    sequence: int
    offset: int


def _longest_two(lengths: np.ndarray, have: np.ndarray, room: int) -> int:
    """The most that two pieces of the ascending lengths, of which there are have, fill of room; 0 if no two fit."""
    if not len(lengths):
        return 0
    best = 0
    twice = lengths[(have[lengths] > 1) & (2 * lengths <= room)]
    if len(twice):
        best = 2 * int(twice[-1])
    # The longest partner of each that is shorter than itself.
    partner = np.minimum(np.searchsorted(lengths, room - lengths, side="right"), np.arange(len(lengths))) - 1
    some = np.flatnonzero(partner >= 0)
    return max(best, int((lengths[some] + lengths[partner[some]]).max(initial=0)))


class Plan:
    """Sequences by groups that are filled alike: a group is (contents, how many)."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.groups: list[tuple[tuple[tuple[int, int], ...], int]] = []
        self._reduce()
        #: Sequences that the reduction has fixed, and how many groups of them.
        self.fixed, self.fixed_groups = self.sequences, len(self.groups)
        least = -(-int((self.left * np.arange(capacity + 1)).sum()) // capacity)
        rest = self._best_fit()
        if sum(times for _, times in rest) > least:
            rest = min(rest, self._best_filled(), key=lambda groups: sum(times for _, times in groups))
        self.groups += rest

    def _reduce(self) -> None:
        """Martello and Toth's reduction: for each length, the longest first, fix its sequence as long as one set of companions dominates all others that fit."""
        for j in range(self.capacity, 0, -1):
            while self.left[j] and (companions := self._dominating(j)) is not None:
                each = Counter([j, *companions])
                times = min(int(self.left[x]) // n for x, n in each.items())
                self.groups.append((tuple(sorted(each.items(), reverse=True)), times))
                for x, n in each.items():
                    self.left[x] -= n * times

    def _dominating(self, j: int) -> list[int] | None:
        """Companions of a piece j that dominate all other sets which fit beside it, or None if none is known to.

        A set dominates another if the other's pieces can be dealt to its pieces so that none gets more than its own length. That is so of
        no companion if none fits; of the longest that fits if it fills the room, if no two fit, or if no three fit and no two
        together are longer; and of the longest with the longest that fits beside it, if no three fit and any two that are both longer than
        the second are together no longer than the first. Fixing a set leaves fewer others, so it may be repeated while its pieces last.
        """
        room = self.capacity - j
        have = self.left[: room + 1]
        if j <= room:
            have = have.copy()
            have[j] -= 1
        fit = np.flatnonzero(have > 0)
        if not len(fit):
            return []
        first = int(fit[-1])
        if first == room:
            return [first]
        three = np.repeat(fit[:3], np.minimum(have[fit[:3]], 3))[:3]
        if three[:2].sum() > room or len(three) < 2:
            return [first]
        if len(three) == 3 and three.sum() <= room:
            return None
        if _longest_two(fit, have, room) <= first:
            return [first]
        beside = fit[fit <= room - first]
        beside = beside[(beside != first) | (have[beside] > 1)]
        if not len(beside):
            return None
        second = int(beside[-1])
        return [first, second] if _longest_two(fit[fit > second], have, room) <= first else None

    def _best_fit(self) -> list[tuple[tuple[tuple[int, int], ...], int]]:
        """Best-fit decreasing over lengths: pieces go where the least room that holds them is left."""
        open_: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
        rooms = np.zeros(self.capacity + 1, dtype=bool)
        for length in np.flatnonzero(self.left)[::-1].tolist():
            n = int(self.left[length])
            while n:
                found = np.flatnonzero(rooms[length:])
                if not len(found):
                    each = self.capacity // length
                    for each, times in ((each, n // each), (n % each, 1)):
                        if each and times:
                            self._put(open_, rooms, self.capacity - each * length, ((length, each),), times)
                    break
                room = length + int(found[0])
                contents, times = open_[room].pop()
                if not open_[room]:
                    rooms[room] = False
                # As long as it stays the tightest, the same group takes further pieces of this length.
                each = room // length
                if n < times * each:
                    full, rest = divmod(n, each)
                    for e, t in ((each, full), (rest, 1 if rest else 0), (0, times - full - (1 if rest else 0))):
                        if t:
                            self._put(open_, rooms, room - e * length, contents + (((length, e),) if e else ()), t)
                    n = 0
                else:
                    self._put(open_, rooms, room - each * length, contents + ((length, each),), times)
                    n -= times * each
        return [group for some in open_.values() for group in some]

    def _best_filled(self) -> list[tuple[tuple[tuple[int, int], ...], int]]:
        """Another best fit, for where the first leaves more than the least thinkable number: a sequence at a time, the longest piece with what fills its room best."""
        left, out = self.left.copy(), []
        while (lengths := np.flatnonzero(left)[::-1].tolist()):
            j = lengths[0]
            left[j] -= 1
            # Bit s of a number is set if lengths up to there can fill s.
            room, reach, steps = self.capacity - j, 1, []
            mask = (1 << (room + 1)) - 1
            for x in lengths:
                n, size = min(int(left[x]), room // x), 1
                while n > 0 and not reach >> room & 1:
                    take = min(size, n)
                    steps.append((x, take, reach))
                    reach |= reach << (x * take) & mask
                    n, size = n - take, size * 2
            left[j] += 1
            at, each = reach.bit_length() - 1, Counter([j])
            for x, take, before in reversed(steps):
                if not before >> at & 1:
                    each[x] += take
                    at -= x * take
            times = min(int(left[x]) // n for x, n in each.items())
            for x, n in each.items():
                left[x] -= n * times
            out.append((tuple(sorted(each.items(), reverse=True)), times))
        return out

    @staticmethod
    def _put(open_, rooms, room, contents, times) -> None:
        open_.setdefault(room, []).append((contents, times))
        rooms[room] = True

    def slots(self) -> list[Slot]:
        used: dict[int, int] = {}
        sequence, out = 0, []
        for contents, times in self.groups:
            offset = 0
            for length, each in contents:
                lo = used.get(length, 0)
                used[length] = hi = lo + times * each
                out.append(Slot(length, lo, hi, each, sequence, offset))
                offset += each * length
            sequence += times
        return out

    @property
    def sequences(self) -> int:
        return sum(times for _, times in self.groups)


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to pieces (with doc_id, piece, length <= capacity); no piece is dropped.

    pieces must be a written table, since it is read for the histogram and again for the ranks.
    Full pieces are sequences of their own, numbered from -1 down;
    all others take the sequences of the plan, numbered from 0. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    short = pieces.where(F.col("length") < capacity)
    counts = {r["length"]: r["count"] for r in short.groupBy("length").count().collect()}
    slots = sorted(Plan(counts, capacity).slots(), key=lambda s: (s.length, s.lo))
    # At most one slot per length and group, and the groups grow with the number of lengths only.
    held = spark.sparkContext.broadcast({k: np.array([getattr(s, k) for s in slots], dtype=np.int64) for k in ("length", "lo", "each", "sequence", "offset")})

    parts = max(LEAST_PARTS, -(-max(counts.values(), default=0) // PART_PIECES))
    part = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(parts)).cast("int")
    short = short.withColumn("_part", part)
    by_part = short.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = by_part.select("length", "_part", F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = (
        short.withColumn("_row", F.row_number().over(Window.partitionBy("length", "_part").orderBy("doc_id", "piece")) - 1)
        .join(before, ["length", "_part"])
        .withColumn("_rank", F.col("_before") + F.col("_row"))
        .drop("_part", "_before", "_row")
    )
    kept = [c for c in pieces.columns]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def find(batches):
        plan = held.value
        key = (plan["length"] << 44) | plan["lo"]
        for pdf in batches:
            length, rank = pdf["length"].to_numpy(np.int64), pdf["_rank"].to_numpy(np.int64)
            at = np.searchsorted(key, (length << 44) | rank, side="right") - 1
            inst, turn = np.divmod(rank - plan["lo"][at], plan["each"][at])
            yield pdf[kept].assign(sequence_id=plan["sequence"][at] + inst, offset=plan["offset"][at] + turn * length)

    placed = ranked.select(*kept, "_rank").mapInPandas(find, schema)
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return placed.unionByName(full)


def pack(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Tokenise and pack whole documents. Nulls count as empty texts; other columns are not read."""
    spark = docs.sparkSession
    pieces = tokenised_pieces(docs, tokenizer_path or public_path("word_bpe_49k.json"), capacity)
    return place(written(pieces, shared_dir(spark), "pieces"), capacity)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row of documents.

    A null or empty text is one piece of the end id; rows that share a doc_id, or have none, give their pieces each; texts of any length
    are whole; of pieces of one length any may take any of their places; an empty table gives no rows; other columns are not read.
    """
    return pack(table(spark, sf_dir, "documents"))
