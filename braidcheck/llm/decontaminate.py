"""Benchmark items in training text: an inverted index of the items, searched with every passage.

Scores are BM25 sums, each divided by the score that the item's own words reach, so 1 means that
a passage holds every word of an item. A passage first sums, for each block of items, the greatest
weights that its words have there; only blocks whose sum reaches the threshold are searched,
by WAND over the posting lists. What it finds is verified by word overlap of question and answer.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_or_null, identified, lean, shared_dir, table, written

K1, B = 1.2, 0.75
#: The least score of a passage for an item, as a share of the item's own.
THRESHOLD = 0.5
#: Items of one block of the index.
BLOCK = 4
WORDS = 5
#: The share of a question's and of an answer's words that shared runs of WORDS words must cover.
OVERLAP = 0.75
#: Bounds on an index that is sent to all executors; a larger benchmark is searched in several turns.
ITEMS_AT_ONCE, CHARS_AT_ONCE = 20_000, 32_000_000
#: Words of passages that are searched together.
SLAB = 200_000
#: Cells up to which an index's greatest weights by word and block are a full table, and cells of sums that are held at once.
DENSE, SUMS = 4_000_000, 4_000_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation and white space part them."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The answer is the last sentence that leaves a question before it; a text of one sentence gives its last quarter of words."""
    parts = [w for w in map(words_of, _SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    own = parts[0] if parts else []
    cut = len(own) - len(own) // 4
    return own[:cut], own[cut:]


@dataclass(frozen=True)
class Statistics:
    """What the search needs to know of the whole benchmark, whatever part of it is searched: items, the mean and the greatest number of their words, and items by word."""

    items: int
    mean: float
    longest: int
    holding: dict[bytes, int]

    @classmethod
    def of(cls, items: list[tuple[int, str]]) -> Statistics:
        bags = [w for _, text in items if (w := words_of(text))]
        holding: Counter = Counter()
        for words in bags:
            holding.update(set(words))
        return cls(len(bags), sum(map(len, bags)) / max(1, len(bags)), max(map(len, bags), default=0), dict(holding))


@dataclass
class Index:
    """Items in the order of their ids, and for each word its postings (item, weight) in that order."""

    ids: list[int] = field(default_factory=list)
    texts: list[tuple[list[bytes], list[bytes]]] = field(default_factory=list)
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    postings: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    longest: int = 0
    #: (word, block) -> items, weights and the greatest weight of its postings there.
    parts: dict[tuple[int, int], tuple[list[int], list[float], float]] = field(default_factory=dict)

    @classmethod
    def of(cls, items: list[tuple[int, str]], whole: Statistics | None = None) -> Index:
        """whole: statistics of all items, of which these may be a part."""
        whole = Statistics.of(items) if whole is None else whole
        out = cls(longest=whole.longest)
        bags = []
        for item, text in sorted(items, key=lambda x: (x[0] is not None, x)):
            words = words_of(text)
            if words:
                out.ids.append(item)
                out.texts.append(question_and_answer(text))
                bags.append(words)
        if not bags:
            return out
        found: list[list[tuple[int, int]]] = []
        for i, words in enumerate(bags):
            for w, n in Counter(words).items():
                t = out.vocabulary.setdefault(w, len(found))
                if t == len(found):
                    found.append([])
                found[t].append((i, n))
        own = np.zeros(len(bags))
        for word, some in zip(out.vocabulary, found):
            items_, tf = np.array([x[0] for x in some]), np.array([x[1] for x in some], dtype=float)
            idf = np.log1p((whole.items - whole.holding[word] + 0.5) / (whole.holding[word] + 0.5))
            size = np.array([len(bags[i]) for i in items_])
            weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / whole.mean))
            np.add.at(own, items_, weight)
            out.postings.append((items_, weight))
        out.postings = [(i, w / own[i]) for i, w in out.postings]
        for t, (items_, weight) in enumerate(out.postings):
            of = items_ // BLOCK
            edges = [*np.flatnonzero(np.diff(of, prepend=-1)).tolist(), len(of)]
            for lo, hi in zip(edges, edges[1:]):
                some = weight[lo:hi].tolist()
                out.parts[t, int(of[lo])] = (items_[lo:hi].tolist(), some, max(some))
        return out

    def blocks(self) -> tuple:
        """For each word, from starts[word] on: blocks that hold it and its greatest weight in each; and the same as a full table if it is small."""
        starts, block, most = [0], [], []
        for items, weight in self.postings:
            of = items // BLOCK
            first = np.flatnonzero(np.diff(of, prepend=-1))
            block.append(of[first])
            most.append(np.maximum.reduceat(weight, first))
            starts.append(starts[-1] + len(first))
        table_, n_blocks = None, -(-len(self.ids) // BLOCK)
        if len(self.postings) * n_blocks <= DENSE:
            table_ = np.zeros((len(self.postings), n_blocks), dtype=np.float32)
            table_[np.repeat(np.arange(len(self.postings)), np.diff(starts)), np.concatenate(block)] = np.concatenate(most)
        return np.array(starts), np.concatenate(block), np.concatenate(most), table_


def wand(index: Index, terms: list[int], blocks: set[int], threshold: float) -> list[tuple[int, float]]:
    """Items of the given blocks whose sum over the terms is at least threshold.

    Lists stand in the order of their next items. The pivot is the first list at which the
    greatest weights that the lists have in their blocks add up to the threshold; no item before the
    pivot's can reach it, so the lists before it skip there.
    """
    out = []
    for block in sorted(blocks):
        lists = [[x[0], x[1], 0, x[2]] for t in terms if (x := index.parts.get((t, block)))]
        while lists:
            lists.sort(key=lambda x: x[0][x[2]])
            bound, pivot = 0.0, None
            for x in lists:
                bound += x[3]
                if bound >= threshold - 1e-9:
                    pivot = x[0][x[2]]
                    break
            if pivot is None:
                break
            if lists[0][0][lists[0][2]] == pivot:
                score = 0.0
                for x in lists:
                    if x[0][x[2]] == pivot:
                        score += x[1][x[2]]
                        x[2] += 1
                if score >= threshold - 1e-9:
                    out.append((pivot, score))
            else:
                for x in lists:
                    while x[2] < len(x[0]) and x[0][x[2]] < pivot:
                        x[2] += 1
            lists = [x for x in lists if x[2] < len(x[0])]
    return out


def overlap(part: list[bytes], passage: list[bytes]) -> float:
    """The share of part's words that runs of WORDS words cover which occur in passage; shorter parts must occur whole. An empty part: 1."""
    if not part:
        return 1.0
    size = min(WORDS, len(part))
    runs = {tuple(passage[i : i + size]) for i in range(len(passage) - size + 1)}
    covered = [False] * len(part)
    for i in range(len(part) - size + 1):
        if tuple(part[i : i + size]) in runs:
            covered[i : i + size] = [True] * size
    return sum(covered) / len(part)


LEAKS = "doc_id long, item_id long, passage_start long, score double, question_overlap double, answer_overlap double"


#: The index that a worker process holds, by the broadcast that it was made from; one at a time.
_held: dict[int, tuple] = {}


def _search(docs: DataFrame, items: list[tuple[int, str]], whole: Statistics) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast((items, whole))
    key = hash((docs.sparkSession.sparkContext.applicationId, held._jbroadcast.id()))

    @lean
    def run(batches):
        if key not in _held:
            index = Index.of(*held.value)
            _held.clear()
            _held[key] = (index, index.blocks() if index.ids else None)
        index, table_ = _held[key]
        for pdf in batches:
            rows: dict[tuple[int, int], tuple] = {}
            if index.ids:
                texts, size, first = pdf["text"].tolist(), 0, 0
                for k, text in enumerate(texts):
                    size += len(text or "") // 5
                    if size > SLAB or k + 1 == len(texts):
                        _passages(index, table_, pdf["doc_id"].tolist()[first : k + 1], texts[first : k + 1], first, rows)
                        size, first = 0, k + 1
            yield pd.DataFrame(list(rows.values()), columns=["doc_id", "item_id", "passage_start", "score", "question_overlap", "answer_overlap"])

    return identified(docs).mapInPandas(run, LEAKS).withColumn("doc_id", id_or_null())


def _bounds(index: Index, blocks, stretch: np.ndarray, term: np.ndarray, n: int) -> np.ndarray:
    """(n, blocks) sums of the greatest weights that the terms of each stretch have in each block; stretches ascend."""
    starts, block_of, most, table_ = blocks
    n_blocks = -(-len(index.ids) // BLOCK)
    if table_ is not None:
        out = np.zeros((n, n_blocks), dtype=np.float32)
        first = np.flatnonzero(np.diff(stretch, prepend=-1))
        for at in range(0, len(first), 512):  # a few stretches at a time stay in the cache
            some = first[at : at + 512]
            lo, hi = some[0], first[at + 512] if at + 512 < len(first) else len(term)
            out[stretch[some]] = np.add.reduceat(table_[term[lo:hi]], some - lo, axis=0)
        return out
    count = starts[term + 1] - starts[term]
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(starts[term], count) + within
    return np.bincount(np.repeat(stretch, count) * n_blocks + block_of[at], weights=most[at], minlength=n * n_blocks).reshape(n, n_blocks)


def _passages(index: Index, blocks, doc_ids, texts, base, rows) -> None:
    """Texts are cut into stretches of the longest item's words; two in a row are a passage, so each item that a text holds lies whole in one."""
    step = index.longest
    all_words, terms, place = [], [], []
    starts: list[tuple[int, int]] = []
    follows: list[bool] = []
    for d, text in enumerate(texts):
        words = words_of(text)
        all_words.append(words)
        ids = np.fromiter(map(index.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        hit = np.flatnonzero(ids >= 0)
        if not len(hit):
            continue
        n = -(-len(words) // step)
        terms.append(ids[hit])
        place.append(hit // step + len(starts))
        starts += [(d, p * step) for p in range(n)]
        follows += [True] * (n - 1) + [False]
    if not terms:
        return
    stretch, term = np.divmod(np.unique(np.concatenate(place) * len(index.postings) + np.concatenate(terms)), len(index.postings))
    more = np.array(follows)
    # Some stretches at a time, each slab with the one after it.
    n_blocks = -(-len(index.ids) // BLOCK)
    each = max(1, SUMS // n_blocks)
    found: list[int] = []
    for at in range(0, len(starts), each):
        end = min(len(starts), at + each + 1)
        lo, hi = np.searchsorted(stretch, [at, end])
        bound = _bounds(index, blocks, stretch[lo:hi] - at, term[lo:hi], end - at)
        # A word of both stretches counts twice here, which keeps it a bound.
        bound[:-1] += np.where(more[at : end - 1, None], bound[1:], 0)
        found += (at + np.flatnonzero((bound[:each] >= THRESHOLD - 1e-4).any(axis=1))).tolist()
    for p in found:
        d, start = starts[p]
        if not more[p] and start:
            continue  # the last stretch of a longer text belongs to the passage before
        lo, hi = np.searchsorted(stretch, [p, p + 1 + more[p]])
        own = np.unique(term[lo:hi])
        live = np.flatnonzero(_bounds(index, blocks, np.zeros(len(own), dtype=np.int64), own, 1)[0] >= THRESHOLD - 1e-4)
        if not len(live):
            continue
        words = all_words[d][start : start + 2 * step]
        for item, score in wand(index, own.tolist(), set(live.tolist()), THRESHOLD):
            question, answer = (overlap(x, words) for x in index.texts[item])
            if question >= OVERLAP and answer >= OVERLAP:
                got = (doc_ids[d], index.ids[item], start, score, question, answer)
                old = rows.get((base + d, item))
                if old is None or old[3] < score:
                    rows[base + d, item] = got


def statistics(items: DataFrame) -> DataFrame:
    """(word, n): the items that hold each word, summed up over all of items (item_id, text); under the empty word all items that have words, under a blank the words that they have, and under two the most that one has (most)."""

    def run(batches):
        for pdf in batches:
            n: Counter = Counter()
            longest = 0
            for text in pdf["text"].tolist():
                words = words_of(text)
                if words:
                    n.update(set(words))
                    n[b""] += 1
                    n[b" "] += len(words)
                    longest = max(longest, len(words))
            n[b"  "] = longest
            yield pd.DataFrame({"word": list(n), "n": list(n.values())})

    return items.mapInPandas(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"), F.max("n").alias("most"))


def _turn_words(items: list[tuple[int, str]]) -> list[tuple[bytearray]]:
    return [(bytearray(w),) for w in {w for _, text in items for w in words_of(text)} | {b"", b" ", b"  "}]


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that it holds, with the best passage (its first word's place) and scores.

    Null and empty texts on either side give none; a repeated document gives its rows again, and a null doc_id stays null; of
    benchmark rows with the same id and text one counts. A benchmark beyond the bounds is searched in
    turns of bounded size, each over all documents and with the statistics of the whole benchmark, so the turns change no score. Of passages
    with equal scores the first counts. Other columns of either table are not read.
    """
    spark = docs.sparkSession
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).first()
    turns = max(1, -(-size["n"] // ITEMS_AT_ONCE), -(-(size["chars"] or 0) // CHARS_AT_ONCE))
    if turns == 1:
        some = _rows(items)
        return _search(docs, some, Statistics.of(some))
    turns *= 2  # a hash deals unevenly
    by_word = written(statistics(items), shared_dir(spark), "words")
    found = None
    for turn in range(turns):
        some = _rows(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(turns)) == turn))
        words = spark.createDataFrame(_turn_words(some), "word binary")
        told = by_word.join(words, "word", "left_semi").collect()
        holding = {bytes(r["word"]): r["n"] for r in told}
        longest = max((r["most"] for r in told if r["word"] == b"  "), default=0)
        n = holding.pop(b"", 0)
        new = _search(docs, some, Statistics(n, holding.pop(b" ", 0) / max(1, n), longest, holding))
        found = new if found is None else found.union(new)
    return found


def _rows(items: DataFrame) -> list[tuple[int, str]]:
    """Items as a list, those without item_id first."""
    return sorted(((r["item_id"], r["text"]) for r in items.collect()), key=lambda x: (x[0] is not None, x))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item that it holds: doc_id, item_id, passage_start, score, question_overlap, answer_overlap. See leaks for nulls, repeats and ties."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
