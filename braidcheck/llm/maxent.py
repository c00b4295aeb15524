"""A hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class of the word | history) * P(word | class, history). The first factor is a
softmax over CLASSES classes whose logits are a bias and sums of weight rows, found by hashing n-grams and
skips of the history. The second is a softmax over the SLOTS slots of the class, with a bias of its own and by the same features hashed
with the class, times the word's share of its slot: the commonest words of a class have a slot each, all others share SHARED slots. The
mass of unseen words is set aside in each class. A word's class follows from its ending and length, so words never
seen have one too, and the probabilities of all seen words and of one unseen word per class add up to 1.

Training takes STEPS steps. The batch of a step is fixed by a hash of the ids; its gradient is summed over all of the batch's documents under the same
weights, and then one step is taken. So the model does not depend on how many tasks there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, crc_fold, discard, id_or_null, identified, lean, shared_dir, table, written
from .hashing import _BLANK, SLICE, hashes_of_words, mix, text_bytes

#: Endings are hashed to so many buckets, which are clustered into so many classes.
BUCKETS, CLASSES = 1024, 32
#: Slots of a class, and how many of them words share; the others hold a word each.
SLOTS, SHARED = 32, 8
#: Rows of weights that the features of a history are hashed to: at least and at most; between, they double whenever the corpus grows to four times, from so many tokens on.
FEATURES, MOST_FEATURES, TOKENS = 8192, 1 << 16, 1 << 27
#: Tasks of a step at most; each hands on a whole table of sums.
TASKS = 256
STEPS = 6
#: What the expected counts are raised by, under the gradient; the largest move of a weight in a step; and the largest weight.
DAMP, MOVE, LARGEST = 4.0, 1.0, 4.0
RATE = 0.4
#: Tokens whose probabilities are taken at once, and bytes of texts that are cut into tokens at once.
BATCH, BYTES = 8192, 1 << 18
#: Tokens that are counted before they are handed on.
COUNTED = 1 << 21
#: Words whose counts go along with the scorer, and places for them; counts of all others are joined.
HEAD, PLACES = 200_000, 1 << 19
#: Places for the words with slots of their own.
OWN_PLACES = 1 << 13
#: Neighbours are told apart by so many groups of buckets when buckets are clustered.
GROUPS = 64
SLABS = 16
END = mix(np.array([0x0E0D], dtype=np.uint64))
_PAD = np.uint64(7)
_SALT = mix(np.arange(CLASSES, dtype=np.uint64) + np.uint64(1 << 20))


def tokens_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, bucket) of each token of the texts, an end after each text, and where each text's tokens begin (the number of all tokens last).

    Words part at ASCII white space; A-Z are lower-cased. The whole texts are cut at once.
    """
    raws = [text_bytes(t) for t in texts]
    data = np.frombuffer(b"\n".join(raws), dtype=np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], _BLANK[data], [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    first = np.cumsum([0, *(len(r) + 1 for r in raws)])
    first[-1] = len(data) + 1
    at = np.searchsorted(start, first)
    begin = at + np.arange(len(at))
    words, buckets = np.full(begin[-1], END[0], dtype=np.uint64), np.zeros(begin[-1], dtype=np.int64)
    if len(start):
        place = np.arange(len(start)) + np.repeat(np.arange(len(raws)), np.diff(at))
        lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        cuts = np.flatnonzero(np.diff(start // SLICE, prepend=-1)).tolist() + [len(start)]
        for a, b in zip(cuts, cuts[1:]):
            o = start[a]
            words[place[a:b]] = hashes_of_words(lower[o : end[b - 1]], start[a:b] - o, end[a:b] - o)
        n = end - start
        key = np.minimum(n, 5).astype(np.uint64)
        for back in (1, 2, 3):
            key = key << np.uint64(8) | np.where(n >= back, lower[np.maximum(end - back, 0)], np.uint8(0)).astype(np.uint64)
        buckets[place] = 1 + (mix(key) % np.uint64(BUCKETS - 1)).astype(np.int64)
    return words, buckets, begin


def tokens(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, bucket) of each token of a text, the end last."""
    return tokens_of([text])[:2]


def history_hashes(words: np.ndarray, buckets: np.ndarray, begin: np.ndarray | None = None) -> np.ndarray:
    """(4, tokens) hashes of features: the word before; the two buckets before; the word before that (a skip); the third bucket before with the first (a skip). Histories begin with their text."""
    begin = np.array([0, len(words)]) if begin is None else begin
    inside = np.arange(len(words)) - np.repeat(begin[:-1], np.diff(begin))

    def before(x, k):
        out = np.full(len(x), _PAD, dtype=np.uint64)
        out[k:] = x[: max(0, len(x) - k)]
        out[inside < k] = _PAD
        return out

    w1, w2 = before(words, 1), before(words, 2)
    b1, b2, b3 = (before(buckets, k) * np.uint64(m) for k, m in ((1, BUCKETS), (2, 1), (3, 1)))
    return mix(np.stack([w1, (b1 + b2) ^ np.uint64(1 << 40), w2 ^ np.uint64(1 << 62), (b1 + b3) ^ np.uint64(1 << 41)]))


def rows_of(hashes: np.ndarray, rows: int) -> np.ndarray:
    """Rows of weights; rows is a power of two, 2**16 at most."""
    return (hashes & np.uint64(rows - 1)).astype(np.uint16)


def inner_hashes(hashes: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The features together with the class of the word."""
    return mix(hashes ^ _SALT[of])


def logits_of(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.take(weights, rows[0], axis=0, mode="clip")  # twice as fast as with a check of the bounds, which rows_of keeps
    more = np.empty_like(out)
    for r in rows[1:]:
        np.take(weights, r, axis=0, mode="clip", out=more)
        out += more
    out += bias
    return out


def probabilities(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    p = np.exp(logits_of(weights, bias, rows))  # logits are bounded, as weights are
    p /= p.sum(axis=1, keepdims=True)
    return p


def log10_of(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    x = logits_of(weights, bias, rows)
    own = x[np.arange(len(x)), target].astype(np.float64)
    np.exp(x, out=x)
    return (own - np.log(np.maximum(x.sum(axis=1), 1e-30).astype(np.float64))) / np.log(10)


@dataclass
class Model:
    #: (rows, CLASSES + SLOTS): weights of classes by feature, and of slots by feature and class.
    table: np.ndarray
    #: Trained biases of classes, and of the slots of each class.
    bias: np.ndarray
    inner_bias: np.ndarray
    class_of: np.ndarray
    #: log10 of what a seen word's count is multiplied by, and of an unseen word's mass, in each class.
    seen: np.ndarray
    unseen: np.ndarray
    total: int
    distinct: int
    #: Words with counts that go along, by place, and their counts.
    head: np.ndarray
    head_counts: np.ndarray
    #: Words with a slot of their own, by place, and their slots; the share of each slot in its class.
    own: np.ndarray
    own_slot: np.ndarray
    share: np.ndarray

    @property
    def weights(self) -> np.ndarray:
        return np.ascontiguousarray(self.table[:, :CLASSES])

    @property
    def inner_weights(self) -> np.ndarray:
        return np.ascontiguousarray(self.table[:, CLASSES:])

    def slots(self, words: np.ndarray) -> np.ndarray:
        """The slot of each word (a signed hash) in its class."""
        at = words & (OWN_PLACES - 1)
        return np.where(self.own[at] == words, self.own_slot[at], words & (SHARED - 1))

    def counts(self, words: np.ndarray) -> np.ndarray:
        """The count of each word (a signed hash) that goes along, else 0."""
        out = np.zeros(len(words), dtype=np.int64)
        for at in (words & (PLACES - 1), words >> 20 & (PLACES - 1)):
            out = np.where(self.head[at] == words, self.head_counts[at], out)
        return out


def slabs(texts: list[str | None], size: int = BYTES):
    """Places of the texts by stretches of about size bytes; a longer text is a stretch."""
    at, n = 0, 0
    for k, text in enumerate(texts):
        n += len(text or "") + 1
        if n >= size or k + 1 == len(texts):
            yield at, k + 1
            at, n = k + 1, 0


def count_words(docs: DataFrame) -> DataFrame:
    """Rows (kind, key, bucket, n): 0 word counts by hash; 1 counts of buckets next to groups of buckets."""

    def counted(words, buckets, near):
        key, first, n = np.unique(np.concatenate(words), return_index=True, return_counts=True)
        yield pd.DataFrame({"kind": np.int8(0), "key": key.view(np.int64), "bucket": np.concatenate(buckets)[first].astype(np.int32), "n": n})
        key = np.flatnonzero(near)
        yield pd.DataFrame({"kind": np.int8(1), "key": key, "bucket": np.int32(0), "n": near[key]})

    @lean
    def run(pdfs):
        words, buckets, near, held = [], [], np.zeros(BUCKETS * 2 * GROUPS, dtype=np.int64), 0
        for pdf in pdfs:
            texts = pdf["text"].tolist()
            for a, e in slabs(texts):
                w, b, begin = tokens_of(texts[a:e])
                words.append(w)
                buckets.append(b.astype(np.int16))
                held += len(w)
                # Neighbours within a text: pairs whose second does not begin one.
                inside = np.ones(len(b), dtype=bool)
                inside[begin[:-1]] = False
                second = np.flatnonzero(inside)
                near += np.bincount(b[second] * (2 * GROUPS) + b[second - 1] % GROUPS, minlength=len(near))
                near += np.bincount(b[second - 1] * (2 * GROUPS) + GROUPS + b[second] % GROUPS, minlength=len(near))
                if held >= COUNTED:
                    yield from counted(words, buckets, near)
                    words, buckets, near, held = [], [], np.zeros(len(near), dtype=np.int64), 0
        if held:
            yield from counted(words, buckets, near)

    return docs.select("text").mapInPandas(run, "kind byte, key long, bucket int, n long").groupBy("kind", "key", "bucket").agg(F.sum("n").alias("n"))


def cluster(near: np.ndarray) -> np.ndarray:
    """A class for each bucket, by k-means of its neighbours' shares; bucket 0, the end of a text, is class 0 alone."""
    mass = near.sum(axis=1)
    rows = np.sqrt(near / np.maximum(mass, 1)[:, None])
    heavy = np.argsort(-mass[1:], kind="stable") + 1
    centres = rows[heavy[: CLASSES - 1]]
    for _ in range(15):
        of = (rows @ centres.T).argmax(axis=1)
        for c in range(len(centres)):
            mine = (of == c) & (mass > 0)
            if mine.any():
                mean = (rows[mine] * mass[mine, None]).sum(axis=0)
                centres[c] = mean / max(np.linalg.norm(mean), 1e-12)
    of = (rows @ centres.T).argmax(axis=1) + 1
    of[0] = 0
    return of


def _add(sums: np.ndarray, bias: np.ndarray, rows: np.ndarray, of: np.ndarray, p: np.ndarray) -> None:
    """sums[c, row] += p[token, c] for each row of each token, and bias[of, c] += p[token, c], in double precision."""
    at = rows.ravel().astype(np.int64)
    columns = np.ascontiguousarray(p.T, dtype=np.float64)
    for c, column in enumerate(columns):
        sums[c] += np.bincount(at, weights=np.tile(column, len(rows)), minlength=sums.shape[1])
        bias[:, c] += np.bincount(of, weights=column, minlength=len(bias))


def train(docs: DataFrame, model: Model) -> None:
    """STEPS steps, each along the gradient summed over the documents of its batch.

    Sums are of what the model expects and of what there is, for each weight; their difference is the gradient, and
    what is expected bounds the curvature, by which the step is scaled.
    """
    spark = docs.sparkSession
    rows, wide = len(model.table), CLASSES + SLOTS
    for turn in range(STEPS):
        held = spark.sparkContext.broadcast((model.weights, model.inner_weights, model.bias, model.inner_bias, model.class_of, model.own, model.own_slot))

        @lean
        def sums(pdfs, held=held):
            weights, inner_weights, bias, inner_bias, class_of, own, own_slot = held.value
            # What is expected, by column and row, and what there is; and the same of biases.
            want, want_bias = np.zeros((wide, rows)), np.zeros((CLASSES, wide))
            have, have_bias = np.zeros((rows, wide)), np.zeros((CLASSES, wide))
            flat, done = have.ravel(), 0
            for pdf in pdfs:
                texts = pdf["text"].tolist()
                for a, e in slabs(texts):
                    words, buckets, begin = tokens_of(texts[a:e])
                    hashes = history_hashes(words, buckets, begin)
                    signed = words.view(np.int64)
                    at = signed & (OWN_PLACES - 1)
                    all_slots = np.where(own[at] == signed, own_slot[at], signed & (SHARED - 1))
                    all_of = class_of[buckets]
                    done += len(words)
                    for i in range(0, len(words), BATCH):
                        of, slot, h = all_of[i : i + BATCH], all_slots[i : i + BATCH], hashes[:, i : i + BATCH]
                        outer, inner = rows_of(h, rows), rows_of(inner_hashes(h, of), rows)
                        p = probabilities(weights, bias, outer)
                        q = probabilities(inner_weights, inner_bias[of], inner)
                        # There is one bias of classes, in the first row.
                        _add(want[:CLASSES], want_bias[:1, :CLASSES], outer, np.zeros_like(of), p)
                        _add(want[CLASSES:], want_bias[:, CLASSES:], inner, of, q)
                        have_bias[0, :CLASSES] += np.bincount(of, minlength=CLASSES)
                        have_bias[:, CLASSES:] += np.bincount(of * SLOTS + slot, minlength=CLASSES * SLOTS).reshape(CLASSES, SLOTS)
                        for x, y in zip(outer, inner):
                            np.add.at(flat, x * np.int64(wide) + of, 1.0)
                            np.add.at(flat, y * np.int64(wide) + CLASSES + slot, 1.0)
            if done:
                from pyspark import TaskContext

                part = TaskContext.get().partitionId() % 64
                want, have = np.concatenate((want.T, want_bias)), np.concatenate((have, have_bias))
                for s, (x, y) in enumerate(zip(np.array_split(want, SLABS), np.array_split(have, SLABS))):
                    yield pd.DataFrame({"slab": [s], "part": [part], "sums": [np.stack((x, y)).tobytes()]})

        batch = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(STEPS)) == turn).select("text").coalesce(TASKS)
        # Two stages of sums, so that no task adds more than about the root of all.
        parts = _summed(batch.mapInPandas(sums, "slab int, part int, sums binary"), ["slab", "part"])
        total = sorted(_summed(parts.withColumn("part", F.lit(0)), ["slab"]).collect())
        held.unpersist()
        if not total:
            continue
        found = [np.frombuffer(r["sums"]).reshape(2, -1, wide) for r in total]
        want, have = (np.concatenate([x[k] for x in found]) for k in (0, 1))
        move = np.clip(RATE * (have - want) / (want + DAMP), -MOVE, MOVE)
        model.table = np.clip(model.table + move[:rows], -LARGEST, LARGEST).astype(np.float32)
        model.bias = (model.bias + move[rows, :CLASSES]).astype(np.float32)
        model.inner_bias = (model.inner_bias + move[rows:, CLASSES:]).astype(np.float32)


def _summed(sums: DataFrame, by: list[str]) -> DataFrame:
    def add(pdfs):
        held: dict[tuple, np.ndarray] = {}
        for pdf in pdfs:
            for slab, part, x in zip(pdf["slab"].tolist(), pdf["part"].tolist(), pdf["sums"].tolist()):
                x = np.frombuffer(x)
                held[slab, part] = held[slab, part] + x if (slab, part) in held else x
        for (slab, part), x in held.items():
            yield pd.DataFrame({"slab": [slab], "part": [part], "sums": [x.tobytes()]})

    return sums.repartition(*by).mapInPandas(add, "slab int, part int, sums binary")


def table_rows(tokens: int) -> int:
    """Rows of weights for so many counted tokens."""
    rows = FEATURES
    while rows < MOST_FEATURES and TOKENS * (rows // FEATURES) ** 2 < tokens:
        rows *= 2
    return rows


def _placed(words: np.ndarray, values: np.ndarray, ways: list[np.ndarray], places: int) -> tuple[np.ndarray, np.ndarray]:
    """Words by place, each in the first of its ways that is free when its turn comes; words that find none are left out. Empty places hold what is no word's own place."""
    key, value = np.full(places, -1, dtype=np.int64), np.zeros(places, dtype=np.int64)
    key[places - 1] = 0
    free = np.ones(places, dtype=bool)
    left = np.arange(len(words))
    for at in ways:
        _, first = np.unique(at[left], return_index=True)
        some = left[np.sort(first)]
        some = some[free[at[some]]]
        key[at[some]], value[at[some]], free[at[some]] = words[some], values[some], False
        left = np.setdiff1d(left, some)
    return key, value


def fit(docs: DataFrame, folder: str) -> tuple[Model, DataFrame]:
    """The model of docs (doc_id, text), and the counts (word, n) of all its words. Everything covers all rows."""
    counted = written(count_words(docs), folder, "counts")
    counts = counted.where("kind = 0").select(F.col("key").alias("word"), "bucket", "n")
    near = np.zeros((BUCKETS, 2 * GROUPS))
    cells = counted.where("kind = 1").select("key", "n").toPandas()  # at most BUCKETS * 2 * GROUPS rows
    near.ravel()[cells["key"].to_numpy()] = cells["n"].to_numpy()
    class_of = cluster(near)
    by_bucket = counts.groupBy("bucket", F.col("word").bitwiseAND(F.lit(SHARED - 1)).cast("int").alias("slot")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect()
    mass, once, words = np.zeros(CLASSES), np.zeros(CLASSES), np.zeros(CLASSES)
    slot_mass = np.zeros((CLASSES, SLOTS))
    for r in by_bucket:
        c = class_of[r["bucket"]]
        mass[c] += r["n"]
        once[c] += r["once"]
        words[c] += r["words"]
        slot_mass[c, r["slot"]] += r["n"]
    left = (once + 0.5) / (mass + 1)
    left = np.minimum(left, 0.5)
    # The head takes words down to the step of the logarithm of counts at which there are HEAD at most.
    step = F.floor(F.log2("n") * 16).cast("int")
    room, least = HEAD, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    head = counts.where(step >= least if least is not None else F.lit(False)).select("word", "bucket", "n").toPandas().sort_values(["n", "word"], ascending=[False, True])
    word, n = head["word"].to_numpy(np.int64), head["n"].to_numpy(np.int64)
    head_key, head_counts = _placed(word, n, [word & (PLACES - 1), word >> 20 & (PLACES - 1)], PLACES)
    # The commonest words of each class that find a place have slots of their own.
    of = class_of[head["bucket"].to_numpy(np.int64)]
    best = head.assign(of=of).groupby("of").head(SLOTS - SHARED)
    mine = best["word"].to_numpy(np.int64)
    own, own_at = _placed(mine, np.arange(len(mine)), [mine & (OWN_PLACES - 1)], OWN_PLACES)
    own_slot = np.zeros(OWN_PLACES, dtype=np.int64)
    slot_of = SHARED + best.groupby("of").cumcount().to_numpy(np.int64)
    kept = np.flatnonzero(np.isin(own, mine))
    own_slot[kept] = slot_of[own_at[kept]]
    own_of, own_n = best["of"].to_numpy(np.int64)[own_at[kept]], best["n"].to_numpy(np.int64)[own_at[kept]]
    np.subtract.at(slot_mass, (own_of, own[kept] & (SHARED - 1)), own_n)
    np.add.at(slot_mass, (own_of, own_slot[kept]), own_n)
    share = slot_mass / np.maximum(mass, 1)[:, None]
    model = Model(
        table=np.zeros((table_rows(int(mass.sum())), CLASSES + SLOTS), dtype=np.float32),
        bias=np.log((mass + 1) / (mass + 1).sum()).astype(np.float32),
        # Empty slots get nothing; a class without words has even ones.
        inner_bias=np.where(share > 0, np.log(np.maximum(share, 1e-30)), np.where(mass > 0, -60.0, 0.0)[:, None]).astype(np.float32),
        class_of=class_of,
        seen=np.log10((1 - left) / np.maximum(mass, 1)),
        unseen=np.log10(left),
        total=int(mass.sum()),
        distinct=int(words.sum()),
        head=head_key,
        head_counts=head_counts,
        own=own,
        own_slot=own_slot,
        share=share,
    )
    train(docs, model)
    return model, counts.select("word", "n")


SCORED = "uid long, doc_id long, word long, code long, base double, score double"


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of docs (doc_id, text).

    Null and empty texts have the end as their only token. Rows that repeat a doc_id are scored each; a null doc_id stays null. Probabilities
    are taken for whole batches of texts; counts of rare words are joined, a row for each rare word of a document.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    @lean
    def run(pdfs):
        from pyspark import TaskContext

        m, uid = held.value, TaskContext.get().partitionId() << 38
        weights, inner_weights = m.weights, m.inner_weights
        rows = len(weights)
        for pdf in pdfs:
            ids, texts = pdf["doc_id"].to_numpy(np.int64), pdf["text"].tolist()
            for a, e in slabs(texts, 4 * BYTES):
                words, buckets, begin = tokens_of(texts[a:e])
                hashes = history_hashes(words, buckets, begin)
                words = words.view(np.int64)
                of, slot = m.class_of[buckets], m.slots(words)
                logp, inside = np.empty(len(of)), np.empty(len(of))
                for i in range(0, len(of), BATCH):
                    c, k, h = of[i : i + BATCH], slot[i : i + BATCH], hashes[:, i : i + BATCH]
                    logp[i : i + BATCH] = log10_of(weights, m.bias, rows_of(h, rows), c)
                    # How much more likely the slot is than by its share of the class, which the counts below stand for.
                    inside[i : i + BATCH] = log10_of(inner_weights, m.inner_bias[c], rows_of(inner_hashes(h, c), rows), k) - np.log10(np.maximum(m.share[c, k], 1e-30))
                sizes = np.diff(begin)
                doc = np.repeat(np.arange(len(sizes)), sizes)
                n = m.counts(words)
                known = n > 0
                n = np.maximum(n, 1)
                base = np.bincount(doc, np.where(known, np.log10(n + 1), 0.0), len(sizes)) - sizes * np.log10(m.total + m.distinct + 1)
                full = np.bincount(doc, logp + np.where(known, np.log10(n) + m.seen[of] + inside, 0.0), len(sizes))
                hits = np.bincount(doc, known, len(sizes)).astype(np.int64)
                own = uid + np.arange(len(sizes))
                uid += len(sizes)
                # The rows of documents carry a scattered word, so that they are dealt evenly; code < 0 tells them apart.
                yield pd.DataFrame({"uid": own, "doc_id": ids[a:e], "word": mix(own.astype(np.uint64)).view(np.int64), "code": -1 - (sizes * (1 << 31) + hits), "base": base, "score": full})
                rare = np.flatnonzero(~known)
                if len(rare):
                    order = rare[np.lexsort((words[rare], doc[rare]))]
                    first = np.flatnonzero((np.diff(doc[order], prepend=-1) != 0) | (np.diff(words[order], prepend=words[order[0]] - 1) != 0))
                    times = np.diff(np.append(first, len(order)))
                    yield pd.DataFrame({"uid": own[doc[order[first]]], "doc_id": NO_ID, "word": words[order[first]], "code": times * CLASSES + of[order[first]], "base": 0.0, "score": np.add.reduceat(inside[order], first)})

    rows = identified(docs).mapInPandas(run, SCORED).join(counts, "word", "left")
    times, cls = F.floor(F.col("code") / CLASSES), (F.col("code") % CLASSES).cast("int")
    own = F.col("code") < 0
    seen = F.array(*[F.lit(float(x)) for x in model.seen])
    unseen = F.array(*[F.lit(float(x)) for x in model.unseen])
    whole = -1 - F.col("code")
    parts = rows.select(
        "uid", "doc_id",
        F.when(own, F.floor(whole / (1 << 31))).otherwise(0).alias("n_tokens"),
        F.when(own, whole % (1 << 31)).when(F.col("n").isNotNull(), times).otherwise(0).alias("n_known"),
        F.when(own, F.col("base")).when(F.col("n").isNotNull(), times * F.log10(F.col("n") + 1)).otherwise(0.0).alias("base_score"),
        F.when(own, F.col("score")).when(F.col("n").isNotNull(), times * (F.log10("n") + F.get(seen, cls)) + F.col("score")).otherwise(times * F.get(unseen, cls)).alias("score"),
    )
    sums = parts.groupBy("uid").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").cast("long").alias("n_tokens"), F.sum("n_known").cast("long").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
    return sums.select(id_or_null(), "n_tokens", "n_known", "base_score", "score")


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of documents; see score for nulls and repeats. Texts of any length are whole; an empty table gives no rows; other columns are not read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model, counts = fit(docs.where(crc_fold(F.col("doc_id"), 7) != 2), shared_dir(spark))
    found = score(docs, model, counts).withColumns({"held_out": crc_fold(F.col("doc_id"), 7) == 2, "train_tokens": F.lit(model.total).cast("long")})
    return found.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
