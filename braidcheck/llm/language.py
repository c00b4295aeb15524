"""Language identification by the nearest of several centroids per language."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import crc_fold, hand_back, id_or_null, identified, lean, table
from .hashing import mix

#: Places that bigrams and trigrams of letters are hashed to.
DIMENSIONS = 4096
CENTROIDS = 4
#: Labelled texts from which the centroids are made: so many a language, and so many over all. Document frequencies come from all.
SAMPLE, SAMPLE_ALL = 600, 9_600
#: The share of a length's sample below whose similarity a text is rejected, and the slack below that.
REJECT_SHARE, REJECT_SLACK = 0.002, 0.1
#: Texts that tell the radius of a length; where the sample has fewer, beginnings of so many longer ones help, in equal parts of the languages.
ENOUGH, BEGINNINGS = 100, 400
BINS = 16
#: Languages whose sizes are broadcast at most; beyond, they are joined.
MOST_BROADCAST = 10_000
UNDETERMINED = "und"
ROUNDS = 12
#: Vectors of the sample that are held at once where none is needed with the others.
ROWS_AT_ONCE = 512

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters; made once in each worker."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool))
    return _letters[0]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
    """(places, counts, letters) of the hashed bigrams and trigrams of a whole text, lower-cased; runs of other characters are one blank."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = letter_table()[code]
    n = int(letter.sum())
    if not n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    code = np.where(letter, code, 32)[keep].astype(np.uint64)
    code = np.concatenate((np.array([32], dtype=np.uint64), code, np.array([32], dtype=np.uint64)))
    two = code[:-1] << np.uint64(21) | code[1:]
    three = two[:-1] << np.uint64(21) | code[2:]
    places = (mix(np.concatenate((two, three))) % np.uint64(DIMENSIONS)).astype(np.int64)
    counts = np.bincount(places, minlength=DIMENSIONS)
    places = np.flatnonzero(counts)
    return places, counts[places], n


def length_bin(letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(letters, 1)).astype(np.int64), BINS - 1)


def beginnings(text: str, letters: int) -> list[str]:
    """The beginnings of a text that have 1, 2, 4 ... letters, of all length bins below its own."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    place = np.flatnonzero(letter_table()[code])
    return [text[: place[(1 << b) - 1] + 1] for b in range(int(length_bin(np.array([letters]))[0])) if (1 << b) <= len(place)]


def radii(bins: np.ndarray, own: np.ndarray, begun_bins: np.ndarray, begun_own: np.ndarray) -> np.ndarray:
    """The least cosine of each length bin, from those of whole texts (own) and, where a bin has fewer than ENOUGH, of beginnings of longer texts.

    A bin that still has fewer takes the nearest ones below, and then above, until it has ENOUGH or all there are.
    """
    out = np.zeros(BINS)
    held = [own[bins == b] for b in range(BINS)]
    held = [x if len(x) >= ENOUGH else np.concatenate((x, begun_own[begun_bins == b])) for b, x in enumerate(held)]
    for b in range(BINS):
        some = held[b]
        for other in [*range(b - 1, -1, -1), *range(b + 1, BINS)]:
            if len(some) >= ENOUGH:
                break
            some = np.concatenate((some, held[other]))
        if len(some):
            least = float(np.quantile(some, REJECT_SHARE))
            out[b] = max(least - REJECT_SLACK, least / 2)
    return out


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 as bytes, which sort as the numbers do and take 4 bytes each on the driver; lists of them take ten times that."""
    return numbers.astype(">u4").tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=">u4").astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    radius: np.ndarray

    def vectors(self, counted: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
        """Rows of TF-IDF weights, each of length 1."""
        out = np.zeros((len(counted), DIMENSIONS), dtype=np.float32)
        for row, (places, counts, _) in zip(out, counted):
            row[places] = np.sqrt(counts) * self.idf[places]
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        out /= np.where(norm > 0, norm, 1)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, cosine to its nearest centroid, rejected) of each text."""
        counted = [gram_counts(t) for t in texts]
        if not len(self.centroids):
            return [(UNDETERMINED, 0.0, True)] * len(texts)
        cosines = self.vectors(counted) @ self.centroids.T
        best = cosines.argmax(axis=1)
        score = np.clip(cosines[np.arange(len(best)), best].astype(np.float64), 0, 1)
        letters = np.array([n for _, _, n in counted])
        far = score < self.radius[length_bin(letters)]
        return [(self.languages[self.owner[b]], float(s), bool(r)) if n else (UNDETERMINED, 0.0, True) for b, s, n, r in zip(best, score, letters, far)]


def _spherical_means(rows: np.ndarray, k: int) -> np.ndarray:
    """k-means by cosine from the farthest-first start; a pure function of the rows and their order."""
    start = [int((rows @ rows.mean(axis=0)).argmax())]
    near = rows @ rows[start[0]]
    while len(start) < min(k, len(rows)):
        start.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[start[-1]])
    centres = rows[start]
    for _ in range(ROUNDS):
        of = (rows @ centres.T).argmax(axis=1)
        sums = np.stack([rows[of == c].sum(axis=0) if (of == c).any() else centres[c] for c in range(len(centres))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = sums / np.where(norm > 0, norm, 1)
    return centres


def fit(labelled: DataFrame) -> Model:
    """labelled: (doc_id, text, lang); rows without language or letters teach nothing.

    Document frequencies are summed over all rows. The centroids come from a bounded
    sample, chosen by a hash of the id: SAMPLE texts a language, SAMPLE_ALL over all.
    """
    labelled = labelled.where("lang is not null")

    @lean
    def frequencies(batches):
        df, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for pdf in batches:
            for text in pdf["text"].tolist():
                places, _, letters = gram_counts(text)
                df[places] += 1
                n += letters > 0
        yield pd.DataFrame({"place": np.arange(-1, DIMENSIONS), "df": np.concatenate(([n], df))})

    total = labelled.select("text").mapInPandas(frequencies, "place int, df long").groupBy("place").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(DIMENSIONS + 1)
    for row in total:
        df[row["place"]] = row["df"]
    idf = np.log((df[-1] + 1) / (df[:-1] + 1)) + 0.1

    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    empty = Model([], idf, np.zeros((0, DIMENSIONS), dtype=np.float32), np.zeros(0, dtype=np.int64), np.zeros(BINS))
    if not languages:
        return empty
    each = max(1, min(SAMPLE, SAMPLE_ALL // len(languages)))
    # A share that brings about twice as many, then the first by hash: the exact choice sorts a bounded number of rows.
    share = F.least(F.lit(1.0), (2.0 * each + 20.0) / F.col("of"))
    by_language = labelled.sparkSession.createDataFrame(list(sizes.items()), "lang string, of long")
    drawn = labelled.select("doc_id", "text", "lang", F.xxhash64("doc_id", "lang").alias("h")).join(F.broadcast(by_language) if len(sizes) <= MOST_BROADCAST else by_language, "lang").where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    drawn = drawn.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", "text"))).where(F.col("k") <= each)

    def counted(batches):
        for pdf in batches:
            rows = []
            for lang, text, k in zip(pdf["lang"].tolist(), pdf["text"].tolist(), pdf["k"].tolist()):
                c = gram_counts(text)
                if c[2]:
                    rows.append((lang, _packed(c[0]), _packed(c[1]), c[2], False))
                    for some in beginnings(text, c[2]) if k <= begun else []:
                        places, counts, n = gram_counts(some)
                        rows.append((lang, _packed(places), _packed(counts), n, True))
            yield pd.DataFrame(rows, columns=["lang", "places", "counts", "letters", "begun"])

    begun = -(-BEGINNINGS // len(languages))
    sample = sorted(drawn.select("lang", "text", "k").mapInPandas(counted, "lang string, places binary, counts binary, letters int, begun boolean").collect())
    model = empty
    model.languages = languages = sorted({r["lang"] for r in sample if not r["begun"]})
    if not languages:
        return empty

    def vectors(rows):
        return model.vectors([(_unpacked(r["places"]), _unpacked(r["counts"]), r["letters"]) for r in rows])

    def nearest(rows, centres):
        """Length bins of rows, and the cosine of each to the nearest of the centres."""
        cosines = [(vectors(rows[at : at + ROWS_AT_ONCE]) @ centres.T).max(axis=1) for at in range(0, len(rows), ROWS_AT_ONCE)]
        return length_bin(np.array([r["letters"] for r in rows], dtype=np.int64)), np.concatenate([np.zeros(0, dtype=np.float32), *cosines])

    # The vectors of one language are held at a time.
    found, whole, parts = [], [], []
    for _, rows in groupby(sample, key=lambda r: r["lang"]):
        rows = list(rows)
        own, begun_rows = [r for r in rows if not r["begun"]], [r for r in rows if r["begun"]]
        found.append(_spherical_means(vectors(own), CENTROIDS))
        whole.append(nearest(own, found[-1]))
        parts.append(nearest(begun_rows, found[-1]))
    model.centroids = np.concatenate(found).astype(np.float32)
    model.owner = np.concatenate([np.full(len(x), i) for i, x in enumerate(found)])
    model.radius = radii(*(np.concatenate(x) for x in zip(*whole)), *(np.concatenate(x) for x in zip(*parts)))
    del sample, rows, own, begun_rows
    hand_back()
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected of every row of docs (doc_id, text).

    Only the text is looked at. lang_pred is `und` with score 0 where the text is null or has
    no letter, or where nothing was learned; those are rejected, as is a text whose nearest centroid
    is farther than nearly all texts of its length in the sample were from theirs. Rows that repeat are told alike; a null doc_id stays null.
    """

    @lean
    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                some = pdf.iloc[at : at + 256]
                found = model.predict(some["text"].tolist())
                yield pd.DataFrame({"doc_id": some["doc_id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "rejected": [x[2] for x in found]})

    return identified(docs).mapInPandas(run, "doc_id long, lang_pred string, score double, rejected boolean").withColumn("doc_id", id_or_null())


def identified_only(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs (with a column text) that identify would not reject, with all their columns; nothing is shuffled."""

    @lean
    def run(batches):
        for batch in batches:
            texts, keep = batch.column("text").to_pylist(), []
            for at in range(0, len(texts), 256):
                keep += [not rejected for _, _, rejected in model.predict(texts[at : at + 256])]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row of documents. Of languages as near the first by name counts; see identify for nulls and repeats; texts are whole; an empty table gives no rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.where(crc_fold(F.col("doc_id"), 4) != 2))
    return identify(docs, model).select("doc_id", (crc_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "rejected")
