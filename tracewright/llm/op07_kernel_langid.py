"""Language identification by a blended-spectrum string kernel.

A text is the set of its letter n-grams of one to four characters, hashed to ``FEATURES``
places; the kernel of two texts is their number of common places over the geometric mean of
their sizes. Nystroem landmarks, drawn evenly from the languages, turn kernel rows into
features, on which one-versus-rest ridge regression is solved in closed form. The fit sees a
bounded sample of labelled rows, whose presence bits (not texts) reach the driver; every text is then
scored whole, in batches of matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import table

FEATURES = 1 << 15
ORDERS = 4
#: The fit: rows per language (about), rows over all languages (about; each has one at least), landmarks (one a language at least), ridge.
TRAIN_PER_LANGUAGE, TRAIN_ROWS, LANDMARKS, RIDGE = 400, 80_000, 128, 1e-2
BATCH = 64
SLICE = 1 << 20
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def presence(text: str) -> tuple[np.ndarray, bool]:
    """The text's n-grams as a boolean vector, and whether it has a letter. Other characters count as one space."""
    out, any_letter = np.zeros(FEATURES, bool), False
    for s in range(0, len(text), SLICE):
        points = np.frombuffer(text[s : s + SLICE + ORDERS - 1].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[points]
        if not letter.any():
            continue
        any_letter = True
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        points = np.where(letter, points, 32).astype(np.uint32)[keep]
        h = np.zeros(len(points), np.uint32)
        for n in range(ORDERS):
            h = h[: len(points) - n] * np.uint32(0x9E3779B1) + points[n:] + np.uint32(1)
            out[(h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 15)] = True
    return out, any_letter


@dataclass
class KernelModel:
    """Landmark presence bits and the weights that take a kernel row to one value per language."""

    languages: list[str]
    bits: np.ndarray
    weights: np.ndarray

    def landmarks(self) -> np.ndarray:
        x = np.unpackbits(self.bits, axis=1).astype(np.float32)
        return x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))


def fit(bits: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    """Nystroem features on evenly drawn landmarks, then kernel ridge regression, one language versus the rest."""
    languages = sorted(set(langs))
    y = np.array([languages.index(x) for x in langs])
    turn = np.zeros(len(y), np.int64)
    for k in range(len(languages)):
        turn[y == k] = np.arange((y == k).sum())
    chosen = np.lexsort((y, turn))[: max(landmarks, len(languages))]
    model = KernelModel(languages, bits[chosen], np.zeros((0, 0), np.float32))
    land = model.landmarks()
    x = np.unpackbits(bits, axis=1).astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    values, vectors = np.linalg.eigh((land @ land.T).astype(np.float64))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    z = (x @ land.T) @ root
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    solved = np.linalg.solve(z.T @ z + ridge * len(z) / len(languages) * np.eye(z.shape[1]), z.T @ target)
    model.weights = (root @ solved).astype(np.float32)
    return model


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [presence(t.as_py()) for t in batch.column("text")]
        keep = pa.array([ok for _, ok in found], pa.bool_())
        out = pa.RecordBatch.from_arrays([batch.column("lang"), pa.array([np.packbits(b).tobytes() for b, _ in found], pa.binary())], ["lang", "bits"])
        yield out.filter(keep)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> KernelModel | None:
    """A model from labelled rows that are not held out; None without any. Rows are drawn by a hash of doc_id."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.select("doc_id", F.xxhash64("doc_id").alias("h"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("low")).collect()
    if not counts:
        return None
    per_language = max(1, min(per_language, TRAIN_ROWS // len(counts)))
    steps = docs.sparkSession.createDataFrame([(r.lang, max(1, r.n // per_language), r.low) for r in counts], "lang string, step long, low long")
    # As small as the number of languages.
    sample = usable.join(F.broadcast(steps), "lang").where("pmod(h, step) = 0 OR h = low")
    rows = sample.orderBy("h").select("lang", "text").mapInArrow(_bits, "lang string, bits binary").limit((2 * per_language + 1) * len(counts)).collect()
    if not rows:
        return None
    return fit(np.frombuffer(b"".join(bytes(r.bits) for r in rows), np.uint8).reshape(len(rows), -1), [r.lang for r in rows])


def _predict(model: KernelModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        land = model.landmarks().T.copy() if model else None
        for batch in batches:
            texts = batch.column("text")
            for s in range(0, batch.num_rows, BATCH):
                part = batch.slice(s, BATCH)
                x = np.zeros((part.num_rows, FEATURES), np.float32)
                ok = np.zeros(part.num_rows, bool)
                for r in range(part.num_rows):
                    text = texts[s + r].as_py()
                    if text and model:
                        x[r], ok[r] = presence(text)
                names, scores = [UNDETERMINED] * part.num_rows, np.zeros(part.num_rows)
                if model and ok.any():
                    size = np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
                    f = ((x @ land) / size) @ model.weights
                    best = f.argmax(1)
                    names = [model.languages[b] if o else UNDETERMINED for b, o in zip(best, ok)]
                    scores = np.where(ok, np.clip((f.max(1).astype(np.float64) + 1) / 2, 0, 1), 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row; only the text is an input of the prediction.

    Null texts and texts without a letter are ``und`` with score 0, as is every text without a
    model. Equal values go to the first language in order. Rows may repeat; a null doc_id is
    not held out (and never trained on). Other columns are unused; an empty table gives an empty result.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(_predict(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def op7_kernel_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, train(docs))
