"""Benchmark decontamination by spaced seeds.

Fixed masks read four of up to five consecutive words and ignore another, so a substituted
word breaks a seed only where a mask reads it. The hashes of the benchmark's seeds are sorted and
joined with those of every document by probing; each hit gives a document, an item and a
diagonal, along which words are compared: an overlap holds where a window of ``WINDOW`` words
(or the whole item, if shorter) agrees in at least 80 of 100 words.

The benchmark goes out in blocks of at most ``BLOCK_WORDS`` words, one pass over the
documents each, so what is broadcast is bounded however large it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnp
from .memory import freed
from .scratch import table

#: With one substitution in any five words, or two in any ten to thirteen, one of these still reads four right ones,
#: so every window of 80 in 100 is found.
MASKS = ("1111", "10111", "11011", "11101")
WINDOW, PERCENT, MIN_WORDS = 13, 80, 5
BLOCK_WORDS = 500_000


def _seeds(hashes: np.ndarray, mask: str) -> np.ndarray:
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, int(mask, 2), np.uint64)
        for i, c in enumerate(mask):
            if c == "1":
                out = textnp.mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n])
    return out


class SeedIndex:
    """Sorted seed hashes of a block of items, and their words."""

    def __init__(self, items: list[tuple[object, str | None]]):
        self.ids, self.words = [], []
        for item_id, text in items:
            raw = (text or "").encode("utf-8")
            w = textnp.words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), lower=True)[2]
            if len(w) >= MIN_WORDS:
                self.ids.append(item_id)
                self.words.append(w)
        keys, owner, place = [], [], []
        for k, w in enumerate(self.words):
            for mask in MASKS:
                keys.append(_seeds(w, mask))
                owner.append(np.full(len(keys[-1]), k))
                place.append(np.arange(len(keys[-1])))
        key = np.concatenate([np.zeros(0, np.uint64), *keys])
        order = np.argsort(key, kind="stable")
        self.key = key[order]
        self.owner = np.concatenate([np.zeros(0, np.int64), *owner])[order].astype(np.int64)
        self.place = np.concatenate([np.zeros(0, np.int64), *place])[order].astype(np.int64)
        #: A small table of key bits turns most probes away.
        self.filter = np.zeros(1 << 20, bool)
        self.filter[(self.key >> np.uint64(44)).astype(np.int64)] = True

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """Distinct (row position - item position, item) of all seed hits."""
        found = []
        for mask in MASKS:
            s = _seeds(words, mask)
            at = np.flatnonzero(self.filter[(s >> np.uint64(44)).astype(np.int64)])
            lo, hi = np.searchsorted(self.key, s[at], "left"), np.searchsorted(self.key, s[at], "right")
            n = hi - lo
            if not n.sum():
                continue
            rows = np.repeat(at, n)
            ref = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            found.append(np.stack([rows - self.place[ref], self.owner[ref]], 1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)

    def verify(self, words: np.ndarray, begin: int, end: int, shift: int, item: int) -> tuple[int, int, int, int] | None:
        """Best window along a diagonal inside one text: words agreeing, window, first and end word of all good windows."""
        w = self.words[item]
        lo, hi = max(0, begin - shift), min(len(w), end - shift)
        size = min(WINDOW, len(w))
        if hi - lo < size:
            return None
        total = np.concatenate(([0], np.cumsum(words[shift + lo : shift + hi] == w[lo:hi])))
        agree = total[size:] - total[:-size]
        good = np.flatnonzero(agree * 100 >= PERCENT * size)
        if not len(good):
            return None
        return int(agree.max()), size, int(shift + lo + good[0] - begin), int(shift + lo + good[-1] + size - begin)


def _overlaps(index: SeedIndex, column: pa.Array) -> Iterator[tuple[int, object, int, int, int, int]]:
    for first, _, buf, offs in textnp.chunks(column):
        _, _, words, row = textnp.words(buf, offs, lower=True)
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        for shift, item in index.candidates(words).tolist():
            # A diagonal may lie in several short texts; each overlapped one is compared.
            r = max(0, int(np.searchsorted(row, max(shift, 0), "right")) - 1)
            while r < len(row) - 1 and row[r] < shift + len(index.words[item]):
                hit = index.verify(words, int(row[r]), int(row[r + 1]), shift, item)
                if hit and hit > best.get((r, item), (0,)):
                    best[r, item] = hit
                r += 1
        for (r, item), hit in sorted(best.items()):
            yield first + r, index.ids[item], *hit


def _find(index: SeedIndex, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_overlaps(index, batch.column("text")))
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], item_type), *(pa.array(c, pa.int64()) for c in cols[2:])],
                ["doc_id", "item_id", "n_agree", "n_window", "first_word", "end_word"],
            )

    return run


def _clean(index: SeedIndex):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[r for r, *_ in _overlaps(index, batch.column("text"))]] = False
            yield batch.filter(pa.array(keep))

    return run


def _blocks(benchmark: DataFrame) -> Iterator[SeedIndex]:
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.size(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+")))).first()[0] or 0
    n = -(-size // BLOCK_WORDS)
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        index = SeedIndex([tuple(r) for r in part.collect()])
        if index.ids:
            yield index


def find_overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_agree, n_window, first_word, end_word): the items overlapped by each row's whole text.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. One row per document row and item, with
    its best window and the word range of all good windows on that diagonal. Items under
    ``MIN_WORDS`` words are too short to tell from ordinary wording and match nothing; so do
    null and empty texts. Repeated rows are each reported; null ids stay null. Other columns are unused,
    whatever their names; empty tables give an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_agree long, n_window long, first_word long, end_word long"
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for i, index in enumerate(_blocks(benchmark)):
        found = texts.mapInArrow(freed(_find(index, to_arrow_type(benchmark.schema["item_id"].dataType))), schema)
        out = out.unionByName(found) if i else found
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text overlaps no item; same columns."""
    for index in _blocks(benchmark):
        docs = docs.mapInArrow(freed(_clean(index)), docs.schema)
    return docs


def op8_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
