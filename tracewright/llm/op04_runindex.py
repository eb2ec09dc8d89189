"""Exact removal of long repeated byte strings through run-length text indexes.

Every ``width``-byte window has an anchor: the leftmost least-hashed ``GRAM``-byte string in it.
Equal windows have equal anchors at equal offsets, so each window needs comparing only with
windows of the same anchor string. Consecutive windows with one anchor are one *run*, and
its bytes are the run's context. Runs, not bytes, are shuffled:

1. runs whose anchor hash is unique are done (nothing in them repeats);
2. where all contexts of an anchor are alike, the whole runs repeat;
3. where contexts differ, one text of each is cut from the documents, and blocks of them are
   indexed: suffixes sorted, the Burrows-Wheeler transform run-compressed, positions sampled
   at the ends of runs, and matching statistics streamed from the samples - the longest match
   of the suffix at j is that at j - 1 less one, unless j is sampled. Matches of ``width`` or
   more are marked.
An anchor with more than ``HOT`` different contexts doesn't go into one task: its windows are
hashed to 128 bits each and counted by Spark instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textnp
from .scratch import Scratch, table

WIDTH, GRAM = 200, 56
HOT = 2_000
BLOCK_BYTES = 1 << 16
SEPARATOR = 0xFF  # in no UTF-8 text
_POSITION = (1 << 20) - 1


def _piece_runs(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and anchor hash of each run; windows stay inside their row."""
    n, gram = len(buf), min(GRAM, width)
    span = width - gram + 1
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(textnp.WEIGHT[buf] * textnp.POW[:n], out=sums[1:])
        grams = textnp.mix((sums[gram:] - sums[:-gram]) * textnp.INV_POW[: n - gram + 1])
    key = (grams & np.uint64((1 << 64) - 1 - _POSITION)) | np.arange(len(grams), dtype=np.uint64)
    pad = np.full(-(-len(key) // span) * span, np.iinfo(np.uint64).max, np.uint64)
    pad[: len(key)] = key
    rows = pad.reshape(-1, span)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    count = len(key) - span + 1
    least = np.minimum(behind[:count], ahead[span - 1 : span - 1 + count])
    step = np.zeros(count + 1, np.int32)
    long = np.diff(offs) >= width
    np.add.at(step, offs[:-1][long], 1)
    np.add.at(step, offs[1:][long] - width + 1, -1)
    at = np.flatnonzero(np.cumsum(step)[:count])
    anchor = (least[at] & np.uint64(_POSITION)).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at))[: len(first)] - 1
    return at[first], at[last], grams[anchor[first]]


def row_runs(column: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, first window, number of windows, anchor hash and context hash; long rows by overlapping pieces."""
    most = textnp.BLOCK - 2 * width
    for first, _, buf, offs in textnp.chunks(column, most):
        base = 0
        while len(buf) - base >= width:
            end = min(len(buf), base + most + width - 1) if len(offs) == 2 else len(buf)
            part = buf[base:end]
            a, b, h = _piece_runs(part, offs - base if len(offs) > 2 else np.array([0, len(part)]), width)
            view = memoryview(np.ascontiguousarray(part))
            c = np.fromiter((xxhash.xxh3_64_intdigest(view[x : y + width]) for x, y in zip(a.tolist(), b.tolist())), np.uint64, len(a))
            row = np.searchsorted(offs, a, "right") - 1 if len(offs) > 2 else np.zeros(len(a), np.int64)
            yield first + row, a + base - (offs[row] if len(offs) > 2 else 0), b - a + 1, h, c
            if end == len(buf):
                break
            base = end - width + 1


def _runs(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column("rid")
            for row, a, n, h, c in row_runs(batch.column("text"), width):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), rid.take(pa.array(row)), pa.array(a.astype(np.int32)), pa.array(n.astype(np.int16))], ["h", "c", "rid", "a", "n"])

    return run


def _cut(width: int):
    """The context bytes that were asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = textnp.utf8(batch.column("text"))
            wanted, rid = batch.column("wanted"), batch.column("rid")
            out: list[tuple] = []
            for r in range(batch.num_rows):
                for w in wanted[r].as_py():
                    s = offs[r] + w["a"]
                    out.append((w["h"], rid[r].as_py(), w["a"], w["single"], w["hot"], buf[s : s + w["n"] - 1 + width].tobytes()))
                if len(out) > 10_000 or out and r == batch.num_rows - 1:
                    cols = list(zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.bool_()), pa.array(cols[5], pa.binary())], ["h", "rid", "a", "single", "hot", "context"])
                    out = []

    return run


class RunIndex:
    """A run-compressed Burrows-Wheeler index of separated byte strings of up to 500 bytes."""

    def __init__(self, strings: list[bytes]):
        joined = bytearray()
        self.starts = np.zeros(len(strings), np.int64)
        for i, s in enumerate(strings):
            joined.append(SEPARATOR)
            self.starts[i] = len(joined)
            joined += s
        joined.append(SEPARATOR)
        text = np.frombuffer(bytes(joined), np.uint8)
        n = self.n = len(text)
        # Separators differ from one another (in order of place), so no comparison goes on into the next string.
        packed, going = np.zeros(n, np.uint64), np.ones(n, np.uint64)
        for j in range(8):
            packed[: n - j] |= going[: n - j] * text[j:] << np.uint64(56 - 8 * j)
            going[: n - j] *= text[j:] != SEPARATOR
        ends = going == 0
        ends[max(0, n - 8) :] = True
        self._packed = packed
        order = np.argsort(packed, kind="stable")
        new = ends[order] | np.append(True, packed[order[1:]] != packed[order[:-1]])
        rank = np.empty(n, np.int32)
        rank[order] = np.flatnonzero(new)[np.cumsum(new) - 1]  # the place of the first of its equals
        self._ranks = {8: rank}
        open_ = order[~(new & np.append(new[1:], True))]  # only suffixes that have equals are sorted on, by rank
        size = 8
        while size < 512:
            rank = rank.copy()
            if len(open_):
                after = np.zeros(len(open_), np.int64)
                inside = open_ + size < n
                after[inside] = self._ranks[size][open_[inside] + size] + 1
                old = rank[open_].astype(np.int64)
                by = np.argsort(old * (n + 1) + after)
                open_, old, after = open_[by], old[by], after[by]
                group = np.append(True, old[1:] != old[:-1])
                new = group | np.append(True, after[1:] != after[:-1])
                first = np.flatnonzero(group)[np.cumsum(group) - 1]
                rank[open_] = old + np.flatnonzero(new)[np.cumsum(new) - 1] - first
                open_ = open_[~(new & np.append(new[1:], True))]
            size *= 2
            self._ranks[size] = rank
        order[rank] = np.arange(n)
        symbol = text[order - 1].astype(np.int64)
        begins = np.zeros(n, bool)
        begins[self.starts] = True
        begins[0] = True
        own = begins[order]  # a string's first suffix is a run of its own, so matches are sampled afresh there
        symbol[own] = 256 + np.flatnonzero(own)
        head = np.ones(n, bool)
        head[1:] = symbol[1:] != symbol[:-1]
        tail = np.append(head[1:], True)
        rows = np.flatnonzero(head)
        self.runs = len(rows)
        before = self._samples(order[rows], np.where(rows > 0, order[rows - 1], -1))
        rows = np.flatnonzero(tail)
        behind = self._samples(order[rows], np.where(rows < n - 1, order[np.minimum(rows + 1, n - 1)], -1))
        self._longest = np.zeros(n, np.int64)
        for where, common in (before, behind):
            np.maximum(self._longest, np.repeat(common + where, np.diff(np.append(where, n))) - np.arange(n), out=self._longest)

    def _samples(self, at: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        common = self._common(at, np.maximum(other, 0))
        common[other < 0] = 0
        by = np.argsort(at)
        return at[by], common[by]

    def _common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes at x and y, up to 511."""
        total = np.zeros(len(x), np.int64)
        for size in (256, 128, 64, 32, 16, 8):
            rank = self._ranks[size]
            i, j = x + total, y + total
            inside = np.maximum(i, j) < self.n
            same = inside & (rank[np.minimum(i, self.n - 1)] == rank[np.minimum(j, self.n - 1)])
            total[same] += size
        i, j = np.minimum(x + total, self.n - 1), np.minimum(y + total, self.n - 1)
        differ = self._packed[i] ^ self._packed[j]  # may count the bytes from a separator on; no window reaches there
        for k in range(7):
            total += (differ >> np.uint64(56 - 8 * k)) == 0
        return np.minimum(total, self.n - np.maximum(x, y))

    def matching_statistics(self, start: int, length: int) -> np.ndarray:
        """Longest match, elsewhere in the index, of the suffix at each position, streamed from the samples."""
        return self._longest[start : start + length]

    def hits(self, chosen: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """String, start and end of each maximal part of the chosen strings that ``width`` bytes or more repeat, as by ``matching_statistics``."""
        size = np.diff(np.append(self.starts, self.n)) - 1
        step = np.zeros(self.n + 1, np.int32)
        chosen = chosen[size[chosen] >= width]
        step[self.starts[chosen]] = 1
        step[self.starts[chosen] + size[chosen] - width + 1] = -1
        hit = (np.cumsum(step[:-1]) > 0) & (self._longest >= width)
        first, last = _spans(hit, width)
        of = np.searchsorted(self.starts, first, "right") - 1
        return of, first - self.starts[of], last - self.starts[of]


def _spans(hit: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1 + width


def _index_block(rows: list[tuple], width: int) -> pa.RecordBatch:
    index = RunIndex([r[3] for r in rows])
    of, first, last = index.hits(np.flatnonzero([r[4] for r in rows]), width)
    a = np.array([r[2] for r in rows], np.int64)[of]
    return pa.RecordBatch.from_arrays([pa.array([rows[i][1] for i in of.tolist()], pa.binary()), pa.array(first + a, pa.int32()), pa.array(last + a, pa.int32())], ["rid", "s", "e"])


def _match(width: int):
    """Over rows sorted by anchor: blocks that never part the rows of one anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("h", "rid", "a", "context", "single"))):
                if size > BLOCK_BYTES and row[0] != block[-1][0]:
                    yield _index_block(block, width)
                    block, size = [], 0
                block.append(row)
                size += len(row[3]) + 1
        if block:
            yield _index_block(block, width)

    return run


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, a, single, context in zip(*(batch.column(c).to_pylist() for c in ("rid", "a", "single", "context"))):
                view, n = memoryview(context), len(context) - width + 1
                both = np.frombuffer(b"".join(xxhash.xxh3_128_digest(view[i : i + width]) for i in range(n)), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array([rid] * n, pa.binary()), pa.array(np.arange(a, a + n, dtype=np.int32)), pa.array([single] * n)], ["w1", "w2", "rid", "s", "single"])

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union of each document's spans; overlapping and touching ones join."""
    for batch in batches:
        out = []
        for spans in batch.column("spans"):
            flat = spans.values
            s, e = flat.field("s").to_numpy(), flat.field("e").to_numpy()
            by = np.argsort(s, kind="stable")
            s, e = s[by], np.maximum.accumulate(e[by])
            new = np.ones(len(s), bool)
            new[1:] = s[1:] > e[:-1]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(s)) - 1
            out.append([{"s": int(x), "e": int(y)} for x, y in zip(s[first], e[last])])
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(out, kind)], ["rid", "removed"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        buf, offs = textnp.utf8(whole.column("text"))
        at = 0
        while at < whole.num_rows:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + (4 << 20), "right")) - 1)
            batch, kept = whole.slice(at, end - at), []
            for r, spans in zip(range(at, end), batch.column("removed").to_pylist()):
                text, out, last = memoryview(buf[offs[r] : offs[r + 1]]), [], 0
                for x in spans or ():
                    out.append(text[last : x["s"]])
                    last = x["e"]
                out.append(text[last:])
                kept.append(b"".join(out))
            size = pa.array(np.diff(offs[at : end + 1]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), size, batch.column("removed"), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "removed", "kept"])
            at = end


def remove_long_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) for every row of ``docs`` (doc_id, text, ...).

    ``removed`` lists the maximal byte spans covered by ``width``-byte strings that also start
    anywhere else in the table, the same text included; ``kept`` is the rest of the bytes, which
    may begin or end inside a character. Null text counts as empty; texts shorter than ``width`` keep
    all bytes. Repeated rows are texts of their own, so each is a repeat of the other. Rows with
    null or repeated doc_ids are judged by their own text. Other columns are unused, whatever
    their names. Judged on the input: all repeats go, first ones included.
    ``width`` is from 8 to 250.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "runindex")
    texts = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ident = F.coalesce(F.col("doc_id").cast("string"), F.lit("\0"))
    texts = texts.withColumn("rid", F.unhex(F.md5(F.concat(F.length(ident), F.lit(":"), ident, "text").cast("binary"))))
    runs = scratch.save(texts.select("rid", "text").mapInArrow(_runs(width), "h long, c long, rid binary, a int, n smallint"), "runs")
    anchors = runs.groupBy("h").agg(F.count("*").alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("k > 1")
    again = scratch.save(runs.join(anchors.select("h", (F.col("lo") != F.col("hi")).alias("mixed")), "h"), "again")
    scratch.drop("runs")
    end = (F.col("a") + F.col("n") - 1 + width).cast("int").alias("e")
    mixed = again.where("mixed").drop("mixed")
    alike = mixed.groupBy("h", "c").agg(F.count("*").alias("k"), F.min(F.struct("rid", "a", "n")).alias("one"))
    alike = scratch.save(alike, "alike")
    hot = alike.groupBy("h").count().where(F.col("count") > HOT).select("h", F.lit(True).alias("hot"))
    wanted = alike.join(hot, "h", "left").select("one.rid", F.struct("h", "one.a", "one.n", (F.col("k") == 1).alias("single"), F.coalesce("hot", F.lit(False)).alias("hot")).alias("w"))
    wanted = scratch.save(wanted.groupBy("rid").agg(F.collect_list("w").alias("wanted")), "wanted")
    # Equal rows share a rid; one text of them is enough here.
    cut = texts.select("rid", "text").join(wanted.hint("merge"), "rid").mapInArrow(_cut(width), "h long, rid binary, a int, single boolean, hot boolean, context binary").dropDuplicates(["h", "rid", "a"])
    cut = scratch.save(cut, "cut")
    matched = cut.where("NOT hot").repartition("h").sortWithinPartitions("h").select("h", "rid", "a", "context", "single").mapInArrow(_match(width), "rid binary, s int, e int")
    windows = scratch.save(cut.where("hot").select("rid", "a", "single", "context").mapInArrow(_windows(width), "w1 long, w2 long, rid binary, s int, single boolean"), "windows")
    counted = windows.join(windows.groupBy("w1", "w2").count().where("count > 1").drop("count"), ["w1", "w2"]).where("single")
    spans = (
        again.where("NOT mixed").select("rid", F.col("a").alias("s"), end)
        .unionByName(mixed.join(alike.where("k > 1").select("h", "c"), ["h", "c"]).select("rid", F.col("a").alias("s"), end))
        .unionByName(matched)
        .unionByName(counted.select("rid", "s", (F.col("s") + width).cast("int").alias("e")))
    )
    # Equal rows give equal spans.
    grouped = spans.distinct().groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    removed = scratch.save(grouped.mapInArrow(_merge, "rid binary, removed array<struct<s:int,e:int>>"), "removed")
    scratch.drop("again", "alike", "wanted", "cut", "windows")
    return texts.join(removed.hint("merge"), "rid", "left").select("doc_id", "text", "removed").mapInArrow(_keep, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, n_bytes long, removed array<struct<s:int,e:int>>, kept binary")


def op4_runindex(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_long_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda t, x: t + x["e"] - x["s"]), F.lit(0).cast("long"))
    n_spans = F.when(F.col("removed").isNull(), 0).otherwise(F.size("removed")).cast("long")
    return out.select("doc_id", "n_bytes", n_removed.alias("n_removed"), n_spans.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
