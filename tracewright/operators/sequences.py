"""Token runs shared by all samples: finding, collapsing and naming them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lists as L
from ..session import cut
from .traces import TraceSet

SEP = "\x00"


def ngrams(tokens: DataFrame, n: int, key: str = "sample_id") -> DataFrame:
    """(key, pos, gram): every window of exactly n consecutive tokens, as one string."""
    w = Window.partitionBy(key).orderBy("pos")
    parts = [F.col("token"), *(F.lead("token", i).over(w) for i in range(1, n))]
    rows = tokens.select(key, "pos", F.array(*parts).alias("g"))
    return rows.where(F.forall("g", lambda x: x.isNotNull())).select(key, "pos", F.array_join("g", SEP).alias("gram"))


def common_ngrams(grams: DataFrame, samples: int, key: str = "sample_id") -> DataFrame:
    """(gram): those that stand in every one of ``samples`` samples."""
    return grams.groupBy("gram").agg(F.count_distinct(key).alias("k")).where(F.col("k") == samples).select("gram")


def least_sample(lists: L.Lists) -> list[str]:
    """The tokens of the sample with the fewest, the first such by id; what all samples share stands in it."""
    least = lists.lengths().agg(F.min_by("sample_id", F.struct("n", "sample_id")).alias("s")).first().s
    row = lists.arrays().where(F.col("sample_id") == least).first()
    return list(row.list or []) if row else []


def ngram_intersection(lists: L.Lists, samples: int, n: int) -> DataFrame:
    """(gram): the n-grams in every one of ``samples`` samples. One sample's are sought in all others; no other n-gram leaves its row."""
    found = L.common_ngrams(lists, least_sample(lists), n, SEP)
    return found.groupBy("gram").agg(F.sum("k").alias("k")).where(F.col("k") == samples).select("gram")


def shared_run_lengths(tokens: DataFrame, first: str, samples: int, n: int, key: str = "sample_id", lists: L.Lists | None = None) -> DataFrame:
    """(pos, len): for each start in the sample ``first``, how far its tokens stand in every other sample too.

    What is left of a run over the samples of a part of the table is all that leaves the part: the starts that stand in
    all its samples, each with its shortest length.
    """
    lists = lists or L.Lists.of(tokens.withColumnRenamed(key, "sample_id"))
    row = lists.rows.where(F.col("sample_id") == first).select(lists.list.alias("list"), (F.lit(None) if lists.pos is None else lists.pos).alias("pos")).first()
    mine = list(row.list or []) if row else []
    found = L.shared_runs(lists, first, mine, n).groupBy("i").agg(F.min("len").alias("len"), F.sum("k").alias("k")).where(F.col("k") == samples - 1)
    at = F.col("i") if lists.pos is None or not mine or list(row.pos) == list(range(len(mine))) else F.element_at(F.array(*map(F.lit, row.pos)), (F.col("i") + 1).cast("int"))
    return found.select(at.cast("long").alias("pos"), "len")


def maximal_runs(runs: list[tuple[int, list[str]]]) -> list[tuple[int, list[str]]]:
    """Distinct runs, longest first then by first start, none whose joined string lies inside a kept one."""
    kept: list[tuple[int, list[str]]] = []
    seen: set[str] = set()
    for start, run in sorted(runs, key=lambda r: (-len(r[1]), r[0])):
        text = SEP.join(run)
        if text not in seen and not any(text in SEP.join(k) for _, k in kept):
            kept.append((start, run))
        seen.add(text)
    return kept


def _clean(ts: TraceSet) -> DataFrame:
    """(sample_id, pos, token, native): tokens that may collapse, renumbered, with a unique marker before every later text.

    References, tokens with extras and annotated tokens are left out; what stood around them then touches.
    """
    blocked = ts.annotations.select("sample_id", "start", "end")
    t = ts.tokens.where("id IS NOT NULL AND extras IS NULL")
    spread = blocked.select("sample_id", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos")).distinct()
    t = t.join(spread, ["sample_id", "pos"], "left_anti").select("sample_id", F.col("pos").alias("native"), F.lit(1).alias("kind"), "token")
    marks = ts.texts.where("parent IS NULL AND start > 0").select("sample_id", F.col("start").alias("native"), F.lit(0).alias("kind"), F.concat(F.lit("\x01"), "sample_id", F.lit("\x01"), "path").alias("token"))
    w = Window.partitionBy("sample_id").orderBy("native", "kind", "token")
    return t.unionByName(marks).withColumn("pos", (F.row_number().over(w) - 1).cast("long"))


def _collapse(sequences: list[tuple[str, list[str], list[int]]]):
    """Left to right, the longest sequence that fits: strings and ids alike, nothing blocked, no text border inside."""
    first: dict[tuple[str, int], list[tuple[str, list[str], list[int]]]] = {}
    for s in sorted(sequences, key=lambda s: -len(s[1])):
        first.setdefault((s[1][0], s[2][0]), []).append(s)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for sample_id, ids, tokens, extras, blocked, border in frame.itertuples(index=False):
                ids, tokens, extras = list(ids), list(tokens), list(extras)
                stop, edges = set(blocked), set(border)
                rows, i, at = [], 0, 0
                n = len(tokens)
                while i < n:
                    hit = None
                    if ids[i] is not None and ids[i] == ids[i] and i not in stop:
                        for name, strings, numbers in first.get((tokens[i], int(ids[i])), ()):
                            k = len(strings)
                            if i + k <= n and tokens[i : i + k] == strings and ids[i : i + k] == numbers and not any(j in stop or (j > i and j in edges) for j in range(i, i + k)):
                                hit = (name, k)
                                break
                    if hit:
                        rows += [(sample_id, i + j, at, hit[1], None, hit[0], None) for j in range(hit[1])]
                        i += hit[1]
                    else:
                        rows.append((sample_id, i, at, 1, ids[i], tokens[i], extras[i]))
                        i += 1
                    at += 1
                out = pd.DataFrame(rows, columns=["sample_id", "pos", "start", "k", "id", "token", "extras"])
                out["id"] = out["id"].astype("Int64")
                yield out

    return run


def _named(runs: list[tuple[int, list[str]]], words: list[str], ids: list[int], taken: set[str]) -> list[tuple[str, list[str], list[int]]]:
    """Names, strings and ids of the maximal runs, the ids from where a run stands first."""
    fresh, number = [], 0
    for _, run in maximal_runs(runs):
        at = next((i for i in range(len(words) - len(run) + 1) if words[i] == run[0] and words[i : i + len(run)] == run), None)
        if at is None:
            continue
        while f"seq_{number}" in taken:
            number += 1
        name = f"seq_{number}"
        taken.add(name)
        fresh.append((name, run, ids[at : at + len(run)]))
    return fresh


def _deduplicate_lists(ts: TraceSet, first: str, k: int, min_length: int) -> TraceSet:
    """The same where each sample is a list still and nothing is annotated: runs are sought and replaced inside the rows."""
    lists = ts.listed
    row = lists.arrays().where(F.col("sample_id") == first).first()
    words, ids = list(row.list or []), list(row.ids or [])
    if k == 1:
        runs = [(0, words)] if len(words) >= min_length else []
    else:
        runs = [(r.pos, words[r.pos : r.pos + r.len]) for r in shared_run_lengths(ts.tokens, first, k, min_length, lists=lists).collect()]
    fresh = _named(runs, words, ids, {r.seq_id for r in ts.sequences.select("seq_id").collect()})
    if not fresh:
        return ts
    known = {n: (strings, numbers) for n, strings, numbers in fresh}
    out = ts._with_lists(lists.replaced(known))
    return _with_sequences(ts, out, fresh)


def _with_sequences(ts: TraceSet, out: TraceSet, fresh: list[tuple[str, list[str], list[int]]]) -> TraceSet:
    """``out`` with the sequences of ``ts`` and the fresh ones behind them."""
    spark = ts.tokens.sparkSession
    last = ts.sequences.agg(F.max("seq_ord")).first()[0]
    base = 0 if last is None else last + 1
    seqs = spark.createDataFrame([(base + i, f[0]) for i, f in enumerate(fresh)], "seq_ord long, seq_id string")
    seq_tokens = spark.createDataFrame([(f[0], i, t, s) for f in fresh for i, (s, t) in enumerate(zip(f[1], f[2]))], "seq_id string, seq_pos long, id long, token string")
    return replace(out, sequences=ts.sequences.unionByName(seqs), sequence_tokens=ts.sequence_tokens.unionByName(seq_tokens), no_sequences=False)


def deduplicate(ts: TraceSet, min_length: int = 5) -> TraceSet:
    """A bundle in which runs of ``min_length`` tokens or more shared by all samples are references.

    New sequences are named seq_0, seq_1, ... past existing ids, longest first, then by their first start in
    the first sample. Existing sequences take part in the replacement; if no run is found nothing changes. With a
    single sample every position extends to its end. Annotations, text offsets and spans follow.
    """
    if min_length < 1:
        return ts
    order = ts.samples.select("sample_id", "sample_ord")
    k = order.count()
    if not k:
        return ts
    first = order.orderBy("sample_ord").first().sample_id
    if ts._plain and not ts.listed.steps:
        return _deduplicate_lists(ts, first, k, min_length)
    clean = cut(_clean(ts))
    # The first sample alone comes to the driver, as naming and maximality are decided on it.
    mine = [(r.token, r.native, r.kind) for r in clean.where(F.col("sample_id") == first).orderBy("pos").collect()]
    words = [m[0] for m in mine]
    if k == 1:
        runs = [(0, words)] if len(words) >= min_length else []
    else:
        runs = [(r.pos, words[r.pos : r.pos + r.len]) for r in shared_run_lengths(clean, first, k, min_length).collect()]
    ids = {r.pos: r.id for r in ts.tokens.where((F.col("sample_id") == first) & F.col("id").isNotNull()).select("pos", "id").collect()}
    taken = {r.seq_id for r in ts.sequences.select("seq_id").collect()}
    plain = [(m[0], ids[m[1]]) for m in mine if m[2]]
    fresh = _named(runs, [p[0] for p in plain], [p[1] for p in plain], taken)
    if not fresh:
        return ts
    old = ts.sequence_tokens.orderBy("seq_id", "seq_pos").collect()
    known: dict[str, tuple[list[str], list[int]]] = {}
    for r in old:
        known.setdefault(r.seq_id, ([], []))[0].append(r.token)
        known[r.seq_id][1].append(r.id)
    everything = [(n, *v) for n, v in known.items()] + fresh
    rows = ts.tokens.groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("pos", "id", "token", "extras"))).alias("t"))
    spread = ts.annotations.select("sample_id", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"))
    extra = ts.tokens.where("extras IS NOT NULL OR id IS NULL").select("sample_id", "pos")
    blocked = spread.unionByName(extra).groupBy("sample_id").agg(F.collect_set("pos").alias("blocked"))
    border = ts.texts.where("parent IS NULL AND start > 0").groupBy("sample_id").agg(F.collect_set("start").alias("border"))
    none = F.array().cast("array<bigint>")
    packed = rows.join(blocked, "sample_id", "left").join(border, "sample_id", "left").select("sample_id", "t.id", "t.token", "t.extras", F.coalesce("blocked", none).alias("blocked"), F.coalesce("border", none).alias("border"))
    moved = packed.mapInPandas(_collapse(everything), "sample_id string, pos long, start long, k long, id long, token string, extras string")
    moved = cut(moved)
    tokens = moved.select("sample_id", F.col("start").alias("pos"), "id", "token", "extras").distinct()
    pieces = moved.select("sample_id", "pos", "start", F.lit(1).cast("long").alias("len"), F.lit(False).alias("expanded"))
    out = ts._remap(tokens, pieces)
    out = replace(out, spans=out.spans.distinct())
    return _with_sequences(ts, out, fresh)
