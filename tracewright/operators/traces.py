"""Token traces as a bundle of lazy tables; every operator returns a new bundle.

Positions are native: a sequence reference (null id, the token naming the sequence) counts one.
Expanded positions count a reference's tokens. Everything is keyed by sample_id, so ranges
and positions always meet within one sample and no join lacks an equality.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lists as L
from ..functions import ranges as R
from ..functions.regex import matches
from ..functions.tokenizers import tokenize_file, tokenize_lists
from ..functions.tokens import char_tokens, explode_tokens, token_id, word_tokens
from ..session import cut

SAMPLES = "sample_ord long, sample_id string, target string, error string, input_tokens long, output_tokens long, metadata string"
TOKENS = "sample_id string, pos long, id long, token string, extras string"
SEQUENCES = "seq_ord long, seq_id string"
SEQUENCE_TOKENS = "seq_id string, seq_pos long, id long, token string"
ANNOTATIONS = "sample_id string, ann_ord long, name string, start long, end long, metadata string"
SPANS = "sample_id string, span_ord long, name string, position long, tags string"
TEXTS = "sample_id string, path string, parent string, name string, value string, start long, end long, metadata string"
SCORES = "sample_id string, score_ord long, scorer string, value string, answer string, explanation string, metadata string"
ROLE_SOURCE = '{"source":"message_role"}'


@dataclass(frozen=True)
class TraceSet:
    """Samples, their tokens and what is known of them. Score values and bags of extras are JSON text."""

    samples: DataFrame
    tokens: DataFrame
    sequences: DataFrame
    sequence_tokens: DataFrame
    annotations: DataFrame
    spans: DataFrame
    texts: DataFrame
    scores: DataFrame
    metadata: dict[str, Any] = field(default_factory=lambda: {"model": {"name": "unknown"}})
    #: Known to be without sequences or annotations, so that plans leave out their joins.
    no_sequences: bool = False
    no_annotations: bool = False
    no_spans: bool = False
    #: The tokens, the same as one array a sample, and the texts that span them whole: known as long as the tokens are these.
    lists: tuple[DataFrame, L.Lists, DataFrame] | None = None
    #: The annotations, as long as no two of one name are known to overlap.
    merged: DataFrame | None = None

    @classmethod
    def empty(cls, spark: SparkSession, **tables: Any) -> TraceSet:
        made = {n: spark.createDataFrame([], s) for n, s in (("samples", SAMPLES), ("tokens", TOKENS), ("sequences", SEQUENCES), ("sequence_tokens", SEQUENCE_TOKENS), ("annotations", ANNOTATIONS), ("spans", SPANS), ("texts", TEXTS), ("scores", SCORES))}
        known = {"no_sequences": "sequence_tokens" not in tables, "no_annotations": "annotations" not in tables, "no_spans": "spans" not in tables}
        return cls(**{**made, **known, **tables})

    @classmethod
    def from_texts(cls, texts: DataFrame, tokens: Column | str | None = None, char_ids: bool = False, tokenizer: str | None = None) -> TraceSet:
        """One sample a row of (sample_ord, sample_id, text), with one text over all its tokens.

        Tokens are those of the ``tokenizer`` file, of the column expression ``tokens``, characters (``chars``) with their
        code points as ids, or else words.
        """
        spark = texts.sparkSession
        split = tokens if isinstance(tokens, str) else "words" if tokens is None else None
        expression, char_ids = (tokens, char_ids) if split is None else (char_tokens(F.col("text")), True) if split == "chars" else (word_tokens(F.col("text")), char_ids)
        rows = tokenize_file(texts, ["sample_id"], tokenizer) if tokenizer else explode_tokens(texts, ["sample_id"], expression, char_ids)
        rows = rows.withColumn("extras", F.lit(None).cast("string"))
        if tokenizer:
            made = L.Lists(tokenize_lists(texts, ["sample_id"], tokenizer), F.col("list"), F.col("ids"))
            whole = texts.join(made.lengths(), "sample_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        else:
            made = L.Lists(texts.select("sample_id", "text"), expression, F.transform(expression, lambda t: F.ascii(t).cast("long") if char_ids else token_id(t)), split=split)
            whole = texts.withColumn("n", F.coalesce(F.size(expression), F.lit(0)))
        whole = whole.select("sample_id", F.lit("0").alias("path"), F.lit(None).cast("string").alias("parent"), F.lit("text_0").alias("name"), F.col("text").alias("value"), F.lit(0).cast("long").alias("start"), F.greatest("n", F.lit(0)).cast("long").alias("end"), F.lit("{}").alias("metadata"))
        none = F.lit(None)
        samples = texts.select(F.col("sample_ord").cast("long").alias("sample_ord"), "sample_id", none.cast("string").alias("target"), none.cast("string").alias("error"), none.cast("long").alias("input_tokens"), none.cast("long").alias("output_tokens"), F.lit("{}").alias("metadata"))
        return cls.empty(spark, samples=samples, tokens=rows, texts=whole, lists=(rows, made, whole))

    @property
    def listed(self) -> L.Lists | None:
        """The tokens as lists, if they still are those of ``lists``."""
        return self.lists[1] if self.lists and self.lists[0] is self.tokens else None

    def lengths(self) -> DataFrame:
        """(sample_id, n) of the samples with tokens."""
        return self.listed.lengths() if self.listed else self.tokens.groupBy("sample_id").agg(F.count("*").alias("n"))

    def _with_lists(self, lists: L.Lists, keep_texts: bool = True) -> TraceSet:
        """The bundle over the tokens of other lists; texts that span all tokens still do."""
        rows = lists.exploded().select("sample_id", "pos", "id", "token", F.lit(None).cast("string").alias("extras"))
        texts = self.texts.drop("end").join(lists.lengths().hint("merge"), "sample_id", "left").withColumn("end", F.coalesce("n", F.lit(0)).cast("long")).select(*self.texts.columns)
        return replace(self, tokens=rows, texts=texts, lists=(rows, lists, texts))

    # -- annotations and spans -------------------------------------------------------------

    def annotate(self, found: DataFrame, metadata: str = "{}") -> TraceSet:
        """Merge ranges (sample_id, name, start, end) into the annotations; of one name, the first metadata stays."""
        if self.no_annotations:
            order = Window.partitionBy("sample_id").orderBy("name")
            fresh = R.merge_ranges(found, ["sample_id", "name"]).select("sample_id", (F.dense_rank().over(order) - 1).cast("long").alias("ann_ord"), "name", "start", "end", F.lit(metadata).alias("metadata"))
            return replace(self, annotations=fresh, no_annotations=False, merged=fresh)
        last = self.annotations.groupBy("sample_id").agg(F.max("ann_ord").alias("last"))
        order = Window.partitionBy("sample_id").orderBy("name")
        fresh = found.select("sample_id", "name").distinct().withColumn("k", F.row_number().over(order)).join(last, "sample_id", "left")
        fresh = found.join(fresh, ["sample_id", "name"]).select("sample_id", (F.coalesce("last", F.lit(-1)) + F.col("k")).cast("long").alias("ann_ord"), "name", "start", "end", F.lit(metadata).alias("metadata"))
        both = self.annotations.unionByName(fresh.select(*self.annotations.columns))
        first = both.groupBy("sample_id", "name").agg(F.min_by("metadata", "ann_ord").alias("metadata"), F.min("ann_ord").alias("ann_ord"))
        merged = R.merge_ranges(both, ["sample_id", "name"]).drop("range_ord")
        out = merged.join(first, ["sample_id", "name"]).select(*self.annotations.columns)
        return replace(self, annotations=out, merged=out)

    def annotate_positions(self, positions: DataFrame, metadata: str = "{}") -> TraceSet:
        """Annotate (sample_id, name, pos); no position, no annotation."""
        found = R.positions_to_ranges(positions, ["sample_id", "name"])
        if self.no_annotations:  # islands are merged already
            order = Window.partitionBy("sample_id").orderBy("name")
            fresh = found.select("sample_id", (F.dense_rank().over(order) - 1).cast("long").alias("ann_ord"), "name", "start", "end", F.lit(metadata).alias("metadata"))
            return replace(self, annotations=fresh, no_annotations=False, merged=fresh)
        return self.annotate(found, metadata)

    def annotation_positions(self, name: str) -> DataFrame:
        return R.ranges_to_positions(self.annotations.where(F.col("name") == name), ["sample_id"], self.merged is self.annotations)

    def position_sets(self, any_of: Iterable[str], none_of: Iterable[str] = ()) -> DataFrame:
        """(sample_id, positions): the distinct positions with one of some annotations and none of others; one row a sample, where there are some.

        All names are found in one reading; what meets in a sample's row are its ranges.
        """
        some, none = set(any_of), set(none_of)
        a = self.annotations.where(F.col("name").isin(sorted(some | none)) & (F.col("start") < F.col("end")))
        of = lambda names: F.collect_list(F.when(F.col("name").isin(sorted(names)), F.struct("start", "end")))
        g = a.groupBy("sample_id").agg(of(some).alias("some"), of(none).alias("none"))
        covered = lambda c: F.flatten(F.transform(c, lambda r: F.sequence(r["start"], r["end"] - 1)))
        return g.select("sample_id", F.array_except(covered("some"), covered("none")).alias("positions")).where(F.size("positions") > 0)

    def remove_annotation(self, name: str) -> TraceSet:
        kept = self.annotations.where(F.col("name") != name)
        return replace(self, annotations=kept, merged=kept if self.merged is self.annotations else None)

    def create_span_from_tag(self, tag: str, span: str) -> TraceSet:
        """A span with the tag's positions in every sample that has some, after the sample's other spans."""
        last = self.spans.groupBy("sample_id").agg(F.max("span_ord").alias("last"))
        new = self.annotation_positions(tag).join(last, "sample_id", "left").select("sample_id", (F.coalesce("last", F.lit(-1)) + 1).cast("long").alias("span_ord"), F.lit(span).alias("name"), F.col("pos").alias("position"), F.to_json(F.array(F.lit(tag))).alias("tags"))
        return replace(self, spans=self.spans.unionByName(new), no_spans=False)

    # -- expansion -------------------------------------------------------------------------

    def pieces(self, chosen: DataFrame | None = None) -> DataFrame:
        """(sample_id, pos, start, len): where each native position goes if all references (or the ``chosen`` ones) expand."""
        n = self.sequence_tokens.groupBy("seq_id").agg(F.count("*").alias("n"))
        t = self.tokens.select("sample_id", "pos", F.when(F.col("id").isNull(), F.col("token")).alias("seq_id"))
        if chosen is not None:
            t = t.join(chosen.select("sample_id", "pos", F.lit(True).alias("open")), ["sample_id", "pos"], "left").withColumn("seq_id", F.when(F.col("open"), F.col("seq_id"))).drop("open")
        sized = t.join(n, "seq_id", "left").withColumn("len", F.coalesce("n", F.lit(1)).cast("long"))
        before = Window.partitionBy("sample_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        return sized.select("sample_id", "pos", F.coalesce(F.sum("len").over(before), F.lit(0)).cast("long").alias("start"), "len", F.col("n").isNotNull().alias("expanded"))

    def missing_sequences(self) -> DataFrame:
        """(sample_id, pos, seq_id) of references to no sequence."""
        refs = self.tokens.where("id IS NULL").select("sample_id", "pos", F.col("token").alias("seq_id"))
        return refs.join(self.sequences, "seq_id", "left_anti").select("sample_id", "pos", "seq_id")

    def expanded_tokens(self, chosen: DataFrame | None = None) -> DataFrame:
        """Tokens with references replaced; vocabulary tokens keep their extras. ``from_pos`` is the native position."""
        if self.no_sequences:
            return self.tokens.select("sample_id", "pos", "id", "token", "extras", F.col("pos").alias("from_pos"), F.lit(None).cast("string").alias("seq_id"))
        if self.listed and chosen is None:
            return self.listed.expanded().exploded().select("sample_id", "pos", "id", "token", F.lit(None).cast("string").alias("extras"), "from_pos", "seq_id")
        t = self.tokens.join(self.pieces(chosen), ["sample_id", "pos"])
        inner = F.col("expanded")
        s = self.sequence_tokens.select(F.col("seq_id").alias("sid"), "seq_pos", F.col("id").alias("sid_id"), F.col("token").alias("sid_token"))
        j = t.join(s, inner & (F.col("token") == F.col("sid")), "left")
        return j.select(
            "sample_id", (F.col("start") + F.coalesce("seq_pos", F.lit(0))).alias("pos"), F.when(inner, F.col("sid_id")).otherwise(F.col("id")).alias("id"),
            F.when(inner, F.col("sid_token")).otherwise(F.col("token")).alias("token"), F.when(~inner, F.col("extras")).alias("extras"), F.col("pos").alias("from_pos"), F.when(inner, F.col("token")).alias("seq_id"),
        )

    def _remap(self, tokens: DataFrame, pieces: DataFrame, keep_spans: bool = False) -> TraceSet:
        """The bundle over new tokens; annotations and text offsets follow, spans too unless ``keep_spans``."""
        first = pieces.select("sample_id", F.col("pos").alias("start"), F.col("start").alias("s"))
        last = pieces.select("sample_id", (F.col("pos") + 1).alias("end"), (F.col("start") + F.col("len")).alias("e"))
        a = self.annotations.join(first, ["sample_id", "start"]).join(last, ["sample_id", "end"])
        ann = a.select("sample_id", "ann_ord", "name", F.col("s").alias("start"), F.col("e").alias("end"), "metadata")
        # An empty text range has no last token: it stands where its start went, or at the end.
        total = pieces.groupBy("sample_id").agg(F.max(F.col("start") + F.col("len")).alias("total"))
        t = self.texts.join(first, ["sample_id", "start"], "left").join(last, ["sample_id", "end"], "left").join(total, "sample_id", "left")
        s, e = F.coalesce("s", "total", F.lit(0)), F.when(F.col("start") == F.col("end"), F.coalesce("s", "total", F.lit(0))).otherwise(F.col("e"))
        texts = t.select("sample_id", "path", "parent", "name", "value", F.when(F.col("start").isNotNull(), s).alias("start"), F.when(F.col("start").isNotNull(), e).alias("end"), "metadata")
        spans = self.spans
        if not keep_spans:
            p = pieces.select("sample_id", F.col("pos").alias("position"), "start", "len")
            spread = F.explode(F.sequence(F.col("start"), F.col("start") + F.col("len") - 1))
            spans = self.spans.join(p, ["sample_id", "position"]).select("sample_id", "span_ord", "name", spread.alias("position"), "tags")
        return replace(self, tokens=tokens.select(*self.tokens.columns), annotations=ann, texts=texts, spans=spans)

    def materialize(self, chosen: DataFrame, keep_spans: bool = False) -> TraceSet:
        """Expand the references at ``chosen`` (sample_id, pos) in place; everything else follows."""
        if self.no_sequences:
            return self
        return self._remap(self.expanded_tokens(chosen), self.pieces(chosen), keep_spans)

    def expand_sequences(self) -> TraceSet:
        """All references expanded; no sequences left."""
        if self._plain:
            out = self._with_lists(self.listed.expanded())
            return replace(out, sequences=self.sequences.limit(0), sequence_tokens=self.sequence_tokens.limit(0), no_sequences=True)
        out = self._remap(self.expanded_tokens(), self.pieces())
        return replace(out, sequences=self.sequences.limit(0), sequence_tokens=self.sequence_tokens.limit(0), no_sequences=True)

    @property
    def _plain(self) -> bool:
        """Whether lists are all there is: only texts that span all tokens would have to follow a change of them."""
        return bool(self.listed and self.no_annotations and self.no_spans and self.lists[2] is self.texts)

    def materialize_position(self, sample_id: str, expanded: int) -> tuple[TraceSet, int]:
        """Expand only the reference that holds the expanded position; the bundle and the native index. IndexError outside."""
        p = self.pieces().where((F.col("sample_id") == sample_id) & (F.col("start") <= expanded) & (F.col("start") + F.col("len") > expanded)).first() if expanded >= 0 else None
        if p is None:
            raise IndexError(f"position {expanded} is outside sample {sample_id}")
        if not p.expanded:
            return self, p.pos
        here = self.tokens.sparkSession.createDataFrame([(sample_id, p.pos)], "sample_id string, pos long")
        return self.materialize(here), p.pos + expanded - p.start

    def materialize_inconsistent(self, signature: DataFrame) -> TraceSet:
        """Expand the references whose expanded positions carry more than one signature (sample_id, pos, sig); none counts as one."""
        if self.no_sequences:
            return self
        e = self.expanded_tokens().where("seq_id IS NOT NULL").select("sample_id", "pos", "from_pos")
        sig = e.join(signature, ["sample_id", "pos"], "left").groupBy("sample_id", "from_pos").agg(F.count_distinct(F.struct(F.col("sig").isNull(), "sig")).alias("k"))
        return self.materialize(sig.where("k > 1").select("sample_id", F.col("from_pos").alias("pos")))

    # -- tagging ---------------------------------------------------------------------------

    def tag_by_predicates(self, tags: Iterable[tuple[Column, str]], on_refs: bool = True, sequences: bool = True) -> TraceSet:
        """Annotate the tokens (columns id, token, extras) that a predicate holds for, all in one pass.

        References of sequences with a hit are expanded in place. With ``on_refs`` a predicate also sees
        references as they are (null id); a null result is no hit. A tag without a hit adds no annotation.
        """
        tags = list(tags)
        hit = F.filter(F.array(*(F.when(F.coalesce(p, F.lit(False)), F.lit(n)) for p, n in tags)), lambda x: x.isNotNull())
        ts = self
        if sequences:
            inside = self.sequence_tokens.withColumn("extras", F.lit(None).cast("string")).where(F.size(hit) > 0).select("seq_id").distinct()
            refs = self.tokens.where("id IS NULL").select("sample_id", "pos", F.col("token").alias("seq_id")).join(inside, "seq_id", "left_semi")
            ts = self.materialize(refs)
        rows = ts.tokens if on_refs else ts.tokens.where("id IS NOT NULL")
        return ts.annotate_positions(rows.select("sample_id", "pos", F.explode(F.array_distinct(hit)).alias("name")))

    def tag_by_regexes(self, tags: Iterable[tuple[str, str]], sequences: bool = True) -> TraceSet:
        """As predicates over token strings; references have no string of their own. Several patterns may share a tag."""
        tags = list(tags)
        if self.listed and self.no_annotations and (self._plain or not self.listed.sequences or not sequences):
            return self._tag_lists(tags, sequences)
        return self.tag_by_predicates([(matches(F.col("token"), p), t) for p, t in tags], on_refs=False, sequences=sequences)

    def _tag_lists(self, tags: list[tuple[str, str]], sequences: bool) -> TraceSet:
        """The same where each sample is a list still: references are expanded and islands found inside the row, without a shuffle."""
        ts = self
        if sequences and self.listed.sequences:
            hit = {n for n, (tokens, _) in self.listed.sequences.items() if any(re.search(p, t) for p, _ in tags for t in tokens)}
            if hit:
                ts = self._with_lists(self.listed.expanded(hit))
        found = L.tagged(ts.listed, tags).withColumn("metadata", F.lit("{}"))
        return replace(ts, annotations=found, no_annotations=False, merged=found)

    def tag_by_regex(self, pattern: str, tag: str, sequences: bool = True) -> TraceSet:
        return self.tag_by_regexes([(pattern, tag)], sequences)

    def tag_by_text_regex(self, pattern: str, tag: str, mode: str = "all", expand: bool = False) -> TraceSet:
        """Annotate the tokens that overlap a match in the joined text: all of them, or each match's first or last.

        A reference stands in the text with its sequence's name, unless ``expand``.
        """
        from .textmatch import overlapping

        lists = self.listed if self.listed and not (expand and self.listed.sequences) else None
        return self.annotate_positions(overlapping(self.expanded_tokens() if expand else self.tokens, pattern, mode, lists).withColumn("name", F.lit(tag)))

    def tag_special_tokens(self, ids: Iterable[int], tag: str = "special") -> TraceSet:
        return self.annotate_positions(self.tokens.where(F.col("id").isin(list(ids))).select("sample_id", "pos", F.lit(tag).alias("name")))

    # -- selection -------------------------------------------------------------------------

    def select_by_positions(self, positions: Iterable[int]) -> DataFrame:
        """Tokens at the given positions, ascending and once; others, negative ones too, are passed over."""
        return self.tokens.where(F.col("pos").isin(sorted(set(positions))))

    def select_by_slice(self, start: int | None = None, stop: int | None = None, step: int | None = None) -> DataFrame:
        """Tokens in a slice of every sample, with Python's rules for negative and missing bounds."""
        step = 1 if step is None else step
        if not step:
            raise ValueError("slice step cannot be zero")
        n = F.col("n")

        def bound(v: int | None, default: Column) -> Column:
            if v is None:
                return default
            x = F.lit(v) if v >= 0 else n + v
            return F.least(F.greatest(x, F.lit(0)), n) if step > 0 else F.least(F.greatest(x, F.lit(-1)), n - 1)

        lo, hi = bound(start, F.lit(0) if step > 0 else n - 1), bound(stop, n if step > 0 else F.lit(-1))
        sized = self.tokens.join(self.tokens.groupBy("sample_id").agg(F.count("*").alias("n")), "sample_id")
        pos = F.col("pos")
        inside = (pos >= lo) & (pos < hi) if step > 0 else (pos <= lo) & (pos > hi)
        return sized.where(inside & (F.pmod(pos - lo, F.lit(abs(step))) == 0)).drop("n")

    def select_by_annotation(self, name: str) -> DataFrame:
        """Tokens of an annotation. Of lists, only samples that have it are looked into; else positions meet under equal keys."""
        a = self.annotations.where((F.col("name") == name) & (F.col("start") < F.col("end")))
        if not self.listed or self.listed.steps:
            return self.tokens.join(R.ranges_to_positions(a, ["sample_id"]), ["sample_id", "pos"], "left_semi")
        at = a.groupBy("sample_id").agg(F.collect_list(F.struct("start", "end")).alias("__r"))
        j = self.listed.arrays((at, "inner"))
        spread = F.array_distinct(F.flatten(F.transform("__r", lambda r: F.sequence(r["start"], r["end"] - 1))))
        picked = F.transform(F.filter(spread, lambda p: (p >= 0) & (p < F.size("list"))), lambda p: F.struct(p.alias("pos"), F.get("ids", p.cast("int")).alias("id"), F.get("list", p.cast("int")).alias("token")))
        return j.select("sample_id", F.explode(picked).alias("t")).select("sample_id", "t.pos", "t.id", "t.token", F.lit(None).cast("string").alias("extras"))

    def select_by_span(self, name: str) -> DataFrame:
        p = self.spans.where(F.col("name") == name).select("sample_id", F.col("position").alias("pos"))
        return self.tokens.join(p, ["sample_id", "pos"], "left_semi")

    def text_parts(self) -> DataFrame:
        """(sample_id, parts): path and joined tokens of each text that has tokens, by path; one row a sample."""
        at = self.texts.where("start < end").groupBy("sample_id").agg(F.sort_array(F.collect_list(F.struct("path", "start", "end"))).alias("__r"))
        rows = (self.listed if self.listed and not self.listed.steps else L.Lists.of(self.tokens)).arrays((at, "inner"))
        cut_out = lambda r: F.array_join(F.slice("list", (r["start"] + 1).cast("int"), (r["end"] - r["start"]).cast("int")), "")
        return rows.select("sample_id", F.transform("__r", lambda r: F.struct(r["path"].alias("path"), cut_out(r).alias("text"))).alias("parts"))

    def select_by_sequence_id(self, seq_id: str) -> DataFrame:
        return self.tokens.where(F.col("id").isNull() & (F.col("token") == seq_id))

    def get_sample(self, sample_id: object) -> TraceSet:
        """The first sample of that id (as text) alone; KeyError if there is none."""
        first = self.samples.where(F.col("sample_id") == str(sample_id)).orderBy("sample_ord").limit(1)
        if first.isEmpty():
            raise KeyError(str(sample_id))
        return self._only(first)

    def filter_samples(self, predicate: Column) -> DataFrame:
        return self.samples.where(predicate)

    def filter_samples_by_score(self, scorer: str, predicate: Column) -> DataFrame:
        """Samples with a score of that scorer for which the predicate (on value, JSON text) holds; each once."""
        return self.samples.join(self.scores.where((F.col("scorer") == scorer) & F.coalesce(predicate, F.lit(False))), "sample_id", "left_semi")

    def subset(self, predicate: Column) -> TraceSet:
        """The samples that satisfy the predicate and the sequences they refer to."""
        return self._only(self.samples.where(predicate))

    def _only(self, samples: DataFrame) -> TraceSet:
        within = lambda df: df.join(samples.select("sample_id"), "sample_id", "left_semi")
        out = replace(self, samples=samples, **{n: within(getattr(self, n)) for n in ("tokens", "annotations", "spans", "texts", "scores")})
        if self.listed:
            out = replace(out, lists=(out.tokens, replace(self.listed, rows=within(self.listed.rows)), out.texts if self.lists[2] is self.texts else self.lists[2]))
        return out.prune_sequences()

    def prune_sequences(self) -> TraceSet:
        """Only the sequences that some token refers to."""
        used = self.tokens.where("id IS NULL").select(F.col("token").alias("seq_id"))
        return replace(self, sequences=self.sequences.join(used, "seq_id", "left_semi").select(*self.sequences.columns), sequence_tokens=self.sequence_tokens.join(used, "seq_id", "left_semi"))

    # -- extras ----------------------------------------------------------------------------

    def get_extra(self, key: str, default: object = None) -> DataFrame:
        """(sample_id, pos, value): the JSON text of an extra, the default where it is absent."""
        bag = F.from_json("extras", "map<string,string>")
        return self.tokens.select("sample_id", "pos", F.coalesce(F.try_element_at(bag, F.lit(key)), F.lit(default).cast("string")).alias("value"))

    def has_extra(self, key: str) -> DataFrame:
        """(sample_id, pos) of the tokens that have the key, even with a null value."""
        return self.tokens.where(F.array_contains(F.coalesce(F.json_object_keys("extras"), F.array().cast("array<string>")), key)).select("sample_id", "pos")

    def set_extra(self, values: DataFrame, key: str) -> TraceSet:
        """Set ``key`` from (sample_id, pos, value), value being JSON text; other extras stay."""
        if self.listed:
            return self._set_listed(values, key)
        bag = F.from_json(F.coalesce("extras", F.lit("{}")), "map<string,string>")
        # Never broadcast: token tables compress to little of what a driver would hold.
        t = self.tokens.join(values.select("sample_id", "pos", F.col("value").alias("__v")).hint("merge"), ["sample_id", "pos"], "left")
        rest = F.expr("regexp_replace(extras, '[}]\\\\s*$', '')")
        without = F.when(F.coalesce("extras", F.lit("{}")).rlike(r"^\s*\{\s*\}\s*$") | F.col("extras").isNull(), F.lit("{")).otherwise(F.concat(rest, F.lit(",")))
        joined = F.concat(without, F.to_json(F.array(F.lit(key))).substr(F.lit(2), F.length(F.to_json(F.array(F.lit(key)))) - 2), F.lit(":"), F.col("__v"), F.lit("}"))
        replaced = F.when(F.map_contains_key(bag, key), self._replace_key(key)).otherwise(joined)
        return replace(self, tokens=t.withColumn("extras", F.when(F.col("__v").isNotNull(), replaced).otherwise(F.col("extras"))).select(*self.tokens.columns))

    def _set_listed(self, values: DataFrame, key: str) -> TraceSet:
        """The same where no token has extras yet: the values of a sample meet its list, not each token."""
        g = values.groupBy("sample_id").agg(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("pos", "value"))).alias("__v"))
        t = L.aligned(self.listed, g).withColumnRenamed("value", "__v")
        return replace(self, tokens=t.withColumn("extras", F.concat(F.lit("{" + json.dumps(key, ensure_ascii=False) + ":"), F.col("__v"), F.lit("}"))).select(*self.tokens.columns))

    @staticmethod
    def _replace_key(key: str) -> Column:
        @F.pandas_udf("string")
        def put(extras: pd.Series, value: pd.Series) -> pd.Series:
            return pd.Series([None if e is None or v is None else json.dumps({**json.loads(e), key: json.loads(v)}, separators=(",", ":"), ensure_ascii=False) for e, v in zip(extras, value)], dtype=object)

        return put("extras", "__v")

    def attach_logprobs(self, values: DataFrame, name: str = "generated") -> TraceSet:
        """Give the tokens of an annotation their logprobs (sample_id, k, logprob), only where the counts match; null entries pass."""
        a = self.annotations.where(F.col("name") == name).groupBy("sample_id").agg(F.min("start").alias("start"), F.max("end").alias("end"))
        n = values.groupBy("sample_id").agg(F.count("*").alias("n"))
        good = a.join(n, "sample_id").where("end - start = n")
        return self.set_extra(values.where("logprob IS NOT NULL").join(good, "sample_id").select("sample_id", (F.col("start") + F.col("k")).alias("pos"), F.col("logprob").cast("string").alias("value")), "logprob")

    def cut(self) -> TraceSet:
        """The same bundle with its tokens, annotations, texts and spans checkpointed, for steps that read them often."""
        keep = {n: cut(getattr(self, n)) for n in ("samples", "tokens", "annotations", "texts", "spans")}
        return replace(self, **keep)

    # -- larger operators ------------------------------------------------------------------

    def deduplicate_sequences(self, min_length: int = 5) -> TraceSet:
        from .sequences import deduplicate

        return deduplicate(self, min_length)

    def transform(self, f: Callable[[TraceSet], TraceSet]) -> TraceSet:
        return f(self)
