"""Tokens inside the rows of their samples: the same results as over token rows, and no token row is shuffled or broadcast."""

import random
import re
from dataclasses import replace

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.functions import lists as L
from tracewright.functions.tokens import WORD_PATTERN
from tracewright.operators import chat, flat, sequences, textmatch
from tracewright.operators.flat import FlatStore
from tracewright.operators.traces import TraceSet
from tracewright.operators.validate import violations

ODD = ["", None, " ", "a", "\n", "a  b\t", "  héllo wörld, 12. ", "x\n\ny", "日本 語\r\n", "\U0001f600 A. #7", "a\xa0b c"]
rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
plan = lambda df: df._jdf.queryExecution().executedPlan().toString()


def words(spark, texts):
    return TraceSet.from_texts(spark.createDataFrame([(k, str(k), t) for k, t in enumerate(texts)], "sample_ord long, sample_id string, text string"))


def chars(spark, texts):
    return TraceSet.from_texts(spark.createDataFrame([(k, str(k), t) for k, t in enumerate(texts)], "sample_ord long, sample_id string, text string"), "chars")


def talk(spark):
    r = random.Random(3)
    data = [(k, str(k), t, r.choice(["user", "assistant", "system"]), r.choice([None, "", " hi ", "yes [end] é", "12 a", "a" * t])) for k in range(12) for t in range(r.randint(1, 5))]
    return spark.createDataFrame(data, "sample_ord long, sample_id string, turn long, role string, content string")


def old(ts):
    return replace(ts, lists=None)


def test_pieces_hold_all_rows(monkeypatch):
    monkeypatch.setattr(L, "PIECE", 3)
    b = pa.record_batch({"sample_id": pa.array(["0", "1", "2", "3"]), "words": pa.array(["", "a b c d", "e", "f"]), "pos": pa.array([[]] * 4, pa.list_(pa.int64()))})
    parts = [L.Batch(p) for p in L.pieces(b)]
    assert sum((p.names.to_pylist() for p in parts), []) == ["0", "1", "2", "3"] and len(parts) > 1
    assert [p.text(r) for p in parts for r in range(len(p.names))] == ["", "a b c d", "e", "f"]


def test_common_ngrams_of_lists(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("abé") for _ in range(r.randint(20, 40))) for _ in range(5)]
    got = sequences.ngram_intersection(chars(spark, texts).listed, 5, 3)
    grams = [{t[i : i + 3] for i in range(len(t) - 2)} for t in texts]
    assert {x.gram.replace(sequences.SEP, "") for x in got.collect()} == set.intersection(*grams)
    assert "Window" not in plan(got) and not sequences.ngram_intersection(chars(spark, [*texts, ""]).listed, 6, 3).count()


def test_shared_runs_of_lists(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(8, 20))) for _ in range(4)]
    ts = chars(spark, texts)
    got = sequences.shared_run_lengths(ts.tokens, "0", 4, 3, lists=ts.listed)
    want = {}
    for i in range(len(texts[0]) - 2):
        reach = [max((k for k in range(3, len(texts[0]) - i + 1) if texts[0][i : i + k] in t), default=0) for t in texts[1:]]
        if min(reach):
            want[i] = min(reach)
    assert {x.pos: x.len for x in got.collect()} == want and want and "Window" not in plan(got)


def test_logprobs_of_lists(spark):
    m = talk(spark)
    ts = chat.tag_generated(chat.chat_traces(m), m)
    n = ts.annotations.select("sample_id", F.explode(F.sequence(F.lit(0), F.col("end") - F.col("start") - 1)).alias("k"))
    values = n.where("sample_id <> '3'").select("sample_id", "k", F.when(F.col("k") > 0, F.col("k") * 0.5).alias("logprob"))
    got, want = (x.attach_logprobs(values).get_extra("logprob").where("value IS NOT NULL") for x in (ts, old(ts)))
    assert rows(got) == rows(want) and got.count()
    assert "BroadcastHashJoin" not in plan(ts.set_extra(values.selectExpr("sample_id", "k pos", "string(k) value"), "x").tokens)
    assert "BroadcastHashJoin" not in plan(old(ts).set_extra(values.selectExpr("sample_id", "k pos", "string(k) value"), "x").tokens)


def test_roles_of_lists(spark):
    m = talk(spark)
    ts = chat.chat_traces(m)
    got, want = (chat.tag_chat_roles(x, m).annotations for x in (ts, old(ts)))
    assert rows(got) == rows(want.select(*got.columns)) and got.count() > 20
    assert "BroadcastHashJoin" not in plan(got) and "Window" not in plan(got)


def test_role_counts_of_lists(spark):
    m = talk(spark)
    ts = chat.tag_chat_roles(chat.chat_traces(m), m)
    n = ts.annotations.groupBy("sample_id").agg(F.sum(F.col("end") - F.col("start")).alias("n"))
    assert rows(n) == rows(ts.lengths()) and "BroadcastHashJoin" not in plan(n)


def test_collapse_of_lists(spark):
    r = random.Random(5)
    texts = ["".join(r.choice(["[user]", "[end]", "x", "y1", "é"]) for _ in range(r.randint(4, 9))) + "[end]<s>[user]" for _ in range(5)]
    ts = chars(spark, texts)
    new, was = ts.deduplicate_sequences(4), old(ts).deduplicate_sequences(4)
    assert rows(new.sequence_tokens) == rows(was.sequence_tokens) and new.sequence_tokens.count()
    assert rows(new.tokens) == rows(was.tokens) and rows(new.texts) == rows(was.texts)
    assert rows(new.expand_sequences().tokens) == rows(ts.tokens) and rows(new.expanded_tokens()) == rows(was.expanded_tokens())
    tagged_, before = (x.tag_by_regex("^\\[$", "open") for x in (new, was))
    assert rows(tagged_.annotations) == rows(before.annotations.select(*tagged_.annotations.columns)) and rows(tagged_.tokens) == rows(before.tokens)
    assert "Window" not in plan(new.expand_sequences().tokens)


def test_subset_of_collapsed_lists(spark):
    ts = chars(spark, ["abcdeX", "Yabcde", "abcdeabcde", "Zabcde1"])
    keep = [x.deduplicate_sequences(5).subset(F.col("sample_ord") % 2 == 1) for x in (ts, old(ts))]
    assert rows(keep[0].expand_sequences().tokens) == rows(keep[1].expand_sequences().tokens) and keep[0].listed is not None
    assert "Window" not in plan(keep[0].expand_sequences().tokens)


def test_message_ranges_of_lists(spark):
    m = talk(spark)
    r = chat.render(m)
    ts = chat.chat_traces(m)
    got = chat.message_ranges(m, ts.tokens, r, lists=ts.listed)
    assert rows(got) == rows(chat.message_ranges(m, ts.tokens, r)) and "Window" not in plan(got)
    bad = {x.sample_id for x in m.where("content LIKE '%[end]%'").collect()}
    ends = dict(map(tuple, ts.lengths().collect()))
    for s in ends:
        own = sorted((x.turn, x.start, x.end) for x in got.where(F.col("sample_id") == s).collect()) if s not in bad else []
        assert all(a[2] == b[1] for a, b in zip(own, own[1:])) and (not own or own[0][1] == 0 and own[-1][2] == ends[s])
    assert bad and all(x.start is None for x in got.collect() if x.sample_id in bad)


def test_generated_range_of_lists(spark):
    m = talk(spark)
    ts = chat.chat_traces(m)
    got, want = (chat.message_token_range(x.tokens, chat.render(m), chat.last_reply(m), lists=x.listed) for x in (ts, old(ts)))
    assert rows(got) == rows(want) and got.count() and "Window" not in plan(got) and "BroadcastHashJoin" not in plan(got)


def test_tokenizer_lists(spark):
    import public_tokenizers

    from tracewright.functions.tokenizers import tokenize_file, tokenize_lists

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = spark.createDataFrame([(str(k), t) for k, t in enumerate(ODD)], "sample_id string, text string")
    lists = L.Lists(tokenize_lists(texts, ["sample_id"], path), F.col("list"), F.col("ids"))
    assert rows(lists.exploded().select("sample_id", "pos", "id", "token")) == rows(tokenize_file(texts, ["sample_id"], path))
    assert rows(lists.joined()) == sorted((str(k), t) for k, t in enumerate(ODD) if t) and "Exchange" not in plan(lists.joined())
    m = talk(spark).where("content IS NULL OR NOT content LIKE '%[end]%'")
    parts = chat.chat_traces(m, tokenizer=path).text_parts().selectExpr("sample_id", "array_join(parts.text, '')")
    assert rows(parts) == rows(chat.render(m))


def test_cuts_and_patterns_of_lists(spark):
    ts = words(spark, ODD)
    got = {(x.sample_id, x.pos): x.token for x in ts.listed.exploded().withColumn("id", F.lit(0)).collect()}
    assert got == {(str(k), i): w for k, t in enumerate(ODD) for i, w in enumerate(re.findall(WORD_PATTERN.replace("\\\\", "\\"), t or ""))}
    assert rows(chars(spark, ODD).listed.exploded().select("sample_id", "pos", "id", "token")) == rows(chars(spark, ODD).tokens.drop("extras"))
    tags = [("^[ \t\r\n]+$", "w"), ("[.,]$", "p"), ("^ *[A-Z]", "up"), ("(?i)HÉ", "py"), ("\\d", "n"), ("never", "never")]
    a, b = (x.tag_by_regexes(tags).annotations for x in (ts, old(ts)))
    assert rows(a) == rows(b.select(*a.columns)) and "Exchange" not in plan(a)


@pytest.mark.parametrize("pattern", ["a$", "[^a]$", "a|b$", "^$", "(a)", "a*+", "[$]", "b.", "^ ?[A-Da-d][.)]?$"])
def test_patterns_read_alike(pattern):
    strings = ["", "a", "a\n", "b\n", "\n", "ba", None, "$", "A)", " c.", "é", "bé"]
    assert L.found_in(pa.array(strings, pa.string()), pattern).tolist() == [x is not None and re.search(pattern, x) is not None for x in strings]


def test_sets_and_selection_of_lists(spark):
    ts = words(spark, [f"{t or ''} 1 2, B. C. x" for t in ODD] + [""]).tag_by_regexes([("[0-9]", "n"), ("[.,]$", "p"), ("^ ?[A-Z]", "up")])
    sets = {(x.sample_id, p) for x in ts.position_sets(["p", "up"], ["n"]).collect() for p in x.positions}
    at = {n: {tuple(x) for x in ts.annotation_positions(n).collect()} for n in ("n", "p", "up")}
    assert sets == (at["p"] | at["up"]) - at["n"] and sets and "Exchange" not in plan(ts.annotation_positions("p"))
    got, want = (x.select_by_annotation("up") for x in (ts, old(ts)))
    assert rows(got) == rows(want.select(*got.columns)) and "range" not in plan(want).lower().split("join")[0] and "BroadcastNestedLoopJoin" not in plan(want)
    assert rows(ts.lengths()) == rows(old(ts).lengths()) and "Exchange" not in plan(ts.lengths())


def test_flat_positions_by_offsets(spark, monkeypatch):
    monkeypatch.setattr(flat, "BLOCK", 4)
    texts = ["a b c", "", "d", None, " ".join("xyz" * 9), "1 B 2"]
    ts = words(spark, texts).tag_by_regexes([("[0-9]", "n"), ("[a-z]", "low")])
    store = FlatStore.from_traces(ts)
    want, at = {}, 0
    for k, t in enumerate(texts):
        for i in range(len((t or "").split())):
            want[at + i] = (str(k), i)
        at += len((t or "").split())
    asked = spark.createDataFrame([(p,) for p in [-1, *range(at + 3), 2, None]], "global_pos long")
    got = store.sample_position(asked)
    assert rows(got) == sorted([(p, *x) for p, x in want.items()] + [(2, *want[2])], key=repr) and "regexp_extract_all" not in plan(got)
    back = store.to_traces().annotations.select("sample_id", "name", "start", "end")
    assert rows(back) == rows(ts.annotations.select("sample_id", "name", "start", "end"))


def test_violations_of_lists(spark):
    ts = words(spark, ODD).tag_by_regexes([("[0-9]", "n")]).create_span_from_tag("n", "s")
    far = replace(ts, annotations=ts.annotations.withColumn("end", F.lit(10**6)), spans=ts.spans.withColumn("position", F.lit(-1).cast("long")))
    assert rows(violations(far).groupBy("rule").count()) == rows(violations(old(far)).groupBy("rule").count()) and violations(far).count()
    assert not violations(ts).count() and "regexp_extract_all(coalesce(text" not in plan(violations(far).where("rule = 'token_positions'"))


def test_text_patterns_of_lists(spark):
    ts = words(spark, [f"{t or ''} one of the, of  th of thof th" for t in ODD])
    texts = {x.sample_id: x.value for x in ts.texts.collect()}
    for mode in ("all", "first", "last"):
        got, want = textmatch.overlapping(ts.tokens, "of th", mode, ts.listed), set()
        for s, t in texts.items():
            at, ends = [], 0
            for w in re.findall("[ \t\r\n]*[^ \t\r\n]+|[ \t\r\n]+", t):
                at.append((ends, ends + len(w)))
                ends += len(w)
            for m in re.finditer("of th", t):
                hit = [(s, i) for i, (a, b) in enumerate(at) if b > m.start() and a < m.end()]
                want |= set(hit if mode == "all" else hit[:1] if mode == "first" else hit[-1:])
        assert rows(got) == sorted(want, key=repr) == rows(textmatch.overlapping(ts.tokens, "of th", mode)) and "Exchange" not in plan(got)
    assert rows(ts.listed.joined()) == sorted(((s, t) for s, t in texts.items() if t), key=repr) and "Exchange" not in plan(ts.listed.joined())
