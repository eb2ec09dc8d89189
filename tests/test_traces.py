import json
import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tracewright.functions import decode, jsontext, ranges
from tracewright.functions import ranges as R
from tracewright.functions.regex import to_java
from tracewright.functions.tokens import char_tokens
from tracewright.operators import chat, fields, sequences, summary, textmatch
from tracewright.operators.flat import FlatStore
from tracewright.operators.traces import TraceSet
from tracewright.sources import documents


def doc(samples, seqs=()):
    return {"metadata": {"model": {"name": "m"}}, "sequences": [{"id": n, "n_tokens": len(t), "tokens": [{"token": a, "id": b} for a, b in t]} for n, t in seqs], "samples": samples}


def toks(*pairs):
    return [{"token": t} if i is None else {"token": t, "id": i} for t, i in pairs]


def ann(ts, name=None):
    rows = ts.annotations.orderBy("sample_id", "name", "start").collect()
    return [(r.name, r.start, r.end) for r in rows if name in (None, r.name)]


SEQ0 = [("<|endoftext|>", 50256), ("This", 1212), (" is", 318)]


@pytest.fixture
def core(spark):
    s = {"id": "s", "tokens": toks(("seq_0", None), (" a", 257), (" test", 1332)) + [{"token": ".", "id": 764, "logprob": -0.5}] + toks(("seq_1", None)), "annotations": [{"name": "content", "ranges": [[2, 3]]}], "spans": [{"name": "answer", "positions": [2, 3]}]}
    return documents.from_dict(spark, doc([s], [("seq_0", SEQ0), ("seq_1", SEQ0[:1])]))


def test_expansion_offsets_and_flat_store(core):
    e = core.expanded_tokens().orderBy("pos").collect()
    assert [r.token for r in e] == ["<|endoftext|>", "This", " is", " a", " test", ".", "<|endoftext|>"]
    assert [r.seq_id for r in e] == ["seq_0"] * 3 + [None] * 3 + ["seq_1"] and e[5].extras is not None
    x = core.expand_sequences()
    assert ann(x) == [("content", 4, 5)] and sorted(r.position for r in x.spans.collect()) == [4, 5]
    store = FlatStore.from_traces(core).annotate_regexes([("test", "testy"), ("end", "bos")]).annotate_regexes([("test", "testy")])
    assert {r.name: r.n for r in store.annotation_counts(["none"]).collect()} == {"content": 1, "testy": 1, "bos": 2, "none": 0}


def test_materialize_position(core):
    ts, i = core.materialize_position("s", 1)
    assert i == 1 and ann(ts) == [("content", 4, 5)] and ts.tokens.count() == 7 and ts.tokens.where("id IS NULL").count() == 1
    assert core.materialize_position("s", 3)[1] == 1
    for bad in (999, -1):
        with pytest.raises(IndexError):
            core.materialize_position("s", bad)


def test_regex_tag_expands_only_matching_references(core):
    ts = core.tag_by_regexes([("is", "is"), (" test", "t")])
    assert ann(ts, "is") == [("is", 1, 3)] and ts.tokens.where("id IS NULL").count() == 1
    assert core.tag_by_regex("zzz", "z").annotations.where("name = 'z'").count() == 0


def test_predicate_sees_references(core):
    got = core.tag_by_predicates([(F.col("id").isNull(), "ref")], sequences=False)
    assert ann(got, "ref") == [("ref", 0, 1), ("ref", 4, 5)]


def test_annotate_merges_and_keeps_first_metadata(core, spark):
    add = lambda ts, s, e, m: ts.annotate(spark.createDataFrame([("s", "k", s, e)], "sample_id string, name string, start long, end long"), m)
    ts = add(add(add(add(core, 5, 7, "a"), 6, 10, "b"), 10, 12, "c"), 0, 2, "d")
    assert ann(ts, "k") == [("k", 0, 2), ("k", 5, 12)] and {r.metadata for r in ts.annotations.where("name = 'k'").collect()} == {"a"}
    assert ts.remove_annotation("k").annotations.count() == 1


def test_selection(core):
    assert [r.token for r in core.select_by_positions([3, 1, 1, -1, 99]).orderBy("pos").collect()] == [" a", "."]
    assert [r.token for r in core.select_by_annotation("content").collect()] == [" test"]
    assert core.select_by_span("answer").count() == 2 and core.select_by_sequence_id("seq_0").count() == 1
    for args in [(1, 4), (None, None, 2), (-3, -1), (None, None, -1), (4, 0, -2), (10, 2), (-100, 2)]:
        assert sorted(r.pos for r in core.select_by_slice(*args).collect()) == sorted(range(5)[slice(*args)]), args
    with pytest.raises(KeyError):
        core.get_sample("nope")


def test_text_regex_modes(spark):
    ts = documents.from_dict(spark, doc([{"id": "s", "tokens": toks((" E", 1), ("iff", 2), ("el", 3), (" Tower", 4))}]))
    want = {"all": [0, 1, 2], "first": [0], "last": [2]}
    for mode, pos in want.items():
        assert sorted(r.pos for r in textmatch.overlapping(ts.tokens, "(?i)eiffel", mode).collect()) == pos


def test_chat_roles(spark):
    m = spark.createDataFrame([(0, "s", 0, "user", "Hi")], "sample_ord long, sample_id string, turn long, role string, content string")
    ts = chat.tag_chat_roles(chat.chat_traces(m), m)
    assert ann(ts, "user") == [("user", 9, 11)] and ann(ts, "template") == [("template", 0, 9), ("template", 11, 16)]
    ref = [(c, ord(c)) for c in "<s>[user]H"]
    half = documents.from_dict(spark, doc([{"id": "s", "tokens": toks(("p", None), *((c, ord(c)) for c in "i[end]"))}], [("p", ref)]))
    out = chat.tag_chat_roles(half, m)
    assert out.tokens.count() == 16 and ann(out, "user") == [("user", 9, 11)]
    other = documents.from_dict(spark, doc([{"id": "s", "tokens": toks(("no", 1))}]))
    assert ann(chat.tag_chat_roles(other, m)) == []


def test_message_ranges_partition(spark):
    rows = [(0, "s", 0, "system", "S"), (0, "s", 1, "user", "q"), (0, "s", 2, "user", None), (0, "s", 3, "assistant", "a b")]
    m = spark.createDataFrame(rows, "sample_ord long, sample_id string, turn long, role string, content string")
    t = chat.chat_traces(m).texts.orderBy("path").collect()
    n = chat.chat_traces(m).tokens.count()
    assert [x.name for x in t] == ["system_0", "user_0", "user_1", "assistant_0"]
    assert t[0].start == 0 and t[-1].end == n and all(a.end == b.start for a, b in zip(t, t[1:]))


def words(spark, *texts):
    ids = {}
    return documents.from_dict(spark, doc([{"id": f"s{k}", "tokens": toks(*((w, ids.setdefault(w, len(ids) + 1)) for w in t.split()))} for k, t in enumerate(texts)]))


def seqs(ts):
    out = {}
    for r in ts.sequence_tokens.orderBy("seq_id", "seq_pos").collect():
        out.setdefault(r.seq_id, []).append(r.token)
    return out


def test_dedup_golden(spark):
    ts = words(spark, "E T i w0", "E T i w1", "E T i w2")
    d = ts.deduplicate_sequences(3)
    assert seqs(d) == {"seq_0": ["E", "T", "i"]} and d.tokens.count() == 6
    assert seqs(ts.deduplicate_sequences()) == {}
    assert seqs(words(spark, "a b x a b c", "a b c").deduplicate_sequences(2)) == {"seq_0": ["a", "b", "c"]} or seqs(words(spark, "a b x a b c", "a b c").deduplicate_sequences(2))["seq_0"] == ["a", "b", "c"]
    alone = words(spark, "a b c d e f").deduplicate_sequences()
    assert seqs(alone) == {"seq_0": list("abcdef")} and alone.tokens.count() == 1


def test_dedup_respects_ids_extras_and_annotations(spark):
    mismatch = documents.from_dict(spark, doc([{"id": 0, "tokens": toks(("a", 1), ("b", 20), ("x", 3))}, {"id": 1, "tokens": toks(("a", 1), ("b", 21), ("y", 4))}])).deduplicate_sequences(2)
    assert {r.sample_id: r["count"] for r in mismatch.tokens.groupBy("sample_id").count().collect()} == {"0": 2, "1": 3}
    marked = {"id": 0, "tokens": toks(("a", 1), ("b", 2), ("c", 3), ("d", 4)), "annotations": [{"name": "k", "ranges": [[1, 2]]}], "spans": [{"name": "p", "positions": [3]}]}
    plain = {"id": 1, "tokens": toks(("a", 1), ("b", 2), ("c", 3), ("d", 4))}
    d = documents.from_dict(spark, doc([marked, plain])).deduplicate_sequences(2)
    back = d.expand_sequences()
    assert ann(back, "k") == [("k", 1, 2)] and [r.token for r in back.tokens.where("sample_id = '0'").orderBy("pos").collect()] == list("abcd")


def test_shared_runs_match_brute_force(spark):
    import random

    r = random.Random(7)
    for _ in range(4):
        texts = ["".join(r.choice("ab") for _ in range(r.randint(3, 12))) for _ in range(3)]
        n = r.choice([2, 3])
        want = {}
        for i in range(len(texts[0]) - n + 1):
            reach = [max((k for k in range(n, len(texts[0]) - i + 1) if texts[0][i : i + k] in t), default=0) for t in texts[1:]]
            if min(reach) >= n:
                want[i] = min(reach)
        df = spark.createDataFrame([(f"s{k}", p, c) for k, t in enumerate(texts) for p, c in enumerate(t)], "sample_id string, pos long, token string")
        assert {x.pos: x.len for x in sequences.shared_run_lengths(df, "s0", 3, n).collect()} == want


def test_fields_and_diffs():
    assert fields.difference("abXYcd", "abcd") == (2, 4) and fields.difference("ab", "ab") is None
    assert fields.differences("aXXb" * 3, "ab" * 3, 2) == [(1, 3), (5, 7), (9, 11)]
    ms = [{"role": "assistant", "content": "c", "reasoning": "think1"}, {"role": "user", "content": "u"}, {"role": "assistant", "content": "c", "reasoning": "think2"}]
    full = fields.plain_template(ms)
    assert ["think" in full[a:b] for _, a, b in fields.field_chunks(ms, fields.plain_template, "reasoning")] == [True, True]


def test_field_tags(spark):
    rows = [(0, "s", 0, "user", "q", None, None), (0, "s", 1, "assistant", "a", "hmm", '[{"name":"f","arguments":{"x":1}}]')]
    m = spark.createDataFrame(rows, "sample_ord long, sample_id string, turn long, role string, content string, reasoning string, tool_calls string")
    text, _ = fields.render_fields(m)
    ts = TraceSet.from_texts(text.withColumn("sample_ord", F.lit(0)), char_tokens(F.col("text")), True)
    ts = fields.tag_fields(chat.tag_chat_roles(ts, m, text), m)
    full = text.first().text
    got = {n: full[s:e] for n, s, e in ann(ts)}
    assert got["reasoning"] == "<think>hmm</think>" and got["tool_call"].startswith("<call>f(")
    assert "hmm" in got["assistant"] or any(s <= full.index("hmm") < e for n, s, e in ann(ts, "assistant"))


def test_extras_and_logprobs(core, spark):
    put = core.set_extra(spark.createDataFrame([("s", 1, "1.5"), ("s", 3, '"x"')], "sample_id string, pos long, value string"), "logprob")
    assert {r.pos: r.value for r in put.get_extra("logprob", "d").collect()} == {0: "d", 1: "1.5", 2: "d", 3: "x", 4: "d"}
    assert sorted(r.pos for r in put.has_extra("logprob").collect()) == [1, 3]


def test_scores(spark):
    ts = documents.from_dict(spark, doc([{"id": k, "tokens": [], "scores": s} for k, s in enumerate([[{"scorer": "a", "value": 0.5}, {"scorer": "b", "value": "C"}], [{"scorer": "a", "value": 0}], [{"scorer": "a", "value": True}], [{"scorer": "a", "value": "I", "metadata": {"is_correct": True}}], []])]))
    assert {r.sample_id: r.verdict for r in summary.sample_verdicts(ts).collect()} == {"0": True, "1": False, "2": True, "3": True, "4": None}
    assert [r.sample_id for r in ts.filter_samples_by_score("a", F.col("value") == "0").collect()] == ["1"]


def test_ranges(spark):
    df = spark.createDataFrame([("a", p) for p in (5, 1, 2, 2, 9)] + [("b", 0)], "k string, pos long")
    assert sorted((r.k, r.start, r.end) for r in ranges.positions_to_ranges(df, ["k"]).collect()) == [("a", 1, 3), ("a", 5, 6), ("a", 9, 10), ("b", 0, 1)]
    r = spark.createDataFrame([("a", 3, 3), ("a", 0, 2), ("a", 2, 4), ("a", 6, 5), ("a", 8, 9)], "k string, start long, end long")
    assert sorted((x.start, x.end) for x in ranges.merge_ranges(r, ["k"]).collect()) == [(0, 4), (8, 9)]


def test_plain_helpers():
    assert decode.by_offsets("héllo x", [(0, 2), (1, 5), (5, 7)]) == ["hé", "llo", " x"] and decode.by_offsets("ab", [(0, 1)]) is None
    assert decode.by_bytes(["é".encode()[:1], "é".encode()[1:] + b"a", b"\xff"]) == ["", "éa", "�"]
    assert decode.by_ids([1, 2], lambda x: "".join("ab"[i - 1] for i in x)) == ["a", "b"]
    assert to_java(r"(?P<n>a)(?P=n)\Z") == r"(?Ud)(?<n>a)\k<n>\z" and to_java(r"(a)?(?(1)b|c)") is None
    assert jsontext.pretty({"tokens": [{"token": "a", "id": 1}]}).count("\n") == 4
    assert jsontext.compact({"a": None, "b": [], "c": {"token": "", "id": 0}, "value": ""}) == {"c": {"token": "", "id": 0}, "value": ""}


def test_missing_sequences_are_reported(spark):
    from tracewright.operators.validate import violations

    ts = documents.from_dict(spark, doc([{"id": 0, "tokens": toks(("gone", None))}]))
    assert [r.rule for r in violations(ts).collect()] == ["missing_sequence"]


def test_tagging_lists_as_rows(spark):
    """Fresh texts are tagged inside their rows; other bundles over exploded tokens. Both agree."""
    rnd = random.Random(4)
    rows = [(i, str(i), "" if i == 3 else None if i == 4 else " ".join(rnd.choice(["a", "12", "B", "Cd.", "7"]) for _ in range(rnd.randint(1, 30)))) for i in range(40)]
    ts = TraceSet.from_texts(spark.createDataFrame(rows, "sample_ord long, sample_id string, text string"))
    tags = [("[0-9]", "n"), ("^ ?[A-Z]", "up"), ("7", "seven"), ("[.]$", "up"), ("never", "never")]
    assert ts.lists is not None
    got, want = (sorted(map(tuple, x.tag_by_regexes(tags).annotations.collect())) for x in (ts, replace(ts, lists=None)))
    assert got == want and got


def test_running_sum(spark):
    rows = [(k, k % 5) for k in range(200)]
    got = R.running_sum(spark.createDataFrame(rows, "k long, v long").repartition(7), ["k"], F.col("v"), "total").collect()
    assert {r.k: r.total for r in got} == {k: sum(x for _, x in rows[: k + 1]) for k, _ in rows}


def test_stripped_content(spark):
    m = spark.createDataFrame([("a", 0, "user", "\n hi\x1c\n")], "sample_id string, turn long, role string, content string")
    found = textmatch.message_spans(m, spark.createDataFrame([("a", "[user]hi")], "sample_id string, text string")).collect()
    assert [(x.role, x.s_start, x.s_end) for x in found] == [("user", 6, 8)]


def test_pretty_is_json():
    doc = {"tokens": [{"token": "a\0", "id": 1}, {"token": 'b"', "extras": {"x": [{"token": "c"}]}}], "e": [], "o": {}, "u": "é\0003"}
    text = jsontext.pretty(doc)
    assert json.loads(text) == doc and '\n        {"token": "a\\u0000", "id": 1},\n' in text and '{"token": "c"}\n' in text and "é" in text
