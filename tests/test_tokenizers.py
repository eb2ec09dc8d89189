import json

import pytest

from tracewright import cli
from tracewright.functions.tokenizers import resolve, tokenize_file
from tracewright.operators import chat
from tracewright.sources import documents, records

public = pytest.importorskip("public_tokenizers")
TEXTS = ["Hello  world,\n\tit's 42!", "日本語 👩‍👩‍👧 é", "", "<|endoftext|> plain", "a b \r\n"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_strings_join_to_the_text(name):
    t = resolve(public.path(name))
    for text in TEXTS:
        ids, strings = t.encode(text)
        assert len(ids) == len(strings) and "".join(strings) == text


def test_two_libraries_agree():
    a, b = (resolve(public.path(f"byte_bpe_50k.{x}")) for x in ("json", "tiktoken"))
    assert all(a.encode(t)[0] == b.encode(t)[0] for t in TEXTS)


def test_word_and_piece_files():
    ids, strings = resolve(public.path("word_bpe_49k.json")).encode("Some words")
    assert ids and len(ids) == len(strings)
    ids, strings = resolve(public.path("piece_bpe_32k.model")).encode("Some words here")
    assert len(ids) == len(strings) and "".join(strings) == "Some words here"
    with pytest.raises(ValueError):
        resolve("words.txt")


def test_table_and_chat(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(9, None)]
    path = public.path("byte_bpe_50k.json")
    got = tokenize_file(spark.createDataFrame(rows, "k long, text string"), ["k"], path).orderBy("k", "pos").collect()
    joined = {}
    for x in got:
        joined[x.k] = joined.get(x.k, "") + x.token
    assert joined == {i: t for i, t in enumerate(TEXTS) if t}
    m = spark.createDataFrame([(0, "s", 0, "user", "What is 6*7?"), (0, "s", 1, "assistant", "It is 42.")], "sample_ord long, sample_id string, turn long, role string, content string")
    ts = chat.chat_traces(m, tokenizer=path)
    tokens = [r.token for r in ts.tokens.orderBy("pos").collect()]
    spans = [(r.name, "".join(tokens[r.start : r.end])) for r in ts.texts.orderBy("path").collect()]
    assert spans == [("user_0", "<s>[user]What is 6*7?[end]"), ("assistant_0", "[assistant]It is 42.[end]")] or "".join(x for _, x in spans) == "".join(tokens)


LOG = {
    "eval": {"model": "together/a/b", "task": "t", "eval_id": "e1"}, "plan": {"config": {"temperature": 0.5}}, "stats": {"started_at": "2025-01-01T00:00:00", "completed_at": "2025-01-01T00:00:02"},
    "samples": [{"id": k, "messages": [{"role": "user", "content": "q é"}, {"role": "assistant", "content": [{"type": "reasoning", "reasoning": "hm"}, {"type": "text", "text": "yes"}], "tool_calls": [{"id": "c", "function": "look", "arguments": {"a": 1}}]}], "scores": {"acc": {"value": "C"}}, "target": "yes"} for k in (3, 4)],
}


def test_eval_log(spark, tmp_path):
    (tmp_path / "log.json").write_text(json.dumps(LOG))
    rows, metadata = records.read_eval_log(spark, f"{tmp_path}/log.json")
    assert rows.count() == 2 and metadata["model"] == {"name": "a/b", "generation_config": {"temperature": 0.5, "preserve_reasoning": True}} and metadata["total_time"] == 2.0
    m = records.whole_content(records.project(rows, "messages")).where("role = 'assistant'").first()
    assert m.content == '<think>\nhm\n</think>\nyes\nlook: {"a":1}'
    assert cli.main(["convert", "eval", f"{tmp_path}/log.json", "-o", f"{tmp_path}/log.trz", "--tokenizer", public.path("byte_bpe_50k.json")], spark) == 0
    ts = documents.load(spark, f"{tmp_path}/log.trz")
    assert {r.sample_id for r in ts.samples.collect()} == {"3", "4"} and ts.metadata["model"]["name"] == "a/b" and ts.scores.count() == 2
    (tmp_path / "no.json").write_text('{"samples": []}')
    with pytest.raises(ValueError):
        records.read_eval_log(spark, f"{tmp_path}/no.json")
