import json

from tracewright import cli
from tracewright.sources import documents, records
from tracewright.viewer import render_html, shown, token_names

RECORD = {
    "evaluation_id": "e", "evaluation_result_id": "r2", "model_id": "m/x", "evaluation_name": "gsm", "sample_id": 7, "interaction_type": "single_turn",
    "input": {"raw": "Q?", "reference": ["4"]}, "output": {"raw": ["It is 4"], "reasoning_trace": ["2+", "2"]},
    "answer_attribution": [{"extracted_value": "5", "is_terminal": False}, {"extracted_value": "4", "is_terminal": True}], "evaluation": {"score": 1.0, "is_correct": True, "num_turns": 1}, "token_usage": {"input_tokens": 3, "output_tokens": 4},
}
TURNS = {**RECORD, "sample_id": "t", "interaction_type": "multi_turn", "input": {"raw": "", "reference": ["a", "b"]}, "evaluation": None, "messages": [{"turn_idx": 1, "role": "assistant", "content": "ok", "tool_calls": [{"name": "f", "arguments": {"é": 1}}]}, {"turn_idx": 0, "role": "user", "content": "hi"}]}
LOG = {"id": 3, "messages": [{"role": "user", "content": [{"type": "text", "text": "q"}]}, {"role": "assistant", "content": [{"type": "reasoning", "reasoning": "r"}, {"type": "text", "text": "yes"}], "tool_calls": [{"id": "c", "function": "g", "arguments": {}}]}], "scores": {"acc": {"value": "C"}}, "target": "yes", "usage": {"input_tokens": 1}, "output": {"choices": [{"logprobs": {"content": [{"logprob": -0.1}, {"logprob": None}, {"logprob": -0.3}]}}]}}


def test_projection():
    assert [m["content"] for m in records.record_messages(RECORD)] == ["Q?", "It is 4"] and records.record_messages(RECORD)[1]["reasoning"] == "2+2"
    turns = records.record_messages(TURNS)
    assert turns[0]["content"] == "hi" and turns[1]["content"] == 'ok\n<tool_call name=f args={"\\u00e9": 1}/>'
    assert records.record_score(RECORD)["answer"] == "4" and records.record_score(TURNS) is None
    assert records.record_sample(RECORD)["target"] == "4" and records.record_sample(TURNS)["target"] is None
    log = records.log_sample(LOG)
    assert log["messages"][1]["reasoning"] == "r" and log["messages"][1]["tool_calls"][0]["name"] == "g" and log["logprobs"] == [-0.1, None, -0.3]
    assert records.aggregate_result(RECORD, {"evaluation_results": [{"evaluation_result_id": "r1"}, {"evaluation_result_id": "r2", "x": 1}]})["x"] == 1
    assert records.model_name([RECORD]) == "m/x" and records.strip_provider("OpenAI/a/b") == "a/b" and records.strip_provider("openai/a") == "openai/a" and records.same_model("hf/A/b", "a/B")
    meta = records.log_metadata({"eval": {"model": "together/a/b"}, "plan": {"config": {"t": 1}}, "stats": {"started_at": "2025-01-01T00:00:00", "completed_at": "2025-01-01T00:00:01.5"}})
    assert meta["total_time"] == 1.5 and meta["model"]["name"] == "a/b" and meta["model"]["generation_config"]["t"] == 1


def test_files_to_traces(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps(RECORD) + "\n\n" + json.dumps(TURNS) + "\n")
    (tmp_path / "b.json").write_text(json.dumps({"instances": [RECORD, TURNS]}))
    (tmp_path / "c.json").write_text(json.dumps([RECORD]))
    (tmp_path / "d.json").write_text(json.dumps(RECORD))
    assert [records.read_records(spark, f"{tmp_path}/{n}").count() for n in ("a.jsonl", "b.json", "c.json", "d.json")] == [2, 2, 1, 1]
    ts = records.records_to_traces(records.read_records(spark, f"{tmp_path}/a.jsonl"))
    names = {(r.sample_id, r.name) for r in ts.annotations.collect()}
    assert {("7", "user"), ("7", "assistant"), ("7", "generated"), ("t", "template")} <= names
    assert ts.scores.count() == 1 and ts.samples.count() == 2


def test_logprobs_from_a_log(spark):
    df = spark.createDataFrame([(0, json.dumps(LOG))], "ord long, json string")
    ts = records.records_to_traces(df, dedup=False)
    assert sorted(r.value for r in ts.get_extra("logprob").where("value IS NOT NULL").collect()) == ["-0.1", "-0.3"]


def test_viewer_escapes(spark):
    ts = documents.from_dict(spark, {"metadata": {"model": {"name": "<m>"}}, "samples": [{"id": "<s>", "tokens": [{"token": "<script>", "id": 1}], "texts": [{"name": "t", "value": "<b>"}], "annotations": [{"name": "user", "ranges": [[0, 1]]}, {"name": "mine", "ranges": [[0, 1]]}], "scores": [{"scorer": "a", "value": 1}]}]})
    page = render_html(ts)
    assert "<script>" not in page and "&lt;script&gt;" in page and "✓" in page and "&lt;b&gt;" in page
    assert "&lt;b&gt;" not in render_html(ts, compact=True)
    assert shown(" a\n") == "·a↵\n" and token_names(next(documents.sample_dicts(ts)))[0] == ["mine", "user"]


def test_cli(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "b.txt").write_text("one two")
    (src / "a.txt").write_text("three")
    assert cli.main(["convert", "txt", str(src), "-o", f"{tmp_path}/o.trz", "--no-dedup"], spark) == 0
    assert [s["id"] for s in documents.iter_samples(spark, f"{tmp_path}/o.trz")] == ["a.txt", "b.txt"]
    assert cli.main(["convert", "txt", str(src), "--pattern", "*.md"], spark) == 1
    assert cli.main(["view", f"{tmp_path}/o.trz", "-o", f"{tmp_path}/o.html"], spark) == 0
    assert "three" in (tmp_path / "o.html").read_text()
