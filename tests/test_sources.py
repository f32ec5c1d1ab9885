import json
import os

import pytest

from palimpsest.sources.messages import captured, image_files, read_messages, resolved_calls, web_results
from palimpsest.sources.results import append_results, read_dialogues, remaining
from palimpsest.streaming.jobs import new_messages, replies, silences, wear


@pytest.fixture
def chat(tmp_path):
    parts = [{"type": "text", "text": "look"}, {"type": "image_url"}, {"type": "text", "text": "nice"}]
    lines = [
        {"session_id": "s", "role": "user", "content": "hello", "timestamp": "1735884600500"},
        {"session_id": "s", "role": "user", "content": "hello", "timestamp": "1735884600500"},
        {"session_id": "s", "role": "user", "content": parts, "timestamp": "2025-01-03T06:10:00Z"},
        {"session_id": "s", "role": "assistant", "content": None, "tool_calls": [{"id": "c1", "function": {"name": "web_read", "arguments": "{}"}}]},
        {"session_id": "s", "role": "tool", "content": json.dumps({"results": [{"url": "u1", "content": " "}, {"url": "u2", "text": "page", "title": "t"}]}), "tool_call_id": "c1"},
    ]
    path = tmp_path / "chat"
    path.mkdir()
    (path / "a.json").write_text("".join(json.dumps(x) + "\n" for x in lines))
    return str(path)


def test_capture(spark, rows, chat):
    messages = read_messages(spark, chat)
    got = captured(messages, 7.0)
    assert got.count() == 4
    assert ("look\n[image]\nnice", 1735884600.0) in rows(got, "text", "said") and ("hello", 1735884600.5) in rows(got, "text", "said") and ("", 7.0) in rows(got, "text", "said")
    assert captured(messages, 7.0, got).count() == 0
    assert rows(resolved_calls(messages), "tool", "args") == [("web_read", "{}")]
    assert rows(web_results(messages.where("role = 'tool'"))) == [("u1", None, None, None), ("u2", "t", "page", None)]


def test_results_resume(spark, rows, tmp_path):
    questions = spark.createDataFrame([("1", "a"), ("2", "b")], "id string, q string")
    path = str(tmp_path / "done")
    assert remaining(questions, path).count() == 2
    append_results(questions.where("id = '1'"), path)
    assert rows(remaining(questions, path), "id") == [("2",)]


def test_dialogues_and_images(spark, rows, tmp_path):
    item = {"id": "x", "sessions": [{"date": "2025-01-01 00:00:00", "turns": [{"speaker": "A", "text": "hi"}, {"role": "user", "content": "yo"}]}], "qa": [{"question": "q", "category": "c", "evidence": ["1"]}]}
    (tmp_path / "d.json").write_text(json.dumps(item))
    turns, questions = read_dialogues(spark, str(tmp_path / "d.json"))
    assert rows(turns, "speaker", "text", "said") == [("A", "hi", 1735689600.0), ("user", "yo", 1735689630.0)] and questions.count() == 1
    for name in ("a.png", "b.png"):
        (tmp_path / name).write_bytes(b"same")
    assert image_files(spark, str(tmp_path / "*.png")).count() == 1


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, tmp_path, schema, *batches):
    folder = tmp_path / "in"
    folder.mkdir()
    for n, batch in enumerate(batches):
        path = folder / f"{n}.json"
        path.write_text("".join(json.dumps(x) + "\n" for x in batch))
        os.utime(path, (1.7e9 + n * 60, 1.7e9 + n * 60))  # files are read in the order of their times
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(folder))


def test_streamed_dedup_and_wear(spark, rows, tmp_path):
    batch = [{"session_id": "s", "message_hash": h, "item": h, "ts": f"2025-01-01T00:{m:02d}:00Z"} for h, m in (("a", 1), ("a", 2), ("b", 3))]
    late = [{"session_id": "s", "message_hash": "a", "item": "a", "ts": "2025-01-01T00:30:00Z"}, {"session_id": "t", "message_hash": "z", "item": "z", "ts": "2025-01-03T00:00:00Z"}]
    stream = source(spark, tmp_path, "session_id string, message_hash string, item string, ts timestamp", batch, late)
    assert rows(run(spark, new_messages(stream), "dedup"), "message_hash") == [("a",), ("b",), ("z",)]
    assert rows(run(spark, wear(stream), "wear"), "item", "raisings") == [("a", 3), ("b", 1)]


def test_streamed_silence_and_replies(spark, rows, tmp_path):
    first = [{"id": "1", "user": "u", "ts": "2025-01-01T00:00:00Z"}, {"id": "2", "user": "v", "ts": "2025-01-01T00:00:00Z"}, {"id": "1", "user": "u", "ts": "2025-01-01T01:00:00Z"}]
    stream = source(spark, tmp_path, "id string, user string, ts timestamp", first, [{"id": "9", "user": "w", "ts": "2025-01-05T00:00:00Z"}], [{"id": "9", "user": "w", "ts": "2025-01-06T00:00:00Z"}])
    got = rows(run(spark, silences(stream), "silence"), "user", "since")
    assert ("u", 1735693200.0) in got and ("v", 1735689600.0) in got
    outreach = stream.where("user <> 'w' or id = '9'").selectExpr("id", "user", "ts as sent")
    got = rows(run(spark, replies(outreach, stream.select("user", "ts")), "replies"), "id", "user", "answered")
    assert ("2", "v", None) in got and any(x[1] == "u" and x[2] is not None for x in got)
