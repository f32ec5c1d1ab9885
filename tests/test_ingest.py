import json

from pyspark.sql import functions as F

from palimpsest.sources.ingest import append_windows, citations, message_windows, page_windows_of, payload_pages, windows_of, without_handoff
from palimpsest.sources.ingest import tests_passed as outcome_of
from palimpsest.sources.messages import MESSAGES, captured


def test_handoffs(spark):
    cases = {
        "hello\nthere": "hello\nthere",
        "[CONTEXT COMPACTION v2]\nsummary\n--- END OF CONTEXT SUMMARY ---\nmy question": "my question",
        "before\nThis is a handoff from a previous context window\nall of it": "before",
        "[PRIOR CONTEXT 3 turns]\nwhat I said\n[END OF PRIOR CONTEXT]\nsummary": "what I said",
        "## Resolved Questions\nmine": "## Resolved Questions\nmine",
        "## Resolved Questions\nold\n--- END OF CONTEXT SUMMARY\nnew": "new",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in [*cases, None]], "text string").select("text", without_handoff(F.col("text")).alias("out"))
    got = {r.text: r.out for r in df.collect()}
    assert got == {**cases, None: None}


def test_outcomes_and_citations(spark):
    df = spark.createDataFrame([("x\n3 passed in 1s\n",), ("1 failed, 2 passed",), ("2 errors in setup",), ("nothing",), (None,)], "t string")
    assert [r[0] and tuple(r[0]) for r in df.select(outcome_of(F.col("t"))).collect()] == [("3 passed in 1s", True), ("1 failed, 2 passed", False), ("2 errors in setup", False), None, None]
    assert spark.createDataFrame([("see [[knowledge/a/b.md]] and [[other]] [[knowledge/c]]",)], "t string").select(citations(F.col("t"))).first()[0] == ["knowledge/a/b.md", "knowledge/c"]


def test_payloads(spark, rows):
    payloads = [
        json.dumps({"results": [{"url": "u1", "content": " ", "markdown": "one"}, {"url": "u2", "error": "no"}, {"body": "two", "title": "t"}]}),
        json.dumps([{"url": "u3", "snapshot": "three"}]),
        json.dumps({"success": False, "content": "x"}),
        json.dumps({"error": "gone"}),
        json.dumps({"url": "u4", "text": ""}),
        "plain words",
        "error: refused",
        "<output>\n" + json.dumps({"url": "u5", "raw_content": "five"}) + "\n</output>",
        None,
    ]
    df = spark.createDataFrame([(p, "f") for p in payloads], "content string, back string")
    got = rows(payload_pages(df, fallback_url=F.col("back")), "url", "text", "is_error")
    want = [("u1", "one", False), ("f", "two", False), ("u3", "three", False), ("f", None, True), ("f", None, True), ("f", None, True), ("f", "plain words", False), ("f", "error: refused", True), ("u5", "five", False), ("f", "", False)]
    assert got == sorted(want, key=str)


def test_messages_to_stored_windows(spark, rows, tmp_path):
    secret = "ghp_" + "a1B2" * 10
    data = [("s", "user", f"My key is {secret}. Keep it.", None, None, None, "1735884600"), ("s", "assistant", "Sure. One. Two. Three.", None, None, None, "1735884660"), ("s", "tool", "x", None, "c", None, None), ("s", "user", None, None, None, None, None)]
    windows = message_windows(captured(spark.createDataFrame(data, MESSAGES), 1.0))
    assert rows(windows, "speaker", "text", "flags") == [("assistant", "Sure. One. Two.", "assistant"), ("assistant", "Three.", "assistant"), ("user", "My key is [REDACTED:github-token]. Keep it.", "")]
    path = str(tmp_path / "windows")
    append_windows(windows, path)
    append_windows(windows, path, spark.read.parquet(path))
    assert spark.read.parquet(path).count() == 3
    assert windows_of(spark.createDataFrame([], "ref string, text string")).count() == 0


def test_new_pages(spark, rows):
    pages = spark.createDataFrame([("https://www.A.example/x", "t", "One page."), ("https://a.example/y", "t", "One page."), ("https://b.example", None, "Other."), (None, None, " "), (None, None, None)], "url string, title string, text string")
    new, windows = page_windows_of(pages, spark.createDataFrame([], "content_hash string"), 5.0)
    assert new.count() == 2 and {r[0] for r in rows(windows, "speaker")} == {"source:a.example", "source:b.example"}
    again, none = page_windows_of(pages, new, 6.0)
    assert again.count() == 0 and none.count() == 0


def test_long_calls_differ(spark):
    call = lambda tail: [("c", (f"{'x' * 5000}{tail}", "web"))]
    data = [("s", "assistant", "", call(t), None, None, None) for t in ("a", "b")]
    rows_ = spark.createDataFrame([(s, r, c, json.dumps([{"id": i, "function": {"name": n, "arguments": a}} for i, (a, n) in k]), t, m, ts) for s, r, c, k, t, m, ts in data], MESSAGES.replace("tool_calls array<struct<id: string, function: struct<name: string, arguments: string>>>", "tool_calls string"))
    kind = spark.createDataFrame([], MESSAGES).schema["tool_calls"].dataType
    assert captured(rows_.withColumn("tool_calls", F.from_json("tool_calls", kind)), 1.0).count() == 2
