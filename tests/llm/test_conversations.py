import hashlib
import random

from palimpsest.llm.conversations import conversation_turns, turns

WINDOWS = "id string, ref string, session_id string, speaker string, said double, text string, flags string, stream string, block string, node string"
SPEAKERS = [("Tessel", "assistant"), ("tessel (Voice)", "assistant"), ("Rowan", "user"), ("action", "tool")]


def wid(ref, i):
    return hashlib.sha1(f"{ref}\x1f{i}\x1f".encode()).hexdigest()[:16]


def brute(windows):
    labels = {s.strip().lower() for s, r in SPEAKERS if r == "assistant"}
    ids, messages = {}, {}
    for w in windows:
        if w[7] == "conversation" and w[2] is not None:
            ids.setdefault(w[0], w)
    for w in ids.values():
        messages.setdefault((w[2], w[1]), []).append(w)
    sessions = {}
    for (session, ref), rows in messages.items():
        said = [r[4] / 1000 if r[4] > 1e11 else r[4] for r in rows if r[4] is not None]
        asst = any("assistant" in (r[6] or "").split() or (r[3] or "").strip().lower() in labels for r in rows)
        blank = all(not (r[5] or "").strip(" \n​ ") for r in rows)
        whole = {r[0] for r in rows} == {wid(ref, i) for i in range(len(rows))}
        sessions.setdefault(session, []).append((min(said) if said else None, ref, asst, blank, whole))
    out = []
    for session, ms in sessions.items():
        if any(m[0] is None or not m[4] or (m[2] and m[3]) for m in ms):
            continue
        kept = sorted(m for m in ms if not m[3])
        if kept and not kept[0][2] and kept[-1][2]:
            out += [(session, n, "assistant" if m[2] else "user", m[1]) for n, m in enumerate(kept, 1)]
    return sorted(out, key=str)


def test_turns_against_brute_force(spark, rows):
    rng = random.Random(5)
    windows = []
    for s in range(40):
        n = 120 if s == 0 else rng.randrange(1, 7)
        for m in range(n):
            ref = f"r{s}-{m}"
            asst = m % 2 == 1
            said = 1.7e9 + s * 1e6 + m * (9e5 if s == 0 else 60)
            size = rng.choice([1, 1, 2, 3])
            gap = s % 9 == 4 and m == 1
            for i in range(size):
                text = rng.choice([None, " ​"]) if rng.random() < 0.03 and s else f"part {i}"
                speaker = rng.choice(["Tessel ", "TESSEL (voice)", "x"]) if asst else rng.choice(["Rowan", None])
                time = None if s % 11 == 7 and m == 0 else said * (1000 if rng.random() < 0.2 and s else 1)
                row = (wid(ref, i + gap), ref, f"s{s}", speaker, time, text, "assistant echo" if asst else rng.choice(["", None]), "conversation", "b", "n")
                windows += [row] * rng.choice([1, 1, 2])
    windows.append((wid("t", 0), "t", "s1", "x", 1.7e9, "thought", "", "thought", "b", "n"))
    windows.append((wid("q", 0), None, "s2", "x", 1.7e9, "no ref", "", "conversation", "b", "n"))
    by_ref = {}
    for w in windows:  # the rows of one message agree in time
        by_ref.setdefault(w[1], w[4])
    windows = [w[:4] + (by_ref[w[1]],) + w[5:] for w in windows]
    df = spark.createDataFrame(windows, WINDOWS)
    speakers = spark.createDataFrame(SPEAKERS, "label string, role string")
    want = brute(windows)
    assert len(want) > 150 and rows(turns(df, speakers), "session_id", "turn_no", "role", "ref") == want
    text = {r.ref: r.text for r in conversation_turns(df, speakers).collect()}
    assert set(text) == {x[3] for x in want} and any(t == "part 0 part 1 part 2" for t in text.values())


def test_empty(spark):
    empty = turns(spark.createDataFrame([], WINDOWS), spark.createDataFrame(SPEAKERS, "label string, role string"))
    assert empty.count() == 0


def test_pointers_decide(spark, rows, monkeypatch):
    """Orphans and cycles that the chains report drop their session; without the chains there are no turns."""
    from pyspark.sql import functions as F

    from palimpsest.llm import conversations

    windows = [(wid(f"r{s}{m}", 0), f"r{s}{m}", f"s{s}", "Rowan" if m % 2 == 0 else "Tessel", 1.7e9 + m * (40 * 86400 if s == 1 else 60), "x", "", "conversation", "b", "n") for s in range(3) for m in range(4)]
    df, speakers = spark.createDataFrame(windows, WINDOWS), spark.createDataFrame(SPEAKERS, "label string, role string")
    linked = conversations.linked_messages(conversations.messages(df, speakers))
    assert linked.where("parent is null").count() == 3 and linked.count() == 12
    assert turns(df, speakers).count() == 12
    real = conversations.resolve_chains
    bad = linked.where("ref = 'r12'").select("node").first()[0]
    for status in ("orphan", "cycle"):
        monkeypatch.setattr(conversations, "resolve_chains", lambda n, s=status: real(n).withColumn("status", F.when(F.col("node") == bad, s).otherwise(F.col("status"))))
        assert {r[0] for r in rows(turns(df, speakers), "session_id")} == {"s0", "s2"}
