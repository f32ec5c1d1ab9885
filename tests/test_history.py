import random

from palimpsest.operators.history import Snapshot, attribute_history, differing_leaves, snapshot_changes, tree_depth

FACTS = "id string, subject_norm string, relation_norm string, object string, modality string, status string, valid_from double, created_at double, block string, _leaf string"
RELATIONS = [("drives", 1), ("likes", 0)]


def brute(facts):
    seen, by = {}, {}
    for f in facts:
        seen.setdefault(f[0], f)
    for id_, s, r, o, m, st, vf, c, *_ in seen.values():
        if s is None or r != "drives" or vf is None or (m or "stated") == "planned" or (st or "active") in ("retracted", "cancelled", "unconfirmed"):
            continue
        value = (o or "").strip().lower().strip(" .")
        at = by.setdefault((s, r), {})
        if vf not in at or ((c if c is not None else float("-inf")), id_) > at[vf][0]:
            at[vf] = ((c if c is not None else float("-inf"), id_), value, m == "negated")
    out = []
    for (s, r), at in by.items():
        now = None
        for vf in sorted(at):
            _, value, negated = at[vf]
            if now and ((negated and value == now[0]) or (not negated and value != now[0])):
                out.append((s, r, now[0], now[1], vf))
                now = None
            if not negated and now is None:
                now = (value, vf)
        if now:
            out.append((s, r, now[0], now[1], None))
    return sorted(out, key=str)


def test_history_against_brute_force(spark, rows):
    rng = random.Random(3)
    facts = []
    for i in range(400):
        s = rng.choice(["user", "user", "user", "b", "c", None])  # one attribute holds half of the rows
        facts.append((
            f"f{i}", s, rng.choice(["drives", "drives", "likes", None]), rng.choice(["Van", "van.", "Bus", "Tram ", None]), rng.choice(["stated", "stated", "negated", "planned", None]),
            rng.choice(["active", "superseded", "retracted", None]), rng.choice([None, *map(float, range(0, 3000000, 30011))]), rng.choice([None, float(rng.randrange(10**7))]), "x", "y",
        ))
    facts += facts[:40]
    df = spark.createDataFrame(facts, FACTS)
    got = attribute_history(df, spark.createDataFrame(RELATIONS, "name string, exclusive int"))
    assert rows(got, "subject_norm", "relation_norm", "value", "valid_from", "valid_to") == brute(facts)


def test_empty_history(spark):
    assert attribute_history(spark.createDataFrame([], FACTS), spark.createDataFrame(RELATIONS, "name string, exclusive int")).count() == 0


def test_snapshot_changes(spark, rows):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), (None, 1, "n"), ("d", 2, None)], "k string, n int, v string")
    new = spark.createDataFrame([("a", 1, "x"), ("b", 1, "z"), (None, 1, "n"), ("e", 1, "w"), ("d", 2, None)], "k string, n int, v string")
    assert rows(snapshot_changes(old, new, ["k", "n"], ["v"], 4, 2)) == [("b", 1, "z", "put"), ("e", 1, "w", "put")]
    assert rows(snapshot_changes(new, old, ["k", "n"], ["v"], 4, 2)) == [("b", 1, "y", "put"), ("e", 1, None, "drop")]
    assert snapshot_changes(old, old, ["k", "n"], ["v"]).count() == 0


def test_only_differing_leaves(spark):
    assert [tree_depth(n) for n in (0, 64, 65, 1024, 1025, 10**6, 10**12)] == [1, 1, 1, 1, 2, 4, 9]
    old = spark.range(5000).selectExpr("cast(id as string) as k", "id % 7 as v")
    new = old.selectExpr("k", "case when k in ('17', '4000') then 99 else v end as v")
    a, b = (Snapshot.of(x, ["k"], ["v"], 3, 8) for x in (old, new))
    assert differing_leaves(a, b, 3, 8).count() == 2 and differing_leaves(a, a, 3, 8).count() == 0
    assert {(r.k, r.v) for r in snapshot_changes(a, b, ["k"], ["v"], 8, 3).collect()} == {("17", 99), ("4000", 99)}
    empty = Snapshot.of(old.where("false"), ["k"], ["v"], 3, 8)
    assert snapshot_changes(empty, b, ["k"], ["v"], 8, 3).count() == 5000 and snapshot_changes(b, empty, ["k"], ["v"], 8, 3).where("op = 'drop'").count() == 5000
