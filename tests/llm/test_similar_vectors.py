import numpy as np

from palimpsest.llm import similar_vectors as v

VECTORS = "rid bigint, kind string, item_id string, model string, vec array<float>, grp string, post int"


def data(n, dim, seed, kind="window", start=0):
    rng = np.random.default_rng(seed)
    topics = rng.normal(size=(12, dim))
    vec = topics[rng.integers(0, 12, n) // rng.integers(1, 4, n)] + 0.6 * rng.normal(size=(n, dim))
    return [(start + i, kind, f"{kind}{i}", f"emb-s{dim}", [float(x) for x in vec[i]], "g", 1) for i in range(n)]


def brute(rows, k=10):
    rids = np.array([r[0] for r in rows])
    x = np.array([r[4] for r in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    s = np.round(x @ x.T, 9)
    out = set()
    for i in range(len(rows)):
        order = [j for j in np.lexsort((rids, -s[i])) if j != i][:k]
        out |= {(int(rids[i]), int(rids[j])) for j in order}
    return out


def test_small_groups_are_exact(spark):
    rows = data(150, 16, 1) + data(7, 16, 2, "fact", 1000)
    dirty = [(2000, "window", "window3", "emb-s16", None, "g", 1), (2001, "window", "w2001", "emb-s16", [0.0] * 16, "g", 1), (2002, "window", "w2002", "emb-s16", [1.0] * 8, "g", 1), (2003, "fact", "fact0", "emb-s16", rows[150][4], "g", 1), (2003, "fact", "fact0", "emb-s16", rows[150][4], "g", 1), (None, "fact", "q", "emb-s16", None, "g", 1)]
    kept = [r for r in rows if r[0] not in (3, 1000)]
    facts = [r for r in kept if r[1] == "fact"] + [dirty[3]]
    want = brute([r for r in kept if r[1] == "window"]) | brute(facts)
    got = v.neighbours(spark.createDataFrame(rows + dirty, VECTORS))
    assert {(r.rid, r.other) for r in got.collect()} == want


def test_index_recall(spark):
    rows = data(2500, 24, 3)
    rows += [(9000 + i, "window", f"copy{i}", "emb-s24", rows[0][4], "g", 1) for i in range(30)]
    want = brute(rows)
    df = spark.createDataFrame(rows, VECTORS)
    got = {(r.rid, r.other) for r in v.neighbours(df).collect()}
    assert len(got & want) / len(want) >= 0.93 and len(got) == len(rows) * 10
    blocked = {(r.rid, r.other) for r in v.neighbours(df, block=100).collect()}  # each block keeps its own nearest, so there are more candidates
    assert len(blocked & want) / len(want) >= 0.93 and len(blocked) == len(rows) * 10


def test_footrule():
    rng = np.random.default_rng(5)
    orders = np.array([rng.permutation(40)[: v.ORDER] for _ in range(60)])
    far = v.footrule(orders[:9], orders, 40)
    for i in range(9):
        for j in range(60):
            places = {p: n for n, p in enumerate(orders[j])}
            assert far[i, j] == sum(abs(places.get(p, v.ORDER) - n) for n, p in enumerate(orders[i]))
    kept = v.nearest_by_footrule(orders[:9], orders, 40, 2)
    assert kept[range(9), range(9)].all() and (kept.sum(1) >= 30).all() and (kept.sum(1) < 60).all()


def test_the_index_decides(spark, monkeypatch):
    """A query sees less than half of its group, and nothing if footrule keeps nothing."""
    rows = data(3000, 24, 3)
    df = spark.createDataFrame(rows, VECTORS)
    seen = []
    vec = v._unit([r[4] for r in rows])
    pivots = v.fit_pivots(v.usable(df))["window|emb-s24"]
    order = v._orders(vec, pivots)
    lists = [np.flatnonzero((order[:, : v.POSTED] == p).any(1)) for p in range(len(pivots))]
    for q in range(0, 3000, 100):
        found = set()
        for p in order[q, : v.LOOKED]:
            near = v.nearest_by_footrule(order[q : q + 1], order[lists[p]], len(pivots), 10)[0]
            found |= set(lists[p][near])
        seen.append(len(found))
    assert np.mean(seen) < 0.5 * len(rows)
    monkeypatch.setattr(v, "POSTED", 0)
    assert v.neighbours(df).count() == 0


def test_empty(spark):
    assert v.neighbours(spark.createDataFrame([], VECTORS)).count() == 0
