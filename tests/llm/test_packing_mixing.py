import numpy as np
import pytest

from palimpsest.llm import mixing, packing
from palimpsest.llm.tokens import RANKS, FOLDER, _count, encoder, token_count

DOCS = "doc_id bigint, text string, source string, units int, block int, container string"


def test_counts_match_the_whole_text():
    e = encoder(f"{FOLDER}/{RANKS}")
    text = "Some words, and then more words; " * 3000
    assert _count(e, text) == len(e.encode_ordinary(text)) and _count(e, "") == 0


def test_containers(spark, rows):
    rng = np.random.default_rng(2)
    docs = [(i, "word " * int(n), "s", 1, 1, "c") for i, n in enumerate(rng.integers(1, 90, 700))]
    docs += [(1000 + i, "word " * 50, "s", 1, 1, "c") for i in range(600)]  # one length holds half of all
    docs += [(5000, None, "s", 1, 1, "c"), (5001, "", "s", 1, 1, "c"), (5002, "word " * 1000, "s", 1, 1, "c")]
    df = spark.createDataFrame(docs, DOCS)
    sizes = spark.createDataFrame([("a", 128), ("b", 400), ("a", 128)], "pack_name string, capacity_tokens int")
    filled = packing.containers(df, sizes)
    got = filled.toPandas()
    tokens = {r.doc_id: r.n for r in df.select("doc_id", token_count("text").alias("n")).collect()}
    for name, cap in (("a", 128), ("b", 400)):
        part = got[got.pack_name == name]
        assert part.groupby("container").tokens.sum().max() <= cap
        assert dict(part.groupby("doc_id").tokens.sum()) == {k: n for k, n in tokens.items() if n}
        assert not part.duplicated(["doc_id", "piece"]).any()
        assert set(part[part.piece > 0].doc_id) == {k for k, n in tokens.items() if n > cap}
    report = {r.pack_name: r for r in packing.fill_report(filled, sizes).collect()}
    assert all(r.filled > 0.9 for r in report.values()), report
    assert report["b"].by_squares > 0.95 and report["a"].by_squares > 0.6, report  # half of a's lengths have no partners that fill it
    assert packing.containers(df.where("false"), sizes).count() == 0 and packing.containers(df, sizes.where("false")).count() == 0
    items = packing.items_of(df.select("doc_id", token_count("text").alias("tokens")), sizes)
    tiny = packing.packed(items, part_items=2).toPandas()
    assert tiny.groupby(["pack_name", "container"]).tokens.sum().groupby("pack_name").max().to_dict() == {"a": 128, "b": 400}
    assert len(tiny) == len(got) and tiny.groupby("pack_name").container.nunique().equals(got.groupby("pack_name").container.nunique())


def test_fit_uses_up_the_histogram():
    rng = np.random.default_rng(4)
    for units in (1, 7, 64, 300):
        h = np.zeros(units + 1, np.int64)
        for u in rng.integers(1, units + 1, 40):
            h[u] += rng.integers(1, 30)
        used = np.zeros_like(h)
        for pairs, n, _ in packing.fitted(h):
            assert sum(u * k for u, k in pairs) <= units and n > 0
            for u, k in pairs:
                used[u] += k * n
        assert (used == h).all()
    assert packing.fitted(np.zeros(5, np.int64)) == []


def test_repeat_counts_hold():
    h = np.zeros(65, np.int64)
    h[[5, 9, 30, 34, 60]] = [100, 50, 20, 20, 7]
    lengths, times = packing.combinations(h)
    counts = packing.repeat_counts(h, lengths, times)
    used = np.zeros_like(h)
    np.add.at(used, lengths.ravel(), (times * counts[:, None]).ravel())
    assert (used[1:] <= h[1:]).all() and ((lengths * times).sum(1) <= 64).all() and counts.sum() > 20


def test_exponents():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1}
    flat = mixing.tempered(shares, 0.0)
    assert all(abs(p - 1 / 3) < 1e-9 for p in flat.values())
    room = {"a": 100, "b": 100, "c": 10}
    by_size = mixing.weights(shares, room, size=150)
    assert by_size.exponent < 1 and by_size.tokens == pytest.approx(150) and all(by_size.shares[s] * 150 <= m + 1e-6 for s, m in room.items())
    assert mixing.weights(shares, room, size=80).exponent == pytest.approx(1) and mixing.weights(shares, room, size=80).shares == pytest.approx(shares)
    by_entropy = mixing.weights(shares, room, wanted_entropy=0.8)
    assert mixing.entropy(by_entropy.shares) == pytest.approx(0.8) and by_entropy.exponent > 1 and by_entropy.shares["a"] == pytest.approx(by_entropy.shares["b"])
    free = mixing.weights(shares, room, most_off=mixing.MOST_OFF)
    exact = mixing.weights(shares, room)
    bound = mixing.weights(shares, room, size=150, most_off=mixing.MOST_OFF)
    assert bound == free and mixing.weights(shares, room, size=80, most_off=mixing.MOST_OFF).tokens == 80
    assert mixing.off(free.shares, shares) == pytest.approx(mixing.MOST_OFF, abs=1e-6) and free.exponent < 1 and free.tokens > exact.tokens and exact.shares == pytest.approx(shares)
    assert mixing.weights({"a": 1.0}, {}).shares == {} and mixing.bisected(lambda e: e >= 0.25, 0.0, 1.0) == pytest.approx(0.25)


def test_mixture(spark):
    docs = [(i, f"text number {i} " * (1 + i % 7), "Big Source" if i % 3 else "big-source", 1, 1, "c") for i in range(900)]
    docs += [(2000 + i, f"little {i} of a few", "small", 1, 1, "c") for i in range(20)] + [(3000, docs[0][1], "small", 1, 1, "c"), (3001, None, "small", 1, 1, "c"), (3002, " ", None, 1, 1, "c"), (3003, "elsewhere", "other", 1, 1, "c")]
    df = spark.createDataFrame(docs, DOCS)
    targets = spark.createDataFrame([("big_source", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = mixing.mixture(df, targets, most_off=mixing.MOST_OFF)
    got = mixed.toPandas()
    share = got.groupby("source").tokens.sum() / got.tokens.sum()
    assert abs(share["big_source"] - 2 / 3) < 0.04 and abs(share["small"] - 1 / 3) < 0.04
    assert got.exponent.nunique() == 1 and 0 < got.exponent[0] < 1  # small's repetitions bind, so the exponent gives way as far as MOST_OFF lets it
    blocked = mixing.mixture(df, targets, most_off=mixing.MOST_OFF, block_tokens=40).toPandas()
    assert len(blocked) > 0 and abs(blocked.tokens.sum() - got.tokens.sum()) <= 60 and blocked[blocked.source == "small"].tokens.sum() == got[got.source == "small"].tokens.sum()
    sized = mixing.mixture(df, targets, size=2000).toPandas()
    assert abs(sized.tokens.sum() - 2000) < 150
    assert got["copy"].max() == 3 and not got.duplicated(["doc_id", "copy"]).any() and got[got.source == "big_source"]["copy"].max() == 1
    assert got.place.between(0, 1).all()
    report = {r.source: r for r in mixing.mixture_report(mixed, targets).collect()}
    assert report["absent"].tokens == 0 and report["small"].most_copies == 3
    assert report["small"].exponent == pytest.approx(got.exponent[0]) and report["small"].entropy < report["small"].wanted_entropy + 0.05 and report["absent"].reached_share == 0
    assert mixing.mixture(df.where("false"), targets).count() == 0
