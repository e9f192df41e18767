from tonearm.llm import mixing


def test_weights_of_many_sources():
    shares = {"big": 0.5} | {f"s{k}": 0.5 / 5000 for k in range(5000)}
    weights = mixing.whole_weights(shares, mixing.period_of(shares))
    assert sum(weights.values()) == mixing.period_of(shares)
    assert abs(weights["big"] / sum(weights.values()) - 0.5) < 0.01 and min(weights.values()) >= 7


def test_pfair_lag_is_under_a_block():
    weights = mixing.whole_weights({"a": 0.62, "b": 0.25, "c": 0.13}, 400)
    done = dict.fromkeys(weights, 0)
    for t, (source, block) in enumerate(mixing.pfair(weights), 1):
        assert block == done[source]
        done[source] += 1
        assert all(abs(done[s] - w * t / 400) < 1 for s, w in weights.items())


def test_mixture(spark):
    docs = spark.createDataFrame([(k, "some words here " * (1 + k % 5), "abc"[k % 3] if k % 7 else None) for k in range(120)] + [(500, None, "a"), (501, "", "b")], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.0, 3), ("none", 0.2, 4)], "source string, target_share double, max_repeats int")
    mix = mixing.mixture(docs, targets, block_tokens=10)
    rows = mix.collect()
    size = {s: sum(r.n_tokens for r in rows if r.source == s) for s in "ab"}
    assert {r.source for r in rows} == {"a", "b"} and abs(size["a"] / sum(size.values()) - 0.625) < 0.03
    copies = {}
    for r in rows:
        copies[r.source, r.doc_id] = copies.get((r.source, r.doc_id), 0) + 1
    assert max(n for (s, _), n in copies.items() if s == "a") <= 2 and max(n for (s, _), n in copies.items() if s == "b") <= 3
    slots = {}
    for r in rows:
        assert slots.setdefault(r.slot, (r.source, r.block_no)) == (r.source, r.block_no)
    assert mixing.mixture(docs.limit(0), targets).count() == 0
    assert {r.source: r.documents for r in mixing.shares(mix, docs, targets).collect()}["none"] == 0
