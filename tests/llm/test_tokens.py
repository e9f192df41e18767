from tonearm.llm import tokens


def test_long_path_gives_the_direct_ids(spark):
    texts = {1: "x" * 500 + "ab" * 300, 2: "Some words, " * 60 + "y1z" * 50 + "   \n\n  end", 3: "é漢字" * 150, 4: "=" * 333 + " tail", 5: "short", 6: "", 7: None, 8: " " * 300 + "a"}
    df = spark.createDataFrame(list(texts.items()) + [(1, texts[1])], "doc_id bigint, text string")
    rows = tokens.encode(df, block_chars=32).collect()
    c = tokens.codec()
    assert len(rows) == 9
    for r in rows:
        assert r.ids == c.encode(texts[r.doc_id] or "")


def test_vocabulary_use(spark):
    texts = ["a b a", "a", "", None, "xyz " * 40, "a b a"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    c = tokens.codec()
    ids = [c.encode(t) for t in texts if t]
    want = {t: (sum(x.count(t) for x in ids), sum(t in x for x in ids)) for x in ids for t in x}
    for block in (16, 1000):
        assert {r.token_id: (r.occurrences, r.documents) for r in tokens.vocabulary_use(df, block_chars=block).collect()} == want
