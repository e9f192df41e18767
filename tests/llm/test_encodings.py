from tonearm.llm import encodings

META = "track_id bigint, tag_source string, meta struct<track_name string, album_name string, artist_name string>, pool int"


def test_undo():
    for text, written, read in (("Für Größe", "utf-8", "cp1252"), ("Пьеса", "koi8-r", "cp1251"), ("Ağaç", "cp1254", "latin-1"), ("Été", "cp1252", "mac-roman"), ("海と窓", "euc-jp", "latin-1")):
        assert encodings.undo(text.encode(written).decode(read), written, read) == text
    assert encodings.undo("Größe", "utf-8", "cp1252") is None


def test_chains():
    twice = "Noël".encode().decode("cp1252").encode().decode("cp1252")
    assert dict(encodings.chains(twice))["utf-8>cp1252 utf-8>cp1252"] == "Noël"
    assert encodings.chains("plain") == [("", "plain")]
    assert "lost" in dict(encodings.chains("M�hle")) and "" not in dict(encodings.chains("M�hle"))
    assert "" not in dict(encodings.chains("M?hle")) and dict(encodings.chains("Who is it?")) == {"": "Who is it?"}


def test_found(spark):
    words = ["Große Brücke", "Süße Wälder", "Über den Fluss", "Früher Morgen", "Schöne Höhle", "Golden Harbour", "Naïve Café", "Mémoire d’été", "São João", "Ça ira"]
    rows = [(k, "a", (w + f" {k % 7}", w, None), 0) for k, w in enumerate(words * 8)]
    bad = [w.encode().decode("cp1252", "ignore") for w in words[:5]] + ["M�hle", "Br?cke"]
    rows += [(1000 + k, "b", (w, None, ""), 0) for k, w in enumerate(bad)] + [(1000, "b", (bad[0], None, ""), 0), (2000, None, None, 0), (2001, None, (None, "Größe", None), 0), (2002, "b", ("x" * 40000 + "é", None, None), 0)]
    tracks = spark.createDataFrame(rows, META)
    got = {tuple(r) for r in encodings.found(tracks).collect()}
    assert got == {(1000 + k, "track_name") for k in range(len(bad))}
    fixed = {r.track_id: r.repaired for r in encodings.repaired(tracks).collect()}
    assert [fixed[1000 + k] for k in range(5)] == words[:5] and fixed[1005] is None and fixed[1006] is None
    assert encodings.found(tracks.limit(0)).count() == 0
