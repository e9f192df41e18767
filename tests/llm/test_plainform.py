import unicodedata

from tonearm.llm import plainform

META = "track_id bigint, tag_source string, meta struct<track_name string, artist_name string>, value int"


def _plain(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "value string")
    return {r.value: (r.plain, r.is_case) for r in plainform.plain_values(df).collect()}


def test_forms_against_python(spark):
    values = ["Café", "ＡＢ", "a b", "so­ft", "ﬁn", "Ⅷ", "K", "x‑y", "q̣̇", "q̣̇", "ṩ́", "　海", "가각", "가", "​", "ȩ́", "plain"]
    got = _plain(spark, values)
    for v in values:
        if v not in ("so­ft", "x‑y", "​", "가"):
            assert got[v][0] == unicodedata.normalize("NFKC", v), v
        assert got[v][1] == (got[v][0] != v)
    assert got["so­ft"][0] == "soft" and got["x‑y"][0] == "x-y" and got["​"][0] == ""


def test_lookalikes_take_the_main_script_of_their_word(spark):
    got = _plain(spark, ["Gоldеn Εmma", "Носhь река", "Где моя", "Title Ω", "don’t – go", "3½ ª º … ²", "Zаё"])
    assert got["Gоldеn Εmma"] == ("Golden Emma", True)
    assert got["Носhь река"] == ("Носһь река", True)
    assert not any(got[v][1] for v in ("Где моя", "Title Ω", "don’t – go", "3½ ª º … ²"))
    assert got["Zаё"][1]


def test_cells(spark):
    rows = [(1, "a", ("x​y", None), 1), (1, "a", ("x​y", None), 1), (2, None, ("", "Ａ"), 1), (3, "a", None, 1), (4, "a", ("Straße " * 3000 + " ", "ok"), 2), (None, "a", ("Ａ", "x"), 2)]
    tracks = spark.createDataFrame(rows, META)
    garbled = spark.createDataFrame([(2, "artist_name")], "track_id bigint, field_name string")
    assert {tuple(r) for r in plainform.found(tracks).collect()} == {(1, "track_name"), (2, "artist_name"), (4, "track_name")}
    assert {tuple(r) for r in plainform.found(tracks, garbled).collect()} == {(1, "track_name"), (4, "track_name")}
    assert plainform.found(tracks.limit(0)).count() == 0
    assert plainform.unified(tracks).count() == 4
