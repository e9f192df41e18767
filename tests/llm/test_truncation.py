import random

from tonearm.llm import truncation

META = "track_id bigint, tag_source string, meta struct<track_name string, album_name string, comment string>, n int"


def test_sketches_of_a_beginning_meet():
    long = "the engineer noted a dropout in the left channel"
    for n in (5, 9, 17, 30):
        short = long[:n]
        mine = {b for _, b, largest in truncation.sketches(short) if largest}
        assert mine and mine <= {b for _, b, _ in truncation.sketches(long)}


def test_aligned():
    assert truncation.aligned("golden har", "golden harbour") == 10
    assert truncation.aligned("golde harbou", "golden harbour at night") == 13
    assert truncation.aligned("the golden harbour at nigth", "the golden harbour at night time") is not None
    assert truncation.aligned("abc", "abd and more") is None


def test_found(spark):
    words = ["Golden Harbour", "Silver Mountain", "Quiet Umbrella", "Early Notebook", "Hollow Lighthouse"]
    rows = [(k, "a", (f"{words[k % 5]} and {words[(k * 3 + 1) % 5]}", None, None), 0) for k in range(60)]
    rows += [(100, "b", ("Silver Mountain and Golden Harb", None, None), 0), (101, "b", ("Waiting for the Golden Harbour...", None, None), 0), (102, "b", ("Silver Mount...", None, None), 0)]
    notes = [(200 + k, "a", (None, None, "needs checking"), 0) for k in range(8)]
    told = [(300 + k, "a", (None, None, f"The engineer noted a dropout near the end of side {k}."), 0) for k in range(30)]
    cuts = [(400, "b", (None, None, "The engineer noted a drop"), 0), (401, "b", (None, None, "The tape is worn. The engineer"), 0), (402, "b", (None, "", None), 0), (403, None, None, 0), (404, "b", (None, None, "The engineer noted a drop"), 0), (405, "b", (None, None, "The engineer noted a dropout near the end of side 3. " * 200), 0)]
    tracks = spark.createDataFrame(rows + notes + told + cuts, META)
    assert {tuple(r) for r in truncation.found(tracks).collect()} == {(100, "track_name"), (102, "track_name"), (400, "comment"), (401, "comment"), (404, "comment")}
    damaged = spark.createDataFrame([(100, "track_name")], "track_id bigint, field_name string")
    assert (100, "track_name") not in {tuple(r) for r in truncation.found(tracks, damaged).collect()}
    share = {(r.tag_source, r.field_name): r.cut for r in truncation.shares(tracks).collect()}
    assert share["b", "comment"] == 3 and share["a", "comment"] == 0 and share["b", None] == 5
    assert truncation.found(tracks.limit(0)).count() == 0


def _texts(seed):
    rnd = random.Random(seed)
    out = set()
    for _ in range(12):
        family = {"".join(rnd.choice("abcde .,'") for _ in range(rnd.choice([5, 11, 20, 33, 60])))}
        for _ in range(15):
            t = list(rnd.choice(sorted(family)))
            for _ in range(rnd.choice([0, 0, 1, 2])):
                i = rnd.randrange(len(t))
                t[i : i + 1] = rnd.choice([[], ["b"], [t[i], "c"]])
            t = t[: rnd.randint(5, 70)] + [rnd.choice("abc  '") for _ in range(rnd.randint(0, 6))]
            family.add("".join(t))
        out |= {t for t in family if len(t) >= 5}
    return sorted(out)


def test_near_copies_against_brute_force(spark):
    texts = _texts(3)
    buckets = {t: truncation.sketches(t) for t in texts}
    want = {}
    for s in texts:
        mine = {(n, b) for n, b, largest in buckets[s] if largest}
        for t in texts:
            if len(t) > len(s) and any((n, b) in mine for n, b, _ in buckets[t]):
                n = truncation.aligned(s, t)
                if n is not None and n < len(t):
                    rest = t[n:]
                    inside = rest[0].isalnum() and s[-1].isalnum() or len(rest) > 1 and rest[0] in "'’" and rest[1].isalpha()
                    goes_on = s[-1] not in ".!?" and (inside or rest[0] in ",;:" or rest.lstrip()[:1].islower())
                    was = want.get(s, (False, False))
                    want[s] = (was[0] or inside, was[1] or goes_on)
    df = spark.createDataFrame([("title", t) for t in texts], "kind string, text string")
    assert len(want) > 50
    assert {r.text: (r.inside, r.goes_on) for r in truncation.near_copies(df).collect()} == want
    assert {r.text: (r.inside, r.goes_on) for r in truncation.near_copies(df, held=2).collect()} == want  # every bucket split


def test_a_text_between_hides_no_near_copy(spark):
    texts = ["the engineer noted a dropout in the left chan", "the engineer noted a dropout in the left chan and more", "the engineer noted a dropout in the left channel"]
    got = truncation.near_copies(spark.createDataFrame([("sentence", t) for t in texts], "kind string, text string"))
    assert {r.text: r.inside for r in got.collect()}[texts[0]]


def test_near_copies_only_of_those_asked_for(spark):
    texts = _texts(5)
    rows = [("title", t, (None, 0, 1, 2, 3)[k % 5]) for k, t in enumerate(texts)]
    every = {r.text: (r.inside, r.goes_on) for r in truncation.near_copies(spark.createDataFrame([r[:2] for r in rows], "kind string, text string")).collect()}
    got = {r.text: (r.inside, r.goes_on) for r in truncation.near_copies(spark.createDataFrame(rows, "kind string, text string, wants int")).collect()}
    for _, t, wants in rows:
        inside, goes_on = got.get(t, (False, False))
        whole = every.get(t, (False, False))
        assert (wants is not None or t not in got) and inside <= whole[0] and goes_on <= whole[1]  # none told wrongly
        if wants == 0:
            assert (inside, goes_on) == whole
        elif wants:
            found = lambda a, b: bool(wants & 1 and a or wants & 2 and b)
            assert found(inside, goes_on) == found(*whole)
    # rows of one text that want unlike things
    t = next(t for t, both in every.items() if all(both))
    two = spark.createDataFrame([*rows, ("title", t, 1), ("title", t, 2)], "kind string, text string, wants int")
    assert {r.text: (r.inside, r.goes_on) for r in truncation.near_copies(two).collect()}[t] == (True, True)


def test_verdicts_are_those_of_all_near_copies(spark, monkeypatch):
    words = "golden harbour silver mountain quiet umbrella early notebook hollow lighthouse engineer dropout".split()
    rnd = random.Random(7)
    cells = []
    for k in range(400):
        t = " ".join(rnd.choice(words) for _ in range(rnd.randint(3, 9))) + rnd.choice(["", "."])
        t = t[: rnd.randint(8, len(t))] if k % 4 == 0 else t
        cells.append((k, rnd.choice(["a", None]), rnd.choice(["track_name", "comment"]), t))
        cells += [(1000 + k, "a", cells[-1][2], t[: rnd.randint(8, len(t))])] if k % 3 == 0 else []
    df = spark.createDataFrame(cells, "track_id bigint, tag_source string, field_name string, value string")
    verdicts = lambda: sorted((r.value, str(r.tag_source), r.field_name, r.is_cut) for r in truncation.judged(df).collect())
    asked, some, all_of_them = [], verdicts(), truncation.near_copies

    def whole(texts):
        asked.append((texts.filter("wants is not null").count(), texts.count()))
        return all_of_them(texts.drop("wants"))

    monkeypatch.setattr(truncation, "near_copies", whole)
    assert verdicts() == some and any(v[-1] for v in some)
    assert 0 < asked[0][0] < 0.8 * asked[0][1]
