import random

from tonearm.llm import names


def test_parse():
    person = lambda n: names.parse(n)[1:4]
    assert person("Föviaronus, Alexander") == person("Dr. ALEXANDER FÖVIARONUS (piano)") == ("foviaronus", "alexander", False)
    assert names.twin(person("A. Foeviaronus")[0]) == "foviaronus" and person("Gelob Samuel") == ("gelob", "samuel", False)
    assert person("Y. Naistugomen") == ("naistugomen", "y", True) and person("Zhenya Naistugomen")[2]
    assert names.parse("E.O. Tind")[4] == "o"
    assert names.parse("Quartet of Bun")[:3] == ("group", "bun", "quartet")
    assert names.parse("Kern Ch. Orch.")[2] == names.parse("Kern Kammerorchester")[2] == "chamber orchestra"
    assert names.parse("Kern Youth Ch.")[2] == names.parse("Kern-Jugendchor")[2] == "choir youth"
    assert names.parse("A B & C D")[0] == names.parse("A B with C D")[0] == names.parse("  ")[0] == ""


def _edges(spark, pairs):
    return {(r.name_a, r.name_b) for r in pairs.collect()}


def test_pairs(spark):
    group = ["Matthew Nirefesov", "Nirefesov, Matt", "M. Nirefesov", "Matthew Nierfesov"]
    umlaut = ["Jonathan Grölafezov", "Jonathan Groelafezov", "Jonathan Grolafezov"]
    other = ["Elizabeth Nazetieben", "Edward Nazetieben", "E. Nazetieben"]  # the initial fits two
    band = ["Veskia Brass Band", "Veskia Brass", "The Veskia Brass BBand"]
    rest = ["Veskia Youth Choir", "Nirefesov, Ursula", "Matthew Nirefesov & Veskia Youth Choir", "x" * 5000, "", None]
    df = spark.createDataFrame([(n,) for n in (group + other + band + umlaut + rest) * 2], "name string")
    want = {tuple(sorted((a, b))) for g in (group, band, umlaut) for a in g for b in g if a != b}
    assert _edges(spark, names.pairs(df)) == want
    assert names.pairs(df.limit(0)).count() == 0


def test_similar_against_brute_force(spark):
    rnd = random.Random(5)
    base = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(3, 16))) for _ in range(150)]
    for s in base[:100]:
        t = list(s)
        for _ in range(rnd.randint(1, 2)):
            i = rnd.randrange(len(t))
            t[i : i + 1] = rnd.choice([[], [rnd.choice("abcde")], [t[i], "x"]])
            if not t:
                t = ["a"]
        base.append("".join(t))
    words = sorted(set(base))
    got = {(r.s, r.t) for r in names.similar(spark.createDataFrame([("b", w) for w in words], "block string, s string")).collect()}

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    want = {(a, b) for a in words for b in words if a != b and lev(a, b) <= names.allowed(min(len(a), len(b)))}
    assert want <= got
    assert all(names.edits(a, b, 3) <= names.allowed(min(len(a), len(b))) for a, b in got)


def test_candidates_dont_grow_with_the_square(spark):
    rnd = random.Random(7)
    some = lambda n: "".join(rnd.choice("abcdefghiklmnoprstuvwz") for _ in range(n))
    words = {some(3) + "ezov" for _ in range(600)} | {"alex" + some(10) for _ in range(600)}  # one segment in common
    met = {(r.s, r.t) for r in names.candidates(spark.createDataFrame([("b", w) for w in words], "block string, s string")).collect()}
    assert len(met) < 20 * len(words)
    assert {(a, b) for a in words for b in words if a < b and names.edits(a, b, 2) <= names.allowed(min(len(a), len(b)))} <= met


def test_two_swaps_across_borders(spark):
    words = ["abcdefghijklmnop", "abcedfghijkmlnop", "abcedfghijklmnpo", "abdcefg", "abcdefg", "acbdefg"]
    got = {(r.s, r.t) for r in names.similar(spark.createDataFrame([("b", w) for w in words], "block string, s string")).collect() if r.s < r.t}
    assert got == {("abcdefghijklmnop", "abcedfghijkmlnop"), ("abcdefghijklmnop", "abcedfghijklmnpo"), ("abcedfghijklmnpo", "abcedfghijkmlnop"), ("abcdefg", "abdcefg"), ("abcdefg", "acbdefg")}
