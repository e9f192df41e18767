"""Variant spellings of the names of people and groups (problem 2).

Each distinct name is parsed once: titles, roles in brackets and articles go; "Surname, Given" and "Quartet of Place"
are put in order; letters are folded. A person becomes a surname and a given name, which is full, or short (initials,
abbreviations, nicknames). A group becomes a place and the words of its kind, abbreviations and translations resolved.
A name that holds two entities ("A & B", "A with B", "A; B") belongs to none.

Similar surnames, places and given names are found by exact look-ups; k edits are allowed, 0 below 5 characters, 1 below
13 and 2 from there, and swapped neighbours count as one. At k = 1 two strings meet in what is left of them without one
character. At k = 2 it is a pigeonhole segment join: the shorter string is cut into four segments, of which two survive.
It is indexed by each two of its segments, and longer or equal strings look up the two substrings they can have become,
at the positions that few enough insertions and deletions can have moved them to. A swap across a border touches two
segments, so the shorter string is also indexed with such swaps made. An edit distance verifies each candidate. One
segment alone would meet a share of all strings, whatever their number; so candidates would grow with its square.

Names with equal given names and similar surnames, or equal surnames and similar given names, are linked, and linked
names make up entities (connected components, by label propagation over written tables). A short name joins the
entity whose given name it can stand for, at the smallest distance of surnames, if that is one entity only; so does a
group with part of another's kind. Short names without such an entity are linked among themselves. People of one
surname with other given names, and groups of one place of another kind, stay apart; so do people with other middle
names.

Null and empty names have no row. Links are between distinct names, never between rows: the work doesn't grow with
repetitions of a name, and no surname's names are paired out; only the pairs of one entity are.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from itertools import combinations
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tonearm.llm.cells import cells
from tonearm.shared import cut, spread

FIELDS = ("artist_name", "composer_name", "performer_name")

#: What comes before a name without being part of it.
TITLES = frozenset("dr prof professor sir dame lord lady mr mrs ms miss herr frau mme mlle monsieur maestro maestra don dona rev hon".split())
#: Words of groups, in English.
KINDS = frozenset("orchestra philharmonic symphony chamber string quartet quintet trio duo ensemble jazz brass wind band choir chorus chorale youth boys girls brothers sisters singers players consort orchestra collective".split())
#: Abbreviations and translations of these words.
KIND_FORMS = dict(
    line.split(": ")
    for line in """orch: orchestra
phil: philharmonic
philh: philharmonic
sym: symphony
symph: symphony
cham: chamber
str: string
strings: string
qt: quartet
qrt: quartet
quart: quartet
ens: ensemble
bd: band
yth: youth
bros: brothers
jugendchor: youth choir
kammerorchester: chamber orchestra
kammerchor: chamber choir
streichquartett: string quartet
streichorchester: string orchestra
blaskapelle: brass band
blasorchester: wind orchestra
jazzensemble: jazz ensemble
philharmoniker: philharmonic orchestra
sinfonieorchester: symphony orchestra
philharmonisches: philharmonic
orchester: orchestra
gebruder: brothers
geschwister: sisters
knabenchor: boys choir
chor: choir
quartett: quartet
orchestre: orchestra
philharmonique: philharmonic
symphonique: symphony
quatuor: quartet
fanfare: brass band
choeur: choir
freres: brothers
soeurs: sisters
orquesta: orchestra
filarmonica: philharmonic
sinfonica: symphony
cuarteto: quartet
coro: choir
juvenil: youth
hermanos: brothers
hermanas: sisters""".split("\n")
)
#: Nicknames, after the names they stand for.
NICKNAMES = """alexander: alex al sandy sasha xander
alexandra: alex sandra sasha
andrew: andy drew
anthony: tony
benjamin: ben benny
barbara: barb babs
catherine: cathy kate katie cat
charles: charlie chuck
charlotte: lotte charlie lottie
christopher: chris kit
christine: chris tina
daniel: dan danny
david: dave davey
deborah: deb debbie
dmitri: dima mitya
dorothy: dot dottie
edward: ed eddie ned ted teddy
eleanor: ellie nell nora
elizabeth: beth betsy betty eliza lisa liz lizzie
emily: em emmy
francisco: paco pancho curro
frances: fran franny
frederick: fred freddie
friedrich: fritz fred
gabriele: gabi gabby
gabriel: gabe
george: georgie
gregory: greg
harold: harry hal
heinrich: heinz
helen: nell
henrietta: etta hetty hettie
henry: hank harry
ignacio: nacho
jacob: jake
james: jim jimmy jamie
johannes: hannes hans
john: jack johnny
jonathan: jon jonny
jose: pepe
joseph: joe joey
katherine: kate kathy katie kitty kay
kenneth: ken kenny
lawrence: larry
leonard: len lenny leo
margaret: maggie meg peggy greta marge
maria: mia
matthew: matt matty
michael: mick mickey mike
natalia: natasha
nicholas: nick nicky
oliver: ollie olly
pamela: pam
patricia: pat patty trish
patrick: pat paddy
peter: pete
philip: phil
philippa: pippa
raymond: ray
rebecca: becky becca
richard: dick rick richie
robert: bob bobby rob robbie bert
ronald: ron ronnie
samuel: sam sammy
samantha: sam
stephen: steve
susan: sue susie
theodore: ted teddy theo
theresa: terry tess
thomas: tom tommy
timothy: tim
ursula: ulla uschi
victoria: vicky tori
vladimir: vova volodya
walter: walt
william: bill billy will willy liam
yevgenia: zhenya
zachary: zack zach zak"""
_SHORT: dict[str, set[str]] = {}
for _line in NICKNAMES.split("\n"):
    _name, _nicks = _line.split(": ")
    for _n in _nicks.split(" "):
        _SHORT.setdefault(_n, set()).add(_name)
_GIVEN = frozenset(line.split(":")[0] for line in NICKNAMES.split("\n"))
#: Between the names of two entities.
TWO = re.compile(r";|\s(?:&|\+|/|with|feat\.?|featuring|ft\.?|vs\.?|and|und|et|mit|avec|con|y)\s|\s/|/\s", re.I)
_FOLDS = str.maketrans({"ß": "ss", "ø": "o", "æ": "ae", "œ": "oe", "ł": "l", "đ": "d", "ð": "d", "þ": "th", "ı": "i", "’": "'", "‘": "'", "ʼ": "'"})
_LINKS = frozenset("the of de von der des du di del da le la les el los die das".split())


@functools.lru_cache(maxsize=1 << 16)
def fold(text: str) -> str:
    """Letters without case and accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.casefold().translate(_FOLDS)) if not unicodedata.combining(c))


def twin(folded: str) -> str:
    """One form for ä and ae, which are a and ae when folded."""
    return re.sub(r"([aou])e(?=[^aeiou\W])", r"\1", folded)


def edits(a: str, b: str, k: int) -> int:
    """Edit distance within a band of ``k``; k + 1 if it is larger. Two swapped neighbours are one edit."""
    if abs(len(a) - len(b)) > k:
        return k + 1
    # common beginnings and ends align with themselves
    same = len(commonprefix((a, b)))
    a, b = a[same:], b[same:]
    same = len(commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - same], b[: len(b) - same]
    before: dict[int, int] = {}
    row = {j: j for j in range(k + 1)}
    for i in range(1, len(a) + 1):
        new = {}
        for j in range(max(0, i - k), min(len(b), i + k) + 1):
            if not j:
                new[j] = i
                continue
            best = min(row.get(j, k + 1) + 1, new.get(j - 1, k + 1) + 1, row.get(j - 1, k + 1) + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, before.get(j - 2, k + 1) + 1)
            new[j] = best
        if min(new.values(), default=k + 1) > k and min(row.values()) >= k:  # a swap looks two rows back
            return k + 1
        before, row = row, new
    return min(k + 1, row.get(len(b), k + 1))


#: From these lengths on, one and two edits are allowed.
SHORT, LONG = 5, 13


def allowed(n: int) -> int:
    return 0 if n < SHORT else 1 if n < LONG else 2


@functools.lru_cache(maxsize=1 << 16)
def kind_words(token: str) -> tuple[str, ...]:
    """The words of a group's kind that a folded token stands for; none for other words."""
    if token in KINDS:
        return (token,)
    if token in KIND_FORMS:
        return tuple(KIND_FORMS[token].split(" "))
    for a in KINDS:
        if token.startswith(a) and token[len(a) :] in KINDS:
            return (a, token[len(a) :])
    if len(token) >= 5 and token not in _GIVEN:
        for a in sorted(KINDS):
            if len(a) >= 5 and edits(token, a, 1) <= 1:
                return (a,)
    return ()


def loose_kind(word: str, token: str) -> tuple[str, ...]:
    """The same beside another word of a kind: short words with a typo, and any abbreviation of one word."""
    near = [a for a in sorted(KINDS) if len(token) >= 3 and len(a) >= 4 and edits(token, a, 1) <= 1]
    if word.endswith(".") and len(token) > 1:
        near = near or [a for a in sorted(KINDS) if a[0] == token[0] and re.fullmatch(".*".join(map(re.escape, token)) + ".*", a)]
    return (near[0],) if len(near) == 1 else ()


def parse(name: str) -> tuple[str, str, str, bool, str]:
    """(shape, surname or place, given name or kind, whether that is short, initials of middle names).

    Shapes are 'person', 'group' and '' for names that hold none or two entities.
    """
    if TWO.search(name):
        return "", "", "", False, ""
    bare = re.sub(r"\([^()]*\)|\[[^\[\]]*\]", " ", name)
    if bare.count(",") == 1:
        head, tail = bare.split(",")
        bare = f"{tail} {head}"
    tokens = [t for t in re.split(r"[\s,]+", bare.replace("‐", "-").replace("‑", "-")) if t.strip(".-")]
    words = [w for t in tokens for w in t.split("-") if w]
    kinds: list[str] = []
    place: list[str] = []
    folded = [fold(w).strip(".") for w in words]
    known = [bool(kind_words(f)) for f in folded]
    if folded and folded[0] == "phil" and sum(known) == 1:
        known[0] = False  # a given name
    for i, (w, f) in enumerate(zip(words, folded)):
        if f == "phil" and not known[i]:
            found: tuple[str, ...] = ()
        elif f == "ch" and (w.endswith(".") or len(words) > 2):
            found = ("chamber",) if i + 1 < len(words) and kind_words(folded[i + 1]) else ("choir",)
        else:
            found = kind_words(f) or (loose_kind(w, f) if i and any(known) else ())
        if found:
            kinds += [k for k in found if k not in kinds]
        elif f and f not in _LINKS:
            place.append(f)
    if kinds and place:
        return "group", " ".join(place), " ".join(sorted(kinds)), False, ""
    parts = [(t, fold(t)) for t in re.sub(r"\.(?=\w)", ". ", " ".join(tokens)).split(" ")]
    while len(parts) > 1 and parts[0][1].strip(".") in TITLES:
        parts.pop(0)
    if not parts[0][1].strip("."):
        return "", "", "", False, ""
    if len(parts) == 1:
        return "person", parts[0][1].strip("."), "", False, ""
    if len(parts) == 2 and parts[1][1] in _GIVEN and parts[0][1] not in _GIVEN and parts[0][1] not in _SHORT:
        parts.reverse()  # "Surname Given"
    given = parts[0][1]
    short = given.endswith(".") or len(given.strip(".")) == 1 or given in _SHORT
    middle = "".join(f[0] for _, f in parts[1:-1] if f not in _LINKS and f[0].isalpha())
    return "person", parts[-1][1].strip("."), given.strip("."), short, middle


# Segment join.


def parts_of(n: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of k + 2 segments of a string of length n: a swap of neighbours may touch two of them."""
    size, more = divmod(n, k + 2)
    out, at = [], 0
    for i in range(k + 2):
        length = size + (i >= k + 2 - more)
        out.append((at, length))
        at += length
    return out


def swapped_at(s: str, k: int) -> Iterator[tuple[int, str]]:
    """(how many, the string with them) of up to ``k`` swaps of neighbours across borders of segments."""
    borders = [a for a, _ in parts_of(len(s), k)[1:] if s[a - 1] != s[a]]
    for m in range(k + 1):
        for some in combinations(borders, m):
            t = list(s)
            for a in some:
                t[a - 1], t[a] = t[a], t[a - 1]
            yield m, "".join(t)


@functools.lru_cache(maxsize=1 << 10)
def moves(k: int, longer: int) -> list[tuple[int, int]]:
    """How far two segments can have moved by at most ``k`` insertions and deletions that make a string so much longer."""
    reach = range(-k, k + 1)
    return [(x, y) for x in reach for y in reach if abs(x) + abs(y - x) + abs(longer - y) <= k]


def keys(s: str) -> set[tuple[bool | None, int, int, str]]:
    """(probe, n, seg, piece) of all look-ups of a string; probe is null where strings of both sides meet in one key."""
    n, out = len(s), set()
    if SHORT <= n < LONG:
        out.add((None, n, -1, s))
    if SHORT <= n <= LONG:
        out |= {(None, n - 1, -1, s[:i] + s[i + 1 :]) for i in range(n)}
    if n < LONG:
        return out
    k = allowed(n)
    parts = parts_of(n, k)
    for m, t in swapped_at(s, k):
        # a swap made leaves fewer edits: one of two disjoint pairs of segments survives one edit, any pair none
        for x, y in [*combinations(range(k + 2), 2)] if not m else [(0, 1), (2, 3)][: k - m + 1]:
            (a, p), (b, q) = parts[x], parts[y]
            out.add((False, n, x * (k + 2) + y, t[a : a + p] + t[b : b + q]))
    for of in range(max(LONG, n - k), n + 1):
        parts = parts_of(of, k)
        for x, y in combinations(range(k + 2), 2):
            (a, p), (b, q) = parts[x], parts[y]
            for v, w in moves(k, n - of):
                if a + v >= 0 and a + v + p <= b + w and b + w + q <= n:
                    out.add((True, of, x * (k + 2) + y, s[a + v : a + v + p] + s[b + w : b + w + q]))
    return out


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each string."""
    names = ["block", "s", "probe", "n", "seg", "piece"]
    types = (pa.string(), pa.string(), pa.bool_(), pa.int32(), pa.int32(), pa.string())
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            each = zip(batch.column("block").slice(lo, 1024).to_pylist(), batch.column("s").slice(lo, 1024).to_pylist())
            rows = [(block, s, *key) for block, s in each for key in keys(s)]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("s").to_pylist(), batch.column("t").to_pylist()
        d = [edits(x, y, allowed(min(len(x), len(y)))) for x, y in zip(a, b)]
        keep = pa.array([e <= allowed(min(len(x), len(y))) for x, y, e in zip(a, b, d)], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("block"), batch.column("s"), batch.column("t"), pa.array(d, pa.int32())], ["block", "s", "t", "edits"]).filter(keep)


def candidates(strings: DataFrame) -> DataFrame:
    """block, s and t (s < t) of the strings of a block that meet in a key; every pair within the edits allowed does."""
    rows = cut(spread(strings.select("block", "s").distinct()).mapInArrow(_index, "block string, s string, probe boolean, n int, seg int, piece string"))
    indexed, probes = rows.filter("probe is null or not probe").drop("probe"), rows.filter("probe is null or probe").drop("probe").withColumnRenamed("s", "t")
    met = indexed.join(probes, ["block", "n", "seg", "piece"]).filter("s < t or seg >= 0 and s > t")
    return met.select("block", F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t")).distinct()


def similar(strings: DataFrame) -> DataFrame:
    """block, s, t and edits of the different strings of a block within the edits allowed, each pair both ways.

    ``strings`` has the columns block and s.
    """
    one = candidates(strings).mapInArrow(_verified, "block string, s string, t string, edits int")
    return one.union(one.select("block", F.col("t").alias("s"), F.col("s").alias("t"), "edits"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id and comp (the least id of its component) of all ``nodes`` (id); ``edges`` (a, b) may stand in one direction."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    label = cut(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("comp")))
    while True:
        near = both.join(label, both.b == label.id).groupBy("a").agg(F.min("comp").alias("least"))
        # the least label near by, and that label's own label
        new = label.join(near, label.id == near.a).select("id", F.least("comp", "least").alias("comp"))
        hop = new.select(F.col("id").alias("comp"), F.col("comp").alias("hop"))
        new = cut(new.join(hop, "comp", "left").select("id", F.least("comp", F.coalesce("hop", "comp")).alias("comp")))
        moved = new.join(label.withColumnRenamed("comp", "old"), "id").filter("comp <> old").isEmpty()
        label = new
        if moved:
            return nodes.select("id").distinct().join(label, "id", "left").select("id", F.coalesce("comp", "id").alias("comp"))


# Entities.


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [parse(n) for n in batch.column("name").to_pylist()]
        cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column("name"), *cols, pa.array([twin(r[1]) for r in rows], pa.string())], ["name", "shape", "a", "b", "short", "mid", "twin"])


def entities(names: DataFrame) -> DataFrame:
    """name and entity (a number) of each distinct non-empty name that holds one entity."""
    parsed = names.select("name").filter("name is not null and name <> ''").distinct().mapInArrow(_parsed, "name string, shape string, a string, b string, short boolean, mid string, twin string")
    parsed = cut(parsed.filter("shape <> '' and a <> ''").withColumn("id", F.xxhash64("shape", "a", "b", "short", "mid")))
    cores = cut(parsed.select("id", "shape", "a", "b", "short", "mid", "twin").distinct())
    alike = cut(similar(cores.select(F.col("shape").alias("block"), F.col("a").alias("s"))))
    forms = cores.select(F.col("shape").alias("block"), "twin", F.col("a").alias("s")).distinct()
    same = forms.join(forms.withColumnRenamed("s", "t"), ["block", "twin"]).select("block", "s", "t", F.lit(0).alias("edits"))
    near = alike.union(same).groupBy("block", "s", "t").agg(F.min("edits").alias("edits"))
    near = cut(near.withColumnRenamed("block", "shape"))

    def side(df: DataFrame, x: str) -> DataFrame:
        return df.select("shape", *[F.col(c).alias(c + x) for c in ("id", "a", "b", "short", "mid")])

    left, right = side(cores, "1"), side(cores, "2")
    one_mid = F.col("mid1").startswith(F.col("mid2")) | F.col("mid2").startswith(F.col("mid1"))
    full1, full2 = left.filter("not short1"), right.filter("not short2")
    # the same given name or kind, a similar surname or place
    like_a = full1.join(near, (full1.shape == near.shape) & (full1.a1 == near.s)).drop(near.shape).join(full2, (full1.shape == full2.shape) & (near.t == full2.a2) & (full1.b1 == full2.b2)).filter(one_mid & (F.col("id1") != F.col("id2"))).select(F.col("id1").alias("a"), F.col("id2").alias("b"))
    # the same surname, a similar given name
    people = cores.filter("shape = 'person' and not short and b <> ''")
    givens = similar(people.select(F.col("a").alias("block"), F.col("b").alias("s"))).select(F.col("block").alias("a1"), F.col("s").alias("b1"), F.col("t").alias("b2"))
    like_b = full1.filter("shape = 'person'").join(givens, ["a1", "b1"]).join(full2.filter("shape = 'person'").withColumnRenamed("a2", "a1"), ["a1", "b2"]).filter(one_mid).select(F.col("id1").alias("a"), F.col("id2").alias("b"))
    # a name run together
    runs = cores.filter("shape = 'person' and b = ''").select(F.col("id").alias("a"), F.col("a").alias("run")).join(people.select(F.col("id").alias("b"), F.concat("b", "a").alias("run")), "run").select("a", "b")
    swapped = people.alias("x").join(people.alias("y"), (F.col("x.a") == F.col("y.b")) & (F.col("x.b") == F.col("y.a"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    sure = like_a.union(like_b).union(runs).union(swapped).distinct()
    comp = cut(components(cores.select("id"), sure))

    # short names and parts of kinds join one entity at the smallest distance
    nicks = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, sorted(x))) for pair in sorted(_SHORT.items()) for x in pair])
    fits = lambda x, y: F.col(y).startswith(F.col(x)) | F.coalesce(F.array_contains(nicks[F.col(x)], F.col(y)), F.lit(False))
    shorts = left.filter("short1").join(near, (left.shape == near.shape) & (left.a1 == near.s)).drop(near.shape).join(full2, (left.shape == full2.shape) & (near.t == full2.a2) & (F.substring("b1", 1, 1) != "")).drop(full2.shape)
    shorts = shorts.filter(one_mid & fits("b1", "b2"))
    kinds = F.split("b1", " "), F.split("b2", " ")
    partial = left.filter("shape = 'group'").join(near.filter("shape = 'group'"), F.col("a1") == F.col("s")).drop(near.shape).join(right.filter("shape = 'group'").drop("shape"), F.col("t") == F.col("a2")).filter((F.size(F.array_except(*kinds)) == 0) & (F.size(kinds[0]) < F.size(kinds[1])))
    chances = shorts.select("id1", "id2", "edits").union(partial.select("id1", "id2", "edits")).join(comp.select(F.col("id").alias("id2"), "comp"), "id2")
    best = chances.withColumn("least", F.min("edits").over(Window.partitionBy("id1"))).filter("edits = least").groupBy("id1").agg(F.min("comp").alias("to"), F.max("comp").alias("other"))
    best = cut(best)
    joined = best.filter("to = other").select(F.col("id1").alias("a"), F.col("to").alias("b"))
    # short names of nobody known
    alone = cut(cores.filter("short").join(best, F.col("id") == F.col("id1"), "left_anti"))
    can_be = lambda x: F.concat(F.array(x), F.coalesce(nicks[F.col(x)], F.array().cast("array<string>")))
    agree = F.exists(can_be("b1"), lambda x: F.exists(can_be("b2"), lambda y: x.startswith(y) | y.startswith(x)))
    l2, r2 = side(alone, "1"), side(alone, "2").drop("shape")
    among = l2.join(near.filter("shape = 'person'").drop("shape"), F.col("a1") == F.col("s")).join(r2, F.col("t") == F.col("a2")).filter((F.col("id1") != F.col("id2")) & one_mid & agree).select(F.col("id1").alias("a"), F.col("id2").alias("b"))
    whole = components(cores.select("id"), sure.union(joined).union(among))
    return parsed.join(whole, "id").select("name", F.col("comp").alias("entity"))


def names_of(tracks: DataFrame, fields: tuple[str, ...] = FIELDS, damaged: DataFrame | None = None) -> DataFrame:
    """The distinct names; cells ``damaged`` in other ways are left out beforehand."""
    every = cells(tracks, fields, ())
    if damaged is not None:
        every = every.join(damaged.select("track_id", "field_name"), ["track_id", "field_name"], "left_anti")
    return every.select(F.col("value").alias("name")).distinct()


def pairs(names: DataFrame) -> DataFrame:
    """name_a < name_b by code points: the pairs of different spellings of one entity, of the names in ``name``."""
    of = cut(entities(names))
    a, b = of.withColumnRenamed("name", "name_a"), of.withColumnRenamed("name", "name_b")
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b").distinct()
