"""One form for text that looks the same (problem 5).

Each distinct value that holds anything but printable ASCII is exploded to positioned code points. Broadcast joins
replace full-width, ligature and symbol forms and split precomposed letters (tables made from the Unicode data that
comes with Python); invisible code points vanish; odd spaces and hyphens become plain ones. Within a word whose
letters come from more than one of the Latin, Greek and Cyrillic scripts, look-alikes are replaced by the letters of
the word's main script. Combining marks are put in order of their class and composed with their letter, and the
string is built again. A value is a case if the result differs from it, or if a word still mixes scripts.

Curly quotes, dashes, ordinal signs (ª º), fractions, circled and superior digits, the ellipsis and words that are
wholly in another script stay as they are. Null and empty values have no row. Zero-width joiners are taken out in
every script. Texts may have any length: a text's code points are sorted in one task, never on the driver.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.llm.cells import cells

FIELDS = ("track_name", "artist_name")
SCRIPTS = ("LATIN", "GREEK", "CYRILLIC")
#: Letters of Greek and Cyrillic that look like the Latin letters below them.
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγηικνορτυχω"
GREEK_AS = "ABEZHIKMNOPTYXaynikvoptuxw"
CYRILLIC = "АВЕЅІЈКМНОРСТУХЬаеѕіјкорсухһԁԛԝӀ"
CYRILLIC_AS = "ABESIJKMHOPCTYXbaesijkopcyxhdqwI"
#: What stands for a plain hyphen.
HYPHENS = "‐‑−﹣－"
#: Compatibility forms that are ordinary text.
KEPT = "ªº"
#: Invisible besides the format characters (category Cf): variation selectors, fillers, the grapheme joiner.
_BLANK = {0x034F, 0x115F, 0x1160, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0), 0x180B, 0x180C, 0x180D}
_HANGUL = range(0xAC00, 0xD7A4)


def replacement(ch: str) -> str | None:
    """What a code point becomes before composing; None: itself."""
    cat = unicodedata.category(ch)
    if ord(ch) in _BLANK or cat in ("Cf", "Cc") and ch not in "\t\n\r":
        return ""
    if cat in ("Zs", "Zl", "Zp") or ch in "\t\n\r":
        return " " if ch != " " else None
    if ch in HYPHENS:
        return "-"
    if ord(ch) in _HANGUL or ch in KEPT:
        return None
    form = unicodedata.decomposition(ch)
    if form.startswith("<"):
        full = unicodedata.normalize("NFKD", ch)
        width = form.startswith(("<wide>", "<narrow>"))
        return full if width or any(x.isalpha() for x in full) else None
    full = unicodedata.normalize("NFD", ch)
    return full if full != ch else None


@functools.cache
def _tables() -> tuple[list, list, list, list]:
    """(replacements, marks with their classes, letters with their scripts, pairs that compose); some 10,000 rows."""
    forms, marks, letters, pairs = [], [], [], []
    for cp in range(sys.maxunicode + 1):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        if (r := replacement(ch)) is not None:
            forms.append((ch, r))
        if c := unicodedata.combining(ch):
            marks.append((ch, c))
        if ch.isalpha() and (s := unicodedata.name(ch, "").split(" ")[0]) in SCRIPTS:
            letters.append((ch, s))
        if cp not in _HANGUL and (d := unicodedata.decomposition(ch)) and d[0] != "<" and unicodedata.normalize("NFC", ch) == ch:
            two = "".join(chr(int(x, 16)) for x in d.split(" "))
            if len(two) == 2:
                pairs.append((two, ch))
    return forms, marks, letters, pairs


def lookalikes() -> list[tuple[str, str, str]]:
    """(letter, script, letter of that script that looks the same)."""
    rows = []
    for script, own, latin in (("GREEK", GREEK, GREEK_AS), ("CYRILLIC", CYRILLIC, CYRILLIC_AS)):
        rows += [(a, "LATIN", b) for a, b in zip(own, latin)] + [(b, script, a) for a, b in zip(own, latin)]
    greek, cyrillic = dict(zip(GREEK_AS, GREEK)), dict(zip(CYRILLIC_AS, CYRILLIC))
    rows += [(greek[x], "CYRILLIC", cyrillic[x]) for x in sorted(greek.keys() & cyrillic.keys())] + [(cyrillic[x], "GREEK", greek[x]) for x in sorted(greek.keys() & cyrillic.keys())]
    return rows


def _composed(letters: Column, table: Column) -> Column:
    """A letter and its marks in order: each mark joins the letter unless a mark of its class or a higher one stays between."""
    start = F.struct(letters[0]["c"].alias("base"), F.lit("").alias("rest"), F.lit(0).alias("last"))

    def step(acc: Column, m: Column) -> Column:
        both = table[F.concat(acc["base"], m["c"])]
        joins = both.isNotNull() & ((acc["rest"] == "") | (acc["last"] < m["ccc"]))
        return F.struct(F.when(joins, both).otherwise(acc["base"]).alias("base"), F.when(joins, acc["rest"]).otherwise(F.concat(acc["rest"], m["c"])).alias("rest"), F.when(joins, acc["last"]).otherwise(m["ccc"]).alias("last"))

    return F.aggregate(F.slice(letters, 2, F.greatest(F.size(letters) - 1, F.lit(0))), start, step, lambda a: F.concat(a["base"], a["rest"]))


def plain_values(values: DataFrame) -> DataFrame:
    """value, plain and is_case of the distinct non-null strings in the column ``value``."""
    spark = values.sparkSession
    forms, marks, letters, pairs = _tables()
    small = lambda rows, schema: F.broadcast(spark.createDataFrame(rows, schema))
    every = values.filter("value is not null").select("value").distinct()
    ascii_only = ~F.col("value").rlike("[^ -~]")
    chars = every.filter(~ascii_only).select("value", F.posexplode(F.split("value", "")).alias("pos", "ch"))
    split = chars.join(small(forms, "ch string, form string"), "ch", "left").select("value", "pos", F.posexplode(F.split(F.coalesce("form", "ch"), "")).alias("sub", "c"))
    known = split.filter("c <> ''").join(small(marks, "c string, ccc int"), "c", "left").join(small(letters, "c string, script string"), "c", "left")
    order = Window.partitionBy("value").orderBy("pos", "sub")
    in_word = F.col("ccc").isNotNull() | F.col("c").rlike(r"^\p{L}$")
    words = known.select("*", F.sum(F.when(in_word, 0).otherwise(1)).over(order).alias("word"))
    alike = lookalikes()
    weak = sorted({a for a, _, _ in alike})
    word = Window.partitionBy("value", "word")
    count = lambda s, strong: F.sum(F.when((F.col("script") == s) & (~F.col("c").isin(weak) if strong else F.lit(True)), 1).otherwise(0)).over(word)
    ranked = F.array_max(F.array(*[F.struct(count(s, True).alias("strong"), count(s, False).alias("n"), F.lit(-k).alias("k"), F.lit(s).alias("s")) for k, s in enumerate(SCRIPTS)]))
    kinds = F.size(F.collect_set("script").over(word))
    told = words.withColumn("target", F.when(kinds > 1, ranked["s"]))
    swap = small(alike, "c string, target string, other string")
    told = told.join(swap, ["c", "target"], "left").withColumn("mixed", F.col("target").isNotNull()).withColumn("c", F.coalesce("other", "c"))
    # a mark belongs to the letter before it; the marks of a letter are ordered by class, then as they came
    told = told.withColumn("group", F.sum(F.when(F.col("ccc").isNull(), 1).otherwise(0)).over(order))
    item = F.struct(F.coalesce("ccc", F.lit(0)).alias("ccc"), "pos", "sub", "c")
    groups = told.groupBy("value", "group").agg(F.array_sort(F.collect_list(item)).alias("letters"), F.max("mixed").alias("mixed"))
    sides = [F.split(F.lit(" ".join(side)), " ") for side in zip(*pairs)]
    built = groups.select("value", "group", "mixed", F.when(F.size("letters") == 1, F.col("letters")[0]["c"]).otherwise(_composed(F.col("letters"), F.map_from_arrays(*sides))).alias("s"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group", "s"))), lambda x: x["s"]), "")
    built = built.groupBy("value").agg(whole.alias("built"), F.max("mixed").alias("mixed"))
    form = F.when(ascii_only, F.col("value")).otherwise(F.coalesce("built", F.lit("")))
    return every.join(built, "value", "left").select("value", form.alias("plain"), ((form != F.col("value")) | F.coalesce("mixed", F.lit(False))).alias("is_case"))


def found(tracks: DataFrame, garbled: DataFrame | None = None, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """track_id and field_name of the cells not in plain form, without the cells in ``garbled``."""
    every = cells(tracks, fields, ())
    cases = every.join(plain_values(every).filter("is_case").select("value"), "value").select("track_id", "field_name").distinct()
    return cases if garbled is None else cases.join(garbled, ["track_id", "field_name"], "left_anti")


def unified(tracks: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """track_id, field_name, value and its plain form, for every cell."""
    every = cells(tracks, fields, ())
    return every.join(plain_values(every).select("value", "plain"), "value").select("track_id", "field_name", "value", "plain")
