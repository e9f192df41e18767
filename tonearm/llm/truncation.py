"""Values cut off by field limits or broken transfers (problem 4).

Two kinds of evidence, both over all distinct values. First, near-copies: each value is sketched by min-hashes of its
character shingles at a geometric series of lengths, and the sketches are banded, so a cut copy shares buckets with
what it was cut from, at the largest length it reaches. A pair is verified if the shorter text, edits up to ``EDITS``
of its length allowed, aligns with the start of the longer one; the shorter copy ends early, and what follows tells
whether it ends inside a word or inside a sentence. Each short text is held against all longer ones of its buckets.
Only the beginnings matter that it can align with and what comes right after them; these are few, and sorted they form
a tree, which a short text walks down with one row of the alignment for each character, so shared beginnings are
aligned once and branches without an alignment left are not entered. Beginnings that lack more of its neighbouring
characters than the edits can have changed are left out beforehand. Large buckets are split over tasks.
Near-copies are the costly kind, so they are looked for last, and only for values that the other kind leaves open: those
whose verdict changes with what a near-copy tells. Such a value is held against all longer ones, asked for or not, until
one decides it.

Second, terminality of the closing word: how often the last word, after the word before it, is a whole word elsewhere,
against how often it is the beginning of longer words there. Lengths at which values of one (tag source, field) pile
up at its upper end are field limits; they set the prior. The odds of both are multiplied.

Titles are cases only if they end inside a word; a mark put in place of the rest (an ellipsis) is taken off first, so
titles that end in dots after a whole word are none. Sentence fields (comments) are also cases if they end inside a
sentence: text without closing punctuation that holds earlier sentences, that a near-copy carries on, or whose closing
word hardly ever closes anything. Values that end in other punctuation or in a script without spaces between words
are cases only by a near-copy that carries on inside the word at a field limit.

Null and empty cells have no row; repeated rows count once; a null tag_source is a source of its own. A text that ends
in a digit is no case: a number isn't a word.
"""

from __future__ import annotations

import functools
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tonearm.llm.cells import cells
from tonearm.shared import cut, spread

FIELDS = ("track_name", "album_name", "comment")
SENTENCES = ("comment",)
#: Characters a shingle, hashes a band, bands, and the series of lengths.
SHINGLE, ROWS, BANDS, SCALE, SMALLEST = 3, 2, 2, 1.25, 5
EDITS = 0.1
#: What is asked of the near-copies of a text: whether it ends inside a word, inside a sentence, and all of both.
WORD, SENTENCE, WHOLE = 1, 2, 0
#: Beginnings that one task holds at a time: a larger bucket is split, and its short texts go to every part.
HELD = 1 << 16
#: Rate of cuts away from field limits; how much more often than its neighbours a limit's length occurs.
RATE, PILE = 0.01, 3.0
#: A note of its own: the least cells away from limits, and how many for each cell that goes on after the same words.
REPEATS, OF_LONGER = 4, 0.05
#: Weight of a word's overall counts beside those after the word before; whole and begun words never seen.
BACKOFF, NEW_WHOLE, NEW_BEGUN = 2.0, 0.3, 0.1
MARK = r"\s*(?:\.\.\.|…|\[\.\.\.\]|\[…\]|\(\.\.\.\))\s*$"
_WORD = r"[\p{L}\p{M}\p{N}]+(?:['’][\p{L}\p{M}\p{N}]+)*"
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]$"


def lengths(n: int) -> list[int]:
    """The lengths of the series up to ``n``."""
    out, x = [], float(SMALLEST)
    while int(x) <= n:
        out.append(int(x))
        x = max(x * SCALE, x + 1)
    return out


@functools.lru_cache(maxsize=1 << 10)
def reach(n: int) -> int:
    """How many characters the texts of largest length ``n`` align with at most."""
    x = float(SMALLEST)
    while int(x) <= n:
        x = max(x * SCALE, x + 1)
    return int(x) - 1 + int(EDITS * (int(x) - 1))


def head(text: str, n: int) -> str:
    """The beginning of a text by which texts of largest length ``n`` are judged."""
    most = reach(n)
    return text[: most + 2] + (text[most + 2 :].lstrip()[:1] if text[most : most + 2].isspace() else "")


def sketches(text: str) -> list[tuple[int, int, bool]]:
    """(length, bucket, whether it is the largest length) of each band at each length of the series."""
    hashes = np.array([xxhash.xxh3_64_intdigest(text[i : i + SHINGLE]) for i in range(max(1, len(text) - SHINGLE + 1))], np.uint64)
    mults = np.array([0x9E3779B97F4A7C15 + 2 * k * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF | 1 for k in range(ROWS * BANDS)], np.uint64)
    running = np.minimum.accumulate(hashes[None, :] * mults[:, None], axis=1)  # the min-hashes of every beginning
    out = []
    series = lengths(len(text))
    for n in series:
        at = max(0, n - SHINGLE)
        for b in range(BANDS):
            key = xxhash.xxh3_64_intdigest(running[b * ROWS : (b + 1) * ROWS, at].tobytes() + bytes([b]) + n.to_bytes(4, "little"))
            out.append((n, key - (1 << 63), n == series[-1]))
    return out


def aligned(short: str, long: str) -> int | None:
    """How many characters of ``long`` the whole of ``short`` aligns with, within the edits allowed; None if it doesn't."""
    if long.startswith(short):
        return len(short)
    k = int(EDITS * len(short))
    if not k:
        return None
    same = len(commonprefix((short, long)))  # a common beginning aligns with itself
    short, long = short[same:], long[same:]
    row = {j: j for j in range(k + 1)}
    for i, c in enumerate(short, 1):
        new = {}
        for j in range(max(0, i - k), min(len(long), i + k) + 1):
            best = row.get(j, k + 1) + 1
            if j:
                best = min(best, new.get(j - 1, k + 1) + 1, row.get(j - 1, k + 1) + (c != long[j - 1]))
            new[j] = best
        if not new or min(new.values()) > k:
            return None
        row = new
    edits, end = min((e, -j) for j, e in row.items())
    return same - end if edits <= k else None


def ending(short: str, long: str, n: int) -> tuple[bool, bool]:
    """Whether ``short``, which aligns with ``n`` characters of ``long``, ends inside a word, and inside a sentence."""
    rest = long[n:]
    inside = rest[0].isalnum() and short[-1].isalnum() or len(rest) > 1 and rest[0] in "'’" and rest[1].isalpha()
    return inside, not short[-1] in ".!?" and (inside or rest[0] in ",;:" or rest.lstrip()[:1].islower())


def _past(heads: list[str], prefix: str, lo: int, hi: int) -> int:
    """Where the heads that begin with ``prefix`` end."""
    return bisect_left(heads, prefix + "\U0010ffff", lo, hi)


def neighbours(texts: list[str]) -> np.ndarray:
    """How often the texts hold each of 256 hashes of two neighbouring characters: a row a hash, a column a text."""
    out = np.zeros((len(texts), 256), np.int16)
    for i, t in enumerate(texts):
        points = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        counts = np.bincount((points[:-1] * np.uint32(31) + points[1:]) % np.uint32(256), minlength=256)
        out[i] = np.minimum(counts, np.iinfo(np.int16).max)  # a bound stays a bound
    return np.ascontiguousarray(out.T)


def in_reach(short: str, k: int, heads: list[str], held: np.ndarray) -> list[str]:
    """The heads, longer than ``short``, that hold all of its neighbouring characters but two for each edit."""
    own = neighbours([short])[:, 0]
    at = np.flatnonzero(own)
    lack = np.maximum(own[at, None] - held[at], 0).sum(axis=0, dtype=np.int32)
    return [heads[i] for i in np.flatnonzero(lack <= 2 * k) if len(heads[i]) > len(short)]


def carried_on(short: str, heads: list[str], held: np.ndarray, wants: int = WHOLE) -> tuple[bool, bool] | None:
    """Of all longer ones among the sorted ``heads`` that ``short`` aligns with, as ``aligned`` tells: whether it ends
    inside a word before any, and inside a sentence. None if it aligns with none that goes on.

    ``held`` are the ``neighbours`` of the heads. ``wants``: WORD, SENTENCE or both added, any of which is enough to
    stop at, or WHOLE for the whole answer.
    """
    m, k = len(short), int(EDITS * len(short))
    inside = sentence = met = False

    def judge(lo: int, hi: int, n: int) -> bool:
        """Heads lo to hi, which ``short`` aligns with up to ``n``. Whether there is nothing more to learn."""
        nonlocal inside, sentence, met
        while lo < hi:
            h = heads[lo]
            if len(h) <= max(m, n):
                lo += 1
                continue
            met = True
            a, b = ending(short, h, n)
            inside, sentence = inside or a, sentence or b
            if inside and (sentence or wants & WORD or short[-1] in ".!?") or sentence and wants & SENTENCE:
                return True
            # the two characters after it decide, or the first that is no space; all heads with these tell the same
            at = n + 2
            if h[n].isspace():
                at = len(h) - len(h[n:].lstrip()) + 1
            lo = max(lo + 1, _past(heads, h[: max(at, m + 1)], lo, hi)) if at <= len(h) else lo + 1
        return False

    lo = bisect_right(heads, short)
    if judge(lo, _past(heads, short, lo, len(heads)), m) or not k or not (heads := in_reach(short, k, heads, held)):
        return (inside, sentence) if met else None
    same = len(commonprefix((short, heads[0], heads[-1])))
    # (heads from, to, characters read, alignments of the beginnings of short around there, fewest edits and -end so far)
    todo = [(0, len(heads), same, {i: i - same for i in range(same, min(m, same + k) + 1)}, (k + 1, 0))]
    if m - same <= k:
        todo[0] = (*todo[0][:4], (m - same, -same))
    while todo:
        lo, hi, j, row, best = todo.pop()
        while lo < hi and len(heads[lo]) == j:  # it ends here
            if best[0] <= k and judge(lo, lo + 1, -best[1]):
                return inside, sentence
            lo += 1
        if lo == hi:
            continue
        if j >= m + k:
            if best[0] <= k and judge(lo, hi, -best[1]):
                return inside, sentence
            continue
        first, last = min(row), max(row)
        while lo < hi:
            c = heads[lo][j]
            end = hi if heads[hi - 1][j] == c else max(lo + 1, _past(heads, heads[lo][: j + 1], lo, hi))
            new: dict[int, int] = {}  # only alignments within the edits allowed are kept
            e = diagonal = k + 1
            for i in range(first, m + 1):
                above = row.get(i, k + 1)
                e = min(above, e) + 1
                if i > same and diagonal + (short[i - 1] != c) < e:
                    e = diagonal + (short[i - 1] != c)
                diagonal = above
                if e <= k:
                    new[i] = e
                elif i > last:
                    break
            now = min(best, (new[m], -j - 1)) if m in new else best
            if new:
                todo.append((lo, end, j + 1, new, now))
            elif now[0] <= k and judge(lo, end, -now[1]):
                return inside, sentence
            lo = end
    return (inside, sentence) if met else None


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 2048):
            each = zip(*(batch.column(c).slice(lo, 2048).to_pylist() for c in ("kind", "text", "wants")))
            rows = {(g, head(t, n), n, bucket, wants if largest else None) for g, t, wants in each for n, bucket, largest in sketches(t)}
            cols = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["kind", "head", "scale", "bucket", "wants"])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each part of a bucket comes as its sorted heads, then its short texts."""
    of, heads, held = None, [], None
    for batch in batches:
        rows = []
        for *key, short, text, wants in zip(*(batch.column(c).to_pylist() for c in ("kind", "scale", "bucket", "part", "short", "head", "wants"))):
            if key != of:
                of, heads, held = key, [], None
            if not short:
                heads.append(text)
                continue
            held = neighbours(heads) if held is None else held
            if (got := carried_on(text, heads, held, wants)) is not None:
                rows.append((key[0], text, *got))
        cols = list(zip(*rows)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_(), pa.bool_()))], ["kind", "text", "inside", "goes_on"])


def near_copies(texts: DataFrame, held: int = HELD) -> DataFrame:
    """kind, text, inside, goes_on of the distinct (kind, text) that end before a near-copy of theirs does.

    A column ``wants`` of ``texts`` tells what of the two is asked for, as for ``carried_on``; a text with null there
    only serves the others. Rows of a text that want unlike things get the whole answer, as do all without the column.
    """
    bucket = ["kind", "scale", "bucket"]
    wants = F.col("wants") if "wants" in texts.columns else F.lit(WHOLE)
    asked = texts.select("kind", "text", wants.cast("int").alias("wants")).groupBy("kind", "text").agg(F.min("wants").alias("low"), F.max("wants").alias("high"))
    asked = asked.select("kind", "text", F.when(F.col("low") == F.col("high"), F.col("low")).when(F.col("low").isNotNull(), WHOLE).alias("wants"))
    sketched = spread(asked).mapInArrow(_sketched, "kind string, head string, scale int, bucket bigint, wants int")
    heads = sketched.repartition(*bucket).groupBy(*bucket, "head").agg(F.max("wants").alias("wants"))
    over = Window.partitionBy(*bucket)
    sized = heads.withColumn("n", F.count("*").over(over)).withColumn("met", F.count("wants").over(over)).filter("met > 0 and n > 1")
    parts = F.ceil(F.col("n") / held).cast("int")
    own = F.array(F.struct(F.pmod(F.xxhash64("head"), parts).cast("int").alias("part"), F.lit(False).alias("short")))
    every = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.struct(p.alias("part"), F.lit(True).alias("short")))
    roles = sized.select(*bucket, "head", "wants", F.inline(F.when(F.col("wants").isNotNull(), F.concat(own, every)).otherwise(own)))
    met = spread(roles, *bucket, "part").sortWithinPartitions(*bucket, "part", "short", "head").mapInArrow(_compared, "kind string, text string, inside boolean, goes_on boolean")
    return met.groupBy("kind", "text").agg(F.max("inside").alias("inside"), F.max("goes_on").alias("goes_on"))


def limits(rows: DataFrame) -> DataFrame:
    """tag_source, field_name, limit_n and pile (share of the values there beyond what neighbours suggest)."""
    sizes = rows.groupBy("tag_source", "field_name", "n").agg(F.sum("cells").alias("c"))
    below = F.avg("c").over(Window.partitionBy("tag_source", "field_name").orderBy("n").rangeBetween(-5, -1))
    top = F.max("n").over(Window.partitionBy("tag_source", "field_name"))
    # nothing is longer than a limit
    return sizes.withColumn("below", F.coalesce(below, F.lit(0.0))).withColumn("top", top).filter((F.col("n") == F.col("top")) & (F.col("c") >= PILE * F.greatest("below", F.lit(1.0)))).select(F.col("tag_source").alias("ls"), F.col("field_name").alias("lf"), F.col("n").alias("ln"), F.least(F.lit(0.98), 1 - F.greatest("below", F.lit(0.5)) / F.col("c")).alias("pile"))


def sound_cells(tracks: DataFrame, fields: tuple[str, ...], damaged: DataFrame | None) -> DataFrame:
    """The cells without those in ``damaged`` (track_id, field_name)."""
    source = F.col("tag_source") if "tag_source" in tracks.columns else F.lit(None).cast("string")
    every = cells(tracks.withColumn("tag_source", source), fields)
    return every if damaged is None else every.join(damaged.select("track_id", "field_name"), ["track_id", "field_name"], "left_anti")


def judged(every: DataFrame, sentences: tuple[str, ...] = SENTENCES) -> DataFrame:
    """value, tag_source, field_name, cells and is_cut of each distinct value of a source and field, and what led to it
    (inside and goes_on only where they decide, and then no further than to the first that does).

    ``every`` holds cells: track_id, tag_source, field_name and value.
    """
    rows = every.groupBy("tag_source", "field_name", "value").agg(F.count("*").alias("cells"))
    body = F.regexp_replace("value", MARK, "")
    rows = rows.withColumn("n", F.length("value")).withColumn("body", body).filter("body <> ''")
    rows = rows.withColumn("marked", F.col("body") != F.col("value")).withColumn("kind", F.when(F.col("field_name").isin(*sentences), "sentence").otherwise("title"))
    rows = rows.withColumn("text", F.lower("body")).withColumn("words", F.regexp_extract_all("text", F.lit(f"({_WORD})"), F.lit(1)))
    rows = rows.withColumn("open", F.size(F.split("text", r"[(\[]")) > F.size(F.split("text", r"[)\]]")))
    rows = rows.withColumn("ends_in_word", F.col("text").rlike(r"[\p{L}\p{M}]$") & ~F.col("text").rlike(_UNSPACED))
    rows = rows.withColumn("last", F.when(F.col("ends_in_word"), F.element_at("words", -1)))
    rows = rows.withColumn("prev", F.when(F.size("words") > 1, F.try_element_at("words", F.lit(-2))).otherwise(F.lit("")))
    tops = limits(rows)
    rows = rows.join(tops, F.col("tag_source").eqNullSafe(F.col("ls")) & (F.col("field_name") == F.col("lf")) & (F.col("n") == F.col("ln")), "left").drop("ls", "lf", "ln")
    rows = cut(rows)

    # whole words: all inner ones, and last ones where nothing points to a cut
    sure_last = F.col("pile").isNull() & ~F.col("marked") & ~F.col("open")
    free = F.sum(F.when(F.col("pile").isNull() & ~F.col("marked"), F.col("cells")).otherwise(0))
    once = rows.groupBy("kind", "text").agg(F.first("words").alias("words"), F.max("ends_in_word").alias("ends_in_word"), F.max(sure_last).alias("sure"), free.alias("free"), F.sum("cells").alias("cells"))
    inner = F.when(F.col("sure") | ~F.col("ends_in_word"), F.col("words")).otherwise(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))))
    pairs = once.select("kind", "cells", inner.alias("w")).select("kind", "cells", F.explode(F.arrays_zip(F.concat(F.array(F.lit("")), F.col("w")).alias("a"), F.col("w").alias("b"))).alias("p"))
    two = cut(pairs.filter("p.b is not null").groupBy("kind", F.col("p.a").alias("prev"), F.col("p.b").alias("last")).agg(F.count("*").alias("c2"), F.sum("cells").alias("w2")))
    one = two.groupBy("kind", "last").agg(F.sum("c2").alias("c1"))
    closing = once.filter("sure and size(words) > 0").groupBy("kind", F.element_at("words", -1).alias("last")).agg(F.count("*").alias("closes"))
    begun = lambda word: F.explode(F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda i: F.substring(word, F.lit(1), i)))
    longer = F.length("last") > 1
    begun2 = two.filter(longer).select("kind", "prev", begun(F.col("last")).alias("last"), "c2", "w2").groupBy("kind", "prev", "last").agg(F.sum("c2").alias("b2"), F.sum("w2").alias("bw2"))
    begun1 = one.filter(longer).select("kind", begun(F.col("last")).alias("last"), "c1").groupBy("kind", "last").agg(F.sum("c1").alias("b1"))
    sizes = one.groupBy("kind").agg(F.sum("c1").alias("all"))

    got = rows.join(two, ["kind", "prev", "last"], "left").join(begun2, ["kind", "prev", "last"], "left").join(one, ["kind", "last"], "left").join(begun1, ["kind", "last"], "left").join(closing, ["kind", "last"], "left").join(F.broadcast(sizes), "kind", "left")
    got = got.join(once.select("kind", "text", "sure", "free"), ["kind", "text"])
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    per: Column = BACKOFF / F.coalesce(F.col("all"), F.lit(1))
    # the value's own last word is no witness for itself
    own = F.when(F.col("sure"), 1).otherwise(0)
    whole = F.greatest(zero("c2") - own, F.lit(0)) + per * (F.greatest(zero("c1") - own, F.lit(0)) + NEW_WHOLE)
    part = zero("b2") + per * (zero("b1") + NEW_BEGUN)
    prior = F.coalesce("pile", F.when(F.col("marked"), F.lit(0.5)).otherwise(F.lit(RATE)))
    odds = lambda inside: prior / (1 - prior) * part / whole * F.when(inside, 20.0).otherwise(1.0) * F.when(F.col("open"), 5.0).otherwise(1.0)
    unspaced = F.col("text").rlike(_UNSPACED) & F.col("pile").isNotNull()
    unclosed = ~F.col("body").rlike(r"[.!?…。)\]\"”»:;]\s*$")
    earlier = F.col("body").rlike(r"\p{Ll}[.!?]\s+\p{Lu}")
    hardly = (zero("c1") >= 20) & (zero("closes") <= 0.02 * zero("c1"))
    may_go_on = (F.col("kind") == "sentence") & unclosed
    # a sentence field's text that occurs again and again where no limit explains it is a note of its own
    longer_cells = zero("bw2") + F.greatest(zero("w2") - F.col("free"), F.lit(0))
    note = (F.col("kind") == "sentence") & (F.col("free") >= REPEATS) & (F.col("free") >= OF_LONGER * longer_cells)
    verdicts = {
        "odds": odds(F.lit(False)), "odds_inside": odds(F.lit(True)), "unspaced": unspaced, "may_go_on": may_go_on,
        "ends_sentence": may_go_on & (earlier | hardly & F.col("ends_in_word")), "note": note,
    }
    got = got.select("kind", "text", "value", "tag_source", "field_name", "cells", "n", "marked", "pile", "last", "ends_in_word", "c2", "b2", "c1", "b1", "closes", *[c.alias(n) for n, c in verdicts.items()])

    # near-copies of those that they decide
    is_known = "note or ends_in_word and odds > 1 or ends_sentence"
    word = F.when(F.expr("unspaced or ends_in_word and odds_inside > 1"), WORD).otherwise(0)
    wants = word + F.when(F.col("may_go_on"), SENTENCE).otherwise(0)
    got = cut(got.withColumn("wants", F.when(~F.coalesce(F.expr(is_known), F.lit(False)) & (wants > 0), wants)))
    got = got.join(near_copies(got.filter("length(text) >= 5")), ["kind", "text"], "left")
    inside, goes_on = F.coalesce("inside", F.lit(False)), F.coalesce("goes_on", F.lit(False))
    at_odds = F.when(inside, F.col("odds_inside")).otherwise(F.col("odds"))
    in_word = F.col("ends_in_word") & (at_odds > 1)
    is_cut = (in_word | F.col("unspaced") & inside | F.col("ends_sentence") | F.col("may_go_on") & goes_on) & ~F.col("note")
    return got.select("value", "tag_source", "field_name", "cells", "n", "marked", "pile", "last", "c2", "b2", "c1", "b1", "closes", "inside", "goes_on", at_odds.alias("odds"), in_word.alias("in_word"), F.coalesce(is_cut, F.lit(False)).alias("is_cut"))


def found(tracks: DataFrame, damaged: DataFrame | None = None, fields: tuple[str, ...] = FIELDS, sentences: tuple[str, ...] = SENTENCES) -> DataFrame:
    """track_id and field_name of the cells that were cut; cells ``damaged`` in other ways are left out beforehand."""
    every = cut(sound_cells(tracks, fields, damaged))
    bad = judged(every, sentences).filter("is_cut").select("field_name", "value", F.col("tag_source").alias("s"))
    return every.join(bad, ["field_name", "value"]).filter(F.col("tag_source").eqNullSafe(F.col("s"))).select("track_id", "field_name").distinct()


def shares(tracks: DataFrame, damaged: DataFrame | None = None, fields: tuple[str, ...] = FIELDS, sentences: tuple[str, ...] = SENTENCES) -> DataFrame:
    """tag_source, field_name, cells, cut and share: how many of a source's cells were cut, by field and in all (null)."""
    per = judged(cut(sound_cells(tracks, fields, damaged)), sentences).rollup("tag_source", "field_name")
    counts = per.agg(F.sum("cells").alias("cells"), F.sum(F.when(F.col("is_cut"), F.col("cells")).otherwise(0)).alias("cut"), F.grouping("tag_source").alias("g"))
    return counts.filter("g = 0").drop("g").withColumn("share", F.round(F.col("cut") / F.col("cells"), 6))
