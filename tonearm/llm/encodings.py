"""Text decoded with the wrong encoding, and its repair (problem 1).

A stored value is taken as an original text that went through a latent chain: none, or one to three wrong decodings
(bytes of one encoding read as another), or a loss that left ``?`` or U+FFFD in place of letters. For each distinct
value all chains that lead to it are inverted. Expectation-maximisation over the whole table estimates the share of
each chain in each pool (a tag source and field) and a character model of the originals; evidence from all records
is pooled in both. Each record is then repaired by the posterior of its chains.

The model: P(value) = sum over chains of P(chain | pool) P(original of the chain). A pool's shares are smoothed by
those of the whole table. Originals are scored by trigrams of case-folded characters, backing off to bigrams and to
character classes (script, case, accent). The first rounds score by classes alone: a garbled name that recurs may have taught
its n-grams to the counts, but hardly the classes. Both are fixed in size whatever the data: ``SLOTS`` hashed n-gram
counts, ``POOLS`` hashed pools; so they may be held by every worker. Values are counted once in each of their pools.

Null and empty cells have no row; values in printable ASCII without a question mark in a word can't be cases. A chain
that lost characters gives no original: ``repaired`` is null. Ties go to the shorter, then the earlier chain.
"""

from __future__ import annotations

import functools
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonearm.llm.cells import cells
from tonearm.llm.plainform import lookalikes
from tonearm.shared import cut, spread

FIELDS = ("track_name", "album_name", "artist_name")
#: Encodings that bytes may have been in, and encodings they may have been read as.
WRITTEN = ("utf-8", "cp1252", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp1253", "iso8859-7", "cp1254", "mac-roman", "cp850", "cp437", "cp932", "euc-jp", "gbk", "big5", "euc-kr")
READ = ("cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "cp1253", "cp1254", "mac-roman", "cp437", "cp850", "cp932", "gbk")
ONE_BYTE = READ[:12]
DEPTH = 3
#: Rounds by character classes alone, and by the full model.
FIRST_ROUNDS, ROUNDS = 5, 4
#: Shares to begin with: of a chain of one step, of longer ones.
BEGIN = (5e-4, 5e-5)
#: Ways with a posterior below this after the first round are left out of the later ones.
UNLIKELY = 1e-6
POOLS = 1 << 12
SLOTS = 1 << 18
#: Weight of the whole table's shares within a pool, in values, and the least share of any chain.
PRIOR, FLOOR = 50.0, 1e-5
LOST = "�"
_WORD = re.compile(r"[^\W\d_]+")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
_ALIKE: dict[str, dict[str, str]] = {}
for _a, _s, _b in lookalikes():
    _ALIKE.setdefault(_a, {})[_s] = _b
_HOLE_SURE = regex.compile(r"\p{Ll}\?\p{Ll}|\p{Lu}\?\p{L}")
#: A question mark where a letter belongs: before or inside a word.
_HOLE = re.compile(r"(?<![^\W_])\?{2,}|\?(?=[^\W\d_]|\?+[^\W\d_])")


@functools.lru_cache(maxsize=1 << 16)
def _script(ch: str) -> str:
    """The script of a letter, with those of Japanese as one."""
    first = unicodedata.name(ch, "").split(" ")[0]
    return "CJK" if first in ("HIRAGANA", "KATAKANA", "KATAKANA-HIRAGANA", "HALFWIDTH", "IDEOGRAPHIC") else first


@functools.lru_cache(maxsize=None)
def _bytes_of(read: str) -> dict[str, bytes]:
    """The byte of each character of a one-byte encoding; bytes without a character are read as control codes."""
    out = {}
    for b in range(256):
        raw = bytes([b])
        try:
            out[raw.decode(read)] = raw
        except UnicodeDecodeError:
            out.setdefault(chr(b), raw)
    return out


def _unread(text: str, read: str) -> bytes | None:
    if read in ("cp932", "gbk"):
        try:
            return text.encode(read)
        except UnicodeEncodeError:
            return None
    table = _bytes_of(read)
    try:
        return b"".join([table[c] for c in text])
    except KeyError:
        return None


def undo(text: str, written: str, read: str) -> str | None:
    """The text whose bytes in ``written`` give ``text`` when read as ``read``; None if there is none."""
    raw = _unread(text, read)
    return None if raw is None else _decoded(text, raw, written)


def _decoded(text: str, raw: bytes, written: str) -> str | None:
    try:
        back = raw.decode(written)
    except UnicodeDecodeError:
        return None
    return back if back != text else None


def _sound(text: str) -> bool:
    """Whether a text can be an original: no control codes, no word in letters of several scripts."""
    if _CONTROL.search(text):
        return False
    return all(len({_script(c) for c in w}) < 2 for w in _WORD.findall(text) if not w.isascii())


def unmixed(text: str) -> str:
    """The text without invisible characters, odd forms, and look-alike letters within words (problem 5)."""
    text = unicodedata.normalize("NFKC", "".join(c for c in text if unicodedata.category(c) != "Cf"))

    def one_script(m: re.Match) -> str:
        kinds = Counter(_script(c) for c in m[0])
        if len(kinds) < 2:
            return m[0]
        strong = Counter(_script(c) for c in m[0] if c not in _ALIKE)
        main = max(kinds, key=lambda k: (strong[k], kinds[k], k))
        return "".join(c if _script(c) == main else _ALIKE.get(c, {}).get(main, c) for c in m[0])

    return _WORD.sub(one_script, text)


def undo_lossy(text: str, read: str) -> str | None:
    """UTF-8 read as ``read`` where some characters were lost or became plain spaces; U+FFFD stands for what is gone."""
    raw = _unread(text.replace(LOST, "?"), read)
    if raw is None:
        return None
    try:
        return re.sub(rb"([\xc3\xc5\xc4]) ", lambda m: m[1] + b"\xa0", raw).decode()
    except UnicodeDecodeError:
        pass
    back = raw.decode("utf-8", "replace")
    # what was read back must outweigh what was lost
    gained = sum(c > "\x7f" and c != LOST for c in back)
    return back if 0 < gained >= back.count(LOST) and len(back) < len(text) else None


def chains(value: str) -> list[tuple[str, str]]:
    """(chain, original) of every way to have got ``value``; the first is ('', value) unless it can't be an original.

    Lost characters are U+FFFD. The chain 'alike' is no wrong decoding: the value with look-alikes undone.
    """
    ways = {value: ""}
    if not value.isascii():
        seen = {value}
        edge = [(value, "")]
        for _ in range(DEPTH):
            reached = []
            for text, chain in edge:
                if text.isascii():
                    continue
                tried: dict[bytes, set[str]] = {}  # encodings that agree on these characters give the same bytes
                unsound: set[str] = set()
                for read in READ:
                    if (raw := _unread(text, read)) is None:
                        continue
                    done = tried.setdefault(raw, set())
                    for written in WRITTEN:
                        if written == read or written in done:
                            continue
                        done.add(written)
                        utf = written == "utf-8"
                        if (back := _decoded(text, raw, written)) is None or back in seen or back in unsound and not utf:
                            continue
                        sound = _sound(back)
                        if not sound:
                            unsound.add(back)
                        if utf or sound:
                            seen.add(back)
                            name = f"{written}>{read}" + (f" {chain}" if chain else "")
                            if utf:
                                reached.append((back, name))
                            if sound:
                                ways[back] = name
            edge = reached
        if not any(c.startswith("utf-8") for c in ways.values()):
            for read in ONE_BYTE:
                if (back := undo_lossy(value, read)) is not None and back not in ways:
                    ways[back] = f"utf-8>{read} lossy"
        ways.setdefault(unmixed(value), "alike")
    if LOST in value:  # no text has this of its own
        ways[value] = "lost"
    elif _HOLE.search(value):
        ways.setdefault(_HOLE.sub(lambda m: LOST * len(m[0]), value), "lost")
        if _HOLE_SURE.search(value):
            del ways[value]
    return [(chain, text) for text, chain in ways.items()]


# The character model.

N_CLASSES = 64
_SCRIPTS = ("LATIN", "GREEK", "CYRILLIC", "HIRAGANA", "KATAKANA", "CJK", "HANGUL", "ARABIC", "HEBREW", "THAI")
_OTHERS = ("Zs", "Nd", "Po", "Pd", "Ps", "Pe", "Pi", "Pf", "Cc", "Sc", "So", "Sm", "No", "Cf")
_LOST_CP, _ACCENTED = ord(LOST), 3
#: Kinds of counts: class pair and what it continues, character of a class and the class, bigram and what it continues, trigram and what it continues.
KINDS = 8


@functools.lru_cache(maxsize=1 << 17)
def _kind(cp: int) -> tuple[int, int]:
    """(class, case-folded code point) of a character. A lost letter counts as an accented one; 0 is the ends of a text."""
    ch = chr(cp)
    if ch == LOST:
        return _ACCENTED, cp
    cat = unicodedata.category(ch)
    low = ch.lower()
    fold = ord(low) if len(low) == 1 else cp
    if cat[0] in "LM":
        first = unicodedata.name(ch, "").split(" ")[0]
        script = _SCRIPTS.index(first) if first in _SCRIPTS else len(_SCRIPTS)
        return 2 + 4 * script + 2 * (cat in ("Lu", "Lt")) + (cp > 127 and script <= 2), fold
    k = _OTHERS.index(cat) if cat in _OTHERS else len(_OTHERS)
    ordinary = cp < 128 or cat in ("Pd", "Pi", "Pf")
    return 46 + (k if ordinary else 16 if cat == "Cc" else 17 if cat in ("So", "Sm", "Sc", "No") else 15), fold


def _hash(*parts: np.ndarray | int) -> np.ndarray:
    h = np.zeros(max(np.size(p) for p in parts), np.uint64)
    for p in parts:
        h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return (h % np.uint64(SLOTS)).astype(np.int64)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each character of the texts and each end: its slot of each kind, its text, whether it and its history are lost."""
    joined = "".join("\0\0" + t.replace("\0", " ") + "\0" for t in texts)
    seen, at = np.unique(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
    kinds = np.array([_kind(int(c)) if c else (0, 0) for c in seen], np.int64).reshape(-1, 2)
    k, f = kinds[at, 0], kinds[at, 1]
    owner = np.repeat(np.arange(len(texts)), [len(t) + 3 for t in texts])
    n = np.flatnonzero(owner[2:] == owner[:-2]) + 2
    k1, k0, f2, f1, f0 = k[n - 1], k[n], f[n - 2], f[n - 1], f[n]
    slots = np.stack([_hash(1, k1, k0), _hash(2, k1), _hash(3, k0, f0), _hash(4, k0), _hash(5, f1, f0), _hash(6, f1), _hash(7, f2, f1, f0), _hash(8, f2, f1)])
    return slots, owner[n], f0 == _LOST_CP, (f1 == _LOST_CP) | (f2 == _LOST_CP)


def scores(texts: list[str], counts: np.ndarray, first: bool = False) -> np.ndarray:
    """Log probability of each text by ``counts`` of shape (KINDS, SLOTS); ``first``: by character classes alone."""
    if not texts:
        return np.empty(0)
    slots, owner, lost, after_lost = grams(texts)
    c = [counts[i][slots[i]] for i in range(KINDS)]
    of_class = (c[0] + 0.02) / (c[1] + 0.02 * N_CLASSES)
    base = of_class * (c[2] + 0.5) / (c[3] + 30.0)
    if first:
        return np.bincount(owner, np.log(np.where(lost, of_class, base)), len(texts))
    two = (c[4] + 4.0 * base) / (c[5] + 4.0)
    three = (c[6] + 3.0 * two) / (c[7] + 3.0)
    return np.bincount(owner, np.log(np.where(lost, of_class, np.where(after_lost, base, three))), len(texts))


# The table.

_COUNTED = pa.schema([("slot", pa.int64()), ("pool", pa.int32()), ("chain", pa.string()), ("weight", pa.float64())])
_JUDGED = pa.schema([("value", pa.string()), ("pool", pa.int32()), ("chain", pa.string()), ("original", pa.string()), ("posterior", pa.float64())])


class Model:
    """Shares of the chains by pool, and the n-gram counts."""

    def __init__(self) -> None:
        self.counts = np.zeros((KINDS, SLOTS), np.float32)
        self.pools: dict[tuple[int, str], float] = {}
        self.size: dict[int, float] = {}
        self.chains: dict[str, float] = {}
        self.first = self.begins = False

    def __getstate__(self) -> dict:
        """Few of the counts are there: what goes to the workers, in each round, is small."""
        at = np.flatnonzero(self.counts).astype(np.int32)
        packed = zlib.compress(np.diff(at, prepend=0).astype(np.int32).tobytes() + self.counts.reshape(-1)[at].tobytes(), 1)
        return self.__dict__ | {"counts": packed}

    def __setstate__(self, state: dict) -> None:
        raw = zlib.decompress(state["counts"])
        n = len(raw) // 8
        counts = np.zeros(KINDS * SLOTS, np.float32)
        counts[np.cumsum(np.frombuffer(raw, np.int32, n))] = np.frombuffer(raw, np.float32, n, 4 * n)
        self.__dict__ = state | {"counts": counts.reshape(KINDS, SLOTS)}

    def add(self, rows: pa.Table) -> Model:
        slot, pool, chain, weight = (rows.column(c) for c in _COUNTED.names)
        at = np.flatnonzero(slot.to_numpy() >= 0)
        w = weight.to_numpy()
        np.add.at(self.counts.reshape(-1), slot.to_numpy()[at], w[at].astype(np.float32))
        for p, c, x in zip(pool.to_pylist(), chain.to_pylist(), w.tolist()):
            if c is not None:
                self.pools[p, c] = self.pools.get((p, c), 0.0) + x
                self.size[p] = self.size.get(p, 0.0) + x
                self.chains[c] = self.chains.get(c, 0.0) + x
        return self

    def share(self, pool: int, chain: str) -> float:
        if self.begins:
            return 0.95 if chain == "" else BEGIN[chain.count(">") > 1]
        whole = max(FLOOR, self.chains.get(chain, 0.0) / max(1.0, sum(self.size.values())))
        return (self.pools.get((pool, chain), 0.0) + PRIOR * whole) / (self.size.get(pool, 0.0) + PRIOR)


def _counted(texts: list[str], weights: np.ndarray, pools: dict[tuple[int, str], float]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(KINDS * SLOTS)
    step = 4096
    for lo in range(0, len(texts), step):
        slots, owner, lost, after_lost = grams(texts[lo : lo + step])
        w = np.where(lost | after_lost, 0.0, weights[lo : lo + step][owner])
        for i in range(KINDS):
            total[i * SLOTS : (i + 1) * SLOTS] += np.bincount(slots[i], w, SLOTS)
    at = np.flatnonzero(total)
    none = pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(at), *none, pa.array(total[at])], schema=_COUNTED)
    keys = list(pools)
    yield pa.RecordBatch.from_arrays([pa.array([-1] * len(keys), pa.int64()), pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.string()), pa.array([pools[k] for k in keys], pa.float64())], schema=_COUNTED)


def _guess(ways: list[str]) -> np.ndarray:
    """Weights to begin with. Bytes of another encoding hardly ever make valid UTF-8 by chance: such a chain is believed."""
    steps = [i for i, c in enumerate(ways) if c.startswith("utf-8")]
    likely = [i for i in steps if ways[i].count(">") == min(ways[k].count(">") for k in steps)] or [i for i, c in enumerate(ways) if c == "lost"] or [0]
    x = np.zeros(len(ways))
    x[likely] = 1.0 / len(likely)
    return x


def _posteriors(batch: pa.RecordBatch, model: Model | None) -> Iterator[tuple[int, list[tuple[str, str]], np.ndarray]]:
    """(pool, ways, posterior of each way) of each value and each of its pools; first guesses without a model."""
    ways = [list(zip(c, t)) for c, t in zip(batch.column("chains").to_pylist(), batch.column("originals").to_pylist())]
    like = scores([t for w in ways for _, t in w], model.counts, model.first) if model else None
    shares: dict[tuple[int, str], float] = {}
    k = 0
    for of, w in zip(batch.column("pools").to_pylist(), ways):
        if model is None:
            guess = _guess([c for c, _ in w])
            yield from ((pool, w, guess) for pool in of)
            continue
        here = like[k : k + len(w)]
        k += len(w)
        for pool in of:
            prior = np.array([shares[pool, c] if (pool, c) in shares else shares.setdefault((pool, c), model.share(pool, c)) for c, _ in w])
            x = here + np.log(prior)
            x = np.exp(x - x.max())
            yield pool, w, x / x.sum()


def _expect(model: Model | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Expected counts of a round; without a model, every value counts as its own original."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[str] = []
        weights: list[float] = []
        pools: dict[tuple[int, str], float] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                for pool, ways, post in _posteriors(part, model):
                    for (chain, text), x in zip(ways, post.tolist()):
                        if x > 1e-3:
                            pools[pool, chain] = pools.get((pool, chain), 0.0) + x
                            texts.append(text)
                            weights.append(x)
            if len(texts) > 20000:
                yield from _counted(texts, np.array(weights), pools)
                texts, weights, pools = [], [], {}
        yield from _counted(texts, np.array(weights), pools)

    return run


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 1024):
            part = batch.slice(lo, 1024)
            ways = [chains(v) for v in part.column("value").to_pylist()]
            lists = [pa.array([[w[i] for w in x] for x in ways], pa.list_(pa.string())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([part.column("value"), part.column("pools"), *lists], ["value", "pools", "chains", "originals"])


def _likely(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The ways that any pool gives a posterior of ``UNLIKELY`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                each = _posteriors(part, model)
                kept = []
                for of in part.column("pools").to_pylist():
                    some = [next(each) for _ in of]
                    most = np.max([post for _, _, post in some], axis=0)
                    kept.append([w for w, x in zip(some[0][1], most) if x >= UNLIKELY])
                lists = [pa.array([[w[i] for w in x] for x in kept], pa.list_(pa.string())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("value"), part.column("pools"), *lists], ["value", "pools", "chains", "originals"])

    return run


def _judge(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part, rows = batch.slice(lo, 1024), []
                values = [v for v, of in zip(part.column("value").to_pylist(), part.column("pools").to_pylist()) for _ in of]
                for value, (pool, ways, post) in zip(values, _posteriors(part, model)):
                    wrong = [i for i, (c, _) in enumerate(ways) if c not in ("", "alike")]
                    if (garbled := float(post[wrong].sum())) > 0.5:
                        chain, text = ways[max(wrong, key=lambda i: (post[i], -ways[i][0].count(">"), -i))]
                        rows.append((value, pool, chain, None if LOST in text or chain == "lost" or chain.endswith("lossy") else text, garbled))
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 5, _JUDGED)], schema=_JUDGED)

    return run


def repaired(tracks: DataFrame, fields: tuple[str, ...] = FIELDS, rounds: int = ROUNDS) -> DataFrame:
    """track_id, field_name, value, chain, repaired (null if lost) and posterior of each garbled cell."""
    source = F.col("tag_source") if "tag_source" in tracks.columns else F.lit(None).cast("string")
    every = cells(tracks.withColumn("tag_source", source), fields).withColumn("pool", F.pmod(F.hash("tag_source", "field_name"), F.lit(POOLS)))
    values = every.groupBy("value").agg(F.collect_set("pool").alias("pools"))
    ways_schema = "value string, pools array<int>, chains array<string>, originals array<string>"
    ways = cut(spread(values).mapInArrow(_ways, ways_schema))
    schema = "slot bigint, pool int, chain string, weight double"

    def total(df: DataFrame, model: Model | None) -> pa.Table:
        return df.mapInArrow(_expect(model), schema).groupBy("slot", "pool", "chain").agg(F.sum("weight").alias("weight")).toArrow()

    certain, open_ = ways.filter("size(chains) = 1"), ways.filter("size(chains) > 1")
    fixed = total(certain, None)
    model = Model().add(fixed).add(total(open_, None))
    model.begins = True
    for k in range(FIRST_ROUNDS + rounds):
        model.first = k < FIRST_ROUNDS
        if k == 1:
            open_ = cut(open_.mapInArrow(_likely(model), ways_schema))
        model = Model().add(fixed).add(total(open_, model))
    verdicts = open_.union(certain.filter("chains[0] <> ''")).mapInArrow(_judge(model), "value string, pool int, chain string, original string, posterior double")
    return every.join(verdicts, ["value", "pool"]).select("track_id", "field_name", "value", "chain", F.col("original").alias("repaired"), "posterior")


def found(tracks: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    return repaired(tracks, fields).select("track_id", "field_name").distinct()
