"""Token ids of whole corpora with a public byte-level BPE (problem 6).

Short texts are encoded in place, without a shuffle. A text longer than ``block_chars`` is cut into segments that
are encoded in parallel: between pretokens where it can be, and inside a pretoken (a long run without any split
point) where it must be. The pieces of one pretoken are joined pairwise as a tree. At a join, the tokens around it
are encoded again in a window that grows until the token before and the token after the window agree with it.

Why that is exact: a list of BPE tokens is the encoding of its bytes if, and only if, each neighbouring pair is the
encoding of its own two tokens. Pairs inside an encoded piece or window are right by construction, so only the two
pairs at the window's ends need a test.

Null and empty texts have the empty list of ids. Rows with the same doc_id are kept apart.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the split pattern of the tokenizer's description.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_CHARS = 65536



class Codec:
    """A rank file loaded into this process."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {v: k for k, v in ranks.items()}

    def encode(self, text: str) -> list[int]:
        return self.encoding.encode_ordinary(text)

    def array(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=())

    def piece(self, data: bytes) -> list[int]:
        """The ids of bytes that lie inside one pretoken."""
        return self.encoding._encode_single_piece(data) if data else []

    def pair(self, a: int, b: int) -> bool:
        return self.piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbouring parts of one pretoken, from the ids of each."""
        if not left or not right:
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.piece(b"".join(self.bytes_of[t] for t in left[len(left) - i :] + right[:j]))
            before = i == len(left) or self.pair(left[len(left) - i - 1], window[0])
            after = j == len(right) or self.pair(window[-1], right[j])
            if before and after:
                return left[: len(left) - i] + window + right[j:]
            i, j = i if before else 2 * i, j if after else 2 * j

    def tree(self, parts: list[list[int]]) -> list[int]:
        """Joins neighbours, then neighbours of the results, until one list is left."""
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []


@functools.lru_cache(maxsize=4)
def codec(path: str = TOKENIZER) -> Codec:
    return Codec(path)


def segments(text: str, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[int, bytes]]:
    """(run, bytes) in order: run is 0 for a part with whole pretokens, else the number of a pretoken of its own.

    A part may only end after a visible character: white space at its end could be split in another way there.
    """
    import regex

    start = safe = runs = 0
    since: list[tuple[int, int]] = []  # pretokens after the last safe place
    for m in regex.finditer(PATTERN, text):
        s, e = m.span()
        if s and not text[s - 1].isspace():
            safe, since = s, []
        if e - s > block_chars:
            if start < safe:
                yield 0, text[start:safe].encode()
            for a, b in since:
                runs += 1
                yield runs, text[a:b].encode()
            runs += 1
            data = text[s:e].encode()
            pieces = 1 << max(1, (len(data) // block_chars).bit_length())
            cuts = [len(data) * k // pieces for k in range(pieces + 1)]
            for a, b in zip(cuts, cuts[1:]):
                yield runs, data[a:b]
            start, safe, since = e, e, []
            continue
        if e - start > block_chars and safe > start:
            yield 0, text[start:safe].encode()
            start = safe
        since.append((s, e))
    if start < len(text):
        yield 0, text[start:].encode()


def _lists(ids: list) -> pa.Array:
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.concatenate([np.asarray(x, dtype=np.int32) for x in ids]) if ids else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def _short(path: str, count_only: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            rest = [batch.column(k) for k in range(batch.num_columns - 1)]
            names = batch.schema.names[:-1]
            for lo in range(0, max(1, batch.num_rows), 512):
                texts = batch.column(batch.num_columns - 1).slice(lo, 512).to_pylist()
                ids = [c.array(t) if t else () for t in texts]
                last = pa.array([len(x) for x in ids], pa.int64()) if count_only else _lists(ids)
                yield pa.RecordBatch.from_arrays([x.slice(lo, 512) for x in rest] + [last], [*names, "out"])

    return run


def _cut(block_chars: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                parts = list(segments(text, block_chars))
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(parts), pa.string()), pa.array(range(len(parts)), pa.int32()), pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], ["row", "seg", "run", "data"])

    return run


def _encode_segments(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            pairs = zip(batch.column("run").to_pylist(), batch.column("data").to_pylist())
            ids = [c.piece(d) if r else c.encode(d.decode()) for r, d in pairs]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("seg"), batch.column("run"), _lists(ids)], ["row", "seg", "run", "ids"])

    return run


def _concatenate(path: str) -> Callable:
    def run(table: pa.Table) -> pa.Table:
        c = codec(path)
        rows = sorted(zip(table.column("seg").to_pylist(), table.column("run").to_pylist(), table.column("ids").to_pylist()))
        out: list[int] = []
        k = 0
        while k < len(rows):
            e = k + 1
            while rows[k][1] and e < len(rows) and rows[e][1] == rows[k][1]:
                e += 1
            out += c.tree([r[2] for r in rows[k:e]])
            k = e
        return pa.table({"row": pa.array([table.column("row")[0].as_py()], pa.string()), "ids": _lists([out])})

    return run


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str = TOKENIZER, count_only: bool = False, block_chars: int = BLOCK_CHARS, keep: tuple[str, ...] = ()) -> DataFrame:
    """``key``, the ``keep`` columns and ``ids`` (array<int>), or ``n_tokens`` (bigint) with ``count_only``, for each row."""
    kind, name = ("bigint", "n_tokens") if count_only else ("array<int>", "ids")
    head = df.select(key, *keep)
    names = [f"k{i}" for i in range(1 + len(keep))]
    plain = df.select(*[F.col(c).alias(n) for c, n in zip((key, *keep), names)], F.col(text).alias("text"))
    fields = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, head.schema.fields))
    is_long = F.coalesce(F.length("text") > block_chars, F.lit(False))
    short = plain.filter(~is_long).mapInArrow(_short(path, count_only), f"{fields}, out {kind}")

    long = plain.filter(is_long)
    row = F.sha2(F.concat_ws("\0", *[F.coalesce(F.col(n).cast("string"), F.lit("\1")) for n in names], F.col("text")), 256)
    long = long.withColumn("row", row)
    heads = long.select("row", *names)  # repeated rows have one key; each of them gets its ids by the join
    once = long.select("row", "text").dropDuplicates(["row"])
    parts = once.mapInArrow(_cut(block_chars), "row string, seg int, run int, data binary").repartition("row", "seg")
    joined = parts.mapInArrow(_encode_segments(path), "row string, seg int, run int, ids array<int>").groupBy("row").applyInArrow(_concatenate(path), "row string, ids array<int>")
    long = heads.join(joined, "row").select(*names, (F.size("ids").cast("bigint") if count_only else F.col("ids")).alias("out"))
    return short.unionByName(long).toDF(key, *keep, name)


def _used(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of a task's texts by token: one row for each token of the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        size = max(c.bytes_of) + 1
        uses, docs = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for text in batch.column(0):
                if t := text.as_py():
                    ids, n = np.unique(c.array(t), return_counts=True)
                    uses[ids] += n
                    docs[ids] += 1
        at = np.flatnonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(uses[at]), pa.array(docs[at])], ["token_id", "occurrences", "documents"])

    return run


def vocabulary_use(df: DataFrame, text: str = "text", path: str = TOKENIZER, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Corpus statistics: occurrences and documents per token id. What is shuffled is a vocabulary for each task."""
    is_long = F.coalesce(F.length(text) > block_chars, F.lit(False))
    short = df.filter(~is_long).select(text).mapInArrow(_used(path), "token_id int, occurrences bigint, documents bigint")
    numbered = df.filter(is_long).select(F.monotonically_increasing_id().alias("n"), text)
    ids = encode(numbered, key="n", text=text, path=path, block_chars=block_chars)
    per = ids.select("n", F.explode("ids").alias("token_id")).groupBy("n", "token_id").agg(F.count("*").alias("occurrences"))
    every = short.unionByName(per.select("token_id", "occurrences", F.lit(1).cast("bigint").alias("documents")))
    return every.groupBy("token_id").agg(F.sum("occurrences").alias("occurrences"), F.sum("documents").alias("documents"))
