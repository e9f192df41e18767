"""Schemas that drift between the files of a feed, and one consistent table of all records (problem 3).

The schema of a file is a tree: its frames, the type of each frame's values below it, and the fields of objects below
that. The script from one file of a feed to the next is the cheapest set of edits between their trees: adding or
deleting a subtree costs its nodes, a field of the same name is kept and its subtree compared, a rename costs what the
content of the two frames disagrees for the tracks that both files share (and is out of the question below ``AGREE``),
a new type costs half a node. Children have no order, so the distance of two nodes is a minimum-cost matching of their
children; a field that leaves one place and comes with the same values at another is moved. Scripts are compiled into
one projection for each file, from its frame ids to lasting ones, which gives the consistent table.

Every row goes to the comparison of its file with the one before and with the one after, so a task holds two files,
however many files a feed has. Rows without a feed or batch_no belong to no file. A payload that isn't a JSON object
has no frames. A frame without non-null values has no type; where two types are equally common, the earlier file's
type stands if it is one of them. Repeated rows count once. Keys are case-sensitive.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Least share of compared tracks with the same content in a renamed frame.
AGREE = 0.8
NODE, RETYPE, NEVER = 1.0, 0.5, 1e6
_EDITS = pa.schema([("feed_id", pa.string()), ("batch_no", pa.int32()), ("change_kind", pa.string()), ("frame_id", pa.string()), ("new_frame_id", pa.string()), ("old_type", pa.string()), ("new_type", pa.string()), ("depth", pa.int32())])
_EDITS_SQL = "feed_id string, batch_no int, change_kind string, frame_id string, new_frame_id string, old_type string, new_type string, depth int"


class Node:
    """A frame or a field of an object: its values by track, how often each type occurs, and its fields."""

    def __init__(self) -> None:
        self.values: dict[int, set[str]] = defaultdict(set)
        self.types: Counter[str] = Counter()
        self.fields: dict[str, Node] = {}

    def add(self, track: int | None, value: object) -> None:
        if value is None:
            return
        self.types[type_of(value)] += 1
        if track is not None:
            self.values[track].add(as_text(value))
        if isinstance(value, dict):
            self.grow(track, value)

    def grow(self, track: int | None, record: dict) -> None:
        for name, value in record.items():
            self.fields.setdefault(name, Node()).add(track, value)

    def size(self) -> float:
        return NODE + sum(f.size() for f in self.fields.values())

    def common(self) -> set[str]:
        return {t for t, n in self.types.items() if n == max(self.types.values())}


def type_of(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    return {str: "text", int: "number", float: "number", list: "list", dict: "object"}[type(value)]


def as_text(value: object) -> str:
    """One form for the same content of different types."""
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float) and value.is_integer():
        return str(int(value))
    if isinstance(value, list):
        return "/".join(as_text(x) for x in value)
    if isinstance(value, dict):
        return as_text(value["text"]) if "text" in value else json.dumps(value, sort_keys=True, ensure_ascii=False)
    return {"true": "1", "false": "0"}.get(str(value).lower(), str(value))


def matching(cost: list[list[float]]) -> list[int]:
    """The column of each row in a minimum-cost matching of a square matrix (shortest augmenting paths)."""
    n = len(cost)
    rows, cols = [0.0] * (n + 1), [0.0] * (n + 1)
    of = [0] * (n + 1)
    for i in range(1, n + 1):
        of[0], j = i, 0
        low, way, done = [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while True:
            done[j] = True
            at, step, to = of[j], float("inf"), 0
            for c in range(1, n + 1):
                if not done[c]:
                    x = cost[at - 1][c - 1] - rows[at] - cols[c]
                    if x < low[c]:
                        low[c], way[c] = x, j
                    if low[c] < step:
                        step, to = low[c], c
            for c in range(n + 1):
                if done[c]:
                    rows[of[c]] += step
                    cols[c] -= step
                else:
                    low[c] -= step
            j = to
            if not of[j]:
                break
        while j:
            of[j], j = of[way[j]], way[j]
    out = [0] * n
    for c in range(1, n + 1):
        out[of[c] - 1] = c - 1
    return out


def agreement(a: Node, b: Node) -> tuple[int, int]:
    """How many tracks with values in both have a value in common, and how many there are."""
    both = a.values.keys() & b.values.keys()
    return sum(bool(a.values[t] & b.values[t]) for t in both), len(both)


#: kind, path, new path, old type, new type
Edit = tuple[str, tuple[str, ...], tuple[str, ...], str, str]


def edits(a: Node, b: Node, was_at: tuple[str, ...] = (), path: tuple[str, ...] = ()) -> tuple[float, list[Edit]]:
    """The cost and the steps (kind, path, new path, old type, new type) of the cheapest script from ``a`` to ``b``.

    What leaves has its path in the old tree, everything else in the new one, where a parent may have another name.
    """
    cost, steps = 0.0, []
    for name in sorted(a.fields.keys() & b.fields.keys()):
        x, y = a.fields[name], b.fields[name]
        was, now = x.common(), y.common()
        if was and now and not was & now:
            cost += RETYPE
            steps.append(("retyped", (*path, name), (), min(was), min(now)))
        below, inner = edits(x, y, (*was_at, name), (*path, name))
        cost += below
        steps += inner
    left, came = sorted(a.fields.keys() - b.fields.keys()), sorted(b.fields.keys() - a.fields.keys())
    n = len(left) + len(came)
    table = [[0.0] * n for _ in range(n)]
    scripts: dict[tuple[int, int], list[Edit]] = {}
    for i, old in enumerate(left):
        for j, new in enumerate(came):
            x, y = a.fields[old], b.fields[new]
            same, of = agreement(x, y)
            table[i][j] = NEVER
            if same and same >= AGREE * of:
                below, scripts[i, j] = edits(x, y, (*was_at, old), (*path, new))
                # of two equally good partners, the one with more tracks behind it
                table[i][j] = NODE * (1 - same / of) + below * 1e-3 + 1e-3 / (1 + same)
        for j in range(len(came), n):
            table[i][j] = a.fields[old].size() if j == len(came) + i else NEVER
    for i in range(len(left), n):
        for j, new in enumerate(came):
            table[i][j] = b.fields[new].size() if i == len(left) + j else NEVER
    to = matching(table) if n else []
    partners = {i: to[i] for i in range(len(left)) if to[i] < len(came)}
    cost += sum(table[i][to[i]] for i in range(n))
    for i, old in enumerate(left):
        if i in partners:
            steps.append(("renamed", (*was_at, old), (*path, came[partners[i]]), "", ""))
            steps += scripts[i, partners[i]]
        else:
            steps.append(("removed", (*was_at, old), (), "", ""))
    steps += [("added", (*path, new), (), "", "") for j, new in enumerate(came) if j not in partners.values()]
    return cost, steps


def _at(root: Node, path: tuple[str, ...]) -> Node:
    for name in path:
        root = root.fields[name]
    return root


def moves(a: Node, b: Node, steps: list[Edit]) -> list[Edit]:
    """Pairs of a field that left one object and one that came, with the same values, in another object."""
    out = []
    for _, old, *_ in [s for s in steps if s[0] == "removed"]:
        for _, new, *_ in [s for s in steps if s[0] == "added"]:
            if old[:-1] != new[:-1]:
                same, of = agreement(_at(a, old), _at(b, new))
                if same and same >= AGREE * of:
                    out.append(("moved", old, new, "", ""))
    return out


def script(a: Node, b: Node) -> list[Edit]:
    steps = edits(a, b)[1]
    return steps + moves(a, b, steps)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at: tuple | None = None
    trees = (Node(), Node())
    seen: set[tuple] = set()
    out: list[tuple] = []

    def close() -> None:
        if at is not None:
            out.extend((*at, kind, "/".join(old), "/".join(new), was, now, len(old) - 1) for kind, old, new, was, now in script(*trees))

    def table() -> pa.RecordBatch:
        cols = list(zip(*out))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _EDITS)], schema=_EDITS)

    for batch in batches:
        for f, n, later, track, payload in zip(*(batch.column(c).to_pylist() for c in ("feed_id", "pair_no", "later", "track_ref", "payload"))):
            if (f, n) != at:
                close()
                at, trees = (f, n), (Node(), Node())
                seen.clear()
            if payload is None or (later, track, payload) in seen:
                continue
            seen.add((later, track, payload))
            try:
                record = json.loads(payload)
            except ValueError:
                continue
            if isinstance(record, dict):
                trees[later].grow(track, record)
        if out:
            yield table()
            out.clear()
    close()
    if out:
        yield table()


def _rows(dumps: DataFrame) -> DataFrame:
    return dumps.select("feed_id", F.col("batch_no").cast("int").alias("batch_no"), "track_ref", "payload").filter("feed_id is not null and batch_no is not null")


def scripts(dumps: DataFrame) -> DataFrame:
    """Every step of every script: feed_id, batch_no, change_kind, frame_id, new_frame_id, old_type, new_type, depth.

    Fields within objects have a depth of 1 or more and paths with slashes.
    """
    rows = _rows(dumps)
    files = rows.select("feed_id", "batch_no").distinct()
    near = files.withColumn("next_no", F.lead("batch_no").over(Window.partitionBy("feed_id").orderBy("batch_no"))).withColumn("first", F.row_number().over(Window.partitionBy("feed_id").orderBy("batch_no")) == 1)
    known = rows.join(near, ["feed_id", "batch_no"])
    as_later = known.filter("not first").select("feed_id", F.col("batch_no").alias("pair_no"), F.lit(1).alias("later"), "track_ref", "payload")
    as_earlier = known.filter("next_no is not null").select("feed_id", F.col("next_no").alias("pair_no"), F.lit(0).alias("later"), "track_ref", "payload")
    pairs = as_later.union(as_earlier).repartition("feed_id", "pair_no").sortWithinPartitions("feed_id", "pair_no")
    return pairs.mapInArrow(_compare, _EDITS_SQL)


def changes(dumps: DataFrame) -> DataFrame:
    """feed_id, batch_no, change_kind, frame_id and new_frame_id of the changes of whole frames."""
    whole = F.col("change_kind").isin("renamed", "removed", "added", "retyped") & (F.col("depth") == 0)
    return scripts(dumps).filter(whole).select("feed_id", "batch_no", "change_kind", "frame_id", "new_frame_id")


def _compile(renames: pa.Table) -> pa.Table:
    """The lasting name of each frame of a feed that was renamed, and the last file in which the old name holds."""
    feed = renames.column("feed_id")[0].as_py()
    steps = sorted(zip(renames.column("batch_no").to_pylist(), renames.column("frame_id").to_pylist(), renames.column("new_frame_id").to_pylist()))
    out = []
    taken: dict[str, tuple] = {}
    for k in range(len(steps) - 1, -1, -1):
        n, old, new = steps[k]
        after = next((x for x in reversed(out) if x[1] == new and x[2] > n), None)  # what the new name becomes later
        lasting = after[3] if after else new
        line = (lasting, after[4] if after else n)
        if taken.setdefault(lasting, line) != line:
            lasting = f"{lasting}#{n}"
        out.append((feed, old, n, lasting, line[1]))
    names = ("feed_id", "frame_id", "before_no", "lasting")
    return pa.table({c: [r[i] for r in out] for i, c in enumerate(names)}, schema=pa.schema([("feed_id", pa.string()), ("frame_id", pa.string()), ("before_no", pa.int32()), ("lasting", pa.string())]))


def projections(dumps: DataFrame) -> DataFrame:
    """feed_id, batch_no and names (map from frame_id to its lasting id) of the files in which any frame has another name later."""
    renamed = changes(dumps).filter("change_kind = 'renamed'")
    compiled = renamed.groupBy("feed_id").applyInArrow(_compile, "feed_id string, frame_id string, before_no int, lasting string")
    files = _rows(dumps).select("feed_id", "batch_no").distinct()
    # the next rename of a name after the file is the one that counts
    ahead = files.join(compiled, "feed_id").filter("batch_no < before_no").groupBy("feed_id", "batch_no", "frame_id").agg(F.min_by("lasting", "before_no").alias("lasting"))
    return ahead.groupBy("feed_id", "batch_no").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("frame_id", "lasting")))).alias("names"))


def consistent(dumps: DataFrame) -> DataFrame:
    """feed_id, batch_no, track_ref and frames (map from lasting frame id to the value as text) of every distinct record.

    A record whose payload is no JSON object has null frames. If two frames of a record last under one id, the value of
    the frame that has the lasting name itself stands.
    """
    rows = dumps.select("feed_id", F.col("batch_no").cast("int").alias("batch_no"), "track_ref", "payload").distinct()
    frames = F.from_json("payload", "map<string,string>")
    told = rows.join(projections(dumps), ["feed_id", "batch_no"], "left").withColumn("frames", frames)
    lasting = F.transform(F.map_entries("frames"), lambda e: F.struct(F.coalesce(F.try_element_at("names", e["key"]), e["key"]).alias("key"), e["value"].alias("value"), e["key"].alias("was")))
    told = told.withColumn("e", lasting)
    one = F.filter("e", lambda x, i: (x["key"] == x["was"]) | (~F.exists("e", lambda y: (y["key"] == x["key"]) & ((y["was"] == y["key"]) | (y["was"] < x["was"])))))
    return told.select("feed_id", "batch_no", "track_ref", F.map_from_entries(F.transform(one, lambda x: F.struct(x["key"].alias("key"), x["value"].alias("value")))).alias("frames"))
