"""From candidate table keys to verified links and components, shared by the MinHash operators.

Documents with the same shingle set are one class, named by a 128-bit hash of
the set and numbered. Classes that share a table key are candidates. A key's
classes form a star around a centre: each map task does so for its own classes
and sends one centre per key on, so a hot key reaches the shuffle as one row a
task. Star edges are verified on the full sets and contracted to components. A
key whose classes are not yet one component is finished exactly: its classes
are compared across components, in blocks of ``BLOCK``, inside tasks, and the
few pairs that may reach the threshold are verified. No pair list of a group
is ever written, and nothing is capped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from revlens.llm.frames import stored, tidy

BLOCK = 1024
PAIR = "a long, b long"
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_ROW = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])
#: classes whose keys a map task groups at a time
TASK_CLASSES = 8_000


def _rows(key, a, b) -> Iterator[pa.RecordBatch]:
    """Rows (key, a, b) in batches; None stands for a null column."""
    n = len(a)
    for lo in range(0, n, 200_000):
        cut = lambda x: pa.nulls(min(n, lo + 200_000) - lo, pa.int64()) if x is None else pa.array(x[lo:lo + 200_000])
        yield pa.RecordBatch.from_arrays([cut(key), cut(a), cut(b)], schema=_ROW)


def _edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.ones(len(a), dtype=bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep]


def _stars(keys: np.ndarray, who: np.ndarray):
    """Sorted by key: keys, members, their key's smallest member, first rows, and whether the key has two members."""
    order = np.lexsort((who, keys))
    k, w = keys[order], who[order]
    first = np.ones(len(k), dtype=bool)
    first[1:] = k[1:] != k[:-1]
    group = np.cumsum(first) - 1
    centre = w[first][group] if len(k) else w
    shared = np.bincount(group, minlength=1)[group] > 1 if len(k) else first
    return k, w, centre, first, shared


def shared_keys(classes: DataFrame, keys_of: Callable[[np.ndarray], np.ndarray], width: int) -> DataFrame:
    """Star edges (null, a, b) and memberships (key, a, null) of the keys that two classes or more of ``classes`` (cid, mh) have."""
    @tidy
    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges to the task's own centre of each key, its members, and the centre for the shuffle (key, a, a)."""
        ids: list[np.ndarray] = []
        mh: list[bytes] = []

        def flush():
            who = np.concatenate(ids)
            keys = keys_of(np.frombuffer(b"".join(mh), dtype=np.uint32).reshape(-1, width))
            k, w, centre, first, shared = _stars(keys.reshape(-1).view(np.int64), np.repeat(who, keys.shape[1]))
            away = w != centre
            yield from _rows(None, *_edges(w[away], centre[away]))
            yield from _rows(k[shared & away], w[shared & away], None)
            yield from _rows(k[first], w[first], w[first])

        for batch in batches:
            if batch.num_rows:
                ids.append(batch.column("cid").to_numpy())
                mh += batch.column("mh").to_pylist()
            if len(mh) >= TASK_CLASSES:
                yield from flush()
                ids, mh = [], []
        if mh:
            yield from flush()

    @tidy
    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, alone = [], [], []
        for batch in batches:
            key, a, b = (batch.column(i) for i in range(3))
            centre = pa.compute.fill_null(pa.compute.equal(a, b), False)
            centre = pa.compute.and_(centre, pa.compute.is_valid(key))
            rest = batch.filter(pa.compute.invert(centre))
            yield rest
            member = rest.filter(pa.compute.is_valid(rest.column("key")))
            alone.append(member.column("key").to_numpy())
            got = batch.filter(centre)
            keys.append(got.column("key").to_numpy())
            ids.append(got.column("a").to_numpy())
        if keys:
            k, w, centre, _, shared = _stars(np.concatenate(keys), np.concatenate(ids))
            away = w != centre
            yield from _rows(None, *_edges(w[away], centre[away]))
            # a centre is a member where another task has the key, or its own task had members
            shared |= np.isin(k, np.unique(np.concatenate(alone)))
            yield from _rows(k[shared], w[shared], None)

    row = f"key long, {PAIR}"
    both = classes.select("cid", "mh").mapInArrow(local, row)
    # what has a key goes to its key, a finished edge anywhere
    return both.repartition(F.coalesce("key", F.xxhash64("a", "b"))).mapInArrow(across, row)


def may_link(pairs: DataFrame, classes: DataFrame, share: float, least: float) -> DataFrame:
    """Pairs whose set sizes and MinHash values do not rule out the threshold."""
    c = classes.select("cid", "n", "mh")
    both = (pairs.join(c.toDF("a", "na", "ma"), "a").join(c.toDF("b", "nb", "mb"), "b")
            .where(F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(share)))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(m).to_pylist()), dtype=np.uint32).reshape(batch.num_rows, -1) for m in ("ma", "mb"))
                keep = pa.array((x == y).mean(axis=1) >= least)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], schema=_PAIR)
    return both.select("a", "b", "ma", "mb").mapInArrow(run, PAIR)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union on their full sets (``sets``: cid, shingles)."""
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                inter = int((y[at] == x).sum())
                keep.append(100 * inter >= percent * (len(x) + len(y) - inter))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], schema=_PAIR)
    return both.select("a", "b", "sa", "sb").mapInArrow(run, PAIR)


def components(links: DataFrame) -> DataFrame:
    """(cid, root) of all linked classes: large-star and small-star until nothing changes."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    while True:
        sides = edges.union(edges.select("v", "u")).toDF("u", "w")
        low = sides.groupBy("u").agg(F.min("w").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.where("w > u").join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")) \
            .select("e.u", "e.v").where("u != v").distinct()
        after = stored(small)
        same = after.join(edges, ["u", "v"], "left_anti").isEmpty() and after.count() == edges.count()
        edges = after
        if same:
            return edges.select(F.col("u").alias("cid"), F.col("v").alias("root"))


def short_set(x: np.ndarray) -> bytes:
    """The upper 16 bits of each shingle: enough to bound an intersection from above."""
    return (x >> np.uint64(48)).astype(np.uint16).tobytes()


def unfinished_pairs(members: DataFrame, classes: DataFrame, roots: DataFrame, short_of: Callable[[DataFrame], DataFrame],
                     groups_of: Callable[[np.ndarray], np.ndarray], width: int, percent: int, least: float) -> DataFrame:
    """Pairs of classes in different components that may reach the threshold.

    ``members``: (key, cid) of the shared keys. Keys with one component are
    dropped by an aggregate. The classes of the others are dealt by the fewer
    ``groups_of`` keys (a shared table key implies a shared group key) to block
    pairs. A task compares a pair under its first shared group key only: sizes,
    MinHash values, then an upper bound of the similarity from 16-bit shingles.
    Pairs at the threshold are returned; of several that clearly join the same
    two components in a task, one.
    """
    c = stored(classes.join(roots, "cid", "left").select("cid", "n", "mh", F.coalesce("root", "cid").alias("root")))
    rows = members.join(c.select("cid", "root"), "cid").select("key", "cid", "root")
    open_keys = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    some = rows.join(open_keys, "key").select("cid").distinct()

    @tidy
    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                g = groups_of(np.frombuffer(b"".join(batch.column("mh").to_pylist()), dtype=np.uint32).reshape(-1, width))
                at = pa.array(np.repeat(np.arange(batch.num_rows), g.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(g.reshape(-1).view(np.int64)), batch.column("cid").take(at), batch.column("root").take(at)],
                                                 names=["key", "cid", "root"])

    light = stored(c.join(some, "cid").select("cid", "root", "mh").mapInArrow(dealt, "key long, cid long, root long"))
    several = light.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo != hi").select("key", "n")
    side = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    spread = light.join(several, "key").select("key", "cid", side.alias("side"), F.pmod(F.xxhash64("cid"), side).cast("int").alias("block"))
    # block pairs (i, j), i <= j: a class of block i is in the pairs with every other block
    spread = spread.select("key", "cid", "block", F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("other"))
    spread = spread.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cid")
    full = spread.join(c.join(short_of(light.select("cid").distinct()), "cid"), "cid")

    def compare(table: pa.Table) -> pa.Table:
        key = table.column("key")[0].as_py()
        ids, root, n = (table.column(x).to_numpy() for x in ("cid", "root", "n"))
        mh = np.frombuffer(b"".join(table.column("mh").to_pylist()), dtype=np.uint32).reshape(-1, width)
        group = groups_of(mh).view(np.int64)
        here = (group == key).argmax(axis=1)
        short = [np.frombuffer(x, dtype=np.uint16) for x in table.column("short").to_pylist()]
        flat, at = np.concatenate(short), np.concatenate([[0], np.cumsum([len(x) for x in short])])
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.get(x, x) != x:
                x = parent[x]
            return x
        a, b = [], []
        for k in range(len(ids) - 1):
            r = slice(k + 1, None)
            may = (root[r] != root[k]) & (100 * np.minimum(n[r], n[k]) >= percent * np.maximum(n[r], n[k]))
            may &= (group[r] == group[k]).argmax(axis=1) == here[k]  # the pair's first shared group
            if not may.any():
                continue
            may &= (mh[r] == mh[k]).mean(axis=1) >= least
            if not may.any():
                continue
            mine = np.zeros(65536, dtype=np.uint8)
            mine[short[k]] = 1
            inter = np.minimum(np.add.reduceat(mine[flat[at[k + 1]:]], at[k + 1:-1] - at[k + 1], dtype=np.int64), n[k])
            for m in np.flatnonzero(may & (100 * inter >= percent * (n[r] + n[k] - inter))) + k + 1:
                one, two = find(int(root[k])), find(int(root[m]))
                if one != two:
                    a.append(min(ids[k], ids[m]))
                    b.append(max(ids[k], ids[m]))
                    sure = inter[m - k - 1] - (2 * n[k] * n[m] / 65536 + 4)  # less chance agreements of 16 bits
                    if 100 * sure >= percent * (n[k] + n[m] - sure):
                        parent[one] = two
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return full.select("key", "i", "j", "cid", "n", "mh", "root", "short").groupBy("key", "i", "j").applyInArrow(compare, PAIR).distinct()


def group(classes: DataFrame, sets_of: Callable[[DataFrame], DataFrame], short_of: Callable[[DataFrame], DataFrame],
          keys_of: Callable[[np.ndarray], np.ndarray], groups_of: Callable[[np.ndarray], np.ndarray], width: int, percent: int) -> DataFrame:
    """(cid, root) of every class that has a link, exact for all pairs that share a table key.

    ``classes``: (cid long, n, mh binary), one row a class, stored;
    ``sets_of(ids)``, ``short_of(ids)``: (cid, shingles) and (cid, short) of the
    classes in ``ids``; ``groups_of``: a few keys of a class such that classes
    with a table key in common have one of them in common.
    """
    share = percent / 100
    least = share - 0.35  # of 40 values or more: a pair at the threshold falls below this once in millions
    found = stored(shared_keys(classes, keys_of, width))
    edges = stored(may_link(found.where("key is null").select("a", "b").distinct(), classes, share, least))
    sets = stored(sets_of(edges.select(F.col("a").alias("cid")).union(edges.select("b")).distinct()))
    links = stored(verified(edges, sets, percent))
    roots = components(links)
    members = found.where("key is not null").select("key", F.col("a").alias("cid")).distinct()
    tried = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    more = stored(unfinished_pairs(members, classes, roots, short_of, groups_of, width, percent, least).join(tried, ["a", "b"], "left_anti"))
    if more.isEmpty():
        return roots
    others = more.select(F.col("a").alias("cid")).union(more.select("b")).distinct().join(sets, "cid", "left_anti")
    late = verified(more, sets.union(sets_of(others)), percent)
    return components(links.union(late))
