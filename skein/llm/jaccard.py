"""Exact Jaccard similarity join on word n-grams, as a join in a metric space.

The Jaccard distance d is a metric. A pair is a link if d <= eps = 1/4. Distances
between documents that have nothing in common are all 1, so that document pivots
can't divide a corpus; single shingles are its pivots first:

1. **Shingle pivots.** All sets order shingles alike, rare ones first. Two linked
   sets share one of the first ``n - ceil(3 n / 4) + 1`` shingles of either, so each
   shingle's region holds the sets that have it among these. Shingles of a fixed
   part of the hash space are counted exactly for that order, in packed blocks;
   a set most of whose shingles nobody else has is alone after this. Very frequent
   shingles come last in the order; they are found by bounded summaries, and a set
   that reaches them is tied to the smallest set of that shingle, without a group.
   Regions that overlap are joined: a pair of linked sets is within one region.
2. **Document pivots.** A region of up to ``REGION`` sets is joined in one task. A
   larger one gets pivots of its own members, in proportion to its size up to
   ``PIVOTS``. Each member is linked to every pivot within eps and goes to the
   Voronoi cell of its nearest pivot, and to each further cell whose window it is in:
   d(y, p) <= radius(p) + eps, by the triangle inequality. Cells are regions of their
   own, divided by pivots again until they fit a task. A cell whose members are all
   known to be of one class ends there, so that a group of copies needs few levels.
3. **Where windows don't divide.** Regions may have grown together by shingles that
   unlike documents share; all distances are near 1 then and every window holds. Such
   a region falls apart into the sets of each shingle again, equal ones once, each a
   region as above, but for those within a longer one. A set of documents that share a
   shingle, fill more than a task and are still all unlike is compared in blocks, each
   pair once, and so is a region that its shingles' lists would copy more often: long
   near copies share thousands of shingles, each with other members.

Sets of large regions that can't link, most of whose shingles no other set of a fitting
size has, are left out first, and regions made anew without them.

Within a task a set is compared with all others at once by marking its shingles,
again only sets outside the largest class, so that a group of copies costs one
comparison each.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, discard, map_arrow, map_batches, map_groups, persisted, table, text_bytes
from .components import connected_components
from .texthash import shingle_sets

#: Part of the hash space in which shingles are counted.
COUNTED = 0.35
#: Postings that a task gathers before it passes them on, and that a bucket holds, about.
FLUSH, BUCKET = 1_000_000, 500_000
#: Frequent shingles: entries of a task's summary, documents of a task that have one at least, and documents in all.
SUMMARY, LOCAL_HOT, HOT = 8192, 4, 256
#: Sets that one task joins, pivots of a larger region at most, and the share of a region that its cells may keep.
REGION, PIVOTS, SHRINK = 1024, 32, 0.7
#: Rows of 16 bytes that are broadcast at most.
MAX_BROADCAST = 2_000_000
#: Bits of a set's name before names that two sets share are replaced.
NAME_BITS = 64

_ORDER_BITS = 6  # low bits of a posting's code hold how many shingles a set may find shared before it matters
_BUCKET_MUL = np.uint64(0xC2B2AE3D27D4EB4F)


def prefix_length(n: np.ndarray | int, percent: int):
    """Shingles of a set of n of which a linked set has one at least."""
    return n - -(-percent * n // 100) + 1


def linked(shared, n, m, percent: int):
    return 100 * shared >= percent * (n + m - shared)


@dataclass
class Names:
    """64-bit names of sets: the first bits of their 128-bit hash, but for the few that two sets would share."""

    bits: int = 64
    other: dict[tuple[int, int], int] = field(default_factory=dict)

    def both(self, s: np.ndarray) -> tuple[int, int]:
        a, b = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), dtype="<i8").tolist()
        return a >> (64 - self.bits), b

    def of(self, s: np.ndarray) -> int:
        a, b = self.both(s)
        return self.other.get((a, b), a) if self.other else a


def members_of(docs: DataFrame, words: int, names: Names) -> DataFrame:
    """doc_id, h (a hash of the text), n (size of its set), node (its name; null for an empty set) and node2 (the rest of its hash)."""

    def run(batch: pa.RecordBatch):
        for block in blocks(batch):
            sets = shingle_sets(text_bytes(block), words)
            both = [names.both(s) if len(s) else (None, None) for s in sets]
            yield pa.RecordBatch.from_pydict({"doc_id": block.column("doc_id"), "h": block.column("h"), "n": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array([a for a, _ in both], pa.int64()), "node2": pa.array([b for _, b in both], pa.int64())})

    return map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("h")), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h bigint, n bigint, node bigint, node2 bigint")


def renamed(members: DataFrame, names: Names) -> tuple[DataFrame, Names]:
    """``members`` and names of which no two sets share one; at 64 bits a few among billions are replaced."""
    ends = members.groupBy("node").agg(F.min("node2").alias("a"), F.max("node2").alias("z"))
    shared = [r.node for r in ends.where("a <> z").select("node").collect()]
    if not shared:
        return members, names
    pairs = sorted((r.node, r.node2) for r in members.where(F.col("node").isin(shared)).select("node", "node2").distinct().collect())
    other = {p: None for i, p in enumerate(pairs) if i and pairs[i - 1][0] == p[0]}
    attempt = 0
    while todo := [p for p, name in other.items() if name is None]:
        attempt += 1
        made = {p: int(np.frombuffer(xxhash.xxh3_64_digest(repr((p, attempt)).encode()), dtype="<i8")[0]) for p in todo}
        taken = {r.node for r in members.where(F.col("node").isin(list(made.values()))).select("node").distinct().collect()} | {n for n in other.values() if n is not None}
        for p, name in made.items():
            if name not in taken:
                other[p] = name
                taken.add(name)
    small = F.broadcast(members.sparkSession.createDataFrame([(a, b, n) for (a, b), n in other.items()], "node bigint, node2 bigint, _name bigint"))
    out = members.join(small, ["node", "node2"], "left").withColumn("node", F.coalesce("_name", "node"))
    return out.select("doc_id", "h", "n", "node", "node2"), Names(names.bits, other)


def _slack_code(x: int) -> int:
    """The greatest number that 6 bits can hold, as 2 bits times a power of two, and that isn't over x."""
    if x < 4:
        return max(0, x)
    e = x.bit_length() - 3
    return min(63, 4 * (e + 1) + (x >> e) - 4)


def _slack(code: np.ndarray) -> np.ndarray:
    return np.where(code < 4, code, (4 + code % 4) << np.maximum(code // 4 - 1, 0))


def hot_shingles(docs: DataFrame, words: int, total: int) -> np.ndarray:
    """Hashes of shingles in very many documents, sorted. Only an order depends on them.

    Each task passes on at most ``SUMMARY`` of its own; the threshold grows with the
    corpus' shingles, so that there are at most a million.
    """

    def run(batches):
        seen: Counter = Counter()
        held: list[np.ndarray] = []

        def count():
            h, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            seen.update(dict(zip(h[n > 1].tolist(), n[n > 1].tolist(), strict=True)))
            if len(seen) > 32 * SUMMARY:
                best = seen.most_common(8 * SUMMARY)
                seen.clear()
                seen.update(dict(best))

        for batch in batches:
            for block in blocks(batch):
                held += shingle_sets(text_bytes(block), words)
                if sum(map(len, held)) > FLUSH:
                    count()
        if held:
            count()
        best = [(h, n) for h, n in seen.most_common(SUMMARY) if n >= LOCAL_HOT]
        yield pa.RecordBatch.from_pydict({"h": pa.array(np.array([h for h, _ in best], dtype=np.uint64).view(np.int64)), "n": pa.array([n for _, n in best], pa.int64())})

    found = map_batches(docs.select("text"), run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    rows = found.where(F.col("n") >= max(HOT, total // 1_000_000)).select("h").collect()
    return np.sort(np.array([r.h for r in rows], dtype=np.int64).view(np.uint64))


def _packed(bucket: list[int], code: list[bytes], node: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int32()), "code": pa.array(code, pa.binary()), "node": pa.array(node, pa.binary())})


_PACKED = "bucket int, code binary, node binary"


def _dealt(bucket: np.ndarray, code: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
    """Postings as one row for each bucket."""
    order = np.argsort(bucket, kind="stable")
    bucket, code, node = bucket[order], code[order], node[order]
    names, first = np.unique(bucket, return_index=True)
    last = np.append(first[1:], len(bucket))[: len(first)]
    return _packed(names.tolist(), [code[a:z].tobytes() for a, z in zip(first, last, strict=True)], [node[a:z].tobytes() for a, z in zip(first, last, strict=True)])


def _gathered(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    join = lambda name, kind: np.frombuffer(b"".join(t.column(name).to_pylist()), dtype=kind)
    return join("code", np.uint64), join("node", np.int64)


def _token_bucket(token: np.ndarray, buckets: int) -> np.ndarray:
    return ((token * _BUCKET_MUL) >> np.uint64(32)).astype(np.int64) % buckets


def shared_prefixes(docs: DataFrame, words: int, percent: int, hot: np.ndarray, buckets: int, names: Names) -> DataFrame:
    """Packed postings (shingle, node) of the sets' prefixes, of shingles that another set has; buckets below 0 hold frequent shingles.

    The code of a posting on its way is the shingle without its low bits, which hold
    the slack (rounded down): of a set with more counted shingles than its prefix
    needs, as many more as the slack tells may be found shared before a shared one is
    in the prefix.
    """
    spark: SparkSession = docs.sparkSession
    known = spark.sparkContext.broadcast(hot)
    limit = np.uint64(int(COUNTED * 2**64))
    low = np.uint64((1 << _ORDER_BITS) - 1)

    def emit(batches):
        tokens, nodes, rare, rare_nodes, size = [], [], [], [], 0
        done: set[int] = set()
        hot = known.value

        def flush():
            token, node = np.concatenate(tokens), np.concatenate(nodes)
            yield _dealt(_token_bucket(token & ~low, buckets), token, node)

        for batch in batches:
            for block in blocks(batch):
                for s in shingle_sets(text_bytes(block), words):
                    if not len(s):
                        continue
                    node = names.of(s)
                    if node in done:
                        continue
                    if len(done) > 200_000:
                        done.clear()
                    done.add(node)
                    need = prefix_length(len(s), percent)
                    cold = s
                    if len(hot):
                        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                        is_hot = hot[at] == s
                        cold = s[~is_hot]
                        if len(cold) < need:
                            extra = s[is_hot][: need - len(cold)]
                            rare.append(extra)
                            rare_nodes.append(np.full(len(extra), node, dtype=np.int64))
                    counted = int(np.searchsorted(cold, limit))
                    take = cold[: max(counted, min(need, len(cold)))]
                    slack = np.uint64(_slack_code(counted - need))
                    tokens.append((take & ~low) | slack)
                    nodes.append(np.full(len(take), node, dtype=np.int64))
                    size += len(take)
                    if size >= FLUSH:
                        yield from flush()
                        tokens, nodes, size = [], [], 0
        if tokens:
            yield from flush()
        if rare:
            from pyspark import TaskContext

            yield _packed([-1 - TaskContext.get().partitionId() % 4096], [np.concatenate(rare).tobytes()], [np.concatenate(rare_nodes).tobytes()])

    def counted(t: pa.Table) -> pa.Table:
        """Shingles of two sets at least, with how many, back to their sets; code: shingle, then count in a second block."""
        bucket = t.column("bucket")[0].as_py()
        code, node = _gathered(t)
        if bucket < 0:
            return pa.table({"bucket": [bucket], "code": [code.tobytes()], "node": [node.tobytes()], "more": [b""]}, schema=_schema(more=True))
        token = code & ~low
        order = np.lexsort((node, token))
        code, token, node = code[order], token[order], node[order]
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (node[1:] != node[:-1])
        code, token, node = code[new], token[new], node[new]
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        n = np.diff(np.append(start, len(token)))
        df = np.repeat(n, n)
        keep = df > 1
        code, node, df = code[keep], node[keep], df[keep].astype(np.uint32)
        home = (node.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        home, code, node, df = home[order], code[order], node[order], df[order]
        names, first = np.unique(home, return_index=True)
        parts = list(zip(first, np.append(first[1:], len(home))[: len(first)], strict=True))
        return pa.table({"bucket": names.tolist(), "code": [code[a:z].tobytes() for a, z in parts], "node": [node[a:z].tobytes() for a, z in parts], "more": [df[a:z].tobytes() for a, z in parts]}, schema=_schema(more=True))

    def chosen(t: pa.Table) -> pa.Table:
        """For each set, its shared shingles that are in its prefix, by rising count."""
        bucket = t.column("bucket")[0].as_py()
        code, node = _gathered(t)
        if bucket < 0:
            return pa.table({"bucket": [bucket], "code": [code.tobytes()], "node": [node.tobytes()]}, schema=_schema())
        df = np.frombuffer(b"".join(t.column("more").to_pylist()), dtype=np.uint32)
        token = code & ~low
        order = np.lexsort((token, df, node))
        code, token, node = code[order], token[order], node[order]
        start = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
        n = np.diff(np.append(start, len(node)))
        rank = np.arange(len(node)) - np.repeat(start, n)
        slack = _slack((code & low).astype(np.int64))
        keep = rank < np.repeat(n, n) - slack
        token, node = token[keep], node[keep]
        b = _dealt(_token_bucket(token, buckets), token, node)
        return pa.Table.from_batches([b.cast(_schema())])

    out = map_batches(docs.select("text"), emit, _PACKED)
    out = map_groups(spark, out.groupBy("bucket"), counted, _PACKED + ", more binary")
    return persisted(map_groups(spark, out.groupBy("bucket"), chosen, _PACKED))


def _schema(more: bool = False) -> pa.Schema:
    return pa.schema([("bucket", pa.int32()), ("code", pa.binary()), ("node", pa.binary())] + [("more", pa.binary())] * more)


def postings(prefixes: DataFrame) -> DataFrame:
    """h (the shingle) and node, unpacked."""

    def unpacked(batch: pa.RecordBatch):
        for i in range(batch.num_rows):
            token, node = _gathered(pa.Table.from_batches([batch.slice(i, 1)]))
            yield pa.RecordBatch.from_pydict({"h": pa.array(token.view(np.int64)), "node": pa.array(node)})

    return map_arrow(prefixes.select("code", "node"), unpacked, "h bigint, node bigint")


def region_edges(prefixes: DataFrame) -> DataFrame:
    """a, b: each set of a shingle's region with the region's smallest set."""
    pair = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def stars(t: pa.Table) -> pa.Table:
        token, node = _gathered(t)
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        n = np.diff(np.append(start, len(token)))
        edges = np.unique(np.stack([node, np.repeat(node[start], n)], axis=1), axis=0)
        edges = edges[edges[:, 0] != edges[:, 1]]
        return pa.table([pa.array(edges[:, 0]), pa.array(edges[:, 1])], schema=pair)

    rare = map_groups(prefixes.sparkSession, prefixes.where("bucket >= 0").groupBy("bucket"), stars, "a bigint, b bigint")
    frequent = postings(prefixes.where("bucket < 0"))
    least = frequent.groupBy("h").agg(F.min("node").alias("b"))  # at most a million shingles
    tied = frequent.join(F.broadcast(least), "h").select(F.col("node").alias("a"), "b").where("a <> b")
    return rare.union(tied).distinct()


def local_classes(sets: list[np.ndarray], percent: int, known: np.ndarray | None = None) -> np.ndarray:
    """The class (index of one of its sets) of each set under links, exactly; ``known`` gives classes already known."""
    m = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    universe, token = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    mark = np.zeros(len(universe), dtype=np.int32)
    label = np.arange(m) if known is None else np.unique(known, return_index=True)[1][np.unique(known, return_inverse=True)[1]]

    def compare(i: int) -> None:
        nonlocal label
        own = token[first[i] : first[i] + size[i]]
        mark[own] = 1
        shared = np.add.reduceat(mark[token], first)
        mark[own] = 0
        hit = linked(shared, size[i], size, percent)
        merge = np.unique(label[hit])
        if len(merge) > 1:
            label = np.where(np.isin(label, merge), merge[0], label)

    # the sets with the most shingles in common with others tend to be a group's centre
    df = np.bincount(token)
    centre = np.argsort(-np.add.reduceat(np.log1p(df[token]), first) / size, kind="stable")
    done = np.zeros(m, dtype=bool)
    while True:  # every pair across classes has a set outside the largest
        names, n = np.unique(label, return_counts=True)
        due = centre[~done[centre] & ((label[centre] != names[n.argmax()]) | (not done.any()))]
        if not len(due) or len(names) == 1:
            break
        compare(int(due[0]))
        done[due[0]] = True
    return label


def _sets(t: pa.Table, extra: str | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray | None]:
    """Distinct nodes, their sets and another column."""
    names, at = np.unique(t.column("node").to_numpy(), return_index=True)
    col = t.column("tokens")
    return names, [np.frombuffer(col[int(i)].as_py(), dtype=np.uint64) for i in at], t.column(extra).to_numpy()[at] if extra else None


_LINK = "a bigint, b bigint"


def _link_table(a: np.ndarray, b: np.ndarray) -> pa.Table:
    return pa.table([pa.array(a[a != b]), pa.array(b[a != b])], schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def classes_of_regions(sets: DataFrame, percent: int) -> DataFrame:
    """node, root for sets with region, node, tokens; each region in one task."""
    out = pa.schema([("node", pa.int64()), ("root", pa.int64())])

    def run(t: pa.Table) -> pa.Table:
        names, own, _ = _sets(t)
        label = local_classes(own, percent)
        return pa.table([pa.array(names), pa.array(names[label])], schema=out)

    return map_groups(sets.sparkSession, sets.groupBy("region"), run, "node bigint, root bigint")


def links_within(sets: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """a, b: links between classes (root) already known that connect them in regions that fit a task."""

    def run(t: pa.Table) -> pa.Table:
        _, own, root = _sets(t, "root")
        pairs = np.unique(np.stack([root, root[local_classes(own, percent, root)]], axis=1), axis=0)
        return _link_table(pairs[:, 0], pairs[:, 1])

    return map_groups(sets.sparkSession, sets.groupBy(*keys), run, _LINK)


def links_of_large_regions(sets: DataFrame, prefixes: DataFrame, percent: int, limit: int = REGION) -> DataFrame:
    """a, b: links that connect the classes of regions too large for a task; sets has region, size (of the region), node, tokens.

    Each round joins the regions that fit a task and divides the others, whose parts
    are smaller by ``SHRINK`` at least, so that rounds grow with the logarithm of the
    largest region.
    """
    level = sets.select("region", "size", "node", "tokens", F.col("node").alias("root"), F.lit(True).alias("home"), F.lit(False).alias("listed"))
    found = []
    while True:
        found.append(links_within(level.where(F.col("size") <= limit), ["region"], percent))
        large = level.where(F.col("size") > limit)
        if large.isEmpty():
            break
        placed, stars = _placed(large, percent, limit)
        cells, wide = _cells(placed, percent)
        found.append(stars)
        parts = _in_cells(placed, cells, percent)
        if not wide.isEmpty():
            again = placed.join(wide, "region", "left_semi")
            lists, dense = _listed(again.where("not listed"), prefixes, limit)
            found.append(_links_in_blocks(again.join(dense, "region", "left").where("listed or dense"), percent, limit))
            parts = parts.unionByName(lists)
        level = persisted(parts)
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out


def trimmed(sets: DataFrame, percent: int, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """``sets`` (with node, tokens) without those that can't link, which are what unlike texts grow together by.

    ``percent`` of a set's shingles at least are in any set it links with, whose size
    differs by no more than that; so must they be in some other set of such a size.
    """
    total = sets.agg(F.sum(F.octet_length("tokens"))).first()[0] or 0
    buckets = max(4, -(-total // 8 // BUCKET))
    packed = _schema(more=True)

    def dealt(token: list, node: list, size: list) -> pa.RecordBatch:
        token, length = np.concatenate(token), np.array([len(x) for x in token])
        at = np.repeat(np.arange(len(node)), length)
        bucket = _token_bucket(token, buckets)
        order = np.argsort(bucket, kind="stable")
        bucket, token, at = bucket[order], token[order], at[order]
        names, first = np.unique(bucket, return_index=True)
        parts = list(zip(first.tolist(), [*first[1:].tolist(), len(bucket)], strict=True))
        node, size = np.array(node, dtype=np.int64)[at], np.array(size, dtype=np.uint32)[at]
        return pa.RecordBatch.from_pydict({"bucket": names.tolist(), "code": [token[a:z].tobytes() for a, z in parts], "node": [node[a:z].tobytes() for a, z in parts], "more": [size[a:z].tobytes() for a, z in parts]}, schema=packed)

    def emit(batches):
        token, node, held = [], [], 0
        for batch in batches:
            for name, raw in zip(batch.column("node").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                token.append(np.frombuffer(raw, dtype=np.uint64))
                node.append(name)
                held += len(token[-1])
                if held >= FLUSH:
                    yield dealt(token, node, [len(x) for x in token])
                    token, node, held = [], [], 0
        if token:
            yield dealt(token, node, [len(x) for x in token])

    def met(t: pa.Table) -> pa.Table:
        token, node = _gathered(t)
        size = np.frombuffer(b"".join(t.column("more").to_pylist()), dtype=np.uint32).astype(np.int64)
        order = np.lexsort((size, token))
        token, node, size = token[order], node[order], size[order]
        next_to = (token[1:] == token[:-1]) & (100 * size[:-1] >= percent * size[1:])  # of a shingle's sets those next in size are the nearest
        found = np.append(next_to, False) | np.append(False, next_to)
        names, n = np.unique(node[found], return_counts=True)
        return pa.table({"node": pa.array(names, pa.int64()), "met": pa.array(n, pa.int64())})

    postings_ = map_batches(sets.select("node", "tokens"), emit, _PACKED + ", more binary")
    counts = map_groups(sets.sparkSession, postings_.groupBy("bucket"), met, "node bigint, met bigint").groupBy("node").agg(F.sum("met").alias("met"))
    sizes = sets.select("node", F.expr("octet_length(tokens) div 8").alias("n"))
    stay = persisted(counts.join(sizes, "node").where(100 * F.col("met") >= percent * F.col("n")).select("node"))
    return sets.join(F.broadcast(stay) if stay.count() <= max_broadcast else stay, "node", "left_semi")


def divided(sets: DataFrame, prefixes: DataFrame, percent: int, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """region, size, node and tokens of the sets of large regions that may link, in the regions that are left without the others."""
    left = persisted(trimmed(sets, percent, max_broadcast).select("node", "tokens"))
    lists = shingle_lists(prefixes).join(left.select("node"), "node", "left_semi")
    lists = persisted(lists.select("list", "node"))
    least = lists.groupBy("list").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1").select("list", "b")
    regions = connected_components(lists.join(least, "list").select(F.col("node").alias("a"), "b").distinct()).withColumnRenamed("root", "region")
    of = regions.join(left.select("node", F.octet_length("tokens").alias("bytes")), "node")
    size = of.groupBy("region").agg(_weight().alias("size"))
    out = persisted(left.join(regions.join(size, "region"), "node").select("region", "size", "node", "tokens"))
    discard(lists, left)
    return out


def _placed(large: DataFrame, percent: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Members with pivots and their distances, the nearest and the root of its class; and links to pivots."""
    spark = large.sparkSession
    wanted = F.least(F.lit(PIVOTS), F.greatest(F.lit(4), F.ceil(4 * F.col("size") / limit)))
    chance = F.pmod(F.xxhash64("region", "node", F.lit("pivot")), F.lit(1 << 30)) < F.floor(wanted * float(1 << 30) / F.col("size"))
    first = large.groupBy("region", "size").agg(F.min(F.struct("node", "tokens")).alias("p")).select("region", "size", "p.node", "p.tokens")
    pivots = large.where(chance).select("region", "size", "node", "tokens").union(first).dropDuplicates(["region", "node"])
    # members in blocks of a task's size, each with all pivots of its region
    parts = F.ceil(F.col("size") / limit).cast("bigint")
    rows = large.withColumn("part", F.pmod(F.xxhash64("node", F.lit("part")), parts)).withColumn("pivot", F.lit(False))
    copies = pivots.select("region", "size", "node", "tokens", F.lit(0).cast("bigint").alias("root"), F.lit(False).alias("home"), F.lit(False).alias("listed"), F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part"), F.lit(True).alias("pivot"))
    keep = ["region", "size", "node", "tokens", "root", "home", "listed"]

    def near(t: pa.Table) -> pa.Table:
        is_pivot = t.column("pivot").to_numpy(zero_copy_only=False)
        own = [np.frombuffer(x, dtype=np.uint64) for x in t.column("tokens").to_pylist()]
        size = np.array([len(x) for x in own], dtype=np.int64)
        universe, token = np.unique(np.concatenate(own), return_inverse=True)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        node = t.column("node").to_numpy()
        at = np.flatnonzero(is_pivot)[np.argsort(node[is_pivot], kind="stable")]
        mark = np.zeros(len(universe), dtype=np.int32)
        distance, hit = np.zeros((len(at), len(own))), np.zeros((len(at), len(own)), dtype=bool)
        for k, i in enumerate(at.tolist()):
            mine = token[begin[i] : begin[i] + size[i]]
            mark[mine] = 1
            both = np.add.reduceat(mark[token], begin)
            mark[mine] = 0
            distance[k] = 1 - both / (size[i] + size - both)
            hit[k] = linked(both, size[i], size, percent)
        rows = np.flatnonzero(~is_pivot)
        names, distance, hit = node[at], distance[:, rows].T, hit[:, rows].T
        out = t.select(keep).take(pa.array(rows))
        out = out.append_column("pivots", pa.array([names.tolist()] * len(rows), pa.list_(pa.int64())))
        out = out.append_column("distances", pa.array(distance.tolist(), pa.list_(pa.float64())))
        out = out.append_column("nearest", pa.array(names[distance.argmin(axis=1)]))
        out = out.append_column("first", pa.array(names[hit.argmax(axis=1)], mask=~hit.any(axis=1)))
        merged = _merged([names[x].tolist() for x in np.unique(hit, axis=0)])  # pivots that a member links; with the first row
        return out.append_column("merged", pa.array([merged if i == 0 else [] for i in range(len(rows))], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))))

    schema = "region bigint, size bigint, node bigint, tokens binary, root bigint, home boolean, listed boolean, pivots array<bigint>, distances array<double>, nearest bigint, first bigint, merged array<struct<a: bigint, b: bigint>>"
    placed = persisted(map_groups(spark, rows.unionByName(copies).groupBy("region", "part"), near, schema))
    pairs = placed.select("region", F.explode("merged").alias("m")).select("region", "m.a", "m.b")
    stars = placed.where("first <> node").select(F.col("root").alias("a"), F.col("first").alias("b")).union(pairs.select("a", "b"))

    def classes(t: pa.Table) -> pa.Table:
        found = _merged(zip(t.column("a").to_pylist(), t.column("b").to_pylist(), strict=True))
        return pa.table({"region": pa.array([t.column("region")[0].as_py()] * len(found), pa.int64()), "first": pa.array([x["a"] for x in found], pa.int64()), "class": pa.array([x["b"] for x in found], pa.int64())})

    of = persisted(map_groups(spark, pairs.groupBy("region"), classes, "region bigint, first bigint, class bigint"))  # PIVOTS rows, about, of a region
    placed = placed.join(of, ["region", "first"], "left").withColumn("root", F.coalesce("class", "first", "root"))
    return placed.drop("first", "class", "merged"), stars


def _merged(groups) -> list[dict[str, int]]:
    """a and b, the least of its class, of all that isn't the least itself, from groups that are of one class."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for group in groups:
        for x in group[1:]:
            a, b = top(group[0]), top(x)
            up[max(a, b)] = min(a, b)
    return [{"a": x, "b": top(x)} for x in sorted(up) if top(x) != x]


def _in_windows(placed: DataFrame, cells: DataFrame, eps: float) -> DataFrame:
    """Members with the cells (pivot, radius, cell, n) that they belong to: home where their nearest pivot is the cell's.

    A pair is found in the cell of one of its home members. Of two home members in
    different cells, only the one whose pivot is the greater goes to the other's cell.
    """
    met = placed.join(cells, "region").withColumn("cell", F.explode("cells"))
    own = F.col("home") & (F.col("nearest") == F.col("cell.pivot"))
    d = F.map_from_arrays("pivots", "distances")[F.col("cell.pivot")]
    near = (d <= F.col("cell.radius") + F.lit(eps + 1e-9)) & (~F.col("home") | (F.col("cell.pivot") < F.col("nearest")))
    return met.withColumn("home_here", own).where(own | near)


def _cells(placed: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """region and its cells that hold several classes, and region of those whose cells aren't smaller than they are."""
    eps = 1 - percent / 100
    radius = placed.where("home").groupBy("region", F.col("nearest").alias("pivot")).agg(F.max(F.element_at(F.map_from_arrays("pivots", "distances"), F.col("nearest"))).alias("radius"))
    all_ = radius.groupBy("region").agg(F.collect_list(F.struct("pivot", "radius")).alias("cells"))  # PIVOTS, about, of a region
    narrow = _in_windows(placed.select("region", "size", "home", "root", "nearest", "pivots", "distances", F.octet_length("tokens").alias("bytes")), all_, eps)
    stats = narrow.groupBy("region", "size", "cell").agg(_weight().alias("n"), (F.min("root") != F.max("root")).alias("mixed")).where("mixed")
    stats = persisted(stats.select("region", "size", "n", "cell.pivot", "cell.radius"))
    fits = stats.groupBy("region", "size").agg(F.max("n").alias("most"), F.sum("n").alias("total")).withColumn("wide", (F.col("most") > SHRINK * F.col("size")) | (F.col("total") > 4 * F.col("size")))
    wide = fits.where("wide").select("region")
    cells = stats.join(wide, "region", "left_anti").groupBy("region").agg(F.collect_list(F.struct("pivot", "radius", F.xxhash64("region", "pivot").alias("id"), "n")).alias("cells"))
    return cells, wide


def _in_cells(placed: DataFrame, cells: DataFrame, percent: int) -> DataFrame:
    met = _in_windows(placed, cells, 1 - percent / 100)
    return met.select(F.col("cell.id").alias("region"), F.col("cell.n").alias("size"), "node", "tokens", "root", F.col("home_here").alias("home"), "listed")


def shingle_lists(prefixes: DataFrame) -> DataFrame:
    """list and node: the sets of each prefix shingle; of shingles with the same sets one. Lists stay packed until equal ones have gone."""

    def packed(t: pa.Table) -> pa.Table:
        token, node = _gathered(t)
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        start = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else np.zeros(0, np.int64)
        found: dict[bytes, bytes] = {}
        for a, z in zip(start.tolist(), [*start[1:].tolist(), len(token)][: len(start)], strict=True):
            raw = np.unique(node[a:z]).tobytes()
            found[xxhash.xxh3_128_digest(raw)] = raw
        return pa.table({"name": pa.array(list(found), pa.binary()), "nodes": pa.array(list(found.values()), pa.binary())})

    def unpacked(batch: pa.RecordBatch):
        for name, raw in zip(batch.column("list").to_pylist(), batch.column("nodes").to_pylist(), strict=True):
            node = np.frombuffer(raw, dtype=np.int64)
            yield pa.RecordBatch.from_pydict({"list": pa.array([name] * len(node), pa.int64()), "node": pa.array(node)})

    lists = map_groups(prefixes.sparkSession, prefixes.where("bucket >= 0").groupBy("bucket"), packed, "name binary, nodes binary").dropDuplicates(["name"])
    rare = map_arrow(lists.select(F.xxhash64("name").alias("list"), "nodes"), unpacked, "list bigint, node bigint")
    return rare.union(postings(prefixes.where("bucket < 0")).distinct())


def _listed(rows: DataFrame, prefixes: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The sets of each prefix shingle of a region as regions of their own; and the regions (dense: true) where that takes more bytes than blocks do."""
    lists = shingle_lists(prefixes).join(rows.select("region", "node", "root", F.octet_length("tokens").alias("bytes")), "node")
    lists = persisted(lists.withColumn("list", F.xxhash64("region", "list")))
    stats = lists.groupBy("region", "list").agg(F.count(F.lit(1)).alias("n"), _weight().alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"), (F.min("root") != F.max("root")).alias("mixed"))
    one = stats.where("mixed").groupBy("region", "n", "size", "x", "y").agg(F.min("list").alias("list")).select("list", "size", "n")
    members = lists.select("region", "list", "node").join(one, "list")
    members = persisted(members.join(_covered(members), "list", "left_anti"))
    taken = members.join(lists.select("region", "list", "node", "bytes"), ["region", "list", "node"]).groupBy("region").agg(F.sum("bytes").alias("taken"))
    whole = rows.groupBy("region", "size").agg(F.sum(F.octet_length("tokens")).alias("bytes"))
    dense = persisted(whole.join(taken, "region").where(F.col("taken") > F.col("bytes") * _blocks(limit)).select("region", F.lit(True).alias("dense")))
    members = members.join(dense, "region", "left_anti")
    parts = rows.drop("size").join(members.drop("n"), ["region", "node"]).select(F.col("list").alias("region"), "size", "node", "tokens", "root", F.lit(True).alias("home"), F.lit(True).alias("listed"))
    return parts, dense


def _blocks(limit: int) -> F.Column:
    """Blocks of half a task's size that a region is cut into; each of its sets is in as many tasks."""
    return F.ceil(2 * F.col("size") / limit).cast("bigint")


def _covered(members: DataFrame) -> DataFrame:
    """list: those all of whose sets are in one longer list, where their pairs are met; no two lists of ``members`` (region, list, node, n) are equal."""
    longest = members.groupBy("region", "node").agg(F.max(F.struct("n", "list")).alias("top"))
    first = members.groupBy("region", "list", "n").agg(F.min("node").alias("node"))
    tried = first.join(longest, ["region", "node"]).where(F.col("top.n") > F.col("n")).select("list", "n", F.col("top.list").alias("longer"))
    met = members.select("list", "node").join(tried, "list").join(members.select(F.col("list").alias("longer"), "node"), ["longer", "node"])
    return met.groupBy("list", "n").count().where(F.col("count") == F.col("n")).select("list")


def _links_in_blocks(rows: DataFrame, percent: int, limit: int) -> DataFrame:
    """Links of regions that nothing divides: blocks of half a task's size, each two of them in one task."""
    blocks_ = _blocks(limit)
    own = rows.withColumn("own", F.pmod(F.xxhash64("node", F.lit("block")), blocks_)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks_ - 1)))
    return links_within(own.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")), ["region", "i", "j"], percent)


def _weight() -> F.Column:
    """The size of a group: its sets, or thousands of shingles if these are more."""
    return F.greatest(F.count(F.lit(1)), F.ceil(F.sum("bytes") / 8000))


def _classed(docs: DataFrame, words: int, percent: int, region: int, max_broadcast: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, h, n, node) of ``docs``, and node, root of the sets that link with another set."""
    docs = docs.select("doc_id", "text")
    members = persisted(members_of(docs, words, Names(NAME_BITS)))
    members, names = renamed(members, Names(NAME_BITS))
    nodes = members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("_rep"), (8 * F.max("n")).alias("bytes"))
    total = int(members.agg(F.sum("n")).first()[0] or 0)
    hot = hot_shingles(docs, words, total)
    buckets = max(4, -(-int(COUNTED * total) // BUCKET))
    prefixes = shared_prefixes(docs, words, percent, hot, buckets, names)
    regions = connected_components(region_edges(prefixes)).withColumnRenamed("root", "region")
    inside = persisted(regions.join(nodes, "node").select("node", "region", "_rep", "bytes"))
    large = persisted(inside.groupBy("region").agg(_weight().alias("size")).where(F.col("size") > region))
    n_large = large.count()
    wanted = inside.drop("bytes").join(F.broadcast(large) if n_large <= max_broadcast else large, "region", "left").fillna(0, "size")
    if inside.count() <= max_broadcast:
        wanted = F.broadcast(wanted)
    chosen = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_rep"))).select("text", "node", "region", "size")

    def sets_of(batch: pa.RecordBatch):
        for block in blocks(batch):
            sets = shingle_sets(text_bytes(block), words)
            node = block.column("node").to_pylist()
            on = [i for i, s in enumerate(sets) if len(s) and names.of(s) == node[i]]  # another row may have the same doc_id
            take = pa.array(on, pa.int64())
            yield pa.RecordBatch.from_pydict({k: block.column(k).take(take) for k in ("region", "size", "node")} | {"tokens": pa.array([sets[i].tobytes() for i in on], pa.binary())})

    sets = persisted(map_arrow(chosen, sets_of, "region bigint, size bigint, node bigint, tokens binary").dropDuplicates(["node"]))
    roots = classes_of_regions(sets.where(F.col("size") <= region), percent)
    if n_large:
        roots = roots.union(connected_components(links_of_large_regions(divided(sets.where(F.col("size") > region), prefixes, percent, max_broadcast), prefixes, percent, region)))
    return members, persisted(roots)


def link_classes(docs: DataFrame, words: int = 5, percent: int = 75, region: int = REGION, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """doc_id, n_shingles and component_id for each row of ``docs`` (doc_id, text).

    A document's set holds its distinct shingles of ``words`` words (ASCII white space
    divides, A-Z in lower case); of a shorter text the whole sequence. Sets link if
    ``100 * intersection >= percent * union``; component_id is the smallest doc_id
    that links reach. A null, empty or blank text has an empty set, links with
    nothing and is its own class. Equal sets link, whatever the texts; repeated rows
    and equal doc_ids are documents of their own. A null doc_id takes part, and is
    never the smallest unless alone. Other columns are ignored.
    """
    members, roots = _classed(docs, words, percent, region, max_broadcast)
    nodes = members.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"))
    joined = nodes.join(roots, "node").select("node", "root", "least")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = joined.join(least, "root").select("node", "component_id")
    own = nodes.join(classes, "node", "left").select("node", F.coalesce("component_id", "least").alias("component_id"))
    out = members.join(own, "node", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 75, region: int = REGION, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """The rows of ``docs``, with all columns, that stand for their class: that of the smallest doc_id (nulls last).

    Classes are those of ``link_classes``; of rows with the same doc_id and text one
    stays, which of them isn't defined. Rows without words all stay.
    """
    members, roots = _classed(docs, words, percent, region, max_broadcast)
    rows = members.where("node is not null").groupBy("node", "doc_id", "h").agg(F.count(F.lit(1)).alias("rows"))
    rows = persisted(rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    stays = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("s"))
    told = persisted(rows.join(stays, "root").withColumn("stays", F.col("s.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("s.h") == F.col("h"))).select(F.col("doc_id").alias("__skein_d"), F.col("h").alias("__skein_h"), "stays", "rows"))
    keyed = docs.withColumn("__skein_t", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__skein_d")) & (F.col("__skein_t") == F.col("__skein_h"))
    gone = told.where(~F.col("stays")).select("__skein_d", "__skein_h").distinct()
    if gone.count() <= max_broadcast:
        gone = F.broadcast(gone)
    out = keyed.join(gone, same, "left_anti")
    repeated = told.where(F.col("stays") & (F.col("rows") > 1)).select("__skein_d", "__skein_h").distinct()
    if not repeated.isEmpty():
        one = out.join(repeated, same, "left_semi").dropDuplicates(["doc_id", "__skein_t"])
        out = out.join(repeated, same, "left_anti").unionByName(one)
    return out.select(*docs.columns)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_classes(table(spark, sf_dir, "documents"))
