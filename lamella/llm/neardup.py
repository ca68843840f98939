"""Near duplicates by MinHash with tensored banding.

A document's set holds the hashes of its distinct word shingles. Instead of k hashes for each of L tables, `m` small
collections of `width` hashes are computed; a table's key is a pair of collections, so m collections give m(m-1)/2 tables
of 2*width hashes each, and L tables cost about the square root of the hashes. m is the least number for which a pair
at the threshold shares no key with a probability of at most MISS.

1. Equal sets fall together first, so any number of exact copies is one node.
2. A task makes the keys of some nodes at a time and ties those of them that share a key to the least of them. Only a
   key's least node goes to the exchange, the one of this stage, where the least nodes of a key are tied to the least of
   all. A key that very many nodes share therefore sends one row for each chunk. Connected ties form clusters: supersets of all
   candidate pairs, in which no pair of a bucket is ever written out.
3. Sets are confirmed in full within clusters. A cluster of more than a fair share of the shingles, or than one task can
   hold, is dealt in blocks: first each block with a few pivots. In clusters that are still in several components, what is
   outside of the largest is then compared with all, block by block; where that is more than PARTS blocks, within buckets
   instead of the cluster, those with the same members once. No candidate is dropped.
4. Within a group, sets are compared with a pivot while that joins many of them; then those outside the largest component
   only with sets with which they share one of their rarest shingles (prefix filter: of n shingles, one of the rarest
   n - ceil(n * similarity) + 1 is shared by any two sets at the threshold). Sets that are not alike cost next to nothing.

Shingles are compared by 64-bit hashes. Of k different shingles in two documents, two have the same hash with a chance of
k^2 / 2^65: 3e-14 for two of 1,000 shingles; and one such shingle changes a link only at the threshold itself. Sets are
equal if 128-bit digests are.

Results: null and empty texts, and texts without words, have no shingles and are linked with nothing. Fewer words than a
shingle count as one shingle. Rows with the same doc_id count as one document, linked by any of its texts. Rows without a
doc_id are linked with nothing and have no component. Columns other than doc_id and text are not read. An empty table has
no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamella.llm import common
from lamella.llm.components import components
from lamella.llm.words import ODD, mix, shingle_sets

#: More hashes in a collection tie fewer documents that share a passage only, and need more tables.
WIDTH = 3
MISS = 3e-5
#: Shingles of a cluster, or of each side of a pair of blocks, that one task holds; shingles and rows that are never dealt in blocks.
BLOCK, LEAST_BLOCK, LEAST_ROWS = 2_000_000, 4_000, 40
PIVOTS = 8
#: Blocks of sets outside the largest component up to which a cluster is compared as one, not bucket by bucket.
PARTS = 128
#: Documents are sieved by so many marks, which all tasks get, before they are joined with the members of clusters.
MARKS = 1 << 20
#: Keys that a task makes, about, and that it holds at once.
KEYS, HELD = 2_000_000, 1_000_000
SEED = 20_011


def collections_needed(similarity: float, width: int = WIDTH, miss: float = MISS) -> int:
    """The least m at which at most `miss` of the pairs at the threshold agree in fewer than two collections."""
    p, m = similarity**width, 2
    while (1 - p) ** m + m * p * (1 - p) ** (m - 1) > miss:
        m += 1
    return m


def collections(sets: list[np.ndarray], m: int, width: int) -> np.ndarray:
    """For each set m hashes, each of `width` minhashes. Sets are not empty."""
    r = np.random.default_rng(SEED)
    a, b = r.integers(1, 1 << 63, (2, m * width), dtype=np.uint64)
    a |= np.uint64(1)
    low = np.empty((len(sets), m * width), np.uint64)
    sizes = np.asarray([len(s) for s in sets])
    k = 0
    with np.errstate(over="ignore"):
        while k < len(sets):  # some sets at a time, few enough for the processor's cache
            e = max(k + 1, int(np.searchsorted(np.cumsum(sizes[k:]), 40_000, "right")) + k)
            flat = np.concatenate(sets[k:e])
            starts = np.r_[0, np.cumsum(sizes[k : e - 1])]
            for j in range(m * width):
                x = flat * a[j] + b[j]
                x ^= x >> np.uint64(32)
                low[k:e, j] = np.minimum.reduceat(x, starts)
            k = e
        out = low[:, ::width]
        for w in range(1, width):
            out = mix(out) * ODD + low[:, w::width]
        return mix(out).view(np.int64)


def signatures(docs: DataFrame, size: int, m: int, width: int = WIDTH) -> DataFrame:
    """doc_id, n_shingles, set_key and c0, c1, ... of each row. Narrow: no shuffle."""
    names = [f"c{k}" for k in range(m)]

    def run(batches):
        for b in common.lean(batches):
            sets = shingle_sets(b.column(1), size)
            full = [k for k, s in enumerate(sets) if len(s)]
            keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            sig = np.zeros((len(sets), m), np.int64)
            if full:
                sig[full] = collections([sets[k] for k in full], m, width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), *(pa.array(np.ascontiguousarray(sig[:, k])) for k in range(m))], names=["doc_id", "n_shingles", "set_key", *names])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_key binary, " + ", ".join(f"{c} long" for c in names))


def _pairs(m: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(m) for j in range(i + 1, m)]


def _keyed(nodes: DataFrame, m: int) -> DataFrame:
    """All columns but the collections, and key: a row for each table."""
    keys = F.array(*(F.xxhash64(F.lit(i * m + j), f"c{i}", f"c{j}") for i, j in _pairs(m)))
    drawn = {f"c{k}" for k in range(m)}
    return nodes.select(*(c for c in nodes.columns if c not in drawn), F.explode(keys).alias("key"))


def _tied(doc: np.ndarray, keys: np.ndarray) -> list[pa.RecordBatch]:
    """doc: ids; keys: a row for each. Each key with its least id, and every other id of the key with that one."""
    by = np.argsort(doc, kind="stable")
    doc, keys = doc[by], keys[by].ravel()
    order = np.argsort(keys, kind="stable")
    s, node = keys[order], order // (len(keys) // len(doc))
    new = np.r_[True, s[1:] != s[:-1]]
    least = node[new]
    pair = np.unique(node[~new] * len(doc) + least[np.cumsum(new) - 1][~new])
    u, v = doc[pair // len(doc)], doc[pair % len(doc)]
    u, v = u[u != v], v[u != v]
    out = [(s[new].view(np.int64), doc[least], None), (mix(u.view(np.uint64)).view(np.int64), u, v)]
    return [
        pa.RecordBatch.from_arrays([pa.array(k[a : a + 100_000]), pa.array(x[a : a + 100_000]), pa.nulls(len(x[a : a + 100_000]), pa.int64()) if y is None else pa.array(y[a : a + 100_000])], names=["key", "u", "v"])
        for k, x, y in out
        for a in range(0, len(x), 100_000)
    ]


def ties(nodes: DataFrame, m: int) -> DataFrame:
    """u, v: edges between nodes that share a key, such that all nodes of a bucket are connected; written."""
    pairs = np.asarray(_pairs(m))
    salt = mix(np.arange(1, len(pairs) + 1, dtype=np.uint64))

    def run(batches):
        doc, rows = [], 0
        cols: list[np.ndarray] = []

        def close():
            with np.errstate(over="ignore"):
                c = np.concatenate(cols)
                return _tied(np.concatenate(doc), mix(mix(c[:, pairs[:, 0]] + salt) * ODD + c[:, pairs[:, 1]]))

        for b in common.lean(batches):
            doc.append(b.column(0).to_numpy())
            cols.append(np.column_stack([b.column(k + 1).to_numpy().view(np.uint64) for k in range(m)]))
            rows += b.num_rows
            if rows * len(pairs) >= HELD:
                yield from close()
                doc, cols, rows = [], [], 0
        if rows:
            yield from close()

    parts = max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), nodes.count() * len(pairs) // KEYS)
    keyed = nodes.select("doc_id", *(f"c{k}" for k in range(m))).repartition(parts).mapInArrow(run, "key long, u long, v long")
    least = F.min("u").over(Window.partitionBy("key", F.col("v").isNotNull()))
    found = keyed.select("u", F.coalesce("v", least).alias("v")).where("u > v").distinct()
    return common.written(found, "ties")


def _linked(a: np.ndarray, b: np.ndarray, common_: np.ndarray, percent: int) -> np.ndarray:
    return 100 * common_ >= percent * (a + b - common_)


def links_within(sets: list[np.ndarray], percent: int, root: np.ndarray | None = None) -> np.ndarray:
    """The least index of each set's component under links of at least `percent` of the union. Exact.

    root: components that are known already, by the least index of each.
    """
    n = len(sets)
    size = np.asarray([len(s) for s in sets], np.int64)
    root = np.arange(n) if root is None else root.copy()
    if n == 2:
        if root[1]:
            both = len(np.intersect1d(*sets, assume_unique=True))
            root[1] = 0 if _linked(size[0], size[1], np.int64(both), percent) else 1
        return root
    values, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    starts = np.r_[0, np.cumsum(size)]
    mark = np.zeros(len(values), np.int32)
    # pivots, as long as each joins an eighth of the sets outside the largest component
    rest = np.flatnonzero(root != np.bincount(root).argmax()) if (root != np.arange(n)).any() else np.arange(n)
    while len(rest):
        x = int(rest[np.argsort(size[rest], kind="stable")[len(rest) // 2]])
        own = ids[starts[x] : starts[x + 1]]
        mark[own] = 1
        shared = np.add.reduceat(mark[ids], starts[:-1])
        mark[own] = 0
        hit = np.unique(root[_linked(size, size[x], shared, percent)])
        root[np.isin(root, hit)] = hit[0]
        before = len(rest)
        rest = np.flatnonzero(root != np.bincount(root).argmax())
        if before - len(rest) < max(2, before // 8):
            break
    if len(rest):
        _link_rest(rest, root, ids, often, starts, size, percent)
    return root


def _link_rest(rest: np.ndarray, root: np.ndarray, ids: np.ndarray, often: np.ndarray, starts: np.ndarray, size: np.ndarray, percent: int) -> None:
    """Compares the sets in rest with all that share one of their rarest shingles, and makes root the least of each component."""
    n = len(size)
    owner = np.repeat(np.arange(n), size)
    rank = np.argsort(np.argsort(often, kind="stable"), kind="stable")
    order = np.lexsort((rank[ids], owner))
    prefix = size - -(-percent * size // 100) + 1
    kept = order[np.arange(len(order)) - starts[:-1][owner] < prefix[owner]]  # order keeps the owners' places
    kept = kept[often[ids[kept]] > 1]
    kept = kept[np.argsort(ids[kept], kind="stable")]
    shingle, who = ids[kept], owner[kept]
    lists = np.searchsorted(shingle, np.arange(len(often) + 1))
    by_owner = np.argsort(who, kind="stable")
    mine = np.searchsorted(who[by_owner], np.arange(n + 1))
    mark = np.zeros(len(often), np.int32)
    up = root.tolist()

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for y in rest.tolist():
        own = shingle[by_owner[mine[y] : mine[y + 1]]]
        near = np.unique(np.concatenate([who[lists[k] : lists[k + 1]] for k in own])) if len(own) else own
        near = near[(100 * np.minimum(size[near], size[y]) >= percent * np.maximum(size[near], size[y])) & (near != y)]
        mine_now = find(y)
        near = np.asarray([x for x in near.tolist() if find(x) != mine_now], np.int64)
        if not len(near):
            continue
        mark[ids[starts[y] : starts[y + 1]]] = 1
        at = np.r_[0, np.cumsum(size[near])]
        shared = np.add.reduceat(mark[ids[np.repeat(starts[near] - at[:-1], size[near]) + np.arange(at[-1])]], at[:-1])
        mark[ids[starts[y] : starts[y + 1]]] = 0
        for x in near[_linked(size[near], size[y], shared, percent)].tolist():
            a, b = sorted((find(x), find(y)))
            up[b] = a
    root[:] = [find(x) for x in range(n)]


def _confirm(batches, size: int, percent: int):
    """Rows sorted by group: grp, doc_id, comp, text. Gives each known component with the least one that it is linked to in the group."""
    comps: list[int] = []
    sets: list[np.ndarray] = []
    seen: set[tuple[int, bytes]] = set()  # rows that repeat are held once
    now = None

    def close():
        names, of = np.unique(np.asarray(comps, np.int64), return_inverse=True)
        if len(names) < 2:
            return None
        first = np.full(len(names), len(of))
        np.minimum.at(first, of, np.arange(len(of)))
        root = links_within(sets, percent, first[of])
        least = np.full(len(of), len(names))
        np.minimum.at(least, root, of)
        v = least[root[first]]
        moved = v != np.arange(len(names))
        return pa.RecordBatch.from_arrays([pa.array(names[moved]), pa.array(names[v[moved]])], names=["u", "v"])

    for b in common.lean(batches):
        out = []
        for g, d, c, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), shingle_sets(b.column(3), size), strict=True):
            if g != now:
                out.append(close())
                now, comps, sets, seen = g, [], [], set()
            key = (d, hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            if len(s) and key not in seen:
                seen.add(key)
                comps.append(c)
                sets.append(s)
        out = [x for x in out if x is not None and x.num_rows]
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
    last = close()
    if last is not None and last.num_rows:
        yield last


def confirm(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """rows: grp, doc_id, comp, text. Exact links between known components within each group, as u, v."""
    dealt = rows.select("grp", "doc_id", "comp", "text").repartition("grp").sortWithinPartitions("grp")
    return dealt.mapInArrow(lambda it: _confirm(it, size, percent), "u long, v long")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles and component_id (the least doc_id of the class) for each row of docs.

    Documents are linked if they share at least `percent` of the union of their sets of `size`-word shingles.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    m = collections_needed(percent / 100)
    rows = common.written(signatures(docs, size, m), "signatures")
    linkable = rows.where("set_key is not null and doc_id is not null")
    nodes = common.written(linkable.groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), *(F.first(c).alias(c) for c in ("n_shingles", *(f"c{k}" for k in range(m))))), "nodes")
    tied = ties(nodes, m)
    clusters = components(tied)

    weighed = common.written(clusters.join(nodes.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n")), "node"), "weighed")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shingles, rows_ = weighed.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    block, most = min(block, max(LEAST_BLOCK, shingles // parts)), block
    of_rows = F.ceil(F.count("*") / max(LEAST_ROWS, rows_ // parts))
    weights = weighed.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / block), of_rows).cast("long").alias("blocks"))
    member = common.written(weighed.join(weights, "root").select(F.col("node").alias("doc_id"), "root", "n", "blocks"), "members")
    common.drop(weighed)
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS)).cast("int").alias("mark")
    some = docs.select("*", mark).join(F.broadcast(member.select(mark).distinct()), "mark", "left_semi").drop("mark")
    texts = common.written(some.join(member, "doc_id").select("doc_id", "root", "n", "blocks", "text"), "texts")
    grp = F.xxhash64("root", "blk").alias("grp")
    spread = texts.withColumn("blk", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    rank = F.xxhash64(F.lit(SEED), "doc_id")
    pivots = member.where("blocks > 1").groupBy("root", F.pmod(rank, F.lit(PIVOTS)).alias("k")).agg(F.min(F.struct(rank.alias("r"), "doc_id")).alias("p"))
    everywhere = texts.join(pivots.select("p.doc_id"), "doc_id").withColumn("blk", F.explode(_range("blocks")))
    one = spread.union(everywhere.select(spread.columns)).select(grp, "doc_id", F.col("doc_id").alias("comp"), "text")
    edges = common.written(confirm(one, size, percent), "links")
    large = member.where("blocks > 1")
    if large.take(1):
        edges = _large_clusters(texts, nodes, large, edges, m, size, percent, block, most)
    first = nodes.select("set_key", F.col("doc_id").alias("v"))
    same = linkable.join(first, "set_key").where("doc_id <> v").select(F.col("doc_id").alias("u"), "v").distinct()
    labels = common.written(components(edges.select("u", "v").union(same)), "labels")
    common.drop(nodes, tied, member, texts)
    placed = rows.join(labels.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    return placed.select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))


def _large_clusters(texts: DataFrame, nodes: DataFrame, large: DataFrame, one: DataFrame, m: int, size: int, percent: int, block: int, most: int) -> DataFrame:
    """All links, with those of clusters that were dealt in blocks. large: doc_id, root, n (shingles), blocks; one: the links in the blocks."""
    found = components(one).select(F.col("node").alias("doc_id"), F.col("root").alias("comp"))
    state = common.written(large.select("doc_id", "root", "n").join(found, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id")), "large-state")

    def parts_of(members: DataFrame, group: str) -> DataFrame:
        """Of groups with several components: the largest, and in how many blocks what is outside of it, and all, is dealt.

        Blocks are such that there are about as many pairs of them as tasks, within the bounds of a block.
        """
        weight = members.groupBy(group, "comp").agg(F.sum("n").alias("w"))
        top = weight.groupBy(group).agg(F.max(F.struct("w", "comp")).alias("x"), F.sum("w").alias("all"), F.count("*").alias("comps")).where("comps > 1")
        top = common.written(top.select(group, F.col("x.comp").alias("top"), (F.col("all") - F.col("x.w")).alias("out"), "all"), "open-weights")
        pairs = top.agg(F.sum(F.col("out").cast("double") * F.col("all"))).first()[0] or 0
        each = min(max(block, int((pairs / int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))) ** 0.5)), most)
        return top.select(group, "top", F.ceil(F.col("out") / each).alias("parts"), F.ceil(F.col("all") / each).alias("blocks"))

    several = common.written(parts_of(state, "root"), "open-clusters")
    if not several.take(1):
        return one
    open_ = state.join(several.withColumnRenamed("root", "gid").where(F.col("parts") <= PARTS), F.col("root") == F.col("gid")).select("gid", "doc_id", "comp", "top", "parts", "blocks")
    if several.where(F.col("parts") > PARTS).take(1):
        rest = state.join(several.where(F.col("parts") > PARTS).select("root"), "root").select("doc_id", "n", "comp")
        keyed = common.written(_keyed(nodes.drop("set_key", "n_shingles").join(rest, "doc_id"), m), "large-keyed")
        same = (F.count("*").alias("size"), *(F.sum(F.xxhash64(F.lit(k), "doc_id").cast("decimal(38,0)")).alias(f"h{k}") for k in range(2)))
        each = keyed.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), *same).where("a < b")
        once = common.written(each.groupBy("size", "h0", "h1").agg(F.min("key").alias("key")).select("key"), "open-keys")
        members = common.written(keyed.join(once, "key"), "open-members")
        open_ = open_.union(members.join(parts_of(members, "key"), "key").select(F.col("key").alias("gid"), "doc_id", "comp", "top", "parts", "blocks"))
    left = open_.where("comp <> top").select("doc_id", "comp", "gid", F.pmod(F.xxhash64("doc_id"), F.col("parts")).alias("part"), F.explode(_range("blocks")).alias("blk"))
    right = open_.select("doc_id", "comp", "gid", F.explode(_range("parts")).alias("part"), F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.col("blocks")).alias("blk"))
    dealt = common.written(left.union(right).distinct(), "open-blocks")
    rows = texts.select("doc_id", "text").join(dealt, "doc_id").select(F.xxhash64("gid", "part", "blk").alias("grp"), "doc_id", "comp", "text")
    return one.union(common.written(confirm(rows, size, percent), "links-blocks"))


def _range(column: str):
    return F.sequence(F.lit(0).cast("long"), F.col(column).cast("long") - 1)


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs of which one document of each class stays: that with the least doc_id.

    Of rows with that doc_id, one stays: that with the least text, and of these that with the least hash of all columns.
    """
    classes = near_duplicates(docs, size, percent)
    kept = classes.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    kept = common.written(kept, "kept")
    out = docs.join(kept.where("n = 1").select("doc_id"), "doc_id", "left_semi").select(docs.columns)
    if kept.where("n > 1").take(1):
        again = docs.join(kept.where("n > 1").select("doc_id"), "doc_id", "left_semi")
        first = again.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct("text", F.xxhash64(*docs.columns))).alias("row"))
        out = out.union(first.select("row.*"))
    return out.union(docs.where("doc_id is null"))
