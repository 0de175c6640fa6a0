"""Operator 1: n-gram Jaccard join by a MinHash LSH forest.

Words are maximal runs of letters and digits of the lower-cased text, shingles are runs of five words, and two documents are linked if the Jaccard similarity of their shingle sets is 0.8 or more.

1. Documents with equal shingle sets are one class; of each, one signature goes on: ``TREES`` trees of ``DEPTH`` MinHash values, a byte each, so that a tree's values are one 64-bit number and a prefix is its upper bytes.
2. The forest: all (tree, value, class) are range-partitioned and sorted, so that each partition holds a stretch of the sorted prefix trie of a tree. The common prefix with the neighbours gives the runs of each depth; a run's members are tied
   to its least one (its head; no pairs are made). Runs that reach a partition's edge are closed by their heads' least one, of which there are at most two for each depth and partition.
3. Each class begins with the longest prefixes. The members of a head's runs are a group (heads that share ``STRONG`` trees with a lesser head are one group with it), a group is dealt into blocks of ``BLOCK`` classes, and each pair of blocks is one group
   of rows, whose pairs are verified exactly in numpy and come out as counts and a spanning forest. A pair that is together in several groups counts in the first.
4. From the similarities of a class's links its recall is estimated: each link stands for one over its chance to be met at that depth, and one link at the threshold is added for those that nothing is known of. A class whose estimate is
   under the target is open, and the prefixes of open classes are shortened by ``STEP`` values; the others stop. So classes with many near copies stop early, and those without any go down to the depth that the threshold itself asks for.
5. Components of the verified forest give the class id: the least doc_id. The count of links counts every copy.

Documents of fewer than five words are linked if their words are the same (empty and null texts among themselves). Edge cases: rows with a null doc_id take part, and get the class id null if all of their class are such; repeated rows are copies;
ties of a class's representative go to the least doc_id; a very long text is a slice of its own; an empty table gives no rows; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelore.llm._common import cut, table, text_slices
from pricelore.operators.graph import connected_components

WIDTH, THRESHOLD, RECALL = 5, 0.8, 0.9999
TREES, DEPTH, STEP = 32, 8, 2
STRONG, BLOCK = 4, 256
SLICE_CHARS = 500_000
BROADCAST_ROWS = 1_000_000
#: A class with more than this share of all rows is joined by broadcast; there are at most its inverse of them.
HOT = 1e-4
_ODD = np.random.default_rng(5).integers(0, 2**31, size=(2, TREES * DEPTH), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
TIES = "depth int, node binary, head binary, tree int, prefix long"


def met(similarity, depth: int):
    """The chance that a pair of this similarity shares a prefix in some tree (a little more, as bytes can be equal by chance)."""
    return 1 - (1 - np.asarray(similarity) ** depth) ** TREES


def last_depth(threshold: float = THRESHOLD, recall: float = RECALL) -> int:
    """The greatest depth at which a pair at the threshold is met with the target recall: no class has to be shortened further."""
    return next((d for d in range(DEPTH, 0, -1) if met(threshold, d) >= recall), 1)


def depths(least: int) -> list[int]:
    """The depths of the turns, down to ``least``."""
    return [*range(DEPTH, least, -STEP), least]


def shingles(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; of a text with fewer words, none."""
    return [s for s, _ in _sets(texts)]


def _sets(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Shingles and word hashes of each text."""
    lower = pa.array([(t or "").lower() for t in texts], pa.large_string())
    found = pc.split_pattern_regex(lower, r"[^\p{L}\p{N}]+")
    coded = found.values.dictionary_encode()
    of_word = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little") for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    empty = np.array([not w for w in coded.dictionary.to_pylist()], dtype=bool)
    index, at = coded.indices.to_numpy(), found.offsets.to_numpy()
    keep = ~empty[index] if len(index) else np.zeros(0, bool)
    hashes = of_word[index][keep] if len(index) else np.zeros(0, np.uint64)
    at = np.concatenate([[0], np.cumsum(keep)])[at]
    out = []
    with np.errstate(over="ignore"):
        h = np.zeros(max(len(hashes) - WIDTH + 1, 0), dtype=np.uint64)
        for k in range(WIDTH):
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + hashes[k : k + len(h)]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
    for a, b in zip(at[:-1], at[1:], strict=True):
        out.append((np.unique(h[a : max(b - WIDTH + 1, a)]), hashes[a:b]))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """TREES numbers of each non-empty set, a byte for each of DEPTH MinHash values, the first one uppermost."""
    out = np.zeros((len(sets), TREES), dtype=np.uint64)
    if sets:
        x, at = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32), np.cumsum([0, *map(len, sets)])[:-1]
        with np.errstate(over="ignore"):
            for k in range(TREES * DEPTH):
                least = np.minimum.reduceat(x * _ODD[0, k] + _ODD[1, k], at)
                byte = ((least ^ (least >> np.uint32(15))) * np.uint32(0x9E3779B1)) >> np.uint32(24)
                out[:, k // DEPTH] |= byte.astype(np.uint64) << np.uint64(56 - 8 * (k % DEPTH))
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, row, key, signature): the key is a 128-bit hash of the shingle set, or of the words where there are too few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(2), SLICE_CHARS):
                sets = _sets(texts)
                keys = [hashlib.blake2b(s.tobytes() if len(s) else b"words" + w.tobytes(), digest_size=16).digest() for s, w in sets]
                full = [k for k, (s, _) in enumerate(sets) if len(s)]
                sig = signatures([sets[k][0] for k in full])
                raw: list = [None] * (b - a)
                for k, row in zip(full, sig.view(np.int64), strict=True):
                    raw[k] = row
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(keys, pa.binary()), pa.array(raw, pa.list_(pa.int64()))], names=["doc_id", "row", "key", "signature"])

    return docs.select(F.col("doc_id").cast("long"), _row().alias("row"), "text").mapInArrow(run, "doc_id long, row long, key binary, signature array<long>")


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many upper bytes are equal."""
    x, n = a ^ b, np.zeros(len(a), np.int8)
    for k in range(DEPTH):
        n += x >> np.uint64(56 - 8 * k) == 0
    return n


def stretch(tree: np.ndarray, value: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a sorted stretch of the forest, the runs of one depth: where each begins (and the end), and which of them have another member here or reach an edge."""
    begin = np.concatenate([[True], (common_prefix(value[1:], value[:-1]) < depth) | (tree[1:] != tree[:-1])])
    at = np.append(np.flatnonzero(begin), len(tree))
    wanted = np.diff(at) > 1
    wanted[[0, -1]] = True
    return at, wanted


def forest(classes: DataFrame, least: int) -> DataFrame:
    """(depth, node, head, trees): each class tied to the least class of its run, for each of the ``depths``, with the number of trees in which that holds."""
    each = classes.where("signature IS NOT NULL").select(F.col("key").alias("node"), F.posexplode("signature").alias("tree", "value"))
    # with the sign bit turned, signed order is the order of the bytes
    dealt = each.select("tree", F.col("value").bitwiseXOR(F.lit(-(1 << 63))).alias("value"), "node").repartitionByRange("tree", "value", "node").sortWithinPartitions("tree", "value", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # a partition of the sort
        if not held:
            return
        whole = pa.Table.from_batches(held).combine_chunks()
        tree, value, nodes = whole["tree"].to_numpy(), (whole["value"].to_numpy() ^ np.int64(-(1 << 63))).view(np.uint64), whole["node"].chunk(0)
        order = pc.array_sort_indices(nodes).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        for depth in depths(least):
            at, wanted = stretch(tree, value, depth)
            size = np.diff(at)
            head = order[np.minimum.reduceat(rank, at[:-1])]
            edge = np.zeros(len(size), bool)
            edge[[0, -1]] = True
            rows, of = np.flatnonzero(np.repeat(wanted, size)), np.repeat(np.flatnonzero(wanted), size[wanted])
            for k in range(0, len(rows), 50_000):
                own, r = rows[k : k + 50_000], of[k : k + 50_000]
                heads = nodes.take(pa.array(head[r], mask=edge[r]))
                prefix = (value[own] >> np.uint64(64 - 8 * depth)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), depth, np.int32)), nodes.take(pa.array(own)), heads, pa.array(tree[own]), pa.array(prefix)], names=["depth", "node", "head", "tree", "prefix"])

    ties = cut(dealt.mapInArrow(run, TIES))
    heads = ties.where("head IS NULL").groupBy("depth", "tree", "prefix").agg(F.min("node").alias("least"))  # at most two for each depth and partition
    ties = ties.join(F.broadcast(heads), ["depth", "tree", "prefix"], "left").select("depth", "node", F.coalesce("head", "least").alias("head"))
    return cut(ties.where("node <> head").groupBy("depth", "node", "head").agg(F.count("*").alias("trees")))


def _verify(rows: list[tuple], group: int, same_block: bool, threshold: float, least: int) -> Iterator[tuple]:
    """(node, links, chances, head) of the classes of a block pair that have links; rows: (node, block, copies, groups, shingles). ``chances`` has, for each depth from ``least``, the sum over links of one over the chance to be met."""
    n = len(rows)
    sets = [r[4] for r in rows]
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    block = np.array([r[1] for r in rows])
    if n <= 6:
        shared = np.zeros((n, n))
        for a in range(n):
            for b in range(a):
                if min(sizes[a], sizes[b]) >= threshold * max(sizes[a], sizes[b]):
                    shared[a, b] = shared[b, a] = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
    else:
        values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(n), sizes.astype(np.int64))
        keep = counts[inverse] > 1
        place = np.cumsum(counts > 1) - 1
        owner, column, width = owner[keep], place[inverse[keep]], int((counts > 1).sum())
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        shared = np.zeros((n, n), dtype=np.float64)
        for c in range(0, width, 4096):
            a, b = np.searchsorted(column, [c, c + 4096])
            dense = np.zeros((n, min(4096, width - c)), dtype=np.float32)
            dense[owner[a:b], column[a:b] - c] = 1
            shared += dense @ dense.T
    jaccard = shared / np.maximum(sizes[:, None] + sizes - shared, 1)
    linked = shared >= threshold * (sizes[:, None] + sizes - shared) - 1e-9
    np.fill_diagonal(linked, False)
    if not same_block:
        linked &= block[:, None] != block
    # pairs that an earlier group holds together count there
    before = {g: k for k, g in enumerate(sorted({g for r in rows for g in r[3] if g < group}))}
    if before:
        member = np.zeros((n, len(before)), np.float32)
        for a, r in enumerate(rows):
            member[a, [before[g] for g in r[3] if g < group]] = 1
        linked &= member @ member.T == 0
    copies = np.array([r[2] for r in rows], dtype=np.float64)
    links = linked @ copies
    chances = np.stack([np.where(linked, 1 / met(np.where(linked, jaccard, 1.0), d), 0) @ copies for d in range(least, DEPTH + 1)], axis=1)
    root = np.full(n, -1)
    for a in range(n):  # spanning forest
        if root[a] < 0 and links[a]:
            front, root[a] = [a], a
            while front:
                reach = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
                root[reach] = a
                front = reach.tolist()
    for a in range(n):
        if links[a]:
            yield rows[a][0], int(links[a]), chances[a].tolist(), rows[root[a]][0]


def shingled(docs: DataFrame, classes: DataFrame, ties: DataFrame) -> DataFrame:
    """(node, copies, shingles) of the classes that are tied at some depth. Rows that repeat an id and a text are repeated."""
    tied = ties.select("node").unionByName(ties.select(F.col("head").alias("node"))).distinct()
    chosen = cut(tied.join(classes.select(F.col("key").alias("node"), "copies", "row"), "node"))
    whole = docs.select(_row().alias("row"), "text").join(_small(chosen), "row")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in text_slices(batch.column(0), SLICE_CHARS):
                raw = [s.tobytes() for s in shingles(texts)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[a:b] for c in (1, 2)), pa.array(raw, pa.binary())], names=["node", "copies", "shingles"])

    return cut(whole.select("text", "node", "copies").mapInArrow(shingle, "node binary, copies long, shingles binary"))


def grouped(ties: DataFrame, turn: int) -> DataFrame:
    """(node, group): the groups of ties of one depth. A head that shares ``STRONG`` trees with a lesser head goes with it, twice over, so that a family of copies is one group mostly; groups are numbered so that those of later turns are greater."""
    top = ties.where(F.col("trees") >= STRONG).groupBy("node").agg(F.min("head").alias("top"))
    heads = ties.select("head").distinct()
    for _ in range(2):
        heads = heads.withColumn("now", F.col("now") if "now" in heads.columns else F.col("head"))
        heads = heads.join(top.select(F.col("node").alias("now"), "top"), "now", "left").select("head", F.coalesce("top", "now").alias("now"))
    named = heads.select("head", (F.lit(turn << 58).bitwiseOR(F.shiftrightunsigned(F.xxhash64("now"), 6))).alias("group"))
    return cut(ties.select("node", "head").join(named, "head").select("node", "group").unionByName(named.select(F.col("head").alias("node"), "group")).distinct())


def fresh(members: DataFrame, earlier: DataFrame | None) -> DataFrame:
    """``members`` without the groups that an earlier group holds whole."""
    if earlier is None:
        return members
    both = members.join(earlier.select("node", F.col("group").alias("old")), "node").groupBy("group", "old").agg(F.count("*").alias("n"))
    most = both.groupBy("group").agg(F.max("n").alias("n"))
    sizes = members.groupBy("group").agg(F.count("*").alias("n"))
    return cut(members.join(sizes.join(most, ["group", "n"], "left_anti").select("group"), "group", "left_semi").select("node", "group"))


def verified(sets: DataFrame, members: DataFrame, all_members: DataFrame, threshold: float, least: int) -> DataFrame:
    """(node, links, chances, head) for each class and block pair with links."""
    sizes = members.groupBy("group").agg(F.count("*").alias("size")).where("size > 1").select("group", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(sizes, "group").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    groups = all_members.groupBy("node").agg(F.collect_set("group").alias("groups"))
    dealt = sets.join(placed, "node").join(groups, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "node", "block", "copies", "groups", "shingles")
    schema = pa.schema([("node", pa.binary()), ("links", pa.int64()), ("chances", pa.list_(pa.float64())), ("head", pa.binary())])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(key, rows):
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in _verify(rows, key[0], key[1] == key[2], threshold, least)], schema=schema)

        key, rows = None, []
        for batch in batches:
            for group, i, j, node, block, copies, groups_, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (group, i, j) != key:
                    if len(rows) > 1:
                        yield done(key, rows)
                    key, rows = (group, i, j), []
                if not rows or rows[-1][0] != node:  # repeated rows have the same text
                    rows.append((node, block, copies, groups_, np.frombuffer(raw, np.uint64)))
        if len(rows) > 1:
            yield done(key, rows)

    return dealt.repartition("group", "i", "j").sortWithinPartitions("group", "i", "j", "node").mapInArrow(verify, "node binary, links long, chances array<double>, head binary")


def closed(found: DataFrame, depth: int, least: int, threshold: float, recall: float) -> DataFrame:
    """(node) of the classes whose recall at this depth is estimated to reach the target: links found, and one at the threshold, over what they stand for."""
    stats = found.groupBy("node").agg(F.sum("links").alias("n"), F.sum(F.element_at("chances", depth - least + 1)).alias("stand"))
    return stats.where((F.col("n") + 1) / (F.col("stand") + float(1 / met(threshold, depth))) >= recall).select("node")


def _row():
    """A name for a row by its id and text, which doesn't depend on partitions."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.coalesce("text", F.lit("")))


def links(docs: DataFrame, classes: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(node, links, chances, head, depth): what each depth's turn verified, from the longest prefixes on, until no class is open."""
    least = last_depth(threshold, recall)
    ties = forest(classes, least)
    sets = shingled(docs, classes, ties)
    found = all_members = None
    turns = depths(least)
    for turn, depth in enumerate(turns):
        own = ties.where(F.col("depth") == depth).select("node", "head", "trees")
        if found is not None:
            done = closed(found, turns[turn - 1], least, threshold, recall)
            still = own.select("head").unionByName(own.select(F.col("node").alias("head"))).distinct().join(done.withColumnRenamed("node", "head"), "head", "left_anti")  # open classes
            heads = still.unionByName(own.join(still.withColumnRenamed("head", "node"), "node", "left_semi").select("head")).distinct()
            own = own.join(heads, "head", "left_semi")
        members = fresh(grouped(own, turn), all_members)
        all_members = members if all_members is None else all_members.unionByName(members)
        new = cut(verified(sets, members, all_members, threshold, least).withColumn("depth", F.lit(depth)))
        found = new if found is None else found.unionByName(new)
    return found


def join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links) for every row."""
    rows = docs.select("doc_id", "text")
    known = cut(keyed(rows))
    classes = cut(known.groupBy("key").agg(F.min("doc_id").alias("least"), F.min("row").alias("row"), F.count("*").alias("copies"), F.first("signature").alias("signature")))
    found = links(rows, classes, threshold, recall)
    groups = connected_components(found.select(F.col("node").alias("a"), F.col("head").alias("b")), cut)
    named = groups.join(classes.select(F.col("key").alias("node"), "least"), "node")
    least = named.groupBy("root").agg(F.min("least").alias("class_id"))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    final = classes.select(F.col("key").alias("node"), "least", "copies").join(named.select("node", "root").join(least, "root").select("node", "class_id"), "node", "left").join(counted, "node", "left")
    final = cut(final.select(F.col("node").alias("key"), F.coalesce("class_id", "least").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "copies"))
    # a class with very many copies goes by broadcast, so that no task gets them all
    hot = F.col("copies") > HOT * (classes.agg(F.sum("copies")).first()[0] or 0)
    often = F.broadcast(final.where(hot))
    by_key = known.join(often.select("key"), "key", "left_anti").join(final.where(~hot), "key")
    return by_key.select("doc_id", "class_id", "n_links").unionByName(known.join(often, "key").select("doc_id", "class_id", "n_links"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each class, the one with the least doc_id, and one of its repeated rows. Rows without doc_id stay."""
    found = cut(join(docs, threshold).select("doc_id", "class_id"))
    gone = cut(found.where("doc_id <> class_id").select("doc_id").distinct())
    rest = docs.join(_small(gone), "doc_id", "left_anti").select(*docs.columns)
    again = cut(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    if again.isEmpty():
        return rest
    again = _small(again)
    return rest.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(rest.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def op1_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
