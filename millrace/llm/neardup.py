"""Near-duplicate texts: signature trees over blocks that rare shared word runs lead to.

Two texts are alike if enough of their distinct three-word sequences (shingles)
are the same.  Finding all such pairs takes three steps, none of which loses one:

1. Routing.  In one order of all shingles, rare ones first, two alike texts
   must share at least ``SHARED`` shingles near the start of their ordered lists.  Those entries
   are grouped by shingle; a group is traversed by size, and members whose
   sizes and remaining lengths leave no room for the overlap needed are pruned.
   Pairs that meet in ``SHARED`` groups go on.
2. Signature trees.  Texts that go on meet in blocks.  A block holds a tree of
   its left and one of its right members; nodes have the OR of their members'
   shingle bitmaps and their range of sizes.  A dual traversal descends only
   into node pairs whose maximum possible overlap suffices.
3. The pairs of leaves that are left are compared shingle by shingle.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import cut_lineage, spread, unzipped as _unzip, zipped as _zip

#: Shingles that alike texts have to share near the start of their ordered lists.
SHARED = 4
#: Texts whose shingle counts tell rare from frequent ones. Any order gives the same pairs.
SAMPLE_TEXTS = 30_000
#: Candidates that meet in a block on average.
BLOCK_PAIRS = 300
#: Bits of a leaf's bitmap.
BITS = 1024
FANOUT = 8

_K = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)]


_WORD = re.compile(r"[一-鿿]|[^\W_一-鿿]+")
_TO_BLANKS = {c: " " for c in range(128) if not chr(c).isalnum()}


def words_of(text: str) -> list[str]:
    low = text.lower()
    return low.translate(_TO_BLANKS).split() if low.isascii() else _WORD.findall(low)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest(word) >> 1
        return v


class Shingler:
    """Distinct word sequences of a text as sorted 64-bit hashes, the same in every process."""

    def __init__(self, least_words: int, words: int):
        self.least_words, self.words = least_words, words
        self._hash = _Hashes().__getitem__

    def __call__(self, text: str | None) -> np.ndarray:
        found = words_of(text) if text else []
        if len(found) < max(self.least_words, self.words):
            return np.empty(0, np.uint64)
        a = np.fromiter(map(self._hash, found), np.int64, len(found)).view(np.uint64)
        n = len(a) - self.words + 1
        h = a[:n].copy()
        for i in range(1, self.words):
            h ^= h >> np.uint64(29)
            h *= _K[i % 3]
            h += a[i : i + n]
        h ^= h >> np.uint64(32)
        h *= _K[0]
        h ^= h >> np.uint64(29)
        h.sort()
        new = np.empty(n, bool)
        new[0] = True
        np.not_equal(h[1:], h[:-1], out=new[1:])
        return h[new]


@functools.lru_cache(maxsize=4)
def _shingler(least_words: int, words: int) -> Shingler:
    return Shingler(least_words, words)


def needed(a, b, similarity: float):
    """Smallest overlap of sets of sizes a and b with that Jaccard similarity."""
    return np.ceil(np.round((a + b) * (similarity / (1 + similarity)), 9)).astype(np.int64)


def _entries(keys: np.ndarray, sets: list[np.ndarray], frequent: np.ndarray, counts: np.ndarray, similarity: float) -> tuple[np.ndarray, ...]:
    """(shingle, text, size, remaining) of the first shingles of each text in the common order."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    if len(frequent):
        p = np.minimum(np.searchsorted(frequent, flat), len(frequent) - 1)
        weight = np.where(frequent[p] == flat, counts[p], 0).astype(np.uint64)
    else:
        weight = np.zeros(len(flat), np.uint64)
    # sets are sorted by hash already; a stable sort by (owner, weight) keeps that order among equals
    order = np.argsort((owner.astype(np.uint64) << np.uint64(32)) | weight, kind="stable")
    flat, owner = flat[order], owner[order]
    start = np.repeat(np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
    place = np.arange(len(flat)) - start
    size = sizes[owner]
    # the partner can be as small as similarity * size; then the overlap needed is similarity * size
    first = size - np.ceil(np.round(similarity * size, 9)).astype(np.int64) + SHARED
    keep = place < first
    flat, text, size, rest = flat[keep], keys[owner[keep]], size[keep], (size - place - 1)[keep]
    # so small sets can be alike with fewer than SHARED in common: each entry counts as SHARED
    tiny = np.flatnonzero(size <= (SHARED - 1) * (1 + similarity) / similarity)
    if len(tiny):
        again = np.tile(tiny, SHARED - 1)
        salt = np.repeat(np.arange(1, SHARED, dtype=np.uint64), len(tiny)) * _K[1]
        flat = np.concatenate([flat, flat[again] ^ salt])
        text, size, rest = (np.concatenate([v, v[again]]) for v in (text, size, rest))
    return flat, text, size, rest


def _pairs_of_groups(shingle: np.ndarray, text: np.ndarray, size: np.ndarray, rest: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (smaller key first) of texts that meet in a group and can still be alike.

    Entries are sorted by (shingle, size); a member is held against those after
    it in its group, nearest size first, and the traversal of a group ends where sizes differ too much.
    """
    order = np.lexsort((text, size, shingle))
    shingle, text, size, rest = shingle[order], text[order], size[order], rest[order]
    dup = np.r_[False, (shingle[1:] == shingle[:-1]) & (text[1:] == text[:-1])]
    if dup.any():
        shingle, text, size, rest = (x[~dup] for x in (shingle, text, size, rest))
    a = np.flatnonzero(np.r_[shingle[1:] == shingle[:-1], False]) if len(shingle) else np.empty(0, np.int64)
    left, right, step = [], [], 0
    while len(a):
        step += 1
        b = a + step
        ok = b < len(shingle)
        a, b = a[ok], b[ok]
        ok = (shingle[a] == shingle[b]) & (size[a] >= similarity * size[b])
        a, b = a[ok], b[ok]
        fits = SHARED + np.minimum(rest[a], rest[b]) >= needed(size[a], size[b], similarity)
        x, y = text[a[fits]], text[b[fits]]
        left.append(np.minimum(x, y)), right.append(np.maximum(x, y))
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x, y = np.concatenate(left), np.concatenate(right)
    ok = x != y
    return x[ok], y[ok]


class SignatureTree:
    """Nodes with OR-combined bitmaps and size ranges over texts sorted by content."""

    def __init__(self, sets: list[np.ndarray], bits: int = BITS):
        self.sets = sets
        self.sizes = np.array([len(s) for s in sets])
        leaf = np.zeros((len(sets), bits // 64), np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        bit = np.concatenate(sets) % np.uint64(bits)
        np.bitwise_or.at(leaf, (owner, (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
        # texts with equal smallest shingles tend to be alike: neighbours in this order share a node
        order = np.lexsort((self.sizes, [int(s[0]) if len(s) else 0 for s in sets]))
        self.order, bitmap, low = order, leaf[order], self.sizes[order]
        high = low
        # shingles of a member that fall on bits other shingles of it took: they may be shared unseen
        unseen = low - np.bitwise_count(bitmap).sum(1, dtype=np.int64)
        self.levels = [(bitmap, low, high, unseen)]
        while len(low) > 1:
            cut = np.arange(0, len(low), FANOUT)
            bitmap = np.bitwise_or.reduceat(bitmap, cut, axis=0)
            low, high, unseen = np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut), np.maximum.reduceat(unseen, cut)
            self.levels.append((bitmap, low, high, unseen))


def dual_traversal(a: SignatureTree, b: SignatureTree, similarity: float) -> Iterator[tuple[int, int]]:
    """Pairs of leaves (positions in the trees' sets) whose maximum possible overlap suffices."""
    depth = max(len(a.levels), len(b.levels)) - 1
    x, y = np.zeros(1, np.int64), np.zeros(1, np.int64)
    while True:
        la, lb = min(depth, len(a.levels) - 1), min(depth, len(b.levels) - 1)
        (bm_a, lo_a, hi_a, un_a), (bm_b, lo_b, hi_b, un_b) = a.levels[la], b.levels[lb]
        ok = (hi_a[x] >= similarity * lo_b[y]) & (hi_b[y] >= similarity * lo_a[x])
        x, y = x[ok], y[ok]
        common = np.empty(len(x), np.int64)
        for i in range(0, len(x), 8192):
            common[i : i + 8192] = np.bitwise_count(bm_a[x[i : i + 8192]] & bm_b[y[i : i + 8192]]).sum(1, dtype=np.int64)
        most = np.minimum(np.minimum(common + un_a[x], common + un_b[y]), np.minimum(hi_a[x], hi_b[y]))
        ok = most >= needed(lo_a[x], lo_b[y], similarity)
        x, y = x[ok], y[ok]
        if depth == 0:
            break
        depth -= 1
        x, y = _children(x, y, len(a.levels) - 1 > depth, len(b.levels) - 1 > depth, a.levels, b.levels, depth)
    yield from zip(a.order[x].tolist(), b.order[y].tolist(), strict=True)


def _children(x, y, down_a, down_b, levels_a, levels_b, depth):
    """All pairs of children of the node pairs, on the level below."""
    for side in (0, 1):
        if not (down_a, down_b)[side]:
            continue
        n = len((levels_a, levels_b)[side][depth][1])
        node = (x, y)[side]
        child = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        other = np.repeat((y, x)[side], FANOUT)
        ok = child < n
        x, y = (child[ok], other[ok]) if side == 0 else (other[ok], child[ok])
    return x, y


def alike_classes(texts: DataFrame, *, text_col: str, similarity: float, least_words: int, words: int = 3) -> DataFrame:
    """``key_a, key_b`` (key_a < key_b): distinct texts at least so similar, by the 64-bit key of the text.

    Equal texts have one key and make no pair here.  Texts that are null or
    have fewer than ``least_words`` words are alike to none.
    """
    spark = texts.sparkSession
    rows = spread(texts.select(F.col(text_col).alias("text")).where("text IS NOT NULL")).select(F.xxhash64("text").alias("key"), "text")
    total = rows.count()
    share = min(1.0, SAMPLE_TEXTS / max(total, 1))
    sampled = rows.where(F.pmod(F.col("key"), F.lit(1_000_003)) < F.lit(int(share * 1_000_003) + 1)).select("text").limit(2 * SAMPLE_TEXTS)

    def count_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = _shingler(least_words, words)
        sets = [make(t) for b in batches for t in set(b.column(0).to_pylist())]
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        u, n = np.unique(flat, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(n.astype(np.int32))], names=["h", "n"])

    counted = sampled.mapInArrow(count_part, "h long, n int").groupBy("h").agg(F.sum("n").cast("int").alias("n")).where("n > 1").toArrow()
    h, n = counted.column("h").to_numpy().view(np.uint64), counted.column("n").to_numpy()
    order = np.argsort(h)
    frequent = spark.sparkContext.broadcast((h[order], n[order]))  # bounded by the sample

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-total // 8_000))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = _shingler(least_words, words)
        f, c = frequent.value
        seen: set[int] = set()
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            keys = np.array([k for k, _ in held], np.int64)
            shingle, text, size, rest = _entries(keys, [s for _, s in held], f, c, similarity)
            bucket = (shingle >> np.uint64(32)) % np.uint64(buckets)
            order = np.lexsort((shingle.astype(np.uint32), bucket))
            shingle, text, size, rest, bucket = (x[order] for x in (shingle, text, size, rest, bucket))
            # texts by number in a table that goes along once, sizes with them
            edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.empty(0, np.int64)
            out = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                key, number = np.unique(text[a:b], return_inverse=True)
                key_size = np.zeros(len(key), np.int32)
                key_size[number] = size[a:b]
                low = shingle[a:b].astype(np.uint32)
                gap = np.diff(low, prepend=np.uint32(0))
                out.append((int(bucket[a]), _zip(key), _zip(key_size), _zip(gap), _zip(number.astype(np.int32)), _zip(rest[a:b].astype(np.int32))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["bucket", "keys", "sizes", "gaps", "numbers", "rests"])
            held.clear()

        total_held = 0
        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key in seen:
                    continue
                if len(seen) > 1_000_000:  # only saves work: equal texts are told apart by their key later on
                    seen.clear()
                seen.add(key)
                s = make(t)
                if len(s):
                    held.append((key, s))
                    total_held += len(s)
                if total_held > 3_000_000:
                    yield from flush()
                    total_held = 0
        if held:
            yield from flush()

    packed = rows.mapInArrow(entries, "bucket long, keys binary, sizes binary, gaps binary, numbers binary, rests binary")

    def meet(table: pa.Table) -> pa.Table:
        cols = []
        for row in table.to_pylist():
            (key,), (key_size,), (gap,), (number,), (rest,) = (
                _unzip(row[c], [k]) for c, k in (("keys", np.int64), ("sizes", np.int32), ("gaps", np.uint32), ("numbers", np.int32), ("rests", np.int32))
            )
            cols.append((np.cumsum(gap, dtype=np.uint32), key[number], key_size[number].astype(np.int64), rest.astype(np.int64)))
        shingle, text, size, rest = (np.concatenate(x) for x in zip(*cols, strict=True))
        x, y = _pairs_of_groups(shingle, text, size, rest, similarity)
        # by block of the pair, compressed: what is counted next is how often a pair came up
        block = (x.view(np.uint64) >> np.uint64(16)) % np.uint64(buckets)
        order = np.lexsort((y, x, block))
        x, y, block = x[order], y[order], block[order]
        edges = np.flatnonzero(np.r_[True, block[1:] != block[:-1], True]) if len(block) else np.empty(0, np.int64)
        out = [(int(block[a]), _zip(x[a:b], y[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        return pa.table({"block": pa.array([o[0] for o in out], pa.int64()), "pairs": pa.array([o[1] for o in out], pa.binary())})

    met = packed.groupBy("bucket").applyInArrow(meet, "block long, pairs binary")

    def count(table: pa.Table) -> pa.Table:
        parts = [_unzip(p, [np.int64, np.int64]) for p in table.column("pairs").to_pylist()]
        x, y = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        edge = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]), True])
        often = np.diff(edge) >= SHARED
        first = edge[:-1][often]
        return pa.table({"key_a": pa.array(x[first]), "key_b": pa.array(y[first])})

    candidates = cut_lineage(met.groupBy("block").applyInArrow(count, "key_a long, key_b long"))
    return _verify(rows, candidates, similarity, least_words, words)


def _verify(rows: DataFrame, candidates: DataFrame, similarity: float, least_words: int, words: int) -> DataFrame:
    """Signature trees over the members of blocks of candidates."""
    spark = rows.sparkSession
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-candidates.count() // BLOCK_PAIRS))
    sides = candidates.select(F.pmod(F.col("key_a"), F.lit(blocks)).alias("block"), "key_a", "key_b")
    members = (
        sides.select("block", F.col("key_a").alias("key"), F.lit(0).alias("side"))
        .union(sides.select("block", F.col("key_b").alias("key"), F.lit(1).alias("side")))
        .distinct()
    )

    texts = rows.join(members.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])

    def compare(table: pa.Table) -> pa.Table:
        make = _shingler(least_words, words)
        keys, side = table.column("key").to_numpy(), table.column("side").to_numpy()
        sets = [make(t) for t in table.column("text").to_pylist()]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b = SignatureTree([sets[i] for i in left]), SignatureTree([sets[i] for i in right])
        out_a, out_b = [], []
        for i, j in dual_traversal(a, b, similarity):
            x, y = keys[left[i]], keys[right[j]]
            if x < y:
                s, t = a.sets[i], b.sets[j]
                both = len(np.intersect1d(s, t, assume_unique=True))
                if both >= needed(len(s), len(t), similarity):
                    out_a.append(x), out_b.append(y)
        return pa.table({"key_a": pa.array(out_a, pa.int64()), "key_b": pa.array(out_b, pa.int64())})

    found = members.join(texts, "key").groupBy("block").applyInArrow(compare, "key_a long, key_b long")
    return cut_lineage(found.distinct())


def alike_pairs(
    records: DataFrame,
    *,
    id_col: str = "chunk_id",
    text_col: str = "text",
    similarity: float = 0.5,
    least_words: int = 60,
    words: int = 3,
) -> DataFrame:
    """``id_a, id_b`` with id_a < id_b: ids whose texts are alike, equal texts included.

    Texts with fewer than ``least_words`` words, null and empty ones among
    them, are in no pair; rows without an id are left out.  If an id has several
    texts each of them counts.  Repeated rows and other columns change nothing.
    """
    rows = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    owners = cut_lineage(rows.select(F.xxhash64("text").alias("key"), "id").distinct())
    classes = alike_classes(records, text_col=text_col, similarity=similarity, least_words=least_words, words=words)
    a = owners.select(F.col("key").alias("key_a"), F.col("id").alias("x"))
    b = owners.select(F.col("key").alias("key_b"), F.col("id").alias("y"))
    different = classes.join(a, "key_a").join(b, "key_b").select("x", "y")
    several = owners.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    long = _long_enough(rows.select(F.xxhash64("text").alias("key"), "text").join(several, "key", "left_semi").dropDuplicates(["key"]), least_words)
    again = owners.join(long, "key", "left_semi")
    equal = again.join(again.withColumnRenamed("id", "other"), "key").where("id < other").select(F.col("id").alias("x"), F.col("other").alias("y"))
    both = different.unionByName(equal).where("x != y")
    return both.select(F.least("x", "y").alias(f"{id_col}_a"), F.greatest("x", "y").alias(f"{id_col}_b")).distinct()


def _long_enough(texts: DataFrame, least_words: int) -> DataFrame:
    """Keys of texts with at least so many words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [len(words_of(t)) >= least_words for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_()))], names=["key"])

    return texts.mapInArrow(run, "key long")


def _components(pairs: DataFrame) -> DataFrame:
    """``key, group``: the smallest key that each key of the pairs (key_a, key_b) is connected with.

    Rounds of large and small stars: every key links its larger, then its
    smaller neighbours to the smallest of them, until nothing changes.  No
    component meets in one task; a round's links are at most those before.
    """
    links = cut_lineage(pairs.select(F.greatest("key_a", "key_b").alias("u"), F.least("key_a", "key_b").alias("v")).where("u != v").distinct())
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        new = cut_lineage(small.where("u != v").distinct())
        if new.exceptAll(links).isEmpty() and links.exceptAll(new).isEmpty():
            break
        links = new
    tops = links.select(F.col("v").alias("key")).distinct().join(links.select(F.col("u").alias("key")), "key", "left_anti")
    return links.select(F.col("u").alias("key"), F.col("v").alias("group")).unionByName(tops.select("key", F.col("key").alias("group")))


def alike_groups(
    records: DataFrame,
    *,
    id_col: str = "chunk_id",
    text_col: str = "text",
    similarity: float = 0.5,
    least_words: int = 60,
    words: int = 3,
) -> DataFrame:
    """``id, group_id, links``: one row for each id whose text is alike to that of another one.

    ``group_id`` is the smallest id that it is connected with, directly or by
    others; ``links`` counts the ids directly alike to it, copies of its own
    text included.  Pairs are made between distinct texts only.  An id with
    several texts counts by the smallest group of them and by all its links.
    """
    rows = records.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    owners = cut_lineage(rows.select(F.xxhash64("text").alias("key"), "id").distinct())
    classes = alike_classes(records, text_col=text_col, similarity=similarity, least_words=least_words, words=words)
    copies = owners.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    several = copies.where("n > 1")
    long = cut_lineage(_long_enough(rows.select(F.xxhash64("text").alias("key"), "text").join(several.select("key"), "key", "left_semi").dropDuplicates(["key"]), least_words))
    directed = classes.unionByName(classes.select(F.col("key_b").alias("key_a"), F.col("key_a").alias("key_b")))
    outer = directed.join(copies.select(F.col("key").alias("key_b"), "n"), "key_b").groupBy(F.col("key_a").alias("key")).agg(F.sum("n").alias("links"))
    inner = several.join(long, "key", "left_semi").select("key", (F.col("n") - 1).alias("links"))
    links = outer.unionByName(inner).groupBy("key").agg(F.sum("links").alias("links"))
    groups = links.select("key", "links").join(_components(classes), "key", "left").select("key", "links", F.coalesce("group", "key").alias("group"))
    named = groups.join(copies.select("key", "first"), "key").groupBy("group").agg(F.min("first").alias("group_id"))
    each = owners.join(groups, "key").join(named, "group")
    return each.groupBy("id").agg(F.min("group_id").alias("group_id"), F.sum("links").alias("links")).withColumnRenamed("id", id_col)
