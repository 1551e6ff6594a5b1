"""Near-duplicate texts: every pair whose word sets are similar enough, without comparing all pairs.

A text's fingerprint is the bit set of its distinct words under a 64-bit hash; it is cut into ``SEGMENTS`` segments of
2**64 / SEGMENTS bits, and the text becomes the vector of bits set in each. Two texts that differ in d words differ by at most d in the Manhattan
distance of these vectors, so the distance is a lower bound of the difference, and texts whose word sets have a Jaccard
similarity of t lie within (1 - t) / (1 + t) of the sum of their sizes.

The range join runs over a grid whose lines are the units of count of each segment (its first bit, its second, ...), in
one order for all texts: segments with few bits over the whole collection first. Vectors within the distance share so
many units that two (one, for long texts) of the first few units of each are the same; those combinations are the
cells, and vectors meet in a cell. Inside a cell the counts of 32 groups of segments, packed in one number, bound the
Manhattan distance again; what is left is verified exactly, on the words. A cell too large for one task is handed out
block against block.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.operators.components import connected_components
from scriptorium.runtime import cut, shuffle_partitions, stored

#: Segments of the fingerprint. Their totals are the only collection statistic that reaches the driver.
SEGMENTS = 1 << 12
#: Texts of up to so many words meet in cells of two units; longer ones, whose rare units are many, in cells of one.
PAIRED_WORDS = 128
#: A cell's members are compared in blocks of so many; cells of more than SPREAD blocks against blocks leave their task.
BLOCK, SPREAD = 2048, 4

WORD_BREAK = "[\\s\\u001C-\\u001F\\u0085\\p{Z}]+"


def word_sets(df: DataFrame, id: str, text: str, least: int) -> DataFrame:
    """(id, class, words): the distinct words of each text with at least ``least`` of them, sorted and joined by a blank,
    which no word holds; texts with the same set of words have the same class."""
    rows = df.select(F.col(id).alias("id"), F.array_sort(F.array_distinct(F.filter(F.split(F.col(text), WORD_BREAK), lambda w: w != ""))).alias("words"))
    rows = rows.filter(F.col("id").isNotNull() & (F.size("words") >= least))
    return rows.select("id", F.array_join("words", " ").alias("words")).withColumn("class", F.md5("words"))


def prefix_sizes(n: np.ndarray, num: int, den: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """For texts of n words: how many first units to probe with (partner not larger) and to be found by (partner not
    smaller), so that any partner at similarity num/den or more shares ``level`` of them."""
    probe = n - -(-n * num // den) + level
    # With m = n the overlap is at least 2t/(1+t) n = 2 num / (den + num) n.
    found = n - -(-n * 2 * num // (den + num)) + level
    return np.minimum(probe, n), np.minimum(found, n)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def coarse(segments: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The 32-coordinate vectors as numbers of 32 times 2 bits; a coordinate stops at 3, which keeps the bound."""
    at = _mix(segments + 1) & np.uint64(31)
    counts = np.minimum(np.bincount(rows * 32 + at.astype(np.int64), minlength=32 * n).reshape(n, 32), 3).astype(np.uint64)
    return (counts << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(1, dtype=np.uint64)


_LOW = np.uint64(0x0303030303030303)


def _bytes(packed: np.ndarray) -> np.ndarray:
    four = np.stack([(packed >> np.uint64(s)) & _LOW for s in (0, 2, 4, 6)], 1)
    return four.view(np.int8)


def cells(segments: np.ndarray, sizes: np.ndarray, rank: np.ndarray, num: int, den: int):
    """(text, cell, may be found there) of texts given as the concatenated segments of their words."""
    n = len(sizes)
    rows = np.repeat(np.arange(n), sizes)
    order = np.lexsort((segments, rank[segments], rows))
    seg = segments[order].astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    # The k-th word of a text in one segment is unit k of that segment.
    new = np.r_[True, (seg[1:] != seg[:-1]) | (rows[1:] != rows[:-1])] if len(seg) else np.zeros(0, bool)
    since = np.maximum.accumulate(np.where(new, np.arange(len(seg)), 0)) if len(seg) else seg
    unit = _mix(seg * 4096 + (np.arange(len(seg)) - since) + 1)
    out = []
    paired = sizes <= PAIRED_WORDS
    single = -(-sizes * den // num) > PAIRED_WORDS  # some partner may have more words than meet in pairs
    for level, of in ((2, paired), (1, single)):
        probe, found = prefix_sizes(sizes, num, den, level)
        for p in np.unique(probe[of]):
            take = np.flatnonzero(of & (probe == p))
            u = unit[starts[take][:, None] + np.arange(p)]
            if level == 2:
                i, j = (np.array(x, np.int64) for x in zip(*itertools.combinations(range(p), 2))) if p > 1 else (np.zeros(0, np.int64),) * 2
                key, last = _mix(u[:, i] * np.uint64(0x9E3779B97F4A7C15) ^ u[:, j]), j
            else:
                key, last = _mix(u ^ np.uint64(0xD1B54A32D192ED03)), np.arange(p)
            flag = last[None, :] < found[take][:, None]
            out.append((np.repeat(take, key.shape[1]), key.ravel(), flag.ravel()))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out))


def _pack(ids: np.ndarray, sketch: np.ndarray, size: np.ndarray, text: np.ndarray, key: np.ndarray, flag: np.ndarray) -> bytes:
    used, local = np.unique(text, return_inverse=True)
    head = np.array([len(used), len(text)], np.int64)
    return b"".join((head.tobytes(), ids[used].tobytes(), sketch[used].tobytes(), size[used].astype(np.uint32).tobytes(), key.astype(np.uint32).tobytes(), (local.astype(np.uint32) * 2 + flag).tobytes()))


def _unpack(blob: bytes):
    u, n = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    at = 16
    out = []
    for count, kind in ((u, np.int64), (u, np.uint64), (u, np.uint32), (n, np.uint32), (n, np.uint32)):
        out.append(np.frombuffer(blob, kind, count, at))
        at += count * np.dtype(kind).itemsize
    return out


def _within_reach(a, b, size, vectors, num, den):
    """The pairs whose sizes and coarse vectors allow the similarity num/den."""
    sa, sb = size[a], size[b]
    ok = np.minimum(sa, sb) * den >= np.maximum(sa, sb) * num
    a, b = a[ok], b[ok]
    gap = np.abs(vectors[a] - vectors[b]).sum(1, dtype=np.int64)
    keep = gap * (den + num) <= (size[a] + size[b]) * (den - num)
    return a[keep], b[keep]


def similar_pairs(classes: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, shared): pairs a < b of rows of ``classes`` (id long, words joined by blanks) with |A ∩ B| / |A ∪ B| >= num / den."""
    spark = classes.sparkSession
    sized = classes.select("id", F.transform(F.split("words", " "), lambda w: F.shiftrightunsigned(F.xxhash64(w), 64 - SEGMENTS.bit_length() + 1).cast("int")).alias("segments"))
    totals = np.zeros(SEGMENTS, np.int64)
    for s, n in sized.select(F.explode("segments").alias("s")).groupBy("s").count().collect():  # at most SEGMENTS rows
        totals[s] = n
    rank = np.empty(SEGMENTS, np.int32)
    rank[np.argsort(totals, kind="stable")] = np.arange(SEGMENTS)
    shared_rank = spark.sparkContext.broadcast(rank)
    parts = shuffle_partitions(spark)

    def spread(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                piece = batch.slice(at, 20_000)
                ids = piece.column(0).to_numpy(zero_copy_only=False)
                lists = piece.column(1)
                segments = lists.flatten().to_numpy(zero_copy_only=False)
                sizes = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                text, key, flag = cells(segments, sizes, shared_rank.value, num, den)
                sketch = coarse(segments.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes), len(sizes))
                part = ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
                o = np.argsort(part, kind="stable")
                edges = np.searchsorted(part[o], np.arange(parts + 1))
                where, blobs = [], []
                for p in range(parts):
                    x = o[edges[p] : edges[p + 1]]
                    if len(x):
                        where.append(p)
                        blobs.append(_pack(ids, sketch, sizes, text[x], key[x], flag[x]))
                yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(blobs, pa.binary())], ["part", "cells"])

    def meet(batches):
        got = [_unpack(x.as_py()) for batch in batches for x in batch.column(0)]
        if not got:
            return
        base = np.cumsum([0, *[len(g[0]) for g in got]])
        ids, sketch, size, key = (np.concatenate([g[i] for g in got]) for i in range(4))
        text = np.concatenate([(g[4] >> 1).astype(np.int64) + b for g, b in zip(got, base)])
        flag = np.concatenate([(g[4] & 1).astype(bool) for g in got])
        del got
        vectors, size = _bytes(sketch), size.astype(np.int64)
        # In a cell the texts that may be found come first; the others only probe.
        o = np.lexsort((~flag, key))
        key, text, flag = key[o], text[o], flag[o]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(key)]
        found = np.add.reduceat(flag.astype(np.int64), starts) if len(starts) else starts
        some = (found > 0) & (ends - starts > 1)
        starts, ends, found = starts[some], ends[some], found[some]
        seen: list = []
        held = 0

        def flush():
            a, b = (np.concatenate(x) for x in zip(*seen))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            x, y = pairs[:, 0], pairs[:, 1]
            x, y = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
            keep = x != y
            return _found(x[keep], y[keep])

        # Cells of like shape are compared together: found texts against all that stand after them in the cell.
        work = found * (ends - starts) - found * (found + 1) // 2
        edges = np.r_[0, np.cumsum(work)]
        at = 0
        while at < len(work):
            to = max(at + 1, int(np.searchsorted(edges, edges[at] + BLOCK * BLOCK, "right")) - 1)
            if work[at] > SPREAD * BLOCK * BLOCK:
                to = at + 1
                members = text[starts[at] : ends[at]]
                yield from _handed_out(ids[members], sketch[members], size[members], int(found[at]))
                blocks = []
            elif work[at] > BLOCK * BLOCK:
                to = at + 1
                blocks = _large(int(starts[at]), int(ends[at]), int(found[at]))
            else:
                f = found[at:to]
                i = np.repeat(starts[at:to], f) + _within(f)
                rest = np.repeat(ends[at:to], f) - i - 1
                left = np.repeat(i, rest)
                blocks = [(left, left + 1 + _within(rest))]
            for left, right in blocks:
                a, b = _within_reach(text[left], text[right], size, vectors, num, den)
                if len(a):
                    seen.append((a, b))
                    held += len(a)
                if held > 2_000_000:
                    yield flush()
                    seen, held = [], 0
            at = to
        if seen:
            yield flush()

    def compare(batches):
        for batch in batches:
            for left, right, same in zip(*[c.to_pylist() for c in batch.columns]):
                (ia, sa, na), (ib, sb, nb) = _read_block(left), _read_block(right)
                ids, size, vectors = np.concatenate([ia, ib]), np.concatenate([na, nb]), _bytes(np.concatenate([sa, sb]))
                x, y = np.repeat(np.arange(len(ia)), len(ib)), len(ia) + np.tile(np.arange(len(ib)), len(ia))
                if same:
                    later = y - len(ia) > x
                    x, y = x[later], y[later]
                x, y = _within_reach(x, y, size, vectors, num, den)
                x, y = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
                yield _found(x[x != y], y[x != y], 2)

    met = stored(
        sized.mapInArrow(spread, "part int, cells binary")
        .repartitionById(parts, F.col("part"))
        .select("cells")
        .mapInArrow(meet, "a long, b long, left binary, right binary, same boolean")
    )
    tasks = met.filter("left is not null").select("left", "right", "same").repartition(parts)
    candidates = met.filter("a is not null").select("a", "b").unionByName(tasks.mapInArrow(compare, "a long, b long")).distinct()
    words_a = classes.select(F.col("id").alias("ia"), F.col("words").alias("wa"))
    words_b = classes.select(F.col("id").alias("ib"), F.col("words").alias("wb"))
    return (
        candidates.join(words_a, F.col("a") == F.col("ia"))
        .join(words_b, F.col("b") == F.col("ib"))
        .select("a", "b", F.split("wa", " ").alias("wa"), F.split("wb", " ").alias("wb"))
        .withColumn("shared", F.size(F.array_intersect("wa", "wb")))
        .filter(F.col("shared") * den >= (F.size("wa") + F.size("wb") - F.col("shared")) * num)
        .select("a", "b", "shared")
    )


def _within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _found(a: np.ndarray, b: np.ndarray, columns: int = 5) -> pa.RecordBatch:
    """Pairs found, as rows of the meeting."""
    blank = [pa.nulls(len(a), k) for k in (pa.binary(), pa.binary(), pa.bool_())]
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *blank][:columns], ["a", "b", "left", "right", "same"][:columns])


def _handed_out(ids: np.ndarray, sketch: np.ndarray, size: np.ndarray, found: int):
    """A large cell as rows of two blocks to be compared: those that may be found against all that stand after them."""
    def block(lo: int, hi: int) -> bytes:
        return b"".join((ids[lo:hi].astype(np.int64).tobytes(), sketch[lo:hi].astype(np.uint64).tobytes(), size[lo:hi].astype(np.int64).tobytes()))

    for i in range(0, found, BLOCK):
        # A block's end is the last that may be found, so that of two blocks all left ones may.
        left = block(i, min(i + BLOCK, found))
        rights = [(i, min(i + BLOCK, found), True), *[(j, j + BLOCK, False) for j in range(min(i + BLOCK, found), len(ids), BLOCK)]]
        for lo, hi, same in rights:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([left], pa.binary()), pa.array([block(lo, min(hi, len(ids)))], pa.binary()), pa.array([same])], ["a", "b", "left", "right", "same"])


def _read_block(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(blob) // 24
    return np.frombuffer(blob, np.int64, n), np.frombuffer(blob, np.uint64, n, 8 * n), np.frombuffer(blob, np.int64, n, 16 * n)


def _large(start: int, end: int, found: int):
    """Pairs of a cell too large to compare at once, block by block."""
    for i in range(start, start + found, BLOCK):
        left = np.arange(i, min(i + BLOCK, start + found))
        for j in range(i, end, BLOCK):
            right = np.arange(j, min(j + BLOCK, end))
            x, y = np.repeat(left, len(right)), np.tile(right, len(left))
            later = y > x
            yield x[later], y[later]


def _classes(df: DataFrame, id: str, text: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Members (id, rep) and representatives (id, words) of the texts with the same words; rep is the least id."""
    rows = word_sets(df, id, text, least)
    best = stored(rows.groupBy("class").agg(F.min("id").alias("id"), F.first("words").alias("words")))
    return rows.select(F.col("id").alias("member"), F.col("class").alias("c")).distinct(), best


def near_duplicate_groups(df: DataFrame, id: str = "element_id", text: str = "text_normalized", num: int = 7, den: int = 10, least: int = 15) -> DataFrame:
    """(id, group, links): every element with at least ``least`` distinct words, the least id of its group (elements
    linked directly or through others) and with how many elements it is similar itself.

    Copies are counted, not paired: links are between distinct word sets. An element without links is a group of its
    own; null and shorter texts have no row; an element delivered twice with one text counts once."""
    members, classes = _classes(df, id, text, least)
    kept = cut(members.join(classes.select(F.col("class"), F.col("id").alias("rep")), F.col("c") == F.col("class")).select("member", "rep"))
    pairs = cut(similar_pairs(classes.select("id", "words"), num, den).select("a", "b"))
    sizes = kept.groupBy("rep").agg(F.count("*").alias("n"))
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(sizes, F.col("b") == F.col("rep")).groupBy(F.col("a").alias("r")).agg(F.sum("n").alias("others"))
    groups = connected_components(pairs, "a", "b")
    told = sizes.join(others, F.col("rep") == F.col("r"), "left").join(groups, F.col("rep") == F.col("node"), "left")
    told = told.select(F.col("rep").alias("r"), F.coalesce("component", "rep").alias("group"), (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links"))
    found = kept.join(told, F.col("rep") == F.col("r")).select(F.col("member").alias(id), "group", "links")
    # An element delivered with two texts is in both groups' classes; the lesser group and the more links are its own.
    return found.groupBy(id).agg(F.min("group").alias("group"), F.max("links").alias("links"))


def near_duplicate_pairs(df: DataFrame, id: str = "element_id", text: str = "text_normalized", num: int = 7, den: int = 10, least: int = 15) -> DataFrame:
    """(element_a, element_b): pairs of different elements with at least ``least`` distinct words each whose common
    words are at least num/den of the words of either.

    Texts with the same set of words are compared once, through the one with the least id; the pairs of their members
    are made at the end, because the result asks for them. Null and shorter texts pair with nothing; an element
    delivered twice counts once; texts of any length are compared whole.
    """
    members, classes = _classes(df, id, text, least)
    kept = cut(members.join(classes.select(F.col("class"), F.col("id").alias("rep")), F.col("c") == F.col("class")).select("member", "rep"))
    pairs = similar_pairs(classes.select("id", "words"), num, den)
    a = kept.select(F.col("member").alias("x"), F.col("rep").alias("ra"))
    b = kept.select(F.col("member").alias("y"), F.col("rep").alias("rb"))
    between = pairs.join(a, F.col("a") == F.col("ra")).join(b, F.col("b") == F.col("rb")).select("x", "y")
    copies = kept.groupBy("rep").count().filter("count > 1").select("rep")
    several = kept.join(copies, "rep", "left_semi")
    inside = several.select(F.col("member").alias("x"), "rep").join(several.select(F.col("member").alias("y"), "rep"), "rep").filter("x < y").select("x", "y")
    both = between.unionByName(inside).filter("x <> y")
    return both.select(F.least("x", "y").alias("element_a"), F.greatest("x", "y").alias("element_b")).distinct()
