"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

A text's set holds its distinct shingles of consecutive words (ASCII letters lower-cased). Its signature comes from
two permutations: the first scatters the shingles over the circle of 32-bit integers, the second is turned by one
step for each further coordinate; a coordinate is the least image. Bands of ROWS coordinates are hashed into buckets.
With 32 bands of 5, two texts of similarity 0.8 miss all buckets with probability 3e-6.

Equal sets are one unit. Of all buckets with the same members one is kept. Links are then sought in rounds, each of
which costs at most a pair for each unit: first with the least unit of a bucket, then, in buckets that still hold
several components, with a pivot drawn anew. In these rounds sizes that rule a link out and signatures that disagree
in a quarter of their bits (six standard errors below similarity 0.8) are skipped. What is left is compared in full.
Buckets of more than LARGE blocks are first replaced by those of the units' rarest shingles: of n shingles, ordered by
how many of these units have them, the first n - 0.8 n + 1 of any two linked units have one in common, so no link is
lost, while texts that only share a template part. Then each unit outside its bucket's largest component with all units of other components, in blocks of bounded size,
each of which counts the common shingles of its texts at once and gives a spanning forest of its links, so no more
links than texts are emitted. All links are verified on whole sets. They are closed to components by star contraction, and the
least id names a component.

Buckets, copies and components are aggregated before any shuffle and joined from written tables, so large groups
are split over tasks. Null and empty texts have empty sets and no links; texts with fewer words than a shingle have
their whole word sequence as their only shingle. Rows that share an id are one document, which links to whatever
any of its texts links to. A null id is not linked: its component is null. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch, ship_by_value, stash, text_slices
from .components import components

BANDS, ROWS = 32, 5
COORDINATES = BANDS * ROWS
#: Rounds with drawn pivots before the rest is compared in full; pairs that are broadcast at most; units of a block.
PIVOT_ROUNDS, BROADCAST_PAIRS, BLOCK = 2, 200_000, 512
#: Blocks on a side beyond which a bucket is cut up by rarest shingles.
LARGE = 16
#: Shingles whose counts are made at once.
STRIPE = 1 << 12
#: Bits of a signature that two texts must share: of 160, 144 are expected at similarity 0.8, with a standard error of 3.8.
LEAST_BITS = 120
BATCH_BYTES, CHUNK = 1 << 19, 1 << 16
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
_random = np.random.default_rng(20240607)
BYTE_VALUES = _random.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in ascending order, one after another, and len(texts) + 1 offsets."""
    joined = (b" ".join(texts) + b" ").translate(LOWER)
    codes = np.frombuffer(joined, np.uint8)
    starts = np.r_[0, np.cumsum([len(t) + 1 for t in texts])]
    blank = SPACE[codes]
    edge = np.flatnonzero(np.diff(np.r_[True, blank].astype(np.int8)))
    begin, end = edge[0::2], edge[1::2]
    summed = np.r_[np.uint64(0), np.cumsum(BYTE_VALUES[codes] * _powers(BASE, len(codes)), dtype=np.uint64)]
    words = _mix((summed[end] - summed[begin]) * _powers(BASE_INVERSE, len(codes) + 1)[begin] + (end - begin).astype(np.uint64))
    ends = np.searchsorted(begin, starts)  # number of words before each text
    h = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        h = _mix(h + words[k : k + len(h)])
    sets = []
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        if b - a >= size:
            sets.append(np.unique(h[a : b - size + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for k in range(a, b):
                short = _mix(short + words[k : k + 1])
            sets.append(short)
        else:
            sets.append(h[:0])
    return np.concatenate(sets) if sets else h[:0], np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int64)


def _turned(x: np.ndarray, out: np.ndarray, spare: np.ndarray, k: int) -> np.ndarray:
    """The second permutation of the 32-bit integers, turned by k."""
    np.subtract(x, np.uint32(k), out=out)
    np.multiply(out, np.uint32(0x9E3779B1), out=out)
    np.right_shift(out, np.uint32(15), out=spare)
    np.bitwise_xor(out, spare, out=out)
    np.multiply(out, np.uint32(0x85EBCA77), out=out)
    np.right_shift(out, np.uint32(13), out=spare)
    return np.bitwise_xor(out, spare, out=out)


def signatures(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of COORDINATES for each set; sets may not be empty."""
    x = (_mix(hashes) >> np.uint64(32)).astype(np.uint32)
    out = np.empty((COORDINATES, len(offsets) - 1), np.uint32)
    at = 0
    while at < len(offsets) - 1:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + CHUNK, "right")) - 1)
        part = x[offsets[at] : offsets[to]]
        image, spare = np.empty_like(part), np.empty_like(part)
        first = offsets[at:to] - offsets[at]
        for k in range(COORDINATES):
            out[k, at:to] = np.minimum.reduceat(_turned(part, image, spare, k), first)
        at = to
    return out.T


def _bands(signature: np.ndarray) -> np.ndarray:
    folded = np.tile(np.arange(BANDS, dtype=np.uint64), (len(signature), 1))
    for k in range(ROWS):
        folded = _mix(folded + signature[:, k::ROWS].astype(np.uint64))
    return folded.view(np.int64)


def _bits(signature: np.ndarray) -> np.ndarray:
    """The lowest bit of each coordinate, in three 64-bit integers."""
    bits = np.zeros((len(signature), 192), np.uint8)
    bits[:, :COORDINATES] = signature & 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def _set_ids(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each set, 0 for an empty one."""
    out = []
    for salt in (1, 2):
        total = np.r_[np.uint64(0), np.cumsum(_mix(hashes + np.uint64(salt * 0x5851F42D4C957F2D & (1 << 64) - 1)), dtype=np.uint64)]
        size = np.diff(offsets).astype(np.uint64)
        out.append(np.where(size > 0, _mix(total[offsets[1:]] - total[offsets[:-1]] + size), 0).astype(np.uint64).view(np.int64))
    return out[0], out[1]


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """id, n, unit, check (hashes of the set), bands, and bits b0, b1, b2."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(1), BATCH_BYTES):
                texts = batch.column(1).slice(a, b - a).fill_null("").cast(pa.binary())
                hashes, offsets = shingle_sets(texts.to_pylist(), size)
                n = np.diff(offsets)
                full = np.flatnonzero(n)
                signature = signatures(hashes, np.r_[offsets[:-1][full], offsets[-1]]) if len(full) else np.zeros((0, COORDINATES), np.uint32)
                bits = np.zeros((b - a, 3), np.int64)
                bits[full] = _bits(signature)
                unit, check = _set_ids(hashes, offsets)
                where = np.r_[0, np.cumsum(np.where(n > 0, BANDS, 0))].astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(where), pa.array(_bands(signature).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n), pa.array(unit), pa.array(check), bands, *(pa.array(bits[:, k]) for k in range(3))],
                    ["id", "n", "unit", "check", "bands", "b0", "b1", "b2"],
                )

    return docs.mapInArrow(sign, f"id {docs.schema['id'].dataType.simpleString()}, n long, unit long, check long, bands array<long>, b0 long, b1 long, b2 long")


def _of_unit(texts: DataFrame, size: int) -> DataFrame:
    """Those (unit, text) whose text has the unit's set; an id with several texts brings others along."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(1), BATCH_BYTES):
                part = batch.slice(a, b - a)
                unit, _ = _set_ids(*shingle_sets(part.column(1).fill_null("").cast(pa.binary()).to_pylist(), size))
                yield part.filter(pa.array(unit == part.column(0).to_numpy()))

    return texts.mapInArrow(keep, "unit long, text string")


@scratch
def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those (u, v) whose sets have 100 * intersection >= percent * union."""
    pairs = stash(pairs.distinct(), "pairs")
    few = pairs.count() <= BROADCAST_PAIRS
    one = texts.withColumnsRenamed({"unit": "u", "text": "one"}).join(F.broadcast(pairs) if few else pairs, "u")
    both = one.join(texts.withColumnsRenamed({"unit": "v", "text": "two"}), "v").select("u", "v", "one", "two")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                sets = []
                for c in (2, 3):
                    hashes, offsets = shingle_sets(part.column(c).cast(pa.binary()).to_pylist(), size)
                    sets.append([hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
                keep = []
                for x, y in zip(*sets, strict=True):
                    common = len(x) + len(y) - len(np.union1d(x, y))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return stash(both.mapInArrow(verify, "u long, v long"), "links")


def common_shingles(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Number of common shingles of each sets[left[i]] and sets[right[j]]."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, number, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # a shingle that only one set has counts for its own size alone
    column = np.cumsum(shared) - 1
    keep = shared[number]
    owner, column = owner[keep], column[number[keep]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    total = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(shared.sum()), STRIPE):
        a, b = np.searchsorted(column, [start, start + STRIPE])
        table = np.zeros((len(sets), STRIPE), np.float32)
        table[owner[a:b], column[a:b] - start] = 1
        total += table[left] @ table[right].T
    same = left[:, None] == right[None, :]
    return np.where(same, np.array([len(x) for x in sets])[left][:, None], total).astype(np.int64)


def spanning(left: list[int], right: list[int], links: np.ndarray) -> np.ndarray:
    """Of the links between components, those of a spanning forest."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    keep = []
    for link, x, y in zip(links.tolist(), left, right, strict=True):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(link)
    return np.array(keep, np.int64)


def _same_members(members: DataFrame, bucket: str, *more: str) -> DataFrame:
    """The least of all buckets with the same members, of which there are several, as (bucket, least, more)."""
    groups = members.groupBy(bucket).agg(F.min("unit").alias("least"), F.max("unit").alias("most"), F.expr("bit_xor(xxhash64(unit))").alias("x"), F.count("*").alias("size"), *[F.expr(m) for m in more]).where("least < most")
    return groups.groupBy("least", "most", "x", "size", *[m.rsplit(" ", 1)[1] for m in more]).agg(F.min(bucket).alias("bucket"))


def _by_rarest(open_: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(bucket, unit, c) of the units of open_, with a bucket for each shingle that two of them have among their rarest."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in text_slices(batch.column(2), BATCH_BYTES):
                hashes, offsets = shingle_sets(batch.column(2).slice(a, b - a).cast(pa.binary()).to_pylist(), size)
                sets = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), sets], ["unit", "c", "shingles"])

    sets = stash(open_.select("unit", "c").distinct().join(texts, "unit").select("unit", "c", "text").mapInArrow(spell, "unit long, c long, shingles array<long>"), "sets")
    rows = sets.select("unit", "c", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    held = stash(rows.groupBy("s").agg(F.count("*").alias("k")).where("k > 1"), "shared-shingles")
    rows = rows.join(held, "s", "left").withColumn("rank", F.row_number().over(Window.partitionBy("unit").orderBy(F.coalesce("k", F.lit(1)), "s")))
    rare = stash(rows.where(f"rank <= n - ceil({percent} * n / 100) + 1 AND k > 1").select(F.col("s").alias("bucket"), "unit", "c"), "rarest-shingles")
    kept = _same_members(rare, "bucket", "min(c) AS low", "max(c) AS high").where("low < high").select("bucket")
    return stash(rare.join(kept, "bucket"), "rarest-shingles")


def _shaped(open_: DataFrame) -> DataFrame:
    """open_ with its bucket's largest component (main), and the numbers of blocks outside it (ni) and of all (nj)."""
    counts = open_.groupBy("bucket", "c").agg(F.count("*").alias("k"))
    shape = counts.groupBy("bucket").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.sum("k").alias("all"), F.max("k").alias("most"))
    shape = shape.select("bucket", "main", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("ni"), F.ceil(F.col("all") / BLOCK).cast("int").alias("nj"))
    return open_.join(stash(shape, "shapes"), "bucket")


@scratch
def _compared(open_: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Verified links (u, v) between components c within each bucket of open_ (bucket, unit, c), in blocks."""
    rows = _shaped(open_)
    large = rows.where(F.col("nj") > LARGE)
    if not large.isEmpty():
        rows = rows.where(F.col("nj") <= LARGE).unionByName(_shaped(_by_rarest(large.select("bucket", "unit", "c"), texts, size, percent)))
    outside = rows.where("c <> main").select("bucket", F.pmod(F.xxhash64("unit"), "ni").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("nj") - 1)).alias("j"), "unit", "c", F.lit(0).alias("role"))
    every = rows.select("bucket", F.explode(F.sequence(F.lit(0), F.col("ni") - 1)).alias("i"), F.pmod(F.xxhash64("unit", F.lit(1)), "nj").cast("int").alias("j"), "unit", "c", F.lit(1).alias("role"))
    dealt = outside.unionByName(every).join(texts, "unit").select("bucket", "i", "j", "unit", "c", "role", "text")
    dealt = dealt.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def compare(part: pa.Table, block: np.ndarray) -> pa.RecordBatch:
        unit, c, role = (part.column(n).to_numpy() for n in ("unit", "c", "role"))
        ids, first, number = np.unique(unit, return_index=True, return_inverse=True)
        hashes, offsets = shingle_sets(part.column("text").take(pa.array(first)).cast(pa.binary()).to_pylist(), size)
        sets = [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        n = np.diff(offsets)
        x, y = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
        common = common_shingles(sets, number[x], number[y])
        linked = 100 * common >= percent * (n[number[x]][:, None] + n[number[y]][None, :] - common)
        a, b = np.nonzero(linked & (block[x][:, None] == block[y][None, :]) & (c[x][:, None] != c[y][None, :]))
        a, b = x[a], y[b]
        once = np.unique(np.stack([c[a], c[b]], 1), axis=0, return_index=True)[1] if len(a) else a
        once = spanning(c[a[once]].tolist(), c[b[once]].tolist(), once)
        return pa.RecordBatch.from_arrays([pa.array(unit[a[once]]), pa.array(unit[b[once]])], ["u", "v"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in (*batches, None):
            if batch is not None:
                held.append(batch)
                if sum(b.num_rows for b in held) < 2 * BLOCK:
                    continue
            if not held:
                return
            table = pa.Table.from_batches(held).combine_chunks()
            keys = np.stack([table.column(n).to_numpy().astype(np.int64) for n in ("bucket", "i", "j")], 1)
            block = np.cumsum(np.r_[0, np.any(keys[1:] != keys[:-1], axis=1)])
            whole = table.num_rows if batch is None else int(np.searchsorted(block, block[-1]))  # the last block may go on
            start = 0
            while start < whole:
                end = min(whole, int(np.searchsorted(block, block[min(start + BLOCK, whole - 1)])) if start + BLOCK < whole else whole)
                if end <= start:  # a block larger than that is taken by itself
                    end = min(whole, int(np.searchsorted(block, block[start], "right")))
                yield compare(table.slice(start, end - start), block[start:end])
                start = end
            held = table.slice(whole).to_batches() if whole < table.num_rows else []

    return stash(dealt.mapInArrow(scan, "u long, v long"), "links")


def _alike(a: str, b: str, percent: int) -> str:
    """SQL: sizes and signature bits of two members leave a link possible."""
    shared = " + ".join(f"bit_count({a}.b{k} ^ {b}.b{k})" for k in range(3))
    return f"100 * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) AND {shared} <= {COORDINATES - LEAST_BITS}"


@scratch
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """Per row: id_col, n_shingles (long) and component, the least id that links lead to.

    percent is the least similarity; the miss probabilities above hold for 80 and more.
    """
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    signed = stash(_signed(rows, size), "signed")
    named = signed.where("id IS NOT NULL AND n > 0")
    units = stash(named.groupBy("unit", "check").agg(F.min("id").alias("rep"), F.first("n").alias("n"), *[F.first(f"b{k}").alias(f"b{k}") for k in range(3)]), "units")
    banded = named.alias("s").join(units.alias("u"), (F.col("s.unit") == F.col("u.unit")) & (F.col("s.id") == F.col("u.rep")))
    banded = banded.select(F.col("s.unit").alias("unit"), F.explode("s.bands").alias("bucket")).distinct()
    groups = stash(_same_members(banded, "bucket"), "buckets")
    members = stash(banded.join(groups.select("bucket", "least"), "bucket"), "members")
    used = members.select("unit").distinct()
    members = stash(members.join(units.select("unit", "n", "b0", "b1", "b2"), "unit"), "members")
    held = units.join(used, "unit", "left_semi").select("unit", "rep")
    shared = named.groupBy("id").agg(F.min("unit").alias("v"), F.max("unit").alias("top")).where("v < top").select("id", "v")
    shared = stash(named.join(shared, "id").select(F.col("unit").alias("u"), "v"), "shared")
    several = not shared.isEmpty()
    texts = rows.join(held, rows["id"] == held["rep"]).select("unit", "text")
    texts = stash((_of_unit(texts, size) if several else texts).dropDuplicates(["unit"]), "texts")

    @scratch
    def linked(found: DataFrame, component: DataFrame | None) -> DataFrame:
        """Components (node, component) after the links found, given those before."""
        if component is None:
            return stash(components(found), "components")
        name = component.withColumnsRenamed({"node": "u", "component": "cu"})
        links = found.join(name, "u", "left").join(name.withColumnsRenamed({"u": "v", "cu": "cv"}), "v", "left")
        merged = components(links.select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v")))
        merged = stash(merged.withColumnsRenamed({"node": "old", "component": "new"}), "merged")
        kept = component.join(merged, component["component"] == merged["old"], "left").select("node", F.coalesce("new", "component").alias("component"))
        fresh = merged.join(component, merged["old"] == component["node"], "left_anti").select(F.col("old").alias("node"), F.col("new").alias("component"))
        return stash(kept.unionByName(fresh), "components")

    star = members.alias("m").join(units.alias("c"), (F.col("m.least") == F.col("c.unit")) & (F.col("m.unit") != F.col("m.least"))).where(_alike("m", "c", percent))
    star = star.groupBy(F.col("m.unit").alias("u")).agg(F.min("m.least").alias("v"))
    component = linked(_verified(star, texts, size, percent), None)
    columns = ["unit", "n", "b0", "b1", "b2"]
    for turn in range(PIVOT_ROUNDS + 1):
        now = members.join(component.withColumnRenamed("node", "unit"), "unit", "left").select("bucket", *columns, F.coalesce("component", "unit").alias("c"))
        drawn = F.min_by(F.struct(*columns, "c"), F.xxhash64("unit", F.lit(turn)))
        mixed = stash(now.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high"), drawn.alias("p")).where("low < high").select("bucket", "p.*").withColumnsRenamed({"c": "pc"}), "mixed")
        if mixed.isEmpty():
            break
        now = stash(now.join(mixed.select("bucket"), "bucket", "left_semi"), "open")
        if turn < PIVOT_ROUNDS:
            pairs = now.alias("m").join(mixed.alias("p"), "bucket").where(F.expr("m.c <> p.pc AND " + _alike("m", "p", percent)))
            pairs = pairs.groupBy(F.col("m.unit").alias("u")).agg(F.min_by("p.unit", F.xxhash64("p.unit", F.lit(turn))).alias("v"))
        else:
            component = linked(_compared(now.select("bucket", "unit", "c"), texts, size, percent), component)
            break
        component = linked(_verified(pairs, texts, size, percent), component)
    if several:  # texts under one id make their units one
        component = linked(shared, component)
    owner = units.select("unit", "check", "rep").join(component.withColumnRenamed("node", "unit"), "unit", "left").withColumn("component", F.coalesce("component", "unit"))
    least = stash(owner.groupBy("component").agg(F.min("rep").alias("first_id")), "first-ids")
    owner = stash(owner.join(least, "component").select(F.col("unit").alias("o_unit"), F.col("check").alias("o_check"), "first_id"), "owners")
    out = signed.join(owner, (signed["unit"] == owner["o_unit"]) & (signed["check"] == owner["o_check"]) & signed["id"].isNotNull(), "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("first_id", "id").alias("component"))


ship_by_value(__name__)
