"""Removal of byte strings that occur in an earlier document, by sorting suffixes in range-partitioned buckets.

A text is a sequence of UTF-8 bytes. Each byte that lies in a string of min_bytes bytes which also starts in a
document with a smaller id is removed; strings never cross documents and are judged on the input.

Of all suffixes those at synchronising positions are sorted: each string of min_bytes bytes holds exactly one, the
place of its least hashed token (16 bytes), so equal strings hold it at the same place. Neighbouring strings with
the same one form a run, kept with its bytes before and after the token.

1. Documents are dealt to groups of bounded size. Each group sends out compact fingerprints of its tokens, and
   learns which of them occur in other groups. Only runs whose token occurs in two documents go on.
2. A group keeps, of runs with equal bytes, those of the smallest id; the others are done (their strings occur
   earlier). The rest goes to buckets by ranges of the suffixes' leading tokens, between splitters from a sample. A
   token that holds more than a part of a bucket in the sample has its runs cut into single strings, which are dealt
   out by their bytes, so no key can fill a bucket.
3. A bucket sorts by multikey quicksort, here in rounds over arrays: ties are split by the next 8 bytes of all
   suffixes at a time, until groups are single or equal. Neighbouring runs of the same token are then compared
   string by string. Ranges end between tokens, so no comparison crosses a boundary but that of the hot tokens,
   whose equal strings share a bucket.
4. The strings found go back to their groups, where they are joined to spans and cut out.

Only partition counts and splitters rest on estimates and samples. Null text counts as empty; a null id counts as
larger than all others, and rows with equal ids never remove from each other. Extra columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship_by_value, size_estimate

TOKEN, WORD = 16, 8
SEGMENT = 1 << 20
#: Bytes of text of a group and of a bucket, and the factor from stored to text bytes; bits of a fingerprint.
GROUP_BYTES, BUCKET_BYTES, INFLATION, BITS = 4 << 20, 16 << 20, 2, 48
#: Tokens that the sample holds at most, bytes of text that it is drawn from, and the part of a bucket that makes a token hot.
SAMPLE_TOKENS, SAMPLE_BYTES, HOT_SHARE = 200_000, 16 << 20, 0.1
LAST_ID = (1 << 63) - 1


class Runs(NamedTuple):
    """first and last: places of the first and last string of each run; token: place of its token; hi, lo: its 16 bytes."""

    first: np.ndarray
    last: np.ndarray
    token: np.ndarray
    hi: np.ndarray
    lo: np.ndarray

    def take(self, at: np.ndarray) -> Runs:
        return Runs(*(x[at] for x in self))


class Texts(NamedTuple):
    """Documents of a group in a fixed order, one after another in data, which ends in spare bytes."""

    ids: list[int | None]
    order: np.ndarray
    offsets: np.ndarray
    data: np.ndarray


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)


def gather(ids: list[int | None], texts: list[bytes]) -> Texts:
    order = sorted(range(len(ids)), key=lambda i: (LAST_ID if ids[i] is None else ids[i], ids[i] is None, texts[i]))
    ids = [ids[i] for i in order]
    offsets = np.r_[0, np.cumsum([len(texts[i]) for i in order])].astype(np.int64)
    data = np.frombuffer(b"".join(texts[i] for i in order) + b"\0" * 128, np.uint8)
    return Texts(ids, np.array([LAST_ID if i is None else i for i in ids], np.int64), offsets, data)


def words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place, as numbers that compare as the bytes do."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, WORD)[at]).view(">u8").ravel().astype(np.uint64)


def _segment(texts: Texts, start: int, end: int, size: int) -> Runs | None:
    """Runs of the strings that start in data[start:end]."""
    reach = end - start + size - TOKEN + 1
    part = texts.data[start : start + reach + TOKEN + WORD]
    part = np.r_[part, np.zeros(max(0, reach + TOKEN + WORD - len(part)), np.uint8)]
    word = np.empty(reach + WORD, np.uint64)
    for shift in range(WORD):
        into = word[shift::WORD]
        into[:] = part[shift : shift + WORD * len(into)].view(">u8")
    least = mix(word[:reach] * np.uint64(0x9E3779B97F4A7C15) ^ word[WORD : WORD + reach]) & np.uint64(0xFFFFFFFF00000000)
    least |= np.arange(reach, dtype=np.uint64)  # of equal hashes the first is least
    width, done = size - TOKEN + 1, 1
    while done * 2 <= width:
        least = np.minimum(least[:-done], least[done:])
        done *= 2
    if width > done:
        least = np.minimum(least[: done - width], least[width - done :])
    token = (least[: end - start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    stop = texts.offsets[1:]
    begin = np.maximum(texts.offsets[:-1], stop - size + 1)  # strings from here on would leave their document
    edge = np.zeros(end - start + 1, np.int64)
    inside = (stop > start) & (begin < end)
    np.add.at(edge, np.maximum(begin[inside], start) - start, 1)
    np.add.at(edge, np.minimum(stop[inside], end) - start, -1)
    at = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
    if not len(at):
        return None
    token = token[at]
    new = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (at[1:] != at[:-1] + 1)])
    p = token[new]
    return Runs(at[new] + start, at[np.r_[new[1:], len(at)] - 1] + start, p + start, word[p], word[p + WORD])


def find_runs(texts: Texts, size: int) -> Runs:
    total = int(texts.offsets[-1])
    parts = [r for s in range(0, total, SEGMENT) if (r := _segment(texts, s, min(total, s + SEGMENT), size))]
    return Runs(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else Runs(*(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64)))


def multikey_classes(count: int, key: Callable[[int, np.ndarray], np.ndarray], levels: int) -> np.ndarray:
    """A number below count for each of count items, equal for items whose keys agree on all levels.

    Each round sorts, within each tie, by the next key of its items; single items leave.
    """
    out, fresh = np.empty(count, np.int64), 0
    item, tie = np.arange(count), np.zeros(count, np.int64)
    for level in range(levels):
        if not len(item):
            return out
        value = key(level, item)
        order = np.lexsort((value, tie))
        item, tie, value = item[order], tie[order], value[order]
        tie = np.cumsum(np.r_[0, (tie[1:] != tie[:-1]) | (value[1:] != value[:-1])])
        alone = np.bincount(tie)[tie] == 1
        left = item[alone]
        out[left] = fresh + np.arange(len(left))
        fresh += len(left)
        item, tie = item[~alone], tie[~alone]
    if len(item):
        out[item] = fresh + np.cumsum(np.r_[0, tie[1:] != tie[:-1]])  # numbers of single items are not taken up
    return out


def run_classes(data: np.ndarray, start: np.ndarray, left: np.ndarray, right: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Equal numbers for runs with equal bytes and their token at the same place."""
    length = left + right
    levels = 3 + (-(-int(length.max()) // WORD) if len(length) else 0)

    def key(level: int, item: np.ndarray) -> np.ndarray:
        if level < 3:
            return (hi[item], lo[item], (left[item] << 32 | right[item]).astype(np.uint64))[level]
        return words(data, start[item] + np.minimum((level - 3) * WORD, length[item] - WORD))

    return multikey_classes(len(start), key, levels)


def spread(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of count[i] copies of i: i, and the number of the copy."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


def earlier_strings(data: np.ndarray, start: np.ndarray, left: np.ndarray, right: np.ndarray, hi: np.ndarray, lo: np.ndarray, order: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, number of the string in it) of strings that a run with a smaller order also has; runs differ in bytes."""
    token = multikey_classes(len(start), lambda level, item: (hi, lo)[level][item], 2)
    low = np.full(len(start), LAST_ID)
    high = np.full(len(start), -LAST_ID - 1)
    np.minimum.at(low, token, order)
    np.maximum.at(high, token, order)
    run = np.flatnonzero(low[token] < high[token])
    which, j = spread((left + right - size + 1)[run])
    which = run[which]
    begin, place = start[which] + j, (token[which] << 8 | (left[which] - j)).astype(np.uint64)
    levels = 1 + -(-size // WORD)
    same = multikey_classes(len(which), lambda level, item: words(data, begin[item] + min((level - 1) * WORD, size - WORD)) if level else place[item], levels)
    least = np.full(len(which), LAST_ID)
    np.minimum.at(least, same, order[which])
    late = order[which] > least[same]
    return which[late], j[late]


def pack(*arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    for x in arrays:
        wide = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T if len(x) else x  # bytes of equal weight together
        np.save(out, np.array([len(x)]))
        np.save(out, np.array(list(x.dtype.str.encode()), np.uint8))
        np.save(out, np.ascontiguousarray(wide))
    return zstandard.compress(out.getvalue(), 3)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = io.BytesIO(zstandard.decompress(blob))
    end, out = len(raw.getvalue()), []
    while raw.tell() < end:
        n = int(np.load(raw)[0])
        kind = np.dtype(bytes(np.load(raw)).decode())
        wide = np.load(raw)
        out.append(np.ascontiguousarray(wide.T).reshape(-1).view(kind) if n else np.zeros(0, kind))
    return out


class Plan(NamedTuple):
    size: int
    groups: int
    buckets: int
    split_hi: np.ndarray  # leading tokens at which buckets begin, in order
    split_lo: np.ndarray
    hot: np.ndarray  # sorted fingerprints of hot tokens
    hot_buckets: int


def prints(runs: Runs) -> np.ndarray:
    return mix(runs.hi * np.uint64(0xC2B2AE3D27D4EB4F) ^ mix(runs.lo)) >> np.uint64(64 - BITS)


def bucket_of(plan: Plan, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Number of splitters that are not beyond the token."""
    below, upto = np.searchsorted(plan.split_hi, hi, "left"), np.searchsorted(plan.split_hi, hi, "right")
    for i in np.flatnonzero(below < upto):
        below[i] += np.searchsorted(plan.split_lo[below[i] : upto[i]], lo[i], "right")
    return below


def _slices(plan: Plan, sorted_prints: np.ndarray) -> np.ndarray:
    edges = (np.arange(plan.buckets + 1, dtype=np.float64) * (2.0**BITS / plan.buckets)).astype(np.uint64)
    return np.r_[np.searchsorted(sorted_prints, edges[:-1]), len(sorted_prints)]


def _group(table: pa.Table) -> Texts:
    return gather(table.column("id").to_pylist(), table.column("text").to_pylist())


def _announce(plan: Plan, table: pa.Table) -> pa.Table:
    """Step 1: the group's distinct fingerprints, by ranges."""
    mine = np.unique(prints(find_runs(_group(table), plan.size)))
    at = _slices(plan, mine)
    rows = [(i, pack(np.diff(mine[a:b], prepend=np.uint64(0)))) for i, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) if a < b]
    g = table.column("g")[0].as_py()
    return pa.table({"range": pa.array([i for i, _ in rows], pa.int32()), "g": pa.array([g] * len(rows), pa.int32()), "prints": pa.array([x for _, x in rows], pa.binary())})


def _reply(table: pa.Table) -> pa.Table:
    """Which fingerprints of each group occur in another."""
    lists = [np.cumsum(unpack(x)[0], dtype=np.uint64) for x in table.column("prints").to_pylist()]
    all_ = np.concatenate(lists)
    order = np.argsort(all_, kind="stable")
    ordered = all_[order]
    same = ordered[1:] == ordered[:-1]
    twice = np.zeros(len(all_), bool)
    twice[order] = np.r_[same, False] | np.r_[False, same]
    ends = np.cumsum([len(x) for x in lists])
    bits = [np.packbits(twice[e - len(x) : e]).tobytes() for x, e in zip(lists, ends, strict=True)]
    return pa.table({"g": table.column("g"), "range": table.column("range"), "bits": pa.array(bits, pa.binary())})


def _cut_hot(plan: Plan, runs: Runs, hot: np.ndarray) -> Runs:
    """runs, those marked hot cut into single strings."""
    which, j = spread(np.where(hot, runs.last - runs.first + 1, 1))
    first = runs.first[which] + j
    out = runs.take(which)
    return out._replace(first=first, last=np.where(hot[which], first, out.last))


def _send(plan: Plan, table: pa.Table, replies: pa.Table) -> pa.Table:
    """Steps 1 and 2: runs that may recur, by bucket; and strings already known to recur (kind 1)."""
    g = table.column("g")[0].as_py() if table.num_rows else 0
    texts = _group(table)
    runs = find_runs(texts, plan.size)
    rows: list[tuple[int, int, bytes]] = []
    if len(runs.first):
        marks = prints(runs)
        mine, number = np.unique(marks, return_inverse=True)
        at = _slices(plan, mine)
        twice = np.zeros(len(mine), bool)
        for i, bits in zip(replies.column("range").to_pylist(), replies.column("bits").to_pylist(), strict=True):
            twice[at[i] : at[i + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=int(at[i + 1] - at[i])).astype(bool)
        doc = np.searchsorted(texts.offsets, runs.first, "right") - 1
        low, high = np.full(len(mine), LAST_ID), np.full(len(mine), -LAST_ID - 1)
        np.minimum.at(low, number, texts.order[doc])
        np.maximum.at(high, number, texts.order[doc])
        keep = np.flatnonzero((twice | (low < high))[number])
        runs, hot = runs.take(keep), np.isin(marks[keep], plan.hot)
        if hot.any():
            runs = _cut_hot(plan, runs, hot)
            hot = np.isin(prints(runs), plan.hot)
        doc = np.searchsorted(texts.offsets, runs.first, "right") - 1
        order = texts.order[doc]
        left, right = runs.token - runs.first, runs.last + plan.size - runs.token
        same = run_classes(texts.data, runs.first, left, right, runs.hi, runs.lo)
        least = np.full(len(same), LAST_ID)
        np.minimum.at(least, same, order)
        late = order > least[same]
        base = texts.offsets[doc]
        if late.any():
            rows.append((g % (plan.buckets + plan.hot_buckets), 1, pack(doc[late].astype(np.uint32), (runs.first - base)[late], (runs.last - base)[late])))
        members = np.flatnonzero(~late)
        if len(members):
            _, one, cls = np.unique(same[members], return_index=True, return_inverse=True)
            one = members[one]
            bucket = bucket_of(plan, runs.hi[one], runs.lo[one])
            if (h := hot[one]).any():
                digest = np.zeros(int(h.sum()), np.uint64)
                for step in range(0, plan.size, WORD):
                    digest = mix(digest + words(texts.data, runs.first[one[h]] + min(step, plan.size - WORD)))
                bucket[h] = plan.buckets + (digest % np.uint64(max(1, plan.hot_buckets))).astype(np.int64)
            by_bucket = np.lexsort((runs.lo[one], runs.hi[one], bucket))
            place = np.empty(len(one), np.int64)
            place[by_bucket] = np.arange(len(one))
            one, bucket = one[by_bucket], bucket[by_bucket]
            by_class = np.argsort(place[cls], kind="stable")
            members, cls = members[by_class], place[cls][by_class]
            cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                own = one[a:b]
                which, j = spread((left + right)[own])
                ma, mb = np.searchsorted(cls, a), np.searchsorted(cls, b)
                m = members[ma:mb]
                blob = pack(texts.data[runs.first[own][which] + j], left[own].astype(np.uint8), right[own].astype(np.uint8), order[own], (cls[ma:mb] - a).astype(np.uint32), doc[m].astype(np.uint32), (runs.first - base)[m])
                rows.append((int(bucket[a]), 0, blob))
    return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int32()), "kind": pa.array([r[1] for r in rows], pa.int32()), "g": pa.array([g] * len(rows), pa.int32()), "blob": pa.array([r[2] for r in rows], pa.binary())})


def _compare(plan: Plan, table: pa.Table) -> pa.Table:
    """Step 3: strings of the bucket that occur in a smaller id, by group."""
    out_g, out = [], []
    data, left, right, order, cls, doc, place, group = ([] for _ in range(8))
    classes = 0
    for kind, g, blob in zip(table.column("kind").to_pylist(), table.column("g").to_pylist(), table.column("blob").to_pylist(), strict=True):
        if kind == 1:
            out_g.append(g)
            out.append(blob)
            continue
        text, l_, r_, o, c, d, p = unpack(blob)
        for into, x in ((data, text), (left, l_), (right, r_), (order, o), (cls, c.astype(np.int64) + classes), (doc, d), (place, p), (group, np.full(len(c), g))):
            into.append(x)
        classes += len(l_)
    if classes:
        data = np.concatenate([*data, np.zeros(16, np.uint8)])
        left, right, order, cls, doc, place, group = (np.concatenate(x) for x in (left, right, order, cls, doc, place, group))
        left, right = left.astype(np.int64), right.astype(np.int64)
        start = np.r_[0, np.cumsum(left + right)[:-1]]
        hi, lo = words(data, start + left), words(data, start + left + WORD)
        same = run_classes(data, start, left, right, hi, lo)
        least = np.full(len(same), LAST_ID)
        np.minimum.at(least, same, order)
        late = order > least[same]
        count = left + right - plan.size + 1
        m = np.flatnonzero(late[cls])
        found = [(m, place[m], place[m] + count[cls[m]] - 1)]
        _, one, number = np.unique(same, return_index=True, return_inverse=True)
        run, j = earlier_strings(data, start[one], left[one], right[one], hi[one], lo[one], least[same[one]], plan.size)
        if len(run):
            sort = np.lexsort((j, run))
            run, j = run[sort], j[sort]
            new = np.r_[True, (run[1:] != run[:-1]) | (j[1:] != j[:-1] + 1)]
            a = np.flatnonzero(new)
            owner, from_, to = run[a], j[a], j[np.r_[a[1:], len(j)] - 1]
            many = np.bincount(owner, minlength=len(one))
            first = np.r_[0, np.cumsum(many)[:-1]]
            m = np.flatnonzero(~late[cls] & (many[number[cls]] > 0))
            which, k = spread(many[number[cls[m]]])
            m = m[which]
            span = first[number[cls[m]]] + k
            found.append((m, place[m] + from_[span], place[m] + to[span]))
        m, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        by = np.argsort(group[m], kind="stable")
        m, a, b = m[by], a[by], b[by]
        cuts = np.r_[np.flatnonzero(np.r_[True, group[m][1:] != group[m][:-1]]), len(m)] if len(m) else [0]
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            out_g.append(int(group[m[s]]))
            out.append(pack(doc[m[s:e]], a[s:e], b[s:e]))
    return pa.table({"g": pa.array(out_g, pa.int32()), "found": pa.array(out, pa.binary())})


def _cut(plan: Plan, table: pa.Table, found: pa.Table) -> pa.Table:
    """Step 4: spans and remaining bytes of each document."""
    texts = _group(table)
    parts = [unpack(x) for x in found.column("found").to_pylist()]
    doc, a, b = (np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for k in range(3))
    begin, end = texts.offsets[doc] + a, texts.offsets[doc] + b + plan.size
    sort = np.argsort(begin, kind="stable")
    doc, begin, end = doc[sort], begin[sort], end[sort]
    reach = np.maximum.accumulate(end) if len(end) else end
    new = np.flatnonzero(np.r_[True, (begin[1:] > reach[:-1]) | (doc[1:] != doc[:-1])]) if len(begin) else begin
    doc, begin, end = doc[new], begin[new], reach[np.r_[new[1:], len(reach)] - 1] if len(new) else end
    at = np.searchsorted(doc, np.arange(len(texts.ids) + 1))
    data = texts.data.tobytes()
    kept = []
    for i, (s, e) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        edges = [int(texts.offsets[i]), *np.stack([begin[s:e], end[s:e]], 1).ravel().tolist(), int(texts.offsets[i + 1])]
        kept.append(b"".join(data[x:y] for x, y in zip(edges[0::2], edges[1::2], strict=True)))
    base = texts.offsets[doc]
    spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(begin - base), pa.array(end - base)], ["start", "end"]))
    return pa.table({"id": pa.array(texts.ids, pa.int64()), "n_bytes": pa.array(np.diff(texts.offsets)), "spans": spans, "kept": pa.array(kept, pa.binary())})


def _sample(rows: DataFrame, size: int, text_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of a sample of documents, sorted; a bounded number."""

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = find_runs(gather([None] * batch.num_rows, batch.column(0).to_pylist()), size)
            some = slice(None, None, max(1, min(8, len(runs.hi) // 1000)))
            yield pa.RecordBatch.from_arrays([pa.array(x[some].view(np.int64)) for x in (runs.hi, runs.lo)], ["hi", "lo"])

    drawn = rows.select("text").sample(min(1.0, SAMPLE_BYTES / text_bytes), seed=7)
    found = drawn.mapInArrow(tokens, "hi long, lo long").limit(SAMPLE_TOKENS).toArrow()
    hi, lo = (found.column(k).to_numpy().view(np.uint64) for k in range(2))
    order = np.lexsort((lo, hi))
    return hi[order], lo[order]


def _plan(rows: DataFrame, size: int, text_bytes: int) -> Plan:
    text_bytes = max(1, text_bytes)
    buckets = -(-text_bytes // BUCKET_BYTES)
    hi, lo = _sample(rows, size, text_bytes)
    new = np.flatnonzero(np.r_[True, (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]) if len(hi) else np.zeros(0, np.int64)
    count = np.diff(np.r_[new, len(hi)])
    big = count >= max(16, HOT_SHARE * len(hi) / buckets)
    none = np.zeros(len(new), np.int64)
    hot = prints(Runs(none, none, none, hi[new], lo[new]))[big]
    share = count[big].sum() / max(1, len(hi))
    rest = np.repeat(~big, count)  # hot tokens have buckets of their own
    hi, lo = hi[rest], lo[rest]
    cut = (np.arange(1, buckets) * len(hi)) // buckets if len(hi) else np.zeros(0, np.int64)
    return Plan(size, -(-text_bytes // GROUP_BYTES), buckets, hi[cut], lo[cut], np.sort(hot), int(np.ceil(share * buckets * size / 4)) if len(hot) else 0)


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 50) -> DataFrame:
    """Per row: id_col (long), n_bytes, spans (array of start and end, in bytes) that are removed, and kept (binary)."""
    if not TOKEN + WORD <= min_bytes <= 200:
        raise ValueError("min_bytes must be from 24 to 200")
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("binary"), F.lit(b"")).alias("text"))
    plan = _plan(rows, min_bytes, size_estimate(docs, text_col, INFLATION))
    grouped = rows.withColumn("g", F.pmod(F.xxhash64("id", "text"), F.lit(plan.groups)).cast("int"))
    replies = grouped.groupBy("g").applyInArrow(lambda t: _announce(plan, t), "range int, g int, prints binary")
    replies = replies.groupBy("range").applyInArrow(_reply, "g int, range int, bits binary")
    sent = grouped.groupBy("g").cogroup(replies.groupBy("g")).applyInArrow(lambda t, r: _send(plan, t, r), "bucket int, kind int, g int, blob binary")
    found = sent.groupBy("bucket").applyInArrow(lambda t: _compare(plan, t), "g int, found binary")
    out = grouped.groupBy("g").cogroup(found.groupBy("g")).applyInArrow(lambda t, f: _cut(plan, t, f), "id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)


ship_by_value(__name__)
