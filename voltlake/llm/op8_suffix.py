"""Suffix-array dedup: bytes covered by a string of ``length`` bytes that also starts elsewhere.

The suffix array is sparse. In every string of ``length`` bytes, the least hash
of its ``ANCHOR``-byte windows picks the same places wherever the string stands,
so two equal strings share an anchor at the same offset; only suffixes at
anchors are sorted.

1. Anchors of every document carry the hash of their window and of their whole
   context: the bytes that any string through the anchor can hold. Counts by hash
   are pre-aggregated, and joins with them can split a hot hash. Only anchors whose
   window occurs twice go on.
2. Of each distinct context the suffixes of its first and its last place are sent:
   every task writes front-coded sorted runs for each bucket of window hashes.
3. A bucket's runs are combined by a loser tree that keeps, for each contender,
   its common prefix with the last winner. A longer known prefix decides without
   reading a byte, and equal ones are compared from there on only. The merge's
   own prefix lengths then delimit the groups of suffixes that share an anchor;
   adding the common bytes to the left, an anchor is covered as far as a partner
   shares at least ``length`` bytes through it.
4. A window with more than ``max_group`` distinct contexts would make one task's
   bucket hot. Of those contexts every string of ``length`` bytes is sorted as a
   suffix of its own, in buckets of the string's hash, so that the group is spread
   over all tasks; a task writes each distinct string once and reports its further
   places at once. Runs and loser trees are the same, equal neighbours are covered.

So all repeats are decided on bytes in the sort. Only where a context has more than
two places, those between its first and last are taken for equal to both by 128 bits
of hash. Documents are shuffled once; both joins use that exchange.

Edge cases: null text counts as empty; documents shorter than ``length`` lose
nothing and match nothing; rows equal in id and text are two documents, so they
cover each other; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.llm.common import join_key, materialise, row_keys, text_of
from voltlake.llm.op7_jaccard import _mix, _signed

ANCHOR, SEGMENT, FLUSH = 64, 1 << 20, 48 << 20


def _slide(a: np.ndarray, w: int, f: np.ufunc, neutral: int) -> np.ndarray:
    """f over every window of w values, by block prefixes and suffixes."""
    n = len(a)
    x = np.full(-(-n // w) * w, neutral, a.dtype)
    x[:n] = a
    y = x.reshape(-1, w)
    head, tail = f.accumulate(y, 1).ravel(), f.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    return f(tail[: n - w + 1], head[w - 1 : n])


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors and their windows' hashes. Long texts go by overlapping segments."""
    n, at, hashes = len(data), [], []
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = length - ANCHOR + 1
    for start in range(0, n, SEGMENT):
        low, high = max(0, start - 2 * length), min(n, start + SEGMENT + 2 * length)
        if high - low < length:
            continue
        h = np.frombuffer(data, np.uint8, high - low, low).astype(np.uint64) + np.uint64(1)
        width, power = 1, 0x9E3779B97F4A7C15
        while width < ANCHOR:
            h = h[:-width] * np.uint64(power) + h[width:]
            width, power = width * 2, power * power % 2**64
        h = _mix(h)
        least = _slide(h, w, np.minimum, 2**64 - 1)
        edge = np.zeros(w - 1, np.uint64)
        p = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), w, np.maximum, 0) == h)
        keep = (p + low >= start) & (p + low < start + SEGMENT)
        at.append(p[keep] + low)
        hashes.append(h[p[keep]])
    return np.concatenate(at), np.concatenate(hashes)


def common(a: bytes, b: bytes, i: int = 0) -> int:
    """Length of the common prefix, known to be at least i."""
    n = min(len(a), len(b))
    while i + 32 <= n and a[i : i + 32] == b[i : i + 32]:
        i += 32
    while i < n and a[i] == b[i]:
        i += 1
    return i


def pack(entries: list[tuple]) -> bytes:
    """A run: entries (suffix, left bytes reversed, k1, k2, pos), sorted and front-coded."""
    import zstandard

    entries.sort(key=lambda e: e[0])
    shared, rest, last = [], [], b""
    for e in entries:
        k = common(last, e[0])
        shared.append(k)
        rest.append(e[0][k:])
        last = e[0]
    head = np.array([shared, [len(r) for r in rest], [len(e[1]) for e in entries], [e[4] for e in entries]], np.int32)
    keys = np.array([[e[2] for e in entries], [e[3] for e in entries]], np.int64)
    return zstandard.ZstdCompressor(3).compress(struct.pack("<I", len(entries)) + head.tobytes() + keys.tobytes() + b"".join(rest) + b"".join(e[1] for e in entries))


def unpack(blob: bytes) -> Iterator[tuple[bytes, int, tuple]]:
    """(suffix, its common prefix with the one before, (left bytes, k1, k2, pos)) of a run, in order."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    n = struct.unpack_from("<I", data)[0]
    head = np.frombuffer(data, np.int32, 4 * n, 4).reshape(4, n).tolist()
    keys = np.frombuffer(data, np.int64, 2 * n, 4 + 16 * n).reshape(2, n).tolist()
    at = 4 + 32 * n
    left_at, last = at + sum(head[1]), b""
    for shared, size, left, pos, k1, k2 in zip(*head, *keys, strict=True):
        last = last[:shared] + data[at : at + size]
        yield last, shared, (data[left_at : left_at + left], k1, k2, pos)
        at += size
        left_at += left


def merge(runs: list[Iterator[tuple[bytes, int, tuple]]]) -> Iterator[tuple[bytes, int, tuple]]:
    """The runs' entries in order, each with its common prefix with the one before.

    tree[node] holds the loser of the match at the node and its common prefix
    with the string that beat it. Everything on the winner's path was last beaten
    by the winner itself, so the prefixes there compare like with like.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list[tuple | None] = [next(r, None) for r in runs] + [None] * (size - len(runs))
    tree: list[tuple[int, int]] = [(0, 0)] * size

    def match(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        if heads[a] is None:
            return b, lb, a, la
        if heads[b] is None or la > lb:
            return a, la, b, lb
        if lb > la:
            return b, lb, a, la
        x, y = heads[a][0], heads[b][0]
        k = common(x, y, la)
        if k == len(x) or (k < len(y) and x[k] < y[k]):
            return a, la, b, k
        return b, lb, a, k

    def build(node: int) -> tuple[int, int]:
        if node >= size:
            return node - size, 0
        win, lw, lose, ll = match(*build(2 * node), *build(2 * node + 1))
        tree[node] = (lose, ll)
        return win, lw

    win, shared = build(1)
    while heads[win] is not None:
        suffix, _, payload = heads[win]
        yield suffix, shared, payload
        heads[win] = following = next(runs[win], None)
        shared = following[1] if following else 0
        node = (win + size) // 2
        while node:
            other, lo = tree[node]
            win, shared, lose, ll = match(win, shared, other, lo)
            tree[node] = (lose, ll)
            node //= 2


def covered(group: list[tuple[int, tuple]], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(k1, k2, from, to) for the members of a group (common prefix with the one before, payload) that a partner covers."""
    m = len(group)
    left, right = [0] * m, [0] * m
    if m <= 24:
        for i in range(m):
            reach = 10**9
            for j in range(i + 1, m):
                reach = min(reach, group[j][0])
                if reach < ANCHOR:
                    break
                if reach < length and min(len(group[i][1][0]), len(group[j][1][0])) + reach < length:
                    continue
                back = common(group[i][1][0], group[j][1][0])
                if back + reach >= length:
                    for x in (i, j):
                        left[x], right[x] = max(left[x], back), max(right[x], reach)
    else:
        wide = length - ANCHOR
        raw = np.zeros((m, wide), np.int16)
        for i, (_, e) in enumerate(group):
            raw[i, : len(e[0])] = np.frombuffer(e[0], np.uint8)
            raw[i, len(e[0]) :] = -1 - (i & 1023)
        order = np.lexsort(raw.T[::-1])
        rank = np.empty(m, np.int64)
        rank[order] = np.arange(m)
        adjacent, lens = np.array([g[0] for g in group]), np.array([len(e[0]) for _, e in group])
        adjacent[0] = 0
        best, far = np.zeros(m, np.int64), np.zeros(m, np.int64)
        for level in sorted({int(x) for x in adjacent[1:] if x >= ANCHOR}, reverse=True):
            part = np.cumsum(adjacent < level)
            line = np.lexsort((rank, part))
            same = part[line][1:] == part[line][:-1]
            equal = raw[line[1:]] == raw[line[:-1]]
            back = np.where(equal.all(1), wide, np.argmin(equal, 1)) * same
            most, paired = np.zeros(m, np.int64), np.zeros(m, bool)
            paired[line[1:]] |= same
            paired[line[:-1]] |= same
            np.maximum.at(most, line[1:], back)
            np.maximum.at(most, line[:-1], back)
            most = np.minimum(most, lens)
            ok = paired & (most + level >= length)
            best = np.where(ok, np.maximum(best, most), best)
            far = np.where(ok, np.maximum(far, level), far)
        left, right = best.tolist(), far.tolist()
    for (_, e), back, ahead in zip(group, left, right, strict=True):
        if ahead:
            yield e[1], e[2], e[3] - back, e[3] + ahead


def _find(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for k1, k2, text in zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), batch.column("text"), strict=True):
                data = text.as_buffer()
                if data is None or data.size < length:
                    continue
                data = data.to_pybytes()
                p, h = anchors(data, length)
                out[0].append(np.full(len(p), k1, np.int64))
                out[1].append(np.full(len(p), k2, np.int64))
                out[2].append(p)
                out[3].append(h.view(np.int64))
                back = length - ANCHOR
                out[4].append(np.array([_signed(xxh3_64_intdigest(data[max(0, a - back) : a + length], min(a, back))) for a in p.tolist()], np.int64))
                if sum(map(len, out[2])) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["k1", "k2", "pos", "h", "c"])
                    out = [[], [], [], [], []]
            if out[2]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["k1", "k2", "pos", "h", "c"])

    return run


def _runs(length: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for bucket in sorted(held):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([pack(held[bucket])], pa.binary())], names=["bucket", "run"])
            held.clear()

        for batch in batches:
            for k in range(batch.num_rows):
                k1, k2 = batch.column("k1")[k].as_py(), batch.column("k2")[k].as_py()
                data = batch.column("text")[k].as_buffer().to_pybytes()
                wanted = batch.column("wanted")[k].values
                for pos, h in zip(wanted.field("pos").to_pylist(), wanted.field("h").to_pylist(), strict=True):
                    back = data[max(0, pos - length + ANCHOR) : pos]
                    held.setdefault(h % buckets, []).append((data[pos : pos + length], back[::-1], k1, k2, pos))
                    size += 2 * length + 200
                if size > FLUSH:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def by_anchor(merged: Iterator[tuple[bytes, int, tuple]], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(k1, k2, from, to) of what is covered, by groups of suffixes that share an anchor."""
    group: list[tuple[int, tuple]] = []
    for _, shared, payload in merged:
        if shared < ANCHOR:
            yield from covered(group, length)
            group = []
        group.append((shared, payload))
    yield from covered(group, length)


def by_equality(merged: Iterator[tuple[bytes, int, tuple]], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(k1, k2, from, to) of strings that equal a neighbour."""
    before, told = None, False
    for _, shared, (_, k1, k2, pos) in merged:
        equal = before is not None and shared >= length
        if equal and not told:
            yield before
        before, told = (k1, k2, pos, pos + length), equal
        if equal:
            yield before


def _combine(length: int, decide):
    def groups(runs: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        return decide(merge([unpack(r) for r in runs]), length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, runs = None, []
        out: list[tuple] = []

        def table() -> pa.RecordBatch:
            got = pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], names=["k1", "k2", "a", "b"])
            out.clear()
            return got

        for batch in batches:
            for now, blob in zip(batch.column("bucket").to_pylist(), batch.column("run").to_pylist(), strict=True):
                if now != bucket:
                    out.extend(groups(runs))
                    bucket, runs = now, []
                    if len(out) > 50_000:
                        yield table()
                runs.append(blob)
        out.extend(groups(runs))
        yield table()

    return run


def _strings(length: int, buckets: int):
    """Runs of the strings through the wanted anchors, each once a block of work; the further places of a string are cuts (k1, k2, a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        held: dict[bytes, tuple[int, int, int]] = {}
        told: set[bytes] = set()
        cuts: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            dealt: dict[int, list] = {}
            for string, (k1, k2, at) in held.items():
                dealt.setdefault(xxh3_64_intdigest(string) % buckets, []).append((string, b"", k1, k2, at))
            rows = [(bucket, pack(dealt[bucket]), None, None, None, None) for bucket in sorted(dealt)]
            rows += [(None, None, k1, k2, at, at + length) for k1, k2, at in cuts]
            for x in (held, told, cuts):
                x.clear()
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            for k in range(0, len(rows), 10_000):
                part = rows[k : k + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], kind) for i, kind in enumerate(kinds)], names=["bucket", "run", "k1", "k2", "a", "b"])

        for batch in batches:
            for k in range(batch.num_rows):
                k1, k2 = batch.column("k1")[k].as_py(), batch.column("k2")[k].as_py()
                data = batch.column("text")[k].as_buffer().to_pybytes()
                starts: set[int] = set()
                for pos in batch.column("wanted")[k].values.field("pos").to_pylist():
                    starts.update(range(max(0, pos - length + ANCHOR), min(pos, len(data) - length) + 1))
                for at in sorted(starts):
                    string = data[at : at + length]
                    first = held.setdefault(string, (k1, k2, at))
                    if first != (k1, k2, at):
                        cuts.append((k1, k2, at))
                        if string not in told:
                            told.add(string)
                            cuts.append(first)
                if (len(held) + len(cuts)) * (length + 200) > FLUSH:
                    yield from flush()
        yield from flush()

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                data = batch.column("text")[k].as_buffer()
                data = data.to_pybytes() if data is not None else b""
                cuts = batch.column("cuts")[k]
                merged: list[list[int]] = []
                if cuts.is_valid:
                    a, b = (np.array(cuts.values.field(f).to_pylist(), np.int64) for f in ("a", "b"))
                    order = np.argsort(a, kind="stable")
                    for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
                        x, y = max(0, x), min(len(data), y)
                        if merged and x <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], y)
                        else:
                            merged.append([x, y])
                kept, last = hashlib.sha256(), 0
                for x, y in merged:
                    kept.update(data[last:x])
                    last = y
                kept.update(data[last:])
                rows.append((len(data), sum(y - x for x, y in merged), len(merged), kept.hexdigest(), [{"start": x, "end": y} for x, y in merged]))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string(), span))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])

    return run


def suffix_dedup(docs: DataFrame, length: int = 200, max_group: int = 2_000, per_task: int = 60_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans, for every row of ``docs``."""
    if length < 2 * ANCHOR:
        raise ValueError(f"length must be at least {2 * ANCHOR}")
    first, second = row_keys()
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), first.alias("k1"), second.alias("k2"), text_of().alias("text"))
    found = keyed.mapInArrow(_find(length), "k1 long, k2 long, pos long, h long, c long")
    shared = found.groupBy("h").agg(F.count("*").alias("n_h")).where("n_h > 1").select(join_key("h").alias("j"))
    suspects = materialise(found.withColumn("j", join_key("h")).join(shared, "j", "left_semi").drop("j"))
    place = F.struct("k1", "k2", "pos")
    contexts = materialise(suspects.groupBy("h", "c").agg(F.count("*").alias("n_c"), F.min(place).alias("first"), F.max(place).alias("last")))
    many = contexts.groupBy("h").agg(F.count("*").alias("contexts")).select(join_key("h").alias("j"), "contexts")
    told = contexts.withColumn("j", join_key("h")).join(many, "j").where("contexts > 1 OR n_c > 1")
    ends = told.select("h", "contexts", F.explode(F.array_distinct(F.array("first", "last"))).alias("at")).select("at.k1", "at.k2", "at.pos", "h", "contexts")
    sorted_, large = F.col("contexts") <= max_group, F.col("contexts") > max_group
    n_sorted, n_large = ends.agg(F.count_if(sorted_), F.count_if(large)).first()

    def with_wanted(which):
        wanted = ends.where(which).groupBy("k1", "k2").agg(F.collect_set(F.struct("pos", "h")).alias("wanted"))
        return keyed.join(wanted.hint("merge"), ["k1", "k2"])

    def combined(runs: DataFrame, partitions: int, decide) -> DataFrame:
        return runs.select("bucket", "run").repartition(partitions, "bucket").sortWithinPartitions("bucket").mapInArrow(_combine(length, decide), "k1 long, k2 long, a long, b long")

    often = contexts.where("n_c > 2 OR first = last AND n_c > 1").select("h", "c")  # rows that repeat a document share its places
    cuts = suspects.join(often, ["h", "c"], "left_semi").select("k1", "k2", (F.col("pos") - (length - ANCHOR)).alias("a"), (F.col("pos") + length).alias("b"))
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    partitions = max(least, -(-n_sorted // per_task))
    runs = with_wanted(sorted_).mapInArrow(_runs(length, 4 * partitions), "bucket long, run binary")
    cuts = cuts.unionByName(combined(runs, partitions, by_anchor))
    if n_large:
        partitions = max(least, -(-n_large * (length - ANCHOR) // (4 * per_task)))
        strings = materialise(with_wanted(large).mapInArrow(_strings(length, 4 * partitions), "bucket long, run binary, k1 long, k2 long, a long, b long"))
        cuts = cuts.unionByName(strings.where("bucket IS NULL").select("k1", "k2", "a", "b")).unionByName(combined(strings.where("bucket IS NOT NULL"), partitions, by_equality))
    per_doc = cuts.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("cuts"))
    return (
        keyed.join(per_doc.hint("merge"), ["k1", "k2"], "left")
        .select("doc_id", "text", "cuts")
        .mapInArrow(_cut(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start: long, end: long>>")
    )
