"""Groups of sets that are alike: every link of a Jaccard likeness or more counts, but pairs are never listed.

1. A prefix filter gives keys. With all members in one order, two sets of sizes m and n that are alike by t
   share one of the first m - ceil(t * m) + 1 of either. Members that many sets hold come last in the order, so
   that few sets share a key. Short sets have keys of two members, as most of their members are frequent.
2. Sets that share a key are put next to each other. Their sizes, the key's places in them, the parities of their
   members and the tallies of long ones bound what they can have in common. Those that may be alike get spanning links.
3. Components of these links hold all that is alike. The sets of one are brought together once, and their
   likeness is counted in full; a component of many bytes is dealt over pairs of parts. Short sets go with their
   keys instead, so that their links are counted in full at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .graph import components

#: Frequent members that are sent to every task (16 bytes each), members counted at once, and times that one of them
#: must occur among these. They settle the order only, so no result depends on them.
FREQUENT, CHUNK, OFTEN = 200_000, 2_000_000, 8
#: Sets with one key, beyond which the key is dealt over pairs of parts; members of a part of a component.
HOT, PART = 20_000, 500_000
#: Longs of a set's parities, and their columns.
WIDTH = 8
PARITY = [f"_p{i}" for i in range(WIDTH)]
#: Sets of more members have tallies, which tell long sets apart where their parities no longer do: counts in so many buckets, and
#: in twice as many for the longest.
LONG, LONGEST, BUCKETS = 1000, 5000, 512
#: Pairs that a task holds before it hands them on.
LISTED = 1_000_000
#: Nodes with their groups that are sent to every task, at most (16 bytes each).
BROADCAST_NODES = 1_000_000
TINY = 1e-9


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())


def _frequent(sets: DataFrame) -> np.ndarray:
    """Members that many sets hold, rarest first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h[c >= OFTEN]), pa.array(c[c >= OFTEN])], names=["h", "c"])

        for batch in batches:
            held.append(flat(batch.column("s"))[0])
            size += len(held[-1])
            if size >= CHUNK:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    top = sets.select("s").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "h").limit(FREQUENT)
    return np.array([r.h for r in top.toLocalIterator()][::-1], dtype=np.int64)


def ordered(values: np.ndarray, lengths: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The members of each set of a batch in the one order of all members, frequent ones last."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    by_value = np.argsort(frequent)
    place = np.searchsorted(frequent[by_value], values)
    rank = np.zeros(len(values), np.int64)
    if len(frequent):
        place = np.minimum(place, len(frequent) - 1)
        known = frequent[by_value][place] == values
        rank[known] = 1 + by_value[place[known]]
    return values[np.lexsort((values, rank, owner))]


def prefixes(values: np.ndarray, lengths: np.ndarray, threshold: float, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, member, place) of the first m - ceil(threshold * m) + 1 members of each set of a batch."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    first = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    at = np.arange(len(values)) - first[owner]
    keep = lengths - np.ceil(lengths * threshold - TINY).astype(np.int64) + 1
    chosen = at < keep[owner]
    return owner[chosen], ordered(values, lengths, frequent)[chosen], at[chosen]


def pair_prefixes(values: np.ndarray, lengths: np.ndarray, threshold: float, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, key, place) of keys of two members each: sets that have two members or more in common, as their sizes want
    it, have two of the first m - ceil(threshold * m) + 2 of either in common. Sets that may be alike by one common member have
    keys of one as well. A key's place is that of its last member less the members before it."""
    values, starts = ordered(values, lengths, frequent), np.cumsum(lengths) - lengths
    share, owners, keys, places = threshold / (1 + threshold), [], [], []
    for m in np.unique(lengths[lengths > 0]).tolist():
        own = np.nonzero(lengths == m)[0]
        held = values[starts[own][:, None] + np.arange(m)]
        least = max(1, int(np.ceil(m * threshold - TINY)))
        if np.ceil(share * (m + least) - TINY) <= 1:
            owners.append(np.repeat(own, m))
            keys.append(held.ravel())
            places.append(np.tile(np.arange(m), len(own)))
        i, j = np.triu_indices(min(m, m - max(2, least) + 2), 1)
        if len(i):
            mixed = (held[:, i].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (held[:, j].view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            owners.append(np.repeat(own, len(i)))
            keys.append((mixed ^ (mixed >> np.uint64(29))).view(np.int64).ravel())
            places.append(np.tile(j - 1, len(own)))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owners, keys, places))


def parities(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64 * WIDTH bits of each set, each of them set if an odd number of members falls on it. Those of two sets differ in no
    more bits than there are members that only one of the sets has."""
    out, ends = np.zeros((len(lengths), WIDTH), np.uint64), np.cumsum(lengths)
    bit = ((values.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % (64 * WIDTH)
    for at in range(0, len(lengths), 1000):
        n = lengths[at : at + 1000]
        own = bit[ends[at] - lengths[at] : ends[at + len(n) - 1]] + np.repeat(np.arange(len(n)), n) * (64 * WIDTH)
        odd = (np.bincount(own, minlength=len(n) * 64 * WIDTH) & 1).astype(np.uint8)
        out[at : at + 1000] = np.packbits(odd.reshape(len(n), -1), axis=1).view(np.uint64)
    return out


def tallies(values: np.ndarray, lengths: np.ndarray) -> list[bytes | None]:
    """How many members of each long set fall into each bucket, modulo 256; of two sets these differ in sum by no more than there
    are members that only one of the sets has. None for others."""
    out, ends = [None] * len(lengths), np.cumsum(lengths)
    for i in np.nonzero(lengths > LONG)[0].tolist():
        own = values[ends[i] - lengths[i] : ends[i]].view(np.uint64)
        n = np.bincount(((own * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % (2 * BUCKETS), minlength=2 * BUCKETS).astype(np.uint8)
        out[i] = (n if lengths[i] > LONGEST else n[:BUCKETS] + n[BUCKETS:]).tobytes()
    return out


def tally_test(n: np.ndarray, held: pa.Array) -> Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """near(i, j, most): which pairs of rows may have at most so many members that only one of them has, by their tallies;
    n: the sets' sizes."""
    long, longest = np.nonzero(n > LONG)[0], np.nonzero(n > LONGEST)[0]
    slot, wide = (np.searchsorted(x, np.arange(len(n))) for x in (long, longest))
    twice = np.frombuffer(b"".join(held.take(pa.array(longest)).to_pylist()), np.uint8).reshape(-1, 2 * BUCKETS)
    once = np.zeros((len(long), BUCKETS), np.uint8)
    once[slot[longest]] = twice[:, :BUCKETS] + twice[:, BUCKETS:]
    rest = long[n[long] <= LONGEST]
    once[slot[rest]] = np.frombuffer(b"".join(held.take(pa.array(rest)).to_pylist()), np.uint8).reshape(-1, BUCKETS)

    def near(i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        out = np.ones(len(i), bool)
        for table, place, least in ((once, slot, LONG), (twice, wide, LONGEST)):
            both = np.nonzero(out & (np.minimum(n[i], n[j]) > least))[0]
            for at in range(0, len(both), 4096):
                x = both[at : at + 4096]
                differ = table[place[i[x]]] - table[place[j[x]]]
                out[x] = np.minimum(differ, -differ).sum(1, dtype=np.int64) <= most[x]
        return out

    return near


def common(codes: np.ndarray, lengths: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many members the sets i and j have in common, pair by pair; codes number the members from 0."""
    starts, many = np.cumsum(lengths) - lengths, int(codes.max()) + 1 if len(codes) else 1

    def spread(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = lengths[x]
        pair = np.repeat(np.arange(len(x)), n)
        return pair, pair * many + codes[np.arange(len(pair)) + np.repeat(starts[x] - (np.cumsum(n) - n), n)]

    pair, left = spread(i)
    return np.bincount(pair[np.isin(left, spread(j)[1])], minlength=len(i))


def _shared_keys(sets: DataFrame, threshold: float, short: bool) -> DataFrame:
    """(h, node, at) of the keys that several sets have."""
    chosen = pair_prefixes if short else prefixes
    sent = sets.sparkSession.sparkContext.broadcast(_frequent(sets))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, lengths = flat(batch.column("s"))
            owner, h, at = chosen(values, lengths, threshold, sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(h), batch.column("node").take(pa.array(owner)), pa.array(at)], names=["h", "node", "at"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = node = at = np.zeros(0, np.int64)

        def found(h: np.ndarray, node: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])])[: len(h)]
            h, node, at = h[new], node[new], at[new]
            same = h[1:] == h[:-1]
            keep = np.concatenate([[False], same])[: len(h)] | np.concatenate([same, [False]])[: len(h)]
            return pa.RecordBatch.from_arrays([pa.array(h[keep]), pa.array(node[keep]), pa.array(at[keep])], names=["h", "node", "at"])

        for batch in batches:
            h, node, at = (np.concatenate([a, batch.column(c).to_numpy()]) for a, c in ((h, "h"), (node, "node"), (at, "at")))
            other = np.nonzero(h != h[-1])[0] if len(h) else []
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield found(h[:cut], node[:cut], at[:cut])
                h, node, at = h[cut:], node[cut:], at[cut:]
        yield found(h, node, at)

    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sets.select("node", "s").mapInArrow(keys, "h long, node long, at long").repartition(n, "h").sortWithinPartitions("h", "node", "at").mapInArrow(several, "h long, node long, at long")


def span_runs(keys: np.ndarray, alike: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (positions) of the pairs that may be alike within runs of equal keys; keys are sorted.

    Neighbours 1, 2, 3, ... places apart in the same run are compared at once, but for pairs that are already
    joined; alike(i, j) gives the positions i whose pair holds. Memory follows the rows; pairs are not listed.
    """
    root = np.arange(len(keys))
    left: list[int] = []
    right: list[int] = []
    i, step = np.arange(len(keys)), 1
    while True:
        i = i[i + step < len(keys)]
        i = i[keys[i] == keys[i + step]]
        if not len(i):
            break
        x = i[root[i] != root[i + step]]
        x = alike(x, x + step) if len(x) else x
        for a in x.tolist():
            ra, rb = a, a + step
            while root[ra] != ra:
                root[ra] = ra = root[root[ra]]
            while root[rb] != rb:
                root[rb] = rb = root[root[rb]]
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
                left.append(a)
                right.append(a + step)
        if len(x):
            while (root[root] != root).any():
                root = root[root]
        step += 1
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def deal_hot(rows: DataFrame, keys: list[str], hot: int) -> DataFrame:
    """Add cell: 0, but for keys of over ``hot`` rows, which are split into parts that meet two by two."""
    crowded = written(rows.groupBy(*keys).count().filter(F.col("count") > hot).withColumn("parts", F.ceil(F.col("count") / hot).cast("int")).drop("count"), "hot")
    if crowded.isEmpty():
        return rows.withColumn("cell", F.lit(0).cast("long"))
    part = F.pmod(F.xxhash64("node"), F.col("parts"))
    pairs = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.least(part, q) * (1 << 31) + F.greatest(part, q)))
    return rows.join(crowded, keys, "left").withColumn("cell", F.explode(pairs)).drop("parts")


def runs_of(batches: Iterator[pa.RecordBatch], columns: list[str], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(run numbers, rows) of whole runs, for batches of long columns sorted by the first ``width`` of them."""
    rest = np.zeros((0, len(columns)), np.int64)
    for batch in batches:
        rest = np.concatenate([rest, np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], 1)])
        # the last run may go on in the next batch
        other = np.nonzero((rest[:, :width] != rest[-1, :width]).any(1))[0] if len(rest) else []
        if len(other):
            whole, rest = rest[: int(other[-1]) + 1], rest[int(other[-1]) + 1 :]
            yield _numbered(whole, width), whole
    if len(rest):
        yield _numbered(rest, width), rest


def _numbered(rows: np.ndarray, width: int) -> np.ndarray:
    return np.concatenate([[0], np.cumsum((rows[1:, :width] != rows[:-1, :width]).any(1))])[: len(rows)]


Sieve = Callable[[np.ndarray, np.ndarray], Callable[[np.ndarray, np.ndarray], np.ndarray]]


def table_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """(run numbers, rows) of whole runs, for batches sorted by some long columns."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        rest = pa.concat_tables([rest, new]) if rest is not None else new
        k = np.stack([rest.column(c).to_numpy() for c in keys], 1)
        # the last run may go on in the next batch
        other = np.flatnonzero((k != k[-1]).any(1))
        if len(other):
            cut = int(other[-1]) + 1
            yield _numbered(k[:cut], len(keys)), rest.slice(0, cut)
            rest = rest.slice(cut)
    if rest is not None and rest.num_rows:
        yield _numbered(np.stack([rest.column(c).to_numpy() for c in keys], 1), len(keys)), rest


def _marks(sets: DataFrame, names: list[str]) -> DataFrame:
    """(node, n, names, PARITY, tally) of sets: sizes, parities and tallies."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, lengths = flat(batch.column("s"))
            p = parities(values, lengths)
            columns = [batch.column("node"), pa.array(lengths.astype(np.int64)), *(batch.column(c) for c in names), *(pa.array(np.ascontiguousarray(p[:, i]).view(np.int64)) for i in range(WIDTH)), pa.array(tallies(values, lengths), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", *names, *PARITY, "tally"])

    schema = ", ".join(f"{c} long" for c in ["node", "n", *names, *PARITY]) + ", tally binary"
    return sets.select("node", "s", *names).mapInArrow(mark, schema).dropDuplicates(["node"])


def _tests(run: np.ndarray, rows: pa.Table, names: list[str], threshold: float, sieve: Sieve | None, short: bool) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """alike(i, j) of the rows of some runs: the positions i whose pair may be alike; if the sets are there, is alike."""
    n, at = (rows.column(c).to_numpy() for c in ("n", "at"))
    parity = np.stack([rows.column(c).to_numpy() for c in PARITY], 1).view(np.uint64)
    apart = tally_test(n, rows.column("tally").combine_chunks())
    more = sieve(run, np.stack([rows.column(c).to_numpy() for c in names], 1)) if sieve else None
    share, lengths, codes = threshold / (1 + threshold), None, None
    if short:
        values, lengths = flat(rows.column("s"))
        codes = np.unique(values, return_inverse=True)[1]

    def alike(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        if not len(i):
            return i
        step = int(j[0] - i[0])
        # from the first key of both on, so many members at most are common
        wanted = share * (n[i] + n[j])
        fits = (np.minimum(n[i], n[j]) >= np.maximum(n[i], n[j]) * threshold - TINY) & (np.minimum(n[i] - at[i], n[j] - at[j]) >= wanted - TINY)
        i, wanted = i[fits], wanted[fits]
        if len(i):
            differ = np.bitwise_count(parity[i] ^ parity[i + step]).sum(1, dtype=np.int64)
            most = n[i] + n[i + step] - 2 * wanted + TINY
            near = differ <= most
            near[near] = apart(i[near], i[near] + step, most[near])
            i, wanted = i[near], wanted[near]
        if more and len(i):
            kept = more(i, i + step)
            i, wanted = kept, share * (n[kept] + n[kept + step])
        return i[common(codes, lengths, i, i + step) >= wanted - TINY] if short and len(i) else i

    return alike


def _candidates(sets: DataFrame, names: list[str], threshold: float, sieve: Sieve | None, short: bool, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """Spanning links (a, b) of sets with a common key that may be alike, and the marks of the sets; short sets are alike. If
    ``every`` is set, all pairs a < b instead."""
    marks = written(_marks(sets, names), "marks")
    columns = ["h", "cell", "node", "n", "at", *names, *PARITY, "tally"] + (["s"] if short else [])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run, rows in table_runs(batches, ["h", "cell"]):
            alike, node = _tests(run, rows, names, threshold, sieve, short), rows.column("node").to_numpy()
            for a, b in all_pairs(run, alike) if every else [span_runs(run, alike)]:
                a, b = node[a], node[b]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    keys = written(_shared_keys(sets, threshold, short), "keys")
    held = marks.join(sets.select("node", "s").dropDuplicates(["node"]), "node") if short else marks
    dealt = deal_hot(keys.join(held, "node"), ["h"], HOT)
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "h", "cell").sortWithinPartitions("h", "cell").select(*columns).mapInArrow(link, "a long, b long").distinct(), marks


def all_pairs(keys: np.ndarray, alike: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs (positions) that may be alike within runs of equal keys, as span_runs() compares them, in pieces."""
    left, right, held = [], [], 0
    i, step = np.arange(len(keys)), 1
    while True:
        i = i[i + step < len(keys)]
        i = i[keys[i] == keys[i + step]]
        if not len(i):
            break
        x = alike(i, i + step)
        left.append(x)
        right.append(x + step)
        held += len(x)
        if held >= LISTED:
            yield np.concatenate(left), np.concatenate(right)
            left, right, held = [], [], 0
        step += 1
    if held:
        yield np.concatenate(left), np.concatenate(right)


def alike_pairs(sets: DataFrame, threshold: float, short: bool = False) -> DataFrame:
    """(a, b), a < b: all pairs of sets (node, s; nodes distinct, none empty) that may be alike; short sets are alike."""
    return _candidates(sets, [], threshold, None, short, every=True)[0]


def linked(sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Spanning links of the sets (distinct members) that are alike, in full: from each set that is reached, the
    members' postings count what it has in common with those that are not reached yet."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, members = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = [members[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
    waiting, found = np.ones(len(sets), bool), []

    def postings() -> tuple[np.ndarray, np.ndarray]:
        owner = np.repeat(np.arange(len(sets)), sizes)
        left = waiting[owner]
        order = np.argsort(members[left], kind="stable")
        return owner[left][order], np.searchsorted(members[left][order], np.arange(int(members.max()) + 2 if len(members) else 1))

    for seed in range(len(sets)):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        queue = [seed]
        if seed == 0:
            holders, start = postings()
            held = len(sets)
        while queue:
            left = int(waiting.sum())
            if not left:
                return found
            if left < held // 2:
                holders, start = postings()
                held = left
            f = queue.pop()
            from_, to = start[own[f]], start[own[f] + 1]
            counts = to - from_
            at = np.repeat(from_ - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(int(counts.sum())) if len(counts) else np.zeros(0, np.int64)
            common = np.bincount(holders[at], minlength=len(sets))
            new = np.nonzero(waiting & (common > 0) & (common * (1 + threshold) >= threshold * (sizes[f] + sizes) - TINY))[0].tolist()
            waiting[new] = False
            found += [(f, j) for j in new]
            queue += new
    return found


def _verified(sets: DataFrame, marks: DataFrame, groups: DataFrame, threshold: float, part: int) -> DataFrame:
    """Spanning links (a, b) of the sets that are alike within their group (node, root). Only grouped sets are
    shuffled: the groups go to the sets if they are few."""
    groups = F.broadcast(groups) if groups.count() <= BROADCAST_NODES else groups
    held = sets.select("node", "s").join(groups, "node")
    sizes = marks.join(groups, "node").groupBy("root").agg(F.sum("n").alias("n")).filter(F.col("n") > part)
    sizes = written(sizes.select("root", F.ceil(F.col("n") / part).cast("int").alias("parts")), "large-groups")
    if sizes.isEmpty():
        dealt = held.withColumn("cell", F.lit(0).cast("long"))
    else:
        own = F.pmod(F.xxhash64("node"), F.col("parts"))
        pairs = F.when(F.col("parts").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: F.least(own, q) * (1 << 31) + F.greatest(own, q)))
        dealt = held.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_NODES else sizes, "root", "left").withColumn("cell", F.explode(pairs)).drop("parts")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}

        def links() -> pa.RecordBatch:
            nodes = list(held)
            found = linked([held[x] for x in nodes], threshold) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i, _ in found], pa.int64()), pa.array([nodes[j] for _, j in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            values, lengths = flat(batch.column("s"))
            ends = np.cumsum(lengths)
            for root, cell, node, e, n in zip(batch.column("root").to_pylist(), batch.column("cell").to_pylist(), batch.column("node").to_pylist(), ends.tolist(), lengths.tolist(), strict=True):
                if at != (root, cell):
                    if held:
                        yield links()
                    at, held = (root, cell), {}
                held.setdefault(node, values[e - n : e].copy())
        if held:
            yield links()

    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(parts, "root", "cell").sortWithinPartitions("root", "cell").select("root", "cell", "node", "s").mapInArrow(verify, "a long, b long")


def alike_groups(sets: DataFrame, threshold: float, names: list[str] | None = None, sieve: Sieve | None = None, part: int = PART, short: bool = False) -> DataFrame:
    """(node, root) of the sets that are alike with any other: root is the smallest node of their component.

    sets: node (long), s (array of long, distinct members) and columns ``names`` (long); a node may be repeated.
    Empty sets are alike with none. Two sets are linked if their Jaccard likeness is ``threshold`` or more; no
    link between components is missed, unless the sieve rejects it. sieve(run, columns) gives a test on pairs
    of rows, as span_runs takes it, that may reject pairs with a common key before they are counted. Empty
    input: no rows. No task holds more than twice ``part`` members, or two sets. ``short``: sets of some ten members, most
    of them frequent, which go with their keys.
    """
    sets = sets.filter(F.size("s") > 0)
    names = names or []
    links, marks = _candidates(sets, names, threshold, sieve, short)
    found = components(links)
    return found if short else components(_verified(sets, marks, written(found, "candidate-groups"), threshold, part))
