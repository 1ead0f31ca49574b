"""N-gram Jaccard join through a token-group matrix.

A document's set is its distinct k-word shingles, as 64-bit hashes. Documents link when the Jaccard
similarity of their sets is at least num / den. Let L(n) = n - ceil(num n / den) + 1; under any common
order of all shingles, linked sets share at least min(L) of each other's first 2 L - 1 shingles.

1. Scan: each set's leading shingles (by hash) are dealt to hash ranges; a set goes on only if enough
   of them occur in another set too. What repeats inside a task is settled there, so that a shingle
   in every document is sent once a task.
2. Sets that are equal become one class; from here on only class representatives count.
3. Similar sets are partitioned into groups, in ROUNDS rounds. Each of a set's first L shingles, ordered so
   that frequent ones (by a counting sketch of fixed size) come last, votes for one set of another group that
   has it among its first, drawn anew each round; a set is compared with the two that get most votes, at
   least two, and linked ones form a group. What a round misses costs time later, never a link.
4. Each group stores the union of its members' shingles, as a bitmap of their hashes, and the matrix holds
   the union of their first L shingles. Linked sets share one of those at least, so a set's overlap with a group is below the
   threshold unless it meets the group there, in a place and with sizes that can still reach it. A group with one
   member that has the shingle is met once: where both have an earlier shingle in common they have met there. For
   groups that it meets, the set's shingles in the union are counted, which bounds the overlap with any
   member; only groups whose bound reaches the threshold are opened: a few members first, the others only
   if those don't join set and group.
5. Components of all links, each link verified on whole sets, give every row its component.

No step emits all pairs of a group, and every pair in different groups that can be linked is compared.

Defined cases: a null text, an empty text and one without words have the empty set and link with
nothing. Fewer than k words are one shingle. Rows that repeat an id are rows of their own; the smallest
id names a component, nulls last. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm.bitmaps import bitmap, has, places
from weft.llm.common import cut, partitions_for, pieces, tidy, unused
from weft.llm.groups import attach
from weft.llm.textarrays import mix, shingle_hashes, word_hashes

K, NUM, DEN = 5, 8, 10
#: Leading shingles that a task holds before it deals them out.
HELD = 1_000_000
SKETCH_BITS = 20
ROUNDS = 3
#: Bits of a group's union for each shingle of its largest member, at least.
UNION_BITS = 8
#: Members of a group that are compared before the others.
HEADS = 8
#: Leading shingles before one that are looked through for an earlier meeting.
LOOK_BACK = 16
_NONE = np.uint32(0xFFFFFFFF)


def lead(n: int, num: int, den: int) -> int:
    """L(n)."""
    return n - -(-num * n // den) + 1


def least_shared(n: int, num: int, den: int) -> int:
    """The least number of leading shingles that a set of n shares with any set it links with."""
    low, high = -(-num * n // den), den * n // num
    # L rises by at most 1 a step and falls never below L(low) - 1, so the ends and their neighbours suffice
    return max(1, min(lead(m, num, den) for m in {low, low + 1, n, high} if low <= m <= high) - 1)


def doc_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    h, before = word_hashes(texts)
    for i in range(len(before) - 1):
        yield np.unique(shingle_hashes(h[before[i] : before[i + 1]], k))


def set_hash(s: np.ndarray) -> tuple[int, int]:
    a = mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return int(a.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix(a + np.uint64(len(s)))).view(np.int64)) if len(s) else 0


SCAN = "kind int, part long, no long, doc_id long, sig long, n long, h1 long, h2 long, toks binary, owners binary"
_NAMES = [c.split()[0] for c in SCAN.split(", ")]
_TYPES = [pa.int32(), *[pa.int64()] * 7, pa.binary(), pa.binary()]


def _rows(**cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols else pa.nulls(n, t) for c, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)


@tidy
def _scan(batches: Iterator[pa.RecordBatch], k: int, num: int, den: int, ranges: int) -> Iterator[pa.RecordBatch]:
    """kind 0: a row for each document; 1: its leading shingles known to repeat; 2: leading shingles of a hash range."""
    part, no = TaskContext.get().partitionId(), 0
    toks: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    held = 0

    def deal() -> Iterator[pa.RecordBatch]:
        t, o = np.concatenate(toks), np.concatenate(owners)
        order = np.argsort(t, kind="stable")
        t, o = t[order], o[order]
        first = np.ones(len(t), bool)
        first[1:] = t[1:] != t[:-1]
        again = ~first
        again[:-1] |= ~first[1:]
        who, n = np.unique(o[again], return_counts=True)
        if len(who):
            yield _rows(kind=[1], part=[part], toks=[np.stack([who, n]).astype("<u4").tobytes()])
        t, o = t[first], np.where(again, _NONE, o)[first]
        r = (t >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
        cuts = np.searchsorted(r, np.arange(ranges + 1))
        for i in range(ranges):
            a, b = cuts[i], cuts[i + 1]
            if a < b:
                yield _rows(kind=[2], part=[part], no=[i], toks=[t[a:b].tobytes()], owners=[o[a:b].tobytes()])

    for whole in batches:
        for b in pieces(whole, "text", 4 << 20):
            facts, ids, sigs = [], b.column("doc_id").to_pylist(), b.column("sig").to_pylist()
            for i, s in enumerate(doc_sets(b.column("text"), k)):
                n = len(s)
                facts.append((no, ids[i], sigs[i], n, *set_hash(s)))
                if n:
                    p = 2 * lead(n, num, den) - 1
                    toks.append(s[:p])
                    owners.append(np.full(min(p, n), no, np.uint32))
                    held += min(p, n)
                no += 1
            c = list(zip(*facts, strict=True))
            yield _rows(kind=[0] * len(facts), part=[part] * len(facts), no=c[0], doc_id=c[1], sig=c[2], n=c[3], h1=c[4], h2=c[5])
            if held > HELD:
                yield from deal()
                toks, owners, held = [], [], 0
    if held:
        yield from deal()


@tidy
def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of each document's leading shingles, in these hash ranges, occur in another task as well: a row for each task that asked."""
    toks, owners = [], []
    for b in batches:
        for part, t, o in zip(b.column("part").to_pylist(), b.column("toks").to_pylist(), b.column("owners").to_pylist(), strict=True):
            o = np.frombuffer(o, np.uint32)
            toks.append(np.frombuffer(t, np.uint64))
            owners.append(np.where(o == _NONE, -1, o.astype(np.int64) | part << 32))
    if not toks:
        return
    t, o = np.concatenate(toks), np.concatenate(owners)
    order = np.argsort(t, kind="stable")
    t, o = t[order], o[order]
    same = t[1:] == t[:-1]
    again = np.zeros(len(t), bool)
    again[1:] |= same
    again[:-1] |= same
    who, n = np.unique(o[again & (o >= 0)], return_counts=True)
    cuts = np.flatnonzero(np.diff(who >> 32, prepend=-1, append=-1)) if len(who) else np.zeros(0, np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield pa.RecordBatch.from_pydict({"part": [int(who[a] >> 32)], "counts": [np.stack([who[a:b] & 0xFFFFFFFF, n[a:b]]).astype("<u4").tobytes()]})


@tidy
def _add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of those counts for each document of a task."""
    held: dict[int, list[np.ndarray]] = {}
    for b in batches:
        for part, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.setdefault(part, []).append(np.frombuffer(x, "<u4").reshape(2, -1).astype(np.int64))
    for part, parts in held.items():
        both = np.concatenate(parts, axis=1)
        n = np.bincount(both[0], both[1]).astype(np.int64)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part)), pa.array(at), pa.array(n[at])], ["part", "no", "shared"])


@tidy
def _enough(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    known: dict[int, int] = {}
    for b in batches:
        keep = []
        for n, x in zip(b.column("n").to_pylist(), b.column("shared").to_pylist(), strict=True):
            if n not in known:
                known[n] = least_shared(n, num, den)
            keep.append(x >= known[n])
        yield b.filter(pa.array(keep, pa.bool_()))


@tidy
def _sets(batches: Iterator[pa.RecordBatch], k: int, marks: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sets whose hash may be a representative's, each once a task."""
    seen: set[tuple[int, int]] = set()
    for whole in batches:
        for b in pieces(whole, "text", 4 << 20):
            h1, h2, sets = [], [], []
            for s in doc_sets(b.column("text"), k):
                x = set_hash(s)
                if len(s) and x not in seen and has(marks, np.array([x[0]]))[0]:
                    seen.add(x)
                    h1.append(x[0])
                    h2.append(x[1])
                    sets.append(s.view(np.int64))
            off = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], ["h1", "h2", "toks"])


@tidy
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(1 << SKETCH_BITS, np.int64)
    for b in batches:
        held += np.bincount(places(b.column(0).flatten().to_numpy(), SKETCH_BITS), minlength=len(held))
    if held.any():
        segments = np.minimum(held, 0xFFFF).astype("<u2").reshape(16, -1)
        yield pa.RecordBatch.from_pydict({"segment": pa.array(range(16), pa.int64()), "data": [s.tobytes() for s in segments]})


@tidy
def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for s, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held[s] = held.get(s, 0) + np.frombuffer(d, "<u2").astype(np.int64)
    if held:
        yield pa.RecordBatch.from_pydict({"segment": pa.array(list(held), pa.int64()), "data": [np.log2(x + 1.0).astype(np.uint8).tobytes() for x in held.values()]})


def frequency_levels(sets: DataFrame) -> np.ndarray:
    """log2 of how many sets may hold a shingle, by place of its hash: a table of 2**SKETCH_BITS bytes."""
    kind = "segment long, data binary"
    out = np.zeros((16, (1 << SKETCH_BITS) // 16), np.uint8)
    for r in sets.select("toks").mapInArrow(_sketch, kind).repartition(16, "segment").mapInArrow(_add, kind).collect():
        out[r.segment] = np.frombuffer(r.data, np.uint8)
    return out.reshape(-1)


@tidy
def _leading(batches: Iterator[pa.RecordBatch], levels: np.ndarray, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """The first L shingles of each set, rare ones first, with their places and the set's size."""
    for b in batches:
        off, flat = b.column("toks").offsets.to_numpy(), b.column("toks").values.to_numpy()
        keep, rows = [], []
        for i in range(b.num_rows):
            s = flat[off[i] : off[i + 1]]
            s = s[np.lexsort((s, levels[places(s, SKETCH_BITS)]))][: lead(len(s), num, den)]
            keep.append(s)
            rows.append(np.full(len(s), i))
        if keep:
            r = pa.array(np.concatenate(rows))
            place = pa.array(np.concatenate([np.arange(len(s)) for s in keep]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keep)), b.column("cid").take(r), b.column("n").take(r), place], ["tok", "cid", "n", "place"])


def _union_size(most: int) -> int:
    """log2 of the bits of a group's union."""
    return max(6, (UNION_BITS * most - 1).bit_length())


@tidy
def _unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of the shingles of these members of each group; ``hi`` is the group's largest size. Rows of a group that come together share one."""
    for b in batches:
        off, flat = b.column("toks").offsets.to_numpy(), b.column("toks").values.to_numpy()
        grp, hi = b.column("grp").to_pylist(), b.column("hi").to_pylist()
        held: dict[int, np.ndarray] = {}
        for i, g in enumerate(grp):
            bits = _union_size(hi[i])
            if g not in held:
                held[g] = np.zeros(1 << bits, bool)
            held[g][places(flat[off[i] : off[i + 1]], bits)] = True
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], ["grp", "bits"])


@tidy
def _join_unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bitmap a group. Rows come sorted by group."""
    now, held = None, np.zeros(0, np.uint8)
    for b in batches:
        done: list[tuple[int, bytes]] = []
        for g, x in zip(b.column("grp").to_pylist(), b.column("bits"), strict=True):
            x = np.frombuffer(x.as_buffer(), np.uint8)
            if g != now:
                if now is not None:
                    done.append((now, held.tobytes()))
                now, held = g, x
            else:
                held = held | x
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in done], pa.int64()), pa.array([x for _, x in done], pa.binary())], ["grp", "bits"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([held.tobytes()], pa.binary())], ["grp", "bits"])


@tidy
def _bounded(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Set and group pairs in which the set's shingles within the union suffice for a member of the least size that could link."""
    for b in batches:
        off, flat = b.column("toks").offsets.to_numpy(), b.column("toks").values.to_numpy()
        keep = []
        for i, (n, lo, x) in enumerate(zip(b.column("n").to_pylist(), b.column("lo").to_pylist(), b.column("bits"), strict=True)):
            marks = np.frombuffer(x.as_buffer(), np.uint8)
            overlap = int(has(marks, flat[off[i] : off[i + 1]]).sum())
            keep.append(overlap * (num + den) >= (n + max(lo, -(-n * num // den))) * num)
        yield b.select(["a", "n", "own", "grp"]).filter(pa.array(keep, pa.bool_()))


def linked(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Those pairs (a, b) of set ids whose whole sets are similar enough."""
    a = sets.select(F.col("cid").alias("a"), F.col("toks").alias("toks_a"))
    b = sets.select(F.col("cid").alias("b"), F.col("toks").alias("toks_b"))
    both = pairs.join(a, "a").join(b, "b")
    shared = F.size(F.array_intersect("toks_a", "toks_b"))
    return both.where(shared * den >= (F.size("toks_a") + F.size("toks_b") - shared) * num).select("a", "b")


def components(links: DataFrame, name: str = "stars") -> DataFrame:
    """(node, root) of the nodes of the links that aren't roots themselves: root is the smallest node of its component.

    Alternates the large-star and small-star steps until all that is left are stars; what each step makes goes to the
    shared folder, so that plans stay small whatever the number of steps.
    """
    now = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = cut(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        now = cut(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        # stars: no node has two links upwards, or is at both ends; the steps would change nothing more
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def meetings(leading: DataFrame, num: int, den: int) -> DataFrame:
    """Sets (a, n, own: its group) and other groups (grp) that share a leading shingle, in a place and with sizes that can reach the threshold. Few repeat."""
    # a shingle met before bounds the overlap of the same two sets less, so that it too is in a place that can reach it
    both = leading.groupBy("cid", "n", "grp").agg(F.array_sort(F.collect_list(F.struct("place", "tok"))).alias("all"))
    both = both.select("cid", "n", "grp", F.posexplode("all").alias("i", "x"), F.col("all.tok").alias("toks"))
    start = F.greatest(F.lit(1), F.col("i") + 1 - LOOK_BACK)
    left = both.select("cid", "n", "grp", F.col("x.tok").alias("tok"), F.col("x.place").alias("place"), F.slice("toks", start, F.least(F.col("i"), F.lit(LOOK_BACK))).alias("before"))
    one = F.when(F.count("*") == 1, F.first("before")).otherwise(F.array().cast("array<long>"))
    right = left.groupBy("tok", F.col("grp").alias("other")).agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("place")).alias("rest"), one.alias("met"))
    # the overlap from this shingle on, with a member of at least ``lo`` shingles, must reach the threshold
    fits = (F.col("grp") > F.col("other")) & (F.col("hi") * den >= F.col("n") * num) & (F.col("n") * den >= F.col("lo") * num)
    reach = F.least(F.col("n") - F.col("place"), F.col("rest")) * (num + den) >= (F.col("n") + F.greatest(F.col("lo"), F.ceil(F.col("n") * num / den))) * num
    new = ~F.arrays_overlap("before", "met")
    return left.join(right, (left.tok == right.tok) & fits & reach & new).select(F.col("cid").alias("a"), F.col("n"), F.col("grp").alias("own"), F.col("other").alias("grp"))


def near_groups(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, n_shingles, component_id, sig (a hash of id and text), and row, first_row: its own number and that of the component's first row."""
    spark = docs.sparkSession
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("sig", F.xxhash64("doc_id", "text"))
    parts = partitions_for(spark)
    scanned = cut(own.mapInArrow(partial(_scan, k=k, num=num, den=den, ranges=4 * parts), SCAN), "leading")
    rows = scanned.where("kind = 0").select("doc_id", "sig", "n", "h1", "h2", "part", "no", (F.col("part") * F.lit(1 << 33) + F.col("no")).alias("row"))
    elsewhere = scanned.where("kind = 2").select("part", F.col("no").alias("r"), "toks", "owners").repartition(parts, "r").drop("r").mapInArrow(_repeats, "part long, counts binary")
    counts = scanned.where("kind = 1").select("part", F.col("toks").alias("counts")).unionByName(elsewhere)
    shared = counts.repartition(parts, "part").mapInArrow(_add_counts, "part long, no long, shared long")
    kind = "doc_id long, n long, h1 long, h2 long, row long, shared long"
    alive = cut(rows.join(shared, ["part", "no"]).select("doc_id", "n", "h1", "h2", "row", "shared").mapInArrow(partial(_enough, num=num, den=den), kind), "alive")

    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    classes = cut(alive.groupBy("h1", "h2").agg(first.alias("first"), F.max("n").alias("n"), F.count("*").alias("copies")).select("h1", "h2", F.col("first.row").alias("cid"), F.col("first.doc_id").alias("c_doc"), "n", "copies"), "classes")
    marks = bitmap(classes.select("h1"))
    sets = own.mapInArrow(partial(_sets, k=k, marks=marks), "h1 long, h2 long, toks array<long>").groupBy("h1", "h2").agg(F.first("toks").alias("toks"))
    sets = cut(sets.join(classes.select("h1", "h2", "cid", "n"), ["h1", "h2"]).select("cid", "n", "toks"), "sets")

    levels = frequency_levels(sets)
    leading = cut(sets.mapInArrow(partial(_leading, levels=levels, num=num, den=den), "tok long, cid long, n long, place long"), "leading")
    leading = leading.withColumn("grp", F.col("cid"))
    grouped = None
    as_links = lambda roots: roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    for i in range(ROUNDS):
        drawn = F.struct(F.xxhash64(F.lit(i), "grp"), "grp", F.xxhash64(F.lit(i), "cid"), "cid", "n")
        heads = leading.groupBy("tok").agg(F.min(drawn).alias("x"), F.max(drawn).alias("y"), F.count("*").alias("c")).where("x.grp <> y.grp")
        given = attach(leading.select("tok", F.col("cid").alias("b"), F.col("n").alias("m"), "grp"), heads, "tok", "c", leading.count()).where("x is not null")
        given = given.select("b", "m", F.when(F.col("x.grp") != F.col("grp"), F.col("x")).otherwise(F.col("y")).alias("x"))
        given = given.where((F.col("x.n") * den >= F.col("m") * num) & (F.col("m") * den >= F.col("x.n") * num))
        votes = given.groupBy("b", F.col("x.cid").alias("a")).agg(F.count("*").alias("v")).where("v > 1")
        votes = votes.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("v", "a")), False), 1, 2).alias("best"))
        found = cut(linked(votes.select("b", F.explode("best.a").alias("a")), sets, num, den), "stars")
        if i and not found.limit(1).count():
            break
        # groups so far are links to their roots
        grouped = components(found if grouped is None else found.unionByName(as_links(grouped)), "groups")
        leading = leading.drop("grp").join(grouped, leading.cid == grouped.node, "left").select("tok", "cid", "n", "place", F.coalesce("root", "cid").alias("grp"))
        # shingles that one group alone has meet nothing
        common = leading.groupBy("tok").agg(F.min("grp").alias("x"), F.max("grp").alias("y")).where("x <> y").select("tok")
        leading = cut(leading.join(common, "tok", "left_semi"), "matrix")
    with_group = cut(sets.join(grouped, sets.cid == grouped.node, "left").select("cid", "n", F.coalesce("root", "cid").alias("grp"), "toks"), "grouped")

    met = meetings(leading, num, den).distinct()
    most = with_group.groupBy("grp").agg(F.max("n").alias("hi"), F.min("n").alias("lo"))
    kind = "grp long, bits binary"
    unions = with_group.join(most, "grp").select("grp", "hi", "toks").mapInArrow(_unions, kind).repartition("grp").sortWithinPartitions("grp").mapInArrow(_join_unions, kind)
    asked = cut(met, "met").join(most.select("grp", "lo"), "grp").join(unions, "grp").join(sets.select(F.col("cid").alias("a"), "toks"), "a")
    open_ = cut(asked.select("a", "n", "own", "grp", "lo", "bits", "toks").mapInArrow(partial(_bounded, num=num, den=den), "a long, n long, own long, grp long"), "open")

    # a few members of each group first: what they link needn't be compared with the rest
    members = with_group.select(F.col("cid").alias("b"), F.col("n").alias("m"), "grp")
    few = members.groupBy("grp", F.pmod(F.xxhash64("b"), F.lit(HEADS)).alias("h")).agg(F.min(F.struct("b", "m")).alias("x")).select("grp", "x.b", "x.m")
    size = (F.col("n") * den >= F.col("m") * num) & (F.col("m") * den >= F.col("n") * num)
    first = open_.join(few, "grp").where(size).select("a", "b").distinct()
    now = components(cut(linked(first, sets, num, den), "links").unionByName(as_links(grouped)), "some")
    root_of = lambda c, name: now.select(F.col("node").alias(c), F.col("root").alias(name))
    still = open_.join(root_of("own", "ra"), "own", "left").join(root_of("grp", "rb"), "grp", "left")
    still = still.where(F.coalesce("ra", "own") != F.coalesce("rb", "grp")).select("a", "n", "grp")
    pairs = still.join(members, "grp").where(size).select("a", "b").join(first.withColumn("_done", F.lit(True)), ["a", "b"], "left").where("_done is null").select("a", "b").distinct()
    # verified once: the component steps read their links several times
    roots = components(cut(linked(pairs, sets, num, den), "more").unionByName(as_links(now)), "all")

    placed = classes.join(roots, classes.cid == roots.node, "left").withColumn("root", F.coalesce("root", "cid"))
    names = placed.groupBy("root").agg(F.min(F.struct(F.col("c_doc").isNull().alias("last"), F.col("c_doc"), F.col("cid"))).alias("first"), F.sum("copies").alias("size")).where("size > 1")
    named = cut(placed.join(names, "root").select("h1", "h2", F.col("first.c_doc").alias("component_id"), F.col("first.cid").alias("first_row"), "copies"), "named")
    # classes with one member are joined like the others; hot ones are broadcast
    named = named.withColumn("set", F.struct("h1", "h2")).drop("h1", "h2")
    n_rows = rows.count()
    out = attach(rows.withColumn("set", F.struct("h1", "h2")), named, "set", "copies", n_rows)
    mine = F.col("first_row").isNull() | (F.col("n") == 0)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(mine, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "sig", "row", F.when(mine, F.col("row")).otherwise(F.col("first_row")).alias("first_row"))


def one_of_each(docs: DataFrame, k: int = K, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all columns, that come first in their component. Rows that repeat id and text stay or go together."""
    own, sig, gone, gone_sig = unused(docs, "id", "sig", "gone", "gone_sig")
    keyed = docs.withColumns({own: F.col(id_col).cast("long")}).withColumn(sig, F.xxhash64(own, F.col(text_col)))
    found = near_groups(docs, k, num, den, id_col, text_col)
    stays = F.max((F.col("first_row") == F.col("row")).cast("int"))
    lost = found.groupBy("doc_id", "sig").agg(stays.alias("s")).where("s = 0").select(F.col("doc_id").alias(gone), F.col("sig").alias(gone_sig))
    return keyed.join(lost, (F.col(sig) == F.col(gone_sig)) & F.col(own).eqNullSafe(F.col(gone)), "left_anti").drop(own, sig)
