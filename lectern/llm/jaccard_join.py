"""N-gram Jaccard links by a parity-sketch join.

A document's set of word shingles is hashed; the hashes fall into cells, and a cell's sketch is the XOR of its
hashes, so that each shingle of the symmetric difference changes one cell at most: the number of
differing cells is a lower bound of the symmetric difference. Sets that link differ in at most d shingles,
d following from the threshold and the larger size, so with d + 1 cells and some to spare at least
one cell agrees (pigeonhole). Sizes fall into bands that set d and the cells; a document
takes part in its own band and in those that a larger partner may be in. Documents meet by band, cell and
sketch. A document with more empty cells than there are to spare also meets others of that kind by its empty
cells, for those may be all that agree.

Who meets is not yet paired with everyone: members of a bucket are paired with its first. Each node also has one
bit sketch, into which its hashes are XORed as single bits; the Hamming distance of two such sketches
is again a lower bound of the symmetric difference, a tight one, so few pairs reach the test of whole sets.
Tests become links and links components. Then members of different components of a bucket are compared by their
bit sketches where they meet, without a row for a pair; of those near enough each member's nearest are
tested, components grow, and in the last round all that are near enough and untested are. What stays untested
is in one component already or proven apart, so components are those of all links. Equal sets count
as one node, copies in a task are merged before anything moves.

Edge cases: a text with fewer words than a shingle is one shingle; without words or null it has none
and links with nothing; rows that share a doc_id or have none are documents of their own, and a component is named by its
smallest doc_id, null being the smallest; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.arrow import gathered, slices, texts
from lectern.llm.common import discard, identified, small_enough, written
from lectern.llm.components import components
from lectern.llm.wordhash import chain, mix, words_of
from lectern.llm.worker import map_arrow

#: Bytes of text a slice; ratio of a band's bounds; rounds in which a member's nearest are tested before all are, and how many.
SCAN_BYTES, RATIO, ROUNDS, NEAREST = 3_000_000, 1.5, 2, 1
#: 64-bit words of sketches that are compared at a time.
WORDS = 1_500_000
#: Members of a node that one task tests; rows gathered of sorted batches.
TESTED, GATHER = 1_000, 100_000
#: Pairs put out at a time.
PUT_OUT = 50_000
#: Pairs, of 24 bytes, that may be broadcast.
FEW = 100_000


def shingle_sets(bodies: list[str], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, A-Z made lower case."""
    hashes, counts = words_of([t.encode().lower() for t in bodies])
    out, at = [], 0
    for n in counts.tolist():
        own = hashes[at : at + n]
        at += n
        # The length keeps a short whole text apart from shingles of other lengths.
        out.append(np.unique(chain(own, min(size, n)) ^ np.uint64(min(size, n))) if n else own)
    return out


def digest(found: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    a, b = mix(found).sum(dtype=np.uint64), mix(found ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


class Bands:
    """Bands of set sizes, and for each the most shingles in which linked sets differ, its cells, and those to spare."""

    def __init__(self, percent: int, largest: int):
        self.percent, self.low = percent, [1]
        while self.low[-1] <= largest:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * RATIO)))

    def of(self, n: int) -> int:
        return int(np.searchsorted(self.low, n, "right")) - 1

    def reach(self, n: int) -> range:
        """The bands in which a set of ``n`` may be the smaller or the larger of a pair."""
        return range(self.of(n), self.of(n * 100 // self.percent) + 1)

    def cells(self, band: int) -> tuple[int, int]:
        high = self.low[band + 1] - 1
        # 100 * both >= percent * (all): all - both <= (100 - percent) / (100 + percent) * (|A| + |B|)
        differ = (100 - self.percent) * 2 * high // (100 + self.percent)
        spare = 2 + -(-differ * 8 // 100) if differ else 0
        return differ + 1 + spare, spare


def sketches(found: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(bucket key, number of the set) of all sets."""
    keys, owners = [], []
    by_band: dict[int, list[int]] = {}
    for i, s in enumerate(found):
        if len(s):
            for b in bands.reach(len(s)):
                by_band.setdefault(b, []).append(i)
    for b, own in by_band.items():
        cells, spare = bands.cells(b)
        sizes = np.array([len(found[i]) for i in own])
        values = np.concatenate([found[i] for i in own])
        place = np.repeat(np.arange(len(own)) * cells, sizes) + (mix(values + np.uint64(b)) % np.uint64(cells)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place = place[order]
        first = np.flatnonzero(np.diff(place, prepend=-1))
        parity, place = np.bitwise_xor.reduceat(values[order], first), place[first]
        owner, cell = place // cells, place % cells
        base = np.uint64(b) << np.uint64(40)
        keys.append(mix(parity ^ mix(base | cell.astype(np.uint64))))
        owners.append(np.array(own)[owner])
        filled = np.bincount(owner, minlength=len(own))
        for i in np.flatnonzero(cells - filled > spare).tolist():
            empty = np.setdiff1d(np.arange(cells), cell[owner == i])
            keys.append(mix(mix(base | np.uint64(1 << 39) | empty.astype(np.uint64))))
            owners.append(np.full(len(empty), own[i]))
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def profiles(own: DataFrame, size: int) -> DataFrame:
    """(doc, n, s1, s2): each document's set size and the set's name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SCAN_BYTES):
            found = shingle_sets(texts(b), size)
            names = [digest(s) for s in found]
            columns = [b.column("doc"), pa.array([len(s) for s in found], pa.int64()), *(pa.array([x[k] for x in names], pa.int64()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n", "s1", "s2"])

    return map_arrow(own, run, "doc long, n long, s1 long, s2 long")


def bucket_links(own: DataFrame, size: int, percent: int) -> DataFrame:
    """(key, doc, lead): every member of a bucket but its first, with a member before it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(percent, 1 << 40)
        for b in slices(batches, most=SCAN_BYTES):
            docs, seen, found = [], set(), []
            for doc, s in sorted(zip(b.column("doc").to_pylist(), shingle_sets(texts(b), size), strict=True), key=lambda x: x[0]):
                if len(s) and (name := (len(s), *digest(s))) not in seen:
                    seen.add(name)
                    docs.append(doc)
                    found.append(s)
            key, owner = sketches(found, bands)
            key, doc = key.view(np.int64), np.array(docs, np.int64)[owner]
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            lead = doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(key) else doc
            # Followers need no meeting any more; they go anywhere.
            route = np.where(new, key, mix((key ^ doc).view(np.uint64)).view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (route, key, doc, lead)], ["route", "key", "doc", "lead"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, last_lead = None, None
        for b in gathered(batches, GATHER):
            key, doc, lead = (b.column(c).to_numpy() for c in ("key", "doc", "lead"))
            mine = doc == lead
            own_key, own_doc = key[mine], doc[mine]
            new = np.ones(len(own_key), bool)
            new[1:] = own_key[1:] != own_key[:-1]
            first = own_doc[np.flatnonzero(new)][np.cumsum(new) - 1] if len(own_key) else own_doc
            if len(own_key) and own_key[0] == last_key:
                head = own_key == last_key
                first = np.where(head, last_lead, first)
                new[0] = False
            if len(own_key):
                last_key, last_lead = int(own_key[-1]), int(first[-1])
            rest = ~new
            out = [np.concatenate([x, y]) for x, y in ((own_key[rest], key[~mine]), (own_doc[rest], doc[~mine]), (first[rest], lead[~mine]))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["key", "doc", "lead"])

    rows = map_arrow(own, cut, "route long, key long, doc long, lead long")
    return map_arrow(rows.repartition("route").sortWithinPartitions("route", "key", "doc"), meet, "key long, doc long, lead long").where("doc <> lead")


def most_apart(a: np.ndarray | int, b: np.ndarray | int, percent: int) -> np.ndarray | int:
    """The largest symmetric difference of linked sets of sizes ``a`` and ``b``."""
    return (100 - percent) * (a + b) // (100 + percent)


def bit_sketch(found: np.ndarray, percent: int) -> bytes:
    """Bits into which the hashes are XORed; a power of two of them, ten times the differences of linked sets or more, so few fall together."""
    size = 1 << int(10 * most_apart(len(found), len(found), percent) + 255).bit_length()
    bits = np.bincount((mix(found ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def unfolded(raw: bytes, size: int) -> np.ndarray:
    """The sketch as 64-bit words, its halves XORed until it has ``size`` bytes."""
    x = np.frombuffer(raw, np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def set_table(own: DataFrame, need: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc, n, found, sketch) of the documents in need(doc): the set's size, sorted hashes and bit sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SCAN_BYTES):
            found = shingle_sets(texts(b), size)
            columns = [pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary()), pa.array([bit_sketch(s, percent) for s in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column("doc"), *columns], ["doc", "n", "found", "sketch"])

    return map_arrow(own.hint("merge").join(need, "doc", "left_semi"), run, "doc long, n long, found binary, sketch binary")


def near_enough(n: int, raw: bytes, m: int, other: bytes, percent: int) -> bool:
    """Whether the bit sketches leave it open that sets of ``n`` and ``m`` link."""
    if min(n, m) * 100 < max(n, m) * percent:
        return False
    size = min(len(raw), len(other))
    return int(np.bitwise_count(unfolded(raw, size) ^ unfolded(other, size)).sum()) <= most_apart(n, m, percent)


def sets_link(n: int, raw: bytes, m: int, other: bytes, percent: int) -> bool:
    """Whether sets of ``n`` and ``m`` hashes link."""
    if min(n, m) * 100 < max(n, m) * percent:
        return False
    a, b = np.frombuffer(raw, np.uint64), np.frombuffer(other, np.uint64)
    both = int((b[np.minimum(np.searchsorted(b, a), m - 1)] == a).sum())
    return 100 * both >= percent * (n + m - both)


def passing(pairs: DataFrame, sets: DataFrame, column: str, test: Callable, percent: int) -> DataFrame:
    """The pairs(a, b) whose values of ``column`` pass the test. A node with many partners is tested by several tasks."""
    many = pairs.groupBy("a").agg(F.count("*").alias("n"))
    routed = pairs.join(many.hint("merge"), "a").select("a", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / TESTED)).alias("part"), F.col("b").alias("doc"))
    routed = routed.unionByName(routed.select("a", "part", F.col("a").alias("doc")).distinct())
    own = sets.select("doc", "n", F.col(column).alias("raw"))
    # Few pairs go to the sets, otherwise both sides are dealt by document.
    met = own.join(F.broadcast(routed), "doc") if small_enough(pairs, FEW) else routed.join(own.hint("merge"), "doc")
    met = met.repartition("a", "part").sortWithinPartitions("a", "part", F.col("doc") != F.col("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, size, base = None, 0, b""
        for b in batches:
            out = []
            for a, part, doc, n, raw in zip(*(b.column(c).to_pylist() for c in ("a", "part", "doc", "n", "raw")), strict=True):
                if doc == a:
                    at, size, base = (a, part), n, raw
                    continue
                assert at == (a, part), "a node's own row comes first"
                if test(n, raw, size, base, percent):
                    out.append((a, doc))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return map_arrow(met.select("a", "part", "doc", "n", "raw"), run, "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    return passing(pairs, sets, "found", sets_link, percent)


def near_pairs(members: DataFrame, nearest: int | None, percent: int) -> DataFrame:
    """(key, a, b) of members(key, node, component, n, sketch) of different components of a bucket whose bit sketches are near enough.

    With ``nearest`` only so many of the nearest for each member, block by block. A bucket that gives none never will, for
    components only grow.
    """

    def compare(rows: list[tuple]) -> Iterator[list[tuple[int, int]]]:
        size = min(len(r[3]) for r in rows)
        node, component, n = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        bits = np.stack([unfolded(r[3], size) for r in rows])
        side = max(4, int((WORDS / bits.shape[1]) ** 0.5))
        for i in range(0, len(rows), side):
            for j in range(i, len(rows), side):
                x, y = slice(i, i + side), slice(j, j + side)
                apart = np.bitwise_count(bits[x, None] ^ bits[None, y]).sum(axis=2, dtype=np.int64)
                p, q = n[x, None], n[None, y]
                good = (apart <= most_apart(p, q, percent)) & (np.minimum(p, q) * 100 >= np.maximum(p, q) * percent) & (component[x, None] != component[None, y])
                if nearest is not None and good.any():
                    ranked = np.where(good, apart, 1 << 40)
                    k = min(nearest, ranked.shape[1]) - 1
                    good &= ranked <= np.partition(ranked, k, axis=1)[:, k : k + 1]
                    few = np.cumsum(good, axis=1) <= nearest
                    good &= few
                u, v = np.nonzero(good)
                if len(u):
                    a, b = node[i + u], node[j + v]
                    yield list(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Neighbouring buckets have many pairs in common: each is put out once a batch, and something for each bucket with a pair.
        held: list[tuple] = []
        last, out, seen = None, [], set()

        def batch() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["key", "a", "b"])
            out.clear()
            seen.clear()
            return rows

        def compared() -> Iterator[pa.RecordBatch]:
            near, new = None, False
            for pairs in compare(held) if len(held) > 1 else ():
                for near in pairs:
                    if near not in seen:
                        seen.add(near)
                        out.append((last, *near))
                        new = True
                if len(out) >= PUT_OUT:
                    yield batch()
            if near and not new:
                out.append((last, *near))

        for b in gathered(batches, 20_000):
            for key, *row in zip(*(b.column(c).to_pylist() for c in ("key", "node", "component", "n", "sketch")), strict=True):
                if key != last and held:
                    yield from compared()
                    held = []
                last = key
                held.append(tuple(row))
        yield from compared()
        if out:
            yield batch()

    dealt = members.repartition("key").sortWithinPartitions("key", "node").select("key", "node", "component", "n", "sketch")
    return map_arrow(dealt, run, "key long, a long, b long")


def _ordered(pairs: DataFrame, x: str, y: str) -> DataFrame:
    return pairs.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def near_groups(docs: DataFrame, shingle: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id of every document: sets link at ``percent`` per cent Jaccard similarity or more."""
    own, same = identified(docs, text, doc_id)
    rows = near_rows(own, shingle, percent)
    if same:
        return rows.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    ids = own.select("doc", "doc_id")
    rows = rows.join(ids.select("doc", "doc_id").hint("merge"), "doc")
    rows = rows.join(ids.select(F.col("doc").alias("component"), F.col("doc_id").alias("component_id")).hint("merge"), "component")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def near_rows(own: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc, n, component) of every row of own(doc, text), ``doc`` being its own: the size of its set, the smallest doc reachable by links."""
    own = own.select("doc", "text")
    known = written(profiles(own, shingle))
    names = known.where("n > 0").groupBy("n", "s1", "s2").agg(F.min("doc").alias("rep"))
    names = names.select(F.xxhash64("n", "s1", "s2").alias("name"), "n", "s1", "s2", "rep")
    # On name and parts, so both sides are dealt anew and a hot set's documents can be split over tasks.
    full = known.where("n > 0").withColumn("name", F.xxhash64("n", "s1", "s2")).join(names.hint("merge"), ["name", "n", "s1", "s2"])
    nodes = written(full.select("doc", "rep", "n"))
    of_doc = nodes.select("doc", "rep")

    links = written(bucket_links(own, shingle, percent))
    first = links.select("doc", "lead").distinct()
    first = first.join(of_doc, "doc").select("lead", F.col("rep").alias("x")).join(of_doc.select(F.col("doc").alias("lead"), F.col("rep").alias("y")), "lead")
    met = written(_ordered(first, "x", "y"))
    need = met.select(F.col("a").alias("doc")).unionByName(met.select(F.col("b").alias("doc"))).distinct()
    sets = written(set_table(own, need, shingle, percent))
    tested = written(passing(met, sets, "sketch", near_enough, percent))
    edges = written(linked(tested, sets, percent))
    label = components(edges)

    # Members of buckets, as nodes; only buckets with different nodes matter.
    members = links.select("key", "doc").unionByName(links.select("key", F.col("lead").alias("doc")))
    inside = written(members.join(of_doc, "doc").select("key", F.col("rep").alias("node")).distinct())
    discard(links, met)
    used = [sets, tested, edges]
    for round_ in range(ROUNDS + 1):
        placed = inside.join(label, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
        open_ = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
        members = placed.join(open_.hint("merge"), "key", "left_semi").join(sets.select(F.col("doc").alias("node"), "n", "sketch").hint("merge"), "node")
        near = written(near_pairs(members, NEAREST if round_ < ROUNDS else None, percent))
        # Only buckets with a near pair may give more.
        alive = written(inside.join(near.select("key").distinct().hint("merge"), "key", "left_semi"))
        more = written(near.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
        discard(inside, near)
        inside = alive
        used.append(more)
        if more.isEmpty():
            continue
        found = written(linked(more, sets, percent))
        tested = tested.unionByName(more)
        used.append(found)
        if not found.isEmpty():
            edges = edges.unionByName(found)
            label = components(edges)
    discard(inside, *used)

    rows = nodes.join(label.select(F.col("node").alias("rep"), "component"), "rep", "left").select("doc", "n", F.coalesce("component", "rep").alias("component"))
    return rows.unionByName(known.where("n = 0").select("doc", "n", F.col("doc").alias("component")))
