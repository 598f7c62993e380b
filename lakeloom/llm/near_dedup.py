"""MinHash near-duplicates through an LSH forest, confirmed on full shingle sets.

1. Every text becomes its set of distinct SHINGLE-word shingles (64-bit hashes), the set's digest, and TREES * DEPTH
   minimum hashes. Texts with equal sets are one node, named by its smallest key.
2. Each tree lays the nodes out in the order of its own DEPTH hashes, in range partitions, HELD_ROWS or so at a time.
   Nodes that share the first LEAST_DEPTH hashes form a region; the NEIGHBOURS nodes before a node in its region are
   those with the longest common prefixes, up to DEPTH hashes. To tie a region together whose members are all near one
   text but not near each other, every member is also compared with the region's hub, the member closest to its
   majority. Work and candidates of this step are linear in the nodes; the pairs it leaves out are step 4's.
3. A candidate whose sketch (two bits of each minimum hash) is over four standard deviations below what the threshold
   implies is dropped; the others are confirmed on full sets by an integer test. Links are made into components by
   alternating large-star and small-star steps, each written to the shared folder.
4. Where a region holds more nodes than the window, or was cut by the end of a partition, and has more than one
   component, all its pairs from different components are compared: by sketch, and what passes on full sets, in pairs of
   blocks of CROWD_BLOCK nodes. The components so linked are merged. Afterwards each pair that shares a region was
   compared or is in one component, however the rows were cut.

Cases: a text without words, or null, is linked with nothing; with fewer words than a shingle the whole text is the
one shingle; rows with equal keys count as one document; rows without a key are linked with nothing and are their own
component, null; an empty table gives an empty table; other columns are never looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, parallelism, quoted, written

SHINGLE = 5
TREES, DEPTH, LEAST_DEPTH = 16, 6, 4
NEIGHBOURS = 12
#: Percent that the intersection must be of the union.
PERCENT = 85
#: Rows of a tree that are held together, about.
HELD_ROWS = 50_000
#: Tasks that the edges of one node are spread over.
SALTS = 16
#: Nodes in one block of a crowded region; a task holds two blocks.
CROWD_BLOCK = 1000
#: Shingles multiplied at once when two blocks are compared.
CROWD_SHINGLES = 2048
#: Words whose hashes a task remembers before it starts afresh.
REMEMBERED = 100_000
#: Ids sent to every executor at most; more go through a shuffle.
BROADCAST_IDS = 1_000_000
_HASHES = TREES * DEPTH
_ODD = np.random.default_rng(20240517).integers(1, 2**63, _HASHES + SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(33)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def shingle_set(text: str | None, known: dict[bytes, int]) -> np.ndarray:
    """Distinct shingle hashes of a text, ascending; known remembers hashes of words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z alone, and the same white space as WORD
    if not words:
        return np.zeros(0, np.uint64)
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    size = min(SHINGLE, len(h))
    n = len(h) - size + 1
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total += _mixed(h[k : k + n] * _ODD[_HASHES + k])
    return np.unique(_mixed(total))


def minimum_hashes(shingles: np.ndarray) -> np.ndarray:
    """The upper halves of the minimum of each multiplicative hash."""
    out = np.full(_HASHES, np.uint64(2**64 - 1))
    for k in range(0, len(shingles), 2048):
        np.minimum(out, (shingles[k : k + 2048, None] * _ODD[None, :_HASHES]).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def sketch(hashes: np.ndarray) -> bytes:
    """Two bits of each minimum hash."""
    low = ((hashes * np.uint32(0x9E3779B1)) >> np.uint32(30)).astype(np.uint8).reshape(-1, 4)
    return (low[:, 0] | low[:, 1] << 2 | low[:, 2] << 4 | low[:, 3] << 6).astype(np.uint8).tobytes()


def most_mismatches(percent: int) -> int:
    """Sketch cells that may differ: the mean at the threshold and four and a half standard deviations."""
    p = 0.75 * (1 - percent / 100)
    return int(np.ceil(_HASHES * p + 4.5 * np.sqrt(_HASHES * p * (1 - p))))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    for batch in batches:
        if len(known) > REMEMBERED:
            known.clear()
        sizes, digests, signs, sketches = [], [], [], []
        for text in batch.column(1).to_pylist():
            s = shingle_set(text, known)
            sizes.append(len(s))
            if not len(s):
                digests.append(None)
                signs.append(None)
                sketches.append(None)
                continue
            digests.append(xxhash.xxh3_128_digest(s.tobytes()))
            hashes = minimum_hashes(s)
            signs.append(hashes.astype(">u4").tobytes())
            sketches.append(sketch(hashes))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signs, pa.binary()), pa.array(sketches, pa.binary())], ["key", "n", "digest", "signs", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, int] = {}
    for batch in batches:
        if len(known) > REMEMBERED:
            known.clear()
        rows = [shingle_set(x, known).view(np.int64) for x in batch.column(1).to_pylist()]
        offsets = np.append(0, np.cumsum([len(x) for x in rows])).astype(np.int32)
        values = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], ["node", "shingles"])


def _mismatches(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    return np.bitwise_count((x | x >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(axis=1)


def _neighbours(percent: int):
    """Rows (tree, order, node, sketch), sorted, to candidate pairs (a, b), and the members (region, node as a, sketch) of
    regions that are larger than the window, or that may go on before or after the rows that were held together."""
    limit = most_mismatches(percent)
    names = ["a", "b", "region", "sketch"]

    def pairs_of(region: np.ndarray, node: np.ndarray, cells: np.ndarray, start: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        found = []
        for w in range(1, min(NEIGHBOURS, len(node) - 1) + 1):
            near = (region[w:] == region[:-w]) & (_mismatches(cells[w:], cells[:-w]) <= limit)
            found.append(np.stack([node[w:][near], node[:-w][near]], axis=1))
        for s, n in zip(start[sizes > NEIGHBOURS + 1].tolist(), sizes[sizes > NEIGHBOURS + 1].tolist(), strict=True):
            own = cells[s : s + n]
            major = np.zeros(own.shape[1], np.uint64)
            for bit in range(64):
                one = np.uint64(1) << np.uint64(bit)
                major |= np.where(2 * np.count_nonzero(own & one, axis=0) > n, one, np.uint64(0))
            hub = int(np.argmin(_mismatches(own, major[None, :])))
            near = node[s : s + n][_mismatches(own, own[hub][None, :]) <= limit]
            found.append(np.stack([near, np.full(len(near), node[s + hub])], axis=1))
        both = np.sort(np.concatenate(found), axis=1) if found else np.zeros((0, 2), np.int64)
        return np.unique(both[both[:, 0] != both[:, 1]], axis=0)

    def flushed(order: np.ndarray, node: np.ndarray, sketches: np.ndarray) -> Iterator[pa.RecordBatch]:
        """order: tree and the first LEAST_DEPTH hashes of each row, as bytes."""
        fresh = np.append(True, (order[1:] != order[:-1]).any(axis=1))
        region, start = np.cumsum(fresh) - 1, np.flatnonzero(fresh)
        sizes = np.diff(np.append(start, len(region)))
        both = pairs_of(region, node, sketches.view(np.uint64), start, sizes)
        if len(both):
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.nulls(len(both), pa.int64()), pa.nulls(len(both), pa.binary())], names)
        crowded = sizes > NEIGHBOURS + 1
        crowded[[0, -1]] = True
        marks = np.zeros(len(sizes), np.int64)
        for k in np.flatnonzero(crowded).tolist():
            marks[k] = xxhash.xxh3_64_intdigest(order[start[k]].tobytes()) - 2**63
        inside = np.flatnonzero(crowded[region])
        for k in range(0, len(inside), 10_000):
            at = inside[k : k + 10_000]
            rows = pa.array([x.tobytes() for x in sketches[at]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.nulls(len(at), pa.int64()), pa.array(marks[region[at]]), rows], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0
        for batch in batches:
            n = batch.num_rows
            tree = batch.column(0).to_numpy().astype(np.uint8).reshape(n, 1)
            hashes = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(n, -1)[:, : 4 * LEAST_DEPTH]
            held.append((np.hstack([tree, hashes]), batch.column(2).to_numpy(), np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, -1)))
            rows += n
            if rows > HELD_ROWS:
                whole = [np.concatenate(x) for x in zip(*held, strict=True)]
                yield from flushed(*whole)
                held, rows = [tuple(x[-NEIGHBOURS:] for x in whole)], NEIGHBOURS
        if rows:
            yield from flushed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return work


def _candidates(nodes: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b), a < b, of nodes that some tree puts near each other; and region, node and sketch of the
    members of regions that may be larger than the window."""
    width = 4 * DEPTH
    rows = nodes.select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), "node", "signs", "sketch").select(
        "tree", F.expr(f"substring(signs, 1 + {width} * tree, {width})").alias("order"), "node", "sketch"
    )
    parts = parallelism(nodes.sparkSession)
    ranged = rows.repartitionByRange(parts, "tree", "order").sortWithinPartitions("tree", "order", "node")
    found = written(in_arrow(ranged, _neighbours(percent), "a long, b long, region long, sketch binary"), "candidates")
    return found.where("b is not null").select("a", "b").distinct(), found.where("region is not null").select("region", F.col("a").alias("node"), "sketch")


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray | list]]:
    """Rows sorted by (region, i, j) to the columns of each such unit."""
    held: list[tuple] = []
    names: list[str] = []

    def columns(rows: list[tuple]) -> dict:
        return dict(zip(names, zip(*rows, strict=True), strict=True))

    for batch in batches:
        names = batch.schema.names
        plain = [c if pa.types.is_list(c.type) else c.to_pylist() for c in batch.columns]
        for row in zip(*plain, strict=True):
            if held and held[-1][:3] != row[:3]:
                yield columns(held)
                held = []
            held.append(row)
    if held:
        yield columns(held)


def _sides(unit: dict) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of a unit's first and second block, which are the same where i = j."""
    second = np.array(unit["second"], bool)
    return (np.arange(len(second)),) * 2 if unit["i"][0] == unit["j"][0] else (np.flatnonzero(~second), np.flatnonzero(second))


def _survivors(percent: int):
    """Rows of units to those that have a row of another component, in the other block, within the sketch's limit."""
    limit = most_mismatches(percent)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            comp = np.array(unit["comp"], np.int64)
            cells = np.frombuffer(b"".join(unit["sketch"]), np.uint64).reshape(len(comp), -1)
            left, right = _sides(unit)
            alive = np.zeros(len(comp), bool)
            for k in left.tolist():
                near = right[(comp[right] != comp[k]) & (_mismatches(cells[right], cells[k][None, :]) <= limit)]
                if len(near):
                    alive[k] = True
                    alive[near] = True
            if alive.any():
                at = np.flatnonzero(alive).tolist()
                yield pa.RecordBatch.from_pydict({c: [unit[c][k] for k in at] for c in ("region", "i", "j", "second", "node", "comp")}, pa.schema([("region", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("second", pa.bool_()), ("node", pa.int64()), ("comp", pa.int64())]))

    return work


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of left with each of right."""
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)  # exact to 2**24 shingles
    places = []
    for sets in (left, right):
        owner, values = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
        at = np.minimum(np.searchsorted(common, values), max(0, len(common) - 1))
        own = common[at] == values if len(common) else np.zeros(len(values), bool)
        owner, at = owner[own], at[own]
        order = np.argsort(at, kind="stable")
        places.append((owner[order], at[order]))
    for k in range(0, len(common), CROWD_SHINGLES):
        parts = []
        for (owner, at), sets in zip(places, (left, right), strict=True):
            lo, hi = np.searchsorted(at, [k, k + CROWD_SHINGLES])
            part = np.zeros((len(sets), CROWD_SHINGLES), np.float32)
            part[owner[lo:hi], at[lo:hi] - k] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out.astype(np.int64)


def _bridged(percent: int):
    """Rows of units with their sets to pairs (u, v), u > v, of components that a pair of nodes links."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches):
            comp = np.array(unit["comp"], np.int64)
            sets = [x.values.to_numpy() for x in unit["shingles"]]
            left, right = _sides(unit)
            if not len(left) or not len(right):
                continue
            shared = _shared([sets[k] for k in left], [sets[k] for k in right])
            sizes = np.array([len(x) for x in sets], np.int64)
            linked = 100 * shared >= percent * (sizes[left][:, None] + sizes[right][None, :] - shared)
            a, b = np.nonzero(linked & (comp[left][:, None] != comp[right][None, :]))
            both = np.unique(np.stack([np.maximum(comp[left[a]], comp[right[b]]), np.minimum(comp[left[a]], comp[right[b]])], axis=1), axis=0)
            if len(both):
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["u", "v"])

    return work


def _bridges(crowds: DataFrame, stars: DataFrame, narrow: DataFrame, percent: int) -> DataFrame | None:
    """Pairs (u, v), u > v, of components that a pair of nodes in one crowded region links; None if there are none."""
    parts = parallelism(crowds.sparkSession)
    told = crowds.join(stars.select(F.col("u").alias("node"), F.col("v").alias("smallest")), "node", "left").select("region", "node", F.coalesce("smallest", "node").alias("comp"), "sketch")
    told = written(told, "crowds")
    several = told.groupBy("region").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    several = written(several.select("region", F.ceil(F.col("n") / CROWD_BLOCK).cast("int").alias("blocks")), "crowded")
    regions = several.count()
    if not regions:
        return None
    rows = told.join(F.broadcast(several) if regions <= BROADCAST_IDS else several, "region").dropDuplicates(["region", "node"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.select("region", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("second"), "node", "comp", "sketch")
    dealt = rows.repartition(parts, "region", "i", "j").sortWithinPartitions("region", "i", "j")
    alive = written(in_arrow(dealt, _survivors(percent), "region long, i int, j int, second boolean, node long, comp long"), "survivors")
    ids = alive.select("node").distinct()
    n = ids.count()
    if not n:
        return None
    chosen = narrow.where("key is not null").join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, F.col("key") == F.col("node"), "left_semi").dropDuplicates(["key", "text"])
    sized = alive.join(in_arrow(chosen, _sets, "node long, shingles array<long>"), "node").select("region", "i", "j", "second", "comp", "shingles")
    dealt = sized.repartition(parts, "region", "i", "j").sortWithinPartitions("region", "i", "j")
    return written(in_arrow(dealt, _bridged(percent), "u long, v long").distinct(), "bridges")


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges and m of their u; the edges of one u, which may be most of all, are dealt by salt too."""
    spread = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return spread.join(least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["u", "salt"])


def _stars(edges: DataFrame) -> DataFrame:
    """Edges (u, v), u > v, to stars (u, smallest of its component)."""
    state = None
    while True:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = _with_least(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, least).select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if now == state:
            return edges
        state = now


def components(docs: DataFrame, percent: int = PERCENT, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_shingles, component_id and kept of every row."""
    narrow = docs.select(F.col(quoted(key)).cast("long").alias("key"), F.col(quoted(text)).cast("string").alias("text"))
    rows = written(in_arrow(narrow, _features, "key long, n long, digest binary, signs binary, sketch binary"), "features")
    # Equal sets share a node; rows with equal keys too. Signs are functions of the digest, so any will do.
    named = rows.where("digest is not null and key is not null")
    digests = named.groupBy("digest").agg(F.min("key").alias("node"), F.first("signs").alias("signs"), F.first("sketch").alias("sketch"))
    digests = written(digests, "digests")
    near, crowds = _candidates(digests.select("node", "signs", "sketch"), percent)
    near = written(near, "pairs")
    ids = near.select(F.col("a").alias("node")).unionAll(near.select(F.col("b").alias("node"))).distinct()
    few = ids.count() <= BROADCAST_IDS
    chosen = narrow.where("key is not null").join(F.broadcast(ids) if few else ids, F.col("key") == F.col("node"), "left_semi").dropDuplicates(["key", "text"])
    sets = in_arrow(chosen, _sets, "node long, shingles array<long>")
    sized = near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    linked = sized.select("a", "b", F.size("of_a").alias("m"), F.size("of_b").alias("n"), shared.alias("shared")).where(f"100L * shared >= {percent}L * (m + n - shared)")
    same_key = named.join(digests.select("digest", "node"), "digest").where("key <> node").select(F.col("key").alias("u"), F.col("node").alias("v"))
    # Members of a node matter as edges only if their key also names or joins another node.
    repeated = named.groupBy("key").agg(F.count_distinct("digest").alias("k")).where("k > 1").select(F.col("key").alias("u"))
    edges = linked.select(F.col("b").alias("u"), F.col("a").alias("v")).unionAll(same_key.join(repeated, "u"))
    stars = _stars(written(edges.distinct(), "links"))
    bridges = _bridges(crowds, stars, narrow, percent)
    if bridges is not None and bridges.head(1):
        stars = _stars(written(stars.unionAll(bridges), "links"))
    of_digest = digests.select("digest", "node").join(stars.select(F.col("u").alias("node"), F.col("v").alias("smallest")), "node", "left").select("digest", F.coalesce("smallest", "node").alias("component"))
    out = rows.join(of_digest, "digest", "left")
    component = F.when(F.col("key").isNotNull(), F.coalesce("component", "key"))
    return out.select(F.col("key").cast(docs.schema[key].dataType).alias(key), F.col("n").alias("n_shingles"), component.cast("long").alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, whose document is the smallest of its component."""
    gone = written(components(docs, percent).where("not kept").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs["doc_id"] == F.col("gone"), "left_anti")
