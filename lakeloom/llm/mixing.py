"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

The documents of a source, in an order drawn from a seed, form one stream of words, cut into blocks of BLOCK_WORDS; of
tables of few words the blocks are smaller, so that LEAST_BLOCKS or so can be dealt out.
All blocks of the mix are allocated one by one to the source with the highest quotient target / (2 * blocks held + 1),
and the blocks of each source in the same way to its SHARDS runs of blocks. Where a shard's quota is q of n blocks,
each block is taken q // n times, and q % n blocks at even distances from a seeded start once more. A document's share
of the mix is what the taken blocks hold of it, so no document is taken more than twice as long as no target exceeds
twice its source.

Documents are never gathered: sizes are summed per source and range of hashes, offsets are running sums of those sums,
and the order inside a range is a window over (key, size) rows alone. The ranges grow in number with the rows and don't
change the order. Only one row per source reaches the driver. Shards hold MOST_BLOCKS blocks at most, so that products
of two numbers of blocks are exact whole numbers at any size.

Cases: a null or wordless text has size 0 and takes 0; null sources are one source, the last in order; repeated rows
are documents of their own; an empty table gives an empty table; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, quoted, written

BLOCK_WORDS, LEAST_BLOCKS = 64, 4096
SHARDS, MOST_BLOCKS = 32, 1 << 30
#: Rows of a table for each range of hashes, and bits of a hash that tell a range at most, as a source's ranges are added up in one window.
RANGE_ROWS, RANGE_BITS = 500, 16
WEIGHTS = (5.0, 2.0, 1.0)
TOTAL = 1.5
MOST = 2.0
SEED = 20240229
#: One copy, where shares are added up as whole numbers.
UNIT = 1 << 20
#: Documents whose numbers of copies are sent to every executor at most; more go through a shuffle.
BROADCAST_DOCS = 500_000


def targets(sizes: Sequence[float], weights: Sequence[float], total: float, most: float = MOST) -> list[float]:
    """Shares of total by weight; none above most times its size, the excess shared again by weight among the rest."""
    out = [0.0] * len(sizes)
    open_, left = set(range(len(sizes))), float(total)
    while open_:
        weight = sum(weights[k] for k in open_)
        full = {k for k in open_ if left * weights[k] / weight > most * sizes[k]}
        if not full:
            for k in open_:
                out[k] = left * weights[k] / weight
            break
        for k in full:
            out[k] = most * sizes[k]
            left -= out[k]
        open_ -= full
    return out


def sainte_lague(seats: int, votes: Sequence[float], most: Sequence[int]) -> list[int]:
    """Seats by the highest quotients votes / (2 * held + 1), none above most; ties go to the first.

    Whole multiples that the method is sure to reach are given at once, so the work doesn't grow with the seats.
    """
    held = [0] * len(votes)
    total = sum(v for v, m in zip(votes, most, strict=True) if m > 0)
    if total <= 0:
        return held
    seats = min(seats, sum(m for v, m in zip(votes, most, strict=True) if v > 0))
    # With divisor d each party gets about votes / (2 d) seats; a d a little too large gives no seat too many.
    divisor = total / (2 * max(1, seats)) * (1 + len(votes) / max(1, seats))
    for k, v in enumerate(votes):
        held[k] = max(0, min(most[k], int((v / divisor + 1) / 2)))
    while sum(held) > seats:  # not before rounding errors: take back the lowest quotients
        k = min((k for k in range(len(votes)) if held[k]), key=lambda k: (votes[k] / (2 * held[k] - 1), -k))
        held[k] -= 1
    heap = [(-v / (2 * h + 1), k) for k, (v, h, m) in enumerate(zip(votes, held, most, strict=True)) if v > 0 and h < m]
    heapq.heapify(heap)
    for _ in range(seats - sum(held)):
        _, k = heapq.heappop(heap)
        held[k] += 1
        if held[k] < most[k]:
            heapq.heappush(heap, (-votes[k] / (2 * held[k] + 1), k))
    return held


def block_words(words: int) -> int:
    """Words of one block in a table of so many words."""
    return max(1, min(BLOCK_WORDS, words // LEAST_BLOCKS))


def drawn(*parts: object) -> int:
    """A number below 2**60 from the parts' text; SQL has the same."""
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def _drawn(*parts: Column | str) -> Column:
    """What drawn gives, of columns; nulls are left out."""
    text = F.concat_ws(":", *((F.col(x) if isinstance(x, str) else x).cast("string") for x in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def quotas(sizes: dict, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, block: int | None = None, shards: int = SHARDS, seed: int = SEED) -> list[dict]:
    """For every source its size, target, and shards: where each begins, how many blocks it has, its quota and start."""
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    size = [sizes[x] for x in order]
    block = block or block_words(sum(size))
    aim = targets(size, [weights[k % len(weights)] for k in range(len(order))], total * sum(size))
    blocks = [-(-n // block) for n in size]
    seats = sainte_lague(int(min(total, MOST) * sum(size) / block + 0.5), aim, [int(MOST) * n for n in blocks])
    out = []
    for k, source in enumerate(order):
        per = max(1, min(MOST_BLOCKS, -(-blocks[k] // shards)))
        have = [min(per, blocks[k] - at) for at in range(0, blocks[k], per)]
        share = sainte_lague(seats[k], [float(x) for x in have], [int(MOST) * x for x in have])
        runs = [{"blocks": n, "base": q // n, "rest": q % n, "turn": drawn(seed, k, j, size[k]) % n} for j, (n, q) in enumerate(zip(have, share, strict=True))]
        done = 0
        for run, q in zip(runs, share, strict=True):
            run["before"] = done
            done += q
        out.append({"source": source, "size": size[k], "target": aim[k], "per": per, "runs": runs, "block": block})
    return out


def _taken_before(place: str) -> Column:
    """Words the mix takes of the first `place` words of a source's stream, in whole numbers."""
    at = f"least({place} div block div per, size(runs) - 1)"
    run = f"get(runs, cast({at} as int))"
    local = f"({place} div block - {at} * per)"
    more = lambda upto: f"(({upto} + {run}.turn) * {run}.rest div {run}.blocks - {run}.turn * {run}.rest div {run}.blocks)"  # noqa: E731  extra blocks among the first `upto`
    return F.expr(f"({run}.before + {local} * {run}.base + {more(local)}) * block + {place} % block * ({run}.base + {more(f'({local} + 1)')} - {more(local)})")


def _ranges(rows: int) -> int:
    """Bits of a hash that tell its range, for so many rows."""
    return max(1, min(RANGE_BITS, (rows // RANGE_ROWS).bit_length()))


def mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, seed: int = SEED, block: int | None = None) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row."""
    return _shares(docs, weights, total, seed, block).drop("source")


def _shares(docs: DataFrame, weights: Sequence[float] = WEIGHTS, total: float = TOTAL, seed: int = SEED, block: int | None = None) -> DataFrame:
    """What mixed returns, and source."""
    spark = docs.sparkSession
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"))
    sized = written(sized.withColumn("place", _drawn(F.lit(seed), "doc_id", "size")), "sizes")  # the texts are read once
    spread = sized.withColumn("bucket", F.shiftright("place", 60 - _ranges(sized.count())))
    sums = spread.groupBy("source", "bucket").agg(F.sum("size").alias("words")).select("source", "bucket", "words")
    per_source = {x["source"]: x["size"] for x in sums.groupBy("source").agg(F.sum("words").alias("size")).collect()}  # a row per source
    plan = quotas(per_source, weights, total, block, seed=seed)
    schema = "of string, source_size long, target double, per long, block long, runs array<struct<blocks: long, base: long, rest: long, turn: long, before: long>>"
    rows = [(x["source"], x["size"], float(x["target"]), x["per"], x["block"], [(r["blocks"], r["base"], r["rest"], r["turn"], r["before"]) for r in x["runs"]]) for x in plan]
    table = spark.createDataFrame(rows, schema)
    offsets = sums.withColumn("offset", F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select(
        F.col("source").alias("of"), F.col("bucket").alias("in"), F.coalesce("offset", F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("source", "bucket").orderBy("place", F.col("doc_id").asc_nulls_first(), "size")
    run = spread.withColumn("end", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("in"))).drop("of", "in")
    run = run.join(F.broadcast(table) if sum(len(x["runs"]) + 1 for x in plan) <= 100_000 else table, F.col("source").eqNullSafe(F.col("of")))
    run = run.withColumn("until", F.col("offset") + F.col("end")).withColumn("since", F.col("until") - F.col("size"))
    taken = F.when(F.col("size") > 0, _taken_before("until") - _taken_before("since")).otherwise(0).cast("long")
    return run.select("source", "doc_id", "size", "source_size", "target", taken.alias("taken"))


def _copies(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size and copies of the documents that the mix takes, in whole copies.

    The shares taken / size of a source's documents are laid end to end from a seeded start, by size class and hash, and a
    document has a copy for each whole number in its stretch: its share rounded up or down, so that copies and words of
    each size class keep to the shares.
    """
    seed = options.get("seed", SEED)
    every = _shares(docs, **options).where("taken > 0").groupBy("doc_id", "size").agg(F.min("source").alias("source"), F.avg(F.col("taken") / F.col("size")).alias("share"))
    place = _drawn(F.lit(f"{seed}:copies"), "doc_id", "size")
    every = every.select("doc_id", "size", "source", F.round(F.col("share") * UNIT).cast("long").alias("part"), F.floor(2 * F.log2("size")).cast("int").alias("class"), place.alias("place"))
    every = written(every, "shares")
    every = every.withColumn("bucket", F.shiftright("place", 60 - _ranges(every.count())))
    sums = every.groupBy("source", "class", "bucket").agg(F.sum("part").alias("parts"))
    before = Window.partitionBy("source").orderBy("class", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    start = F.pmod(_drawn(F.lit(f"{seed}:start"), F.coalesce("source", F.lit(""))), F.lit(UNIT))
    offsets = sums.select(F.col("source").alias("of"), F.col("class").alias("kind"), F.col("bucket").alias("in"), (F.coalesce(F.sum("parts").over(before), F.lit(0)) + start).alias("offset"))
    inside = Window.partitionBy("source", "class", "bucket").orderBy("place", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    run = every.withColumn("end", F.sum("part").over(inside))
    run = run.join(offsets, F.col("source").eqNullSafe(F.col("of")) & (F.col("class") == F.col("kind")) & (F.col("bucket") == F.col("in")))
    until = F.col("offset") + F.col("end")
    return run.select("doc_id", "size", (F.floor(until / UNIT) - F.floor((until - F.col("part")) / UNIT)).cast("int").alias("copies")).where("copies > 0")


def repeated(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it, in whole copies (none drops it).

    Rows with equal doc_id and size are taken equally often.
    """
    every = _copies(docs, **options)
    every = written(every.select(F.struct(F.col("doc_id").alias("id"), "size").alias("of"), F.array_repeat(F.lit(0), F.col("copies")).alias("copies")), "copies")
    few = every.count() <= BROADCAST_DOCS
    whole = docs.select(F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("row"))
    size = n_words(F.col("row").getField("text"))
    joined = whole.join(F.broadcast(every) if few else every, F.col("row").getField("doc_id").eqNullSafe(F.col("of.id")) & (size == F.col("of.size")))
    return joined.select("row", F.explode("copies")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
