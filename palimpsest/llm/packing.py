"""Operator 7, best-fit packing: bin completion, a branch and bound over undominated fillings, with best-fit solutions as incumbents."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.mixing import tokens_of
from palimpsest.llm.tables import HIDDEN, first_row_order, q, read
from palimpsest.shared import cut

CAPACITY, BLOCK, NODES = 2048, 2048, 60_000


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing over ``sizes`` (sorted, largest first): bins of sizes. A bit set of open residuals finds the tightest bin."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    open_rooms = 0
    for s in sizes:
        fit = open_rooms >> s
        if fit:
            room = s + ((fit & -fit).bit_length() - 1)
            at = by_room[room]
            i = at.pop()
            if not at:
                open_rooms &= ~(1 << room)
            bins[i].append(s)
        else:
            room, i = capacity, len(bins)
            bins.append([s])
        room -= s
        if room:
            by_room.setdefault(room, []).append(i)
            open_rooms |= 1 << room
    return bins


def fillings(sizes: list[int], count: Counter, room: int, most_waste: int, budget: list[int]) -> Iterator[tuple[int, ...]]:
    """Undominated subsets of the remaining pieces that leave at most ``most_waste`` of ``room``, those of least waste first.

    ``sizes``: the distinct sizes, in the order to try them. A filling is dominated if a piece left out could replace a smaller
    piece in it, or two pieces that sum to at most the piece left out, without overfilling. Bit sets of the sums that
    the sizes from each on can reach keep the walk to prefixes that some filling of the wanted sum has. ``count`` must
    be as it was whenever the next filling is asked for.
    """
    reach, within = [1] * (len(sizes) + 1), (1 << (room + 1)) - 1
    for k in range(len(sizes) - 1, -1, -1):
        sums, copies, n = reach[k + 1], min(count[sizes[k]], room // sizes[k]), 1
        while copies:
            n = min(n, copies)
            sums |= sums << (n * sizes[k])
            copies -= n
            n *= 2
        reach[k] = sums & within
    there = sum(1 << s for s in sizes if count[s])
    chosen: list[int] = []

    def undominated(left: int) -> bool:
        out = there
        for s, n in Counter(chosen).items():
            if count[s] <= n:
                out &= ~(1 << s)
        if out & ((2 << left) - 1):
            return False  # a piece would fit beside them
        sums = {a for a in chosen} | {a + b for i, a in enumerate(chosen) for b in chosen[i + 1 :]}
        # A piece left out takes the place of one or two smaller ones.
        return not any((out >> (t + 1)) & ((1 << left) - 1) or ((out >> t) & 1 and t not in chosen) for t in sums)

    def walk(i: int, need: int, waste: int) -> Iterator[tuple[int, ...]]:
        budget[0] -= 1
        if budget[0] < 0:
            return
        if not need:
            if undominated(waste):
                yield tuple(chosen)
            return
        for k in range(i, len(sizes)):
            if not (reach[k] >> need) & 1:
                return
            for n in range(min(count[sizes[k]], need // sizes[k]), 0, -1):
                rest = need - n * sizes[k]
                if (reach[k + 1] >> rest) & 1:
                    chosen.extend([sizes[k]] * n)
                    yield from walk(k + 1, rest, waste)
                    del chosen[-n:]

    for waste in range(min(most_waste, room) + 1):
        if (reach[0] >> (room - waste)) & 1:
            yield from walk(0, room - waste, waste)


def branch(sizes: list[int], capacity: int, bins: int, budget: list[int], rng: random.Random) -> list[list[int]] | None:
    """``sizes`` in at most ``bins`` bins, or None. Each step fills a bin around the largest piece left; the waste that is still allowed prunes.

    Sizes are tried in random order: largest or smallest first would leave only middling pieces to the end, which fit badly.
    """
    count, kinds, done = Counter(sizes), sorted(set(sizes), reverse=True), []
    left, spare = len(sizes), bins * capacity - sum(sizes)
    if spare < 0:
        return None
    steps: list[tuple[int, int, Iterator[tuple[int, ...]]]] = []  # the largest piece, the waste allowed, the ways to fill its bin
    while left and budget[0] >= 0:
        if len(steps) == len(done):
            big = next(s for s in kinds if count[s])
            count[big] -= 1
            room = capacity - big
            fit = [s for s in kinds if count[s] and s <= room]
            steps.append((big, spare, fillings(rng.sample(fit, len(fit)), count, room, min(spare, room), budget)))
        big, spare, ways = steps[-1]
        way = next(ways, None)
        if way is not None:
            count.subtract(way)
            done.append([big, *way])
            left -= 1 + len(way)
            spare -= capacity - big - sum(way)
            continue
        steps.pop()
        count[big] += 1
        if not steps:
            return None
        last = done.pop()  # another way for the bin before
        count.update(last[1:])
        left += len(last)
    return None if left else done


def complete(sizes: list[int], capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Bins of ``sizes``: best fit decreasing is the incumbent, bin completion looks for solutions with one bin less or fewer.

    The search is over all bins. It ends at the lower bound (all tokens over the capacity), when it has proved that
    there is no better solution, or after ``nodes`` steps, which limit the effort spent on improving and not what is
    packed. A solution found may save many bins at once, as each bin is filled with the least waste first.
    """
    best = best_fit(sorted(sizes, reverse=True), capacity)
    bound, budget, rng = -(-sum(sizes) // capacity), [nodes], random.Random(1)
    while len(best) > bound and budget[0] > 0:
        found = branch(sizes, capacity, len(best) - 1, budget, rng)
        if found is None:
            break
        best = found
    return best


def pack_block(sizes: np.ndarray, capacity: int, nodes: int = NODES) -> list[list[int]]:
    """Bins of positions in ``sizes``."""
    where: dict[int, list[int]] = {}
    for i in np.argsort(sizes, kind="stable")[::-1].tolist():
        where.setdefault(int(sizes[i]), []).append(i)
    return [[where[s].pop() for s in b] for b in complete(sizes.tolist(), capacity, nodes)]


def pack(docs: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, text_col: str = "text", id_col: str = "doc_id", nodes: int = NODES) -> DataFrame:
    """Training sequences of at most ``capacity`` tokens (words) that together hold every token of every document once.

    A document of more tokens is cut into full sequences of its own and one remaining piece; every other document is
    one piece. Pieces are packed in blocks of about ``block``, so a sequence count is within a bin a block of what one
    huge search could reach. Result: sequence (id), doc_ids, starts and lengths (of the pieces, in tokens), used.

    Nulls: null and empty texts have no token and are in no sequence. A null id is carried as null. Repeated rows are
    packed each. Equal lengths are told apart by the order of ids and other columns, so a rerun packs alike. An empty
    table gives no sequences. Columns with other names, whatever they are, are left aside.
    """
    id_type = docs.schema[id_col].dataType
    order = first_row_order(docs, id_col, (text_col,))
    # Texts are read once: ids and lengths are kept in the shared folder.
    rows = cut(docs.select(q(id_col).alias("id"), tokens_of(q(text_col)).alias("n"), F.xxhash64(order).alias("o"))).where("n > 0")
    full = rows.where(f"n >= {capacity}").select("id", "o", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"n div {capacity} - 1"))).alias("k"))
    one = F.array(F.lit(capacity).cast("long"))
    whole = full.select(F.concat(F.lit("w"), F.hex("o"), F.lit("-"), F.col("k")).alias("sequence"), F.array("id").alias("doc_ids"), F.array(F.col("k") * capacity).alias("starts"), one.alias("lengths"), F.lit(capacity).cast("long").alias("used"))
    parts = rows.withColumn("size", F.expr(f"n % {capacity}")).where("size > 0")
    blocks = max(1, -(-parts.count() // block))
    schema = T.StructType([T.StructField("sequence", T.StringType()), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("used", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("o", "ascending"), ("n", "ascending")])
        size, n = table.column("size").to_numpy(), table.column("n").to_numpy()
        bins = pack_block(size, capacity, nodes)
        flat = np.fromiter((i for b in bins for i in b), np.int64, len(size))
        off = pa.array(np.concatenate(([0], np.cumsum([len(b) for b in bins]))), pa.int32())
        lists = lambda v: pa.ListArray.from_arrays(off, v)
        ids = table.column("id").combine_chunks().take(pa.array(flat))
        name = f"b{table.column(HIDDEN + 'block')[0].as_py()}-"
        used = np.add.reduceat(size[flat], np.asarray(off)[:-1]).astype(np.int64)
        return pa.Table.from_arrays([pa.array([name + str(i) for i in range(len(bins))]), lists(ids), lists(pa.array((n - size)[flat])), lists(pa.array(size[flat])), pa.array(used)], ["sequence", "doc_ids", "starts", "lengths", "used"])

    packed = parts.withColumn(HIDDEN + "block", F.pmod("o", F.lit(blocks))).groupBy(HIDDEN + "block").applyInArrow(run, schema)
    return whole.unionByName(packed)


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences that hold all documents."""
    return pack(read(spark, sf_dir, "documents"))
