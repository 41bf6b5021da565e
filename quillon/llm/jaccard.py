"""Exact n-gram Jaccard join of whole texts, with set-relation skipping; its links' components.

Sets are word-shingle hashes. The join works on documents' distinct sets and never forms the pairs inside a group:

1. Documents that can link with none go first. With shingles in one global (hash) order, two sets that link share at
   least l of their first n - ceil(T n) + l shingles (l = n // SHARE). A partition counts the shingles that repeat
   inside it and sends each of its shingles once, so a shingle that a third of all documents have is a row a partition.
2. The sets of those left are built (documents with equal sets are one), and their shingles' document frequencies
   counted exactly, in ranges of (shingle, set). Each set enters its rarest n - ceil(T n) + 1 shingles of the order by
   (frequency, hash) into the index lists; those that only it has are left out, as no list would hold another set.
3. Answers are derived from those of similar sets: a list's first set is the one with the fewest shingles that no other
   set has, the likeliest to link; one set of each other component of the list is checked against it, one pair a component
   and round. What links joins that component and takes over its answers, so sets in one component are never compared
   again. The rounds end when they link nothing new, or after ROUNDS.
4. The pairs across components that are left in the lists are checked one by one. Lists are cut in blocks of sizes, and a set
   meets only its own block and the next, so blocks that can't reach the threshold are skipped; within them a pair is
   skipped if the shingles after the two positions don't suffice, or if the shingles that only one set has are too many:
   they are all in the pair's difference. In a large group of near copies the first kind of set has linked by then and the
   second is skipped.

5. If asked for, every set's number of links comes from its difference to the centre of its component (see _link_counts), also
   for the pairs inside a component that the steps before have skipped.

Every check is exact, on the whole sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from quillon.llm.common import claim, cut, mix, pieces_of, small_batches, table, window_hashes, word_hashes

WORDS = 5
#: Links: 100 * |both| >= PERCENT * |either|.
PERCENT = 75
SHARE = 8
#: Entries that a partition counts at once.
CHUNK = 3_000_000
ROUNDS = 3
#: A list with more than this share of all entries is dealt in SALTS parts.
HOT = 1000
SALTS = 64
#: Bits of the filter that spares most documents without links a second look; its size is fixed.
FILTER_BITS = 27
RUN_BYTES = 4 << 20
#: Stands for a null doc_id, which is the smallest.
NULL_ID = -(1 << 63)


def need(n: int | np.ndarray) -> int | np.ndarray:
    """Least overlap that a set of n shingles has with any set it links with."""
    return -(-PERCENT * n // 100)


def shingles(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text, in A-Z lower-cased words; fewer words are one sequence; none: empty."""
    flat, lengths = word_hashes(texts, True)
    windows, out, at = window_hashes(flat, words, 21), [], 0
    for n in lengths.tolist():
        if n >= words:
            out.append(np.unique(windows[at : at + n - words + 1]))
        else:
            out.append(window_hashes(flat[at : at + n], n, 100 + n) if n else np.zeros(0, np.uint64))
        at += n
    return out


def digest(s: np.ndarray) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0
    return ((value >> 64) - (1 << 63)), ((value & ((1 << 64) - 1)) - (1 << 63))


def _ids(part: pa.RecordBatch) -> np.ndarray:
    return part.column("doc_id").cast(pa.int64()).fill_null(NULL_ID).to_numpy(zero_copy_only=False)


ENTRY = "h long, doc long, sure boolean, n int, d2 long, count int, mark long"


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, doc, sure): first shingles; sure: it repeats here. And a row with n, digest (h, d2), count and the text's mark for each document."""
    names = [c.split()[0] for c in ENTRY.split(", ")]
    claim("entries")
    sets: list[tuple[int, np.ndarray, int]] = []
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal sets, size
        firsts = []
        for _, s, _ in sets:
            n = len(s)
            firsts.append(s[: n - need(n) + max(1, n // SHARE)] if n else s)
        flat = np.concatenate(firsts)
        owner = np.repeat(np.arange(len(sets)), list(map(len, firsts)))
        order = np.argsort(flat, kind="stable")
        flat, owner = flat[order], owner[order]
        new = np.concatenate([[True], flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        length = np.diff(np.append(start, len(flat)))
        counts = np.bincount(owner, np.repeat(length > 1, length), len(sets)).astype(np.int32)
        ids = np.array([i for i, _, _ in sets], np.int64)
        m = len(start)
        yield pa.RecordBatch.from_arrays(
            [pa.array(flat[start].view(np.int64)), pa.array(ids[owner[start]]), pa.array(length > 1), pa.array(np.zeros(m, np.int32), mask=np.ones(m, bool)), pa.array(np.zeros(m, np.int64)), pa.array(np.zeros(m, np.int32)), pa.array(np.zeros(m, np.int64))],
            names,
        )
        marks = [digest(s) for _, s, _ in sets]
        k = len(sets)
        yield pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in marks], pa.int64()), pa.array(ids), pa.array(np.zeros(k, bool)), pa.array([len(s) for _, s, _ in sets], pa.int32()), pa.array([b for _, b in marks], pa.int64()), pa.array(counts), pa.array([x for _, _, x in sets], pa.int64())],
            names,
        )
        sets, size = [], 0

    for batch in batches:
        for part in pieces_of(batch, RUN_BYTES):
            for i, s, x in zip(_ids(part).tolist(), shingles(part.column("text")), part.column("mark").to_pylist()):
                sets.append((i, s, x))
                size += len(s)
            if size >= CHUNK:
                yield from flush()
    if sets:
        yield from flush()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by h: a document's (doc, n, d1, d2, count, mark), and a row of count 1 for each of its shingles that other partitions have."""
    names = ["doc", "n", "d1", "d2", "count", "mark"]
    carry: tuple[np.ndarray, ...] | None = None

    def counted(h: np.ndarray, doc: np.ndarray, sure: np.ndarray) -> np.ndarray:
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        length = np.diff(np.append(start, len(h)))
        repeats = np.repeat((length > 1) | np.maximum.reduceat(sure, start), length)
        return doc[repeats & ~sure]  # the documents of a sure row were counted where it came from

    def rows(doc: np.ndarray) -> pa.RecordBatch:
        zero, k = pa.array(np.zeros(len(doc), np.int64)), len(doc)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.nulls(k, pa.int32()), zero, zero, pa.array(np.ones(k, np.int32)), zero], names)

    for batch in batches:
        n = batch.column("n")
        stats = n.is_valid()
        if pc.any(stats).as_py():
            own = batch.filter(stats)
            yield pa.RecordBatch.from_arrays([own.column(c) for c in ("doc", "n", "h", "d2", "count", "mark")], names)
            batch = batch.filter(n.is_null())
        if not batch.num_rows:
            continue
        h, doc, sure = np.asarray(batch.column("h")), np.asarray(batch.column("doc")), batch.column("sure").to_numpy(zero_copy_only=False)
        if carry is not None:
            h, doc, sure = (np.concatenate(x) for x in zip(carry, (h, doc, sure)))
        last = int(np.searchsorted(h, h[-1], "left"))
        carry = h[last:], doc[last:], sure[last:]
        if len(carry[0]) > 2:
            # of a long run only whether it repeats matters for what follows
            yield rows(counted(*carry))
            carry = carry[0][:1], carry[1][:1], np.array([True])
        if last:
            yield rows(counted(h[:last], doc[:last], sure[:last]))
    if carry is not None:
        yield rows(counted(*carry))


def _mark():
    """Tells the texts of one doc_id apart."""
    return F.xxhash64("text")


def _filter_cell(doc):
    return F.pmod(F.xxhash64(doc), F.lit(1 << FILTER_BITS))


def _flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = np.asarray(batch.column("n")).astype(np.int64)
        tokens = np.frombuffer(b"".join(batch.column("tokens").to_pylist()), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(tokens), pa.array(np.repeat(np.asarray(batch.column("set")), n))], ["h", "set"])


FREQUENT = "set long, h long, count long, part int, kind int"


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (h, set) sorted: the entries whose shingle two sets or more have, with its frequency (kind 0).

    The first and last run may go on in other ranges: their entries come with kind 1, their lengths here with kind 2.
    """
    part = TaskContext.get().partitionId()
    names = [c.split()[0] for c in FREQUENT.split(", ")]
    carry, first = None, None
    edges: dict[int, int] = {}

    def rows(h: np.ndarray, owner: np.ndarray, count: np.ndarray, kind: int) -> pa.RecordBatch:
        k = len(h)
        return pa.RecordBatch.from_arrays([pa.array(owner.astype(np.int64)), pa.array(h.astype(np.int64)), pa.array(count.astype(np.int64)), pa.array(np.full(k, part, np.int32)), pa.array(np.full(k, kind, np.int32))], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        h, owner = np.asarray(batch.column("h")), np.asarray(batch.column("set"))
        if first is None:
            first = int(h[0])
        # rows of the range's first run leave at once, so a run of any length passes in bounded memory
        if h[0] == first:
            n = int(np.searchsorted(h, first, "right"))
            yield rows(h[:n], owner[:n], np.zeros(n), 1)
            edges[first] = edges.get(first, 0) + n
            h, owner = h[n:], owner[n:]
            if not len(h):
                continue
        if carry is not None:
            h, owner = np.concatenate([carry[0], h]), np.concatenate([carry[1], owner])
        last = int(np.searchsorted(h, h[-1], "left"))
        if last:
            start = np.flatnonzero(np.concatenate([[True], h[1:last] != h[: last - 1]]))
            length = np.diff(np.append(start, last))
            count = np.repeat(length, length)
            keep = np.flatnonzero(count > 1)
            yield rows(h[keep], owner[keep], count[keep], 0)
        carry = h[last:], owner[last:]
    if carry is not None:
        yield rows(*carry, np.zeros(len(carry[0])), 1)
        edges[int(carry[0][0])] = len(carry[0])
    if edges:
        yield rows(np.array(list(edges)), np.zeros(len(edges)), np.array(list(edges.values())), 2)


def _index(shared: DataFrame) -> DataFrame:
    """From (set, n, h, count) the index entries (h, set, n, place, own); own: shingles that no other set has, which come before."""
    all_, order = Window.partitionBy("set"), Window.partitionBy("set").orderBy("count", "h")
    rows = shared.withColumn("rank", F.row_number().over(order)).withColumn("shared", F.count(F.lit(1)).over(all_).cast("int"))
    least = F.floor((F.col("n") * PERCENT + 99) / 100)
    own = F.col("n") - F.col("shared")
    return rows.where(F.col("rank") <= F.col("shared") - least + 1).select("h", "set", "n", (own + F.col("rank") - 1).cast("int").alias("place"), own.cast("int").alias("own"))


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, before, b = [], None, None
        for i, (x, y, p) in enumerate(zip(batch.column("tokens_a").to_pylist(), batch.column("tokens_b").to_pylist(), batch.column("b").to_pylist())):
            if p != before:
                before, b = p, np.frombuffer(y, np.uint64)
            a = np.frombuffer(x, np.uint64)
            at = np.minimum(np.searchsorted(b, a), len(b) - 1)
            both = int((b[at] == a).sum())
            found.append(100 * both >= PERCENT * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(found, pa.bool_()))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that link."""
    left = sets.select(F.col("set").alias("a"), F.col("tokens").alias("tokens_a"))
    right = sets.select(F.col("set").alias("b"), F.col("tokens").alias("tokens_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "tokens_a", "tokens_b").mapInArrow(_linked, "a long, b long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (its smallest node) of the nodes of edges (a, b), by alternating large and small stars.

    Every step is a grouped minimum and a join on nodes; the edge set is written after each round, until it stays equal.
    """
    mark = F.struct(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40)))
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = now.agg(mark.alias("m")).first()["m"]
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct().select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        after = cut(small, name)
        marked = after.agg(mark.alias("m")).first()["m"]
        if marked == state:
            break
        now, state = after, marked
    stars = after.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _salted(lists: DataFrame) -> DataFrame:
    """lists with salt: lists that hold more than a HOT-th of all entries (HOT at most) are dealt in SALTS parts by set."""
    sizes = lists.groupBy("h").count()
    hot = F.broadcast(sizes.where(F.col("count") * HOT > (sizes.agg(F.sum("count")).first()[0] or 0)).select("h", F.lit(True).alias("hot")))
    return lists.join(hot, "h", "left").withColumn("salt", F.when(F.col("hot"), F.pmod("set", F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("hot")


def _round(lists: DataFrame, of: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """lists with comp, less those lists that are all one component; and one pair (a, b) for each component but its lists' first."""
    if of is None:
        rows = lists.withColumn("comp", F.col("set"))
    else:
        rows = lists.join(of, lists["set"] == of["node"], "left").withColumn("comp", F.coalesce("component", "set")).drop("node", "component")
    several = rows.groupBy("h").agg(F.min(F.struct("own", "set", "comp")).alias("first"), F.min("comp").alias("least"), F.max("comp").alias("most"), F.max("salt").alias("salts")).where("least <> most")
    several = several.select("h", "first", F.explode(F.sequence(F.lit(0), F.when(F.col("salts") > 0, F.lit(SALTS - 1)).otherwise(F.lit(0)))).alias("salt"))
    rows = rows.join(several, ["h", "salt"])
    stars = rows.where("comp <> first.comp").groupBy("comp", F.col("first.comp").alias("to"), F.col("set").alias("a"), F.col("own").alias("own"), F.col("first.set").alias("b")).count()
    pairs = stars.groupBy("comp").agg(F.max(F.struct("count", F.negative("own").alias("no"), F.negative("b").alias("nb"), F.negative("a").alias("na"))).alias("best"))
    return rows.select("h", "set", "n", "place", "own", "comp"), pairs.select((-F.col("best.na")).alias("a"), (-F.col("best.nb")).alias("b"))


def _across(rows: DataFrame) -> DataFrame:
    """All pairs of sets in one list but not in one component whose sizes and positions allow a link."""
    block = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100.0 / PERCENT)))
    left = rows.select("h", F.explode(F.array(block, block + 1)).alias("block"), F.col("set").alias("a"), F.col("n").alias("na"), F.col("place").alias("pa"), F.col("own").alias("oa"), F.col("comp").alias("ca"))
    right = rows.select("h", block.alias("block"), F.col("set").alias("b"), F.col("n").alias("nb"), F.col("place").alias("pb"), F.col("own").alias("ob"), F.col("comp").alias("cb"))
    both = f"ceil({PERCENT} * (na + nb) / {100.0 + PERCENT} - 1e-9)"  # the overlap that a link needs
    over = F.expr(f"1 + least(na - pa, nb - pb) >= {both} AND na + nb - oa - ob >= 2 * {both}")
    smaller = F.expr("na < nb OR na = nb AND a < b")
    return left.join(right, ["h", "block"]).where(smaller & F.expr(f"100 * na >= {PERCENT} * nb AND ca <> cb") & over).select("a", "b").distinct()


def _joined(texts: DataFrame, counts: bool = False) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Of texts (doc_id, text): stats (doc, mark of the text, n, d1, d2) of every row; links (a, b) that connect all sets that links connect;
    if counts, (set, n_links) of the sets that have links.

    A set is its digest: d1 names it in lists and links, so rows that share a doc_id keep a set each.
    """
    small_batches(texts.sparkSession)
    entries = texts.withColumn("mark", _mark()).mapInArrow(_entries, ENTRY).repartition("h").sortWithinPartitions("h")
    counted = cut(entries.mapInArrow(_counted, "doc long, n int, d1 long, d2 long, count int, mark long"), "jaccard")
    stats = counted.where("n IS NOT NULL").select("doc", "mark", "n", "d1", "d2")
    n_max = F.min(F.when(F.col("n") > 0, F.col("n")))
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * PERCENT / 100) / SHARE))
    maybe = counted.groupBy("doc").agg(n_max.alias("n"), F.sum("count").alias("count")).where(F.col("count") >= least).select("doc")
    # equal sets are one: the smallest document stands for them
    same = stats.where("n > 0").groupBy("d1", "d2", "n").agg(F.min("doc").alias("doc"))
    standing = cut(maybe.join(same.select("d1", "d2", "doc"), "doc").select("doc", "d1", "d2"), "jaccard")
    bits = standing.select((_filter_cell("doc") + 1).alias("cell")).groupBy(F.bitmap_bucket_number("cell").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("bits"))
    built = _built(texts, bits)
    sets = cut(built.join(standing, ["doc", "d1", "d2"], "left_semi").dropDuplicates(["d1", "d2"]).select(F.col("d1").alias("set"), "n", "tokens"), "jaccard")
    spread = sets.mapInArrow(_flat, "h long, set long").repartitionByRange("h", "set").sortWithinPartitions("h", "set")
    frequent = cut(spread.mapInArrow(_frequencies, FREQUENT), "jaccard")
    edges = frequent.where("kind = 2").groupBy("h").agg(F.sum("count").alias("total")).where("total > 1")
    # edges: two a range at most, so every entry of a shingle that fills whole ranges stays where it is
    at_edge = frequent.where("kind = 1").select("set", "h").join(F.broadcast(edges), "h").select("set", "h", F.col("total").alias("count"))
    shared = frequent.where("kind = 0").select("set", "h", "count").unionByName(at_edge)
    lists = cut(_salted(cut(_index(shared.join(sets.select("set", "n"), "set")), "jaccard")), "jaccard")
    # only sets in a list are compared
    sets = cut(sets.join(lists.select("set").distinct(), "set", "left_semi"), "jaccard")
    links, of, rows = None, None, None
    for _ in range(ROUNDS):
        rows, pairs = _round(lists, of)
        found = cut(verified(pairs, sets), "jaccard")
        links = found if links is None else links.unionByName(found)
        if found.isEmpty():
            break
        of = cut(components(links), "jaccard")
    rows, _ = _round(lists, of)
    rest = cut(verified(_across(rows), sets), "jaccard")
    return stats, links.unionByName(rest), _link_counts(of, links, rest, sets) if counts else None


def _classes(stats: DataFrame, links: DataFrame) -> DataFrame:
    """set, class (sets that links connect have one class) and low, the smallest document of the class, of all sets."""
    of = components(links)
    same = stats.where("n > 0").groupBy(F.col("d1").alias("set")).agg(F.min("doc").alias("doc"))
    rows = cut(same.join(of, same["set"] == of["node"], "left").select("set", F.coalesce("component", "set").alias("class"), "doc"), "jaccard")
    return rows.select("set", "class").join(rows.groupBy("class").agg(F.min("doc").alias("low")), "class")


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, centre, f, k, size, tokens): the shingles that only one of a set and its centre has, and what they weigh."""
    for batch in batches:
        f, k, size, out, before, centre = [], [], [], [], None, None
        for x, y, p in zip(batch.column("tokens_a").to_pylist(), batch.column("tokens_b").to_pylist(), batch.column("b").to_pylist()):
            if p != before:
                before, centre = p, np.frombuffer(y, np.uint64)
            a = np.frombuffer(x, np.uint64)
            more, less = np.setdiff1d(a, centre, True), np.setdiff1d(centre, a, True)
            f.append(100 * len(less) + PERCENT * len(more))
            k.append((100 - PERCENT) * len(centre))
            size.append(len(less) + len(more))
            out.append(np.concatenate([less, more]).tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(f, pa.int64()), pa.array(k, pa.int64()), pa.array(size, pa.int32()), pa.array(out, pa.binary())], ["set", "centre", "f", "k", "n", "tokens"])


def _link_counts(of: DataFrame | None, links: DataFrame, rest: DataFrame, sets: DataFrame) -> DataFrame:
    """(set, n_links) of all sets that link with another.

    Inside a component all pairs count, without forming most of them. With d shingles of the component's centre S missing in a set,
    e more than S has and f = 100 d + PERCENT e, two sets link if and only if f_a + f_b <= k + (100 + PERCENT) x: k is
    (100 - PERCENT) |S| and x the number of shingles that both differences from S have. Pairs with f_a + f_b <= k are counted from
    the numbers of sets by f; for the others, x must make up for the excess, so they meet in lists of the differences' shingles
    (each set in those that any x that it needs must touch) and are checked one by one. Across components `rest` has the links.
    """
    ends = rest.select(F.col("a").alias("set")).unionByName(rest.select(F.col("b").alias("set"))).groupBy("set").agg(F.count(F.lit(1)).alias("n_links"))
    if of is None:
        return ends
    centres = links.groupBy(F.col("b").alias("node")).count().join(of, "node").groupBy("component").agg(F.max(F.struct("count", "node")).alias("best"))
    pairs = of.join(centres, "component").select(F.col("node").alias("a"), F.col("best.node").alias("b"))
    left = sets.select(F.col("set").alias("a"), F.col("tokens").alias("tokens_a"))
    right = sets.select(F.col("set").alias("b"), F.col("tokens").alias("tokens_b"))
    apart = pairs.join(left, "a").join(right, "b").select("a", "b", "tokens_a", "tokens_b")
    apart = cut(apart.mapInArrow(_differences, "set long, centre long, f long, k long, n int, tokens binary"), "jaccard")
    by_f = apart.groupBy("centre", "k", "f").count()
    asked = by_f.select("centre", F.col("f").alias("at"), "count").unionByName(by_f.select("centre", (F.col("k") - F.col("f")).alias("at"), F.lit(0).cast("long").alias("count")))
    upto = Window.partitionBy("centre").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    reach = cut(asked.groupBy("centre", "at").agg(F.sum("count").alias("count")).withColumn("n_links", F.sum("count").over(upto)), "jaccard").select("centre", "at", "n_links")
    near = apart.select("set", "centre", "k", "f", (F.col("k") - F.col("f")).alias("at")).join(reach, ["centre", "at"])
    near = near.select("set", (F.col("n_links") - F.expr("int(2 * f <= k)")).alias("n_links"))  # less itself
    most = by_f.groupBy("centre").agg(F.max("f").alias("most"))
    far = cut(apart.join(most, "centre").where("f + most > k").drop("most"), "jaccard")
    spread = far.mapInArrow(_flat, "h long, set long").join(far.select("set", "centre", "f", "k"), "set")
    several = spread.groupBy("centre", "h").count().where("count > 1")
    shared = spread.join(several, ["centre", "h"])
    rows = shared.withColumn("rank", F.row_number().over(Window.partitionBy("set").orderBy("count", "h"))).withColumn("after", F.count(F.lit(1)).over(Window.partitionBy("set")) - F.col("rank") + 1)
    rows = cut(rows.where("after >= greatest(1, ceil((f - k) / 100))").select("centre", "h", "set", "f", "k", "after"), "jaccard")
    one, two = (rows.select("centre", "h", *(["k"] if c == "a" else []), F.col("set").alias(c), F.col("f").alias(f"f{c}"), F.col("after").alias(f"after_{c}")) for c in "ab")
    meet = one.join(two, ["centre", "h"]).where(F.expr(f"a < b AND fa + fb > k AND {100 + PERCENT} * least(after_a, after_b) >= fa + fb - k"))
    more = cut(verified(meet.select("a", "b").distinct(), sets), "jaccard")
    more = more.select(F.col("a").alias("set")).unionByName(more.select(F.col("b").alias("set"))).groupBy("set").agg(F.count(F.lit(1)).alias("n_links"))
    return near.unionByName(more).unionByName(ends).repartition("set").groupBy("set").agg(F.sum("n_links").alias("n_links"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every row of docs (doc_id, text; others unused).

    Null and empty texts have no shingles and link with nothing, so their component is their own doc_id. Rows with one doc_id
    are one node that has the links of each. A null doc_id is the smallest and names its component. An empty table gives
    an empty result. Texts with equal sets link, whatever they look like.
    """
    stats, links, _ = _joined(docs.select("doc_id", "text"))
    return _named(stats, _classes(stats, links)).select("doc_id", "n_shingles", "component_id")


def jaccard_links(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id as jaccard_components, and n_links: the other sets that the row's set links with, all of them verified.

    Rows with equal sets are one set, so copies add nothing to n_links; they show in n_shingles and component_id.
    """
    stats, links, counts = _joined(docs.select("doc_id", "text"), True)
    classes = _classes(stats, links).join(counts, "set", "left")
    return _named(stats, classes).withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long"))


def _with_classes(stats: DataFrame, classes: DataFrame) -> DataFrame:
    """stats with the columns of classes (d1, others); those of sets that more than a HOT-th of all rows have (HOT at most) are broadcast."""
    classes, total = cut(classes, "jaccard"), stats.count()
    hot = stats.where("n > 0").groupBy("d1").count().where(F.col("count") * HOT > total).select("d1")
    large = F.broadcast(cut(classes.join(F.broadcast(hot), "d1", "left_semi"), "jaccard"))
    some = stats.where("n > 0")
    none = stats.where("n = 0").select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in classes.schema.fields if f.name != "d1"])
    return some.join(large, "d1").unionByName(some.join(large.select("d1"), "d1", "left_anti").join(classes, "d1", "left")).unionByName(none)


def _named(stats: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of stats, and what else classes has of its set."""
    found = _with_classes(stats, classes.drop("class").withColumnRenamed("set", "d1")).withColumn("low", F.coalesce("low", "doc"))
    found = cut(found, "jaccard")
    # documents with rows in several classes connect these
    several = found.groupBy("doc").agg(F.min("low").alias("least"), F.max("low").alias("most")).where("least <> most").select("doc")
    bridges = cut(found.join(several, "doc").select(F.col("doc").alias("a"), F.col("low").alias("b")).distinct(), "jaccard")
    if not bridges.isEmpty():
        # a document's number may be that of a class of which it is the smallest: it is then in that class
        of = components(bridges)
        found = found.join(of, found["low"] == of["node"], "left").withColumn("low", F.coalesce("component", "low")).drop("node", "component")
    real = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    return found.select(real("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), real("low").alias("component_id"), *(c for c in found.columns if c not in ("doc", "mark", "n", "d1", "d2", "low")))


def _built(texts: DataFrame, bits: DataFrame) -> DataFrame:
    """The sets of documents that may be among those of the filter: it spares work, the exact join comes after."""
    held = [(r.bucket, bytes(r.bits)) for r in bits.toLocalIterator()]  # FILTER_BITS / 8 bytes at most
    shared = texts.sparkSession.sparkContext.broadcast([(b, zlib.compress(x, 1)) for b, x in held])
    rows = texts.withColumn("cell", _filter_cell(F.coalesce("doc_id", F.lit(NULL_ID))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("sets")
        filled = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        for bucket, packed in shared.value:
            x = np.frombuffer(zlib.decompress(packed), np.uint8)
            filled[(bucket - 1) * len(x) : bucket * len(x)] = x
        for batch in batches:
            cell = np.asarray(batch.column("cell"))
            keep = (filled[cell >> 3] >> (cell & 7).astype(np.uint8) & 1) > 0
            for part in pieces_of(batch.filter(pa.array(keep)), RUN_BYTES):
                found = shingles(part.column("text"))
                marks = [digest(s) for s in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_ids(part)), pa.array([a for a, _ in marks], pa.int64()), pa.array([b for _, b in marks], pa.int64()), pa.array(list(map(len, found)), pa.int32()), pa.array([s.tobytes() for s in found], pa.binary())],
                    ["doc", "d1", "d2", "n", "tokens"],
                )

    return rows.mapInArrow(run, "doc long, d1 long, d2 long, n int, tokens binary")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, but one text of each group that links connect: that of the smallest doc_id (null first).

    Texts count, not doc_ids: different texts under one doc_id, or without one, go only if links connect them with a text that stays.
    Of one doc_id's texts in a group one stays; so does one of rows with equal doc_id and text. Texts without shingles all stay
    (null and empty ones). Of equal rows one stays, of rows that differ only in other columns the one with the least hash. Columns may have any names. An empty table gives
    an empty result.
    """
    columns = docs.columns
    held = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    doc, text = (F.col(f"c{columns.index(c)}") for c in ("doc_id", "text"))
    tie = F.xxhash64(*[F.to_json(F.struct(f"c{i}")) if "map<" in t else F.col(f"c{i}") for i, (_, t) in enumerate(held.dtypes)])
    stats, links, _ = _joined(docs.select("doc_id", "text"))
    rows = _with_classes(stats, _classes(stats, links).select(F.col("set").alias("d1"), "class")).select("doc", "mark", "class")
    rows = cut(rows, "jaccard")
    first = rows.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("doc", "mark")).alias("first")).select("first.doc", "first.mark")
    stay = first.unionByName(rows.where("class IS NULL").select("doc", "mark")).distinct().select(F.col("doc").alias("__doc"), F.col("mark").alias("__mark"))
    kept = held.withColumns({"__doc": F.coalesce(doc.cast("long"), F.lit(NULL_ID)), "__mark": F.xxhash64(text), "__tie": tie}).join(stay, ["__doc", "__mark"], "left_semi")
    one = Window.partitionBy("__doc", "__mark").orderBy(text, "__tie")
    return kept.withColumn("__row", F.row_number().over(one)).where("__row = 1").drop("__doc", "__mark", "__tie", "__row").toDF(*columns)


def op4_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(table(spark, sf_dir, "documents"))
