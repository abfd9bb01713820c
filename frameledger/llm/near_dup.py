"""Near-duplicate detection with an LSH forest over MinHash sketches.

Copies with equal shingle sets first collapse to one representative. Every tree of the forest orders the
representatives by its own signature, the plain sequence of LEVELS minimum hashes; an order is one global
range sort, so a run of equal prefixes may lie across many tasks. A row's candidate is its neighbour, which
has the longest common prefix with it. How long that prefix must be adapts to the region: from the base
depth on, a region with more than CROWD members is divided by one hash more until its parts are small, so
crowded regions are only searched among texts that agree on more. Candidates are confirmed on full sets.

Regions of three or more members that still hold several components have pairs that were no neighbours.
Their members are compared by an exact join on the rarest shingles of each set (a prefix filter with length and place
filters), which leaves out no link and needs no pairs of a region. So of pairs that share a region none is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import FILE_ROWS, FILE_TEXTS, Scratch, bound_batches, few, frugal, slices, some, spread_join
from .components import components
from .shingles import minhashes, mixed, shingle_sets

#: Hashes of an order, 16 bits of each; members of a region from which on it is divided further.
LEVELS, CROWD = 12, 32
#: Buckets in which shingles of open regions are counted, to find the rare ones: 2 MB, whatever the input.
BUCKETS = 1 << 18
#: Ids that are broadcast at most to choose texts; with more the texts are shuffled once.
MOST_IDS = 1 << 20


@dataclass(frozen=True)
class Forest:
    """A pair of similarity s meets in some tree with probability 1 - (1 - s^depth)^trees.

    At the threshold itself that is 1 - 8e-7 for 0.85 with depth 5 and 24 trees, and 1 - 1e-7 for
    0.8 with depth 4 and 30 trees.
    """

    width: int = 5
    percent: int = 80
    depth: int = 4
    trees: int = 30


def sketch_batches(batches: Iterator[pa.RecordBatch], forest: Forest) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, ["text"]):
            sets = shingle_sets(batch.column(1).to_pylist(), forest.width)
            hashes = minhashes(sets, forest.depth * forest.trees).astype(np.uint16)
            keys = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
            n = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n, pa.array(keys, pa.binary()), pa.array([h.tobytes() for h in hashes], pa.binary())], names=["doc_id", "n_shingles", "set_key", "sketch"])


def orders(sketches: DataFrame, forest: Forest) -> DataFrame:
    """rep and, for every tree, place: the tree and LEVELS hashes, those of the tree first and then those of the next ones."""
    step = 2 * forest.depth
    around = F.concat("sketch", *["sketch"] * (-(-2 * LEVELS // (step * forest.trees))))
    trees = sketches.select("rep", around.alias("around"), F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree"))
    tree = F.unhex(F.lpad(F.hex(F.col("tree").cast("long")), 4, "0"))
    return trees.select(F.concat(tree, F.substring("around", F.col("tree") * step + 1, F.lit(2 * LEVELS))).alias("place"), "rep")


def run_batches(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """Of one sorted partition, the rows that share a region: region, rep, the neighbour before it, and whether the region may hold more pairs.

    Held for a row of the partition: its id, its region and the length of the prefix that it shares with the row before.
    """
    reps, regions, shared, last = [], [], [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        place = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        before = np.concatenate([~place[:1] if last is None else last, place[:-1]])
        differs = before != place
        first = np.where(differs.any(1), differs.argmax(1), place.shape[1])
        shared.append(((first - 2) // 2).astype(np.int8))
        region = np.zeros(len(place), np.uint64)
        for i in range(0, 2 + 2 * depth, 2):
            region = mixed(region ^ (place[:, i].astype(np.uint64) << np.uint64(8) | place[:, i + 1]) ^ np.uint64(i + 1))
        regions.append(region.view(np.int64))
        reps.append(batch.column(1).to_numpy())
        last = place[-1:].copy()
    if not reps:
        return
    rep, region, common = np.concatenate(reps), np.concatenate(regions), np.concatenate(shared)
    common[0] = -1
    n = len(rep)
    same = common >= depth
    # a region at either end may go on in the next partition
    start = np.flatnonzero(~same)
    size = np.diff(np.append(start, n))
    more = np.repeat(size > 2, size)
    more[: size[0]] = more[n - size[-1] :] = True
    linked, crowded = same.copy(), np.repeat(size > CROWD, size)
    for level in range(depth + 1, LEVELS + 1):
        if not crowded.any():
            break
        linked &= ~crowded | (common >= level)
        size = np.diff(np.append(np.flatnonzero(~linked), n))
        crowded &= np.repeat(size > CROWD, size)
    keep = np.flatnonzero(same | np.append(same[1:], False) | more)
    previous = pa.array(np.concatenate([[0], rep[:-1]])[keep], mask=~linked[keep])
    for at in range(0, len(keep), 1 << 16):
        own = keep[at : at + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(region[own]), pa.array(rep[own]), previous.slice(at, len(own)), pa.array(more[own])], names=["region", "rep", "previous", "more"])


def set_batches(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Full sets of documents."""
    for whole in batches:
        for batch in slices(whole, ["text"]):
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            ends = np.cumsum([0, *map(len, sets)])
            values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], names=["rep", "shingles"])


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("y")), "b")
    n, m, common = F.size("x").cast("long"), F.size("y").cast("long"), F.size(F.array_intersect("x", "y")).cast("long")
    # the sizes alone rule most of the others out; the intersection is only worked out behind them
    fits = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    return both.where(F.when(fits, common * (100 + percent) >= (n + m) * percent).otherwise(False)).select("a", "b").distinct()


def needed(n, percent: int, partner=None):
    """Least intersection of a set of n with one of partner elements, or with any larger one (partner None) at the threshold."""
    return -(-percent * n // 100) if partner is None else -(-percent * (n + partner) // (100 + percent))


def prefix_batches(batches: Iterator[pa.RecordBatch], percent: int, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rarest shingles of each set, as many as a link can't do without: token, rep, root, n, place, and whether smaller sets are found by it."""
    for whole in batches:
        for batch in slices(whole, ["shingles"], 2 << 20):
            rep, root = (batch.column(i).to_numpy() for i in (0, 1))
            length = np.asarray(batch.column(2).value_lengths()).astype(np.int64)
            flat = np.asarray(batch.column(2).flatten()).view(np.uint64)
            owner = np.repeat(np.arange(len(rep)), length)
            order = np.lexsort((flat, counts[(flat >> np.uint64(46)).astype(np.int64)], owner))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
            asks = length - needed(length, percent) + 1
            shows = length - needed(length, percent, length) + 1
            own = place < asks[owner]
            o, p = owner[own], place[own]
            columns = [flat[order][own].view(np.int64), rep[o], root[o], length[o], p, p < shows[o]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "rep", "root", "n", "place", "shows"])


def across(open_sets: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs a, b of different roots that an exact prefix filter leaves. open_sets: rep, root, shingles.

    Two sets at the threshold share one of the rarest shingles of each, in any order that holds for all. The order is by the
    count of a shingle's bucket; a shingle that many texts share is in few prefixes, but those of texts that hold little else.
    """
    bucket = F.shiftrightunsigned("shingle", 46)
    got = open_sets.select(F.explode("shingles").alias("shingle")).groupBy(bucket.alias("bucket")).count().toArrow()  # BUCKETS rows at most
    counts = np.zeros(BUCKETS, np.int64)
    counts[got.column("bucket").to_numpy()] = got.column("count").to_numpy()
    sent = open_sets.sparkSession.sparkContext.broadcast(counts)
    tokens = scratch.write(
        open_sets.select("rep", "root", "shingles").mapInArrow(lambda it: frugal(prefix_batches(it, percent, sent.value)), "token long, rep long, root long, n long, place long, shows boolean"), "tokens", open_sets.count(), FILE_TEXTS
    )
    x, y = tokens.where("shows").alias("x"), tokens.alias("y")

    def c(name: str) -> Column:
        return F.col(name)

    left = F.least(c("x.n") - c("x.place"), c("y.n") - c("y.place"))
    fits = (c("x.token") == c("y.token")) & (c("x.root") != c("y.root")) & ((c("x.n") < c("y.n")) | (c("x.n") == c("y.n")) & (c("x.rep") < c("y.rep")))
    fits &= (c("x.n") * 100 >= c("y.n") * percent) & (left * (100 + percent) >= (c("x.n") + c("y.n")) * percent)
    return x.join(y, fits).select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def near_duplicates(docs: DataFrame, forest: Forest = Forest()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    A document's set holds its distinct shingles of ``width`` words, A-Z lower-cased, words between
    [\\x20\\x09-\\x0D]; with fewer words the whole sequence is one. Documents are linked if their sets'
    intersection is at least ``percent`` hundredths of the union. component_id is the smallest doc_id that
    links reach, the document's own included; kept marks the document that gives it.

    Reads doc_id and text; other columns have no effect. A null text, or one without words, has an empty set
    and is linked with nothing. A row without a doc_id has no component and is kept. Repeated rows
    have one id and so one component; each gives a row. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    bound_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    total = raw.count()
    sketches = scratch.write(raw.mapInArrow(lambda it: frugal(sketch_batches(it, forest)), "doc_id long, n_shingles long, set_key binary, sketch binary"), "sketches", total, FILE_TEXTS)
    sound = sketches.where("doc_id is not null and n_shingles > 0")
    reps = scratch.write(sound.groupBy("set_key").agg(F.min("doc_id").alias("rep")), "reps", total)

    chosen = sound.select(F.col("doc_id").alias("rep"), "sketch").join(reps.select("rep"), "rep", "left_semi")
    sorted_orders = orders(chosen, forest).repartitionByRange(parts, "place", "rep").sortWithinPartitions("place", "rep")
    runs = scratch.write(sorted_orders.mapInArrow(lambda it: frugal(run_batches(it, forest.depth)), "region long, rep long, previous long, more boolean"), "runs", reps.count() * forest.trees, 4 * FILE_ROWS)
    neighbours = runs.where("previous is not null").select(F.least("previous", "rep").alias("a"), F.greatest("previous", "rep").alias("b")).where("a <> b").distinct()

    size = runs.count()
    ids = scratch.write(runs.select("rep").distinct(), "ids", size)
    asked = ids.select(F.col("rep").alias("doc_id"))
    sets = scratch.write(raw.where("doc_id is not null").join(some(asked, MOST_IDS), "doc_id", "left_semi").mapInArrow(lambda it: frugal(set_batches(it, forest.width)), "rep long, shingles array<long>"), "sets", ids.count(), FILE_TEXTS)
    near = scratch.write(confirmed(neighbours, sets, forest.percent), "near", size)
    roots = components(near, scratch, "first")

    members = runs.where("more").select("region", "rep").distinct().join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("region", "rep", F.coalesce("root", "rep").alias("root"))
    members = scratch.write(members, "members", size)
    mixed_regions = members.groupBy("region").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("region")
    mixed_regions = scratch.write(mixed_regions, "mixed", size)
    found = members.join(F.broadcast(mixed_regions), "region", "left_semi") if mixed_regions.count() <= MOST_IDS else spread_join(members, mixed_regions, "region", "left_semi")
    opened = found.select("rep", "root").distinct()
    open_sets = scratch.write(opened.join(sets, "rep").select("rep", "root", "shingles"), "open", size, FILE_TEXTS)
    if open_sets.limit(1).count():
        further = scratch.write(confirmed(across(open_sets, forest.percent, scratch), sets, forest.percent), "further")
        if further.limit(1).count():
            roots = components(near.unionAll(further), scratch, "second")
    scratch.drop("runs", "ids", "sets", "members", "mixed", "open", "tokens")

    named = sound.select("doc_id", "n_shingles", "set_key")
    places = reps.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("set_key", F.coalesce("root", "rep").alias("component_id"))
    full = spread_join(named, places, "set_key", "inner").select("doc_id", "n_shingles", "component_id")
    rest = sketches.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return few(full.unionAll(rest), total).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def missed(forest: Forest, similarity: float) -> float:
    """Probability that a pair of that similarity meets in no tree."""
    return math.pow(1 - similarity**forest.depth, forest.trees)


#: DuckDB, for the columns of the query (width 3, 85 hundredths): every pair that shares a shingle, and the closure of the links.
ORACLE = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select distinct doc_id, array_to_string(ws[i : i + 2], ' ') as shingle from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) as i from w where len(ws) > 0) q),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l),
r(doc_id, reached) as (select doc_id, doc_id from n union select r.doc_id, e.b from r join e on e.a = r.reached)
select w.doc_id, coalesce(any_value(n.n), 0) as n_shingles, coalesce(min(r.reached), w.doc_id) as component_id, coalesce(min(r.reached), w.doc_id) = w.doc_id as kept
from w left join n using (doc_id) left join r using (doc_id) group by w.doc_id
"""
