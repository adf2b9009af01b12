"""MinHash near-duplicate groups: one-permutation hashing, optimal densification, bands, star-shaped candidates.

1. Every document's distinct word shingles are hashed once; each of `bins` equal ranges of the hash keeps its
   smallest value, and an empty bin copies a non-empty one that a fixed sequence of random bins reaches first
   (optimal densification). Bands of consecutive bins are hashed to bucket keys. Documents of equal sets are one
   class (two 64-bit sums over the set), represented by the smallest doc_id: thousands of copies cost one row.
2. Within a bucket only star edges are candidates: each member against the bucket's most central member (the one
   whose buckets have the most members in sum, so the original of a family of near copies rather than any copy).
   Candidates are linear in the members.
3. Each candidate is confirmed on both full sets. A centre's set goes to its members in salted groups of at most
   SALT rows, however many it has.
4. Components of the confirmed links. What stars can miss is a pair (x, y) of one bucket whose member y failed
   against the centre c. Let D(m) be the symmetric difference of the sets of m and c. As y failed, a link of x and
   y needs more than (|D(x)| + f (|c| - |x|)) / 2 differences in common, f = (1 - t) / (1 + t) for threshold t: about
   half of D(x). So x meets y at one of its rarest differences, of which just so many are looked up that one must
   be common (a prefix filter). Those pairs are confirmed too, and components taken once more: no pair that shares a
   bucket is lost, and none is compared but for a reason.

Bands have 6 bins for thresholds of 85 and more, else 5, and there are as many as make the chance that a pair at
the threshold shares no bucket less than one in a million.

A class goes by its smallest doc_id and a sum of its set (`node`), so classes that share a doc_id stay apart, and the
smallest node of a component holds the smallest doc_id.

Defined results: null, empty and blank texts have no set, are linked with nothing and kept; rows with a null doc_id
likewise, with a null component_id; rows that repeat a doc_id are each returned, by their own text's class, and all of
one class and doc_id alike. Other columns are ignored. `one_of_each` leaves one row of each component: of rows that
repeat a doc_id and a set any one, of different texts under the component's doc_id those of the smallest node.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vedette.llm.common import prepare, slices, table
from vedette.llm.components import components
from vedette.llm.textkit import Words, mix, sorted_sets
from vedette.session import scratch, written

#: Members that one task confirms against a centre at a time.
SALT = 200
#: Bits of the filter that spares the shuffle all documents without candidates.
FILTER_BITS = 24
U = np.uint64
NODE = "struct<id: bigint, k1: bigint>"


def bands_for(percent: int) -> tuple[int, int]:
    """(bands, bins in each) for a similarity threshold in percent."""
    rows = 6 if percent >= 85 else 5
    return math.ceil(math.log(1e-6) / math.log(1 - (percent / 100) ** rows)), rows


def densified(h: np.ndarray, doc: np.ndarray, n_docs: int, bins: int) -> np.ndarray:
    """[n_docs, bins] minima of sorted distinct hashes, empty bins filled; rows without hashes stay at the largest value."""
    high, low = h >> U(32), h & U(0xFFFFFFFF)
    at = ((high * U(bins)) >> U(32)).astype(np.int64)  # equal ranges of the high half
    none = U(2**64 - 1)
    out = np.full((n_docs, bins), none, np.uint64)
    cell = doc * bins + at
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    out.reshape(-1)[cell[first]] = (high[first] << U(32)) | low[first]
    empty = out == none
    full = ~empty.all(axis=1)
    open_rows, open_bins = np.nonzero(empty & full[:, None])
    have = ~empty
    attempt = 0
    while len(open_rows):
        attempt += 1
        probe = (mix(open_bins.astype(np.uint64) * U(1_000_003) + U(attempt) * U(0x9E3779B9)) % U(bins)).astype(np.int64)
        good = have[open_rows, probe]
        if attempt > 40 * bins:  # a row whose probes never meet its few bins: its first bin
            probe, good = have[open_rows].argmax(axis=1), np.ones(len(probe), bool)
        out[open_rows[good], open_bins[good]] = out[open_rows[good], probe[good]]
        open_rows, open_bins = open_rows[~good], open_bins[~good]
    return out


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, the set's two sums k1 and k2, and its bucket keys (null without shingles)."""
    n_bands, rows = bands_for(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column(1))
            h, doc, size = sorted_sets(*words.shingles(k), words.n_docs)
            signature = densified(h, doc, words.n_docs, n_bands * rows)
            keys = np.zeros((words.n_docs, n_bands), np.uint64)
            for j in range(rows):
                keys = mix(keys * U(5) + signature[:, j::rows] + U(j + 1))
            keys = mix(keys + np.arange(1, n_bands + 1, dtype=np.uint64))
            k1, k2 = _sums(h, size)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, words.n_docs * n_bands + 1, n_bands, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size.astype(np.int64)), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), lists],
                ["doc_id", "n_shingles", "k1", "k2", "keys"],
            )

    rows_ = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows_.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, keys array<long>")


def bitmap_words(ids: DataFrame, column: str) -> DataFrame:
    """(_w, _b): the 32-bit words, as whole numbers, of a bitmap of 2**FILTER_BITS bits, those set that an id hashes to."""
    bits = ids.select(F.pmod(F.xxhash64(column), F.lit(1 << FILTER_BITS)).alias("bit"))
    return bits.groupBy(F.expr("shiftright(bit, 5)").alias("_w")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 32 as int)))").alias("_b"))


def bitmap(ids: DataFrame, column: str) -> np.ndarray:
    """The bitmap as an array of booleans: 2 MB of bits whatever the column's size."""
    out = np.zeros(1 << (FILTER_BITS - 5), "<u4")
    for w, b in bitmap_words(ids, column).collect():  # a row for each 32 bits at most
        out[w] = b
    return np.unpackbits(out.view(np.uint8), bitorder="little").view(bool)


def _sums(h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sums over each row's set."""
    k1, k2 = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
    some = np.flatnonzero(size)
    if len(h):
        heads = (np.cumsum(size) - size)[some]
        k1[some], k2[some] = np.add.reduceat(mix(h), heads), np.add.reduceat(mix(h ^ U(0x5555_AAAA_1234_5678)), heads)
    return k1, k2


def full_sets(docs: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """node and its sorted distinct shingle hashes as binary, of the classes in `wanted` (node).

    A small bitmap lets nearly only their documents through before anything is shuffled; the join drops the others.
    With ever more ids it lets more through, never fewer."""
    chosen = docs.sparkSession.sparkContext.broadcast(bitmap(wanted.select("node.id"), "id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            batch = whole.filter(pa.array(chosen.value[whole.column(2).to_numpy()]))
            for part in slices(iter([batch])):
                words = Words(part.column(1))
                h, _, size = sorted_sets(*words.shingles(k), words.n_docs)
                offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(size) * 8]).astype(np.int32))
                sets = pa.Array.from_buffers(pa.binary(), words.n_docs, [None, offsets, pa.py_buffer(h)])
                node = pa.StructArray.from_arrays([part.column(0), pa.array(_sums(h, size)[0].view(np.int64))], ["id", "k1"])
                yield pa.RecordBatch.from_arrays([node, sets], ["node", "shingles"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS)).alias("bit"))
    return rows.mapInArrow(run, f"node {NODE}, shingles binary").join(wanted.hint("merge"), "node").dropDuplicates(["node"])


def _confirm(percent: int, differences: bool):
    def run(key: tuple, centre: pa.Table, members: pa.Table) -> pa.Table:
        linked, deltas, prefix = [], [], []
        n = members.num_rows if centre.num_rows else 0
        if n:
            c = np.frombuffer(centre.column("centre_set")[0].as_buffer(), np.uint64)
            for i in range(n):
                m = np.frombuffer(members.column("shingles")[i].as_buffer(), np.uint64)
                at = np.searchsorted(c, m)
                known = c[np.minimum(at, len(c) - 1)] == m
                shared = int(known.sum())
                linked.append(100 * shared >= percent * (len(c) + len(m) - shared))
                if differences:
                    gone = np.ones(len(c), bool)
                    gone[at[known]] = False
                    deltas.append(np.concatenate([m[~known], c[gone]]).view(np.int64))
                    added, removed = len(m) - shared, len(c) - shared
                    least = (added + removed) * (100 + percent) + (100 - percent) * (removed - added)  # over 2 (100 + percent)
                    prefix.append(added + removed - max(0, least // (2 * (100 + percent))))
        first = pa.array(np.zeros(n, np.int64))
        u = centre.column("head").combine_chunks().take(first) if n else pa.array([], members.schema.field("member").type)
        out = {"u": u, "v": members.column("member").slice(0, n), "salt": members.column("salt").slice(0, n), "linked": pa.array(linked, pa.bool_())}
        if differences:
            out |= {"prefix": pa.array(prefix, pa.int64()), "delta": pa.array(deltas, pa.list_(pa.int64()))}
        return pa.table(out)

    return run


def _of_salts(heads: DataFrame) -> DataFrame:
    """One row for each salt of each row with `salts`."""
    return heads.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int, differences: bool = False) -> DataFrame:
    """(u, v, salt, linked) for the distinct (centre, member) pairs: whether their full sets reach the threshold; with
    `differences` also what they differ in, and how many of these a prefix filter must look up. A centre's members are
    dealt into groups (salt) of about SALT."""
    pairs = written(pairs.distinct(), "mh-pairs")
    counts = pairs.groupBy("centre").agg(F.ceil(F.count("*") / SALT).alias("salts"))
    salted = pairs.join(counts, "centre").select("centre", "member", F.pmod(F.xxhash64("member"), F.col("salts")).cast("long").alias("salt"))
    members = salted.join(sets.withColumnRenamed("node", "member").hint("merge"), "member").select("centre", "salt", "member", "shingles")
    heads = counts.join(sets.select(F.col("node").alias("centre"), F.col("shingles").alias("centre_set")).hint("merge"), "centre")
    centres = _of_salts(heads).select(F.col("centre").alias("head"), F.col("salt").alias("head_salt"), "centre_set")
    schema = f"u {NODE}, v {NODE}, salt long, linked boolean" + ", prefix long, delta array<long>" * differences
    return centres.groupBy("head", "head_salt").cogroup(members.groupBy("centre", "salt")).applyInArrow(_confirm(percent, differences), schema)


def missed_by_stars(tested: DataFrame, labels: DataFrame) -> DataFrame:
    """(centre, member) pairs in different components that stars may have missed, from confirmed(differences=True).

    What is known of a centre is joined by centre and salt, so no task gets all members of one centre."""
    label = lambda name: labels.select(F.col("node").alias(name), F.col("component").alias(f"{name}_component"))
    heads = tested.groupBy("u").agg((F.max("salt") + 1).alias("salts")).join(label("u"), "u", "left")
    known = tested.join(_of_salts(heads).drop("salts"), ["u", "salt"]).join(label("v"), "v", "left")
    known = known.select("u", "v", "salt", "prefix", "delta", F.coalesce("v_component", "v").alias("component"), (F.coalesce("u_component", "u") != F.coalesce("v_component", "v")).alias("apart"))
    open_stars = known.groupBy("u").agg(F.max("apart").alias("open"), (F.max("salt") + 1).alias("salts")).where("open")
    spread = known.join(_of_salts(open_stars).select("u", "salt"), ["u", "salt"]).select("u", "v", "apart", "prefix", "component", F.explode("delta").alias("e"))
    spread = written(spread, "mh-differences")
    # a difference of one member is in common with none; one of members that are all together tells nothing new
    often = spread.groupBy("u", "e").agg(F.count("*").alias("n"), F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("apart").alias("open")).where("n > 1")
    rare_first = Window.partitionBy("u", "v").orderBy(F.coalesce("n", F.lit(1)), "e")
    ranked = spread.join(often, ["u", "e"], "left").withColumn("rank", F.row_number().over(rare_first)).where("n is not null")
    ranked = ranked.where("open and lo <> hi")
    left = ranked.where("apart").select("u", "e", F.col("v").alias("centre"), F.col("component").alias("a"))
    right = ranked.where("rank <= prefix").select("u", "e", F.col("v").alias("member"), F.col("component").alias("b"))
    return left.join(right, ["u", "e"]).where("a <> b").select(F.greatest("centre", "member").alias("centre"), F.least("centre", "member").alias("member"))


def classed(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, k1, k2 and component (a node; null without a set or doc_id) for each row of `docs`."""
    prepare(docs.sparkSession)
    found = written(signatures(docs, k, percent), "mh-signatures")
    known = found.where("n_shingles > 0 and doc_id is not null")
    with scratch(docs.sparkSession) as keep:
        # these sides grow with the input, so they are merged and not broadcast while they happen to be small
        # (and written, so that a class of many copies is a join's hot key, which Spark splits, and no aggregate's)
        classes = written(known.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep")), "mh-reps")
        node = F.struct(F.col("rep").alias("id"), "k1").alias("node")
        first = written(known.join(classes.hint("merge"), ["k1", "k2"]).where("doc_id = rep").select(node, "keys"), "mh-classes")
        buckets = first.select("node", F.explode("keys").alias("key"))
        shared = buckets.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
        hits = written(buckets.join(shared.hint("merge"), "key").select("node", "key", "m").distinct(), "mh-hits")
        central = hits.groupBy("node").agg(F.sum("m").alias("c"))
        hits = written(hits.join(central.hint("merge"), "node").select("key", "node", "m", "c"), "mh-central")
        wanted = hits.select("node").distinct()
        sets = written(full_sets(docs, k, wanted), "mh-sets")
        centres = hits.groupBy("key").agg(F.max(F.struct("c", F.bitwise_not("node.id").alias("r"), F.bitwise_not("node.k1").alias("s"))).alias("x"))  # of equal ones the smallest node
        centres = centres.select("key", F.struct(F.bitwise_not("x.r").alias("id"), F.bitwise_not("x.s").alias("k1")).alias("centre"))
        pairs = hits.join(centres.hint("merge"), "key").where("node <> centre").select("centre", F.col("node").alias("member"))
        tested = written(confirmed(pairs, sets, percent, differences=True), "mh-stars")
        links = tested.where("linked").select("u", "v")
        labels = components(links)
        more = written(confirmed(missed_by_stars(tested, labels), sets, percent).where("linked").select("u", "v"), "mh-links")
        if not more.isEmpty():
            labels = components(links.union(more))
        final = keep(written(classes.select("k1", "k2", node).join(labels, "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("class_component")), "mh-final"))
    out = found.drop("keys").join(final.hint("merge"), ["k1", "k2"], "left")
    return out.select("doc_id", "n_shingles", "k1", "k2", F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("class_component")).alias("component"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of `docs`."""
    component = F.coalesce("component.id", "doc_id")
    return classed(docs, k, percent).select("doc_id", "n_shingles", component.alias("component_id"), (component.isNull() | (component == F.col("doc_id"))).alias("kept"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of `docs`, all columns, of each component, and all rows without a set or doc_id.

    Documents outside a bitmap of the ids that lose rows stay where they are; only the others, those that lose rows and
    few besides, get their sets once more and go through the join that decides exactly."""
    with scratch(docs.sparkSession) as keep:
        found = classed(docs, k, percent).where("component is not null")
        mine = (F.col("doc_id") == F.col("component.id")) & (F.col("k1") == F.col("component.k1"))
        # written, so that the aggregate deals by doc_id too and a class of many copies is not one task's
        found = written(found.select("doc_id", "k1", "k2", mine.alias("mine")), "mh-judged")
        many = found.groupBy("doc_id", "k1", "k2").agg(F.count("*").alias("rows"), F.min("mine").alias("stays")).where("rows > 1 or not stays")
        many = keep(written(many.select("doc_id", "k1", "k2", "stays"), "mh-gone"))
    bits = F.broadcast(bitmap_words(many, "doc_id").select(F.struct("_w", "_b").alias("filter")))  # 2**(FILTER_BITS - 5) rows at most
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("bit", F.pmod(F.xxhash64("id"), F.lit(1 << FILTER_BITS)))
    seen = rows.join(bits, F.shiftright("bit", 5) == F.col("filter._w"), "left")
    maybe = F.coalesce(F.col("filter._b").bitwiseAND(F.expr("shiftleft(1L, cast(bit % 32 as int))")) != 0, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            words = Words(batch.column(2))
            h, _, size = sorted_sets(*words.shingles(k), words.n_docs)
            k1, k2 = (pa.array(x.view(np.int64), mask=size == 0) for x in _sums(h, size))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), k1, k2], ["row", "id", "k1", "k2"])

    schema = T.StructType([T.StructField("row", docs.schema), *(T.StructField(c, T.LongType()) for c in ("id", "k1", "k2"))])
    tested = written(seen.where(maybe).select("row", "id", "text").mapInArrow(run, schema), "mh-maybe")
    judged = tested.join(many.withColumnRenamed("doc_id", "id").hint("merge"), ["id", "k1", "k2"], "left")
    alone = judged.where("stays is null").select("row.*")
    one = judged.where("stays").dropDuplicates(["id", "k1", "k2"]).select("row.*")
    return seen.where(~maybe).select("row.*").union(alone).union(one)


def op8_minhash_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
