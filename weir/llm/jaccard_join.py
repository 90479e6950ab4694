"""N-gram Jaccard join with vertical partitioning, and the groups that its links form.

A document's set are its distinct word n-grams, as 56-bit hashes under one global order: rare ones
first, by a count of all n-grams in ``COUNTERS`` hashed counters, then by hash. The order is cut into
``FRAGMENTS`` fragments of equal weight; the overlap of two sets is counted fragment by fragment and
summed for each pair.

Candidates come from prefixes: two sets that are similar enough share one of their first n-grams.
Documents with equal sets are one class, so copies are never paired. In a group of near copies the
pairs would still grow with its square; so each class is first compared with one hub, the class that
leads most of the prefix lists it is on. A class with most n-grams in common with its hub is then
described by its difference to the hub, and
 - two that are both linked to the hub are in one group, whatever their own similarity;
 - two of which one is not linked to the hub are similar only if their differences have about half
   of the smaller in common, so they are found by a prefix join over the differences, rare ones first;
 - classes with different hubs are found by the prefix join over the n-grams.
No list of partners is cut anywhere, and every pair that is needed for the groups is verified exactly
(up to hash collisions: 56 bits within a pair, 64 bits for classes).

Defined cases: a null or empty text, or one of white space, has an empty set and is linked with
nothing. With fewer words than n the whole sequence is the only n-gram. Repeated rows are copies.
Null ids: such a document takes part, and its group's component_id is the smallest id that isn't null
(null if there is none). Very long texts are read whole. Empty tables give no rows; extra columns
don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from weir.llm.common import HOT_GROUPS, join_groups, materialise, mix, texts, whole_row
from weir.llm.components import components
from weir.llm.exact_dedup import contains, maybe_repeated, repeated_filter

COUNTERS, SLICES, FRAGMENTS = 1 << 22, 16, 8
#: Tasks whose counters one task sums at a time.
TOGETHER = 256
#: Hubs of a list from which it may be dealt into parts.
LONG = 256
_LOW = np.uint64((1 << 56) - 1)


def ngrams(text: str, n: int) -> np.ndarray:
    """Sorted distinct 56-bit hashes of a text's word n-grams."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(n, len(h))
    acc = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : i + len(acc)])
    return np.unique((acc & _LOW).astype(np.int64))


def class_of(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).astype(np.int64))


class Order:
    """The global order: a number for each n-gram, and the cuts between fragments."""

    def __init__(self, level: np.ndarray):
        self.level = level  # of each counter, 0 to 127
        weight = np.bincount(level, np.exp2(level / 4.0), 128)
        ends = np.cumsum(weight) / max(1.0, weight.sum())
        self.cuts = []
        for f in range(1, FRAGMENTS):
            k = int(np.searchsorted(ends, f / FRAGMENTS))
            low = ends[k - 1] if k else 0.0
            inside = (f / FRAGMENTS - low) / max(1e-12, ends[k] - low) if k < 128 else 0.0
            self.cuts.append((min(k, 127) << 56) + int(min(0.999999, inside) * (1 << 56)))

    def __call__(self, grams: np.ndarray) -> np.ndarray:
        return np.sort((self.level[grams & (COUNTERS - 1)].astype(np.int64) << 56) | grams)

    def fragments(self, keys: np.ndarray) -> list[np.ndarray]:
        return np.split(keys, np.searchsorted(keys, self.cuts))


def row_key() -> Column:
    """64 bits of a document's id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def _sets_and_counts(docs: DataFrame, n: int) -> DataFrame:
    """A row for each document (doc_id, key of id and text, n, cls) and the counters of each task (slice, blob)."""

    def run(batches):
        counts = np.zeros(COUNTERS, np.uint32)
        names = ["doc_id", "key", "n", "cls", "slice", "blob"]
        seen = False
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                grams = [ngrams(t, n) for t in texts(part.column(1))]
                at, times = np.unique(np.concatenate(grams) & (COUNTERS - 1), return_counts=True)
                counts[at] += times.astype(np.uint32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([len(g) for g in grams], pa.int32()), pa.array([class_of(g) for g in grams], pa.int64()), pa.nulls(len(grams), pa.int32()), pa.nulls(len(grams), pa.binary())], names)
                seen = True
        if seen:
            for k, part in enumerate(np.split(counts, SLICES)):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.array([k], pa.int32()), pa.array([zstandard.compress(part.tobytes(), 1)], pa.binary())], names)

    return docs.select(F.col("doc_id").cast("long"), "text", row_key()).mapInArrow(run, "doc_id long, key long, n int, cls long, slice int, blob binary")


def _order(counts: DataFrame) -> Order:
    """Sums the counters slice by slice, those of ``TOGETHER`` tasks first; the driver gets one byte for each of the COUNTERS."""

    def summed(batches, dtype) -> dict[int, np.ndarray]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                part = np.frombuffer(zstandard.decompress(blob), dtype).astype(np.int64)
                sums[k] = sums[k] + part if k in sums else part
        return sums

    def lane(batches):
        for k, v in summed(batches, np.uint32).items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zstandard.compress(v.tobytes(), 1)], pa.binary())], ["slice", "blob"])

    def run(batches):
        for k, v in summed(batches, np.int64 if lanes > 1 else np.uint32).items():
            level = np.minimum(127, 4 * np.log2(v + 1)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zstandard.compress(level.tobytes())], pa.binary())], ["slice", "level"])

    level = np.zeros(COUNTERS, np.uint8)
    size = COUNTERS // SLICES
    lanes = -(-counts.rdd.getNumPartitions() // TOGETHER)
    blobs = counts.select("slice", "blob", F.pmod(F.spark_partition_id(), F.lit(lanes)).alias("lane"))
    if lanes > 1:
        blobs = blobs.repartition(SLICES * lanes, "slice", "lane").mapInArrow(lane, "slice int, blob binary")
    for r in blobs.repartition(SLICES, "slice").mapInArrow(run, "slice int, level binary").collect():
        level[r.slice * size : (r.slice + 1) * size] = np.frombuffer(zstandard.decompress(r.level), np.uint8)
    return Order(level)


def _prefixes(docs: DataFrame, n: int, percent: int, order) -> DataFrame:
    """g, cls, n, pos: the first n-grams of each class, as many as two similar sets can't both miss; a task emits a class once."""

    def run(batches):
        seen: set[int] = set()
        for b in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            out = []
            for t in texts(b.column(0)):
                grams = ngrams(t, n)
                if len(grams) and (c := class_of(grams)) not in seen:
                    seen.add(c)
                    k = len(grams) - -(-percent * len(grams) // 100) + 1
                    out.append((order.value(grams)[:k].copy(), c, len(grams), k))
            if out:
                ks = [x[3] for x in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([x[0] for x in out])), *(pa.array(np.repeat(np.array([x[i] for x in out], kind), ks)) for i, kind in ((1, np.int64), (2, np.int32))), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in ks]))],
                    ["g", "cls", "n", "pos"],
                )

    return docs.select("text").mapInArrow(run, "g long, cls long, n int, pos int")


def _sets(docs: DataFrame, n: int, order, wanted: DataFrame) -> DataFrame:
    """cls, frag, head, keys, task of the classes whose documents are wanted (doc_id), and a few more; a task emits a class once.

    ``head`` marks the first fragment. Asked as ``frag = 0`` of a small table, Spark takes it for a
    selective filter of a join, whose Bloom filters of megabytes then go along in every closure.
    """
    key = F.xxhash64(F.col("doc_id").cast("long"))
    ids = wanted.select(key.alias("h")).distinct()
    bits, counters = repeated_filter(ids.unionAll(ids), 2 * ids.count())
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches):
        seen: set[int] = set()
        for b in (whole.slice(i, 256) for whole in batches for i in range(0, whole.num_rows, 256)):
            maybe = contains(b.column(0).to_numpy(), shared.value, counters)
            rows = {c: g for c, g in ((class_of(g), g) for g in (ngrams(t, n) for t in texts(b.column(1).filter(pa.array(maybe)))) if len(g)) if c not in seen}
            if rows:
                seen.update(rows)
                cut = [x for g in rows.values() for x in order.value.fragments(order.value(g))]
                yield pa.RecordBatch.from_arrays([pa.array([c for c in rows for _ in range(FRAGMENTS)], pa.int64()), pa.array(list(range(FRAGMENTS)) * len(rows), pa.int32()), pa.array([k == 0 for k in range(FRAGMENTS)] * len(rows)), pa.array(cut, pa.list_(pa.int64()))], ["cls", "frag", "head", "keys"])

    found = docs.select(key.alias("h"), "text").mapInArrow(run, "cls long, frag int, head boolean, keys array<long>").withColumn("task", F.spark_partition_id())
    found = materialise(found)
    shared.unpersist()
    return found


def _overlaps(pairs: DataFrame, sets: DataFrame, difference: bool, frags: str = "true") -> DataFrame:
    """Partial overlaps by fragment, summed for each pair (a, b); with the sizes of both; with ``difference`` also the n-grams of only one of the two.

    The pairs of a class b that has many are dealt into parts, each of which gets b's fragments. Of a
    class that several tasks have read, the first task's fragments are taken.
    """
    first = sets.filter("head").groupBy("cls").agg(F.min("task").alias("task"))
    sets = sets.filter(frags)
    keep = [c for c in pairs.columns if c not in ("a", "b")]
    least = max(64, -(-pairs.count() // HOT_GROUPS))
    often = pairs.groupBy("b").agg(F.ceil(F.count("*") / least).alias("parts")).filter("parts > 1")  # HOT_GROUPS at most
    pairs = pairs.join(F.broadcast(often), "b", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("a"), F.col("parts")), F.lit(0))).drop("parts")
    of = lambda own: sets.join(own.join(first.hint("merge"), "cls").hint("merge"), ["cls", "task"])
    left = of(pairs.withColumnRenamed("a", "cls")).select(F.col("cls").alias("a"), "b", *keep, "part", "frag", F.col("keys").alias("ka"))
    right = of(pairs.select(F.col("b").alias("cls"), "part").distinct()).select(F.col("cls").alias("b"), "part", "frag", F.col("keys").alias("kb"))
    more, less = F.array_except("ka", "kb"), F.array_except("kb", "ka")
    delta = [F.concat(more, less).alias("delta")] if difference else []
    parts = left.join(right.hint("merge"), ["b", "part", "frag"]).select("a", "b", "frag", *keep, (F.size("ka") - F.size(more)).alias("o"), (F.size("ka") + F.size("kb")).alias("s"), *delta)
    return parts.groupBy("a", "b", *keep).agg(F.sum("o").alias("overlap"), F.sum("s").alias("sizes"), *(F.flatten(F.collect_list("delta")).alias("delta") for _ in delta))


def links(docs: DataFrame, n: int, percent: int, order, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) of classes whose links make up the groups: those of a class with its hub, and all others."""
    linked = lambda na, nb, d: d * (100 + percent) <= (100 - percent) * (na + nb)
    same = W.partitionBy("g").orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    lists = _prefixes(docs, n, percent, order).select("*", F.min("cls").over(same).alias("lo"), F.max("cls").over(same).alias("hi"))
    lists = lists.filter("lo <> hi").drop("lo", "hi").dropDuplicates(["g", "cls"])
    # Most lists hold two classes by chance, whose sizes and places already rule out a link.
    whole = {"size": F.count("*"), "least": F.min("n"), "most": F.max("n"), "left": F.min(F.col("n") - F.col("pos")), "both": F.sum("n")}
    lists = lists.select("*", *(f.over(same).alias(k) for k, f in whole.items()))
    lists = lists.filter(f"size > 2 or (100 * least >= {percent} * most and left * {100 + percent} >= {percent} * both)")
    lists = materialise(lists.drop(*whole))
    # Hubs: in each list the class with the largest share of shared prefix n-grams leads; a class takes the
    # best of the leaders that it meets in a fifth of its prefix or in a long list. (Fewer n-grams in
    # common are no hint at a copy; a class without a hub costs nothing but time.)
    by = lambda c: W.partitionBy(c).orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = lists.select("g", "cls", "n", (F.count("*").over(by("cls")) / F.col("n")).alias("share"))
    led = ranked.select("cls", "n", F.max(F.struct("share", (-F.col("cls")).alias("minus"), "n")).over(same).alias("lead"), F.count("*").over(same).alias("size"))
    votes = led.groupBy("cls", "n", "lead").agg(F.count("*").alias("votes"), F.max("size").alias("size")).filter(f"500 * votes >= {100 - percent} * n or size >= 16")
    hub = votes.groupBy("cls", "n").agg(F.max("lead").alias("lead"))
    star = hub.select(F.col("cls").alias("a"), (-F.col("lead.minus")).alias("b"), F.col("n").alias("na"), F.col("lead.n").alias("nb"))
    star = materialise(star.filter("a <> b and 4 * abs(na - nb) <= na + nb"))
    of = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("cls")).distinct().join(classes.select("cls", F.col("rep").alias("doc_id")).hint("merge"), "cls")
    sets = _sets(docs, n, order, of(star))
    d = F.col("na") + F.col("nb") - 2 * F.col("overlap")
    star = _overlaps(star, sets, True).withColumn("d", d).filter(4 * F.col("d") <= F.col("na") + F.col("nb"))
    star = materialise(star.select("a", "b", "na", "nb", "d", "delta").withColumn("near", linked(F.col("na"), F.col("nb"), F.col("d"))))
    # Same hub, not both linked to it: prefixes of the differences.
    hubs_of = star.groupBy("b").agg(F.count("*").alias("members"), F.bool_or(~F.col("near")).alias("far")).filter("far").select("b", "members")
    own = materialise(join_groups(star, hubs_of, "b", "members", star.count()).drop("members"))
    each = own.select("a", "b", F.explode("delta").alias("e"))
    df = each.groupBy("b", "e").agg(F.count("*").alias("df")).filter("df > 1")
    common = join_groups(each, df, ["b", "e"], "df", each.count())
    common = common.groupBy("a", "b").agg(F.transform(F.sort_array(F.collect_list(F.struct("df", "e"))), lambda x: x["e"]).alias("es"))
    ranked = materialise(own.select("a", "b", "na", "d", "near").join(common.hint("merge"), ["a", "b"]))
    # In order of frequency, those that only one class of the hub has come first and meet nothing.
    half = F.col("d") - F.floor(F.col("d") * percent / (100 + percent))
    long_ = F.col("d") - F.greatest(F.lit(1), F.col("d") - F.floor(F.col("na") * (100 - percent) / percent)) + 1
    shared = lambda take: F.posexplode(F.slice("es", 1, F.greatest(F.lit(0), take - F.col("d") + F.size("es")).cast("int")))
    right = ranked.select(F.col("a").alias("y"), "b", F.col("na").alias("ny"), F.col("d").alias("dy"), F.size("es").alias("my"), shared(half).alias("j", "e"))
    left = ranked.filter("not near").select(F.col("a").alias("x"), "b", F.col("na").alias("nx"), F.col("d").alias("dx"), F.size("es").alias("mx"), shared(long_).alias("i", "e"))
    # What can still be in common from this place on must be enough.
    most = 2 * F.least(F.col("mx") - F.col("i"), F.col("my") - F.col("j"))
    near_enough = linked(F.col("nx"), F.col("ny"), F.greatest(F.abs(F.col("dx") - F.col("dy")), F.col("dx") + F.col("dy") - most))
    pairs = left.join(right.hint("merge"), ["b", "e"]).filter((F.col("x") != F.col("y")) & near_enough).select("b", F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    one = ranked.select("b", F.col("a").alias("x"), F.col("na").alias("nx"), F.col("d").alias("dx"), F.col("es").alias("ex"))
    two = ranked.select("b", F.col("a").alias("y"), F.col("na").alias("ny"), F.col("d").alias("dy"), F.col("es").alias("ey"))
    checked = pairs.join(one.hint("merge"), ["b", "x"]).join(two.hint("merge"), ["b", "y"])
    d = F.col("dx") + F.col("dy") - 2 * F.size(F.array_intersect("ex", "ey"))
    linked_same = materialise(checked.filter(linked(F.col("nx"), F.col("ny"), d)).select(F.col("x").alias("a"), F.col("y").alias("b")))
    # Different hubs: lists that have classes of more than one.
    hubs = star.select(F.col("a").alias("cls"), F.col("b").alias("hub"))
    lists = lists.join(hubs.hint("merge"), "cls", "left").withColumn("hub", F.coalesce("hub", "cls"))
    lists = materialise(lists)
    mixed = lists.groupBy("g").agg(F.min("hub").alias("lo"), F.max("hub").alias("hi"), F.count("*").alias("size")).filter("lo <> hi").select("g", "size")
    lists = materialise(join_groups(lists, mixed, "g", "size", lists.count()).select("g", "hub", "cls", "n", "pos"))
    pair = materialise(lists.select("g", "hub").distinct())
    # A list of many hubs is dealt into parts, each of which meets all hubs of the list.
    least = max(LONG, -(-pair.count() // HOT_GROUPS))
    long_lists = F.broadcast(pair.groupBy("g").agg(F.ceil(F.count("*") / least).alias("parts")).filter("parts > 1"))  # HOT_GROUPS at most
    pair = pair.join(long_lists, "g", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    every = pair.select("g", F.col("hub").alias("hub2"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    pair = pair.withColumn("part", F.pmod(F.xxhash64("hub"), F.col("parts"))).join(every.hint("merge"), ["g", "part"]).filter("hub < hub2").select("g", "hub", "hub2")
    other = lists.select("g", F.col("hub").alias("hub2"), F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    cross = pair.join(lists.hint("merge"), ["g", "hub"]).join(other.hint("merge"), ["g", "hub2"])
    least = F.least(F.col("n") - F.col("pos"), F.col("nb") - F.col("pb"))
    cross = cross.filter((F.least("n", "nb") * 100 >= F.greatest("n", "nb") * percent) & (least * (100 + percent) >= percent * (F.col("n") + F.col("nb"))))
    cross = materialise(cross.select(F.least("cls", "b").alias("a"), F.greatest("cls", "b").alias("b"), (F.col("n") + F.col("nb")).alias("both")).distinct())
    # A pair that differs too much in its first fragment alone needs no other.
    sets = _sets(docs, n, order, of(cross))
    cross = _overlaps(cross, sets, False, "head")
    cross = cross.filter((F.col("sizes") - 2 * F.col("overlap")) * (100 + percent) <= (100 - percent) * F.col("both"))
    cross = materialise(cross.select("a", "b", "both", F.col("overlap").alias("first")))
    cross = _overlaps(cross, sets, False, "not head").filter((100 + percent) * (F.col("first") + F.col("overlap")) >= percent * F.col("both"))
    # Written one by one, since the driver's memory grows with the largest plan.
    return star.filter("near").select("a", "b"), linked_same.unionByName(materialise(cross.select("a", "b")))


def _classes(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """Rows (doc_id, key, n_shingles, cls), their number, and the classes of those that aren't empty.

    Of a class: size, class_id, and of its group component_id, rows and best, which is the key of the
    row with the smallest id; a null id comes after all others, and the key decides between equal ones.
    """
    found = materialise(_sets_and_counts(docs, n))
    order = docs.sparkSession.sparkContext.broadcast(_order(found.filter("slice is not null")))
    rows = found.filter("slice is null").select("doc_id", "key", F.col("n").alias("n_shingles"), "cls")
    total = rows.count()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("best")
    classes = materialise(rows.filter("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), first))
    near, others = links(docs, n, percent, order, classes)
    # Hubs stand for the classes linked to them, so that components are looked for among hubs and loose classes only.
    hub = near.select(F.col("a").alias("cls"), F.col("b").alias("hub"))
    hubs = materialise(near.groupBy("b").agg(F.count("*").alias("members")))
    by_hub = lambda df, c: df.join(hub.select(F.col("cls").alias(c), F.col("hub").alias("to")).hint("merge"), c, "left").withColumn(c, F.coalesce("to", c)).drop("to")
    between = near.join(hubs.select(F.col("b").alias("a")).hint("merge"), "a", "left_semi").unionByName(by_hub(by_hub(others, "a"), "b"))
    parts = components(between)
    order.unpersist()  # all that needs it is written
    roots = hubs.join(parts.select(F.col("node").alias("b"), F.col("component").alias("to")).hint("merge"), "b", "full").select(F.col("b").alias("root"), F.coalesce("to", "b").alias("component"), F.coalesce("members", F.lit(1)).alias("members"))
    placed = classes.join(hub.hint("merge"), "cls", "left").withColumn("root", F.coalesce("hub", "cls")).drop("hub")
    known = materialise(roots)
    alone = placed.join(known.select("root").hint("merge"), "root", "left_anti").withColumn("component", F.col("cls"))
    named = join_groups(placed, known, "root", "members", total).select("cls", "rep", "size", "best", "component").unionByName(alone.select("cls", "rep", "size", "best", "component"))
    named = materialise(named)
    whole = named.groupBy("component").agg(F.min("rep").alias("component_id"), F.sum("size").alias("rows"), F.min("best").alias("least"), F.count("*").alias("classes"))
    found = join_groups(named, whole, "component", "classes", total)
    named = materialise(found.select("cls", "size", F.col("rep").alias("class_id"), "component_id", "rows", F.col("least.key").alias("best")))
    return rows, named, total


def groups(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id, component_id."""
    rows, named, total = _classes(docs, n, percent)
    rows = rows.drop("key")
    full = join_groups(rows.filter("n_shingles > 0"), named.select("cls", "size", "class_id", "component_id"), "cls", "size", total).select("doc_id", "n_shingles", "class_id", "component_id")
    empty = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with exactly one row of each group, the one with the smallest id; the columns stay.

    Rows are told apart by id and text together, so other texts under a dropped row's id stay. A null
    id comes after all others; of rows with the same id one stays, whatever their texts in the group,
    and of rows that are equal in both any one. Documents without n-grams are in no group and all stay.
    Only rows that a bounded filter can't tell from decided ones are shuffled.
    """
    rows, named, total = _classes(docs, n, percent)
    shared_by = join_groups(rows.filter("n_shingles > 0"), named.filter("rows > 1").select("cls", "size", "best"), "cls", "size", total)
    decided = shared_by.groupBy("key").agg(F.count("*").alias("size"), F.first(F.col("key") == F.col("best")).alias("keep"))
    decided = materialise(decided.filter("not keep or size > 1"))
    ids = decided.select(F.col("key").alias("h"))
    bits, counters = repeated_filter(ids.unionAll(ids), 2 * decided.count())
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    marked = docs.select(whole_row(docs), row_key().alias("key"))
    marked = marked.withColumn("maybe", maybe_repeated(F.col("key"), shared, counters))
    maybe = marked.filter("maybe").select("r", "key")
    # As in join_groups, but rows that the filter marked in error stay.
    least = max(2, -(-total // HOT_GROUPS))
    hot = F.broadcast(decided.filter(F.col("size") >= least))
    cold = maybe.join(hot.select("key"), "key", "left_anti").join(decided.filter(F.col("size") < least), "key", "left")
    equal = maybe.join(hot.filter("keep").select("key"), "key").unionByName(cold.filter("keep").select("key", "r"))
    equal = equal.groupBy("key").agg(F.first("r").alias("r"))
    return marked.filter("not maybe").select("r.*").unionByName(cold.filter("keep is null").select("r.*")).unionByName(equal.select("r.*"))
