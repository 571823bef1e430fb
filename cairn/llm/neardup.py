"""Near-duplicate documents by bottom-k sketches from one hash function.

1. Each text's set of n-word shingle hashes gives its size, a 128-bit signature of the whole set, and its `LOW` smallest hashes.
2. Equal sets fall together by signature; one representative of each goes on.
3. Inverted lists of the retained values: two sets whose similarity reaches the threshold share well over a third of their retained values, so each set enters only the lists of its rarest ones, two thirds and one more (the prefix filter; no list is cut).
   What is common to many unlike texts, such as a license passage, thereby leaves the lists.
4. First pass: each set meets the list member that shares the most with others (its pivot); the exact Jaccard similarity of the full sets confirms the link. Components follow.
5. Second pass, over the groups of sets that met one pivot and are not all connected: every pair of sets that share a list is in such a group. In groups of up to `BLOCK` sets all pairs
   of different components are compared by union sketches of `WIDE` values inside the tasks; only pairs that can reach the threshold leave a task. Exact Jaccard confirms them.
6. Larger groups are thinned first, by exact bounds from counts that are combined before each shuffle (`able`): what a set has for itself alone in its group, and how far it is from the pivot,
   says how near any other member can come. What is left is compared in blocks; blocks of one component do not meet.

Pairs that are already connected are never compared again, so a large group of copies costs one comparison each, and so does a large group of near copies of one text, linked with it or not.
A linked pair is missed only when its sketches deviate by more than 4.5 standard deviations from its similarity.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import new_path, slices, written
from .words import Words, mix

LOW, WIDE, NARROW, BLOCK = 24, 256, 128, 512
#: Pairs of one set for each of which a copy of the set is made, so that a set with many partners is no single task's.
PARTNERS = 256
#: Bits of the table that spares most texts the way to the sets, per document that needs one, and at most: 16 MB, beyond which it spares fewer.
BITS_EACH, MOST_BITS = 16, 1 << 27
DEVIATIONS = 4.5


def _distinct(column: pa.Array, words: int, lower: bool) -> Iterator[np.ndarray]:
    s, first = Words(column, lower).shingles(words)
    for a, b in zip(first[:-1], first[1:], strict=True):
        yield np.unique(s[a:b])


def _bit(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(bits)).astype(np.int64)


def _marked(ids: DataFrame) -> np.ndarray:
    """A packed table of bits, one set for each id: which documents surely need no set."""
    bits = min(MOST_BITS, max(64, 1 << (BITS_EACH * ids.count()).bit_length()))

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_bit(batch.column(0).to_numpy(), bits))], names=["bit"])

    words = ids.mapInArrow(place, "bit long").groupBy(F.shiftright("bit", 5).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("b")).toArrow()
    out = np.zeros(bits // 32, np.uint32)
    out[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.uint32)
    return out


def _needed(table: np.ndarray):
    bits = 32 * len(table)

    def run(batches):
        for batch in batches:
            at = _bit(batch.column("doc_id").fill_null(0).to_numpy(), bits)
            yield batch.filter(pa.array((table[at >> 5] >> (at & 31).astype(np.uint32)) & 1 == 1))

    return run


def _bucketed(df: DataFrame, buckets: int) -> tuple[DataFrame, str]:
    """df, which is dealt by id into that many partitions, as a table in the shared folder that joins on id read without a shuffle."""
    spark = df.sparkSession
    path = new_path(spark, "sets")
    name = "cairn_" + path.rpartition("-")[2]
    df.write.bucketBy(buckets, "id").sortBy("id").option("path", path).saveAsTable(name)
    return spark.table(name), name


def _sketches(words: int, lower: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64()), ("low", pa.list_(pa.int64()))])

    def run(batches):
        for batch in slices(batches):
            n, a, b, low = [], [], [], []
            for s in _distinct(batch.column("text"), words, lower):
                n.append(len(s))
                a.append(int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum().astype(np.int64)))
                b.append(int(mix(s + np.uint64(0x14057B7EF767814F)).sum().astype(np.int64)))
                low.append(s[:LOW].astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(low, pa.list_(pa.int64()))], schema=schema)

    return run, "doc_id long, n_shingles long, sig_a long, sig_b long, low array<long>"


def _full_sets(words: int, lower: bool):
    schema = pa.schema([("id", pa.int64()), ("wide", pa.binary()), ("all", pa.list_(pa.int64()))])

    def run(batches):
        for batch in slices(batches):
            wide, full = [], []
            for s in _distinct(batch.column("text"), words, lower):
                wide.append((s[:WIDE] >> np.uint64(32)).astype(np.uint32).tobytes())
                full.append(s.astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(wide, pa.binary()), pa.array(full, pa.list_(pa.int64()))], schema=schema)

    return run, "id long, wide binary, all array<long>"


def union_estimate(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> tuple[float, int]:
    """The Jaccard similarity estimated on the union sketch, and the number of values it rests on (0: the sketches hold both whole sets)."""
    limit = min([int(x[-1]) for x, n in ((a, n_a), (b, n_b)) if n > WIDE], default=None)
    if limit is not None:
        a, b = a[: np.searchsorted(a, limit, "right")], b[: np.searchsorted(b, limit, "right")]
    both = len(np.intersect1d(a, b))
    size = max(1, len(a) + len(b) - both)
    return both / size, 0 if limit is None else size


def _close(a, b, n_a: int, n_b: int, share: float) -> bool:
    estimate, size = union_estimate(a, b, n_a, n_b)
    return estimate >= share - (DEVIATIONS * (share * (1 - share) / size) ** 0.5 if size else 0.02)


def _crossing(rows: dict, pivot: int, same: bool, share: float) -> Iterator[tuple[int, int]]:
    """Pairs of one group, or of two blocks of a large one, that may reach the threshold and are in different components; of the groups that both are in, the first has them."""
    ids, part, n, block = rows["id"], rows["component"], rows["n"], rows["block"]
    m = len(ids)
    if m < 2 or len(set(part.tolist())) < 2:
        return
    wide = [np.frombuffer(w, np.uint32) for w in rows["wide"]]
    order = np.argsort(n, kind="stable")
    reach = np.searchsorted(n[order], n[order] / share + 1e-9, "right")
    shared = None
    if m > 48:  # counts of common values among the NARROW smallest for all pairs of the block at once, to pass over most of them
        narrow = [w[:NARROW] for w in wide]
        held = np.array([len(w) for w in narrow])
        whole = n <= NARROW
        _, inverse, count = np.unique(np.concatenate(narrow), return_inverse=True, return_counts=True)
        keep = count > 1
        column, row, used = (np.cumsum(keep) - 1)[inverse], np.repeat(np.arange(m), held), keep[inverse]
        shared = np.zeros((m, m), np.float32)
        for k in range(0, int(keep.sum()), 4096):
            inside = used & (column >= k) & (column < k + 4096)
            x = np.zeros((m, min(4096, int(keep.sum()) - k)), np.float32)
            x[row[inside], column[inside] - k] = 1
            shared += x @ x.T
    for at, i in enumerate(order):
        others = order[at + 1 : reach[at]]
        others = others[part[others] != part[i]]
        if not same:
            others = others[block[others] != block[i]]
        if shared is not None and len(others):
            least = np.where(whole[others] & whole[i], (held[others] + held[i]) * (share / (1 + share)) - 1, np.minimum(held[others], held[i]) * 0.6)
            others = others[shared[i][others] >= least]
        for j in others:
            a, b = rows["pivots"][i], set(rows["pivots"][j])
            if next(x for x in a if x in b) == pivot and _close(wide[i], wide[j], n[i], n[j], share):
                yield (int(ids[i]), int(ids[j])) if ids[i] < ids[j] else (int(ids[j]), int(ids[i]))


def _second_pass(share: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def groups(batches):
        """Rows of one (pivot, i, j) after another; rows arrive sorted by these. A group has at most 2 blocks."""
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            key = np.stack([table.column(c).to_numpy() for c in ("pivot", "i", "j")])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            edges = [0, *cut.tolist()]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a > 1:
                    yield key[:, a], table.slice(a, b - a)
            held = table.slice(edges[-1]).combine_chunks()
        if held is not None and held.num_rows > 1:
            yield np.array([held.column(c)[0].as_py() for c in ("pivot", "i", "j")]), held

    def run(batches):
        found: list[tuple[int, int]] = []
        for (pivot, i, j), t in groups(batches):
            rows = {c: t.column(c).to_numpy() for c in ("id", "component", "n", "block")} | {c: t.column(c).to_pylist() for c in ("wide", "pivots")}
            found += _crossing(rows, int(pivot), i == j, share)
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)
                found = []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], schema=schema)

    return run, "a long, b long"


def _met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) with both, n_a and n_b: the sizes of the common and the full sets. Of a set that is the a of many pairs there is a copy for every PARTNERS of them."""
    hot = written(pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("copies")).filter("copies > 1"), "hot")
    left = pairs.join(hot, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("copies")), F.lit(0)).cast("int").alias("copy"))
    left = left.join(sets.select(F.col("id").alias("b"), F.col("all").alias("all_b")), "b")
    right = sets.select(F.col("id").alias("a"), F.col("all").alias("all_a")).join(pairs.select("a").distinct(), "a", "left_semi").join(hot, "a", "left")
    right = right.select("a", "all_a", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("copy"))
    return left.join(right, ["a", "copy"]).select("a", "b", F.size(F.array_intersect("all_a", "all_b")).alias("both"), F.size("all_a").alias("n_a"), F.size("all_b").alias("n_b"))


def _linked(percent: int) -> Column:
    return 100 * F.col("both") >= percent * (F.col("n_a") + F.col("n_b") - F.col("both"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold, as edges."""
    return _met(pairs, sets).filter(_linked(percent)).select(F.col("a").alias("u"), F.col("b").alias("v"))


def able(members: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """members(a, b, component, own, main) of large groups, a being the group's pivot, own its component and main the group's largest, to those that may have a link which no component holds yet, and the links with the pivots.

    Two sets X and Y are linked if their symmetric difference has at most r * (|X| + |Y|) elements, r = (1 - s) / (1 + s) at similarity s. Let d(X) be the size of X's difference from the
    pivot and u(X) the number of elements that X alone has in the group. X and Y differ in d(X) + d(Y) - 2c elements, c being common to both differences, and c is at most d(X) - u(X) and
    d(Y) - u(Y). So linked sets have overlapping ranges from d - r|X| to d - 2u + r|X|: low(X) <= high(Y) and low(Y) <= high(X). Members go whose range meets that of no member of a like size
    outside their component (or, for those outside main, of any member), by the extremes of each class of sizes. With independent changes high is about r|X| for all, which only sets linked with the pivot reach.
    """
    share = percent / 100
    r = (1 - share) / (1 + share)
    elements = members.select("a", "b").join(sets.select(F.col("id").alias("b"), "all"), "b").select("a", "b", F.explode("all").alias("e"))
    alone = elements.groupBy("a", "e").agg(F.count("*").alias("c"), F.min("b").alias("b")).filter("c = 1").groupBy("a", "b").agg(F.count("*").alias("u"))
    met = written(_met(members.select("a", "b"), sets), "met")
    d, n = F.col("n_a") + F.col("n_b") - 2 * F.col("both"), F.col("n_b")
    component = F.when(_linked(percent), F.col("own")).otherwise(F.col("component"))
    u = F.when(F.col("a") == F.col("b"), 0).otherwise(F.coalesce("u", F.lit(0)))  # what the pivot has alone is in all other differences
    found = members.join(met, ["a", "b"]).join(alone, ["a", "b"], "left").select(
        "a", "b", n.alias("n"), component.alias("component"), (component == F.col("main")).alias("inside"),
        F.floor(F.log(n) / math.log(1 / share)).alias("class"), (d - r * n).alias("low"), (d - 2 * u + r * n).alias("high"),
    )
    found = written(found, "ranges")
    each = found.groupBy("a", "class", "inside").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    each = each.withColumn("class", F.explode(F.array(*(F.col("class") + k for k in (-1, 0, 1)))))
    outer = lambda c: F.when(~F.col("inside"), F.col(c))
    ends = written(each.groupBy("a", "class").agg(F.min("low").alias("least"), F.max("high").alias("most"), F.min(outer("low")).alias("least_outside"), F.max(outer("high")).alias("most_outside")), "ends")
    least, most = (F.when(F.col("inside"), F.col(f"{c}_outside")).otherwise(F.col(c)) for c in ("least", "most"))
    kept = found.join(ends, ["a", "class"]).filter((F.col("low") <= most + 1e-6) & (F.col("high") >= least - 1e-6))
    return written(kept.select("a", "b", "n", "component", "inside"), "able"), met.filter(_linked(percent) & (F.col("a") != F.col("b"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _in_blocks(members: DataFrame) -> DataFrame:
    """members(a, b, n, component, inside) to a row for each pair of blocks (i, j) in which a member is compared: blocks of the largest component meet all others but not one another."""
    count = members.groupBy("a").agg(*(F.ceil(F.count(F.when(F.col("inside") == x, 1)) / BLOCK).cast("int").alias(c) for c, x in (("ins", True), ("outs", False)))).filter("outs > 0")
    first = lambda x: F.when(x, F.col("ins")).otherwise(0)
    block = F.pmod(F.xxhash64("b"), F.when(F.col("inside"), F.col("ins")).otherwise(F.col("outs"))).cast("int") + first(~F.col("inside"))
    other = F.explode(F.sequence(first(F.col("inside")), F.col("ins") + F.col("outs") - 1))
    placed = members.join(written(count, "counts"), "a").withColumn("block", block).withColumn("other", other)
    return placed.select("a", "b", "n", "component", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _components(entries: DataFrame, met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(id, component) of all sets with links, by the two passes."""
    share = percent / 100
    best = met.filter("a <> b").groupBy("b").agg(F.max(F.struct("shared", (-F.col("a")).alias("a"))).alias("best")).select((-F.col("best.a")).alias("a"), "b")
    edges = written(_confirmed(best, sets, percent), "links")
    part = connected_components(edges)

    place = F.coalesce("component", "id")
    labels = entries.select("id", "n").join(part, "id", "left").select(F.col("id").alias("b"), "n", place.alias("component"))
    members = met.select("a", "b").join(labels, "b")
    parts = members.groupBy("a", "component").agg(F.count("*").alias("c"), F.max(F.col("a") == F.col("b")).alias("own"))
    mixed = parts.groupBy("a").agg(F.sum("c").alias("m"), F.count("*").alias("parts"), F.max(F.struct("c", "component")).alias("most"), F.max(F.when(F.col("own"), F.col("component"))).alias("own")).filter("parts > 1")
    mixed = written(mixed.select("a", "m", "own", F.col("most.component").alias("main")), "mixed")
    members = written(members.join(mixed, "a"), "members")
    placed = members.filter(F.col("m") <= BLOCK).select("a", "b", "n", "component", *(F.lit(0).alias(c) for c in ("block", "i", "j")))
    if (mixed.agg(F.max("m")).first()[0] or 0) > BLOCK:
        large, links = able(members.filter(F.col("m") > BLOCK), sets, percent)
        edges, placed = edges.unionByName(links), placed.unionByName(_in_blocks(large))
    payload = met.groupBy("b").agg(F.sort_array(F.collect_list("a")).alias("pivots")).join(sets.select(F.col("id").alias("b"), "wide"), "b")
    spread = placed.join(payload, "b").select(F.col("a").alias("pivot"), "i", "j", "block", F.col("b").alias("id"), "component", "n", "wide", "pivots")
    run, ddl = _second_pass(share)
    spread = spread.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col("pivot"), F.col("i"), F.col("j")).sortWithinPartitions("pivot", "i", "j")
    more = written(spread.mapInArrow(run, ddl), "pairs")
    edges = edges.unionByName(_confirmed(more, sets, percent))
    return connected_components(edges)


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, lower: bool = True) -> DataFrame:
    """docs(doc_id, text, ...) to one row per document: doc_id, n_shingles, component_id, kept.

    Two documents are linked if 100 * |A and B| >= percent * |A or B| for their sets of distinct shingles of `words` words (A-Z lower-cased if `lower`);
    component_id is the smallest doc_id that links reach, kept says that it is the document's own.
    A null, empty or blank text has no shingles and no links. Rows with a null doc_id are returned with component_id null and kept true.
    Repeated rows of one doc_id are one document and come back as often as given; if their texts differ, links are confirmed on the smallest text of a doc_id.
    Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    run, ddl = _sketches(words, lower)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketches = written(own.mapInArrow(run, ddl), "sketches")
    usable = sketches.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    sig = ["sig_a", "sig_b", "n_shingles"]
    classes = usable.groupBy(*sig).agg(F.min(F.struct("doc_id", "low")).alias("first")).select(*sig, F.col("first.doc_id").alias("id"), F.col("first.low").alias("low"))
    classes = written(classes, "classes")

    retained = classes.select("id", F.explode("low").alias("value"))
    common = retained.groupBy("value").agg(F.count("*").alias("c")).filter("c > 1")
    listed = retained.join(common, "value").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("c", "value"))).alias("values"), F.sum("c").alias("weight"))
    size = F.least(F.lit(LOW), F.col("n"))
    room = (size - F.floor(size / 3) + 1 - (size - F.size("values"))).cast("int")  # values in no other set are the rarest and take their places first
    entries = listed.join(classes.select("id", F.col("n_shingles").alias("n")), "id").withColumn("room", room).filter("room > 0").select("id", "n", "weight", F.expr("transform(slice(values, 1, room), x -> x.value)").alias("prefix"))
    entries = written(entries, "entries")

    rows = entries.select("id", "weight", F.explode("prefix").alias("value"))
    pivots = rows.groupBy("value").agg(F.count("*").alias("members"), F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("p")).filter("members > 1").select("value", (-F.col("p.id")).alias("a"))
    met = rows.join(written(pivots, "pivots"), "value").groupBy("a", F.col("id").alias("b")).agg(F.count("*").alias("shared"))
    met = written(met, "met")
    involved = written(met.select(F.col("b").alias("doc_id")).distinct(), "involved")
    run, ddl = _full_sets(words, lower)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = own.mapInArrow(_needed(_marked(involved)), "doc_id long, text string").repartition(buckets, "doc_id")
    texts = texts.join(involved, "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    sets, table_name = _bucketed(texts.mapInArrow(run, ddl), buckets)
    try:
        part = _components(entries, met, sets, percent)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table_name}")  # its rows are not needed any more

    named = classes.join(part, "id", "left").select(*sig, F.coalesce("component", "id").alias("component_id"))
    full = usable.drop("low").join(named, sig).select("doc_id", "n_shingles", "component_id")
    rest = sketches.filter("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return full.unionByName(rest).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
