"""N-gram Jaccard join by PartEnum signatures.

Sets of similar size share a band; the hamming distance of two sufficiently similar sets of a
band (or of neighbouring bands) is bounded. The feature domain is cut into first-level and
second-level partitions, and a set gets one signature per first-level partition and subset of its
second-level partitions, so that similar sets share at least one. Candidates are verified exactly.

Features that many texts share (a line found everywhere) would join unlike sets whose partitions
hold little else. They are left out of the first signatures, which stays exact, as leaving out
features never adds to a distance; sets with too little left get signatures of all features.

Defined cases: a null or empty text (or one of white space) has an empty set and no links; a text
of fewer words than the shingle size is one feature; rows that repeat a `doc_id` are one node of
the link graph, but those without words keep their own id as component; `n_links` counts rows; rows without `doc_id` get a null component; further columns are ignored; an empty
table gives no rows.
"""

import math
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlake.session import cut

from . import hashing, lookup, sketches
from .components import components
from .held import trimmed

BLOCK_FEATURES = 200_000
"""Features of one block of a verified cluster; every set counts as `LEAST_FEATURES` at least."""
LEAST_FEATURES = 200
_SEED = np.uint64(0x5851F42D4C957F2D)


COMMON = 1 / 2000
"""Features in more than this share of the texts are common. There are at most as many as an
average text has features, divided by this share, whatever the number of texts."""
MOST_COPIES = 1_000_000
"""Ids that are sent to all tasks (8 MB), to leave out copies or to choose a cluster's texts."""
MOST_MEMBERS = 10_000
"""Members of a bucket that are compared by their sketches; a larger one is one group."""
COUNTED = 2_000_000
"""Features that a task counts at a time to find common ones."""
ROUNDS = 6
RARE = 0.1
"""The share of sets that may have more empty subsets than tolerated, in each round."""


@lru_cache(maxsize=None)
def scheme(low: int, distance: int) -> tuple[int, int, int, int]:
    """First-level partitions, second-level ones, the subset's size, and the tolerated empty ones.

    Of `n1` first-level partitions, more than `spare` differ in at most `k2` features when the
    sets differ in at most `distance`; there some `n2 - k2` second-level partitions are equal. The
    scheme with the fewest signatures is taken under which a set of `low` features seldom has more
    than `spare` partitions with an empty subset.
    """
    best = None
    for k2 in range(min(distance, 6) + 1):
        need = -(-(distance + 1) // (k2 + 1))
        for size in range(1, 6 if k2 else 2):
            n2 = k2 + size
            subsets = math.comb(n2, k2)
            for spare in range(max(40, need // 8)):
                n1 = need + spare
                if best is not None and n1 * subsets >= best[0]:
                    break
                mean = n1 * min(1.0, subsets * (1 - size / (n1 * n2)) ** low)
                if _tail(mean, spare) <= RARE:
                    best = (n1 * subsets, n1, n2, size, spare)
                    break
    if best is None:
        return distance + 1, 1, 1, 0
    return best[1:]


def _tail(mean: float, spare: int) -> float:
    """An upper bound of the chance that more than `spare` of rare events with this mean occur."""
    if mean >= spare + 1:
        return 1.0
    term = math.exp(-mean + (spare + 1) * math.log(max(mean, 1e-300)) - math.lgamma(spare + 2))
    return term / (1 - mean / (spare + 2))


def bands(longest: int, percent: int) -> np.ndarray:
    """Lower ends of the size bands up to `longest`; the next band begins past low / similarity."""
    lows = [1]
    while lows[-1] <= longest:
        lows.append(lows[-1] * 100 // percent + 1)
    return np.array(lows)


def signatures(sets: list[np.ndarray], percent: int, common=None) -> list[np.ndarray]:
    """The signatures of each set, in its own band and in the next one.

    `common` has the sorted common features; it must be the same for all sets.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    if not sizes.any():
        return [np.zeros(0, np.uint64)] * len(sets)
    rare = sets
    if common is not None and len(common):
        flat = np.concatenate(sets)
        near = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        owner = np.repeat(np.arange(len(sets)), sizes)[common[near] != flat]
        flat = flat[common[near] != flat]
        rare = np.split(flat, np.cumsum(np.bincount(owner, minlength=len(sets)))[:-1])
    lows = bands(int(sizes.max()) * 2, percent)
    own = np.searchsorted(lows, sizes, "right") - 1
    found = [[] for _ in sets]
    for band in np.unique(np.concatenate([own[sizes > 0], own[sizes > 0] + 1])).tolist():
        members = np.flatnonzero((sizes > 0) & ((own == band) | (own == band - 1)))
        high = int(lows[band]) * 100 // percent
        distance = 2 * high * (100 - percent) // (100 + percent)
        low = int(lows[max(band - 1, 0)])
        some = [(rare[i], sets[i]) for i in members]
        for i, signature in zip(
            members.tolist(), _band_signatures(some, band, low, distance), strict=True
        ):
            found[i].append(signature)
    return [np.concatenate(f) if f else np.zeros(0, np.uint64) for f in found]


def _band_signatures(pairs, band, low, distance, turn=0):
    """Signatures of (rare features, all features) pairs; the first turn takes the rare ones."""
    n1, n2, size, spare = scheme(low, distance)
    sets = [pair[min(turn, 1)] for pair in pairs]
    counts = np.array([len(s) for s in sets])
    features = hashing.mix(np.concatenate(sets) ^ hashing.mix(np.array([turn], np.uint64) + _SEED))
    cells = n1 * n2
    cell = (features >> np.uint64(33)) % np.uint64(cells)
    place = np.repeat(np.arange(len(sets)) * cells, counts) + cell.astype(np.int64)
    sums = np.zeros(len(sets) * cells, np.uint64)
    np.add.at(sums, place, hashing.mix(features))
    filled = np.bincount(place, minlength=len(sums)).reshape(-1, n1, n2)
    sums = sums.reshape(-1, n1, n2)
    subsets = np.array(list(combinations(range(n2), size)))
    total = sums[:, :, subsets].sum(axis=3, dtype=np.uint64)
    empty = filled[:, :, subsets].sum(axis=3) == 0
    tag = np.arange(n1 * len(subsets), dtype=np.uint64).reshape(1, n1, -1)
    tag = tag + (np.uint64(band + 1) << np.uint64(40)) + (np.uint64(turn) << np.uint64(60))
    keys = hashing.mix(total + hashing.mix(tag))
    # A pair that shares only empty subsets has more than `spare` partitions with one in both
    # sets. Such sets meet again under other partitions, and at last by their empty subsets.
    special = empty.any(axis=2).sum(axis=1) > spare
    kept = ~empty
    if turn == ROUNDS - 1:
        kept |= special[:, None, None]
    found = [keys[i][kept[i]] for i in range(len(sets))]
    again = np.flatnonzero(special).tolist()
    if again and turn < ROUNDS - 1:
        more = _band_signatures([pairs[i] for i in again], band, low, distance, turn + 1)
        for i, extra in zip(again, more, strict=True):
            found[i] = np.concatenate([found[i], extra])
    return found


def _slices(batch, size=512):
    for start in range(0, batch.num_rows, size):
        yield batch.slice(start, size)


def _prints(shingle, sketched=False):
    """Rows (doc_id, n_shingles, high, low, and the sketch if `sketched`) per text; and, with -1
    for n_shingles, features that recur within some texts of a task, with their number."""

    def rows(ids, sizes, high, low, sets=None):
        columns = [ids, pa.array(sizes, pa.int64()), hashing.as_long(high), hashing.as_long(low)]
        names = ["doc_id", "n_shingles", "high", "low"]
        if sketched:
            names.append("sketch")
            columns.append(pa.nulls(len(sizes), pa.binary()) if sets is None else sketches.sketches(sets))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def recurring(sets):
        features, counts = np.unique(np.concatenate(sets), return_counts=True)
        often = counts >= max(3, COMMON * len(sets))
        number = int(often.sum())
        return rows(
            pa.nulls(number, pa.int64()), [-1] * number, features[often], counts[often].astype(np.uint64)
        )

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in _slices(batch):
                sets = hashing.shingle_sets(part.column(1), shingle)
                marks = [
                    (int(s.sum(dtype=np.uint64)), int(hashing.mix(s ^ hashing._ORDER[7]).sum()))
                    for s in sets
                ]
                high, low = (np.array([m[i] for m in marks], np.uint64) for i in (0, 1))
                yield rows(part.column(0), [len(s) for s in sets], high, low, sets)
                held += sets
                size += sum(map(len, sets))
                if size > COUNTED:
                    yield recurring(held)
                    held, size = [], 0
        if size:
            yield recurring(held)

    return run


def _common(marks: DataFrame) -> np.ndarray:
    """The sorted common features, by the tasks' counts over all texts."""
    texts = marks.where("n_shingles >= 0").count()
    found = (
        marks.where("n_shingles < 0")
        .groupBy("high")
        .agg(F.sum("low").alias("count"))
        .where(F.col("count") > max(COMMON * texts, 10))
        .select("high")
        .toArrow()
    )
    return np.sort(found["high"].to_numpy().view(np.uint64))


def _signed(shingle, percent, common):
    def run(batches):
        for batch in batches:
            for part in _slices(batch):
                sets = hashing.shingle_sets(part.column(1), shingle)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), hashing.long_lists(signatures(sets, percent, common))],
                    names=["doc_id", "signatures"],
                )

    return run


def _verified(shingle, percent):
    """Links within each run of rows of one (cluster, first block, second block)."""

    def group(key, rows):
        sets = hashing.shingle_sets(pa.array([r["text"] for r in rows], pa.large_string()), shingle)
        sizes = np.array([len(s) for s in sets])
        side = np.array([r["block"] == key[1] for r in rows])
        left = np.flatnonzero(side)
        right = left if key[1] == key[2] else np.flatnonzero(~side)
        if not len(left) or not len(right):
            return
        _, feature = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), sizes)
        used = np.bincount(feature)
        feature = (np.cumsum(used > 1) - 1)[feature] * (used > 1)[feature] - (used <= 1)[feature]
        owner, feature = owner[feature >= 0], feature[feature >= 0]
        order = np.argsort(feature, kind="stable")
        owner, feature = owner[order], feature[order]
        shared = np.zeros((len(left), len(right)), np.float32)
        row_of = np.full(len(sets), -1)
        for begin in range(0, int(feature[-1]) + 1 if len(feature) else 0, 4096):
            a, b = np.searchsorted(feature, [begin, begin + 4096])
            matrix = np.zeros((len(sets), 4096), np.float32)
            matrix[owner[a:b], feature[a:b] - begin] = 1
            shared += matrix[left] @ matrix[right].T
        row_of[left] = np.arange(len(left))
        union = sizes[left][:, None] + sizes[right][None, :] - shared
        links = 100 * shared >= percent * union
        ids = np.array([r["doc_id"] for r in rows], np.int64)
        links &= ids[left][:, None] != ids[right][None, :]
        weight = np.array([r["copies"] for r in rows], np.int64)
        number = np.zeros(len(sets), np.int64)
        number[left] += (links * weight[right][None, :]).sum(axis=1)
        if key[1] != key[2]:
            number[right] += (links * weight[left][:, None]).sum(axis=0)
        yield from _forest(ids, left, right, links, number)

    def _forest(ids, left, right, links, number):
        """Each linked document with the smallest one it reaches inside the block pair."""
        label = ids.copy()
        big = np.iinfo(np.int64).max
        while True:
            before = label.copy()
            lowest = np.where(links, label[right][None, :], big).min(axis=1)
            label[left] = np.minimum(label[left], lowest)
            lowest = np.where(links, label[left][:, None], big).min(axis=0)
            label[right] = np.minimum(label[right], lowest)
            if (label == before).all():
                break
        for i in np.flatnonzero(number).tolist():
            yield int(ids[i]), int(label[i]), int(number[i])

    def run(batches):
        key, rows = None, []
        columns = ["a", "b", "links"]

        def flush():
            if len(rows) > 1:
                found = list(group(key, rows))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, pa.int64()) for c in zip(*found, strict=True)], names=columns
                    )

        for batch in batches:
            for row in batch.to_pylist():
                now = (row["cluster"], row["first"], row["second"])
                if now != key:
                    yield from flush()
                    key, rows = now, []
                rows.append(row)
        yield from flush()

    return run


def links(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, n_links.

    Documents are linked when their shingle sets have a Jaccard similarity of `percent` / 100 or
    more; `component_id` is the smallest `doc_id` reachable, `n_links` the number of other
    rows linked directly. Equal sets are one class and take part once, by their smallest
    `doc_id`. Sketches part a bucket of equal signatures where none of its pairs can be similar,
    and a part names its smallest class; whatever the candidate graph connects is a cluster, and a
    cluster is verified in pairs of bounded blocks, so no bucket and no group of copies is
    expanded into pairs of rows.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    counted = cut(
        texts.mapInArrow(
            trimmed(_prints(shingle, True)),
            "doc_id long, n_shingles long, high long, low long, sketch binary",
        ),
        "marks",
    )
    marks = counted.where("n_shingles >= 0")
    usable = marks.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(
        usable.groupBy("n_shingles", "high", "low").agg(
            F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies")
        ),
        "classes",
    )
    members = classes.select(F.col("class_id").alias("doc_id")).distinct()
    signed = texts.mapInArrow(
        trimmed(_signed(shingle, percent, _common(counted))), "doc_id long, signatures array<long>"
    )
    buckets = _without_copies(signed, usable, members).select(
        "doc_id", F.explode("signatures").alias("signature")
    )
    ordered = Window.partitionBy("signature").orderBy("doc_id")
    shared = cut(
        buckets.withColumn(
            "leader",
            F.first("doc_id").over(ordered.rowsBetween(Window.unboundedPreceding, 0)),
        )
        .where("doc_id <> leader")
        .distinct(),
        "shared",
    )
    clusters = cut(components(_candidates(shared, usable, percent)), "clusters")
    found = cut(_verify(texts, classes, clusters, shingle, percent), "links")
    labels = components(found.where("a <> b").select("a", "b").union(_repeated(usable, classes)))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    classed = (
        classes.join(labels, classes["class_id"] == labels["node"], "left")
        .drop("node")
        .join(counts, F.col("class_id") == counts["node"], "left")
        .select(
            "n_shingles",
            "high",
            "low",
            F.coalesce("component", "class_id").alias("component_id"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    linked = usable.join(classed, ["n_shingles", "high", "low"])
    columns = ["doc_id", "n_shingles", "component_id", "n_links"]
    alone = marks.where("NOT (n_shingles > 0 AND doc_id IS NOT NULL)").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(0).alias("n_links")
    )
    return linked.select(columns).unionByName(alone)


def _repeated(usable, classes):
    """Links between the classes of each document that has rows of several sets."""
    key = ["n_shingles", "high", "low"]
    both = (
        usable.groupBy("doc_id")
        .agg(F.min(F.struct(*key)).alias("least"), F.max(F.struct(*key)).alias("most"))
        .where("least <> most")
        .select("doc_id")
    )
    nodes = usable.join(both, "doc_id").join(classes, key).select("doc_id", "class_id").distinct()
    least = nodes.groupBy("doc_id").agg(F.min("class_id").alias("b"))
    return nodes.join(least, "doc_id").where("class_id <> b").select(F.col("class_id").alias("a"), "b")


def _candidates(shared, usable, percent):
    """Edges (a, b) that connect all similar members of each bucket of two or more classes.

    `shared` has its members (signature, doc_id, leader) but for the smallest one, the leader. Of
    buckets with the same members one is taken. Texts that share little but a signature's few
    features would otherwise connect unlike families, ever more of them as the texts grow.
    """
    buckets = shared.groupBy("signature").agg(
        F.min("leader").alias("leader"),
        F.count(F.lit(1)).alias("members"),
        F.bit_xor(F.xxhash64("doc_id")).alias("x"),
        F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"),
    )
    same = ["leader", "members", "x", "y"]
    buckets = cut(buckets.groupBy(same).agg(F.min("signature").alias("signature")), "buckets")
    small = buckets.where(F.col("members") < MOST_MEMBERS)
    large = buckets.where(F.col("members") >= MOST_MEMBERS).select("signature")
    members = small.select("signature", F.col("leader").alias("doc_id")).union(
        shared.join(small.select("signature"), "signature", "left_semi").select("signature", "doc_id")
    )
    # A document with rows of several sets has no sketch.
    key = F.struct("n_shingles", "high", "low")
    described = (
        usable.join(members.select("doc_id").distinct(), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(
            F.min(key).alias("least"),
            F.max(key).alias("most"),
            F.first("sketch").alias("sketch"),
        )
        .select(
            "doc_id",
            F.col("least.n_shingles").alias("size"),
            F.when(F.col("least") == F.col("most"), F.col("sketch")).alias("sketch"),
        )
    )
    rows = (
        members.join(described, "doc_id")
        .select("signature", "doc_id", "size", "sketch")
        .repartition("signature")
        .sortWithinPartitions("signature")
    )
    near = rows.mapInArrow(trimmed(sketches.bucket_edges(percent)), "a long, b long")
    led = shared.join(large, "signature", "left_semi")
    return near.union(led.select(F.col("doc_id").alias("a"), F.col("leader").alias("b")))


def _without_copies(signed, usable, members):
    """The rows of the classes' smallest documents: few other ids, or else few ids of these, go to
    all tasks, so that the signatures are not shuffled for this; with more of both they are."""
    others = cut(usable.select("doc_id").distinct().join(members, "doc_id", "left_anti"), "copies")
    if others.count() <= MOST_COPIES:
        return signed.where("doc_id IS NOT NULL").join(F.broadcast(others), "doc_id", "left_anti")
    if members.count() <= MOST_COPIES:
        members = F.broadcast(members)
    return signed.join(members, "doc_id", "left_semi")


def _verify(texts, classes, clusters, shingle, percent):
    # Sets that can be linked are in the same band of sizes or in neighbouring ones.
    width = math.log(100 / percent) * (1 + 1e-9)
    member = classes.join(clusters, classes["class_id"] == clusters["node"]).select(
        F.col("component").alias("cluster"),
        F.floor(F.log("n_shingles") / width).alias("band"),
        "class_id",
        "copies",
        F.greatest("n_shingles", F.lit(LEAST_FEATURES)).alias("weight"),
    )
    bands = member.groupBy("cluster", "band").agg(
        F.ceil(F.sum("weight") / BLOCK_FEATURES).alias("blocks")
    )

    def block(band, number):
        return (F.col(band) * (1 << 40) + number).cast("long")

    numbers = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    left = bands.select("cluster", "band", numbers.alias("number")).select(
        "cluster",
        block("band", F.col("number")).alias("first"),
        F.explode(F.array("band", F.col("band") + 1)).alias("band2"),
    )
    right = bands.select(F.col("cluster").alias("cluster2"), "band", numbers.alias("number")).select(
        "cluster2", F.col("band").alias("other"), block("band", F.col("number")).alias("second")
    )
    pairs = left.join(
        right,
        (F.col("cluster") == F.col("cluster2"))
        & (F.col("band2") == F.col("other"))
        & (F.col("first") <= F.col("second")),
    ).select("cluster", "first", "second")
    sided = pairs.select("*", F.col("first").alias("block")).union(
        pairs.where("first < second").select("*", F.col("second").alias("block"))
    )
    placed = member.join(bands, ["cluster", "band"]).select(
        "cluster",
        "class_id",
        "copies",
        block("band", F.pmod(F.xxhash64("class_id"), F.col("blocks"))).alias("block"),
    )
    work = placed.join(sided, ["cluster", "block"]).select(
        F.col("class_id").alias("doc_id"), "cluster", "first", "second", "block", "copies"
    )
    if clusters.count() <= MOST_COPIES:
        # Few texts are in a cluster: only these move.
        chosen = F.broadcast(clusters.select(F.col("node").alias("doc_id")).distinct())
        texts = texts.join(chosen, "doc_id", "left_semi")
    rows = (
        texts.join(work, "doc_id")
        .repartition("cluster", "first", "second")
        .sortWithinPartitions("cluster", "first", "second")
    )
    return rows.mapInArrow(trimmed(_verified(shingle, percent)), "a long, b long, links long")


def keep_one(documents: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those linked to a smaller `doc_id`; rows without an id stay.

    Rows that repeat a `doc_id` are one document: they stay or go together.
    """
    linked = links(documents, shingle, percent)
    return lookup.without(documents, linked.where("doc_id <> component_id"))
