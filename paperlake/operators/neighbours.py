"""The nearest papers of many papers: the neighbour table of all, or lists of the asked ones.

Equal vectors are folded first, so that a group of copies is compared once, however large. The
distinct vectors lie in two-level cells (`cells`); crowded cells are cut into blocks of bounded
size, and the blocks of one coarse cell are joined into groups that one task can hold. A query is
sent to a group once, with the cells to be searched there; a task hands on `k` rows per query,
never the pairs.

`nprobe` searches so many nearest cells only: approximate, and linear in the data. `recall` finds
the number of cells itself: a bounded sample of queries (`PROBED`) is compared with all vectors, and
the ranks of the cells in which their neighbours lie tell how many cells hold that share of them.
Vectors without any clusters need many cells, and then a large share of all. Without both, lists are
exact: the nearest cell's vectors bound the angle worth looking at, and further cells are searched
unless the triangle inequality rules them out, the coarse ones first. In high dimensions that rules
out little; `nprobe` is the choice for large tables. Vectors that fit into one block are compared
without cells.

Only the training and probing samples, the coarse centroids and counts by coarse cell (all in the
order of the square root of the cells, or bounded) come to the driver.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paperlake import params
from paperlake.memory import trim
from paperlake.operators import cells, ivf, knn
from paperlake.schemas import SIMILAR
from paperlake.session import cut

MAX_BLOCK = 4096

# Queries and rows compared at a time, and pairs of them compared exactly at a time.
QUERY_ROWS = 512
PIECE_ROWS = 2048
EXACT_ROWS = 1 << 14

# Rows of queries handed on at a time, with their vectors.
SENT_ROWS = 4096

# Sampled queries that tell how many cells to search.
PROBED = 256

_HITS = "rep string, arxiv_id string, similarity double"
_HIT_SCHEMA = pa.schema(
    [("rep", pa.string()), ("arxiv_id", pa.string()), ("similarity", pa.float64())]
)
_GROUP = ["coarse", "group", "part"]


def _keyed(embeddings: DataFrame) -> DataFrame:
    """Rows with the key of their vector: 128 bits of two differently seeded hashes."""
    key = F.struct(
        F.xxhash64("embedding").alias("first"), F.xxhash64(F.lit(1), "embedding").alias("second")
    )
    return ivf.nonzero(embeddings).select("arxiv_id", "embedding", key.alias("vector_key"))


def _distinct_vectors(keyed: DataFrame) -> DataFrame:
    """One row per distinct vector, named after the smallest id that has it."""
    return keyed.groupBy("vector_key").agg(
        F.min("arxiv_id").alias("rep"), F.first("embedding").alias("embedding")
    )


def _best(query, ids, scores, k: int):
    """The `k` best hits of each query, best first, ties by id."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    kept = place < k
    return query[kept], ids[kept], scores[kept]


class _Best:
    """The `k` best hits so far of some queries: their scores, and their rows' places in id order."""

    def __init__(self, lowest: np.ndarray, k: int):
        self.k, self.lowest = k, lowest
        self.scores = np.full((len(lowest), k), -np.inf)
        self.places = np.zeros((len(lowest), k), np.int64)

    def add(self, query: np.ndarray, scores: np.ndarray, places: np.ndarray) -> None:
        seen = np.unique(query)
        old = self.scores[seen].ravel()
        there = np.isfinite(old)
        query = np.concatenate((np.repeat(seen, self.k)[there], query))
        scores = np.concatenate((old[there], scores))
        places = np.concatenate((self.places[seen].ravel()[there], places))
        query, places, scores = _best(query, places, scores, self.k)
        at = np.arange(len(query)) - np.searchsorted(query, query)
        self.scores[seen] = -np.inf
        self.scores[query, at], self.places[query, at] = scores, places
        self.lowest[seen] = np.maximum(self.lowest[seen], self.scores[seen, -1])

    def hits(self):
        """(query, place, score), best first."""
        query, at = np.nonzero(np.isfinite(self.scores))
        return query, self.places[query, at], self.scores[query, at]


def _slices(first: int, last: int) -> list[slice]:
    """Rows from `first` to `last`, `PIECE_ROWS` at a time."""
    return [slice(i, min(i + PIECE_ROWS, last)) for i in range(first, last, PIECE_ROWS)]


class _Rows:
    """A group's vectors, cell by cell, in pieces of at most `max_block` rows.

    Beside the vectors as given, their lengths and the unit vectors in single precision are kept; those
    in double precision are made for the rows that are asked for.
    """

    def __init__(self, table: pa.Table, max_block: int):
        table = table.sort_by([("fine", "ascending"), ("other", "ascending")])
        self.names = table["other"].combine_chunks()
        self.place = np.empty(table.num_rows, np.int64)
        self.by_place = pc.sort_indices(self.names)
        self.place[self.by_place.to_numpy()] = np.arange(table.num_rows)
        flat = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        self.given = flat.reshape(table.num_rows, -1)
        self.lengths = np.empty(table.num_rows)
        self.rough = np.empty(self.given.shape, np.float32)
        for rows in _slices(0, table.num_rows):
            norms = np.linalg.norm(self.given[rows].astype(np.float64), axis=1)
            self.lengths[rows] = np.where(norms == 0, np.nan, norms)
            self.rough[rows] = self.units(rows)
        # Products of single precision are off by less than half of this, the rounding included.
        self.slack = 1.2e-7 * (self.given.shape[1] + 4)
        self.cells, starts = np.unique(table["fine"].to_numpy(), return_index=True)
        self.starts = np.append(starts, table.num_rows)
        # Runs of whole small cells, and pieces of large ones: (first row, last, first cell, last).
        self.pieces = []
        most, cell = min(max_block, PIECE_ROWS), 0
        while cell < len(self.cells):
            first = self.starts[cell]
            last = np.searchsorted(self.starts, first + PIECE_ROWS, "right") - 1
            last = min(max(last, cell + 1), len(self.cells))
            if last == cell + 1:
                for start in range(first, self.starts[last], most):
                    end = min(start + most, self.starts[last])
                    self.pieces.append((start, end, cell, last))
            else:
                self.pieces.append((first, self.starts[last], cell, last))
            cell = last

    def units(self, rows) -> np.ndarray:
        """The unit vectors of some rows, in double precision."""
        return self.given[rows].astype(np.float64) / self.lengths[rows, None]

    def listed(self, lists: pa.Array) -> np.ndarray:
        """Which cells the queries' lists name."""
        visited = lists.flatten().to_numpy(zero_copy_only=False)
        visitor = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        cell = np.minimum(np.searchsorted(self.cells, visited), len(self.cells) - 1)
        here = self.cells[cell] == visited
        visit = np.zeros((len(lists), len(self.cells)), bool)
        visit[visitor[here], cell[here]] = True
        return visit

    def bounds(self) -> tuple[np.ndarray, np.ndarray]:
        """A direction for each cell, and the largest angle of its vectors here with it."""
        centres = np.empty((len(self.cells), self.given.shape[1]))
        angles = np.empty(len(self.cells))
        for cell, (first, last) in enumerate(zip(self.starts[:-1], self.starts[1:], strict=True)):
            total = sum(self.units(rows).sum(axis=0) for rows in _slices(first, last))
            if not total.any():
                total = self.units(slice(first, first + 1))[0]
            centres[cell] = total / np.linalg.norm(total)
            cosine = min((self.units(rows) @ centres[cell]).min() for rows in _slices(first, last))
            angles[cell] = np.arccos(np.clip(cosine, -1, 1))
        return centres, angles

    def search(self, queries: np.ndarray, visit: np.ndarray, best: _Best) -> None:
        """Puts the rows of the visited cells into `best`."""
        sizes = np.diff(self.starts)
        for first, last, cell, end in self.pieces:
            some = visit[:, cell:end]
            who = np.flatnonzero(some.any(axis=1))
            rows = slice(first, last)
            if end == cell + 1:
                self._compare(queries, who, rows, None, best)
            elif 4 * (some[who] @ sizes[cell:end]).sum() >= len(who) * (last - first):
                shown = np.repeat(some[who], sizes[cell:end], axis=1)
                self._compare(queries, who, rows, shown, best)
            else:
                for c in range(cell, end):
                    rows = slice(self.starts[c], self.starts[c + 1])
                    self._compare(queries, np.flatnonzero(visit[:, c]), rows, None, best)

    def _compare(self, queries, who, rows: slice, shown, best: _Best) -> None:
        """Rows that single precision does not rule out are compared exactly."""
        if not len(who):
            return
        scores = queries[who].astype(np.float32) @ self.rough[rows].T
        if shown is not None:
            scores[~shown] = -np.inf
        least = best.lowest[who]
        if scores.shape[1] > best.k and np.isneginf(least).any():
            place = scores.shape[1] - best.k
            least = np.maximum(least, np.partition(scores, place, axis=1)[:, place])
        query, row = np.nonzero((scores >= least[:, None] - self.slack) & (scores > -np.inf))
        for start in range(0, len(query), EXACT_ROWS):
            asking = who[query[start : start + EXACT_ROWS]]
            found = rows.start + row[start : start + EXACT_ROWS]
            exact = np.einsum("ij,ij->i", queries[asking], self.units(found))
            best.add(asking, np.round(exact, knn.DIGITS), self.place[found])


def _compared(k: int, max_block: int):
    """Compares the queries of a group with its vectors, cell by cell.

    Queries (rep, embedding, fines, floor) name the cells they search; without `fines` they search
    all that can hold a similarity not below `floor`. Each query keeps its `k` best rows while the
    cells pass, so that a task holds one set of hits, however many cells there are.
    """

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _HIT_SCHEMA.empty_table()
        rows = _Rows(right, max_block)
        bounds = None
        found = []
        for start in range(0, left.num_rows, QUERY_ROWS):
            some = left.slice(start, QUERY_ROWS)
            queries = knn.unit_rows(knn.matrix(some["embedding"].combine_chunks()))
            lists = some["fines"].combine_chunks()
            floor = some["floor"].fill_null(-1.0).to_numpy()
            if lists.null_count:
                bounds = bounds or rows.bounds()
                angles = np.arccos(np.clip(queries @ bounds[0].T, -1, 1))
                reach = np.arccos(np.clip(floor, -1, 1)) + 2 * cells.ANGLE_SLACK
                visit = angles - bounds[1] <= reach[:, None]
            else:
                visit = rows.listed(lists)
            # A floor was rounded, and is lowered by that.
            lowest = np.where(floor > -1, floor - 2 * 10.0**-knn.DIGITS, -np.inf)
            best = _Best(lowest, k)
            rows.search(queries, visit, best)
            query, place, score = best.hits()
            found.append(
                pa.table(
                    [
                        some["rep"].take(pa.array(query)),
                        rows.names.take(rows.by_place.take(pa.array(place))),
                        pa.array(score),
                    ],
                    schema=_HIT_SCHEMA,
                )
            )
        return pa.concat_tables(found)

    def trimmed(left: pa.Table, right: pa.Table) -> pa.Table:
        found = compare(left, right)
        trim()
        return found

    return trimmed


def _top(hits: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("rep").orderBy(*knn.best_first()))
    return hits.withColumn("place", place).where(F.col("place") <= k).drop("place")


def _grouped(found: cells.Cells, max_block: int) -> tuple[DataFrame, DataFrame]:
    """The vectors with their group, and the cells with the groups their blocks are in."""
    filled = found.fine.where("rows > 0")
    blocks = filled.withColumn("blocks", F.ceil(F.col("rows") / max_block).cast("int"))
    each = blocks.select(
        "coarse", "fine", (F.col("rows") / F.col("blocks")).alias("size"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"),
    )
    # One row per block of a coarse cell: its share of all blocks is about a square root.
    before = Window.partitionBy("coarse").orderBy("fine", "block")
    most = max(cells.rows_per_task(found.dim), max_block)
    each = each.withColumn(
        "group", F.floor((F.sum("size").over(before) - F.col("size")) / most).cast("int")
    )
    groups = each.groupBy("coarse", "fine").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("block", "group"))), lambda x: x["group"]
        ).alias("groups")
    )
    targets = cut(filled.join(groups, ["coarse", "fine"]), "targets")
    rows = found.rows.join(targets.select("coarse", "fine", "groups"), ["coarse", "fine"])
    number = cells.share("rep", F.size("groups"))
    rows = rows.withColumn("group", F.element_at("groups", number + 1)).drop("groups", "angle")
    return rows, targets


def _to_coarse(queries: DataFrame, found: cells.Cells, first: int) -> DataFrame:
    """(rep, embedding, coarse): the `first` nearest coarse cells of each query."""
    centroids, radius = found.centroids, found.radius

    def visits(rows, batch):
        angles = np.arccos(np.clip(rows @ centroids.T, -1, 1))
        angles[:, radius < 0] = np.inf
        ranked = np.argsort(angles, axis=1, kind="stable")
        visit = np.zeros(angles.shape, bool)
        np.put_along_axis(visit, ranked[:, :first], True, axis=1)
        return visit & np.isfinite(angles)

    return _sent(queries, visits, ["rep", "embedding"])


def _within_reach(queries: DataFrame, found: cells.Cells) -> DataFrame:
    """(rep, embedding, floor, coarse): the coarse cells that can hold a similarity not below a
    query's `floor`."""
    centroids, radius = found.centroids, found.radius

    def visits(rows, batch):
        floor = batch.column("floor").fill_null(-1.0).to_numpy(zero_copy_only=False)
        reach = np.arccos(np.clip(floor, -1, 1)) + 2 * cells.ANGLE_SLACK
        angles = np.arccos(np.clip(rows @ centroids.T, -1, 1))
        return (angles - radius <= reach[:, None]) & (radius >= 0)

    return _sent(queries, visits, ["rep", "embedding", "floor"])


def _sent(queries: DataFrame, visits, names: list[str]) -> DataFrame:
    """A row for each query and coarse cell that `visits` gives it."""

    def send(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, QUERY_ROWS):
                some = batch.slice(start, QUERY_ROWS)
                rows = knn.unit_rows(knn.matrix(some.column("embedding")))
                who, cell = np.nonzero(visits(rows, some))
                for at in range(0, len(who), SENT_ROWS):
                    part = pa.array(who[at : at + SENT_ROWS])
                    columns = [some.column(name).take(part) for name in names]
                    coarse = pa.array(cell[at : at + SENT_ROWS].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([*columns, coarse], names=[*names, "coarse"])

    types = {"rep": "string", "embedding": "array<float>", "floor": "double"}
    shape = ", ".join(f"{name} {types[name]}" for name in names)
    return queries.select(names).mapInArrow(send, f"{shape}, coarse int")


def _by_coarse(rows: DataFrame, found: cells.Cells, value) -> np.ndarray:
    """An aggregate for each coarse cell, at least one."""
    values = np.ones(len(found.centroids))
    for row in rows.groupBy("coarse").agg(value.alias("value")).collect():
        values[row.coarse] = max(row.value, 1)
    return values


def _parts(sent: DataFrame, found: cells.Cells):
    """In how many parts the queries sent to a coarse cell are compared there."""
    visits = _by_coarse(sent, found, F.count("*"))
    return cells.by_cell(np.ceil(visits / cells.rows_per_task(found.dim))).cast("int")


def _routes(queries: DataFrame, found: cells.Cells, targets: DataFrame, nprobe) -> DataFrame:
    """(rep, coarse, group, fines): the cells to be searched for each query, the nearest ones by
    `nprobe` (coarse cells, fine cells)."""
    sent = _to_coarse(queries, found, nprobe[0])
    number = _parts(sent, found)
    left = sent.withColumn("part", cells.share("rep", number))
    right = targets.withColumn("part", F.explode(F.sequence(F.lit(0), number - 1)))
    schema = pa.schema(
        [("rep", pa.string()), ("coarse", pa.int32()), ("fine", pa.int32()), ("angle", pa.float64())]
    )

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        chosen = [schema.empty_table()]
        for start in range(0, left.num_rows if right.num_rows else 0, QUERY_ROWS):
            some = left.slice(start, QUERY_ROWS)
            angles, sorted_right = cells._fine_angles(some, right)
            fine = sorted_right["fine"].to_numpy()
            ranked = np.argsort(angles, axis=1, kind="stable")[:, : nprobe[1]]
            who = np.repeat(np.arange(some.num_rows), ranked.shape[1])
            cell = ranked.ravel()
            chosen.append(
                pa.table(
                    [
                        some["rep"].take(pa.array(who)), some["coarse"].take(pa.array(who)),
                        pa.array(fine[cell].astype(np.int32)), pa.array(angles[who, cell]),
                    ],
                    schema=schema,
                )
            )
        return pa.concat_tables(chosen)

    right = right.withColumnsRenamed({"coarse": "their_coarse", "part": "their_part"})
    chosen = left.groupBy("coarse", "part").cogroup(
        right.groupBy("their_coarse", "their_part")
    ).applyInArrow(
        near, "rep string, coarse int, fine int, angle double"
    )
    place = F.row_number().over(Window.partitionBy("rep").orderBy("angle", "coarse", "fine"))
    chosen = chosen.withColumn("place", place).where(F.col("place") <= nprobe[1]).drop("place")
    groups = targets.select("coarse", "fine", F.explode(F.array_distinct("groups")).alias("group"))
    return chosen.join(groups, ["coarse", "fine"]).groupBy("rep", "coarse", "group").agg(
        F.collect_list("fine").alias("fines")
    )


def _all_in_reach(
    queries: DataFrame, found: cells.Cells, rows: DataFrame, targets: DataFrame, k: int, max_block
) -> DataFrame:
    """Hits in all cells that can hold a similarity not below the query's `floor`. Which fine cells
    these are is seen where the group is compared."""
    sent = _within_reach(queries, found)
    number = _parts(sent, found)
    last = targets.select("coarse", F.explode("groups").alias("group"))
    groups = cells.by_cell(_by_coarse(last, found, F.max("group") + 1)).cast("int")
    left = sent.withColumn("part", cells.share("rep", number)).withColumns(
        {
            "fines": F.lit(None).cast("array<int>"),
            "group": F.explode(F.sequence(F.lit(0), groups - 1)),
        }
    )
    right = rows.withColumn("part", F.explode(F.sequence(F.lit(0), number - 1)))
    return _hits(left, right, k, max_block)


def _searched(routes: DataFrame, queries: DataFrame, rows: DataFrame, dim: int, k: int, max_block):
    """Hits of the routed queries. Queries of a crowded group are cut into parts."""
    routes = cut(routes, "routes")
    most = cells.rows_per_task(dim)
    visits = routes.groupBy("coarse", "group").agg(F.count("*").alias("visits"))
    parts = cut(
        visits.select("coarse", "group", F.ceil(F.col("visits") / most).cast("int").alias("parts")),
        "parts",
    )
    left = routes.join(parts, ["coarse", "group"]).join(queries.select("rep", "embedding"), "rep")
    left = left.withColumn("part", cells.share("rep", F.col("parts")))
    right = rows.join(parts, ["coarse", "group"]).withColumn(
        "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    )
    return _hits(left, right, k, max_block)


def _hits(left: DataFrame, right: DataFrame, k: int, max_block: int) -> DataFrame:
    """The queries' hits, group by group. The sides may come from one table: names differ."""
    floor = F.col("floor") if "floor" in left.columns else F.lit(None).cast("double")
    left = left.select("rep", "embedding", "fines", floor.alias("floor"), *_GROUP)
    theirs = [F.col(c).alias(f"their_{c}") for c in _GROUP]
    right = right.select(
        F.col("rep").alias("other"), F.col("embedding").alias("vector"), "fine", *theirs
    )
    both = left.groupBy(_GROUP).cogroup(right.groupBy(*(f"their_{c}" for c in _GROUP)))
    return both.applyInArrow(_compared(k, max_block), _HITS)


def _in_one_block(queries: DataFrame, vectors: DataFrame, k: int, max_block: int) -> DataFrame:
    """All vectors are one block, which goes to each part of the queries."""
    dim = vectors.select(F.size("embedding")).first()[0]
    parts = -(-queries.count() // cells.rows_per_task(dim))
    one = {"fine": F.lit(0), "coarse": F.lit(0), "group": F.lit(0)}
    left = queries.withColumns(
        {"fines": F.array(F.lit(0)), **one, "part": cells.share("rep", F.lit(max(parts, 1)))}
    )
    number = F.explode(F.sequence(F.lit(0), F.lit(max(parts, 1) - 1)))
    return _hits(left, vectors.withColumns(one).withColumn("part", number), k, max_block)


def probes(found: cells.Cells, k: int, recall: float) -> tuple[int, int]:
    """How many coarse and fine cells hold the share `recall` of the `k` nearest vectors."""
    order = F.xxhash64(F.lit("probed"), "rep")
    sample = found.rows.select("rep", "embedding").orderBy(order, "rep").limit(PROBED).toArrow()
    queries = knn.matrix(sample["embedding"].combine_chunks())
    units, names = knn.unit_rows(queries), sample["rep"].to_pylist()
    rows = found.rows.withColumnRenamed("rep", "arxiv_id")
    hits = knn.scan(rows.select("arxiv_id", "embedding"), queries, k, names)
    hits = hits.join(rows.select("arxiv_id", "coarse", "fine"), "arxiv_id")

    def angles(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found = np.arccos(np.clip(knn.matrix(batch.column("centroid")) @ units.T, -1, 1))
            cell = np.repeat(np.arange(batch.num_rows), len(units))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.tile(np.arange(len(units), dtype=np.int32), batch.num_rows)),
                    batch.column("coarse").take(pa.array(cell)),
                    batch.column("fine").take(pa.array(cell)),
                    pa.array(found.ravel()),
                ],
                names=["query", "coarse", "fine", "angle"],
            )

    filled = found.fine.where("rows > 0").select("coarse", "fine", "centroid")
    ranks = filled.mapInArrow(angles, "query int, coarse int, fine int, angle double")
    by_angle = Window.partitionBy("query").orderBy("angle", "coarse", "fine")
    ranks = ranks.withColumn("place", F.row_number().over(by_angle)).drop("angle")
    rows = hits.join(ranks, ["query", "coarse", "fine"]).select("query", "coarse", "place").toArrow()
    if not rows.num_rows:
        return len(found.centroids), 1
    away = np.arccos(np.clip(units @ found.centroids.T, -1, 1))
    away[:, found.radius < 0] = np.inf
    coarse_place = np.argsort(np.argsort(away, axis=1, kind="stable"), axis=1) + 1
    coarse = coarse_place[rows["query"].to_numpy(), rows["coarse"].to_numpy()]
    # Half of what may be missed is missed by the coarse cells.
    first = int(np.quantile(coarse, (1 + recall) / 2, method="higher"))
    fine = np.where(coarse <= first, rows["place"].to_numpy(), np.iinfo(np.int64).max)
    return first, int(np.quantile(fine, recall, method="higher"))


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int, max_block: int = MAX_BLOCK, nprobe=None,
    seed: int = 7, recall=None,
) -> DataFrame:
    """Top `k` vectors of every query (rep, arxiv_id, similarity), the query's own among them.

    `queries` and `vectors` are tables (rep, embedding) without zero vectors.
    """
    count = vectors.count()
    if not count:
        return vectors.select("rep", F.col("rep").alias("arxiv_id"), F.lit(0.0).alias("similarity"))
    if count <= max_block:
        return _in_one_block(queries, vectors, k, max_block)
    found = cells.build(vectors, count, -(-2 * count // max_block), seed)
    rows, targets = _grouped(found, max_block)

    def searched(routes, asked):
        return _searched(routes, asked, rows, found.dim, k, max_block)

    if recall is not None:
        chosen = probes(found, k, recall)
        return _top(searched(_routes(queries, found, targets, chosen), queries), k)
    if nprobe is not None:
        chosen = int(np.ceil(nprobe**0.5)) + 2, nprobe
        return _top(searched(_routes(queries, found, targets, chosen), queries), k)
    first = _routes(queries, found, targets, (1, 1))
    hits = _top(searched(first, queries), k)
    # The k-th similarity is a floor; with fewer neighbours there is none yet.
    floor = hits.groupBy("rep").agg(
        F.when(F.count("*") == k, F.greatest(F.min("similarity"), F.lit(-1.0))).alias("floor")
    )
    bounded = cut(queries.join(floor, "rep", "left"), "bounded")
    return _top(_all_in_reach(bounded, found, rows, targets, k, max_block), k)


def lists(
    queries: DataFrame, embeddings: DataFrame, limit=None, max_block: int = MAX_BLOCK,
    nprobe=None, seed: int = 7, recall=None,
) -> DataFrame:
    """The nearest papers of `embeddings` for each paper of `queries`, itself excluded:
    (arxiv_id, similar_id, similarity, rank). Both are tables (arxiv_id, embedding).

    Zero vectors have no direction: they get no neighbours and are nobody's.
    """
    k = params.positive(limit, params.SIMILAR_LIMIT)
    members, asking = _keyed(embeddings), _keyed(queries)
    vectors = cut(_distinct_vectors(members), "vectors")
    same = queries is embeddings
    asked = vectors if same else cut(_distinct_vectors(asking), "queries")

    # The first k+1 ids of a vector are enough for every list it can appear in.
    by_id = Window.partitionBy("vector_key").orderBy("arxiv_id")
    first_ids = members.select("vector_key", "arxiv_id").withColumn(
        "n", F.row_number().over(by_id)
    )
    names = vectors.select("vector_key", F.col("rep").alias("other"))
    first_ids = first_ids.where(F.col("n") <= k + 1).join(names, "vector_key")

    pair = ["rep", "embedding"]
    near = nearest(asked.select(pair), vectors.select(pair), k + 1, max_block, nprobe, seed, recall)
    candidates = near.select("rep", F.col("arxiv_id").alias("other"), "similarity").join(
        first_ids.select("other", "arxiv_id"), "other"
    )
    # One list of k+1 ids serves all copies: each drops itself from it.
    hit = F.struct((-F.col("similarity")).alias("distance"), F.col("arxiv_id"))
    ranked = _top(candidates.drop("other"), k + 1).groupBy("rep").agg(
        F.sort_array(F.collect_list(hit)).alias("ids")
    )
    ranked = ranked.join(asked.select("vector_key", "rep"), "rep")
    # Adaptive execution splits the members of a large group of copies.
    rows = asking.select("vector_key", "arxiv_id").join(ranked.drop("rep"), "vector_key").select(
        "arxiv_id",
        F.posexplode(
            F.slice(F.filter("ids", lambda x: x["arxiv_id"] != F.col("arxiv_id")), 1, k)
        ).alias("place", "hit"),
    )
    return rows.select(
        "arxiv_id",
        F.col("hit.arxiv_id").alias("similar_id"),
        (-F.col("hit.distance")).alias("similarity"),
        (F.col("place") + 1).cast("int").alias("rank"),
    ).to(SIMILAR)


def build(
    embeddings: DataFrame, limit=None, max_block: int = MAX_BLOCK, nprobe=None, seed: int = 7,
    recall=None,
) -> DataFrame:
    """The neighbour table (arxiv_id, similar_id, similarity, rank) of every paper."""
    return lists(embeddings, embeddings, limit, max_block, nprobe, seed, recall)
