"""Full-text search: a scan form, an index form, and many queries at once."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake import params
from paperlake.functions import analysis
from paperlake.functions.rank import rank, rank_positions
from paperlake.functions.stemming import common_start
from paperlake.functions.text import searchable_text
from paperlake.schemas import POSTINGS, SEARCH_COLS
from paperlake.session import cut, shuffles_dropped

TERM_BUCKETS = 256

# Bits of the map that names the wanted keys to all tasks, in a million rows at most.
MARKS = 1 << 26

# Tokens that a task groups at a time.
SLICE_TOKENS = 1 << 18


def best_first(key: str = "rank") -> list[Column]:
    """Order by score, ties by id, so that results are deterministic."""
    return [F.col(key).desc(), F.col("arxiv_id").asc()]


def _check_query(query: str) -> None:
    if not query:
        raise ValueError("missing query text")


def search(papers: DataFrame, query: str, limit=None, analyzer: str = "english") -> DataFrame:
    """Top papers containing every term of `query`, by scanning the papers.

    One pass and no shuffle: rows are filtered and ranked where they are read, and only the top
    rows of each task are merged.
    """
    _check_query(query)
    terms = analysis.query_terms(query, analyzer)
    matched = matches(papers, terms, analyzer)
    columns = [F.col(c) for c in SEARCH_COLS]
    ranked = matched.select(*columns, rank(F.col("positions"), len(terms)).alias("rank"))
    return ranked.orderBy(*best_first()).limit(params.positive(limit, params.SEARCH_LIMIT))


def matches(papers: DataFrame, terms: list[str], analyzer: str = "english") -> DataFrame:
    """Papers containing every term, with a list of positions per term. No term: no paper."""
    if not terms:
        return papers.where(F.lit(False)).withColumn(
            "positions", F.lit(None).cast("array<array<int>>")
        )
    text = searchable_text()
    lowered = F.lower(text)
    # Cheap tests before cutting the text into tokens: substrings first, then whole words.
    for term in terms:
        start = term if analyzer == "simple" else common_start(term)
        papers = papers.where(F.contains(lowered, F.lit(start)))
    if analyzer == "simple":
        for term in terms:
            papers = papers.where(lowered.rlike(_whole_word(term)))
        positions = _positions_of(analysis.tokens(text), terms)
    else:
        positions = _arrow_positions(terms, analyzer)(analysis.tokens(text))
    # A list of one or none: filter and result share one computation of the positions, where a
    # filter on the column would be pushed below it and repeat it.
    complete = F.filter(
        F.array(positions), lambda p: F.forall(p, lambda places: F.size(places) > 0)
    )
    return papers.select("*", F.explode(complete).alias("positions"))


def _whole_word(term: str) -> str:
    """Pattern for the term as a token of its own; starts with the term, for a fast search."""
    return f"{term}(?<!{analysis.TOKEN_CHARACTER}{term})(?!{analysis.TOKEN_CHARACTER})"


def _bound(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row.

    Inside a higher-order function an outer expression would be computed for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def _positions_of(tokens: Column, terms: list[str]) -> Column:
    places = F.transform(
        tokens,
        lambda token, i: F.struct(token.alias("token"), (i + 1).alias("place")),
    )
    hits = F.filter(places, lambda p: p["token"].isin(terms))

    def of(hits, term):
        return F.transform(F.filter(hits, lambda p: p["token"] == term), lambda p: p["place"])

    return _bound(hits, lambda found: F.array(*[of(found, term) for term in terms]))


def _arrow_positions(terms: list[str], analyzer: str):
    to_term = analysis.term_of(analyzer)
    wanted = {term: i for i, term in enumerate(terms)}

    @F.arrow_udf("array<array<int>>")
    def positions(lists: pa.Array) -> pa.Array:
        def keep(token):
            term = to_term(token)
            return term if term in wanted else None

        docs, names, places = analysis.group_positions(lists, keep)
        # One list per document and wanted term, most of them empty: the found ones in order.
        slots = docs * len(wanted) + np.array([wanted[name] for name in names.to_pylist()], np.int64)
        order = np.argsort(slots)
        sizes = np.zeros(len(lists) * len(wanted), np.int64)
        sizes[slots] = places.value_lengths().to_numpy(zero_copy_only=False)
        inner = pa.ListArray.from_arrays(
            pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()),
            places.take(pa.array(order)).flatten(),
        )
        outer = np.arange(len(lists) + 1) * len(wanted)
        return pa.ListArray.from_arrays(pa.array(outer, pa.int32()), inner)

    return positions


def build_postings(papers: DataFrame, analyzer: str = "english") -> DataFrame:
    """Inverted index rows (term, arxiv_id, positions) of title and abstract. No shuffle."""
    to_term = analysis.term_of(analyzer)
    names = POSTINGS.fieldNames()

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in _by_tokens(batch):
                docs, terms, positions = analysis.group_positions(some.column("tokens"), to_term)
                ids = some.column("arxiv_id").take(pa.array(docs, pa.int64()))
                yield pa.RecordBatch.from_arrays([terms, ids, positions], names=names)

    tokenised = papers.select("arxiv_id", analysis.tokens(searchable_text()).alias("tokens"))
    return tokenised.mapInArrow(group, POSTINGS)


def _by_tokens(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of some `SLICE_TOKENS` tokens, one row at least."""
    lengths = batch.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(lengths)
    first = 0
    while first < batch.num_rows:
        before = ends[first] - lengths[first]
        last = max(int(np.searchsorted(ends, before + SLICE_TOKENS, "right")), first + 1)
        yield batch.slice(first, last - first)
        first = last


def term_bucket(term, buckets: int = TERM_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def place_postings(postings: DataFrame, path: str, buckets: int = TERM_BUCKETS) -> None:
    """Write postings partitioned by term bucket, in order of the term within a file.

    Each task sorts and writes its own rows, a file per bucket: postings are several times as large
    as the texts while they are shuffled, so they are not, and a term found in a third of all papers
    fills as many files as there are tasks.
    """
    placed = postings.withColumn("term_bucket", term_bucket(F.col("term"), buckets))
    placed = placed.sortWithinPartitions("term_bucket", "term")
    with shuffles_dropped(postings.sparkSession):
        placed.write.partitionBy("term_bucket").mode("overwrite").parquet(path)


def write_postings(postings: DataFrame, path: str, buckets: int = TERM_BUCKETS) -> None:
    """Write the index, and how many papers hold each term.

    The latter is read back: the terms' column alone, counted per task before the shuffle.
    """
    place_postings(postings, path, buckets)
    stored = read_postings(postings.sparkSession, path)
    counts = stored.groupBy("term_bucket", "term").agg(F.count("*").alias("df"))
    counts = counts.hint("rebalance", "term_bucket").sortWithinPartitions("term_bucket", "term")
    with shuffles_dropped(postings.sparkSession):
        counts.write.partitionBy("term_bucket").mode("overwrite").parquet(_terms_path(path))


def _terms_path(path: str) -> str:
    return f"{path.rstrip('/')}-terms"


def read_terms(spark, path: str) -> DataFrame:
    """The term statistics (term, df, term_bucket) of the index under `path`."""
    schema = "term string, df long, term_bucket int"
    return spark.read.schema(schema).parquet(_terms_path(path))


def read_postings(spark, path: str) -> DataFrame:
    schema = T.StructType([*POSTINGS.fields, T.StructField("term_bucket", T.IntegerType())])
    return spark.read.schema(schema).parquet(path)


def search_index(
    postings: DataFrame, query: str, limit=None, analyzer: str = "english",
    buckets: int = TERM_BUCKETS,
) -> DataFrame:
    """Top (arxiv_id, rank) for one query from a stored index.

    Reads only the partitions of the query's terms; one shuffle of their rows by paper.
    """
    _check_query(query)
    terms = analysis.query_terms(query, analyzer)
    found = postings.where(F.col("term").isin(terms))
    if "term_bucket" in postings.columns:
        wanted = [term_bucket(F.lit(term), buckets) for term in terms]
        found = found.where(F.col("term_bucket").isin(wanted) if wanted else F.lit(False))
    per_paper = found.groupBy("arxiv_id").agg(F.collect_list("positions").alias("positions"))
    ranked = per_paper.where(F.size("positions") == max(len(terms), 1)).select(
        "arxiv_id", rank(F.col("positions"), len(terms)).alias("rank")
    )
    return ranked.orderBy(*best_first()).limit(params.positive(limit, params.SEARCH_LIMIT))


def with_papers(ranked: DataFrame, papers: DataFrame) -> DataFrame:
    """Attach the search columns to (arxiv_id, rank) rows."""
    return ranked.join(papers.select(*SEARCH_COLS), "arxiv_id").select(*SEARCH_COLS, "rank")


def _marked(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose keys may be among the wanted ones: all that are, and few others.

    The bits of the wanted keys' hashes go to all tasks, whatever the number of keys, so that of a
    large table only the rows for a join are shuffled.
    """
    bit = F.pmod(F.xxhash64(*keys), F.lit(MARKS))
    word, place = F.shiftright(bit, 6), F.pmod(bit, F.lit(64)).cast("int")
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    marks = wanted.select(word.alias("word"), one.alias("bits"))
    marks = marks.groupBy("word").agg(F.bit_or("bits").alias("bits"))
    found = rows.withColumn("word", word).join(F.broadcast(marks), "word")
    return found.where(F.getbit("bits", place) == 1).select(*rows.columns)


def search_batch(
    postings: DataFrame, queries: DataFrame, limit=None, analyzer: str = "english",
    buckets: int = TERM_BUCKETS, terms: DataFrame | None = None, newest: DataFrame | None = None,
) -> DataFrame:
    """Top papers of every row of `queries` (query_id, query): (query_id, arxiv_id, rank, place).

    Queries with the same terms are answered once. `terms` is the index's table of document
    frequencies (else they are counted), so each term set's rarest term is known before postings
    are read. Candidates, with their positions, come from the rarest terms' postings only, so a
    term shared by all queries and most papers never pairs them up; a second read takes the other
    terms' positions by (term, paper) for these candidates, and shuffles hardly any other postings.

    With `newest` (arxiv_id, change), `postings` also has outdated rows: those of a paper count that
    have its `change`, 0 for papers not named. Candidates are looked up there, not all postings, and
    `terms` has to be given.
    """
    limit = params.positive(limit, params.SEARCH_LIMIT)
    found = analysis.distinct_terms(analysis.tokens("query"), analyzer)
    asked = queries.select("query_id", F.array_sort(found).alias("terms")).select(
        "query_id", "terms", F.sha2(F.array_join("terms", " "), 256).alias("terms_key")
    )
    stored = "term_bucket" in postings.columns
    keys = ["term_bucket", "term"] if stored else ["term"]

    def placed(rows):
        # On a stored index this prunes partitions at run time.
        return rows.withColumn("term_bucket", term_bucket(F.col("term"), buckets)) if stored else rows

    # Dropping repeated sets by their short key combines them per task before the shuffle.
    sets = asked.groupBy("terms_key").agg(F.first("terms").alias("terms"))
    wanted = placed(
        sets.select("terms_key", "terms", F.size("terms").alias("n"), F.explode("terms").alias("term"))
    )
    if terms is None:
        named = postings.join(wanted.select(keys).distinct(), keys, "left_semi")
        terms = named.groupBy(keys).agg(F.count("*").alias("df"))
    # An inner join is enough: a set with a term that no paper has drops out.
    rarest = (
        wanted.join(terms, keys)
        .groupBy("terms_key")
        .agg(
            F.min(F.struct("df", "term")).alias("rarest"),
            F.count("*").alias("known"),
            F.first("n").alias("n"),
            F.first("terms").alias("terms"),
        )
        .where(F.col("known") == F.col("n"))
        .select("terms_key", "n", "terms", F.col("rarest.term").alias("term"))
    )
    rarest = cut(placed(rarest), "rarest")
    version = [] if newest is None else ["change"]
    hits = postings.join(rarest.drop("terms"), keys).select(
        "terms_key", "n", "arxiv_id", "positions", *version
    )
    if newest is not None:
        now = newest.select("arxiv_id", F.col("change").alias("now"))
        hits = hits.join(now, "arxiv_id", "left").where(
            F.col("change") == F.coalesce("now", F.lit(0))
        ).drop("now")
    first = cut(hits, "first")
    others = rarest.select("terms_key", F.explode(F.array_remove("terms", F.col("term"))).alias("term"))
    due = first.select("terms_key", "n", "arxiv_id", *version).join(placed(others), "terms_key")
    more = _marked(postings, due, ["term", "arxiv_id"]).join(due, [*keys, "arxiv_id", *version])
    matched = (
        first.unionByName(more.select(first.columns))
        .groupBy("terms_key", "n", "arxiv_id")
        .agg(F.collect_list("positions").alias("positions"))
        .where(F.size("positions") == F.col("n"))
    )
    ranked = matched.select(
        "terms_key", "arxiv_id", rank_positions(F.col("positions")).alias("rank")
    )
    place = F.row_number().over(Window.partitionBy("terms_key").orderBy(*best_first()))
    top = ranked.withColumn("place", place).where(F.col("place") <= limit)
    return asked.select("query_id", "terms_key").join(top, "terms_key").drop("terms_key")
