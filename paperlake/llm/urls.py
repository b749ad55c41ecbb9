"""URL filters by a ratio of character language models.

Rules judge the URLs they fit, the longest rule first (of equally long ones, the last by name). The
URLs that rules judge train two smoothed variable-order Markov models of characters, of accepted
and of rejected URLs: exact counts of all n-grams up to `ORDER` and of their contexts, a Spark table
that grows with the URLs. A URL that no rule fits is judged by the difference of the two
log-likelihoods per character, against a threshold calibrated on judged URLs that were left out of
the counts.

URLs are counted and scored in blocks of rows: a block names each of its n-grams once, so what is
shuffled is a block's distinct n-grams, never all n-grams of all URLs, and an n-gram of every URL is
one row per block. The rows themselves move once, by block, so a URL that fills a third of the table
makes no hot key.

Defined cases: a null URL or one without `://` has an empty host and path, fits no rule, and is
scored by its characters (no characters score 0); repeated URLs count as often as they occur; with
no accepted or no rejected URL every other URL is allowed with score 0; further columns are ignored;
an empty table gives no rows.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperlake.session import cut

from . import hashing

ORDER = 6
"""Bytes of the longest n-gram: five of context and the next one. They fit into a 64-bit key."""
SMOOTHING = 4.0
MISBLOCKED = 0.01
"""The largest share of accepted URLs, among those left out, that the threshold may block."""
HELD_OUT = 5
"""One judged URL of so many, by hash, calibrates the threshold and is not counted."""
BLOCK_ROWS, BLOCK_BYTES = 16_384, 2 << 20
"""A block of URLs ends when it has so many rows or bytes."""


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


# The rules of the registered query.
RULES = [
    Rule("org", "/", "allow"),
    Rule("example.org", "/es/", "block"),
    Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"),
    Rule("com", "/de/", "block"),
]


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path of a URL column."""
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def by_rule(rules: list[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, over columns `host` and `path`."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = (
            (F.col("host") == rule.host) | F.col("host").endswith(f".{rule.host}")
        ) & F.col("path").startswith(rule.path)
        name = F.when(fits, rule.name).otherwise(name)
        verdict = F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def _grams(column):
    """(order, whether there is one, n-gram, context) arrays by order, at each byte of the URLs.

    Keys are the bytes themselves, above them the order, and 8 more for contexts.
    """
    data, offsets = hashing.text_bytes(column)
    place = np.arange(len(data)) - np.repeat(offsets[:-1], np.diff(offsets))
    byte = data.astype(np.int64)
    gram = np.zeros(len(data), np.int64)
    for order in range(1, ORDER + 1):
        context = np.zeros(len(data), np.int64)
        context[1:] = gram[:-1]
        shifted = np.zeros(len(data), np.int64)
        shifted[order - 1 :] = byte[: len(data) - order + 1]
        gram = gram | shifted << 8 * (order - 1)
        there = place >= order - 1
        yield order, there, gram | order << 48, np.where(order > 1, context, 0) | (order + 8) << 48


def _counted(batches):
    """Rows (url, side): each batch's n-grams and contexts, counted for rejected and accepted."""
    for batch in batches:
        side = batch.column(1).to_numpy()
        found = []
        for wanted in (0, 1):
            column = batch.column(0).filter(pa.array(side == wanted))
            keys = [k[there] for _, there, *both in _grams(column) for k in both]
            found.append(np.unique(np.concatenate(keys), return_counts=True))
        (rejected, n_rejected), (accepted, n_accepted) = found
        counts = pa.array(n_rejected), pa.array(n_accepted)
        zeros = [pa.array(np.zeros(len(c), np.int64)) for c in counts]
        for keys, columns in ((rejected, (counts[0], zeros[0])), (accepted, (zeros[1], counts[1]))):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys), *columns], names=["key", "rejected", "accepted"]
            )


def _scores(column, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The difference of the log-likelihoods per character, accepted less rejected.

    `keys` are sorted, with a row of two counts each; other keys were never seen.
    """
    _, offsets = hashing.text_bytes(column)
    keys = np.append(keys, np.iinfo(np.int64).max)
    counts = np.append(counts, np.zeros((1, 2)), axis=0)

    def seen(wanted):
        at = np.searchsorted(keys, wanted)
        return np.where((keys[at] == wanted)[:, None], counts[at], 0)

    chance = np.full((int(offsets[-1]), 2), 1 / 256)
    for _, there, gram, context in _grams(column):
        new = (seen(gram) + SMOOTHING * chance) / (seen(context) + SMOOTHING)
        chance = np.where(there[:, None], new, chance)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ratio = np.log(chance[:, 1]) - np.log(chance[:, 0])
    total = np.bincount(row, ratio, len(offsets) - 1)
    return total / np.maximum(np.diff(offsets), 1)


def count_grams(judged: DataFrame) -> DataFrame:
    """The written table of exact counts (key, rejected, accepted) of rows (url, verdict)."""
    side = F.when(F.col("verdict") == "allow", 1).otherwise(0).cast("long")
    rows = judged.where("url IS NOT NULL").select("url", side.alias("side"))
    counts = rows.mapInArrow(_counted, "key long, rejected long, accepted long")
    sums = [F.sum(name).alias(name) for name in ("rejected", "accepted")]
    return cut(counts.groupBy("key").agg(*sums), "grams")


def _blocks(batches):
    """The rows with their block's number, and for each block one row of its n-grams."""
    number = (TaskContext.get().partitionId() << 32) - 1
    for batch in batches:
        _, offsets = hashing.text_bytes(batch.column(0))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES, "right")) - 1
            last = min(max(last, first + 1), first + BLOCK_ROWS)
            some = batch.slice(first, last - first)
            first, number = last, number + 1
            keys = [k[there] for _, there, *both in _grams(some.column(0)) for k in both]
            kind = pa.list_(pa.int64())
            names = [*batch.schema.names, "block", "grams"]
            yield pa.RecordBatch.from_arrays(
                [*some.columns, pa.array(np.full(len(some), number)), pa.nulls(len(some), kind)],
                names=names,
            )
            none = [pa.nulls(1, column.type) for column in some.columns]
            grams = pa.array([np.unique(np.concatenate(keys))], kind)
            yield pa.RecordBatch.from_arrays([*none, pa.array([number]), grams], names=names)


def scored(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """`rows` (url first, any others) with their `score`, as a written table."""
    names = rows.columns
    def shape(**more):
        kinds = {f.name: f.dataType for f in rows.schema.fields} | more
        return T.StructType([T.StructField(*x) for x in kinds.items()])

    blocks = rows.mapInArrow(_blocks, shape(block=T.LongType(), grams=T.ArrayType(T.LongType())))
    blocks = cut(blocks, "url-blocks")
    grams = blocks.where("grams IS NOT NULL").select(
        F.col("block").alias("of_block"), F.explode_outer("grams").alias("key")
    )
    known = grams.join(counts, "key")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("key")
        counts = np.stack([right[c].to_numpy() for c in ("rejected", "accepted")], axis=1)
        found = _scores(left["url"].combine_chunks(), right["key"].to_numpy(), counts)
        return left.select(names).append_column("score", pa.array(found))

    own = blocks.where("grams IS NULL").drop("grams")
    both = own.groupBy("block").cogroup(known.groupBy("of_block"))
    return cut(both.applyInArrow(score, shape(score=T.DoubleType())), "url-scores")


def threshold(judged: DataFrame) -> float:
    """The threshold for rows (verdict, score) that were left out of the counts."""
    side = F.when(F.col("verdict") == "allow", 1).otherwise(0)
    stats = {
        row["side"]: row
        for row in judged.groupBy(side.alias("side"))
        .agg(
            F.avg("score").alias("mean"),
            F.stddev_pop("score").alias("deviation"),
            F.percentile_approx("score", MISBLOCKED, 10_000).alias("lowest"),
        )
        .collect()
    }
    return _threshold(stats)


def _threshold(stats) -> float:
    """As many deviations from the one class as from the other, but no more than misblocks few
    accepted URLs; 0 if a class was not left out."""
    if len(stats) < 2:
        return 0.0
    low, high = stats[0], stats[1]
    spread = low["deviation"] + high["deviation"]
    middle = (low["mean"] + high["mean"]) / 2
    if spread > 0:
        middle = (low["mean"] * high["deviation"] + high["mean"] * low["deviation"]) / spread
    return min(middle, high["lowest"])


def judge(pages: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (the difference of the models,
    higher for accepted URLs).

    Only the URLs are read, once for the counts and once for the scores.
    """
    host, path = host_and_path()
    split = pages.select("url", "page_id", host.alias("host"), path.alias("path"))
    rule, verdict = by_rule(rules)
    ruled = split.select("*", rule.alias("rule"), verdict.alias("verdict"))
    apart = F.pmod(F.xxhash64("url", F.lit("calibration")), F.lit(HELD_OUT)) == 0
    counts = count_grams(ruled.where(F.col("verdict").isNotNull() & ~apart))
    # Every character has the empty context of the first order.
    total = counts.where(F.col("key") == 9 << 48).first()
    names = ["page_id", "host", "path", "rule"]
    if total is None or not total["rejected"] or not total["accepted"]:
        own = F.coalesce("verdict", F.lit("allow")).alias("verdict")
        return ruled.select(*names, own, F.lit(0.0).alias("score"))
    rows = scored(ruled, counts)
    least = threshold(rows.where(F.col("verdict").isNotNull() & F.col("url").isNotNull() & apart))
    own = F.when(F.col("score") < least, "block").otherwise("allow")
    return rows.select(*names, F.coalesce("verdict", own).alias("verdict"), "score")
