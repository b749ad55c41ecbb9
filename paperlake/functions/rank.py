"""Text rank over the positions of the matched query terms.

Every occurrence carries the same weight. One term is scored by a damped occurrence count; several
terms by the distances between occurrences of different terms. Only pairs within `FAR` positions
have a weight worth computing, all farther pairs share one constant and are counted
arithmetically, so the work grows with the occurrences, not with their pairs.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the ranking formula.
WEIGHT = 0.1
SERIES_LIMIT = 1.64493406685
FAR = 100
FAR_CLOSENESS = 1e-30


def closeness(distance: int) -> float:
    if distance > FAR:
        return FAR_CLOSENESS
    return 1.0 / (1.005 + 0.05 * math.exp(distance / 1.5 - 2))


def pair_log(distance: int) -> float:
    """Log of the chance that a pair of occurrences at this distance does not count."""
    return math.log1p(-WEIGHT * math.sqrt(closeness(distance)))


def single_scores(most: int) -> np.ndarray:
    """Rank of one term by its number of occurrences, from none to `most`."""
    counts = np.arange(1.0, most + 1)
    return np.concatenate(([0.0], WEIGHT * np.cumsum(1.0 / counts**2) / SERIES_LIMIT))


def rank_batch(positions: pa.Array) -> np.ndarray:
    """Ranks of a batch of documents, each with one ascending position list per query term."""
    n_docs = len(positions)
    n_terms = positions.value_lengths().to_numpy(zero_copy_only=False)
    lists = positions.flatten()
    counts = lists.value_lengths().to_numpy(zero_copy_only=False)
    list_doc = np.repeat(np.arange(n_docs), n_terms)

    # Occurrences of all terms of a document, ordered by place.
    place = lists.flatten().to_numpy(zero_copy_only=False)
    doc = np.repeat(list_doc, counts)
    term = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((place, doc))
    place, doc, term = place[order], doc[order], term[order]

    far = pair_log(FAR + 1)
    # Pairs at the same place do not count.
    logs = np.array([0.0, *(pair_log(d) for d in range(1, FAR + 1))])
    n_all = np.bincount(doc, minlength=n_docs).astype(np.float64)
    n_same = np.bincount(list_doc, weights=counts.astype(np.float64) ** 2, minlength=n_docs)
    total = (n_all**2 - n_same) / 2 * far

    # Compare each occurrence with the one `step` before it. Distances grow with the step, so the
    # first step without a near pair ends the search.
    for step in range(1, len(place)):
        distance = place[step:] - place[:-step]
        near = (doc[step:] == doc[:-step]) & (distance <= FAR)
        if not near.any():
            break
        near &= term[step:] != term[:-step]
        # A near pair is part of the far total already: replace its share.
        shares = logs[distance[near]] - far
        total += np.bincount(doc[step:][near], weights=shares, minlength=n_docs)

    ranks = -np.expm1(total)
    single = n_terms == 1
    first = (np.cumsum(n_terms) - n_terms)[single]
    if len(first):
        ranks[single] = single_scores(int(counts[first].max()))[counts[first]]
    return ranks


def rank_positions(positions) -> Column:
    """Rank from one ascending position list per distinct query term.

    Ranks are single precision; that also makes equal ranks compare equal.
    """

    @F.arrow_udf("float")
    def rank(lists: pa.Array) -> pa.Array:
        return pa.array(rank_batch(lists).astype(np.float32))

    return rank(positions)


def rank_single(positions) -> Column:
    """The same for documents matched by one term, without leaving the JVM."""
    count = F.size(F.get(positions, 0))
    series = F.aggregate(
        F.when(count > 0, F.sequence(F.lit(1), count)),
        F.lit(0.0),
        lambda total, n: total + 1.0 / (n.cast("double") * n),
    )
    return (F.coalesce(series, F.lit(0.0)) * WEIGHT / SERIES_LIMIT).cast("float")


def rank(positions, n_terms: int) -> Column:
    """Rank of documents that all match the same number of terms."""
    return rank_single(positions) if n_terms == 1 else rank_positions(positions)
