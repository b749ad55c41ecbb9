"""Quality rules by weak supervision, in DataFrame functions only.

Each rule votes for keeping (1), against (-1) or abstains (0). Expectation maximisation over the
counts of all vote patterns estimates how often each rule votes against good and against bad texts
(its accuracy on either) and the share of good texts. A text's posterior probability of being good
replaces the demand that all rules pass.

Defined cases: null and empty texts have no words and fail the base rules; rows that repeat a
`doc_id` and rows without one are judged one by one; further columns are ignored; an empty table
gives no rows (and accuracies from the prior alone).
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.session import cut

SPACE = r"[\x20\x09-\x0D]+"
RUN = 5
PRIOR_GOOD = 1.0, 50.0
"""Votes against, and votes, that every rule is taken to have cast on good texts beforehand."""
PRIOR_BAD = 5.0, 10.0
"""The same on bad texts."""
ROUNDS = 50
THRESHOLD = 0.5


def features(documents: DataFrame) -> DataFrame:
    """doc_id and the counts the rules look at; one pass over the whole texts, no shuffle."""
    text = F.coalesce("text", F.lit(""))
    words = documents.select("doc_id", text.alias("text")).withColumn(
        "words", F.array_remove(F.split("text", SPACE), "")
    )
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = words.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit("[A-Z]")).cast("long").alias("n_capitals"),
        F.regexp_count("text", F.lit("[.!?]")).cast("long").alias("n_stops"),
        F.regexp_count("text", F.lit("[#*$%&|<>!]{2,}")).cast("long").alias("n_symbol_runs"),
        F.length(F.regexp_replace("text", r"\P{L}+", "")).cast("long").alias("n_letters"),
        lines.alias("lines"),
        _runs().alias("runs"),
    )
    listed = counted.select(
        "*",
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("lines")).cast("long").alias("n_distinct_lines"),
        (F.size(F.array_distinct("runs")) < F.size("runs")).alias("repeats"),
    ).drop("lines")
    # Equal runs meet when sorted; where no run occurs twice nothing is sorted.
    ranked = listed.withColumn(
        "sorted",
        F.when(
            F.col("repeats"),
            F.sort_array(
                F.transform("runs", lambda run, at: F.struct(run.alias("run"), at.alias("at")))
            ),
        ),
    ).drop("runs", "repeats")
    again = F.filter(
        "sorted",
        lambda x, i: (F.get("sorted", i - 1)["run"] == x["run"])
        | (F.get("sorted", i + 1)["run"] == x["run"]),
    )
    placed = ranked.withColumn(
        "places", F.sort_array(F.transform(again, lambda x: x["at"]))
    ).drop("sorted")
    covered = F.aggregate(
        F.transform(
            "places",
            lambda at, i: F.when(i == 0, F.lit(RUN)).otherwise(
                F.least(F.lit(RUN), at - F.get("places", i - 1))
            ),
        ),
        F.lit(0),
        lambda total, x: total + x,
    )
    return placed.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.col("n_lines") - F.col("n_distinct_lines")).alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_lines",
        "n_capitals",
        "n_stops",
        "n_symbol_runs",
        "n_letters",
    )


def _runs() -> Column:
    """The hash of each run of `RUN` words; none if there are not two of them."""
    places = F.sequence(F.lit(0), F.size("words") - RUN)
    words = F.col("words")
    hashes = F.transform(places, lambda at: F.xxhash64(*(words[at + i] for i in range(RUN))))
    return F.when(F.size("words") > RUN, hashes).otherwise(F.array().cast("array<bigint>"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))


def rules() -> dict[str, Column]:
    """The rules' votes by name, over the columns of `features`."""
    words = F.greatest("n_words", F.lit(1))
    lines = F.greatest("n_lines", F.lit(1))
    length = F.col("word_chars") / words
    symbols = F.col("n_symbols") / words
    capitals = F.col("n_capitals") / F.greatest("word_chars", F.lit(1))
    duplicate = F.col("n_dup_lines") / lines
    repeated = F.col("n_repeat_words") / words
    stops = F.col("n_stops") / words
    letters = F.col("n_letters") / F.greatest("word_chars", F.lit(1))
    symbol_runs = F.col("n_symbol_runs") / words
    n = F.col("n_words")
    return {
        "vote_length": _vote(n >= 50, n < 10),
        "vote_word_length": _vote((length >= 3) & (length <= 9), (length < 2.5) | (length > 15)),
        "vote_symbols": _vote(symbols < 0.1, symbols > 0.25),
        "vote_symbol_runs": _vote(symbol_runs < 0.02, symbol_runs > 0.1),
        "vote_letters": _vote(letters >= 0.85, (letters < 0.75) & (n > 0)),
        "vote_capitals": _vote(capitals < 0.2, capitals > 0.5),
        "vote_lines": _vote((duplicate == 0) & (F.col("n_lines") > 0), duplicate > 0.3),
        "vote_repeats": _vote((repeated < 0.05) & (n > 0), repeated > 0.2),
        "vote_sentences": _vote((stops >= 0.02) & (stops < 0.5), (stops < 0.002) & (n >= 200)),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], names: list[str]):
    """Each rule's rates of votes against good and against bad texts, and the share of good ones,
    from counts by vote pattern.

    There are at most 3 ** rules patterns, however many texts there are.
    """
    rates = {name: (PRIOR_GOOD[0] / PRIOR_GOOD[1], PRIOR_BAD[0] / PRIOR_BAD[1]) for name in names}
    share = 0.9
    total = sum(count for _, count in patterns)
    for _ in range(ROUNDS):
        good_sum = 0.0
        against = {name: [PRIOR_GOOD[0], PRIOR_BAD[0]] for name in names}
        cast = {name: [PRIOR_GOOD[1], PRIOR_BAD[1]] for name in names}
        for votes, count in patterns:
            odds = math.log(share / (1 - share))
            for name, vote in zip(names, votes, strict=True):
                odds += evidence(rates[name], vote)
            good = 1 / (1 + math.exp(-odds))
            good_sum += good * count
            for name, vote in zip(names, votes, strict=True):
                for side, weight in enumerate((good * count, (1 - good) * count)):
                    cast[name][side] += weight * (vote != 0)
                    against[name][side] += weight * (vote < 0)
        # A rule is never taken to be worse than chance, so that the classes keep their meaning.
        for name in names:
            good, bad = (against[name][i] / cast[name][i] for i in (0, 1))
            rates[name] = good, max(bad, good)
        share = min(max((good_sum + 9) / (total + 10), 0.05), 0.99)
    return rates, share


def evidence(rate: tuple[float, float], vote: int) -> float:
    """The log odds that a vote adds for a good text."""
    good, bad = rate
    if vote < 0:
        return math.log(good / bad)
    return math.log((1 - good) / (1 - bad)) if vote else 0.0


def judge(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, quality (the posterior probability) and the rules' votes.

    The features are a written table; the counts of vote patterns are over all of it.
    """
    votes = rules()
    names = list(votes)
    rows = cut(features(documents).select("*", *(vote.alias(n) for n, vote in votes.items())), "quality")
    patterns = [
        (tuple(row[name] for name in names), row["count"])
        for row in rows.groupBy(*names).count().collect()
    ]
    rates, share = estimate(patterns, names)
    odds = F.lit(math.log(share / (1 - share)))
    for name in names:
        odds = odds + F.when(F.col(name) < 0, evidence(rates[name], -1)).when(
            F.col(name) > 0, evidence(rates[name], 1)
        ).otherwise(0.0)
    n = F.col("n_words")
    failed = (n < 10) | (100 * F.col("n_repeat_words") > 20 * n)
    quality = 1 / (1 + F.exp(-odds))
    return rows.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (quality >= threshold)).alias("kept"),
        quality.alias("quality"),
        *names,
    )
