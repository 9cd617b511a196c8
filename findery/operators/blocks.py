"""Block keys of a vocabulary: a query token finds the tokens that match it loosely through keys that both have.

A token that holds another holds its rarest run of characters, and tokens one edit apart agree once a
character is left out of each. So the tokens are filed under all their runs (``gram``), under their rarest one
(``key``) and under what is left without each character (``cut``), with the number of tokens of each run
(``count``) and each token by itself (``token``). A token of digits alone matches none but itself, so of it there are only the token and
what is left without no character. All of these are rows of one table, ``ROWS``, which may be made
for one search or kept, sorted, beside an index. A kept table may come in parts, each with the tokens that no earlier part
has: which run of a token is its rarest is then judged by its own part, and the counts of the parts add up. Neither
changes which pairs are found, as any run of the shorter token would do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from findery.functions import text as T

ROWS = "kind string, b string, token string, n long"
#: Keys that a look-up in a kept table names as literals at most, and how many of them one pushed comparison names.
LITERAL_KEYS, PUSHED = 400, 10


def _grams(token: str) -> Column:
    """The distinct runs of two and of three characters of a column; none of digits alone."""
    x, n = F.col(token), F.length(token)

    def of(size: int) -> Column:
        starts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(x, i, F.lit(size)))

    return F.when(~T.digits(x), F.array_distinct(F.concat(of(2), of(3))))


def _shorter(token: str) -> Column:
    """A column with each of its characters left out, and as it is; shorter tokens, and digits alone, have only themselves."""
    x, n = F.col(token), F.length(token)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, n)))
    return F.array_distinct(F.when((n >= 4) & ~T.digits(x), F.concat(cut, F.array(x))).otherwise(F.array(x)))


def _rarest() -> Column:
    """The run ``b`` with the least ``n``; a run that no token has belongs to no pair and is the rarest of all."""
    return F.min_by("b", F.struct(F.coalesce("n", F.lit(0)), -F.length("b"), "b")).alias("b")


def rows_of(vocabulary: DataFrame) -> DataFrame:
    """The rows of the distinct tokens (``token``), of two characters or more as ``T.tokens`` makes them."""
    v = vocabulary.select("token").distinct()
    grams = v.select("token", F.explode(_grams("token")).alias("b"))
    often = grams.groupBy("b").agg(F.count("*").alias("n"))
    kinds = {
        "token": v.withColumn("b", F.col("token")),
        "count": often,
        "gram": grams,
        "key": grams.join(often, "b").groupBy("token").agg(_rarest()),
        "cut": v.select("token", F.explode(_shorter("token")).alias("b")),
    }
    out = None
    for kind, df in kinds.items():
        token = F.col("token") if kind != "count" else F.lit(None).cast("string")
        n = F.col("n") if kind == "count" else F.lit(None).cast("long")
        rows = df.select(F.lit(kind).alias("kind"), "b", token.alias("token"), n.alias("n"))
        out = rows if out is None else out.unionByName(rows)
    return out


def of_keys(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows``, of a kept table, that may have a kind and key of ``asked`` (``kind, b``).

    Few keys become literals, in comparisons small enough to reach the statistics of the sorted files, so only the pages with
    these keys are read. With more keys all rows are left to the join that follows.
    """
    keys = sorted(tuple(r) for r in asked.select("kind", "b").distinct().limit(LITERAL_KEYS + 1).collect())
    if len(keys) > LITERAL_KEYS:
        return rows
    some = F.lit(False)
    for kind in dict.fromkeys(k for k, _ in keys):
        mine = [b for k, b in keys if k == kind]
        for at in range(0, len(mine), PUSHED):
            some = some | ((F.col("kind") == kind) & F.col("b").isin(*mine[at : at + PUSHED]))
    return rows.where(some)


def asked_keys(tokens: DataFrame, rows: DataFrame, kept: bool = False) -> DataFrame:
    """``(kind, b, q_token)``: under which keys of ``rows`` the distinct ``q_token`` are looked up."""
    q = tokens.select("q_token").distinct()
    grams = q.select("q_token", F.explode(_grams("q_token")).alias("b"))
    counts = rows.where("kind = 'count'")
    if kept:
        counts = of_keys(counts, grams.select(F.lit("count").alias("kind"), "b"))
    counts = counts.groupBy("b").agg(F.sum("n").alias("n"))
    own = grams.join(counts, "b", "left").groupBy("q_token").agg(_rarest())
    cut = q.select("q_token", F.explode(_shorter("q_token")).alias("b"))
    under = {"gram": own, "key": grams, "cut": cut}
    out = [df.select(F.lit(kind).alias("kind"), "b", "q_token") for kind, df in under.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def pairs(tokens: DataFrame, rows: DataFrame, kept: bool = False) -> DataFrame:
    """Distinct ``(q_token, token)`` of the tokens in ``rows`` that are equal to a ``q_token`` or match it loosely.

    ``kept`` rows are read from a sorted table, and of it, for few keys, only what they lead to. What is compared goes with the
    query's tokens, not with the vocabulary.
    """
    asked = asked_keys(tokens, rows, kept)
    held = rows.where(F.col("kind").isin("gram", "key", "cut"))
    if kept:
        held = of_keys(held, asked)
    both = asked.join(held.select("kind", "b", "token"), ["kind", "b"])
    return both.where(T.loose(F.col("q_token"), F.col("token"))).select("q_token", "token").distinct()
