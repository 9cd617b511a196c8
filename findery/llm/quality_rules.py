"""Quality rules whose cutoffs are certified on labelled holdouts.

Each rule rejects a text whose statistic exceeds a cutoff. For every stratum (language) one path of joint
cutoffs is laid out by the bad documents and a fixed fifth of the good ones: at each step a rule may reject what
is so many times commoner among the bad ones, and the factor falls from step to step. The other good documents
certify the path: a step holds while the exact binomial test rejects "all rules together reject more than
``alpha`` of the good documents", at a level divided by the number of strata (Bonferroni); the fixed order
along the path needs no further correction. Trials are distinct texts of a stratum: copies of a text, under
one id or many, count once, so the test's trials do not repeat each other (near copies count apart). So with probability ``1 - delta`` at least, no stratum loses more
than ``alpha`` of its good documents to these rules. Of the certified steps the first one that catches nearly
all the bad ones that the last catches is taken. A stratum with too few labels gets no cutoff.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, columns_of, materialize, text_column, unused

SPACES, SYMBOLS = b"\x20\x09\x0a\x0b\x0c\x0d", b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks")
#: Rule name to the two counts whose ratio is its statistic; larger is worse.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "marks": ("n_marks", "n_words"),
}
#: Cutoffs that each rule may take, from the loosest: equal steps of the square root.
GRID = tuple(round((k / 64) ** 2, 6) for k in range(63, 0, -1))
#: At each step of a path, how many times commoner rejection must be among the bad documents.
LIFTS = tuple(round(64 ** (1 - t / 60), 6) for t in range(1, 61))
STEPS = len(LIFTS)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Strata whose cutoffs become a literal; more are joined as a table.
LITERAL_STRATA = 1000

MARKS = re.compile(rb"[!?]{2}")


def text_stats(text: bytes | None) -> tuple[int, ...]:
    """The counts named in ``STATS``; all 0 for null and empty texts.

    ``n_lines`` counts lines with a word, ``n_marks`` the words with two exclamation or question marks in a row.
    """
    text = text or b""
    words = text.split()
    n = len(words)
    solid = text.translate(None, SPACES)
    chars = len(solid) - int(((np.frombuffer(solid, np.uint8) & 0xC0) == 0x80).sum()) if not solid.isascii() else len(solid)
    symbols = len(solid) - len(solid.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    marks = sum(1 for w in words if MARKS.search(w)) if MARKS.search(text) else 0
    return n, chars, symbols, len(lines) - len(set(lines)), _repeat_words(words), len(lines), marks


def _repeat_words(words: list[bytes], size: int = 3) -> int:
    """Words covered by ``size``-word windows that occur twice or more, first occurrences included."""
    n = len(words)
    if n <= size:
        return 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) == n:
        return 0
    if len(ids) < 1 << 20:
        base = len(ids)
        windows = (at[:-2] * base + at[1:-1]) * base + at[2:]
    else:
        pairs = np.unique(at[:-2] * len(ids) + at[1:-1], return_inverse=True)[1]
        windows = pairs * len(ids) + at[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for k in range(size):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def stats_of(text: Column) -> Column:
    """A struct of the counts in ``STATS``."""

    def step(texts: pa.Array) -> pa.Array:
        rows = np.array([text_stats(t) for t in texts.cast(pa.binary()).to_pylist()], np.int64).reshape(-1, len(STATS))
        return pa.StructArray.from_arrays([pa.array(c) for c in rows.T.copy()], STATS)

    return text_column(step, "struct<" + ", ".join(f"{s}: long" for s in STATS) + ">")(text)


def failed(n_words: Column, n_repeat_words: Column) -> Column:
    """The base rules: too few words, or too many of them in repeated windows."""
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words)


def with_stats(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """``docs`` with the columns of ``STATS`` (longs) and ``base_failed``; columns of those names are replaced.

    Without ``keep_text``, ``text_md5`` stands for the text.

    Null and empty texts have counts of 0 and fail the base rules; repeated rows and null ids are rows like others.
    """
    name = unused(docs, "_stats")
    own = columns_of(docs, *STATS, "base_failed", *(() if keep_text else ("text", "text_md5")))
    if not keep_text:
        docs = docs.select(*columns_of(docs, "text_md5"), _digest(F.col("text")).alias("text_md5"))
        own.append(F.col("text_md5"))
    got = docs.select(*own, stats_of(F.col("text")).alias(name)).select(*own, *(F.col(f"{name}.{s}").alias(s) for s in STATS))
    return got.withColumn("base_failed", failed(F.col("n_words"), F.col("n_repeat_words")))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X binomial(n, p), summed in logarithms."""
    if k >= n:
        return 1.0
    lead = math.lgamma(n + 1)
    terms = [lead - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(terms)
    return min(1.0, math.exp(top) * sum(math.exp(t - top) for t in terms))


@dataclass(frozen=True)
class Limits:
    """``alpha``: tolerated false rejection per stratum; ``delta``: risk that any stratum exceeds it."""

    alpha: float = 0.02
    delta: float = 0.05
    #: Share of the bad documents that the last certified step catches, to be caught at least.
    catch: float = 0.98


def _ratio(rule: str, of=F.col) -> Column:
    count, base = RULES[rule]
    return of(count) / F.greatest(of(base), F.lit(1))


def _passed(stat: Column, cutoffs: Column) -> Column:
    """How many of the cutoffs, counted from the loosest, leave a text with this statistic alone."""
    return F.size(F.filter(cutoffs, lambda c: stat <= c))


def stratum_of(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit("und"))


def _digest(text: Column) -> Column:
    return F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def design_fold(text_md5: Column) -> Column:
    """True for the fixed fifth of the good texts that helps to lay out the path."""
    return F.conv(F.substring(text_md5, 1, 8), 16, 10).cast("long") % 5 == 0


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` has a label, with their own columns: all that ``calibrate`` needs."""
    name = unused(docs, "_labelled")
    ids = broadcast_if_small(labels.where("doc_id is not null and quality in (0, 1)").select(F.col("doc_id").alias(name)).distinct(), "labelled")
    return docs.join(ids, F.col("doc_id") == F.col(name), "left_semi")


def trials(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """``(stratum, role, ...)`` with the statistic of each rule: a row for each distinct labelled text of a stratum.

    ``role`` is bad, or design or good. Ids that are null, labelled both ways or borne by several texts are left
    out, and so are texts that the base rules reject or whose ids are labelled both ways.
    """
    digest = _digest(F.col("text")) if "text" in stats.columns else F.col("text_md5")
    said = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("quality").alias("q2")).where("q = q2")
    rows = stats.select("doc_id", stratum_of(F.col("lang")).alias("stratum"), digest.alias("digest"), "base_failed", *(_ratio(r).alias(r) for r in RULES))
    rows = rows.join(said.select("doc_id", "q"), "doc_id")
    sure = rows.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a = b").select("doc_id")
    once = rows.join(sure, "doc_id", "left_semi").where("not base_failed").groupBy("stratum", "digest")
    once = once.agg(F.min("q").alias("q"), F.max("q").alias("q2"), *(F.first(r).alias(r) for r in RULES)).where("q = q2")
    role = F.when(F.col("q") == 0, "bad").when(design_fold(F.col("digest")), "design").otherwise("good")
    return once.select("stratum", role.alias("role"), *RULES)


def calibrate(stats: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> dict[str, dict[str, float]]:
    """Stratum to rule to cutoff, from ``stats`` (as ``with_stats`` gives them, with ``doc_id`` and ``lang``).

    ``labels`` has ``doc_id`` and ``quality``. ``trials`` says what counts: each distinct text of a stratum once,
    however often it or its id is repeated. Without labels there are no cutoffs. Only counts per stratum, rule and cutoff reach the driver, and only for strata with
    enough good labels to certify anything.
    """
    held = materialize(trials(stats, labels), "trials")
    least = math.ceil(math.log(limits.delta) / math.log1p(-limits.alpha))
    strata = sorted(r.stratum for r in held.where("role = 'good'").groupBy("stratum").count().where(F.col("count") >= least).collect())
    if not strata:
        return {}
    grid = F.array(*(F.lit(c) for c in GRID))
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), _passed(F.col(r), grid).alias("passed")) for r in RULES)))
    counts = _with_table(held.where("role <> 'good'"), {s: [] for s in strata}, "").select("stratum", "role", each.alias("x")).groupBy("stratum", "role", "x.rule", "x.passed").count()
    hits: dict[str, dict[tuple[str, str], np.ndarray]] = {s: {} for s in strata}
    for r in counts.collect():
        hits[r.stratum].setdefault((r.role, r.rule), np.zeros(len(GRID) + 1, np.int64))[r.passed] += r["count"]
    paths = {s: lay_out(h, limits) for s, h in hits.items()}
    laid = _with_table(held.where("role <> 'design'"), {s: list(p.values()) for s, p in paths.items()}, "array<double>")
    step = F.least(*(_passed(F.col(r), F.col(f"_{k}")) for k, r in enumerate(RULES)))
    joint = laid.select("stratum", "role", step.alias("step")).groupBy("stratum", "role", "step").count()
    found = {s: {role: np.zeros(STEPS + 1, np.int64) for role in ("good", "bad")} for s in paths}
    for r in joint.collect():
        found[r.stratum][r.role][r.step] += r["count"]
    return {s: {r: path[at] for r, path in paths[s].items() if path[at] < math.inf} for s, h in found.items() if (at := choose(h["good"], h["bad"], limits, len(paths))) is not None}


def _with_table(rows: DataFrame, table: dict[str, list], kind: str) -> DataFrame:
    """``rows`` of the strata in ``table`` with its values as ``_0``, ``_1``...: from literals, or by a join if there are very many strata."""
    names = [f"_{k}" for k in range(len(next(iter(table.values()))))]
    if len(table) > LITERAL_STRATA:
        held = rows.sparkSession.createDataFrame([(s, *v) for s, v in sorted(table.items())], ", ".join(["stratum string", *(f"{n} {kind}" for n in names)]))
        return rows.join(held, "stratum")
    stratum = F.col("stratum")
    literal = lambda v: F.array(*map(F.lit, v)) if isinstance(v, list) else F.lit(v)
    maps = {n: F.create_map(*(x for s, v in sorted(table.items()) for x in (F.lit(s), literal(v[k]))))[stratum] for k, n in enumerate(names)}
    return rows.where(stratum.isin(*table)).withColumns(maps) if maps else rows.where(stratum.isin(*table))


def lay_out(hits: dict[tuple[str, str], np.ndarray], limits: Limits) -> dict[str, list[float]]:
    """Rule to its cutoff at every step (infinite: none), from counts of documents by how many cutoffs they pass.

    Of the cutoffs that the step allows, the loosest is taken that catches nearly all that the strictest does.
    """
    out = {}
    none = np.zeros(len(GRID) + 1, np.int64)
    for rule in RULES:
        bad, plain = (hits.get((role, rule), none) for role in ("bad", "design"))
        plain = (np.cumsum(plain)[:-1] + 1) / (plain.sum() + 1)
        bad = np.cumsum(bad)[:-1] / max(1, bad.sum())
        out[rule] = []
        for lift in LIFTS:
            fit = bad[(bad >= lift * plain)]
            out[rule].append(GRID[int(np.argmax(bad >= limits.catch * fit.max()))] if len(fit) and fit.max() else math.inf)
    return out


def choose(good: np.ndarray, bad: np.ndarray, limits: Limits, strata: int) -> int | None:
    """The step to take, from counts of documents by how many steps they pass; None if the first cannot be certified."""
    rejected, caught = np.cumsum(good)[:-1], np.cumsum(bad)[:-1]
    certified = 0
    while certified < STEPS and binomial_tail(int(rejected[certified]), int(good.sum()), limits.alpha) <= limits.delta / strata:
        certified += 1
    return int(np.argmax(caught[:certified] >= limits.catch * caught[certified - 1])) if certified else None


def passes(docs: DataFrame, cutoffs: dict[str, dict[str, float]], of, lang: Column, name: str) -> DataFrame:
    """``docs`` with boolean ``name``: no base rule and no cutoff of the row's stratum rejects it; ``of`` gives a count's column."""
    own, over = columns_of(docs), F.lit(False)
    if len(cutoffs) <= LITERAL_STRATA:
        for r in RULES:
            if known := [x for s, c in sorted(cutoffs.items()) if r in c for x in (F.lit(s), F.lit(float(c[r])))]:
                over = over | F.coalesce(_ratio(r, of) > F.create_map(*known)[stratum_of(lang)], F.lit(False))
    else:
        s = unused(docs, "_stratum")
        rows = [(k, *(float(c.get(r, math.inf)) for r in RULES)) for k, c in sorted(cutoffs.items())]
        table = docs.sparkSession.createDataFrame(rows, f"{s} string, " + ", ".join(f"{s}_{r} double" for r in RULES))
        docs = docs.withColumn(s, stratum_of(lang)).join(table, s, "left")
        for r in RULES:
            over = over | F.coalesce(_ratio(r, of) > F.col(f"{s}_{r}"), F.lit(False))
    return docs.select(*own, (~failed(of("n_words"), of("n_repeat_words")) & ~over).alias(name))


def verdict(stats: DataFrame, cutoffs: dict[str, dict[str, float]]) -> DataFrame:
    """``stats`` with ``kept``: false if ``base_failed`` or a rule's cutoff for the row's stratum is exceeded; a column of that name is replaced."""
    return passes(stats.drop("kept"), cutoffs, F.col, F.col("lang"), "kept")


def keep(docs: DataFrame, cutoffs: dict[str, dict[str, float]]) -> DataFrame:
    """The rows of ``docs`` (``text, lang``, ...) that ``verdict`` keeps, with their own columns, whatever their names."""
    name, mark = unused(docs, "_stats"), unused(docs, "_kept")
    measured = docs.withColumn(name, stats_of(F.col("text")))
    return passes(measured, cutoffs, lambda c: F.col(f"{name}.{c}"), F.col("lang"), mark).where(F.col(mark)).select(*columns_of(docs))
