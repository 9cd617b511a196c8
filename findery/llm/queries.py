"""One query per operator, with production parameters over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, embedding_dedup, exact_dedup, language_id, late_sessions, packing, quality_classifier, quality_rules, simhash, substring_dedup, url_filters, warc, whitening
from .common import fold_of, materialize, table

#: Names of the public vocabulary files; see ``tokenizer_path``.
WORD_BPE, BYTE_BPE = "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents").select("doc_id", "text"), fold_of(F.col("doc_id"), 3)
    weights = quality_classifier.train(docs.where(fold != 1), table(spark, sf_dir, "labels").where(fold != 1))
    scored = quality_classifier.score(docs, weights)
    return scored.select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _day(text, days: int):
    """A date in 2024 from the first eight hex digits of the md5 of ``text``."""
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    return F.date_add(F.lit("2024-01-01").cast("date"), (number % days).cast("int"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a capture with a fetch date, against a list with three dated entries for each host and language section.

    The tables hold no dates and no list, so both are derived from md5 sums.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", _day(F.concat(F.lit("fetch:"), F.col("page_id").cast("string")), 366))
    host, section = url_filters.host_of(F.col("url")), F.split(url_filters.path_of(F.col("url")), "/")[1]
    wide = F.regexp_replace(host, r"^[^.]+\.", "")
    listed = pages.select(F.explode(F.array(F.struct(F.lit("domain").alias("kind"), host.alias("key")), F.struct(F.lit("domain").alias("kind"), wide.alias("key")), F.struct(F.lit("prefix").alias("kind"), F.concat(host, F.lit("/"), section).alias("key")))).alias("x")).select("x.kind", "x.key").where("key is not null").distinct()
    dated = listed.select("kind", "key", F.explode(F.array(*(F.lit(k) for k in range(3)))).alias("k"))
    name = F.concat_ws(":", "kind", "key", "k")
    action = F.element_at(F.array(*(F.lit(a) for a in url_filters.ACTIONS)), (F.conv(F.substring(F.md5(name.cast("binary")), 9, 6), 16, 10).cast("long") % 3 + 1).cast("int"))
    entries = dated.select("kind", "key", action.alias("action"), _day(name, 366).alias("listed_at"))
    return url_filters.evaluate(captures, entries).select("page_id", "fetched_at", "host", "verdict", "matched_kind", "matched_key", "active_from")


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, url,
    DATE '2024-01-01' + CAST(('0x' || substr(md5('fetch:' || CAST(page_id AS VARCHAR)), 1, 8))::UBIGINT % 366 AS INTEGER) AS fetched_at,
    nullif(regexp_replace(lower(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1), '^.*@|:[0-9]*$', '')), '\.$', ''), '') AS host,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
listed AS (
  SELECT DISTINCT kind, key FROM (
    SELECT 'domain' AS kind, host AS key FROM p
    UNION ALL SELECT 'domain', regexp_replace(host, '^[^.]+\.', '') FROM p
    UNION ALL SELECT 'prefix', host || '/' || split_part(CASE WHEN path = '' THEN '/' ELSE path END, '/', 2) FROM p) WHERE key IS NOT NULL),
dated AS (SELECT kind, key, k, kind || ':' || key || ':' || CAST(k AS VARCHAR) AS name FROM listed CROSS JOIN (VALUES (0), (1), (2)) AS t(k)),
entries AS (
  SELECT kind, lower(key) AS key,
    list_extract(['allow', 'block', 'drop'], CAST(('0x' || substr(md5(name), 9, 6))::UBIGINT % 3 + 1 AS INTEGER)) AS action,
    DATE '2024-01-01' + CAST(('0x' || substr(md5(name), 1, 8))::UBIGINT % 366 AS INTEGER) AS listed_at
  FROM dated),
one AS (
  SELECT kind, key, listed_at, arg_max(action, CASE action WHEN 'block' THEN 2 WHEN 'allow' THEN 1 ELSE 0 END) AS action
  FROM entries GROUP BY ALL),
spans AS (SELECT kind, key, action, listed_at AS valid_from, lead(listed_at) OVER (PARTITION BY kind, key ORDER BY listed_at) AS valid_to FROM one),
hits AS (
  SELECT p.page_id, s.action, s.kind, s.key, s.valid_from,
    row_number() OVER (PARTITION BY p.page_id ORDER BY s.kind DESC, length(s.key) DESC) AS place
  FROM p JOIN spans s ON p.fetched_at >= s.valid_from AND (s.valid_to IS NULL OR p.fetched_at < s.valid_to) AND s.action <> 'drop'
    AND CASE WHEN s.kind = 'domain' THEN s.key = p.host OR s.key = regexp_replace(p.host, '^[^.]+\.', '') OR (ends_with(p.host, '.' || s.key) AND contains(s.key, '.'))
      ELSE s.key = lower(p.host || '/' || split_part(p.path, '/', 2)) END)
SELECT p.page_id, p.fetched_at, p.host, coalesce(h.action, 'allow') AS verdict, h.kind AS matched_kind, h.key AS matched_key, h.valid_from AS active_from
FROM p LEFT JOIN hits h ON p.page_id = h.page_id AND h.place = 1
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), fold_of(F.col("doc_id"), 4)
    model = language_id.train(docs.where(fold != 2))
    return language_id.identify(docs.select("doc_id", "text"), model).select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


OP5_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT * FROM e WHERE label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM s a JOIN s b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM e JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_back(spark, table(spark, sf_dir, "pages"))
    size = F.coalesce(F.length("payload").cast("long"), F.col("size"))
    digest = F.coalesce(F.sha2("payload", 256), F.col("digest"))
    return read.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT d.page_id, d.payload_bytes, d.payload_digest, CASE WHEN d.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN d.page_id > f.first THEN f.first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.trim(F.regexp_replace("kept_text", r"[\x20\x09-\x0D]+", " "))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(kept.cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
h AS (
  SELECT doc_id, unnest(generate_series(1, len(w) - 49)) AS pos,
    unnest(list_transform(generate_series(1, len(w) - 49), lambda i: md5(array_to_string(list_slice(w, i, i + 49), ' ')))) AS h
  FROM d WHERE len(w) >= 50),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(pos, pos + 49)) AS pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY h) AS first FROM h) WHERE doc_id > first),
word AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS pos, unnest(w) AS w FROM d),
left_over AS (SELECT doc_id, string_agg(w, ' ' ORDER BY pos) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(l.n, 0) AS n_removed, sha256(coalesce(l.t, '')) AS kept_sha256
FROM d LEFT JOIN left_over l ON l.doc_id = d.doc_id
"""


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coder = byte_bpe.Coder(byte_bpe.read_ranks(tokenizer_path(BYTE_BPE)), public_tokenizers.PATTERN)
    out = byte_bpe.encode_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), coder)
    return out.select("doc_id", "n_tokens", F.sha2(F.col("ids").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = materialize(quality_rules.with_stats(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), keep_text=False), "rule-stats")
    cutoffs = quality_rules.calibrate(stats, table(spark, sf_dir, "labels"))
    return quality_rules.verdict(stats, cutoffs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _op9_sql() -> str:
    """The counts, the path of joint cutoffs and the binomial tests in SQL, for ids that occur once."""
    rules, limits = quality_rules.RULES, quality_rules.Limits()
    steps, lifts = quality_rules.STEPS, ", ".join(f"{x}::DOUBLE" for x in quality_rules.LIFTS)
    grid = ", ".join(f"{c}::DOUBLE" for c in quality_rules.GRID)
    ratios = " UNION ALL ".join(f"SELECT doc_id, stratum, role, '{r}' AS rule, {a} / greatest({b}, 1)::DOUBLE AS x FROM held" for r, (a, b) in rules.items())
    counts = ", ".join(f"any_value({c}) AS {c}" for c in quality_rules.STATS)
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, unnest(generate_series(1, len(w) - 2)) AS pos, unnest(list_transform(generate_series(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 2), ' '))) AS g FROM w WHERE len(w) > 2),
twice AS (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
covered AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest([pos, pos + 1, pos + 2]) AS pos FROM twice WHERE n > 1) GROUP BY doc_id),
s AS (
  SELECT w.doc_id, stratum, md5(t) AS digest, len(w.w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(l) AS n_lines, len(list_filter(w.w, lambda x: regexp_matches(x, '[!?][!?]'))) AS n_marks
  FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id),
b AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM s),
said AS (SELECT doc_id, min(quality) AS q FROM labels WHERE quality IN (0, 1) GROUP BY doc_id HAVING min(quality) = max(quality)),
labelled AS (SELECT b.*, q FROM b JOIN said ON said.doc_id = b.doc_id),
sure AS (SELECT doc_id FROM labelled GROUP BY doc_id HAVING min(digest) = max(digest)),
held AS (
  SELECT digest AS doc_id, stratum, CASE WHEN min(q) = 0 THEN 'bad' WHEN ('0x' || substr(digest, 1, 8))::UBIGINT % 5 = 0 THEN 'design' ELSE 'good' END AS role, {counts}
  FROM labelled SEMI JOIN sure USING (doc_id) WHERE NOT base_failed GROUP BY digest, stratum HAVING min(q) = max(q)),
enough AS (SELECT stratum FROM held WHERE role = 'good' GROUP BY stratum HAVING count(*) >= {math.ceil(math.log(limits.delta) / math.log1p(-limits.alpha))}),
x AS (SELECT r.* FROM ({ratios}) r SEMI JOIN enough USING (stratum)),
cut AS (SELECT unnest(generate_series(1, {len(quality_rules.GRID)})) AS k, unnest([{grid}]) AS c),
share AS (
  SELECT stratum, rule, k, any_value(c) AS c, (count(*) FILTER (role = 'design' AND x > c) + 1) / (count(*) FILTER (role = 'design') + 1)::DOUBLE AS plain,
    count(*) FILTER (role = 'bad' AND x > c) / greatest(count(*) FILTER (role = 'bad'), 1)::DOUBLE AS bad
  FROM x CROSS JOIN cut GROUP BY stratum, rule, k),
t AS (SELECT unnest(generate_series(1, {steps})) AS t, unnest([{lifts}]) AS lift),
fit AS (SELECT stratum, rule, t, max(bad) FILTER (bad >= lift * plain AND bad > 0) AS most FROM share CROSS JOIN t GROUP BY stratum, rule, t),
path AS (
  SELECT f.stratum, f.rule, t, coalesce(max(c) FILTER (bad >= {limits.catch}::DOUBLE * most), 'inf'::DOUBLE) AS cutoff
  FROM share s JOIN fit f ON f.stratum = s.stratum AND f.rule = s.rule GROUP BY f.stratum, f.rule, t),
first AS (SELECT doc_id, x.stratum, role, coalesce(min(t) FILTER (x > cutoff), {steps + 1}) AS first FROM x JOIN path p ON p.stratum = x.stratum AND p.rule = x.rule WHERE role <> 'design' GROUP BY ALL),
hit AS (SELECT stratum, t, count(*) FILTER (role = 'good') AS n, count(*) FILTER (role = 'good' AND first <= t) AS k, count(*) FILTER (role = 'bad' AND first <= t) AS caught FROM first CROSS JOIN t GROUP BY stratum, t),
tail AS (
  SELECT stratum, t, caught, k >= n AS all_of, list_sum(list_transform(generate_series(0, k), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({limits.alpha}::DOUBLE) + (n - i) * ln(1 - {limits.alpha}::DOUBLE)))) AS p FROM hit),
failed AS (SELECT stratum, min(t) AS t FROM tail WHERE all_of OR p > {limits.delta}::DOUBLE / (SELECT count(DISTINCT stratum) FROM path) GROUP BY stratum),
certified AS (SELECT tail.stratum, tail.t, caught, max(caught) OVER (PARTITION BY tail.stratum) AS most FROM tail LEFT JOIN failed f ON f.stratum = tail.stratum WHERE f.t IS NULL OR tail.t < f.t),
chosen AS (SELECT stratum, min(t) AS t FROM certified WHERE caught >= {limits.catch}::DOUBLE * most GROUP BY stratum),
final AS (SELECT p.stratum, p.rule, p.cutoff FROM path p JOIN chosen ON chosen.stratum = p.stratum AND chosen.t = p.t),
over AS (SELECT DISTINCT r.doc_id FROM ({ratios.replace(", role,", ", 0 AS role,").replace("FROM held", "FROM b")}) r JOIN final f ON f.stratum = r.stratum AND f.rule = r.rule WHERE r.x > f.cutoff)
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND over.doc_id IS NULL AS kept
FROM b LEFT JOIN over ON over.doc_id = b.doc_id
"""


OP9_SQL = _op9_sql()


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(WORD_BPE))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP11_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op12_late_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of conversations as events of users; both the time and the lateness come from crc32 sums."""
    turns = table(spark, sf_dir, "conversations").where("turn is not null and conv_id is not null")
    crc = lambda text: F.crc32(text.cast("binary"))
    conv = F.col("conv_id").cast("string")
    rows = turns.select("conv_id", "turn", crc(conv).alias("c"), crc(F.concat(conv, F.lit(":"), F.col("turn").cast("string"))).alias("h"))
    seconds = F.floor(F.col("c") / 2) % 7200 + 300 * F.col("turn") + F.col("h") % 600
    g = F.floor(F.col("h") / 600)
    late = F.when(g % 3 == 0, g % 4).otherwise(0)
    timed = rows.select((2 * F.floor(F.col("conv_id") / 8) + F.col("c") % 2).alias("user"), seconds.alias("seconds"), late.alias("late"), F.col("h").alias("weight"))
    return late_sessions.versions(timed.withColumn("batch", F.floor(F.col("seconds") / late_sessions.BATCH_SECONDS) + F.col("late")).drop("late"))


def _crc32_sql(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit: a byte goes in, then eight shifts."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda x: [ord(x)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {steps}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END), 4294967295::BIGINT)"


OP12_SQL = f"""
WITH c AS (SELECT conv_id, turn, {_crc32_sql("CAST(conv_id AS VARCHAR)")} AS c, {_crc32_sql("CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR)")} AS h FROM conversations WHERE turn IS NOT NULL AND conv_id IS NOT NULL),
t AS (SELECT CAST(2 * floor(conv_id / 8.0) AS BIGINT) + c % 2 AS u, c // 2 % 7200 + 300 * turn + h % 600 AS s, h // 600 AS g, h FROM c),
e AS (SELECT u, s, h, CAST(floor(s / 1800.0) AS BIGINT) + CASE WHEN g % 3 = 0 THEN g % 4 ELSE 0 END AS batch FROM t),
snap AS (SELECT DISTINCT u, batch AS b FROM e),
r AS (SELECT snap.u, b, s, h, batch, CASE WHEN s - lag(s) OVER (PARTITION BY snap.u, b ORDER BY s) <= 240 THEN 0 ELSE 1 END AS cut FROM snap JOIN e ON e.u = snap.u AND e.batch <= b),
k AS (SELECT *, sum(cut) OVER (PARTITION BY u, b ORDER BY s) AS k FROM r),
v AS (SELECT u, b, min(s) AS s0, max(s) AS s1, count(*) AS n_events, count(*) FILTER (batch = b) AS n_new, CAST(sum(h) AS BIGINT) AS h_sum FROM k GROUP BY u, b, k HAVING count(*) FILTER (batch = b) > 0),
link AS (
  SELECT v.u, v.b, v.s0, w.b AS rb, w.s0 AS rs FROM v JOIN v w ON w.u = v.u AND w.b > v.b AND w.s0 <= v.s0 AND w.s1 >= v.s1
  QUALIFY row_number() OVER (PARTITION BY v.u, v.b, v.s0 ORDER BY w.b) = 1),
n AS (SELECT u, rb, rs, count(*) AS n FROM link GROUP BY ALL)
SELECT v.u AS "user", v.b AS batch, v.s0 AS start_s, v.s1 AS end_s, n_events, n_new, coalesce(n.n, 0) AS n_retracted, h_sum, link.rb AS retracted_batch, link.rs AS retracted_start_s
FROM v LEFT JOIN link ON link.u = v.u AND link.b = v.b AND link.s0 = v.s0 LEFT JOIN n ON n.u = v.u AND n.rb = v.b AND n.rs = v.s0
"""


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    listed, dim = whitening.fit_list(vectors)
    model, most = whitening.fit(listed, dim), min(4, dim)
    if model is None:
        return spark.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = whitening.identity_error(listed, model, most)
    rows = whitening.whiten(vectors, model, most).select("vec_id", "deviation", F.posexplode("whitened").alias("pos", "whitened"))
    shares = F.array(*(F.lit(None if math.isnan(x) else float(x)).cast("double") for x in model.explained[:most]))
    return rows.select("vec_id", (F.col("pos") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("pos")).alias("explained"), F.lit(error).alias("identity_error"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_url_filters": op3_url_filters,
    "op4_language_id": op4_language_id,
    "op5_embedding_near_dedup": op5_embedding_near_dedup,
    "op6_warc": op6_warc,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality_rules": op9_quality_rules,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_exact_dedup": op11_exact_dedup,
    "op12_late_sessions": op12_late_sessions,
    "op13_embedding_whitening": op13_embedding_whitening,
}

ORACLE_SQL: dict[str, str] = {"op3_url_filters": OP3_SQL, "op5_embedding_near_dedup": OP5_SQL, "op6_warc": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op9_quality_rules": OP9_SQL, "op11_exact_dedup": OP11_SQL, "op12_late_sessions": OP12_SQL}
