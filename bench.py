"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))

from pyspark.sql import SparkSession  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from findery.config import Config  # noqa: E402
from findery.operators import postings, search  # noqa: E402
from findery.plans import registry  # noqa: E402
from findery.plans.corpora import PART_RULES, RANKING, part_files, part_records  # noqa: E402
from findery.sources.store import Store, index_files  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = ("parse_part_corpus", "field_postings", "keyword_postings", "text_vocabulary", "facet_extension", "change_detection", "incremental_upsert", "loose_vocab_pairs", "feedback_field_stats")


def timed(f) -> float:
    start = time.time()
    f()
    return round(time.time() - start, 3)


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    consume(registry.QUERIES["facet_folder"](spark, SF))  # the session is warm from here on
    took = {name: timed(lambda n=name: consume(registry.QUERIES[n](spark, SF))) for name in HEADLINE}

    # searches over an index that is in memory, as a service would hold it
    records = part_records(spark, SF).cache()
    index = search.Index(records, postings.field_postings(records).cache(), postings.keyword_postings(records).cache())
    took["postings_build"] = timed(lambda: [x.count() for x in (records, index.fields, index.keywords)])
    index = index.cache()
    vocabulary = index.tokens.count()

    def one(text):
        return search.search_one(text, index, PART_RULES, RANKING, top=3)

    one("warm up P-0001")
    texts = {"search_narrow": "P-0117", "search_wide": "brand 7", "search_fuzzy_warm": "wigets anvill"}
    for name, text in texts.items():
        took[name] = min(timed(lambda t=text: one(t)) for _ in range(3))
    words = [t for _, t in registry.BATCH if t != "zzzz qqqq"]
    hundred = [(k, f"{words[k % len(words)]} P-{k * 37 % 2000:04d}") for k in range(100)]
    asked = registry.queries_frame(spark, hundred)
    tokens = search.parse_queries(asked, PART_RULES).select(F.explode("keywords")).distinct().count()
    took["search_batch_100"] = timed(lambda: consume(search.search(asked, index, PART_RULES, RANKING, top=3)))

    # the index on disk: all new, nothing new, one percent new
    store, config = Store(spark, registry.scratch(spark, "bench")), Config(rules=PART_RULES)
    files = part_files(spark, SF).cache()

    def reindex(now, changed):
        seen = files.select("file_path", F.when(changed, 2.0).otherwise(1.0).alias("mtime"), F.col("p_partkey").cast("long").alias("size"))
        index_files(store, seen, "parts", config, now)

    for name, changed in (("100", F.lit(False)), ("0", F.lit(False)), ("1", F.col("p_partkey") % 100 == 0)):
        took[f"reindex_{name}_percent"] = timed(lambda n=name, c=changed: reindex(f"t{n}", c))
    counts = {"vocabulary_pairs_100_queries": tokens * vocabulary, "records": records.count(), "records_written_at_1_percent": store.snapshot().rows[-1], "queries_per_second_batch": round(100 / took["search_batch_100"], 2)}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "counts": counts, "sf": SF}))


if __name__ == "__main__":
    main()
