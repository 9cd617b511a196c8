"""What large tables need: work dealt over tasks, and no broadcast on an estimate."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from findery.plans import corpora, registry


def test_rows_of_one_small_file_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    spark.range(100).withColumn("p", F.lit("x")).coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    assert corpora.spread(rows, "id").rdd.getNumPartitions() == 1
    monkeypatch.setattr(corpora, "TASK_ROWS", 30)
    assert corpora.spread(rows, "id").rdd.getNumPartitions() == 4
    assert sorted(r.id for r in corpora.spread(rows, "id").collect()) == list(range(100))
    records = corpora.part_records(spark, entry.SMOKE_DIR)
    assert records.rdd.getNumPartitions() == -(-spark.read.parquet(f"{entry.SMOKE_DIR}/part.parquet").count() // 30)


def test_postings_are_not_broadcast_on_an_estimate(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    plan = registry.QUERIES["loose_documents"](spark, entry.SMOKE_DIR)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    own = registry.measured(spark)
    assert own.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1" and own.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold") == before
    assert own.conf.get("spark.sql.session.timeZone") == spark.conf.get("spark.sql.session.timeZone")
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == before


@pytest.mark.parametrize("name", ["keyword_postings", "field_postings"])
def test_postings_are_grouped_where_the_files_were_dealt(spark, monkeypatch, name):
    whole = registry.QUERIES[name](spark, entry.SMOKE_DIR).collect()
    monkeypatch.setattr(corpora, "TASK_ROWS", 30)
    dealt = registry.QUERIES[name](spark, entry.SMOKE_DIR)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    below = plan[plan.index("Exchange") :]
    assert "split(" not in below and "- Filter" not in below  # nothing is parsed before the files are dealt
    assert sorted(whole) == sorted(dealt.collect()) and whole


def test_a_single_reader_deals_to_few_tasks_first(spark, monkeypatch):
    whole = registry.QUERIES["vocabulary_df"](spark, entry.SMOKE_DIR).collect()
    monkeypatch.setattr(corpora, "TASK_ROWS", 30)
    monkeypatch.setattr(corpora, "READER_TASKS", 3)
    dealt = registry.QUERIES["vocabulary_df"](spark, entry.SMOKE_DIR)
    plan = dealt._jdf.queryExecution().executedPlan().toString()
    last = plan[plan.rindex("Exchange") :]
    assert "hashpartitioning(p_partkey" in last and ", 3), REPARTITION_BY_NUM" in last  # the reader's own dealing
    assert plan.count("REPARTITION_BY_NUM") == 2
    assert sorted(whole) == sorted(dealt.collect()) and whole
