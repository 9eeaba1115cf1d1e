import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 2 and [r["rank"] for r in sorted(rows, key=lambda r: r["rank"])] == [1, 2]


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_queries_run_at_smoke_scale(spark):
    cheap = ["profile_interactions", "pivot_priorities_wide", "sequences_events", "split_temporal",
             "topk_per_user_history", "novel_urls_conversations"]
    qs = E.queries()
    for name in cheap:
        assert qs[name](spark, E.SMOKE_DIR).count() >= 0


def test_entry_schema_is_stable(spark):
    df = E.entry(spark)
    assert df.dtypes == [("model_id", "string"), ("precision_at_10", "double"), ("recall_at_10", "double"),
                         ("map_at_10", "double"), ("ndcg_at_10", "double"), ("mrr_at_10", "double"),
                         ("rank", "bigint")]
