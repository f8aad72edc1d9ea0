import duckdb
import pytest
from pyspark.sql import functions as F

from sparkfolio import registry
from sparkfolio.config import Bands, Settings
from sparkfolio.functions.numbers import half_away
from sparkfolio.operators import evaluation as E
from sparkfolio.operators.providers import Chain, GaveUp, RetryPolicy, call_with_retry
from sparkfolio.sources.files import corpus_lines


def test_floor_calibration_is_lexicographic(spark):
    rows = spark.createDataFrame([(True, 0.9), (True, 0.2), (True, 0.5), (False, 0.3), (False, 0.1)], "answerable boolean, best double")
    got = E.calibrate_floor(rows).first()
    assert (got["threshold"], got["wrong_answers"], got["wrong_refusals"]) == (0.4, 0, 1)


def test_retry_gives_up_for_reasons():
    waits = []
    flaky = iter([RuntimeError("503"), RuntimeError("503")])

    def call():
        error = next(flaky, None)
        if error:
            raise error
        return "ok"

    assert call_with_retry(call, lambda e: ("transient", 5.0), RetryPolicy(), waits.append) == "ok"
    assert waits == [5.0, 5.0]
    with pytest.raises(GaveUp) as e:
        call_with_retry(lambda: 1 / 0, lambda e: ("permanent", None), RetryPolicy(), waits.append)
    assert e.value.reason == "permanent"


def test_chain_fails_over_and_cools_down():
    def spent(_):
        raise RuntimeError("per day")

    chain = Chain({"a": spent, "b": lambda p: f"b:{p}"}, lambda e: ("daily_quota", None))
    assert chain.answer("x", 0.0, lambda s: None) == ("b:x", "b")
    assert chain.marks["a"] == 3600.0
    only = Chain({"a": spent}, lambda e: ("daily_quota", None))
    assert only.answer("x", 0.0, lambda s: None) == (None, None)


def test_configuration_checks_and_fingerprint():
    with pytest.raises(ValueError):
        Bands(high=0.4, moderate=0.5)
    with pytest.raises(ValueError):
        Settings(bands=Bands(high=0.4, moderate=0.3))
    assert Settings(primary_key=" ").primary_key is None
    assert Settings(primary_key="x").fingerprint() == Settings().fingerprint()
    assert Settings(near_duplicate_threshold=0.9).fingerprint() != Settings().fingerprint()


def test_chains_run_in_tasks_with_cooldown_and_failover(spark):
    from sparkfolio.operators.providers import generate

    def chain():
        def first(prompt):
            raise RuntimeError("daily" if "quota" in prompt else "busy" if "busy" in prompt else "bad")

        def second(prompt):
            if "nobody" in prompt:
                raise RuntimeError("bad")
            return prompt.upper()

        kinds = {"daily": "daily_quota", "busy": "transient", "bad": "permanent"}
        return Chain({"first": first, "second": second}, lambda e: (kinds[str(e)], None), RetryPolicy(attempts=2))

    rows = [(1, False, "bad a", "e1"), (2, False, "busy b", "e2"), (3, True, "c", "e3"), (4, False, "bad nobody", "e4"), (5, False, "quota d", "e5"), (6, False, "bad e", "e6")]
    df = spark.createDataFrame(rows, "id long, refused boolean, prompt string, evidence string").coalesce(1).sortWithinPartitions("id")
    got = {r["id"]: r for r in generate(df, chain, clock=lambda: 0.0, sleep=lambda s: None).collect()}
    assert [(got[i]["mode"], got[i]["text"], got[i]["provider"], got[i]["failover"]) for i in range(1, 7)] == [
        ("generated", "BAD A", "second", True), ("generated", "BUSY B", "second", True), ("refused", None, None, False),
        ("degraded", "e4", None, False), ("generated", "QUOTA D", "second", True), ("generated", "BAD E", "second", True),
    ]
    assert [got[i]["calls"] for i in range(1, 7)] == [{"first": 1, "second": 1}, {"first": 3, "second": 1}, {}, {"first": 1, "second": 1}, {"first": 1, "second": 1}, {"second": 1}]
    assert got[6]["errors"] == ["first: cooling"] and got[4]["errors"] == ["first: permanent", "second: permanent"]


def test_halves_are_rounded_as_in_sql(spark):
    """Every score of five places; those that end in 5 are halves at four places."""
    ours = spark.range(100_000).select("id", half_away(F.col("id") / 100_000, 4).alias("s"), half_away(-F.col("id") / 100_000, 4).alias("t"))
    theirs = duckdb.sql("SELECT i AS id, round(i / 100000::DOUBLE, 4) AS s, round(-i / 100000::DOUBLE, 4) AS t FROM range(100000) r(i)").fetchall()
    assert sorted(map(tuple, ours.collect())) == sorted(theirs)


@pytest.mark.parametrize("name", ["win_mid", "ev_cal", "top_floor", "agg_upmed"])
def test_scores_that_lie_densely(spark, tmp_path, name):
    spark.range(30_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality")).coalesce(1).write.parquet(str(tmp_path / "labels.parquet"))
    ours = registry.QUERIES[name](spark, str(tmp_path))
    theirs = duckdb.sql(registry.ORACLES[name].replace("FROM labels", f"FROM '{tmp_path}/labels.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, ours.collect())) == sorted(theirs)


def test_lines_of_a_pattern_are_read_in_parts(spark, tmp_path):
    """Large files are split among tasks; sub-folders, other suffixes and empty files give no lines."""
    folder = tmp_path / "files"
    (folder / "inner").mkdir(parents=True)
    for name, n in (("part-1.txt", 4000), ("part-2.txt", 3), ("part-3.txt", 0), ("part-4.json", 5), ("inner/part-5.txt", 7)):
        (folder / name).write_text("".join(f'{{"text":"line {i}\u2028 of {name}"}}\n' for i in range(n)), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        lines = corpus_lines(spark, str(folder), "part-*.txt")
        assert lines.rdd.getNumPartitions() > 4 and lines.count() == lines.distinct().count() == 4003
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_src_glob_never_holds_a_file(spark, tmp_path):
    spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("a\nb\r \u00e4 "), "id").alias("text")).write.parquet(str(tmp_path / "documents.parquet"))
    found = registry.QUERIES["src_glob"](spark, str(tmp_path))
    assert "content" not in found._jdf.queryExecution().executedPlan().toString()
    assert tuple(found.first()) == (3, 0, 50, sum(len(f"a\nb\r \u00e4 {i}") for i in range(50)))
