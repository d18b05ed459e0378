"""Operators against known answers, and every query with an oracle against DuckDB."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from ability_engine.functions import scalar
from ability_engine.operators import fit, frontier, ingest
from ability_engine.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rasch(spark, models, benches, seed=1):
    theta, delta = np.linspace(-1.8, 2.2, models), np.linspace(-1.4, 1.4, benches)
    rels = spark.createDataFrame([(f"m-{k:03}", k % 3, f"2024-{1 + k % 12:02}-01", None, "released") for k in range(models)], "release_id string, lab int, date string, tier string, status string").withColumn("date", F.col("date").cast("date"))
    dims = spark.createDataFrame([(f"b{k}", k, 1.0, False, True, "x") for k in range(benches)], "benchmark string, basket_pos int, weight double, legacy boolean, in_index boolean, preferred_config string")
    cells = [(f"m-{m:03}", f"b{b}", float(100 / (1 + math.exp(-(theta[m] - delta[b])))), "official", None, 0) for m in range(models) for b in range(benches)]
    scores = spark.createDataFrame(cells, "release_id string, benchmark string, value double, reported_by string, config string, score_pos int")
    asof = spark.createDataFrame([("2024-12-31",)], "d string").select(F.col("d").cast("date").alias("asof"))
    return theta, delta - delta.mean(), fit.fit(scores, rels, dims, asof, ridge=0.0)


def test_exact_recovery(spark):
    theta, delta, (models, deltas, _) = rasch(spark, 12, 7)
    assert [r.delta for r in deltas.orderBy("benchmark").collect()] == pytest.approx(delta.tolist(), abs=1e-9)
    got = models.orderBy("release_id").collect()
    assert [r.theta for r in got] == pytest.approx(theta.tolist(), abs=1e-9) and got[0].sigma < 1e-9


def test_normal_law(spark):
    rows = spark.range(-80, 81).select((F.col("id") / 10).alias("x")).select("x", scalar.normal_cdf("x").alias("p")).withColumn("z", scalar.normal_quantile("p")).collect()
    for r in rows:
        assert r.p == pytest.approx(math.erfc(-r.x / math.sqrt(2)) / 2, abs=1e-14)
        assert abs(r.x) > 6 or r.z == pytest.approx(r.x, abs=1e-6)


def test_same_day_knots(spark):
    rows = [("2024-01-02", "b", 50.0), ("2024-01-02", "a", 40.0), ("2024-01-02", "c", 45.0), ("2024-01-01", "z", 30.0), ("2024-02-01", "d", 50.0)]
    df = spark.createDataFrame([(d, r, 1, i, "flagship", True, "2025-01-01") for d, r, i in rows], "date string, release_id string, lab int, index double, tier string, qualified boolean, asof string").withColumns({c: F.col(c).cast("date") for c in ("date", "asof")})
    assert [r.release_id for r in frontier.line(df).orderBy("date", "release_id").collect()] == ["z", "a", "b"]


def test_html_to_text(spark):
    html = "<html><head><title>t</title></head><body><script>x</script><h1>A &amp; B</h1><p>one <b>two</b></p></body></html>"
    assert spark.range(1).select(ingest.html_to_text(F.lit(html)).alias("t")).first().t == "A & B\none two"


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plain(v):
    return repr(round(float(v), 5) + 0.0) if isinstance(v, float) else str(v)[:10] if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    found = con.execute(registry.ORACLES[name])
    at = [[c[0] for c in found.description].index(n) for n in names]
    want = sorted([plain(r[k]) for k in at] for r in found.fetchall())
    got = sorted([plain(r[n]) for n in names] for r in df.collect())
    assert got == want
    spark.catalog.clearCache()
