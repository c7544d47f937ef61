import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import balance

RATIOS = [("italian", 0.5, 3), ("english", 0.3, 1), ("c_code", 0.2, 2), ("unknown", 0.0, 1), ("cpp_code", None, None)]


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(4)
    rows = []
    for source, n in (("italian_wiki", 300), ("english_web", 900), ("c_code", 400)):
        rows += [(len(rows) + i, source, int(4 * t), int(t)) for i, t in enumerate(rng.lognormal(5, 1, n).astype(int) + 1)]
    rows += [(9001, None, 5, 5), (9002, "italian_wiki", None, None), (9003, "english_web", 0, 0), (9004, "elsewhere", 9, 9)]
    counted = spark.createDataFrame(rows, "doc_id bigint, source string, n_chars bigint, n_tokens bigint")
    return counted, spark.createDataFrame(RATIOS, "category string, ratio double, max_repeats int")


def test_shares_are_met(tables):
    counted, ratios = tables
    records = balance.sized_records(counted, ratios)
    duals, total = balance.solve(records)
    drawn = balance.draw(records, duals).cache()
    out = {r.category: r for r in balance.shares(drawn, ratios).collect()}
    for name, ratio, cap in RATIOS[:3]:
        assert abs(out[name].token_share - ratio) < 0.01
        assert out[name].most_repeats <= cap
    assert out["unknown"].copies == out["cpp_code"].copies == 0
    assert abs(sum(r.token_share for r in out.values()) - 1) < 1e-9
    full = [k for k, d in duals.items() if d["full"]]
    assert full and all(drawn.where(F.col("category") == k).agg(F.min("copies") == F.max("copies")).first()[0] for k in full)
    assert drawn.where("abs(copies - rate) >= 1").count() == 0


def test_no_other_rates_are_nearer_to_the_base(tables):
    """Optimality: along random directions that keep tokens and documents, the relative entropy to the base only rises."""
    counted, ratios = tables
    records = balance.sized_records(counted, ratios)
    duals, _ = balance.solve(records, total=20_000)
    rng = np.random.default_rng(2)
    entropy = lambda w: (w * np.log(w) - w).sum()
    for name, d in duals.items():
        t = np.array([r.n_tokens for r in records.where(F.col("category") == name).collect()], float)
        w = np.exp(d["dual"][0] + d["dual"][1] * t / d["mean"])
        assert abs((w * t).sum() / t.sum() - d["rate"]) < 1e-4 and abs(w.mean() - d["rate"]) < 1e-4
        kept = np.linalg.qr(np.column_stack([np.ones_like(t), t]))[0]
        for _ in range(50):
            step = rng.normal(size=len(t))
            step -= kept @ (kept.T @ step)
            step *= 0.2 * w.min() / np.abs(step).max()
            assert entropy(w + step) > entropy(w) and entropy(w - step) > entropy(w)


@pytest.mark.parametrize("share", [0.001, 0.3, 0.97, 0.9999])
def test_rates_near_the_cap_converge(spark, share):
    rows = [(i, "c_code", 4 * t, t) for i, t in enumerate([3, 50, 50, 700, 9])]
    counted = spark.createDataFrame(rows, "doc_id bigint, source string, n_chars bigint, n_tokens bigint")
    records = balance.sized_records(counted, spark.createDataFrame([("c_code", 1.0, 4)], "category string, ratio double, max_repeats int"))
    duals, _ = balance.solve(records, total=int(812 * 4 * share))
    assert abs(np.exp(duals["c_code"]["dual"][0]) - int(812 * 4 * share) / 812) < 1e-4


def test_a_dual_that_does_not_converge_is_an_error(tables):
    records = balance.sized_records(*tables)
    with pytest.raises(RuntimeError):
        balance.solve(records, iterations=0, tolerance=1e-12)


def test_too_many_categories_are_refused(spark, tables):
    many = spark.range(balance.MOST_CATEGORIES + 1).selectExpr("concat('c', id) as category", "0.1D as ratio", "1 as max_repeats")
    with pytest.raises(ValueError):
        balance.sized_records(tables[0], many)


def test_a_ratio_per_category_alone_tilts_nothing(tables):
    """What the README states: the dual ends at (ln rate, 0), so all documents of a category have one rate."""
    counted, ratios = tables
    duals, _ = balance.solve(balance.sized_records(counted, ratios))
    open_ = [d for d in duals.values() if not d["full"]]
    assert open_ and all(np.allclose(d["dual"], (np.log(d["rate"]), 0), atol=1e-5) for d in open_)


def test_unreachable_totals_are_capped(tables):
    counted, ratios = tables
    records = balance.sized_records(counted, ratios)
    duals, _ = balance.solve(records, total=10**9)
    assert all(d["full"] for d in duals.values())
    out = {r.category: r for r in balance.shares(balance.draw(records, duals), ratios).collect()}
    assert out["italian"].copies == 3 * 300 and out["english"].copies == 900


def test_empty(tables):
    counted, ratios = tables
    records = balance.sized_records(counted.limit(0), ratios)
    duals, _ = balance.solve(records)
    assert [r.copies for r in balance.shares(balance.draw(records, duals), ratios).collect()] == [0] * 5
