import random

import pytest
from pyspark.sql import functions as F

from siftwork.functions import exprs


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_stable_seed_column_equals_value(spark):
    rows = [("a", "λ"), ("sample", ""), ("x|y", "z")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = [r[0] for r in df.select(exprs.stable_seed(17, F.col("a"), F.col("b"), "use")).collect()]
    assert got == [exprs.stable_seed_value(17, a, b, "use") for a, b in rows]


def test_stable_seed_tells_types_apart():
    seeds = [exprs.stable_seed_value(*c) for c in ((1,), (True,), ("1",), (b"1",), (1.0,), (None,), (), ("a", "b"), ("ab",))]
    assert len(set(seeds)) == len(seeds) and all(0 <= s < 2**63 for s in seeds)
    with pytest.raises(ValueError):
        exprs.stable_seed_value(float("nan"))


def test_hamming_of_hex(spark):
    rng = random.Random(3)
    pairs = [(rng.getrandbits(64), rng.getrandbits(64)) for _ in range(50)] + [(0, 2**64 - 1)]
    df = spark.createDataFrame([(f"{a:016x}", f"{b:016x}") for a, b in pairs], "a string, b string")
    got = [r[0] for r in df.select(exprs.hamming(exprs.hash_halves(F.col("a")), exprs.hash_halves(F.col("b")))).collect()]
    assert got == [(a ^ b).bit_count() for a, b in pairs]


def test_scalars(spark):
    s = lambda x: F.lit(x)
    r = one(spark, exprs.sigmoid(s(-800.0)), exprs.sigmoid(s(800.0)), exprs.sigmoid(s(0.0)), exprs.missing(s(" \t")), exprs.missing(F.lit(None).cast("string")), exprs.number(s("x")), exprs.resized(s(5.0), 0.5), exprs.resized(s(7.0), 0.5), exprs.half_up_count(s(5.0), 0.5), exprs.blur_kernel_size(s(0.5)))
    assert tuple(r) == (0.0, 1.0, 0.5, True, True, None, 2, 4, 3, 5)
    r = one(spark, *(exprs.safe_relative_path(s(p)) for p in ("a/b", "../a", "/a", "c:x", "a\\..\\b", "", "a..b/c")))
    assert tuple(r) == (True, False, False, False, False, False, True)
    assert one(spark, exprs.html_escaped(s("<a href=\"x\">'&")))[0] == exprs.html_escaped_value("<a href=\"x\">'&")
    assert one(spark, exprs.heading_section(s("# t\n## One\nx\ny\n## Two\nz"), "One"))[0].strip() == "x\ny"
    assert exprs.normalized_filename_value("Fake°.PNG") == exprs.normalized_filename_value("fake-¦.png")


def test_learning_rate(spark):
    rate = [one(spark, exprs.learning_rate_factor(F.lit(i), 10, 100))[0] for i in (0, 9, 10, 55, 100)]
    assert rate == pytest.approx([0.1, 1.0, 1.0, 0.5, 0.0])


def test_order_bucket_never_falls(spark):
    import math
    import random

    rng = random.Random(4)
    near = [0.0, 5e-324, 1e-300, 0.25, 0.5, 0.75, 1.0, 2.0, 1e300, math.inf]
    xs = [*near, *(math.nextafter(x, -math.inf) for x in near), *(math.nextafter(x, math.inf) for x in near), *(rng.random() for _ in range(300)), *(1 - rng.random() ** 9 for _ in range(300)), *(rng.gauss(0, 5) for _ in range(300))]
    xs += [-x for x in xs]
    rows = spark.createDataFrame([(None,), (math.nan,), *((x,) for x in xs)], "x double").select("x", exprs.order_bucket(F.col("x")).alias("b")).orderBy("x").collect()
    buckets = [r["b"] for r in rows]
    assert buckets == sorted(buckets) and len(set(buckets)) > 800 and all(b is not None for b in buckets)
