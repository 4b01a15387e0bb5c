"""Inference where a probability differs in its last digits each time that it is found, as sums do on a cluster."""

import random

from pyspark.sql import functions as F

from tidemark.plans import proteins as X


def wavering(df, *names):
    shake = F.udf(lambda x: x * (1.0 + random.random() * 1e-12), "double").asNondeterministic()
    return df.withColumns({n: shake(n) for n in names})


def test_calls_that_waver_are_all_kept(spark):
    calls = spark.range(500).select(F.concat(F.when(F.col("id") % 3 == 0, "DECOY").otherwise("P"), F.col("id").cast("string")).alias("pro"), ((F.col("id") + 1) / 600).alias("accPEP"))
    calls = wavering(calls.select("pro", "accPEP", (100 - F.col("accPEP") * 90).alias("conf"), F.when(F.col("pro").startswith("D"), -1).otherwise(1).alias("label")), "accPEP", "conf")
    out = X.with_fdr(calls).collect()
    assert len(out) == 500 and len({r.pro for r in out}) == 500
    want = {f"P{i}": (1 + i // 3 + 1) / (1 + i - i // 3) for i in (1, 4, 499)}
    assert {r.pro: round(r.fdr, 9) for r in out if r.pro in want} == {k: round(x, 9) for k, x in want.items()}
    cpx = spark.createDataFrame([(1, "P1"), (1, "P499"), (2, "P4")], "cpxId int, pro string")
    assert len({r.pro for r in X.refined(calls, cpx).collect()}) == 500
