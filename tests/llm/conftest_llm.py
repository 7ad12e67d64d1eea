"""Generated texts and tables for the operator tests."""

WORDS = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me", "no", "pa", "ri", "su", "te") for b in ("ra", "len", "mo", "st", "vi")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def clashing(spark, rows, schema):
    """Rows with further columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, schema)
    names = ["fp", "score", "counts", "n_lines", "line", "high", "key", "keys", "uid", "length", "anomaly", "hash", "node", "count", "_h", "_id", "_k", "_text", "_lines"]
    return df.select("*", *(F.lit(k).alias(c) for k, c in enumerate(names) if c not in df.columns))
