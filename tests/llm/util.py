"""Fixtures with the awkward cases that every operator must stand."""

from pyspark.sql import types as T

AWKWARD = [
    (1, "The cat sat on the mat with the other cat.", "en", "s"),
    (1, "The cat sat on the mat with the other cat.", "en", "s"),
    (2, "The cat sat on the mat with the other cat.", None, "s"),
    (3, None, "en", None),
    (4, "", "de", "s"),
    (5, " \n\t ", None, "s"),
    (6, "12345 !!! 678", "en", "s"),
    (None, "Der Hund und die Katze sind im Haus und der Garten ist schön.", "de", "s"),
    (8, "word " * 30_000, "en", "hot"),
    (9, "x" * 70_000, "en", "hot"),
    (10, "Der Hund läuft durch den Wald und die Stadt.", "de", "s"),
]
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
    ]
)


def awkward(spark):
    """Documents with nulls, empty, blank, very long and repeated texts, and columns of clashing names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(AWKWARD, SCHEMA)
    names = ("n_chars", "score", "shard", "fp", "unit", "tokens", "chunk", "ids", "lang_pred", "digest", "key", "mask", "size", "n")
    return df.withColumns({c: F.lit(7) for c in names})


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def union_components(nodes, links):
    """Brute force: smallest node reachable."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
