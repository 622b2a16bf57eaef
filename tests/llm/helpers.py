"""Small tables with the awkward cases of the contracts, and plain versions of what operators share."""

import random
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return [w.lower() for w in WORD.findall((text or "").encode())]


def prose(rng, n, size=400):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(2 + int(rng.random() ** 2 * 8))) if rng.random() < 0.7 else rng.choice(["the", "of", "und", "été"]) for _ in range(n))


def table(spark, rows, extra=False):
    """(doc_id, text) rows with, if wanted, further columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string")
    if extra:
        df = df.select(F.lit(1).alias("key"), F.lit("x").alias("fp"), "text", F.lit(None).cast("string").alias("h"), "doc_id", F.lit(2.0).alias("score"), F.lit(0).alias("cell"), F.lit(5).alias("start"))
    return df


def awkward(seed=1):
    """Nulls, empty and long texts, repeated rows and ties."""
    rng = random.Random(seed)
    base = [prose(rng, rng.choice([1, 2, 3, 5, 40, 200])) for _ in range(40)]
    rows = list(enumerate(base))
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, prose(rng, 5000)), (104, base[3]), (105, base[3]), (106, "A a A"), (107, "ÄÖ ß"), (107, "ÄÖ ß"), (108, base[5].upper()), (None, base[7]), (None, None), (109, "x" * 3000), (110, base[9] + "\n" + base[10])]
    return rows


def components(nodes, linked):
    """{node: least node reachable} for a test of pairs."""
    label = {x: x for x in nodes}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                ra, rb = root(a), root(b)
                label[max(ra, rb)] = min(ra, rb)
    return {x: root(x) for x in nodes}
