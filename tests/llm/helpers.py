"""Tables that hold the awkward cases, and their brute-force readings."""

import random

from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=120):
    """Texts of a small vocabulary with copies, near copies, nulls, empty and one very long text."""
    rng = random.Random(seed)
    words = [a + b for a in ("Ta", "ri", "mo", "éx", "ul") for b in ("ne", "so", "KA", "fi", "lo", "bé")]
    out = []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.15:
            text = rng.choice(out)
        elif out and kind < 0.45:
            parts = (rng.choice(out) or "").split()
            for _ in range(rng.randint(0, 2)):
                if parts:
                    parts[rng.randrange(len(parts))] = rng.choice(words)
            text = " ".join(parts)
        else:
            text = rng.choice([" ", "\n", "\t "]).join(rng.choice(words) for _ in range(rng.randint(1, 60)))
        out.append(text)
    out += [None, "", " \n\t", "One", "one TWO", " ".join(rng.choice(words) for _ in range(30_000))]
    return [(i, t, "en", rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(out)]


def frame(spark, rows, extra=True):
    """Documents, with columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, DOCS)
    if not extra:
        return df
    names = ("label", "block", "shard", "component_id", "score", "node", "tile", "h", "count", "copies", "word", "size", "target", "mark", "ids")
    return df.withColumns({c: F.lit(7) for c in names})
