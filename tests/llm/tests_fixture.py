import numpy as np


def corpus(spark, folder: str) -> set[int]:
    """Write documents, labels and benchmark; the ids that should be left."""
    words = [f"{a}{b}" for a in "stone river cloud field light house water green north table".split() for b in ("", "s", "ing", "ed")]
    prose = lambda seed: ". ".join(" ".join(np.random.default_rng(seed * 31 + k).choice(words, 12)) for k in range(6))
    rows, labels, left = [], [], set()
    for i in range(120):
        if i % 3 == 0:
            rows.append((i, "@@@ ### $$$ " * 30, "en", "s", 1))
            labels.append((i, 0, 0))
        elif i % 3 == 1:
            rows.append((i, prose(i) + " grubby vermin" * 3, "en", "s", 1))
            labels.append((i, 1, 1))
        else:
            rows.append((i, prose(i), "en", "s", 1))
            labels.append((i, 1, 0))
            left.add(i)
    secret = " ".join(f"q{k}uestion" for k in range(25))
    rows += [(500, prose(2) + " end", "en", "s", 1), (501, prose(900) + " " + secret, "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, secret)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return left
