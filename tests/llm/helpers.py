"""Documents with every awkward case, beside the given ones."""

import random
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

DOCS = "doc_id long, text string, lang string, source string, n_chars long, item_id string"


def awkward(spark, sf):
    """The table of documents with null and empty texts, long ones, copies, ties, repeated rows and a column of a clashing name."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], "x") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(10_000, None, "en", "src1", None, None), (10_001, "", None, None, 0, None), (10_002, "!! 12 --", "en", "src1", 8, None), (10_003, "One two", "en", None, 7, None)]
    rows += [(10_004, "ONE\ttwo", None, "Z", 7, None), (None, "one two three four", "en", "src1", 1, None), (10_005, "one two three four", "en", "src1", 1, None)]
    rows += [(10_006, " ".join(rng.choice(vocabulary) for _ in range(30_000)), "en", "src1", 1, None)]
    for i in range(40):
        copy = list(base)
        for _ in range(i % 4):
            copy[rng.randrange(len(copy))] = "changed"
        rows.append((20_000 - i, " ".join(copy).upper() if i % 2 else "  ".join(copy), "de", "src0", 1, None))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    rows += [(10_010, f"start {item} end", "en", "src2", 1, None), (10_011, " ".join(re.findall(r"\w+", item)[:9]), "en", "src2", 1, None), (10_012, " ".join(re.findall(r"\w+", item)[2:12]) + " z", "en", "src2", 1, None)]
    rows += [rows[5], rows[5], (7, "another text with an id that is there already", "en", "src3", 1, None)]
    return spark.createDataFrame(rows, DOCS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
