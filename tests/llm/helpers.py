"""Small documents with every awkward case, and plain versions of shared definitions."""

import random
import re
import zlib

WORD = re.compile("[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5


def prose(rng, n, stem="lorem ipsum dolor sit amet the of and to in a is that it for on with".split()):
    return " ".join(rng.choice(stem) + (rng.choice(("", "", "s", "ing", "ed")) if rng.random() < 0.4 else "")
                    for _ in range(n))


def awkward(n=40, seed=0):
    """Rows of DOCS: ordinary texts, copies, and nulls, empties, ties, repeats and a long text."""
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randint(3, 150)) + ".\n" + prose(rng, 20), rng.choice(("en", "de")),
             rng.choice(("a", "b", "c", None)), None) for i in range(n)]
    rows += [(n, None, "en", "a", None), (n + 1, "", None, None, 0), (n + 2, " \t\n", "en", "b", None),
             (n + 3, "1 2 3 !!", None, "b", None), (None, "text without an id", "en", "a", None),
             (None, None, None, None, None), rows[0], rows[0], (n + 4, rows[1][1], "de", None, 1),
             (n + 5, "word " * 30000 + "end", "en", "a", None), (n + 6, "日本語 <|endoftext|> ²½ naïve", "en", "d", None)]
    return rows


def awkward_frame(spark, extra=True):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(awkward(), DOCS).repartition(3)
    if extra:  # names that the operators use themselves
        df = df.withColumns({c: F.lit(1) for c in ("id", "size", "mix", "label", "score", "kept", "words", "host")})
    return df
