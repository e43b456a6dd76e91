"""Quality rules by distribution divergence, in DataFrame operations only.

Method
------
A document becomes two histograms: shares of character classes (upper case, digits,
sentence marks, symbols, other marks, white space, the rest) and shares of common words.
Language references are the mean histograms of the corpus's documents by ``lang``, over all
documents that pass the base rules. A document is kept when the Jensen-Shannon distance
to the nearest reference is small for both histograms. References are learned twice, the
second time without documents that lie far from all first ones. Short documents have noisy word
histograms, so these are only held against documents of enough words. How far a word histogram may
lie follows from its reference: less far than a text without any common word lies. A reference
that hardly has common words says nothing that way and excuses the documents of its own language only
(that of all documents: those without a language).

The most frequent languages' references are compared with every document; a document of any other
language meets its own reference by a join, so that no language goes without one.

Repetition is counted inside each row: windows of three words are hashed to 64 bits and
sorted, equal neighbours mark their positions, and marked positions are unrolled to words.

Edge cases
----------
Null text has no words; it and blank texts fail the base rule. Null ids, null languages
(pooled into the reference of all documents) and repeated rows are judged like any other.
With no document to learn a reference from, the base rules decide. Only the named columns are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailsift.llm.common import materialize

#: Frequent function words of four languages.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "with"),
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "ist"),
    "fr": ("de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "por"),
}
WORDS = tuple(dict.fromkeys(w for words in COMMON.values() for w in words))
#: Largest distance (0 to 1) of a kept document's characters, and the words it needs for the word rule.
MAX_CHAR_DISTANCE, MIN_COMMON_WORDS = 0.30, 100
#: Its largest word distance, as a share of the distance of a text without common words; references
#: for which that distance is below the second value (common words of about 4 % and less) don't decide.
VOID_SHARE, MIN_VOID_DISTANCE = 0.9, 0.14
#: A document that is beyond both of these goes too: odd marks and hardly a common word.
BOTH_CHAR_DISTANCE, BOTH_WORD_DISTANCE = 0.18, 0.25
#: Documents farther than this from every first reference don't shape the second ones.
TRIM_CHAR_DISTANCE, TRIM_WORD_DISTANCE = 0.12, 0.24
#: The references of this many languages, the most frequent ones, are compared with all documents.
COMPARED_LANGUAGES = 64
_SPACE = r"[\x20\x09-\x0D]+"
_CLASSES = 7


def _sum_of(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)


def _repeated(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: words in three-word windows that the row's ``words`` hold twice or more."""
    at = lambda a, i: F.get(a, i)
    df = df.withColumn("windows", F.when(F.col("n_words") >= 3, F.transform(
        F.sequence(F.lit(0), (F.col("n_words") - 3).cast("int")),
        lambda i: F.xxhash64(at(F.col("words"), i), at(F.col("words"), i + 1), at(F.col("words"), i + 2)))))
    df = df.withColumn("ranked", F.sort_array("windows"))
    df = df.withColumn("twice", F.exists(
        F.sequence(F.lit(1), F.greatest(F.size("ranked") - 1, F.lit(1))),
        lambda i: F.coalesce(at(F.col("ranked"), i) == at(F.col("ranked"), i - 1), F.lit(False))))
    df = df.withColumn("ordered", F.when(F.col("twice"), F.sort_array(F.transform(
        "windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    hash_at = lambda i: F.get(F.col("ordered"), i)["h"]
    df = df.withColumn("marked", F.sort_array(F.transform(F.filter(
        "ordered", lambda x, i: F.coalesce((i > 0) & (hash_at(i - 1) == x["h"]), F.lit(False))
        | F.coalesce(hash_at(i + 1) == x["h"], F.lit(False))), lambda x: x["i"])))
    # A marked window covers three words, less those the next marked window starts in.
    covered = F.transform("marked", lambda p, j: F.least(
        F.lit(3), F.coalesce(F.get(F.col("marked"), j + 1) - p, F.lit(3))).cast("long"))
    return df.withColumn("n_repeat_words", F.when(F.col("twice"), _sum_of(covered)).otherwise(F.lit(0).cast("long")))


def measures(docs: DataFrame, id_col: str, text_col: str, lang_col: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, lang, base measures, chars, common): histograms as shares, one pass over the texts.

    ``carry`` names further columns to keep, as one struct ``carried``.
    """
    kept = [F.col(id_col).alias("id"), F.col(lang_col).alias("lang")]
    if carry:
        kept.append(F.struct(*carry).alias("carried"))
    df = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    df = df.withColumn("words", F.array_remove(F.split("text", _SPACE), ""))
    # What is neither small letter nor white space: a few hundredths of ordinary text.
    df = df.withColumn("odd", F.regexp_replace("text", r"[a-z\s\p{Ll}\p{Lo}\p{Lm}\p{M}]+", ""))
    df = df.withColumn("n_words", F.size("words").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("words", "")).cast("long"))
    df = df.withColumn("n_chars", F.length("text").cast("long"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("lines", lines)
    df = df.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
    spelled = sorted({*WORDS, *(w[0].upper() + w[1:] for w in WORDS)})
    df = df.withColumn("hits", F.filter("words", lambda w: w.isin(*spelled)))
    df = _repeated(df)
    df = df.withColumn("hits", F.concat(F.lit(" "), F.lower(F.array_join("hits", "  ")), F.lit(" ")))
    odd = {c: F.regexp_count("odd", F.lit(p)).cast("long") for c, p in (
        ("upper", r"\p{Lu}"), ("digit", "[0-9]"), ("stop", r"[.,;:?'\"()-]"), ("n_symbols", r"[#*$%&|<>]"))}
    df = df.withColumns(odd | {"n_odd": F.length("odd").cast("long")})
    classes = [F.col("upper"), F.col("digit"), F.col("stop"), F.col("n_symbols"),
               F.col("n_odd") - F.col("upper") - F.col("digit") - F.col("stop") - F.col("n_symbols"),
               F.col("n_chars") - F.col("word_chars"),
               F.greatest(F.col("word_chars") - F.col("n_odd"), F.lit(0))]
    all_hits = F.length("hits")
    counts = [(all_hits - F.length(F.replace(F.col("hits"), F.lit(f" {w} "), F.lit("")))) / F.lit(len(w) + 2.0)
              for w in WORDS]
    df = df.withColumn("found", F.array(*counts))
    df = df.withColumn("found", F.concat("found", F.array(
        F.col("n_words") - F.aggregate("found", F.lit(0.0), lambda a, x: a + x))))
    share = lambda a, n: F.transform(a, lambda x: x / F.greatest(n, F.lit(1)))
    return df.select("id", "lang", *(["carried"] if carry else []), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                     share(F.array(*[c.cast("double") for c in classes]), F.col("n_chars")).alias("chars"),
                     share("found", F.col("n_words")).alias("common"))


def js_distance(p: Column, q: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two arrays of shares."""
    def half(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    parts = F.zip_with(p, q, lambda x, y: half(x, (x + y) / 2) + half(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def _to_each(column: str, table: Column) -> Column:
    return F.transform(table, lambda q: js_distance(F.col(column), q))


def word_limit(common: list[float]) -> float | None:
    """The largest word distance to a reference, None where it can't decide."""
    rest = common[-1]  # the share of words that are not common
    void = 0.0  # distance of a text without common words
    for p, q in [(0.0, x) for x in common[:-1]] + [(1.0, rest)]:
        m = (p + q) / 2
        void += sum(x * math.log2(x / m) for x in (p, q) if x > 0) / 2
    void = math.sqrt(max(void, 0.0))
    return VOID_SHARE * void if void >= MIN_VOID_DISTANCE else None


class References:
    """Mean histograms: ``near`` for all documents to be compared with, as (lang, chars, common, is_pooled),
    a bounded number of short arrays; ``others`` (or None) by language, for the documents of that language."""

    def __init__(self, measured: DataFrame):
        n = len(WORDS) + 1
        usable = measured.filter(~F.col("base_failed"))
        means = [F.array(*[F.avg(F.col("chars")[i]) for i in range(_CLASSES)]).alias("ref_chars"),
                 F.array(*[F.avg(F.col("common")[i]) for i in range(n)]).alias("ref_common")]
        by_lang = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), *means)
        rows = by_lang.orderBy(F.desc("n"), "lang").limit(COMPARED_LANGUAGES + 1).collect()
        self.others = None
        if len(rows) > COMPARED_LANGUAGES:
            rows.pop()
            self.others = materialize(by_lang.filter(F.col("lang").isNotNull() & ~F.col("lang").isin(
                [r["lang"] for r in rows if r["lang"] is not None])).select(
                "lang", "ref_chars", "ref_common"), "quality-references")
        self.near = [(r["lang"], r["ref_chars"], r["ref_common"], False) for r in rows]
        if rows:
            pooled = usable.agg(*means).collect()[0]
            self.near.append((None, pooled["ref_chars"], pooled["ref_common"], True))

    def compare(self, measured: DataFrame) -> DataFrame:
        """Adds char_distance and word_distance (to the nearest reference, 0 without any) and word_fine."""
        if not self.near:
            return measured.withColumns({"char_distance": F.lit(0.0), "word_distance": F.lit(0.0),
                                         "word_fine": F.lit(True)})
        tables = [F.array(*[F.array(*[F.lit(float(x)) for x in ref[k]]) for ref in self.near]) for k in (1, 2)]
        limits = []
        for lang, _, common, is_pooled in self.near:
            limit = word_limit(common)
            if limit is None:
                same = F.col("lang").isNull() if is_pooled else F.col("lang").eqNullSafe(F.lit(lang))
                limits.append(F.when(same, F.lit(1.0)).otherwise(F.lit(-1.0)))
            else:
                limits.append(F.lit(limit))
        distances = [_to_each("chars", tables[0]), _to_each("common", tables[1])]
        char_distance, word_distance = map(F.array_min, distances)
        fine = F.exists(F.zip_with(distances[1], F.array(*limits), lambda d, most: d <= most), lambda x: x)
        if self.others is not None:
            measured = measured.join(self.others, "lang", "left")
            has_own = F.col("ref_common").isNotNull()
            own = js_distance(F.col("common"), F.col("ref_common"))
            # The distance of a text without common words: all of its words are others.
            void = js_distance(F.array(*[F.lit(0.0)] * len(WORDS), F.lit(1.0)), F.col("ref_common"))
            char_distance = F.least(char_distance, F.when(has_own, js_distance(F.col("chars"), F.col("ref_chars"))))
            word_distance = F.least(word_distance, F.when(has_own, own))
            fine = fine | (has_own & ((own <= VOID_SHARE * void) | (void < MIN_VOID_DISTANCE)))
        return measured.withColumns({"char_distance": char_distance, "word_distance": word_distance,
                                     "word_fine": fine}).drop("ref_chars", "ref_common")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, [carried,] base measures, char_distance, word_distance, base_failed, kept): one row per document."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = materialize(measures(docs, id_col, text_col, lang_col, carry).withColumn("base_failed", failed), "quality")
    # Once with all documents, then without those far from every first reference, so that
    # junk does not colour what it is compared with.
    near = (F.col("char_distance") <= TRIM_CHAR_DISTANCE) & (F.col("word_distance") <= TRIM_WORD_DISTANCE)
    first = References(measured)
    known = References(first.compare(measured).filter(near))
    fine = (F.col("char_distance") <= MAX_CHAR_DISTANCE) & (
        (F.col("n_words") < MIN_COMMON_WORDS) | F.col("word_fine")) & ~(
        (F.col("char_distance") > BOTH_CHAR_DISTANCE) & (F.col("word_distance") > BOTH_WORD_DISTANCE))
    return (known if known.near else first).compare(measured).select(
        F.col("id").alias(id_col), *(["carried"] if carry else []), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "char_distance", "word_distance", "base_failed", (~F.col("base_failed") & fine).alias("kept"))
