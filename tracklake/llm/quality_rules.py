"""Rule-based quality filter with distribution-divergence tests (built-in functions only).

Each document gives two histograms: of character classes and of common words. The
reference of a language is the sum over all its documents that pass the base rules.
A document is rejected if it breaks a base rule, or if it is long enough and the
Jensen-Shannon distance (base 2, so 0 to 1) of either histogram to its reference is
above its limit. Most words are not common ones, so even a text without any common word is not far from a
reference; the limit for words is a share of just that distance (``silence``), which each language's
reference gives. A language whose reference hardly uses the listed words has a small ``silence`` and
is not judged by words.

Repeated word windows are found within the row: windows are hashed, the (hash, place)
pairs sorted, and equal neighbours mark the words they cover. Nothing is exploded and
no text is shuffled; only the per-language sums are.

Defined cases: a null text counts as empty and fails the base rule; a null language is a
language of its own; an empty table gives an empty result; repeated rows each get a
row; extra input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracklake.llm.common import let, spool

#: Frequent function words of English, German, French and Spanish.
COMMON_WORDS = "the of and in that der die und den von de la les et des el los que con para".split()
CHAR_CLASSES = ("upper", "digit", "space", "punct", "symbol", "rest")
SPACE = r"[\x20\x09-\x0D]"


def _left(text: Column, drop: str) -> Column:
    """How many characters stay once those that match ``drop`` are gone."""
    return F.length(F.regexp_replace(text, drop, "")).cast("long")


def _marked(places: Column, n: int) -> Column:
    """Words covered by n-word windows at the given ascending places."""
    step = F.transform(places, lambda p, i: F.least(F.lit(n), F.coalesce(F.get(places, i + 1) - p, F.lit(n))))
    return F.aggregate(step, F.lit(0), lambda a, x: a + x)


def _repeated(windows: Column) -> Column:
    """Ascending places of the window hashes that stand in the array more than once."""

    def neighbours(pairs):
        same = lambda p, i: F.coalesce(F.get(pairs, i)["h"] == p["h"], F.lit(False))
        return F.filter(pairs, lambda p, i: same(p, i - 1) | same(p, i + 1))

    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.sort_array(F.transform(let(pairs, neighbours), lambda p: p["i"]))


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The base counts and both histograms of every document.

    One projection after the other, so that each array is made once and the functions
    that are not higher-order run as generated code.
    """
    n = 5
    forms = COMMON_WORDS + [w.capitalize() for w in COMMON_WORDS]
    small_gone = "_rest"
    key = ["doc_id", "lang"]
    cut = docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")
    ).select(
        *key,
        F.length("_t").cast("long").alias("_chars"),
        F.array_remove(F.split("_t", f"{SPACE}+"), "").alias("_w"),
        F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
        # most characters are small letters: once they are gone, the classes are counted on what is left
        F.regexp_replace("_t", "[a-z]+", "").alias(small_gone),
    )
    hashed = cut.select(
        *key,
        "_chars",
        F.size("_w").cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_w", lambda w: F.xxhash64(w)).alias("_h"),
        F.transform(F.filter("_w", lambda w: w.isin(forms)), lambda w: F.lower(w)).alias("_found"),
        *[
            _left(F.col(small_gone), drop).alias(f"_{c}")
            for c, drop in (
                ("upper", r"[^\p{Lu}]+"),
                ("digit", r"[^0-9]+"),
                ("space", r"[^\x20\x09-\x0D]+"),
                ("punct", r"[^.,;:!?'\"()]+"),
                ("symbol", r"[^#*$%&|<>]+"),
            )
        ],
    )
    at = lambda i, k: F.get(F.col("_h"), i + k)
    windowed = hashed.withColumn(
        "_win",
        F.when(
            F.col("n_words") > n,
            F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - n), lambda i: F.xxhash64(*[at(i, k) for k in range(n)])),
        ).otherwise(F.array().cast("array<bigint>")),
    ).drop("_h")
    counted = windowed.withColumn("_single", F.size(F.array_distinct("_win")) == F.size("_win"))
    counts = [(F.size("_found") - F.size(F.array_remove("_found", w))).cast("long") for w in COMMON_WORDS]
    classes = [F.col(f"_{c}") for c in CHAR_CLASSES[:-1]]
    return (
        counted.select(
            *key,
            "n_words",
            (F.col("_chars") - F.col("_space")).alias("word_chars"),
            F.col("_symbol").alias("n_symbols"),
            "n_dup_lines",
            F.when(F.col("_single"), F.lit(0)).otherwise(let(_repeated(F.col("_win")), lambda p: _marked(p, n))).cast("long").alias("n_repeat_words"),
            F.array(*classes, F.col("_chars") - sum(classes, F.lit(0).cast("long"))).alias("classes"),
            F.array(*counts, F.greatest(F.lit(0).cast("long"), F.col("n_words") - F.size("_found"))).alias("commons"),
        )
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance, base 2, of two count arrays; 0 if either is empty."""

    def total(a):
        return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x).cast("double")

    def half(x, m):
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def both(v):
        terms = F.zip_with(
            v["p"],
            v["q"],
            lambda a, b: let(
                F.struct((a / v["s"]).alias("a"), (b / v["t"]).alias("b"), ((a / v["s"] + b / v["t"]) / 2).alias("m")),
                lambda x: half(x["a"], x["m"]) + half(x["b"], x["m"]),
            ),
        )
        div = F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2
        return F.when((v["s"] > 0) & (v["t"] > 0), F.sqrt(F.greatest(F.lit(0.0), div))).otherwise(F.lit(0.0))

    return let(F.struct(p.alias("p"), q.alias("q"), total(p).alias("s"), total(q).alias("t")), both)


def quality_rules(
    docs: DataFrame,
    *,
    min_words: int = 50,
    max_class_distance: float = 0.3,
    min_common_words: int = 120,
    max_silence: float = 0.8,
    least_silence: float = 0.15,
) -> DataFrame:
    """Counts, both distances, ``silence``, ``base_failed`` and ``kept`` for every document.

    Classes are judged from ``min_words`` words on, common words from ``min_common_words`` on: shorter texts hold too
    few of them by chance. The limit for words is ``max_silence`` times the distance of a text without a common word.
    """
    stats = spool(base_counts(docs))
    sums = lambda col, n: F.array(*[F.sum(F.get(F.col(col), F.lit(i))) for i in range(n)])
    refs = (
        stats.where(~F.col("base_failed"))
        .groupBy(F.col("lang").alias("_lang"))
        .agg(sums("classes", len(CHAR_CLASSES)).alias("_classes"), sums("commons", len(COMMON_WORDS) + 1).alias("_commons"))
    )
    zero = F.lit(0.0)
    none = F.array(*[F.lit(0).cast("long")] * len(COMMON_WORDS), F.lit(1).cast("long"))
    refs = refs.withColumn("_silence", js_distance(none, F.col("_commons")))
    far = (F.col("n_words") >= min_words) & (F.col("class_distance") > max_class_distance)
    mute = (F.col("n_words") >= min_common_words) & (F.col("silence") >= least_silence) & (F.col("word_distance") > max_silence * F.col("silence"))
    return (
        stats.join(refs, F.col("lang").eqNullSafe(F.col("_lang")), "left")
        .withColumn("class_distance", F.coalesce(js_distance(F.col("classes"), F.col("_classes")), zero))
        .withColumn("word_distance", F.coalesce(js_distance(F.col("commons"), F.col("_commons")), zero))
        .withColumn("silence", F.coalesce(F.col("_silence"), zero))
        .withColumn("kept", ~F.col("base_failed") & ~far & ~mute)
        .select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance", "silence"
        )
    )
