"""Quality rules: base counts and Jensen-Shannon distances to language references, in DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.plans.lineage import sealed

# White space of a word boundary, and the characters that count as symbols.
SPACE = r"[ \t\n\x0B\f\r]"
SYMBOLS = "#*$%&|<>"

# Usual shares of character classes in running text, in the order
# a-z, white space, A-Z, sentence marks, Latin letters beyond ASCII, other ASCII, everything else. Digits say nothing
# about a language and stay out.
CLASS_SHARES = {
    "en": (0.794, 0.165, 0.022, 0.017, 0.000, 0.001, 0.001),
    "de": (0.769, 0.140, 0.032, 0.018, 0.039, 0.001, 0.001),
    "fr": (0.749, 0.160, 0.022, 0.020, 0.047, 0.001, 0.001),
    "es": (0.759, 0.160, 0.022, 0.018, 0.039, 0.001, 0.001),
}
# Frequent function words of each language, most frequent first.
COMMON_WORDS = {
    "en": "the of and to in is that for it on with as be this was are from by an a".split(),
    "de": "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als in".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas avec".split(),
    "es": "de la que el en y los se del las un por con no una su para es al lo".split(),
}


@dataclass(frozen=True)
class QualityRules:
    """Limits of the rules; ``common_share`` is the share of running words that the common words make up."""

    min_words: int = 20
    window: int = 8
    repeat_percent: int = 30
    min_chars_for_classes: int = 200
    min_words_for_words: int = 60
    max_class_distance: float = 0.17
    max_word_distance: float = 0.44
    common_share: float = 0.40
    languages: tuple[str, ...] = field(default=("en", "de", "fr", "es"))


def word_reference(lang: str, common_share: float) -> list[float]:
    """Shares of the common words (falling with their rank) and, last, of all other words."""
    ranks = [1 / (i + 2) for i in range(len(COMMON_WORDS[lang]))]
    return [common_share * r / sum(ranks) for r in ranks] + [1 - common_share]


def js_distance(counts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of an array of counts to a reference; null where the counts are all 0."""
    total = F.aggregate(counts, F.lit(0.0), lambda s, x: s + x)
    ref = F.array(*[F.lit(float(x)) for x in reference])

    def term(x: Column) -> Column:
        p, q = x["0"] / x["2"], x["1"]
        mid = (p + q) / F.lit(2.0)
        return F.when(p > 0, p * F.ln(p / mid)).otherwise(0.0) + F.when(q > 0, q * F.ln(q / mid)).otherwise(0.0)

    rows = F.arrays_zip(counts.alias("0"), ref.alias("1"), F.array_repeat(total, len(reference)).alias("2"))
    parts = F.transform(rows, term)
    jsd = F.aggregate(parts, F.lit(0.0), lambda s, x: s + x) / F.lit(2 * math.log(2))
    return F.when(total > 0, F.sqrt(F.greatest(jsd, F.lit(0.0))))


def base_counts(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` (null text: empty) with words, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, row by row."""
    w = rules.window
    df = docs.withColumn("text", F.coalesce("text", F.lit("")))
    df = df.withColumn("words", F.filter(F.split("text", SPACE + "+"), lambda x: x != ""))
    df = df.withColumn("n", F.size("words"))
    df = df.withColumn(
        "grams",
        F.when(
            F.col("n") >= w,
            F.transform(F.sequence(F.lit(0), F.col("n") - w), lambda i: F.xxhash64(*[F.get("words", i + j) for j in range(w)])),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn("repeats", F.size(F.array_distinct("grams")) < F.size("grams"))
    df = df.withColumn("order", F.when(F.col("repeats"), F.sort_array(F.transform("grams", lambda x, i: F.struct(x.alias("g"), i.alias("i"))))))

    def twice(i: Column) -> Column:
        at = lambda k: F.get("order", k)["g"]
        same = F.coalesce(at(i) == at(i + 1), F.lit(False)) | F.when(i > 0, at(i) == at(i - 1)).otherwise(False)
        return F.when(same, F.get("order", i)["i"]).otherwise(-1)

    places = F.sort_array(F.filter(F.transform(F.sequence(F.lit(0), F.size("order") - 1), twice), lambda p: p >= 0))
    df = df.withColumn("places", F.when(F.col("repeats"), places))
    steps = F.transform("places", lambda p, i: F.least(F.lit(w), F.coalesce(F.get("places", i + 1) - p, F.lit(w))))
    df = df.withColumn("n_repeat_words", F.when(F.col("repeats"), F.aggregate(steps, F.lit(0), lambda s, x: s + x)).otherwise(0))
    df = df.withColumn("lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.regexp_replace(x, SPACE + "+", "")) > 0))
    gap = F.length(F.regexp_replace("text", SPACE + "+", ""))
    return df.select(
        *[c for c in df.columns if c in docs.columns],
        "words",
        F.col("n").cast("long").alias("n_words"),
        gap.cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.col("n_repeat_words").cast("long").alias("n_repeat_words"),
    )


#: Steps that strip one class of characters after another; each class counts what its step removed.
CLASS_STEPS = (
    ("lower", "[a-z]+"),
    ("space", SPACE + "+"),
    ("upper", "[A-Z]+"),
    ("digit", "[0-9]+"),
    ("mark", r"[.,;:!?'\"()-]+"),
    ("latin", "[À-ɏ]+"),
    ("ascii", r"[\x00-\x7F]+"),
)


def _judge(docs: DataFrame, rules: QualityRules) -> DataFrame:
    """``docs`` with base counts, distances, base_failed and kept."""
    df = base_counts(docs, rules)
    steps = CLASS_STEPS
    df = df.withColumn("rest0", F.col("text"))
    for i, (_, pattern) in enumerate(steps):
        df = df.withColumn(f"rest{i + 1}", F.regexp_replace(f"rest{i}", pattern, ""))
    sizes = [F.length(f"rest{i}") for i in range(len(steps) + 1)]
    counts = [(sizes[i] - sizes[i + 1]).cast("double") for i, (kind, _) in enumerate(steps) if kind != "digit"] + [sizes[-1].cast("double")]
    df = df.withColumn("classes", F.array(*counts))
    listed = sorted({w for lang in rules.languages for w in COMMON_WORDS[lang]})
    df = df.withColumn("low", F.transform("words", F.lower))
    df = df.withColumn("common", F.concat(F.lit(" "), F.array_join(F.filter("low", lambda x: x.isin(listed)), "  "), F.lit(" ")))
    has = lambda w: ((F.length("common") - F.length(F.replace("common", F.lit(f" {w} "), F.lit("")))) / (len(w) + 2)).cast("double")
    df = df.withColumns({f"has_{w}": has(w) for w in listed})
    near = lambda cols: F.least(*cols) if len(cols) > 1 else cols[0]
    df = df.withColumns({f"own_{x}": F.array(*[F.col(f"has_{w}") for w in COMMON_WORDS[x]]) for x in rules.languages})
    rest = lambda x: F.greatest(F.col("n_words") - F.aggregate(f"own_{x}", F.lit(0.0), lambda s, v: s + v), F.lit(0.0))
    df = df.withColumns({f"hist_{x}": F.concat(F.col(f"own_{x}"), F.array(rest(x))) for x in rules.languages})
    df = df.withColumns({f"word_{x}": js_distance(F.col(f"hist_{x}"), word_reference(x, rules.common_share)) for x in rules.languages})
    df = df.withColumns({f"class_{x}": js_distance(F.col("classes"), list(CLASS_SHARES[x])) for x in rules.languages})
    df = df.withColumn("class_distance", F.round(near([F.col(f"class_{x}") for x in rules.languages]), 6))
    df = df.withColumn("word_distance", F.round(near([F.col(f"word_{x}") for x in rules.languages]), 6))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.repeat_percent * F.col("n_words"))
    odd = (
        (F.length("text") >= rules.min_chars_for_classes) & (F.coalesce("class_distance", F.lit(1.0)) > rules.max_class_distance)
    ) | ((F.col("n_words") >= rules.min_words_for_words) & (F.coalesce("word_distance", F.lit(1.0)) > rules.max_word_distance))
    return df.withColumn("base_failed", failed).withColumn("kept", ~failed & ~odd)


RESULT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance")


def quality_rules(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Per document: doc_id, base counts, distances to the nearest language reference, base_failed and kept.

    base_failed: fewer than ``min_words`` words, or more than ``repeat_percent`` of the words lie in windows of
    ``window`` words found twice. kept: not base_failed, and no distance above its limit; a distance counts only for
    texts of at least ``min_chars_for_classes`` characters or ``min_words_for_words`` words, so short texts pass.
    The language column is not trusted: the nearest of all references counts. Null and empty texts have no words and
    fail; repeated rows are judged one by one; other columns of the input are ignored. Every step works within
    its row, so no key can be hot.
    """
    return sealed(_judge(docs.select("doc_id", "text"), rules), "doc_id", *RESULT)


def kept_rows(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns as they are, whatever their names."""
    inside = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    return sealed(_judge(inside, rules), "row", "kept").where("kept").select("row.*")
