"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust their score.

DataFrame functions only. Positions come from splitting a text by the pattern that is also extracted: pieces and
matches alternate, so running lengths give the code points. Groups repeat possessively, which Java runs as a loop.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.plans.lineage import sealed


@dataclass(frozen=True)
class Kind:
    """One kind of personal data. ``cheap`` must match any text that ``pattern`` can match; ``base`` scores the bare form."""

    name: str
    pattern: str
    cheap: str
    base: float
    context: tuple[str, ...]


# Patterns of the kinds (the first four as documented, written so that no scan is quadratic) and context words.
LOCAL = "A-Za-z0-9._%+-"
KINDS = (
    Kind("email", rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0.9, ("mail", "contact", "write", "kontakt", "correo", "courriel")),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]++\.[0-9]++\.", 0.7, ("ip", "host", "server", "address", "adresse", "login")),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", 0.7, ("card", "visa", "payment", "karte", "carte", "tarjeta")),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", 0.7, ("phone", "call", "tel", "mobile", "telefon", "teléfono")),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", 0.5, ("iban", "bank", "account", "konto", "compte", "cuenta")),
)
#: Kinds whose confirmed spans always count; spans of the others need a score.
BASE = ("email", "ip", "card", "phone")


@dataclass(frozen=True)
class PersonalData:
    """``window``: characters on either side in which a context word counts; ``bonus``: what it adds to the score.

    ``min_score`` rules out spans of kinds beyond the base ones, such as account numbers without context at 0.6.
    """

    kinds: tuple[Kind, ...] = KINDS
    window: int = 48
    bonus: float = 0.3
    min_score: float = 0.5


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn checksum."""
    padded = F.lpad(digits, 19, "0")
    places = F.array(*[F.lit(i) for i in range(1, 20)])

    def worth(i: Column) -> Column:
        d = F.substring(padded, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.transform(places, worth), F.lit(0), lambda s, x: s + x) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number without blanks has the remainder 1 by 97, its first four characters moved to the end."""
    moved = F.concat(F.substr(code, F.lit(5)), F.substring(code, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        at = F.ascii(c)
        return F.when(at < 65, (rest * 10 + at - 48) % 97).otherwise((rest * 100 + at - 55) % 97)

    return F.aggregate(F.filter(F.split(moved, ""), lambda x: x != ""), F.lit(0), step) == 1


def _confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
        return match.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return mod97(F.replace(match, F.lit(" "), F.lit("")))
    return F.lit(True)


def _scored(proposed: Column, k: int, kind: Kind, config: PersonalData) -> Column:
    """The proposed (start, match) pairs that a checksum confirms and whose score is high enough, as spans."""

    def span(x: Column) -> Column:
        end = x["s"] + F.length(x["h"])
        before = F.substring(F.col("text"), F.greatest(x["s"] - config.window, F.lit(0)) + 1, F.least(x["s"], F.lit(config.window)))
        near = F.lower(F.concat(before, F.lit(" "), F.substring(F.col("text"), end + 1, F.lit(config.window))))
        close = near.rlike(r"(?<!\p{L})(?:" + "|".join(kind.context) + ")")
        score = F.least(F.lit(1.0), F.lit(kind.base) + F.when(close, F.lit(config.bonus)).otherwise(F.lit(0.0)))
        return F.struct(x["s"].alias("start"), F.lit(k).alias("order"), F.lit(kind.name).alias("kind"), end.alias("end"), score.alias("score"))

    kept = F.filter(proposed, lambda x: _confirmed(kind.name, x["h"]))
    spans = F.transform(kept, span)
    return spans if kind.name in BASE else F.filter(spans, lambda x: x["score"] >= config.min_score)


#: Matches that are added up in one go; starts are then shifted block by block, so that no array grows by one at a time.
BLOCK = 256


def _starts(gaps: Column, hits: Column) -> Column:
    """The start of each match: the lengths of all gaps and matches before it."""
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("g"), hits.alias("h"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / BLOCK).cast("int")), lambda b: F.slice(pairs, b * BLOCK + 1, F.lit(BLOCK)))
    none = F.struct(F.lit(0).alias("end"), F.array().cast("array<int>").alias("starts"))
    inner = F.transform(blocks, lambda block: F.aggregate(block, none, lambda s, x: F.struct(
        (s["end"] + x["g"] + F.length(x["h"])).alias("end"), F.concat(s["starts"], F.array(s["end"] + x["g"])).alias("starts"))))
    begin = F.struct(F.lit(0).alias("end"), F.array().cast("array<array<int>>").alias("starts"))
    return F.flatten(F.aggregate(inner, begin, lambda s, x: F.struct(
        (s["end"] + x["end"]).alias("end"), F.concat(s["starts"], F.array(F.transform(x["starts"], lambda v: v + s["end"]))).alias("starts")), lambda s: s["starts"]))


def _of_kind(kind: str) -> Column:
    return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")


def find_spans(docs: DataFrame, config: PersonalData = PersonalData()) -> DataFrame:
    """``docs`` with text (null: empty) and spans: array of (start, kind number, kind, end, score), sorted.

    Starts and ends are code points from 0, ends exclusive. Spans of one kind never overlap; those of different kinds
    may. Works row by row; other columns pass through untouched.
    """
    df = docs.withColumn("text", F.coalesce("text", F.lit("")))
    names = []
    for k, kind in enumerate(config.kinds):
        some = F.col("text").rlike(kind.cheap)
        hits, gaps, at = f"__{kind.name}_hits", f"__{kind.name}_gaps", f"__{kind.name}_at"
        df = df.withColumn(hits, F.when(some, F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0))))
        df = df.withColumn(gaps, F.when(F.size(hits) > 0, F.transform(F.split("text", kind.pattern, -1), F.length)))
        df = df.withColumn(at, F.when(F.size(hits) > 0, _starts(F.col(gaps), F.col(hits))))
        proposed = F.arrays_zip(F.col(at).alias("s"), F.col(hits).alias("h"))
        name = f"__{kind.name}"
        df = df.withColumn(name, F.when(F.size(hits) > 0, _scored(proposed, k, kind, config)))
        df = df.drop(hits, gaps, at)
        names.append(name)
    empty = F.array().cast("array<struct<start:int,order:int,kind:string,end:int,score:double>>")
    spans = F.sort_array(F.concat(*[F.coalesce(F.col(n), empty) for n in names]))
    return df.withColumn("spans", spans).drop(*names)


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, config: PersonalData = PersonalData()) -> DataFrame:
    """Per document: counts of the four base kinds, digest of their spans and all spans as kind:start:end.

    Null and empty texts have no spans; repeated rows give repeated rows; the base kinds count whatever their score.
    """
    found = sealed(find_spans(docs.select("doc_id", "text"), config), "doc_id", "spans")
    own = F.filter("spans", lambda x: x["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        *[_of_kind(k).alias(f"n_{k}") for k in BASE],
        F.sha2(span_text(own), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0)).alias("max_score"),
    )


def redact(docs: DataFrame, config: PersonalData = PersonalData()) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; overlapping spans become one, named by the first.

    A null text stays null. All columns of the input stay, in their order; n_chars, where there is one, follows the new text.
    """
    inside = docs.select(F.struct(*docs.columns).alias("row"), F.col("text"))
    found = find_spans(inside, config)
    start = F.struct(F.lit(0).alias("done"), F.array().cast("array<string>").alias("parts"))

    def step(s: Column, x: Column) -> Column:
        fresh = x["start"] >= s["done"]
        piece = F.concat(F.substring(F.col("text"), s["done"] + 1, x["start"] - s["done"]), F.lit("<"), x["kind"], F.lit(">"))
        return F.struct(F.greatest(s["done"], x["end"]).alias("done"), F.when(fresh, F.concat(s["parts"], F.array(piece))).otherwise(s["parts"]).alias("parts"))

    done = found.withColumn("__cut", F.when(F.size("spans") > 0, F.aggregate("spans", start, step)))
    text = F.when(F.col("__cut").isNull(), F.col("text")).otherwise(F.concat(F.array_join(F.col("__cut")["parts"], ""), F.substr(F.col("text"), F.col("__cut")["done"] + 1)))
    done = done.withColumn("__new", F.when(F.col("row.text").isNotNull(), text))
    changed = {"text": F.col("__new"), "n_chars": F.when(F.size("spans") > 0, F.length("__new").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return done.select(*[changed[c].alias(c) if c in changed else F.col("row")[c].alias(c) for c in docs.columns])
