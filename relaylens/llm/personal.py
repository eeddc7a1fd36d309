"""Personal data: generators propose overlapping spans, boosted trees score them, calibrated thresholds select."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylens.llm import spans as S
from relaylens.llm.common import Scratch, text_of

KINDS = ("email", "ip", "card", "phone")
#: What the four kinds look like. Repeated groups are possessive, so that a long match needs no deep stack;
#: the look-behinds skip starts that cannot match when the run's first did not.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High-recall generators: spelled-out separators, numbers without their prefix, shorter and longer groups.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:@|[(\[]at[)\]])\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.])[0-9]{1,3}(?:[.,][0-9]{1,3}){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20.-]?[0-9]{3,4}){2,4}(?![0-9])",
    "phone": r"(?<![0-9(+])[(]?[0-9]{2,4}[)]?(?:[\x20./-][0-9]{2,4}){2,4}(?![0-9])",
}
CONTEXT = 24
#: Of the sampled candidates this share is held out from the trees.
HELD = 1 / 3
HINTS = {
    "email": r"(?i)\b(e-?mail|mail|contact|write)", "ip": r"(?i)\b(ip|host|server|address)",
    "card": r"(?i)\b(card|visa|master|amex|credit|payment)", "phone": r"(?i)\b(phone|tel|call|mobile|fax)",
}


@dataclass(frozen=True)
class Fit:
    """Bounds of the fit. ``per_class`` is the labelled candidates expected per kind and label in the sample of the trees,
    ``precision`` what all candidates above a threshold must reach, ``support`` how many held-out ones of them must be true."""

    per_class: int = 4000
    trees: int = 12
    depth: int = 4
    precision: float = 0.98
    support: int = 25
    seed: int = 7


def _luhn(hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    places = F.sequence(F.lit(1), F.greatest(F.length(digits), F.lit(1)))

    def value(i: Column) -> Column:
        # places count from the right; every second digit is doubled
        digit = F.ascii(F.substring(digits, F.length(digits) - i + 1, F.lit(1))) - 48
        doubled = F.when(digit * 2 > 9, digit * 2 - 9).otherwise(digit * 2)
        return F.when(i % 2 == 0, doubled).otherwise(digit)

    total = F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x)
    return F.length(digits).between(14, 19) & (total % 10 == 0)


def valid(kind: str, hit: Column) -> Column:
    """Whether a match of the base pattern counts."""
    if kind == "ip":
        part = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return hit.rlike(rf"^{part}(\.{part}){{3}}$")
    if kind == "card":
        # only a candidate of fitting length is summed
        return F.when(F.length(F.regexp_replace(hit, "[^0-9]", "")).between(14, 19), _luhn(hit)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(hit, "[^0-9]", "")).between(10, 15)
    return F.lit(True)


#: Characters of a candidate, least and most: longer runs of digits and dots are lists, which neither shape nor context tells apart.
LENGTHS = (6, 80)


def proposed(docs: DataFrame, lengths: tuple[int, int] = LENGTHS) -> DataFrame:
    """doc_id, same (a hash of the text), base spans per kind, and ``candidates``: every proposed span with its context.

    Spans shorter or longer than ``lengths`` are no candidates for the trees; base spans of any length stay.
    """
    text = F.col("text")
    rows = docs.select("doc_id", text_of().alias("text"))
    raw = rows.select(
        "doc_id", "text", F.xxhash64("text").alias("same"),
        *[S.matches(text, BASE[k]).alias(f"raw_{k}") for k in KINDS], *[S.matches(text, LOOSE[k]).alias(f"loose_{k}") for k in KINDS],
    )

    def with_context(kind: str) -> Column:
        def view(s: Column) -> Column:
            begin = F.greatest(s["start"] - CONTEXT, F.lit(0).cast("long"))
            return F.struct(
                F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"),
                F.substring(text, begin.cast("int") + 1, (s["start"] - begin).cast("int")).alias("before"),
                F.substring(text, s["end"].cast("int") + 1, F.lit(CONTEXT)).alias("after"),
            )

        every = F.array_distinct(F.concat(F.col(f"raw_{kind}"), F.col(f"loose_{kind}")))
        return F.transform(F.filter(every, lambda s: F.length(s["hit"]).between(*lengths)), view)

    def confirmed(kind: str) -> Column:
        return F.filter(f"raw_{kind}", lambda s: valid(kind, s["hit"])).alias(kind)

    return raw.select(
        "doc_id", "same",
        *[confirmed(k) for k in KINDS],
        F.concat(*[with_context(k) for k in KINDS]).alias("candidates"),
    )


def features(candidates: DataFrame) -> DataFrame:
    """Format and context of every candidate as numbers; what the base rules decide by is not among them."""
    hit, before, after = F.col("hit"), F.col("before"), F.col("after")

    def count(pattern: str) -> Column:
        return F.regexp_count(hit, F.lit(pattern)).cast("double")

    def flag(condition: Column) -> Column:
        return condition.cast("double")

    out = {
        "length": F.length(hit).cast("double"), "digits": count("[0-9]"), "letters": count("[A-Za-z]"), "spaces": count(" "),
        "dots": count("\\."), "dashes": count("-"), "parens": count("[()]"), "brackets": count("[\\[\\](]"), "groups": count("[0-9]+"),
        "at": count("@"), "plus": flag(hit.startswith("+")), "zero": flag(hit.startswith("0")), "one_digit": flag(hit.rlike("^([0-9])[^0-9]*(\\1[^0-9]*)+$")),
        "wide": flag(hit.rlike("[0-9]{9,}")), "space_before": flag(before.rlike("(^|[\\s])$")), "letter_before": flag(before.rlike("[A-Za-z]$")),
        "symbol_before": flag(before.rlike("[^\\sA-Za-z0-9]$")), "letter_after": flag(after.rlike("^[A-Za-z]")),
        "space_after": flag(after.rlike("^([\\s]|$)")), "symbol_after": flag(after.rlike("^[^\\sA-Za-z0-9]")),
        **{f"is_{k}": flag(F.col("kind") == k) for k in KINDS}, **{f"hint_{k}": flag(before.rlike(HINTS[k]) | after.rlike(HINTS[k])) for k in KINDS},
    }
    exprs = [e.alias(f"f_{n}") for n, e in out.items()]
    return candidates.select("doc_id", "same", "kind", "start", "end", "label", *exprs)


def _draw(*salt: str) -> Column:
    """A number in [0, 1) that depends on the candidate alone."""
    return F.pmod(F.xxhash64("doc_id", "same", "kind", "start", "end", *[F.lit(x) for x in salt]), F.lit(1 << 30)) / (1 << 30)


def fit(scored: DataFrame, scratch: Scratch, options: Fit = Fit()) -> tuple[GBTClassificationModel, dict[str, float]] | None:
    """Trees and a threshold per kind, from a bounded sample of labelled candidates; None where one label is missing.

    A candidate's label is whether the base rules confirm it. The trees see two thirds of the sample; all other candidates are
    scored, and count as many times as stands for the trees' part of their kind and label, so that the mix is the corpus's own.
    A kind's threshold is the lowest score above which they reach the precision; kinds that never do get no threshold.
    """
    sizes = {(r.kind, r.label): r.n for r in scored.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if {label for _, label in sizes} != {0.0, 1.0}:
        return None
    shares = {key: min(1.0, options.per_class / n) for key, n in sizes.items()}
    share = F.coalesce(*[F.when((F.col("kind") == kind) & (F.col("label") == label), F.lit(x)) for (kind, label), x in shares.items()])
    seed = str(options.seed)
    seen = (_draw("sample", seed) < share) & (_draw("held", seed) >= HELD)
    names = [c for c in scored.columns if c.startswith("f_")]
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    training = scratch.keep(scored.filter(seen), "training")
    if training.select("label").distinct().count() < 2:
        return None
    trees = GBTClassifier(maxIter=options.trees, maxDepth=options.depth, stepSize=0.2, seed=options.seed, maxBins=64)
    model = trees.fit(assembler.transform(training.orderBy("kind", "doc_id", "same", "start", "end").coalesce(1)))
    others = model.transform(assembler.transform(scored.filter(~seen)))
    scores = others.select("kind", "label", F.floor(vector_to_array("probability")[1] * 100).alias("bin"))
    counts = scores.groupBy("kind", "bin", "label").agg(F.count(F.lit(1)).alias("n")).collect()
    thresholds = {}
    for kind in KINDS:
        found = yes = n = 0
        steps = [r for r in counts if r.kind == kind]
        for at in sorted({r.bin for r in steps}, reverse=True):
            for r in (r for r in steps if r.bin == at):
                weighted = r.n / (1 - (1 - HELD) * shares[kind, r.label])
                found, yes, n = found + r.label * r.n, yes + r.label * weighted, n + weighted
            if found >= options.support and yes >= options.precision * n:
                thresholds[kind] = at / 100
    return model, thresholds


def personal_table(docs: DataFrame, options: Fit = Fit()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added of every document.

    Base spans always stay; candidates that the base rules do not confirm are added where their score reaches the kind's
    threshold and they overlap no base span of the kind. Null text counts as empty; rows that repeat a doc_id and text
    get the same spans; null ids are values like any other; where candidates of one label are missing (an empty table, say)
    nothing is added; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "personal")
    rows = scratch.keep(proposed(docs), "proposed")

    def keys(kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))

    own = F.concat(*[keys(k) for k in KINDS])
    every = rows.withColumn("own", own).select("doc_id", "same", "own", F.explode("candidates").alias("c")).select(
        "doc_id", "same", "c.*", F.array_contains("own", F.struct("c.kind", "c.start", "c.end")).cast("double").alias("label"),
    )
    scored = scratch.keep(features(every).dropDuplicates(["doc_id", "same", "kind", "start", "end"]), "features")
    fitted = fit(scored, scratch, options)
    tag = "array<struct<start:long,ord:int,kind:string,end:long>>"
    if fitted and fitted[1]:
        model, thresholds = fitted
        least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in thresholds.items()], F.lit(2.0))
        names = [c for c in scored.columns if c.startswith("f_")]
        vectors = VectorAssembler(inputCols=names, outputCol="features").transform(scored.filter("label = 0"))
        chosen = model.transform(vectors).filter(vector_to_array("probability")[1] >= least)
        order = F.coalesce(*[F.when(F.col("kind") == k, F.lit(n)) for n, k in enumerate(KINDS)])
        added = chosen.groupBy("doc_id", "same").agg(F.collect_list(F.struct("start", order.alias("ord"), "kind", "end")).alias("added"))
        added = scratch.keep(added.select(F.col("doc_id").alias("id"), F.col("same").alias("t"), F.col("added").cast(tag).alias("added")), "added")
        rows = rows.join(added, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("same") == F.col("t")), "left")
    else:
        rows = rows.withColumn("added", F.lit(None).cast(tag))
    base = [S.tagged(F.col(k), k, n) for n, k in enumerate(KINDS)]
    flat = F.concat(*base)
    extra = F.filter(
        F.coalesce("added", F.array().cast(tag)),
        lambda a: ~F.exists(flat, lambda b: (b["kind"] == a["kind"]) & (b["start"] < a["end"]) & (a["start"] < b["end"])),
    )
    rows = rows.withColumn("extra", extra)
    return rows.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(S.joined(base), 256).alias("base_sha256"),
        S.joined([*base, F.col("extra")]).alias("spans"), F.size("extra").cast("long").alias("n_added"),
    )
