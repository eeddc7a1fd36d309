"""Secret scans: a trigram inverted index proposes documents for each rule, the rule's expression verifies them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relaylens.llm import spans as S
from relaylens.llm.common import Scratch, text_of
from relaylens.llm.trigrams import ANYTHING, query_of


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    least: int = 0  # code points of the match, or of its ``group``
    group: int = 0


_KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
#: The first three kinds and their limits.
BASE = (
    Rule("assign", _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", least=8, group=2),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
RULES = (
    *BASE,
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("stripe", r"[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
)
#: Documents of one posting list: ids are cut into blocks of so many.
BLOCK = 8192
_NO_ID = -(1 << 63)


def queries_of(rules: tuple[Rule, ...] = RULES) -> dict[str, list[list[str]]]:
    """Kind -> alternatives, each a list of trigrams; kinds that demand no trigram are left out and scanned fully."""
    derived = {r.kind: query_of(r.pattern) for r in rules}
    return {kind: sorted(sorted(part) for part in query) for kind, query in derived.items() if query != ANYTHING and frozenset() not in query}


def postings(rows: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, block, ids): the sorted documents of each block that hold the trigram, letters in either case.

    Only trigrams that some rule asks for are posted; a trigram's list is cut into blocks of ``BLOCK`` ids.
    """
    low = F.lower("text")
    held = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in trigrams]))
    pairs = rows.select("key", F.explode(held).alias("trigram"))
    return pairs.groupBy("trigram", F.floor(F.col("key") / BLOCK).alias("block")).agg(F.array_sort(F.collect_set("key")).alias("ids"))


def candidates(index: DataFrame, queries: dict[str, list[list[str]]]) -> DataFrame:
    """(key, kinds): the documents whose trigrams meet a kind's query, by intersecting posting lists block by block."""
    wanted: dict[str, list[Column]] = {}
    for kind, parts in queries.items():
        for number, part in enumerate(parts):
            for trigram in part:
                wanted.setdefault(trigram, []).append(F.struct(F.lit(kind).alias("kind"), F.lit(number).alias("part"), F.lit(len(part)).alias("need")))
    uses = F.create_map(*[x for trigram, structs in wanted.items() for x in (F.lit(trigram), F.array(*structs))])
    lists = index.select("block", "ids", F.explode(uses[F.col("trigram")]).alias("use")).select("block", "ids", "use.*")
    met = lists.groupBy("kind", "part", "block").agg(F.collect_list("ids").alias("lists"), F.first("need").alias("need")).filter("size(lists) = need")
    common = F.expr("aggregate(slice(lists, 2, size(lists)), lists[0], (a, b) -> array_intersect(a, b))")
    return met.select("kind", F.explode(common).alias("key")).groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _verified(rule: Rule) -> Column:
    text = F.col("text")
    found = S.matches(text, rule.pattern)
    if rule.group:
        groups = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
        zipped = F.arrays_zip(found.alias("m"), groups.alias("g"))
        return F.transform(F.filter(zipped, lambda z: F.length(z["g"]) >= rule.least), lambda z: z["m"])
    return F.filter(found, lambda m: F.length(m["hit"]) >= rule.least) if rule.least else found


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, and for every kind an array of spans (start, end, hit) found in the whole text.

    The index names the documents that a rule can match; only there its expression runs. Rules without a mandatory
    trigram run everywhere. Null text counts as empty; rows that repeat a doc_id are each verified by their own text; a
    null doc_id is indexed under a reserved value; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "secrets")
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("key"), text_of().alias("text"))
    queries = queries_of(rules)
    trigrams = sorted({t for parts in queries.values() for part in parts for t in part})
    index = scratch.keep(postings(rows, trigrams), "postings")
    found = scratch.keep(candidates(index, queries), "candidates")
    # the planner sends the candidates to all tasks only where the written table is small enough
    checked = rows.join(found, "key", "left")
    empty = F.array().cast(S.SPANS)
    per_kind = [
        (F.when(F.array_contains("kinds", r.kind), _verified(r)).otherwise(empty) if r.kind in queries else _verified(r)).alias(r.kind)
        for r in rules
    ]
    return checked.select("doc_id", *per_kind)


def secrets_table(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_other of every document."""
    found = scan(docs, rules)
    tags = {r.kind: S.tagged(F.col(r.kind), r.kind, k) for k, r in enumerate(rules)}
    base = [r.kind for r in BASE]
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in base], F.sha2(S.joined([tags[k] for k in base]), 256).alias("base_sha256"),
        S.joined(list(tags.values())).alias("spans"), sum((F.size(k) for k in tags if k not in base), F.lit(0)).cast("long").alias("n_other"),
    )


def duck_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """The same table in DuckDB, every rule run over every text."""
    found = []
    for rule in rules:
        hit = "m.hit" if not rule.group else f"regexp_extract(m.hit, '{rule.pattern.replace(chr(39), chr(39) * 2)}', {rule.group})"
        found.append(f"list_filter({S.duck_matches('t', rule.pattern)}, lambda m: len({hit}) >= {rule.least}) AS {rule.kind}")
    tag = "list_transform({k}, lambda m: {{'start': m.start, 'ord': {n}, 'kind': '{k}', 'end': m.start + len(m.hit)}})"
    base = [r.kind for r in BASE]
    tags = {r.kind: tag.format(k=r.kind, n=n) for n, r in enumerate(rules)}

    def joined(kinds):
        every = ", ".join(tags[k] for k in kinds)
        return f"array_to_string(list_transform(list_sort(flatten([{every}])), lambda s: s.kind || ':' || s.start || ':' || s.\"end\"), ',')"

    return (
        f"WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS (SELECT doc_id, {', '.join(found)} FROM d) SELECT doc_id, "
        + ", ".join(f"CAST(len({k}) AS BIGINT) AS n_{k}" for k in base)
        + f", sha256({joined(base)}) AS base_sha256, {joined(list(tags))} AS spans, "
        + f"CAST({' + '.join(f'len({k})' for k in tags if k not in base)} AS BIGINT) AS n_other FROM f"
    )
