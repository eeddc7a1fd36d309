"""Token counts: whole documents are encoded once, and their tokens attributed to sections by character spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relaylens.llm import spans as S
from relaylens.llm import textkit
from relaylens.llm.common import fresh, map_arrow, text_of
from relaylens.llm.tokens import default_vocabulary, encoder

#: How a token that crosses a section's edge is allocated. "start": to the section that holds the token's first character.
#: "majority": to the section that holds more than half of its bytes, or half of them and the first. "share": to every section by its share of
#: the bytes. Tokens or shares that fall to no section count as outside.
RULES = ("start", "majority", "share")
COUNTED = T.StructType([
    T.StructField("n_tokens", T.LongType()), T.StructField("outside", T.DoubleType()), T.StructField("crossing", T.LongType()),
    T.StructField("counts", T.ArrayType(T.DoubleType())),
])
_ARROW = pa.struct([("n_tokens", pa.int64()), ("outside", pa.float64()), ("crossing", pa.int64()), ("counts", pa.list_(pa.float64()))])


def allocate(token_ends: np.ndarray, low: np.ndarray, high: np.ndarray, rule: str) -> np.ndarray:
    """Tokens of each section [low, high), in bytes; ``token_ends`` are the ends of the consecutive tokens of a text."""
    starts = np.concatenate([[0], token_ends[:-1]]) if len(token_ends) else token_ends
    if not len(token_ends):
        return np.zeros(len(low))
    if rule == "share":
        # tokens before a byte, as a fraction within the token that the byte lies in
        edges = np.concatenate([[0], token_ends])
        return np.interp(high, edges, np.arange(len(edges))) - np.interp(low, edges, np.arange(len(edges)))
    counts = (np.searchsorted(starts, high) - np.searchsorted(starts, low)).astype(float)
    if rule == "start":
        return np.where(high > low, counts, 0.0)
    for k in range(len(low)):
        if high[k] <= low[k]:
            counts[k] = 0
            continue
        # the tokens over the section's two edges are looked at one by one
        for token in {int(np.searchsorted(token_ends, edge, "right")) for edge in (low[k], high[k] - 1)}:
            length = token_ends[token] - starts[token]
            inside = min(token_ends[token], high[k]) - max(starts[token], low[k])
            first = low[k] <= starts[token] < high[k]
            counts[k] += int(2 * inside > length or (2 * inside == length and first)) - int(first)
    return counts


def with_counts(docs: DataFrame, name: str, *, sections: str = "sections", rule: str = "start", vocabulary: str | None = None) -> DataFrame:
    """``docs`` with struct column ``name``: n_tokens, outside, crossing (tokens over an edge of a section), counts (of each section).

    ``sections`` is an array of structs with start and end, in code points of the text, end exclusive; the sections of a document do not overlap.
    Each whole text is encoded once. The vocabulary is byte-level, so its tokens split the text's bytes and their spans
    follow from the tokens' lengths; sections and tokens then meet by binary search in their sorted edges. A null list of sections counts as empty.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        for batch in textkit.slices(batches, "text"):
            column = batch.column("text")
            texts = textkit.texts_of(column)
            ids, first = tokens.encode(column)
            lengths = tokens.bytes_of[ids]
            leads = (texts.data & 0xC0) != 0x80
            rows = []
            for k, own in enumerate(batch.column(sections).to_pylist()):
                begin, end = texts.offsets[k], texts.offsets[k + 1]
                at = np.append(np.flatnonzero(leads[begin:end]), end - begin)  # byte of every code point
                low = at[np.clip([s["start"] for s in own or ()], 0, len(at) - 1).astype(np.int64)]
                high = at[np.clip([s["end"] for s in own or ()], 0, len(at) - 1).astype(np.int64)]
                ends = np.cumsum(lengths[first[k]:first[k + 1]])
                counts = allocate(ends, low, high, rule)
                edges = np.unique(np.concatenate([low, high]))
                inner = edges[(edges > 0) & (edges < end - begin)]
                crossed = np.searchsorted(ends, inner)
                crossing = len(np.unique(crossed[ends[crossed] != inner])) if len(ends) else 0
                total = int(first[k + 1] - first[k])
                rows.append({"n_tokens": total, "outside": max(0.0, total - float(counts.sum())), "crossing": crossing, "counts": counts.tolist()})
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, _ARROW)], names=[*batch.schema.names, name])

    return map_arrow(docs, run, T.StructType([*docs.schema.fields, T.StructField(name, COUNTED)]))


def line_sections(docs: DataFrame) -> DataFrame:
    """doc_id, text, and a section for every line that is not empty, without its newline; the first is the title."""
    rows = docs.select("doc_id", text_of().alias("text"))
    lines = F.split("text", "\n", -1)
    placed = S.walked(
        lines, lambda x: F.lit(0), lambda x: F.length(x) + 1, lambda start, end, x: F.struct(start.alias("start"), (end - 1).alias("end")), "array<struct<start:long,end:long>>"
    )
    return rows.withColumn("sections", F.filter(placed, lambda s: s["end"] > s["start"]))


def count_table(docs: DataFrame, rule: str = "start") -> DataFrame:
    """doc_id, n_tokens, n_sections, title_tokens, body_tokens, outside_tokens, crossing, counts (per section, comma-joined) of every document.

    Sections are lines. Null text is empty and has no tokens or sections; repeated rows count alike; an empty table
    gives an empty result; other columns are ignored.
    """
    counted = with_counts(line_sections(docs), "c", rule=rule)
    counts = F.transform("c.counts", lambda x: x.cast("long"))
    title = F.coalesce(F.try_element_at("c.counts", F.lit(1)), F.lit(0.0)).cast("long")
    return counted.select(
        "doc_id", "c.n_tokens", F.size("sections").cast("long").alias("n_sections"), title.alias("title_tokens"),
        (F.col("c.n_tokens") - F.col("c.outside").cast("long") - title).alias("body_tokens"), F.col("c.outside").cast("long").alias("outside_tokens"),
        "c.crossing", F.array_join(F.transform(counts, lambda x: x.cast("string")), ",").alias("counts"),
    )
