"""Places of all matches of a pattern in a text, with DataFrame functions only, and their digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lengths summed at a time, so that a text with very many matches stays linear enough.
GROUP = 256

EMPTY = "array<struct<start:bigint,end:bigint,match:string,part:string>>"


def _total(lengths: Column) -> Column:
    return F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)


def find_all(df: DataFrame, text: str, name: str, pattern: str, group: int = 0, when: Column | None = None) -> DataFrame:
    """Adds ``name``: an array of ``start, end, match, part`` of the leftmost non-overlapping matches.

    Places count code points from 0, ends are exclusive, ``part`` is that group of the match. Java's
    ``split`` and ``find`` walk a text alike, so the places are running sums of the lengths of
    what lies between the matches and of the matches. ``when`` skips texts that cannot match.
    """
    hit = F.col(text).rlike(pattern) if when is None else when & F.col(text).rlike(pattern)
    none = F.array().cast("array<string>")

    def if_hit(column: Column) -> Column:
        return F.when(hit, column).otherwise(none)

    all_of = lambda g: if_hit(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)))
    df = df.withColumns({"_found": all_of(0), "_part": all_of(group), "_gap": if_hit(F.split(text, pattern, -1))})
    df = df.withColumn("_step", F.zip_with("_gap", "_found", lambda g, m: (F.length(g) + F.coalesce(F.length(m), F.lit(0))).cast("long")))
    chunks = F.when(F.size("_found") > 0, F.sequence(F.lit(0), F.floor((F.size("_found") - 1) / GROUP).cast("int"))).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("_chunk", F.transform(chunks, lambda c: _total(F.slice("_step", c * GROUP + 1, F.lit(GROUP)))))
    df = df.withColumn("_before", F.transform("_chunk", lambda x, c: _total(F.slice("_chunk", F.lit(1), c))))

    def place(match: Column, i: Column) -> Column:
        chunk = F.floor(i / GROUP).cast("int")
        end = F.element_at("_before", chunk + 1) + _total(F.slice("_step", chunk * GROUP + 1, i % GROUP + 1))
        return F.struct((end - F.length(match)).alias("start"), end.alias("end"), match.alias("match"), F.element_at("_part", i + 1).alias("part"))

    df = df.withColumn(name, F.transform("_found", place).cast(EMPTY))
    return df.drop("_found", "_part", "_gap", "_step", "_chunk", "_before")


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of structs ``start, rank, kind, end``, by start, then rank, joined by commas."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
