"""Fill-in-middle rows by counted regular expressions.

``regexp_count`` gives the units of a text; two hashed cut points make a pattern of its own for each
row, whose possessive counted groups take prefix, middle and suffix in one match. Possessive groups
are matched in a loop, not by recursion, so the counts may be as large as the texts are long.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit is a word with the white space before it, or white space at the end of the text.
UNIT = "(?:[\\x20\\x09-\\x0D]*+[^\\x20\\x09-\\x0D]++|[\\x20\\x09-\\x0D]++)"


@dataclass(frozen=True)
class Middles:
    """Which rows are cut, how often suffix comes first, and the marks before the parts."""

    seed: int = 42
    percent: int = 50
    suffix_first_percent: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = {self.prefix, self.suffix, self.middle}
        if len(marks) != 3 or not all(len(m) > 2 and m[0] == "<" and m[-1] == ">" and not set(m[1:-1]) & set("<>$\\") for m in marks):
            raise ValueError("marks are three different names in angle brackets")

    @property
    def any_mark(self) -> str:
        return "|".join(f"\\Q{m}\\E" for m in (self.prefix, self.suffix, self.middle))


def hashed(id_col: str, seed: int, group: int) -> Column:
    """The unsigned number in the ``group``-th eight hex digits of the id's SHA-256; a null id is an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(text, 256), 8 * group + 1, 8), 16, 10).cast("long")


def restored(output: Column, form: Column, how: Middles = Middles()) -> Column:
    """The exact text of an output of ``fill_in_middle``, from it and its form."""
    found = F.split(output, how.any_mark, -1)
    part = [F.get(found, F.lit(n)) for n in range(4)]
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(part[1], part[3], part[2]))
        .otherwise(F.concat(part[2], part[3], part[1]))
    )


def fill_in_middle(docs: DataFrame, how: Middles = Middles(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` per row of ``docs``.

    ``n`` counts the units of the text. Two hashes of the id pick the units after which prefix and
    middle end. ``form`` is ``plain`` (output is the text), ``psm`` or ``spm`` (the parts behind their
    marks, in that order). Empty texts, and texts that hold a mark, are plain; null text is empty. Whole
    texts are cut, of any length. Rows come back as often as given, and equal ids are cut at the same
    hashes; null ids count as empty ones; other columns are ignored; an empty table gives an empty result.
    """
    # a mark cannot come up where parts meet: none begins inside another, and "<" ends none
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col), text.alias("_text"), *(hashed(id_col, how.seed, g).alias(f"_h{g}") for g in range(4)))
    rows = rows.withColumn("n", F.regexp_count("_text", F.lit(UNIT)).cast("long"))
    plain = (F.col("n") == 0) | F.col("_text").rlike(how.any_mark) | (F.col("_h2") % 100 >= how.percent)
    form = F.when(plain, "plain").when(F.col("_h3") % 100 < how.suffix_first_percent, "spm").otherwise("psm")
    one, two = F.col("_h0") % (F.col("n") + 1), F.col("_h1") % (F.col("n") + 1)
    first, second = F.least(one, two), F.greatest(one, two) - F.least(one, two)
    pattern = F.format_string(f"(?s)\\A({UNIT}{{%d}}+)({UNIT}{{%d}}+)(.*+)\\z", first, second)
    rows = rows.withColumns({"form": form, "_pattern": pattern})
    psm, spm = f"{how.prefix}$1{how.suffix}$3{how.middle}$2", f"{how.suffix}$3{how.prefix}$1{how.middle}$2"
    order = F.when(F.col("form") == "psm", psm).otherwise(spm)
    cut = F.when(F.col("form") == "plain", F.col("_text")).otherwise(F.regexp_replace("_text", F.col("_pattern"), order))
    rows = rows.withColumn("output", cut)
    part = F.split("output", how.any_mark, -1)
    prefix = F.when(F.col("form") != "plain", F.get(part, F.when(F.col("form") == "psm", 1).otherwise(2)))
    middle = F.when(F.col("form") != "plain", F.get(part, F.lit(3)))
    return rows.select(id_col, "n", "form", F.length(prefix).cast("long").alias("prefix_chars"), F.length(middle).cast("long").alias("middle_chars"), "output")
