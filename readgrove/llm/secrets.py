"""Secrets in texts: fixed formats, and strings that pass a battery of randomness tests.

DataFrame operations only.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readgrove.llm.spans import find_all, spans_text
from readgrove.session import materialise

#: The base formats, in this order, and the shortest match or group.
ASSIGN = "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{16,}"  # as AKIA[A-Z0-9]+ of 20 and more: a shorter run has no longer match inside
HEX = "[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]
ASSIGNED = 6

#: Strings that are tested: runs of key characters with a digit and a letter.
SHORTEST = 20
CANDIDATE = f"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])(?=[0-9+/_=-]*+[A-Za-z])[A-Za-z0-9+/_=-]{{{SHORTEST},}}+"
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": string.ascii_uppercase + "234567",
    "alnum": string.ascii_uppercase + string.ascii_lowercase + string.digits,
    "base64": string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/",
}
#: Share of false rejections of randomness allowed in each encoding and length class.
RATE = 0.05
#: Length classes are this many symbols wide; the last one is open.
CLASS, CLASSES = 8, 16
#: Probabilities are counted in steps of exp(-1 / STEP), down to exp(-STEPS / STEP).
STEP, STEPS = 10, 300


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution for z >= 0, by a polynomial good to 1e-7."""
    t = F.lit(1.0) / (F.lit(1.0) + z * 0.2316419)
    poly = F.lit(0.0)
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = (poly + c) * t
    return F.exp(-z * z / 2) * poly / math.sqrt(2 * math.pi)


def _upper(z: Column) -> Column:
    return F.when(z >= 0, _tail(F.abs(z))).otherwise(F.lit(1.0) - _tail(F.abs(z)))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _encoding(token: Column) -> Column:
    return (
        F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(token.rlike("^[A-Z2-7]+=*$"), "base32")
        .when(token.rlike("^[A-Za-z0-9]+=*$"), "alnum")
        .otherwise("base64")
    )


def _body(token: Column, encoding: Column) -> Column:
    """The symbols without padding, as the encoding's alphabet spells them."""
    plain = F.translate(F.regexp_replace(token, "=+", ""), "_-", "/+")
    return F.when(encoding == "hex", F.lower(plain)).otherwise(plain)


def random_probability(cands: DataFrame) -> DataFrame:
    """Adds ``n`` and ``p`` to rows with ``body`` and ``encoding``.

    ``p`` is how likely a random string of the alphabet looks less random than this one: three times
    the smallest of chi-squared uniformity (upper tail), runs above and below the middle of the
    alphabet, and serial correlation of neighbours (both two-sided), 1 at most.
    """
    alphabet = F.create_map(*(F.lit(x) for pair in ALPHABETS.items() for x in pair))[F.col("encoding")]
    df = cands.withColumns({"alphabet": alphabet, "n": F.length("body").cast("double")}).withColumn("k", F.length("alphabet").cast("double"))
    df = df.withColumn("code", F.expr("transform(filter(split(body, ''), c -> c != ''), c -> cast(instr(alphabet, c) - 1 as double))"))
    squares = F.expr("aggregate(filter(split(alphabet, ''), c -> c != ''), 0D, (a, c) -> a + pow(length(body) - length(replace(body, c, '')), 2))")
    df = df.withColumns({
        "chi2": squares * F.col("k") / F.col("n") - F.col("n"),
        "high": F.transform("code", lambda c: F.when(c * 2 >= F.col("k"), 1.0).otherwise(0.0)),
        "mean": _sum(F.col("code")) / F.col("n"),
    })
    neighbours = F.expr("sequence(2, cast(n as int))")
    df = df.withColumns({
        "ones": _sum(F.col("high")),
        "runs": F.lit(1.0) + _sum(F.transform(neighbours, lambda i: F.abs(F.element_at("high", i) - F.element_at("high", i - 1)))),
        "spread": _sum(F.transform("code", lambda c: F.pow(c - F.col("mean"), F.lit(2)))),
        "serial": _sum(F.transform(neighbours, lambda i: (F.element_at("code", i) - F.col("mean")) * (F.element_at("code", i - 1) - F.col("mean")))),
    })
    free, n = F.col("k") - 1, F.col("n")
    cube = F.pow(F.greatest(F.col("chi2"), F.lit(0.0)) / free, F.lit(1 / 3))
    p_chi = _upper((cube - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free)))
    twice = 2 * F.col("ones") * (n - F.col("ones"))
    variance = twice * (twice - n) / (n * n * (n - 1))
    z_runs = (F.col("runs") - twice / n - 1) / F.sqrt(variance)
    p_runs = F.when(variance > 0, 2 * _tail(F.abs(z_runs))).otherwise(F.lit(0.0))
    z_serial = (F.col("serial") / F.col("spread") + 1 / n) * F.sqrt(n)
    p_serial = F.when(F.col("spread") > 0, 2 * _tail(F.abs(z_serial))).otherwise(F.lit(0.0))
    return df.withColumn("p", F.least(F.lit(1.0), 3 * F.least(p_chi, p_runs, p_serial)))


def _bin(p: Column) -> Column:
    """0 for probability 1, the higher the less likely."""
    return F.least(F.floor(-F.log(F.greatest(p, F.lit(1e-300))) * STEP), F.lit(STEPS)).cast("int")


def rejection_bins(counts: list[tuple[str, int, int]], rate: float = RATE) -> dict[str, int]:
    """Per stratum the bin from which on strings count as not random: Benjamini-Hochberg's step-up.

    ``counts`` are (stratum, bin, strings), at most one per encoding, length class and bin.
    """
    found: dict[str, int] = {}
    by: dict[str, dict[int, int]] = {}
    for stratum, b, n in counts:
        by.setdefault(stratum, {})[b] = n
    for stratum, bins in by.items():
        total, above = sum(bins.values()), 0
        found[stratum] = STEPS + 1
        for b in sorted(bins, reverse=True):
            above += bins[b]
            if math.exp(-b / STEP) * total <= rate * above:
                found[stratum] = b
    return found


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = RATE) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans`` per row of ``docs``.

    The base formats are found as they stand. Strings of at least ``SHORTEST`` key characters that
    meet no base span are tested for randomness in the encoding their characters suggest; those
    whose randomness is not rejected, with a false-discovery control over all strings of that
    encoding and length class in the table, are added as ``random``. Null text is empty; empty
    texts have no spans; rows come back as often as they are given, null ids too; other columns are
    ignored. Only a table of at most 64 strata by 301 probabilities reaches the driver.
    """
    df = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    sign = F.col("text").contains("=") | F.col("text").contains(":")
    df = find_all(df, "text", "assign", ASSIGN, 2, sign)
    df = find_all(df, "text", "access", ACCESS, 0, F.col("text").contains("AKIA"))
    df = find_all(df, "text", "hex", HEX)
    df = find_all(df, "text", "cand", CANDIDATE)
    df = df.withColumn("assign", F.filter("assign", lambda m: F.length(m["part"]) >= ASSIGNED))

    def kept(kind: str) -> Column:
        rank = KINDS.index(kind)
        return F.transform(kind, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    base = F.concat(kept("assign"), kept("access"), kept("hex"))
    df = df.select("doc", base.alias("base"), "cand")
    free = F.filter("cand", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    # a number per row, kept in a written table, brings the strings of a row together again
    rows = materialise(df.select(F.monotonically_increasing_id().alias("row"), "doc", "base", free.alias("cand")), "spans")

    cands = rows.select("row", F.explode("cand").alias("c")).select("row", "c.start", "c.end", F.col("c.match").alias("token"))
    cands = cands.withColumn("encoding", _encoding(F.col("token"))).withColumn("body", _body(F.col("token"), F.col("encoding")))
    tested = random_probability(cands.where(F.length("body") >= SHORTEST))
    stratum = F.concat_ws("/", "encoding", F.least(F.floor(F.col("n") / CLASS), F.lit(CLASSES - 1)).cast("string"))
    tested = materialise(tested.select("row", "start", "end", stratum.alias("stratum"), _bin(F.col("p")).alias("bin")), "tested_strings")
    counts = tested.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"))
    bounds = rejection_bins([tuple(r) for r in counts.collect()], rate)
    added = F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>")
    if bounds:
        bound = F.create_map(*(F.lit(x) for pair in sorted(bounds.items()) for x in pair))[F.col("stratum")]
        span = F.struct("start", F.lit(3).alias("rank"), F.lit("random").alias("kind"), "end")
        per_row = tested.where(F.col("bin") < bound).groupBy("row").agg(F.collect_list(span).alias("random"))
        rows = rows.join(per_row, "row", "left")
        added = F.coalesce("random", added)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        F.col("doc").alias(id_col), count("assign"), count("access"), count("hex"), F.size(added).cast("long").alias("n_random"),
        F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.concat("base", added)).alias("spans"),
    )
