"""URL rules by host and path, with decisions carried over redirects and canonical links.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from readgrove.llm.components import connected_components
from readgrove.llm.lists import counted
from readgrove.session import materialise

#: The rules of the registered query, as verdict, host, path.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: A page's own address and where it sends readers to, as HTML states them.
CANONICAL = "(?is)<link\\b(?=[^>]*\\brel\\s*=\\s*[\"']?canonical\\b)[^>]*?\\bhref\\s*=\\s*[\"']?([^\"'\\s>]+)"
REFRESH = "(?is)<meta\\b(?=[^>]*\\bhttp-equiv\\s*=\\s*[\"']?refresh\\b)[^>]*?\\burl\\s*=\\s*[\"']?([^\"'\\s>]+)"


def url_host(url: Column) -> Column:
    """Up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; empty without ``://``."""
    host = F.regexp_extract(url, "^(?s).*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, "^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_key(url: Column) -> Column:
    """What a link names: the address without fragment, scheme and host in lower case."""
    head = F.lower(F.regexp_extract(url, "^(?s)(.*?://[^/?#]*)", 1))
    return F.concat(head, F.regexp_extract(url, "^(?s).*?://[^/?#]*([^#]*)", 1))


def _suffixes(host: Column) -> Column:
    """The host and every domain above it."""
    labels = F.split(host, "\\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )


def rule_table(spark, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, rule, verdict`` of the distinct ``urls`` that a rule fits; the longest rule wins.

    ``rules`` has ``verdict, host, path``. A rule meets a url by an equal host or domain above it, so
    any number of rules is one join. Of rules of one length, the longer host wins, then allow.
    """
    ruled = rules.select(F.col("host").alias("suffix"), F.col("path").alias("start"), F.col("verdict").alias("rule_verdict"))
    spread = urls.select("url", url_path(F.col("url")).alias("path"), F.explode(_suffixes(url_host(F.col("url")))).alias("suffix"))
    fits = spread.join(counted(ruled), "suffix").where(F.col("path").startswith(F.col("start")))
    text = F.concat("suffix", "start")
    best = F.max(F.struct(F.length(text), F.length("suffix"), F.when(F.col("rule_verdict") == "allow", 1).otherwise(0), text.alias("rule"), F.col("rule_verdict").alias("verdict")))
    return fits.groupBy("url").agg(best.alias("best")).select("url", "best.rule", "best.verdict")


def without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments; it never rises above the root."""
    parts = F.split(F.regexp_replace(path, "/(\\.{1,2})$", "/$1/"), "/", -1)
    step = lambda kept, part: (
        F.when(part == "..", F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(1))))
        .when(part == ".", kept)
        .otherwise(F.array_append(kept, part))
    )
    walked = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.slice(parts, 1, 1), step)
    return F.when(path.contains("/."), F.array_join(walked, "/")).otherwise(path)


def resolve(base: Column, link: Column) -> Column:
    """The address that a link on the page ``base`` names; null where it names no page of a host.

    Links may be whole, begin with ``//``, ``/``, ``?`` or a name, and hold ``&amp;`` and dot segments.
    """
    link = F.regexp_replace(link, "&(?:amp|AMP|#38|#x26);", "&")
    scheme, root = F.regexp_extract(base, "^(?s)(.*?)://", 1), F.regexp_extract(base, "^(?s)(.*?://[^/?#]*)", 1)
    path = url_path(base)
    folder = F.when(path.contains("/"), F.regexp_extract(path, "^(?s)(.*/)", 1)).otherwise(F.lit("/"))
    whole = (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, path, link))
        .when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | link.startswith("#") | (link == ""), F.lit(None))
        .otherwise(F.concat(root, folder, link))
    )
    head, rest = F.regexp_extract(whole, "^(?s)(.*?://[^/?#]*)", 1), F.regexp_extract(whole, "^(?s).*?://[^/?#]*[^?#]*(.*)$", 1)
    return F.concat(head, without_dots(url_path(whole)), rest)


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``source, target`` addresses of all canonical and redirect links in whole pages, resolved against the page."""
    url, html = F.col(url_col), F.col(html_col)
    found = F.concat(F.regexp_extract_all(html, F.lit(CANONICAL), F.lit(1)), F.regexp_extract_all(html, F.lit(REFRESH), F.lit(1)))
    has = F.lower(html)
    links = pages.where(url.contains("://") & (has.contains("canonical") | has.contains("refresh")))
    links = links.select(url.cast("string").alias("source"), F.explode(F.array_distinct(found)).alias("target"))
    return links.select("source", resolve(F.col("source"), F.col("target")).alias("target")).where("target is not null")


def judge_urls(pages: DataFrame, rules: DataFrame, links: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, host, path, rule, verdict`` per row of ``pages``.

    A url that a rule fits has that rule's verdict. Redirect and canonical links, read from the pages
    and taken from ``links`` (``source, target`` urls), make addresses aliases: one without a rule
    of its own is allowed if a rule allows an alias, else blocked if a rule blocks one, else
    allowed. Null urls and urls without ``://`` have empty host and path and are allowed. Repeated
    rows come as often as given; other columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col(id_col).alias("page"), F.col(url_col).cast("string").alias("url"))
    links_found = page_links(pages, url_col, html_col)
    if links is not None:
        links_found = links_found.unionByName(links.select("source", "target"))
    edges = links_found.select(url_key(F.col("source")).alias("s"), url_key(F.col("target")).alias("t"))
    edges = materialise(edges.where("s != t and s != '' and t != ''").distinct(), "links")
    urls = rows.where(F.col("url").contains("://")).select("url")
    # addresses that are only linked to can have rules too, and pass them on
    urls = urls.unionByName(edges.select(F.explode(F.array("s", "t")).alias("url"))).distinct()
    ruled = materialise(match_rules(urls, rules), "ruled_urls")
    verdicts = ruled
    if not edges.isEmpty():
        verdicts = ruled.unionByName(_aliases(urls, ruled, edges))
    verdicts = materialise(verdicts.select(F.col("url").alias("u"), "rule", "verdict"), "url_verdicts")
    judged = rows.join(verdicts, rows["url"] == verdicts["u"], "left")
    return judged.select(
        F.col("page").alias(id_col), url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"),
        "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"),
    )


def _aliases(urls: DataFrame, ruled: DataFrame, edges: DataFrame) -> DataFrame:
    """Verdicts of urls without a rule that are linked, over any number of links, to ruled ones."""
    # linked addresses get numbers, which cannot meet as hashes can
    ends = edges.select(F.explode(F.array("s", "t")).alias("key")).distinct()
    keys = materialise(ends.withColumn("node", F.monotonically_increasing_id()), "addresses")
    numbered = edges.join(keys.select(F.col("key").alias("s"), F.col("node").alias("a")), "s")
    numbered = numbered.join(keys.select(F.col("key").alias("t"), F.col("node").alias("b")), "t")
    comp = connected_components(materialise(numbered.select("a", "b"), "numbered_links"))
    named = urls.select("url", url_key(F.col("url")).alias("key")).join(keys, "key").join(comp, "node")
    named = materialise(named.select("url", "component"), "linked_urls")
    told = named.join(ruled, "url", "left")
    allowed = F.max(F.when(F.col("verdict") == "allow", 1).otherwise(0))
    blocked = F.max(F.when(F.col("verdict") == "block", 1).otherwise(0))
    groups = told.groupBy("component").agg(allowed.alias("allowed"), blocked.alias("blocked"))
    decided = groups.select("component", F.when(F.col("allowed") == 1, "allow").when(F.col("blocked") == 1, "block").alias("verdict")).where("verdict is not null")
    open_urls = named.join(ruled, "url", "left_anti")
    return open_urls.join(materialise(decided, "decided"), "component").select("url", F.lit(None).cast("string").alias("rule"), "verdict")
