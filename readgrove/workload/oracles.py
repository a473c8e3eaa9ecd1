"""The same results in plain SQL for DuckDB, written without the library: joins, counts, windows."""

from __future__ import annotations

import re

from readgrove.workload.queries import FAMILIES, ITERATIONS, SAMPLES, TIGHT_RADIUS

K = 8
STEPS = 14  # enough landmark steps for clusters of up to 2**15 reads

# ---- building blocks: name -> (names it needs, body) ---------------------------------------

VIEWS: dict[str, tuple[list[str], str]] = {
    "lines": ([], """
        SELECT concat('s', CAST(l_suppkey % 8 AS VARCHAR), '_', CAST(l_orderkey * 10 + l_linenumber AS VARCHAR)) AS header,
               translate(concat(md5(concat('a', CAST(l_partkey % 16 AS VARCHAR))), md5(concat('b', CAST(l_partkey % 16 AS VARCHAR))),
                                md5(concat('c', CAST(l_partkey % 16 AS VARCHAR))), md5(concat('d', CAST(l_partkey % 16 AS VARCHAR)))),
                         '0123456789abcdef', 'ACGTACGTACGTACGT') AS base,
               CAST(l_suppkey % 128 AS INT) + 1 AS pos,
               substr('ACGT', CAST(l_linenumber % 4 AS INT) + 1, 1) AS ch, l_partkey % 16 AS fam
        FROM lineitem"""),
    "reads_syn": (["lines"], "SELECT fam, header, concat(substr(base, 1, pos - 1), ch, substr(base, pos + 1)) AS read FROM lines"),
    "reads_any": ([], """
        SELECT header, read, source FROM (
          SELECT concat(source, '_', CAST(doc_id AS VARCHAR)) AS header, source,
                 regexp_replace(upper(text), '[^ACGT]', '', 'g') AS read FROM documents)
        WHERE length(read) > 0"""),
    "reads_doc": (["reads_any"], f"SELECT * FROM reads_any WHERE length(read) >= {K}"),
    "unique_syn": (["reads_syn"], """
        SELECT md5(read) AS seq_id, read, count(DISTINCT header) AS abundance, min(fam) AS fam FROM reads_syn GROUP BY read"""),
    "seqs_syn": (["unique_syn"], "SELECT * FROM unique_syn WHERE abundance >= 2"),
    "seqs_doc": (["reads_doc"], """
        SELECT md5(read) AS seq_id, read, count(DISTINCT header) AS abundance FROM reads_doc GROUP BY read"""),
    "turned": (["unique_syn"], """
        SELECT seq_id, CASE WHEN substr(seq_id, 1, 1) < '8' THEN reverse(translate(read, 'ACGT', 'TGCA')) ELSE read END AS read FROM unique_syn"""),
    "facing": (["turned"], """
        SELECT seq_id, '+' AS strand, read FROM turned UNION ALL SELECT seq_id, '-', reverse(translate(read, 'ACGT', 'TGCA')) FROM turned"""),
    "facing_words": (["facing"], f"""
        SELECT seq_id, strand, word, count(*) AS cnt FROM (
          SELECT seq_id, strand, substr(read, i, {K}) AS word FROM (
            SELECT seq_id, strand, read, unnest(range(1, length(read) - {K} + 2)) AS i FROM facing))
        GROUP BY seq_id, strand, word"""),
    "many": ([], """
        SELECT cluster, fam, header, max(read) AS read FROM (
          SELECT l_partkey % 4 AS cluster, l_partkey AS fam,
                 concat('s', CAST(l_suppkey % 8 AS VARCHAR), '_', CAST(l_orderkey * 10 + l_linenumber AS VARCHAR), 'p', CAST(l_partkey AS VARCHAR)) AS header,
                 concat(substr(base, 1, CAST(l_orderkey % 128 AS INT)), substr('ACGT', CAST(l_linenumber % 4 AS INT) + 1, 1),
                        substr(base, CAST(l_orderkey % 128 AS INT) + 2)) AS read
          FROM (SELECT *, translate(concat(md5(concat('a', CAST(l_partkey AS VARCHAR))), md5(concat('b', CAST(l_partkey AS VARCHAR))),
                                           md5(concat('c', CAST(l_partkey AS VARCHAR))), md5(concat('d', CAST(l_partkey AS VARCHAR)))),
                                    '0123456789abcdef', 'ACGTACGTACGTACGT') AS base FROM lineitem))
        GROUP BY ALL"""),
    "members": (["seqs_syn"], """
        SELECT seq_id, read, fam + 16 AS cluster,
               CAST(('0x' || substr(md5(read), 1, 8)) AS BIGINT) % 16 AS bucket FROM seqs_syn"""),
    "sizes": (["members"], "SELECT cluster, count(*) AS size FROM members GROUP BY cluster"),
    "quotas": (["sizes"], "SELECT cluster, size, greatest(CAST(ceil(log2(size)) AS INT) - 1, 1) AS m FROM sizes"),
    "landmarks": (["members", "quotas"], """
        SELECT cluster, lm_ord, seq_id, read FROM (
          SELECT cluster, seq_id, read, m, row_number() OVER (PARTITION BY cluster ORDER BY seq_id) - 1 AS lm_ord
          FROM members JOIN quotas USING (cluster)) WHERE lm_ord < m"""),
    "top_landmarks": (["members"], """
        SELECT cluster - 16 AS lm_ord, min(seq_id) AS seq_id FROM members GROUP BY cluster"""),
    "words": (["unique_syn"], f"""
        SELECT seq_id, word, count(*) AS cnt FROM (
          SELECT seq_id, substr(read, i, {K}) AS word FROM (
            SELECT seq_id, read, unnest(range(1, length(read) - {K} + 2)) AS i FROM unique_syn))
        GROUP BY seq_id, word"""),
    "spans": (["unique_syn"], f"SELECT seq_id, length(read) - {K} + 1 AS windows FROM unique_syn"),
    "root_dist": (["members", "top_landmarks", "words", "spans"], """
        SELECT p.seq_id, 1 AS cluster, p.lm_ord, 1 - coalesce(s.shared, 0) / p.windows AS d
        FROM (SELECT m.seq_id, t.lm_ord, least(a.windows, b.windows) AS windows FROM members m, top_landmarks t
              JOIN spans b ON b.seq_id = t.seq_id, spans a WHERE a.seq_id = m.seq_id) p
        LEFT JOIN (SELECT a.seq_id, t.lm_ord, sum(least(a.cnt, b.cnt)) AS shared
                   FROM words a JOIN words b ON a.word = b.word JOIN top_landmarks t ON t.seq_id = b.seq_id
                   GROUP BY 1, 2) s ON s.seq_id = p.seq_id AND s.lm_ord = p.lm_ord"""),
    "family_dist": (["members", "landmarks", "words", "spans"], """
        SELECT p.seq_id, p.cluster, p.lm_ord, 1 - coalesce(s.shared, 0) / p.windows AS d
        FROM (SELECT m.seq_id, m.cluster, l.lm_ord, l.seq_id AS lm_id, least(a.windows, b.windows) AS windows
              FROM members m JOIN landmarks l ON l.cluster = m.cluster
              JOIN spans a ON a.seq_id = m.seq_id JOIN spans b ON b.seq_id = l.seq_id) p
        LEFT JOIN (SELECT a.seq_id, b.seq_id AS lm_id, sum(least(a.cnt, b.cnt)) AS shared
                   FROM words a JOIN words b ON a.word = b.word
                   WHERE b.seq_id IN (SELECT seq_id FROM landmarks) GROUP BY 1, 2) s
          ON s.seq_id = p.seq_id AND s.lm_id = p.lm_id"""),
    "bucketed": (["family_dist", "members"], """
        SELECT m.seq_id, m.cluster, m.bucket, least(1.0, min(d)) AS d
        FROM family_dist f JOIN members m USING (seq_id) GROUP BY ALL"""),
    "medians": (["bucketed"], """
        SELECT cluster, bucket, list_sort(list(d))[CAST(floor(count(*) / 2) AS INT) + 1] AS median
        FROM bucketed GROUP BY cluster, bucket"""),
    "edges": (["landmarks"], """
        SELECT a.cluster, a.lm_ord AS src, b.lm_ord AS dst, 1.0 - hamming(a.read, b.read) / 128.0 AS weight
        FROM landmarks a JOIN landmarks b ON a.cluster = b.cluster AND a.lm_ord < b.lm_ord"""),
    "ends": (["edges"], """
        SELECT cluster, src AS v, dst AS u, weight FROM edges UNION ALL SELECT cluster, dst, src, weight FROM edges"""),
    "radii": (["ends"], """
        SELECT cluster, min(r) AS radius FROM (
          SELECT cluster, v, avg(1.0 - weight) AS r FROM ends GROUP BY cluster, v) GROUP BY cluster"""),
    "hits_syn": (["reads_syn", "seqs_syn"], """
        SELECT concat('Set(', h.headers, ')') AS header_set, concat('cluster_', CAST(s.fam + 16 AS VARCHAR)) AS cluster, s.seq_id
        FROM seqs_syn s JOIN (
          SELECT md5(read) AS seq_id, string_agg(header, ',' ORDER BY header) AS headers
          FROM (SELECT DISTINCT read, header FROM reads_syn) GROUP BY read) h USING (seq_id)"""),
    "header_hits": (["reads_syn", "seqs_syn"], """
        SELECT header, cluster FROM (
          SELECT r.header, concat('cluster_', CAST(s.fam + 16 AS VARCHAR)) AS cluster,
                 row_number() OVER (PARTITION BY r.header ORDER BY s.seq_id DESC) AS rn
          FROM (SELECT DISTINCT header, md5(read) AS seq_id FROM reads_syn) r JOIN seqs_syn s USING (seq_id))
        WHERE rn = 1"""),
    "by_header": (["reads_syn"], "SELECT header, max(read) AS read FROM reads_syn GROUP BY header"),
    "assigned_syn": (["reads_syn"], "SELECT fam + 16 AS cluster, header, max(read) AS read FROM reads_syn GROUP BY fam, header"),
    "members_syn": (["reads_syn"], """
        SELECT h.fam + 16 AS cluster, h.header AS query, f.target, 0.99 AS identity
        FROM (SELECT DISTINCT fam, header FROM reads_syn) h
        JOIN (SELECT fam, min(header) AS target FROM reads_syn GROUP BY fam) f ON f.fam = h.fam
        WHERE h.header <> f.target"""),
    "centroids_syn": (["assigned_syn"], """
        SELECT cluster, header AS centroid, read FROM (
          SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY header) AS rn FROM assigned_syn) WHERE rn = 1"""),
    "counts_syn": (["members_syn"], """
        SELECT cluster, target AS centroid, split_part(query, '_', 1) AS sample, count(*) AS n
        FROM members_syn GROUP BY cluster, target, sample"""),
    "otus_syn": (["centroids_syn"], """
        SELECT *, row_number() OVER (ORDER BY cluster, length(read) DESC, centroid) - 1 AS otu_num FROM centroids_syn"""),
    "named_syn": (["counts_syn", "otus_syn"], """
        SELECT otu_num, concat('OTU_', CAST(otu_num AS VARCHAR)) AS otu, sample, CAST(n AS BIGINT) AS n
        FROM counts_syn JOIN otus_syn USING (cluster, centroid)"""),
}


def _key(text: str) -> str:
    return f"CAST(('0x' || substr(md5({text}), 1, 15)) AS BIGINT)"


def _iterate(iterations: int) -> None:
    """Power iteration, one view per round, and the exact cut in two."""
    start = _key("concat_ws('|', 'start|0', CAST(cluster AS VARCHAR), CAST(v AS VARCHAR))")
    VIEWS["values_0"] = (["ends"], f"SELECT cluster, v, {start} / 1152921504606846976.0 AS x FROM (SELECT DISTINCT cluster, v FROM ends)")
    VIEWS["degrees"] = (["ends"], "SELECT cluster, v, sum(weight) AS degree FROM ends GROUP BY cluster, v")
    for i in range(1, iterations + 1):
        VIEWS[f"values_{i}"] = ([f"values_{i - 1}", "ends", "degrees"], f"""
            SELECT cluster, v, y / sum(abs(y)) OVER (PARTITION BY cluster) AS x FROM (
              SELECT b.cluster, b.v, sum(b.weight / CASE WHEN g.degree > 0 THEN g.degree ELSE 1 END * p.x) AS y
              FROM ends b JOIN degrees g ON g.cluster = b.cluster AND g.v = b.v
              JOIN values_{i - 1} p ON p.cluster = b.cluster AND p.v = b.u GROUP BY b.cluster, b.v)""")
    VIEWS["cut"] = ([f"values_{iterations}"], f"""
        WITH c AS (SELECT cluster, v, x - avg(x) OVER (PARTITION BY cluster) AS u FROM values_{iterations}),
        r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY u, v) AS i,
                     count(*) OVER (PARTITION BY cluster) AS m,
                     sum(u) OVER (PARTITION BY cluster ORDER BY u, v) AS s FROM c),
        g AS (SELECT *, s * s / i + s * s / (m - i) AS gain FROM r WHERE i < m),
        b AS (SELECT cluster, arg_max(i, gain) AS best FROM g GROUP BY cluster),
        q AS (SELECT r.cluster, r.v, CAST(r.i > b.best AS INT) AS side FROM r JOIN b USING (cluster))
        SELECT q.cluster, q.v AS lm_ord, xor(q.side, z.side) AS side
        FROM q JOIN q z ON z.cluster = q.cluster AND z.v = 0""")


_iterate(ITERATIONS)


ALIGNED: dict[str, str] = {}


def _picks() -> None:
    """Landmark selection with one view per step over every cluster."""
    def pick(step: int) -> str:
        return _key(f"concat_ws('|', '0', CAST(cluster AS VARCHAR), '{step}', seq_id)")

    VIEWS["near_0"] = (["members", "quotas"], "SELECT *, 1.0 AS d_min FROM members JOIN quotas USING (cluster)")
    VIEWS["pick_0"] = (["near_0"], f"SELECT cluster, arg_min(seq_id, {pick(0)}) AS seq_id FROM near_0 GROUP BY cluster")
    for i in range(1, STEPS):
        VIEWS[f"near_{i}"] = ([f"near_{i - 1}", f"pick_{i - 1}", "words", "spans"], f"""
            SELECT n.* REPLACE (least(n.d_min, 1 - coalesce(s.shared, 0) / least(a.windows, b.windows)) AS d_min)
            FROM near_{i - 1} n JOIN pick_{i - 1} p ON p.cluster = n.cluster
            JOIN spans a ON a.seq_id = n.seq_id JOIN spans b ON b.seq_id = p.seq_id
            LEFT JOIN (SELECT x.seq_id, y.seq_id AS lm_id, sum(least(x.cnt, y.cnt)) AS shared
                       FROM words x JOIN words y ON x.word = y.word
                       WHERE y.seq_id IN (SELECT seq_id FROM pick_{i - 1}) GROUP BY 1, 2) s
              ON s.seq_id = n.seq_id AND s.lm_id = p.seq_id
            WHERE n.m > {i}""")
        VIEWS[f"pick_{i}"] = ([f"near_{i}"], f"""
            WITH b AS (SELECT cluster, list_sort(list(d_min))[CAST(floor(count(*) / 2) AS INT) + 1] AS median
                       FROM near_{i} GROUP BY cluster, bucket),
            t AS (SELECT cluster, list_sort(list(median))[CAST(floor(count(*) / 2) AS INT) + 1] AS mom FROM b GROUP BY cluster)
            SELECT n.cluster, arg_min(seq_id, {pick(i).replace('cluster', 'n.cluster')}) AS seq_id
            FROM near_{i} n JOIN t ON t.cluster = n.cluster WHERE d_min >= mom GROUP BY n.cluster""")
    VIEWS["picked"] = ([f"pick_{i}" for i in range(STEPS)], " UNION ALL ".join(
        f"SELECT cluster, {i} AS lm_ord, seq_id FROM pick_{i}" for i in range(STEPS)))
    # the same by alignment: reads of a family differ in two places at most, which no gap improves
    for i in range(1, STEPS):
        ALIGNED[f"near_{i}"] = f"""
            SELECT n.* REPLACE (least(n.d_min, hamming(n.read, q.read) / 128.0) AS d_min)
            FROM near_{i - 1} n JOIN pick_{i - 1} p ON p.cluster = n.cluster JOIN members q ON q.seq_id = p.seq_id AND q.cluster = p.cluster
            WHERE n.m > {i}"""


_picks()


def _with(needs: list[str], body: str, replace: dict[str, str] | None = None) -> str:
    """``body`` behind the views it needs, each once and in order."""
    placed: dict[str, None] = {}

    def place(name: str) -> None:
        if name in placed:
            return
        for other in VIEWS[name][0]:
            place(other)
        placed[name] = None

    for name in needs:
        place(name)
    swap = replace or {}
    ctes = ", ".join(f"{n} AS MATERIALIZED ({swap.get(n, VIEWS[n][1])})" for n in placed)
    return f"WITH {ctes} {body}"


def _digits(word: str) -> str:
    digit = "CASE substr({w}, {i}, 1) WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 ELSE 0 END"
    return " + ".join(f"({digit.format(w=word, i=i + 1)}) * {4 ** (K - 1 - i)}" for i in range(K))


_WINDOWS = f"""SELECT seq_id, i - 1 AS pos, substr(read, i, {K}) AS word FROM (
    SELECT seq_id, read, unnest(range(1, length(read) - {K} + 2)) AS i FROM seqs_doc)"""

_CLUSTER_SUMS = ", ".join(
    f"CAST(sum(CASE WHEN cluster = {c} THEN n ELSE 0 END) AS BIGINT) AS c{c}" for c in range(FAMILIES, 2 * FAMILIES)
)
_SAMPLE_SUMS = ", ".join(f"CAST(sum(CASE WHEN sample = '{s}' THEN n ELSE 0 END) AS BIGINT) AS {s}" for s in SAMPLES)

_NEAREST = """
    SELECT seq_id, cluster, lm_ord, identity, strand FROM (
      SELECT f.seq_id, l.cluster, CAST(l.lm_ord AS INT) AS lm_ord, {identity} AS identity, f.strand,
             row_number() OVER (PARTITION BY f.seq_id ORDER BY {identity} DESC, l.cluster, l.lm_ord, f.strand) AS rn
      FROM (SELECT a.seq_id, a.strand, b.seq_id AS lm_id, sum(least(a.cnt, b.cnt)) AS shared
            FROM facing_words a JOIN words b ON a.word = b.word
            WHERE b.seq_id IN (SELECT seq_id FROM landmarks) GROUP BY ALL) c
      JOIN landmarks l ON l.seq_id = c.lm_id JOIN facing f ON f.seq_id = c.seq_id AND f.strand = c.strand
      JOIN spans w ON w.seq_id = c.lm_id
      WHERE c.shared / w.windows >= 0.6) WHERE rn = 1"""

_SPLIT_EDGES = """
    SELECT a.cluster, a.lm_ord AS src, b.lm_ord AS dst, 1.0 - hamming(x.read, y.read) / 128.0 AS weight
    FROM picked a JOIN picked b ON a.cluster = b.cluster AND a.lm_ord < b.lm_ord
    JOIN members x ON x.seq_id = a.seq_id JOIN members y ON y.seq_id = b.seq_id"""
VIEWS["picked_first"] = (["picked", "members"], "SELECT 1")


def _split_once() -> str:
    body = f"""
        , pick_words AS (SELECT p.cluster, p.lm_ord, w.word, w.cnt FROM picked p JOIN words w USING (seq_id)),
        dist AS (
          SELECT m.seq_id, m.cluster, p.lm_ord, 1 - coalesce(s.shared, 0) / least(a.windows, b.windows) AS d
          FROM members m JOIN picked p ON p.cluster = m.cluster
          JOIN spans a ON a.seq_id = m.seq_id JOIN spans b ON b.seq_id = p.seq_id
          LEFT JOIN (SELECT m.seq_id, p.lm_ord, sum(least(w.cnt, p.cnt)) AS shared
                     FROM members m JOIN words w ON w.seq_id = m.seq_id
                     JOIN pick_words p ON p.cluster = m.cluster AND p.word = w.word GROUP BY 1, 2) s
            ON s.seq_id = m.seq_id AND s.lm_ord = p.lm_ord),
        means AS (
          SELECT d.seq_id, d.cluster, round(avg(CASE WHEN side = 0 THEN d END), 12) AS l, round(avg(CASE WHEN side = 1 THEN d END), 12) AS r
          FROM dist d JOIN cut c ON c.cluster = d.cluster AND c.lm_ord = d.lm_ord GROUP BY 1, 2),
        moved AS (SELECT cluster, count(*) FILTER (WHERE l <= r) AS left_size, count(*) FILTER (WHERE NOT l <= r) AS right_size
                  FROM means GROUP BY cluster)
        SELECT s.cluster, s.size, round(q.radius, 9) AS radius,
               CASE WHEN q.radius <= {TIGHT_RADIUS} THEN 'radius'
                    WHEN left_size = 0 OR right_size = 0 THEN 'one_sided' ELSE 'split' END AS status,
               CASE WHEN q.radius <= {TIGHT_RADIUS} THEN NULL ELSE left_size END AS left_size,
               CASE WHEN q.radius <= {TIGHT_RADIUS} THEN NULL ELSE right_size END AS right_size
        FROM sizes s JOIN radii q USING (cluster) LEFT JOIN moved USING (cluster)"""
    needs = ["picked_first", "sizes", "words", "spans", "radii", "cut"]
    return _with(needs, body, {"edges": _SPLIT_EDGES})


def _best(*states: str) -> tuple[str, str]:
    """Score and counts of the first state that has the largest score."""
    score = f"greatest({', '.join(s for s, _ in states)})"
    cases = " ".join(f"WHEN {s} = {score} THEN {c}" for s, c in states)
    return score, f"CASE {cases} END"


_SHORT = """
    SELECT c_custkey AS pair, substr(translate(md5(c_name), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, CAST(c_custkey % 13 + 12 AS INT)) AS a, c_mktsegment
    FROM customer"""
_PAIRS = """
    SELECT pair, a, CASE WHEN pair % 2 = 0 THEN other
                    ELSE concat(substr(a, 1, cut), substr(a, cut + CAST(pair % 4 AS INT) + 1), substr(other, 1, CAST(pair % 3 AS INT))) END AS b
    FROM (SELECT c_custkey AS pair, CAST(c_custkey % 5 + 3 AS INT) AS cut,
                 substr(translate(md5(c_name), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, CAST(c_custkey % 13 + 12 AS INT)) AS a,
                 substr(translate(md5(concat(c_name, 'x')), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, CAST(c_custkey % 11 + 12 AS INT)) AS other
          FROM customer)"""


def _sweep_sql(pairs: str = _PAIRS) -> str:
    """Global affine alignment, three states a cell, one anti-diagonal a recursion.

    A cell's columns are scores ``s`` and counts ``c`` (misses * 1000 + matches) of the states m (letters
    paired), a and b (a letter of one read alone), on this diagonal (1) and the one before (0);
    the cell before in the read has them under ``y``. Equal scores: the order of the arguments.
    """
    never = "-1000000"
    state = lambda name, diagonal, gain=0, misses=1000, y="": (f"{y}{name}s{diagonal} + ({gain})", f"{y}{name}c{diagonal} + {misses}")
    longer, opened = -1, -11
    match = _best(*(state(n, 0, 0, 0, "y") for n in "mab"))
    same = "substr(a, i, 1) = substr(b, d + 1 - i, 1)"
    skip_a = _best(state("m", 1, opened), state("a", 1, longer), state("b", 1, opened))
    skip_b = _best(state("m", 1, opened, y="y"), state("a", 1, opened, y="y"), state("b", 1, longer, y="y"))
    inside = "i >= 1 AND i <= d AND d + 1 - i <= lb"
    edge, edge_count = "-10 - (d + 1)", "(d + 1) * 1000"
    names = [f"{n}{k}" for n in "mab" for k in "sc"]
    last = _best(*((f"{n}s1", f"{n}c1") for n in "abm"))
    start = ", ".join(f"CASE WHEN i = 0 THEN 0 ELSE {never} END AS {n}s1, 0 AS {n}c1, {never} AS {n}s0, 0 AS {n}c0" for n in "mab")
    lags = ", ".join(f"lag({n}{k}) OVER w AS y{n}{k}" for n in names for k in "01")
    return f"""
WITH RECURSIVE pairs AS ({pairs}
), sweep AS (
    SELECT pair, a, b, length(a) AS la, length(b) AS lb, 0 AS d, i, {start}
    FROM (SELECT pair, a, b, unnest(range(0, length(a) + 1)) AS i FROM pairs)
    UNION ALL
    SELECT pair, a, b, la, lb, d + 1, i,
           CASE WHEN {inside} THEN {match[0]} + CASE WHEN {same} THEN 5 ELSE -4 END ELSE {never} END,
           CASE WHEN {inside} THEN {match[1]} + CASE WHEN {same} THEN 1 ELSE 1000 END ELSE 0 END, ms1, mc1,
           CASE WHEN {inside} THEN {skip_a[0]} WHEN i = 0 AND d < lb THEN {edge} ELSE {never} END,
           CASE WHEN {inside} THEN {skip_a[1]} WHEN i = 0 AND d < lb THEN {edge_count} ELSE 0 END, as1, ac1,
           CASE WHEN {inside} THEN {skip_b[0]} WHEN i = d + 1 THEN {edge} ELSE {never} END,
           CASE WHEN {inside} THEN {skip_b[1]} WHEN i = d + 1 THEN {edge_count} ELSE 0 END, bs1, bc1
    FROM (SELECT *, {lags} FROM sweep WHERE d < la + lb WINDOW w AS (PARTITION BY pair ORDER BY i))
)
SELECT pair, round((n // 1000) / (n // 1000 + n % 1000), 9) AS d
FROM (SELECT pair, {last[1]} AS n FROM sweep WHERE d = la + lb AND i = la)
"""


#: Splits of the division that SQL replays, one view each for its labels, landmarks and cut.
SPLITS = 3

# the few landmarks' words first, so that no plan joins all words with all words
_KMER_EDGES = """
    WITH mine AS MATERIALIZED (SELECT w.seq_id, w.word, w.cnt FROM words w JOIN (SELECT DISTINCT seq_id FROM picked) p ON p.seq_id = w.seq_id),
    s AS MATERIALIZED (SELECT p.seq_id AS i, q.seq_id AS j, sum(least(p.cnt, q.cnt)) AS shared FROM mine p JOIN mine q ON p.word = q.word GROUP BY 1, 2)
    SELECT a.cluster, a.lm_ord AS src, b.lm_ord AS dst, coalesce(s.shared, 0) / least(x.windows, y.windows) AS weight
    FROM picked a JOIN picked b ON a.cluster = b.cluster AND a.lm_ord < b.lm_ord
    JOIN spans x ON x.seq_id = a.seq_id JOIN spans y ON y.seq_id = b.seq_id
    LEFT JOIN s ON s.i = a.seq_id AND s.j = b.seq_id"""

_KMER_NEAR = """
    WITH mine AS MATERIALIZED (SELECT w.word, w.cnt FROM words w JOIN pick_{before} p ON p.seq_id = w.seq_id),
    s AS MATERIALIZED (SELECT x.seq_id, sum(least(x.cnt, y.cnt)) AS shared FROM words x JOIN mine y ON x.word = y.word GROUP BY 1)
    SELECT n.* REPLACE (least(n.d_min, 1 - coalesce(s.shared, 0) / least(a.windows, b.windows)) AS d_min)
    FROM near_{before} n JOIN pick_{before} p ON p.cluster = n.cluster
    JOIN spans a ON a.seq_id = n.seq_id JOIN spans b ON b.seq_id = p.seq_id LEFT JOIN s ON s.seq_id = n.seq_id
    WHERE n.m > {before} + 1"""


def _division() -> None:
    """The largest cluster is split, three times in turn: copies of the views of one split, each over its own reads."""
    steps = [f"{name}_{i}" for i in range(STEPS) for name in ("near", "pick")]
    steps += ["picked", "edges", "ends", "degrees", *(f"values_{i}" for i in range(ITERATIONS + 1)), "cut"]
    VIEWS["labels_0"] = (["seqs_syn"], "SELECT seq_id, 1 AS cluster FROM seqs_syn")
    for n in range(SPLITS):
        VIEWS[f"largest_{n}"] = ([f"labels_{n}"], f"SELECT cluster, count(*) AS size FROM labels_{n} GROUP BY cluster ORDER BY size DESC, cluster LIMIT 1")
        VIEWS[f"quotas_s{n}"] = ([f"largest_{n}"], f"SELECT cluster, size, greatest(CAST(ceil(log2(size)) AS INT) - 1, 1) AS m FROM largest_{n}")
        VIEWS[f"members_s{n}"] = ([f"labels_{n}", f"largest_{n}", "members"], f"""
            SELECT m.seq_id, m.read, m.bucket, l.cluster FROM labels_{n} l JOIN largest_{n} g ON g.cluster = l.cluster JOIN members m ON m.seq_id = l.seq_id""")
        renamed = re.compile(rf"\b({'|'.join([*steps, 'members', 'quotas'])})\b")
        for name in steps:
            needs, body = VIEWS[name]
            if name == "edges":
                needs, body = ["picked", "words", "spans"], _KMER_EDGES
            elif name.startswith("near_") and name != "near_0":
                body = _KMER_NEAR.format(before=int(name[5:]) - 1)
            VIEWS[f"{name}_s{n}"] = ([renamed.sub(rf"\1_s{n}", x) for x in needs], renamed.sub(rf"\1_s{n}", body))
        VIEWS[f"labels_{n + 1}"] = ([f"labels_{n}", f"members_s{n}", f"picked_s{n}", f"cut_s{n}", "words", "spans"], f"""
            WITH mine AS MATERIALIZED (SELECT w.seq_id, w.word, w.cnt FROM words w JOIN (SELECT DISTINCT seq_id FROM picked_s{n}) p ON p.seq_id = w.seq_id),
            s AS MATERIALIZED (SELECT w.seq_id, v.seq_id AS lm_id, sum(least(w.cnt, v.cnt)) AS shared FROM words w JOIN mine v ON w.word = v.word GROUP BY 1, 2),
            dist AS (
              SELECT m.seq_id, m.cluster, p.lm_ord, 1 - coalesce(s.shared, 0) / least(a.windows, b.windows) AS d
              FROM members_s{n} m JOIN picked_s{n} p ON p.cluster = m.cluster
              JOIN spans a ON a.seq_id = m.seq_id JOIN spans b ON b.seq_id = p.seq_id
              LEFT JOIN s ON s.seq_id = m.seq_id AND s.lm_id = p.seq_id),
            means AS (
              SELECT d.seq_id, d.cluster, round(avg(CASE WHEN side = 0 THEN d END), 12) AS l, round(avg(CASE WHEN side = 1 THEN d END), 12) AS r
              FROM dist d JOIN cut_s{n} c ON c.cluster = d.cluster AND c.lm_ord = d.lm_ord GROUP BY 1, 2)
            SELECT l.seq_id, CASE WHEN m.seq_id IS NULL THEN l.cluster WHEN m.l <= m.r THEN 2 * l.cluster ELSE 2 * l.cluster + 1 END AS cluster
            FROM labels_{n} l LEFT JOIN means m ON m.seq_id = l.seq_id AND m.cluster = l.cluster""")
    passed = " UNION ALL ".join(
        f"SELECT 2 * p.cluster + c.side AS cluster, p.lm_ord, p.seq_id FROM picked_s{n} p JOIN cut_s{n} c ON c.cluster = p.cluster AND c.lm_ord = p.lm_ord"
        for n in range(SPLITS))
    VIEWS["leaf_landmarks"] = ([f"{name}_s{n}" for n in range(SPLITS) for name in ("picked", "cut")] + [f"labels_{SPLITS}", "seqs_syn"], f"""
        SELECT k.cluster, k.lm_ord, k.seq_id, s.read FROM ({passed}) k JOIN seqs_syn s USING (seq_id)
        WHERE k.cluster IN (SELECT cluster FROM labels_{SPLITS})""")
    VIEWS["leaf_hits"] = (["leaf_landmarks", "words", "spans", "reads_syn"], """
        WITH mine AS MATERIALIZED (SELECT w.seq_id, w.word, w.cnt FROM words w JOIN (SELECT DISTINCT seq_id FROM leaf_landmarks) p ON p.seq_id = w.seq_id),
        c AS MATERIALIZED (SELECT a.seq_id, b.seq_id AS lm_id, sum(least(a.cnt, b.cnt)) AS shared FROM words a JOIN mine b ON a.word = b.word GROUP BY 1, 2),
        near AS (
          SELECT seq_id, cluster FROM (
            SELECT c.seq_id, l.cluster, row_number() OVER (PARTITION BY c.seq_id ORDER BY round(c.shared / least(x.windows, y.windows), 12) DESC, l.cluster, l.lm_ord) AS rn
            FROM c JOIN leaf_landmarks l ON l.seq_id = c.lm_id JOIN spans x ON x.seq_id = c.seq_id JOIN spans y ON y.seq_id = c.lm_id
            WHERE c.shared / least(x.windows, y.windows) >= 0.6) WHERE rn = 1)
        SELECT header, cluster FROM (
          SELECT r.header, concat('cluster_', CAST(n.cluster AS VARCHAR)) AS cluster, row_number() OVER (PARTITION BY r.header ORDER BY n.seq_id DESC) AS rn
          FROM (SELECT DISTINCT header, md5(read) AS seq_id FROM reads_syn) r JOIN near n USING (seq_id)) WHERE rn = 1""")


_division()


def _short_sql() -> str:
    """Every short read, on both strands, against the first one of each market segment."""
    words = "list_transform(range(1, length({0}) - 2), lambda i: substr({0}, i, 4))".format
    pairs = f"""
    WITH reads AS ({_SHORT}), marks AS (
        SELECT c_mktsegment AS cluster, a AS b FROM reads JOIN (SELECT min(pair) AS pair FROM reads GROUP BY c_mktsegment) USING (pair)
    ), facing AS (SELECT pair, '+' AS strand, a FROM reads UNION ALL SELECT pair, '-', reverse(translate(a, 'ACGT', 'TGCA')) FROM reads)
    SELECT concat(CAST(pair AS VARCHAR), '|', strand, '|', cluster) AS pair, a, b FROM facing, marks
    WHERE list_has_any({words('a')}, {words('b')})"""
    return f"""
SELECT CAST(split_part(pair, '|', 1) AS BIGINT) AS seq_id, split_part(pair, '|', 3) AS cluster, 0 AS lm_ord, round(1 - d, 9) AS identity, split_part(pair, '|', 2) AS strand
FROM ({_sweep_sql(pairs)}) WHERE 1 - d >= 0.5
QUALIFY row_number() OVER (PARTITION BY seq_id ORDER BY round(1 - d, 9) DESC, cluster, strand) = 1"""


ORACLES: dict[str, str] = {
    "fasta_scan": _with(["reads_syn"], "SELECT concat(header, chr(10), read, chr(10)) AS value FROM reads_syn"),
    "fasta_parse": _with(["reads_any"], "SELECT header, read FROM reads_any"),
    "header_lookup": _with(["by_header"], "SELECT header, read FROM by_header"),
    "hits_scan": _with(["hits_syn"], "SELECT header_set, cluster FROM hits_syn"),
    "hits_union": _with(["hits_syn", "reads_any"], """
        SELECT header_set, cluster FROM hits_syn
        UNION ALL SELECT concat('Set(', header, ')'), source FROM reads_any"""),
    "members_scan": _with(["members_syn"], "SELECT query, target FROM members_syn"),
    "centroid_scan": _with(["centroids_syn"], "SELECT CAST(cluster AS VARCHAR) AS cluster, centroid, read FROM centroids_syn"),
    "otu_table_scan": _with(["counts_syn"], """
        SELECT s.sample, c.centroid, CAST(coalesce(sum(n), 0) AS BIGINT) AS n
        FROM (SELECT DISTINCT sample FROM counts_syn) s CROSS JOIN (SELECT DISTINCT centroid FROM counts_syn) c
        LEFT JOIN counts_syn k ON k.sample = s.sample AND k.centroid = c.centroid GROUP BY ALL"""),
    "derep_sink": _with(["reads_syn"], """
        SELECT concat('Set(', string_agg(header, ', ' ORDER BY header), ')') AS header_set, read
        FROM (SELECT DISTINCT read, header FROM reads_syn) GROUP BY read"""),
    "partition_sink": _with(["members"], "SELECT concat('cluster_', CAST(cluster AS VARCHAR)) AS header, read FROM members"),
    "landmark_sink": _with(["landmarks"], "SELECT concat('cluster_', CAST(cluster AS VARCHAR)) AS header, read FROM landmarks"),
    "cluster_fanout_sink": _with(["assigned_syn"], """
        SELECT concat('cluster_', CAST(cluster AS VARCHAR)) AS cluster, header, read FROM assigned_syn"""),
    "cluster_union": _with(["assigned_syn", "reads_any"], """
        SELECT concat('cluster_', CAST(cluster AS VARCHAR)) AS cluster, header, read FROM assigned_syn
        UNION ALL SELECT source, header, read FROM reads_any"""),
    "cluster_count": _with(["assigned_syn"], "SELECT count(DISTINCT cluster) AS n_clusters FROM assigned_syn"),
    "centroid_sink": _with(["otus_syn"], "SELECT concat('OTU_', CAST(otu_num AS VARCHAR)) AS otu, read FROM otus_syn"),
    "otu_table": _with(["named_syn"], f"SELECT otu, {_SAMPLE_SUMS} FROM named_syn GROUP BY otu, otu_num ORDER BY otu_num"),
    "otu_table_sink": _with(["named_syn"], """
        SELECT o.otu, s.sample, CAST(coalesce(sum(n), 0) AS BIGINT) AS n
        FROM (SELECT DISTINCT otu FROM named_syn) o CROSS JOIN (SELECT DISTINCT sample FROM named_syn) s
        LEFT JOIN named_syn k ON k.otu = o.otu AND k.sample = s.sample GROUP BY ALL"""),
    "abundance_filter": _with(["seqs_syn"], "SELECT seq_id, abundance FROM seqs_syn"),
    "base_code": _with(["reads_any"], "SELECT header, translate(read, 'ACGT', '0103') AS code FROM reads_any"),
    "kmer_index": _with(["seqs_doc"], f"SELECT word, CAST({_digits('word')} AS BIGINT) AS kmer FROM (SELECT DISTINCT word FROM ({_WINDOWS}))"),
    "kmer_explode": _with(["seqs_doc"], f"SELECT seq_id, CAST(pos AS INT) AS pos, CAST({_digits('word')} AS BIGINT) AS kmer FROM ({_WINDOWS})"),
    "kmer_counts": _with(["seqs_doc"], f"""
        SELECT seq_id, CAST({_digits('word')} AS BIGINT) AS kmer, count(*) AS cnt FROM ({_WINDOWS}) GROUP BY seq_id, word"""),
    "strip_blanks": _with(["reads_syn"], """
        SELECT md5(read) AS seq_id, concat('Set(', string_agg(header, ',' ORDER BY header), ')') AS header_set
        FROM (SELECT DISTINCT read, header FROM reads_syn) GROUP BY read"""),
    "header_set_explode": _with(["reads_syn", "seqs_syn"], """
        SELECT r.header, concat('cluster_', CAST(s.fam + 16 AS VARCHAR)) AS cluster
        FROM (SELECT DISTINCT header, md5(read) AS seq_id FROM reads_syn) r JOIN seqs_syn s USING (seq_id)"""),
    "sample_extract": _with(["reads_any", "reads_syn"], """
        SELECT header, split_part(header, '_', 1) AS sample
        FROM (SELECT header FROM reads_any UNION ALL SELECT header FROM reads_syn)"""),
    "cluster_filter": _with(["members"], "SELECT seq_id, cluster FROM members WHERE cluster = 16"),
    "alignment_sweep": _sweep_sql(),
    "divide_unlimited": _with(["seqs_syn"], """
        SELECT count(*) AS labels, count(DISTINCT seq_id) AS reads, count(*)::BIGINT AS in_leaves,
               0::BIGINT AS outside_leaves, 0::BIGINT AS nested FROM seqs_syn"""),
    "short_reads": f"SELECT count(*) AS n_short FROM documents WHERE length(regexp_replace(upper(text), '[^ACGT]', '', 'g')) < {K}",
    "subcluster_many": _with(["many"], """
        SELECT CAST(m.cluster AS VARCHAR) AS cluster, m.header AS query, f.header AS target, round(1 - hamming(m.read, f.read) / 128.0, 9) AS identity
        FROM many m JOIN (SELECT fam, min(header) AS header, arg_min(read, header) AS read FROM many GROUP BY fam) f ON f.fam = m.fam
        WHERE m.header <> f.header"""),
    "subcluster_picker": _with(["assigned_syn"], """
        SELECT CAST(cluster AS VARCHAR) AS cluster, header AS query, target, 1.0::DOUBLE AS identity
        FROM (SELECT *, first_value(header) OVER (PARTITION BY cluster ORDER BY length(read) DESC, header) AS target FROM assigned_syn)
        WHERE header <> target"""),
    "landmark_quota": """
        SELECT size, q AS quota, greatest(q - 1, 1) AS m FROM (
          SELECT size, CASE WHEN size < 2 THEN 0 ELSE CAST(ceil(log2(size)) AS INT) END AS q
          FROM (SELECT DISTINCT l_orderkey AS size FROM lineitem))""",
    "attach_cluster": _with(["seqs_syn"], "SELECT seq_id, abundance, fam + 16 AS cluster FROM seqs_syn"),
    "kmer_distance": _with(["root_dist"], "SELECT seq_id, CAST(cluster AS BIGINT) AS cluster, CAST(lm_ord AS INT) AS lm_ord, round(d, 9) AS d FROM root_dist"),
    "assign_side": _with(["root_dist"], """
        SELECT seq_id, CAST(1 AS BIGINT) AS cluster, CASE WHEN l <= r THEN 0 ELSE 1 END AS side FROM (
          SELECT seq_id, round(avg(CASE WHEN lm_ord % 2 = 0 THEN d END), 12) AS l,
                 round(avg(CASE WHEN lm_ord % 2 = 1 THEN d END), 12) AS r FROM root_dist GROUP BY seq_id)"""),
    "min_distance": _with(["bucketed"], "SELECT seq_id, cluster, round(d, 9) AS d_min FROM bucketed"),
    "bucket_median": _with(["medians"], "SELECT cluster, CAST(bucket AS INT) AS bucket, round(median, 9) AS median FROM medians"),
    "median_of_medians": _with(["medians"], """
        SELECT cluster, round(list_sort(list(median))[CAST(floor(count(*) / 2) AS INT) + 1], 9) AS mom FROM medians GROUP BY cluster"""),
    "alignment_distance": _with(["members", "landmarks"], """
        SELECT m.seq_id, CAST(l.lm_ord AS INT) AS lm_ord, round(hamming(m.read, l.read) / 128.0, 9) AS d
        FROM members m JOIN landmarks l ON l.cluster = m.cluster"""),
    "landmark_graph": _with(["edges"], "SELECT cluster, src, dst, round(weight, 9) AS weight FROM edges"),
    "landmark_graph_kmer": _with(["landmarks", "words", "spans"], """
        SELECT a.cluster, a.lm_ord AS src, b.lm_ord AS dst,
               round(coalesce(s.shared, 0) / least(x.windows, y.windows), 9) AS weight
        FROM landmarks a JOIN landmarks b ON a.cluster = b.cluster AND a.lm_ord < b.lm_ord
        JOIN spans x ON x.seq_id = a.seq_id JOIN spans y ON y.seq_id = b.seq_id
        LEFT JOIN (SELECT p.seq_id AS i, q.seq_id AS j, sum(least(p.cnt, q.cnt)) AS shared
                   FROM (SELECT * FROM words WHERE seq_id IN (SELECT seq_id FROM landmarks)) p
                   JOIN (SELECT * FROM words WHERE seq_id IN (SELECT seq_id FROM landmarks)) q ON p.word = q.word
                   GROUP BY 1, 2) s ON s.i = a.seq_id AND s.j = b.seq_id"""),
    "medoid_radius": _with(["radii"], "SELECT cluster, round(radius, 9) AS radius FROM radii"),
    "radius_stop": _with(["radii"], f"SELECT cluster, round(radius, 9) AS radius FROM radii WHERE radius <= {TIGHT_RADIUS}"),
    "pic_bisect": _with(["cut"], "SELECT cluster, CAST(lm_ord AS INT) AS lm_ord, side FROM cut"),
    "nearest_landmark": _with(["words", "spans", "landmarks", "facing_words"], _NEAREST.format(identity="round(c.shared / w.windows, 9)")),
    "nearest_landmark_aligned": _with(
        ["words", "spans", "landmarks", "facing_words"], _NEAREST.format(identity="round(1 - hamming(f.read, l.read) / 128.0, 9)")),
    "nearest_landmark_short": _short_sql(),
    "hit_dedupe": _with(["header_hits"], "SELECT header, cluster FROM header_hits"),
    "assign_all": _with(["by_header", "header_hits"], f"""
        , slots AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS slot FROM (SELECT DISTINCT cluster FROM header_hits))
        SELECT r.header, r.read, coalesce(h.cluster, s.cluster) AS cluster
        FROM by_header r LEFT JOIN header_hits h ON h.header = r.header
        LEFT JOIN slots s ON s.slot = {_key("concat_ws('|', 'fallback|0', r.header)")} % (SELECT count(*) FROM slots)"""),
    "unassigned_reads": _with(["by_header", "header_hits"], """
        SELECT header, read FROM by_header WHERE header NOT IN (SELECT header FROM header_hits)"""),
    "assigned_reads": _with(["by_header", "header_hits"], """
        SELECT header, read FROM by_header WHERE header IN (SELECT header FROM header_hits)"""),
    "observed_clusters": _with(["hits_syn"], "SELECT DISTINCT cluster FROM hits_syn"),
    "cluster_members": _with(["assigned_syn"], "SELECT cluster, count(*) AS n_reads FROM assigned_syn GROUP BY cluster"),
    "select_landmarks_aligned": _with(["picked"], "SELECT cluster, CAST(lm_ord AS INT) AS lm_ord, seq_id FROM picked", ALIGNED),
    "kmer_counts_strict": _with(["reads_doc"], f"""
        , odd AS (SELECT DISTINCT translate(read, 'G', 'N') AS read FROM reads_doc), windows AS (
          SELECT md5(read) AS seq_id, substr(read, i, {K}) AS word FROM (SELECT read, unnest(range(1, length(read) - {K} + 2)) AS i FROM odd))
        SELECT seq_id, CAST({_digits('word')} AS BIGINT) AS kmer, count(*) AS cnt FROM windows WHERE NOT contains(word, 'N') GROUP BY seq_id, word"""),
    "stage_counts": _with(["reads_syn", "unique_syn"], """
        SELECT 'input' AS stage, count(*) AS n FROM reads_syn UNION ALL SELECT 'unique', count(*) FROM unique_syn
        UNION ALL SELECT 'abundant', count(*) FROM unique_syn WHERE abundance >= 2"""),
    "dereplicate": _with(["reads_syn"], """
        SELECT md5(read) AS seq_id, string_agg(header, ',' ORDER BY header) AS headers, count(*) AS abundance
        FROM (SELECT DISTINCT read, header FROM reads_syn) GROUP BY read"""),
    "abundance": _with(["seqs_doc"], "SELECT seq_id, abundance FROM seqs_doc"),
    "cluster_sizes": _with(["sizes"], "SELECT cluster, size FROM sizes"),
    "largest_cluster": _with(["sizes"], "SELECT cluster, size FROM sizes ORDER BY size DESC, cluster LIMIT 1"),
    "side_summary": _with(["landmarks"], """
        SELECT cluster * 2 + lm_ord % 2 AS child, string_agg(CAST(lm_ord AS VARCHAR), ',' ORDER BY lm_ord) AS landmarks
        FROM landmarks GROUP BY 1"""),
    "cluster_tree": _with(["sizes"], """
        SELECT node AS cluster, CASE WHEN node > 1 THEN node // 2 END AS parent,
               CAST(floor(log2(node)) AS INT) AS depth, CAST(sum(size) AS BIGINT) AS size
        FROM (SELECT unnest([cluster, cluster // 2, cluster // 4, cluster // 8, cluster // 16]) AS node, size FROM sizes)
        GROUP BY node"""),
    "otu_counts": _with(["counts_syn"], "SELECT cluster, centroid, sample, n FROM counts_syn"),
    "otu_counts_with_centroid": _with(["assigned_syn"], """
        SELECT cluster, min(min(header)) OVER (PARTITION BY cluster) AS centroid, split_part(header, '_', 1) AS sample, count(*) AS n
        FROM assigned_syn GROUP BY cluster, split_part(header, '_', 1)"""),
    "otu_pivot": _with(["counts_syn"], f"SELECT sample, {_CLUSTER_SUMS} FROM counts_syn GROUP BY sample"),
    "otu_table_merge": _with(["named_syn"], "SELECT otu_num, otu, sample, n FROM named_syn"),
    "otu_rename": _with(["named_syn"], "SELECT otu_num, otu, sample, n FROM named_syn"),
    "seeded_pick": _with(["members"], f"""
        SELECT seq_id, cluster, read FROM (
          SELECT *, row_number() OVER (PARTITION BY cluster
                    ORDER BY {_key("concat_ws('|', '0', CAST(cluster AS VARCHAR), '0', seq_id)")}, seq_id) AS rn
          FROM members) WHERE rn = 1"""),
    "length_rank": _with(["reads_any"], """
        SELECT source AS cluster, header,
               CAST(row_number() OVER (PARTITION BY source ORDER BY length(read) DESC, header) AS INT) AS rank FROM reads_any"""),
    "otu_numbering": _with(["reads_any"], """
        SELECT source AS cluster, header AS centroid, n AS otu_num, concat('OTU_', CAST(n AS VARCHAR)) AS otu FROM (
          SELECT *, row_number() OVER (ORDER BY source, length(read) DESC, header) - 1 AS n FROM reads_any)"""),
    "select_landmarks": _with(["picked"], "SELECT cluster, lm_ord, seq_id FROM picked"),
    "split_once": _split_once(),
    "subcluster": _with(["assigned_syn", "centroids_syn"], """
        SELECT CAST(a.cluster AS VARCHAR) AS cluster, a.header AS query, c.centroid AS target,
               round(1 - hamming(a.read, c.read) / 128.0, 9) AS identity
        FROM assigned_syn a JOIN centroids_syn c ON c.cluster = a.cluster WHERE a.header <> c.centroid"""),
}
ORACLES["divide_kmer"] = _with([f"labels_{SPLITS}"], f"SELECT seq_id, CAST(cluster AS BIGINT) AS cluster FROM labels_{SPLITS}")
ORACLES["leaf_landmarks_kmer"] = _with(["leaf_landmarks"], "SELECT CAST(cluster AS BIGINT) AS cluster, CAST(lm_ord AS INT) AS lm_ord, seq_id, read FROM leaf_landmarks")
ORACLES["otu_end_to_end_kmer"] = _with(["leaf_hits", "by_header", "unique_syn"], f"""
    , slots AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS slot FROM (SELECT DISTINCT cluster FROM leaf_hits)),
    placed AS (
      SELECT r.header, r.read, coalesce(h.cluster, s.cluster) AS cluster FROM by_header r LEFT JOIN leaf_hits h ON h.header = r.header
      LEFT JOIN slots s ON s.slot = {_key("concat_ws('|', 'fallback|0', r.header)")} % (SELECT count(*) FROM slots)),
    units AS (SELECT p.*, u.fam, min(p.header) OVER (PARTITION BY p.cluster, u.fam) AS centroid FROM placed p JOIN unique_syn u ON u.read = p.read),
    otus AS (SELECT cluster, centroid, row_number() OVER (ORDER BY cluster, centroid) - 1 AS otu_num FROM (SELECT DISTINCT cluster, centroid FROM units))
    SELECT otu_num, concat('OTU_', CAST(otu_num AS VARCHAR)) AS otu, split_part(header, '_', 1) AS sample, count(*) AS n
    FROM units JOIN otus USING (cluster, centroid) WHERE header <> centroid GROUP BY ALL""")
ORACLES["stage_counts_observed"] = ORACLES["stage_counts"]
ORACLES["nearest_landmark_stream"] = ORACLES["nearest_landmark_aligned"]
