"""Source divergence audit: how far each source's vocabulary is from its language's, and from every other source's.

Terms are counted for each (lang, source) group. A lang keeps the terms that enough of
its documents have. p is a term's smoothed share in a group, q in its lang, both whole
numbers of about 10^9 in sum, and f = floor((p - q)^2 / (p + q)).

`term`: the K terms of each group with p > q and the largest f. f grows with p and falls
with q. A group's terms are put into buckets by count; a bucket's largest p and the smallest
q of its terms bound each f in it. Buckets are opened best first: those with the largest bounds
until K terms are seen, and then every one whose bound isn't strictly below the k-th
value found. What stays unopened can neither beat nor tie with a result.

`pair`: f summed over all kept terms, for every two sources of a lang. Terms have postings
(which groups have them, and p); groups without a term have the p of count 0. The
postings of some terms form a small matrix for a tile of groups, which adds up
f for the pairs of the tile, column by column; terms that none of a tile's groups
has add a constant each. No pairs are made for a term.

Arithmetic is exact: counts and shares are longs, products of them decimals.

Edge cases: null text, lang or source counts as ''; a group without terms has all its
`pair` rows and no `term` rows; a lang without kept terms has values of 0; a text of any length is
read whole, in pieces of bounded size; rows that repeat an id are documents of
their own; ties go to the smaller item by its UTF-8 bytes; an empty table gives an empty
table; columns other than text, lang and source are neither read nor returned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parlance.llm.common import cut, drop, prepare

LEAST_DOCS, K, SCALE = 10, 10, 1_000_000_000
#: Bytes of a text that are split at once, and entries that a task counts before it sends them on.
PIECE, ENTRIES = 1 << 22, 200_000
#: Groups of a tile, and about how many terms its matrix has.
TILE, TERMS = 64, 256
#: Buckets for each doubling of the count.
STEPS = 4

#: Letters A-Z in lower case, what no term has as a space.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> Counter:
    """How often a text (UTF-8) has each term."""
    found: Counter = Counter()
    a = 0
    while a < len(text):
        z = a + PIECE
        if z < len(text):
            # up to the next byte that no term has
            tail = text[z : z + PIECE].translate(_TERM)
            while (at := tail.find(b" ")) < 0 and z + len(tail) < len(text):
                z += len(tail)
                tail = text[z : z + PIECE].translate(_TERM)
            z = z + at if at >= 0 else len(text)
        found.update(text[a:z].translate(_TERM).split())
        a = z
    return found


COUNTS = "lang string, source string, term string, n long, docs long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """COUNTS of a task's documents, and a row without term for each group."""
    n: dict[tuple[str, str], Counter] = {}
    docs: dict[tuple[str, str], Counter] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for g, c in n.items():
            items = list(c.items())
            d = docs[g]
            for i in range(0, len(items), 50_000):
                some = items[i : i + 50_000]
                terms = pa.array([t for t, _ in some], pa.binary()).cast(pa.string())
                names = [pa.array([x] * len(some), pa.string()) for x in g]
                yield pa.RecordBatch.from_arrays([*names, terms, pa.array([m for _, m in some], pa.int64()), pa.array([d[t] for t, _ in some], pa.int64())], names=["lang", "source", "term", "n", "docs"])
            yield pa.RecordBatch.from_arrays([pa.array([g[0]]), pa.array([g[1]]), pa.array([None], pa.string()), pa.array([0], pa.int64()), pa.array([0], pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for b in batches:
        for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), b["text"].cast(pa.binary()).to_pylist(), strict=True):
            g = lang, source
            if g not in n:
                n[g], docs[g] = Counter(), Counter()
            found = terms_of(text)
            n[g].update(found)
            docs[g].update(found.keys())
        if sum(map(len, n.values())) > ENTRIES:
            yield from rows()
            n, docs = {}, {}
    yield from rows()


def share(count: str, total: str, terms: str) -> str:
    """p as SQL: 1 + floor(SCALE * (count + 2) / (total + 2 * terms)); a decimal holds the product."""
    return f"(1 + ({SCALE}BD * ({count} + 2)) DIV ({total} + 2 * {terms}))"


def distance(p: str, q: str) -> str:
    """f as SQL: floor((p - q)^2 / (p + q)); below 2^63, as shares are at most about SCALE."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) DIV (({p}) + ({q})))"


def counts(docs: DataFrame) -> DataFrame:
    """`lang, source, term, n, docs`, written: how often a group has a term and in how many documents; and a row without term for each group."""
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    return cut(named.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))


def shares(found: DataFrame, least_docs: int = LEAST_DOCS) -> tuple[DataFrame, DataFrame]:
    """Two written tables.

    Groups: `lang, source, g, terms, p0`: its number within the lang, kept terms of the lang, and p of a term that it doesn't have.
    Kept terms of groups: `lang, g, term, n, p, q`.
    """
    of_lang = found.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
    kept = cut(found.where("term IS NOT NULL").drop("docs").join(of_lang, ["lang", "term"]))
    lang = kept.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    number = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("g")
    groups = found.where("term IS NULL").select("lang", "source").join(lang, "lang", "left").join(group, ["lang", "source"], "left").fillna(0, ["terms", "lang_total", "total"])
    p0 = F.expr(f"CASE WHEN terms > 0 THEN {share('0L', 'total', 'terms')} ELSE 1L END")
    groups = cut(groups.select("lang", "source", number, "terms", "lang_total", "total", p0.alias("p0")))
    known = kept.join(groups, ["lang", "source"])
    known = cut(known.select("lang", "g", "term", "n", F.expr(share("n", "total", "terms")).alias("p"), F.expr(share("lang_n", "lang_total", "terms")).alias("q")))
    drop(kept)
    return groups, known


def top_terms(known: DataFrame, k: int = K) -> DataFrame:
    """`lang, g, term, value, rank`: the k terms of each group with p > q and the largest f."""
    by = ["lang", "g"]
    rows = known.withColumn("bucket", F.floor(STEPS * F.log2("n")).cast("int"))
    buckets = rows.groupBy(*by, "bucket").agg(F.count("*").alias("of"), F.max("p").alias("p"), F.min("q").alias("q")).where("p > q")
    # a group has at most 63 * STEPS buckets
    seen = F.sum("of").over(Window.partitionBy(*by).orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1))
    buckets = cut(buckets.select(*by, "bucket", "of", F.expr(distance("p", "q")).alias("bound")).withColumn("seen", F.coalesce(seen, F.lit(0))))

    def best(terms: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("value"), "term"))
        return terms.withColumn("rank", rank).where(F.col("rank") <= k)

    def opened(which: DataFrame) -> DataFrame:
        return rows.join(which.select(*by, "bucket"), [*by, "bucket"]).where("p > q").select(*by, "term", F.expr(distance("p", "q")).alias("value"))

    first = cut(best(opened(buckets.where(F.col("seen") < k))))
    kth = first.where(F.col("rank") == k).select(*by, F.col("value").alias("kth"))
    rest = buckets.where(F.col("seen") >= k).join(kth, by, "left").where("kth IS NULL OR bound >= kth")
    return best(first.drop("rank").union(opened(rest)))


def _tile(table: pa.Table) -> pa.Table:
    """Sums of f for the pairs of a tile's groups over some terms, and how many terms that were. Rows without term are the groups, with p of count 0."""
    term, g, p = table["term"].combine_chunks(), table["g"].to_numpy(), table["p"].to_numpy()
    name = pc.dictionary_encode(term)
    row = name.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    base = row < 0
    all_g, at = np.unique(g[base], return_index=True)
    column = np.searchsorted(all_g, g)
    shares_ = np.tile(p[base][at], (len(name.dictionary), 1))
    shares_[row[~base], column[~base]] = p[~base]
    a, b = table["a"][0].as_py(), table["b"][0].as_py()
    left, right = np.flatnonzero(all_g // TILE == a), np.flatnonzero(all_g // TILE == b)
    out: list[np.ndarray] = []
    for i in left.tolist():
        others = right[right > i]
        x, y = shares_[:, i : i + 1], shares_[:, others]
        f = ((x - y) * (x - y) // (x + y)).sum(0)
        out.append(np.stack([np.full(len(others), all_g[i]), all_g[others], f]))
    g0, g1, f = np.concatenate(out, 1) if out else np.zeros((3, 0), np.int64)
    lang = pa.array([table["lang"][0].as_py()] * len(f), pa.string())
    return pa.table({"lang": lang, "g0": g0, "g1": g1, "f": f, "seen": np.full(len(f), len(shares_))})


def pair_sums(groups: DataFrame, known: DataFrame) -> DataFrame:
    """`lang, g, other, value`: f summed over the lang's kept terms for every two different groups of a lang, each way."""
    # parts of the terms, and tiles of the groups of each lang
    sizes = groups.groupBy("lang").agg(F.expr(f"CAST(greatest(1, ceil(max(terms) / {TERMS})) AS INT)").alias("parts"), F.expr(f"CAST(max(g) DIV {TILE} AS INT)").alias("last"))
    posting = known.select("lang", "g", "term", "p").join(sizes, "lang").withColumn("part", F.expr("CAST(pmod(xxhash64(term), parts) AS INT)"))
    bare = groups.select("lang", "g", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p")).join(sizes, "lang").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # a posting goes to every pair of tiles that its group is in
    rows = posting.union(bare).withColumn("tile", F.explode(F.expr("sequence(0, last)"))).withColumn("own", F.expr(f"CAST(g DIV {TILE} AS INT)"))
    rows = rows.select("lang", "part", F.least("own", "tile").alias("a"), F.greatest("own", "tile").alias("b"), F.col("g").cast("long").alias("g"), "term", "p")
    sums = rows.groupBy("lang", "part", "a", "b").applyInArrow(_tile, "lang string, g0 long, g1 long, f long, seen long")
    sums = sums.groupBy("lang", "g0", "g1").agg(F.sum("f").alias("f"), F.sum("seen").alias("seen"))
    side = lambda n: groups.select("lang", F.col("g").cast("long").alias(f"g{n}"), "terms" if n == 0 else F.lit(0).alias("_"), F.col("p0").alias(f"p{n}"))
    sums = sums.join(side(0), ["lang", "g0"]).join(side(1), ["lang", "g1"])
    # terms that no group of the tile has
    value = F.expr(f"f + (terms - seen) * {distance('p0', 'p1')}")
    both = F.explode(F.array(F.struct(F.col("g0").alias("g"), F.col("g1").alias("other")), F.struct(F.col("g1").alias("g"), F.col("g0").alias("other"))))
    return sums.select("lang", value.alias("value"), both.alias("x")).select("lang", "x.g", "x.other", "value")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, k: int = K) -> DataFrame:
    """`lang, source, part, item, value, rank`: `pair` rows of every two sources of a lang, `term` rows of each group's k most unusual terms."""
    prepare(docs.sparkSession)
    found = counts(docs)
    groups, known = shares(found, least_docs)
    drop(found)
    name = groups.select("lang", "g", "source")
    other = groups.select("lang", F.col("g").alias("other"), F.col("source").alias("item"))
    pair = pair_sums(groups, known).join(name, ["lang", "g"]).join(other, ["lang", "other"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", rank)
    term = top_terms(known, k).join(name, ["lang", "g"])
    return pair.union(term.select("lang", "source", F.lit("term"), F.col("term").alias("item"), "value", "rank"))


#: DuckDB SQL of the query: every kept term of every group, without buckets or tiles.
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
c AS (SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM (SELECT id, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
l AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL HAVING sum(docs) >= {LEAST_DOCS}),
v AS (SELECT lang, count(*) AS terms, sum(n) AS total FROM l GROUP BY ALL),
k AS (SELECT c.lang, c.source, c.term, c.n FROM c JOIN l USING (lang, term)),
t AS (SELECT lang, source, sum(n) AS total FROM k GROUP BY ALL),
g AS (SELECT lang, source, coalesce(v.terms, 0) AS terms, coalesce(v.total, 0) AS lang_total, coalesce(t.total, 0) AS total FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN t USING (lang, source)),
p AS (
  SELECT g.lang, g.source, l.term, coalesce(k.n, 0) AS n,
    1 + {SCALE}::HUGEINT * (coalesce(k.n, 0) + 2) // (g.total + 2 * terms) AS p, 1 + {SCALE}::HUGEINT * (l.n + 2) // (lang_total + 2 * terms) AS q
  FROM g JOIN l ON l.lang = g.lang LEFT JOIN k ON k.lang = g.lang AND k.source = g.source AND k.term = l.term),
pair AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL
SELECT lang, source, 'term', term, CAST(value AS BIGINT), CAST(rank AS INTEGER)
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, term) AS rank FROM (SELECT lang, source, term, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q)) WHERE rank <= {K}
"""
