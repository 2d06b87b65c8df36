"""Source divergence, sharding and centroid clustering against brute force and their SQL, with odd rows."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from parlance.llm import centroids, divergence, queries, sharding

NAMES = ("op11_source_divergence", "op12_sharding", "op13_centroid_clustering")


def plain(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    ours, theirs = queries.queries()[name](spark, sf_dir), con.sql(queries.oracle_sql()[name])
    assert plain(ours) == sorted((tuple(r) for r in theirs.select(*(duckdb.ColumnExpression(c) for c in sorted(theirs.columns))).fetchall()), key=repr)


# -- source divergence


def brute_audit(rows, least=10, k=10):
    """rows of (text, lang, source)."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    groups, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang, source in rows:
        words = term.findall(lower(text))
        groups[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang in docs | {g[0]: 0 for g in groups}:
        kept = {t for t, n in docs[lang].items() if n >= least}
        mine = {s: {t: c[t] for t in kept} for (g, s), c in groups.items() if g == lang}
        whole = {t: sum(c[t] for c in mine.values()) for t in kept}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        f = lambda p, q: (p - q) ** 2 // (p + q)
        p, q = {s: share(c) for s, c in mine.items()}, share(whole)
        for s in mine:
            pair = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in mine if o != s]
            words = [(-f(p[s][t], q[t]), t.encode()) for t in kept if mine[s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", x.decode(), -v, i + 1) for i, (v, x) in enumerate(sorted(pair))]
            out += [(lang, s, "term", x.decode(), -v, i + 1) for i, (v, x) in enumerate(sorted(words)[:k])]
    return sorted(out)


def made_texts(seed, n=400, sources=5):
    r = random.Random(seed)
    words = [a + b for a in ("k", "Q", "é", "语") for b in "abcdefghijklmn"] + ["Ä", "z"]
    rows = []
    for _ in range(n):
        source = r.randrange(sources)
        mine = words[source * 7 : source * 7 + 30]
        rows.append((r.choice((" ", "-", "9", "\n", "_")).join(r.choices(mine, k=r.randrange(25))), r.choice(("en", "en", "xx")), f"s{source}"))
    return rows


ODD_TEXTS = [(None, None, None), ("", "en", None), (None, "en", "empty"), ("word " * 200_000, "en", "s1"), ("x" * 100_000, "xx", "s0"), ("\x00\x7f", "", "only"), ("a a", None, "s9"), ("a a", None, "s9")]
LISTED = ("lang", "source", "part", "item", "value", "rank")


@pytest.mark.parametrize("seed", [1, 2])
def test_audit(spark, seed, monkeypatch):
    # tiles of two groups, matrices of few terms and small batches, so that all of them meet
    monkeypatch.setattr(divergence, "TERMS", 8)
    rows = made_texts(seed) + ODD_TEXTS
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "text string, lang string, source string, n int, term string, g int").repartition(4)
    got = sorted(tuple(r) for r in divergence.audit(df).select(*LISTED).collect())
    assert got == brute_audit(rows)


def test_audit_many_sources(spark):
    """More groups than a tile has."""
    rows = [(t, "en", f"s{i % 150}") for i, (t, _, _) in enumerate(made_texts(5, n=600))]
    got = sorted(tuple(r) for r in divergence.audit(spark.createDataFrame(rows, "text string, lang string, source string")).select(*LISTED).collect())
    assert got == brute_audit(rows)


def test_audit_empty(spark):
    df = spark.createDataFrame([], "text string, lang string, source string")
    assert divergence.audit(df).count() == 0


def test_unopened_buckets_cannot_win(spark, sf_dir):
    """Every term that isn't among the results lies in a bucket whose bound the k-th value beats, or was opened."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    _, known = divergence.shares(divergence.counts(docs))
    top = divergence.top_terms(known)
    every = collections.defaultdict(list)
    for r in known.where("p > q").collect():
        every[r.lang, r.g].append(((r.p - r.q) ** 2 // (r.p + r.q), r.term))
    got = collections.defaultdict(list)
    for r in top.collect():
        got[r.lang, r.g].append((r.rank, r.value, r.term))
    for g, terms in every.items():
        best = sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:10]
        assert [(v, t) for _, v, t in sorted(got[g])] == best


def test_terms_of_long_texts(monkeypatch):
    text = "".join(random.Random(1).choices(["ab", " ", "É", "Q", "\n", "9"], k=5000)).encode()
    whole = divergence.terms_of(text)
    for piece in (1, 7, 1000):
        monkeypatch.setattr(divergence, "PIECE", piece)
        assert divergence.terms_of(text) == whole


def test_tasks_that_send_early(monkeypatch):
    rows = made_texts(3, n=60)
    batches = [pa.RecordBatch.from_pylist([{"text": t or "", "lang": g, "source": o} for t, g, o in rows[i : i + 5]]) for i in range(0, len(rows), 5)]

    def counted():
        n = collections.Counter()
        for b in divergence._count(batches):
            for r in b.to_pylist():
                n[r["lang"], r["source"], r["term"], "n"] += r["n"]
                n[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        return n

    whole = counted()
    monkeypatch.setattr(divergence, "ENTRIES", 50)
    assert counted() == whole


# -- sharding


def held(rows, got, shards=8):
    """What must hold of any sharding by bytes; rows of (doc_id, text)."""
    size = lambda t: len((t or "").encode()) + 1
    wanted = collections.Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == wanted
    slots = collections.defaultdict(list)
    bytes_ = collections.Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        bytes_[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))
    largest = max((size(t) for _, t in rows), default=0)
    share = sum(bytes_.values()) / shards
    assert all(abs(bytes_[s] - share) <= largest for s in range(shards))


def made_records(kind):
    r = random.Random(3)
    text = lambda n: "".join(r.choices("abcd é", k=n))
    if kind == "odd":
        return [(None, None), (None, ""), (1, None), (1, ""), (2, "same"), (2, "same"), (3, "x" * 200_000), (4, "é语"), (-5, "z")]
    if kind == "copies":  # a third of all rows has one text, another third is one row again and again
        return [(i, "hot " * 20) for i in range(1500)] + [(7, "again")] * 1500 + [(10_000 + i, text(r.randrange(60))) for i in range(1500)]
    if kind == "tiny":  # most rows weigh next to nothing
        return [(i, None) for i in range(3000)] + [(5000 + i, text(3000)) for i in range(60)]
    return [(i, text(int(r.paretovariate(1.1) * 20) % 5000)) for i in range(2000)]


@pytest.mark.parametrize("kind", ["plain", "copies", "tiny", "odd"])
def test_sharding(spark, kind):
    rows = made_records(kind)
    df = spark.createDataFrame([(*r, 5, "k", 1) for r in rows], "doc_id long, text string, size int, key string, shard int").repartition(3)
    got = sharding.report(df)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    held(rows, got.collect())


@pytest.mark.parametrize("kind", ["plain", "copies", "tiny"])
def test_no_range_is_overfull(spark, kind):
    rows = made_records(kind)
    df = sharding.records(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    found, counts = sharding.splitters(df, 32)
    n, size = sum(a for a, _ in counts.values()), sum(b for _, b in counts.values())
    assert n == len(rows) and len(found) < 32 * 6
    largest = df.agg({"size": "max"}).first()[0]
    assert all(a == 1 or (a <= 3 * n / 32 and b <= 3 * size / 32 + largest) for a, b in counts.values())


def test_splitters_do_not_change_the_result(spark):
    df = spark.createDataFrame(made_records("copies"), "doc_id long, text string").repartition(3)
    one, many = (plain(sharding.assign(df, ranges=n).drop("row")) for n in (1, 64))
    assert one == many


def test_range_of(spark):
    rows = [(k, d, i) for i, (k, d) in enumerate((k, d) for k in (1, 5, 9) for d in (None, 3, 4))]
    df = spark.createDataFrame(rows, "key long, doc_id long, row long")
    order = lambda r: (r[0], r[1] is not None, r[1] or 0, r[2])
    for n in range(len(rows) + 1):
        cuts = sorted(rows, key=order)[:: max(1, len(rows) // n)][:n] if n else []
        got = {r.row: r.at for r in df.select("row", sharding.range_of(cuts).alias("at")).collect()}
        assert got == {r[2]: sum(order(c) <= order(r) for c in cuts) for r in rows}


def test_sharding_empty(spark):
    assert sharding.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_written_shards(spark, tmp_path):
    rows = made_records("plain")
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, slot long")
    sharding.write_shards(df, str(tmp_path / "out"), 8, file_rows=100)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert collections.Counter((r.doc_id, r.text) for r in got.collect()) == collections.Counter(rows)
    size = {r.shard: r.s for r in got.selectExpr("shard", "octet_length(text) + 1 AS s").groupBy("shard").agg({"s": "sum"}).withColumnRenamed("sum(s)", "s").collect()}
    assert len(size) == 8 and max(size.values()) - min(size.values()) <= 2 * 5001


# -- centroid clustering


def brute_clusters(rows, k=16, rounds=3, dimension=64):
    """rows of (vec_id, vector): the contract in Python's integers."""
    good = lambda v: v is not None and len(v) == dimension and all(x is not None and math.isfinite(x) for x in v)
    whole = lambda x: math.floor(64 * x) if abs(x) < 1e300 else int(x) * 64
    kept = [(i, [whole(float(x)) for x in v]) for i, v in rows if good(v)]
    first = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    c = [v for _, v in first[:k]]
    if not c:
        return []
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, m, strict=True)), j) for j, m in enumerate(c))
    for _ in range(rounds):
        of = collections.defaultdict(list)
        for _, v in kept:
            of[near(v)[1]].append(v)
        c = [[sum(x) // len(of[j]) for x in zip(*of[j], strict=True)] if j in of else m for j, m in enumerate(c)]
    most = 2**63 - 1
    out = [(i, near(v)[1], min(most, near(v)[0])) for i, v in kept]
    sums = collections.Counter()
    for _, j, d in out:
        sums[j] += d
    digest = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return [(i, j, d, min(most, sums[j]), min(most, sum(sums.values())), digest[j]) for i, j, d in out]


def same_clusters(spark, rows, kind="double", parts=3):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], f"vec_id long, embedding array<{kind}>, cluster int, v int").repartition(parts)
    got = [tuple(r) for r in centroids.cluster(df).collect()]
    assert sorted(got, key=repr) == sorted(brute_clusters(rows), key=repr)


def vector(r, scale=1.0):
    return [scale * r.gauss(0, 1) for _ in range(64)]


def test_clusters_of_plain_vectors(spark):
    r = random.Random(1)
    same_clusters(spark, [(i, vector(r, 0.3)) for i in range(300)])


def test_clusters_of_ties(spark):
    """Few different vectors, many of them as far from one centroid as from another."""
    r = random.Random(2)
    unit = lambda i: [float(j == i) for j in range(64)]
    same_clusters(spark, [(i, unit(r.randrange(6))) for i in range(200)] + [(1000 + i, [0.0] * 64) for i in range(20)] + [(2000, unit(9))] * 3)


def test_clusters_of_odd_vectors(spark):
    r = random.Random(3)
    inf, nan = float("inf"), float("nan")
    odd = [(1, None), (2, []), (3, [1.0] * 63), (4, [1.0] * 65), (5, [inf] + [0.0] * 63), (6, [nan] + [0.0] * 63), (7, [None] + [0.0] * 63), (None, vector(r)), (8, vector(r)), (8, vector(r)), (8, [-1e-300] * 64)]
    same_clusters(spark, odd + [(20 + i, vector(r)) for i in range(30)])
    same_clusters(spark, odd[:7])
    same_clusters(spark, [(None, vector(r))])
    same_clusters(spark, odd[8:10])


@pytest.mark.parametrize("scale", [1e6, 1e9, 1e17, 1e25, 1e160, 1e306])
def test_clusters_of_large_components(spark, scale):
    r = random.Random(4)
    rows = [(i, vector(r, scale if i % 3 else 1.0)) for i in range(60)]
    same_clusters(spark, [(i, [max(-1.7e308, min(1.7e308, x)) for x in v]) for i, v in rows])


def test_intervals_hold_the_distance():
    """Exact values of |c|^2 - 2 x.c lie in their intervals, cancellation included."""
    r = np.random.default_rng(5)
    for scale in (1, 1e3, 1e8, 1e15):
        c = [[int(v) for v in row] for row in r.normal(0, 64 * scale, (16, 64))]
        held_ = centroids.Centroids(c)
        x = np.floor(64 * (np.array(c[:8]) / 64 + r.normal(0, scale * 1e-6, (8, 64)))) / 64
        low, high = held_.intervals(x)
        for i, row in enumerate(x):
            w = centroids.whole(row)
            for j, m in enumerate(c):
                exact = sum(a * a for a in m) - 2 * sum(a * b for a, b in zip(w, m, strict=True))
                assert low[i, j] * 4096 <= exact <= high[i, j] * 4096


def test_overlapping_intervals_are_decided_exactly():
    """Two centroids that float32 can't tell apart: whole numbers find the nearer one, and the smaller number where they tie."""
    base = [1 << 20] * 64
    near, far = list(base), list(base)
    near[0] += 1
    far[1] += 2
    held_ = centroids.Centroids([far, near, near])
    to, unsure = held_.assign(np.array([base]) / 64)
    assert to.tolist() == [1] and unsure == 1
