"""Operators on many rows against brute force, with odd rows."""

import collections
import math
import random
import re
import time
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from parlance.llm import components, jaccard_join, line_dedup, packing, queries, topk, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(None, "no id at all", None, None, None), (10**12, None, None, "s", 1), (10**12 + 1, "", "x", None, None), (10**12 + 2, " \n ", "x", "s", 3), (10**12 + 3, "w " * 20000, "x", "s", 3), (10**12 + 4, "same row", "x", "s", 8), (10**12 + 4, "same row", "x", "s", 8), (10**12 + 5, "same ROW", "x", "s", 8)]


@pytest.fixture(scope="module")
def rows(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(*corpus_pipeline.COLUMNS).collect()]


@pytest.fixture(scope="module")
def odd(spark, rows):
    """Real rows and odd ones, with more columns whose names the operators use inside."""
    df = spark.createDataFrame([(*r, 1, 2, "h", 4) for r in rows[:60] + ODD], DOCS + ", n int, label int, doomed string, part int")
    return df.repartition(3)


def shingles(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_groups(docs):
    sets, root = {i: shingles(t) for i, t in docs.items()}, {i: i for i in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i)) for i in docs}


def made_copies(seed, n=160, base=8, length=(1, 120)):
    """Copies of a few texts with random edits, of similarities around the limit, and texts that share a passage."""
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdef", k=4))
    bases = [[word() for _ in range(r.randint(*length))] for _ in range(base)]
    passage = [word() for _ in range(60)]
    out = {}
    for i in range(n):
        w = list(r.choice(bases))
        for _ in range(r.randint(0, 1 + len(w) // 30)):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.3:
            w = passage + [word() for _ in range(r.randint(0, 16))]
        if r.random() < 0.2:
            w = w[: r.randint(1, len(w))]
        out[i] = " ".join(x.upper() if r.random() < 0.1 else x for x in w) + r.choice(("", "\n"))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard_join(spark, seed):
    docs = made_copies(seed)
    df = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.groups(df).collect()}
    assert got == brute_groups(docs)


def test_jaccard_query(spark, sf_dir, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op6_ngram_jaccard_join(spark, sf_dir).collect()}
    assert got == brute_groups({r[0]: r[1] for r in rows})


def test_jaccard_odd_rows(spark, odd):
    got = jaccard_join.groups(odd).collect()
    assert len(got) == 68
    by = {r.doc_id: r for r in got}
    assert by[None].component_id is None and by[10**12].component_id == 10**12 and by[10**12 + 1].n_shingles == 0
    assert by[10**12 + 5].component_id == 10**12 + 4 and by[10**12 + 3].n_shingles == 1
    assert jaccard_join.groups(odd.limit(0)).count() == 0


def test_jaccard_repeated_ids(spark):
    """Every row has the links of its own text, whatever other texts its id has."""
    r = random.Random(4)
    text = lambda: " ".join("".join(r.choices("abcdefgh", k=5)) for _ in range(60))
    one, two, three = text(), text(), text()
    rows = [(1, one), (1, two), (2, one + " more"), (3, two + " more"), (4, three), (4, three), (4, three.upper()), (0, text()), (None, one)]
    got = jaccard_join.groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert collections.Counter((x.doc_id, x.component_id) for x in got) == collections.Counter({(1, 1): 2, (2, 1): 1, (3, 1): 1, (4, 4): 3, (0, 0): 1, (None, None): 1})


def test_prefixes_lose_no_link():
    """Any global order: similar sets share `need` shingles of their prefixes."""
    r = random.Random(3)
    for _ in range(2000):
        n = r.randint(1, 150)
        a = set(r.sample(range(400), n))
        b = set(a)
        for _ in range(r.randint(0, n // 4)):
            b.discard(r.randrange(400))
            b.add(r.randrange(400))
        if 100 * len(a & b) < 80 * len(a | b):
            continue
        cut = lambda s: set(sorted(s)[: len(s) - (4 * len(s) + 4) // 5 + int(jaccard_join.need(np.array([len(s)]))[0])])
        assert len(cut(a) & cut(b)) >= min(int(jaccard_join.need(np.array([min(len(a), len(b))]))[0]), len(a & b))


def test_components(spark):
    r = random.Random(7)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 1), (7, None)]
    got = {x.node: x.label for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = collections.defaultdict(set)
    for a, b in edges:
        if a is not None and b is not None:
            near[a].add(b)
            near[b].add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        assert got[n] == min(seen)
    assert len(got) == len(near)
    assert components.components(spark.createDataFrame([], "a string, b string")).count() == 0


def brute_doomed(docs, block=line_dedup.BLOCK):
    """Every document against every earlier one: lines of consecutive common lines with `block` words, and wordless lines between deleted ones."""
    lines = {d: [(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate((t or "").split("\n")) if WORD.search(x)] for d, t in docs.items()}
    places = {d: collections.defaultdict(list) for d in docs}
    for d, own in lines.items():
        for j, (_, x) in enumerate(own):
            places[d][x].append(j)
    out = {}
    for d, own in lines.items():
        gone = set()
        for e, other in lines.items():
            if e >= d:
                continue
            for i, (_, x) in enumerate(own):
                for j in places[e].get(x, ()):
                    if i and j and own[i - 1][1] == other[j - 1][1]:
                        continue
                    n = 0
                    while i + n < len(own) and j + n < len(other) and own[i + n][1] == other[j + n][1]:
                        n += 1
                    if sum(len(WORD.findall(y)) for _, y in own[i : i + n]) >= block:
                        gone.update(k for k, _ in own[i : i + n])
        worded = [k for k, _ in own]
        for a, z in zip(worded, worded[1:], strict=False):
            if a in gone and z in gone:
                gone.update(range(a, z))
        out[d] = sorted(gone)
    return out


def check_dedup(docs, got):
    """Deleted lines as the pairwise comparison has them, and every reported block stands where it was found."""
    expected = brute_doomed(docs)
    assert {r.doc_id: [int(x) for x in r.deleted.split(",") if x] for r in got} == expected
    worded = {d: [(i, x.strip(" \t\r\x0b\x0c")) for i, x in enumerate(t.split("\n")) if WORD.search(x)] for d, t in docs.items()}
    for r in got:
        lines = docs[r.doc_id].split("\n")
        assert r.text == "\n".join(x for i, x in enumerate(lines) if i not in set(expected[r.doc_id])) and r.n_lines == len(lines)
        covered = set()
        for block in filter(None, r.found.split(",")):
            first, last, holder, there = map(int, re.fullmatch(r"(\d+)-(\d+)=(-?\d+):(\d+)", block).groups())
            mine = [x for i, x in worded[r.doc_id] if first <= i <= last]
            assert holder < r.doc_id and mine == [x for i, x in worded[holder] if i >= there][: len(mine)]
            covered.update(i for i, _ in worded[r.doc_id] if first <= i <= last)
        assert covered == {i for i, _ in worded[r.doc_id]} & set(expected[r.doc_id])


def sql_dedup(documents):
    con = duckdb.connect()
    con.register("documents", documents)
    return con.sql(line_dedup.ORACLE).fetchall()


def test_line_dedup(spark, sf_dir, rows):
    got = line_dedup.report(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    check_dedup({r[0]: r[1] for r in rows}, got)
    assert sorted(map(tuple, queries.op4_line_dedup(spark, sf_dir).collect())) == sorted(tuple(r)[:-1] for r in got)


def test_line_dedup_made(spark):
    r = random.Random(6)
    passage = [" ".join("".join(r.choices("abcdefg", k=5)) for _ in range(r.randint(1, 14))) for _ in range(40)]
    docs = {}
    for d in range(150):
        lines = []
        for _ in range(r.randint(0, 5)):
            a = r.randrange(40)
            lines += passage[a : a + r.randint(1, 7)] + [f"own {d} {r.random()}"] * r.randint(0, 2)
            if r.random() < 0.4:
                lines.insert(r.randrange(len(lines) + 1), r.choice(("", " ", "x")))
        docs[d] = "\n".join([*lines, "Read more"] if r.random() < 0.7 else lines * r.choice((1, 1, 1, 20)))
    got = line_dedup.report(spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(4)).collect()
    check_dedup(docs, got)
    documents = pa.table({"doc_id": pa.array(docs, pa.int64()), "text": list(docs.values())})
    assert sorted(tuple(r)[:-1] for r in got) == sorted(sql_dedup(documents))
    # every deleted line with a word stays in an earlier document
    kept = collections.defaultdict(lambda: 10**9)
    for row in got:
        for x in row.text.split("\n"):
            kept[x] = min(kept[x], row.doc_id)
    for row in got:
        for i in row.deleted.split(","):
            if i and docs[row.doc_id].split("\n")[int(i)].strip():
                assert kept[docs[row.doc_id].split("\n")[int(i)]] < row.doc_id


def test_line_dedup_three_documents(spark):
    """A block of short lines that 2 and 3 share goes from 3, though 1 has three of its lines apart; rows of one id keep their own lines."""
    block = [f"short line {i}" for i in range(12)]
    docs = [(1, "\n".join(["one", block[3], "two", block[6], "three", block[9]])), (2, "\n".join(["own", *block])), (3, "\n".join([*block, "last of three"]))]
    docs += [(4, "\n".join([*block, "first text of four"])), (4, "a quite different text of the id four with many words\nand a second line of it"), (4, "\n".join([*block, "first text of four"]))]
    got = line_dedup.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, docs[0][1]), (2, docs[1][1]), (3, "last of three"), (4, docs[4][1]), (4, "first text of four"), (4, "first text of four")]
    assert {r.found for r in got if r.doc_id == 3} == {"0-11=2:1"}


def test_line_dedup_short_lines_of_many(spark):
    """A passage of short lines goes from every later document, whether 64 or 65 have it; a short line alone stays."""
    verse = "\n".join(f"verse {i} of six short words" for i in range(12))
    for n in (64, 65, 90):
        docs = [(d, f"{verse}\nown line {d}\nown too {d}\nRead more") for d in range(n)]
        got = {r.doc_id: r.text for r in line_dedup.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
        assert got == {d: t if d == 0 else f"own line {d}\nown too {d}\nRead more" for d, t in docs}


def test_line_dedup_overlaps_without_the_holder(spark):
    """Blocks that two documents share go from the later one, whichever earlier documents have their single lines."""
    words = [f"sorted line number {i}" for i in range(12)]
    long = [f"a line that is long enough to be a block number {i}" for i in range(6)]
    docs = {
        # 1 has the lines in reverse order; 2 and 3 in one order, with wordless lines in other places
        1: [x for w in (words, long) for x in reversed(w)],
        2: ["own 2", *words, "own too 2", *long],
        3: ["own 3", "and 3", *words, "own too 3", "and 3", *long],
        # the block of 13 occurred line by line before
        10: ["first short one", "x 10", "y 10"],
        11: ["second short one", "x 11", "y 11"],
        12: ["x 12", "y 12", "first short one", "second short one", "", "third short one"],
        13: ["first short one", "second short one", "", "third short one", "x 13", "y 13", "third short one"],
    }
    made = spark.createDataFrame([(d, "\n".join(x)) for d, x in docs.items()], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.report(made).collect()}
    assert {d: got[d] for d in (1, 10, 11, 12)} == {d: docs[d] for d in (1, 10, 11, 12)}
    assert got[3] == ["own 3", "and 3", "own too 3", "and 3"]
    assert got[13] == ["x 13", "y 13", "third short one"]


def test_line_dedup_odd_rows(odd):
    got = line_dedup.dedup(odd).collect()
    assert len(got) == 68 and all(r.text is None for r in got if r.doc_id == 10**12)
    assert line_dedup.dedup(odd.limit(0)).count() == 0
    assert line_dedup.report(odd).where("doc_id IS NULL").first().text == "no id at all"


def test_patience_pairs_are_common_and_ascending():
    r = random.Random(8)
    for _ in range(300):
        a, b = ([(i, r.randrange(9)) for i in range(r.randint(0, 20))] for _ in range(2))
        pairs = line_dedup.patience(a, b)
        assert all(dict(a)[i] == dict(b)[j] for i, j in pairs)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:], strict=False))


def test_alignment_alone_deletes(monkeypatch):
    """What no alignment reaches stays: without patience diff nothing goes."""
    shared = [([0 << 32, 9 << 32 | 9], [3 << 32 | 3]), ([1 << 32 | 1], [4 << 32 | 4])]
    assert line_dedup.aligned(shared) == [(0, 1, 3), (9, 9, 3)]
    monkeypatch.setattr(line_dedup, "patience", lambda a, b: [])
    assert line_dedup.aligned(shared) == []


def test_alignments_leave_nothing():
    """Moved, repeated and reversed runs: every place whose run is there gets a place of the same run."""
    r = random.Random(9)
    for n in range(400):
        kinds = r.choice((2, 5, 40))
        b = [(i, r.randrange(kinds)) for i in range(r.randint(1, 40))]
        have = {h for _, h in b}
        a = [(i, h) for i, h in ((i, r.randrange(kinds)) for i in range(r.randint(0, 60))) if h in have]
        if n % 5 == 0:
            b = list(enumerate(dict.fromkeys(h for _, h in b)))
            a = [(i, h) for i, (_, h) in enumerate(reversed(b))]
        got = line_dedup.alignments(a, b)
        assert set(got) == {i for i, _ in a} and all(dict(a)[i] == dict(b)[j] for i, j in got.items())
        assert a == [] or line_dedup.patience(a, b)


@pytest.mark.parametrize("kind", ["reversed", "one line", "two lines", "shuffled"])
def test_alignments_of_long_documents(kind):
    """Thousands of lines in any order take time in proportion, as far as a factor of the passes."""
    n = 20_000
    b = list(enumerate({"one line": [0] * n, "two lines": [0, 1] * (n // 2)}.get(kind, range(n))))
    runs = [h for _, h in b]
    if kind == "reversed":
        runs.reverse()
    elif kind == "shuffled":
        random.Random(1).shuffle(runs)
    began = time.time()
    assert len(line_dedup.alignments(list(enumerate(runs))[1:] + [(n, runs[0])], b)) == n
    assert time.time() - began < 20


def test_line_dedup_repeated_and_long(spark):
    """A block that the earlier document has once and the later one a thousand times, and the other way round; 5,000 varied lines, moved."""
    r = random.Random(10)
    line = lambda: " ".join("".join(r.choices("abcdefg", k=4)) for _ in range(9))
    block, many = [line() for _ in range(3)], [line() for _ in range(5000)]
    docs = {1: [*block, "own 1"], 2: ["own 2", *block * 1000], 3: [*many, "own 3"], 4: ["own 4", *many[3000:], *many[:3000]], 5: [*reversed(many[:500]), "own 5"]}
    got = {x.doc_id: x for x in line_dedup.report(spark.createDataFrame([(d, "\n".join(x)) for d, x in docs.items()], "doc_id long, text string").repartition(3)).collect()}
    assert {d: x.text for d, x in got.items()} == {1: "\n".join(docs[1]), 2: "own 2", 3: "\n".join(docs[3]), 4: "own 4", 5: "own 5"}
    for x in got.values():
        for b in filter(None, x.found.split(",")):
            first, last, holder, there = map(int, re.split("[-=:]", b))
            assert docs[x.doc_id][first : last + 1] == docs[holder][there : there + last - first + 1]


def test_packing(spark, sf_dir, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = queries.op5_packing(spark, sf_dir).toPandas()
    docs = {r[0]: r[1] for r in rows}
    for d, pieces in got.groupby("doc_id"):
        ids, at = [*lib.encode(docs[d], add_special_tokens=False).ids, 2], 0
        for p in pieces.sort_values("start").itertuples():
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    assert got.doc_id.nunique() == len(docs)
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.offset == placed.groupby("sequence_id").length.cumsum() - placed.length).all()
    used = placed.groupby("sequence_id").length.sum()
    assert used.max() <= packing.SIZE and 1 - used.sum() / (len(used) * packing.SIZE) < 0.03


def test_word_tokens(texts=None):
    r = random.Random(4)
    path = public_tokenizers.path("word_bpe_49k.json")
    lib, own = Tokenizer.from_file(path), packing.WordTokens(path)
    every = ["".join(r.choices("aB éÉß.,'s1 ①½ǅİΣς\n\tа中́  <|endoftext|>-_", k=r.randint(0, 30))) for _ in range(3000)] + ["a<|endoftext|>b", "ÀÖ÷×ßÿ.", "", "don't", "x" * 5000]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch([t.encode() for t in every])] == [e.ids for e in lib.encode_batch(every, add_special_tokens=False)]


def test_packing_odd_rows(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(odd, path).toPandas()
    assert got[got.doc_id == 10**12].doc_tokens.tolist() == [1] and got.doc_id.isna().sum() == 1
    assert len(got[got.doc_id == 10**12 + 4]) == 2 and not got.duplicated(["sequence_id", "offset"]).any()
    assert packing.pack(odd.limit(0), path).count() == 0


def test_packing_short_texts(spark):
    """Tables of short texts alone pack as densely as others."""
    r = random.Random(5)
    docs = [(i, " ".join(r.choices(("one", "two", "words"), k=r.choice((0, 1, 16, 100))))) for i in range(6000)]
    got = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(2), public_tokenizers.path("word_bpe_49k.json")).toPandas()
    assert sorted(got.doc_id) == [i for i, _ in docs] and (got.start == 0).all() and (got.length == got.doc_tokens).all()
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.offset == placed.groupby("sequence_id").length.cumsum() - placed.length).all()
    used = placed.groupby("sequence_id").length.sum()
    assert used.max() <= packing.SIZE and 1 - used.sum() / (len(used) * packing.SIZE) < 0.05


def test_column_generation():
    r = random.Random(2)
    for _ in range(5):
        demand = {r.randint(1, 256): r.randint(1, 3000) for _ in range(r.randint(1, 40))}
        plan = packing.plan(demand, 256)
        held = collections.Counter()
        for pattern, n in plan:
            assert sum(k * a for k, a in pattern.items()) <= 256
            held.update({k: a * n for k, a in pattern.items()})
        assert all(held[k] >= n for k, n in demand.items())
        used = sum(n for _, n in plan)
        assert used >= sum(k * n for k, n in demand.items()) / 256
        table = packing.slots(plan, 0)
        for k, n in demand.items():
            first, a, base = table[k]
            p = np.searchsorted(first, np.arange(n), "right") - 1
            seats = collections.Counter((base[p] + (np.arange(n) - first[p]) // a[p]).tolist())
            assert max(seats.values()) <= max(x.get(k, 0) for x, _ in plan)
    # a known optimum: 3 of 100 and 3 of 156 fit three sequences, 256 units each
    assert sum(n for _, n in packing.plan({100: 3, 156: 3}, 256)) == 3
    value, taken = packing.knapsack(np.array([6.0, 10.0, 12.0]), np.array([1, 2, 3]), 5)
    assert value == 30.0 and taken[0].tolist() == [5, 0, 0]


def test_knapsack_against_a_plain_table():
    r = random.Random(3)
    for _ in range(60):
        m, capacity = r.randint(1, 7), r.randint(1, 60)
        size = np.array(r.sample(range(1, 61), m))
        size = np.sort(size[size <= capacity]) if (size <= capacity).any() else np.array([1])
        value = np.array([r.choice((0.0, r.random())) for _ in size])
        best = [0.0] * (capacity + 1)
        for c in range(1, capacity + 1):
            best[c] = max([best[c - 1], *(best[c - s] + v for s, v in zip(size.tolist(), value.tolist(), strict=True) if s <= c)])
        total, found = packing.knapsack(value, size, capacity, 5)
        assert abs(total - best[capacity]) < 1e-9 and abs(found[0] @ value - total) < 1e-9
        assert len(found) <= 5 and all((p >= 0).all() and p @ size <= capacity for p in found)


def test_classes():
    """Lengths up to 64 are their own class; others are rounded up by less than a thirty-second part; a few hundred classes in all."""
    classes = [packing.class_of(n) for n in range(1, packing.SIZE + 1)]
    assert classes[:64] == list(range(1, 65)) and classes[-1] == packing.SIZE and classes == sorted(classes)
    assert all(n <= c < n * 33 / 32 for n, c in enumerate(classes, 1)) and len(set(classes)) < 450
    assert all(packing.class_of(c) == c for c in set(classes))


@pytest.mark.parametrize("kind", ["even", "short", "halves"])
def test_plans_near_the_bound(kind):
    """No plan of the classes needs fewer sequences than their tokens fill; column generation comes within one in a hundred, or the known best."""
    r = random.Random(7)
    lengths = [r.randint(1, 4095) if kind == "even" else int(r.paretovariate(1.2) * 3) % 300 + 1 if kind == "short" else r.choice((2049, 1366)) for _ in range(60_000)]
    demand = collections.Counter(map(packing.class_of, lengths))
    plan = packing.plan(demand)
    used = sum(n for _, n in plan)
    need = sum(k * n for k, n in demand.items()) / packing.SIZE
    if kind == "halves":
        # two of the longer class don't fit, three of the shorter do not either: one of each, then two
        a, b = (packing.class_of(x) for x in (2049, 1366))
        assert used <= demand[a] + max(0, demand[b] - demand[a]) / (packing.SIZE // b) + 1
    else:
        assert used <= need * 1.01 + 1


def test_top_k(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    assert sorted(map(tuple, queries.op10_exact_topk(spark, sf_dir).collect())) == sorted(con.sql(topk.ORACLE).fetchall())


def brute_top(rows, k=5):
    """(id, vector) rows: the documented result, in Python's integers."""
    good = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    asked = {}
    for i, v in good:
        if i % 50 == 0:
            asked[i] = min(v, asked.get(i, v))
    out = []
    for q, x in asked.items():
        score = lambda y: max(-(2**63), min(2**63 - 1, sum(map(int.__mul__, x, y))))  # noqa: E731, B023
        best = sorted((-score(y), i) for i, y in good if i != q)[:k]
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize(("chunk", "size"), [(1 << 14, 64 << 20), (3, 64 << 20), (1 << 14, 100)])
def test_top_k_odd_rows(spark, chunk, size, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", chunk)
    monkeypatch.setattr(topk, "CHUNK_BYTES", size)
    monkeypatch.setattr(topk, "SEED", 8)
    r = np.random.default_rng(3)
    rows = [(i, (r.normal(size=r.integers(1, 6)) * r.choice([0.01, 1, 30])).tolist()) for i in range(400)]
    rows += [(1000 + i, [1.0, 2.0]) for i in range(60)] + [(2000, None), (2050, [1.0, None]), (2100, [float("nan")]), (2150, [float("inf")]), (None, [1.0]), (2200, []), (2250, [0.0])]
    # repeated rows, and one id with two vectors
    rows += [rows[50], rows[50], rows[7], (100, [3.0, -1.0]), (8, [2.0])]
    df = spark.createDataFrame([(*x, 1.0) for x in rows], "vec_id long, embedding array<double>, score double")
    assert sorted(map(tuple, topk.top_k(df).collect())) == sorted(brute_top(rows))
    assert topk.top_k(df.limit(0)).count() == 0
    assert sorted(map(tuple, topk.top_k(df.where("vec_id IN (150, 200, 7)")).select("query_id", "rank").collect())) == [(150, 1), (150, 2), (150, 3), (200, 1), (200, 2), (200, 3)]


def test_top_k_large_components(spark, monkeypatch):
    """No magnitude leaves a vector out, and no sum loses a digit."""
    monkeypatch.setattr(topk, "SEED", 4)
    r = np.random.default_rng(5)
    rows = [(50, [1.0, 0.0]), (1, [70000.0, 0.0]), (2, [2.0, 0.0])]
    for i in range(200):
        scale = float(r.choice([1, 1e4, 1e6, 1e7, 1e9, 1e15, 1e300]))
        rows.append((100 + i, (r.normal(size=40) * scale).round(3).tolist()))
    rows += [(350 + i, [1e308, -1e308, float(i), 5e-324]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted(map(tuple, topk.top_k(df).collect()))
    assert got == sorted(brute_top(rows))
    little = [x for x in rows if x[0] in (50, 1, 2)]
    assert [tuple(x) for x in topk.top_k(spark.createDataFrame(little, "vec_id long, embedding array<float>")).collect()] == [(50, 1, 1, 256 * 70000 * 256), (50, 2, 2, 256 * 512)]


def test_url_filter(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{sf_dir}/pages.parquet')")
    ours = sorted(map(tuple, queries.op2_url_filter(spark, sf_dir).collect()))
    assert ours == sorted(con.sql(url_filter.ORACLE).fetchall())


def test_url_aliases(spark):
    link, refresh = '<link rel="canonical" href="{}">', '<meta http-equiv="refresh" content="0; url={}">'
    rows = [
        (1, "https://a.example.com/x", link.format("https://b.net/y")),  # blocked through its canonical page
        (2, "https://b.net/y", None),
        (3, "https://c.example.org/", refresh.format("https://a.example.com/x#top")),  # two steps away
        (4, "HTTPS://D.example.com/en/", link.format("https://d.example.org/fr/z")),  # an alias is allowed, one blocked
        (5, "https://e.net/q", link.format("https://d.example.com/en/")),
        (6, "https://d.example.com/en/#part", "<!-- " + link.format("https://f.net/") + " -->"),
        (7, "https://f.example.com/de/k", None),
        (8, "https://www.example.net/en/k?q", None),
        (9, "https://net.example.com/", "<script>'" + link.format("https://f.net/") + "'</script>"),
        (10, None, link.format("https://f.net/")),
        (11, "no scheme net/", ""),
        (12, "https://g.example.com/a/b?x=1&y=2", "<LINK HREF='/c?x=1&amp;y=2' REL='canonical'>"),
        (13, "https://g.example.com/c?x=1&y=2", None),
        (14, "https://X.NET", None),
        (14, "https://X.NET", None),
        (None, "ftp://y.fr.org/fr/://net/", None),
    ]
    df = spark.createDataFrame([(*r, "z", "z") for r in rows], "page_id long, url string, html string, verdict string, node string")
    got = {r.page_id: r for r in url_filter.judge(df).collect()}
    assert url_filter.judge(df).count() == len(rows)
    verdicts = {k: r.verdict for k, r in got.items()}
    assert [verdicts[i] for i in range(1, 15)] == ["block", "block", "block", "allow", "block", "allow", "block", "allow", "allow", "allow", "allow", "allow", "allow", "allow"]
    assert got[8].rule == "example.net/en/" and got[7].rule == "example.com/de/" and got[10].host == "" == got[11].path
    assert got[1].alias_of == got[3].alias_of and got[12].alias_of == got[13].alias_of is not None and got[14].host == "x.net" and got[14].rule is None
    assert (got[None].host, got[None].path, got[None].verdict) == ("y.fr.org", "/fr/://net/", "allow")
    more = spark.createDataFrame([("https://www.example.net/en/k?q", "https://net.example.com/"), ("https://net.example.com/", "https://h.net/")], "a string, b string")
    assert {r.page_id: r.verdict for r in url_filter.judge(df, edges=more).collect()}[9] == "allow"
    assert url_filter.judge(df.limit(0)).count() == 0
    assert "Python" not in url_filter.judge(df)._jdf.queryExecution().executedPlan().toString()


def test_url_relative_links(spark):
    link = '<link rel="canonical" href="{}">'
    to = {"?id=7": "https://h.org/a/b?id=7", "?u=x://y": "https://h.org/a/b?u=x://y", "./c": "https://h.org/a/c", "../c?q=/../": "https://h.org/c?q=/../", "../../../c": "https://h.org/c", "/x/./y/../z": "https://h.org/x/z", "..": "https://h.org/", ".": "https://h.org/a/", "/x/..y/.z": "https://h.org/x/..y/.z", "https://I.org/p/../q#f": "https://i.org/q"}
    pages = [(k, "https://h.org/a/b?old=1#top", link.format(t)) for k, t in enumerate(to)]
    for page, there in zip(pages, to.values(), strict=True):
        found = url_filter.links(spark.createDataFrame([page], "page_id long, url string, html string")).collect()
        assert [tuple(r) for r in found] == [("https://h.org/a/b?old=1", there)], page
    made = [(1, "https://h.org/a/b", link.format("?id=7")), (2, "https://h.org/a/b?id=7", link.format("https://b.net/")), (3, "https://h.org/x/y", link.format("../a/b"))]
    got = url_filter.judge(spark.createDataFrame(made, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.verdict for r in got} == {1: "block", 2: "block", 3: "block"}


def test_pipeline(spark, sf_dir, tmp_path, rows):
    labels = f"{tmp_path}/labels.parquet"
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(labels)
    docs = spark.createDataFrame(rows + ODD, DOCS)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS), name
            empty = stage(spark, docs.limit(0), str(tmp_path))
            assert empty.count() == 0
    kept = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert docs.select("doc_id").distinct().count() == len(kept)
    near = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/1").where("doc_id IS NOT NULL").collect()}
    groups = brute_groups(near)
    assert {i for i in kept if i is not None} == {i for i, (_, c) in groups.items() if i == c}
    from parlance.llm import pii

    assert not any(pii.find(t)[k] for t in kept.values() for k in pii.BASE)


def test_near_duplicates_without_ids(spark, sf_dir):
    """Rows without an id stay unless a copy does, and one of equal rows of one id."""
    long = " ".join(f"word{i}" for i in range(60))
    rows = [(None, "clean and without an id of its own"), (None, "another clean row without an id"), (None, f"{long} more"), (None, "twice the same row without id"), (None, "twice the same row without id")]
    rows += [(7, long), (9, long + " end"), (5, "the same row of one id twice"), (5, "the same row of one id twice"), (6, "two texts of one id, this"), (6, "and this, quite another one"), (8, ""), (8, ""), (4, ""), (None, ""), (-3, "negative id of a row")]
    docs = spark.createDataFrame([(i, t, "x", "s", len(t)) for i, t in rows], DOCS).repartition(4)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()]
    expected = {r for r in rows if r not in {(None, f"{long} more"), (9, long + " end")}}
    assert collections.Counter(got) == collections.Counter(expected)


def test_run(spark, sf_dir, rows):
    """Rows of the whole pipeline, from the stages in plain form: verdicts, the SQL of line dedup, all pairs, masked texts, the tokenizer itself."""
    from parlance.llm import pii

    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    good = {r.doc_id for r in queries.op8_quality_classifier(spark, sf_dir).collect() if r.predicted}
    docs = {r[0]: r[1] for r in rows if r[0] in good}
    assert 0 < len(docs) < len(rows)
    reduced = {r[0]: r[4] for r in sql_dedup(pa.table({"doc_id": pa.array(docs, pa.int64()), "text": list(docs.values())})) if not r[2] or WORD.search(r[4])}
    assert any(reduced.get(i) != t for i, t in docs.items())
    groups = brute_groups(reduced)
    final = {i: pii.mask(reduced[i]) for i, (n, c) in groups.items() if i == c}
    assert len(final) < len(reduced) and any(final[i] != reduced[i] for i in final)
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for i, t in final.items():
        ids = [*lib.encode(t, add_special_tokens=False).ids, 2]
        expected += [(i, at, len(part := ids[at : at + packing.SIZE]), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)) for at in range(0, len(ids), packing.SIZE)]
    pieces = got.collect()
    assert sorted(tuple(r)[:5] for r in pieces) == sorted(expected)
    ends = collections.defaultdict(int)
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= packing.SIZE


#: What opens something that never ends, and pages of nothing else.
OPENERS = ("<!--", "<script", "<link ", "<meta ", '<link rel="', "<script></script", "<!-- --><", "<link rel=canonical href='", "<", "</script ")


def test_links_of_long_pages(spark):
    """Time in proportion to the page: pages of things that don't end, with a link before them."""
    link = '<link rel="canonical" href="http://b.org/x">'
    seconds = {}
    for size in (250_000, 1_000_000):
        rows = [(i, f"http://a{i}.org/", link + o * (size // len(o))) for i, o in enumerate(OPENERS)]
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1).cache()
        df.count()
        assert url_filter.links(df).count() == len(OPENERS)
        began = time.time()
        got = {r.a for r in url_filter.links(df).collect()}
        seconds[size] = time.time() - began
        assert got == {f"http://a{i}.org/" for i in range(len(OPENERS))}
    assert seconds[1_000_000] < 5 * seconds[250_000] + 2 and seconds[1_000_000] < 10


def test_links_in_comments_and_scripts(spark):
    to = lambda n: f'<link rel="canonical" href="http://to{n}.org/">'
    html = ["<!-- a -->" + to(0), f"<!-- {to(1)} -->", f"<!-- {to(2)}", f"<SCRIPT x>{to(3)}</Script\n>", f"<script>{to(4)}", f"<script>'<!--'</script>{to(5)}", f"<scripts>{to(6)}", to(7)[:-1], f"<!--{to(8)}--{to(8)}", "<link\nREL = canonical\nHREF = http://to9.org/ >", "<!-- <script> -->" + to(10)]
    df = spark.createDataFrame([(i, f"http://from{i}.org/", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {(r.a, r.b) for r in url_filter.links(df).collect()}
    assert got == {(f"http://from{i}.org/", f"http://to{i}.org/") for i in (0, 5, 6, 9, 10)}
