"""Fingerprints, decontamination, the Jaccard join and sentence spans against brute-force versions."""

import collections
import glob
import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lexloom.llm import decontam, jaccard, queries, simhash, spans, words
from lexloom.plans import shared

SF = "/root/testdata/sf0.001"


def documents(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("doc_id", "text", "1 as id", "'x' as n", "2 as tokens")


def copies(seed, groups=6, size=12, words=60):
    """Groups around an original: light, heavy and no edits, shared passages, short and empty texts."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    passage = [rng.choice(vocab) for _ in range(25)]
    texts, i = {}, 0
    for _ in range(groups):
        base = [rng.choice(vocab) for _ in range(words)] + (passage if rng.random() < 0.5 else [])
        for k in range(size):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 8])):
                own[rng.randrange(len(own))] = rng.choice(vocab)
            texts[i * 7 % 997] = " ".join(own)
            i += 1
    return texts | {1000: "", 1001: None, 1002: "one two", 1003: "One  two", 1004: "x", 1005: " \n\t", 1006: "a b c d", 1007: "a b c d"}


def brute_components(texts, k=4, num=85, den=100):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("seed", "rule"), [(0, (4, 85, 100)), (1, (4, 85, 100)), (2, (5, 80, 100))])
def test_jaccard_components(spark, seed, rule, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_SHINGLES", 300)  # salted verification groups
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 2)
    monkeypatch.setattr(jaccard, "HOT_SETS", (100, 4, 2)[seed])
    texts = copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(documents(spark, texts), "doc_id", "text", *rule).collect()}
    assert got == brute_components(texts, *rule)


def test_jaccard_of_repeated_rows(spark):
    df = documents(spark, {5: "a b c d e f g h i j k l m n o p q r s t u v w x y z", 9: "A b c d e f g h i j k l m n o p q r s t u v w x y z", 7: "one", 8: None})
    rows = jaccard.jaccard_components(df.union(df).union(documents(spark, {7: "x"}).selectExpr("cast(null as long) as doc_id", "text", "id", "n", "tokens"))).collect()
    assert sorted(map(tuple, rows)) == sorted([(5, 23, 5), (9, 23, 5), (7, 1, 7), (8, 0, 8)] * 2)
    assert jaccard.jaccard_components(df.limit(0)).count() == 0


def test_signatures_lose_no_pair():
    rng = np.random.default_rng(4)
    classes = jaccard.Classes(85, 100)
    for _ in range(400):
        n = int(rng.integers(1, 120))
        base = rng.integers(0, 1 << 62, n + 60).astype(np.uint64)
        cut, more = int(rng.integers(0, n // 8 + 1)), int(rng.integers(0, n // 8 + 1))
        a, b = set(base[:n].tolist()), set(base[cut : n + more].tolist())
        if 100 * len(a & b) >= 85 * len(a | b):
            x, y = (jaccard.signatures(np.array(sorted(s), np.uint64), classes) for s in (a, b))
            assert set(x.tolist()) & set(y.tolist())


def test_trie_traversal():
    rng = random.Random(2)
    x = sorted(rng.sample(range(1000), 100))
    rows = []
    for i in range(40):
        y = sorted(set(x) - set(rng.sample(x, rng.randrange(30))) | set(rng.sample(range(1000, 1100), rng.randrange(12))))
        rows.append((i, len(y), np.array(y, np.int64)))
    want = [i for i, n, y in rows if 100 * len(set(x) & set(y.tolist())) >= 85 * len(set(x) | set(y.tolist()))]
    assert sorted(jaccard.traverse(np.array(x, np.int64), len(x), rows)) == want and want


def test_fingerprints(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r.doc_id: r for r in queries.op1_simhash(spark, SF).collect()}
    ids = sorted(texts, reverse=True)
    assert rows.keys() == texts.keys()
    value = {i: int(r.fingerprint, 16) for i, r in rows.items()}
    seen = {}
    for k, i in enumerate(ids):
        following, t = ids[(k + 1) % len(ids)], texts[i]
        half = len(t) // 2
        edited = t[: len(t) - half] + texts[following][:half]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and rows[i].n_chars == len(t)
        assert rows[i].near_next == 1 - (value[i] ^ value[following]).bit_count() / 64
        assert seen.setdefault(t, rows[i].fingerprint) == rows[i].fingerprint
        near = sum((value[i] ^ v).bit_count() <= 3 for v in value.values()) - 1
        assert rows[i].n_near == (near if i % 50 == 0 else None)
    edited_, next_ = (np.array([getattr(r, c) for r in rows.values()]) for c in ("near_edited", "near_next"))
    assert edited_.mean() > next_.mean() + 0.1


def test_votes_equal_brute_force(spark):
    rng = random.Random(14)
    texts = {i: " ".join(rng.choice(["A", "bb", "Ccc", "word" * 9, "é", "😀x", "tail\n"]) + rng.choice(["", str(rng.randrange(9))]) for _ in range(rng.randrange(1, 80))) for i in range(60)}
    texts |= {100: "", 101: "   ", 102: "same " * 5000}
    for r in simhash.fingerprint_report(documents(spark, texts)).collect():
        votes, total = [0] * 64, 0
        for term in re.split("[ \\t\\n\\x0b\\f\\r]+", texts[r.doc_id].lower()):
            weight, value = min(len(term), 16) ** 2, xxhash.xxh64_intdigest(term.encode(), 42)
            total += weight
            votes = [v + weight * (value >> k & 1) for k, v in enumerate(votes)]
        assert int(r.fingerprint, 16) == sum(1 << k for k, v in enumerate(votes) if 2 * v > total)


def test_fingerprint_edges(spark):
    df = documents(spark, {5: None, 10_000: "a b", 3: "", 2**40: "a b", -7: "😀"})
    rows = {r.doc_id: r for r in simhash.fingerprint_report(df).collect()}
    assert len(rows) == 5 and rows[10_000].fingerprint == rows[2**40].fingerprint and rows[5].fingerprint == "0" * 16
    assert rows[-7].edited_sha256 == hashlib.sha256("😀".encode()).hexdigest()
    assert simhash.fingerprint_report(df.limit(0)).count() == 0
    assert simhash.fingerprint_report(df.where("doc_id = 3")).first().near_next == 1.0


def test_equal_texts_have_equal_fingerprints_whatever_their_ids(spark):
    base = documents(spark, {1: "a b c dd eee", 2: "x y z"})
    more = documents(spark, {1: "quite other words here", 3: "a b c dd eee"})
    rows = simhash.fingerprint_report(base.union(more).union(base).union(base)).collect()
    assert len(rows) == 8 and sorted(r.doc_id for r in rows) == [1, 1, 1, 1, 2, 2, 2, 3]
    value = {r.doc_id: r.fingerprint for r in rows if r.doc_id != 1}
    assert sum(r.fingerprint == value[3] for r in rows) == 4 and len({r.fingerprint for r in rows}) == 3


def test_next_lower_over_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ORDERED", 5)
    keys = sorted(random.Random(3).sample(range(-(10**7), 10**7), 60))
    got = dict(map(tuple, simhash.next_lower(spark.createDataFrame([(k,) for k in keys], "key long")).collect()))
    assert got == dict(zip(keys, [None, *keys]))


def test_radius_search_is_exact(spark):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(20)]
    values = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(6))) for b in base for _ in range(10)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {(r.query, r.fp) for r in simhash.within_radius(df, df).collect()}
    bits = lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count()
    assert got == {(a, b) for a in signed for b in signed if a != b and bits(a, b) <= 3}


@pytest.fixture(scope="module")
def db():
    found = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        found.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return found


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_sql(spark, db, name):
    df = queries.queries()[name](spark, SF)
    result = db.sql(queries.oracle_sql()[name])
    at = [result.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[k] for k in at) for r in result.fetchall())


def test_leaks(spark):
    item = " ".join(f"b{k}" for k in range(30))
    near = " ".join("zz" if k == 10 else f"b{k}" for k in range(30))
    far = " ".join("zz" if k in (5, 15, 25) else f"b{k}" for k in range(30))
    docs = documents(spark, {1: "start " + item.upper() + "! end", 2: near, 3: far, 4: None, 5: "", 6: "x tiny item y", 7: "tiny, ITEM"})
    bench = spark.createDataFrame([(1, item), (2, "tiny item"), (3, None), (4, "..."), (1, item)], "item_id long, text string").selectExpr("*", "1 as size")
    got = sorted((r.doc_id, r.item_id, r.n_shared, r.n_item) for r in decontam.find_leaks(docs, bench).collect())
    assert got == [(1, 1, 26, 26), (2, 1, 21, 26), (6, 2, 1, 1), (7, 2, 1, 1)]
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0 == decontam.find_leaks(docs.limit(0), bench).count()


def test_only_candidates_are_verified(spark):
    """Sketches choose the candidates: all documents that hold enough of an item, few that share some of it, none without."""
    rng = random.Random(15)
    items = {i: [f"v{rng.randrange(50)}" for _ in range(rng.choice([6, 12, 40, 90]))] for i in range(25)}
    cut = lambda w, k=5: {" ".join(w[a : a + k]) for a in range(len(w) - k + 1)}
    texts = {}
    for i in range(300):
        own = list(items[rng.randrange(25)])
        for _ in range(rng.randrange(8)):
            own[rng.randrange(len(own))] = f"x{rng.random()}"
        texts[i] = " ".join([*(f"v{rng.randrange(50)}" for _ in range(rng.randrange(40))), *own[: rng.randrange(1, len(own) + 1) if i % 3 == 0 else None]]).replace(".", "")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    parts, held = {i: cut(w) for i, w in items.items()}, {i: cut(t.split()) for i, t in texts.items()}
    want = {(d, i) for d, h in held.items() for i, p in parts.items() if len(h & p) >= -(-8 * len(p) // 10)}
    some = {(d, i) for d, h in held.items() for i, p in parts.items() if h & p}
    docs = documents(spark, texts)
    base, shingles = docs.selectExpr("doc_id as id", "split(text, ' ') as words"), decontam.item_shingles(bench)
    met = {tuple(r) for r in decontam.candidates(base, shingles, 5).collect()}
    assert want <= met < some and len(met) < len(some) - 20
    assert {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs, bench).collect()} == want and want
    # without the sketch of an item nothing finds it
    none = shingles.withColumn("sketch", F.col("sketch") & (F.col("item_id") != 3))
    assert {p for p in met if p[1] != 3} == {tuple(r) for r in decontam.candidates(base, none, 5).collect()} != met


def brute_repeats(texts, least=20, long=50):
    """Text and number of removed sentences by the rule, sentence by sentence."""
    cut = re.compile(r"""(?s).*?(?:[.!?]+["')\]]*[ \t\n\r\f]+|[。！？]+[ \t\n\r\f]*|\n[ \t\n\r\f]*)|.+""")
    parts = {i: cut.findall(t or "") for i, t in texts.items()}
    first, gone = {}, collections.defaultdict(set)
    for i in sorted(parts):
        plain = [" ".join(re.split(r"[ \t\n\r\f]+", s.lower().strip(" \t\n\r\f"))) for s in parts[i]]
        size = [max(len(s.split(" ")), len(s) // 8) if s else 0 for s in plain]
        for a in range(len(plain)):
            for b in range(a, len(plain)):
                if sum(size[a : b + 1]) >= (least if b > a else long):
                    if first.setdefault(tuple(plain[a : b + 1]), (i, a)) != (i, a):
                        gone[i] |= {*range(a, b + 1)}
                    break
    return {i: ("".join(s for k, s in enumerate(p) if k not in gone[i]), len(p), len(gone[i])) for i, p in parts.items()}


def test_spans(spark):
    run = "One two three four five six seven. Eight nine ten eleven twelve thirteen fourteen! Fifteen sixteen seventeen eighteen nineteen twenty? "
    short = "Ten words are too few for a run. By themselves. "
    single = " ".join(f"w{k}" for k in range(50)) + ". "
    texts = {1: "Own words here. " + run + "Tail of one.", 2: "Other words.\n" + run + "Tail of two.", 3: run + run, 4: None, 5: "", 6: "No. No. No. No.", 7: "A. " + short, 8: "B. " + short, 9: single + "X.", 10: "Y. " + single}
    texts |= {11: "版" * 90 + "。" + "本" * 80 + "。", 12: "x。" + "版" * 90 + "。" + "本" * 80 + "。", 13: "See 3.14 at a.b.co/x.y now"}
    got = {r.doc_id: r for r in spans.drop_repeats(documents(spark, texts)).collect()}
    assert got[1].text == texts[1] and got[2].text == "Other words.\nTail of two." and got[3].text == ""
    assert got[4].text == got[5].text == "" and all(got[i].text == texts[i] for i in (6, 7, 8, 9, 11, 13))
    assert got[2].n_removed == 3 and got[2].n_sentences == 5 and got[13].n_sentences == 1
    assert got[10].text == "Y. " and got[12].text == "x。"
    assert spans.drop_repeats(documents(spark, texts).limit(0)).count() == 0


def test_spans_equal_brute_force(spark):
    rng = random.Random(12)
    ends = [". ", "! ", "?\n", ".", "\n\n", '." ', "... ", "。", ", "]
    pool = [" ".join(f"P{rng.randrange(9)}" for _ in range(rng.choice([1, 2, 5, 9, 14, 22, 55]))) + rng.choice(ends) for _ in range(40)]
    texts = {}
    for i in range(80):
        at = rng.randrange(30)
        texts[i] = "".join([*rng.sample(pool, 2), *pool[at : at + rng.randrange(1, 9)], f"u{rng.random()} . ", *rng.sample(pool, 2)])
    texts |= {90: "\n a. b", 91: "  ", 92: "." * 50, 93: "a. " * 3000, 94: None}
    got = {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in spans.drop_repeats(documents(spark, texts)).collect()}
    assert got == brute_repeats(texts)
    twice = documents(spark, {1: texts[93]}).union(documents(spark, {1: texts[93]}))
    assert len({tuple(r) for r in spans.drop_repeats(twice).collect()}) == 1


def test_repeated_runs_store_no_tables(spark):
    """Nothing is written to the shared folder, and repeats are found across partitions as within them."""
    rng = random.Random(21)
    pool = [" ".join(f"q{rng.randrange(30)}" for _ in range(rng.choice([3, 12, 25]))) + ". " for _ in range(25)]
    texts = {i: "".join([*pool[(at := rng.randrange(20)) : at + 5], "Same words in each text, twelve of them, to make a run, here. And nine more that follow them to be enough. "]) for i in range(-30, 30)}
    listed = lambda: set(glob.glob(shared._own_tables(spark).removeprefix("file:") + "/*"))
    before = listed()
    got = spans.drop_repeats(documents(spark, texts).repartition(7)).collect()
    assert {r.doc_id: (r.text, r.n_sentences, r.n_removed) for r in got} == brute_repeats(texts)
    assert listed() == before


def test_a_frequent_run_comes_once_from_a_portion(monkeypatch):
    given = []
    monkeypatch.setattr(words, "give_back", lambda: given.append(1))
    batch = pa.record_batch({"id": pa.array(range(2000), pa.int64()), "text": ["One two three four five six seven eight nine ten. Eleven more words follow here so that it is a run. End."] * 2000})
    dealt = pa.Table.from_batches(spans._hashed(20, 50, 8)(iter([batch])))
    runs = spans._unpacked(dealt, spans._RUN)
    assert (runs["pos"] >= 0).sum() == len(np.unique(runs[["h1", "h2"]][runs["pos"] >= 0])) and set(runs["id"][runs["pos"] >= 0]) == {0}
    assert dealt.num_rows <= 8 and set(runs["id"][runs["pos"] < 0]) == {*range(1, 2000)}
    assert given == [1] and not list(spans._removed(20, 50)(iter([]))) and given == [1, 1]


def test_passages_whatever_their_sentences(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    fill = lambda n: " ".join(word() for _ in range(n))
    one, two, within, short, middle = fill(60) + ".", fill(30) + ". " + fill(30) + ".", fill(55), fill(49), fill(20) + ". " + fill(5) + ". " + fill(35)
    texts = {1: f"{one} {fill(9)}", 2: f"{fill(7)} {one.upper()} Tail.", 3: two, 4: two, 5: f"{fill(5)} {middle} {fill(4)}", 6: f"Q {middle}, {fill(4)} {middle} z", 7: f"a {short} b", 8: f"c {short} d"}
    texts |= {9: None, 10: "", 11: "x " * 120, 12: f"own {fill(99)}", 13: f"{within} then {within}"}
    got = {r.doc_id: (r.text, r.n_removed) for r in spans.drop_passages(documents(spark, texts)).collect()}
    for i in (1, 3, 5, 7, 8, 12):
        assert got[i] == (texts[i], 0)
    assert got[2] == (" ".join(texts[2].split()[:7]) + " Tail.", 60) and got[4] == ("", 60)
    assert got[6][1] == 59 + 60 and got[13][1] == 55
    assert got[9] == got[10] == ("", 0) and got[11] == ("x " * 50, 70)
    assert spans.drop_passages(documents(spark, texts).limit(0)).count() == 0


def test_passages_equal_brute_force(spark):
    rng = random.Random(9)
    pool = [[f"p{rng.randrange(300)}" for _ in range(rng.randrange(40, 90))] for _ in range(12)]
    texts = {i: " ".join(w for _ in range(4) for w in [*rng.choice(pool)[rng.randrange(8) :], f"u{rng.random()}"]) for i in range(60)}
    first, want = {}, {}
    for i in sorted(texts):
        w, starts = texts[i].split(), set()
        for a in range(len(w) - 49):
            at = first.setdefault(tuple(w[a : a + 50]), (i, a))
            if at[0] < i or a >= at[1] + 50:
                starts.add(a)
        if starts:
            want[i] = starts
    assert {r.id: set(r.starts) for r in spans.repeated_passages(documents(spark, texts), "doc_id", "text").collect()} == want and want


def test_partners_are_those_counted(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    report = {r.doc_id: r for r in simhash.fingerprint_report(docs).collect()}
    rows = simhash.near_classes(docs).collect()
    members, near = collections.defaultdict(set), collections.defaultdict(set)
    for r in rows:
        members[r.class_id].add(r.doc_id)
        if r.near_class is not None:
            near[r.doc_id].add(r.near_class)
            a, b = (int(report[i].fingerprint, 16) for i in (r.doc_id, r.near_class))
            assert r.doc_id == r.class_id and r.distance == (a ^ b).bit_count()
    of = {i: c for c, found in members.items() for i in found}
    assert of.keys() == report.keys() and near and all(len({report[i].fingerprint for i in found}) == 1 for found in members.values())
    for i, r in report.items():
        if i % 50 == 0:
            assert r.n_near == sum(len(members[c]) for c in near[of[i]] | {of[i]}) - 1
    assert simhash.near_classes(docs.limit(0)).count() == 0
