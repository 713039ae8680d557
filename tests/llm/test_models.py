"""LM scoring, the quality classifier, SentencePiece pieces and the pipeline."""

import collections
import hashlib
import math
import random
import re
import struct
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from lexloom.llm import jaccard, lm, pieces, queries, quality, words

SF = "/root/testdata/sf0.001"


def documents(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").selectExpr("doc_id", "text", "'x' as id", "1 as train", "2 as score")


def brute_scores(texts):
    """Probabilities by their recursive definition, over counters of the whole corpus."""
    grams, rows = [collections.Counter() for _ in range(3)], {}
    for i, t in texts.items():
        w = rows[i] = [0, *(t or "").encode().lower().split(), None]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            grams[0].update((x,) for x in w[1:])
            grams[1].update(zip(w, w[1:]))
            grams[2].update(zip(w, w[1:], w[2:]))
    n, v = sum(grams[0].values()), len(grams[0])
    ends = grams[0][(None,)]

    def mass(k):  # by bisection of the definition, with every context by itself
        low, high = 1e-3, 1e9
        once = sum(c == 1 for c in grams[k].values())
        for _ in range(200):
            m = (low * high) ** 0.5
            low, high = (m, high) if sum(c * m / (c + m) for c in grams[k - 1].values()) < once else (low, m)
        return high

    m = [mass(1), mass(2)]
    count = lambda g: ends if g == (0,) else grams[len(g) - 1][g]

    def p(*g):
        if len(g) == 1:
            return (count(g) + 1) / (n + v + 1)
        return (count(g) + m[len(g) - 2] * p(*g[1:])) / (count(g[:-1]) + m[len(g) - 2])

    out = {}
    for i, w in rows.items():
        steps = [p(*w[max(0, k - 2) : k + 1]) for k in range(1, len(w))]
        base = sum(math.log10(p(x)) for x in w[1:])
        out[i] = (zlib.crc32(str(i).encode()) % 7 == 2, len(w) - 1, sum(grams[0][(x,)] > 0 for x in w[1:]), n, base, sum(map(math.log10, steps)))
    if len(grams[0]) < 50:  # every state's probabilities sum to one, with one unknown word
        for h in [(), *list(grams[0])[:9], *list(grams[1])[:9]]:
            if None not in h:
                assert sum(p(*h, *x) for x in [*grams[0], ("unknown",)]) == pytest.approx(1)
    return out


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_scores_equal_brute_force(spark, monkeypatch, levels):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 500)  # many chunks
    monkeypatch.setattr(lm, "STEP_TOKENS", 7)
    rng = random.Random(1)
    texts = {i: " ".join(rng.choice("the THE of a bb ccc dd é".split()) + rng.choice(["", "", str(rng.randrange(30))]) for _ in range(rng.randrange(40))) for i in range(120)}
    texts |= {500: None, 501: "", 502: " \x0b\n ", 503: "w " * 5000}
    got = lm.score_texts(documents(spark, texts), group_bytes=[1 << 30, 8000, 2000][levels - 1], ranges=[16, 4, 3][levels - 1]).collect()
    want = brute_scores(texts)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:5] == want[r.doc_id][:4]
        assert (r.base_score, r.score) == (pytest.approx(want[r.doc_id][4]), pytest.approx(want[r.doc_id][5], rel=1e-5))


def test_each_state_sums_to_one():
    brute_scores({i: f"a b {'c' * (i % 3 + 1)} a b d" for i in range(40)})


def test_a_known_text_scores_above_its_base(spark):
    """A held-out text that training holds too takes arcs of the third order."""
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 == 2)
    other = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 7 != 2)
    rng = random.Random(4)
    text = lambda: " ".join(str(rng.randrange(300)) for _ in range(80))
    twin = text()
    texts = {held: twin, other: twin} | {2000 + i: text() for i in range(60)}
    got = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in lm.score_texts(documents(spark, texts)).collect() if r.held_out}
    assert got[held] > 0.5 and all(g < 0.3 for i, g in got.items() if i != held) and len(got) > 3


def test_scores_of_edge_tables(spark):
    assert lm.score_texts(documents(spark, {1: "a"}).limit(0)).count() == 0
    twice = documents(spark, {2: "a b"}).union(documents(spark, {2: "a b"}))
    assert [r.train_tokens for r in lm.score_texts(twice).collect()] == [6, 6]
    null = documents(spark, {1: "a"}).withColumn("doc_id", F.lit(None).cast("long"))
    assert [(r.doc_id, r.held_out, r.n_known) for r in lm.score_texts(null).collect()] == [(None, False, 2)]


def test_scores_of_long_texts(spark):
    """One word of a million characters, a text of one word a hundred thousand times, and one without any."""
    texts = {1: "x" * 1_000_000, 2: "word " * 100_000, 3: " \t" * 100_000, 4: "word"}
    got = {r.doc_id: r for r in lm.score_texts(documents(spark, texts)).collect()}
    assert [got[i].n_tokens for i in (1, 2, 3, 4)] == [2, 100_001, 1, 2]
    want = brute_scores(texts)
    assert all(got[i].score == pytest.approx(want[i][5]) and got[i].base_score == pytest.approx(want[i][4]) for i in texts)


def test_memory_of_a_chunk_is_bounded(monkeypatch):
    """Bytes for each token that a chunk takes at most, and what is left when its group is done."""
    given = []
    monkeypatch.setattr(lm, "give_back", lambda: given.append(1))
    rng = np.random.default_rng(8)
    texts = [b" ".join(b"w%d" % w for w in rng.integers(0, 2000, 20_000)) for _ in range(10)]
    tokens = sum(len(t.split()) + 1 for t in texts)
    tracemalloc.start()
    chunk = lm.Chunk(iter(texts))
    peak = tracemalloc.get_traced_memory()[1]
    assert peak < 80 * tokens
    for keys, at, first in zip(chunk.keys, chunk.at, chunk.first):
        assert (np.diff(keys) > 0).all() and (at[first] == np.arange(len(keys))).all()
    counts = [(kind, 0, 1, None, lm._pack(c)) for kind, c in enumerate(chunk.counts(np.ones(len(texts), bool)))]
    del chunk, keys, at, first
    heads = struct.pack("<20q", *range(10), *map(len, texts)) + bytes(10)
    table = pa.Table.from_arrays(lm._rows([*counts, (lm.TEXTS, 10, 1, heads, zstandard.compress(b"".join(texts)))]), schema=lm._SCHEMA)
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    scored = lm._scored(tokens, 2001, (1.0, 1.0))(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak - before < 110 * tokens and given == [1]
    assert scored.num_rows == 10 and sum(scored.column("n_tokens").to_pylist()) == tokens


def test_distinct_values_equal_those_of_numpy():
    for values in (np.array([5, 3, 5, 5, 1, 3], np.uint64), np.empty(0, np.uint64), np.array([2**64 - 1, 0], np.uint64), np.random.default_rng(2).integers(0, 50, 999).astype(np.uint64)):
        for got, want in zip(lm._distinct(values), np.unique(values, return_index=True, return_inverse=True)):
            assert got.tolist() == want.tolist()


def test_held_out_scores_beat_the_base(spark):
    rows = [r for r in queries.op8_lm(spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_quality_separates(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.classify(docs, labels)
    share = {(r.quality, r.toxic): r.s for r in judged.join(labels, "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("keep").cast("int")).alias("s")).collect()}
    assert judged.count() == docs.count() and share[1, 0] >= 0.95 and share[0, 0] <= 0.5


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_quality_rejects_toxic_and_keeps_unseen_clean(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels"))
    unseen = F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(10)) < 3
    rows = quality.classify(docs, labels.where(~unseen)).join(labels, "doc_id").withColumn("unseen", unseen).collect()
    share = lambda of: sum(r.keep for r in rows if of(r)) / sum(map(of, rows))
    assert share(lambda r: r.toxic == 1) <= 0.36 and share(lambda r: r.toxic == 0 and r.quality == 0) <= 0.25
    assert share(lambda r: r.unseen and r.quality == 1 and r.toxic == 0) >= 0.95


def test_quality_equals_brute_force(spark):
    """Importances from sets of features counted in Python; of the documents kept, that they are the k of the largest keys."""
    rng = random.Random(21)
    words = [f"w{k}" for k in range(60)]
    texts = {i: " ".join(rng.choices(words[:40] if i % 3 else words[20:], k=rng.randrange(1, 60))) + rng.choice(["", "!!", ", a b"]) for i in range(150)}
    texts |= {200: None, 201: "", 202: "junk " * 300}
    good = [i for i in texts if i < 150 and i % 3 and i % 2]
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(i, 0, 0) for i in range(0, 150, 3)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(documents(spark, texts), labels, buckets=1 << 18).collect()}

    def features(text):
        tokens = re.findall(r"[^\W_]+|[^\w\s]+|_+", (text or "").lower())
        single = collections.Counter(("one", t) for t in tokens)
        pair = collections.Counter("same" if a == b else ("two", a, b) for a, b in zip(tokens, tokens[1:]))
        return {(f, 4**k) for f, c in [*single.items(), *pair.items()] for k in range(9) if c >= 4**k}

    raw, target = collections.Counter(), collections.Counter()
    for i, t in texts.items():
        raw.update(features(t))
        if i in good:
            target.update(features(t))
    weights = {}
    for i, t in texts.items():
        total = 0.0
        for f in features(t):
            expected = (raw[f] - 1) * len(good) / len(texts) + quality.PRIOR_DOCS
            ratio = math.log((target[f] - (i in good) + quality.PRIOR_DOCS) / expected)
            total += ratio * max(0.0, 1 - quality.SHRINKAGE / expected / max(ratio**2, 1e-12))
        weights[i] = total
    # a feature that shares its bucket in both tables with others may differ; with these few none does
    assert all(r.log_weight == pytest.approx(weights[i], abs=1e-3) for i, r in got.items())
    level = float(np.percentile([got[i].log_weight for i in good], 100 * quality.CLEAN_LOSS))
    k = sum(r.log_weight >= level for r in got.values())
    first = sorted(got.values(), key=lambda r: -r.key)[:k]
    assert {r.doc_id for r in first} == {i for i, r in got.items() if r.keep} and 0 < k < len(texts)
    noise = sorted(r.key - r.log_weight / quality.TEMPERATURE for r in got.values())
    assert abs(noise[len(noise) // 2] + math.log(math.log(2))) < 0.3  # the median of Gumbel noise


def test_quality_edges(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    df = documents(spark, {1: "a b", 2: None, 3: ""}).withColumn("target", F.lit("clash"))
    assert [r.keep for r in quality.classify(df, labels).collect()] == [True] * 3  # no target document is left
    good = spark.createDataFrame([(1, 1, 0)], labels.schema)
    twice = df.union(df)
    kept = collections.defaultdict(set)
    for r in quality.classify(twice, good).collect():
        kept[r.doc_id].add(r.keep)
    assert all(len(v) == 1 for v in kept.values()) and quality.classify(df.limit(0), good).count() == 0


def test_kth_largest(spark):
    rng = random.Random(2)
    values = [rng.randrange(-(10**13), 10**13) for _ in range(200)] + [5, 5, 5]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for k in (1, 17, len(values)):
        assert quality.kth_largest(df, "v", k) == sorted(values, reverse=True)[k - 1]
    assert quality.kth_largest(df, "v", 0) is None and quality.kth_largest(df, "v", 500) is None


@pytest.fixture(scope="module")
def model():
    return pieces.load_model()


@pytest.fixture(scope="module")
def own(model):
    return pieces.Pieces(model)


@pytest.fixture(scope="module")
def library(model):
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def odd_texts(n=600):
    rng = random.Random(3)
    alphabets = ["ab ", "thein ", "   x", "日本語のテ ", "😀a \n\t", "aA1_.-"]
    return ["".join(rng.choice(a) for _ in range(rng.randrange(1, 60))) for a in rng.choices(alphabets, k=n)]


def test_pieces_equal_the_library(own, library):
    for text in [*odd_texts(), "", " ", "a" * 3000, "\x00", "ﬁ"]:
        ids = own.encode(text)
        assert ids.tolist() == library.encode(text)
        assert own.decode(ids) == text


def merged(library, text):
    """The BPE segmentation by its definition: join the adjacent pair of the best score, the leftmost on a tie."""
    ids = {library.id_to_piece(i): i for i in range(library.vocab_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}
    parts = list(pieces.SPACE + text.replace(" ", pieces.SPACE))
    while best := max(((library.get_score(ids[a + b]), -k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ids), default=None):
        parts[-best[1] : 2 - best[1]] = [parts[-best[1]] + parts[1 - best[1]]]
    return [i for p in parts for i in ([ids[p]] if p in ids else [library.piece_to_id(f"<0x{b:02X}>") for b in p.encode()])]


def test_pieces_equal_the_definition(own, library):
    for text in odd_texts(40):
        assert own.encode(text).tolist() == merged(library, text)


def scanned(own, text, chunk, associate):
    s, around = pieces.SPACE + text.replace(" ", pieces.SPACE), 2 * own.longest
    last = (len(s) - 1) // chunk
    cut = [(s[max(0, k * chunk - around) : k * chunk], s[k * chunk : (k + 1) * chunk], s[(k + 1) * chunk : (k + 1) * chunk + around]) for k in range(last + 1)]
    matrices = [own.transfer(*c, k == 0, k == last) for k, c in enumerate(cut)]
    if associate:  # any bracketing of the product leads from the beginning to the end
        left, right = matrices[0], matrices[-1]
        for m in matrices[1:]:
            left = pieces.product(left, m)
        for m in matrices[-2::-1]:
            right = pieces.product(m, right)
        assert left == right == {pieces.BEGIN: [pieces.BEGIN]}
    return [i for c, (a, b) in zip(cut, pieces.settle(matrices)) for i in own.backtrace(*c, a, b)]


@pytest.mark.parametrize("more", [1, 9, 30])
def test_scan_equals_the_library(own, library, more):
    for text in [*odd_texts(200), "thein" * 80, "日本" * 60]:
        assert scanned(own, text, own.longest + more, len(text) > 40) == library.encode(text)


def test_encode_and_decode_tables(spark, model, library):
    texts = {1: "hello  world", 2: None, 3: "", 4: "the thing " * 40, 5: "x" * 300, 6: "日本語 😀" * 30}
    df = documents(spark, texts).withColumn("ids", F.lit("clash")).withColumn("uid", F.lit(0))
    df = df.union(df.where("doc_id = 4"))
    rows = pieces.decode(pieces.encode(df, model, chunk_chars=64), model).collect()
    assert len(rows) == 7
    for r in rows:
        assert r.ids == library.encode(texts[r.doc_id] or "") and r.text == (texts[r.doc_id] or "")
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, pieces.round_trip(df, model, chunk_chars=64).collect()), key=str)
    assert pieces.encode(df.limit(0), model).count() == 0


def test_matrices_are_multiplied_up_a_tree(spark, model, library):
    texts = {1: "the thing " * 300, 2: "日本" * 900, 3: "x" * 2000, 4: "short"}
    for block in (2, 3):
        for r in pieces.encode(documents(spark, texts), model, chunk_chars=64, block=block).collect():
            assert r.ids == library.encode(texts[r.doc_id])


def test_chunks_are_worked_on_in_portions(model, own, library, monkeypatch):
    """However many chunks a batch has, only a few are opened at once; ids and texts stay whole."""
    text, size, begin = "the thing 日本 " * 900, 512, pieces._pair(pieces.BEGIN)
    cut = next(pieces._cut(size, 2 * own.longest)(iter([pa.record_batch({"uid": [7], "id": [1], "text": [text]})])))
    monkeypatch.setattr(pieces, "CHUNK_BYTES", 2000)
    found = list(pieces._matrices(model)(iter([cut])))
    assert len(found) > 5 and max(b.num_rows for b in found) < 5
    path = pieces.settle([pieces._matrix(r["matrix"]) for b in found for r in b.to_pylist()])
    ends = [pa.array([pieces._pair(p[k]) for p in path], pieces._ARROW_STATE) for k in (0, 1)]
    assert ends[0][0].as_py() == ends[1][-1].as_py() == begin
    whole = pa.RecordBatch.from_arrays([*cut.columns, *ends], names=[*cut.schema.names, "entry", "exit"])
    parts = list(pieces._traced(model, True)(iter([whole])))
    assert len(parts) > 5 and max(b.num_rows for b in parts) < 5
    rows = [r for b in parts for r in b.to_pylist()]
    assert [r["no"] for r in rows] == list(range(cut.num_rows))
    assert [i for r in rows for i in r["part"]] == library.encode(text) and "".join(r["text"] for r in rows) == text
    whole = list(pieces._encoded(model, True)(iter([pa.record_batch({"id": range(20), "text": ["the thing " * 50] * 20})])))
    assert len(whole) > 4 and [r["decoded"] for b in whole for r in b.to_pylist()] == ["the thing " * 50] * 20


def test_memory_is_given_back_when_a_task_ends(monkeypatch):
    given = []
    monkeypatch.setattr(words, "give_back", lambda: given.append(1))
    run = words.tidy(lambda batches: (b + 1 for b in batches))
    assert list(run(iter([1, 2]))) == [2, 3] and given == [1]
    stopped = run(iter([1, 2]))
    assert next(stopped) == 2 and given == [1]
    stopped.close()
    assert given == [1, 1]
    tasks = [quality._counted(8), jaccard._sets(4), jaccard._posts(4, 85, 100), jaccard._shingles(4), pieces._encoded(pieces.load_model(), True)]
    assert [list(task(iter([]))) is not None for task in tasks] and len(given) == 2 + len(tasks)


def test_a_word_without_a_quick_path(own, library):
    """Words in which the longest piece is often wrong: the search steps back."""
    rng = random.Random(31)
    for _ in range(400):
        word = "".join(rng.choice(["a", "aa", "an", "the", "ing", "tion", "st", "er"]) for _ in range(rng.randrange(1, 40)))
        assert own.flat(own.whole(pieces.SPACE + word)) == library.encode(word)


def test_pieces_query_round_trips(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op10_pieces(spark, SF).collect()
    assert {r.doc_id: r.decoded_sha256 for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}


def test_pipeline(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, "/root/testdata/sf0.01").cache()
        assert kept.columns == columns and kept.count() <= before.count()
        if name == "jaccard":
            left = {r.doc_id for r in before.collect()}
            parts = collections.defaultdict(set)
            for r in jaccard.jaccard_components(before, k=5, num=80, den=100).collect():
                parts[r.component_id].add(r.doc_id)
            assert {r.doc_id for r in kept.collect()} == set(parts) <= left
        if name == "pii":
            assert kept.where(F.length("text") != F.col("n_chars")).count() == 0
            assert kept.where(F.col("text").rlike(r"[a-z0-9]@[a-z0-9-]+\.[a-z]")).count() == 0
    last = corpus_pipeline.STAGES[-1][1](spark, kept, "").collect()
    shas = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in kept.collect()}
    assert {r.doc_id: r.decoded_sha256 for r in last} == shas
    assert np.all([r.n_tokens == len(r.ids) for r in last])


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows, a further column and an empty table go through all stages."""
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet").limit(40).selectExpr("*", "nullif('clash', '') as id", "nullif(1, 0) as keep")
    odd = spark.createDataFrame([(9001, None, None, None, None, None, 1), (9002, "", "en", "s", 0, "x", 1), (9002, "", "en", "s", 0, "x", 1), (None, "mail a@b.co", "en", "s", 11, "x", 1)], docs.schema)
    for table in (docs.union(odd), docs.limit(0)):
        kept = table
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, base)
            assert kept.columns == table.columns
            kept.write.parquet(f"{tmp_path}/{name}-{table.count()}")
            kept = spark.read.parquet(f"{tmp_path}/{name}-{table.count()}")
        last = corpus_pipeline.STAGES[-1][1](spark, kept, base).collect()
        found = collections.Counter(r.doc_id for r in last)
        assert len(last) == kept.count() and (not last or (found[9001], found[9002], found[None]) == (1, 2, 1))
