"""The operators as queries: against plain versions on small tables, and on odd rows."""

import collections
import hashlib
import math
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilspan.llm import _text, bpe, fingerprints, knn, license_scan, near_dup, packing, quality, queries, suffix_lm, toxicity, warc

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, label int, score double, spans string, digest string, `key` long, node long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None if i == 3 else "en", "s" if i else None, len(t) if t else None, "x", 1, 0.5, "y", "z", 7, 8) for i, t in rows], SCHEMA)


LONG = " ".join(f"w{k % 977}" for k in range(30_000))
ODD = [(1, "One two three four five six MIT License"), (2, None), (3, ""), (4, LONG), (5, "One two three four five six MIT License"), (5, "One two three four five six MIT License"), (None, "no id here"), (None, None), (6, "<|endoftext|> é 漢字 \x00 !"), (7, "!!! ???"), (8, " \n\t ")]


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def rows_of(df, *cols):
    return collections.Counter(tuple(r) for r in df.select(*cols).collect())


def test_registered_names():
    assert [q.split("_")[0] for q in queries.queries()] == [f"op{n}" for n in range(1, 11)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "packing"]


def test_license_report(odd, empty):
    got = {r.doc_id: r for r in license_scan.license_report(odd).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].labels, got[1].score) == (8, 1, 6, "mit", 0.5)
    assert got[2].n_words == 0 and got[2].first_word is None and got[2].labels == "" and got[4].n_words == 30_000
    assert license_scan.license_report(empty).count() == 0 and license_scan.license_report(odd).count() == len(ODD)


def test_toxicity(spark, documents, odd, empty, sf_dir):
    out = queries.queries()["op2_toxicity"](spark, sf_dir).collect()
    assert len(out) == documents.count()
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    labels = spark.createDataFrame([(1, 0), (4, 1), (4, 0), (None, 1), (9, None)], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(empty, model).count() == 0
    kept = toxicity.keep_clean(odd, toxicity.train(odd, labels.limit(0)))
    assert rows_of(kept, *kept.columns) == rows_of(odd, *odd.columns)
    assert toxicity.keep_clean(empty, toxicity.train(empty, labels)).columns == odd.columns


def test_toxicity_learns(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    made = [(k, " ".join(words[(k * 7 + j * 3) % 6] for j in range(9)) + (" vile" if k % 4 == 0 else "")) for k in range(400)]
    docs, labels = frame(spark, made), spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in made], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, usable=~toxicity.held_out())
    out = toxicity.score(docs, model).where(toxicity.held_out()).collect()
    assert all((r.score >= toxicity.THRESHOLD) == (r.doc_id % 4 == 0) for r in out)
    assert toxicity.keep_clean(docs, model).count() == 300


def test_quality(spark, documents, odd, empty, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(documents, labels)
    assert quality.score(documents, model).where("score BETWEEN 0 AND 1").count() == documents.count()
    assert quality.score(odd, model).count() == len(ODD)
    assert quality.keep_good(odd, quality.NEUTRAL).count() == len(ODD)
    kept = quality.keep_good(odd, quality.NEUTRAL)
    assert rows_of(kept, *kept.columns) == rows_of(odd, *odd.columns)
    assert quality.keep_good(empty, quality.train(empty, labels)).count() == 0
    bare = odd.select("doc_id", "text")
    assert quality.score(bare, quality.train(bare, labels)).count() == len(ODD)


def plain_co_training(rows, labels):
    """Co-training row by row, over the features that the operator gives a row."""
    column = lambda k: pa.array([r[k] for r in rows], pa.string())
    lists = [[], []]
    for low, high, block in _text.blocks(column(1)):
        for view, (text, place) in enumerate(quality.views(block, [column(2 + k).slice(low, high - low) for k in range(3)])):
            lists[view] += [place[text == k].tolist() for k in range(high - low)]
    order = labels["order"]
    apart, base = order[3::4], [i for k, i in enumerate(order) if k % 4 != 3]
    at = {r[0]: k for k, r in enumerate(rows)}
    y = labels["label"]

    def ratios(given):
        out = []
        for view in (0, 1):
            n = [[0.0, collections.Counter()] for _ in (0, 1)]
            for i in base:
                n[y[i]][0] += 1
                n[y[i]][1].update(lists[view][at[i]])
            for label in (0, 1):
                own = [k for k, called in given[view] if called == label]
                weight = min(1.0, n[label][0] / len(own)) if own else 0.0
                n[label][0] += weight * len(own)
                for k in own:
                    for p in lists[view][k]:
                        n[label][1][p] += weight
            ratio = {}
            for p in set(n[0][1]) | set(n[1][1]):
                if n[0][1][p] + n[1][1][p] >= quality.LEAST:
                    ratio[p] = math.log((n[1][1][p] + 1) / (n[1][0] + 2)) - math.log((n[0][1][p] + 1) / (n[0][0] + 2))
            out.append(ratio)
        return out

    def odds(ratio, view, k, calibration):
        own = [ratio[view][p] for p in lists[view][k] if ratio[view].get(p)]
        return calibration[view][0] * (sum(own) / max(1, len(own))) + calibration[view][1]

    plain = ((1.0, 0.0), (1.0, 0.0))

    def calibrated(ratio):
        means = [np.array([odds(ratio, view, at[i], plain) for i in sorted(apart)]) for view in (0, 1)]
        return quality.calibrated(quality.NEUTRAL, means, np.array([y[i] for i in sorted(apart)], float))

    ratio = ratios([[], []])
    model = calibrated(ratio)
    for _ in range(quality.ROUNDS):
        given = [[], []]
        for k, r in enumerate(rows):
            if r[0] not in y:
                p = [1 / (1 + math.exp(-odds(ratio, view, k, model.calibration))) for view in (0, 1)]
                call = [1 if x >= quality.SURE else 0 if x <= 1 - quality.SURE else None for x in p]
                if None in call or call[0] == call[1]:
                    for view in (0, 1):
                        if call[1 - view] is not None:
                            given[view].append((k, call[1 - view]))
        ratio = ratios(given)
        model = calibrated(ratio)
    a, b, c = model.combined
    return {r[0]: 1 / (1 + math.exp(-(a * odds(ratio, 0, k, model.calibration) + b * odds(ratio, 1, k, model.calibration) + c))) for k, r in enumerate(rows)}, sum(map(len, given))


def test_quality_equals_a_plain_version(spark):
    pick = np.random.default_rng(3)
    good = lambda: " ".join(pick.choice(["plain", "Words", "here", "and", "There", "so", "it", "goes"], 40))
    bad = lambda: " ".join(pick.choice(["x!!", "BUY", "###", "a|b", "$$9", "so"], 40))
    rows = [(k, good() if k % 3 else bad(), "en" if k % 3 else "xx", f"s{k % 5}", 100 + k % 7) for k in range(360)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    truth = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(0, 360, 2)], "doc_id long, quality int")
    order = [r.doc_id for r in truth.orderBy(quality.F.xxhash64("doc_id"), "doc_id").collect()]
    page = [(i, t, l, s, str(int(math.log2(n + 1)))) for i, t, l, s, n in rows]
    want, handed = plain_co_training(page, {"order": order, "label": {k: int(k % 3 > 0) for k in range(0, 360, 2)}})
    got = {r.doc_id: r.score for r in quality.score(docs, quality.train(docs, truth)).collect()}
    assert handed > 100 and max(abs(got[i] - want[i]) for i in want) < 1e-6
    assert all((got[i] >= 0.5) == (i % 3 > 0) for i in got)


def brute_knn(rows, k=5):
    valid = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, q in valid:
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in valid if j != i)[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)}
    return out


def test_knn(spark):
    rng = np.random.default_rng(3)
    rows = [(k, [float(x) for x in rng.normal(size=8).round(2)]) for k in range(420)]
    rows += [(k, rows[7][1]) for k in range(420, 700)]  # a third of all rows are copies
    rows += [(700, None), (750, [1.0, None]), (800, [float("nan")] * 8), (850, [float("inf")] * 8), (None, [1.0] * 8), (900, [0.5, 0.25]), (950, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("cell", F.lit(1)).withColumn("v", F.lit(2))
    for options in ({}, {"queries": 3, "vectors": 50, "pivots": 5}):
        got = {tuple(r) for r in knn.knn_join(df, is_query=F.col("id") % 50 == 0, **options).collect()}
        assert got == brute_knn(rows)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert {tuple(r) for r in knn.knn_join(few, is_query=F.col("id") % 50 == 0).collect()} == brute_knn(rows[:3])
    assert knn.knn_join(few.limit(0), is_query=F.col("id") % 50 == 0).count() == 0
    large = [(0, [1e9, 3e9]), (1, [2e9, -1e9]), (2, [0.001, 0.002])]
    got = {tuple(r) for r in knn.knn_join(spark.createDataFrame(large, "vec_id long, embedding array<double>"), is_query=F.col("id") % 50 == 0).collect()}
    assert got == {(i, n, j, max(1 - 2**63, min(2**63 - 1, s))) for i, n, j, s in brute_knn(large)}


def test_knn_repeated_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(k, [float(x) for x in rng.normal(size=6).round(2)]) for k in range(1, 130)]
    rows += [(0, [float(x) for x in 9 + rng.normal(size=6).round(2)]) for _ in range(9)]  # their own products are the largest
    rows += [rows[49]] * 2 + [(100, [float(x) for x in rng.normal(size=6).round(2)])] + [rows[20]] * 7
    scores = collections.defaultdict(list)
    for i, q in rows:
        for j, v in rows:
            if i % 50 == 0 and i != j:
                scores[i].append((-sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(q, v, strict=True)), j))
    want = collections.Counter((i, n + 1, j, -s) for i, found in scores.items() for n, (s, j) in enumerate(sorted(found)[:5]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for options in ({}, {"queries": 3, "vectors": 40, "pivots": 5}, {"pivots": 60}):
        assert collections.Counter(tuple(r) for r in knn.knn_join(df, is_query=F.col("id") % 50 == 0, **options).collect()) == want


def check_packed(docs, out, tokenizer):
    ids = {}
    for i, t in docs:
        own = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        ids.setdefault(i, []).append(own)
    pieces = collections.defaultdict(list)
    for r in out:
        own = next(x for x in ids[r.doc_id] if len(x) == r.doc_tokens)
        assert zlib.crc32(np.array(own[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and r.length > 0
        pieces[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in out) == sum(len(x) for own in ids.values() for x in own)
    assert sorted(pieces) == list(range(len(pieces)))
    for k, own in pieces.items():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at == packing.WINDOW or k == len(pieces) - 1


def test_packing(odd, empty, documents):
    from veilspan.llm._tokens import load

    tokenizer = load(WORD)
    check_packed(ODD, packing.pack(odd, WORD).collect(), tokenizer)
    check_packed([tuple(r) for r in documents.select("doc_id", "text").collect()], packing.pack(documents.repartition(5), WORD).collect(), tokenizer)
    assert packing.pack(empty, WORD).count() == 0
    whole = {r.doc_id: r.ids for r in packing.pack(odd.where("doc_id = 1"), WORD, keep_ids=True).collect()}
    assert whole[1] == [*tokenizer.encode(ODD[0][1], add_special_tokens=False).ids, 1]


def brute_neighbours(rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = collections.Counter()
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        a, b, c = fingerprints.sketch(pa.array([t, edited, n]))
        out[(i, len(t), hashlib.sha256(edited.encode()).hexdigest(), fingerprints._hex(a[None])[0], fingerprints._hex(b[None])[0], float((a == b).mean()), float((a == c).mean()))] += 1
    return out


def test_neighbours(odd, empty, documents):
    assert rows_of(fingerprints.neighbours(odd), "*") == brute_neighbours(ODD)
    assert rows_of(fingerprints.neighbours(documents.repartition(7)), "*") == brute_neighbours([tuple(r) for r in documents.select("doc_id", "text").collect()])
    assert fingerprints.neighbours(empty).count() == 0
    one = odd.where("doc_id = 4")
    assert fingerprints.neighbours(one).first().near_next == 1.0
    pairs = fingerprints.fingerprints(odd).where("doc_id IN (1, 5)").select(F.col("fingerprint")).distinct()
    assert pairs.count() == 1
    assert odd.sparkSession.range(1).select(fingerprints.likeness(F.lit("ab12" * 64), F.lit("ab12" * 32 + "0000" * 32)).alias("x")).first().x == 0.5


def test_bpe(odd, empty):
    from veilspan.llm._tokens import load

    library = load(BYTE)
    ids = {(r.doc_id, tuple(r.ids)) for r in bpe.encode(odd, BYTE).collect()}
    assert ids == {(i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD}
    assert rows_of(bpe.decode(bpe.encode(odd, BYTE), BYTE), "*") == collections.Counter((i, t or "") for i, t in ODD)
    for r in bpe.round_trip(odd.where("doc_id IS NOT NULL"), BYTE).collect():
        text = next(t or "" for i, t in ODD if i == r.doc_id)
        own = library.encode(text, add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(own), hashlib.sha256(",".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.round_trip(empty, BYTE).count() == 0


def grams(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter([("text", text)])


def brute_classes(rows):
    rows = [(i, t or "") for i, t in rows if i is not None]
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [(i, grams(t)) for i, t in rows]
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if sum((a & b).values()) >= 0.8 * sum((a | b).values()):
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i, _ in rows}


def test_near_duplicates(spark, odd, empty, documents):
    out = near_dup.near_duplicates(odd).collect()
    assert len(out) == len(ODD) and all((r.class_id is None) == (r.doc_id is None) for r in out)
    assert {r.doc_id: r.class_id for r in out if r.doc_id is not None} == brute_classes(ODD)
    rng = np.random.default_rng(5)
    rows = []
    for c in range(6):
        base = [f"t{x}" for x in rng.integers(0, 400, 120)]
        for _ in range(40 if c == 0 else 6):
            own = list(base)
            for at in rng.integers(0, 120, rng.integers(0, 6)):
                own[at] = f"t{rng.integers(0, 400)}"
            rows.append((len(rows), " ".join(own)))
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(len(rows) + k, passage + " " + " ".join(f"u{x}" for x in rng.integers(0, 10**6, 40))) for k in range(30)]
    rows += [(i + 1000, t) for i, t in rows[:50]]
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(frame(spark, rows).repartition(4)).collect()}
    assert got == brute_classes(rows)
    assert near_dup.near_duplicates(empty).count() == 0
    kept = near_dup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(brute_classes(ODD).values()))
    assert kept.where("doc_id IS NULL").count() == 2


def test_near_duplicates_of_documents(documents):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    assert {r.doc_id: r.class_id for r in near_dup.near_duplicates(documents).collect()} == brute_classes(rows)


def test_near_duplicates_of_repeated_ids(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(2, a), (5, a), (5, b), (5, b), (7, c), (7, c + " more"), (9, b), (9, a)]
    out = near_dup.near_duplicates(frame(spark, rows)).collect()
    assert collections.Counter((r.doc_id, r.class_id) for r in out) == {(2, 2): 1, (5, 2): 1, (5, 5): 2, (7, 7): 2, (9, 5): 1, (9, 2): 1}
    kept = collections.Counter((r.doc_id, r.text) for r in near_dup.keep_one(frame(spark, rows)).collect())
    assert set(kept.values()) == {1} and {t for _, t in kept if t in (a, b)} == {a, b} and sorted(i for i, _ in kept) == [2, 5, 7]
    # an id that stands everywhere
    hot = [(1, f"{a} x{k}" if k % 2 else f"{b} y{k}") for k in range(60)] + [(1, c)] * 20
    assert {t[0] for _, t in [(r.doc_id, r.text) for r in near_dup.keep_one(frame(spark, hot)).collect()]} == {"a", "b", "c"}
    with pytest.raises(ValueError):
        near_dup.near_duplicates(spark.createDataFrame([("x", "y")], "doc_id string, text string"))


def test_connected(spark):
    from veilspan.llm._spark import Scratch

    scratch = Scratch(spark)
    edges = [(k, k + 1) for k in range(40)] + [(100, 7), (200, 201), (201, 200), (300, 300)] + [(500, k) for k in range(501, 560)]
    got = {r.node: r.label for r in near_dup.connected(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert got == {k: 0 for k in [*range(41), 100]} | {200: 200, 201: 200} | {k: 500 for k in range(500, 560)}
    assert near_dup.connected(spark.createDataFrame([], "a long, b long"), scratch) is None


def test_suffix_lm(odd, empty, documents):
    for df, rows in ((odd, ODD), (documents, [tuple(r) for r in documents.select("doc_id", "text").collect()])):
        token = {k: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)), None] for k, (_, t) in enumerate(rows)}
        train = {k: i is not None and zlib.crc32(str(i).encode()) % 10 != 0 for k, (i, _) in enumerate(rows)}
        c = collections.Counter(w for k in token if train[k] for w in token[k])
        n, v = sum(c.values()), len(c)
        want = collections.Counter()
        for k, (i, _) in enumerate(rows):
            base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in token[k])
            want[(i, not train[k], len(token[k]), sum(c[w] > 0 for w in token[k]), n, f"{base:.6g}")] += 1
        out = suffix_lm.score(df, training=F.crc32(F.col("doc_id").cast("string")) % 10 != 0).collect()
        assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.6g}") for r in out) == want
        assert all(r.score < 0 for r in out)
    assert suffix_lm.score(empty).count() == 0


def test_suffix_lm_keeps_rare_contexts_of_a_large_corpus(spark):
    pick = np.random.default_rng(9)
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(k, " ".join(words[x] for x in pick.integers(0, 5, 6_000))) for k in range(90)]  # 3 million symbols
    rows += [(1000 + k, "qzxjvkw") for k in range(9)]
    df = frame(spark, rows).repartition(4)
    out = {r.doc_id: r.score for r in suffix_lm.score(df).collect()}
    assert out[1000] > -14  # without the contexts of "qzxj..", each of its letters costs 5 and more
    parted = {r.doc_id: r.score for r in suffix_lm.score(df, most=50).collect()}
    assert parted.keys() == out.keys() and all(abs(parted[i] - out[i]) < 1e-6 * abs(out[i]) for i in out)


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>"), (1, "http://a/", "<p>x</p>"), (2, None, None), (None, "u", ""), (3, "http://b/\r\nWARC-Type: x", "<p>" + "y " * 50_000)], "page_id long, url string, html string").withColumn("record", F.lit("clash")).withColumn("title", F.lit(1))
    out = warc.derivatives(warc.responses(pages)).collect()
    assert len(out) == 10 and {r.warc_type for r in out} == {"metadata", "conversion"}
    for r in out:
        (headers, block), *rest = warc.records(bytes(r.record))
        assert not rest and dict(headers)["WARC-Record-ID"] == r.record_id and warc.digest(block) == r.block_digest and dict(headers)["WARC-Refers-To"] == r.refers_to
    assert warc.derivatives(warc.responses(pages.limit(0))).count() == 0


def test_pipeline(spark, tmp_path, documents, sf_dir):
    kept = documents
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, sf_dir)
        assert after.columns == documents.columns
        path = str(tmp_path / stage.__name__)
        after.write.parquet(path)
        assert spark.read.parquet(path).join(kept, "doc_id", "left_anti").count() == 0
        kept = spark.read.parquet(path)
    classes = near_dup.near_duplicates(kept)
    assert classes.where("doc_id <> class_id").count() == 0
    out = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in kept.select("doc_id").collect()}
    from veilspan.llm._tokens import load

    check_packed([tuple(r) for r in kept.select("doc_id", "text").collect()], out.collect(), load(WORD))


def test_pipeline_stages_on_odd_and_empty_tables(spark, odd, empty, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0
        out = stage(spark, odd, sf_dir)
        if name != "packing":
            assert out.columns == odd.columns and out.count() > 0
