"""The kernels against the libraries and plain versions of themselves."""

import collections
import math
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from veilspan.llm import _text, _tokens, bpe, fingerprints, knn, license_scan, near_dup, quality, suffix_lm, toxicity, warc

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LETTERS = list(" \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　'''stredvmlSTL!!.,<|>ab12éßÀÅñжİſ漢😀́\x00½²ĲŁ") + ["<|endoftext|>", "<|startoftext|>", "'s", "'LL", "  ", " '"]


def texts(seed, n=4000, most=30):
    pick = random.Random(seed)
    return ["".join(pick.choice(LETTERS) for _ in range(pick.randint(0, most))) for _ in range(n)]


def test_words_and_hashes():
    given = ["Ab, ab 9é", "", "ab", "é9", None]
    (_, _, block), *_ = _text.blocks(pa.array(given))
    words = block.words()
    assert words.per_text.tolist() == [3, 0, 1, 1, 0]
    h = words.hashes()
    assert h[0] == h[1] == h[3] != h[2]
    assert words.hashes(fold=False)[0] != words.hashes(fold=False)[1]


def test_shingles_of_short_and_long_texts():
    (_, _, block), *_ = _text.blocks(pa.array(["a b", "", "a b c d e f", "A  B"]))
    runs, number = block.words().shingles(5)
    assert number.tolist() == [1, 0, 2, 1]
    assert runs[0] == runs[3] and len(set(runs.tolist())) == 3


def test_word_encoder_equals_the_library():
    own = _tokens.WordEncoder(WORD)
    given = texts(1) + [f"a{chr(c)}b {chr(c)}'s {chr(c)}{chr(c)}1" for c in range(0x3000)]
    found = [x for _, _, b in _text.blocks(pa.array(given), _tokens.BLOCK) for x in own.encode(b)]
    assert [np.frombuffer(x, own.dtype).tolist() for x in found] == [e.ids for e in own.tokenizer.encode_batch(given, add_special_tokens=False)]


def test_byte_codec_equals_the_library():
    own = bpe.Codec(BYTE)
    given = texts(2, 8000)
    found = [x.tolist() for _, _, b in _text.blocks(pa.array(given)) for x in own.encode(b)]
    library = own.tokenizer
    assert found == [e.ids for e in library.encode_batch(given, add_special_tokens=False)]
    assert [own.decode(x) for x in found] == given
    pick = random.Random(3)
    odd = [[pick.randrange(50257) for _ in range(8)] for _ in range(1000)]
    assert [own.decode(x) for x in odd] == [library.decode(x, skip_special_tokens=False) for x in odd]
    assert own.decode([10**6, 64]) == own.decode([64])


def weighted(text):
    import re

    w = re.findall(rb"[0-9a-z\x80-\xff]+", text.encode().lower())
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def jaccard(a, b):
    a, b = weighted(a), weighted(b)
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def copies(seed, n):
    pick = random.Random(seed)
    words = ["w%d" % k for k in range(60)]
    out = []
    for _ in range(n):
        a = [pick.choice(words) for _ in range(pick.randint(8, 200))]
        a += a[:20] * pick.randint(0, 2)
        b = list(a)
        for _ in range(pick.randint(0, 12)):
            b[pick.randrange(len(b))] = pick.choice(words)
        out.append((" ".join(a), " ".join(b)))
    return out


@pytest.mark.parametrize("kind", ["cws", "darts"])
def test_collision_rate_is_generalised_jaccard(kind):
    error = []
    for a, b in copies(5, 150):
        if kind == "cws":
            x, y = fingerprints.sketch(pa.array([a, b]))
        else:
            (_, _, block), *_ = _text.blocks(pa.array([a, b]))
            t, e, w = fingerprints.weighted_terms(block.words())
            x, y = near_dup.darts(t, e, w.astype(float), 2, 128)
        error.append((x == y).mean() - jaccard(a, b))
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.09


def test_darts_with_real_weights_and_empty_sets():
    rng = np.random.default_rng(7)
    terms, k = rng.integers(0, 2**63, 60).astype(np.uint64), 512
    a, b = rng.random(60) * 3 + 0.01, rng.random(60) * 3 + 0.01
    got = near_dup.darts(np.repeat([0, 2], 60), np.concatenate([terms, terms]), np.concatenate([a, b]), 3, k)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((got[0] == got[2]).mean() - want) < 0.08
    assert (got[1] == 0).all()


def test_exact_similarities():
    given = [x for pair in copies(9, 12) for x in pair] + ["", "a b"]
    sets = near_dup.units(pa.array(given), 5)
    found = near_dup.similarities(sets)
    for i, a in enumerate(given):
        for j, b in enumerate(given):
            want = jaccard(a, b) if weighted(a) or weighted(b) else 1.0
            assert abs(found[i, j] - want) < 1e-9
            if want >= 0.5:
                assert abs(near_dup.similarity(sets[i], sets[j]) - want) < 1e-9


def test_automaton():
    t = license_scan.Template
    auto = license_scan.Automaton([t("a", "a", 'x <<beginOptional>> y <<beginOptional>> z <<endOptional>> <<endOptional>> w'), t("b", "b", 'x <<var;name="v";match="[0-9]+";words="1-2">> end'), t("c", "c", 'x <<var;name="o";words="0-2">> w')])
    run = lambda s: auto.run(s.split().__getitem__, 0, len(s.split()))
    assert run("x w") == {"a": 2, "c": 2}
    assert run("x y z w") == {"a": 4, "c": 4}
    assert run("x z w") == {"c": 3}
    assert run("x 1 2 end") == {"b": 4} and run("x end") == {} and run("x 1 2 3 end") == {}
    for bad in ("<<beginOptional>> a", "a <<endOptional>>", "<<beginOptional>> a <<endOptional>>"):
        with pytest.raises(ValueError):
            license_scan.Automaton([t("d", "d", bad)])


def test_ftrl_learns_and_stays_sparse():
    pick = random.Random(4)
    rows = []
    for k in range(600):
        toxic = k % 5 == 0
        words = {pick.randrange(100, 3000) for _ in range(40)} | ({pick.choice([1, 2, 3])} if toxic else set())
        rows.append((np.array(sorted(words)), int(toxic)))
    place, weight, bias = toxicity.fit_ftrl(rows)
    top = dict(zip(place.tolist(), weight.tolist(), strict=True))
    assert bias < 0 and all(top.get(k, 0) > 1 for k in (1, 2, 3)) and len(place) < 200
    assert toxicity.fit_ftrl([]) [2] == -30.0


def plain_ftrl(rows, alpha=toxicity.ALPHA, beta=toxicity.BETA, l1=toxicity.LAMBDA1, l2=toxicity.LAMBDA2, passes=toxicity.PASSES):
    """FTRL-proximal, a coordinate at a time."""
    z, n = {}, {}

    def weight(i, bias=False):
        own = z.get(i, 0.0)
        if not bias and abs(own) <= l1:
            return 0.0
        rate = (beta + math.sqrt(n.get(i, 0.0))) / alpha
        return -own / rate if bias else -(own - math.copysign(l1, own)) / (rate + l2)

    for _ in range(passes):
        for places, y in rows:
            w = {i: weight(i, i == "bias") for i in [*places.tolist(), "bias"]}
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(w.values()))))) - y
            for i, x in w.items():
                before = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * x
                n[i] = before + g * g
    return {i: weight(i) for i in z if i != "bias" and weight(i)}, weight("bias", True)


def test_ftrl_equals_a_plain_version():
    pick = random.Random(9)
    rows = [(np.array(sorted({pick.randrange(300) for _ in range(12)} | ({301} if k % 3 == 0 else set()))), int(k % 3 == 0)) for k in range(300)]
    place, weight, bias = toxicity.fit_ftrl(rows)
    want, own = plain_ftrl(rows)
    assert place.tolist() == sorted(want) and abs(bias - own) < 1e-6
    assert all(abs(w - want[p]) < 1e-6 for p, w in zip(place.tolist(), weight.tolist(), strict=True))


def plain_tree_score(tree_rows, text):
    """Longest retained suffix, symbol by symbol."""
    counts, retained = tree_rows
    symbols = b"".join(w + b" " for w in text.encode().lower().split()) + b"\n"
    stream = b"\n" * suffix_lm.DEPTH + symbols

    def share(context):
        c = counts.get(context, {})
        n = sum(c.values())
        if not context:
            return lambda x: (c.get(x, 0) + 0.5) / (n + 128)
        longest = next(context[k:] for k in range(1, len(context) + 1) if context[k:] in retained or k == len(context))
        up = share(longest)
        return lambda x: (c.get(x, 0) + suffix_lm.BACK * up(x)) / (n + suffix_lm.BACK)

    total = 0.0
    for i in range(suffix_lm.DEPTH, len(stream)):
        past = stream[i - suffix_lm.DEPTH : i]
        context = next(past[k:] for k in range(suffix_lm.DEPTH + 1) if past[k:] in retained or k == suffix_lm.DEPTH)
        total += np.log10(share(context)(stream[i]))
    return total


def test_automaton_of_a_tree_equals_longest_suffixes():
    corpus = ["the cat the hat", "The dog", "a cat in the hat", "thé", ""] * 4
    counts = collections.defaultdict(collections.Counter)
    for t in corpus:
        s = b"\n" * suffix_lm.DEPTH + b"".join(w + b" " for w in t.encode().lower().split()) + b"\n"
        for i in range(suffix_lm.DEPTH, len(s)):
            for d in range(suffix_lm.DEPTH + 1):
                counts[s[i - d : i]][s[i]] += 1
    pick = random.Random(8)
    retained = {c for c in counts if c and sum(counts[c].values()) > 3 and pick.random() < 0.6}
    rows = [(len(c), int.from_bytes(c, "big"), x, n) for c in {*retained, b""} for x, n in counts[c].items()]
    depth, context, symbol, n = (np.array(x, np.int64) for x in zip(*rows, strict=True))
    tree = suffix_lm.Tree(context, depth, symbol, n, np.ones(len(rows), bool))
    given = [*corpus[:5], "the unseen zebra ☃", " x ", "hat " * 300]
    (_, _, block), *_ = _text.blocks(pa.array(given))
    symbols, first, tokens = suffix_lm.stream(block)
    got = tree.scores(symbols, first)
    assert tokens.tolist() == [len(t.split()) for t in given]
    for t, x in zip(given, got, strict=True):
        assert abs(x - plain_tree_score((counts, retained), t)) < 1e-3 * max(1, abs(x))


def test_http_reads_all_gzip_members():
    import gzip

    head = b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n"
    members = gzip.compress(b"<p>one</p>") + gzip.compress(b"") + gzip.compress(b"<p>two</p>")
    for tail in (b"", b"\x00\x00", b"\x1f\x8bbroken"):
        assert warc.http(head + members + tail)[3] == b"<p>one</p><p>two</p>"
    assert warc.http(head + b"plain")[3] == b""


def test_warc_round_trip():
    body = "<html><head><title>A &amp; B</title><script>var x='<p>no</p>'</script></head><body><p>One<br>two &lt;3</p><!-- c --><a href='/x?a=1&amp;b=2'>link</a></body>".encode()
    made = warc.response("http://a.example/é", body, "7")
    (headers, block), *rest = warc.records(made)
    assert not rest and dict(headers)["WARC-Payload-Digest"] == warc.digest(body) and warc.http(block)[2] == body
    meta, text = warc.derive(made)
    assert meta["refers_to"] == text["refers_to"] == dict(headers)["WARC-Record-ID"] and meta["concurrent_to"] == text["record_id"]
    (own, content), *_ = warc.records(text["record"])
    assert content.decode() == "One\ntwo <3\nlink" and dict(own)["WARC-Block-Digest"] == warc.digest(content)
    import gzip
    import json

    envelope = json.loads(list(warc.records(meta["record"]))[0][1])["Envelope"]
    page = envelope["Payload-Metadata"]["HTTP-Response-Metadata"]["HTML-Metadata"]
    assert page["Title"] == "A & B" and page["Links"] == [{"path": "A@/href", "url": "/x?a=1&b=2"}]
    assert envelope["WARC-Header-Metadata"] == [list(h) for h in headers]
    packed = gzip.compress(made) + gzip.compress(text["record"])
    assert len(list(warc.records(packed))) == 2 and [d["record_id"] for d in warc.derive(packed)] == [meta["record_id"], text["record_id"]]
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Type: text/html; charset=latin-1\r\n\r\n5\r\n<p>\xe9x\r\n0\r\n\r\n"
    (found, *_), = [list(warc.derive(warc.build([("WARC-Type", "response"), ("WARC-Record-ID", "<a>")], chunked)))[1:]]
    assert "éx" in found["record"].decode()
    assert list(warc.derive(b"junk")) == [] and list(warc.derive(b"")) == []
    assert list(warc.derive(warc.build([("WARC-Type", "response")], b"not http")))[1]["record"].endswith(b"\r\n\r\n\r\n\r\n")


def test_bounds_of_cells_hold_and_prune_clusters():
    rng = np.random.default_rng(8)
    centres = np.floor(rng.normal(size=(40, 16)) * 400)
    cell = rng.integers(0, 40, 4000)
    v = np.floor(centres[cell] + rng.normal(size=(4000, 16)) * 12)
    queries = np.arange(0, 4000, 20)
    own = [queries[cell[queries] == c] for c in range(40)]
    radius = np.array([np.sqrt(((v[q] - centres[c]) ** 2).sum(axis=1)).max(initial=0) for c, q in enumerate(own)])
    longest = np.array([np.sqrt((v[q] ** 2).sum(axis=1)).max(initial=0) for q in own])
    top = np.sort(v[queries] @ v.T, axis=1)[:, -6]
    floor = np.array([min([top[k] for k, q in enumerate(queries) if cell[q] == c], default=np.inf) for c in range(40)])
    most = knn.uppers(v, centres, radius, longest)
    for c, q in enumerate(own):
        if len(q):
            assert (v @ v[q].T <= most[:, c : c + 1]).all()
    assert (most >= floor).mean() < 0.2
    order = knn.chain(centres, list(range(40)))
    group, parts = knn.grouped(order, {c: int((cell == c).sum()) for c in range(40)}, 250)
    assert sorted(order) == list(range(40)) and set(group.values()) == set(range(len(parts))) and set(parts) == {1}
    assert knn.grouped([0, 1, 2], {0: 5, 1: 1000, 2: 5}, 100) == ({0: 0, 1: 1, 2: 2}, [1, 10, 1])
