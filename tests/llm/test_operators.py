"""The training-data operators against brute force, on odd rows and on the smallest tables."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from strandwise.llm import components, decontam, html_text, media, mixing, pii, queries, sharding, simhash, simple8b, toxicity, warc
from tests.test_oracles import rows

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, size string, position int"
ODD = [
    (1, "the cat sat on the mat and then it went away", "en", "b", 1, "x", "y", 1),
    (2, "the cat sat on the mat and then it went away", "en", "a", 1, "x", "y", 1),
    (2, "the cat sat on the mat and then it went away", "en", "a", 1, "x", "y", 1),
    (3, None, None, None, None, None, None, None),
    (None, "", "en", None, 0, None, None, None),
    (5, " \t\n", "en", "", 0, None, None, None),
    (6, "one two", "en", "", 0, None, None, None),
    (7, "word " * 30_000 + "a@b.co", "de", "\U0001f600", 0, None, None, None),
    (8, "Ünïcode £ text 4111 1111 1111 1111 and 10.0.0.1, +1 (555) 123-4567", "de", "b", 0, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def table(name):
    return duckdb.connect().execute(f"SELECT * FROM '{SMALL}/{name}.parquet'").fetchdf()


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(rows, budget=4):
    fps = [slow_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(i):
                if (fps[i] ^ fps[j]).bit_count() <= budget and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    least = {}
    for (d, _), x in zip(rows, label, strict=True):
        if d is not None:
            least[x] = min(d, least.get(x, d))
    return [(d, f"{fp:016x}", least.get(x)) for (d, _), fp, x in zip(rows, fps, label, strict=True)]


def key(row):
    return tuple((v is None, v if v is not None else 0) for v in row)


def test_near_duplicates(spark, odd, small):
    for df in (odd, small, odd.limit(0)):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = [tuple(r) for r in simhash.near_duplicates(df).collect()]
        assert sorted(got, key=key) == sorted(slow_components(rows), key=key)


def test_drop_near_duplicates(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = simhash.drop_near_duplicates(odd)
    assert got.columns == odd.columns
    classes = {c for _, _, c in slow_components(rows)}
    assert sorted(r.doc_id for r in got.collect()) == sorted(classes)
    assert simhash.drop_near_duplicates(odd.limit(0)).count() == 0


@settings(deadline=None, max_examples=30)
@given(st.integers(0, 2**32), st.integers(1, 4), st.sampled_from([3, 20000]))
def test_trie_links(seed, spread, batch):
    rng = np.random.default_rng(seed)
    fps = np.repeat(rng.integers(0, 1 << 63, 12, dtype=np.uint64), 12)
    for _ in range(spread):
        fps = fps ^ np.where(rng.random(len(fps)) < 0.8, np.uint64(1) << rng.integers(0, 64, len(fps)).astype(np.uint64), np.uint64(0))
    fps = np.unique(fps)
    groups = np.sort(rng.integers(0, 2, len(fps)))
    got = simhash.trie_links(fps, groups, 4, pair_batch=batch)
    want = np.arange(len(fps))
    a, b = np.nonzero((np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4) & (groups[:, None] == groups[None, :]))
    assert (got == simhash._merge(want, a, b)).all()


def test_links_of_a_hot_bucket(spark):
    """All fingerprints share most bits, so buckets are dealt into chunk pairs; components stay whole."""
    rng = np.random.default_rng(3)
    fps = np.unique(np.uint64(77 << 40) ^ (np.uint64(1) << rng.integers(0, 20, 600).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 20, 600).astype(np.uint64)) ^ (rng.integers(0, 4, 600).astype(np.uint64) << np.uint64(50)))
    df = spark.createDataFrame([(int(x.view(np.int64)),) for x in fps], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.links(df, 4, hot=50)).collect()}
    lab = simhash.trie_links(fps, np.zeros(len(fps), int), 4)
    want = len(np.unique(lab))
    got = len({roots.get(int(x.view(np.int64)), int(x.view(np.int64))) for x in fps})
    assert got == want


def test_links_split_by_further_blocks(spark):
    """A bucket over the bound whose open bits vary widely: finer blocks split it, and the links found are those of all pairs."""
    rng = np.random.default_rng(5)
    some = rng.integers(0, 1 << 51, 300, dtype=np.uint64) ^ (np.uint64(77) << np.uint64(51))
    fps = np.unique(np.concatenate([some, some ^ np.uint64(0b1011 << 30), some ^ (np.uint64(1) << np.uint64(60)), some ^ np.uint64((1 << 50) | (1 << 33) | (1 << 17) | 1), some[:9] ^ np.uint64(31)]))
    df = spark.createDataFrame([(int(x.view(np.int64)),) for x in fps], "fp long")
    roots = {r.node: r.root for r in components.components(simhash.links(df, 4, hot=100)).collect()}
    want = simhash.trie_links(fps, np.zeros(len(fps), int), 4)
    mine = [roots.get(int(x.view(np.int64)), int(x.view(np.int64))) for x in fps]
    assert len(set(mine)) == len(set(want.tolist())) == len(set(zip(mine, want.tolist(), strict=True)))
    assert all(sum(m & f == 0 for f in simhash._finer_masks(m, 4)) == 15 for m in simhash._block_masks(10, 4, 512))


def test_dropping_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 7, "x", 0)] * 3 + [(2, "a b c d e f", 8, "y", 0), (3, "other words here", None, None, None)]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, h0 int, doc string, n int"))
    assert sorted(map(tuple, got.collect())) == [(1, "a b c d e f", 7, "x", 0), (3, "other words here", None, None, None)]


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 1000 for i in range(1000, 1100)}


EMAIL, IP, CARD, PHONE = (re.compile(x) for x in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"))


def slow_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(s):
        t = [int(c) * (1 + i % 2) for i, c in enumerate(s[::-1])]
        return sum(x - 9 if x > 9 else x for x in t) % 10 == 0

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]


@settings(deadline=None, max_examples=500)
@given(st.text(alphabet="ab.@-+% 0129()\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == slow_spans(text)


def test_pii_digest(odd, small):
    for df in (odd, small, odd.limit(0)):
        want = Counter()
        for r in df.collect():
            s = slow_spans(r.text or "")
            want[(r.doc_id, *(sum(k == x for k, _, _ in s) for x in pii.KINDS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest())] += 1
        assert Counter(tuple(r)[:6] for r in pii.digest(df).collect()) == want


def test_contexts_discover_identifiers(spark):
    rows = [(i, f"please write to mail: user{i}@site{i}.example.org today") for i in range(12)] + [(50, "please write to mail: someone_at_home9 today"), (51, "some words 1234567 here")]
    got = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == "email:22:38" and got[51] == ""
    assert pii.mask("to a@b.co now", [("email", 3, 9)]) == "to <email> now" and pii.mask(None, []) is None


def test_discovered_identifiers_are_seeds(spark):
    texts = [f"please write to mail: user{i}@site{i}.example.org today" for i in range(120)]
    texts += [f"please write to mail: first_{i:03} today" for i in range(40)] + [f"you reach member first_{i:03} tonight" for i in range(40)]
    texts += [f"you reach member second_{i:03} tonight" for i in range(10)] + [f"a badge of second_{i:03} here" for i in range(10)]
    texts += [f"a badge of third_{i:03} here" for i in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = Counter(r.value.split("_")[0] for r in pii.bootstrap(pii.scan(df)).collect())
    assert got == {"first": 40, "second": 10, "third": 2}
    assert {r.doc_id for r in pii.digest(df).collect() if r.spans} == set(range(len(texts)))


def test_hidden_seeds_come_back(spark):
    """Of three tenths of the seeds of the documents, taken away, all of some kinds come back, and none as another kind; without rounds nothing is added."""
    scanned = pii.scan(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))
    everything, hidden = pii.known(scanned), "pmod(xxhash64(value), 10) < 3"
    truth = {r.value: r.kind for r in everything.filter("seed").collect()}
    away = {r.value for r in everything.filter("seed").filter(hidden).collect()}
    back = {r.value: r.kind for r in pii.bootstrap(scanned, hidden=hidden).collect()}
    for kind in ("email", "ip", "phone"):
        mine = {v for v in away if truth[v] == kind}
        assert len(mine) > 30 and len(mine & {v for v, k in back.items() if k == kind}) >= 0.9 * len(mine)
    seen = [v for v in back if v in truth]
    assert sum(back[v] == truth[v] for v in seen) >= 0.98 * len(seen)
    assert everything.filter("not seed").count() > 20 and pii.known(scanned, rounds=0).filter("not seed").count() == 0


def test_plain_numbers_stay(spark):
    """Numbers of a shape that few seeds have, and other words with digits, aren't taken for identifiers."""
    texts = [f"pay with {4000000000000000 + x} now" for x in range(0, 400) if pii.luhn(str(4000000000000000 + x))] + [f"order {7000000000000000 + 37 * x} shipped" for x in range(300)] + [f"version v{x}.2 of 2024-01-{x % 28 + 1:02}" for x in range(100)]
    texts += ["ip 1.2.3.400 or a@b", None, "", "x" * 200_000 + " 4000000000000002"]
    got = pii.bootstrap(pii.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert got == []


def test_contexts_take_whole_words():
    text = "a" * 300 + " " + "b" * 200 + " 10.0.0.1 " + "c" * 400 + " d"
    got = pii.contexts(text, 502, 510)
    assert f"w{'a' * 300} {'b' * 200} _" in got and f"r0.0.0.0 {'c' * 400}" in got and "s00.0.0.0" in got
    assert pii.contexts("x@y.z,10.0.0.1", 6, 14, 5) == ["s00.0.0.0", "s~0.0.0.0", "s,_00.0.0.0", "l, 0.0.0.0", "r0.0.0.0 $", "w<> , _", "b, _ $"]


def test_candidates_span_digit_groups(spark):
    words = lambda t: [t[a:b] for a, b in pii.candidates(t, [])]
    assert words("call (017) 555-7713, or 4000 0000 0000 0001.") == ["(017) 555-7713", "555-7713", "4000 0000 0000 0001"]
    assert words("(017 555 7713) 12 3") == ["(017 555 7713) 12 3"] and words("(017 555 7713") == ["017 555 7713"] and words("a1 2 3b") == [] and words("1" * 50_000) == ["1" * 50_000]
    texts = [f"please call +1 (743) 555-{i:04} now" for i in range(40)] + ["please call (017) 555-7713 now"]
    got = {r.doc_id: r.spans for r in pii.digest(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[40] == "phone:12:26"


def test_every_pass_has_its_position(spark):
    rows = [(i, "a b c d", "a") for i in range(40)] + [(100 + i, "a b c d", "c") for i in range(40)] + [(200 + i, "a b c d", "b") for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    mine = [r for r in got if r.doc_id < 100]
    assert {(r.source_size, r.target, r.copies) for r in mine} == {(160, 480.0, 3)}
    shares = sorted(t - 0.5 * (t * t - t) for r in mine for t in r.positions)
    assert shares == pytest.approx([k / 120 for k in range(120)])
    for r in got:
        assert r.position == (r.positions[0] if r.positions else None) and r.positions == sorted(r.positions)
        assert len(r.positions) == -(-r.taken // r.size)
    ids = [r.doc_id for r in mixing.mixed(df).collect()]
    due = sorted((t, r.doc_id) for r in got for t in r.positions[: r.copies])
    assert ids == [i for _, i in due]
    places = [k / len(ids) for k, i in enumerate(ids) if i < 100]
    assert len(places) == 120 and max(places) > 0.95 and sum(p > 0.5 for p in places) > 30


def test_mix(odd, small):
    for df, cap in ((odd, 3), (small, 3)):
        rows = mixing.mix(df).collect()
        texts = df.collect()
        assert len(rows) == len(texts)
        size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        by = Counter()
        for r in texts:
            by[r.source] += size(r.text)
        names = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        target, open_, left = {}, set(names), float(sum(by.values()))
        while open_:
            level = left / sum(weight[s] for s in open_)
            over = [s for s in open_ if level * weight[s] > cap * by[s]]
            for s in over or list(open_):
                target[s] = cap * by[s] if over else level * weight[s]
                open_.discard(s)
                left -= target[s]
        goals = sorted((by[s], round(target[s], 3)) for s in names for _ in range(sum(r.source == s for r in texts)))
        assert sorted((r.source_size, round(r.target, 3)) for r in rows) == goals
        assert all(0 <= r.taken <= cap * r.size for r in rows)
        assert abs(sum(r.taken for r in rows) - sum(target.values())) <= len(names)
        positions = [r.position for r in rows if r.position is not None]
        assert positions == sorted(positions) and all(0 <= p <= 1 for p in positions)
    again = sorted(map(tuple, mixing.mix(small.repartition(7)).collect()))
    assert again == sorted(map(tuple, mixing.mix(small).collect()))
    assert mixing.mix(odd.limit(0)).count() == 0


@settings(deadline=None, max_examples=40)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 50256), st.integers(0, 2**64 - 1)), max_size=700))
def test_simple8b_round_trip(ids):
    x = np.array(ids, np.uint64)
    names, counts, back = simple8b.read_segment(simple8b.write_segment([None, 3], [len(ids), 0], x))
    assert names == [None, 3] and counts.tolist() == [len(ids), 0] and (back == x).all()


@pytest.fixture(scope="module")
def tokenizer():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    return path, tokenizers.Tokenizer.from_file(path)


@settings(deadline=None, max_examples=60)
@given(texts=st.lists(st.text(alphabet="aBé 9.,\n\t '<|endoftext|>", max_size=30), min_size=1, max_size=5))
def test_encoder_equals_the_library(tokenizer, texts):
    with open(tokenizer[0], encoding="utf-8") as f:
        encoder = simple8b._encoder(f.read())
    got = encoder.encode(pa.array(texts, pa.string()))
    assert [g.tolist() for g in got] == [tokenizer[1].encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files(odd, small, tokenizer):
    for df in (odd, small, odd.limit(0)):
        rows = sorted(((r.doc_id, r.text or "") for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        want, at = Counter(), 0
        for d, t in rows:
            ids = np.array(tokenizer[1].encode(t, add_special_tokens=False).ids + [2], "<u4")
            want[(d, at, len(ids), zlib.crc32(ids.tobytes()))] += 1
            at += len(ids)
        assert Counter(tuple(r)[:4] for r in simple8b.round_trip(df, tokenizer[0]).collect()) == want


def test_toxicity(spark, small, odd):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.train(small, labels)
    rows = {r.doc_id: r for r in toxicity.score(small, model).collect()}
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for d, r in rows.items())
    mine = {r.doc_id: r.text for r in small.collect()}
    assert all(abs(model.score(mine[d]) - r.score) < 1e-12 for d, r in rows.items())
    known = [(r.toxic, rows[r.doc_id].predicted) for r in labels.collect() if not rows[r.doc_id].held_out]
    assert sum(a == b for a, b in known) / len(known) > 0.9
    assert toxicity.score(odd, model).count() == len(ODD) and toxicity.score(odd.limit(0), model).count() == 0
    nothing = toxicity.train(small, labels.limit(0))
    assert {r.predicted for r in toxicity.score(odd, nothing).collect()} == {0}
    assert toxicity.drop_toxic(odd, nothing).columns == odd.columns


def slow_grams(text):
    raw = b" " + "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode() + b" "
    out = set()
    for n in (4, 5, 6):
        for i in range(len(raw) - n + 1):
            h = n
            for b in raw[i : i + n]:
                h = (h * 0x01000193 & 0xFFFFFFFF) ^ b
            out.add((h * 0x9E3779B1 & 0xFFFFFFFF) >> 12)
    return out


def test_toxicity_equals_brute_force(spark):
    """Ratios and weights recomputed with dicts, in the order of training; an id that occurs twice is one row of the sample, and its bound holds."""
    words = "you are nice kind awful rotten table chair green".split()
    texts = {i: " ".join(words[(i * 7 + j * j * (1 + i % 3)) % 9] for j in range(8)) for i in range(60)}
    labels = {i: int("awful" in texts[i]) for i in texts if i % 7}
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()] * 3 + [(None, None, "x"), (99, None, "x")], "doc_id long, text string, id string")
    marks = spark.createDataFrame([(i, y) for i, y in labels.items()] + [(None, 1), (5, None), (1000, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    train = [i for i in labels if zlib.crc32(str(i).encode()) % 5]
    grams = {i: slow_grams(texts[i]) for i in texts}
    n = Counter(labels[i] for i in train)
    seen = [Counter(g for i in train if labels[i] == y for g in grams[i]) for y in (0, 1)]
    ratio = {g: np.log((seen[1][g] + 0.5) / (n[1] + 1)) - np.log((seen[0][g] + 0.5) / (n[0] + 1)) for g in seen[0] | seen[1]}
    zz = {g: r * r / (1 / (seen[1][g] + 0.5) + 1 / (seen[0][g] + 0.5)) for g, r in ratio.items()}
    ratio = {g: r * (zz[g] / (zz[g] + 10)) ** 4 for g, r in ratio.items()}
    F = toxicity.F
    keys = spark.createDataFrame([(i, e) for i in train for e in range(1, 7)], "id long, epoch int")
    order = [(r.id, labels[r.id]) for r in keys.orderBy("epoch", F.xxhash64(F.lit("fit"), "epoch", "id"), "id").collect()]
    w, squares, bias, bias_squares = Counter(), Counter(), 0.0, 1e-8
    for i, y in order:
        norm = sum(ratio[g] ** 2 for g in grams[i]) ** 0.5 + 1e-9
        z = sum(w[g] * ratio[g] / norm for g in grams[i]) + bias
        err = (1 / (1 + np.exp(-z)) - y) * len(train) / 2 / n[y]
        for g in grams[i]:
            squares[g] += (err * ratio[g] / norm) ** 2
            w[g] -= 0.5 * err * ratio[g] / norm / (squares[g] + 1e-8) ** 0.5
        bias_squares += err * err
        bias -= 0.5 * err / bias_squares**0.5
    want = {}
    for i in texts:
        known = [g for g in grams[i] if g in ratio]
        z = sum(w[g] * ratio[g] for g in known) / (sum(ratio[g] ** 2 for g in known) ** 0.5 + 1e-9) + bias
        want[i] = 1 / (1 + np.exp(-z))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all(abs(got[i] - want[i]) < 1e-6 for i in texts) and got[99] == got[None] == pytest.approx(1 / (1 + np.exp(-bias)))
    few = toxicity.train(docs, marks, max_rows=1)
    assert few.weight.any() and toxicity.train(docs.limit(0), marks).bias < 0


def test_toxicity_ignores_held_out_labels(spark, small):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    flipped = labels.withColumn("toxic", toxicity.F.when(toxicity.fold() == 0, 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    a, b = toxicity.train(small, labels), toxicity.train(small, flipped)
    assert (a.weight == b.weight).all() and a.bias == b.bias


def test_toxicity_generalises(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.score(docs, toxicity.train(docs, labels)).filter("held_out").join(labels, "doc_id").select("toxic", "predicted").collect()
    hits = sum(r.toxic and r.predicted for r in rows)
    assert hits / sum(r.toxic for r in rows) > 0.85 and hits / sum(r.predicted for r in rows) > 0.85


WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def slow_hits(text, items):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    words, hit, names = WORD.findall(low(text)), set(), set()
    for name, t in items:
        w = WORD.findall(low(t))
        k = min(13, len(w))
        grams = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1 if k else 0):
            if tuple(words[i : i + k]) in grams:
                hit |= set(range(i, i + k))
                names.add(str(name))
    return len(words), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("limit", [2_000_000, 150])
def test_contamination(spark, odd, small, limit):
    items = [(1, "It went away"), (10, "the Cat sat on the mat and then it went"), (2, None), (3, "!!"), (None, "unicode text é")] + [(r.item_id, r.text) for r in table("benchmark").itertuples()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [("null" if i is None else i, t) for i, t in items]
    for df in (odd, small.limit(60), odd.limit(0)):
        judged = decontam.judge(decontam.find_hits(df, bench, max_windows=limit)).collect()
        got = Counter((r.id, r.n_words, r.n_hit, r.n_items, decontam.items_digest(r["items"]), r.contaminated) for r in judged)
        assert got == Counter((r.doc_id, *slow_hits(r.text, named)) for r in df.collect())
    assert (len(decontam._slices(bench, 13, limit)) > 1) == (limit == 150)
    odd = odd.withColumn("row", odd["size"]).withColumn("_row", odd["id"]).withColumn("doc", odd["lang"])
    kept = decontam.remove_contaminated(odd, bench, max_windows=limit)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in odd.collect() if not slow_hits(r.text, named)[-1])
    assert decontam.remove_contaminated(odd, bench.limit(0)).count() == len(ODD)


def test_an_item_over_the_bound_is_cut(spark):
    long = " ".join(f"w{i * i % 97}" for i in range(400))
    bench = spark.createDataFrame([(1, long), (2, "short item")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " * 5 + " ".join(long.split()[180:240])), (2, "a Short ITEM"), (3, long)], "doc_id long, text string")
    whole, cut = (sorted(map(tuple, decontam.contamination(docs, bench).collect())), decontam.judge(decontam.find_hits(docs, bench, max_windows=40)))
    assert sorted((r.id, r.n_words, r.n_hit, r.n_items, decontam.items_digest(r["items"]), r.contaminated) for r in cut.collect()) == whole
    assert max(sum(max(1, len(r.text.split()) - 12) for r in part.collect()) for part in decontam._slices(bench, 13, 40)) <= 80


def test_remove_spans():
    assert decontam.remove_spans("One, two; THREE four.", [(1, 3)]) == "One, four." and decontam.remove_spans(None, [(0, 1)]) is None


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><header><h1>A &amp; B</h1></header><p>First&nbsp; <b>bold</b>
text.<br>Next</p><div class="ad">Buy</div><p>Be.</p><form><input>Search</form><ul><li>one</li><li>two</li></ul></article><aside>Side</aside><div id="comments"><p>Nice!</p></div><footer>&copy;</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "A & B\n\nFirst bold text. Next\n\nBe.\n\none\n\ntwo"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x") == ""
    assert html_text.main_text("plain &lt;text&gt;") == "plain <text>"
    body = "<p>" + "Long sentences make the text surge here. " * 5 + "</p>"
    assert html_text.main_text(f"<ul><li><a href=a>x</a></li><li><a href=b>y</a></li></ul>{body}<p>Short.</p>{body}<div class=sidebar>{body}</div>").count("\n\n") == 2
    for bad in ("<" * 50_000, "<a " * 50_000, '<a href="' * 30_000, "<nav>" * 20_000, "<!--" * 20_000, "<script>" * 20_000):
        html_text.main_text(bad)


LONG = "Long sentences make the text surge here, and surge again. " * 3


def test_line_blocks_decide():
    """Without article elements the sums find the text; within one a run of links ends it; markup alone would do neither."""
    menu = "".join(f"<div><a href=/{i}>Entry number {i} of a long menu of links</a></div>" for i in range(6))
    page = f"{menu}<p>Intro</p><p>{LONG}</p><p>Yes.</p><p>{LONG}</p>{menu}<div>Imprint</div>"
    assert html_text.main_text(page).split("\n\n") == ["Intro", LONG.strip(), "Yes.", LONG.strip()]
    inside = f"<div>Buy now, only today</div><article><h1>Head</h1><p>{LONG}</p><p><a href=x>One link</a></p><p>End.</p>{menu}<p>More</p></article><div>Offers of our partners</div>"
    assert html_text.main_text(inside).split("\n\n") == ["Head", LONG.strip(), "One link", "End."]
    assert len([1 for _, _, cue in html_text.lines(inside) if cue == "article"]) == 11
    assert html_text.main_text(f"<article><p>Short.</p></article><p>{LONG * 3}</p>").startswith("Short.")
    assert html_text.main_text("<nav>a long menu of many words</nav><footer>and a long footer, too</footer>") == ""
    assert html_text.main_text("<p>Ok</p>") == "Ok" and html_text.main_text(menu) == ""


def test_line_blocks_change_the_pages(spark):
    for p in table("pages").itertuples():
        every = "\n\n".join(text for text, _, _ in html_text.lines(p.html))
        assert html_text.main_text(p.html) != every


def test_extract_pages(spark):
    pages = table("pages")
    got = {r.page_id: r for r in html_text.extract(spark.read.parquet(f"{SMALL}/pages.parquet")).collect()}
    import html as h

    for p in pages.itertuples():
        body = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        blocks = [" ".join(h.unescape(re.sub(r"<[^>]+>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        want = "\n\n".join(x for x in blocks if x)
        assert got[p.page_id].text == want and got[p.page_id].n_chars == len(want) and got[p.page_id].url == p.url
    odd = spark.createDataFrame([(1, None, None, 5), (1, "u", "", None), (None, "u", "x", 1)], "page_id long, url string, html string, text int")
    assert sorted(r.text for r in html_text.extract(odd).collect()) == ["", "", "x"]
    assert html_text.extract(odd.limit(0)).count() == 0 and html_text.extract(odd.union(odd)).count() == 6


def test_archives(spark):
    rows = [(1, "http://a.com/x", "hi"), (2, "http://B.com:80/y?q#f", "hi"), (3, None, None), (4, "u v", ""), (None, "http://a.com/x", "hi"), (7, "http://a.com/z", "é"), (7, "http://a.com/z", "é"), (8, "c", "<p>" * 100_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    last = {}
    for d, _, h in rows:
        if d is not None:
            last[h or ""] = max(d, last.get(h or "", d))
    want = Counter((d, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), "response" if d == last[h or ""] else "revisit", None if d == last[h or ""] else last[h or ""]) for d, _, h in rows)
    assert Counter(map(tuple, warc.round_trip(pages).collect())) == want
    assert warc.round_trip(pages.limit(0)).count() == 0
    captures = warc.write(pages, archive_bytes=200)
    blocks = warc.index(captures, lines_per_block=2)
    assert blocks.count() > 2 and captures.select("archive").distinct().count() > 2
    asked = spark.createDataFrame([("http://a.com/x",), ("http://b.com/y?q",), ("http://none.com/",), ("http://b.com/y?q",)], "url string")
    found = warc.lookup(blocks, asked).collect()
    assert sorted((r.id is None, r.id, r.record_type, bytes(r.payload or b"")) for r in found) == [(False, 1, "revisit", b""), (False, 2, "response", b"hi"), (True, None, "revisit", b"")]
    assert {r.id for r in warc.lookup(blocks, spark.createDataFrame([(None,)], "url string")).collect()} == {3}
    with open(captures.first().archive.removeprefix("file:"), "rb") as f:
        own = {(r.key, r.offset, r.length, r.kind) for r in captures.filter(captures.archive == captures.first().archive).collect()}
        assert set(warc.captures_of(f.read())) == own
    joined = Counter(tuple(r) for r in warc.packed(pages, max_broadcast=0).select("id", "url", "size", "refers_to", "member").collect())
    assert joined == Counter(tuple(r) for r in warc.packed(pages).select("id", "url", "size", "refers_to", "member").collect())
    assert warc.index(captures, lines_per_block=1, max_blocks=2).agg({"lines": "max"}).first()[0] > 1  # in place of more blocks
    clash = pages.withColumn("key", pages.url).withColumn("sha", pages.page_id).withColumn("id", pages.url).withColumn("data", pages.url)
    assert Counter(map(tuple, warc.round_trip(clash).collect())) == want
    assert warc.url_key("https://www.B.com:443/P?a=1#f") == "com,b,www)/p?a=1" and warc.url_key(None) == "-"
    none = warc.packed(pages, least_bytes=1).filter("size = 0 and refers_to is not null").count()
    assert none == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    assert rows(queries.QUERIES[name](spark, SMALL).toPandas()) == rows(db.execute(queries.ORACLE_SQL[name]).fetchdf())


def test_rows_repeated_very_often(spark):
    """Half of all rows are one row: every copy is numbered by itself."""
    df = spark.createDataFrame([(7, "a b c", "s")] * 3000 + [(i, f"w{i} x", "s") for i in range(3000)], "doc_id long, text string, source string")
    rows = sharding.shard_rows(df, sharding.layout(16)).collect()
    for shard in {r.shard for r in rows}:
        mine = sorted(r.slot for r in rows if r.shard == shard)
        assert mine == list(range(len(mine)))
    same = [r.slot for r in rows if r.doc_id == 7 and r.size == 6]
    assert len(same) == len(set(same)) == 3000
    mix = mixing.mix(df).collect()
    assert len(mix) == 6000 and sum(r.taken for r in mix) == 15000 == mix[0].target
    ends = sorted(p for r in mix for p in r.positions)
    assert len(set(ends)) == 6000 and max(ends) < 1


def test_small_trees_are_refused():
    with pytest.raises(ValueError):
        sharding.layout(12)
    assert len(sharding.layout(12, base=8)) == 12


def test_shards(odd, small, spark):
    for df in (odd, small, odd.limit(0)):
        rows = sharding.shard_rows(df, sharding.layout(16), sharding.layout(17)).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in df.collect())
        assert all(r.grown_shard in (r.shard, 16) and 0 <= r.shard < 16 and r.law == "key" for r in rows)
        slots = {}
        for r in rows:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    ids = spark.range(8000).withColumnRenamed("id", "doc_id")
    place = lambda tree: {r.doc_id: r.s for r in ids.select("doc_id", sharding.place(sharding.F.col("doc_id"), tree).alias("s")).collect()}
    a = place(sharding.layout(16))
    assert all(380 < c < 630 for c in Counter(a.values()).values())
    heavier = [sharding.Leaf(x.region, x.rack, x.shard, 3.0 if x.shard == 0 else 1.0) for x in sharding.layout(16)]
    b = place(heavier)
    near = {x.shard for x in sharding.layout(16) if x.region == "r0"}
    assert all(b[i] in near for i in a if a[i] != b[i]) and Counter(b.values())[0] > 2 * Counter(a.values())[0]
    gone = [x for x in sharding.layout(17) if x.shard != 16]
    assert place(gone) == a


@settings(deadline=None, max_examples=25)
@given(st.integers(1, 40), st.integers(1, 70), st.booleans(), st.integers(0, 2**32))
def test_png_round_trip(height, width, colour, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 256, (height, width, 3) if colour else (height, width), dtype=np.uint8)
    if seed % 2:
        x = np.cumsum(x // 64, axis=0, dtype=np.uint8)
    blob = media.encode_png(x)
    assert (media.decode_png(blob) == x).all()
    with pytest.raises(media.PngError):
        media.decode_png(blob[:40] + bytes([blob[40] ^ 1]) + blob[41:])
    with pytest.raises(media.PngError):
        media.decode_png(blob[:-5])


def test_png_average_and_paeth():
    import struct

    rng = np.random.default_rng(1)
    x = rng.integers(0, 256, (6, 9), dtype=np.uint8).astype(int)
    lines = []
    for y in range(6):
        kind = 3 + y % 2
        row = [kind]
        for i in range(9):
            a, b, c = (x[y][i - 1] if i else 0), (x[y - 1][i] if y else 0), (x[y - 1][i - 1] if y and i else 0)
            p = a + b - c
            best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((x[y][i] - ((a + b) // 2 if kind == 3 else best)) % 256)
        lines.append(bytes(int(v) for v in row))
    head = struct.pack(">IIBBBBB", 9, 6, 8, 0, 0, 0, 0)
    blob = media.MAGIC + media._chunk(b"IHDR", head) + media._chunk(b"tEXt", b"x") + media._chunk(b"IDAT", zlib.compress(b"".join(lines))) + media._chunk(b"IEND", b"")
    assert (media.decode_png(blob) == x).all()


def test_media(odd, small):
    for df in (odd, small, odd.limit(0)):
        want = Counter()
        for r in df.collect():
            raw = (r.text or "").encode()
            full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
            want[(r.doc_id, len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))] += 1
        rows = media.media_features(df).collect()
        assert Counter(tuple(r)[:5] for r in rows) == want
        same = {}
        for r in rows:
            assert same.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)


def test_cosine_hash_is_of_low_frequencies():
    smooth = np.kron(np.random.default_rng(7).integers(20, 230, (8, 8), dtype=np.uint8), np.ones((8, 8), np.uint8))  # energy in all low terms
    noisy = smooth + np.random.default_rng(0).integers(0, 4, smooth.shape, dtype=np.uint8)
    other = np.random.default_rng(1).integers(0, 256, smooth.shape, dtype=np.uint8)
    bits = lambda b: int.from_bytes(b, "big")
    h = [bits(media.cosine_hash(i)) for i in (smooth, noisy, other)]
    assert (h[0] ^ h[1]).bit_count() < 16 < (h[0] ^ h[2]).bit_count()


@pytest.mark.parametrize("height", [1, 5, 32, 100])
def test_cosine_hash_equals_a_direct_transform(height):
    x = np.random.default_rng(height).integers(0, 256, (height, 64), dtype=np.uint8)

    def cell(k, n):
        a, b = k * n // 32, (k + 1) * n // 32
        return range(a, b) if n >= 32 else [a]

    grid = [[np.mean([float(x[i, j]) for i in cell(r, height) for j in cell(c, 64)]) for c in range(32)] for r in range(32)]
    terms = []
    for u in range(8):
        for v in range(8):
            terms.append(round(sum(grid[r][c] * np.cos(np.pi * (2 * r + 1) * u / 64) * np.cos(np.pi * (2 * c + 1) * v / 64) for r in range(32) for c in range(32)), 6))
    middle = np.median(terms[1:])
    direct = "".join("1" if t > middle else "0" for t in terms)
    got = f"{int.from_bytes(media.cosine_hash(x), 'big'):064b}"
    unsure = [i for i, t in enumerate(terms) if abs(t - middle) < 1e-5]
    assert all(got[i] == direct[i] for i in range(64) if i not in unsure)


def test_media_takes_clashing_columns(spark):
    df = spark.createDataFrame([(1, "text", 5, "x", 2.0), (1, "text", 6, "y", None)], "doc_id long, text string, id int, media string, n_bytes double")
    rows = media.media_features(df).collect()
    assert len(rows) == 2 and {(r.doc_id, r.n_bytes, r.payload_bytes) for r in rows} == {(1, 4, 64)}


def test_shards_equal_brute_force(spark):
    """The descent recomputed in Python: XXH64 of node and key, exponential draws, the smallest wins."""
    import math

    def draw(key, node, weight):
        h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), xxhash.xxh64_intdigest(node.encode(), 42))
        h -= (h >> 63) << 64
        return -math.log(((h >> 11) + 2.0**52 + 0.5) / 2.0**53) / weight

    def descend(key, leaves, path, names):
        if not names:
            return leaves[0].shard
        groups = {}
        for leaf in leaves:
            groups.setdefault(str(getattr(leaf, names[0])), []).append(leaf)
        best = min(groups, key=lambda g: draw(key, f"{path}/{g}", sum(x.weight for x in groups[g]))) if len(groups) > 1 else next(iter(groups))
        return descend(key, groups[best], f"{path}/{best}", names[1:])

    docs = spark.range(-50, 2000).select(sharding.F.col("id").alias("doc_id"), sharding.F.lit("t").alias("text"))
    for r in sharding.shard_rows(docs, sharding.layout(16), sharding.layout(17)).collect():
        assert r.shard == descend(r.doc_id, sharding.layout(16), "", ("region", "rack", "shard"))
        assert r.grown_shard == descend(r.doc_id, sharding.layout(17), "", ("region", "rack", "shard"))
