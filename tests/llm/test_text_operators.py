"""Operators on documents: against plain versions, and on odd rows."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from graphweave.llm import bpe, lines, lm, mixing, quality, queries, simhash
from graphweave.llm import common as C

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
COMMON = "\n".join(["the very same line"] * 3)


def odd_rows(n=12):
    """Nulls in every column, empty and long texts, ties, equal rows."""
    rows = [(i, f"Own words {i} and more of them\nThe same line\n  tHe SAME line \t\n\n", "en", f"s{i % 4}", 10) for i in range(n)]
    rows += [(100, None, None, None, None), (101, "", "en", "s0", 0), (102, " \t\n\r ", "en", "s1", 4), (None, "no id at all here", "en", "s1", 9), (None, None, None, None, None)]
    rows += [(103, "word " * 30000 + "é ü", "de", "s2", 1), (104, "x" * 50000, "de", "s2", 1), (105, "dup row text", "en", None, 3), (105, "dup row text", "en", None, 3), (106, "<|endoftext|> a<|endoftext|>", "en", "", 3)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns whose names operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows(), SCHEMA)
    return df.select("*", *[F.lit(1).alias(c) for c in ("fp", "size", "mark", "uid", "h", "line", "doc", "ids", "score", "key", "_text", "_id", "_mark", "_key", "_nth", "_size", "c0")]).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


# ---------------------------------------------------------------- words


def test_word_hashes_follow_words():
    texts = ["Ab  cd\x0bé", "", "ab", " \n", "ab cd é x"]
    h, doc = C.words_of([t.encode() for t in texts])
    assert doc.tolist() == [0, 0, 0, 2, 4, 4, 4, 4]
    said = [w for t in texts for w in words(lowered(t))]
    by = defaultdict(set)
    for w, x in zip(said, h.tolist()):
        by[w].add(x)
    assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)


def test_chunks_cover_all_rows():
    import pyarrow as pa

    b = pa.RecordBatch.from_arrays([pa.array(["a" * 50, None, "", "b" * 500, "c"])], names=["t"])
    got = [(i, t) for i, t in C.chunks(b, "t", 100)]
    assert [x for _, t in got for x in t] == [b"a" * 50, b"", b"", b"b" * 500, b"c"]
    assert all(sum(len(t) for _, t in got[:k]) == i for k, (i, _) in enumerate(got))


def test_smallest_hashes_are_the_same_with_a_bound(spark):
    from pyspark.sql import functions as F

    rows = spark.range(9000).withColumn("same", F.lit(7))
    want = [r.id for r in rows.orderBy(F.xxhash64("id"), "id").limit(300).collect()]
    assert [r.id for r in C.smallest_hashes(rows, "id", 300).collect()] == want
    assert C.smallest_hashes(rows, "same", 300).count() == 300 and C.smallest_hashes(rows.limit(5), "id", 300).count() == 5


# ---------------------------------------------------------------- components


def test_components_against_union_find(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(-50, 400, (250, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in C.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    loops = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in parent if x not in loops}
    assert C.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


# ---------------------------------------------------------------- SimHash


def plain_fingerprint(text):
    w = words(lowered(text))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    """fps: list of (id, fingerprint)."""
    values = sorted({f for _, f in fps})
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= 2:
                a2, b2 = find(a), find(b)
                parent[max(a2, b2)] = min(a2, b2)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return {f: least.get(find(f)) for f in values}


def check_simhash(rows, got):
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    comp = plain_components(fps)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{f:016x}", comp[f]) for i, f in fps)


def test_simhash_on_odd_rows(docs, empty):
    check_simhash([(r[0], r[1]) for r in odd_rows()], simhash.near_duplicates(docs).collect())
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_query_on_whole_table(spark, sf):
    rows = [(r.doc_id, r.text) for r in C.table(spark, sf, "documents").select("doc_id", "text").collect()]
    check_simhash(rows, queries.op3_simhash(spark, sf).collect())


def test_simhash_links_all_pairs_within_two_bits(spark):
    rng = np.random.default_rng(2)
    base = [int(x) for x in rng.integers(0, 2**63, 40)]
    fps = {0, (1 << 64) - 1, 1 << 63} | set(base) | {b ^ 1 << int(i) ^ 1 << int(j) for b in base[:20] for i, j in rng.integers(0, 64, (3, 2))}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(x), i) for i, x in enumerate(sorted(fps))], "fp long, doc_id long")
    got = {r.fp: r.component for r in simhash.components(df).collect()}
    want = plain_components([(i, x) for i, x in enumerate(sorted(fps))])
    ours, plain = defaultdict(set), defaultdict(set)
    for x in fps:
        ours[got[signed(x)]].add(x)
        plain[want[x]].add(x)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, plain.values()))


def test_keep_one_of_each_component(docs, empty):
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    comp = plain_components([(r[0], plain_fingerprint(r[1])) for r in odd_rows()])
    kept = got.collect()
    assert Counter(plain_fingerprint(r.text) for r in kept).keys() <= comp.keys()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({c for c in comp.values() if c is not None})
    assert simhash.keep_one(empty).count() == 0


# ---------------------------------------------------------------- lines


def plain_lines(rows, least=10):
    key = lambda x: lowered(x.strip(" \t\n\x0b\x0c\r"))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            holders[key(x)].add(i)
    out = []
    for i, t in rows:
        all_of = (t or "").split("\n")
        kept = [x for x in all_of if not key(x) or len(holders[key(x)]) < least]
        out.append((i, len(all_of), len(all_of) - len(kept), "\n".join(kept)))
    return out


def test_lines_on_odd_rows(docs, empty):
    rows = [(r[0], r[1]) for r in odd_rows()]
    want = Counter((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain_lines(rows))
    assert Counter(tuple(r) for r in lines.digests(docs).collect()) == want
    assert sum(d * n for (_, _, d, _), n in want.items()) == 24
    assert lines.digests(empty).count() == 0
    dropped = lines.drop_lines(docs)
    assert dropped.columns == docs.columns
    assert Counter(r.text for r in dropped.collect()) == Counter(t for *_, t in plain_lines(rows))
    assert all(r.n_chars == len(r.text) for r in dropped.collect())


def test_lines_that_reach_over_partitions(spark):
    rows = [(i, f"hot\nown {i}\nhot" + "\nnine" * (i < 9) + "\nten" * (i < 10)) for i in range(400)]
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 37)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = {r.doc_id: (r.n_lines, r.n_dropped) for r in lines.digests(df).collect()}
        first = lines.dropped_lines(df, least_docs=2, keep_first=True).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: (3 + (i < 9) + (i < 10), 2 + (i < 10)) for i in range(400)}
    assert sum(len(r.gone) for r in first) == 799 + 8 + 9


def test_keep_bitmaps_round_trip():
    for gone in ([0], [7, 8, 9], [3, 1000], list(range(0, 5000, 7))):
        assert np.flatnonzero(lines.unpack_bits(lines.pack_bits(gone), 6000)).tolist() == gone
    assert not lines.unpack_bits(None, 5).any()


# ---------------------------------------------------------------- mixing


def plain_targets(sizes):
    """By resharing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, total, target = set(names), sum(sizes.values()), {}
    while left:
        whole = sum(weight[s] for s in left)
        rest = total - sum(target.values())
        over = [s for s in left if rest * weight[s] / whole > 3 * sizes[s]]
        if not over:
            return target | {s: rest * weight[s] / whole for s in left}
        target |= {s: 3.0 * sizes[s] for s in over}
        left -= set(over)
    return target


def check_mix(rows, got):
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len(words(t))
    target = plain_targets(sizes)
    source = defaultdict(set)
    for i, _, s in rows:
        source[i].add(s)
    taken = defaultdict(int)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len(words(t))) for i, t, _ in rows)
    for r in got:
        s = next(s for s in source[r.doc_id] if math.isclose(target[s], r.target, rel_tol=1e-9, abs_tol=1e-9) and sizes[s] == r.source_size)
        assert 0 <= r.taken <= 3 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert taken[s] == math.floor(target[s] + 0.5)


def test_mixing_on_odd_rows(docs, empty):
    from pyspark.sql import functions as F

    numbered = docs.withColumn("doc_id", F.coalesce("doc_id", F.lit(-5) - F.coalesce("n_chars", F.lit(0))))
    rows = [(r.doc_id, r.text, r.source) for r in numbered.collect()]
    got = mixing.plan(numbered).collect()
    check_mix(rows, got)
    assert sorted(map(str, got)) == sorted(map(str, mixing.plan(numbered.repartition(7)).collect()))
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_mixing_targets_reshare_until_none_is_above(spark):
    for sizes in ({"a": 1, "b": 1000, "c": 2, "d": 0}, {"a": 5, None: 7}, {"x": 0}, {f"s{i}": i**3 for i in range(9)}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        assert got == pytest.approx(plain_targets(sizes))


def test_mix_repeats_and_cuts(docs):
    plan = Counter()
    for r in mixing.plan(docs).collect():
        plan[r.doc_id] += r.taken
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = Counter()
    texts = defaultdict(set)
    for i, t, *_ in odd_rows():
        texts[i].add(t)
    partial = 0
    for r in mixed.collect():
        got[r.doc_id] += len(words(r.text))
        assert any(t and t.startswith(r.text) for t in texts[r.doc_id])
        if r.text not in texts[r.doc_id]:
            partial += 1
            assert r.n_chars == len(r.text)
    assert +plan == got and partial <= 6


# ---------------------------------------------------------------- BPE


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return t


def check_bpe(rows, got, library):
    want = Counter()
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:4] for r in got) == want


def test_bpe_on_odd_rows(spark, docs, empty, library):
    texts = ["a\x1cb\x1d c\x85d e f　", "  \n\n  x  \t y's don't'll 12 ٣٤ ½ ⅷ é́ 日本語 🎉🎉", "<|endoftext|", "\x00\x01 ��"]
    rows = [(r[0], r[1]) for r in odd_rows()] + [(500 + i, t) for i, t in enumerate(texts)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(rows[-len(texts) :], "doc_id long, text string"))
    got = bpe.round_trip(df, queries.vocabulary_path(), with_ids=True).collect()
    check_bpe(rows, got, library)
    assert all(hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest() == r.ids_sha256 for r in got)
    assert bpe.round_trip(empty, queries.vocabulary_path()).count() == 0


def test_bpe_query_on_whole_table(spark, sf, library):
    rows = [(r.doc_id, r.text) for r in C.table(spark, sf, "documents").select("doc_id", "text").collect()]
    check_bpe(rows, queries.op2_bpe(spark, sf).collect(), library)


def test_bpe_encode_then_decode(docs):
    path = queries.vocabulary_path()
    got = bpe.decode(bpe.encode(docs, path), path).select("decoded").collect()
    assert Counter(r.decoded for r in got) == Counter(t or "" for _, t, *_ in odd_rows())


def test_bpe_cache_of_any_size_gives_the_same():
    small, large = bpe.Bpe(queries.vocabulary_path(), 2), bpe.Bpe(queries.vocabulary_path())
    text = "some words and some more words, and numbers 123 123 and words " * 3
    assert small.encode(text) == large.encode(text)


# ---------------------------------------------------------------- quality


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op1_quality_nbsvm(spark, sf).collect()}
    docs = C.table(spark, sf, "documents")
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[x.doc_id].predicted, x.quality) for x in C.table(spark, sf, "labels").collect() if got[x.doc_id].held_out]
    assert len(held) > 100 and np.mean([p == q for p, q in held]) >= 0.97


def test_quality_on_odd_rows(spark, docs, empty):
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (104, 0), (3, None), (None, 1), (999, 1), (0, 1), (2, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert quality.score(empty, model).count() == 0
    none = quality.train(empty, labels)
    assert {r.predicted for r in quality.score(docs, none).collect()} == {1}
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and Counter(r.doc_id for r in kept.collect()) == Counter(r.doc_id for r in got if r.predicted)


def test_quality_features_do_not_depend_on_neighbours():
    texts = [b"One two two $$$", b"", b"| a | b |", b"ONE!! TWO!!", "é é".encode()]
    together = quality.features(texts)
    assert all((quality.features([t])[0] == f).all() for t, f in zip(texts, together))


def test_quality_fit_against_brute_force():
    """Ratios from counts, and the optimum of the dual: no step along any coordinate improves it, and the gap to the primal closes."""
    rng = np.random.default_rng(6)
    labels = rng.integers(0, 2, 80)
    rows = [np.unique(rng.choice(40, 12) + (rng.random(12) < 0.4) * 10 * y) for y in labels]
    cost, alpha = 0.7, 1.0
    m = quality.fit(rows, labels, cost=cost, alpha=alpha, epochs=4000, tolerance=1e-10)
    ratio = np.zeros(1 << quality.BITS)
    for k in range(50):
        p, q = (sum(k in r for r, y in zip(rows, labels) if y == c) for c in (1, 0))
        if p + q:
            ratio[k] = math.log((p + alpha) / ((labels == 1).sum() + 2 * alpha)) - math.log((q + alpha) / ((labels == 0).sum() + 2 * alpha))
    assert m.square == pytest.approx(ratio**2)
    x = np.zeros((80, 51))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.linalg.norm(ratio[r])
        x[i, 50] = 1  # the bias
    y = np.where(labels == 1, 1.0, -1.0)
    weight = np.append(np.divide(m.weight[:50], ratio[:50], out=np.zeros(50), where=ratio[:50] != 0), m.bias)
    primal = 0.5 * weight @ weight + cost * np.maximum(0, 1 - y * (x @ weight)).sum()
    gram, dual = (y[:, None] * x) @ (y[:, None] * x).T, np.zeros(80)
    pace = 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(20000):  # projected gradient, another way to the same optimum
        dual = np.clip(dual + pace * (1 - gram @ dual), 0, cost)
    assert primal == pytest.approx(dual.sum() - 0.5 * dual @ gram @ dual, rel=1e-5)
    assert weight == pytest.approx(x.T @ (y * dual), abs=1e-3)


def test_quality_sample_is_bounded_in_bytes(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(12), 101, 103, 105]], "doc_id long, quality int")
    whole, few = quality.train(docs, labels), quality.train(docs, labels, sample_bytes=4 * 120)
    assert 0 < (few.square > 0).sum() < (whole.square > 0).sum()
    assert (quality.train(docs, labels, sample_bytes=0).square == 0).all()


def test_word_hashes_do_not_depend_on_slices():
    text = b"".join(bytes([97 + i % 26]) * (1 + i % 9000) + b" " for i in range(0, 9000, 700))
    data, lens = np.frombuffer(text.replace(b" ", b""), np.uint8), np.array([len(w) for w in text.split()])
    assert C.hash_runs(data, lens, 1000).tolist() == C.hash_runs(data, lens).tolist() == [int(C.hash_runs(np.frombuffer(w, np.uint8), np.array([len(w)]))[0]) for w in text.split()]


def test_quality_fit_does_not_copy_the_features():
    """The driver holds a sample's features once: fitting takes vectors of 2 ** BITS numbers, whatever the sample's size."""
    import tracemalloc

    flat = np.arange(8 << 20, dtype=np.int32) % (1 << quality.BITS)
    rows = list(flat.reshape(2048, -1))
    tracemalloc.start()
    quality.fit(rows, np.arange(2048) % 2, epochs=1)
    peak = tracemalloc.get_traced_memory()[1] / (1 << 20)
    tracemalloc.stop()
    assert peak < 96


def test_quality_coordinate_descent_separates():
    rng = np.random.default_rng(0)
    rows, y = [], []
    for i in range(200):
        good = i % 2
        rows.append(np.unique(np.concatenate([rng.integers(0, 500, 20), [1000 + good]])))
        y.append(good)
    m = quality.fit(rows, np.array(y))
    side = [sum(m.weight[r]) + m.bias * 0 for r in rows]
    assert np.mean([(s > np.median(side)) == bool(g) for s, g in zip(side, y)]) > 0.95


# ---------------------------------------------------------------- language model


def check_lm_counts(rows, got):
    count, n_docs = Counter(), 0
    for i, t in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            count.update(words(lowered(t)))
            n_docs += 1
    total, distinct = sum(count.values()) + n_docs, len(count) + (n_docs > 0)
    want = []
    for i, t in rows:
        w = [count[x] for x in words(lowered(t))] + [n_docs]
        base = sum(math.log10((c + 1) / (total + distinct + 1)) for c in w)
        want.append((i, zlib.crc32(str("" if i is None else i).encode()) % 7 == 2, len(w), sum(c > 0 for c in w), total, base))
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    found = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    want.sort(key=key)
    assert [x[:5] for x in found] == [x[:5] for x in want]
    assert [x[5] for x in found] == pytest.approx([x[5] for x in want], rel=1e-7)


def test_lm_base_scores_on_odd_rows(docs, empty):
    rows = [(r[0], r[1]) for r in odd_rows()]
    for head in (lm.HEAD, 5):  # with the joined counts, too
        got = lm.score(docs, words=8, head=head).collect()
        check_lm_counts(rows, got)
        assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert lm.score(empty).count() == 0


def test_lm_query_beats_the_base_on_held_out_texts(spark, sf):
    got = queries.op5_lm(spark, sf).collect()
    check_lm_counts([(r.doc_id, r.text) for r in C.table(spark, sf, "documents").select("doc_id", "text").collect()], got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_scores_against_a_plain_evaluation(spark, docs):
    """score, token by token in plain Python from the same weights, counts by word."""
    rows = [(r[0], r[1]) for r in odd_rows()]
    fitted = lm.fit(docs, words=12, head=6)
    m, x, w = fitted[0], fitted[0].lexicon, fitted[0].weights
    count, n_docs = Counter(), 0
    for i, t in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2:
            count.update(words(lowered(t)))
            n_docs += 1
    number = {h: i for i, h in zip(x.order.tolist(), x.hashes.tolist())}

    def hash_of(word):
        return int(lm.tokens([word.encode()])[0][0])

    def softmax(scores, pick):
        return scores[pick] - math.log(sum(map(math.exp, scores)))

    rest = [[c for v, c in count.items() if hash_of(v) & 255 == s and hash_of(v) not in number] for s in range(lm.SURFACES)]
    want = []
    for i, t in rows:
        said, before, total = words(lowered(t))[:400], [x.start] * lm.CONTEXT, 0.0
        for v in [*said, None]:
            h = int(C.END) if v is None else hash_of(v)
            item = number.get(h, x.n + (h & 255))
            hidden = sum(w.r[k].astype(float) * w.c[j].astype(float) for j, k in enumerate(before))
            group = int(x.group[item])
            total += softmax((w.g[:, :-1].astype(float) @ hidden + w.g[:, -1]).tolist(), group)
            if item < x.n:
                lo, hi = x.words_of[group], x.words_of[group + 1]
                total += softmax((w.w[lo:hi, :-1].astype(float) @ hidden + w.w[lo:hi, -1]).tolist(), item - lo)
            else:
                own = rest[item - x.n]
                total += math.log((count[v] + 1) / (sum(own) + len(own) + 1))
            before = [item, *before[:-1]]
        want.append((str(i), len(said) + 1, total / math.log(10)))
    cut = docs.withColumn("text", F.array_join(F.slice(F.regexp_extract_all("text", F.lit(C.WORD), F.lit(0)), 1, 400), " "))
    got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm.score(cut, fitted=fitted).collect())
    want.sort()
    assert [g[:2] for g in got] == [x[:2] for x in want]
    assert [g[2] for g in got] == pytest.approx([x[2] for x in want], rel=1e-4)


def test_lm_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    lex = lm.Lexicon(np.sort(rng.integers(0, 1 << 60, 50).astype(np.uint64)), np.arange(50, 0, -1) * 9, rng.integers(0, 20, lm.SURFACES), groups=6)
    items = np.arange(lex.n).repeat(40)[rng.permutation(2000)]
    following = (items + 1) % lex.n  # every word after the one before it
    t = lm.Trainer(lex, lm.Weights(lex).flat, rate=0.3)
    contexts = np.stack([items, rng.integers(0, lex.start + 1, 2000)], axis=1)
    m = lm.Model(lex, t.w, 0, 0, None, None, None, None, 0)
    before = m.log_probabilities(following, contexts).mean()
    for _ in range(60):
        t.train(following, contexts)
    assert m.log_probabilities(following, contexts).mean() > before + 1  # it learns what follows what
    every = np.concatenate([np.arange(lex.n), lex.n + np.arange(lm.SURFACES)])
    for c in contexts[:3]:
        p = np.exp(m.log_probabilities(every, np.repeat(c[None], len(every), axis=0)))
        assert p.sum() == pytest.approx(1, rel=1e-4)


def test_lm_goes_over_a_corpus_once_whatever_its_size(spark):
    for n in (20, 900):
        rows = [(i, " ".join(f"{'ab'[i % 2]}{(i * j) % 7}" for j in range(1, 30))) for i in range(n)]
        model = lm.fit(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))[0]
        h, doc = lm.tokens([t.encode() for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2])
        items = model.lexicon.items(h)
        plain = lm.Trainer(model.lexicon, lm.Weights(model.lexicon).flat, seed=0)
        plain.train(items, model.lexicon.contexts(items, doc))
        assert plain.seen == model.train_tokens
        assert np.allclose(model.weights.flat, plain.w.flat, atol=1e-5)


def test_lm_weights_are_averaged_over_all_partitions(spark, monkeypatch):
    rows = [(i, " ".join(f"{'ab'[i % 2]}{(i * j) % 7}" for j in range(1, 30))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9, "doc_id")
    monkeypatch.setattr(lm, "FAN", 3)
    got = lm.score(docs).collect()
    assert sum(r.score for r in got) > 0.8 * sum(r.base_score for r in got)


# ---------------------------------------------------------------- near copies by shingles


def plain_near_copies(rows, width=5):
    """Smallest ids of the components of pairs within two bits or with a Jaccard similarity of 0.8 or more."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()
    fps = {i: plain_fingerprint(t) for i, t in rows}
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids, by_jaccard = sorted(sets), 0
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            a, b = sets[i], sets[j]
            both = len(a & b) if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) else 0
            near = both and 5 * both >= 4 * len(a | b)
            bits = (fps[i] ^ fps[j]).bit_count() <= 2
            by_jaccard += bool(near and not bits)
            if near or bits:
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted({find(i) for i in ids}), by_jaccard


@pytest.mark.parametrize("crowd, block", [(64, 512), (1, 3)])
def test_near_copies_of_five_word_shingles(spark, sf, monkeypatch, crowd, block):
    from graphweave.llm import shingles

    monkeypatch.setattr(shingles, "CROWD", crowd)
    monkeypatch.setattr(shingles, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = [(r.doc_id, r.text) for r in C.table(spark, sf, "documents").select("doc_id", "text").collect()]
    at = 10_000
    passage = [f"p{i}" for i in range(60)]
    for n in (3, 5, 9, 49, 104, 300):
        base = [f"w{x}" for x in rng.integers(0, 10**6, n)]
        for cut in (0, 1, 2, 3, 5, n // 20, n // 10, n // 5):
            rows.append((at, " ".join(base[: n - cut])))
            rows.append((at + 1, " ".join(["Other"] + base[:-1]) if cut % 2 else " ".join(base[:cut] + [f"x{at}"] + base[cut + 1 :])))
            rows.append((at + 2, " ".join(passage + [f"y{at + x}" for x in range(n)])))
            at += 3
    want, by_jaccard = plain_near_copies(rows)
    assert by_jaccard > 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = shingles.keep_one(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == want
    assert shingles.keep_one(docs.limit(0)).count() == 0


def test_crowds_take_whole_sets_of_what_can_be_alike_in_shares(spark, monkeypatch):
    from graphweave.llm import shingles

    asked = []
    whole_sets = shingles.whole_sets
    monkeypatch.setattr(shingles, "CROWD", 4)
    monkeypatch.setattr(shingles, "BLOCK", 8)
    monkeypatch.setattr(shingles, "NUMBERS", 8000, raising=False)
    monkeypatch.setattr(shingles, "PAIRS", 500, raising=False)
    monkeypatch.setattr(shingles, "frequent", lambda *a: np.zeros(0, np.uint64))
    monkeypatch.setattr(shingles, "whole_sets", lambda keys, *a: asked.append(keys.count()) or whole_sets(keys, *a))
    passage = [f"p{i}" for i in range(20)]
    rows = [(i, " ".join(passage + [f"y{i}.{x}" for x in range(100)])) for i in range(60)]
    rows += [(100 + i, " ".join(passage + [f"z{i // 4}.{x}" for x in range(100)] + [f"e{i}"] * (i % 4))) for i in range(24)]
    want, by_jaccard = plain_near_copies(rows)
    assert by_jaccard > 0
    got = shingles.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == want
    assert max(asked) <= 24  # the 60 share a passage only


def test_whole_sets_move_few_other_texts(spark):
    from graphweave.llm import shingles

    docs = spark.createDataFrame([(i, None if i == 7 else f"a b c d e f{i}") for i in range(3000)], "doc_id long, text string")
    rows = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), F.col("doc_id").alias("key"))
    wanted = rows.where("key % 500 = 7").select("mark")
    found = shingles.likely(rows, "mark", wanted)
    assert found.columns == rows.columns
    assert wanted.exceptAll(found.select("mark")).isEmpty() and found.count() < 50
    assert shingles.likely(rows, "mark", wanted.limit(0)).isEmpty()
    keys = spark.createDataFrame([(shingles.text_key(f"a b c d e f{i}".encode()),) for i in (3, 2000)], "key long")
    read = shingles.read(docs, "doc_id", "text", 5, 4, 5, np.zeros(0, np.uint64), 3)
    got = shingles.whole_sets(keys, docs, read, "text", 5)
    # The filter comes before the join by mark, so what that join moves are a few texts.
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("= _m#") < plan.index("= _word#")
    assert sorted(r.key for r in got.collect()) == sorted(r.key for r in keys.collect())


def test_pipeline_stage_finds_near_copies(spark, sf):
    import corpus_pipeline

    base = [f"w{i}" for i in range(200)]
    other = [f"x{i}" if i in (40, 80, 120, 160) else w for i, w in enumerate(base)]
    a, b = (simhash.fingerprint(" ".join(t).encode()) for t in (base, other))
    assert (a ^ b).bit_count() > 2
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(other)), (3, "z")], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, sf).collect()) == [1, 3]


# ---------------------------------------------------------------- memory of workers

_WORKER = """
import re, sys
from types import SimpleNamespace as Of
import numpy as np, pyarrow as pa
from graphweave.llm import quality

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

rng = np.random.default_rng(4)
said = [" ".join(f"w{x}" for x in rng.integers(0, 50000, 400)) for _ in range(4000)]
whole = pa.RecordBatch.from_arrays([pa.array(said * 3)], names=["text"])
sink = pa.BufferOutputStream()
with pa.ipc.new_stream(sink, whole.schema) as out:
    out.write_batch(whole)
data = sink.getvalue().to_pybytes()
del said, whole, sink, out
weight = rng.normal(size=1 << quality.BITS)
docs = Of(sparkSession=Of(sparkContext=Of(broadcast=lambda m: Of(value=m))), schema=None, mapInArrow=lambda run, schema: run)
run = quality.keep_good(docs, quality.Model(weight, np.abs(weight), 0.0, 3.0))
pa.default_memory_pool().release_unused()
before, kept = held(), 0
for batch in run(b for _ in range(2) for b in pa.ipc.open_stream(pa.BufferReader(bytes(bytearray(data))))):
    kept += batch.num_rows
    del batch
print(kept, held() - before)
"""


def test_workers_give_memory_back():
    """A worker that has judged 50 MB of text does not keep buffers for its next task; each text is judged once."""
    import subprocess
    import sys

    got = subprocess.run([sys.executable, "-c", _WORKER], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
    kept, grown = got.stdout.split()
    assert int(kept) % 6 == 0 and int(kept) > 0
    assert float(grown) < 10


def test_scores_do_not_depend_on_slices():
    from graphweave.llm import quality

    rng = np.random.default_rng(4)
    texts = [" ".join(f"W{x}" for x in rng.integers(0, 3000, rng.integers(0, 300))).encode() for _ in range(300)]
    weight = rng.normal(size=1 << quality.BITS)
    model = quality.Model(weight, np.abs(weight), 0.1, 3.0)
    assert model.scores(texts).tolist() == [s for i in range(0, 300, 7) for s in model.scores(texts[i : i + 7]).tolist()]
