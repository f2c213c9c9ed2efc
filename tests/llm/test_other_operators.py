"""Chat, vectors, archives and the pipeline: against plain versions, and on odd rows."""

import base64
import hashlib
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from graphweave.llm import ann, chat, forest, queries, vectors, warc
from graphweave.llm import common as C

# ---------------------------------------------------------------- chat

_TEXT = st.text(st.sampled_from(list("ab\\\n:</turn>### <|image|>é ")) | st.characters(codec="utf-8"), max_size=40)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(_TEXT, _TEXT), max_size=5), st.integers(1, 9))
def test_template_reads_back(turns, step):
    text = "".join(chat.segment(r, chat.escape(t)) for r, t in turns)
    reader, got = chat.Reader(), []
    for i in range(0, len(text), step):
        got += list(reader.feed(text[i : i + step]))
    assert got == turns


@given(_TEXT)
def test_escape_is_reversible_and_hides_control_strings(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert chat.Reader._close(hidden) is None


def test_parts_become_placeholders_in_order():
    flat = chat.flatten([{"type": "text", "text": "a <turn>"}, {"type": "image", "ref": "i.png", "width": 28, "height": 15}, {"type": "audio", "ref": "x.wav", "seconds": 2.0}, {"type": "document", "ref": "d", "pages": 3}, {"type": "odd", "text": "z"}, None, {"type": "image"}])
    assert "".join(flat.text) == "a \\<turn><|image|><|audio|><|document|>z<|image|>"
    assert [(a["position"], a["kind"], a["ref"], a["tokens"]) for a in flat.attachments] == [(0, "image", "i.png", 4), (1, "audio", "x.wav", 50), (2, "document", "d", 1500), (3, "image", "", 256)]
    assert flat.expanded == 4 + 50 + 1500 + 256


def plain_chat(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for *_, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def test_chat_on_odd_rows(spark):
    rows = [(1, 0, "user", "hi"), (1, 2, "assistant", "</turn>\\"), (1, 1, "assistant", None), (2, 0, None, ""), (3, None, "user", "first"), (3, 0, "assistant", "x" * 70000), (None, 0, "assistant", "lost"), (4, 0, "us\\ner\n:", "a\nb")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS segment", "2 AS loss_from", "3 AS parts").repartition(3)
    made = chat.format_turns(df)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    assert {c: tuple(r)[1:5] for c, r in got.items()} == plain_chat(rows)
    whole = {r.conv_id: len(r.formatted) for r in chat.assemble(made).collect()}
    assert {c: r.formatted_chars for c, r in got.items()} == whole
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_chat_with_parts(spark):
    df = spark.sql(f"SELECT 1 AS conv_id, 0 AS turn, 'user' AS role, CAST(array(named_struct('type', 'image', 'text', null, 'ref', 'r', 'width', 14, 'height', 14, 'seconds', null, 'pages', null)) AS {chat.PARTS}) AS content")
    r = chat.format_turns(df, parts_col="content").first()
    assert r.segment == "<turn>### user:\n<|image|></turn>\n" and r.attachments[0].ref == "r" and r.expanded_tokens == 1 and r.loss_to == 0


# ---------------------------------------------------------------- vectors


def odd_vectors(n=130, dim=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(size=dim).astype(np.float32).tolist()) for i in range(n)]
    rows += [(200 + i, rows[0][1]) for i in range(12)] + [(300 + i, (np.array(rows[100][1]) * (1 + 0.01 * i) + rng.normal(size=dim) * 0.01).tolist()) for i in range(9)]
    rows += [(400, None), (500, [0.0] * dim), (600, [float("nan")] + [1.0] * (dim - 1)), (700, [float("inf")] + [1.0] * (dim - 1)), (800, [None] + [1.0] * (dim - 1)), (900, []), (901, [1.0, 2.0]), (None, rows[3][1])]
    return rows


def fine(rows, dim=8):
    return [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v)]


def vector_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "2 AS v", "3 AS score", "4 AS rep", "5 AS n").repartition(3)


def plain_nearest(rows, k=10):
    out = []
    for i, q in rows:
        if i % 100:
            continue
        near = sorted((float(vectors.distances(q[None], v[None])[0]), j) for j, v in rows if j != i)[:k]
        out += [(i, n + 1, j, s) for n, (s, j) in enumerate(near)]
    return out


def test_nearest_on_odd_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = odd_vectors()
    df = vector_frame(spark, rows)
    want = sorted(plain_nearest(fine(rows)))
    assert sorted(map(tuple, ann.search(df, F.col("vec_id") % 100 == 0, 10).collect())) == want
    for name in ("BLOCK", "ASKS", "QUERY_BLOCK"):
        monkeypatch.setattr(ann, name, 3 if name == "ASKS" else 20)
    assert sorted(map(tuple, ann.search(df, F.col("vec_id") % 100 == 0, 10, n_curves=2, tile=16, exact=True).collect())) == want
    few = ann.search(df.where("vec_id < 5"), F.col("vec_id") % 100 == 0, 10).collect()
    assert len(few) == 4
    assert ann.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    assert ann.search(df.where("vec_id = 500"), F.col("vec_id") % 100 == 0).count() == 0


def recall(x, got, k=10):
    """Share of the true k nearest rows of the queries (ids divisible by 100) among (query, row) pairs."""
    hit = many = 0
    for i in range(0, len(x), 100):
        far = ((x - x[i]) ** 2).sum(1)
        far[i] = np.inf
        true = set(np.argpartition(far, k)[:k].tolist())
        hit, many = hit + len(true & got[i]), many + k
    return hit / many


@pytest.mark.parametrize("kind, n_curves, least", [("clustered", 4, 0.95), ("independent", 32, 0.95)])
def test_curves_alone_find_close_rows(spark, kind, n_curves, least):
    """The index's own recall, without any check, on tables that are twenty windows long.

    Independent components are the hardest rows there are: an ordering finds
    little more than twice its window's share of the answers, so it takes many.
    """
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    n, tile, dim = 20 * 3 * 128, 128, 16 if kind == "clustered" else 64
    x = rng.normal(size=(n, dim))
    if kind == "clustered":
        x = (rng.normal(size=(150, dim)) * 5)[np.arange(n) % 150] + 0.3 * x
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 100 == 0, 10, tile=tile, n_curves=n_curves).collect():
        got[r.query_id].add(r.vec_id)
    assert recall(x, got) >= least


def test_hilbert_neighbours_are_neighbours():
    cells = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = ann.hilbert(cells, 3)
    assert sorted(key.tolist()) == list(range(512))
    path = cells[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def plain_links(rows, least=0.9):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows])
    x = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = x @ x.T >= least
    parent = {i: i for i in ids}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in zip(*np.nonzero(near)):
        p, q = find(ids[a]), find(ids[b])
        parent[max(p, q)] = min(p, q)
    return {i: (int(near[k].sum()) - 1, find(i), find(i) == i) for k, i in enumerate(ids)}


@pytest.mark.parametrize("block, sample, fit", [(5, 16384, 2048), (1536, 16384, 2048), (30, 64, 100)])
def test_embedding_links_on_odd_rows(spark, block, sample, fit):
    rows = odd_vectors()
    df = vector_frame(spark, rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in forest.near_duplicates(df, leaf=20, block=block, sample=sample, fit=fit).collect()}
    want = plain_links(fine(rows))
    want |= {i: (0, i, True) for i, _ in rows if i not in want}
    assert got == want
    assert forest.near_duplicates(df.limit(0)).count() == 0
    alone = forest.near_duplicates(df.where("vec_id in (400, 500)")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in alone) == [(400, 0, 400, True), (500, 0, 500, True)]


def test_leaf_with_many_links_and_leaves_takes_little_memory():
    rng = np.random.default_rng(4)
    m = 600
    x = rng.normal(size=64) + 0.1 * rng.normal(size=(m, 64))
    lists = [sorted({int(k) for k in rng.integers(0, 3000, 28)}) + [10**6] for _ in range(m)]
    rep, n = rng.permutation(m), rng.integers(1, 4, m)
    t = pa.table({"leaf": [10**6] * m, "pair": [False] * m, "sub": [0] * m, "rep": rep, "n": n, "leaves": lists, "v": x.tolist()})
    tracemalloc.start()
    got = forest.compare(t, 64, 0.9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64e6
    sets = [set(k) - {10**6} for k in lists]
    want = {int(rep[i]): int(sum(n[j] for j in range(m) if i != j and not sets[i] & sets[j])) for i in range(m)}
    assert dict(zip(got["rep"].to_pylist(), got["links"].to_pylist())) == want and set(got["root"].to_pylist()) == {0}


def test_forest_recall_at_the_threshold(spark):
    """Pairs just above 0.9 in 64 dimensions: at least 99 in 100 are found."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    side = rng.normal(size=base.shape)
    side -= (side * base).sum(1, keepdims=True) * base
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    other = 0.905 * base + np.sqrt(1 - 0.905**2) * side
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, other]))]
    got = forest.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), leaf=64).where("n_links > 0").count()
    assert got >= 0.99 * 3000


def test_leaves_do_not_grow_with_the_table(spark):
    """Pairs compared a row stay within twice of what they were, on eight times the rows and a sample of a fortieth."""
    rng = np.random.default_rng(2)
    compared = []
    for n in (2500, 20000):
        rows = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(rng.normal(size=(n, 16)))], "rep long, n long, v array<double>")
        routed, sizes = forest.leaves_of(C.cut(rows), 16, 0.98, trees=3, leaf=64, sample=512, fit=512)
        found = [r["size"] for r in sizes.collect()]
        lists = routed.collect()
        assert len(lists) == n and sum(found) == sum(len(r.leaves) for r in lists) and max(found) <= forest.LARGE * 64
        compared.append(sum(x * x for x in found) / n)
    assert compared[1] <= 2 * compared[0]


def test_copies_of_vectors_stand_in_shares(spark, monkeypatch):
    """However many leaves rows lie in, no table holds more than a share of the copies, and the links are the same."""
    rng = np.random.default_rng(6)
    base = rng.normal(size=(700, 16))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(np.concatenate([base, base + 0.1 * rng.normal(size=base.shape)]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    tables, cut = [], C.cut

    def counted(rows):
        out = cut(rows)
        tables.append(out.count() if "v" in out.columns else 0)
        return out

    monkeypatch.setattr(C, "cut", counted)
    found, most = [], []
    for copies in (10**9, 9000):
        monkeypatch.setattr(forest, "COPIES", copies, raising=False)
        got = forest.near_duplicates(df, leaf=20, sample=64, fit=64)
        found.append(sorted((r.vec_id, r.n_links, r.component_id) for r in got.collect()))
        most.append(max(tables))
        tables.clear()
    assert found[0] == found[1] and sum(n > 0 for _, n, _ in found[0]) > 1000
    assert most[1] < 0.6 * most[0]


# ---------------------------------------------------------------- archives


def plain_pages(rows, least=0):
    first = {}
    for p, _, h in rows:
        h = (h or "").encode()
        if p is not None and len(h) >= least:
            first[h] = min(p, first.get(h, p))
    out = []
    for p, _, h in rows:
        h = (h or "").encode()
        to = first.get(h) if p is not None and len(h) >= least and first[h] != p else None
        out.append((p, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if to is not None else "response", to))
    return out


@pytest.mark.parametrize("least", [0, 5])
def test_archives_on_odd_rows(spark, least):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}</p>" * (i % 3)) for i in range(60)] + [(100, None, None), (101, "a b\r\nc é", ""), (102, "u", "é" * 90000), (103, "u", "\r\n\r\nWARC/1.1\r\n"), (None, None, "<p>1</p>"), (104, "u", "same"), (104, "u", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS payload", "2 AS digest", "3 AS first").repartition(4)
    got = warc.round_trip(df, least_bytes=least).collect()
    assert Counter(map(tuple, got)) == Counter(plain_pages(rows, least))
    assert warc.round_trip(df.limit(0)).count() == 0


def test_archive_index_finds_each_record(spark, tmp_path):
    rows = [(i, f"u{i}", f"page {i} " * 500) for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"), bundle_bytes=4000)
    bundles = spark.read.parquet(str(tmp_path / "w"))
    data = {r.bundle: bytes(r.data) for r in bundles.collect()}
    at = warc.index(bundles).collect()
    assert len(data) > 1 and sorted(r.record_id for r in at) == list(range(200))
    for r in at:
        (headers, block), = warc.records(warc.read_record(data[r.bundle], r.frame, r.offset, r.length))
        assert headers["WARC-Record-ID"] == f"<urn:page:{r.record_id}>" and block.decode() == f"page {r.record_id} " * 500


def test_bundle_is_plain_zstandard():
    import io

    import zstandard

    w = warc.BundleWriter(frame_bytes=50)
    parts = [b"a" * 30, b"b" * 40, b"c" * 10]
    for i, p in enumerate(parts):
        w.add(i, p)
    data, _ = w.finish()
    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read() == b"".join(parts)
    assert len(warc.seek_table(data)) == 2


# ---------------------------------------------------------------- queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_against_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = queries.queries()[name](spark, sf)
    want = con.sql(queries.oracle_sql()[name])
    order = [df.columns.index(c) for c in want.columns]
    assert sorted(df.columns) == sorted(want.columns)
    assert Counter(tuple(r[i] for i in order) for r in df.collect()) == Counter(want.fetchall())


def test_pipeline_against_plain_stages(spark, sf):
    from test_text_operators import plain_lines, plain_near_copies, plain_targets, words
    from tokenizers import Tokenizer

    from graphweave.llm import quality

    docs = C.table(spark, sf, "documents")
    model = quality.train(docs, C.table(spark, sf, "labels"))
    rows = {r.doc_id: r for r in docs.collect()}
    good = [i for i in rows if model.scores([(rows[i].text or "").encode()])[0] >= 0.5]
    assert len(good) >= 0.7 * len(rows)
    text = {i: t for i, _, _, t in plain_lines([(i, rows[i].text) for i in good])}
    kept = plain_near_copies(list(text.items()))[0]
    sizes = defaultdict(int)
    for i in kept:
        sizes[rows[i].source] += len(words(text[i]))
    target = plain_targets(sizes)
    left = {s: int(np.floor(t + 0.5)) for s, t in target.items()}
    want = Counter()
    library = Tokenizer.from_file(queries.vocabulary_path())

    def row(i, t):
        ids = library.encode(t, add_special_tokens=False).ids
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()

    for s in sizes:
        mine = sorted((i for i in kept if rows[i].source == s), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
        while left[s] > 0:
            for i in mine:
                n = len(words(text[i]))
                if n and left[s] > 0:
                    take = min(n, left[s])
                    left[s] -= take
                    import re

                    want[row(i, text[i] if take == n else "".join(re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+", text[i])[:take]))] += 1
    got = corpus_pipeline.run(spark, sf)
    assert Counter(tuple(r)[:4] for r in got.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want


def test_pipeline_stages_keep_columns(spark, sf):
    docs = C.table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).schema.names == docs.schema.names


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_on_odd_rows(spark, sf, tmp_path, empty):
    """Nulls, empty and long texts, ties, equal rows, clashing further columns; and no row at all: stage by stage."""
    from pyspark.sql import functions as F
    from test_text_operators import SCHEMA, odd_rows

    docs = spark.createDataFrame([] if empty else odd_rows(), SCHEMA)
    docs = docs.select("*", *[F.lit(1).alias(c) for c in ("fp", "key", "h", "mark", "size", "component", "prefix", "c0", "_id", "taken")]).repartition(3)
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        columns = docs.columns
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "bpe" or docs.columns == columns
        counts.append(docs.count())
    if empty:
        assert counts == [0] * 6
        return
    assert counts[0] >= counts[1] == counts[2] > counts[3] and counts[4] == counts[5] > 0
    assert docs.where("n_tokens > 100").count() >= 1
