"""Every query with SQL gives what another engine gives on the same tables."""

from collections import Counter

import pytest

from graphweave import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, sf, duck, name):
    df = queries.QUERIES[name](spark, sf)
    want = duck.sql(queries.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [df.columns.index(c) for c in want.columns]
    assert Counter(tuple(r[i] for i in order) for r in df.collect()) == Counter(want.fetchall())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plain_normal(code):
    """Code normalised by a scanner, rule after rule: strings, comments, layout, numbers, names."""
    from graphweave.functions.text import RESERVED

    spaces = " \t\n\v\f\r\u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))
    ends = "\n\r\u2028\u2029"
    code = code or ""
    if not code.strip(spaces):
        return ""
    for quote in "`\"'":
        out, i = "", 0
        while i < len(code):
            j = -1
            if code[i] == quote:
                j = i + 1
                while j < len(code) and code[j] != quote:
                    if quote != "`" and code[j] == "\\":
                        if j + 1 >= len(code) or code[j + 1] in ends:
                            j = len(code)
                            break
                        j += 1
                    j += 1
            if 0 <= j < len(code):
                out, i = out + "$STR", j + 1
            else:
                out, i = out + code[i], i + 1
        code = out
    while (a := code.find("/*")) >= 0 and (b := code.find("*/", a + 2)) >= 0:
        code = code[:a] + code[b + 2 :]
    while (a := code.find("//")) >= 0:
        b = min([x for x in (code.find(e, a) for e in ends) if x >= 0], default=len(code))
        code = code[:a] + code[b:]
    parts, run = [], ""
    for ch in code:
        if ch in spaces:
            parts, run = parts + [run], ""
        else:
            run += ch
    code = " ".join(x for x in [*parts, run] if x)
    word = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_"
    digits = "0123456789"

    def numbers(text, take, guarded=""):
        out, i = "", 0
        while i < len(text):
            n = take(text, i) if text[i] in digits and (i == 0 or text[i - 1] not in word + guarded) else 0
            if n and text[i + n : i + n + 1] == "n" and (i + n + 1 == len(text) or text[i + n + 1] not in word):
                n += 1
            if n and (i + n == len(text) or text[i + n] not in word):
                out, i = out + "$NUM", i + n
            else:
                out, i = out + text[i], i + 1
        return out

    def based(mark, allowed):
        def take(text, i):
            n = 2
            while i + n < len(text) and text[i + n] in allowed:
                n += 1
            return n if text[i] == "0" and text[i + 1 : i + 2] in tuple(mark) and n > 2 else 0

        return take

    def decimal(text, i):
        def run(k):
            n = 0
            if text[k : k + 1] and text[k] in digits:
                n = 1
                while text[k + n : k + n + 1] and text[k + n] in digits + "_":
                    n += 1
            return n

        n = run(i)
        options = [n]
        if text[i + n : i + n + 1] == "." and run(i + n + 1):
            options.append(n + 1 + run(i + n + 1))
        for k in list(options):
            at = i + k
            if text[at : at + 1] in ("e", "E"):
                sign = 1 if text[at + 1 : at + 2] in ("+", "-") else 0
                if run(at + 1 + sign):
                    options.append(k + 1 + sign + run(at + 1 + sign))
        fine = [k for k in options if (i + k == len(text) or text[i + k] not in word) or (text[i + k] == "n" and (i + k + 1 == len(text) or text[i + k + 1] not in word))]
        return max(fine, default=0)

    for mark, allowed in (("xX", "0123456789abcdefABCDEF_"), ("bB", "01_"), ("oO", "01234567_")):
        code = numbers(code, based(mark, allowed))
    code = numbers(code, decimal, "$")
    names, out, i = {}, "", 0
    while i < len(code):
        ch = code[i]
        before = i > 0 and code[i - 1] in word
        if (ch in word and ch not in digits and not before) or (ch == "$" and before):
            j = i + 1
            while j < len(code) and code[j] in word + "$":
                j += 1
            while code[j - 1] == "$" and not (j < len(code) and code[j] in word):  # a name ends at a boundary
                j -= 1
            name = code[i:j]
            if j > i:
                out += name if name in RESERVED else names.setdefault(name, f"$VAR_{len(names) + 1}")
                i = j
                continue
        out, i = out + ch, i + 1
    return out


def test_normalised_documents_against_a_plain_scanner(spark, sf):
    import hashlib

    from graphweave.functions.text import normalize
    from graphweave.sources.fixtures import table

    want = {r.doc_id: plain_normal(r.text) for r in table(spark, sf, "documents").collect()}
    got = {r.doc_id: (r.length, r.hash) for r in queries.d6_normalized_code(spark, sf).collect()}
    assert got == {i: (len(t), hashlib.sha256(t.encode()).hexdigest() if t else "") for i, t in want.items()}
    code = ["const a = 0x1F + 0b1_0 + 0o17 + 1_000.5e-3 + 12n; // end\nlet b$ = a.b + 'it\\'s' + \"x\" + `y\n`;", "/* a */ f(1.e, .5, x1, 1a) // \u2028 g", "if (_a) { return this.b(_a, b, _a); }", "'open", "", " \u00a0\n", "a /* b", "x$y$ $z 0x 0xg 1e5 1e 1_ '\\\n'"]
    assert [normalize(c) for c in code] == [plain_normal(c) for c in code]


def test_greedy_pairs_against_a_loop(spark, sf):
    from pyspark.sql import functions as F

    from graphweave.operators import duplicates

    def loop(rows):
        used, chosen = set(), []
        for r in sorted(rows, key=lambda r: (-r.similarity, r.id1, r.id2)):
            if not {r.id1, r.id2} & used and r.file1 != r.file2:
                used |= {r.id1, r.id2}
                chosen.append((r.id1, r.id2))
        return sorted(chosen)

    pairs = duplicates.similar_pairs(queries._vector_nodes(spark, sf), 0.675)
    few = pairs.orderBy(F.col("similarity").desc(), "id1", "id2").limit(200)
    assert sorted((r.id1, r.id2) for r in queries.d13_greedy_pairs(spark, sf).collect()) == loop(few.collect()) != []
    ties = pairs.withColumn("similarity", F.floor(F.col("similarity") * 20) / 20).withColumn("file2", F.when(F.crc32("id2") % 9 == 0, F.col("file1")).otherwise(F.col("file2")))
    assert sorted((r.id1, r.id2) for r in duplicates.greedy_pairs(ties).collect()) == loop(ties.collect())
    assert duplicates.greedy_pairs(pairs.limit(0)).count() == 0


def test_similar_pairs_of_odd_vectors(spark):
    from graphweave.operators import duplicates

    rows = [("a", [1.0, 0.0], "/a", None, "k"), ("b", [2.0, 0.0], "/b", None, "k"), ("c", None, "/c", None, "k"), ("d", [0.0, 0.0], "/d", None, "k"), ("e", [1.0], "/e", None, "k"), ("f", [1.0, 0.1], "/a", "h", "k"), ("g", [1.0, 0.0], "/g", None, "other")]
    nodes = spark.createDataFrame(rows, "id string, embedding array<double>, filePath string, normalizedHash string, coreType string")
    got = sorted((r.id1, r.id2) for r in duplicates.similar_pairs(nodes, 0.9, block=2).collect())
    assert got == [("a", "b"), ("b", "f")]
    assert duplicates.similar_pairs(nodes.where("id = 'c'")).count() == 0


def test_similar_pairs_in_rounds_and_groups(spark, monkeypatch):
    """Small blocks that all can meet are grouped, copies go in rounds; the pairs are those of all against all."""
    import numpy as np

    from graphweave.operators import duplicates

    x = np.random.default_rng(5).normal(size=(300, 8))
    nodes = spark.createDataFrame([(f"{i:03d}", v.tolist(), f"/{i}", None, "k") for i, v in enumerate(x)], "id string, embedding array<double>, filePath string, normalizedHash string, coreType string")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = (1 + x @ x.T) / 2
    np.fill_diagonal(s, -9)
    want = sorted((f"{i:03d}", f"{j:03d}") for i in range(300) for j in np.argsort(-s[i])[:20] if s[i, j] >= 0.75 and i < j)
    dealt, rounds = [], []
    sides, sweep = duplicates.cut, duplicates.sweep
    monkeypatch.setattr(duplicates, "cut", lambda d: dealt.append(d.count() if d.columns == ["i", "j"] else 0) or sides(d))
    monkeypatch.setattr(duplicates, "sweep", lambda s: rounds.append(1) or sweep(s))
    monkeypatch.setattr(duplicates, "COPIES", 700)
    monkeypatch.setattr(duplicates, "GROUP", 64)
    got = duplicates.similar_pairs(nodes, 0.75, neighbours=20, block=8)
    assert sorted((r.id1, r.id2) for r in got.collect()) == want
    assert dealt[-1] == 0 and min(n for n in dealt if n) <= 16 and len(rounds) > 1


def plain_levels(ids, edges):
    before = {i: {b for a, b in edges if a == i and b in ids} for i in ids}
    want, level, rest = {}, 0, dict(before)
    while ready := [i for i, b in rest.items() if not b & rest.keys()]:
        want |= {i: (level, len(before[i])) for i in ready}
        rest = {i: b for i, b in rest.items() if i not in want}
        level += 1
    return want | {i: (-1, len(before[i])) for i in rest}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_levels_against_a_plain_sort(spark, seed):
    """Chains, joints, cycles, ids behind them, dependencies without an id, repeated rows."""
    import random

    from graphweave.operators import tasks

    rng = random.Random(seed)
    ids = [f"t{i}" for i in range(90)]
    edges = [(f"t{i}", f"t{i - 1}") for i in range(1, 40)] + [(f"t{i}", f"t{rng.randrange(i)}") for i in range(40, 80) for _ in range(rng.choice([1, 1, 1, 2, 3]))]
    edges += [("t80", "t81"), ("t81", "t82"), ("t82", "t80"), ("t83", "t82"), ("t84", "t83"), ("t84", "t1"), ("t85", "t85"), ("t86", "gone"), ("t87", "t86"), ("t87", "t86")]
    got = tasks.levels(spark.createDataFrame([(i,) for i in [*ids, "t1"]], "id string"), spark.createDataFrame(edges, "taskId string, dependsOn string")).collect()
    assert {r.id: (r.level, r.n) for r in got} == plain_levels(set(ids), edges) and len(got) == len(ids)
    assert tasks.levels(spark.createDataFrame([], "id string"), spark.createDataFrame([], "taskId string, dependsOn string")).count() == 0
