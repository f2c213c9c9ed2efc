"""Near copies by Jaccard similarity of word shingles, completing the SimHash components.

A set's prefix holds so many of its smallest shingles that two sets at or above the
similarity share one.  The order is by hash, shingles that are frequent in a sample
last, so that common passages make no candidates; any order is complete.  Sets are
first held against the smallest set of each shingle and get a label by what they link
with; then sets of different labels are held against each other: pair by pair where few
share a shingle, in blocks of sets where many do, which hand on a row a set and no pairs.
Blocks first hold prefixes, without the shingles that nothing shares, against each other;
whole sets go only to blocks where two of them can still be alike.  Every link is checked
exactly, on whole sets of the texts that candidates name; other texts are left out before
any exchange.  What grows faster than the texts goes in shares, one on disk at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import simhash

#: Texts from which frequent shingles are taken, in how many of them one is frequent, and the most that are broadcast.
SAMPLE, FREQUENT, MOST = 8192, 3, 1 << 18
#: Words of 64 bits of the table that tells which texts a join can do without.
WORDS = 1 << 18
#: From how many sets of a shingle on they meet in blocks, and the sets of a block.
CROWD, BLOCK = 64, 512
#: Shingles of copies of sets or prefixes, and pairs of sets, that stand on disk at a time, about.
NUMBERS, PAIRS = 1 << 26, 1 << 25


def text_key(text: bytes) -> int:
    """Signed 64-bit hash of a text's lower-cased words: texts with one key have one fingerprint and one set."""
    h = xxhash.xxh64_intdigest(b" ".join(text.lower().split()), 7)
    return h - (1 << 64) if h >> 63 else h


def shingle_sets(texts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash), distinct and sorted: the shingles of each text; one of all its words if they are fewer than ``width``."""
    words, doc = C.words_of(texts)
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    inside = np.arange(len(words)) - first[doc]
    begin = np.flatnonzero(inside <= np.maximum(n - width, 0)[doc])
    h = np.zeros(len(begin), np.uint64)
    for k in range(width):
        there = inside[begin] + k < n[doc[begin]]
        at = np.minimum(begin + k, max(len(words) - 1, 0))
        h = C.mix64(h + np.where(there, words[at] if len(words) else h, C.END))
    order = np.lexsort((h, doc[begin]))
    d, h = doc[begin][order], h[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[new], h[new]


def sets(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """(key, shingles) of each row."""

    def run(batches):
        for batch in batches:
            for _, texts in C.chunks(batch, "text", C.SLICE):
                d, h = shingle_sets(texts, width)
                at = np.searchsorted(d, np.arange(len(texts) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array([text_key(t) for t in texts], pa.int64()), lists], names=["key", "shingles"])

    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(C.lean(run), "key long, shingles array<long>")


def frequent(docs: DataFrame, id_col: str, text_col: str, width: int) -> np.ndarray:
    """Sorted hashes of shingles that several texts of a sample, of about SAMPLE texts, share; they only order."""
    total = docs.count()
    low = (1 << 63) - 1 if total <= SAMPLE else int(SAMPLE / total * 2**64) - (1 << 63)
    some = docs.select(id_col, text_col).where(F.xxhash64(id_col) <= F.lit(low))
    n = sets(some, text_col, width).dropDuplicates(["key"]).select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("n"))
    got = n.where(F.col("n") >= FREQUENT).orderBy(F.col("n").desc(), "h").limit(MOST).select("h").toArrow()
    return np.sort(got.column(0).to_numpy().astype(np.int64).view(np.uint64))


def read(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, late: np.ndarray, bits_width: int) -> DataFrame:
    """(doc_id, mark, fp, key, n, prefix): fingerprint, key, size of the shingle set and its prefix."""

    def run(batches):
        for batch in batches:
            for at0, texts in C.chunks(batch, "text", C.SLICE):
                d, h = shingle_sets(texts, width)
                n = np.bincount(d, minlength=len(texts))
                last = np.isin(h, late)
                order = np.lexsort((h, last, d))
                rank = np.arange(len(d)) - (np.cumsum(n) - n)[d]
                keep = rank < (n + 1 - -(-num * n // den))[d]
                d, h = d[keep], h[order][keep]
                at = np.searchsorted(d, np.arange(len(texts) + 1)).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(at), pa.array(h.view(np.int64)))
                fp = pa.array(np.array([simhash.fingerprint(t, bits_width) for t in texts], np.uint64).view(np.int64))
                key = pa.array([text_key(t) for t in texts], pa.int64())
                own = batch.slice(at0, len(texts))
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), fp, key, pa.array(n.astype(np.int64)), prefix], names=["doc_id", "mark", "fp", "key", "n", "prefix"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    return rows.mapInArrow(C.lean(run), "doc_id long, mark long, fp long, key long, n long, prefix array<long>")


def shares_of(volume: int | None, most: int) -> int:
    return max(1, -(-(volume or 0) // most))


def of_share(rows: DataFrame, column: str, k: int, shares: int) -> DataFrame:
    """The rows whose value of a column belongs to a share."""
    return rows if shares == 1 else rows.where(F.pmod(F.xxhash64(F.lit(13), column), F.lit(shares)) == k)


def in_shares(spark, shares: int, made) -> DataFrame:
    """Rows of made(0), made(1), ..., of which each is written before the next begins; one share is left as a plan."""
    if shares == 1:
        return made(0)
    out = None
    for k in range(shares):
        some = C.cut(made(k))
        out = some if out is None else out.unionByName(some)
        C.sweep(spark)
    return out


def possible(met: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of rows (a, b, na, nb), one for each shingle that two prefixes share, whose sets can still reach the similarity.

    What lies behind the prefix whose last shingle comes first is all that can be
    shared besides; the larger of the two rests bounds it.
    """
    rest = lambda n: F.ceil(F.lit(num) * F.col(n) / F.lit(den)) - 1
    close = (F.col("na") * den >= F.col("nb") * num) & (F.col("nb") * den >= F.col("na") * num)
    shared = met.where(close).groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"))
    return shared.where((F.col("c") + F.greatest(rest("na"), rest("nb"))) * (num + den) >= (F.col("na") + F.col("nb")) * num).select("a", "b")


def alike(pairs: DataFrame, docs: DataFrame, rows: DataFrame, text_col: str, width: int, num: int, den: int) -> DataFrame:
    """(u, v): the pairs (a, b) of keys whose whole sets have a Jaccard similarity of num / den or more."""
    pairs = C.cut(pairs)
    whole = C.cut(whole_sets(pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct(), docs, rows, text_col, width))
    one, two = whole.toDF("a", "sa"), whole.toDF("b", "sb")
    both = F.size(F.array_intersect("sa", "sb"))
    enough = both * (num + den) >= (F.size("sa") + F.size("sb")) * num
    sizes = C.cut(whole.select(F.col("key").alias("a"), F.size("shingles").cast("long").alias("n")))
    once, copies = sizes.agg(F.sum("n")).first()[0], pairs.join(sizes, "a").agg(F.sum("n")).first()[0]
    shares = shares_of(copies, max(NUMBERS, once or 0))

    def check(k: int) -> DataFrame:
        met = of_share(pairs, "a", k, shares).join(of_share(one, "a", k, shares), "a").join(two, "b")
        return met.where(enough).select(F.col("a").alias("u"), F.col("b").alias("v"))

    return in_shares(docs.sparkSession, shares, check)


def whole_sets(keys: DataFrame, docs: DataFrame, rows: DataFrame, text_col: str, width: int) -> DataFrame:
    """(key, shingles): the whole sets of some keys, from one text of each."""
    marks = C.cut(rows.join(keys, "key", "left_semi").groupBy("key").agg(F.min("mark").alias("mark")).select(F.col("mark").alias("_m")))
    texts = likely(docs.select(F.col(text_col).alias("text"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("_h")), "_h", marks.select("_m"))
    # An inner join: a semi join would be pushed below that of likely.
    return sets(texts.join(marks, F.col("_h") == F.col("_m")), "text", width).dropDuplicates(["key"])


def likely(rows: DataFrame, hash_col: str, wanted: DataFrame) -> DataFrame:
    """Rows whose hash may be among some hashes (one column): none of those is lost, few others stay.

    A broadcast table of fixed size, a bit a hash, so that a join with few of the
    rows does not move all of them.
    """
    word = lambda c: F.pmod(F.shiftrightunsigned(c, 6), F.lit(WORDS))
    h = F.col(wanted.columns[0])
    bits = wanted.groupBy(word(h).alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({wanted.columns[0]} & 63 as int))")).alias("_bits"))
    met = rows.withColumn("_at", word(F.col(hash_col))).join(F.broadcast(bits), F.col("_at") == F.col("_word"))
    return met.where(F.getbit("_bits", F.col(hash_col).bitwiseAND(F.lit(63)).cast("int")) == 1).select(*rows.columns)


def shared_counts(lists: pa.ListArray) -> np.ndarray:
    """How many numbers each two of some lists of distinct numbers share."""
    flat, n = lists.flatten().to_numpy(), lists.value_lengths().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), n)
    _, at, many = np.unique(flat, return_inverse=True, return_counts=True)
    shared = many > 1
    column = np.cumsum(shared) - 1
    row, at = row[shared[at]], column[at[shared[at]]]
    both = np.zeros((len(lists), len(lists)), np.float32)
    for i in range(0, int(shared.sum()), 4096):
        here = (at >= i) & (at < i + 4096)
        member = np.zeros((len(lists), 4096), np.float32)
        member[row[here], at[here] - i] = 1
        both += member @ member.T
    return both


def of_blocks(t: pa.Table) -> np.ndarray:
    """Which two rows of one block, or of two, have different labels and are not met in another group."""
    label, sub = t.column("label").to_numpy(), t.column("sub").to_numpy()
    apart = label[:, None] != label[None, :]
    return apart & (sub[:, None] != sub[None, :]) if t.column("pair")[0].as_py() else apart


def hopeful(t: pa.Table, num: int, den: int) -> pa.Table:
    """The rows of one block, or of two, that can be alike with another, by all that their prefixes share.

    Two sets count at the smallest crowd that both are in.
    """
    n, crowds = t.column("n").to_numpy(), t.column("crowds").combine_chunks()
    flat, size = crowds.flatten(), crowds.value_lengths().to_numpy(zero_copy_only=False)
    before = flat.to_numpy() < t.column("h")[0].as_py()
    ends = np.concatenate([[0], np.cumsum(np.bincount(np.repeat(np.arange(len(n)), size)[before], minlength=len(n)))]).astype(np.int32)
    earlier = shared_counts(pa.ListArray.from_arrays(pa.array(ends), flat.filter(pa.array(before))))
    rest = -(-num * n // den) - 1
    most = shared_counts(t.column("shared").combine_chunks()) + np.maximum(rest[:, None], rest[None, :])
    close = (n[:, None] * den >= n[None, :] * num) & (n[None, :] * den >= n[:, None] * num)
    can = of_blocks(t) & close & (earlier == 0) & (most * (num + den) >= (n[:, None] + n[None, :]) * num)
    return t.select(["h", "low", "high", "pair", "sub", "key", "label", "n"]).filter(pa.array(can.any(axis=1)))


def meet(t: pa.Table, num: int, den: int) -> pa.Table:
    """(u, v): of the sets of one block, or of two, each with the smallest that it is joined to by links between labels."""
    key = t.column("key").to_numpy()
    lists = t.column("shingles").combine_chunks()
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    link = of_blocks(t) & (shared_counts(lists) * (num + den) >= (n[:, None] + n[None, :]) * num)
    a, b = np.nonzero(link)
    root = np.argsort(np.argsort(key, kind="stable"), kind="stable")  # by place in order of key
    own = root.copy()
    while len(a):
        low = root.copy()
        np.minimum.at(low, a, root[b])
        low = low[np.argsort(own, kind="stable")][low]
        if (low == root).all():
            break
        root = low
    named = np.sort(key)
    off = root != own
    return pa.table({"u": key[off], "v": named[root[off]]})


def crowd_links(posts: DataFrame, docs: DataFrame, rows: DataFrame, text_col: str, width: int, num: int, den: int) -> DataFrame:
    """(u, v): what joins the sets that share a shingle with a crowd, met block by block.

    ``posts`` (key, n, h, label, k) has all shingles that prefixes of different labels share.
    """
    spark, block = docs.sparkSession, ["h", "low", "high"]
    crowd = C.cut(posts.where(F.col("k") > CROWD).select("h", "key", "label", "n", "k"))
    own = posts.join(crowd.select("key").distinct(), "key", "left_semi").groupBy("key")
    lists = C.cut(own.agg(F.collect_list("h").alias("shared"), F.collect_list(F.when(F.col("k") > CROWD, F.col("h"))).alias("crowds")))
    parts = F.ceil(F.col("k") / BLOCK).cast("long")
    sizes = lists.select("key", (F.size("shared") + F.size("crowds") + 8).cast("long").alias("size"))
    shares = shares_of(crowd.join(sizes, "key").agg(F.sum(parts * F.col("size"))).first()[0], NUMBERS)

    def dealt(k: int) -> DataFrame:
        some = of_share(crowd, "h", k, shares).withColumn("sub", F.pmod(F.xxhash64("key"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
        some = some.select("h", F.least("sub", "other").alias("low"), F.greatest("sub", "other").alias("high"), (F.col("sub") != F.col("other")).alias("pair"), "sub", "key", "label", "n")
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in some.schema)
        return some.join(lists, "key").groupBy(*block).applyInArrow(lambda t: hopeful(t, num, den), kinds)

    near = C.cut(in_shares(spark, shares, dealt))
    whole = C.cut(whole_sets(near.select("key").distinct(), docs, rows, text_col, width))
    most = shares_of(near.agg(F.sum("n")).first()[0], NUMBERS)
    return in_shares(spark, most, lambda k: of_share(near, "h", k, most).join(whole, "key").groupBy(*block).applyInArrow(lambda t: meet(t, num, den), "u long, v long"))


def labels(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """(key, label): a key that each key is linked with over some edges, the same for most of a component; one label, one component."""
    both = edges.select("u", "v").union(edges.select("v", "u")).where("u != v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = C.cut(keys.join(least, keys.key == least.u, "left").select("key", F.coalesce("m", "key").alias("label")))
    far = near.toDF("label", "far")
    return near.join(far, "label").select("key", F.col("far").alias("label"))


def fingerprint_links(keys: DataFrame, radius: int) -> DataFrame:
    """(u, v): keys of one fingerprint with the smallest of them, and those of fingerprints within ``radius`` bits."""
    least = C.cut(keys.groupBy("fp").agg(F.min("key").alias("rep")))
    same = keys.join(least, "fp").where("key != rep").select(F.col("key").alias("u"), F.col("rep").alias("v"))
    one, two = least.select(F.col("fp").alias("u"), F.col("rep").alias("a")), least.select(F.col("fp").alias("v"), F.col("rep").alias("b"))
    near = simhash.links(least.select("fp"), radius).join(one, "u").join(two, "v").select(F.col("a").alias("u"), F.col("b").alias("v"))
    return same.union(near)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 4, den: int = 5, radius: int = 2, bits_width: int = 3) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id stays.

    Links are fingerprints within ``radius`` bits, on shingles of ``bits_width``
    words, and sets of shingles of ``width`` words with a Jaccard similarity of
    num / den or more; all such links are found.
    """
    late = frequent(docs, id_col, text_col, width)
    rows = C.cut(read(docs, id_col, text_col, width, num, den, late, bits_width))
    keys = C.cut(rows.groupBy("key").agg(F.first("fp").alias("fp")))

    # One exchange serves the distinct, the pivots and their join; prefixes are not moved before.
    posts = rows.select("key", "n", F.explode("prefix").alias("h")).repartition("h").distinct()
    pivots = posts.groupBy("h").agg(F.min(F.struct("key", "n")).alias("p"), F.count("*").alias("k")).where("k > 1")
    posts = C.cut(posts.join(pivots, "h"))
    C.sweep(docs.sparkSession)  # here and below: what dozens of plans leave would let the driver's heap grow to its bound, and moved tables stay on disk
    met = posts.select(F.col("key").alias("a"), F.col("p.key").alias("b"), F.col("n").alias("na"), F.col("p.n").alias("nb")).where("a != b")
    edges = C.cut(fingerprint_links(keys, radius).union(alike(possible(met, num, den), docs, rows, text_col, width, num, den)))
    C.sweep(docs.sparkSession)

    posts = posts.select("key", "n", "h", "k").join(labels(keys.select("key"), edges), "key")
    mixed = posts.groupBy("h").agg(F.min("label").alias("c0"), F.max("label").alias("c1")).where("c0 != c1").select("h")
    posts = C.cut(posts.join(mixed, "h", "left_semi").select("key", "n", "h", "label", "k"))
    C.sweep(docs.sparkSession)
    few = posts.where(F.col("k") <= CROWD)
    shares = shares_of(few.agg(F.sum(F.col("k") - 1)).first()[0], 2 * PAIRS)
    one, two = few.drop("k").toDF("a", "na", "h", "ca"), few.drop("k").toDF("b", "nb", "h2", "cb")

    def met_of(k: int) -> DataFrame:
        """Pairs of a share of the sets: all shingles that two of them share are in one share."""
        met = of_share(one, "a", k, shares).join(two, (F.col("h") == F.col("h2")) & (F.col("ca") < F.col("cb")))
        return possible(met.select("a", "b", "na", "nb"), num, den)

    more = alike(in_shares(docs.sparkSession, shares, met_of), docs, rows, text_col, width, num, den)
    more = C.cut(more.union(crowd_links(posts, docs, rows, text_col, width, num, den)))
    C.sweep(docs.sparkSession)
    found = C.connected_components(edges.union(more))
    C.sweep(docs.sparkSession)
    component = keys.join(found, keys.key == found.node, "left").select("key", F.coalesce("component", "key").alias("component"))
    return simhash.first_of_each(docs, rows.join(component, "key").select("component", "doc_id", "mark"), id_col, text_col)
