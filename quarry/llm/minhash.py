"""Operator 5: near-duplicates by BagMinHash over word shingles.

A document is the multiset of its runs of five words (lower case, ``\\w+``; fewer than five
words make one run). Documents with equal multisets are one node. Per node:

* ``signatures``: BagMinHash. For every shingle and every block of the dyadic weight scale
  [0,1), [1,2), [2,4), [4,8) ... there is a Poisson process whose points carry a time, a
  signature position and a weight position inside the block (the sides taken by the
  hierarchical splits, read as the bits of one number); points below the shingle's
  count remain. A position keeps its earliest point. Two multisets agree at a position
  with probability sum(min) / sum(max). Points are drawn in order of time and only while
  they can still be earlier than what the document holds, so the work is
  O(shingles + m log m), also for large counts.
* bands of positions name buckets (``LEVELS``). In every bucket all members are compared
  with one leader, by the true overlap of the multisets. A bucket whose members are then in
  one class is done, however many they are. By the triangle inequality of the Jaccard
  distance, members closer to the leader than (its nearest unlinked member - 0.2) cannot be
  linked to an unlinked one and leave. A remainder of at most ``BLOCK`` members is compared
  as one block, in which the links between different classes are found without listing pairs;
  a larger one is dealt again by fresh signatures with more rows per band, on which texts that
  only share a passage part. The last level compares whatever is still together.
* classes are the connected components of the verified links.

No links, components or signatures are gathered on the driver, hot buckets and hot leaders
are joined with keys that adaptive execution splits, and every round is written to the
shared folder.

Defined cases: a null text is alone; texts without a word are in one class only with equal
texts; repeated rows are copies; null ``doc_id`` is allowed (a class of only such rows has
class_id null); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, read, staged, text_slices
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
#: (rows per band, bands) of each level; a pair of similarity 0.8 is missed with
#: probability (1 - 0.8^rows)^bands: 7e-5, 1e-4, 1e-4
LEVELS = ((5, 24), (8, 50), (11, 100))
#: members, and shingles, of a bucket's remainder that one task compares as a block
BLOCK = 2_048
BLOCK_SHINGLES = 2_000_000

_WORD = re.compile(r"\w+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0x100000001B3)
_MEMO: dict[str, int] = {}
_MEMO_WORDS = 50_000
#: text, and bytes of multisets, that a task holds in all their forms at a time
SLICE_CHARS = 1_000_000
SLICE_BYTES = 8_000_000


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64"""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """64 bits -> (0, 1]"""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * (1.0 / 9007199254740992.0)


def shingles(text: str, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, ascending, and their counts."""
    words = _WORD.findall(text.lower())
    if not words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    words += ["\0"] * (width - len(words))
    memo = _MEMO
    if len(memo) > _MEMO_WORDS:
        memo.clear()
    for w in set(words).difference(memo):
        memo[w] = xxhash.xxh3_64_intdigest(w)
    x = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = len(x) - width + 1
    h = np.zeros(n, np.uint64)
    for i in range(width):
        h = _mix(h * _MUL + x[i : n + i])
    return np.unique(h, return_counts=True)


def content_key(text: str, hashes: np.ndarray, counts: np.ndarray) -> bytes:
    """16 bytes that name the multiset (of a text without a word: the text)."""
    body = hashes.tobytes() + counts.tobytes() if len(hashes) else b"\0" + text.encode("utf-8", "surrogatepass")
    return hashlib.blake2b(body, digest_size=16).digest()


def bag_minhash(doc: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_docs: int, m: int, seed: int) -> np.ndarray:
    """Signatures (n_docs x m, times as float64; inf for a document without shingles)."""
    sig = np.full(n_docs * m, np.inf)
    if not len(hashes):
        return sig.reshape(n_docs, m)
    # atoms: one Poisson process per shingle and dyadic block that its count reaches
    atoms = [(doc, hashes, counts, 0, 1)]
    low, block = 1, 1
    while True:
        some = counts > low
        if not some.any():
            break
        atoms.append((doc[some], hashes[some], counts[some], low, block))
        low, block = 2 * low, 2 * block
    d = np.concatenate([a[0] for a in atoms]).astype(np.int64)
    base = np.concatenate([_mix(a[1] ^ _mix(np.array([seed * 1_000_003 + a[3]], np.uint64))) for a in atoms])
    rate = np.concatenate([np.full(len(a[0]), float(a[4])) for a in atoms])
    # share of the block that the count covers: the splits keep a point if its side is below
    keep = np.concatenate([np.minimum(1.0, (a[2] - a[3]) / a[4]) for a in atoms])
    t = np.zeros(len(d))
    step = 0
    while len(d):
        points = int(min(64, max(1, 60_000 // len(d))))
        k = np.arange(step + 1, step + points + 1, dtype=np.uint64) * np.uint64(3)
        x = base[:, None] + k[None, :] * _GOLD
        at = t[:, None] + np.cumsum(-np.log(_unit(_mix(x))) / rate[:, None], axis=1)
        where = _mix(x ^ np.uint64(0x5851F42D4C957F2D))
        pos = (d * m)[:, None] + (where % np.uint64(m)).astype(np.int64)
        if (keep < 1).any():
            side = _unit(_mix(x ^ np.uint64(0x14057B7EF767814F)))
            ok = side <= keep[:, None]
            np.minimum.at(sig, pos[ok], at[ok])
        else:
            np.minimum.at(sig, pos.ravel(), at.ravel())
        t = at[:, -1]
        step += points
        last = sig.reshape(n_docs, m).max(axis=1)
        more = t < last[d]
        d, base, rate, keep, t = d[more], base[more], rate[more], keep[more], t[more]
    return sig.reshape(n_docs, m)


def bands_of(sig: np.ndarray, rows: int, bands: int) -> np.ndarray:
    """One bucket (int64) per document and band."""
    bits = sig.view(np.uint64).reshape(len(sig), bands, rows)
    h = np.broadcast_to(_mix(np.arange(bands, dtype=np.uint64))[None, :], bits.shape[:2]).copy()
    for r in range(rows):
        h = _mix(h * _MUL + bits[:, :, r])
    return h.view(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1] or 1, dtype=np.int32)), pa.array(values.ravel()))


def _signed(bags, rows: int, bands: int, seed: int) -> np.ndarray:
    doc = np.repeat(np.arange(len(bags)), [len(b[0]) for b in bags])
    return bands_of(bag_minhash(doc, np.concatenate([b[0] for b in bags]), np.concatenate([b[1] for b in bags]), len(bags), rows * bands, seed), rows, bands)


def _first_pass(rows: int, bands: int, width: int):
    def sign(batches):
        for batch in batches:
            for part, texts in text_slices(batch, chars=SLICE_CHARS):
                bags = [shingles(t or "", width) for t in texts]
                keys = [None if t is None else content_key(t, *b) for t, b in zip(texts, bags)]
                buckets = _signed(bags, rows, bands, 0)
                total = pa.array([int(b[1].sum()) for b in bags], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(keys, pa.binary()), total, _lists(buckets)], names=["doc_id", "key", "total", "buckets"])

    return sign


def _bags(width: int):
    def out(batches):
        for batch in batches:
            for _, texts in text_slices(batch, chars=SLICE_CHARS):
                bags = [(t, *shingles(t, width)) for t in texts if t is not None]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([content_key(*b) for b in bags], pa.binary()),
                        pa.array([b[1].tobytes() for b in bags], pa.binary()),
                        pa.array([b"" if (b[2] == 1).all() else b[2].astype("<u4").tobytes() for b in bags], pa.binary()),
                    ],
                    names=["key", "hashes", "counts"],
                )

    return out


def _bag(hashes: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(hashes, np.uint64)
    return h, np.frombuffer(counts, "<u4").astype(np.int64) if counts else np.ones(len(h), np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets (0 if either is empty)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    hit = a[0][at] == b[0]
    common = int(np.minimum(a[1][at[hit]], b[1][hit]).sum())
    return common / (int(a[1].sum()) + int(b[1].sum()) - common)


def _bag_slices(batch, hashes: list[str]):
    """Runs of rows whose multisets take about ``SLICE_BYTES``; a larger row is a run of its own."""
    size = sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in hashes)
    end = np.cumsum(size)
    a = 0
    while a < batch.num_rows:
        z = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + SLICE_BYTES, side="right")))
        yield batch.slice(a, z - a)
        a = z


def _verify(batches):
    for batch in (part for whole in batches for part in _bag_slices(whole, ["ha", "hb"])):
        cols = [batch.column(i).to_pylist() for i in range(6)]
        last, left = None, None
        sims = []
        for a, ha, ca, _b, hb, cb in zip(*cols):
            if a != last:
                last, left = a, _bag(ha, ca)
            sims.append(overlap(left, _bag(hb, cb)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(sims, pa.float64())], names=["a", "b", "j"])


def _block_links(threshold: float):
    """Links between different classes among the members of one (bounded) block.

    One pass over the block's shingles gives a member's overlap with all others. Of each
    member outside the largest class, one link to each other class is enough.
    """

    def links(block: pa.Table) -> pa.Table:
        keys, roots, main = (block[c].to_pylist() for c in ("key", "root", "main"))
        bags = [_bag(h, c) for h, c in zip(block["hashes"].to_pylist(), block["counts"].to_pylist())]
        _, at = np.unique(np.concatenate([b[0] for b in bags]), return_inverse=True)
        count = np.concatenate([b[1] for b in bags])
        begin = np.concatenate([[0], np.cumsum([len(b[0]) for b in bags])])
        total = np.array([b[1].sum() for b in bags])
        number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
        root = np.array([number[r] for r in roots])
        own = np.zeros(int(at.max()) + 1, np.int64)
        a, b, j = [], [], []
        for i in np.nonzero(~np.array(main))[0]:
            mine = slice(begin[i], begin[i + 1])
            own[at[mine]] = count[mine]
            common = np.add.reduceat(np.minimum(own[at], count), begin[:-1])
            own[at[mine]] = 0
            sim = common / (total + total[i] - common)
            hit = np.nonzero((sim >= threshold) & (root != root[i]))[0]
            for k in hit[np.unique(root[hit], return_index=True)[1]]:
                a.append(keys[i]), b.append(keys[k]), j.append(float(sim[k]))
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary()), "j": pa.array(j, pa.float64())})

    return links


def similarities(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """``(a, b, j)`` for the pairs of keys, by the true multiset overlap."""
    left = bags.select(F.col("key").alias("a"), F.col("hashes").alias("ha"), F.col("counts").alias("ca"))
    right = bags.select(F.col("key").alias("b"), F.col("hashes").alias("hb"), F.col("counts").alias("cb"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "ha", "ca", "b", "hb", "cb")
    return both.mapInArrow(_verify, "a binary, b binary, j double")


def _alike(total_a, total_b, threshold: float):
    """Necessary for a link: the smaller total is at least ``threshold`` of the larger."""
    return F.least(total_a, total_b) >= F.greatest(total_a, total_b) * F.lit(threshold - 1e-9)


def _rebucket(rows: int, bands: int, level: int):
    def sign(batches):
        for batch in batches:
            for part in (x.slice(a, 256) for x in _bag_slices(batch, ["hashes"]) for a in range(0, x.num_rows, 256)):
                bags = [_bag(h, c) for h, c in zip(part.column("hashes").to_pylist(), part.column("counts").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("total"), _lists(_signed(bags, rows, bands, level))], names=["key", "total", "buckets"])

    return sign


def _gathered(df: DataFrame, name: str) -> DataFrame:
    """``staged`` for a table far smaller than what it is made of: files of the advised size, not one per task."""
    return staged(df.hint("rebalance"), name)


def near_duplicates(docs: DataFrame, *, threshold: float = THRESHOLD, width: int = SHINGLE, levels=LEVELS, block: int = BLOCK, block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """``docs(doc_id, text)`` -> per row ``doc_id, key, class_key`` (null for a null text).

    ``key`` names the row's multiset, ``class_key`` its class.
    """
    spark = docs.sparkSession
    rows, bands = levels[0]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = staged(texts.mapInArrow(_first_pass(rows, bands, width), "doc_id bigint, key binary, total bigint, buckets array<bigint>"), "near-signed")
    nodes = signed.where("key is not null and total > 0").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.any_value("total").alias("total"), F.any_value("buckets").alias("buckets"))
    member = nodes.select("key", "doc_id", "total", F.explode("buckets").alias("bucket"))
    shared = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    member = _gathered(member.join(shared, "bucket", "left_semi"), "near-members")

    # the multisets of every text that shares a bucket, once
    wanted = member.groupBy("key").agg(F.any_value("doc_id").alias("doc_id"))
    only = wanted.select(F.col("doc_id").alias("w")).distinct().hint("merge")  # grows with the input: never broadcast
    once = texts.join(only, texts["doc_id"].eqNullSafe(only["w"]), "left_semi").withColumn("tie", F.xxhash64("text")).dropDuplicates(["doc_id", "tie"])
    bags = once.select("doc_id", "text").mapInArrow(_bags(width), "key binary, hashes binary, counts binary")
    bags = staged(bags.join(wanted.select("key"), "key", "left_semi").dropDuplicates(["key"]), "near-bags")

    roots = None  # node, root of the links verified so far

    def add(found: DataFrame):
        """Merge the classes that the links among ``found`` join."""
        nonlocal roots
        ok = found.where(F.col("j") >= threshold)
        if roots is None:
            roots = staged(components(ok), "near-roots")
            return
        at = [roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in ("a", "b")]
        cross = ok.join(at[0], "a", "left").join(at[1], "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        cross = staged(cross.where("a <> b").distinct(), "near-cross")
        if cross.isEmpty():
            return
        new = staged(components(cross), "near-merged")
        to = new.select(F.col("node").alias("root"), F.col("root").alias("to"))
        moved = roots.join(to, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        roots = staged(moved.unionByName(new.join(roots.select("node"), "node", "left_anti")), "near-roots")

    def with_root(m: DataFrame) -> DataFrame:
        r = roots.select(F.col("node").alias("key"), "root")
        return m.join(r, "key", "left").withColumn("root", F.coalesce("root", "key"))

    far = 1.0 - threshold
    for level in range(len(levels)):
        # 1. every member against the leader of its bucket
        first = F.min(F.struct(F.xxhash64("key", F.lit(level)).alias("o"), F.col("key").alias("k"))).alias("l")
        lead = member.groupBy("bucket").agg(F.count("*").alias("n"), first).where("n > 1").select("bucket", F.col("l.k").alias("a"))
        star = member.join(lead, "bucket").where("key <> a").select("bucket", "a", F.col("key").alias("b"), "total")
        tested = _gathered(similarities(star.select("a", "b").distinct(), bags), "near-tested")
        add(tested)
        # 2. what the leader leaves open
        known = star.join(tested.select("a", "b", (1.0 - F.col("j")).alias("d")), ["a", "b"])
        known = staged(with_root(known.select("bucket", F.col("b").alias("key"), "total", "d")), "near-known")
        nearest = F.min(F.when(F.col("d") > far + 1e-9, F.col("d"))).alias("nearest")  # unlinked member
        open_ = known.groupBy("bucket").agg(nearest, F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("bucket", "nearest")
        left = staged(known.join(open_, "bucket").where(F.col("d") >= F.col("nearest") - F.lit(far + 1e-9)).select("bucket", "key", "total", "root"), "near-left")
        classes_ = left.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.sum("total").alias("t"))
        sizes = classes_.groupBy("bucket").agg(F.sum("c").alias("n"), F.sum("t").alias("t"), F.max("c").alias("most"), F.max_by("root", "c").alias("top")).where("n > most")
        left = left.join(sizes, "bucket").withColumn("main", F.col("root") == F.col("top"))
        left = staged(left.select("bucket", "key", "total", "root", "main", ((F.col("n") <= block) & (F.col("t") <= block_shingles)).alias("one_block")), "near-left")
        # 3. a bounded remainder is compared as one block, links alone come out
        rest = left.where("one_block")
        if not rest.isEmpty():
            held = rest.select("bucket", "key", "main", "root").join(bags, "key")
            add(_gathered(held.groupBy("bucket").applyInArrow(_block_links(threshold), "a binary, b binary, j double"), "near-tested"))
        rest = left.where(~F.col("one_block")).drop("one_block")
        if rest.isEmpty():
            break
        if level + 1 == len(levels):
            # what is still together after the last level: pair by pair
            rest = staged(with_root(rest.drop("root")), "near-rest")
            x = rest.where(~F.col("main")).select("bucket", F.col("key").alias("a"), F.col("total").alias("ta"), F.col("root").alias("ra"))
            y = rest.select("bucket", F.col("key").alias("b"), F.col("total").alias("tb"), F.col("root").alias("rb"), F.col("main").alias("mb"))
            apart = (F.col("ra") != F.col("rb")) & (F.col("mb") | (F.col("a") < F.col("b")))
            pairs = x.join(y, "bucket").where(apart & _alike(F.col("ta"), F.col("tb"), threshold)).select("a", "b").distinct()
            add(_gathered(similarities(pairs, bags), "near-tested"))
            break
        # 4. a larger one is dealt out again by fresh signatures with more rows a band
        r, b = levels[level + 1]
        again = bags.join(rest.select("key", "total").distinct(), "key").mapInArrow(_rebucket(r, b, level + 1), "key binary, total bigint, buckets array<bigint>")
        member = again.select("key", "total", F.explode("buckets").alias("bucket"))
        shared = member.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
        member = _gathered(member.join(shared, "bucket", "left_semi"), "near-members")

    to = roots.select(F.col("node").alias("key"), F.col("root").alias("class_key"))
    return signed.select("doc_id", "key").join(to, "key", "left").select("doc_id", "key", F.coalesce("class_key", "key").alias("class_key"))


def classes(docs: DataFrame, **options) -> DataFrame:
    """Per document ``doc_id, class_id`` (smallest doc_id of its class) and ``class_rows``."""
    found = staged(near_duplicates(docs, **options), "near-classes")
    alone = found.where("class_key is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_rows"))
    every = found.where("class_key is not null").groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_rows"))
    return found.join(every, "class_key").select("doc_id", "class_id", "class_rows").unionByName(alone)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each class: its smallest doc_id (nulls last)."""
    found = staged(near_duplicates(docs, **options), "near-classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    stay = found.where("class_key is not null").groupBy("class_key").agg(first).select(F.col("first.doc_id").alias("s_id"), F.col("first.key").alias("s_key"))
    key, tie = fresh(docs, "key"), fresh(docs, "tie")

    def keys(batches):
        for batch in batches:
            for part, texts in text_slices(batch, chars=SLICE_CHARS):
                named = pa.array([content_key(t, *shingles(t, options.get("width", SHINGLE))) for t in texts], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, named], names=[*part.schema.names, key])

    schema = T.StructType([*docs.schema.fields, T.StructField(key, T.BinaryType())])
    named = docs.where(F.col("text").isNotNull()).mapInArrow(keys, schema)
    null_text = docs.where(F.col("text").isNull())
    stay = stay.withColumnsRenamed({"s_id": f"{key}_id", "s_key": f"{key}_key"})
    on = named["doc_id"].cast("long").eqNullSafe(stay[f"{key}_id"]) & (named[key] == stay[f"{key}_key"])
    kept = named.join(stay, on, "left_semi").dropDuplicates(["doc_id", key]).drop(key)
    return kept.unionByName(null_text)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))
