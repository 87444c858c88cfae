"""N-gram Jaccard join by parity sketches.

Each document is a set of 64-bit shingle hashes. Its sketch XORs every hash into one of k words,
where k depends only on the set's size octave, so two sets that differ in D shingles differ in at most
D words: the number of unequal words bounds the symmetric difference from below. Linked sets differ in
at most d = floor(size * (den - num) / num) shingles (see ``max_difference``), so of the k words k - d at
least are equal. A set offers only its d + 1 fullest words as join keys: the fullest word that both share
untouched has k - d - 1 lighter untouched ones below it, in either set, and so both offer it. Words with
few shingles, which would collide on passages that many documents share, are thus never joined on, and no
link is lost. How full a word is counts the shingles outside a list of frequent ones first: the list comes from
a bounded sample, but as any fixed order of the words keeps the argument, it changes only which keys are
offered, never which links are found. Sets near an octave's upper end offer keys for the next octave as well.

Candidates pass a second, bit-wise parity sketch (one bit flipped a shingle; Hamming distance is at most the
symmetric difference) and are verified on the exact sets. Copies are folded into one representative first. Within a key
each document is first paired with the key's least document only; the few that remain in other components
are then paired with each other, so a group of n near copies costs about n pairs, not n * n. A key that many documents
of several components share (a passage that they have in common) is split by a second word first: the two fullest words
that linked sets share untouched lie among either set's d + 2 fullest, in the same order, so a linked pair whose
fullest such word is that key also meets under the key joined with the second word. Documents that share several keys
may be paired under each, and the plausible pairs are made distinct.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from listenlake.llm import _text as T
from listenlake.llm._graph import connected_components
from listenlake.runtime import discard, materialize, ship_package

_U = np.uint64
#: Document ids (8 bytes each) up to which a set of them is broadcast.
BROADCAST_IDS = 1_000_000
#: Documents of a key beyond which it is split by a second word, if they are also this many times the words that a document offers.
HOT_DOCS, HOT_RATIO = 2048, 2


def max_difference(size: int, num: int, den: int) -> int:
    """Most shingles by which a set of this size can differ from one with num/den similarity."""
    return size * (den - num) // num


def octave_words(octave: int, num: int, den: int) -> int:
    """Sketch words for sets of 2**octave to 2**(octave+1) - 1 shingles: half as many again as the largest needs."""
    return max(3, (3 * (max_difference(2 << octave, num, den) + 1) + 1) // 2)


def shingle_sets(texts: pa.Array, width: int):
    """Per row the sorted distinct 64-bit hashes of its shingles of ``width`` words."""
    buf, offs = T.flat(texts)
    buf = T.LOWER[buf]
    starts, ends, first = T.words(buf, offs, T.SPACE)
    h = T.span_hashes(buf, starts, ends)
    rolled = T.rolling(h, width)
    for i in range(len(offs) - 1):
        a, b = int(first[i]), int(first[i + 1])
        if b - a >= width:
            yield np.unique(rolled[a : b - width + 1])
        elif b > a:
            yield np.array([T.sequence_hash(h[a:b])], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def bit_sketch(u: np.ndarray) -> np.ndarray:
    """Parity of the shingles that fall on each of 2**(octave + 1) bits, 64 at least, as 64-bit words."""
    b = max(64, 1 << len(u).bit_length())
    parity = np.bincount((u & _U(b - 1)).astype(np.int64), minlength=b).astype(np.uint8) & 1
    return np.packbits(parity, bitorder="little").view(np.int64)


def hamming(x: str, y: str) -> Column:
    """Hamming distance of two bit sketches; the one of the larger octave is folded in two."""

    def folded(a: str, b: str) -> Column:
        m = F.size(b)
        return F.when(F.size(a) > m, F.zip_with(F.slice(a, 1, m), F.slice(a, m + 1, m), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(a))

    return F.aggregate(F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda p, q: p + q)


def signatures(u: np.ndarray, num: int, den: int, common: np.ndarray) -> list[np.ndarray]:
    """For one octave or two, one set's d + 2 fullest sketch words in order; all but the last are join keys. common: frequent shingles, sorted."""
    n = len(u)
    d = max_difference(n, num, den)
    if d == 0:
        return []  # only an equal set is similar enough
    own = n.bit_length() - 1
    at = np.minimum(np.searchsorted(common, u), max(len(common) - 1, 0))
    rare = common[at] != u if len(common) else np.ones(n, bool)
    out = []
    for octave in sorted({own, (n + d).bit_length() - 1}):
        k = octave_words(octave, num, den)
        word = ((u >> _U(32)) * _U(k) >> _U(32)).astype(np.int64)  # ascends with u
        weight = np.bincount(word, minlength=k)
        sketch = np.zeros(k, np.uint64)
        used = np.flatnonzero(weight)
        sketch[used] = np.bitwise_xor.reduceat(u, (np.cumsum(weight) - weight)[used])
        own_weight = np.bincount(word[rare], minlength=k)
        top = np.argsort(-(own_weight * (n + 1) + weight), kind="stable")[: d + 2]
        out.append(T.mix64(sketch[top] + top.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(octave * 0xA24BAED4963EE407 % 2**64)))
    return out


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    """Arrays of 64-bit integers as a list column."""
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    values = np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(ends, pa.array(values))


def _nested(rows: list[list[np.ndarray]]) -> pa.ListArray:
    """Lists of arrays of 64-bit integers as a column."""
    ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(ends, _lists([p for r in rows for p in r]))


def _features(width: int, num: int, den: int, common):
    def run(batches):
        frequent = common.value
        for b in T.pieces(batches):
            n, d1, d2, sigs, bits = [], [], [], [], []
            for u in shingle_sets(b.column(1), width):
                n.append(len(u))
                d1.append(u.sum(dtype=np.uint64) if len(u) else _U(0))
                d2.append(np.bitwise_xor.reduce(T.mix64(u + _U(1))) if len(u) else _U(0))
                sigs.append(signatures(u, num, den, frequent))
                bits.append(bit_sketch(u))
            yield pa.record_batch(
                [
                    b.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(d1, np.uint64).view(np.int64)),
                    pa.array(np.array(d2, np.uint64).view(np.int64)),
                    _nested(sigs),
                    _lists(bits),
                ],
                names=["doc_id", "n", "d1", "d2", "sigs", "bits"],
            )

    return run


def _sets(width: int):
    def run(batches):
        for b in T.pieces(batches):
            yield pa.record_batch([b.column(0), _lists(list(shingle_sets(b.column(1), width)))], names=["doc_id", "shingles"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of pairs (a, b) those whose sets are similar enough."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return pairs.join(right, "b").join(left, "a").where(den * both >= num * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _frequent(rows: DataFrame, width: int, sample_docs: int, least: int, most: int) -> np.ndarray:
    """At most ``most`` shingles that ``least`` or more of about ``sample_docs`` documents hold, sorted."""
    step = max(1, rows.count() // sample_docs)
    some = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0)
    held = some.mapInArrow(_sets(width), "doc_id long, shingles array<long>").select(F.explode("shingles").alias("s"))
    top = held.groupBy("s").count().where(F.col("count") >= least).orderBy(F.desc("count"), "s").limit(most).collect()
    return np.sort(np.array([r[0] for r in top], np.int64).view(np.uint64))


def _plausible(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, na, nb, ba, bb) whose sizes and bit sketches allow a link."""
    total = F.col("na") + F.col("nb")
    return pairs.where((den * F.least("na", "nb") >= num * F.greatest("na", "nb")) & ((num + den) * hamming("ba", "bb") <= (den - num) * total))


def _split(rows: DataFrame, offered: DataFrame) -> DataFrame:
    """Rows (key, doc_id, c, docs) of open keys as (key, doc_id, c), the keys of many documents joined with each further word.

    A large key is split only where its documents outnumber the words that any of them offers: then the split makes
    fewer rows than the pairs that it saves. Rows hold no list of their document's keys: its length times their number would outgrow the texts.
    """
    words = offered.select("doc_id", "sigs").dropDuplicates(["doc_id"])
    large = rows.where(F.col("docs") > HOT_DOCS).join(words, "doc_id")
    own = F.filter("sigs", lambda x: F.array_contains(x, F.col("key")))[0]
    large = large.select("key", "doc_id", "c", "docs", own.alias("own"))
    pays = large.groupBy("key").agg(F.max(F.size("own")).alias("words"), F.first("docs").alias("docs")).where(F.col("docs") > HOT_RATIO * F.col("words")).select("key")
    pays = materialize(pays, "jaccard-hot-keys")
    later = F.expr("transform(slice(own, array_position(own, key) + 1, size(own)), x -> xxhash64(key, x))")
    finer = materialize(large.join(pays, "key").select(F.explode(later).alias("key"), "doc_id", "c"), "jaccard-finer")
    several = materialize(finer.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key"), "jaccard-finer-keys")
    names = ["key", "doc_id", "c"]
    return rows.join(pays, "key", "left_anti").select(*names).union(finer.join(several, "key").select(*names))


def ngram_jaccard_components(
    docs: DataFrame, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 4096, sample_least: int = 5, sample_most: int = 50_000
) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (the least doc_id that links reach).

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased; a set holds the distinct shingles of
    ``width`` words, or the whole sequence where there are fewer. Two documents link when den * intersection >=
    num * union; a document without words links with nothing. Null text counts as empty. A row with a null id
    is returned with a null component. doc_id identifies a document: repeated rows are returned as often as
    they come. Other columns are ignored; an empty table gives an empty one.

    ``sample_*`` bound the list of frequent shingles (see the module); links don't depend on them.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    common = spark.sparkContext.broadcast(_frequent(rows, width, sample_docs, sample_least, sample_most))
    feats = materialize(rows.mapInArrow(_features(width, num, den, common), "doc_id long, n long, d1 long, d2 long, sigs array<array<long>>, bits array<long>"), "jaccard-features")
    # Tables that hold a row a group are written before they are joined: then Spark can split a hot group on the other side.
    reps = materialize(feats.where("n > 0").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep")), "jaccard-reps")
    members = materialize(feats.select("doc_id", "n", "d1", "d2").join(reps, ["n", "d1", "d2"], "left").select("doc_id", "n", "rep"), "jaccard-members")
    alone = members.where("doc_id = rep").select("doc_id").distinct()
    offered = materialize(feats.select("doc_id", "n", "bits", "sigs").join(alone, "doc_id", "left_semi"), "jaccard-offered")
    discard(feats, reps)
    keys = offered.select("doc_id", F.explode(F.flatten(F.transform("sigs", lambda x: F.slice(x, F.lit(1), F.size(x) - 1)))).alias("key"))
    several = materialize(keys.groupBy("key").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last")).where("lead < last").drop("last"), "jaccard-keys")
    shared = materialize(keys.join(several, "key"), "jaccard-shared")
    some = shared.select("doc_id").distinct()
    sketches = materialize(offered.select("doc_id", "n", "bits").join(some, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "jaccard-sketches")
    sketch = lambda i: sketches.select(F.col("doc_id").alias(i), F.col("n").alias(f"n{i}"), F.col("bits").alias(f"b{i}"))
    stars = shared.where("doc_id <> lead").select(F.col("lead").alias("a"), F.col("doc_id").alias("b")).distinct()
    tried = materialize(_plausible(stars.join(sketch("b"), "b").join(sketch("a"), "a"), num, den).select("a", "b"), "jaccard-pairs")

    def sets(pairs: DataFrame) -> DataFrame:
        ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "jaccard-ids")
        ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids.hint("merge")  # few documents: their texts needn't be shuffled
        own = rows.join(ids, "doc_id", "left_semi").mapInArrow(_sets(width), "doc_id long, shingles array<long>")
        return materialize(own.dropDuplicates(["doc_id"]), "jaccard-sets")

    links = materialize(_verified(tried, sets(tried), num, den), "jaccard-links")
    label = connected_components(links)

    # Keys whose documents are still in several components: pair those across components.
    known = sketches.join(label.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n", "bits", F.coalesce("component", "doc_id").alias("c"))
    labelled = materialize(shared.select("key", "doc_id").join(known.select("doc_id", "c"), "doc_id"), "jaccard-labelled")
    grouped = labelled.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("docs"))
    open_keys = materialize(grouped.where("c0 < c1").select("key", "docs"), "jaccard-open-keys")
    rest = materialize(_split(labelled.join(open_keys, "key"), offered).join(known.select("doc_id", "n", "bits"), "doc_id"), "jaccard-open")
    side = lambda i: rest.select("key", *[F.col(c).alias(f"{short}{i}") for c, short in (("doc_id", ""), ("n", "n"), ("bits", "b"), ("c", "c"))])
    met = side("a").join(side("b"), "key").where("a < b AND ca <> cb")
    across = materialize(_plausible(met, num, den).select("a", "b").distinct(), "jaccard-across")
    across = materialize(across.join(tried, ["a", "b"], "left_anti"), "jaccard-pairs")
    if not across.isEmpty():
        more = materialize(_verified(across, sets(across), num, den), "jaccard-links")
        if not more.isEmpty():
            label = connected_components(links.union(more))
    heads = label.select(F.col("node").alias("rep"), "component")
    discard(offered, several, shared, sketches, labelled, open_keys, rest)
    return members.join(heads, "rep", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id")
    )
