"""N-gram Jaccard join by prefixes of tokens and token combinations.

A document's set holds the fingerprints of its distinct shingles of five words. All sets are in one order: rare tokens
before frequent ones, and each class by fingerprint. Two sets of similarity t or more share s tokens of their prefixes
if these are s - 1 tokens longer than for one. Frequent tokens are dealt into g groups by hash, and prefixes extended by
g tokens: of g + 1 shared ones either one is rare, or two frequent ones are of one group. So documents are indexed by
each rare token of the extended prefix and by each combination of two frequent tokens of a group. g grows with the set,
by powers of two, so that a group has a few tokens and combinations stay in proportion to the set; a set that may link
with smaller ones of another g is indexed with both.

Which tokens count as frequent changes the cost alone: any choice gives every link. They are found by counts over all
documents, in which tokens seen once in a stretch of a task drop out, and are bounded in number.

Links are needed as components. Equal sets are one class from the start. Then each class is verified against one hub,
the class of fewest rare tokens in most of the index entries it stands in; components of these links come first, and
only classes that share an entry and are still apart are verified pair by pair: those of entries with few classes by a
join, those of large entries in blocks, from which only pairs come out that bitmaps let pass. No link between different
components is left out.

A pair is verified in two steps: parity bitmaps of the sets bound their difference from below, so most pairs that are
no link drop out by a few words each; whole sets are compared for the rest.

Classes are told apart by 120 bits of their sets: their short name of 56 bits serves for joins, and where two classes
have the same one, both take another (``twins``).

Scale: index rows are about a quarter of all shingles, grouped with partial aggregation; entries of one class are
dropped by the first grouping. Whole sets are made of classes that share an entry only. Rows of empty sets meet nothing,
and classes that hold more than a thousandth of all rows are joined by broadcast.

Cases: a null or empty text has an empty set and stays alone; fewer than five words are one shingle; very long texts are
read whole, in arrays of some 60 bytes a word; repeated rows and ties come under the smallest doc_id; rows without a
doc_id belong to the component of the rows with an id that have an equal set, else to none (null); an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from fathomline.llm.common import LOWER, STEP, U64, chunks, cut, frugal, if_small, join_spread, mix, owner, spans_hash, word_hashes, words
from fathomline.llm.graph import connected

N = 5
#: Similarity from which two sets link, in hundredths.
PERCENT = 80
#: A token this often seen counts as frequent; at most so many of the most frequent do (8 bytes each on every executor).
FREQUENT, MOST_FREQUENT = 16, 1 << 18
#: Tokens of a task that are counted together.
STRETCH = 1 << 21
#: Shingles of a set for each group of frequent tokens, twice as many at most.
GROUP = 16
#: 64-bit words of a set's parity bitmap at least; a power of two.
BITMAP = 16
#: Classes of an index entry up to which it is joined with itself; beyond, blocks of so many classes meet.
SMALL_GROUP, BLOCK = 16, 4096
#: Pairs of one class that are verified together.
SPOKES = 64
#: Bits of index keys; what falls together by chance is told apart when verified.
KEY_BITS = 48
#: Short names of classes that fall together by chance: n * n / 2 ** 57 of n classes are expected.
MOST_TWINS = 1 << 20


def shingles(data: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of each text, and the first index of each text's."""
    low = LOWER[data]
    starts, ends, first = words(low, offsets)
    hashes = word_hashes(low, starts, ends)
    text = owner(first)
    size = np.diff(first)
    whole = np.flatnonzero(text[n - 1 :] == text[: len(text) - n + 1]) if len(text) >= n else np.zeros(0, np.int64)
    short = np.flatnonzero((size > 0) & (size < n))
    begin = np.concatenate([whole, first[short]])
    end = np.concatenate([whole + n, first[short + 1]])
    own = np.concatenate([text[whole], short])
    token = spans_hash(hashes, begin, end)
    order = np.lexsort((token, own))
    token, own = token[order], own[order]
    fresh = np.ones(len(token), bool)
    fresh[1:] = (token[1:] != token[:-1]) | (own[1:] != own[:-1])
    token, own = token[fresh], own[fresh]
    return token, np.searchsorted(own, np.arange(len(offsets)))


def signatures(token: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of each set, whatever its order; 0 for empty sets."""
    out = []
    for salt in (U64(11), STEP):
        total = np.zeros(len(token) + 1, U64)
        np.cumsum(mix(token ^ salt), out=total[1:])
        out.append(np.where(np.diff(first) > 0, mix(total[first[1:]] - total[first[:-1]]), U64(0)))
    return out[0], out[1]


def survey(docs: DataFrame) -> DataFrame:
    """Rows of two kinds: (0, doc_id, two signatures, size, bitmap) of documents and (1, token, count) of tokens seen
    twice."""
    schema = "kind int, a long, b long, c long, n long, bits array<long>"

    def rows(kind: int, *columns) -> pa.RecordBatch:
        columns = [np.asarray(c).view(np.int64) if getattr(c, "dtype", None) == U64 else c for c in columns]
        n = len(columns[0])
        bits = columns.pop() if kind == 0 else pa.nulls(n, pa.list_(pa.int64()))
        columns += [np.zeros(n, np.int64)] * (4 - len(columns))
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(c if isinstance(c, pa.Array) else pa.array(c) for c in columns), bits], names=["kind", "a", "b", "c", "n", "bits"])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                token, first = shingles(data, offsets)
                one, two = signatures(token, first)
                one = one >> U64(8)
                yield rows(0, batch.column(0)[a:b], one, two, np.diff(first), bitmaps(token, first))
                held.append(token)
                size += len(token)
                if size >= STRETCH:
                    yield rows(1, *twice(held))
                    held, size = [], 0
        if held:
            yield rows(1, *twice(held))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def twice(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    token = np.sort(np.concatenate(held))
    head = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]])) if len(token) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate([head, [len(token)]]))
    return token[head][n > 1], n[n > 1].astype(np.int64)


def names_of(token: np.ndarray, first: np.ndarray, twins: np.ndarray) -> np.ndarray:
    """Short name of each set: 56 bits of its first signature, or of its second where two sets share the first."""
    one, two = (x >> U64(8) for x in signatures(token, first))
    return np.where(is_common(one, twins), two, one)


def is_common(token: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(token), bool)
    return frequent[np.minimum(np.searchsorted(frequent, token), len(frequent) - 1)] == token


def groups_of(size: np.ndarray) -> np.ndarray:
    """Groups of frequent tokens for sets of these sizes: powers of two."""
    return 1 << np.maximum(np.log2(np.maximum(size // GROUP, 1)).astype(np.int64), 0)


def keys_of(token: np.ndarray, first: np.ndarray, frequent: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Index keys and the text of each."""
    own, size = owner(first), np.diff(first)
    common = is_common(token, frequent)
    order = np.lexsort((token, common, own))
    token, common = token[order], common[order]
    place = np.arange(len(token)) - first[own]
    least = -(-percent * size // 100)
    prefix, groups = size - least + 1, groups_of(size)  # a prefix of one shared token
    rare = ~common & (place < (prefix + groups)[own])
    keys, texts = [mix(token[rare])], [own[rare]]
    smallest = groups_of(least)  # of any set that this one may link with
    while True:
        pair = np.flatnonzero(common & (place < (prefix + groups)[own]) & (groups >= smallest)[own])
        if not len(pair):
            break
        group = own[pair] * (int(groups.max()) + 1) + (mix(token[pair] ^ U64(55)) % groups[own[pair]].astype(U64)).astype(np.int64)
        order = np.lexsort((token[pair], group))
        pair, group = pair[order], group[order]
        gap = 1
        while len(pair) > gap:  # combinations of two tokens ``gap`` apart
            same = group[gap:] == group[:-gap]
            if not same.any():
                break
            left, right = pair[:-gap][same], pair[gap:][same]
            keys.append(mix(mix(token[left]) * U64(3) + token[right]))
            texts.append(own[left])
            gap += 1
        groups = groups // 2
    return np.concatenate(keys), np.concatenate(texts)


def index(docs: DataFrame, frequent, twins: np.ndarray, percent: int) -> DataFrame:
    """(key, sig) of every document with two shingles or more.

    The top byte of this name tells which part of a set is rare, so that the least name of an entry is that
    of the set most like all others in it.
    """

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in chunks(batch.column(0)):
                token, first = shingles(data, offsets)
                common = np.concatenate([[0], np.cumsum(is_common(token, frequent.value))])[first]
                rare = 127 - (127 * np.diff(common)) // np.maximum(np.diff(first), 1)
                sig = names_of(token, first, twins) | rare.astype(U64) << U64(56)
                key, text = keys_of(token, first, frequent.value, percent)
                use = np.diff(first)[text] > 1
                yield pa.RecordBatch.from_arrays([pa.array((key[use] >> U64(64 - KEY_BITS)).view(np.int64)), pa.array(sig[text[use]].view(np.int64))], names=["key", "sig"])

    return docs.select("text").mapInArrow(run, "key long, sig long")


def bitmaps(token: np.ndarray, first: np.ndarray) -> pa.Array:
    """A list of words for each set; a bit is on if an odd number of tokens falls on it.

    A set has two bits a token at least, in a power of two of words; the upper half of a bitmap folds onto the lower.
    """
    size = np.diff(first)
    length = np.full(len(size), BITMAP)
    while (short := 32 * length < size).any():
        length[short] *= 2
    begin = np.concatenate([[0], np.cumsum(length)])
    own = owner(first)
    spot = (mix(token ^ U64(77)) & (64 * length[own] - 1).astype(U64)).astype(np.int64) + 64 * begin[own]
    odd = np.zeros(64 * begin[-1], np.uint8)
    at, n = np.unique(spot, return_counts=True)
    odd[at] = n & 1
    return pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(np.packbits(odd).view(np.int64)))


def sets_of(docs: DataFrame, twins: np.ndarray) -> DataFrame:
    """(at, part, sig, tokens) of the documents (at, part, sig, text)."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(3)):
                token, first = shingles(data, offsets)
                at, part, given = (batch.column(c)[a:b] for c in range(3))
                # rows that share the doc_id but hold another text are not meant
                same = names_of(token, first, twins).view(np.int64) == given.to_numpy()
                token, (at, part, given) = token[same[owner(first)]], (x.filter(pa.array(same)) for x in (at, part, given))
                first = np.concatenate([[0], np.cumsum(np.diff(first)[same])])
                yield pa.RecordBatch.from_arrays([at, part, given, pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(token.view(np.int64)))], names=["at", "part", "sig", "tokens"])

    return docs.select("at", "part", "sig", "text").mapInArrow(run, "at long, part int, sig long, tokens array<long>")


def links(pairs: DataFrame, docs: DataFrame, classes: DataFrame, twins: np.ndarray, percent: int) -> DataFrame:
    """Of the pairs (u, v), as ``cut`` wrote them, those whose sets are similar; ``classes`` has sig, doc_id, n and bits.

    A class that is the second of many pairs meets them in parts of about SPOKES pairs.
    """
    hubs = cut(pairs.groupBy("v").agg(F.count("*").alias("rows_of_key"), F.ceil(F.count("*") / SPOKES).cast("int").alias("parts")))
    pairs = join_spread(pairs, hubs, ["v"], pairs.count()).select("u", "v", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int").alias("part"))
    side = lambda key: classes.select(F.col("sig").alias(key), F.col("n").alias(f"n_{key}"), F.col("bits").alias(f"bits_{key}"))
    least = F.least(F.size("bits_u"), F.size("bits_v"))
    both = lambda x, y: F.zip_with(x, y, lambda p, q: p.bitwiseXOR(q))
    # sets of near sizes have bitmaps of one length, or one twice as long as the other
    folded = lambda c: F.when(F.size(c) > least, both(F.slice(c, F.lit(1), least), F.slice(c, least + 1, least))).otherwise(F.col(c))
    differ = F.aggregate(both(folded("bits_u"), folded("bits_v")), F.lit(0), lambda a, x: a + F.bit_count(x))
    # shared tokens are at most half of what the sizes leave besides the difference
    most = F.floor((F.col("n_u") + F.col("n_v") - differ) / 2)
    parts = hubs.join(side("v"), "v").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("rows_of_key", "parts")
    near = pairs.join(side("u"), "u").join(parts, ["v", "part"])
    near = cut(near.filter((100 * F.least("n_u", "n_v") >= percent * F.greatest("n_u", "n_v")) & (100 * most >= percent * (F.col("n_u") + F.col("n_v") - most))).select("u", "v", "part"))
    # whole sets go to where the second class of their pair is
    place = lambda sig: near.select(F.col("v").alias("at"), "part", F.col(sig).alias("sig"))
    wanted = place("u").unionByName(place("v").distinct())
    wanted = cut(wanted.join(classes.select("sig", "doc_id"), "sig"))
    sets = sets_of(docs.join(if_small(wanted), "doc_id"), twins)
    left = sets.filter("sig <> at").select(F.col("at").alias("v"), "part", F.col("sig").alias("u"), F.col("tokens").alias("x"))
    right = sets.filter("sig = at").select(F.col("at").alias("v"), "part", F.col("tokens").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    sizes = F.size("x") + F.size("y")
    return cut(left.join(right, ["v", "part"]).filter(100 * shared >= percent * (sizes - shared)).select("u", "v").distinct())


def small_groups(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) of classes of different roots and near sizes that share an entry of few classes."""
    left = rows.select("key", F.col("sig").alias("u"), F.col("root").alias("r"), F.col("n").alias("x"))
    right = rows.select("key", F.col("sig").alias("v"), F.col("root").alias("s"), F.col("n").alias("y"))
    met = left.join(right, "key").filter((F.col("u") > F.col("v")) & (F.col("r") != F.col("s")) & (100 * F.least("x", "y") >= percent * F.greatest("x", "y")))
    return met.select("u", "v")


def large_groups(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The same for entries of many classes: blocks of them meet, and only pairs that bitmaps let pass come out."""
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("sig"), blocks).cast("int")
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda j: F.struct(F.least(own, j).alias("i"), F.greatest(own, j).alias("j")))
    dealt = rows.withColumn("own", own).withColumn("at", F.explode(others)).select("key", "at.i", "at.j", "own", "sig", "root", "n")
    dealt = dealt.join(classes.select("sig", "bits"), "sig")

    def meet(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        sig, root, n, own = (table[c].to_numpy() for c in ("sig", "root", "n", "own"))
        bits = table["bits"].chunk(0)
        begin = bits.offsets.to_numpy()
        words_of, flat = np.diff(begin), bits.flatten().to_numpy().view(U64)
        begin = begin[:-1] - begin[0]
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        found = [np.zeros((2, 0), np.int64)]
        for length in np.unique(words_of).tolist():
            left, right = np.flatnonzero((own == i) & (words_of == length)), np.flatnonzero((own == j) & (words_of == length))
            one = flat[begin[left][:, None] + np.arange(length)]
            sides = [(right, flat[begin[right][:, None] + np.arange(length)], left, one)]
            for x, y in ((i, j), (j, i))[: 1 + (i != j)]:  # and with those whose bitmaps are twice as long
                small, big = np.flatnonzero((own == x) & (words_of == length)), np.flatnonzero((own == y) & (words_of == 2 * length))
                if len(small) and len(big):
                    wide = flat[begin[big][:, None] + np.arange(2 * length)]
                    sides.append((small, flat[begin[small][:, None] + np.arange(length)], big, wide[:, :length] ^ wide[:, length:]))
            for many, their, few, own_bits in sides:
                for at, mine in zip(few.tolist(), own_bits, strict=True):
                    differ = np.bitwise_count(their ^ mine).sum(axis=1).astype(np.int64)
                    both = n[many] + n[at]
                    most = (both - differ) // 2
                    ok = (root[many] != root[at]) & (100 * np.minimum(n[many], n[at]) >= percent * np.maximum(n[many], n[at])) & (100 * most >= percent * (both - most))
                    hit = sig[many[ok]]
                    found.append(np.stack([np.maximum(hit, sig[at]), np.minimum(hit, sig[at])]))
        u, v = np.unique(np.concatenate(found, axis=1), axis=1)
        return pa.table({"u": pa.array(u), "v": pa.array(v)})

    return dealt.groupBy("key", "i", "j").applyInArrow(meet, "u long, v long")


def told_apart(members: DataFrame) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Members and classes with one short name a class, and the names that two classes had."""
    classes = members.filter("n_shingles > 0").groupBy("sig", "sig2").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), F.count("*").alias("rows_of_key"))
    classes = cut(classes)
    # bounded by chance, and checked: a name of 56 bits is rarely that of two classes
    doubled = lambda df: df.groupBy("sig").count().filter("count > 1").select("sig")
    found = doubled(classes).limit(MOST_TWINS + 1).toArrow()["sig"].to_numpy()
    if not len(found):
        return members, classes, np.zeros(0, U64)
    if len(found) > MOST_TWINS:
        raise RuntimeError("too many classes share a short name")
    twins = F.broadcast(members.sparkSession.createDataFrame([(int(x),) for x in found], "twin long"))
    rename = lambda df: df.join(twins, F.col("sig") == F.col("twin"), "left").withColumn("sig", F.when(F.col("twin").isNull(), F.col("sig")).otherwise(F.shiftrightunsigned("sig2", 8))).drop("twin")
    members, classes = rename(members), cut(rename(classes))
    if doubled(classes).limit(1).count():
        raise RuntimeError("two classes share both their names")
    return members, classes, np.sort(np.asarray(found, np.int64).view(U64))


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every row."""
    if not 50 <= percent <= 100:
        raise ValueError("similarities from 50 to 100 hundredths are indexed")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    seen = cut(survey(docs))
    members = seen.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("sig"), F.col("c").alias("sig2"), F.col("n").alias("n_shingles"), "bits")
    counted = seen.filter("kind = 1").groupBy(F.col("a").alias("token")).agg(F.sum("b").alias("n")).filter(F.col("n") >= FREQUENT)
    # bounded: at most MOST_FREQUENT numbers
    top = counted.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").toArrow()["token"].to_numpy()
    frequent = spark.sparkContext.broadcast(np.sort(np.asarray(top, np.int64).view(U64)))
    members, classes, twins = told_apart(members)

    entries = index(docs, frequent, twins, percent)
    hubs = entries.groupBy("key").agg(F.min("sig").alias("hub"), F.max("sig").alias("most")).filter("hub < most").drop("most")
    plain = lambda c: F.col(c).bitwiseAND(F.lit((1 << 56) - 1)).alias(c)
    shared = cut(entries.join(hubs, "key").distinct().select("key", plain("sig"), plain("hub")))
    # one hub a class: that of most of its entries
    votes = shared.filter("sig <> hub").groupBy("sig", "hub").agg(F.count("*").alias("n"))
    stars = cut(votes.groupBy(F.col("sig").alias("u")).agg(F.max(F.struct("n", "hub"))["hub"].alias("v")))
    first = links(stars, docs, classes, twins, percent)
    roots = cut(connected(first))

    known = classes.select("sig", "n").join(roots.withColumnRenamed("node", "sig"), "sig", "left").select("sig", "n", F.coalesce("root", "sig").alias("root"))
    labelled = shared.select("key", "sig").join(known, "sig")
    apart = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).filter("low < high").select("key", "m")
    open_rows = cut(labelled.join(apart, "key"))
    pairs = small_groups(open_rows.filter(F.col("m") <= SMALL_GROUP), percent).unionByName(large_groups(open_rows.filter(F.col("m") > SMALL_GROUP), classes, percent)).distinct()
    tried = stars.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    late = links(cut(pairs.join(tried, ["u", "v"], "left_anti")), docs, classes, twins, percent)
    every = cut(connected(first.unionByName(late)))

    named = every.join(classes.select(F.col("sig").alias("node"), "doc_id"), "node")
    least = named.join(named.groupBy("root").agg(F.min("doc_id").alias("component")), "root").groupBy(F.col("node").alias("sig")).agg(F.min("component").alias("component"))
    final = cut(classes.join(least, "sig", "left").select("sig", "sig2", F.coalesce("component", "doc_id").alias("component_id"), "rows_of_key"))
    members = members.drop("bits")
    out = join_spread(members.filter("n_shingles > 0"), final, ["sig", "sig2"], seen.filter("kind = 0").count())
    alone = members.filter("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    return out.unionByName(alone).select("doc_id", "n_shingles", "component_id")
