"""Jaccard join of documents on word shingles, with token-combination prefixes.

Two sets x and y with Jaccard similarity of at least t share at least ceil(t |x|) tokens of x, so at most
e = |x| - ceil(t |x|) tokens of x are missing from y. Tokens are ordered: rare ones first, then frequent ones, by hash
within either class. A document indexes the tokens of the shortest prefix that survives e losses: a rare token is a
signature by itself; frequent tokens fall into subclasses and are indexed as pairs within a subclass, where n tokens
survive n - 1 losses. The prefix is extended until the losses it survives exceed e. Of two similar sets, the prefix
that ends first in the order is contained, but for its losses, in the other one; so they share a signature (pigeonhole),
and none is lost. How many subclasses there are follows from the size class of the set (powers of 1/t): similar sets
lie in the same or adjacent classes, so that every set indexes its pairs for its own class and the next.

Which tokens are frequent comes from counts over all documents in a fixed number of hash buckets; any choice gives the
same results. Sets that meet at a pair of frequent tokens have indexed all their rare ones, so unless they meet at one of those
too, all of them are losses; where these are too many, the pair is left out. Copies are one set. Within the documents of a signature, each is verified against one leader; components
follow; then only pairs that still lie in different components are verified. So a group of near copies costs links in
proportion to its size, and no link between different components is lost.

Defined results: null texts and texts without words have an empty set and link with nothing; texts with fewer words
than a shingle have their whole sequence as the one shingle; repeated rows and copies share a component; a null doc_id
gets a null component and names none; other columns are ignored; an empty table gives an empty result. Texts of any
length are hashed whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cut
from .components import components
from .shingles import _FACTORS, mix, set_identity, shingle_sets

#: Buckets of the token counts, and bits of the filter for candidates: both bound what is broadcast (16 KB and 2 MB).
COUNT_BUCKETS = 1 << 17
FILTER_BITS = 1 << 24
#: Shared signatures that a set names to tell where its pairs are handled.
LEAST_SHARED = 8
#: Words of parities that go with every shared signature; a longer set's are folded to so many there.
SHORT_WORDS = 16


def _parities(tokens: np.ndarray) -> np.ndarray:
    """Bits, a power of two and one a token at least: of the tokens that fall on each, whether their number is odd. In the
    xor of two sets' bits, each that is set stands for a token at least that only one of them has. Twice as many bits
    fold into half of them by xor."""
    bits = max(64, 1 << (len(tokens) - 1).bit_length())
    odd = np.bincount(((tokens >> np.uint64(40)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _folded(bits: np.ndarray) -> np.ndarray:
    while len(bits) > SHORT_WORDS:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


class _Parities:
    """Parities of many sets, comparable in bulk: for each width, those of that width and those of twice as many bits."""

    def __init__(self, column: pa.Array):
        flat = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        self.width = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        start = np.cumsum(self.width) - self.width
        self.at, self.bits = np.zeros((2, len(self.width)), np.int64), {}
        for w in np.unique(self.width):
            own, double = np.flatnonzero(self.width == w), np.flatnonzero(self.width == 2 * w)
            wide = flat[start[double][:, None] + np.arange(2 * w)]
            self.bits[w] = np.concatenate([flat[start[own][:, None] + np.arange(w)], wide[:, :w] ^ wide[:, w:]])
            self.at[0, own], self.at[1, double] = np.arange(len(own)), len(own) + np.arange(len(double))

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """At least so many tokens are in one of the sets i and j only (widths of a pair differ by a factor of two at most)."""
        out, least = np.zeros(len(i), np.int64), np.minimum(self.width[i], self.width[j])
        for w in np.unique(least):
            where = np.flatnonzero(least == w)
            step = max(1, 4_000_000 // int(w))
            for a in range(0, len(where), step):
                part = where[a : a + step]
                one, two = (self.bits[w][self.at[(self.width[x[part]] != w).astype(int), x[part]]] for x in (i, j))
                out[part] = np.bitwise_count(one ^ two).sum(axis=1, dtype=np.int64)
        return out


def _first_pass(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """A row for each document (doc_id, n, ident, and once a task and ident parities), and the counts of this task's
    distinct tokens by bucket."""
    counts, seen = np.zeros(COUNT_BUCKETS, np.int64), set()
    names = ["doc_id", "n", "ident", "parities", "short", "bucket", "count"]

    def add(tokens):
        np.add(counts, np.bincount((np.concatenate(tokens) & np.uint64(COUNT_BUCKETS - 1)).astype(np.int64), minlength=COUNT_BUCKETS), out=counts)

    for batch in batches:
        sizes, idents, tokens, held, bits = [], [], [], 0, []
        for _, found in shingle_sets(batch.column(1), k):
            ident = set_identity(found)
            sizes.append(len(found))
            idents.append(ident)
            if fresh := len(found) > 0 and ident not in seen:
                seen.add(ident)
            bits.append(_parities(found) if fresh else np.zeros(0, np.int64))
            tokens.append(found)
            held += len(found)
            if held > 1_000_000:
                add(tokens)
                tokens, held = [], 0
        if tokens:
            add(tokens)
        none = pa.nulls(len(sizes), pa.int64())
        wide, short = (pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, x)]).astype(np.int32)), pa.array(np.concatenate([np.zeros(0, np.int64), *x]))) for x in (bits, [_folded(x) for x in bits]))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(idents, pa.int64()), wide, short, none, none], names)
    full = np.flatnonzero(counts)
    for i in range(0, len(full), 50_000):
        part = full[i : i + 50_000]
        none = pa.nulls(len(part), pa.int64())
        lists = pa.nulls(len(part), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([none, none, none, lists, lists, pa.array(part), pa.array(counts[part])], names)


class Signatures:
    """The signatures of a set, for a similarity of ``percent`` hundredths."""

    def __init__(self, percent: int):
        self.percent = percent
        self.base = math.log(100 / percent) * 1.0001

    def losses(self, n: int) -> int:
        """Tokens of a set of n that may be missing from a similar one."""
        return n - -(-self.percent * n // 100)

    def size_class(self, n: int) -> int:
        return int(math.log(n) / self.base)

    def subclasses(self, size_class: int) -> int:
        """For frequent tokens of sets in this class and the one below; 0: they are indexed singly."""
        least = max(1, math.floor(math.exp((size_class - 1) * self.base)))
        many = max(1, (self.losses(math.ceil(math.exp(size_class * self.base))) + 1) // 3)
        return many if least - self.losses(least) - 1 >= many else 0

    def of(self, tokens: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The signatures, and for those of frequent tokens how many rare ones the set has (all of them are indexed then),
        else -1. tokens: sorted and distinct; frequent: which of them are so."""
        need = self.losses(len(tokens)) + 1
        rare = tokens[~frequent]
        if len(rare) >= need:
            return mix(rare[:need]), np.full(need, -1, np.int32)
        often, out = tokens[frequent], [mix(rare)]
        need -= len(rare)
        own = self.size_class(len(tokens))
        for c in (own, own + 1):
            many = self.subclasses(c)
            if not many:
                out.append(mix(often[:need]))
                continue
            sub = ((often >> np.uint64(24)) % np.uint64(many)).astype(np.int64)
            first = np.zeros(len(often), bool)
            first[np.unique(sub, return_index=True)[1]] = True
            reached = np.cumsum(~first)
            end = int(np.searchsorted(reached, need)) + 1
            order = np.argsort(sub[:end], kind="stable")
            held, at = often[:end][order], sub[:end][order]
            salt = np.uint64((c + 1) * int(_FACTORS[40]) % 2**64)
            for gap in range(1, end):
                same = at[gap:] == at[:-gap]
                if not same.any():
                    break
                out.append(mix(held[:-gap][same] * _FACTORS[41] + held[gap:][same] * _FACTORS[42] + salt))
        out = np.concatenate(out)
        return out, np.where(np.arange(len(out)) < len(rare), -1, len(rare)).astype(np.int32)


def _signature_rows(batches: Iterator[pa.RecordBatch], k: int, percent: int, heavy) -> Iterator[pa.RecordBatch]:
    make, seen = Signatures(percent), set()
    bits = np.frombuffer(heavy.value, np.uint8)

    def rows(parts):
        sigs, rare = (np.concatenate([p[0][i] for p in parts]) for i in (0, 1))
        lengths = [len(p[0][0]) for p in parts]
        idents, sizes = np.repeat(np.array([p[1] for p in parts], np.int64), lengths), np.repeat(np.array([p[2] for p in parts], np.int32), lengths)
        return pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(idents), pa.array(sizes), pa.array(rare)], ["sig", "ident", "n", "rare"])

    for batch in batches:
        parts, total = [], 0
        for _, tokens in shingle_sets(batch.column(0), k):
            # The smallest set that another set can be similar to without being equal has as many tokens.
            if not len(tokens) or make.percent * (len(tokens) + 1) > 100 * len(tokens):
                continue
            if (ident := set_identity(tokens)) in seen:
                continue
            seen.add(ident)
            at = tokens & np.uint64(COUNT_BUCKETS - 1)
            frequent = (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
            found = make.of(tokens, frequent.astype(bool))
            parts.append((found, ident, len(tokens)))
            total += len(found[0])
            if total > 200_000:
                yield rows(parts)
                parts, total = [], 0
        if parts:
            yield rows(parts)


def _shared_signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the rows of a partition by signature, those whose signature several sets have, with a leader for each: the one
    with the fewest rare tokens."""
    held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
    if not held:
        return
    sig, ident, n, rare = (np.concatenate(x) for x in zip(*held))
    del held
    rank = ((rare + 1).astype(np.uint64) << np.uint64(40)) | (mix(ident.view(np.uint64)) >> np.uint64(24))
    order = np.lexsort((rank, sig))
    sig, ident, n, rare = sig[order], ident[order], n[order], rare[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (ident[1:] != ident[:-1])
    sig, ident, n, rare = sig[new], ident[new], n[new], rare[new]
    first = np.ones(len(sig), bool)
    first[1:] = sig[1:] != sig[:-1]
    start = np.flatnonzero(first)
    length = np.diff(np.append(start, len(sig)))
    keep = np.repeat(length > 1, length)
    lead = np.repeat(start, length)
    out = [sig[keep], ident[keep], n[keep], rare[keep], ident[lead][keep], n[lead][keep], rare[lead][keep]]
    for i in range(0, len(out[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 100_000]) for x in out], ["sig", "ident", "n", "rare", "lead", "lead_n", "lead_rare"])


def _candidate_sets(batches: Iterator[pa.RecordBatch], k: int, wanted) -> Iterator[pa.RecordBatch]:
    """(ident, tokens) of the documents (doc_id, text) whose ids the filter lets pass."""
    bits = np.frombuffer(wanted.value, np.uint8)
    for batch in batches:
        at = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64) & (FILTER_BITS - 1)
        batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1 == 1))
        idents, sets, total = [], [], 0

        def rows():
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(idents, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], ["ident", "tokens"])  # noqa: B023

        for _, tokens in shingle_sets(batch.column(1), k):
            if len(tokens):
                idents.append(set_identity(tokens))
                sets.append(tokens)
                total += len(tokens)
            if total > 500_000:
                yield rows()
                idents, sets, total = [], [], 0
        if idents:
            yield rows()


def _heavy_buckets(counts: DataFrame, spark):
    """A bit for each bucket: whether it holds clearly more tokens than the mean bucket, as frequent tokens make it do."""
    rows = counts.groupBy("bucket").agg(F.sum("count").alias("count")).toArrow()  # COUNT_BUCKETS rows at most
    total = np.zeros(COUNT_BUCKETS, np.int64)
    total[rows.column("bucket").to_numpy()] = rows.column("count").to_numpy()
    mean = float(np.median(total))
    heavy = total > mean + 3 * math.sqrt(mean) + 8
    return spark.sparkContext.broadcast(np.packbits(heavy, bitorder="little").tobytes())


def _filter_of(ids: DataFrame, spark):
    """A bit for each doc_id of ``ids`` modulo FILTER_BITS."""
    at = F.col("doc_id").bitwiseAND(F.lit(FILTER_BITS - 1).cast("long"))
    words = ids.select(at.alias("at")).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    rows = words.toArrow()  # FILTER_BITS / 64 rows at most
    bits[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    return spark.sparkContext.broadcast(bits.tobytes())


def _near_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Those rows (ident, n, lead, lead_n, a, b), where a and b are parities, whose sets may be similar by these."""
    for batch in batches:
        parities = _Parities(pa.concat_arrays([batch.column(4), batch.column(5)]))
        both = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64) + batch.column(3).to_numpy(zero_copy_only=False)
        at = np.arange(len(batch))
        near = parities.differ(at, at + len(batch)) * (100 + percent) <= both * (100 - percent)
        yield batch.select([0, 2]).filter(pa.array(near))


def _open_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Of the rows of a partition by signature: pairs of sets that share one, lie in different components and may be
    similar by their sizes, rare tokens and parities. A pair is left to a smaller signature where both sets name it among
    their smallest shared ones; each pair once a task."""
    table = pa.Table.from_batches(batches)
    if not len(table):
        return
    table = table.sort_by("sig").combine_chunks()
    sig, ident, n, rare, component = (table.column(c).to_numpy() for c in ("sig", "ident", "n", "rare", "component"))
    n, parities = n.astype(np.int64), _Parities(table.column("parities").combine_chunks())
    least = table.column("least").combine_chunks()
    width = least.value_lengths().to_numpy(zero_copy_only=False)
    smallest = np.tile(sig[:, None], LEAST_SHARED)
    smallest[np.arange(LEAST_SHARED) < width[:, None]] = least.flatten().to_numpy(zero_copy_only=False)
    start = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
    end = np.repeat(np.append(start[1:], len(sig)), np.diff(np.append(start, len(sig))))
    row, gap, found = np.arange(len(sig)), 0, np.zeros(0, [("u", np.int64), ("v", np.int64)])
    while True:
        gap += 1
        row = row[row + gap < end[row]]
        if not len(row) and not len(found):
            return
        for a in range(0, len(row), 100_000):
            i, j = row[a : a + 100_000], row[a : a + 100_000] + gap
            both = n[i] + n[j]
            keep = (component[i] != component[j]) & (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent)
            keep &= (rare[i] < 0) | ((rare[i] + rare[j]) * (100 + percent) <= both * (100 - percent))
            i, j, both = i[keep], j[keep], both[keep]
            near = parities.differ(i, j) * (100 + percent) <= both * (100 - percent)
            i, j = i[near], j[near]
            both_name = (smallest[i][:, :, None] == smallest[j][:, None, :]) & (smallest[i] < sig[i][:, None])[:, :, None]
            near = ~both_name.any(axis=(1, 2))
            new = np.zeros(int(near.sum()), found.dtype)
            new["u"], new["v"] = np.minimum(ident[i], ident[j])[near], np.maximum(ident[i], ident[j])[near]
            found = np.unique(np.concatenate([found, new])) if len(new) else found
        if not len(row) or len(found) > 200_000:
            yield pa.RecordBatch.from_arrays([pa.array(found["u"].copy()), pa.array(found["v"].copy())], ["ident", "lead"])
            found = found[:0]


def _verified(pairs: DataFrame, docs: DataFrame, lowest: DataFrame, k: int, percent: int) -> DataFrame:
    """Those pairs (ident, lead) that are similar enough, by their whole sets, which are made anew from the texts of the
    documents concerned."""
    pairs = Cut(pairs, "pairs").df
    idents = pairs.select("ident").unionByName(pairs.select(F.col("lead").alias("ident"))).distinct()
    wanted = _filter_of(idents.join(lowest, "ident").select(F.col("low").alias("doc_id")), pairs.sparkSession)
    sets = Cut(docs.mapInArrow(lambda it: _candidate_sets(it, k, wanted), "ident long, tokens array<long>"), "sets").df
    wanted.destroy()  # the table is written, so nothing is made anew from it
    one, two = sets.select("ident", F.col("tokens").alias("a")), sets.select(F.col("ident").alias("lead"), F.col("tokens").alias("b"))
    same = F.size(F.array_intersect("a", "b"))
    alike = pairs.join(one, "ident").join(two, "lead").where(same * 100 >= (F.size("a") + F.size("b") - same) * percent)
    return Cut(alike.select(F.col("ident").alias("u"), F.col("lead").alias("v")).distinct(), "links").df


def similar_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id, the smallest doc_id that links
    reach, where documents link if their sets of k-word shingles have a Jaccard similarity of ``percent`` hundredths."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    first = Cut(docs.mapInArrow(lambda it: _first_pass(it, k), "doc_id long, n long, ident long, parities array<long>, short array<long>, bucket long, count long"), "first").df
    each = first.where("n is not null").select("doc_id", "n", "ident")
    parities = first.where("size(parities) > 0").select("ident", "n", "parities").dropDuplicates(["ident"])
    short = first.where("size(parities) > 0").select("ident", F.col("short").alias("parities")).dropDuplicates(["ident"])
    lowest = Cut(each.where("n > 0 and doc_id is not null").groupBy("ident").agg(F.min("doc_id").alias("low")), "lowest").df
    heavy = _heavy_buckets(first.where("bucket is not null"), spark)
    docs = docs.where("doc_id is not null")

    sigs = docs.select("text").mapInArrow(lambda it: _signature_rows(it, k, percent, heavy), "sig long, ident long, n int, rare int")
    shared = Cut(sigs.repartition("sig").mapInArrow(_shared_signatures, "sig long, ident long, n int, rare int, lead long, lead_n int, lead_rare int"), "shared").df
    heavy.destroy()
    # Sets that meet at frequent tokens have all their rare ones indexed. If they share none of these, all of them differ;
    # if they do share one, they meet there.
    few = (F.col("rare") < 0) | ((F.col("rare") + F.col("lead_rare")) * (100 + percent) <= (F.col("n") + F.col("lead_n")) * (100 - percent))
    fits = (F.least("n", "lead_n") * 100 >= F.greatest("n", "lead_n") * percent) & few
    tried = Cut(shared.where((F.col("ident") != F.col("lead")) & fits).select("ident", "n", "lead", "lead_n").distinct(), "tried").df

    def near(pairs: DataFrame) -> DataFrame:
        one, two = parities.select("ident", "n", F.col("parities").alias("a")), parities.select(F.col("ident").alias("lead"), F.col("n").alias("lead_n"), F.col("parities").alias("b"))
        both = pairs.select("ident", "lead").join(one, "ident").join(two, "lead").select("ident", "n", "lead", "lead_n", "a", "b")
        return both.mapInArrow(lambda it: _near_pairs(it, percent), "ident long, lead long")

    links = _verified(near(tried), docs, lowest, k, percent)
    label = components(links)

    # What is left: sets that share a signature but lie in different components, as far as the leaders tell.
    named = shared.select("sig", "ident", "n", "rare").join(label.withColumnRenamed("node", "ident"), "ident", "left").withColumn("component", F.coalesce("component", "ident"))
    named = Cut(named, "named").df
    open_sigs = named.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("sig")
    left = named.join(open_sigs, "sig").withColumn("single", F.col("rare") < 0)
    least = left.groupBy("ident", "single").agg(F.slice(F.array_sort(F.collect_list("sig")), 1, LEAST_SHARED).alias("least"))
    left = left.join(short.join(least, "ident"), ["ident", "single"]).select("sig", "ident", "n", "rare", "component", "parities", "least")
    rest = left.repartition("sig").mapInArrow(lambda it: _open_pairs(it, percent), "ident long, lead long").distinct()
    known = tried.select(F.least("ident", "lead").alias("ident"), F.greatest("ident", "lead").alias("lead"))
    more = _verified(near(rest.join(known, ["ident", "lead"], "left_anti")), docs, lowest, k, percent)
    if not more.isEmpty():
        label = components(label.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more))

    named = lowest.join(label.withColumnRenamed("node", "ident"), "ident", "left").withColumn("component", F.coalesce("component", "ident"))
    of = named.groupBy("component").agg(F.min("low").alias("component_id"))
    of = named.join(of, "component").select("ident", "component_id")
    filled = each.where("n > 0").join(of, "ident", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return filled.unionByName(each.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
