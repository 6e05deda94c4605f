"""Similarity join on word n-gram sets by T-occurrence search, and its components.

A text's set is its distinct n-word shingles as 64-bit hashes; a text of fewer words is one
shingle. Two texts link when 100 * intersection >= percent * union, so a partner of a set of
n shingles holds at least T = ceil(n * percent / 100) of them. Of any n - T + 1 shingles the
partner holds one, and if both sides take these first in one order of all shingles, the
inverted lists of the taken shingles alone bring every partner together.

1. Equal sets become one class, named by its smallest doc_id, so copies cost one row.
2. The order is by hash, with frequent shingles (lists over LONG) last: they are found by
   counting the taken shingles, of which every class takes a few more than it needs. A class
   left with too few rare ones takes all its shingles and goes on in the same order.
3. Short lists: every class heap-merges the short lists of its shingles, without classes of a
   size too far from its own. A class that occurs so seldom that even all that neither list
   shows could not make up a link is no candidate.
4. Long lists remain only among classes that consist of frequent shingles, that is, large
   groups of near copies. They are not merged: members are probed against the list's most
   central class, and what then lies in one component needs no more comparing. Lists with
   several components left are compared in blocks, across components only, by parity sketches,
   whose distance never exceeds the difference of two sets: first every member is tried with the
   nearest member of each other component, then what is still apart with every possible one.
5. A candidate whose sketches allow a link is decided by binary probes of one sorted set into
   the other.

Defined results: a text that is null, empty or without words has no shingles, is linked with
nothing and is its own component; a row without doc_id is counted but linked with nothing and
its component is null; rows with one doc_id are one document, whose set is the union of its
rows' sets. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diurna.llm.common import BROADCAST_ROWS, column, small_batches, small_or_not, staged, unstage
from diurna.llm.connected import roots
from diurna.llm.hashing import Rolling, mixed

#: Lists over this many classes are long: they are probed, not merged.
LONG = 100
SKETCH_BITS = 256
#: Bits at most of the wider sketches that are compared in blocks.
WIDE_BITS = 2048
BLOCK = 256
#: Most members outside the largest components whose blocks are broadcast (at most 20 MB with sketches of WIDE_BITS).
MINOR_ROWS = 1 << 16
#: Rows with whole lists or sets that are in a worker's memory at a time.
BATCH_ROWS = 100
#: Rows with texts and the heads of their sets that are in a worker's memory at a time.
SET_ROWS = 1000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14)]] = True
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    inside = np.concatenate([[False], ~_WHITE[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.int64)
    word = Rolling(data).hashes(starts, ends)
    k = min(words, len(word))
    total = np.zeros(len(word) - k + 1, np.uint64)  # arithmetic is mod 2**64
    for i in range(k):
        total = total * np.uint64(0xC2B2AE3D27D4EB4F) + word[i:i + len(total)]
    return np.unique(mixed(total + np.uint64(k)).view(np.int64))


def needed(n: int, percent: int) -> int:
    """T: shingles that a partner of a set of n must hold."""
    return -(-n * percent // 100)


def taken(n: int, percent: int) -> int:
    return n - needed(n, percent) + 1


def spare(n: int, percent: int) -> int:
    return taken(n, percent) // 4 + 2


def sketch(own: np.ndarray, wide: bool = False) -> bytes:
    """Parities of the hashes by their leading bits, SKETCH_BITS at least: half a bit a shingle, or if wide, two to four bits up to WIDE_BITS."""
    bits = max(SKETCH_BITS, min(WIDE_BITS, 1 << (2 * len(own)).bit_length()) if wide else 1 << (len(own) // 2).bit_length())
    at = (own.view(np.uint64) >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(own: bytes, size: int) -> np.ndarray:
    """A sketch at a smaller size in bytes: neighbouring parities are added."""
    if len(own) == size:
        return np.frombuffer(own, np.uint8)
    bits = np.unpackbits(np.frombuffer(own, np.uint8)).reshape(8 * size, -1)
    return np.packbits(bits.sum(axis=1).astype(np.uint8) & 1)


def most_apart(a: int, b: int, percent: int) -> int:
    """Largest difference of linked sets of a and b shingles; parities differ in no more places."""
    return a + b - 2 * -(-percent * (a + b) // (100 + percent))


def _owns(batch: pa.RecordBatch, words: int) -> Iterator[np.ndarray]:
    """The set of each row: the joined one of a document with several texts, or that of its text."""
    for text, joined in zip(column(batch, "text"), column(batch, "joined")):
        yield np.frombuffer(joined.as_py(), np.int64) if joined.is_valid else shingles(text.as_py(), words)


def _sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, heads, sketches, wide = [], [], [], [], []
            for own in _owns(batch, words):
                n = len(own)
                sizes.append(n)
                names.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                heads.append(own[:taken(n, percent) + spare(n, percent)] if n else own)
                sketches.append(sketch(own))
                wide.append(sketch(own, True))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
                 pa.array(heads, pa.list_(pa.int64())), pa.array(sketches, pa.binary()), pa.array(wide, pa.binary())],
                names=["doc_id", "n", "class", "head", "sketch", "wide"])

    return docs.mapInArrow(run, "doc_id bigint, n bigint, class binary, head array<bigint>, sketch binary, wide binary")


def _whole_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, own): the sorted sets of the named documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owns = list(_owns(batch, words))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "node"), pa.array([o.tobytes() for o in owns], pa.binary())], names=["node", "own"])

    named = docs.withColumnRenamed("doc_id", "node").join(small_or_not(nodes), "node", "left_semi")
    return named.mapInArrow(run, "node bigint, own binary")


def _possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sizes and sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for n, m, a, b in zip(*(column(batch, c).to_pylist() for c in ("na", "nb", "a", "b"))):
                size = min(len(a), len(b))
                apart = int(_POPCOUNT[folded(a, size) ^ folded(b, size)].sum())
                yes.append(100 * min(n, m) >= percent * max(n, m) and apart <= most_apart(n, m, percent))
            keep = pa.array(yes, pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, "u").filter(keep), column(batch, "v").filter(keep)], names=["u", "v"])

    side = lambda u, n, a: classes.select(F.col("rep").alias(u), F.col("n").alias(n), F.col("sketch").alias(a))
    named = pairs.filter("u <> v").distinct().join(side("u", "na", "a"), "u").join(side("v", "nb", "b"), "v")
    return named.mapInArrow(run, "u bigint, v bigint").distinct()


def _decided(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (u, v) that do link, by binary probes of the smaller set into the larger."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for a, b in zip(column(batch, "a"), column(batch, "b")):
                x, y = sorted((np.frombuffer(a.as_py(), np.int64), np.frombuffer(b.as_py(), np.int64)), key=len)
                at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                both = int((y[at] == x).sum()) if len(y) else 0
                yes.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(yes, pa.bool_())
            yield pa.RecordBatch.from_arrays([column(batch, "u").filter(keep), column(batch, "v").filter(keep)], names=["u", "v"])

    with small_batches(docs.sparkSession, BATCH_ROWS):
        pairs = staged(pairs, "pairs")
        nodes = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
        own = staged(_whole_sets(docs, nodes, words), "own")
        both = pairs.join(own.select(F.col("node").alias("u"), F.col("own").alias("a")), "u") \
            .join(own.select(F.col("node").alias("v"), F.col("own").alias("b")), "v")
        links = staged(both.mapInArrow(run, "u bigint, v bigint").distinct(), "links")
    unstage(pairs, own)
    return links


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _merged(lists: DataFrame, percent: int) -> DataFrame:
    """Candidates (u, v) of each class u among smaller v, by a heap merge of its lists that counts occurrences.

    Both classes show the first shingles of one order. Where the one that ends earlier ends, the
    other shows all it holds up to there; so what two classes share is at most the occurrences
    counted here and the `rest` of one of them, which is what it holds but no merged list shows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us: list[int] = []
            vs: list[int] = []
            for u, n, rest, each in zip(*(column(batch, c) for c in ("rep", "n", "rest", "lists"))):
                u, n, rest, runs = u.as_py(), n.as_py(), rest.as_py(), [each.values.field(c) for c in ("own", "sizes", "rests")]
                own, sizes, rests = (x.flatten().to_numpy() for x in runs)
                least = -(-percent * (n + sizes.astype(np.int64)) // (100 + percent)) - np.maximum(rest, rests)
                least = dict(zip(own.tolist(), least.tolist()))
                merged = heapq.merge(*(x.tolist() for x in np.split(own, np.cumsum(runs[0].value_lengths().to_numpy())[:-1])))
                found = [v for v, same in groupby(merged) if sum(1 for _ in same) >= least[v]]
                us += [u] * len(found)
                vs += found
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return lists.mapInArrow(run, "u bigint, v bigint")


def _asked(short: DataFrame, percent: int) -> DataFrame:
    """(rep, n, rest, lists): of every class its short lists (t, rep, n, rest), with the smaller classes whose size allows a link."""
    own = short.groupBy("t").agg(F.sort_array(F.collect_list(F.struct("rep", "n", "rest"))).alias("own"))
    before = F.filter(F.slice("own", F.lit(1), F.col("at")), lambda v: _sizes_fit(v["n"], F.col("u.n"), percent))
    fits = own.select(F.posexplode("own").alias("at", "u"), "own").filter("at > 0").select("u", before.alias("own")).filter(F.size("own") > 0)
    return fits.groupBy("u.rep", "u.n", "u.rest").agg(F.collect_list(
        F.struct(F.col("own.rep").alias("own"), F.col("own.n").alias("sizes"), F.col("own.rest").alias("rests"))).alias("lists"))


def _across(blocks: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """(u, v, comp, apart): a minor member u and a member v of another component whose sketches allow a link.

    nearest: of each component of the block only the member least apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out: list[tuple] = []
                by_length: dict[int, list[dict]] = {}
                for x in row["members"]:
                    by_length.setdefault(len(x["sketch"]), []).append(x)
                for length, members in by_length.items():
                    nb, cb, rb = (np.array([x[c] for x in members], np.int64) for c in ("n", "comp", "rep"))
                    at_size: dict[int, np.ndarray] = {}
                    for x in row["minor"]:
                        size = min(length, len(x["sketch"]))
                        if size not in at_size:
                            at_size[size] = np.array([folded(y["sketch"], size) for y in members])
                        total = x["n"] + nb
                        most = total - 2 * -(-percent * total // (100 + percent))
                        far = _POPCOUNT[folded(x["sketch"], size) ^ at_size[size]].sum(axis=1)
                        hit = np.flatnonzero((x["comp"] != cb) & (np.minimum(x["n"], nb) * 100 >= np.maximum(x["n"], nb) * percent) & (far <= most))
                        if nearest and len(hit):
                            hit = hit[np.lexsort((rb[hit], far[hit], cb[hit]))]
                            hit = hit[np.unique(cb[hit], return_index=True)[1]]
                        out += zip([x["rep"]] * len(hit), rb[hit].tolist(), cb[hit].tolist(), far[hit].tolist())
                columns = list(zip(*out)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["u", "v", "comp", "apart"])

    found = blocks.mapInArrow(run, "u bigint, v bigint, comp bigint, apart bigint")
    if nearest:
        found = found.groupBy("u", "comp").agg(F.min(F.struct("apart", "v")).alias("least")).select("u", "least.v")
    return found.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _rare_first(docs: DataFrame, reps: DataFrame, frequent: DataFrame, words: int, percent: int) -> DataFrame:
    """(t, rep, n): the shingles that the whole sets of the named documents take, frequent ones last.

    Texts become taken shingles in one map: two maps in a task would be two Python workers a
    core, and an executor keeps all it ever started. Frequent shingles are few (each is in over LONG classes) and go to the tasks as one array
    if they are at most BROADCAST_ROWS; beyond that they are joined to the sets' shingles.
    """
    if frequent.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        known = docs.sparkSession.sparkContext.broadcast(np.array([r.t for r in frequent.collect()], np.int64))

        def first(x: np.ndarray) -> np.ndarray:
            often = np.isin(x, known.value)
            return np.concatenate([x[~often], x[often]])[:taken(len(x), percent)]
    else:
        def first(x: np.ndarray) -> np.ndarray:
            return x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_owns(batch, words))
            yield pa.RecordBatch.from_arrays(
                [column(batch, "rep"), pa.array([len(x) for x in sets], pa.int64()),
                 pa.array([first(x) for x in sets], pa.list_(pa.int64()))], names=["rep", "n", "some"])

    named = docs.withColumnRenamed("doc_id", "rep").join(small_or_not(reps), "rep", "left_semi")
    each = named.mapInArrow(run, "rep bigint, n bigint, some array<bigint>").select("rep", "n", F.explode("some").alias("t"))
    if frequent.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return each.select("t", "rep", "n")
    marked = each.join(frequent.withColumn("often", F.lit(True)), "t", "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(False)).alias("often"), "t")))
    take = F.col("n") - ((F.col("n") * percent + 99) / 100).cast("long") + 1
    kept = marked.groupBy("rep", "n").agg(order.alias("all")).select(
        "rep", "n", F.explode(F.slice("all", F.lit(1), take.cast("int"))).alias("x"))
    return kept.select("x.t", "rep", "n")


def _lists(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The taken shingles (t, rep, n) of all classes, and the lengths (t, m) of lists of two or more."""
    need = ((F.col("n") * percent + 99) / 100).cast("long")
    take = F.col("n") - need + 1
    shown = F.least(F.col("n"), take + (take / 4).cast("long") + 2)
    postings = classes.select("rep", "n", F.explode("head").alias("t"))
    length = postings.groupBy("t").count().filter("count >= 2")
    shared = staged(postings.join(length, "t"), "shared")
    frequent = staged(shared.filter(F.col("count") > LONG).groupBy("t").agg(F.max("count").alias("count")).select("t"), "frequent")
    full = staged(shared.filter(F.col("count") > LONG).groupBy("rep", "n").agg(F.count("*").alias("hot"))
                  .filter(shown - F.col("hot") < take).select("rep"), "full")
    rare = shared.filter(F.col("count") <= LONG).select("t", "rep", "n")
    done = [shared, frequent, full]
    if full.limit(1).count():
        more = staged(_rare_first(docs, full, frequent, words, percent), "more")
        done.append(more)
        # a shingle that one class showed may now meet those that show all
        met = postings.join(small_or_not(more.select("t").distinct()), "t", "left_semi") \
            .join(small_or_not(frequent), "t", "left_anti").select("t", "rep", "n")
        rare = rare.unionByName(met).distinct().join(small_or_not(full), "rep", "left_anti").select("t", "rep", "n") \
            .unionByName(more)
    chosen = staged(rare, "chosen")
    unstage(*done)
    return chosen, chosen.groupBy("t").agg(F.count("*").alias("m")).filter("m >= 2")


def tops(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(u, v), staged: every class u that is not the smallest of its component, with that smallest class v.

    classes: (rep, n, head, sketch, wide).
    """
    chosen, lengths = _lists(docs, classes, words, percent)
    lists = staged(chosen.join(lengths, "t"), "lists")
    unstage(chosen)
    long = lists.filter(F.col("m") > LONG)
    central = long.groupBy("rep").agg(F.count("*").alias("c"))
    short = lists.filter(F.col("m") <= LONG).select("t", "rep", F.col("n").cast("int").alias("n"))
    several = long.limit(1).count() > 0
    if several:
        short = short.join(small_or_not(central), "rep", "left")
    unseen = F.coalesce("c", F.lit(0)) if several else F.lit(0)
    rest = (((F.col("n").cast("long") * percent + 99) / 100).cast("long") - 1 + unseen).cast("int")
    merged = _merged(_asked(short.select("t", "rep", "n", rest.alias("rest")), percent), percent)
    new = _decided(docs, _possible(merged, classes, percent), words, percent)
    if not several:
        edges = roots(new)
        unstage(lists, new)
        return edges
    rows = staged(long.join(central, "rep"), "long")
    unstage(lists)
    found, named, mixed = new, None, None
    for way in ("centre", "centre", "nearest", "every"):
        if way == "centre":  # probe against the most central class, then among what is left apart from it
            apart = rows if named is None else named.join(mixed.select("t", F.col("comp").alias("main")), "t").filter("comp <> main").drop("comp", "main")
            head = apart.groupBy("t").agg(F.max(F.struct("c", (-F.col("rep")).alias("r"), F.col("n").alias("hn"))).alias("h"))
            pairs = apart.join(head, "t").select("rep", "n", (-F.col("h.r")).alias("head"), F.col("h.hn").alias("hn")) \
                .filter((F.col("rep") != F.col("head")) & _sizes_fit(F.col("n"), F.col("hn"), percent)) \
                .select(F.greatest("rep", "head").alias("u"), F.least("rep", "head").alias("v"))
            probed = _decided(docs, _possible(pairs, classes, percent), words, percent)
        else:  # the wide sketches that allow these pairs say more than those of _possible
            members = staged(_open_members(named, mixed, classes), "open")
            probed = _decided(docs, _across(_blocks(members), percent, way == "nearest").distinct(), words, percent)
            unstage(members)
        if named is not None and not probed.limit(1).count():  # nothing came together
            unstage(probed)
            continue
        old, found = found, roots(found.unionByName(probed))
        unstage(old, probed, *(x for x in (named, mixed) if x is not None))
        if way == "every":
            break
        comps = found.select(F.col("u").alias("rep"), F.col("v").alias("comp"))
        named = staged(rows.join(comps, "rep", "left").withColumn("comp", F.coalesce("comp", "rep")), "named")
        main = named.groupBy("t", "comp").agg(F.count("*").alias("k")).groupBy("t").agg(
            F.max(F.struct("k", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("k").alias("m2"))
        mixed = staged(main.filter("comps > 1").select("t", "main.comp", "m2", (F.col("m2") - F.col("main.k")).alias("m1")), "mixed")
        if not mixed.limit(1).count():
            break
    unstage(rows, named, mixed)
    return found


def _open_members(named: DataFrame, mixed: DataFrame, classes: DataFrame) -> DataFrame:
    """The members of lists with several components, with their wide sketches."""
    return named.drop("m", "c").join(mixed.select("t", F.col("comp").alias("main"), "m1", "m2"), "t").join(
        classes.select("rep", F.col("wide").alias("sketch")), "rep")


def _blocks(members: DataFrame) -> DataFrame:
    """(minor, members): blocks of the members outside a list's largest component, each with every block of the list."""
    member = F.collect_list(F.struct("rep", "n", "comp", "sketch"))
    part = lambda size: F.pmod(F.xxhash64("rep"), F.ceil(F.col(size) / BLOCK).cast("long"))
    every = members.groupBy("t", part("m2").alias("b")).agg(member.alias("members"))
    minor = members.filter("comp <> main").groupBy("t", part("m1").alias("b1")).agg(member.alias("minor"))
    # sent to the blocks, which are dealt evenly; a join by t would bring all blocks of a list together
    minor = small_or_not(minor, members.filter("comp <> main"), MINOR_ROWS)
    return every.join(minor, "t").select("minor", "members")


def _joined(docs: DataFrame, several: DataFrame, words: int) -> DataFrame:
    """(doc_id, text, joined): a row for each of the named documents, with the union of its rows' sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owns = [shingles(t.as_py(), words) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(owns, pa.list_(pa.int64()))], names=["doc_id", "own"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owns = [np.sort(x.values.to_numpy()).tobytes() for x in column(batch, "own")]
            yield pa.RecordBatch.from_arrays(
                [column(batch, "doc_id"), pa.nulls(len(owns), pa.string()), pa.array(owns, pa.binary())], names=["doc_id", "text", "joined"])

    rows = docs.select("doc_id", "text").join(small_or_not(several.select("doc_id")), "doc_id", "left_semi")
    each = rows.mapInArrow(run, "doc_id bigint, own array<bigint>").select("doc_id", F.explode("own").alias("t")).distinct()
    return each.groupBy("doc_id").agg(F.collect_list("t").alias("own")).mapInArrow(pack, "doc_id bigint, text string, joined binary")


def components(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), one row per row of docs.

    The result's _below are the staged tables that it reads, for `unstage` once it is written.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("binary").alias("joined"))
    with small_batches(docs.sparkSession, SET_ROWS):
        base = staged(_sets(docs, words, percent), "sets")
    name = F.xxhash64("class")
    several = staged(base.filter("doc_id is not null").groupBy("doc_id").agg(
        F.count("*").alias("times"), F.min(name).alias("a"), F.max(name).alias("b")).filter("a <> b").select("doc_id", "times"), "several")
    if not several.limit(1).count():
        unstage(several)
        return _components(docs, base, words, percent)
    # in between, a document with several texts is one row
    with small_batches(docs.sparkSession, BATCH_ROWS):
        joined = staged(_joined(docs, several, words), "joined")
        rest = lambda rows: rows.join(small_or_not(several.select("doc_id")), "doc_id", "left_anti")
        base = staged(rest(base).unionByName(_sets(joined, words, percent)), "sets")
    found = _components(rest(docs).unionByName(joined), base, words, percent)
    below = (*found._below, several, joined)
    times = F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)))).alias("_")
    out = found.join(small_or_not(several), "doc_id", "left").select(*found.columns, times).drop("_")
    out._below = below
    return out


def _components(docs: DataFrame, base: DataFrame, words: int, percent: int) -> DataFrame:
    first = staged(base.filter("n > 0 and doc_id is not null").groupBy("class").agg(F.min("doc_id").alias("rep")), "classes")
    # a class is read from the row of its smallest doc_id
    classes = base.join(small_or_not(first.select("class", F.col("rep").alias("doc_id"))), ["class", "doc_id"]).select(
        F.col("doc_id").alias("rep"), "n", "head", "sketch", "wide")
    edges = tops(docs, classes, words, percent)
    top = edges.select(F.col("u").alias("rep"), F.col("v").alias("comp"))
    named = first.join(top, "rep", "left").select("class", F.coalesce("comp", "rep").alias("comp"))
    out = base.select("doc_id", "n", "class").join(named, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id"))
        .otherwise(F.col("comp")).alias("component_id"))
    out._below = (base, first, edges)
    return out
