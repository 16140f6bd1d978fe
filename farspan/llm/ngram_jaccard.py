"""Near-duplicate join on word shingles: prefix filters under several global token orders, then verification.

Order of work, for sets of distinct shingles (64-bit hashes) and a Jaccard threshold of percent / 100:

1. Every set's size and 128-bit signature are written; rows with equal sets are one class from here on. Tasks also
   count shingles in a sketch of 2^20 counters (4 MiB; its size doesn't grow). Its logarithmic classes begin every
   global order: rare shingles come first, and each order breaks ties by a hash of its own.
2. One more pass writes each class's prefixes (the tokens of which any partner must share one) under all orders.
3. Tokens of the first order go to a pair of Bloom filters; only those that two sets may share become rows (token,
   set, size, place).
4. Each token's rows are paired with one centre only, if the place and size bounds allow: the least set by id, so that
   a group's tokens mostly name one centre. Tokens whose sets are then still in different components try a second
   centre, the set with the fewest rarer tokens, and after that give all their remaining pairs that pass the same
   bounds; sets that a link has joined need no more pairs. So copies cost a row each, not all pairs.
5. Candidates meet the prefixes under the other orders and must share a token under each: the filters are intersected
   on narrow rows. What is left is verified on the words themselves, for which alone texts are shuffled.
6. No link leaves a component, so all links are counted within them: blocks of each component's texts meet each other
   once, their sets as the rows of two matrices, whose product holds all intersections. Only counts leave the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_hash, key_filter, lean, prepare, release, repeated_filter, shared_with, staged, texts_of
from .components import components
from .shingles import mixed, of_batch, of_text

SKETCH_BITS, SKETCH_PARTS = 20, 16
#: One global token order each.
ORDERS = tuple(np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
GATHERED = 400_000
#: Bytes of prepared texts that a comparing task holds.
HELD_BYTES = 16 << 20
#: Bytes of a block of texts that meets another one, and what a text counts at least; columns of a product.
BLOCK_BYTES, LEAST_BYTES, COLUMNS = 8 << 20, 16 << 10, 1 << 13


class WordIds(dict):
    """Word to a number of its own."""

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        return i


class Prepared:
    """Texts made ready for comparison, the latest HELD_BYTES of them: sorted shingle hashes, a place of each in the
    text, and the words as numbers."""

    def __init__(self, size: int, percent: int):
        self.size, self.percent = size, percent
        self.ids, self.kept, self.held = WordIds(), {}, 0

    def known(self, text: bytes) -> tuple:
        if (x := self.kept.get(text)) is None:
            words = text.lower().split()  # of bytes: A-Z only, ASCII white space only
            tokens, place = np.unique(of_text(text, self.size), return_index=True)
            x = self.kept[text] = (tokens, place.astype(np.int32), np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
            self.held += self.weight(text, x)
        return x

    @staticmethod
    def weight(text: bytes, x: tuple) -> int:
        return len(text) + sum(a.nbytes for a in x) + 1000

    def near(self, a: bytes, b: bytes) -> bool:
        """Whether two texts share, word for word, enough shingles."""
        if len(self.ids) > 100_000:  # numbers are given anew, so no text may keep old ones
            self.ids.clear()
            self.kept.clear()
            self.held = 0
        while self.held > HELD_BYTES and self.kept:
            first = next(iter(self.kept))
            self.held -= self.weight(first, self.kept.pop(first))
        (x, px, wx), (y, py, wy) = self.known(a), self.known(b)
        if not len(x) or not len(y) or 100 * min(len(x), len(y)) < self.percent * max(len(x), len(y)):
            return False
        _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
        i, j, same = px[i], py[j], np.ones(len(i), bool)
        for k in range(min(self.size, len(wx), len(wy))):  # equal hashes: so must be their words
            same &= wx[i + k] == wy[j + k]
        both = int(same.sum())
        return 100 * both >= self.percent * (len(x) + len(y) - both)


def ranked(tokens: np.ndarray, classes: np.ndarray, order: np.uint64) -> np.ndarray:
    """Tokens as their place values in a global order; equal tokens have equal values."""
    return (classes[tokens >> np.uint64(64 - SKETCH_BITS)].astype(np.uint64) << np.uint64(56)) | (mixed(tokens, order) >> np.uint64(8))


def prefix(values: np.ndarray, percent: int) -> np.ndarray:
    """The least place values of a set, in order: any partner must share one of them."""
    n = len(values)
    return np.sort(values)[: n - -(-percent * n // 100) + 1]


def _sum_counts(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(x, np.int32).astype(np.int64) for x in t.column("counts").to_pylist())
    return pa.table({"seg": t.column("seg").slice(0, 1), "salt": t.column("salt").slice(0, 1), "counts": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})


def _classes(sketch: DataFrame) -> np.ndarray:
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    width = len(out) // SKETCH_PARTS
    schema = "seg int, salt int, counts binary"
    for seg, _, counts in sketch.groupBy("seg", "salt").applyInArrow(_sum_counts, schema).groupBy("seg").applyInArrow(_sum_counts, schema).collect():  # SKETCH_PARTS rows
        out[seg * width : (seg + 1) * width] = np.frombuffer(counts, np.int32)
    return np.floor(4 * np.log2(np.maximum(out, 1))).astype(np.uint8)


def _signatures(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each row's set, as two arrays; zeros for empty sets."""
    out, full = np.zeros((2, len(offsets) - 1), np.uint64), np.flatnonzero(np.diff(offsets))
    if len(full):
        out[0, full] = np.add.reduceat(mixed(tokens, ORDERS[1]), offsets[full])
        out[1, full] = np.bitwise_xor.reduceat(mixed(tokens, ORDERS[2]), offsets[full])
    return out[0].view(np.int64), out[1].view(np.int64)


def _sign(size: int):
    """Rows (doc_id, n, s1, s2) of every text, and the task's counts of shingles in parts."""
    names = ["doc_id", "n", "s1", "s2", "seg", "salt", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            for row, tokens, offsets in of_batch(batch.column("text"), size):
                n = np.diff(offsets)
                s1, s2 = _signatures(tokens, offsets)
                if len(seen) >= GATHERED:
                    seen.clear()
                fresh = np.zeros(len(n), bool)  # a set counts once for each task, as far as it remembers
                for i, own in enumerate(zip(s1.tolist(), s2.tolist(), strict=True)):
                    if own not in seen:
                        seen.add(own)
                        fresh[i] = True
                counts += np.bincount((tokens[np.repeat(fresh, n)] >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts)).astype(np.int32)
                none = [pa.nulls(len(n), t) for t in (pa.int32(), pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, len(n)), pa.array(n), pa.array(s1), pa.array(s2), *none], names)
        if counts.any():
            k = SKETCH_PARTS
            rest = [pa.nulls(k, pa.int64())] * 4
            yield pa.RecordBatch.from_arrays([*rest, pa.array(range(k), pa.int32()), pa.array([TaskContext.get().partitionId() % 64] * k, pa.int32()), pa.array([x.tobytes() for x in np.split(counts, k)], pa.binary())], names)

    return run


def _prefixes(named: DataFrame, copies: DataFrame, classes, size: int, percent: int) -> DataFrame:
    """(c, n, first, others) of each class of equal sets, written: the place values of its prefix under the first
    order, and 32 bits of those under the others, one binary for each order. copies (doc_id, s1): rows that are not
    their class's first. A filter tells most other rows apart in their tasks; what it suspects is looked up."""
    spark = named.sparkSession
    suspects = shared_with(spark, key_filter(copies.select(id_hash("doc_id").alias("h")).distinct()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = suspects.value.test(batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64))
            for row, tokens, offsets in of_batch(batch.column("text"), size):
                n = np.diff(offsets)
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                values, own = [ranked(tokens, classes.value, o) for o in ORDERS], []
                for i in full.tolist():
                    first, *rest = (prefix(v[offsets[i] : offsets[i + 1]], percent) for v in values)
                    own.append((first.tobytes(), [np.sort((r >> np.uint64(16)).astype(np.uint32)).tobytes() for r in rest]))
                first, others = zip(*own, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row + full)), pa.array(n[full]), pa.array(_signatures(tokens, offsets)[0][full]), pa.array(maybe[row + full]), pa.array(first, pa.binary()), pa.array(others, pa.list_(pa.binary()))], ["c", "n", "s1", "maybe", "first", "others"])

    rows = staged(named.select("doc_id", id_hash("doc_id").alias("h"), "text").mapInArrow(lean(run), "c long, n long, s1 long, maybe boolean, first binary, others array<binary>"), "prefixes")
    release(suspects)
    sure = rows.where("not maybe")
    kept = staged(rows.where("maybe").join(copies.select(F.col("doc_id").alias("c"), "s1"), ["c", "s1"], "left_anti"), "firsts")
    # a doc_id that repeats with one text gives its row more than once, which costs no link
    return sure.select("c", "n", "first", "others").union(kept.select("c", "n", "first", "others"))


def _shared_rows(prefixes: DataFrame, total: int) -> DataFrame:
    """(tok, c, n, pos) of prefix tokens that two sets may share under the first order, written."""
    spark = prefixes.sparkSession

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def out() -> pa.RecordBatch:
            h, count = np.unique(np.frombuffer(b"".join(waiting), np.int64), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(count > 1)], ["h", "multi"])

        for batch in batches:
            for x in batch.column(0).to_pylist():
                waiting.append(x)
                held += len(x) // 8
            if held >= GATHERED:
                yield out()
                waiting, held = [], 0
        if held:
            yield out()

    hashes = prefixes.select("first").mapInArrow(lean(tokens), "h long, multi boolean")
    twice = shared_with(spark, repeated_filter(hashes, total))

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = np.array([len(x) // 8 for x in batch.column("first").to_pylist()], np.int64)
            own = np.frombuffer(b"".join(batch.column("first").to_pylist()), np.uint64)
            hit = np.flatnonzero(twice.value.test(own))
            at = np.repeat(np.arange(len(k)), k)[hit]
            place = hit - (np.cumsum(k) - k)[at]
            yield pa.RecordBatch.from_arrays([pa.array(own[hit].view(np.int64)), batch.column("c").take(pa.array(at)), batch.column("n").take(pa.array(at)), pa.array(place)], ["tok", "c", "n", "pos"])

    out = staged(prefixes.select("c", "n", "first").mapInArrow(lean(shared), "tok long, c long, n long, pos long"), "shared")
    release(twice)
    return out


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, count_links: bool = True) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, n_links (all other sets that the row's set links with; equal
    sets count once, and rows of one set show the same number), component_id (the least doc_id that links reach).
    Without count_links there is no n_links, which saves comparing all texts of each component.

    A-Z count as lower case; words are split at ASCII white space. Two rows link when 100 * intersection >= percent *
    union of their sets. Null or blank text has an empty set, links with nothing and is its own component. Rows that
    repeat a doc_id are one document for links, whose texts all count. A row without doc_id takes no part: its
    component_id is null. A very long text is read whole, by the task that holds it. Links at exactly the threshold
    count. Other columns of docs are ignored, whatever their names. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = staged(docs.mapInArrow(lean(_sign(size)), "doc_id long, n long, s1 long, s2 long, seg int, salt int, counts binary"), "signed")
    sets = signed.where("seg is null").select("doc_id", "n", "s1", "s2")
    classes = shared_with(spark, _classes(signed.where("seg is not null").select("seg", "salt", "counts")))
    named, equal = docs.where("doc_id is not null"), ["s1", "s2", "n"]
    full = sets.where("n > 0 and doc_id is not null")
    repeated = staged(full.groupBy(*equal).agg(F.min("doc_id").alias("c"), F.max("doc_id").alias("last")).where("c <> last").drop("last"), "repeated")
    copies = staged(full.join(repeated, equal).where("doc_id <> c").select("doc_id", "s1").distinct(), "copies")
    total = sets.agg(F.coalesce(F.sum(F.expr(f"n * {100 - percent} div 100 + 1")), F.lit(0))).first()[0]
    prefixes = _prefixes(named, copies, classes, size, percent)
    release(classes)
    rows = _shared_rows(prefixes, int(total))

    def bound(a: str, b: str):
        most = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
        return 100 * most >= percent * (F.col(f"{a}.n") + F.col(f"{b}.n") - most)

    at, links, tried, joined = rows.withColumn("comp", F.col("c")), None, None, None
    early = (F.col("pos") * 200 > (100 - percent) * F.col("n")).cast("int")  # 0: in the first half of its prefix
    share = (F.col("pos") * 1_000_000 / F.col("n")).cast("long")
    for by in ((early, F.col("c")), (share, F.col("c"))):
        first = F.min(F.struct(*(k.alias(f"k{i}") for i, k in enumerate(by)), "c", "n", "pos", "comp")).alias("z")
        centre = staged(at.groupBy("tok").agg(F.count("*").alias("k"), first).where("k > 1").select("tok", "z"), "centre")
        star = at.alias("x").join(centre.alias("y"), "tok").where((F.col("x.comp") != F.col("z.comp")) & bound("x", "z"))
        star = star.select(F.least("x.c", "z.c").alias("a"), F.greatest("x.c", "z.c").alias("b")).distinct()
        star = staged(star if tried is None else star.join(tried, ["a", "b"], "left_anti"), "stars")
        found = _verified(named, _intersected(star, prefixes), size, percent)
        tried, links = (star, found) if tried is None else (tried.union(star), staged(links.union(found), "links"))
        joined = components(links)
        at = staged(rows.join(joined.withColumnRenamed("node", "c"), "c", "left").withColumn("comp", F.coalesce("label", "c")).drop("label"), "placed")
        open_toks = staged(at.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("tok"), "unlike")
        at = staged(at.join(open_toks, "tok", "left_semi"), "open")
    rest = at.alias("x").join(at.alias("y"), "tok").where((F.col("x.c") < F.col("y.c")) & (F.col("x.comp") != F.col("y.comp")) & bound("x", "y"))
    rest = staged(rest.select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct().join(tried, ["a", "b"], "left_anti"), "rest")
    more = _verified(named, _intersected(rest, prefixes), size, percent)
    links = staged(links.union(more), "links")
    joined = components(links)
    nodes = joined.withColumnRenamed("node", "c")
    if count_links:
        nodes = nodes.join(_link_counts(named, joined, size, percent), "c", "left").withColumn("n_links", F.coalesce("n_links", F.lit(1).cast("long")))  # of two nodes each has one
    nodes = staged(nodes, "nodes")
    out = sets.join(repeated, equal, "left").withColumn("c", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id"))).join(nodes, "c", "left")
    # rows that repeat a doc_id with other texts are one document: their classes meet in it
    twins = out.where("doc_id is not null and n > 0").groupBy("doc_id").agg(F.min(F.coalesce("label", "c")).alias("lo"), F.max(F.coalesce("label", "c")).alias("hi")).where("lo <> hi")
    twins = staged(twins.select(F.col("lo").alias("a"), F.col("hi").alias("b")), "twins")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "c", "doc_id")))
    if not twins.isEmpty():
        met = staged(components(twins).select(F.col("node").alias("component_id"), F.col("label").alias("met")), "met")
        out = out.join(met, "component_id", "left").withColumn("component_id", F.coalesce("met", "component_id"))
    counted = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if count_links else []
    return out.select("doc_id", F.col("n").alias("n_shingles"), *counted, "component_id")


def _wanted(rows: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """The rows whose id is among the ids (id), and maybe a few others, written: a filter goes out, not the rows."""
    spark = rows.sparkSession
    wanted = shared_with(spark, key_filter(ids.distinct().select(id_hash("id").alias("h"))))

    @F.arrow_udf("boolean")
    def may_be(h: pa.Array) -> pa.Array:
        return pa.array(wanted.value.test(h.to_numpy(zero_copy_only=False).view(np.uint64)))

    out = staged(rows.where(may_be(id_hash(column))), "sought")
    release(wanted)
    return out


def _both_sides(pairs: DataFrame, rows: DataFrame, column: str, what: str) -> DataFrame:
    """pairs (a, b) with x and y: `what` of either, out of rows (column, what)."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id")))
    rows = _wanted(rows.select(column, what), column, ids)
    left = pairs.join(rows.select(F.col(column).alias("a"), F.col(what).alias("x")), "a")
    return left.join(rows.select(F.col(column).alias("b"), F.col(what).alias("y")), "b").select("a", "b", "x", "y")


def _intersected(pairs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """The pairs (a, b) that share a prefix token under each further order too, written."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                yes.append(all(len(np.intersect1d(np.frombuffer(s, np.uint32), np.frombuffer(t, np.uint32))) for s, t in zip(x, y, strict=True)))
            hit = pa.array(np.flatnonzero(yes))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(hit), batch.column("b").take(hit)], ["a", "b"])

    return staged(_both_sides(pairs, prefixes, "c", "others").mapInArrow(lean(meet), "a long, b long").distinct(), "candidates")


def _verified(docs: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, written. Only texts that a pair names are shuffled."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Prepared(size, percent)
        for batch in batches:
            yes = [ready.near(x, y) for x, y in zip(texts_of(batch, "x"), texts_of(batch, "y"), strict=True)]
            hit = pa.array(np.flatnonzero(yes))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(hit), batch.column("b").take(hit)], ["a", "b"])

    return staged(_both_sides(pairs, docs, "doc_id", "text").mapInArrow(lean(compare), "a long, b long").distinct(), "links")


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """The intersection size of each left with each right set."""
    every = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.int64)
    places = [[np.searchsorted(every, x[np.isin(x, every, assume_unique=True)]) for x in side] for side in (left, right)]
    for start in range(0, len(every), COLUMNS):
        a, b = (np.zeros((len(side), min(COLUMNS, len(every) - start)), np.float32) for side in places)
        for m, side in ((a, places[0]), (b, places[1])):
            for i, at in enumerate(side):
                lo, hi = np.searchsorted(at, (start, start + COLUMNS))
                m[i, at[lo:hi] - start] = 1
        out += np.rint(a @ b.T).astype(np.int64)
    return out


def exact_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Each text's shingles as numbers that are equal only where the words are: hashes, unless unlike words share one."""
    ids, hashes, spelled = WordIds(), [], []
    for text in texts:
        words = text.lower().split()
        tokens, place = np.unique(of_text(text, size), return_index=True)
        numbers = np.full(len(words) + size, -1, np.int32)
        numbers[: len(words)] = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
        hashes.append(tokens)
        spelled.append(numbers[place[:, None] + np.arange(size)])
    h, w = np.concatenate(hashes), np.concatenate(spelled)
    order = np.argsort(h, kind="stable")
    h, w = h[order], w[order]
    if ((h[1:] == h[:-1]) & (w[1:] != w[:-1]).any(axis=1)).any():
        number = np.empty(len(h), np.int64)
        number[order] = np.unique(w, axis=0, return_inverse=True)[1].reshape(-1)
        return [np.sort(x) for x in np.split(number, np.cumsum([len(x) for x in hashes])[:-1])]
    return hashes


def _link_counts(docs: DataFrame, joined: DataFrame, size: int, percent: int) -> DataFrame:
    """(c, n_links) of all nodes in components (node, label) of three nodes or more: how many others of its component
    a node links with. A component's nodes are dealt into blocks of about BLOCK_BYTES by a hash; each two blocks meet
    in one task, so a text is sent once for each block of its component, not for each partner."""
    many = staged(joined.groupBy("label").agg(F.count("*").alias("k")).where("k > 2").select("label"), "many")
    nodes = staged(joined.join(many, "label", "left_semi").select(F.col("node").alias("doc_id"), "label"), "members")
    texts = _wanted(docs, "doc_id", nodes.select(F.col("doc_id").alias("id"))).distinct().join(nodes, "doc_id")
    weight = F.greatest(F.octet_length("text"), F.lit(LEAST_BYTES)).cast("long")
    blocks = staged(texts.groupBy("label").agg(F.ceil(F.sum(weight) / BLOCK_BYTES).cast("long").alias("blocks")), "blocks")
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks"))
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: F.struct(F.least(other, own).alias("lo"), F.greatest(other, own).alias("hi")))
    rows = texts.join(blocks, "label").select("doc_id", "text", "label", own.alias("block"), F.explode(met).alias("cell")).select("label", "cell.*", "block", "doc_id", "text")

    def compare(cell: pa.Table) -> pa.Table:
        ids, block, lo, hi = (np.asarray(cell.column(c)) for c in ("doc_id", "block", "lo", "hi"))
        sets = exact_sets(texts_of(cell.combine_chunks().to_batches()[0]), size)
        sides = [np.flatnonzero(block == x[0]) for x in (lo, hi)]
        found = np.zeros((0, 2), np.int64)
        if all(len(side) for side in sides):
            left, right = ([sets[i] for i in side] for side in sides)
            shared = shared_counts(left, right)
            most = np.array([len(x) for x in left])[:, None] + np.array([len(x) for x in right]) - shared
            i, j = np.nonzero((shared > 0) & (100 * shared >= percent * most))
            found = np.sort(np.column_stack([ids[sides[0][i]], ids[sides[1][j]]]), axis=1)
            found = np.unique(found[found[:, 0] != found[:, 1]], axis=0)  # a doc_id may have several texts
        c, k = np.unique(found, return_counts=True)
        return pa.table({"c": pa.array(c, pa.int64()), "k": pa.array(k, pa.int64())})

    counts = rows.groupBy("label", "lo", "hi").applyInArrow(compare, "c long, k long")
    return counts.groupBy("c").agg(F.sum("k").alias("n_links"))
