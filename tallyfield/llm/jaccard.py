"""Set similarity join on word shingles by vertical partitioning of the global shingle order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import column, lower_table, mix, native_id_type, separators, slices, table, utf8, window_hashes, word_hashes
from tallyfield.llm.registry import query
from tallyfield.session import pinned, scratch_path

SHINGLE = 4
PERCENT = 85
#: The shingle order is cut into so many ranges of equal width; overlaps are counted range by range.
FRAGMENTS = 8
#: Shingles that a slice of about 4 MB of text holds in so many different documents are candidates for the end of the order, and
#: the list of them has a fixed size. The list only orders shingles: any order finds the same links.
FREQUENT_IN_SLICE, FREQUENT = 2, 1 << 19
#: Rounds of comparisons with heads. Every candidate pair they leave open is compared after them, so their number changes costs only.
HEAD_ROUNDS = 1
#: Heads that a set is held against in a round.
HEADS = 3
#: A pair with the smaller key first.
ORDERED = ["least(a, b) as a", "if(a < b, na, nb) as na", "greatest(a, b) as b", "if(a < b, nb, na) as nb"]
#: Bits of the fixed-size filter that keeps sets without any candidate pair from being shipped.
FILTER_BITS = 1 << 23


def shingle_sets(docs: list[bytes], size: int = SHINGLE) -> Iterator[np.ndarray]:
    """Each document's distinct shingles as sorted 64-bit hashes; fewer words than ``size`` make one shingle, none an empty set."""
    if not docs:
        return
    lower = lower_table()
    words, begin = word_hashes([d.translate(lower) for d in docs], separators())
    grams = window_hashes(words, size)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            yield mix(window_hashes(words[a:b], b - a) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def class_key(grams: np.ndarray) -> int:
    """A hash of the whole set. Together with the set's size it stands for the class of documents with this very set."""
    return int(np.bitwise_xor(mix(mix(grams ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)[None]), np.uint64(len(grams)))[0].astype(np.int64))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root) with the least node of each component; alternating large and small stars until nothing changes."""

    def settled(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = pinned(df.distinct())
        return df, tuple(df.agg(F.count("*"), F.expr("sum(cast(xxhash64(a, b) as decimal(38)))")).first())

    edges, mark = settled(edges.where("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b"))
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").selectExpr("b as a", "m as b").where("a <> b").union(smallest.select("a", F.col("m").alias("b")))
        edges, now = settled(small)
        if now == mark:
            return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        mark = now


class Join:
    """The join of one table of documents; every step that is read twice is written to the shared folder."""

    def __init__(self, documents: DataFrame, size: int, percent: int):
        self.docs = documents.select("doc_id", "text")
        self.spark, self.size, self.percent = documents.sparkSession, size, percent
        self.kind = native_id_type(documents)

    def members(self) -> DataFrame:
        """(doc_id, n, c) of every document, and the frequent shingles of the corpus for :meth:`prefixes`."""
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for batch in slices(batches, "text"):
                sets = list(shingle_sets(utf8(batch, "text"), size))
                n = len(sets)
                docs = column(batch, "doc_id")
                classes = [class_key(s) for s in sets]
                yield pa.record_batch([docs, pa.array([len(s) for s in sets], pa.int64()), pa.array(classes, pa.int64()), pa.array([None] * n, pa.int64()), pa.array(["member"] * n)], ["doc_id", "n", "c", "sig", "kind"])
                fresh = [s for c, s in dict(zip(classes, sets, strict=True)).items() if c not in seen]
                seen.update(classes)
                sigs, times = np.unique(np.concatenate([*fresh, np.zeros(0, np.uint64)]), return_counts=True)
                often = times >= FREQUENT_IN_SLICE
                k = int(often.sum())
                if k:
                    yield pa.record_batch([pa.nulls(k, docs.type), pa.array(times[often]), pa.nulls(k, pa.int64()), pa.array(sigs[often].astype(np.int64)), pa.array(["frequent"] * k)], ["doc_id", "n", "c", "sig", "kind"])

        folder = scratch_path(self.spark, "shingle-members")
        schema = f"doc_id {self.kind}, n long, c long, sig long"
        self.docs.mapInArrow(run, f"{schema}, kind string").write.partitionBy("kind").parquet(folder)
        every = self.spark.read.schema(f"{schema}, kind string").parquet(folder)
        top = every.where("kind = 'frequent'").groupBy("sig").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "sig").limit(FREQUENT).toArrow()
        order = np.argsort(top["sig"].to_numpy().astype(np.uint64))
        self.frequent = (top["sig"].to_numpy().astype(np.uint64)[order], top["n"].to_numpy()[order].astype(np.int64))
        members = every.where("kind = 'member'").select("doc_id", "n", "c")
        self.least = members.groupBy("c").agg(F.min("doc_id").alias("doc_id"))
        return members

    def prefixes(self) -> DataFrame:
        """(sig, c, n, i): the first shingles of each set in the global order, frequent ones last, with their places in it from 0 on.

        Two sets that link share at least ceil(percent n / 100) shingles of either, so their first n - that + 1 must meet.
        Classes already seen by the same task are left out: they would repeat its rows.
        """
        size, percent = self.size, self.percent
        held = self.spark.sparkContext.broadcast(self.frequent)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            often, times = held.value
            seen: set[int] = set()
            for batch in slices(batches, "text"):
                sigs, classes, sizes, counts = [], [], [], []
                for grams in shingle_sets(utf8(batch, "text"), size):
                    n, c = len(grams), class_key(grams)
                    if not n or c in seen:
                        continue
                    seen.add(c)
                    keep = n - (percent * n + 99) // 100 + 1
                    if len(often):
                        at = np.minimum(np.searchsorted(often, grams), len(often) - 1)
                        weight = np.where(often[at] == grams, times[at], 0)
                        if weight.any():
                            grams = grams[np.argsort(weight, kind="stable")]
                    sigs.append(grams[:keep])
                    classes.append(c)
                    sizes.append(n)
                    counts.append(keep)
                if sigs:
                    rows = [np.concatenate(sigs).astype(np.int64), np.repeat(np.array(classes, np.int64), counts), np.repeat(np.array(sizes, np.int32), counts), np.concatenate([np.arange(k, dtype=np.int32) for k in counts])]
                    yield pa.record_batch([pa.array(x) for x in rows], ["sig", "c", "n", "i"])

        return self.docs.mapInArrow(run, "sig long, c long, n int, i int")

    def fragments(self, wanted: DataFrame) -> DataFrame:
        """(c, fragment, grams) of the wanted classes, read from one document of each, the one with the least id.

        A filter of fixed size, filled from hashes of those ids, keeps all other documents' sets from being shipped. What it lets through
        wrongly finds no pair later; a repeated row repeats equal counts.
        """
        bits = FILTER_BITS
        keys = wanted.join(self.least, "c").select(F.expr(f"pmod(xxhash64(doc_id), {bits})").alias("bit"))
        words = keys.groupBy(F.expr("bit div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit % 64 as int)))").alias("mask")).toArrow()  # a fixed number of words at most
        filter_ = np.zeros(bits // 64, np.int64)
        filter_[words["word"].to_numpy()] = words["mask"].to_numpy()
        held = self.spark.sparkContext.broadcast(filter_)
        size = self.size

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "text"):
                at = column(batch, "bit").to_numpy()
                wanted_here = (held.value[at // 64] >> (at % 64)) & 1 == 1
                picked = [t for t, w in zip(utf8(batch, "text"), wanted_here, strict=True) if w]
                classes, fragment, ends, grams_of = [], [], [0], []
                for grams in shingle_sets(picked, size):
                    if not len(grams):
                        continue
                    c = class_key(grams)
                    cuts = np.searchsorted(grams, np.arange(1, FRAGMENTS, dtype=np.uint64) << np.uint64(61)).tolist()
                    for f, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(grams)], strict=True)):
                        if b > a:
                            classes.append(c)
                            fragment.append(f)
                            ends.append(ends[-1] + b - a)
                    grams_of.append(grams)
                if classes:
                    values = pa.array(np.concatenate(grams_of).astype(np.int64))
                    yield pa.record_batch([pa.array(classes, pa.int64()), pa.array(fragment, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)], ["c", "fragment", "grams"])

        keyed = self.docs.select("text", F.expr(f"pmod(xxhash64(doc_id), {bits})").alias("bit"))
        return keyed.mapInArrow(run, "c long, fragment int, grams array<long>")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a, na, b, nb), the links: partial overlaps are counted per fragment and summed per pair."""
        left = self.fragments(pairs.selectExpr("a as c").distinct()).toDF("a", "fragment", "left")
        right = self.fragments(pairs.selectExpr("b as c").distinct()).toDF("b", "fragment", "right")
        met = pairs.join(left, "a").join(right, ["b", "fragment"])
        partial = met.groupBy("a", "na", "b", "nb", "fragment").agg(F.max(F.size(F.array_intersect("left", "right"))).cast("long").alias("overlap"))
        return partial.groupBy("a", "na", "b", "nb").agg(F.sum("overlap").alias("overlap")).where(f"100 * overlap >= {self.percent} * (na + nb - overlap)").select("a", "b")

    def near(self, a: str, b: str) -> str:
        return f"100 * least({a}, {b}) >= {self.percent} * greatest({a}, {b})"

    def enough(self, times: str, a: str, b: str) -> str:
        """Condition that ``times`` shared prefix shingles leave a link possible.

        Of two sets, the one whose prefix ends first in the global order meets the other only in both prefixes or in its own rest, which has
        ceil(percent n / 100) - 1 shingles.
        """
        p = self.percent
        return f"{times} >= ({p} * ({a} + {b}) + {99 + p}) div {100 + p} - ({p} * greatest({a}, {b}) + 99) div 100 + 1"

    def early(self, i: str, j: str, a: str, b: str) -> str:
        """Condition that a shingle at places ``i`` and ``j`` can be the first that two linked sets share.

        A link needs an overlap of m = ceil(percent (a + b) / (100 + percent)); behind the first shared shingle, either set holds m - 1 more. A set
        whose own shingles fill these places, as one edited too much to link with others of its group, meets none of them.
        """
        p = self.percent
        need = f"(({p} * ({a} + {b}) + {99 + p}) div {100 + p})"
        return f"{i} <= {a} - {need} and {j} <= {b} - {need}"

    def open_pairs(self, left_open: DataFrame) -> DataFrame:
        """(a, na, b, nb): pairs of classes of different components that share a shingle early in both prefixes."""
        x, y = left_open.alias("x"), left_open.alias("y")
        met = x.join(y, F.expr(f"x.sig = y.sig and x.c < y.c and x.root <> y.root and {self.near('x.n', 'y.n')} and {self.early('x.i', 'y.i', 'x.n', 'y.n')}"))
        return met.selectExpr("x.c as a", "cast(x.n as long) as na", "y.c as b", "cast(y.n as long) as nb").distinct()

    def enough_shared(self, pairs: DataFrame, left_open: DataFrame) -> DataFrame:
        """Of :meth:`open_pairs`, those whose prefixes share enough for a link.

        ``left_open`` has the prefix shingles of groups with several components, so all that such a pair shares. The list of a class is bounded by its own set.
        """
        prefix = left_open.join(pairs.select("a").union(pairs.select("b")).distinct().toDF("c"), "c", "left_semi").groupBy("c").agg(F.collect_list("sig").alias("sigs"))
        both = pairs.join(prefix.toDF("a", "left"), "a").join(prefix.toDF("b", "right"), "b")
        return both.where(self.enough("size(array_intersect(left, right))", "na", "nb")).select("a", "na", "b", "nb")

    def heads(self, met: DataFrame, roots: DataFrame, tried: DataFrame | None, turn: int) -> DataFrame:
        """(a, na, b, nb): each class b with up to ``HEADS`` heads a of other components, those it meets in most signature groups, not tried before.

        A group's heads are the class with the least of its own in its prefix, as an unedited original among its edited copies, and those with the
        least and greatest hash, drawn anew with every turn.
        """
        marked = met.join(roots.withColumnRenamed("node", "c"), "c", "left").select("sig", "c", "n", F.coalesce("root", "c").alias("root"))
        # of a class's prefix, the part that others have too; the rows of one class are bounded by its own set
        shared = F.count("*").over(Window.partitionBy("c")) / F.expr(f"n - ({self.percent} * n + 99) div 100 + 1")
        marked = marked.withColumn("shared", shared)
        draw = F.xxhash64("c", F.lit(turn))
        one = F.struct("root", "c", "n")
        picked = [F.max_by(one, F.struct("shared", draw)), F.max_by(one, draw), F.min_by(one, draw)]
        head = marked.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.array_distinct(F.array(*picked)).alias("heads")).where("low <> high")
        pairs = marked.join(head.select("sig", "heads"), "sig").select("root", "c", "n", F.explode("heads").alias("head")).where("root <> head.root")
        pairs = pairs.groupBy(F.col("head.c").alias("a"), F.col("head.n").cast("long").alias("na"), F.col("c").alias("b"), F.col("n").cast("long").alias("nb")).agg(F.count("*").alias("times"))
        pairs = pairs.where(self.near("na", "nb")).where(self.enough("times", "na", "nb"))
        if tried is not None:
            pairs = pairs.join(tried.select("a", "b").union(tried.select("b", "a")), ["a", "b"], "left_anti")
        # a class has at most HEADS heads in each group of its prefix, so this list is bounded by its own set
        best = F.slice(F.sort_array(F.collect_list(F.struct("times", "a", "na")), asc=False), 1, HEADS)
        best = pairs.groupBy("b", "nb").agg(best.alias("best")).select(F.explode("best").alias("best"), "b", "nb")
        return best.selectExpr("best.a as a", "best.na as na", "b", "nb").selectExpr(*ORDERED).distinct()

    def links(self) -> DataFrame:
        """Links between distinct sets that give the same components as all links.

        In rounds, every set is held against a few of its candidates, heads of signature groups that it meets most often and that lie in other
        components by then. This settles groups of many near copies with a few comparisons each. Then all candidate pairs that still lie
        in different components are compared, if their prefixes share a shingle early and enough in all.
        """
        group = Window.partitionBy("sig")  # of at most one row per class, as a set holds a shingle once
        rows = self.prefixes().select("sig", "c", "n", "i", F.min("c").over(group).alias("head"), F.max("c").over(group).alias("other"))
        met = pinned(rows.where("head <> other").select("sig", "c", "n", "i"))
        roots = met.selectExpr("c as node", "c as root").limit(0)
        linked = tried = None
        for turn in range(HEAD_ROUNDS):
            best = pinned(self.heads(met, roots, tried, turn))
            found = pinned(self.verified(best))
            tried = best if tried is None else tried.union(best)
            linked = found if linked is None else linked.union(found)
            if found.isEmpty():
                break
            roots = components(linked)
        marked = met.join(roots.withColumnRenamed("node", "c"), "c", "left").select("sig", "c", "n", "i", F.coalesce("root", "c").alias("root"))
        open_ = marked.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("sig")
        left_open = pinned(marked.join(open_, "sig"))
        done = tried.selectExpr("least(a, b) as a", "greatest(a, b) as b")
        rest = pinned(self.open_pairs(left_open).join(done, ["a", "b"], "left_anti"))
        rest = pinned(self.enough_shared(rest, left_open))
        return linked.union(self.verified(rest))


def near_duplicates(documents: DataFrame, size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every document.

    Links are exact: ``100 * intersection >= percent * union``. Documents without words (null text too) link with nothing and stand for
    themselves; equal sets are one class and link; repeated rows are copies of each other. A null doc_id is never the least of a component
    with another id. An empty table gives no rows. Other columns are not read.
    """
    join = Join(documents, size, percent)
    members = join.members()
    roots = components(join.links()).toDF("c", "root")
    marked = pinned(members.where("n > 0").join(roots, "c", "left").select("doc_id", "n", F.coalesce("root", "c").alias("root")))
    least = marked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = marked.join(least, "root").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return named.unionByName(members.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


@query("op4_jaccard")
def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
