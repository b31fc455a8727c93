"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

Sketch: in round ``i < t`` each element goes to a hashed bin with value ``i`` plus a hashed
fraction; in round ``t + j`` every element goes to bin ``j``. Each bin keeps its least value, and a
set stops once its bins are full, so 2t rounds fill every coordinate of every non-empty set. The
share of equal coordinates estimates the Jaccard similarity with the concentration of t
independent hashes.

Exact copies (equal shingle sets) are one class from the start. Classes that meet in a band's
bucket are compared without forming all pairs of the bucket. With n shingles of a class, T those of a
leader and d = |class Δ T|, a similarity of p % is a symmetric difference of at most k = (100 - p) /
(100 + p) of both sizes, so e = d - k n says by how much a class is out of the leader's reach:

1. every bucket picks one leader, the member that meets most others over all buckets, and each
   member is compared exactly with the leader;
2. two members with e + e' <= 0 are linked for certain (triangle inequality): each such member is
   linked to the one with the least e;
3. any other two can only be linked if the sets (class Δ T) share (e + e') / 2 elements at least.
   Members of one leader that are still in different components meet by the rarest of these
   elements, those within the prefix that the pair's own bound leaves, and are compared exactly.

So every candidate pair of the banding is confirmed, ruled out by a bound, or inside one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, U64, mix, raw, steps, stored, stream, table, windows, word_hashes, words
from .components import components, hot_keys, hottest, joined, merged

#: 40 bands of 5: a pair at similarity 0.8 shares no bucket with probability 1.3e-7.
BANDS, ROWS = 40, 5


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, and their n_texts+1 bounds, in ascending order."""
    data = LOWER[data]
    starts, ends, _, bounds = words(data, offsets)
    hashes = word_hashes(data, starts, ends)
    grams, at = windows(hashes, bounds, n)
    docs = np.searchsorted(bounds, at, "right") - 1
    counts = np.diff(bounds)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):  # the whole sequence is the one shingle
        by = stream(0xBEE, n)
        whole = np.zeros(len(short), U64)
        for j in range(n):
            has = counts[short] > j
            whole[has] += hashes[bounds[short[has]] + j] * by[j]
        grams = np.concatenate([grams, mix(whole + counts[short].astype(U64))])
        docs = np.concatenate([docs, short])
    order = np.lexsort((grams, docs))
    grams, docs = grams[order], docs[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (docs[1:] != docs[:-1])
    grams, docs = grams[new], docs[new]
    return grams, np.searchsorted(docs, np.arange(len(offsets)))


def sketch(grams: np.ndarray, bounds: np.ndarray, t: int) -> np.ndarray:
    """n_sets x t coordinates; rows of empty sets are all ones."""
    n, full = len(bounds) - 1, U64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * t, full, U64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    salts = stream(0xFA57, 2 * t)
    left = np.flatnonzero(np.diff(bounds) > 0)
    for i in range(2 * t):
        if not len(left):
            break
        h = mix(grams ^ salts[i])
        # the round is in the top 16 bits, so an earlier round always beats a later one
        value = (h >> U64(16)) | (U64(i) << U64(48))
        spot = mix(h ^ U64(0xB1)) % U64(t) if i < t else np.full(len(h), i - t, U64)
        np.minimum.at(out, owner * t + spot.astype(np.int64), value)
        open_ = left[(out.reshape(n, t)[left] == full).any(axis=1)]
        if len(open_) < len(left):
            left = open_
            keep = np.zeros(n, bool)
            keep[left] = True
            keep = keep[owner]
            grams, owner = grams[keep], owner[keep]
    return out.reshape(n, t)


def band_keys(sketches: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band; keys of different bands differ."""
    by = stream(0xBA2D, rows)
    parts = mix(sketches.reshape(len(sketches), bands, rows))
    out = np.zeros(parts.shape[:2], U64)
    for j in range(rows):
        out += parts[:, :, j] * by[j]
    return mix(out ^ stream(0xBA2E, bands)[None, :])


def _sums(grams: np.ndarray, bounds: np.ndarray) -> list[pa.Array]:
    """Two 64-bit sums over each set's hashed shingles: equal sets have equal sums and sizes."""
    out = []
    for salt in (0xF1, 0xF2):
        total = np.concatenate([[U64(0)], np.cumsum(mix(grams ^ U64(salt)))])
        out.append(pa.array((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)))
    return out


def _signatures(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, "text"):
                grams, bounds = shingles(*raw(texts), n)
                sizes = np.diff(bounds)
                keys = band_keys(sketch(grams, bounds, bands * rows), bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * bands, pa.int32()), pa.array(keys.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sizes.astype(np.int64)), *_sums(grams, bounds), lists], ["doc_id", "n_shingles", "f1", "f2", "keys"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in steps(batch, "text"):
                grams, bounds = shingles(*raw(texts), n)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(grams.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds).astype(np.int64)), *_sums(grams, bounds), lists], ["doc_id", "n_shingles", "f1", "f2", "grams"])

    return run


def _with_sets(pairs: DataFrame, sets: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``pairs`` (a, b, more columns) with the shingles ga and gb of both; ``hot`` are the keys b of many
    pairs, whose sets are copied instead of gathering the pairs in one task."""
    pairs = sets.select(F.col("id").alias("a"), F.col("grams").alias("ga")).join(pairs.hint("merge"), "a")
    return joined(pairs, sets.select(F.col("id").alias("b"), F.col("grams").alias("gb")), ["b"], hot, "a")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int, hot: DataFrame | None) -> DataFrame:
    """``pairs`` (a, b) compared on full sets: ``c`` shared shingles, sizes ``n``, ``m`` and ``linked``."""
    out = _with_sets(pairs, sets, hot).select("a", "b", F.size("ga").cast("long").alias("n"), F.size("gb").cast("long").alias("m"), F.size(F.array_intersect("ga", "gb")).cast("long").alias("c"))
    return out.withColumn("linked", F.col("c") * 100 >= (F.col("n") + F.col("m") - F.col("c")) * percent)


def _certain(faced: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(a, b) of step 2, for ``faced`` (leader, id, e, ...)."""
    least = faced.groupBy("leader").agg(F.min("e").alias("least"))
    best = joined(faced, least, ["leader"], hot, "id").where("e = least").groupBy("leader").agg(F.min("id").alias("best"), F.min("least").alias("least"))
    return joined(faced, best, ["leader"], hot, "id").where("id != best and e + least <= 0").select(F.col("id").alias("a"), F.col("best").alias("b"))


def _rest(faced: DataFrame, comps: DataFrame, sets: DataFrame, percent: int, hot: DataFrame | None) -> DataFrame:
    """(a, b) that step 3 has to compare; ``faced`` has leader, id, n, d and e (times 100 + percent)."""
    named = comps.select(F.col("node").alias("id"), "component")
    homes = comps.select(F.col("node").alias("leader"), F.col("component").alias("home"))
    all_ = joined(faced.join(named, "id", "left"), homes, ["leader"], hot, "id", "left")
    all_ = all_.select("leader", "id", "n", "d", "e", F.coalesce("component", "id").alias("comp"), F.coalesce("home", "leader").alias("home"))
    all_ = stored(all_, "faced")
    minor = F.col("comp") != F.col("home")
    # d - d' <= k (n + n') must hold both ways, or the pair is out of reach
    reach = F.col("e") + 2 * (100 - percent) * F.col("n")
    bounds = all_.groupBy("leader").agg(F.min("e").alias("any_e"), F.min(F.when(minor, F.col("e"))).alias("minor_e"), F.max(F.when(minor, reach)).alias("minor_reach"))
    bounds = bounds.where("minor_e is not null")
    all_ = joined(all_, bounds, ["leader"], hot, "id").where(minor | ((reach >= F.col("minor_e")) & (F.col("e") <= F.col("minor_reach"))))
    all_ = all_.withColumn("other_e", F.when(minor, F.col("any_e")).otherwise(F.col("minor_e"))).drop("any_e", "minor_e", "minor_reach")

    as_b = hot.withColumnRenamed("leader", "b") if hot is not None else None
    both = _with_sets(all_.withColumnRenamed("id", "a").withColumnRenamed("leader", "b"), sets, as_b).withColumnRenamed("a", "id").withColumnRenamed("b", "leader")
    apart = F.concat(F.array_except("ga", "gb"), F.array_except("gb", "ga"))
    spread = stored(both.select("leader", "id", "n", "d", "e", "comp", "home", "other_e", F.explode(apart).alias("el")), "apart")
    # elements that one component has alone come first in the order: they can't be what a pair shares
    often = spread.groupBy("leader", "el").agg(F.count("*").alias("often"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").drop("lo", "hi")
    own = W.partitionBy("leader", "id")
    spread = joined(spread, often, ["leader", "el"], hot_keys(spread, "leader", "el"), "id")
    spread = spread.withColumn("at", F.col("d") - F.count("*").over(own) + F.row_number().over(own.orderBy("often", "el")))
    need = lambda e: F.greatest(F.lit(1), F.ceil(e / (2 * (100 + percent))))
    spread = spread.where(F.col("at") <= F.col("d") - need(F.col("e") + F.col("other_e")) + 1)
    spread = stored(spread.select("leader", "el", "id", "n", "d", "e", "comp", "home", "at"), "prefixes")
    x = spread.where(minor).select("leader", "el", "home", *(F.col(c).alias("x" + c) for c in ("id", "n", "d", "e", "comp", "at")))
    y = spread.select("leader", "el", *(F.col(c).alias("y" + c) for c in ("id", "n", "d", "e", "comp", "at")))
    share = need(F.col("xe") + F.col("ye"))
    apart = (F.col("xcomp") != F.col("ycomp")) & ((F.col("ycomp") == F.col("home")) | (F.col("xcomp") < F.col("ycomp")))
    fits = (F.col("xat") <= F.col("xd") - share + 1) & (F.col("yat") <= F.col("yd") - share + 1) & (F.least("xn", "yn") * 100 >= F.greatest("xn", "yn") * percent)
    found = x.join(y.hint("merge"), (x.leader == y.leader) & (x.el == y.el) & apart & fits)
    return found.select(F.least("xid", "yid").alias("a"), F.greatest("xid", "yid").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs`` (doc_id, text).

    Two documents are linked if ``100 * intersection >= percent * union`` of their distinct word
    shingles (A-Z lower-cased). ``component_id`` is the smallest doc_id reachable over links,
    ``kept`` marks the document that has it.

    Null or blank text: no shingles, linked with nothing. Null doc_id: linked with nothing,
    component_id null, kept. Rows that repeat a doc_id are one node: each is returned, and their
    links are joined. Extra columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, n_shingles long, f1 long, f2 long, keys array<long>"
    signed = docs.mapInArrow(_signatures(shingle_words, bands, rows), schema).withColumn("row", F.monotonically_increasing_id())
    signed = stored(signed, "signed")
    own = signed.where("doc_id is not null and n_shingles > 0")
    same = ["f1", "f2", "n_shingles"]
    # a class goes by the least number of its rows
    classes = own.groupBy(*same).agg(F.min("row").alias("id"), F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    classes = stored(classes, "classes")

    # members of buckets that hold two classes or more
    spread = classes.select("id", F.explode("keys").alias("key"))
    met = stored(spread.groupBy("key").agg(F.count("*").alias("c")).where("c > 1"), "met")
    full = hottest(met, bands * classes.count(), "key")
    members = stored(joined(spread, met, ["key"], full, "id"), "members")
    weight = stored(members.groupBy("id").agg(F.sum("c").alias("weight")), "weight")
    # the heaviest member leads, the smallest id of those; both maxima are plain numbers
    ranked = members.join(weight.hint("merge"), "id")
    top = ranked.groupBy("key").agg(F.max("weight").alias("weight"))
    top = top.withColumnRenamed("weight", "most")
    leaders = joined(ranked, top, ["key"], full, "id").where("weight = most").groupBy("key").agg(F.min("id").alias("leader"))
    star = joined(members.select("key", "id"), leaders, ["key"], full, "id").where("id != leader").select(F.col("id").alias("a"), F.col("leader").alias("b")).distinct()
    star = stored(star, "star")
    hot = hot_keys(star, "b")

    # a doc_id that repeats: its rows may be equal, or texts of several classes, which are linked then
    repeated = stored(own.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"), "repeated")
    repeats = bool(repeated.limit(1).count())

    needed = classes.drop("keys").join(weight.select("id"), "id", "left_semi")
    texts = docs.join(needed.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    sets = texts.mapInArrow(_sets(shingle_words), "doc_id long, n_shingles long, f1 long, f2 long, grams array<long>")
    sets = sets.join(needed.hint("merge"), ["doc_id", *same]).select("id", "grams")
    sets = stored(sets.groupBy("id").agg(F.first("grams").alias("grams")) if repeats else sets, "sets")

    compared = stored(_compared(star, sets, percent, hot), "compared")
    apart = F.col("n") + F.col("m") - 2 * F.col("c")
    faced = compared.select(F.col("b").alias("leader"), F.col("a").alias("id"), "n", apart.alias("d"), ((100 + percent) * apart - (100 - percent) * F.col("n")).alias("e"))
    hot = hot.withColumnRenamed("b", "leader") if hot is not None else None
    links = compared.where("linked").select("a", "b").union(_certain(faced, hot))
    if repeats:
        several = own.join(repeated, "doc_id", "left_semi").join(classes.select(*same, "id"), same).select("doc_id", "id").distinct()
        several = stored(several, "several")
        least = several.groupBy("doc_id").agg(F.min("id").alias("a"))
        links = links.union(several.join(least, "doc_id").where("id != a").select("a", F.col("id").alias("b")).distinct())
    comps = components(links)
    rest = stored(_rest(faced, comps, sets, percent, hot), "rest")
    more = stored(_compared(rest, sets, percent, hot_keys(rest, "b")).where("linked").select("a", "b"), "more")
    comps = merged(comps, more)

    # class of each row, by the smallest doc_id of its component
    named = classes.select(*same, "id", "doc_id").join(comps.withColumnRenamed("node", "id").hint("merge"), "id", "left")
    named = stored(named.select(*same, F.coalesce("component", "id").alias("component"), "doc_id"), "named")
    first = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = joined(named.drop("doc_id"), first, ["component"], hot_keys(named, "component"), "f1").select(*same, "component_id")
    out = joined(signed.select("row", "doc_id", *same), named, same, hot_keys(signed, *same), "row", "left")
    component = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 2 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS g FROM w
), c AS (
  SELECT min(doc_id) AS id, any_value(g) AS g, len(any_value(g)) AS n FROM s WHERE len(g) > 0 GROUP BY list_sort(g)
), links AS (
  SELECT a.id AS a, b.id AS b, len(list_intersect(a.g, b.g)) AS x, a.n + b.n AS t
  FROM c a JOIN c b ON a.id < b.id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
), e AS (
  SELECT a, b FROM links WHERE 100 * x >= 80 * (t - x)
  UNION SELECT min(s.doc_id) OVER (PARTITION BY list_sort(s.g)), s.doc_id FROM s WHERE len(s.g) > 0
), d AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (
  SELECT doc_id AS node, doc_id AS root FROM s
  UNION SELECT d.b, r.root FROM r JOIN d ON d.a = r.node
)
SELECT s.doc_id, len(s.g) AS n_shingles, m.root AS component_id, s.doc_id = m.root AS kept
FROM s JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) m ON m.node = s.doc_id
"""
