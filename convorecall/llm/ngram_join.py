"""N-gram Jaccard join: an exact similarity join of documents in the metric space of their word-shingle sets.

Two metrics on sets serve: the Jaccard distance, and the size of the symmetric difference. A pair is linked if its
Jaccard similarity is percent/100 or more, that is if its difference is at most (100 - percent)/(100 + percent) of the
sum of both sizes. Nearly all pairs of a corpus are at the largest Jaccard distance, 1, where document pivots see
only ties. The space is therefore entered through single shingles, and document pivots part what is crowded:

1. Equal sets are one point: the smallest doc_id stands for its copies.
2. A set's zone is the part of it with the smallest hash values (a quarter, where a fifth would do). Two linked sets share
   a shingle in the first fifth of either set, in any common order of shingles. The order here is by hash, with the
   common shingles, which are in more than COMMON zones, last. One aggregate finds the members of every shingle that is
   not common. For each pair that it brings up, the shingles shared inside the zones bound those shared at all; pairs
   within the bound are measured.
3. Sets whose zone is crowded by common shingles take their prefix from the whole set, the rarer shingles first. Each
   shingle of these prefixes is a region. Pairs in small regions are measured. In a large region some members become
   pivots, of near ones only the most central, and distances to them are measured exactly: a set's Voronoi cell is that of its
   nearest pivot, and a set at a boundary, whose distance to another pivot is within twice the radius of its
   nearest, is replicated there, so that any two linked sets share a cell.
4. In a cell each set is replaced by its difference from the pivot. The difference of two sets is that of their
   differences, so the join inside a cell is a join of these, which are small where the cell is dense: what all members
   share with the pivot is gone. Their prefixes, rarest first within the cell, are the regions of the next round; the
   pivot's windows (by the triangle inequality, differences' sizes may not differ by more than the allowed difference)
   and the place in the order cut the pairs. Sets linked to one pivot are connected and never form pairs, so copies
   of one text never become all their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convorecall.llm.components import components
from convorecall.llm.scratch import scope, small, written
from convorecall.llm.textkit import Words, distinct_pairs, map_texts, mix, string_column, text_slices

#: Zones with a shingle in more documents than this make the shingle a common one. It is 3, as the least, the greatest and
#: the exclusive or of up to three ids tell all of them.
COMMON = 3
#: Members up to which a region's pairs are measured at once; to the power of the round, as differences leave fewer pairs.
LEAF = 32
#: Pivots drawn from a region at most, and the distance within which of two only the more central one stays.
PIVOTS = 16
NET = 0.6
#: Rounds of pivots; the regions after the last one are joined whatever their size.
ROUNDS = 3
#: Shingles of all pivots up to which their sets are sent to all executors.
PIVOT_SHINGLES = 4_000_000


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    at = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.view(np.int64)))


def _sets(words: int, zone: bool):
    """Arrow batches of doc_id, text -> doc_id, n, digest, items: the zone, or the whole set; in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            for lo, hi, data, offsets in text_slices(string_column(batch, "text")):
                row, h = distinct_pairs(*Words(data, offsets).shingles(words))
                n = np.bincount(row, minlength=hi - lo).astype(np.int64)
                first = np.concatenate([[0], np.cumsum(n)])
                sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)])
                digest = (sums[first[1:]] - sums[first[:-1]]).view(np.int64)
                size = n
                if zone:
                    size = np.where(n > 0, np.minimum(n, n // 4 + 1), 0)
                    h = h[np.arange(len(h)) - first[row] < size[row]]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n), pa.array(digest), _lists(h, size)], names=["doc_id", "n", "digest", "items"])

    return run


_SET = "doc_id long, n long, digest long, items array<long>"


def shingle_sets(docs: DataFrame, words: int = 5, zone: bool = False) -> DataFrame:
    """``doc_id, n, digest, items`` of each document; items are the sorted 64-bit hashes of its distinct shingles."""
    return map_texts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _sets(words, zone), _SET)


class _Rule:
    """When two sets are linked, as column expressions."""

    def __init__(self, percent: int):
        self.percent = percent
        self.radius = 1 - percent / 100

    def shared_enough(self, inter: Column, nx: Column, ny: Column) -> Column:
        return (100 + self.percent) * inter >= self.percent * (nx + ny)

    def differ_little(self, difference: Column, nx: Column, ny: Column) -> Column:
        return (100 + self.percent) * difference <= (100 - self.percent) * (nx + ny)

    def prefix(self, n: Column) -> Column:
        return F.floor((100 - self.percent) * n / 100) + 1


def _beside(pairs: DataFrame, sets: DataFrame, pivots: bool = False) -> DataFrame:
    """``pairs`` (x, y and more) with ``nx, ny, x_items, y_items``; ``pivots`` says that the y are few different ones."""
    left = sets.select(F.col("doc_id").alias("x"), F.col("n").alias("nx"), F.col("items").alias("x_items"))
    right = sets.select(F.col("doc_id").alias("y"), F.col("n").alias("ny"), F.col("items").alias("y_items"))
    if pivots:
        right = written(right.join(pairs.select("y").distinct(), "y"), "pivot_sets")
        total = right.agg(F.coalesce(F.sum("ny"), F.lit(0)).alias("n")).first().n
        return pairs.join(left, "x").join(F.broadcast(right) if total <= PIVOT_SHINGLES else right, "y")
    return pairs.hint("merge").join(left, "x").hint("merge").join(right, "y")


def _measured(pairs: DataFrame, sets: DataFrame, rule: _Rule, pivots: bool = False) -> DataFrame:
    """``x, y, nx, ny, inter, linked`` of pairs; ``inter`` is the size of the intersection."""
    met = _beside(pairs.select("x", "y"), sets, pivots).select("x", "y", "nx", "ny", F.size(F.array_intersect("x_items", "y_items")).cast("long").alias("inter"))
    return met.withColumn("linked", rule.shared_enough(F.col("inter"), F.col("nx"), F.col("ny")))


def _labels(links: DataFrame) -> DataFrame:
    """``doc_id, comp`` of linked documents."""
    return written(components(links.select(F.col("x").alias("a"), F.col("y").alias("b"))).toDF("doc_id", "comp"), "labels")


def _with_comp(df: DataFrame, labels: DataFrame) -> DataFrame:
    return df.join(labels, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))


def _open(members: DataFrame, key: str) -> DataFrame:
    """Rows of the groups whose members are not all connected yet."""
    parts = members.groupBy(key).agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1")
    return members.join(parts.select(key), key)


def _met(members: DataFrame, condition: Column) -> DataFrame:
    """Distinct pairs ``x, y`` of members of one region that the condition, over x's columns and y's ``_y``, lets through."""
    other = members.select("region", *[F.col(c).alias(f"{c}_y") for c in members.columns if c != "region"])
    pairs = members.join(other, "region").where((F.col("doc_id") < F.col("doc_id_y")) & (F.col("comp") != F.col("comp_y")) & condition)
    return pairs.select(F.col("doc_id").alias("x"), F.col("doc_id_y").alias("y")).distinct()


def _zone_pairs(shared: DataFrame, info: DataFrame, rule: _Rule) -> DataFrame:
    """Pairs that share a shingle that is not common, and whose zones allow a link."""
    third = F.col("a").bitwiseXOR(F.col("b")).bitwiseXOR(F.col("all"))
    two = [F.struct(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")) for x, y in ((F.col("a"), F.col("b")), (F.col("a"), third), (third, F.col("b")))]
    few = shared.where(F.col("count") <= COMMON).select(F.explode(F.when(F.col("count") == 2, F.array(two[0])).otherwise(F.array(*two))).alias("p"))
    met = few.select("p.*").where("x <> y").groupBy("x", "y").agg(F.count("*").alias("both"))
    side = lambda s: info.select(F.col("doc_id").alias(s), F.col("n").alias(f"n{s}"), F.col("late").alias(f"late_{s}"))
    met = met.join(side("x"), "x").join(side("y"), "y")
    outside = lambda n: n - F.least(n, F.floor(n / 4) + 1)
    # shared and common, or shared outside the zone that ends first
    most = F.col("both") + F.least("late_x", "late_y") + F.greatest(outside(F.col("nx")), outside(F.col("ny")))
    return met.where(rule.shared_enough(F.least(most, "nx", "ny"), F.col("nx"), F.col("ny"))).select("x", "y")


def _crowded_regions(entries: DataFrame, info: DataFrame, common: DataFrame, docs: DataFrame, words: int, rule: _Rule) -> tuple[DataFrame, DataFrame]:
    """``region, doc_id, n, at`` of documents crowded by common shingles and those that share a prefix shingle with them; and the former's sets.

    ``at`` is the place in the document's order, at the least. Regions of equal members are one.
    """

    def crowd(late: DataFrame) -> DataFrame:
        room = F.least("n", F.floor(F.col("n") / 4) + 1) - F.col("late")
        return late.where(room < F.least(rule.prefix(F.col("n")), "n"))

    def whole(ids: DataFrame, name: str) -> DataFrame:
        return written(shingle_sets(docs.join(small(ids), "doc_id", "left_semi"), words).select("doc_id", "n", "items"), name)

    first = written(crowd(info).select("doc_id"), "crowded")
    sets = whole(first, "whole")
    more = sets.select(F.explode("items").alias("g")).groupBy("g").agg(F.count("*").alias("often")).where(F.col("often") > COMMON)
    common = written(common.join(more, "g", "full").select("g", F.coalesce("often", F.lit(0)).alias("often")), "common")
    late = entries.join(small(common.select("g")), "g", "left_semi").groupBy("doc_id").agg(F.count("*").alias("late"))
    late = written(info.select("doc_id", "n").join(late, "doc_id"), "late")
    crowded = written(crowd(late).select("doc_id"), "crowded")
    later = written(crowded.join(first, "doc_id", "left_anti"), "crowded")
    sets = sets.unionByName(whole(later, "whole"))
    ranked = sets.select("doc_id", "n", F.explode("items").alias("g")).join(small(common), "g", "left")
    rank = F.expr("row_number() over (partition by doc_id order by coalesce(often, -1), g < 0, g)")  # by unsigned hash, as zones are
    again = ranked.withColumn("rank", rank).where(F.col("rank") <= rule.prefix(F.col("n")))
    again = written(again.select("g", "doc_id", "n", (F.col("rank") - 1).cast("long").alias("at"), F.col("often").isNull().alias("rare")), "prefixes")
    rare = written(again.where("rare").select("g").distinct(), "rare")
    light = entries.join(small(rare), "g", "left_semi").join(small(crowded), "doc_id", "left_anti").join(info.select("doc_id", "n"), "doc_id")
    both = written(again.drop("rare").unionByName(light.select("g", "doc_id", "n", F.lit(0).cast("long").alias("at"))), "prefixes")
    members = [F.expr(f"bit_xor(xxhash64(doc_id, {k}))").alias(f"m{k}") for k in (1, 2)]
    region = both.groupBy("g").agg(F.count("*").alias("size"), *members).where("size > 1")
    region = region.select("g", F.xxhash64("size", "m1", "m2").alias("region"))
    return written(both.join(region, "g").groupBy("region", "doc_id", "n").agg(F.min("at").alias("at")), "regions"), sets


def _cells(large: DataFrame, sets: DataFrame, rule: _Rule) -> tuple[DataFrame, DataFrame]:
    """Voronoi cells ``pivot, doc_id, n, pivot_n, inter`` of the pivots of large regions, with boundary documents; and the links to pivots."""
    order = F.xxhash64("doc_id", F.lit(7))
    lot = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(PIVOTS))
    drawn = large.groupBy("region", lot.alias("lot")).agg(F.min(F.struct(order.alias("h"), F.col("doc_id").alias("pivot"))).alias("p")).select("region", "p.*")
    drawn = written(drawn, "drawn")
    earlier = drawn.toDF("region", "h_y", "y")
    two = written(drawn.withColumnRenamed("pivot", "x").join(earlier, "region").where("h_y < h").select("region", "x", "y"), "drawn")
    alike = F.col("inter") / (F.col("nx") + F.col("ny") - F.col("inter"))
    apart = written(_measured(two.select("x", "y").distinct(), sets, rule).select("x", "y", alike.alias("alike")), "apart")
    ways = apart.unionByName(apart.select(F.col("y").alias("x"), F.col("x").alias("y"), "alike"))
    # of near ones that stays which serves more regions, by powers of two, and then which is more like the others
    drawn_in = drawn.groupBy(F.col("pivot").alias("x")).agg(F.floor(F.log2(F.count("*"))).alias("many"))
    central = ways.groupBy("x").agg(F.avg("alike").alias("c")).join(drawn_in, "x")
    central = written(central.select("x", F.struct("many", "c").alias("c")), "central")
    near = apart.where(F.col("alike") > 1 - NET).join(central.withColumnRenamed("c", "cx"), "x").join(central.toDF("y", "cy"), "y")
    less = F.when(F.struct("cx", "x") < F.struct("cy", "y"), F.col("x")).otherwise(F.col("y"))
    out = two.join(near.select("x", "y", less.alias("pivot")), ["x", "y"]).select("region", "pivot").distinct()
    pivots = written(drawn.select("region", "pivot").join(out, ["region", "pivot"], "left_anti"), "pivots")
    met = written(large.select("region", F.col("doc_id").alias("x")).join(pivots.withColumnRenamed("pivot", "y"), "region").where("x <> y"), "to_pivots")
    found = written(_measured(met.select("x", "y").distinct(), sets, rule, pivots=True), "distances")
    d = 1 - F.col("inter") / (F.col("nx") + F.col("ny") - F.col("inter"))
    known = met.join(found.withColumn("d", d), ["x", "y"])
    home = known.groupBy("region", "x").agg(F.min("d").alias("home"))
    kept = known.join(home, ["region", "x"]).where(F.col("d") <= F.col("home") + 2 * rule.radius + 1e-9)
    cells = kept.select(F.col("y").alias("pivot"), F.col("x").alias("doc_id"), F.col("nx").alias("n"), F.col("ny").alias("pivot_n"), "inter").distinct()
    return cells, found.where("linked").select("x", "y")


def _cell_regions(cells: DataFrame, sets: DataFrame, rule: _Rule) -> DataFrame:
    """``region, doc_id, n, comp, size, at``: sets that share a prefix element of their differences from a cell's pivot.

    ``size`` is that of the difference, and ``at`` the element's place in it. Let k = (100 - percent) / (100 + percent) and
    D be the difference's size. Linked sets x and y have (D_x + D_y - k (n_x + n_y)) / 2 elements of their differences
    in common, at the least. If x is linked to the pivot, then y, of another component, is not, so D_y > k (n_y + n_pivot).
    If x is not, D_y is at least D_x - k (n_x + n_y), and n_y at most n_x * 100 / percent. Either way one element is shared.
    """
    a, b = 100 - rule.percent, 100 + rule.percent
    size = F.col("n") + F.col("pivot_n") - 2 * F.col("inter")
    linked = rule.differ_little(F.col("size"), F.col("n"), F.col("pivot_n"))
    biggest = F.least(F.floor(100 * F.col("n") / rule.percent), F.col("cell_n"))
    if_linked = F.ceil((b * F.col("size") + a * (F.col("pivot_n") - F.col("n"))) / (2 * b) - 1e-9)
    if_not = F.ceil((b * F.col("size") - a * (F.col("n") + biggest)) / b - 1e-9)
    least = F.greatest(F.lit(1), F.when(linked, if_linked).otherwise(if_not))
    top = cells.groupBy("pivot").agg(F.max("n").alias("cell_n"))
    sized = cells.withColumn("size", size).join(top, "pivot").withColumn("prefix", F.col("size") - least + 1)
    sized = sized.where("prefix > 0").select(F.col("pivot").alias("y"), F.col("doc_id").alias("x"), "comp", "size", "prefix")
    own = _beside(sized, sets, pivots=True)
    parts = F.concat(F.array_except("x_items", "y_items"), F.array_except("y_items", "x_items"))
    elements = written(own.select("y", F.col("x").alias("doc_id"), F.col("nx").alias("n"), "comp", "size", "prefix", F.explode(parts).alias("e")), "differences")
    # an element of one set alone meets nothing; such come first in the order, so it is enough to know how many they are
    often = elements.groupBy("y", "e").agg(F.count("*").alias("often")).where("often > 1")
    own = Window.partitionBy("y", "doc_id")
    ranked = elements.join(often, ["y", "e"]).withColumn("alone", F.col("size") - F.count("*").over(own))
    ranked = ranked.withColumn("at", F.col("alone") + F.row_number().over(own.orderBy("often", "e")) - 1).where("at < prefix")
    return written(ranked.select(F.xxhash64("y", "e").alias("region"), "doc_id", "n", "comp", "size", "at"), "cell_regions")


def jaccard_classes(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Classes of documents linked by shingle sets of Jaccard similarity ``percent``/100 or more.

    Takes any DataFrame with ``doc_id`` and ``text``; other columns are not read. Returns one row per row of ``docs``:
    ``doc_id, n_shingles, component_id``, the smallest doc_id reachable by links (itself included). Null, empty and
    blank texts have no shingles and are linked with nothing; texts of fewer than ``words`` words have one shingle.
    Equal texts are one class of any size. Rows that repeat an id and its text repeat its result; rows of one id with
    different texts are each placed by their own. An empty table gives no rows; rows with a null doc_id are left out.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must be from 80 to 100")
    with scope(docs.sparkSession):
        return _classes(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null"), words, _Rule(percent))


def _classes(docs: DataFrame, words: int, rule: _Rule) -> DataFrame:
    zones = written(shingle_sets(docs, words, zone=True), "zones")
    classes = written(zones.where("n > 0").groupBy("digest", "n").agg(F.min("doc_id").alias("rep")), "classes")
    copies = written(zones.select("doc_id", "n", "digest").join(classes, ["digest", "n"]).where("doc_id <> rep").select("doc_id"), "copies")
    reps = zones.where("n > 0").join(small(copies), "doc_id", "left_anti")
    entries = reps.select("doc_id", F.explode("items").alias("g"))
    few = [F.count("*").alias("count"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.bit_xor("doc_id").alias("all")]
    shared = written(entries.groupBy("g").agg(*few).where("count > 1"), "shared")
    common = written(shared.where(F.col("count") > COMMON).select("g"), "common")
    late = entries.join(small(common), "g", "left_semi").groupBy("doc_id").agg(F.count("*").alias("late"))
    info = written(reps.select("doc_id", "n").join(late, "doc_id", "left").fillna(0, ["late"]), "info")
    pairs = written(_zone_pairs(shared, info, rule), "pairs")
    regions, sets = _crowded_regions(entries, info, common, docs, words, rule)
    need = pairs.select(F.explode(F.array("x", "y")).alias("doc_id")).unionByName(regions.select("doc_id")).distinct()
    need = written(need.join(sets.select("doc_id"), "doc_id", "left_anti"), "members")
    sets = sets.unionByName(written(shingle_sets(docs.join(small(need), "doc_id", "left_semi"), words).select("doc_id", "n", "items"), "sets"))
    links = written(_measured(pairs, sets, rule).where("linked").select("x", "y"), "links")
    labels = _labels(links)
    members = _with_comp(regions, labels).withColumn("size", F.col("n"))
    # if this is the first shingle that both have, neither has more in common than what comes after it
    left = F.least(F.col("n") - F.col("at"), F.col("n_y") - F.col("at_y"))
    fits = rule.shared_enough(left, F.col("n"), F.col("n_y"))
    for turn in range(ROUNDS + 1):
        members = written(_open(members, "region"), "members")
        sizes = members.groupBy("region").agg(F.count("*").alias("k"))
        few = members if turn == ROUNDS else members.join(sizes.where(F.col("k") <= LEAF ** (turn + 1)).select("region"), "region")
        met = written(_measured(written(_met(few, fits), "met"), sets, rule).where("linked").select("x", "y"), "links")
        links = links.unionByName(met)
        large = None if turn == ROUNDS else written(members.join(sizes.where(F.col("k") > LEAF ** (turn + 1)).select("region"), "region").select("region", "doc_id"), "large")
        if large is None or large.isEmpty():
            break
        cells, found = _cells(large, sets, rule)
        links = links.unionByName(found)
        labels = _labels(links)
        cells = written(_open(_with_comp(cells, labels), "pivot"), "cells")
        members = _cell_regions(cells, sets, rule)
        window = rule.differ_little(F.abs(F.col("size") - F.col("size_y")), F.col("n"), F.col("n_y"))
        left = F.least(F.col("size") - F.col("at"), F.col("size_y") - F.col("at_y"))
        fits = window & rule.differ_little(F.col("size") + F.col("size_y") - 2 * left, F.col("n"), F.col("n_y"))
    labels = _labels(links)
    out = zones.select("doc_id", "n", "digest").join(classes, ["digest", "n"], "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("rep", "doc_id").alias("rep"))
    out = out.join(labels.toDF("rep", "component"), "rep", "left")
    return written(out.select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id")), "classes")
