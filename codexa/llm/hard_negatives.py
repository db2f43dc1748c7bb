"""Hard-negative mining over k-means inverted lists (operator 11).

Method. Rows with the same label and vector form one node, of which the first ids are kept: no more of them can stand in a result. Centroids are fitted by Lloyd's rounds on a
sample of SAMPLE nodes (those of the least id hashes); every node then stands in the list of its nearest centroid c, and each list stores its radius r, the largest distance
to c. By Cauchy-Schwarz no member of a list scores more than q.c + |q| r with a query q, nor less than q.c - |q| r. A query visits the lists in falling order of the
upper bound, skips those whose bounds lie outside its score window, and stops when the bound falls strictly below the k-th score found so far. Visits go in rounds (FIRST lists,
then GROW times as many): in a round, queries and rows of a list meet in tiles of PORTION queries and PART rows, and the best k of all tiles are merged. Nothing is approximate.

First come the positives (same label, no window; the radius of a list's members of that label is used), then the negatives, with one window for each different positive score of a query.

Scores are exact integers: double products where all partial sums stay below 2**53, Python integers otherwise; values beyond long are held at its ends.

Defined cases. Rows with a null id, label or vector or a component that is null or not finite take no part. Of rows that share an id, the one of the least (label, vector) counts;
equal rows count once. Vectors of different lengths are filled up with zeros. Ties go to the smaller id. An anchor without positives or without rows in the window gives no row;
an empty table gives none. Further columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop, stage, table

#: Nodes that centroids are fitted on; rows a list should have; most lists; rounds of the fit.
SAMPLE, LIST_ROWS, MOST_LISTS, FIT_ROUNDS = 20_000, 1024, 1024, 8
#: Queries and rows of a tile, queries handled at once in it; lists of the first round and growth; most (label, list) radii that are broadcast.
PORTION, PART, AT_ONCE, FIRST, GROW, MOST_RADII = 1024, 1024, 256, 4, 8, 200_000
LOW, HIGH = -(2**63), 2**63 - 1


def whole_components(vector: Column, factor: int = 256) -> Column:
    """floor(factor * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("long"))


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return vector.isNotNull() & fine


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as int64, filled up with zeros."""
    column = pa.concat_arrays([column]) if not isinstance(column, pa.ChunkedArray) else column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """AT_ONCE rows at most: what is computed for a row is as long as there are lists."""
    for batch in batches:
        for a in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(a, AT_ONCE)


def fit(sample: np.ndarray, lists: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Centroids by Lloyd's rounds; starts are spread evenly over the sample, lists that lose all members keep their place."""
    x = sample.astype(np.float64)
    c = x[np.linspace(0, len(x) - 1, lists).astype(int)]
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with the rows of b."""
    most = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * max(a.shape[1], 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, LOW, HIGH).astype(np.int64)


class Index:
    """Inverted lists over nodes(node, label, q, ids): `rows` (node, label, q, ids, list, part), centroids, radii of lists and of the labels in them."""

    def __init__(self, nodes: DataFrame):
        spark = nodes.sparkSession
        total, self.width = nodes.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(0))).first()
        sample = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("q").toArrow().column("q")
        lists = min(MOST_LISTS, max(1, round(total / LIST_ROWS)))
        self.centroids = fit(_matrix(sample, self.width), lists) if total else np.zeros((1, self.width))
        held, width = spark.sparkContext.broadcast(self.centroids), self.width

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = held.value
            for batch in _slices(batches):
                x = _matrix(batch.column(2), width).astype(np.float64)
                near = np.argmin((c * c).sum(1)[None, :] - 2 * x @ c.T, axis=1)
                gap = np.sqrt(((x - c[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(gap)], [*batch.schema.names, "list", "gap"])

        placed = stage(nodes.select("node", "label", "q", "ids").mapInArrow(place, f"node long, label {_kind(nodes, 'label')}, q array<long>, ids array<long>, list int, gap double"), "lists")
        sizes = placed.groupBy("list").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect()  # a row a list
        self.radius = np.full(len(self.centroids), -1.0)  # below 0: no member
        for r in sizes:
            self.radius[r.list] = r.radius
        self.parts = spark.createDataFrame([(r.list, -(-r.n // PART)) for r in sizes], "list int, parts int")
        self.rows = placed.join(F.broadcast(self.parts), "list").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).drop("parts")
        of_label = placed.groupBy("label", "list").agg(F.max("gap").alias("radius"))
        found = of_label.limit(MOST_RADII + 1).collect()
        self.by_label: dict | None = None
        if len(found) <= MOST_RADII:
            self.by_label = {}
            for label, at, radius in found:
                self.by_label.setdefault(label, []).append((at, radius))
        self.placed = placed


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def search(index: Index, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """queries(node, label, q, windows array<struct<lo, hi>>) -> node, w, score, id, ids: for each window the best k nodes of the same label (or of others), best first by score, then id; staged."""
    spark = queries.sparkSession
    kind, width = _kind(queries, "label"), index.width
    told = spark.sparkContext.broadcast((index.centroids, index.radius, index.by_label if same else None))  # MOST_LISTS centroids and MOST_RADII radii at most
    # neighbouring queries share a portion: by home list, then at random
    home = queries.join(index.placed.select("node", "list"), "node")
    homes = sorted(tuple(r) for r in home.groupBy("list").count().collect())
    offsets, before = [], 0
    for at, n in homes:
        offsets.append((at, before, n))
        before += n
    offsets = F.broadcast(spark.createDataFrame(offsets, "list int, before long, n long"))
    portion = ((F.col("before") + F.pmod(F.xxhash64("node"), "n")) / PORTION).cast("int")
    asked = stage(home.join(offsets, "list").select("node", "label", "q", "windows", portion.alias("portion")), "queries")

    def plan(start: int, stop: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, radius, by_label = told.value
            for batch in _slices(batches):
                q = _matrix(batch.column(2), width).astype(np.float64)
                labels = batch.column(1).to_pylist()
                r = np.tile(radius, (len(q), 1))
                if by_label is not None:
                    r[:] = -1
                    for i, label in enumerate(labels):
                        for at, own in by_label.get(label, ()):
                            r[i, at] = own
                size, mid = np.sqrt((q * q).sum(1))[:, None], q @ c.T
                slack = 1 + 1e-9 * size * (np.sqrt((c * c).sum(1))[None, :] + np.abs(r))
                most, least = mid + size * r + slack, mid - size * r - slack
                wanted, visits = np.zeros(r.shape, bool), []
                useful = np.zeros(r.shape, bool)
                for i, (windows, kth) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                    reached = dict(kth or ())
                    for w, window in enumerate(windows):
                        meets = (r[i] >= 0) & (most[i] >= window["lo"]) & (least[i] <= window["hi"])
                        useful[i] |= meets
                        wanted[i] |= meets & (most[i] >= reached.get(w, LOW))
                order = np.argsort(np.where(useful, -most, np.inf), axis=1, kind="stable")
                more = []
                for i in range(len(q)):
                    ranked = order[i][: int(useful[i].sum())]
                    visits.append([int(x) for x in ranked[start:stop] if wanted[i, x]])
                    more.append(bool(wanted[i, ranked[stop:]].any()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(visits, pa.list_(pa.int32())), pa.array(more)], ["node", "visits", "more"])

        return run

    def tile(rows: pa.Table, ask: pa.Table) -> pa.Table:
        ids = rows.column("node").to_numpy()
        order = np.argsort(ids)
        ids, x = ids[order], _matrix(rows.column("q"), width)[order]
        named = np.array(rows.column("label").to_pylist(), object)[order]
        q, own = _matrix(ask.column("q"), width), np.array(ask.column("label").to_pylist(), object)
        windows, kths = ask.column("windows").to_pylist(), [dict(x or ()) for x in ask.column("kth").to_pylist()]
        who, which, score, at = [], [], [], []
        for a in range(0, len(q), AT_ONCE):
            b = min(a + AT_ONCE, len(q))
            s = products(q[a:b], x)
            fits = (own[a:b, None] == named[None, :]) == same
            for w in range(max(map(len, windows[a:b]))):
                lo = np.array([max(v[w]["lo"], t.get(w, LOW)) if w < len(v) else HIGH for v, t in zip(windows[a:b], kths[a:b], strict=True)], np.int64)
                hi = np.array([v[w]["hi"] if w < len(v) else LOW for v in windows[a:b]], np.int64)
                i, j = np.nonzero(fits & (s >= lo[:, None]) & (s <= hi[:, None]))
                v = s[i, j]
                best = np.lexsort((j, -v.astype(np.float64) if np.abs(v.astype(np.float64)).max(initial=0) >= 2**53 else -v, i))
                i, j, v = i[best], j[best], v[best]
                first = np.concatenate([[0], np.flatnonzero(i[1:] != i[:-1]) + 1]) if len(i) else np.zeros(0, int)
                place = np.arange(len(i)) - np.repeat(first, np.diff(first, append=len(i)))
                keep = place < k
                who.append(i[keep] + a)
                which.append(np.full(int(keep.sum()), w, np.int32))
                score.append(v[keep])
                at.append(j[keep])
        who, at = (np.concatenate(y).astype(np.int64) if y else np.zeros(0, np.int64) for y in (who, at))
        return pa.table({
            "node": ask.column("node").combine_chunks().take(pa.array(who)), "w": pa.array(np.concatenate(which) if which else np.zeros(0, np.int32)),
            "score": pa.array(np.concatenate(score) if score else np.zeros(0, np.int64)), "id": pa.array(ids[at]), "ids": rows.column("ids").combine_chunks().take(pa.array(order[at])),
        })

    ranked = Window.partitionBy("node", "w").orderBy(F.desc("score"), "id")
    best, start, stop = None, 0, FIRST
    open_ = asked
    while True:
        if best is None:
            now = open_.withColumn("kth", F.lit(None).cast("map<int,bigint>"))
        else:
            full = best.groupBy("node", "w").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") == k)
            now = open_.join(full.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("kth")), "node", "left")
        planned = now.select("node", "label", "q", "windows", "kth").mapInArrow(plan(start, stop), "node long, visits array<int>, more boolean")
        planned = stage(now.join(planned, "node"), "visits")
        visits = planned.withColumn("list", F.explode("visits"))
        tiles = visits.select("list", "portion").distinct()
        rows = index.rows.join(tiles, "list").select("list", "part", "portion", "node", "label", "q", "ids")
        asks = visits.join(F.broadcast(index.parts), "list").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        asks = asks.select("list", "part", "portion", "node", "label", "q", "windows", "kth")
        asks = asks.toDF(*asks.columns)  # columns of its own, apart from those that rows got from tiles
        keys = ["list", "part", "portion"]
        found = rows.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInArrow(tile, "node long, w int, score long, id long, ids array<long>")
        both = found if best is None else best.unionByName(found)
        both = stage(both.withColumn("n", F.row_number().over(ranked)).where(F.col("n") <= k).drop("n"), "best")
        if best is not None:
            drop(best)
        best, left = both, planned.where("more")
        start, stop = stop, stop * GROW
        if stop > len(index.centroids) * GROW or left.isEmpty():
            return best
        open_ = stage(left.select("node", "label", "q", "windows", "portion"), "queries")


def _expanded(rows: DataFrame, by: list[str], k: int, name: str) -> DataFrame:
    """The best k (score, id) of the members of the nodes in rows, by falling score, then id: `k` nodes of `k` ids at most for each group."""
    each = F.flatten(F.collect_list(F.transform("ids", lambda x: F.struct((-F.col("score").cast("decimal(38,0)")).alias("down"), x.alias("id"), F.col("score").alias("score")))))
    return rows.groupBy(*by).agg(F.transform(F.slice(F.array_sort(each), 1, k), lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"))).alias(name))


def hard_negatives(rows: DataFrame, anchor: Column, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """rows(vec_id, label, q array<long>) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each row that `anchor` holds for and each of its first positives: the first negatives with low * positive_score <= 100 * negative_score <= high * positive_score.
    """
    kept = max(n_positives + 1, n_negatives)
    one = rows.where("vec_id is not null and label is not null and q is not null").groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("r"))
    one = stage(one.select(F.col("vec_id").cast("long").alias("vec_id"), "r.label", "r.q"), "vectors")
    first = one.withColumn("n", F.row_number().over(Window.partitionBy("label", "q").orderBy("vec_id"))).where(F.col("n") <= kept)
    nodes = first.groupBy("label", "q").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    nodes = stage(nodes.select(F.col("ids")[0].alias("node"), "label", "q", "ids"), "nodes")
    anchors = stage(one.where(anchor).join(nodes.select("node", "label", "q"), ["label", "q"]).select("vec_id", "node"), "anchors")
    index = Index(nodes)
    asked = nodes.join(anchors.select("node").distinct(), "node").select("node", "label", "q")
    any_score = F.array(F.struct(F.lit(LOW).cast("long").alias("lo"), F.lit(HIGH).alias("hi")))
    positives = _expanded(search(index, asked.withColumn("windows", any_score), n_positives + 1, True), ["node"], n_positives + 1, "positives")
    positives = stage(positives, "positives")
    exact = lambda p, s: F.lit(p).cast("decimal(18,0)") * s.cast("decimal(19,0)")
    window = lambda s: F.struct(F.ceil(exact(low, s) / 100).cast("long").alias("lo"), F.floor(exact(high, s) / 100).cast("long").alias("hi"), s.alias("s"))
    windows = F.filter(F.transform(F.array_distinct(F.transform("positives", lambda p: p["score"])), window), lambda x: x["lo"] <= x["hi"])
    asked = stage(asked.join(positives, "node").select("node", "label", "q", windows.alias("windows")).where(F.size("windows") > 0), "windows")
    found = search(index, asked.withColumn("windows", F.transform("windows", lambda x: F.struct(x["lo"].alias("lo"), x["hi"].alias("hi")))), n_negatives, False)
    named = found.join(asked.select("node", F.posexplode("windows").alias("w", "window")), ["node", "w"]).withColumn("s", F.col("window.s"))
    negatives = _expanded(named, ["node", "s"], n_negatives, "negatives")
    out = anchors.join(positives, "node")
    others = F.slice(F.filter("positives", lambda p: p["id"] != F.col("vec_id")), 1, n_positives)
    out = out.select("node", F.col("vec_id").alias("anchor_id"), F.explode(others).alias("p")).withColumn("s", F.col("p.score")).join(negatives, ["node", "s"])
    out = out.select("anchor_id", F.col("p.id").alias("positive_id"), F.posexplode("negatives").alias("place", "x"), F.col("p.score").alias("positive_score"))
    return out.select("anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.select("vec_id", label.alias("label"), whole_components(F.col("embedding")).alias("q")), F.col("vec_id") % 50 == 0)


ORACLE_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
           from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, list_inner_product(a.q, b.q)::bigint as s from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (select a, b, s from s where same qualify row_number() over (partition by a order by s desc, b) <= 5),
n as (select p.a, p.b as p, p.s as ps, s.b as n, s.s as ns, row_number() over (partition by p.a, p.b order by s.s desc, s.b) as r
      from p join s on s.a = p.a and not s.same and 50 * p.s <= 100 * s.s and 100 * s.s <= 95 * p.s)
select a as anchor_id, p as positive_id, r::int as rank, n as negative_id, ps as positive_score, ns as negative_score from n where r <= 3
"""
