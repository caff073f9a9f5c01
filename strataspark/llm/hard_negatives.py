"""Hard negatives by LEMP-style coordinate pruning: exact inner-product search in buckets of like length.

Rows become integers floor(SCALE * x). They are sorted by length, longest first, and cut into blocks of BLOCK rows
and, in a task, into buckets of BUCKET. A bucket keeps a sorted list of the normalised rows' values for each
coordinate. A search wants an anchor's best rows with a score of `low` or more (of equal scores, the smaller ids). In a bucket whose longest row is l
they need a cosine of t = low / (|anchor| l) or more: over 1, the bucket is left out. Else the angle to the anchor is
at most arccos t, so a coordinate that has cos a in the anchor has a value between cos(a + arccos t) and
cos(a - arccos t) in the row. The ranges of the anchor's FOCUS largest coordinates are looked up in their
lists; the rows in all of them are scored exactly in integers. `low` rises to the last wanted score as soon as there
are enough rows.

Searches meet blocks in cogroups of at most BLOCK rows and ANCHORS anchors. Each runs over the first block alone
at first, whose scores become `low` for the run over all; so later blocks return few rows.

First the positives are searched, then, between the limits that their scores set, the negatives.

Defined cases: rows with a null label, a null vector, or null or non-finite components take no part; vectors of
different lengths don't meet; components beyond CLAMP count as CLAMP, so that scores fit a long up to 2,048
components; rows that repeat a vec_id are rows of their own (an anchor of each, and positives of each other); a null
vec_id comes last among ties and is no anchor (the largest long stands for it); zero vectors score 0; a positive
below 0 has no negatives, one of 0 those of 0; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import read_table, stage

SCALE, EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 10
#: A negative's score is this share of its positive's at least and at most, in tenths.
LEAST, MOST = 3, 9
FOCUS = 4
BUCKET, BLOCK, ANCHORS = 2048, 16_384, 16_384
CLAMP = 1 << 24
_TOP = (1 << 63) - 1
_SLACK = 1e-9


class Bucket:
    """Rows of like length with a sorted list of each coordinate."""

    def __init__(self, x: np.ndarray, length: np.ndarray):
        self.x, self.longest, self.shortest = x, float(length.max()), float(length.min())
        unit = x / np.where(length, length, 1)[:, None]
        self.order = np.argsort(unit, axis=0, kind="stable").T.copy()
        self.lists = np.take_along_axis(unit, self.order.T, axis=0).T.copy()
        self.unit = unit

    def candidates(self, anchor: np.ndarray, size: float, focus: np.ndarray, low: int | None) -> np.ndarray | None:
        """Places of all rows whose score may be low or more; None: any. size: the anchor's length."""
        if low is None or (low <= 0 and not (size and self.shortest)):
            return None
        if not size * self.longest:
            return np.empty(0, np.int64)
        t = low / (size * (self.longest if low > 0 else self.shortest)) - _SLACK
        if t > 1:
            return np.empty(0, np.int64)
        if t <= -1:
            return None
        angle, own = np.arccos(t), np.arccos(np.clip(anchor[focus] / size, -1, 1))
        least = np.cos(np.minimum(np.pi, own + angle)) - _SLACK
        most = np.cos(np.maximum(0, own - angle)) + _SLACK
        ends = [(np.searchsorted(self.lists[f], a, "left"), np.searchsorted(self.lists[f], b, "right")) for f, a, b in zip(focus, least, most, strict=True)]
        first = min(range(len(focus)), key=lambda k: ends[k][1] - ends[k][0])
        found = self.order[focus[first], ends[first][0] : ends[first][1]]
        for k, f in enumerate(focus):
            if k != first:
                v = self.unit[found, f]
                found = found[(v >= least[k]) & (v <= most[k])]
        return found


class Best:
    """The best `want` rows of a slot so far: score, id, row."""

    def __init__(self, low: int | None, last: int | None, high: int, want: int):
        """Rows of a score of `low` count up to the id `last`: later ones come after `want` known rows."""
        self.low, self.last, self.high, self.want, self.rows = low, _TOP if last is None else last, high, want, np.empty((0, 3), np.int64)

    def add(self, score: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
        fit = score <= self.high
        if self.low is not None:
            fit &= (score > self.low) | ((score == self.low) & (ids <= self.last))
        if fit.any():
            both = np.concatenate([self.rows, np.stack([score[fit], ids[fit], rows[fit]], axis=1)])
            self.rows = both[np.lexsort((both[:, 2], both[:, 1], -both[:, 0]))[: self.want]]
            if len(self.rows) == self.want:
                self.low, self.last = int(self.rows[-1, 0]), int(self.rows[-1, 1])


_FOUND = "anchor long, slot int, score long, id long, row long"


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy().astype(np.int64)


def _searched(same: bool, want: int):
    """Best rows of a block for each slot of the anchors that meet it."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out: list[np.ndarray] = []
        slots = anchors.column("slots").to_pylist() if anchors.num_rows and rows.num_rows else []
        dims = pc.list_value_length(anchors.column("q")).to_numpy(), pc.list_value_length(rows.column("q")).to_numpy()
        for dim in np.intersect1d(*dims) if slots else ():
            own, mine = np.flatnonzero(dims[0] == dim), np.flatnonzero(dims[1] == dim)
            part = rows.take(pa.array(mine))
            x = part.column("q").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(-1, dim)
            length = np.sqrt(np.einsum("ij,ij->i", x, x).astype(np.float64))
            by = np.argsort(-length, kind="stable")
            x, length = x[by], length[by]
            ids, row, label = (_numbers(part.column(c))[by] for c in ("id", "row", "label"))
            buckets = [(slice(k, k + BUCKET), Bucket(x[k : k + BUCKET], length[k : k + BUCKET])) for k in range(0, len(x), BUCKET)]
            some = anchors.take(pa.array(own))
            q = some.column("q").combine_chunks().flatten().to_numpy().astype(np.int64).reshape(-1, dim)
            for a, a_row, a_label, want_of in zip(q, _numbers(some.column("row")), _numbers(some.column("label")), [slots[k] for k in own], strict=True):
                size = float(np.sqrt(float(a @ a)))
                focus = np.argsort(-np.abs(a), kind="stable")[:FOCUS]
                best = [Best(s["low"], s["last"], s["high"], want) for s in want_of]
                for where, bucket in buckets:
                    low = None if any(b.low is None for b in best) else min(b.low for b in best)
                    at = bucket.candidates(a, size, focus, low)
                    at = np.arange(len(bucket.x)) if at is None else at
                    at = at[((label[where][at] == a_label) == same) & (row[where][at] != a_row)]
                    if len(at):
                        score = bucket.x[at] @ a
                        for b in best:
                            b.add(score, ids[where][at], row[where][at])
                out += [np.column_stack([np.full(len(b.rows), a_row), np.full(len(b.rows), s["slot"]), b.rows]) for b, s in zip(best, want_of, strict=True)]
        found = np.concatenate(out) if out else np.empty((0, 5), np.int64)
        return pa.table([pa.array(found[:, 0]), pa.array(found[:, 1], pa.int32()), *(pa.array(found[:, k]) for k in (2, 3, 4))], names=["anchor", "slot", "score", "id", "row"])

    return run


def _meet(rows: DataFrame, anchors: DataFrame, same: bool, want: int, blocks: int, lots: int) -> DataFrame:
    """Best rows of each block for the anchors' slots. Each block meets each lot of anchors once."""
    left = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))).alias("lot"))
    right = anchors.select("*", F.pmod(F.xxhash64("row"), F.lit(lots)).cast("int").alias("lot"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    return left.groupBy("block", "lot").cogroup(right.groupBy("block", "lot")).applyInArrow(_searched(same, want), _FOUND)


def _first(found: DataFrame, want: int) -> DataFrame:
    """Ranks 1 to want of each anchor's slot."""
    w = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id", "row")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= want)


def _search(rows: DataFrame, anchors: DataFrame, same: bool, want: int, blocks: int, lots: int) -> DataFrame:
    """The best `want` rows between low and high for each slot of each anchor (row, label, q, slots)."""
    seed = _first(_meet(rows.where("block = 0"), anchors, same, want, 1, lots), want)
    reached = seed.where(F.col("rank") == want).select(F.col("anchor").alias("row"), "slot", F.struct(F.col("score").alias("low"), F.col("id").alias("last")).alias("k"))
    known = reached.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("slot", "k"))).alias("known"))
    best = lambda s: F.try_element_at("known", s["slot"])
    raised = F.transform("slots", lambda s: F.struct(s["slot"].alias("slot"), F.coalesce(best(s)["low"], s["low"]).alias("low"), best(s)["last"].alias("last"), s["high"].alias("high")))
    ready = stage(anchors.join(known, "row", "left").select("row", "label", "q", raised.alias("slots")), "anchors")
    return stage(_first(_meet(rows, ready, same, want, blocks, lots), want), "found")


def _tenths(c: Column) -> Column:
    """floor(c / 10) of a long, exactly."""
    return F.call_function("div", c - F.pmod(c, F.lit(10)), F.lit(10))


def _slot(slot: Column, low: Column, high: Column) -> Column:
    return F.struct(slot.cast("int").alias("slot"), low.cast("long").alias("low"), F.lit(None).cast("long").alias("last"), high.cast("long").alias("high"))


def mine(vectors: DataFrame, anchor: Column, label: Column | str = "label", scale: int = SCALE, positives: int = POSITIVES, negatives: int = NEGATIVES, block: int = BLOCK, anchors_each: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the vectors (vec_id, embedding and label) where `anchor` holds.

    Negatives score 3 to 9 tenths of their positive. Both conditions and labels are expressions over the vectors' columns.
    """
    spark = vectors.sparkSession
    e = F.col("embedding").cast("array<double>")
    fit = F.col("label").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    q = F.transform(e, lambda v: F.least(F.greatest(F.floor(v * F.lit(float(scale))), F.lit(-CLAMP)), F.lit(CLAMP)).cast("int"))
    usable = vectors.select(F.col("vec_id").cast("long"), "embedding", F.col(label) if isinstance(label, str) else label.alias("label"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    known = usable.where(F.coalesce(fit, F.lit(False))).select(F.coalesce("vec_id", F.lit(_TOP)).alias("id"), F.col("label").cast("long"), "is_anchor", q.alias("q"), F.monotonically_increasing_id().alias("row"))
    known = stage(known.withColumn("length", F.aggregate("q", F.lit(0).cast("long"), lambda s, v: s + v.cast("long") * v.cast("long"))), "vectors")
    totals = known.agg(F.count("*").alias("n"), F.count_if("is_anchor").alias("anchors")).first()
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not totals["anchors"]:
        return spark.createDataFrame([], out)
    blocks, lots = -(-totals["n"] // block), -(-totals["anchors"] // anchors_each)
    # longest first; the number of a row parts equal lengths
    spread = known.repartitionByRange(blocks, F.size("q"), F.desc("length"), "row")
    rows = stage(spread.select(F.spark_partition_id().alias("block"), "row", "id", "label", "q"), "blocks")
    blocks = rows.agg(F.max("block")).first()[0] + 1

    chosen = known.where("is_anchor").select("row", "label", "q")
    open_ = chosen.withColumn("slots", F.array(_slot(F.lit(1), F.lit(None), F.lit(_TOP))))
    near = _search(rows, open_, True, positives, blocks, lots).select("anchor", F.col("rank").alias("slot"), F.col("id").alias("positive"), F.col("score").alias("p"))
    # 30 p <= 100 n <= 90 p
    low, high = -_tenths(-F.col("p") * LEAST), _tenths(F.col("p") * MOST)
    wanted = near.where(low <= high).groupBy(F.col("anchor").alias("row")).agg(F.collect_list(_slot(F.col("slot"), low, high)).alias("slots"))
    hard = _search(rows, chosen.join(wanted, "row"), False, negatives, blocks, lots)
    null = lambda c: F.when(F.col(c) != _TOP, F.col(c))
    pairs = hard.join(near, ["anchor", "slot"]).join(known.where("is_anchor").select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return pairs.select("anchor_id", null("positive").alias("positive_id"), "rank", null("id").alias("negative_id"), F.col("p").alias("positive_score"), F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors, F.col("vec_id") % EVERY == 0, changed)


ORACLE = f"""with numbered as (select row_number() over () as rid, vec_id, label, [v::double for v in embedding] as e from embeddings),
r as (select rid, vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label,
    [greatest(least(floor({SCALE} * v), {CLAMP}), -{CLAMP})::bigint for v in e] as q from numbered
  where label is not null and len(e) > 0 and len([v for v in e if v is null or isnan(v) or isinf(v)]) = 0),
s as (select a.rid as anchor, a.vec_id as anchor_id, b.rid, b.vec_id, a.label = b.label as same, list_sum([p[1] * p[2] for p in list_zip(a.q, b.q)])::bigint as score
  from r as a join r as b on a.rid <> b.rid and len(a.q) = len(b.q) where a.vec_id % {EVERY} = 0),
p as (select * from (select *, row_number() over (partition by anchor order by score desc, vec_id nulls last, rid) as k from s where same) where k <= {POSITIVES}),
n as (select p.anchor, p.anchor_id, p.k, p.vec_id as positive_id, p.score as positive_score, s.vec_id as negative_id, s.score as negative_score,
    row_number() over (partition by p.anchor, p.k order by s.score desc, s.vec_id nulls last, s.rid) as rank
  from p join s on p.anchor = s.anchor and not s.same and {LEAST * 10} * p.score <= 100 * s.score and 100 * s.score <= {MOST * 10} * p.score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= {NEGATIVES}"""
