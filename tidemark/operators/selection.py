"""Exact order statistics and slices of groups of any size.

A group with over 1 / ``parts`` of all rows and over HOT_ROWS of them is hot; fewer than ``parts`` are. All other groups are ranked by
a window, as one task sorts what they have. In a hot
group the wanted ranks are found by selection: rows are counted in BINS bins between the group's extremes (map-side combined, so a
task sends at most a row per bin), a running sum over the bins finds the bin of each rank, and only that bin's rows are counted
again, in narrower bins. After PASSES passes what is left is counted by value. So a hot group is read a few times by all tasks,
and neither sorted nor gathered by one.

Order columns are numbers, dates or timestamps; several make one order, the later ones deciding ties. Rows with a null in one of
them are left out. Null keys are a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

BINS = 1024
HOT_ROWS = 1_000_000
PASSES = 3


def number(column: str) -> Column:
    """A column as a double; never falling where the column rises."""
    return F.unix_micros(F.col(column).cast("timestamp")).cast("double")


def _keys_equal(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


class Groups:
    """Rows parted into those of hot and of all other groups."""

    def __init__(self, rows: DataFrame, keys: list[str], order: list[str], parts: int):
        self.keys, self.order, self.hot_keys = keys, order, [f"__k{i}" for i in range(len(keys))]
        known = rows
        for c in order:
            known = known.where(F.col(c).isNotNull())
        self.sizes = known.groupBy(*keys).agg(F.count("*").alias("__n"))
        total = F.broadcast(self.sizes.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("__total")))  # one row
        hot = self.sizes.crossJoin(total).where((F.col("__n") * parts > F.col("__total")) & (F.col("__n") > HOT_ROWS))
        self.hot = F.broadcast(hot.select(*[F.col(k).alias(h) for k, h in zip(keys, self.hot_keys)], "__n"))  # under ``parts`` rows
        on = _keys_equal(keys, self.hot_keys)
        self.hot_rows = known.join(self.hot, on)
        self.cold_rows = known.join(self.hot, on, "left_anti")

    def numbered(self) -> DataFrame:
        """Cold rows with their rank ``__i`` from 0 and their group's size ``__n``."""
        w = Window.partitionBy(*self.keys)
        return self.cold_rows.select("*", (F.row_number().over(w.orderBy(*self.order)) - 1).cast("long").alias("__i"), F.count("*").over(w).alias("__n"))


def _numeric(rows: DataFrame, column: str) -> Column:
    return number(column) if dict(rows.dtypes)[column] in ("date", "timestamp", "timestamp_ntz") else F.col(column).cast("double")


def _select(rows: DataFrame, targets: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """targets: keys, ``__name`` and ``__rank`` (a rank from 0 within the group's rows). Adds the order columns' values at the ranks.
    Both the groups and the ranks are few: targets are broadcast."""
    ids = [f"__t{i}" for i in range(len(keys))]
    found = targets.select(*[F.col(k).alias(i) for k, i in zip(keys, ids)], "__name", "__rank")
    done: list[str] = []
    for column in order:
        x = _numeric(rows, column)
        span = None
        for step in range(PASSES + 1):
            # rows of the group that share the values found so far and lie in the interval that the last pass left
            on = _keys_equal(keys, ids)
            for d in done:
                on = on & (F.col(d) == F.col(f"__v_{d}"))
            if span is not None:
                on = on & F.col(column).between(F.col("__lo"), F.col("__hi"))
            held = [*ids, "__name", "__rank", *[f"__v_{d}" for d in done]]
            inside = rows.join(F.broadcast(found), on).select(*held, *(["__lo", "__hi"] if span is not None else []), F.col(column).alias("__x"), x.alias("__d"))
            if span is None:
                bounds = inside.groupBy(*held).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
                found, span = bounds, True
                continue
            if step < PASSES:
                lo, hi = (number(c) if dict(bounds.dtypes)["__lo"] in ("date", "timestamp", "timestamp_ntz") else F.col(c).cast("double") for c in ("__lo", "__hi"))
                bin_ = F.coalesce(F.least(F.floor(F.try_divide(F.col("__d") - lo, hi - lo) * BINS), F.lit(BINS - 1)), F.lit(0))
            else:
                bin_ = F.col("__x")
            hist = inside.groupBy(*held, bin_.alias("__bin")).agg(F.count("*").alias("__c"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
            upto = F.sum("__c").over(Window.partitionBy(*ids, "__name").orderBy("__bin"))  # at most BINS rows, at last a row per value left
            hist = hist.withColumn("__before", upto - F.col("__c")).where((F.col("__before") <= F.col("__rank")) & (F.col("__rank") < F.col("__before") + F.col("__c")))
            found = hist.withColumn("__rank", F.col("__rank") - F.col("__before")).select(*held, "__lo", "__hi")
        found = found.select(*[c for c in found.columns if c not in ("__lo", "__hi")], F.col("__lo").alias(f"__v_{column}"))
        done.append(column)
    return found.select(*[F.col(i).alias(k) for k, i in zip(keys, ids)], "__name", *[F.col(f"__v_{d}").alias(d) for d in done])


def select_ranks(rows: DataFrame, keys: list[str], order: list[str], ranks: dict[str, Callable[[Column], Column]], parts: int = 1000) -> DataFrame:
    """Per group, its size ``n`` and for each name in ``ranks`` (a rank from 0 as a function of ``n``) the order columns' values
    there, as a struct; null where the group has no such rank."""
    g = Groups(rows, keys, order, parts)
    asked = F.explode(F.array(*[F.struct(F.lit(name).alias("__name"), rank(F.col("__n")).cast("long").alias("__rank")) for name, rank in ranks.items()]))
    at_rank = lambda df: df.select("*", asked.alias("__a")).select(*df.columns, "__a.*")
    value = F.struct(*order).alias("__value")
    cold = at_rank(g.numbered()).where("__i = __rank").select(*keys, "__name", value)
    targets = at_rank(g.hot.select(*[F.col(h).alias(k) for h, k in zip(g.hot_keys, keys)], "__n")).where("__rank >= 0 and __rank < __n")
    hot = _select(g.hot_rows.select(*keys, *order), targets, keys, order).select(*keys, "__name", value)
    wide = cold.unionByName(hot).groupBy(*keys).pivot("__name", list(ranks)).agg(F.first("__value"))
    sizes = g.sizes.select(*[F.col(k).alias(h) for k, h in zip(keys, g.hot_keys)], F.col("__n").alias("n"))
    return sizes.hint("merge").join(wide.hint("merge"), _keys_equal(g.hot_keys, keys), "left").select(*[F.col(h).alias(k) for h, k in zip(g.hot_keys, keys)], "n", *[F.col(f"`{name}`") for name in ranks])


def slices(rows: DataFrame, keys: list[str], order: list[str], cuts: list[Callable[[Column], Column]], name: str, parts: int = 1000) -> DataFrame:
    """``rows`` with ``name``: how many of ``cuts`` (ranks from 0 as functions of the group's size, ascending) a row's rank
    has reached. In hot groups a row is compared with the rows at the cuts, which are broadcast; rows that are equal in all order
    columns reach a cut together."""
    g = Groups(rows, keys, order, parts)
    reached = sum((F.when(F.col("__i") >= c(F.col("__n")), 1).otherwise(0) for c in cuts), F.lit(0))
    cold = g.numbered().withColumn(name, reached).select(*rows.columns, name)
    asked = F.explode(F.array(*[F.struct(F.lit(str(k)).alias("__name"), F.ceil(c(F.col("__n"))).cast("long").alias("__rank")) for k, c in enumerate(cuts)]))
    targets = g.hot.select(*[F.col(h).alias(k) for h, k in zip(g.hot_keys, keys)], "__n").select(*keys, "__n", asked.alias("__a")).select(*keys, "__n", "__a.*")
    edges = _select(g.hot_rows.select(*keys, *order), targets.where("__rank >= 0 and __rank < __n"), keys, order)
    edges = edges.groupBy(*[F.col(k).alias(h) for k, h in zip(keys, g.hot_keys)]).agg(F.collect_list(F.struct(*order)).alias("__edges"))  # a struct per cut
    row = F.struct(*order)
    hot = g.hot_rows.drop("__n", *g.hot_keys).join(F.broadcast(edges), _keys_equal(keys, g.hot_keys), "left")
    hot = hot.withColumn(name, F.coalesce(F.size(F.filter("__edges", lambda e: e <= row)), F.lit(0))).select(*rows.columns, name)
    return cold.unionByName(hot)
