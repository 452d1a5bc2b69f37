"""Hard filters: an algebra of clauses that compiles to semi and anti joins and one pass of flags."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Range clauses: name -> (column, whether the bound is the least value).
RANGES = {"runtime_min": ("runtime", True), "runtime_max": ("runtime", False), "popularity_min": ("popularity", True), "popularity_max": ("popularity", False)}
#: Clauses on columns of the item itself, and on bridges (item, value).
COLUMNS = {"genres": "genre", "collections": "collection"}
BRIDGES = {"keywords": "keyword", "countries": "country", "people": "person"}


@dataclass(frozen=True)
class HardFilters:
    """Bounds, and values that must or must not occur. An include set that is empty, but not None, can't be met."""

    runtime_min: float | None = None
    runtime_max: float | None = None
    popularity_min: float | None = None
    popularity_max: float | None = None
    include: dict[str, frozenset] = field(default_factory=dict)
    exclude: dict[str, frozenset] = field(default_factory=dict)
    exclude_ids: frozenset = frozenset()
    exclude_watched: bool = True

    def merge(self, other: HardFilters) -> HardFilters:
        """Both at once: bounds tighten, excludes unite, includes intersect. Never looser than either."""
        def tighter(name: str) -> float | None:
            both = [v for v in (getattr(self, name), getattr(other, name)) if v is not None]
            return (max(both) if RANGES[name][1] else min(both)) if both else None

        kinds = self.include.keys() | other.include.keys()
        include = {k: self.include[k] & other.include[k] if k in self.include and k in other.include else self.include.get(k, other.include.get(k)) for k in kinds}
        exclude = {k: self.exclude.get(k, frozenset()) | other.exclude.get(k, frozenset()) for k in self.exclude.keys() | other.exclude.keys()}
        return replace(self, **{n: tighter(n) for n in RANGES}, include=include, exclude=exclude, exclude_ids=self.exclude_ids | other.exclude_ids, exclude_watched=self.exclude_watched or other.exclude_watched)

    @property
    def impossible(self) -> bool:
        return any(not v for v in self.include.values())

    def names(self) -> list[str]:
        """The active clauses in order."""
        out = [n for n in RANGES if getattr(self, n) is not None]
        out += [f"include_{k}" for k in sorted(self.include)] + [f"exclude_{k}" for k in sorted(self.exclude) if self.exclude[k]]
        return out + ["exclude_ids"] * bool(self.exclude_ids) + ["exclude_watched"] * self.exclude_watched


def values(spark, column: str, wanted: frozenset) -> DataFrame:
    return spark.createDataFrame([(v,) for v in sorted(wanted)], f"{column} {'string' if all(isinstance(v, str) for v in wanted) else 'long'}")


def flagged(items: DataFrame, filters: HardFilters, bridges: dict[str, DataFrame], watched: DataFrame | None = None) -> DataFrame:
    """The items with a boolean column for each active clause: whether the item passes it alone.

    A bound drops items whose value is null; an excluded value does not. Bridges are reduced to the clause's
    values before they are joined, and each gives one row for an item at most.
    """
    spark, out = items.sparkSession, items
    for name, (column, least) in RANGES.items():
        bound = getattr(filters, name)
        if bound is not None:
            out = out.withColumn(name, F.coalesce(F.col(column) >= bound if least else F.col(column) <= bound, F.lit(False)))
    for side, sets in (("include", filters.include), ("exclude", filters.exclude)):
        for kind in sorted(sets):
            wanted, name = sets[kind], f"{side}_{kind}"
            if side == "exclude" and not wanted:
                continue
            if kind in COLUMNS:
                hit = F.coalesce(F.col(COLUMNS[kind]).isin(*wanted), F.lit(False)) if wanted else F.lit(False)
            elif not wanted:
                hit = F.lit(False)
            else:
                column = BRIDGES[kind]
                some = bridges[kind].join(F.broadcast(values(spark, column, wanted)), column, "left_semi").select("item").distinct().withColumn(f"_{name}", F.lit(True))
                out = out.join(some, "item", "left")
                hit = F.coalesce(F.col(f"_{name}"), F.lit(False))
            out = out.withColumn(name, hit if side == "include" else ~hit)
    if filters.exclude_ids:
        out = out.withColumn("exclude_ids", ~F.col("item").isin(*filters.exclude_ids))
    if filters.exclude_watched:
        seen = watched.select("item").distinct().withColumn("_watched", F.lit(True))
        out = out.join(seen, "item", "left").withColumn("exclude_watched", F.col("_watched").isNull())
    return out.select(*items.columns, *filters.names())


def every(names: list[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & F.col(n)
    return out


def allowed(items: DataFrame, filters: HardFilters, bridges: dict[str, DataFrame], watched: DataFrame | None = None) -> DataFrame:
    """The items that pass every clause."""
    return flagged(items, filters, bridges, watched).where(every(filters.names())).select(*items.columns)


def attribution(items: DataFrame, filters: HardFilters, bridges: dict[str, DataFrame], watched: DataFrame | None = None) -> DataFrame:
    """(clause, removed): what each clause alone removes of all items, and `all` for the items that no clause leaves; one pass."""
    names = filters.names()
    flags = flagged(items, filters, bridges, watched)
    sums = flags.agg(*(F.count_if(~F.col(n)).alias(n) for n in names), F.count_if(~every(names)).alias("all"))
    return sums.unpivot([], [*names, "all"], "clause", "removed")


def most_restrictive(removed: DataFrame) -> DataFrame:
    """The clause that removes most; ties go to the first name."""
    return removed.where("clause <> 'all'").orderBy(F.desc("removed"), "clause").limit(1)


def vote_floor(year: Column, country: Column, home: tuple[str, ...] = ("US", "GB")) -> Column:
    """Votes that an item needs: 25, for older ones 10 or 5, elsewhere half of it, 3 at least."""
    floor = F.when(year < 1980, 5).when(year < 2000, 10).otherwise(25)
    return F.when(F.coalesce(country.isin(*home), F.lit(False)), floor).otherwise(F.greatest(F.lit(3), F.floor(floor / 2))).cast("int")


def verdict(rules: list[tuple[Column, str]]) -> Column:
    """The reason of the first rule that is met, or null."""
    out = F.lit(None).cast("string")
    for met, reason in reversed(rules):
        out = F.when(met, F.lit(reason)).otherwise(out)
    return out


def bucket(value: Column, edges: tuple[int, ...]) -> Column:
    """The number of edges that a value reaches; -1 for null."""
    out = F.lit(len(edges))
    for k, e in reversed(list(enumerate(edges))):
        out = F.when(value < e, F.lit(k)).otherwise(out)
    return F.when(value.isNull(), F.lit(-1)).otherwise(out)


assert {f.name for f in fields(HardFilters)} >= set(RANGES)


def failing(names: list[str]) -> Column:
    """The clauses that a flagged row fails, a bit each."""
    out = F.lit(0)
    for i, n in enumerate(names):
        out = out + F.when(~F.col(n), F.lit(1 << i)).otherwise(0)
    return out


def without_each(scored: DataFrame, names: list[str], k: int = 10) -> DataFrame:
    """(clause, item, rank, gained): the k best items if each clause alone weren't there, from one pass over flagged rows (item, score and a column for each clause).

    What a list without a clause can hold fails nothing, or just that clause: the k best rows of each such mask are enough, and
    they are cut before the shuffle. `gained` items are those that the clause keeps out.
    """
    masked = scored.select("item", "score", failing(names).alias("_mask")).where(F.col("_mask").isin([0, *(1 << i for i in range(len(names)))]))
    best = masked.withColumn("_r", F.row_number().over(Window.partitionBy("_mask").orderBy(F.desc("score"), "item"))).where(F.col("_r") <= k).drop("_r")
    clauses = F.when(F.col("_mask") == 0, F.array(*map(F.lit, names)))
    for i, n in enumerate(names):
        clauses = clauses.when(F.col("_mask") == 1 << i, F.array(F.lit(n)))
    each = best.withColumn("clause", F.explode(clauses))
    place = F.row_number().over(Window.partitionBy("clause").orderBy(F.desc("score"), "item"))
    return each.withColumn("rank", place).where(F.col("rank") <= k).select("clause", "item", "rank", (F.col("_mask") > 0).alias("gained"))


def head_costs(scored: DataFrame, names: list[str], kept: DataFrame, k: int = 10) -> DataFrame:
    """(clause, n): of the k best rows whatever their flags, how many that aren't kept each clause removes; clauses that cost nothing are left out."""
    head = scored.orderBy(F.desc("score"), "item").limit(k).join(kept.select("item"), "item", "left_anti")
    counts = head.agg(*(F.count_if(~F.col(n)).alias(n) for n in names))
    return counts.unpivot([], names, "clause", "n").where("n > 0")
