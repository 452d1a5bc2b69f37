"""Runs of many arms over the same pools: arms are rows of configuration, candidates are scanned once, stored runs aren't run again."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillon.operators import evaluation as E
from quillon.storage import small, written

#: Places of a ranking that are kept, metrics of a run.
KEPT = 50
METRICS = ("ndcg", "recall", "mrr")


def arms(spark: SparkSession, configs: dict[str, dict]) -> DataFrame:
    """(arm, sha, weights): each arm's identity, the first 16 hex digits of the sha256 of its configuration as JSON with sorted keys, and its weights by feature, those it masks left out.

    A configuration has `weights` (feature to number), and may have `zeroed` (features) and anything else that tells it apart.
    """
    rows = [(name, json.dumps(c, sort_keys=True, separators=(",", ":")), {f: float(w) for f, w in c["weights"].items() if f not in c.get("zeroed", ()) and w}) for name, c in sorted(configs.items())]
    told = spark.createDataFrame(rows, "arm string, config string, weights map<string,double>")
    return told.select("arm", F.substring(F.sha2("config", 256), 1, 16).alias("sha"), "weights")


class Results:
    """A folder of runs: (arm, sha, user, metric, value), one batch of files for each call that had something to do."""

    KIND = "arm string, sha string, user long, metric string, value double"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.batches = spark, path.rstrip("/"), []

    def rows(self) -> DataFrame:
        if not self.batches:
            return self.spark.createDataFrame([], self.KIND)
        return self.spark.read.schema(self.KIND).parquet(*self.batches)

    def append(self, rows: DataFrame) -> None:
        batch = f"{self.path}/{uuid.uuid4().hex}"
        rows.write.parquet(batch)
        self.batches.append(batch)

    def run(self, told: DataFrame, users: DataFrame, values: DataFrame, judged: DataFrame) -> int:
        """Runs what isn't stored of arms and users, in one job; how many (arm, user) there were. The features of an arm and user that are stored are not joined."""
        due = users.select("user").distinct().crossJoin(F.broadcast(told.select("arm", "sha"))) if small(told, 200) else users.select("user").distinct().join(told.select("arm", "sha"), F.lit(True))
        due = due.join(self.rows().select("sha", "user").distinct(), ["sha", "user"], "left_anti")
        due = written(due, "due")
        n = due.count()
        if n:
            self.append(measured(due, told, values, judged))
        return n


def rankings(due: DataFrame, told: DataFrame, values: DataFrame, k: int = KEPT) -> DataFrame:
    """(arm, sha, user, item, rank) of the k best candidates of each due (arm, sha, user): one pass over scaled rows (user, item, feature, scaled) for all arms.

    A candidate's rows meet once, and all arms are scored from them: rows of features are not multiplied by arms.
    Candidates that an arm has no feature for have score 0; equal scores, to nine digits, are in order of the id.
    """
    weights = told.select("arm", "weights")
    by_user = due.join(F.broadcast(weights) if small(weights, 2000) else weights, "arm").groupBy("user").agg(F.collect_list(F.struct("arm", "sha", "weights")).alias("_arms"))
    own = values.groupBy("user", "item").agg(F.array_sort(F.collect_list(F.struct("feature", "scaled"))).alias("_f"))
    total = lambda a: F.aggregate("_f", F.lit(0.0), lambda s, f: s + F.coalesce(F.element_at(a["weights"], f["feature"]) * f["scaled"], F.lit(0.0)))
    each = own.join(F.broadcast(by_user) if small(due, 2000) else by_user, "user").select("user", "item", F.explode(F.transform("_arms", lambda a: F.struct(a["arm"].alias("arm"), a["sha"].alias("sha"), F.round(total(a), 9).alias("score")))).alias("a"))
    scored = each.select("a.arm", "a.sha", "user", "item", "a.score")
    place = F.row_number().over(Window.partitionBy("arm", "sha", "user").orderBy(F.desc("score"), "item"))
    return scored.withColumn("rank", place).where(F.col("rank") <= k).select("arm", "sha", "user", "item", "rank")


def measured(due: DataFrame, told: DataFrame, values: DataFrame, judged: DataFrame) -> DataFrame:
    """Results.KIND of each due (arm, sha, user): metrics of its ranking against judgements (user, item, rel)."""
    asked = due.select("arm", "sha", "user")
    found = E.metrics(rankings(asked, told, values), judged.select("user", "item", "rel"), asked=asked)
    return found.unpivot(["arm", "sha", "user"], list(METRICS), "metric", "value")


def deltas(results: DataFrame, reference: str, folds: int = 8) -> DataFrame:
    """(arm, metric, delta, better, worse): the mean over folds of an arm's mean difference to the reference arm, and in how many folds it is above or below; user is 8 * user + fold."""
    base = results.where(F.col("arm") == reference).select("user", "metric", F.col("value").alias("_base"))
    each = results.where(F.col("arm") != reference).join(base, ["user", "metric"]).withColumn("fold", F.col("user") % folds)
    by_fold = each.groupBy("arm", "metric", "fold").agg(F.avg(F.col("value") - F.col("_base")).alias("d"))
    return by_fold.groupBy("arm", "metric").agg(F.avg("d").alias("delta"), F.count_if(F.col("d") > 1e-12).alias("better"), F.count_if(F.col("d") < -1e-12).alias("worse"))
