"""One fitted chain from events to calibrated distributions of a session's count, as an Estimator and its Model.

Sessions are split by their day into train, calibrate and evaluate. Both classifiers learn on train: the chance of a
success at an event, and the hazard that a session ends at a step (a person-period table with the step as a feature).
Both are calibrated on calibrate, where also the count curves and the temperature of the resulting distributions are
fitted. Nothing is fitted on evaluate; the report scores each stage there.

A session's distribution comes from its first row: its features are advanced to each step of the horizon by rule (events
so far, expected pitches, times through), scored by both classifiers, and folded as arrays. No step draws or feeds back
a simulated outcome. With batter features, each step takes those of the batter whose turn it is in the session's line-up.
With a state stride, the hazard also learns from rows in the middle of sessions, so that running ones can be priced.

A saved model is a folder of versions with a pointer to the last whole one. The pointer is replaced by one atomic
rename, after everything else is written, so a save that is cut off leaves the version before it readable.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import boosting as BO
from . import diagnostics as D
from . import features as X
from . import pooling as PO
from . import sessions as SE
from . import splits as SP
from .lineage import settled
from .sessions import USUAL_PITCHES

STAGES = ("raw", "isotonic", "count_curves", "temperature")
#: Batters of a line-up.
PLACES = 9


class _Settings(Params):
    """Fixed values in the defaults: rounds, depths and rates of both classifiers, and the horizon."""

    features = Param(Params._dummy(), "features", "features of an event", TypeConverters.toListString)
    keys = Param(Params._dummy(), "keys", "columns that name a session", TypeConverters.toListString)
    rounds = Param(Params._dummy(), "rounds", "rounds of the success classifier", TypeConverters.toInt)
    stopRounds = Param(Params._dummy(), "stopRounds", "rounds of the hazard classifier", TypeConverters.toInt)
    depth = Param(Params._dummy(), "depth", "depth of the trees", TypeConverters.toInt)
    horizon = Param(Params._dummy(), "horizon", "steps of a session at most", TypeConverters.toInt)
    size = Param(Params._dummy(), "size", "cells of a distribution", TypeConverters.toInt)
    leastDays = Param(Params._dummy(), "leastDays", "days that a fit needs", TypeConverters.toInt)
    heldDays = Param(Params._dummy(), "heldDays", "days of calibrate and of evaluate at least", TypeConverters.toInt)
    batterFeatures = Param(Params._dummy(), "batterFeatures", "those of the features that belong to the batter", TypeConverters.toListString)
    stateStride = Param(Params._dummy(), "stateStride", "every so many events a session's state is a start for the hazard; 0: its first row only", TypeConverters.toInt)

    def _given(self, **values) -> None:
        self._setDefault(features=[], keys=["game_id", "pitcher_id"], rounds=350, stopRounds=300, depth=4, horizon=36, size=21, leastDays=30, heldDays=7, batterFeatures=[], stateStride=0)
        self._set(**{k: v for k, v in values.items() if v is not None})

    def of(self, name: str):
        return self.getOrDefault(name)


def line_ups(events: DataFrame, keys: Sequence[str], batters: Sequence[str]) -> DataFrame:
    """(keys, lineup): the first PLACES batters of each session with their features when they first appear."""
    met = events.where(F.col("batter_id").isNotNull()).groupBy(*keys, "batter_id")
    firsts = met.agg(F.min("bf_so_far").alias("place"), F.min_by(F.struct(*batters), F.struct("bf_so_far", "event_id")).alias("batter"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "batter_id", "batter")))
    return firsts.groupBy(*keys).agg(F.slice(F.transform(ordered, lambda x: x["batter"]), 1, PLACES).alias("lineup"))


def session_starts(events: DataFrame, keys: Sequence[str], features: Sequence[str], batters: Sequence[str] = ()) -> DataFrame:
    """The first row of each session with its length and its count of successes; `day` is the day of its first event.

    With batter features `batters` it has the line-up and the place of the next batter in it in place of them; a session
    without known batters has no line-up.
    """
    known = [c for c in dict.fromkeys([*features, "bf_so_far", "pitch_count_pa_so_far", "pitches_per_bf"]) if c not in (*keys, *batters)]
    first = F.min_by(F.struct(*known), F.struct("bf_so_far", "event_id"))
    day = [] if "day" in keys else [F.min("day").alias("day")]
    found = events.groupBy(*keys).agg(*day, first.alias("_first"), F.count(F.lit(1)).alias("remaining_bf"), F.sum("is_strikeout").alias("actual"))
    starts = found.select(*keys, *(["day"] if day else []), "_first.*", "remaining_bf", "actual")
    return starts.join(line_ups(events, keys, batters), list(keys), "left").withColumn("next_place", F.lit(0)) if batters else starts


def states_between(events: DataFrame, starts: DataFrame, keys: Sequence[str], stride: int) -> DataFrame:
    """The starts, and the states of their sessions after every `stride` events with what remains from there."""
    moving = [c for c in ("bf_so_far", "pitch_count_pa_so_far", "pitches_per_bf") if c in starts.columns]
    derived = [c for c in ("times_through", "heavy_workload") if c in starts.columns]
    later = events.where((F.col("bf_so_far") > 0) & (F.col("bf_so_far") % stride == 0)).select(*keys, *(F.col(c).alias(f"_{c}") for c in (*moving, *derived)))
    met = starts.join(later, list(keys))
    changed = {c: F.col(f"_{c}") for c in (*moving, *derived)} | {"remaining_bf": F.col("remaining_bf") - F.col("_bf_so_far")}
    if "next_place" in starts.columns:
        changed["next_place"] = F.col("_bf_so_far").cast("int")
    return starts.unionByName(met.withColumns(changed).select(*starts.columns))


def step_rows(starts: DataFrame, keys: Sequence[str], features: Sequence[str], steps, batters: Sequence[str] = ()) -> DataFrame:
    """(keys, future_bf_step, features) of each session at each of its steps, what follows from the step brought forward.

    The batters of a line-up take turns from its `next_place` on; those of a session without one have no features.
    """
    at = starts.select("*", F.explode(steps).alias("future_bf_step"))
    ahead = F.col("future_bf_step") - 1
    bf = F.col("bf_so_far") + ahead
    pitches = F.col("pitch_count_pa_so_far") + ahead * F.coalesce("pitches_per_bf", F.lit(USUAL_PITCHES))
    times = F.floor(bf / 9)
    moved = {"bf_so_far": bf, "pitch_count_pa_so_far": pitches, "times_through": times, "heavy_workload": ((pitches >= X.WORKLOAD_PITCHES) | (times >= X.WORKLOAD_TIMES)).cast("int")}
    others = [c for c in at.columns if c not in (*keys, "future_bf_step", *batters)]
    turn = []
    if batters:
        others = [c for c in others if c not in ("lineup", "next_place")]
        place = F.pmod(F.col("next_place") + ahead, F.greatest(F.size("lineup"), F.lit(1))) + 1
        batter = F.try_element_at("lineup", place.cast("int"))
        turn = [batter[c].alias(c) for c in batters]
    return at.select(*keys, "future_bf_step", *((moved[c] if c in moved else F.col(c)).alias(c) for c in others), *turn)


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features that are missing count as zero, also as whole columns."""
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in df.columns else F.lit(0.0) for c in features]
    named = df.select("*", *(e.alias(f"_f{i}") for i, e in enumerate(filled)))
    names = [f"_f{i}" for i in range(len(features))]
    return VectorAssembler(inputCols=names, outputCol="_x").transform(named).drop(*names)


def _scored(df: DataFrame, model: GBTClassificationModel, features: Sequence[str], out: str) -> DataFrame:
    scored = model.setFeaturesCol("_x").transform(_assembled(df, features))
    return scored.select(*df.columns, vector_to_array("probability")[1].alias(out))


def _one(df: DataFrame) -> DataFrame:
    return df.withColumn("curve", F.lit(0))


class OutcomeModel(_Settings, Model, MLWritable, MLReadable):
    """A fitted chain. `success`, `stop`: classifiers. `success_curve`, `stop_curve`, `count_curves`: tables of segments."""

    def __init__(self, success: GBTClassificationModel | BO.Boosted, stop: GBTClassificationModel | BO.Boosted, success_curve: DataFrame, stop_curve: DataFrame, count_curves: DataFrame | None = None, temperature: float = 1.0) -> None:
        super().__init__()
        self._given()
        self._success, self._stop, self.success_curve, self.stop_curve, self.count_curves, self.temperature = success, stop, success_curve, stop_curve, count_curves, temperature

    @property
    def success(self) -> GBTClassificationModel:
        return self._success.model if isinstance(self._success, BO.Boosted) else self._success

    @property
    def stop(self) -> GBTClassificationModel:
        return self._stop.model if isinstance(self._stop, BO.Boosted) else self._stop

    def _pricer(self) -> SE.Pricer:
        curve = lambda table: SE.curves_of(table, "curve").get(0, SE.Curve())
        counts = None if self.count_curves is None else SE.curves_of(self.count_curves, "k")
        leaves = (m.leaves if isinstance(m, BO.Boosted) else BO.Leaves.of(m) for m in (self._success, self._stop))
        return SE.Pricer(self.of("features"), self.of("batterFeatures"), self.of("horizon"), self.of("size"), *leaves, curve(self.success_curve), curve(self.stop_curve), counts, self.temperature)

    def distributions(self, starts: DataFrame, calibrated: bool = True) -> DataFrame:
        """Adds `pmf` before count curves and temperature, from classifiers as they are or calibrated."""
        return self.staged(starts, "isotonic" if calibrated else "raw")

    def staged(self, starts: DataFrame, stage: str = STAGES[-1]) -> DataFrame:
        """Adds `pmf` as it is after one of STAGES. Starts are priced where they lie, none is shuffled."""
        schema = T.StructType([*starts.schema, T.StructField("pmf", T.ArrayType(T.DoubleType()))])
        return starts.mapInArrow(self._pricer().added({"pmf": stage}), schema)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.staged(dataset)

    def report(self, starts: DataFrame) -> DataFrame:
        """(stage, n, log_score, rps) of labelled starts; the last cell stands for all counts from there on.

        A start is read once, and what comes of it is its scores at all stages.
        """
        pricer = self._pricer()
        names = [f"{kind}_{s}" for kind in ("log", "rps") for s in STAGES]
        known = starts.where("actual IS NOT NULL").select("actual", *pricer.columns(starts.columns))
        scored = known.mapInArrow(pricer.scores(STAGES), ", ".join(f"{c} double" for c in names))
        found = scored.agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in names))
        rows = F.array(*(F.struct(F.lit(i).alias("place"), F.lit(s).alias("stage"), "n", F.col(f"log_{s}").alias("log_score"), F.col(f"rps_{s}").alias("rps")) for i, s in enumerate(STAGES)))
        return found.select(F.explode(rows).alias("_r")).select("_r.*")

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class OutcomeChain(_Settings, Estimator):
    """fit() takes the rows of an event log with their features: the keys, day, event_id, is_strikeout, bf_so_far,
    pitch_count_pa_so_far, pitches_per_bf and the named features; batter_id too if some of them are the batter's."""

    def __init__(self, features: Sequence[str], keys: Sequence[str] | None = None, rounds: int | None = None, stop_rounds: int | None = None, horizon: int | None = None, size: int | None = None, least_days: int | None = None, held_days: int | None = None, batter_features: Sequence[str] | None = None, state_stride: int | None = None) -> None:
        super().__init__()
        batters = None if batter_features is None else list(batter_features)
        self._given(features=list(features), keys=None if keys is None else list(keys), rounds=rounds, stopRounds=stop_rounds, horizon=horizon, size=size, leastDays=least_days, heldDays=held_days, batterFeatures=batters, stateStride=state_stride)

    def parts(self, events: DataFrame) -> DataFrame:
        """The sessions' starts with `part`: whole sessions go to train, calibrate or evaluate by the day they begin."""
        starts = session_starts(events, self.of("keys"), self.of("features"), self.of("batterFeatures"))
        return SP.out_of_time(starts, F.col("day"), least=self.of("heldDays"), least_days=self.of("leastDays"))

    def _fit(self, dataset: DataFrame) -> OutcomeModel:
        return self.fit_parts(dataset)[0]

    def fit_parts(self, dataset: DataFrame) -> tuple[OutcomeModel, DataFrame]:
        """The model, and parts() of the same events."""
        keys, features, batters, stride = self.of("keys"), self.of("features"), self.of("batterFeatures"), self.of("stateStride")
        starts = settled(self.parts(dataset))
        fitted_on = starts.where("part <> 'evaluate'")
        wanted = [c for c in features if c in dataset.columns and c not in keys]
        events = settled(dataset.drop("part").join(fitted_on.select(*keys, "part"), keys).select("part", "is_strikeout", *wanted, *(k for k in keys if k in features)))
        states = states_between(dataset, fitted_on, keys, stride) if stride else fitted_on
        periods = step_rows(states.where("remaining_bf >= 1"), keys, features, F.sequence(F.lit(1), F.least(F.lit(self.of("horizon")), F.col("remaining_bf").cast("int"))), batters)
        periods = periods.withColumn("stops", (F.col("future_bf_step") == F.col("remaining_bf")).cast("int"))
        with_step = [*features, "future_bf_step"]
        train, held = F.col("part") == "train", F.col("part") == "calibrate"
        # Neither needs the other, so the jobs of one fill the gaps between those of the other.
        with ThreadPoolExecutor(2) as both:
            begun = [
                both.submit(inheritable_thread_target(dataset.sparkSession)(BO.boosted), rows, own, label, rounds, self.of("depth"), rate, share)
                for rows, own, label, rounds, rate, share in ((events.where(train), features, "is_strikeout", self.of("rounds"), 0.04, 0.85), (periods.where(train), with_step, "stops", self.of("stopRounds"), 0.05, 0.9))
            ]
            success, stop = (b.result() for b in begun)
        success_curve = settled(PO.fit_curves(_one(BO.scored(events.where(held), success.leaves, features, "is_strikeout")), ["curve"]))
        stop_curve = settled(PO.fit_curves(_one(BO.scored(periods.where(held), stop.leaves, with_step, "stops")), ["curve"]))
        model = self._copyValues(OutcomeModel(success, stop, success_curve, stop_curve))
        calibrate = settled(model.distributions(starts.where(held)).select("pmf", F.least("actual", F.lit(self.of("size") - 1)).alias("actual")))
        model.count_curves = settled(PO.fit_count_curves(calibrate, self.of("size")))
        model.temperature = _best_temperature(calibrate.where("actual IS NOT NULL"), model._pricer())
        return model, starts


def _best_temperature(calibrate: DataFrame, pricer: SE.Pricer) -> float:
    """The one with the least log score, the lower of equal ones; 1 without sessions."""
    sums = calibrate.mapInArrow(pricer.tempered_scores(D.TEMPERATURES), "place int, n long, log_score double").groupBy("place").agg((F.sum("log_score") / F.sum("n")).alias("score"))
    best = sums.agg(F.min_by("place", F.struct("score", "place"))).first()[0]
    return 1.0 if best is None else D.TEMPERATURES[best]


POINTER = "CURRENT"


def _file_context(spark: SparkSession, path: str):
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()), jvm


def point_to(spark: SparkSession, path: str, version: str) -> None:
    """Makes `version` the current one of the folder, by a rename over the pointer before."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    pending = hadoop.Path(f"{path}/.{POINTER}-{uuid.uuid4()}")
    out = pending.getFileSystem(spark._jsc.hadoopConfiguration()).create(pending, True)
    out.write(bytearray(version.encode()))
    out.close()
    context, jvm = _file_context(spark, path)
    over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    over[0] = hadoop.Options.Rename.OVERWRITE
    context.rename(pending, hadoop.Path(f"{path}/{POINTER}"), over)


def current_version(spark: SparkSession, path: str) -> str:
    return spark.read.text(f"{path}/{POINTER}").first()[0].strip()


class _Writer(MLWriter):
    def __init__(self, model: OutcomeModel) -> None:
        super().__init__()
        self.model = model

    def save(self, path: str) -> None:
        """Adds a version and points to it; versions before it stay."""
        self.saveImpl(path)

    def saveImpl(self, path: str) -> None:
        m, spark = self.model, SparkSession.getActiveSession()
        version = f"versions/{time.time_ns():020d}-{uuid.uuid4()}"
        folder = f"{path}/{version}"
        m.success.write().save(f"{folder}/success")
        m.stop.write().save(f"{folder}/stop")
        for name in ("success_curve", "stop_curve", "count_curves"):
            getattr(m, name).write.parquet(f"{folder}/{name}")
        settings = {p.name: m.getOrDefault(p) for p in m.params if m.isDefined(p)}
        spark.createDataFrame([(json.dumps({"settings": settings, "temperature": m.temperature}),)], "value string").coalesce(1).write.text(f"{folder}/metadata")
        point_to(spark, path, version)


class _Reader(MLReader):
    def load(self, path: str) -> OutcomeModel:
        spark = SparkSession.getActiveSession()
        folder = f"{path}/{current_version(spark, path)}"
        metadata = json.loads(spark.read.text(f"{folder}/metadata").first()[0])
        tables = {name: spark.read.parquet(f"{folder}/{name}") for name in ("success_curve", "stop_curve", "count_curves")}
        model = OutcomeModel(GBTClassificationModel.load(f"{folder}/success"), GBTClassificationModel.load(f"{folder}/stop"), temperature=metadata["temperature"], **tables)
        model._set(**metadata["settings"])
        return model
