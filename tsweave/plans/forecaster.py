"""End-to-end runs: prepare, split, fit, score, report, forecast, save."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from tsweave.operators import arima, models
from tsweave.operators.evaluate import evaluate
from tsweave.operators.forecast import dated, recursive_linear, recursive_model, step_lengths
from tsweave.operators.linear import LinearWindowModel, fit_linear
from tsweave.operators.panel import Panel, join_series
from tsweave.operators.recurrent import RecurrentModel, fit_recurrent
from tsweave.operators.scaling import RANGE, minmax, unscale
from tsweave.operators.splits import OVERLAP, TRAIN_SHARE, floor_cut, split_ceil_overlap
from tsweave.operators.windows import WINDOW_LENGTH, clean_windows, require_clean_windows, seed_windows, split_windows
from tsweave.session import materialise
from tsweave.sources.store import load_artefact, load_pipeline, save_artefact
from tsweave.spec import PANEL, SeriesSpec


@dataclass(frozen=True)
class SequenceForecaster:
    """Scaled sliding windows in, next value out, one model for all series.

    ``aligned=False`` keeps a known off-by-one: the last observation of each
    series is never used, and the first forecast repeats the last known target
    one day late. ``aligned=True`` uses every observation.

    A forecast starts from the last window of the whole series. With
    ``seed_in_test`` it must lie in the test part, and a series whose test part
    is too short for it has null predictions. ``strict`` stops a run at the
    first null or NaN in a window; otherwise it only costs the windows it is in.

    ``model`` is ``linear``, ``recurrent`` or a tree model; ``settings`` are those of
    ``fit_recurrent`` or of the trees.
    """

    model: str = "linear"
    length: int = WINDOW_LENGTH
    feature_range: tuple[float, float] = RANGE
    share: float = TRAIN_SHARE
    overlap: int = OVERLAP
    clamp: bool = False
    aligned: bool = False
    seed_in_test: bool = False
    strict: bool = True
    settings: dict = field(default_factory=dict)

    def scaled(self, panel: Panel) -> Panel:
        """Split the panel and scale it by the train rows of each series."""
        split = split_ceil_overlap(panel, self.share, self.overlap, self.clamp)
        return minmax(split, F.col("in_train"), self.feature_range)

    def windows(self, scaled: Panel) -> DataFrame:
        """Windows of both parts with the bounds of their series."""
        return split_windows(scaled, self.length, "scaled", keep_last=self.aligned)

    def fit(self, panel: Panel) -> FittedSequence:
        spec, scaled = panel.spec, self.scaled(panel)
        windows = self.windows(scaled)
        if self.strict:
            windows = require_clean_windows(windows)
        if self.model == "linear":
            used = F.col("train_rows") - (0 if self.aligned else 1)
            fitted = fit_linear(replace(scaled, spec=replace(spec, value="scaled")), self.length, used, self.strict)
        elif self.model == "recurrent":
            usable = windows if self.strict else clean_windows(windows)
            fitted = fit_recurrent(usable, spec.key, **self.settings)
        else:
            pipeline = models.window_pipeline(self.model, self.length, **self.settings)
            usable = windows if self.strict else clean_windows(windows)
            fitted = models.fit_pipeline(pipeline, usable.where("split = 'train'"), ["x", "y"])
        seeds = seed_windows(scaled, self.length, "scaled", keep_last=self.aligned)
        if self.seed_in_test:
            outside = F.col("pos") < F.col("test_start") + self.length
            seeds = seeds.withColumns(
                {
                    "x": F.when(outside, F.transform("x", lambda e: F.lit(None).cast("double"))).otherwise(F.col("x")),
                    "reason": F.when(outside, "test part too short").otherwise(F.col("reason")),
                }
            )
        state = seeds.select(spec.key, "last_ts", "x", "lo", "hi", "reason")
        return FittedSequence(self, fitted, state, step_lengths(panel), spec, windows)


@dataclass(frozen=True)
class FittedSequence:
    config: SequenceForecaster
    model: PipelineModel | LinearWindowModel | RecurrentModel
    state: DataFrame
    steps: DataFrame
    spec: SeriesSpec = PANEL
    windows: DataFrame | None = None

    def _unscale(self, column):
        return unscale(column, F.col("lo"), F.col("hi"), self.config.feature_range)

    def transform(self, windows: DataFrame) -> DataFrame:
        """Actual and predicted target of windows, in original units."""
        usable = windows if self.config.strict else clean_windows(windows)
        return self.model.transform(usable).select(
            self.spec.key, "split", F.col("y_ts").alias(self.spec.ts), "pos",
            self._unscale(F.col("y")).alias("actual"), self._unscale(F.col("predicted")).alias("predicted"),
        )

    def predictions(self) -> DataFrame:
        return self.transform(self.windows)

    def errors(self) -> DataFrame:
        scored = self.predictions().withColumn("model", F.lit(self.config.model))
        return evaluate(scored, [self.spec.key, "model", "split"])

    def loss_curve(self) -> DataFrame:
        if isinstance(self.model, RecurrentModel):
            return self.model.loss_curve(self.state.sparkSession)
        windows = self.windows if self.config.strict else clean_windows(self.windows)
        return models.loss_curve(self.model, windows.select("split", "x", "y"), "y")

    def forecast(self, horizon: int, step: str = "days") -> DataFrame:
        """``horizon`` steps after the last known date, ``(key, step, date, predicted, reason)``.

        Every series has its rows; one that cannot be forecast has null predictions and the reason.
        ``step="days"`` labels the steps with whole days, ``"infer"`` with the
        median gap of each series.
        """
        if horizon < 1:
            raise ValueError("horizon must be 1 or more")
        state, seconds = self.state, None
        if step == "infer":
            state, seconds = join_series(state, self.steps, [self.spec.key]), "step_seconds"
        if self.config.model == "linear":
            weights = F.array(*[F.lit(w) for w in self.model.weights])
            paths = recursive_linear(state, weights, F.lit(self.model.intercept), horizon)
        else:
            paths = recursive_model(state, self.model, horizon)
        return dated(paths, self.spec.key, "last_ts", self._unscale, seconds)

    def save(self, path: str) -> None:
        settings = {"config": asdict(self.config), "spec": asdict(self.spec)}
        pipeline = self.model
        if isinstance(self.model, LinearWindowModel):
            pipeline, settings["linear"] = None, asdict(self.model)
        elif isinstance(self.model, RecurrentModel):
            pipeline, settings["recurrent"] = None, asdict(self.model)
        save_artefact(path, pipeline, join_series(self.state, self.steps, [self.spec.key]), settings)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> FittedSequence:
        state, settings = load_artefact(spark, path)
        if "linear" in settings:
            line = settings["linear"]
            model = LinearWindowModel(tuple(line["weights"]), line["intercept"])
        elif "recurrent" in settings:
            cells = settings["recurrent"]
            model = RecurrentModel(cells["units"], tuple(cells["weights"]), tuple(map(tuple, cells["losses"])))
        else:
            model = load_pipeline(path)
        config = settings["config"]
        config["feature_range"] = tuple(config["feature_range"])
        spec = settings["spec"]
        spec["order"] = tuple(spec["order"]) if spec["order"] else None
        spec = SeriesSpec(**spec)
        steps = state.select(spec.key, "step_seconds")
        return cls(SequenceForecaster(**config), model, state.drop("step_seconds"), steps, spec)


@dataclass(frozen=True)
class EnsembleForecaster:
    """Trees on calendar, lag and rolling features, one model for all series.

    ``leak_safe=False`` gives the rolling mean its original frame, which holds
    the target itself; errors of such a model say nothing about its skill, and
    are labelled so.
    """

    model: str = "random_forest"
    features: str = "lags"
    leak_safe: bool = True
    settings: dict = field(default_factory=dict)

    def fit(self, panel: Panel) -> FittedEnsemble:
        frame, names = models.training_frame(panel, self.leak_safe, self.features)
        spec = panel.spec
        # Fitting and scoring both read the features.
        frame = materialise(frame.select(spec.key, "split", spec.ts, "pos", spec.value, *names), "features")
        pipeline = models.table_pipeline(self.model, names, spec.value, **self.settings)
        return FittedEnsemble(self, pipeline.fit(frame.where("split = 'train'")), frame, spec)


@dataclass(frozen=True)
class FittedEnsemble:
    config: EnsembleForecaster
    model: PipelineModel
    frame: DataFrame
    spec: SeriesSpec = PANEL

    @property
    def name(self) -> str:
        leaks = self.config.features == "lags" and not self.config.leak_safe
        return self.config.model + (" (leaking)" if leaks else "")

    def predictions(self) -> DataFrame:
        return models.predictions(self.model, self.frame, self.spec)

    def errors(self) -> DataFrame:
        return evaluate(self.predictions().withColumn("model", F.lit(self.name)), [self.spec.key, "model", "split"])

    def loss_curve(self) -> DataFrame:
        return models.loss_curve(self.model, self.frame, self.spec.value)


def series_linear_forecast(
    panel: Panel, horizon: int, length: int = WINDOW_LENGTH, feature_range: tuple[float, float] = RANGE
) -> DataFrame:
    """Forecast each series with a linear window model of its own.

    The windows of a series are its lags, so the fit is an autoregression from
    lag products; no window has to be built to fit it.
    """
    spec = panel.spec
    split = split_ceil_overlap(panel)
    scaled = minmax(split, F.col("in_train"), feature_range)
    on_scaled = replace(scaled, spec=replace(spec, value="scaled"))
    # The last usable train window is left out, as in sliding_windows.
    fits = arima.fit_orders(on_scaled, [(length, 0, 0)], rows=F.col("train_rows") - 1)
    seeds = seed_windows(scaled, length, "scaled").select(spec.key, "last_ts", "x", "lo", "hi", "reason")
    ready = join_series(seeds, fits.select(spec.key, "intercept", "phi"), [spec.key])
    unfitted = F.array_repeat(F.lit(None).cast("double"), length)
    ready = ready.withColumns(
        {
            "reason": F.coalesce("reason", F.when(F.col("phi").isNull(), "no fit")),
            "phi": F.coalesce("phi", unfitted),
        }
    )
    paths = recursive_linear(ready, F.reverse("phi"), F.col("intercept"), horizon)
    return dated(paths, spec.key, "last_ts", lambda c: unscale(c, F.col("lo"), F.col("hi"), feature_range))


def arima_run(panel: Panel, orders: list[tuple[int, int, int]] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Search orders on the train part, refit the best, predict train and test.

    Returns the chosen orders, the prediction frame and the errors.
    """
    spec = panel.spec
    orders = orders or arima.all_orders()
    cut = floor_cut(F.col("n"))
    # One row per series, read three times below.
    fits = materialise(arima.refit_best(panel, orders, rows=cut), "arima-fits")
    chosen = fits.select(spec.key, "p", "d", "q", F.col("search_aic").alias("aic"))
    largest = tuple(max(o[i] for o in orders) for i in range(3))
    fitted = arima.in_sample(panel, fits, largest)
    if largest[2]:
        # Read for the train part and for the errors that forecasts start from.
        fitted = fitted.written("arima-in-sample")
        fits = arima.with_last_errors(fits, fitted, cut)
    train = fitted.where(F.col("pos") < cut)
    lengths = panel.df.groupBy(spec.key).agg(F.max("n").alias("_n"))
    ahead = join_series(fits, lengths, [spec.key], "inner")
    steps = arima.forecast(ahead, spec.key, F.col("_n") - floor_cut(F.col("_n")))
    test = join_series(panel.where(F.col("pos") >= cut).df.withColumn("step", F.col("pos") - cut + 1), steps, [spec.key, "step"])
    columns = [spec.key, "split", spec.ts, "pos", F.col(spec.value).alias("actual"), "predicted"]
    frame = train.df.withColumn("split", F.lit("train")).select(*columns).unionByName(
        test.withColumn("split", F.lit("test")).select(*columns)
    )
    errors = evaluate(frame.withColumn("model", F.lit("arima")), [spec.key, "model", "split"])
    return chosen, frame, errors
