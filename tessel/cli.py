"""Command line: the stages of the research pipeline, each from tables of the one before.

python -m tessel.cli STAGE [--config FILE] [--input-dir DIR] [--output-dir DIR]; run-all runs them in order.
Tables are Parquet; small results are also CSV.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.artifacts import Manifest, bundle, current_tables, publish
from tessel.config import Config, ConfigError, as_plain, load
from tessel.operators import cleaning, decision, factors, indicators, ml, plots, portfolio, registry, research, stress, tuning
from tessel.sources import acquire, sinks
from tessel.sources.files import first_existing, read_csv


class Run:
    """One run's session, settings and tables."""

    def __init__(self, spark: SparkSession, config: Config, out: str):
        self.spark, self.config, self.out = spark, config, out
        self.inputs: list[str] = []  # what the present stage has read

    def path(self, name: str) -> str:
        return f"{self.out}/{name}"

    def find(self, candidates: list[str]) -> str:
        """The first path that exists, noted as an input."""
        found = first_existing(self.spark, candidates)
        self.inputs.append(found)
        return found

    def read(self, name: str) -> DataFrame:
        out = self.config.data.output_dir
        published = current_tables(self.spark, out).get(name)
        return self.spark.read.parquet(self.find([self.path(name), *([published] if published else []), f"{out}/{name}"]))

    def save(self, df: DataFrame, name: str, report: bool = False) -> str:
        """A table, and where it is a report also a CSV and Markdown."""
        df.write.mode("overwrite").parquet(self.path(name))
        if report:
            again = self.spark.read.parquet(self.path(name))
            sinks.write_csv(f"{self.path(name)}.csv", again, 8)
            sinks.write_text(f"{self.path(name)}.md", sinks.markdown(again))
        return self.path(name)


def fetch(r: Run) -> list[str]:
    """Daily bars of the universe from the configured source; nothing where none is configured."""
    c, d = r.config.fetch, r.config.data.input_dir
    if c.source is None:
        return []
    listing = r.find([f"{d}/universe.parquet", f"{d}/universe.csv"])
    raw = r.spark.read.parquet(listing) if listing.endswith(".parquet") else r.spark.read.option("header", True).csv(listing)
    universe = r.save(acquire.universe_of(raw, c.probe_n or c.final_n), "universe", report=True)
    source = acquire.with_retries(acquire.load_fetch(c.source), tuple(map(acquire.load_fetch, c.fallbacks)), c.max_retries, c.base_delay)
    wanted = r.spark.read.parquet(universe)
    state = acquire.fetch_symbols(r.spark, wanted, source, c.start_date, acquire.last_day(c.end_date), c.cache_dir, f"{c.cache_dir}-checkpoint", c.max_workers, c.rate_limit_per_second, c.resume, c.use_cache, c.checkpoint_every)
    out = [universe, r.save(acquire.summary(state.join(wanted.select("symbol"), "symbol", "left_semi"), wanted), "fetch_summary", report=True)]
    return [*out, r.save(acquire.read_cache(r.spark, c.cache_dir).join(wanted.select("symbol"), "symbol", "left_semi"), "fetched")]


def clean(r: Run) -> list[str]:
    d, c = r.config.data.input_dir, r.config.cleaning
    source = r.find([r.path("fetched"), f"{d}/daily_price.parquet", f"{d}/daily_price.csv", f"{d}/processed/daily_price*.csv", f"{d}/daily_price*.csv"])
    raw = r.spark.read.parquet(source) if source.endswith((".parquet", "/fetched")) else read_csv(r.spark, source)
    profile = r.save(cleaning.quality_profile(cleaning.coerce(cleaning.add_missing(cleaning.rename_aliases(raw)))), "quality_profile", report=True)
    bars = r.save(cleaning.clean_daily(raw), "daily_price")
    daily = r.read("daily_price")
    out = indicators.rsi(indicators.volatility(indicators.moving_averages(indicators.returns(daily), c.ma_short, c.ma_long), c.vol_win), c.rsi_period)
    out = indicators.moving_convergence(out, c.ema_fast, c.ema_slow, c.ema_signal)
    out = cleaning.winsorize_global(cleaning.outlier_flags(out, "ret", c.z_thresh, c.iqr_k), "ret", "ret_w", c.winsor_lower_q, c.winsor_upper_q)
    saved = [profile, bars, r.save(out, "tech_indicators")]
    full = r.read("tech_indicators")
    return [
        *saved,
        r.save(cleaning.describe(full, "ret"), "return_stats", report=True),
        r.save(sinks.histogram(full, "ret_w"), "return_histogram", report=True),
        r.save(plots.box_stats(full, "ret_w"), "return_box", report=True),
        r.save(plots.scatter_bins(full, "vol_20", "ret_w"), "volatility_return_bins", report=True),
    ]


def build_factors(r: Run) -> list[str]:
    c, s = r.config.factors, r.config.research
    names = factors.FACTORS if c.include_enhanced else factors.BASE
    panel = factors.standardize(factors.raw_factors(r.read("daily_price"), c.include_enhanced, c.month_end_mode), names, c.winsor_p)
    out = [r.save(panel, "factor_panel")]
    panel, z = r.read("factor_panel"), [f"z_{f}" for f in names]
    out.append(r.save(factors.cumulative_ic(factors.rank_ic(panel, z)), "rank_ic", report=True))
    ic = r.read("rank_ic")
    out += [
        r.save(factors.ic_summary(ic), "ic_summary", report=True),
        r.save(research.ic_significance(ic).join(research.bootstrap_mean(ic, s.bootstrap_samples, s.random_seed, s.bootstrap_ci), "factor"), "ic_significance", report=True),
        r.save(research.ic_decay_summary(research.ic_decay(panel, z, list(c.ic_decay_horizons))), "ic_decay", report=True),
        r.save(research.group_summary(research.group_returns(panel, z, c.quantile_groups)), "group_returns", report=True),
        r.save(research.fama_macbeth(panel, z), "fama_macbeth", report=True),
        r.save(factors.correlation_matrix(panel, z), "factor_correlation", report=True),
    ]
    return out


def backtest(r: Run) -> list[str]:
    c, s = r.config.backtest, r.config.research
    scores = portfolio.scored_panel(r.read("factor_panel"), c.factor_weights, c.sign_flip)
    out = [r.save(scores, "scores")]
    scores = r.read("scores")
    out.append(r.save(portfolio.weights(scores, c.top_quantile), "weights"))
    w = r.read("weights")
    out.append(r.save(portfolio.portfolio_returns(w, scores), "returns_gross"))
    out.append(r.save(portfolio.turnover(w, scores), "turnover"))
    gross, turn = r.read("returns_gross"), r.read("turnover")
    net = portfolio.net_returns(gross, turn, c.transaction_cost_bps + c.slippage_bps)
    split = research.time_split("month_end", s.train_end, s.valid_end, s.test_start)
    for kind, rets in (("gross", gross), ("net", net)):
        both = portfolio.performance(rets, freq=c.freq).join(portfolio.relative_metrics(rets, freq=c.freq), "strategy")
        out += [r.save(both, f"performance_{kind}", report=True), r.save(portfolio.with_nav(rets), f"nav_{kind}")]
    out += [
        r.save(portfolio.rolling_metrics(gross, c.rolling_window, c.freq), "rolling"),
        r.save(portfolio.split_summary(gross, split), "split_summary", report=True),
        r.save(portfolio.robustness(scores, list(c.robustness_quantiles)), "robustness", report=True),
        r.save(portfolio.extreme_months(gross), "extreme_months", report=True),
    ]
    return out


def train_models(r: Run) -> list[str]:
    c, v = r.config.ml, r.config.validation
    out = []
    for method in ("expanding", "purged"):  # either is trained once: the main one also yields predictions and portfolios
        found, importances = ml.walk_forward_predictions(r.read("factor_panel"), list(c.feature_cols), c.models, v.min_train_months, v.test_window_months, method, v.embargo_months)
        out.append(r.save(found, f"predictions_{method}"))
        if method == v.method:
            out += [r.save(ml.mean_importance(importances), "importance", report=True), r.save(portfolio.performance(ml.score_portfolios(r.read(f"predictions_{method}"), c.top_quantile), ("method", "model", "strategy")), "model_portfolios", report=True)]
    both = r.read("predictions_expanding").unionByName(r.read("predictions_purged"))
    out.append(r.save(ml.evaluate(both, c.top_quantile), "model_metrics", report=True))
    return [*out, r.save(ml.compare_methods(r.read("model_metrics")), "validation_comparison", report=True)]


def decide(r: Run) -> list[str]:
    c = r.config.decision
    try:
        predictions = r.read(f"predictions_{r.config.validation.method}")
    except FileNotFoundError:
        predictions = None
    scores = decision.score_panels(r.read("factor_panel"), predictions, c.ml_model)
    found = decision.optimize_panel(scores, c.lookback_months, c.transaction_cost_bps + c.slippage_bps, risk_aversion=c.risk_aversion, turnover_penalty=c.turnover_penalty, concentration_penalty=c.concentration_penalty, max_weight=c.max_weight)
    out = [r.save(found, "decisions")]
    return [*out, r.save(decision.performance(r.read("decisions")), "decision_performance", report=True)]


def tune(r: Run) -> list[str]:
    c, s = r.config.tuning, r.config.research
    grid = tuning.grid(r.spark, list(c.risk_aversion), list(c.turnover_penalty), list(c.top_quantile), list(c.factor_weight_sets))
    splits = {"train_end": s.train_end, "valid_end": s.valid_end, "test_start": s.test_start}
    base = r.config.decision.transaction_cost_bps + r.config.decision.slippage_bps
    found = tuning.evaluate(r.read("factor_panel"), grid, splits, r.config.decision.lookback_months, base)
    out = [r.save(found.drop("factor_weights"), "tuning", report=True)]
    return [*out, r.save(tuning.select(r.read("tuning")), "tuning_selected", report=True)]


def stress_test(r: Run) -> list[str]:
    b, c = r.config.backtest, r.config.stress
    found = stress.regimes(r.read("factor_panel"), portfolio.scored_panel(r.read("factor_panel"), b.factor_weights, b.sign_flip), r.read("daily_price"), b.top_quantile, b.transaction_cost_bps + b.slippage_bps, c.high_cost_bps, c.liquidity_drop_quantile, c.price_limit_pct)
    out = [r.save(found, "stress_returns")]
    return [*out, r.save(stress.regime_summary(r.read("stress_returns")), "stress_metrics", report=True)]


def benchmarks(r: Run) -> list[str]:
    b = r.config.backtest
    mean = r.read("turnover").groupBy("strategy").agg(F.avg("turnover").alias("mean_turnover"))
    decided = decision.month_returns(r.read("decisions")).groupBy("source").agg(F.avg("turnover").alias("mean_turnover"))
    reg = registry.registry(
        registry.backtest_entries(r.read("performance_gross"), mean, "gross", 0.0),
        registry.backtest_entries(r.read("performance_net"), mean, "net", b.transaction_cost_bps + b.slippage_bps),
        registry.model_entries(r.read("model_metrics")),
        registry.decision_entries(r.read("decision_performance"), decided, r.config.decision.transaction_cost_bps + r.config.decision.slippage_bps),
        registry.tuned_entries(r.read("tuning"), r.read("tuning_selected")),
    )
    out = [r.save(reg, "registry", report=True)]
    return [*out, r.save(registry.gross_net(r.read("registry")), "gross_net", report=True)]


STAGES: dict[str, Callable[[Run], list[str]]] = {
    "fetch": fetch,
    "clean": clean,
    "factors": build_factors,
    "backtest": backtest,
    "ml": train_models,
    "decision": decide,
    "tune": tune,
    "stress": stress_test,
    "benchmarks": benchmarks,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessel", description=__doc__.split("\n")[0])
    p.add_argument("stage", choices=[*STAGES, "run-all"])
    p.add_argument("--config")
    p.add_argument("--input-dir")
    p.add_argument("--output-dir")
    return p


def run_stages(spark: SparkSession, config: Config, names: list[str], command: str = "") -> Path:
    """Run stages into a new run directory, keep its manifest, and publish it as the output directory if all succeed."""
    latest = Path(config.data.output_dir)
    manifest = Manifest(latest.parent / "runs" / "pending.json", command, as_plain(config), spark.sparkContext.applicationId)
    run_dir = latest.parent / "runs" / manifest.value["run_id"]
    run_dir.mkdir(parents=True)
    manifest.path = run_dir / "manifest.json"
    run = Run(spark, config, str(run_dir))
    for name in names:
        manifest.started(name)
        run.inputs = []
        try:
            outputs = STAGES[name](run)
        except Exception as e:
            manifest.finished(name, error=f"{type(e).__name__}: {e}", inputs=run.inputs)
            manifest.close("failed")
            raise
        if outputs:
            manifest.finished(name, outputs, inputs=[p for p in run.inputs if p not in outputs])
        else:
            manifest.skipped(name, "nothing configured")
    manifest.close("succeeded")
    bundle(run_dir)
    publish(spark, run_dir, latest)
    return run_dir


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    try:
        config = load(args.config, args.input_dir, args.output_dir)
        spark = spark or SparkSession.builder.appName("tessel").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        names = list(STAGES) if args.stage == "run-all" else [args.stage]
        run_stages(spark, config, names, " ".join(["tessel", *(argv or sys.argv[1:])]))
    except (ConfigError, FileNotFoundError) as e:
        p.error(str(e))
    return 0


if __name__ == "__main__":
    sys.exit(main())
