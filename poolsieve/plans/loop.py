"""The active-learning loop: immutable tables of labelled and pool rows, one action an iteration."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import proba
from ..operators import acquire, density, greedy
from ..operators.overlap import gram_counts, pair_overlap
from ..operators.rows import query_size, sample, token_budget, top, union, within, without
from ..session import hash01


@dataclass(frozen=True)
class PoolState:
    """What is labelled, what is not, at which iteration. Rows move; none is lost or doubled."""

    labelled: DataFrame
    pool: DataFrame
    id_col: str
    iteration: int = 0

    def take(self, chosen: DataFrame) -> PoolState:
        """Moves chosen rows, any table with the id, from the pool to the labelled rows."""
        moved = within(self.pool, chosen, self.id_col)
        return replace(self, labelled=union(self.labelled, moved), pool=without(self.pool, chosen, self.id_col), iteration=self.iteration + 1)

    def settled(self) -> PoolState:
        """Lineage cut, where the session has a checkpoint folder."""
        if not self.pool.sparkSession.sparkContext.getCheckpointDir():
            return self
        return replace(self, labelled=self.labelled.checkpoint(), pool=self.pool.checkpoint())


Strategy = Callable[..., DataFrame]
Scorer = Callable[[DataFrame, DataFrame], DataFrame]


def _random(state: PoolState, n: int, seed: int = 0, tokens: str | None = None, **_) -> DataFrame:  # noqa: ANN003
    if tokens:
        return token_budget(state.pool, F.col(tokens), n, hash01(seed + state.iteration, state.id_col), F.col(state.id_col))
    return sample(state.pool, n, state.id_col, seed + state.iteration)


def _seq_score(state: PoolState, n: int, score: str = "seq_score", threshold: float | None = None, mode: str = "absolute", **_) -> DataFrame:  # noqa: ANN003
    if threshold is None:
        return acquire.by_uncertainty(state.pool, F.col(score), n, state.id_col)
    return acquire.filtered_by_uncertainty(state.pool.withColumn("uncertainty", -F.col(score)), "uncertainty", threshold, n, state.id_col, mode)


def _stochastic(state: PoolState, n: int, scores: str = "log_scores", **kw) -> DataFrame:  # noqa: ANN003
    return acquire.stochastic(state.pool, scores, n, state.id_col, **{k: v for k, v in kw.items() if k in ("aggregation", "use_log", "divisor", "seed")})


def _bleuvar(state: PoolState, n: int, generations: str = "texts", divisor: float | None = None, seed: int = 0, **_) -> DataFrame:  # noqa: ANN003
    pool = sample(state.pool, round(state.pool.count() / divisor), state.id_col, seed) if divisor else state.pool
    return acquire.bleu_variance(pool, generations, state.id_col).orderBy(F.col("score").desc(), state.id_col).limit(n)


def _idds(state: PoolState, n: int, vector: str = "embedding", **kw) -> DataFrame:  # noqa: ANN003
    if "u_top" in kw:
        picks = greedy.idds_top(state.pool, state.labelled, n, state.id_col, vector, kw["u_top"], kw.get("l_top", kw["u_top"]), kw.get("lam", 0.667))
    else:
        picks = greedy.idds(state.pool, state.labelled, n, state.id_col, vector, **{k: v for k, v in kw.items() if k in ("lam", "cosine", "uncertainty", "similarity", "outliers")})
    return picks.frame(state.pool.sparkSession, state.id_col)


def _idds_uncertainty(state: PoolState, n: int, score: str = "seq_score", normalise: bool = True, **kw) -> DataFrame:  # noqa: ANN003
    pool = state.pool.withColumn("_unc", -F.col(score))
    pool = acquire.minmax(pool, "_unc", "_unc") if normalise else pool
    return _idds(replace(state, pool=pool), n, uncertainty="_unc", **kw)


EXPRESSIONS: dict[str, Callable] = {
    "lc": proba.least_confidence,
    "entropy": proba.entropy,
    "margin": proba.margin,
    "mnlp": proba.mnlp,
    "bald": proba.bald,
    "var_ratio": proba.variation_ratio,
    "sampled_max_prob": proba.sampled_max,
    "probability_variance": proba.variance,
}


def _expression(score: Callable) -> Strategy:
    def run(state: PoolState, n: int, probas: str = "probas", **_) -> DataFrame:  # noqa: ANN003
        return state.pool.withColumn("uncertainty", score(F.col(probas))).orderBy(F.col("uncertainty").desc(), state.id_col).limit(n)

    return run


def _cluster_margin(state: PoolState, n: int, probas: str = "probas", cluster: str = "cluster", multiplier: int = 10, **_) -> DataFrame:  # noqa: ANN003
    from ..functions.proba import margin

    few = state.pool.withColumn("margin", margin(F.col(probas))).orderBy(F.col("margin").desc(), state.id_col).limit(multiplier * n)
    return acquire.cluster_round_robin(few, cluster, -F.col("margin"), n, state.id_col)


def _mahalanobis(state: PoolState, n: int, label: str = "label", vector: str = "embedding", **_) -> DataFrame:  # noqa: ANN003
    scored = density.mahalanobis(state.labelled, state.pool, label, vector)
    return top(scored.drop("distances"), n, F.col("distance").desc(), F.col(state.id_col))


def _triplet(state: PoolState, n: int, label: str = "label", vector: str = "embedding", lam: float = 0.25, **_) -> DataFrame:  # noqa: ANN003
    return top(density.triplet(state.labelled, state.pool, label, vector, lam), n, F.col("score").desc(), F.col(state.id_col))


def _mahalanobis_filtering(state: PoolState, n: int, label: str = "label", vector: str = "embedding", strategy: str = "lc", filtering_share: float = 0.01, probas: str = "probas", batched: bool = False, **_) -> DataFrame:  # noqa: ANN003
    if batched and strategy == "mahalanobis":
        far = density.single_centre(state.labelled, state.pool, vector)
        stay = density.without_farthest(far, "distance", round(filtering_share * far.count()), state.id_col)
        pool = within(state.pool, stay, state.id_col)
        ids = density.batched(state.labelled, pool, n, label, state.id_col, vector)
        order = state.pool.sparkSession.createDataFrame(list(enumerate(ids)), f"ord int, {state.id_col} long")
        return order.join(pool, state.id_col).orderBy("ord")
    return density.filtered_scores(state.labelled, state.pool, n, state.id_col, label, vector, strategy, filtering_share, probas)


def _mmr(f1: bool) -> Strategy:
    def run(state: PoolState, n: int, tokens: str = "tokens", orders: tuple[int, ...] = (1, 2), lam: float = 0.5, **_) -> DataFrame:  # noqa: ANN003
        counts = gram_counts(state.pool, state.id_col, F.col(tokens), orders)
        pairs = pair_overlap(counts, counts).select("n", "i", "j", "common")
        picks = greedy.mmr(pairs, counts.groupBy("n", "i").agg(F.sum("c").alias("total")), n, lam, f1=f1)
        return picks.frame(state.pool.sparkSession, state.id_col)

    return run


def _registry() -> dict[str, Strategy]:
    named: dict[str, Strategy] = {
        "random": _random,
        "seq_score": _seq_score,
        "seq_score_stochastic": _stochastic,
        "bleuvar": _bleuvar,
        "idds": _idds,
        "embeddings_similarity": _idds,
        "idds_with_uncertainty": _idds_uncertainty,
        "cluster_margin": _cluster_margin,
        "mahalanobis": _mahalanobis,
        "triplet": _triplet,
        "mahalanobis_filtering": _mahalanobis_filtering,
        "mmr_rec_prec": _mmr(False),
        "mmr_f1": _mmr(True),
    }
    return named | {k: _expression(f) for k, f in EXPRESSIONS.items()}


STRATEGIES = _registry()


def strategy_name(strategy: str, split_by_tokens: bool | None = None, head_only_dropout: bool = False) -> str:
    """The name under which an experiment asks for a strategy: by tokens or by samples where a sequence can be split, and BALD with
    dropout of the head alone."""
    postfix = "" if split_by_tokens is None else "_tokens" if split_by_tokens else "_samples"
    return strategy + postfix + ("_head" if strategy == "bald" and head_only_dropout else "")


def named_strategy(name: str) -> Strategy:
    """A strategy by its name, postfixes allowed: ``_tokens`` counts the step in tokens, the others change what the scorer does."""
    plain = name.removesuffix("_head")
    base = plain.removesuffix("_tokens").removesuffix("_samples")
    if base not in STRATEGIES:
        raise ValueError(f"unknown strategy: {name}; known are {sorted(STRATEGIES)}")
    if not plain.endswith("_tokens"):
        return STRATEGIES[base]
    if base == "random":
        return lambda state, n, tokens="n_tokens", **kw: _random(state, n, tokens=tokens, **kw)
    if base not in EXPRESSIONS:
        raise ValueError(f"{base} can't be counted in tokens")

    def by_tokens(state: PoolState, n: int, tokens: str = "n_tokens", probas: str = "probas", **_) -> DataFrame:  # noqa: ANN003
        scored = state.pool.withColumn("uncertainty", EXPRESSIONS[base](F.col(probas)))
        return token_budget(scored, F.col(tokens), n, F.col("uncertainty").desc(), F.col(state.id_col)).drop("cum")

    return by_tokens


@dataclass
class Spec:
    """An experiment: the strategy by name or as a function, how many rows (or which share) a step takes."""

    strategy: str | Strategy
    step: int | float
    iterations: int
    seed: int = 42
    kwargs: dict = field(default_factory=dict)
    subsample: Callable[[DataFrame, int], DataFrame] | None = None

    def choose(self) -> Strategy:
        return named_strategy(self.strategy) if isinstance(self.strategy, str) else self.strategy


def run(state: PoolState, spec: Spec, scorer: Scorer | None = None) -> Iterator[tuple[PoolState, DataFrame, dict[str, float]]]:
    """Yields (state, selection, seconds) of each iteration. ``scorer`` (labelled, pool) adds the columns that the strategy
    reads to the pool: it stands for fitting and applying a model. ``subsample`` (pool, iteration) limits what
    is scored. The selection, ``ord`` and id, is the iteration's only result on the driver. Stops when the pool is empty."""
    strategy = spec.choose()
    for _ in range(spec.iterations):
        total = state.labelled.count() + state.pool.count() if isinstance(spec.step, float) else 0
        n = query_size(spec.step, total)
        began = time.time()
        pool = spec.subsample(state.pool, state.iteration) if spec.subsample else state.pool
        scored = scorer(state.labelled, pool) if scorer else pool
        fitted = time.time()
        chosen = strategy(replace(state, pool=scored), n, **{"seed": spec.seed, **spec.kwargs})
        ids = [r[0] for r in chosen.select(state.id_col).collect()]  # n rows
        if not ids:
            return
        spark = state.pool.sparkSession
        selection = spark.createDataFrame([(spec.seed, state.iteration, i, x) for i, x in enumerate(ids)], f"seed long, iteration int, ord int, {state.id_col} long")
        state = state.take(selection).settled()
        yield state, selection, {"fit": fitted - began, "query": time.time() - fitted}


def resume(labelled: DataFrame, pool: DataFrame, id_col: str, selections: DataFrame) -> PoolState:
    """The state after logged selections (iteration, id): one anti-join and one union, however many iterations there were."""
    last = selections.agg(F.max("iteration")).first()[0]
    state = PoolState(labelled, pool, id_col).take(selections)
    return replace(state, iteration=0 if last is None else last + 1)


def fan_out(specs: list[Spec], seeds: list[int]) -> list[Spec]:
    """Every experiment with every seed."""
    return [replace(s, seed=seed) for s in specs for seed in seeds]


def best_query(candidates: DataFrame, score: Callable[[DataFrame], float], keys: list[int], key: str) -> tuple[int, float]:
    """The candidate set, by key, that scores highest under a given evaluation."""
    found = [(score(candidates.where(F.col(key) == k)), -k) for k in keys]
    value, k = max(found)
    return -k, value


def adaptive(value: float | str, metrics: DataFrame, metric: str) -> float:
    """A threshold or smoothing of pseudo-labels: a number as it is; ``adaptive`` is the last value of a metric, 1 before there is one."""
    from ..operators.pseudo import last_metric

    if value != "adaptive":
        return float(value)
    last = last_metric(metrics, metric)
    return 1.0 if last is None else last


def epochs_and_batch(rows: int, epochs: float, batch: int, min_steps: int, adjust_batch: bool = True, adjust_epochs: bool = True, min_batch: int = 4) -> tuple[float, int]:
    """(epochs, batch size) that give at least ``min_steps`` gradient steps: the batch shrinks to the first of four roundings that is enough, to
    ``min_batch`` at least, where epochs grow instead. Below one epoch nothing changes."""
    if not adjust_batch or epochs < 1:
        return epochs, batch
    need, have = math.ceil(min_steps / epochs), math.ceil(rows / batch)
    if have >= need:
        return epochs, batch
    exact = batch / (need / have)
    tried = [math.ceil(exact), round(exact), int(exact)]  # the last rounding, one less, means the least batch
    for size in tried:
        if size < min_batch:
            break
        if math.ceil(rows / size) >= need:
            return epochs, size
    steps = math.ceil(rows / min_batch)
    return (math.ceil(need / steps * epochs) if adjust_epochs else epochs), min_batch


def train_constants(rows: int, epochs: float, batch: int, min_steps: int, warmup: float, dev_share: float = 0.0, adjust_batch: bool = True, adjust_epochs: bool = True, min_batch: int = 4) -> tuple[int, float, int, int]:
    """(batch size, epochs, steps an epoch, warm-up steps). With a validation share, training stops early: epochs double and are not adjusted."""
    if dev_share > 0:
        epochs, adjust_epochs = epochs * 2, False
    epochs, batch = epochs_and_batch(rows, epochs, batch, min_steps, adjust_batch, adjust_epochs, min_batch)
    steps = math.ceil(rows / batch)
    return batch, epochs, steps, int(epochs * steps * warmup)
