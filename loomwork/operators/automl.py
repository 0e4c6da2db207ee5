"""Search, fit, score and ensemble of candidate pipelines.

The driver holds only the small list of candidates; every fit, transform and score is a Spark
job on DataFrames. Trials run on a few threads at once, each under a job tag, so a trial that
exceeds its time is cancelled by its tag.
"""

from __future__ import annotations

import math
import time
import uuid
from collections import defaultdict
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from loomwork.operators import ensemble, evaluate
from loomwork.operators.column_loop import ColumnLoop, ModelStep, TableStep
from loomwork.operators.tagging import MODEL, TRANSFORM
from loomwork.schemas import SEARCH_LOG
from loomwork.session import cut_lineage

MAX_ROWS = 10_000
FINAL_FIT_SECONDS = 120
SCORE_FLOOR = 0.0


def cap_rows(df: DataFrame, n: int = MAX_ROWS, seed: int = 42) -> DataFrame:
    """Exactly n rows drawn with replacement when there are more; otherwise all rows."""
    total = df.count()
    if total <= n:
        return df
    spare = 1.0 + 6.0 / math.sqrt(n)
    while True:
        # with replacement a share above 1 is fine; stored, so that no retry draws again
        drawn = cut_lineage(df.sample(True, n * spare / total, seed).orderBy(F.rand(seed)).limit(n))
        if drawn.count() == n:
            return drawn
        spare *= 2


def check_runs(data: DataFrame) -> None:
    """Compute every column of every row: a transform that cannot run fails here."""
    data.write.format("noop").mode("overwrite").save()


def train_val_split(
    df: DataFrame, share: float = 0.2, seed: int = 42, key: str = "row_id"
) -> tuple[DataFrame, DataFrame]:
    """Split by a hash of the key: the same rows each time, also after recomputation."""
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("")))
    slot = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 10_000
    held = slot < int(share * 10_000)
    return df.filter(~held), df.filter(held)


@dataclass(frozen=True)
class Step:
    role: str
    component: str
    wrap: bool = False
    log_prob: float = 0.0

    def stage(self):
        if self.role == MODEL:
            return ModelStep(self.component)
        if self.role == TRANSFORM:
            return ColumnLoop(self.component) if self.wrap else TableStep(self.component)
        raise ValueError(f"unknown role {self.role}")


@dataclass
class Candidate:
    """Steps with their fitted stages; `data` is the training table after the transforms."""

    data: DataFrame
    steps: list[Step] = field(default_factory=list)
    fitted: list = field(default_factory=list)
    log_prob: float = 0.0
    score: float | None = None

    @property
    def depth(self) -> int:
        return sum(s.role == TRANSFORM for s in self.steps)

    def uses(self, component: str) -> bool:
        return any(s.component == component for s in self.steps)

    def extend(self, step: Step) -> Candidate:
        """Fit one more step on the current table; repeated components are refused."""
        if self.uses(step.component):
            raise ValueError(f"{step.component} is used already")
        model = step.stage().fit(self.data)
        data = self.data
        if step.role == TRANSFORM:
            data = model.transform(self.data)
            check_runs(data)
        return replace(
            self, data=data, steps=[*self.steps, step], fitted=[*self.fitted, model],
            log_prob=self.log_prob + step.log_prob, score=None,
        )

    def pipeline(self) -> PipelineModel:
        return PipelineModel(self.fitted)

    def predict(self, df: DataFrame) -> DataFrame:
        """(row_id, label?, pred, proba)."""
        return self.pipeline().transform(df)

    def evaluate(self, df: DataFrame, task: str, metric: str | None) -> float | None:
        """Score on other data: macro F1, or the model's default score."""
        preds = self.predict(df)
        table = evaluate.macro_f1(preds) if metric == "macro_f1" else (
            evaluate.default_score(preds, task)
        )
        return table.first()["score"]

    def refit(self, df: DataFrame) -> Candidate:
        """All steps fitted again on other data."""
        fresh = Candidate(df, log_prob=0.0)
        for step in self.steps:
            fresh = fresh.extend(step)
        return replace(fresh, score=self.score)


def transform_step(df: DataFrame, component: str, wrap: bool = False):
    """(fitted stage, transformed table)."""
    model = Step(TRANSFORM, component, wrap).stage().fit(df)
    return model, model.transform(df)


def model_step(df: DataFrame, component: str):
    return Step(MODEL, component).stage().fit(df)


def from_configuration(df: DataFrame, config: list[dict]) -> Candidate:
    """Build and fit one candidate; the first failing step aborts."""
    candidate = Candidate(df)
    for entry in config:
        candidate = candidate.extend(
            Step(entry["role"], entry["component"], bool(entry.get("wrap", False)))
        )
    return candidate


class Search:
    """Beam search for transforms, then models, on one training table."""

    def __init__(self, predictor, train: DataFrame, val: DataFrame | None = None,
                 depth: int = 3, beam: int | None = 10, seconds: float = 60.0,
                 task: str = "classification", metric: str | None = "macro_f1",
                 threads: int = 4):
        self.predictor, self.train, self.val = predictor, train, val
        self.depth, self.beam, self.seconds = depth, beam, seconds
        self.task, self.metric, self.threads = task, metric, threads
        self.spark = train.sparkSession
        self.log: list[tuple] = []

    def limited(self, work, seconds: float):
        """Run work() under a job tag; cancel its jobs when the time is up."""
        tag = f"loomwork-{uuid.uuid4().hex}"
        context = self.spark.sparkContext

        def tagged():
            context.addJobTag(tag)
            try:
                return work()
            finally:
                context.removeJobTag(tag)

        pool = ThreadPoolExecutor(1)
        task = pool.submit(tagged)
        try:
            return task.result(timeout=seconds)
        except TimeoutError:
            context.cancelJobsWithTag(tag)
            raise
        finally:
            pool.shutdown(wait=False)

    def _try(self, candidate: Candidate, step: Step) -> Candidate | None:
        started = time.time()
        try:
            result = self.limited(lambda: candidate.extend(step), self.seconds)
        except Exception:
            result = None
        self.log.append(
            (len(self.log), step.role, step.component, step.wrap, started,
             time.time() - started, result is not None)
        )
        return result

    def _extend(self, candidate: Candidate, options: list[Step], need: int | None):
        """The first `need` successes among the options, tried in order, a few at a time."""
        found: list[Candidate] = []
        options = [s for s in options if not candidate.uses(s.component)]
        with ThreadPoolExecutor(self.threads) as pool:
            while options and (need is None or len(found) < need):
                size = self.threads if need is None else min(self.threads, need - len(found))
                batch, options = options[:size], options[size:]
                results = pool.map(lambda s: self._try(candidate, s), batch)
                found += [r for r in results if r is not None]
        return found

    def prune(self, candidates: list[Candidate]) -> list[Candidate]:
        ranked = sorted(candidates, key=lambda c: -c.log_prob)
        return ranked[: self.beam] if self.beam else ranked

    def transforms(self) -> list[Candidate]:
        working = [Candidate(self.train)]
        pool = list(working)
        for _ in range(self.depth):
            fresh: list[Candidate] = []
            for candidate in working:
                ranked = self.predictor.predict_transforms(
                    self.spark, [s.component for s in candidate.steps], candidate.data
                )
                options = [Step(TRANSFORM, t, w, p) for t, p in ranked for w in (False, True)]
                need = None if self.beam is None else 2 * self.beam
                fresh += self._extend(candidate, options, need)
            working = self.prune(fresh)
            # survivors share their transformed table with everything built on them
            working = [replace(c, data=c.data.persist()) for c in working]
            pool += working
        return pool

    def models(self, working: list[Candidate]) -> list[Candidate]:
        found: list[Candidate] = []
        for candidate in working:
            ranked = self.predictor.predict_models(
                self.spark, [s.component for s in candidate.steps], candidate.data
            )
            options = [Step(MODEL, m, False, p) for m, p in ranked]
            found += self._extend(candidate, options, self.beam)
        by_length = defaultdict(list)
        for candidate in found:
            by_length[len(candidate.steps)].append(candidate)
        kept = [c for group in by_length.values() for c in self.prune(group)]
        if self.val is None:
            return kept
        for candidate in kept:
            try:
                candidate.score = self.limited(
                    lambda c=candidate: c.evaluate(self.val, self.task, self.metric),
                    self.seconds,
                )
            except Exception:
                candidate.score = None
        return sorted((c for c in kept if c.score is not None), key=lambda c: -c.score)

    def run(self) -> list[Candidate]:
        pool = self.transforms()
        try:
            return self.models(pool)
        finally:
            for candidate in pool[1:]:
                candidate.data.unpersist()

    def search_log(self) -> DataFrame:
        """One row per trial."""
        return self.spark.createDataFrame(self.log, SEARCH_LOG)

    def prune_ill(self, candidates: list[Candidate], full: DataFrame) -> list[Candidate]:
        """Candidates refitted on the full data; those that fail to refit, predict or score,
        or whose validation score is not above zero, are dropped."""
        sound = []
        for candidate in candidates:
            try:
                fitted = self.limited(lambda c=candidate: c.refit(full), FINAL_FIT_SECONDS)
                fitted.evaluate(full, self.task, None)
            except Exception:
                continue
            if fitted.score is not None and fitted.score > SCORE_FLOOR:
                sound.append(fitted)
        return sound


class AutoPipeline:
    """fit, then predict with one candidate or with all of them."""

    def __init__(self, predictor, task: str = "classification", max_rows: int = MAX_ROWS,
                 threads: int = 4):
        self.predictor, self.task, self.max_rows = predictor, task, max_rows
        self.threads = threads
        self.candidates: list[Candidate] = []

    def fit(self, df: DataFrame, share: float = 0.2, depth: int = 3, beam: int | None = 10,
            seconds: float = 60.0) -> AutoPipeline:
        """df has row_id, label and feature columns. The search runs on capped rows, the
        final fit on all of them."""
        # stored once: a sample drawn again after a lost executor could differ
        capped = cut_lineage(cap_rows(df, self.max_rows))
        train, val = (part.persist() for part in train_val_split(capped, share))
        metric = "macro_f1" if self.task == "classification" else None
        self.search = Search(
            self.predictor, train, val, depth, beam, seconds, self.task, metric, self.threads,
        )
        try:
            found = self.search.run()
            self.candidates = self.search.prune_ill(found, df)
        finally:
            train.unpersist()
            val.unpersist()
        return self

    def votes(self, df: DataFrame) -> DataFrame:
        """(program, row_id, pred, proba) of all candidates."""
        parts = [
            c.predict(df).select(F.lit(i).alias("program"), "row_id", "pred", "proba")
            for i, c in enumerate(self.candidates)
        ]
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result

    def predict(self, df: DataFrame, index: int | None = 0) -> DataFrame:
        """(row_id, pred) of one candidate, or the majority vote for index=None."""
        if index is None:
            return ensemble.majority_vote(self.votes(df))
        return self.candidates[index].predict(df).select("row_id", "pred")

    def predict_proba(self, df: DataFrame, index: int | None = None) -> DataFrame:
        """(row_id, class, p) averaged over the candidates, or of one of them."""
        if index is None:
            return ensemble.mean_proba(self.votes(df))
        one = self.candidates[index].predict(df)
        return one.select("row_id", F.posexplode("proba").alias("class", "p"))
