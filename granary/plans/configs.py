"""Declarative plans: curricula, mixtures and packing contracts, read strictly - an unknown key or a wrong sum raises."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOLERANCE = 1e-9


def strict(kind: type, values: dict[str, Any]) -> Any:
    """An instance of a dataclass; keys that it doesn't have raise."""
    unknown = set(values) - {f.name for f in fields(kind)}
    if unknown:
        raise ValueError(f"unknown {kind.__name__} fields: {sorted(unknown)}")
    return kind(**values)


@dataclass(frozen=True)
class Filters:
    """What makes an example eligible for a stage."""

    include_tasks: tuple[str, ...] = ()
    exclude_tasks: tuple[str, ...] = ()
    modes: tuple[str, ...] = ()
    max_tokens: int | None = None
    max_supervised: int | None = None
    banned: tuple[str, ...] = ()

    def condition(self, task: str = "task", mode: str = "mode", tokens: str = "num_tokens", supervised: str = "supervised_tokens", response: str = "response") -> Column:
        out = F.lit(True)
        if self.include_tasks:
            out &= F.col(task).isin(*self.include_tasks)
        if self.exclude_tasks:
            out &= ~F.col(task).isin(*self.exclude_tasks)
        if self.modes:
            out &= F.col(mode).isin(*self.modes)
        if self.max_tokens is not None:
            out &= F.col(tokens) <= self.max_tokens
        if self.max_supervised is not None:
            out &= F.col(supervised) <= self.max_supervised
        for word in self.banned:
            out &= ~F.contains(F.lower(F.coalesce(F.col(response), F.lit(""))), F.lit(word.lower()))
        return out


@dataclass(frozen=True)
class Stage:
    name: str
    max_examples: int
    epochs: int = 1
    filters: Filters = field(default_factory=Filters)


def shares(values: dict[str, float]) -> dict[str, float]:
    """Weights in (0, 1] that sum to 1."""
    if not values or any(not 0 < w <= 1 for w in values.values()):
        raise ValueError("weights must be in (0, 1]")
    if abs(sum(values.values()) - 1) > TOLERANCE:
        raise ValueError("weights must sum to 1")
    return values


# What each packing contract promises.
CONTRACTS = {
    "token_stream": {"overlap": 1, "tail": "dropped", "eos": "after each document"},
    "batch": {"overlap": 0, "tail": "padded", "eos": "after each document"},
    "offline": {"overlap": 0, "tail": "short", "eos": "none"},
    "examples": {"overlap": 0, "tail": "padded", "eos": "separator between examples"},
}


@dataclass(frozen=True)
class RunPlan:
    """Tokens and steps of a run on a cluster."""

    parameters: int
    target_tokens: int
    length: int
    tensor: int = 1
    pipeline: int = 1
    data: int = 1
    micro: int = 1
    accumulate: int = 1

    @property
    def devices(self) -> int:
        return self.tensor * self.pipeline * self.data

    @property
    def tokens_per_step(self) -> int:
        return self.length * self.micro * self.accumulate * self.data

    @property
    def steps(self) -> int:
        return -(-self.target_tokens // self.tokens_per_step)

    @property
    def overshoot(self) -> int:
        return self.steps * self.tokens_per_step - self.target_tokens

    @property
    def optimal_tokens(self) -> int:
        return 20 * self.parameters


def epoch_steps(items: int, world: int, batch: int, epochs: int) -> int:
    """ceil(ceil(items / world) / batch) * epochs, in whole numbers."""
    return -(-(-(-items // world)) // batch) * epochs


def prefix_boundaries(total: int, packs: int) -> list[int]:
    """Ends of `packs` even parts of total, rounded up."""
    return [-(-p * total // packs) for p in range(1, packs + 1)]


def audit_exposures(examples: DataFrame, epochs: int, groups: dict[str, tuple[str, ...]], targets: dict[str, float], tolerance: float) -> DataFrame:
    """(group, exposures, share, target, within) of tasks in groups; tasks in none are the group `unassigned`."""
    label = F.lit("unassigned")
    for name, tasks in groups.items():
        label = F.when(F.col("task").isin(*tasks), F.lit(name)).otherwise(label)
    counts = examples.groupBy(label.alias("group")).agg((F.count("*") * epochs).alias("exposures"))
    total = counts.agg(F.sum("exposures").alias("total"))
    goal = F.coalesce(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv])[F.col("group")], F.lit(0.0))
    out = counts.crossJoin(F.broadcast(total)).withColumns({"share": F.col("exposures") / F.col("total"), "target": goal})
    return out.withColumn("within", F.abs(F.col("share") - F.col("target")) <= tolerance).drop("total")


def release_ready(manifest: Column) -> Column:
    """Whether a release's manifest(quality_status, release_quality(ready), envelope, template_envelope) may go out.

    It must have passed, be declared ready, and have its answers in one envelope, not in one of the data and one of the template.
    """
    twice = F.coalesce(manifest["envelope"], F.lit(False)) & F.coalesce(manifest["template_envelope"], F.lit(False))
    return F.coalesce(manifest["quality_status"] == "passed", F.lit(False)) & F.coalesce(manifest["release_quality"]["ready"], F.lit(False)) & ~twice
