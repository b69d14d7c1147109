"""A build that checks as it goes: a model's checks run before what is built from it, and an error holds
back its descendants, and only those."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from nimbusops.config import local_frame
from nimbusops.plans.warehouse import LAYERS, PARENTS, Warehouse
from nimbusops.quality import checks

BUILT, FAILED, HELD_BACK = "built", "failed", "held back"


@dataclass(frozen=True)
class Outcome:
    """errors and warnings: the checks with violations."""

    model: str
    status: str
    errors: tuple[str, ...] = ()
    warnings: tuple[str, ...] = ()
    because_of: str | None = None


def checked_build(wh: Warehouse, rules: dict[str, checks.Rules] | None = None,
                  make: Callable[[str], DataFrame] | None = None) -> list[Outcome]:
    """Build all models in order. make: how a model is built, e.g. `lambda m: wh.save_model(m, "marts")`; as it
    is staged (or a view) by default. A model that fails is there to be looked at, its descendants are not built.
    """
    rules = checks.declared_rules(wh.params) if rules is None else rules
    make = wh.built if make is None else make
    known, outcomes = dict(wh.seeds()), {}
    for model in LAYERS:
        culprits = [p for p in PARENTS[model] if outcomes[p].status != BUILT]
        if culprits:
            outcomes[model] = Outcome(model, HELD_BACK, because_of=outcomes[culprits[0]].because_of or culprits[0])
            continue
        known[model] = make(model)
        found = checks.run_model_checks(known, model, rules, wh.params).where("violations > 0").collect()  # a row per check
        texts = {severity: tuple(sorted(f"{r.check} {r.column}".strip() for r in found if r.severity == severity))
                 for severity in (checks.ERROR, checks.WARN)}
        outcomes[model] = Outcome(model, FAILED if texts[checks.ERROR] else BUILT, texts[checks.ERROR], texts[checks.WARN])
    return list(outcomes.values())


def outcome_frame(wh: Warehouse, outcomes: list[Outcome]) -> DataFrame:
    rows = [(o.model, o.status, ", ".join(o.errors), ", ".join(o.warnings), o.because_of) for o in outcomes]
    return local_frame(wh.spark, dict.fromkeys(("model", "status", "errors", "warnings", "because_of"), "string"), rows)


def fail_on_errors(outcomes: list[Outcome]) -> None:
    if bad := [f"{o.model}: {', '.join(o.errors)}" for o in outcomes if o.status == FAILED]:
        raise ValueError("; ".join(bad))
