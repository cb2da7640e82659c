"""Configuration: a table of options with defaults and rules, and the plan of all runs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the format: weightings and methods, in the order in which runs are planned.
MATRICES = ("kmer", "unitig", "uniqrow")
METHODS = ("optimal", "worst", "nj", "upgma", "randomized")


@dataclass(frozen=True)
class Option:
    """A default, and a rule that names the fault of a value, or gives None."""

    default: object
    fault: Callable[[object], str | None]


def whole(least: int | None = None) -> Callable[[object], str | None]:
    """Whole numbers, from `least` on; True and False are none."""
    return lambda v: None if type(v) is int and (least is None or v >= least) else f"is no whole number{'' if least is None else f' of {least} or more'}: {v!r}"


def several(one: Callable[[object], str | None]) -> Callable[[object], str | None]:
    """Lists, not empty, of values under one rule."""
    return lambda v: "is no list of values" if not isinstance(v, list) or not v else next((f"holds a value that {f}" for x in v if (f := one(x))), None)


def switches(*known: str) -> Callable[[object], str | None]:
    """Mappings of known names to true or false that leave one of the names on, those not given being on."""

    def fault(v: object) -> str | None:
        if not isinstance(v, dict):
            return "is no mapping"
        strange = [k for k in v if k not in known]
        odd = [k for k in v if not isinstance(v[k], bool)]
        if strange or odd:
            return f"has unknown names {sorted(map(str, strange))} or values beside true and false {sorted(map(str, odd))}"
        return None if any(v.get(k, True) for k in known) else "switches everything off"

    return fault


OPTIONS = {
    "kmer_sizes": Option([31], several(whole(3))),
    "random_seed": Option(1, whole()),
    "sampling_steps": Option(0, whole(0)),
    "matrices": Option({}, switches(*MATRICES)),
    "outputs": Option({}, switches(*METHODS)),
    "sketch_k": Option(31, whole(1)),
    "sketch_size": Option(10000, whole(1)),
}


class Config(SimpleNamespace):
    """Options of a run over all datasets: those given, the others by default. All faults are told in one ValueError."""

    def __init__(self, **given):
        faults = [f"unknown option {k}" for k in given if k not in OPTIONS]
        values = {k: given.get(k, o.default) for k, o in OPTIONS.items()}
        faults += [f"{k} {f}" for k, v in values.items() if (f := OPTIONS[k].fault(v))]
        if faults:
            raise ValueError("; ".join(faults))
        super().__init__(**values)

    @property
    def on_matrices(self) -> list[str]:
        return [m for m in MATRICES if self.matrices.get(m, True)]

    @property
    def on_methods(self) -> list[str]:
        return [m for m in METHODS if self.outputs.get(m, True)]


def planned_runs(spark: SparkSession, config: Config, sizes: DataFrame) -> DataFrame:
    """(dataset, n, k, method, type): every combination that is enabled; sizes: (dataset, n). Options are few."""
    one = lambda xs, c: spark.createDataFrame([(x,) for x in xs], c)
    return sizes.crossJoin(one(config.kmer_sizes, "k int")).crossJoin(one(config.on_methods, "method string")).crossJoin(one(config.on_matrices, "type string"))
