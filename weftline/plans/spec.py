"""What a dataset is: a frozen specification, checked before a session exists."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, fields
from typing import Any

CAST_TYPES = ("int", "bigint", "double", "string", "boolean", "date", "timestamp")
FORMATS = ("csv", "parquet", "json", "orc")
_TOKEN = re.compile(r"(?<![:\w]):([a-z_]\w*)")


def snake_case(name: str) -> str:
    words = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower()
    return re.sub(r"[^a-z0-9]+", "_", words).strip("_")


def standard_names(columns: Sequence[str], rename: Mapping[str, str]) -> list[str]:
    """New names in order: the mapping's, else snake case; two of one name are an error."""
    names = [rename.get(c) or snake_case(c) for c in columns]
    twice = sorted({n for n in names if names.count(n) > 1})
    if twice:
        raise ValueError(f"columns that would share a name: {twice}")
    return names


def literal(value: Any) -> str:
    """A value as SQL text; sequences as lists in brackets."""
    if isinstance(value, bool) or value is None:
        return str(value).lower() if value is not None else "null"
    if isinstance(value, (int, float)):
        return repr(value)
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return "(" + ", ".join(map(literal, value)) + ")"


def with_parameters(sql: str, parameters: Mapping[str, Any]) -> str:
    """Puts values in the place of ``:name`` tokens; braces and all else stay as they are."""
    missing = sorted({m[1] for m in _TOKEN.finditer(sql)} - set(parameters))
    if missing:
        raise ValueError(f"parameters without a value: {missing}")
    return _TOKEN.sub(lambda m: literal(parameters[m[1]]), sql)


@dataclass(frozen=True)
class DatasetSpec:
    """One dataset. rules: name to SQL condition, with ``:name`` tokens for parameters and ``:timezone``; a row passes where
    it is true. scope: SQL condition; rows for which it is false are out of scope. tie_break: what decides between valid rows
    of one key, in order; without it the rows' JSON text does. instants: name to SQL text of a time in any notation, wall
    clock of the timezone if it names none; derived columns and rules may use ``_<name>_utc`` and ``_<name>_status``."""

    name: str
    format: str
    source_path: str
    required: tuple[str, ...]
    key: tuple[str, ...]
    rename: Mapping[str, str] = field(default_factory=dict)
    casts: Mapping[str, str] = field(default_factory=dict)
    defaults: Mapping[str, Any] = field(default_factory=dict)
    instants: Mapping[str, str] = field(default_factory=dict)
    derived: Mapping[str, str] = field(default_factory=dict)
    rules: Mapping[str, str] = field(default_factory=dict)
    parameters: Mapping[str, Any] = field(default_factory=dict)
    timezone: str = "UTC"
    scope: str | None = None
    selected: tuple[str, ...] | None = None
    partition_by: tuple[str, ...] = ()
    tie_break: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        def need(good: bool, what: str) -> None:
            if not good:
                raise ValueError(f"{self.name or 'dataset'}: {what}")

        text = lambda x: isinstance(x, str) and bool(x.strip())
        need(text(self.name), "name must be a text")
        need(self.format in FORMATS, f"format must be one of {FORMATS}")
        need(text(self.source_path) and text(self.timezone), "source_path and timezone must be texts")
        for what in ("rename", "casts", "defaults", "instants", "derived", "rules", "parameters"):
            need(isinstance(getattr(self, what), Mapping), f"{what} must be a mapping")
        for what in ("required", "key", "partition_by", "selected", "tie_break"):
            value = getattr(self, what)
            if value is None and what in ("selected", "tie_break"):
                continue
            need(isinstance(value, (list, tuple)) and all(map(text, value)) and len(set(value)) == len(value), f"{what} must list different names")
            need(bool(value) or what == "partition_by", f"{what} must not be empty")
            object.__setattr__(self, what, tuple(value))
        known = set(standard_names(self.required, self.rename))
        need(set(self.casts) <= known, f"casts of columns that aren't required: {sorted(set(self.casts) - known)}")
        need(set(self.casts.values()) <= set(CAST_TYPES), f"cast types must be of {CAST_TYPES}")
        need(all(text(k) and text(v) for k, v in self.rules.items()), "rules must be named conditions")
        for sql in [*self.rules.values(), *self.instants.values(), *self.derived.values(), *([self.scope] if self.scope else [])]:
            self.sql(sql)

    def sql(self, text: str) -> str:
        return with_parameters(text, {**self.parameters, "timezone": self.timezone})

    @classmethod
    def of(cls, name: str, values: Mapping[str, Any]) -> DatasetSpec:
        if not isinstance(values, Mapping):
            raise ValueError(f"{name}: must be a mapping")
        unknown = set(values) - {f.name for f in fields(cls)}
        lacking = {"format", "source_path", "required", "key"} - set(values)
        if unknown or lacking:
            raise ValueError(f"{name}: unknown keys {sorted(unknown)}, missing keys {sorted(lacking)}")
        return cls(name=name, **values)


SESSION_KEYS = {"shuffle_partitions": int, "adaptive": bool, "coalesce": bool, "master": str, "app_name": str}


#: The parts that the integration needs, each a dataset's name unless the configuration says otherwise.
ROLES = {"trips": "taxi_trips", "zones": "taxi_zones", "weather": "weather", "air": "air_quality"}
LAYERS = ("bronze", "silver", "quarantine")


def _need(good: bool, what: str) -> None:
    if not good:
        raise ValueError(what)


def _text(value: Any) -> bool:
    return isinstance(value, str) and bool(value.strip())


@dataclass(frozen=True)
class Integration:
    """Which datasets play which part, and how the integrated table is partitioned."""

    roles: Mapping[str, str]
    partition_by: tuple[str, ...] = ()

    @classmethod
    def of(cls, values: Mapping[str, Any], datasets: Mapping[str, DatasetSpec]) -> Integration:
        _need(set(values) <= {*ROLES, "partition_by"}, f"integration: unknown keys {sorted(set(values) - {*ROLES, 'partition_by'})}")
        roles = {r: values.get(r, name) for r, name in ROLES.items()}
        _need(all(_text(n) and n in datasets for n in roles.values()), f"integration: datasets {sorted(roles.values(), key=str)} are needed")
        columns = values.get("partition_by", ())
        _need(isinstance(columns, (list, tuple)) and all(map(_text, columns)) and len(set(columns)) == len(columns), "integration.partition_by must list different names")
        return cls(roles, tuple(columns))


@dataclass(frozen=True)
class Benchmark:
    """Where the layouts of the trips are written for comparison, and how often each query is timed."""

    root: str
    iterations: int = 5

    @classmethod
    def of(cls, values: Mapping[str, Any]) -> Benchmark:
        _need(set(values) <= {"root", "iterations"}, f"benchmark: unknown keys {sorted(set(values) - {'root', 'iterations'})}")
        iterations = values.get("iterations", 5)
        _need(_text(values.get("root")), "benchmark.root must be a text")
        _need(type(iterations) is int and iterations >= 1, "benchmark.iterations must be a whole number of at least 1")
        return cls(values["root"], iterations)


@dataclass(frozen=True)
class Platform:
    """All of a run: its version, session settings, datasets and the tables' root; integration and benchmark where wanted."""

    version: str
    root: str
    datasets: Mapping[str, DatasetSpec]
    session: Mapping[str, Any] = field(default_factory=dict)
    integration: Integration | None = None
    benchmark: Benchmark | None = None

    @classmethod
    def of(cls, values: Mapping[str, Any]) -> Platform:
        _need(isinstance(values, Mapping), "the configuration must be a mapping")
        unknown = set(values) - {"platform", "session", "datasets", "integration", "benchmark"}
        _need(not unknown, f"unknown sections: {sorted(unknown)}")
        for what in ("platform", "session", "datasets"):
            _need(isinstance(values.get(what), Mapping), f"section {what} must be a mapping")
        for what in ("integration", "benchmark"):
            _need(what not in values or isinstance(values[what], Mapping), f"section {what} must be a mapping")
        version, root = (values["platform"].get(k) for k in ("version", "root"))
        _need(_text(version) and _text(root), "platform needs the texts version and root")
        for key, value in values["session"].items():
            kind = SESSION_KEYS.get(key)
            _need(kind is not None and type(value) is kind and value != "", f"session.{key} is unknown or of the wrong type")
        _need(values["session"].get("shuffle_partitions", 1) >= 1, "session.shuffle_partitions must be at least 1")
        datasets = {n: DatasetSpec.of(n, d) for n, d in values["datasets"].items()}
        _need(bool(datasets), "datasets must exist")
        integration = Integration.of(values["integration"], datasets) if "integration" in values else None
        benchmark = Benchmark.of(values["benchmark"]) if "benchmark" in values else None
        _need(benchmark is None or integration is not None, "the benchmark needs the integration's parts")
        made = cls(version, root, datasets, dict(values["session"]), integration, benchmark)
        made.outputs()
        return made

    def outputs(self) -> list[str]:
        """All places that a run writes to; two that are the same, however written, or of which one holds the other, are an error."""
        places = [f"{self.root}/{layer}/{n}" for n in self.datasets for layer in LAYERS] + [f"{self.root}/metadata/ingestions"]
        places += [f"{self.root}/silver/integrated"] if self.integration else []
        places += [self.benchmark.root] if self.benchmark else []
        plain = sorted(posixpath.normpath(p) for p in places)
        clash = [b for a in plain for b in plain if a is not b and (a == b or b.startswith(a + "/"))]
        _need(not clash, f"places that aren't apart: {sorted(set(clash))}")
        return plain

    @classmethod
    def load(cls, path: str) -> Platform:
        import yaml

        with open(path) as text:
            return cls.of(yaml.safe_load(text))
