"""A flow as data: sources, transforms, target. Read from YAML or built in Python, checked at once.

Every mistake that can be seen without data is raised here, before Spark reads anything.
"""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml

from millrace.functions.sqltext import split_sql
from millrace.functions.transforms import Transform, not_null, python_step, registered, sql_step
from millrace.operators.cdc import CdcConfig
from millrace.operators.scd2 import Scd2Config
from millrace.sinks import MERGE, check_target, mode_of, target_config, target_type
from millrace.sinks.files import SAVE_MODES
from millrace.sources import check_source, source_type

# The name of a flow that has none, and the two ways to stack several sources.
UNNAMED = "UnnamedPipeline"
BY_NAME, BY_POSITION = "by_name", "by_position"
TRANSFORM_TYPES = ("sql", "python")

_ENVIRONMENT = re.compile(r"\$\{(\w+)\}")
_SECRET = re.compile(r"password|secret|token", re.IGNORECASE)


def redacted(value: Any) -> Any:
    """A copy that is safe to print."""
    if isinstance(value, Mapping):
        return {k: "***" if _SECRET.search(str(k)) else redacted(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [redacted(v) for v in value]
    return value


def with_environment(value: Any) -> Any:
    """``${NAME}`` replaced by environment variables, wherever it occurs."""
    if isinstance(value, Mapping):
        return {k: with_environment(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [with_environment(v) for v in value]
    if not isinstance(value, str):
        return value

    def lookup(match: re.Match) -> str:
        if match.group(1) not in os.environ:
            raise ValueError(f"environment variable {match.group(1)} is not set")
        return os.environ[match.group(1)]

    return _ENVIRONMENT.sub(lookup, value)


@dataclass(frozen=True)
class SourceSpec:
    type: str
    config: Mapping[str, Any] = field(repr=False)
    cdc: CdcConfig
    name: str

    def __repr__(self) -> str:
        return f"SourceSpec({self.name}, {self.type}, {redacted(self.config)})"


@dataclass(frozen=True)
class TransformSpec:
    type: str
    config: Mapping[str, Any]

    def step(self) -> Transform:
        if self.type == "sql":
            return sql_step(self.config["query"])
        if not self.config.get("function"):
            return not_null
        return python_step(self.config["function"], self.config.get("args"))


@dataclass(frozen=True)
class TargetSpec:
    type: str
    config: Mapping[str, Any] = field(repr=False)
    scd2: Scd2Config | None

    @property
    def mode(self) -> str:
        return mode_of(self.config, f"{self.type} target", (*SAVE_MODES, MERGE))

    @property
    def partition_by(self) -> list[str]:
        columns = self.config.get("partition_by") or []
        return [columns] if isinstance(columns, str) else list(columns)

    def __repr__(self) -> str:
        return f"TargetSpec({self.type}, {redacted(self.config)})"


@dataclass(frozen=True)
class FlowSpec:
    name: str
    sources: tuple[SourceSpec, ...]
    transforms: tuple[TransformSpec, ...]
    target: TargetSpec
    combine: str = BY_NAME
    schedule: Mapping[str, Any] = field(default_factory=dict)   # kept, never acted on

    @property
    def change_log(self) -> CdcConfig | None:
        """Set when the sources are a change log that is to be applied to the target."""
        cdc = self.sources[0].cdc
        return cdc if cdc.enabled and cdc.mode == "binlog" and cdc.keys else None


# Targets whose files this library lays out itself.
FILE_TARGETS = ("s3", "files", "csv", "parquet")


def load_connections(source: str | os.PathLike | Mapping | None) -> dict[str, dict[str, Any]]:
    """``{type: {name: settings}}`` from a YAML file or a mapping; a missing file holds none."""
    if source is None:
        return {}
    if isinstance(source, Mapping):
        raw = source
    else:
        path = Path(source)
        raw = yaml.safe_load(path.read_text(encoding="utf-8")) if path.exists() else {}
    raw = raw or {}
    return dict(raw.get("connections", raw) or {})


def _connected(section: Mapping[str, Any], kind: str, connections: Mapping[str, Any]) -> dict[str, Any]:
    """The section's config with its named connection laid over it."""
    config = dict(section.get("config") or {})
    name = section.get("connection")
    if not name:
        return config
    family = str(config.get("db_type") or "mysql").lower() if kind == "jdbc" else kind
    known = connections.get(family) or {}
    if name not in known:
        raise ValueError(f"no connection {name!r} of type {family!r}")
    return {**config, **known[name]}


def load_spec(source: str | os.PathLike | Mapping[str, Any],
              connections: str | os.PathLike | Mapping | None = None) -> FlowSpec:
    """Check a specification and return it. ``source`` is a path, YAML text or a mapping."""
    return _build(_raw(source), load_connections(connections))


def _raw(source: str | os.PathLike | Mapping[str, Any]) -> Mapping[str, Any]:
    if isinstance(source, Mapping):
        return source
    text = str(source)
    if isinstance(source, str) and "\n" in source:
        raw = yaml.safe_load(source)
    else:
        path = Path(text)
        if not path.exists():
            raise FileNotFoundError(f"no flow specification at {text}")
        raw = yaml.safe_load(path.read_text(encoding="utf-8"))
    if not isinstance(raw, Mapping):
        raise ValueError("a flow specification must be a mapping")
    return raw


def _build(raw: Mapping[str, Any], connections: Mapping[str, Any]) -> FlowSpec:
    sections = raw.get("sources") or [raw.get("source") or {}]
    sources = tuple(_source(s, i, connections) for i, s in enumerate(sections))
    transforms = tuple(_transform(t) for t in raw.get("transformations") or [])
    target = _target(raw.get("target") or {}, connections)
    combine = str(raw.get("combine") or BY_NAME)
    if combine not in (BY_NAME, BY_POSITION):
        raise ValueError(f"combine must be {BY_NAME!r} or {BY_POSITION!r}, not {combine!r}")
    schedule = {k: raw[k] for k in ("scheduler", "schedule_cron", "dag_id") if k in raw}
    spec = FlowSpec(raw.get("name") or UNNAMED, sources, transforms, target, combine, schedule)
    _check_together(spec)
    return spec


def _source(section: Mapping[str, Any], index: int, connections: Mapping[str, Any]) -> SourceSpec:
    kind = source_type(section.get("type"))
    config = with_environment(_connected(section, kind, connections))
    cdc = CdcConfig.from_mapping(config.pop("cdc", None))
    check_source(kind, config)
    return SourceSpec(kind, config, cdc, str(section.get("name") or f"source{index}"))


def _transform(section: Mapping[str, Any]) -> TransformSpec:
    kind = str(section.get("type") or "").lower()
    config = dict(section.get("config") or {})
    if kind not in TRANSFORM_TYPES:
        raise ValueError(f"transformation type {section.get('type')!r} is not one of {TRANSFORM_TYPES}")
    if kind == "sql":
        if not config.get("query"):
            raise ValueError("a sql transformation needs a 'query'")
        if not split_sql(config["query"]):
            raise ValueError("the query of a sql transformation holds no statement")
    elif config.get("function"):
        registered(config["function"])
    return TransformSpec(kind, config)


def _target(section: Mapping[str, Any], connections: Mapping[str, Any]) -> TargetSpec:
    kind = target_type(section.get("type"))
    config = with_environment(_connected(section, kind, connections))
    scd2 = Scd2Config.from_mapping(config.pop("scd2", None))
    config = target_config(kind, config)
    check_target(kind, config)
    return TargetSpec(kind, config, scd2)


def _check_together(spec: FlowSpec) -> None:
    if len({s.name for s in spec.sources}) < len(spec.sources):
        raise ValueError("sources need different names")
    logs = [s.cdc.enabled and s.cdc.mode == "binlog" and bool(s.cdc.keys) for s in spec.sources]
    if any(logs) and not all(logs):
        raise ValueError("a change log cannot be stacked with other sources")
    if any(logs) and spec.target.scd2:
        raise ValueError("a change log is applied to plain rows, not to an scd2 target")
    if spec.target.mode == "append" and not spec.target.scd2 and not any(logs):
        for source in spec.sources:
            cdc = source.cdc
            if cdc.enabled and cdc.state and cdc.mode == "timestamp" and (cdc.inclusive or cdc.lookback):
                raise ValueError(f"{source.name}: an append target would get the rows at the cursor again with every run; "
                                 "set 'inclusive: false' without 'lookback', or merge")
    scd2, buckets = spec.target.scd2, spec.target.config.get("buckets")
    if scd2 and scd2.closes_absent and any(s.cdc.enabled for s in spec.sources):
        raise ValueError("'deletes: close' needs full sources; an increment lacks most keys")
    if scd2 and scd2.backdated and spec.target.type == "iceberg":
        raise ValueError("backdated loads rewrite versions of their keys, which the iceberg merge does not")
    if buckets is not None:
        if isinstance(buckets, bool) or not isinstance(buckets, int) or buckets < 1:
            raise ValueError(f"'buckets' must be a positive number, not {buckets!r}")
        if spec.target.type not in FILE_TARGETS or not (scd2 or spec.target.mode == MERGE or any(logs)):
            raise ValueError("'buckets' lays out file targets that are merged by key")
    if scd2 and spec.target.mode == MERGE:
        raise ValueError("an scd2 target merges by itself; leave out mode 'merge'")


class FlowBuilder:
    """Writes the same specification step by step, without YAML."""

    def __init__(self, name: str):
        self._raw: dict[str, Any] = {"name": name, "sources": [], "transformations": []}

    def source(self, type: str, connection: str | None = None, cdc: Mapping[str, Any] | None = None,
               name: str | None = None, **config: Any) -> FlowBuilder:
        if cdc:
            config["cdc"] = dict(cdc)
        return self._section("sources", type=type, connection=connection, name=name, config=config)

    def sql(self, query: str) -> FlowBuilder:
        return self._section("transformations", type="sql", config={"query": query})

    def python(self, function: str | None = None, **args: Any) -> FlowBuilder:
        config = {"function": function, "args": args} if function else {}
        return self._section("transformations", type="python", config=config)

    def target(self, type: str, connection: str | None = None, scd2: Mapping[str, Any] | None = None,
               **config: Any) -> FlowBuilder:
        if scd2:
            config["scd2"] = {"enabled": True, **scd2}
        section = {"type": type, "config": config}
        if connection:
            section["connection"] = connection
        self._raw["target"] = section
        return self

    def set(self, **values: Any) -> FlowBuilder:
        """Top-level settings: ``combine``, ``scheduler``, ``schedule_cron``."""
        self._raw.update(values)
        return self

    def _section(self, where: str, **section: Any) -> FlowBuilder:
        self._raw[where].append({k: v for k, v in section.items() if v is not None})
        return self

    def spec(self, connections: str | os.PathLike | Mapping | None = None) -> FlowSpec:
        return load_spec(self._raw, connections)

    def to_yaml(self) -> str:
        return yaml.safe_dump(self._raw, sort_keys=False, allow_unicode=True)


def flow(name: str = UNNAMED) -> FlowBuilder:
    return FlowBuilder(name)
