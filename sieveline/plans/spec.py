"""Declarative specifications: a dict becomes one DataFrame plan.

    plan = compile_spec({"sources": [...], "filters": [...], "agent": {...}})
    out = plan.run({"logs": events}, scorer)
    out["actions"].write...
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.functions.text import explode_actions
from sieveline.operators import stateful
from sieveline.operators.routing import dispatch_actions, on_error, route_agents, unrouted
from sieveline.operators.rules import Filter, content_filter, filter_chain, priority_router, project_for_agent
from sieveline.operators.scoring import Scorer, offline_scorer, score_in_budget
from sieveline.session import checkpoint_root
from sieveline.sources.normalize import union_sources

# Known source kinds and the keys an agent must have.
SOURCE_KINDS = ("native/tshark", "native/log-tailer", "native/stdin", "mcp-bridge", "kafka", "google-docs")
AGENT_KEYS = ("runtime", "model", "system_prompt")
ON_ERROR = ("drop_and_alert", "buffer_limited", "passthrough")

_custom_filters: dict[str, Callable[[Mapping[str, Any]], Filter]] = {}


class SpecError(ValueError):
    """The specification is incomplete or contradictory."""


def register_filter(name: str, factory: Callable[[Mapping[str, Any]], Filter]) -> None:
    """Make a user filter available to specifications under a type name."""
    if name in _BUILDERS or name in _custom_filters:
        raise SpecError(f"filter type already registered: {name}")
    _custom_filters[name] = factory


def custom_filter(name: str | None) -> Callable[[Mapping[str, Any]], Filter] | None:
    """The factory of a registered user filter."""
    return _custom_filters.get(name)


def _windowed(c: Mapping[str, Any]) -> Filter:
    by = list(c.get("partition_by", ()))
    batch = stateful.batch_arrival(
        by,
        c.get("summary_prompt") or "Analyze the following batch of events",
        window_seconds=c.get("window_seconds", 60),
        max_batch_size=c.get("max_batch_size") or 50,
    )
    keys = ["batch_source" if k == "source_id" else k for k in by] + ["batch_no"]

    def run(df: DataFrame) -> DataFrame:
        return stateful.batch_events(batch(df), keys)

    run.stateful = True
    return run


# Defaults of the filter types.
_BUILDERS: dict[str, Callable[[Mapping[str, Any]], Filter]] = {
    "rate-limiter": lambda c: stateful.rate_limit_sliding(
        c.get("max_events_per_minute", 60), 60, c.get("partition_by", ())
    ),
    "content-filter": lambda c: content_filter(c.get("rules", ()), c.get("mode")),
    "dedup": lambda c: stateful.dedup_window(
        c.get("key_fields", ["payload"]), c.get("window_seconds", 30), c.get("partition_by", ()), c.get("missing_key", "share")
    ),
    "windowed-aggregation": _windowed,
    "adaptive-sampling": lambda c: stateful.adaptive_sample(
        base_rate=c.get("base_rate", 0.5),
        min_rate=c.get("min_rate", 0.1),
        max_rate=c.get("max_rate", 1.0),
        window_seconds=c.get("velocity_window_seconds", 60),
        high_velocity=c.get("high_velocity_threshold", 100),
        low_velocity=c.get("low_velocity_threshold", 10),
        partition_by=c.get("partition_by", ()),
    ),
    "priority-router": lambda c: priority_router(
        c.get("high_priority_threshold", 2), c.get("low_priority_threshold", 5), bool(c.get("drop_low_priority", False))
    ),
}


def build_filter(config: Mapping[str, Any]) -> Filter:
    kind = config.get("type")
    builder = _BUILDERS.get(kind) or _custom_filters.get(kind)
    if builder is None:
        raise SpecError(f"unknown filter type: {kind}")
    return builder(config)


def _check_agent(agent: Mapping[str, Any], label: str) -> None:
    for key in AGENT_KEYS:
        if not agent.get(key):
            raise SpecError(f"{label} needs {key}")
    if agent.get("sources") is not None and not isinstance(agent["sources"], (list, tuple)):
        raise SpecError(f"{label}.sources must be a list of source ids")


def normalize_spec(spec: Mapping[str, Any]) -> dict[str, Any]:
    """Check a specification and fill in what it leaves out."""
    sources = spec.get("sources")
    if not isinstance(sources, (list, tuple)) or not sources:
        raise SpecError("at least one source is needed")
    for s in sources:
        if s.get("adapter") is not None and s["adapter"] not in SOURCE_KINDS:
            raise SpecError(f"unknown source kind: {s['adapter']}")
    if spec.get("agent") and spec.get("agents"):
        raise SpecError("give either agent or agents, not both")
    if spec.get("agent"):
        _check_agent(spec["agent"], "agent")
        agents = [{"id": "default", **{k: v for k, v in spec["agent"].items() if k != "id" or v}}]
    elif spec.get("agents") is not None:
        if not isinstance(spec["agents"], (list, tuple)) or not spec["agents"]:
            raise SpecError("agents must be a non-empty list")
        agents, seen = [], set()
        for i, a in enumerate(spec["agents"]):
            _check_agent(a, f"agents[{i}]")
            name = a.get("id") or f"agent-{i}"
            if name in seen:
                raise SpecError(f"agent id used twice: {name}")
            seen.add(name)
            agents.append({**a, "id": name})
    else:
        raise SpecError("agent or agents is needed")
    filters = spec.get("filters")
    if filters is not None and not isinstance(filters, (list, tuple)):
        raise SpecError("filters must be a list")
    behavior = dict(spec.get("behavior") or {})
    policy = behavior.setdefault("on_llm_unreachable", "drop_and_alert")
    if policy not in ON_ERROR:
        raise SpecError(f"unknown failure policy: {policy}")
    return {**spec, "sources": list(sources), "agents": agents, "filters": list(filters or ()), "behavior": behavior}


@dataclass(frozen=True)
class CompiledSpec:
    spec: dict[str, Any]
    chain: Filter = field(repr=False)

    @property
    def agents(self) -> Sequence[Mapping[str, Any]]:
        return self.spec["agents"]

    @property
    def handlers(self) -> list[tuple[str, str]]:
        """(type, name) of every action of every agent; all agents share them."""
        return [(a["type"], a.get("name", a["type"])) for agent in self.agents for a in agent.get("actions") or ()]

    def filtered(self, sources: Mapping[str, DataFrame]) -> DataFrame:
        from sieveline.plans.live import open_batch

        spark = SparkSession.getActiveSession()
        opened = {s["id"]: open_batch(spark, s) for s in self.spec["sources"] if s["id"] not in sources and "path" in s}
        sources = {**opened, **sources}
        missing = [s["id"] for s in self.spec["sources"] if s["id"] not in sources]
        if missing:
            raise SpecError(f"no data for sources: {missing}")
        return union_sources([sources[s["id"]] for s in self.spec["sources"]]).transform(self.chain)

    def requests(self, events: DataFrame) -> DataFrame:
        """(event, agent) rows with prompts and budgets."""
        rows = route_agents(events, self.agents)
        system, budget = F.lit(None).cast("string"), F.lit(None).cast("long")
        for a in self.agents:
            mine = F.col("agent_id") == a["id"]
            system = F.when(mine, a["system_prompt"]).otherwise(system)
            cap = (a.get("token_budget") or {}).get("max_per_hour")
            budget = F.when(mine, F.lit(cap).cast("long")).otherwise(budget)
        return rows.withColumns({"system_prompt": system, "max_per_hour": budget, "prompt": project_for_agent()})

    def run(self, sources: Mapping[str, DataFrame], scorer: Scorer = offline_scorer) -> dict[str, DataFrame]:
        """All outputs of the plan.

        An agent whose budget of the hour is used up isn't called.  The replies
        are checkpointed: no output calls the scorer again.
        """
        events = self.filtered(sources)
        replies = score_in_budget(self.requests(events), scorer)
        checkpoint_root(replies.sparkSession)
        budgeted = replies.checkpoint()
        sent = budgeted.where("is_sent")
        out = {
            "events": events,
            "unrouted": unrouted(events, self.agents),
            "over_budget": budgeted.where("NOT is_sent"),
            **on_error(sent, self.spec["behavior"]["on_llm_unreachable"], self.handlers or [("none", "none")]),
        }
        if not self.handlers:
            out.pop("alerts", None)
        out["actions"] = dispatch_actions(explode_actions(out["passed"]), self.handlers)
        return out


def compile_spec(spec: Mapping[str, Any]) -> CompiledSpec:
    checked = normalize_spec(spec)
    return CompiledSpec(checked, filter_chain([build_filter(f) for f in checked["filters"]]))
