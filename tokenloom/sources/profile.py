"""What the engine needs to know about one agent's logs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from tokenloom.operators import transcript
from tokenloom.operators.turns import assign_graph_turns, assign_linear_turns, graph_turns, linear_turns
from tokenloom.schema import AGENT_GRAPH, AGENT_LINEAR, RATIO_CODE, RATIO_LINEAR_AGENT
from tokenloom.sources import graph_agent, inventory, linear_agent


@dataclass(frozen=True)
class AgentProfile:
    """Parser, inventory, turn rule and sizing of one agent.

    ``membership`` says how a prompt is rebuilt: ``chain`` walks parents,
    ``linear`` replays in order.
    """

    agent: str
    membership: str
    ratio: float
    normalise: Callable[..., DataFrame]
    inventory: Callable[[DataFrame], DataFrame]
    assign_turns: Callable[[DataFrame], DataFrame]
    turns: Callable[[DataFrame], DataFrame]
    text: Callable[[Column], Column]


PROFILES = {
    AGENT_GRAPH: AgentProfile(
        AGENT_GRAPH,
        "chain",
        RATIO_CODE,
        graph_agent.normalise,
        inventory.graph_inventory,
        assign_graph_turns,
        graph_turns,
        transcript.graph_text,
    ),
    AGENT_LINEAR: AgentProfile(
        AGENT_LINEAR,
        "linear",
        RATIO_LINEAR_AGENT,
        linear_agent.normalise,
        inventory.linear_inventory,
        assign_linear_turns,
        linear_turns,
        transcript.linear_text,
    ),
}

ALIASES = {"claude": AGENT_GRAPH, "cc": AGENT_GRAPH, "openai-codex": AGENT_LINEAR}


def profile(name: str) -> AgentProfile:
    """The profile of an agent name, in any of its spellings."""
    key = name.strip().lower().replace("_", "-")
    key = ALIASES.get(key, key)
    if key not in PROFILES:
        raise ValueError(f"unknown agent '{name}'; use {' or '.join(PROFILES)}")
    return PROFILES[key]
