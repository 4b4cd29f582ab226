"""Scopes and views.

    edge scope     := 'all' | 'topic:' label('+' label)*
    analytic scope := view [':' edge scope, if not all] [':core']
                    | view '@' [window ':'] partition scope
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Weight of each kind of edge in each view.
VIEWS: dict[str, dict[str, float]] = {
    "amp": {"repost": 1.0, "quote": 0.8},
    "reply": {"reply": 1.0},
    "all": {"repost": 1.0, "quote": 0.8, "reply": 0.4, "mention": 0.3},
}
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")


def topic_scope(labels: list[str]) -> str:
    """Edge scope of some labels: sorted, without repeats; ``all`` for none."""
    if any("+" in x for x in labels):
        raise ValueError("a label can't hold '+'")
    return "topic:" + "+".join(sorted(set(labels))) if labels else "all"


def labels_of(scope: str) -> list[str]:
    """Labels of an edge scope or of the topic part of an analytic one; none if there is no topic."""
    at = scope.find("topic:")
    if at not in (0, *[len(v) + 1 for v in VIEWS if scope.startswith(f"{v}:")]):
        return []
    return scope[at + 6 :].removesuffix(":core").split("+")


@dataclass(frozen=True)
class Scope:
    """An analytic scope, parsed."""

    view: str = "amp"
    edge_scope: str = "all"
    core: bool = False
    partition: str | None = None
    partition_window: str | None = None

    def __post_init__(self):
        if self.view not in VIEWS:
            raise ValueError(f"unknown view {self.view!r}")

    @classmethod
    def parse(cls, text: str) -> Scope:
        if "@" in text:
            view, _, rest = text.partition("@")
            window, part = split_partition(rest)
            return cls(view, partition=part, partition_window=window)
        view, _, rest = text.partition(":")
        core = rest == "core" or rest.endswith(":core")
        rest = "" if rest == "core" else rest.removesuffix(":core")
        return cls(view, rest or "all", core)

    def __str__(self) -> str:
        if self.partition is not None:
            return f"{self.view}@" + (f"{self.partition_window}:" if self.partition_window else "") + self.partition
        return self.view + (f":{self.edge_scope}" if self.edge_scope != "all" else "") + ":core" * self.core

    @property
    def labels(self) -> list[str]:
        return labels_of(self.edge_scope)


def split_partition(text: str) -> tuple[str | None, str]:
    """``[window:]scope``; a date alone is no scope."""
    if _DATE.fullmatch(text):
        raise ValueError("a partition needs a scope after its window")
    if _DATE.match(text) and text[10:11] == ":":
        return text[:10], text[11:]
    return None, text


def split_window(text: str) -> tuple[str, str]:
    """``window:scope``, parted at the first colon."""
    window, colon, scope = text.partition(":")
    if not colon or not _DATE.fullmatch(window) or not scope:
        raise ValueError(f"expected WINDOW:SCOPE, not {text!r}")
    return window, scope
