"""Settings as a tree with dotted paths, and vocabularies by domain."""

from __future__ import annotations

import json
from typing import Any

DEFAULTS: dict[str, Any] = {"search": {"hop_1_k": 50, "hop_2_k": 20, "final_k": 10}, "chunking": {"min_words": 15, "max_words": 300, "max_heading_level": 3}}
DOMAINS: dict[str, dict[str, list[str]]] = {
    "general": {"products": [], "metrics": [], "policy_tags": []},
    "finance": {"products": [], "metrics": ["revenue", "net income", "operating margin", "ebitda", "cash flow"], "policy_tags": ["guidance", "dividend", "buyback"]},
    "technology": {"products": ["platform", "cloud"], "metrics": ["uptime", "latency", "throughput"], "policy_tags": ["deprecation", "migration"]},
}


class Config:
    """Values by dotted path over defaults; ``load`` reads JSON and keeps the defaults where it can't."""

    def __init__(self, values: dict[str, Any] | None = None) -> None:
        self.values = json.loads(json.dumps(DEFAULTS))
        for key, value in (values or {}).items():
            self.update(key, value)

    @classmethod
    def load(cls, text: str) -> Config:
        try:
            return cls(json.loads(text))
        except ValueError:
            return cls()

    def get(self, path: str, default: Any = None) -> Any:
        node: Any = self.values
        for part in path.split("."):
            if not isinstance(node, dict) or part not in node:
                return default
            node = node[part]
        return node

    def update(self, path: str, value: Any) -> None:
        node = self.values
        *parents, last = path.split(".")
        for part in parents:
            node = node.setdefault(part, {})
        node[last] = value
