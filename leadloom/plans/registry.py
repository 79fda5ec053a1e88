"""Registry of queries and of the SQL each is checked with."""

import re

from leadloom.plans.views import BASE, VIEWS

QUERIES = {}
ORACLES = {}
CTES = {}


def query(name: str, oracle: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``oracle`` may use ``{cte}`` references."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


_REF = re.compile(r"\{(\w+)\}")


def _refs(sql: str) -> list[str]:
    return [r for r in dict.fromkeys(_REF.findall(sql)) if r in VIEWS or r in CTES or r in BASE]


def render(sql: str) -> str:
    """Plain SQL with every referenced view and common table expression in WITH."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in BASE or name in ordered:
            return
        for ref in _refs(VIEWS.get(name) or CTES[name]):
            visit(ref)
        ordered.append(name)

    def plain(text: str) -> str:
        for ref in _refs(text):
            text = text.replace("{" + ref + "}", ref)
        return text

    for ref in _refs(sql):
        visit(ref)
    parts = [f"{name} AS ({plain(VIEWS.get(name) or CTES[name])})" for name in ordered]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + plain(sql)
