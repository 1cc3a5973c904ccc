"""Named queries over the given tables, each with its checking statement.

A query is a function of :class:`Given`; the checking SQL is assembled from named
common table expressions, so both sides start from the same bindings.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import prepare, store
from ..tables import BINDINGS, TABLES, bound, given

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
EXPRESSIONS: dict[str, str] = {}


class Given:
    """The given tables and the stages derived from them, each built once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = prepare(spark)
        self.sf_dir = sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in TABLES:
            return self.make(name, lambda: given(self.spark, self.sf_dir, name))
        if f"b_{name}" in BINDINGS:
            return self.make(name, lambda: bound(self.spark, self.sf_dir, f"b_{name}"))
        raise AttributeError(name)

    def make(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            self._made[name] = build()
        return self._made[name]

    def keep(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A stage several consumers read, written once to the shared folder."""
        return self.make(name, lambda: store(build(), name))


_CURRENT: dict[str, object] = {}


def workspace(spark: SparkSession, sf_dir: str) -> Given:
    """One workspace per application and folder; the last one used is kept."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if _CURRENT.get("key") != key:
        _CURRENT["key"], _CURRENT["given"] = key, Given(spark, sf_dir)
    return _CURRENT["given"]


def forget() -> None:
    _CURRENT.clear()


def query(key: str, oracle: str | None = None):
    def register(build: Callable[[Given], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = lambda spark, sf_dir: build(workspace(spark, sf_dir))
        if oracle:
            ORACLES[key] = oracle
        return build

    return register


def define(**expressions: str) -> None:
    twice = set(expressions) & set(EXPRESSIONS)
    if twice:
        raise ValueError(f"expressions defined twice: {sorted(twice)}")
    EXPRESSIONS.update(expressions)


def assemble(text: str) -> str:
    """A statement with every named expression it needs, in dependency order."""
    order: list[str] = []
    known = {**BINDINGS, **EXPRESSIONS}

    def visit(body: str, trail: tuple[str, ...]) -> None:
        for name in dict.fromkeys(re.findall(r"\b[bx]_\w+\b", body)):
            if name in known and name not in trail and name not in order:
                visit(known[name], (*trail, name))
                order.append(name)

    visit(text, ())
    if not order:
        return text
    parts = ", ".join(f"{name} AS ({known[name].strip()})" for name in order)
    return f"WITH RECURSIVE {parts}\n{text.strip()}"


def oracle_statements() -> dict[str, str]:
    return {key: assemble(text) for key, text in ORACLES.items()}
