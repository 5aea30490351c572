"""The engine: query texts in, rows out."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession

from .lang.ast import Query
from .lang.parser import parse
from .plans.compile import Sources, compiled, keep_within
from .plans.nodes import Deadline, Node, find, tree
from .plans.planner import Settings, plan
from .sources.embedding import Embedder, NoEmbedder


class QueryTimeout(TimeoutError):
    pass


@dataclass
class Result:
    rows: list[Row]
    timings_ms: dict[str, float]
    partial: bool = False

    @property
    def total(self) -> int:
        return len(self.rows)


@dataclass
class Engine:
    spark: SparkSession
    sources: Sources
    settings: Settings = field(default_factory=Settings)
    embedder: Embedder = field(default_factory=NoEmbedder)
    footprints: DataFrame | None = None  # user_id, footprint
    timeout_s: float = 30.0

    def vector_of(self, query: Query) -> Sequence[float]:
        return query.source if not isinstance(query.source, str) else self.embedder.embed(query.source)

    def footprint_of(self, user: object) -> Sequence[float] | None:
        if user is None or self.footprints is None:
            return None
        row = self.footprints.where(self.footprints["user_id"] == user).select("footprint").first()
        return row and row[0]

    def plan(self, text: str) -> Node:
        return plan(parse(text), self.settings, self.sources.extra)

    def explain(self, text: str) -> str:
        """The logical plan, then Spark's."""
        q = parse(text)
        node = plan(q, self.settings, self.sources.extra)
        df = compiled(node, self.sources, self.vector_of(q))
        return tree(node) + "\n" + df._jdf.queryExecution().toString()

    def frame(self, text: str, user: object = None) -> DataFrame:
        """The result as a lazy DataFrame: no deadline, no timeout."""
        q = parse(text)
        footprint = self.footprint_of(user)
        return compiled(plan(q, self.settings, self.sources.extra), self.sources, self.vector_of(q), footprint, semantic=q.kind == "SEMANTIC" and footprint is not None)

    def stream(self, text: str, user: object = None) -> Iterator[Row]:
        """The rows of frame(), fetched partition by partition."""
        yield from self.frame(text, user).toLocalIterator()

    def find(self, text: str, user: object = None) -> Result:
        """Run a query under its deadline and the engine's timeout; Spark jobs that overrun the timeout are cancelled by their tag."""
        t0 = time.perf_counter()
        q = parse(text)
        t1 = time.perf_counter()
        node = plan(q, self.settings, self.sources.extra)
        t2 = time.perf_counter()
        vector = self.vector_of(q)
        t3 = time.perf_counter()
        footprint = self.footprint_of(user)
        sc, tag, late, done = self.spark.sparkContext, f"find-{uuid.uuid4().hex}", threading.Event(), threading.Event()

        def watch() -> None:
            if not done.wait(self.timeout_s):
                late.set()
                while not done.wait(0.1):  # a job may begin after the time is over
                    sc.cancelJobsWithTag(tag)

        threading.Thread(target=watch, daemon=True).start()
        sc.addJobTag(tag)
        try:
            rows = compiled(node, self.sources, vector, footprint, semantic=q.kind == "SEMANTIC" and footprint is not None).collect()
        except Exception as e:
            if not late.is_set():
                raise
            raise QueryTimeout(f"query timed out after {self.timeout_s:g} s") from e
        finally:
            done.set()
            sc.removeJobTag(tag)
        if late.is_set():
            raise QueryTimeout(f"query timed out after {self.timeout_s:g} s")
        t4 = time.perf_counter()
        ms = {"parse": t1 - t0, "plan": t2 - t1, "embed": t3 - t2, "search": t4 - t3, "total": t4 - t0}
        ms = {k: 1000 * v for k, v in ms.items()}
        deadline = find(node, Deadline)
        kept = keep_within(len(rows), deadline.millis, ms["search"]) if deadline else len(rows)
        return Result(rows[:kept], ms, kept < len(rows))
