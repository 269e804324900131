"""The batch protocol: query lines, ended by `F`; answers in order of arrival when a batch ends."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from ..engine import Engine, render


class BatchSession:
    """feed() takes a line and returns the answers that it completes: those of the batch at `F`, else none. close(), or the
    end of a with block, runs queries after the last `F` into rest.

    A batch runs longest first, by estimated cost, on a few threads; each thread's jobs go to a pool of their own, which
    share executors fairly if spark.scheduler.mode is FAIR. A query that fails raises at the end of its batch."""

    def __init__(self, engine: Engine, threads: int = 4):
        self.engine, self.threads = engine, threads
        self.pending: list[str] = []
        self.rest: list[str] = []

    def feed(self, line: str) -> list[str]:
        line = line.strip()
        if line == "F":
            return self.flush()
        if line:
            self.engine.spec(line)  # errors are raised at once
            self.pending.append(line)
        return []

    def order(self) -> list[int]:
        """Places of the pending queries, by cost, highest first."""
        costs = [self.engine.cost(q) for q in self.pending]
        return sorted(range(len(costs)), key=lambda i: costs[i], reverse=True)

    def flush(self) -> list[str]:
        queries, order = self.pending, self.order()
        self.pending = []
        sc = self.engine.catalog.spark.sparkContext
        pool = sc.getLocalProperty("spark.scheduler.pool")

        def run(i: int) -> str:
            sc.setLocalProperty("spark.scheduler.pool", f"query{i % self.threads}")
            try:
                return render(self.engine.query(queries[i]).first())
            finally:
                sc.setLocalProperty("spark.scheduler.pool", pool)

        with ThreadPoolExecutor(self.threads) as threads:
            answers = dict(zip(order, threads.map(run, order), strict=True))
        return [answers[i] for i in range(len(queries))]

    def close(self) -> list[str]:
        self.rest = self.flush() if self.pending else []
        return self.rest

    def __enter__(self) -> BatchSession:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.close()


def run_workload(engine: Engine, workload: str, results: str | None = None, threads: int = 4) -> list[str]:
    """Runs a file of batches; with a file of expected lines, raises at the first that differs."""
    answers = engine.batch(Path(workload).read_text().splitlines(), threads)
    if results is not None:
        for k, (got, want) in enumerate(zip(answers, Path(results).read_text().splitlines(), strict=True), 1):
            if got.split() != want.split():
                raise AssertionError(f"line {k}: got {got!r}, expected {want!r}")
    return answers
