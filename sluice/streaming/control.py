"""Running routes beside each other: scheduler pools for domains, and reloading changed routes."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from xml.sax.saxutils import quoteattr

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from sluice.plans import config
from sluice.streaming.runner import swap


def allocations(slots: dict[str, int]) -> str:
    """A fair scheduler's allocation file: a pool for each domain, whose slots are its share and its weight. Spark reads
    it from spark.scheduler.allocation.file with spark.scheduler.mode=FAIR."""
    if bad := [d for d, n in slots.items() if n < 1]:
        raise ValueError(f"domains need a slot at least: {bad}")
    pools = "".join(f"<pool name={quoteattr(d)}><schedulingMode>FAIR</schedulingMode><weight>{n}</weight><minShare>{n}</minShare></pool>" for d, n in sorted(slots.items()))
    return f'<?xml version="1.0"?><allocations>{pools}</allocations>'


@contextmanager
def pool(spark: SparkSession, domain: str):
    """Jobs and streams that are started within belong to the domain's pool."""
    before = spark.sparkContext.getLocalProperty("spark.scheduler.pool")
    spark.sparkContext.setLocalProperty("spark.scheduler.pool", domain)
    try:
        yield
    finally:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", before)


class Reloader:
    """Keeps routes' queries in step with a configuration file. ``start(name, route)`` starts a route's query;
    ``refresh`` ends and starts what changed its version, after the batch that runs, from the same checkpoint. A file
    that doesn't load leaves everything as it is."""

    def __init__(self, path: str, start: Callable[[str, dict], StreamingQuery], drain_seconds: int = 30):
        self.path, self.start, self.drain = path, start, drain_seconds
        self.running: dict[str, tuple[str, StreamingQuery]] = {}

    def refresh(self) -> dict[str, str]:
        """What was done, by route: started, reloaded or stopped."""
        routes = config.load(self.path)["routes"]
        done = {}
        for name in sorted(set(self.running) - set(routes)):
            _, query = self.running.pop(name)
            query.stop()
            query.awaitTermination(self.drain)
            done[name] = "stopped"
        for name, route in routes.items():
            version, query = self.running.get(name, (None, None))
            if version == route["route_version"]:
                continue
            again = lambda name=name, route=route: self.start(name, route)
            self.running[name] = (route["route_version"], again() if query is None else swap(query, again, self.drain))
            done[name] = "started" if query is None else "reloaded"
        return done
