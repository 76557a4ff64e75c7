"""Detection plugins: a registry of functions from posts to results, run side by side, and plugins as table functions of SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmlens.operators.graphs import ready


class Registry:
    """Named plugins; one that fails, while it is planned or while it runs, is counted and left out.

    A plugin is a function of posts that gives (id, score), and may come with another
    one of clusters that gives (cluster_id, score).  What a plugin gives is written to the
    checkpoint folder, so that a failure at run time is its own and not the union's.
    """

    def __init__(self):
        self.plugins: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.analyses: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self.versions: dict[str, str] = {}
        self.failures: dict[str, str] = {}
        self.runs: dict[str, int] = {}

    def register(self, name: str, plugin: Callable[[DataFrame], DataFrame], analyse: Callable[[DataFrame], DataFrame] | None = None, version: str = "1") -> None:
        if not name or not version or not callable(plugin) or not (analyse is None or callable(analyse)):
            raise ValueError("a plugin needs a name, a version and a function")
        self.plugins[name], self.versions[name] = plugin, version
        if analyse:
            self.analyses[name] = analyse

    def unregister(self, name: str) -> None:
        """Takes a plugin out; KeyError if there is none."""
        del self.plugins[name], self.versions[name]
        self.analyses.pop(name, None)
        self.failures.pop(name, None)

    def _union(self, functions: dict, rows: DataFrame, key: str) -> DataFrame:
        ready(rows.sparkSession)
        results = []
        for name, plugin in functions.items():
            self.runs[name] = self.runs.get(name, 0) + 1
            try:
                results.append(plugin(rows).select(F.lit(name).alias("algorithm"), key, F.col("score").cast("double").alias("score")).checkpoint())
                self.failures.pop(name, None)
            except Exception as error:
                self.failures[name] = str(error)
        if not results:
            raise ValueError("no plugin gave a result")
        return reduce(DataFrame.unionByName, results)

    def detect(self, posts: DataFrame) -> DataFrame:
        """(algorithm, id, score) of all plugins that ran."""
        return self._union(self.plugins, posts, "id")

    def analyse(self, clusters: DataFrame) -> DataFrame:
        """(algorithm, cluster_id, score) of all plugins that judge clusters."""
        return self._union(self.analyses, clusters, "cluster_id")

    def info(self, name: str) -> dict:
        return {"name": name, "version": self.versions[name], "runs": self.runs.get(name, 0), "status": "failed" if name in self.failures else "healthy", "analyses_clusters": name in self.analyses}

    def health(self) -> dict[str, int]:
        return {"healthy": len(self.plugins) - len(self.failures), "failed": len(self.failures)}


def table_function(spark, name: str, start: Callable, step: Callable, result: Callable, returns: str) -> None:
    """Make a plugin callable from SQL: ``SELECT * FROM name(TABLE(t) PARTITION BY key)``.

    ``start()`` gives a partition's state, ``step(state, batch)`` takes an Arrow batch of some of
    its rows and gives the state after them, and ``result(state)`` gives the partition's rows as an
    Arrow table of the columns ``returns``.  Rows come in batches and only the state is held, so a
    partition may be of any size; a plugin that raises fails the query that calls it.
    """

    class Plugin:
        def __init__(self):
            self.state = start()

        def eval(self, batch):
            self.state = step(self.state, batch)
            return iter(())

        def terminate(self):
            yield result(self.state)

    spark.udtf.register(name, F.arrow_udtf(Plugin, returnType=returns))
