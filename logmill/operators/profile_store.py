"""The installed profiles as a versioned table: readers see one version, writers win or try again.

A change reads a version, makes the rows it alters (never the whole catalog) and commits them as the next
version. If another writer was faster the change is worked out again on what that one left, so a refusal
(an id that exists, an override of an unknown profile) is decided on the state it is committed to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from logmill.operators import registry
from logmill.sources.keyed_table import Conflict, KeyedTable

STATE = "id string, origin string, application string, body string, disabled boolean"
TRIES = 10


class ProfileStore:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.table = KeyedTable(spark, root, ["id"])

    def version(self) -> int | None:
        return max(self.table.steps(), default=None)

    def state(self, version: int | None = None) -> DataFrame:
        """``STATE`` of a version, or of the newest."""
        if version is None:
            version = self.version()
        if version is None:
            return self.spark.createDataFrame([], STATE)
        return self.table.rows(version).select(*self.spark.createDataFrame([], STATE).columns)

    def change(self, make: Callable[[DataFrame], DataFrame], tries: int = TRIES) -> int:
        """Commit the rows that ``make`` gives of the current state; after a conflict, of the new one."""
        for _ in range(tries):
            base = self.version()
            try:
                return self.table.put(make(self.state(base)), 0 if base is None else base + 1)
            except Conflict:
                continue
        raise Conflict(f"{tries} times another writer was first")

    def install(self, drafts: DataFrame, origin: str = "user") -> int:
        """Drafts (id, application, body) whose ids are not stored yet."""
        def made(state: DataFrame) -> DataFrame:
            new = registry.install(state, drafts).filter("installed").select("id")
            return drafts.join(new, "id").select(
                "id", F.lit(origin).alias("origin"), "application", "body", F.lit(False).alias("disabled")
            )

        return self.change(made)

    def override(self, overrides: DataFrame) -> int:
        """Stored profiles replaced by (id, application, body); unknown ids are left out."""
        def made(state: DataFrame) -> DataFrame:
            new = overrides.select("id", F.col("application").alias("named"), F.col("body").alias("new_body"))
            return state.join(new, "id").select(
                "id", F.lit("override").alias("origin"), F.coalesce("named", "id").alias("application"),
                F.col("new_body").alias("body"), "disabled",
            )

        return self.change(made)

    def disable(self, ids: DataFrame, disabled: bool = True) -> int:
        def made(state: DataFrame) -> DataFrame:
            return state.join(ids.select("id").distinct(), "id", "left_semi").withColumn("disabled", F.lit(disabled))

        return self.change(made)

    def restore_defaults(self, base: DataFrame) -> int:
        """Nothing disabled, overridden profiles as in ``base`` (id, origin, application, body)."""
        def made(state: DataFrame) -> DataFrame:
            was = base.select("id", F.struct("origin", "application", "body").alias("was"))
            back = (F.col("origin") == "override") & F.col("was").isNotNull()

            def value(name: str) -> F.Column:
                return F.when(back, F.col(f"was.{name}")).otherwise(F.col(name)).alias(name)

            changed = state.join(was, "id", "left").filter(F.col("disabled") | back)
            return changed.select("id", value("origin"), value("application"), value("body"), F.lit(False).alias("disabled"))

        return self.change(made)


__all__ = ["Conflict", "ProfileStore"]
