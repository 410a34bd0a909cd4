"""From documents to facts, for the sets that changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import corpus, facts, reading

#: Up to so many changed sets are named in the filter on the documents, so that a table partitioned by set is pruned; more are joined.
NAMED_SETS = 1000


def set_facts(documents: DataFrame, this_year: int, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """(set_id, field, value, source, corroboration, confidence) from all that the readers find in the documents of each set.

    The name is the one that most speaks for (see best_names), of other fields the best by rule and corroboration, or all values
    of those that have several. `keep` writes the candidates, which several steps read.
    """
    found = keep(reading.all_candidates(documents, this_year), "candidates")
    others = facts.reconcile_facts(found.where("field <> 'name'"))
    names = reading.best_names(found).withColumn("field", F.lit("name")).select(*others.columns)
    return others.unionByName(names)


class FactStore:
    """Facts of document sets in a folder: runs of facts, and for each run a manifest that says which run has a set's facts.

    A run adds rows and changes none. Its manifest is written last, so a run that dies leaves what was known before; facts
    that no manifest names are not seen.
    """

    def __init__(self, spark: SparkSession, path: str, keep: Callable[[DataFrame, str], DataFrame]):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _table(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # never written, or without a row
                return None
            raise

    def manifest(self) -> DataFrame | None:
        """(set_id, n_files, fingerprint, version, provider, facts_run) of the latest run; None before the first."""
        found = self._table("manifest")
        return found if found is None else found.where(F.col("run") == found.agg(F.max("run")).first()[0])

    def facts(self, manual: DataFrame | None = None) -> DataFrame:
        """The facts of the latest run; manual ones (set_id, field, value, source, corroboration, confidence) win their field."""
        manifest, found = self.manifest(), self._table("facts")
        if found is None:
            kind = manifest.schema["set_id"].dataType.simpleString()
            found = self.spark.createDataFrame([], f"set_id {kind}, field string, value string, source string, corroboration long, confidence string, run int")
        found = found.join(manifest.select("set_id", F.col("facts_run").alias("run")), ["set_id", "run"], "left_semi").drop("run")
        return found if manual is None else facts.manual_override(found, manual.select(*found.columns))

    def refresh(self, documents: DataFrame, version: int, provider: str, this_year: int = 2026) -> DataFrame:
        """Reads the sets of documents (set_id, file_name, text) that can't be reused; (set_id, verdict) of all sets.

        Fingerprints of all sets are compared with the manifest's; only documents of changed sets go through the readers. Sets without
        documents leave the manifest. Documents without a set are left out.
        """
        documents = documents.where(F.col("set_id").isNotNull())
        now = self.keep(corpus.set_fingerprint(documents).select("*", F.lit(version).alias("version"), F.lit(provider).alias("provider")), "fingerprints")
        old = self.manifest()
        known = old if old is not None else now.withColumns({"facts_run": F.lit(0).cast("long"), "run": F.lit(0).cast("long")}).limit(0)
        run = (known.agg(F.max("run")).first()[0] or 0) + 1
        verdicts = self.keep(corpus.change_verdict(now, known), "verdicts")
        changed = verdicts.where(~F.col("verdict").isin("reuse", "removed")).select("set_id")
        listed = [r.set_id for r in changed.limit(NAMED_SETS + 1).collect()]
        if listed:
            some = documents.where(F.col("set_id").isin(listed)) if len(listed) <= NAMED_SETS else documents.join(changed, "set_id", "left_semi")
            set_facts(some, this_year, self.keep).withColumn("run", F.lit(run).cast("long")).write.mode("append").partitionBy("run").parquet(f"{self.path}/facts")
        if listed or not verdicts.where("verdict = 'removed'").isEmpty():
            kept = known.select("set_id", "facts_run").join(verdicts.where("verdict = 'reuse'"), "set_id", "left_semi")
            rows = now.join(kept, "set_id", "left").withColumns({"facts_run": F.coalesce("facts_run", F.lit(run).cast("long")), "run": F.lit(run).cast("long")})
            rows.write.mode("append").partitionBy("run").parquet(f"{self.path}/manifest")
        return verdicts
