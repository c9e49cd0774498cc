"""The engine's tools on one store: search, discovery, maps, sections, sources, releases and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lantern.functions import versions
from lantern.operators import health, hybrid, navigation, scope
from lantern.sources import corpus
from lantern.sources.checkpoints import exists
from lantern.sources.store import Store, cache_key

CANARIES = "query_id long, query string, expected string"


class Tools:
    """``root`` has the store; ``root/navigation/<version>.json``, ``root/sources/<version>`` and ``root/releases.json`` what goes with it."""

    def __init__(self, spark: SparkSession, root: str, embedder: hybrid.Embedder, canaries: list[tuple[int, str, str]] | None = None):
        self.spark, self.root, self.embedder, self.canaries = spark, root.rstrip("/"), embedder, canaries or []
        self.store = Store(spark, f"{self.root}/indexes")
        self.checks: dict[str, health.HealthCheck] = {}

    def _vectors(self, queries: DataFrame) -> DataFrame:
        """Queries with vectors: cached ones, and new ones, which are written to the cache and read from there."""
        keyed = queries.withColumn("cache_key", F.concat(F.lit(f"{self.embedder.model}\n"), F.trim("query")))
        asked = keyed.join(self.store.cached(keyed), "cache_key", "left_anti").select("cache_key", "query").distinct()
        if not asked.isEmpty():
            self.store.cache(hybrid.embedded(asked, self.embedder, "query", queries=True).select("cache_key", "embedding"))
        return keyed.join(self.store.cached(keyed), "cache_key").drop("cache_key")

    def _ranked(self, family: str, queries: DataFrame, limit: int, condition) -> DataFrame:
        build = self.store.current(family)
        sections = self.store.table(family, "sections", build)
        return hybrid.search(queries, sections, self.store.index(family, build), self.store.cells(family, build), limit, condition)

    def _healthy(self, family: str) -> None:
        if not self.canaries:
            return
        canaries = self.spark.createDataFrame(self.canaries, CANARIES)
        run = lambda: health.failures(canaries, self._ranked(family, self._vectors(canaries.select("query_id", "query")), health.TOP, None))
        check = self.checks.setdefault(family, health.HealthCheck(run))
        meta = self.store.metadata(family)
        check.ensure((self.root, self.embedder.model, meta["model"], meta["source_version"], meta["chunk_count"], meta["built_at"]))

    def search_batch(self, version: str, queries: DataFrame, limit: int = 8, mode: str = "all", subsystem: str | None = None, group: str | None = None) -> DataFrame:
        """The best sections of each query (query_id, query)."""
        if not 1 <= limit <= 20:
            raise ValueError("limit must be from 1 to 20")
        family = versions.release(version).family
        self.store.check_model(family, self.embedder)
        self._healthy(family)
        condition = scope.condition(F.col("source_path"), mode, subsystem, group)
        return hybrid.compact(self._ranked(family, self._vectors(queries), limit, condition))

    def search(self, version: str, query: str, limit: int = 8, mode: str = "all", subsystem: str | None = None, group: str | None = None) -> DataFrame:
        if not query.strip():
            raise ValueError("the query is empty")
        asked = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        return self.search_batch(version, asked, limit, mode, subsystem, group).orderBy("rank")

    def _navigation(self, version: str) -> navigation.Navigation:
        source = self.store.metadata(versions.release(version).family)["source_version"]
        each = corpus.navigation_file(self.spark, f"{self.root}/navigation/{source}.json", source).select(F.posexplode("sections").alias("n", "s")).select("n", "s.*")
        groups = each.select(F.col("name").alias("subsystem"), F.explode("groups").alias("g")).select("subsystem", "g.*")
        return navigation.Navigation(each.drop("groups"), groups.drop("methods"), groups.select(F.col("id").alias("group_id"), F.posexplode("methods").alias("ord", "m")).select("group_id", "ord", "m.*"))

    def list_sections(self, version: str) -> DataFrame:
        return self._navigation(version).sections.orderBy("n").select("name", "description")

    def discover(self, version: str, query: str, limit: int = 5) -> DataFrame:
        if not query.strip():
            raise ValueError("the query is empty")
        asked = self.spark.createDataFrame([(0, query)], "query_id long, query string")
        return navigation.discover(asked, self._navigation(version), limit).orderBy("rank").select("name", "description")

    def section_map(self, version: str, subsystem: str) -> DataFrame:
        found = navigation.section_map(self._navigation(version), subsystem)
        if found.isEmpty():
            raise KeyError(subsystem)
        return found

    def demo_location(self, version: str) -> dict:
        """The demo release that fits a version, or why there is none."""
        full = versions.release(version).full
        found = corpus.matching_release(corpus.releases(self.spark, f"{self.root}/releases.json"), full).collect()
        if not found:
            return {"requested_version": full, "available": False, "reason": "no demo fits this version"}
        archive = found[0]["demo_archive"]
        if not exists(self.spark, f"{self.root}/{archive}"):
            return {"requested_version": full, "available": False, "reason": f"the demo's archive isn't there: {archive}"}
        return {"requested_version": full, "available": True, "demo_version": found[0]["demo_version"], "archive": archive, "sha256": corpus.file_digest(self.spark, f"{self.root}/{archive}")}

    def section(self, version: str, section_id: str) -> DataFrame:
        found = self.store.section(versions.release(version).family, section_id)
        if found.isEmpty():
            raise KeyError(section_id)
        return found.select("title", "text", *(F.when(F.col(c), F.lit(True)).alias(c) for c in ("has_recommendation", "has_warning")))

    def source_section(self, version: str, section_id: str, form: str = "markdown") -> dict:
        """The page that a section is from, as Markdown or HTML."""
        family = versions.release(version).family
        row = self.store.section(family, section_id).select("title", "source_path").first()
        if row is None:
            raise KeyError(section_id)
        release = self.store.metadata(family)["source_version"]
        page = self.spark.read.option("wholetext", True).text(f"{self.root}/sources/{release}/{row['source_path']}").first()
        return {"title": row["title"], "format": form.strip().lower(), "content": corpus.original(page["value"], form)}

    def detect_version(self, project: str, marker: str) -> Row:
        """The release that a project's files name; ``marker`` names the library in the older kind of file."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "{Configuration.distr,ParentConfigurations.bin}").load(project)
        # a path that is the file itself is found like one below a folder
        path = F.coalesce(corpus.relative_path(project), F.regexp_extract("_metadata.file_path", "([^/]*)$", 1))
        chosen = corpus.project_file(files.select(path.alias("path"), "content"))
        support = F.endswith("path", F.lit(".distr"))
        quoted = versions.quoted_before(F.col("text"), marker)
        read = chosen.select("path", corpus.decoded("content").alias("text"))
        reason = F.when(support, versions.support_failure(F.col("text"))).when(~F.contains("text", F.lit(marker)), F.lit("the marker isn't in the project file")).when(quoted.isNull(), F.lit("no version before the marker"))
        found = read.select(F.when(support, versions.from_support_xml(F.col("text"))).otherwise(quoted).alias("v"), reason.alias("reason")).first()
        if found is None:
            raise FileNotFoundError(f"no project file below {project}")
        if found["v"] is None:
            raise ValueError(f"{found['reason']}: {project}")
        return versions.release(found["v"])

    def list_versions(self) -> list[str]:
        return self.store.families()


__all__ = ["Tools", "cache_key"]
