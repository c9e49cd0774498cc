"""Index storage: builds of an index in folders of their own, one pointer to the current one, and a query cache."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lantern.functions import versions
from lantern.operators import cells, documents, hybrid, lexical
from lantern.sources import checkpoints

METADATA = "family string, source_version string, source_file string, source_file_count long, model string, chunk_count long, built_at string"
CACHE = "cache_key string, embedding array<float>, written timestamp"


class Store:
    """A folder with a folder for each family: ``<family>/<build>/<table>``, and ``<family>/current`` naming a build.

    A build is written whole before the pointer is flipped, and readers resolve
    the pointer once, so they never see half of an index.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # the pointer is a small file, written aside and renamed over the one before, so there always is one

    def _file(self, path: str):
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), found

    def _flip(self, family: str, build: str) -> None:
        fs, aside = self._file(f"{self.root}/{family}/.current-{build}")
        out = fs.create(aside, True)
        out.write(bytearray(build.encode()))
        out.close()
        _, current = self._file(f"{self.root}/{family}/current")
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(current.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
        context.rename(context.makeQualified(aside), context.makeQualified(current), options)

    def current(self, family: str) -> str:
        path = f"{self.root}/{family}/current"
        fs, pointer = self._file(path)
        if not fs.exists(pointer):
            raise FileNotFoundError(f"no index of {family}")
        return self.spark.read.option("wholetext", True).text(path).first()[0]

    def families(self) -> list[str]:
        fs, root = self._file(self.root)
        if not fs.exists(root):
            return []
        found = [s.getPath() for s in fs.listStatus(root) if s.isDirectory()]
        return sorted(p.getName() for p in found if fs.exists(self._file(f"{self.root}/{p.getName()}/current")[1]))

    def build(self, sections: DataFrame, embedder: hybrid.Embedder, version: str, source: str = "", files: int | None = None, product: str = "Docs") -> str:
        """Writes sections with vectors, postings, lengths and metadata, and makes them current; the build's name."""
        release = versions.release(version)
        name = uuid.uuid4().hex
        base = f"{self.root}/{release.family}/{name}"
        # texts are dealt out once; all that follows reads them where they are stored
        ready = hybrid.embedded(documents.with_embedding_text(sections.repartition("id"), product), embedder, "embedding_text").drop("embedding_text")
        ready.write.parquet(f"{base}/sections")
        stored = documents.assert_unique(self.spark.read.parquet(f"{base}/sections"))
        if bad := stored.filter("embedding IS NULL").select("id").first():
            raise ValueError(f"there are fewer vectors than sections: {bad['id']}")
        lexical.Index.build(stored, folder=base, dealt=True)
        found = cells.Cells.build(stored)
        found.packs.write.parquet(f"{base}/packs")
        checkpoints.drop(found.packs)
        count = stored.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source_path").alias("files")).first()
        if not count["n"]:
            raise ValueError("nothing to index")
        built = datetime.datetime.now(datetime.UTC).replace(microsecond=0).isoformat().replace("+00:00", "Z")
        row = (release.family, release.full, source, files if files is not None else count["files"], embedder.model, count["n"], built)
        self.spark.createDataFrame([row], METADATA).write.parquet(f"{base}/metadata")
        self._flip(release.family, name)
        return name

    def table(self, family: str, name: str, build: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{family}/{build or self.current(family)}/{name}")

    def index(self, family: str, build: str | None = None) -> lexical.Index:
        build = build or self.current(family)
        return lexical.Index.read({name: self.table(family, name, build) for name in lexical.Index.TABLES})

    def cells(self, family: str, build: str | None = None) -> cells.Cells:
        return cells.Cells.read(self.table(family, "packs", build))

    def metadata(self, family: str) -> dict:
        return self.table(family, "metadata").first().asDict()

    def section(self, family: str, section_id: str) -> DataFrame:
        """One section without its vector; the filter reaches the file scan."""
        return self.table(family, "sections").drop("embedding").filter(F.col("id") == section_id)

    def check_model(self, family: str, embedder: hybrid.Embedder) -> None:
        model = self.metadata(family)["model"]
        if model != embedder.model:
            raise ValueError(f"the index was built with {model}, not {embedder.model}")

    # query vectors: appended, the last one written counts

    def cached(self, keys: DataFrame) -> DataFrame:
        """cache_key and embedding of the keys that were written."""
        try:
            written = self.spark.read.schema(CACHE).parquet(f"{self.root}/.query_cache")
        except Exception as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            written = self.spark.createDataFrame([], CACHE)
        return written.join(keys.select("cache_key"), "cache_key", "left_semi").groupBy("cache_key").agg(F.max_by("embedding", "written").alias("embedding"))

    def cache(self, vectors: DataFrame) -> None:
        vectors.select("cache_key", F.col("embedding").cast("array<float>").alias("embedding"), F.current_timestamp().alias("written")).write.mode("append").parquet(f"{self.root}/.query_cache")


def cache_key(model: str, query: str) -> str:
    return f"{model}\n{query.strip()}"
