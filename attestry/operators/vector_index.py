"""A vector index as parts of a Parquet table under a log: guarded creation, upserts by id."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..commits import Log
from ..functions.text import point_id
from ..storage import delete


class IndexMismatch(RuntimeError):
    """The index was built in another embedding space."""


def points(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Points (id, chunk_id, vector, payload columns) of chunks (chunk_id, ...) and their vectors (chunk_id, vector)."""
    return chunks.join(vectors, "chunk_id").withColumn("id", point_id(F.concat(F.lit("chunk:"), "chunk_id")))


class VectorIndex:
    """An index in a folder: parts that upserts have left, in the order of a log.

    An upsert writes its own points only; of an id the point of the latest part counts. When the parts after the first
    hold a fifth of its points, or are many, all are written as one. A part is whole before the log names it, so readers see
    all of an upsert or nothing; of upserts at one time each gets a number of its own, and none is lost.
    """

    #: Share of later points, and number of later parts, from which on parts are put together.
    SHARE, PARTS = 0.2, 32

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.log = spark, folder.rstrip("/"), Log(spark, folder)

    @staticmethod
    def _mark(entries: list[dict]) -> dict:
        """The dimension and embedder that the entries agree on."""
        out: dict = {}
        for e in entries:
            out |= {k: e[k] for k in ("dimension", "embedder") if e.get(k) is not None and k not in out}
        return out

    def ensure(self, dimension: int, embedder: str) -> None:
        """Create the index, or check that it was built with this dimension and embedder. An index without an
        embedder's name takes this one; a mismatch of either is an error, since vectors of two spaces can't be
        compared even where their dimensions are equal."""
        while True:
            entries = self.log.entries()
            mark = self._mark(entries)
            if mark.get("dimension", dimension) != dimension:
                raise IndexMismatch(f"{self.folder} holds vectors of {mark['dimension']} dimensions, not {dimension}; use a new folder")
            if mark.get("embedder") not in (None, embedder):
                raise IndexMismatch(f"{self.folder} was built with embedder {mark['embedder']!r}, not {embedder!r}; use a new folder")
            if "dimension" in mark and "embedder" in mark:
                return
            if self.log.commit((entries[-1]["version"] if entries else 0) + 1, {"dimension": dimension, "embedder": embedder}):
                return

    def _parts(self, entries: list[dict]) -> DataFrame | None:
        """All points of the parts, with the number of their upsert."""
        parts = {e["part"]: e["version"] for e in entries if "part" in e}
        if not parts:
            return None
        rows = self.spark.read.option("basePath", self.folder).option("mergeSchema", "true").parquet(*[f"{self.folder}/upsert={p}" for p in parts])
        numbers = F.create_map(*[F.lit(x) for kv in parts.items() for x in kv])
        return rows.withColumn("_version", numbers[F.col("upsert")]).drop("upsert")

    def _live(self, entries: list[dict]) -> DataFrame | None:
        rows, parts = self._parts(entries), [e["version"] for e in entries if "part" in e]
        if rows is None or len(parts) == 1:
            return rows.drop("_version") if rows is not None else None
        newest = rows.filter(F.col("_version") > parts[0]).groupBy("id").agg(F.max("_version").alias("_newest"))
        return rows.join(newest, "id", "left").filter(F.col("_newest").isNull() | (F.col("_version") == F.col("_newest"))).drop("_version", "_newest")

    def read(self) -> DataFrame | None:
        """All points; None before the first upsert. Ids of later parts alone are looked up; the first part isn't sorted."""
        return self._live(self.log.entries())

    def upsert(self, new: DataFrame) -> int:
        """Put points (id, vector, ...) in: those with an id that is there replace what is there. Of repeated ids
        in ``new`` one counts, the least by a hash of the row. Vectors of another length are an error. Returns how many
        points were written."""
        mark = self._mark(self.log.entries())
        if "dimension" not in mark:
            raise IndexMismatch(f"{self.folder} is no index yet")
        checked = new.withColumn("vector", F.when(F.size("vector") == mark["dimension"], F.col("vector")).otherwise(F.raise_error(F.lit("a vector has another dimension than the index")).cast(new.schema["vector"].dataType)))
        others = [c for c in checked.columns if c != "id"]
        one = checked.groupBy("id").agg(F.min_by(F.struct(*others), F.xxhash64(*others)).alias("_r")).select("id", *[F.col(f"_r.`{c}`") for c in others])
        part, n = self._write(one)
        if n:
            self.log.append({"part": part, "rows": n})
            self.compact()
        return n

    def _write(self, rows: DataFrame) -> tuple[str, int]:
        part = f"p{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/upsert={part}")
        return part, self.spark.read.schema(rows.schema).parquet(f"{self.folder}/upsert={part}").count()

    def compact(self, force: bool = False) -> bool:
        """Write all points as one part if later parts are large or many (or at once). An upsert at the same time makes
        this one void; its points would be missing."""
        entries = self.log.entries()
        parts = [e for e in entries if "part" in e]
        later = sum(e["rows"] for e in parts[1:])
        if not later or not (force or later > self.SHARE * parts[0]["rows"] or len(parts) > self.PARTS):
            return False
        part, n = self._write(self._live(entries))
        done = self.log.commit(entries[-1]["version"] + 1, {"part": part, "rows": n, "base": True} | self._mark(entries))
        if not done:
            delete(self.spark, f"{self.folder}/upsert={part}")
        return done

    def vacuum(self, age: float = 86_400) -> list[str]:
        """Delete parts that the index no longer consists of and that are at least ``age`` seconds old."""
        return self.log.vacuum(lambda e: f"upsert={e['part']}" if "part" in e else None, "upsert=", age)
