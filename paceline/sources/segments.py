"""Named user segments as versions of a table.

The members of the segments that are written together lie in one folder; a small table of versions says which folder is whose. A version
becomes visible by the row that is appended there after its members are committed, so a reader sees the old segment
or the new one, and a job that fails leaves the old ones. Names are data, never part of a path.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

VERSIONS = "segment_name string, version long, folder string, users long"


def check_export_names(names: Iterable[str]) -> list[str]:
    """Refuse a job that would write one segment twice."""
    listed = list(names)
    twice = sorted({n for n in listed if listed.count(n) > 1})
    if twice:
        raise ValueError(f"segments exported more than once in one job: {twice}")
    return listed


class SegmentStore:
    """Segments under one root. A write replaces the segment of its name, an empty result empties it."""

    def __init__(self, spark: SparkSession, root: str, user_id_type: str = "bigint"):
        self.spark = spark
        self.root = root.rstrip("/")
        self.user_id_type = user_id_type

    @staticmethod
    def _checked(name: str) -> str:
        text = str(name or "").strip()
        if not text:
            raise ValueError("a segment needs a name")
        return text

    def _versions(self) -> DataFrame:
        try:
            return self.spark.read.schema(VERSIONS).parquet(f"{self.root}/versions")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], VERSIONS)

    def _current(self) -> DataFrame:
        """The newest version of every segment; of two writers at once the one with the greater folder name wins."""
        newest = F.max(F.struct("version", "folder", "users")).alias("newest")
        return self._versions().groupBy("segment_name").agg(newest).select("segment_name", "newest.*")

    def write(self, name: str, users: DataFrame) -> int:
        """Replace segment ``name``; returns its size."""
        return self.write_all([(name, users)])[self._checked(name)]

    def write_all(self, segments: Iterable[tuple[str, DataFrame]]) -> dict[str, int]:
        """Replace several segments; duplicate names fail before the first job. Returns the sizes by name.

        One job writes the members of all of them and counts them on the way; their versions are then appended together, by a task
        that holds a row a segment. Versions are ordered by the clock of who writes.
        """
        listed = [(self._checked(name), users) for name, users in segments]
        names = check_export_names(name for name, _ in listed)
        if not listed:
            return {}
        folder, members = f"{self.root}/members/{uuid.uuid4().hex}", None
        for name, users in listed:
            own = users.select(F.lit(name).alias("segment_name"), F.col("user_id").cast(self.user_id_type))
            members = own if members is None else members.unionByName(own)
        seen = Observation()
        sizes = [F.count_if(F.col("segment_name") == name).alias(f"n{k}") for k, name in enumerate(names)]
        members.dropDuplicates().observe(seen, *sizes).write.parquet(folder)
        found = {name: seen.get.get(f"n{k}", 0) for k, name in enumerate(names)}
        rows = [(name, time.time_ns(), folder, found[name]) for name in names]
        self.spark.createDataFrame(rows, VERSIONS).coalesce(1).write.mode("append").parquet(f"{self.root}/versions")
        return found

    def _members(self, folders: Iterable[str]) -> DataFrame:
        schema, listed = f"segment_name string, user_id {self.user_id_type}", sorted(set(folders))
        return self.spark.read.schema(schema).parquet(*listed) if listed else self.spark.createDataFrame([], schema)

    def read(self, name: str) -> DataFrame:
        """Members of a segment; unknown or empty is an error. Runs a job over the versions."""
        text = str(name or "").strip()
        found = self._current().filter(F.col("segment_name") == text).first()
        if found is None or not found["users"]:
            raise ValueError(f"segment {name!r} is unknown or empty")
        return self._members([found["folder"]]).filter(F.col("segment_name") == text).select("user_id")

    def table(self) -> DataFrame:
        """All segments as (segment_name, user_id); empty if nothing was written. Runs a job over the versions.

        A folder may hold several segments, of which some have a newer version elsewhere.
        """
        current = [(row["segment_name"], row["folder"]) for row in self._current().filter("users > 0").collect()]
        if not current:
            return self._members([])
        written = F.element_at(F.split("_metadata.file_path", "/"), -2)
        newest = self.spark.createDataFrame([(name, folder.rsplit("/", 1)[1]) for name, folder in current], "segment_name string, written string")
        members = self._members(folder for _, folder in current).withColumn("written", written)
        return members.join(newest, ["segment_name", "written"], "left_semi").select("segment_name", "user_id")

    def sizes(self) -> DataFrame:
        """Users of every segment that has some, from the versions alone."""
        return self._current().filter("users > 0").select("segment_name", "users")
