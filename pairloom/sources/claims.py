"""Claims of a name that one run may write: exclusive markers, commit marks, take-over of broken claims.

    <folder>/_claims/<name>.claim    who writes the name, made by an exclusive create: of several runs one gets it
    <folder>/_claims/<name>.done     the commit mark, made once the table stands complete
    <folder>/<name>.<run>            the table while it is written, moved to its name after the commit mark

A run that ends without a commit leaves its claim. Another may take it over once it is old enough: the claim is first moved away
under a name of its own, which only one of several succeeds in, then claimed anew. What a run does after it lost its claim is thrown away,
as it can't commit. Creates and moves are atomic on local disks and on Hadoop file systems that promise an exclusive create.
"""

from __future__ import annotations

import os
import shutil
import time
import uuid
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


class ClaimLost(Exception):
    """Another run has taken the claim over."""


class _LocalFiles:
    def _place(self, path: str) -> str:
        return urlparse(path).path if path.startswith("file:") else path

    def create_new(self, path: str, text: str) -> bool:
        path = self._place(path)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        # The text is complete before the name exists: a link fails where the name is taken.
        own = f"{path}.{uuid.uuid4().hex}"
        with open(own, "w", encoding="utf-8") as file:
            file.write(text)
        try:
            os.link(own, path)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(own)

    def read(self, path: str) -> str | None:
        try:
            with open(self._place(path), encoding="utf-8") as file:
                return file.read()
        except FileNotFoundError:
            return None

    def age(self, path: str) -> float | None:
        try:
            return time.time() - os.stat(self._place(path)).st_mtime
        except FileNotFoundError:
            return None

    def move(self, source: str, target: str) -> bool:
        try:
            os.rename(self._place(source), self._place(target))
            return True
        except FileNotFoundError:
            return False

    def exists(self, path: str) -> bool:
        return os.path.exists(self._place(path))

    def delete(self, path: str) -> None:
        shutil.rmtree(self._place(path), ignore_errors=True)


class _HadoopFiles:
    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        place = self.jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.conf)

    def create_new(self, path: str, text: str) -> bool:
        place, files = self._at(path)
        files.mkdirs(place.getParent())
        try:
            out = files.create(place, False)
        except Exception as error:  # the class differs between file systems
            if files.exists(place):
                return False
            raise error
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def read(self, path: str) -> str | None:
        place, files = self._at(path)
        if not files.exists(place):
            return None
        source = files.open(place)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
        finally:
            source.close()

    def age(self, path: str) -> float | None:
        place, files = self._at(path)
        return time.time() - files.getFileStatus(place).getModificationTime() / 1000 if files.exists(place) else None

    def move(self, source: str, target: str) -> bool:
        place, files = self._at(source)
        try:
            return bool(files.exists(place) and files.rename(place, self._at(target)[0]))
        except Exception as error:  # the class differs between file systems
            if not files.exists(place):
                return False
            raise error

    def exists(self, path: str) -> bool:
        place, files = self._at(path)
        return files.exists(place)

    def delete(self, path: str) -> None:
        place, files = self._at(path)
        files.delete(place, True)


def _files(spark: SparkSession, path: str):
    scheme = urlparse(path).scheme or urlparse(spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")).scheme
    return _LocalFiles() if scheme in ("", "file") else _HadoopFiles(spark)


def _markers(path: str) -> tuple[str, str]:
    folder, name = path.rstrip("/").rsplit("/", 1)
    return f"{folder}/_claims/{name}.claim", f"{folder}/_claims/{name}.done"


class Claim:
    """The right of one run to write ``path``."""

    def __init__(self, spark: SparkSession, path: str, run: str):
        self.files, self.path, self.run = _files(spark, path), path.rstrip("/"), run
        self.marker, self.done = _markers(path)

    @property
    def attempt(self) -> str:
        """Where the run writes its table until it commits."""
        return f"{self.path}.{self.run}"

    def held(self) -> bool:
        return self.files.read(self.marker) == self.run

    def commit(self) -> None:
        """Set the commit mark and move the table to its name; an error, with the table thrown away, if the claim is lost."""
        if not self.held() or not self.files.create_new(self.done, self.run):
            self.files.delete(self.attempt)
            raise ClaimLost(self.path)
        finish(self.files, self.path)


def finish(files, path: str) -> None:
    """Move the committed table to its name, if that did not happen yet."""
    run = files.read(_markers(path)[1])
    if run is not None and not files.exists(path):
        files.move(f"{path}.{run}", path)


def committed(spark: SparkSession, path: str) -> bool:
    """Whether a run has committed ``path``; completes a commit that broke off before its last step."""
    files = _files(spark, path)
    if files.read(_markers(path)[1]) is None:
        return False
    finish(files, path.rstrip("/"))
    return True


def claim(spark: SparkSession, path: str, stale_after: float | None = None) -> Claim | None:
    """Claim ``path`` for this run; None if it is committed or claimed by another one.

    A claim without a commit that is at least ``stale_after`` seconds old is taken over.
    """
    made = Claim(spark, path, uuid.uuid4().hex)
    if committed(spark, path):
        return None
    if made.files.create_new(made.marker, made.run):
        return made
    if stale_after is None:
        return None
    other, age = made.files.read(made.marker), made.files.age(made.marker)
    if other is None or age is None or age < stale_after or committed(spark, path):
        return None
    moved = f"{made.marker}.{made.run}.broken"
    if not made.files.move(made.marker, moved):
        return None  # another run was faster
    if made.files.read(moved) != other:  # and has claimed the name since: its claim is put back
        made.files.create_new(made.marker, made.files.read(moved))
        return None
    made.files.delete(f"{made.path}.{other}")
    return made if made.files.create_new(made.marker, made.run) else None


def write_new_version(df: DataFrame, path: str, stale_after: float | None = None) -> bool:
    """Write a table once; False when it is there already, or being written, and stays as it is."""
    own = claim(df.sparkSession, path, stale_after)
    if own is None:
        return False
    df.write.parquet(own.attempt)
    own.commit()
    return True
