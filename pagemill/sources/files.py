"""Small files next to the data: what exists, whole texts, and texts published once."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str) -> tuple:
    """The file system of a path and its Hadoop path."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists in whatever file system the path names."""
    files, place = _open(spark, path)
    return files.exists(place)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none if there is no such folder."""
    files, place = _open(spark, path)
    if not files.exists(place) or not files.getFileStatus(place).isDirectory():
        return []
    return [entry.getPath().getName() for entry in files.listStatus(place)]


def read_text(spark: SparkSession, path: str) -> str:
    files, place = _open(spark, path)
    stream = files.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Make ``text`` the file at ``path`` unless there is one: of several writers at once, one gets True.

    The file appears whole. It is written under another name first; a local file is
    then linked and any other renamed, neither of which replaces a file on HDFS or POSIX.
    """
    files, place = _open(spark, path)
    files.mkdirs(place.getParent())
    _, draft = _open(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    stream = files.create(draft, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if files.getUri().getScheme() != "file":
        done = not files.exists(place) and files.rename(draft, place)
    else:
        disk = spark._jvm.java.nio.file
        local = lambda p: disk.Paths.get(p.toUri().getPath(), spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 0))
        try:
            disk.Files.createLink(local(place), local(draft))
            done = True
        except Exception as error:  # Py4J wraps the Java exception
            if "FileAlreadyExistsException" not in str(error):
                raise
            done = False
    files.delete(draft, False)
    return done


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder and what is in it, if it is there."""
    files, place = _open(spark, path)
    if files.exists(place) and not files.delete(place, True):
        raise OSError(f"{path} could not be deleted")
