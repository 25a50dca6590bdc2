"""Paths and small files through the file system Spark reads with (local, HDFS, object stores)."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """The full path, with scheme, that Spark reports for files under ``path``."""
    fs, p = _path(spark, path)
    return fs.makeQualified(p).toString()


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copy a file or folder."""
    (fs, a), (to, b) = _path(spark, source), _path(spark, target)
    to.mkdirs(b.getParent())
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, to, b, False, spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder; nothing there is no error."""
    fs, p = _path(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; empty where it does not exist."""
    fs, p = _path(spark, path)
    if not fs.exists(p):
        return []
    jvm = spark.sparkContext._jvm
    paths = jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(fs.listStatus(p))
    plain = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, len(paths))
    jvm.java.lang.System.arraycopy(paths, 0, plain, 0, len(paths))
    joined = jvm.org.apache.commons.lang3.StringUtils.join(plain, "\0")  # a few calls, however many names there are
    return sorted(x.rsplit("/", 1)[1] for x in joined.split("\0")) if joined else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file that must not exist yet; False if it does. Of several writers exactly one succeeds:
    local files are created exclusively, HDFS and stores that offer it do the same for a create without overwrite."""
    jvm = spark.sparkContext._jvm
    fs, p = _path(spark, path)
    fs.mkdirs(p.getParent())
    data = bytearray(text.encode())
    try:
        if fs.getUri().getScheme() == "file":
            option = jvm.java.nio.file.StandardOpenOption
            options = spark.sparkContext._gateway.new_array(jvm.java.nio.file.OpenOption, 2)
            options[0], options[1] = option.CREATE_NEW, option.WRITE
            jvm.java.nio.file.Files.write(jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri()), data, options)
            return True
        builder = fs.createFile(p).overwrite(False).opt("fs.s3a.create.conditional.overwrite", True)
        out = builder.build()
        out.write(data)
        out.close()
        return True
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
