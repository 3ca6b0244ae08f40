"""Single files and folders on any file system that Spark reads: local paths, hdfs, s3a."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import SparkSession


def located(place: str | Path) -> Path | str:
    """A local place as an absolute Path, one with a scheme (hdfs://, s3a://) as it is."""
    text = str(place)
    return text.rstrip("/") if "://" in text else Path(text).expanduser().resolve()


def join(folder: Path | str, name: str) -> Path | str:
    return f"{folder}/{name}" if isinstance(folder, str) else folder / name


def name_of(place: Path | str) -> str:
    return str(place).rstrip("/").rpartition("/")[2]


def _open(place: Path | str) -> tuple[Any, Any]:
    """Hadoop's file system and path of a place; local ones without checksum files."""
    spark = SparkSession.active()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place.as_uri() if isinstance(place, Path) else place)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return (fs.getRawFileSystem() if fs.getScheme() == "file" else fs), path


def exists(place: Path | str) -> bool:
    if isinstance(place, Path):
        return place.exists()
    fs, path = _open(place)
    return fs.exists(path)


def make_folder(place: Path | str) -> None:
    """Fails if it is there."""
    if exists(place):
        raise FileExistsError(str(place))
    fs, path = _open(place)
    fs.mkdirs(path)


def write_bytes(place: Path | str, data: bytes) -> None:
    fs, path = _open(place)
    out = fs.create(path, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_bytes(place: Path | str) -> bytes:
    if isinstance(place, Path):
        return place.read_bytes()
    fs, path = _open(place)
    size = fs.getFileStatus(path).getLen()
    stream = fs.open(path)
    try:
        return bytes(stream.readNBytes(size))
    finally:
        stream.close()


def names_in(folder: Path | str) -> list[str]:
    fs, path = _open(folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(path))


def rename(source: Path | str, target: Path | str) -> None:
    """Fails if the target is there."""
    if exists(target):
        raise FileExistsError(str(target))
    fs, path = _open(source)
    if not fs.rename(path, _open(target)[1]):
        raise OSError(f"{source} can't be renamed to {target}")


def delete(place: Path | str) -> None:
    fs, path = _open(place)
    fs.delete(path, True)


def sizes_in(folder: Path | str) -> dict[str, int]:
    """Bytes of all that is in a folder, by name; of folders in it the sum."""
    fs, path = _open(folder)
    return {x.getPath().getName(): fs.getContentSummary(x.getPath()).getLength() for x in fs.listStatus(path)}
