"""Files in folders that driver and executors share, by URI (see `qualified`); a path without a scheme is a local one, for one machine."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    files: list[str] = field(default_factory=list)


def _at(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def qualified(spark: SparkSession, path: str) -> str:
    """A path as a URI of the store that Spark's readers would look for it in, which tasks can't tell by themselves."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def create(path: str):
    store, place = _at(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    return store.open_output_stream(place)


def move(old: str, new: str) -> None:
    store, place = _at(old)
    store.move(place, _at(new)[1])


def move_if_there(old: str, new: str) -> None:
    """Moves a file, unless an earlier try has."""
    if exists(old):
        move(old, new)


def content(path: str) -> bytes:
    store, place = _at(path)
    with store.open_input_stream(place) as f:
        return f.read()


def opened(path: str):
    """A file to read from any place in it."""
    store, place = _at(path)
    return store.open_input_file(place)


def is_known(path: str) -> bool:
    """Whether the store of a URI is one that tasks can open by themselves."""
    try:
        _at(path)
    except (ValueError, NotImplementedError, OSError):
        return False
    return True


def exists(path: str) -> bool:
    store, place = _at(path)
    return store.get_file_info(place).type != fs.FileType.NotFound


def names(path: str) -> list[str]:
    """The names in a folder; none if there isn't one."""
    store, place = _at(path)
    return sorted(x.base_name for x in store.get_file_info(fs.FileSelector(place, allow_not_found=True)))


def delete_folder(path: str) -> None:
    store, place = _at(path)
    if store.get_file_info(place).type == fs.FileType.Directory:
        store.delete_dir(place)


def delete(path: str) -> None:
    if exists(path):
        store, place = _at(path)
        store.delete_file(place)
