"""Files that tasks write to and read from a folder all executors share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import pyarrow.fs
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's place (not yet made) under ``spark.checkpoint.dir``, which the cluster names.

    Without that setting a session on one machine takes a folder there; on a cluster it is an error.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        top = f"file://{tempfile.mkdtemp(prefix='shared-')}"
    if "://" not in top and not top.startswith("file:"):
        top = f"file://{top}" if top.startswith("/") else top
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def _system(place: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(place)


def write_file(place: str, data: bytes) -> None:
    """Writes a file whole: under another name first, so that a lost or repeated task leaves no part of it."""
    system, path = _system(place)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, path)


def read_file(place: str, start: int = 0, size: int | None = None) -> bytes:
    system, path = _system(place)
    with system.open_input_file(path) as file:
        if start:
            file.seek(start)
        return file.read() if size is None else file.read(size)


def exists(place: str) -> bool:
    system, path = _system(place)
    return system.get_file_info(path).type != pyarrow.fs.FileType.NotFound


def opened(place: str):
    """A file to read from, with read, seek and close."""
    system, path = _system(place)
    return system.open_input_file(path)


@contextmanager
def stream_to(place: str):
    """A file to write to piece by piece; it gets its name when all is written."""
    system, path = _system(place)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with system.open_output_stream(draft) as out:
        yield out
    system.move(draft, path)


def delete_file(place: str) -> None:
    system, path = _system(place)
    if system.get_file_info(path).type != pyarrow.fs.FileType.NotFound:
        system.delete_file(path)


def delete_folder(place: str) -> None:
    system, path = _system(place)
    system.delete_dir(path)


def written(frame, name: str):
    """The frame, written once to the shared folder and read back: later steps do not compute it again."""
    place = shared_folder(frame.sparkSession, name)
    frame.write.parquet(place)
    return frame.sparkSession.read.schema(frame.schema).parquet(place)
