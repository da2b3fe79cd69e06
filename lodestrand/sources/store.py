"""Files of binary formats in any store that Arrow opens, and sinks whose files appear when a job has succeeded."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql.datasource import WriterCommitMessage


def place(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def listed(path: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, bytes) of the file, or of a folder's files with one of the suffixes, in order of names; hidden ones are passed over."""
    system, at = place(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(at)) if f.base_name.lower().endswith(suffixes) and f.base_name[0] not in "._"]
    return [(f.path, f.size) for f in sorted(found, key=lambda f: f.path)]


@dataclass
class Written(WriterCommitMessage):
    """The files that a task wrote, by their names in the job's own folder."""

    names: tuple[str, ...]
    rows: int = 0


class Job:
    """A job's output: tasks write into a folder of the job, whose files move to the target when all tasks have succeeded.

    Attempts have names of their own, so a task that is run twice leaves one attempt's files; a job that fails leaves none.
    """

    def __init__(self, path: str, overwrite: bool, suffix: str):
        self.path, self.overwrite, self.suffix, self.id = path.rstrip("/"), overwrite, suffix, uuid.uuid4().hex[:12]
        place(path)[0].create_dir(self.folder, recursive=True)  # here, not in tasks: one that outlives a failed job must not bring it back

    @property
    def folder(self) -> str:
        return f"{place(self.path)[1]}/_job-{self.id}"

    def open(self, name: str):
        system, _ = place(self.path)
        return system.open_output_stream(f"{self.folder}/{name}")

    def commit(self, messages: list[Written | None]) -> None:
        system, at = place(self.path)
        if self.overwrite:
            for old, _ in listed(self.path, (self.suffix,)) if system.get_file_info(at).type == fs.FileType.Directory else ():
                system.delete_file(old)
        for m in messages:
            for name in m.names if m else ():
                system.move(f"{self.folder}/{name}", f"{at}/{name}")
        self.clear()

    def clear(self) -> None:
        system, _ = place(self.path)
        if system.get_file_info(self.folder).type == fs.FileType.Directory:
            system.delete_dir(self.folder)
