"""Files of Python data sources: found and opened through the file system of their URI, and written so that a job shows all of them or none.

Tasks write below ``_temporary/<job>/<attempt>`` of the target.  When all tasks are done the driver moves what
their messages name into place, writes ``_SUCCESS`` and removes the job's folder, and with it what lost attempts left; a job
that fails only has its folder removed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from fnmatch import fnmatchcase

from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

STAGING, DONE = "_temporary", "_SUCCESS"


def system_of(uri: str):
    """The file system of ``uri`` and the path in it."""
    from pyarrow import fs

    if "://" in uri or uri.startswith("file:"):
        return fs.FileSystem.from_uri(uri)
    return fs.LocalFileSystem(), uri


def files_of(uri: str) -> list[tuple[str, int]]:
    """Path and size of the files below ``uri``, a file, a folder or a pattern; hidden ones and unfinished jobs' are left out."""
    from pyarrow import fs

    system, path = system_of(uri)
    wild = next((k for k, part in enumerate(path.split("/")) if any(c in part for c in "*?[")), None)
    top = path if wild is None else "/".join(path.split("/")[:wild])
    info = system.get_file_info(top)
    if info.type == fs.FileType.File:
        return [(top, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(uri)
    depth = path.count("/")
    out = []
    for x in system.get_file_info(fs.FileSelector(top, recursive=True)):
        inside = x.path[len(top.rstrip("/")) + 1 :].split("/")
        if x.type != fs.FileType.File or any(p.startswith(("_", ".")) for p in inside):
            continue
        if wild is not None and not (x.path.count("/") >= depth and fnmatchcase("/".join(x.path.split("/")[: depth + 1]), path)):
            continue
        out.append((x.path, x.size))
    return sorted(out)


@dataclass
class Written(WriterCommitMessage):
    """What an attempt wrote: its folder, files or folders in it to move, and counts."""

    attempt: str
    names: list[str]
    counts: dict[str, int] = field(default_factory=dict)


class StagedWriter(DataSourceArrowWriter):
    """Writes below the target's staging folder; ``put`` of a subclass writes the files of one task."""

    def __init__(self, target: str, overwrite: bool):
        self.target, self.overwrite, self.job = target.rstrip("/"), overwrite, uuid.uuid4().hex

    def put(self, batches, system, folder: str) -> tuple[list[str], dict[str, int]]:
        """Names, relative to ``folder``, of what is written there, and counts."""
        raise NotImplementedError

    def write(self, iterator):
        system, path = system_of(self.target)
        attempt = f"{path}/{STAGING}/{self.job}/{uuid.uuid4().hex}"
        system.create_dir(attempt, recursive=True)
        names, counts = self.put(iterator, system, attempt)
        return Written(attempt, names, counts)

    def commit(self, messages):
        from pyarrow import fs

        system, path = system_of(self.target)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(path)):
                if x.base_name != STAGING:
                    (system.delete_dir if x.type == fs.FileType.Directory else system.delete_file)(x.path)
        made: set[str] = set()
        for m in messages:
            for name in m.names if m is not None else []:
                parent = f"{path}/{name}".rpartition("/")[0]
                if parent not in made:
                    system.create_dir(parent, recursive=True)
                    made.add(parent)
                system.move(f"{m.attempt}/{name}", f"{path}/{name}")
        self._clear(system, path)
        with system.open_output_stream(f"{path}/{DONE}"):
            pass

    def abort(self, messages):
        system, path = system_of(self.target)
        self._clear(system, path)

    def _clear(self, system, path: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{path}/{STAGING}/{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{path}/{STAGING}/{self.job}")
        if system.get_file_info(f"{path}/{STAGING}").type != fs.FileType.NotFound and not system.get_file_info(fs.FileSelector(f"{path}/{STAGING}")):
            system.delete_dir(f"{path}/{STAGING}")
