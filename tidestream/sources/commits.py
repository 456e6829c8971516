"""Commits of files that tasks have written: all of a job's files appear in a folder, or none, and a job that is run again adds nothing.

Tasks write into a folder of the job that readers skip. The commit is one file, the manifest, which names what the tasks that were taken have written;
until it is there, nothing has happened. Then the files are moved under their names, which may be broken off and taken up again any number of times, as what
has been moved isn't there any more. A manifest stays under the job's key (a batch of a stream) so that a second run of it is told from a first; a job without a key
takes its manifest away when it is done.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor

from tidestream.sources import shared

#: Files moved at a time, and manifests of a stream's last batches that are kept.
MOVERS, KEPT = 32, 100
_FOLDER = "_manifests"


def staging(path: str, stream: str | None = None) -> str:
    """A new folder for a job's files; of a stream always the same, as its tasks and its commits don't know of each other, and one batch runs at a time."""
    return f"{path}/_staged-{stream or uuid.uuid4().hex}"


def _manifest(path: str, key: str) -> str:
    return f"{path}/{_FOLDER}/{key}.json"


def _put(path: str, key: str, content: dict) -> None:
    """Under another name first, so that a manifest is whole or isn't there."""
    draft = f"{path}/{_FOLDER}/.{key}-{uuid.uuid4().hex}"
    with shared.create(draft) as out:
        out.write(json.dumps(content).encode())
    shared.move(draft, _manifest(path, key))


def commit(path: str, staged: str, files: list[str], key: str | None = None) -> bool:
    """Makes files of staged appear in path; whether they do. They don't if the key was committed before: then that commit is finished, if need be, and
    staged goes."""
    name = key or uuid.uuid4().hex
    if key and shared.exists(_manifest(path, key)):
        finish(path, key)
        shared.delete_folder(staged)
        return False
    _put(path, name, {"staged": staged, "files": sorted(files)})
    finish(path, name)
    if not key:
        _forget(path, name)
    return True


def finish(path: str, key: str) -> None:
    """Moves what a manifest names and is not moved yet."""
    content = json.loads(shared.content(_manifest(path, key)))
    if not content["staged"]:
        return
    with ThreadPoolExecutor(MOVERS) as pool:
        list(pool.map(lambda f: shared.move_if_there(f"{content['staged']}/{f}", f"{path}/{f.rpartition('/')[2]}"), content["files"]))
    shared.delete_folder(content["staged"])
    _put(path, key, {"staged": None, "files": []})


def recover(path: str) -> list[str]:
    """Finishes commits that were broken off; their keys. A writer does so before it writes."""
    keys = [n.removesuffix(".json") for n in shared.names(f"{path}/{_FOLDER}") if n.endswith(".json")]
    open_ = [k for k in keys if json.loads(shared.content(_manifest(path, k)))["staged"]]
    for key in open_:
        finish(path, key)
    return open_


def prune(path: str, stream: str, batch: int) -> None:
    """Drops the manifest of a stream's batch that is too old to be run again."""
    shared.delete(_manifest(path, f"{stream}-{batch - KEPT}"))


def _forget(path: str, key: str) -> None:
    shared.delete(_manifest(path, key))
    if not shared.names(f"{path}/{_FOLDER}"):
        shared.delete_folder(f"{path}/{_FOLDER}")
