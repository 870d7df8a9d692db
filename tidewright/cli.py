"""python -m tidewright.cli transform|raw-query REQUEST.yaml RESPONSE.yaml [--tar]

--tar: checkpoints are single tar files, of paths that this machine can open, as coordinators pass them on; the state tables
lie in a folder beside each while a transformation runs.
"""

from __future__ import annotations

import os
import shutil
import sys
import tarfile

import yaml

from tidewright.model import RawQueryRequest, TransformRequest
from tidewright.plans import execute_raw_query, execute_transform
from tidewright.session import session


def _unpacked(path: str) -> str:
    folder = f"{path}.d"
    with tarfile.open(path) as f:
        f.extractall(folder, filter="data")
    return folder


def _packed(folder: str, path: str) -> None:
    """No file where there is no state."""
    if os.path.isdir(folder):
        with tarfile.open(path, "w") as f:
            f.add(folder, ".")
        shutil.rmtree(folder)


def main(args: list[str]) -> int:
    kind, source, target = (a for a in args if a != "--tar")
    with open(source) as f:
        request = yaml.safe_load(f)
    packed = "--tar" in args and kind == "transform"
    if packed:
        old, new = request.get("prevCheckpointPath"), request["newCheckpointPath"]
        request |= {"prevCheckpointPath": _unpacked(old) if old else None, "newCheckpointPath": f"{new}.d"}
    run, of = {"transform": (execute_transform, TransformRequest.of), "raw-query": (execute_raw_query, RawQueryRequest.of)}[kind]
    response = run(session(), of(request)).to_dict()
    if packed:
        _packed(f"{new}.d", new)
        if old:
            shutil.rmtree(f"{old}.d")
    with open(target, "w") as f:
        yaml.safe_dump(response, f, sort_keys=False)
    return int(response["kind"] != "Success")


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
