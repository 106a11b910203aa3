"""What Python workers need: the package itself, and model weights.

Spark copies a shipped file to every executor once. The package goes as a zip on the
workers' path, so a session may be started anywhere, with nothing installed on
the cluster. Weights go as one file or a zipped folder, named by its SHA-256;
a worker checks the sum and unpacks once, into the folder Spark gave the executor.
"""

from __future__ import annotations

import hashlib
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import SparkFiles
from pyspark.sql import SparkSession

_PACKAGE = os.path.dirname(os.path.abspath(__file__))


def _zipped(folder: str, prefix: str, keep: Callable[[str], bool]) -> bytes:
    """The folder's files as a zip whose bytes depend on their names and contents only."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for root, folders, names in os.walk(folder):
            folders.sort()
            for name in sorted(names):
                path = os.path.join(root, name)
                if keep(path):
                    entry = zipfile.ZipInfo(os.path.join(prefix, os.path.relpath(path, folder)), (1980, 1, 1, 0, 0, 0))
                    entry.compress_type = zipfile.ZIP_DEFLATED
                    with open(path, "rb") as f:
                        archive.writestr(entry, f.read())
    return out.getvalue()


def _local_copy(data: bytes, name: str) -> str:
    """A file of the driver, from which Spark serves it to the executors."""
    path = os.path.join(tempfile.mkdtemp(prefix="tidings-ship-"), name)
    with open(path, "wb") as f:
        f.write(data)
    return path


def ship_package(spark: SparkSession) -> str:
    """Put this package on the path of all Python workers; returns its SHA-256.
    Shipping the same code twice to one session does nothing."""
    data = _zipped(_PACKAGE, os.path.basename(_PACKAGE), lambda path: path.endswith(".py"))
    digest = hashlib.sha256(data).hexdigest()
    name = f"tidings-{digest[:16]}.zip"
    sc = spark.sparkContext
    if not any(path.endswith(name) for path in sc.listFiles):
        sc.addPyFile(_local_copy(data, name))
    return digest


@dataclass(frozen=True)
class Weights:
    """A shipped file: its name on the executors, its sum, and whether it is a zipped folder."""

    name: str
    sha256: str
    folder: bool

    def path(self) -> str:
        """On a worker (or the driver): the checked file, or the unpacked folder."""
        path = SparkFiles.get(self.name)
        if not self.folder:
            _check(path, self.sha256)
            return path
        target = os.path.join(os.path.dirname(path), f"unpacked-{self.sha256}")
        if not os.path.isdir(target):
            _check(path, self.sha256)
            part = f"{target}-{uuid.uuid4().hex}"
            with zipfile.ZipFile(path) as archive:
                archive.extractall(part)
            try:
                os.rename(part, target)  # workers of one executor may unpack at the same time: the first stays
            except OSError:
                if not os.path.isdir(target):
                    raise
        return target


def _check(path: str, sha256: str) -> None:
    with open(path, "rb") as f:
        found = hashlib.file_digest(f, "sha256").hexdigest()
    if found != sha256:
        raise ValueError(f"{os.path.basename(path)} arrived with SHA-256 {found}, not {sha256}")


def ship_weights(spark: SparkSession, path: str) -> Weights:
    """Send a file or folder of the driver to every executor."""
    folder = os.path.isdir(path)
    if folder:
        data = _zipped(path, "", lambda _: True)
    else:
        with open(path, "rb") as f:
            data = f.read()
    digest = hashlib.sha256(data).hexdigest()
    name = f"weights-{digest[:32]}{'.zip' if folder else os.path.splitext(path)[1]}"
    sc = spark.sparkContext
    if not any(p.endswith(name) for p in sc.listFiles):
        sc.addFile(_local_copy(data, name))
    return Weights(name, digest, folder)


def weights_loader(weights: Weights, build: Callable[[str], Callable]) -> Callable[[], Callable]:
    """A model loader (``ModelScorer``, ``EncoderCosine``): ``build`` makes the
    model from the path of the shipped weights, once per Python worker."""

    def load():
        return build(weights.path())

    return load
