"""Source archives of published Java artifacts: fetched by their URL, unpacked into a folder of name and version, once."""

from __future__ import annotations

import io
import os
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from typing import BinaryIO
from urllib.request import urlopen

from tessera.functions.names import ARCHIVES

TIMEOUT = 120.0


def url_of(coordinate: str, version: str, base: str = ARCHIVES) -> str:
    """Of group:artifact (names.archive_url of a table's columns)."""
    group, _, artifact = coordinate.partition(":")
    return "/".join([base, *group.split("."), artifact, version, f"{artifact}-{version}-sources.jar"])


def fetch(name: str, coordinate: str, version: str, root: str, base: str = ARCHIVES, open_url: Callable[..., BinaryIO] = urlopen) -> str | None:
    """The folder with the sources; None if they can't be had. What is there already isn't fetched again, and a broken archive leaves nothing behind."""
    folder = os.path.join(root, f"{name}-{version}")
    if os.path.isdir(folder):
        return folder
    os.makedirs(root, exist_ok=True)
    part = tempfile.mkdtemp(dir=root, prefix=".part-")
    try:
        with open_url(url_of(coordinate, version, base), timeout=TIMEOUT) as answer:
            zipfile.ZipFile(io.BytesIO(answer.read())).extractall(part)
        os.rename(part, folder)
    except (OSError, zipfile.BadZipFile):
        shutil.rmtree(part, ignore_errors=True)
        return None
    return folder
