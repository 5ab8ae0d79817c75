"""Files of the cluster's store, opened on an executor to be read from any place."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import BinaryIO
from urllib.parse import quote

#: From a path, as Spark lists it, to a file that can be read from any place.
Opener = Callable[[str], BinaryIO]

# Hadoop's names of stores that have another one here.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def open_file(path: str) -> BinaryIO:
    """Open a path on the local or a shared disk, HDFS, S3 or GCS.

    Credentials are those of the executor's environment.  For another store,
    pass an opener of your own.
    """
    store, place = _store_of(path)
    return store.open_input_file(place)


def create_file(path: str) -> BinaryIO:
    """The same for writing; a file that is there is replaced."""
    store, place = _store_of(path)
    return store.open_output_stream(place)


def _store_of(path: str):
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), re.sub("^/+", "/", rest)
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}:{quote(rest, safe='/:@')}")
