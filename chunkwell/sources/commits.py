"""Which writes to a store are finished.

Every write has folders of its own, named by an id that no other attempt has. When all its
files are in place, a marker of that name is created, and readers look at marked writes only.
So a write is seen whole or not at all, what a crash leaves is never read, and an ingest that
is tried again stands there once: of several marked attempts the first by name counts.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Sequence

from pyspark.sql import SparkSession

from chunkwell.functions.metadata import promoted_column

#: Folder of the markers; Spark does not read names that begin like this.
MARKERS = "_finished"
#: Folder of the names of promoted caller fields.
FIELDS = "_fields"
#: Begins the id of rows that a write sets aside; no marker has such a name.
LOST = "lost-"


def _key(ingest_id: str) -> str:
    return hashlib.sha256(ingest_id.encode()).hexdigest()[:32]


def new_write(ingest_id: str) -> str:
    """An id for one attempt to write an ingest."""
    return f"{_key(ingest_id)}.{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def finish(spark: SparkSession, root: str, write_id: str, facts: dict) -> None:
    """Marks a write as finished; ``facts`` are kept with the marker."""
    system, place = _place(spark, f"{root}/{MARKERS}/{write_id}")
    out = system.create(place, False)
    try:
        out.write(bytearray(json.dumps(facts).encode()))
    finally:
        out.close()


def _first_attempts(names: list[str]) -> list[str]:
    chosen: dict[str, str] = {}
    for name in sorted(names):
        chosen.setdefault(name.partition(".")[0], name)
    return sorted(chosen.values())


def finished_writes(spark: SparkSession, root: str) -> list[str]:
    """Ids of all finished writes, one per ingest; a listing of one folder."""
    system, place = _place(spark, f"{root}/{MARKERS}")
    found = system.listStatus(place) if system.exists(place) else []
    return _first_attempts([f.getPath().getName() for f in found])


def finished_write(spark: SparkSession, root: str, ingest_id: str) -> tuple[str, dict] | None:
    """The finished write of an ingest and its facts, if there is one."""
    system, place = _place(spark, f"{root}/{MARKERS}/{_key(ingest_id)}.*")
    found = [f.getPath() for f in system.globStatus(place) or []]
    if not found:
        return None
    marker = min(found, key=lambda p: p.getName())
    text = spark.read.text(marker.toString(), wholetext=True).head()
    return marker.getName(), json.loads(text[0])


def promote_fields(spark: SparkSession, root: str, names: Sequence[str]) -> None:
    """Notes that caller fields are stored as columns as well; the notes only ever grow."""
    for name in names:
        system, place = _place(spark, f"{root}/{FIELDS}/{promoted_column(name)}")
        if not system.exists(place):
            system.create(place, True).close()


def promoted_fields(spark: SparkSession, root: str) -> list[str]:
    """The columns of promoted caller fields that any write may have."""
    system, place = _place(spark, f"{root}/{FIELDS}")
    found = system.listStatus(place) if system.exists(place) else []
    return sorted(f.getPath().getName() for f in found)


def remove_unfinished(spark: SparkSession, root: str, older_than: float = 7 * 86_400) -> list[str]:
    """Removes folders of writes that did not finish within ``older_than`` seconds.

    They are never read; this only frees their space. Returns the ids of the writes.
    """
    done, gone = set(finished_writes(spark, root)), set()
    system, place = _place(spark, f"{root}/collection_name=*/write_id=*")
    for folder in system.globStatus(place) or []:
        name = folder.getPath().getName().removeprefix("write_id=")
        old = folder.getModificationTime() / 1000 <= time.time() - older_than
        if old and name.removeprefix(LOST) not in done:
            system.delete(folder.getPath(), True)
            gone.add(name.removeprefix(LOST))
    return sorted(gone)
