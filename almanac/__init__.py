"""almanac: historical-records analytics as declarative Spark plans."""

from __future__ import annotations

import gc
import io
import os
import tempfile
import zipfile

# Spark runs a task on each core; threads of numerical libraries inside a task only get in each other's way
os.environ.setdefault("OMP_NUM_THREADS", "1")

_shipped: set[str] = set()


def checkpoint_dir(spark) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset a folder of this machine
    serves, but only if the executors are on this machine too (tests); a cluster without it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="almanac-ckpt-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df):
    """df, computed once into the shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark) -> None:
    """Lets Spark delete the shuffle files of frames that are gone: it does so when the driver has collected its garbage.

    The driver's heap shrinks to what is held, too; between long plans it else grows to its bound, with buffers and generated classes beside it."""
    gc.collect()
    spark._jvm.System.gc()


def ship(spark) -> None:
    """Sends this package to the executors once for each application, for the operators that run Python there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here, data = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("almanac", os.path.relpath(path, here)))
    to = os.path.join(tempfile.mkdtemp(prefix="almanac-"), "almanac.zip")
    with open(to, "wb") as f:
        f.write(data.getvalue())
    sc.addPyFile(to)
    _shipped.add(sc.applicationId)
