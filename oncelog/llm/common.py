"""Helpers shared by the corpus operators: tables, shared scratch space, word buffers."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the word contracts; every other code point is part of a word.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset and Spark
    runs on this machine alone, as in tests, a temporary folder is set instead.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="oncelog-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes a table to the shared folder and reads it: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch path through the file system that it belongs to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Workspace:
    """Tables of one job in the shared folder, each removed once nothing reads it any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch(self.spark, label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Removes tables that ``write`` returned; others are left alone."""
        for t in tables:
            if id(t) in self.paths:
                remove(self.spark, self.paths.pop(id(t))[0])

    def keep(self, *tables: DataFrame) -> None:
        """Removes all tables but these, which the result still reads."""
        kept = {id(t) for t in tables}
        self.drop(*(t for k, (_, t) in list(self.paths.items()) if k not in kept))


class RunLog:
    """The immutable runs of an index: bucketed and sorted tables in the warehouse, oldest first.

    A run is an external table whose folder tells its index, number and buckets, so a
    later session opens an index by its name: folders of finished runs that its
    catalog does not know are registered anew.
    """

    def __init__(self, spark: SparkSession, name: str, key: str, schema: str, buckets: int | None = None):
        self.spark, self.name, self.key, self.schema = spark, name, key, schema
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        self.runs: list[str] = self._stored()
        for run in self.runs:
            if not spark.catalog.tableExists(run):
                spark.sql(f"CREATE TABLE {run} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {run.split('_b')[-1]} BUCKETS LOCATION '{self.root}/{run}'")

    def _stored(self) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [f.getPath() for f in files.listStatus(path)] if files.exists(path) else []
        own = re.compile(rf"{re.escape(self.name)}_n[0-9]+_b[0-9]+")
        return sorted(p.getName() for p in found if own.fullmatch(p.getName()) and files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def append(self, rows: DataFrame) -> str:
        """A new run, one sorted file for each bucket."""
        last = int(self.runs[-1].split("_n")[-1].split("_b")[0]) if self.runs else 0
        run = f"{self.name}_n{last + 1:09d}_b{self.buckets}"
        out = rows.repartition(self.buckets, self.key).write.mode("overwrite").bucketBy(self.buckets, self.key).sortBy(self.key)
        out.format("parquet").option("path", f"{self.root}/{run}").saveAsTable(run)
        self.runs.append(run)
        return run

    def rows(self) -> DataFrame | None:
        """All rows, with the number of their run as ``age``."""
        out = None
        for age, run in enumerate(self.runs):
            own = self.spark.table(run).withColumn("age", F.lit(age))
            out = own if out is None else out.unionByName(own)
        return out

    def replace(self, rows: DataFrame) -> None:
        """One run in place of all; the old ones go once it is written."""
        old, self.runs = list(self.runs), self.runs[-1:]
        self.append(rows)
        self.runs = self.runs[-1:]
        for run in old:
            self.spark.sql(f"DROP TABLE {run}")
            remove(self.spark, f"{self.root}/{run}")


def fresh(columns: list[str], *names: str) -> list[str]:
    """Column names that do not clash with those of a table (Spark compares them without case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on unsigned 64-bit lanes (wraps by intent)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordBuffer:
    """The words of many texts as byte ranges of one buffer, without Python strings.

    Words are maximal runs of bytes outside space and 09..0D; no such byte occurs
    inside a multi-byte UTF-8 sequence, so byte runs are code point runs.
    ``starts``/``ends`` are byte offsets, ``first[i]:first[i + 1]`` are the words of text i.
    """

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts) + b"\n"
        self.data = np.frombuffer(joined, dtype=np.uint8)
        space = (self.data == 32) | ((self.data >= 9) & (self.data <= 13))
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space)).astype(np.int8)))
        self.starts, self.ends = edge[0::2], edge[1::2]
        lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.bases = np.concatenate(([0], np.cumsum(lengths)))
        self.first = np.searchsorted(self.starts, self.bases)

    def lane(self, at: np.ndarray) -> np.ndarray:
        """The eight bytes that begin at each offset, zeros behind the end of the buffer."""
        if not hasattr(self, "_lanes"):
            padded = np.concatenate((self.data, np.zeros(8, np.uint8)))
            self._lanes = np.lib.stride_tricks.as_strided(padded, (len(self.data) + 1, 8), (1, 1))
        return np.ascontiguousarray(self._lanes[at]).view("<u8").ravel()

    def word_hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: eight bytes at a time are mixed into it.

        Words of up to eight bytes and of one length never collide; very long ones are hashed one by one.
        """
        size = self.ends - self.starts
        out = mix64(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        left, at = np.flatnonzero(size <= _LONG), 0
        with np.errstate(over="ignore"):
            while len(left):
                rest = np.minimum(size[left] - at, 8)
                lanes = self.lane(self.starts[left] + at) & LANE_MASKS[rest]
                out[left] = mix64((out[left] ^ lanes) * np.uint64(0xD1B54A32D192ED03) + np.uint64(at))
                at += 8
                left = left[size[left] > at]
        for i in np.flatnonzero(size > _LONG):
            out[i] = np.uint64(_long_word(self.data[self.starts[i] : self.ends[i]].tobytes()))
        return out


#: Words over this many bytes are hashed one by one; masks of the bytes of a lane that belong to the word.
_LONG = 256
LANE_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def _long_word(word: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(word, seed=7)
