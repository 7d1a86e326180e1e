"""What the operators share: session helpers, sizing and the grouped two-phase key statistics."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from math import isqrt
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> SparkSession:
    """Make this package importable on the workers and give the session a checkpoint folder.

    The folder is spark.checkpoint.dir where the cluster names one. Without that setting only a
    session on one machine (local) gets a temporary one; any other is refused. What nothing refers
    to any more is removed from the folder by Spark's cleaner, which is told so here.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.match(r"local($|\[)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    root = Path(__file__).resolve().parents[2]
    on_path = str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if not on_path and not getattr(sc, "_millrace_shipped", False):
        archive = os.path.join(tempfile.mkdtemp(prefix="code-"), "millrace_code.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for f in sorted((root / "millrace").rglob("*.py")):
                z.write(f, f.relative_to(root))
        sc.addPyFile(archive)
        sc._millrace_shipped = True
    return spark


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once and written to the shared checkpoint folder: a lost executor
    costs a reread, not the lineage. The files go once the driver has dropped the frame."""
    ready(df.sparkSession)
    return df.checkpoint()


def writer(spark: SparkSession) -> Callable[[DataFrame], DataFrame]:
    """A function that writes tables to the shared folder as Parquet and reads them again, one
    after another: the one before goes when the next is written, the last when the application ends."""
    ready(spark)
    path, last = spark._jvm.org.apache.hadoop.fs.Path, []
    top = path(f"{spark.sparkContext.getCheckpointDir()}/tables-{uuid.uuid4().hex}")
    files = top.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(top)

    def put(df: DataFrame) -> DataFrame:
        at = path(top, str(len(last)))
        df.write.parquet(at.toString())
        if last:
            files.delete(last[-1], True)
        last.append(at)
        return spark.read.schema(df.schema).parquet(at.toString())

    return put


def spread(df: DataFrame) -> DataFrame:
    """The rows in as many parts at least as there are cores: a small file of one part would be
    worked by one task. Tables with parts enough stay as they are, without a shuffle."""
    cores, plan = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution().executedPlan()
    if plan.nodeName() == "AdaptiveSparkPlan":  # it has shuffles of its own
        return df
    return df.repartition(cores) if plan.execute().getNumPartitions() < cores else df


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """What the documents really weigh: the bytes of their texts, and a little for each row. One
    pass over that column; planners' estimates multiply at joins and are no measure."""
    size, rows = docs.agg(F.sum(F.octet_length(text)), F.count("*")).first()
    return (size or 0) + 64 * rows


#: Bytes of text for a message from a group to a bucket, and bounds for a group.
A_MESSAGE, SMALL_GROUP, LARGE_GROUP = 8 << 10, 256 << 10, 32 << 20


def groups_for(total: int) -> int:
    """How many groups, and about as many buckets, so many bytes of text make. A group grows with
    the root of the whole, so that messages (groups times buckets) grow in proportion to the
    bytes; from LARGE_GROUP on groups stay as they are and messages get smaller."""
    return max(1, -(-total // min(LARGE_GROUP, max(SMALL_GROUP, isqrt(total * A_MESSAGE)))))


def bucket_bits(total: int) -> int:
    """Buckets are told by so many of a hash's upper bits."""
    return (groups_for(total) - 1).bit_length()


def group_of(n: int, *cols: Column) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(n)).cast("int")


MESSAGE = "bucket int, g int, payload binary"
MESSAGE_SCHEMA = pa.schema([("bucket", pa.int32()), ("g", pa.int32()), ("payload", pa.binary())])

#: The bucket number of what a caller tells each group from the start.
TOLD = -1

Answers = dict[int, bytes]
Emit = Callable[[pa.Table, Answers], Iterable[tuple[int, bytes]]]
Merge = Callable[[list[bytes]], list[bytes]]


def message_table(g: int, rows: Iterable[tuple[int, bytes]]) -> pa.Table:
    rows = list(rows)
    return pa.table({"bucket": pa.array([b for b, _ in rows], pa.int32()), "g": pa.array([g] * len(rows), pa.int32()), "payload": pa.array([p for _, p in rows], pa.binary())}, schema=MESSAGE_SCHEMA)


def in_rounds(dealt: DataFrame, rounds: list[tuple[Emit, Merge]], consume: Callable[[pa.Table, Answers], pa.Table], schema: str, told: DataFrame | None = None) -> DataFrame:
    """Statistics of keys that occur in many documents, told back to each document.

    `dealt` has a column g: documents are dealt to bounded groups by a hash of the row, so no key
    of theirs can make a group large. In a round each group sends each bucket of the key space one
    message with its distinct keys; a key that stands in a third of all rows so arrives once a
    group, not once a row. A bucket merges its messages and answers each, in the order of its
    keys. The next round's groups read their documents again with these answers at hand, and
    `consume` makes the result with the last answers. The plan has one exchange of the texts and
    reuses it. `told` may hold a message (bucket TOLD) for each group, which first round and
    `consume` also get.
    """

    def answers_of(t: pa.Table) -> Answers:
        return dict(zip(t["bucket"].to_pylist(), t["payload"].to_pylist(), strict=True))

    def sender(emit: Emit):
        def send(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            return message_table(key[0].as_py(), emit(left, answers_of(right)) if len(left) else ())

        return send

    def sender_alone(emit: Emit):
        def send(t: pa.Table) -> pa.Table:
            return message_table(t["g"][0].as_py(), emit(t, {}))

        return send

    def merger(merge: Merge):
        def answer(t: pa.Table) -> pa.Table:
            return t.set_column(2, MESSAGE_SCHEMA.field(2), pa.array(merge(t["payload"].to_pylist()), pa.binary())).select(MESSAGE_SCHEMA.names)

        return answer

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        return consume(left, answers_of(right))

    heard = told
    for emit, merge in rounds:
        if heard is None:
            sent = dealt.groupBy("g").applyInArrow(sender_alone(emit), MESSAGE)
        else:
            sent = dealt.groupBy("g").cogroup(heard.groupBy("g")).applyInArrow(sender(emit), MESSAGE)
        heard = sent.groupBy("bucket").applyInArrow(merger(merge), MESSAGE)
    if told is not None:
        heard = heard.unionByName(told)
    return dealt.groupBy("g").cogroup(heard.groupBy("g")).applyInArrow(finish, schema)


def by_range(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """The buckets of sorted hashes, which are ranges of them, and where they are."""
    high = hashes >> np.uint64(32)
    b = ((high * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(b, prepend=-1, append=-1))
    for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield int(b[x]), slice(x, y)


def by_bucket(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    return by_range(keys, 1 << bits)


def shortened(hashes: np.ndarray, bits: int, low: int = 40) -> np.ndarray:
    """Hashes cut to their bucket and the next `low` bits, for keys that only propose."""
    cut = np.uint64(max(0, 64 - bits - low))
    return hashes >> cut << cut


def packed(keys: np.ndarray, bits: int, *more: np.ndarray, low: int = 64) -> bytes:
    """Keys of one bucket without its bits (all the others, or the next `low`), byte by byte from
    the lowest, and other arrays as they are."""
    low = min(low, 64 - bits)
    wide = -(-low // 8)
    rest = (keys >> np.uint64(64 - bits - low)).astype("<u8")
    planes = np.ascontiguousarray(rest.view(np.uint8).reshape(-1, 8)[:, :wide].T)
    return b"".join([len(keys).to_bytes(4, "little"), bytes([wide]), planes.tobytes(), *(x.tobytes() for x in more)])


def unpacked(payload: bytes) -> tuple[np.ndarray, memoryview]:
    """Numbers that are equal, and in order, as the bucket's keys are; and what follows them."""
    n, wide = int.from_bytes(payload[:4], "little"), payload[4]
    out = np.zeros((n, 8), np.uint8)
    out[:, :wide] = np.frombuffer(payload, np.uint8, n * wide, 5).reshape(wide, n).T
    return out.view("<u8").reshape(-1), memoryview(payload)[5 + n * wide :]
