"""Token-ID output in training order.

Texts become token sequences of a fixed length.  A keyed Feistel permutation with
cycle walking maps the dense index of each sequence to a global slot, so the order is
a pseudo-random permutation that any worker can compute on its own.  Range partitions
of slots hold whole shards of fixed-stride records: the place of a slot is arithmetic,
so a reader can start, stop and resume anywhere.
"""

from __future__ import annotations

import base64
import hashlib
import json
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from . import _text as T
from ._spark import with_long_ids, written

#: Fixed value: how the byte-level vocabularies split a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
EOS = 50256
ROUNDS = 6
#: Sequences are dealt to so many buckets by hash and numbered inside each: a part of the order, not of the cluster.
BUCKETS = 1 << 18
#: Packed bytes of a partition of the output, which is whole shards.
OUTPUT_BYTES = 128 << 20


def feistel(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A permutation of range(n): a balanced Feistel network over the next power of four, walked until below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for r in range(ROUNDS):
            left, right = right, left ^ (T.mix(right, key * ROUNDS + r + 1) & mask)
        x = (left << np.uint64(half)) | right
        out[todo] = x
        todo = todo[x >= n]
    return out.astype(np.int64)


class Encoder:
    """Byte-level BPE as token bytes, a text at a time: nothing is remembered, so new words cost what known ones do."""

    def __init__(self, ranks: bytes, kind: type):
        import tiktoken

        self.bpe = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, ranks.splitlines()))}, special_tokens={})
        self.kind, self.code = kind, "HI"[np.dtype(kind).itemsize == 4]

    def one(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), self.kind).tobytes()

    def encode(self, text: str) -> bytes:
        """As `one`; an array takes a list of numbers in half numpy's time."""
        return array(self.code, self.bpe.encode_ordinary(text)).tobytes()


def _tokenise(ranks, length: int, eos: int, kind: type):
    schema = pa.schema([("doc_id", pa.int64()), ("seq_no", pa.int64()), ("n_tokens", pa.int64()), ("content", pa.int64()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(ranks.value, kind)
        press = zstandard.ZstdCompressor(level=1)
        width = np.dtype(kind).itemsize
        end = np.array([eos], kind).tobytes()
        for batch in batches:
            for lo in range(0, len(batch), 500):
                ids, numbers, sizes, contents, packed = [], [], [], [], []
                for i, text in zip(batch.column(0).slice(lo, 500).to_pylist(), T.strings(batch.column(1).slice(lo, 500)), strict=True):
                    tokens = encoder.encode(text or "") + end
                    for k, at in enumerate(range(0, len(tokens), length * width)):
                        part = tokens[at : at + length * width]
                        ids.append(i)
                        numbers.append(k)
                        sizes.append(len(part) // width)
                        contents.append(int.from_bytes(hashlib.blake2b(part, digest_size=8).digest(), "little", signed=True))
                        packed.append(press.compress(part))
                yield pa.record_batch([pa.array(x, t) for x, t in zip((ids, numbers, sizes, contents, packed), schema.types, strict=True)], schema=schema)

    return run


def _unpack(length: int, eos: int, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        pad = np.full(length, eos, kind).tobytes()
        for batch in batches:
            for lo in range(0, len(batch), 1000):
                part = batch.slice(lo, 1000)
                full = [(x := unpress.decompress(p)) + pad[len(x) :] for p in part.column("packed").to_pylist()]
                names = [c for c in part.schema.names if c != "packed"]
                yield pa.record_batch([*(part.column(c) for c in names), pa.array(full, pa.binary())], names=[*names, "tokens"])

    return run


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, length: int = 1024, eos: int = EOS, key: int = 1, shard_slots: int = 8192, buckets: int = BUCKETS) -> DataFrame:
    """slot, shard, shard_offset, doc_id, seq_no, n_tokens, tokens: one row for each sequence, by slot within each partition.

    A text is its tokens and one `eos`, cut every `length` tokens; the last part is
    filled with `eos`, and n_tokens counts what is not filling.  `tokens` are
    little-endian 16-bit numbers (32-bit where `eos` needs them).  Null and empty
    texts are one sequence with `eos` alone; texts may be of any length; repeated rows
    are sequences of their own (equal ones may change places, which no reader can tell).
    A null id is an id; ids that are no integers go by their places
    among all ids.  Bytes that are no UTF-8 count as replacement
    characters.  The slot depends on the rows and the parameters only, not on
    partitions or settings: sequences go to `buckets` by a hash of id, number and
    tokens, are ordered by these inside, and the permutation takes their place in that
    order to the slot.

    Sequences are shuffled twice, packed: by bucket to be numbered, and by slot.  To
    number keys alone would need a third shuffle to bring the numbers back.
    """
    spark = docs.sparkSession
    kind = np.uint16 if eos < 1 << 16 else np.uint32
    with open(tokenizer, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # a vocabulary: about 1 MB whatever the corpus
    base, back = with_long_ids(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    rows = base.mapInArrow(_tokenise(ranks, length, eos, kind), "doc_id long, seq_no long, n_tokens long, content long, packed binary")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "seq_no", "content"), F.lit(buckets)).cast("int"))
    rank = F.expr("row_number() OVER (PARTITION BY bucket ORDER BY doc_id, seq_no, content)")
    rows = written(rows.withColumn("rank", rank))
    sizes = written(rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.octet_length("packed")).alias("bytes")))
    before = sizes.select("bucket", (F.expr("sum(n) OVER (ORDER BY bucket)") - F.col("n")).alias("before"))
    n, packed_bytes = (x or 0 for x in sizes.agg(F.sum("n"), F.sum("bytes")).first())

    def slots(index: pd.Series) -> pd.Series:
        return pd.Series(feistel(index.to_numpy(np.int64), n, key))

    slot = F.pandas_udf(slots, Ty.LongType())
    placed = rows.join(F.broadcast(before), "bucket").withColumn("slot", slot(F.col("before") + F.col("rank") - 1))  # `buckets` rows of two numbers
    shards = max(1, -(-n // shard_slots))
    placed = placed.withColumn("shard", F.floor(F.col("slot") / shard_slots).cast("long"))
    share = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-packed_bytes // OUTPUT_BYTES)), shards)
    placed = back(placed, "doc_id")
    id_type = placed.schema["doc_id"].dataType.simpleString()
    # Each partition is a run of whole shards; their bounds are known, so nothing is sampled.
    placed = placed.repartitionById(share, F.floor(F.col("shard") * share / shards).cast("int")).sortWithinPartitions("slot")
    width = np.dtype(kind).itemsize * length
    placed = placed.select("slot", "shard", (F.col("slot") % shard_slots * width).alias("shard_offset"), "doc_id", "seq_no", "n_tokens", "packed")
    return placed.mapInArrow(_unpack(length, eos, kind), f"slot long, shard long, shard_offset long, doc_id {id_type}, seq_no long, n_tokens long, tokens binary")


def write_shards(ordered: DataFrame, uri: str, **parameters) -> DataFrame:
    """Writes training_order's rows as files shard-00000.bin and a manifest under `uri`; returns (shard, n_slots, bytes).

    A task writes each of its shards under a name of its own and renames it when
    whole, so a lost or repeated task leaves no half shard; a shard that an earlier
    attempt finished is replaced.  The manifest, written last, has the number of
    sequences and slots, what a slot is wide, and `parameters` (those given to
    training_order): with it any slot's place is arithmetic, and a set of shards
    without one is not whole.  `uri` is any file system that pyarrow opens (file, hdfs,
    s3, gs).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(uri)
        store.create_dir(path, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        out, now, sink, n, size, widest = [], None, None, 0, 0, 0

        def close():
            if sink is not None:
                sink.close()
                target = f"{path}/shard-{now:05d}.bin"
                if store.get_file_info(target).type == fs.FileType.File:
                    store.delete_file(target)
                store.move(f"{path}/.{now}-{attempt}", target)
                out.append((now, n, size, widest))

        for batch in batches:
            for shard, tokens in zip(batch.column("shard").to_pylist(), batch.column("tokens").to_pylist(), strict=True):
                if shard != now:
                    close()
                    now, n, size = shard, 0, 0
                    sink = store.open_output_stream(f"{path}/.{now}-{attempt}")
                sink.write(tokens)
                n, size, widest = n + 1, size + len(tokens), len(tokens)
        close()
        yield pa.record_batch([pa.array([x[k] for x in out], pa.int64()) for k in range(4)], names=["shard", "n_slots", "bytes", "stride"])

    done = written(ordered.select("shard", "tokens").mapInArrow(run, "shard long, n_slots long, bytes long, stride long"))
    total = done.agg(F.sum("n_slots").alias("n"), F.max("n_slots").alias("shard_slots"), F.max("stride").alias("stride"), F.count("*").alias("shards")).first()
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(f"{path}/manifest.json") as f:
        f.write(json.dumps({"sequences": total["n"] or 0, "shards": total["shards"], "shard_slots": total["shard_slots"] or 0, "stride": total["stride"] or 0, "parameters": parameters}, sort_keys=True).encode())
    return done.drop("stride")


def read_slots(uri: str, start: int, stop: int, kind: type = np.uint16) -> np.ndarray:
    """Sequences start to stop - 1, one a row, by seeking in the shards as the manifest lays them out."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(f"{path}/manifest.json") as f:
        manifest = json.loads(f.read())
    stride, shard_slots = manifest["stride"], manifest["shard_slots"]
    length, out = stride // np.dtype(kind).itemsize, []
    stop = min(stop, manifest["sequences"])
    while start < stop:
        shard, at = divmod(start, shard_slots)
        take = min(stop - start, shard_slots - at)
        with store.open_input_file(f"{path}/shard-{shard:05d}.bin") as f:
            f.seek(at * stride)
            out.append(np.frombuffer(f.read(take * stride), kind).reshape(-1, length))
        start += take
    return np.concatenate(out) if out else np.zeros((0, length), kind)
