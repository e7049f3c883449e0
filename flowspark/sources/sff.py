"""Binary SFF files, read and written."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format: magic number and version; blocks are padded to eight bytes.
MAGIC, VERSION = b".sff", b"\0\0\0\1"
_FIELDS = "file string, ord long, read_id string, clip_left int, clip_right int, flows array<int>, flow_index array<int>, bases string, quals array<int>"


def _pad(n: int) -> int:
    return -n % 8


def parse_sff(data: bytes) -> list[dict]:
    """All reads: flows in hundredths, flow_index as steps between bases."""
    if data[:4] != MAGIC:
        raise ValueError("no SFF data")
    index_at, index_size, reads, head, key, flows = struct.unpack(">QIIHHH", data[8:30])
    at, out = head, []
    for _ in range(reads):
        if index_size and at == index_at:
            at += index_size + _pad(index_size)
        size, name, bases, ql, qr, al, ar = struct.unpack(">HHIHHHH", data[at : at + 16])
        read_id = data[at + 16 : at + 16 + name].decode()
        at += size
        signal = struct.unpack(f">{flows}H", data[at : at + 2 * flows])
        at += 2 * flows
        steps, text, quals = data[at : at + bases], data[at + bases : at + 2 * bases], data[at + 2 * bases : at + 3 * bases]
        used = 2 * flows + 3 * bases
        at += 3 * bases + _pad(used)
        out.append({"read_id": read_id, "clip_left": max(1, ql, al) - 1, "clip_right": min(qr or bases, ar or bases), "flows": list(signal), "flow_index": list(steps), "bases": text.decode(), "quals": list(quals)})
    return out


def build_sff(reads: list[dict], flow_chars: str, key: str = "TCAG") -> bytes:
    """The bytes of a file with these reads, without an index."""
    n = len(flow_chars)
    head = 31 + n + len(key)
    head += _pad(head)
    out = [(MAGIC + VERSION + struct.pack(">QIIHHHB", 0, 0, len(reads), head, len(key), n, 1) + flow_chars.encode() + key.encode()).ljust(head, b"\0")]
    for r in reads:
        name, bases = r["read_id"].encode(), r["bases"].encode()
        size = 16 + len(name)
        size += _pad(size)
        out.append((struct.pack(">HHIHHHH", size, len(name), len(bases), r["clip_left"] + 1, r["clip_right"], 0, 0) + name).ljust(size, b"\0"))
        body = struct.pack(f">{n}H", *r["flows"]) + bytes(r["flow_index"]) + bases + bytes(r["quals"])
        out.append(body + bytes(_pad(len(body))))
    return b"".join(out)


def scan_sff(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Reads of all files under path, or of several paths; a file is one task's work. (file, ord) names a read: ord is
    its place in its file."""

    def parse(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = parse_sff(bytes(content))
                yield pd.DataFrame({"file": name, "ord": range(len(rows)), **{k: [r[k] for r in rows] for k in ("read_id", "clip_left", "clip_right", "flows", "flow_index", "bases", "quals")}})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse, _FIELDS)


def sink_sff(reads: DataFrame, folder: str, by: str, flow_chars: str, key: str = "TCAG") -> DataFrame:
    """Writes the reads (read_id, clip_left, clip_right, flows, flow_index, bases, quals, ord) of each by into
    folder/<by>.sff, in order of file, where there is one, and ord, and gives by, path and n. A file is one task's work, as its header holds the number
    of reads. folder is one that all executors share, as a URI; a name appears once its file is whole."""

    order = [c for c in ("file", "ord") if c in reads.columns]

    def written(group: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs
        from pyspark import TaskContext

        name = str(group[by].iat[0])
        rows = [{k: (list(map(int, getattr(r, k))) if k in ("flows", "flow_index", "quals") else getattr(r, k)) for k in ("read_id", "clip_left", "clip_right", "flows", "flow_index", "bases", "quals")} for r in group.sort_values(order).itertuples()]
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        path, work = f"{base}/{name}.sff", f"{base}/.{name}.{TaskContext.get().taskAttemptId()}"
        with store.open_output_stream(work) as out:
            out.write(build_sff(rows, flow_chars, key))
        store.move(work, path)
        return pd.DataFrame({by: [group[by].iat[0]], "path": [path], "n": [len(rows)]})

    return reads.groupBy(by).applyInPandas(written, f"`{by}` {dict(reads.dtypes)[by]}, path string, n long")


def sff_to_raw(reads: DataFrame) -> DataFrame:
    """ord, read_id, clip, flows of SFF reads, and file where there is one: ord is the place in a file."""
    clip = F.aggregate(F.slice("flow_index", 1, F.col("clip_right")), F.lit(0), lambda a, x: a + x)
    return reads.select(*(["file"] if "file" in reads.columns else []), "ord", "read_id", clip.alias("clip"), "flows")
