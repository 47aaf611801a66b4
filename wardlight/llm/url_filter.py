"""URL filters: allow and block rules in a sorted digest array, memory-mapped by every task.

``DigestRules`` holds the rules' 64-bit xxhash keys, sorted, in one file and the
rule strings in another.  Both are sent to the executors as Spark files (so a new
executor fetches them again) and memory-mapped there.  A url probes its host's
suffixes joined with those prefixes of its path that are as long as some rule's
path; all probes of a batch are one binary search, and a hit counts only if the
stored string is equal, so a collision of keys is harmless.  Only suffixes of as many
labels as some rule's host has are probed, so the work on a url is linear in its
length, whatever its number of labels.

The rules are a parameter of the job, not data that grows with the pages: their
files may take ``MAX_RULE_BYTES`` on each executor's disk, which is checked.

Edges: a null url, or one without ``://``, has an empty host and path and no
rule.  Without a rule the verdict is ``default``.  Of several rules that fit, the
longest string wins, then the longest host.  A rule string given twice keeps its
last verdict.  Repeated rows and null ids are answered row by row; urls may be of any
length; an empty table gives an empty one; only id and url are read, so further
columns cannot clash.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlight.llm.common import sliced

MAX_RULE_BYTES = 4 << 30
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    if url is None:
        return "", ""
    head, found, rest = url.partition("://")
    if not found:
        return "", ""
    rest = rest.partition("#")[0].partition("?")[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


class DigestRules:
    """Rules opened from the two files in a folder."""

    def __init__(self, folder: str, name: str) -> None:
        table = np.load(os.path.join(folder, f"{name}.npy"), mmap_mode="r")
        self.keys, self.at, self.allow = table["key"], table["at"], table["allow"]
        self.strings = np.memmap(os.path.join(folder, f"{name}.bin"), np.uint8, "r")
        sizes = self.strings[:16].view(np.int64).tolist()
        numbers = self.strings[16 : 16 + 8 * sum(sizes)].view(np.int64).tolist()
        self.path_lengths, self.label_counts = numbers[: sizes[0]], numbers[sizes[0] :]

    @staticmethod
    def write(rules: list[tuple[str, bool]], folder: str, name: str) -> int:
        """Store (rule string, allowed) pairs; gives the bytes written."""
        unique = {r.encode(): allow for r, allow in rules}
        rows = sorted((xxhash.xxh64_intdigest(r), r, allow) for r, allow in unique.items())
        parts = [r.decode().partition("/") for r in unique]
        lengths = sorted({1 + len(path) for _, _, path in parts})
        labels = sorted({1 + host.count(".") for host, _, _ in parts})
        head = np.array([len(lengths), len(labels), *lengths, *labels], np.int64).tobytes()
        ends = len(head) + np.cumsum([0] + [len(r) for _, r, _ in rows])
        table = np.zeros(len(rows), [("key", np.uint64), ("at", np.int64, 2), ("allow", np.bool_)])
        table["key"] = [k for k, _, _ in rows]
        table["at"] = np.stack([ends[:-1], ends[1:]], axis=1)
        table["allow"] = [a for _, _, a in rows]
        np.save(os.path.join(folder, f"{name}.npy"), table)
        with open(os.path.join(folder, f"{name}.bin"), "wb") as out:
            out.write(head + b"".join(r for _, r, _ in rows))
        return table.nbytes + int(ends[-1])

    def probes(self, host: str, path: str) -> list[str]:
        """The rule strings that would fit, longest first, then longest host."""
        if not host or not self.label_counts:
            return []
        labels = host.rsplit(".", self.label_counts[-1])[-self.label_counts[-1] :]
        whole = host.count(".") + 1
        hosts = [".".join(labels[-n:]) for n in reversed(self.label_counts) if n <= whole]
        paths = [path[:n] for n in self.path_lengths if n <= len(path)]
        return sorted((h + p for h in hosts for p in paths), key=len, reverse=True)  # stable: longest host first

    def first_fits(self, urls: list[tuple[str, str]]) -> list[tuple[str, bool] | None]:
        """For each host and path the winning rule and whether it allows."""
        probes, owner = [], []
        for i, (host, path) in enumerate(urls):
            own = self.probes(host, path)
            probes += own
            owner += [i] * len(own)
        out: list[tuple[str, bool] | None] = [None] * len(urls)
        if not probes or not len(self.keys):
            return out
        raw = [p.encode() for p in probes]
        keys = np.fromiter(map(xxhash.xxh64_intdigest, raw), np.uint64, len(raw))
        at = np.searchsorted(self.keys, keys)
        hits = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys)
        for j in hits.tolist():
            i, k = owner[j], int(at[j])
            while out[i] is None and k < len(self.keys) and self.keys[k] == keys[j]:  # equal keys lie side by side
                begin, end = self.at[k]
                if self.strings[begin:end].tobytes() == raw[j]:
                    out[i] = (probes[j], bool(self.allow[k]))
                k += 1
        return out


@lru_cache(maxsize=4)
def _opened(name: str) -> DigestRules:
    return DigestRules(SparkFiles.getRootDirectory(), name)


def url_filter(
    pages: DataFrame, rules: list[tuple[str, bool]], id_col: str = "page_id", url_col: str = "url", default: str = "allow",
) -> DataFrame:
    """Host, path, winning rule and verdict of each page's url."""
    for rule, _ in rules:
        if "/" not in rule or rule.startswith("/"):
            raise ValueError(f"a rule is a host and a path: {rule!r}")
    name = f"rules-{uuid.uuid4().hex}"
    folder = tempfile.mkdtemp(prefix="wardlight-rules-")
    if DigestRules.write(rules, folder, name) > MAX_RULE_BYTES:
        raise ValueError(f"the rules take more than {MAX_RULE_BYTES} bytes")
    for end in ("npy", "bin"):
        pages.sparkSession.sparkContext.addFile(os.path.join(folder, f"{name}.{end}"))
    schema = pa.schema([("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string())])

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = _opened(name)
        for part in sliced(parts):
            urls = [host_and_path(u) for u in part.column(1).to_pylist()]
            fits = opened.first_fits(urls)
            yield pa.record_batch([
                part.column(0).cast(pa.int64()), pa.array([h for h, _ in urls], pa.string()), pa.array([p for _, p in urls], pa.string()),
                pa.array([f and f[0] for f in fits], pa.string()),
                pa.array([default if f is None else "allow" if f[1] else "block" for f in fits], pa.string()),
            ], schema=schema)

    ids = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    return ids.mapInArrow(judge, "page_id long, host string, path string, rule string, verdict string")
