"""Secret scan: keyword automaton, anchored expressions, embedded checksums.

A batch of texts is one flat byte buffer.  An Aho-Corasick automaton finds the
keywords in one pass; only at its hits is an expression tried, anchored there.
Runs of hexadecimal digits have no keyword and are found by a byte-class pass.
All patterns are ASCII, so bytes and characters agree; places are turned into
code points for the few texts with a span.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import production, table, text_of, tidy
from .textvec import buffers

#: Kinds in the order in which spans with equal start stand.  The first three
#: are the base; the others carry a checksum of their own.
KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]
MIN_VALUE, MIN_ACCESS, MIN_HEX = 6, 20, 24
ASSIGN = re.compile(rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
CHECKED = re.compile(rb"(gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
KEYWORDS = {"password": 0, "passwd": 0, "secret": 0, "token": 0, "apikey": 0, "api_key": 0, "akia": 1, "ghp_": 3, "gho_": 3, "ghu_": 3, "ghs_": 3, "ghr_": 3, "npm_": 4}
_DIGITS = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


@cache
def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def checksum62(body: bytes) -> bytes:
    """CRC-32 of a token's body as six base-62 digits."""
    n, out = zlib.crc32(body), b""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _DIGITS[d : d + 1] + out
    return out


def scan_buffer(raw: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``(row, start, end, kind)`` of every span; places are bytes in raw."""
    data = raw.tobytes()
    found: list[tuple[int, int, int, int]] = []
    hits = sorted((end + 1 - size, kind) for end, (kind, size) in _automaton().iter(data.lower().decode("latin-1")))
    done = [0] * len(KINDS)  # a kind's spans don't overlap
    if hits:
        rows = np.searchsorted(off, [h for h, _ in hits], side="right") - 1
        for (at, kind), row in zip(hits, rows.tolist(), strict=True):
            if at < done[kind]:
                continue
            stop = int(off[row + 1])
            m = (ASSIGN, ACCESS, None, CHECKED, CHECKED)[kind].match(data, at, stop)
            if m is None:
                continue
            done[kind] = m.end()
            if (kind == 0 and len(m[2]) < MIN_VALUE) or (kind == 1 and m.end() - at < MIN_ACCESS) or (kind > 2 and checksum62(m[2]) != m[3]):
                continue
            found.append((row, at, m.end(), kind))
    if len(raw) >= MIN_HEX:
        is_hex = _HEX[raw]
        first = is_hex.copy()
        first[1:] &= ~is_hex[:-1]
        cut = off[:-1][off[:-1] < len(raw)]
        first[cut] = is_hex[cut]
        last = is_hex.copy()
        last[:-1] &= ~is_hex[1:]
        cut = off[1:][off[1:] > 0] - 1
        last[cut] = is_hex[cut]
        a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
        long = b - a >= MIN_HEX
        a, b = a[long], b[long]
        rows = np.searchsorted(off, a, side="right") - 1
        found += [(r, x, y, 2) for r, x, y in zip(rows.tolist(), a.tolist(), b.tolist(), strict=True)]
    found.sort(key=lambda s: (s[0], s[1], s[3]))
    return found


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind_of = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for first, raw, off in buffers(batch.column(1)):
            place, places = -1, None
            for row, a, b, kind in scan_buffer(raw, off):
                if row != place:
                    place, base = row, int(off[row])
                    places = np.cumsum((raw[base : int(off[row + 1])] & 0xC0) != 0x80)
                out[first + row].append({"kind": KINDS[kind], "start": int(places[a - base]) - 1, "end": int(places[b - 1 - base])})
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(kind_of))], names=["id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id and ``spans``, an array of (kind, start,
    end) in code points, end exclusive, by start and then in KINDS' order.

    assign, access and hex are the base kinds: leftmost matches that don't
    overlap within a kind, of which those that are too short are dropped after
    matching.  github and npm tokens count only if the CRC-32 in their last six
    characters fits.  Spans of different kinds may overlap.  A null or empty
    text has no span; ids may be null or repeat; each row is on its own; other
    columns are not looked at; an empty table gives no rows."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("t"))
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("spans", SPANS)])
    return src.mapInArrow(tidy(_spans), schema).withColumnRenamed("id", id_col)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@production
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = _joined(F.filter("spans", lambda s: s["kind"].isin(*BASE)))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(base, 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
