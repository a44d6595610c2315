"""Binary carriers as entries: bytes in, rows out, in Arrow batches; broken input gives a status row, never an error."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OUT = "asset_id long, order_in_block int, key_kind string, ifd string, tag int, record int, dataset int, num_key long, name string, v_text string, v_num double, v_bytes binary, status string"
_COLS = [c.split()[0] for c in OUT.split(", ")]
#: Most bytes that a compressed chunk may inflate to.
INFLATE_LIMIT = 1 << 26
# Bytes of a TIFF value by wire type, and struct codes of the numeric ones.
_WIDTH = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8, 13: 4, 16: 8, 17: 8, 18: 8, 129: 1}
_CODE = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
_POINTERS = {0x8769: "exififd", 0x8825: "gpsifd", 0xA005: "interopifd", 0x014A: "subifd"}
_SIGNATURES = ((b"\xff\xd8\xff", "jpeg"), (b"\x89PNG\r\n\x1a\n", "png"), (b"GIF87a", "gif"), (b"GIF89a", "gif"), (b"II*\0", "tiff"), (b"MM\0*", "tiff"), (b"II+\0", "tiff"), (b"MM\0+", "tiff"), (b"FUJIFILMCCD-RAW", "raf"), (b"FOVb", "x3f"), (b"\0MRM", "mrw"))


def sniff(content: Column) -> Column:
    """Container format of a binary column by its first bytes."""
    out = F.lit("unsupported")
    head = F.substring(content, 1, 16)
    out = F.when((F.substring(head, 1, 4) == F.lit(b"RIFF")) & (F.substring(head, 9, 4) == F.lit(b"WEBP")), "webp").when(F.substring(head, 5, 4) == F.lit(b"ftyp"), "bmff").when(F.substring(head, 5, 4) == F.lit(b"jP  "), "jp2").when(F.substring(head, 5, 4) == F.lit(b"JXL "), "jxl").otherwise(out)
    for sig, name in reversed(_SIGNATURES):
        out = F.when(F.substring(head, 1, len(sig)) == F.lit(sig), name).otherwise(out)
    return out


def iptc(b: bytes) -> Iterator[dict]:
    at = 0
    while at + 5 <= len(b):
        if b[at] != 0x1C:
            yield {"status": "malformed"}
            return
        rec, ds, n = b[at + 1], b[at + 2], int.from_bytes(b[at + 3 : at + 5], "big")
        at += 5
        if n & 0x8000:  # an extended length of as many bytes
            w = n & 0x7FFF
            n = int.from_bytes(b[at : at + w], "big")
            at += w
        if at + n > len(b):
            yield {"status": "truncated"}
            return
        yield {"key_kind": "iptc_dataset", "record": rec, "dataset": ds, "v_bytes": b[at : at + n]}
        at += n
    if at < len(b):
        yield {"status": "truncated"}


def png(b: bytes) -> Iterator[dict]:
    at = 8
    while at + 12 <= len(b):
        n, kind = int.from_bytes(b[at : at + 4], "big"), b[at + 4 : at + 8]
        body = b[at + 8 : at + 8 + n]
        if len(body) < n:
            yield {"status": "truncated"}
            return
        if kind in (b"tEXt", b"zTXt", b"iTXt"):
            key, _, rest = body.partition(b"\0")
            packed, code = kind == b"zTXt", "latin-1"
            if kind == b"zTXt":
                rest = rest[1:]
            elif kind == b"iTXt":
                packed, code = rest[:1] == b"\1", "utf-8"
                rest = rest[2:].split(b"\0", 2)[-1]
            if packed:
                d = zlib.decompressobj()
                rest = d.decompress(rest, INFLATE_LIMIT)
                if d.unconsumed_tail:  # more than a row may hold: no part of it passes for the whole
                    yield {"key_kind": "png_text", "name": key.decode("latin-1"), "status": "too_long"}
                    at += 12 + n
                    continue
            yield {"key_kind": "png_text", "name": key.decode("latin-1"), "v_text": rest.decode(code, "replace")}
        at += 12 + n


def icc(b: bytes) -> Iterator[dict]:
    if len(b) < 132 or b[36:40] != b"acsp":
        yield {"status": "malformed"}
        return
    for off, n, name in ((0, 4, "size"), (8, 4, "version"), (12, 4, "class"), (16, 4, "space"), (64, 4, "intent")):
        raw = b[off : off + n]
        text = raw.decode("latin-1") if name in ("class", "space") else None
        yield {"key_kind": "icc_header_field", "num_key": off, "name": name, "v_text": text, "v_num": None if text else float(int.from_bytes(raw, "big"))}
    for i in range(int.from_bytes(b[128:132], "big")):
        row = b[132 + 12 * i : 144 + 12 * i]
        if len(row) < 12:
            yield {"status": "truncated"}
            return
        sig, off, n = struct.unpack(">III", row)
        yield {"key_kind": "icc_tag", "num_key": sig, "name": row[:4].decode("latin-1"), "v_bytes": b[off : off + n], "status": "ok" if off + n <= len(b) else "truncated"}


def tiff(b: bytes) -> Iterator[dict]:
    order = {b"II": "<", b"MM": ">"}.get(b[:2])
    if order is None or len(b) < 8:
        yield {"status": "malformed"}
        return
    big = struct.unpack(order + "H", b[2:4])[0] == 43
    word, entry, count = ("Q", 20, "Q") if big else ("I", 12, "H")
    width = struct.calcsize(word)
    todo, seen, n_ifd = [(struct.unpack_from(order + word, b, 8 if big else 4)[0], "")], set(), 0
    while todo:
        off, name = todo.pop(0)
        if not off or off in seen:
            continue
        seen.add(off)
        head = struct.calcsize(order + count)
        if off + head > len(b):
            yield {"status": "truncated", "ifd": name}
            continue
        if not name:
            name, n_ifd = f"ifd{n_ifd}", n_ifd + 1
        n = struct.unpack_from(order + count, b, off)[0]
        for i in range(n):
            at = off + head + entry * i
            if at + entry > len(b):
                yield {"status": "truncated", "ifd": name}
                break
            tag, kind, size = struct.unpack_from(order + "HH" + word, b, at)
            total = _WIDTH.get(kind, 0) * size
            start = at + 4 + width if total <= width else struct.unpack_from(order + word, b, at + 4 + width)[0]
            raw = b[start : start + total]
            if not total or len(raw) < total:
                yield {"status": "malformed" if not total else "truncated", "ifd": name, "tag": tag}
                continue
            row = {"key_kind": "exif_tag", "ifd": name, "tag": tag, "v_bytes": raw}
            if kind in (2, 129):
                row["v_text"] = raw.split(b"\0")[0].decode("utf-8", "replace")
            elif kind in (5, 10):
                num, den = struct.unpack_from(order + ("II" if kind == 5 else "ii"), raw)
                row |= {"v_text": f"{num}/{den}", "v_num": num / den if den else None}
            elif kind in _CODE:
                row["v_num"] = float(struct.unpack_from(order + _CODE[kind], raw)[0])
            yield row
            if tag in _POINTERS and kind in (4, 13, 16, 18):
                todo += [(v, _POINTERS[tag]) for v in struct.unpack_from(f"{order}{size}{_CODE[kind]}", raw)]
        else:
            tail = off + head + entry * n
            if name.startswith("ifd") and tail + width <= len(b):
                todo.append((struct.unpack_from(order + word, b, tail)[0], ""))


def jpeg(b: bytes) -> Iterator[dict]:
    """Segments before the image data: the marker, and what carrier it is."""
    at = 2
    kinds = ((0xE1, b"Exif\0\0", "exif"), (0xE1, b"http://ns.adobe.com/xap/1.0/\0", "xmp"), (0xE1, b"http://ns.adobe.com/xmp/extension/\0", "xmp_extended"), (0xE2, b"ICC_PROFILE\0", "icc"), (0xE2, b"MPF\0", "mpf"), (0xEB, b"JP", "jumbf"), (0xED, b"Photoshop 3.0\0", "photoshop_irb"), (0xFE, b"", "comment"))
    while at + 4 <= len(b) and b[at] == 0xFF:
        m, n = b[at + 1], int.from_bytes(b[at + 2 : at + 4], "big")
        if m == 0xFF:
            at += 1
            continue
        if m == 0xDA:
            return
        body = b[at + 4 : at + 2 + n]
        if n < 2 or at + 2 + n > len(b):
            yield {"status": "truncated"}
            return
        kind = next(((k, len(p)) for mk, p, k in kinds if mk == m and body.startswith(p)), None)
        if kind:
            yield {"key_kind": "block", "name": kind[0], "num_key": at + 4 + kind[1], "v_num": float(len(body) - kind[1]), "v_bytes": body[kind[1] :]}
        at += 2 + n


DECODERS: dict[str, Callable[[bytes], Iterator[dict]]] = {"iptc": iptc, "png": png, "icc": icc, "tiff": tiff, "jpeg": jpeg}


def decoded(binaries: DataFrame, kind: str) -> DataFrame:
    """binaries (asset_id, content) as entries of a decoder; a null content has no entries."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = DECODERS[kind]
        for batch in batches:
            rows = []
            for asset, content in zip(batch.asset_id, batch.content, strict=True):
                at = -1
                try:
                    for at, row in enumerate(decode(bytes(content)) if content is not None else ()):  # noqa: B007
                        rows.append({"asset_id": asset, "order_in_block": at, "status": "ok"} | row)
                except (struct.error, ValueError, zlib.error, IndexError):
                    rows.append({"asset_id": asset, "order_in_block": at + 1, "status": "malformed"})
            yield pd.DataFrame(rows, columns=_COLS).astype({c: "object" for c in _COLS})

    return binaries.select("asset_id", "content").mapInPandas(step, OUT)


def read_binaries(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below path as path, asset_id (a hash of the path), content and format."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return b.select("path", F.xxhash64("path").alias("asset_id"), "content").withColumn("format", sniff(F.col("content")))
