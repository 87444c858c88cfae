"""Tags of MP3 files: ID3v2.3 and 2.4 frames and the length of the audio, read from binary files inside tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from listenlake.runtime import ship_package
from listenlake.sources.audio import list_audio
from listenlake.sources.files import release_year, track_number

#: Text encodings by their number, and the genres that tags name by number.
ENCODINGS = ["latin-1", "utf-16", "utf-16-be", "utf-8"]
GENRES = [
    "Blues", "Classic Rock", "Country", "Dance", "Disco", "Funk", "Grunge", "Hip-Hop", "Jazz", "Metal", "New Age", "Oldies", "Other", "Pop", "R&B", "Rap",
    "Reggae", "Rock", "Techno", "Industrial", "Alternative", "Ska", "Death Metal", "Pranks", "Soundtrack", "Euro-Techno", "Ambient", "Trip-Hop", "Vocal", "Jazz+Funk", "Fusion", "Trance",
    "Classical", "Instrumental", "Acid", "House", "Game", "Sound Clip", "Gospel", "Noise", "Alt. Rock", "Bass", "Soul", "Punk", "Space", "Meditative", "Instrumental Pop", "Instrumental Rock",
    "Ethnic", "Gothic", "Darkwave", "Techno-Industrial", "Electronic", "Pop-Folk", "Eurodance", "Dream", "Southern Rock", "Comedy", "Cult", "Gangsta Rap", "Top 40", "Christian Rap", "Pop/Funk", "Jungle",
    "Native American", "Cabaret", "New Wave", "Psychedelic", "Rave", "Showtunes", "Trailer", "Lo-Fi", "Tribal", "Acid Punk", "Acid Jazz", "Polka", "Retro", "Musical", "Rock & Roll", "Hard Rock",
]
#: Kilobits a second of layer III by index, for version 1 and for versions 2 and 2.5; samples a second of version 1.
KBITS = {1: [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320], 2: [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160]}
HERTZ = [44100, 48000, 32000]


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _values(body: bytes) -> list[str]:
    """The values of a text frame, parted by its encoding's zero."""
    encoding = ENCODINGS[body[0]] if body and body[0] < len(ENCODINGS) else "latin-1"
    text = body[1:].decode(encoding, "replace")
    return [x for x in (v.lstrip("﻿").strip() for v in text.split("\0")) if x]


def frames(content: bytes) -> tuple[list[tuple[str, bytes]], int]:
    """The frames (id, body) of a file's tag, and where the audio begins; a tag that breaks off gives the frames before the break."""
    if content[:3] != b"ID3" or len(content) < 10 or content[3] not in (3, 4):
        return [], 0
    version, flags, end = content[3], content[5], 10 + _syncsafe(content[6:10])
    data = content[10:end]
    if version == 3 and flags & 0x80:
        data = data.replace(b"\xff\x00", b"\xff")
    at, out = 0, []
    if flags & 0x40 and len(data) >= 4:
        at = _syncsafe(data[:4]) if version == 4 else 4 + int.from_bytes(data[:4], "big")
    while at + 10 <= len(data) and data[at : at + 4].isalnum():
        size = _syncsafe(data[at + 4 : at + 8]) if version == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : at + 10 + size]
        if len(body) < size:
            break
        if version == 4 and (data[at + 9] & 0x02 or flags & 0x80):
            body = body.replace(b"\xff\x00", b"\xff")
        if version == 4 and data[at + 9] & 0x01:
            body = body[4:]  # the length before unsynchronisation
        out.append((data[at : at + 4].decode("latin-1"), body))
        at += 10 + size
    return out, min(end + (10 if version == 4 and flags & 0x10 else 0), len(content))


def _genres(values: list[str]) -> list[str]:
    """Genres, with numbers and "(n)" named; text after "(n)" refines it and stands for itself."""
    out = []
    for v in values:
        numbers = re.findall(r"\((\d+)\)", v) if v.startswith("(") else [v] if v.isdigit() else []
        rest = re.sub(r"^(?:\(\d+\))+", "", v) if numbers and v.startswith("(") else "" if numbers else v
        out += [GENRES[int(n)] if int(n) < len(GENRES) else n for n in numbers] + ([rest] if rest else [])
    return list(dict.fromkeys(out))


def length(content: bytes, at: int) -> float | None:
    """Seconds of layer III audio: from the frame count that the first frame may hold, else from its bit rate; None without a frame."""
    while (at := content.find(b"\xff", at)) >= 0 and at + 4 <= len(content):
        h = int.from_bytes(content[at : at + 4], "big")
        version, layer, kbits, hertz = h >> 19 & 3, h >> 17 & 3, h >> 12 & 15, h >> 10 & 3
        if h >> 21 == 0x7FF and version != 1 and layer == 1 and 0 < kbits < 15 and hertz < 3:
            first = version == 3
            rate, samples = HERTZ[hertz] >> {3: 0, 2: 1, 0: 2}[version], 1152 if first else 576
            mono = h >> 6 & 3 == 3
            side = at + 4 + ((17 if mono else 32) if first else (9 if mono else 17))
            if content[side : side + 4] in (b"Xing", b"Info") and content[side + 7 : side + 8] and content[side + 7] & 1:
                return int.from_bytes(content[side + 8 : side + 12], "big") * samples / rate
            return (len(content) - at) * 8 / (KBITS[1 if first else 2][kbits] * 1000)
        at += 1
    return None


def parse(content: bytes) -> dict:
    """A file's tags as texts and lists; what it doesn't say is None or empty."""
    found, audio = frames(content)
    texts: dict[str, list[str]] = {}
    for kind, body in found:
        if kind == "TXXX":
            name, *values = _values(body) or [""]
            texts.setdefault(f"TXXX:{name.lower()}", values)
        elif kind[0] == "T" or kind == "IPLS":
            texts.setdefault(kind, _values(body))
    people = [p for kind in ("TIPL", "IPLS") for p in [texts.get(kind, [])]]
    producers = [who for p in people for role, who in zip(p[::2], p[1::2]) if role.lower() == "producer"]
    first = lambda *kinds: next((texts[k][0] for k in kinds if texts.get(k)), None)
    every = lambda *kinds: next((texts[k] for k in kinds if texts.get(k)), [])
    return {
        "title": first("TIT2"), "album": first("TALB"), "artists": every("TPE1", "TPE2"), "genres": _genres(every("TCON")), "labels": every("TXXX:label", "TPUB"),
        "producers": producers or every("TXXX:producer"), "date": first("TDRC", "TYER"), "track": first("TRCK"), "seconds": length(content, audio),
    }


_LISTS = ("artists", "genres", "labels", "producers")
_RAW = pa.schema([("path", pa.string()), ("sha_id", pa.string()), ("title", pa.string()), ("album", pa.string()), *[(c, pa.list_(pa.string())) for c in _LISTS], ("date", pa.string()), ("track", pa.string()), ("seconds", pa.float64())])


def tagged(files: DataFrame) -> DataFrame:
    """Songs of binary files (path, content): sha_id of the content, title (else the file's stem), album, artists, genres, labels, producers, duration_sec, release_year, track_number.

    Of artists and album artists the first kind that is there counts, likewise of the label fields. Files without a tag, or with a broken
    one, keep what can be read. A file's content passes through one task and isn't shuffled.
    """
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"path": p, "sha_id": s} | parse(c or b"") for p, s, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=_RAW)

    kinds = ", ".join(f"{c} array<string>" for c in _LISTS)
    raw = files.select("path", F.sha2("content", 256).alias("sha_id"), "content").mapInArrow(run, f"path string, sha_id string, title string, album string, {kinds}, date string, track string, seconds double")
    stem = F.regexp_replace(F.regexp_replace("path", r"^.*/", ""), r"\.[^.]*$", "")
    seconds = F.bround("seconds").cast("int")
    return raw.select("sha_id", "path", F.coalesce("title", stem).alias("title"), "album", *_LISTS, seconds.alias("duration_sec"), release_year("date").alias("release_year"), track_number("track").alias("track_number"))


def read_tags(spark: SparkSession, root: str) -> DataFrame:
    """The tags of all MP3 files below a folder; files of no bytes are not read."""
    return tagged(list_audio(spark, root))


def ingested(songs: DataFrame) -> dict[str, DataFrame]:
    """Tagged files as tables: songs (one a content), and (sha_id, name) of their artists, genres, labels and producers, the first artist primary."""
    one = songs.dropDuplicates(["sha_id"])
    names = lambda c: one.select("sha_id", F.posexplode(F.array_distinct(c)).alias("no", "name"))
    role = F.when(F.col("no") == 0, "primary").otherwise("featured").alias("role")
    plain = {c: names(c).select("sha_id", "name") for c in _LISTS[1:]}
    return {"songs": one.select("sha_id", "title", "album", "duration_sec", "release_year", "track_number"), "artists": names("artists").select("sha_id", "name", role)} | plain
