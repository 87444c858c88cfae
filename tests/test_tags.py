from listenlake.sources import tags as T


def sync(n):
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def frame(version, kind, body):
    return kind.encode() + (sync(len(body)) if version == 4 else len(body).to_bytes(4, "big")) + b"\0\0" + body


def tag(version, *parts, flags=0, before=b""):
    data = before + b"".join(parts) + b"\0" * 20
    if flags & 0x80:
        data = data.replace(b"\xff", b"\xff\0")
    return b"ID3" + bytes([version, 0, flags]) + sync(len(data)) + data


def audio(frames, xing=None, kbits=9, head=0xFFFB0000):
    h = (head | kbits << 12).to_bytes(4, "big")
    first = h + b"\0" * 32 + (b"Xing" + (1).to_bytes(4, "big") + xing.to_bytes(4, "big") if xing else b"") + b"\0" * 100
    return first.ljust(417, b"\0") + (h + b"\0" * 413) * (frames - 1)


def test_files_written_here_read_back(spark, tmp_path):
    utf16 = lambda x: b"\1" + x.encode("utf-16")
    utf8 = lambda *x: b"\3" + "\0".join(x).encode()
    files = {
        "one.mp3": tag(3, frame(3, "TIT2", utf16("Déjà vu")), frame(3, "TALB", b"\0Caf\xe9"), frame(3, "TPE1", utf16("Ann")), frame(3, "TPE2", utf16("Various")), frame(3, "TCON", b"\0(17)(4)Own"), frame(3, "TYER", b"\x001999"), frame(3, "TRCK", b"\x003/12"), frame(3, "IPLS", b"\0Producer\0Pat\0mixer\0Max")) + audio(100),
        "two.mp3": tag(4, frame(4, "TIT2", utf8("Two")), frame(4, "TPE1", utf8("Ann", "Bob", "Ann")), frame(4, "TCON", utf8("Jazz", "17", "200")), frame(4, "TDRC", utf8("2001-05-06")), frame(4, "TXXX", utf8("LABEL", "Best", "Second")), frame(4, "TPUB", utf8("Other")), frame(4, "TIPL", utf8("producer", "Q", "producer", "R"))) + audio(10, xing=2000),
        "sub/The + stem%41.mp3": audio(50),
        "unsynced.mp3": tag(3, frame(3, "TIT2", utf16("ÿx")), flags=0x80) + audio(2),
        "extended.mp3": tag(4, frame(4, "TIT2", utf8("Ext")), flags=0x40, before=sync(6) + b"\1\0"),
        "broken.mp3": tag(3, frame(3, "TIT2", utf16("Begun")), frame(3, "TALB", b"\0album")[:14])[:-20],
        "nothing.mp3": b"x",
        "album only.mp3": tag(4, frame(4, "TPE2", utf8("Band")), frame(4, "TIT2", utf8(" ")), frame(4, "TRCK", utf8("x"))),
    }
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r.path.rsplit("/", 1)[-1]: r for r in T.read_tags(spark, str(tmp_path)).collect()}
    assert set(got) == {n.rsplit("/", 1)[-1] for n in files}
    one, two = got["one.mp3"], got["two.mp3"]
    assert (one.title, one.album, one.artists, one.genres, one.labels, one.producers, one.release_year, one.track_number) == ("Déjà vu", "Café", ["Ann"], ["Rock", "Disco", "Own"], [], ["Pat"], 1999, 3)
    assert one.duration_sec == round(100 * 417 * 8 / 128_000)
    assert (two.title, two.artists, two.genres, two.labels, two.producers, two.release_year, two.track_number) == ("Two", ["Ann", "Bob", "Ann"], ["Jazz", "Rock", "200"], ["Best", "Second"], ["Q", "R"], 2001, None)
    assert two.duration_sec == round(2000 * 1152 / 44100)
    titles = {r.title for r in got.values()}
    assert {"The + stem%41", "ÿx", "Ext", "Begun", "nothing", "album only"} <= titles
    assert got["album only.mp3"].artists == ["Band"] and got["album only.mp3"].track_number is None and got["nothing.mp3"].duration_sec is None
    tables = T.ingested(T.read_tags(spark, str(tmp_path)))
    assert sorted((r.name, r.role) for r in tables["artists"].where(f"sha_id = '{two.sha_id}'").collect()) == [("Ann", "primary"), ("Bob", "featured")]
    assert tables["songs"].count() == len(files) and tables["producers"].count() == 3


def test_lengths_of_other_versions():
    assert T.length(audio(10, head=0xFFF30000, kbits=4), 0) == len(audio(10)) * 8 / 32_000  # version 2
    assert T.length(b"\xff" * 50 + b"no audio", 0) is None and T.length(b"", 0) is None
