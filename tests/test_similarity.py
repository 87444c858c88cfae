"""The similarity queries against plain Python over the same tables."""

import numpy as np
import pytest

from listenlake.catalog import Catalog
from listenlake.operators import rules as R, similarity as V, tables as M
from listenlake.plans import browse
from listenlake.plans.base import AS_OF


@pytest.fixture(scope="module")
def lib(spark, sf):
    c = Catalog.testdata(spark, sf)
    songs = {r.sha_id: r for r in c.songs.collect()}
    artist = {}
    for r in sorted(c.primary.collect(), key=lambda r: r.artist_id):
        artist.setdefault(r.sha_id, r.artist)
    vectors = {r.sha_id: np.array(r.vector, np.float64) for r in c.vectors.collect() if r.sha_id in songs}
    return c, songs, artist, vectors


def cosine(a, b):
    n = np.linalg.norm(a) * np.linalg.norm(b)
    return float(a @ b / n) if n else 0.0


def ranked(vectors, q, without, n):
    return sorted(((cosine(v, q), i) for i, v in vectors.items() if i not in without), key=lambda x: (-x[0], x[1]))[:n]


def chosen(lib, found, limit):
    """Greedy: three of an album, five of an artist, unknown ones free."""
    _, songs, artist, _ = lib
    albums, artists, out = {}, {}, []
    for score, i in found:
        who = artist.get(i)
        album = (songs[i].album.lower(), who.lower() if who else None) if songs[i].album and who else None
        if len(out) == limit or albums.get(album, 0) >= 3 or artists.get(who, 0) >= 5:
            continue
        if album is not None:
            albums[album] = albums.get(album, 0) + 1
        if who is not None:
            artists[who] = artists.get(who, 0) + 1
        out.append((len(out), i, round(score, 9)))
    return out


def rows(df):
    return [(r.position, r.sha_id, round(r.score, 9)) for r in df.orderBy("position").collect()]


def test_song_and_artist_radio(spark, sf, lib):
    c, _, _, vectors = lib
    assert rows(browse.QUERIES["v03_song_radio"](spark, sf)) == chosen(lib, ranked(vectors, vectors["5"], {"5"}, 60), 20)
    own = {r.sha_id for r in c.song_artists.where("artist_id = 3").collect()}
    q = np.mean([vectors[i] for i in own if i in vectors], axis=0)
    assert rows(browse.QUERIES["v05_artist_radio"](spark, sf)) == chosen(lib, ranked(vectors, q, own, 60), 20)


def liked_minus_disliked(lib, up, down, limit):
    *_, vectors = lib
    mean = lambda own: sum(w * vectors[i] for i, w in own if i in vectors) / sum(w for i, w in own if i in vectors)
    found = ranked(vectors, mean(up), {i for i, _ in up + down}, 5 * limit)
    away = mean(down)
    return chosen(lib, sorted(((s - 0.5 * cosine(vectors[i], away), i) for s, i in found), key=lambda x: (-x[0], x[1])), limit)


def test_preferences(spark, sf, lib):
    assert rows(browse.QUERIES["v06_preferences"](spark, sf)) == liked_minus_disliked(lib, [("1", 1.0), ("2", 1.0), ("3", 1.0)], [("9", 1.0)], 20)


def test_for_you(spark, sf, lib):
    c = lib[0]
    from datetime import timedelta

    plays = [r for r in c.play_sessions.collect() if AS_OF - timedelta(days=30) <= r.started_at < AS_OF]
    half = [r for r in plays if r.started_at >= AS_OF - timedelta(days=15)]

    def top(own, least, n, weight):
        count = {}
        for r in own:
            count[r.sha_id] = count.get(r.sha_id, 0) + 1
        return [(i, weight) for i, k in sorted(count.items(), key=lambda x: (-x[1], x[0])) if k >= least][:n]

    up = [(i, 1.0) for i in "123"] + top(plays, 3, 50, 0.8) + top([r for r in half if r.completed or r.completion_percent >= 80], 1, 30, 0.7)
    down = [("9", 1.0)] + top([r for r in plays if r.skipped or r.completion_percent < 30], 2, 30, 0.5)
    assert rows(browse.QUERIES["v07_for_you"](spark, sf)) == liked_minus_disliked(lib, up, down, 20)


def test_songs_most_similar_to_one_as_a_rule(spark, lib):
    c, _, _, vectors = lib
    k = R.Compiler(c, AS_OF, similar=lambda song, n: V.similar_songs(c, song, n))
    rule = R.parse(R._rule(("similar_to", "top_n", {"sha_id": "5", "count": 12})))
    assert {r.sha_id for r in k.select(rule).collect()} == {i for _, i in ranked(vectors, vectors["5"], {"5"}, 12)}
    assert R.Compiler(c, AS_OF).select(rule).count() == 0  # nothing to ask


def test_sampled_features_are_rows_of_the_table(spark, sf, lib):
    from listenlake.registry import QUERIES

    sample = QUERIES["a13_sample"](spark, sf)
    out = [tuple(r) for r in sample.collect()]
    all_ = {tuple(r) for r in lib[0].audio_features.select(*sample.columns).collect()}
    assert len(out) == len(set(out)) > 0 and set(out) <= all_


def test_get_or_create_keeps_known_ids_and_makes_new_ones(spark):
    known = spark.createDataFrame([(3, "Ann"), (9, "Bob")], "artist_id long, name string")
    names = spark.createDataFrame([("Bob",), (" Cy ",), ("Cy",), ("Dee",), ("",), (None,)], "name string")
    out = {r.name: r.artist_id for r in M.get_or_create(known, names, "artist_id", "name").collect()}
    again = {r.name: r.artist_id for r in M.get_or_create(known, names.where("name <> ''"), "artist_id", "name").collect()}
    assert out["Ann"] == 3 and out["Bob"] == 9 and set(out) == {"Ann", "Bob", "Cy", "Dee"} and len(set(out.values())) == 4 and out == again
