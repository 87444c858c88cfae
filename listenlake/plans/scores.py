"""Registered queries of audio and candidate scores and their SQL twins, on measures made from the library's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from listenlake.catalog import oracle
from listenlake.functions import scores as S
from listenlake.plans.base import bind

QUERIES, ORACLE = {}, {}

#: Measures in SQL that both engines read alike.
_MEASURES = """SELECT sha_id, bpm AS tempo, energy / 350.0 AS energy, key_mode = 'major' AS major, 1000 + danceability * 35 AS brightness,
  instrumentalness / 600.0 AS percussiveness, speechiness / 3.0 AS contrast, energy / 300.0 AS rms, 900 + speechiness * 43 AS centroid, instrumentalness / 45.0 AS onset,
  danceability / 110.0 AS flux, energy / 101.0 AS beat, speechiness / 107.0 AS stability, instrumentalness / 103.0 AS regularity, CAST(danceability AS DOUBLE) AS off_beat,
  CAST(energy AS DOUBLE) AS on_beat, instrumentalness / 1300.0 AS flatness, energy / 109.0 AS harmonic, speechiness * 6100.0 AS bandwidth_var, danceability / 600.0 AS crossings,
  -speechiness / 2.0 AS vocal, -energy / 1.7 AS other, instrumentalness * 0.7 AS mfcc_var, danceability / 3.0 - 2 AS low_contrast, bpm > 120 AS vocal_pitch FROM audio_features"""
_CANDIDATES = """SELECT o_custkey AS key, o_orderkey AS release_id, CAST(o_orderkey % 7 AS INT) AS place, o_custkey % 4 <> 0 AS has_artist, CAST(o_orderkey % 41 AS DOUBLE) / 40 AS track_title,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST(o_orderkey % 23 AS DOUBLE) / 22 END AS artist, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 19 AS DOUBLE) / 18 END AS album,
  CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE CAST(100 + o_custkey % 200 AS INT) END AS expected, CAST(95 + o_custkey % 200 + o_orderkey % 17 AS INT) AS found,
  CASE WHEN o_orderkey % 13 = 0 THEN 'heading' WHEN o_orderkey % 13 < 6 THEN 'track' END AS kind, CAST(40 + o_orderkey % 61 AS INT) AS score,
  o_orderpriority || CASE o_orderkey % 6 WHEN 0 THEN ' Album' WHEN 1 THEN ' LP' WHEN 2 THEN ' EP' WHEN 3 THEN ' Single' WHEN 4 THEN ' Compilation' ELSE '' END AS format_1,
  CASE o_orderkey % 4 WHEN 0 THEN 'CD' WHEN 1 THEN 'Vinyl 12' ELSE 'File' END AS format_2 FROM orders"""


def _measured(c):
    return c.spark.sql(_MEASURES.replace("FROM audio_features", "FROM {a}"), a=c.audio_features)


def _candidates(c):
    rows = c.spark.sql(_CANDIDATES.replace("FROM orders", "FROM {o}"), o=c._stored["orders"])
    return rows.withColumn("formats", F.array("format_1", "format_2")).drop("format_1", "format_2")


def audio_scores(c):
    m = _measured(c).withColumn("groove", S.groove(F.col("off_beat"), F.col("on_beat")))
    of = lambda f, *names: f(*[F.col(n) for n in names])
    return m.select(
        "sha_id", of(S.energy, "rms", "centroid", "onset", "flux").alias("energy"), of(S.danceability, "beat", "stability", "regularity", "groove", "tempo").alias("danceability"),
        of(S.acousticness, "flatness", "harmonic", "bandwidth_var", "crossings").alias("acousticness"),
        of(S.instrumentalness, "vocal", "other", "mfcc_var", "low_contrast", "vocal_pitch").alias("instrumentalness"),
    )


def mood_scores(c):
    out = S.moods(_measured(c))
    return out.select("sha_id", "mood_primary", "mood_secondary", *[F.col("mood_scores")[m].alias(m) for m in S.MOODS])


def recording_matches(c):
    total = S.recording_score(*[F.col(x) for x in ("score", "track_title", "artist", "has_artist", "expected", "found")])
    rows = _candidates(c).withColumn("total", total).where("total IS NOT NULL")
    best = rows.groupBy("key").agg(F.min_by(F.struct("release_id", "total"), F.struct(-F.col("total"), "release_id")).alias("b"))
    return best.select("key", F.col("b.release_id").alias("recording_id"), F.round("b.total", 6).alias("total"))


QUERIES["u11_audio_scores"] = bind(audio_scores)
_pct = lambda x: f"CAST(greatest(0, least(100, round_even(({x}) * 100, 0))) AS INT)"
_scaled = lambda c, a, b: f"greatest(0.0, least(1.0, ({c} - {a}) / ({b - a}::DOUBLE)))"
ORACLE["u11_audio_scores"] = oracle(f"""WITH m AS ({_MEASURES}), g AS (SELECT *, CASE WHEN on_beat = 0 THEN 0.5 WHEN off_beat / on_beat < 0.1 OR off_beat / on_beat > 0.9 THEN 0.3 ELSE 1 - abs(off_beat / on_beat - 0.5) * 2 END AS groove FROM m)
SELECT sha_id, {_pct(f"0.4::DOUBLE * {_scaled('rms', 0, 0.3)} + 0.3::DOUBLE * {_scaled('centroid', 1000, 5000)} + 0.2::DOUBLE * {_scaled('onset', 0, 2)} + 0.1::DOUBLE * {_scaled('flux', 0, 1)}")} AS energy,
  {_pct("(0.4::DOUBLE * beat + 0.3::DOUBLE * stability + 0.2::DOUBLE * regularity + 0.1::DOUBLE * groove) * CASE WHEN tempo < 115 THEN greatest(0.5::DOUBLE, 1 - (115 - tempo) / 50) WHEN tempo > 130 THEN greatest(0.6::DOUBLE, 1 - (tempo - 130) / 60) ELSE 1.0 END")} AS danceability,
  {_pct("0.35::DOUBLE * (1 - least(1.0, flatness * 10)) + 0.3::DOUBLE * harmonic + 0.2::DOUBLE * CASE WHEN bandwidth_var < 500000 THEN least(1.0, bandwidth_var / 100000) ELSE 0.5 END + 0.15::DOUBLE * CASE WHEN crossings > 0.02 AND crossings < 0.15 THEN 1 - abs(crossings - 0.08::DOUBLE) * 10 ELSE 0.3 END")} AS acousticness,
  {_pct("1 - (0.35::DOUBLE * CASE WHEN other = 0 THEN 0.5 ELSE least(1.0, vocal / other / 1.5::DOUBLE) END + 0.3::DOUBLE * least(1.0, mfcc_var / 50) + 0.2::DOUBLE * CASE WHEN low_contrast > 0 THEN least(1.0, low_contrast / 25) ELSE 0.5 END + 0.15::DOUBLE * CAST(vocal_pitch AS INT))")} AS instrumentalness FROM g""", "audio_features")

QUERIES["u11_moods"] = bind(mood_scores)
_raw = {
    "happy": "CASE WHEN major AND tempo > 100 AND energy > 0.08 THEN 0.5 + 0.3 * least(1, tempo / 140) + 0.2 * least(1, energy / 0.2) ELSE 0 END",
    "sad": "CASE WHEN NOT major AND tempo < 100 AND energy < 0.15 THEN 0.5 + 0.3 * (1 - tempo / 100) + 0.2 * (1 - energy / 0.15) ELSE 0 END",
    "energetic": "CASE WHEN tempo > 115 AND energy > 0.12 THEN 0.4 + 0.35 * least(1, energy / 0.25) + 0.25 * least(1, tempo / 160) ELSE 0 END",
    "calm": "CASE WHEN tempo < 95 AND energy < 0.12 THEN 0.5 + 0.3 * (1 - tempo / 95) + 0.2 * (1 - energy / 0.12) ELSE 0 END",
    "aggressive": "CASE WHEN energy > 0.18 AND percussiveness > 0.08 AND tempo > 100 THEN 0.4 + 0.4 * least(1, energy / 0.3) + 0.2 * least(1, percussiveness / 0.15) ELSE 0 END",
    "romantic": "CASE WHEN tempo > 70 AND tempo < 110 AND energy > 0.05 AND energy < 0.15 THEN CASE WHEN major THEN 0.6 ELSE 0.4 END + 0.2 * (1 - abs(tempo - 90) / 40) ELSE 0 END",
    "dark": "CASE WHEN NOT major AND brightness < 2500 AND energy < 0.2 THEN 0.5 + 0.3 * (1 - brightness / 2500) + 0.2 * (1 - energy / 0.2) ELSE 0 END",
    "uplifting": "CASE WHEN major AND tempo > 90 AND energy > 0.1 THEN least(1, 0.4 + CASE WHEN tempo > 110 THEN 0.15 ELSE 0 END + CASE WHEN contrast > 20 THEN 0.15 ELSE 0 END + 0.1 * least(1, energy / 0.2)) ELSE 0 END",
}
_names = list(_raw)
ORACLE["u11_moods"] = oracle(f"""WITH m AS ({_MEASURES}), r AS (SELECT sha_id, {', '.join(f'CAST({v} AS DOUBLE) AS {k}' for k, v in _raw.items())} FROM m),
s AS (SELECT sha_id, {', '.join(f'CASE WHEN top > 0 THEN floor({k} / top * 100 + 0.5) / 100 ELSE 0 END AS {k}' for k in _names)} FROM (SELECT *, greatest({', '.join(_names)}) AS top FROM r)),
l AS ({' UNION ALL '.join(f"SELECT sha_id, '{k}' AS mood, {k} AS v, {i} AS no FROM s" for i, k in enumerate(_names))}), o AS (SELECT *, row_number() OVER (PARTITION BY sha_id ORDER BY v DESC, no) AS n FROM l)
SELECT s.*, (SELECT max(mood) FROM o WHERE o.sha_id = s.sha_id AND n = 1 AND v > 0) AS mood_primary, (SELECT max(mood) FROM o WHERE o.sha_id = s.sha_id AND n = 2 AND v > 0.3) AS mood_secondary FROM s""", "audio_features")

_FITS = "(expected IS NULL OR found IS NULL OR abs(expected - found) <= greatest(5, CAST(floor(expected * 0.05) AS INT)))"
QUERIES["u07_recording_matches"] = bind(recording_matches)
ORACLE["u07_recording_matches"] = f"""WITH c AS ({_CANDIDATES}), t AS (SELECT key, release_id, CASE WHEN has_artist THEN score * 0.3 + 25 * track_title + 45 * coalesce(artist, 0) ELSE score * 0.5 + 40 * track_title + 10 * coalesce(artist, 0) END
  + CASE WHEN expected IS NOT NULL AND found IS NOT NULL THEN 5 ELSE 0 END AS total FROM c WHERE score >= 75 AND {_FITS} AND CASE WHEN has_artist THEN track_title >= 0.72 AND coalesce(artist, 0) >= 0.6 ELSE track_title >= 0.85 END)
SELECT key, release_id AS recording_id, round(CAST(total AS DOUBLE), 6) AS total FROM t QUALIFY row_number() OVER (PARTITION BY key ORDER BY total DESC, release_id) = 1"""

QUERIES["u09_release_scores"] = bind(lambda c: S.best_release(_candidates(c)).select("key", "release_id", F.round(F.col("total").cast("double"), 6).alias("total")))
ORACLE["u09_release_scores"] = f"""WITH c AS (SELECT *, lower(format_1 || ' ' || format_2) AS f FROM ({_CANDIDATES}) WHERE kind IS NULL OR kind = 'track'),
t AS (SELECT *, track_title + CASE WHEN expected IS NULL THEN 0 WHEN {_FITS} THEN 0.1 ELSE -0.2 END AS track,
  CASE WHEN contains(f, 'album') OR contains(f, 'lp') THEN 10 WHEN contains(f, 'ep') THEN 5 WHEN contains(f, 'single') THEN 2 WHEN contains(f, 'compilation') THEN -5 ELSE 0 END
  + CASE WHEN contains(f, 'cd') THEN 2 WHEN contains(f, 'vinyl') THEN 1 ELSE 0 END AS points FROM c),
r AS (SELECT key, release_id, artist, has_artist, track_title, CASE WHEN has_artist THEN 35 * track_title + 40 * coalesce(artist, 0) + 10 * coalesce(album, 0) + points + 5 * track
  ELSE 50 * track_title + 15 * coalesce(artist, 0) + 15 * coalesce(album, 0) + points + 10 * track END AS total FROM t WHERE track > 0)
SELECT key, release_id, round(CAST(total AS DOUBLE), 6) AS total FROM r WHERE track_title >= 0.72 AND (NOT has_artist OR artist IS NULL OR artist >= 0.6) AND total >= 70
QUALIFY row_number() OVER (PARTITION BY key ORDER BY total DESC, release_id) = 1"""
