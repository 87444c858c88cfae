"""Registered rule queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from listenlake.catalog import Catalog, oracle
from listenlake.operators import refresh as RF, rules as R
from listenlake.plans.base import AS_OF, bind

QUERIES, ORACLE = {}, {}
_TABLES = ("songs", "play_sessions", "audio_features", "song_artists", "artists", "song_genres", "vectors")

_SUBJECT = """st AS (SELECT sha_id, count(*) AS play_count, max(started_at) AS last_played, count(*) FILTER (skipped) AS skip_count, avg(completion_percent) AS avg_completion,
  count(*) FILTER (started_at >= TIMESTAMP '2024-01-24') AS lw, count(*) FILTER (started_at >= TIMESTAMP '2024-01-17' AND started_at < TIMESTAMP '2024-01-24') AS pw FROM play_sessions GROUP BY 1),
 af AS (SELECT sha_id, bpm, energy, danceability, acousticness, key_mode, mood_primary FROM audio_features),
 x AS (SELECT s.*, coalesce(play_count, 0) AS play_count, last_played, coalesce(skip_count, 0) AS skip_count, avg_completion, coalesce(lw, 0) AS last_week_plays, coalesce(lw > pw, FALSE) AS trending, coalesce(lw < pw AND pw > 0, FALSE) AS declining, bpm, energy, danceability, acousticness, key_mode, mood_primary
  FROM songs s LEFT JOIN st ON s.sha_id = st.sha_id LEFT JOIN af ON s.sha_id = af.sha_id),
 art AS (SELECT sha_id, name FROM song_artists JOIN artists USING (artist_id)), liked AS (SELECT sha_id FROM songs WHERE release_year = 1990)"""


def compiler(c: Catalog) -> R.Compiler:
    liked = c.songs.where("release_year = 1990")
    return R.Compiler(c, AS_OF, liked=liked, members={"p1": c.songs.where("release_year = 1975")})


#: (field, operator, value, SQL predicate over x)
CASES = [
    ("title", "equals", "part 17", None), ("album", "not_equals", "Brand#11", None),
    ("title", "contains", "1", "title ILIKE '%1%'"), ("album", "not_contains", "2", "album NOT ILIKE '%2%'"), ("title", "starts_with", "p", "title ILIKE 'p%'"), ("title", "ends_with", "7", "title ILIKE '%7'"),
    ("title", "regex", "[0-4]$", "regexp_matches(title, '[0-4]$')"), ("duration_sec", "greater", 300, "duration_sec > 300"), ("duration_sec", "greater_or_equal", 300, "duration_sec >= 300"),
    ("duration_sec", "less", 180, "duration_sec < 180"), ("duration_sec", "less_or_equal", 180, "duration_sec <= 180"), ("release_year", "between", [1970, 1980], "release_year BETWEEN 1970 AND 1980"),
    ("release_year", "years_ago", 40, "release_year <= 1984"), ("track_number", "in_list", [1, 3], "track_number IN (1, 3)"), ("release_year", "not_in_list", [1990, 1991], "release_year NOT IN (1990, 1991)"),
    ("verified", "is_true", None, "verified"), ("verified", "is_false", None, "NOT verified"), ("album", "is_null", None, "album IS NULL"), ("album", "is_not_null", None, "album IS NOT NULL"),
    ("last_played", "before", "-10 days", "last_played < TIMESTAMP '2024-01-21'"), ("last_played", "after", "2024-01-20", "last_played > TIMESTAMP '2024-01-20'"), ("added_at", "within_days", 14, "created_at > TIMESTAMP '2024-01-17'"),
    ("last_played", "never", None, "last_played IS NULL"), ("genre", "same_as", "playlist:p1", "sha_id IN (SELECT sha_id FROM song_genres WHERE genre IN (SELECT genre FROM song_genres JOIN songs USING (sha_id) WHERE release_year = 1975))"),
    ("play_count", "equals", 0, "play_count = 0"), ("skip_count", "greater", 3, "skip_count > 3"), ("completion_rate", "less", 30, "avg_completion < 30"), ("last_week_plays", "greater", 2, "last_week_plays > 2"), ("trending", "is_true", None, "trending"), ("declining", "is_true", None, "declining"),
    ("artist", "not_equals", "Supplier#000000001", "sha_id IN (SELECT sha_id FROM art WHERE name <> 'Supplier#000000001')"), ("genre", "contains", "brass", "sha_id IN (SELECT sha_id FROM song_genres WHERE genre ILIKE '%brass%')"),
    ("is_liked", "is_true", None, "sha_id IN (SELECT sha_id FROM liked)"), ("is_liked", "is_false", None, "sha_id NOT IN (SELECT sha_id FROM liked)"), ("is_disliked", "is_true", None, "FALSE"), ("has_embedding", "is_true", None, "sha_id IN (SELECT sha_id FROM vectors)"), ("has_embedding", "is_false", None, "sha_id NOT IN (SELECT sha_id FROM vectors)"),
    ("bpm", "greater", 120, "bpm > 120"), ("mood", "equals", "STANDARD", "mood_primary = 'STANDARD'"), ("key_mode", "equals", "major", "key_mode = 'major'"),
]
CASES = [(f, o, v, s or f"{f} {'=' if o == 'equals' else '<>'} '{v}'") for f, o, v, s in CASES]


def operator_counts(c: Catalog):
    """How many songs each case matches, all in one pass."""
    return RF.counts(compiler(c), {f"{f} {o}": R.parse({"version": 1, "match": "all", "conditions": [{"field": f, "operator": o, "value": v}]}) for f, o, v, _ in CASES})


QUERIES["r01_operator_counts"] = bind(operator_counts)
ORACLE["r01_operator_counts"] = oracle(f"WITH {_SUBJECT} " + " UNION ALL ".join(f"SELECT '{f} {o}' AS rule, count(*) AS songs FROM x WHERE {s}" for f, o, _, s in CASES), *_TABLES)

_NESTED = {
    "version": 1, "match": "any",
    "conditions": [
        {"field": "artist", "operator": "ends_with", "value": "7"},
        {"match": "all", "conditions": [{"field": "play_count", "operator": "greater", "value": 8}, {"match": "any", "conditions": [{"field": "genre", "operator": "contains", "value": "brand#1"}, {"field": "energy", "operator": "less", "value": 40}]}]},
        {"match": "all", "conditions": []},
        {"field": "is_liked", "operator": "is_true"},
    ],
}
_RESULT = """SELECT CAST(row_number() OVER (ORDER BY {key} NULLS LAST, sha_id) - 1 AS INT) AS position, sha_id, title, (SELECT string_agg(DISTINCT name, ', ' ORDER BY name) FROM art WHERE art.sha_id = x.sha_id) AS artist, album, play_count, skip_count, round(avg_completion, 8) AS avg_completion FROM x WHERE {where}"""
QUERIES["r31_nested_rule"] = bind(lambda c: compiler(c).playlist(R.parse(_NESTED), "play_count", "desc", 100))
ORACLE["r31_nested_rule"] = oracle(f"WITH {_SUBJECT} " + _RESULT.format(key="play_count DESC", where="sha_id IN (SELECT sha_id FROM art WHERE name ILIKE '%7') OR (play_count > 8 AND (sha_id IN (SELECT sha_id FROM song_genres WHERE genre ILIKE '%brand#1%') OR energy < 40)) OR sha_id IN (SELECT sha_id FROM liked)") + " ORDER BY 1 LIMIT 100", *_TABLES)
_WHERE = {
    "Recently Added": ("created_at > TIMESTAMP '2024-01-01'", "created_at DESC"), "Heavy Rotation": ("play_count > 5 AND last_played > TIMESTAMP '2024-01-01'", "play_count DESC"),
    "Forgotten Favorites": ("sha_id IN (SELECT sha_id FROM liked) AND last_played < TIMESTAMP '2023-11-02'", "last_played"), "Never Played": ("play_count = 0", "created_at DESC"), "Short Songs": ("duration_sec < 180", "duration_sec"),
    "Long Songs": ("duration_sec > 420", "duration_sec DESC"), "Top Rated": ("avg_completion > 80 AND play_count > 3", "avg_completion DESC"), "Frequently Skipped": ("skip_count > 3 AND avg_completion < 50", "skip_count DESC"),
}
for _name, (_rules, _by, _order, _) in R.TEMPLATES.items():
    _key = "r45_" + _name.lower().replace(" ", "_")
    QUERIES[_key] = bind(lambda c, r=_rules, b=_by, o=_order: compiler(c).playlist(R.parse(r), b, o))
    ORACLE[_key] = oracle(f"WITH {_SUBJECT} " + _RESULT.format(where=_WHERE[_name][0], key=_WHERE[_name][1]), *_TABLES)
QUERIES["r46_suggest"] = bind(lambda c: R.suggest(c, c.songs.where("release_year BETWEEN 1970 AND 1975 AND album IS NOT NULL"), AS_OF))
ORACLE["r46_suggest"] = oracle("""
WITH s AS (SELECT * FROM songs WHERE release_year BETWEEN 1970 AND 1975 AND album IS NOT NULL), t AS (SELECT count(*) AS t FROM s),
 a AS (SELECT name AS v, count(DISTINCT sha_id) AS n FROM s JOIN song_artists USING (sha_id) JOIN artists USING (artist_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
 g AS (SELECT genre AS v, count(DISTINCT sha_id) AS n FROM s JOIN song_genres USING (sha_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
 r AS (SELECT count(*) AS n FROM s WHERE created_at >= TIMESTAMP '2024-01-01')
SELECT id, round(score, 6) AS score FROM (SELECT 'artist:' || v AS id, n / t AS score FROM a, t WHERE n >= 0.6 * t UNION ALL SELECT 'genre:' || v, n / t FROM g, t WHERE n >= 0.6 * t
 UNION ALL SELECT 'years:' || min(release_year) || '-' || max(release_year), 0.4 FROM s HAVING max(release_year) - min(release_year) <= 10 UNION ALL SELECT 'recent:30', n / t FROM r, t WHERE n >= 5 AND n >= 0.2 * t)""", "songs", "song_artists", "artists", "song_genres")


def _hundred() -> list[dict]:
    """A hundred playlists: plays, years, artists and genres in turn, by four keys, one in five with a limit."""
    out = []
    for i in range(100):
        rules = [("play_count", "greater_or_equal", i % 7), ("release_year", "greater", 1960 + i // 2)] if i % 2 else [("artist", "ends_with", str(i % 10)), ("genre", "contains", f"brand#{1 + i % 5}")]
        by, order = (("play_count", "desc"), ("title", "asc"), ("added_at", "desc"), ("album", "desc"))[i % 4]
        out.append({"playlist_id": f"p{i:02}", "rules": R._rule(*rules) | {"match": "all" if i % 3 else "any"}, "sort_by": by, "sort_order": order, "limit_count": 10 if i % 5 == 0 else None})
    return out


_MEMBERS = f"""WITH {_SUBJECT}, i AS (SELECT CAST(range AS INT) AS i FROM range(100)),
 a AS (SELECT DISTINCT sha_id, right(name, 1) AS digit FROM art), g AS (SELECT DISTINCT sha_id, k FROM song_genres, (SELECT range AS k FROM range(1, 6)) WHERE contains(lower(genre), 'brand#' || k)),
 t AS (SELECT i, x.*, CASE WHEN i % 2 = 1 THEN play_count >= i % 7 ELSE (sha_id, CAST(i % 10 AS VARCHAR)) IN (SELECT (sha_id, digit) FROM a) END AS one,
   CASE WHEN i % 2 = 1 THEN release_year > 1960 + i // 2 ELSE (sha_id, CAST(1 + i % 5 AS BIGINT)) IN (SELECT (sha_id, k) FROM g) END AS two FROM i, x),
 o AS (SELECT i, sha_id, duration_sec, CAST(row_number() OVER (PARTITION BY i ORDER BY CASE WHEN i % 4 = 0 THEN play_count END DESC, CASE WHEN i % 4 = 1 THEN title END NULLS LAST,
   CASE WHEN i % 4 = 2 THEN created_at END DESC NULLS LAST, CASE WHEN i % 4 = 3 THEN album END DESC NULLS LAST, sha_id) - 1 AS INT) AS position FROM t WHERE CASE WHEN i % 3 = 0 THEN one OR two ELSE one AND two END),
 m AS (SELECT 'p' || lpad(CAST(i AS VARCHAR), 2, '0') AS playlist_id, sha_id, position, duration_sec FROM o WHERE i % 5 <> 0 OR position < 10)"""
QUERIES["r43_refresh_all"] = bind(lambda c: RF.members_of(compiler(c), _hundred()).drop("duration_sec"))
ORACLE["r43_refresh_all"] = oracle(f"{_MEMBERS} SELECT playlist_id, sha_id, position FROM m", *_TABLES)
QUERIES["r44_playlist_stats"] = bind(lambda c: RF.stats_of(c.spark, RF.members_of(compiler(c), _hundred()), [p["playlist_id"] for p in _hundred()]))
ORACLE["r44_playlist_stats"] = oracle(f"""{_MEMBERS} SELECT 'p' || lpad(CAST(i AS VARCHAR), 2, '0') AS playlist_id, coalesce(song_count, 0) AS song_count, coalesce(total_duration_sec, 0) AS total_duration_sec
FROM i LEFT JOIN (SELECT playlist_id, count(*) AS song_count, CAST(sum(duration_sec) AS BIGINT) AS total_duration_sec FROM m GROUP BY 1) s ON s.playlist_id = 'p' || lpad(CAST(i AS VARCHAR), 2, '0')""", *_TABLES)
