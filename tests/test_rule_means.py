import itertools
from pathlib import Path

import duckdb
from oracle import check

from listenlake.registry import ORACLE, QUERIES


def total(values):
    out = 0.0
    for v in values:
        out += v
    return out


def tables(sf, tmp_path, songs):
    """The smallest tables, with events such that song i * i has the values of songs[i], in their order; ids have one to three digits."""
    for f in Path(sf).glob("*.parquet"):
        if f.stem != "events":
            (tmp_path / f.name).symlink_to(f)
    plays = [(user, v) for user, values in songs.items() for v in values]
    rows = ", ".join(f"({11 * i}, TIMESTAMP '2024-01-30', {user}, 'view', {v}::DOUBLE, '')" for i, (user, v) in enumerate(plays))
    duckdb.connect().execute(f"COPY (SELECT * FROM (VALUES {rows}) AS e(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet'")
    return str(tmp_path)


def test_a_bound_takes_the_mean_of_doubles_as_stored(spark, sf, tmp_path):
    below = min(itertools.permutations([15.37, 43.9, 40.55, 20.2, 29.98]), key=total)
    assert total(below) < 150  # exactly 150 as written
    at = tables(sf, tmp_path, {1: below, 2: [30.0] * 5})
    out = QUERIES["r01_operator_counts"](spark, at)
    assert {r.rule: r.songs for r in out.collect()}["completion_rate less"] == 1
    check(out, ORACLE["r01_operator_counts"], at)


def test_the_top_rated_are_sorted_by_the_means_of_doubles_as_stored(spark, sf, tmp_path):
    orders = list(itertools.permutations([95.33, 92.74, 82.62, 77.77, 85.34, 82.15]))
    at = tables(sf, tmp_path, {1: min(orders, key=total), 2: max(orders, key=total)})
    out = QUERIES["r45_top_rated"](spark, at)
    assert [r.sha_id for r in out.orderBy("position").collect()] == ["4", "1"]
    check(out, ORACLE["r45_top_rated"], at)
