import difflib
import random
import re

from pyspark.sql import functions as F

from listenlake.functions import fuzzy as Z
from listenlake.operators import resolve


def norm(x):
    x = (x or "").lower()
    for p in (r"\([^)]*\)", r"\[[^\]]*\]", r"\{[^}]*\}", r"\b(feat|featuring|ft)\.?\b.*", r"[^\w\s]"):
        x = re.sub(p, " ", x)
    return " ".join(x.split())


def ratio(a, b):
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def spoilt(rng, x):
    x = list(x)
    for _ in range(rng.randrange(4)):
        i = rng.randrange(len(x) + 1)
        x[i : i + rng.randrange(2)] = rng.choice(["", "a", "q", " "])
    return "".join(x)


def texts(rng, n):
    return ["".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 14))).strip() or "a" for _ in range(n)]


def test_fuzzy_pairs_match_brute_force_and_compare_few(spark):
    rng = random.Random(5)
    right = texts(rng, 250) + [f"the {x}" for x in texts(rng, 250)] + ["a", "ab", "b", "é", "x" * 250]
    left = [spoilt(rng, x) for x in rng.sample(right, 200)] + ["", None, "a", "ab", "the", "x" * 249]
    frame = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    for least in (0.8, 0.82, 0.9):
        want = {(a, b) for a in set(left) - {"", None} for b in set(right) if ratio(a.lower(), b.lower()) >= least}
        got = Z.fuzzy_pairs(frame(left, "a"), frame(right, "b"), least)
        assert {(r.a, r.b) for r in got.collect()} == want and len(want) > 100
    # 1,000 names that begin alike: the candidates follow the answers, not the common beginning.
    names = [f"the {w}" for w in {"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(10)) for _ in range(1000)}]
    some = [spoilt(rng, x) for x in names[:100]]
    few = Z.candidates(frame(some, "a"), frame(names, "b"), Z.ARTIST)
    found = few.withColumn("r", F.lit(1)).count()
    assert found < 0.01 * len(some) * len(names)


def test_artists_that_edits_mean(spark):
    artists = spark.createDataFrame([(1, "The Beatles"), (2, "Beatles Revival"), (3, "Queen"), (4, "queen"), (5, "Simon & Garfunkel"), (6, "The Beetles"), (7, None)], "artist_id int, name string")
    edits = spark.createDataFrame([("s1", "QUEEN; the beatlas, Nobody At All"), ("s2", "Simon and Garfunkel;simon   & garfunkle"), ("s3", " , ;"), ("s4", None), ("s5", "The Beatles (live), the beatles")], "sha_id string, artists string")
    got = {(r.sha_id, r.name): (r.role, r.artist_id) for r in resolve.resolved_edits(edits, artists).collect()}
    rows = [(a.artist_id, a.name) for a in artists.collect() if a.name]

    def meant(name):
        exact = [i for i, n in rows if n.lower() == name.strip().lower()]
        if exact:
            return min(exact)
        near = sorted((-ratio(norm(name), norm(n)), i) for i, n in rows if norm(name) and norm(name).split()[0] in n.lower())
        return near[0][1] if near and -near[0][0] >= Z.ARTIST else None

    by_id = dict(rows)
    want = {}
    for e in edits.collect():
        for i, name in enumerate(x.strip() for x in re.split("[;,]", e.artists or "") if x.strip()):
            who = meant(name)
            want.setdefault((e.sha_id, by_id.get(who, name)), ("primary" if i == 0 else "featured", who))
    assert got == want and got["s1", "Queen"] == ("primary", 3)


def test_names_that_differ_by_signs_are_not_compared(spark, monkeypatch):
    def compared(*_):
        raise AssertionError("an equal normalised name was compared")

    monkeypatch.setattr(Z, "fuzzy_pairs", compared)
    artists = spark.createDataFrame([(i, f"Supplier#{i:09}") for i in range(3000)] + [(5000, "Supplier 000000007")], "artist_id int, name string")
    names = artists.where("artist_id % 50 = 0 OR artist_id = 7").select(F.replace("name", F.lit("#"), F.lit(" - ")).alias("name"))
    got = {r.name: (r.artist_id, r.score) for r in Z.resolve_artists(names, artists).collect()}
    assert got == {f"Supplier - {i:09}": (i, 1.0) for i in [7, *range(0, 3000, 50)]} | {"Supplier 000000007": (5000, 1.0)}


def test_the_best_artist_is_found_at_every_ratio(spark):
    rng = random.Random(9)
    artists = [(i, f"{rng.choice(['the', 'dj', 'saint'])} {''.join(rng.choice('abcd') for _ in range(rng.randrange(4, 12)))}{rng.choice(['', '!', ' (x)'])}") for i in range(200)] + [(900, "thx abcdabcd"), (901, "the abcdxbcd")]
    names = sorted({spoilt(rng, n) for _, n in artists for _ in range(2)} | {"the abcdabcd", "x", "(y)"})
    want = {}
    for name in names:
        same = [(-1.0, i) for i, n in artists if n.lower() == name.strip().lower()]
        near = [(-ratio(norm(name), norm(n)), i) for i, n in artists if norm(name) and norm(name).split()[0] in n.lower()]
        top = min(same or near, default=(0, 0))
        if name.strip() and -top[0] >= Z.ARTIST:
            want[name] = top[1], round(-top[0], 9)
    got = {r.name: (r.artist_id, round(r.score, 9)) for r in Z.resolve_artists(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(artists, "artist_id int, name string")).collect()}
    assert got == want and sum(s < 0.88 for _, s in want.values()) > 5 and sum(0.88 <= s < 0.95 for _, s in want.values()) > 5


def test_albums_match_brute_force(spark):
    rng = random.Random(6)
    words = ["love", "night", "blue", "x", "the", "songs", "live"]
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))
    albums = [(f"{i:03}", title() + rng.choice(["", " (Deluxe)", "!", " II"]), rng.choice(["Ann", "Anne", "Bob", None])) for i in range(120)] + [("900", None, "Ann"), ("901", "X", "Bob")]
    asked = [(title(), rng.choice(["Ann", "Anna", "Bob", None, ""])) for _ in range(60)] + [(None, "Ann"), (" ", "Ann"), ("x", None)]
    got = {(r.title, r.artist): (r.album_id, round(r.score, 9)) for r in Z.resolve_albums(spark.createDataFrame(asked, "title string, artist string"), spark.createDataFrame(albums, "album_id string, title string, artist_name string")).collect()}
    want = {}
    for t, a in asked:
        t, a = (t or "").strip(), (a or "").strip() or None
        if not t:
            continue
        same = [i for i, x, n in albums if x and x.lower() == t.lower() and (a is None or (n or "").lower() == a.lower())]
        scored = sorted((-(0.7 * ratio(norm(t), norm(x)) + 0.3 * (ratio(norm(a), norm(n)) if a else 1.0)), i) for i, x, n in albums if x and t.lower() in x.lower())
        if same:
            want[t, a] = min(same), 1.0
        elif scored and -scored[0][0] >= 0.8:
            want[t, a] = scored[0][1], round(-scored[0][0], 9)
    assert got == want and len(want) > 10


def test_the_album_gate(spark):
    cases = [("Abbey Road", "abbey road (remastered)", True), ("Abbey Road", "Let It Be", False), ("Abbey Road", None, False), ("Abbey Road", "", False), (None, "x", True), (" ", None, True), ("Help!", "help", True)]
    df = spark.createDataFrame(cases, "a string, r string, want boolean")
    assert df.where(Z.album_fits(F.col("a"), F.col("r")) != F.col("want")).count() == 0


def test_names_that_share_a_few_trigrams_make_few_candidates(spark):
    from listenlake.functions import text as T

    rng = random.Random(8)
    names = sorted({f"Supplier#{rng.randrange(10**6):09}" for _ in range(2000)})
    asked = [f"{rng.choice(['', '01 ', 'the '])}{n}{rng.choice(['', ' new', ' old'])}" for n in names[::20]] + ["ab", "", None]
    of = lambda rows, c: spark.createDataFrame([(x,) for x in rows], f"{c} string")
    names += ["a", "ab", "ab c", "a" * 60, " ".join(f"word{i}" for i in range(12))]
    asked += [names[-1], names[-1][:-3], "a" * 61]
    brute = of(asked, "text").distinct().crossJoin(of(names, "name")).withColumn("similarity", T.similarity("text", "name"))
    close = T.close_pairs(of(asked, "text"), of(names, "name"), 0.75)
    want = brute.where("similarity >= 0.75").collect()
    assert sorted(map(tuple, close.collect())) == sorted(map(tuple, want)) and len(want) >= 80
    sets = T._gram_sets(of(asked, "text"), "text", "text", "l"), T._gram_sets(of(names, "name"), "name", "name", "r")
    few, many = T.close_candidates(*sets, 0.75).count(), T.candidate_pairs(*sets, 0.75).count()
    print("candidates", few, many)
    assert few < 0.5 * many
