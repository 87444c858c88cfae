"""Secret scans with built-in functions only.

Base patterns are found with regular expressions. Beyond them, candidate strings are scored by the Shannon
entropy of a sliding window, kept up to date by incremental counts: a window's step changes two counts, and
with them the sum of c * log2(c). The threshold depends on the candidate's character class; windows that overlap a
match of the allow-list are suppressed.

Work is linear in a text: it is split around a pattern's matches once and offsets are carried along, in blocks, so that
no list of matches is copied for every match. A window's counts are fields of five bits in six words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: The base patterns in the order of kinds. Each match's text alone decides whether it holds.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"  # the first AKIA of a run gives its longest match
HEX = r"[0-9a-f]{16,}"  # matches of the bare class are maximal runs
ASSIGN_VALUE = 12

#: Candidates: runs of the characters of encoded keys, and the window over them.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least window entropy, in bits a character, for hexadecimal digits, for letters of one case with digits, for letters of both
#: cases with digits, and for letters of both cases alone; letters of one case alone, or digits alone, are words and numbers.
THRESHOLDS = {"hex": 3.0, "one_case": 3.7, "mixed": 3.75, "letters": 4.1}
#: Well-known harmless strings.
ALLOW = [
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",
    r"(?i)example|placeholder|changeme|your[_-]?(key|token|secret)",
    r"(?i)0123456789abcdef|abcdefghijklmnop|qwertyuiop",
    r"([-_=+/])\1{7,}",
]


#: Matches whose spans are listed together; fixed values: characters of candidates, in the order of their count fields.
BLOCK = 64
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_FIELDS = 12  # counts in a word
_SPAN = "array<struct<start:int,end:int,m:string>>"


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _spans(text: str | Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs (start, end, m), in code points: running sums of the lengths of gaps and matches."""
    text = F.col(text) if isinstance(text, str) else text
    none = F.array().cast(_SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["p"] + x["gap"]
        end = start + x["length"]
        return F.struct(end.alias("p"), F.concat(acc["s"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m")))).alias("s"))

    def block(pieces: Column, p: Column, k: Column) -> Column:
        return F.aggregate(F.slice(pieces, k * BLOCK + 1, F.lit(BLOCK)), F.struct(p.alias("p"), none.alias("s")), step)

    def spans(pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("p"), F.array().cast(f"array<{_SPAN}>").alias("s"))
        joined = lambda acc, own: F.struct(own["p"].alias("p"), F.concat(acc["s"], F.array(own["s"])).alias("s"))
        blocks = F.sequence(F.lit(0), ((F.size(pieces) - 1) / BLOCK).cast("int"))
        return F.aggregate(blocks, start, lambda acc, k: _let(block(pieces, acc["p"], k), lambda own: joined(acc, own)), lambda acc: F.flatten(acc["s"]))

    def pieces(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
        return F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("length"), m.alias("m")))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) == 0, none).otherwise(_let(pieces(found), spans)))


def _log_sum(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(0.0)


def _hot(m: Column) -> Column:
    """(first, last, best): the hull of the windows of m at or over its class's threshold that overlap no match of the allow-list, and the highest entropy."""
    lower, upper, digit = m.rlike("[a-z]"), m.rlike("[A-Z]"), m.rlike("[0-9]")
    least = (
        F.when(digit & ~lower & ~upper, 99.0)
        .when(m.rlike("^([0-9a-f]+|[0-9A-F]+)$"), THRESHOLDS["hex"])
        .when(lower & upper & digit, THRESHOLDS["mixed"])
        .when((lower | upper) & digit, THRESHOLDS["one_case"])
        .when(lower & upper, THRESHOLDS["letters"])
        .otherwise(99.0)
    )
    one = F.lit(1).cast("long")
    words = -(-len(ALPHABET) // _FIELDS)
    shift = lambda c: (c % _FIELDS) * 5
    word = lambda c: (c / _FIELDS).cast("int")
    count = lambda counts, c: F.call_function("shiftright", F.get(counts, word(c)), shift(c)).bitwiseAND(F.lit(31).cast("long")).cast("int")
    added = lambda c, k: F.when(word(c) == k, F.call_function("shiftleft", one, shift(c))).otherwise(0)

    def scored(allowed: Column, at_least: Column) -> Column:
        codes = F.transform(F.split(m, "", -1), lambda c: F.when(c == "", -1).otherwise(F.call_function("instr", F.lit(ALPHABET), c) - 1))
        codes = F.filter(codes, lambda c: c >= 0)
        nexts = F.struct(*[F.lit(0).alias(f"p{j}") for j in range(len(ALLOW))])
        start = F.struct(
            F.lit(0).alias("i"), F.array_repeat(F.lit(0).cast("long"), words).alias("counts"), F.lit(0.0).alias("s"), nexts.alias("next"),
            F.lit(0).alias("until"), F.lit(0.0).alias("best"), F.lit(-1).alias("first"), F.lit(-1).alias("last"),
        )

        def step(acc: Column, x: Column) -> Column:
            new, old, i = x["new"], x["old"], acc["i"] + 1
            # The matches of one allowed pattern start at different places, in order: one may start here.
            here = [F.get(allowed[j], acc["next"][f"p{j}"]) for j in range(len(ALLOW))]
            begins = [F.coalesce(h["start"] == acc["i"], F.lit(False)) for h in here]
            until = F.greatest(acc["until"], *[F.when(b, h["end"]).otherwise(0) for b, h in zip(begins, here, strict=True)])
            following = F.struct(*[(acc["next"][f"p{j}"] + b.cast("int")).alias(f"p{j}") for j, b in enumerate(begins)])
            same = new == old
            was_new, was_old = count(acc["counts"], new), F.when(old >= 0, count(acc["counts"], F.greatest(old, F.lit(0)))).otherwise(0)
            grown = F.when(same, 0.0).otherwise(_log_sum(was_new + 1) - _log_sum(was_new))
            shrunk = F.when(same | (old < 0), 0.0).otherwise(_log_sum(was_old - 1) - _log_sum(was_old))
            counts = F.transform(acc["counts"], lambda c, k: c + added(new, k) - F.when(old >= 0, added(old, k)).otherwise(0))

            def moved(v: Column) -> Column:
                over = (i >= WINDOW) & (v["h"] >= at_least) & (v["until"] <= i - WINDOW)
                return F.struct(
                    i.alias("i"), counts.alias("counts"), v["s"].alias("s"), following.alias("next"), v["until"].alias("until"), F.greatest(acc["best"], v["h"]).alias("best"),
                    F.when(over & (acc["first"] < 0), i - WINDOW).otherwise(acc["first"]).alias("first"), F.when(over, i).otherwise(acc["last"]).alias("last"),
                )

            entropy = lambda v: F.struct(v["s"].alias("s"), v["until"].alias("until"), F.when(i >= WINDOW, F.log2(F.lit(float(WINDOW))) - v["s"] / WINDOW).otherwise(0.0).alias("h"))
            return _let(_let(F.struct((acc["s"] + grown + shrunk).alias("s"), until.alias("until")), entropy), moved)

        return _let(
            codes,
            lambda own: F.aggregate(
                F.zip_with(own, F.slice(F.concat(F.array_repeat(F.lit(-1), WINDOW), own), F.lit(1), F.size(own)), lambda new, old: F.struct(new.alias("new"), old.alias("old"))),
                start, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last"), a["best"].alias("best")),
            ),
        )

    none = F.struct(F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0.0).alias("best"))
    allowed = F.array(*[_spans(m, pattern) for pattern in ALLOW])
    return _let(least, lambda at_least: F.when(at_least > 90, none).otherwise(_let(allowed, lambda a: scored(a, at_least))))


def scan_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with ``secrets`` added: an array of structs (start, no, end, kind), sorted by start, then kind.

    Kinds, numbered from 0: assign, access, hex (the base patterns) and entropy. Offsets are in code points, the end
    exclusive. Null text counts as empty and has none; repeated rows are each scanned; a column ``secrets`` that
    is there already is replaced, all others pass through; an empty table stays empty.
    """
    rows = docs.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    kind = lambda spans, no, name: F.transform(
        spans, lambda x: F.struct(x["start"].alias("start"), F.lit(no).alias("no"), x["end"].alias("end"), F.lit(name).alias("kind"))
    )
    assign = F.filter(_spans("__text", ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], "^" + ASSIGN + "$", 2)) >= ASSIGN_VALUE)
    hot = F.filter(
        F.transform(_spans("__text", CANDIDATE), lambda x: F.struct(x["start"].alias("at"), _hot(x["m"]).alias("h"))), lambda x: x["h"]["first"] >= 0
    )
    entropy = F.transform(hot, lambda x: F.struct((x["at"] + x["h"]["first"]).alias("start"), (x["at"] + x["h"]["last"]).alias("end")))
    found = F.concat(kind(assign, 0, "assign"), kind(_spans("__text", ACCESS), 1, "access"), kind(_spans("__text", HEX), 2, "hex"), kind(entropy, 3, "entropy"))
    return rows.withColumn("secrets", F.array_sort(found)).drop("__text")


def joined(secrets: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(secrets, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, and all spans."""
    found = scan_secrets(docs.select("doc_id", "text")).select("doc_id", "secrets")
    n = lambda no: F.size(F.filter("secrets", lambda x: x["no"] == no)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(F.filter("secrets", lambda x: x["no"] < 3)), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans")
    )
