"""Secret scans in DataFrame functions: patterns, and a battery of randomness tests.

Three patterns find assignments, access keys and long hexadecimal runs. Beside
them, each long token that holds a digit or 16 letters is tested: its encoding is inferred
(hexadecimal, base 32, base 36 where digits stand in three places at least,
base 64), and under the hypothesis that its symbols are
random in that alphabet, a chi-squared test of uniformity, a runs test about the
middle of the alphabet and a lag-1 serial correlation give p-values, joined by
Fisher's method. Within a document the false-discovery rate of "not random" is
held by a step-up rule whose thresholds are weighted by length, as long tokens
carry more evidence; tokens that stay random at that level are secrets.

Positions are code points. A document's matches and the pieces between them
come from the same pattern, so starts are running sums of lengths. Each document
is scanned whole and alone: no shuffle.

Defined results: null and empty texts have no spans; rows are independent, so
ties and repeats don't matter; spans of the battery that touch one of a pattern
are left out; extra columns, whatever their names, pass through
``masked`` and are ignored by ``scan``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RANDOM = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9]|(?:[+/_=-]*[A-Za-z]){16})[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "random")
LEVEL = 0.05
#: matches added up at once, and code points of a text that are cut at once
LOT, CUT = 256, 4096
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base36": "abcdefghijklmnopqrstuvwxyz0123456789", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"}
SPAN = "array<struct<start:bigint,kind:int,stop:bigint>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def found(text: Column, pattern: str) -> Column:
    """Matches of a pattern, in order: struct of start, stop, text and second group (or whole)."""
    group = 2 if pattern is ASSIGN else 0
    m = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"), F.slice(F.split(text, pattern, -1), 1, 1 << 30).alias("p"))
    m = F.filter(m, lambda x: x["m"].isNotNull())
    one_type = "struct<start:bigint,stop:bigint,m:string,g:string>"

    def step(a: Column, x: Column) -> Column:
        start = a["at"] + F.length(x["p"])
        stop = start + F.length(x["m"])
        one = F.struct(start.alias("start"), stop.alias("stop"), x["m"].alias("m"), x["g"].alias("g"))
        return F.struct(stop.alias("at"), F.concat(a["out"], F.array(one)).alias("out")).cast(f"struct<at:bigint,out:array<{one_type}>>")

    def lot(a: Column, i: Column) -> Column:
        zero = F.struct(a["at"].alias("at"), F.array().cast(f"array<{one_type}>").alias("out"))
        done = F.aggregate(F.slice(a["m"], i * LOT + 1, F.lit(LOT)), zero, step)
        return let(done, lambda d: F.struct(a["m"].alias("m"), d["at"].alias("at"), F.concat(a["out"], F.array(d["out"])).alias("out")))

    # matches are added up in lots, so that appending to an array copies a lot, not all of them
    begin = F.struct(m.alias("m"), F.lit(0).cast("long").alias("at"), F.array().cast(f"array<array<{one_type}>>").alias("out"))
    lots = let(F.size(m), lambda n: F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / LOT).cast("int")))
    # the first look spares texts without a match two more
    return F.when(text.rlike(pattern), F.flatten(F.aggregate(lots, begin, lot)["out"])).otherwise(F.array().cast(f"array<{one_type}>"))


def _below(z: Column) -> Column:
    """The normal distribution function, to about 1e-4."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(1.5976) * z + F.lit(0.07056) * z * z * z)))


def randomness(token: Column) -> Column:
    """Fisher's joint p-value of the three tests, small where the token isn't random."""
    bare = F.regexp_replace(token, "=+$", "")
    alphabet = F.when(bare.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), F.lit(ALPHABETS["hex"])).when(bare.rlike("^[A-Z2-7]+$"), F.lit(ALPHABETS["base32"]))
    alphabet = alphabet.when(bare.rlike("^(?:[a-z0-9]+|[A-Z0-9]+)$") & bare.rlike("(?:[0-9]+[A-Za-z]+){3}"), F.lit(ALPHABETS["base36"])).otherwise(F.lit(ALPHABETS["base64"]))
    word = F.when(F.length(alphabet).isin(16, 36), F.lower(bare)).otherwise(bare)
    letters = F.filter(F.split(word, ""), lambda c: c != "")
    # base 64 has 64 symbols in either of its two forms
    size = F.least(F.length(alphabet), F.lit(64)).cast("double")
    coded = lambda t: F.struct(F.transform(t["c"], lambda c: F.instr(alphabet, c).cast("double")).alias("x"), t["c"].alias("c"), t["k"].alias("k"))
    return let(let(F.struct(letters.alias("c"), size.alias("k")), coded), _fisher)


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, v: t + v)


def _fisher(s: Column) -> Column:
    """s: x, the symbols' places in an alphabet; c, the symbols; k, its size."""
    x, c, k = s["x"], s["c"], s["k"]
    n = F.greatest(F.size(x), F.lit(1)).cast("double")
    squares = _total(F.transform(F.array_distinct(c), lambda u: F.pow(F.size(F.filter(c, lambda v: v == u)).cast("double"), F.lit(2.0))))
    tail = F.greatest(F.size(x) - 1, F.lit(0))
    sides = F.struct(n.alias("n"), squares.alias("squares"), _total(F.transform(x, lambda v: (v > k / 2).cast("double"))).alias("up"), (_total(x) / n).alias("mean"), F.arrays_zip(F.slice(x, F.lit(1), tail).alias("a"), F.slice(x, F.lit(2), tail).alias("b")).alias("pairs"))

    def joined(t: Column) -> Column:
        n, up, mean = t["n"], t["up"], t["mean"]
        chi, free = F.greatest(k / n * t["squares"] - n, F.lit(1e-9)), k - 1
        # Wilson and Hilferty's cube root; the upper tail
        uniform = _below(-(F.pow(chi / free, F.lit(1 / 3)) - (1 - F.lit(2.0) / (9 * free))) / F.sqrt(F.lit(2.0) / (9 * free)))
        runs = 1 + _total(F.transform(t["pairs"], lambda p: ((p["a"] > k / 2) != (p["b"] > k / 2)).cast("double")))
        mean_runs = 1 + 2 * up * (n - up) / n
        spread = F.greatest((mean_runs - 1) * (mean_runs - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(1e-9))
        ordered = 2 * _below(-F.abs(runs - mean_runs) / F.sqrt(spread))
        variance = F.greatest(_total(F.transform(x, lambda v: (v - mean) * (v - mean))), F.lit(1e-9))
        serial = _total(F.transform(t["pairs"], lambda p: (p["a"] - mean) * (p["b"] - mean))) / variance
        alone = 2 * _below(-F.abs(serial + 1 / n) * F.sqrt(n))
        clip = lambda p: F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-12))
        stat = -(F.log(clip(uniform)) + F.log(clip(ordered)) + F.log(clip(alone)))  # half of Fisher's statistic, 6 degrees of freedom
        return let(stat, lambda h: F.exp(-h) * (1 + h + h * h / 2))

    return let(sides, joined)


def random_tokens(tokens: Column) -> Column:
    """Of a document's tokens (start, stop, m, g), those that stay random under the step-up rule."""
    weight = lambda t: F.sqrt((t["stop"] - t["start"]).cast("double"))
    scored = F.transform(tokens, lambda t: F.struct((randomness(t["m"]) / weight(t)).alias("p"), t["start"].alias("start"), t["stop"].alias("stop")))
    mean = _total(F.transform(tokens, weight)) / F.greatest(F.size(tokens), F.lit(1)).cast("double")

    def step_up(s: Column) -> Column:
        n = F.size(s["t"])
        last = F.aggregate(F.transform(s["t"], lambda t, i: F.when(t["p"] * s["mean"] <= F.lit(LEVEL) * (i + 1) / n, i + 1).otherwise(F.lit(0))), F.lit(0), lambda a, v: F.greatest(a, v))
        return let(last, lambda k: F.slice(s["t"], k + 1, n - k))

    return let(F.struct(F.array_sort(scored).alias("t"), mean.alias("mean")), step_up)


def spans(text: Column) -> Column:
    """base, the patterns' spans, and all, those of the battery too; in order."""
    text = F.coalesce(text, F.lit(""))
    span = lambda m, k: F.transform(m, lambda t: F.struct(t["start"].alias("start"), F.lit(k).alias("kind"), t["stop"].alias("stop"))).cast(SPAN)
    assign = F.filter(found(text, ASSIGN), lambda t: F.length(t["g"]) >= 12)
    base = F.array_sort(F.concat(span(assign, 0), span(found(text, ACCESS), 1), span(found(text, HEX), 2)))
    none = F.array().cast(SPAN)

    def add(s: Column) -> Column:
        free = F.filter(s["long"], lambda t: ~F.exists(s["base"], lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"])))
        more = F.when(F.size(s["long"]) > 0, let(free, lambda f: F.when(F.size(f) > 0, span(random_tokens(f), 3)).otherwise(none))).otherwise(none)
        return F.struct(s["base"].alias("base"), F.array_sort(F.concat(s["base"], more)).alias("all"))

    return let(F.struct(base.alias("base"), found(text, RANDOM).alias("long")), add)


def written(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name[s["kind"]], s["start"], s["stop"])), ",")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each document."""
    got = docs.select(F.col("doc_id").cast("long").alias("doc_id"), spans(F.col("text")).alias("__spans"))
    count = lambda k: F.size(F.filter("__spans.base", lambda s: s["kind"] == k)).cast("long")
    return got.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(F.encode(written(F.col("__spans.base")), "UTF-8"), 256).alias("base_sha256"), written(F.col("__spans.all")).alias("spans"))


def masked(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with their columns; each span of text is replaced by a mark."""
    text = F.col("text")
    kind = "struct<at:bigint,out:array<struct<start:bigint,stop:bigint>>>"
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("out")).cast(kind)

    def apart(a: Column, s: Column) -> Column:
        # where spans overlap, the first one has the mark and the others only widen it
        fresh = F.concat(a["out"], F.array(F.struct(s["start"].alias("start"), s["stop"].alias("stop"))))
        last = F.element_at(a["out"], -1)
        wider = F.concat(F.slice(a["out"], F.lit(1), F.size(a["out"]) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))))
        return F.struct(F.greatest(a["at"], s["stop"]).alias("at"), F.when(s["start"] >= a["at"], fresh).otherwise(wider).alias("out")).cast(kind)

    def between(cut: Column, start: Column, stop: Column) -> Column:
        """Code points start to stop of a text in cuts of CUT."""
        piece = lambda k: F.substring(F.element_at(cut, (k + 1).cast("int")), (F.greatest(start - k * CUT, F.lit(0)) + 1).cast("int"), (F.least(stop - k * CUT, F.lit(CUT)) - F.greatest(start - k * CUT, F.lit(0))).cast("int"))
        return F.when(stop > start, F.array_join(F.transform(F.sequence(F.floor(start / CUT), F.floor((stop - 1) / CUT)), piece), "")).otherwise(F.lit(""))

    def write(s: Column) -> Column:
        cut, gone = s["cut"], s["gone"]
        before = lambda i: F.when(i > 0, F.element_at(gone, F.greatest(i, F.lit(1)))["stop"]).otherwise(F.lit(0).cast("long"))
        pieces = F.transform(gone, lambda g, i: F.concat(between(cut, before(i), g["start"]), F.lit(mark)))
        return F.concat(F.array_join(pieces, ""), between(cut, F.element_at(gone, -1)["stop"], F.length(text).cast("long")))

    def clean(all_spans: Column) -> Column:
        parts = F.struct(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CUT), F.lit(0)).alias("cut"), F.aggregate(all_spans, zero, apart)["out"].alias("gone"))
        return F.when(F.size(all_spans) > 0, let(parts, write)).otherwise(text)

    return docs.withColumn("text", let(spans(text)["all"], clean))
