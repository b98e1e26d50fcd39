"""Secret scans in DataFrame functions only: fixed patterns, and a randomness battery for the rest.

Strings of 20 or more key-like characters that mix character classes are tested per inferred encoding; they are
cut at equals signs that do not end them, and at other signs where no encoding fits. Two
tests measure how far a string is from ordinary writing: the collision form of the chi-squared statistic of
its alphabet, and the runs of character classes. Both are taken against a null of ordinary writing, so a small
p speaks for a random key; they are combined by Fisher's method. Chi-squared uniformity and serial
correlation must not contradict randomness. Discoveries are then controlled by a step-up rule within each
length class, over all strings of all documents: a string that fails a gate counts with p = 1, so gates only
raise p and never loosen the rule.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import free_name, let, stored, table, whole_text

#: Kind, pattern, group whose length counts, least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 2, 8), ("access", r"AKIA[A-Z0-9]{12,}", 0, 16), ("hex", r"[0-9a-f]{32,}", 0, 32))
KINDS = [kind for kind, *_ in BASE] + ["random"]
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Cheap conditions before the patterns: a word of an assignment, with no letter whose lower case depends on a locale;
#: a start of 20 characters without a blank, in the text behind a blank.
ASSIGN_WORDS, LONG_RUN = ("passw", "secret", "token", "key"), r"[\x20\n][^\x20\n]{20}"
#: Parts of a candidate: between equals signs, which only end an encoding; where no encoding fits such a part, what
#: stands between slashes or pluses, between dashes or underscores, and between any of these.
VALUE, SMALLER = r"[^=]+(?:=+$)?", (r"[^=/+]+(?:=+$)?", r"[^=_-]+(?:=+$)?", r"[^=/+_-]+(?:=+$)?")
#: Encodings from narrow to wide: pattern of the whole string, alphabet in order.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = (
    (r"^[0-9a-f]+$", DIGITS + LOWER[:6]), (r"^[0-9A-F]+$", DIGITS + UPPER[:6]), (r"^[A-Z2-7]+=*$", UPPER + "234567"), (r"^[0-9a-z]+$", DIGITS + LOWER),
    (r"^[0-9A-Z]+$", DIGITS + UPPER), (r"^[0-9A-Za-z]+$", UPPER + LOWER + DIGITS), (r"^[0-9A-Za-z+/]+=*$", UPPER + LOWER + DIGITS + "+/"), (r"^[0-9A-Za-z_-]+=*$", UPPER + LOWER + DIGITS + "-_"),
)
#: Ordinary writing: chance that two letters are equal and sum of cubed letter shares, the same for writing of
#: hexadecimal digits only, and the chance that the character class changes.
COLLISION, CUBES, HEX_COLLISION, HEX_CUBES, CLASS_CHANGE = 0.0667, 0.0059, 0.2, 0.05, 0.15
#: Each test must point to randomness by itself this far before the two are combined.
EACH_P = 0.1
FALSE_DISCOVERY = 0.01
#: Lower ends of the length classes; decibans are tenths of -log10 p.
LENGTHS, MOST_DECIBANS = (20, 32, 48, 64), 600
#: Matches summed up together when places in a text are found.
CHUNK = 256


def matches(text: Column, pattern: str, group: int) -> Column:
    """gaps, found, inner: what lies between the matches, the matches, and the group of each."""
    every = lambda g: F.regexp_extract_all(text, F.lit(pattern), F.lit(g))
    return F.struct(F.split(text, pattern, -1).alias("gaps"), every(0).alias("found"), *([every(group).alias("inner")] if group else []))


def total(first: Column, last: Column, number) -> Column:
    """Sum of number(i) from first to last; reads by place, as a slice would copy its whole array."""
    return F.aggregate(F.sequence(first, last), F.lit(0), lambda n, i: n + number(i))


def spans_of(found: Column, end, least: int, kind: int, group: int) -> Column:
    """Spans (start, end, kind, found) of matches, short ones dropped; end(i) is the end of match i."""
    return F.transform(
        F.filter(F.sequence(F.lit(0), F.size(found["found"]) - 1), lambda i: F.char_length(F.get(found["inner" if group else "found"], i)) >= least),
        lambda i: let(F.struct(end(i).alias("end"), F.get(found["found"], i).alias("found")), lambda s: F.struct((s["end"] - F.char_length(s["found"])).alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"), s["found"].alias("found"))),
    )


NONE = "array<struct<start:int,end:int,kind:int,found:string>>"


def placed(text: Column, pattern: str, group: int, least: int, kind: int, likely: Column | None = None) -> Column:
    """Spans of the matches in a text of any length, leftmost and non-overlapping; none where `likely` is false.

    Places are sums over the parts between matches and the matches. They are taken in chunks: what lies before
    a match's chunk, then inside it, so a text with k matches costs far less than k squared.
    """
    add = lambda within: lambda a, c: F.struct(F.concat(a["list"], F.array(a["sum"])).alias("list"), (a["sum"] + within(c * CHUNK, c * CHUNK + CHUNK - 1)).alias("sum"))

    def summed(m: Column) -> Column:
        steps = F.transform(m["found"], lambda f, i: F.char_length(F.get(m["gaps"], i)) + F.char_length(f))
        return let(steps, lambda s: chunked(m, s))

    def chunked(m: Column, steps: Column) -> Column:
        within = lambda first, last: total(first, F.least(last, F.size(steps) - 1), lambda j: F.get(steps, j))
        chunks = F.sequence(F.lit(0), ((F.size(steps) - 1) / CHUNK).cast("int"))
        before = F.aggregate(chunks, F.struct(F.array().cast("array<int>").alias("list"), F.lit(0).alias("sum")), add(within), lambda a: a["list"])
        return let(before, lambda b: spans_of(m, lambda i: F.get(b, (i / CHUNK).cast("int")) + within((i / CHUNK).cast("int") * CHUNK, i), least, kind, group))

    some = text.rlike(pattern) if likely is None else likely & text.rlike(pattern)
    return F.when(some, let(matches(text, pattern, group), summed)).otherwise(F.array().cast(NONE))


def overlapped(spans: Column, start: Column, end: Column) -> Column:
    """Whether a span overlaps one of `spans`, which are in order and apart: halving steps to the first that ends behind its start."""
    bit = lambda p: F.call_function("shiftleft", F.lit(1), p)
    go = lambda i, p: F.when((i + bit(p) <= F.size(spans)) & (F.get(spans, i + bit(p) - 1)["end"] <= start), i + bit(p)).otherwise(i)
    first = F.aggregate(F.sequence(F.ceil(F.log2(F.size(spans))).cast("int"), F.lit(0), F.lit(-1)), F.lit(0), go)
    return F.coalesce(F.get(spans, first)["start"] < end, F.lit(False))


def tail(z: Column) -> Column:
    """Upper tail of the standard normal, by a closed form with an error below one percent of the tail."""
    def closed(t: Column) -> Column:
        half = 0.5 * F.exp(-0.717 * t["bound"] - 0.416 * t["bound"] * t["bound"])
        return F.when(t["z"] >= 0, half).otherwise(1.0 - half)

    return let(z, lambda z: let(F.struct(z.alias("z"), F.least(F.abs(z), F.lit(36.0)).alias("bound")), closed))


def alphabet_of(found: Column) -> Column:
    """The narrowest alphabet that fits the string, or null."""
    return F.coalesce(*[F.when(found.rlike(pattern), F.lit(letters)) for pattern, letters in ENCODINGS])


def decibans(found: Column) -> Column:
    """Tenths of -log10 of the combined p of one string; 0, p = 1, if it fails a gate.

    What a lambda needs is bound before it, so a string costs its length times the size of its alphabet.
    """
    # Words, names and numbers are no keys: a digit and a letter, or capitals inside, must be there.
    mixed = (found.rlike("[0-9]") & found.rlike("[A-Za-z]")) | (found.rlike("[a-z]") & found.rlike(".[A-Z]"))

    def battery(s: Column) -> Column:
        k, n = F.char_length(s["alphabet"]).cast("double"), s["n"]
        values = F.transform(F.split(found, ""), lambda c: F.instr(s["alphabet"], c).cast("double"))
        squares = F.aggregate(F.array_distinct(F.split(found, "")), F.lit(0.0), lambda a, c: a + F.pow(n - F.char_length(F.replace(found, c, F.lit(""))), F.lit(2.0)))
        classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(found, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
        return let(F.struct(n.alias("n"), values.alias("v"), squares.alias("q"), F.char_length(classes).cast("double").alias("runs"), k.alias("k")), tests)

    def tests(t: Column) -> Column:
        n = t["n"]
        pairs = n * (n - 1) / 2
        narrow = t["k"] <= 16
        equal, cubes = F.when(narrow, HEX_COLLISION).otherwise(COLLISION), F.when(narrow, HEX_CUBES).otherwise(CUBES)
        variance = pairs * equal * (1 - equal) + n * (n - 1) * (n - 2) * (cubes - equal * equal)
        unlike = tail((pairs * equal - (t["q"] - n) / 2) / F.sqrt(variance))
        changes = tail((t["runs"] - 1 - (n - 1) * CLASS_CHANGE) / F.sqrt((n - 1) * CLASS_CHANGE * (1 - CLASS_CHANGE)))
        chi = t["k"] / n * t["q"] - n
        uniform = (chi - (t["k"] - 1)) / F.sqrt(2 * (t["k"] - 1)) <= 4.0
        mean = F.aggregate(t["v"], F.lit(0.0), lambda a, x: a + x) / n
        kept = F.struct(n.alias("n"), t["v"].alias("v"), unlike.alias("unlike"), changes.alias("changes"), uniform.alias("uniform"), mean.alias("mean"))
        return let(kept, lambda u: F.when(u["uniform"] & (u["unlike"] <= EACH_P) & (u["changes"] <= EACH_P), moments(u)))

    def moments(u: Column) -> Column:
        v, mean = u["v"], u["mean"]
        spread = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        product = F.aggregate(F.sequence(F.lit(1), F.size(v) - 1), F.lit(0.0), lambda a, i: a + (F.get(v, i - 1) - mean) * (F.get(v, i) - mean))
        serial = lambda m: (F.abs(m["product"]) <= 4.0 * m["spread"] / F.sqrt(u["n"])) & (m["spread"] > 0)
        return let(F.struct(spread.alias("spread"), product.alias("product")), lambda m: F.when(serial(m), let(-(F.log(u["unlike"]) + F.log(u["changes"])), combined)))

    def combined(half_fisher: Column) -> Column:
        return F.least(F.floor((half_fisher - F.log(1 + half_fisher)) / math.log(10.0) * 10), F.lit(MOST_DECIBANS)).cast("int")

    known = lambda s: F.when(s["alphabet"].isNotNull(), battery(s))
    return F.coalesce(F.when(mixed, let(F.struct(alphabet_of(found).alias("alphabet"), F.char_length(found).cast("double").alias("n")), known)), F.lit(0))


def length_class(width: Column) -> Column:
    return sum((F.when(width >= low, 1).otherwise(0) for low in LENGTHS[1:]), F.lit(0))


def cut(whole: Column, patterns: tuple[str, ...]) -> Column:
    """The strings of 20 or more characters that match a pattern inside a span, as spans of the text."""
    found = F.flatten(F.array(*[placed(whole["found"], pattern, 0, 20, len(BASE)) for pattern in patterns]))
    return F.array_distinct(F.transform(found, lambda c: F.struct((c["start"] + whole["start"]).alias("start"), (c["end"] + whole["start"]).alias("end"), c["kind"].alias("kind"), c["found"].alias("found"))))


def parts_of(value: Column) -> Column:
    """The strings to test in a value between equals signs: itself if an encoding fits it; else its parts, which may overlap."""
    return F.when(alphabet_of(value["found"]).isNotNull(), F.array(value)).otherwise(cut(value, SMALLER))


def strongest(scored: Column) -> Column:
    """Of overlapping spans the one with the smallest p keeps it, ties by place; the others get p = 1.

    So no end of a key is left, but a key may take path parts beside it along. Spans with p = 1 hide none.
    """
    order = lambda some: F.array_sort(F.transform(some, lambda c: F.struct((-c["decibans"]).alias("rank"), c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))

    def add(taken: Column, c: Column) -> Column:
        hidden = F.exists(taken, lambda t: (t["decibans"] > 0) & (t["start"] < c["end"]) & (c["start"] < t["end"]))
        return F.concat(taken, F.array(F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), F.when(hidden, 0).otherwise(-c["rank"]).alias("decibans"))))

    chosen = lambda some: F.aggregate(order(some), F.array().cast("array<struct<start:int,end:int,kind:int,decibans:int>>"), add)
    several = lambda some: F.when(F.size(some) < 2, scored).otherwise(F.concat(F.filter(scored, lambda c: c["decibans"] == 0), chosen(some)))
    return let(F.filter(scored, lambda c: c["decibans"] > 0), several)


def with_spans(docs: DataFrame, name: str) -> DataFrame:
    """docs plus `name`, a struct of `base` and `tested` spans; the latter overlap no base span and carry their decibans.

    A tested span with decibans above 0 overlaps no other one. A pattern is tried where a cheaper condition, which
    follows from it, holds; texts without a candidate skip the battery.
    """
    text = whole_text("text")
    run = free_name(docs, "_run")
    out = docs.withColumn(run, F.concat(F.lit(" "), text).rlike(LONG_RUN))
    lower = F.lower(text)
    named = lower.contains(ASSIGN_WORDS[0])
    for word in ASSIGN_WORDS[1:]:
        named = named | lower.contains(word)
    likely = {"assign": (text.contains(":") | text.contains("=")) & named, "access": text.contains("AKIA"), "hex": F.col(run)}
    parts = [free_name(out, f"_{kind}") for kind, *_ in BASE]
    candidates = free_name(out, "_candidates")
    found = {part: placed(text, pattern, group, least, i, likely[kind]) for i, (part, (kind, pattern, group, least)) in enumerate(zip(parts, BASE))}
    out = out.withColumns(found | {candidates: placed(text, CANDIDATE, 0, 20, len(BASE), F.col(run))})
    hit = lambda c: [overlapped(F.col(part), c["start"], c["end"]) for part in parts]
    free = lambda c: ~(hit(c)[0] | hit(c)[1] | hit(c)[2])
    score = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), decibans(c["found"]).alias("decibans"))
    # Values overlap no other ones, so each is settled by itself.
    tested = lambda c: F.flatten(F.transform(cut(c, (VALUE,)), lambda v: let(F.transform(F.filter(parts_of(v), free), score), strongest)))
    scored = F.flatten(F.transform(F.col(candidates), tested))
    plain = F.transform(F.concat(*map(F.col, parts)), lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), b["kind"].alias("kind")))
    return out.withColumn(name, F.struct(plain.alias("base"), scored.alias("tested"))).select(*docs.columns, name)


def thresholds(histogram: list[tuple[int, int, int]], q: float = FALSE_DISCOVERY) -> dict[int, int]:
    """Least accepted decibans per length class from (class, decibans, count): the step-up rule on binned p."""
    least = {}
    for wanted in {c for c, _, _ in histogram}:
        bins = sorted(((d, n) for c, d, n in histogram if c == wanted), reverse=True)
        total, rank = sum(n for _, n in bins), 0
        for d, n in bins:
            rank += n
            if 10 ** (-d / 10) <= q * rank / total:
                least[wanted] = d
    return least


def scan(docs: DataFrame, q: float = FALSE_DISCOVERY, kept: list[str] | None = None) -> DataFrame:
    """docs, or the columns of it named in `kept`, plus `spans`: array of (start, end, kind), by start, then kind; code points, end exclusive.

    kind counts along KINDS. Base kinds are always kept; a `random` span stands where no base span does. A null
    text is empty and has no span; equal texts have equal spans. Extra columns pass through; an input column
    named `spans` is replaced. The text is scanned once: the kept columns and all spans are stored, the histogram
    of p (at most 4 x 601 counts come to the driver, whatever the input) and the accepted spans are read from there.
    """
    hidden = free_name(docs, "_scan")
    kept = [c for c in kept or docs.columns if c.lower() != "spans"]
    empty = {c: F.lit(None) for c, kind in docs.dtypes if c in kept and kind == "void"}  # no file holds them
    scored = stored(with_spans(docs, hidden).select(*[c for c in kept if c not in empty], hidden), "scan").withColumns(empty)
    one = scored.select(F.explode(F.col(hidden)["tested"]).alias("c")).select(length_class(F.col("c.end") - F.col("c.start")).alias("class"), F.col("c.decibans").alias("decibans"))
    least = thresholds([tuple(r) for r in one.groupBy("class", "decibans").count().collect()], q)

    def accepted(c: Column) -> Column:
        width = length_class(c["end"] - c["start"])
        return c["decibans"] >= F.coalesce(*[F.when(width == k, F.lit(d)) for k, d in sorted(least.items())], F.lit(MOST_DECIBANS + 1))

    plain = lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))
    random = F.transform(F.filter(F.col(hidden)["tested"], accepted), plain)
    ordered = F.transform(F.array_sort(F.transform(F.concat(F.col(hidden)["base"], random), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))), plain)
    return scored.withColumn("spans", ordered).select(*kept, "spans")


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The columns of docs, every span of the text replaced by the mark; overlapping spans become one mark.

    Documents without a span are unchanged; `n_chars`, if there, follows a changed text. No row is dropped.
    """
    spans = free_name(docs, "spans")
    if spans != "spans":
        docs = docs.withColumnRenamed("spans", spans)
    found = scan(docs)
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def chunk(a: Column, c: Column) -> Column:
        """Go on behind the place reached with the next CHUNK spans, on the piece of the text that they end in."""
        part = F.filter(F.transform(F.sequence(c * CHUNK, c * CHUNK + CHUNK - 1), lambda i: F.get("spans", i)), lambda s: s.isNotNull())
        end = F.greatest(a["at"], F.coalesce(F.array_max(F.transform(part, lambda s: s["end"])), F.lit(0)))
        piece = F.substring(F.col("text"), a["at"] + 1, end - a["at"])
        step = lambda p: lambda b, s: F.struct(
            F.when(s["start"] >= b["at"], F.concat(b["out"], F.substring(p, b["at"] - a["at"] + 1, s["start"] - b["at"]), F.lit(mark))).otherwise(b["out"]).alias("out"), F.greatest(b["at"], s["end"]).alias("at")
        )
        done = let(piece, lambda p: F.aggregate(part, F.struct(F.lit("").alias("out"), a["at"].alias("at")), step(p)))
        return let(done, lambda d: F.struct(F.concat(a["out"], d["out"]).alias("out"), d["at"].alias("at")))

    done = F.aggregate(F.sequence(F.lit(0), ((F.size("spans") - 1) / CHUNK).cast("int")), start, chunk, lambda a: F.concat(a["out"], F.substring(F.col("text"), a["at"] + 1, F.char_length("text"))))
    hit = free_name(found, "_hit")
    out = found.withColumn(hit, F.size("spans") > 0).withColumn("text", F.when(F.col(hit), done).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(hit), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    out = out.select(*docs.columns)
    return out if spans == "spans" else out.withColumnRenamed(spans, "spans")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan every whole text; counts and digest of the base spans, and all spans."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), kept=["doc_id"])
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(i).alias(f"n_{kind}") for i, (kind, *_) in enumerate(BASE)], count(len(BASE)).alias("n_random"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


SQL: dict[str, str] = {}
QUERIES = {"op3_secret_scan": op3_secret_scan}
