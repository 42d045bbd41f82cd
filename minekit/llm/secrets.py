"""Secret scans: fixed patterns, and a battery of randomness tests over long tokens.

A token's encoding follows from its characters. One that fits none is cut after each run of ``=``, and at the signs outside
of base64 and of base64url; each part of ``LEAST`` characters or more is a token of its own. Three statistics are taken over its symbols: chi-squared against a
uniform alphabet, runs above and below the middle of the alphabet, and serial correlation. A random token must pass all
three together (Fisher's sum against ``RANDOM``); its p-value is the chance that ordinary text looks as
even as the token does; two symbols of ordinary text are alike with the chance ``ALIKE``, or ``COINCIDENCE`` times that of
uniform symbols if this is more. Over the whole table these p-values
are held to the false-discovery rate ``FDR`` separately per encoding and length class (Benjamini and Hochberg, on counts
per p-value bin, so that no class has to be sorted).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VALUE = "[A-Za-z0-9+/_.=-]+"
ASSIGN = rf"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?({VALUE})"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
TOKEN = "[A-Za-z0-9+/_=-]{20,}"
LEAST = 20
CODED = "^([0-9A-Za-z+/]+|[0-9A-Za-z_-]+)=*$"
PARTS = ["[0-9A-Za-z+/]+=*", "[0-9A-Za-z_-]+=*"]
KINDS = ["assign", "access", "hex", "random"]
COINCIDENCE, ALIKE = 1.73, 0.065
RANDOM = 0.001
FDR = 0.01
_BINS, _PER_DECADE = 400, 20
_SPANS = "array<struct<start:int,kind:int,end:int>>"
# name, characters, alphabet: the first that fits is the encoding
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = [
    ("decimal", "^[0-9]+$", _DIGITS),
    ("hex", "^[0-9a-f]+$", _DIGITS + "abcdef"),
    ("HEX", "^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    ("lower", "^[a-z]+$", _LOWER),
    ("upper", "^[A-Z]+$", _UPPER),
    ("base32", "^[A-Z2-7]+=*$", _UPPER + "234567"),
    ("base36", "^[0-9a-z]+$", _DIGITS + _LOWER),
    ("base62", "^[0-9A-Za-z]+$", _DIGITS + _UPPER + _LOWER),
    ("base64", "^[0-9A-Za-z+/]+=*$", _DIGITS + _UPPER + _LOWER + "+/"),
    ("base64url", "^[0-9A-Za-z_-]+=*$", _DIGITS + _UPPER + _LOWER + "-_"),
]


def _located(text: Column, matches: Column, pattern: str, kind: int) -> Column:
    """``start, kind, end`` (code points) of each match, from the lengths of matches and of what lies between them."""
    between = F.split(text, pattern, -1)
    step = F.aggregate(
        F.arrays_zip(F.slice(between, 1, F.size(matches)).alias("gap"), matches.alias("hit")),
        F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("at"),
            F.concat(
                a["spans"],
                F.array(F.struct((a["at"] + F.length(x["gap"])).alias("start"), F.lit(kind).alias("kind"), (a["at"] + F.length(x["gap"]) + F.length(x["hit"])).alias("end"))),
            ).alias("spans"),
        ),
    )["spans"]
    return F.when(F.size(matches) > 0, step).otherwise(F.array().cast(_SPANS))


def base_spans(docs: DataFrame, text: str, out: str) -> DataFrame:
    """``docs`` with the array ``out`` of pattern spans, ordered by start and kind; a null text has none."""
    whole = F.coalesce(F.col(text), F.lit(""))
    hits = {k: F.regexp_extract_all(whole, F.lit(f"({p})"), F.lit(1)) for k, p in zip(KINDS, (ASSIGN, ACCESS, HEX))}
    found = docs.withColumns({f"__{k}": c for k, c in hits.items()})
    spans = {f"__at_{k}": _located(whole, F.col(f"__{k}"), p, i) for i, (k, p) in enumerate(zip(KINDS, (ASSIGN, ACCESS, HEX)))}
    # an assignment counts if its value has six characters or more
    long_enough = F.transform("__assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6)
    spans["__at_assign"] = F.filter(spans["__at_assign"], lambda s, i: F.element_at(long_enough, i + 1))
    done = found.withColumns(spans).withColumn(out, F.array_sort(F.concat(*[f"__at_{k}" for k in KINDS[:3]])))
    return done.drop(*[f"__{k}" for k in KINDS[:3]], *[f"__at_{k}" for k in KINDS[:3]])


def normal_below(z: Column) -> Column:
    """Chance that a standard normal value is below ``z``, by a logistic approximation good to 0.0002."""
    c = F.least(F.greatest(z, F.lit(-12.0)), F.lit(12.0))
    return 1 / (1 + F.exp(-1.5976 * c - 0.07056 * c * c * c))


def _coded(token: Column) -> Column:
    """Encoding, alphabet size and symbol numbers of a token; null if its characters fit no encoding."""
    chars = F.split(F.regexp_replace(token, "=+$", ""), "")
    chosen = F.lit(None)

    def numbers(alphabet: str) -> Column:
        return F.transform(chars, lambda c: F.instr(F.lit(alphabet), c).cast("double"))

    for name, fits, alphabet in reversed(ENCODINGS):
        fitted = F.struct(F.lit(name).alias("encoding"), F.lit(float(len(alphabet))).alias("k"), numbers(alphabet).alias("v"))
        chosen = F.when(token.rlike(fits), fitted).otherwise(chosen)
    return chosen


def _span(s: Column) -> Column:
    return F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))


def _tokens(text: Column) -> Column:
    """``start, kind, end, token`` of all tokens that the battery can judge, in order and each once."""
    raw = F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))

    def cut(found: Column) -> Column:
        """Spans within a token."""
        parts = [F.regexp_extract_all(found, F.lit(f"({p})"), F.lit(1)) for p in PARTS]
        spans = F.array_distinct(F.concat(*[_located(found, hits, p, 3) for hits, p in zip(parts, PARTS)]))
        whole = F.array(F.struct(F.lit(0).alias("start"), F.lit(3).alias("kind"), F.length(found).alias("end"))).cast(_SPANS)
        return F.when(found.rlike(CODED), whole).otherwise(F.array_sort(F.filter(spans, lambda s: s["end"] - s["start"] >= LEAST)))

    def pieces(found: Column, at: Column) -> Column:
        def one(span: Column) -> Column:
            token = F.substr(found, span["start"] + 1, span["end"] - span["start"])
            return F.struct((at["start"] + span["start"]).alias("start"), F.lit(3).alias("kind"), (at["start"] + span["end"]).alias("end"), token.alias("token"))

        return F.transform(cut(found), one)

    return F.flatten(F.zip_with(raw, _located(text, raw, TOKEN, 3), pieces))


def battery(tokens: Column) -> Column:
    """``encoding, n, p_random, p_text`` for each token of an array; null where no encoding fits."""

    def add(array: Column, **new) -> Column:
        """The structs of ``array`` with further fields."""
        return F.transform(array, lambda e: F.when(e.isNotNull(), F.struct(*[e[f].alias(f) for f in known], *[c(e).alias(f) for f, c in new.items()])))

    def sum_of(array: Column, term) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda a, x: a + term(x))

    known = ["encoding", "k", "v"]
    out = add(
        F.transform(tokens, _coded),
        n=lambda e: F.size(e["v"]).cast("double"),
        mean=lambda e: sum_of(e["v"], lambda x: x) / F.size(e["v"]),
        squares=lambda e: sum_of(F.array_distinct(e["v"]), lambda x: F.pow(F.size(F.filter(e["v"], lambda y: y == x)).cast("double"), F.lit(2.0))),
        high=lambda e: F.size(F.filter(e["v"], lambda x: x > (e["k"] + 1) / 2)).cast("double"),
        pairs=lambda e: F.arrays_zip(F.slice(e["v"], 1, F.size(e["v"]) - 1).alias("a"), F.slice(e["v"], 2, F.size(e["v"]) - 1).alias("b")),
    )
    known = ["encoding", "k", "n", "squares", "high"]
    out = add(
        out,
        turns=lambda e: F.size(F.filter(e["pairs"], lambda p: (p["a"] > (e["k"] + 1) / 2) != (p["b"] > (e["k"] + 1) / 2))).cast("double") + 1,
        lagged=lambda e: sum_of(e["pairs"], lambda p: (p["a"] - e["mean"]) * (p["b"] - e["mean"])),
        spread=lambda e: sum_of(e["v"], lambda x: (x - e["mean"]) * (x - e["mean"])),
        runs=lambda e: 1 + 2 * e["high"] * (e["n"] - e["high"]) / e["n"],
    )
    known = ["encoding", "k", "n"]
    out = add(
        out,
        chi=lambda e: e["k"] / e["n"] * e["squares"] - e["n"],
        deviation=lambda e: F.sqrt(2 * (e["k"] - 1) * (e["n"] - 1) / e["n"]),
        # of chi-squared in ordinary text over that of random symbols
        excess=lambda e: (e["n"] - 1) * (F.greatest(F.lit(COINCIDENCE), ALIKE * e["k"]) - 1),
        # a sequence without variation is as far from random as can be
        runs_z=lambda e: F.when(e["runs"] > 2, (e["turns"] - e["runs"]) / F.sqrt((e["runs"] - 1) * (e["runs"] - 2) / (e["n"] - 1))).otherwise(12.0),
        serial_z=lambda e: F.when(e["spread"] > 1e-9, (F.try_divide(e["lagged"], e["spread"]) + 1 / e["n"]) * F.sqrt(e["n"])).otherwise(12.0),
    )
    known = ["encoding", "n"]
    out = add(
        out,
        half=lambda e: -F.log(F.greatest(1 - normal_below((e["chi"] - (e["k"] - 1)) / e["deviation"]), F.lit(1e-300)))
        - F.log(F.greatest(2 - 2 * normal_below(F.abs(e["runs_z"])), F.lit(1e-300)))
        - F.log(F.greatest(2 - 2 * normal_below(F.abs(e["serial_z"])), F.lit(1e-300))),
        p_text=lambda e: normal_below((e["chi"] - (e["k"] - 1 + e["excess"])) / F.sqrt(2 * (e["k"] - 1) + 4 * e["excess"])),
    )
    known = ["encoding", "n", "p_text"]
    # Fisher's sum is twice ``half``; tail of chi-squared with six degrees of freedom
    return add(out, p_random=lambda e: F.exp(-e["half"]) * (1 + e["half"] + e["half"] * e["half"] / 2))


def _class(test: Column) -> Column:
    """Encoding and length class (half octaves) of a tested token."""
    return F.concat_ws("/", test["encoding"], F.floor(F.log2(test["n"]) * 2).cast("string"))


def _bin(p: Column) -> Column:
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-30))) * _PER_DECADE), F.lit(_BINS)).cast("int")


def discovery_bins(tests: DataFrame, test: str) -> DataFrame:
    """Per class the smallest p-value bin that keeps the false-discovery rate; classes without discoveries have no row."""
    c = F.col(test)
    counts = tests.groupBy(_class(c).alias("class"), _bin(c["p_text"]).alias("bin")).agg(F.count("*").alias("rows"))
    one = Window.partitionBy("class")  # at most _BINS rows of counts
    worst = F.pow(F.lit(10.0), -F.col("bin") / _PER_DECADE) * F.sum("rows").over(one) / F.sum("rows").over(one.orderBy(F.desc("bin")))
    return counts.withColumn("worst", worst).where(F.col("worst") <= FDR).groupBy("class").agg(F.min("bin").alias("least"))


def find_secrets(docs: DataFrame, *, text: str = "text", out: str = "secrets") -> DataFrame:
    """Every row with ``out``: spans ``start, kind, end`` (code points, end exclusive; kind as an index of ``KINDS``)
    ordered by start and kind. Random tokens that touch a pattern span are not listed again.

    A null text has no spans. A column named ``out`` is replaced, all others pass through, repeated rows each get
    their own spans; repeated tokens count each time in the false-discovery control. Of random parts of a token that lie
    in each other only the longest is listed.
    """
    whole = F.coalesce(F.col("__text"), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col(text).alias("__text"))
    tokens = _tokens(whole)
    tests = rows.select(tokens["token"].alias("tokens")).where(F.size("tokens") > 0).select(F.explode(battery(F.col("tokens"))).alias("test"))
    bins = discovery_bins(tests.where(F.col("test.p_random") >= RANDOM), "test")
    limits = bins.agg(F.map_from_entries(F.collect_list(F.struct("class", "least"))).alias("limits"))

    based = base_spans(rows, "__text", "__base").withColumns({"__tokens": tokens, "__limits": limits.scalar()})
    tested = based.withColumns({"__spans": F.transform("__tokens", _span), "__tests": battery(F.col("__tokens.token"))})
    passed = F.transform(
        "__tests",
        lambda t: F.coalesce((t["p_random"] >= RANDOM) & (_bin(t["p_text"]) >= F.element_at("__limits", _class(t))), F.lit(False)),
    )
    judged = tested.withColumn("__passed", passed)
    random = F.filter(
        "__spans",
        lambda s, i: F.element_at("__passed", i + 1) & ~F.exists("__base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    judged = judged.withColumn("__random", random)
    inside = lambda s, o: (o["start"] <= s["start"]) & (s["end"] <= o["end"]) & (o["end"] - o["start"] > s["end"] - s["start"])
    longest = F.filter("__random", lambda s: ~F.exists("__random", lambda o: inside(s, o)))
    done = judged.withColumn("__found", F.array_sort(F.concat("__base", longest)))
    return done.select(*[F.col("__row")[c].alias(c) for c in docs.columns if c.lower() != out.lower()], F.col("__found").alias(out))


def listed(spans: str | Column, base_only: bool = False) -> Column:
    """The spans as ``kind:start:end``, comma-joined."""
    spans = F.col(spans) if isinstance(spans, str) else spans
    chosen = F.filter(spans, lambda s: s["kind"] < 3) if base_only else spans
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(chosen, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every character of a span replaced by ``*``; as long as before, null stays null."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(
        spans,
        start,
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.concat(
                a["out"],
                F.substr(text, a["at"] + 1, F.greatest(s["start"] - a["at"], F.lit(0))),
                F.repeat(F.lit("*"), F.greatest(s["end"] - F.greatest(a["at"], s["start"]), F.lit(0))),
            ).alias("out"),
        ),
    )
    joined = F.concat(done["out"], F.substr(text, done["at"] + 1))
    return F.when(F.size(spans) > 0, joined).otherwise(text)
