"""Secret scans: three patterns, and a battery of randomness tests for other tokens.

Candidates are all long runs of letters, digits and a few signs, and all count in
the control. From its characters a run's encoding is inferred, the smallest
alphabet that holds them (hexadecimal, letters, base 32, 36, 62, 64), and three
tests ask whether it could be random in that alphabet: chi-squared uniformity of
the characters, the runs test about the alphabet's middle, and serial
correlation of neighbours. Runs that pass are then weighed against ordinary
text: the more often a run changes between letters in lower case, in upper case
and digits, the less likely an ordinary token of its length does so. Those
probabilities are put through false-discovery control within bands of length.

Everything is column functions. Places are code points, found by splitting at
the pattern: lengths of what lies between matches give each start.

Results in special cases: a null text is empty and has no spans. Repeated rows
are scanned each for itself, but count as so many tokens in the control. An
empty table gives no rows. All columns beside id and text are left aside.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobsluice.llm.common import store, whole_text

# The base patterns. Letters of the first group in either case.
ASSIGN = (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"""
          r"""|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?"""
          r"""([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
# What a text must hold to have a match long enough.
ACCESS_LONG, HEX_LONG = r"AKIA[A-Z0-9]{12}", r"[0-9a-f]{32}"
KINDS = ["assign", "access", "hex", "random"]
SPAN = "struct<at:int,kind:int,upto:int,own:int>"

UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
# A token is tested against the first that holds all its signs; no later one is smaller.
ALPHABETS = {
    "hex": (DIGITS + "abcdef", r"^[0-9a-f]+$"),
    "HEX": (DIGITS + "ABCDEF", r"^[0-9A-F]+$"),
    "lower": (LOWER, r"^[a-z]+$"),
    "upper": (UPPER, r"^[A-Z]+$"),
    "base32": (UPPER + "234567", r"^[A-Z2-7]+$"),
    "base32lower": (LOWER + "234567", r"^[a-z2-7]+$"),
    "base36": (DIGITS + LOWER, r"^[0-9a-z]+$"),
    "BASE36": (DIGITS + UPPER, r"^[0-9A-Z]+$"),
    "letters": (UPPER + LOWER, r"^[A-Za-z]+$"),
    "base62": (DIGITS + UPPER + LOWER, r"^[0-9A-Za-z]+$"),
    "base64": (UPPER + LOWER + DIGITS + "+/", r"^[0-9A-Za-z+/]+$"),
    "base64url": (UPPER + LOWER + DIGITS + "-_", r"^[0-9A-Za-z_-]+$"),
    # Signs of both, as where a name in front of a base 64 key ends in a dash.
    "mixed": (UPPER + LOWER + DIGITS + "+/-_", r"^[0-9A-Za-z+/_-]+$"),
}


@dataclass(frozen=True)
class SecretSettings:
    min_assigned: int = 8
    min_access: int = 16
    min_hex: int = 32
    # Length of a candidate for the battery, and the bands of the control.
    min_random: int = 20
    bands: tuple[int, ...] = (20, 32, 64)
    # A token random in its alphabet fails the battery this often.
    battery_level: float = 0.001
    # How often neighbours of an ordinary token differ in class.
    ordinary_changes: float = 0.15
    discovery_rate: float = 0.01
    bins: int = 300


def spans(text: Column, pattern: str, kind: int, quick: str | None = None,
          own: int | None = None) -> Column:
    """``SPAN`` of each leftmost match; ``own`` is the length of a group of it."""
    none = F.array().cast(f"array<{SPAN}>")
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    groups = found if own is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(own))
    sizes = F.zip_with(
        F.arrays_zip(found.alias("m"), groups.alias("g")), F.slice(between, 1, F.size(found)),
        lambda m, gap: F.struct(F.length(gap).alias("gap"), F.length(m["m"]).alias("size"),
                                F.length(m["g"]).alias("own")))
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc, x):
        at = acc["at"] + x["gap"]
        return F.struct((at + x["size"]).alias("at"), F.concat(acc["out"], F.array(F.struct(
            at.alias("at"), F.lit(kind).alias("kind"), (at + x["size"]).alias("upto"),
            x["own"].alias("own")))).alias("out"))

    return F.when(text.rlike(quick or pattern), F.aggregate(sizes, start, step)["out"]) \
        .otherwise(none)


def phi(z: Column) -> Column:
    """The normal distribution function, by its logistic form (error below 0.0002)."""
    return 1 / (1 + F.exp(-(0.07056 * z * z * z + 1.5976 * z)))


def log10_upper_tail(z: Column) -> Column:
    """log10 of the chance to exceed ``z``: exact in scale far out, too."""
    t = F.greatest(z, F.lit(0.0))
    return F.log10(F.exp(-0.717 * t - 0.416 * t * t) / 2 + F.lit(1e-300))


def _encoding(token: Column) -> Column:
    out = None
    for name, (_, pattern) in ALPHABETS.items():
        out = F.when(token.rlike(pattern), name) if out is None \
            else out.when(token.rlike(pattern), name)
    return out


def _battery(cfg: SecretSettings, x: Column) -> Column:
    """``(token, values, k)`` -> log10 of an ordinary token's chance; 0 where it is not random."""
    v, k = x["values"], x["k"].cast("double")
    n = F.size(v).cast("double")
    squares = F.aggregate(F.transform(F.array_distinct(v), lambda s: F.size(
        F.filter(v, lambda y: y == s))), F.lit(0.0), lambda a, c: a + c * c)
    chi = (k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
    high = F.transform(v, lambda y: (y * 2 > x["k"]).cast("int"))
    ups = F.aggregate(high, F.lit(0), lambda a, y: a + y).cast("double")
    turns = F.aggregate(F.zip_with(F.slice(high, 2, F.size(v) - 1), F.slice(high, 1, F.size(v) - 1),
                                   lambda a, b: (a != b).cast("int")), F.lit(1), lambda a, y: a + y)
    both = 2 * ups * (n - ups)
    runs = F.when((ups == 0) | (ups == n), F.lit(99.0)).otherwise(
        (turns - 1 - both / n) / F.sqrt(F.greatest(both * (both - n) / (n * n * (n - 1)),
                                                   F.lit(1e-9))))
    mean = F.aggregate(v, F.lit(0.0), lambda a, y: a + y) / n
    spread = F.aggregate(v, F.lit(0.0), lambda a, y: a + (y - mean) * (y - mean))
    lagged = F.aggregate(F.zip_with(
        F.slice(v, 2, F.size(v) - 1), F.slice(v, 1, F.size(v) - 1),
        lambda a, b: (a - mean) * (b - mean)), F.lit(0.0), lambda a, y: a + y)
    serial = F.when(spread == 0, F.lit(99.0)).otherwise(
        (lagged / spread + 1 / n) * F.sqrt(n))
    worst = F.least(1 - phi(chi), 2 * (1 - phi(F.abs(runs))), 2 * (1 - phi(F.abs(serial))))
    classes = F.translate(x["token"], "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_",
                          "0" * 10 + "A" * 26 + "a" * 26 + "+" * 4)
    shifted = F.split(classes, "")
    changes = F.aggregate(F.zip_with(
        F.slice(shifted, 2, F.size(v) - 1), F.slice(shifted, 1, F.size(v) - 1),
        lambda a, b: (a != b).cast("int")), F.lit(0), lambda a, y: a + y)
    rate = cfg.ordinary_changes
    z = (changes - 0.5 - rate * (n - 1)) / F.sqrt(rate * (1 - rate) * (n - 1))
    return F.when((3 * worst >= cfg.battery_level) & (changes > 0), log10_upper_tail(z)) \
        .otherwise(0.0)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         cfg: SecretSettings = SecretSettings()) -> DataFrame:
    """``(id, base, added)``: arrays of spans ``(at, kind, upto, own)``, by place."""
    t = F.col("_t")
    run = rf"[A-Za-z0-9+/_-]{{{cfg.min_random},}}"
    found = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("_t")).select(
        "id", "_t",
        F.filter(spans(t, ASSIGN, 0, own=2), lambda s: s["own"] >= cfg.min_assigned).alias("a"),
        F.filter(spans(t, ACCESS, 1, ACCESS_LONG),
                 lambda s: s["upto"] - s["at"] >= cfg.min_access).alias("b"),
        F.filter(spans(t, HEX, 2, HEX_LONG),
                 lambda s: s["upto"] - s["at"] >= cfg.min_hex).alias("c"),
        spans(t, run, 3).alias("d"))
    base = found.select("id", "_t", F.sort_array(F.concat("a", "b", "c")).alias("base"), "d")
    tokens = F.transform(
        F.filter("d", lambda s: ~F.exists("base", lambda o: (o["at"] < s["upto"])
                                          & (s["at"] < o["upto"]))),
        lambda s: F.struct(s.alias("span"), F.substring(t, s["at"] + 1, s["upto"] - s["at"])
                           .alias("token")))
    named = base.select("id", "base", F.transform(tokens, lambda x: F.struct(
        x["span"].alias("span"), x["token"].alias("token"), _encoding(x["token"]).alias("code")))
        .alias("d"))
    letters = F.create_map(*[F.lit(v) for k, (a, _) in ALPHABETS.items() for v in (k, a)])
    valued = named.select("id", "base", F.transform("d", lambda x: F.struct(
        x["span"].alias("span"), x["token"].alias("token"),
        F.length(letters[x["code"]]).alias("k"),
        F.transform(F.split(x["token"], ""), lambda c: F.instr(letters[x["code"]], c))
        .alias("values"))).alias("d"))
    tested = store(valued.select("id", "base", F.transform("d", lambda x: F.struct(
        x["span"].alias("span"), _battery(cfg, x).alias("chance"))).alias("d")), "secret-spans")
    limits = discovery_limits(tested, cfg)
    added = F.filter("d", lambda x: _bin(x["chance"], cfg) >= _by_band(x["span"], limits, cfg))
    return tested.select("id", "base", F.transform(added, lambda x: x["span"]).alias("added"))


def _bin(chance: Column, cfg: SecretSettings) -> Column:
    return F.least(F.floor(-10 * chance), F.lit(cfg.bins)).cast("int")


def _by_band(span: Column, values: list[int], cfg: SecretSettings) -> Column:
    size, out = span["upto"] - span["at"], F.lit(values[0])
    for least, value in zip(cfg.bands[1:], values[1:]):
        out = F.when(size >= least, value).otherwise(out)
    return out


def discovery_limits(tested: DataFrame, cfg: SecretSettings) -> list[int]:
    """For each band of length, the least bin of -10 log10 p that the step-up rule accepts.

    One row for each band and bin comes to the driver, whatever the data.
    """
    bands = list(range(len(cfg.bands)))
    counts = {b: [0] * (cfg.bins + 1) for b in bands}
    rows = tested.select(F.explode("d").alias("x")).groupBy(
        _by_band(F.col("x.span"), bands, cfg).alias("band"), _bin(F.col("x.chance"), cfg)
        .alias("bin")).count()
    for band, at, n in rows.collect():
        counts[band][max(at, 0)] += n
    out = []
    for band in bands:
        total, above, limit = sum(counts[band]), 0, cfg.bins + 1
        for at in range(cfg.bins, -1, -1):
            above += counts[band][at]
            if above and 10 ** (-at / 10) <= cfg.discovery_rate * above / total:
                limit = at
        out.append(limit)
    return out


def span_text(array: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(array, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["at"].cast("string"),
        s["upto"].cast("string"))))


def count_kind(array: Column, kind: int) -> Column:
    return F.size(F.filter(array, lambda s: s["kind"] == kind)).cast("long")
