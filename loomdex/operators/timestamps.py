"""Mixed timestamp texts to one UTC instant: expectation-maximisation over format mixtures per source.

Every text is read under each *reading* (date layout) that fits it; one text may have several valid readings
(``03/04/2021``). A source is a mixture of readings. Values are reduced to counts per (source, set of valid
readings), EM runs on those few counts inside one JVM expression, and the posterior of each reading then chooses
the instant of each value. A value whose best reading stays below ``threshold`` is marked ``ambiguous`` and gets no
instant. A declared date order of a source is a prior of EM, strong enough to win against any mixture.

Nothing here leaves the JVM and no step is keyed by the value, so a source holding most rows is no hot spot: the
counts are combined map-side and the joined weights have one row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.session import valid_zones

# Month names in the languages of the feeds (lower case).
MONTHS = {
    1: "jan january januar enero janvier gennaio janeiro",
    2: "feb february februar febrero février fevrier febbraio fevereiro",
    3: "mar march märz maerz marzo mars março",
    4: "apr april abril avril aprile",
    5: "may mai mayo maggio maio",
    6: "jun june juni junio juin giugno junho",
    7: "jul july juli julio juillet luglio julho",
    8: "aug august agosto août aout",
    9: "sep sept september septiembre setiembre septembre settembre setembro",
    10: "oct october oktober octubre octobre ottobre outubro okt",
    11: "nov november noviembre novembre novembro",
    12: "dec december dezember diciembre décembre decembre dicembre dezembro dez",
}
# Zone abbreviations and their minutes east of UTC.
ABBREVIATIONS = {
    "Z": 0, "UTC": 0, "UT": 0, "GMT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "SAST": 120, "IST": 330, "NPT": 345, "SGT": 480, "HKT": 480, "AWST": 480,
    "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
    "NST": -210, "NDT": -150, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300,
    "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600,
}

#: Readings of the mixture, by position.
READINGS = ("ymd", "week", "ordinal", "epoch_s", "epoch_ms", "epoch_us", "epoch_ns", "day_month_name", "month_name_day", "dmy", "mdy")
_SEP = "\u0001"
# Each layout rewrites a text that it fits to kind, three fields and the rest; others pass through unchanged.
_LAYOUTS = (
    ("week", r"^(\d{4})-?W(\d{2})-?(\d)(?=[T ]|$)(.*)$", "$1", "$2", "$3", "$4"),
    ("ymd", r"^(\d{4})-(\d{1,2})-(\d{1,2})(?=[T ,]|$)(.*)$", "$1", "$2", "$3", "$4"),
    ("ymd", r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})(?=[T ,]|$)(.*)$", "$1", "$2", "$3", "$4"),
    ("ymd", r"^(\d{4})(\d{2})(\d{2})(?=[T ]|$)(.*)$", "$1", "$2", "$3", "$4"),
    ("ordinal", r"^(\d{4})-(\d{3})(?=[T ]|$)(.*)$", "$1", "1", "$2", "$3"),
    ("epoch", r"^(-?\d{9,19})$", "$1", "0", "0", ""),
    ("day_month_name", r"^(\d{1,2})(?:\.|st|nd|rd|th)?[ -](?:de |of )?(\p{L}{3,12})\.?,?[ -](?:de )?(\d{4}|\d{2})(?=[T ,]|$)(.*)$", "$3", "$2", "$1", "$4"),
    ("month_name_day", r"^(\p{L}{3,12})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})(?=[T ,]|$)(.*)$", "$3", "$1", "$2", "$4"),
    ("month_name_day", r"^(\p{L}{3,12}) (\d{1,2}) (\d{1,2}:\d{2}(?::\d{2})?)((?: [A-Z]{1,5})?) (\d{4})$", "$5", "$1", "$2", " $3$4"),
    ("numeric", r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})(?=[T ,]|$)(.*)$", "$3", "$1", "$2", "$4"),
)
_WEEKDAY = r"(?iu)^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? ?(?=\S)"
_TIME = (
    r"^(?:T|,? ?(?:at |à |um |a las )?)(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?: ?([AaPp])\.?[Mm]\.?)?(?: ?(?:uhr|Uhr))?"
    r" ?((?:[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Z]{1,5}|[A-Z][A-Za-z]+/[A-Za-z_/+-]+)?)(?: ?\[([A-Za-z_/+-]+)\])?(?: ?\([^)]*\))?$"
)
_BASIC_TIME = r"^[T ](\d{2})(\d{2})(\d{2})?((?:[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Z]{1,5})?)$"


def _map(pairs: dict) -> Column:
    return F.expr("map(" + ", ".join(f"'{k}', {v}" for k, v in pairs.items()) + ")")


def _int(c: Column) -> Column:
    return c.try_cast("int")


def with_readings(df: DataFrame, value: str, zone: Column) -> DataFrame:
    """Adds ``readings``: array of (reading index, utc_us or null), one element for each valid reading of the text.
    ``zone``: name of the zone in which a time without zone is meant, null if unknown (its instants are then null)."""
    zones = valid_zones(df.sparkSession)
    text = F.trim(F.regexp_replace(F.col(value), r"[\s ]+", " "))
    out = df.withColumn("_t", F.regexp_replace(text, _WEEKDAY, ""))
    laid = F.col("_t")
    for kind, pattern, *fields in _LAYOUTS:
        laid = F.regexp_replace(laid, pattern, _SEP.join([kind, *fields]))
    out = out.withColumn("_p", F.split(laid, _SEP))
    part = lambda i: F.get(F.col("_p"), F.lit(i))
    out = out.withColumns({"_k": F.when(F.size("_p") == 5, part(0)), "_r": part(4)})
    clock = F.regexp_replace(F.regexp_replace("_r", _BASIC_TIME, "T$1:$2:$3 $4"), r"^(T\d{2}:\d{2}): ", "$1 ")
    names = ["$1", "$2", "$3", "$4", "$5", "$6", "$7"]
    out = out.withColumn("_c", F.split(F.regexp_replace(clock, _TIME, _SEP.join([*names, "-"])), _SEP))
    bare = F.trim(F.col("_r")) == ""
    c = lambda i: F.get(F.col("_c"), F.lit(i))
    timed = F.size("_c") == 8
    hour = _int(c(0))
    half = F.lower(c(4))
    hour = (
        F.when(half == "", F.when(hour <= 24, hour))
        .when(hour.between(1, 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    )
    out = out.withColumns(
        {
            "_ok": F.col("_k").isNotNull() & (bare | (timed & hour.isNotNull()) | (F.col("_k") == "epoch")),
            "_h": F.when(bare, F.lit(0)).otherwise(hour),
            "_mi": F.when(bare, F.lit(0)).otherwise(_int(c(1))),
            "_s": F.when(bare | (c(2) == ""), F.lit(0)).otherwise(_int(c(2))),
            "_us": F.when(bare | (c(3) == ""), F.lit(0)).otherwise(_int(F.substring(F.rpad(c(3), 9, "0"), 1, 6))),
            "_z": F.when(bare, F.lit("Z")).when(c(5) != "", c(5)).when(c(6) != "", c(6)),
        }
    )
    offset = F.regexp_replace("_z", ":", "")
    minutes = (
        F.when(F.col("_z").rlike(r"^[+-]"), F.concat(F.substring(offset, 1, 1), F.lit("1")).try_cast("int")
               * (_int(F.substring(offset, 2, 2)) * 60 + F.coalesce(_int(F.nullif(F.substring(offset, 4, 2), F.lit(""))), F.lit(0))))
        .otherwise(F.try_element_at(_map(ABBREVIATIONS), F.col("_z")))
    )
    named = F.when(F.col("_z").isNull(), zone).otherwise(F.col("_z"))
    known = F.expr("array(" + ", ".join(f"'{z}'" for z in zones) + ")")
    out = out.withColumns({"_off": minutes, "_zone": F.when(F.array_contains(known, named), named)})
    month = F.coalesce(F.try_element_at(_map({n: m for m, ns in MONTHS.items() for n in ns.split()}), F.lower(part(2))), F.lit(0))
    year = _int(part(1))
    year = F.when(F.length(part(1)) == 2, year + F.when(year < 70, 2000).otherwise(1900)).otherwise(year)
    a, b = _int(part(2)), _int(part(3))
    k = F.col("_k")
    day = lambda y, m, d: F.try_make_timestamp(y, m, d, F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"), F.lit("UTC"))
    jan4 = day(year, F.lit(1), F.lit(4))
    shift = lambda t, days: F.timestamp_micros(F.unix_micros(t) + days.cast("bigint") * 86_400_000_000)
    week = F.when(a.between(1, 53) & b.between(1, 7), shift(jan4, (a - 1) * 7 + b - 1 - (F.dayofweek(jan4) + 5) % 7))
    ordinal = F.when(b.between(1, 366), shift(day(year, F.lit(1), F.lit(1)), b - 1))
    ordinal = F.when(F.year(ordinal) == year, ordinal)
    starts = {
        "ymd": F.when(k == "ymd", day(year, a, b)),
        "week": F.when(k == "week", week),
        "ordinal": F.when(k == "ordinal", ordinal),
        "day_month_name": F.when((k == "day_month_name") & (month > 0), day(year, month, b)),
        "month_name_day": F.when((k == "month_name_day") & (month > 0), day(year, month, b)),
        "dmy": F.when(k == "numeric", day(year, b, a)),
        "mdy": F.when(k == "numeric", day(year, a, b)),
    }
    clock_ok = (F.col("_mi") < 60) & (F.col("_s") <= 60) & ((F.col("_h") < 24) | ((F.col("_mi") == 0) & (F.col("_s") == 0)))
    in_day = (F.col("_h").cast("bigint") * 3600 + F.col("_mi") * 60 + F.col("_s")) * 1_000_000 + F.col("_us")

    def instant(start: Column) -> Column:
        local = F.unix_micros(start) + in_day
        by_zone = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), F.col("_zone")))
        return F.when(F.col("_off").isNotNull(), local - F.col("_off").cast("bigint") * 60_000_000).when(F.col("_zone").isNotNull(), by_zone)

    number = part(1).try_cast("bigint")
    digits = F.length(F.regexp_replace(part(1), "-", ""))
    scale = {"epoch_s": (9, 11, number * 1_000_000), "epoch_ms": (12, 14, number * 1_000), "epoch_us": (15, 17, number), "epoch_ns": (18, 19, (number - F.pmod(number, F.lit(1000))) / 1000)}
    # An unknown zone text (neither offset, abbreviation nor zone name) makes the value unreadable.
    known_zone = F.col("_z").isNull() | F.col("_off").isNotNull() | F.col("_zone").isNotNull()
    items = []
    for i, name in enumerate(READINGS):
        if name in starts:
            s = starts[name]
            items.append(F.when(F.col("_ok") & clock_ok & known_zone & s.isNotNull(), F.struct(F.lit(i).alias("reading"), instant(s).alias("utc_us"))))
        else:
            low, high, us = scale[name]
            items.append(F.when((k == "epoch") & digits.between(low, high), F.struct(F.lit(i).alias("reading"), us.cast("bigint").alias("utc_us"))))
    temporary = ["_t", "_p", "_k", "_r", "_c", "_ok", "_h", "_mi", "_s", "_us", "_z", "_off", "_zone"]
    out = out.withColumn("_all", F.array(F.filter(F.array(*items), lambda x: x.isNotNull()))).drop(*temporary)
    # The generator keeps later filters from being pushed below, where they would repeat the whole parse.
    return out.select("*", F.explode_outer("_all").alias("readings")).drop("_all")


def mixture_weights(read: DataFrame, source: str, prior: str, iterations: int = 25, smoothing: float = 0.5) -> DataFrame:
    """EM per source over counts of (set of valid readings): one row (source, weights by reading)."""
    n = len(READINGS)
    mask = F.aggregate("readings", F.lit(0), lambda acc, r: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1), r["reading"])))
    counts = read.select(F.col(source).alias("source"), F.col(prior).alias("prior"), mask.alias("mask")).groupBy("source", "prior", "mask").count()
    per = counts.groupBy("source", "prior").agg(F.collect_list(F.struct("mask", F.col("count").cast("double").alias("n"))).alias("m"))
    has = lambda m, k: F.call_function("shiftright", m, k).bitwiseAND(F.lit(1)) == 1
    every = F.sequence(F.lit(0), F.lit(n - 1))

    def step(w: Column, _: Column) -> Column:
        share = lambda m, k: F.when(has(m, k), F.get(w, k) * F.get(F.col("prior"), k)).otherwise(0.0)
        whole = lambda m: F.aggregate(every, F.lit(0.0), lambda acc, k: acc + share(m, k))
        raw = F.transform(every, lambda k: F.aggregate("m", F.lit(smoothing), lambda acc, x: acc + F.when(x["mask"] > 0, x["n"] * share(x["mask"], k) / whole(x["mask"])).otherwise(0.0)))
        return F.transform(raw, lambda x: x / F.aggregate(raw, F.lit(0.0), lambda acc, y: acc + y))

    start = F.array_repeat(F.lit(1.0 / n), n)
    return per.select("source", F.aggregate(F.sequence(F.lit(1), F.lit(iterations)), start, step).alias("weights"), "prior")


def normalise(
    df: DataFrame, value: str, source: str, zones: DataFrame, *, threshold: float = 0.95, doubt: float = 1e-9
) -> DataFrame:
    """Adds ``utc_us`` (bigint), ``reading`` (string), ``posterior`` (double) and ``status`` to ``df``.

    ``zones``: (source, zone_name, date_order in DMY/MDY or null), one row per source; ``doubt`` is what a declared
    order leaves to the other one. A stated offset, zone or abbreviation holds; a bare date is midnight UTC; any other
    time is local in the source's zone: the earlier of two equal local times, and a skipped one read with the offset
    before the change. Rows are kept as they are, repeated ones too.

    status: ``ok``; ``null`` (no value); ``unreadable`` (no valid full date and time); ``ambiguous`` (no reading
    reaches ``threshold``); ``no_zone`` (local time of a source without zone). Only ``ok`` rows have ``utc_us``. Other columns stay; one
    named like an added column is replaced. A null source is a source of its own. An empty table gives an empty result.
    """
    side = zones.groupBy(F.col("source").alias("_source")).agg(F.min("zone_name").alias("_zone_name"), F.min(F.upper("date_order")).alias("_order"))
    added = ("utc_us", "reading", "posterior", "status")
    kept = [c for c in df.columns if c not in added]
    # The caller's columns travel in one struct, so that their names cannot meet those used here.
    df = df.select(F.struct(*[F.col(f"`{c}`") for c in kept], F.lit(0).alias("_")).alias("_row"), F.col(f"`{value}`").alias("_value"), F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("_source"))
    value = "_value"
    got = {"DMY": ("dmy", "mdy"), "MDY": ("mdy", "dmy")}

    def belief(name: str) -> Column:
        c = F.lit(1.0)
        for order, (yes, no) in got.items():
            c = F.when(F.col("_order") == order, F.lit(1.0 if name == yes else doubt if name == no else 1.0)).otherwise(c)
        return c

    prior = F.array(*[belief(x) for x in READINGS])
    read = with_readings(df.join(side, "_source", "left"), value, F.col("_zone_name")).withColumn("_prior", prior)
    weights = mixture_weights(read, "_source", "_prior").select(F.col("source").alias("_source"), F.col("weights").alias("_w"))
    out = read.join(weights, "_source", "left")
    score = F.transform("readings", lambda r: F.struct((F.get("_w", r["reading"]) * F.get("_prior", r["reading"])).alias("w"), r["reading"].alias("reading"), r["utc_us"].alias("utc_us")))
    total = F.aggregate("_scored", F.lit(0.0), lambda acc, x: acc + x["w"])
    best = F.array_max("_scored")
    same = F.aggregate(F.filter("_scored", lambda x: x["utc_us"].eqNullSafe(F.col("_best")["utc_us"])), F.lit(0.0), lambda acc, x: acc + x["w"])
    out = out.withColumn("_scored", score).withColumn("_best", best).withColumn("posterior", F.try_divide(same, total))
    status = (
        F.when(F.col(value).isNull(), "null")
        .when(F.size("readings") == 0, "unreadable")
        .when(F.col("posterior") < threshold, "ambiguous")
        .when(F.col("_best")["utc_us"].isNull(), "no_zone")
        .otherwise("ok")
    )
    out = out.withColumn("status", status)
    name = F.get(F.array(*[F.lit(x) for x in READINGS]), F.col("_best")["reading"])
    out = out.withColumns({"utc_us": F.when(F.col("status") == "ok", F.col("_best")["utc_us"]), "reading": name})
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], *added)
