"""Mixed timestamp formats and time zones: every notation becomes microseconds since 1970-01-01 UTC.

``parse_instants`` takes a string column apart with built-in expressions only: date, clock time, and
the zone written in the value. ``to_utc_micros`` turns that into an instant, taking a zone from a
column where the value has none. ``estimate_zones`` finds the zone of a group of local timestamps
that come without one, by aligning them with the times at which they were ingested.

Defined results: null, empty and unreadable values, values without a full calendar date (``hoje``),
and dates that don't exist (30 February) give null; digits past microseconds are cut; missing parts of
the time are zero; a wall time that occurs twice is the first one, one that a clock change skips moves
forward by the length of the gap; a value with an unknown zone name counts as unreadable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tarrafa.session import written

# Month names by their first three letters, Portuguese and English.
MONTHS = {
    "jan": 1, "fev": 2, "feb": 2, "mar": 3, "abr": 4, "apr": 4, "mai": 5, "may": 5, "jun": 6, "jul": 7,
    "ago": 8, "aug": 8, "set": 9, "sep": 9, "out": 10, "oct": 10, "nov": 11, "dez": 12, "dec": 12,
}
# Abbreviations of Brazilian legal time, standard and summer.
ABBREVIATIONS = {
    "utc": "+00:00", "gmt": "+00:00", "z": "+00:00",
    "brt": "-03:00", "brst": "-02:00", "amt": "-04:00", "amst": "-03:00",
    "act": "-05:00", "acst": "-04:00", "fnt": "-02:00", "fnst": "-01:00",
}
# The zones of Brazil that differ in their history since 1985.
BRAZIL_ZONES = [
    "America/Noronha", "America/Belem", "America/Fortaleza", "America/Recife", "America/Araguaina",
    "America/Maceio", "America/Bahia", "America/Sao_Paulo", "America/Campo_Grande", "America/Cuiaba",
    "America/Santarem", "America/Porto_Velho", "America/Boa_Vista", "America/Manaus",
    "America/Eirunepe", "America/Rio_Branco",
]

_MONTH = r"(?:jan|fev|feb|mar|abr|apr|mai|may|jun|jul|ago|aug|set|sep|out|oct|nov|dez|dec)\p{L}*"
_DAY_NAME = r"(?:(?:seg|ter|qua|qui|sex|sab|sáb|dom|mon|tue|wed|thu|fri|sat|sun)[\p{L}-]*\.?,?\s+)?"
#: Each shape of a date, anchored at the start, and the order of its year, month and day groups.
_DATES = [
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})(?!\d)", "ymd"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})(?!\d)", "ymd"),
    (r"^(\d{4})\.(\d{1,2})\.(\d{1,2})(?!\d)", "ymd"),
    (r"^((?:19|20)\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?=$|[t ]|\d{6}(?:\D|$)|\d{4}$)", "ymd"),
    (r"^(\d{1,2})([/.-])(\d{1,2})\2(\d{4}|\d{2})(?!\d)", "d_my"),
    (r"^(0[1-9]|[12]\d|3[01])(0[1-9]|1[0-2])((?:19|20)\d{2})$", "dmy"),
    (rf"^{_DAY_NAME}(\d{{1,2}})º?(?:\s+de\s+|\s+|-)({_MONTH})\.?,?(?:\s+de\s+|\s+|-)(\d{{4}})(?!\d)", "dMy"),
    (rf"^{_DAY_NAME}({_MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?!\d)", "Mdy"),
]
_ORDERS = {"ymd": "$1|$2|$3|", "d_my": "$4|$3|$1|", "dmy": "$3|$2|$1|", "dMy": "$3|$2|$1|", "Mdy": "$3|$1|$2|"}
_CLOCK = (
    r"^(?:t|[\s,;|–—-]*(?:às|as|at|a las)?\s*)?(\d{1,2})(?:\s?[:h]\s?(\d{2})?(?:\s?[:m]\s?(\d{2})\s?s?)?|(?=\s?[ap]\.?m))"
    r"(?:[.,](\d+))?(?:min(?!\p{L}))?(?:\s*([ap])\.?\s?m\.?(?!\p{L}))?"
)
_BARE_CLOCK, _AFTER_BARE = r"^t?(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?", r"(?!\d)(?!\s?[:h])"


def available_zones(spark: SparkSession) -> list[str]:
    """Region names that the JVM can resolve, so that a bad name in the data can't end a job."""
    try:
        return sorted(z for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    except Exception:
        import zoneinfo

        return sorted(zoneinfo.available_timezones())


def _among(column: str, values) -> Column:
    """Whether a column holds one of some plain names; one expression, as hundreds of literals cost a call each."""
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in sorted(set(values)))
    return F.expr(f"`{column}` IN ({listed})") if listed else F.lit(False)


def parse_instants(df: DataFrame, value: str, out: str = "p", zones: list[str] | None = None) -> DataFrame:
    """Adds ``out``: a struct of ``local`` (timestamp_ntz), ``zone`` (null if not written), ``epoch_micros``.

    ``epoch_micros`` is set for bare numbers only. All fields are null where the value names no full,
    existing date. The steps are separate projections, so that no expression is repeated in the plan;
    their columns are named ``_i_...`` and dropped.
    """
    keep = [df[c] for c in df.columns if c != out]
    zones = available_zones(df.sparkSession) if zones is None else zones
    space = F.regexp_replace(F.regexp_replace(F.col(value), r"[\p{Z}\s]+", " "), r"^ | $", "")
    d = df.select(*keep, space.alias("_i_u"))
    d = d.withColumn("_i_v", F.lower("_i_u"))

    shape = F.lit(None).cast("string")
    for pattern, order in reversed(_DATES):
        shape = F.when(F.col("_i_v").rlike(pattern), F.regexp_replace("_i_v", pattern, _ORDERS[order])).otherwise(shape)
    number = F.regexp_extract("_i_v", r"^(\d{10}|\d{13})$", 1)
    d = d.withColumns({"_i_n": number, "_i_s": F.split(shape, r"\|", 4)})
    d = d.withColumns({"_i_epoch": F.when(F.length("_i_n") == 10, F.col("_i_n").cast("long") * 1_000_000).when(F.length("_i_n") == 13, F.col("_i_n").cast("long") * 1000), "_i_year": F.try_element_at("_i_s", F.lit(1)), "_i_month": F.try_element_at("_i_s", F.lit(2)), "_i_day": F.try_element_at("_i_s", F.lit(3)), "_i_rest": F.coalesce(F.try_element_at("_i_s", F.lit(4)), F.lit(""))})
    months = F.create_map(*[x for k, m in MONTHS.items() for x in (F.lit(k), F.lit(m))])
    century = F.when(F.length("_i_year") == 2, F.when(F.col("_i_year").try_cast("int") < 70, 2000).otherwise(1900)).otherwise(0)
    d = d.withColumns({"_i_month": F.coalesce(F.col("_i_month").try_cast("int"), F.try_element_at(months, F.substring("_i_month", 1, 3))), "_i_year": F.col("_i_year").try_cast("int") + century})
    # The clock time as hour|minute|second|fraction|half of the day|what follows.
    clock = F.when(F.col("_i_rest").rlike(_BARE_CLOCK + _AFTER_BARE), F.regexp_replace("_i_rest", _BARE_CLOCK + _AFTER_BARE, "$1|$2|$3|$4||"))
    clock = clock.when(F.col("_i_rest").rlike(_CLOCK), F.regexp_replace("_i_rest", _CLOCK, "$1|$2|$3|$4|$5|")).otherwise(F.concat(F.lit("|||||"), F.col("_i_rest")))
    d = d.withColumn("_i_c", F.split(clock, r"\|", 6))
    at = lambda i: F.element_at("_i_c", i)
    d = d.withColumns({"_i_hour": F.coalesce(at(1).try_cast("int"), F.lit(0)), "_i_minute": F.coalesce(at(2).try_cast("int"), F.lit(0)), "_i_second": F.concat(F.coalesce(F.nullif(at(3), F.lit("")), F.lit("0")), F.lit("."), F.rpad(F.substring(at(4), 1, 6), 6, "0")).try_cast("decimal(16,6)"), "_i_half": at(5), "_i_tail": F.trim(at(6))})
    hour = F.when((F.col("_i_half") == "p") & (F.col("_i_hour") < 12), F.col("_i_hour") + 12).when((F.col("_i_half") == "a") & (F.col("_i_hour") == 12), 0).otherwise(F.col("_i_hour"))
    offset = F.translate(F.regexp_extract("_i_tail", r"^(?:utc|gmt)?\s?([+−-]\d{1,2}(?::?\d{2})?)(?:\s?[\[(].*[\])])?$", 1), "−:", "-")
    d = d.withColumns({"_i_hour": hour, "_i_offset": offset, "_i_name": F.when((F.col("_i_tail") == "") | (offset != ""), "").otherwise(F.regexp_extract("_i_u", r"(?<![\p{L}/])([A-Z][A-Za-z]+(?:/[A-Za-z0-9_+-]+)+)[\])]?$", 1))})

    hours, minutes = F.expr("substring(_i_offset, 2, if(length(_i_offset) <= 3, 2, length(_i_offset) - 3))"), F.expr("if(length(_i_offset) <= 3, '00', right(_i_offset, 2))")
    offset_zone = F.when((F.length("_i_offset") > 1) & (hours.try_cast("int") <= 18) & (minutes.try_cast("int") < 60), F.concat(F.substring("_i_offset", 1, 1), F.lpad(hours, 2, "0"), F.lit(":"), minutes))
    region = F.when(_among("_i_name", [z for z in zones if "/" in z]), F.col("_i_name"))
    short = F.try_element_at(F.create_map(*[x for k, z in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(z))]), F.regexp_extract("_i_tail", r"^\(?([a-z]{1,4})\)?$", 1))
    brasilia = F.when(F.col("_i_tail").rlike(r"^\(?\s*(?:no\s+)?hor[áa]rio\s+(?:oficial\s+)?de\s+bras[íi]lia\s*\)?$"), F.lit("America/Sao_Paulo"))
    d = d.withColumn("_i_zone", F.coalesce(offset_zone, short, region, brasilia))
    midnight = (F.col("_i_hour") == 24) & (F.col("_i_minute") == 0)
    d = d.withColumns({"_i_local": F.try_make_timestamp_ntz("_i_year", "_i_month", F.col("_i_day").try_cast("int"), F.when(midnight, 0).otherwise(F.col("_i_hour")), "_i_minute", "_i_second"), "_i_next": midnight})
    local = F.when(F.col("_i_next"), F.col("_i_local") + F.expr("interval 1 day")).otherwise(F.col("_i_local"))
    ok = ((F.col("_i_tail") == "") | F.col("_i_zone").isNotNull()) & F.col("_i_local").isNotNull() & F.col("_i_epoch").isNull()
    return d.select(*[F.col(c) for c in df.columns if c != out], F.struct(F.when(ok, local).alias("local"), F.when(ok, F.col("_i_zone")).alias("zone"), F.col("_i_epoch").alias("epoch_micros")).alias(out))


def ntz_micros(ts: Column) -> Column:
    """Microseconds from 1970-01-01 to a timestamp_ntz, whatever the session's zone."""
    return (
        F.unix_date(ts.cast("date")).cast("long") * 86_400_000_000 + F.hour(ts).cast("long") * 3_600_000_000
        + F.minute(ts).cast("long") * 60_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    )


def to_utc_micros(parsed: Column, default_zone: Column) -> Column:
    """The instant of a ``parse_instants`` struct; ``default_zone`` holds where the value names none."""
    zone = F.coalesce(parsed["zone"], default_zone)
    return F.coalesce(parsed["epoch_micros"], F.when(zone.isNotNull(), ntz_micros(F.convert_timezone(zone, F.lit("UTC"), parsed["local"]))))


def estimate_zones(df: DataFrame, group: str, local: str, seen_micros: str, candidates: list[str] | None = None, tolerance: float = 0.0) -> DataFrame:
    """For each group, the zone whose offset history fits its local timestamps best.

    ``local`` is a timestamp_ntz, ``seen_micros`` the instant (in UTC microseconds) at which the row was
    ingested, which can't come before the timestamp. For every candidate zone the rows that would have
    been ingested before they were written are violations. Wrong timestamps violate in every zone, so the
    zones with the fewest violations (or a share within ``tolerance`` of theirs) are those that fit; too far east
    is never a violation, so of these the one with the smallest summed lag wins, ties by the order of
    ``candidates``. Zones whose histories differ in summer time only are told apart by rows of those months. Rows with a null in one of the three columns are left out, so a group
    without usable rows has no result.

    One partial aggregate per (group, zone): a group of any size costs the shuffle of one row per zone
    and map task.
    """
    zones = candidates or BRAZIL_ZONES
    usable = df.select(F.col(group).alias("_g"), F.col(local).alias("_l"), F.col(seen_micros).alias("_s"))
    tried = usable.withColumn("_z", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(z).alias("z")) for i, z in enumerate(zones)])))
    lag = F.col("_s") - ntz_micros(F.convert_timezone(F.col("_z.z"), F.lit("UTC"), F.col("_l")))
    # Rows without a usable pair of times have a null lag: no count and no sum takes them.
    scored = (
        tried.select("_g", "_z", lag.alias("_lag"))
        .groupBy("_g", "_z")
        .agg(F.count("_lag").alias("n"), F.count_if(F.col("_lag") < 0).alias("violations"), F.sum(F.abs(F.col("_lag") / 1e6)).alias("lag_s"))
        .where("n > 0 and _g is not null")
    )
    share = F.col("violations") / F.col("n")
    best = scored.withColumn("_least", F.min(share).over(Window.partitionBy("_g"))).where(share <= F.col("_least") + tolerance)
    won = best.groupBy("_g").agg(F.min_by(F.struct("_z", "n", "violations"), F.struct("lag_s", "_z.i")).alias("w"))
    return won.select(F.col("_g").alias(group), F.col("w._z.z").alias("time_zone"), F.col("w.n").alias("n_rows"), F.col("w.violations").alias("violations"))


#: The three fields and whether a value without a zone is wall time of the edition (else UTC).
FIELDS = {"date_published": True, "sitemap_lastmod": False, "sitemap_article_lastmod": True}

#: What is surely written before an article is first seen; its last modification may come later.
ALIGNED = {"date_published": True}


def edition(url: Column) -> Column:
    """The first path segment of an article's address, in lower case; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]+)", 1)), F.lit(""))


def parsed_fields(articles: DataFrame, fields: dict[str, bool] | None = None) -> DataFrame:
    """One row per url and field: url, edition, seen_micros, field_name, walled and the parsed struct p."""
    fields = fields or FIELDS
    values = F.array(*[F.struct(F.lit(f).alias("field_name"), F.lit(w).alias("walled"), F.col(f).alias("v")) for f, w in fields.items()])
    long = articles.select("url", edition(F.col("url")).alias("edition"), F.unix_micros("first_seen_at").alias("seen_micros"), F.inline(values))
    return parse_instants(long, "v", "p").drop("v")


def unzoned_times(rows: DataFrame) -> DataFrame:
    """(edition, local, seen_micros) of ``parsed_fields`` rows; local is null where the zone is known.

    No filter on the parsed struct: it would be pushed below the parsing, whose work would double.
    """
    local = F.when(F.col("walled") & F.col("p.zone").isNull(), F.col("p.local"))
    return rows.select("edition", local.alias("local"), "seen_micros")


def normalise_articles(articles: DataFrame, edition_zones: DataFrame) -> DataFrame:
    """(url, field_name, utc_micros) of every readable value of the three fields of instants.

    Editions that ``edition_zones`` doesn't name, or names with a null or unknown zone, get the zone that
    ``estimate_zones`` finds from their articles' dates of publication and first_seen_at; a wall time
    without either is no case.
    """
    known = set(available_zones(articles.sparkSession))
    zones = edition_zones.where(_among("time_zone", known)).groupBy(F.lower("edition").alias("edition")).agg(F.min("time_zone").alias("time_zone"))
    other = articles.withColumn("_edition", edition(F.col("url"))).join(zones, F.col("_edition") == zones["edition"], "left_anti")
    estimated = estimate_zones(unzoned_times(parsed_fields(other, ALIGNED)), "edition", "local", "seen_micros")
    # One row per edition; written out first, so that its size is known and the long table needn't move for it.
    every = written(zones.unionByName(estimated.select("edition", "time_zone")))
    joined = parsed_fields(articles).join(every, "edition", "left")
    zone = F.when(F.col("walled"), F.col("time_zone")).otherwise("UTC")
    return joined.select("url", "field_name", to_utc_micros(F.col("p"), zone).alias("utc_micros")).where("utc_micros is not null")
