"""Mixed timestamp normalisation: candidate interpretations as rows, votes of unmistakable stamps per source, and the candidate of rank 1.

A stamp is stripped of ASCII white space. Ten digits are seconds since 1970, thirteen milliseconds; other stamps are a date (y-m-d, ymd,
d.m.y, d b y, d/m/y or m/d/y) with an optional time, AM or PM, and offset. A slashed date is exploded into its day-first and month-first
interpretations. Where only one of them is a date, the stamp is a vote for that order in its source; where both are, and differ, the
candidates are ranked by their order's votes, day first at a tie, and rank 1 stays. Dates without an offset are wall times of the stamp's
zone; one that a change of the clock skips or repeats takes the offset after the change.

Votes are counted per source with partial sums; only stamps with two candidates meet them, by source and salt, with as many salts as
there are shuffle partitions, so a source of any size is spread. Nothing is collected, and no row is grouped with another: repeated rows
and ids need no care. Every other stamp is settled where it is read.

Edge cases: a null source is a source of its own; a null, empty or unknown zone makes a stamp without an offset bad, which then does not
vote; epochs and stamps with an offset need no zone; a text of any length is one stamp, and bad if it has more than the grammar allows;
empty tables give an empty result; other columns, whatever their names, stay in ``normalise`` and are not in the query. Zones with
two changes of the clock within 32 hours are not foreseen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelmill.llm._base import ASCII_SPACE, read_table, width

MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
_NAMES = "|".join(MONTHS[i : i + 3] for i in range(0, 36, 3))
#: Groups: year, month and day of y-m-d, ymd, d.m.y, d b y and slashed dates; hour, minute, second, half of the day, Z, sign, hours and minutes of the offset.
STAMP = (
    rf"\A(?:(20\d\d)-(\d\d)-(\d\d)|(20\d\d)(\d\d)(\d\d)|(\d\d)[.](\d\d)[.](20\d\d)|(\d\d) ({_NAMES}) (20\d\d)|(\d\d)(/)(\d\d)/(20\d\d))"
    r"(?:[T ](\d\d):(\d\d)(?::(\d\d))?(?: ?([AP])M)?(?: ?(?:(Z)|([+-])(\d\d):?(\d\d)))?)?\z"
).replace(r"\d", "[0-9]")
#: Year, month, day, slash, hour, minute, second, half, Z or sign, offset's hours and minutes.
_PARTS = "$1$4$9$12$16|$2$5$8$11$15|$3$6$7$10$13|$14|$17|$18|$19|$20|$21$22|$23|$24"
EPOCH = r"\A(?:[0-9]{10}|[0-9]{13})\z"
_SECOND, _HOUR = 1_000_000, 3_600_000_000


def candidates(rows: DataFrame, raw: Column, source: Column, zone: Column) -> DataFrame:
    """(row, source, zone, epoch_us, offset_us, clock_us, order, day, n): a row for each of the n possible interpretations, one with nulls for none.

    order is day or month where a slashed date's order matters, else null.
    """
    text = F.trim(raw.cast("string"), F.lit(ASCII_SPACE))
    given = rows.select(F.struct("*").alias("row"), source.cast("string").alias("source"), F.trim(zone.cast("string")).alias("zone"), text.alias("text"))
    parts = F.when(F.col("text").rlike(STAMP), F.split(F.regexp_replace("text", STAMP, _PARTS), "[|]", -1))
    epoch = F.when(F.col("text").rlike(EPOCH), F.col("text").cast("long") * F.when(F.length("text") == 10, _SECOND).otherwise(1000))
    split = given.select("row", "source", "zone", epoch.alias("epoch_us"), parts.alias("p"))
    named = split.withColumn("v", F.transform("p", lambda x: F.when(F.length(x) == 3, F.floor((F.position(x, F.lit(MONTHS)) + 2) / 3).cast("int")).when((x >= "0") & (x < ":"), x.cast("int"))))

    v, hour, half, sign = (lambda k: F.get("v", k)), F.get("v", 4), F.get("p", 7), F.get("p", 8)
    hours = F.when(half == "", F.when(hour <= 23, hour)).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "P", 12).otherwise(0))
    clock = F.when(hour.isNull(), 0).when((v(5) <= 59) & (F.coalesce(v(6), F.lit(0)) <= 59), hours * 3600 + v(5) * 60 + F.coalesce(v(6), F.lit(0)))
    size = F.when((v(9) <= 14) & (v(10) <= 59), v(9) * 3600 + v(10) * 60)
    offset = F.when(sign == "Z", 0).when(sign == "-", -size).when(sign == "+", size)
    # Spark takes a zone's name at the end of a timestamp; if that fails it is none
    zoned = (F.col("zone") != "") & F.concat(F.lit("2024-01-01 00:00:00 "), F.col("zone")).try_cast("timestamp").isNotNull()
    placed = F.when(sign == "", zoned).otherwise(offset.isNotNull())
    # the same day and month: one date, whose order does not matter
    either = (F.get("p", 3) == "/") & (v(1) != v(2))
    date = lambda *ymd: F.unix_date(F.concat_ws("-", *ymd).try_cast("date"))
    options = F.array(F.struct(F.when(either, "day").alias("order"), date(v(0), v(1), v(2)).alias("day")), F.struct(F.lit("month").alias("order"), F.when(either, date(v(0), v(2), v(1))).alias("day")))
    fields = named.select("row", "source", "zone", "epoch_us", (offset.cast("long") * _SECOND).alias("offset_us"), (clock.cast("long") * _SECOND).alias("clock_us"), F.when(placed, F.filter(options, lambda c: c["day"].isNotNull())).alias("dates"))
    dates = F.when(F.col("clock_us").isNotNull(), F.transform("dates", lambda c: F.struct(c["order"].alias("order"), c["day"].cast("long").alias("day"), F.size("dates").alias("n"))))
    kept = ["row", "source", "zone", "epoch_us", "offset_us", "clock_us"]
    return fields.select(*kept, F.explode_outer(dates).alias("c")).select(*kept, "c.order", "c.day", "c.n")


def _offset(wall: Column, hours: int, zone: Column) -> Column:
    """The zone's offset at the instant that is so many hours from the wall time taken as UTC."""
    at = F.timestamp_micros(wall + hours * _HOUR)
    return F.unix_micros(F.from_utc_timestamp(at, zone)) - F.unix_micros(at)


def _settled(kept: DataFrame) -> DataFrame:
    """kept (row, zone, epoch_us, offset_us, clock_us, day, rule) to (row, utc_us, rule, ambiguous)."""
    wall = F.col("day") * 24 * _HOUR + F.col("clock_us")
    local = kept.withColumn("wall", F.when(F.col("epoch_us").isNull(), wall))
    by_zone = F.col("wall").isNotNull() & F.col("offset_us").isNull()
    # an instant lies within 14 hours of its wall time, so these are the offsets before and after any change near it
    sides = local.withColumns({"before": F.when(by_zone, _offset(F.col("wall"), -16, F.col("zone"))), "after": F.when(by_zone, _offset(F.col("wall"), 16, F.col("zone")))})
    holds = lambda c: _offset(F.col("wall") - F.col(c), 0, F.col("zone")) == F.col(c)
    changed = F.col("before") != F.col("after")
    marked = sides.withColumns({"early": F.when(changed, holds("before")), "late": F.when(changed, holds("after"))})
    odd = F.coalesce(F.col("early") == F.col("late"), F.lit(False))  # both hold: repeated; neither: skipped
    offset = F.when(F.col("early") & ~F.col("late"), F.col("before")).otherwise(F.col("after"))
    utc = F.coalesce("epoch_us", F.col("wall") - F.coalesce("offset_us", offset))
    return marked.select("row", utc.alias("utc_us"), "rule", (odd | F.col("rule").isin("votes", "default")).alias("ambiguous"))


def votes(read: DataFrame) -> DataFrame:
    """(source, day_votes, month_votes): stamps that are a date in one order only."""
    single = read.where("n = 1 AND order IS NOT NULL")
    return single.groupBy("source").agg(F.count_if(F.col("order") == "day").alias("day_votes"), F.count_if(F.col("order") == "month").alias("month_votes"))


def normalise(stamps: DataFrame, raw_col: str = "raw", source_col: str = "source", zone_col: str = "zone", ratio: int = 1) -> DataFrame:
    """(row, utc_us, rule, ambiguous) of every row, which is kept whole: an order wins with over ``ratio`` times the other's votes, else day first."""
    columns = [F.col(f"`{c}`") for c in (raw_col, source_col, zone_col)]
    kept = ["row", "zone", "epoch_us", "offset_us", "clock_us", "day", "rule"]
    single = F.when(F.col("epoch_us").isNotNull(), "epoch").when(F.col("n").isNull(), "bad").otherwise("plain")
    one = candidates(stamps, *columns).where("coalesce(n, 0) < 2").withColumn("rule", single)

    salts = width(stamps.sparkSession)
    slashed = stamps.where(columns[0].contains("/"))
    counted = votes(candidates(slashed, *columns)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumnRenamed("source", "voters")
    two = candidates(slashed, *columns).where("n = 2").withColumn("salt", (F.monotonically_increasing_id() % salts).cast("int"))
    met = two.join(counted, F.col("source").eqNullSafe(F.col("voters")) & (two["salt"] == counted["salt"]), "left")
    day, month = F.coalesce("day_votes", F.lit(0)), F.coalesce("month_votes", F.lit(0))
    verdict = F.when(day > ratio * month, "day").when(month > ratio * day, "month")
    ranked = met.withColumns({"rank": F.when(F.col("order") == F.coalesce(verdict, F.lit("day")), 1).otherwise(2), "rule": F.when(verdict.isNull(), "default").otherwise("votes")})
    return _settled(one.select(kept).unionByName(ranked.where("rank = 1").select(kept)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = normalise(read_table(spark, sf_dir, "stamps"))
    return done.select("row.stamp_id", "utc_us", "rule", "ambiguous")


_SQL_DATE = f"20[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}|20[0-9]{{6}}|[0-9]{{2}}[.][0-9]{{2}}[.]20[0-9]{{2}}|[0-9]{{2}} (?:{_NAMES}) 20[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/20[0-9]{{2}}"
_SQL_TIME = "(?:[T ]([0-9]{2}):([0-9]{2})(?::([0-9]{2}))?(?: ?([AP])M)?(?: ?(Z|[+-][0-9]{2}:?[0-9]{2}))?)?"

SQL = r"""
WITH s AS (SELECT row_number() OVER () AS k, stamp_id, source, zone, trim(raw, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM stamps),
g AS (SELECT *, regexp_full_match(t, '[0-9]{10}|[0-9]{13}') AS epoch, regexp_full_match(t, '""" + f"(?:{_SQL_DATE}){_SQL_TIME}" + r"""') AS dated,
             regexp_extract(t, '^(""" + f"{_SQL_DATE}){_SQL_TIME}" + r"""$', ['date', 'h', 'm', 's', 'half', 'off']) AS p FROM s),
c AS (SELECT *, p.date AS d, TRY_CAST(p.h AS INTEGER) AS h, TRY_CAST(p.m AS INTEGER) AS mi, coalesce(TRY_CAST(p.s AS INTEGER), 0) AS se,
             CASE WHEN p.off IN ('', 'Z') THEN 0 ELSE TRY_CAST(p.off[2:3] AS INTEGER) END AS oh, CASE WHEN p.off IN ('', 'Z') THEN 0 ELSE TRY_CAST(right(p.off, 2) AS INTEGER) END AS om FROM g),
v AS (SELECT *, dated AND (p.h = '' OR (mi <= 59 AND se <= 59 AND CASE WHEN p.half = '' THEN h <= 23 ELSE h BETWEEN 1 AND 12 END)) AND oh <= 14 AND om <= 59 AS fine,
             CASE WHEN p.h = '' THEN 0 ELSE CASE WHEN p.half = '' THEN h ELSE h % 12 + CASE p.half WHEN 'P' THEN 12 ELSE 0 END END * 3600 + mi * 60 + se END AS clock,
             CASE WHEN p.off <> '' THEN CASE WHEN p.off[1:1] = '-' THEN -1 ELSE 1 END * (oh * 60 + om) * CAST(60000000 AS BIGINT) END AS offset_us FROM c),
n AS (SELECT *, CASE WHEN NOT fine THEN NULL
                     WHEN length(d) = 8 THEN TRY_CAST(d[1:4] || '-' || d[5:6] || '-' || d[7:8] AS DATE)
                     WHEN length(d) = 11 THEN TRY_CAST(d[8:11] || '-' || lpad(CAST((instr('""" + MONTHS + r"""', d[4:6]) + 2) // 3 AS VARCHAR), 2, '0') || '-' || d[1:2] AS DATE)
                     WHEN d[5:5] = '-' THEN TRY_CAST(d AS DATE)
                     ELSE TRY_CAST(d[7:10] || '-' || d[4:5] || '-' || d[1:2] AS DATE) END AS a,
                CASE WHEN fine AND d[3:3] = '/' THEN TRY_CAST(d[7:10] || '-' || d[1:2] || '-' || d[4:5] AS DATE) END AS b, d[3:3] = '/' AS slashed FROM v),
w AS (SELECT source, count(*) FILTER (WHERE a IS NOT NULL AND b IS NULL) AS dv, count(*) FILTER (WHERE a IS NULL AND b IS NOT NULL) AS mv FROM n WHERE slashed GROUP BY source),
r AS (SELECT n.*, CASE WHEN epoch THEN 'epoch' WHEN a IS NULL AND b IS NULL THEN 'bad' WHEN a <> b THEN CASE WHEN dv <> mv THEN 'votes' ELSE 'default' END ELSE 'plain' END AS rule,
             CASE WHEN a <> b AND mv > dv THEN b ELSE coalesce(a, b) END AS day FROM n LEFT JOIN w ON n.source IS NOT DISTINCT FROM w.source),
l AS (SELECT *, CASE WHEN rule NOT IN ('epoch', 'bad') THEN epoch_us(CAST(day AS TIMESTAMP)) + CAST(clock AS BIGINT) * 1000000 END AS wall FROM r),
o AS (SELECT *, CASE WHEN offset_us IS NULL THEN epoch_us(timezone(zone, timezone('UTC', make_timestamp(wall - 57600000000)))) - (wall - 57600000000) END AS o1,
                CASE WHEN offset_us IS NULL THEN epoch_us(timezone(zone, timezone('UTC', make_timestamp(wall + 57600000000)))) - (wall + 57600000000) END AS o2 FROM l),
h AS (SELECT *, epoch_us(timezone(zone, timezone('UTC', make_timestamp(wall - o1)))) - (wall - o1) = o1 AS early,
                epoch_us(timezone(zone, timezone('UTC', make_timestamp(wall - o2)))) - (wall - o2) = o2 AS late FROM o)
SELECT stamp_id, CASE WHEN rule = 'epoch' THEN CAST(t AS BIGINT) * CASE length(t) WHEN 10 THEN 1000000 ELSE 1000 END
                      WHEN rule <> 'bad' THEN wall - coalesce(offset_us, CASE WHEN early AND NOT late THEN o1 ELSE o2 END) END AS utc_us, rule,
       coalesce(rule IN ('votes', 'default') OR (o1 <> o2 AND early = late), false) AS ambiguous
FROM h
"""
