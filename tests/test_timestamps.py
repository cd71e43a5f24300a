from __future__ import annotations

from datetime import UTC, datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from loomdex.operators.timestamps import normalise

ZONES = [("a", "Europe/Berlin", "DMY"), ("b", "America/New_York", "MDY"), ("c", None, None), ("d", "UTC", None)]


def us(*args, zone="UTC", fold=0, micro=0):
    return int(datetime(*args, tzinfo=ZoneInfo(zone), fold=fold).timestamp()) * 1_000_000 + micro


CASES = [
    ("a", "2020-01-02T03:04:05Z", us(2020, 1, 2, 3, 4, 5)),
    ("a", "2020-01-02T03:04:05.123456789+02:00", us(2020, 1, 2, 1, 4, 5, micro=123456)),
    ("a", "2020-01-02 03:04:05,5", us(2020, 1, 2, 3, 4, 5, zone="Europe/Berlin", micro=500000)),
    ("a", "2020-05-02T21:17:36-04:00[Europe/Berlin]", us(2020, 5, 3, 1, 17, 36)),
    ("a", "2019-W30-7T04:00:02+09:00", us(2019, 7, 27, 19, 0, 2)),
    ("a", "2019-123", us(2019, 5, 3)),
    ("a", "20211007T173654Z", us(2021, 10, 7, 17, 36, 54)),
    ("a", "1506393011", 1506393011 * 1_000_000),
    ("a", "1636260642623", 1636260642623 * 1000),
    ("a", "1449609198257508", 1449609198257508),
    ("a", " Thu,  26 Apr 2018 08:30:48 +0200\t", us(2018, 4, 26, 6, 30, 48)),
    ("a", "Mon, 8 Nov 16 20:02:27 -0500 (EST)", us(2016, 11, 9, 1, 2, 27)),
    ("a", "Sun, 16 Nov 2014 09:48:23 EST", us(2014, 11, 16, 14, 48, 23)),
    ("a", "2024-05-22 04:50 Asia/Tokyo", us(2024, 5, 21, 19, 50)),
    ("a", "January 26, 2019, 06:03:38 AM", us(2019, 1, 26, 5, 3, 38)),
    ("b", "Jun 19, 2017 12:16:44 am", us(2017, 6, 19, 4, 16, 44)),
    ("a", "7 de marzo de 2020 00:01", us(2020, 3, 6, 23, 1)),
    ("a", "18 décembre 2021 à 16:26", us(2021, 12, 18, 15, 26)),
    ("a", "19. Januar 2020 14:22", us(2020, 1, 19, 13, 22)),
    ("a", "03/12/2016 22:05", us(2016, 12, 3, 21, 5)),
    ("b", "03/12/2016 22:05", us(2016, 3, 13, 3, 5)),
    ("a", "16.03.2021", us(2021, 3, 16)),
    ("b", "2021-11-07 01:30:00", us(2021, 11, 7, 5, 30)),  # occurs twice: the first
    ("b", "2021-03-14 02:30:00", us(2021, 3, 14, 7, 30)),  # skipped: the offset before
    ("c", "2021-03-14 02:30:00", None),
    ("a", "2021-02-30", None),
    ("a", "2021-01-01 25:61:00", None),
    ("a", "0000-00-00 00:00:00", None),
    ("a", "yesterday", None),
    ("a", "13:17", None),
    ("a", "", None),
    ("a", "2021-01-01 10:00 Nowhere/Land", None),
    ("a", "9" * 3000, None),
    ("a", None, None),
    (None, "2020-01-02", us(2020, 1, 2)),
]


@pytest.fixture(scope="module")
def got(spark):
    rows = [(i, s, v, "mine", 7) for i, (s, v, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "n int, feed string, value string, status string, `_row` int")
    zones = spark.createDataFrame(ZONES, "source string, zone_name string, date_order string")
    return {r["n"]: r for r in normalise(df, "value", "feed", zones).collect()}


@pytest.mark.parametrize("n", range(len(CASES)))
def test_case(got, n):
    assert got[n]["utc_us"] == CASES[n][2], CASES[n]
    assert got[n]["_row"] == 7 and got[n]["status"] != "mine"


def test_statuses(got):
    by = {CASES[n][1]: r["status"] for n, r in got.items()}
    assert by["yesterday"] == "unreadable" and by[None] == "null"
    assert got[24]["status"] == "no_zone"


def test_mixture_learns_order(spark):
    """Without a declared order, the order seen in unambiguous values of the source decides; without evidence it is ambiguous."""
    rows = [("d", f"{d:02d}/05/2020 10:00") for d in range(13, 29)] * 8 + [("d", "03/04/2020 10:00"), ("d", "05/05/2020 10:00"), ("e", "03/04/2020 10:00")]
    zones = spark.createDataFrame([("d", "UTC", None), ("e", "UTC", None)], "source string, zone_name string, date_order string")
    out = normalise(spark.createDataFrame(rows, "s string, v string"), "v", "s", zones)
    one = {(r.s, r.v): r for r in out.where(F.col("v").isin("03/04/2020 10:00", "05/05/2020 10:00")).collect()}
    assert one[("d", "03/04/2020 10:00")].utc_us == us(2020, 4, 3, 10) and one[("d", "03/04/2020 10:00")].reading == "dmy"
    assert one[("d", "05/05/2020 10:00")].status == "ok"
    assert one[("e", "03/04/2020 10:00")].status == "ambiguous" and one[("e", "03/04/2020 10:00")].utc_us is None


def test_empty(spark):
    zones = spark.createDataFrame([], "source string, zone_name string, date_order string")
    assert normalise(spark.createDataFrame([], "v string, s string"), "v", "s", zones).count() == 0
    out = normalise(spark.createDataFrame([("2020-01-01T00:00:00Z", "x"), ("2020-01-01T00:00:00Z", "x")], "v string, s string"), "v", "s", zones).collect()
    assert [r.utc_us for r in out] == [us(2020, 1, 1)] * 2


def test_against_log(spark, sf):
    """Instants of stored documents lie before their log entry but for a few late or moved ones."""
    from loomdex.session import read_table

    n = normalise(read_table(spark, sf, "documents", "id", "created_at", "source"), "created_at", "source", read_table(spark, sf, "source_zones"))
    log = read_table(spark, sf, "change_log").where("change_type = 'insert'").groupBy(F.col("doc_id").alias("id")).agg(F.unix_micros(F.min("changed_at")).alias("at"))
    gaps = [r[0] for r in n.join(log, "id").where("utc_us is not null").select((F.col("at") - F.col("utc_us")) / 3.6e9).collect()]
    assert len(gaps) > 50 and sum(0 <= g < 400 for g in gaps) > 0.9 * len(gaps)
    assert datetime.now(UTC)
