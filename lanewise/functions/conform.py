"""Scalar clean-up of race data: names, venues, keys, codes, numbers, timings, bet labels and combinations."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The 24 official venues by number; labels of winning methods, compass points and bet types as the
# reports spell them.
VENUES = ["桐生", "戸田", "江戸川", "平和島", "多摩川", "浜名湖", "蒲郡", "常滑", "津", "三国", "びわこ", "住之江", "尼崎", "鳴門", "丸亀", "児島", "宮島", "徳山", "下関", "若松", "芦屋", "福岡", "唐津", "大村"]
WIN_METHODS = {"まくり差し": "MAKURI_SASHI", "まくり": "MAKURI", "差し": "SASHI", "逃げ": "NIGE", "抜き": "NUKI", "恵まれ": "MEGUMARE"}
COMPASS = ["北", "北北東", "北東", "東北東", "東", "東南東", "南東", "南南東", "南", "南南西", "南西", "西南西", "西", "西北西", "北西", "北北西"]
BET_LABELS = {
    "3連単": ["三連単", "３連単", "3連単", "3T", "3t", "TRIFECTA"],
    "3連複": ["三連複", "３連複", "3連複", "3F", "3f", "TRIO"],
    "2連単": ["二連単", "２連単", "2連単", "2T", "2t", "EXACTA"],
    "二連複": ["二連複", "２連複", "2連複", "2F", "2f", "QUINELLA"],
    "拡連複": ["拡連複", "ワイド", "WIDE"],
    "単勝": ["単勝", "WIN"],
    "複勝": ["複勝", "PLACE"],
}
WIDE_DIGITS = "０１２３４５６７８９"


def lookup(key: Column, values: dict) -> Column:
    """The value of key in a literal map; null if it isn't there."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in values.items() for x in kv)), key)


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode NFKC, which no Spark function has; null stays null."""
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def collapse_spaces(c: Column) -> Column:
    """Runs of spaces, tabs and ideographic spaces become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t　]+", " "))


def spaced_place(c: Column) -> Column:
    """A place name of two characters gets a space between them."""
    return F.when(F.length(c) == 2, F.concat(F.substring(c, 1, 1), F.lit(" "), F.substring(c, 2, 1))).otherwise(c)


def venue_number(c: Column) -> Column:
    """Two-digit venue number of a name or a number; other texts come back without white space."""
    bare = F.regexp_replace(c, r"[\s　]+", "")
    return F.coalesce(F.when(bare.rlike(r"^[0-9]{1,2}$"), F.lpad(bare, 2, "0")), lookup(bare, {n: f"{i:02d}" for i, n in enumerate(VENUES, 1)}), bare)


def race_key(date: Column, race_no: Column, stadium: Column) -> Column:
    """YYYY-MM-DD-NN-venue; null if any part is."""
    return F.concat(F.date_format(date, "yyyy-MM-dd"), F.lit("-"), F.lpad(race_no.cast("string"), 2, "0"), F.lit("-"), venue_number(stadium))


def rank_of(finish: Column) -> Column:
    return F.when(finish.between(1, 6), finish).otherwise(F.lit(7)).cast("int")


def win_pattern(method: Column) -> Column:
    return F.coalesce(lookup(method, WIN_METHODS), F.lit("OTHER"))


def compass_degrees(name: Column) -> Column:
    return lookup(name, {n: i * 22.5 for i, n in enumerate(COMPASS)})


def wind_icon_degrees(icon: Column) -> Column:
    """is-windN: N times 22.5 degrees for 1 to 15, 0 for 16, null otherwise."""
    n = F.regexp_extract(icon, r"^is-wind([1-9]|1[0-6])$", 1).try_cast("int")
    return F.when(n.isNotNull(), (n % 16) * 22.5)


def to_number(c: Column) -> Column:
    """The number that is left when all but digits and points are gone; null if none is."""
    return F.nullif(F.regexp_replace(c, r"[^0-9.]", ""), F.lit("")).try_cast("double")


def start_timing(raw: Column) -> Column:
    """.12, 0.1 or 0.12 as a number, negative after F; null for other texts."""
    bare = F.regexp_replace(raw, "^F", "")
    value = F.when(bare.rlike(r"^(\.[0-9]{2}|[0-9]\.[0-9]{1,2})$"), bare.try_cast("decimal(4,2)"))
    return F.when(raw.startswith("F"), -value).otherwise(value)


def false_start_flag(raw: Column) -> Column:
    return F.substring(raw, 1, 1) == "F"


def signed_start(timing: Column, status: Column) -> Column:
    """The timing, negative for a false start; a null status leaves it as it is."""
    return F.when(status == "F", -timing).otherwise(timing)


def bet_type(label: Column) -> Column:
    return F.coalesce(lookup(label, {alias: name for name, aliases in BET_LABELS.items() for alias in aliases}), label)


def combination_digits(c: Column) -> Column:
    """Three lanes as 'abc' if exactly three digits 1-6 are left in the combination, else null."""
    digits = F.regexp_replace(F.translate(c, WIDE_DIGITS, "0123456789"), "[^0-9]+", "")
    return F.when(digits.rlike("^[1-6]{3}$"), digits)


def lanes_of(digits: Column, ordered: bool = True) -> Column:
    """The three lanes of combination_digits as an array; ascending for bets without order."""
    lanes = F.array(*(F.substring(digits, i, 1).cast("int") for i in (1, 2, 3)))
    return F.when(digits.isNotNull(), lanes if ordered else F.array_sort(lanes))


def sort_three(a: Column, b: Column, c: Column) -> tuple[Column, Column, Column]:
    """Least, middle and greatest of three numbers; null if any is."""
    known = a.isNotNull() & b.isNotNull() & c.isNotNull()
    low, high = F.least(a, b, c), F.greatest(a, b, c)
    return F.when(known, low), F.when(known, a + b + c - low - high), F.when(known, high)


def odds_of(payout_yen: Column) -> Column:
    return payout_yen / F.lit(100.0)


def wave_metres(cm: Column) -> Column:
    return cm / F.lit(100.0)


def wind_parts(degrees: Column) -> tuple[Column, Column]:
    return F.sin(F.radians(degrees)), F.cos(F.radians(degrees))


def file_date_and_race(path: Column, prefix: str = "beforeinfo") -> tuple[Column, Column]:
    """Date and race number that a page's file name ends with; null if it has another form."""
    tail, pattern = F.right(path, F.lit(100)), prefix + r"_[0-9]+_([0-9]{8})_([0-9]+)\.html$"
    return F.to_date(F.nullif(F.regexp_extract(tail, pattern, 1), F.lit("")), "yyyyMMdd"), F.regexp_extract(tail, pattern, 2).try_cast("int")


def wind_bin(speed: Column) -> Column:
    """Left-closed bins at 2, 4, 6 and 8 as struct(id, low, high); null in, null out."""
    return cut(speed, [2.0, 4.0, 6.0, 8.0])


def wave_bin(metres: Column) -> Column:
    return cut(metres, [0.5, 1.0, 2.0])


def cut(c: Column, edges: list[float]) -> Column:
    bounds = [None, *edges, None]
    out = F.lit(None)
    for i in reversed(range(len(edges) + 1)):
        box = F.struct(F.lit(i).alias("id"), F.lit(bounds[i]).cast("double").alias("low"), F.lit(bounds[i + 1]).cast("double").alias("high"))
        out = box if i == len(edges) else F.when(c < edges[i], box).otherwise(out)
    return F.when(c.isNotNull() & ~F.isnan(c.cast("double")), out)


def month_cutoffs(day: Column) -> dict[str, Column]:
    """Training limit and evaluation bounds: the last and first day of the previous month."""
    before = F.add_months(day, -1)
    return {"train_until": F.last_day(before), "eval_from": F.trunc(before, "MM").cast("date"), "eval_until": F.last_day(before)}


def period_ends(day: Column) -> dict[str, Column]:
    return {"is_week_end": F.weekday(day) == 6, "is_month_end": day == F.last_day(day)}
