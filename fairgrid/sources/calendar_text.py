"""iCalendar text to rows, and recurrence sets to occurrences.

Files are split where a component begins, so a large one is read by many tasks.
A component's lines are unfolded and folded over with the depth of BEGIN and
END, so that an alarm's properties aren't the event's; a property has its
parameters. Times are in their own zone: UTC, a named zone, or one that the
file itself defines by rules.

Recurrence goes by periods (days, weeks, months or years): only those that can
meet the window are made, each with its days by the rule's parts, in order, so
that positions in a period can be picked. A COUNT of plain daily and weekly
rules is turned into their last day by arithmetic; only other counted rules
list their periods from the first one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, times
from ..functions.lineage import cut, small
from .ordered import in_order

#: Weekdays in rules, Monday first.
DAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")
#: Parts of rules that expand() knows; FREQ below a day isn't among its frequencies.
PARTS = ("FREQ", "INTERVAL", "COUNT", "UNTIL", "BYDAY", "BYMONTHDAY", "BYYEARDAY", "BYWEEKNO", "BYMONTH", "BYSETPOS", "BYHOUR", "BYMINUTE", "BYSECOND", "WKST")
FREQUENCIES = ("DAILY", "WEEKLY", "MONTHLY", "YEARLY")
_STAMP = r"^(\d{4})(\d{2})(\d{2})(?:T(\d{2})(\d{2})(\d{2})(Z?))?$"
_PARAMETERS = r'((?:;[^=;:"\n]+=(?:"[^"\n]*"|[^";:\n]*))*)'
#: A component without others in it, as lines of a text.
_INNERMOST = r"(?i)\nBEGIN:[^\n]*(?:\n(?!BEGIN:|END:)[^\n]*)*+\nEND:[^\n]*"
#: An observance of a zone: wall times from ``start`` on have the offset ``after``, until the next one begins.
RULES = "array<struct<start:timestamp,before:int,after:int,month:int,nth:int,weekday:int,until:timestamp,dates:array<timestamp>>>"


# -- components ---------------------------------------------------------------


def _lines(c: Column) -> Column:
    """Unfolded lines that aren't empty, each behind a line break, as a text.

    Patterns are for the texts that need them; the others are cut as bytes.
    """
    rare = F.contains(c, F.lit("\r")) | F.contains(c, F.lit("\n\t"))
    unfolded = F.when(rare, F.regexp_replace(c, r"\r?\n[ \t]", "")).otherwise(F.replace(c, F.lit("\n "), F.lit("")))
    every = F.concat(F.lit("\n"), F.ltrim(unfolded, F.lit("\n")))
    return F.when(F.contains(every, F.lit("\r")) | F.contains(every, F.lit("\n\n")), F.regexp_replace(every, r"(?:\r?\n)++", "\n")).otherwise(every)


def _own(lines: Column) -> Column:
    """Of _lines() those that aren't inside of a component further down.

    Innermost components go until none is left, at most as many times as there
    are begins; lines behind a begin without its end are inside of it.
    """
    nested = F.size(F.regexp_extract_all(lines, F.lit(r"(?i)(\nBEGIN:)"), F.lit(1)))
    left = F.aggregate(F.sequence(F.lit(1), nested), lines, lambda at, _: F.regexp_replace(at, _INNERMOST, ""))
    left = F.when(nested > 0, F.regexp_replace(left, r"(?is)\nBEGIN:.*", "")).otherwise(lines)
    return F.regexp_replace(left, r"(?i)\nEND:[^\n]*", "")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(seq, file, whole, component, other) of calendar files, seq in the order of files and places.

    component: an event's lines as of _lines(), null in what comes before a
    file's first one, and in an event without its end: these aren't whole;
    other: the text between this event's end and the next one's begin, with
    zones and other components in it.
    """
    rows = in_order(spark.read.option("lineSep", "\nBEGIN:VEVENT").text(path).select("*", F.col("_metadata.file_path").alias("file")))
    value = F.concat(F.lit("\n"), F.col("value"))
    first = F.startswith("value", F.lit("BEGIN:VEVENT"))  # a file that begins with an event
    value = F.when(first, F.substring(value, 14, 1 << 30)).otherwise(value)
    whole, end = F.contains(value, F.lit("\nEND:VEVENT")), F.substring_index(value, "\nEND:VEVENT", 1)
    other = F.when(whole, F.substr(value, F.length(end) + 2)).otherwise(value)
    return rows.select("seq", "file", whole.alias("whole"), F.when(whole, _lines(end)).alias("component"), other.alias("other"))


def _found(own: Column, name: str) -> Column:
    """array of (parameters, value) of a property, from the own lines of a component."""
    of = rf"(?i)^{name}{_PARAMETERS}:(.*)$"
    lines = F.filter(F.split(own, "\n"), lambda x: x.rlike(f"(?s){of}"))
    every = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, f"(?s){of}", 1).alias("parameters"), text.strip(F.regexp_extract(x, f"(?s){of}", 2)).alias("value")))
    return F.when(own.rlike(rf"(?i)\n{name}[;:]"), every).otherwise(F.array().cast("array<struct<parameters:string,value:string>>"))


def _parameters(own: Column, name: str) -> Column:
    """The parameters of the first of a property; empty without one."""
    return F.regexp_extract(own, rf"(?i)\n{name}{_PARAMETERS}:", 1)


def _value(own: Column, name: str) -> Column:
    """The value of the first of a property; empty without one."""
    return text.strip(F.regexp_extract(own, rf"(?i)\n{name}{_PARAMETERS}:([^\n]*)", 2))


def _unescaped(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\\[nN]", "\n"), r"\\([,;\\])", "$1")


def _text(value: Column) -> Column:
    return text.blank_as_null(F.when(F.contains(value, F.lit("\\")), text.strip(_unescaped(value))).otherwise(value))


def _tzid(parameters: Column) -> Column:
    return text.blank_as_null(text.strip(F.regexp_extract(parameters, r'(?i);TZID="?([^";:]*)"?', 1)))


def _known_zone(tzid: Column) -> Column:
    """The named zone that an id is or ends in (after the maker's prefix); null for others."""
    tails = [F.substring_index(tzid, "/", -n) for n in (3, 2, 1)]
    named = [F.when(t.rlike(r"^[A-Za-z]") & F.try_to_timestamp(F.concat(F.lit("2000-01-01 "), t), F.lit("yyyy-MM-dd VV")).isNotNull(), t) for t in tails]
    # a failed try is dear, so none is made twice
    return F.coalesce(named[0], *[F.when(tails[n] != tails[n - 1], named[n]) for n in (1, 2)])


def _naive(value: Column) -> Column:
    """A date or time as it is written, as if in UTC; null for anything else."""
    clock = F.when(F.length(value) == 8, "000000").otherwise(F.substring(value, 10, 6))
    return F.when(value.rlike(_STAMP), F.try_to_timestamp(F.concat(F.substring(value, 1, 8), clock), F.lit("yyyyMMddHHmmss")))


def _is_utc(value: Column) -> Column:
    return F.endswith(value, F.lit("Z"))


def _is_date(value: Column) -> Column:
    return value.rlike(r"^\d{8}$")


def _seconds(duration: Column) -> tuple[Column, Column]:
    """Days and seconds of a duration such as P1W, -P1DT2H or PT30M; null for anything else."""
    of = r"^([+-]?)P(?:(\d+)W)?(?:(\d+)D)?(?:T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"
    n = [F.coalesce(F.concat(F.lit("0"), F.regexp_extract(duration, of, i)).try_cast("int"), F.lit(0)) for i in range(2, 7)]
    sign = F.when(F.startswith(duration, F.lit("-")), -1).otherwise(1)
    good = duration.rlike(of) & duration.rlike(r"\d")
    return F.when(good, sign * (7 * n[0] + n[1])), F.when(good, sign * (3600 * n[2] + 60 * n[3] + n[4]))


# -- zones that files define ----------------------------------------------------


def _later(naive: Column, seconds: Column) -> Column:
    return (F.unix_timestamp(naive) + seconds).cast("timestamp")


def _nth_weekday(year: Column, month: Column, nth: Column, weekday: Column) -> Column:
    first = F.make_date(year, month, F.lit(1))
    last = F.last_day(first)
    ahead = F.date_add(first, F.pmod(weekday - F.weekday(first), F.lit(7)) + 7 * (nth - 1))
    return F.when(nth > 0, ahead).otherwise(F.date_sub(last, F.pmod(F.weekday(last) - weekday, F.lit(7)) + 7 * (-nth - 1)))


def zones(chunks: DataFrame) -> DataFrame:
    """(file, tzid, rules) of the zones that files define, a row for each file and id: of several the file's first.

    A file may define a zone again with each of its events, so equal texts meet before they are read.
    """
    blocks = F.regexp_extract_all("other", F.lit(r"(?s)BEGIN:VTIMEZONE\r?\n(.*?)END:VTIMEZONE"), F.lit(1))
    every = chunks.where(F.contains("other", F.lit("BEGIN:VTIMEZONE"))).select("seq", "file", F.posexplode(blocks).alias("place", "block"))
    one = every.groupBy("file", "block", "place").agg(F.min("seq").alias("seq")).withColumn("first", F.struct("seq", "place"))
    parts = F.regexp_extract_all("block", F.lit(r"(?s)BEGIN:(?:STANDARD|DAYLIGHT)\r?\n(.*?)END:(?:STANDARD|DAYLIGHT)"), F.lit(1))

    def offset(lines: Column, name: str) -> Column:
        of, value = r"^([+-])(\d{2})(\d{2})(\d{2})?$", _value(lines, name)
        n = [F.coalesce(F.regexp_extract(value, of, i).try_cast("int"), F.lit(0)) for i in (2, 3, 4)]
        return F.when(value.rlike(of), F.when(F.startswith(value, F.lit("-")), -1).otherwise(1) * (3600 * n[0] + 60 * n[1] + n[2])).cast("int")

    def observance(block: Column) -> Column:
        lines = _lines(block)
        rule, start = _value(lines, "RRULE"), _naive(_value(lines, "DTSTART"))
        day = _part(rule, "BYDAY")
        before, after = offset(lines, "TZOFFSETFROM"), offset(lines, "TZOFFSETTO")
        until = _part(rule, "UNTIL")
        until = F.when(_is_utc(until), _later(_naive(until), before)).otherwise(_naive(until))
        dates = F.flatten(F.transform(_found(lines, "RDATE"), lambda p: F.transform(F.split(p["value"], ","), _naive)))
        return F.struct(
            start.alias("start"), before.alias("before"), after.alias("after"), _part(rule, "BYMONTH").try_cast("int").alias("month"), F.coalesce(F.regexp_extract(day, r"^([+-]?\d+)?", 1).try_cast("int"), F.lit(1)).alias("nth"),
            (F.array_position(F.array(*map(F.lit, DAYS)), F.right(day, F.lit(2))) - 1).cast("int").alias("weekday"), until.alias("until"), dates.alias("dates"),
        )

    own = one.select("first", "file", text.blank_as_null(_value(_own(_lines(F.col("block"))), "TZID")).alias("tzid"), F.filter(F.transform(parts, observance), lambda o: o["start"].isNotNull() & o["after"].isNotNull()).cast(RULES).alias("rules"))
    return own.groupBy("file", "tzid").agg(F.min_by("rules", "first").alias("rules"))


def _offset(naive: Column, rules: Column) -> Column:
    """Seconds that a wall time is ahead of UTC by the rules of its zone."""

    def latest(o: Column) -> Column:
        """The observance's last begin that isn't after the time."""
        clock = F.unix_timestamp(o["start"]) - F.unix_timestamp(F.to_date(o["start"]).cast("timestamp"))
        yearly = [_later(_nth_weekday(F.year(naive) - back, o["month"], o["nth"], o["weekday"]).cast("timestamp"), clock) for back in (0, 1)]
        yearly += [F.when(o["until"].isNotNull(), _later(_nth_weekday(F.year(o["until"]) - back, o["month"], o["nth"], o["weekday"]).cast("timestamp"), clock)) for back in (0, 1)]
        good = F.filter(F.concat(F.array(o["start"], *yearly), F.coalesce(o["dates"], F.array().cast("array<timestamp>"))), lambda t: (t >= o["start"]) & (t <= naive) & (o["until"].isNull() | (t <= o["until"])))
        return F.array_max(good)

    begun = F.filter(F.transform(rules, lambda o: F.struct(latest(o).alias("at"), o["after"].alias("after"))), lambda x: x["at"].isNotNull())
    earliest = F.array_min(F.transform(rules, lambda o: F.struct(o["start"], o["before"])))["before"]
    return F.coalesce(F.array_max(begun)["after"], earliest, F.lit(0))


def instant(naive: Column, zone: Column, rules: Column) -> Column:
    """A wall time in a zone to an instant; by ``rules`` where they aren't null."""
    return F.when(rules.isNotNull(), _later(naive, -_offset(naive, rules))).otherwise(F.to_utc_timestamp(naive, zone))


# -- events ---------------------------------------------------------------------

ROW = ["seq", "uid", "summary", "dtstart", "dtend", "location", "description", "rrule", "rdate", "exdate", "recurrence_id", "sequence", "wall", "zone", "rules"]


def rows(chunks: DataFrame, tz: str = times.HOME) -> DataFrame:
    """One row for each event of read(): the columns of ROW, texts stripped and empty ones null.

    dtstart, dtend and recurrence_id are instants, wall is dtstart as its zone's
    clocks show it. Dates and zone-less times are in ``tz``, and so are times
    whose zone is neither known by name nor defined in their file. dtend is
    DTEND, else dtstart with DURATION added, days of it by the clock. exdate and
    rdate are lists of UTC times, or dates where they were dates.
    """
    one = chunks.where("whole").select("seq", "file", _own(F.col("component")).alias("own"))
    own, timed = F.col("own"), ("dtstart", "dtend", "recurrence_id")
    named = lambda n: n.upper().replace("_", "-")
    one = one.withColumns({f"v_{n}": _value(own, named(n)) for n in (*timed, "duration", "uid", "summary", "location", "description", "rrule", "sequence")})
    one = one.withColumns({f"n_{n}": _naive(F.col(f"v_{n}")) for n in timed} | {f"t_{n}": _tzid(_parameters(own, named(n))) for n in timed})
    one = one.withColumns({f"z_{n}": _known_zone(F.col(f"t_{n}")) for n in timed})
    defined = cut(zones(chunks))
    size = 200 + F.length("file") + F.length("tzid") + F.aggregate("rules", F.lit(0), lambda n, o: n + 150 + 8 * F.size(F.coalesce(o["dates"], F.array().cast("array<timestamp>"))))
    defined = small(defined, size).select(F.col("file").alias("of"), F.col("tzid").alias("named"), "rules")
    one = one.join(defined, (F.when(F.col("z_dtstart").isNull(), F.col("t_dtstart")) == F.col("named")) & (F.col("file") == F.col("of")), "left")
    utc = _is_utc(F.col("v_dtstart"))
    one = one.withColumn("zone", F.when(utc, "UTC").otherwise(F.coalesce("z_dtstart", F.lit(tz))))

    def written(naive: Column, value: Column, zone: Column) -> Column:
        return F.struct(naive.alias("naive"), _is_utc(value).alias("utc"), _is_date(value).alias("date"), zone.alias("zone"))

    def at(x: Column) -> Column:
        """A property's instant, in its own zone or, without one, the event's."""
        here = F.when(x["zone"].isNotNull(), F.to_utc_timestamp(x["naive"], x["zone"])).otherwise(instant(x["naive"], F.col("zone"), F.col("rules")))
        return F.when(x["utc"], x["naive"]).when(x["date"], F.to_utc_timestamp(x["naive"], tz)).otherwise(here)

    def listed(name: str) -> Column:
        """Comma-separated values, each with its parameters; of a period its start."""
        each = lambda p: F.transform(F.split(p["value"], ","), lambda v: F.struct(_known_zone(_tzid(p["parameters"])).alias("zone"), F.substring_index(text.strip(v), "/", 1).alias("value")))
        return F.flatten(F.transform(_found(own, name), each))

    days, seconds = _seconds(F.col("v_duration"))
    given = F.col("v_duration") != ""
    one = one.withColumns({"rdates": listed("RDATE"), "exdates": listed("EXDATE"), "seconds": F.when(given, seconds), "n_after": F.when(given, _later(F.col("n_dtstart"), days * 86400))})
    after = F.struct(F.col("n_after").alias("naive"), utc.alias("utc"), F.lit(False).alias("date"), F.col("z_dtstart").alias("zone"))
    single = [written(*[F.col(f"{k}_{n}") for k in "nvz"]) for n in timed]
    many = F.transform(F.concat("rdates", "exdates"), lambda x: written(_naive(x["value"]), x["value"], x["zone"]))
    listing = F.size("rdates") + F.size("exdates") > 0
    every = one.withColumn("times", F.when(listing, F.concat(F.array(*single, after), many)).otherwise(F.array(*single, after))).withColumn("at", F.transform("times", at))

    def stamps(column: str, since: Column) -> Column:
        """Values as UTC times, dates as they are."""
        return F.transform(column, lambda p, n: F.when(_is_date(p["value"]), p["value"]).otherwise(F.date_format(F.get("at", since + n), "yyyyMMdd'T'HHmmss'Z'")))

    return every.select(
        "seq", _text(F.col("v_uid")).alias("uid"), _text(F.col("v_summary")).alias("summary"), F.get("at", F.lit(0)).alias("dtstart"),
        F.coalesce(F.get("at", F.lit(1)), _later(F.get("at", F.lit(3)), F.col("seconds"))).alias("dtend"), _text(F.col("v_location")).alias("location"), _text(F.col("v_description")).alias("description"),
        text.blank_as_null(F.col("v_rrule")).alias("rrule"), stamps("rdates", F.lit(4)).alias("rdate"), stamps("exdates", F.size("rdates") + 4).alias("exdate"),
        F.get("at", F.lit(2)).alias("recurrence_id"), F.coalesce(F.when(F.col("v_sequence") != "", F.col("v_sequence").try_cast("int")), F.lit(0)).alias("sequence"),
        F.col("n_dtstart").alias("wall"), "zone", "rules",
    )


# -- recurrence -------------------------------------------------------------------


def _part(rule: Column, name: str) -> Column:
    return text.blank_as_null(F.regexp_extract(F.upper(F.coalesce(rule, F.lit(""))), rf"(?:^|;){name}=([^;]*)", 1))


def _numbers(rule: Column, name: str) -> Column:
    """A part's numbers; null without the part."""
    return F.transform(F.split(_part(rule, name), ","), lambda x: x.try_cast("int"))


def known(rule: Column) -> Column:
    """Whether expand() knows the rule: any of PARTS, with a frequency of a day or more."""
    names = F.transform(F.split(F.upper(rule), ";"), lambda p: F.substring_index(p, "=", 1))
    day = r"([+-]?\d{1,2})?(MO|TU|WE|TH|FR|SA|SU)"
    days = F.coalesce(_part(rule, "BYDAY").rlike(rf"^{day}(,{day})*$"), F.lit(True))
    numbers = F.coalesce(F.forall(F.flatten(F.array(*[F.coalesce(_numbers(rule, n), F.array().cast("array<int>")) for n in PARTS if n.startswith("BY") and n != "BYDAY"])), lambda x: x.isNotNull()), F.lit(False))
    return (F.size(F.array_except(names, F.array(*map(F.lit, (*PARTS, ""))))) == 0) & F.coalesce(_part(rule, "FREQ").isin(*FREQUENCIES), F.lit(False)) & days & numbers


def unknown_rules(events: DataFrame) -> DataFrame:
    """The rows whose rule expand() doesn't know: it gives their first occurrence, and their dates of RDATE."""
    return events.where(F.col("rrule").isNotNull() & ~known(F.col("rrule")))


def _week_number(d: Column, first: Column) -> tuple[Column, Column, Column]:
    """Year, number and number from the year's end (below zero) of the week of a date, whose weeks begin at a weekday and belong to the year that has most of them."""
    middle = lambda x: F.date_add(F.date_sub(x, F.pmod(F.weekday(x) - first, F.lit(7))), 3)
    m = middle(d)
    number = F.floor((F.dayofyear(m) - 1) / 7) + 1
    last = F.floor((F.dayofyear(middle(F.make_date(F.year(m), F.lit(12), F.lit(28)))) - 1) / 7) + 1
    return F.year(m), number.cast("int"), (number - last - 1).cast("int")


def _days(freq: Column, start: Column) -> Column:
    """All dates of the period that begins at ``start``; of a year also the days around it that its weeks may have."""
    end = F.when(freq == "DAILY", start).when(freq == "WEEKLY", F.date_add(start, 6)).when(freq == "MONTHLY", F.last_day(start)).otherwise(F.date_add(F.make_date(F.year(start), F.lit(12), F.lit(31)), 3))
    return F.sequence(F.when(freq == "YEARLY", F.date_sub(start, 3)).otherwise(start), end)


def _fits(d: Column, start: Column) -> Column:
    """Whether the rule of a row takes a date of the period."""
    c = F.col
    freq, first = c("freq"), c("d0")
    has = lambda name, x: F.coalesce(F.array_contains(c(name), x), F.lit(False))
    left_of_month = F.dayofmonth(d) - F.dayofmonth(F.last_day(d)) - 1
    left_of_year = F.dayofyear(d) - F.dayofyear(F.make_date(F.year(d), F.lit(12), F.lit(31))) - 1
    year, week, week_back = _week_number(d, c("wkst"))
    in_period = F.when((freq == "YEARLY") & c("byweekno").isNotNull(), year == F.year(start)).when(freq == "YEARLY", F.year(d) == F.year(start)).otherwise(F.lit(True))
    month = c("bymonth").isNull() | has("bymonth", F.month(d))
    monthday = c("bymonthday").isNull() | has("bymonthday", F.dayofmonth(d)) | has("bymonthday", left_of_month)
    yearday = c("byyearday").isNull() | has("byyearday", F.dayofyear(d)) | has("byyearday", left_of_year)
    weekno = c("byweekno").isNull() | (freq != "YEARLY") | has("byweekno", week) | has("byweekno", week_back)
    # the nth of a weekday in its month, or in its year where no months are named
    in_year = (freq == "YEARLY") & c("bymonth").isNull()
    nth = F.when(in_year, F.ceil(F.dayofyear(d) / 7.0)).otherwise(F.ceil(F.dayofmonth(d) / 7.0))
    nth_back = F.when(in_year, F.floor(left_of_year / 7.0)).otherwise(F.floor(left_of_month / 7.0))
    plain = freq.isin("DAILY", "WEEKLY") | c("byweekno").isNotNull()
    weekday = c("byday").isNull() | F.exists("byday", lambda e: (e["weekday"] == F.weekday(d)) & (plain | e["nth"].isNull() | (e["nth"] == nth) | (e["nth"] == nth_back)))
    # without a part that names days, they are those of the first occurrence
    none = lambda *names: F.forall(F.array(*[c(n).isNull() for n in names]), lambda x: x)
    same_day = F.dayofmonth(d) == F.dayofmonth(first)
    default = (
        F.when((freq == "WEEKLY") & none("byday"), F.weekday(d) == F.weekday(first))
        .when((freq == "MONTHLY") & none("byday", "bymonthday"), same_day)
        .when((freq == "YEARLY") & none("byday", "bymonthday", "byyearday") & c("byweekno").isNotNull(), F.weekday(d) == F.weekday(first))
        .when((freq == "YEARLY") & none("byday", "bymonthday", "byyearday", "bymonth"), same_day & (F.month(d) == F.month(first)))
        .when((freq == "YEARLY") & none("byday", "bymonthday", "byyearday"), same_day)
        .otherwise(F.lit(True))
    )
    return in_period & month & monthday & yearday & weekno & weekday & default


def _parsed(events: DataFrame, here: Callable[[Column], Column]) -> DataFrame:
    """Events with the parts of their rules, their first day and the clock times of an occurrence."""
    events = events.withColumn("rule", F.when(known(F.col("rrule")), F.col("rrule")))
    rule = F.col("rule")
    of = r"^([+-]?\d+)?([A-Z]{2})$"
    codes = F.array(*map(F.lit, DAYS))
    byday = F.transform(F.split(_part(rule, "BYDAY"), ","), lambda e: F.struct(F.regexp_extract(e, of, 1).try_cast("int").alias("nth"), (F.array_position(codes, F.right(e, F.lit(2))) - 1).cast("int").alias("weekday")))
    until = _part(rule, "UNTIL")
    clock = {"byhour": F.hour("wall"), "byminute": F.minute("wall"), "bysecond": F.second("wall")}
    times_of = [F.coalesce(_numbers(rule, n.upper()), F.array(c)) for n, c in clock.items()]
    product = F.flatten(F.transform(times_of[0], lambda h: F.flatten(F.transform(times_of[1], lambda m: F.transform(times_of[2], lambda s: h * 3600 + m * 60 + s)))))
    return events.withColumns(
        {"freq": _part(rule, "FREQ"), "step": F.greatest(F.coalesce(_part(rule, "INTERVAL").try_cast("int"), F.lit(1)), F.lit(1)), "n": _part(rule, "COUNT").try_cast("int"), "byday": byday, "wkst": F.coalesce((F.array_position(codes, _part(rule, "WKST")) - 1).cast("int"), F.lit(0))}
        | {n.lower(): _numbers(rule, n) for n in ("BYMONTH", "BYMONTHDAY", "BYYEARDAY", "BYWEEKNO", "BYSETPOS")}
        | {"clocks": F.array_sort(F.array_distinct(product)), "d0": F.to_date("wall"), "until_at": F.when(~_is_date(until), F.when(_is_utc(until), _naive(until)).otherwise(here(_naive(until)))), "until_day": F.when(_is_date(until), F.to_date(_naive(until)))}
    )


def _last_counted(events: DataFrame) -> DataFrame:
    """Plain counted rules by days and weeks get the day of their last occurrence instead of the count."""
    plain = F.forall(F.array(*[F.col(c).isNull() for c in ("bymonth", "bymonthday", "byyearday", "byweekno", "bysetpos")]), lambda x: x) & (F.size("clocks") == 1) & (F.element_at("clocks", 1) == _clock(F.col("wall")))
    daily = F.date_add("d0", F.col("step") * (F.col("n") - 1))
    own = F.coalesce(F.array_sort(F.array_distinct(F.transform("byday", lambda e: F.pmod(e["weekday"] - F.col("wkst"), F.lit(7))))), F.array(F.pmod(F.weekday("d0") - F.col("wkst"), F.lit(7))))
    week0 = F.date_sub("d0", F.pmod(F.weekday("d0") - F.col("wkst"), F.lit(7)))
    begun = F.size(F.filter(own, lambda x: x < F.datediff("d0", week0)))  # of the first week, before the first day
    k = F.col("n") - 1 + begun
    weekly = F.date_add(week0, (F.floor(k / F.size(own)) * 7 * F.col("step")).cast("int") + F.get(own, (k % F.size(own)).cast("int")))
    counted = F.col("n").isNotNull() & (F.col("n") > 0) & plain
    last = F.when(counted & (F.col("freq") == "DAILY") & F.col("byday").isNull(), daily).when(counted & (F.col("freq") == "WEEKLY"), weekly)
    return events.withColumn("last", last).withColumns({"until_day": F.when(F.col("last").isNull(), F.col("until_day")).otherwise(F.least("last", F.coalesce("until_day", "last"))), "n": F.when(F.col("last").isNull(), F.col("n"))}).drop("last")


def _clock(naive: Column) -> Column:
    return (F.unix_timestamp(naive) - F.unix_timestamp(F.to_date(naive).cast("timestamp"))).cast("int")


def _walls(events: DataFrame, lo: Column, hi: Column) -> DataFrame:
    """Adds ``walls``: in order, the wall times that a parsed event's rule gives in the periods that can meet [lo, hi)."""
    freq, step, d0 = F.col("freq"), F.col("step"), F.col("d0")
    back = (F.ceil(F.greatest(F.col("length"), F.lit(0)) / 86400) + 2).cast("int")
    beyond = F.date_add(hi, 2)
    since, to = F.greatest(d0, F.date_sub(lo, back)), F.least(beyond, F.coalesce(F.date_add("until_day", 1), beyond), F.coalesce(F.date_add(F.to_date("until_at"), 2), beyond))
    week = lambda d: F.date_sub(d, F.pmod(F.weekday(d) - F.col("wkst"), F.lit(7)))
    index = lambda d: F.when(freq == "DAILY", F.datediff(d, d0)).when(freq == "WEEKLY", F.datediff(week(d), week(d0)) / 7).when(freq == "MONTHLY", (F.year(d) - F.year(d0)) * 12 + F.month(d) - F.month(d0)).otherwise(F.year(d) - F.year(d0))
    beside = F.when(F.col("byweekno").isNotNull(), 1).otherwise(0)  # weeks of a year reach into its neighbours
    first = F.when(F.col("n").isNotNull(), 0).otherwise(F.greatest(F.floor(index(since) / step) - beside, F.lit(0))).cast("int")
    last = F.floor((index(to) + beside) / step).cast("int")
    events = events.withColumns({"first": first, "last": last})
    some = F.col("freq").isNotNull() & (F.col("first") <= F.col("last")) & (F.coalesce("n", F.lit(1)) > 0)

    def start(period: Column) -> Column:
        ahead = period * step
        return F.when(freq == "DAILY", F.date_add(d0, ahead)).when(freq == "WEEKLY", F.date_add(week(d0), ahead * 7)).when(freq == "MONTHLY", F.add_months(F.trunc(d0, "month"), ahead)).otherwise(F.make_date(F.year(d0) + ahead, F.lit(1), F.lit(1)))

    def picked(every: Column) -> Column:
        at = F.transform("bysetpos", lambda p: F.get(every, F.when(p > 0, p - 1).otherwise(F.size(every) + p)))
        return F.when(F.col("bysetpos").isNull(), every).otherwise(F.array_sort(F.array_distinct(F.filter(at, lambda x: x.isNotNull()))))

    def given(begin: Column) -> Column:
        days = F.filter(_days(freq, begin), lambda d: _fits(d, begin))
        every = F.flatten(F.transform(days, lambda d: F.transform("clocks", lambda s: _later(d.cast("timestamp"), s))))
        return F.flatten(F.transform(F.array(every), picked))

    begins = F.transform(F.sequence("first", "last"), start)
    walls = F.filter(F.flatten(F.transform(begins, given)), lambda at: at >= F.col("wall"))
    events = events.withColumn("walls", F.when(some, walls).otherwise(F.array().cast("array<timestamp>")))
    return events.withColumn("walls", F.when(F.col("n") > 0, F.slice("walls", F.lit(1), F.col("n"))).otherwise(F.col("walls")))


def expand(events: DataFrame, start: str, end: str, tz: str = times.HOME) -> DataFrame:
    """(seq, summary, start_at, end_at, location, description) of occurrences that overlap [start 00:00, end 00:00) in ``tz``.

    events: rows(), or any table with seq, summary, dtstart, dtend, location,
    description, rrule and exdate; without the columns of its zone an event is
    in ``tz``. An event's set is what its rule gives from dtstart on (dtstart
    alone without a rule, or with one that isn't known), and its dates of RDATE,
    each instant once, less EXDATE (times by instant, dates by local date). An
    event with a recurrence_id takes the place of that instant of its uid's set,
    of several the one with the highest sequence. Clock times stay as they are
    when clocks change; an occurrence is as long as the first one. UNTIL is an
    instant if it has a time, else the last local date.

    Sets are made in arrays of the event's row, without a shuffle; only events
    that take another's place meet by uid and instant.
    """
    ruled = "rules" in events.columns
    none = {"uid": "string", "rdate": "array<string>", "recurrence_id": "timestamp", "sequence": "int", "rules": RULES}
    events = events.withColumns({c: F.lit(None).cast(kind) for c, kind in none.items() if c not in events.columns})
    if "zone" not in events.columns:
        events = events.withColumns({"zone": F.lit(tz), "wall": times.local(F.col("dtstart"), tz)})
    lo, hi = F.lit(start).cast("date"), F.lit(end).cast("date")
    length = F.coalesce(F.unix_timestamp("dtend") - F.unix_timestamp("dtstart"), F.lit(0))
    events = events.where("dtstart is not null")
    here = lambda naive: instant(naive, F.col("zone"), F.col("rules")) if ruled else F.to_utc_timestamp(naive, F.col("zone"))
    own = _walls(_last_counted(_parsed(events.withColumn("length", length), here)), lo, hi)
    place = lambda at, d: F.struct(at.alias("at"), d.alias("day"))
    by_rule = F.transform("walls", lambda w: place(here(w), F.to_date(w)))
    by_rule = F.filter(by_rule, lambda o: (F.col("until_at").isNull() | (o["at"] <= F.col("until_at"))) & (F.col("until_day").isNull() | (o["day"] <= F.col("until_day"))))
    by_rule = F.when(F.col("freq").isNull(), F.array(place(F.col("dtstart"), F.to_date("wall")))).otherwise(by_rule)
    # a date of RDATE has the clock time of the first occurrence
    on_day = lambda v: place(here(_later(F.to_date(_naive(v)).cast("timestamp"), _clock(F.col("wall")))), F.to_date(_naive(v)))
    dates = F.transform(F.coalesce("rdate", F.array().cast("array<string>")), lambda v: F.when(_is_date(v), on_day(v)).otherwise(place(_naive(v), times.local_date(_naive(v), tz))))
    own = own.withColumn("many", F.array_sort(F.concat(by_rule, F.filter(dates, lambda o: o["at"].isNotNull()))))
    new = F.filter("many", lambda o, n: (n == 0) | (o["at"] != F.get("many", n - 1)["at"]))

    def skipped(o: Column) -> Column:
        return F.coalesce(F.exists("exdate", lambda x: F.when(_is_date(x), F.to_date(_naive(x)) == o["day"]).when(_is_utc(x), _naive(x) == o["at"]).otherwise(here(_naive(x)) == o["at"])), F.lit(False))

    lasting = F.greatest(F.col("length"), F.lit(0))
    meets = lambda o: (o["at"] < times.local_midnight(hi, tz)) & (_later(o["at"], lasting) >= times.local_midnight(lo, tz))
    out = own.withColumn("o", F.explode(F.filter(new, lambda o: meets(o) & ~skipped(o))))
    out = out.select("seq", "uid", "summary", F.col("o.at").alias("start_at"), F.when(F.col("dtend").isNotNull(), _later(F.col("o.at"), F.col("length"))).alias("end_at"), "location", "description", F.coalesce("recurrence_id", "o.at").alias("instant"), F.col("recurrence_id").isNotNull().alias("instead"))
    moved = events.where("uid is not null and recurrence_id is not null").groupBy(F.col("uid").alias("of"), F.col("recurrence_id").alias("taken")).agg(F.max_by("seq", F.struct("sequence", "seq")).alias("by"))
    out = out.join(moved, (F.col("uid") == F.col("of")) & (F.col("instant") == F.col("taken")), "left")
    kept = F.when(F.col("instead"), F.col("by").isNull() | (F.col("by") == F.col("seq"))).otherwise(F.col("by").isNull())
    return out.where(kept).select("seq", "summary", "start_at", "end_at", "location", "description")
