"""Column-to-column functions: text, dates, numbers (all JVM expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thai digits in order.
THAI_DIGITS = "๐๑๒๓๔๕๖๗๘๙"
NUMBER_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"


def arabic_digits(c: Column) -> Column:
    return F.translate(c, THAI_DIGITS, "0123456789")


def is_thai(c: Column) -> Column:
    return c.rlike("[\\u0E00-\\u0E7F]")


def number(c: Column) -> Column:
    """The number at the start of a text; 0 where there is none."""
    return F.coalesce(F.regexp_extract(c, NUMBER_PREFIX, 1).try_cast("double"), F.lit(0.0))


def number_or_null(c: Column) -> Column:
    return F.regexp_extract(c, NUMBER_PREFIX, 1).try_cast("double")


def money(c: Column, decimals: int = 2) -> Column:
    return F.when(c == 0, "-").otherwise(F.format_number(c, decimals))


def half_up(c: Column, scale: int = 1) -> Column:
    """Half goes up on the binary double, unlike round()."""
    return F.floor(c * scale + 0.5) / scale


def common_era(year: Column) -> Column:
    return F.when(year > 2400, year - 543).otherwise(year)


def strict_date(c: Column) -> Column:
    """YYYY-MM-DD, a real day from 2000 to 2100, else null."""
    day = F.try_to_date(c, "yyyy-MM-dd")
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.year(day).between(2000, 2100), day)


def years_back(day: Column, years: Column | int) -> Column:
    """The same day some years before; 29 February becomes 1 March."""
    first = F.make_date(F.year(day) - years, F.month(day), F.lit(1))
    return F.date_add(first, F.dayofmonth(day) - 1)


def bangkok_day(ts: Column) -> Column:
    return F.from_utc_timestamp(ts, "Asia/Bangkok").cast("date")


def split_day(c: Column) -> Column:
    """struct(day, month, year) of an ISO date or of d/m/y."""
    iso, own = c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}"), c.rlike(r"^\d{1,2}/\d{1,2}/\d{4}")
    part = lambda p, k: F.regexp_extract(c, p, k).try_cast("int")
    a, b = r"^(\d{4})-(\d{1,2})-(\d{1,2})", r"^(\d{1,2})/(\d{1,2})/(\d{4})"
    return F.struct(*[F.when(iso, part(a, i)).when(own, part(b, j)).alias(n) for n, i, j in (("day", 3, 1), ("month", 2, 2), ("year", 1, 3))])


def title_key(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def slug(c: Column, most: int = 60) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most)


def item_path(c: Column) -> Column:
    """'5.3.1' to [5, 3, 1]: compares number by number."""
    return F.transform(F.split(F.regexp_replace(F.trim(c), r"\.+$", ""), r"\."), lambda x: x.try_cast("int"))


def is_inside(path: Column, major: Column) -> Column:
    return F.slice(path, F.lit(1), F.size(major)) == major


def version_key(c: Column, parts: int = 3) -> Column:
    """'v0.5.0' to numbers, padded with zeros."""
    nums = F.transform(F.split(F.regexp_replace(c, "^[vV]", ""), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    return F.slice(F.concat(nums, F.array_repeat(F.lit(0), parts)), 1, parts)


def named_in(text: Column, name: str) -> Column:
    """A Thai name anywhere in the text; a Latin one as a whole word, in any case."""
    if any("฀" <= ch <= "๿" for ch in name):
        return F.contains(text, F.lit(name))
    quoted = "".join(("\\" + ch if not ch.isalnum() and not ch.isspace() else ch) for ch in name.lower())
    return F.lower(text).rlike(f"(?<![a-z0-9]){quoted}(?![a-z0-9])")


def page_list(c: Column, most: int, span: int, ordered: bool) -> Column:
    """Pages of 'page 3, 6, 12-13': ranges of at most `span` steps, numbers from 1 to `most`."""
    found = F.regexp_extract_all(arabic_digits(c), F.lit(r"(\d+(?:\s*[-–]\s*\d+)?)"), 1)
    ends = F.transform(found, lambda x: F.transform(F.split(x, r"\s*[-–]\s*"), lambda n: n.try_cast("int")))
    low, high = lambda e: F.get(e, 0), lambda e: F.coalesce(F.get(e, 1), F.get(e, 0))
    fit = F.filter(ends, lambda e: (low(e) >= 1) & (high(e) <= most) & (high(e) >= low(e)) & (high(e) - low(e) <= span))
    pages = F.array_distinct(F.flatten(F.transform(fit, lambda e: F.sequence(low(e), high(e)))))
    return F.array_sort(pages) if ordered else pages


def value_tokens(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct numbers of two characters or more and Latin words of four letters or more, without stop words."""
    text = F.lower(arabic_digits(c))
    numbers = F.regexp_extract_all(text, F.lit(r"(\d[\d.,]*\d)"), 1)
    words = F.regexp_extract_all(text, F.lit(r"([a-z]{4,})"), 1)
    return F.array_except(F.array_union(numbers, words), F.array(*map(F.lit, stop)).cast("array<string>"))


def fare(km: Column, minutes: Column, tiers: list[tuple[float, float | None, float]], flag: float, per_minute: float, extra: Column | None = None) -> Column:
    """Flag fall, a price a kilometre by tiers (from, to, price), a price a minute, and surcharges, rounded half up to cents."""
    total = F.lit(flag) + minutes * per_minute
    for low, high, price in tiers:
        reach = km if high is None else F.least(km, F.lit(high))
        total = total + F.greatest(F.lit(0.0), reach - low) * price
    return half_up(total + extra if extra is not None else total, 100)
