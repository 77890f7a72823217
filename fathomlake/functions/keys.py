"""Search keys: what a column is, and its normal form.

Every normal form is a column expression; only IP addresses need Python.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import BinaryType, DateType, NumericType, StringType, StructField, StructType, TimestampNTZType, TimestampType

from .countries import COUNTRIES, PHONES

_LABEL = r"[^\W_](?:(?:[^\W_]|-){0,61}[^\W_])?"
#: Of ASCII characters; in Python it needs re.ASCII.
EMAIL = rf"^[\w.!#$%&'*+/=?^`{{|}}~-]+@{_LABEL}(?:\.{_LABEL})*$"


def email_hash(c: Column) -> Column:
    """The SHA-256 of the lower-cased address; null for what is no address."""
    return F.when(c.rlike(EMAIL), F.sha2(F.lower(c), 256))


def email_domain(c: Column) -> Column:
    """What follows the @, if there is exactly one."""
    parts = F.split(c, "@")
    return F.when(F.size(parts) == 2, F.get(parts, F.lit(1)))


def email_one_domain(c: Column) -> Column:
    """The first letter and the domain."""
    parts = F.split(c, "@")
    return F.when((F.size(parts) == 2) & (F.length(F.get(parts, F.lit(0))) > 0), F.concat(F.substring(c, 1, 1), F.lit("@"), F.get(parts, F.lit(1))))


def phone(c: Column) -> Column:
    """The digits as a number from 10^7 to below 10^15, else null."""
    digits = F.regexp_replace(F.regexp_replace(c.cast("string"), r"\.0$", ""), r"[^0-9]", "")
    n = digits.try_cast("bigint")
    return F.when((n >= 10**7) & (n < 10**15), n)


def phone_with_prefix(c: Column, country: Column) -> Column:
    """A normalised phone with its country's calling code, if it has just the digits of a national number there."""
    table = F.create_map(*[F.lit(x) for k, (code, n) in PHONES.items() for x in (k, f"{code}/{n}")])
    parts = F.split(F.try_element_at(table, country), "/")
    code, n = F.get(parts, F.lit(0)), F.get(parts, F.lit(1)).cast("int")
    return F.when(F.length(c.cast("string")) == n, F.concat(code, c.cast("string")).cast("bigint")).otherwise(c)


def country(c: Column) -> Column:
    """The ISO code of a code or a name: capitals, letters only, UK as GB."""
    table = F.create_map(*[F.lit(x) for item in COUNTRIES.items() for x in item])
    named = F.coalesce(F.try_element_at(table, F.upper(F.trim(c))), c)
    letters = F.regexp_replace(F.upper(named), "[^A-Z]", "")
    return F.when(letters == "UK", F.lit("GB")).otherwise(letters)


def postal_code(c: Column) -> Column:
    """Capitals and digits only, without leading zeros; a decimal ``.0`` goes."""
    text = F.regexp_replace(c.cast("string"), r"^\s*(\d+)\.0+\s*$", "$1")
    return F.regexp_replace(F.regexp_replace(F.upper(text), "[^A-Z0-9]", ""), r"^0+\B", "")


_IP = StructType([StructField("binary", BinaryType()), StructField("prefix", StringType())])


def parse_ip(value: object) -> tuple[bytes | None, str | None]:
    """The packed bytes and the first two groups; a mapped IPv6 address counts as IPv4."""
    try:
        text = str(value).strip()
        address = ipaddress.ip_address(int(text) if text.isdigit() else text)
    except ValueError:
        return None, None
    mapped = getattr(address, "ipv4_mapped", None)
    address = mapped or address
    sign = "." if address.version == 4 else ":"
    return address.packed, sign.join(address.exploded.split(sign)[:2])


@pandas_udf(_IP)
def ip(values: pd.Series) -> pd.DataFrame:
    """A struct of ``parse_ip``, null inside for what is no address."""
    found = [(None, None) if v is None else parse_ip(v) for v in values]
    return pd.DataFrame(found, columns=["binary", "prefix"])


def epoch(c: Column, largest: float) -> Column:
    """A timestamp of numbers whose unit shows in the largest: seconds, milli-, micro- or nanoseconds."""
    for bound, scale in ((1e11, 1e6), (1e14, 1e3), (1e16, 1.0)):
        if largest < bound:
            return F.timestamp_micros((c.cast("double") * F.lit(scale)).cast("long"))
    return F.timestamp_micros((c.cast("double") / F.lit(1e3)).cast("long"))


#: Formats tried on a whole column, in this order.
FORMATS = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd.MM.yyyy", "yyyy/MM/dd", "MM/dd/yyyy", "dd/MM/yyyy", "yyyyMMdd", "dd-MM-yyyy", "yyyy-MM", "MM.yyyy", "yyyy"]


def parse_dates(df: DataFrame, name: str, date_format: str | None = None) -> Column:
    """A date column as timestamps: by its type, by the first format that reads all of it, or by guessing.

    Texts with fewer than six digits are null. Looks at the column once.
    """
    kind, c = df.schema[name].dataType, F.col(name)
    if isinstance(kind, (TimestampType, TimestampNTZType, DateType)):
        return c.cast("timestamp")
    if isinstance(kind, NumericType):
        largest = df.agg(F.max(F.abs(c))).first()[0]
        return epoch(c, float(largest or 0))
    text = F.when(F.length(F.regexp_replace(c, r"\D", "")) >= 6, F.trim(c))
    if date_format:
        return F.try_to_timestamp(text, F.lit(date_format))
    tried = [F.try_to_timestamp(text, F.lit(f)) for f in FORMATS]
    reads = df.agg(F.count(text).alias("all"), *[F.count(t).alias(f"f{i}") for i, t in enumerate(tried)]).first()
    for i, t in enumerate(tried):
        if reads[f"f{i}"] == reads["all"]:
            return t
    return F.coalesce(F.try_to_timestamp(text), *tried)


def date_key(t: Column) -> Column:
    """Milliseconds of the day's start; null up to 1999."""
    return F.when(t > F.lit("1999-12-31").cast("timestamp"), F.unix_millis(F.date_trunc("DAY", t)))


def cyclical(t: Column) -> dict[str, Column]:
    """Sine and cosine of the day in its quarter and of the time of day."""
    quarter = F.date_trunc("QUARTER", t)
    length = F.datediff(F.add_months(quarter.cast("date"), 3), quarter.cast("date"))
    angles = {
        "day_in_quarter": F.datediff(t, quarter) / length, "second_60": F.second(t) / 60.0, "minute_60": F.minute(t) / 60.0,
        "minute_30": (F.minute(t) % 30) / 30.0, "hour_24": F.hour(t) / 24.0,
    }
    turn = F.lit(6.283185307179586)
    return {f"{k}_{n}": f(turn * a) for k, a in angles.items() for n, f in (("sin", F.sin), ("cos", F.cos))}


#: How many rows detection looks at.
DETECTION_ROWS = 100


def detect(df: DataFrame, known: Sequence[str] = ()) -> dict[str, str]:
    """What columns look like: date, postal_code, country, email, phone; each kind at most once.

    A column that fits by name and by values comes before one that fits by
    values, and that before one that fits by name.
    """
    head = df.limit(DETECTION_ROWS).toPandas()
    found: dict[str, str] = {}
    for kind in ("date", "postal_code", "country", "email", "phone"):
        free = [c for c in df.columns if c not in found and c not in known]
        fits = [(_by_name(kind, c), _by_value(kind, head[c]), c) for c in free]
        for want in ((True, True), (False, True), (True, False)):
            if kind in ("date", "postal_code", "country") and want != (True, True):
                break
            hit = next((c for n, v, c in fits if (n, bool(v)) == want), None)
            if hit is not None:
                found[hit] = kind
                break
    return found


def _by_name(kind: str, name: str) -> bool:
    name = name.lower()
    words = {"date": ("date", "time", "timestamp"), "postal_code": ("zip", "postal"), "country": ("country",), "phone": ("phone", "msisdn")}
    return name in ("email", "e_mail", "e-mail") if kind == "email" else any(w in name for w in words[kind])


def _by_value(kind: str, values: pd.Series) -> bool:
    texts = values.dropna().astype(str)
    if not len(texts):
        return False
    if kind == "date":
        return bool(pd.to_datetime(texts, errors="coerce", format="mixed").notna().mean() >= 0.5)
    if kind == "postal_code":
        return bool(texts.map(lambda t: re.fullmatch(r"[^\W_][\w .-]{2,9}", t.strip()) is not None).all())
    if kind == "country":
        return bool(texts.str.upper().isin({*COUNTRIES, *COUNTRIES.values()}).sum() > 0.1 * len(values))
    if kind == "email":
        return bool(texts.str.contains("@").any() and texts.str.match(EMAIL, flags=re.ASCII).sum() > 0.1 * len(values))
    return False


_SEVERAL = {"phone", "ip", "postal_code", "email", "hem", "custom_key"}


def validate_keys(keys: dict[str, str]) -> None:
    """Raise ValueError for keys that do not go together."""
    kinds = list(keys.values())
    twice = {k for k in kinds if kinds.count(k) > 1} - _SEVERAL
    if twice:
        raise ValueError(f"More than one column for {sorted(twice)}")
    for a, b in (("date", "datetime"), ("email", "hem")):
        if a in kinds and b in kinds:
            raise ValueError(f"Both {a} and {b} are given")
    if "postal_code" in kinds and "country" not in kinds:
        raise ValueError("A postal code needs a country")


def needs_current_date(keys: dict[str, str]) -> bool:
    """Whether keys without time need today's date as a further key."""
    return set(keys.values()) <= {"phone", "email", "hem", "custom_key", "country", "postal_code"}


def key_combinations(keys: Sequence[str]) -> list[tuple[str, ...]]:
    """All subsets of keys but the empty one, the most specific first."""
    out = [tuple(k for j, k in enumerate(keys) if i >> j & 1) for i in range(1, 1 << len(keys))]
    return sorted(out, key=lambda s: (-len(s), [list(keys).index(k) for k in s]))
