"""Codes, periods, numbers and other small scalar columns."""
from pyspark.sql import Column, functions as F


def _c(c):
    return F.col(c) if isinstance(c, str) else c


def pad_code(c) -> Column:
    """Zero-padded to six, longer codes untouched."""
    c = _c(c).cast("string")
    return F.when(F.char_length(c) < 6, F.lpad(c, 6, "0")).otherwise(c)


def strip_code_prefix(c) -> Column:
    return pad_code(F.trim(F.regexp_replace(_c(c).cast("string"), "^[A-Za-z]+", "")))


def exchange_code(c) -> Column:
    code = pad_code(c)
    return F.when(code.rlike("^(60|68|9)"), F.concat(F.lit("sh"), code)).otherwise(F.concat(F.lit("sz"), code))


def normalize_period(c) -> Column:
    """Eight digits, ISO dates and quarters to YYYY-MM-DD; anything else unchanged."""
    s = F.trim(_c(c).cast("string"))
    quarter = F.regexp_extract(F.upper(s), r"^.{4}[^Q]*Q0*([1-4])$", 1)
    month_end = F.when(quarter == "1", "03-31").when(quarter == "2", "06-30").when(
        quarter == "3", "09-30").when(quarter == "4", "12-31")
    return (F.when(s.rlike(r"^\d{8}$"), F.regexp_replace(s, r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"))
            .when(s.rlike("^.{4}-.{2}-"), F.substring(s, 1, 10))
            .when(month_end.isNotNull(), F.concat(F.substring(s, 1, 4), F.lit("-"), month_end))
            .otherwise(s))


def safe_double(c) -> Column:
    v = _c(c).try_cast("double")
    return F.when(~F.isnan(v), v)


def safe_int(c) -> Column:
    return safe_double(c).try_cast("int")


def day_text(c) -> Column:
    return F.substring(_c(c).cast("string"), 1, 10)


def valid_at(valid_from, valid_to, as_of) -> Column:
    """Row is in force on as_of; unknown bounds pass; text comparison. A null as_of accepts everything."""
    if as_of is None:
        return F.lit(True)
    as_of = F.lit(as_of)
    ok = F.lit(True)
    if valid_from is not None:
        ok = ok & (F.coalesce(_c(valid_from), F.lit("")) <= as_of)
    if valid_to is not None:
        end = F.coalesce(_c(valid_to), F.lit(""))
        ok = ok & ((end == "") | (end >= as_of))
    return ok


def confidence_rank(c) -> Column:
    c = _c(c)
    return F.when(c == "high", 3).when(c == "medium", 2).when(c == "low", 1).otherwise(0)
