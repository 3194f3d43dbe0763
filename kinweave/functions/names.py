"""Names as keys: normalising, typing and matching, as column expressions that stay in the JVM."""
import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from kinweave import settings as S


@lru_cache(maxsize=2)
def _compat_maps(one_dash=True):
    """Characters with another compatibility form, by rule: signs and forms for a translation, those with forms of several signs as a
    regex class and as a map spelled out in one text."""
    plain, mapped, expanding = [], [], {}
    for point in range(0x80, 0x10000):
        if 0xD800 <= point < 0xE000:
            continue
        char = chr(point)
        form = unicodedata.normalize("NFKC", char)
        if one_dash:
            form = "".join("-" if _is_dash(x) else x for x in form)
            form = "-" if _is_dash(char) else form
        if form == char:
            continue
        if len(form) == 1:
            plain.append(char)
            mapped.append(form)
        else:
            expanding[char] = form
    return "".join(plain), "".join(mapped), "[" + _ranges(expanding) + "]", "\x01".join(k + "\x02" + v for k, v in expanding.items())


@lru_cache(maxsize=1)
def _joining():
    """Regex class of what may melt into the sign before it: marks, second parts of composed signs, signs whose forms hold such, and all
    signs beyond the basic plane."""
    seconds = {chr(int(parts[1], 16)) for parts in (unicodedata.decomposition(chr(p)).split() for p in range(0x80, 0x30000))
               if len(parts) == 2 and not parts[0].startswith("<")}
    seconds |= {chr(p) for p in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}
    found = [chr(p) for p in range(0x80, 0x10000) if not 0xD800 <= p < 0xE000
             and any(x in seconds or unicodedata.combining(x) for x in chr(p) + unicodedata.normalize("NFKC", chr(p)))]
    return "[" + _ranges(found) + "\\x{10000}-\\x{10ffff}]"


def _ranges(chars):
    """Characters as ranges of a regex class, so that a test stays a few comparisons."""
    out, start, last = [], None, None
    for point in [ord(c) for c in chars] + [None]:
        if last is not None and point == last + 1:
            last = point
            continue
        if last is not None:
            out.append(f"\\u{start:04x}" + (f"-\\u{last:04x}" if last > start else ""))
        start = last = point
    return "".join(out)


def _is_dash(char):
    return "\u2010" <= char <= "\u2015" or char in "\u2212\uff0d"


def _blank_free(c):
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", "")


def folded_width(c, one_dash=True) -> Column:
    """Compatibility forms (full width, circled, squared, superscript, ...) to their plain signs, one or several; dashes to '-'.

    Only a text that has a sign with several signs for a form is taken apart; each such sign is replaced once.
    """
    plain, mapped, expanding, forms = _compat_maps(one_dash)
    known = F.str_to_map(F.lit(forms), F.lit("\x01"), F.lit("\x02"))
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(f"({expanding})"), 1))
    spelled = F.when(c.rlike(expanding), F.aggregate(found, c, lambda text, sign: F.replace(text, sign, F.element_at(known, sign)))).otherwise(c)
    return F.translate(spelled, plain, mapped)


def normalize_name(c) -> Column:
    """One spelling per name: plain characters, one dash, no blanks; null gives ''. Marks stay beside their sign (see with_normalized)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(_blank_free(folded_width(c.cast("string"))), F.lit(""))


@F.pandas_udf(StringType())
def _normalize_rare(names: pd.Series) -> pd.Series:
    dashes = re.compile(r"[\u2010-\u2015\u2212\uff0d]")
    return names.map(lambda s: None if s is None else
                     re.sub(r"\s+", "", dashes.sub("-", unicodedata.normalize("NFKC", s))))


def with_normalized(df: DataFrame, source: str, target: str) -> DataFrame:
    """As normalize_name, exact also for marks that melt into the sign before them and for signs beyond the basic plane.

    The input is read once. Only names that hold such a sign are handed to Python, nulls in the place of all others.
    """
    rare = F.col(source).rlike(_joining())
    return df.withColumn(target, F.coalesce(_normalize_rare(F.when(rare, F.col(source))), normalize_name(source)))


def org_key_of_normalized(n) -> Column:
    """Up to three suffixes off in one pass: every suffix ends in its own last sign and none of these stands inside another
    suffix's cut, so the shortest head is what three rounds of the longest suffix leave."""
    last = sorted({s[-1] for s in S.ORG_SUFFIXES})
    pattern = "^(.+?)(?:" + "|".join(S.ORG_SUFFIXES) + "){1,3}$"
    return F.when(F.right(n, F.lit(1)).isin(last), F.regexp_replace(n, pattern, "$1")).otherwise(n)


def org_match_key(c) -> Column:
    """Organisation key: up to three legal-form suffixes removed, longest first, never down to nothing."""
    return org_key_of_normalized(normalize_name(c))


def _or_null(c):
    return F.when(c != "", c)


def manager_of_normalized(n) -> Column:
    managers = "(" + "|".join(S.FUND_MANAGERS) + ")"
    return F.coalesce(_or_null(F.regexp_extract(n, "-" + managers, 1)), _or_null(F.regexp_extract(n, "^" + managers, 1)))


def fund_manager(c) -> Column:
    """Known manager in the parts after the first dash, else at the very start, else null."""
    return manager_of_normalized(normalize_name(c))


def fund_key_of_normalized(n) -> Column:
    custodian = F.coalesce(_or_null(F.substring_index(n, "-", 1)), n)
    return F.coalesce(F.concat(F.lit("FUND:"), manager_of_normalized(n)),
                      F.concat(F.lit("CUST:"), org_key_of_normalized(custodian)), F.lit(""))


def fund_match_key(c) -> Column:
    """FUND:<manager> where one is known, else CUST:<organisation key of the first part>."""
    return fund_key_of_normalized(normalize_name(c))


def channel_pattern(patterns=None) -> str:
    return "|".join(f"(?:{p})" for p in (S.CHANNEL_PATTERNS if patterns is None else patterns))


def _plain(text):
    return re.sub(r"\s+", "", unicodedata.normalize("NFKC", text))


def is_channel_name(c, exact=None, patterns=None, normalized=None) -> Column:
    """True for holders that only hold for others: exact list on the normalised name, patterns on both spellings."""
    c = F.col(c) if isinstance(c, str) else c
    n = normalize_name(c) if normalized is None else normalized
    exact = [_plain(x) for x in (S.CHANNEL_NAMES if exact is None else exact)]
    patterns = S.CHANNEL_PATTERNS if patterns is None else patterns
    hit = n.isin(exact) if exact else F.lit(False)
    if patterns:
        hit = hit | c.rlike(channel_pattern(patterns)) | n.rlike(channel_pattern(patterns))
    return F.coalesce((c != "") & hit, F.lit(False))


def contains_any(c, words) -> Column:
    return c.rlike("|".join(re.escape(w) for w in words))


def holder_type_of_normalized(t, n) -> Column:
    return (F.when(contains_any(t, S.PERSON_TYPE_WORDS) | (t == "个人"), "person")
            .when(contains_any(t, S.FUND_TYPE_WORDS), "fund")
            .when(contains_any(t, S.ORG_TYPE_WORDS), "org")
            .when((F.char_length(n) <= 4) & ~contains_any(n, S.HOLDER_ORG_WORDS), "person")
            .otherwise("org"))


def holder_entity_type(holder_type, name) -> Column:
    """Person, fund or organisation: by the stated type, else a short name without organisation words is a person."""
    return holder_type_of_normalized(normalize_name(holder_type), normalize_name(name))


def title_class(title) -> Column:
    t = normalize_name(title)
    return (F.when(t.contains("独立董事"), "independent_director")
            .when(t.contains("监事"), "supervisor")
            .when(t.contains("董事"), "director")
            .when(contains_any(t, S.SENIOR_WORDS), "senior_mgmt")
            .otherwise("other"))


def controller_type_of_normalized(n) -> Column:
    return (F.when(contains_any(n, S.CONTROLLER_ORG_WORDS), "org")
            .when(F.char_length(n) <= 4, "person").otherwise("org"))


def controller_entity_type(name) -> Column:
    return controller_type_of_normalized(normalize_name(name))


def canonical_of_normalized(entity_type, n) -> Column:
    t = F.col(entity_type) if isinstance(entity_type, str) else entity_type
    return F.coalesce(F.when(t == "person", n).when(t == "fund", fund_key_of_normalized(n))
                      .otherwise(org_key_of_normalized(n)), F.lit(""))


def canonical_for(entity_type, name) -> Column:
    """Key of an entity within its type."""
    return canonical_of_normalized(entity_type, normalize_name(name))


def matcher_norm(c) -> Column:
    """Spelling used by the dictionary: plain characters, no blanks, one trailing share-class letter dropped, lower case."""
    c = F.col(c) if isinstance(c, str) else c
    n = F.trim(F.regexp_replace(folded_width(c, one_dash=False), "[ \\t\u3000]", ""))
    return F.lower(F.regexp_replace(n, "[ABCDabcd]$", ""))


def derive_alias(name) -> Column:
    """Name without its leading place, unless nothing but a general word is left."""
    name = F.col(name) if isinstance(name, str) else name
    rest = F.regexp_extract(name, "^(?:" + "|".join(S.PLACE_PREFIXES) + ")(..+)$", 1)
    return F.when((rest != "") & ~matcher_norm(rest).isin(S.GENERIC_ALIASES), rest)


def alignment_name(c) -> Column:
    """Spelling on which found and disclosed parties are compared."""
    n = normalize_name(c)
    return F.coalesce(_or_null(org_key_of_normalized(n)), n)
