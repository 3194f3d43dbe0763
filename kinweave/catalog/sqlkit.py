"""SQL spellings of the name functions, for the comparison only."""
from kinweave import settings as S

_WIDE = "".join(chr(0xFF01 + i) for i in range(94)) + "　—–"
_SLIM = "".join(chr(0x21 + i) for i in range(94)) + " --"


def lit(s):
    return "'" + s.replace("'", "''") + "'"


def in_list(words):
    return "(" + ",".join(lit(w) for w in words) + ")"


def alternatives(words):
    return lit("|".join(w.replace(".", r"\.") for w in words))


def norm(x):
    return f"regexp_replace(translate(coalesce({x},''), {lit(_WIDE)}, {lit(_SLIM)}), '\\s+', '', 'g')"


def org_of_norm(n):
    for _ in range(3):
        n = f"regexp_replace({n}, '^(.+?)({'|'.join(S.ORG_SUFFIXES)})$', '\\1')"
    return n


def org(x):
    return org_of_norm(norm(x))


def manager(x):
    m = "|".join(S.FUND_MANAGERS)
    n = norm(x)
    return (f"coalesce(nullif(regexp_extract({n}, '-({m})', 1), ''), nullif(regexp_extract({n}, '^({m})', 1), ''))")


def fund_key(x):
    n = norm(x)
    first = f"split_part({n}, '-', 1)"
    return (f"coalesce('FUND:' || {manager(x)}, 'CUST:' || {org_of_norm(f'coalesce(nullif({first}, chr(0)), {n})')})"
            ).replace("chr(0)", "''")


def channel(x):
    pattern = lit("|".join(f"(?:{p})" for p in S.CHANNEL_PATTERNS))
    exact = in_list([n.replace(" ", "") for n in S.CHANNEL_NAMES])
    return f"({norm(x)} IN {exact} OR regexp_matches({x}, {pattern}) OR regexp_matches({norm(x)}, {pattern}))"


def any_word(x, words):
    return f"regexp_matches({x}, {alternatives(words)})"


def holder_type(t, n):
    t, n = norm(t), norm(n)
    return (f"CASE WHEN {any_word(t, ['自然'])} OR {t}='个人' THEN 'person' WHEN {any_word(t, ['基金', '私募'])} THEN 'fund' "
            f"WHEN {any_word(t, ['机构', '法人', '企业', '外资'])} THEN 'org' WHEN length({n})<=4 AND NOT "
            f"{any_word(n, S.HOLDER_ORG_WORDS)} THEN 'person' ELSE 'org' END")


def controller_type(x):
    n = norm(x)
    return f"CASE WHEN {any_word(n, S.CONTROLLER_ORG_WORDS)} THEN 'org' WHEN length({n})<=4 THEN 'person' ELSE 'org' END"


def canonical(t, x):
    return f"CASE {t} WHEN 'person' THEN {norm(x)} WHEN 'fund' THEN {fund_key(x)} ELSE {org(x)} END"


def title(x):
    t = norm(x)
    return (f"CASE WHEN contains({t},'独立董事') THEN 'independent_director' WHEN contains({t},'监事') THEN 'supervisor' "
            f"WHEN contains({t},'董事') THEN 'director' WHEN {any_word(t, S.SENIOR_WORDS)} THEN 'senior_mgmt' ELSE 'other' END")


def matcher(x):
    t = f"translate({x}, {lit(_WIDE[:95])}, {lit(_SLIM[:95])})"
    return f"lower(regexp_replace(regexp_replace({t}, '[ \\t　]', '', 'g'), '[ABCDabcd]$', ''))"


def alias(x):
    rest = f"regexp_extract({x}, '^(?:{'|'.join(S.PLACE_PREFIXES)})(..+)$', 1)"
    return f"CASE WHEN {rest}<>'' AND {matcher(rest)} NOT IN {in_list(S.GENERIC_ALIASES)} THEN {rest} END"


def aligned(x):
    return f"coalesce(nullif({org(x)},''), {norm(x)})"
