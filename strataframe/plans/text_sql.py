"""SQL twins of the text functions."""

from __future__ import annotations

from strataframe.functions.text import ACCENTED, STOP_WORDS, UNACCENTED

STOP_SQL = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def STEM_SQL(t: str) -> str:  # noqa: N802
    return f"""CASE WHEN length({t}) <= 4 THEN {t}
    WHEN ends_with({t}, 'ies') AND length({t}) > 5 THEN left({t}, length({t})-3) || 'y'
    WHEN ends_with({t}, 'sses') OR ends_with({t}, 'ses') THEN left({t}, length({t})-2)
    WHEN ends_with({t}, 'ing') AND length({t}) > 6 THEN left({t}, length({t})-3)
    WHEN ends_with({t}, 'ed') AND length({t}) > 5 THEN left({t}, length({t})-2)
    WHEN ends_with({t}, 's') AND NOT ends_with({t}, 'ss') THEN left({t}, length({t})-1) ELSE {t} END"""


def TOKENS_SQL(text: str) -> str:  # noqa: N802
    folded = f"regexp_replace(lower(coalesce({text}, '')), '[‐-―−]', '-', 'g')"
    joined = f"regexp_replace({folded}, '(\\d),(\\d{{3}})', '\\1\\2', 'g')"
    raw = (f"list_transform(regexp_split_to_array({joined}, '[^a-z0-9./-]+'), "
           "lambda r: regexp_replace(r, '^[./-]+|[./-]+$', '', 'g'))")
    kept = f"list_filter({raw}, lambda k: length(k) >= 2 AND length(k) <= 40 AND NOT list_contains({STOP_SQL}, k))"
    return f"list_transform({kept}, lambda t: CASE WHEN regexp_full_match(t, '\\d+') THEN t ELSE {STEM_SQL('t')} END)"


def WORDS_SQL(text: str) -> str:  # noqa: N802
    folded = f"translate(lower(coalesce({text}, '')), '{ACCENTED}', '{UNACCENTED}')"
    return f"list_filter(regexp_split_to_array({folded}, '[^\\p{{L}}\\p{{N}}]+'), lambda k: k <> '')"


def QUERY_TOKENS_SQL(text: str, limit: int = 24) -> str:  # noqa: N802
    cleaned = f"regexp_replace({text}, '[\"^*()]', ' ', 'g')"
    bare = f"trim(regexp_replace({cleaned}, '(?i)\\b(AND|OR|NOT|NEAR)\\b', ' ', 'g'))"
    return f"list_slice(list_filter(regexp_split_to_array({bare}, '\\s+'), lambda k: length(k) >= 2), 1, {limit})"
