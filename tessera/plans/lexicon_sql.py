"""BM25 over Porter stems in DuckDB's SQL: what the index is compared to."""

from __future__ import annotations

from ..functions import stem as S
from ..operators import lexicon as L

CONSONANT, VOWEL = "[^aeiou][^aeiouy]*", "[aeiouy][aeiou]*"
ONE_OR_MORE = f"^({CONSONANT})?{VOWEL}{CONSONANT}"
ONE = f"^({CONSONANT})?{VOWEL}{CONSONANT}({VOWEL})?$"
TWO_OR_MORE = f"^({CONSONANT})?{VOWEL}{CONSONANT}{VOWEL}{CONSONANT}"
SOME_VOWEL = f"^({CONSONANT})?[aeiouy]"
SHORT = f"^{CONSONANT}[aeiouy][^aeiouwxy]$"


def is_(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, '{pattern}')"


def cut(x: str, n: int) -> str:
    return f"left({x}, length({x}) - {n})"


def replaced(endings: dict[str, str], condition: str, x: str = "x") -> str:
    """The longest ending that ``x`` has, replaced where what precedes it meets the condition."""
    cases = "".join(
        f" WHEN ends_with({x}, '{end}') THEN CASE WHEN {is_(cut(x, len(end)), condition)}{f''' AND right({cut(x, 3)}, 1) IN ('s', 't')''' if end == 'ion' else ''} THEN {cut(x, len(end))} || '{new}' ELSE {x} END"
        for end, new in sorted(endings.items(), key=lambda e: (-len(e[0]), e[0]))
    )
    return f"CASE{cases} ELSE {x} END"


def after(x: str) -> str:
    """What becomes of a word that has lost -ed or -ing."""
    return f"""CASE WHEN regexp_matches({x}, '(at|bl|iz)$') THEN {x} || 'e' WHEN length({x}) > 1 AND right({x}, 1) = substr({x}, length({x}) - 1, 1) AND regexp_matches({x}, '[^aeiouylsz]$') THEN {cut(x, 1)} WHEN {is_(x, ONE)} AND {is_(x, SHORT)} THEN {x} || 'e' ELSE {x} END"""


STEPS = (
    f"CASE WHEN regexp_matches(x, '(sses|ies)$') THEN {cut('x', 2)} WHEN regexp_matches(x, '(^|[^s])s$') THEN {cut('x', 1)} ELSE x END",
    f"CASE WHEN ends_with(x, 'eed') THEN CASE WHEN {is_(cut('x', 3), ONE_OR_MORE)} THEN {cut('x', 1)} ELSE x END WHEN ends_with(x, 'ed') AND {is_(cut('x', 2), SOME_VOWEL)} THEN {after(cut('x', 2))} WHEN ends_with(x, 'ing') AND {is_(cut('x', 3), SOME_VOWEL)} THEN {after(cut('x', 3))} ELSE x END",
    f"CASE WHEN ends_with(x, 'y') AND {is_(cut('x', 1), SOME_VOWEL)} THEN {cut('x', 1)} || 'i' ELSE x END",
    replaced(S.STEP_2, ONE_OR_MORE),
    replaced(S.STEP_3, ONE_OR_MORE),
    replaced(dict.fromkeys(S.STEP_4, ""), TWO_OR_MORE),
    f"CASE WHEN ends_with(x, 'e') AND ({is_(cut('x', 1), TWO_OR_MORE)} OR ({is_(cut('x', 1), ONE)} AND NOT {is_(cut('x', 1), SHORT)})) THEN {cut('x', 1)} ELSE x END",
    f"CASE WHEN ends_with(x, 'll') AND {is_('x', TWO_OR_MORE)} THEN {cut('x', 1)} ELSE x END",
)


def stems(vocabulary: str = "vocab") -> str:
    """CTEs up to stems(w, s) of the words w of a relation; an initial y is a consonant."""
    ctes = [f"p0 AS (SELECT w, regexp_replace(w, '^y', 'Y') AS x FROM {vocabulary} WHERE length(w) BETWEEN 3 AND 64)"]
    ctes += [f"p{i} AS (SELECT w, {step} AS x FROM p{i - 1})" for i, step in enumerate(STEPS, 1)]
    return ", ".join(ctes) + f", stems AS (SELECT w, lower(x) AS s FROM p{len(STEPS)} UNION ALL SELECT w, w FROM {vocabulary} WHERE length(w) NOT BETWEEN 3 AND 64)"


def bm25(rows: str, columns: tuple[str, ...], terms: list[str] | str) -> str:
    """CTEs up to hits(id, bm25) of a relation's rows that hold any of the (stemmed) terms (or of those that a subquery over said and stems gives)."""
    word_list = "list_concat(" + ", ".join(f"regexp_split_to_array(lower(strip_accents(coalesce({c}, ''))), '[^\\p{{L}}\\p{{N}}]+')" for c in columns) + ")" if len(columns) > 1 else f"regexp_split_to_array(lower(strip_accents(coalesce({columns[0]}, ''))), '[^\\p{{L}}\\p{{N}}]+')"
    wanted = terms if isinstance(terms, str) else ", ".join(f"'{t}'" for t in terms)
    return f"""bag AS (SELECT id, list_filter({word_list}, lambda w: length(w) > 0) AS ws FROM {rows}), said AS (SELECT id, unnest(ws) AS w FROM bag), vocab AS (SELECT DISTINCT w FROM said), {stems()},
tfs AS (SELECT id, s AS term, count(*) AS tf FROM said JOIN stems USING (w) WHERE s IN ({wanted}) GROUP BY 1, 2), dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY 1), tot AS (SELECT count(*) AS n, avg(len(ws)) AS avg_dl FROM bag),
hits AS (SELECT id, round(sum((CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN {L.LEAST_IDF} ELSE ln((n - df + 0.5) / (df + 0.5)) END) * tf * {L.K1 + 1} / (tf + {L.K1} * ({1 - L.B} + {L.B} * len(ws) / avg_dl))), 10) AS bm25 FROM tfs JOIN dfs USING (term) JOIN bag USING (id), tot GROUP BY id)"""
