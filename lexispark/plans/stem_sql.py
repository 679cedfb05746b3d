"""The stemmer's rules once more as SQL over the distinct words of `kept`, for comparison."""

from __future__ import annotations

from lexispark.functions.stem import EXCEPTIONS, STEP2, STEP3, STEP4, STOP_AFTER_PLURAL

_SHORT = "'([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$'"
_TO_REGION = "'^.*?[aeiouy][^aeiouy]'"


def _ending(column: str, endings) -> str:
    """The longest listed ending: a match anchored at the end starts as far left as possible."""
    return f"regexp_extract({column}, '({'|'.join(endings)})$')"


def _replacement(column: str, table: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + " END"


def _region(start: str) -> str:
    rest = f"substr(w, {start} + 1)"
    return f"CASE WHEN regexp_matches({rest}, '[aeiouy][^aeiouy]') THEN {start} + length(regexp_extract({rest}, {_TO_REGION})) ELSE length(w) END"


def _cut(column: str, ending: str) -> str:
    return f"left({column}, length({column}) - length({ending}))"


_EXCEPTIONS = "exceptions(word, stem) AS (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in EXCEPTIONS.items()) + ")"
_STOPPED = ", ".join(f"'{w}'" for w in sorted(STOP_AFTER_PLURAL))

PORTER2_CTES = (
    _EXCEPTIONS,
    r"""marked AS (SELECT word, regexp_replace(regexp_replace(replace(word, '’', ''''), '^''', ''), '(^|[aeiouy])y', '\1Y', 'g') AS w
        FROM (SELECT DISTINCT word FROM kept))""",
    f"""region1 AS (SELECT *, CASE WHEN regexp_matches(w, '^(gener|commun|arsen)')
        THEN length(regexp_extract(w, '^(gener|commun|arsen)')) ELSE {_region('0')} END AS r1 FROM marked)""",
    f"region2 AS (SELECT word, r1, {_region('r1')} AS r2, regexp_replace(w, '(''s''|''s|'')$', '') AS w FROM region1)",
    """plural AS (SELECT * REPLACE (CASE WHEN w LIKE '%sses' THEN left(w, length(w) - 2)
        WHEN w LIKE '%ied' OR w LIKE '%ies' THEN left(w, length(w) - CASE WHEN length(w) > 4 THEN 2 ELSE 1 END)
        WHEN w LIKE '%us' OR w LIKE '%ss' OR w NOT LIKE '%s' THEN w
        WHEN regexp_matches(left(w, length(w) - 2), '[aeiouy]') THEN left(w, length(w) - 1) ELSE w END AS w) FROM region2)""",
    f"past AS (SELECT *, {_ending('w', ['eed', 'eedly', 'ed', 'edly', 'ing', 'ingly'])} AS e FROM plural)",
    f"""past_base AS (SELECT *, {_cut('w', 'e')} AS base FROM past)""",
    f"""past_cut AS (SELECT word, r1, r2, CASE WHEN e = '' THEN w
        WHEN e IN ('eed', 'eedly') THEN CASE WHEN length(base) >= r1 THEN base || 'ee' ELSE w END
        WHEN NOT regexp_matches(base, '[aeiouy]') THEN w
        WHEN regexp_matches(base, '(at|bl|iz)$') THEN base || 'e'
        WHEN regexp_matches(base, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(base, length(base) - 1)
        WHEN r1 >= length(base) AND regexp_matches(base, {_SHORT}) THEN base || 'e' ELSE base END AS w, w AS before FROM past_base)""",
    """final_y AS (SELECT word, r1, r2, before, CASE WHEN length(w) > 2 AND regexp_matches(w, '[^aeiouy][yY]$')
        THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM past_cut)""",
    f"step2 AS (SELECT *, {_ending('w', STEP2)} AS e, {_cut('w', _ending('w', STEP2))} AS base FROM final_y)",
    f"""step2_cut AS (SELECT word, r1, r2, before, CASE WHEN e = '' OR length(base) < r1 OR (e = 'ogi' AND base NOT LIKE '%l')
        OR (e = 'li' AND NOT regexp_matches(base, '[cdeghkmnrt]$')) THEN w ELSE base || {_replacement('e', STEP2)} END AS w FROM step2)""",
    f"step3 AS (SELECT *, {_ending('w', STEP3)} AS e, {_cut('w', _ending('w', STEP3))} AS base FROM step2_cut)",
    f"""step3_cut AS (SELECT word, r1, r2, before, CASE WHEN e = '' OR length(base) < CASE WHEN e = 'ative' THEN r2 ELSE r1 END THEN w
        ELSE base || {_replacement('e', STEP3)} END AS w FROM step3)""",
    f"step4 AS (SELECT *, {_ending('w', STEP4)} AS e, {_cut('w', _ending('w', STEP4))} AS base FROM step3_cut)",
    """step4_cut AS (SELECT word, r1, r2, before, CASE WHEN e = '' OR length(base) < r2
        OR (e = 'ion' AND NOT regexp_matches(base, '[st]$')) THEN w ELSE base END AS w FROM step4)""",
    f"""step5 AS (SELECT word, before, CASE WHEN w LIKE '%e' AND (length(w) - 1 >= r2 OR (length(w) - 1 >= r1
        AND NOT regexp_matches(left(w, length(w) - 1), {_SHORT}))) THEN left(w, length(w) - 1)
        WHEN w LIKE '%ll' AND length(w) - 1 >= r2 THEN left(w, length(w) - 1) ELSE w END AS w FROM step4_cut)""",
    f"""english AS (SELECT s.word, CASE WHEN length(s.word) <= 2 THEN s.word WHEN x.stem IS NOT NULL THEN x.stem
        WHEN s.before IN ({_STOPPED}) THEN s.before ELSE lower(s.w) END AS word_stem FROM step5 s LEFT JOIN exceptions x USING (word))""",
)
