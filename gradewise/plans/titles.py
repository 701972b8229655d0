"""Card and shop titles over the whole part table, and the rules of titles as DuckDB SQL.

The expressions of the first half are read by Spark and DuckDB alike. The second half states the rules
once more for DuckDB, whose patterns have no look-ahead.
"""

from __future__ import annotations

from gradewise.functions import text
from gradewise.operators import match


def _case(key: str, *values: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _turn(n: int, size: int) -> str:
    return f"CAST(floor(p_partkey / {n}) AS INT) % {size}"


CODE = _case("p_partkey % 12", "SV2a", "S8b", "M2a", "XY5", "XY8", "CP6", "BW3", "SV-P", "SM-P", "NEO1", "MMB", "sv9")
NUMBER = "lpad(CAST(p_size AS STRING), 3, '0')"
EXACT = "CASE WHEN p_partkey % 6 = 0 THEN 'sr' ELSE p_type END"
CARD = (
    "p_name || " + _case(_turn(12, 11), "", "", "", "(ミラー)", " マスボミラー", "(モンスターボールミラー)", " SAR仕様", " 旧裏", "  英語版", " アンリミ", " 1ED")
    + " || " + _case(_turn(7, 9), "", " SAR", " HR: SA", " RR", " P", " プロモ", " PR", "【UR】", "：仕様")
    + f" || CASE {_turn(5, 8)} WHEN 0 THEN ' [' || {CODE} || ' ' || {NUMBER} || '/069]' WHEN 1 THEN ' [' || {CODE} || ' ' || {NUMBER} || ']' WHEN 2 THEN ' {{' || {NUMBER} || '/069}} [' || {CODE} || ']'"
    + f" WHEN 3 THEN ' [' || {CODE} || ']' WHEN 4 THEN ' {{' || {NUMBER} || '/sv-P}}' WHEN 5 THEN ' [PROMO ' || {NUMBER} || ' SM-P]' WHEN 6 THEN ' [' || {NUMBER} || '/069]' WHEN 7 THEN ' [SV-P ' || {NUMBER} || ']' END"
)
SHOP = (
    _case("p_partkey % 9", "〔状態A-〕", "〔状態B〕", "〔状態難〕", "〔状態a〕", *[""] * 5) + " || p_name || " + _case(_turn(12, 11), "", "", "(ミラー)", "(ミラー)", "(マスターボールミラー)", "(モンスターボールミラー)", "(SAR仕様)", "(旧裏)", "(英語版)", "(アンリミ)", "(1ED)")
    + " || " + _case(_turn(7, 9), "", "【SAR】", "【HR】", "【RR】", "【P】", "【P】", "【PR】", "【UR】", "")
    + f" || CASE WHEN {CODE} LIKE '%-P' THEN '{{' || {NUMBER} || '/' || {CODE} || '}}' ELSE '{{' || {NUMBER} || '/069}}' END || CASE WHEN p_partkey % 13 = 0 THEN ' PSA10' ELSE '' END"
)


def q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def trim(x: str) -> str:
    return rf"regexp_replace(regexp_replace({x}, '^\s+', ''), '\s+\z', '')"


def collapse(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def loose(x: str) -> str:
    return rf"regexp_replace(translate(lower({x}), '{text.WIDE_DIGITS}', '{text.DIGITS}'), '[^\p{{L}}\p{{N}}]+', '', 'g')"


def _extract(x: str, pattern: str, group: int) -> str:
    return f"nullif(regexp_extract({x}, {q(pattern)}, {group}), '')"


def finish(x: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({x}, {q('(?i)' + p)}) THEN '{kind}'" for kind, p, _ in text.FINISHES) + " ELSE '' END"


def finish_label(kind: str) -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN '{label}'" for k, _, label in text.FINISHES) + " ELSE '' END"


def set_code(x: str) -> str:
    return f"coalesce({_extract(x, text.PROMO_SET_FIRST, 1)}, {_extract(x, text.PROMO_NUMBER_FIRST, 2)}, {_extract(x, text.PROMO_PRODUCT, 2)}, {_extract(x, text.SET_AND_NUMBER, 1)}, {_extract(x, text.SET_ALONE, 1)}, '')"


def card_number(x: str, model: str) -> str:
    promo = lambda p, n, c: f"{_extract(x, p, n)} || '/' || upper({_extract(x, p, c)})"
    return (
        f"coalesce({promo(text.PROMO_PRODUCT, 1, 2)}, {promo(text.PROMO_SET_FIRST, 2, 1)}, {promo(text.PROMO_NUMBER_FIRST, 1, 2)}, {_extract(x, text.NUMBER_IN_BRACES, 1)}, "
        f"{_extract(x, text.NUMBER_AFTER_SET, 1)}, {_extract(x, text.NUMBER_ALONE, 1)}, {_extract(model, text.NUMBER, 1)}, '')"
    )


def rarity(x: str, exact: str) -> str:
    token = rf"(?i)(?:^|\s)({text.RARITIES})\s*(?:[:：]|\[|\{{|\z)"
    after = rf"(?i)\[\s*[A-Za-z0-9-]+\s+[0-9]{{1,4}}/[0-9]{{1,4}}\s*\]\s*【?({text.RARITIES})】?"
    promo = rf"(?i)(?:^|\s)[A-Za-z0-9-]*-P(?:\s|\z)|(?:^|\s)PR(?:\s|\z)"  # noqa: F541
    return f"upper(coalesce({_extract(exact, f'(?i)^({text.RARITIES})$', 1)}, CASE WHEN contains({x}, 'プロモ') OR regexp_matches({x}, {q(promo)}) THEN 'P' END, {_extract(x, token, 1)}, {_extract(x, after, 1)}, ''))"


def base(x: str) -> str:
    out = f"regexp_replace(regexp_replace({x}, {q(chr(92) + 's*' + chr(92) + '(.+' + chr(92) + ')' + chr(92) + 's*' + chr(92) + 'z')}, ''), {q(r'\s*[【\[].*\z')}, '')"
    suffix = rf"(?:(?:{text.RARITIES})(?:\s*[:：]\s*[^\s\[]+)?|[:：]\s*(?:SA|{text.SUFFIX_WORDS})|(?:{text.SUFFIX_WORDS}))"
    for pattern in (rf"\((?:{text.FINISH_NOTES})\)", rf"(?:{text.FINISH_WORDS})", suffix):
        out = f"regexp_replace(trim({out}), {q(rf'(?i)\s*{pattern}\s*\z')}, '')"
    return f"trim({out})"


def parts(x: str, model: str, exact: str) -> str:
    """The columns base, card_no, rarity, code, finish of a collapsed title."""
    return f"{base(x)} AS base, {card_number(x, model)} AS card_no, {rarity(x, exact)} AS rarity, {set_code(x)} AS code, {finish(x)} AS finish"


def display(p: str = "") -> str:
    """The display name of columns made by ``parts``, of a table ``p.``."""
    some = lambda c, a, b: f"CASE WHEN {c} <> '' THEN '{a}' || {c} || '{b}' ELSE '' END"
    return collapse(f"{p}base || {some(f'({finish_label(f"{p}finish")})', '(', ')')} || {some(f'{p}rarity', '【', '】')} || {some(f'{p}card_no', '{', '}')} || {some(f'{p}code', ' [', ']')}")


def grading_query(x: str) -> str:
    inside = trim(f"regexp_extract({x}, '\\[([^\\]]+)\\]', 1)")
    words = f"string_split_regex({inside}, '\\s+')"
    number = f"upper(regexp_replace(string_split({words}[2], '/')[1], '^#', ''))"
    return f"CASE WHEN len({words}) >= 2 AND {number} <> '' THEN '{text.LANGUAGE} ' || upper({words}[1]) || ' ' || {number} WHEN regexp_matches({inside}, '^[A-Za-z0-9-]+\\z') THEN '{text.LANGUAGE} ' || upper({inside}) END"


def coverage_code(x: str, model: str) -> str:
    return f"upper(coalesce({_extract(x, text.SET_AND_NUMBER, 1)}, trim({model})))"


def modern(code: str) -> str:
    plain = r"^SV[A-Z0-9-]*\z|^SM[A-Z0-9-]*\z|^S[A-Z0-9-]+\z|^M[0-9]|^M-[A-Z]|^MA\z|^MB|^MC\z|^MMB\z|^CL[FKL]\z|^CP[0-9]+\z|^XY\z|^XY-P\z|^XY-BEST\z"
    return f"(regexp_matches({code}, '{plain}') OR coalesce(TRY_CAST(regexp_extract({code}, '^XY([0-9]+)\\z', 1) AS INTEGER) >= 6, false))"


def promo(x: str, code: str) -> str:
    return f"(regexp_matches({x}, '(?i)プロモ|PROMO') OR regexp_matches({code}, '(?i)-P\\z') OR regexp_matches({x}, '(?:^|[^A-Za-z0-9_])P(?:[^A-Za-z0-9_]|\\z)'))"


#: (id, title, model, exact, src, then ``parts``) of every part's card title.
CARDS = f"titles AS (SELECT p_partkey AS id, {CARD} AS title, p_brand AS model, {EXACT} AS exact, {collapse(CARD)} AS src FROM part), signed AS (SELECT *, {parts('src', 'model', 'exact')} FROM titles)"
#: Cards that are wanted, with promo flag, query and key.
WANTED = (
    f"marked AS (SELECT *, {promo('title', 'code')} AS promo, CASE WHEN regexp_matches(card_no, '/[^0-9]') THEN card_no WHEN card_no <> '' AND code <> '' THEN card_no || ' ' || code ELSE '' END AS query, {modern(coverage_code('title', 'model'))} AS modern FROM signed),"
    f" wanted AS (SELECT *, {loose('query')} AS key FROM marked WHERE modern OR promo)"
)
_FULL = collapse(rf"regexp_replace({SHOP}, '^〔状態[^〕]+〕', '') || ' [' || {CODE} || ']'")
_STATE = "coalesce(nullif(regexp_extract(shown, '(?i)^〔状態([A-D]-?)〕', 1), ''), 'A')"
#: (id, shown, name, state, then ``parts``, and keys) of every part's shop entry.
ENTRIES = (
    f"listed AS (SELECT p_partkey AS id, {SHOP} AS shown, {_FULL} AS name FROM part), split AS (SELECT *, {_STATE} AS state, {parts('name', chr(39) * 2, chr(39) * 2)} FROM listed),"
    f" entries AS (SELECT *, list_filter([{', '.join(loose(x) for x in ('name', 'base', 'card_no', 'code', 'rarity', 'base || rarity || card_no || code', 'base || card_no || code'))}], lambda x: x <> '') AS every FROM split)"
)
GRADED = match.GRADED
