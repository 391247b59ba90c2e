"""The same rules as SQL text, for the queries' oracles."""

from __future__ import annotations

from collections.abc import Iterable

from clauseriver.functions import rules as R


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def rx(text: str, p: str, flags: str = "(?i)") -> str:
    return f"regexp_matches({text}, {lit(flags + p)})"


def any_rx(text: str, patterns: Iterable[str], flags: str = "(?i)") -> str:
    return "(" + " OR ".join(rx(text, p, flags) for p in patterns) + ")"


def any_in(text: str, phrases: Iterable[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(p)})" for p in phrases) + ")"


def count_rx(text: str, patterns: Iterable[str]) -> str:
    return "(0" + "".join(f" + CAST({rx(text, p)} AS INT)" for p in patterns) + ")"


def count_in(text: str, phrases: Iterable[str]) -> str:
    return "(0" + "".join(f" + CAST(contains({text}, {lit(p)}) AS INT)" for p in phrases) + ")"


def first_rx(text: str, patterns: Iterable[str]) -> str:
    return "CASE " + " ".join(f"WHEN {rx(text, p)} THEN {i}" for i, p in enumerate(patterns)) + " END"


def strip(t: str) -> str:
    return rf"regexp_replace({t}, '^\s+|\s+$', '', 'g')"


def collapse(t: str) -> str:
    return rf"regexp_replace({t}, '\s+', ' ', 'g')"


def normalize(t: str) -> str:
    return f"trim({collapse(rf"regexp_replace(lower({t}), '[^a-z0-9\s]', ' ', 'g')")})"


def normalize_quotes(t: str) -> str:
    straight = f"regexp_replace(lower({t}), '[\"''`]', '\"', 'g')"
    return f"trim({collapse(rf"regexp_replace({straight}, '[^\w\s\"]', ' ', 'g')")})"


def cap_words(t: str, most: int = 60, more: str = "...") -> str:
    words = rf"regexp_split_to_array({t}, '\s+')"
    return f"CASE WHEN len({words}) > {most} THEN array_to_string({words}[1:{most}], ' ') || '{more}' ELSE {t} END"


def quote_around(t: str, p: str, variant: str = "denial") -> str:
    head = f"regexp_extract({t}, {lit(rf'(?i)^([\s\S]*?)(?:{p})')}, 1)"
    if variant == "evidence":
        left = f"CASE WHEN regexp_matches({head}, '[.;]') THEN regexp_extract({head}, '[^.;]*$') ELSE substr({head}, greatest(1, length({head}) - 179), 180) END"
        after = f"substr({t}, length({head}) + 1)"
        right = f"CASE WHEN regexp_matches({after}, '[.;]') THEN regexp_extract({after}, '^[^.;]*[.;]') ELSE substr({after}, 1, 220) END"
        quote = strip(f"(({left}) || ({right}))")
        return f"CASE WHEN length({quote}) >= 24 THEN substr({quote}, 1, 300) ELSE '' END"
    left = f"regexp_extract({head}, '{'[^.]*$' if variant == 'denial' else '[^.\\n]*$'}')"
    hit = f"regexp_extract({t}, {lit('(?i)' + p)})"
    after = f"substr({t}, length({head}) + length({hit}) + 1)"
    right = f"CASE WHEN contains({after}, '.') THEN {hit} || regexp_extract({after}, '^[^.]*\\.') ELSE substr({t}, length({head}) + 1, 200) END"
    return f"substr({collapse(strip(f'({left} || ({right}))'))}, 1, {240 if variant == 'denial' else 300})"


def null_citation(c: str) -> str:
    c = f"lower({strip(f"coalesce({c}, '')")})"
    return f"({c} IN ({', '.join(map(lit, R.NULL_CITATIONS))}) OR {rx(c, R.NULL_CITATION)})"


def is_paraphrase(c: str) -> str:
    c = strip(f"coalesce({c}, '')")
    return f"({any_rx(c, R.PARAPHRASE_STRICT)} OR {any_rx(f'substr({c}, 1, 80)', R.PARAPHRASE_LEADING)})"


def strip_wrapper(c: str) -> str:
    inner = f"regexp_replace({c}, {lit('(?i)' + R.WRAPPER_PREFIX)}, '')"
    inner = f"regexp_replace({inner}, {lit('(?i)' + R.WRAPPER_SUFFIX)}, '')"
    inner = strip(f"regexp_replace({inner}, '[\"''”’]+$', '')")
    return f"CASE WHEN length({inner}) >= 20 THEN {inner} ELSE {c} END"


def is_grounded(c: str, s: str) -> str:
    cit, src = normalize_quotes(c), normalize_quotes(s)
    words = f"list_filter(string_split({cit}, ' '), lambda w: w <> '')"
    window = (
        f"len(list_filter(range(1, len({words}) - 3), lambda i: length(array_to_string({words}[i:i + 4], ' ')) >= 18 "
        f"AND contains({src}, array_to_string({words}[i:i + 4], ' ')))) > 0"
    )
    return (
        f"(coalesce({c}, '') NOT IN ('', {lit(R.NOT_ADDRESSED)}) AND length({cit}) >= 25 "
        f"AND (contains({src}, substr({cit}, 1, 60)) OR (len({words}) >= 5 AND {window})))"
    )


def classify_citation(c: str, s: str) -> str:
    c = strip(f"coalesce({c}, '')")
    return (
        f"CASE WHEN {c} IN ('', {lit(R.NOT_ADDRESSED)}) THEN 'ABSENT' WHEN {is_paraphrase(c)} THEN 'PARAPHRASE' "
        f"WHEN length({c}) < 25 THEN 'TOO_SHORT' WHEN NOT {is_grounded(c, s)} THEN 'NOT_FOUND' ELSE 'GROUNDED' END"
    )


def citation_confidence(c: str, s: str) -> str:
    cit, src = normalize(c), normalize(s)
    words = f"list_filter(string_split({cit}, ' '), lambda w: length(w) > 3)"
    hits = f"len(list_filter({words}, lambda w: contains({src}, w)))"
    return (
        f"CASE WHEN coalesce({c}, '') IN ('', '{R.NOT_FOUND}', '{R.NOT_ADDRESSED}') THEN 'MEDIUM' "
        f"WHEN length(substr({cit}, 1, 50)) >= 20 AND contains({src}, substr({cit}, 1, 50)) THEN 'HIGH' "
        f"WHEN len({words}) = 0 THEN 'LOW' WHEN {hits} / len({words}) >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END"
    )


def host(u: str) -> str:
    return f"lower(regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


def url_path(u: str) -> str:
    return f"regexp_extract({u}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"


def conf_rank(c: str) -> str:
    return f"CASE {c} WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 ELSE 0 END"
