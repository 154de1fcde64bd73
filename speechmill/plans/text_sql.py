"""DuckDB expressions of the letter-to-sound, transliteration and chunking rules, over the same fixed values as the Spark functions.

Switches are found by looking back over a list and runs by neighbours, not by the folds and back references of the Spark side. Each function takes the SQL of a value and gives the SQL of a result. `let` names a value inside an expression.
"""

from __future__ import annotations

from collections.abc import Callable

from ..functions import tables as T


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_map(entries: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in entries.items()) + "}"


def let(name: str, value: str, body: str) -> str:
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def joined(parts: str, by: str = "") -> str:
    return f"coalesce(array_to_string({parts}, {quoted(by)}), '')"


def units(value: str, first: list[str] | str) -> str:
    """The text cut into the given groups where one begins, else into single signs."""
    groups = first if isinstance(first, str) else "|".join(first)
    return f"regexp_extract_all({value}, {quoted(groups + '|(?s:.)')})"


def kind(w: str) -> str:
    return rf"CASE WHEN regexp_matches({w}, '[{T.DEVANAGARI}]') THEN 'hi' WHEN regexp_matches({w}, '[A-Za-z]') THEN 'latin' WHEN regexp_full_match({w}, '\p{{Nd}}+') THEN 'digit' ELSE 'other' END"


def latin_language(w: str) -> str:
    words = lambda x: ", ".join(map(quoted, x))
    hint = f"regexp_matches(lower({w}), '{'|'.join(T.HINDI_HINTS)}') AND regexp_matches(lower({w}), '[aeiou]$')"
    return f"CASE WHEN lower({w}) IN ({words(T.LOANWORDS)}) THEN 'hi' WHEN lower({w}) IN ({words([*T.OVERRIDES, *T.PRONUNCIATIONS])}) THEN 'en' WHEN {hint} THEN 'hi' ELSE 'en' END"


def squash(value: str) -> str:
    """A sign goes if it equals the one before it and either the second one before or the next one; line ends stay."""
    same = lambda k: f"cs[j {k}] IS NOT DISTINCT FROM ch"
    return let("cs", f"regexp_extract_all({value}, '(?s:.)')", joined(rf"list_filter(cs, lambda ch, j: NOT (ch NOT IN (chr(10), chr(13), chr(133), chr(8232), chr(8233)) AND {same('- 1')} AND (({same('- 2')} AND j > 2) OR {same('+ 1')})))"))


def english_to_ipa(w: str) -> str:
    vowels = "'a', 'e', 'i', 'o', 'u'"
    source = f"CASE WHEN {w} LIKE '%e' AND length({w}) > 2 AND substring({w}, length({w}) - 1, 1) NOT IN ({vowels}) THEN left({w}, length({w}) - 1) ELSE {w} END"
    soft = "eu IN ('c', 'g') AND coalesce(left(us[ei + 1], 1), '') IN ('e', 'i', 'y')"
    said = f"list_transform(us, lambda eu, ei: CASE WHEN {soft} THEN CASE eu WHEN 'c' THEN 's' ELSE 'dʒ' END ELSE coalesce({sql_map(T.ENGLISH_GROUPS | T.ENGLISH_LETTERS)}[eu], '?') END)"
    return f"CASE WHEN {w} = '' THEN '?' ELSE {squash(let('us', units(source, list(T.ENGLISH_GROUPS)), joined(said)))} END"


def hindi_rules(ipa: str) -> str:
    return rf"regexp_replace(regexp_replace({ipa}, 'ə$', ''), 'ə([aːɪiʊueɛoɔæ])', '\1', 'g')"


def hindi_to_ipa(value: str) -> str:
    consonant, sign, vowel, mark = (sql_map(x) for x in (T.CONSONANTS, T.SIGNS, T.VOWELS, T.MARKS))
    after = f"CASE substring(hu, 2, 1) WHEN '' THEN 'ə' WHEN '{T.VIRAMA}' THEN '' ELSE {sign}[substring(hu, 2, 1)] END"
    other = f"coalesce({vowel}[hu], {sign}[hu], {mark}[hu], CASE WHEN hu = '{T.VIRAMA}' THEN '' ELSE hu END)"
    cut = units(value, f"[{''.join(T.CONSONANTS)}](?:{T.VIRAMA}|[{''.join(T.SIGNS)}])?")
    return hindi_rules(joined(f"list_transform({cut}, lambda hu: coalesce({consonant}[left(hu, 1)] || {after}, {other}))"))


def token_to_ipa(w: str) -> str:
    spoken = {k: "".join(T.ARPABET.get(p.rstrip("0123456789"), "?") for p in v) for k, v in T.PRONUNCIATIONS.items()}
    known = sql_map(spoken | T.OVERRIDES | T.LOANWORDS)
    latin = let("lw", f"lower({w})", f"coalesce({known}[lw], {english_to_ipa('lw')})")
    return f"CASE {kind(w)} WHEN 'hi' THEN {hindi_to_ipa(w)} WHEN 'latin' THEN {latin} ELSE {w} END"


def join_ipa(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({text}, '\s+([,.;:!?])', '\1', 'g'), '\s+\|\s+', ' | ', 'g'), '\s{{2,}}', ' ', 'g'))"


def text_to_ipa(value: str, marker: str = "|") -> str:
    """The marker stands before a word whose language isn't that of the last word that has one."""
    language = f"CASE {kind('tw')} WHEN 'hi' THEN 'hi' WHEN 'latin' THEN {latin_language('tw')} END"
    said = f"list_filter(list_transform(regexp_extract_all({value}, {quoted(T.TOKEN)}), lambda tw: {{'ipa': {token_to_ipa('tw')}, 'lang': {language}}}), lambda tx: tx.ipa <> '')"
    before = "list_filter(list_transform(ts[1:ti - 1], lambda tz: tz.lang), lambda tz: tz IS NOT NULL)[-1]"
    parts = f"list_transform(ts, lambda tx, ti: CASE WHEN ti > 1 AND tx.lang <> {before} THEN {quoted(marker + ' ')} || tx.ipa ELSE tx.ipa END)"
    return join_ipa(let("ts", said, joined(parts, " ")))


def ipa_to_gujarati(ipa: str) -> str:
    cut = f"list_filter({units(f"regexp_replace({ipa}, '[| ]', '', 'g')", list(T.IPA_GROUPS))}, lambda gu: gu <> 'ː')"
    written = f"list_transform({cut}, lambda gu: {sql_map(T.IPA_GROUPS | T.IPA_SIGNS)}[gu])"
    return let("gs", written, f"CASE WHEN len(list_filter(gs, lambda gz: gz IS NULL)) > 0 THEN '' ELSE {joined('gs')} END")


def latin_to_gujarati(word: str) -> str:
    return joined(f"list_transform({units(f'lower({word})', list(T.LATIN_GROUPS))}, lambda au: coalesce({sql_map(T.LATIN_GROUPS | T.LATIN_LETTERS)}[au], au))")


def devanagari_to_gujarati(text: str) -> str:
    return f"translate({text}, '{T.PARALLEL}{T.DROPPED}', '{T.GUJARATI_PARALLEL}')"


def transliterate(word: str) -> str:
    by_ipa = let("ip", f"trim({text_to_ipa(word, ' ')})", f"CASE WHEN ip <> '' AND NOT contains(ip, '?') AND regexp_matches(ip, '{T.PHONETIC}') THEN {ipa_to_gujarati('ip')} END")
    letters = f"CASE WHEN regexp_matches({word}, '[{T.DEVANAGARI}]') THEN {devanagari_to_gujarati(word)} ELSE {latin_to_gujarati(word)} END"
    return f"CASE WHEN regexp_matches({word}, '[{T.GUJARATI}]') THEN {word} ELSE coalesce(nullif({by_ipa}, ''), {letters}) END"


def join_tokens(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({text}, '\s+([,.;:!?])', '\1', 'g'), '\(\s+', '(', 'g'), '\s+\)', ')', 'g'), '\s{{2,}}', ' ', 'g'))"


def translated(text: str, entries: dict[str, str]) -> str:
    digits = f"CASE WHEN regexp_full_match(xw, '\\p{{Nd}}+') THEN translate(xw, '0123456789', '{T.GUJARATI_DIGITS}') END"
    word = f"CASE WHEN NOT regexp_matches(xw, '[\\p{{L}}\\p{{N}}]') THEN xw ELSE coalesce({sql_map(entries)}[lower(xw)], {digits}, {transliterate('xw')}) END"
    return join_tokens(joined(f"list_transform(regexp_extract_all({text}, {quoted(T.TOKEN_GUJARATI)}), lambda xw: {word})", " "))


def speech_chunks(text: str, most: int = 220, by: str = "|") -> str:
    """A fold over sentences (kind 0) and the words of longer ones (1: the first, 2: others); the last value is the open chunk."""
    speakable = lambda s: f"regexp_matches({s}, '[A-Za-z0-9{T.DEVANAGARI}]')"
    unit = lambda t, k: f"{{'done': []::VARCHAR[], 'now': {t}, 'kind': {k}}}"
    words = f"list_transform(string_split(se, ' '), lambda wo, wi: {unit('wo', 'CASE WHEN wi = 1 THEN 1 ELSE 2 END')})"
    cut = f"flatten(list_transform(list_filter(string_split(regexp_replace(cl, '([.!?;:])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda se: se <> ''), lambda se: CASE WHEN length(se) <= {most} THEN [{unit('se', '0')}] ELSE {words} END))"
    longer = "CASE WHEN ac.now = '' THEN un.now ELSE ac.now || ' ' || un.now END"
    fits = f"(un.kind <> 1 AND NOT (un.kind = 0 AND ac.kind <> 0) AND length({longer}) <= {most})"
    fold = f"list_reduce({cut}, lambda ac, un: {{'done': CASE WHEN NOT {fits} AND ac.now <> '' THEN list_append(ac.done, ac.now) ELSE ac.done END, 'now': CASE WHEN {fits} THEN {longer} ELSE un.now END, 'kind': un.kind}}, {unit(quoted(''), '0')})"
    good = let("fo", fold, f"list_filter(list_transform(CASE WHEN fo.now <> '' THEN list_append(fo.done, fo.now) ELSE fo.done END, lambda pa: trim(pa)), lambda pa: {speakable('pa')})")
    whole = f"CASE WHEN {speakable('cl')} THEN cl ELSE '' END"
    chosen = f"CASE WHEN length(cl) <= {most} THEN {whole} ELSE {let('go', good, f'CASE WHEN len(go) > 0 THEN {joined("go", by)} ELSE {whole} END')} END"
    return let("cl", f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))", chosen)
