"""Text functions on columns: tokens, scripts, letter-to-sound, transliteration, chunking. All JVM-side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T


#: A token of decimal digits of any script.
DIGITS_OR_NONE = r"^\p{Nd}+$"


def mapping(entries: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in entries.items() for x in pair))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once; inside a lambda Spark works out each mention of an expression again."""
    return F.get(F.transform(F.array(value), body), 0)


def hinglish_tokens(text: Column, gujarati: bool = False) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({T.TOKEN_GUJARATI if gujarati else T.TOKEN})"), 1)


def lm_tokens(text: Column) -> Column:
    """Lower case; runs of Devanagari, a-z, 0-9, apostrophe and hyphen."""
    return F.regexp_extract_all(F.lower(text), F.lit(rf"[{T.DEVANAGARI}a-z0-9'\-]+"), 0)


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, T.SENTENCE_END), lambda s: F.btrim(s, F.lit(" \t\n\x0b\f\r"))), lambda s: s != "")


def token_kind(token: Column) -> Column:
    """hi, latin, digit or other."""
    return F.when(token.rlike(rf"[{T.DEVANAGARI}]"), "hi").when(token.rlike("[A-Za-z]"), "latin").when(token.rlike(r"^\p{Nd}+$"), "digit").otherwise("other")


def latin_language(token: Column) -> Column:
    """hi or en for a Latin token: word lists first, then a hint inside and a vowel at the end."""
    low = F.lower(token)
    return F.when(low.isin(list(T.LOANWORDS)), "hi").when(low.isin([*T.OVERRIDES, *T.PRONUNCIATIONS]), "en").otherwise(hinted_language(token))


def hinted_language(token: Column) -> Column:
    """hi or en for a Latin token that is in no word list: a hint inside and a vowel at the end make it hi."""
    low = F.lower(token)
    return F.when(low.rlike("|".join(T.HINDI_HINTS)) & low.rlike("[aeiou]$"), "hi").otherwise("en")


def script_runs(token: Column) -> Column:
    """A token cut where its script changes (Devanagari, Latin, other)."""
    return F.regexp_extract_all(token, F.lit(rf"([{T.DEVANAGARI}]+|[A-Za-z]+|[^A-Za-z{T.DEVANAGARI}]+)"), 1)


def arpabet_to_ipa(phones: Column) -> Column:
    """Array of phones to IPA; the stress digit goes, unknown phones become '?'."""
    table = mapping(T.ARPABET)
    return F.array_join(F.transform(phones, lambda p: F.coalesce(table[F.regexp_replace(p, "[0-9]", "")], F.lit("?"))), "")


def squash(ipa: Column) -> Column:
    """Three or more of a sign become one."""
    return F.regexp_replace(ipa, r"(.)\1{2,}", "$1")


def english_to_ipa(word: Column) -> Column:
    """Spelling rules: silent e, letter groups in order, soft c and g, single letters, '?' for the rest."""
    silent = word.endswith("e") & (F.length(word) > 2) & ~F.substring(word, -2, 1).isin(*"aeiou")
    source = F.when(silent, F.regexp_replace(word, "e$", "")).otherwise(word)
    units = F.regexp_extract_all(source, F.lit(f"({'|'.join(T.ENGLISH_GROUPS)}|.)"), 1)
    # a lone c or g is soft before e, i or y: the first letter of the next unit
    spoken = mapping(T.ENGLISH_GROUPS | T.ENGLISH_LETTERS)
    soft = lambda us: F.transform(
        us,
        lambda u, i: F.when(u.isin("c", "g") & (F.coalesce(F.substring(F.get(us, i + 1), 1, 1), F.lit("")).isin("e", "i", "y")), F.when(u == "c", "s").otherwise("dʒ")).otherwise(F.coalesce(spoken[u], F.lit("?"))),
    )
    return F.when(word == "", "?").otherwise(squash(F.array_join(let(units, soft), "")))


def hindi_to_ipa(text: Column) -> Column:
    """Consonants carry a schwa unless a vowel sign or virama follows; the last schwa and a schwa before a vowel go."""
    vowel, sign, consonant, mark = mapping(T.VOWELS), mapping(T.SIGNS), mapping(T.CONSONANTS), mapping(T.MARKS)
    consonants, signs = "".join(k for k in T.CONSONANTS), "".join(T.SIGNS)
    units = F.regexp_extract_all(text, F.lit(f"([{consonants}](?:{T.VIRAMA}|[{signs}])?|(?s:.))"), 1)

    def say(u: Column) -> Column:
        head, tail = F.substring(u, 1, 1), F.substring(u, 2, 1)
        base = consonant[head]
        spoken = F.when(tail == "", F.concat(base, F.lit("ə"))).when(tail == T.VIRAMA, base).otherwise(F.concat(base, sign[tail]))
        other = F.coalesce(vowel[u], sign[u], mark[u], F.when(u == T.VIRAMA, "").otherwise(u))
        return F.when(base.isNotNull(), spoken).otherwise(other)

    return hindi_rules(F.array_join(F.transform(units, say), ""))


def hindi_rules(ipa: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(ipa, "ə$", ""), "ə([aːɪiʊueɛoɔæ])", "$1")


def latin_to_ipa(token: Column) -> Column:
    said = {w: "".join(T.ARPABET.get(p.rstrip("0123456789"), "?") for p in ps) for w, ps in T.PRONUNCIATIONS.items()}
    known = mapping({**said, **T.OVERRIDES, **T.LOANWORDS})
    return let(F.lower(token), lambda low: F.coalesce(known[low], english_to_ipa(low)))


def token_to_ipa(token: Column) -> Column:
    """A token to IPA; digits and punctuation stay. Tokens never mix scripts, so a token is one run."""
    return let(token_kind(token), lambda kind: F.when(kind == "hi", hindi_to_ipa(token)).when(kind == "latin", latin_to_ipa(token)).otherwise(token))


def token_language(token: Column) -> Column:
    kind = token_kind(token)
    return F.when(kind == "hi", "hi").when(kind == "latin", latin_language(token))


def join_ipa(parts: Column) -> Column:
    text = F.array_join(parts, " ")
    text = F.regexp_replace(text, r"\s+([,.;:!?])", "$1")
    text = F.regexp_replace(text, r"\s+\|\s+", " | ")
    return F.trim(F.regexp_replace(text, r"\s{2,}", " "))


def text_to_ipa(text: Column, marker: str = "|") -> Column:
    """Tokens to IPA in order, with the marker where the language of words changes."""
    said = F.filter(F.transform(hinglish_tokens(text), lambda t: F.struct(token_to_ipa(t).alias("ipa"), token_language(t).alias("lang"))), lambda x: x["ipa"] != "")
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(None).cast("string").alias("lang"))

    def step(acc: Column, x: Column) -> Column:
        switch = x["lang"].isNotNull() & acc["lang"].isNotNull() & (x["lang"] != acc["lang"])
        own = F.when(switch, F.array(F.lit(marker), x["ipa"])).otherwise(F.array(x["ipa"]))
        return F.struct(F.concat(acc["parts"], own).alias("parts"), F.coalesce(x["lang"], acc["lang"]).alias("lang"))

    return F.aggregate(said, start, step, lambda a: join_ipa(a["parts"]))


def ipa_to_gujarati(ipa: Column) -> Column:
    """Groups then single signs; one sign that isn't known makes the whole result empty."""
    clean = F.regexp_replace(ipa, "[| ]", "")
    units = F.filter(F.regexp_extract_all(clean, F.lit(f"({'|'.join(T.IPA_GROUPS)}|(?s:.))"), 1), lambda u: u != "ː")
    out = F.transform(units, lambda u: mapping(T.IPA_GROUPS | T.IPA_SIGNS)[u])
    return let(out, lambda o: F.when(F.exists(o, lambda x: x.isNull()), "").otherwise(F.array_join(o, "")))


def latin_to_gujarati(word: Column) -> Column:
    units = F.regexp_extract_all(F.lower(word), F.lit(f"({'|'.join(T.LATIN_GROUPS)}|(?s:.))"), 1)
    return F.array_join(F.transform(units, lambda u: F.coalesce(mapping(T.LATIN_GROUPS | T.LATIN_LETTERS)[u], u)), "")


def devanagari_to_gujarati(text: Column) -> Column:
    return F.translate(text, T.PARALLEL + T.DROPPED, T.GUJARATI_PARALLEL)


def gujarati_digits(text: Column) -> Column:
    return F.translate(text, "0123456789", T.GUJARATI_DIGITS)


def transliterate(word: Column) -> Column:
    """Gujarati stays; else by way of IPA, in which a change of language makes no mark; else letter by letter from Devanagari or Latin."""
    said = F.trim(join_ipa(F.filter(F.transform(hinglish_tokens(word), token_to_ipa), lambda x: x != "")))
    by_ipa = let(said, lambda ipa: F.when((ipa != "") & ~ipa.contains("?") & ipa.rlike(T.PHONETIC), let(ipa_to_gujarati(ipa), lambda g: F.when(g != "", g))))
    letters = F.when(word.rlike(rf"[{T.DEVANAGARI}]"), devanagari_to_gujarati(word)).otherwise(latin_to_gujarati(word))
    return F.when(word.rlike(rf"[{T.GUJARATI}]"), word).otherwise(F.coalesce(by_ipa, letters))


def join_tokens(parts: Column) -> Column:
    text = F.regexp_replace(F.array_join(parts, " "), r"\s+([,.;:!?])", "$1")
    text = F.regexp_replace(F.regexp_replace(text, r"\(\s+", "("), r"\s+\)", ")")
    return F.trim(F.regexp_replace(text, r"\s{2,}", " "))


def script_counts(text: Column) -> Column:
    count = lambda cls: F.length(F.regexp_replace(text, f"[^{cls}]", ""))
    return F.struct(count(T.GUJARATI).alias("gujarati"), count(T.DEVANAGARI).alias("devanagari"), count("A-Za-z").alias("latin"))


def dominant_script(text: Column) -> Column:
    """Ties go to Gujarati, then Devanagari; unknown without any."""
    n = script_counts(text)
    most = F.greatest(n["gujarati"], n["devanagari"], n["latin"])
    return F.when(most == 0, "unknown").when(n["gujarati"] == most, "gujarati").when(n["devanagari"] == most, "devanagari").otherwise("latin")


def speakable(text: Column) -> Column:
    """Whether a chunk has a Latin letter, an ASCII digit or Devanagari; Gujarati alone doesn't count."""
    return text.rlike(rf"[A-Za-z0-9{T.DEVANAGARI}]")


def speech_model(text: Column, language: Column | None = None, default: str = "en", override: str | None = None) -> Column:
    if override:
        return F.lit(override)
    script = dominant_script(text)
    code = F.lower(F.coalesce(language if language is not None else F.lit(None).cast("string"), F.lit(default)))
    by_code = F.coalesce(mapping(T.TTS_MODELS)[code], F.lit("eng"))
    return F.when(script == "gujarati", "guj").when(script == "devanagari", "hin").otherwise(by_code)


def speech_chunks(text: Column, most: int = 220) -> Column:
    """Sentences packed to `most` characters; a longer sentence by words; a longer word stays whole."""
    clean = F.trim(F.regexp_replace(text, r"\s+", " "))
    marked = F.regexp_replace(clean, r"([.!?;:])\s+", "$1\n")
    # units: words with a flag for the first one of a sentence; whole sentences that fit stand as one unit
    units = F.flatten(F.transform(F.filter(F.split(marked, "\n"), lambda s: s != ""), lambda s: F.when(F.length(s) <= most, F.array(F.struct(s.alias("t"), F.lit(0).alias("k")))).otherwise(
        F.transform(F.split(s, " "), lambda w, i: F.struct(w.alias("t"), F.when(i == 0, 1).otherwise(2).alias("k"))))))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("now"), F.lit(False).alias("long"))

    def step(acc: Column, u: Column) -> Column:
        # a long sentence begins and ends a chunk
        cut = (u["k"] == 1) | ((u["k"] == 0) & acc["long"])
        joined = F.when(acc["now"] == "", u["t"]).otherwise(F.concat_ws(" ", acc["now"], u["t"]))
        fits = ~cut & (F.length(joined) <= most)
        flush = ~fits & (acc["now"] != "")
        return F.struct(
            F.when(flush, F.concat(acc["done"], F.array(acc["now"]))).otherwise(acc["done"]).alias("done"), F.when(fits, joined).otherwise(u["t"]).alias("now"), (u["k"] != 0).alias("long")
        )

    packed = F.aggregate(units, start, step, lambda a: F.when(a["now"] != "", F.concat(a["done"], F.array(a["now"]))).otherwise(a["done"]))
    good = F.filter(F.transform(packed, lambda s: F.trim(s)), speakable)
    whole = F.when(speakable(clean), F.array(clean)).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(clean) <= most, whole).when(F.size(good) > 0, good).otherwise(whole)
