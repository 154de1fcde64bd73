"""Script ranges, letter-to-sound tables and word lists that results depend on."""

# Token patterns, in a form that Java and RE2 both accept.
DEVANAGARI = r"\x{0900}-\x{097F}"
GUJARATI = r"\x{0A80}-\x{0AFF}"
TOKEN = rf"[{DEVANAGARI}]+|[A-Za-z]+(?:'[A-Za-z]+)?|\p{{Nd}}+|[^\p{{L}}\p{{N}}_\p{{Z}}\s]"
TOKEN_GUJARATI = rf"[{DEVANAGARI}]+|[{GUJARATI}]+|[A-Za-z]+(?:'[A-Za-z]+)?|\p{{Nd}}+|[^\p{{L}}\p{{N}}_\p{{Z}}\s]"
SENTENCE_END = r"[.\n\x{0964}]+"

# Devanagari independent vowels.
VOWELS = {"अ": "ə", "आ": "aː", "इ": "ɪ", "ई": "iː", "उ": "ʊ", "ऊ": "uː", "ऋ": "rɪ", "ए": "eː", "ऐ": "ɛː", "ओ": "oː", "औ": "ɔː", "ऑ": "ɔ"}
# Devanagari vowel signs.
SIGNS = {"ा": "aː", "ि": "ɪ", "ी": "iː", "ु": "ʊ", "ू": "uː", "ृ": "rɪ", "े": "eː", "ै": "ɛː", "ो": "oː", "ौ": "ɔː", "ॉ": "ɔ", "ॅ": "æ"}
# Devanagari consonants without their inherent vowel. The two flaps are spelt with two code points and so never match one letter.
CONSONANTS = {
    "क": "k", "ख": "kʰ", "ग": "ɡ", "घ": "ɡʱ", "ङ": "ŋ", "च": "tʃ", "छ": "tʃʰ", "ज": "dʒ", "झ": "dʒʱ", "ञ": "ɲ",
    "ट": "ʈ", "ठ": "ʈʰ", "ड": "ɖ", "ढ": "ɖʱ", "ण": "ɳ", "त": "t̪", "थ": "t̪ʰ", "द": "d̪", "ध": "d̪ʱ", "न": "n",
    "प": "p", "फ": "pʰ", "ब": "b", "भ": "bʱ", "म": "m", "य": "j", "र": "r", "ल": "l", "व": "ʋ", "श": "ʃ", "ष": "ʂ", "स": "s", "ह": "ɦ",
    "ऴ": "ɭ", "क़": "q", "ख़": "x", "ग़": "ɣ", "ज़": "z", "फ़": "f", "ऱ": "ɾ",
}
# Devanagari marks.
MARKS = {"ं": "̃", "ँ": "̃", "ः": "h", "ऽ": ""}
VIRAMA = "्"

# ARPABET phones.
ARPABET = {
    "AA": "ɑ", "AE": "æ", "AH": "ʌ", "AO": "ɔ", "AW": "aʊ", "AY": "aɪ", "B": "b", "CH": "tʃ", "D": "d", "DH": "ð", "EH": "ɛ", "ER": "ɝ", "EY": "eɪ",
    "F": "f", "G": "ɡ", "HH": "h", "IH": "ɪ", "IY": "i", "JH": "dʒ", "K": "k", "L": "l", "M": "m", "N": "n", "NG": "ŋ", "OW": "oʊ", "OY": "ɔɪ",
    "P": "p", "R": "ɹ", "S": "s", "SH": "ʃ", "T": "t", "TH": "θ", "UH": "ʊ", "UW": "u", "V": "v", "W": "w", "Y": "j", "Z": "z", "ZH": "ʒ",
}
# English letter groups, first match wins.
ENGLISH_GROUPS = {
    "tion": "ʃən", "sion": "ʒən", "ough": "oʊ", "eigh": "eɪ", "igh": "aɪ", "dge": "dʒ", "tch": "tʃ", "ch": "tʃ", "sh": "ʃ", "ph": "f", "th": "θ", "dh": "ð", "ng": "ŋ",
    "qu": "kw", "ck": "k", "wh": "w", "oo": "uː", "ee": "iː", "ea": "iː", "ai": "eɪ", "ay": "eɪ", "oa": "oʊ", "ow": "aʊ", "oi": "ɔɪ", "oy": "ɔɪ", "au": "ɔː", "ou": "aʊ",
}
# English single letters.
ENGLISH_LETTERS = {
    "a": "æ", "b": "b", "c": "k", "d": "d", "e": "ɛ", "f": "f", "g": "ɡ", "h": "h", "i": "ɪ", "j": "dʒ", "k": "k", "l": "l", "m": "m",
    "n": "n", "o": "ɒ", "p": "p", "q": "k", "r": "ɹ", "s": "s", "t": "t", "u": "ʌ", "v": "v", "w": "w", "x": "ks", "y": "j", "z": "z",
}
# Romanised Hindi words.
LOANWORDS = {
    "acha": "ətʃʰaː", "achha": "ətʃʰaː", "arey": "əreː", "arre": "əreː", "aur": "ɔːr", "bhai": "bʱaːi", "chai": "tʃaːi", "chalo": "tʃəloː", "didi": "diːdiː",
    "dost": "d̪oːst̪", "guru": "ɡʊruː", "hai": "ɦɛː", "haan": "ɦaː̃", "jaldi": "dʒəldiː", "kaise": "kɛːseː", "kya": "kjaː", "namaste": "nəməsteː", "namaskar": "nəməskɑːr",
    "nahi": "nəɦiː", "nahin": "nəɦĩː", "paani": "paːniː", "sahi": "səɦiː", "shukriya": "ʃʊkrɪjaː", "yaar": "jaːr",
}
# Words with a pronunciation of their own.
OVERRIDES = {"ios": "aɪoʊɛs", "wifi": "waɪfaɪ", "youtube": "juːtjuːb", "google": "ɡuːɡəl", "openai": "oʊpənaɪ", "whatsapp": "wɒtsæp"}
# The small pronouncing dictionary.
PRONUNCIATIONS = {
    "hello": ("HH", "AH0", "L", "OW1"), "language": ("L", "AE1", "NG", "G", "W", "IH0", "JH"), "model": ("M", "AA1", "D", "AH0", "L"),
    "speech": ("S", "P", "IY1", "CH"), "test": ("T", "EH1", "S", "T"), "world": ("W", "ER1", "L", "D"),
}
# What makes a Latin word look Hindi.
HINDI_HINTS = ("aa", "ai", "bh", "dh", "gh", "jh", "kh", "ph", "th", "ya")

# Latin letter groups in Gujarati script, first match wins.
LATIN_GROUPS = {
    "ksh": "ક્ષ", "gny": "જ્ઞ", "chh": "છ", "sh": "શ", "kh": "ખ", "gh": "ઘ", "ch": "ચ", "jh": "ઝ", "th": "થ", "dh": "ધ", "ph": "ફ", "bh": "ભ",
    "aa": "આ", "ee": "ઈ", "ii": "ઈ", "oo": "ઊ", "uu": "ઊ", "ai": "ઐ", "au": "ઔ",
}
# Latin letters in Gujarati script.
LATIN_LETTERS = {
    "a": "અ", "b": "બ", "c": "ક", "d": "દ", "e": "એ", "f": "ફ", "g": "ગ", "h": "હ", "i": "ઇ", "j": "જ", "k": "ક", "l": "લ", "m": "મ",
    "n": "ન", "o": "ઓ", "p": "પ", "q": "ક", "r": "ર", "s": "સ", "t": "ત", "u": "ઉ", "v": "વ", "w": "વ", "x": "ક્સ", "y": "ય", "z": "ઝ",
}
# Groups of IPA signs in Gujarati script, first match wins.
IPA_GROUPS = {
    "tʃʰ": "છ", "dʒʱ": "ઝ", "tʃ": "ચ", "dʒ": "જ", "kʰ": "ખ", "ɡʱ": "ઘ", "t̪ʰ": "થ", "d̪ʱ": "ધ", "t̪": "ત", "d̪": "દ", "ʈʰ": "ઠ", "ɖʱ": "ઢ", "ʈ": "ટ", "ɖ": "ડ", "pʰ": "ફ", "bʱ": "ભ",
    "aɪ": "આઇ", "aʊ": "આઉ", "eɪ": "એઇ", "oʊ": "ઓ", "ɔɪ": "ઓઇ", "aː": "આ", "iː": "ઈ", "uː": "ઊ", "eː": "એ", "ɛː": "એ", "oː": "ઓ", "ɔː": "ઓ", "rɪ": "રિ", "ks": "ક્સ",
}
# IPA signs in Gujarati script; the length sign alone is silent.
IPA_SIGNS = {
    "ɑ": "આ", "æ": "એ", "ə": "અ", "ʌ": "અ", "ɒ": "ઓ", "ɔ": "ઓ", "ɛ": "એ", "ɪ": "ઇ", "i": "ઈ", "ʊ": "ઉ", "u": "ઊ", "b": "બ", "d": "દ", "ð": "ધ", "f": "ફ", "ɡ": "ગ", "h": "હ", "j": "ય", "k": "ક",
    "l": "લ", "m": "મ", "n": "ન", "ŋ": "ઙ", "ɲ": "ઞ", "ɳ": "ણ", "p": "પ", "ɹ": "ર", "r": "ર", "ɾ": "ર", "ɽ": "ડ", "s": "સ", "ʃ": "શ", "ʂ": "ષ", "t": "ટ", "θ": "થ", "ʋ": "વ", "v": "વ", "w": "વ",
    "x": "ખ", "ɣ": "ગ", "z": "ઝ", "ʒ": "ઝ", "ɦ": "હ", "̃": "ં",
}
PHONETIC = r"[A-Za-zəɑæɔɛɪʊʌʃʒʰʱŋɲɳɽɦ\x{0303}ːɡʋɹɾθð]"

#: Devanagari letters with a Gujarati counterpart: it stands 0x180 further on. Nukta and avagraha are dropped.
PARALLEL = "अआइईउऊऋएऐओऔ" + "".join(chr(c) for c in range(0x0915, 0x0929)) + "पफबभमयरलवशषसहळ" + "ािीुूृेैोौंँः्" + "०१२३४५६७८९"
DROPPED = "़ऽ"
GUJARATI_PARALLEL = "".join(chr(ord(c) + 0x180) for c in PARALLEL)
GUJARATI_DIGITS = "".join(chr(0x0AE6 + k) for k in range(10))

# Speech models by language code.
TTS_MODELS = {"en": "eng", "eng": "eng", "hi": "hin", "hin": "hin", "gu": "guj", "guj": "guj"}

#: A few entries of a lexicon, made up as a sample; whole lexicons come as tables (operators.translate.lexicon).
SAMPLE_LEXICON = {"the": "તે", "and": "અને", "of": "નું", "to": "ને", "is": "છે", "in": "માં", "it": "તે", "for": "માટે", "on": "પર", "with": "સાથે", "hello": "નમસ્તે", "le": "લે", "de": "દે", "der": "દેર"}

# Recogniser codes by segment label.
RECOGNISER_CODES = {"hi": "hi", "en": "en", "sil": "en"}

# Codes of the language classes, in the order of their indices.
CLASS_CODES = [
    "ab", "af", "am", "ar", "as", "az", "ba", "be", "bg", "bn", "bo", "br", "bs", "ca", "ceb", "cs", "cy", "da", "de", "el", "en", "eo", "es", "et",
    "eu", "fa", "fi", "fo", "fr", "gl", "gn", "gu", "ha", "haw", "hi", "ht", "hu", "hy", "ia", "id", "is", "it", "iw", "ja", "jw", "ka", "kk", "km",
    "kn", "ko", "la", "lb", "ln", "lo", "lt", "lv", "mg", "mi", "mk", "ml", "mn", "mr", "ms", "mt", "my", "ne", "nl", "nn", "no", "oc", "pa", "pl",
    "ps", "pt", "ro", "ru", "sa", "si", "sk", "sl", "sn", "so", "sq", "sr", "su", "sv", "sw", "ta", "te", "tg", "th", "tk", "tl", "tr", "tt", "uk",
    "ur", "uz", "vi", "vo", "war", "yi", "yo", "zh",
]
