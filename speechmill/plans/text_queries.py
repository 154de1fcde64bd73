"""Queries of tokens, letter-to-sound, translation, chunking, and n-gram language models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T
from ..functions import text as X
from ..operators import lm, pronounce, translate
from ..shared import new_path, written
from . import text_sql as Q
from .registry import query, rounded, table

_TURN = ("conv_id", "turn")


def turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(*_TURN, "text")


def _each(name: str, make, sql: str | None, source: str = "conversations", spread: bool = False) -> None:
    """A query that gives one value for each turn of a conversation. spread: values take long, so turns are dealt over as many tasks as the session has shuffle partitions."""

    @query(name, sql and f"SELECT conv_id, turn, {sql} AS y FROM {source}")
    def run(spark, sf_dir):
        rows = turns(spark, sf_dir)
        rows = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *_TURN) if spread else rows
        return rows.select(*_TURN, make(F.col("text")).alias("y"))


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


def _sql_map(entries: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{_re(k)}': '{_re(v)}'" for k, v in entries.items()) + "}"


_joined = lambda c: F.array_join(c, "|")
_TOK = f"regexp_extract_all(text, '{_re(T.TOKEN)}')"
_each("x1_tokens", lambda t: _joined(X.hinglish_tokens(t)), f"array_to_string({_TOK}, '|')")
_each("x2_tokens_with_gujarati", lambda t: _joined(X.hinglish_tokens(F.concat(t, F.lit(" નમસ્તે 12")), True)), f"array_to_string(regexp_extract_all(text || ' નમસ્તે 12', '{_re(T.TOKEN_GUJARATI)}'), '|')")


def _lm(value: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({value}), '[^{T.DEVANAGARI}a-z0-9''\-]', ' ', 'g'), '\s+'), lambda w: w <> '')"


_each("x3_lm_tokens", lambda t: _joined(X.lm_tokens(t)), f"array_to_string({_lm('text')}, '|')")
_SENT = rf"list_filter(list_transform(regexp_split_to_array(text, '{T.SENTENCE_END}'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"
_each("x4_sentences", lambda t: _joined(X.sentences(t)), f"array_to_string({_SENT}, '|')")
_KIND = rf"CASE WHEN regexp_matches(w, '[{T.DEVANAGARI}]') THEN 'hi' WHEN regexp_matches(w, '[A-Za-z]') THEN 'latin' WHEN regexp_full_match(w, '\p{{Nd}}+') THEN 'digit' ELSE 'other' END"
_each("x5_token_kinds", lambda t: _joined(F.transform(X.hinglish_tokens(t), X.token_kind)), f"array_to_string(list_transform({_TOK}, lambda w: {_KIND}), '|')")
_each("x6_script_runs", lambda t: _joined(X.script_runs(F.concat(t, F.lit("कab12"))),), f"array_to_string(regexp_extract_all(text || 'कab12', '[{T.DEVANAGARI}]+|[A-Za-z]+|[^A-Za-z{T.DEVANAGARI}]+'), '|')")
_in = lambda words: ", ".join(f"'{w}'" for w in words)
_LATIN = f"CASE WHEN lower(w) IN ({_in(T.LOANWORDS)}) THEN 'hi' WHEN lower(w) IN ({_in([*T.OVERRIDES, *T.PRONUNCIATIONS])}) THEN 'en' WHEN regexp_matches(lower(w), '{'|'.join(T.HINDI_HINTS)}') AND regexp_matches(lower(w), '[aeiou]$') THEN 'hi' ELSE 'en' END"
_each("x7_latin_language", lambda t: _joined(F.transform(F.filter(X.hinglish_tokens(t), lambda w: X.token_kind(w) == "latin"), X.latin_language)), f"array_to_string(list_transform(list_filter({_TOK}, lambda w: {_KIND} = 'latin'), lambda w: {_LATIN}), '|')")


#: Romanised words as Devanagari letters, so that the tables have Hindi text: each ASCII letter becomes the one at its place.
_ROMAN = "abcdefghijklmnopqrstuvwxyz"
_NAGARI = "अबचदएफगहिजकलमनोपकरसतुववखयज"


def nagari(text: Column) -> Column:
    return F.translate(F.lower(text), _ROMAN, _NAGARI)


_NAGARI_SQL = f"translate(lower(text), '{_ROMAN}', '{_NAGARI}')"
_each("x8_hindi_to_ipa", lambda t: X.hindi_to_ipa(nagari(t)), Q.hindi_to_ipa(_NAGARI_SQL))
_each("x9_hindi_rules", lambda t: X.hindi_rules(F.regexp_replace(t, "e", "ə")), Q.hindi_rules("replace(text, 'e', 'ə')"))
_each("x10_english_to_ipa", lambda t: F.array_join(F.transform(X.lm_tokens(t), X.english_to_ipa), " "), Q.joined(f"list_transform({_lm('text')}, lambda w: {Q.english_to_ipa('w')})", " "))
_each("x11_squash", lambda t: X.squash(F.regexp_replace(F.lower(t), "[aeiou]", "aa")), Q.squash("regexp_replace(lower(text), '[aeiou]', 'aa', 'g')"))
_each("x12_arpabet", lambda t: X.arpabet_to_ipa(F.transform(F.filter(X.lm_tokens(t), lambda w: F.length(w) <= 2), lambda w: F.concat(F.upper(w), F.lit("1")))),
      f"array_to_string(list_transform(list_filter({_lm('text')}, lambda w: length(w) <= 2), lambda w: coalesce({_sql_map(T.ARPABET)}[regexp_replace(upper(w) || '1', '[0-9]', '', 'g')], '?')), '')")
_TIGHT = r"trim(regexp_replace(regexp_replace(regexp_replace({}, '\s+([,.;:!?])', '\1', 'g'), '\s+\|\s+', ' | ', 'g'), '\s{{2,}}', ' ', 'g'))"
_each("x13_join_ipa", lambda t: X.join_ipa(X.hinglish_tokens(t)), _TIGHT.format(f"array_to_string({_TOK}, ' ')"))
_each("x14_text_to_ipa", X.text_to_ipa, Q.text_to_ipa("text"))
_each("x16_translate", lambda t: translate.translated(t, T.SAMPLE_LEXICON), Q.translated("text", T.SAMPLE_LEXICON), spread=True)
_each("x17_transliterate", lambda t: F.array_join(F.transform(X.lm_tokens(t), X.transliterate), " "), Q.joined(f"list_transform({_lm('text')}, lambda w: {Q.transliterate('w')})", " "), spread=True)
_each("x19_ipa_to_gujarati", lambda t: F.array_join(F.transform(X.hinglish_tokens(t), lambda w: X.ipa_to_gujarati(X.text_to_ipa(w, " "))), ""), Q.joined(f"list_transform({_TOK}, lambda w: {Q.ipa_to_gujarati(Q.text_to_ipa('w', ' '))})"))
_each("x20_latin_to_gujarati", lambda t: F.array_join(F.transform(X.lm_tokens(t), X.latin_to_gujarati), " "), Q.joined(f"list_transform({_lm('text')}, lambda w: {Q.latin_to_gujarati('w')})", " "))
_drop = "".join(T.DROPPED)
_each("x21_devanagari_to_gujarati", lambda t: X.devanagari_to_gujarati(nagari(t)), Q.devanagari_to_gujarati(_NAGARI_SQL))
_each("x22_gujarati_digits", lambda t: X.gujarati_digits(F.concat(t, F.lit(" 0123456789"))), f"translate(text || ' 0123456789', '0123456789', '{T.GUJARATI_DIGITS}')")
_JOIN = rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(array_to_string({_TOK}, ' '), '\s+([,.;:!?])', '\1', 'g'), '\(\s+', '(', 'g'), '\s+\)', ')', 'g'), '\s{{2,}}', ' ', 'g'))"
_each("x23_join_tokens", lambda t: X.join_tokens(X.hinglish_tokens(t)), _JOIN)
_each("x25_speech_chunks", lambda t: _joined(X.speech_chunks(t)), Q.speech_chunks("text"))
_each("x26_speakable", X.speakable, f"regexp_matches(text, '[A-Za-z0-9{T.DEVANAGARI}]')")
_n = lambda cls: f"length(regexp_replace(text, '[^{cls}]', '', 'g'))"
_SCRIPT = f"CASE WHEN greatest({_n(T.GUJARATI)}, {_n(T.DEVANAGARI)}, {_n('A-Za-z')}) = 0 THEN 'unknown' WHEN {_n(T.GUJARATI)} >= greatest({_n(T.DEVANAGARI)}, {_n('A-Za-z')}) THEN 'gujarati' WHEN {_n(T.DEVANAGARI)} >= {_n('A-Za-z')} THEN 'devanagari' ELSE 'latin' END"
_each("r12_dominant_script", X.dominant_script, _SCRIPT)
_each("x27_speech_model", lambda t: X.speech_model(t, F.element_at(F.array(F.lit("hi"), F.lit("xx"), F.lit(None)), (F.col("turn") % 3 + 1).cast("int"))), f"CASE {_SCRIPT} WHEN 'gujarati' THEN 'guj' WHEN 'devanagari' THEN 'hin' ELSE CASE turn % 3 WHEN 0 THEN 'hin' ELSE 'eng' END END")
_each("a7_language_switches", lambda t: F.size(F.split(X.text_to_ipa(t), r"\|")) - 1, Q.let("ipa", Q.text_to_ipa("text"), "CAST(length(ipa) - length(replace(ipa, '|', '')) AS INTEGER)"))
_each("j3_in_dictionary", lambda t: F.size(F.filter(X.lm_tokens(t), lambda w: w.isin([*T.LOANWORDS, *T.OVERRIDES, *T.PRONUNCIATIONS]))), f"CAST(len(list_filter({_lm('text')}, lambda w: w IN ({_in([*T.LOANWORDS, *T.OVERRIDES, *T.PRONUNCIATIONS])}))) AS INTEGER)")


@query("p11_language_code", "SELECT DISTINCT lang, coalesce(MAP {'hi': 'hi', 'en': 'en', 'sil': 'en'}[lang], 'hi') AS code FROM documents")
def language_code(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang", translate.recogniser_code(F.col("lang")).alias("code")).distinct()


@query("p14_label_index", "WITH l AS (SELECT DISTINCT lang || '-' || source AS label FROM documents), n AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM l) SELECT split_part(trim(lower(label)), '-', 1) AS code, min(idx) AS idx FROM n GROUP BY code")
def label_index(spark, sf_dir):
    labels = table(spark, sf_dir, "documents").select(F.concat_ws("-", "lang", "source").alias("label")).distinct()
    return translate.class_index(translate.numbered(labels))


_LEX = ", ".join(f"('{_re(k)}', '{v}')" for k, v in T.SAMPLE_LEXICON.items())


@query(
    "j1_lexicon_join",
    rf"WITH lex(word, gu) AS (VALUES {_LEX}), t AS (SELECT conv_id, turn, unnest(range(len(ws))) AS pos, unnest(ws) AS token FROM (SELECT conv_id, turn, {_TOK} AS ws FROM conversations)) SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, token, gu FROM t LEFT JOIN lex ON lower(token) = word",
)
def lexicon_join(spark, sf_dir):
    rows = turns(spark, sf_dir).select(*_TURN, F.posexplode(X.hinglish_tokens(F.col("text"))).alias("pos", "token"))
    return translate.looked_up(rows, translate.lexicon(spark, T.SAMPLE_LEXICON)).select(*_TURN, "pos", "token", F.col("target").alias("gu"))


@query("u2_dictionary_overlay", "WITH d AS (SELECT lower(word) AS word, 1 AS priority, CAST(count(*) AS VARCHAR) AS target FROM (SELECT unnest(string_split(text, ' ')) AS word FROM benchmark) GROUP BY ALL), o AS (SELECT word, 2 AS priority, 'own' AS target FROM d WHERE length(word) = 3) SELECT word, arg_max(target, priority) AS target FROM (SELECT * FROM d UNION ALL SELECT * FROM o) GROUP BY word")
def dictionary_overlay(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("word"))
    base = words.groupBy("word").agg(F.count("*").cast("string").alias("target"))
    return translate.overlaid(base, base.where(F.length("word") == 3).select("word", F.lit("own").alias("target")))


# language models


def sentences(spark, sf_dir) -> DataFrame:
    return lm.sentence_tokens(table(spark, sf_dir, "documents"))


_ROWS = f"""sent AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, {_lm('ss[pos + 1]')} AS tokens FROM (SELECT doc_id, ss, unnest(range(len(ss))) AS pos FROM (SELECT doc_id, {_SENT} AS ss FROM documents))),
lines AS (SELECT * FROM sent WHERE len(tokens) > 0)"""


def _grams(n: int, tokens: str = "tokens") -> str:
    return f"SELECT {n} AS n, ctx, word, count(*) AS cnt FROM (SELECT unnest(list_transform(range(1, len({tokens}) - {n} + 2), lambda i: {{'ctx': array_to_string({tokens}[i:i + {n} - 2], ' '), 'word': {tokens}[i + {n} - 1]}}), recursive := true) FROM lines) GROUP BY ctx, word"


_COUNTS = f"{_ROWS}, grams AS ({' UNION ALL '.join(_grams(n) for n in (1, 2, 3))})"


@query("r1_unigrams", f"WITH {_ROWS} SELECT word, count(*) AS cnt FROM (SELECT unnest(tokens) AS word FROM lines) GROUP BY word")
def unigrams(spark, sf_dir):
    return lm.unigrams(sentences(spark, sf_dir))


@query("r2_ngrams", f"WITH {_COUNTS} SELECT CAST(n AS INTEGER) AS n, ctx, word, cnt FROM grams")
def ngrams(spark, sf_dir):
    return lm.counts(sentences(spark, sf_dir), 3).select("n", "ctx", "word", "cnt")


@query("r3_context_totals", f"WITH {_COUNTS} SELECT CAST(n AS INTEGER) AS n, ctx, CAST(sum(cnt) AS BIGINT) AS total, count(*) AS kinds FROM grams GROUP BY n, ctx")
def context_totals(spark, sf_dir):
    return lm.context_totals_of(lm.blocks(sentences(spark, sf_dir), 3)).select("n", "ctx", "total", "kinds")


_PAD = "(['<s>', '<s>'] || tokens || ['</s>', '</s>'])"


@query("r4_padded_ngrams", f"WITH {_ROWS} {' UNION ALL '.join(_grams(n, _PAD) for n in (1, 2, 3))}")
def padded_ngrams(spark, sf_dir):
    return lm.counts(sentences(spark, sf_dir), 3, True).select("n", "ctx", "word", "cnt")


@query("k1_top_words", f"WITH {_ROWS} SELECT word, count(*) AS cnt FROM (SELECT doc_id, pos, unnest(range(len(tokens))) AS place, unnest(tokens) AS word FROM lines) GROUP BY word ORDER BY cnt DESC, min({{'a': doc_id, 'b': pos, 'c': place}}) LIMIT 50")
def top_words(spark, sf_dir):
    return lm.top_words(sentences(spark, sf_dir), 50)


_ASKED = "asked AS (SELECT conv_id AS doc_id, CAST(pos AS INTEGER) AS pos, place, tokens[place + 1] AS word, array_to_string(tokens[greatest(place - 1, 1):place], ' ') AS ctx FROM (SELECT conv_id, pos, tokens, unnest(range(len(tokens))) AS place FROM (SELECT conv_id, pos, {lm} AS tokens FROM (SELECT conv_id, turn * 1000 + pos AS pos, ss[pos + 1] AS s FROM (SELECT conv_id, turn, ss, unnest(range(len(ss))) AS pos FROM (SELECT conv_id, turn, {sent} AS ss FROM conversations))))))".format(lm=_lm("s"), sent=_SENT)


def asked(spark, sf_dir) -> DataFrame:
    rows = turns(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), "turn", F.posexplode(X.sentences(F.col("text"))).alias("pos", "s"))
    rows = rows.select("doc_id", (F.col("turn") * 1000 + F.col("pos")).cast("int").alias("pos"), X.lm_tokens(F.col("s")).alias("tokens")).where(F.size("tokens") > 0)
    return lm.queries_of(rows, 3)


def counted(spark, sf_dir) -> lm.Blocks:
    """Counts of the documents' n-grams, made where they are read."""
    return lm.blocks(sentences(spark, sf_dir), 3)


@query("j11_m14_laplace", f"WITH {_COUNTS}, {_ASKED}, t AS (SELECT ctx, sum(cnt) AS total FROM grams GROUP BY ctx), v AS (SELECT count(*) AS kinds FROM grams WHERE n = 1) SELECT a.doc_id, a.pos, CAST(place AS INTEGER) AS place, round(ln((coalesce(cnt, 0) + 1) / (coalesce(total, 0) + kinds)), 6) AS logp FROM asked a LEFT JOIN grams g ON a.ctx = g.ctx AND a.word = g.word LEFT JOIN t ON a.ctx = t.ctx CROSS JOIN v")
def laplace(spark, sf_dir):
    grams = counted(spark, sf_dir)
    return lm.laplace(asked(spark, sf_dir), grams).select("doc_id", "pos", "place", rounded("logp").alias("logp"))


_PADDED = f"{_ROWS}, grams AS ({' UNION ALL '.join(_grams(n, _PAD) for n in (1, 2, 3))})"


def padded(spark, sf_dir) -> lm.Blocks:
    return lm.blocks(sentences(spark, sf_dir), 3, True)


@query("m15_maximum_likelihood", f"WITH {_PADDED}, {_ASKED}, t AS (SELECT ctx, sum(cnt) AS total FROM grams GROUP BY ctx) SELECT a.doc_id, a.pos, CAST(place AS INTEGER) AS place, round(ln(greatest(coalesce(cnt / total, 0), 1e-12)), 6) AS logp FROM asked a LEFT JOIN grams g ON a.ctx = g.ctx AND a.word = g.word LEFT JOIN t ON a.ctx = t.ctx")
def maximum_likelihood(spark, sf_dir):
    return lm.maximum_likelihood(asked(spark, sf_dir), padded(spark, sf_dir)).select("doc_id", "pos", "place", rounded("logp").alias("logp"))


@query("m15_add_one", f"WITH {_PADDED}, {_ASKED}, t AS (SELECT ctx, sum(cnt) AS total FROM grams GROUP BY ctx), v AS (SELECT count(*) + 1 AS kinds FROM grams WHERE n = 1) SELECT a.doc_id, a.pos, CAST(place AS INTEGER) AS place, round(ln((coalesce(cnt, 0) + 1) / (coalesce(total, 0) + kinds)), 6) AS logp FROM asked a LEFT JOIN grams g ON a.ctx = g.ctx AND a.word = g.word LEFT JOIN t ON a.ctx = t.ctx CROSS JOIN v")
def add_one(spark, sf_dir):
    return lm.add_one(asked(spark, sf_dir), padded(spark, sf_dir)).select("doc_id", "pos", "place", rounded("logp").alias("logp"))


@query("r6_perplexity", f"WITH {_COUNTS}, {_ASKED}, t AS (SELECT ctx, sum(cnt) AS total FROM grams GROUP BY ctx), v AS (SELECT count(*) AS kinds FROM grams WHERE n = 1) SELECT round(exp(-avg(ln((coalesce(cnt, 0) + 1) / (coalesce(total, 0) + kinds)))), 4) AS perplexity, count(*) AS n_words FROM asked a LEFT JOIN grams g ON a.ctx = g.ctx AND a.word = g.word LEFT JOIN t ON a.ctx = t.ctx CROSS JOIN v")
def perplexity(spark, sf_dir):
    grams = counted(spark, sf_dir)
    return lm.perplexity(lm.laplace(asked(spark, sf_dir), grams)).select(F.round("perplexity", 4).alias("perplexity"), "n_words")


@query(
    "m15_kneser_ney",
    f"""WITH {_PADDED}, {_ASKED}, share AS (SELECT word, count(*) / (SELECT count(*)::DOUBLE FROM grams WHERE n = 2) AS p FROM grams WHERE n = 2 GROUP BY word),
c2 AS (SELECT split_part(ctx, ' ', 2) AS ctx, word, count(*) AS c FROM grams WHERE n = 3 GROUP BY ALL), h2 AS (SELECT ctx, total, kinds FROM (SELECT ctx, sum(c) AS total FROM c2 GROUP BY ctx) JOIN (SELECT ctx, count(*) AS kinds FROM grams WHERE n = 2 GROUP BY ctx) USING (ctx)),
h3 AS (SELECT ctx, sum(cnt) AS total, count(*) AS kinds FROM grams WHERE n = 3 GROUP BY ctx),
one AS (SELECT a.*, string_split(ctx, ' ') AS cs, coalesce(p, 0) AS p1 FROM asked a LEFT JOIN share USING (word)),
two AS (SELECT o.*, CASE WHEN h.ctx IS NULL THEN p1 ELSE greatest(coalesce(c, 0) - 0.1::DOUBLE, 0) / total + 0.1::DOUBLE * kinds / total * p1 END AS p2 FROM one o LEFT JOIN h2 h ON o.ctx <> '' AND h.ctx = cs[-1] LEFT JOIN c2 ON c2.ctx = cs[-1] AND c2.word = o.word),
three AS (SELECT t.*, CASE WHEN h.ctx IS NULL THEN p2 ELSE greatest(coalesce(cnt, 0) - 0.1::DOUBLE, 0) / total + 0.1::DOUBLE * kinds / total * p2 END AS p3 FROM two t LEFT JOIN h3 h ON h.ctx = t.ctx LEFT JOIN grams g ON g.n = 3 AND g.ctx = t.ctx AND g.word = t.word)
SELECT doc_id, pos, CAST(place AS INTEGER) AS place, round(ln(greatest(p3, 1e-12)), 6) AS logp FROM three""",
)
def kneser_ney(spark, sf_dir):
    """Each word of the turns after the two words before it, by a model of the documents."""
    return lm.kneser_ney_of(asked(spark, sf_dir), sentences(spark, sf_dir)).select("doc_id", "pos", "place", rounded("logp").alias("logp"))


_VOCAB = "vocab AS (SELECT item_id * 1000 + pos AS token_id, ws[pos + 1] AS token FROM (SELECT item_id, ws, unnest(range(len(ws))) AS pos FROM (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark)))"


@query("j9_m17_token_bias", f"WITH {_COUNTS}, {_VOCAB}, a AS (SELECT token_id, regexp_split_to_array(trim(lower(token)), '\\s+')[1] AS word FROM vocab WHERE trim(token) <> '' AND trim(token) NOT LIKE '<%'), u AS (SELECT word, cnt FROM grams WHERE n = 1), v AS (SELECT sum(cnt) AS total, count(*) AS kinds FROM u) SELECT token_id, word, round(greatest(ln((cnt + 1) / (total + kinds)), -10) * 1.5::DOUBLE, 6) AS bias FROM a JOIN u USING (word) CROSS JOIN v")
def token_bias(spark, sf_dir):
    vocab = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "token")).select((F.col("item_id") * 1000 + F.col("pos")).alias("token_id"), "token")
    return lm.token_bias(vocab, written(lm.counts(sentences(spark, sf_dir), 1), "word-counts")).select("token_id", "word", rounded("bias").alias("bias"))


_NEXT = "cand AS (SELECT item_id AS hyp_id, item_id * 1000 + pos AS token_id, lower(ws[pos + 1]) AS word, {lm} AS ctx FROM (SELECT item_id, ws, pos, array_to_string(ws[greatest(pos - 1, 1):pos], ' ') AS before FROM (SELECT item_id, ws, unnest(range(len(ws))) AS pos FROM (SELECT item_id, string_split(text, ' ') AS ws FROM benchmark))))".replace("{lm}", _lm("before"))


@query(
    "m18_contextual_bias",
    f"WITH {_COUNTS}, {_NEXT}, u AS (SELECT word, cnt FROM grams WHERE n = 1), v AS (SELECT sum(cnt) AS total, count(*) AS kinds FROM u), t AS (SELECT ctx, sum(cnt) AS total FROM grams GROUP BY ctx), c AS (SELECT *, array_to_string(ctx[-2:], ' ') AS last FROM cand) "
    "SELECT hyp_id, token_id, round(CASE WHEN u.word IS NULL THEN 0 ELSE 1.5::DOUBLE * greatest(-10, CASE WHEN len(c.ctx) = 0 THEN ln((u.cnt + 1) / (v.total + kinds)) ELSE ln((coalesce(g.cnt, 0) + 1) / (coalesce(t.total, 0) + kinds)) END) END, 6) + 0.0::DOUBLE AS logit "
    "FROM c CROSS JOIN v LEFT JOIN u ON u.word = c.word LEFT JOIN grams g ON g.ctx = c.last AND g.word = c.word AND g.n > 1 LEFT JOIN t ON t.ctx = c.last",
)
def contextual_bias(spark, sf_dir):
    """Each word of the benchmark as a candidate after its two predecessors."""
    words = F.split("text", " ")
    rows = table(spark, sf_dir, "benchmark").select("item_id", words.alias("ws"), F.posexplode(words).alias("pos", "token"))
    logits = rows.select(F.col("item_id").alias("hyp_id"), (F.col("item_id") * 1000 + F.col("pos")).alias("token_id"), F.lit(0.0).alias("logit"), X.lm_tokens(F.array_join(F.slice("ws", F.greatest(F.lit(1), F.col("pos") - 1), F.least(F.lit(2), F.col("pos"))), " ")).alias("ctx"), "token")
    known = written(lm.counts(sentences(spark, sf_dir), 1), "word-counts")
    bias = lm.token_bias(logits.select("token_id", "token"), known)
    return lm.contextual_bias(logits, bias, counted(spark, sf_dir), words=known).select("hyp_id", "token_id", rounded("logit").alias("logit"))


#: Letters as phones: each letter of a word becomes the phone at its place.
_PHONES = list(T.ARPABET)[:26]
_WORDS = "w AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark))"
_PHONED = f"(list_transform(regexp_extract_all(word, '.'), lambda lt: {_sql_map(dict(zip(_ROMAN, _PHONES, strict=True)))}[lt] || '1'))"
_SAID = f"(array_to_string(list_transform(regexp_extract_all(word, '.'), lambda lt: {_sql_map({c: T.ARPABET[p] for c, p in zip(_ROMAN, _PHONES, strict=True)})}[lt]), ''))"


def pronunciations(spark, sf_dir) -> DataFrame:
    """A pronouncing dictionary, written as a file and read again: words of the benchmark, each with a second pronunciation that doesn't count."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("word")).distinct()
    phones = F.transform(F.regexp_extract_all("word", F.lit("(.)"), 1), lambda c: F.concat(X.mapping(dict(zip(_ROMAN, _PHONES, strict=True)))[c], F.lit("1")))
    first = words.select(F.concat_ws("  ", F.upper("word"), F.array_join(phones, " ")).alias("value"))
    second = words.select(F.concat(F.upper("word"), F.lit("(2)  ZH0 # not this one")).alias("value"))
    path = new_path(spark, "pronunciations")
    second.unionByName(first).union(spark.createDataFrame([(";;; a comment",)], "value string")).write.text(path)
    return pronounce.read_pronunciations(spark, path)


@query("x15_pronunciations", f"WITH {_WORDS} SELECT word, array_to_string({_PHONED}, ' ') AS phones FROM w")
def read_pronunciations(spark, sf_dir):
    return pronunciations(spark, sf_dir).select("word", F.array_join("phones", " ").alias("phones"))


_ENTRIES = f"""{_WORDS}, every AS (SELECT word, {_SAID} AS ipa, 'en' AS lang, 0 AS priority FROM w UNION ALL SELECT unnest(map_keys(m)), unnest(map_values(m)), 'en', 1 FROM (SELECT {_sql_map(T.OVERRIDES)} AS m)
  UNION ALL SELECT word, 'c' || word, 'en', 2 FROM w WHERE length(word) = 5 UNION ALL SELECT unnest(map_keys(m)), unnest(map_values(m)), 'hi', 3 FROM (SELECT {_sql_map(T.LOANWORDS)} AS m) UNION ALL SELECT word, 'l' || word, 'hi', 4 FROM w WHERE length(word) = 3),
entries AS (SELECT word, arg_max(ipa, (priority, ipa)) AS ipa, arg_max(lang, (priority, ipa)) AS lang FROM every GROUP BY word)"""
_TOKENS = f"tokens AS (SELECT conv_id, turn, t[i] AS token, i FROM (SELECT conv_id, turn, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT conv_id, turn, {_TOK} AS t FROM conversations)))"
_SPOKEN = f"""spoken AS (SELECT token, coalesce(e.ipa, {Q.let('ow', 'token', f"CASE {_KIND.replace('(w', '(ow')} WHEN 'hi' THEN {Q.hindi_to_ipa('ow')} WHEN 'latin' THEN {Q.let('el', 'lower(ow)', Q.english_to_ipa('el'))} ELSE ow END")}) AS ipa,
  coalesce(e.lang, CASE WHEN regexp_matches(token, '[{T.DEVANAGARI}]') THEN 'hi' WHEN regexp_matches(token, '[A-Za-z]') THEN CASE WHEN regexp_matches(lower(token), '{'|'.join(T.HINDI_HINTS)}') AND regexp_matches(lower(token), '[aeiou]$') THEN 'hi' ELSE 'en' END END) AS lang
  FROM (SELECT DISTINCT token FROM tokens) LEFT JOIN entries e ON regexp_matches(token, '[A-Za-z]') AND e.word = lower(token))"""


def entries(spark, sf_dir) -> DataFrame:
    """All dictionaries as one: the file, and words of the benchmark of three letters as loanwords and of five as a custom dictionary."""
    said = pronunciations(spark, sf_dir)
    made = lambda n, first: said.where(F.length("word") == n).select(F.upper("word").alias("word") if n == 5 else "word", F.concat(F.lit(first), "word").alias("ipa"))
    return pronounce.dictionary(spark, made(3, "l"), made(5, "c"), said)


@query("j2_spoken_words", f"WITH {_ENTRIES}, {_TOKENS}, {_SPOKEN} SELECT * FROM spoken")
def spoken_words(spark, sf_dir):
    tokens = turns(spark, sf_dir).select(F.explode(X.hinglish_tokens(F.col("text"))).alias("token"))
    return pronounce.spoken(tokens, entries(spark, sf_dir))


@query(
    "j2_text_to_ipa",
    f"""WITH {_ENTRIES}, {_TOKENS}, {_SPOKEN}, said AS (SELECT conv_id, turn, i, ipa, lang, last_value(lang IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM tokens JOIN spoken USING (token) WHERE ipa <> ''),
texts AS (SELECT conv_id, turn, string_agg(CASE WHEN lang <> before THEN '| ' ELSE '' END || ipa, ' ' ORDER BY i) AS ipa FROM said GROUP BY conv_id, turn)
SELECT c.conv_id, CAST(c.turn AS BIGINT) AS turn, coalesce({_TIGHT.format('ipa')}, '') AS ipa FROM conversations c LEFT JOIN texts USING (conv_id, turn)""",
)
def text_by_dictionary(spark, sf_dir):
    """Whole turns by the dictionaries of j2_spoken_words."""
    docs = turns(spark, sf_dir).select(F.struct("conv_id", "turn").alias("doc_id"), "text")
    found = pronounce.converted(docs, entries(spark, sf_dir))
    return found.select("doc_id.conv_id", "doc_id.turn", "ipa")


@query("x28_translated_texts", f"SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce({Q.translated('text', T.SAMPLE_LEXICON)}, '') AS translation FROM conversations")
def translated_texts(spark, sf_dir):
    """The translation stage: takes texts and what they sound like, and makes use of the texts alone."""
    docs = turns(spark, sf_dir).select(F.struct("conv_id", "turn").alias("utt_id"), F.col("text").alias("full_text"))
    ipa = docs.select("utt_id", F.lit("").alias("ipa"))
    found = translate.translated_texts(docs, ipa, translate.lexicon(spark, T.SAMPLE_LEXICON))
    return found.select("utt_id.conv_id", "utt_id.turn", "translation")
