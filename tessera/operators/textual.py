"""Text functions and corpus-processing jobs over the test tables."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import text as t
from tessera.functions.embedding import embedded
from tessera.registry import query, table

_BLANK = r"[ \t\n\x0B\f\r]+"
_NORM = rf"trim(regexp_replace(translate(@, '‘’`´“”‐‑‒–—', '''''''''\"\"-----'), '{_BLANK}', ' ', 'g'))"
_SEARCH = rf"trim(regexp_replace(regexp_replace(replace(lower(replace(replace(strip_accents({_NORM}), 'đ', 'd'), 'Đ', 'D')), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_\s-]', ' ', 'g'), '{_BLANK}', ' ', 'g'))"
_TERMS = f"list_filter(string_split({_SEARCH}, ' '), lambda w: w <> '')"
_WORDS = rf"list_filter(string_split_regex(@, '{_BLANK}'), lambda w: w <> '')"


def docs(spark, sf):
    return table(spark, sf, "documents")


@query("SELECT doc_id, md5(replace(replace(strip_accents(text), 'đ', 'd'), 'Đ', 'D')) AS h FROM documents")
def fn_strip_accents(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(t.unaccented(F.col("text"))).alias("h"))


@query(f"SELECT doc_id, md5({_SEARCH.replace('@', 'text')}) AS h FROM documents")
def fn_search_text(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(t.search_text(F.col("text"))).alias("h"))


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")
def fn_slug(spark, sf):
    return table(spark, sf, "part").select("p_partkey", t.slug(F.col("p_name")).alias("slug"))


@query(rf"SELECT doc_id, len(regexp_extract_all(text, '{t.TOKEN}'))::BIGINT AS n_tokens FROM documents")
def fn_token_count(spark, sf):
    return docs(spark, sf).select("doc_id", t.token_count(F.col("text")).alias("n_tokens"))


@query(r"""SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text, '([.!?])[ \t\n\f\r]+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s) <> ''))::BIGINT AS n_sentences FROM documents""")
def fn_split_sentences(spark, sf):
    return docs(spark, sf).select("doc_id", F.size(t.sentences(F.col("text"))).cast("long").alias("n_sentences"))


@query("SELECT doc_id, sha256(text) AS content_hash, sha256(array_to_string([doc_id::VARCHAR, lang, source, sha256(text)], chr(10))) AS source_key FROM documents")
def fn_sha256_identity(spark, sf):
    content = F.sha2("text", 256)
    return docs(spark, sf).select("doc_id", content.alias("content_hash"), F.sha2(F.concat_ws("\n", F.col("doc_id").cast("string"), "lang", "source", content), 256).alias("source_key"))


@query(f"""WITH w AS (SELECT doc_id, {_TERMS.replace('@', 'text')} AS ws FROM documents), p AS (SELECT doc_id, unnest(list_zip(ws[:len(ws)-1], ws[2:])) AS b FROM w WHERE len(ws) > 1)
 SELECT doc_id, count(*)::BIGINT AS bigrams, count(DISTINCT b)::BIGINT AS distinct_bigrams FROM p GROUP BY doc_id""")
def win_bigrams(spark, sf):
    words = docs(spark, sf).select("doc_id", t.terms(F.col("text")).alias("ws")).where(F.size("ws") > 1)
    pairs = F.zip_with(F.slice("ws", F.lit(1), F.size("ws") - 1), F.slice("ws", F.lit(2), F.size("ws") - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    return words.select("doc_id", pairs.alias("p")).select("doc_id", F.size("p").cast("long").alias("bigrams"), F.size(F.array_distinct("p")).cast("long").alias("distinct_bigrams"))


@query("""SELECT doc_id, len(list_distinct(string_split(text, chr(10))))::BIGINT AS distinct_lines, string_split(text, chr(10))[1] AS first_line FROM documents""")
def agg_first_seen_distinct(spark, sf):
    lines = F.array_distinct(F.split("text", "\n"))
    return docs(spark, sf).select("doc_id", F.size(lines).cast("long").alias("distinct_lines"), lines[0].alias("first_line"))


@query(f"SELECT doc_id, md5(nfc_normalize({_NORM.replace('@', 'text')})) AS h FROM documents")
def fn_normalize_unicode(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(t.composed(t.normalized(F.col("text")))).alias("h"))


#: Words that tell a language where no letter does; those of the test tables.
# Words in search form that show a language.
VIETNAMESE_HINTS = ("ban", "cach", "che", "con", "cung", "da", "de", "di", "giu", "lam", "ma", "mon", "mu", "nhan", "nhiet", "noi", "o", "vat")
ENGLISH_HINTS = ("armor", "character", "craft", "food", "helmet", "how", "item", "recipe", "stone", "the", "weapon")
_TONES = "\u0300\u0301\u0303\u0309\u0323"


def _vietnamese() -> str:
    """Letters with the marks of Vietnamese: the seven of its own, and each vowel with each tone."""
    own = "ăâđêôơư"
    toned = "".join(unicodedata.normalize("NFC", v + tone) for v in "aăâeêioôơuưy" for tone in _TONES)
    return "".join(sorted(c for c in set(own + toned) if len(c) == 1))


#: Marked letters, composed or as a vowel before its mark.
VIETNAMESE = f"[{_vietnamese()}]|[aeiouy][{_TONES}\u0302\u0306\u031b]"


def language(text: Column) -> Column:
    """vi by its letters or words, en by its words or any letters else, mixed if it has signs of both; unknown without letters."""
    held = t.terms(text)
    shows = lambda hints: F.arrays_overlap(held, F.array(*map(F.lit, hints)))
    vi, en = F.lower(text).rlike(VIETNAMESE) | shows(VIETNAMESE_HINTS), shows(ENGLISH_HINTS)
    return F.when(vi & en, "mixed").when(vi, "vi").when(en | text.rlike(r"\p{L}"), "en").otherwise("unknown")


def _shows(hints: tuple[str, ...]) -> str:
    return f"list_has_any({_TERMS.replace('@', 'text')}, [{', '.join(map(repr, hints))}])"


_LANGUAGE = f"""(SELECT CASE WHEN vi AND en THEN 'mixed' WHEN vi THEN 'vi' WHEN en OR regexp_matches(text, '\\p{{L}}') THEN 'en' ELSE 'unknown' END FROM (SELECT coalesce(regexp_matches(lower(text), '{VIETNAMESE}') OR {_shows(VIETNAMESE_HINTS)}, false) AS vi, coalesce({_shows(ENGLISH_HINTS)}, false) AS en))"""


@query(f"SELECT doc_id, {_LANGUAGE} AS language FROM documents")
def fn_detect_language(spark, sf):
    return docs(spark, sf).select("doc_id", language(F.col("text")).alias("language"))


@query(f"SELECT item_id, text AS original, nfc_normalize({_NORM.replace('@', 'text')}) AS normalized, {_SEARCH.replace('@', 'text')} AS search_normalized, {_LANGUAGE} AS language FROM benchmark")
def fn_query_forms(spark, sf):
    text = F.col("text")
    return table(spark, sf, "benchmark").select("item_id", text.alias("original"), t.composed(t.normalized(text)).alias("normalized"), t.search_text(text).alias("search_normalized"), language(text).alias("language"))


@query(f"""WITH w AS (SELECT doc_id, {_WORDS.replace('@', 'text')} AS ws FROM documents), s AS (SELECT doc_id, ws, unnest(range(0, greatest(len(ws) - 40, 1), 260)) AS a FROM w WHERE len(ws) > 0)
 SELECT doc_id, (a // 260)::BIGINT AS chunk, len(ws[a+1:a+300])::BIGINT AS n_words, md5(array_to_string(ws[a+1:a+300], ' ')) AS h FROM s""")
def fn_split_words_window(spark, sf):
    cut = t.windowed(docs(spark, sf), ["doc_id"], "text")
    return cut.select("doc_id", F.col("i").alias("chunk"), F.size("ws").cast("long").alias("n_words"), F.md5(F.array_join("ws", " ")).alias("h"))


@query(f"""WITH w AS (SELECT doc_id, source, {_WORDS.replace('@', 'text')} AS ws FROM documents), s AS (SELECT doc_id, source, ws, unnest(range(0, greatest(len(ws) - 40, 1), 260)) AS a FROM w WHERE len(ws) > 0)
 SELECT doc_id, (a // 260)::BIGINT AS chunk_index, sha256('# ' || source || chr(10) || chr(10) || array_to_string(ws[a+1:a+300], ' ')) AS id FROM s""")
def job_chunk_words(spark, sf):
    cut = t.windowed(docs(spark, sf), ["doc_id", "source"], "text")
    content = F.concat(F.lit("# "), "source", F.lit("\n\n"), F.array_join("ws", " "))
    return cut.select("doc_id", F.col("i").alias("chunk_index"), F.sha2(content, 256).alias("id"))


_TAIL = rf"trim(reverse(regexp_extract(reverse(text), '^\s*(?:(?:[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s])\s*){{0,60}}')), ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))"


@query(f"SELECT doc_id, md5({_TAIL}) AS tail FROM documents")
def fn_token_tail(spark, sf):
    return docs(spark, sf).select("doc_id", F.md5(t.token_tail(F.col("text"), 60)).alias("tail"))


@query(r"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text || ' -3,5% x-4 7', '(?:^|[^\p{L}\p{N}_])(-?[0-9]+(?:[.,][0-9]+)?%?)', 1), lambda x: replace(x, ',', '.')), ' ') AS numbers FROM documents")
def fn_numbers(spark, sf):
    """Signed numbers of each text, to which a few are added."""
    return docs(spark, sf).select("doc_id", F.array_join(t.numbers(F.concat("text", F.lit(" -3,5% x-4 7"))), " ").alias("numbers"))


@query(r"""SELECT conv_id, turn, array_to_string(regexp_extract_all(text || ' [S' || turn || '] [S0] [S12]', '\[(S[1-9][0-9]*)\]', 1), ',') AS ids FROM conversations""")
def fn_citation_ids(spark, sf):
    cited = F.concat("text", F.lit(" [S"), F.col("turn").cast("string"), F.lit("] [S0] [S12]"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(t.citations(cited), ",").alias("ids"))


_SAFE = rf"trim(regexp_replace(regexp_replace({_NORM.replace('@', 'x')}, '[^\p{{L}}\p{{N}}_\s''-]', ' ', 'g'), '{_BLANK}', ' ', 'g'))"


@query(f"""SELECT item_id, array_to_string(list_distinct_in_order, ' OR ') AS q FROM (SELECT item_id, list_transform(list_filter(range(1, len(s) + 1), lambda i: list_position(s, s[i]) = i), lambda i: s[i]) AS list_distinct_in_order FROM (
 SELECT item_id, list_transform(list_filter(list_transform(list_concat(string_split(text, '.'), string_split(text, ' ')), lambda x: {_SAFE}), lambda x: x <> ''), lambda x: CASE WHEN contains(x, ' ') THEN '"' || x || '"' ELSE x END) AS s FROM benchmark))""")
def fn_lexical_query(spark, sf):
    """An item's sentences are phrases, its words single terms, in order."""
    terms = F.concat(F.split("text", r"\."), F.split("text", " "))
    return table(spark, sf, "benchmark").select("item_id", t.lexical_query(terms).alias("q"))


# Section intents and the words of a query that show them, in order.
SECTION_INTENTS = [
    ("craft", ("craft", "crafting", "recipe", "cong thuc", "cach lam", "che tao")),
    ("obtain", ("obtain", "acquisition", "where", "find", "lay o dau", "tim")),
    ("usage", ("usage", "use", "dung", "tac dung")),
    ("history", ("history", "update", "version", "lich su", "phien ban")),
    ("combat", ("combat", "damage", "fight", "chien dau", "sat thuong")),
]
#: Intents for the test tables, whose sections are languages.
INTENTS = [("es", ("los", "una", "las")), ("fr", ("les", "une", "dans")), ("de", ("der", "und", "die")), ("en", ("the", "with")), ("craft", ("craft", "recipe"))]


def intent(text: Column, rules=INTENTS) -> Column:
    """The first intent one of whose markers is a word or phrase of the text; null if none is."""
    padded, found = F.concat(F.lit(" "), t.search_text(text), F.lit(" ")), None
    for name, markers in rules:
        hit = padded.rlike(" (" + "|".join(markers) + ") ")
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found


def intent_sql(text: str, rules=INTENTS) -> str:
    padded = f"' ' || {_SEARCH.replace('@', text)} || ' '"
    return "CASE " + " ".join(f"WHEN regexp_matches({padded}, ' ({'|'.join(markers)}) ') THEN '{name}'" for name, markers in rules) + " END"


@query(f"SELECT item_id, {intent_sql('text')} AS intent, {intent_sql('text', SECTION_INTENTS)} AS section FROM benchmark")
def fn_section_intent(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", intent(F.col("text")).alias("intent"), intent(F.col("text"), SECTION_INTENTS).alias("section"))


@query(f"SELECT item_id, regexp_matches(' ' || {_SEARCH.replace('@', 'text')} || ' ', '{t.COMPARES}') AS compares FROM benchmark")
def fn_comparison_intent(spark, sf):
    return table(spark, sf, "benchmark").select("item_id", t.compares(F.col("text")).alias("compares"))


@query("""WITH v AS (SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN list_append(embedding, 'nan'::FLOAT) WHEN vec_id % 50 = 1 THEN list_transform(embedding, lambda x: x * 2) ELSE embedding END AS e FROM embeddings)
 SELECT vec_id, len(e) = 64 AS dims_ok, len(list_filter(e, lambda x: NOT isfinite(x))) = 0 AS finite, len(list_filter(e, lambda x: NOT isfinite(x))) = 0 AND abs(sqrt(list_sum(list_transform(e, lambda x: x::DOUBLE * x::DOUBLE))) - 1) <= 0.05 AS unit FROM v""")
def fn_vector_contract(spark, sf):
    """Dimension, finiteness and unit norm of vectors, some of which are spoilt on purpose."""
    v, n = F.col("embedding"), F.col("vec_id") % 50
    spoilt = F.when(n == 0, F.concat(v, F.array(F.lit(float("nan")).cast("float")))).when(n == 1, F.transform(v, lambda x: x * F.lit(2).cast("float"))).otherwise(v)
    rows = table(spark, sf, "embeddings").select("vec_id", spoilt.alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return rows.select("vec_id", (F.size("e") == 64).alias("dims_ok"), finite.alias("finite"), (finite & (F.abs(norm - 1) <= 0.05)).alias("unit"))


#: Secrets in text: access keys, assignments, private keys, signed tokens and credentials in addresses.
PATTERNS = {
    "access_key": "AKIA[A-Z0-9]{16}",
    "assignment": "(?:password|secret|token)[=:] ?[A-Za-z0-9/+_-]{6,}",
    "private_key": "-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "credential_url": r"[a-z]+://[^\s:/@]{1,64}:[^\s:/@]{3,128}@[A-Za-z0-9.-]+",
}
_PLANTED = " eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl db://app:pass1@host.example"


_EACH = " UNION ALL ".join(f"SELECT '{name}' AS pattern, unnest(regexp_extract_all(text, '{rule}')) AS x FROM d" for name, rule in PATTERNS.items())


@query(f"WITH d AS (SELECT CASE WHEN doc_id % 10 = 0 THEN text || '{_PLANTED}' ELSE text END AS text FROM documents) SELECT pattern, count(*)::BIGINT AS n FROM ({_EACH}) GROUP BY pattern")
def fn_secret_patterns(spark, sf):
    """Counts of secrets in the texts, to some of which a token and an address with credentials are added."""
    text = F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit(_PLANTED))).otherwise(F.col("text")).alias("text")
    found = [F.array_repeat(F.lit(name), F.regexp_count("text", F.lit(rule))) for name, rule in PATTERNS.items()]
    return docs(spark, sf).select(text).select(F.explode(F.concat(*found)).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n"))


_FEATURES = f"""SELECT @k, ('0x' || substr(sha256(f), 1, 8))::BIGINT % 256 AS idx, CASE WHEN ('0x' || substr(sha256(f), 9, 2))::BIGINT % 2 = 0 THEN v ELSE -v END AS v FROM (
 SELECT @k, unnest(ws) AS f, 1.0::DOUBLE AS v FROM w UNION ALL SELECT @k, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i+1])), 0.5::DOUBLE FROM w)"""


def vector_sql(rel: str, key: str) -> str:
    """key and e, the hashed unit vector, of the texts of a relation."""
    return f"""WITH w AS (SELECT {key}, {_TERMS.replace('@', 'text')} AS ws FROM {rel}) SELECT {key}, list_transform(range(256), lambda i: coalesce(m[i], 0) / norm) AS e FROM (
 SELECT {key}, map(list(idx), list(v)) AS m, sqrt(sum(v * v)) AS norm FROM (SELECT {key}, idx, sum(v) AS v FROM ({_FEATURES.replace('@k', key)}) GROUP BY ALL) GROUP BY {key}) WHERE norm > 0"""


@query(f"WITH v AS ({vector_sql('benchmark', 'item_id')}) SELECT item_id, i AS idx, round(e[i + 1], 6) AS weight FROM v, range(256) r(i) WHERE e[i + 1] <> 0")
def job_hash_embed(spark, sf):
    found = embedded(table(spark, sf, "benchmark"), "item_id", "text").select("item_id", F.posexplode("embedding").alias("idx", "weight")).where("weight <> 0")
    return found.select("item_id", F.col("idx").cast("long").alias("idx"), F.round("weight", 6).alias("weight"))
