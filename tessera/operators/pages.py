"""Corpus processing: wiki pages as sections, facts, classes and chunks, their validation and a build's report.

The test tables hold no wiki markup, so pages are written from the columns of `documents` by a stated rule; what the
jobs find in them is then known from these columns.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import chunks, wikitext
from tessera.functions import text as t
from tessera.functions.batches import pieces
from tessera.operators.textual import _SEARCH, _WORDS
from tessera.registry import query, table

PARSED = "sections array<struct<path: array<string>, content: string>>, categories array<string>, templates array<string>, hints array<string>, facts array<string>"


def parsed(pages: DataFrame, keys: list[str], markup: str = "markup", parse: Callable[[str], dict] | None = None) -> DataFrame:
    """pages' keys with sections, categories, templates, hints and facts of their markup; null markup is empty.

    With a parse function of one's own a page that raises has empty lists, and its error in a further column.
    """
    nothing = {"sections": [], "categories": [], "templates": [], "hints": [], "facts": []}

    def read(text: str) -> tuple[dict, str | None]:
        if parse is None:
            return wikitext.parse(text), None
        try:
            return parse(text), None
        except Exception as e:  # whatever a page raises is that page's error
            return nothing, f"{type(e).__name__}: {e}"

    told = "sections", "categories", "templates", "hints", "facts"
    strings = pa.list_(pa.string())
    kind_of = dict.fromkeys(told, strings) | {"sections": pa.list_(pa.struct([("path", strings), ("content", pa.string())]))}

    def each(batches):
        for batch in pieces(batches, "_markup"):
            read_ = [read(m or "") for m in batch.column("_markup").to_pylist()]
            out = {k: batch.column(k) for k in keys}
            out["sections"] = pa.array([[{"path": p, "content": c} for p, c in f["sections"]] for f, _ in read_], kind_of["sections"])
            for name in told[1:]:
                out[name] = pa.array([f[name] for f, _ in read_], kind_of[name])
            if parse is not None:
                out["error"] = pa.array([e for _, e in read_], pa.string())
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.select(*keys, F.col(markup).alias("_markup")).mapInArrow(each, f"{kinds}, {PARSED}" + (", error string" if parse is not None else ""))


def clean_html(html: Column) -> Column:
    for rule, put in (("(?s)<script.*?</script>", ""), ("(?s)<style.*?</style>", ""), ("(?s)<!--.*?-->", ""), ("<[^>]*>", " ")):
        html = F.regexp_replace(html, rule, put)
    return t.collapse(html)


def _plain(text: Column) -> Column:
    """Letters, digits, points and single blanks of a text, which no markup sign is among."""
    return F.trim(F.regexp_replace(text, "[^a-zA-Z0-9.]+", " "))


_PLAIN = "trim(regexp_replace(text, '[^a-zA-Z0-9.]+', ' ', 'g'))"


def wiki_pages(spark, sf) -> DataFrame:
    """doc_id, title, revision, lang and markup: an infobox, links, nested headings, a table, a gallery and notes."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), (F.col("n_chars") + 1).alias("revision"), "lang", "n_chars", _plain(F.col("text")).alias("body"))
    scope = F.when(F.col("doc_id") % 5 == 0, "Shipwrecked").when(F.col("doc_id") % 5 == 1, "Don't Starve Together").otherwise("")
    lines = [
        F.format_string("{{Object Infobox|name=%s|image=x.png|damage={{Value|%s}}|lang=%s}}{{Exclusivity|%s}}", "title", F.col("n_chars").cast("string"), "lang", scope),
        F.format_string("'''%s''' is [[Page %s|page %s]].<ref>a note</ref>", "title", F.col("doc_id").cast("string"), F.col("doc_id").cast("string")),
        F.lit("\n== Crafting {{Pic|32|x}} ==\n* first\n# second\n=== Tips ===\n{| class=\"t\"\n|+ Costs\n! name !! size"),
        F.format_string("|-\n| %s || style=\"x\" | %s || extra\n|}", "lang", F.col("n_chars").cast("string")),
        F.lit("== Gallery ==\n<gallery>a.png</gallery>\n=== Deeper ===\ngone\n== Notes =="),
        F.concat(F.when(F.col("body") != "", F.concat(F.lit("* "), "body")).otherwise(""), F.lit("\n[[Category:Items]] [[Category:"), "title", F.lit("]] [[File:x.png|thumb]]")),
    ]
    return docs.select("doc_id", "title", "revision", "lang", F.concat_ws("\n", *lines).alias("markup"))


def _sections(spark, sf) -> DataFrame:
    pages = wiki_pages(spark, sf)
    found = parsed(pages, ["doc_id", "title", "revision"])
    return found.select("*", F.posexplode("sections").alias("section", "s")).select("doc_id", "title", "revision", "section", "s.path", "s.content", "categories", "templates", "hints")


_SECTIONS = f"""(SELECT doc_id, 0 AS section, 'Overview' AS path, 'Infobox:' || chr(10) || '- name: ' || source || chr(10) || '- damage: ' || n_chars || chr(10) || '- lang: ' || lang || chr(10) || chr(10) || source || ' is page ' || doc_id || '.' AS content, source, n_chars, lang FROM documents UNION ALL
 SELECT doc_id, 1, 'Crafting', '- first' || chr(10) || '- second', source, n_chars, lang FROM documents UNION ALL
 SELECT doc_id, 2, 'Crafting > Tips', 'Table: Costs' || chr(10) || 'Row 1: name: ' || lang || '; size: ' || n_chars || '; extra', source, n_chars, lang FROM documents UNION ALL
 SELECT doc_id, 3, 'Notes', '- ' || {_PLAIN}, source, n_chars, lang FROM documents WHERE {_PLAIN} <> '')"""


@query(f"SELECT doc_id, section::BIGINT AS section, path, md5(content) AS h FROM {_SECTIONS}")
def job_page_sections(spark, sf):
    """One row for each section of a wiki page, with its heading path; boilerplate sections and what is below them are gone."""
    return _sections(spark, sf).select("doc_id", F.col("section").cast("long").alias("section"), F.array_join("path", " > ").alias("path"), F.md5("content").alias("h"))


@query(rf"""WITH c AS (SELECT page_id, regexp_replace(regexp_replace(html, '<script.*?</script>', '', 'gs'), '<style.*?</style>', '', 'gs') AS h FROM pages)
SELECT 'html' AS kind, page_id AS id, md5(trim(regexp_replace(regexp_replace(regexp_replace(h, '<!--.*?-->', '', 'gs'), '<[^>]*>', ' ', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS h FROM c
UNION ALL SELECT 'wiki', doc_id, md5(string_agg(content, chr(10) || chr(10) ORDER BY section)) FROM {_SECTIONS} GROUP BY doc_id""")
def job_clean_pages(spark, sf):
    """The text of web pages, and the blocks of wiki pages."""
    web = table(spark, sf, "pages").select(F.lit("html").alias("kind"), F.col("page_id").alias("id"), F.md5(clean_html(F.col("html"))).alias("h"))
    wiki = parsed(wiki_pages(spark, sf), ["doc_id"]).select(F.lit("wiki").alias("kind"), F.col("doc_id").alias("id"), F.md5(F.array_join("sections.content", "\n\n")).alias("h"))
    return web.union(wiki)


@query("""SELECT doc_id, 'Items,' || source AS categories, CASE WHEN doc_id % 5 = 0 THEN 'Shipwrecked' WHEN doc_id % 5 = 1 THEN 'Don''t Starve Together' ELSE '' END AS hints,
 'name: ' || source || '|damage: ' || n_chars || '|lang: ' || lang AS facts, 'Exclusivity,Object Infobox,Pic,Value' AS templates FROM documents""")
def job_page_facts(spark, sf):
    found = parsed(wiki_pages(spark, sf), ["doc_id"])
    return found.select("doc_id", F.array_join("categories", ",").alias("categories"), F.array_join("hints", ",").alias("hints"), F.array_join("facts", "|").alias("facts"), F.array_join(F.array_sort("templates"), ",").alias("templates"))


# Scopes and entity types with the words that show them, in order of preference.
SCOPE_RULES = [
    ("dst", ("don't starve together", "return of them", "a new reign")),
    ("reign_of_giants", ("reign of giants",)),
    ("shipwrecked", ("shipwrecked",)),
    ("hamlet", ("hamlet",)),
    ("dont_starve", ("don't starve",)),
]
CATEGORY_RULES = [
    ("boss", ("boss", "giants")),
    ("character", ("character", "survivors")),
    ("weapon", ("weapon",)),
    ("armor", ("armor", "armour")),
    ("tool", ("tool",)),
    ("recipe", ("crock pot recipes", "recipes")),
    ("food", ("food", "vegetable", "fruit", "meat", "perishables")),
    ("structure", ("structure", "crafting stations", "light sources")),
    ("mob", ("mobs", "creatures", "monsters", "animals")),
    ("mechanic", ("game mechanics", "mechanics")),
    ("biome", ("biomes", "caves")),
    ("season", ("seasons",)),
    ("guide", ("guides",)),
    ("update", ("updates",)),
    ("item", ("items", "objects", "resources")),
]
TEMPLATE_RULES = [("update", ("update infobox",)), ("biome", ("biome infobox",)), ("character", ("character infobox",)), ("mob", ("creature infobox",)), ("item", ("object infobox",))]


def folded(text: Column) -> Column:
    return F.lower(t.collapse(text))


def _has(text: Column, markers: tuple[str, ...]) -> Column:
    found = text.contains(markers[0])
    for marker in markers[1:]:
        found = found | text.contains(marker)
    return found


def scope_of(text: Column, rules=SCOPE_RULES) -> Column:
    """The first scope whose words a folded text contains."""
    found = None
    for name, markers in rules:
        hit = _has(text, markers)
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found


def scopes(values: Column, rules=SCOPE_RULES) -> Column:
    """The scopes that strings name, one for each string at most."""
    return F.array_distinct(F.array_compact(F.transform(values, lambda v: scope_of(folded(v), rules))))


def first_rule(values: Column, rules) -> Column:
    """The first rule that any string of an array meets."""
    told, found = F.transform(values, folded), None
    for name, markers in rules:
        hit = F.exists(told, lambda v: _has(v, markers))  # noqa: B023
        found = F.when(hit, name) if found is None else found.when(hit, name)
    return found


def classified(pages: DataFrame) -> DataFrame:
    """pages (title, categories, templates, hints) with scope, entity, kind, their reasons and whether they are subjective."""
    title, hinted, named = folded(F.col("title")), scopes(F.col("hints")), scopes(F.col("categories"))
    by_title = title.endswith("/dst") | (title == "don't starve together")
    only = lambda found: F.when(F.size(found) > 1, "mixed").otherwise(found[0])
    pages = pages.withColumns({"_h": hinted, "_n": named, "_e": first_rule(F.col("categories"), CATEGORY_RULES), "_t": first_rule(F.col("templates"), TEMPLATE_RULES), "_guide": title.startswith("guides/")})
    scope = F.when(by_title, "dst").when(F.size("_h") > 0, only(F.col("_h"))).when(F.size("_n") > 0, only(F.col("_n"))).otherwise("unknown")
    why = F.when(by_title, "title").when(F.size("_h") > 0, "exclusivity_template").when(F.size("_n") > 0, "category").otherwise("insufficient_scope_evidence")
    entity = F.coalesce("_e", "_t", F.when(F.col("_guide"), "guide"), F.lit("other"))
    entity_why = F.when(F.col("_e").isNotNull(), "category").when(F.col("_t").isNotNull(), "infobox_template").when(F.col("_guide"), "title").otherwise("fallback")
    pages = pages.withColumns({"scope": scope, "scope_reason": why, "entity": entity, "entity_reason": entity_why})
    updated = (F.col("entity") == "update") | F.exists("templates", lambda x: folded(x).contains("update infobox"))
    guided = F.col("_guide") | (F.col("entity") == "guide")
    kind = F.when(guided, "guide").when(updated, "version_history").when(title.startswith("category:"), "category_list").otherwise("factual_article")
    kind_why = F.when(guided, "guide_title_or_entity").when(updated, "update_template_or_entity").when(title.startswith("category:"), "category_title").otherwise("article_default")
    return pages.withColumns({"kind": kind, "kind_reason": kind_why, "subjective": guided}).drop("_h", "_n", "_e", "_t", "_guide")


def _titled(spark, sf) -> DataFrame:
    """Facts of pages some of which are renamed or lose their infobox, so that every rule is met."""
    n = F.col("doc_id") % 7
    title = F.when(n == 0, F.concat(F.lit("Guides/"), "title")).when(n == 1, F.concat("title", F.lit("/DST"))).when(n == 2, F.concat(F.lit("Category:"), "title")).otherwise(F.col("title"))
    category = F.element_at(F.array(*map(F.lit, ("Reign of Giants", "Hamlet Mobs", "Biomes", "Don't Starve", "Plain"))), (F.col("doc_id") % 5 + 1).cast("int"))
    found = parsed(wiki_pages(spark, sf), ["doc_id", "title"]).select("doc_id", title.alias("title"), "hints", F.when(F.col("doc_id") % 3 == 0, F.array(category)).otherwise(F.array(F.lit("x"))).alias("categories"), F.when(n == 3, F.array(F.lit("Update Infobox"))).when(n == 4, F.array(F.lit("Pic"))).otherwise(F.col("templates")).alias("templates"))
    return found


_RULED = """(SELECT doc_id, CASE WHEN n7 = 1 THEN 'dst' WHEN h IS NOT NULL THEN h WHEN c3 AND n5 = 0 THEN 'reign_of_giants' WHEN c3 AND n5 = 1 THEN 'hamlet' WHEN c3 AND n5 = 3 THEN 'dont_starve' ELSE 'unknown' END AS scope,
 CASE WHEN n7 = 1 THEN 'title' WHEN h IS NOT NULL THEN 'exclusivity_template' WHEN c3 AND n5 IN (0, 1, 3) THEN 'category' ELSE 'insufficient_scope_evidence' END AS scope_reason,
 CASE WHEN c3 AND n5 = 0 THEN 'boss' WHEN c3 AND n5 = 1 THEN 'mob' WHEN c3 AND n5 = 2 THEN 'biome' WHEN n7 = 3 THEN 'update' WHEN n7 <> 4 THEN 'item' WHEN n7 = 0 THEN 'guide' ELSE 'other' END AS entity,
 CASE WHEN c3 AND n5 IN (0, 1, 2) THEN 'category' WHEN n7 <> 4 THEN 'infobox_template' ELSE 'fallback' END AS entity_reason, n7
 FROM (SELECT doc_id, doc_id % 7 AS n7, doc_id % 5 AS n5, doc_id % 3 = 0 AS c3, CASE doc_id % 5 WHEN 0 THEN 'shipwrecked' WHEN 1 THEN 'dst' END AS h FROM documents))"""


@query(f"""SELECT doc_id, scope, scope_reason, entity, entity_reason, CASE WHEN n7 = 0 THEN 'guide' WHEN n7 = 3 THEN 'version_history' WHEN n7 = 2 THEN 'category_list' ELSE 'factual_article' END AS kind,
 CASE WHEN n7 = 0 THEN 'guide_title_or_entity' WHEN n7 = 3 THEN 'update_template_or_entity' WHEN n7 = 2 THEN 'category_title' ELSE 'article_default' END AS kind_reason, n7 = 0 AS subjective FROM {_RULED}""")
def job_classify_pages(spark, sf):
    return classified(_titled(spark, sf)).select("doc_id", "scope", "scope_reason", "entity", "entity_reason", "kind", "kind_reason", "subjective")


def section_scope(page: Column, path: Column, rules=SCOPE_RULES) -> Column:
    """A section's scope: that of its heading if it names one, mixed if it names several, else the page's."""
    found = scopes(F.array(path), rules)
    return F.when(F.size(found) == 1, found[0]).when(F.size(found) > 1, "mixed").otherwise(page)


@query("""SELECT doc_id, section, CASE WHEN contains(path, 'Together') THEN 'dst' WHEN contains(path, 'Hamlet') THEN 'hamlet' ELSE lang END AS scope FROM (
 SELECT doc_id, lang, section, CASE (doc_id + section) % 3 WHEN 0 THEN 'Notes > Don''t Starve  Together' WHEN 1 THEN 'In Hamlet' ELSE 'Notes' END AS path FROM documents, (SELECT unnest([0, 1])::BIGINT AS section))""")
def job_classify_section_scope(spark, sf):
    """Two sections of each document, with headings of which some name a game."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("section"))
    n = (F.col("doc_id") + F.col("section")) % 3
    path = F.when(n == 0, "Notes > Don't Starve  Together").when(n == 1, "In Hamlet").otherwise("Notes")
    return docs.select("doc_id", "section", section_scope(F.col("lang"), path).alias("scope"))


@query("""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'dst' ELSE 'shipwrecked' END, CASE WHEN contains(source, '1') THEN 'hamlet' END, 'dst'], lambda x: x IS NOT NULL))), ',') AS scopes FROM documents""")
def set_scope_matches(spark, sf):
    """Scopes named by three strings of each document."""
    values = F.array(F.when(F.col("doc_id") % 2 == 0, "Don't Starve Together").otherwise("Shipwrecked Islands"), F.when(F.col("source").contains("1"), "The Hamlet").otherwise(F.col("source")), F.lit("A New Reign"))
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.sort_array(scopes(values)), ",").alias("scopes"))


# What a chunk's header calls a scope.
LABELS = {
    "dst": "Don't Starve Together",
    "dont_starve": "Don't Starve",
    "reign_of_giants": "Reign of Giants",
    "shipwrecked": "Shipwrecked",
    "hamlet": "Hamlet",
    "mixed": "Mixed game scope",
    "unknown": "Unknown game scope",
}
SUBJECTIVE = ("guide", "recommendation", "strategy", "tips")


def section_chunks(sections: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Chunks of sections (doc_id, title, revision, section, path, content, scope, entity, subjective), with header, hashes and keys.

    by: further columns that tell sections of one number and page apart, text all of them.

    Only the ordered fold over one section's blocks is Python; null or blank content has no chunk.
    """
    keys = [*by, "doc_id", "section"]

    def fold(batches):
        for batch in pieces(batches, "content"):
            cut = [chunks.chunked([b.strip() for b in (text or "").split("\n\n") if b.strip()]) for text in batch.column("content").to_pylist()]
            row = pa.array([i for i, found in enumerate(cut) for _ in found], pa.int64())
            at, body = pa.array([n for found in cut for n in range(len(found))], pa.int64()), pa.array([c for found in cut for c in found], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(row) for k in keys), at, body], names=[*keys, "chunk_index", "body"])

    bodies = sections.select(*by, F.col("doc_id").cast("long").alias("doc_id"), F.col("section").cast("long").alias("section"), "content").mapInArrow(fold, "".join(f"`{c}` string, " for c in by) + "doc_id long, section long, chunk_index long, body string")
    of = sections.drop("content").withColumn("path", F.array_join("path", " > "))
    label = F.create_map(*(F.lit(x) for item in LABELS.items() for x in item))
    scope = section_scope(F.col("scope"), F.col("path"))
    header = F.format_string("Page: %s\nSection: %s\nGame: %s\nEntity type: %s", "title", "path", F.coalesce(F.try_element_at(label, scope), F.lit("Unknown game scope")), "entity")
    rows = bodies.join(of, keys).withColumns({"scope": scope, "content": F.concat(header, F.lit("\n\n"), "body")})
    content = F.sha2("content", 256)
    key = F.sha2(F.concat_ws("\n", F.col("doc_id").cast("string"), F.col("revision").cast("string"), "path", F.col("chunk_index").cast("string"), content), 256)
    subjective = F.col("subjective") | _has(F.lower("path"), SUBJECTIVE)
    found = F.concat_ws("\n", "title", "path", "content", t.search_text(F.col("content")))
    return rows.select(*by, "doc_id", "revision", "section", "chunk_index", "title", "path", "scope", "entity", subjective.alias("subjective"), t.token_count(F.col("content")).alias("n_tokens"), "content", found.alias("search_text"), content.alias("content_hash"), F.sha2("body", 256).alias("body_hash"), key.alias("source_key"))


def _chunks(spark, sf) -> DataFrame:
    return section_chunks(classified(_sections(spark, sf)).select("doc_id", "title", "revision", "section", "path", "content", "scope", "entity", "subjective"))


_SHORT = f"""(SELECT s.doc_id, section::BIGINT AS section, 0::BIGINT AS chunk_index, 'Page: ' || source || chr(10) || 'Section: ' || path || chr(10) || 'Game: ' || CASE s.doc_id % 5 WHEN 0 THEN 'Shipwrecked' WHEN 1 THEN 'Don''t Starve Together' ELSE 'Unknown game scope' END || chr(10) || 'Entity type: item' || chr(10) || chr(10) || content AS content,
 contains(path, 'Tips') AS subjective, source AS title, path FROM {_SECTIONS} s)"""


@query(rf"SELECT doc_id, section, chunk_index, sha256(content) AS content_hash, subjective, len(regexp_extract_all(content, '{t.TOKEN}'))::BIGINT AS n_tokens, md5(title || chr(10) || path || chr(10) || content || chr(10) || {_SEARCH.replace('@', 'content')}) AS search_hash FROM {_SHORT}")
def job_chunk_sections(spark, sf):
    """Chunks of the wiki pages' sections: short ones, tables, and notes that are lists, which stay whole however long they are."""
    rows = _chunks(spark, sf)
    return rows.select("doc_id", "section", "chunk_index", "content_hash", "subjective", "n_tokens", F.md5("search_text").alias("search_hash"))


# What a chunk must have, and the share of chunks that must have it.
REQUIRED = ("title", "path", "revision", "scope", "source_key", "content_hash", "n_tokens")
LEAST_COMPLETE = 0.95


def validated(rows: DataFrame, pages: DataFrame, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Valid chunks, issues (code, doc_id, source_key, fatal) and a report of one row.

    by: columns of rows and pages; chunks are duplicates only of chunks that are alike in these.

    The first chunk of each body in order of page, section and index is valid; only chunks that are otherwise accepted
    make others duplicates. A page without any unique valid chunk is fatal. pages: doc_id of all that are expected.
    """
    missing = F.array_compact(F.array(*(F.when(F.coalesce(F.col(c).cast("string"), F.lit("")).isin("", "0"), F.lit(c)) for c in REQUIRED)))
    blank = F.coalesce(F.trim("content"), F.lit("")) == ""
    rows = rows.withColumn("code", F.when(blank, "empty_chunk").when(F.size(missing) > 0, "missing_metadata"))
    good = rows.where("code is null")
    at = F.struct("doc_id", "section", "chunk_index")
    first = good.where("coalesce(body_hash, '') <> ''").groupBy(*by, "body_hash").agg(F.min(at).alias("first"))
    same_key = good.groupBy(*by, "source_key").agg(F.min(at).alias("first_key"))
    judged = good.join(same_key, [*by, "source_key"]).join(first, [*by, "body_hash"], "left")
    judged = judged.withColumn("code", F.when(at != F.col("first_key"), "duplicate_source_key").when(at != F.col("first"), "duplicate_content"))
    valid = judged.where("code is null").select(*rows.columns).drop("code")
    bare = pages.select(*by, "doc_id").distinct().join(valid.select(*by, "doc_id"), [*by, "doc_id"], "left_anti").select(*by, F.lit("page_without_chunks").alias("code"), "doc_id", F.lit(None).cast("string").alias("source_key"), F.lit(True).alias("fatal"))
    fatal = ~F.col("code").startswith("duplicate")
    told = [*by, "code", "doc_id", "source_key"]
    issues = rows.where("code is not null").select(*told).union(judged.where("code is not null").select(*told)).withColumn("fatal", fatal).union(bare)
    counts = rows.agg(F.count("*").alias("candidates"), F.count_if(F.col("code").isNull()).alias("complete"), F.count_if(F.col("code") == "empty_chunk").alias("empties"))
    told = issues.agg(F.count_if(~F.col("fatal")).alias("duplicates"), F.count_if("fatal").alias("fatal"))
    covered = valid.agg(F.count("*").alias("valid"), F.count_distinct("doc_id").alias("covered"))
    report = counts.crossJoin(told).crossJoin(covered)  # one row each
    share = F.coalesce(F.try_divide(F.col("complete").cast("double"), "candidates"), F.lit(0.0))
    return valid, issues, report.withColumns({"completeness": F.round(share, 4), "passed": (F.col("valid") > 0) & (share >= LEAST_COMPLETE) & (F.col("fatal") == 0)})


def word_chunks(docs: DataFrame) -> DataFrame:
    """Word-window chunks of documents (doc_id, title, revision, scope, text) in the shape that validation takes."""
    cut = t.windowed(docs, ["doc_id", "title", "revision", "scope"], "text").withColumn("body", F.array_join("ws", " "))
    content = F.when(F.col("title").isNotNull(), F.concat(F.lit("# "), "title", F.lit("\n\n"), "body")).otherwise(F.col("body"))
    rows = cut.select("doc_id", "title", "revision", "scope", F.lit(0).cast("long").alias("section"), F.col("i").alias("chunk_index"), F.lit("Overview").alias("path"), content.alias("content"), F.sha2("body", 256).alias("body_hash"), F.size("ws").cast("long").alias("n_tokens"))
    return rows.withColumns({"content_hash": F.sha2("content", 256), "source_key": F.sha2(F.concat_ws("\n", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"), "body_hash"), 256)})


def _pages(spark, sf) -> DataFrame:
    """Documents as pages; a few lack their scope."""
    return table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), (F.col("n_chars") + 1).alias("revision"), F.when(F.col("doc_id") % 50 != 7, F.col("lang")).alias("scope"), "text")


_WC = f"""wc AS (SELECT doc_id, title, scope, a // 260 AS i, sha256(array_to_string(ws[a+1:a+300], ' ')) AS body FROM (SELECT doc_id, title, scope, ws, unnest(range(0, greatest(len(ws) - 40, 1), 260)) AS a FROM (
 SELECT doc_id, source AS title, CASE WHEN doc_id % 50 <> 7 THEN lang END AS scope, {_WORDS.replace('@', 'text')} AS ws FROM documents) WHERE len(ws) > 0)),
vc AS (SELECT *, CASE WHEN scope IS NULL THEN 'missing_metadata' WHEN row_number() OVER (PARTITION BY scope IS NULL, body ORDER BY doc_id, i) > 1 THEN 'duplicate_content' END AS code FROM wc)"""


@query(f"""WITH {_WC} SELECT code, doc_id, count(*)::BIGINT AS n FROM (SELECT code, doc_id FROM vc WHERE code IS NOT NULL UNION ALL
 SELECT 'page_without_chunks', doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM vc WHERE code IS NULL)) GROUP BY ALL""")
def job_validate_corpus(spark, sf):
    """Issues of word chunks, with their numbers."""
    pages = _pages(spark, sf)
    return validated(word_chunks(pages), pages)[1].groupBy("code", "doc_id").agg(F.count("*").alias("n"))


@query(f"WITH {_WC} SELECT (SELECT count(*) FROM documents) AS pages, count(*) AS candidates, count(*) FILTER (code IS NULL) AS valid, count(*) FILTER (code = 'duplicate_content') AS duplicates, round(count(*) FILTER (scope IS NOT NULL) / count(*), 4) AS completeness FROM vc")
def agg_build_report(spark, sf):
    pages = _pages(spark, sf)
    report = validated(word_chunks(pages), pages)[2]
    return pages.agg(F.count("*").alias("pages")).crossJoin(report).select("pages", "candidates", "valid", "duplicates", "completeness")  # one row each
