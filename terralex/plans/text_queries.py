"""Queries over names and texts: keys, search, cleaning, line and word scores, merging of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralex.functions import fixed
from terralex.functions import text as T
from terralex.operators import fuzzy, resolve
from terralex.operators.filters import readable
from terralex.operators.graph import compact_index
from terralex.operators.skew import found_in, hub_keys, looked_up, with_keys
from terralex.staging import stage


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fuzzy_topk(spark, d):
    return fuzzy.search(read(spark, d, "part"), "p_name", "blue widgit")


FUZZY_TOPK = """
SELECT name, distance::INTEGER AS distance, CASE WHEN distance <= 1 THEN 'ok' WHEN distance = 2 THEN 'near' ELSE 'no' END AS grade
FROM (SELECT DISTINCT p_name AS name, levenshtein(p_name, 'blue widgit') AS distance FROM part)
ORDER BY distance, length(name), name LIMIT 60
"""


def typo_pairs(spark, d):
    names = read(spark, d, "customer").select(F.substring("c_name", 10, 9).alias("name"))
    return fuzzy.close_pairs(names, names, "name").where("a < b")


TYPO_PAIRS = """
WITH n AS (SELECT DISTINCT substr(c_name, 10, 9) AS name FROM customer)
SELECT x.name AS a, y.name AS b FROM n x JOIN n y ON x.name < y.name AND damerau_levenshtein(x.name, y.name) <= 1
"""


def fuzzy_reject(spark, d):
    part = read(spark, d, "part")
    long = F.expr("concat(p_name, ' ', p_size * 37 + p_partkey % 97)")
    left = part.where("p_size > 40").select(long.alias("name")).distinct()
    return fuzzy.without_close(left, part.where("p_size <= 35").select(long.alias("name")), "name")


FUZZY_REJECT = """
WITH n AS (SELECT p_size, p_name || ' ' || (p_size * 37 + p_partkey % 97) AS name FROM part),
l AS (SELECT DISTINCT name FROM n WHERE p_size > 40), r AS (SELECT DISTINCT name FROM n WHERE p_size <= 35)
SELECT name FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE damerau_levenshtein(l.name, r.name) <= 1)
"""


def fold_keys(spark, d):
    docs = read(spark, d, "documents")
    return docs.select("doc_id", F.md5(T.key_alnum(F.col("text"))).alias("alnum_md5"), F.md5(T.key_words(F.col("text"))).alias("words_md5"))


FOLD_KEYS = r"""
SELECT doc_id, md5(regexp_replace(strip_accents(lower(text)), '[^\p{L}\p{N}]', '', 'g')) AS alnum_md5,
  md5(trim(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))) AS words_md5
FROM documents
"""


def html_to_text(spark, d):
    return read(spark, d, "pages").select("page_id", T.html_text(F.col("html")).alias("body"))


HTML_TO_TEXT = r"""
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'),
  '<style[^>]*>.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g')) AS body FROM pages
"""


def html_escaped(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(T.html_escape(F.col("html"))).alias("escaped_md5"))


HTML_ESCAPED = "SELECT page_id, md5(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS escaped_md5 FROM pages"


def link_crawl(spark, d):
    pages = read(spark, d, "pages")
    links = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("pos", "path"))
    first = Window.partitionBy("path").orderBy("page_id", "pos")
    return links.withColumn("n", F.row_number().over(first)).where("n = 1").select("path", F.col("page_id").alias("first_page"))


LINK_CRAWL = r"""
SELECT path, min(page_id) AS first_page
FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS path FROM pages) GROUP BY path
"""


def shout_ratio(spark, d):
    docs = read(spark, d, "documents").select("doc_id", T.upper_ratio(F.col("text")).alias("upper_ratio"))
    return docs.withColumn("shouted", F.col("upper_ratio") > 0.7)


SHOUT_RATIO = r"""
SELECT *, upper_ratio > 0.7 AS shouted FROM (
SELECT doc_id, CASE WHEN len(regexp_extract_all(text, '\p{L}')) > 0 THEN len(regexp_extract_all(text, '\p{Lu}')) / len(regexp_extract_all(text, '\p{L}')) ELSE 0.0::DOUBLE END AS upper_ratio FROM documents)
"""


def dehyphenated(spark, d):
    text = T.squeeze(T.dehyphenate(F.replace(F.col("text"), F.lit("e "), F.lit("e-\n"))))
    return read(spark, d, "documents").select("doc_id", F.md5(text).alias("text_md5"))


DEHYPHENATED = r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(
  replace(text, 'e ', 'e-' || chr(10)), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g'), chr(160), ' '), '\r', chr(10), 'g'), '[ \t]+', ' ', 'g'),
  '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS text_md5 FROM documents
"""


def name_slugs(spark, d):
    name = F.col("p_name")
    url = T.image_url("https://example.org/", F.lit(""), F.concat(F.lit("File:"), name, F.lit(".jpg;other.jpg")))
    return read(spark, d, "part").select("p_partkey", T.slug(name).alias("slug"), url.alias("url"), T.h32(name).alias("h"), (F.abs(T.h32(name)) % 8).alias("palette"))


NAME_SLUGS = """
SELECT *, abs(h) % 8 AS palette FROM (
SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') AS slug, 'https://example.org/' || replace(p_name, ' ', '%20') || '.jpg' AS url,
  (CASE WHEN u >= 2147483648 THEN u - 4294967296 ELSE u END)::BIGINT AS h
FROM (SELECT *, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(p_name, ''), lambda c: unicode(c)::BIGINT)), lambda h, c: (h * 31 + c) % 4294967296) AS u FROM part))
"""


def place_keys(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", T.place_key(F.col("s_name"), F.col("s_acctbal") / 100, F.col("s_acctbal") / 37).alias("key"))


PLACE_KEYS = "SELECT s_suppkey, s_name || '|' || printf('%.5f', s_acctbal / 100) || '|' || printf('%.5f', s_acctbal / 37) AS key FROM supplier"


def label_numbers(spark, d):
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    numbered = nation.withColumn("num", F.coalesce(T.label_number(F.col("n_name")), F.lit(999)))
    found = numbered.join(region.select("r_name", F.col("r_regionkey").alias("num")), "num", "left")
    return compact_index(found, "num", "n_nationkey").select("n_name", "num", "r_name", F.col("idx").cast("int").alias("idx"))


LABEL_NUMBERS = r"""
WITH n AS (SELECT n_name, n_nationkey, coalesce(try_cast(nullif(regexp_extract(n_name, '(\d+)', 1), '') AS INTEGER), 999) AS num FROM nation)
SELECT n_name, num, r_name, (row_number() OVER (ORDER BY num, n_nationkey) - 1)::INTEGER AS idx FROM n LEFT JOIN region ON r_regionkey = num
"""


def vowel_words(spark, d):
    return read(spark, d, "documents").select("doc_id", T.vowel_words(F.col("text")).alias("n"))


VOWEL_WORDS = r"""
SELECT doc_id, len(list_filter(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{3,}'), lambda w: regexp_matches(w, '[aeiouyàâéèêîïôûüAEIOUY]'))) ::INTEGER AS n FROM documents
"""


def known_words(spark, d):
    """Share of a document's words that the clean documents' vocabulary has."""
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels")
    words = docs.select("doc_id", F.explode(T.plain_words(F.col("text"))).alias("w"))
    sure = with_keys(docs, labels.where("quality = 1"), "doc_id")
    clean = sure.select(F.explode(T.plain_words(F.col("text"), lower=True)).alias("w"))
    constants = docs.sparkSession.createDataFrame([(w,) for w in fixed.COMMON_FRENCH], "w string")
    found = found_in(words, "doc_id", "w", clean.union(constants))
    return found.select("doc_id", "tokens", F.round(F.col("hits") / F.col("tokens"), 6).alias("ratio"), readable(F.col("tokens"), F.col("hits") / F.col("tokens")).alias("passes"))


KNOWN_WORDS = rf"""
WITH words AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{3,}}'), lambda w: lower(regexp_replace(strip_accents(w), '[^\x00-\x7F]', '', 'g')))) AS w FROM documents),
vocab AS (SELECT lower(regexp_replace(strip_accents(unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]{{3,}}'))), '[^\x00-\x7F]', '', 'g')) AS w
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) UNION SELECT unnest({sorted(set(fixed.COMMON_FRENCH))}))
SELECT doc_id, count(*)::BIGINT AS tokens, round(count(v.w) / count(*), 6) AS ratio, count(*) >= 15 AND count(v.w) / count(*) >= 0.42 AS passes
FROM words LEFT JOIN vocab v USING (w) GROUP BY doc_id
"""


def recall_stats(spark, d):
    """How much of a benchmark text each document dealt to it holds: mean and upper median by language."""
    docs, bench = read(spark, d, "documents"), read(spark, d, "benchmark")
    joined = docs.withColumn("item_id", F.col("doc_id") % bench.count()).join(bench.select("item_id", F.col("text").alias("truth")), "item_id")
    scored = joined.select("lang", resolve.overlap(F.col("truth"), F.col("text")).alias("recall"))
    means = scored.groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 9).alias("mean_recall"))
    medians = resolve.upper_medians(scored, "lang", "recall").withColumnRenamed("lang", "_lang")
    return means.join(medians, F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang")


RECALL_STATS = """
WITH s AS (
  SELECT lang, len(list_intersect(a, b)) / greatest(1, len(a)) AS recall FROM (
    SELECT d.lang, list_distinct(regexp_extract_all(lower(b.text), '[a-zà-ÿ]{4,}')) AS a, list_distinct(regexp_extract_all(lower(d.text), '[a-zà-ÿ]{4,}')) AS b
    FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)))
SELECT lang, count(*)::BIGINT AS n, round(avg(recall), 9) AS mean_recall, list_sort(list(recall))[(count(*) // 2 + 1)::INTEGER] AS upper_median FROM s GROUP BY lang
"""


def priority_merge(spark, d):
    """Three sources by id, by title and by id, merged in order of trust with a confidence."""
    title = F.substring_index("text", " ", 2).alias("title")
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("osm"), title)
    talk = read(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.min_by("text", "turn").alias("reader"))
    other = resolve.first_value(read(spark, d, "documents").select(title, F.col("text").alias("archive"), F.col("doc_id").alias("ord")), "title", "archive", "ord")
    scan = read(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("scan"))
    # one title may stand over very many documents
    titled = looked_up(docs, stage(other, "titles"), "title", hub_keys(docs, "title"), "left")
    rows = titled.join(talk, "id", "left").join(scan, "id", "left")
    sources = [("osm", F.col("osm")), ("reader", F.col("reader")), ("archive", F.col("archive")), ("scan", F.col("scan"))]
    src, text = resolve.chosen(sources)
    rows = rows.withColumn("src", src).withColumn("body", text)
    return rows.select("id", "src", F.md5("body").alias("text_md5"), resolve.confidence(F.col("src"), F.col("body"), sources, "scan").alias("conf"))


PRIORITY_MERGE = """
WITH base AS (SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN text END AS osm, array_to_string(string_split(text, ' ')[1:2], ' ') AS title, text FROM documents),
talk AS (SELECT conv_id AS id, arg_min(text, turn) AS reader FROM conversations GROUP BY 1),
arch AS (SELECT array_to_string(string_split(text, ' ')[1:2], ' ') AS title, arg_min(text, doc_id) AS archive FROM documents WHERE array_to_string(string_split(text, ' ')[1:2], ' ') <> '' GROUP BY 1),
j AS (SELECT base.id, osm, reader, archive, b.text AS scan FROM base LEFT JOIN talk USING (id) LEFT JOIN arch USING (title) LEFT JOIN benchmark b ON b.item_id = base.id),
l AS (SELECT *, coalesce(length(osm), 0) AS a, coalesce(length(reader), 0) AS b, coalesce(length(archive), 0) AS c, coalesce(length(scan), 0) AS e FROM j),
p AS (SELECT *, CASE WHEN a >= 80 THEN 'osm' WHEN b >= 80 THEN 'reader' WHEN c >= 80 THEN 'archive' WHEN e >= 80 THEN 'scan'
  WHEN greatest(a, b, c, e) = 0 THEN NULL WHEN a = greatest(a, b, c, e) THEN 'osm' WHEN b = greatest(a, b, c, e) THEN 'reader' WHEN c = greatest(a, b, c, e) THEN 'archive' ELSE 'scan' END AS src FROM l),
q AS (SELECT *, CASE src WHEN 'osm' THEN osm WHEN 'reader' THEN reader WHEN 'archive' THEN archive WHEN 'scan' THEN scan END AS body FROM p),
w AS (SELECT *, list_distinct(regexp_extract_all(lower(body), '[a-zà-ÿ]{4,}')) AS ws FROM q)
SELECT id, src, md5(body) AS text_md5, CASE WHEN src IS NULL THEN 'none' WHEN src <> 'scan' THEN 'high'
  WHEN greatest(len(list_intersect(ws, regexp_extract_all(lower(coalesce(osm, '')), '[a-zà-ÿ]{4,}'))), len(list_intersect(ws, regexp_extract_all(lower(coalesce(reader, '')), '[a-zà-ÿ]{4,}'))),
    len(list_intersect(ws, regexp_extract_all(lower(coalesce(archive, '')), '[a-zà-ÿ]{4,}')))) / greatest(1, len(ws)) >= 0.5 THEN 'high' ELSE 'low' END AS conf
FROM w
"""


def line_filter(spark, d):
    """Lines of documents that read like prose, without up to three weak leading ones, joined again in order. A document
    stays one row throughout, so nothing is shuffled."""

    kept = read(spark, d, "documents").select("doc_id", T.filtered_lines(F.col("text")).alias("lines"))
    return kept.where(F.size("lines") > 0).select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("text_md5"))


LINE_FILTER = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
s AS (SELECT *, len(regexp_extract_all(line, '\p{L}')) AS letters, len(regexp_extract_all(line, '[^\s\p{Z}]')) AS solid, len(regexp_extract_all(line, '\p{Ll}')) AS lows,
  len(list_filter(regexp_extract_all(line, '[A-Za-zÀ-ÿ]{3,}'), lambda w: regexp_matches(w, '(?i)[aeiouyàâéèêîïôûü]'))) AS score FROM l),
g AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, max((score >= 4)::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS seen
  FROM s WHERE solid > 0 AND letters > 0 AND letters / solid >= 0.6 AND lows / letters >= 0.55 AND score >= 2)
SELECT doc_id, count(*)::BIGINT AS n_lines, md5(string_agg(line, chr(10) ORDER BY pos)) AS text_md5 FROM g WHERE seen = 1 OR n > 3 GROUP BY doc_id
"""


def panel_lines(spark, d):
    """Prose of every document: lines trimmed at their edges, title bands and weak leading lines dropped."""
    lines = read(spark, d, "documents").select("doc_id", T.prose_lines(F.col("text")).alias("p"))
    return lines.select("doc_id", F.size("p").alias("n_lines"), F.md5(F.array_join("p", "\n")).alias("prose_md5"))


def edge_trim(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.trim_edges(F.col("text")).alias("trimmed"))


#: The rules' fixed lists as SQL.
_SHORT = str(fixed.SHORT_FRENCH)
EDGE_TRIM = rf"""
WITH t AS (SELECT conv_id, turn, text, regexp_split_to_array(regexp_replace(text, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '[\s\p{{Z}}]+') AS w FROM conversations),
b AS (SELECT *, list_transform(w, lambda x: trim(x, '.,;:!?"''()[]«»')) AS bare FROM t),
g AS (SELECT *, list_transform(bare, lambda x: (length(x) >= 3 AND regexp_matches(lower(x), '[{fixed.VOWELS}]')) OR list_contains({_SHORT}, lower(x)) OR regexp_matches(x, '^\p{{Lu}}{{2,5}}$')) AS good FROM b),
p AS (SELECT *, list_position(good, true) AS first, len(good) + 1 - list_position(list_reverse(good), true) AS last FROM g)
SELECT conv_id, turn, CASE WHEN text IS NULL THEN NULL WHEN first > 0 THEN array_to_string(w[first:last], ' ') ELSE '' END AS trimmed FROM p
"""


def core_names(spark, d):
    part = read(spark, d, "part").select("p_partkey", "p_name", "p_size")
    street = F.concat(F.lit("Rue du "), F.col("p_size"), F.lit(" "), F.col("p_name"))
    return part.select("p_partkey", T.key_core(street).alias("core"), T.key_core_whole(street).alias("whole"))


#: The numbers from 1 to 50 as keys spell them.
_NUMBERS = """un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize dixsept dixhuit dixneuf vingt vingtetun vingtdeux vingttrois vingtquatre
vingtcinq vingtsix vingtsept vingthuit vingtneuf trente trenteetun trentedeux trentetrois trentequatre trentecinq trentesix trentesept trentehuit trenteneuf quarante quaranteetun
quarantedeux quarantetrois quarantequatre quarantecinq quarantesix quarantesept quarantehuit quaranteneuf cinquante""".split()
CORE_NAMES = f"""
WITH n AS (SELECT p_partkey, {_NUMBERS}[p_size] || regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS core FROM part)
SELECT p_partkey, core, 'ruedu' || core AS whole FROM n
"""


def expanded_names(spark, d):
    name = F.upper(F.concat(F.lit("bd des "), F.col("p_name")))
    return read(spark, d, "part").select("p_partkey", T.expand_abbreviations(name).alias("name"))


EXPANDED_NAMES = f"""
WITH t AS (SELECT p_partkey, list_transform(string_split('DES ' || upper(p_name), ' '), lambda w: w[1] || lower(w[2:])) AS w FROM part)
SELECT p_partkey, 'Boulevard ' || array_to_string(list_transform(w, lambda x: CASE WHEN list_contains({sorted(fixed.LOWERED - {"D'", "L'"})}, x) THEN lower(x) ELSE x END), ' ') AS name FROM t
"""


def cleaned_panels(spark, d):
    text = F.col("text")
    out = [T.clean_panel(text), T.clean_export(text), T.calm(F.upper(text)), T.calm_strict(F.upper(text))]
    return read(spark, d, "documents").select("doc_id", *[F.md5(c).alias(n) for c, n in zip(out, ("panel", "export", "calm", "strict"), strict=True)])


def osa_scores(spark, d):
    names = read(spark, d, "part").select("p_name").distinct()
    return names.select("p_name", T.osa(F.col("p_name"), F.lit("bleu widget")).alias("distance"))


ALL = {
    "fuzzy_topk": (fuzzy_topk, FUZZY_TOPK),
    "typo_pairs": (typo_pairs, TYPO_PAIRS),
    "fuzzy_reject": (fuzzy_reject, FUZZY_REJECT),
    "fold_keys": (fold_keys, FOLD_KEYS),
    "html_to_text": (html_to_text, HTML_TO_TEXT),
    "html_escaped": (html_escaped, HTML_ESCAPED),
    "link_crawl": (link_crawl, LINK_CRAWL),
    "shout_ratio": (shout_ratio, SHOUT_RATIO),
    "dehyphenated": (dehyphenated, DEHYPHENATED),
    "name_slugs": (name_slugs, NAME_SLUGS),
    "place_keys": (place_keys, PLACE_KEYS),
    "label_numbers": (label_numbers, LABEL_NUMBERS),
    "vowel_words": (vowel_words, VOWEL_WORDS),
    "known_words": (known_words, KNOWN_WORDS),
    "recall_stats": (recall_stats, RECALL_STATS),
    "priority_merge": (priority_merge, PRIORITY_MERGE),
    "line_filter": (line_filter, LINE_FILTER),
    "panel_lines": (panel_lines, None),
    "edge_trim": (edge_trim, EDGE_TRIM),
    "core_names": (core_names, CORE_NAMES),
    "expanded_names": (expanded_names, EXPANDED_NAMES),
    "cleaned_panels": (cleaned_panels, None),
    "osa_scores": (osa_scores, None),
}
