"""The driver's tables seen as the engine's tables, in Spark and as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import word_count


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Ids of a source that are numbered by one task.
BLOCK = 4096


def chapters(spark: SparkSession, sf_dir: str, total: bool = False) -> DataFrame:
    """documents as chapters: a source is a book, its documents are chapters in order of doc_id. `total` adds n, the number of the book's chapters.

    A chapter's number is its place in a block of BLOCK ids and what the source has in earlier blocks, so a source of a third of all rows is dealt to many tasks
    and only its blocks' counts meet in one.
    """
    docs = table(spark, sf_dir, "documents").withColumn("_block", F.coalesce(F.floor(F.col("doc_id") / BLOCK), F.lit(-(1 << 62))))
    before = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = docs.groupBy("source", "_block").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    blocks = blocks.withColumn("_total", F.sum("_n").over(Window.partitionBy("source"))) if total else blocks
    nth = F.row_number().over(Window.partitionBy("source", "_block").orderBy("doc_id"))
    placed = docs.withColumn("_nth", nth).join(blocks, ["source", "_block"])
    n = (F.col("_before") + F.col("_nth") - 1).cast("int")
    return placed.select(F.col("source").alias("book"), n.alias("chapter_index"), "doc_id", "lang", "text", *([F.col("_total").alias("n")] if total else [])).withColumn("words", word_count(F.col("text")))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as chapters: a conversation is a book, a role a label."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("book"), F.col("role").alias("label"), F.col("turn").alias("chapter_index"), "text")


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as score rows: three vectors are an item's targets, three components a condition's log-probabilities."""
    e = table(spark, sf_dir, "embeddings").withColumn("cond", F.explode(F.sequence(F.lit(0), F.lit(4))))
    item, target = F.floor(F.col("vec_id") / 3).cast("long"), (F.col("vec_id") % 3).cast("int")
    lp = F.transform(F.slice("embedding", 3 * F.col("cond") + 1, 3), lambda x: x.cast("double"))
    rows = e.select("cond", item.alias("item"), target.alias("target"), lp.alias("lp"))
    tokens = 100 + 10 * F.col("cond") * (F.col("item") % 5 + 1) + F.col("target")
    return rows.withColumns({"answer": ((F.col("target") + F.col("item")) % 3).cast("int"), "book": F.col("item") % 10, "tokens": tokens.cast("long")})


def likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as likelihood rows: nation is book, order is example, return flag is condition."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_extendedprice", "l_discount", "l_quantity", "l_linenumber")
    who = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    who = who.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    nll = F.round(F.col("l_extendedprice") * F.col("l_discount")).cast("long")
    return lines.join(who, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_returnflag").alias("cond"), F.col("n_name").alias("book"), F.col("l_orderkey").alias("example"), F.col("l_linenumber").alias("line"), nll.alias("nll"), F.col("l_quantity").cast("long").alias("tokens"))


def aliases(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """(book, label, alias): the k most frequent words of five letters or more of each source are its labels."""
    words = chapters(spark, sf_dir).select("book", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), 0)).alias("w")).select("book", F.lower("w").alias("label"))
    counts = words.groupBy("book", "label").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("n"), "label"))
    top = counts.withColumn("rank", rank).where(F.col("rank") <= k)
    return top.select("book", "label", F.explode(F.array("label", F.initcap("label"))).alias("alias"))


#: Ranks of a source's frequent words that stand for an ambiguous and a protected name.
AMBIGUOUS_RANK, PROTECTED_RANK = 60, 80
#: Consecutive documents of a source that are one chapter's sections.
SECTIONS = 4


def alias_files(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """(book, kind, label, label_no, alias): the k most frequent words of five letters or more of each source are principals, two rarer ones
    an ambiguous and a protected name."""
    words = chapters(spark, sf_dir).select("book", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]{5,}"), 0)).alias("w")).select("book", F.lower("w").alias("label"))
    rank = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("n"), "label"))
    top = words.groupBy("book", "label").agg(F.count("*").alias("n")).withColumn("rank", rank).where(F.col("rank") <= max(k, AMBIGUOUS_RANK, PROTECTED_RANK))
    kind = F.when(F.col("rank") <= k, "principal").when(F.col("rank") == AMBIGUOUS_RANK, "ambiguous").when(F.col("rank") == PROTECTED_RANK, "protected")
    return top.withColumn("kind", kind).where("kind is not null").select("book", "kind", "label", (F.col("rank") - 1).alias("label_no"), F.explode(F.array("label", F.initcap("label"))).alias("alias"))


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as examples: SECTIONS consecutive documents of a source are the sections of a chapter."""
    n = F.col("chapter_index")
    return chapters(spark, sf_dir).select("book", F.floor(n / SECTIONS).cast("int").alias("chapter_index"), (n % SECTIONS).cast("int").alias("chunk_index"), "text", F.lit(None).cast("string").alias("header"))


#: What the conversations' notes are about.
NOTE_LAYOUT = ((("First", ("a",)), ("Second", ("b",))), {"a": "What comes first?", "b": "What comes next?"}, ("First", "Second"), "a")


def representations(spark: SparkSession, sf_dir: str):
    """(keys, sources) of the catalogue: a conversation is a book, a role a label, and a role's n-th turn is chapter n; what is known of
    a label are words of its turns. The boundary is the label's number of turns."""
    from ..plans.catalogue import Layout, Sources

    n = F.row_number().over(Window.partitionBy("book", "label").orderBy("chapter_index")) - 1
    w = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r\f]+"), lambda x: x != "")
    tu = turns(spark, sf_dir).select(F.col("book").cast("string").alias("book"), "label", n.cast("int").alias("chapter_index"), w.alias("w"))
    part = lambda a, k: F.array_join(F.slice("w", a, k), " ")
    row = lambda source, q, q_no, pos, text, rating: F.struct(F.lit(source).alias("source"), q.alias("q"), q_no.cast("int").alias("q_no"), pos.cast("int").alias("pos"), text.alias("text"), rating.cast("int").alias("rating"))
    none, zero = F.lit(None), F.lit(0)
    notes = [row(s, F.lit(q), F.lit(i), zero, part(5 * i + 1, 5), none) for s in ("chapnotes", "renote") for i, q in enumerate("ab")]
    sentences = lambda s: F.transform(F.slice("w", 1, 6), lambda x, i: row(s, F.when(i % 2 == 0, "a").otherwise("b"), i % 2, i, x, 3 + F.length(x) % 3))
    ledger = F.transform(F.slice("w", 1, 9), lambda x, i: row("ledger", F.concat(F.lit("s"), (i % 3).cast("string")), i % 3, F.floor(i / 3), x, none))
    every = F.concat(F.array(*notes), sentences("renote_ent"), sentences("renote_x"), ledger)
    records = tu.select("book", "label", F.col("label").alias("name"), "chapter_index", F.explode(every).alias("x")).select("book", "label", "name", "chapter_index", "x.*")
    last = tu.groupBy("book", "label").agg((F.max("chapter_index") + 1).alias("boundary"), F.max_by("w", "chapter_index").alias("w"), F.min_by("w", "chapter_index").alias("first"))
    text = lambda source, x: F.struct(F.lit(source).alias("source"), x.alias("text"))
    sheet = lambda a, b: F.concat(F.lit("## Physicality And Personality\n"), a, F.lit("\n## Relationships\n"), b)
    whole = [text("v2", sheet(part(1, 5), part(6, 5))), text("second", sheet(part(3, 4), part(7, 20))), text("summary", F.array_join(F.slice("first", 1, 12), " "))]
    texts = last.select("book", "boundary", "label", F.explode(F.array(*whole)).alias("x"), F.lit(0).alias("pos")).select("book", "boundary", "label", "x.*", "pos")
    own = last.select("book", "boundary", "label", F.posexplode(F.slice("w", 1, 8)).alias("pos", "text"))
    own = own.select(F.lit("csum_f").alias("source"), "book", "boundary", "label", "pos", "text", (4 + F.length("text") % 2).cast("int").alias("rating"))
    names = spark.createDataFrame([], "book string, kind string, label string, label_no int, alias string")
    return last.select("book", "boundary", "label"), Sources(texts, records, names, own, Layout(*NOTE_LAYOUT))


# SQL twins of the adapters, as common table expressions.
CHAPTERS = r"""ch AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS chapter_index, doc_id, lang, text, len(regexp_extract_all(text, '\S+')) AS words FROM documents)"""
TURNS = "tu AS (SELECT conv_id AS book, role AS label, turn AS chapter_index, text FROM conversations)"
EVAL = """ev AS (SELECT c AS cond, vec_id // 3 AS item, vec_id % 3 AS target, list_transform(embedding[3*c+1:3*c+3], lambda x: CAST(x AS DOUBLE)) AS lp,
 (vec_id % 3 + vec_id // 3) % 3 AS answer, (vec_id // 3) % 10 AS book, 100 + 10 * c * ((vec_id // 3) % 5 + 1) + vec_id % 3 AS tokens
 FROM embeddings, (SELECT unnest(range(5)) AS c))"""
HITS = EVAL + """, hits AS (SELECT cond, item, target, book, answer, lp, tokens, CASE WHEN list_position(lp, list_max(lp)) - 1 = answer THEN 1 ELSE 0 END AS hit FROM ev)"""
JOINT = EVAL + """, g AS (SELECT cond, item, book, list(lp ORDER BY target) AS l, list(answer ORDER BY target) AS a FROM ev GROUP BY cond, item, book HAVING count(*) = 3),
 perms(p0, p1, p2) AS (VALUES (0,1,2),(0,2,1),(1,0,2),(1,2,0),(2,0,1),(2,1,0)),
 scored AS (SELECT g.*, p0, p1, p2, row_number() OVER (PARTITION BY cond, item ORDER BY l[1][p0+1] + l[2][p1+1] + l[3][p2+1] DESC, p0, p1, p2) AS rn FROM g, perms),
 jh AS (SELECT cond, item, book, t AS target, a[t+1] AS answer, CASE WHEN [p0, p1, p2][t+1] = a[t+1] THEN 1 ELSE 0 END AS hit FROM scored, (SELECT unnest(range(3)) AS t) WHERE rn = 1)"""
LIKELIHOODS = """lk AS (SELECT l_returnflag AS cond, n_name AS book, l_orderkey AS example, l_linenumber AS line, CAST(round(l_extendedprice * l_discount) AS BIGINT) AS nll, CAST(l_quantity AS BIGINT) AS tokens
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""
ALIASES = CHAPTERS + """, aw AS (SELECT book, lower(w) AS label FROM (SELECT book, unnest(regexp_extract_all(text, '[A-Za-z]{5,}')) AS w FROM ch)),
 al AS (SELECT book, label FROM (SELECT book, label, row_number() OVER (PARTITION BY book ORDER BY count(*) DESC, label) AS r FROM aw GROUP BY book, label) WHERE r <= 3),
 forms AS (SELECT DISTINCT book, label, f FROM (SELECT book, label, unnest([label, upper(label[1:1]) || label[2:], upper(label)]) AS f FROM al)),
 tok AS (SELECT doc_id, book, chapter_index, w, count(*) AS n FROM (SELECT doc_id, book, chapter_index, unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]+')) AS w FROM ch) GROUP BY ALL),
 named AS (SELECT t.doc_id, t.book, t.chapter_index, f.label, sum(n) AS n FROM tok t JOIN forms f ON t.book = f.book AND t.w = f.f GROUP BY ALL)"""


def item_units(window: bool) -> str:
    """un: units of documents as examples, with their pieces: words with an apostrophe that precedes them, and single other characters."""
    made = "SELECT book, c, 'k' || printf('%02d', k) AS unit, k AS chunk, text FROM ex"
    if window:
        made = "SELECT book, c, 'w' || printf('%02d', g) AS unit, NULL AS chunk, string_agg(text, chr(10) || chr(10) ORDER BY k) AS text FROM fo GROUP BY book, c, g"
    fold = """, fo AS (SELECT book, c, k, text, n, 0 AS g, 1 AS m, n AS s FROM ex WHERE k = 0 UNION ALL SELECT ex.book, ex.c, ex.k, ex.text, ex.n, CASE WHEN m >= 3 OR s >= 900 THEN g + 1 ELSE g END,
 CASE WHEN m >= 3 OR s >= 900 THEN 1 ELSE m + 1 END, CASE WHEN m >= 3 OR s >= 900 THEN ex.n ELSE s + ex.n END FROM fo JOIN ex ON ex.book = fo.book AND ex.c = fo.c AND ex.k = fo.k + 1)"""
    return f"""{CHAPTERS}, ex AS MATERIALIZED (SELECT book, (chapter_index // {SECTIONS})::INT AS c, (chapter_index % {SECTIONS})::INT AS k, x AS text, len(regexp_extract_all(x, '\\S+')) AS n FROM (SELECT *, trim(coalesce(text, ''), chr(10) || chr(9) || chr(13) || ' ') AS x FROM ch)){fold if window else ""},
 un AS MATERIALIZED (SELECT *, regexp_extract_all(text, '[’'']?[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]') AS p FROM ({made}))"""


def item_plan(window: bool = False, two: bool = False) -> str:
    """pl: each unit with its reason, labels, answer and masked text."""
    whole, suffix = "coalesce(k, 0) = 2" if two else "coalesce(k, 0) = ks", "__two" if two else ""
    return f"""{item_units(window)},
 rk AS (SELECT book, label, row_number() OVER (PARTITION BY book ORDER BY count(*) DESC, label) AS r FROM (SELECT book, lower(unnest(regexp_extract_all(text, '[A-Za-z]{{5,}}'))) AS label FROM ch) GROUP BY book, label),
 al AS MATERIALIZED (SELECT *, CASE WHEN r <= 3 THEN 'p' WHEN r = {AMBIGUOUS_RANK} THEN 'a' ELSE 'x' END AS kind FROM rk WHERE r <= 3 OR r IN ({AMBIGUOUS_RANK}, {PROTECTED_RANK})),
 fm AS (SELECT DISTINCT book, label, kind, r, f FROM (SELECT *, unnest([label, upper(label[1:1]) || label[2:], upper(label)]) AS f FROM al)),
 tk AS (SELECT book, c, unit, w, count(*) AS n FROM (SELECT book, c, unit, unnest(p) AS w FROM un) GROUP BY ALL),
 nm AS MATERIALIZED (SELECT t.book, t.c, t.unit, f.label, f.kind, f.r, sum(n) AS n FROM tk t JOIN fm f ON t.book = f.book AND t.w = f.f GROUP BY ALL),
 si AS (SELECT book, label, c AS since FROM (SELECT *, row_number() OVER (PARTITION BY book, label ORDER BY c) AS o FROM (SELECT DISTINCT book, label, c FROM nm WHERE kind = 'p')) WHERE o = 2),
 li AS (SELECT nm.*, coalesce(since >= c, true) AS early, row_number() OVER (PARTITION BY book, c, unit ORDER BY md5(printf('%s__c%03d__%s', book, c, unit) || '{suffix}:' || label)) - 1 AS id FROM nm LEFT JOIN si USING (book, label) WHERE kind = 'p'),
 la AS (SELECT book, c, unit, count(*) AS k, bool_or(early) AS early, string_agg(label, ',' ORDER BY r) AS labels, string_agg(label || '=' || id, ',' ORDER BY r) AS answer, string_agg(label || '=' || n::BIGINT, ',' ORDER BY r) AS mentions FROM li GROUP BY ALL),
 ma AS (SELECT li.book, li.c, li.unit, map_from_entries(list((f, id))) AS m FROM li JOIN fm USING (book, label) GROUP BY ALL),
 ot AS (SELECT book, c, unit, bool_or(kind = 'a') AS amb, bool_or(kind = 'x') AS pro FROM nm GROUP BY ALL),
 bk AS (SELECT book, list(label) AS names, count(*) AS ks FROM al WHERE kind = 'p' GROUP BY book),
 pl AS (SELECT printf('%s__c%03d__%s', book, c, unit) || '{suffix}' AS item_id, book, c AS chapter_index, labels, answer, mentions, array_to_string(list_transform(p, lambda w: coalesce('[CHAR ' || m[w] || ']', w)), '') AS masked,
  CASE WHEN text = '' THEN 'no_text' WHEN pro THEN 'protected' WHEN NOT {whole} THEN 'not_all_named' WHEN early THEN 'too_early' WHEN amb THEN 'ambiguous'
  WHEN len(list_filter(p, lambda w: m[w] IS NULL AND list_contains(names, lower(ltrim(w, '’'''))) AND w <> lower(w))) > 0 THEN 'leftover' END AS reason
  FROM un JOIN bk USING (book) LEFT JOIN la USING (book, c, unit) LEFT JOIN ma USING (book, c, unit) LEFT JOIN ot USING (book, c, unit))"""


def representation_sql() -> str:
    """Families of the catalogue over conversations, each by its own rule."""
    rule = "-" * 100
    ask = lambda q: f"'Question: {NOTE_LAYOUT[1][q]}' || chr(10) || chr(10) || "
    nl2 = "chr(10) || chr(10)"
    snippet = "'<snippet ' || c || '>' || chr(10) || "
    under = lambda head, q, body: f"'## {head}' || coalesce({nl2} || {ask(q)} {body}, '')"
    return rf"""WITH {TURNS}, tw AS MATERIALIZED (SELECT book::VARCHAR AS book, label, row_number() OVER (PARTITION BY book, label ORDER BY chapter_index) - 1 AS c, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+') AS w FROM tu),
 k AS (SELECT book, label, (max(c) + 1)::INT AS n, arg_max(w, c) AS w, arg_min(w, c) AS f FROM tw GROUP BY book, label),
 rt AS (SELECT *, CASE WHEN i % 2 = 0 THEN 'a' ELSE 'b' END AS q, 3 + length(x) % 3 AS r FROM (SELECT book, label, c, unnest(w[1:6]) AS x, unnest(range(least(len(w), 6))) AS i FROM tw)),
 rc AS (SELECT book, label, c, q, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (r = 5), '') AS t, coalesce(string_agg(x, ' ' ORDER BY i) FILTER (r >= 4), '') AS t4 FROM rt GROUP BY ALL),
 ok AS (SELECT book, label FROM (SELECT DISTINCT book, label, c FROM rc) JOIN k USING (book, label) GROUP BY book, label, n HAVING count(*) = n),
 qa AS (SELECT book, label, string_agg({snippet} array_to_string(w[1:5], ' '), chr(10) ORDER BY c) AS a, string_agg({snippet} array_to_string(w[6:10], ' '), chr(10) ORDER BY c) AS b,
  string_agg({snippet} array_to_string(w[1:5], ' '), chr(10) ORDER BY c) FILTER (len(w) > 0) AS a1, string_agg({snippet} array_to_string(w[6:10], ' '), chr(10) ORDER BY c) FILTER (len(w) > 5) AS b1 FROM tw GROUP BY ALL),
 en AS (SELECT book, label, string_agg({snippet} t, chr(10) ORDER BY c) FILTER (q = 'a' AND t <> '') AS a, string_agg({snippet} t, chr(10) ORDER BY c) FILTER (q = 'b' AND t <> '') AS b,
  string_agg({snippet} t4, chr(10) ORDER BY c) FILTER (q = 'a' AND t4 <> '') AS a4, string_agg({snippet} t4, chr(10) ORDER BY c) FILTER (q = 'b' AND t4 <> '') AS b4 FROM rc GROUP BY ALL),
 ar AS (SELECT tw.book, tw.label, string_agg('<snippet ' || tw.c || '>' || chr(10) || coalesce(x.t, '') || chr(10), '' ORDER BY tw.c) AS a, string_agg('<snippet ' || tw.c || '>' || chr(10) || coalesce(y.t, '') || chr(10), '' ORDER BY tw.c) AS b
  FROM tw LEFT JOIN rc x ON x.q = 'a' AND x.book = tw.book AND x.label = tw.label AND x.c = tw.c LEFT JOIN rc y ON y.q = 'b' AND y.book = tw.book AND y.label = tw.label AND y.c = tw.c GROUP BY ALL),
 le AS (SELECT book, label, c, list(x ORDER BY i // 3, i % 3) AS l FROM (SELECT book, label, c, unnest(w[1:9]) AS x, unnest(range(least(len(w), 9))) AS i FROM tw) GROUP BY ALL),
 lt AS (SELECT book, label, string_agg('Chapter ' || (c + 1) || ':' || chr(10) || array_to_string(list_transform(l, lambda x: '- ' || x), chr(10)), {nl2} ORDER BY c) AS f, string_agg('Chapter ' || (c + 1) || ':' || chr(10) || array_to_string(list_transform(l[1:2], lambda x: '- ' || x), chr(10)), {nl2} ORDER BY c) AS c2 FROM le GROUP BY ALL),
 sh AS (SELECT *, '## Physicality And Personality' || chr(10) || array_to_string(w[1:5], ' ') AS ph, '## Physicality And Personality' || chr(10) || array_to_string(w[1:5], ' ') || chr(10) || '## Relationships' || chr(10) || array_to_string(w[6:10], ' ') AS v2,
  '## Physicality And Personality' || chr(10) || array_to_string(w[3:6], ' ') || chr(10) || '## Relationships' || chr(10) || array_to_string(w[7:26], ' ') AS s2, array_to_string(f[1:12], ' ') AS su FROM k),
 al AS (SELECT 'v2' AS condition, book, n, label, v2 AS t FROM sh UNION ALL SELECT 'v2_norel', book, n, label, ph FROM sh UNION ALL SELECT 'v2_sec_physical', book, n, label, ph FROM sh
  UNION ALL SELECT 'second_nest', book, n, label, regexp_replace(s2, '(^|\n)(#+) ', '\1#\2 ', 'g') FROM sh
  UNION ALL SELECT 'combo_short', book, n, label, '#### Sheet' || chr(10) || v2 || {nl2} || '#### Second sheet' || chr(10) || s2 || {nl2} || '#### Summary' || chr(10) || su FROM sh WHERE su <> ''
  UNION ALL SELECT 'chapnotes', book, n, label, {under('First', 'a', 'a1')} || {nl2} || {under('Second', 'b', 'b1')} FROM qa JOIN k USING (book, label)
  UNION ALL SELECT 'renote', book, n, label, {under('First', 'a', 'a')} || {nl2} || {under('Second', 'b', 'b')} FROM qa JOIN k USING (book, label)
  UNION ALL SELECT 'renote_ent', book, n, label, {under('First', 'a', 'a')} || {nl2} || {under('Second', 'b', 'b')} FROM en JOIN k USING (book, label) JOIN ok USING (book, label)
  UNION ALL SELECT 'renote_ent4', book, n, label, {under('First', 'a', 'a4')} || {nl2} || {under('Second', 'b', 'b4')} FROM en JOIN k USING (book, label) JOIN ok USING (book, label)
  UNION ALL SELECT 'renote_x', book, n, label, trim('## First' || {nl2} || {ask('a')} a || '{rule}' || chr(10) || '## Second' || {nl2} || {ask('b')} b, chr(10) || ' ') FROM ar JOIN k USING (book, label) JOIN ok USING (book, label)
  UNION ALL SELECT 'renote_x_sec1', book, n, label, trim('## Second' || {nl2} || {ask('b')} b, chr(10) || ' ') FROM ar JOIN k USING (book, label) JOIN ok USING (book, label)
  UNION ALL SELECT 'ledger_full', book, n, label, f FROM (SELECT book, label, f FROM lt) JOIN (SELECT book, label, n FROM k) USING (book, label) UNION ALL SELECT 'ledger_c2', book, n, label, c2 FROM lt JOIN k USING (book, label)
  UNION ALL SELECT 'sheet_csum_fd_flat', book, n, label, coalesce((SELECT string_agg(x, ' ' ORDER BY i) FROM (SELECT x, min(i) AS i FROM (SELECT unnest(w[1:8]) AS x, unnest(range(least(len(w), 8))) AS i) WHERE 4 + length(x) % 2 = 5 GROUP BY x)), '') FROM k WHERE len(w) > 0
  UNION ALL SELECT 'v2+last1', book, n, label, rtrim(v2, ' ' || chr(10)) || {nl2} || '### Latest chapters' || chr(10) || 'Chapter ' || n || ': ' || CASE WHEN len(w) = 0 THEN 'Not in this chapter.' ELSE array_to_string(w[1:10], ' ') END FROM sh)
SELECT condition, book, n::BIGINT AS boundary, label, md5(t) AS text, len(regexp_extract_all(t, '[^ \t\n\r\f]+'))::BIGINT AS words FROM al"""
