"""Text, matching and comparison queries over documents, pages, conversations and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import masking as K
from ..functions import text as X
from ..operators import analytics as A
from ..operators import compare as C
from ..operators import matching as M
from ..operators import segment as S
from ..session import spread, table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


_DOT = "list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) / sqrt(list_inner_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))"


@query(f"SELECT q, r, rank FROM (SELECT a.vec_id AS q, b.vec_id AS r, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 5")
def vector_topk(spark, sf):
    """Queries are the rows whose id is divisible by 20, against all rows."""
    v = C.unit_vectors(table(spark, sf, "embeddings"), "embedding")
    return C.nearest(v.where("vec_id % 20 = 0"), v, "vec_id", "vec_id", "embedding", 5).select("q", "r", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT q, r, rank FROM (SELECT a.vec_id AS q, b.vec_id AS r, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_DOT}, 6) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) WHERE rank <= 5")
def vector_index_topk(spark, sf):
    """The same search through the inverted file, with all of its cells: its exact way."""
    v = C.unit_vectors(table(spark, sf, "embeddings"), "embedding")
    index = C.VectorIndex(v, "vec_id", "embedding")
    return index.search(v.where("vec_id % 20 = 0"), "vec_id", "embedding", 5, len(index.centroids)).select("q", "r", F.col("rank").cast("long").alias("rank"))


@query("SELECT true AS reached, true AS fewer_cells")
def vector_index_recall(spark, sf):
    """Whether the inverted file finds nine of ten of the exact results in fewer cells than all."""
    v = C.unit_vectors(table(spark, sf, "embeddings"), "embedding")
    index = C.VectorIndex(v, "vec_id", "embedding")
    probes, share = index.probes_for(v.where("vec_id % 20 = 0"), "vec_id", "embedding", 5)
    return spark.createDataFrame([(share >= 0.9, probes < len(index.centroids))], "reached boolean, fewer_cells boolean")


@query(f"""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b, round({_DOT}, 6) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1)
 SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS rn FROM p) WHERE rn = 1 UNION SELECT a, b FROM (SELECT a, b, row_number() OVER (PARTITION BY b ORDER BY score DESC, a) AS rn FROM p) WHERE rn = 1""")
def vector_mutual(spark, sf):
    """The even and the odd passages as two sides that hold the whole table, each passage with its best partner on the other."""
    v = C.unit_vectors(table(spark, sf, "embeddings"), "embedding")
    return C.mutual_best(C.best_pairs(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1"), "vec_id", "embedding"))


@query()
def vector_mutual_all(spark, sf):
    """Two sides that hold the whole table, the ids divisible by 20 and all other rows; each row with its best partner on the other side.

    Too many pairs for a SQL oracle; tested against a loop.
    """
    v = C.unit_vectors(table(spark, sf, "embeddings"), "embedding")
    return C.mutual_best(C.best_pairs(v.where("vec_id % 20 = 0"), v.where("vec_id % 20 != 0"), "vec_id", "embedding"))


_TOK = "unnest(regexp_extract_all(lower({0}.text), '[\\p{{L}}\\p{{N}}_]+'))"


@query(f"""WITH i AS (SELECT item_id, token, count(*) AS n FROM (SELECT item_id, {_TOK.format('benchmark')} AS token FROM benchmark) GROUP BY 1, 2), d AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, {_TOK.format('documents')} AS token FROM documents) GROUP BY 1, 2),
 ti AS (SELECT item_id, sum(n) AS t FROM i GROUP BY 1), td AS (SELECT doc_id, sum(n) AS t FROM d GROUP BY 1), p AS (SELECT item_id, doc_id, sum(least(i.n, d.n)) AS common FROM i JOIN d USING (token) GROUP BY 1, 2)
 SELECT item_id, doc_id, CAST(floor(common * 1000000 / (ti.t + td.t - common) + 0.5) AS BIGINT) AS millionths FROM p JOIN ti USING (item_id) JOIN td USING (doc_id) WHERE common / (ti.t + td.t - common) >= 0.3""")
def jaccard_align(spark, sf):
    """Benchmark passages (a stated query set) against all documents."""
    side = lambda name, key: spread(table(spark, sf, name).select(key, "text")).select(key, X.tokens(F.col("text")).alias("tokens"))
    j = C.weighted_jaccard(side("benchmark", "item_id"), side("documents", "doc_id"), "item_id", "doc_id", 0.3)
    return j.select("item_id", "doc_id", F.floor(F.col("jaccard") * 1000000 + 0.5).alias("millionths"))


@query("""WITH c AS (SELECT c_custkey AS id, 'Account of ' || c_name || ' since ' || c_nationkey AS line FROM customer), k AS (SELECT id, line, regexp_replace(line, '[0-9]+', '#', 'g') || ' ' || (id // 10) AS skeleton, regexp_extract_all(line, '[0-9]+') AS nums FROM c)
 SELECT a.id AS a, b.id AS b FROM k a JOIN k b ON a.skeleton = b.skeleton AND a.id < b.id AND a.nums <> b.nums""")
def digit_skeleton_diff(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("Account of "), "c_name", F.lit(" since "), F.col("c_nationkey").cast("string")).alias("line"))
    k = c.select("id", "line", F.concat_ws(" ", X.skeleton(F.col("line")), F.floor(F.col("id") / 10).cast("string")).alias("skeleton"), X.numbers(F.col("line")).alias("numbers"))
    return C.same_but_numbers(k, k).select("a", "b")


# The oracle's own definition: an address, else a long code, else three numbers with separators, else a number of three digits or more.
_ANY_DIGIT = "[\\x{30}-\\x{39}\\x{660}-\\x{669}]"
_SEPARATED = f"{_ANY_DIGIT}{{1,4}}[-./]{_ANY_DIGIT}{{1,2}}[-./]{_ANY_DIGIT}{{1,4}}"
_GUARDED = f"[\\w.%+-]+@[A-Za-z\\d.-]+\\.[A-Za-z][A-Za-z]+|[A-Z][A-Z]\\d\\d[A-Za-z\\d]{{10,}}|{_SEPARATED}|{_ANY_DIGIT}{_ANY_DIGIT}{_ANY_DIGIT}+"
#: A number in Arabic digits, a foreign IBAN and a dotted date are added to every text.
_PLANTED = "text || ' رقم ' || translate(CAST(doc_id * 7919 + 100 AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩') || ' DE89370400440532013' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || ' 5.3.2024'"


def _planted(spark, sf):
    number = F.translate((F.col("doc_id") * 7919 + 100).cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    code = F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0")
    return spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.concat("text", F.lit(" رقم "), number, F.lit(" DE89370400440532013"), code, F.lit(" 5.3.2024")).alias("t"))


@query(f"""SELECT doc_id, CAST(len(t) AS BIGINT) AS n, array_to_string(t, ' ') AS tokens
 FROM (SELECT doc_id, regexp_extract_all(t, '{_GUARDED}') AS t FROM (SELECT doc_id, {_PLANTED} AS t FROM documents)) WHERE len(t) > 0""")
def protected_tokens(spark, sf):
    # a generated column is not filtered below its generator, so each text is matched once
    d = _planted(spark, sf).select("doc_id", F.explode(F.array(X.protected_tokens(F.col("t")))).alias("t"))
    return d.where(F.size("t") > 0).select("doc_id", F.size("t").cast("long").alias("n"), F.array_join("t", " ").alias("tokens"))


@query(r"""SELECT doc_id, regexp_replace(text, '([A-Za-z0-9])[A-Za-z0-9._%+-]*@([A-Za-z0-9-]+\.[A-Za-z0-9.-]+)', '\1•••@\2', 'g') AS masked
 FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+')""")
def mask_emails(spark, sf):
    d = table(spark, sf, "documents").where(F.col("text").rlike("[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\\.[A-Za-z0-9.-]+"))
    return d.select("doc_id", K.email(F.col("text")).alias("masked"))


_NINE = "[0-9٠-٩۰-۹](?: ?[0-9٠-٩۰-۹]){8,}"
_CALLED = "text || ' 055 123 4567 and ' || (123456000 + doc_id) || ' order 20240305, 12345678, ٠٥٥١٢٣٤٥٦٧'"


@query(f"""WITH t AS (SELECT doc_id, string_split(regexp_replace({_CALLED}, '({_NINE})', chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS parts FROM documents),
 p AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM t),
 r AS (SELECT doc_id, i, part, CASE WHEN contains(part, chr(2)) THEN split_part(part, chr(2), 1) END AS run FROM p),
 k AS (SELECT *, length(regexp_extract(run, '(?:[0-9٠-٩۰-۹] ?){{3}}[0-9٠-٩۰-۹]$')) AS shown FROM r)
 SELECT doc_id, string_agg(CASE WHEN run IS NULL THEN part ELSE regexp_replace(left(run, length(run) - shown), '[^ ]', '•', 'g') || right(run, shown)
 || substr(part, length(run) + 2) END, '' ORDER BY i) AS masked FROM k GROUP BY 1""")
def mask_long_numbers(spark, sf):
    """Numbers of nine digits or more, also spaced and in Arabic digits; shorter ones and dates stay."""
    called = F.concat("text", F.lit(" 055 123 4567 and "), (F.col("doc_id") + 123456000).cast("string"), F.lit(" order 20240305, 12345678, ٠٥٥١٢٣٤٥٦٧"))
    return table(spark, sf, "documents").select("doc_id", K.long_numbers(called).alias("masked"))


@query("SELECT c_custkey, regexp_replace(left(c_name, length(c_name) - 4), '.', '•', 'g') || right(c_name, 4) AS masked FROM customer")
def mask_identifiers(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", K.tail4(F.col("c_name")).alias("masked"))


@query("SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS running FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1 OR sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 600")
def history_budget(spark, sf):
    return M.budget_newest(table(spark, sf, "conversations"), "conv_id", "turn", F.length("text"), 600).select("conv_id", "turn", "running")


@query()
def html_lines(spark, sf):
    """Block HTML to lines; the rules are a chain of rewrites that is tested on fixtures."""
    return spread(table(spark, sf, "pages").select("page_id", "html")).select("page_id", F.posexplode(X.html_lines(F.col("html"))).alias("line", "text"))


_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS ln FROM documents)"


@query(f"""WITH m AS (SELECT doc_id, CASE WHEN ln % 7 = 0 THEN '--- Page ' || (ln // 7 + 1) || ' ---' ELSE line END AS line, ln FROM {_LINES}),
 p AS (SELECT *, coalesce(last_value(CAST(nullif(regexp_extract(line, '^--- Page ([0-9]+) ---$', 1), '') AS INT) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY ln), 1) AS page, regexp_matches(line, '^--- Page [0-9]+ ---$') AS mk FROM m)
 SELECT doc_id, ln, page, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY ln) - max(CAST(mk AS INT)) OVER (PARTITION BY doc_id, page ORDER BY ln) AS INT) AS line FROM p""")
def page_line_numbers(spark, sf):
    """No document holds page markers: every seventh line becomes one."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "t")).withColumn("ln", F.col("i").cast("long") + 1)
    d = d.withColumn("t", F.when(F.col("ln") % 7 == 0, F.concat(F.lit("--- Page "), (F.floor(F.col("ln") / 7) + 1).cast("string"), F.lit(" ---"))).otherwise(F.col("t")))
    return M.page_lines(d, "doc_id", "ln", "t").select("doc_id", "ln", "page", F.col("line").cast("int").alias("line"))


@query(f"""WITH l AS (SELECT doc_id, ln, line, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY ln) - length(line) - 1 AS BIGINT) AS pos FROM {_LINES}), k AS (SELECT l.doc_id, pos, length(text) AS n FROM l JOIN documents USING (doc_id) WHERE length(line) < 30 AND line <> '')
 SELECT doc_id, pos, coalesce(lead(pos) OVER (PARTITION BY doc_id ORDER BY pos), n) AS section_end FROM k""")
def section_spans(spark, sf):
    """Short lines open sections."""
    from pyspark.sql.window import Window

    d = table(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("n"), F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    w = Window.partitionBy("doc_id").orderBy("ln")
    k = d.withColumn("pos", F.sum(F.length("line") + 1).over(w) - F.length("line") - 1).where((F.length("line") < 30) & (F.col("line") != ""))
    return M.section_spans(k, "doc_id", "pos", "n").select("doc_id", "pos", "section_end")


ANCHORS = (("grant", "g1", "licensed under", 5), ("grant", "g1", "all rights reserved", 3), ("grant", "g2", "version 2.0", 4), ("insult", "g3", "idiot", 5), ("insult", "g3", "clown", 4), ("insult", "g4", "worthless", 2))
_VALUES = ", ".join(f"('{t}', '{g}', '{a}', {w})" for t, g, a, w in ANCHORS)


@query(f"""WITH a(template, grp, anchor, weight) AS (VALUES {_VALUES}), c AS (SELECT template, sum(m) AS ceiling FROM (SELECT template, grp, max(weight) AS m FROM a GROUP BY 1, 2) GROUP BY 1),
 h AS (SELECT doc_id, template, grp, max(weight) AS w FROM documents JOIN a ON contains(lower(text), anchor) GROUP BY 1, 2, 3), s AS (SELECT doc_id, template, CAST(sum(w) AS DOUBLE) / max(ceiling) AS score FROM h JOIN c USING (template) GROUP BY 1, 2)
 SELECT doc_id, template, CAST(round(score * 10000) AS BIGINT) AS score, CAST(round((score - coalesce(next, 0)) * 10000) AS BIGINT) AS margin FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template) AS rn, lead(score) OVER (PARTITION BY doc_id ORDER BY score DESC, template) AS next FROM s) WHERE rn = 1""")
def classify_scores(spark, sf):
    """A bounded vocabulary of anchors in one expression over each text, and the best template with its lead."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.lower("text").alias("t"))
    hits = d.select("doc_id", F.explode(M.anchor_weights(F.col("t"), ANCHORS)).alias("h")).select("doc_id", "h.*")
    best = A.best_with_margin(A.category_scores(hits, "doc_id"), "doc_id", "template")
    return best.select("doc_id", "template", F.round(F.col("score") * 10000).cast("long").alias("score"), F.round(F.col("margin") * 10000).cast("long").alias("margin"))


#: Anchors against a template have a negative weight.
AGAINST = (*ANCHORS, ("grant", "n1", "clown", -1), ("grant", "n2", "worthless", -1), ("insult", "n3", "version 2.0", -1), ("plain", "g5", "the", 1), ("plain", "g6", "e", 3), ("plain", "n4", "licensed under", -1))


@query("WITH a(template, grp, anchor, weight) AS (VALUES " + ", ".join(f"('{t}', '{g}', '{a}', {w})" for t, g, a, w in AGAINST) + """), c AS (SELECT template, sum(m) AS ceiling FROM (SELECT template, grp, max(weight) AS m FROM a WHERE weight > 0 GROUP BY 1, 2) GROUP BY 1),
 h AS (SELECT doc_id, template, grp, max(weight) AS w FROM documents JOIN a ON contains(lower(text), anchor) GROUP BY 1, 2, 3), s AS (SELECT doc_id, template, greatest(0, CAST(coalesce(sum(w) FILTER (w > 0), 0) AS DOUBLE) / max(ceiling) - least(0.3::DOUBLE * count(*) FILTER (w < 0), 0.6::DOUBLE)) AS score FROM h JOIN c USING (template) GROUP BY 1, 2)
 SELECT doc_id, template, CAST(floor(score * 10000 + 0.5) AS BIGINT) AS score, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template) AS rank FROM s""")
def template_ranks(spark, sf):
    """Every template of a document with its rank; evidence against it takes off."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.lower("text").alias("t"))
    hits = d.select("doc_id", F.explode(M.anchor_weights(F.col("t"), AGAINST)).alias("h")).select("doc_id", "h.*")
    ranked = A.ranked_templates(A.category_scores(hits, "doc_id"), "doc_id", "template")
    return ranked.select("doc_id", "template", F.floor(F.col("score") * 10000 + 0.5).alias("score"), F.col("rank").cast("long").alias("rank"))


SIGNALS = (("rights", "all rights reserved"), ("license", "licen[cs]ed? under"), ("insult", "idiot|clown|moron"), ("account", "[a-z0-9]+@[a-z0-9]+"), ("license", "permission is hereby granted"))


@query("WITH s(signal, pattern) AS (VALUES " + ", ".join(f"('{s}', '{p}')" for s, p in SIGNALS) + ") SELECT signal, count(DISTINCT doc_id) AS n FROM documents JOIN s ON regexp_matches(lower(text), pattern) GROUP BY 1")
def signal_counts(spark, sf):
    """Documents by signal, each signal once a document."""
    d = spread(table(spark, sf, "documents").select("text")).select(F.lower("text").alias("t"))
    found = d.select(F.explode(M.pattern_hits(F.col("t"), SIGNALS)).alias("signal"))
    return found.groupBy("signal").agg(F.count("*").alias("n"))


@query()
def document_chunks(spark, sf):
    """Lossless chunks; the cut is sequential, so it is tested on its contract instead."""
    return S.chunks(table(spark, sf, "documents"), "doc_id", "text")


_WORDS = "regexp_extract_all(text, '[^ \\t\\n\\r]+')"


@query(f"SELECT doc_id, i // 10 AS no, array_to_string(list_slice(w, i + 1, i + 20), ' ') AS window_text FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), 10)) AS i FROM (SELECT doc_id, {_WORDS} AS w FROM documents))")
def word_windows(spark, sf):
    w = F.regexp_extract_all("text", F.lit("[^ \\t\\n\\r]+"), 0)
    return table(spark, sf, "documents").select("doc_id", w.alias("w")).select("doc_id", F.posexplode(X.words_windows(F.col("w"))).alias("no", "window_text")).withColumn("no", F.col("no").cast("long"))


@query("""SELECT doc_id, CAST(floor(a / 2.2 + d + (length(text) - a - d) / 4.0) AS BIGINT) + 16 AS n_tokens, CASE WHEN length(text) <= 300 THEN text
 ELSE left(text, 200) || chr(10) || '...' || chr(10) || right(text, 100) END AS clip FROM (SELECT *,
 len(list_filter(string_split(text, ''), lambda c: unicode(c) BETWEEN 1536 AND 1791 AND NOT regexp_matches(c, '[0-9٠-٩۰-۹]'))) AS a,
 length(text) - length(regexp_replace(text, '\\pN', '', 'g')) AS d FROM documents)""")
def clip_and_estimate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.token_estimate(F.col("text")).alias("n_tokens"), X.head_tail(F.col("text"), 200, 100).alias("clip"))


@query("SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) < 40 AS too_short FROM documents")
def too_short(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.length(F.regexp_replace("text", "\\s", "")) < 40).alias("too_short"))
