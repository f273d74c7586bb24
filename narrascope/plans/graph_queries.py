"""Queries on names: references, closure, labels, matching, relations from descriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrascope.operators import cooccurrence as co
from narrascope.operators import coref, labels
from narrascope.operators import relations as rel
from narrascope.operators.frames import saved, table
from narrascope.plans import name_tables as n
from narrascope.plans.base import query

CLOSED = f"""RECURSIVE {n.NAMED},
edges AS MATERIALIZED ({n.EDGES["partial"]}),
closed AS (SELECT book_id, src, dst FROM edges UNION SELECT c.book_id, c.src, e.dst FROM closed c JOIN edges e ON e.book_id = c.book_id AND e.src = c.dst),
far AS MATERIALIZED (SELECT * FROM closed WHERE src <> dst)"""


def names(spark: SparkSession, folder: str) -> DataFrame:
    return saved(n.names(n.top_words(spark, folder)), "names")


def closed(found: DataFrame) -> DataFrame:
    return coref.closure(coref.partial_edges(found))


@query(f"WITH {n.NAMED} {n.EDGES['partial']}")
def partial_reference(spark, folder):
    return coref.partial_edges(names(spark, folder))


@query(f"WITH {n.NAMED} {n.EDGES['nickname']}")
def nickname_similarity(spark, folder):
    return coref.nickname_edges(names(spark, folder))


@query(f"WITH {n.NAMED} {n.EDGES['title']}")
def title_resolution(spark, folder):
    top = n.top_words(spark, folder)
    return coref.title_edges(n.names(top), n.genders(top))


@query(f"WITH {n.NAMED} {' UNION '.join(n.EDGES.values())}")
def reference_edges(spark, folder):
    top = n.top_words(spark, folder)
    return coref.reference_edges(saved(n.names(top), "names"), n.genders(top))


@query(f"WITH {CLOSED} SELECT book_id, src, dst FROM far")
def coref_closure(spark, folder):
    return closed(names(spark, folder))


@query(
    f"""WITH {CLOSED}, mutual AS (SELECT a.* FROM far a JOIN far b ON a.book_id = b.book_id AND a.src = b.dst AND a.dst = b.src),
stays AS (SELECT * FROM far EXCEPT SELECT * FROM mutual WHERE string_split(src, ' ') > string_split(dst, ' '))
SELECT book_id, k AS gram_key FROM listed WHERE (book_id, k) NOT IN (SELECT (book_id, src) FROM stays)"""
)
def unique_characters(spark, folder):
    found = names(spark, folder)
    return coref.unique_names(found, closed(found)).select("book_id", "gram_key")


def name_features(found: DataFrame) -> DataFrame:
    return found.select("book_id", "gram_key", F.length("gram_key").alias("count"), (F.length("gram_key") % 5).alias("count_st"))


_SUMS = [f"coref_{kind}_{c}" for kind in ("shorter", "longer") for c in ("count", "count_st")]


@query(
    f"""WITH {CLOSED}, f AS (SELECT book_id, k, length(k) AS count, length(k) % 5 AS count_st FROM listed),
e AS (SELECT book_id, src AS k, dst AS o, 'longer' AS kind FROM far UNION ALL SELECT book_id, dst, src, 'shorter' FROM far)
SELECT f.book_id, f.k AS gram_key, """
    + ", ".join(f"coalesce(max((kind = '{kind}')::INT), 0) AS coref_{kind}" for kind in ("shorter", "longer"))
    + ", "
    + ", ".join(f"coalesce(sum(o.{c}) FILTER (kind = '{kind}'), 0)::BIGINT AS coref_{kind}_{c}" for kind in ("shorter", "longer") for c in ("count", "count_st"))
    + " FROM f LEFT JOIN e ON e.k = f.k AND e.book_id = f.book_id LEFT JOIN f o ON o.k = e.o AND o.book_id = f.book_id GROUP BY ALL"
)
def coref_features(spark, folder):
    found = names(spark, folder)
    return coref.neighbour_features(closed(found), name_features(found), ["count", "count_st"])


def _pair_scores(found: DataFrame) -> DataFrame:
    return coref.ordered_pairs(found).withColumn("cooc", ((F.length("gram1") * 3 + F.length("gram2")) % 7).cast("bigint"))


PAIR_SUMS = f"""WITH {CLOSED}, near AS (SELECT book_id, k AS g, k AS m, 'e' AS kind FROM listed UNION ALL SELECT book_id, src, dst, 'l' FROM far UNION ALL SELECT book_id, dst, src, 's' FROM far),
p AS (SELECT a.book_id, a.k AS g1, b.k AS g2, ((length(a.k) * 3 + length(b.k)) % 7)::BIGINT AS cooc FROM listed a JOIN listed b ON a.book_id = b.book_id AND a.k <> b.k),
sums AS MATERIALIZED (SELECT p.book_id, x.g AS gram1, y.g AS gram2, x.kind || y.kind AS kind, sum(cooc)::BIGINT AS cooc FROM p JOIN near x ON x.m = p.g1 AND x.book_id = p.book_id JOIN near y ON y.m = p.g2 AND y.book_id = p.book_id WHERE x.g <> y.g AND x.kind || y.kind <> 'ee' GROUP BY ALL)"""


@query(PAIR_SUMS + " SELECT book_id, gram1, gram2, kind, cooc FROM sums")
def coref_pair_sums(spark, folder):
    found = names(spark, folder)
    return coref.pair_sums(closed(found), found, _pair_scores(found), ["cooc"])


@query(
    PAIR_SUMS
    + """, f AS (SELECT book_id, k, length(k) AS count, length(k) % 5 AS count_st FROM listed), lk AS (SELECT book_id, src AS a, dst AS b, 1 AS c FROM far UNION SELECT book_id, dst, src, 1 FROM far),
wide AS (SELECT book_id, gram1, gram2, """
    + ", ".join(f"sum(cooc) FILTER (kind = '{k}') AS cooc_{k}" for k in coref.KINDS)
    + """ FROM sums GROUP BY ALL)
SELECT p.book_id, p.g1 AS gram1, p.g2 AS gram2, p.cooc, a.count::INT AS "1_count", a.count_st::INT AS "1_count_st", b.count::INT AS "2_count", b.count_st::INT AS "2_count_st", """
    + ", ".join(f"coalesce(cooc_{k}, 0)::BIGINT AS cooc_{k}" for k in coref.KINDS)
    + """, coalesce(lk.c, 0)::INT AS coref FROM p JOIN f a ON a.k = p.g1 AND a.book_id = p.book_id JOIN f b ON b.k = p.g2 AND b.book_id = p.book_id
LEFT JOIN wide w ON w.book_id = p.book_id AND w.gram1 = p.g1 AND w.gram2 = p.g2 LEFT JOIN lk ON lk.book_id = p.book_id AND lk.a = p.g1 AND lk.b = p.g2"""
)
def pair_features_wide(spark, folder):
    found = names(spark, folder)
    far, p = closed(found), _pair_scores(found)
    return coref.pair_frame(p, name_features(found), ["count", "count_st"], coref.pair_sums(far, found, p, ["cooc"]), ["cooc"], far)


def matches(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Characters, candidates, the scores between them, and each character's best candidate."""
    top = n.top_words(spark, folder)
    people, found = saved(n.characters(top), "characters"), saved(n.names(top), "names")
    edges = saved(labels.match_edges(people, found, n.genders(top)), "matches")
    best = edges.groupBy("book_id", "character").agg(F.max_by(F.struct("gram_key", "weight"), F.struct(F.round("weight", 6), "gram_key")).alias("x")).select("book_id", "character", "x.*")
    return people, found, edges, best


_MATCHED = f"WITH {n.NAMED}, {n.MATCHED}"
_BEST = f"{_MATCHED}, best AS (SELECT book_id, character, gram_key FROM matched QUALIFY row_number() OVER (PARTITION BY book_id, character ORDER BY round(weight, 6) DESC, gram_key DESC) = 1)"


@query(f"{_MATCHED} SELECT book_id, character, gram_key, round(weight, 6) AS weight FROM matched")
def character_match_edges(spark, folder):
    return matches(spark, folder)[2].withColumn("weight", F.round("weight", 6))


@query()
def character_matching(spark, folder):
    return labels.matching(matches(spark, folder)[2]).withColumn("weight", F.round("weight", 6))


@query(f"{_MATCHED} SELECT book_id, k AS gram_key, ((book_id, k) IN (SELECT (book_id, gram_key) FROM matched))::INT AS label, '' AS matched FROM listed")
def label_candidates(spark, folder):
    _, found, edges, _ = matches(spark, folder)
    return labels.candidate_labels(found, edges)


@query(f"{_BEST} SELECT l.book_id, k AS gram_key, (b.gram_key IS NOT NULL)::INT AS label, coalesce(b.character, '') AS matched FROM listed l LEFT JOIN best b ON b.book_id = l.book_id AND b.gram_key = k")
def label_candidates_named(spark, folder):
    _, found, edges, best = matches(spark, folder)
    return labels.candidate_labels(found, edges, best)


_RELATED = "rel AS (SELECT * FROM (SELECT book_id, character AS c1, lead(character) OVER (PARTITION BY book_id ORDER BY character) AS c2 FROM chars) WHERE c2 IS NOT NULL)"


def _pairs_sql(either: str) -> str:
    return (
        f"{_MATCHED}, {_RELATED}, either AS ({either}), pos AS (SELECT DISTINCT book_id, gram_key FROM matched), "
        "hit AS (SELECT DISTINCT e.book_id, x.gram_key AS gram1, y.gram_key AS gram2, 1 AS one FROM either e JOIN matched x ON x.book_id = e.book_id AND x.character = c1 JOIN matched y ON y.book_id = e.book_id AND y.character = c2) "
        "SELECT a.book_id, a.gram_key AS gram1, b.gram_key AS gram2, coalesce(one, 0)::INT AS label FROM pos a JOIN pos b ON a.book_id = b.book_id AND a.gram_key <> b.gram_key LEFT JOIN hit h ON h.book_id = a.book_id AND h.gram1 = a.gram_key AND h.gram2 = b.gram_key"
    )


def _pair_labels(spark, folder, literal):
    people, found, edges, _ = matches(spark, folder)
    following = F.lead("character").over(co.Window.partitionBy("book_id").orderBy("character"))
    related = people.select("book_id", F.col("character").alias("c1"), following.alias("c2")).where("c2 IS NOT NULL")
    return labels.pair_labels(labels.candidate_labels(found, edges), edges, related, literal)


@query(_pairs_sql("SELECT * FROM rel UNION SELECT book_id, c2, c1 FROM rel"))
def relation_labels(spark, folder):
    return _pair_labels(spark, folder, False)


@query(_pairs_sql("SELECT * FROM rel"))
def relation_labels_literal(spark, folder):
    return _pair_labels(spark, folder, True)


_KINDS = """, edged AS (SELECT DISTINCT book_id, gram_key FROM matched), picked AS (SELECT DISTINCT book_id, gram_key FROM best),
cand AS (SELECT l.book_id, k, e.gram_key IS NOT NULL AS edge, p.gram_key IS NOT NULL AS pick FROM listed l LEFT JOIN edged e ON e.book_id = l.book_id AND e.gram_key = k LEFT JOIN picked p ON p.book_id = l.book_id AND p.gram_key = k),
missed AS (SELECT book_id, character FROM chars WHERE (book_id, character) NOT IN (SELECT (book_id, character) FROM best))"""


@query(f"{_BEST}{_KINDS} SELECT book_id, count(*) AS n_candidates, count(*) FILTER (edge AND NOT pick) AS duplicate, count(*) FILTER (NOT edge) AS invalid, (SELECT count(*) FROM missed WHERE missed.book_id = cand.book_id) AS unresolved FROM cand GROUP BY book_id")
def evaluate_candidates(spark, folder):
    people, found, edges, best = matches(spark, folder)
    return labels.candidate_quality(found, edges, best.dropDuplicates(["book_id", "gram_key"]), people)


@query(
    f"{_BEST}{_KINDS}, each AS (SELECT book_id, 'duplicate' AS kind, k AS name FROM cand WHERE edge AND NOT pick UNION ALL SELECT book_id, 'invalid', k FROM cand WHERE NOT edge UNION ALL SELECT book_id, 'unresolved', character FROM missed) "
    "SELECT book_id, kind, string_agg(name, '|' ORDER BY name) AS names FROM each GROUP BY ALL"
)
def candidate_quality_names(spark, folder):
    people, found, edges, best = matches(spark, folder)
    return labels.quality_names(found, edges, best, people).withColumn("names", F.array_join("names", "|"))


@query(
    f"{_BEST}{_KINDS}, size AS (SELECT book_id, count(*) AS n FROM chars GROUP BY ALL) SELECT book_id, round((SELECT count(*) FROM missed WHERE missed.book_id = cand.book_id) / any_value(n), 9) AS unresolved_rate, round(count(*) FILTER (edge AND NOT pick) / count(*), 9) AS duplicate_rate, round(count(*) FILTER (NOT edge) / count(*), 9) AS invalid_rate FROM cand JOIN size USING (book_id) GROUP BY book_id"
)
def evaluate_unique_names(spark, folder):
    """Rates of a whole run's evaluation; here all names count as predicted and unique."""
    people, found, edges, best = matches(spark, folder)
    return _rounded(labels.quality_rates(labels.candidate_quality(found, edges, best.dropDuplicates(["book_id", "gram_key"]), people), people))


@query(
    f"{_BEST}, hit AS (SELECT DISTINCT book_id, character FROM best), r AS (SELECT c.book_id, avg((h.character IS NULL)::INT) AS u FROM chars c LEFT JOIN hit h ON h.book_id = c.book_id AND h.character = c.character GROUP BY ALL) SELECT round(min(u), 9) AS least, round(max(u), 9) AS most, round(avg(u), 9) AS mean FROM r"
)
def unresolved_rates(spark, folder):
    people, _, _, best = matches(spark, folder)
    return _rounded(labels.rate_summary(labels.unresolved_rates(people, best)))


def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations as descriptions: a book is a tenth of them by number, a paragraph a conversation, its heading the first word, its text all turns."""
    t = table(spark, folder, "conversations")
    each = t.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))
    return each.select((F.col("conv_id") % 10).alias("book_id"), F.col("conv_id").alias("paragraph_id"), F.regexp_extract("text", "([A-Za-z]+)", 1).alias("heading"), "text")


_PARAGRAPHS_SQL = r"""pars AS (SELECT conv_id % 10 AS book_id, conv_id AS paragraph_id, regexp_extract(text, '([A-Za-z]+)', 1) AS heading, text FROM (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id)),
refs AS (SELECT DISTINCT book_id, heading AS reference, heading AS character FROM pars),
sts AS (SELECT book_id, paragraph_id, unnest(s) AS st, generate_subscripts(s, 1) - 1 AS sent_id FROM (SELECT *, string_split(regexp_replace(text, '\.[ \t]+', '.' || chr(1), 'g'), chr(1)) AS s FROM pars)),
words AS (SELECT book_id, paragraph_id, sent_id, w[:-2] AS w FROM (SELECT *, regexp_extract_all(st, '(?:Mr|Mrs|Ms|Dr|Prof|Jr)\.|''s|[\p{L}\p{N}]+|[^\s\p{L}\p{N}]') AS w FROM sts)),
each AS (SELECT book_id, paragraph_id, sent_id, unnest(w) AS word FROM words),
fam AS (SELECT book_id, paragraph_id, sent_id, unnest(range(1, len(w))) AS i, w FROM words),
fams AS (SELECT book_id, paragraph_id, sent_id, CASE WHEN len(w) >= i + 2 AND w[i + 2] IN ('children', 'house', 'family', 'people') AND EXISTS (SELECT 1 FROM refs r WHERE r.book_id = fam.book_id AND r.reference = w[i + 1]) THEN w[i + 1] ELSE w[i + 1][:-2] END AS last, w[i + 1] AS nextw FROM fam WHERE w[i] IN ('the', 'The') AND (ends_with(w[i + 1], 's') OR (len(w) >= i + 2 AND w[i + 2] IN ('children', 'house', 'family', 'people')))),
seen AS (SELECT DISTINCT book_id, paragraph_id, sent_id, character FROM each JOIN refs USING (book_id) WHERE word = reference
  UNION SELECT DISTINCT f.book_id, paragraph_id, sent_id, character FROM fams f JOIN refs r ON r.book_id = f.book_id AND r.character = f.last AND regexp_matches(r.character, '^[A-Z]')),
others AS (SELECT s.* FROM seen s JOIN pars p USING (book_id, paragraph_id) WHERE s.character <> p.heading)"""


@query("WITH " + _PARAGRAPHS_SQL + " SELECT DISTINCT book_id, least(character, heading) AS c1, greatest(character, heading) AS c2 FROM others JOIN pars USING (book_id, paragraph_id)")
def relations_from_descriptions(spark, folder):
    return rel.from_descriptions(saved(paragraphs(spark, folder), "paragraphs"))


_COMPARED = (
    "WITH "
    + _PARAGRAPHS_SQL
    + """, pred AS (SELECT DISTINCT book_id, least(character, heading) AS c1, greatest(character, heading) AS c2 FROM others JOIN pars USING (book_id, paragraph_id)),
truth AS (SELECT DISTINCT a.book_id, least(a.heading, b.heading) AS c1, greatest(a.heading, b.heading) AS c2 FROM pars a JOIN pars b ON a.book_id = b.book_id AND b.paragraph_id = a.paragraph_id + 10 WHERE a.heading <> b.heading),
j AS (SELECT coalesce(p.book_id, t.book_id) AS book_id, p.c1 IS NOT NULL AS p, t.c1 IS NOT NULL AS t FROM pred p FULL JOIN truth t ON p.book_id = t.book_id AND p.c1 = t.c1 AND p.c2 = t.c2),
compared AS (SELECT book_id, round(coalesce(count(*) FILTER (p AND t) / nullif(count(*) FILTER (p), 0), 1.0), 9) AS precision, round(count(*) FILTER (p AND t) / nullif(count(*) FILTER (t), 0), 9) AS recall FROM j GROUP BY ALL)"""
)


def _compared(spark: SparkSession, folder: str) -> DataFrame:
    p = saved(paragraphs(spark, folder), "paragraphs")
    after = p.select("book_id", (F.col("paragraph_id") - 10).alias("paragraph_id"), F.col("heading").alias("h2"))
    true = p.join(after, ["book_id", "paragraph_id"]).where("heading <> h2").select("book_id", F.least("heading", "h2").alias("c1"), F.greatest("heading", "h2").alias("c2"))
    found = rel.compare(rel.from_descriptions(p), true)
    return found.select("book_id", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(_COMPARED + " SELECT * FROM compared")
def relation_compare(spark, folder):
    return _compared(spark, folder)


@query(_COMPARED + " SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall FROM compared")
def relation_averages(spark, folder):
    return _rounded(rel.averages(_compared(spark, folder)), 6)


@query(_COMPARED + " SELECT * FROM compared WHERE precision < 0.7 OR recall < 0.7")
def relation_weak_books(spark, folder):
    return rel.weak_books(_compared(spark, folder))


@query(
    """WITH spans AS (SELECT doc_id, source AS book_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS stop FROM documents), spots AS (SELECT source AS book_id, unnest(range(0, sum(n_chars)::BIGINT, 5000)) AS s FROM documents GROUP BY source)
SELECT s.book_id, s.s, p.doc_id AS paragraph_id FROM spots s JOIN spans p ON s.book_id = p.book_id AND p.stop - n_chars <= s AND s < p.stop"""
)
def range_mention_paragraph(spark, folder):
    from pyspark.sql import Window

    d = table(spark, folder, "documents").select(F.col("source").alias("book_id"), F.col("doc_id").cast("int").alias("paragraph_id"), "n_chars")
    stop = F.sum("n_chars").over(Window.partitionBy("book_id").orderBy("paragraph_id"))
    spans = d.withColumn("stop", stop).select("book_id", "paragraph_id", (F.col("stop") - F.col("n_chars")).cast("int").alias("start"), F.col("stop").cast("int").alias("stop")).where("start < stop")
    spots = d.groupBy("book_id").agg(F.sum("n_chars").alias("n")).where("n > 0").select("book_id", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1, F.lit(5000))).alias("s"))
    return rel.mention_paragraphs(spots, spans).select("book_id", F.col("s").cast("bigint").alias("s"), F.col("paragraph_id").cast("bigint").alias("paragraph_id"))


_OCC = "occ AS (SELECT l_returnflag AS book_id, l_orderkey AS s, l_suppkey AS item, count(*) AS n FROM lineitem GROUP BY ALL)"
_W = ", w AS (SELECT book_id, item, sum(n) / sum(sum(n)) OVER (PARTITION BY book_id) AS w FROM occ GROUP BY book_id, item), num AS (SELECT book_id, count(DISTINCT s) AS num FROM occ GROUP BY ALL), cnt AS (SELECT book_id, item, count(*) AS count_s FROM occ GROUP BY ALL), sh AS (SELECT *, count_s / sum(count_s) OVER (PARTITION BY book_id) AS ws FROM cnt)"


def orders(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Order lines as occurrences: a book is a return flag, a section an order, an item a supplier; and each item's share of its book's lines."""
    lines = table(spark, folder, "lineitem").select(F.col("l_returnflag").alias("book_id"), F.lit("order").alias("section_type"), F.col("l_orderkey").alias("section_id"), F.col("l_suppkey").alias("item"))
    counts = lines.groupBy("book_id", "item").agg(F.count("*").alias("n"))
    return lines, counts.select("book_id", "item", (F.col("n") / F.sum("n").over(co.Window.partitionBy("book_id"))).alias("w"))


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*(F.round(n, digits).alias(n) if k == "double" else F.col(n) for n, k in df.dtypes))


@query("WITH " + _OCC + _W + " SELECT book_id, 'order' AS section_type, item, count_s, round(count_s / num, 9) AS count_norm_length_s, round(ws, 9) AS count_norm_char_s FROM sh JOIN num USING (book_id)")
def section_counts(spark, folder):
    return _rounded(co.section_counts(orders(spark, folder)[0]))


@query(
    "WITH "
    + _OCC
    + _W
    + """, c AS (SELECT a.book_id, a.item AS i, b.item AS j, count(*) AS c FROM occ a JOIN occ b USING (book_id, s) GROUP BY ALL), r AS (SELECT *, sum(c) OVER (PARTITION BY book_id, i) AS row FROM c),
f AS (SELECT r.book_id, i AS item, sum(c)::BIGINT AS cooc_cand_s, sum(c / row * ws) AS a1, sum(c / row * w) AS a2, sum(ws) AS a3, sum(w) AS a4 FROM r JOIN sh ON sh.book_id = r.book_id AND sh.item = j JOIN w ON w.book_id = r.book_id AND w.item = j GROUP BY ALL),
top AS (SELECT book_id, item FROM w QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY w DESC, item) <= 40), ms AS (SELECT DISTINCT book_id, s FROM occ JOIN top USING (book_id, item)), m AS (SELECT book_id, item, count(*) AS cooc_sec_s FROM occ JOIN ms USING (book_id, s) GROUP BY ALL)
SELECT sh.book_id, 'order' AS section_type, sh.item, count_s, round(count_s / num, 9) AS count_norm_length_s, round(ws, 9) AS count_norm_char_s, cooc_cand_s, round(a1, 9) AS cooc_cand_norm_sec_s, round(a2, 9) AS cooc_cand_norm_char_s, round(a3, 9) AS cooc_cand_dd_norm_sec_s, round(a4, 9) AS cooc_cand_dd_norm_char_s,
  coalesce(cooc_sec_s, 0) AS cooc_sec_s, round(coalesce(cooc_sec_s, 0) / num, 9) AS cooc_sec_norm_length_s FROM sh JOIN num USING (book_id) JOIN f USING (book_id, item) LEFT JOIN m USING (book_id, item)"""
)
def cooc_features(spark, folder):
    occurrences, weights = orders(spark, folder)
    return _rounded(co.features(occurrences, weights))


@query(
    "WITH "
    + _OCC
    + _W
    + ", top AS (SELECT book_id, item FROM w QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY w DESC, item) <= 40), ms AS (SELECT DISTINCT book_id, s FROM occ JOIN top USING (book_id, item)) SELECT book_id, 'order' AS section_type, item, count(*) AS cooc_sec_s, round(count(*) / any_value(num), 9) AS cooc_sec_norm_length_s FROM occ JOIN ms USING (book_id, s) JOIN num USING (book_id) GROUP BY book_id, item"
)
def cooc_major(spark, folder):
    occurrences, weights = orders(spark, folder)
    return _rounded(co.with_major(occurrences, weights))


_EVENTS = "occ AS (SELECT DISTINCT 'events' AS book_id, user_id::VARCHAR || '/' || strftime(ts, '%Y-%m-%d') AS s, event_type AS item FROM events)"


@query("WITH " + _EVENTS + " SELECT 'events' AS book_id, 'day' AS section_type, a.item, b.item AS other, count(*) AS cooc FROM occ a JOIN occ b USING (s) GROUP BY ALL")
def cooc_pairs(spark, folder):
    e = table(spark, folder, "events").select(F.lit("events").alias("book_id"), F.lit("day").alias("section_type"), F.concat_ws("/", F.col("user_id").cast("string"), F.date_format("ts", "yyyy-MM-dd")).alias("section_id"), F.col("event_type").alias("item"))
    return co.pairs(e)


@query(
    "WITH "
    + _OCC
    + _W
    + """, c AS (SELECT a.book_id, a.item AS i, b.item AS j, count(*) AS c FROM occ a JOIN occ b USING (book_id, s) GROUP BY ALL), r AS (SELECT *, sum(c) OVER (PARTITION BY book_id, i) AS row FROM c)
SELECT r.book_id, 'order' AS section_type, i AS item, j AS other, c AS cooc, round(c / row * ws, 9) AS cooc_norm_sec, round(c / row * w, 9) AS cooc_norm_char, 1 AS cooc_bool, round(ws, 9) AS cooc_bool_norm_sec, round(w, 9) AS cooc_bool_norm_char FROM r JOIN sh ON sh.book_id = r.book_id AND sh.item = j JOIN w ON w.book_id = r.book_id AND w.item = j WHERE i <> j"""
)
def pair_cooc_features(spark, folder):
    return _rounded(co.pair_features(*orders(spark, folder)))
