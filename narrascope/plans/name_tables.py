"""Names drawn from the tables, and SQL for comparing names.

A book is a language, its words the most frequent capitalised ones of its documents; names are
made up of a word and the next one, with titles and initials. SQL compares tokens pair by pair
into maps and folds names over them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from narrascope.functions import matching as m
from narrascope.operators.frames import saved, table

WORDS = 14

#: CTEs top(book_id, w, r, nxt), listed(book_id, k), genders(name, gender), chars(book_id, character, refs).
TABLES = f"""caps AS (SELECT lang AS book_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{{2,}}')) AS w FROM documents WHERE lang IS NOT NULL),
ranks AS (SELECT book_id, w, row_number() OVER (PARTITION BY book_id ORDER BY count(*) DESC, w) AS r FROM caps GROUP BY book_id, w),
top AS (SELECT a.book_id, a.w, a.r, b.w AS nxt FROM ranks a JOIN ranks b ON a.book_id = b.book_id AND b.r = a.r % {WORDS} + 1 WHERE a.r <= {WORDS}),
listed AS (SELECT DISTINCT book_id, unnest([w || ' ' || nxt] || CASE WHEN r % 2 = 0 THEN [w] ELSE [] END || CASE r % 3 WHEN 0 THEN ['Mr. ' || nxt] WHEN 1 THEN ['Mrs. ' || nxt] ELSE ['Mister ' || nxt] END
  || CASE WHEN r % 5 = 0 THEN ['Doctor ' || nxt, 'The ' || w] ELSE [] END || CASE WHEN r % 4 = 0 THEN [w[1] || '. ' || nxt, w[1:4] || ' ' || nxt, w || 's'] ELSE [] END) AS k FROM top),
genders AS (SELECT lower(w) AS name, min(CASE r % 3 WHEN 0 THEN 'MALE' ELSE 'FEMALE' END) AS gender FROM top WHERE r % 3 < 2 GROUP BY lower(w)),
chars AS (SELECT book_id, w || ' ' || nxt AS character, CASE WHEN r % 5 = 0 THEN ['Dr. ' || nxt] WHEN r % 5 = 1 THEN [w || ' ' || w] ELSE [] END AS refs FROM top WHERE r % 2 = 1)"""


def top_words(spark: SparkSession, folder: str, book: str = "lang") -> DataFrame:
    """book_id, w, r, nxt: at most WORDS rows a language, or a value of another column."""
    caps = table(spark, folder, "documents").where(F.col(book).isNotNull()).select(F.col(book).alias("book_id"), F.explode(F.regexp_extract_all("text", F.lit("[A-Z][a-z]{2,}"), F.lit(0))).alias("w"))
    counts = caps.groupBy("book_id", "w").agg(F.count("*").alias("n"))
    r = F.row_number().over(Window.partitionBy("book_id").orderBy(F.desc("n"), "w"))
    top = saved(counts.select("book_id", "w", r.alias("r")).where(F.col("r") <= WORDS), "top-words")
    following = top.select("book_id", F.when(F.col("r") == 1, WORDS).otherwise(F.col("r") - 1).alias("r"), F.col("w").alias("nxt"))
    return saved(top.join(following, ["book_id", "r"]).select("book_id", "w", "r", "nxt"), "top-words")


def names(top: DataFrame) -> DataFrame:
    either = lambda test, *forms: F.when(test, F.array(*(F.concat(*x) for x in forms))).otherwise(F.array().cast("array<string>"))
    r, w, nxt, lit = F.col("r"), F.col("w"), F.col("nxt"), F.lit
    title = F.when(r % 3 == 0, "Mr. ").when(r % 3 == 1, "Mrs. ").otherwise("Mister ")
    forms = F.concat(
        F.array(F.concat(w, lit(" "), nxt), F.concat(title, nxt)),
        either(r % 2 == 0, (w,)),
        either(r % 5 == 0, (lit("Doctor "), nxt), (lit("The "), w)),
        either(r % 4 == 0, (F.substring(w, 1, 1), lit(". "), nxt), (F.substring(w, 1, 4), lit(" "), nxt), (w, lit("s"))),
    )
    return top.select("book_id", F.explode(forms).alias("gram_key")).distinct().withColumn("gram", F.split("gram_key", " "))


def genders(top: DataFrame) -> DataFrame:
    return top.where("r % 3 < 2").groupBy(F.lower("w").alias("name")).agg(F.min(F.when(F.col("r") % 3 == 0, "MALE").otherwise("FEMALE")).alias("gender"))


def characters(top: DataFrame) -> DataFrame:
    refs = F.when(F.col("r") % 5 == 0, F.array(F.concat(F.lit("Dr. "), "nxt"))).when(F.col("r") % 5 == 1, F.array(F.concat("w", F.lit(" "), "w"))).otherwise(F.array().cast("array<string>"))
    return top.where("r % 2 = 1").select("book_id", F.concat("w", F.lit(" "), "nxt").alias("character"), refs.alias("references"))


def _listed(words) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _low(x: str) -> str:
    return f"(lower({x}[1]) || {x}[2:])"


_STRICT = "(CASE WHEN ends_with({b}, '.') AND NOT ends_with({a}, '.') AND (starts_with({a}, {b}[:-2]) OR (length({b}) = 3 AND starts_with({a}, {b}[1]) AND ends_with({a}, {b}[2]))) THEN true ELSE {a} = {b} END)"


def strict(a: str, b: str) -> str:
    return _STRICT.format(a=a, b=b)


def _lcs(of: str, b: str) -> str:
    """Folds the letters of `of` into {row, i, best}: the last row of the table, and the best similarity of b with a proper prefix."""
    row = f"list_reduce(range(1, length({b}) + 1), lambda q, j: list_append(q, CASE WHEN {b}[j] = c THEN s.row[j] + 1 ELSE greatest(s.row[j + 1], q[j]) END), [0::BIGINT])"
    step = f"{{'row': {row}, 'i': s.i + 1, 'best': 0::BIGINT}}"
    rated = f"{{'row': x.row, 'i': x.i, 'best': CASE WHEN x.i < length({of}) THEN greatest(s.best, floor(200 * x.row[length({b}) + 1] / (x.i + length({b})) + 0.5)::BIGINT) ELSE s.best END}}"
    # the step's row is named once: a list of one element stands for a binding
    return f"list_reduce(string_split({of}, ''), lambda s, c: list_transform([{step}], lambda x: {rated})[1], {{'row': list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT), 'i': 0::BIGINT, 'best': 0::BIGINT}})"


#: CTEs tok(t) of all tokens, pairs(a, b, strict, fuzzy, score), and one row `maps` of maps from 'outer|inner' to each.
TOKENS = f"""tok AS (SELECT DISTINCT unnest(string_split(k, ' ')) AS t FROM (SELECT k FROM listed UNION SELECT character FROM chars UNION SELECT unnest(refs) FROM chars) AS every(k)),
low AS (SELECT t, {_low('t')} AS u, t IN {_listed(m.TITLES)} AS title, {_low('t')} IN {_listed(m.TITLES)} AS low_title FROM tok),
folded AS (SELECT x.t AS a, y.t AS b, x.u AS ua, y.u AS ub, x.title OR y.title AS title, x.low_title OR y.low_title AS low_title, {_lcs('x.u', 'y.u')} AS f FROM low x, low y),
rated AS (SELECT *, floor(200 * f.row[-1] / (length(ua) + length(ub)) + 0.5)::BIGINT AS ratio FROM folded),
pairs AS (SELECT a, b, {strict('ua', 'ub')} AS strict, NOT title AND (contains(ua, ub) OR f.best >= 70) AS fuzzy,
  CASE WHEN (ua = 'grey' AND ub = 'gray') OR (ua = 'gray' AND ub = 'grey') THEN 1.0 WHEN ub = ua || 's' OR ua = ub || 's' OR title OR low_title THEN 0.0 WHEN ends_with(ub, '.') AND starts_with(ua, ub[:-2]) THEN 0.5 WHEN ratio >= 80 THEN ratio / 100.0 ELSE 0.0 END::DOUBLE AS score FROM rated),
maps AS MATERIALIZED (SELECT map(list(a || '|' || b), list(strict)) AS ms, map(list(a || '|' || b), list(fuzzy)) AS mf, map(list(a || '|' || b), list(score)) AS mt FROM pairs)"""


def contains(out: str, inn: str, of: str) -> str:
    at = lambda a, b: f"{of}[{a} || '|' || {b}]"
    walk = f"list_reduce({out}, lambda i, t: CASE WHEN i <= len({inn}) AND {at('t', f'{inn}[i]')} THEN i + 1 ELSE i END, 1::BIGINT)"
    return f"coalesce(len({out}) > 0 AND len({inn}) > 0 AND {out} <> {inn} AND ({at(f'{out}[1]', f'{inn}[1]')} OR {at(f'{out}[-1]', f'{inn}[-1]')}) AND {walk} = len({inn}) + 1, false)"


def _canonical(token: str) -> str:
    return f"(CASE {token} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in m.TITLES.items()) + " END)"


def _agrees(title: str, gender: str) -> str:
    return f"(({gender} = 'MALE' AND {title} IN {_listed(m.MALE_TITLES)}) OR ({gender} = 'FEMALE' AND {title} IN {_listed(m.FEMALE_TITLES)}))"


def resolves(out: str, inn: str, gender: str) -> str:
    title, other = f"{inn}[1]", f"{out}[1]"
    same = f"CASE WHEN {_canonical(title)} <> {_canonical(other)} THEN false WHEN {out}[2:] = {inn}[2:] THEN true ELSE {contains(f'{out}[2:]', f'{inn}[2:]', 'ms')} END"
    agrees = f"CASE WHEN {title} IN {_listed(m.OTHER_TITLES)} THEN true WHEN {gender} IS NOT NULL THEN {_agrees(title, gender)} ELSE {strict(_low(f'lower({other})'), _low(f'lower({inn}[2])'))} END"
    return f"coalesce({out} <> {inn} AND {title} IN {_listed(m.TITLES)} AND CASE WHEN {other} IN {_listed(m.TITLES)} THEN {same} ELSE {contains(out, f'{inn}[2:]', 'ms')} AND {agrees} END, false)"


def name_score(out: str, inn: str) -> str:
    at = lambda a, b: f"coalesce(mt[{a} || '|' || {b}], 0.0)"
    fold = (
        f"list_reduce({out}, lambda s, t: list_transform([CASE WHEN s.i > len({inn}) THEN -1.0 ELSE {at('t', f'{inn}[s.i]')} END], lambda x: {{'i': s.i + CASE WHEN x > 0 THEN 1 ELSE 0 END, 'at': s.at + 1, "
        f"'sum': CASE WHEN x < 0 THEN s.sum WHEN x > 0 THEN s.sum + x + CASE WHEN s.at = 0 THEN 0.5 ELSE 0.0 END ELSE s.sum - 0.1 END}})[1], {{'i': 1::BIGINT, 'at': 0::BIGINT, 'sum': 0.0::DOUBLE}})"
    )
    return (
        f"(CASE WHEN len({inn}) = 0 OR len({out}) = 0 OR (len({inn}) = 1 AND {inn}[1] IN {_listed(m.TITLES)}) THEN 0.0 WHEN {at(f'{out}[1]', f'{inn}[1]')} > 0 OR {at(f'{out}[-1]', f'{inn}[-1]')} > 0 "
        f"THEN list_transform([{fold}], lambda s: CASE WHEN s.i = len({inn}) + 1 THEN s.sum ELSE 0.0 END)[1] ELSE 0.0 END)"
    )


def reference_score(out: str, inn: str, gender: str) -> str:
    title, other = f"{inn}[1]", f"{out}[1]"
    agreed = f"CASE WHEN {title} IN {_listed(m.OTHER_TITLES)} THEN 0.2 WHEN {gender} IS NULL THEN 0.0 WHEN {_agrees(title, gender)} THEN 0.2 END"
    both = f"CASE WHEN {_canonical(title)} <> {_canonical(other)} THEN 0.0 ELSE {name_score(f'{out}[2:]', f'{inn}[2:]')} END"
    one = f"list_transform([{name_score(out, f'{inn}[2:]')}], lambda v: CASE WHEN v > 0 AND {agreed} IS NOT NULL THEN v + {agreed} ELSE 0.0 END)[1]"
    titled = f"CASE WHEN {title} NOT IN {_listed(m.TITLES)} THEN 0.0 WHEN {other} IN {_listed(m.TITLES)} THEN {both} ELSE {one} END"
    return f"(CASE WHEN len({out}) < len({inn}) THEN 0.0 WHEN {out} = {inn} THEN (len({inn}) + 1)::DOUBLE ELSE list_transform([{name_score(out, inn)}], lambda w: CASE WHEN w > 0 THEN w ELSE {titled} END)[1] END)"


#: CTE prs(book_id, src, dst, inn, out, gender, maps): all pairs of a book's names, for SQL on small tables only.
PAIRS = "prs AS MATERIALIZED (SELECT a.book_id, a.k AS src, b.k AS dst, string_split(a.k, ' ') AS inn, string_split(b.k, ' ') AS out, gender FROM listed a JOIN listed b ON a.book_id = b.book_id AND a.k <> b.k LEFT JOIN genders g ON g.name = lower(string_split(b.k, ' ')[1]))"
NAMED = f"{TABLES},\n{TOKENS},\n{PAIRS}"
EDGES = {kind: f"SELECT book_id, src, dst FROM prs, maps WHERE {test}" for kind, test in (("partial", contains("out", "inn", "ms")), ("nickname", contains("out", "inn", "mf")), ("title", resolves("out", "inn", "gender")))}
#: CTE matched(book_id, character, gram_key, weight): the best direct score of each candidate, and for characters without one their best reverse score.
MATCHED = f"""nm AS (SELECT book_id, character, string_split(n, ' ') AS out, gender FROM (SELECT book_id, character, unnest([character] || refs) AS n FROM chars) LEFT JOIN genders g ON g.name = lower(string_split(n, ' ')[1])),
scored AS MATERIALIZED (SELECT nm.book_id, character, k AS gram_key, max({reference_score('out', 'inn', 'gender')}) AS weight FROM nm JOIN (SELECT book_id, k, string_split(k, ' ') AS inn FROM listed) l ON l.book_id = nm.book_id, maps GROUP BY ALL),
direct AS (SELECT * FROM scored WHERE weight > 0),
back AS (SELECT c.book_id, c.character, k AS gram_key, {reference_score('out', 'inn', 'gender')} AS weight FROM (SELECT book_id, character, string_split(character, ' ') AS inn FROM chars WHERE (book_id, character) NOT IN (SELECT (book_id, character) FROM direct)) c
  JOIN (SELECT book_id, k, string_split(k, ' ') AS out, gender FROM listed LEFT JOIN genders g ON g.name = lower(string_split(k, ' ')[1])) l ON l.book_id = c.book_id, maps),
matched AS MATERIALIZED (SELECT * FROM direct UNION ALL SELECT * FROM back WHERE weight > 0 QUALIFY row_number() OVER (PARTITION BY book_id, character ORDER BY weight DESC, gram_key DESC) = 1)"""
