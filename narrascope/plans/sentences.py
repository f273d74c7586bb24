"""SQL that splits documents into sentences of words."""

SENTENCES = r"""WITH pgs AS (SELECT source AS book_id, doc_id AS cp_id, unnest(p) AS pg, generate_subscripts(p, 1) - 1 AS pg_id FROM (SELECT *, string_split_regex(text, '\n+') AS p FROM documents)),
sts AS (SELECT book_id, cp_id, pg_id, unnest(s) AS st_text, generate_subscripts(s, 1) - 1 AS st FROM
  (SELECT *, string_split(regexp_replace(regexp_replace(pg, '\b(Mr|Mrs|Ms|Dr|Prof|Jr)\. ', '\1.' || chr(2), 'g'), '\.[ \t]+', '.' || chr(1), 'g'), chr(1)) AS s FROM pgs)),
sents AS (SELECT * FROM (SELECT book_id, cp_id, pg_id, pg_id || '-' || st AS st_id, regexp_extract_all(replace(st_text, chr(2), ' '), '(?:Mr|Mrs|Ms|Dr|Prof|Jr)\.|''s|[\p{L}\p{N}]+|[^\s\p{L}\p{N}]') AS w FROM sts) WHERE len(w) > 0)"""
